"""SimHash near-dedup with an exact check: documents whose sets of word shingles have a Jaccard similarity of ``p / q`` or more.

``simhash`` makes a fingerprint of every text and finds by its vantage-point trees what lies within a radius; both sets decide
each of its links, and what these connect needs no other search. A fingerprint's majority bits differ by chance, so no radius
finds every pair of a similarity. The rest has an exact way:

1. Every shingle of every distinct text is counted: shards by hash tell each chunk of texts how many texts have its shingles, so
   far as that is two or more (by classes of frequency, a power of two each).
2. Shingles of a text are ordered by that class, rare first, then by hash. Of two sets that share alpha members the
   first ``n - alpha + 1`` of each share one (n: its size), in any order that both follow; a set of n
   members shares at least ``ceil(p n / q)`` with any set so alike. These first members are a set's signatures; those that
   no other text has are left out, so that a text unlike all others sends nothing.
3. Sets that share a signature, that SimHash hasn't connected and whose sizes allow the similarity are paired; both sets then decide, member by member.
4. A signature of over ``MANY`` sets (a family of near copies; in other texts a rarer one comes first) isn't paired: the sets that such
   signatures connect are searched for a spanning forest, in blocks of bounded bytes. A few sets stand in every block and mostly
   connect a family at once; if not, every two blocks are searched too. What SimHash has connected isn't compared there.

Shingles are told apart by 64-bit hashes of their words, sets by the XXH64 of those; 32 bits of a hash name a signature in its
shard, and what is mistaken for another is only compared in vain.

Defined results. Null and blank texts: one class, like no other. Fewer words than a shingle: the whole sequence is one shingle. A-Z
equal a-z. Repeated rows: a result row each. component_id is the least doc_id of the component; null ids are ignored unless
there is no other. Very long texts: whole. Empty table: empty result.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import chunk_count, cut, given_back, heavy, id_and_text, join_back, join_parts, lean, mix, slices, small_batches, stored, swept
from .graph import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
#: Sets that share a signature are paired up to so many, and searched in blocks beyond.
MANY = 16
BLOCK_BYTES, BLOCK_SETS, PIVOTS = 64 << 20, 4096, 16
U = np.uint64
PIECE = "chunk int, shard bigint, a binary, b binary"


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word by all of its bytes: eight at a time, and XXH64 for those over 24."""
    import xxhash

    b = np.frombuffer(raw + bytes(32), np.uint8)
    eights = np.lib.stride_tricks.as_strided(b, (len(b) - 7, 8), (1, 1))
    size = (ends - starts).astype(U)
    h = size * U(0x9E3779B97F4A7C15)
    for k in (0, 8, 16):
        here = np.flatnonzero(size > k) if k else np.arange(len(starts))
        left = np.minimum(size[here] - U(k), U(8))
        part = eights[starts[here] + k].copy().view("<u8").ravel()
        keep = np.where(left == 8, ~U(0), (U(1) << (U(8) * (left % U(8)))) - U(1))
        h[here] = mix(h[here] ^ (part & keep))
    for i in np.flatnonzero(size > 24).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]], SEED)
    return h


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles of one text, ascending."""
    raw = b" ".join(text.encode("utf-8", "surrogatepass").translate(LOWER).split())
    if not raw:
        return np.zeros(0, U)
    gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    one = word_hashes(raw, np.append(0, gaps + 1), np.append(gaps, len(raw)))
    k = min(shingle, len(one))
    n = len(one) - k + 1
    h = np.full(n, U(k))
    for j in range(k):
        h = mix(h * U(0xC2B2AE3D27D4EB4F) + one[j : j + n])
    return np.unique(h)


def class_of(found: np.ndarray) -> int:
    """The id of all texts with this set of shingles."""
    import xxhash

    x = xxhash.xxh64_intdigest(found.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


class Bound:
    """Jaccard similarity of at least a fraction, in whole numbers."""

    def __init__(self, similarity: float):
        self.p, self.q = Fraction(similarity).limit_denominator(1000).as_integer_ratio()
        if not 0 < self.p < self.q:
            raise ValueError("similarity must lie between 0 and 1")

    def alike(self, a, b, both):
        """Whether sets of ``a`` and ``b`` members, ``both`` of them shared, are."""
        return (self.p + self.q) * both >= self.p * (a + b)

    def sizes(self, a, b):
        """Whether sets of such sizes can be."""
        return (self.p * a <= self.q * b) & (self.p * b <= self.q * a)

    def prefix(self, n):
        """How many members, the first in an order, hold one of any such set's first."""
        return np.where(n > 0, n + (-self.p * n // self.q) + 1, 0)


def split_code(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard (above) and code (below) of hashes, in one word."""
    return ((h & U(0xFFFFFFFF)) % U(shards)) << U(32) | h >> U(32)


def _by_shard(keys: np.ndarray, *columns: np.ndarray):
    """(shard, codes, columns) of keys that ascend by shard."""
    shard = keys >> U(32)
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(keys) else np.zeros(0, np.int64)
    codes = np.split((keys & U(0xFFFFFFFF)).astype("<u4"), at[1:])
    return zip(shard[at].astype(np.int64).tolist(), codes, *[np.split(c, at[1:]) for c in columns])


def _pieces(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["chunk", "shard", "a", "b"])


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All members, the set of each, and sizes."""
    size = np.array([len(x) for x in sets], np.int64)
    return np.concatenate([np.zeros(0, U), *sets]), np.repeat(np.arange(len(sets)), size), size


def signatures(sets: list[np.ndarray], level: np.ndarray, bound: Bound) -> tuple[np.ndarray, np.ndarray]:
    """(set, member) of the first members by level and hash; ``level``: of each member of the sets in turn."""
    h, row, size = _flat(sets)
    order = np.lexsort((h, level, row))
    rank = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    first = order[rank < bound.prefix(size)[row]]  # rows stay in place: only the order within a row changes
    return row[first], first


def set_forest(sets: list[np.ndarray], bound: Bound, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (by place) of a spanning forest of the graph of all pairs of ``sets`` that are alike.

    ``part``: sets of the same part are connected already, so they are linked without a comparison.
    Sets flip a bit of a sketch for each member: no more bits differ than members do, so far sketches rule a pair out. Exact counts decide the others.
    """
    flat, _, size = _flat(sets)
    start = np.cumsum(size) - size
    flips = [np.bincount((mix(x ^ U(79)) & U(1023)).astype(np.int64), minlength=1024) & 1 for x in sets]
    sketch = np.array([np.packbits(f.astype(np.uint8)).view(U) for f in flips], U).reshape(-1, 16)
    p, q = bound.p, bound.q

    def within(v: int, others: np.ndarray) -> np.ndarray:
        both = size[v] + size[others]
        hit = bound.sizes(size[v], size[others])
        at = np.flatnonzero(hit)
        hit[at] = np.bitwise_count(sketch[others[at]] ^ sketch[v]).sum(axis=1, dtype=np.int64) * (p + q) <= both[at] * (q - p)
        near = np.flatnonzero(hit)
        for at in range(0, len(near), 500):
            some = near[at : at + 500]
            n = size[others[some]]
            owner = np.repeat(np.arange(len(some)), n)
            x = flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[others[some]][owner]]
            there = np.searchsorted(sets[v], x)
            shared = np.bincount(owner[sets[v][np.minimum(there, size[v] - 1)] == x], minlength=len(some)) if size[v] else np.zeros(len(some), np.int64)
            hit[some] = bound.alike(size[v], n, shared)
        return hit

    links: list[tuple[int, int]] = []
    open_ = np.arange(len(sets))
    while len(open_):
        queue, open_ = [int(open_[0])], open_[1:]
        while queue and len(open_):
            v = queue.pop()
            hit = part[open_] == part[v] if part is not None else np.zeros(len(open_), bool)
            hit[~hit] = within(v, open_[~hit])
            reached = open_[hit].tolist()
            links += [(v, j) for j in reached]
            queue += reached
            open_ = open_[~hit]
    return links


def candidates(docs: DataFrame, shingle: int, bound: Bound, hot: dict[int, int | None], text_col: str, id_col: str) -> DataFrame:
    """Of each distinct set that may have a partner a row (id, a: its members), and rows (shard, a: ids, b: sizes, c: codes) of signatures.

    ``hot``: of sets that very many rows have, the doc_id of the row that is sent.
    """
    shards = chunk_count(docs, 3 << 20)

    def named(batches):
        sent: set[int] = set()
        for b in slices(batches, 200):
            ids, keep = [], []
            for k, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                i = class_of(shingle_set(text, shingle))
                if i not in sent and (i not in hot or hot[i] == doc):
                    sent.add(i)
                    ids.append(i), keep.append(k)
            ids = np.array(ids, np.int64)
            chunk = (mix(ids.view(U)) % U(shards)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(ids), b.column(1).take(pa.array(keep, pa.int32()))], ["chunk", "id", "text"])

    def sets_of(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        ids, first = np.unique(table.column("id").to_numpy(), return_index=True)
        return ids, [shingle_set(t, shingle) for t in table.column("text").take(pa.array(first)).to_pylist()]

    def codes(key, table):
        """To each shard: the chunk's codes, and how many of its sets have each (up to 255)."""
        _, sets = sets_of(table)
        u, n = np.unique(split_code(_flat(sets)[0], shards), return_counts=True)
        return _pieces([(key[0].as_py(), s, c.tobytes(), k.tobytes()) for s, c, k in _by_shard(u, np.minimum(n, 255).astype(np.uint8))])

    def levels(key, table):
        """To each chunk: those of its codes that two sets and more have, with the class of that number."""
        rows = list(zip(*[table.column(c).to_pylist() for c in ("chunk", "a", "b")]))
        code, n = np.frombuffer(b"".join(r[1] for r in rows), "<u4"), np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        u, at = np.unique(code, return_inverse=True)
        level = np.frexp(np.bincount(at, n, len(u)))[1].astype(np.uint8)[at]  # 1 for one set, 2 for two and three, 3 for four to seven
        cuts = np.cumsum([len(r[2]) for r in rows])[:-1]
        out = []
        for r, c, v in zip(rows, np.split(code, cuts), np.split(level, cuts)):
            if (v > 1).any():
                out.append((r[0], key[0].as_py(), c[v > 1].tobytes(), v[v > 1].tobytes()))
        return _pieces(out)

    def signed(key, left, right):
        ids, sets = sets_of(left)
        said = list(zip(*[right.column(c).to_pylist() for c in ("shard", "a", "b")]))
        known = np.concatenate([np.zeros(0, U), *[U(s) << U(32) | np.frombuffer(a, "<u4").astype(U) for s, a, _ in said]])
        level_of = np.frombuffer(b"".join(b for _, _, b in said), np.uint8)
        order = np.argsort(known)
        known, level_of = known[order], level_of[order]
        h, _, size = _flat(sets)
        code = split_code(h, shards)
        at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
        level = np.where(known[at] == code, level_of[at], 1) if len(known) else np.ones(len(code), np.uint8)
        row, member = signatures(sets, level, bound)
        use = level[member] > 1
        row, code = row[use], code[member[use]]
        order = np.argsort(code, kind="stable")
        out: dict[str, list] = {c: [] for c in ("shard", "id", "a", "b", "c")}
        for shard, codes, owner in _by_shard(code[order], row[order]):
            for name, x in zip(out, (shard, None, ids[owner].tobytes(), size[owner].astype("<u4").tobytes(), codes.tobytes())):
                out[name].append(x)
        for i in np.unique(row).tolist():
            for name, x in zip(out, (None, int(ids[i]), sets[i].tobytes(), None, None)):
                out[name].append(x)
        return pa.table(out, schema=pa.schema([("shard", pa.int64()), ("id", pa.int64()), *[(c, pa.binary()) for c in "abc"]]))

    texts = id_and_text(docs, text_col, id_col).mapInArrow(lean(named), "chunk int, id bigint, text string").repartition("chunk").groupBy("chunk")
    told = texts.applyInArrow(lambda key, table: given_back(codes(key, table)), PIECE)
    told = told.groupBy("shard").applyInArrow(lambda key, table: given_back(levels(key, table)), PIECE)
    return texts.cogroup(told.groupBy("chunk")).applyInArrow(lambda key, left, right: given_back(signed(key, left, right)), "shard bigint, id bigint, a binary, b binary, c binary")


def meetings(bound: Bound):
    """Of a shard's signatures: many, a, b (a < b): all pairs of up to MANY sets that share one; of more each set with the first."""

    def met(table: pa.Table) -> pa.Table:
        return given_back(paired(table))

    def paired(table: pa.Table) -> pa.Table:
        join = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        ids, size, code = join("a", "<i8"), join("b", "<u4").astype(np.int64), join("c", "<u4")
        order = np.lexsort((ids, code))
        ids, size, code = ids[order], size[order], code[order]
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (ids[1:] != ids[:-1])]) if len(ids) else np.zeros(0, bool)
        ids, size, code = ids[new], size[new], code[new]
        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(ids) else np.zeros(0, np.int64)
        n = np.diff(start, append=len(ids))
        out = [(True, np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in range(2, MANY + 1):
            of = start[n == k][:, None] + np.arange(k)
            i, j = np.triu_indices(k, 1)
            a, b = of[:, i].ravel(), of[:, j].ravel()
            fit = bound.sizes(size[a], size[b])
            out.append((False, ids[a[fit]], ids[b[fit]]))
        for g in np.flatnonzero(n > MANY).tolist():
            out.append((True, np.full(n[g] - 1, ids[start[g]]), ids[start[g] + 1 : start[g] + n[g]]))
        many = np.concatenate([np.full(len(a), kind) for kind, a, _ in out])
        a, b = np.concatenate([a for _, a, _ in out]), np.concatenate([b for _, _, b in out])
        order = np.lexsort((b, a, many))
        many, a, b = many[order], a[order], b[order]
        new = np.flatnonzero(np.concatenate([[True], (many[1:] != many[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else []
        return pa.table({"many": pa.array(many[new]), "a": pa.array(a[new]), "b": pa.array(b[new])})

    return met


def family_links(families: DataFrame, bound: Bound, block_bytes: int = BLOCK_BYTES, block_sets: int = BLOCK_SETS) -> DataFrame:
    """a, b: links that connect what is alike within each family (``root``, ``id``, ``members``); no task holds more than two blocks and the pivots.

    ``part``, if it is there: sets of the same part are connected already.
    """
    if "part" not in families.columns:
        families = families.withColumn("part", F.col("id"))

    def gathered(table: pa.Table) -> pa.Table:
        return given_back(searched(table))

    def searched(table: pa.Table) -> pa.Table:
        ids, first = np.unique(table.column("id").to_numpy(), return_index=True)
        members = table.column("members").take(pa.array(first)).to_pylist()
        part = table.column("part").to_numpy()[first]
        pairs = np.array(set_forest([np.frombuffer(x, "<u8") for x in members], bound, part), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ids[pairs[:, 0]]), "b": pa.array(ids[pairs[:, 1]])})

    kind = "a bigint, b bigint"
    size = families.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.length("members")).alias("bytes"))
    size = cut(size.withColumn("blocks", F.greatest(F.ceil(F.col("n") / block_sets), F.ceil(F.col("bytes") / block_bytes)).cast("int")))
    large = size.where("blocks > 1").select(F.col("root").alias("r"), "n", "blocks")
    if large.isEmpty():
        return families.groupBy("root").applyInArrow(gathered, kind)
    small = families.join(large, F.col("root") == F.col("r"), "left_anti").groupBy("root").applyInArrow(gathered, kind)
    dealt = cut(families.join(large, F.col("root") == F.col("r")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    pivot = F.pmod(F.xxhash64("id", F.lit(7)), F.greatest(F.lit(1), F.floor(F.col("n") / PIVOTS))) == 0
    everywhere = dealt.where(pivot).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["root", "block", "id", "members", "part"]
    first = cut(dealt.select(columns).unionByName(everywhere.select(columns)).groupBy("root", "block").applyInArrow(gathered, kind))
    parts = components(first).select("node", F.col("root").alias("part"))
    apart = dealt.select("root", "id").join(parts, F.col("id") == F.col("node"), "left").groupBy("root")
    apart = apart.agg(F.min(F.coalesce("part", "id")).alias("x"), F.max(F.coalesce("part", "id")).alias("y")).where("x <> y").select(F.col("root").alias("open"))
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("block")))
    crossed = dealt.join(apart, F.col("root") == F.col("open"), "left_semi").select("*", other.alias("other"))
    crossed = crossed.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "members", "part")
    return small.unionByName(first).unionByName(crossed.groupBy("root", "i", "j").applyInArrow(gathered, kind))


def simhash_pairs(prints: DataFrame, radius: int) -> DataFrame:
    """a < b: pairs of sets (``id``) to be checked, by the links of their fingerprints (``fp``) within ``radius``; a fingerprint stands for its least id, which is paired with its others."""
    marks = cut(prints.select("fp", "id").distinct())
    named = cut(marks.groupBy("fp").agg(F.min("id").alias("least")))
    ends = cut(simhash.links(named.select("fp"), radius))
    pairs = ends
    for end in ("a", "b"):
        pairs = join_parts(pairs, named.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_id")), end, heavy(ends, end))
    shared = join_parts(marks, named, "fp", heavy(marks, "fp"))
    pairs = pairs.select("a_id", "b_id").unionByName(shared.select(F.col("least").alias("a_id"), F.col("id").alias("b_id")))
    return pairs.where("a_id <> b_id").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()


def similar_components(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, text_col: str = "text", id_col: str = "doc_id", radius: int = 4) -> DataFrame:
    """doc_id, component_id of each row: texts are linked whose sets of shingles have that Jaccard similarity or more.

    ``radius``: within which fingerprints are looked up first; it decides how much is left to the exact search, not what is found.
    """
    with small_batches(docs.sparkSession):  # all that reads texts or sets runs here; what is returned has no Python left
        return _components(docs, shingle, Bound(similarity), text_col, id_col, radius)


def _components(docs: DataFrame, shingle: int, bound: Bound, text_col: str, id_col: str, radius: int) -> DataFrame:
    """What ``similar_components`` returns."""

    def named(batches):
        for b in slices(batches, 200):
            texts = b.column("text").to_pylist()
            ids = [class_of(shingle_set(t, shingle)) for t in texts]
            fp = np.array([simhash.fingerprint(t) for t in texts], U).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.int64()), pa.array(fp)], ["doc_id", "id", "fp"])

    def confirmed(batches):
        for b in slices(batches):
            good = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                good.append(bool(bound.alike(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)))))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(good, pa.bool_())), b.column("b").filter(pa.array(good, pa.bool_()))], ["a", "b"])

    def alike(pairs):
        """Those of pairs a, b whose sets are alike. A set that has no members in ``sets`` is like no other."""
        sides = pairs
        for end, name in (("a", "x"), ("b", "y")):
            sides = join_parts(sides, sets.select(F.col("id").alias(end), F.col("members").alias(name)), end, heavy(pairs, end))
        return sides.select("a", "b", "x", "y").mapInArrow(lean(confirmed), "a bigint, b bigint")

    prints = stored(id_and_text(docs, text_col, id_col).mapInArrow(lean(named), "doc_id bigint, id bigint, fp bigint"), "classes")
    classes = cut(prints.groupBy("id").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    total = prints.count()
    hot = {r.id: r.first for r in classes.where(F.col("n") * 1000 > total).where("n > 1").select("id", "first").collect()}  # under a thousand
    made = cut(candidates(docs, shingle, bound, hot, text_col, id_col))
    swept(docs.sparkSession)  # texts and codes went through shuffles, most of what this stage writes
    sets = made.where("id is not null").groupBy("id").agg(F.any_value("a").alias("members"))
    near = cut(alike(cut(simhash_pairs(prints, radius))))
    parts = components(near).select("node", F.col("root").alias("part"))
    found = cut(made.where("id is null").groupBy("shard").applyInArrow(meetings(bound), "many boolean, a bigint, b bigint").distinct())
    groups = components(found.where("many").select("a", "b"))
    known = cut(groups.join(parts, "node", "full"))
    pairs = found.where("not many").select("a", "b")
    for end in ("a", "b"):  # pairs that SimHash has connected are done, pairs within a family are found with it
        pairs = pairs.join(known.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"), F.col("part").alias(f"{end}_part")), end, "left")
    apart = lambda c: F.coalesce(F.col(f"a_{c}") != F.col(f"b_{c}"), F.lit(True))
    pairs = cut(pairs.where(apart("root") & apart("part")).select("a", "b"))
    families = known.where("root is not null").join(sets, F.col("node") == F.col("id"))
    families = cut(families.select("root", "id", "members", F.coalesce("part", "id").alias("part")))
    roots = components(near.unionByName(alike(pairs)).unionByName(family_links(families, bound)))
    told = cut(classes.join(roots, F.col("id") == F.col("node"), "left").select("id", "n", F.coalesce("root", "id").alias("root"), "first"))
    least = told.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("classes"))
    told = cut(join_back(told, least, "root", "classes").select("id", "n", "component_id"))
    return join_back(prints, told, "id", "n").select("doc_id", "component_id")


def keep_one(docs: DataFrame, similarity: float = 0.8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Of each group of similar texts the document of the least doc_id (with all rows of that id); other columns pass through."""
    stays = similar_components(docs, similarity=similarity, text_col=text_col, id_col=id_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = stays.select("doc_id").distinct()
    return docs.join(stays, docs[id_col].cast("bigint").eqNullSafe(stays["doc_id"]), "left_semi")
