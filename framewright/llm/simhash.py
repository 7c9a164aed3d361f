"""SimHash near-dedup over vantage-point trees.

Fingerprints: 64 majority bits of the XXH64 (seed 42) of word shingles. In the whole 64-bit space a
vantage-point tree hardly prunes, since unlike texts all lie near distance 32; so the tree indexes
projections. The bits are split into ``radius // 2 + 1`` blocks; of two fingerprints within ``radius``
at least one block differs by at most one bit. Each block has a vantage-point tree: a node's vantage and
median distance part the block's Hamming space, the triangle bound lets a value cross only if its
distance touches the boundary, and a leaf is a shard. Values that touch a boundary are sent to the
shard beyond it too, so every linked pair meets in a shard, where full distances decide. The trees are
fitted on a bounded sample (``sample``); every fingerprint is indexed. A shard sends only the links of a
spanning forest (never all pairs), found by searches that compare against what is still unreached, so a
shard that is one big group of near copies costs little. Components of those links come from ``graph``: by one
task if they are few, else by alternating large-star and small-star rounds, cut by checkpoints.

Links are of fingerprints within a radius; ``similar_sets`` checks them by the similarity of the texts' sets of shingles.

Defined results. Null and blank texts: fingerprint zero, linked like any other. Fewer words than a
shingle: the whole sequence is one shingle. Equal fingerprints are one class. Repeated rows: a result row
each. component_id is the least doc_id of the component; null ids are ignored unless there is no other.
Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, join_back, slices
from .graph import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
LEAF = 1000


def fingerprint(text: str, shingle: int = 4) -> int:
    """The fingerprint of one whole text, unsigned: a bit of the majority of its shingles' XXH64."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :][:n] - 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    starts, last = starts[:n].tolist(), last.tolist()
    for at in range(0, n, 65536):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + 65536], last[at : at + 65536])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a bigint) of each row."""

    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return id_and_text(docs, text_col, id_col).mapInArrow(run, "doc_id bigint, fp bigint")


class VPTree:
    """A vantage-point tree of ``depth`` levels over one block of bits; its leaves are shards."""

    def __init__(self, sample: np.ndarray, mask: int, depth: int, seed: int):
        self.mask, self.depth = np.uint64(mask), depth
        self.vantage = np.zeros(1 << depth, np.uint64)
        self.median = np.zeros(1 << depth, np.int64)
        rng = np.random.default_rng(seed)
        groups = {1: np.unique(sample & self.mask)}
        for node in range(1, 1 << depth):
            x = groups.pop(node)
            pool = x if len(x) else sample & self.mask
            # Of a few candidates, the vantage whose boundary fewest values touch and that parts evenly.
            best = None
            for v in rng.choice(pool, 16) if len(pool) else np.zeros(1, np.uint64):
                d = np.bitwise_count(x ^ v).astype(np.int64)
                m = int(np.median(d)) if len(d) else 0
                for r in (m - 1, m):
                    inside = (d <= r).mean() if len(d) else 0.5
                    cost = (d == r).mean() + 2 * abs(inside - 0.5) if len(d) else 1.0
                    if best is None or cost < best[0]:
                        best = (cost, v, r, d)
            _, self.vantage[node], self.median[node], d = best
            groups[2 * node], groups[2 * node + 1] = x[d <= self.median[node]], x[d > self.median[node]]

    def shards(self, fp: np.ndarray, reach: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each shard that a fingerprint belongs to or must visit."""
        x = fp & self.mask
        row, node, home = np.arange(len(x)), np.ones(len(x), np.int64), np.ones(len(x), bool)
        for _ in range(self.depth):
            d = np.bitwise_count(x[row] ^ self.vantage[node]).astype(np.int64)
            r = self.median[node]
            inner = np.where(home, d <= r, d <= r + reach)
            outer = d > r - reach
            # A value at home outside need not visit the inside: its partner there visits the outside.
            row, node, home = (
                np.concatenate([row[inner], row[outer]]),
                np.concatenate([2 * node[inner], 2 * node[outer] + 1]),
                np.concatenate([home[inner], home[outer] & (d > r)[outer]]),
            )
        return row, node - (1 << self.depth)


def blocks(radius: int) -> list[int]:
    """Masks of ``radius // 2 + 1`` blocks: a pair within ``radius`` has a block within distance one."""
    n = radius // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def forest(fp: np.ndarray, radius: int, mask: int = 0) -> list[tuple[int, int]]:
    """Links (by place) of a spanning forest of the graph of all pairs within ``radius`` (with a mask: at least of those that differ by at most one bit in it)."""
    if mask and len(fp) > 4 * LEAF:
        return _forest_by_block(fp, radius, mask)
    links: list[tuple[int, int]] = []
    left = np.arange(len(fp))
    while len(left):
        head = left[:128]
        near = np.bitwise_count(fp[head][:, None] ^ fp[left][None, :]) <= radius
        linked = head[near.sum(axis=1) > 1]
        if not len(linked):
            left = left[128:]
            continue
        gone = np.zeros(len(fp), bool)
        for i in linked.tolist():
            if gone[i]:
                continue
            gone[i] = True
            # Search from this one through everything not yet reached.
            queue, open_ = [i], left[~gone[left]]
            while queue and len(open_):
                v = queue.pop()
                hit = np.bitwise_count(fp[open_] ^ fp[v]) <= radius
                reached = open_[hit].tolist()
                links += [(v, j) for j in reached]
                queue += reached
                gone[reached] = True
                open_ = open_[~hit]
        gone[head] = True
        left = left[~gone[left]]
    return links


def _forest_by_block(fp: np.ndarray, radius: int, mask: int) -> list[tuple[int, int]]:
    """The same for a large shard: values are sorted by their masked bits, and a value meets only equals there and those one bit off.

    The work is that of the meetings, not the square of the shard. A run of equal bits is searched as a forest of its own; two runs
    are compared only as far as their values aren't connected yet.
    """
    bits = [1 << b for b in range(64) if mask >> b & 1]
    order = np.argsort(fp & np.uint64(mask), kind="stable")
    key = (fp & np.uint64(mask))[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    runs, at = np.split(order, start[1:]), key[start]
    links: list[tuple[int, int]] = []
    group = list(range(len(fp)))

    def find(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    def add(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            group[max(a, b)] = min(a, b)
            links.append((i, j))

    for run in runs:
        for i, j in forest(fp[run], radius) if len(run) > 1 else ():
            add(int(run[i]), int(run[j]))
    for bit in bits:
        other = np.searchsorted(at, at ^ np.uint64(bit))
        for a in np.flatnonzero((at & np.uint64(bit)) == 0).tolist():
            b = int(other[a])
            if b < len(at) and at[b] == at[a] ^ np.uint64(bit):
                left, right = sorted((runs[a], runs[b]), key=len)
                for i in left.tolist():  # the links of one value to a run: one to each group in it
                    for j in right[np.bitwise_count(fp[right] ^ fp[i]) <= radius].tolist():
                        add(i, j)
    return links


def links(fps: DataFrame, radius: int = 4, sample: int = 65536) -> DataFrame:
    """a, b: links among the distinct fingerprints of ``fps`` (column fp) that connect all pairs within ``radius``."""
    n = fps.count()
    step = max(1, -(-n // sample))
    seen = np.array([r[0] for r in fps.where(F.pmod(F.xxhash64("fp"), F.lit(step)) == 0).collect()], np.int64).view(np.uint64)
    depth = min(16, max(0, int(np.ceil(np.log2(max(1, n / LEAF))))))
    trees = fps.sparkSession.sparkContext.broadcast([VPTree(seen, m, depth if len(seen) else 0, i) for i, m in enumerate(blocks(radius))])

    def dealt(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for i, tree in enumerate(trees.value):
                row, leaf = tree.shards(fp)
                yield pa.RecordBatch.from_arrays([pa.array((i << 32) + leaf), pa.array(fp[row].view(np.int64))], ["shard", "fp"])

    def linked(table: pa.Table) -> pa.Table:
        fp = np.unique(table.column("fp").to_numpy())
        mask = blocks(radius)[table.column("shard")[0].as_py() >> 32] if len(fp) else 0
        pairs = np.array(forest(fp.view(np.uint64), radius, mask), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(fp[pairs[:, 0]]), "b": pa.array(fp[pairs[:, 1]])})

    return fps.mapInArrow(dealt, "shard bigint, fp bigint").groupBy("shard").applyInArrow(linked, "a bigint, b bigint")


def simhash_components(docs: DataFrame, shingle: int = 4, radius: int = 4, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, fp, component_id of each row of ``docs``."""
    prints = cut(fingerprints(docs, shingle, text_col, id_col))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = components(links(classes.select("fp"), radius))
    told = classes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    told = cut(told.select("fp", "n", "root", "first"))
    least = told.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("classes"))
    told = cut(join_back(told, least, "root", "classes").select("fp", "n", "component_id"))
    return join_back(prints, told, "fp", "n").select("doc_id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
