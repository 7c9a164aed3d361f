"""The near-dedup stage against plain Jaccard similarity of shingle sets, pair by pair."""

import os
import time

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from framewright.llm import common, simhash, similar_sets

from . import cases


def shingles(text, n=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode("utf-8", "surrogatepass").split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def alike(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def brute_jaccard(rows):
    """Components of all pairs of rows with Jaccard 0.8 or more; every pair that shares a shingle is counted, and equal sets."""
    sets = [shingles(t) for _, t in rows]
    group, where, equal = list(range(len(rows))), {}, {}

    def find(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i, x in enumerate(sets):
        same = equal.setdefault(frozenset(x), i)
        if same != i:
            group[find(i)] = find(same)
            continue
        shared = {}
        for s in x:
            for j in where.get(s, ()):
                shared[j] = shared.get(j, 0) + 1
            where.setdefault(s, []).append(i)
        for j, n in shared.items():
            if 5 * n >= 4 * (len(x) + len(sets[j]) - n):
                group[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, least.get(find(i))) for i, (d, _) in enumerate(rows)]


def told(spark, rows):
    return cases.got(similar_sets.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)), "doc_id", "component_id")


def test_only_pairs_of_the_similarity_are_linked(spark):
    """Pairs of similarity 0.6 to 0.85: those under 0.8 stay apart."""
    rng, rows = np.random.default_rng(11), []
    for k in range(120):
        words = cases.passage(9000 + k, 300).split()
        rows.append((2 * k, " ".join(words)))
        for at in rng.choice(300, 5 + k % 12, replace=False):
            words[at] = "changed"
        rows.append((2 * k + 1, " ".join(words)))
    far = sum(not alike(shingles(a[1]), shingles(b[1])) for a, b in zip(rows[::2], rows[1::2]))
    assert 20 < far < 100
    assert told(spark, rows) == cases.want(brute_jaccard(rows))


def test_every_pair_at_the_bound_is_linked(spark):
    """400 pairs that share exactly 4 of 5 shingles: none is lost."""
    rows = []
    for k in range(400):
        words = cases.passage(20000 + k, 94 + k % 3 * 90).split()
        n = len(words) - 4
        # A tail of own words adds shingles and takes none away: n of n + n / 4 are shared.
        tail = cases.passage(40000 + k, n // 4).split()
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, *tail]))]
    near = sum(alike(shingles(a[1]), shingles(b[1])) for a, b in zip(rows[::2], rows[1::2]))
    assert near == 400
    out = dict(told(spark, rows))
    assert sum(out[2 * k + 1] == 2 * k for k in range(400)) == 400


def test_sample_tables_equal_plain_jaccard(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert told(spark, rows) == cases.want(brute_jaccard(rows))
    rows = [r[:2] for r in cases.rows()]
    assert told(spark, rows) == cases.want(brute_jaccard(rows))


def test_large_groups_equal_plain_jaccard(spark):
    """A group of near copies and a passage that many unlike texts share, both over MANY."""
    rng, rows, base, line = np.random.default_rng(3), [], cases.passage(77, 200).split(), cases.passage(78, 40)
    for k in range(90):
        words = list(base)
        for at in rng.choice(200, k % 5, replace=False):
            words[at] = f"own{k}"
        rows.append((k, " ".join(words)))
        rows.append((1000 + k, f"{line} {cases.passage(3000 + k, 15 + k % 9)}"))
    rows += [(2000 + k, " ".join(f"w{k + i}" for i in range(6))) for k in range(60)]
    assert told(spark, rows) == cases.want(brute_jaccard(rows))


def test_a_repeated_shingle_counts_once(spark):
    line = cases.passage(50, 16)
    own, other = cases.passage(51, 104), cases.passage(52, 104)
    rows = [(1, f"{own} {' '.join([line] * 20)}"), (2, f"{other} {' '.join([line] * 20)}"), (3, f"{own} {' '.join([line] * 2)}")]
    assert told(spark, rows) == [(1, 1), (2, 2), (3, 1)]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 400), st.sampled_from([0.5, 0.8, 0.9]))
def test_alike_sets_share_a_signature(seed, n, similarity):
    r, bound = np.random.default_rng(seed), similar_sets.Bound(similarity)
    x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
    keep = int(np.ceil(len(x) * similarity))
    y = x[: r.integers(keep, len(x) + 1)]
    y = np.unique(np.concatenate([y, r.integers(0, 2**63, r.integers(0, len(x) // 4 + 1), dtype=np.uint64)]))
    level = lambda h: (h % np.uint64(5)).astype(np.uint8)
    row, at = similar_sets.signatures([x, y], np.concatenate([level(x), level(y)]), bound)
    told = np.concatenate([x, y])[at]
    if bound.alike(len(x), len(y), len(np.intersect1d(x, y))):
        assert set(told[row == 0].tolist()) & set(told[row == 1].tolist())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcdefgh éß", max_size=60), max_size=4), st.integers(1, 6))
def test_shingles_are_told_apart(texts, n):
    """As many distinct hashes as distinct shingles, and the same hash for the same shingle."""
    name: dict = {}
    for t in texts:
        mine = shingles(t, n)
        got = similar_sets.shingle_set(t, n)
        assert len(got) == len(mine)
        for w in mine:
            (h,) = similar_sets.shingle_set(b" ".join(w).decode(), n)
            assert name.setdefault(h, w) == w and h in got


def test_long_words_count_whole():
    a, b = "x" * 40, "x" * 20 + "y" + "x" * 19
    assert similar_sets.shingle_set(a, 5)[0] != similar_sets.shingle_set(b, 5)[0]
    assert len({int(similar_sets.shingle_set("q" * k, 5)[0]) for k in range(1, 60)}) == 59


def test_families_in_blocks_equal_one_search(spark):
    """A chain and a star of near copies, cut into many blocks; the chain isn't connected by a few pivots."""
    bound = similar_sets.Bound(0.8)
    rng = np.random.default_rng(2)
    pool = np.sort(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    chain = [pool[8 * k : 8 * k + 100] for k in range(150)]
    star = [np.sort(np.concatenate([pool[2000:2100], pool[3000 + 9 * k : 3000 + 9 * k + k % 9]])) for k in range(100)]
    other = [pool[2500 + 100 * k % 400 : 2500 + 100 * k % 400 + 100] + np.uint64(k) for k in range(20)]
    sets = [*chain, *star, *other]
    df = spark.createDataFrame([(5, k, x.tobytes()) for k, x in enumerate(sets)] + [(6, 1000 + k, x.tobytes()) for k, x in enumerate(star)], "root bigint, id bigint, members binary")

    def parts(links, n):
        of = list(range(n))
        for a, b in links:
            x, y = of[a], of[b]
            of = [x if k == y else k for k in of]
        return {frozenset(k for k in range(n) if of[k] == g) for g in set(of)}

    want = parts(similar_sets.set_forest(sets, bound), len(sets))
    for blocks in (10_000, 40):
        links = [tuple(r) for r in similar_sets.family_links(df, bound, block_sets=blocks).collect()]
        assert all(bound.alike(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b]))) for a, b in links if a < 1000)
        assert parts([x for x in links if x[0] < 1000], len(sets)) == want
        assert len(parts([(a - 1000, b - 1000) for a, b in links if a >= 1000], len(star))) == 1


def test_stage_keeps_one_of_each(spark):
    stay = {d for d, c in brute_jaccard([r[:2] for r in cases.rows()]) if d == c}
    for name in ("bits", "__stays", "stays"):
        kept = similar_sets.keep_one(cases.table(spark).withColumnRenamed("n_chars", name))
        assert {r.doc_id for r in kept.collect()} == stay and kept.columns == ["doc_id", "text", "lang", "source", name]
    assert similar_sets.keep_one(cases.empty(spark)).collect() == [] == similar_sets.similar_components(cases.empty(spark)).collect()


def test_hot_copies(spark):
    """A third of all rows are one text, in two spellings."""
    rows = [(k, cases.passage(k, 30)) for k in range(100)] + [(200 + k, cases.passage(7, 30).upper() if k % 2 else cases.passage(7, 30)) for k in range(60)]
    assert told(spark, rows) == cases.want(brute_jaccard(rows))


def test_pipeline_drops_by_plain_jaccard(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, sf).collect()} == {d for d, c in brute_jaccard(rows) if d == c}


def test_simhash_links_what_it_brings_together(spark, monkeypatch):
    """Without the exact search for the rest, pairs within 4 bits of each other are still linked, and only if their sets are alike."""
    rng, rows = np.random.default_rng(5), []
    for k in range(120):
        words = cases.passage(60000 + k, 300).split()
        rows.append((2 * k, " ".join(words)))
        for at in rng.choice(300, 1 + k % 4, replace=False):
            words[at] = "changed"
        rows.append((2 * k + 1, " ".join(words)))
    for k in range(120, 124):  # one line so often that bits hardly tell the texts apart, though their sets do
        line = " ".join([cases.passage(61000 + k, 16)] * 200)
        rows += [(2 * k + i, f"{cases.passage(62000 + 2 * k + i, 60)} {line}") for i in (0, 1)]
    pairs = list(zip(rows[::2], rows[1::2]))
    close = [(simhash.fingerprint(a[1]) ^ simhash.fingerprint(b[1])).bit_count() <= 4 for a, b in pairs]
    good = [alike(shingles(a[1]), shingles(b[1])) for a, b in pairs]
    assert sum(c and g for c, g in zip(close, good)) > 20 and sum(g and not c for c, g in zip(close, good)) > 20 and sum(c and not g for c, g in zip(close, good)) > 0
    assert told(spark, rows) == cases.want(brute_jaccard(rows))

    def none(bound):
        import pyarrow as pa

        return lambda table: pa.table({"many": pa.array([], pa.bool_()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    monkeypatch.setattr(similar_sets, "meetings", none)
    expected = [(d, a[0] if c and g else d) for (a, b), c, g in zip(pairs, close, good) for d in (a[0], b[0])]
    assert told(spark, rows) == cases.want(expected)


def test_the_pipeline_searches_by_simhash(spark, sf, monkeypatch):
    seen, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, radius: seen.append((fps.count(), radius)) or links(fps, radius))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    corpus_pipeline.near(spark, docs, sf).count()
    assert seen == [(len({simhash.fingerprint(r.text or "") for r in docs.select("text").collect()}), 4)]


def test_parts_of_a_forest_are_not_compared():
    """Sets of a part are linked as they are; what else is alike is found as without parts."""
    bound, pool = similar_sets.Bound(0.8), np.arange(4000, dtype=np.uint64)
    sets = [pool[8 * k : 8 * k + 100] for k in range(30)] + [pool[2000 + 200 * k : 2100 + 200 * k] for k in range(6)]
    assert len(similar_sets.set_forest(sets, bound)) == 29
    part = np.arange(36)
    part[[3, 7, 20]] = 3
    assert len(similar_sets.set_forest(sets, bound, part)) == 29
    part[[30, 35]] = 30
    links = similar_sets.set_forest(sets, bound, part)
    assert len(links) == 30 and (30, 35) in links


def test_join_in_parts_equals_a_join(spark):
    rows = spark.createDataFrame([(k % 7 if k % 2 else 1, k) for k in range(300)], "a bigint, x bigint").repartition(3)
    told = spark.createDataFrame([(k, 10 * k) for k in range(9) if k != 3], "a bigint, y bigint")
    parts = common.heavy(rows, "a")
    assert parts and all(1 < n <= 300 for _, n in parts)
    assert cases.got(common.join_parts(rows, told, "a", parts), "a", "x", "y") == cases.got(rows.join(told, "a"), "a", "x", "y")
    assert common.heavy(rows.limit(0), "a") == []


def test_shuffled_texts_are_deleted_before_the_search(spark, sf, monkeypatch):
    """When links are looked for, the shuffle files of texts and codes go; else they'd stand beside all that the search writes."""
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f and f.endswith(".data")}
    before, left, pairs = files(), [], similar_sets.simhash_pairs

    def looked(prints, radius):
        for _ in range(50):
            left.append(sum(os.path.getsize(f) for f in files() - before if os.path.exists(f)))
            if left[-1] < 20_000:
                break
            time.sleep(0.1)
        return pairs(prints, radius)

    monkeypatch.setattr(similar_sets, "simhash_pairs", looked)
    corpus_pipeline.near(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).count()
    assert left[-1] < 20_000, left


def test_texts_reach_python_in_small_batches(spark, sf, monkeypatch):
    """All jobs of the stage run with the bound, which holds batches of long texts, and the session's setting is there again afterwards."""
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name)
    for f in (similar_sets.cut, similar_sets.stored):
        monkeypatch.setattr(similar_sets, f.__name__, lambda *a, f=f: (seen.append(spark.conf.get(name)), f(*a))[1])
    similar_sets.similar_components(spark.read.parquet(f"{sf}/documents.parquet").limit(50))
    assert len(seen) > 5 and set(seen) == {str(common.BATCH_BYTES)} and spark.conf.get(name) == before

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "rows"])

    texts = spark.range(0, 1000, 1, 1).selectExpr("repeat('a', 20000) t")
    with common.small_batches(spark):
        found = texts.mapInArrow(sizes, "bytes bigint, rows bigint").collect()
    assert sum(r.rows for r in found) == 1000 and max(r.bytes for r in found) < common.BATCH_BYTES + 100_000
    with common.small_batches(spark, 1000), common.small_batches(spark):
        assert spark.conf.get(name) == "1000"  # a smaller setting holds
    assert spark.conf.get(name) == before


def test_a_worker_gives_free_memory_back():
    held = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    parts = [np.ones(100_000, np.uint8) for _ in range(2000)]
    last = parts[-1]  # what lies below it isn't given back by itself
    del parts
    full = held()
    assert list(common.lean(iter)([1, 2])) == [1, 2]
    assert held() < full - 150_000_000 and last.sum() == 100_000
