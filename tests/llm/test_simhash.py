"""SimHash against brute force."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.llm import graph, simhash

from . import cases


def fingerprint(text, n):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, n=4, radius=4):
    prints = [fingerprint(t, n) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                group[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))]


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert cases.got(simhash.op8_simhash(spark, sf), "doc_id", "fingerprint", "component_id") == cases.want(brute(rows))


def test_awkward_rows(spark):
    rows = [r[:2] for r in cases.rows()]
    out = simhash.simhash_components(cases.table(spark))
    told = ((d, f"{f % 2**64:016x}", c) for d, f, c in map(tuple, out.select("doc_id", "fp", "component_id").collect()))
    assert cases.want(told) == cases.want(brute(rows))


def test_empty(spark):
    assert simhash.simhash_components(cases.empty(spark)).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 6), st.integers(0, 6))
def test_every_pair_meets_in_a_shard(seed, depth, radius):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    near = base.copy()
    for i in range(len(near)):
        for b in r.choice(64, r.integers(0, radius + 1), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    fp = np.unique(np.concatenate([base, near]))
    meet = set()
    for i, mask in enumerate(simhash.blocks(radius)):
        row, leaf = simhash.VPTree(fp, mask, depth, i).shards(fp)
        for k in np.unique(leaf):
            at = np.unique(row[leaf == k])
            meet |= {(a, b) for a in at for b in at}
    for a in range(len(fp)):
        for b in range(len(fp)):
            if int(fp[a] ^ fp[b]).bit_count() <= radius:
                assert (a, b) in meet


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 400))
def test_forest_connects_what_is_linked(seed, n):
    r = np.random.default_rng(seed)
    fp = np.unique(r.integers(0, 1 << 12, n, dtype=np.uint64))
    links = simhash.forest(fp, 1)
    assert len(links) < len(fp) or not links
    group = {int(x): int(x) for x in fp}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in links:
        a, b = int(fp[a]), int(fp[b])
        assert (a ^ b).bit_count() <= 1 and find(a) != find(b)
        group[find(a)] = find(b)
    for a in map(int, fp):
        for b in range(12):
            if a ^ 1 << b in group:
                assert find(a) == find(a ^ 1 << b)


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**32))
def test_a_large_shard_is_searched_by_block(seed):
    """Every pair that the block's bits bring together is connected, as the search of all pairs connects it."""
    r = np.random.default_rng(seed)
    radius = 4
    base = r.integers(0, 1 << 62, 60, dtype=np.uint64)
    fp = np.concatenate([base, *[base[r.integers(0, 60, 60)] ^ (np.uint64(1) << r.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 60, dtype=np.uint64)) for _ in range(4)]])
    fp = np.unique(fp)
    group = [{i} for i in range(len(fp))]

    def join(links):
        of = list(range(len(fp)))
        for a, b in links:
            assert int(fp[a] ^ fp[b]).bit_count() <= radius
            x, y = of[a], of[b]
            of = [x if k == y else k for k in of]
        return of

    found = []
    for mask in simhash.blocks(radius):
        found += simhash._forest_by_block(fp, radius, mask)
    a, b = join(found), join(simhash.forest(fp, radius))
    assert len(set(a)) == len(set(b)) == len(set(zip(a, b))) and group


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(5, i) for i in range(6, 40)] + [(100, 99), (99, 101)], [(3, 3), (2, 1), (1, 2)]])
def test_components(spark, edges):
    group = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            group[y] = x
    out = simhash.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert sorted(map(tuple, out.select("node", "root").collect())) == sorted((x, find(x)) for x in group)


def test_components_by_one_task_equal_alternating_stars(spark):
    """Chains, stars, cycles, repeated links and signed ids, over many partitions; both ways give the least node."""
    r = np.random.default_rng(4)
    chain, ids = r.permutation(300), r.choice(np.arange(-(2**40), 2**40, 2**28), 700, replace=False)
    edges = [*zip(chain, chain[1:]), *((300, 301 + k % 60) for k in range(120)), *((400 + k, 400 + (k + 1) % 50) for k in range(50)), *r.integers(500, 700, (120, 2)), (7, 7)]
    edges = [(int(ids[a]), int(ids[b])) for a, b in edges]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(9)
    of = {x: x for e in edges for x in e}
    for _ in of:
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
        if all(of[a] == of[b] for a, b in edges):
            break
    linked = {x for a, b in edges if a != b for x in (a, b)}
    want = sorted((x, of[x]) for x in linked)
    for few in (None, 0):
        assert sorted(map(tuple, graph.components(df, few).select("node", "root").collect())) == want


def test_few_links_cost_few_tasks(spark):
    """On 40 partitions, 300 links of a chain take no rounds over all of them."""
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    off = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", 40), spark.conf.set(off, False)
    try:
        df = spark.createDataFrame([(k, k + 1) for k in range(300)], "a bigint, b bigint").repartition(40)
        sc.setJobGroup("few links", "")
        assert graph.components(df).count() == 301
        told = sc.statusTracker()
        stages = {s for j in told.getJobIdsForGroup("few links") for s in told.getJobInfo(j).stageIds}
        assert sum(i.numTasks for s in stages if (i := told.getStageInfo(s))) < 300
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before), spark.conf.unset(off)
