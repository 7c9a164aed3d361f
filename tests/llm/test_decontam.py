"""Greedy string tiling against a plain version, and the planted leaks."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from framewright.llm import decontam

from . import cases


def plain_coverage(test, text, least):
    """Greedy tiling by its definition: always the longest unmarked common run."""
    a, b, covered = [True] * len(test), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(test)):
            for j in range(len(text)):
                k = 0
                while i + k < len(test) and j + k < len(text) and a[i + k] and b[j + k] and test[i + k] == text[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return covered
        a[i : i + k], b[j : j + k] = [False] * k, [False] * k
        covered += k


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=25), st.lists(st.integers(0, 4), max_size=40), st.integers(1, 5))
def test_tiles(test, text, least):
    found = decontam.tiles(np.array(test, np.int64), np.array(text, np.int64), least)
    a, b = [0] * len(test), [0] * len(text)
    for i, j, k in found:
        assert k >= least and test[i : i + k] == text[j : j + k]
        for x in range(k):
            a[i + x] += 1
            b[j + x] += 1
    assert max([0, *a, *b]) <= 1
    # Ties may be broken otherwise, but nothing that is long enough may be left unmarked.
    left_a, left_b = [x if not n else -1 for x, n in zip(test, a)], [x if not n else -2 for x, n in zip(text, b)]
    assert plain_coverage(left_a, left_b, least) == 0


def test_long_runs_first():
    test, text = list(range(1, 31)), [*range(16, 31), 99, *range(1, 16)]
    assert sorted(k for _, _, k in decontam.tiles(np.array(test), np.array(text), 5)) == [15, 15]


def bench(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_awkward_rows(spark):
    words = cases.passage(50, 40).split()
    moved = " ".join([*words[20:], "between", *words[:20]])
    part = " ".join(words[:20])
    docs = [(1, f"{cases.passage(8)} {' '.join(words).upper()}! {cases.passage(9)}", "a", "b", 1), (2, moved, None, "b", 1), (3, part, "a", None, 1), (4, None, "a", "b", 1), (5, "", "a", "b", 1), (5, "", "a", "b", 1), (None, " ".join(words), "a", "b", 1), (6, f"see tiny item now {cases.passage(10, 5000)}", "a", "b", 1)]
    items = [(7, " ".join(words)), (8, None), (9, ""), (10, "tiny item"), (None, " ".join(words)), (7, " ".join(words))]
    df = cases.table(spark, docs).withColumnRenamed("lang", "coverage").withColumnRenamed("source", "__x")
    for block_bytes in (1 << 20, 100):
        out = decontam.decontaminate(df, bench(spark, items), block_bytes=block_bytes)
        assert out.columns == ["doc_id", "text", "__x", "n_chars", "leaked", "coverage", "contaminated"]
        hit = {r.doc_id: sorted(r.leaked, key=str) for r in out.collect() if r.contaminated}
        assert hit == {1: [7, 7, None], 2: [7, 7, None], None: [7, 7, None], 6: [10]}
        # Half an item can't reach the threshold, so it is no candidate.
        assert {r.doc_id: r.coverage for r in out.where("doc_id in (2, 3)").collect()} == {2: 1.0, 3: 0.0}


def test_many_blocks_and_clashing_names(spark):
    """Ten blocks, one of them an item larger than a block; columns of the names that are used inside come through."""
    items = [(k, cases.passage(60 + k, 30)) for k in range(12)] + [(99, cases.passage(99, 600))] + [(5, cases.passage(65, 30))] * 3
    docs = [(k, f"{cases.passage(200 + k, 20)} {t} tail") for k, (_, t) in enumerate(items[:13])] + [(50, cases.passage(500, 60)), (51, None)]
    names = ["__leaks0", "__told", "__TEXT", "__found"]
    df = spark.createDataFrame([(d, t, *[f"{c}{d}" for c in names]) for d, t in docs], "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in names))
    rows = bench(spark, items).select(F.col("item_id").alias("id"), "text").groupBy("id", "text").count()
    size = {(i, t): len(t) for i, t in items}
    plan = decontam.plan_blocks(rows, 400)
    parts = [rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect() for n, k in plan]
    assert len(plan) > 5 and sorted((r.id, r.text) for p in parts for r in p) == sorted(set(items))
    assert all(len(p) == 1 or sum(size[r.id, r.text] for r in p) <= 800 for p in parts)
    told = [decontam.decontaminate(df, bench(spark, items), block_bytes=b) for b in (400, 1 << 20)]
    for out in told:
        assert out.columns == ["doc_id", "text", *names, "leaked", "coverage", "contaminated"]
        rows = {r.doc_id: r for r in out.collect()}
        assert {d: sorted(r.leaked) for d, r in rows.items() if r.contaminated} == {k: [5] * 4 if k == 5 else [i] for k, (i, _) in enumerate(items[:13])}
        assert all(r[c] == f"{c}{d}" for d, r in rows.items() for c in names)


def test_empty(spark):
    some = bench(spark, [(1, cases.passage(1))])
    assert decontam.decontaminate(cases.empty(spark), some).collect() == []
    assert decontam.decontaminate(cases.table(spark), bench(spark, [])).where("contaminated").count() == 0


def test_query_against_plain_tiling(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    token = lambda t: decontam.TOKEN.findall(t.lower())
    seeds: dict = {}
    for i, t in items:
        w = token(t)
        for k in range(len(w) - 4):
            seeds.setdefault(tuple(w[k : k + 5]), set()).add(i)
    texts = {i: token(t) for i, t in items}
    expected = []
    for d, t in docs:
        w = token(t)
        near = {i for k in range(len(w) - 4) for i in seeds.get(tuple(w[k : k + 5]), ())}
        hit = []
        for i in near:
            grams = {tuple(texts[i][k : k + 5]) for k in range(len(texts[i]) - 4)}
            at = [any(tuple(w[p : p + 5]) in grams for p in range(max(0, k - 4), k + 1)) for k in range(len(w))]
            if plain_coverage(texts[i], [x if a else None for x, a in zip(w, at)], 5) >= 0.8 * len(texts[i]):
                hit.append(i)
        expected.append((d, bool(hit), sorted(hit)))
    assert cases.got(decontam.op7_decontamination(spark, sf), "doc_id", "contaminated", "item_ids") == cases.want(expected)
    assert any(e[1] for e in expected)
