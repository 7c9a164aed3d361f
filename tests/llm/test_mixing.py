"""Temperature mixing: native plan, targets met, SQL and brute force."""

import hashlib
import math
import re

import duckdb
import pytest

from framewright.llm import mixing

from . import cases


def brute(rows, max_repeats=4.0, entropy=None, budget=None, seed=42):
    docs = [(i, "null" if s is None else "=" + s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    n: dict = {}
    for _, s, k in docs:
        n[s] = n.get(s, 0) + k
    n = {s: k for s, k in n.items() if k}
    total = sum(n.values())
    budget = budget or total
    p = {s: k / total for s, k in n.items()}

    def weights(a):
        z = sum(x**a for x in p.values())
        return {s: x**a / z for s, x in p.items()}

    def enough(a):
        w = weights(a)
        return -sum(x * math.log(x) for x in w.values()) >= entropy if entropy is not None else max(w[s] * budget / n[s] for s in w) <= max_repeats

    lo, hi = 0.0, 1.0
    if entropy is not None and (enough(1.0) or not enough(0.0)):
        alpha = 1.0 if enough(1.0) else 0.0
    elif entropy is None and (enough(0.0) or not enough(1.0)):
        alpha = 0.0 if enough(0.0) else 1.0
    else:
        for _ in range(60):
            mid = (lo + hi) / 2
            if enough(mid) == (entropy is not None):
                lo = mid
            else:
                hi = mid
        alpha = math.floor(lo * 1e6) / 1e6 if entropy is not None else math.ceil(hi * 1e6) / 1e6
    out = []
    for s, w in weights(alpha).items():
        whole, rest = divmod(math.floor(w * budget), n[s])
        for b in range(whole + 1):
            dealt = sorted((hashlib.md5(f"{seed}|{b}|{'null' if i is None else i}".encode()).hexdigest(), k, i) for i, s2, k in docs if s2 == s)
            run = 0
            for place, k, i in dealt:
                run += k
                if b < whole or (rest > 0 and run <= rest):
                    out.append((i, k, b, place))
    return out, alpha


def data(hot=0):
    rows = [r[:2] + (r[3],) for r in cases.rows() if r[0] is not None]
    return rows + [(1000 + k, cases.passage(k, 20 + k % 9), "hot") for k in range(hot)] + [(5000, "tiny source", "tiny")]


@pytest.mark.parametrize("options", [{}, {"max_repeats": 1.5}, {"entropy": 1.0}, {"entropy": 99.0}, {"entropy": 0.0}, {"budget": 500}, {"budget": 60000, "max_repeats": 2.0}, {"seed": 7, "max_repeats": 8.0}])
def test_against_brute_force(spark, options):
    rows = data(120)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    expected, _ = brute(rows, **options)
    assert cases.got(mixing.mix_sources(df, **options), "doc_id", "n_tokens", "block", "place") == cases.want(expected)


def test_clashing_names_nulls_and_repeats(spark):
    df = cases.table(spark).withColumnRenamed("lang", "block").withColumnRenamed("n_chars", "s")
    out = mixing.mix_sources(df)
    assert out.columns == ["doc_id", "text", "source", "s", "n_tokens", "block", "place"]
    expected, _ = brute([(r[0], r[1], r[3]) for r in cases.rows()])
    assert cases.got(out, "doc_id", "n_tokens", "block", "place") == cases.want(expected)


def test_empty(spark):
    assert mixing.mix_sources(cases.empty(spark)).collect() == []
    assert mixing.mix_sources(cases.table(spark, [(1, None, "a", "b", 0), (2, " ", "a", None, 0)])).collect() == []


def test_native(spark, sf):
    plan = mixing.op3_mixing(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = ["doc_id", "source", "n_tokens", "block", "place"]
    assert cases.got(mixing.op3_mixing(spark, sf), *names) == cases.want(con.sql(f"SELECT {', '.join(names)} FROM ({mixing.ORACLE})").fetchall())


def test_sql_with_a_hot_source(spark, tmp_path):
    rows = data(300)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "source", "n_tokens", "block", "place"]
    got = cases.got(mixing.op3_mixing(spark, str(tmp_path)), *names)
    assert got == cases.want(con.sql(f"SELECT {', '.join(names)} FROM ({mixing.ORACLE})").fetchall())
    assert 0 < brute(rows)[1] < 1
