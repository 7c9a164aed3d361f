"""Exact dedup and token counts."""

import hashlib
import os

import duckdb
import pytest

from framewright.llm import exact_dedup, token_counts

from . import cases


def brute(rows):
    norm = [(t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"}) for _, t in rows]
    groups: dict = {}
    for k, n in enumerate(norm):
        groups.setdefault(n, []).append(k)
    out = []
    for n, at in groups.items():
        best = min(at, key=lambda k: (-len(rows[k][1] or ""), rows[k][0] is None, rows[k][0] or 0, k))
        out += [(rows[k][0], rows[best][0], len(at), k == best, hashlib.sha256(n.encode()).hexdigest()) for k in at]
    return out


@pytest.mark.parametrize("slots", [None, 8, 1 << 16])
def test_exact_awkward_rows(spark, slots):
    rows = [r[:2] for r in cases.rows()]
    df = cases.table(spark).withColumnRenamed("lang", "n").withColumnRenamed("n_chars", "kept")
    out = exact_dedup.exact_dedup(df, slots=slots)
    assert out.columns == ["doc_id", "text", "n", "source", "keep_id", "group_size", "kept", "text_sha256"]
    assert cases.got(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == cases.want(brute(rows))


def test_exact_empty(spark):
    assert exact_dedup.exact_dedup(cases.empty(spark)).collect() == []


def test_exact_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert cases.got(exact_dedup.op5_exact_dedup(spark, sf), *names) == cases.want(con.sql(f"SELECT {', '.join(names)} FROM ({exact_dedup.ORACLE})").fetchall())


def test_filter_passes_no_repeat(spark):
    h = spark.range(5000).selectExpr("xxhash64(id % 3000) AS h")
    bits = exact_dedup.seen_again(h, 1 << 16)
    import numpy as np

    again = np.array([r.h for r in h.groupBy("h").count().where("count > 1").collect()])
    for p in exact_dedup._slots(again, 1 << 16):
        assert ((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_tokens(spark, name, tmp_path):
    rows = [r[:2] for r in cases.rows()] + [(90, "a <|endoftext|> b"), (91, "a <|endoftext|> b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    count = token_counts.encoder(name)
    expected = cases.want((i, len((t or "").encode()), count([t or ""])[0], count([t or ""])[0] > 20) for i, t in rows)
    path = str(tmp_path / "cache")
    out = token_counts.token_counts(df, name, limit=20, cache_path=path)
    assert cases.got(out, "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    files = set(os.listdir(path))
    before = spark.read.parquet(path).count()
    assert before == len({t or "" for _, t in rows})
    more = df.unionByName(spark.createDataFrame([(99, "new text")], df.schema))
    out = token_counts.token_counts(more, name, limit=20, cache_path=path)
    assert out.count() == len(rows) + 1 and files < set(os.listdir(path))
    assert spark.read.parquet(path).count() == before + 1


def test_tokens_empty(spark):
    assert token_counts.token_counts(cases.empty(spark)).collect() == []
    assert token_counts.encoder("byte_bpe_50k.json")([]) == []


def test_tokens_special_string_is_the_librarys(spark):
    assert token_counts.encoder("byte_bpe_50k.json")(["<|endoftext|>"]) == [1]
