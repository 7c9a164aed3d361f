"""The pipeline against a brute-force version of its stages."""

import corpus_pipeline
from framewright.llm import decontam, toxicity

from . import cases
from .test_exact_and_tokens import brute as exact
from .test_mixing import brute as mixed
from .test_similar_sets import brute_jaccard


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    rows = [r for r, s in zip(rows, model.score([r[1] for r in rows])) if s < 0.5]
    kept = {e[0] for e in exact([r[:2] for r in rows]) if e[3]}
    rows = [r for r in rows if r[0] in kept]
    kept = {d for d, c in brute_jaccard([r[:2] for r in rows]) if d == c}
    rows = [r for r in rows if r[0] in kept]
    index = decontam.Index([tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()])
    rows = [r for r in rows if not index.leaks(r[1])[0]]
    expected, _ = mixed(rows)
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "n_tokens", "block", "place"]
    assert cases.got(out, "doc_id", "n_tokens", "block", "place") == cases.want(expected)
    assert 0 < len(rows) < docs.count()


def test_stages_keep_the_columns_and_awkward_rows(spark, tmp_path):
    cases.table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i in (3, 9))) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, cases.passage(5))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = cases.table(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0
