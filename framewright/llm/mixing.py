"""Mixing sources to target weights by temperature, with DataFrame and SQL functions only.

A source's weight is its token share to the power alpha, normalised: alpha 1 keeps the shares, alpha 0 makes all
sources equal. Alpha is bisected to six decimals in [0, 1]: with ``entropy`` (nats) it is the largest alpha whose weights
have at least that entropy; otherwise the smallest alpha at which no source is repeated more than ``max_repeats``
times. Each step asks 63 places between the bounds in one aggregation over the table of sources, so the
table never comes to the driver. Where the target can't be met, alpha is the end of the range nearest to it.

The weights are realised within a token budget as block permutations: a source's budget is so many whole
blocks, each all its documents in an order of their own, and a last block that is the longest beginning of a
permutation that fits what is left of the budget. A document's place is the MD5 of seed, block and id. The
cut of the last block is found without gathering a source anywhere: tokens are summed by 4096 slots of the
order, and only the one slot in which the budget ends is ordered row by row.

Defined results. Null or blank text: 0 tokens; such documents are in every whole block, and in the last one up to its cut. A
null source is a source of its own. Sources without tokens get no budget and no block. Repeated rows
count and are dealt each. Ties of place go by tokens. Empty table: empty result. Columns named like the results are
replaced; all others pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, stored

SLOTS, GRID, DIGITS = 4096, 64, 6
OUT = ("n_tokens", "block", "place")


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")


def place(block: Column, doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), block.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def slot(place: Column) -> Column:
    return F.conv(F.substring(place, 1, 3), 16, 10).cast("int")


def solve(sources: DataFrame, total: int, budget: int, max_repeats: float, entropy: float | None) -> float:
    """The exponent; ``sources`` has n, the tokens of each source, above 0."""
    lo, hi = 0.0, 1.0
    p = F.col("n") / F.lit(float(total))

    def met(alphas: list[float]) -> dict[float, bool]:
        at = sources.select(p.alias("p"), F.explode(F.array(*map(F.lit, alphas))).alias("a"))
        rows = at.groupBy("a").agg(
            F.sum(F.pow("p", F.col("a"))).alias("z"), F.sum(F.pow("p", F.col("a")) * F.log("p")).alias("t"), F.max(F.pow("p", F.col("a") - 1)).alias("m")
        )
        if entropy is not None:
            return {r.a: math.log(r.z) - r.a * r.t / r.z >= entropy for r in rows.collect()}
        return {r.a: r.m / r.z * budget / total <= max_repeats for r in rows.collect()}

    ends = met([lo, hi])
    if entropy is not None:
        if ends[1.0] or not ends[0.0]:
            return 1.0 if ends[1.0] else 0.0
    elif ends[0.0] or not ends[1.0]:
        return 0.0 if ends[0.0] else 1.0
    # Below the sought alpha the entropy suffices, above it the repeats do.
    while hi - lo > 10.0 ** -(DIGITS + 3):
        grid = [lo + (hi - lo) * k / GRID for k in range(1, GRID)]
        ok = met(grid)
        low = [a for a in grid if ok[a] == (entropy is not None)]
        high = [a for a in grid if ok[a] != (entropy is not None)]
        lo, hi = max(low, default=lo), min(high, default=hi)
    step = 10**DIGITS
    return math.floor(lo * step) / step if entropy is not None else math.ceil(hi * step) / step


def mix_sources(
    docs: DataFrame, max_repeats: float = 4.0, entropy: float | None = None, budget: int | None = None, seed: int = 42, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """A row for each document and block it is in: the columns of ``docs``, n_tokens, block (from 0) and place.

    Reading by block and place gives the mixture's order. ``budget``: tokens in all; by default as many as there are.
    """
    docs = docs.drop(*OUT)
    names = docs.columns
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    base = docs.select(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("row"), docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), tokens(docs[text_col]).alias("n"))
    base = base.withColumn("source", key)
    small = cut(base.select("id", "source", "n"))
    sources = stored(small.groupBy("source").agg(F.sum("n").alias("n")).where("n > 0"), "sources")
    total = sources.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        alpha = z = 1.0
    else:
        alpha = solve(sources, total, budget or total, max_repeats, entropy)
        z = sources.agg(F.sum(F.pow(F.col("n") / F.lit(float(total)), F.lit(alpha)))).first()[0]
    want = F.floor(F.pow(F.col("n") / F.lit(float(total or 1)), F.lit(alpha)) / F.lit(z) * F.lit(float(budget or total))).cast("bigint")
    plan = sources.withColumn("want", want)
    plan = plan.select(F.col("source").alias("s"), F.expr("want div n").alias("whole"), F.expr("want % n").alias("rest"))
    # Where a source's last block ends: the slot, and the tokens before it.
    last = small.join(plan, F.col("source") == F.col("s")).where("rest > 0")
    sums = last.groupBy("s", "rest", slot(place(F.col("whole"), F.col("id"), seed)).alias("slot")).agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = sums.withColumn("before", before).where("before + n > rest").groupBy("s").agg(F.min("slot").alias("edge"), F.min("before").alias("before"))
    plan = stored(plan.join(edge.withColumnRenamed("s", "e"), F.col("s") == F.col("e"), "left").select("s", "whole", "rest", F.coalesce("edge", F.lit(SLOTS)).alias("edge"), F.coalesce("before", F.lit(0)).alias("before")), "mix")

    dealt = base.join(plan, F.col("source") == F.col("s"))
    upto = F.when((F.col("rest") > 0) & (slot(place(F.col("whole"), F.col("id"), seed)) <= F.col("edge")), F.col("whole")).otherwise(F.col("whole") - 1)
    dealt = dealt.withColumn("upto", upto).where("upto >= 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("upto"))))
    dealt = dealt.withColumn("place", place(F.col("block"), F.col("id"), seed))
    at_edge = (F.col("block") == F.col("whole")) & (slot(F.col("place")) == F.col("edge"))
    out = [*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], F.col("n").alias("n_tokens"), "block", "place"]
    order = Window.partitionBy("s").orderBy("place", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.where(~at_edge).select(*out)
    ending = dealt.where(at_edge).withColumn("run", F.col("before") + F.sum("n").over(order)).where("run <= rest").select(*out)
    return inside.unionByName(ending)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", "n_tokens", "block", "place")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents
), src AS (
  SELECT s, sum(n)::BIGINT AS n FROM d GROUP BY s HAVING sum(n) > 0
), tot AS (
  SELECT sum(n)::DOUBLE AS total, list(n::DOUBLE) AS ns FROM src
), p AS (
  SELECT total, list_transform(ns, lambda x: x / total) AS ps FROM tot
), bis AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
          list_max(list_transform(ps, lambda x: pow(x, (lo + hi) / 2 - 1))) / list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2))) <= 4.0 AS ok
        FROM bis, p WHERE i < 40)
), alpha AS (
  SELECT CASE WHEN len(ps) * 1.0 > 0 AND list_max(list_transform(ps, lambda x: 1.0 / x)) / len(ps) <= 4.0 THEN 0.0
              ELSE ceil((SELECT hi FROM bis WHERE i = 40) * 1e6) / 1e6 END AS a FROM p
), w AS (
  SELECT s, n, floor(pow(n / total, a) / list_sum(list_transform(ps, lambda x: pow(x, a))) * total)::BIGINT AS want FROM src, p, alpha
), plan AS (
  SELECT s, want // n AS whole, want % n AS rest FROM w
), b AS (
  SELECT doc_id, source, d.s, n, whole, rest, unnest(range(0, whole + 1)) AS block FROM d JOIN plan USING (s)
), placed AS (
  SELECT *, md5('42|' || block || '|' || coalesce(doc_id::VARCHAR, 'null')) AS place FROM b
), run AS (
  SELECT *, sum(n) OVER (PARTITION BY s, block ORDER BY place, n ROWS UNBOUNDED PRECEDING) AS run FROM placed
)
SELECT doc_id, source, n AS n_tokens, block, place FROM run WHERE block < whole OR (rest > 0 AND run <= rest)
"""
