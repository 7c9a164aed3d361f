"""Exact dedup by two-pass Bloom filtering.

Pass 1 hashes every normalised text and counts the hashes in a two-level Bloom filter ("seen once",
"seen again"). Tasks send only touched slots, packed; a slot's counts meet in its segment's reducer,
which is a sum that saturates at two, so neither a hot hash nor the number of tasks matters. Pass 2
tests each row against "seen again": rows that miss it are unique for certain and pass straight
through; only possible repeats shuffle and are settled by their SHA-256.

Defined results. Null text: empty. All empty or all-blank texts are one group. A null doc_id sorts
after every other. Fully equal rows (same doc_id and text) still form a group of which one row stays.
An empty table gives an empty result. Other columns pass through untouched; columns that carry this
module's output names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, mix, ship, shuffle_partitions

#: Slots of the filter per row, and the most slots: "seen again" is one bit a slot, so 2**31 slots are a
#: 256 MB broadcast at most. Beyond it more rows take the shuffle; results stay the same.
SLOTS_PER_ROW, MOST_SLOTS, SEGMENT = 16, 1 << 31, 1 << 20
OUT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text):
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def _slots(h: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(h.astype(np.uint64))
    low = np.uint64(slots - 1)
    return (h & low).astype(np.int64), ((h >> np.uint64(32)) & low).astype(np.int64)


def seen_again(hashes: DataFrame, slots: int) -> np.ndarray:
    """Bits of the slots that two or more rows of ``hashes`` (one bigint column) fall on, packed little-endian."""

    def touched(batches):
        once, again = [], []
        for b in batches:
            a, c = _slots(b.column(0).to_numpy(zero_copy_only=False), slots)
            for p in (a, np.where(c == a, -1, c)):
                u, n = np.unique(p[p >= 0], return_counts=True)
                once.append(u)
                again.append(u[n > 1])
        if not once:
            return
        u, n = np.unique(np.concatenate(once), return_counts=True)
        twice = np.isin(u, np.concatenate([u[n > 1], *again]))
        code = (u % SEGMENT) * 2 + twice
        seg = u // SEGMENT
        at = np.flatnonzero(np.diff(seg, prepend=-1))
        parts = np.split(code.astype("<u4"), at[1:])
        yield pa.RecordBatch.from_arrays([pa.array(seg[at]), pa.array([p.tobytes() for p in parts], pa.binary())], ["segment", "slots"])

    def summed(batches):
        have: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for s, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                bits = have.setdefault(s, [np.zeros(min(SEGMENT, slots), bool), np.zeros(min(SEGMENT, slots), bool)])
                code = np.frombuffer(blob, "<u4")
                p = code >> 1
                bits[1][p] |= bits[0][p] | (code & 1).astype(bool)
                bits[0][p] = True
        for s, (_, again) in have.items():
            if again.any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([np.packbits(again, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])

    spark = hashes.sparkSession
    segments = max(1, slots // SEGMENT)
    parts = min(segments, shuffle_partitions(spark))
    rows = hashes.mapInArrow(touched, "segment bigint, slots binary").repartition(parts, "segment").mapInArrow(summed, "segment bigint, bits binary")
    out = np.zeros(max(1, slots // 8), np.uint8)
    width = min(SEGMENT, slots) // 8
    for s, bits in rows.collect():  # at most slots / 8 bytes
        out[s * width : (s + 1) * width] = np.frombuffer(bits, np.uint8)
    return out


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", slots: int | None = None) -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256; see the module for the rules."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop(*[c for c in docs.columns if c in OUT])
    if slots is None:
        slots = 1 << max(16, min(MOST_SLOTS, SLOTS_PER_ROW * docs.select(id_col).count()).bit_length())
        slots = min(slots, MOST_SLOTS)
    bits = spark.sparkContext.broadcast(seen_again(docs.select(F.xxhash64(normalised(docs[text_col])).alias("h")), slots))

    @F.pandas_udf("boolean")
    def maybe(h):
        import pandas as pd

        a, c = _slots(h.to_numpy(), slots)
        b = bits.value
        test = lambda p: (b[p >> 3] >> (p & 7).astype(np.uint8)) & 1
        return pd.Series((test(a) & test(c)).astype(bool))

    names = docs.columns
    rows = docs.select(
        F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("row"),
        docs[id_col].alias("id"),
        F.sha2(normalised(docs[text_col]), 256).alias("sha"),
        F.length(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("n"),
        maybe(F.xxhash64(normalised(docs[text_col]))).alias("maybe"),
    )
    lone = rows.where(~F.col("maybe")).select("row", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha")
    some = cut(rows.where("maybe").withColumn("uid", F.monotonically_increasing_id()))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), "id", "uid")).alias("best")
    groups = some.groupBy("sha").agg(best, F.count("*").alias("group_size"))
    # The groups are a table of their own, so that the join below is of two plain exchanges and a hot group can be split.
    groups = cut(groups.select(F.col("sha").alias("g"), "best", "group_size"))
    told = some.join(groups, F.col("sha") == F.col("g")).select("row", F.col("best.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "sha")
    both = lone.unionByName(told)
    return both.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the rows that stay, with the columns of ``docs``."""
    return exact_dedup(docs).where("kept").select(*docs.columns)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
