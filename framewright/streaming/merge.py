"""Populating tables from streams of frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.options import Options
from framewright.operators.frames import decode, populate


def merge_batch(target: DataFrame, frames: DataFrame, schema: T.StructType, key: str, order: str = "offset", options: Options | None = None) -> DataFrame:
    """``target`` overlaid by a batch of keyed frames (columns frame and ``order``); of one key's frames each field's last value wins.

    Rows of the target without a frame stay; keys without a row are added.
    """
    meta = {"layout": "keyed"}
    read = frames.select(decode(F.col("frame"), schema, meta, options or Options(), mode="PERMISSIVE").alias("d"), F.col(order).alias("__order")).where("d.value IS NOT NULL")
    fields = [f for f in schema.fields if f.name != key]
    last = [F.max_by(F.struct(F.col(f"d.value.{f.name}").alias("v")), F.when(F.array_contains("d.found", f.name), F.col("__order"))).alias(f"__{f.name}") for f in fields]
    here = [F.max(F.array_contains("d.found", f.name)).alias(f"__has_{f.name}") for f in fields]
    folded = read.groupBy(F.col(f"d.value.{key}").alias("__key")).agg(*last, *here)
    both = target.join(folded, target[key] == F.col("__key"), "full_outer")
    out = [F.coalesce(target[key], F.col("__key")).alias(key)]
    out += [F.when(F.coalesce(F.col(f"__has_{f.name}"), F.lit(False)), F.col(f"__{f.name}.v")).otherwise(target[f.name]).alias(f.name) for f in fields]
    return both.select(*out)


def populate_stream(stream: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], schema: T.StructType, key: str, checkpoint: str, order: str = "offset", options: Options | None = None):
    """A running query that merges each micro-batch of frames into a table: ``load`` reads it, ``save`` stores it (again, if a batch is retried)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        save(merge_batch(load(), batch, schema, key, order, options), batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def latest(frames: DataFrame, key: str, order: str) -> DataFrame:
    """The last frame of each key."""
    return frames.groupBy(key).agg(F.max_by(F.struct(*frames.columns), order).alias("row")).select("row.*")


__all__ = ["latest", "merge_batch", "populate", "populate_stream"]
