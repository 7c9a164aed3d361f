"""What the operators of this subpackage share: shared storage, column guards, chunk counts."""

from __future__ import annotations

import ctypes
import gc
import time
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.ship import ship
from framewright.functions.storage import fresh, shared_dir

#: The characters of ``[\x20\x09-\x0D]``, which part words in every contract of this subpackage.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: What ``small_batches`` lets go to Python at once: the JVM's buffers and the worker hold a few times that each.
BATCH_BYTES = 4 << 20


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def swept(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing holds any more: it does so only once the driver has collected its garbage, Python's and then the JVM's; what the first pass lets go of, the second deletes."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES):
    """Rows go to Python in Arrow batches of at most so many bytes (or one row) in the jobs that run meanwhile; a smaller setting of the session holds."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    size = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before))
    spark.conf.set(name, str(min(size, most) if size > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Return to the system what this worker's allocators have free; a worker lives on, and its memory would count beside that of those at work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc
        trim(0)


def given_back(out):
    """``out``, once what its making took is given back."""
    give_back()
    return out


def lean(run):
    """``run`` over batches, whose worker gives its memory back at the end."""

    def go(batches):
        yield from run(batches)
        give_back()

    return go


def id_and_text(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Only the two columns that an operator reads, under fixed names; a null text is empty."""
    ship(docs.sparkSession)
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def unused(columns: list[str], name: str) -> str:
    """A column name that none of ``columns`` has, whatever their case."""
    taken = {c.lower() for c in columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def join_back(rows: DataFrame, told: DataFrame, key: str, hot: list | str) -> DataFrame:
    """``rows`` with what ``told`` says of their key: one row a key.

    ``hot``: the keys that over a thousandth of all rows have, of which there are under a thousand; or the column of ``told`` that counts the ``rows`` of
    each key. Such a key would fill one task, so its row of ``told`` is broadcast. All other keys meet in a plain join.
    """
    if isinstance(hot, str):
        total = told.agg(F.sum(hot)).first()[0] or 0
        count, hot = hot, [r[0] for r in told.where((F.col(hot) * 1000 > total) & (F.col(hot) > 1)).select(key).collect()]
        told = told.drop(count)
    if not hot:
        return rows.join(told, key)
    here = F.col(key).isin(hot)
    return rows.where(here).join(F.broadcast(told.where(here)), key).unionByName(rows.where(~here).join(told.where(~here), key))


def heavy(rows: DataFrame, key: str) -> list[tuple[int, int]]:
    """The keys that over a thousandth of all rows have, of which there are under a thousand, and in how many parts none of a key's is larger than that."""
    counts, total = rows.groupBy(key).agg(F.count("*").alias("n")), rows.count()
    parts = F.least(F.col("n"), F.ceil(F.col("n") * 1000 / F.lit(max(1, total)))).cast("int")
    return [tuple(r) for r in counts.where((F.col("n") * 1000 > total) & (F.col("n") > 1)).select(key, parts).collect()]


def join_parts(rows: DataFrame, told: DataFrame, key: str, parts: list[tuple[int, int]]) -> DataFrame:
    """``rows`` with what ``told`` says of their key: one row a key. Rows of the keys of ``parts`` (see ``heavy``) are dealt to so many copies of it; there are under two thousand copies."""
    if not parts:
        return rows.join(told, key)
    of = F.broadcast(rows.sparkSession.createDataFrame(parts, f"{key} bigint, parts int"))
    rows = rows.join(of, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    told = told.join(of, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")
    return rows.join(told, [key, "part"]).drop("part")


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan; for files their size on disk. Costs no job."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if 0 < size < 1 << 60 else 1 << 30


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def chunk_count(df: DataFrame, chunk_bytes: int = 8 << 20) -> int:
    """How many chunks keep each at about ``chunk_bytes`` of stored input; follows the data."""
    return max(shuffle_partitions(df.sparkSession), -(-input_bytes(df) // chunk_bytes))


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (n + 1), without copies where Arrow allows it."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def slices(batches, rows: int = 500):
    """Record batches in slices, so that few texts are Python strings at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
