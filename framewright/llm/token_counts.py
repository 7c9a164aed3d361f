"""Token counts behind a digest cache.

A text's key is the SHA-256 of its normalised content (null: empty; nothing else may change, or counts
would) together with a digest of the tokenizer (its file and the library's version). Keys are joined to
the stored counts; of the misses each distinct text is encoded once, and the new counts are appended
to the cache, a Parquet folder that later calls share. Appending a key twice is harmless: reads take one.

Defined results. Null text: as empty, 0 bytes and 0 tokens. Repeated rows: a result row each. Very long
texts: encoded whole. Empty table: empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, join_back, shared_dir, stored

CACHE = "tokenizer string, digest string, n_bytes bigint, n_tokens bigint"
_LOADED: dict[str, object] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_version(name: str) -> str:
    """A digest of the tokenizer's file and of the library that reads it."""
    with open(tokenizer_path(name), "rb") as f:
        file = hashlib.sha256(f.read()).hexdigest()
    if name.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    return hashlib.sha256(f"{library.__name__} {library.__version__} {file}".encode()).hexdigest()


def encoder(name: str):
    """texts -> token counts, by the library of the file; one per process."""
    if name not in _LOADED:
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
            _LOADED[name] = lambda texts: [len(model.encode(t)) for t in texts]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(tokenizer_path(name))
            model.no_truncation()
            model.no_padding()
            _LOADED[name] = lambda texts: [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
    return _LOADED[name]


def _encoded(name: str, version: str):
    def run(batches):
        count = encoder(name)
        for b in batches:
            digests, texts = b.column("digest").to_pylist(), b.column("text").to_pylist()
            at = 0
            while at < len(texts):  # a few hundred KB at a time: an encoding holds many bytes a token
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < 400_000):
                    size += len(texts[end])
                    end += 1
                part = texts[at:end]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([version] * len(part)), pa.array(digests[at:end]), pa.array([len(t.encode()) for t in part], pa.int64()), pa.array(count(part), pa.int64())],
                    ["tokenizer", "digest", "n_bytes", "n_tokens"],
                )
                at = end

    return run


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(CACHE).parquet(path)
    return spark.createDataFrame([], CACHE)


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, cache_path: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``.

    ``cache_path``: a Parquet folder to share between calls; by default a new one in the shared folder.
    """
    spark = docs.sparkSession
    path = cache_path or f"{shared_dir(spark)}/framewright/token-cache-{uuid.uuid4().hex}"
    version = tokenizer_version(tokenizer)
    keyed = id_and_text(docs, text_col, id_col).withColumn("digest", F.sha2("text", 256))
    prints = stored(keyed.select("doc_id", "digest"), "digests")
    total = prints.count()
    hot = [r.digest for r in prints.groupBy("digest").count().where((F.col("count") * 1000 > total) & (F.col("count") > 1)).collect()]  # under a thousand
    known = read_cache(spark, path).where(F.col("tokenizer") == version)
    misses = keyed.select("digest", "text").join(known.select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
    misses.mapInArrow(_encoded(tokenizer, version), CACHE).write.mode("append").parquet(path)
    counts = read_cache(spark, path).where(F.col("tokenizer") == version)
    counts = counts.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))
    return join_back(prints, counts, "digest", hot).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
