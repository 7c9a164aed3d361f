"""The same functions in SQL: ``register(spark)`` adds frame_header, frame_xxh3, frame_xxh128, frame_split and, for named schemas, encoders, decoders and dumps."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions import algorithms as A
from framewright.functions import dump as D
from framewright.functions import envelope as E
from framewright.functions import rows as R
from framewright.functions.errors import FrameError
from framewright.functions.options import Options
from framewright.functions.schema import Context, compile_schema, plain
from framewright.functions.ship import ship
from framewright.sources.frames import register as register_source

from .frames import PARTS, _arrow, checksum_udf, header_udf, key_udf, sealable


def register(spark: SparkSession, context: Context | None = None, options: Options | None = None) -> None:
    """Scalar functions frame_header, frame_xxh3, frame_xxh128 and, of each schema S of the context, encode_S and decode_S; table functions
    frame_split(bytes) and dump_S(frame), for LATERAL joins; and the ``frames`` source.

    With keys there is frame_opened(frame) too: what AES-256-GCM made of a frame's stored bytes, the second argument of dump_S.
    That cipher is the JVM's, so encode_S and decode_S are then SQL functions around it.
    """
    ship(spark)
    register_source(spark)
    o = options or Options()
    spark.udf.register("frame_header", header_udf())
    for name in ("xxh3", "xxh128"):
        spark.udf.register(f"frame_{name}", checksum_udf(name))

    class Split:
        def eval(self, data):
            if data is not None:
                yield from E.split(bytes(data), o)

    spark.udtf.register("frame_split", F.udtf(Split, returnType="ordinal int, offset bigint, frame binary"))
    if o.keys is not None:
        spark.udf.register("frame_key", key_udf(o))
        head, stored = "substring(frame, 1, h.header_length)", "substring(frame, h.header_length + 1, h.on_disk_length)"
        ours = f"h.encryption = 'Aes256Gcm' AND octet_length({stored}) >= {A.NONCE + A.TAG} AND octet_length(k) = 32"
        heads = "STRUCT<encryption: STRING, key_id: STRING, header_length: INT, on_disk_length: INT>"
        _function(spark, "frame_opened_by", f"frame BINARY, h {heads}, k BINARY", "BINARY", f"CASE WHEN {ours} THEN try_aes_decrypt({stored}, k, 'GCM', 'DEFAULT', {head}) END")
        _function(spark, "frame_opened_at", f"frame BINARY, h {heads}", "BINARY", "frame_opened_by(frame, h, frame_key(h.key_id))")
        _function(spark, "frame_headed", f"h {_sql(spark, header_udf().returnType)}", heads, "named_struct('encryption', h.encryption, 'key_id', h.key_id, 'header_length', h.header_length, 'on_disk_length', h.on_disk_length)")
        _function(spark, "frame_opened", "frame BINARY", "BINARY", "frame_opened_at(frame, frame_headed(frame_header(frame)))")
        _function(spark, "frame_finish", f"p {_sql(spark, PARTS)}", "BINARY", "concat(p.head, aes_encrypt(p.stored, p.key, 'GCM', 'DEFAULT', CAST('' AS BINARY), p.head))")
    for name, (kind, meta) in (context.schemas if context else {}).items():
        codec, value = compile_schema(kind, meta), _sql(spark, plain(kind))
        read = F.arrow_udf(_decoder(codec, _arrow(plain(kind)), o), plain(kind))
        if o.encryption == "aes256gcm" and o.version == 1:
            spark.udf.register(f"frame_parts_{name}", F.arrow_udf(_parts(codec, o), PARTS))
            _function(spark, f"encode_{name}", f"v {value}", "BINARY", f"frame_finish(frame_parts_{name}(v))")
        else:
            spark.udf.register(f"encode_{name}", F.arrow_udf(_encoder(codec, o), T.BinaryType()))
        if o.keys is None:
            spark.udf.register(f"decode_{name}", read)
        else:
            spark.udf.register(f"frame_read_{name}", read)
            _function(spark, f"decode_{name}", "frame BINARY", value, f"frame_read_{name}(frame, frame_opened(frame))")
        spark.udtf.register(f"dump_{name}", F.udtf(_dumper(codec, o), returnType=D.NODE.replace(" long", " bigint")))


def _function(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS `{name}`")
    spark.sql(f"CREATE TEMPORARY FUNCTION `{name}`({parameters}) RETURNS {returns} RETURN {body}")


def _sql(spark: SparkSession, kind: T.DataType) -> str:
    """A type as SQL writes it, names quoted."""
    return spark._jvm.org.apache.spark.sql.types.DataType.fromJson(kind.json()).sql()


def _encoder(codec, o: Options):
    import pyarrow as pa

    def run(a):
        references = o.references and o.version == 1
        payloads = R.encode_column(codec, a, o.limits, references)
        return payloads if o.version == 0 else pa.array(E.seal_all(payloads.to_pylist(), o, references), pa.binary())

    return run


def _parts(codec, o: Options):
    return lambda a: sealable(R.encode_column(codec, a, o.limits, o.references).to_pylist(), o, o.references)


def _decoder(codec, arrow, o: Options):
    def run(a, plains=None):
        plains = [None] * len(a) if plains is None else plains.to_pylist()
        frames = a.to_pylist()
        undone = [(None, False) if b is None else E.undo(b, o, p, opened=x) for b, p, x in zip(frames, plains, E.open_all(frames, o))]
        d = R.Decoded(codec, [p for p, _ in undone], arrow, o.limits, [r for _, r in undone])
        for e in d.errors:
            if isinstance(e, FrameError):
                raise e
        return d.values

    return run if o.keys is not None else lambda a: run(a)


def _dumper(codec, o: Options):
    class Dump:
        def eval(self, frame, opened=None):
            if frame is not None:
                for r in D.rows(E.dump(bytes(frame), codec, o, opened and bytes(opened)).root):
                    yield tuple(r.values())

    return Dump
