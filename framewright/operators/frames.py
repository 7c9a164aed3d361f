"""Frames as columns: encode, decode, split, peek, populate, dump and compare.

Each function takes columns and gives a column, so that filters, projections and joins around it stay Spark's.
Python sees only the columns that a frame is made of, in Arrow batches, and one hop does all phases but AES-GCM,
which is the JVM's own. Flat schemas without floats need no Python at all (``native``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from framewright.functions import algorithms as A
from framewright.functions import dump as D
from framewright.functions import envelope as E
from framewright.functions import header as H
from framewright.functions import rows as R
from framewright.functions import wire
from framewright.functions.errors import CLASSES, FrameError, IntegrityError
from framewright.functions.options import Options
from framewright.functions.schema import Context, compile_schema, plain
from framewright.functions.ship import ship

DEFAULT = Options()
ERROR = "error_class string, error string"
PARTS = T.StructType([T.StructField(c, T.BinaryType()) for c in ("head", "stored", "key")])


def _kind(schema: T.DataType | str, context: Context | None, meta: dict | None) -> tuple[T.DataType, dict]:
    if isinstance(schema, str) and context is not None and schema in context.schemas:
        return context.find(schema)
    return (T._parse_datatype_string(schema) if isinstance(schema, str) else schema), meta or {}


def _arrow(kind: T.DataType):
    return to_arrow_type(kind)


def encode(value: Column, schema: T.DataType | str, meta: dict | None = None, options: Options = DEFAULT, context: Context | None = None, nullable: bool = True, nonce: Column | None = None) -> Column:
    """A frame (version 0: the payload) of each value.

    ``nonce``: 12 bytes a row, for tests and for frames that must repeat; without it each is random.
    """
    kind, meta = _kind(schema, context, meta)
    codec, o = compile_schema(kind, meta, nullable), options
    references = o.references and o.version == 1

    @F.arrow_udf(T.BinaryType())
    def payload(a):
        return R.encode_column(codec, a, o.limits, references)

    if o.version == 0:
        return payload(value)
    if o.encryption != "aes256gcm":

        @F.arrow_udf(T.BinaryType())
        def frame(a):
            import pyarrow as pa

            p = R.encode_column(codec, a, o.limits, references)
            if o.checksum == o.compression == o.encryption == "none":
                return _plain_frames(p, o, references)
            return pa.array(E.seal_all(p.to_pylist(), o, references), pa.binary())

        return frame(value)

    @F.arrow_udf(PARTS)
    def parts(a):
        return sealable(R.encode_column(codec, a, o.limits, references).to_pylist(), o, references)

    o.keys.get(o.key_id, 32)  # refused here rather than in a task
    return finish(parts(value), nonce)


def sealable(payloads: list[bytes], o: Options, references: bool):
    """Header, stored bytes and key of frames whose cipher is the JVM's. The key is a value of a row, so no plan or log shows it."""
    import pyarrow as pa

    out = [E.parts(x, o, references) for x in payloads]
    key = o.keys.get(o.key_id, 32) if out else b""
    columns = ([h for h, _ in out], [s for _, s in out], [key] * len(out))
    return pa.StructArray.from_arrays([pa.array(c, pa.binary()) for c in columns], PARTS.names)


def finish(parts: Column, nonce: Column | None = None) -> Column:
    """The frames of such parts, by AES-256-GCM with the header as associated data."""
    iv = nonce if nonce is not None else F.lit("").cast("binary")
    return F.concat(parts["head"], F.aes_encrypt(parts["stored"], parts["key"], F.lit("GCM"), F.lit("DEFAULT"), iv, parts["head"]))


def _plain_frames(payloads, o: Options, references: bool):
    """Frames without services, made in one piece."""
    import numpy as np
    import pyarrow as pa

    from framewright.functions import batch

    p = batch._binary(payloads)
    head = np.frombuffer(H.MAGIC + bytes([1, 1 if references else 0, 0]), np.uint8)
    out = batch.join([batch.fixed(np.tile(head, (len(p.size), 1))), batch.varints(p.size), p])
    off = np.append(out.start, len(out.data)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(p.size), [None, pa.py_buffer(off), pa.py_buffer(out.data)]).cast(pa.binary())


def encode_native(columns: dict[str, Column], schema: T.StructType, options: Options = DEFAULT, class_type: bool = True) -> Column:
    """The same frame by expressions alone, for schemas that ``wire.supports``; CRC-32 is the JVM's."""
    payload = wire.payload(columns, schema, class_type)
    if options.version == 0:
        return payload
    if options.compression != "none" or options.encryption != "none" or options.checksum not in ("none", "crc32"):
        raise FrameError("expressions write no such phase")
    if options.checksum == "none":
        return wire.frame(payload)
    record = F.concat(F.unhex(F.lit("030501")), wire.little(F.crc32(payload), 4))
    return F.concat(F.unhex(F.lit("42534552010001")), record, wire.varint(F.octet_length(payload)), payload)


def header(frame: Column) -> Column:
    """The header of a frame without its payload: null for other bytes; ``error_class`` where it is malformed."""
    return header_udf()(F.substring(frame, 1, H.LONGEST))


def header_udf():
    """The function of ``header``, over the first bytes of frames or whole ones."""
    kind = T._parse_datatype_string(f"struct<{_ddl(H.INFO)}, {_ddl(ERROR)}>")
    arrow = _arrow(kind)

    @F.arrow_udf(kind)
    def peek(a):
        import pyarrow as pa

        # Frames of one writer have few headers: each is read once, and rows refer to it.
        infos, known, at = [], {}, []
        for b in a.to_pylist():
            if b is None or not H.recognized(b[:16]):
                at.append(None)
                continue
            k = known.get(b[:16])
            if k is not None and b.startswith(k[0]):
                at.append(k[1])
                continue
            try:
                h = H.read(b[: H.LONGEST])
                info = h.info() | {"error_class": None, "error": None}
                known[b[:16]] = b[: h.length], len(infos)
            except FrameError as e:
                info = {"error_class": e.error_class, "error": str(e)}
            at.append(len(infos))
            infos.append(info)
        return pa.array(infos, arrow).take(pa.array(at, pa.int32()))

    return peek


def _ddl(fields: str) -> str:
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in fields.split(","))


def opened(frame: Column, options: Options = DEFAULT, key: Column | None = None) -> Column | None:
    """What AES-GCM makes of each frame's stored bytes, in the JVM; null where it doesn't authenticate. None without keys."""
    if options.keys is None and key is None:
        return None
    h = header(frame)
    if key is None:
        key = _key(h, options)
    head = F.substring(frame, F.lit(1), h["header_length"])
    stored = F.substring(frame, h["header_length"] + 1, h["on_disk_length"])
    found = F.try_aes_decrypt(stored, key, F.lit("GCM"), F.lit("DEFAULT"), head)
    return F.when((h["encryption"] == "Aes256Gcm") & (F.octet_length(stored) >= A.NONCE + A.TAG) & (F.octet_length(key) == 32), found)


def _key(h: Column, o: Options) -> Column:
    """The key of each header's id, as a value of its row: never a literal, which plans and event logs would show."""
    return key_udf(o)(h["key_id"])


def key_udf(o: Options):
    keys = o.keys

    @F.arrow_udf(T.BinaryType())
    def find(ids):
        import pyarrow as pa

        known: dict = {}
        out = []
        for i in ids.to_pylist():
            if i not in known:
                try:
                    known[i] = keys.get(i)
                except FrameError:
                    known[i] = None
            out.append(known[i])
        return pa.array(out, pa.binary())

    return find


def decode(
    frame: Column, schema: T.DataType | str, meta: dict | None = None, options: Options = DEFAULT, mode: str = "FAILFAST", context: Context | None = None, nullable: bool = True, key: Column | None = None
) -> Column:
    """The value of each frame.

    FAILFAST: the value; a malformed frame fails the query. PERMISSIVE: a struct of value, found (of a keyed root: the fields that
    were there), error_class and error. ``key``: the key of each frame, for instance from a joined table of keys.
    """
    kind, meta = _kind(schema, context, meta)
    codec, o = compile_schema(kind, meta, nullable), options
    strict = mode.upper() == "FAILFAST"
    kind = plain(kind)
    arrow = _arrow(kind)
    told = T.StructType([T.StructField("value", kind), T.StructField("found", T.ArrayType(T.StringType())), T.StructField("error_class", T.StringType()), T.StructField("error", T.StringType())])
    by_key = key is not None
    protected = o.require_encryption or o.require_checksum

    def run(frames, plains):
        import pyarrow as pa

        from framewright.functions import batch

        if not protected and len(frames):
            bare, ok = batch.bare_frames(frames, o.limits)
            if ok.all():
                return result(R.Decoded(codec, bare, arrow, o.limits, want_found=not strict), [None] * len(frames))
        payloads, references, errors, frames = [], [], [], frames.to_pylist()
        known = o if not by_key else _with_any_key(o)
        for i, (b, there) in enumerate(zip(frames, E.open_all(frames, known))):
            error = None
            payload, refs = None, False
            if b is not None:
                try:
                    payload, refs = E.undo(b, known, plains[i].as_py() if plains is not None else None, opened=there)
                except FrameError as e:
                    error = e
            payloads.append(payload), references.append(refs), errors.append(error)
        return result(R.Decoded(codec, payloads, arrow, o.limits, references, want_found=not strict), errors)

    def result(d, errors):
        import pyarrow as pa

        errors = [a or b for a, b in zip(errors, d.errors)]
        if strict:
            bad = next((e for e in errors if e), None)
            if bad is not None:
                raise bad
            return d.values
        text = lambda f: pa.array([e and f(e) for e in errors], pa.string())
        return pa.StructArray.from_arrays([d.values, pa.array(d.found, pa.list_(pa.string())), text(lambda e: e.error_class), text(str)], names=["value", "found", "error_class", "error"])

    sealed = opened(frame, o, key)
    if sealed is None:

        @F.arrow_udf(kind if strict else told)
        def read(frames):
            return run(frames, None)

        return read(frame)

    @F.arrow_udf(kind if strict else told)
    def read_opened(frames, plains):
        return run(frames, plains)

    return read_opened(frame, sealed)


def _with_any_key(o: Options) -> Options:
    """Options whose keys are a column: whatever it holds has been tried."""
    from dataclasses import replace

    from framewright.functions.keys import Keys

    return replace(o, keys=Keys(resolve=lambda _: bytes(32)))


def split(data: Column, options: Options = DEFAULT, schema: T.DataType | str | None = None, meta: dict | None = None) -> Column:
    """Frames laid end to end as an array of (ordinal, offset, frame); use ``inline`` to make rows of it."""
    codec = compile_schema(*_kind(schema, None, meta)) if schema is not None else None
    kind = T._parse_datatype_string("array<struct<ordinal: int, offset: bigint, frame: binary>>")
    arrow = _arrow(kind)

    @F.arrow_udf(kind)
    def parts(a):
        import pyarrow as pa

        return pa.array([None if b is None else [dict(zip(("ordinal", "offset", "frame"), x)) for x in E.split(b, options, codec)] for b in a.to_pylist()], arrow)

    return parts(data)


def concat_chunks(df: DataFrame, by: list[str], order: str, chunk: str, name: str = "data") -> DataFrame:
    """Segments of one buffer, in order, as one column. A buffer is bounded by max_wire_bytes, so a group is too."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, chunk))), lambda x: F.hex(x[chunk]))
    return df.groupBy(*by).agg(F.unhex(F.array_join(parts, "")).alias(name))


def populate(target: dict[str, Column], decoded: Column, schema: T.StructType) -> list[Column]:
    """A target's columns overlaid by a decoded keyed value: fields that weren't in the frame keep what they had.

    ``decoded``: of ``decode`` in PERMISSIVE mode. A failed frame leaves the target as it was.
    """
    out = []
    for f in schema.fields:
        here = F.array_contains(decoded["found"], f.name) if f.metadata and "key" in f.metadata else decoded["value"].isNotNull()
        out.append(F.when(F.coalesce(here, F.lit(False)), decoded["value"][f.name]).otherwise(target[f.name]).alias(f.name))
    return out


def dump(frame: Column, schema: T.DataType | str | None = None, meta: dict | None = None, options: Options = DEFAULT, form: str = "nodes", nullable: bool = True) -> Column:
    """What is in a frame, for people. ``form``: nodes (an array of rows), text, json, xml or hex. Never fails for a bad frame."""
    codec = compile_schema(*_kind(schema, None, meta), nullable) if schema is not None else None
    kind = T._parse_datatype_string(f"array<struct<{_ddl(D.NODE)}>>") if form == "nodes" else T.StringType()
    arrow = _arrow(kind)

    def run(frames, plains):
        import pyarrow as pa

        frames = frames.to_pylist()
        found = (None if b is None else E.dump(b, codec, options, plains[i].as_py() if plains is not None else None, x) for i, (b, x) in enumerate(zip(frames, E.open_all(frames, options))))
        if form != "nodes":
            return pa.array((None if d is None else getattr(d, form)() for d in found), arrow)
        # Columns rather than objects a node: Arrow takes them far faster.
        out, ends, gone = [], [0], []
        for d in found:
            out += () if d is None else D.records(d.root)
            ends.append(len(out))
            gone.append(d is None)
        inner = arrow.value_type
        columns = list(zip(*out)) or [()] * inner.num_fields
        parts = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, inner)], fields=list(inner))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts, mask=pa.array(gone))

    sealed = opened(frame, options)
    if sealed is None:

        @F.arrow_udf(kind)
        def read(frames):
            return run(frames, None)

        return read(frame)

    @F.arrow_udf(kind)
    def read_opened(frames, plains):
        return run(frames, plains)

    return read_opened(frame, sealed)


def failure(frame: Column, schema: T.DataType | str, meta: dict | None = None, options: Options = DEFAULT, nullable: bool = True) -> Column:
    """Where and why a frame doesn't read: error_class, error, failure_offset, failure_path; nulls for a good one."""
    codec = compile_schema(*_kind(schema, None, meta), nullable)
    kind = T._parse_datatype_string("struct<error_class: string, error: string, failure_offset: bigint, failure_path: string>")
    arrow = _arrow(kind)

    @F.arrow_udf(kind)
    def read(frames):
        import pyarrow as pa

        out = []
        for b in frames.to_pylist():
            d = E.dump(b or b"", codec, options)
            out.append({"error_class": d.failure and d.failure.error_class, "error": d.failure and str(d.failure), "failure_offset": d.failure_offset, "failure_path": d.failure_path})
        return pa.array(out, arrow)

    return read(frame)


def header_text(frame: Column) -> Column:
    """The header's report, a line a fact."""
    return dump(F.substring(frame, 1, H.LONGEST), form="text")


def compare(expected: Column, actual: Column, schema: T.DataType | str, meta: dict | None = None, options: Options = DEFAULT, nullable: bool = True) -> Column:
    """The first node at which two frames differ, or null: path, both sides and their offsets."""
    codec = compile_schema(*_kind(schema, None, meta), nullable)
    kind = T._parse_datatype_string("struct<path: string, expected: string, actual: string, expected_offset: bigint, actual_offset: bigint>")
    arrow = _arrow(kind)

    @F.arrow_udf(kind)
    def run(left, right):
        import pyarrow as pa

        return pa.array([D.compare(E.dump(a or b"", codec, options), E.dump(b or b"", codec, options)) for a, b in zip(left.to_pylist(), right.to_pylist())], arrow)

    return run(expected, actual)


def checksum(data: Column, algorithm: str = "crc32") -> Column:
    """A checksum in the byte order that frames carry: CRC-32 in the JVM, XXH3 in Arrow batches."""
    if algorithm == "crc32":
        return wire.little(F.crc32(data), 4)
    return checksum_udf(algorithm)(data)


def checksum_udf(algorithm: str):
    ident = A.CHECKSUM[algorithm]

    @F.arrow_udf(T.BinaryType())
    def run(a):
        import pyarrow as pa

        return pa.array([None if b is None else A.checksum(ident, b) for b in a.to_pylist()], pa.binary())

    return run


def checksum_ok(frame: Column, options: Options = DEFAULT) -> Column:
    """Whether a frame's recorded checksum matches its payload; null without one or where the phases can't be undone."""

    @F.arrow_udf(T.BooleanType())
    def run(a):
        import pyarrow as pa

        frames = a.to_pylist()
        return pa.array([None if b is None else E.dump(b, None, options, opened=x).checksum_verified for b, x in zip(frames, E.open_all(frames, options))], pa.bool_())

    return run(frame)


def error_of(class_name: str) -> type[FrameError]:
    """The exception class of an ``error_class``."""
    return CLASSES[class_name]


def require(column: Column, ok: Column, error: type[FrameError] = IntegrityError) -> Column:
    """A column that fails the query where ``ok`` isn't true."""
    return F.when(ok, column).otherwise(F.raise_error(F.lit(error.error_class)))


def prepare(df: DataFrame) -> DataFrame:
    """Make sure that the executors have this package."""
    ship(df.sparkSession)
    return df
