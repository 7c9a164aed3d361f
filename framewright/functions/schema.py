"""The schema compiler: a Spark type and its fields' metadata become a codec, once, on the driver.

Metadata of a field (or, for the root, the ``meta`` argument):

``wire``        a scalar's wire name (``u32``, ``f16``, ``guid`` ...), a sequence kind (``set``, ``stack`` ...), a map
                kind (``sorted_dictionary`` ...), or ``priority_queue``, ``grid``, ``pair``, ``tuple``, ``value_tuple``, ``lazy``
``enum``        the base width of an enum; ``names`` maps its values to names
``layout``      ``keyed`` for the evolvable layout of a struct; its fields carry ``key`` or ``ignore``
``key`` / ``order`` / ``ignore`` / ``include``   of a member; fields named with ``_`` take part only with ``include``
``union``       {field: tag} for a struct whose fields are the arms
``element`` / ``key_meta`` / ``value_meta``      metadata of an array's elements, a map's keys and values
``identity``    fields that make equal structs one object when references are preserved
``type``        the name shown in dumps

Nullability decides the bytes: a nullable number has a flag, a nullable struct is a class, a struct that is not
nullable is a value without a flag. Parquet marks every column nullable, so pass the schema that is meant.
"""

from __future__ import annotations

import json
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import types as T

from .codec import MAPS, SCALARS, SEQUENCES, Codec, Composite, Enum, Grid, Map, Member, Nullable, Object, Queue, Sequence, Union
from .errors import WireTypeError

DEFAULTS = {
    T.BooleanType: "bool", T.ByteType: "i8", T.ShortType: "i16", T.IntegerType: "i32", T.LongType: "i64", T.FloatType: "f32", T.DoubleType: "f64", T.DecimalType: "decimal", T.StringType: "string",
    T.DateType: "date", T.TimestampType: "instant", T.TimestampNTZType: "datetime", T.DayTimeIntervalType: "timespan", **({T.TimeType: "time"} if hasattr(T, "TimeType") else {}),
}
#: The Spark types a wire name may stand for; others are refused.
ALLOWED = {
    "bool": T.BooleanType, "string": T.StringType, "char": T.StringType, "rune": T.StringType, "guid": T.StringType, "uri": T.StringType, "version": T.StringType, "builder": T.StringType, "culture": T.StringType, "timezone": T.StringType,
    "date": T.DateType, "datetime": T.TimestampNTZType, "instant": T.TimestampType, "timespan": T.DayTimeIntervalType, "f16": T.FloatType, "f32": T.FloatType, "f64": T.DoubleType, "offset": T.StructType, "complex": T.StructType, "bits": T.ArrayType,
    **dict.fromkeys(("vector2", "vector3", "vector4", "quaternion", "plane", "matrix3x2", "matrix4x4"), T.ArrayType),
}


class Diagnostic(NamedTuple):
    code: str
    path: str
    message: str


def ordinal(name: str) -> bytes:
    """Ordinal order is by UTF-16 unit."""
    return name.encode("utf-16-be", "surrogatepass")


def diagnose(schema: T.StructType, meta: dict | None = None, path: str = "root") -> list[Diagnostic]:
    """All contradictions of a schema's metadata; an empty list compiles."""
    meta, out = meta or {}, []
    say = lambda code, field, message: out.append(Diagnostic(code, f"{path}.{field}" if field else path, message))
    if "union" in meta:
        tags = meta["union"]
        for name, tag in tags.items():
            if not 0 <= tag <= 255:
                say("UNION_TAG_RANGE", name, f"tag {tag} is outside 0-255")
            if name not in schema.names:
                say("UNION_ARM_UNKNOWN", name, "no such field")
            elif not isinstance(schema[name].dataType, T.StructType):
                say("UNION_ARM_TYPE", name, "an arm must be a struct")
        for tag in {t for t in tags.values() if list(tags.values()).count(t) > 1}:
            say("UNION_TAG_TWICE", "", f"tag {tag} is given twice")
        for f in schema.fields:
            if f.name not in tags:
                say("UNION_ARM_UNTAGGED", f.name, "the arm has no tag")
    else:
        keyed, keys, orders = meta.get("layout") == "keyed", [], []
        for f in schema.fields:
            m = f.metadata or {}
            if m.get("include") and m.get("ignore"):
                say("INCLUDE_AND_IGNORE", f.name, "included and ignored")
            if "key" in m and m.get("ignore"):
                say("KEY_AND_IGNORE", f.name, "keyed and ignored")
            if keyed:
                if m.get("include"):
                    say("INCLUDE_IN_CONTRACT", f.name, "include means nothing in the keyed layout")
                if "order" in m:
                    say("ORDER_IN_CONTRACT", f.name, "order means nothing in the keyed layout")
                if "key" not in m and not m.get("ignore"):
                    say("MEMBER_WITHOUT_KEY", f.name, "needs key or ignore")
                if m.get("key", 0) < 0:
                    say("KEY_NEGATIVE", f.name, f"key {m['key']} is negative")
                if "key" in m and not m.get("ignore"):
                    keys.append(m["key"])
            else:
                if "key" in m:
                    say("KEY_WITHOUT_CONTRACT", f.name, "key needs the keyed layout")
                if "order" in m and not m.get("ignore"):
                    orders.append(m["order"])
        for what, values in (("KEY_TWICE", keys), ("ORDER_TWICE", orders)):
            for v in sorted({v for v in values if values.count(v) > 1}):
                say(what, "", f"{v} is given twice")
    for f in schema.fields:
        if not (f.metadata or {}).get("ignore"):
            out += _nested(f.dataType, f.metadata or {}, f"{path}.{f.name}")
    return out


def _nested(kind: T.DataType, meta: dict, path: str) -> list[Diagnostic]:
    wire = meta.get("wire")
    if isinstance(kind, T.StructType) and wire == "grid":
        if sorted(kind.names) != ["data", "dims"] or not isinstance(kind["data"].dataType, T.ArrayType):
            return [Diagnostic("UNSUPPORTED_WIRE_TYPE", path, "a grid is a struct of dims and data")]
        return _nested(kind["data"].dataType, kind["data"].metadata or {}, f"{path}.data")
    if isinstance(kind, T.StructType) and wire not in SCALARS:
        return diagnose(kind, meta, path)
    if isinstance(kind, T.ArrayType) and wire not in SCALARS:
        return _nested(kind.elementType, meta.get("element", {}), f"{path}[]")
    if isinstance(kind, T.MapType):
        return _nested(kind.keyType, meta.get("key_meta", {}), f"{path}.key") + _nested(kind.valueType, meta.get("value_meta", {}), f"{path}.value")
    if isinstance(kind, T.BinaryType) and wire not in SCALARS:
        return [] if (wire or "array") in SEQUENCES else [Diagnostic("UNSUPPORTED_WIRE_TYPE", path, f"{wire} is no sequence kind")]
    if "enum" in meta:
        return [] if meta["enum"] in SCALARS else [Diagnostic("UNSUPPORTED_WIRE_TYPE", path, f"{meta['enum']} is no integer")]
    try:
        _scalar_name(kind, meta)
    except WireTypeError as e:
        return [Diagnostic("UNSUPPORTED_WIRE_TYPE", path, str(e))]
    return []


def _scalar_name(kind: T.DataType, meta: dict) -> str:
    wire = meta.get("wire") or next((w for t, w in DEFAULTS.items() if isinstance(kind, t)), None)
    if wire is None or wire not in SCALARS:
        raise WireTypeError(f"{kind.simpleString()} has no wire form{f' {wire}' if wire else ''}")
    allowed = ALLOWED.get(wire)
    if allowed and not isinstance(kind, allowed):
        raise WireTypeError(f"{wire} doesn't stand for {kind.simpleString()}")
    return wire


def members(schema: T.StructType, meta: dict) -> list[tuple[T.StructField, int | None]]:
    """The fields that are written, in the order of the layout, with their keys."""
    fields = [f for f in schema.fields if not (f.metadata or {}).get("ignore")]
    if meta.get("layout") == "keyed":
        return sorted(((f, f.metadata["key"]) for f in fields), key=lambda x: x[1])
    fields = [f for f in fields if not f.name.startswith("_") or (f.metadata or {}).get("include")]
    last = 1 << 31
    return [(f, None) for f in sorted(fields, key=lambda f: ((f.metadata or {}).get("order", last), ordinal(f.name)))]


def build(kind: T.DataType, nullable: bool, meta: dict) -> Codec:
    """The codec of a value of ``kind``."""
    wire = meta.get("wire")
    if "enum" in meta:
        codec: Codec = Enum(meta["enum"], {int(k): v for k, v in meta.get("names", {}).items()}, meta.get("type", "Enum"))
        return Nullable(codec) if nullable else codec
    if isinstance(kind, T.BinaryType):
        return Sequence(SCALARS["u8"](), wire or "array")
    if isinstance(kind, T.ArrayType) and wire not in SCALARS:
        inner = meta.get("element", {})
        if wire == "priority_queue":
            a, b = kind.elementType.fields
            return Queue(build(a.dataType, a.nullable, a.metadata or {}), build(b.dataType, b.nullable, b.metadata or {}), (a.name, b.name))
        if (wire or "list") not in SEQUENCES:
            raise WireTypeError(f"{wire} is no sequence kind")
        return Sequence(build(kind.elementType, kind.containsNull, inner), wire or "list")
    if isinstance(kind, T.MapType):
        if (wire or "dictionary") not in MAPS:
            raise WireTypeError(f"{wire} is no map kind")
        return Map(build(kind.keyType, isinstance(kind.keyType, T.StructType), meta.get("key_meta", {})), build(kind.valueType, kind.valueContainsNull, meta.get("value_meta", {})), wire or "dictionary")
    if isinstance(kind, T.StructType) and wire not in SCALARS:
        name = meta.get("type", "Object")
        if wire == "grid":
            data = kind["data"].dataType
            return Grid(build(data.elementType, data.containsNull, (kind["data"].metadata or {}).get("element", {})), meta.get("rank"))
        if wire in ("pair", "tuple", "value_tuple", "lazy"):
            parts = [Member(f.name, build(f.dataType, f.nullable, f.metadata or {})) for f in kind.fields]
            inner = ", ".join(p.codec.name for p in parts)
            label = {"pair": f"KeyValuePair<{inner}>", "tuple": f"Tuple<{inner}>", "value_tuple": f"({inner})", "lazy": f"Lazy<{inner}>"}[wire]
            if wire == "lazy" and len(parts) != 1 or wire == "pair" and len(parts) != 2 or not 1 <= len(parts) <= 8:
                raise WireTypeError(f"{len(parts)} parts don't make a {wire}")
            codec = Composite(label, parts, wire in ("pair", "value_tuple"))
            return Nullable(codec) if codec.value_type and nullable else codec
        if "union" in meta:
            arms = {}
            for f in kind.fields:
                m = f.metadata or {}
                arm = build(f.dataType, True, m)
                arms[meta["union"][f.name]] = (f.name, arm)
            return Union(name, dict(sorted(arms.items())))
        keyed = meta.get("layout") == "keyed"
        parts = [Member(f.name, build(f.dataType, f.nullable, f.metadata or {}), key) for f, key in members(kind, meta)]
        out = Object(name, parts, keyed, value_type=not nullable)
        out.identity = tuple(meta.get("identity", ()))
        return out
    codec = SCALARS[_scalar_name(kind, meta)]()
    return codec if codec.fold or not nullable else Nullable(codec)


def compile_schema(kind: T.DataType, meta: dict | None = None, nullable: bool = True) -> Codec:
    """The codec of a root value; a root struct is a class unless ``nullable`` is false."""
    return compiled(kind.json(), json.dumps(meta or {}, sort_keys=True), nullable)


@lru_cache(maxsize=512)
def compiled(kind_json: str, meta_json: str, nullable: bool) -> Codec:
    parsed = json.loads(kind_json)
    kind = T._parse_datatype_json_value(parsed)
    meta = json.loads(meta_json)
    found = _nested(kind, meta, "root")
    if found:
        raise WireTypeError("; ".join(f"{d.code} {d.path}: {d.message}" for d in found))
    codec = build(kind, nullable, meta)
    codec.recipe = kind_json, meta_json, nullable
    return codec


def required(kind: T.DataType) -> T.DataType:
    """The same type with nothing nullable but strings (which fold null anyway)."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, required(f.dataType), False, f.metadata) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(required(kind.elementType), False)
    if isinstance(kind, T.MapType):
        return T.MapType(required(kind.keyType), required(kind.valueType), False)
    return kind


class Context:
    """A set of named schemas, compiled when they are added: the handles that options and sources accept by name."""

    def __init__(self):
        self.schemas: dict[str, tuple[T.DataType, dict]] = {}

    def add(self, name: str, kind: T.DataType, meta: dict | None = None) -> Context:
        meta = {"type": name} | (meta or {})
        compile_schema(kind, meta)
        if name in self.schemas and self.schemas[name] != (kind, meta):
            raise WireTypeError(f"{name} is already another schema")
        self.schemas[name] = (kind, meta)
        return self

    def find(self, name: str) -> tuple[T.DataType, dict]:
        if name not in self.schemas:
            raise WireTypeError(f"no schema is named {name}")
        return self.schemas[name]


def plain(kind: T.DataType) -> T.DataType:
    """The same type without metadata and with everything nullable, as results carry it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, plain(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(plain(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(plain(kind.keyType), plain(kind.valueType))
    return kind
