"""Types whose Spark form needs care: times, intervals, instants, offsets, nested values in columns."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.codec import MAX_TICKS, decode, encode
from framewright.functions.errors import FormatError, WireTypeError
from framewright.functions.schema import compile_schema, members
from framewright.operators import frames as fr


def through(spark, rows, schema, meta=None):
    df = fr.prepare(spark.createDataFrame(rows, schema))
    return df.select(fr.decode(fr.encode(F.struct(*df.columns), df.schema if not isinstance(schema, T.StructType) else schema, meta), schema if isinstance(schema, T.StructType) else df.schema, meta).alias("v")).select("v.*").collect()


def test_instants_and_intervals(spark):
    schema = T.StructType([T.StructField("at", T.TimestampType()), T.StructField("wall", T.TimestampNTZType()), T.StructField("span", T.DayTimeIntervalType())])
    rows = [(dt.datetime(2026, 9, 20, 13, 45, 30, 123000), dt.datetime(1, 1, 1), dt.timedelta(days=-3, microseconds=7)), (dt.datetime(1970, 1, 1), dt.datetime(9999, 12, 31, 23, 59, 59, 999999), dt.timedelta(0)), (None, None, None)]
    df = fr.prepare(spark.createDataFrame(rows, schema))
    out = df.select("*", fr.decode(fr.encode(F.struct(*df.columns), schema), schema).alias("v"))
    assert out.where("at <=> v.at AND wall <=> v.wall AND span <=> v.span").count() == 3


def test_time_of_day(spark):
    if not hasattr(T, "TimeType"):
        pytest.skip("no TIME type here")
    codec = compile_schema(T.TimeType(6), nullable=False)
    at = dt.time(13, 45, 30, 123000)
    data = encode(codec, at)
    assert int.from_bytes(data, "little") == 495_301_230_000 and decode(codec, data) == 495_301_230_000
    with pytest.raises(FormatError):
        decode(codec, (864_000_000_000).to_bytes(8, "little"))


def test_offsets_and_kinds():
    codec = compile_schema(T.StructType([T.StructField("ticks", T.LongType()), T.StructField("offset_ticks", T.LongType())]), {"wire": "offset"}, nullable=False)
    v = {"ticks": 639_000_000_000_000_000, "offset_ticks": -5 * 36_000_000_000}
    assert decode(codec, encode(codec, v)) == v
    for bad in ({"ticks": 1, "offset_ticks": 36_000_000_000}, {"ticks": MAX_TICKS, "offset_ticks": 15 * 36_000_000_000}, {"ticks": 10**12, "offset_ticks": 1}):
        with pytest.raises(WireTypeError):
            encode(codec, bad)
    wall, instant = compile_schema(T.TimestampNTZType(), nullable=False), compile_schema(T.TimestampType(), nullable=False)
    assert encode(instant, dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc))[7] & 0xC0 == 0x40
    with pytest.raises(FormatError):
        decode(wall, (3 << 62).to_bytes(8, "little"))
    with pytest.raises(FormatError):
        decode(wall, (1).to_bytes(8, "little"))


def test_layout_orders():
    f = lambda n, **m: T.StructField(n, T.IntegerType(), False, m)
    schema = T.StructType([f("b"), f("a"), f("z", order=1), f("_hidden"), f("_shown", include=True), f("gone", ignore=True), f("B")])
    assert [x.name for x, _ in members(schema, {})] == ["z", "B", "_shown", "a", "b"]
    keyed = T.StructType([f("x", key=9), f("y", key=2), f("n", ignore=True)])
    assert [(x.name, k) for x, k in members(keyed, {"layout": "keyed"})] == [("y", 2), ("x", 9)]


def test_nested_values_through_spark(spark):
    inner = T.StructType([T.StructField("k", T.IntegerType(), False), T.StructField("s", T.StringType())])
    schema = T.StructType([
        T.StructField("m", T.MapType(T.StringType(), T.ArrayType(inner))), T.StructField("d", T.DecimalType(12, 3)), T.StructField("set", T.ArrayType(T.StringType(), False), True, {"wire": "sorted_set"}),
        T.StructField("q", T.ArrayType(T.StructType([T.StructField("element", T.StringType()), T.StructField("priority", T.IntegerType(), False)]), False), True, {"wire": "priority_queue"}),
        T.StructField("raw", T.BinaryType()), T.StructField("deep", T.ArrayType(T.ArrayType(T.ArrayType(T.LongType())))),
    ])
    rows = [({"x": [(1, "a"), None], "y": None}, decimal.Decimal("-1.250"), ["b", "a"], [("late", 9), ("early", 1)], bytearray(b"\0\xff"), [[[1, None]], None, []]), (None,) * 6, ({}, decimal.Decimal(0), [], [], bytearray(), [])]
    out = through(spark, rows, schema)
    assert out[0].m == {"x": [T.Row(k=1, s="a"), None], "y": None} and out[0].d == decimal.Decimal("-1.250") and out[0].set == ["a", "b"]
    assert [x.element for x in out[0].q] == ["early", "late"] and out[0].raw == b"\0\xff" and out[0].deep == [[[1, None]], None, []]
    assert tuple(out[1]) == (None,) * 6 and out[2].m == {} and out[2].raw == b""


def test_refused_types():
    for kind, meta in ((T.NullType(), {}), (T.VariantType(), {}), (T.IntegerType(), {"wire": "guid"}), (T.ArrayType(T.IntegerType()), {"wire": "heap"}), (T.StructType([]), {"wire": "pair"})):
        with pytest.raises(WireTypeError):
            compile_schema(kind, meta)


def test_text_rules():
    for wire, good, bad in (("version", "1.2.3", "1.02"), ("culture", "en-US", "EN"), ("uri", "http://x", ""), ("guid", "0f8fad5b-d9cb-469f-a165-70867728950e", "nope"), ("char", "Ж", "😀"), ("rune", "😀", "ab")):
        codec = compile_schema(T.StringType(), {"wire": wire}, nullable=False)
        assert decode(codec, encode(codec, good)) == good
        with pytest.raises(WireTypeError):
            encode(codec, bad)
    with pytest.raises(FormatError):
        decode(compile_schema(T.StringType()), b"\x03\xc3\x28")
