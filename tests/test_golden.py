"""Golden bytes: what the format's own vectors say."""

import decimal
import zlib

import pytest
from pyspark.sql import types as T

from framewright.functions import algorithms, envelope, header
from framewright.functions.codec import FOUND, SCALARS, Member, Object, decode, encode
from framewright.functions.options import Options
from framewright.functions.schema import compile_schema

I, S = T.IntegerType(), T.StringType()


def struct(*fields):
    return T.StructType([T.StructField(n, k, nullable, meta or {}) for n, k, nullable, meta in fields])


def f(name, kind=I, nullable=False, **meta):
    return name, kind, nullable, meta


NODE = struct(f("Value"))
SHARED = [7]
#: Types, values and the bytes that they must have.
VECTORS = [
    (I, None, False, 0x11223344, "44332211"),
    (S, None, True, None, "00"), (S, None, True, "", "01"), (S, None, True, "hello", "0668656C6C6F"), (S, None, True, "héllo", "0768C3A96C6C6F"),
    (T.ArrayType(I, False), None, True, [1, 2], "030100000002000000"), (T.ArrayType(I, False), None, True, None, "00"),
    (T.MapType(I, I, False), None, True, [(7, 9)], "020700000009000000"), (T.BinaryType(), None, True, b"\x0a\x0b", "030A0B"),
    (I, None, True, 5, "0105000000"), (I, None, True, None, "00"),
    (struct(f("Name", S, True), f("Age")), None, True, {"Name": "A", "Age": 2}, "01020000000241"),
    (struct(f("Kept", NODE, True, key=2)), {"layout": "keyed"}, True, {"Kept": {"Value": 5}}, "0202050000000105000000"),
    (struct(f("X", key=1), f("Y", key=2)), {"layout": "keyed"}, False, {"X": 3, "Y": 4}, "02010400000003000000020400000004000000"),
    (struct(f("arm", struct(f("A"), f("Z")), True)), {"union": {"arm": 1}}, True, {"arm": {"A": 3, "Z": 4}}, "01010300000004000000"),
    (struct(f("Late", key=5), f("Early", key=1)), {"layout": "keyed"}, True, {"Late": 11, "Early": 22}, "0301040000001600000005040000000B000000"),
    (T.ArrayType(T.BooleanType()), {"wire": "bits"}, True, [c == "1" for c in "101100011"], "0A028D01"),
    (struct(f("dims", T.ArrayType(I, False)), f("data", T.ArrayType(I, False))), {"wire": "grid"}, True, {"dims": [2, 3], "data": [1, 2, 3, 4, 5, 6]}, "030203010000000200000003000000040000000500000006000000"),
    (struct(f("a"), f("b", S, True)), {"wire": "tuple"}, True, {"a": 7, "b": "a"}, "01070000000261"), (struct(f("a"), f("b", S, True)), {"wire": "value_tuple"}, False, {"a": 7, "b": "a"}, "070000000261"),
    (T.ArrayType(I, False), {"wire": "immutable_array"}, True, None, "00"), (T.ArrayType(I, False), {"wire": "immutable_array"}, True, [], "01"), (T.ArrayType(I, False), {"wire": "immutable_array"}, True, [7, 9], "030700000009000000"),
    (T.DecimalType(29, 1), None, False, decimal.Decimal("1.5"), "0F000000000000000000000000000100"),
    (T.DecimalType(38, 0), {"wire": "bigint"}, False, 300, "022C01"), (T.DecimalType(38, 0), {"wire": "bigint"}, False, 0, "0100"), (T.DecimalType(38, 0), {"wire": "bigint"}, False, -1, "01FF"),
    (T.FloatType(), {"wire": "f16"}, False, 1.5, "003E"), (S, {"wire": "rune"}, False, "\U0001f600", "00F60100"),
]


@pytest.mark.parametrize("kind,meta,nullable,value,wire", VECTORS)
def test_payloads(kind, meta, nullable, value, wire):
    codec = compile_schema(kind, meta, nullable)
    data = encode(codec, value)
    assert data.hex().upper() == wire
    back = decode(codec, data)
    if isinstance(back, dict):
        back.pop(FOUND, None)
    assert back == value or meta and "union" in meta and back["arm"] == value["arm"]


def test_references():
    assert encode(compile_schema(T.ArrayType(I, False)), [1, 2, 3], references=True).hex().upper() == "0103010000000200000003000000"
    two = compile_schema(struct(f("A", T.ArrayType(I, False), True), f("B", T.ArrayType(I, False), True)))
    data = encode(two, {"A": SHARED, "B": SHARED}, references=True)
    assert data.hex().upper() == "01030107000000" + "04"
    back = decode(two, data, references=True)
    assert back["A"] is back["B"]
    kept = compile_schema(struct(f("Kept", NODE, True, key=2)), {"layout": "keyed"})
    assert encode(kept, {"Kept": {"Value": 5}}, references=True).hex().upper() == "010102050000000305000000"


@pytest.mark.parametrize("n,prefix", [(126, "7F"), (127, "8001"), (16382, "FF7F"), (16383, "808001")])
def test_string_lengths(n, prefix):
    assert encode(compile_schema(S), "a" * n).hex().upper().startswith(prefix + "61")


def test_headers():
    h = header.Header(compression=(2, None, 1000), encryption=(1, None, "k7"), on_disk=0)
    assert header.write(h)[:-1].hex().upper() == "42534552010002050302E807070401036B37"
    assert envelope.seal(encode(compile_schema(I, nullable=False), 0x11223344), Options()).hex().upper() == "425345520100000444332211"
    assert envelope.seal(encode(compile_schema(S), ""), Options()).hex().upper() == "425345520100000101"
    assert [len(envelope.parts(b"x" * 100, o)[0]) for o in (Options(), Options(checksum="crc32"), Options(checksum="crc32", compression="deflate"))] == [8, 15, 19]


#: The members of the frozen scalars in their order.
FROZEN = [
    ("Flag", "bool", True), ("Byte", "u8", 0xA5), ("SByte", "i8", -42), ("Short", "i16", -12345), ("UShort", "u16", 54321), ("Int", "i32", -1234567890), ("UInt", "u32", 3234567890), ("Long", "i64", -1234567890123456789),
    ("ULong", "u64", 12345678901234567890), ("Float", "f32", 3.5), ("Double", "f64", -2.718281828459045), ("Decimal", "decimal", decimal.Decimal("-79228162514264.337593543950335")), ("Char", "char", "Ж"), ("Text", "string", "hello — мир 🌍"),
    ("Choice", "i32", 7), ("Half", "f16", 1.5), ("Int128", "i128", -(2**127) + 7), ("UInt128", "u128", 2**128 - 8), ("NativeInt", "iptr", -(2**31)), ("NativeUInt", "uptr", 2**32 - 1), ("Rune", "rune", "\U0001f600"), ("BigInteger", "bigint", 2**130 - 1),
]


def test_frozen_scalars():
    codec = Object("Frozen", [Member(n, SCALARS[w]()) for n, w, _ in FROZEN])
    data = encode(codec, {n: v for n, _, v in FROZEN})
    assert len(data) == 160 and zlib.crc32(data).to_bytes(4, "little").hex().upper() == "71A17AA7"
    assert decode(codec, data) == {n: v for n, _, v in FROZEN}
    text = envelope.dump(envelope.seal(data, Options()), codec, Options()).text()
    for line in ("@0001  ├─ Flag                        Boolean          true", "@002C  ├─ Decimal                     Decimal          -79228162514264.337593543950335", "@003C  ├─ Char                        Char             \"Ж\"", "@008A  ├─ Rune                        Rune             😀"):
        assert line in text


def order():
    line = struct(f("Sku", S, True), f("Quantity"), f("Note", S, True))
    codec = compile_schema(struct(f("Id", T.LongType()), f("Customer", S, True), f("Lines", T.ArrayType(line, True), True, element={"type": "Line"})), {"type": "Order"})
    lines = [("ANL-1", 2, "gift"), ("DIF-7", 1, None), ("ENG-3", 5, "fragile")]
    return codec, {"Id": 1001, "Customer": "Ada Lovelace", "Lines": [dict(zip(("Sku", "Quantity", "Note"), x)) for x in lines]}


def test_order_hash_dump_and_hex():
    codec, value = order()
    data = encode(codec, value)
    assert len(data) == 70 and algorithms.checksum(2, data).hex().upper() == "F99E18257B275944"
    d = envelope.dump(envelope.seal(data, Options()), codec, Options())
    assert (d.max_depth, d.node_count) == (4, 16)
    text = d.text()
    for line in (
        "payload 70 bytes as Order · depth 4 · 16 nodes", "@0000  Order                                           object · 3 members", "@0016  └─ Lines                       List<Line>       3 items",
        "@0028     │  ├─ Note                  String           null", "@0040        └─ Sku                   String           \"ENG-3\"",
    ):
        assert line in text
    assert d.hex().splitlines()[1] == "@0010  00 00 00 00 00 00 04 01 05 67 69 66 74 02 00 00  Order.Id"
    assert d.hex().splitlines()[4].rstrip() == "@0040  06 45 4E 47 2D 33                                Order.Lines[2].Sku"


def test_frozen_keyed_dump():
    codec = compile_schema(struct(f("Number", key=1), f("Text", S, True, key=2), f("Numbers", T.ArrayType(I, False), True, key=7)), {"layout": "keyed", "type": "FrozenKeyed"})
    frame = envelope.seal(encode(codec, {"Number": 5, "Text": "keyed", "Numbers": [1, 2, 3]}), Options())
    d = envelope.dump(frame, codec, Options())
    assert len(frame) == 47 and d.node_count == 10 and d.max_depth == 4
    for line in ("@0000  FrozenKeyed                                     keyed object · 3 fields", "@0001  ├─ Number                      keyed field      key 1 · 9 bytes", "@001A     └─ value                    List<Int32>      3 items"):
        assert line in d.text()


def test_frozen_graph_dump():
    node = Object("FrozenNode", [])
    node.members = [Member("Value", SCALARS["i32"]()), Member("Next", node)]
    graph = Object("FrozenGraph", [Member("Left", node), Member("Right", node)])
    n = {"Value": 1, "Next": None}
    n["Next"] = n
    frame = envelope.seal(encode(graph, {"Left": n, "Right": n}, references=True), Options(), True)
    d = envelope.dump(frame, graph, Options())
    assert len(frame) == 16 and (d.max_depth, d.node_count) == (3, 5)
    assert d.text().splitlines()[1:] == [
        "  references   preserved", "payload 8 bytes as FrozenGraph · depth 3 · 5 nodes", "@0000  FrozenGraph                                     object · 2 members · #0", "@0001  ├─ Left                        FrozenNode       object · 2 members · #1",
        "@0002  │  ├─ Value                    Int32            1", "@0006  │  └─ Next                     FrozenNode       → #1 FrozenGraph.Left", "@0007  └─ Right                       FrozenNode       → #1 FrozenGraph.Left",
    ]
    back = decode(graph, frame[8:], references=True)
    assert back["Left"]["Next"] is back["Left"] and back["Right"] is back["Left"]
