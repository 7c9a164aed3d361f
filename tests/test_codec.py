"""Properties: round trips, both back ends agree, nothing escapes the taxonomy, tighter limits never help."""

import datetime as dt
import math
from dataclasses import replace

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from framewright.functions import algorithms, batch, envelope, header
from framewright.functions import rows as R
from framewright.functions.codec import FOUND, decode, encode
from framewright.functions.errors import ConfigurationError, EncryptionKeyError, FormatError, FrameError, IntegrityError, LimitError, NotSupportedError, WireTypeError
from framewright.functions.keys import Keys, hkdf
from framewright.functions.limits import DEFAULT, Limits
from framewright.functions.options import Options
from framewright.functions.schema import Context, compile_schema, diagnose, ordinal

INNER = T.StructType([T.StructField("x", T.IntegerType(), False), T.StructField("s", T.StringType())])
WIDE = T.StructType([
    T.StructField("b", T.BooleanType()), T.StructField("i", T.IntegerType(), False), T.StructField("l", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("t", T.StringType()), T.StructField("day", T.DateType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("raw", T.BinaryType()), T.StructField("xs", T.ArrayType(T.IntegerType(), False)), T.StructField("ss", T.ArrayType(T.StringType())), T.StructField("in", INNER), T.StructField("rows", T.ArrayType(INNER)),
])
KEYED = T.StructType([T.StructField(f.name, f.dataType, f.nullable, {"key": 3 * i + 1}) for i, f in enumerate(WIDE.fields)])
ints, texts = st.integers(-(2**31), 2**31 - 1), st.text(max_size=12)
inner = st.fixed_dictionaries({"x": ints, "s": st.none() | texts})
values = st.fixed_dictionaries({
    "b": st.none() | st.booleans(), "i": ints, "l": st.none() | st.integers(-(2**63), 2**63 - 1), "d": st.none() | st.floats(allow_nan=False), "t": st.none() | texts, "day": st.none() | st.dates(),
    "ts": st.none() | st.datetimes(), "raw": st.none() | st.binary(max_size=9), "xs": st.none() | st.lists(ints, max_size=5), "ss": st.none() | st.lists(st.none() | texts, max_size=4), "in": st.none() | inner, "rows": st.none() | st.lists(st.none() | inner, max_size=3),
})


def arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def plain(v):
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items() if k != FOUND}
    return [plain(x) for x in v] if isinstance(v, list) else v


def ordered(v):
    """A value's text: unlike ``==`` it finds NaN equal to itself."""
    if isinstance(v, dict):
        return str(sorted((k, ordered(x)) for k, x in v.items()))
    return str([ordered(x) for x in v]) if isinstance(v, list) else repr(v)


@pytest.fixture(scope="module", autouse=True)
def session(spark):
    return spark


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | values, min_size=1, max_size=6), st.booleans())
def test_both_back_ends_agree(rows, keyed):
    kind, meta = (KEYED, {"layout": "keyed"}) if keyed else (WIDE, {})
    codec = compile_schema(kind, meta)
    expected = [encode(codec, v) for v in rows]
    a = pa.array(rows, arrow(kind))
    assert batch.encode(codec, a, DEFAULT).to_pylist() == expected
    assert [plain(decode(codec, b)) for b in expected] == rows
    got, judge = batch.decode(codec, pa.array(expected, pa.binary()), arrow(kind), DEFAULT)
    assert not judge.any() and got.to_pylist() == rows


@settings(max_examples=300, deadline=None)
@given(values, st.integers(0, 10**6), st.integers(1, 255), st.booleans(), st.booleans())
def test_damage_is_the_same_for_both(value, at, flip, keyed, cut):
    """A damaged payload fails alike, or reads alike; whatever is raised is of the taxonomy."""
    kind, meta = (KEYED, {"layout": "keyed"}) if keyed else (WIDE, {})
    codec = compile_schema(kind, meta)
    data = bytearray(encode(codec, value))
    at %= len(data)
    data = data[:at] if cut else data[:at] + bytes([data[at] ^ flip]) + data[at + 1 :]
    try:
        expected, failed = plain(decode(codec, bytes(data))), False
    except FrameError:
        expected, failed = None, True
    got, judge = batch.decode(codec, pa.array([bytes(data)], pa.binary()), arrow(kind), DEFAULT)
    assert judge[0] or not failed
    if not judge[0]:
        x = got.to_pylist()[0]
        assert ordered(x) == ordered(expected)
    d = R.Decoded(codec, [bytes(data)], arrow(kind), DEFAULT)
    assert (d.errors[0] is not None) == failed


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_arbitrary_bytes(data):
    for call in (lambda: decode(compile_schema(WIDE), data), lambda: header.read(data), lambda: envelope.split(data, Options())):
        try:
            call()
        except FrameError:
            pass
    envelope.dump(data, compile_schema(WIDE), Options(allow_v0=True)).text()


@settings(max_examples=100, deadline=None)
@given(values, st.integers(1, 60), st.sampled_from(["max_depth", "max_array_length", "max_collection_length", "max_string_bytes", "max_total_elements", "max_object_graph_nodes", "max_payload_bytes"]))
def test_tighter_limits_never_turn_failure_into_success(value, n, name):
    codec = compile_schema(WIDE)
    data = encode(codec, value)

    def fails(limits):
        try:
            envelope.undo(envelope.seal(data, Options()), Options(limits=limits))
            decode(codec, data, limits)
        except LimitError:
            return True
        return False

    tight, tighter = Limits(**{name: n}), Limits(**{name: max(1, n // 2)})
    assert not fails(DEFAULT) and (not fails(tight) or fails(tighter))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.sampled_from(["none", "deflate"]), st.sampled_from(["none", "crc32", "xxh3", "xxh128"]), st.integers(0, 10**6), st.integers(1, 255))
def test_phases_and_tampering(payload, compression, checksum, at, flip):
    o = Options(compression=compression, checksum=checksum)
    frame = envelope.seal(payload, o)
    assert envelope.undo(frame, Options()) == (payload, False)
    at %= len(frame)
    bad = frame[:at] + bytes([frame[at] ^ flip]) + frame[at + 1 :]
    try:
        out = envelope.undo(bad, Options())
    except FrameError:
        return
    assert checksum == "none" or at < 8 or out[0] == payload  # a checksum lets no changed payload through


def test_every_truncation_fails():
    codec = compile_schema(WIDE)
    v = {"b": True, "i": 1, "l": 2, "d": 0.5, "t": "x", "day": dt.date(2020, 1, 1), "ts": dt.datetime(2020, 1, 1), "raw": b"z", "xs": [1], "ss": ["a"], "in": {"x": 1, "s": "q"}, "rows": [{"x": 2, "s": None}]}
    data = encode(codec, v)
    for n in range(len(data)):
        with pytest.raises(FormatError):
            decode(codec, data[:n])
    with pytest.raises(FormatError):
        decode(codec, data + b"\0")


@pytest.mark.parametrize("data", ["80", "8000", "FFFFFFFFFF01", "808080808001", "FFFFFFFF0F"])
def test_numbers_have_one_spelling(data):
    with pytest.raises(FormatError):
        decode(compile_schema(T.StringType()), bytes.fromhex(data))


def test_depth_nodes_and_cycles():
    kind = T.IntegerType()
    for _ in range(20):
        kind = T.ArrayType(kind, False)
    v = 1
    for _ in range(20):
        v = [v]
    codec = compile_schema(kind)
    assert decode(codec, encode(codec, v)) == v
    with pytest.raises(LimitError):
        encode(codec, v, Limits(max_depth=19))
    with pytest.raises(LimitError):
        decode(codec, encode(codec, v), Limits(max_object_graph_nodes=10))


def test_containers_reject_and_order():
    k = T.ArrayType(T.IntegerType(), False)
    as_list = encode(compile_schema(k), [3, 1, 3])
    with pytest.raises(FormatError):
        decode(compile_schema(k, {"wire": "set"}), as_list)
    with pytest.raises(WireTypeError):
        encode(compile_schema(k, {"wire": "set"}), [1, 1])
    s = compile_schema(k, {"wire": "sorted_set"})
    assert encode(s, [3, 1, 2]) == encode(s, [2, 3, 1]) and decode(s, encode(compile_schema(k), [3, 1, 2])) == [1, 2, 3]
    stack = compile_schema(k, {"wire": "stack"})
    assert decode(compile_schema(k), encode(stack, [1, 2, 3])) == [3, 2, 1] and decode(stack, encode(stack, [1, 2, 3])) == [1, 2, 3]
    m = compile_schema(T.MapType(T.IntegerType(), T.StringType()), {"wire": "sorted_dictionary"})
    assert encode(m, [(2, "b"), (1, "a")]) == encode(m, [(1, "a"), (2, "b")])
    with pytest.raises(FormatError):
        decode(compile_schema(T.MapType(T.IntegerType(), T.IntegerType(), False)), bytes.fromhex("03" + "0700000009000000" * 2))


def test_keyed_rules():
    f = lambda n, k: T.StructField(n, T.IntegerType(), False, {"key": k})
    three, outer = (compile_schema(T.StructType(x), {"layout": "keyed"}) for x in ([f("a", 1), f("b", 2), f("c", 3)], [f("a", 1), f("c", 3)]))
    data = encode(three, {"a": 1, "b": 2, "c": 3})
    back = decode(outer, data)
    assert (back["a"], back["c"], back[FOUND]) == (1, 3, {"a", "c"})
    assert decode(three, encode(outer, {"a": 1, "c": 3}))["b"] is None
    for bad in (data.replace(b"\x02\x04\x00\x00\x00", b"\x01\x04\x00\x00\x00"), data.replace(b"\x03\x04\x00\x00\x00", b"\x03\x05\x00\x00\x00"), data.replace(b"\x02\x04\x00\x00\x00", b"\x02\xff\xff\xff\xff")):
        with pytest.raises(FormatError):
            decode(three, bad)
    wide = compile_schema(T.StructType([f(f"k{k}", k) for k in (0, 127, 128, 2**31 - 1)]), {"layout": "keyed"})
    assert decode(wide, encode(wide, {f"k{k}": 1 for k in (0, 127, 128, 2**31 - 1)}))["k128"] == 1


def test_unions():
    arm = lambda n: T.StructField(n, T.StructType([T.StructField("v", T.IntegerType(), False)]))
    u = compile_schema(T.StructType([arm("a"), arm("b")]), {"union": {"a": 0, "b": 255}})
    assert encode(u, {"a": None, "b": {"v": 1}}).hex() == "01ff01000000" and decode(u, bytes.fromhex("010001000000"))["a"]["v"] == 1
    with pytest.raises(WireTypeError):
        decode(u, bytes.fromhex("010101000000"))
    for wrong in ({"a": None, "b": None}, {"a": {"v": 1}, "b": {"v": 1}}):
        with pytest.raises(WireTypeError):
            encode(u, wrong)


def test_reference_errors():
    lists = compile_schema(T.ArrayType(T.ArrayType(T.IntegerType(), False)))
    for bad in ("010104", "01020301000000000301000000", "010202"):
        with pytest.raises(FormatError):
            decode(lists, bytes.fromhex(bad), references=True)
    pair = compile_schema(T.StructType([T.StructField(n, T.StructType([T.StructField("v", T.IntegerType(), False)]), True, {"key": k}) for n, k in (("a", 1), ("b", 2))]), {"layout": "keyed"})
    x = {"v": 1}
    back = decode(pair, encode(pair, {"a": x, "b": x}, references=True), references=True)
    assert back["a"] == back["b"] and back["a"] is not back["b"]  # siblings under keys don't share


def test_schema_diagnostics():
    f = lambda n, k=T.IntegerType(), **m: T.StructField(n, k, True, m)
    s = lambda *x: T.StructType(list(x))
    cases = {
        "KEY_WITHOUT_CONTRACT": (s(f("a", key=1)), {}), "INCLUDE_AND_IGNORE": (s(f("a", include=True, ignore=True)), {}), "ORDER_TWICE": (s(f("a", order=1), f("b", order=1)), {}), "INCLUDE_IN_CONTRACT": (s(f("a", key=1, include=True)), {"layout": "keyed"}),
        "ORDER_IN_CONTRACT": (s(f("a", key=1, order=1)), {"layout": "keyed"}), "KEY_AND_IGNORE": (s(f("a", key=1, ignore=True)), {"layout": "keyed"}), "MEMBER_WITHOUT_KEY": (s(f("a")), {"layout": "keyed"}), "KEY_NEGATIVE": (s(f("a", key=-1)), {"layout": "keyed"}),
        "KEY_TWICE": (s(f("a", key=1), f("b", key=1)), {"layout": "keyed"}), "UNSUPPORTED_WIRE_TYPE": (s(f("a", T.NullType())), {}), "UNION_TAG_RANGE": (s(f("a", s(f("x")))), {"union": {"a": 256}}), "UNION_TAG_TWICE": (s(f("a", s(f("x"))), f("b", s(f("x")))), {"union": {"a": 1, "b": 1}}),
        "UNION_ARM_TYPE": (s(f("a")), {"union": {"a": 1}}), "UNION_ARM_UNTAGGED": (s(f("a", s(f("x"))), f("b", s(f("x")))), {"union": {"a": 1}}),
    }
    for code, (kind, meta) in cases.items():
        assert code in {d.code for d in diagnose(kind, meta)}, code
        with pytest.raises(WireTypeError):
            compile_schema(kind, meta)
    assert sorted(["￿", "\U00010000"], key=ordinal) == ["\U00010000", "￿"]
    c = Context().add("A", s(f("x")))
    assert c.find("A")[1] == {"type": "A"}
    with pytest.raises(WireTypeError):
        c.find("B")


@pytest.mark.parametrize(
    "bad",
    [
        {"version": 2}, {"compression": "lz9"}, {"encryption": "aes256gcm"}, {"require_encryption": True}, {"require_checksum": True}, {"checksum": "crc32", "require_checksum": True, "allow_v0": True},
        {"encryption": "aes256gcm", "keys": Keys(fixed=b"short")}, {"encryption": "aes256gcm", "keys": Keys(fixed=bytes(32)), "require_encryption": True, "version": 0},
    ],
)
def test_contradictory_options(bad):
    with pytest.raises(ConfigurationError):
        Options(**bad)


def test_limits_must_be_positive_and_platform_gaps():
    with pytest.raises(ConfigurationError):
        replace(DEFAULT, max_depth=0)
    for o in ({"compression": "brotli"},):
        what, name = next((k, v) for k, v in o.items() if k != "keys")
        try:
            algorithms.available(what, name)
        except NotSupportedError:
            with pytest.raises(NotSupportedError):
                Options(**o)


def test_keys():
    # RFC 5869, test case 1.
    assert hkdf(bytes([11] * 22), bytes(range(13)), bytes(range(240, 250)), 42).hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"
    assert Keys(root=bytes(32)).get("a") != Keys(root=bytes(32)).get("b")
    for keys, ident in ((Keys(fixed=bytes(32), fixed_id="x"), "y"), (Keys(resolve=lambda _: None), "a"), (Keys(resolve=lambda _: b"short"), "a"), (Keys(root=bytes(32)), None), (Keys(resolve=lambda _: 1 / 0), "a")):
        with pytest.raises(EncryptionKeyError):
            keys.get(ident)


def test_headers_are_canonical():
    frame = envelope.seal(b"abc", Options(checksum="crc32"))
    assert header.read(frame).info()["checksum_algorithm"] == "Crc32"
    cases = [
        (b"BSER\x02" + frame[5:], NotSupportedError), (b"BSER\x81\x00" + frame[5:], FormatError), (b"XSER" + frame[4:], FormatError), (frame.replace(b"\x03\x05\x01", b"\x03\x05\x09"), NotSupportedError),
        (frame.replace(b"\x03\x05\x01", b"\x03\x04\x01"), FormatError), (b"BSER\x01\x00\x01\x0b\x01\x00\x00", NotSupportedError), (frame[:-1], FormatError), (frame + b"\0", FormatError), (b"", FormatError), (b"BSER\x01\x02\x00\x00", NotSupportedError),
    ]
    for data, error in cases:
        with pytest.raises(error):
            envelope.undo(data, Options())
    # An unknown record that isn't critical is stepped over.
    assert envelope.undo(b"BSER\x01\x00\x01\x0a\x02zz\x01q", Options()) == (b"q", False)


def test_amplification_is_bounded():
    bomb = envelope.seal(bytes(1 << 20), Options(compression="deflate"))
    assert len(envelope.undo(bomb, Options())[0]) == 1 << 20
    for limits in (Limits(max_decompression_ratio=100), Limits(max_payload_bytes=1000)):
        with pytest.raises(LimitError):
            envelope.undo(bomb, Options(limits=limits))
    lie = bomb.replace(header.varint(1 << 20), header.varint((1 << 20) - 1))
    with pytest.raises(FormatError):
        envelope.undo(lie, Options())


def test_streams_of_frames():
    frames = [envelope.seal(bytes([k]) * k, Options(checksum="crc32")) for k in range(1, 5)]
    assert [f for _, _, f in envelope.split(b"".join(frames), Options())] == frames
    assert [o for o, _, _ in envelope.split(b"".join(frames), Options())] == [0, 1, 2, 3]
    assert envelope.split(b"", Options()) == []
    with pytest.raises(FormatError):
        envelope.split(b"".join(frames)[:-1], Options())


def test_custom_algorithms():
    from framewright.plans.registry import Sum16, Xor, Zlib

    o = Options(compression="zlib", checksum="sum16", encryption="xor", keys=Keys(fixed=b"\x21"), custom={"zlib": Zlib(), "sum16": Sum16(), "xor": Xor()})
    frame = envelope.seal(b"payload" * 9, o)
    assert envelope.undo(frame, o)[0] == b"payload" * 9
    assert header.read(frame).info()["compression_name"] == "zlib"
    with pytest.raises(NotSupportedError):
        envelope.undo(frame, Options(keys=Keys(fixed=b"\x21")))
    with pytest.raises(IntegrityError):
        envelope.undo(frame, replace(o, encryption="aes256gcm", keys=Keys(fixed=bytes(32)), require_encryption=True))


def test_floats_keep_their_bits():
    codec = compile_schema(T.DoubleType(), nullable=False)
    assert math.isnan(decode(codec, encode(codec, float("nan")))) and encode(codec, -0.0) != encode(codec, 0.0)


ARM = T.StructType([T.StructField("v", T.IntegerType(), False), T.StructField("s", T.StringType())])
UNION = T.StructType([T.StructField(n, ARM, True, {"type": n}) for n in "ab"])
MAPS = T.MapType(T.IntegerType(), T.StringType())
TEXT_MAPS = T.MapType(T.StringType(), T.ArrayType(T.IntegerType(), False))
arms = st.fixed_dictionaries({"v": ints, "s": st.none() | texts})


@settings(max_examples=80, deadline=None)
@given(
    st.lists(st.none() | st.one_of(arms.map(lambda x: {"a": x, "b": None}), arms.map(lambda x: {"a": None, "b": x})), min_size=1, max_size=5),
    st.lists(st.none() | st.dictionaries(ints, st.none() | texts, max_size=4), min_size=1, max_size=4),
    st.lists(st.none() | st.dictionaries(texts, st.none() | st.lists(ints, max_size=3), max_size=4), min_size=1, max_size=4),
    st.integers(0, 10**6),
    st.integers(1, 255),
)
def test_unions_and_maps_agree(unions, maps, text_maps, at, flip):
    as_pairs = [[None if m is None else list(m.items()) for m in x] for x in (maps, text_maps)]
    for kind, meta, rows in ((UNION, {"union": {"a": 3, "b": 250}}, unions), (MAPS, {}, as_pairs[0]), (TEXT_MAPS, {}, as_pairs[1])):
        codec = compile_schema(kind, meta)
        expected = [encode(codec, v) for v in rows]
        assert batch.encode(codec, pa.array(rows, arrow(kind)), DEFAULT).to_pylist() == expected
        got, judge = batch.decode(codec, pa.array(expected, pa.binary()), arrow(kind), DEFAULT)
        assert not judge.any() and got.to_pylist() == rows
        data = bytearray(b"".join(expected[:1]))
        data[at % len(data)] ^= flip
        d = R.Decoded(codec, [bytes(data)], arrow(kind), DEFAULT)
        try:
            value, failed = decode(codec, bytes(data)), False
        except FrameError:
            value, failed = None, True
        assert (d.errors[0] is not None) == failed
        if not failed:
            assert ordered(d.values.to_pylist()[0]) == ordered(R.to_spark(codec, value, arrow(kind)))


def test_a_map_key_twice_is_malformed_in_a_batch():
    codec = compile_schema(MAPS)
    data = encode(codec, [(7, "a"), (9, "b")]).replace(b"\x09\0\0\0", b"\x07\0\0\0")
    d = R.Decoded(codec, [data, encode(codec, [(7, "a")])], arrow(MAPS), DEFAULT)
    assert [e and e.error_class for e in d.errors] == ["FORMAT", None] and d.values.to_pylist() == [None, [(7, "a")]]


def test_chacha_vector():
    """The published vector of RFC 8439, 2.8.2."""
    from framewright.functions import chacha

    key, nonce, head = bytes(range(0x80, 0xA0)), bytes.fromhex("070000004041424344454647"), bytes.fromhex("50515253c0c1c2c3c4c5c6c7")
    text = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    out = chacha.seal(key, nonce, text, head)
    assert out[12:28].hex() == "d31a8d34648e60db7b86afbc53ef7ec2" and out[-16:].hex() == "1ae10b594f09e26a7e902ecbd0600691"
    assert chacha.open_(key, out, head) == text and chacha.open_(key, out, head + b"x") is None
    assert chacha.open_(key, chacha.seal(key, nonce, b"", b""), b"") == b""


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000])
def test_no_sealed_bytes_hold_the_text(size):
    text = bytes(range(1, 251)) * 4
    o = Options(encryption="chacha20poly1305", keys=Keys(fixed=bytes(range(32))), key_id="k", require_encryption=True)
    frame = envelope.seal(text[:size], o)
    assert size < 8 or text[:8] not in frame
    assert envelope.undo(frame, o)[0] == text[:size]
    for at in (0, 9, len(frame) - 1):
        bad = frame[:at] + bytes([frame[at] ^ 1]) + frame[at + 1 :]
        with pytest.raises(FrameError):
            envelope.undo(bad, o)
    with pytest.raises(NotSupportedError):
        envelope.seal(text, Options(encryption="aes256gcm", keys=Keys(fixed=bytes(32))))


def test_a_batch_is_sealed_and_opened_at_once(monkeypatch):
    """The blocks of all texts of a batch are made together, not a text at a time, and give what one text gives."""
    from framewright.functions import chacha

    calls, made = [], chacha.keystream
    monkeypatch.setattr(chacha, "keystream", lambda *a: calls.append(1) or made(*a))
    o = Options(encryption="chacha20poly1305", keys=Keys(resolve=lambda i: {"k": bytes(range(32)), "j": bytes(32)}.get(i)), key_id="k", checksum="crc32")
    texts = [bytes([i % 251]) * (i % 200) for i in range(1000)] + [bytes(3 * 64 * chacha.BLOCKS + 5)]
    frames = envelope.seal_all(texts, o)
    assert len(calls) == 1 and len({f[-16:] for f in frames}) == len(frames)
    bad = frames[5][:-1] + bytes([frames[5][-1] ^ 1])
    awkward = [None, b"", b"no frame", frames[7][:-1], bad, envelope.seal(b"plain", Options()), envelope.seal(b"gone", replace(o, keys=Keys(fixed=bytes(32)), key_id="x")), envelope.seal(b"other", replace(o, key_id="j"))]
    frames = awkward + frames
    calls.clear()
    opened = envelope.open_all(frames, o)
    assert len(calls) == 1 and [x is None for x in opened[: len(awkward)]] == [True] * 4 + [False, True, True, False]
    assert opened[4][0] is None

    def outcome(frame, **more):
        try:
            return envelope.undo(frame, o, **more)
        except FrameError as e:
            return e.error_class, str(e)

    assert [outcome(f, opened=x) for f, x in zip(frames[1:], opened[1:])] == [outcome(f) for f in frames[1:]]
    assert [envelope.undo(f, o, opened=x)[0] for f, x in zip(frames[len(awkward) :], opened[len(awkward) :])] == texts
    assert envelope.open_all([], o) == [] == envelope.seal_all([], o) and envelope.open_all(frames, Options()) == [None] * len(frames)
