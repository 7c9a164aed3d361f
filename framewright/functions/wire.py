"""Wire encodings as column expressions: they run in the JVM, inside generated code, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codec import EPOCH_DAYS, EPOCH_TICKS
from .errors import WireTypeError


def _swapped(n: Column) -> Column:
    """A long with its bytes in the other order."""
    pair, quad = F.lit(0x00FF00FF00FF00FF), F.lit(0x0000FFFF0000FFFF)
    n = F.shiftrightunsigned(n, 8).bitwiseAND(pair).bitwiseOR(F.shiftleft(n.bitwiseAND(pair), 8))
    n = F.shiftrightunsigned(n, 16).bitwiseAND(quad).bitwiseOR(F.shiftleft(n.bitwiseAND(quad), 16))
    return F.shiftrightunsigned(n, 32).bitwiseOR(F.shiftleft(n, 32))


def little_hex(n: Column, size: int) -> Column:
    """Hex of the lowest ``size`` bytes of a whole number, lowest first."""
    n = n.cast("bigint")
    if size == 1:
        return F.lpad(F.hex(n.bitwiseAND(F.lit(255))), 2, "0")
    swapped = _swapped(n)
    return F.lpad(F.hex(swapped if size == 8 else F.shiftrightunsigned(swapped, 64 - 8 * size)), 2 * size, "0")


def little(n: Column, size: int) -> Column:
    """The lowest ``size`` bytes of a whole number, lowest first."""
    return F.unhex(little_hex(n, size))


def number(b: Column, size: int, at: int | Column = 1, signed: bool = True) -> Column:
    """A whole number from ``size`` bytes, lowest first, at a place counted from 1."""
    part = F.substring(b, at if isinstance(at, int) else at, size) if isinstance(at, int) else b.substr(at, F.lit(size))
    h = F.hex(part)
    big = F.concat(*[F.substring(h, 2 * k - 1, 2) for k in range(size, 0, -1)])
    if size < 8:
        n = F.conv(big, 16, 10).cast("bigint")
        return F.when(n >= 1 << (8 * size - 1), n - (1 << 8 * size)).otherwise(n) if signed else n
    high, low = (F.conv(F.substring(big, k, 8), 16, 10).cast("bigint") for k in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def varint_hex(n: Column) -> Column:
    n = n.cast("bigint")
    byte = lambda k, more: F.lpad(F.hex(F.shiftright(n, 7 * k).bitwiseAND(F.lit(127)).bitwiseOR(F.lit(128 if more else 0))), 2, "0")
    forms = [F.concat(*[byte(k, k < size - 1) for k in range(size)]) for size in range(1, 6)]
    out = forms[4]
    for size in range(4, 0, -1):
        out = F.when(n < 1 << 7 * size, forms[size - 1]).otherwise(out)
    return out


def varint(n: Column) -> Column:
    """A non-negative number in groups of seven bits."""
    return F.unhex(varint_hex(n))


def varint_size(n: Column) -> Column:
    out = F.lit(5)
    for size in range(4, 0, -1):
        out = F.when(n < 1 << 7 * size, size).otherwise(out)
    return out


def text_hex(s: Column) -> Column:
    return F.coalesce(F.concat(varint_hex(F.octet_length(s) + 1), F.hex(s)), F.lit("00"))


def text(s: Column) -> Column:
    """UTF-8 behind its length + 1; null is one zero."""
    return F.unhex(text_hex(s))


def scalar_hex(c: Column, kind: T.DataType) -> Column:
    """Hex of a value that isn't null, for the types that have an expression."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, "01").otherwise("00")
    for t, size in ((T.ByteType, 1), (T.ShortType, 2), (T.IntegerType, 4), (T.LongType, 8)):
        if isinstance(kind, t):
            return little_hex(c, size)
    if isinstance(kind, T.StringType):
        return text_hex(c)
    if isinstance(kind, T.DateType):
        return little_hex(F.unix_date(c) + EPOCH_DAYS, 4)
    if isinstance(kind, T.TimestampNTZType):
        # A wall clock's microseconds, without the session's time zone.
        days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
        of_day = (F.hour(c) * 3600 + F.minute(c) * 60).cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
        return little_hex((days * 86_400_000_000 + of_day) * 10 + EPOCH_TICKS, 8)
    if isinstance(kind, T.TimestampType):
        return little_hex((F.unix_micros(c) * 10 + EPOCH_TICKS).bitwiseOR(F.lit(1 << 62)), 8)
    raise WireTypeError(f"{kind.simpleString()} has no expression")


def supports(schema: T.StructType) -> bool:
    """Whether a flat schema can be written by expressions alone."""
    kinds = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.DateType, T.TimestampNTZType, T.TimestampType)
    return all(isinstance(f.dataType, kinds) and not f.metadata for f in schema.fields)


def payload(columns: dict[str, Column], schema: T.StructType, class_type: bool = True) -> Column:
    """A flat positional payload as one expression."""
    from .schema import members

    parts = [F.lit("01")] if class_type else []
    for f, _ in members(schema, {}):
        c = columns[f.name]
        body = scalar_hex(c, f.dataType)
        parts.append(F.when(c.isNull(), "00").otherwise(F.concat(F.lit("01"), body)) if f.nullable and not isinstance(f.dataType, T.StringType) else body)
    return F.unhex(F.concat(*parts))


def frame(payload: Column) -> Column:
    """A frame without services around a payload."""
    return F.concat(F.unhex(F.lit("42534552010000")), varint(F.octet_length(payload)), payload)


def frame_size(payload_size: Column) -> Column:
    return payload_size + varint_size(payload_size) + 7
