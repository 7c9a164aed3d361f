"""The codec of one value: the specification that both back ends follow.

A compiled schema is a tree of codecs. ``write`` appends a value's bytes, ``read`` takes them and refuses any
spelling but the canonical one. The column expressions of ``wire`` and the whole-batch codecs of ``batch``
are faster forms for the common types; tests hold them to these bytes.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
import struct
import uuid
from typing import Any

from .errors import FormatError, LimitError, WireTypeError
from .limits import DEFAULT, MAX_INT, Budget, Limits

EPOCH_TICKS = 621_355_968_000_000_000
EPOCH_DAYS = 719_162
DAY_TICKS = 864_000_000_000
MAX_TICKS = 3_155_378_975_999_999_999
ZERO = dt.datetime(1970, 1, 1)
ZERO_UTC = ZERO.replace(tzinfo=dt.timezone.utc)
CONTEXT = decimal.Context(prec=60)


class Writer:
    """The bytes of one value so far, with its budget."""

    __slots__ = ("ancestors", "budget", "out", "refs")

    def __init__(self, limits: Limits = DEFAULT, references: bool = False):
        self.out = bytearray()
        self.budget = Budget(limits)
        self.refs = References() if references else None
        self.ancestors: list[int] = []

    def varint(self, n: int) -> None:
        if not 0 <= n <= MAX_INT:
            raise LimitError(f"{n} is no non-negative 32-bit number")
        while n > 127:
            self.out.append(n & 127 | 128)
            n >>= 7
        self.out.append(n)


class Reader:
    """A cursor over the bytes of one value."""

    __slots__ = ("budget", "data", "end", "pos", "refs", "trace")

    def __init__(self, data: bytes, limits: Limits = DEFAULT, references: bool = False, trace=None, pos: int = 0):
        self.data, self.pos, self.end = data, pos, len(data)
        self.budget = Budget(limits)
        self.refs = References() if references else None
        self.trace = trace

    def take(self, n: int) -> bytes:
        if n > self.end - self.pos:
            raise FormatError(f"{n} bytes wanted, {self.end - self.pos} left")
        self.pos += n
        return self.data[self.pos - n : self.pos]

    def varint(self) -> int:
        value = 0
        for k in range(5):
            if self.pos >= self.end:
                raise FormatError("the bytes end inside a number")
            b = self.data[self.pos]
            self.pos += 1
            value |= (b & 127) << (7 * k)
            if b < 128:
                if k and not b:
                    raise FormatError("a number is not in its shortest form")
                if value > MAX_INT:
                    raise FormatError("a number exceeds 32 bits")
                return value
        raise FormatError("a number is longer than five bytes")

    def boolean(self) -> bool:
        b = self.take(1)[0]
        if b > 1:
            raise FormatError(f"{b} is no boolean")
        return b == 1


class References:
    """Identities of one frame: ids rise over the whole frame, but are seen only along open scopes."""

    def __init__(self):
        self.next = 0
        self.scopes: list[dict] = [{}]

    def find(self, key):
        for s in reversed(self.scopes):
            if key in s:
                return s[key]
        return None

    def put(self, key, value) -> None:
        self.scopes[-1][key] = value


PENDING = object()


class Codec:
    """One type's codec. ``structural`` values count as nodes and can be shared."""

    structural = False
    name = "?"
    kind = "Scalar"
    #: What ``schema.compile_schema`` was given for this root: workers compile it again, once.
    recipe: tuple[str, str, bool] | None = None

    def __reduce__(self):
        from .schema import compiled

        return compiled, self.recipe

    def write(self, w: Writer, v: Any) -> None:
        raise NotImplementedError

    def read(self, r: Reader) -> Any:
        if r.trace is None:
            return self.take(r)
        r.trace.begin(self, r.pos)
        v = self.take(r)
        r.trace.end(r.pos, v)
        return v

    def take(self, r: Reader) -> Any:
        raise NotImplementedError


# ---------------------------------------------------------------- scalars


class Scalar(Codec):
    """A fixed or prefixed encoding without nodes. ``fold``: the encoding starts with a length that can carry null."""

    fold = False

    def __init__(self, name: str, put, get, fold: bool = False):
        self.name, self.put, self.get, self.fold = name, put, get, fold

    def write(self, w, v):
        if v is None:
            if not self.fold:
                raise WireTypeError(f"null in a non-nullable {self.name}")
            w.out.append(0)
            return
        try:
            self.put(w, v)
        except (struct.error, OverflowError, AttributeError, TypeError, ValueError) as e:
            raise WireTypeError(f"{v!r} is no {self.name}: {e}") from e

    def take(self, r):
        return self.get(r)


class Nullable(Codec):
    """A value type that may be null: flag, then the value."""

    def __init__(self, inner: Codec):
        self.inner, self.name, self.kind = inner, inner.name, inner.kind

    def write(self, w, v):
        if v is None:
            w.out.append(0)
        else:
            w.out.append(1)
            self.inner.write(w, v)

    def take(self, r):
        return self.inner.take(r) if r.boolean() else None


def _packed(name: str, form: str, convert=lambda v: v, back=lambda v: v) -> Scalar:
    s = struct.Struct("<" + form)

    def put(w, v):
        w.out += s.pack(convert(v))

    def get(r):
        return back(s.unpack(r.take(s.size))[0])

    return Scalar(name, put, get)


def _wide(name: str, size: int, signed: bool) -> Scalar:
    def put(w, v):
        w.out += int(v).to_bytes(size, "little", signed=signed)

    return Scalar(name, put, lambda r: int.from_bytes(r.take(size), "little", signed=signed))


def _text(name: str, check=None, to=str) -> Scalar:
    """UTF-8 behind its length + 1; 0 is null."""

    def put(w, v):
        b = to(v).encode("utf-8")
        if check:
            check(to(v), ValueError)
        w.budget.size(len(b), "max_string_bytes")
        w.varint(len(b) + 1)
        w.out += b

    def get(r):
        n = r.varint()
        if not n:
            return None
        r.budget.size(n - 1, "max_string_bytes")
        try:
            s = r.take(n - 1).decode("utf-8")
        except UnicodeDecodeError as e:
            raise FormatError(f"invalid UTF-8: {e.reason}") from e
        if check:
            check(s, FormatError)
        return s

    return Scalar(name, put, get, fold=True)


def _boolean() -> Scalar:
    return Scalar("Boolean", lambda w, v: w.out.append(1 if v else 0), Reader.boolean)


def _decimal() -> Scalar:
    def put(w, v):
        sign, digits, exponent = decimal.Decimal(v).as_tuple()
        if exponent > 0:
            digits, exponent = digits + (0,) * exponent, 0
        n = int("".join(map(str, digits)) or "0")
        if -exponent > 28 or n >= 1 << 96:
            raise ValueError("more than 96 bits or 28 places")
        w.out += struct.pack("<IIII", n & 0xFFFFFFFF, n >> 32 & 0xFFFFFFFF, n >> 64, -exponent << 16 | sign << 31)

    def get(r):
        lo, mid, hi, flags = struct.unpack("<IIII", r.take(16))
        scale = flags >> 16 & 255
        if flags & 0x7F00FFFF or scale > 28:
            raise FormatError("malformed decimal flags")
        n = decimal.Decimal(lo | mid << 32 | hi << 64).scaleb(-scale, CONTEXT)
        return n.copy_negate() if flags >> 31 else n

    return Scalar("Decimal", put, get)


def _char() -> Scalar:
    def put(w, v):
        b = v.encode("utf-16-le", "surrogatepass")
        if len(b) != 2:
            raise ValueError("not one UTF-16 unit")
        w.out += b

    return Scalar("Char", put, lambda r: r.take(2).decode("utf-16-le", "surrogatepass"))


def _rune() -> Scalar:
    def put(w, v):
        if len(v) != 1 or 0xD800 <= ord(v) <= 0xDFFF:
            raise ValueError("not one scalar value")
        w.out += struct.pack("<i", ord(v))

    def get(r):
        n = struct.unpack("<i", r.take(4))[0]
        if not 0 <= n <= 0x10FFFF or 0xD800 <= n <= 0xDFFF:
            raise FormatError(f"{n} is no scalar value")
        return chr(n)

    return Scalar("Rune", put, get)


def _bigint() -> Scalar:
    def put(w, v):
        v = int(v)
        n = max(1, (v.bit_length() if v >= 0 else (v + 1).bit_length()) // 8 + 1)
        w.budget.size(n, "max_byte_blob_bytes")
        w.varint(n)
        w.out += v.to_bytes(n, "little", signed=True)

    def get(r):
        n = r.budget.size(r.varint(), "max_byte_blob_bytes")
        b = r.take(n)
        if not n or n > 1 and (b[-1] == 0 and b[-2] < 128 or b[-1] == 255 and b[-2] >= 128):
            raise FormatError("a big integer is not in its shortest form")
        return int.from_bytes(b, "little", signed=True)

    return Scalar("BigInteger", put, get)


def _micros(v) -> int:
    d = v - (ZERO_UTC if v.tzinfo else ZERO)
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def _datetime(utc: bool) -> Scalar:
    """Ticks since year 1 with the kind in the top two bits: 0 for a wall clock, 1 for UTC, 2 for an instant in local time."""

    def put(w, v):
        ticks = _micros(v) * 10 + EPOCH_TICKS
        w.out += struct.pack("<q", ticks | (1 << 62 if utc else 0))

    def get(r):
        n = struct.unpack("<Q", r.take(8))[0]
        kind, ticks = n >> 62, n & (1 << 62) - 1
        if kind == 3 or ticks > MAX_TICKS:
            raise FormatError("malformed time")
        if ticks % 10:
            raise FormatError("a time has parts of a microsecond")
        at = ZERO + dt.timedelta(microseconds=(ticks - EPOCH_TICKS) // 10)
        return at.replace(tzinfo=dt.timezone.utc) if utc else at

    return Scalar("DateTime", put, get)


def _ticks(name: str, limit: int | None = None) -> Scalar:
    """A count of 100 ns ticks, as a number or a time interval."""

    def put(w, v):
        if isinstance(v, dt.timedelta):
            v = ((v.days * 86400 + v.seconds) * 1_000_000 + v.microseconds) * 10
        elif isinstance(v, dt.time):
            v = ((v.hour * 3600 + v.minute * 60 + v.second) * 1_000_000 + v.microsecond) * 10
        if limit is not None and not 0 <= v < limit:
            raise ValueError("out of range")
        w.out += struct.pack("<q", v)

    def get(r):
        n = struct.unpack("<q", r.take(8))[0]
        if limit is not None and not 0 <= n < limit:
            raise FormatError(f"{n} ticks are out of range")
        return n

    return Scalar(name, put, get)


def _interval() -> Scalar:
    ticks = _ticks("TimeSpan")

    def get(r):
        n = ticks.get(r)
        if n % 10:
            raise FormatError("an interval has parts of a microsecond")
        return dt.timedelta(microseconds=n // 10)

    return Scalar("TimeSpan", ticks.put, get)


def _offset() -> Scalar:
    """Clock ticks and offset ticks, as a struct of the two."""

    def check(clock, offset, error):
        if not 0 <= clock <= MAX_TICKS or abs(offset) > 14 * 36_000_000_000 or offset % 600_000_000 or not 0 <= clock - offset <= MAX_TICKS:
            raise error("time or offset out of range")

    def put(w, v):
        check(v["ticks"], v["offset_ticks"], ValueError)
        w.out += struct.pack("<qq", v["ticks"], v["offset_ticks"])

    def get(r):
        clock, offset = struct.unpack("<qq", r.take(16))
        check(clock, offset, FormatError)
        return {"ticks": clock, "offset_ticks": offset}

    return Scalar("DateTimeOffset", put, get)


def _date() -> Scalar:
    def put(w, v):
        w.out += struct.pack("<i", v.toordinal() - 1)

    def get(r):
        n = struct.unpack("<i", r.take(4))[0]
        if not 0 <= n <= 3_652_058:
            raise FormatError(f"day {n} is out of range")
        return dt.date.fromordinal(n + 1)

    return Scalar("DateOnly", put, get)


def _guid() -> Scalar:
    return Scalar("Guid", lambda w, v: w.out.extend(uuid.UUID(v).bytes_le), lambda r: str(uuid.UUID(bytes_le=r.take(16))))


def _floats(name: str, n: int, form: str, fields: tuple[str, ...] | None = None) -> Scalar:
    """``n`` floats, as an array or, with ``fields``, as a struct."""
    s = struct.Struct(f"<{n}{form}")

    def put(w, v):
        w.out += s.pack(*([v[f] for f in fields] if fields else v))

    def get(r):
        x = s.unpack(r.take(s.size))
        return dict(zip(fields, x)) if fields else list(x)

    return Scalar(name, put, get)


def _bits() -> Scalar:
    """The number of bits + 1, the number of bytes, the bytes; the lowest bit first, spare bits 0."""

    def put(w, v):
        w.budget.size(len(v), "max_array_length") if len(v) > w.budget.limits.max_byte_blob_bytes * 8 else None
        w.varint(len(v) + 1)
        w.varint(-(-len(v) // 8))
        w.out += sum(1 << i for i, b in enumerate(v) if b).to_bytes(-(-len(v) // 8), "little")

    def get(r):
        n = r.varint()
        if not n:
            return None
        n -= 1
        size = r.budget.size(r.varint(), "max_byte_blob_bytes")
        if size != -(-n // 8):
            raise FormatError("bit and byte counts differ")
        x = int.from_bytes(r.take(size), "little")
        if x >> n:
            raise FormatError("spare bits are set")
        return [x >> i & 1 == 1 for i in range(n)]

    return Scalar("BitArray", put, get, fold=True)


def _check(pattern: str, what: str):
    p = re.compile(pattern)

    def check(s, error):
        if not p.fullmatch(s):
            raise error(f"{s!r} is no canonical {what}")

    return check


def _version_check(s, error):
    parts = s.split(".")
    if not 2 <= len(parts) <= 4 or not all(p.isascii() and p.isdigit() and str(int(p)) == p and int(p) <= MAX_INT for p in parts):
        raise error(f"{s!r} is no canonical version")


FIELDS = {"complex": ("re", "im"), "offset": ("ticks", "offset_ticks")}
#: Wire names that a field's metadata may choose, and what makes their codecs. The type names, which dumps show.
SCALARS = {
    "bool": _boolean,
    "i8": lambda: _packed("SByte", "b"), "i16": lambda: _packed("Int16", "h"), "i32": lambda: _packed("Int32", "i"), "i64": lambda: _packed("Int64", "q"),
    "u8": lambda: _packed("Byte", "B"), "u16": lambda: _packed("UInt16", "H"), "u32": lambda: _packed("UInt32", "I"), "u64": lambda: _packed("UInt64", "Q", int),
    "f16": lambda: _packed("Half", "e"), "f32": lambda: _packed("Single", "f"), "f64": lambda: _packed("Double", "d"),
    "decimal": _decimal, "char": _char, "string": lambda: _text("String"), "rune": _rune, "bigint": _bigint,
    "i128": lambda: _wide("Int128", 16, True), "u128": lambda: _wide("UInt128", 16, False),
    "iptr": lambda: _packed("IntPtr", "q"), "uptr": lambda: _packed("UIntPtr", "Q", int),
    "datetime": lambda: _datetime(False), "instant": lambda: _datetime(True), "offset": _offset,
    "timespan": _interval, "ticks": lambda: _ticks("TimeSpan"), "date": _date, "time": lambda: _ticks("TimeOnly", DAY_TICKS),
    "timezone": lambda: _text("TimeZoneInfo"), "guid": _guid, "uri": lambda: _text("Uri", _check(r"(?s).+", "uri")), "version": lambda: _text("Version", _version_check),
    "builder": lambda: _text("StringBuilder"), "culture": lambda: _text("CultureInfo", _check(r"|[a-z]{2,3}(-[A-Z][a-z]{3})?(-([A-Z]{2}|\d{3}))?", "culture name")), "bits": _bits,
    "complex": lambda: _floats("Complex", 2, "d", FIELDS["complex"]), "vector2": lambda: _floats("Vector2", 2, "f"), "vector3": lambda: _floats("Vector3", 3, "f"),
    "vector4": lambda: _floats("Vector4", 4, "f"), "quaternion": lambda: _floats("Quaternion", 4, "f"), "plane": lambda: _floats("Plane", 4, "f"),
    "matrix3x2": lambda: _floats("Matrix3x2", 6, "f"), "matrix4x4": lambda: _floats("Matrix4x4", 16, "f"),
}


class Enum(Codec):
    """An integer of its base's width; names, where given, are only for dumps."""

    def __init__(self, base: str, names: dict[int, str], name: str = "Enum"):
        self.base, self.names, self.name = SCALARS[base](), names, name

    def write(self, w, v):
        self.base.write(w, v)

    def take(self, r):
        return self.base.take(r)


# ---------------------------------------------------------------- structures


class Structural(Codec):
    """A value that can be null, shared and nested. ``value_type``: never null or shared."""

    structural = True
    value_type = False
    #: Null is the value 0 of the first number, which is then written one higher.
    folds = True
    #: Exists before its children are read, so that a cycle can close in it.
    early = False
    #: Fields that say which object a row's struct is; without them an object is itself alone.
    identity: tuple[str, ...] = ()

    def key_of(self, v):
        return (self.name, *(identity(v[f]) for f in self.identity)) if self.identity else id(v)

    def write(self, w, v):
        folded = False
        if not self.value_type:
            if w.refs is not None:
                if v is None:
                    w.out.append(0)
                    return
                known = w.refs.find(self.key_of(v))
                if known is not None:
                    w.varint((known[0] << 1 | 1) + 1)
                    return
                n = w.refs.next
                w.refs.next += 1
                w.refs.put(self.key_of(v), (n, v))
                w.varint((n << 1) + 1)
            elif v is None:
                w.out.append(0)
                return
            elif self.folds:
                folded = True
            else:
                w.out.append(1)
        elif v is None:
            raise WireTypeError(f"null in a non-nullable {self.name}")
        w.budget.enter()
        track = w.refs is None and not self.value_type
        if track:
            if id(v) in w.ancestors and isinstance(v, (list, dict)):
                raise WireTypeError("a cycle needs references")
            w.ancestors.append(id(v))
        self.put(w, v, folded)
        if track:
            w.ancestors.pop()
        w.budget.leave()

    def take(self, r):
        ref, folded = -1, False
        if not self.value_type:
            if r.refs is not None:
                n = r.varint()
                if not n:
                    return None
                ref, back = (n - 1) >> 1, (n - 1) & 1
                if r.trace is not None:
                    r.trace.reference(ref, back == 1)
                if back:
                    return self._resolve(r, ref)
                if r.refs.find(ref) is not None:
                    raise FormatError(f"object id {ref} is declared twice")
                r.refs.put(ref, (PENDING, None))
            elif self.folds:
                if r.pos < r.end and r.data[r.pos] == 0:
                    r.pos += 1
                    return None
                folded = True
            elif not r.boolean():
                return None
        r.budget.enter()
        v = self.get(r, folded, ref)
        if ref >= 0:
            r.refs.put(ref, (v, self))
        r.budget.leave()
        return v

    def _resolve(self, r, ref):
        found = r.refs.find(ref)
        if found is None:
            raise FormatError(f"object id {ref} is not known here")
        if found[0] is PENDING:
            raise FormatError(f"object id {ref} is still being built")
        if found[1].name != self.name:
            raise FormatError(f"object id {ref} is a {found[1].name}, not a {self.name}")
        return found[0]

    def register(self, r, ref, v) -> None:
        if ref >= 0 and self.early:
            r.refs.put(ref, (v, self))

    def put(self, w, v, folded: bool) -> None:
        raise NotImplementedError

    def get(self, r, folded: bool, ref: int):
        raise NotImplementedError

    @staticmethod
    def first(r, folded: bool) -> int:
        """The first number of the shape, without the fold."""
        return r.varint() - (1 if folded else 0)


#: Sequence kinds of one name or another, all a count and elements. distinct: repeats are malformed; sorted: in
#: order when read; reversed: written backwards, so that iteration order survives. The type names, which dumps show.
SEQUENCES = {
    "array": ("{}[]", "array"), "memory": ("Memory<{}>", "array"), "readonly_memory": ("ReadOnlyMemory<{}>", "array"), "segment": ("ArraySegment<{}>", "array"), "immutable_array": ("ImmutableArray<{}>", "array"),
    "list": ("List<{}>", ""), "ilist": ("IList<{}>", ""), "set": ("HashSet<{}>", "distinct"), "iset": ("ISet<{}>", "distinct"), "sorted_set": ("SortedSet<{}>", "distinct sorted"), "linked_list": ("LinkedList<{}>", ""),
    "observable": ("ObservableCollection<{}>", ""), "stack": ("Stack<{}>", "reversed"), "queue": ("Queue<{}>", ""), "bag": ("ConcurrentBag<{}>", ""), "concurrent_queue": ("ConcurrentQueue<{}>", ""),
    "concurrent_stack": ("ConcurrentStack<{}>", "reversed"), "readonly_observable": ("ReadOnlyObservableCollection<{}>", ""), "readonly_list": ("ReadOnlyCollection<{}>", ""), "sequence": ("ReadOnlySequence<{}>", ""),
    "custom": ("Collection<{}>", ""), "immutable_list": ("ImmutableList<{}>", ""), "iimmutable_list": ("IImmutableList<{}>", ""), "immutable_set": ("ImmutableHashSet<{}>", "distinct"), "iimmutable_set": ("IImmutableSet<{}>", "distinct"),
    "immutable_sorted_set": ("ImmutableSortedSet<{}>", "distinct sorted"), "immutable_queue": ("ImmutableQueue<{}>", ""), "immutable_stack": ("ImmutableStack<{}>", "reversed"), "frozen_set": ("FrozenSet<{}>", "distinct"),
}
#: Map kinds. sorted: entries in key order. The type names, which dumps show.
MAPS = {
    "dictionary": ("Dictionary<{}, {}>", ""), "idictionary": ("IDictionary<{}, {}>", ""), "sorted_dictionary": ("SortedDictionary<{}, {}>", "sorted"), "sorted_list": ("SortedList<{}, {}>", "sorted"), "concurrent_dictionary": ("ConcurrentDictionary<{}, {}>", ""),
    "readonly_dictionary": ("ReadOnlyDictionary<{}, {}>", ""), "frozen_dictionary": ("FrozenDictionary<{}, {}>", ""), "immutable_dictionary": ("ImmutableDictionary<{}, {}>", ""), "iimmutable_dictionary": ("IImmutableDictionary<{}, {}>", ""),
    "immutable_sorted_dictionary": ("ImmutableSortedDictionary<{}, {}>", "sorted"),
}
EARLY = {"list", "ilist", "set", "iset", "sorted_set", "linked_list", "observable", "queue", "custom", "dictionary", "idictionary", "sorted_dictionary", "sorted_list", "concurrent_dictionary"}


def identity(v):
    """A value as a key: equal values, and only those, have equal keys."""
    if isinstance(v, dict):
        return tuple((k, identity(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(map(identity, v))
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


class Sequence(Structural):
    kind = "Sequence"

    def __init__(self, element: Codec, kind: str = "list"):
        label, rules = SEQUENCES[kind]
        self.element, self.which, self.name = element, kind, label.format(element.name)
        self.distinct, self.sorted, self.reversed = "distinct" in rules, "sorted" in rules, "reversed" in rules
        self.limit = "max_array_length" if "array" in rules else "max_collection_length"
        self.early = kind in EARLY
        self.bytes = element.name == "Byte" and isinstance(element, Scalar)

    def put(self, w, v, folded):
        n = w.budget.count(len(v), self.limit)
        w.varint(n + 1 if folded else n)
        if self.bytes and isinstance(v, (bytes, bytearray)):
            w.out += v
            return
        if self.distinct and len({identity(x) for x in v}) < n:
            raise WireTypeError(f"a {self.name} holds an element twice")
        if self.sorted:
            v = sorted(v)
        for x in reversed(v) if self.reversed else v:
            self.element.write(w, x)

    def get(self, r, folded, ref):
        n = r.budget.count(self.first(r, folded), self.limit)
        if r.trace is not None:
            r.trace.items(n)
        if self.bytes and r.trace is None:
            return r.take(n)
        out: list = []
        self.register(r, ref, out)
        seen: set = set()
        for i in range(n):
            if r.trace is not None:
                r.trace.label(f"[{i}]")
            x = self.element.read(r)
            if self.distinct:
                k = identity(x)
                if k in seen:
                    raise FormatError(f"a {self.name} holds an element twice")
                seen.add(k)
            out.append(x)
        if self.sorted:
            out.sort()
        elif self.reversed:
            out.reverse()
        return out


class Map(Structural):
    kind = "Map"

    def __init__(self, key: Codec, value: Codec, kind: str = "dictionary"):
        label, rules = MAPS[kind]
        self.key, self.value, self.which, self.name = key, value, kind, label.format(key.name, value.name)
        self.sorted, self.early = "sorted" in rules, kind in EARLY

    def put(self, w, v, folded):
        entries = list(v.items()) if isinstance(v, dict) else [tuple(e) for e in v]
        n = w.budget.count(len(entries), "max_dictionary_entries")
        w.varint(n + 1 if folded else n)
        if len({identity(k) for k, _ in entries}) < n or any(k is None for k, _ in entries):
            raise WireTypeError("a map has a null or repeated key")
        if self.sorted:
            entries.sort(key=lambda e: e[0])
        for k, x in entries:
            self.key.write(w, k)
            self.value.write(w, x)

    def get(self, r, folded, ref):
        n = r.budget.count(self.first(r, folded), "max_dictionary_entries")
        if r.trace is not None:
            r.trace.items(n)
        out: list = []
        self.register(r, ref, out)
        seen: set = set()
        for i in range(n):
            if r.trace is not None:
                r.trace.label(f"key {i}")
            k = self.key.read(r)
            if k is None or identity(k) in seen:
                raise FormatError("a map has a null or repeated key")
            seen.add(identity(k))
            if r.trace is not None:
                r.trace.label("{" + render(k) + "}")
            out.append((k, self.value.read(r)))
        if self.sorted:
            out.sort(key=lambda e: e[0])
        return out


class Queue(Structural):
    """A priority queue: element and priority in turn, repeats allowed, in priority order when read."""

    kind = "Map"

    def __init__(self, element: Codec, priority: Codec, names: tuple[str, str]):
        self.element, self.priority, self.names, self.name = element, priority, names, f"PriorityQueue<{element.name}, {priority.name}>"

    def put(self, w, v, folded):
        n = w.budget.count(len(v), "max_collection_length")
        w.varint(n + 1 if folded else n)
        for x in v:
            self.element.write(w, x[self.names[0]])
            self.priority.write(w, x[self.names[1]])

    def get(self, r, folded, ref):
        n = r.budget.count(self.first(r, folded), "max_collection_length")
        if r.trace is not None:
            r.trace.items(n)
        out = []
        for i in range(n):
            if r.trace is not None:
                r.trace.label(f"[{i}]")
            x = self.element.read(r)
            if r.trace is not None:
                r.trace.label(f"priority {i}")
            out.append(dict(zip(self.names, (x, self.priority.read(r)))))
        out.sort(key=lambda x: x[self.names[1]])
        return out


class Grid(Structural):
    """An array of rank above one: rank + 1, the lengths, the elements row by row."""

    kind = "Sequence"

    def __init__(self, element: Codec, rank: int | None):
        self.element, self.rank, self.name = element, rank, f"{element.name}[{',' * ((rank or 2) - 1)}]"

    def put(self, w, v, folded):
        dims, data = v["dims"], v["data"]
        if math.prod(dims) != len(data) or len(dims) < 2 or self.rank not in (None, len(dims)):
            raise WireTypeError("the lengths don't multiply to the elements")
        for d in dims:
            w.budget.size(d, "max_array_length")
        w.budget.count(len(data), "max_array_length")
        w.varint(len(dims) + (1 if folded else 0))
        for d in dims:
            w.varint(d)
        for x in data:
            self.element.write(w, x)

    def get(self, r, folded, ref):
        rank = self.first(r, folded)
        if rank < 2 or rank > 32 or self.rank not in (None, rank):
            raise FormatError(f"rank {rank} doesn't fit")
        dims = [r.budget.size(r.varint(), "max_array_length") for _ in range(rank)]
        n = r.budget.count(math.prod(dims), "max_array_length")
        if r.trace is not None:
            r.trace.items(n)
        out = []
        for i in range(n):
            if r.trace is not None:
                r.trace.label(f"[{i}]")
            out.append(self.element.read(r))
        return {"dims": dims, "data": out}


class Member:
    __slots__ = ("codec", "key", "name")

    def __init__(self, name: str, codec: Codec, key: int | None = None):
        self.name, self.codec, self.key = name, codec, key


class Object(Structural):
    """Members in order; keyed: a count, then key, length and bytes of each field."""

    kind = "Object"
    early = True

    def __init__(self, name: str, members: list[Member], keyed: bool = False, value_type: bool = False):
        self.name, self.members, self.keyed, self.value_type = name, members, keyed, value_type
        self.folds = keyed
        self.by_key = {m.key: m for m in members}
        if keyed:
            self.kind = "KeyedObject"

    def put(self, w, v, folded):
        if not self.keyed:
            for m in self.members:
                m.codec.write(w, v[m.name])
            return
        n = w.budget.fields(len(self.members))
        w.varint(n + 1 if folded else n)
        for m in self.members:
            w.varint(m.key)
            at = len(w.out)
            w.out += bytes(4)
            if w.refs is not None:
                w.refs.scopes.append({})
            m.codec.write(w, v[m.name])
            if w.refs is not None:
                w.refs.scopes.pop()
            w.out[at : at + 4] = struct.pack("<i", len(w.out) - at - 4)

    def get(self, r, folded, ref):
        out: dict = {}
        self.register(r, ref, out)
        if not self.keyed:
            if r.trace is not None:
                r.trace.items(len(self.members))
            for m in self.members:
                if r.trace is not None:
                    r.trace.label(m.name)
                out[m.name] = m.codec.read(r)
            return out
        n = r.budget.fields(self.first(r, folded))
        if r.trace is not None:
            r.trace.items(n)
        for m in self.members:
            out[m.name] = None
        found, before = set(), -1
        for _ in range(n):
            start = r.pos
            key = r.varint()
            if key <= before:
                raise FormatError(f"field key {key} follows key {before}")
            before = key
            size = r.budget.size(struct.unpack("<i", r.take(4))[0], "max_payload_bytes")
            if size > r.end - r.pos:
                raise FormatError(f"field {key} has {size} bytes, {r.end - r.pos} are left")
            m = self.by_key.get(key)
            stop, end = r.pos + size, r.end
            if r.trace is not None:
                r.trace.field(m.name if m else None, key, start, stop - start)
            if m is None:
                r.pos = stop
            else:
                r.end = stop
                if r.refs is not None:
                    r.refs.scopes.append({})
                if r.trace is not None:
                    r.trace.label("value")
                out[m.name] = m.codec.read(r)
                found.add(m.name)
                if r.refs is not None:
                    r.refs.scopes.pop()
                if r.pos != stop:
                    raise FormatError(f"field {key} has {stop - r.pos} bytes left over")
                r.end = end
            if r.trace is not None:
                r.trace.end(r.pos, None)
        out[FOUND] = found
        return out


#: Under this name a keyed object tells which of its fields were there.
FOUND = "\x00found"


class Union(Structural):
    """A closed set of arms by tag: flag, tag, the arm's members. In Spark: a struct whose one non-null field is the arm."""

    kind = "Union"
    folds = False
    early = False

    def __init__(self, name: str, arms: dict[int, tuple[str, Object]]):
        self.name, self.arms = name, arms

    def put(self, w, v, folded):
        here = [t for t, (n, _) in self.arms.items() if v.get(n) is not None]
        if len(here) != 1:
            raise WireTypeError(f"{len(here)} arms of {self.name} are set, not one")
        w.out.append(here[0])
        name, arm = self.arms[here[0]]
        arm.put(w, v[name], False)

    def get(self, r, folded, ref):
        tag = r.take(1)[0]
        if tag not in self.arms:
            raise WireTypeError(f"tag {tag} is not declared for {self.name}")
        name, arm = self.arms[tag]
        if r.trace is not None:
            r.trace.tag(tag, arm)
        out: dict = {n: None for n, _ in self.arms.values()}
        out[name] = arm.get(r, False, -1)
        return out


class Composite(Structural):
    """Fixed children: pairs and tuples. A reference tuple has a flag; value tuples and pairs don't."""

    kind = "Composite"
    folds = False

    def __init__(self, name: str, members: list[Member], value_type: bool):
        self.name, self.members, self.value_type = name, members, value_type

    def put(self, w, v, folded):
        for m in self.members:
            m.codec.write(w, v[m.name])

    def get(self, r, folded, ref):
        if r.trace is not None:
            r.trace.items(len(self.members))
        out = {}
        for m in self.members:
            if r.trace is not None:
                r.trace.label(m.name)
            out[m.name] = m.codec.read(r)
        return out


def render(v: Any) -> str:
    """A scalar for people: the same text everywhere."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    if isinstance(v, float):
        return repr(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)
    if isinstance(v, (bytes, bytearray)):
        return v.hex().upper()
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def encode(codec: Codec, v: Any, limits: Limits = DEFAULT, references: bool = False) -> bytes:
    w = Writer(limits, references)
    codec.write(w, v)
    w.budget.size(len(w.out), "max_payload_bytes")
    return bytes(w.out)


def decode(codec: Codec, data: bytes, limits: Limits = DEFAULT, references: bool = False, trace=None) -> Any:
    """Exactly one value."""
    if not data:
        raise FormatError("no bytes")
    r = Reader(data, limits, references, trace)
    try:
        v = codec.read(r)
    except RecursionError as e:
        raise LimitError("nesting exceeds the stack") from e
    if r.pos != r.end:
        raise FormatError(f"{r.end - r.pos} bytes left over")
    return v
