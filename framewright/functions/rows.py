"""Between Arrow columns and the codec's values."""

from __future__ import annotations

import datetime as dt
from typing import Any

import numpy as np
import pyarrow as pa

from . import batch
from .codec import FOUND, Codec, Composite, Enum, Grid, Map, Nullable, Object, Queue, Sequence, Union, decode, encode
from .errors import FrameError
from .limits import Limits

MAX_DEPTH_BATCH = 32


def encode_column(codec: Codec, a: pa.Array, limits: Limits, references: bool = False) -> pa.Array:
    """Payloads of a column of values."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    if not references and limits.max_depth >= MAX_DEPTH_BATCH:
        try:
            return batch.encode(codec, a, limits)
        except batch.Unsupported:
            pass
    return pa.array([encode(codec, v, limits, references) for v in a.to_pylist(maps_as_pydicts=None)], pa.binary())


def to_spark(codec: Codec, v: Any, kind: pa.DataType) -> Any:
    """A decoded value in the form that Arrow wants for ``kind``."""
    if v is None:
        return None
    if isinstance(codec, Nullable):
        return to_spark(codec.inner, v, kind)
    if isinstance(codec, (Object, Composite)):
        kinds = {kind.field(i).name: kind.field(i).type for i in range(kind.num_fields)}
        return {m.name: to_spark(m.codec, v[m.name], kinds[m.name]) for m in codec.members if m.name in kinds}
    if isinstance(codec, Union):
        kinds = {kind.field(i).name: kind.field(i).type for i in range(kind.num_fields)}
        return {n: to_spark(arm, v[n], kinds[n]) for n, arm in codec.arms.values()}
    if isinstance(codec, Sequence):
        if isinstance(v, (bytes, bytearray)):
            return bytes(v)
        return [to_spark(codec.element, x, kind.value_type) for x in v]
    if isinstance(codec, Map):
        return [(to_spark(codec.key, k, kind.key_type), to_spark(codec.value, x, kind.item_type)) for k, x in v]
    if isinstance(codec, Queue):
        e = kind.value_type
        return [{n: to_spark(c, x[n], e.field(n).type) for n, c in zip(codec.names, (codec.element, codec.priority))} for x in v]
    if isinstance(codec, Grid):
        return v
    if isinstance(codec, Enum):
        return v
    if pa.types.is_decimal(kind):
        import decimal

        return decimal.Decimal(v)
    if pa.types.is_time(kind):
        return (dt.datetime.min + dt.timedelta(microseconds=v // 10)).time()
    return v


class Decoded:
    """Values, the keyed root's fields that were there, and the errors of a column of payloads."""

    def __init__(self, codec: Codec, payloads: list[bytes | None] | pa.Array, kind: pa.DataType, limits: Limits, references: list[bool] | None = None, want_found: bool = True):
        a = payloads if isinstance(payloads, pa.Array) else pa.array(payloads, pa.binary())
        self.errors: list[FrameError | None] = [None] * len(a)
        self.found: list[list[str] | None] = [None] * len(a)
        self.kind, keyed = kind, want_found and isinstance(codec, Object) and codec.keyed
        done = None
        if not (references and any(references)) and not keyed and limits.max_depth >= MAX_DEPTH_BATCH and _small(a, limits):
            try:
                done, judge = batch.decode(codec, a, kind, limits)
            except batch.Unsupported:
                done = None
        rows = range(len(a)) if done is None else np.flatnonzero(judge).tolist()
        values: dict[int, Any] = {}
        for i in rows:
            data = a[i].as_py()
            if data is None:
                values[i] = None
                continue
            try:
                v = decode(codec, data, limits, bool(references and references[i]))
                if keyed and v is not None:
                    self.found[i] = sorted(v[FOUND])
                values[i] = to_spark(codec, v, kind)
            except FrameError as e:
                self.errors[i] = e
                values[i] = None
        if done is None:
            self.values = pa.array([values[i] for i in range(len(a))], kind)
        elif values:
            judged = pa.array(list(values.values()), kind)
            place = np.arange(len(a))
            place[list(values)] = len(a) + np.arange(len(values))
            self.values = pa.concat_arrays([done, judged]).take(pa.array(place))
        else:
            self.values = done


def _small(a: pa.Array, limits: Limits) -> bool:
    """Whether no row is large enough to meet a cumulative budget."""
    longest = int(batch._binary(a).size.max()) if len(a) else 0
    return longest <= min(limits.max_payload_bytes, limits.max_total_elements, limits.max_object_graph_nodes)
