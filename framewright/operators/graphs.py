"""Shared and cyclic objects: node tables become one frame a graph, and back.

Rows have no identity, so a graph is a table of (graph_id, node_id, fields, links), a link being another node's id. A frame keeps
identity by reference frames: the first occurrence of a node, then back references to it.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions import envelope as E
from framewright.functions.codec import FOUND, Member, Object, decode, encode
from framewright.functions.errors import WireTypeError
from framewright.functions.options import Options
from framewright.functions.schema import build, ordinal
from framewright.functions.ship import ship

from .frames import PARTS, finish, opened


def node_codec(fields: T.StructType, links: list[str], name: str = "Node") -> Object:
    """A class whose links are of its own type."""
    codec = Object(name, [])
    parts = [Member(f.name, build(f.dataType, f.nullable, f.metadata or {})) for f in fields.fields] + [Member(k, codec) for k in links]
    codec.members = sorted(parts, key=lambda m: ordinal(m.name))
    return codec


def link(rows: list[dict], links: list[str]) -> dict[Any, dict]:
    """Node rows as objects that hold each other."""
    at = {r["node_id"]: {k: v for k, v in r.items() if k not in ("graph_id", "node_id")} for r in rows}
    if len(at) < len(rows):
        raise WireTypeError("a graph has a node twice")
    for v in at.values():
        for k in links:
            if v[k] is not None:
                if v[k] not in at:
                    raise WireTypeError(f"node {v[k]} is linked to and isn't there")
                v[k] = at[v[k]]
    return at


def unlink(root: dict | None, links: list[str]) -> list[dict]:
    """Objects as node rows, numbered in the order met from the root."""
    if root is None:
        return []
    number, todo, out = {id(root): 0}, [root], []
    while todo:
        v = todo.pop(0)
        row = {"node_id": number[id(v)]} | {k: x for k, x in v.items() if k not in links and k != FOUND}
        for k in links:
            if v[k] is not None and id(v[k]) not in number:
                number[id(v[k])] = len(number)
                todo.append(v[k])
            row[k] = None if v[k] is None else number[id(v[k])]
        out.append(row)
    return out


def encode_graphs(nodes: DataFrame, fields: T.StructType, links: list[str], options: Options | None = None, name: str = "Node") -> DataFrame:
    """graph_id, frame: a frame of each graph, from its node of the least id. A graph is one frame, so max_object_graph_nodes bounds it."""
    ship(nodes.sparkSession)
    o = options or Options(references=True)
    by_jvm = o.encryption == "aes256gcm"

    def run(pdf):
        import pandas as pd

        at = link([{k: None if pd.isna(v) else v for k, v in r.items()} for r in pdf.to_dict("records")], links)
        for v in at.values():
            for f in fields.fields:
                if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)) and v[f.name] is not None:
                    v[f.name] = int(v[f.name])
        payload = encode(node_codec(fields, links, name), at[min(at)], o.limits, o.references)
        head, stored = E.parts(payload, o, o.references)
        key = o.keys.get(o.key_id, 32) if by_jvm else None
        return pd.DataFrame({"graph_id": [pdf["graph_id"].iloc[0]], "head": [head], "stored": [stored], "key": [key]})

    wanted = nodes.select("graph_id", "node_id", *fields.names, *links)
    made = wanted.groupBy("graph_id").applyInPandas(run, T.StructType([wanted.schema["graph_id"], *PARTS.fields]))
    frame = finish(F.struct("head", "stored", "key")) if by_jvm else F.concat("head", "stored")
    return made.select("graph_id", frame.alias("frame"))


def decode_graphs(frames: DataFrame, fields: T.StructType, links: list[str], options: Options | None = None, name: str = "Node") -> DataFrame:
    """graph_id, node_id, fields and links of every node of each frame."""
    ship(frames.sparkSession)
    o = options or Options(references=True)
    row = T.StructType([T.StructField("node_id", T.LongType()), *fields.fields, *[T.StructField(k, T.LongType()) for k in links]])

    plain = opened(F.col("frame"), o)

    @F.udf(T.ArrayType(row))
    def nodes(frame, plain):
        payload, references = E.undo(bytes(frame), o, None if plain is None else bytes(plain))
        return unlink(decode(node_codec(fields, links, name), payload, o.limits, references), links)

    return frames.select("graph_id", F.inline(nodes("frame", F.lit(None).cast("binary") if plain is None else plain)))
