"""Queries by name, and their SQL.

Each query passes a whole table through frames and gives back what SQL can say about it: relational operators here only carry
results to where they can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions import wire
from framewright.functions.codec import MAPS, SEQUENCES
from framewright.functions.keys import Keys
from framewright.functions.limits import Limits
from framewright.functions.options import Options
from framewright.functions.schema import Context, required
from framewright.functions.ship import ship
from framewright.functions.storage import fresh
from framewright.operators import frames as fr
from framewright.operators import graphs
from framewright.operators import sql as fsql
from framewright.sources import frames as source
from framewright.streaming import merge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KEY = bytes(range(32))
#: Bytes of a number's varint, in SQL.
VARINT = "CASE WHEN ({0}) < 128 THEN 1 WHEN ({0}) < 16384 THEN 2 WHEN ({0}) < 2097152 THEN 3 WHEN ({0}) < 268435456 THEN 4 ELSE 5 END"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row(df: DataFrame):
    return F.struct(*df.columns)


def meta_field(name: str, kind: T.DataType, nullable: bool = True, **meta) -> T.StructField:
    return T.StructField(name, kind, nullable, meta)


def keyed(fields) -> T.StructType:
    """Fields with keys 1, 2, ... in order."""
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {"key": i}) for i, f in enumerate(fields, 1)])


KEYED = {"layout": "keyed"}

# ---------------------------------------------------------------- round trips


def _roundtrip(name: str, options: Options = fr.DEFAULT, strict: bool = False):
    def run(spark, sf_dir):
        df = table(spark, sf_dir, name)
        schema = required(df.schema) if strict else df.schema
        framed = df.select(fr.encode(row(df), schema, options=options).alias("frame"))
        return framed.select(fr.decode(F.col("frame"), schema, options=options).alias("v")).select("v.*")

    return run


for _t in TABLES:
    query(f"roundtrip_{_t}", f"SELECT * FROM {_t}")(_roundtrip(_t))
query("roundtrip_v0_lineitem", "SELECT * FROM lineitem")(_roundtrip("lineitem", Options(version=0, allow_v0=True), strict=True))
query("deflate_documents", "SELECT doc_id, text, lang, source, n_chars FROM documents")(_roundtrip("documents", Options(compression="deflate", checksum="crc32")))
query("xxh3_orders", "SELECT * FROM orders")(_roundtrip("orders", Options(checksum="xxh3", require_checksum=True)))
query("xxh128_customers", "SELECT * FROM customer")(_roundtrip("customer", Options(checksum="xxh128")))
AES = Options(encryption="aes256gcm", keys=Keys(fixed=KEY), key_id="k1", checksum="crc32", compression="deflate", require_encryption=True)
query("aes_documents", "SELECT * FROM documents")(_roundtrip("documents", AES))
CHACHA = Options(encryption="chacha20poly1305", keys=Keys(fixed=KEY), key_id="k1", checksum="crc32", require_encryption=True)
query("chacha_customers", "SELECT * FROM customer")(_roundtrip("customer", CHACHA))
query("hkdf_events", "SELECT * FROM events")(_roundtrip("events", Options(encryption="aes256gcm", keys=Keys(root=KEY, salt=b"salt"), key_id="2026-q3")))


class Xor:
    """A cipher of one's own, for the extension surface; not for secrets."""

    key_size, authenticates = 1, False

    def stored_size(self, n: int) -> int:
        return n

    def encrypt(self, data: bytes, key: bytes, header: bytes) -> bytes:
        return bytes(b ^ key[0] for b in data)

    decrypt = encrypt


class Sum16:
    """A checksum of one's own: two bytes."""

    size = 2

    def compute(self, data: bytes) -> bytes:
        return (sum(data) & 0xFFFF).to_bytes(2, "big")


class Zlib:
    """A compression of one's own."""

    def compress(self, data: bytes) -> bytes:
        import zlib

        return zlib.compress(data)

    def decompress(self, data: bytes, size: int) -> bytes:
        import zlib

        return zlib.decompressobj().decompress(data, size + 1)


CUSTOM = Options(compression="zlib", checksum="sum16", encryption="xor", keys=Keys(fixed=b"\x5a"), custom={"zlib": Zlib(), "sum16": Sum16(), "xor": Xor()})
query("custom_algorithms_parts", "SELECT * FROM part")(_roundtrip("part", CUSTOM))


@query("keys_by_table_orders", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def keys_by_table_orders(spark, sf_dir):
    """Keys come from a table by key id: a small one is broadcast by Spark's own size check."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    ring = spark.createDataFrame([(f"k{i}", bytes([i]) * 32) for i in range(4)], "id string, key binary")
    shares = [
        df.where(F.pmod("o_orderkey", F.lit(4)) == i).select(fr.encode(row(df), df.schema, options=Options(encryption="aes256gcm", keys=Keys(fixed=bytes([i]) * 32), key_id=f"k{i}")).alias("frame"))
        for i in range(4)
    ]
    sealed = shares[0].unionByName(shares[1]).unionByName(shares[2]).unionByName(shares[3])
    named = sealed.withColumn("id", fr.header(F.col("frame"))["key_id"]).join(ring, "id", "left")
    return named.select(fr.decode(F.col("frame"), df.schema, key=F.col("key")).alias("v")).select("v.*")


# ---------------------------------------------------------------- sizes and bytes

ORDER_SIZE = f"33 + octet_length(encode(o_orderpriority)) + ({VARINT.format('octet_length(encode(o_orderpriority)) + 1')}) + octet_length(encode(o_orderstatus)) + ({VARINT.format('octet_length(encode(o_orderstatus)) + 1')})"


@query("v0_payload_size", f"SELECT o_orderkey, CAST({ORDER_SIZE} AS INTEGER) AS n FROM orders")
def v0_payload_size(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", F.octet_length(fr.encode(row(df), required(df.schema), options=Options(version=0))).alias("n"))


@query("v1_frame_size", f"SELECT o_orderkey, CAST(n + 7 + ({VARINT.format('n')}) AS INTEGER) AS n FROM (SELECT o_orderkey, {ORDER_SIZE} AS n FROM orders)")
def v1_frame_size(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", F.octet_length(fr.encode(row(df), required(df.schema))).alias("n"))


def _le(x: str, n: int) -> str:
    """Little-endian hex of a whole number, in SQL."""
    h = f"right(lpad(hex({x}), 16, '0'), {2 * n})"
    return " || ".join(f"substr({h}, {2 * k - 1}, 2)" for k in range(n, 0, -1))


@query("int_le_hex", f"SELECT o_orderkey, upper({_le('o_orderkey', 8)}) AS wire FROM orders")
def int_le_hex(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.hex(wire.little(F.col("o_orderkey"), 8)).alias("wire"))


@query("int_le_decode", "SELECT l_orderkey, l_linenumber, l_orderkey * -7 AS n FROM lineitem")
def int_le_decode(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", wire.little(F.col("l_orderkey") * -7, 8).alias("b"))
    return df.select("l_orderkey", "l_linenumber", wire.number(F.col("b"), 8).alias("n"))


SEGMENT = "octet_length(encode(c_mktsegment))"  # under 127: its length is one byte


@query("native_customer_frames", f"SELECT c_custkey, '42534552010000' || lpad(hex(14 + {SEGMENT}), 2, '0') || '01' || upper({_le('c_custkey', 8)}) || upper({_le('c_nationkey', 4)}) || lpad(hex({SEGMENT} + 1), 2, '0') || upper(hex(encode(c_mktsegment))) AS frame FROM customer")
def native_customer_frames(spark, sf_dir):
    """Frames by expressions alone: no Python in the plan."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("c_segment"))
    schema = T.StructType([T.StructField("c_custkey", T.LongType(), False), T.StructField("c_nationkey", T.IntegerType(), False), T.StructField("c_segment", T.StringType())])
    return df.select("c_custkey", F.hex(fr.encode_native({c: F.col(c) for c in df.columns}, schema)).alias("frame"))


@query("native_equals_batch_orders", "SELECT o_orderkey, true AS same FROM orders")
def native_equals_batch_orders(spark, sf_dir):
    """Both back ends write the same bytes."""
    df = table(spark, sf_dir, "orders").drop("o_totalprice")
    o = Options(checksum="crc32")
    native = fr.encode_native({c: F.col(c) for c in df.columns}, df.schema, o)
    return df.select("o_orderkey", (native == fr.encode(row(df), df.schema, options=o)).alias("same"))


@query("date_and_time_wire", f"SELECT o_orderkey, upper({_le('date_diff(\'day\', DATE \'1970-01-01\', CAST(o_orderdate AS DATE)) + 719162', 4)}) AS day, upper({_le('epoch_us(o_orderdate) * 10 + 621355968000000000', 8)}) AS instant FROM orders")
def date_and_time_wire(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderdate")
    enc = lambda c, kind: F.hex(fr.encode(F.col(c), kind, options=Options(version=0), nullable=False))
    return df.select("o_orderkey", enc("day", T.DateType()).alias("day"), enc("o_orderdate", T.TimestampNTZType()).alias("instant"))


@query("varint_widths", f"SELECT doc_id, CAST({VARINT.format('n_chars')} AS INTEGER) AS n FROM documents")
def varint_widths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(wire.varint(F.col("n_chars"))).alias("n"))


@query("header_peek", f"SELECT o_orderkey, 1 AS version, false AS refs, 'None' AS compression, 'Crc32' AS checksum, CAST(14 + ({VARINT.format(ORDER_SIZE)}) AS INTEGER) AS header_length, CAST({ORDER_SIZE} AS INTEGER) AS on_disk FROM orders")
def header_peek(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    h = df.select("o_orderkey", fr.header(fr.encode(row(df), required(df.schema), options=Options(checksum="crc32"))).alias("h"))
    return h.select("o_orderkey", "h.version", F.col("h.references").alias("refs"), "h.compression", F.col("h.checksum_algorithm").alias("checksum"), "h.header_length", F.col("h.on_disk_length").alias("on_disk"))


# ---------------------------------------------------------------- contracts, unions, references


@query("keyed_skip", "SELECT p_partkey, p_size, p_retailprice FROM part")
def keyed_skip(spark, sf_dir):
    """An old reader meets new fields: they are stepped over by their length."""
    df = table(spark, sf_dir, "part")
    new = keyed(df.schema.fields)
    old = T.StructType([new[c] for c in ("p_partkey", "p_size", "p_retailprice")])
    return df.select(fr.decode(fr.encode(row(df), new, KEYED), old, KEYED).alias("v")).select("v.*")


@query("keyed_missing", "SELECT p_partkey, p_name, CAST(NULL AS VARCHAR) AS p_note FROM part")
def keyed_missing(spark, sf_dir):
    """A new reader meets old frames: what they lack is null."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    old = keyed(df.schema.fields)
    new = T.StructType([*old.fields, meta_field("p_note", T.StringType(), key=9)])
    return df.select(fr.decode(fr.encode(row(df), old, KEYED), new, KEYED).alias("v")).select("v.*")


@query("populate_merge", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders")
def populate_merge(spark, sf_dir):
    """Frames with some fields overlay rows: other fields keep what they had."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    full = keyed(df.schema.fields)
    part = T.StructType([full["o_orderkey"], full["o_orderstatus"]])
    change = df.select(F.col("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    frames = change.select(F.col("o_orderkey").alias("k"), fr.encode(row(change), part, KEYED).alias("frame"))
    read = df.join(frames, df["o_orderkey"] == F.col("k")).withColumn("d", fr.decode(F.col("frame"), full, KEYED, mode="PERMISSIVE"))
    return read.select(*fr.populate({c: F.col(c) for c in full.names}, F.col("d"), full))


@query("merge_batch_orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'B' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders")
def merge_batch_orders(spark, sf_dir):
    """Of several frames of a key the last wins, field by field."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    full = keyed(df.schema.fields)
    part = T.StructType([full["o_orderkey"], full["o_orderstatus"]])
    some = df.where("o_orderkey % 3 = 0")
    frames = [some.select(F.lit(i).alias("offset"), fr.encode(F.struct("o_orderkey", F.lit(s).alias("o_orderstatus")), part, KEYED).alias("frame")) for i, s in enumerate("AB")]
    return merge.merge_batch(df, frames[0].unionByName(frames[1]), full, "o_orderkey")


EVENT_ARMS = ("click", "view", "purchase", "signup")


@query("union_events", "SELECT CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 255 END AS INTEGER) AS tag, count(*) AS n, count(event_id) AS ids, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1")
def union_events(spark, sf_dir):
    """Each event is one arm of a union; the tag is read from the bytes, the arm decoded."""
    df = table(spark, sf_dir, "events")
    arm = T.StructType([T.StructField("event_id", T.LongType(), False), T.StructField("value", T.DoubleType())])
    names = [*EVENT_ARMS, "other"]
    schema = T.StructType([T.StructField(n, arm, True, {"type": n}) for n in names])
    tags = {n: i for i, n in enumerate(EVENT_ARMS, 1)} | {"other": 255}
    here = [F.when((F.col("event_type") == n) if n != "other" else F.coalesce(~F.col("event_type").isin(*EVENT_ARMS), F.lit(True)), F.struct("event_id", "value")).alias(n) for n in names]
    framed = df.select(fr.encode(F.struct(*here), schema, {"union": tags}, Options(version=0)).alias("p"))
    v = framed.select(F.conv(F.hex(F.substring("p", 2, 1)), 16, 10).cast("int").alias("tag"), fr.decode(F.col("p"), schema, {"union": tags}, Options(allow_v0=True)).alias("v"))
    ids = F.coalesce(*[F.col(f"v.{n}.event_id") for n in names])
    return v.groupBy("tag").agg(F.count("*").alias("n"), F.count(ids).alias("ids"), F.sum(ids).alias("total"))


@query("reference_customers", "SELECT o_custkey, count(*) AS n_orders, count(*) - 1 AS back_references FROM orders GROUP BY o_custkey")
def reference_customers(spark, sf_dir):
    """A customer's orders hold one customer: written once, then referred back to."""
    df = table(spark, sf_dir, "orders")
    customer = T.StructType([T.StructField("c_custkey", T.LongType(), False)])
    order = T.StructType([T.StructField("o_orderkey", T.LongType(), False), T.StructField("customer", customer, True, {"identity": ["c_custkey"], "type": "Customer"})])
    schema = T.ArrayType(order, True)
    lists = df.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", F.struct(F.col("o_custkey").alias("c_custkey")).alias("customer"))).alias("orders"))
    nodes = lists.select("o_custkey", F.inline(fr.dump(fr.encode(F.col("orders"), schema, options=Options(references=True)), schema)))
    return nodes.groupBy("o_custkey").agg(F.count(F.when(F.col("name") == "customer", 1)).alias("n_orders"), F.count(F.when(F.col("kind") == "BackReference", 1)).alias("back_references"))


def _rings(spark, sf_dir, options):
    """The nations of a region as a ring: a cycle that survives a frame."""
    df = table(spark, sf_dir, "nation")
    ring = df.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("k"))
    nodes = ring.select(F.col("n_regionkey").alias("graph_id"), F.posexplode("k").alias("i", "node_id"), "k")
    nodes = nodes.select("graph_id", F.col("node_id").cast("bigint").alias("node_id"), F.col("node_id").cast("int").alias("Value"), F.element_at("k", (F.pmod(F.col("i") + 1, F.size("k")) + 1).cast("int")).cast("bigint").alias("Next"))
    fields = T.StructType([T.StructField("Value", T.IntegerType(), False)])
    back = graphs.decode_graphs(graphs.encode_graphs(nodes, fields, ["Next"], options), fields, ["Next"], options)
    return back.groupBy("graph_id").agg(F.count("*").alias("nodes"), F.count("Next").alias("links"))


query("graph_of_nations", "SELECT n_regionkey AS graph_id, count(*) AS nodes, count(*) AS links FROM nation GROUP BY 1")(lambda spark, sf_dir: _rings(spark, sf_dir, None))
query("aes_graph_of_nations", "SELECT n_regionkey AS graph_id, count(*) AS nodes, count(*) AS links FROM nation GROUP BY 1")(
    lambda spark, sf_dir: _rings(spark, sf_dir, Options(references=True, encryption="aes256gcm", keys=Keys(fixed=KEY), key_id="k1"))
)


# ---------------------------------------------------------------- kinds of containers and scalars


@query("sequence_kinds", "SELECT kind, vec_id, embedding FROM embeddings, (SELECT unnest([" + ", ".join(f"'{k}'" for k in SEQUENCES if "distinct" not in SEQUENCES[k][1]) + "]) AS kind)")
def sequence_kinds(spark, sf_dir):
    """Every sequence kind that allows repeats gives back the same order."""
    df = table(spark, sf_dir, "embeddings")
    schema = T.ArrayType(T.FloatType(), False)
    kinds = [k for k in SEQUENCES if "distinct" not in SEQUENCES[k][1]]
    return _stack([df.select(F.lit(k).alias("kind"), "vec_id", fr.decode(fr.encode(F.col("embedding"), schema, {"wire": k}), schema, {"wire": k}).alias("embedding")) for k in kinds])


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SETS = [k for k in SEQUENCES if "distinct" in SEQUENCES[k][1]]


@query("set_kinds", "SELECT kind, o_custkey, list_sort(list(DISTINCT o_orderkey)) AS keys FROM orders, (SELECT unnest([" + ", ".join(f"'{k}'" for k in SETS) + "]) AS kind) GROUP BY ALL")
def set_kinds(spark, sf_dir):
    df = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderkey").alias("keys"))
    schema = T.ArrayType(T.LongType(), False)
    return _stack([df.select(F.lit(k).alias("kind"), "o_custkey", F.array_sort(fr.decode(fr.encode(F.col("keys"), schema, {"wire": k}), schema, {"wire": k})).alias("keys")) for k in SETS])


@query("set_duplicates_rejected", "SELECT o_custkey, CASE WHEN count(*) > count(DISTINCT o_orderstatus) THEN 'FORMAT' END AS error_class FROM orders GROUP BY o_custkey")
def set_duplicates_rejected(spark, sf_dir):
    """A list's bytes read as a set are malformed where an element repeats."""
    df = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias("s"))
    schema = T.ArrayType(T.StringType(), False)
    return df.select("o_custkey", fr.decode(fr.encode(F.col("s"), schema), schema, {"wire": "set"}, mode="PERMISSIVE")["error_class"].alias("error_class"))


@query("map_conversations", "SELECT conv_id, turn, text FROM conversations")
def map_conversations(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("turn", "text"))).alias("m"))
    schema = T.MapType(T.LongType(), T.StringType(), True)
    return df.select("conv_id", F.explode(fr.decode(fr.encode(F.col("m"), schema), schema)).alias("turn", "text"))


@query("map_kinds", "SELECT kind, n_regionkey, n_nationkey, n_name FROM nation, (SELECT unnest([" + ", ".join(f"'{k}'" for k in MAPS) + "]) AS kind)")
def map_kinds(spark, sf_dir):
    df = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("m"))
    schema = T.MapType(T.IntegerType(), T.StringType(), True)
    return _stack([df.select(F.lit(k).alias("kind"), "n_regionkey", F.explode(fr.decode(fr.encode(F.col("m"), schema, {"wire": k}), schema, {"wire": k})).alias("n_nationkey", "n_name")) for k in MAPS])


@query("priority_queue_parts", "SELECT p_brand, list(p_size ORDER BY p_size) AS sizes FROM part GROUP BY p_brand")
def priority_queue_parts(spark, sf_dir):
    """Pairs come back in priority order; equal priorities are allowed."""
    pair = T.StructType([T.StructField("element", T.LongType(), False), T.StructField("priority", T.IntegerType(), False)])
    schema, meta = T.ArrayType(pair, False), {"wire": "priority_queue"}
    df = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_list(F.struct(F.col("p_partkey").alias("element"), F.col("p_size").alias("priority"))).alias("q"))
    return df.select("p_brand", F.transform(fr.decode(fr.encode(F.col("q"), schema, meta), schema, meta), lambda x: x["priority"]).alias("sizes"))


@query("grid_embeddings", "SELECT vec_id, [2, len(embedding) // 2]::INTEGER[] AS dims, embedding AS data FROM embeddings")
def grid_embeddings(spark, sf_dir):
    """Vectors as arrays of rank two."""
    schema = T.StructType([T.StructField("dims", T.ArrayType(T.IntegerType(), False), False), T.StructField("data", T.ArrayType(T.FloatType(), False), False)])
    meta = {"wire": "grid", "rank": 2}
    df = table(spark, sf_dir, "embeddings")
    grid = F.struct(F.array(F.lit(2), (F.size("embedding") / 2).cast("int")).alias("dims"), F.col("embedding").alias("data"))
    return df.select("vec_id", fr.decode(fr.encode(grid, schema, meta), schema, meta).alias("g")).select("vec_id", "g.dims", "g.data")


@query("tuples_nation", "SELECT n_nationkey AS a, n_name AS b, n_regionkey AS c, kind FROM nation, (SELECT unnest(['tuple', 'value_tuple']) AS kind)")
def tuples_nation(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("b"), F.col("n_regionkey").alias("c"))
    return _stack([df.select(fr.decode(fr.encode(row(df), df.schema, {"wire": k}), df.schema, {"wire": k}).alias("v"), F.lit(k).alias("kind")).select("v.*", "kind") for k in ("tuple", "value_tuple")])


@query("tuple_arities", "SELECT kind, arity, o_orderkey, list_sum([(o_orderkey + i) * (i + 1) FOR i IN range(arity)])::BIGINT AS weighted FROM orders, (SELECT unnest(['tuple', 'value_tuple']) AS kind), (SELECT unnest([1, 2, 4, 5, 6, 7, 8]) AS arity)")
def tuple_arities(spark, sf_dir):
    """Tuples of every arity give back each part in its place."""
    df = table(spark, sf_dir, "orders").select("o_orderkey")
    out = []
    for kind in ("tuple", "value_tuple"):
        for arity in (1, 2, 4, 5, 6, 7, 8):
            schema = T.StructType([T.StructField(f"p{i}", T.LongType(), False) for i in range(arity)])
            value = F.struct(*[(F.col("o_orderkey") + i).alias(f"p{i}") for i in range(arity)])
            v = df.select("o_orderkey", fr.decode(fr.encode(value, schema, {"wire": kind}), schema, {"wire": kind}).alias("v"))
            total = sum((F.col(f"v.p{i}") * (i + 1) for i in range(arity)), F.lit(0).cast("bigint"))
            out.append(v.select(F.lit(kind).alias("kind"), F.lit(arity).alias("arity"), "o_orderkey", total.alias("weighted")))
    return _stack(out)


TICKS = "(epoch_us(o_orderdate) * 10 + 621355968000000000)"


@query("offsets_and_times", f"SELECT o_orderkey, CAST({TICKS} AS BIGINT) AS ticks, CAST(((o_orderkey % 27) - 13) * 36000000000 AS BIGINT) AS offset_ticks, CAST(o_orderkey % 86400 * 10000000 AS BIGINT) AS clock, upper({_le(TICKS, 8)} || {_le('((o_orderkey % 27) - 13) * 36000000000 + CASE WHEN o_orderkey % 27 < 13 THEN 0 ELSE 0 END', 8)}) AS wire FROM orders WHERE o_orderkey % 27 >= 13 UNION ALL SELECT o_orderkey, CAST({TICKS} AS BIGINT), CAST(((o_orderkey % 27) - 13) * 36000000000 AS BIGINT), CAST(o_orderkey % 86400 * 10000000 AS BIGINT), NULL FROM orders WHERE o_orderkey % 27 < 13")
def offsets_and_times(spark, sf_dir):
    """Clock times with their offsets, and times of day; the bytes too where the offset isn't negative."""
    df = table(spark, sf_dir, "orders")
    ticks = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 10 + F.lit(621355968000000000)
    pair = T.StructType([T.StructField("ticks", T.LongType(), False), T.StructField("offset_ticks", T.LongType(), False)])
    offset = (F.pmod("o_orderkey", F.lit(27)) - 13) * F.lit(36000000000)
    made = df.select("o_orderkey", F.struct(ticks.alias("ticks"), offset.alias("offset_ticks")).alias("o"), (F.pmod("o_orderkey", F.lit(86400)) * 10000000).alias("t"))
    o = fr.decode(fr.encode(F.col("o"), pair, {"wire": "offset"}, nullable=False), pair, {"wire": "offset"}, nullable=False)
    t = fr.decode(fr.encode(F.col("t"), T.LongType(), {"wire": "time"}, nullable=False), T.LongType(), {"wire": "time"}, nullable=False)
    wire_ = F.hex(fr.encode(F.col("o"), pair, {"wire": "offset"}, Options(version=0), nullable=False))
    read = made.select("o_orderkey", o.alias("o"), t.alias("clock"), wire_.alias("w"))
    return read.select("o_orderkey", "o.ticks", "o.offset_ticks", "clock", F.when(F.col("o.offset_ticks") >= 0, F.col("w")).alias("wire"))


@query("member_orders", f"SELECT c_custkey, upper({_le('c_nationkey', 4)} || {_le('c_custkey', 8)} || {_le('c_custkey + 1', 8)}) AS wire, CAST(NULL AS INTEGER) AS ignored FROM customer")
def member_orders(spark, sf_dir):
    """Members stand by order and then by name; ignored ones and private ones that aren't included aren't written."""
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("b"), (F.col("c_custkey") + 1).alias("_shown"), F.col("c_custkey").alias("_hidden"), F.col("c_nationkey").alias("z"), F.col("c_nationkey").alias("gone"))
    long = lambda n, **m: meta_field(n, T.LongType(), False, **m)
    schema = T.StructType([long("b", order=2), long("_shown", include=True), meta_field("_hidden", T.LongType()), meta_field("z", T.IntegerType(), False, order=1), meta_field("gone", T.IntegerType(), ignore=True)])
    bare = Options(version=0, allow_v0=True)
    made = df.select(F.col("b").alias("c_custkey"), fr.encode(row(df), schema, options=bare, nullable=False).alias("p"))
    return made.select("c_custkey", F.hex("p").alias("wire"), fr.decode(F.col("p"), schema, options=bare, nullable=False)["gone"].alias("ignored"))


@query("union_unknown_tag", "SELECT event_id, 'TYPE' AS error_class, true AS same FROM events")
def union_unknown_tag(spark, sf_dir):
    """A tag that the reader's union lacks is an error of type; one that it has is the arm that was written."""
    df = table(spark, sf_dir, "events")
    arm = T.StructType([T.StructField("event_id", T.LongType(), False)])
    wide, narrow = (T.StructType([T.StructField(n, arm, True, {"type": n}) for n in names]) for names in (("a", "b"), ("b",)))
    made = df.select("event_id", fr.encode(F.struct(F.struct("event_id").alias("a"), F.lit(None).cast(arm).alias("b")), wide, {"union": {"a": 7, "b": 8}}).alias("f"))
    back = fr.decode(F.col("f"), wide, {"union": {"a": 7, "b": 8}})
    return made.select("event_id", fr.decode(F.col("f"), narrow, {"union": {"b": 8}}, mode="PERMISSIVE")["error_class"].alias("error_class"), ((back["a"]["event_id"] == F.col("event_id")) & back["b"].isNull()).alias("same"))


def _ring_key(name: str | None) -> bytes | None:
    return bytes([int(name[1:])]) * 32 if name and name[0] == "k" else None


@query("keys_by_function", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN 'ENCRYPTION_KEY' END AS refused FROM customer")
def keys_by_function(spark, sf_dir):
    """Keys come from a function of the key id; an id that it doesn't know is refused."""
    df = table(spark, sf_dir, "customer")
    ring = Keys(resolve=_ring_key)
    half = [df.where(F.pmod("c_custkey", F.lit(2)) == i) for i in (0, 1)]
    sealed = _stack([x.select("c_custkey", fr.encode(row(df), df.schema, options=Options(encryption="aes256gcm", keys=ring, key_id=f"k{i}")).alias("f")) for i, x in enumerate(half)])
    odd = Options(encryption="aes256gcm", keys=Keys(resolve=lambda k: _ring_key(k) if k == "k1" else None), key_id="k1")
    read = fr.decode(F.col("f"), df.schema, options=Options(encryption="aes256gcm", keys=ring, key_id="k1"))
    return sealed.select("c_custkey", read["c_name"].alias("c_name"), fr.decode(F.col("f"), df.schema, options=odd, mode="PERMISSIVE")["error_class"].alias("refused"))


@query("populate_stream_orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'S' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders")
def populate_stream_orders(spark, sf_dir):
    """A table that a stream of frames keeps up to date; each batch is stored as a new version of it."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    full = keyed(df.schema.fields)
    part = T.StructType([full["o_orderkey"], full["o_orderstatus"]])
    source.register(spark)
    raw, store = fresh(spark, "changes"), fresh(spark, "target")
    change = df.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("S").alias("o_orderstatus"))
    change.select(fr.encode(row(change), part, KEYED).alias("frame")).write.format("frames").mode("append").save(raw)
    df.write.parquet(f"{store}/start")
    now = {"at": f"{store}/start"}

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{store}/{batch}")
        now["at"] = f"{store}/{batch}"

    q = merge.populate_stream(spark.readStream.format("frames").load(raw), lambda: spark.read.parquet(now["at"]), save, full, "o_orderkey", fresh(spark, "changes-log"))
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(now["at"])


@query("pairs_and_lazies", "SELECT r_regionkey AS key, r_name AS value, r_name AS lazy FROM region")
def pairs_and_lazies(spark, sf_dir):
    df = table(spark, sf_dir, "region")
    schema = T.StructType([
        meta_field("pair", T.StructType([T.StructField("key", T.IntegerType(), False), T.StructField("value", T.StringType())]), False, wire="pair"),
        meta_field("lazy", T.StructType([T.StructField("v", T.StringType())]), True, wire="lazy"),
    ])
    v = F.struct(F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value")).alias("pair"), F.struct(F.col("r_name").alias("v")).alias("lazy"))
    out = df.select(fr.decode(fr.encode(v, schema), schema).alias("v"))
    return out.select("v.pair.key", "v.pair.value", F.col("v.lazy.v").alias("lazy"))


SCALAR_FIELDS = [
    ("flag", T.BooleanType(), "o_orderkey % 2 = 0", {}), ("u8", T.ShortType(), "CAST(o_orderkey % 256 AS SMALLINT)", {"wire": "u8"}), ("i8", T.ByteType(), "CAST(o_orderkey % 128 AS TINYINT)", {}),
    ("i16", T.ShortType(), "CAST(o_orderkey % 30000 AS SMALLINT)", {}), ("u16", T.IntegerType(), "CAST(o_orderkey % 65536 AS INT)", {"wire": "u16"}), ("u32", T.LongType(), "o_orderkey + 3000000000", {"wire": "u32"}),
    ("u64", T.DecimalType(20, 0), "CAST(o_orderkey + 9000000000000000000 AS DECIMAL(20,0))", {"wire": "u64"}), ("f32", T.FloatType(), "CAST(o_totalprice AS FLOAT)", {}), ("f16", T.FloatType(), "CAST(o_orderkey % 1000 AS FLOAT)", {"wire": "f16"}),
    ("f64", T.DoubleType(), "o_totalprice", {}), ("dec", T.DecimalType(20, 2), "CAST(o_totalprice AS DECIMAL(20,2))", {}), ("i128", T.DecimalType(38, 0), "CAST(-o_orderkey AS DECIMAL(38,0))", {"wire": "i128"}),
    ("u128", T.DecimalType(38, 0), "CAST(o_orderkey AS DECIMAL(38,0))", {"wire": "u128"}), ("iptr", T.LongType(), "-o_orderkey", {"wire": "iptr"}), ("uptr", T.LongType(), "o_orderkey", {"wire": "uptr"}), ("big", T.DecimalType(38, 0), "CAST(o_orderkey * -1000 AS DECIMAL(38,0))", {"wire": "bigint"}),
    ("ch", T.StringType(), "substr(o_orderpriority, 1, 1)", {"wire": "char"}), ("rune", T.StringType(), "substr(o_orderstatus, 1, 1)", {"wire": "rune"}), ("text", T.StringType(), "o_orderpriority", {}), ("builder", T.StringType(), "o_orderstatus", {"wire": "builder"}),
    ("uri", T.StringType(), "'http://example.org/' || CAST(o_orderkey AS VARCHAR(20))", {"wire": "uri"}), ("version", T.StringType(), "'1.' || CAST(o_orderkey AS VARCHAR(20))", {"wire": "version"}), ("culture", T.StringType(), "'en-US'", {"wire": "culture"}), ("zone", T.StringType(), "'UTC'", {"wire": "timezone"}),
    ("guid", T.StringType(), "'0f8fad5b-d9cb-469f-a165-' || lpad(CAST(o_orderkey AS VARCHAR(20)), 12, '0')", {"wire": "guid"}), ("day", T.DateType(), "CAST(o_orderdate AS DATE)", {}), ("ts", T.TimestampNTZType(), "o_orderdate", {}), ("ticks", T.LongType(), "o_orderkey * 7", {"wire": "ticks"}),
    ("choice", T.IntegerType(), "CAST(o_orderkey % 3 AS INT)", {"enum": "i32", "names": {"0": "A", "1": "B"}}),
]


@query("all_scalars", "SELECT o_orderkey, " + ", ".join(f"{sql} AS {n}" for n, _, sql, _ in SCALAR_FIELDS) + " FROM orders")
def all_scalars(spark, sf_dir):
    """Every scalar encoding, there and back."""
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey", *[f"{sql.replace('VARCHAR(20)', 'STRING')} AS {n}" for n, _, sql, _ in SCALAR_FIELDS])
    schema = T.StructType([T.StructField(n, k, i % 2 == 0, m) for i, (n, k, _, m) in enumerate(SCALAR_FIELDS)])
    return df.select("o_orderkey", fr.decode(fr.encode(F.struct(*schema.names), schema), schema).alias("v")).select("o_orderkey", "v.*")


@query("numerics", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS re, CAST(embedding[2] AS DOUBLE) AS im, embedding[1:2] AS vector2, embedding[1:3] AS vector3, embedding[1:4] AS vector4, embedding[1:4] AS quaternion, embedding[1:4] AS plane, embedding[1:6] AS matrix3x2, embedding[1:16] AS matrix4x4, [x > 0 FOR x IN embedding] AS bits FROM embeddings")
def numerics(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    sizes = {"vector2": 2, "vector3": 3, "vector4": 4, "quaternion": 4, "plane": 4, "matrix3x2": 6, "matrix4x4": 16}
    complex_ = T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])
    schema = T.StructType([meta_field("z", complex_, False, wire="complex"), *[meta_field(n, T.ArrayType(T.FloatType(), False), False, wire=n) for n in sizes], meta_field("bits", T.ArrayType(T.BooleanType(), False), True, wire="bits")])
    value = F.struct(
        F.struct(F.col("embedding")[0].cast("double").alias("re"), F.col("embedding")[1].cast("double").alias("im")).alias("z"), *[F.slice("embedding", 1, k).alias(n) for n, k in sizes.items()],
        F.transform("embedding", lambda x: x > 0).alias("bits"),
    )
    v = df.select("vec_id", fr.decode(fr.encode(value, schema), schema).alias("v"))
    return v.select("vec_id", "v.z.re", "v.z.im", *[f"v.{n}" for n in sizes], "v.bits")


@query("nested_orders", "SELECT l_orderkey, count(*) AS lines, CAST(sum(l_linenumber) AS BIGINT) AS numbers, max(l_shipdate) AS last FROM lineitem GROUP BY l_orderkey")
def nested_orders(spark, sf_dir):
    """Orders with their lines as nested lists of structs."""
    df = table(spark, sf_dir, "lineitem")
    line = T.StructType([df.schema[c] for c in df.columns if c != "l_orderkey"])
    schema = T.StructType([T.StructField("l_orderkey", T.LongType(), False), T.StructField("lines", T.ArrayType(line, False))])
    orders = df.groupBy("l_orderkey").agg(F.collect_list(F.struct(*line.names)).alias("lines"))
    v = orders.select(fr.decode(fr.encode(row(orders), schema), schema).alias("v")).select("v.l_orderkey", F.explode("v.lines").alias("x"))
    return v.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("x.l_linenumber").alias("numbers"), F.max("x.l_shipdate").alias("last"))


# ---------------------------------------------------------------- protection, limits, errors


def _tamper(frame, at):
    """The frame with one byte, counted from its end, turned over."""
    n = F.octet_length(frame)
    b = F.conv(F.hex(F.substring(frame, n - at, F.lit(1))), 16, 10).cast("int")
    return F.concat(F.substring(frame, F.lit(1), n - at - 1), F.unhex(F.lpad(F.hex(b.bitwiseXOR(F.lit(255))), 2, "0")), F.substring(frame, n - at + 1, n))


@query("checksum_ok", "SELECT c_custkey, algorithm, true AS ok FROM customer, (SELECT unnest(['crc32', 'xxh3', 'xxh128']) AS algorithm)")
def checksum_ok(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return _stack([df.select("c_custkey", F.lit(a).alias("algorithm"), fr.checksum_ok(fr.encode(row(df), df.schema, options=Options(checksum=a))).alias("ok")) for a in ("crc32", "xxh3", "xxh128")])


@query("checksum_tampered", "SELECT c_custkey, 'INTEGRITY' AS error_class FROM customer")
def checksum_tampered(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    frame = fr.encode(row(df), df.schema, options=Options(checksum="xxh3"))
    return df.select("c_custkey", fr.decode(_tamper(frame, 0), df.schema, mode="PERMISSIVE")["error_class"].alias("error_class"))


def _sealed(spark, sf_dir, options):
    df = table(spark, sf_dir, "customer")
    return df, df.select("c_custkey", fr.encode(row(df), df.schema, options=options, nonce=F.unhex(F.lpad(F.hex("c_custkey"), 24, "0"))).alias("frame"))


@query("aes_wrong_key", "SELECT c_custkey, 'INTEGRITY' AS error_class FROM customer")
def aes_wrong_key(spark, sf_dir):
    df, sealed = _sealed(spark, sf_dir, AES)
    wrong = Options(encryption="aes256gcm", keys=Keys(fixed=bytes(32)), checksum="crc32")
    return sealed.select("c_custkey", fr.decode(F.col("frame"), df.schema, options=wrong, mode="PERMISSIVE")["error_class"].alias("error_class"))


@query("aes_no_key", "SELECT c_custkey, 'ENCRYPTION_KEY' AS error_class FROM customer")
def aes_no_key(spark, sf_dir):
    df, sealed = _sealed(spark, sf_dir, AES)
    return sealed.select("c_custkey", fr.decode(F.col("frame"), df.schema, mode="PERMISSIVE")["error_class"].alias("error_class"))


@query("aes_tampered_header", "SELECT c_custkey, 'INTEGRITY' AS error_class FROM customer")
def aes_tampered_header(spark, sf_dir):
    """The header is bound to the sealed bytes: another key id in it is found out."""
    df, sealed = _sealed(spark, sf_dir, AES)
    other = F.unhex(F.regexp_replace(F.hex("frame"), "036B31", "036B32"))
    return sealed.select("c_custkey", fr.decode(other, df.schema, options=AES, mode="PERMISSIVE")["error_class"].alias("error_class"))


@query("policy_downgrade", "SELECT c_custkey, 'INTEGRITY' AS unencrypted, 'INTEGRITY' AS unchecked FROM customer")
def policy_downgrade(spark, sf_dir):
    """Readers that require protection refuse frames without it."""
    df = table(spark, sf_dir, "customer")
    plain = df.select("c_custkey", fr.encode(row(df), df.schema).alias("frame"))
    read = lambda o: fr.decode(F.col("frame"), df.schema, options=o, mode="PERMISSIVE")["error_class"]
    return plain.select("c_custkey", read(AES).alias("unencrypted"), read(Options(checksum="crc32", require_checksum=True)).alias("unchecked"))


@query("v0_needs_permission", "SELECT r_regionkey, 'FORMAT' AS refused, r_name FROM region")
def v0_needs_permission(spark, sf_dir):
    df = table(spark, sf_dir, "region")
    bare = df.select("r_regionkey", fr.encode(row(df), df.schema, options=Options(version=0)).alias("p"))
    refused = fr.decode(F.col("p"), df.schema, mode="PERMISSIVE")["error_class"]
    return bare.select("r_regionkey", refused.alias("refused"), fr.decode(F.col("p"), df.schema, options=Options(allow_v0=True))["r_name"].alias("r_name"))


@query("limit_string_bytes", "SELECT doc_id, CASE WHEN octet_length(encode(text)) > 500 THEN 'LIMIT' END AS error_class FROM documents")
def limit_string_bytes(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    frame = fr.encode(row(df), df.schema)
    return df.select("doc_id", fr.decode(frame, df.schema, options=Options(limits=Limits(max_string_bytes=500)), mode="PERMISSIVE")["error_class"].alias("error_class"))


@query("limit_collection_length", "SELECT o_custkey, CASE WHEN count(*) > 10 THEN 'LIMIT' END AS error_class FROM orders GROUP BY 1")
def limit_collection_length(spark, sf_dir):
    df = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("k"))
    schema = T.ArrayType(T.LongType(), False)
    return df.select("o_custkey", fr.decode(fr.encode(F.col("k"), schema), schema, options=Options(limits=Limits(max_collection_length=10)), mode="PERMISSIVE")["error_class"].alias("error_class"))


@query("truncated_frames", "SELECT n_nationkey, 'FORMAT' AS decoded, 'FORMAT' AS error_class, CAST(0 AS BIGINT) AS offset FROM nation")
def truncated_frames(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    frame = fr.encode(row(df), df.schema)
    cut = F.substring(frame, F.lit(1), F.octet_length(frame) - 1)
    read = df.select("n_nationkey", fr.decode(cut, df.schema, mode="PERMISSIVE")["error_class"].alias("decoded"), fr.failure(cut, df.schema).alias("f"))
    return read.select("n_nationkey", "decoded", "f.error_class", F.coalesce("f.failure_offset", F.lit(0)).alias("offset"))


@query("failure_path", "SELECT n_nationkey, 'FORMAT' AS error_class, 'Object.n_name' AS path FROM nation")
def failure_path(spark, sf_dir):
    """Where a payload breaks: text that is no UTF-8."""
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    schema = required(df.schema)
    frame = _tamper(fr.encode(row(df), schema), 8)
    f = df.select("n_nationkey", fr.failure(_bad_text(frame, 4), schema).alias("f"))
    return f.select("n_nationkey", "f.error_class", F.col("f.failure_path").alias("path"))


def _bad_text(frame, at):
    return F.concat(F.substring(_tamper(frame, 8), F.lit(1), F.octet_length(frame) - 5), F.unhex(F.lit("FFFFFFFFFF")))


# ---------------------------------------------------------------- streams of frames, inspection


@query("frames_of_orders", "SELECT * FROM orders")
def frames_of_orders(spark, sf_dir):
    """A customer's frames laid end to end, split again and read."""
    df = table(spark, sf_dir, "orders")
    framed = df.select("o_custkey", fr.encode(row(df), df.schema).alias("frame"), F.col("o_orderkey").alias("k"))
    joined = fr.concat_chunks(framed, ["o_custkey"], "k", "frame")
    return joined.select(F.inline(fr.split(F.col("data")))).select(fr.decode(F.col("frame"), df.schema).alias("v")).select("v.*")


@query("split_offsets", "SELECT o_custkey, count(*) AS frames, count(*) - 1 AS last_ordinal FROM orders GROUP BY 1")
def split_offsets(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    framed = df.select("o_custkey", fr.encode(F.col("o_orderkey"), T.LongType(), nullable=False).alias("frame"), F.col("o_orderkey").alias("k"))
    parts = fr.concat_chunks(framed, ["o_custkey"], "k", "frame").select("o_custkey", F.inline(fr.split(F.col("data"))))
    return parts.where(F.col("offset") == F.col("ordinal") * 16).groupBy("o_custkey").agg(F.count("*").alias("frames"), F.max("ordinal").cast("bigint").alias("last_ordinal"))


@query("v0_split", "SELECT n_regionkey, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation GROUP BY 1")
def v0_split(spark, sf_dir):
    """Headerless payloads end where their value does."""
    df = table(spark, sf_dir, "nation")
    o = Options(version=0, allow_v0=True)
    bare = df.select("n_regionkey", fr.encode(row(df), df.schema, options=o).alias("p"), F.col("n_nationkey").alias("k"))
    parts = fr.concat_chunks(bare, ["n_regionkey"], "k", "p").select(F.inline(fr.split(F.col("data"), o, df.schema)))
    v = parts.select(fr.decode(F.col("frame"), df.schema, options=o).alias("v"))
    return v.groupBy("v.n_regionkey").agg(F.sum("v.n_nationkey").alias("total"))


@query("frames_source_orders", "SELECT * FROM orders")
def frames_source_orders(spark, sf_dir):
    """Written by the data source, read by Spark's file reader."""
    df = table(spark, sf_dir, "orders")
    source.register(spark)
    path = fresh(spark, "orders")
    df.select(fr.encode(row(df), df.schema).alias("frame")).write.format("frames").mode("append").save(path)
    return source.read_frames(spark, path).select(fr.decode(F.col("frame"), df.schema).alias("v")).select("v.*")


@query("frames_source_read_customers", "SELECT * FROM customer")
def frames_source_read_customers(spark, sf_dir):
    """Written and read by the data source."""
    df = table(spark, sf_dir, "customer")
    source.register(spark)
    path = fresh(spark, "customers")
    df.select(fr.encode(row(df), df.schema).alias("frame")).write.format("frames").mode("append").save(path)
    return spark.read.format("frames").load(path).select(fr.decode(F.col("frame"), df.schema).alias("v")).select("v.*")


@query("frames_source_v0", "SELECT * FROM orders")
def frames_source_v0(spark, sf_dir):
    """Headerless payloads, written and read by the data source with their schema."""
    df = table(spark, sf_dir, "orders")
    source.register(spark)
    path, o = fresh(spark, "orders-v0"), Options(version=0, allow_v0=True)
    df.select(fr.encode(row(df), df.schema, options=o).alias("frame")).write.format("frames").option("payload", df.schema.json()).mode("append").save(path)
    return spark.read.format("frames").option("payload", df.schema.json()).load(path).select(fr.decode(F.col("frame"), df.schema, options=o).alias("v")).select("v.*")


@query("frames_stream_events", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def frames_stream_events(spark, sf_dir):
    """Frames through a streaming query, from the data source to the data source."""
    df = table(spark, sf_dir, "events")
    source.register(spark)
    raw, out = fresh(spark, "events"), fresh(spark, "events-out")
    df.select(fr.encode(row(df), df.schema).alias("frame")).write.format("frames").mode("append").save(raw)
    stream = spark.readStream.format("frames").load(raw).select("frame")
    q = stream.writeStream.format("frames").option("path", out).option("checkpointLocation", fresh(spark, "events-log")).trigger(once=True).start()
    q.awaitTermination()
    return source.read_frames(spark, out).select(fr.decode(F.col("frame"), df.schema).alias("v")).groupBy(F.col("v.event_type").alias("event_type")).agg(F.count("*").alias("n"))


@query("dump_node_count", "SELECT o_orderkey, CAST(7 AS BIGINT) AS nodes FROM orders")
def dump_node_count(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    nodes = df.select("o_orderkey", fr.dump(fr.encode(row(df), df.schema), df.schema).alias("n"))
    return nodes.select("o_orderkey", F.size("n").cast("bigint").alias("nodes"))


@query("dump_values", "SELECT n_nationkey, 'n_name' AS name, '\"' || n_name || '\"' AS value FROM nation")
def dump_values(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    nodes = df.select("n_nationkey", F.inline(fr.dump(fr.encode(row(df), df.schema), df.schema)))
    return nodes.where("name = 'n_name'").select("n_nationkey", "name", "value")


@query("dump_header_lines", "SELECT r_regionkey, unnest(['V1 frame', 'checksum', 'payload']) AS word, true AS there FROM region")
def dump_header_lines(spark, sf_dir):
    """The report of a header names the version, the checksum's algorithm with its bytes, and the payload's length."""
    df = table(spark, sf_dir, "region")
    frame = fr.encode(row(df), df.schema, options=Options(checksum="crc32"))
    made = df.select("r_regionkey", frame.alias("frame")).select("r_regionkey", fr.dump(F.col("frame"), form="text").alias("t"), fr.header(F.col("frame")).alias("h"))
    digits = F.rtrim(F.regexp_replace(F.hex("h.checksum"), "(..)", "$1 "))
    lines = F.split("t", "\n")
    first = lines[0] == F.concat(F.lit("V1 frame \u00b7 "), F.col("h.header_length") + F.col("h.on_disk_length"), F.lit(" bytes \u00b7 header "), F.col("h.header_length"), F.lit(" bytes"))
    second = lines[1].contains("Crc32") & lines[1].contains(digits) & lines[1].endswith("verified")
    third = lines[2] == F.concat(F.lit("payload "), F.col("h.on_disk_length"), F.lit(" bytes"))
    told = F.array(*[F.struct(F.lit(w).alias("word"), c.alias("there")) for w, c in (("V1 frame", first), ("checksum", second), ("payload", third))])
    return made.select("r_regionkey", F.inline(told))


LENGTH = "octet_length(encode(r_name))"
# The renderings of a frame of (r_name, r_regionkey), written out with the lengths that its bytes have.
RENDERED = f"""SELECT r_regionkey,
  'V1 frame · ' || ({LENGTH} + 13) || ' bytes · header 8 bytes' || chr(10) || 'payload ' || ({LENGTH} + 5) || ' bytes as Region · depth 2 · 3 nodes' || chr(10) || '@0000  ' || rpad('Region', 48, ' ') || 'object · 2 members' || chr(10)
  || '@0000  ├─ ' || rpad('r_name', 28, ' ') || rpad('String', 17, ' ') || '"' || r_name || '"' || chr(10) || '@' || lpad(hex({LENGTH} + 1), 4, '0') || '  └─ ' || rpad('r_regionkey', 28, ' ') || rpad('Int32', 17, ' ') || r_regionkey || chr(10) AS text,
  '{{"version": 1, "frame_length": ' || ({LENGTH} + 13) || ', "header_length": 8, "payload_length": ' || ({LENGTH} + 5) || ', "header": {{"version": 1, "references": false, "compression": "None", "compression_name": null, "uncompressed_length": null, '
  || '"checksum_algorithm": "None", "checksum_name": null, "checksum": "", "encryption": "None", "encryption_name": null, "key_id": null, "header_length": 8, "on_disk_length": ' || ({LENGTH} + 5) || '}}, "checksum_verified": null, "decrypted": null, '
  || '"max_depth": 2, "node_count": 3, "root": {{"name": "Region", "type": "Region", "kind": "Object", "offset": 0, "length": ' || ({LENGTH} + 5) || ', "children": [{{"name": "r_name", "type": "String", "kind": "Scalar", "offset": 0, "length": '
  || ({LENGTH} + 1) || ', "value": "\\"' || r_name || '\\""}}, {{"name": "r_regionkey", "type": "Int32", "kind": "Scalar", "offset": ' || ({LENGTH} + 1) || ', "length": 4, "value": "' || r_regionkey || '"}}]}}}}' AS json,
  '<dump version="1" frame_length="' || ({LENGTH} + 13) || '" header_length="8" payload_length="' || ({LENGTH} + 5) || '" max_depth="2" node_count="3"><header version="1" references="false" compression="None" checksum_algorithm="None" checksum="" encryption="None" '
  || 'header_length="8" on_disk_length="' || ({LENGTH} + 5) || '"/><node name="Region" type="Region" kind="Object" offset="0" length="' || ({LENGTH} + 5) || '"><node name="r_name" type="String" kind="Scalar" offset="0" length="' || ({LENGTH} + 1)
  || '" value=''"' || r_name || '"''></node><node name="r_regionkey" type="Int32" kind="Scalar" offset="' || ({LENGTH} + 1) || '" length="4" value="' || r_regionkey || '"></node></node></dump>' AS xml,
  '@0000  ' || rpad(trim(regexp_replace(lpad(hex({LENGTH} + 1), 2, '0') || upper(hex(encode(r_name))) || upper({_le('r_regionkey', 4)}), '(..)', '\\1 ', 'g')), 47, ' ') || '  Region.r_name' || chr(10) AS hex
FROM (SELECT r_regionkey, r_name FROM region) AS r"""


@query("dump_texts", RENDERED)
def dump_texts(spark, sf_dir):
    """Every rendering of a frame, letter by letter."""
    df = table(spark, sf_dir, "region")
    schema = T.StructType([T.StructField("r_regionkey", T.IntegerType(), False), T.StructField("r_name", T.StringType())])
    frame = fr.encode(F.struct("r_regionkey", "r_name"), schema, {"type": "Region"}, nullable=False)
    return df.select("r_regionkey", *[fr.dump(frame, schema, {"type": "Region"}, form=f, nullable=False).alias(f) for f in ("text", "json", "xml", "hex")])


@query("dump_renderings")
def dump_renderings(spark, sf_dir):
    """All renderings of a frame; their text has no SQL form."""
    df = table(spark, sf_dir, "region")
    frame = fr.encode(row(df), df.schema, {"type": "Region"}, Options(checksum="crc32", compression="deflate"))
    return df.select("r_regionkey", *[fr.dump(frame, df.schema, {"type": "Region"}, form=f).alias(f) for f in ("text", "json", "xml", "hex")])


@query("compare_orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Object.o_orderstatus' END AS path FROM orders")
def compare_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    changed = df.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.concat("o_orderstatus", F.lit("!"))).otherwise(F.col("o_orderstatus")))
    pair = df.select("o_orderkey", fr.encode(row(df), df.schema).alias("a")).join(changed.select(F.col("o_orderkey").alias("k"), fr.encode(row(changed), df.schema).alias("b")), F.col("o_orderkey") == F.col("k"))
    return pair.select("o_orderkey", fr.compare(F.col("a"), F.col("b"), df.schema)["path"].alias("path"))


@query("sql_functions", "SELECT c_custkey, c_name, 1 AS version, CAST(6 AS BIGINT) AS nodes FROM customer")
def sql_functions(spark, sf_dir):
    """The same surface in SQL: encoder, decoder, header and a table function for dumps."""
    df = table(spark, sf_dir, "customer")
    fsql.register(spark, Context().add("customer_frame", df.schema))
    df.createOrReplaceTempView("fw_customer")
    frames = spark.sql("SELECT c_custkey, encode_customer_frame(struct(*)) AS frame FROM fw_customer")
    frames.createOrReplaceTempView("fw_frames")
    return spark.sql(
        "SELECT f.c_custkey, first(decode_customer_frame(f.frame).c_name) AS c_name, first(frame_header(f.frame).version) AS version, count(*) AS nodes "
        "FROM fw_frames f, LATERAL dump_customer_frame(f.frame) GROUP BY f.c_custkey"
    )


@query("aes_sql_customers", "SELECT c_custkey, c_name, 'Aes256Gcm' AS encryption, false AS readable, CAST(6 AS BIGINT) AS nodes FROM customer")
def aes_sql_customers(spark, sf_dir):
    """Sealed by SQL, opened by SQL; the name isn't readable in the sealed bytes."""
    df = table(spark, sf_dir, "customer")
    fsql.register(spark, Context().add("sealed_customer", df.schema), Options(encryption="aes256gcm", keys=Keys(fixed=KEY), key_id="k1", require_encryption=True))
    df.createOrReplaceTempView("fw_customer")
    sealed = spark.sql("SELECT c_custkey, c_name, encode_sealed_customer(struct(*)) AS frame FROM fw_customer")
    sealed.selectExpr("*", "frame_opened(frame) AS opened").createOrReplaceTempView("fw_sealed")
    return spark.sql(
        "SELECT f.c_custkey, first(decode_sealed_customer(f.frame).c_name) AS c_name, first(frame_header(f.frame).encryption) AS encryption, "
        "first(instr(hex(f.frame), hex(f.c_name)) > 0) AS readable, count(*) AS nodes FROM fw_sealed f, LATERAL dump_sealed_customer(f.frame, f.opened) GROUP BY f.c_custkey"
    )


@query("checksums_of_names")
def checksums_of_names(spark, sf_dir):
    """Checksum bytes as frames carry them; SQL has no such functions."""
    df = table(spark, sf_dir, "customer")
    return df.select("c_custkey", *[F.hex(fr.checksum(F.encode("c_name", "UTF-8"), a)).alias(a) for a in ("crc32", "xxh3", "xxh128")])


# CRC-32, XXH3-64 and XXH3-128 of the five names, by the published algorithms, in the byte order of frames.
SUMS = """('AFRICA', '25C9B566', '5AA141D88ACE4F0C', '150937C2D9B1556EFA4AAEBC4E444CBE'), ('AMERICA', '9E730598', 'FCB5914837539001', 'BFADDF07D3635CE931DEB669FA686C85'),
('ASIA', 'E7F5764C', '206960AC7DC20633', '6767C9F9D26BDCD8E152AC2C3D9D8122'), ('EUROPE', '589F6BB8', '35367DF723E3FDEA', '7AAB68E4A03E50446F95ED594D7D31AE'),
('MIDDLE EAST', '2628A007', '8FA89239B4F6B131', '92CD8EA8D846AC7D48DFD9C0CF218F21')"""


@query("checksums_of_regions", f"SELECT r_regionkey, crc32, xxh3, xxh128 FROM region JOIN (VALUES {SUMS}) AS s(name, crc32, xxh3, xxh128) ON r_name = name")
def checksums_of_regions(spark, sf_dir):
    df = table(spark, sf_dir, "region")
    return df.select("r_regionkey", *[F.hex(fr.checksum(F.encode("r_name", "UTF-8"), a)).alias(a) for a in ("crc32", "xxh3", "xxh128")])


@query("flagship_orders", "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1")
def flagship(spark, sf_dir):
    """Orders through frames and back, then a grouped total."""
    df = table(spark, sf_dir, "orders")
    v = df.select(fr.decode(fr.encode(row(df), df.schema), df.schema).alias("v"))
    return v.groupBy(F.col("v.o_orderstatus").alias("o_orderstatus")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("v.o_totalprice") * 100).cast("bigint")).alias("cents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
