"""Files and streams of frames, populating tables, and failures in queries."""

import glob

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.options import Options
from framewright.operators import frames as fr
from framewright.sources import frames as source
from framewright.streaming import merge

KEYED = T.StructType([T.StructField("id", T.LongType(), False, {"key": 1}), T.StructField("a", T.StringType(), True, {"key": 2}), T.StructField("b", T.IntegerType(), True, {"key": 3})])


def frames(spark, n, start=0):
    return fr.prepare(spark.range(start, start + n)).select(fr.encode(F.col("id"), T.LongType(), nullable=False).alias("frame"))


def ids(df):
    return sorted(r.v for r in df.select(fr.decode(F.col("frame"), T.LongType(), nullable=False).alias("v")).collect())


def test_write_append_overwrite_read(spark, tmp_path):
    source.register(spark)
    path = str(tmp_path / "f")
    frames(spark, 10).write.format("frames").mode("append").save(path)
    frames(spark, 5, 10).write.format("frames").mode("append").save(path)
    assert ids(spark.read.format("frames").load(path)) == list(range(15)) == ids(source.read_frames(spark, path))
    frames(spark, 3).write.format("frames").mode("overwrite").save(path)
    assert ids(spark.read.format("frames").load(path)) == [0, 1, 2]
    assert not glob.glob(f"{path}/_*")


def test_failed_write_leaves_nothing(spark, tmp_path):
    source.register(spark)
    path = str(tmp_path / "f")
    with pytest.raises(Exception):
        spark.createDataFrame([(b"no frame",)], "frame binary").write.format("frames").mode("append").save(path)
    assert not glob.glob(f"{path}/*")


def test_torn_file(spark, tmp_path):
    source.register(spark)
    data = b"".join(bytes(r.frame) for r in frames(spark, 3).collect())
    (tmp_path / "x.frames").write_bytes(data[:-1])
    with pytest.raises(Exception, match="inside a frame"):
        spark.read.format("frames").load(str(tmp_path)).collect()


def test_stream_waits_for_whole_frames(spark, tmp_path):
    source.register(spark)
    data = b"".join(bytes(r.frame) for r in frames(spark, 4).collect())
    path, out, log = tmp_path / "in", tmp_path / "out", str(tmp_path / "log")
    path.mkdir()
    size = len(data) // 4
    for stop, seen in ((2 * size + 3, 2), (3 * size, 3), (len(data), 4)):
        (path / "x.frames").write_bytes(data[:stop])
        q = spark.readStream.format("frames").load(str(path)).select("frame").writeStream.format("frames").option("path", str(out)).option("checkpointLocation", log).trigger(once=True).start()
        q.awaitTermination()
        assert ids(source.read_frames(spark, str(out))) == list(range(seen))


def test_populate_stream(spark, tmp_path):
    source.register(spark)
    state = {"t": spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "id bigint, a string, b int")}
    change = T.StructType([KEYED["id"], KEYED["a"]])
    rows = spark.createDataFrame([(2, "new"), (3, "added")], "id bigint, a string")
    rows.coalesce(1).select(fr.encode(F.struct("id", "a"), change, {"layout": "keyed"}).alias("frame")).write.format("frames").mode("append").save(str(tmp_path / "in"))

    def save(df, _):
        state["t"] = spark.createDataFrame(df.collect(), df.schema)

    q = merge.populate_stream(spark.readStream.format("frames").load(str(tmp_path / "in")), lambda: state["t"], save, KEYED, "id", str(tmp_path / "log"))
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, state["t"].collect())) == [(1, "x", 1), (2, "new", 2), (3, "added", None)]


def test_merge_keeps_a_written_null(spark):
    target = spark.createDataFrame([(1, "x", 1)], "id bigint, a string, b int")
    part = T.StructType([KEYED["id"], KEYED["a"]])
    f = fr.prepare(spark.createDataFrame([(1, None)], "id bigint, a string")).select(F.lit(0).alias("offset"), fr.encode(F.struct("id", "a"), part, {"layout": "keyed"}).alias("frame"))
    assert [tuple(r) for r in merge.merge_batch(target, f, KEYED, "id").collect()] == [(1, None, 1)]


def test_modes(spark):
    df = fr.prepare(spark.createDataFrame([(b"BSER\x01\x00\x00\x01\x02x",), (None,), (b"junk",), (b"",)], "frame binary"))
    out = df.select(fr.decode(F.col("frame"), T.StringType(), mode="PERMISSIVE").alias("d")).select("d.*").collect()
    assert [(r.value, r.error_class) for r in out] == [(None, "FORMAT"), (None, None), (None, "FORMAT"), (None, "FORMAT")]
    with pytest.raises(PythonException, match="no frame"):
        df.where("frame = CAST('junk' AS BINARY)").select(fr.decode(F.col("frame"), T.StringType())).collect()


def test_peek(spark):
    df = spark.createDataFrame([(b"BSER\x01\x00\x00\x01\x02",), (b"none",), (b"BSER\x01\x00\x01",), (None,)], "frame binary")
    out = [r.h for r in fr.prepare(df).select(fr.header(F.col("frame")).alias("h")).collect()]
    assert out[0].on_disk_length == 1 and out[1] is None and out[2].error_class == "FORMAT" and out[3] is None


def test_random_nonces_differ_and_decrypt(spark):
    from framewright.functions.keys import Keys

    o = Options(encryption="aes256gcm", keys=Keys(fixed=bytes(32)))
    df = fr.prepare(spark.createDataFrame([("same",)] * 5, "s string")).select(fr.encode(F.col("s"), T.StringType(), options=o).alias("frame")).checkpoint()
    assert df.distinct().count() == 5
    assert {r.v for r in df.select(fr.decode(F.col("frame"), T.StringType(), options=o).alias("v")).collect()} == {"same"}


def test_latest(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, o int, v string")
    assert sorted(map(tuple, merge.latest(df, "k", "o").collect())) == [(1, 2, "b"), (2, 1, "c")]


@pytest.mark.parametrize("cipher", ["aes256gcm", "chacha20poly1305"])
def test_every_encoder_seals(spark, cipher):
    """Columns, SQL and graphs: no frame holds the text or the key, no plan holds the key, and each reads back."""
    from framewright.functions.keys import Keys
    from framewright.functions.schema import Context
    from framewright.operators import graphs
    from framewright.operators import sql as fsql

    key, text = b"\x07key-of-32-bytes-for-this-test!!\x08"[:32], "top secret text"
    o = Options(encryption=cipher, keys=Keys(fixed=key), key_id="k1", require_encryption=True)
    kind = T.StructType([T.StructField("s", T.StringType())])
    df = fr.prepare(spark.createDataFrame([(text,)], "s string"))
    fsql.register(spark, Context().add("secret", kind), o)
    df.createOrReplaceTempView("fw_secrets")
    column = df.select(fr.encode(F.struct("s"), kind, options=o).alias("frame"))
    by_sql = spark.sql("SELECT encode_secret(struct(s)) AS frame FROM fw_secrets")
    for made in (column, by_sql):
        assert key.hex().upper() not in made._jdf.queryExecution().toString().upper()
        for back in (made.select(fr.decode(F.col("frame"), kind, options=o).alias("v")), made.selectExpr("decode_secret(frame) AS v")):
            assert key.hex().upper() not in back._jdf.queryExecution().toString().upper()
            assert back.first().v.s == text
        assert text.encode() not in bytes(made.first().frame)
    nodes = spark.createDataFrame([(1, 1, text, 2), (1, 2, text, 1)], "graph_id bigint, node_id bigint, s string, next bigint")
    go = Options(encryption=cipher, keys=Keys(fixed=key), references=True)
    sealed = graphs.encode_graphs(nodes, kind, ["next"], go).checkpoint()
    assert text.encode() not in bytes(sealed.first().frame)
    assert sorted((r.node_id, r.s, r.next) for r in graphs.decode_graphs(sealed, kind, ["next"], go).collect()) == [(0, text, 1), (1, text, 0)]


def test_a_replayed_batch_is_written_once(tmp_path):
    """A commit that broke off is done again; one that was finished stays as it is."""
    from pyspark import TaskContext

    class Row:
        def __init__(self, n):
            self.frame = b"BSER\x01\x00\x00\x02\x01" + bytes([n])

    def written(writer, *rows):
        return [writer.write(iter([Row(r)])) for r in rows]

    class Task:
        def partitionId(self):
            return self.k

    task = Task()
    settings = source.Settings({"path": str(tmp_path / "out")})
    first = source.FramesStreamWriter(settings)
    original, TaskContext.get = TaskContext.get, classmethod(lambda cls: task)
    try:
        def messages(writer, rows):
            out = []
            for task.k, r in enumerate(rows):
                out += written(writer, r)
            return out

        first.commit(messages(first, [1, 2]), 0)
        again = source.FramesStreamWriter(settings)
        again.commit(messages(again, [1, 2, 3]), 0)  # after a restart: batch 0 is done
        broken = messages(first, [4, 5, 6])
        store, root = source._fs(settings.path)
        store.move(broken[2].temporary, f"{root}/batch-{1:012d}-00002.frames")  # a commit that broke off
        source.FramesStreamWriter(settings).commit(messages(again, [4, 5]), 1)
        first.abort([], 1)
    finally:
        TaskContext.get = original
    names = [n for n, _ in source._files(settings.path)]
    assert [open(n, "rb").read()[-1] for n in names] == [1, 2, 4, 5]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_")) == ["_done-batch-000000000000", "_done-batch-000000000001"]


def test_paths_without_a_scheme_are_of_the_default_file_system():
    assert source.Settings({"path": "/a/b"}, "hdfs://n:8020").path == "hdfs://n:8020/a/b"
    assert source.Settings({"path": "/a/b"}).path == "/a/b" and source.Settings({"path": "s3://x/y"}, "hdfs://n").path == "s3://x/y"


def test_offsets_are_sizes_and_a_grown_file_is_read_from_where_it_was(tmp_path):
    def frame(n):
        return b"BSER\x01\x00\x00" + bytes([n & 127 | 128, n >> 7]) + bytes([n % 251]) * n if n > 127 else b"BSER\x01\x00\x00" + bytes([n]) + bytes([n % 251]) * n

    sizes = [3, 200, 0, 127, 128, 9000, 1, 16000, 50]
    data = b"".join(frame(n) for n in sizes)
    (tmp_path / "x.frames").write_bytes(data)
    settings = source.Settings({"path": str(tmp_path)})
    whole = list(source._frames(settings, str(tmp_path / "x.frames"), 0, len(data)))
    assert [len(f) - (9 if len(f) > 135 else 8) for _, _, f in whole] == sizes and [k for k, _, _ in whole] == list(range(9))
    for cut in range(0, len(data), 777):
        parts = [list(source._frames(settings, str(tmp_path / "x.frames"), a, b, torn=True)) for a, b in ((0, cut), (cut, len(data)))]
        assert parts[0] + parts[1] == whole
    reader = source.FramesStreamReader(settings)
    assert reader.latestOffset() == {"files": f'{{"{tmp_path}/x.frames": {len(data)}}}'}


def test_headerless_files(spark, tmp_path):
    """Payloads without headers, through the source, batch and streaming; values longer than a buffer too."""
    source.register(spark)
    o = Options(version=0, allow_v0=True)
    rows = [(k, "x" * (k * 997 % 5000 if k else 1_500_000)) for k in range(300)]
    df = fr.prepare(spark.createDataFrame(rows, "id bigint, s string"))
    path, kind = str(tmp_path / "v0"), "id bigint, s string"
    df.select(fr.encode(F.struct("id", "s"), df.schema, options=o).alias("frame")).write.format("frames").option("payload", kind).mode("append").save(path)
    read = spark.read.format("frames").option("payload", df.schema.json()).load(path)
    got = read.select(fr.decode(F.col("frame"), df.schema, options=o).alias("v")).select("v.*")
    assert sorted(map(tuple, got.collect())) == rows
    out = str(tmp_path / "out")
    q = spark.readStream.format("frames").option("payload", kind).load(path).select("frame").writeStream.format("frames").option("payload", kind).option("path", out).option("checkpointLocation", str(tmp_path / "log")).trigger(once=True).start()
    q.awaitTermination()
    assert spark.read.format("frames").option("payload", kind).load(out).count() == 300
    with pytest.raises(Exception, match="no schema"):
        spark.read.format("frames").option("payload", "a strange").load(path).collect()
