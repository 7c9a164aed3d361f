"""The ``frames`` data source: files of frames laid end to end.

    spark.read.format("frames").load("/dir")             path, ordinal, offset, frame
    spark.readStream.format("frames").load("/dir")       the same, as files appear and grow
    df.write.format("frames").mode("append").save(path)  of a column named frame

Options: ``payload``, the schema (DDL or JSON) of headerless payloads, which end where their value does, and ``nullable``, whether that value may
be null (default true); ``writer``, a name for a streaming query that shares its path with another.

A row is one frame and limits hold for each. Reading is by Arrow's file systems (local and shared folders, hdfs, s3, gs, abfs); a path without a scheme is of the session's
``fs.defaultFS``, as for Spark's own sources. For every other store use ``read_frames``, which goes through Spark's ``binaryFile`` reader.

Writers make a new file a task and rename it into place when the job commits; old files of an overwritten path go after that, and a failed job's
own files are removed, those of failed tasks too. A stream's files are named by its batch: a batch that is run again replaces its files or, once
committed, leaves them as they are. A stream's offset is the size of each file, so the driver reads no data; a task gives the frames
that end in its part of a file, and a torn last frame waits until it is whole. Of a file that has grown, a task steps over the older frames by their headers.
"""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from framewright.functions import envelope as E
from framewright.functions import header as H
from framewright.functions.errors import ConfigurationError, FormatError, StreamError
from framewright.functions.options import Options
from framewright.functions.schema import compile_schema
from framewright.functions.ship import ship

CHUNK = 1 << 20
PLAIN = H.MAGIC + bytes([1, 0, 0])


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    store, at = _fs(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    if info.type == fs.FileType.NotFound:
        return []
    found = store.get_file_info(fs.FileSelector(at, recursive=False))
    return sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))


class Settings:
    """What the options say: path, codec of headerless payloads, the writer's name."""

    def __init__(self, options, default_fs: str = "file:///"):
        path = options.get("path")
        if not path:
            raise ConfigurationError("the frames source needs a path")
        self.path = path if "://" in path or default_fs.startswith("file:") else default_fs.rstrip("/") + "/" + path.lstrip("/")
        self.writer = options.get("writer") or ""
        kind = options.get("payload")
        self.codec = compile_schema(_kind(kind), nullable=str(options.get("nullable") or "true").lower() == "true") if kind else None
        self.options = Options(allow_v0=self.codec is not None)


def _kind(text: str) -> T.DataType:
    """A schema from JSON or from simple DDL; the planner's process has no session to parse more."""
    try:
        return T._parse_datatype_json_string(text)
    except ValueError:
        fields = [f.strip().split(None, 1) for f in text.split(",")]
        plain = {t.typeName(): t for t in (T.LongType(), T.IntegerType(), T.ShortType(), T.ByteType(), T.StringType(), T.DoubleType(), T.FloatType(), T.BooleanType(), T.BinaryType(), T.DateType(), T.TimestampType(), T.TimestampNTZType())}
        named = plain | {"bigint": T.LongType(), "int": T.IntegerType(), "smallint": T.ShortType(), "tinyint": T.ByteType()}
        try:
            return T.StructType([T.StructField(n, named[t.strip().lower()]) for n, t in fields])
        except (KeyError, ValueError) as e:
            raise ConfigurationError(f"{text} is no schema in JSON or of plain columns") from e


def _frames(settings: Settings, path: str, start: int, end: int, torn: bool = False):
    """(ordinal, offset, frame) of the frames that end after ``start`` and by ``end``, a buffer at a time. ``torn``: the last may be cut off."""
    store, _ = _fs(settings.path)
    try:
        with store.open_input_file(path) as f:
            buffer, pos, at, ordinal = b"", 0, 0, 0  # ``at``: where in the file the frame begins that is at ``pos`` in the buffer
            while True:
                here = at + len(buffer) - pos
                size = _size(buffer, pos, settings, here >= end and not torn)
                if size is not None and at + size > end:
                    break
                if size is not None and (at + size <= here or at + size <= start):
                    if at + size > start:
                        yield ordinal, at, buffer[pos : pos + size]
                    at, pos, ordinal = at + size, pos + size, ordinal + 1
                    if pos > len(buffer):  # an older frame: step over the rest of it
                        buffer, pos = b"", 0
                        f.seek(at)
                    continue
                need = CHUNK if size is None else max(CHUNK, at + size - here)
                data = f.read(min(max(need, len(buffer) - pos), end - here)) if end > here else b""
                if not data:
                    break
                buffer, pos = buffer[pos:] + data, 0
            if at < end and not torn:
                raise FormatError(f"{path} ends inside a frame at {at}")
    except OSError as e:
        raise StreamError(f"{path} can't be read: {e}") from e


def _size(buffer: bytes, pos: int, settings: Settings, whole: bool) -> int | None:
    """The length of the frame at ``pos``, or None if more is needed to tell."""
    head = buffer[pos : pos + 16]
    if not head:
        return None
    if head.startswith(PLAIN) and len(head) > len(PLAIN) + 2:  # no services, and a short one: only its length to read
        n = head[len(PLAIN)]
        if n < 128:
            return len(PLAIN) + 1 + n
        if 0 < head[len(PLAIN) + 1] < 128:
            return len(PLAIN) + 2 + (n & 127 | head[len(PLAIN) + 1] << 7)
    if settings.codec is not None and not H.recognized(head) and not (len(head) < 16 and H.MAGIC.startswith(head[:4])):
        window = 1 << 12
        while True:  # values are short beside the buffer, mostly
            try:
                return E.measure(buffer[pos : pos + window], 0, settings.options, settings.codec)
            except FormatError:
                if pos + window >= len(buffer):
                    if whole:
                        raise
                    return None  # it may only be cut off
                window *= 8
    head = buffer[pos : pos + H.LONGEST]
    try:
        h = H.read(head, settings.options.limits)
    except FormatError:
        if len(head) < H.LONGEST and H.MAGIC.startswith(head[:4]) and not whole:
            return None
        raise
    return h.length + h.on_disk


class FilePartition(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class FramesReader(DataSourceReader):
    def __init__(self, settings: Settings):
        self.settings = settings

    def partitions(self):
        return [FilePartition(p, 0, n) for p, n in _files(self.settings.path)] or [FilePartition("", 0, 0)]

    def read(self, partition):
        if partition.path:
            for ordinal, at, frame in _frames(self.settings, partition.path, 0, partition.end):
                yield partition.path, ordinal, at, frame


class FramesStreamReader(DataSourceStreamReader):
    """Offsets: the size of each file."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def initialOffset(self):
        return {"files": "{}"}

    def latestOffset(self):
        return {"files": json.dumps(dict(_files(self.settings.path)), sort_keys=True)}

    def partitions(self, start, end):
        before, after = json.loads(start["files"]), json.loads(end["files"])
        return [FilePartition(p, before.get(p, 0), n) for p, n in sorted(after.items()) if n > before.get(p, 0)]

    def read(self, partition):
        for ordinal, at, frame in _frames(self.settings, partition.path, partition.start, partition.end, torn=True):
            yield partition.path, ordinal, at, frame

    def commit(self, end):
        pass


class Written(WriterCommitMessage):
    def __init__(self, temporary: str, part: int):
        self.temporary, self.part = temporary, part


class _Writing:
    """A file a task, renamed on commit. All files of a job in the making begin with its own name."""

    def __init__(self, settings: Settings, overwrite: bool = False):
        self.settings, self.overwrite, self.job = settings, overwrite, uuid.uuid4().hex

    def write(self, rows):
        from pyspark import TaskContext

        store, root = _fs(self.settings.path)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        temporary = f"{root}/_{self.job}-{part:05d}-{uuid.uuid4().hex}"
        try:
            with store.open_output_stream(temporary) as out:
                for row in rows:
                    data = bytes(row.frame)
                    if E.measure(data, 0, self.settings.options, self.settings.codec) != len(data):
                        raise FormatError("a row holds more than one frame")
                    out.write(data)
        except OSError as e:
            raise StreamError(f"{temporary} can't be written: {e}") from e
        return Written(temporary, part)

    def _abort(self, messages=()):
        """Remove what this job has written so far, of tasks that failed too."""
        from pyarrow import fs

        store, root = _fs(self.settings.path)
        for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if i.base_name.startswith(f"_{self.job}-"):
                store.delete_file(i.path)


class FramesWriter(_Writing, DataSourceWriter):
    def commit(self, messages):
        store, root = _fs(self.settings.path)
        old = [p for p, _ in _files(self.settings.path)] if self.overwrite else []
        for m in messages:
            if m is not None:
                store.move(m.temporary, f"{root}/part-{m.part:05d}-{self.job}.frames")
        for p in old:
            store.delete_file(p)
        self._abort()  # what tasks left that were run twice

    def abort(self, messages):
        self._abort()


class FramesStreamWriter(_Writing, DataSourceStreamWriter):
    def commit(self, messages, batchId):
        from pyarrow import fs

        store, root = _fs(self.settings.path)
        store.create_dir(root, recursive=True)
        name = f"batch-{self.settings.writer}{'-' if self.settings.writer else ''}{batchId:012d}"
        done = f"{root}/_done-{name}"
        if store.get_file_info(done).type == fs.FileType.NotFound:
            for p, _ in _files(self.settings.path):  # of a commit that broke off
                if p.rsplit("/", 1)[-1].startswith(f"{name}-"):
                    store.delete_file(p)
            for m in messages:
                if m is not None:
                    store.move(m.temporary, f"{root}/{name}-{m.part:05d}.frames")
            store.open_output_stream(done).close()
        self._abort()

    def abort(self, messages, batchId):
        self._abort()


def source_class(root: str, default_fs: str = "file:///") -> type[DataSource]:
    """The source. Spark's streaming planner starts without the package, so the class carries itself and where the package is."""

    class FramesSource(DataSource):
        @classmethod
        def name(cls):
            return "frames"

        def schema(self):
            return "path string, ordinal int, offset bigint, frame binary"

        def _module(self):
            import importlib
            import sys

            if root not in sys.path:
                sys.path.append(root)
            return importlib.import_module("framewright.sources.frames")

        def _settings(self):
            return self._module().Settings(self.options, default_fs)

        def reader(self, schema):
            return self._module().FramesReader(self._settings())

        def streamReader(self, schema):
            return self._module().FramesStreamReader(self._settings())

        def writer(self, schema, overwrite):
            return self._module().FramesWriter(self._settings(), overwrite)

        def streamWriter(self, schema, overwrite):
            return self._module().FramesStreamWriter(self._settings(), overwrite)

    return FramesSource


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship(spark)
    default_fs = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    spark.dataSource.register(source_class(str(Path(__file__).resolve().parents[2]), default_fs))


def read_frames(spark: SparkSession, path: str, options: Options | None = None) -> DataFrame:
    """path, ordinal, offset, frame of all files, through Spark's own file reader; a file is a buffer of at most 2 GB."""
    from framewright.operators.frames import split

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.select("path", F.inline(split(F.col("content"), options or Options())))
