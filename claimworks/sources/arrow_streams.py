"""Arrow IPC streams as a table: read by byte ranges, written with a commit.

spark.read.format("arrow_stream").load(path) and df.write.format("arrow_stream").mode("append").save(folder). A path is a file
or a folder of .arrow files in any store that pyarrow opens (file, hdfs, viewfs, s3, gs).

A stream has no index, but each of its messages says how long it and its body are. The driver reads these lengths (a few
hundred bytes a record batch, no data) and cuts the stream into ranges of whole messages; a task seeks to its range and reads
it and the schema, so every record batch is read once and by one task.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of messages that a partition has at most, unless it is one record batch, and least number of partitions of a stream that has so many.
RANGE, LEAST = 16 << 20, 8
#: Kinds of messages by the Arrow format's union, and its end of a stream: fixed values.
SCHEMA, DICTIONARY, BATCH = 1, 2, 3
END = b"\xff\xff\xff\xff\x00\x00\x00\x00"


def opened(uri: str):
    """The file system of a path and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def stream_files(uri: str) -> list[str]:
    """A file's own name, or those of a folder's .arrow files in order."""
    from pyarrow import fs

    system, path = opened(uri)
    if system.get_file_info(path).type == fs.FileType.File:
        return [path]
    return sorted(x.path for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".arrow"))


@dataclass(frozen=True)
class Message:
    kind: int
    start: int
    end: int


def _field(table: bytes, root: int, number: int) -> int:
    """Where a flat buffer's table has its field, 0 if it has none."""
    slots = root - struct.unpack_from("<i", table, root)[0]
    at = 4 + 2 * number
    offset = struct.unpack_from("<H", table, slots + at)[0] if at < struct.unpack_from("<H", table, slots)[0] else 0
    return root + offset if offset else 0


def messages(source) -> Iterator[Message]:
    """The stream's messages, by their lengths alone; source: a file that can be read at any place."""
    at, size = 0, source.size()
    while at + 4 <= size:
        head = source.read_at(8, at)
        marked = head[:4] == b"\xff\xff\xff\xff"
        length = struct.unpack_from("<i", head, 4 if marked else 0)[0] if len(head) >= (8 if marked else 4) else 0
        if length == 0:
            return
        begin = at + (8 if marked else 4)
        meta = source.read_at(length, begin)
        root = struct.unpack_from("<I", meta, 0)[0]
        kind, body = _field(meta, root, 1), _field(meta, root, 3)
        end = begin + length + (struct.unpack_from("<q", meta, body)[0] if body else 0)
        if end > size:
            raise ValueError(f"the stream ends within its message at byte {at}")
        yield Message(meta[kind] if kind else 0, at, end)
        at = end


class Range(InputPartition):
    """Bytes of a stream, and those that have to be read before: its schema and earlier dictionaries."""

    def __init__(self, uri: str, path: str, first: list[tuple[int, int]], start: int, end: int):
        super().__init__((path, start))
        self.uri, self.path, self.first, self.start, self.end = uri, path, first, start, end


def ranges(uri: str, path: str, limit: int | None = None) -> list[Range]:
    """Ranges of whole record batches that together are the whole stream."""
    system, _ = opened(uri)
    out: list[Range] = []
    with system.open_input_file(path) as source:
        limit = limit or min(RANGE, source.size() // LEAST)
        first: list[tuple[int, int]] = []
        for m in messages(source):
            if m.kind == SCHEMA:
                first.append((m.start, m.end))
            elif out and out[-1].end == m.start and m.end - out[-1].start <= limit:
                out[-1].end = m.end
            else:
                out.append(Range(uri, path, list(first), m.start, m.end))
            if m.kind == DICTIONARY:
                first.append((m.start, m.end))
    return out


class _Reader(DataSourceReader):
    def __init__(self, uri: str, limit: int | None):
        self.uri, self.limit = uri, limit

    def partitions(self) -> list[Range]:
        return [r for path in stream_files(self.uri) for r in ranges(self.uri, path, self.limit)]

    def read(self, partition: Range | None) -> Iterator:
        import pyarrow as pa

        if partition is None:  # streams without batches
            return
        system, _ = opened(partition.uri)
        with system.open_input_file(partition.path) as source:
            parts = [source.read_at(e - s, s) for s, e in (*partition.first, (partition.start, partition.end))]
        with pa.ipc.open_stream(pa.py_buffer(b"".join([*parts, END]))) as stream:
            for batch in stream:
                # Dictionaries are for the stream; Spark's columns are plain.
                plain = [c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in batch.columns]
                yield pa.RecordBatch.from_arrays(plain, names=batch.schema.names)


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _Writer(DataSourceArrowWriter):
    """Each task writes a hidden file; on commit, all are named by their partition, on abort all go."""

    def __init__(self, uri: str, schema: StructType):
        self.uri, self.schema, self.run = uri, schema, uuid.uuid4().hex

    def write(self, iterator) -> _Written:
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        system, folder = opened(self.uri)
        system.create_dir(folder, recursive=True)
        path = f"{folder}/_{self.run}-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}"
        sink = None
        try:
            with system.open_output_stream(path) as out:
                for batch in iterator:
                    sink = sink or pa.ipc.new_stream(out, batch.schema)
                    sink.write_batch(batch)
                (sink or pa.ipc.new_stream(out, to_arrow_schema(self.schema))).close()
        except BaseException:
            system.delete_file(path)
            raise
        return _Written(path)

    def _files(self, messages: list) -> Iterator[tuple]:
        system, folder = opened(self.uri)
        for m in messages:
            if m is not None:
                yield system, folder, m.path

    def commit(self, messages: list) -> None:
        for system, folder, path in self._files(messages):
            system.move(path, f"{folder}/part-{path.rsplit('/_', 1)[1][33:38]}-{self.run}.arrow")

    def abort(self, messages: list) -> None:
        for system, _, path in self._files(messages):
            system.delete_file(path)


class ArrowStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_stream"

    def schema(self) -> StructType:
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        system, _ = opened(self.options["path"])
        for path in stream_files(self.options["path"])[:1]:
            with system.open_input_file(path) as source, pa.ipc.open_stream(source) as stream:
                plain = [f.with_type(f.type.value_type) if pa.types.is_dictionary(f.type) else f for f in stream.schema]
                return from_arrow_schema(pa.schema(plain))
        raise FileNotFoundError(f"{self.options['path']}: no .arrow file")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("range", 0)) or None)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("streams are appended to; take a new folder")
        return _Writer(self.options["path"], schema)


def register(spark) -> None:
    spark.dataSource.register(ArrowStream)
