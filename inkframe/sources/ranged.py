"""Files in places that pyarrow's file systems know, read by byte ranges, and files written whole or not at all.

A file is cut into slices by its size alone, so planning opens no file: each task reads the directory that the format
keeps at a file's head or tail, and then only those members whose data begins in its slice.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Bytes of a slice, and of a run of neighbouring members read at once.
SLICE, RUN = 64 << 20, 8 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        # Spark's paths are not percent-encoded
        return pafs.LocalFileSystem(), re.sub(r"^file:(//(?=/))?", "", path)
    return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path)) if "://" in path else (pafs.LocalFileSystem(), path)


class Ranged:
    """A file read at given places; counts the bytes asked for."""

    def __init__(self, path: str):
        system, inner = opened(path)
        self.file, self.read = system.open_input_file(inner), 0
        self.size = self.file.size()

    def at(self, offset: int, size: int) -> bytes:
        size = max(0, min(size, self.size - offset))
        self.read += size
        return self.file.read_at(size, offset) if size else b""

    def runs(self, spans: list[tuple[int, int]]) -> Iterator[bytes]:
        """The bytes of each (offset, size), in order; neighbours are read together, up to RUN bytes."""
        i = 0
        while i < len(spans):
            begin, size = spans[i]
            end, j = begin + size, i + 1
            while j < len(spans) and spans[j][0] == end and end + spans[j][1] - begin <= RUN:
                end, j = end + spans[j][1], j + 1
            raw = memoryview(self.at(begin, end - begin))
            for at, n in spans[i:j]:
                yield bytes(raw[at - begin : at - begin + n])
            i = j


@dataclass
class Slice(InputPartition):
    """The members of a file whose data begins at low or later, before high."""

    path: str
    low: int
    high: int


class SlicedReader(DataSourceReader):
    """Slices of the files below a path; filters on the file's name and on one numeric column are pushed into them."""

    def __init__(self, options: dict, suffixes: tuple[str, ...], number: str | None = None, whole: bool = False):
        self.path, self.slice = options["path"], int(options.get("slice", SLICE))
        self.suffixes, self.number, self.whole = suffixes, number, whole
        self.low, self.high, self.names, self.some = None, None, None, None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("book",) and isinstance(f, EqualTo | In):
                found = {value} if isinstance(f, EqualTo) else set(value)
                self.names = found if self.names is None else self.names & found
            elif self.number and column == (self.number,) and isinstance(f, EqualTo | In):
                found = {value} if isinstance(f, EqualTo) else set(value)
                self.some = found if self.some is None else self.some & found
            elif self.number and column == (self.number,) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                least = value + isinstance(f, GreaterThan)
                self.low = least if self.low is None else max(self.low, least)
            elif self.number and column == (self.number,) and isinstance(f, LessThan | LessThanOrEqual):
                most = value - isinstance(f, LessThan)
                self.high = most if self.high is None else min(self.high, most)
            else:
                yield f

    def wanted(self, n: int) -> bool:
        return (self.low is None or n >= self.low) and (self.high is None or n <= self.high) and (self.some is None or n in self.some)

    @property
    def pruned(self) -> bool:
        """Whether rows without a number can't pass."""
        return not (self.low is None and self.high is None and self.some is None)

    def partitions(self):
        # the folder before the first part with a wildcard
        parts = self.path.split("/")
        fixed = next((i for i, x in enumerate(parts) if any(c in x for c in "*?[")), len(parts))
        base = "/".join(parts[:fixed])
        system, inner = opened(base)
        info = system.get_file_info(inner)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else system.get_file_info(pafs.FileSelector(inner, recursive=True))
        head = base[: len(base) - len(inner)] if base.endswith(inner) else "file://"
        if fixed < len(parts):
            pattern = "/".join([inner, *parts[fixed:]])
            files = [f for f in files if PurePosixPath(f.path).full_match(pattern)]
        out = []
        for f in files:
            name = head + f.path
            if not f.is_file or f.base_name.startswith((".", "_")) or "/." in f.path[len(inner) :] or not f.base_name.lower().endswith(self.suffixes) or (self.names is not None and name not in self.names):
                continue
            cuts = [0] if self.whole else range(0, max(1, f.size), self.slice)
            out += [Slice(name, lo, f.size + 1 if self.whole or lo + self.slice >= f.size else lo + self.slice) for lo in cuts]
        # Spark wants one at least
        return out or [Slice("", 0, 0)]


# -- files from chunks


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]
    temp: str = ""


class ChunkWriter(DataSourceArrowWriter):
    """Writes rows (name, seq, chunk), which come by name and seq, as a file a name.

    A task writes under a name of its own and the commit renames, so a reader never sees part of a file, and what killed
    tasks left goes when the job ends. A file of the same name is replaced.
    """

    def __init__(self, path: str, job: str):
        self.path, self.temp = path.rstrip("/"), f"{path.rstrip('/')}/.writing-{job}"

    def write(self, iterator: Iterable[pa.RecordBatch]) -> Written:
        system, temp = opened(self.temp)
        system.create_dir(temp, recursive=True)
        made, now, last, out = [], None, -1, None
        try:
            for b in iterator:
                for name, seq, chunk in zip(*(b.column(b.schema.get_field_index(c)) for c in ("name", "seq", "chunk")), strict=True):
                    name, seq = name.as_py(), seq.as_py()
                    if name != now:
                        if out:
                            out.close()
                        now, last = name, -1
                        made.append((f"{temp}/{uuid.uuid4().hex}", name))
                        out = system.open_output_stream(made[-1][0])
                    if seq <= last:
                        raise ValueError(f"chunks of {name} don't come in order")
                    last = seq
                    buffer = chunk.as_buffer()
                    if buffer is not None:
                        out.write(buffer)
        finally:
            if out:
                out.close()
        return Written(made, temp)

    def commit(self, messages):
        system, inner = opened(self.path)
        made = [f for m in messages if m for f in m.files]
        names = [n for _, n in made]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("chunks of a file were written by several tasks")
        for temp, name in made:
            system.move(temp, f"{inner}/{quote(name, safe=' ')}")
        self.abort(messages)

    def abort(self, messages):
        system, own = opened(self.temp)
        # a stream's tasks may have been sent out by another copy of the writer
        for temp in {own, *(m.temp for m in messages if m)}:
            if temp and system.get_file_info(temp).type != pafs.FileType.NotFound:
                system.delete_dir(temp)


class ChunkStreamWriter(DataSourceStreamArrowWriter):
    """The same for each batch of a stream; a batch that is repeated replaces its files."""

    def __init__(self, path: str, job: str):
        self.inner = ChunkWriter(path, job)

    def write(self, iterator):
        return self.inner.write(iterator)

    def commit(self, messages, batchId):  # noqa: N803
        self.inner.commit(messages)

    def abort(self, messages, batchId):  # noqa: N803
        self.inner.abort(messages)


class ChunkFiles(DataSource):
    """Format inkframe_chunks: files written from chunks."""

    @classmethod
    def name(cls) -> str:
        return "inkframe_chunks"

    def schema(self) -> str:
        return "name string, seq long, chunk binary"

    def writer(self, schema, overwrite):
        return ChunkWriter(self.options["path"], uuid.uuid4().hex)

    def streamWriter(self, schema, overwrite):  # noqa: N802
        return ChunkStreamWriter(self.options["path"], uuid.uuid4().hex)


def in_order(chunks: DataFrame) -> DataFrame:
    """Chunks (name, seq, chunk, more columns if any), a file's in one task and in order; tasks stream, so a file may be of any size."""
    rest = [c for c in chunks.columns if c not in ("name", "seq")]
    return chunks.select("name", F.col("seq").cast("long").alias("seq"), *rest).repartition("name").sortWithinPartitions("name", "seq")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Writes the files below a folder that all tasks can reach. An empty table writes none; a null chunk is empty."""
    save_chunks(in_order(chunks.select("name", "seq", "chunk")), path)


def save_chunks(ordered: DataFrame, path: str) -> None:
    """The same for chunks that are in_order."""
    register(ordered.sparkSession, ChunkFiles)
    ordered.write.format("inkframe_chunks").option("path", path).mode("append").save()


def register(spark: SparkSession, source: type[DataSource]) -> None:
    """Makes a format known to the session and lets its filters be pushed."""
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def scratch_path(spark: SparkSession) -> str:
    """A new folder name in the one that spark.checkpoint.dir gives; where that is unset, a temporary one on a local master,
    and an error on others."""
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='inkframe-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found}/inkframe-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """df written once to a scratch table, for steps that read it several times, and what deletes the table."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession)
    df.write.parquet(path)

    def drop() -> None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    return spark.read.schema(df.schema).parquet(path), drop


def by_bytes(sizes: Iterable[int], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes, one row at least."""
    lo, total, i = 0, 0, -1
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo <= i:
        yield lo, i + 1
