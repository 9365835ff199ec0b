"""Page containers: header, metadata, table of contents, index and page blobs in one file a book."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from .ranged import Ranged, SlicedReader, register

SIZES = (128, 64, 32, 16)
#: Pages and chapters at most.
MOST = 0xFFFF


def _text(value: str | None, size: int) -> bytes:
    return (value or "").encode()[: size - 1].ljust(size, b"\0")


def head(sizes: list[tuple[int, bytes]], two_bit: bool = False, meta: tuple = (), toc: list[tuple[str, int, int]] | None = None, create_time: int = 0, cover: int = 0xFFFF) -> bytes:
    """Header, metadata, table of contents and index of pages, given as size and bytes 4 to 8 of each, which say its width
    and height. meta is (title, author, publisher, language). ValueError for more than the format can count."""
    toc = toc or []
    if len(sizes) > MOST or len(toc) > MOST:
        raise ValueError(f"{len(sizes)} pages, {len(toc)} chapters: the format counts to {MOST}")
    rich = any(meta) or bool(toc)
    start = 56 + 256 + 96 * len(toc) if rich else 48
    at = start + 16 * len(sizes)
    out = [(b"XTCH" if two_bit else b"XTC\0") + struct.pack("<HHIIQQQQ", 1, len(sizes), 0x01000100 if rich else 0, 1 if rich else 0, 56 if rich else 0, start, at, 0)]
    if rich:
        out += [struct.pack("<Q", 312), *(_text(v, n) for v, n in zip((*meta, "", "", "", "")[:4], SIZES, strict=True)), struct.pack("<IHH8x", create_time, cover, len(toc))]
        out += [_text(t, 80) + struct.pack("<HH12x", a, b) for t, a, b in toc]
    for size, shape in sizes:
        out.append(struct.pack("<QI", at, size) + shape)
        at += size
    return b"".join(out)


def fixed_head(sizes: list[tuple[int, bytes]], two_bit: bool = False, meta: tuple = ()) -> bytes:
    """The command-line variant: always metadata, of which only title and author are set, and never a table of contents."""
    if len(sizes) > MOST:
        raise ValueError(f"{len(sizes)} pages: the format counts to {MOST}")
    at = 312 + 16 * len(sizes)
    out = [(b"XTCH" if two_bit else b"XTC\0") + struct.pack("<HHIIQQQQQ", 1, len(sizes), 0x01000100, 1, 56, 312, at, 0, 0)]
    out.append(b"".join(_text(v, n) for v, n in zip((*meta, "", "")[:2], SIZES, strict=False)).ljust(256, b"\0"))
    for size, shape in sizes:
        out.append(struct.pack("<QI", at, size) + shape)
        at += size
    return b"".join(out)


def build(blobs: list[bytes], two_bit: bool = False, meta: tuple = (), toc: list[tuple[str, int, int]] | None = None, create_time: int = 0, cover: int = 0xFFFF) -> bytes:
    """A container of encoded pages."""
    return head([(len(x), x[4:8]) for x in blobs], two_bit, meta, toc, create_time, cover) + b"".join(blobs)


def parse(raw: bytes) -> tuple[dict, list[tuple[str, int, int]], list[bytes]]:
    """Header and metadata, table of contents, page blobs, each where the header says. ValueError for other bytes."""
    if raw[:3] != b"XTC":
        raise ValueError("not a container")
    version, n, flags, _, meta, index, _, _ = struct.unpack_from("<HHIIQQQQ", raw, 4)
    info, toc = {"version": version, "page_count": n, "two_bit": raw[3:4] in b"Hh" and raw[3:4] != b""}, []
    if flags and meta:
        at = meta
        for name, size in zip(("title", "author", "publisher", "language"), SIZES, strict=True):
            info[name] = raw[at : at + size].split(b"\0")[0].decode("utf-8", "replace")
            at += size
        info["create_time"], info["cover"], chapters = struct.unpack_from("<IHH", raw, at)
        own = struct.unpack_from("<Q", raw, 48)[0] if len(raw) >= 56 else 0
        for i in range(chapters):
            p = (own or at + 16) + 96 * i
            toc.append((raw[p : p + 80].split(b"\0")[0].decode("utf-8", "replace"), *struct.unpack_from("<HH", raw, p + 80)))
    pages = []
    for i in range(n):
        at, size = struct.unpack_from("<QI", raw, index + 16 * i)
        pages.append(raw[at : at + size])
    return info, toc, pages


def page_count(head: Column) -> Column:
    """How many pages a container has, by the first bytes of its header; null for other bytes."""
    low, high = (F.conv(F.hex(F.substring(head, i, 1)), 16, 10).cast("int") for i in (7, 8))
    return F.when(F.hex(F.substring(head, 1, 3)) == F.lit(b"XTC".hex()), low + 256 * high)


def page_counts(spark: SparkSession, path: str) -> DataFrame:
    """(book, page_count) of containers; no page is sliced, and null stands for files that are none. Spark passes over empty files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("book"), page_count(F.substring("content", 1, 8)).alias("page_count"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(book, page_no, page_blob, error) of containers; a broken file gives one row with error."""

    def run(batches) -> Iterator:
        for b in batches:
            for book, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    blobs, error = parse(raw)[2], None
                except (ValueError, struct.error) as e:
                    blobs, error = [None], str(e)
                yield pa.RecordBatch.from_arrays([pa.array([book] * len(blobs)), pa.array([i + 1 if error is None else None for i in range(len(blobs))], pa.int32()), pa.array(blobs, pa.binary()), pa.array([error] * len(blobs), pa.string())], names=["book", "page_no", "page_blob", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "book string, page_no int, page_blob binary, error string")


def to_containers(pages: DataFrame, book: str = "book", two_bit: bool = False) -> DataFrame:
    """One container a book. A book's pages meet in one row, as they do in its file; the format ends at 65,535 pages."""
    gathered = pages.groupBy(book).agg(F.array_sort(F.collect_list(F.struct("page_no", "page_blob"))).alias("p")).select(book, F.transform("p", lambda x: x["page_blob"]).alias("blobs"))

    def run(batches) -> Iterator:
        for b in batches:
            for key, blobs in zip(b.column(0), b.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], b.schema.field(0).type), pa.array([build(blobs.as_py(), two_bit)], pa.binary())], names=[book, "container"])

    return gathered.mapInArrow(run, f"{book} {pages.schema[book].dataType.simpleString()}, container binary")


# -- by ranges of bytes

SCHEMAS = {
    "pages": "book string, page_no int, width int, height int, page_blob binary, error string",
    "index": "book string, page_no int, width int, height int, offset long, bytes long, error string",
    "books": "book string, page_count int, two_bit boolean, title string, author string, publisher string, language string, create_time long, cover int, chapters int, error string",
    "toc": "book string, idx int, title string, start int, end int, error string",
    "counts": "book string, page_count int, error string",
}


class Head:
    """What a container's first bytes say; ValueError for other bytes."""

    def __init__(self, file: Ranged, counts_only: bool = False):
        raw = file.at(0, 8 if counts_only else 56)
        if raw[:3] != b"XTC" or len(raw) < (8 if counts_only else 48):
            raise ValueError("not a container")
        self.page_count, self.two_bit = struct.unpack_from("<H", raw, 6)[0], raw[3:4] in (b"H", b"h")
        if counts_only:
            return
        flags, _, self.meta, self.index = struct.unpack_from("<IIQQ", raw, 8)
        if not flags:
            self.meta = 0
        own = struct.unpack_from("<Q", raw, 48)[0] if len(raw) >= 56 else 0
        self.toc = (own or self.meta + 256) if self.meta else 0

    def texts(self, file: Ranged) -> dict:
        """Metadata; nothing but a chapter count of 0 where there is none."""
        raw = file.at(self.meta, 256) if self.meta else b""
        if len(raw) < 256:
            return {"chapters": 0}
        out, at = {}, 0
        for name, size in zip(("title", "author", "publisher", "language"), SIZES, strict=True):
            out[name] = raw[at : at + size].split(b"\0")[0].decode("utf-8", "replace")
            at += size
        out["create_time"], out["cover"], out["chapters"] = struct.unpack_from("<IHH", raw, at)
        return out


class ContainerReader(SlicedReader):
    def __init__(self, options: dict):
        self.what = options.get("what", "pages")
        if self.what not in SCHEMAS:
            raise ValueError(f"what must be one of {', '.join(SCHEMAS)}")
        number = "page_no" if self.what in ("pages", "index") else None
        super().__init__(options, (".xtc", ".xtch"), number, whole=self.what in ("books", "toc", "counts"))

    def read(self, partition):
        names = [x.split()[0] for x in SCHEMAS[self.what].split(", ")]
        types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
        kinds = [types[x.split()[1]] for x in SCHEMAS[self.what].split(", ")]
        held, size = [], 0
        for row in self.rows(partition) if partition.path else ():
            held.append({"book": partition.path} | row)
            size += len(row.get("page_blob") or b"") + 64
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], t) for n, t in zip(names, kinds, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], t) for n, t in zip(names, kinds, strict=True)], names=names)

    def rows(self, part) -> Iterator[dict]:
        # of a file in slices, the first one tells of faults
        first = part.low == 0
        try:
            file = Ranged(part.path)
            h = Head(file, self.what == "counts")
            if self.what == "counts":
                yield {"page_count": h.page_count}
            elif self.what == "books":
                yield {"page_count": h.page_count, "two_bit": h.two_bit} | h.texts(file)
            elif self.what == "toc":
                n = h.texts(file)["chapters"]
                raw = file.at(h.toc, 96 * n) if n else b""
                for i in range(len(raw) // 96):
                    yield {"idx": i + 1, "title": raw[96 * i : 96 * i + 80].split(b"\0")[0].decode("utf-8", "replace"), **dict(zip(("start", "end"), struct.unpack_from("<HH", raw, 96 * i + 80), strict=True))}
                if len(raw) < 96 * n:
                    yield {"error": f"{n} chapters announced, {len(raw) // 96} there"}
            else:
                yield from self.pages(part, file, h, first)
        except (ValueError, OSError) as e:
            if first and not self.pruned:
                yield {"error": str(e)}

    def pages(self, part, file: Ranged, h: Head, first: bool) -> Iterator[dict]:
        """The wanted pages whose data begins in the slice; pages that end behind the file are errors."""
        lo = max(1, self.low or 1, min(self.some, default=1) if self.some is not None else 1)
        hi = min(h.page_count, h.page_count if self.high is None else self.high, max(self.some, default=0) if self.some is not None else h.page_count)
        if lo > hi:
            return
        raw = file.at(h.index + 16 * (lo - 1), 16 * (hi - lo + 1))
        found = []
        for i in range(len(raw) // 16):
            at, size, w, height = struct.unpack_from("<QIHH", raw, 16 * i)
            if self.wanted(lo + i) and (part.low <= at < part.high or (at >= file.size and part.high > file.size)):
                found.append((at, size, {"page_no": lo + i, "width": w, "height": height}))
        good = [x for x in found if x[0] + x[1] <= file.size]
        if self.what == "index":
            yield from (row | {"offset": at, "bytes": size} for at, size, row in good)
        else:
            for (_, _, row), blob in zip(good, file.runs([x[:2] for x in good]), strict=True):
                yield row | {"page_blob": blob}
        for at, size, row in found:
            if at + size > file.size:
                yield row | {"error": f"page of {size} bytes at {at} ends behind the file"}
        if first and len(raw) < 16 * (hi - lo + 1):
            for n in range(lo + len(raw) // 16, hi + 1):
                if self.wanted(n):
                    yield {"page_no": n, "error": "no index entry"}


class Containers(DataSource):
    """Format inkframe_containers: what = pages, index, books, toc or counts of the containers below a path."""

    @classmethod
    def name(cls) -> str:
        return "inkframe_containers"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("what", "pages")]

    def reader(self, schema):
        return ContainerReader(self.options)


def containers(spark: SparkSession, path: str, what: str = "pages", slice_bytes: int | None = None) -> DataFrame:
    """Pages, index entries, books, chapters or page counts of container files, read by ranges of bytes.

    Filters on book, and on page_no of pages and index, decide what is read: 8 bytes of a file for counts, its head for
    books and toc, head, index and the wanted pages else. A large file is read by several tasks. Files that are no
    containers, and pages that are cut off, are rows with error, where filters on page_no let them pass. An empty folder
    gives no rows. Only files named .xtc or .xtch are looked at.
    """
    register(spark, Containers)
    reader = spark.read.format("inkframe_containers").option("path", path).option("what", what)
    return (reader.option("slice", slice_bytes) if slice_bytes else reader).load()
