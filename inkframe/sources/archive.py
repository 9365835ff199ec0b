"""Zip archives of page images: entries by the central directory, merges and splits that copy compressed bytes.

The directory is read from a file's tail; a large archive is cut into slices of bytes, and each task reads only the
members that begin in its slice.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from ..functions.names import IMAGES
from .ranged import RUN, Ranged, SlicedReader, by_bytes, in_order, register, save_chunks, stored, write_chunks

STORED, DEFLATED = 0, 8
CHUNK = "name string, seq long, chunk binary"
SCHEMAS = {
    "directory": "book string, entry_path string, method int, flags int, crc long, packed_bytes long, bytes long, offset long, error string",
    "contents": "book string, entry_path string, method int, flags int, crc long, packed_bytes long, bytes long, offset long, content binary, error string",
    "members": "book string, entry_path string, method int, flags int, crc long, packed_bytes long, bytes long, offset long, packed binary, error string",
}


class BadEntry(ValueError):
    """An entry that can't be read; the others can."""


ENTRY = struct.Struct("<4s4xHH4xIIIHHH8xI")


def directory_of(file: Ranged) -> tuple[int, int, int, int]:
    """Where a central directory begins, its bytes and entries, and what moves all offsets; ValueError if there is none."""
    span = min(file.size, 65_557)
    raw = file.at(file.size - span, span)
    at = raw.rfind(b"PK\5\6")
    if at < 0 or at + 22 > len(raw):
        raise ValueError("not a zip archive")
    n, size, begin = struct.unpack_from("<HII", raw, at + 10)
    end = file.size - span + at
    if n == 0xFFFF or size == 0xFFFFFFFF or begin == 0xFFFFFFFF:
        where = file.at(end - 20, 20)
        if where[:4] == b"PK\6\7":
            end = struct.unpack_from("<Q", where, 8)[0]
            n, size, begin = struct.unpack_from("<QQQ", file.at(end, 56), 32)
    # bytes before the archive move all offsets
    shift = end - size - begin
    return begin + shift, size, n, shift


def walked(file: Ranged, begin: int, size: int, n: int, piece: int = 1 << 20) -> Iterator[tuple[bytes, int, tuple]]:
    """The entries of a directory as (bytes, place in them, fields), which is read piece by piece; ValueError if it ends early."""
    raw, at, there = b"", 0, begin
    most = ENTRY.size + 3 * 0xFFFF
    for i in range(n):
        if len(raw) - at < most and there < begin + size:
            more = file.at(there, min(max(piece, most), begin + size - there))
            raw, at, there = raw[at:] + more, 0, there + len(more) if more else begin + size
        if raw[at : at + 4] != b"PK\1\2" or at + ENTRY.size > len(raw):
            raise ValueError(f"the directory ends after {i} of {n} entries")
        fields = ENTRY.unpack_from(raw, at)
        yield raw, at, fields
        at += ENTRY.size + fields[6] + fields[7] + fields[8]


def listed(file: Ranged, low: int = 0, high: int | None = None) -> Iterator[dict]:
    """The entries of a central directory whose data begins at low or later, before high; ValueError before the first if there is
    none or a part of it is missing. It is read twice, in pieces, and never held as a whole."""
    begin, size, n, shift = directory_of(file)
    for _ in walked(file, begin, size, n):
        pass
    for raw, at, (_, flags, method, crc, packed, whole, name, extra, _, offset) in walked(file, begin, size, n):
        # places in the wide format are known from the extra field alone
        if high is not None and offset != 0xFFFFFFFF and not low <= min(max(offset + shift, 0), file.size) < high:
            continue
        at += ENTRY.size
        path = raw[at : at + name].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        if 0xFFFFFFFF in (whole, packed, offset):
            more, long_ = raw[at + name : at + name + extra], []
            while len(more) >= 4:
                kind, length = struct.unpack_from("<HH", more)
                if kind == 1:
                    long_ = list(struct.unpack(f"<{min(length, len(more) - 4) // 8}Q", more[4 : 4 + min(length, len(more) - 4) // 8 * 8]))
                more = more[4 + length :]
            whole, packed, offset = (long_.pop(0) if v == 0xFFFFFFFF and long_ else v for v in (whole, packed, offset))
        # an offset outside of the file belongs to the last slice
        if high is None or low <= min(max(offset + shift, 0), file.size) < high:
            yield {"entry_path": path, "method": method, "crc": crc, "packed_bytes": packed, "bytes": whole, "offset": offset + shift, "flags": flags}


def tail(file: Ranged) -> list[dict]:
    """The entries of a central directory; ValueError if there is none."""
    return list(listed(file))


def data_at(file: Ranged, entry: dict) -> int:
    """Where the stored bytes of a member begin, behind its local header."""
    local = file.at(entry["offset"], 30)
    if len(local) < 30 or local[:4] != b"PK\3\4":
        raise BadEntry("no local header")
    name, extra = struct.unpack_from("<HH", local, 26)
    if entry["offset"] + 30 + name + extra + entry["packed_bytes"] > file.size:
        raise BadEntry("ends behind the file")
    return entry["offset"] + 30 + name + extra


def packed_bytes(file: Ranged, entry: dict) -> bytes:
    """The stored bytes of a member."""
    return file.at(data_at(file, entry), entry["packed_bytes"])


def unpacked(raw: bytes, entry: dict) -> bytes:
    """A member's content, tested by length and checksum."""
    if entry["flags"] & 1:
        raise BadEntry("encrypted")
    if entry["method"] not in (STORED, DEFLATED):
        raise BadEntry(f"method {entry['method']} is not supported")
    try:
        out = raw if entry["method"] == STORED else zlib.decompressobj(-15).decompress(raw, entry["bytes"] + 1)
    except zlib.error as e:
        raise BadEntry(str(e)) from e
    if len(out) != entry["bytes"] or zlib.crc32(out) != entry["crc"]:
        raise BadEntry("length or checksum differ")
    return out


class ArchiveReader(SlicedReader):
    def __init__(self, options: dict):
        self.what = options.get("what", "contents")
        if self.what not in SCHEMAS:
            raise ValueError(f"what must be one of {', '.join(SCHEMAS)}")
        super().__init__(options, (".cbz", ".zip"), whole=self.what == "directory")

    def read(self, partition):
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        columns = [x.split() for x in SCHEMAS[self.what].split(", ")]
        held, size = [], 0
        for row in self.rows(partition) if partition.path else ():
            held.append({"book": partition.path} | row)
            size += len(row.get("content") or row.get("packed") or b"") + 128
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], kinds[t]) for n, t in columns], names=[n for n, _ in columns])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], kinds[t]) for n, t in columns], names=[n for n, _ in columns])

    def rows(self, part) -> Iterator[dict]:
        try:
            file = Ranged(part.path)
            entries = listed(file, part.low, part.high)
            first = next(entries, None)
        except (ValueError, OSError, struct.error) as e:
            if part.low == 0:
                yield {"error": str(e)}
            return
        for e in chain([first] if first else [], entries):
            name = e["entry_path"]
            if name.endswith("/") or name.lower().startswith("__macos") or name.lower().rpartition(".")[2] not in IMAGES:
                continue
            if self.what == "directory":
                yield e
                continue
            try:
                raw = packed_bytes(file, e)
                yield e | ({"packed": raw} if self.what == "members" else {"content": unpacked(raw, e)})
            except (BadEntry, ValueError, OSError) as fault:
                yield e | {"error": str(fault)}


class Archives(DataSource):
    """Format inkframe_archives: what = directory, contents or members of the archives below a path."""

    @classmethod
    def name(cls) -> str:
        return "inkframe_archives"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("what", "contents")]

    def reader(self, schema):
        return ArchiveReader(self.options)


def archives(spark: SparkSession, path: str, what: str = "contents", slice_bytes: int | None = None) -> DataFrame:
    """The images in archive files (.cbz, .zip), read by ranges of bytes: their directory entries, with contents, or with the
    packed bytes.

    Folders, junk and other files are skipped. A file that is no archive gives one row with error, and so does an entry
    that is damaged, encrypted, cut off or of an unknown method; the others come through. A filter on book decides
    which files are opened. An empty folder gives no rows.
    """
    register(spark, Archives)
    reader = spark.read.format("inkframe_archives").option("path", path).option("what", what)
    return (reader.option("slice", slice_bytes) if slice_bytes else reader).load()


def in_collation(path: Column) -> Column:
    """What paths are sorted by: the order of letters in the root locale, not of their codes."""
    return F.collate(path, "UNICODE")


def numbered(rows: DataFrame, book: str = "book", path: str = "entry_path") -> DataFrame:
    """Adds page_no, an entry's place in its book by collated path; entries of equal paths by offset. Rows with a null path have
    none. Only keys and paths should come here: a book's names pass through one task."""
    last = [F.col("offset")] if "offset" in rows.columns else []
    w = Window.partitionBy(book).orderBy(F.col(path).isNull(), in_collation(F.col(path)), F.col(path), *last)
    return rows.withColumn("page_no", F.when(F.col(path).isNotNull(), F.row_number().over(w)))


def near(placed: DataFrame, block: Column | None = None) -> DataFrame:
    """Rows of directories by blocks of neighbours, 64 pages if none is given: a task reads whole blocks, in the order of places."""
    return placed.repartition("book", F.floor(F.col("page_no") / 64) if block is None else block).sortWithinPartitions("book", "offset")


def members(placed: DataFrame, block: Column | None = None) -> DataFrame:
    """Adds content and error to rows of directories, with whatever columns they have: each task reads the members of its rows
    by ranges, so no content passes a shuffle."""
    kept = [c for c in placed.columns if c not in ("content", "error")]
    names = ["book", "offset", "packed_bytes", "bytes", "crc", "method", "flags"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in names]
            got, faults, begin, size = [], [], 0, 0
            for i, row in enumerate(zip(*cols, strict=True)):
                e = dict(zip(names, row, strict=True))
                raw, fault = None, None
                try:
                    if e["book"] != path:
                        path, file = e["book"], Ranged(e["book"])
                    raw = unpacked(packed_bytes(file, e), e)
                except (ValueError, OSError) as x:
                    raw, fault = None, str(x)
                got.append(raw)
                faults.append(fault)
                size += len(raw or b"")
                if size > 4 << 20 or i + 1 == b.num_rows:
                    part = b.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary()), pa.array(faults, pa.string())], names=[*b.schema.names, "content", "error"])
                    got, faults, begin, size = [], [], i + 1, 0

    return near(placed.select(*kept), block).mapInArrow(run, f"{fields(placed.select(*kept))}, content binary, error string")


def fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def located(placed: DataFrame) -> DataFrame:
    """Adds at, where a member's stored bytes begin, to rows of directories; those without such bytes go. Headers alone are read."""
    names = ["book", "offset", "packed_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for b in batches:
            found = []
            for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
                try:
                    if row[0] != path:
                        path, file = row[0], Ranged(row[0])
                    found.append(data_at(file, dict(zip(names, row, strict=True))))
                except (ValueError, OSError):
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], names=[*b.schema.names, "at"])

    return near(placed).mapInArrow(run, f"{fields(placed)}, at long").where("at IS NOT NULL")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(book, entry_path, content, error, page_no) of images in archives, numbered by collated path.

    The numbers come from the directories alone; contents are read by ranges, in the tasks that put them out.
    """
    found = archives(spark, path, "directory")
    broken = found.where("error IS NOT NULL").select("book", "entry_path", F.lit(None).cast("binary").alias("content"), "error", F.lit(None).cast("int").alias("page_no"))
    return members(numbered(found.where("error IS NULL"))).select("book", "entry_path", "content", "error", "page_no").unionByName(broken)


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(book, entry_path, content, error) of images in archives, in no order. Unlike archives, whose slices read the whole directory
    each, this reads it in one task of the archive's, so the work doesn't grow with the square of an archive's entries."""
    found = archives(spark, path, "directory")
    broken = found.where("error IS NOT NULL").select("book", "entry_path", F.lit(None).cast("binary").alias("content"), "error")
    return members(found.where("error IS NULL"), block=F.floor(F.col("offset") / RUN)).select("book", "entry_path", "content", "error").unionByName(broken)


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(book, entry_path, content, page_no) of the images in folders, a folder a book, numbered by collated path.

    Only images are opened, and paths alone are sorted. Spark passes over empty files.
    """
    glob = "*.{" + ",".join(x for e in IMAGES for x in (e, e.upper())) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).withColumnRenamed("path", "entry_path")
    placed = numbered(files.select("entry_path", F.regexp_replace("entry_path", "/[^/]*$", "").alias("book")))
    return files.select("entry_path", "content").join(placed, "entry_path").select("book", "entry_path", "content", "page_no")


# -- writing


def local_header(name: bytes, method: int, crc: int, packed: int, size: int) -> bytes:
    big = max(packed, size) >= 0xFFFFFFFF
    extra = struct.pack("<HHQQ", 1, 16, size, packed) if big else b""
    return struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if big else 20, 0x800, method, 0, 0x21, crc, *((0xFFFFFFFF,) * 2 if big else (packed, size)), len(name), len(extra)) + name + extra


def directory_entry(name: bytes, method: int, crc: int, packed: int, size: int, offset: int) -> bytes:
    wide = [v for v in (size, packed, offset) if v >= 0xFFFFFFFF]
    extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
    short = lambda v: min(v, 0xFFFFFFFF)
    return struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if wide else 20, 0x800, method, 0, 0x21, crc, short(packed), short(size), len(name), len(extra), 0, 0, 0, 0, short(offset)) + name + extra


def directory_end(n: int, size: int, offset: int) -> bytes:
    out = b""
    if n >= 0xFFFF or size >= 0xFFFFFFFF or offset >= 0xFFFFFFFF:
        out = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, offset) + struct.pack("<4sIQI", b"PK\6\7", 0, offset + size, 1)
    return out + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, 0xFFFFFFFF), min(offset, 0xFFFFFFFF), 0)


def page_names(page_no: Column, path: Column) -> Column:
    """00001.ext, 00002.ext, ...: a page's name in a merged or split archive."""
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.concat(F.lpad(page_no.cast("string"), F.greatest(F.lit(5), F.length(page_no.cast("string"))), "0"), ending)


def archive_chunks(members: DataFrame, end_size: int = 50_000) -> DataFrame:
    """(name, seq, chunk): archives of packed members, which are copied as they are.

    members has name (the archive), page_no (from 1), entry (the member's name), method, crc, packed, bytes; it is read
    three times, twice for sizes alone. A member is one chunk with its header; the central directory comes behind. A null
    packed is left out.
    """
    there = members.where(F.col("packed").isNotNull())

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in by_bytes(pc.binary_length(b.column(6)).to_pylist()):
                rows = zip(*(b.column(k).slice(lo, hi - lo).to_pylist() for k in range(7)), strict=True)
                made = [local_header(entry.encode(), method, crc, len(packed), whole) + packed for _, _, entry, method, crc, whole, packed in rows]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(made, pa.binary())], names=["name", "seq", "chunk"])

    data = there.select("name", F.col("page_no").cast("long"), "entry", F.col("method").cast("int"), F.col("crc").cast("long"), F.col("bytes").cast("long"), "packed").mapInArrow(bodies, CHUNK)
    return data.unionByName(directories(there.withColumn("packed", F.length("packed")), end_size))


def directories(members: DataFrame, end_size: int = 50_000) -> DataFrame:
    """(name, seq, chunk): what comes behind the members of archives, of which packed is the number of bytes here: the central
    directory and its end. Offsets are running sums in parts of end_size entries, which begin at the sum of the parts before;
    entries stay rows on the way, so no task holds a directory."""
    big = (F.col("packed") >= 0xFFFFFFFF) | (F.col("bytes") >= 0xFFFFFFFF)
    size = (30 + F.octet_length("entry") + F.when(big, 20).otherwise(0) + F.col("packed")).cast("long")
    part = F.floor(F.col("page_no") / end_size).cast("long")
    kinds = {"page_no": "long", "method": "int", "crc": "long", "packed": "long", "bytes": "long"}
    rows = members.select("name", part.alias("part"), "entry", *[F.col(k).cast(t).alias(k) for k, t in kinds.items()], size.alias("size"))
    earlier = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each end_size members
    bases = rows.groupBy("name", "part").agg(F.sum("size").alias("body")).select("name", "part", F.coalesce(F.sum("body").over(earlier), F.lit(0)).alias("base"))
    here = Window.partitionBy("name", "part").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(bases, ["name", "part"]).withColumn("at", F.col("base") + F.coalesce(F.sum("size").over(here), F.lit(0)))

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for name, part, page_no, *rest, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not found or found[-1][:2] != [name, part]:
                    found.append([name, part, page_no, [], 0])
                entry, *numbers = rest
                found[-1][3].append(directory_entry(entry.encode(), *numbers))
                found[-1][4] += size
            if found:
                names, _, first, made, body = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([(1 << 40) + n for n in first]), pa.array([b"".join(x) for x in made], pa.binary()), pa.array([len(x) for x in made]), pa.array(body)], names=["name", "seq", "chunk", "n", "body"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [directory_end(n, size, body) for n, size, body in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([1 << 41] * b.num_rows), pa.array(made, pa.binary())], names=["name", "seq", "chunk"])

    made = placed.select("name", "part", "page_no", "entry", "method", "crc", "packed", "bytes", "at", "size").mapInArrow(listing, f"{CHUNK}, n long, body long")
    ends = made.groupBy("name").agg(F.sum("n").alias("n"), F.sum(F.length("chunk")).cast("long").alias("size"), F.sum("body").alias("body")).mapInArrow(last, CHUNK)
    return made.select("name", "seq", "chunk").unionByName(ends)


def merge_archives(spark: SparkSession, path: str, sets: DataFrame, out: str) -> None:
    """Writes the archives of each set (book, name, file_idx) as one named so, below out, pages in the order of files and then
    of collated paths, numbered anew; packed bytes are copied. Entries that can't be read are left out, archives that are
    none end the job. Names alone are sorted, a set's in one task."""
    w = Window.partitionBy("name").orderBy("file_idx", in_collation(F.col("entry_path")), "entry_path", "offset")
    write_parts(sound(spark, path).join(sets, "book").withColumn("page_no", F.row_number().over(w)), out)


def split_archives(spark: SparkSession, path: str, ranges: DataFrame, out: str) -> None:
    """Writes an archive for each range (book, name, start, end) of an archive's pages, numbered from 1; packed bytes are
    copied. A page may be in several; archives that are none end the job."""
    part = numbered(sound(spark, path)).join(ranges, "book").where(F.col("page_no").between(F.col("start"), F.col("end")))
    write_parts(part.withColumn("page_no", (F.col("page_no") - F.col("start") + 1).cast("int")).drop("start", "end"), out)


def sound(spark: SparkSession, path: str) -> DataFrame:
    """Directory entries; a file that is no archive ends the job that reads them."""
    why = F.concat_ws(": ", "book", "error")
    return archives(spark, path, "directory").where(F.when(F.col("error").isNotNull(), F.raise_error(why).cast("boolean")).otherwise(True)).drop("error")


def write_parts(placed: DataFrame, out: str) -> None:
    """Writes archives of members: rows of directories with name and page_no. Places alone are sorted; the task that writes a
    file reads its members' bytes when their turn comes, so none are shuffled or stored in between."""
    found, drop = stored(located(placed).withColumn("entry", page_names(F.col("page_no"), F.col("entry_path"))).withColumnRenamed("packed_bytes", "packed"))
    body = found.select("name", F.col("page_no").cast("long").alias("seq"), F.lit(None).cast("binary").alias("chunk"), "entry", "method", "crc", "packed", "bytes", "book", "at")

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for b in batches:
            made, begin, size = [], 0, 0
            for i, (chunk, entry, method, crc, packed, whole, book, at) in enumerate(zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)):
                if chunk is None:
                    if book != path:
                        path, file = book, Ranged(book)
                    raw = file.at(at, packed)
                    if len(raw) < packed:
                        raise ValueError(f"{book} was cut off meanwhile")
                    chunk = local_header(entry.encode(), method, crc, packed, whole) + raw
                made.append(chunk)
                size += len(chunk)
                if size > 4 << 20 or i + 1 == b.num_rows:
                    part = b.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.binary())], names=["name", "seq", "chunk"])
                    made, begin, size = [], i + 1, 0

    save_chunks(in_order(body.unionByName(directories(found), allowMissingColumns=True)).mapInArrow(copied, CHUNK), out)
    drop()


def deflated(raw: bytes) -> bytes:
    """A compressor holds some 260 KB, so there is one at a time."""
    c = zlib.compressobj(wbits=-15)
    return c.compress(raw) + c.flush()


def packed_images(pages: DataFrame, content: str = "png", squeeze: bool = False) -> DataFrame:
    """Adds method, crc, bytes and packed of a column's bytes, stored as they are or deflated: members for archive_chunks.
    A null content gives a null packed."""
    kept = pages.select(*[c for c in pages.columns if c not in ("method", "crc", "bytes", "packed")])
    at = kept.columns.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in by_bytes(pc.fill_null(pc.binary_length(b.column(at)), 0).to_pylist()):
                part = b.slice(lo, hi - lo)
                raw = part.column(at).to_pylist()
                packed = [deflated(x) if squeeze and x is not None else x for x in raw]
                made = [pa.array([DEFLATED if squeeze else STORED] * len(raw), pa.int32()), pa.array([None if x is None else zlib.crc32(x) for x in raw], pa.int64()), pa.array([None if x is None else len(x) for x in raw], pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*b.schema.names, "method", "crc", "bytes", "packed"])

    return kept.mapInArrow(run, f"{fields(kept)}, method int, crc long, bytes long, packed binary")


def write_archives(images: DataFrame, path: str, content: str = "png", squeeze: bool = False) -> None:
    """Writes an archive for each name of images (name, page_no, entry and a column of bytes)."""
    packed, drop = stored(packed_images(images, content, squeeze).drop(content))
    write_chunks(archive_chunks(packed), path)
    drop()


def write_archive(images: list[bytes], ext: str = "png") -> bytes:
    """A zip with entries 00001.ext, 00002.ext, ..."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, x in enumerate(images, 1):
            z.writestr(f"{i:05d}.{ext}", x)
    return out.getvalue()
