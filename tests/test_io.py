"""Container and archive files read by ranges and written from chunks; streams against their batch forms."""

import contextlib
import glob
import io
import os
import random
import struct
import tempfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe.operators import books, dither, raster
from inkframe.sources import archive, container, ranged
from inkframe.streaming import stateful


def page(n: int, w: int = 8, h: int = 8) -> bytes:
    return dither.page_blob(random.Random(n).randbytes(h), w, h)


def read_all(reader):
    return [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]


def counted(monkeypatch):
    total = []
    at = ranged.Ranged.at

    def counting(self, offset, size):
        got = at(self, offset, size)
        total.append(len(got))
        return got

    monkeypatch.setattr(ranged.Ranged, "at", counting)
    return total


def test_range_reads(tmp_path, monkeypatch):
    """Of a sparse file of 2 GB with 3 pages wanted, some KB are read; 8 bytes for a count."""
    blobs = [page(i) for i in range(100)]
    head = bytearray(container.head([(len(b), b[4:8]) for b in blobs], toc=[("c", 1, 100)]))
    index, far = struct.unpack_from("<Q", head, 24)[0], 1 << 31
    for i in range(100):
        struct.pack_into("<Q", head, index + 16 * i, far + 1000 * i)
    path = str(tmp_path / "a.xtc")
    with open(path, "wb") as f:
        f.write(head)
        for i, b in enumerate(blobs):
            f.seek(far + 1000 * i)
            f.write(b)
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    total = counted(monkeypatch)
    reader = container.ContainerReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([GreaterThanOrEqual(("page_no",), 40), LessThan(("page_no",), 43), EqualTo(("width",), 8)]))
    assert [f.attribute for f in left] == [("width",)]
    got = read_all(reader)
    assert [(r["page_no"], r["page_blob"]) for r in got] == [(i, blobs[i - 1]) for i in (40, 41, 42)]
    assert sum(total) < 40 * 300  # 33 slices read head and three index entries each
    total.clear()
    reader = container.ContainerReader({"path": path, "what": "counts"})
    assert read_all(reader) == [{"book": path, "page_count": 100, "error": None}] and sum(total) == 8
    reader = container.ContainerReader({"path": path})
    assert not list(reader.pushFilters([In(("page_no",), (7, 500)), EqualTo(("book",), path)])) and [r["page_no"] for r in read_all(reader)] == [7]
    reader = container.ContainerReader({"path": path})
    assert not list(reader.pushFilters([EqualTo(("book",), "other")])) and read_all(reader) == []
    assert sorted(r["page_no"] for r in read_all(container.ContainerReader({"path": path, "slice": 1 << 20}))) == list(range(1, 101))


def test_broken_containers(spark, tmp_path):
    blobs = [page(i) for i in range(3)]
    (tmp_path / "a.xtc").write_bytes(b"nothing")
    (tmp_path / "b.XTC").write_bytes(container.build(blobs)[:-5])
    (tmp_path / "c.xtch").write_bytes(container.build([]))
    (tmp_path / "d.xtc").write_bytes(container.build(blobs)[:60])
    (tmp_path / "e.xtc").write_bytes(b"")
    (tmp_path / "f.xtc").write_bytes(container.build(blobs, meta=("t",), toc=[("x", 1, 2)])[:330])
    name = lambda r: os.path.basename(r.book)[0]
    rows = container.containers(spark, str(tmp_path)).collect()
    assert {(name(r), r.page_no, r.error is None) for r in rows} == {("a", None, False), ("b", 1, True), ("b", 2, True), ("b", 3, False), ("d", 1, False), ("d", 2, False), ("d", 3, False), ("e", None, False), ("f", 1, False), ("f", 2, False), ("f", 3, False)}
    only = container.containers(spark, str(tmp_path)).where("page_no = 2")
    assert {(name(r), r.error is None) for r in only.collect()} == {("b", True), ("d", False), ("f", False)}
    heads = {name(r): (r.page_count, r.chapters, r.error is None) for r in container.containers(spark, str(tmp_path), "books").collect()}
    assert heads == {"a": (None, None, False), "b": (3, 0, True), "c": (0, 0, True), "d": (3, 0, True), "e": (None, None, False), "f": (3, 1, True)}
    assert {(name(r), r.idx, r.error is None) for r in container.containers(spark, str(tmp_path), "toc").collect()} == {("a", None, False), ("e", None, False), ("f", None, False)}
    (tmp_path / "none").mkdir()
    assert container.containers(spark, str(tmp_path / "none")).collect() == []


def test_containers_written(spark, tmp_path):
    """Files are the bytes that build gives; a job whose tasks fail leaves nothing."""
    r = random.Random(2)
    blobs = {b: [page(7 * i + len(b), 8, 8 * (1 + i % 3)) for i in range(n)] for b, n in (("x", 5), ("y/z", 300), ("ä b", 1))}
    rows = [(b, i + 1, x) for b, some in blobs.items() for i, x in enumerate(some)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "book string, page_no int, page_blob binary").repartition(5)
    meta = spark.createDataFrame([("x", "T" * 200, "é" * 40, None, True, 5), ("none", "n", "n", 3, False, 6)], "book string, title string, author string, cover int, two_bit boolean, create_time long")
    toc = spark.createDataFrame([("x", 2, "b", 3, 5), ("x", 1, "a", 1, 2), ("ä b", 1, "c", 1, 1)], "book string, idx int, title string, start int, end int")
    out = str(tmp_path / "out")
    books.write_containers(df, out, meta=meta, toc=toc)
    want = {"x.xtch": container.build(blobs["x"], True, ("T" * 200, "é" * 40), [("a", 1, 2), ("b", 3, 5)], 5), "y%2Fz.xtc": container.build(blobs["y/z"]), "%C3%A4 b.xtc": container.build(blobs["ä b"], toc=[("c", 1, 1)])}
    assert {os.path.basename(p): open(p, "rb").read() for p in glob.glob(f"{out}/*")} == want and len(os.listdir(out)) == 3
    books.write_containers(df.where("book = 'x'"), out)  # again, other content
    assert open(f"{out}/x.xtc", "rb").read() == container.build(blobs["x"]) and len(os.listdir(out)) == 4
    books.write_containers(df.limit(0), out)
    bad = df.select("book", "page_no", F.when((F.col("page_no") == 200) & F.raise_error(F.lit("lost")).isNull(), F.lit(None)).otherwise(F.col("page_blob")).alias("page_blob"))
    fails = spark.createDataFrame([("f", i, b"x" * 9) for i in range(3)] + [("f", 2, b"again")], "name string, seq long, chunk binary")
    for write in (lambda: ranged.write_chunks(fails, out), lambda: books.write_containers(bad, out)):
        with pytest.raises(Exception, match="order|lost"):
            write()
    assert len([x for x in os.listdir(out) if not x.startswith(".")]) == 4 and not glob.glob(f"{out}/.writing-*")


def test_too_many_pages(spark, tmp_path):
    df = spark.range(65_537).select(F.lit("b").alias("book"), (F.col("id") + 1).cast("int").alias("page_no"), F.lit(page(1)).alias("page_blob"))
    with pytest.raises(Exception, match="65537 pages"):
        books.write_containers(df, str(tmp_path / "out"))
    books.write_containers(df.where("page_no <= 65535"), str(tmp_path / "out"))
    assert container.containers(spark, str(tmp_path / "out"), "counts").first().page_count == 65_535


def test_killed_task(tmp_path):
    """What an attempt that died had written is no part of the file, and goes with the commit."""
    import pyarrow as pa

    w = ranged.ChunkWriter(str(tmp_path), "job")
    batch = lambda seqs: pa.RecordBatch.from_pydict({"name": ["f"] * len(seqs), "seq": seqs, "chunk": [b"%d" % s for s in seqs]})

    def dies():
        yield batch([0, 1])
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        w.write(dies())
    assert os.listdir(tmp_path) == [".writing-job"]
    w.commit([w.write(iter([batch([0, 1]), batch([2])])), None])
    assert os.listdir(tmp_path) == ["f"] and (tmp_path / "f").read_bytes() == b"012"
    with pytest.raises(ValueError):
        w.commit([w.write(iter([batch([0])])), w.write(iter([batch([1])]))])
    assert (tmp_path / "f").read_bytes() == b"012" and os.listdir(tmp_path) == ["f"]


def zipped(path, files, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, raw in files:
            z.writestr(name, raw)


def test_bad_entries(spark, tmp_path):
    texts = [(f"{n}.png", n.encode() * 500) for n in ("a", "B", "c", "d", "é")]
    zipped(tmp_path / "good.cbz", [*texts, ("__MACOSX/a.png", b"x"), ("x.txt", b"x"), ("folder/", b"")])
    raw = bytearray((tmp_path / "good.cbz").read_bytes())
    z = zipfile.ZipFile(io.BytesIO(bytes(raw)))
    at = {i.filename: i.header_offset for i in z.infolist()}
    raw[at["B.png"] + 30 + 5 + 4] ^= 0xFF
    central = raw.find(b"PK\1\2")
    while raw[central + 46 : central + 51] != b"c.png":
        central = raw.find(b"PK\1\2", central + 1)
    raw[central + 8] |= 1  # encrypted
    while raw[central + 46 : central + 51] != b"d.png":
        central = raw.find(b"PK\1\2", central + 1)
    raw[central + 10] = 12  # bzip2
    (tmp_path / "some.zip").write_bytes(b"before it" + bytes(raw))
    (tmp_path / "broken.cbz").write_bytes(bytes(raw[: len(raw) // 2]))
    rows = archive.entries(spark, str(tmp_path)).collect()
    got = {(os.path.basename(r.book), r.entry_path): (None if r.content is None else bytes(r.content), r.page_no, r.error is None) for r in rows}
    want = {("good.cbz", n): (t, i, True) for i, (n, t) in enumerate(texts[:4] + texts[4:], 1)}
    want |= {("some.zip", n): (t, i, True) for i, (n, t) in enumerate(texts, 1)} | {("some.zip", n): (None, i, False) for n, i in (("B.png", 2), ("c.png", 3), ("d.png", 4))} | {("broken.cbz", None): (None, None, False)}
    assert got == want and len(rows) == len(want)
    small = archive.archives(spark, str(tmp_path / "good.cbz"), slice_bytes=40).collect()
    assert sorted((r.entry_path, bytes(r.content)) for r in small) == sorted(texts)


def test_archives_merged_and_split(spark, tmp_path):
    src, out, cut = (str(tmp_path / x) for x in ("src", "out", "cut"))
    os.mkdir(src)
    files = {f"{b}.cbz": [(f"{'pP'[i % 2]}{i:03d}.{'png' if i % 3 else 'JPG'}", f"{b}{i}".encode() * (1 + i)) for i in range(40)] for b in ("one", "two", "three")}
    for i, (name, some) in enumerate(files.items()):
        zipped(f"{src}/{name}", some[::-1], zipfile.ZIP_STORED if i == 1 else zipfile.ZIP_DEFLATED)
    sets = spark.createDataFrame([(f"{src}/two.cbz", "m.cbz", 1), (f"{src}/one.cbz", "m.cbz", 2), (f"{src}/three.cbz", "other.cbz", 1)], "book string, name string, file_idx int")
    archive.merge_archives(spark, src, sets, out)
    order = lambda b: sorted(files[b], key=lambda x: (x[0].lower(), x[0].swapcase()))
    for name, parts in (("m.cbz", ["two.cbz", "one.cbz"]), ("other.cbz", ["three.cbz"])):
        z = zipfile.ZipFile(f"{out}/{name}")
        want = [x for p in parts for x in order(p)]
        assert z.testzip() is None and z.namelist() == [f"{i:05d}.{n.rpartition('.')[2].lower()}" for i, (n, _) in enumerate(want, 1)]
        assert [z.read(n) for n in z.namelist()] == [x for _, x in want]
    ranges = spark.createDataFrame([(f"{src}/one.cbz", "a.cbz", 1, 7), (f"{src}/one.cbz", "b.cbz", 5, 5), (f"{src}/two.cbz", "c.cbz", 39, 90)], "book string, name string, start int, end int")
    archive.split_archives(spark, src, ranges, cut)
    for name, b, lo, hi in (("a.cbz", "one.cbz", 0, 7), ("b.cbz", "one.cbz", 4, 5), ("c.cbz", "two.cbz", 38, 40)):
        z = zipfile.ZipFile(f"{cut}/{name}")
        assert z.testzip() is None and [z.read(n) for n in sorted(z.namelist())] == [x for _, x in order(b)[lo:hi]]
    (tmp_path / "src/bad.cbz").write_bytes(b"no")
    with pytest.raises(Exception, match="not a zip"):
        archive.merge_archives(spark, src, sets, out)


def test_compressors_one_at_a_time(spark, tmp_path):
    """A compressor holds 260 KB and more: a batch of 8,000 small members has no 8,000 of them."""
    def peak(batches):
        # the highest memory of this worker and of those before it in the task
        import resource

        import pyarrow as pa

        for b in batches:
            b.num_rows
        mb = max(int(line.split()[1]) for p in glob.glob("/proc/[0-9]*/status") for text in [open(p).read()] if f"PPid:\t{os.getppid()}\n" in text for line in text.splitlines() if line.startswith("VmHWM")) // 1024
        yield pa.RecordBatch.from_pydict({"mb": [max(mb, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)]})

    rows = spark.range(8_000, numPartitions=1).select(F.lit("a").alias("name"), F.concat(F.lit("text "), F.col("id").cast("string")).cast("binary").alias("png"))
    assert archive.packed_images(rows, squeeze=True).mapInArrow(peak, "mb long").first().mb < 400


def test_merges_read_members_in_place(spark, tmp_path):
    """Merged files have the members' bytes, but no task shuffles or stores them: rows of places are small."""
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    os.mkdir(src)
    files = {b: [(f"{i:03d}.png", random.Random(f"{b}{i}").randbytes(20_000)) for i in range(100)] for b in "ab"}
    for b, some in files.items():
        zipped(f"{src}/{b}.cbz", some)
    sets = spark.createDataFrame([(f"{src}/{b}.cbz", "m.cbz", i) for i, b in enumerate("ab")], "book string, name string, file_idx int")
    with stored_bytes() as seen:
        archive.merge_archives(spark, src, sets, out)
    z = zipfile.ZipFile(f"{out}/m.cbz")
    assert z.testzip() is None and [z.read(n) for n in sorted(z.namelist())] == [x for b in "ab" for _, x in files[b]]
    assert 0 < sum(seen) < 400_000  # of 4 MB


def test_splits_read_members_in_place(spark, tmp_path):
    """The same for parts that overlap: two with nearly all members, stored as places alone."""
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    os.mkdir(src)
    some = [(f"{i:03d}.png", random.Random(i).randbytes(20_000)) for i in range(100)]
    zipped(f"{src}/a.cbz", some[::-1])
    ranges = spark.createDataFrame([(f"{src}/a.cbz", "x.cbz", 1, 99), (f"{src}/a.cbz", "y.cbz", 2, 100)], "book string, name string, start int, end int")
    with stored_bytes() as seen:
        archive.split_archives(spark, src, ranges, out)
    for name, lo, hi in (("x.cbz", 0, 99), ("y.cbz", 1, 100)):
        z = zipfile.ZipFile(f"{out}/{name}")
        assert z.testzip() is None and [z.read(n) for n in sorted(z.namelist())] == [x for _, x in some[lo:hi]]
    assert 0 < sum(seen) < 400_000  # of 4 MB


@contextlib.contextmanager
def stored_bytes():
    """What archives put in scratch tables."""
    seen, kept = [], archive.stored

    def storing(df):
        found, drop = kept(df)
        seen.append(sum(os.path.getsize("/" + p.partition(":")[2].lstrip("/")) for p in found.inputFiles()))
        return found, drop

    with pytest.MonkeyPatch.context() as m:
        m.setattr(archive, "stored", storing)
        yield seen


def test_directory_in_pieces(tmp_path):
    """A directory of 60,000 entries is read piece by piece; no task holds it."""
    import tracemalloc

    n, at, entries, heads = 60_000, 0, [], []
    for i in range(n):
        name = b"%06d.png" % i
        heads.append(archive.local_header(name, 0, 0, 0, 0))
        entries.append(archive.directory_entry(name, 0, 0, 0, 0, at))
        at += len(heads[-1])
    made = b"".join(entries)
    (tmp_path / "a.zip").write_bytes(b"".join(heads) + made + archive.directory_end(n, len(made), at))
    reader = archive.ArchiveReader({"path": str(tmp_path), "what": "directory"})
    tracemalloc.start()
    rows = sum(1 for part in reader.partitions() for _ in reader.rows(part))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and most < 8 << 20
    # slices share the entries out, and a directory that lacks a part is one error
    reader = archive.ArchiveReader({"path": str(tmp_path), "what": "contents", "slice": 1 << 20})
    assert sorted(r["entry_path"] for part in reader.partitions() for r in reader.rows(part)) == [f"{i:06d}.png" for i in range(n)]
    (tmp_path / "a.zip").write_bytes(b"".join(heads) + made[:-112] + b"x" * 112 + archive.directory_end(n, len(made), at))
    assert [r["error"] for part in reader.partitions() for r in reader.rows(part)] == [f"the directory ends after {n - 2} of {n} entries"]


def test_directories_by_parts(spark, tmp_path):
    """Offsets run on over parts and names, in whatever order members come; no row holds more than a batch of entries."""
    sizes = {b: [random.Random(f"{b}{i}").randrange(50) for i in range(n)] for b, n in (("a", 25_000), ("b", 3))}
    rows = [(b, i, f"{i}.png", 0, i, s, s) for b, some in sizes.items() for i, s in enumerate(some, 1)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "name string, page_no int, entry string, method int, crc long, packed long, bytes long")
    made = sorted(archive.directories(df, 10_000_000).collect(), key=lambda r: (r.name, r.seq))
    for b, some in sizes.items():
        at, want = 0, b""
        for i, s in enumerate(some, 1):
            want += archive.directory_entry(b"%d.png" % i, 0, i, s, s, at)
            at += 30 + len(f"{i}.png") + s
        assert b"".join(bytes(r.chunk) for r in made if r.name == b) == want + archive.directory_end(len(some), len(want), at)
    assert max(len(r.chunk) for r in made) < 700_000  # of 1.3 MB
    again = sorted(archive.directories(df, 7).collect(), key=lambda r: (r.name, r.seq))
    assert len(again) > len(made) and len({b"".join(bytes(r.chunk) for r in x if r.name == "a") for x in (made, again)}) == 1


def test_wide_archives(tmp_path):
    """Numbers beyond the old format's are written and read in the wide one."""
    n = 70_000
    body = b"".join(archive.local_header(b"%d.png" % i, 0, 0, 0, 0) for i in range(n))
    at, listed = 0, []
    for i in range(n):
        listed.append(archive.directory_entry(b"%d.png" % i, 0, 0, 0, 0, at))
        at += 30 + len(b"%d.png" % i)
    made = b"".join(listed)
    (tmp_path / "a.zip").write_bytes(body + made + archive.directory_end(n, len(made), len(body)))
    assert len(zipfile.ZipFile(tmp_path / "a.zip").namelist()) == n
    assert len(archive.tail(ranged.Ranged(str(tmp_path / "a.zip")))) == n
    big = archive.directory_entry(b"x.png", 0, 1, 5 << 30, 6 << 30, 7 << 30)
    info = archive.tail(type("F", (), {"size": len(big) + 22, "at": lambda self, o, s, raw=big + archive.directory_end(1, len(big), 0): raw[o : o + s]})())
    assert (info[0]["packed_bytes"], info[0]["bytes"], info[0]["offset"]) == (5 << 30, 6 << 30, 7 << 30)


def test_stitch_stream(spark, tmp_path):
    """Pages in any batching and order, with a restart from the checkpoint in between, give the batch form's slices."""
    rng = np.random.default_rng(3)
    rows = []
    for book in ("a", "b"):
        for n in range(1, 8):
            w, h = (int(v) for v in rng.integers(4, 20, 2))
            data = np.full(h * w * 3, 90, np.uint8) if n == 3 else rng.integers(0, 256, h * w * 3, np.uint8)
            rows.append((book, n, w, h, data.tobytes(), False))
        rows[-1] = (*rows[-1][:4], b"no raster", False)
    kind = "book string, page_no int, width int, height int, data binary, last boolean"
    options = {"size": (8, 10), "overlap": 30, "contrast": 2, "gamma": 1.8, "invert": True, "two_bit": True, "dithering": "floyd"}
    want = sorted(tuple(r) for r in raster.stitch(spark.createDataFrame(rows, kind), **options).collect())
    ends = [("a", 8, None, None, None, True), ("b", 8, None, None, None, True)]
    order = [rows[:3] + rows[9:11], rows[4:7] + rows[:2], [rows[3], ends[0], *rows[7:9]], rows[11:] + [ends[1]], rows[:4]]
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, stateful.ROCKS)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    try:
        for part in order:
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
            pages = spark.readStream.schema(kind).parquet(source)
            q = stateful.stream_stitch(pages, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            assert q.awaitTermination(120)
    finally:
        spark.conf.set(provider, before)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == want and want


def test_expired_results(spark, tmp_path, monkeypatch):
    """Lifetimes over several batches: results stored again while they live or after, ends at the very clock, many of one session; the
    state store is called some times a session and batch, not for each result."""
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    batches = [
        [(i, "big", at(i // 3)) for i in range(3_000)] + [(1, "a", at(5)), (1, "a", at(9)), (2, "b", at(7)), (9, "c", at(1001)), (8, "e", at(1))],
        [(1, "a", at(1_002)), (3, "b", at(2_000)), (None, "b", at(1_500)), (4, "b", None)],
        [(5, "d", at(3_001))],
        [(6, "d", at(9_000))],
    ]
    kind = "id long, session_id string, created_at timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, stateful.ROCKS)
    try:
        for rows in batches:
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
            found = stateful.expired_results(spark.readStream.schema(kind).parquet(source), 1_000_000)
            q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            assert q.awaitTermination(240)
            made = spark.read.schema(found.schema).parquet(out)
            if rows is batches[0]:
                # the clock stands at 1001 s; what ends then is over
                assert {(r.session_id, r.expired_ms - 1704067200000) for r in made.collect()} == {("big", 1_000_000), ("big", 1_001_000), ("e", 1_001_000)}
    finally:
        spark.conf.set(provider, before)
    got = {(r.session_id, (r.expired_ms - 1704067200000) // 1000): r.ids for r in made.collect()}
    want = {("big", 1_000 + s): [3 * s, 3 * s + 1, 3 * s + 2] for s in range(1_000)} | {("e", 1_001): [8], ("a", 1_005): [1], ("b", 1_007): [2], ("c", 2_001): [9], ("b", 3_000): [3], ("d", 4_001): [5]}
    assert got == want and made.count() == len(want)
    calls = []
    handle = type("H", (), {"registerTimer": lambda self, t: calls.append(t), "deleteTimer": lambda self, t: calls.append(t)})()
    state = type("V", (), {"get": lambda self: calls.append("get"), "exists": lambda self: calls.append("exists"), "update": lambda self, v: calls.append("update")})()
    one = stateful.Lifetimes(1_000)
    one.handle, one.living = handle, state
    import pandas as pd

    assert list(one.handleInputRows(("s",), iter([pd.DataFrame({"id": range(1_000), "created_ms": range(1_000)})]), None)) == [] and len(calls) < 5


def test_streamed_files(spark, tmp_path):
    """Books of each batch become files; chunks of a stream, too, and a repeated batch replaces its own."""
    blobs = {b: [page(9 * i + n) for i in range(n)] for n, b in enumerate("pqr", 1)}
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for b, some in blobs.items():
        spark.createDataFrame([(b, i + 1, x) for i, x in enumerate(some)], "book string, page_no int, page_blob binary").coalesce(1).write.mode("append").parquet(source)
    pages = spark.readStream.schema("book string, page_no int, page_blob binary").option("maxFilesPerTrigger", 1).parquet(source)
    q = books.stream_containers(pages, out, str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert {os.path.basename(p): open(p, "rb").read() for p in glob.glob(f"{out}/*")} == {f"{b}.xtc": container.build(some) for b, some in blobs.items()}
    chunks = spark.createDataFrame([("a", i, b"%d" % i) for i in range(5)] + [("b", 0, b"x")], "name string, seq long, chunk binary").coalesce(1)
    chunks.write.parquet(str(tmp_path / "chunks"))
    ranged.register(spark, ranged.ChunkFiles)
    stream = spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "chunks"))
    for check in ("one", "two"):  # the second time all over again
        q = stream.writeStream.format("inkframe_chunks").option("path", out).option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    assert open(f"{out}/a", "rb").read() == b"01234" and open(f"{out}/b", "rb").read() == b"x" and len(os.listdir(out)) == 5


def test_strip_tone():
    """Stretch, gamma, inversion and gray, in this order, pixel by pixel."""
    rng = np.random.default_rng(4)
    rgb = rng.integers(0, 256, (9, 7, 3), np.uint8)
    half_even = lambda v: int(np.rint(v))
    for contrast, gamma, invert in ((0, 1.0, False), (4, 1.0, True), (2, 2.2, True), (0, 0.5, False), (8, 1.5, False)):
        black, white = raster.contrast_points(rgb, contrast) if contrast else (0, 255)
        want = []
        for r in rgb.reshape(-1, 3).tolist():
            v = [half_even(max(0, min(255, (c - black) / (white - black) * 255))) if contrast and white > black else c for c in r]
            v = [int(np.floor(pow(c / 255, gamma) * 255 + 0.5)) if gamma != 1 else c for c in v]
            v = [255 - c if invert else c for c in v]
            want.append(half_even(0.299 * v[0] + 0.587 * v[1] + 0.114 * v[2]))
        assert raster.strip_tone(rgb, contrast, gamma, invert).ravel().tolist() == want


def test_scratch_path(spark):
    assert ranged.scratch_path(spark) != ranged.scratch_path(spark)
    assert ranged.opened("file:/a b/c")[1] == ranged.opened("file:///a b/c")[1] == ranged.opened("/a b/c")[1] == "/a b/c"
    assert tempfile.gettempdir()
