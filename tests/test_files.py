"""Files read and written: archives' images, folders of images, header counts, names."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from inkframe.functions import names as N
from inkframe.operators import books, dither
from inkframe.sources import archive, container
from inkframe.streaming import strip


def png_rows(png):
    """Grays of an unfiltered PNG."""
    assert png[:8] == b"\x89PNG\r\n\x1a\n"
    w, h = int.from_bytes(png[16:20], "big"), int.from_bytes(png[20:24], "big")
    at, data = 8, b""
    while at < len(png):
        size, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + size]
        assert int.from_bytes(png[at + 8 + size : at + 12 + size], "big") == zlib.crc32(kind + body)
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, w + 1)
    assert not rows[:, 0].any()
    return rows[:, 1:]


def test_archive_entries(spark):
    rng = np.random.default_rng(1)
    pages = dither.dither(rng.integers(0, 256, (3, 5, 9), np.uint8), "floyd", True)
    blobs = [dither.page_blob(p, 9, 5, True) for p in dither.pack(pages, True)]
    rows = [("a", i + 1, bytearray(b)) for i, b in enumerate(blobs)] + [("a", 4, bytearray(b"XTG\0")), ("b", 1, None), ("b", 123456, bytearray(b""))]
    df = spark.createDataFrame(rows, "book string, page_no int, page_blob binary").repartition(3)
    got = {(x.book, x.name): x.png for x in books.archive_entries(df).collect()}
    assert len(got) == len(rows)
    for i, p in enumerate(pages, 1):
        assert (png_rows(bytes(got["a", f"{i:05d}.png"])) == p).all()
    assert got["a", "00004.png"] is None and got["b", "00001.png"] is None
    back = dither.decode_pages(df.withColumn("gray", F.lit(1))).collect()
    assert sum(x.error is not None for x in back) == 3 and {(x.width, x.height) for x in back if not x.error} == {(9, 5)}
    assert dither.decode_pages(df.limit(0)).count() == 0


def test_directory(spark, tmp_path):
    for name in ("x/b.png", "x/a.JPG", "x/c.txt", "y/z/1.webp"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    pages = archive.directory(spark, str(tmp_path)).collect()
    assert sorted((x.book.rpartition("/")[2], bytes(x.content), x.page_no) for x in pages) == [("x", b"x/a.JPG", 1), ("x", b"x/b.png", 2), ("z", b"y/z/1.webp", 1)]


def test_page_counts(spark, tmp_path):
    blob = dither.page_blob(b"\0" * 4, 8, 4)
    (tmp_path / "a.xtc").write_bytes(container.build([blob] * 300, meta=("t",)))
    (tmp_path / "b.xtc").write_bytes(b"PK\3\4 something else")
    (tmp_path / "c.xtc").write_bytes(b"X")
    got = {x.book[-5]: x.page_count for x in container.page_counts(spark, str(tmp_path)).collect()}
    assert got == {"a": 300, "b": None, "c": None}


def test_names(spark):
    rows = [("a.b/c",), ("x.cbz",), ("",), (None,)]
    df = spark.createDataFrame(rows, "name string")
    got = [r[0] for r in df.select(N.part_name(F.col("name"), F.lit(2), F.lit("xtc"))).collect()]
    assert got == ["a.b/c_part2.xtc", "x_part2.xtc", "_part2.xtc", None]
    assert [r[0] for r in df.select(N.input_kind(F.col("name"))).collect()] == [None, "comic", None, None]


def test_last_page(spark):
    df = spark.createDataFrame([("a", 1, "p"), ("a", 3, "q"), ("b", 2, None)], "book string, page_no int, more string")
    assert sorted((x.book, x.page_no, x.more) for x in strip.last_page(df, "book").collect()) == [("a", 3, "q"), ("b", 2, None)]
    assert not strip.last_page(df.limit(0), "book").collect()
