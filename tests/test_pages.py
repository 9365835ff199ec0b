"""Golden vectors and round trips of pages, containers and archives; streams against batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe.functions import geometry as G
from inkframe.functions import names as N
from inkframe.functions.pixels import contrast_points, hilbert
from inkframe.operators import dither
from inkframe.sources import archive, comicinfo, container
from inkframe.streaming import strip

RASTER = np.minimum(255, 32 * np.arange(8) + 8 * np.arange(4)[:, None]).astype(np.uint8)
# Payloads of RASTER by algorithm.
GOLDEN = {
    "none": ("0f0f0f0f", "00e0f0f00000c0f000000000f0f0f0f0"),
    "floyd": ("17152f17", "00d0f0b01000a0f000000040e0f0f0f0"),
    "atkinson": ("0f17172f", "00e0f0f0000080f000000000f0f0f0f0"),
    "stucki": ("0f172b1f", "00e0f0f0000080f000000000f0f0f0f0"),
    "zhoufang": ("0f17172f", "00e0f0f0000080f000000000f0f0f0f0"),
    "sierra-lite": ("17152f17", "00d0f0b01000a0f000000040e0f0f0f0"),
    "ostromoukhov": ("1715175f", "00d0f0b01000a0f000000040e0f0f0f0"),
    "stochastic": ("2b27451f", "00e0f0b0100090f000000040e0f0f0f0"),
    "ordered": ("2f152b17", None),
}


@pytest.mark.parametrize("name", GOLDEN)
@pytest.mark.parametrize("two_bit", [False, True])
def test_payloads(name, two_bit):
    want = GOLDEN[name][two_bit]
    if want:
        assert dither.pack(dither.dither(RASTER[None], name, two_bit), two_bit)[0].hex() == want


def test_hilbert_order():
    assert hilbert(8, 8)[:12] == [(0, 0), (0, 1), (1, 1), (1, 0), (2, 0), (3, 0), (3, 1), (2, 1), (2, 2), (3, 2), (3, 3), (2, 3)]
    assert len(hilbert(5, 3)) == 15 and len(set(hilbert(16, 16))) == 256


@pytest.mark.parametrize("two_bit", [False, True])
@pytest.mark.parametrize("size", [(1, 1), (8, 8), (31, 50), (64, 7)])
def test_curve_walk(two_bit, size):
    """The running error against a walk that takes place after place."""
    h, w = size
    pages = np.random.default_rng(h).integers(0, 256, (3, h, w), dtype=np.uint8)
    pages[1:] = [[[0]], [[255]]]
    for page, got in zip(pages, dither.dither(pages, "stochastic", two_bit), strict=True):
        left, want = 0.0, np.empty_like(page)
        for x, y in hilbert(w, h):
            value = page[y, x] + left
            want[y, x] = dither.levels(np.array(value), two_bit)
            left = value - want[y, x]
        assert (want == got).all()


@pytest.mark.parametrize("level", [0, 1, 4, 8, 34])
def test_contrast_points_of_arrays(spark, level):
    """Places of sorted grays against a histogram's running counts."""
    rng = np.random.default_rng(level)
    rasters = [rng.integers(0, top, n).tolist() for top in (1, 5, 256) for n in (1, 2, 63, 64, 100)] + [[], None]
    df = spark.createDataFrame(list(enumerate(rasters)), "i int, g array<int>")
    black, white = contrast_points(F.col("g"), level)
    for r in df.select("i", black.alias("black"), white.alias("white")).collect():
        g = np.array(rasters[r.i] or [], int)
        counts = np.bincount(g, minlength=256)
        seen = np.flatnonzero(counts)
        dark = [v for v in seen if counts[: v + 1].sum() >= len(g) * (3 * level) / 100]
        light = [v for v in seen if counts[v:].sum() >= len(g) * (3 + 9 * level) / 100]
        assert (r.black, r.white) == (min(dark, default=0), max(light, default=255))


@pytest.mark.parametrize("two_bit", [False, True])
def test_page_round_trip(two_bit):
    pages = np.random.default_rng(1).integers(0, 256, (3, 13, 9), dtype=np.uint8)
    done = dither.dither(pages, "floyd", two_bit)
    for p, payload in zip(done, dither.pack(done, two_bit), strict=True):
        w, h, back = dither.unpack(dither.page_blob(payload, 9, 13, two_bit))
        assert (w, h) == (9, 13) and (back == p).all()


def test_container():
    blob = dither.page_blob(dither.pack(RASTER[None])[0], 8, 4)
    assert blob.hex() == "58544700080004000000040000000f0f0f0f000000000f0f0f0f"
    raw = container.build([blob, blob])
    assert len(raw) == 132 and raw[:80].hex() == "58544300010002000000000000000000000000000000000030000000000000005000000000000000000000000000000050000000000000001a000000080004006a000000000000001a00000008000400"
    rich = container.build([blob] * 3, meta=("Titel ü", "Author"), toc=[("a", 1, 2), ("b" * 100, 3, 3)], create_time=5, cover=1)
    info, toc, pages = container.parse(rich)
    assert info["title"] == "Titel ü" and info["author"] == "Author" and info["cover"] == 1 and toc[0] == ("a", 1, 2) and toc[1][0] == "b" * 79
    assert pages == [blob] * 3 and rich.index(blob) == 552
    with pytest.raises(ValueError):
        container.parse(b"nope")


def test_files(spark, tmp_path):
    (tmp_path / "a.cbz").write_bytes(archive.write_archive([b"x", b"y"]))
    (tmp_path / "b.cbz").write_bytes(b"broken")
    rows = archive.entries(spark, str(tmp_path / "*.cbz")).collect()
    assert [(r.entry_path, bytes(r.content), r.page_no) for r in rows if r.error is None] == [("00001.png", b"x", 1), ("00002.png", b"y", 2)]
    assert sum(r.error is not None for r in rows) == 1
    blob = dither.page_blob(b"\0" * 4, 8, 4)
    pages = spark.createDataFrame([("k", i, bytearray(blob)) for i in (2, 1)], "book string, page_no int, page_blob binary")
    raw = container.to_containers(pages).first().container
    (tmp_path / "k.xtc").write_bytes(bytes(raw))
    (tmp_path / "l.xtc").write_bytes(b"no")
    rows = container.read_pages(spark, str(tmp_path / "*.xtc")).collect()
    assert sorted((r.page_no, bytes(r.page_blob)) for r in rows if r.error is None) == [(1, blob), (2, blob)] and len(rows) == 3


def test_comicinfo(spark):
    xml = '<ComicInfo><Title>T</Title><Writer> </Writer><Artist>A </Artist><Pages><Page Image="0"/><Page Image="1" Bookmark="One"/></Pages></ComicInfo>'
    df = spark.createDataFrame([("b", xml)], "book string, xml string").withColumn("info", comicinfo.parse(F.col("xml")))
    assert df.select(comicinfo.author(F.col("info"))).first()[0] == "A"
    assert [tuple(r) for r in comicinfo.bookmarks(df, "book", "info").collect()] == [("b", 2, "One")]


def test_geometry(spark):
    df = spark.createDataFrame([(1000, 1500), (1000, 1780), (800, 4000), (1000, 10000), (1000, 1001)], "w int, h int")
    got = [r[0] for r in df.select(G.overlap_segments(F.col("w"), F.col("h"), 480, 800)).collect()]
    assert [[s.y for s in x] for x in got[:2]] == [[0, 450, 900], [0, 393, 786, 1179]]
    assert len(got[2]) == 9 and got[2][1].y == 440 and len(got[3]) == 10 and got[3][1].y == 1044 and got[4][2].h == 601
    one = spark.range(1)
    assert tuple(one.select(G.crop_rect(F.lit(1), F.lit(1), F.lit(20.0), F.lit(float("nan")))).first()[0]) == (0, 0, 1, 1)
    assert tuple(one.select(G.fit_rect(F.lit(1000), F.lit(1500), 480, 800, "cover")).first()[0]) == (-27, 0, 533, 800)


def test_ranges(spark):
    got = spark.range(1).select(N.page_ranges(F.lit("1-2-3, 3abc,-5,0,5-2, ,4-9"), F.lit(9))).first()[0]
    assert [(r.start, r.end) for r in got if not r.error] == [(1, 2), (3, 3), (4, 9)] and sum(r.error for r in got) == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", 1, 1000), ("a", 2, 700), ("a", 3, 300), ("b", 1, 100), ("c", 1, 800)]
    df = spark.createDataFrame(rows, "book string, page_no int, h int")
    batch = {(r.book, r.top) for r in strip.slices(df, 800, 50).where("slice_no is not null").collect()}
    assert batch == {("a", 0), ("a", 400), ("a", 800), ("a", 1200), ("c", 0)}
    for i in range(3):
        df.where(f"page_no = {i + 1}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = strip.stream_slices(stream, 800, 50).writeStream.format("memory").queryName("slices").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.book, r.top) for r in spark.table("slices").collect()} == batch
