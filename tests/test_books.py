"""Conversions, strips, containers and running sums against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe.operators import books, dither, paging, raster, store
from inkframe.sources import container, feed


def plain_tone(rgb, contrast, gamma, invert):
    h, w, _ = rgb.shape
    hist = [0] * 256
    for y in range(h):
        for x in range(w):
            r, g, b = (int(v) for v in rgb[y, x])
            hist[int(0.299 * r + 0.587 * g + 0.114 * b + 0.5)] += 1
    black, white = 0, 255
    if contrast:
        count = 0
        for i in range(256):
            count += hist[i]
            if count >= w * h * 3 * contrast / 100:
                black = i
                break
        count = 0
        for i in reversed(range(256)):
            count += hist[i]
            if count >= w * h * (3 + 9 * contrast) / 100:
                white = i
                break
    out = np.zeros((h, w), np.uint8)
    for y in range(h):
        for x in range(w):
            v = [255 - int(c) if invert else int(c) for c in rgb[y, x]]
            if contrast and white > black:
                v = [max(0, min(255, int((c - black) * 255 / (white - black)))) for c in v]
            gray = (77 * v[0] + 150 * v[1] + 29 * v[2]) >> 8
            out[y, x] = int((gray / 255) ** gamma * 255 + 0.5) if gamma != 1 else gray
    return out


def plain_box(a, w, h):
    out = np.zeros((h, w, 3), np.uint8)
    sx, sy = np.float32(a.shape[1]) / np.float32(w), np.float32(a.shape[0]) / np.float32(h)
    for y in range(h):
        for x in range(w):
            y1, x1 = int(np.ceil(np.float32(y + 1) * sy)), int(np.ceil(np.float32(x + 1) * sx))
            window = a[int(np.float32(y) * sy) : y1, int(np.float32(x) * sx) : x1].reshape(-1, 3).astype(int)
            out[y, x] = window.sum(0) // len(window)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_kernels(seed):
    r = np.random.default_rng(seed)
    rgb = r.integers(0, 256, (r.integers(1, 30), r.integers(1, 30), 3), np.uint8)
    for options in ((0, 1.0, False), (4, 1.0, True), (2, 1.8, False), (8, 0.7, True)):
        assert (raster.tone(rgb, *options) == plain_tone(rgb, *options)).all()
    w, h = int(r.integers(1, 40)), int(r.integers(1, 40))
    assert (raster.resize_box(rgb, w, h) == plain_box(rgb, w, h)).all()


def images(spark, rows):
    return spark.createDataFrame(rows, "id long, width int, height int, data binary")


@pytest.mark.parametrize("options", [{"split": "half", "upright": True}, {"split": "nosplit", "single": "crop"}, {"split": "nosplit", "single": "cover", "landscape": True}, {"strip_overlap": 25}, {"horizontal": 20.0, "vertical": 5.0, "portrait": True, "pad_black": True}])
def test_convert(spark, options):
    r = random.Random(str(options))
    rows = [(i, w, h, r.randbytes(w * h * n)) for i, (w, h, n) in enumerate([(10, 30, 1), (25, 12, 3), (1, 1, 1), (7, 90, 1), (40, 40, 3)])]
    bad = [(10, 8, 8, b"abc"), (11, None, 3, b"abc"), (12, 0, 0, b""), (13, 3, 1, None)]
    got = raster.convert(images(spark, rows + bad + rows[:1]), ["id"], size=(16, 20), dithering="floyd", two_bit=True, contrast=2, **options).collect()
    by_id = {}
    for x in got:
        by_id.setdefault(x.id, []).append(x)
    assert all(len(by_id[i[0]]) == 1 and by_id[i[0]][0].error and by_id[i[0]][0].page_blob is None for i in bad)
    for i, w, h, _ in rows:
        pages = sorted(by_id[i], key=lambda x: x.out_idx)
        assert pages and all(x.error is None for x in pages)
        for x in pages:
            assert dither.unpack(bytes(x.page_blob))[:2] == (16, 20)
        if "split" in options and options["split"] == "half":
            assert [x.kind for x in pages[:: 2 if i == 0 else 1]] == ["upright"] + (["segment"] * 2 if w < h else ["whole"])
    assert len(by_id[0]) % 2 == 0
    assert raster.convert(images(spark, rows).limit(0), ["id"], size=(16, 20), **options).count() == 0


def plain_stitch(pages, w, h, overlap):
    strip, out = np.empty((0, w), np.uint8), []
    for a in pages:
        strip = np.concatenate([strip, raster.luma(plain_box(a, w, int(a.shape[0] * (w / a.shape[1])))).astype(np.uint8)])
        while len(strip) >= h:
            solid = strip[:h].std() < 5
            out.append((bool(solid), strip[:h]))
            strip = strip[h if solid else h - int(h * (overlap or 50) / 100) :]
    if len(strip):
        out.append((False, np.concatenate([strip, np.full((h - len(strip), w), 255, np.uint8)])))
    return out


@pytest.mark.parametrize("overlap", [0, 30])
def test_stitch(spark, overlap):
    r = np.random.default_rng(overlap)
    rows, want = [], {}
    for book in range(4):
        pages = []
        for n in range(12):
            w, h = (int(v) for v in r.integers(3, 30, 2))
            a = np.full((h, w, 1), 200, np.uint8) if r.random() < 0.4 else r.integers(0, 256, (h, w, 1), np.uint8)
            rows.append((book, n, w, h, a.tobytes()))
            pages.append(np.repeat(a, 3, axis=2))
        want[book] = plain_stitch(pages, 16, 20, overlap)
    rows.append((2, 5, 4, 4, b"bad"))
    df = spark.createDataFrame(rows, "book int, page_no int, width int, height int, data binary").repartition(5)
    got = {}
    for x in raster.stitch(df, (16, 20), overlap).orderBy("book", "slice_no").collect():
        got.setdefault(x.book, []).append((x.solid, bytes(x.page_blob)))
    encode = lambda a: dither.page_blob(dither.pack(dither.dither(a[None], "none"))[0], 16, 20)
    assert got == {b: [(s, encode(a)) for s, a in x] for b, x in want.items()}
    assert raster.stitch(df.limit(0), (16, 20)).count() == 0


def test_container_chunks(spark):
    r = random.Random(1)
    blobs = {b: [dither.page_blob(r.randbytes(8 * (1 + i % 3)), 8, 8 * (1 + i % 3)) for i in range(n)] for b, n in (("x", 5), ("y", 300))}
    df = spark.createDataFrame([(b, i + 1, x) for b, some in blobs.items() for i, x in enumerate(some)], "book string, page_no int, page_blob binary")
    files = {}
    for x in books.container_chunks(df).orderBy("book", "seq").collect():
        assert len(files.setdefault(x.book, b"")) == x.offset
        files[x.book] += bytes(x.chunk)
    assert files == {b: container.build(some) for b, some in blobs.items()}


def test_container_offsets():
    """Metadata and chapters are read where the header says."""
    page = dither.page_blob(b"\1" * 8, 8, 8)
    raw = container.build([page], meta=("T", "A"), toc=[("c", 1, 1)], cover=0)
    moved = bytearray(raw) + raw[56:312] + b"..." + raw[312:408]
    moved[3] = ord("?")
    moved[16:24], moved[48:56] = len(raw).to_bytes(8, "little"), (len(raw) + 259).to_bytes(8, "little")
    moved[56:408] = bytes(352)
    (info, toc, pages), (old, old_toc, _) = container.parse(bytes(moved)), container.parse(raw)
    assert (info, toc, pages) == (old, old_toc, [page]) and toc == [("c", 1, 1)] and info["title"] == "T"


def test_running(spark):
    """Sums and numbers are the same however a book is cut into ranges."""
    r = random.Random(2)
    rows = [(r.choice("aaaaaab"), i, r.randrange(9)) for i in r.sample(range(10_000), 3000)]
    df = spark.createDataFrame(rows, "book string, at long, n long")
    want, sums, count = {}, {}, {}
    for b, i, n in sorted(rows):
        count[b] = count.get(b, 0) + 1
        want[b, i] = (sums.get(b, 0), count[b])
        sums[b] = sums.get(b, 0) + n
    for parts in (1, 2, 40):
        got = paging.running(df, "book", "at", {"before": "n"}, {"total": "n"}, "no", parts).collect()
        assert {(x.book, x.at): (x.before, x.no) for x in got} == want and all(x.total == sums[x.book] for x in got)
    assert paging.running(df.limit(0), "book", "at", {"before": "n"}, count="no").count() == 0


def test_running_ties(spark):
    """Equal numbers come in the order of the other columns, nulls first, in any partitioning; bytes don't count."""
    rows = [("a", i // 20, None if i % 20 == 7 else (i * 37) % 101, b"x" * (i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "book string, at long, n long, page_blob binary")
    want = sorted(((at, -1 if n is None else n) for _, at, n, _ in rows))
    loose = spark.createDataFrame([(None, i if i else None, 1) for i in range(9)] + [("b", i, 1) for i in range(5)], "book string, at long, n long")
    for cut in (2, 100):
        got = paging.running(loose, "book", "at", {"before": "n"}, {"total": "n"}, "no", cut).collect()
        assert sorted((x.book or "", x.at or 0, x.no, x.before, x.total) for x in got) == [("", i, i + 1, i, 9) for i in range(9)] + [("b", i, i + 1, i, 5) for i in range(5)]
    for parts, cut in ((1, 500), (5, 500), (5, 9)):
        got = sorted(paging.running(df.repartition(parts), "book", "at", {}, count="no", rows_a_range=cut).collect(), key=lambda x: x.no)
        assert [(x.at, -1 if x.n is None else x.n) for x in got] == want and [x.no for x in got] == list(range(1, 401))


def test_store_append(spark, tmp_path):
    df = spark.createDataFrame([(1, 7, "2024-01-01 10:00:00"), (2, 8, "2024-01-02 10:00:00")], "id long, session_id long, t string").withColumn("created_at", F.to_timestamp("t"))
    for _ in range(2):
        store.append(df, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 4 and store.by_session(back, 8).count() == 2 and store.newest_first(back).first().id == 2


def test_feed_odd(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "no xml"), (4, "<rss><channel></channel></rss>")], "id int, xml string")
    assert feed.items(df, "xml").count() == 0


def plain_dither(page, algorithm, two_bit):
    """Place by place in the order of rows and columns."""
    h, w = page.shape
    plane = page.astype(np.float32)
    divisor, shares = dither.KERNELS.get(algorithm, dither.KERNELS["floyd"])
    for y in range(h):
        for x in range(w):
            old = np.float64(plane[y, x])
            plane[y, x] = new = float(dither.levels(np.array(old), two_bit))
            if algorithm == "ostromoukhov":
                v = min(255.0, max(0.0, old))
                t = v / 128.0 if v <= 128 else (v - 128) / 127.0
                ends = [(0.7, 0.3, 1, 0), (0.2, 0.4, -1, 1), (0.1, 0.3, 0, 1)]
                parts = [(dx, dy, (old - new) * (a * (1 - t) + b * t if v <= 128 else b * (1 - t) + a * t)) for a, b, dx, dy in ends]
            else:
                parts = [(dx, dy, (old - new) / divisor * weight) for dx, dy, weight in shares]
            for dx, dy, part in parts:
                if 0 <= x + dx < w and y + dy < h:
                    plane[y + dy, x + dx] = np.float32(np.float64(plane[y + dy, x + dx]) + part)
    return np.clip(plane, 0, 255).astype(np.uint8)


@pytest.mark.parametrize("algorithm", [*dither.KERNELS, "ostromoukhov", "other"])
def test_dither_plain(algorithm):
    r = np.random.default_rng(7)
    for h, w in ((1, 1), (1, 9), (9, 1), (2, 3), (13, 7), (6, 17)):
        pages = r.integers(0, 256, (3, h, w), np.uint8)
        for two_bit in (False, True):
            assert (dither.dither(pages, algorithm, two_bit) == np.stack([plain_dither(p, algorithm, two_bit) for p in pages])).all()


def test_encode_odd(spark):
    rows = [(1, 8, bytes(16)), (2, 5, bytes(16)), (3, 8, b""), (4, None, bytes(8)), (5, 8, None), (6, 4, bytes(16)), (1, 8, bytes(16))]
    df = spark.createDataFrame([(*x, "old") for x in rows], "vec_id long, w int, gray binary, page_blob string")
    got = [(x.vec_id, x.page_blob and dither.unpack(bytes(x.page_blob))[:2]) for x in dither.encode_pages(df, width_col="w").collect()]
    assert sorted(got, key=str) == sorted([(1, (8, 2)), (2, None), (3, None), (4, None), (5, None), (6, (4, 4)), (1, (8, 2))], key=str)
