"""Image files of every kind against plain encoders; chapters at fault against pairs; outlines and edits."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe.operators import books, dither, raster
from inkframe.sources import archive, container, images


def png_bytes(grid, kind, depth, interlaced, rng, palette=None, clear=b""):
    """A PNG with a random filter a row, byte by byte."""
    samples = grid.shape[2]

    def rows(g):
        if not g.shape[0] or not g.shape[1]:
            return b""
        if depth == 16:
            lines = g.astype(">u2").reshape(len(g), -1).view(np.uint8)
        elif depth == 8:
            lines = g.astype(np.uint8).reshape(len(g), -1)
        else:
            lines = np.packbits(((g[:, :, :1] >> np.arange(depth - 1, -1, -1)) & 1).reshape(len(g), -1).astype(np.uint8), axis=1)
        step, out, above = max(1, samples * depth // 8), b"", [0] * lines.shape[1]
        for row in lines.tolist():
            k, line = rng.randrange(5), []
            for i, v in enumerate(row):
                a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line.append((v - [0, a, b, (a + b) // 2, near][k]) & 255)
            out, above = out + bytes([k]) + bytes(line), row
        return out

    raw = b"".join(rows(grid[y::dy, x::dx]) for x, y, dx, dy in images.PASSES) if interlaced else rows(grid)
    part = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    z = zlib.compress(raw)
    out = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", grid.shape[1], grid.shape[0], depth, kind, 0, 0, int(interlaced)))
    out += part(b"PLTE", palette.tobytes()) if palette is not None else b""
    return out + (part(b"tRNS", clear) if clear else b"") + part(b"IDAT", z[: len(z) // 2]) + part(b"IDAT", z[len(z) // 2 :]) + part(b"IEND", b"")


@pytest.mark.parametrize("kind", [0, 2, 3, 4, 6])
def test_png(kind):
    rng, dice = np.random.default_rng(kind), random.Random(kind)
    for depth in images.DEPTHS[kind]:
        for interlaced in (False, True):
            for w, h in ((1, 1), (5, 3), (13, 17), (2, 9)):
                grid = rng.integers(0, 1 << depth, (h, w, images.CHANNELS[kind]))
                palette = rng.integers(0, 256, (1 << depth, 3), np.uint8) if kind == 3 else None
                eight = grid >> 8 if depth == 16 else grid * 255 // ((1 << depth) - 1)
                rgb = palette[grid[:, :, 0]] if kind == 3 else np.repeat(eight[:, :, :1], 3, 2) if kind in (0, 4) else eight[:, :, :3]
                alpha = eight[:, :, -1:] if kind in (4, 6) else np.full((h, w, 1), 255)
                clear = b""
                if kind == 3:
                    clear = bytes([0, 128])
                    alpha = np.where(grid == 0, 0, np.where(grid == 1, 128, 255))
                elif kind in (0, 2):
                    clear = struct.pack(f">{images.CHANNELS[kind]}H", *grid[0, 0].tolist())
                    alpha = np.where((grid == grid[0, 0]).all(2, keepdims=True), 0, 255)
                got = images.decode(png_bytes(grid, kind, depth, interlaced, dice, palette, clear), 200)
                assert (got == (rgb.astype(int) * alpha + 200 * (255 - alpha) + 127) // 255).all()


def gif_bytes(picture, palette, least, interlaced=False, clear=None, at=(0, 0), screen=None):
    """A GIF by the plain form of the code: a dictionary of words."""
    h, w = picture.shape
    order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)] if interlaced else range(h)
    pixels = bytes(picture[list(order)].ravel().tolist())
    held, bits, out, width = 0, 0, bytearray(), least + 1

    def put(code):
        nonlocal held, bits
        held, bits = held | code << bits, bits + width
        while bits >= 8:
            out.append(held & 255)
            held, bits = held >> 8, bits - 8

    words = {bytes([i]): i for i in range(1 << least)}
    put(1 << least)
    size, word = (1 << least) + 2, b""
    for p in pixels:
        if word + bytes([p]) in words:
            word += bytes([p])
            continue
        put(words[word])
        if size < 4096:
            words[word + bytes([p])] = size
            size += 1
            if size - 1 == 1 << width and width < 12:
                width += 1
        else:
            put(1 << least)
            words, size, width = {bytes([i]): i for i in range(1 << least)}, (1 << least) + 2, least + 1
        word = bytes([p])
    put(words[word])
    put((1 << least) + 1)
    out.append(held & 255)
    n = len(palette)
    sw, sh = screen or (w, h)
    head = b"GIF89a" + struct.pack("<HHBBB", sw, sh, 0x80 | (n.bit_length() - 2), 0, 0) + palette.tobytes()
    head += b"\x21\xfe\x03abc\x00" + (b"\x21\xf9\x04" + bytes([1, 0, 0, clear]) + b"\0" if clear is not None else b"")
    head += b"\x2c" + struct.pack("<HHHHB", *at, w, h, 0x40 if interlaced else 0) + bytes([least])
    return head + b"".join(bytes([len(out[i : i + 255])]) + bytes(out[i : i + 255]) for i in range(0, len(out), 255)) + b"\0;"


def test_gif():
    rng = np.random.default_rng(8)
    for least, w, h in ((2, 7, 5), (4, 33, 40), (8, 150, 90), (8, 1, 1)):
        palette = rng.integers(0, 256, (1 << least, 3), np.uint8)
        for picture in (rng.integers(0, 1 << least, (h, w), np.uint8), np.full((h, w), 1, np.uint8)):
            for interlaced in (False, True):
                assert (images.decode(gif_bytes(picture, palette, least, interlaced)) == palette[picture]).all()
            got = images.decode(gif_bytes(picture, palette, least, clear=1, at=(2, 3), screen=(w + 4, h + 5)), 9)
            want = np.full((h + 5, w + 4, 3), 9, np.uint8)
            want[3 : 3 + h, 2 : 2 + w] = np.where((picture == 1)[:, :, None], 9, palette[picture])
            assert (got == want).all()


def test_bmp():
    rng = np.random.default_rng(9)
    for bits in (1, 4, 8, 16, 24, 32):
        for down in (False, True):
            w, h = 13, 6
            palette = rng.integers(0, 256, (1 << min(bits, 8), 4), np.uint8) if bits <= 8 else np.empty((0, 4), np.uint8)
            grid = rng.integers(0, 1 << min(bits, 24), (h, w))
            lines = b""
            for row in grid if down else grid[::-1]:
                line = np.packbits(((row[:, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8)).tobytes() if bits <= 8 else b"".join(int(v).to_bytes(bits // 8, "little") for v in row)
                lines += line.ljust((w * bits + 31) // 32 * 4, b"\0")
            head = struct.pack("<IiiHHIIIIII", 40, w, -h if down else h, 1, bits, 0, 0, 0, 0, 0, 0)
            raw = b"BM" + struct.pack("<IHHI", 0, 0, 0, 14 + 40 + palette.size) + head + palette.tobytes() + lines
            if bits <= 8:
                want = palette[grid][:, :, 2::-1]
            elif bits == 16:
                want = np.stack([((grid >> s & 31) * 255 + 15) // 31 for s in (10, 5, 0)], 2)
            else:
                want = np.stack([grid >> s & 255 for s in (16, 8, 0)], 2)
            assert (images.decode(raw) == want).all()


def test_decode_images(spark):
    good = png_bytes(np.arange(12).reshape(3, 4, 1), 0, 8, False, random.Random(1))
    damaged = bytearray(good)
    damaged[45] ^= 1
    huge = b"\x89PNG\r\n\x1a\n" + (lambda b: struct.pack(">I", 13) + b + struct.pack(">I", zlib.crc32(b)))(b"IHDR" + struct.pack(">IIBBBBB", 1 << 31, 1 << 31, 8, 0, 0, 0, 0))
    files = [good, bytes(damaged), good[:50], None, b"", b"\xff\xd8\xff\xe0JFIF", huge, b"GIF89a\1\0\1\0", b"BM" + bytes(60)]
    df = spark.createDataFrame([(i, f, "old") for i, f in enumerate(files)], "id int, content binary, error string")
    got = {r.id: r for r in images.decode_images(df).collect()}
    assert bytes(got[0].data) == bytes(v for v in range(12) for _ in range(3)) and (got[0].width, got[0].height, got[0].error) == (4, 3, None)
    assert len(got) == len(files) and all(got[i].data is None and got[i].error for i in range(1, len(files)))
    assert images.decode_images(df.limit(0)).collect() == []


def test_first_fault(spark):
    r = random.Random(6)
    rows, want = [], {}
    for book in range(400):
        toc = []
        for idx in range(1, r.randrange(1, 9)):
            a = r.randrange(1, 25)
            toc.append((idx, f"c%{idx}", a, a + r.choice([-3, -1, 0, 0, 1, 2, 6])))
        rows += [(book, *c) for c in toc]
        for i, (n, title, a, b) in enumerate(toc):
            other = next((c for c in toc[i + 1 :] if a <= c[3] and b >= c[2]), None)
            if a > b or other:
                want[book] = (n, None if a > b else other[0], f'Chapter "{title}" has an invalid page range (start {a} > end {b}).' if a > b else f'Chapter overlap detected:\n"{title}" (Pages {a}-{b})\noverlaps with\n"{other[1]}" (Pages {other[2]}-{other[3]}).\nPlease fix overlapping pages before saving.')
                break
    rows += [(1000, 1, "n", None, 4), (1000, 2, "n", 2, 3), (1000, None, "n", 2, 3)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "book int, idx int, title string, start int, end int")
    assert {x.book: (x.idx, x.other, x.message) for x in books.first_fault(df).collect()} == want and 100 < len(want) < 400
    # a book of as many chapters as the format counts, of which the last two overlap
    many = spark.range(1, 65_536).select(F.lit("b").alias("book"), F.col("id").cast("int").alias("idx"), F.lit("t").alias("title"), F.col("id").cast("int").alias("start"), F.when(F.col("id") == 65_534, 65_535).otherwise(F.col("id")).cast("int").alias("end"))
    assert [(x.idx, x.other) for x in books.first_fault(many).collect()] == [(65_534, 65_535)]


def test_outline(spark):
    kind = "book string, id int, parent int, place int, title string, name string, ref int"
    items = [("a", 1, None, 2, "two", None, 20), ("a", 2, None, 1, "one", "n", None), ("a", 3, 2, 1, "none", None, None), ("a", 4, 3, 1, "deep", None, 30), ("a", 5, 2, 2, "lost", "x", 10), ("a", 6, 2, 3, "no page", None, 99), ("a", 7, 8, 1, "circle", None, 10), ("a", 8, 7, 1, "circle", None, 10)]
    chain = [("c", i, i - 1 if i else None, 1, f"t{i}", None, 10) for i in range(40)]
    names = spark.createDataFrame([("a", "n", 10)], "book string, name string, ref int")
    refs = spark.createDataFrame([("a", 10, 1), ("a", 20, 9), ("a", 30, 4), ("c", 10, 3)], "book string, ref int, page_no int")
    totals = spark.createDataFrame([("a", 12), ("c", 5)], "book string, page_count int")
    got = books.outline_toc(spark.createDataFrame(items + chain, kind), names, refs, totals).collect()
    assert sorted(tuple(x)[1:] for x in got if x.book == "a") == [(1, "one", 1, 3), (2, "deep", 4, 8), (3, "two", 9, 12)]
    assert [x.title for x in sorted((x for x in got if x.book == "c"), key=lambda x: x.idx)] == [f"t{i}" for i in range(40)]
    assert books.outline_toc(spark.createDataFrame([], kind), names, refs, totals).collect() == []


def test_numbered(spark):
    names = ["b.png", "B.png", "a.png", "é.png", "e.png", "f.png", "A.png", "10.png", "2.png", "a.png"]
    df = spark.createDataFrame([("k", n, i) for i, n in enumerate(names)] + [("k", None, 0)], "book string, entry_path string, offset int")
    rows = archive.numbered(df).collect()
    ordered = [r.entry_path for r in sorted((r for r in rows if r.page_no), key=lambda r: r.page_no)]
    assert ordered == ["10.png", "2.png", "a.png", "a.png", "A.png", "b.png", "B.png", "e.png", "é.png", "f.png"]
    assert [r.page_no for r in rows if r.entry_path is None] == [None]


def test_move_pages(spark):
    df = spark.createDataFrame([(b, i, f"{b}{i}") for b in "xyz" for i in range(1, 6)], "book string, page_no int, blob string")
    moves = spark.createDataFrame([("x", 2, 4), ("y", 5, 1), ("z", 3, 9)], "book string, source int, target int")
    got = {(r.book, r.page_no): r.blob for r in books.move_pages(df, moves).collect()}
    order = {b: "".join(got[b, i][1] for i in range(1, 6)) for b in "xyz"}
    assert order == {"x": "13425", "y": "51234", "z": "12345"}


def test_cubic():
    """Each sample as a sum over the kernel, in two dimensions at once."""

    def kernel(t):
        t = abs(t)
        return 1.5 * t**3 - 2.5 * t**2 + 1 if t < 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0

    def weights(n, m, i):
        wide, center, out = max(1, n / m), (i + 0.5) * n / m - 0.5, {}
        for j in range(-3 * n - 9, 4 * n + 9):
            out[min(max(j, 0), n - 1)] = out.get(min(max(j, 0), n - 1), 0) + kernel((j - center) / wide)
        total = sum(out.values())
        return {j: v / total for j, v in out.items() if v}

    rng = np.random.default_rng(2)
    for h, w, th, tw in ((7, 5, 11, 9), (12, 10, 5, 3), (6, 6, 6, 13), (1, 3, 4, 2)):
        a = rng.integers(0, 256, (h, w, 1), np.uint8)
        got = raster.resize_cubic(a, tw, th)[:, :, 0]
        for y in range(th):
            for x in range(tw):
                v = sum(p * q * float(a[i, j, 0]) for i, p in weights(h, th, y).items() for j, q in weights(w, tw, x).items())
                assert abs(min(max(v, 0), 255) - int(got[y, x])) <= 0.5 + 1e-6
    gray = np.repeat(np.arange(256, dtype=np.uint8)[None, :, None], 3, axis=2)
    assert raster.linear_gray(gray)[0].tolist() == list(range(256))


def test_cubic_pages(spark):
    """The command-line variant keeps a gray page of the target's size, inverts last, and ignores gamma at one bit."""
    a = np.random.default_rng(1).integers(0, 256, (10, 8), np.uint8)
    df = spark.createDataFrame([(1, 8, 10, a.tobytes()), (2, 3, 3, b"x")], "id int, width int, height int, data binary")
    options = {"size": (8, 10), "split": "nosplit", "single": "fill", "dithering": "none", "cubic": True}
    blob = lambda g, two: dither.page_blob(dither.pack(dither.dither(g[None], "none", two), two)[0], 8, 10, two)
    for two in (False, True):
        for gamma, invert in ((1.0, True), (2.0, False)):
            rows = raster.convert(df, ["id"], two_bit=two, gamma=gamma, invert=invert, **options).collect()
            want = raster.powered(raster.powered(a, gamma), 1 / gamma) if two and gamma != 1 else a
            assert [bytes(r.page_blob) for r in rows if r.id == 1] == [blob(255 - want if invert else want, two)] and sum(r.error is not None for r in rows) == 1


def test_fixed_head():
    pages = [dither.page_blob(bytes(8), 8, 8)] * 3
    raw = container.fixed_head([(len(p), p[4:8]) for p in pages], True, ("T" * 200, "A")) + b"".join(pages)
    info, toc, got = container.parse(raw)
    assert (info["title"], info["author"], info["cover"], info["create_time"], toc, got) == ("T" * 127, "A", 0, 0, [], pages) and raw[:4] == b"XTCH" and raw[48:56] == bytes(8)
