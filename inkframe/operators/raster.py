"""Rasters through a whole conversion: crop, cut, turn, resize into the target, tone, dither, pack.

A raster is a row with width, height and its bytes, row by row: gray (one byte a pixel) or RGB (three). The page plan
says which rectangles of an image become pages; each task renders the pages of its rows, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.convert import page_plan
from .dither import dither, pack, page_blob

PAGE_FIELDS = [T.StructField("out_idx", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("page_blob", T.BinaryType()), T.StructField("error", T.StringType())]


def raster_of(raw: bytes, width: int, height: int) -> np.ndarray:
    """(height, width, 3) of gray or RGB bytes; ValueError if the bytes don't fit the size."""
    n = (width or 0) * (height or 0)
    if n <= 0 or raw is None or len(raw) not in (n, 3 * n):
        raise ValueError(f"{len(raw or b'')} bytes are no raster of {width} x {height}")
    a = np.frombuffer(raw, np.uint8).reshape(height, width, -1)
    return np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a


def luma(rgb: np.ndarray) -> np.ndarray:
    """Gray by fixed-point weights."""
    return (rgb.astype(np.int64) @ np.array([77, 150, 29])) >> 8


def contrast_points(rgb: np.ndarray, level: float) -> tuple[int, int]:
    """The grays at which the counts from below and from above pass their cut-offs; else 0 and 255."""
    r, g, b = np.moveaxis(rgb.astype(np.float64), 2, 0)
    gray = np.floor(r * 0.299 + g * 0.587 + b * 0.114 + 0.5).astype(np.int64)
    counts = np.bincount(gray.ravel(), minlength=256)
    below, above = np.cumsum(counts), np.cumsum(counts[::-1])[::-1]
    dark, light = np.flatnonzero(below >= gray.size * (3 * level) / 100), np.flatnonzero(above >= gray.size * (3 + 9 * level) / 100)
    return (int(dark[0]) if len(dark) else 0), (int(light[-1]) if len(light) else 255)


def tone(rgb: np.ndarray, contrast: float = 0, gamma: float = 1.0, invert: bool = False) -> np.ndarray:
    """Grays after inversion, stretch, gray and gamma. The stretch's points come from the raster before inversion."""
    v = rgb.astype(np.int64)
    black, white = contrast_points(rgb, contrast) if contrast > 0 else (0, 255)
    if invert:
        v = 255 - v
    if contrast > 0 and white > black:
        v = np.clip(np.trunc((v - black) * 255 / (white - black)), 0, 255).astype(np.int64)
    gray = luma(v)
    if gamma != 1.0:
        gray = np.floor(np.power(np.arange(256) / 255, gamma) * 255 + 0.5).astype(np.int64)[gray]
    return gray.astype(np.uint8)


def strip_tone(rgb: np.ndarray, contrast: float = 0, gamma: float = 1.0, invert: bool = False) -> np.ndarray:
    """Grays of a strip's page: stretch of each channel, gamma, inversion, then gray. Every step rounds, halves to even but
    for gamma."""
    v = rgb.astype(np.int64)
    if contrast > 0:
        black, white = contrast_points(rgb, contrast)
        if white > black:
            v = np.rint(np.clip((v - black) / (white - black) * 255, 0, 255)).astype(np.int64)
    if gamma != 1.0:
        v = np.floor(np.power(np.arange(256) / 255, gamma) * 255 + 0.5).astype(np.int64)[v]
    if invert:
        v = 255 - v
    r, g, b = np.moveaxis(v.astype(np.float64), 2, 0)
    return np.rint(0.299 * r + 0.587 * g + 0.114 * b).astype(np.uint8)


def tone_by_table(rgb: np.ndarray, contrast: float = 0, gamma: float = 1.0, invert: bool = False) -> np.ndarray:
    """The compiled variant: gray first, then a table in single precision; contrast is a slope about the middle."""
    f = np.float32
    v = np.arange(256, dtype=f)
    if contrast > 0:
        v = np.clip(f(0.5) + (v / f(255) - f(0.5)) * (f(1) + f(contrast) / f(4)), f(0), f(1)) * f(255)
    if gamma != 1.0:
        v = np.power((v / f(255)).astype(np.float64), float(f(gamma))).astype(f) * f(255)
    if invert:
        v = f(255) - v
    return np.clip(v, 0, 255).astype(np.uint8)[luma(rgb)]


def resize_box(a: np.ndarray, w: int, h: int) -> np.ndarray:
    """Each new pixel is the truncated mean of the window of pixels that it touches; windows overlap where sizes don't divide."""

    def windows(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        r, i = np.float32(n) / np.float32(m), np.arange(m + 1).astype(np.float32)
        return np.floor(i[:-1] * r).astype(np.int64), np.minimum(np.ceil(i[1:] * r).astype(np.int64), n)

    (x0, x1), (y0, y1) = windows(a.shape[1], w), windows(a.shape[0], h)
    total = np.zeros((a.shape[0] + 1, a.shape[1] + 1, a.shape[2]), np.int64)
    total[1:, 1:] = a.cumsum(0, dtype=np.int64).cumsum(1)
    rows = total[y1] - total[y0]
    sums = rows[:, x1] - rows[:, x0]
    return (sums // ((y1 - y0)[:, None] * (x1 - x0)[None, :])[:, :, None]).astype(np.uint8)


@lru_cache(maxsize=16)
def cubic_weights(n: int, m: int) -> np.ndarray:
    """(m, n): how m new samples are made of n old ones by a cubic kernel (Catmull-Rom), widened where there are fewer new
    ones; beyond the ends, the end's sample counts."""
    wide = max(1.0, n / m)
    center = (np.arange(m) + 0.5) * n / m - 0.5
    taps = np.floor(center)[:, None] + np.arange(-int(np.ceil(2 * wide)), int(np.ceil(2 * wide)) + 2)
    t = np.abs(taps - center[:, None]) / wide
    k = np.where(t < 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0.0))
    out = np.zeros((m, n))
    np.add.at(out, (np.repeat(np.arange(m), taps.shape[1]), np.clip(taps, 0, n - 1).astype(int).ravel()), (k / k.sum(1, keepdims=True)).ravel())
    return out


def resize_cubic(a: np.ndarray, w: int, h: int) -> np.ndarray:
    """Resized by one kernel for rows and one for columns, rounded once."""
    made = np.einsum("yi,ijc->yjc", cubic_weights(a.shape[0], h), a.astype(np.float64), optimize=True)
    made = np.einsum("xj,yjc->yxc", cubic_weights(a.shape[1], w), made, optimize=True)
    return np.clip(np.floor(made + 0.5), 0, 255).astype(np.uint8)


def linear_gray(rgb: np.ndarray) -> np.ndarray:
    """Gray by weights 0.2, 0.7 and 0.1 of linear light."""
    v = np.arange(256) / 255
    light = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)[rgb] @ np.array([0.2, 0.7, 0.1])
    back = np.where(light <= 0.0031308, light * 12.92, 1.055 * np.power(light, 1 / 2.4) - 0.055)
    return np.clip(np.floor(back * 255 + 0.5), 0, 255).astype(np.uint8)


def powered(gray: np.ndarray, exponent: float) -> np.ndarray:
    return np.floor(np.power(np.arange(256) / 255, exponent) * 255 + 0.5).astype(np.uint8)[gray]


def place(a: np.ndarray, fit: tuple[int, int, int, int], w: int, h: int, pad: int, resize=resize_box) -> np.ndarray:
    """a resized to fit (x, y, width, height) on a w x h page of the pad gray; what lies outside is cut off."""
    x, y, fw, fh = fit
    page = np.full((h, w, a.shape[2]), pad, np.uint8)
    if fw <= 0 or fh <= 0:
        return page
    scaled = a if a.shape[:2] == (fh, fw) else resize(a, fw, fh)
    left, top, right, bottom = max(0, x), max(0, y), min(w, x + fw), min(h, y + fh)
    page[top:bottom, left:right] = scaled[top - y : bottom - y, left - x : right - x]
    return page


def render(raster: np.ndarray, pages: list[dict], size: tuple[int, int], contrast: float, gamma: float, invert: bool, dithering: str, two_bit: bool, pad_black: bool, crop: bool = False, cubic: bool = False) -> list[bytes]:
    """The encoded pages of one image by its plan. All of them are dithered in lockstep.

    Gamma counts at two bits only. With crop, what a single image does not cover stays black before the tone filters,
    whatever the padding. cubic is the command-line variant: no contrast, gray first, the resize by cubic kernels between
    a gamma that darkens and one that brightens, then inversion.
    """
    w, h = size
    gamma = gamma if two_bit else 1.0
    grays = []
    for p in pages:
        part = raster[p["cy"] + p["y"] : p["cy"] + p["y"] + p["sh"], p["cx"] + p["x"] : p["cx"] + p["x"] + p["sw"]]
        part = np.rot90(part, -1) if p["turn"] == 90 else part
        if not part.size:
            part = np.full((1, 1, 3), 0 if pad_black else 255, np.uint8)
        pad = 0 if pad_black or (crop and p["kind"] == "single") else 255
        fit = (p["fx"], p["fy"], p["fw"], p["fh"])
        if cubic:
            dark = linear_gray(part) if gamma == 1.0 else powered(linear_gray(part), gamma)
            page = place(dark[:, :, None], fit, w, h, 0 if pad_black else 255, resize_cubic)[:, :, 0]
            page = page if gamma == 1.0 else powered(page, 1 / gamma)
            grays.append(255 - page if invert else page)
        else:
            grays.append(tone(place(part, fit, w, h, pad), contrast, gamma, invert))
    return [page_blob(x, w, h, two_bit) for x in pack(dither(np.stack(grays), dithering, two_bit), two_bit)] if grays else []


def convert(images: DataFrame, id_cols: list[str], *, size: tuple[int, int], contrast: float = 0, gamma: float = 1.0, invert: bool = False, dithering: str = "stucki", two_bit: bool = False, pad_black: bool = False, data_col: str = "data", cubic: bool = False, **plan) -> DataFrame:
    """(ids, out_idx, kind, page_blob, error) of images with width, height and bytes; a bad raster gives one row with error.

    plan holds the options of page_plan; cubic takes the filters of the command-line variant. Null bytes and sizes are bad rasters; repeated rows give equal pages; an empty
    table gives no rows.
    """
    base = images.select(*id_cols, F.col("width").cast("int").alias("w"), F.col("height").cast("int").alias("h"), F.col(data_col).alias("data"))
    rows = page_plan(base, size=size, as_array=True, **plan).select(*id_cols, "w", "h", "data", "plan")
    schema = T.StructType([base.schema[c] for c in id_cols] + PAGE_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(b.schema.get_field_index(c))[i].as_py() for c in ("w", "h", "data", "plan")}
                try:
                    pages = row["plan"] or []
                    blobs = render(raster_of(row["data"], row["w"], row["h"]), pages, size, contrast, gamma, invert, dithering, two_bit, pad_black, plan.get("single") == "crop", cubic)
                    made, error = [(k, p["kind"], x) for k, (p, x) in enumerate(zip(pages, blobs, strict=True))], None
                except ValueError as e:
                    made, error = [(None, None, None)], str(e)
                n = len(made)
                ids = [pa.array([b.column(b.schema.get_field_index(c))[i].as_py()] * n, b.schema.field(c).type) for c in id_cols]
                cols = [pa.array(list(c), t) for c, t in zip(zip(*made, strict=True), (pa.int32(), pa.string(), pa.binary()), strict=True)] if n else [pa.array([], t) for t in (pa.int32(), pa.string(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*ids, *cols, pa.array([error] * n, pa.string())], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


class Strip:
    """A book's pages scaled to one width and joined, of which full slices leave the top.

    A solid slice is passed whole, another up to the overlap (percent; 0 counts as 50). What is left is height x width
    grays, so a strip can be put away as bytes and taken up again.
    """

    def __init__(self, size: tuple[int, int], overlap: int, contrast: float, gamma: float, invert: bool, dithering: str, two_bit: bool, pad_black: bool):
        self.size, self.overlap, self.pad = size, overlap or 50, 0 if pad_black else 255
        self.tone, self.dithering, self.two_bit = (contrast, gamma if two_bit else 1.0, invert), dithering, two_bit
        self.start()

    def start(self, rows: bytes = b"", slices: int = 0) -> None:
        self.rows, self.slices = np.frombuffer(rows, np.uint8).reshape(-1, self.size[0]), slices

    def append(self, data: bytes, width: int, height: int) -> list[tuple[int, bool, bytes]]:
        """(slice_no, solid, page_blob) of the slices that are full with this page; none for one that is no raster."""
        w, h = self.size
        try:
            raster = raster_of(data, width, height)
        except ValueError:
            return []
        high = int(height * (w / width))
        if high < 1:
            return []
        self.rows = np.concatenate([self.rows, strip_tone(resize_box(raster, w, high), *self.tone)])
        out = []
        while len(self.rows) >= h:
            top = self.rows[:h]
            solid = bool(top.std() < 5)
            out.append(self.encoded(top, solid))
            self.rows = self.rows[h if solid else h - h * self.overlap // 100 :]
        return out

    def finish(self) -> list[tuple[int, bool, bytes]]:
        """The last slice, padded below; none if nothing is left."""
        if not len(self.rows):
            return []
        page = np.full((self.size[1], self.size[0]), self.pad, np.uint8)
        page[: len(self.rows)] = self.rows
        self.rows = self.rows[:0]
        return [self.encoded(page, False)]

    def encoded(self, page: np.ndarray, solid: bool) -> tuple[int, bool, bytes]:
        self.slices += 1
        return self.slices - 1, solid, page_blob(pack(dither(page[None], self.dithering, self.two_bit), self.two_bit)[0], *self.size, self.two_bit)


def stitch(pages: DataFrame, size: tuple[int, int], overlap: int = 50, contrast: float = 0, gamma: float = 1.0, invert: bool = False, dithering: str = "none", two_bit: bool = False, pad_black: bool = False, book: str = "book") -> DataFrame:
    """(book, slice_no, solid, page_blob) of books whose pages are one long strip. pages has page_no, width, height, data.

    A book's pages arrive in order in one task, which holds one strip of less than a slice and a page, as each slice
    depends on what is left of the one before; what is left at a book's end is padded below. Gamma counts at two bits
    only. Pages that are no rasters are passed over; an empty table gives no rows.
    """
    kind = pages.schema[book].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, strip = None, Strip(size, overlap, contrast, gamma, invert, dithering, two_bit, pad_black)
        for b in batches:
            out = []
            for key, pw, ph, data in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if key != now:
                    out += [(now, *x) for x in strip.finish()]
                    now = key
                    strip.start()
                out += [(now, *x) for x in strip.append(data, pw, ph)]
            yield from made(out)
        yield from made([(now, *x) for x in strip.finish()])

    def made(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], book_type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.binary())], names=[book, "slice_no", "solid", "page_blob"])

    from pyspark.sql.pandas.types import to_arrow_type

    book_type = to_arrow_type(pages.schema[book].dataType)
    rows = pages.repartition(book).sortWithinPartitions(book, "page_no").select(book, F.col("width").cast("int"), F.col("height").cast("int"), "data")
    return rows.mapInArrow(run, f"{book} {kind}, slice_no int, solid boolean, page_blob binary")


def _grays(images: DataFrame, id_cols: list[str], work) -> DataFrame:
    """(ids, gray) of images with width, height and data by work(raster); null for bad rasters."""
    base = images.select(*id_cols, F.col("width").cast("int"), F.col("height").cast("int"), "data")
    schema = T.StructType([base.schema[c] for c in id_cols] + [T.StructField("gray", T.BinaryType())])

    def one(w: int, h: int, data: bytes) -> bytes | None:
        try:
            return work(raster_of(data, w, h)).tobytes()
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [one(*x) for x in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("width", "height", "data")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in id_cols), pa.array(made, pa.binary())], names=[f.name for f in schema.fields])

    return base.mapInArrow(run, schema)


def toned(images: DataFrame, id_cols: list[str], *, contrast: float = 0, gamma: float = 1.0, invert: bool = False, table: bool = False) -> DataFrame:
    """(ids, gray) after the tone filters, by the compiled variant if table is set."""
    return _grays(images, id_cols, lambda a: (tone_by_table if table else tone)(a, contrast, gamma, invert))


def resized(images: DataFrame, id_cols: list[str], size: tuple[int, int]) -> DataFrame:
    """(ids, gray) box-resized to a width and height."""
    return _grays(images, id_cols, lambda a: luma(resize_box(a, *size)).astype(np.uint8))
