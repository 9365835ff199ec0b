"""Dithering and packing of many equal-size pages at once: numpy steps over skewed rows, all pages in lockstep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pixels import BAYER, curve

# Error shares as (dx, dy, weight), with their divisor.
KERNELS = {
    "floyd": (16, [(1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)]),
    "atkinson": (8, [(1, 0, 1), (2, 0, 1), (-1, 1, 1), (0, 1, 1), (1, 1, 1), (0, 2, 1)]),
    "stucki": (42, [(1, 0, 8), (2, 0, 4), (-2, 1, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 4), (2, 1, 2), (-2, 2, 1), (-1, 2, 2), (0, 2, 4), (1, 2, 2), (2, 2, 1)]),
    "zhoufang": (103, [(1, 0, 16), (2, 0, 9), (-2, 1, 5), (-1, 1, 11), (0, 1, 16), (1, 1, 11), (2, 1, 5), (-2, 2, 3), (-1, 2, 5), (0, 2, 9), (1, 2, 5), (2, 2, 3)]),
    "sierra-lite": (4, [(1, 0, 2), (-1, 1, 1), (0, 1, 1)]),
}
ALGORITHMS = ["none", *KERNELS, "ostromoukhov", "ordered", "stochastic"]


def levels(v: np.ndarray, two_bit: bool) -> np.ndarray:
    return np.select([v < 42, v < 127, v < 212], [0.0, 85.0, 170.0], 255.0) if two_bit else np.where(v < 128, 0.0, 255.0)


def dither(pages: np.ndarray, algorithm: str, two_bit: bool = False) -> np.ndarray:
    """Pages (n, height, width) of grays to palette grays. Unknown names run as floyd."""
    n, h, w = pages.shape
    if algorithm == "none":
        return levels(pages.astype(np.float64), two_bit).astype(np.uint8)
    if algorithm == "ordered":
        limit = np.resize(np.array(BAYER, np.int64).reshape(4, 4) * 16, (4, 4))
        tiled = np.tile(limit, (-(-h // 4), -(-w // 4)))[:h, :w]
        return np.where(pages > tiled, 255, 0).astype(np.uint8)
    if algorithm == "stochastic":
        # a place's error is what is left of the sum of all grays so far, modulo the step between palette grays
        step, low = (85, 43) if two_bit else (255, 127)
        x, y = curve(w, h).T
        out = np.empty_like(pages, dtype=np.uint8)
        for page, made in zip(pages, out, strict=True):
            grays = page[y, x].astype(np.int64)
            error = (np.cumsum(grays) + low) % step - low
            made[y, x] = grays + np.concatenate([[0], error[:-1]]) - error
        return out
    plane = pages.astype(np.float32)
    divisor, shares = KERNELS.get(algorithm, KERNELS["floyd"])
    if algorithm == "ostromoukhov":
        shares = [(1, 0, 0), (-1, 1, 0), (0, 1, 0)]
    # Rows run in lockstep, each so far behind the one above that every place still gets its shares in the order of rows
    # and columns, and no two places of a step share a target.
    lag = 5 if max(abs(dx) for dx, _, _ in shares) == 2 else 3
    for step in range(w + lag * (h - 1)):
        y = np.arange(max(0, -(-(step - w + 1) // lag)), min(h, step // lag + 1))
        x = step - lag * y
        old = plane[:, y, x].astype(np.float64)
        new = levels(old, two_bit)
        plane[:, y, x] = new
        err = old - new
        if algorithm == "ostromoukhov":
            v = np.clip(old, 0, 255)
            low = v <= 128
            t = np.where(low, v / 128.0, (v - 128) / 127.0)
            ends = [(0.7, 0.3), (0.2, 0.4), (0.1, 0.3)]
            parts = [err * np.where(low, a * (1 - t) + b * t, b * (1 - t) + a * t) for a, b in ends]
        else:
            e = err / divisor
            parts = [e * weight for _, _, weight in shares]
        for (dx, dy, _), part in zip(shares, parts, strict=True):
            to_x, to_y = x + dx, y + dy
            ok = (to_x >= 0) & (to_x < w) & (to_y < h)
            if not ok.all():
                to_x, to_y, part = to_x[ok], to_y[ok], part[:, ok]
            plane[:, to_y, to_x] = (plane[:, to_y, to_x].astype(np.float64) + part).astype(np.float32)
    return np.clip(plane, 0, 255).astype(np.uint8)


def pack(pages: np.ndarray, two_bit: bool = False) -> list[bytes]:
    """Payload bits: rows of 8 pixels, or two planes of columns from right to left."""
    if not two_bit:
        return [np.packbits(p >= 128, axis=1).tobytes() for p in pages]
    code = np.select([pages >= 212, pages >= 127, pages >= 42], [0, 1, 2], 3)
    turned = code[:, :, ::-1].transpose(0, 2, 1)
    return [np.packbits(p & 1, axis=1).tobytes() + np.packbits(p >> 1, axis=1).tobytes() for p in turned]


def page_blob(payload: bytes, w: int, h: int, two_bit: bool = False) -> bytes:
    half = len(payload) // 2
    digest = bytes(a ^ b for a, b in zip(payload[:8], payload[half : half + 8], strict=False)) if two_bit else payload[:8]
    return (b"XTH\0" if two_bit else b"XTG\0") + w.to_bytes(2, "little") + h.to_bytes(2, "little") + b"\0\0" + len(payload).to_bytes(4, "little") + digest[:8].ljust(8, b"\0") + payload


def unpack(blob: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, grays) of an encoded page; ValueError for other bytes."""
    if blob[:4] not in (b"XTG\0", b"XTH\0"):
        raise ValueError("not an encoded page")
    w, h = int.from_bytes(blob[4:6], "little"), int.from_bytes(blob[6:8], "little")
    body = np.frombuffer(blob[22:], np.uint8)
    if blob[:4] == b"XTG\0":
        bits = np.unpackbits(body.reshape(h, -1), axis=1)[:, :w]
        return w, h, (bits * 255).astype(np.uint8)
    planes = np.unpackbits(body.reshape(2, w, -1), axis=2)[:, :, :h]
    code = planes[1] * 2 + planes[0]
    return w, h, np.array([255, 170, 85, 0], np.uint8)[code].T[:, ::-1]


def encode_pages(rasters: DataFrame, algorithm: str = "stucki", two_bit: bool = False, width: int = 8, id_col: str = "vec_id", gray_col: str = "gray", width_col: str | None = None) -> DataFrame:
    """Adds page_blob to rasters whose gray column holds rows of `width` bytes, or of width_col's; no shuffle.

    Null, empty and ragged rasters get a null blob; an empty table gives no rows; a column page_blob is replaced."""
    kept = rasters.drop("page_blob")
    schema = T.StructType(kept.schema.fields + [T.StructField("page_blob", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs: list[bytes | None] = [None] * b.num_rows
            widths = b.column(b.schema.get_field_index(width_col)).to_pylist() if width_col else [width] * b.num_rows
            by_size: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
            for i, (g, w) in enumerate(zip(b.column(b.schema.get_field_index(gray_col)).to_pylist(), widths, strict=True)):
                if g and w and w > 0 and len(g) % w == 0:
                    by_size.setdefault((len(g) // w, w), []).append((i, g))
            for (h, w), some in by_size.items():
                pages = np.frombuffer(b"".join(g for _, g in some), np.uint8).reshape(-1, h, w)
                for (i, _), payload in zip(some, pack(dither(pages, algorithm, two_bit), two_bit), strict=True):
                    blobs[i] = page_blob(payload, w, h, two_bit)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(blobs, pa.binary())], names=[f.name for f in schema.fields])

    return kept.mapInArrow(run, schema)


def decode_pages(pages: DataFrame) -> DataFrame:
    """Adds width, height, gray (rows of bytes) and error to pages with a page_blob; no shuffle.

    Blobs that don't decode, null ones included, say so in error; columns of these names are replaced."""
    made = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("gray", T.BinaryType()), T.StructField("error", T.StringType())]
    kept = pages.drop(*[f.name for f in made])
    schema = T.StructType(kept.schema.fields + made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_decoded(x) for x in b.column(b.schema.get_field_index("page_blob")).to_pylist()]
            new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)] if rows else []
            if new:
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[f.name for f in schema.fields])

    return kept.mapInArrow(run, schema)


def _decoded(blob: bytes | None) -> tuple[int | None, int | None, bytes | None, str | None]:
    try:
        w, h, gray = unpack(blob or b"")
        return w, h, np.ascontiguousarray(gray).tobytes(), None
    except ValueError:
        return None, None, None, "not an encoded page"


def rasters_of(embeddings: DataFrame) -> DataFrame:
    """vec_id and its 8 x 8 grays as bytes."""
    from ..functions.pixels import gray_of

    digits = F.transform("embedding", lambda e: F.lpad(F.hex(gray_of(e)), 2, "0"))
    return embeddings.select("vec_id", F.unhex(F.array_join(digits, "")).alias("gray"))
