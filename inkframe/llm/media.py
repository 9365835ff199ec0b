"""Media columns: a text's bytes stored as a grey PNG, read back, and hashed by its low cosine frequencies.

Images are 64 samples wide and 8 bits deep. Rows are filtered (none, left or above, whichever leaves the least sum),
deflated into one data chunk, and read back by checking every chunk's checksum, inflating and undoing the filters in
numpy. All is narrow: no row meets another. Null and empty texts store one row of zeros; equal texts give equal values;
an empty table gives no rows; columns named like an output are replaced.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
OUTPUTS = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())]


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def write_png(samples: np.ndarray) -> bytes:
    """A PNG of a matrix of unsigned bytes."""
    h, w = samples.shape
    left = np.zeros_like(samples)
    left[:, 1:] = samples[:, :-1]
    above = np.zeros_like(samples)
    above[1:] = samples[:-1]
    tried = np.stack([samples, samples - left, samples - above])
    cost = np.minimum(tried, -tried.astype(np.int16) & 255).astype(np.uint32).sum(2)
    cost[0] = np.minimum(samples, 256 - samples.astype(np.int16)).sum(1)
    kind = cost.argmin(0)
    rows = np.empty((h, w + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = tried[kind, np.arange(h)]
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, rows: np.ndarray, step: int = 1) -> np.ndarray:
    """Undoes the five row filters. Runs of rows with the same simple filter are done at once."""
    h, w = rows.shape
    out = rows.copy()
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, h], strict=True):
        kind = kinds[lo] if h else 0
        if kind == 1:
            for k in range(step):
                out[lo:hi, k::step] = np.cumsum(rows[lo:hi, k::step], axis=1, dtype=np.uint8)
        elif kind == 2:
            first = out[lo - 1 : lo] if lo else np.zeros((1, w), np.uint8)
            out[lo:hi] = np.cumsum(np.concatenate([first, rows[lo:hi]]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for y in range(lo, hi):
                up = out[y - 1].astype(int) if y else np.zeros(w, int)
                cur = rows[y].astype(int)
                for x in range(w):
                    a = cur[x - step] if x >= step else 0
                    b, c = up[x], up[x - step] if x >= step else 0
                    if kind == 3:
                        add = (a + b) // 2
                    else:
                        p = a + b - c
                        pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                        add = a if pa <= pb and pa <= pc else b if pb <= pc else c
                    cur[x] = (cur[x] + add) & 255
                out[y] = cur
        elif kind > 4:
            raise ValueError(f"row filter {kind}")
    return out


def read_png(data: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG without interlace. Wrong checksums, sizes or kinds raise ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, parts, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data) or struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"length or checksum of chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole grey 8-bit PNG")
    w, h = head[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if len(raw) != h * (w + 1):
        raise ValueError("wrong number of samples")
    rows = raw.reshape(h, w + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def _cosines(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(low)[:, None] / (2 * n))


_TABLE = _cosines(32, 8)


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest cosine frequencies of the 32 x 32 means exceed their median."""
    h, w = samples.shape
    rows = np.arange(33) * h // 32
    if h >= 32:
        a = np.add.reduceat(samples, rows[:-1], axis=0, dtype=np.float64) / np.diff(rows)[:, None]
    else:
        a = samples[np.arange(32) * h // 32].astype(np.float64)
    small = a.reshape(32, 32, w // 32).mean(2)
    low = _TABLE @ small @ _TABLE.T
    bits = (low.ravel() > np.median(low.ravel()[1:])).astype(np.uint8)
    return np.packbits(bits).tobytes().hex()


def store_text(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    padded = raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")
    return len(raw), write_png(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH))


def media_columns(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_bytes, media (PNG), payload (its samples, read back from media) and feature (cosine hash)."""

    def make():
        def work(texts: list[str]) -> list[list]:
            stored = [store_text(t) for t in texts]
            read = [read_png(m) for _, m in stored]
            return [[n for n, _ in stored], [m for _, m in stored], [r.tobytes() for r in read], [cosine_hash(r) for r in read]]

        return work

    return map_text(df, text_col, OUTPUTS, make)
