"""Rasters from image files: PNG of every colour type and depth, GIF and BMP, decoded in numpy.

Transparent pixels are laid over a background gray. Of 16-bit samples the high byte counts; of a GIF, the first picture.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .ranged import by_bytes

FIELDS = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType())]
#: More pixels than a page ever has; a damaged size must not ask for all memory.
MOST_PIXELS = 1 << 28
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Passes of an interlaced picture: first column and row, steps.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def decode_images(files: DataFrame, content: str = "content", background: int = 255) -> DataFrame:
    """Adds width, height, data (three bytes a pixel) and error to rows with the bytes of an image.

    Null, empty, damaged and unknown files have an error and no raster. No shuffle; a picture is decoded in its row's task.
    An empty table gives no rows; columns of these names are replaced.
    """
    names = [f.name for f in FIELDS]
    kept = files.select(*[c for c in files.columns if c not in names])
    at = kept.columns.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # some 20 rasters at once, or a larger one
            for lo, hi in by_bytes((64 * (n or 0) for n in pc.binary_length(b.column(at)).to_pylist()), 32 << 20):
                made = [one(x) for x in b.column(at).slice(lo, hi - lo).to_pylist()]
                cols = [pa.array(list(v), t) for v, t in zip(zip(*made, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, *cols], names=[*b.schema.names, *names])

    def one(raw: bytes | None) -> tuple:
        try:
            rgb = decode(raw, background)
        except (ValueError, IndexError, KeyError, struct.error, zlib.error) as e:
            return None, None, None, str(e) or type(e).__name__
        return rgb.shape[1], rgb.shape[0], rgb.tobytes(), None

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *FIELDS]))


def decode(raw: bytes | None, background: int = 255) -> np.ndarray:
    """(height, width, 3) of an image file's bytes; ValueError and the like for what can't be read."""
    raw = raw or b""
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        return over(png(raw), background)
    if raw[:6] in (b"GIF87a", b"GIF89a"):
        return over(gif(raw), background)
    if raw[:2] == b"BM":
        return over(bmp(raw), background)
    raise ValueError("neither PNG nor GIF nor BMP")


def over(rgba: np.ndarray, background: int) -> np.ndarray:
    """Colours laid over a gray."""
    if rgba.shape[2] == 3:
        return rgba
    a = rgba[:, :, 3:].astype(np.int64)
    return ((rgba[:, :, :3] * a + background * (255 - a) + 127) // 255).astype(np.uint8)


def checked(w: int, h: int) -> tuple[int, int]:
    if not 0 < w * h <= MOST_PIXELS or w <= 0:
        raise ValueError(f"no picture of {w} x {h}")
    return w, h


# -- PNG


def png(raw: bytes) -> np.ndarray:
    at, head, palette, clear, packed, ended = 8, None, None, b"", [], False
    while at + 12 <= len(raw) and not ended:
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size or raw[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"chunk {kind.decode('latin-1')} is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or head[3] not in DEPTHS or head[2] not in DEPTHS[head[3]] or head[4] or head[5] or head[6] > 1:
        raise ValueError("no header of a known kind")
    w, h, depth, kind, _, _, interlaced = head
    checked(w, h)
    samples, bits = CHANNELS[kind], CHANNELS[kind] * depth
    whole = sum(ph * (1 + (pw * bits + 7) // 8) for pw, ph in (passes(w, h) if interlaced else [(w, h)]) if pw and ph)
    flat = np.frombuffer(zlib.decompressobj().decompress(b"".join(packed), whole), np.uint8)
    if len(flat) < whole:
        raise ValueError("picture data ends early")
    if not interlaced:
        grid = rows_of(flat, w, h, samples, depth)
    else:
        grid, at = np.zeros((h, w, samples), np.uint16), 0
        for (x, y, dx, dy), (pw, ph) in zip(PASSES, passes(w, h), strict=True):
            if pw and ph:
                n = ph * (1 + (pw * bits + 7) // 8)
                grid[y::dy, x::dx] = rows_of(flat[at : at + n], pw, ph, samples, depth)
                at += n
    return coloured(grid, kind, depth, palette, clear)


def passes(w: int, h: int) -> list[tuple[int, int]]:
    return [(max(0, -(-(w - x) // dx)), max(0, -(-(h - y) // dy))) for x, y, dx, dy in PASSES]


def rows_of(flat: np.ndarray, w: int, h: int, samples: int, depth: int) -> np.ndarray:
    """Samples of one picture or pass, as they are stored."""
    lines = flat.reshape(h, -1)
    step = max(1, samples * depth // 8)
    body = unfiltered(lines[:, 1:], lines[:, 0], step)
    if depth == 16:
        return body.reshape(h, w, samples, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    if depth < 8:
        bits = np.unpackbits(body, axis=1).reshape(h, -1, depth)
        return (bits @ (1 << np.arange(depth - 1, -1, -1)))[:, :w, None].astype(np.uint16)
    return body.reshape(h, w, samples).astype(np.uint16)


def unfiltered(body: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Bytes before the filters. Rows go in lockstep, each one pixel behind the one above: what a pixel needs is done."""
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    h, n = body.shape
    if not kinds.any():
        return np.ascontiguousarray(body)
    w = n // step
    given = body.reshape(h, w, step).astype(np.int16)
    out = np.zeros((h + 1, w + 1, step), np.int16)
    kind = kinds.astype(np.int64)[:, None]
    for t in range(w + h - 1):
        y = np.arange(max(0, t - w + 1), min(h, t + 1))
        x = t - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        p = left + up - corner
        a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        k = kind[y]
        added = np.where(k == 1, left, np.where(k == 2, up, np.where(k == 3, (left + up) >> 1, np.where(k == 4, nearest, 0))))
        out[y + 1, x + 1] = (given[y, x] + added) & 255
    return out[1:, 1:].astype(np.uint8).reshape(h, n)


def coloured(grid: np.ndarray, kind: int, depth: int, palette: np.ndarray | None, clear: bytes) -> np.ndarray:
    """RGB, or RGBA where something is transparent."""
    h, w, _ = grid.shape
    if kind == 3:
        if palette is None or grid.max() >= len(palette):
            raise ValueError("colours outside of the palette")
        rgb = palette[grid[:, :, 0]]
        if not clear:
            return rgb
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear[: len(palette)], np.uint8)
        return np.concatenate([rgb, alpha[grid]], axis=2)
    eight = (grid >> 8 if depth == 16 else grid * (255 // ((1 << depth) - 1)) if depth < 8 else grid).astype(np.uint8)
    colours = 1 if kind in (0, 4) else 3
    rgb = np.repeat(eight[:, :, :1], 3, axis=2) if colours == 1 else eight[:, :, :3]
    if kind in (4, 6):
        return np.concatenate([rgb, eight[:, :, colours:]], axis=2)
    if clear:
        same = (grid == np.array(struct.unpack(f">{colours}H", clear[: 2 * colours]), np.uint16)).all(axis=2)
        return np.concatenate([rgb, np.where(same, 0, 255).astype(np.uint8)[:, :, None]], axis=2)
    return rgb


# -- GIF


def gif(raw: bytes) -> np.ndarray:
    w, h = checked(*struct.unpack_from("<HH", raw, 6))
    flags, at = raw[10], 13
    common = None
    if flags & 0x80:
        n = 2 << (flags & 7)
        common, at = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
    clear = None
    while raw[at] != 0x2C:
        if raw[at] != 0x21:
            raise ValueError("no picture")
        if raw[at + 1] == 0xF9 and raw[at + 3] & 1:
            clear = raw[at + 6]
        at = blocks(raw, at + 2)[1]
    x, y, pw, ph, flags = struct.unpack_from("<HHHHB", raw, at + 1)
    checked(pw, ph)
    at += 10
    if flags & 0x80:
        n = 2 << (flags & 7)
        common, at = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
    if common is None:
        raise ValueError("no colours")
    body, _ = blocks(raw, at + 1)
    codes = unzipped(body, raw[at], pw * ph)
    if len(codes) < pw * ph or max(codes) >= len(common):
        raise ValueError("picture data is damaged")
    picture = np.frombuffer(codes, np.uint8).reshape(ph, pw)
    if flags & 0x40:
        order = [*range(0, ph, 8), *range(4, ph, 8), *range(2, ph, 4), *range(1, ph, 2)]
        straight = np.empty_like(picture)
        straight[order] = picture
        picture = straight
    out = np.zeros((max(h, y + ph), max(w, x + pw), 4), np.uint8)
    out[y : y + ph, x : x + pw, :3] = common[picture]
    out[y : y + ph, x : x + pw, 3] = 255 if clear is None else np.where(picture == clear, 0, 255)
    return out[:h, :w]


def blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    """Joined sub-blocks, and where they end."""
    out = []
    while raw[at]:
        out.append(raw[at + 1 : at + 1 + raw[at]])
        at += 1 + raw[at]
    return b"".join(out), at + 1


def unzipped(body: bytes, least: int, want: int) -> bytes:
    """Indices from codes of growing width; stops when there are as many as wanted."""
    if not 2 <= least <= 8:
        raise ValueError("unknown code size")
    fresh = [bytes([i]) for i in range(1 << least)] + [b"", b""]
    words, width, last = list(fresh), least + 1, b""
    held, bits, out, size = 0, 0, [], 0
    for byte in body:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code = held & ((1 << width) - 1)
            held >>= width
            bits -= width
            if code == 1 << least:
                words, width, last = list(fresh), least + 1, b""
                continue
            if code == (1 << least) + 1 or size >= want:
                return b"".join(out)[:want]
            if code > len(words) or (code == len(words) and not last):
                raise ValueError("unknown code")
            word = words[code] if code < len(words) else last + last[:1]
            if last and len(words) < 4096:
                words.append(last + word[:1])
                if len(words) == 1 << width and width < 12:
                    width += 1
            out.append(word)
            size += len(word)
            last = word
    return b"".join(out)[:want]


# -- BMP


def bmp(raw: bytes) -> np.ndarray:
    begin, size = struct.unpack_from("<I", raw, 10)[0], struct.unpack_from("<I", raw, 14)[0]
    if size < 40:
        w, h, _, bits = struct.unpack_from("<HHHH", raw, 18)
        packing, used, entry = 0, 0, 3
    else:
        w, h, _, bits, packing = struct.unpack_from("<iiHHI", raw, 18)
        used, entry = struct.unpack_from("<I", raw, 46)[0], 4
    turned, h = h < 0, abs(h)
    checked(w, h)
    if packing not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32) or (packing == 3 and bits < 16):
        raise ValueError(f"{bits} bits packed by {packing} are not supported")
    line = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(raw, np.uint8, line * h, begin).reshape(h, line)
    if bits <= 8:
        colours = np.frombuffer(raw, np.uint8, entry * (used or 1 << bits), 14 + size).reshape(-1, entry)[:, 2::-1]
        index = (np.unpackbits(rows, axis=1).reshape(h, -1, bits) @ (1 << np.arange(bits - 1, -1, -1)))[:, :w]
        if index.max() >= len(colours):
            raise ValueError("colours outside of the palette")
        out = colours[index]
    elif bits == 24:
        out = rows[:, : 3 * w].reshape(h, w, 3)[:, :, ::-1]
    else:
        value = rows[:, : w * bits // 8].copy().view("<u2" if bits == 16 else "<u4").astype(np.int64)
        masks = struct.unpack_from("<III", raw, 54) if packing == 3 else (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
        parts = []
        for m in masks:
            low = m & -m or 1
            most = m // low or 1
            parts.append(((value & m) // low * 255 + most // 2) // most)
        out = np.stack(parts, axis=2).astype(np.uint8)
    return np.ascontiguousarray(out if turned else out[::-1])
