"""Page geometry as Column expressions: crops, fits, segments, output counts and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Target sizes by device.
DEVICES = {"X4": (480, 800), "X3": (528, 792)}


def device_size(device: str) -> tuple[int, int]:
    return DEVICES.get(device, DEVICES["X4"])


def clamp_margin(percent: Column) -> Column:
    """0 to 20; null and non-finite as 0."""
    ok = percent.isNotNull() & ~F.isnan(percent) & (F.abs(percent) != float("inf"))
    return F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(20.0), percent))).otherwise(0.0)


def crop_rect(w: Column, h: Column, horizontal: Column, vertical: Column) -> Column:
    """Symmetric crop by percent of each side; at least one pixel stays."""
    x = F.least(F.floor(w * clamp_margin(horizontal) / 100), F.floor((w - 1) / 2)).cast("int")
    y = F.least(F.floor(h * clamp_margin(vertical) / 100), F.floor((h - 1) / 2)).cast("int")
    return F.struct(x.alias("x"), y.alias("y"), F.greatest(F.lit(1), w - 2 * x).alias("w"), F.greatest(F.lit(1), h - 2 * y).alias("h"))


def fit_rect(w: Column, h: Column, tw: int, th: int, mode: str = "pad") -> Column:
    """Where an image lands in a target: pad (whole image, centred), cover (no gap), crop (unscaled) or fill."""
    if mode == "fill":
        return F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(tw).alias("w"), F.lit(th).alias("h"))
    pick = {"pad": F.least, "cover": F.greatest}.get(mode)
    scale = pick(F.lit(float(tw)) / F.nullif(w, F.lit(0)), F.lit(float(th)) / F.nullif(h, F.lit(0))) if pick else F.lit(1.0)
    nw, nh = F.floor(w * scale).cast("int"), F.floor(h * scale).cast("int")
    return F.struct(F.floor((tw - nw) / 2).cast("int").alias("x"), F.floor((th - nh) / 2).cast("int").alias("y"), nw.alias("w"), nh.alias("h"))


def overlap_segments(w: Column, h: Column, tw: int, th: int) -> Column:
    """3 to 10 overlapping parts of a tall page, each as high as a turned target is wide."""
    seg = F.floor(F.lit(tw) / (F.lit(float(th)) / w)).cast("int")
    shift = lambda n: F.floor(seg - (seg * n - h) / (n - 1)).cast("int")
    # a page too narrow for a part of its own height shifts by more than any share of nothing: ten parts
    n = F.coalesce(F.get(F.filter(F.sequence(F.lit(3), F.lit(9)), lambda k: ~(shift(k) / F.nullif(seg, F.lit(0)) > 0.95)), F.lit(0)), F.lit(10))
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.lit(0).alias("x"), (shift(n) * i).alias("y"), w.alias("w"), F.when(i == n - 1, h - shift(n) * i).otherwise(seg).alias("h")))
    return parts


def strip_slices(w: Column, h: Column, tw: int, th: int, overlap: int) -> Column:
    """Slices of an image scaled to the target's width, as rectangles of the unscaled image; the last one ends at its end."""
    scale = F.lit(float(tw)) / w
    high = F.floor(h * scale).cast("int")
    step = th - th * overlap // 100
    full = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((high - th) / step).cast("int"))) if step > 0 else F.array(F.lit(0))
    tops = F.transform(full, lambda k: k * step)
    last = F.element_at(tops, -1)
    tops = F.when((high > th) & (last + th < high), F.concat(tops, F.array(high - th))).otherwise(tops)
    at = lambda y: F.floor(y / scale).cast("int")
    return F.transform(tops, lambda y: F.struct(F.lit(0).alias("x"), at(y).alias("y"), w.alias("w"), F.greatest(F.lit(1), F.least(h, at(F.least(y + th, high))) - at(y)).alias("h"), y.alias("top")))


def half_split(w: Column, h: Column) -> Column:
    half = F.floor(h / 2).cast("int")
    return F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), w.alias("w"), half.alias("h")), F.struct(F.lit(0).alias("x"), half.alias("y"), w.alias("w"), (h - half).alias("h")))


def output_page_count(w: Column, h: Column, *, strip: bool = False, sideways: bool = False, upright: bool = False, portrait: bool = False, split: str = "overlap") -> Column:
    """How many pages an image of this size is planned to give."""
    if strip:
        return F.lit(0)
    extra = F.lit(int(sideways) + int(upright))
    if portrait:
        return extra + 1
    return extra + F.when((w < h) & F.lit(split != "nosplit"), 3 if split == "overlap" else 2).otherwise(1)


def page_size(w: Column, h: Column, two_bit: bool = False) -> Column:
    """Bytes of an encoded page with its 22-byte header."""
    eighth = lambda c: F.floor((c + 7) / 8).cast("long")
    return 22 + (2 * eighth(h) * w if two_bit else eighth(w) * h)


def orientation_angle(orientation: Column) -> Column:
    return F.when(orientation == "landscape", 90).otherwise(0)


def frame_angle(orientation: Column, w: Column, h: Column) -> Column:
    """The turn of a video frame: tall frames are never turned."""
    return F.when(w >= h, orientation_angle(orientation)).otherwise(0)


def wide_halves(w: Column, h: Column, overlap: int = 40) -> Column:
    """Left and right halves of a wide page with some overlap; a tall page stays whole."""
    mid = F.floor(w / 2).cast("int")
    left = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.least(mid + overlap, w).alias("w"), h.alias("h"))
    start = F.greatest(F.lit(0), mid - overlap)
    right = F.struct(start.alias("x"), F.lit(0).alias("y"), (w - start).alias("w"), h.alias("h"))
    return F.when(w > h, F.array(left, right)).otherwise(F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), w.alias("w"), h.alias("h"))))
