"""The plan of a conversion: each image's output pages, before any pixel is touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def page_plan(
    images: DataFrame, *, device: str = "X4", size: tuple[int, int] | None = None, horizontal: float = 0.0, vertical: float = 0.0, sideways: bool = False, upright: bool = False,
    portrait: bool = False, split: str = "overlap", single: str | None = None, landscape: bool = False, strip_overlap: int | None = None, as_array: bool = False,
) -> DataFrame:
    """One row per output page: kind, source rectangle (after the crop, which begins at cx, cy), turn and where it lands.

    images has w and h. size stands for the device's. single (pad, cover, fill or crop) is the mode of single images that
    are not split, turned if landscape; strip_overlap (percent) cuts an image into slices of the target's shape. As an array,
    the pages of an image stay in one row, in column plan.
    """
    tw, th = size or G.device_size(device)
    crop = G.crop_rect(F.col("w"), F.col("h"), F.lit(horizontal), F.lit(vertical))
    df = images.withColumn("crop", crop)
    w, h = F.col("crop.w"), F.col("crop.h")
    whole = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), w.alias("w"), h.alias("h"))

    def page(kind: str, rect: Column, turn: int, mode: str = "pad") -> Column:
        pw, ph = (rect["h"], rect["w"]) if turn == 90 else (rect["w"], rect["h"])
        fit = G.fit_rect(pw, ph, tw, th, mode)
        return F.struct(
            F.lit(kind).alias("kind"), rect["x"].cast("int").alias("x"), rect["y"].cast("int").alias("y"), rect["w"].cast("int").alias("sw"), rect["h"].cast("int").alias("sh"), F.lit(turn).alias("turn"),
            fit["x"].alias("fx"), fit["y"].alias("fy"), fit["w"].alias("fw"), fit["h"].alias("fh"), F.col("crop.x").alias("cx"), F.col("crop.y").alias("cy"),
        )

    first = ([page("sideways", whole, 90)] if sideways else []) + ([page("upright", whole, 0)] if upright else [])
    if single and split == "nosplit" and strip_overlap is None:
        rest = F.array(page("single", whole, 90 if landscape else 0, single))
    elif strip_overlap is not None:
        rest = F.transform(G.strip_slices(w, h, tw, th, strip_overlap), lambda r: page("slice", r, 0))
    elif portrait:
        rest = F.array(page("portrait", whole, 0))
    else:
        parts = G.overlap_segments(w, h, tw, th) if split == "overlap" else G.half_split(w, h)
        turned = F.array(page("whole", whole, 90))
        rest = turned if split == "nosplit" else F.when(w < h, F.transform(parts, lambda r: page("segment", r, 90))).otherwise(turned)
    all_ = F.concat(F.array(*first), rest) if first else rest
    kept = [c for c in df.columns if c != "crop"]
    if as_array:
        return df.select(*kept, all_.alias("plan"))
    return df.select(*kept, F.posexplode(all_).alias("out_idx", "p")).select(*kept, "out_idx", "p.*")
