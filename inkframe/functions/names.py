"""File names, types, sizes and page ranges as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by kind.
KINDS = {"cbz": ["cbz"], "cbr": ["cbr"], "pdf": ["pdf"], "xtc": ["xtc", "xtch"]}
IMAGES = ["jpg", "jpeg", "png", "webp", "bmp", "gif"]
# Extensions that each kind of input takes.
INPUTS = {"pdf": ["pdf"], "image": IMAGES, "video": ["mp4", "webm", "mkv", "avi", "mov"], "xtc": ["xtc", "xtch", "xtg", "xth"], "comic": ["cbz", "cbr"]}


def extension(name: Column) -> Column:
    """What follows the last dot, lower-cased; the whole name if there is none."""
    return F.lower(F.substring_index(name, ".", -1))


def file_type(name: Column) -> Column:
    out = F.lit("unknown")
    for kind, exts in KINDS.items():
        out = F.when(extension(name).isin(exts), kind).otherwise(out)
    return out


def is_page_image(path: Column) -> Column:
    return path.rlike(rf"(?i)\.({'|'.join(IMAGES)})$") & ~F.lower(path).startswith("__macos")


def input_kind(name: Column) -> Column:
    """The kind of input that takes a file of this name; null if none does. The dot must be there."""
    return F.coalesce(*[F.when(name.rlike(rf"(?i)\.({'|'.join(exts)})$"), kind) for kind, exts in INPUTS.items()])


def container_extension(two_bit: Column) -> Column:
    return F.when(two_bit, "xtch").otherwise("xtc")


def part_name(name: Column, part: Column, ext: Column) -> Column:
    """The name of a part, counted from 1, of a split file."""
    return F.concat(output_name(name, ""), F.lit("_part"), part.cast("string"), F.lit("."), ext)


def merged_name(ext: Column) -> Column:
    return F.concat(F.lit("merged."), ext)


def edited_name(name: Column, two_bit: Column) -> Column:
    return F.concat(output_name(name, ""), F.lit("_edited."), container_extension(two_bit))


def output_name(name: Column, suffix: str) -> Column:
    return F.regexp_replace(name, r"\.[^/.]+$", suffix)


def format_size(n: Column) -> Column:
    """B, KB or MB, with one digit; halves go up."""
    one = lambda x: F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(one(n / 1024.0), F.lit(" KB"))).otherwise(F.concat(one(n / 1048576.0), F.lit(" MB")))


def part_base(name: Column) -> Column:
    """The name before `part N`, or empty."""
    return F.regexp_extract(name, r"(?i)^(.*?)[_\s]+part\s*\d+", 1)


def folder_title(path: Column) -> Column:
    """The last folder of a path; null at the top."""
    return F.get(F.reverse(F.split(path, "/")), F.lit(1))


def page_ranges(text: Column, total: Column) -> Column:
    """`1-3, 5` as an array of (start, end, error); an entry's numbers are its leading digits."""
    number = lambda x: F.nullif(F.regexp_extract(x, r"^\s*([+-]?\d+)", 1), F.lit("")).cast("int")

    def one(part: Column) -> Column:
        pieces = F.split(part, "-")
        start = number(F.get(pieces, F.lit(0)))
        end = F.when(F.size(pieces) > 1, number(F.get(pieces, F.lit(1)))).otherwise(start)
        bad = start.isNull() | end.isNull() | (start < 1) | (end > total) | (start > end)
        return F.struct(start.alias("start"), end.alias("end"), bad.alias("error"))

    return F.transform(F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != ""), one)


def equal_parts(total: Column, n: Column) -> Column:
    """n page ranges that differ by one page at most, longer ones first; none where parts_error has a message."""
    m = F.nullif(n, F.lit(0))
    q, r = F.floor(total / m).cast("int"), (total % m).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), n) - 1), lambda i: F.struct((i * q + F.least(i, r) + 1).alias("start"), ((i + 1) * q + F.least(i + 1, r)).alias("end")))
    return F.when(parts_error(total, n).isNull(), parts)


def parts_error(total: Column, n: Column) -> Column:
    """Why a book of so many pages can't be split into n parts; null if it can."""
    many = F.format_string("Cannot split %d pages into %d parts", total, n)
    return F.when(n.isNull() | total.isNull() | (n < 1), F.lit("Must have at least 1 part")).when(n > total, many)


def page_title(page_no: Column, chapter: Column, folder: Column, offset: int = 0) -> Column:
    """`Page 7`, with the page's bookmark, or else its folder, behind it."""
    name = F.coalesce(chapter, folder)
    plain = F.concat(F.lit("Page "), (page_no + offset).cast("string"))
    return F.when(name.isNull(), plain).otherwise(F.concat(plain, F.lit(" - "), name))


def info_hash(magnet: Column) -> Column:
    """The lower-cased hash of a magnet link; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(magnet, "(?i)xt=urn:btih:([a-z0-9]+)", 1)), F.lit(""))


def with_trackers(magnet: Column, trackers: list[str]) -> Column:
    """The link with each tracker that it doesn't name yet."""
    for t in trackers:
        coded = F.url_encode(F.lit(t))
        magnet = F.when(F.contains(magnet, coded), magnet).otherwise(F.concat(magnet, F.lit("&tr="), coded))
    return magnet
