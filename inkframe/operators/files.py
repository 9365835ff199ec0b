"""Merges, splits and conversions with files at both ends: containers and archives below folders that all tasks can reach.

Pages pass as they are stored; only conversions to images decode them. A file that can't be read ends the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.archive import entries, write_archives
from ..sources.container import containers
from ..sources.images import decode_images
from ..sources.ranged import stored
from .books import archive_entries, merge_books, part_meta, write_containers
from .dither import decode_pages
from .paging import number_pages
from .raster import convert


def base_name(path: Column) -> Column:
    """A file's name without folders and ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^/.]+$", "")


def sound(rows: DataFrame) -> DataFrame:
    """Rows without errors; a row with one ends the job."""
    why = F.concat_ws(": ", "book", "error")
    return rows.where(F.when(F.col("error").isNotNull(), F.raise_error(why).cast("boolean")).otherwise(True)).drop("error")


def merge_containers(spark: SparkSession, path: str, sets: DataFrame, out: str) -> None:
    """Writes a container for each set (book, name, file_idx) of container files: pages one behind the other, chapters moved
    up, title, author and depth of the first file. sets has a row a file, and few of them against pages."""
    heads = sound(containers(spark, path, "books"))
    files = sets.select(F.col("name").alias("set_id"), F.col("book").alias("file"), "file_idx").join(heads.withColumnRenamed("book", "file"), "file")
    pages = sound(containers(spark, path)).select(F.col("book").alias("file"), "page_no", "page_blob")
    toc = sound(containers(spark, path, "toc")).select(F.col("book").alias("file"), "idx", "title", "start", "end")
    merged, moved, chapters = merge_books(files.select("set_id", "file", "file_idx", "page_count", "title", "author", "two_bit"), pages, toc)
    # a file has 65,535 chapters at most
    order = F.col("file_idx").cast("long") * 65_536 + F.col("idx")
    write_containers(
        moved.select(F.col("set_id").alias("book"), "page_no", "page_blob"), out, meta=merged.select(F.col("set_id").alias("book"), "title", "author", "two_bit"),
        toc=chapters.select(F.col("set_id").alias("book"), order.alias("idx"), "title", "start", "end"),
    )


def split_containers(spark: SparkSession, path: str, ranges: DataFrame, out: str) -> None:
    """Writes a container for each range (book, part, start, end) of a container's pages, named by file and part: pages
    numbered from 1, chapters clipped, a title with the part's number, author and depth of the file."""
    heads = sound(containers(spark, path, "books")).select("book", "title", "author", "two_bit").join(ranges, "book")
    name = F.concat(base_name(F.col("book")), F.lit("_part"), F.col("part").cast("string"))
    inside = sound(containers(spark, path)).join(ranges, "book").where(F.col("page_no").between(F.col("start"), F.col("end")))
    pages = inside.select(name.alias("book"), (F.col("page_no") - F.col("start") + 1).cast("int").alias("page_no"), "page_blob")
    first, last = F.greatest("start", "low"), F.least("end", "high")
    bounds = ranges.select("book", "part", F.col("start").alias("low"), F.col("end").alias("high"))
    toc = sound(containers(spark, path, "toc")).join(bounds, "book").where(first <= last)
    toc = toc.select(name.alias("book"), "idx", "title", (first - F.col("low") + 1).alias("start"), (last - F.col("low") + 1).alias("end"))
    titled = part_meta(heads.select("book", "title", "author").distinct(), ranges.select("book", "part"), F.regexp_extract("book", r"([^/]*)$", 1))
    meta = titled.join(heads.select("book", "part", "two_bit"), ["book", "part"]).select(name.alias("book"), "title", "author", "two_bit")
    write_containers(pages, out, meta=meta, toc=toc)


def containers_to_archives(spark: SparkSession, path: str, out: str) -> None:
    """Writes an archive of images for each container: pages decoded, named by number. Pages that don't decode are left out."""
    pages = sound(containers(spark, path)).select(base_name(F.col("book")).alias("book"), "page_no", "page_blob")
    images = archive_entries(pages).where("png IS NOT NULL")
    number = F.regexp_extract("name", r"^(\d+)", 1).cast("int")
    write_archives(images.select(F.concat("book", F.lit(".cbz")).alias("name"), number.alias("page_no"), F.col("name").alias("entry"), "png"), out)


def archives_to_containers(spark: SparkSession, path: str, out: str, two_bit: bool = False, **options) -> None:
    """Converts archives of images to containers: entries in collated order, decoded, converted by the page plan, numbered by
    image and output page. Images that can't be read give no pages. options are those of convert."""
    found = decode_images(entries(spark, path).where("error IS NULL")).where("error IS NULL")
    images = found.select(base_name(F.col("book")).alias("book"), "page_no", "width", "height", "data")
    made = convert(images, ["book", "page_no"], two_bit=two_bit, **options).where("error IS NULL")
    # page_no orders images, out_idx the pages of one: numbers with gaps, closed by counting
    placed, drop = stored(made.select("book", "page_blob", (F.col("page_no").cast("long") * 65_536 + F.col("out_idx")).alias("at")))
    write_containers(number_pages(placed, "book", "at").select("book", "page_no", "page_blob"), out, two_bit)
    drop()


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """(book, width, height, gray, error) of single encoded pages in files (.xtg, .xth); bad ones have an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xtg,xth,XTG,XTH}").option("recursiveFileLookup", "true").load(path)
    return decode_pages(files.select(F.col("path").alias("book"), F.col("content").alias("page_blob"))).select("book", "width", "height", "gray", "error")

