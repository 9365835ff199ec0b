"""Book metadata from XML: title, author (writer, else artist) and bookmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "Title string, Writer string, Artist string, Publisher string, LanguageISO string, Pages struct<Page:array<struct<_Bookmark:string,_Image:string>>>"


def parse(xml: Column) -> Column:
    return F.from_xml(xml, SCHEMA)


def author(info: Column) -> Column:
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(given(info["Writer"]), given(info["Artist"]))


def bookmarks(df: DataFrame, book: str, info: str) -> DataFrame:
    """(book, page_no, title) of bookmarked pages."""
    pages = df.select(book, F.posexplode(f"{info}.Pages.Page").alias("i", "p"))
    return pages.where(F.trim("p._Bookmark") != "").select(book, (F.col("i") + 1).alias("page_no"), F.trim("p._Bookmark").alias("title"))


def find(entries: DataFrame, book: str, path: str, order: str) -> DataFrame:
    """Of each book the first entry in order that is named ComicInfo.xml, in any folder; books without one give no row."""
    name = F.lower(F.col(path))
    named = entries.where((name == "comicinfo.xml") | name.endswith("/comicinfo.xml"))
    rest = F.struct(*[F.col(c) for c in entries.columns if c != book])
    return named.groupBy(book).agg(F.min_by(rest, order).alias("_x")).select(book, "_x.*")
