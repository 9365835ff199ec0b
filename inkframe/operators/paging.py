"""Books as tables of pages: manifests, tables of contents, merges and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Ranges of one call at most; with more rows than fit them at rows_a_range, ranges grow.
MOST_RANGES = 1_024


def range_bounds(rows: DataFrame, order: str, rows_a_range: int = 1_000_000) -> list[float]:
    """Bounds that cut rows into value ranges of about rows_a_range rows by a number; none for a table that one range holds.

    They are approximate quantiles; only the balance depends on them.
    """
    parts = min(MOST_RANGES, -(-rows.count() // rows_a_range))
    if parts < 2:
        return []
    at = rows.agg(F.percentile_approx(F.col(order).cast("double"), [i / parts for i in range(1, parts)], 10_000)).first()[0]
    return sorted(set(at or []))


def _ties(rows: DataFrame, *used: str) -> list[str]:
    """The other columns of plain values: rows of equal number come in their order, the same in every run. Bytes are left
    out, so that pages can be numbered without reading them."""
    return [f"`{f.name}`" for f in rows.schema if f.name not in used and isinstance(f.dataType, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.BooleanType))]


def running(rows: DataFrame, book: str, order: str, sums: dict[str, str], totals: dict[str, str] | None = None, count: str | None = None, rows_a_range: int = 1_000_000) -> DataFrame:
    """Adds sums over a book's earlier rows (name: column), totals over all of them, and a row number (count), in the
    order of a number; rows of equal number come in the order of their other columns of plain values, nulls first. Rows without a book count as one book, rows without a number come first.

    A table that one range holds is sorted by book. Rows of a larger one are sorted by book and range; what earlier ranges and whole books hold is summed up first, one row a range.
    """
    bounds = range_bounds(rows, order, rows_a_range)
    all_ = {**sums, **(totals or {})}
    ties = _ties(rows, book, order)
    if not bounds:
        here, whole = Window.partitionBy(book).orderBy(order, *ties), Window.partitionBy(book)
        made = {k: F.coalesce(F.sum(c).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long") for k, c in sums.items()}
        made |= {k: F.sum(c).over(whole) for k, c in (totals or {}).items()}
        made |= {count: F.row_number().over(here)} if count else {}
        return rows.withColumns(made)
    cuts = F.array(*[F.lit(x) for x in bounds])
    ranged = rows.withColumn("_range", F.when(F.col(order).isNull(), -1).otherwise(F.size(F.filter(cuts, lambda c: c < F.col(order).cast("double")))))
    by_range = ranged.groupBy(book, "_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{k}") for k, c in all_.items()])
    before, whole = Window.partitionBy(book).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(book)
    held = by_range.select(
        book, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"),
        *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_pre_{k}") for k in sums], *[F.sum(f"_sum_{k}").over(whole).alias(k) for k in totals or {}],
    )
    here = Window.partitionBy(book, "_range").orderBy(order, *ties)
    up_to = here.rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumnsRenamed({book: "_book", "_range": "_in"})
    out = ranged.join(held, F.col(book).eqNullSafe(F.col("_book")) & (F.col("_range") == F.col("_in")))
    for k, c in sums.items():
        out = out.withColumn(k, (F.col(f"_pre_{k}") + F.coalesce(F.sum(c).over(up_to), F.lit(0))).cast("long"))
    if count:
        out = out.withColumn(count, (F.col("_rows") + F.row_number().over(here)).cast("int"))
    return out.drop("_range", "_rows", "_book", "_in", *[f"_pre_{k}" for k in sums])


def number_pages(pages: DataFrame, book: str, order: str) -> DataFrame:
    """Adds page_no, a page's place in its book by a number."""
    return running(pages, book, order, {}, count="page_no")


def manifest(pages: DataFrame, book: str = "book", toc_entries: int = 0, has_metadata: bool = False) -> DataFrame:
    """Adds offset: where each page will lie in its book's container, from sizes alone. pages has page_no and size."""
    placed = running(pages.withColumn("_one", F.lit(1)), book, "page_no", {"_before": "size"}, {"_pages": "_one"})
    head = F.lit(56 + 256 + 96 * toc_entries if has_metadata else 48) + 16 * F.col("_pages")
    return placed.withColumn("offset", (head + F.col("_before")).cast("long")).drop("_one", "_before", "_pages")


def output_mapping(pages: DataFrame, book: str = "book") -> DataFrame:
    """Adds out_start: the first output page of each original page, which has n_out of them."""
    return running(pages, book, "page_no", {"out_start": "n_out"}).withColumn("out_start", F.col("out_start") + 1)


def toc_ends(toc: DataFrame, book: str, total: str) -> DataFrame:
    """Adds end: the page before the next entry, or the book's last."""
    nxt = F.lead("start").over(Window.partitionBy(book).orderBy("idx"))
    return toc.withColumn("end", F.coalesce(nxt - 1, F.col(total)).cast("long"))


def remap_toc(toc: DataFrame, mapping: DataFrame, book: str = "book") -> DataFrame:
    """Starts by output page; entries without a mapped page keep theirs."""
    m = mapping.select(book, F.col("page_no").alias("start"), "out_start")
    return toc.join(m, [book, "start"], "left").withColumn("start", F.coalesce("out_start", "start")).drop("out_start")


def split_by_ranges(pages: DataFrame, ranges: DataFrame, book: str, cell: int = 64) -> DataFrame:
    """Pages in each range (a page can be in several), numbered from 1 in their part.

    Both sides meet on cells of pages, so that long books are no nested loop.
    """
    cells = F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell)))
    r = ranges.withColumn("cell", cells)
    p = pages.withColumn("cell", F.floor(F.col("page_no") / cell))
    hit = p.join(r, [book, "cell"]).where(F.col("page_no").between(F.col("start"), F.col("end")))
    return hit.withColumn("part_page", F.col("page_no") - F.col("start") + 1).drop("cell")


def clip_toc(toc: DataFrame, ranges: DataFrame, book: str) -> DataFrame:
    """TOC entries (start, end) in each range (range_start, range_end), clipped to it and counted from its start."""
    j = toc.join(ranges, book).where(F.greatest("start", "range_start") <= F.least("end", "range_end"))
    return j.withColumns({"part_start": F.greatest("start", "range_start") - F.col("range_start") + 1, "part_end": F.least("end", "range_end") - F.col("range_start") + 1})


def merge_offsets(books: DataFrame, order: str, count: str = "page_count") -> DataFrame:
    """Adds shift: the pages of all earlier books. Books are few against pages; group first when there are many sets."""
    w = Window.partitionBy("set_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return books.withColumn("shift", F.coalesce(F.sum(count).over(w), F.lit(0)).cast("long"))


def islands(rows: DataFrame, part: str, order: str, value: str) -> DataFrame:
    """Adds island: a number for each run of rows with one value."""
    w = Window.partitionBy(part).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w).cast("long")).drop("_new")


def in_path_order(files: DataFrame, path: str) -> DataFrame:
    """Files sorted by path as readers of any language expect, numbers as text."""
    return files.orderBy(F.collate(F.col(path), "UNICODE"))
