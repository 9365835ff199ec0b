"""Books as tables: merges, titles and chapters, edits of a table of contents, containers as streams of chunks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import names as N
from ..sources import container
from ..sources.ranged import write_chunks
from .dither import decode_pages
from .paging import manifest, merge_offsets


def merge_books(files: DataFrame, pages: DataFrame, toc: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Containers joined by set: (books, pages, toc) of the merged ones.

    files has set_id, file, file_idx, page_count, title, author, two_bit; pages has file and page_no; toc has file, start,
    end. Blobs are not touched. Title, author and depth come from a set's first file; pages and chapters move up by the
    pages of earlier files. Files are few against pages.
    """
    placed = merge_offsets(files, "file_idx")
    first = lambda c: F.min_by(c, "file_idx").alias(c)
    books = placed.groupBy("set_id").agg(first("title"), first("author"), first("two_bit"), F.sum("page_count").alias("page_count"))
    by_file = placed.select("file", "set_id", "file_idx", "shift")
    moved = pages.join(by_file, "file").withColumn("page_no", (F.col("page_no") + F.col("shift")).cast("long")).drop("shift")
    chapters = toc.join(by_file, "file").withColumns({"start": F.col("start") + F.col("shift"), "end": F.col("end") + F.col("shift")}).drop("shift")
    return books, moved, chapters


def same_type(files: DataFrame) -> DataFrame:
    """(set_id, valid, type, error) of each set of files (set_id, file_idx, name): all must be of the first one's type."""
    kind = files.withColumn("kind", N.file_type(F.col("name")))
    found = kind.groupBy("set_id").agg(F.min_by("kind", "file_idx").alias("type"), F.count_distinct("kind").alias("kinds"))
    error = F.when(F.col("type") == "unknown", "Unsupported file type").when(F.col("kinds") > 1, "All files must be the same type")
    return found.select("set_id", error.isNull().alias("valid"), "type", error.alias("error"))


def merge_output(kind: Column, wanted: Column) -> Column:
    """What a merge of files of this type puts out: containers become what is wanted (xtc or cbz), others stay as they are;
    null for types that can't be merged."""
    return F.when(kind == "xtc", F.when(wanted == "cbz", "cbz").otherwise("xtc")).when(kind.isin("cbz", "pdf"), kind)


def first_of_folders(pages: DataFrame) -> DataFrame:
    """(book, folder, first): the first page of each last folder; pages at the top count for none. pages has book, page_no,
    path."""
    return pages.withColumn("folder", N.folder_title(F.col("path"))).where(F.col("folder").isNotNull()).groupBy("book", "folder").agg(F.min("page_no").alias("first"))


def first_pages(pages: DataFrame) -> DataFrame:
    """(book, page_blob) of each book's first page, as it is stored on its own. pages has book, page_no, page_blob."""
    return pages.groupBy("book").agg(F.min_by("page_blob", "page_no").alias("page_blob"))


def archive_entries(pages: DataFrame) -> DataFrame:
    """(book, name, png): encoded pages as images of an archive, named by page; pages that don't decode keep their number
    and give a null png. No shuffle. pages has book, page_no, page_blob."""
    decoded = decode_pages(pages.select("book", "page_no", "page_blob"))
    name = F.concat(F.lpad(F.col("page_no").cast("string"), 5, "0"), F.lit(".png"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [png_of(g, w, h) if g is not None else None for w, h, g in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], names=["book", "name", "png"])

    kind = pages.schema["book"].dataType.simpleString()
    return decoded.select("book", name.alias("name"), "width", "height", "gray").mapInArrow(run, f"book {kind}, name string, png binary")


def png_images(rasters: DataFrame) -> DataFrame:
    """Adds png, a gray image of 8 bits, to rows with width, height and as many bytes of data; null for other rows."""
    kept = rasters.select(*[c for c in rasters.columns if c != "png"])
    at = [kept.columns.index(c) for c in ("data", "width", "height")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [png_of(g, w, h) if g and w and h and len(g) == w * h else None for g, w, h in zip(*(b.column(i).to_pylist() for i in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=[*b.schema.names, "png"])

    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", png binary")


def png_of(gray: bytes, w: int, h: int) -> bytes:
    """A gray image of 8 bits; every row goes without a filter."""
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + gray[y * w : y * w + w] for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def continued(files: DataFrame, base: Column) -> DataFrame:
    """Adds toc_offset: the pages of the files just before, as long as they have the same base name. files has set_id,
    file_idx, page_count; a set is one batch of chosen files."""
    w = Window.partitionBy("set_id").orderBy("file_idx")
    named = files.withColumn("_base", base)
    run = F.sum(F.when(F.lag("_base").over(w).eqNullSafe(F.col("_base")), 0).otherwise(1)).over(w)
    inside = Window.partitionBy("set_id", "_run").orderBy("file_idx").rowsBetween(Window.unboundedPreceding, -1)
    return named.withColumn("_run", run).withColumn("toc_offset", F.coalesce(F.sum("page_count").over(inside), F.lit(0)).cast("long")).drop("_base", "_run")


def page_toc(pages: DataFrame, bookmarks: DataFrame, offset: int = 0) -> DataFrame:
    """One entry a page: its bookmark, or else its folder, in the title. pages has book, page_no, path; bookmarks has book,
    page_no, title, of which the greatest counts where a page has several."""
    marks = bookmarks.groupBy("book", "page_no").agg(F.max("title").alias("title"))
    titled = pages.join(marks, ["book", "page_no"], "left")
    return titled.select("book", "page_no", N.page_title(F.col("page_no"), F.col("title"), N.folder_title(F.col("path")), offset).alias("title"))


def folder_chapters(pages: DataFrame) -> DataFrame:
    """(book, title, start, end): a chapter a folder, from its first page to the next folder's; a book with one folder or
    none has an entry a page. pages has book, page_no, path. Pages before the first folder are chapter Start."""
    foldered = pages.withColumn("folder", N.folder_title(F.col("path")))
    first = foldered.where(F.col("folder").isNotNull()).groupBy("book", "folder").agg(F.min("page_no").alias("start"))
    whole = foldered.groupBy("book").agg(F.count("*").alias("pages"), F.count_distinct("folder").alias("folders"), F.min(F.when(F.col("folder").isNotNull(), F.col("page_no"))).alias("first"))
    many = whole.where("folders > 1")
    heads = first.join(many, "book").select("book", F.col("folder").alias("title"), "start", "pages")
    heads = heads.unionByName(many.where("first > 1").select("book", F.lit("Start").alias("title"), F.lit(1).alias("start"), "pages"))
    # folders are few against pages
    nxt = F.lead("start").over(Window.partitionBy("book").orderBy("start"))
    chapters = heads.select("book", "title", F.col("start").cast("long").alias("start"), F.coalesce(nxt - 1, F.col("pages")).cast("long").alias("end"))
    single = foldered.join(whole.where("folders < 2").select("book"), "book", "left_semi")
    n = F.col("page_no").cast("long")
    return chapters.unionByName(single.select("book", F.concat(F.lit("Page "), n.cast("string")).alias("title"), n.alias("start"), n.alias("end")))


# -- edits of a table of contents: rows with book, idx (from 1), title, start, end


def toc_add(toc: DataFrame, books: DataFrame) -> DataFrame:
    """A new chapter behind the others, over all pages; books has book and page_count."""
    last = books.join(toc.groupBy("book").agg(F.max("idx").alias("last")), "book", "left")
    new = last.select("book", (F.coalesce("last", F.lit(0)) + 1).alias("idx"), F.lit("New Chapter").alias("title"), F.lit(1).cast("long").alias("start"), F.greatest(F.lit(1), "page_count").cast("long").alias("end"))
    return toc.select("book", "idx", "title", "start", "end").unionByName(new)


def toc_remove(toc: DataFrame, idx: int) -> DataFrame:
    return toc.where(F.col("idx") != idx).withColumn("idx", F.when(F.col("idx") > idx, F.col("idx") - 1).otherwise(F.col("idx")))


def toc_change(toc: DataFrame, idx: int, field: str, value) -> DataFrame:
    return toc.withColumn(field, F.when(F.col("idx") == idx, F.lit(value)).otherwise(F.col(field)))


def toc_move(toc: DataFrame, idx: int, by: int) -> DataFrame:
    """Entry idx changes places with its neighbour above (by = -1) or below (1); nothing moves past a book's ends."""
    last = toc.groupBy("book").agg(F.max("idx").alias("_last"))
    i, other = F.col("idx"), idx + by
    swapped = F.when(i == idx, other).when(i == other, idx).otherwise(i)
    ok = (F.lit(other) >= 1) & (F.col("_last") >= max(idx, other))
    return toc.join(last, "book").withColumn("idx", F.when(ok, swapped).otherwise(i).cast(toc.schema["idx"].dataType)).drop("_last")


# Messages about chapters, with title, start and end, of one chapter or two.
WRONG_RANGE = 'Chapter "%s" has an invalid page range (start %d > end %d).'
OVERLAP = 'Chapter overlap detected:\n"%s" (Pages %d-%d)\noverlaps with\n"%s" (Pages %d-%d).\nPlease fix overlapping pages before saving.'


def first_fault(toc: DataFrame) -> DataFrame:
    """(book, idx, other, message) of books whose chapters are at fault: the first chapter, in the order of idx, that ends
    before it begins or shares a page with a later one, and the first such one.

    A chapter shares pages with some other if the greatest end before it, in the order of starts, reaches its start, or
    the next start lies before its end; the least idx of all these has only later partners. One that ends before it
    begins counts, for another, as the pages from its end to its start, which the other must hold whole. So a book costs
    two sorts of its chapters, 65,535 at most. Nulls in start or end leave a chapter out; a book without faults has no row.
    """
    there = toc.where(F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("idx").isNotNull()).select("book", "idx", "title", "start", "end")
    wrong = F.col("start") > F.col("end")
    by_start = Window.partitionBy("book").orderBy("start", "idx")
    marked = there.withColumn("wrong", wrong)
    good = marked.where(~F.col("wrong"))
    reached = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("start")
    crossed = F.lead("start").over(by_start) <= F.col("end")
    overlapping = good.withColumn("hit", F.coalesce(reached, F.lit(False)) | F.coalesce(crossed, F.lit(False))).where("hit").select("book", "idx")
    # from the last low end on: the least high end of wrong chapters that begin no earlier
    low = F.when(F.col("wrong"), F.col("end")).otherwise(F.col("start"))
    from_low = Window.partitionBy("book").orderBy(F.desc("low"), F.desc("wrong")).rowsBetween(Window.unboundedPreceding, 0)
    least = F.min(F.when(F.col("wrong"), F.col("start"))).over(from_low)
    holding = marked.withColumn("low", low).withColumn("least", least).where(F.col("wrong") | (F.col("least") <= F.col("end"))).select("book", "idx", "wrong")
    # one that holds a wrong chapter counts only if that one is later; wrong ones count by themselves, so the first of all does
    first = overlapping.unionByName(holding.select("book", "idx")).groupBy("book").agg(F.min("idx").alias("idx"))
    a = first.join(there, ["book", "idx"]).select("book", "idx", *[F.col(c).alias(f"a_{c}") for c in ("title", "start", "end")])
    later = a.join(there.select("book", F.col("idx").alias("j"), *[F.col(c).alias(f"b_{c}") for c in ("title", "start", "end")]), "book")
    partner = later.where((F.col("j") > F.col("idx")) & (F.col("a_start") <= F.col("a_end")) & (F.col("a_start") <= F.col("b_end")) & (F.col("a_end") >= F.col("b_start")))
    b = partner.groupBy("book").agg(F.min_by(F.struct("j", "b_title", "b_start", "b_end"), "j").alias("b"))
    title = lambda c: F.coalesce(c, F.lit(""))
    both = F.format_string(OVERLAP, title(F.col("a_title")), F.col("a_start").cast("long"), F.col("a_end").cast("long"), title(F.col("b.b_title")), F.col("b.b_start").cast("long"), F.col("b.b_end").cast("long"))
    alone = F.format_string(WRONG_RANGE, title(F.col("a_title")), F.col("a_start").cast("long"), F.col("a_end").cast("long"))
    return a.join(b, "book", "left").select("book", "idx", F.col("b.j").alias("other"), F.when(F.col("a_start") > F.col("a_end"), alone).otherwise(both).alias("message"))


def outline_toc(items: DataFrame, names: DataFrame, page_refs: DataFrame, totals: DataFrame) -> DataFrame:
    """(book, idx, title, start, end) of nested outlines, flattened depth first.

    items has book, id, parent (null at the top), place (among its siblings), title, and where it leads: name, a named
    destination, or ref, a page reference, or neither; names has book, name, ref; page_refs has book, ref, page_no; totals
    has book, page_count. Items that lead nowhere are left out, but not those below them. A chapter ends before the
    next one begins, the last at the book's end. Levels are walked by a recursive relation, of any depth up to 1,000;
    items that no way from the top reaches are left out.
    """
    spark = items.sparkSession
    # a relation may have any number of rows
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "1000")
    rows = items.select("book", "id", "parent", F.struct(F.col("place").cast("long"), F.col("id").cast("string")).alias("step"), "title", "name", "ref")
    walked = spark.sql(
        """WITH RECURSIVE walk(book, id, title, name, ref, way) AS (
          SELECT book, id, title, name, ref, array(step) FROM {rows} WHERE parent IS NULL
          UNION ALL SELECT r.book, r.id, r.title, r.name, r.ref, concat(w.way, array(r.step)) FROM walk w JOIN {rows} r ON r.book = w.book AND r.parent = w.id)
        SELECT * FROM walk""",
        rows=rows,
    )
    named = names.groupBy("book", "name").agg(F.min("ref").alias("named"))
    found = walked.join(named, ["book", "name"], "left").withColumn("ref", F.when(F.col("name").isNotNull(), F.col("named")).otherwise(F.col("ref")))
    placed = found.join(page_refs.groupBy("book", "ref").agg(F.min("page_no").alias("start")), ["book", "ref"]).join(totals.select("book", "page_count"), "book")
    w = Window.partitionBy("book").orderBy("way")
    return placed.select("book", F.row_number().over(w).alias("idx"), "title", "start", F.coalesce(F.lead("start").over(w) - 1, F.col("page_count")).cast("long").alias("end"))


# -- edits of books and page orders


# The languages of the editor.
LANGUAGES = ["en", "zh-CN", "zh-TW", "jp", "ko", "es", "fr", "de", "it", "ru", "pt"]


def edit_meta(meta: DataFrame, edits: DataFrame, now: int) -> DataFrame:
    """Books with edits (book, field, value) applied, the last of a field by its seq; create_time becomes now where any is.

    Fields are title, author, publisher, language (of LANGUAGES, or empty) and cover (a page from 0, or none). Others, and
    languages and covers that aren't any, change nothing, nor do edits of unknown books.
    """
    known = F.col("field").isin("title", "author", "publisher") | ((F.col("field") == "language") & (F.col("value").isin(LANGUAGES) | (F.col("value") == ""))) | ((F.col("field") == "cover") & F.col("value").rlike("^([0-9]{1,5}|none)$"))
    last = edits.where(known).groupBy("book").pivot("field", ["title", "author", "publisher", "language", "cover"]).agg(F.max_by("value", "seq"))
    last = last.select("book", *[F.col(c).alias(f"new_{c}") for c in ("title", "author", "publisher", "language", "cover")], F.lit(True).alias("edited"))
    out = meta.join(last, "book", "left")
    texts = {c: F.coalesce(f"new_{c}", F.col(c) if c in meta.columns else F.lit(None).cast("string")) for c in ("title", "author", "publisher", "language")}
    old = F.col("cover") if "cover" in meta.columns else F.lit(None).cast("int")
    cover = F.when(F.col("new_cover") == "none", 0xFFFF).when(F.col("new_cover").isNotNull(), F.col("new_cover").cast("int")).otherwise(old)
    time = F.when(F.col("edited"), F.lit(now)).otherwise(F.col("create_time") if "create_time" in meta.columns else F.lit(None)).cast("long")
    return out.withColumns({**texts, "cover": cover.cast("int"), "create_time": time}).drop("edited", *[f"new_{c}" for c in ("title", "author", "publisher", "language", "cover")])


def part_meta(meta: DataFrame, parts: DataFrame, name: Column) -> DataFrame:
    """Metadata of a split's parts: the title, or else the name without its ending, with the part's number, and the author.
    parts has book and part (from 1)."""
    base = F.regexp_replace(name, r"\.[^/.]+$", "")
    title = F.concat(F.when(F.coalesce(F.col("title"), F.lit("")) == "", base).otherwise(F.col("title")), F.lit(" - Part "), F.col("part").cast("string"))
    return parts.join(meta.select("book", "title", "author"), "book", "left").select("book", "part", title.alias("title"), F.coalesce("author", F.lit("")).alias("author"))


def move_pages(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """Pages with one of each book moved to another place, those between closing up: moves has book, source and target, a
    row a book; places outside of a book change nothing."""
    last = pages.groupBy("book").agg(F.max("page_no").alias("_last"))
    out = pages.join(moves.select("book", "source", "target"), "book", "left").join(last, "book")
    n, a, b = F.col("page_no"), F.col("source"), F.col("target")
    ok = a.between(1, F.col("_last")) & b.between(1, F.col("_last"))
    moved = F.when(n == a, b).when((n > a) & (n <= b), n - 1).when((n < a) & (n >= b), n + 1).otherwise(n)
    return out.withColumn("page_no", F.when(F.coalesce(ok, F.lit(False)), moved).otherwise(n).cast(pages.schema["page_no"].dataType)).drop("source", "target", "_last")


# -- containers


META = "title string, author string, publisher string, language string, create_time long, cover int, two_bit boolean"


def container_chunks(pages: DataFrame, two_bit: bool = False, meta: DataFrame | None = None, toc: DataFrame | None = None, fixed: bool = False) -> DataFrame:
    """(book, seq, offset, chunk): a book's container as chunks in order, header with index first, then each page.

    pages has book, page_no, page_blob; meta a row a book with any columns of META (two_bit counts before the argument);
    toc has book, idx, title, start, end. No row holds more than a head (16 bytes a page, 96 a chapter, 65,535 of each at
    most) or a page, so a sink that appends chunks by seq streams a book of any size. Books of more pages or chapters end
    the query. Books without pages have no container; a null blob is an empty page. fixed is the command-line variant, whose
    head has title and author, but never chapters.
    """
    blob = F.coalesce("page_blob", F.lit(b""))
    sized = pages.select("book", "page_no", blob.alias("page_blob"), F.length(blob).cast("long").alias("size"))
    heads = container_heads(sized, two_bit, meta, toc, fixed)
    placed = manifest(sized)
    if meta is not None or toc is not None or fixed:
        placed = placed.join(heads.select("book", "more"), "book").withColumn("offset", F.col("offset") + F.col("more"))
    top = heads.select("book", F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("offset"), "chunk")
    return top.unionByName(placed.select("book", F.col("page_no").cast("long").alias("seq"), "offset", F.col("page_blob").alias("chunk")))


def container_heads(sized: DataFrame, two_bit: bool, meta: DataFrame | None, toc: DataFrame | None, fixed: bool) -> DataFrame:
    """(book, chunk, more): heads of books, and how many bytes they have besides a plain header and the index."""
    index = sized.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("page_no", "size", F.substring("page_blob", 5, 4).alias("shape")))).alias("entries"))
    names = [x.split()[0] for x in META.split(", ")]
    known = [c for c in names if meta is not None and c in meta.columns]
    fields = F.struct(*[(F.col(c) if c in known else F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in META.split(", "))]).alias("meta")
    index = index.join(meta.select("book", fields), "book", "left") if meta is not None else index.withColumn("meta", F.lit(None).cast(f"struct<{META.replace(' ', ': ')}>".replace(",:", ",")))
    if toc is not None:
        index = index.join(toc.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("idx", "title", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias("toc")), "book", "left")
    else:
        index = index.withColumn("toc", F.lit(None).cast("array<struct<idx: int, title: string, start: int, end: int>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                entries, m, chapters = (b.column(k)[i].as_py() for k in (1, 2, 3))
                m, sizes = m or {}, [(e["size"], (e["shape"] or b"").ljust(4, b"\0")) for e in entries]
                deep = two_bit if m.get("two_bit") is None else m["two_bit"]
                made = container.fixed_head(sizes, deep, (m.get("title"), m.get("author"))) if fixed else container.head(
                    sizes, deep,
                    tuple(m.get(c) for c in names[:4]), [(c["title"], c["start"], c["end"]) for c in chapters or []], m.get("create_time") or 0, 0xFFFF if m.get("cover") is None else m["cover"],
                )
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([made], pa.binary()), pa.array([len(made) - 48 - 16 * len(entries)])], names=["book", "chunk", "more"])

    kind = sized.schema["book"].dataType.simpleString()
    return index.select("book", "entries", "meta", "toc").mapInArrow(run, f"book {kind}, chunk binary, more long")


def write_containers(pages: DataFrame, path: str, two_bit: bool = False, meta: DataFrame | None = None, toc: DataFrame | None = None, fixed: bool = False) -> None:
    """Writes a container file a book, named by the book with .xtc or .xtch, below a folder that all tasks can reach.

    Heads come first and pages stream behind them; files appear whole when the job commits. pages is read twice, once for
    sizes.
    """
    blob = F.coalesce("page_blob", F.lit(b""))
    sized = pages.select("book", F.col("page_no").cast("long").alias("page_no"), blob.alias("page_blob"), F.length(blob).cast("long").alias("size"))
    heads = container_heads(sized, two_bit, meta, toc, fixed).select("book", F.lit(0).cast("long").alias("seq"), "chunk")
    chunks = heads.unionByName(sized.select("book", F.col("page_no").alias("seq"), F.col("page_blob").alias("chunk")))
    deep = F.lit(two_bit)
    if meta is not None and "two_bit" in meta.columns:
        chunks = chunks.join(meta.select("book", F.col("two_bit").alias("_deep")), "book", "left")
        deep = F.coalesce("_deep", deep)
    write_chunks(chunks.select(F.concat(F.col("book").cast("string"), F.lit("."), N.container_extension(deep)).alias("name"), "seq", "chunk"), path)


def stream_containers(pages: DataFrame, path: str, checkpoint: str, two_bit: bool = False) -> StreamingQuery:
    """Starts a stream that writes the books of each batch; a book's pages must come in one batch. pages is a stream of book,
    page_no, page_blob. A batch that is repeated after a failure replaces its own files."""

    def batch(df: DataFrame, n: int) -> None:
        write_containers(df, path, two_bit)

    return pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).start()
