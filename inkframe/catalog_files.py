"""More queries of the catalog: kinds and names of files, chapters from book metadata, pages read back from their bytes."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import ORACLE, PIXELS, SIZES, query, read, sizes
from .catalog_books import encoded
from .functions import geometry as G
from .functions import names as N
from .operators import books, dither, paging
from .sources import archive, comicinfo, container
from .streaming import strip

# -- names

ENDINGS = [".pdf", ".PNG", ".webp", ".mov", ".xtg", ".cbr", ".cbz", ".zip", "pdf", ".gif.txt", ".XTCH", ".mkv"]


@query("SELECT p_partkey, (['pdf', 'image', 'image', 'video', 'xtc', 'comic', 'comic', NULL, NULL, NULL, 'xtc', 'video'])[p_partkey % 12 + 1] AS kind FROM part")
def sc2_input_kind(spark, sf_dir):
    ending = F.element_at(F.array(*[F.lit(x) for x in ENDINGS]), (F.col("p_partkey") % 12 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", N.input_kind(F.concat("p_name", ending)).alias("kind"))


@query("""SELECT p_partkey, p_name || '_part' || p_size || '.' || ext AS part, 'merged.' || ext AS merged, p_name || '_edited.' || ext AS edited
FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'xtch' ELSE 'xtc' END AS ext FROM part)""")
def sk11_part_names(spark, sf_dir):
    name, two_bit = F.concat("p_name", F.lit(".cbz")), F.col("p_partkey") % 2 == 0
    ext = N.container_extension(two_bit)
    return read(spark, sf_dir, "part").select("p_partkey", N.part_name(name, F.col("p_size"), ext).alias("part"), N.merged_name(ext).alias("merged"), N.edited_name(name, two_bit).alias("edited"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'cbz' WHEN 1 THEN 'pdf' WHEN 2 THEN CASE WHEN n_chars % 2 = 0 THEN 'cbz' ELSE 'xtc' END END AS output FROM documents""")
def se5_merge_output(spark, sf_dir):
    name = F.concat(F.lit("f"), F.element_at(F.array(*[F.lit(x) for x in (".cbz", ".PDF", ".xtch", ".zip")]), (F.col("doc_id") % 4 + 1).cast("int")))
    wanted = F.when(F.col("n_chars") % 2 == 0, "cbz").otherwise("xtc")
    return read(spark, sf_dir, "documents").select("doc_id", books.merge_output(N.file_type(name), wanted).alias("output"))


# -- folders, metadata and chapters


@query("""SELECT book, folder, min(page_no) AS first FROM (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_no,
CASE WHEN doc_id % 5 <> 0 THEN lang END AS folder FROM documents) WHERE folder IS NOT NULL GROUP BY book, folder""")
def ag11_first_of_folder(spark, sf_dir):
    i = F.col("doc_id")
    path = F.concat(F.when(i % 5 != 0, F.concat(F.lit("top/"), F.col("lang"), F.lit("/"))).otherwise(""), i.cast("string"), F.lit(".png"))
    pages = paging.number_pages(read(spark, sf_dir, "documents").select(F.col("source").alias("book"), "doc_id", path.alias("path")), "book", "doc_id")
    return books.first_of_folders(pages).select("book", "folder", F.col("first").cast("long").alias("first"))


@query("""SELECT book, min(entry) AS entry FROM (SELECT source || '/' || lang AS book, doc_id AS entry FROM documents WHERE doc_id % 7 IN (0, 1)) GROUP BY book""")
def sc12_find_info(spark, sf_dir):
    i = F.col("doc_id") % 7
    path = F.when(i == 0, "ComicInfo.xml").when(i == 1, "in/COMICINFO.XML").when(i == 2, "xComicInfo.xml").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".png")))
    entries = read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("book"), F.col("doc_id").alias("entry"), path.alias("path"))
    return comicinfo.find(entries, "book", "path", "entry").select("book", "entry")


@query("""SELECT p_partkey, 'Mark ' || i AS title, CAST(i AS BIGINT) AS start, CAST(coalesce(lead(i) OVER (PARTITION BY p_partkey ORDER BY i) - 1, p_size) AS BIGINT) AS "end"
FROM (SELECT p_partkey, p_size, unnest(range(1, p_size + 1)) AS i FROM part) WHERE i % 4 = 1""")
def tc1_bookmark_chapters(spark, sf_dir):
    page = lambda i: F.when(i % 4 == 1, F.concat(F.lit('<Page Bookmark=" Mark '), i.cast("string"), F.lit('"/>'))).otherwise(F.when(i % 4 == 2, '<Page Bookmark=""/>').otherwise("<Page/>"))
    pages = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size")), page), "")
    xml = F.concat(F.lit("<ComicInfo><Title>t</Title><Pages>"), pages, F.lit("</Pages></ComicInfo>"))
    made = read(spark, sf_dir, "part").select("p_partkey", "p_size", comicinfo.parse(xml).alias("info"))
    # a book's marks come from its own row
    marks = comicinfo.bookmarks(made, "p_partkey", "info").withColumnRenamed("page_no", "start").withColumn("idx", F.col("start"))
    chapters = paging.toc_ends(marks.join(made.select("p_partkey", "p_size"), "p_partkey"), "p_partkey", "p_size")
    return chapters.select("p_partkey", "title", F.col("start").cast("long").alias("start"), "end")


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 90 ELSE 0 END AS page_turn, CASE WHEN p_partkey % 2 = 0 AND w >= h THEN 90 ELSE 0 END AS frame_turn FROM ({SIZES})")
def ge10_turns(spark, sf_dir):
    way = F.when(F.col("p_partkey") % 2 == 0, "landscape").otherwise("portrait")
    return sizes(spark, sf_dir).select("p_partkey", G.orientation_angle(way).alias("page_turn"), G.frame_angle(way, F.col("w"), F.col("h")).alias("frame_turn"))


# -- pages read back


@query(f"SELECT label AS book, arg_min(blob, e.vec_id) AS blob FROM ({ORACLE['px10_encoded_page']}) b JOIN embeddings e ON b.vec_id = e.vec_id GROUP BY label")
def sk8_first_pages(spark, sf_dir):
    return books.first_pages(encoded(spark, sf_dir)).select("book", F.lower(F.hex("page_blob")).alias("blob"))


@query("SELECT label AS book, max(vec_id) AS vec_id, count(*) AS page_no FROM embeddings GROUP BY label")
def so4_last_pages(spark, sf_dir):
    return strip.last_page(encoded(spark, sf_dir), "book").select("book", "vec_id", F.col("page_no").cast("long").alias("page_no"))


@query("SELECT label AS book, CAST(count(*) AS INTEGER) AS page_count FROM embeddings GROUP BY label")
def sc10_page_counts(spark, sf_dir):
    heads = books.container_chunks(encoded(spark, sf_dir)).where("seq = 0")
    return heads.select("book", container.page_count(F.col("chunk")).alias("page_count"))


def damaged(spark, sf_dir) -> DataFrame:
    """Encoded pages of which every fifth lacks its end."""
    blob = F.when(F.col("vec_id") % 5 == 0, F.substring("page_blob", 1, 25)).otherwise(F.col("page_blob"))
    return encoded(spark, sf_dir).withColumn("page_blob", blob)


@query(f"""SELECT vec_id, CASE WHEN vec_id % 5 <> 0 THEN 8 END AS width, CASE WHEN vec_id % 5 <> 0 THEN 8 END AS height, CASE WHEN vec_id % 5 <> 0 THEN string_agg(CASE WHEN g >= 128 THEN 'ff' ELSE '00' END, '' ORDER BY y, x) END AS gray, vec_id % 5 = 0 AS failed
FROM ({PIXELS}) GROUP BY vec_id""")
def sc11_decode_pages(spark, sf_dir):
    return dither.decode_pages(damaged(spark, sf_dir)).select("vec_id", "width", "height", F.lower(F.hex("gray")).alias("gray"), F.col("error").isNotNull().alias("failed"))


# a PNG's signature and header chunk for gray pages of 8 x 8
_IHDR = b"IHDR" + struct.pack(">IIBBBBB", 8, 8, 8, 0, 0, 0, 0)
_FRONT = (b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + _IHDR + struct.pack(">I", zlib.crc32(_IHDR))).hex()


@query(f"""SELECT book, lpad(CAST(page_no AS VARCHAR), 5, '0') || '.png' AS name, CASE WHEN vec_id % 5 <> 0 THEN '{_FRONT}' END AS front
FROM (SELECT label AS book, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS page_no FROM embeddings)""")
def se4_archive_entries(spark, sf_dir):
    return books.archive_entries(damaged(spark, sf_dir)).select("book", "name", F.lower(F.hex(F.substring("png", 1, 33))).alias("front"))


# -- chapters at fault, outlines, edits, orders


CHAPTERS = """SELECT conv_id AS book, turn AS idx, role AS title, turn * 3 + length(text) % 3 AS s, turn * 3 + CASE WHEN conv_id % 3 = 0 AND length(text) % 7 = 0 THEN -4 ELSE 0 END + length(text) % 4 AS e FROM conversations"""


def chapter_rows(spark, sf_dir) -> DataFrame:
    n, t = F.length("text"), F.col("turn")
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), t.alias("idx"), F.col("role").alias("title"), (t * 3 + n % 3).alias("start"), (t * 3 + F.when((F.col("conv_id") % 3 == 0) & (n % 7 == 0), -4).otherwise(0) + n % 4).alias("end"))


@query(f"""WITH c AS ({CHAPTERS}), f AS (SELECT a.book, a.idx, a.title, a.s, a.e, CASE WHEN a.s <= a.e THEN (SELECT min(b.idx) FROM c b WHERE b.book = a.book AND b.idx > a.idx AND a.s <= b.e AND a.e >= b.s) END AS other FROM c a),
g AS (SELECT * FROM f WHERE s > e OR other IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book ORDER BY idx) = 1)
SELECT g.book, g.idx, other, CASE WHEN g.s > g.e THEN 'Chapter "' || g.title || '" has an invalid page range (start ' || g.s || ' > end ' || g.e || ').'
ELSE 'Chapter overlap detected:' || chr(10) || '"' || g.title || '" (Pages ' || g.s || '-' || g.e || ')' || chr(10) || 'overlaps with' || chr(10) || '"' || o.title || '" (Pages ' || o.s || '-' || o.e || ').' || chr(10) || 'Please fix overlapping pages before saving.' END AS message
FROM g LEFT JOIN c o ON o.book = g.book AND o.idx = g.other""")
def tc8_first_fault(spark, sf_dir):
    return books.first_fault(chapter_rows(spark, sf_dir))


@query("""WITH RECURSIVE i AS (SELECT conv_id AS book, turn AS id, CASE WHEN turn > 1 THEN turn // 2 END AS parent, role || turn AS title, CASE turn % 4 WHEN 0 THEN 'd' || turn % 8 END AS name, CASE turn % 4 WHEN 1 THEN turn * 10 WHEN 2 THEN turn * 10 END AS ref FROM conversations WHERE turn > 0),
refs AS (SELECT conv_id AS book, turn * 10 AS ref, turn + 1 AS page_no FROM conversations), n AS (SELECT DISTINCT book, 'd0' AS name, 10 AS ref FROM i), total AS (SELECT conv_id AS book, count(*) AS page_count FROM conversations GROUP BY conv_id),
w(book, id, title, name, ref, way) AS (SELECT book, id, title, name, ref, lpad(CAST(id AS VARCHAR), 9, '0') FROM i WHERE parent IS NULL UNION ALL SELECT i.book, i.id, i.title, i.name, i.ref, way || '/' || lpad(CAST(i.id AS VARCHAR), 9, '0') FROM w JOIN i ON i.book = w.book AND i.parent = w.id),
p AS (SELECT w.book, title, page_no AS start, way FROM w LEFT JOIN n ON n.book = w.book AND n.name = w.name JOIN refs r ON r.book = w.book AND r.ref = CASE WHEN w.name IS NULL THEN w.ref ELSE n.ref END)
SELECT p.book, CAST(row_number() OVER (PARTITION BY p.book ORDER BY way) AS INTEGER) AS idx, title, start, CAST(coalesce(lead(start) OVER (PARTITION BY p.book ORDER BY way) - 1, page_count) AS BIGINT) AS "end" FROM p JOIN total t ON t.book = p.book""")
def tc2_outline(spark, sf_dir):
    c, t = read(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "book"), F.col("turn")
    items = c.where("turn > 0").select(
        "book", t.alias("id"), F.when(t > 1, F.floor(t / 2)).alias("parent"), t.alias("place"), F.concat("role", t.cast("string")).alias("title"),
        F.when(t % 4 == 0, F.concat(F.lit("d"), (t % 8).cast("string"))).alias("name"), F.when((t % 4).isin(1, 2), t * 10).alias("ref"),
    )
    names = items.select("book", F.lit("d0").alias("name"), F.lit(10).alias("ref")).distinct()
    refs = c.select("book", (t * 10).alias("ref"), (t + 1).alias("page_no"))
    return books.outline_toc(items, names, refs, c.groupBy("book").agg(F.count("*").alias("page_count")))


EDITS = """SELECT vec_id // 3 AS book, vec_id AS seq, (['title', 'author', 'publisher', 'language', 'cover', 'pages'])[vec_id % 6 + 1] AS field, (['en', 'zh-CN', 'none', '7', 'xx', ''])[vec_id // 2 % 6 + 1] AS value FROM embeddings WHERE vec_id % 11 <> 0"""


@query(f"""WITH e AS ({EDITS}), k AS (SELECT * FROM e WHERE field IN ('title', 'author', 'publisher') OR (field = 'language' AND value IN ('en', 'zh-CN', '')) OR (field = 'cover' AND value IN ('none', '7'))),
l AS (SELECT book, field, arg_max(value, seq) AS value FROM k GROUP BY ALL), b AS (SELECT DISTINCT vec_id // 3 AS book FROM embeddings)
SELECT b.book, coalesce(max(value) FILTER (field = 'title'), 'T' || b.book) AS title, max(value) FILTER (field = 'author') AS author, max(value) FILTER (field = 'publisher') AS publisher, max(value) FILTER (field = 'language') AS language,
CASE max(value) FILTER (field = 'cover') WHEN 'none' THEN 65535 WHEN '7' THEN 7 ELSE 2 END AS cover, CAST(CASE WHEN count(field) > 0 THEN 1700000000 ELSE 5 END AS BIGINT) AS create_time FROM b LEFT JOIN l ON l.book = b.book GROUP BY b.book""")
def tc7_edit_meta(spark, sf_dir):
    i, pick = F.col("vec_id"), lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n + 1).cast("int"))
    e = read(spark, sf_dir, "embeddings")
    edits = e.where("vec_id % 11 <> 0").select(F.floor(i / 3).alias("book"), i.alias("seq"), pick(["title", "author", "publisher", "language", "cover", "pages"], i % 6).alias("field"), pick(["en", "zh-CN", "none", "7", "xx", ""], F.floor(i / 2) % 6).alias("value"))
    meta = e.select(F.floor(i / 3).alias("book")).distinct().select("book", F.concat(F.lit("T"), F.col("book").cast("string")).alias("title"), F.lit(2).alias("cover"), F.lit(5).cast("long").alias("create_time"))
    return books.edit_meta(meta, edits, 1_700_000_000).select("book", "title", "author", "publisher", "language", "cover", "create_time")


@query("""SELECT o_custkey AS book, n AS part, CASE WHEN o_custkey % 2 = 0 THEN 'Book' ELSE 'file.x' END || ' - Part ' || n AS title, CASE WHEN o_custkey % 3 = 0 THEN 'A' ELSE '' END AS author
FROM (SELECT DISTINCT o_custkey, unnest([1, 2, 3]) AS n FROM orders)""")
def tc5_part_meta(spark, sf_dir):
    book = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book")).distinct()
    meta = book.select("book", F.when(F.col("book") % 2 == 0, "Book").alias("title"), F.when(F.col("book") % 3 == 0, "A").alias("author"))
    parts = book.select("book", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("part"))
    return books.part_meta(meta, parts, F.lit("file.x.xtc"))


@query("""WITH p AS (SELECT l_orderkey AS book, l_linenumber AS n, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last, l_orderkey % 5 + 1 AS a, l_orderkey % 3 + 1 AS b FROM lineitem)
SELECT book, n AS was, CASE WHEN a > last OR b > last THEN n WHEN n = a THEN b WHEN n > a AND n <= b THEN n - 1 WHEN n < a AND n >= b THEN n + 1 ELSE n END AS page_no FROM p""")
def so6_move_pages(spark, sf_dir):
    pages = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("page_no"), F.col("l_linenumber").alias("was"))
    moves = pages.select("book").distinct().select("book", (F.col("book") % 5 + 1).alias("source"), (F.col("book") % 3 + 1).alias("target"))
    return books.move_pages(pages, moves).select("book", "was", F.col("page_no").cast("long").alias("page_no"))


@query("""SELECT lang AS book, CASE WHEN doc_id % 2 = 0 THEN 'P' ELSE 'p' END || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INTEGER) AS page_no FROM documents""")
def so1_collated_numbers(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("lang").alias("book"), F.concat(F.when(F.col("doc_id") % 2 == 0, "P").otherwise("p"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"))
    return archive.numbered(d, path="path")
