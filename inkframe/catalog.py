"""Queries over the driver's tables, one for each operator, with SQL that gives the same rows.

documents are pages of books (a source is a book), conversations are tables of contents, embeddings are 8 x 8 rasters,
parts and line items have page sizes, pages have names, and events are stored results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dither_sql
from .functions import geometry as G
from .functions import names as N
from .functions import pixels as P
from .operators import dither, paging, store
from .plans import convert
from .streaming import strip

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("book"), "doc_id", (F.col("n_chars") + 22).alias("size"))
    return paging.number_pages(docs, "book", "doc_id")


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", (200 + F.col("p_size") * 40).alias("w"), (300 + (F.col("p_partkey") * 37) % 1500).cast("int").alias("h"))


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pixels(read(spark, sf_dir, "embeddings"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stored(read(spark, sf_dir, "events"))


BOOKS = "SELECT source AS book, doc_id, n_chars + 22 AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_no FROM documents"
SIZES = "SELECT p_partkey, 200 + p_size * 40 AS w, CAST(300 + (p_partkey * 37) % 1500 AS INTEGER) AS h FROM part"
PIXELS = "SELECT vec_id, CAST((i - 1) % 8 AS INTEGER) AS x, CAST((i - 1) // 8 AS INTEGER) AS y, greatest(0, least(255, CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS INTEGER))) AS g FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)"
STORE = "SELECT event_id AS id, user_id AS session_id, event_type AS kind, value, ts AS created_at, ts + INTERVAL 270 MINUTE AS expires_at FROM events"
TOC = "SELECT conv_id AS book, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS idx, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) * 3 - 2 AS start, count(*) OVER (PARTITION BY conv_id) * 3 AS total FROM conversations"


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id")
    n = F.row_number().over(w.orderBy("turn", "role", "text"))
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), n.cast("long").alias("idx"), (n * 3 - 2).cast("long").alias("start"), (F.count("*").over(w) * 3).alias("total"))


# -- containers and pages of books


@query(f"SELECT book, page_no, size, CAST(48 + 16 * count(*) OVER (PARTITION BY book) + coalesce(sum(size) OVER (PARTITION BY book ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM ({BOOKS})")
def sk3_manifest(spark, sf_dir):
    return paging.manifest(book_pages(spark, sf_dir)).select("book", "page_no", "size", "offset")


@query(f"SELECT book, count(*) AS pages, CAST(sum(size) AS BIGINT) AS bytes, CAST(48 + 16 * count(*) + sum(size) AS BIGINT) AS container_bytes FROM ({BOOKS}) GROUP BY book")
def ag4_container_totals(spark, sf_dir):
    b = book_pages(spark, sf_dir).groupBy("book").agg(F.count("*").alias("pages"), F.sum("size").alias("bytes"))
    return b.withColumn("container_bytes", 48 + 16 * F.col("pages") + F.col("bytes"))


@query(f"SELECT p_partkey, CAST(22 + ((w + 7) // 8) * h AS BIGINT) AS one_bit, CAST(22 + 2 * ((h + 7) // 8) * w AS BIGINT) AS two_bit FROM ({SIZES})")
def sk4_page_size(spark, sf_dir):
    w, h = F.col("w"), F.col("h")
    return sizes(spark, sf_dir).select("p_partkey", G.page_size(w, h).alias("one_bit"), G.page_size(w, h, True).alias("two_bit"))


@query(f"SELECT book, CAST(ceil(page_no / 10.0) AS BIGINT) AS sheet, count(*) AS pages, min(doc_id) AS first_doc FROM ({BOOKS}) GROUP BY ALL")
def so6_paginate(spark, sf_dir):
    return book_pages(spark, sf_dir).groupBy("book", F.ceil(F.col("page_no") / 10.0).alias("sheet")).agg(F.count("*").alias("pages"), F.min("doc_id").alias("first_doc"))


@query(f"SELECT book, page_no, doc_id FROM ({BOOKS}) WHERE page_no <= 10")
def so5_previews(spark, sf_dir):
    return book_pages(spark, sf_dir).where("page_no <= 10").select("book", "page_no", "doc_id")


@query(f"SELECT book, page_no, 1 + size % 3 AS n_out, CAST(coalesce(sum(1 + size % 3) OVER (PARTITION BY book ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS out_start FROM ({BOOKS})")
def ag5_output_mapping(spark, sf_dir):
    return paging.output_mapping(book_pages(spark, sf_dir).withColumn("n_out", 1 + F.col("size") % 3)).select("book", "page_no", "n_out", "out_start")


@query(f"SELECT book, idx, start, CAST(coalesce(lead(start) OVER (PARTITION BY book ORDER BY idx) - 1, total) AS BIGINT) AS \"end\" FROM ({TOC})")
def j2_toc_ends(spark, sf_dir):
    return paging.toc_ends(toc(spark, sf_dir), "book", "total").select("book", "idx", "start", "end")


@query(f"""WITH t AS ({TOC}), m AS (SELECT book, p AS page_no, CAST(coalesce(sum(1 + p % 2) OVER (PARTITION BY book ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS out_start
FROM (SELECT DISTINCT book, unnest(range(1, total + 1)) AS p FROM t) WHERE p % 5 <> 0)
SELECT t.book, idx, coalesce(out_start, start) AS start FROM t LEFT JOIN m ON t.book = m.book AND t.start = m.page_no""")
def j1_remap_toc(spark, sf_dir):
    t = toc(spark, sf_dir)
    pages = t.select("book", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total"))).alias("page_no")).distinct().where("page_no % 5 <> 0")
    return paging.remap_toc(t, paging.output_mapping(pages.withColumn("n_out", 1 + F.col("page_no") % 2))).select("book", "idx", "start")


RANGES = f"SELECT book, r.part, r.part * 20 - 25 AS range_start, r.part * 20 + 5 AS range_end FROM (SELECT DISTINCT book FROM ({BOOKS})), (SELECT unnest([1, 2, 3]) AS part) r"


def ranges(books: DataFrame) -> DataFrame:
    part = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("part")
    return books.select("book").distinct().select("book", part).withColumns({"range_start": F.col("part") * 20 - 25, "range_end": F.col("part") * 20 + 5})


@query(f"SELECT p.book, part, page_no, CAST(page_no - range_start + 1 AS BIGINT) AS part_page FROM ({BOOKS}) p JOIN ({RANGES}) r ON p.book = r.book AND page_no BETWEEN range_start AND range_end")
def j4_split_pages(spark, sf_dir):
    b = book_pages(spark, sf_dir)
    r = ranges(b).withColumnsRenamed({"range_start": "start", "range_end": "end"})
    return paging.split_by_ranges(b, r, "book").select("book", "part", "page_no", F.col("part_page").cast("long").alias("part_page"))


@query(f"""WITH t AS (SELECT book, idx, start, coalesce(lead(start) OVER (PARTITION BY book ORDER BY idx) - 1, total) AS e FROM ({TOC})), r AS (SELECT DISTINCT book, 4 AS s, 9 AS f FROM t)
SELECT t.book, idx, CAST(greatest(start, s) - s + 1 AS BIGINT) AS part_start, CAST(least(e, f) - s + 1 AS BIGINT) AS part_end FROM t JOIN r ON t.book = r.book AND greatest(start, s) <= least(e, f)""")
def j3_clip_toc(spark, sf_dir):
    t = paging.toc_ends(toc(spark, sf_dir), "book", "total")
    r = t.select("book", F.lit(4).alias("range_start"), F.lit(9).alias("range_end")).distinct()
    return paging.clip_toc(t, r, "book").select("book", "idx", F.col("part_start").cast("long").alias("part_start"), F.col("part_end").cast("long").alias("part_end"))


@query("""WITH c AS (SELECT conv_id, turn AS idx, turn * 2 + length(text) % 3 AS s, turn * 2 + length(text) % 5 AS e FROM conversations)
SELECT a.conv_id, min(a.idx) AS first_idx, CAST(count(*) AS BIGINT) AS overlaps FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.idx < b.idx AND a.s <= b.e AND a.e >= b.s GROUP BY a.conv_id""")
def j5_overlapping_chapters(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), (F.col("turn") * 2 + F.length("text") % 3).alias("s"), (F.col("turn") * 2 + F.length("text") % 5).alias("e"))
    a, b = c.alias("a"), c.alias("b")
    hit = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.idx") < F.col("b.idx")) & (F.col("a.s") <= F.col("b.e")) & (F.col("a.e") >= F.col("b.s")))
    return hit.groupBy("a.conv_id").agg(F.min("a.idx").alias("first_idx"), F.count("*").alias("overlaps"))


@query("""SELECT o_custkey, o_orderkey, CAST(sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS island FROM
(SELECT o_custkey, o_orderkey, CASE WHEN lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IS NOT DISTINCT FROM o_orderstatus THEN 0 ELSE 1 END AS new FROM orders)""")
def j11_islands(spark, sf_dir):
    return paging.islands(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderstatus").select("o_custkey", "o_orderkey", "island")


@query(f"SELECT book, lang, pages, CAST(coalesce(sum(pages) OVER (PARTITION BY book ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM (SELECT source AS book, lang, count(*) AS pages FROM documents GROUP BY ALL)")
def se3_merge_shift(spark, sf_dir):
    files = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("set_id"), "lang").agg(F.count("*").alias("page_count"))
    return paging.merge_offsets(files, "lang").select(F.col("set_id").alias("book"), "lang", F.col("page_count").alias("pages"), "shift")


@query("SELECT lang, source, doc_id, lpad(CAST(row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) AS VARCHAR), 5, '0') || '.png' AS name FROM documents")
def se1_merge_names(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("lang").alias("set_id"), "source", "doc_id", F.concat_ws("/", "lang", "source").alias("file"))
    files = docs.groupBy("set_id", "source", "file").agg(F.count("*").alias("page_count"))
    shifts = paging.merge_offsets(files, "source").select("file", "shift")
    placed = paging.number_pages(docs, "file", "doc_id").join(shifts, "file")
    n = (F.col("page_no") + F.col("shift")).cast("string")
    name = F.concat(F.when(F.length(n) < 5, F.lpad(n, 5, "0")).otherwise(F.substring(n, 1, 5)), F.lit(".png"))
    return placed.select(F.col("set_id").alias("lang"), "source", "doc_id", name.alias("name"))


@query(f"SELECT source AS book, min(doc_id) AS first_doc, count(DISTINCT lang) = 1 AS same_type, CAST(sum(n_chars) AS BIGINT) > 4294967296 AS too_large FROM documents GROUP BY source")
def pf8_validate(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.col("source").alias("book")).agg(F.min("doc_id").alias("first_doc"), (F.count_distinct("lang") == 1).alias("same_type"), (F.sum("n_chars") > 4294967296).alias("too_large"))


# -- names and ranges


@query("""SELECT page_id, lower(regexp_extract(url, '[^.]*$')) AS ext, CASE WHEN lower(regexp_extract(url, '[^.]*$')) = 'cbz' THEN 'cbz' WHEN lower(regexp_extract(url, '[^.]*$')) = 'cbr' THEN 'cbr' WHEN lower(regexp_extract(url, '[^.]*$')) = 'pdf' THEN 'pdf' WHEN lower(regexp_extract(url, '[^.]*$')) IN ('xtc', 'xtch') THEN 'xtc' ELSE 'unknown' END AS kind,
regexp_matches(url, '(?i)\\.(jpg|jpeg|png|webp|bmp|gif)$') AND NOT starts_with(lower(url), '__macos') AS is_image FROM pages""")
def sc1_file_type(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", N.extension(u).alias("ext"), N.file_type(u).alias("kind"), N.is_page_image(u).alias("is_image"))


@query("SELECT page_id, regexp_replace(url, '\\.[^/.]+$', '.xtc') AS name, CASE WHEN len(string_split(url, '/')) > 1 THEN string_split(url, '/')[-2] END AS folder FROM pages")
def sk11_output_name(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", N.output_name(F.col("url"), ".xtc").alias("name"), N.folder_title(F.col("url")).alias("folder"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN CAST(n_chars AS VARCHAR) || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n_chars / 1048576.0 * 10 + 0.5) / 10) END AS size FROM documents")
def f3_format_size(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", N.format_size(F.col("n_chars")).alias("size"))


@query("""SELECT p_partkey, i AS part, i * (total // n) + least(i, total % n) + 1 AS start, (i + 1) * (total // n) + least(i + 1, total % n) AS "end" FROM
(SELECT p_partkey, total, n, unnest(range(0, n)) AS i FROM (SELECT p_partkey, CAST(10 + p_size AS BIGINT) AS total, 1 + p_size % 7 AS n FROM part))""")
def f2_equal_parts(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", (10 + F.col("p_size")).alias("total"), (1 + F.col("p_size") % 7).alias("n"))
    return p.select("p_partkey", F.posexplode(N.equal_parts(F.col("total"), F.col("n"))).alias("part", "r")).select("p_partkey", F.col("part").cast("long").alias("part"), F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("end"))


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS pos, s AS start, e AS "end", s IS NULL OR e IS NULL OR s < 1 OR e > p_size OR s > e AS error FROM (
SELECT p_partkey, p_size, i, TRY_CAST(nullif(regexp_extract(split_part(p, '-', 1), '^\\s*([+-]?\\d+)', 1), '') AS INTEGER) AS s, TRY_CAST(nullif(regexp_extract(CASE WHEN p LIKE '%-%' THEN split_part(p, '-', 2) ELSE p END, '^\\s*([+-]?\\d+)', 1), '') AS INTEGER) AS e FROM (
SELECT p_partkey, p_size, unnest(['1-3', CAST(p_size % 9 AS VARCHAR) || 'x', CAST(p_size AS VARCHAR) || ' - 20 - 3', '-5']) AS p, unnest([1, 2, 3, 4]) AS i FROM part))""")
def f1_page_ranges(spark, sf_dir):
    text = F.concat(F.lit(" 1-3,, "), (F.col("p_size") % 9).cast("string"), F.lit("x , "), F.col("p_size").cast("string"), F.lit(" - 20 - 3,-5"))
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", F.posexplode(N.page_ranges(text, F.col("p_size"))).alias("pos", "r")).select("p_partkey", F.col("pos").cast("long").alias("pos"), "r.start", "r.end", F.col("r.error").alias("error"))


# -- geometry


@query(f"SELECT p_partkey, x, y, greatest(1, w - 2 * x) AS cw, greatest(1, h - 2 * y) AS ch FROM (SELECT *, least(CAST(floor(w * 5.0 / 100) AS INTEGER), CAST(floor((w - 1) / 2.0) AS INTEGER)) AS x, least(CAST(floor(h * 2.5 / 100) AS INTEGER), CAST(floor((h - 1) / 2.0) AS INTEGER)) AS y FROM ({SIZES}))")
def ge1_crop(spark, sf_dir):
    c = sizes(spark, sf_dir).withColumn("c", G.crop_rect(F.col("w"), F.col("h"), F.lit(5.0), F.lit(2.5)))
    return c.select("p_partkey", "c.x", "c.y", F.col("c.w").alias("cw"), F.col("c.h").alias("ch"))


@query(f"SELECT p_partkey, CASE WHEN w < h THEN 3 ELSE 1 END AS overlap_pages, 1 + CASE WHEN w < h THEN 2 ELSE 1 END AS half_pages FROM ({SIZES})")
def ge2_output_count(spark, sf_dir):
    w, h = F.col("w"), F.col("h")
    return sizes(spark, sf_dir).select("p_partkey", G.output_page_count(w, h).alias("overlap_pages"), G.output_page_count(w, h, upright=True, split="half").alias("half_pages"))


@query(f"""WITH s AS (SELECT *, CAST(floor(480 / (800.0::DOUBLE / w)) AS INTEGER) AS seg FROM ({SIZES})),
k AS (SELECT s.*, n, CAST(floor(seg - (seg * n - h)::DOUBLE / (n - 1)) AS INTEGER) AS shift FROM s, (SELECT unnest(range(3, 11)) AS n)),
c AS (SELECT p_partkey, min(n) FILTER (n = 10 OR NOT shift::DOUBLE / seg > 0.95) AS n FROM k GROUP BY p_partkey)
SELECT k.p_partkey, CAST(i AS INTEGER) AS i, CAST(shift * i AS INTEGER) AS y, CAST(CASE WHEN i = k.n - 1 THEN h - shift * i ELSE seg END AS INTEGER) AS h FROM k JOIN c ON k.p_partkey = c.p_partkey AND k.n = c.n, (SELECT unnest(range(0, 10)) AS i) WHERE i < k.n""")
def ge3_overlap_segments(spark, sf_dir):
    s = sizes(spark, sf_dir).select("p_partkey", F.posexplode(G.overlap_segments(F.col("w"), F.col("h"), 480, 800)).alias("i", "s"))
    return s.select("p_partkey", "i", "s.y", "s.h")


@query(f"""SELECT p_partkey, mode, CAST(floor((480 - nw) / 2.0) AS INTEGER) AS x, CAST(floor((800 - nh) / 2.0) AS INTEGER) AS y, nw AS fw, nh AS fh FROM (
SELECT p_partkey, mode, CAST(floor(w * scale) AS INTEGER) AS nw, CAST(floor(h * scale) AS INTEGER) AS nh FROM (
SELECT *, CASE mode WHEN 'pad' THEN least(480.0::DOUBLE / w, 800.0::DOUBLE / h) WHEN 'cover' THEN greatest(480.0::DOUBLE / w, 800.0::DOUBLE / h) ELSE 1.0::DOUBLE END AS scale FROM ({SIZES}), (SELECT unnest(['pad', 'cover', 'crop']) AS mode)))""")
def ge5_fit(spark, sf_dir):
    s, w, h = sizes(spark, sf_dir), F.col("w"), F.col("h")
    fits = F.array(*[F.struct(F.lit(m).alias("mode"), G.fit_rect(w, h, 480, 800, m).alias("r")) for m in ("pad", "cover", "crop")])
    return s.select("p_partkey", F.explode(fits).alias("f")).select("p_partkey", "f.mode", "f.r.x", "f.r.y", F.col("f.r.w").alias("fw"), F.col("f.r.h").alias("fh"))


@query(f"""SELECT p_partkey, 0 AS i, CASE WHEN w > h THEN 0 ELSE 0 END AS x, CASE WHEN w > h THEN least(w // 2 + 40, w) ELSE w END AS pw FROM ({SIZES}) UNION ALL SELECT p_partkey, 1, greatest(0, w // 2 - 40), w - greatest(0, w // 2 - 40) FROM ({SIZES}) WHERE w > h""")
def ge12_wide_halves(spark, sf_dir):
    s = sizes(spark, sf_dir).select("p_partkey", F.posexplode(G.wide_halves(F.col("w"), F.col("h"))).alias("i", "r"))
    return s.select("p_partkey", "i", "r.x", F.col("r.w").alias("pw"))


@query(f"""WITH s AS ({SIZES}), p AS (SELECT p_partkey, 0 AS out_idx, 'upright' AS kind, 0 AS y, w, h, 0 AS turn FROM s
UNION ALL SELECT p_partkey, 1, 'segment', 0, w, h // 2, 90 FROM s WHERE w < h UNION ALL SELECT p_partkey, 2, 'segment', h // 2, w, h - h // 2, 90 FROM s WHERE w < h
UNION ALL SELECT p_partkey, 1, 'whole', 0, w, h, 90 FROM s WHERE w >= h)
SELECT p_partkey, out_idx, kind, y, h AS sh, turn, CAST(floor(CASE turn WHEN 90 THEN h ELSE w END * least(480.0::DOUBLE / CASE turn WHEN 90 THEN h ELSE w END, 800.0::DOUBLE / CASE turn WHEN 90 THEN w ELSE h END)) AS INTEGER) AS fw FROM p""")
def ge8_page_plan(spark, sf_dir):
    return convert.page_plan(sizes(spark, sf_dir), upright=True, split="half").select("p_partkey", "out_idx", "kind", "y", "sh", "turn", "fw")


# -- pixels


@query(f"SELECT vec_id, g, count(*) AS n FROM ({PIXELS}) GROUP BY ALL")
def ag1_histogram(spark, sf_dir):
    return px(spark, sf_dir).groupBy("vec_id", "g").agg(F.count("*").alias("n"))


POINTS = f"""SELECT vec_id, coalesce(min(g) FILTER (below >= total * 12 / 100.0), 0) AS black, coalesce(max(g) FILTER (above >= total * 39 / 100.0), 255) AS white FROM (
SELECT vec_id, g, sum(n) OVER (PARTITION BY vec_id ORDER BY g) AS below, sum(n) OVER (PARTITION BY vec_id ORDER BY g DESC) AS above, sum(n) OVER (PARTITION BY vec_id) AS total FROM (SELECT vec_id, g, count(*) AS n FROM ({PIXELS}) GROUP BY ALL)) GROUP BY vec_id"""


@query(POINTS)
def ag2_contrast_points(spark, sf_dir):
    black, white = P.contrast_points(P.grays_of(F.col("embedding")), 4)
    return read(spark, sf_dir, "embeddings").select("vec_id", black.alias("black"), white.alias("white"))


@query(f"SELECT p.vec_id, x, y, CAST(CASE WHEN white > black THEN greatest(0, least(255, trunc((g - black) * 255::DOUBLE / (white - black)))) ELSE g END AS INTEGER) AS g FROM ({PIXELS}) p JOIN ({POINTS}) c ON p.vec_id = c.vec_id")
def px1_stretch(spark, sf_dir):
    p = P.stretched(read(spark, sf_dir, "embeddings"), 4)
    return p.select("vec_id", "x", "y", P.stretch(F.col("g"), F.col("black"), F.col("white")).alias("g"))


@query(f"SELECT vec_id, round(avg(g), 6) AS mean, round(stddev_pop(g), 6) AS deviation, stddev_pop(g) < 5 AS solid FROM ({PIXELS}) GROUP BY vec_id")
def ag3_solid(spark, sf_dir):
    return px(spark, sf_dir).groupBy("vec_id").agg(F.round(F.avg("g"), 6).alias("mean"), F.round(F.stddev_pop("g"), 6).alias("deviation"), (F.stddev_pop("g") < 5).alias("solid"))


@query(f"SELECT vec_id, x // 4 AS cx, y // 4 AS cy, CAST(floor(avg(g)) AS BIGINT) AS g FROM ({PIXELS}) GROUP BY ALL")
def ag7_box(spark, sf_dir):
    return px(spark, sf_dir).groupBy("vec_id", F.floor(F.col("x") / 4).cast("int").alias("cx"), F.floor(F.col("y") / 4).cast("int").alias("cy")).agg(F.floor(F.avg("g")).alias("g"))


@query(f"SELECT vec_id, x, y, 255 - g AS inverted, CAST(floor(pow(g / 255.0::DOUBLE, 2.0) * 255 + 0.5) AS INTEGER) AS gamma2, CASE WHEN g < 42 THEN 0 WHEN g < 127 THEN 85 WHEN g < 212 THEN 170 ELSE 255 END AS level, CASE WHEN g >= 212 THEN 0 WHEN g >= 127 THEN 1 WHEN g >= 42 THEN 2 ELSE 3 END AS code FROM ({PIXELS})")
def px8_tones(spark, sf_dir):
    g = F.col("g")
    return px(spark, sf_dir).select("vec_id", "x", "y", (255 - g).alias("inverted"), P.gamma(g, 2.0).alias("gamma2"), P.quantize(g, True).alias("level"), P.code2(g).alias("code"))


@query(f"SELECT vec_id, x, y, CASE WHEN g > 16 * ([0,8,2,10,12,4,14,6,3,11,1,9,15,7,13,5])[(y % 4) * 4 + x % 4 + 1] THEN 255 ELSE 0 END AS g FROM ({PIXELS})")
def di8_ordered(spark, sf_dir):
    return px(spark, sf_dir).select("vec_id", "x", "y", P.ordered(F.col("g"), F.col("x"), F.col("y")).alias("g"))


@query(f"SELECT vec_id, y, CAST(sum(CASE WHEN g >= 128 THEN 1 << (7 - x) ELSE 0 END) AS BIGINT) AS byte FROM ({PIXELS}) GROUP BY ALL")
def ag8_pack_rows(spark, sf_dir):
    bit = F.when(F.col("g") >= 128, F.pow(F.lit(2), 7 - F.col("x")).cast("long")).otherwise(0)
    return px(spark, sf_dir).groupBy("vec_id", "y").agg(F.sum(bit).alias("byte"))


@query(f"SELECT vec_id, 7 - x AS col, CAST(sum(((CASE WHEN g >= 212 THEN 0 WHEN g >= 127 THEN 1 WHEN g >= 42 THEN 2 ELSE 3 END) >> 1) << (7 - y)) AS BIGINT) AS plane1, CAST(sum(((CASE WHEN g >= 212 THEN 0 WHEN g >= 127 THEN 1 WHEN g >= 42 THEN 2 ELSE 3 END) & 1) << (7 - y)) AS BIGINT) AS plane0 FROM ({PIXELS}) GROUP BY ALL")
def ag9_pack_planes(spark, sf_dir):
    p = px(spark, sf_dir).withColumn("code", P.code2(F.col("g")))
    place = F.pow(F.lit(2), 7 - F.col("y")).cast("long")
    return p.groupBy("vec_id", (7 - F.col("x")).alias("col")).agg(F.sum(F.shiftright("code", 1) * place).alias("plane1"), F.sum(F.col("code").bitwiseAND(1) * place).alias("plane0"))


@query(f"SELECT vec_id, 7 - y AS x, x AS y, g FROM ({PIXELS})")
def ge7_rotate(spark, sf_dir):
    return px(spark, sf_dir).select("vec_id", (7 - F.col("y")).alias("x"), F.col("x").alias("y"), "g")


@query(f"""SELECT vec_id, lower('58544700' || '08000800' || '0000' || '08000000' || string_agg(hex2, '' ORDER BY y) || string_agg(hex2, '' ORDER BY y)) AS blob FROM (
SELECT vec_id, y, printf('%02x', CAST(sum(CASE WHEN g >= 128 THEN 1 << (7 - x) ELSE 0 END) AS INTEGER)) AS hex2 FROM ({PIXELS}) GROUP BY ALL) GROUP BY vec_id""")
def px10_encoded_page(spark, sf_dir):
    pages = dither.encode_pages(dither.rasters_of(read(spark, sf_dir, "embeddings")), "none")
    return pages.select("vec_id", F.lower(F.hex("page_blob")).alias("blob"))


def _dithered(algorithm: str, two_bit: bool = False):
    def run(spark, sf_dir):
        pages = dither.encode_pages(dither.rasters_of(read(spark, sf_dir, "embeddings")), algorithm, two_bit)
        return pages.select("vec_id", F.lower(F.hex("page_blob")).alias("blob"))

    return run


for _name in dither.ALGORITHMS[1:]:
    QUERIES[f"di_{_name.replace('-', '_')}"] = _dithered(_name)
    QUERIES[f"di_{_name.replace('-', '_')}_2bit"] = _dithered(_name, True)
ORACLE |= dither_sql.all_pages(PIXELS)


# -- result store


NOW = "TIMESTAMP '2024-01-15 00:00:00'"


@query(f"SELECT id, session_id, created_at FROM ({STORE}) WHERE expires_at > {NOW}")
def pf2_live(spark, sf_dir):
    return store.references(store.live(results(spark, sf_dir), F.expr(f"TIMESTAMP_NTZ '2024-01-15 00:00:00'"))).select("id", "session_id", "created_at")


@query(f"SELECT session_id <> 7 AS recovered, count(*) AS n, count(*) FILTER (expires_at <= {NOW}) AS expired FROM ({STORE}) GROUP BY ALL")
def pf6_expired(spark, sf_dir):
    gone = F.col("expires_at") <= F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    return results(spark, sf_dir).groupBy((F.col("session_id") != 7).alias("recovered")).agg(F.count("*").alias("n"), F.count_if(gone).alias("expired"))


@query("SELECT event_id AS id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')")
def pf7_delete(spark, sf_dir):
    s = results(spark, sf_dir)
    return store.without_ids(s, s.where("kind = 'error'").select("id")).select("id")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS errors, count(*) AS total FROM events GROUP BY ALL")
def ag12_daily(spark, sf_dir):
    t = F.col("event_type")
    return read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(t == "view").alias("views"), F.count_if(t == "error").alias("errors"), F.count("*").alias("total"))


@query("""SELECT user_id, event_id, n FROM (SELECT user_id, island, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM (
SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, island)""")
def st7_settled(spark, sf_dir):
    return strip.settled_queries(read(spark, sf_dir, "events"), "1 hour")


# -- strips


@query("""WITH b AS (SELECT source AS book, CAST(sum(n_chars) AS BIGINT) AS height FROM documents GROUP BY source)
SELECT book, count(*) AS slices, max(top) AS last_top FROM (SELECT book, unnest(range(0, greatest(0, (height - 800) // 400 + 1))) * 400 AS top FROM b WHERE height >= 800) GROUP BY book""")
def st1_strip_slices(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page_no"), F.col("n_chars").alias("h"))
    return strip.slices(d, 800, 50).where(F.col("slice_no").isNotNull()).groupBy("book").agg(F.count("*").alias("slices"), F.max("top").alias("last_top"))


@query("SELECT l_orderkey, count(*) AS pages, CAST(sum(22 + ((200 + l_linenumber * 40 + 7) // 8) * (300 + (l_partkey * 37) % 1500)) AS BIGINT) AS bytes, CAST(sum(CASE WHEN 200 + l_linenumber * 40 < 300 + (l_partkey * 37) % 1500 THEN 3 ELSE 1 END) AS BIGINT) AS outputs FROM lineitem GROUP BY l_orderkey")
def bench_order_books(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", (200 + F.col("l_linenumber") * 40).alias("w"), (300 + (F.col("l_partkey") * 37) % 1500).cast("int").alias("h"))
    w, h = F.col("w"), F.col("h")
    return li.groupBy("l_orderkey").agg(F.count("*").alias("pages"), F.sum(G.page_size(w, h)).alias("bytes"), F.sum(G.output_page_count(w, h)).alias("outputs"))


# register their queries here
from . import catalog_books, catalog_files, catalog_io  # noqa: E402, F401
