"""More queries of the catalog: merges, titles, chapters and their edits, page conversion, strips, links and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import PIXELS, POINTS, SIZES, STORE, TOC, px, query, read, results, sizes, toc
from .functions import names as N
from .functions import pixels as P
from .operators import books, dither, paging, raster, store
from .plans import convert
from .sources import feed

# -- the store


@query(f"SELECT id, created_at FROM ({STORE}) WHERE session_id = 7 OR id = 11")
def pf5_lookup(spark, sf_dir):
    s = results(spark, sf_dir)
    return store.by_session(s, 7).unionByName(store.by_id(s, 11).where("session_id <> 7")).select("id", "created_at")


@query(f"SELECT id, session_id, created_at FROM ({STORE}) WHERE expires_at > TIMESTAMP '2024-01-15 00:00:00'")
def so3_newest_first(spark, sf_dir):
    return store.newest_first(store.references(store.live(results(spark, sf_dir), F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")))).select("id", "session_id", "created_at")


@query("SELECT user_id, bool_and(value > 10) AS all_chosen, bool_or(value > 10) AS some_chosen FROM events GROUP BY user_id")
def pf9_selection(spark, sf_dir):
    chosen = F.col("value") > 10
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_and(chosen).alias("all_chosen"), F.bool_or(chosen).alias("some_chosen"))


# -- files, merges and chapters


@query("""WITH f AS (SELECT doc_id // 3 AS set_id, doc_id, ['cbz', 'pdf', 'xtc', 'unknown'][(doc_id // 3 + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) % 4 + 1] AS kind FROM documents),
g AS (SELECT set_id, arg_min(kind, doc_id) AS type, count(DISTINCT kind) AS kinds FROM f GROUP BY set_id)
SELECT set_id, NOT (type = 'unknown' OR kinds > 1) AS valid, type, CASE WHEN type = 'unknown' THEN 'Unsupported file type' WHEN kinds > 1 THEN 'All files must be the same type' END AS error FROM g""")
def pf8_same_type(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".cbz", ".PDF", ".xtch", ".zip")]), ((F.floor(F.col("doc_id") / 3) + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)) % 4 + 1).cast("int"))
    files = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 3).alias("set_id"), F.col("doc_id").alias("file_idx"), F.concat(F.lit("f"), ext).alias("name"))
    return books.same_type(files)


@query("""SELECT p_partkey, CASE WHEN n < 1 THEN 'Must have at least 1 part' WHEN n > p_size THEN printf('Cannot split %d pages into %d parts', p_size, n) END AS error, CASE WHEN n BETWEEN 1 AND p_size THEN n END AS parts
FROM (SELECT p_partkey, p_size, p_partkey % 61 AS n FROM part)""")
def f2_parts_error(spark, sf_dir):
    total, n = F.col("p_size"), (F.col("p_partkey") % 61).cast("int")
    error = N.parts_error(total, n)
    return read(spark, sf_dir, "part").select("p_partkey", error.alias("error"), F.when(error.isNull(), F.size(N.equal_parts(total, n))).alias("parts"))


def merged(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = read(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("file"), "lang", "source", "doc_id")
    files = docs.groupBy("file", F.col("lang").alias("set_id"), F.col("source").alias("file_idx")).agg(F.count("*").alias("page_count")).withColumns({"title": F.col("file_idx"), "author": F.col("file"), "two_bit": F.length("file_idx") % 2 == 0})
    chapters = files.select("file", F.lit(1).cast("long").alias("start"), F.col("page_count").alias("end"))
    return books.merge_books(files, paging.number_pages(docs.select("file", "doc_id"), "file", "doc_id"), chapters)


FILES = "SELECT lang, source, count(*) AS n, coalesce(sum(count(*)) OVER (PARTITION BY lang ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM documents GROUP BY lang, source"


@query("SELECT lang AS set_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) AS page_no FROM documents")
def se3_merge_pages(spark, sf_dir):
    return merged(spark, sf_dir)[1].select("set_id", "doc_id", "page_no")


@query(f'SELECT lang AS set_id, source AS file_idx, CAST(1 + shift AS BIGINT) AS start, CAST(n + shift AS BIGINT) AS "end" FROM ({FILES})')
def se3_merge_toc(spark, sf_dir):
    return merged(spark, sf_dir)[2].select("set_id", "file_idx", "start", "end")


@query("SELECT lang AS set_id, min(source) AS title, lang || '/' || min(source) AS author, length(min(source)) % 2 = 0 AS two_bit, count(*) AS page_count FROM documents GROUP BY lang")
def j7_first_file(spark, sf_dir):
    return merged(spark, sf_dir)[0].select("set_id", "title", "author", "two_bit", "page_count")


@query("""WITH f AS (SELECT doc_id // 200 AS set_id, doc_id AS file_idx, n_chars % 50 AS page_count, 'Vol ' || (doc_id // 40) || CASE WHEN doc_id % 11 = 0 THEN '.cbz' ELSE '' END AS base FROM documents),
g AS (SELECT *, CASE WHEN lag(base) OVER (PARTITION BY set_id ORDER BY file_idx) = base THEN 0 ELSE 1 END AS new FROM f), r AS (SELECT *, sum(new) OVER (PARTITION BY set_id ORDER BY file_idx) AS run FROM g)
SELECT set_id, file_idx, CAST(coalesce(sum(page_count) OVER (PARTITION BY set_id, run ORDER BY file_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS toc_offset FROM r""")
def j11_continued_parts(spark, sf_dir):
    i = F.col("doc_id")
    part = F.when(i % 11 == 0, F.lit(".cbz")).when(i % 4 == 0, F.lit("_part 1.cbz")).otherwise(F.concat(F.lit(" Part"), (i % 4).cast("string"), F.lit(".cbz")))
    files = read(spark, sf_dir, "documents").select(F.floor(i / 200).alias("set_id"), i.alias("file_idx"), (F.col("n_chars") % 50).alias("page_count"), F.concat(F.lit("Vol "), F.floor(i / 40).cast("string"), part).alias("name"))
    base = F.coalesce(F.nullif(N.part_base(F.col("name")), F.lit("")), F.col("name"))
    return books.continued(files, base).select("set_id", "file_idx", "toc_offset")


@query("""SELECT book, page_no, 'Page ' || (page_no + 5) || CASE WHEN doc_id % 10 = 0 THEN ' - Mark ' || doc_id WHEN doc_id % 3 <> 0 THEN ' - ' || lang ELSE '' END AS title
FROM (SELECT source AS book, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_no FROM documents)""")
def tc3_page_toc(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("top/"), F.col("lang"), F.lit("/"))), i, F.lit(".png"))
    pages = paging.number_pages(read(spark, sf_dir, "documents").select(F.col("source").alias("book"), "doc_id", path.alias("path")), "book", "doc_id")
    marks = pages.where("doc_id % 10 = 0").select("book", "page_no", F.concat(F.lit("Mark "), i).alias("title"))
    return books.page_toc(pages, marks, 5)


@query("""WITH p AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_no, CASE WHEN doc_id % 5 <> 0 THEN 'f' || (doc_id % (1 + length(source) % 3)) END AS folder FROM documents),
w AS (SELECT book, count(*) AS pages, count(DISTINCT folder) AS folders, min(page_no) FILTER (folder IS NOT NULL) AS first FROM p GROUP BY book),
h AS (SELECT p.book, folder AS title, min(page_no) AS start, any_value(pages) AS pages FROM p JOIN w ON p.book = w.book WHERE folders > 1 AND folder IS NOT NULL GROUP BY p.book, folder UNION ALL SELECT book, 'Start', 1, pages FROM w WHERE folders > 1 AND first > 1)
SELECT book, title, start, coalesce(lead(start) OVER (PARTITION BY book ORDER BY start) - 1, pages) AS "end" FROM h UNION ALL SELECT p.book, 'Page ' || page_no, page_no, page_no FROM p JOIN w ON p.book = w.book WHERE folders < 2""")
def tc6_folder_chapters(spark, sf_dir):
    i = F.col("doc_id")
    folder = F.concat(F.lit("f"), (i % (1 + F.length("source") % 3)).cast("string"), F.lit("/"))
    path = F.concat(F.when(i % 5 != 0, folder).otherwise(""), i.cast("string"), F.lit(".png"))
    pages = paging.number_pages(read(spark, sf_dir, "documents").select(F.col("source").alias("book"), "doc_id", path.alias("path")), "book", "doc_id")
    return books.folder_chapters(pages)


@query(f"""WITH t AS (SELECT book, idx, 'c' || idx AS title, start, start + 2 AS "end", total FROM ({TOC})), n AS (SELECT book, max(idx) AS k, max(total) AS total FROM t GROUP BY book),
a AS (SELECT book, idx, title, start, "end" FROM t UNION ALL SELECT book, k + 1, 'New Chapter', 1, greatest(1, total) FROM n), r AS (SELECT book, CASE WHEN idx > 2 THEN idx - 1 ELSE idx END AS idx, title, start, "end" FROM a WHERE idx <> 2),
c AS (SELECT book, idx, CASE WHEN idx = 1 THEN 'First' ELSE title END AS title, start, "end" FROM r), m AS (SELECT book, max(idx) AS k FROM c GROUP BY book)
SELECT c.book, CASE WHEN k >= 3 AND idx = 3 THEN 2 WHEN k >= 3 AND idx = 2 THEN 3 ELSE idx END AS idx, title, start, "end" FROM c JOIN m ON c.book = m.book""")
def tc7_edit_toc(spark, sf_dir):
    t = toc(spark, sf_dir)
    rows = t.select("book", "idx", F.concat(F.lit("c"), F.col("idx").cast("string")).alias("title"), "start", (F.col("start") + 2).alias("end"))
    added = books.toc_add(rows, t.groupBy("book").agg(F.max("total").alias("page_count")))
    return books.toc_move(books.toc_change(books.toc_remove(added, 2), 1, "title", "First"), 3, -1).select("book", "idx", "title", "start", "end")


@query("SELECT lang || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path FROM documents")
def so1_path_order(spark, sf_dir):
    return paging.in_path_order(read(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path")), "path")


# -- pixels and conversions


def rgb(spark, sf_dir) -> DataFrame:
    """8 x 8 rasters of three bytes a pixel."""
    g = lambda e: P.gray_of(e)
    triple = lambda e: F.concat(*[F.lpad(F.hex(v), 2, "0") for v in (g(e), 255 - g(e), g(e) * 7 % 256)])
    data = F.unhex(F.array_join(F.transform("embedding", triple), ""))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), data.alias("data"))


def grays(spark, sf_dir) -> DataFrame:
    return dither.rasters_of(read(spark, sf_dir, "embeddings")).select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("gray").alias("data"))


RGB = f"SELECT vec_id, x, y, g AS r, 255 - g AS gg, g * 7 % 256 AS b FROM ({PIXELS})"
LUMA = "CAST(floor(r * 0.299::DOUBLE + gg * 0.587::DOUBLE + b * 0.114::DOUBLE + 0.5::DOUBLE) AS INTEGER)"
STRETCHED = ", ".join(f"CAST(CASE WHEN white > black THEN greatest(0, least(255, trunc((255 - {c} - black) * 255::DOUBLE / (white - black)))) ELSE 255 - {c} END AS INTEGER) AS {c}" for c in ("r", "gg", "b"))


@query(f"""WITH p AS ({RGB}), h AS (SELECT vec_id, {LUMA} AS l, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT vec_id, l, sum(n) OVER (PARTITION BY vec_id ORDER BY l) AS below, sum(n) OVER (PARTITION BY vec_id ORDER BY l DESC) AS above FROM h),
e AS (SELECT vec_id, coalesce(min(l) FILTER (below >= 64 * 12 / 100.0), 0) AS black, coalesce(max(l) FILTER (above >= 64 * 39 / 100.0), 255) AS white FROM c GROUP BY vec_id),
s AS (SELECT p.vec_id, x, y, {STRETCHED} FROM p JOIN e ON p.vec_id = e.vec_id)
SELECT vec_id, string_agg(printf('%02x', CAST(floor(pow(((77 * r + 150 * gg + 29 * b) >> 8) / 255.0::DOUBLE, 2.0) * 255 + 0.5) AS INTEGER)), '' ORDER BY y, x) AS gray FROM s GROUP BY vec_id""")
def px1_unified(spark, sf_dir):
    return raster.toned(rgb(spark, sf_dir), ["vec_id"], contrast=4, gamma=2.0, invert=True).select("vec_id", F.lower(F.hex("gray")).alias("gray"))


@query(f"SELECT vec_id, string_agg(printf('%02x', CAST(trunc(255::REAL - least(1::REAL, greatest(0::REAL, 0.5::REAL + (((77 * r + 150 * gg + 29 * b) >> 8)::REAL / 255::REAL - 0.5::REAL) * 2::REAL)) * 255::REAL) AS INTEGER)), '' ORDER BY y, x) AS gray FROM ({RGB}) GROUP BY vec_id")
def px6_table(spark, sf_dir):
    return raster.toned(rgb(spark, sf_dir), ["vec_id"], contrast=4, invert=True, table=True).select("vec_id", F.lower(F.hex("gray")).alias("gray"))


@query(f"SELECT p.vec_id, x, y, CAST(round_even(g * 0.299::DOUBLE + (255 - g) * 0.587::DOUBLE + (g * 7 % 256) * 0.114::DOUBLE, 0) AS INTEGER) AS luma, CAST(CASE WHEN white > black THEN round_even(greatest(0, least(255, (g - black) / (white - black)::DOUBLE * 255)), 0) ELSE g END AS INTEGER) AS contrast FROM ({PIXELS}) p JOIN ({POINTS}) c ON p.vec_id = c.vec_id")
def px3_contrast_alone(spark, sf_dir):
    p, g = P.stretched(read(spark, sf_dir, "embeddings"), 4), F.col("g")
    return p.select("vec_id", "x", "y", P.float_luma(g, 255 - g, g * 7 % 256).alias("luma"), P.contrast_alone(g, F.col("black"), F.col("white")).alias("contrast"))


@query(f"""WITH c AS (SELECT dx, dy FROM (SELECT unnest(range(0, 3)) AS dx), (SELECT unnest(range(0, 5)) AS dy)),
m AS (SELECT vec_id, dx, dy, CAST(floor(avg(g)) AS INTEGER) AS g FROM ({PIXELS}) JOIN c ON x >= floor(dx * 8 / 3.0) AND x < ceil((dx + 1) * 8 / 3.0) AND y >= floor(dy * 8 / 5.0) AND y < ceil((dy + 1) * 8 / 5.0) GROUP BY ALL)
SELECT vec_id, string_agg(printf('%02x', g), '' ORDER BY dy, dx) AS gray FROM m GROUP BY vec_id""")
def ag7_box_windows(spark, sf_dir):
    return raster.resized(grays(spark, sf_dir), ["vec_id"], (3, 5)).select("vec_id", F.lower(F.hex("gray")).alias("gray"))


def _blob(w: int, h: int, payload: str) -> str:
    """SQL of an encoded 1-bit page's hex; the payload must have at most 8 bytes."""
    n = (w + 7) // 8 * h
    head = "58544700" + w.to_bytes(2, "little").hex() + h.to_bytes(2, "little").hex() + "0000" + n.to_bytes(4, "little").hex()
    return f"'{head}' || {payload} || '{'00' * (8 - n)}' || {payload}"


@query(f"""WITH m AS (SELECT vec_id, x // 2 AS x, y // 2 AS y, floor(avg(g)) AS g FROM ({PIXELS}) GROUP BY ALL), r AS (SELECT vec_id, y, sum(CASE WHEN g >= 128 THEN 1 << (7 - x) ELSE 0 END) AS byte FROM m GROUP BY ALL),
p AS (SELECT vec_id, 'f0' || string_agg(printf('%02x', CAST(byte AS INTEGER)), '' ORDER BY y) || 'f0' AS payload FROM r GROUP BY vec_id)
SELECT vec_id, 0 AS out_idx, 'portrait' AS kind, {_blob(4, 6, "payload")} AS blob FROM p""")
def ge8_convert_padded(spark, sf_dir):
    return pages_of(spark, sf_dir, size=(4, 6), portrait=True, dithering="none")


TURNED = f"""WITH c AS (SELECT vec_id, x - 1 AS x, y - 1 AS y, CASE WHEN g > 16 * ([0,8,2,10,12,4,14,6,3,11,1,9,15,7,13,5])[(CASE WHEN k = 0 THEN x - 1 ELSE y - 1 END) % 4 * 4 + (CASE WHEN k = 0 THEN 6 - y ELSE x - 1 END) % 4 + 1] THEN 1 ELSE 0 END AS bit, k FROM ({PIXELS}), (SELECT unnest([0, 1]) AS k) WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6),
t AS (SELECT vec_id, k, CASE WHEN k = 0 THEN 5 - y ELSE x END AS x, CASE WHEN k = 0 THEN x ELSE y END AS y, bit FROM c),
r AS (SELECT vec_id, k, y, sum(bit << (7 - x)) AS byte FROM t GROUP BY ALL), p AS (SELECT vec_id, k, string_agg(printf('%02x', CAST(byte AS INTEGER)), '' ORDER BY y) AS payload FROM r GROUP BY vec_id, k)"""


@query(f"{TURNED} SELECT vec_id, CAST(k AS INTEGER) AS out_idx, CASE WHEN k = 0 THEN 'sideways' ELSE 'portrait' END AS kind, {_blob(6, 6, 'payload')} AS blob FROM p")
def ge8_convert_cropped(spark, sf_dir):
    return pages_of(spark, sf_dir, size=(6, 6), horizontal=12.5, vertical=12.5, sideways=True, portrait=True, dithering="ordered")


GAMMA2 = "CAST(floor(pow(g / 255.0::DOUBLE, 2.0) * 255 + 0.5) AS INTEGER)"
CODE = f"(CASE WHEN {GAMMA2} >= 212 THEN 0 WHEN {GAMMA2} >= 127 THEN 1 WHEN {GAMMA2} >= 42 THEN 2 ELSE 3 END)"


@query(f"""WITH r AS (SELECT vec_id, y, printf('%02x', CAST(sum(CASE WHEN g >= 128 THEN 1 << (7 - x) ELSE 0 END) AS INTEGER)) AS byte FROM ({PIXELS}) GROUP BY ALL),
p AS (SELECT vec_id, string_agg(byte, '' ORDER BY y) AS payload FROM r GROUP BY vec_id)
SELECT vec_id, 0 AS out_idx, 'portrait' AS kind, {_blob(8, 8, "payload")} AS blob FROM p""")
def px5_gamma_one_bit(spark, sf_dir):
    return pages_of(spark, sf_dir, size=(8, 8), portrait=True, dithering="none", gamma=2.0)


@query(f"""WITH c AS (SELECT vec_id, 7 - x AS col, CAST(sum(({CODE} >> 1) << (7 - y)) AS INTEGER) AS one, CAST(sum(({CODE} & 1) << (7 - y)) AS INTEGER) AS two FROM ({PIXELS}) GROUP BY ALL),
p AS (SELECT vec_id, string_agg(printf('%02x', two), '' ORDER BY col) || string_agg(printf('%02x', one), '' ORDER BY col) AS payload, string_agg(printf('%02x', xor(one, two)), '' ORDER BY col) AS digest FROM c GROUP BY vec_id)
SELECT vec_id, 0 AS out_idx, 'portrait' AS kind, '585448000800080000' || '0010000000' || digest || payload AS blob FROM p""")
def px5_gamma_two_bit(spark, sf_dir):
    return pages_of(spark, sf_dir, size=(8, 8), portrait=True, dithering="none", gamma=2.0, two_bit=True)


@query(f"""WITH r AS (SELECT vec_id, y + 2 AS y, printf('%04x', CAST(sum(CASE WHEN g >= 128 THEN 1 << (15 - 3 - x) ELSE 0 END) AS INTEGER)) AS line FROM ({PIXELS}) GROUP BY ALL),
p AS (SELECT vec_id, '00000000' || string_agg(line, '' ORDER BY y) || '00000000' AS payload FROM r GROUP BY vec_id)
SELECT vec_id, 0 AS out_idx, 'single' AS kind, '58544700' || '0e000c00' || '0000' || '18000000' || payload[1:16] || payload AS blob FROM p""")
def ge6_crop_larger_page(spark, sf_dir):
    return pages_of(spark, sf_dir, size=(14, 12), split="nosplit", single="crop", dithering="none")


@query(f"""WITH r AS (SELECT vec_id, y, printf('%02x', CAST(sum(CASE WHEN g >= 128 THEN 1 << (7 - (x - 1)) ELSE 0 END) AS INTEGER)) AS byte FROM ({PIXELS}) WHERE x BETWEEN 1 AND 6 GROUP BY ALL),
p AS (SELECT vec_id, '00' || string_agg(byte, '' ORDER BY y) || '00' AS payload FROM r GROUP BY vec_id)
SELECT vec_id, 0 AS out_idx, 'single' AS kind, '58544700' || '06000a00' || '0000' || '0a000000' || payload[1:16] || payload AS blob FROM p""")
def ge6_crop_narrow_page(spark, sf_dir):
    return pages_of(spark, sf_dir, size=(6, 10), split="nosplit", single="crop", dithering="none", pad_black=False)


def pages_of(spark, sf_dir, **options) -> DataFrame:
    return raster.convert(grays(spark, sf_dir), ["vec_id"], **options).select("vec_id", "out_idx", "kind", F.lower(F.hex("page_blob")).alias("blob"))


@query(f"""WITH s AS (SELECT p_partkey, CAST(floor(h * (480.0::DOUBLE / w)) AS INTEGER) AS high FROM ({SIZES})), k AS (SELECT p_partkey, high, unnest(range(0, greatest(0, (high - 800) // 400) + 1)) * 400 AS top FROM s)
SELECT p_partkey, top FROM k UNION ALL SELECT p_partkey, high - 800 FROM (SELECT p_partkey, high, max(top) AS t FROM k GROUP BY ALL) WHERE high > 800 AND t + 800 < high""")
def ge9_strip_slices(spark, sf_dir):
    from .functions.geometry import strip_slices

    return sizes(spark, sf_dir).select("p_partkey", F.explode(strip_slices(F.col("w"), F.col("h"), 480, 800, 50)).alias("s")).select("p_partkey", F.col("s.top").alias("top"))


@query(f"""SELECT p_partkey, out_idx, kind, turn, fw, fh, CAST(floor((480 - fw) / 2.0) AS INTEGER) AS fx, CAST(floor((800 - fh) / 2.0) AS INTEGER) AS fy FROM (SELECT p_partkey, 0 AS out_idx, 'single' AS kind, 90 AS turn,
CAST(floor(h * greatest(480.0::DOUBLE / h, 800.0::DOUBLE / w)) AS INTEGER) AS fw, CAST(floor(w * greatest(480.0::DOUBLE / h, 800.0::DOUBLE / w)) AS INTEGER) AS fh FROM ({SIZES}))""")
def ge8_single_image(spark, sf_dir):
    return convert.page_plan(sizes(spark, sf_dir), split="nosplit", single="cover", landscape=True).select("p_partkey", "out_idx", "kind", "turn", "fw", "fh", "fx", "fy")


def encoded(spark, sf_dir) -> DataFrame:
    pages = dither.encode_pages(grays(spark, sf_dir).withColumnRenamed("data", "gray"), "none").join(read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("book")), "vec_id")
    return paging.number_pages(pages.select("book", "vec_id", "page_blob"), "book", "vec_id")


@query("""WITH p AS (SELECT label AS book, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS seq, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT book, seq, 48 + 16 * n + 30 * (seq - 1) AS "offset", 30 AS bytes FROM p UNION ALL SELECT book, 0, 0, 48 + 16 * n FROM (SELECT DISTINCT book, n FROM p)""")
def sk5_container_chunks(spark, sf_dir):
    return books.container_chunks(encoded(spark, sf_dir)).select("book", "seq", "offset", F.length("chunk").alias("bytes"))


SHRUNK = ", ".join(f"CAST(255 - CASE WHEN white > black THEN round_even(greatest(0, least(255, ({c} - black) / (white - black)::DOUBLE * 255)), 0) ELSE {c} END AS INTEGER) AS {c}" for c in ("r", "gg", "b"))
STITCHED = f"""WITH RECURSIVE p AS ({RGB}), h AS (SELECT vec_id, {LUMA} AS l, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT vec_id, l, sum(n) OVER (PARTITION BY vec_id ORDER BY l) AS below, sum(n) OVER (PARTITION BY vec_id ORDER BY l DESC) AS above FROM h),
e AS (SELECT vec_id, coalesce(min(l) FILTER (below >= 64 * 12 / 100.0), 0) AS black, coalesce(max(l) FILTER (above >= 64 * 39 / 100.0), 255) AS white FROM c GROUP BY vec_id),
s AS (SELECT p.vec_id, x, y, {SHRUNK} FROM p JOIN e ON p.vec_id = e.vec_id),
g AS (SELECT vec_id, x, y, CAST(round_even(0.299::DOUBLE * r + 0.587::DOUBLE * gg + 0.114::DOUBLE * b, 0) AS INTEGER) AS g FROM s),
k AS (SELECT vec_id, label AS book, 8 * (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) AS top FROM embeddings),
rows_ AS (SELECT book, top + y AS y, sum(g) AS s1, sum(g * g) AS s2, printf('%02x', CAST(sum(CASE WHEN g >= 128 THEN 1 << (7 - x) ELSE 0 END) AS INTEGER)) AS byte FROM g JOIN k ON g.vec_id = k.vec_id GROUP BY ALL),
tops AS (SELECT book, y AS top, count(*) OVER w AS high, (sum(s2) OVER w) / 96.0::DOUBLE - pow((sum(s1) OVER w) / 96.0::DOUBLE, 2) < 25 AS solid FROM rows_ WINDOW w AS (PARTITION BY book ORDER BY y ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
walk(book, n, top) AS (SELECT DISTINCT book, 0, CAST(0 AS BIGINT) FROM k UNION ALL SELECT w.book, n + 1, w.top + CASE WHEN solid THEN 12 ELSE 9 END FROM walk w JOIN tops t ON w.book = t.book AND w.top = t.top AND high = 12),
cut AS (SELECT w.book, n, w.top, high = 12 AND solid AS solid FROM walk w JOIN tops t ON w.book = t.book AND w.top = t.top),
paged AS (SELECT c.book, n, any_value(solid) AS solid, rpad(string_agg(byte, '' ORDER BY y), 24, 'f') AS payload FROM cut c JOIN rows_ r ON c.book = r.book AND r.y >= c.top AND r.y < c.top + 12 GROUP BY c.book, n)
SELECT book, CAST(n AS INTEGER) AS slice_no, solid, '5854470008000c0000000c000000' || payload[1:16] || payload AS blob FROM paged"""
STITCH = {"size": (8, 12), "overlap": 25, "contrast": 4, "invert": True, "gamma": 2.0}


def strip_pages(spark, sf_dir) -> DataFrame:
    pages = rgb(spark, sf_dir).join(read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("book")), "vec_id")
    return paging.number_pages(pages, "book", "vec_id").drop("vec_id")


@query(STITCHED)
def st1_stitch(spark, sf_dir):
    return raster.stitch(strip_pages(spark, sf_dir), **STITCH).select("book", "slice_no", "solid", F.lower(F.hex("page_blob")).alias("blob"))


# -- links and feeds


def links(spark, sf_dir) -> DataFrame:
    i = F.col("event_id").cast("string")
    tail = F.when(F.col("event_id") % 3 == 0, F.lit("&tr=wss%3A%2F%2Ft.example%2Fannounce")).otherwise("")
    return read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 != 9, F.concat(F.lit("magnet:?xt=urn:btih:"), F.upper(F.md5(i.cast("binary"))), F.lit("&dn=a"), tail)).otherwise("none").alias("magnet"))


@query("""SELECT event_id, CASE WHEN event_id % 10 <> 9 THEN md5(CAST(event_id AS VARCHAR)) END AS hash,
CASE WHEN event_id % 10 <> 9 THEN 'magnet:?xt=urn:btih:' || upper(md5(CAST(event_id AS VARCHAR))) || '&dn=a' ELSE 'none' END || '&tr=wss%3A%2F%2Ft.example%2Fannounce' AS link FROM events""")
def f10_magnets(spark, sf_dir):
    m = F.col("magnet")
    return links(spark, sf_dir).select("event_id", N.info_hash(m).alias("hash"), N.with_trackers(m, ["wss://t.example/announce"]).alias("link"))


@query("SELECT event_id FROM events WHERE event_id % 10 <> 9 AND event_id % 4 <> 0")
def j8_new_links(spark, sf_dir):
    found = links(spark, sf_dir).withColumn("hash", N.info_hash(F.col("magnet"))).where(F.col("hash").isNotNull())
    known = read(spark, sf_dir, "events").where("event_id % 4 = 0").select(F.md5(F.col("event_id").cast("string").cast("binary")).alias("hash"))
    return feed.unknown(found, known).select("event_id")


@query("SELECT event_id, CASE WHEN event_id % 10 <> 9 AND event_id % 4 = 0 THEN event_type END AS state FROM events")
def j9_active_links(spark, sf_dir):
    found = links(spark, sf_dir).withColumn("hash", N.info_hash(F.col("magnet")))
    active = read(spark, sf_dir, "events").where("event_id % 4 = 0").select(F.md5(F.col("event_id").cast("string").cast("binary")).alias("hash"), F.col("event_type").alias("state"))
    return feed.looked_up(found, active).select("event_id", "state")


@query("""SELECT p_partkey, n AS item, p_brand || ' ' || n AS title, p_size || ' MiB' AS size, CASE WHEN n = 1 THEN p_size ELSE 0 END AS seeders, CASE WHEN n = 1 THEN 'magnet:?xt=urn:btih:' || md5(CAST(p_partkey AS VARCHAR)) ELSE '' END AS magnet
FROM (SELECT *, unnest([1, 2]) AS n FROM part)""")
def sc14_feed_items(spark, sf_dir):
    c = lambda x: F.col(x).cast("string")
    first = F.concat(F.lit("<item><title>"), c("p_brand"), F.lit(" 1</title><size>"), c("p_size"), F.lit(" MiB</size><seeders>"), c("p_size"), F.lit("</seeders><infoHash>"), F.md5(c("p_partkey").cast("binary")), F.lit("</infoHash></item>"))
    second = F.concat(F.lit("<item><title>"), c("p_brand"), F.lit(" 2</title><size>"), c("p_size"), F.lit(" MiB</size></item>"))
    xml = F.concat(F.lit("<rss><channel><title>x</title>"), first, second, F.lit("</channel></rss>"))
    items = feed.items(read(spark, sf_dir, "part").select("p_partkey", xml.alias("xml")), "xml")
    return items.select("p_partkey", "item", "title", "size", "seeders", "magnet")
