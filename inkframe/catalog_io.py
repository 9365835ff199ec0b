"""Queries over files that they write from the tables first, and over streams: containers, archives, strips, lifetimes.

Files lie in the folder of spark.checkpoint.dir, which driver and executors share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import PIXELS, query, read
from .catalog_books import STITCH, STITCHED, encoded, grays, strip_pages
from .operators import books, dither, files, paging
from .sources import archive, container, ranged
from .sources.images import decode_images
from .sources.ranged import scratch_path
from .streaming import stateful

# -- containers


def book_name(path: str) -> Column:
    """A file's name without folders and ending."""
    return F.regexp_extract(path, r"([^/]*)\.[^.]*$", 1)


def meta(spark, sf_dir) -> DataFrame:
    """Metadata of books: a label's number is its title."""
    labels = read(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("book")).agg(F.count("*").alias("pages"))
    return labels.where("book % 3 <> 1").select("book", F.concat(F.lit("T\u00e9 "), F.col("book")).alias("title"), F.repeat(F.lit("\u00e4"), 40).alias("author"), F.lit("en").alias("language"), F.lit(1_700_000_000).alias("create_time"), F.when(F.col("book") % 2 == 0, 0).alias("cover"))


def chapters(spark, sf_dir) -> DataFrame:
    """Two chapters for every other label."""
    labels = read(spark, sf_dir, "embeddings").where("label % 2 = 0").groupBy(F.col("label").alias("book")).agg(F.count("*").alias("pages"))
    half = F.ceil(F.col("pages") / 2)
    row = lambda i, title, start, end: F.struct(F.lit(i).alias("idx"), F.lit(title).alias("title"), start.cast("int").alias("start"), end.cast("int").alias("end"))
    both = F.array(row(1, "One", F.lit(1), half), row(2, "Two", half + 1, F.col("pages")))
    return labels.select("book", F.explode(both).alias("c")).select("book", "c.*")


def written(spark, sf_dir) -> str:
    path = scratch_path(spark)
    books.write_containers(encoded(spark, sf_dir), path, meta=meta(spark, sf_dir), toc=chapters(spark, sf_dir))
    return path


NUMBERED = f"""SELECT label AS book, row_number() OVER (PARTITION BY label ORDER BY p.vec_id) AS page_no, lower('58544700' || '08000800' || '0000' || '08000000' || hex8 || hex8) AS blob
FROM (SELECT vec_id, string_agg(hex2, '' ORDER BY y) AS hex8 FROM (SELECT vec_id, y, printf('%02x', CAST(sum(CASE WHEN g >= 128 THEN 1 << (7 - x) ELSE 0 END) AS INTEGER)) AS hex2 FROM ({PIXELS}) GROUP BY ALL) GROUP BY vec_id) p JOIN embeddings e ON p.vec_id = e.vec_id"""


@query(f"SELECT CAST(book AS VARCHAR) AS book, CAST(page_no AS INTEGER) AS page_no, 8 AS width, 8 AS height, blob FROM ({NUMBERED}) WHERE page_no BETWEEN 2 AND 9")
def sc9_container_pages(spark, sf_dir):
    pages = container.containers(spark, written(spark, sf_dir)).where("page_no >= 2 AND page_no < 10")
    return pages.select(book_name("book").alias("book"), "page_no", "width", "height", F.lower(F.hex("page_blob")).alias("blob"))


HEADS = "(SELECT label AS book, count(*) AS n, label % 3 <> 1 AS meta, label % 2 = 0 AS toc FROM embeddings GROUP BY label)"


@query(f"""SELECT CAST(book AS VARCHAR) AS book, CAST(page_no AS INTEGER) AS page_no, CASE WHEN meta OR toc THEN 312 + 96 * CASE WHEN toc THEN 2 ELSE 0 END ELSE 48 END + 16 * n + 30 * (page_no - 1) AS "offset", CAST(30 AS BIGINT) AS bytes
FROM (SELECT *, unnest(range(1, n + 1)) AS page_no FROM {HEADS})""")
def sk1_container_index(spark, sf_dir):
    return container.containers(spark, written(spark, sf_dir), "index").select(book_name("book").alias("book"), "page_no", "offset", "bytes")


@query(f"""SELECT CAST(book AS VARCHAR) AS book, CAST(n AS INTEGER) AS page_count, CASE WHEN meta THEN 'T\u00e9 ' || book WHEN toc THEN '' END AS title, CASE WHEN meta THEN repeat('\u00e4', 31) || chr(65533) WHEN toc THEN '' END AS author,
CASE WHEN meta THEN 1700000000 WHEN toc THEN 0 END AS create_time, CASE WHEN meta AND toc THEN 0 WHEN meta OR toc THEN 65535 END AS cover, CASE WHEN toc THEN 2 ELSE 0 END AS chapters FROM {HEADS}""")
def sc9_container_books(spark, sf_dir):
    found = container.containers(spark, written(spark, sf_dir), "books")
    return found.select(book_name("book").alias("book"), "page_count", "title", "author", "create_time", "cover", "chapters")


@query(f"SELECT CAST(book AS VARCHAR) AS book, idx, CASE idx WHEN 1 THEN 'One' ELSE 'Two' END AS title, CAST(CASE idx WHEN 1 THEN 1 ELSE ceil(n / 2.0) + 1 END AS INTEGER) AS start, CAST(CASE idx WHEN 1 THEN ceil(n / 2.0) ELSE n END AS INTEGER) AS \"end\" FROM (SELECT *, unnest([1, 2]) AS idx FROM {HEADS} WHERE toc)")
def sk1_container_toc(spark, sf_dir):
    return container.containers(spark, written(spark, sf_dir), "toc").select(book_name("book").alias("book"), "idx", "title", "start", "end")


@query("SELECT CAST(label AS VARCHAR) AS book, CAST(count(*) AS INTEGER) AS page_count FROM embeddings GROUP BY label")
def sc10_container_counts(spark, sf_dir):
    return container.containers(spark, written(spark, sf_dir), "counts").select(book_name("book").alias("book"), "page_count")


@query(f"""SELECT CAST(book AS VARCHAR) AS book, CAST(page_no AS INTEGER) AS page_no, 312 + 16 * n + 30 * (page_no - 1) AS "offset", CASE WHEN meta THEN 'T\u00e9 ' || book ELSE '' END AS title, 0 AS cover, 0 AS chapters
FROM (SELECT *, unnest(range(1, n + 1)) AS page_no FROM {HEADS})""")
def sk9_fixed_heads(spark, sf_dir):
    path = scratch_path(spark)
    books.write_containers(encoded(spark, sf_dir), path, meta=meta(spark, sf_dir), toc=chapters(spark, sf_dir), fixed=True)
    index, heads = container.containers(spark, path, "index"), container.containers(spark, path, "books")
    return index.select("book", "page_no", "offset").join(heads.select("book", "title", "cover", "chapters"), "book").withColumn("book", book_name("book"))


SETS = f"""SELECT *, CASE WHEN book % 2 = 0 THEN 'even' ELSE 'odd' END AS name FROM {HEADS}"""


def container_sets(spark, sf_dir, path: str) -> DataFrame:
    """Even and odd labels, in the order of labels."""
    labels = read(spark, sf_dir, "embeddings").select(F.col("label").alias("b")).distinct()
    return labels.select(F.concat(F.lit(path + "/"), F.col("b").cast("string"), F.lit(".xtc")).alias("book"), F.when(F.col("b") % 2 == 0, "even").otherwise("odd").alias("name"), F.col("b").alias("file_idx"))


def merged(spark, sf_dir) -> str:
    path, out = written(spark, sf_dir), scratch_path(spark)
    files.merge_containers(spark, path, container_sets(spark, sf_dir, path), out)
    return out


@query(f"""SELECT CASE WHEN book % 2 = 0 THEN 'even' ELSE 'odd' END AS book, CAST(row_number() OVER (PARTITION BY book % 2 ORDER BY book, page_no) AS INTEGER) AS page_no, blob FROM ({NUMBERED})""")
def se3_merge_containers(spark, sf_dir):
    return container.containers(spark, merged(spark, sf_dir)).select(book_name("book").alias("book"), "page_no", F.lower(F.hex("page_blob")).alias("blob"))


@query(f"""WITH s AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY name ORDER BY book ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS shift FROM ({SETS}))
SELECT name AS book, CAST(row_number() OVER (PARTITION BY name ORDER BY book, idx) AS INTEGER) AS idx, CASE idx WHEN 1 THEN 'One' ELSE 'Two' END AS title, CAST(shift + CASE idx WHEN 1 THEN 1 ELSE ceil(n / 2.0) + 1 END AS INTEGER) AS start, CAST(shift + CASE idx WHEN 1 THEN ceil(n / 2.0) ELSE n END AS INTEGER) AS "end" FROM (SELECT *, unnest([1, 2]) AS idx FROM s WHERE toc)""")
def se3_merge_container_toc(spark, sf_dir):
    return container.containers(spark, merged(spark, sf_dir), "toc").select(book_name("book").alias("book"), "idx", "title", "start", "end")


def split(spark, sf_dir) -> str:
    path, out = written(spark, sf_dir), scratch_path(spark)
    ranges = container_sets(spark, sf_dir, path).select("book", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.lit(a).alias("start"), F.lit(b).alias("end")) for k, a, b in ((1, 1, 12), (2, 9, 20))])).alias("r")).select("book", "r.*")
    files.split_containers(spark, path, ranges, out)
    return out


@query(f"""SELECT book || '_part' || k AS book, CAST(page_no - CASE k WHEN 1 THEN 0 ELSE 8 END AS INTEGER) AS page_no, blob FROM (SELECT *, unnest([1, 2]) AS k FROM ({NUMBERED})) WHERE page_no BETWEEN CASE k WHEN 1 THEN 1 ELSE 9 END AND CASE k WHEN 1 THEN 12 ELSE 20 END""")
def se6_split_containers(spark, sf_dir):
    return container.containers(spark, split(spark, sf_dir)).select(book_name("book").alias("book"), "page_no", F.lower(F.hex("page_blob")).alias("blob"))


@query(f"""SELECT book || '_part' || k AS book, CASE WHEN meta THEN 'T\u00e9 ' || book ELSE CAST(book AS VARCHAR) END || ' - Part ' || k AS title, CASE WHEN meta THEN repeat('\u00e4', 31) || chr(65533) ELSE '' END AS author, CAST(least(n, CASE k WHEN 1 THEN 12 ELSE 20 END) - CASE k WHEN 1 THEN 0 ELSE 8 END AS INTEGER) AS page_count,
CASE WHEN NOT toc THEN 0 ELSE CASE WHEN ceil(n / 2.0) >= CASE k WHEN 1 THEN 1 ELSE 9 END THEN 1 ELSE 0 END + CASE WHEN ceil(n / 2.0) + 1 <= CASE k WHEN 1 THEN 12 ELSE 20 END AND n >= CASE k WHEN 1 THEN 1 ELSE 9 END THEN 1 ELSE 0 END END AS chapters
FROM (SELECT *, unnest([1, 2]) AS k FROM {HEADS}) WHERE n >= CASE k WHEN 1 THEN 1 ELSE 9 END""")
def se6_split_container_heads(spark, sf_dir):
    found = container.containers(spark, split(spark, sf_dir), "books")
    return found.select(book_name("book").alias("book"), "title", "author", "page_count", "chapters")


@query(f"""SELECT CAST(book AS VARCHAR) AS book, lpad(CAST(page_no AS VARCHAR), 5, '0') || '.png' AS entry_path, gray FROM (SELECT label AS book, row_number() OVER (PARTITION BY label ORDER BY p.vec_id) AS page_no, gray FROM (SELECT vec_id, string_agg(CASE WHEN g >= 128 THEN 'FFFFFF' ELSE '000000' END, '' ORDER BY y, x) AS gray FROM ({PIXELS}) GROUP BY vec_id) p JOIN embeddings e ON p.vec_id = e.vec_id)""")
def se4_containers_to_archives(spark, sf_dir):
    out = scratch_path(spark)
    files.containers_to_archives(spark, written(spark, sf_dir), out)
    images = decode_images(archive.archives(spark, out).where("error IS NULL"))
    return images.select(book_name("book").alias("book"), "entry_path", F.hex("data").alias("gray"))


# -- archives: documents are the members, named in mixed case by language


def paths() -> Column:
    lang = F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang"))
    return F.concat(lang, F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".png"))


def documents(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit(".cbz")).alias("name"), "doc_id", paths().alias("entry"), F.coalesce("text", F.lit("")).cast("binary").alias("png"))


def archived(spark, sf_dir) -> str:
    path = scratch_path(spark)
    # packed where they are read and numbered then, so no text passes a shuffle
    packed, drop = ranged.stored(archive.packed_images(documents(spark, sf_dir), squeeze=True).drop("png"))
    ranged.write_chunks(archive.archive_chunks(paging.number_pages(packed, "name", "doc_id")), path)
    drop()
    return path


ENTRIES = "SELECT doc_id, coalesce(source, 'none') AS book, lower(lang) || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS folded, CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.png' AS entry, coalesce(text, '') AS text FROM documents"


@query(f"SELECT book, entry AS entry_path, CAST(row_number() OVER (PARTITION BY book ORDER BY folded) AS INTEGER) AS page_no, md5(text) AS content FROM ({ENTRIES})")
def sc3_archive_entries(spark, sf_dir):
    found = archive.entries(spark, archived(spark, sf_dir))
    return found.select(book_name("book").alias("book"), "entry_path", "page_no", F.md5("content").alias("content"))


def sets(spark, sf_dir, path: str) -> DataFrame:
    """Two sets of the archives written, by the last letter of their names, each in the order of names."""
    names = read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("s")).distinct()
    even = F.ascii(F.substring("s", -1, 1)) % 2 == 0
    # a row a source
    order = F.row_number().over(Window.partitionBy(even).orderBy("s"))
    return names.select(F.concat(F.lit(path + "/"), "s", F.lit(".cbz")).alias("book"), F.when(even, "first.cbz").otherwise("second.cbz").alias("name"), order.alias("file_idx"))


@query(f"""SELECT CASE WHEN ascii(right(book, 1)) % 2 = 0 THEN 'first' ELSE 'second' END AS book, CASE WHEN n < 100000 THEN lpad(CAST(n AS VARCHAR), 5, '0') ELSE CAST(n AS VARCHAR) END || '.png' AS entry_path, md5(text) AS content
FROM (SELECT *, row_number() OVER (PARTITION BY ascii(right(book, 1)) % 2 ORDER BY book, folded) AS n FROM ({ENTRIES}))""")
def se1_merge_archives(spark, sf_dir):
    path, out = archived(spark, sf_dir), scratch_path(spark)
    archive.merge_archives(spark, path, sets(spark, sf_dir, path), out)
    return archive.contents(spark, out).select(book_name("book").alias("book"), "entry_path", F.md5("content").alias("content"))


@query(f"""SELECT book || '_part' || k AS book, lpad(CAST(n - CASE k WHEN 1 THEN 0 ELSE 4 END AS VARCHAR), 5, '0') || '.png' AS entry_path, md5(text) AS content
FROM (SELECT *, unnest([1, 2]) AS k FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY folded) AS n FROM ({ENTRIES}))) WHERE n BETWEEN CASE k WHEN 1 THEN 1 ELSE 5 END AND CASE k WHEN 1 THEN 7 ELSE 9 END""")
def se6_split_archives(spark, sf_dir):
    path, out = archived(spark, sf_dir), scratch_path(spark)
    books_ = sets(spark, sf_dir, path).select("book", F.regexp_extract("book", r"([^/]*)\.cbz$", 1).alias("s"))
    part = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("start"), F.lit(b).alias("end")) for k, a, b in ((1, 1, 7), (2, 5, 9))])).alias("p")
    ranges = books_.select("book", "s", part).select("book", F.concat("s", F.lit("_part"), F.col("p.k").cast("string"), F.lit(".cbz")).alias("name"), "p.start", "p.end")
    archive.split_archives(spark, path, ranges, out)
    return archive.contents(spark, out).select(book_name("book").alias("book"), "entry_path", F.md5("content").alias("content"))


# -- images


CONVERTED = NUMBERED.replace("AS book, row_number() OVER (PARTITION BY label ORDER BY p.vec_id) AS page_no", "AS book, CAST(row_number() OVER (PARTITION BY label ORDER BY p.vec_id) AS INTEGER) AS page_no")


@query(f"SELECT CAST(book AS VARCHAR) AS book, page_no, blob FROM ({CONVERTED})")
def sc6_images_to_containers(spark, sf_dir):
    """From archives of images to containers and back: entries, decoding, conversion, sink, pages."""
    labels = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("book"))
    images = books.png_images(grays(spark, sf_dir)).join(labels, "vec_id")
    numbers = paging.number_pages(images, "book", "vec_id")
    path, out = scratch_path(spark), scratch_path(spark)
    archive.write_archives(numbers.select(F.concat(F.col("book").cast("string"), F.lit(".cbz")).alias("name"), "page_no", F.concat(F.lpad(F.col("vec_id").cast("string"), 9, "0"), F.lit(".png")).alias("entry"), "png"), path)
    files.archives_to_containers(spark, path, out, size=(8, 8), portrait=True, dithering="none")
    return container.containers(spark, out).select(book_name("book").alias("book"), "page_no", F.lower(F.hex("page_blob")).alias("blob"))


@query(f"""SELECT vec_id, 8 AS width, 8 AS height, gray FROM (SELECT vec_id, string_agg(CASE WHEN g >= 128 THEN 'FF' ELSE '00' END, '' ORDER BY y, x) AS gray FROM ({PIXELS}) GROUP BY vec_id)""")
def sc11_raw_page_files(spark, sf_dir):
    path = scratch_path(spark)
    pages = dither.encode_pages(grays(spark, sf_dir).withColumnRenamed("data", "gray"), "none")
    ranged.write_chunks(pages.select(F.concat(F.col("vec_id").cast("string"), F.lit(".xtg")).alias("name"), F.lit(0).alias("seq"), F.col("page_blob").alias("chunk")), path)
    found = files.raw_pages(spark, path)
    return found.select(book_name("book").cast("long").alias("vec_id"), "width", "height", F.hex("gray").alias("gray"))


# -- streams


def streamed(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs a stream to its end and reads what it wrote."""
    path, provider = scratch_path(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, stateful.ROCKS)
    try:
        q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(df.schema).parquet(f"{path}/out")


@query(STITCHED)
def st1_stitch_stream(spark, sf_dir):
    path, pages = scratch_path(spark), strip_pages(spark, sf_dir)
    ends = pages.groupBy("book").agg(F.max("page_no").alias("n")).select("book", (F.col("n") + 1).alias("page_no"), F.lit(True).alias("last"))
    rows = pages.select("book", "page_no", "width", "height", "data", F.lit(False).alias("last")).unionByName(ends, allowMissingColumns=True)
    rows.repartition(3, F.xxhash64("book", "page_no")).write.parquet(path)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return streamed(stateful.stream_stitch(source, **STITCH), spark).select("book", "slice_no", "solid", F.lower(F.hex("page_blob")).alias("blob"))


@query("""SELECT user_id AS session_id, epoch_us(ts) // 1000 + 16200000 AS expired_ms, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids
FROM events WHERE epoch_us(ts) // 1000 + 16200000 <= (SELECT epoch_us(max(ts)) // 1000 FROM events) GROUP BY ALL""")
def st6_expired_results(spark, sf_dir):
    schema = read(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = source.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("created_at"))
    found = streamed(stateful.expired_results(rows), spark)
    return found.select("session_id", "expired_ms", "n", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
