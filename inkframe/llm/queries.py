"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, licenses, lines, media, middle, periodic, repeats, simhash, topk, toxicity, urls, wordpiece
from .common import Scratch, table

# Rules as (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels)
    # a row without an id is in no fold
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "toxic_hits")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), _vocabulary(), _pattern())
    return done.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontaminate.find_hits(docs, items)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), _vocabulary()).select("doc_id", "n_words", "n_tokens")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media.media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return m.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    # files of a tree: a source's thousands, then hundreds
    number = F.coalesce(F.col("doc_id"), F.lit(0))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(number / 1000).cast("string"), F.floor(number / 100).cast("string"), F.concat(number.cast("string"), F.lit(".txt")))
    done = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), path, together=True)
    return done.select("doc_id", "path", "n_headers", "license", F.round("similarity", 4).alias("similarity"), "inherited_from")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the contract's runs of known place: one document in ten, by a hash of its id
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("loop"))
    done = periodic.periodic_runs(docs, loop_col="loop")
    # the first of those with the greatest length / period, compared without rounding
    best = F.reduce("runs", F.lit(None).cast(periodic.RUN), lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return done.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), middle.draws(F.col("doc_id"), 7))
    back = middle.restored(F.col("output"), F.col("form"))
    return done.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, Scratch(spark))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_simhash": op5_simhash,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_counts": op7_token_counts,
    "op8_media": op8_media,
    "op9_repeats": op9_repeats,
    "op10_licenses": op10_licenses,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_top_k": op13_top_k,
    "pipeline": pipeline,
}


def _rules_sql() -> str:
    return ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


#: SQL where it can express an operator; the others are held against plain versions in the tests.
ORACLE = {
    "op3_url_filter": f"""WITH rules(rh, rp, v) AS (VALUES {_rules_sql()}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') ELSE '' END AS raw, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM u),
f AS (SELECT p.page_id, arg_max(rh || rp, length(rh) + length(rp)) AS rule, arg_max(v, length(rh) + length(rp)) AS v FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY p.page_id)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id""",
    "op2_line_dedup": r"""WITH docs AS (SELECT DISTINCT doc_id AS id, text FROM documents WHERE text IS NOT NULL),
t AS (SELECT row_number() OVER (ORDER BY id NULLS FIRST, text) AS key, id, text, string_split(text, chr(10)) AS lines FROM docs),
l AS (SELECT key, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM t),
n AS (SELECT key, pos, greatest(1, len(regexp_extract_all(line, '[^\s\x0B\p{Z}\x{85}\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+|[\p{Han}\p{Hiragana}\p{Katakana}]{1,2}|[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]{1,4}'))) AS words FROM l),
w AS (SELECT *, sum(words) OVER (PARTITION BY key ORDER BY pos) AS upto FROM n),
ways AS (SELECT key, a.pos AS first, min(b.pos) AS last FROM w a JOIN w b USING (key) WHERE b.upto - (a.upto - a.words) >= 30 GROUP BY key, a.pos
  UNION SELECT key, max(a.pos), b.pos FROM w a JOIN w b USING (key) WHERE b.upto - (a.upto - a.words) >= 30 GROUP BY key, b.pos),
runs AS (SELECT key, first, last, array_to_string(lines[first:last], chr(10)) AS run FROM ways JOIN t USING (key)),
later AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY run, last - first ORDER BY key, first) > 1),
gone AS (SELECT key, list(DISTINCT pos) AS gone FROM (SELECT key, unnest(range(first, last + 1)) AS pos FROM later) GROUP BY key),
cut AS (SELECT id, text, len(lines) AS n_lines, coalesce(len(gone), 0) AS n_removed, array_to_string(list_filter(lines, lambda x, i: NOT list_contains(coalesce(gone, []), i)), chr(10)) AS kept FROM t LEFT JOIN gone USING (key))
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN cut ON d.doc_id IS NOT DISTINCT FROM cut.id AND d.text = cut.text""",
    "op6_decontaminate": r"""WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS phrase FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM items WHERE len(w) > 0)),
places AS (SELECT r, size, k, array_to_string(w[k:k + size - 1], ' ') AS phrase FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT r, k, p.size, item_id FROM places p JOIN windows i ON p.size = i.size AND p.phrase = i.phrase),
hit AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS pos FROM (SELECT DISTINCT r, k, size FROM found)) GROUP BY r),
held AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (r) LEFT JOIN held USING (r)""",
    "op9_repeats": """WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT r, unnest(range(1, octet_length(b) - 198)) AS s, unnest(list_transform(range(1, octet_length(b) - 198), lambda i: array_slice(b, i, i + 199))) AS string FROM d WHERE octet_length(b) >= 200),
again AS (SELECT unnest(places, recursive := true) FROM (SELECT list({'r': r, 's': s}) AS places FROM s GROUP BY string HAVING count(*) > 1)),
runs AS (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS run FROM (SELECT r, s, CASE WHEN s - lag(s) OVER (PARTITION BY r ORDER BY s) <= 200 THEN 0 ELSE 1 END AS fresh FROM again)),
spans AS (SELECT r, min(s) AS first, max(s) + 199 AS last FROM runs GROUP BY r, run),
marks AS (SELECT r, list(first ORDER BY first) AS firsts, list(last ORDER BY first) AS lasts, CAST(sum(last - first + 1) AS BIGINT) AS n_removed FROM spans GROUP BY r),
ends AS (SELECT d.r, doc_id, b, n_removed, [1] || list_transform(coalesce(lasts, []), lambda x: x + 1) AS starts, coalesce(firsts, []) || [octet_length(b) + 1] AS stops FROM d LEFT JOIN marks USING (r))
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, len(stops) - 1 AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(stops) + 1), lambda i: CASE WHEN stops[i] > starts[i] THEN hex(array_slice(b, starts[i], stops[i] - 1)) ELSE '' END), ''))) AS kept_sha256 FROM ends""",
    "op11_periodic_runs": r"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, CAST(doc_id AS VARCHAR) AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT *, len(w) AS n, flatten(list_transform(range(1, length(id) + 1), lambda i: [CAST(ascii(substr(id, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS steps FROM t),
h AS (SELECT *, xor(list_reduce(steps, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS h FROM b),
g AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM h),
d AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM g),
x AS (SELECT r, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM d),
same AS (SELECT a.r, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.r = b.r AND a.word = b.word AND a.i < b.i AND 4 * (b.i - a.i) <= a.n),
part AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same),
runs AS (SELECT r, first AS start, length, min(q) AS period FROM (SELECT r, q, min(i) AS first, count(*) + q AS length FROM part GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)) GROUP BY r, first, length),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
every AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
gone AS (SELECT r, list(DISTINCT i) AS gone FROM (SELECT r, unnest(range(start + period, start + length)) AS i FROM runs) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)) END, ' ')) AS collapsed_sha256
FROM d LEFT JOIN every USING (r) LEFT JOIN best USING (r) LEFT JOIN gone USING (r)""",
    "op12_fill_in_middle": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM g),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN length(pre) END AS prefix_chars, CASE WHEN NOT plain THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op13_top_k": """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) WHERE rank <= 5""",
}
