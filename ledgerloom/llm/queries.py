"""Queries over the given tables, one for each operator of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination
from .jaccard_join import similar_components
from .language_id import identify
from .license_scan import NOTICES, PHRASES, license_matches
from .near_lines import LAST, line_flags
from .packing import pack
from .periodic_runs import periodic_runs
from .quality_rules import BASE, judged, scored
from .quality_knn import score_quality
from .repeats import without_repeats
from .shared import settle
from .sharding import byte_shards
from .spelling import latin_words, spelling_forms
from .tokens import token_table

WORD_END, BYTE_END = 2, 0


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_matches(_docs(spark, sf_dir))
    base = F.sort_array(F.array_distinct(F.col("places.label")))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.get("places", F.lit(0))["start"].alias("first_word"), F.array_max(F.col("places.start")).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.sort_array(F.array_union(base, "found")), ",").alias("labels"),
        F.col("best").alias("score"),
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(_docs(spark, sf_dir), n=3, num=90, den=100)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_docs(spark, sf_dir), n=50).drop("kept")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(_docs(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), WORD_END)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_docs(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), BYTE_END, 2048)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: its lines, and the numbers (from 0) of those that go."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    own = docs.select(
        "doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("copy"),
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
    )
    return own.join(line_flags(docs), ["id", "copy"], "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed_lines"),
    )


def op7_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(part != 2)
    out = score_quality(_docs(spark, sf_dir).select("doc_id", "text"), labels)
    return out.select("doc_id", (part == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_docs(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = byte_shards(rows, ["doc_id", "text_crc32", "size"], "size", 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(_docs(spark, sf_dir).select("doc_id", "text", "lang")).drop("text")
    return judged(settle(rows, "scored"), small=True).select("doc_id", *BASE, "base_failed", "kept", "ppl", "ppl_low", "ppl_high")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = _docs(spark, sf_dir)
    # a null doc_id has no remainder and is not held out
    known = docs.where(~F.coalesce(held_out, F.lit(False))).select("text", "lang")
    out = identify(docs.select("doc_id", "text"), known)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "second", "ambiguous")


def rewritten(doc_id: Column, text: Column) -> Column:
    """The text of every tenth document (by hash of doc_id) from word a on repeats the p words that
    stand there; all other texts as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # as an element of an array the words are found once, however often they are used
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.get(F.transform(F.array(words), repeat), F.lit(0))).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = periodic_runs(docs.select("doc_id", rewritten(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.get(F.array_sort(F.transform("runs", lambda x: F.struct((-x["length"]).alias("n"), x["start"].alias("s"), x["period"].alias("p")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", F.col("x.s").alias("start"), (-F.col("x.n")).alias("length"), F.col("x.p").alias("period"),
        F.expr("-1000 * x.n div x.p").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = latin_words(_docs(spark, sf_dir).select("doc_id", "text"), damage=97)
    return spelling_forms(words.where((F.length("word") >= 5) & (F.col("n") >= 3)))


ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _values(templates: dict[str, str]) -> str:
    return ", ".join(f"('{t}', '{label}')" for t, label in templates.items())


SQL_1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{ALNUM}') AS w FROM documents),
phrase(p, label) AS (VALUES {_values(PHRASES)}),
notice(p, label) AS (VALUES {_values(NOTICES)}),
place AS (
  SELECT r, label, i - 1 AS start FROM d, phrase, unnest(range(1, len(w) + 1)) AS u(i)
  WHERE w[i] = string_split(p, ' ')[1] AND list_slice(w, i, i + len(string_split(p, ' ')) - 1) = string_split(p, ' ')
),
base AS (SELECT r, count(*) AS n, min(start) AS f, max(start) AS l, list(DISTINCT label) AS labels FROM place GROUP BY r),
block AS (SELECT r, list_distinct(list_slice(w, b + 1, b + 128)) AS ws FROM d, unnest(range(0, len(w), 64)) AS u(b)),
share AS (
  SELECT r, label, len(list_intersect(list_distinct(string_split(p, ' ')), ws)) / len(list_distinct(string_split(p, ' '))) AS s
  FROM block, notice
),
fuzzy AS (SELECT r, list(DISTINCT label) AS labels, max(s) AS s FROM share WHERE s >= 0.8 - 1e-12 GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, f AS first_word, l AS last_word,
  array_to_string(list_sort(coalesce(base.labels, CAST([] AS VARCHAR[]))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, CAST([] AS VARCHAR[])), coalesce(fuzzy.labels, CAST([] AS VARCHAR[]))))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(s, 0.0) END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN fuzzy USING (r)
"""

SQL_2 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 2), ' ') AS x
  FROM d, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS u(i) WHERE len(w) > 0
),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS p, b.r AS q, count(*) AS c FROM s AS a JOIN s AS b ON a.x = b.x AND a.r <> b.r GROUP BY ALL),
links AS (
  SELECT p, q FROM shared JOIN n AS a ON a.r = p JOIN n AS b ON b.r = q WHERE 100 * c >= 90 * (a.n + b.n - c)
),
reach(r, q) AS (SELECT r, r FROM d UNION SELECT reach.r, links.q FROM reach JOIN links ON links.p = reach.q)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (r)
JOIN (SELECT reach.r, min(e.doc_id) AS component_id FROM reach JOIN d AS e ON e.r = reach.q GROUP BY reach.r) AS c USING (r)
"""

SQL_3 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT r, doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS x
  FROM d, unnest(range(1, len(w) - 48)) AS u(i)
),
f AS (SELECT x, min(doc_id) AS least FROM s GROUP BY x),
gone AS (SELECT r, list(DISTINCT p) AS ps FROM s JOIN f USING (x), unnest(range(i, i + 50)) AS u(p) WHERE least < doc_id GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(
    list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""

SQL_8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{ALNUM}') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, '{ALNUM}') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS x
  FROM b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS u(i) WHERE len(w) > 0
),
dw AS (
  SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i)
),
hits AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.x = bw.x AND dw.n = bw.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(p) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT r, item FROM hits) AS x GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

SQL_9 = """
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, i FROM range(256) AS t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
),
summed AS (
  SELECT doc_id, size, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
    lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) AS text_crc32
  FROM sized, crc
),
run AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS everything
  FROM summed
),
cut AS (SELECT *, least(39, (2 * upto - size) * 40 // (2 * everything)) AS shard FROM run)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""

#: crc32 of the UTF-8 bytes whose hexadecimal digits are h, as a list of steps over a table of 256 values.
_CRC_TABLE = """step(i, k, c) AS (
  SELECT i, 0, i FROM range(256) AS t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8)"""


def _crc_sql(h: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len({h}), 2), lambda i: CAST('0x' || substr({h}, i, 2) AS BIGINT))),
    lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295)"""


SQL_12 = rf"""
WITH RECURSIVE {_CRC_TABLE},
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    hex(encode(CAST(doc_id AS VARCHAR))) AS h FROM documents
),
g AS (SELECT r, doc_id, w, len(w) AS n, {_crc_sql("h")} AS h FROM d, crc),
ga AS (SELECT *, (h // 10) % n AS a FROM g WHERE h % 10 = 0 AND n > 0),
gp AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM ga),
e AS (
  SELECT r, doc_id, n, list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) AS w FROM gp
  UNION ALL
  SELECT r, doc_id, n, w FROM g WHERE h % 10 <> 0 OR n = 0 OR h IS NULL
),
x AS (SELECT r, n, i, w[i + 1] AS word FROM e, unnest(range(0, n)) AS u(i)),
pair AS (SELECT a.r, b.i - a.i AS q, a.i AS i FROM x AS a JOIN x AS b ON a.r = b.r AND a.word = b.word AND a.i < b.i AND 4 * (b.i - a.i) <= a.n),
island AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pair),
stretch AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM island GROUP BY r, q, k),
run AS (SELECT r, s, len, min(q) AS q FROM stretch WHERE len >= greatest(6, 4 * q) GROUP BY r, s, len),
gone AS (SELECT DISTINCT r, i FROM run, unnest(range(s + q, s + len)) AS u(i)),
told AS (
  SELECT r, count(*) AS n_runs, first(struct_pack(s := s, len := len, q := q) ORDER BY len DESC, s, q) AS b,
    string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY r
),
kept AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.i) AS text FROM x LEFT JOIN gone USING (r, i) WHERE gone.i IS NULL GROUP BY x.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.len AS length, b.q AS period, 1000 * b.len // b.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM e LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""

SQL_13 = rf"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS h FROM d GROUP BY doc_id, run),
h AS (SELECT run, n, {_crc_sql("h")} AS h FROM c, crc),
w AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n) AS n FROM h GROUP BY 1
),
v AS (SELECT word, CAST(n AS BIGINT) AS n FROM w WHERE length(word) >= 5 AND n >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM v, unnest(range(1, length(word) + 1)) AS u(i)),
near AS (
  SELECT a.word, b.word AS other, b.n AS n FROM cut AS a JOIN cut AS b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON cut.less = v.word
  UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON cut.less = v.word
),
best AS (SELECT word, count(*) AS n_near, first(struct_pack(other := other, n := n) ORDER BY n DESC, encode(other)) AS b FROM near GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 2 * v.n THEN b.other END AS form, CASE WHEN b.n >= 2 * v.n THEN b.n END AS form_n
  FROM v LEFT JOIN best USING (word)
),
chain AS (
  SELECT word, word AS root, form AS next FROM f
  UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON f.word = chain.next
)
SELECT f.word, f.form, chain.root, f.n, f.n_near, f.form_n FROM f JOIN chain ON chain.word = f.word AND chain.next IS NULL
"""

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_files": op4_token_files,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_votes": op7_quality_votes,
    "op8_decontaminate": op8_decontaminate,
    "op9_byte_shards": op9_byte_shards,
    "op10_quality_rules": op10_quality_rules,
    "op11_language_id": op11_language_id,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLE = {"op1_license_scan": SQL_1, "op2_jaccard_join": SQL_2, "op3_substring_dedup": SQL_3, "op8_decontaminate": SQL_8, "op9_byte_shards": SQL_9, "op12_periodic_runs": SQL_12, "op13_spelling_variants": SQL_13}
