"""Each operator bound to the given tables, and SQL that gives the same rows."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fields import (
    as_identifier, blank_status, cell_lines, config_fingerprint, content_hash, field_lookup, format_location, parse_amount, parse_response, salvage_response, stated_date,
)
from ..functions.fragments import fragment_text, image_regions, neighbour_context, pack_blocks
from ..operators import batches as B
from ..operators import checks as C
from ..operators import ledgers as L
from ..operators.assembly import assemble, entries_of, retry_units
from ..operators.extract import rule_extract
from ..operators.sheets import cut_sheets
from ..operators.template_sql import register_fill_template
from ..sources.blocks import block_source, document_blocks, list_files, new_file
from ..sources.difference import differences
from ..sources.files import accept_paths, list_sources, read_blocks, text_blocks
from ..sources.readers import Block, Reader
from ..sources.store import latest, latest_export, replace_results, save_results, saved_results, scratch, verify, write_ledger, written
from ..streaming.intake import ROCKS, intake_results, intake_stream
from ..streaming.resume import resume_stream
from .export import export_job
from .ledgers import contract_job, invoice_job, minutes_job
from .rounds import ask_rounds, attempts, route_answers, run_rounds
from .voucher import voucher_job

QUERIES, ORACLE = {}, {}
_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_ALL = ", ".join(_LINE)


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.col("l_extendedprice").cast("decimal(18,2)")
    unit = F.when(F.col("l_linenumber") % 2 == 0, "even").otherwise("odd")
    credit = F.when(F.col("l_returnflag") == "R", amount - 1).otherwise(amount)
    return t(spark, sf_dir, "lineitem").select("*", F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("currency"), unit.alias("unit"), amount.alias("debit"), credit.alias("credit"))


_E = """e AS (SELECT *, l_orderkey AS o_orderkey, l_linestatus AS currency, CASE WHEN l_linenumber % 2 = 0 THEN 'even' ELSE 'odd' END AS unit,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS debit,
  CAST(l_extendedprice AS DECIMAL(18,2)) - CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS credit FROM lineitem)"""
_BAL = "bal AS (SELECT o_orderkey, currency, unit, sum(debit) AS debit, sum(credit) AS credit FROM e GROUP BY ALL)"
_VOUCHER = f"""WITH {_E}, {_BAL},
r AS (SELECT o_orderkey, 'unbalanced' AS reason FROM bal WHERE debit <> credit
  UNION ALL SELECT o_orderkey, 'conflict in l_linestatus' FROM e GROUP BY 1 HAVING min(l_linestatus) <> max(l_linestatus)),
rs AS (SELECT o_orderkey, string_agg(DISTINCT reason, ';' ORDER BY reason) AS reasons FROM r GROUP BY 1)"""


@query("voucher_job", _VOUCHER + """
SELECT e.o_orderkey, o_orderstatus, o_totalprice, l_linenumber, l_partkey, currency, unit, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit,
  concat_ws(';', CASE WHEN o.o_orderkey IS NULL THEN 'no header' END, reasons) AS reasons,
  CASE WHEN reasons IS NULL AND o.o_orderkey IS NOT NULL THEN 'normal' ELSE 'review' END AS route
FROM e LEFT JOIN orders o ON o.o_orderkey = e.o_orderkey LEFT JOIN rs ON rs.o_orderkey = e.o_orderkey""")
def voucher_ledger_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: JN1, AGG1, AGG2, AGG8 and FLT1 in one plan."""
    heads = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = voucher_job(heads, entries(spark, sf_dir), "o_orderkey", ["l_linestatus"])
    return out.select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "l_linenumber", "l_partkey", "currency", "unit", F.col("debit").cast("double").alias("debit"),
        F.col("credit").cast("double").alias("credit"), F.array_join("reasons", ";").alias("reasons"), "route",
    )


@query("src1_list_sources", "SELECT page_id, url FROM pages WHERE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) IN ('html', 'pdf') AND NOT starts_with(url, 'http://ththre.example.com/')")
def _(spark, d):
    return accept_paths(t(spark, d, "pages").select("page_id", "url"), "url", ("html", "pdf"), ("http://ththre.example.com",))


@query("src2_read_blocks", "SELECT doc_id AS file_id, CAST(i - 1 AS INTEGER) AS block_no, 'para' AS kind, CAST(i AS INTEGER) AS para, string_split(text, chr(10))[i] AS text FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)")
def _(spark, d):
    return text_blocks(t(spark, d, "documents"), "doc_id")


@query("snk3_verify_export", "SELECT 'rows' AS \"check\", true AS ok UNION ALL SELECT 'content', true UNION ALL SELECT 'rows', (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') = 0 UNION ALL SELECT 'content', (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') = 0")
def _(spark, d):
    o = t(spark, d, "orders")
    return verify(o, o.repartition(7, "o_custkey")).unionByName(verify(o, o.where("o_orderstatus <> 'O'"))).select("check", "ok")


@query("snk4_latest_export", "SELECT * FROM (SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS run_id FROM orders) AS x WHERE run_id = (SELECT max(CAST(year(o_orderdate) AS INTEGER)) FROM orders)")
def _(spark, d):
    return latest(t(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("run_id")))


@query("prj1_default_fields", "SELECT o_orderkey AS contract_no, CAST(NULL AS VARCHAR) AS name, o_custkey AS party_a, CAST(NULL AS VARCHAR) AS party_b, o_totalprice AS total, CAST(NULL AS VARCHAR) AS condition_lines, CAST(NULL AS VARCHAR) AS share_lines, CAST(NULL AS VARCHAR) AS due_lines FROM orders")
def _(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("contract_no"), F.col("o_custkey").alias("party_a"), F.col("o_totalprice").alias("total"), "o_orderstatus")
    return B.default_fields(rows, "contract")


@query("prj2_template_fields", "SELECT p_partkey, p_name AS name, p_brand AS brand, CAST(NULL AS VARCHAR) AS gap_3, CAST(p_size AS VARCHAR) AS size FROM part")
def _(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand")).alias("fields"))
    return B.template_fields(p, ["name", "brand", None, "size"])


@query("prj2_fill_template", "SELECT p_partkey, p_name AS name, p_brand AS brand, CAST(NULL AS VARCHAR) AS gap_3, CAST(p_size AS VARCHAR) AS size FROM part")
def _(spark, d):
    """The same by the table function of SQL."""
    register_fill_template(spark)
    t(spark, d, "part").select("p_partkey", F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand")).alias("fields")).createOrReplaceTempView("template_rows")
    return spark.sql("SELECT * FROM fill_template(TABLE(template_rows), header => array('name', 'brand', NULL, 'size'))")


@query("prj3_with_provenance", "SELECT l_orderkey, l_partkey, l_linenumber, concat('order ', l_orderkey) AS source_file, concat('line ', l_linenumber) AS source_position, l_linenumber AS item_no, CASE WHEN l_discount = 0 THEN 'no discount stated' END AS note FROM lineitem")
def _(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_discount")
    note = F.when(F.col("l_discount") == 0, "no discount stated")
    return B.with_provenance(rows, F.format_string("order %d", "l_orderkey"), F.format_string("line %d", "l_linenumber"), F.col("l_linenumber"), note).drop("l_discount")


def _reasoned(spark, d):
    reasons = F.array_compact(F.array(F.when(F.col("l_returnflag") == "R", F.lit("returned")), F.when(F.col("l_discount") >= 0.09, F.lit("discount"))))
    return t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_linestatus", "l_returnflag", reasons.alias("reasons"))


_R = "x AS (SELECT l_orderkey, l_partkey, l_linenumber, l_linestatus, CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN 'returned;discount' WHEN l_returnflag = 'R' THEN 'returned' WHEN l_discount >= 0.09 THEN 'discount' ELSE '' END AS reasons FROM lineitem)"


@query("flt1_split_review", f"WITH {_R} SELECT l_orderkey, l_partkey, l_linenumber, reasons FROM x WHERE reasons <> ''")
def _(spark, d):
    return C.split_review(_reasoned(spark, d))[1].select("l_orderkey", "l_partkey", "l_linenumber", F.array_join("reasons", ";").alias("reasons"))


@query("flt2_failed_file_rows", "SELECT user_id AS file_id, min(concat('failed at ', event_type, ' ', CAST(value AS VARCHAR))) AS reason, 'review' AS route, CAST(0 AS INTEGER) AS n_documents FROM events WHERE event_type = 'error' GROUP BY user_id")
def _(spark, d):
    cause = F.concat(F.lit("failed at "), "event_type", F.lit(" "), F.col("value").cast("string"))
    return C.failed_file_rows(t(spark, d, "events"), "user_id", F.col("event_type") == "error", cause)


@query("flt3_capacity_check", "SELECT doc_id AS row_id, 'text' AS field, length(text) AS size FROM documents WHERE length(text) > 5000")
def _(spark, d):
    return C.capacity_check(t(spark, d, "documents"), "doc_id", ["text", "n_chars"], max_chars=5000)


@query("flt4_required_fields", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'unreadable quality' ELSE '' END AS reasons, CASE WHEN quality IS NULL THEN 'not stated: quality' ELSE '' END AS notes FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, d):
    both = t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left")
    status = blank_status(F.when(F.col("toxic") == 1, "???").otherwise(F.col("quality").cast("string")))
    out = C.required_fields(both, {"quality": status})
    return out.select("doc_id", F.array_join("reasons", ";").alias("reasons"), F.array_join("notes", ";").alias("notes"))


@query("jn1_voucher_ledger", "SELECT l_orderkey AS o_orderkey, o_custkey, o_orderdate, l_linenumber, l_partkey, l_suppkey, o_orderkey IS NOT NULL AS header_found FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def _(spark, d):
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    return L.voucher_ledger(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), lines, "o_orderkey")


@query("jn2_minutes_ledger", "SELECT o_orderkey, o_orderpriority, l_partkey, l_suppkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def _(spark, d):
    todos = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey")
    return L.minutes_ledger(t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), todos, "o_orderkey")


@query("jn3_attach_evidence", "SELECT o_orderkey, coalesce(n, 0) AS n_attachments, coalesce(a, '') AS attachments FROM orders LEFT JOIN (SELECT user_id, count(*) AS n, string_agg(event_type, ',' ORDER BY event_type) AS a FROM events GROUP BY 1) ON user_id = o_orderkey")
def _(spark, d):
    own = t(spark, d, "events").select(F.col("user_id").alias("o_orderkey"), "event_type")
    return L.attach_evidence(t(spark, d, "orders").select("o_orderkey"), own, "o_orderkey", "event_type")


@query("jn4_location_exists", "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS block_no, l_partkey, 'position not in the source' AS reason FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = l_orderkey AND l_linenumber < len(string_split(text, chr(10))))")
def _(spark, d):
    cited = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("block_no"), "l_partkey")
    blocks = text_blocks(t(spark, d, "documents"), "doc_id").withColumnRenamed("file_id", "doc_id")
    return C.location_exists(cited, blocks, ["doc_id", "block_no"])


@query("jn5_pending_files", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return B.pending_files(t(spark, d, "documents").select("doc_id", "source"), t(spark, d, "labels"), ["doc_id"])


@query("jn6_source_drift", """WITH a AS (SELECT doc_id, sha256(lang) AS s FROM documents), b AS (SELECT item_id AS doc_id, sha256(CASE WHEN length(text) % 2 = 0 THEN 'en' ELSE 'de' END) AS s FROM benchmark)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'missing' WHEN a.s = b.s THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def _(spark, d):
    saved = t(spark, d, "documents").select("doc_id", content_hash(F.col("lang")).alias("sha"))
    shown = F.when(F.length("text") % 2 == 0, "en").otherwise("de")
    now = t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), content_hash(shown).alias("sha"))
    return B.source_drift(saved, now, "doc_id", "sha")


@query("jn7_replace_file_results", """WITH r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT l_orderkey, l_partkey, l_linenumber, 1 AS attempt FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM r)
UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, 2 FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM r) AND l_returnflag <> 'R'""")
def _(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    files = rows.where("l_returnflag = 'R'").select("l_orderkey")
    again = rows.where("l_returnflag <> 'R'").join(files.distinct(), "l_orderkey", "left_semi").withColumn("attempt", F.lit(2))
    return B.replace_file_results(rows.withColumn("attempt", F.lit(1)), again, files, "l_orderkey").drop("l_returnflag")


@query("jn8_retry_targets", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, d):
    review = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return B.retry_targets(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), review, "o_orderkey")


@query("jn9_occupied_rows", "SELECT o_orderkey AS row_no FROM orders WHERE o_orderkey IN (SELECT p_partkey FROM part)")
def _(spark, d):
    return B.occupied_rows(t(spark, d, "orders").select(F.col("o_orderkey").alias("row_no")), t(spark, d, "part").select(F.col("p_partkey").alias("row_no")))


@query("agg1_voucher_balance", f"WITH {_E}, {_BAL} SELECT o_orderkey, currency, unit, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit, CAST(debit - credit AS DOUBLE) AS diff, debit = credit AS balanced FROM bal")
def _(spark, d):
    out = C.voucher_balance(entries(spark, d), ["o_orderkey", "currency", "unit"], "debit", "credit")
    return out.withColumns({c: F.col(c).cast("double") for c in ("debit", "credit", "diff")})


@query("agg2_header_conflict", "SELECT l_orderkey, 'l_linestatus' AS field, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS \"values\" FROM lineitem GROUP BY 1 HAVING min(l_linestatus) <> max(l_linestatus) UNION ALL SELECT l_orderkey, 'l_returnflag', string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FROM lineitem GROUP BY 1 HAVING min(l_returnflag) <> max(l_returnflag)")
def _(spark, d):
    return C.header_conflict(t(spark, d, "lineitem"), "l_orderkey", ["l_linestatus", "l_returnflag"])


@query("agg3_invoice_ledger", f"SELECT o_orderkey, o_custkey, coalesce(items, '') AS items FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(concat(l_linenumber, ' part ', l_partkey, ' x ', CAST(l_quantity AS BIGINT)), chr(10) ORDER BY {_ALL}) AS items FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def _(spark, d):
    items = t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    line = F.format_string("%d part %d x %d", "l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint"))
    return L.invoice_ledger(t(spark, d, "orders").select("o_orderkey", "o_custkey"), items, "o_orderkey", _LINE, line)


_STATED = """s AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS summed, count(*) FILTER (l_linenumber = 7 AND l_extendedprice <> 0) AS bad FROM lineitem GROUP BY 1),
h AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'F' THEN coalesce(summed, 0) + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END END AS stated, summed, coalesce(bad, 0) AS n_bad_items FROM orders LEFT JOIN s ON k = o_orderkey),
c AS (SELECT *, stated IS NULL OR coalesce(stated = summed, false) AS agrees FROM h),
x AS (SELECT *, concat_ws(';', CASE WHEN NOT agrees AND summed IS NULL THEN 'total without items' WHEN NOT agrees THEN 'items differ from total' END, CASE WHEN n_bad_items > 0 THEN 'quantity x price differs from amount' END) AS reasons FROM c)"""


def _stated(spark, d):
    """Invoices with a stated total (for some none), and items; a seventh item's price is wrong."""
    amount, seventh = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_linenumber") == 7
    items = t(spark, d, "lineitem").withColumn("amount", amount).withColumn("quantity", F.when(seventh, 2).otherwise(1)).withColumn("price", amount)
    items = items.withColumnRenamed("l_orderkey", "o_orderkey")
    sums = items.groupBy("o_orderkey").agg(F.sum("amount").alias("s"))
    total = F.coalesce("s", F.lit(0)) + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    heads = t(spark, d, "orders").join(sums, "o_orderkey", "left").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "F", total).alias("total"))
    return heads, items


@query("agg4_amount_relation", f"WITH {_STATED} SELECT o_orderkey, CAST(stated AS DOUBLE) AS stated, CAST(summed AS DOUBLE) AS summed, n_bad_items, agrees, reasons FROM x")
def _(spark, d):
    heads, items = _stated(spark, d)
    out = C.amount_relation(items, heads, "o_orderkey", "amount", "total", quantity="quantity", price="price")
    return out.withColumns({c: F.col(c).cast("double") for c in ("stated", "summed")}).withColumn("reasons", F.array_join("reasons", ";"))


@query("invoice_job", f"""WITH {_STATED}, i AS (SELECT l_orderkey, string_agg(concat(l_linenumber, ' part ', l_partkey), chr(10) ORDER BY {_ALL}) AS items FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_custkey, CAST(stated AS DOUBLE) AS total, coalesce(items, '') AS items, reasons, CASE WHEN reasons = '' THEN 'normal' ELSE 'review' END AS route FROM x LEFT JOIN i ON l_orderkey = o_orderkey""")
def _(spark, d):
    heads, items = _stated(spark, d)
    line = F.format_string("%d part %d", "l_linenumber", "l_partkey")
    out = invoice_job(heads, items, "o_orderkey", _LINE, line, "amount", "total", "quantity", "price")
    return out.withColumn("total", F.col("total").cast("double")).withColumn("reasons", F.array_join("reasons", ";"))


@query("contract_job", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '???' WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS name, coalesce(s, '') AS o_orderstatus_lines,
CASE WHEN c_mktsegment = 'BUILDING' THEN 'unreadable name' ELSE '' END AS reasons, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'not stated: name' ELSE '' END AS notes, CASE WHEN c_mktsegment = 'BUILDING' THEN 'review' ELSE 'normal' END AS route
FROM customer LEFT JOIN (SELECT o_custkey, string_agg(o_orderstatus, chr(10) ORDER BY o_orderdate, o_orderkey) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def _(spark, d):
    segment = F.col("c_mktsegment")
    heads = t(spark, d, "customer").select("c_custkey", F.when(segment == "BUILDING", "???").when(segment != "MACHINERY", segment).alias("name"))
    out = contract_job(heads, t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus"], ["name"])
    return out.withColumns({c: F.array_join(c, ";") for c in ("reasons", "notes")})


@query("minutes_job", """SELECT o_orderkey, o_orderpriority, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN '' WHEN l_returnflag = 'R' THEN '???' ELSE l_returnflag END AS owner, CASE WHEN l_returnflag = 'R' THEN 'unreadable owner' ELSE '' END AS reasons,
CASE WHEN l_returnflag = 'N' OR l_returnflag IS NULL THEN 'not stated: owner' ELSE '' END AS notes, CASE WHEN l_returnflag = 'R' THEN 'review' ELSE 'normal' END AS route FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""")
def _(spark, d):
    owner = F.when(F.col("l_returnflag") == "N", "").when(F.col("l_returnflag") == "R", "???").otherwise(F.col("l_returnflag"))
    todos = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", owner.alias("owner"))
    out = minutes_job(t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), todos, "o_orderkey", ["owner"])
    return out.withColumns({c: F.array_join(c, ";") for c in ("reasons", "notes")})


@query("agg5_contract_ledger", """SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS total, coalesce(s, '') AS o_orderstatus_lines, coalesce(p, '') AS o_orderpriority_lines FROM customer LEFT JOIN (
SELECT o_custkey, string_agg(o_orderstatus, chr(10) ORDER BY o_orderdate, o_orderkey) AS s, string_agg(CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END, chr(10) ORDER BY o_orderdate, o_orderkey) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def _(spark, d):
    heads = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("total"))
    parts = t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return L.contract_ledger(heads, parts, "c_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query("agg6_batch_summary", f"WITH {_R} SELECT l_linestatus AS batch_id, count(*) FILTER (reasons = '') AS n_normal, count(*) FILTER (reasons <> '') AS n_review FROM x GROUP BY 1")
def _(spark, d):
    return B.batch_summary(C.routed(_reasoned(spark, d)).withColumnRenamed("l_linestatus", "batch_id"), "batch_id")


@query("agg7_progress", "SELECT stage, count(*) AS n_files FROM (SELECT user_id, arg_max(event_type, ts) AS stage FROM events GROUP BY 1) GROUP BY 1")
def _(spark, d):
    return B.progress(B.latest_result(t(spark, d, "events"), "user_id", "ts", ["event_type"]).withColumnRenamed("event_type", "stage"), "stage")


@query("agg8_collect_reasons", "SELECT l_orderkey, string_agg(DISTINCT r, ';' ORDER BY r) AS reasons FROM (SELECT l_orderkey, 'returned' AS r FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, 'discount' FROM lineitem WHERE l_discount >= 0.09) GROUP BY 1")
def _(spark, d):
    rows = _reasoned(spark, d).select("l_orderkey", F.explode("reasons").alias("reason"))
    return C.collect_reasons(rows, "l_orderkey", "reason")


@query("agg9_assemble_documents", """WITH p AS (SELECT conv_id, role, turn // 2 AS slot, count(DISTINCT length(text)) AS n, string_agg(DISTINCT CAST(length(text) AS VARCHAR), '|' ORDER BY CAST(length(text) AS VARCHAR)) AS v FROM conversations GROUP BY ALL)
SELECT conv_id, role, string_agg(concat(slot, '=', v), ';' ORDER BY slot) AS content, CAST(sum(n) AS BIGINT) AS n_candidates, max(n > 1) AS conflict FROM p GROUP BY 1, 2""")
def _(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "role", F.expr("turn div 2").alias("slot"), F.length("text").cast("string").alias("value"))
    out = C.assemble_documents(rows, ["conv_id", "role"], "slot", "value")
    shown = F.transform("content", lambda x: F.concat(x["position"].cast("string"), F.lit("="), F.array_join(x["values"], "|")))
    return out.withColumn("content", F.array_join(shown, ";"))


_CANDIDATES = """c AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS file_id, turn * 10 AS s, turn * 10 + 4 + length(text) % 24 AS e, role AS field, CAST(length(text) % 3 AS VARCHAR) AS value,
  CASE WHEN length(text) % 4 > 0 THEN concat('K', conv_id) END AS no, CASE WHEN length(text) % 5 = 0 THEN concat('R', length(text) % 60) END AS ref FROM conversations),
n AS (SELECT *, row_number() OVER (ORDER BY file_id, s, e, field, value, no, ref) AS id, no IS NOT NULL OR ref IS NOT NULL AS has FROM c),
l AS (SELECT a.id AS p, b.id AS q FROM n AS a JOIN n AS b ON a.no = b.no UNION SELECT a.id, b.id FROM n AS a JOIN n AS b ON a.ref = b.ref UNION SELECT id, id FROM n
  UNION SELECT a.id, b.id FROM n AS a JOIN n AS b ON a.file_id = b.file_id AND a.s < b.e AND b.s < a.e AND NOT a.has AND NOT b.has),
r(p, q) AS (SELECT p, q FROM l UNION SELECT r.p, l.q FROM r JOIN l ON l.p = r.q),
k AS (SELECT n.*, g FROM n JOIN (SELECT p AS id, min(q) AS g FROM r GROUP BY 1) AS x USING (id)),
m AS (SELECT a.g, min(b.g) AS lo, max(b.g) AS hi FROM k AS a JOIN k AS b ON a.file_id = b.file_id AND a.s < b.e AND b.s < a.e AND NOT a.has AND b.has GROUP BY 1),
d AS (SELECT k.*, CASE WHEN NOT has AND lo = hi THEN lo ELSE k.g END AS doc, has OR coalesce(lo = hi, false) AS keyed,
  CASE WHEN has OR coalesce(lo = hi, false) THEN NULL WHEN lo IS NOT NULL THEN 'overlaps several documents' ELSE 'no business key' END AS reason FROM k LEFT JOIN m ON m.g = k.g)"""


def _assembled(spark, d):
    n = F.length("text")
    rows = t(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("file_id"), (F.col("turn") * 10).alias("start"), (F.col("turn") * 10 + 4 + n % 24).alias("stop"), F.col("role").alias("field"), (n % 3).cast("string").alias("value"),
        F.when(n % 4 > 0, F.concat(F.lit("K"), F.col("conv_id").cast("string"))).alias("no"), F.when(n % 5 == 0, F.concat(F.lit("R"), (n % 60).cast("string"))).alias("ref"),
    )
    return assemble(rows, ["no", "ref"], across_files=True)


@query("agg9_documents", f"""WITH RECURSIVE {_CANDIDATES},
el AS (SELECT a.id AS p, b.id AS q FROM d AS a JOIN d AS b ON a.doc = b.doc AND a.file_id = b.file_id AND a.field = b.field AND a.s < b.e AND b.s < a.e),
er(p, q) AS (SELECT p, q FROM el UNION SELECT er.p, el.q FROM er JOIN el ON el.p = er.q),
e AS (SELECT d.*, x.entry FROM d JOIN (SELECT p AS id, min(q) AS entry FROM er GROUP BY 1) AS x USING (id)),
o AS (SELECT doc, count(*) AS n_candidates, min(file_id) AS first_file, count(DISTINCT file_id) AS n_files FROM d GROUP BY 1)
SELECT min(file_id) AS file_id, min(field) AS field, min(s) AS start, max(e) AS stop, string_agg(DISTINCT value, '|' ORDER BY value) AS "values", count(*) AS n_met, min(value) <> max(value) AS conflict,
  bool_and(keyed) AS keyed, min(reason) AS reason, min(n_candidates) AS n_candidates, min(first_file) AS first_file, min(n_files) AS n_files FROM e JOIN o USING (doc) GROUP BY doc, entry""")
def _(spark, d):
    """Candidates with two kinds of numbers, some with none, put together over conversations."""
    found = written(_assembled(spark, d), "assembled")
    whole = found.groupBy("document").agg(F.count("*").alias("n_candidates"), F.min("file_id").alias("first_file"), F.count_distinct("file_id").alias("n_files"))
    return entries_of(found).withColumn("values", F.array_join("values", "|")).join(whole, "document").drop("document", "entry")


@query("jn8_retry_units", f"""WITH RECURSIVE {_CANDIDATES}, fl AS (SELECT DISTINCT a.file_id AS p, b.file_id AS q FROM d AS a JOIN d AS b ON a.doc = b.doc),
fr(p, q) AS (SELECT p, q FROM fl UNION SELECT fr.p, fl.q FROM fr JOIN fl ON fl.p = fr.q) SELECT p AS file_id, min(q) AS unit FROM fr GROUP BY 1""")
def _(spark, d):
    return retry_units(written(_assembled(spark, d), "assembled"))


@query("win1_dedupe_content", "SELECT doc_id, first AS kept_as FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents) WHERE doc_id <> first")
def _(spark, d):
    files = t(spark, d, "documents").select(content_hash(F.col("text")).alias("sha"), "doc_id")
    return B.dedupe_content(files, "sha", "doc_id")[1].select("doc_id", "kept_as")


@query("win2_number_items", f"SELECT l_orderkey, {_ALL}, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ALL}) AS INTEGER) AS item_no FROM lineitem")
def _(spark, d):
    return B.number_items(t(spark, d, "lineitem"), "l_orderkey", _LINE)


@query("win3_neighbour_context", "SELECT conv_id, turn, text, right(lag(text) OVER w, 20) AS before, left(lead(text) OVER w, 20) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(spark, d):
    return neighbour_context(t(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", 20)


@query("win4_latest_result", "SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY 1")
def _(spark, d):
    return B.latest_result(t(spark, d, "events"), "user_id", "ts", ["event_id", "event_type"])


@query("win5_row_positions", "SELECT o_orderkey, o_custkey, 4 + row_number() OVER (ORDER BY o_custkey, o_orderkey) AS row_no FROM orders")
def _(spark, d):
    return B.row_positions(t(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], start=5)


@query("srt1_source_order", f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, {_ALL}")
def _(spark, d):
    return B.source_order(t(spark, d, "lineitem"), ["l_orderkey", *_LINE]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("set1_dedupe_paths", "SELECT DISTINCT regexp_replace(url, '\\?.*$', '') AS path FROM pages")
def _(spark, d):
    return B.dedupe_paths(t(spark, d, "pages").select(F.regexp_replace("url", r"\?.*$", "").alias("path")))


@query("set2_full_batch_view", f"WITH {_R} SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN reasons <> '' THEN reasons END AS reasons, CASE WHEN reasons = '' THEN 'normal' ELSE 'review' END AS sheet FROM x")
def _(spark, d):
    rows = _reasoned(spark, d).select("l_orderkey", "l_partkey", "l_linenumber", "reasons")
    normal, review = C.split_review(rows)
    return B.full_batch_view(normal.drop("reasons"), review.withColumn("reasons", F.array_join("reasons", ";")))


@query("set3_sources_unchanged", "SELECT doc_id, sha256(text) AS sha, 'before' AS side FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT doc_id, sha256(text || '!'), 'after' FROM documents WHERE doc_id % 50 = 0")
def _(spark, d):
    docs = t(spark, d, "documents")
    before = docs.select("doc_id", content_hash(F.col("text")).alias("sha"))
    after = docs.select("doc_id", content_hash(F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("sha"))
    return B.sources_unchanged(before, after)


@query("fn1_parse_amount", "SELECT c_custkey, c_acctbal AS value, CASE WHEN c_nationkey % 2 = 0 THEN 'CNY' ELSE 'USD' END AS currency, CASE WHEN c_nationkey % 3 = 0 THEN '万元' ELSE '元' END AS unit FROM customer")
def _(spark, d):
    shown = F.concat(F.when(F.col("c_nationkey") % 2 == 0, "CNY ").otherwise("USD "), F.format_number("c_acctbal", 2), F.when(F.col("c_nationkey") % 3 == 0, " 万元").otherwise(" 元"))
    out = t(spark, d, "customer").select("c_custkey", parse_amount(shown).alias("a"))
    return out.select("c_custkey", F.col("a.value").cast("double").alias("value"), "a.currency", "a.unit")


@query("fn2_as_identifier", "SELECT c_custkey, substr(c_name, 10) AS number FROM customer")
def _(spark, d):
    return t(spark, d, "customer").select("c_custkey", as_identifier(F.substring("c_name", 10, 20)).alias("number"))


@query("fn3_blank_status", "SELECT doc_id, CASE WHEN n_chars < 100 THEN 'not_stated' WHEN lang = 'de' THEN 'unreadable' WHEN lang = 'fr' THEN 'not_applicable' ELSE 'stated' END AS status FROM documents")
def _(spark, d):
    value = F.when(F.col("n_chars") < 100, " ").when(F.col("lang") == "de", "???").when(F.col("lang") == "fr", "N/A").otherwise(F.col("text"))
    return t(spark, d, "documents").select("doc_id", blank_status(value).alias("status"))


@query("fn4_stated_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date FROM orders")
def _(spark, d):
    shown = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy/MM/dd"))
    shown = shown.when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy年M月d日")).otherwise("soon")
    return t(spark, d, "orders").select("o_orderkey", stated_date(shown)["date"].cast("string").alias("date"))


@query("fn5_content_hash", "SELECT doc_id, sha256(text) AS sha FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", content_hash(F.col("text")).alias("sha"))


@query("fn6_fragment_text", "SELECT doc_id, CAST(s // 900 AS INTEGER) AS frag_no, CAST(s AS INTEGER) AS start, substr(text, s + 1, 1000) AS fragment FROM documents, unnest(range(0, greatest(length(text) - 100, 1), 900)) AS u(s)")
def _(spark, d):
    return fragment_text(t(spark, d, "documents").select("doc_id", "text")).drop("text")


@query("fn7_pack_blocks", """WITH RECURSIVE b AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, turn, i, 0 AS frag, n AS used FROM b WHERE i = 1 UNION ALL
SELECT b.conv_id, b.turn, b.i, CASE WHEN used + n <= 1500 OR used = 0 THEN frag ELSE frag + 1 END, CASE WHEN used + n <= 1500 OR used = 0 THEN used + n ELSE n END FROM f JOIN b ON b.conv_id = f.conv_id AND b.i = f.i + 1)
SELECT conv_id, turn, CAST(frag AS INTEGER) AS frag_no FROM f""")
def _(spark, d):
    return pack_blocks(t(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", 1500).drop("text")


@query("fn8_cell_lines", f"SELECT l_orderkey, string_agg(concat(l_partkey, ': ', l_returnflag), chr(10) ORDER BY {_ALL}) AS cell FROM lineitem GROUP BY 1")
def _(spark, d):
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(L.ordered(_LINE, []).alias("x"))
    return rows.select("l_orderkey", cell_lines(F.col("x"), "%s: %s", ("l_partkey", "l_returnflag")).alias("cell"))


@query("fn9_format_location", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN concat('page ', p_size) WHEN 1 THEN concat('paragraph ', p_size) WHEN 2 THEN concat('table row ', p_size, ' column ', p_size + 1) WHEN 3 THEN 'header' END AS position FROM part")
def _(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("pdf", "para", "cell", "header", "video"))), (F.col("p_size") % 5 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", format_location(kind, F.col("p_size"), F.col("p_size"), F.col("p_size"), F.col("p_size") + 1).alias("position"))


@query("fn10_parse_response", """SELECT event_id, CASE WHEN event_id % 11 <> 0 AND k >= 10 THEN k END AS k, CASE WHEN event_id % 11 = 0 THEN 'unreadable answer' WHEN k < 10 THEN 'missing k' ELSE '' END AS reasons
FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)""")
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    answer = F.when(F.col("event_id") % 11 == 0, F.lit('{"k": ')).when(k < 10, "{}").otherwise(F.col("props"))
    out = t(spark, d, "events").select("event_id", parse_response(answer, "k INT", ("k",)).alias("r"))
    return out.select("event_id", F.col("r.value.k").alias("k"), F.array_join("r.reasons", ";").alias("reasons"))


@query("fn10_salvage_response", """WITH e AS (SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, length(concat('{"id": ', event_id, ', "k": ', json_extract(props, '$.k'), '}')) AS n FROM events),
p AS (SELECT *, 16 + sum(n) OVER w + 2 * (row_number() OVER w - 1) AS stop, 16 + sum(n) OVER (PARTITION BY user_id) + 2 * count(*) OVER (PARTITION BY user_id) AS whole FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
u AS (SELECT user_id, whole, count(*) FILTER (stop <= whole - user_id % 40) AS n_whole, CAST(sum(k) FILTER (stop <= whole - user_id % 40) AS BIGINT) AS k FROM p GROUP BY 1, 2)
SELECT user_id, n_whole, k, CASE WHEN user_id % 40 > 1 THEN concat('answer broken off after ', n_whole, ' whole candidates') ELSE '' END AS reasons FROM u""")
def _(spark, d):
    """A user's events as one answer, of which up to 39 characters are lost at the end."""
    item = F.format_string('{"id": %d, "k": %s}', "event_id", F.get_json_object("props", "$.k"))
    items = t(spark, d, "events").select("user_id", "event_id", item.alias("item")).groupBy("user_id").agg(L.ordered(["event_id"], ["item"]).alias("x"))
    whole = F.concat(F.lit('{"candidates": ['), F.array_join(F.transform("x", lambda x: x["item"]), ", "), F.lit("]}"))
    answer = F.substring(whole, F.lit(1), (F.length(whole) - F.col("user_id") % 40).cast("int"))
    out = items.select("user_id", salvage_response(answer, "id BIGINT, k BIGINT", ("id",)).alias("r"))
    k = F.transform("r.candidates", lambda c: c["value"]["k"])
    return out.select("user_id", F.size("r.candidates").cast("long").alias("n_whole"), F.when(F.size(k) > 0, F.aggregate(k, F.lit(0).cast("long"), lambda a, x: a + x)).alias("k"), F.array_join("r.reasons", ";").alias("reasons"))


@query("fn11_config_fingerprint", "SELECT n_nationkey, sha256('{\"model\":\"' || n_name || '\",\"region\":\"' || n_regionkey || '\"}') AS fingerprint FROM nation")
def _(spark, d):
    return t(spark, d, "nation").select("n_nationkey", config_fingerprint(region=F.col("n_regionkey"), model=F.col("n_name")).alias("fingerprint"))


@query("fn12_field_lookup", "SELECT p_partkey, p_name AS name, CAST(NULL AS VARCHAR) AS weight FROM part")
def _(spark, d):
    fields = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    return t(spark, d, "part").select("p_partkey", *field_lookup(fields, ["name", "weight"]))


@query("fn13_image_regions", """SELECT p_partkey, CAST(x AS INTEGER) AS x0, CAST(y AS INTEGER) AS y0, CAST(least(x + 800, w) AS INTEGER) AS x1, CAST(least(y + 800, h) AS INTEGER) AS y1
FROM (SELECT p_partkey, p_size * 60 AS w, p_size * 85 AS h FROM part), unnest(range(0, greatest(w - 100, 1), 700)) AS u(x), unnest(range(0, greatest(h - 100, 1), 700)) AS v(y)""")
def _(spark, d):
    sized = t(spark, d, "part").select("p_partkey", (F.col("p_size") * 60).alias("w"), (F.col("p_size") * 85).alias("h"))
    return image_regions(sized, "w", "h", 800, 100).drop("w", "h")


@query("udf1_rule_extract", "SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+', 0), '') AS mail, nullif(regexp_extract(text, '[0-9]{6,}', 0), '') AS number FROM documents")
def _(spark, d):
    return rule_extract(t(spark, d, "documents").select("doc_id", "text"), "text", {"mail": "[A-Za-z0-9._]+@[A-Za-z0-9.]+", "number": "[0-9]{6,}"}).drop("text")


@query("udf3_classify_attempts", """SELECT user_id, tries, CASE WHEN last IN ('purchase', 'view', 'click') THEN 'done' WHEN last <> 'error' THEN 'stop' WHEN tries < 15 THEN 'retry' ELSE 'give_up' END AS next_action
FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS tries, arg_max(event_type, ts) AS last FROM events GROUP BY 1)""")
def _(spark, d):
    return B.classify_attempts(t(spark, d, "events"), "user_id", "ts", "event_type", ("error",), ("purchase", "view", "click"), 15)


@query("udf1_extract", "SELECT doc_id, 'ok' AS status, nullif(regexp_extract(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+', 0), '') AS answer FROM documents")
def _(spark, d):
    """A service in Python asked about every text, two calls at once over all partitions."""

    def mail(text: str) -> str | None:
        found = re.search(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", text)
        return found and found[0]

    at = scratch(spark, "asked")
    ask_rounds(t(spark, d, "documents").select("doc_id", "text"), ["doc_id"], at, mail, "text", unit=500)
    return attempts(spark, at).select("doc_id", "status", "answer")


_SCRIPT = """s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events),
a AS (SELECT u.user_id, i AS try_no, CASE WHEN event_type <> 'error' THEN event_type END AS answer
  FROM (SELECT DISTINCT user_id FROM events) AS u CROSS JOIN range(1, 4) AS r(i) LEFT JOIN s ON s.user_id = u.user_id AND t = i),
f AS (SELECT user_id, min(try_no) FILTER (answer IS NOT NULL) AS first FROM a GROUP BY 1)"""


def _asked_by_script(spark, d):
    """Rounds in which a user's n-th event is the answer to the n-th try: an error is a temporary
    failure, as is an event that isn't there."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    script = t(spark, d, "events").select("user_id", F.row_number().over(order).alias("try_no"), F.nullif("event_type", F.lit("error")).alias("answer"))

    def asks(left: DataFrame) -> DataFrame:
        status = F.when(F.col("answer").isNotNull(), "ok").otherwise("temporary")
        return left.join(script, ["user_id", "try_no"], "left").select("user_id", "try_no", status.alias("status"), "answer", F.lit("busy").alias("cause"))

    return run_rounds(t(spark, d, "events").select("user_id").distinct(), ["user_id"], scratch(spark, "rounds"), asks, 3)


@query("udf3_attempts", f"WITH {_SCRIPT} SELECT a.user_id, CAST(try_no AS INTEGER) AS try_no, CASE WHEN answer IS NULL THEN 'temporary' ELSE 'ok' END AS status, answer, CAST(try_no AS INTEGER) AS round FROM a JOIN f ON a.user_id = f.user_id WHERE try_no <= coalesce(first, 3)")
def _(spark, d):
    return _asked_by_script(spark, d).select("user_id", "try_no", "status", "answer", "round")


@query("udf3_retry_rounds", f"WITH {_SCRIPT} SELECT f.user_id, answer, CASE WHEN first IS NULL THEN 'no answer after 3 tries: busy' ELSE '' END AS reasons FROM f LEFT JOIN a ON a.user_id = f.user_id AND a.try_no = f.first")
def _(spark, d):
    out = route_answers(_asked_by_script(spark, d), ["user_id"], 3)
    return out.select("user_id", "answer", F.array_join("reasons", ";").alias("reasons"))


@query("udf2_block_reader", "SELECT doc_id AS file_id, CAST(i - 1 AS INTEGER) AS block_no, CAST(i AS INTEGER) AS para, string_split(text, chr(10))[i] AS text, 'read' AS status FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i) WHERE lang <> 'es' UNION ALL SELECT doc_id, NULL, NULL, NULL, 'failed: ValueError' FROM documents WHERE lang = 'es'")
def _(spark, d):
    """Texts as files: one kind has a reader that is plugged in, the other has none."""

    def lines(content: bytes):
        for i, line in enumerate(content.decode().split("\n"), 1):
            yield "para", i, None, None, line

    path = F.concat(F.col("doc_id").cast("string"), F.when(F.col("lang") == "es", ".pdf").otherwise(".txt"))
    files = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_id"), path.alias("path"), F.col("text").cast("binary").alias("content"))
    return read_blocks(files, {"txt": lines}).select(F.col("file_id").cast("long").alias("file_id"), "block_no", "para", "text", "status")


class PagedLines(Reader):
    """Plain text whose pages end with a form feed: a part is a page's place in the file."""

    def parts(self, file, size):
        cuts, at = [0], 0
        while piece := file.read(1 << 16):
            cuts += [at + i + 1 for i, c in enumerate(piece) if c == 0x0C]
            at += len(piece)
        return [(n, a, b) for n, (a, b) in enumerate(zip(cuts, [*cuts[1:], size], strict=True), 1)]

    def read(self, file, part):
        page, a, b = part
        file.seek(a)
        for line in file.read(b - a).decode().rstrip("\f").split("\n"):
            yield Block("pdf", page=page, text=line)


def _as_files(spark, d, at: str) -> None:
    """Each text as a file in the shared folder: of one language with three lines a page, of the others as Word files."""

    def write(batches):
        for b in batches:
            for i, text, lang in zip(b["doc_id"], b["text"], b["lang"], strict=True):
                lines, raw = text.split("\n"), io.BytesIO()
                if lang == "fr":
                    raw.write("\f".join("\n".join(lines[k : k + 3]) for k in range(0, len(lines), 3)).encode())
                else:
                    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
                        paras = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in lines)
                        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{paras}</w:body></w:document>')
                with new_file(f"{at}/{i % 100}/{i}.{'pages' if lang == 'fr' else 'docx'}") as f:
                    f.write(raw.getvalue())
            yield b[["doc_id"]]

    t(spark, d, "documents").select("doc_id", "text", "lang").where("text IS NOT NULL").mapInPandas(write, "doc_id long").agg(F.count("*")).collect()


_BLOCKS = """SELECT doc_id, CAST(CASE WHEN lang = 'fr' THEN (i - 1) // 3 ELSE 0 END AS INTEGER) AS part, CAST(CASE WHEN lang = 'fr' THEN (i - 1) % 3 ELSE i - 1 END AS INTEGER) AS block_no,
  CASE WHEN lang = 'fr' THEN concat('page ', (i - 1) // 3 + 1) ELSE concat('paragraph ', i) END AS position, string_split(text, chr(10))[i] AS text, 'read' AS status
FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)"""


def _shown(blocks: DataFrame) -> DataFrame:
    place = format_location(*(F.col(c) for c in ("kind", "page", "para", "row", "col")))
    return blocks.select(F.regexp_extract("file_id", r"([0-9]+)\.[a-z]+$", 1).cast("long").alias("doc_id"), "part", "block_no", place.alias("position"), "text", "status")


@query("src2_document_blocks", _BLOCKS)
def _(spark, d):
    """Texts as Word files and as files with pages, read by the data source."""
    at = scratch(spark, "files")
    _as_files(spark, d, at)
    spark.dataSource.register(block_source({"pages": PagedLines()}))
    return _shown(spark.read.format("document_blocks").load(at))


@query("udf2_read_parts", _BLOCKS)
def _(spark, d):
    """The same, listed and planned by tasks."""
    at = scratch(spark, "files")
    _as_files(spark, d, at)
    return _shown(document_blocks(list_files(spark, [at], ("docx", "pages")).select("path"), {"pages": PagedLines()}))


@query("src1_list_files", """SELECT doc_id, strlen(text) AS n_bytes, sha256(text) AS sha FROM documents WHERE lang IN ('en', 'de') AND source <> (SELECT min(source) FROM documents) AND text IS NOT NULL""")
def _(spark, d):
    """Texts as files in a folder for each source, of kinds that are input for some languages; two
    folders are left out: the least source's and that of texts without one."""
    at = scratch(spark, "sources")
    docs = t(spark, d, "documents")
    # any source's text gives a folder's name; a row's number tells files of one doc_id apart
    folder = F.coalesce(F.sha2("source", 256), F.lit("none"))
    rows = docs.withColumn("name", F.concat_ws("_", F.monotonically_increasing_id(), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.where("text IS NOT NULL").select("name", "text", "lang", folder.alias("folder"))

    def write(batches):
        kinds = {"en": "PDF", "de": "docx"}
        for b in batches:
            for name, text, lang, own in zip(b["name"], b["text"], b["lang"], b["folder"], strict=True):
                with new_file(f"{at}/{own}/{name}.{kinds.get(lang, 'xlsx')}") as f:
                    f.write(text.encode())
            yield b[["name"]]

    rows.mapInPandas(write, "name string").agg(F.count("*")).collect()
    least = docs.agg(F.sha2(F.min("source"), 256)).first()[0]
    files = list_sources(spark, [at], exclude=(f"{at}/{least}", f"{at}/none"))
    doc_id = F.nullif(F.regexp_extract("path", r"_(-?[0-9]*)\.[A-Za-z]+$", 1), F.lit("")).cast("long")
    return files.select(doc_id.alias("doc_id"), "n_bytes", content_hash(F.col("content")).alias("sha"))


@query("snk1_write_ledger", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 'review' ELSE 'normal' END AS sheet FROM orders")
def _(spark, d):
    rows, out = t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), scratch(spark, "ledger")
    write_ledger(rows.where("o_orderstatus <> 'P'"), rows.where("o_orderstatus = 'P'"), out, "1")
    return B.full_batch_view(latest_export(spark, out).drop("run_id"), latest_export(spark, out, "review").drop("run_id"))


@query("snk3_differences", """SELECT 'expected' AS side, o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'actual', o_orderkey, o_custkey + 1, o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '5-LOW'""")
def _(spark, d):
    """A table is written with rows that were changed or left out, read back, and these are named."""
    rows, at = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"), scratch(spark, "damaged")
    wrong = F.col("o_orderstatus") == "P"
    damaged = rows.where(~wrong | (F.col("o_orderpriority") != "5-LOW")).withColumn("o_custkey", F.when(wrong, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    damaged.write.parquet(at)
    return differences(rows, spark.read.parquet(at), ["o_orderkey"]).select("side", "o_orderkey", "o_custkey", "o_orderpriority")


@query("win5_cut_sheets", """WITH RECURSIVE v AS (SELECT o_custkey, count(*) AS n, min(struct_pack(a := o_orderdate, b := o_orderkey)) AS f FROM orders GROUP BY 1),
i AS (SELECT *, row_number() OVER (ORDER BY f) AS i FROM v),
s AS (SELECT i, 1 AS sheet, n AS used, CAST(0 AS BIGINT) AS base FROM i WHERE i = 1 UNION ALL
SELECT i.i, CASE WHEN used + n > 60 THEN sheet + 1 ELSE sheet END, CASE WHEN used + n > 60 THEN n ELSE used + n END, CASE WHEN used + n > 60 THEN 0 ELSE used END FROM s JOIN i ON i.i = s.i + 1)
SELECT o_orderkey, o.o_custkey, CAST(sheet AS INTEGER) AS sheet_no, base + 4 + row_number() OVER (PARTITION BY o.o_custkey ORDER BY o_orderdate, o_orderkey) AS row_no
FROM orders AS o JOIN i ON i.o_custkey = o.o_custkey JOIN s ON s.i = i.i""")
def _(spark, d):
    """A customer's orders as a voucher, sheets of 60 rows from row 5 on."""
    rows = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return cut_sheets(rows, "o_custkey", ["o_orderdate", "o_orderkey"], 60, 5).drop("o_orderdate")


@query("snk1_export_job", """SELECT CASE WHEN o_orderstatus = 'P' THEN 'review' ELSE 'normal' END AS sheet, CAST((k - 1) // 1000 + 1 AS INTEGER) AS sheet_no, (k - 1) % 1000 + 2 AS row_no,
  CAST(o_orderkey AS VARCHAR) AS contract, CAST(NULL AS VARCHAR) AS gap_2, CAST(o_custkey AS VARCHAR) AS party, concat('order ', o_orderkey) AS source_file,
  CASE WHEN o_orderstatus = 'P' THEN 'pending' END AS review_reason
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey) AS k FROM orders)""")
def _(spark, d):
    """Orders in a template's columns, on sheets of 1,000 rows, checked, written and read back."""
    fields = F.create_map(F.lit("contract"), F.col("o_orderkey").cast("string"), F.lit("party"), F.col("o_custkey").cast("string"))
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", fields.alias("fields"), F.format_string("order %d", "o_orderkey").alias("source_file"))
    pending, out = F.col("o_orderstatus") == "P", scratch(spark, "export")
    export_job(rows.where(~pending), rows.where(pending).withColumn("review_reason", F.lit("pending")), ["contract", None, "party"], "o_orderkey", ["o_orderdate", "o_orderkey"], out, "1", 1000)
    return B.full_batch_view(latest_export(spark, out).drop("run_id"), latest_export(spark, out, "review").drop("run_id"))


@query("snk2_save_results", """SELECT o_orderpriority AS batch_id, o_orderkey AS file_id, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS attempt FROM orders WHERE o_orderstatus <> 'P' OR o_custkey % 2 = 0""")
def _(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_orderpriority").alias("batch_id"), F.col("o_orderkey").alias("file_id"), "o_custkey", "o_orderstatus")
    store, under_review = scratch(spark, "store"), rows.where("o_orderstatus = 'P'")
    save_results(rows.drop("o_orderstatus").withColumn("attempt", F.lit(1)), store)
    # of the files that are tried again some have no result this time
    again = under_review.where("o_custkey % 2 = 0").drop("o_orderstatus").withColumn("attempt", F.lit(2))
    replace_results(under_review.select("batch_id", "file_id"), again, store)
    return saved_results(spark, store)


@query("str1_resume_stream", "SELECT event_id, user_id, upper(event_type) AS event_type FROM events")
def _(spark, d):
    """Intake of the table's files as a stream; a second run finds nothing new."""
    at = scratch(spark, "stream")
    own = t(spark, d, "events").select("event_id", "user_id", "event_type")
    own.where("event_type = 'error'").write.mode("append").parquet(f"{at}/in")
    take = lambda: resume_stream(spark, f"{at}/in", "event_id long, user_id long, event_type string", f"{at}/out", f"{at}/mark", lambda x: x.withColumn("event_type", F.upper("event_type"))).awaitTermination()
    take()
    own.where("event_type <> 'error' OR event_type IS NULL").write.mode("append").parquet(f"{at}/in")
    take()
    take()
    return spark.read.parquet(f"{at}/out").select("event_id", "user_id", "event_type")


@query("str1_intake", """WITH v AS (SELECT CAST(user_id AS VARCHAR) AS path, event_id AS seq, concat(event_type, ' ', CAST(floor(value) AS BIGINT)) AS text FROM events),
l AS (SELECT path, arg_max(text, seq) AS text FROM v GROUP BY 1) SELECT min(path) AS path, count(*) AS n_paths, upper(text) AS found FROM l GROUP BY text""")
def _(spark, d):
    """Users as files whose contents change with each event: errors arrive first, whatever their
    time, then the others, then all once more. Each content is worked on once."""
    at, key = scratch(spark, "intake"), "spark.sql.streaming.stateStore.providerClass"
    text = F.concat("event_type", F.lit(" "), F.floor("value").cast("string"))
    rows = t(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), content_hash(text).alias("sha"), F.col("event_id").alias("seq"), text.alias("text"))
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        for part in (rows.where("text LIKE 'error%'"), rows.where("text NOT LIKE 'error%'"), rows):
            part.write.mode("append").parquet(f"{at}/in")
            arrivals = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
            intake_stream(arrivals, f"{at}/store", f"{at}/mark", "b", lambda x: x.select("file_id", F.upper("text").alias("found")), 4).awaitTermination()
    finally:
        spark.conf.set(key, before)
    return intake_results(spark, f"{at}/store", "b").select("path", "n_paths", "found")
