"""Golden cases, invariants, and sources and sinks on files made here."""

import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.fields import as_identifier, blank_status, config_fingerprint, parse_amount, stated_date
from ledgerloom.functions.fragments import fragment_text
from ledgerloom.jobs.batch import retry_batch, run_batch
from ledgerloom.jobs.ledgers import invoice_job
from ledgerloom.jobs.voucher import voucher_job
from ledgerloom.operators import batches as B
from ledgerloom.operators import checks as C
from ledgerloom.operators import ledgers as L
from ledgerloom.operators.extract import extract
from ledgerloom.sources.files import list_sources, read_blocks
from ledgerloom.sources.store import latest_export, read_csv_ledger, replace_results, save_results, saved_results, verify_export, write_ledger
from ledgerloom.streaming.resume import resume_stream

ENTRY = "v string, seq int, org string, currency string, unit string, debit decimal(18,2), credit decimal(18,2)"


def entry(spark, *rows):
    from decimal import Decimal

    return spark.createDataFrame([(v, s, o, c, u, d and Decimal(d), k and Decimal(k)) for v, s, o, c, u, d, k in rows], ENTRY)


def test_voucher_has_a_row_for_each_entry_and_no_summary(spark):
    e = entry(spark, ("1", 1, "a", "X", "元", "100", None), ("1", 2, "a", "X", "元", "13", None), ("1", 3, "a", "X", "元", None, "113"))
    out = voucher_job(spark.createDataFrame([("1", "h")], "v string, head string"), e, "v", ["org"]).orderBy("seq").collect()
    assert [(r.seq, r.head, r.route) for r in out] == [(1, "h", "normal"), (2, "h", "normal"), (3, "h", "normal")]


def test_balance_is_not_struck_across_currencies_or_units(spark):
    e = entry(spark, ("1", 1, "a", "X", "元", "100", None), ("1", 2, "a", "Y", "元", None, "100"), ("2", 1, "a", "X", "万元", "1", None), ("2", 2, "a", "X", "元", None, "10000"))
    assert [r.balanced for r in C.voucher_balance(e, ["v", "currency", "unit"], "debit", "credit").collect()] == [False] * 4


def test_header_conflict_goes_to_review(spark):
    e = entry(spark, ("1", 1, "a", "X", "元", "5", None), ("1", 2, "b", "X", "元", None, "5"))
    out = voucher_job(spark.createDataFrame([("1",)], "v string"), e, "v", ["org"]).collect()
    assert {r.route for r in out} == {"review"} and list(out[0].reasons) == ["conflict in org"]


def test_entries_without_a_key_and_several_headers(spark):
    e = entry(spark, *[(None, i, str(i), "X", "元", "5", None) for i in range(50)], ("1", 1, "a", "X", "元", "5", "5"), ("1", 2, "a", "X", "元", "5", "5"), ("2", 1, "a", "X", "元", "5", "5"))
    heads = spark.createDataFrame([("1", "h"), ("1", "other"), ("2", "h"), ("2", "h"), (None, "x")], "v string, head string")
    out = voucher_job(heads, e, "v", ["org"]).collect()
    assert len(out) == 53 and {(r.v, r.route, *r.reasons) for r in out} == {(None, "review", "no header"), ("1", "review", "several headers"), ("2", "normal")}
    assert L.voucher_ledger(heads, e, "v").count() == 53
    assert {r.v for r in C.voucher_balance(e, ["v", "currency", "unit"], "debit", "credit").collect()} == {"1", "2"}
    assert C.header_conflict(e, "v", ["org", "seq"]).collect() == [("1", "seq", "1,2")]


def test_minutes(spark):
    topics = spark.createDataFrame([(1,), (2,)], "topic int")
    todos = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "topic int, task string, owner string")
    out = L.minutes_ledger(topics, todos, "topic").collect()
    assert sorted((r.topic, r.task or "") for r in out) == [(1, "a"), (1, "b"), (2, "")]


def test_contract_total_stays_blank_and_instalments_aligned(spark):
    c = spark.createDataFrame([("k", None)], "no string, total decimal(18,2)")
    i = spark.createDataFrame([("k", 1, "sign", "30"), ("k", 2, None, "70")], "no string, seq int, cond string, share string")
    r = L.contract_ledger(c, i, "no", ["seq"], ["cond", "share"]).first()
    assert (r.total, r.cond_lines, r.share_lines) == (None, "sign\n", "30\n70")


def test_amounts_identifiers_blanks_and_dates(spark):
    df = spark.createDataFrame([("0",), ("-3.10 元",), ("",), (None,), ("1.005",), ("CNY 1,200.50 万元",)], "x string")
    got = [(None if r.a.value is None else str(r.a.value), r.a.currency, r.a.unit) for r in df.select(parse_amount(F.col("x")).alias("a")).collect()]
    assert got == [("0.00", None, None), ("-3.10", None, "元"), (None, None, None), (None, None, None), (None, None, None), ("1200.50", "CNY", "万元")]
    one = spark.createDataFrame([("0012 ", "???", "soon", "2024年3月5日")], "a string, b string, c string, d string")
    r = one.select(as_identifier(F.col("a")).alias("a"), blank_status(F.col("b")).alias("b"), stated_date(F.col("c")).alias("c"), stated_date(F.col("d")).alias("d")).first()
    assert (r.a, r.b, r.c.date, r.d.date) == ("0012", "unreadable", None, datetime.date(2024, 3, 5))


def test_fragments_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(237))
    parts = fragment_text(spark.createDataFrame([(text,), ("",), (None,)], "text string"), size=50, overlap=10).collect()
    own = [r for r in parts if r.text == text]
    assert own[0].fragment + "".join(r.fragment[10:] for r in own[1:]) == text and len(parts) == len(own) + 2
    with pytest.raises(ValueError):
        fragment_text(spark.createDataFrame([("a",)], "text string"), size=5, overlap=5)


def test_template(spark):
    rows = spark.createDataFrame([({"a": "1", "b": "2", "c": "3"},)], "fields map<string,string>")
    assert B.template_fields(rows, ["a", "b", None, "c"]).first() == ("1", "2", None, "3")
    for bad in (["a", "a"], [" "], ["note"]):
        with pytest.raises(ValueError):
            B.template_fields(rows, bad)


def test_capacity_stops_the_export(spark):
    found = C.capacity_check(spark.createDataFrame([(1, "x" * 11, 5)], "id int, t string, n int"), "id", ["t", "n"], max_chars=10)
    assert found.collect() == [(1, "t", 11)]
    with pytest.raises(ValueError):
        C.stop_if_any(found, "too long")


def test_fingerprint_ignores_the_key(spark):
    one = spark.range(1)
    a, b = (one.select(config_fingerprint(model=F.lit(m), service=F.lit("s")).alias("f")).first().f for m in ("m", "n"))
    assert a != b
    with pytest.raises(ValueError):
        config_fingerprint(access_key=F.lit("k"))


def test_retry_replaces_one_file_only(spark):
    saved = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "file_id string, v int")
    again = spark.createDataFrame([("a", 9)], "file_id string, v int")
    out = B.replace_file_results(saved, again, again.select("file_id"), "file_id")
    assert sorted(out.collect()) == [("a", 9), ("b", 3)]


def test_row_positions_follow_the_order(spark):
    df = spark.range(0, 500).select((F.col("id") * 7919 % 503).alias("k")).repartition(7)
    out = B.row_positions(df, ["k"], start=3).orderBy("row_no").collect()
    assert [r.row_no for r in out] == list(range(3, 503)) and [r.k for r in out] == sorted(r.k for r in out)


def docx(path, lines, cell):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    table = f"<w:tbl><w:tr><w:tc><w:p><w:r><w:t>{cell}</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}{table}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}><w:p><w:r><w:t>head</w:t></w:r></w:p></w:hdr>")


def test_files_to_blocks(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/work").mkdir()
    docx(tmp_path / "in/sub/a.docx", ["one", "two"], "cell")
    docx(tmp_path / "in/work/own.docx", ["x"], "y")
    (tmp_path / "in/bad.docx").write_bytes(b"no zip")
    (tmp_path / "in/old.xlsx").write_bytes(b"x")
    files = list_sources(spark, [str(tmp_path / "in")], exclude=(f"file:{tmp_path}/in/work",))
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.select("path").collect()) == ["a.docx", "bad.docx"]
    blocks = read_blocks(files.withColumn("file_id", F.regexp_extract("path", "([^/]+)$", 1))).collect()
    got = [(r.kind, r.para, r.row, r.col, r.text) for r in sorted((b for b in blocks if b.file_id == "a.docx"), key=lambda b: b.block_no)]
    assert got == [("header", None, None, None, "head"), ("para", 1, None, None, "one"), ("para", 2, None, None, "two"), ("cell", None, 1, 1, "cell")]
    assert [b.status for b in blocks if b.file_id == "bad.docx"] == ["failed: BadZipFile"]


def test_store_and_exports(spark, tmp_path):
    rows = spark.createDataFrame([("b", f"f{i}", i, None if i % 2 else "") for i in range(20)], "batch_id string, file_id string, v int, note string")
    out = str(tmp_path / "out")
    paths = write_ledger(rows, rows.limit(0), out, "1")
    write_ledger(rows.where("v < 5"), rows.limit(0), out, "2")
    with pytest.raises(Exception, match="(?i)exists"):
        write_ledger(rows, rows, out, "2")
    assert latest_export(spark, out).count() == 5
    assert all(r.ok for r in verify_export(rows, paths[0]).collect())
    assert not any(r.ok for r in verify_export(rows.where("v > 0"), paths[0]).collect())
    csv = write_ledger(rows, rows.limit(0), out, "3", "csv")[0]
    back = read_csv_ledger(spark, csv, rows.schema.simpleString()[7:-1].replace(":", " "))
    assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
    store = str(tmp_path / "store")
    save_results(rows, store)
    save_results(rows, store)
    assert spark.read.parquet(store).count() == 20


def test_extractor_plugs_in(spark):
    def ask(batches):
        for b in batches:
            yield b.assign(n=b.text.str.len())[["n"]]

    assert sorted(extract(spark.createDataFrame([("a",), ("bcd",)], "text string"), ask, "n long").collect()) == [(1,), (3,)]


def test_stream_resumes_without_repeats(spark, tmp_path):
    src, store, mark = (str(tmp_path / x) for x in ("src", "store", "mark"))
    run = lambda: resume_stream(spark, src, "id long", store, mark, lambda df: df.withColumn("twice", F.col("id") * 2), 1).awaitTermination()
    spark.range(0, 10).coalesce(2).write.parquet(src)
    run()
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    assert sorted((r.id, r.twice) for r in spark.read.parquet(store).collect()) == [(i, 2 * i) for i in range(15)]


def test_routing_is_complete(spark):
    df = spark.createDataFrame([(1, []), (2, ["x"]), (3, None)], "id int, reasons array<string>")
    a, b = C.split_review(df)
    assert sorted(r.id for r in a.collect()) == [1, 3] and [r.id for r in b.collect()] == [2]


def test_invoice_without_items_stays(spark):
    heads = spark.createDataFrame([("1", "5.00"), ("2", None), ("3", "7.00")], "no string, total string").withColumn("total", F.col("total").cast("decimal(18,2)"))
    items = spark.createDataFrame([("3", 1, "3.00", 2, "1.50"), ("3", 2, "4.00", 3, "1.00")], "no string, seq int, a string, q int, p string")
    items = items.withColumn("a", F.col("a").cast("decimal(18,2)")).withColumn("p", F.col("p").cast("decimal(18,2)"))
    rows = {r.no: r for r in invoice_job(heads, items, "no", ["seq"], F.col("seq").cast("string"), "a", "total", "q", "p").collect()}
    assert [(rows[k]["items"], list(rows[k].reasons), rows[k].route) for k in "123"] == [
        ("", ["total without items"], "review"), ("", [], "normal"), ("1\n2", ["quantity x price differs from amount"], "review"),
    ]


def test_entry_without_header_goes_to_review(spark):
    e = entry(spark, ("1", 1, "a", "X", "元", "5", "5"), ("9", 1, "a", "X", "元", "5", "5"), (None, 1, "a", "X", "元", "5", "5"))
    out = voucher_job(spark.createDataFrame([("1", "h")], "v string, head string"), e, "v", ["org"]).collect()
    assert sorted((r.v or "", r.route, list(r.reasons)) for r in out) == [("", "review", ["no header"]), ("1", "normal", []), ("9", "review", ["no header"])]


def test_errors_that_trying_again_cannot_help_stop(spark):
    rows = [("a", 1, "busy"), ("a", 2, "bad_key"), ("b", 1, "busy"), ("c", 1, "busy"), ("c", 2, "ok"), ("d", 1, "busy"), ("d", 2, "busy")]
    out = B.classify_attempts(spark.createDataFrame(rows, "f string, t int, s string"), "f", "t", "s", ("busy",), ("ok",), 2)
    assert {r.f: r.next_action for r in out.collect()} == {"a": "stop", "b": "retry", "c": "done", "d": "give_up"}


def test_source_drift_tells_all_four_states(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "path string, sha string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("n", "1")], "path string, sha string")
    assert {r.path: r.state for r in B.source_drift(a, b, "path", "sha").collect()} == {"x": "same", "y": "changed", "z": "missing", "n": "new"}


def test_a_run_that_was_broken_off_does_not_count(spark, tmp_path):
    rows, out = spark.createDataFrame([(1,)], "v int"), f"file://{tmp_path}/out"
    write_ledger(rows, rows.limit(0), out, "1")
    rows.union(rows).write.parquet(f"{out}/normal/run_id=2")
    assert latest_export(spark, out).count() == 1 and latest_export(spark, out, "review").count() == 0


def test_batch_resumes_and_retries(spark, tmp_path):
    files = spark.createDataFrame([(f"f{i}", f"p{i}", str(i)) for i in range(12)], "file_id string, path string, sha string")
    store, asked = f"file://{tmp_path}/batch", spark.sparkContext.accumulator(0)

    def work(route):
        def f(df):
            asked.add(df.count())
            return df.select("file_id", F.lit(1).alias("v"), F.when(F.col("file_id") == "f3", "review").otherwise(route).alias("route"))

        return f

    config = {"model": "m", "service": "s"}
    assert run_batch(spark, store, "b", config, files, work("normal")).count() == 12 and asked.value == 12
    assert run_batch(spark, store, "b", config, files, work("normal")).count() == 12 and asked.value == 12
    with pytest.raises(ValueError, match="conditions"):
        run_batch(spark, store, "b", config | {"model": "other"}, files, work("normal"))
    with pytest.raises(ValueError, match="sources"):
        run_batch(spark, store, "b", config, files.withColumn("sha", F.lit("0")), work("normal"))
    after = retry_batch(spark, store, "b", config, files, lambda df: df.select("file_id", F.lit(2).alias("v"), F.lit("normal").alias("route")))
    assert {r.file_id: r.v for r in after.collect()} == {f"f{i}": 2 if i == 3 else 1 for i in range(12)}
    replace_results(files.where("file_id = 'f5'").select(F.lit("b").alias("batch_id"), "file_id"), after.limit(0), f"{store}/results", 4)
    assert saved_results(spark, f"{store}/results").count() == 11


def test_tables_within_cells_and_images_are_read_once():
    import io

    from ledgerloom.sources.files import docx_blocks

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    text = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    table = lambda x: f"<w:tbl><w:tr><w:tc>{x}</w:tc></w:tr></w:tbl>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{table(text('a') + table(text('b')))}</w:body></w:document>")
        z.writestr("word/media/image1.png", b"x")
    assert list(docx_blocks(raw.getvalue())) == [("cell", None, 1, 1, "ab"), ("picture", None, None, None, "word/media/image1.png")]
