"""Files listed under a folder, however it is written."""

import pandas as pd
import pytest

from ledgerloom.jobs import queries
from ledgerloom.sources import files
from ledgerloom.sources.blocks import new_file
from ledgerloom.sources.files import block_reader, list_sources


@pytest.mark.parametrize("before", ["", "file:", "file://"])
def test_an_excluded_folder_may_be_written_in_any_way(spark, tmp_path, before):
    for name in ("in/a.pdf", "out/b.pdf", "out/deep/c.docx", "outer/d.PDF", "in/e.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    for root in ("", "file:", "file://"):
        found = list_sources(spark, [f"{root}{tmp_path}"], exclude=(f"{before}{tmp_path}/out/",)).select("path").collect()
        assert sorted(r.path.rsplit("/", 2)[-2:] for r in found) == [["in", "a.pdf"], ["outer", "d.PDF"]]


def test_the_query_leaves_its_folder_out_where_the_shared_one_has_no_scheme(spark, tmp_path, monkeypatch):
    docs = [(1, "a", "en", "s1"), (2, "b", "de", "s1"), (3, "c", "en", "s2"), (4, "d", "fr", "s2"), (5, None, "en", "s2")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries, "scratch", lambda spark, name: f"{tmp_path}/shared/{name}")
    got = queries.QUERIES["src1_list_files"](spark, str(tmp_path)).select("doc_id", "n_bytes").collect()
    assert sorted(map(tuple, got)) == [(3, 1)]


def test_the_query_keeps_repeated_ids_and_any_sources(spark, tmp_path, monkeypatch):
    """Of rows with one doc_id each has its file; a null source is no source, others may be named in any way."""
    docs = [(7, "a", "en", "s2"), (7, "b", "en", "s2"), (7, "b", "en", "s2"), (-3, "", "de", "_x/../s1"), (None, "c", "en", ".y"), (8, "d", "en", None), (9, None, "en", ""), (5, "e", "de", "s1/s2")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["src1_list_files"](spark, str(tmp_path)).select("doc_id", "n_bytes").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(7, 1), (7, 1), (7, 1), (-3, 0), (None, 1), (5, 1)], key=str)


def test_a_file_appears_whole_or_not_at_all(tmp_path):
    with pytest.raises(KeyError), new_file(f"file://{tmp_path}/x/a.pdf") as f:
        f.write(b"half")
        raise KeyError
    assert not (tmp_path / "x/a.pdf").exists()
    with new_file(f"{tmp_path}/x/a.pdf") as f:
        f.write(b"whole")
    with pytest.raises(KeyError), new_file(f"{tmp_path}/x/a.pdf") as f:
        raise KeyError
    assert (tmp_path / "x/a.pdf").read_bytes() == b"whole"


@pytest.mark.parametrize("by_tasks", [True, False])
def test_files_without_a_byte_are_listed_too(spark, tmp_path, monkeypatch, by_tasks):
    """Spark's reader of whole files leaves them out."""
    if not by_tasks:
        monkeypatch.setattr(files, "reached", lambda path: False)
    for name, content in (("x y/a.pdf", b""), ("x y/b.pdf", b"b"), ("c%20.PNG", b""), ("no.txt", b""), ("out/d.pdf", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = list_sources(spark, [str(tmp_path)], exclude=(f"{tmp_path}/out",)).select("path", "n_bytes", "content").collect()
    assert sorted((r.path.removeprefix(f"file:{tmp_path}/"), r.n_bytes, bytes(r.content)) for r in found) == [("c%20.PNG", 0, b""), ("x y/a.pdf", 0, b""), ("x y/b.pdf", 1, b"b")]


def test_the_query_keeps_empty_texts(spark, tmp_path):
    docs = [(1, "a", "en", "s1"), (2, "", "en", "s2"), (3, "b", "de", "s2"), (4, "", "fr", "s2")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["src1_list_files"](spark, str(tmp_path)).select("doc_id", "n_bytes").collect()
    assert sorted(map(tuple, got)) == [(2, 0), (3, 1)]


def test_the_driver_holds_no_list_of_files(spark, tmp_path):
    """No file stands in the plan; what is listed and read equals Spark's own listing."""
    for i in range(1, 40):
        at = tmp_path / f"in/{i % 3}/x y/{i}.{['pdf', 'PNG', 'txt', 'docx'][i % 4]}"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"%d" % i * i)
    (tmp_path / "in/_hidden").mkdir()
    (tmp_path / "in/_hidden/a.pdf").write_bytes(b"x")
    columns = ("path", "modified_at", "n_bytes", "content")
    found = list_sources(spark, [f"{tmp_path}/in", f"file:{tmp_path}/in/1"], exclude=(f"{tmp_path}/in/2",)).select(*columns)
    assert not any("/in/" in x for x in found.inputFiles())
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/in").where("lower(path) NOT LIKE '%.txt' AND path NOT LIKE '%/in/2/%'")
    own = own.selectExpr("path", "modificationTime", "length", "content").collect()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, own)) and len(own) > 15
    # a root with a pattern is Spark's to list
    assert list_sources(spark, [f"{tmp_path}/in/[01]"]).select(*columns).count() == len(own)


def test_blocks_are_passed_on_in_small_frames():
    """Of 40 MB of blocks in one batch, no frame holds more than a part; a file that breaks off gives its cause alone."""

    def lines(content):
        for i in range(2000):
            yield "para", i + 1, None, None, "x" * 1000
            if content == b"bad" and i == 5:
                raise OSError("torn")

    batch = pd.DataFrame({"file_id": [str(i) for i in range(20)], "path": ["a.txt"] * 19 + ["a.pdf"], "content": [b""] * 10 + [b"bad"] + [b""] * 9})
    frames = list(block_reader({"txt": lines})(iter([batch])))
    assert max(len(f) for f in frames) < 5000
    whole = pd.concat(frames)
    assert (whole[whole.status == "read"].groupby("file_id").size() == 2000).all() and len(whole) == 18 * 2000 + 2
    assert sorted(whole[whole.status != "read"].status) == ["failed: OSError", "failed: ValueError"]
    assert whole[whole.file_id == "3"].block_no.tolist() == list(range(2000))
