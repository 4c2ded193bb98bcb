"""Rounds of asking, the gate, and batches that ask a service."""

import os
import socket
import subprocess
import sys
import textwrap
import threading
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.jobs.batch import asked_work, retry_batch, run_batch
from ledgerloom.jobs.rounds import Stopped, ask_rounds, attempts, finished_rounds, route_answers, run_rounds, standing
from ledgerloom.operators.extract import PermanentFailure, TemporaryFailure, ask
from ledgerloom.operators.gate import Address, Closed, Gate, place, visit


def noted(folder, answer):
    """A service that writes down each call as a file, and then answers, or fails, by the n-th call."""
    os.makedirs(folder, exist_ok=True)

    def call(text):
        n = sum(x.startswith(f"{text}-") for x in os.listdir(folder)) + 1
        open(f"{folder}/{text}-{n}-{time.time_ns()}", "x").close()
        return answer(text, n)

    return call


def calls(folder):
    return Counter(x.split("-")[0] for x in os.listdir(folder))


def files(spark, n):
    return spark.createDataFrame([(f"f{i}", f"p{i}", str(i)) for i in range(n)], "file_id string, path string, sha string")


def test_each_is_asked_as_often_as_the_limit_says(spark, tmp_path):
    def answer(text, n):
        if text == "f3" or text == "f4" and n < 3:
            raise TemporaryFailure("busy")
        if text == "f5":
            raise ValueError("no sense")
        return text.upper()

    call = noted(tmp_path / "calls", answer)
    requests = files(spark, 9).select("file_id", F.col("file_id").alias("request"))
    said = ask_rounds(requests, ["file_id"], f"file://{tmp_path}/store", call, max_tries=3)
    assert calls(tmp_path / "calls") == {f"f{i}": 3 if i in (3, 4, 5) else 1 for i in range(9)}
    state = {r.file_id: (r.tries, r.next_action) for r in standing(said, ["file_id"], 3).collect()}
    assert state == {f"f{i}": (3, "give_up") if i in (3, 5) else (2 if i == 4 else 0, "done") for i in range(9)}
    assert {(r.file_id, r.try_no, r.round) for r in said.collect() if r.file_id == "f4"} == {("f4", k, k) for k in (1, 2, 3)}
    routed = {r.file_id: (r.answer, r.reasons) for r in route_answers(said, ["file_id"], 3).collect()}
    assert routed["f4"] == ("F4", []) and routed["f5"] == (None, ["no answer after 3 tries: ValueError: no sense"])
    # nothing is open, so nothing is asked
    ask_rounds(requests, ["file_id"], f"file://{tmp_path}/store", call, max_tries=3)
    assert sum(calls(tmp_path / "calls").values()) == 15


def test_a_permanent_failure_stops_and_keeps_what_was_saved(spark, tmp_path):
    key = tmp_path / "key"
    key.write_text("right")

    def answer(text, n):
        if text == "f2" and n == 1:
            raise TemporaryFailure("busy")
        if key.read_text() == "wrong":
            raise PermanentFailure("bad key")
        return "yes"

    call, store = noted(tmp_path / "calls", answer), f"file://{tmp_path}/store"
    requests = files(spark, 40).select("file_id", F.col("file_id").alias("request"))
    ask_rounds(requests.where("file_id < 'f2'"), ["file_id"], store, call)
    first = sum(calls(tmp_path / "calls").values())
    key.write_text("wrong")
    with pytest.raises(Stopped, match="stop"):
        ask_rounds(requests, ["file_id"], store, call, at_once=1, unit=4)
    # one call met the wrong key; the gate was closed before any other
    said = attempts(spark, store)
    assert said.where("status = 'permanent'").count() == 1 and said.where("status = 'ok'").count() == first
    key.write_text("right")
    out = ask_rounds(requests, ["file_id"], store, call)
    assert {r.next_action for r in standing(out, ["file_id"], 3).collect()} == {"done"}
    assert out.where("status = 'ok'").count() == 40


def test_no_more_calls_at_once_than_places(spark, tmp_path):
    def slow(text):
        time.sleep(0.01)
        return text

    for at_once in (1, 2, 3):
        rows = spark.range(200).select("id", F.col("id").cast("string").alias("request")).repartition(100)
        with Gate(spark, at_once) as gate:
            out = ask(rows, slow, gate.address)
            out.write.mode("overwrite").parquet(str(tmp_path / "out"))
            assert gate.n_calls == 200
        out = spark.read.parquet(str(tmp_path / "out")).collect()
        assert sorted(int(r.answer) for r in out) == list(range(200))
        events = sorted([(r.began, 1) for r in out] + [(r.ended, -1) for r in out], key=lambda x: (x[0], x[1]))
        now = most = 0
        for _, step in events:
            now += step
            most = max(most, now)
        assert most == at_once


def test_a_lost_caller_frees_its_place_and_strangers_get_none(spark):
    with Gate(spark, 1) as gate:
        lost = socket.create_connection(gate.address[:2])
        lost.sendall(gate.address.token.encode() + b"\n")
        assert lost.recv(10) == b"go\n"
        got = threading.Event()

        def wait():
            with place(gate.address):
                got.set()

        t = threading.Thread(target=wait)
        t.start()
        assert not got.wait(0.2)
        lost.close()
        assert got.wait(5)
        t.join()
        with pytest.raises(ConnectionError), place(Address(*gate.address[:2], "other")):
            pass
        with place(gate.address) as lease:
            lease.close_gate("wrong\nmodel")
        time.sleep(0.1)
        with pytest.raises(Closed, match="wrong model"), place(gate.address):
            pass


def test_one_connection_serves_many_calls_and_lets_others_in_between(spark, monkeypatch):
    made, connect = [], socket.create_connection
    monkeypatch.setattr(socket, "create_connection", lambda *a, **k: made.append(a) or connect(*a, **k))
    with Gate(spark, 1) as gate, visit(gate.address) as own:
        for _ in range(50):
            with own.place():
                pass
        with pytest.raises(OSError), own.place():
            raise OSError("the call failed")
        assert len(made) == 1 and gate.n_calls == 51
        got = threading.Event()

        def wait():
            with place(gate.address):
                got.set()

        with own.place():
            t = threading.Thread(target=wait)
            t.start()
            assert not got.wait(0.2)
        assert got.wait(5)  # though the first connection is still there
        t.join()
        with own.place() as lease:
            lease.close_gate("wrong model")
        for _ in range(2):
            with pytest.raises(Closed, match="wrong model"), own.place():
                pass
        assert gate.n_calls == 54


def test_a_lost_task_repeats_its_partition_alone(tmp_path):
    """In a process of its own, where a task may fail: of 40 requests in partitions of about 4 a task
    is lost once, in the middle of its work."""
    script = """
        import os, sys
        from pyspark.sql import SparkSession
        from ledgerloom.jobs.rounds import ask_rounds
        at = sys.argv[1]
        spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", f"file://{at}/shared").getOrCreate()
        def call(text):
            open(f"{at}/calls/{text}-{os.urandom(4).hex()}", "x").close()
            if text == "17" and not os.path.exists(f"{at}/lost"):
                open(f"{at}/lost", "x").close()
                os._exit(1)
            return text
        out = ask_rounds(spark.range(40).selectExpr("id", "cast(id as string) request"), ["id"], f"file://{at}/store", call, unit=4)
        assert sorted(int(r.answer) for r in out.collect()) == list(range(40))
    """
    (tmp_path / "calls").mkdir()
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parent.parent)}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script), str(tmp_path)], env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    n = calls(tmp_path / "calls")
    assert n["17"] == 2 and len(n) == 40 and 41 <= sum(n.values()) <= 52


def test_a_round_that_was_broken_off_is_asked_again(spark, tmp_path):
    store, asked = f"file://{tmp_path}/store", []
    requests = spark.createDataFrame([(i,) for i in range(6)], "id int")

    def asks(left):
        asked.append(sorted(r.id for r in left.collect()))
        return left.select("id", "try_no", F.lit("ok").alias("status"), F.lit("a").alias("answer"), F.lit(None).cast("string").alias("cause"))

    asks(requests.where("id < 2").withColumn("try_no", F.lit(1))).write.parquet(f"{store}/attempts/round=1")  # no mark that it was finished
    asked.clear()
    assert run_rounds(requests, ["id"], store, asks).count() == 6 and asked == [[0, 1, 2, 3, 4, 5]]
    assert finished_rounds(spark, store) == [1]
    assert run_rounds(requests.limit(0), ["id"], f"file://{tmp_path}/none", asks).count() == 0


def test_a_batch_asks_once_and_a_retry_asks_review_files_alone(spark, tmp_path):
    call = noted(tmp_path / "calls", lambda text, n: "odd" if text == "p7" and n == 1 else "fine")

    def parse(answers):
        return answers.select("file_id", "answer", F.when(F.col("answer") == "odd", "review").otherwise("normal").alias("route"))

    store, config, own = f"file://{tmp_path}/batch", {"model": "m"}, files(spark, 40)
    work = asked_work(store, F.col("path"), call, parse)
    assert run_batch(spark, store, "b", config, own, work).count() == 40
    assert calls(tmp_path / "calls") == {f"p{i}": 1 for i in range(40)}
    assert run_batch(spark, store, "b", config, own, work).count() == 40
    after = retry_batch(spark, store, "b", config, own, asked_work(store, F.col("path"), call, parse, "again"))
    assert calls(tmp_path / "calls") == {f"p{i}": 2 if i == 7 else 1 for i in range(40)}
    assert {r.route for r in after.collect()} == {"normal"} and after.count() == 40
    # nothing is under review any more
    assert retry_batch(spark, store, "b", config, own, asked_work(store, F.col("path"), call, parse, "third")).count() == 40
    assert sum(calls(tmp_path / "calls").values()) == 41


def test_given_up_files_are_under_review(spark, tmp_path):
    def answer(text, n):
        raise TemporaryFailure("busy")

    store = f"file://{tmp_path}/batch"
    work = asked_work(store, F.col("path"), noted(tmp_path / "calls", answer), lambda a: a.select("file_id", "answer", F.lit("normal").alias("route")), max_tries=2)
    rows = run_batch(spark, store, "b", {"model": "m"}, files(spark, 3), work, steps=2).collect()
    assert {(r.file_id, r.route, r.reasons) for r in rows} == {(f"f{i}", "review", "no answer after 2 tries: TemporaryFailure: busy") for i in range(3)}
    assert set(calls(tmp_path / "calls").values()) == {2}
