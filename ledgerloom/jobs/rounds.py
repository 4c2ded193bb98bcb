"""Rounds of asking an outside service, with every attempt written down.

A round asks all requests that are open, writes what became of each (attempt and answer are one
row, so neither is ever there without the other), and only then counts as finished. What a round
that was broken off has written is written over. Between rounds the table of attempts tells
which requests are done, are asked again, are given up, or stop the work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import NOT_ASKED, OK, PERMANENT, TEMPORARY, ask
from ..operators.gate import Gate
from ..sources.store import read_if_there

#: Takes open requests (keys, try_no, ...) and gives keys, try_no, status, answer, cause.
Ask = Callable[[DataFrame], DataFrame]


class Stopped(Exception):
    """An error that trying again can't mend; all that was answered before is saved."""


def finished_rounds(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the rounds that were written whole (a row each)."""
    marks = read_if_there(spark, f"{store}/finished")
    return [] if marks is None else sorted(r[0] for r in marks.select("round").distinct().collect())


def attempts(spark: SparkSession, store: str, rounds: list[int] | None = None) -> DataFrame | None:
    """All attempts of finished rounds, with their round; None before the first."""
    rounds = finished_rounds(spark, store) if rounds is None else rounds
    if not rounds:
        return None
    return spark.read.option("basePath", f"{store}/attempts").parquet(*(f"{store}/attempts/round={k}" for k in rounds))


def standing(said: DataFrame, keys: list[str], max_tries: int, since: int = -1) -> DataFrame:
    """(keys, tries, next_action) by the attempts: done, retry (a temporary failure with tries left),
    give_up (without), stop (a permanent failure in a round after `since`; an older one is asked
    again, as its cause may have been mended). Requests that were not asked don't count."""
    newest = F.max_by(F.struct("status", "round"), "round").alias("last")
    out = said.where(F.col("status") != NOT_ASKED).groupBy(*keys).agg(F.count_if(F.col("status") == TEMPORARY).alias("tries"), newest)
    last = F.col("last.status")
    action = (
        F.when(last == OK, "done").when((last == PERMANENT) & (F.col("last.round") > since), "stop")
        .when((last == PERMANENT) | (F.col("tries") < max_tries), "retry").otherwise("give_up")
    )
    return out.select(*keys, "tries", action.alias("next_action"))


def run_rounds(requests: DataFrame, keys: list[str], store: str, asks: Ask, max_tries: int = 3) -> DataFrame:
    """Asks until each request (told apart by its keys, which are not null) is done or was tried
    max_tries times without an answer, and returns all attempts.

    Each round asks every open request once, so there are at most max_tries rounds and one for
    what a closed gate left. A permanent failure raises Stopped after its round is saved. A new
    call goes on where the last one ended: nothing that was answered is asked again.
    """
    spark, began = requests.sparkSession, max(finished_rounds(requests.sparkSession, store), default=0)
    while True:
        rounds = finished_rounds(spark, store)
        said = attempts(spark, store, rounds)
        number = max(rounds, default=0) + 1
        if said is None:
            left = requests.withColumn("try_no", F.lit(1))
        else:
            state = standing(said, keys, max_tries, began)
            if bad := state.where("next_action = 'stop'").limit(5).collect():
                raise Stopped(f"stopped in round {rounds[-1]}: {[r.asDict() for r in bad]}")
            state = state.withColumnRenamed("tries", "_tries").withColumnRenamed("next_action", "_next")
            left = requests.join(state, keys, "left").where("_next IS NULL OR _next = 'retry'")
            left = left.withColumn("try_no", (F.coalesce("_tries", F.lit(0)) + 1).cast("int")).drop("_tries", "_next")
        if left.isEmpty():
            return said if said is not None else _none(requests, keys)
        # a plain write: its files come into sight together, when all tasks have ended
        asks(left).write.mode("overwrite").parquet(f"{store}/attempts/round={number}")
        spark.createDataFrame([(number,)], "n int").coalesce(1).write.mode("overwrite").parquet(f"{store}/finished/round={number}")


def _none(requests: DataFrame, keys: list[str]) -> DataFrame:
    return requests.limit(0).select(*keys, *(F.lit(None).cast(t).alias(c) for c, t in (("try_no", "int"), ("status", "string"), ("answer", "string"), ("cause", "string"), ("round", "int"))))


def ask_rounds(
    requests: DataFrame, keys: list[str], store: str, call: Callable[[str], str], request: str = "request", max_tries: int = 3, at_once: int = 2, unit: int = 20
) -> DataFrame:
    """run_rounds by a plain function (see operators.extract.ask), at most at_once calls at a time.
    A partition holds about `unit` requests: what a lost task asks again."""
    with Gate(requests.sparkSession, at_once) as gate:

        def asks(left: DataFrame) -> DataFrame:
            left = left.select(*keys, "try_no", request)
            parts = max(1, -(-left.count() // unit))
            return ask(left.repartition(parts, *keys), call, gate.address, request).drop(request)

        return run_rounds(requests, keys, store, asks, max_tries)


def route_answers(said: DataFrame, keys: list[str], max_tries: int) -> DataFrame:
    """(keys, answer, reasons): the answer of each request that is done; a reason for each that was
    given up. Requests still open have no row."""
    state = standing(said, keys, max_tries).where("next_action IN ('done', 'give_up')")
    answer = said.where(F.col("status") == OK).groupBy(*keys).agg(F.max_by("answer", "round").alias("answer"))
    cause = said.where(F.col("status") == TEMPORARY).groupBy(*keys).agg(F.max_by("cause", "round").alias("cause"))
    out = state.join(answer, keys, "left").join(cause, keys, "left")
    gave_up: Column = F.concat(F.lit("no answer after "), F.col("tries").cast("string"), F.lit(" tries: "), F.coalesce("cause", F.lit("unknown")))
    return out.select(*keys, "answer", F.when(F.col("next_action") == "give_up", F.array(gave_up)).otherwise(F.array().cast("array<string>")).alias("reasons"))
