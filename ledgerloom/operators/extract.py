"""The extractor plug-in point, and a rule extractor that needs no service."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gate import Address, Closed, Visitor, visit


class TemporaryFailure(Exception):
    """The service is busy or can't be reached; trying again later may help."""


class PermanentFailure(Exception):
    """A wrong key, address or model; trying again can't help, whatever is asked."""


#: What became of a request.
OK, TEMPORARY, PERMANENT, NOT_ASKED = "ok", "temporary", "permanent", "not_asked"
ANSWER = "status string, answer string, cause string, began double, ended double"


def extract(fragments: DataFrame, extractor: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, parallelism: int = 2) -> DataFrame:
    """Candidates of an outside extractor that takes whole partitions; at most `parallelism` of
    them call it at once, as there are no more. `ask` bounds calls over any number of partitions.
    Save the result before it is used twice, so that nothing is asked again."""
    return fragments.repartition(parallelism).mapInPandas(extractor, schema)


def ask(requests: DataFrame, call: Callable[[str], str], gate: Address, request: str = "request") -> DataFrame:
    """requests (all columns) with status, answer, cause, began and ended (seconds) of one call each.

    Calls wait for a place of the gate, so no more are under way than it has, however many
    partitions there are; make these small: a task that is lost asks again what its partition
    holds. A TemporaryFailure, and any error but a PermanentFailure, is "temporary"; a
    PermanentFailure is "permanent" and closes the gate: all calls that have not begun by then
    are "not_asked". A null request is asked as an empty text. Save the result before it is used.
    """
    own = [f for f in requests.schema.fields if f.name not in ("status", "answer", "cause", "began", "ended")]
    names = [f.name for f in own]

    def one(visitor: Visitor, text: str | None) -> tuple:
        began = None
        try:
            with visitor.place() as lease:
                began = time.time()
                try:
                    return OK, call(text or ""), None, began, time.time()
                except PermanentFailure as e:
                    lease.close_gate(f"{type(e).__name__}: {e}")
                    return PERMANENT, None, str(e), began, time.time()
                except Exception as e:  # the cause is saved with the attempt
                    return TEMPORARY, None, f"{type(e).__name__}: {e}", began, time.time()
        except Closed as e:
            return NOT_ASKED, None, str(e), None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            with visit(gate) as visitor:
                said = [one(visitor, x) for x in b[request].tolist()]
            yield pd.concat([b[names].reset_index(drop=True), pd.DataFrame(said, columns=["status", "answer", "cause", "began", "ended"])], axis=1)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), ANSWER])
    return requests.select(*names).mapInPandas(run, schema)


def rule_extract(fragments: DataFrame, text: str, rules: dict[str, str]) -> DataFrame:
    """The first match of each rule (a regular expression) as a field; null without one."""
    found = [F.nullif(F.regexp_extract(text, rule, 0), F.lit("")).alias(field) for field, rule in rules.items()]
    return fragments.select("*", *found)
