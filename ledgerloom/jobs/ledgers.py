"""The invoice, contract and minutes jobs: a ledger's rows with their reasons and route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import blank_status
from ..operators.checks import amount_relation, required_fields, routed
from ..operators.ledgers import contract_ledger, invoice_ledger, minutes_ledger


def invoice_job(
    headers: DataFrame, items: DataFrame, key: str, order: list[str], line: Column, amount: str, total: str, quantity: str | None = None, price: str | None = None, tol: str = "0"
) -> DataFrame:
    """A row for each invoice with its items in one cell; an invoice whose amounts contradict
    each other goes to review. Items are dealt out by key once for ledger and check."""
    items = items.repartition(key)
    checks = amount_relation(items, headers, key, amount, total, tol, quantity, price).select(key, "reasons")
    return routed(invoice_ledger(headers, items, key, order, line).join(checks, key))


def contract_job(contracts: DataFrame, instalments: DataFrame, key: str, order: list[str], fields: list[str], required: list[str]) -> DataFrame:
    """A row for each contract, its instalments aligned line by line; one with a required field
    that can't be read goes to review, one that isn't stated has a note."""
    rows = contract_ledger(contracts, instalments, key, order, fields)
    return routed(required_fields(rows, {c: blank_status(F.col(c).cast("string")) for c in required}))


def minutes_job(topics: DataFrame, todos: DataFrame, key: str, required: list[str]) -> DataFrame:
    """A row for each to-do, one for a topic without any, routed as contracts are."""
    rows = minutes_ledger(topics, todos, key)
    return routed(required_fields(rows, {c: blank_status(F.col(c).cast("string")) for c in required}))
