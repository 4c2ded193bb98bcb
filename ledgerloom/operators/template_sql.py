"""A template's columns as a table function of SQL, its schema made from the header when a query is planned."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .batches import check_template


class FillTemplate:
    """fill_template(TABLE(rows), header => array(...)): rows of a table with a map column `fields`,
    that column replaced by the template's, as template_fields does. header: the name at each
    position, null where a column is empty (gap_N). A bad header, or rows without such a map, fail
    when the query is planned."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, header: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table: fill_template(TABLE(rows), header => array(...))")
        if not isinstance(header.dataType, ArrayType) or header.value is None:
            raise ValueError("the header is a constant array of names")
        own = {f.name: f for f in rows.dataType.fields}
        if "fields" not in own or own["fields"].dataType != MapType(StringType(), StringType()):
            raise ValueError("the table has no column fields that maps names to texts")
        check_template(list(header.value))
        names = [f"gap_{i}" if c is None else c for i, c in enumerate(header.value, 1)]
        kept = [f for f in rows.dataType.fields if f.name != "fields"]
        if len({f.name for f in kept} | set(names)) < len(kept) + len(names):
            raise ValueError("a template column has the name of a column of the table")
        return AnalyzeResult(StructType([*kept, *(StructField(n, StringType()) for n in names)]))

    def eval(self, rows: Row, header: list[str | None]) -> Iterator[tuple[Any, ...]]:
        fields = rows["fields"] or {}
        yield (*(v for k, v in zip(rows.__fields__, rows, strict=True) if k != "fields"), *(None if c is None else fields.get(c) for c in header))


def register_fill_template(spark: SparkSession, name: str = "fill_template") -> None:
    """Makes the function known to the session's SQL. Rows go to Python in pickled batches: with
    useArrow a function with `analyze` makes a data frame and an Arrow batch of each row."""
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(FillTemplate, useArrow=False))
