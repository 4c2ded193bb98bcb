"""An export as one job: fields in their columns, rows in their places, all checks, then the write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.batches import PROVENANCE, check_template, occupied_rows, template_fields
from ..operators.checks import capacity_check, stop_if_any
from ..operators.sheets import cut_sheets
from ..sources.store import write_ledger, written


def export_job(
    normal: DataFrame, review: DataFrame, columns: Sequence[str | None], key: str, order: list[str], out_dir: str, run_id: str, most: int, start: int = 2,
    existing: DataFrame | None = None, max_chars: int = 32767, max_digits: int = 15,
) -> list[str]:
    """Writes a run's two tables (see write_ledger) and returns their paths, or writes nothing.

    normal and review have a map column `fields`, the key, the order's columns and any of the columns
    that an export adds (source_file, ...). columns: the template's header at each position,
    None where a column is empty. Rows go into sheets of at most `most` rows, from row `start` on.
    The export stops, with the first places that are to blame: at a bad template; at a voucher
    that no sheet holds; at a target row (sheet_no, row_no) that existing has something in; at a
    text or number that a cell can't hold.
    """
    check_template(list(columns))
    shown = [c for c in columns if c is not None]
    ready = []
    for df in (normal, review):
        added = [c for c in PROVENANCE if c in df.columns]
        # made once: it is checked and written
        own = cut_sheets(df, key, order, most, start).select("sheet_no", "row_no", *added, "fields")
        ready.append(written(template_fields(own, list(columns)).select("sheet_no", "row_no", *(c if c is not None else f"gap_{i}" for i, c in enumerate(columns, 1)), *added), "export"))
    if existing is not None:
        place = F.struct("sheet_no", "row_no").alias("row_no")
        stop_if_any(occupied_rows(ready[0].select(place), existing.select(place)), "rows that hold something already")
    for df in ready:
        cells = df.withColumn("at", F.struct("sheet_no", "row_no"))
        stop_if_any(capacity_check(cells, "at", [c for c in (*shown, *PROVENANCE) if c in df.columns], max_chars, max_digits), "values that a cell can't hold")
    return write_ledger(*ready, out_dir, run_id)
