"""W1, J8, J9 with spans: where the cells of a table stand when cells reach over columns and rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold


def placed(cells: DataFrame, *keep: str) -> DataFrame:
    """column_index of cells (table_id, row_no from 0, cell_ord, col_span, row_span), with what else is to be kept: a cell goes to the first column of its row, behind the cell before it, that no cell from above reaches into.

    A table's cells stream past in order; what is held is, for every column, the row up to which it is taken. Spans below 1 count as 1.
    """
    rows = cells.select("table_id", *(F.col(c).cast("int").alias(c) for c in ("row_no", "cell_ord")), *(F.greatest(F.coalesce(F.col(c).cast("int"), F.lit(1)), F.lit(1)).alias(c) for c in ("col_span", "row_span")), *(F.col(c).alias(f"_{c}") for c in keep))

    def step(state: tuple | None, row: tuple) -> tuple[tuple, Iterable[tuple]]:
        now, at, taken = state or (None, 0, [])
        row_no, cell_ord, col_span, row_span, *rest = row
        at = at if row_no == now else 0
        while at < len(taken) and taken[at] > row_no:
            at += 1
        taken += [0] * (at + col_span - len(taken))
        for k in range(at, at + col_span):
            taken[k] = max(taken[k], row_no + row_span)
        return (row_no, at + col_span, taken), [(row_no, cell_ord, at, *rest)]

    kept = "".join(f", {c} {cells.schema[c].dataType.simpleString()}" for c in keep)
    return fold(rows, "table_id", ["row_no", "cell_ord"], f"row_no int, cell_ord int, column_index int{kept}", step, lambda _: ())


def cell_headers(cells: DataFrame) -> DataFrame:
    """For every data cell the nearest header above in a column that it covers, from the left, and the nearest to its left in a row that it covers, from the top; a header counts in all slots that it covers.

    cells: table_id, row_no, cell_ord, column_index (of placed), col_span, row_span, text, role. Cells are spread over their slots, so a table's work is its area.
    """
    steps = lambda n: F.sequence(F.lit(0), F.greatest(F.lit(1), F.col(n)) - 1)
    # Tables are dealt out before their cells are spread; all that follows stays within a table.
    cells = cells.select("table_id", "row_no", "cell_ord", "column_index", "col_span", "row_span", "text", "role").repartition("table_id")
    s = cells.select("*", F.explode(steps("row_span")).alias("dy"))
    s = s.select("*", F.explode(steps("col_span")).alias("dx")).withColumn("y", F.col("row_no") + F.col("dy")).withColumn("x", F.col("column_index") + F.col("dx"))
    # Of cells that overlap, the later one has the slot.
    s = s.withColumn("_last", F.row_number().over(Window.partitionBy("table_id", "y", "x").orderBy(F.desc("row_no"), F.desc("cell_ord")))).filter("_last = 1")
    head = lambda *roles: F.when(F.col("role").isin(*roles), F.col("text"))
    above = Window.partitionBy("table_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    left = Window.partitionBy("table_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("column_header", F.last(head("ColumnHeader", "Header"), ignorenulls=True).over(above)).withColumn("row_header", F.last(head("RowHeader", "Header"), ignorenulls=True).over(left))
    first = lambda c, dy, dx: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(dy, dx))).alias(c)
    s = s.filter("role = 'Data'").groupBy("table_id", "row_no", "cell_ord").agg(first("column_header", "dx", "dy"), first("row_header", "dy", "dx"))
    return s
