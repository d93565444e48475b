"""Rules that decide by what came before, as one pass over sorted rows that holds the open state of one group only.

The rows of a group are dealt to one task, since each decision depends on the one before, but they stream through it: neither the log nor the result of a group is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import ship

ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
FLUSH = 10_000


def fold(df: DataFrame, key: str, order: list[str], schema: str, step: Callable[[object, tuple], tuple[object, Iterable[tuple]]], end: Callable[[object], Iterable[tuple]]) -> DataFrame:
    """Rows of ``key`` and what the folds give out. step(state, row) -> (state, rows out) for each row of a group in order (state None first); end(state) -> rows out.

    df's columns but the key, in their order, make the row. schema: 'name type, ...' of what is given out.
    """
    ship(df.sparkSession)
    fields = [tuple(x.split()) for x in schema.split(",")]
    types = [ARROW[df.schema[key].dataType.simpleString()], *(ARROW[t] for _, t in fields)]
    names = [key, *(n for n, _ in fields)]
    at = df.columns.index(key)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, open_, out = None, None, False, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            keys = columns.pop(at)
            for k, row in zip(keys, zip(*columns, strict=True), strict=True):
                if open_ and k != now:
                    out += [(now, *x) for x in end(state)]
                    open_ = False
                if not open_:
                    now, state, open_ = k, None, True
                state, found = step(state, row)
                out += [(now, *x) for x in found]
            if len(out) >= FLUSH:
                yield packed(out)
                out = []
        if open_:
            out += [(now, *x) for x in end(state)]
        if out:
            yield packed(out)

    # Numbering is what deals and sorts the rows: those that are dealt by the key already are not dealt again.
    sorted_ = df.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return sorted_.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {schema}")
