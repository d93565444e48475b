"""Pages audited as their files arrive, and edits merged as they are made."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quire.operators.changes import MERGING, merges

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def audit_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, issues: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Writes the issues of every new file's pages below ``out``. A batch that is run again replaces its own folder, so each counts once."""

    def batch(df: DataFrame, number: int) -> None:
        issues(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    source = spark.readStream.schema(PAGES).parquet(folder)
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ENTRY = "doc_id long, op string, target string, n int, value string"


def merge_stream(edits: DataFrame, window_seconds: float = 2.0, ops: tuple[str, ...] | None = MERGING) -> DataFrame:
    """E3 over a stream: edits of one kind and target join their document's open entry while they come within the window of its first edit; any other edit ends it.

    edits: doc_id, made_at (timestamp with a watermark), op, target, value. An entry is given out when the next one opens or when the watermark passes its window.
    The open entry is all the state that a document holds.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        entry, out = state.getOption, []  # op, target, time, n, value
        if state.hasTimedOut:
            out.append((*entry[:2], *entry[3:]))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("made_at", kind="stable")
            for at, op, target, value in zip(rows["made_at"], rows["op"], rows["target"], rows["value"], strict=True):
                s = at.timestamp()
                if entry is not None and merges(entry, op, target, s, window_seconds, ops):
                    entry = (*entry[:3], entry[3] + 1, value)
                else:
                    if entry is not None:
                        out.append((*entry[:2], *entry[3:]))
                    entry = (op, target, s, 1, value)
            state.update(entry)
            state.setTimeoutTimestamp(max(int((entry[2] + window_seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, *x) for x in out], columns=["doc_id", "op", "target", "n", "value"])

    return edits.groupBy("doc_id").applyInPandasWithState(fold, ENTRY, "op string, target string, s double, n int, value string", "append", "EventTimeTimeout")
