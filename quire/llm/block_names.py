"""Exact dedup by deterministic block naming.

A text without its white space is cut into blocks of BLOCK bytes. Blocks are sorted, and each distinct one gets an integer name; then adjacent names are paired (the last of an odd number with 0), distinct pairs
are sorted and named in turn, and so on until a document has one name left. Names of a round stand for distinct strings and 0 is no name, so (round, name) is an identity without collisions: no hash decides.

Documents are read in chunks of about CHUNK bytes. A chunk has a dictionary of its own, so a block that a third of all documents share goes into the exchange once a chunk. Dictionaries are dealt out by the hash of the
key, sorted in each task and named there as a stream; the names go back to their chunk, which pairs them up and makes its next dictionary. So no task holds more than a chunk, whatever the groups are,
and texts are shuffled once. Every round is a table in the shared folder, and rows are known by chunk and place, which are written with them.

Nulls: a null text counts as empty, and all texts without anything but white space are equal. Rows with a null doc_id come after all others of their length. Of equal rows one stays, as of any others. A text of any
length is cut whole. An empty table gives no rows; extra columns are ignored by op13 and kept by keep_one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, small_batches

BLOCK, CHUNK = 1024, 1 << 23
#: Keys of a dictionary that go to Spark in one batch, by bytes.
SEND = 1 << 21
PART = pa.schema([
    ("chunk", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("chars", pa.int64()), ("sha256", pa.binary()),
    ("items", pa.list_(pa.int32())), ("name", pa.int64()), ("local", pa.int32()), ("key", pa.binary()),
])
PART_DDL = "chunk long, row int, doc_id long, chars long, sha256 binary, items array<int>, name long, local int, key binary"

SQL = r"""
WITH t AS (SELECT doc_id, coalesce(length(text), 0) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
     r AS (SELECT doc_id, norm, row_number() OVER w AS nth, first_value(doc_id) OVER w AS keep_id FROM t WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, count(*) OVER (PARTITION BY norm) AS group_size, nth = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""


def _rows(chunk: int, **cols: object) -> pa.RecordBatch:
    """A batch of PART in which the columns that aren't given are null."""
    n = len(next(iter(cols.values())))
    arrays = [pa.array(cols[f.name], f.type) if f.name in cols else pa.array(np.full(n, chunk), f.type) if f.name == "chunk" else pa.nulls(n, f.type) for f in PART]
    return pa.RecordBatch.from_arrays(arrays, schema=PART)


def _dictionary(chunk: int, keys: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The keys with their numbers, in batches of about SEND bytes."""
    first, size = 0, 0
    for i, key in enumerate(keys):
        size += len(key)
        if size >= SEND or i == len(keys) - 1:
            yield _rows(chunk, local=np.arange(first, i + 1, dtype=np.int32), key=keys[first : i + 1])
            first, size = i + 1, 0


def _cut(docs: DataFrame, block: int, chunk_bytes: int) -> DataFrame:
    """PART rows of the first round: documents with their blocks' numbers, and each chunk's dictionary of blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, 0
        numbers: dict[bytes, int] = {}
        docs: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if docs:
                ids, chars, sums, items = zip(*docs, strict=True)
                yield _rows(chunk, row=np.arange(len(docs), dtype=np.int32), doc_id=ids, chars=chars, sha256=sums, items=items)
                yield from _dictionary(chunk, list(numbers))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass").translate(None, b" \t\n\v\f\r")
                items = [numbers.setdefault(raw[i : i + block], len(numbers)) for i in range(0, len(raw), block)]
                docs.append((doc_id, len(text or ""), hashlib.sha256(raw).digest(), items))
                held += len(raw)
                if held >= chunk_bytes or len(docs) >= 1 << 16:
                    yield from flush()
                    chunk, held, docs, numbers = chunk + 1, 0, [], {}
        yield from flush()

    return docs.select("doc_id", "text").mapInArrow(cut, PART_DDL)


def _named(parts: DataFrame, partitions: int) -> DataFrame:
    """chunk, local and the name of each dictionary entry: the task's number and the key's place among its sorted keys."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = TaskContext.get().partitionId() << 33, None
        for batch in batches:
            names = np.empty(batch.num_rows, dtype=np.int64)
            for i, key in enumerate(batch.column(2).to_pylist()):
                if key != last:
                    now, last = now + 1, key
                names[i] = now
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names)], ["chunk", "local", "name"])

    keys = parts.filter("key IS NOT NULL").select("chunk", "local", "key").repartition(partitions, F.xxhash64("key")).sortWithinPartitions("key")
    return keys.mapInArrow(name, "chunk long, local int, name long")


def _paired(parts: DataFrame, names: DataFrame) -> DataFrame:
    """PART rows of the next round: documents with one name are done and have it, the others have pairs."""

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return PART.empty_table()
        chunk = left.column(0)[0].as_py()
        of = np.zeros(right.num_rows, dtype=np.int64)
        of[right.column(1).to_numpy()] = right.column(2).to_numpy()
        lists, rows = left.column(2).combine_chunks(), left.column(1).to_numpy()
        counts = lists.value_lengths().to_numpy()
        flat = of[lists.flatten().to_numpy()]
        starts = np.cumsum(counts) - counts
        one = counts == 1
        out = [_rows(chunk, row=rows[one], name=flat[starts[one]])]
        if not one.all():
            counts, starts, rows = counts[~one], starts[~one], rows[~one]
            half = (counts + 1) // 2
            ends = np.cumsum(half)
            at = 2 * (np.arange(ends[-1]) - np.repeat(ends - half, half))  # place of each pair's first name in its document
            first = np.repeat(starts, half) + at
            alone = at + 1 == np.repeat(counts, half)
            a, b = flat[first], np.where(alone, 0, flat[np.where(alone, first, first + 1)])
            both = np.stack([a, b], axis=1).astype(">i8")
            keys, numbers = np.unique(both.view("V16").ravel(), return_inverse=True)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(numbers.ravel(), pa.int32()))
            out += [_rows(chunk, row=rows, items=lists), *_dictionary(chunk, [k.tobytes() for k in keys])]
        return pa.Table.from_batches(out)

    open_ = parts.filter("items IS NOT NULL AND size(items) > 0").select("chunk", "row", "items")
    return open_.groupBy("chunk").cogroup(names.groupBy("chunk")).applyInArrow(pair, PART_DDL)


def identities(docs: DataFrame, scratch: Scratch, block: int = BLOCK, chunk_bytes: int = CHUNK) -> DataFrame:
    """chunk, row, doc_id, chars, sha256, round and name of each row of doc_id and text; rows are equal without white space if and only if (round, name) is."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = scratch.save(_cut(docs, block, chunk_bytes), "round-0")
    meta = parts.filter("items IS NOT NULL").select("chunk", "row", "doc_id", "chars", "sha256", "items")
    done = meta.filter("size(items) = 0").select("chunk", "row", F.lit(0).alias("round"), F.lit(0).cast("long").alias("name"))
    k = 0
    while not parts.filter("key IS NOT NULL").isEmpty():  # a round halves the longest text's names
        k += 1
        parts = scratch.save(_paired(parts, _named(parts, partitions)), f"round-{k}")
        done = done.unionByName(parts.filter("name IS NOT NULL").select("chunk", "row", F.lit(k).alias("round"), "name"))
    return scratch.save(meta.drop("items").join(done, ["chunk", "row"]), "identities")


def groups(named: DataFrame) -> DataFrame:
    """Adds keep_id, group_size and kept. Groups are joined by chunk first, so that a large one is dealt over as many tasks as its chunks are."""
    place = F.struct((-F.col("chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("chunk").alias("d"), F.col("row").alias("e"))
    each = named.groupBy("round", "name").agg(F.min(place).alias("_best"), F.count("*").alias("group_size"))
    by_chunk = named.select("chunk", "round", "name").distinct().join(each, ["round", "name"])
    kept = (F.col("_best.d") == F.col("chunk")) & (F.col("_best.e") == F.col("row"))
    return named.join(by_chunk, ["chunk", "round", "name"]).withColumn("keep_id", F.col("_best.c")).withColumn("kept", kept).drop("_best")


def op13(spark: SparkSession, docs: DataFrame, block: int = BLOCK, chunk_bytes: int = CHUNK) -> DataFrame:
    small_batches(spark)
    named = identities(documents(docs), Scratch(spark, "names"), block, chunk_bytes)
    return groups(named).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents of which no other equal one stays, with all their columns. The table is written once with a number for each row, so equal rows are told apart."""
    small_batches(spark)
    scratch = Scratch(spark, "names")
    pinned = scratch.save(docs.withColumn("_place", F.monotonically_increasing_id()), "pinned")
    named = identities(pinned.select(F.col("_place").alias("doc_id"), F.col("text").cast("string").alias("text")), scratch)
    best = F.struct((-F.col("chars")).alias("a"), F.col("_id").isNull().alias("b"), F.col("_id").alias("c"), F.col("_place").alias("d"))
    ids = pinned.select("_place", F.col("doc_id").cast("long").alias("_id"))
    kept = named.withColumnRenamed("doc_id", "_place").join(ids, "_place").groupBy("round", "name").agg(F.min(best).alias("_best")).select(F.col("_best.d").alias("_place"))
    return pinned.join(kept, "_place", "left_semi").drop("_place")
