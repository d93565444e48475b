"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The rows are dealt to source parts by a hash, so a lost task finds the same part again. The number of rows that
part p sends to shard s is drawn exactly, without replacement, from what the shards still lack. Each part permutes its rows and cuts
them by those counts, the rows are exchanged, and every shard permutes again. Only keys move; texts stay where they are.

Equal rows are counted first, and each of them gets a number, which takes part in all three hashes: copies fall into parts, shards and slots as unlike rows do, and
a row that is repeated over and over is dealt out over all tasks.

Law ``rows``: the shards' row counts are at most one apart. Nulls: a null text has size 1 and the CRC of no
bytes; a null doc_id is a value like any other. Rows that tie in doc_id, size and CRC take their places among themselves in the order in which they were written. A text of any length is
only measured. An empty table gives no rows; extra columns are ignored by op2 and kept by sharded_documents, but for those named like its own four.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, documents

#: Source parts, and permutation bins of one shard; both bound what one task holds, and the matrix that is broadcast.
PARTS, MOST_PARTS, ROWS_PER_PART = 1024, 8192, 2_000_000
#: So many equal rows are numbered by one task at a time.
LOT = 65_536


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """A draw of how many of ``draws`` items taken from good + bad are good; any size.

    The weights next to each other have a simple ratio, so they follow outward from the mode's, set to 1; beyond 12 deviations nothing is left that a double could hold.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    reach = 20 + int(12 * (draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5)
    first, last = max(low, mode - reach), min(high, mode + reach)
    up, down = np.arange(mode, last, dtype=np.float64), np.arange(mode, first, -1, dtype=np.float64)
    above = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    below = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    weights = np.concatenate([below[::-1], [1.0], above])
    upto = np.cumsum(weights)
    return first + min(len(weights) - 1, int(np.searchsorted(upto, rng.random() * upto[-1], "right")))


def communication_matrix(part_rows: dict[int, int], shard_rows: list[int], seed: int) -> dict[int, list[int]]:
    """Rows that each part sends to each shard: row sums are the parts' rows, column sums the shards' sizes."""
    rng, lack, out = random.Random(seed), list(shard_rows), {}
    for part in sorted(part_rows):
        draws, rest, row = part_rows[part], sum(lack), []
        for n in lack:
            got = hypergeometric(rng, n, rest - n, draws)
            row.append(got)
            rest -= n
            draws -= got
        lack = [a - b for a, b in zip(lack, row, strict=True)]
        out[part] = row
    return out


def numbered(rows: DataFrame, *key: str) -> DataFrame:
    """The rows' key columns and ``_copy``, which numbers equal rows from 0. Counted with partial sums and spread again, so no task holds all of many equal rows."""
    counts = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    lots = counts.select(*key, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / LOT))).alias("_lot"))
    lots = lots.repartition(*key, "_lot")
    last = F.least(F.col("_n") - 1, (F.col("_lot") + 1) * LOT - 1)
    return lots.select(*key, F.explode(F.sequence(F.col("_lot") * LOT, last)).alias("_copy"))


def row_numbers(rows: DataFrame, *key: str) -> DataFrame:
    """Adds ``_copy``, which numbers rows with the same key from 0 in the order of ``_row``. rows: key columns and _row, monotonically_increasing_id() of a written table.

    Rows are numbered within the part that _row starts with, and parts by running sums, so a key that many rows share is dealt over as many groups as there are parts.
    """
    r = rows.withColumn("_part", F.shiftright("_row", 33))
    inside = F.row_number().over(Window.partitionBy(*key, "_part").orderBy("_row"))
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a part
    starts = r.groupBy(*key, "_part").agg(F.count("*").alias("_n")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_start"))
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return r.withColumn("_in", inside).join(starts, on).select(*rows.columns, (F.col("_start") + F.col("_in") - 1).cast("long").alias("_copy"))


def shard(keys: DataFrame, shards: int = 16, seed: int = 20240607) -> DataFrame:
    """Adds ``shard`` (int), ``slot`` (long, gapless from 0 in the shard) and ``_copy`` (the number among equal rows, from 0) to a frame of doc_id, size, text_crc32."""
    spark = keys.sparkSession
    scratch = Scratch(spark, "shard")
    # Three numbers a document; the texts are read once.
    keys = scratch.save(numbered(keys, "doc_id", "size", "text_crc32"), "keys")
    key = ["doc_id", "size", "text_crc32", "_copy"]
    first, second = (F.xxhash64(F.lit(seed + k), *key) for k in (1, 2))
    total = keys.count()
    parts = max(PARTS, min(MOST_PARTS, total // ROWS_PER_PART))
    dealt = keys.select(*key, F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(parts)).cast("int").alias("part"))
    counts = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}  # at most MOST_PARTS rows
    total = sum(counts.values())
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix(counts, sizes, seed)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("upto", T.ArrayType(T.LongType()))])
    rows = [(p, [sum(row[: s + 1]) for s in range(shards)]) for p, row in matrix.items()]
    upto = F.broadcast(spark.createDataFrame(rows, schema))  # at most MOST_PARTS x shards numbers
    place = Window.partitionBy("part").orderBy(first, *key)
    sent = (
        dealt.withColumn("place", F.row_number().over(place).cast("long"))
        .join(upto, "part")
        .select(*key, F.size(F.filter("upto", lambda u: u < F.col("place"))).cast("int").alias("shard"))
    )
    # The second permutation: rows in the order of another hash; bins of that hash keep a shard out of a single task.
    bins = max(16, parts // shards)
    sent = sent.withColumn("_key", second).withColumn("_bin", F.shiftrightunsigned(F.col("_key"), 40) * bins / F.lit(1 << 24))
    sent = sent.withColumn("_bin", F.floor("_bin").cast("int"))
    inside = Window.partitionBy("shard", "_bin")
    placed = sent.withColumn("_n", F.row_number().over(inside.orderBy("_key", *key)).cast("long"))
    per_bin = sent.groupBy("shard", "_bin").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("shard").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(per_bin.select("shard", "_bin", F.coalesce(before, F.lit(0)).alias("_start")))  # shards x bins rows
    return placed.join(starts, ["shard", "_bin"]).select(*key, "shard", (F.col("_start") + F.col("_n") - 1).alias("slot"))


def keyed(docs: DataFrame) -> DataFrame:
    d = documents(docs)
    return d.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return shard(keyed(docs)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def sharded_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The documents with size, text_crc32, shard and slot; columns of those names that they came with go.

    The rows are written once with a number each, so that rows with the same key keep their places among themselves whatever task is run again. Only keys are sorted; texts are shuffled once, by number.
    """
    own = ("size", "text_crc32", "shard", "slot", "__row")
    names = [c for c in docs.columns if c not in own]
    scratch = Scratch(docs.sparkSession, "sharded")
    d = scratch.save(docs.select(*(F.col(f"`{c}`") for c in names)).withColumn("__row", F.monotonically_increasing_id()), "rows")
    size = (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1).cast("long")
    keys = scratch.save(d.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_crc32"), F.col("__row").alias("_row")), "keys")
    copies = row_numbers(keys, "doc_id", "size", "text_crc32")
    placed = shard(keys.drop("_row"), shards).select(F.col("doc_id").alias("_k"), F.col("size").alias("_s"), F.col("text_crc32").alias("_c"), F.col("_copy").alias("_n"), "shard", "slot")
    on = F.col("doc_id").eqNullSafe(F.col("_k")) & (F.col("size") == F.col("_s")) & (F.col("text_crc32") == F.col("_c")) & (F.col("_copy") == F.col("_n"))
    places = copies.join(placed, on).select(F.col("_row").alias("__row"), "size", "text_crc32", "shard", "slot")
    return d.join(places, "__row").select(*(F.col(f"`{c}`") for c in names), "size", "text_crc32", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard (shard=0, ...), its files in order of slot and so are their rows. A shard is split over range partitions, so none is held by one task."""
    files = int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.mode("overwrite").partitionBy("shard").parquet(path)
