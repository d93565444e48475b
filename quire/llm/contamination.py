"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by their number of shingles into classes whose bounds grow by the square root of 2. For a class with upper bound u, a
document's shingles are cut into blocks of u, and every two neighbouring blocks form a window, so any run of u shingles lies inside one. An item of
the class that is contained to 0.75 in a window has a Jaccard similarity of at least about 0.24 with it whatever the document's length, and the
HASHES minima (bands of one row) miss it with probability below 1e-6. Candidates are verified by exact containment of
the item's shingles in the document's, compared as words.

Each document is handled where it is read: nothing of the corpus is shuffled. The items are sent to all tasks in blocks of at most
about ITEMS; more items mean more blocks, one after another over the same rows.

Nulls: null or empty texts have no shingles and match nothing, on either side; null ids are kept as they are. An item of under five words is one
shingle and only matches a text of exactly these words. Repeated rows give repeated pairs. Empty tables give no pairs.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, small_batches
from .shingles import MinHash, grams, hashes, words

THRESHOLD, HASHES, SEED, ITEMS = 0.75, 56, 404, 20_000
STEP = math.sqrt(2)
#: Indexes that a worker holds; a chain of filters by several blocks uses them by turns.
HELD = 2
HITS = "array<struct<item:int,shared:int,size:int>>"


class ItemIndex:
    """The minima of the items, by size class."""

    def __init__(self, texts: list[str | None], threshold: float = THRESHOLD) -> None:
        self.threshold, self.minhash = threshold, MinHash(HASHES, SEED)
        self.items = [grams(words(t)) for t in texts]
        classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.items):
            if s:
                classes.setdefault(math.ceil(round(math.log(len(s), STEP), 9)), []).append(i)
        self.classes = []
        for c, members in sorted(classes.items()):
            table: dict[tuple[int, int], list[int]] = {}
            for i in members:
                for k, value in enumerate(self.minhash.minima(hashes(words(texts[i]))).tolist()):
                    table.setdefault((k, value), []).append(i)
            bits = max(20, (len(table) * 64).bit_length())
            bitmap = np.zeros(1 << bits, dtype=bool)
            bitmap[np.array([v for _, v in table], dtype=np.uint32) & np.uint32((1 << bits) - 1)] = True
            self.classes.append((max(1, math.ceil(STEP**c - 1e-9)), table, bitmap, np.uint32((1 << bits) - 1)))
        self.longest = max((u for u, *_ in self.classes), default=1)

    def candidates(self, h: np.ndarray) -> set[int]:
        found: set[int] = set()
        step = max(1 << 14, 4 * self.longest)
        for at in range(0, len(h), step):  # long texts piece by piece, with two blocks of overlap
            values = self.minhash.values(h[at : at + step + 2 * self.longest])
            for u, table, bitmap, mask in self.classes:
                blocks = np.minimum.reduceat(values, np.arange(0, len(values), u), axis=0)
                windows = np.minimum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks
                for w, k in zip(*np.nonzero(bitmap[windows & mask]), strict=True):
                    found.update(table.get((int(k), int(windows[w, k])), ()))
        return found

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """Item number, shared shingles and item's shingles of each item that the text contains."""
        w = words(text)
        candidates = self.candidates(hashes(w)) if w and self.classes else set()
        if not candidates:
            return []
        own = grams(w)
        shared = ((i, len(self.items[i] & own), len(self.items[i])) for i in sorted(candidates))
        return [x for x in shared if x[1] >= self.threshold * x[2] - 1e-9]


_built: dict[str, ItemIndex] = {}


def _searcher(spark: SparkSession, texts: list[str | None]) -> Callable[[Column], Column]:
    sent, key = spark.sparkContext.broadcast(texts), uuid.uuid4().hex

    @F.pandas_udf(HITS)
    def search(column: pd.Series) -> pd.Series:
        if key not in _built:
            while len(_built) >= HELD:
                del _built[next(iter(_built))]
            _built[key] = ItemIndex(sent.value)
        index = _built[key]
        return pd.Series([[{"item": i, "shared": a, "size": b} for i, a, b in index.search(t)] for t in column], dtype=object)

    return search


def _blocks(benchmark: DataFrame) -> Iterator[list]:
    """The items' rows in blocks of about ITEMS at most, one after another. Equal rows are held once, with their number, however many there are."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.groupBy("item_id", "text").agg(F.count("*").alias("n"))
    n = -(-items.count() // ITEMS)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    for k in range(n):
        yield items.filter(part == k).orderBy("item_id", "text").collect()


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, shared and item_shingles (long) and containment of every item in every document that contains it."""
    small_batches(spark)
    d, out = documents(docs), None
    for block in _blocks(benchmark):
        search = _searcher(spark, [r["text"] for r in block])
        hit = d.select("doc_id", F.explode(search(F.col("text"))).alias("h"))
        names = F.broadcast(spark.createDataFrame([(i, r["item_id"], r["n"]) for i, r in enumerate(block)], "item int, item_id long, n long"))  # at most about ITEMS rows of three numbers
        hit = hit.join(names, F.col("h.item") == F.col("item"))
        hit = hit.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n")))  # a pair for each of equal items
        hit = hit.select("doc_id", "item_id", F.col("h.shared").cast("long").alias("shared"), F.col("h.size").cast("long").alias("item_shingles"), (F.col("h.shared") / F.col("h.size")).alias("containment"))
        out = hit if out is None else out.unionByName(hit)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, shared long, item_shingles long, containment double")


def remove_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item, with the columns they came with. What one block of items leaves is written before the next block goes over it, so a worker builds one index."""
    small_batches(spark)
    scratch = Scratch(spark, "clean")
    for k, block in enumerate(_blocks(benchmark)):
        if k:
            docs = scratch.save(docs, f"block-{k}")
            scratch.drop(f"block-{k - 1}")
        search = _searcher(spark, [r["text"] for r in block])
        docs = docs.filter(F.size(search(F.col("text").cast("string"))) == 0)
    return docs


#: All pairs by exact containment, for comparison.
SQL = r"""
WITH w AS (
  SELECT 0 AS side, doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 1, item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark WHERE text IS NOT NULL
), s AS (
  SELECT DISTINCT side, id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM w
), n AS (SELECT id, count(*) AS size FROM s WHERE side = 1 GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*)::BIGINT AS shared, any_value(n.size)::BIGINT AS item_shingles, count(*) / any_value(n.size)::DOUBLE AS containment
FROM s d JOIN s i ON d.g = i.g AND d.side = 0 AND i.side = 1 JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING count(*) >= 0.75 * any_value(n.size)
"""
