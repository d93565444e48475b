r"""Ranked lexical search, a document at a time, over an index of compressed postings.

The index is a table: a row for each shard and term with the term's postings, ordered by doc_id and compressed (steps between the documents' places in the shard, and counts, in 1, 2, 4 or 8 bytes each), and one row a
shard, under the empty term, with its doc_ids and lengths. A shard is what one task has read when it holds SHARD_DOCS documents or SHARD_TERMS terms, so building shuffles nothing and a shard fits in a task.

For a search the items come in blocks of at most ITEM_BYTES of text, one after another; a block's terms and weights are all that is broadcast. Of the index only the lists of these terms are read, dealt out by shard. In a
shard, the lists of an item are merged by a heap of their next documents; a document's score is complete when the heap leaves it, and a heap of the item's best results so far, keyed by score, then doc_id, bounds what is kept.
A task keeps its result heaps from shard to shard. Lists that together can't lift a document to the worst kept score don't enter the merge, but are looked up for the documents that the others yield.
Tasks send at most TOP results an item, and these are merged by rank.

Scores are integers, as is all that is compared, so results don't depend on how documents are dealt out.

Nulls: a null text has no terms, a null doc_id comes after all others of its score, and a null item_id is kept. Documents without terms don't count, items without terms give no rows. Equal rows of documents are documents of
their own; equal rows of items are one item, and items of one item_id with unlike texts are ranked apart. Texts of any length are read whole. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, small_batches

TOP = 20
SHARD_DOCS, SHARD_TERMS = 1 << 15, 1 << 22
ITEM_BYTES = 1 << 22
#: A-Z to a-z, bytes of letters, digits and all code points above 127 as they are, all else to a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("total", pa.int64()), ("postings", pa.binary())])

SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
     i AS (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
     reps AS (SELECT item_id, text, term, count(*) AS reps FROM i GROUP BY ALL),
     tf AS (SELECT k, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
     len AS (SELECT k, sum(tf)::BIGINT AS n FROM tf GROUP BY k),
     whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM len),
     m AS (SELECT k, 100 - 25 + (25 * n * docs) // l AS m FROM len, whole),
     w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole),
     s AS (SELECT item_id, text, k, doc_id, sum(reps * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
           FROM reps JOIN tf USING (term) JOIN w USING (term) JOIN m USING (k) GROUP BY ALL HAVING score > 0),
     r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


def pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in the least of 1, 2, 4 and 8 bytes that holds them all."""
    most = int(numbers.max()) if len(numbers) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - (w == 8)))
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _packed_one(n: int) -> bytes:
    """pack() of a single number; most terms of a shard stand in one document of it."""
    width = 1 if n < 1 << 8 else 2 if n < 1 << 16 else 4 if n < 1 << 32 else 8
    return bytes([width]) + n.to_bytes(width, "little")


class _Numbers(dict):
    """Numbers terms from 0 as they are asked for."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def unpack(blob: bytes, count: int, at: int = 0) -> tuple[np.ndarray, int]:
    """Numbers that pack() wrote at a place of the blob, and the place after them."""
    width = blob[at]
    return np.frombuffer(blob, dtype=f"<u{width}", count=count, offset=at + 1).astype(np.int64), at + 1 + width * count


class Shard:
    """Documents that are being put in one shard."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self.numbers = _Numbers()
        self.size = 0

    def add(self, doc_id: int | None, found: list[bytes]) -> None:
        places, tf = np.unique(np.array(list(map(self.numbers.__getitem__, found)), dtype=np.int32), return_counts=True)
        self.ids.append(doc_id)
        self.docs.append((places, tf.astype(np.int32)))
        self.size += len(found)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        known = np.array([self.ids[i] for i in order if self.ids[i] is not None], dtype=np.int64)
        lengths = np.array([self.docs[i][1].sum() for i in order], dtype=np.int64)
        head = (known[:1].tobytes() if len(known) else bytes(8)) + pack(np.diff(known)) + pack(lengths)
        yield self._batch(shard, [("", len(order), self.size, len(known).to_bytes(8, "little") + head)])
        numbers = np.concatenate([self.docs[i][0] for i in order])
        tf = np.concatenate([self.docs[i][1] for i in order])
        place = np.repeat(np.arange(len(order)), [len(self.docs[i][0]) for i in order])
        by_term = np.argsort(numbers, kind="stable")
        tf, place = tf[by_term], place[by_term]
        ends = np.cumsum(np.bincount(numbers, minlength=len(self.numbers)))
        starts, ends = [0, *ends.tolist()], ends.tolist()
        firsts, counts = place.tolist(), tf.tolist()
        out: list[tuple] = []
        for term, k in sorted(self.numbers.items()):
            a, b = starts[k], ends[k]
            if b - a == 1:
                out.append((term.decode("utf-8", "surrogatepass"), 1, counts[a], _packed_one(firsts[a]) + _packed_one(counts[a])))
            else:
                out.append((term.decode("utf-8", "surrogatepass"), b - a, sum(counts[a:b]), pack(np.diff(place[a:b], prepend=0)) + pack(tf[a:b])))
            if len(out) == 8192:
                yield self._batch(shard, out)
                out = []
        if out:
            yield self._batch(shard, out)

    @staticmethod
    def _batch(shard: int, rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int64()), *(pa.array(c, f.type) for c, f in zip(cols, list(INDEX)[1:], strict=True))], schema=INDEX)


def build_index(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """shard, term, df, total, postings. Write it once; shards are numbered by task."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now = TaskContext.get().partitionId() << 32, Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms(text)
                if found:
                    now.add(doc_id, found)
                if now.size >= shard_terms or len(now.ids) >= shard_docs:
                    yield from now.rows(number)
                    number, now = number + 1, Shard()
        if now.ids:
            yield from now.rows(number)

    return docs.select("doc_id", "text").mapInArrow(build, "shard long, term string, df long, total long, postings binary")


def merge(lists: list[tuple[list[int], list[int], int, int]], ids: list[int | None], best: list[tuple], top: int) -> None:
    """Puts a shard's documents into the heap ``best`` of at most ``top`` entries (score, has an id, -doc_id).

    lists: places of documents ascending, what the term gives each, the most it gives, and how often the item has the term.
    """
    lists.sort(key=lambda x: x[2] * x[3])
    n, bits = len(lists), len(lists).bit_length()
    places, gives, _, reps = (list(x) for x in zip(*lists, strict=True))
    upto, total = [], 0
    for x in lists:
        total += x[2] * x[3]
        upto.append(total)  # the most that this list and those before it give together
    least = best[0][0] if len(best) == top else 1
    idle = bisect_left(upto, least)  # so many lists can't reach it together
    at = [0] * n
    heap = [places[i][0] << bits | i for i in range(idle, n)]
    heapify(heap)
    mask = (1 << bits) - 1
    while heap:
        doc, score = heap[0] >> bits, 0
        while heap and heap[0] >> bits == doc:
            i = heap[0] & mask
            j = at[i]
            score += gives[i][j] * reps[i]
            at[i] = j = j + 1
            if j < len(places[i]):
                heapreplace(heap, places[i][j] << bits | i)
            else:
                heappop(heap)
        for i in range(idle - 1, -1, -1):
            if score + upto[i] < least:
                break
            j = at[i] = bisect_left(places[i], doc, at[i])
            if j < len(places[i]) and places[i][j] == doc:
                score += gives[i][j] * reps[i]
        if score < least:
            continue
        doc_id = ids[doc]
        entry = (score, 0, 0) if doc_id is None else (score, 1, -doc_id)
        if len(best) < top:
            heappush(best, entry)
        elif entry > best[0]:
            heapreplace(best, entry)
        else:
            continue
        if len(best) == top and best[0][0] > least:
            least = best[0][0]
            now = bisect_left(upto, least)
            if now > idle:
                idle = now
                heap = [places[i][at[i]] << bits | i for i in range(idle, n) if at[i] < len(places[i])]
                heapify(heap)


def _blocks(items: DataFrame, item_bytes: int) -> Iterator[list[tuple[int | None, Counter]]]:
    """Distinct items with their terms, at most item_bytes of text (or one item) at a time."""
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().toLocalIterator():
        found = Counter(t.decode("utf-8", "surrogatepass") for t in terms(r["text"]))
        if block and size + len(r["text"] or "") > item_bytes:
            yield block
            block, size = [], 0
        if found:
            block.append((r["item_id"], found))
            size += len(r["text"])
    if block:
        yield block


def _results(index: DataFrame, block: list[tuple[int | None, Counter]], top: int) -> DataFrame:
    """item, doc_id, score: every task's best results of each item of the block."""
    spark = index.sparkSession
    vocabulary = sorted({t for _, found in block for t in found})
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in ["", *vocabulary]], "term string"))  # at most ITEM_BYTES of text
    lists = index.join(wanted, "term")
    stats = {r["term"]: (r["df"], r["total"]) for r in lists.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).collect()}  # one row a term of the block
    n_docs, n_terms = stats.get("", (0, 0))
    weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, (df, _) in stats.items() if t}
    shared = spark.sparkContext.broadcast((block, weights, n_docs, n_terms))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights, n_docs, n_terms = shared.value
        best: list[list[tuple]] = [[] for _ in block]
        shard, held, ids, m = None, {}, [], np.zeros(0, dtype=np.int64)

        def rank() -> None:
            for (_, found), results in zip(block, best, strict=True):
                mine = [(*held[t], c) for t, c in found.items() if t in held]
                if mine:
                    merge(mine, ids, results, top)

        for batch in batches:
            for number, term, df, postings in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if number != shard:
                    rank()
                    shard, held = number, {}
                if not term:  # it comes first in its shard
                    some = int.from_bytes(postings[:8], "little")
                    steps, at = unpack(postings, max(0, some - 1), 16)
                    known = np.cumsum(np.concatenate([np.frombuffer(postings, dtype=np.int64, count=1, offset=8), steps]))[:some]
                    ids = known.tolist() + [None] * (df - some)
                    m = np.array([75 + 25 * n * n_docs // n_terms for n in unpack(postings, df, at)[0].tolist()], dtype=np.int64)
                elif weights[term]:
                    steps, at = unpack(postings, df)
                    places, tf = np.cumsum(steps), unpack(postings, df, at)[0]
                    gives = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[places]))
                    held[term] = (places.tolist(), gives.tolist(), int(gives.max()))
        rank()
        rows = [(i, -e[2] if e[1] else None, e[0]) for i, results in enumerate(best) for e in results]
        for i in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 20_000], strict=True)], ["item", "doc_id", "score"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lists.select("shard", "term", "df", "postings").repartition(tasks, "shard").sortWithinPartitions("shard", "term")
    return dealt.mapInArrow(search, "item long, doc_id long, score long")


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = TOP, item_bytes: int = ITEM_BYTES, shard_docs: int = SHARD_DOCS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    small_batches(spark)
    scratch = Scratch(spark, "search")
    index = scratch.save(build_index(documents(docs), shard_docs, shard_terms), "index")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())  # at most ``top`` rows a task
    for k, block in enumerate(_blocks(items, item_bytes)):
        best = _results(index, block, top).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = F.broadcast(spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item long, item_id long"))  # one row an item of the block
        out = out.unionByName(scratch.save(best.join(names, "item").select("item_id", "rank", "doc_id", "score"), f"block-{k}"))
    return out
