r"""Source divergence audit: how far each source's word frequencies lie from those of the other sources of its language, and which terms stand out in it.

1. Each task counts, for every (lang, term), the documents that hold it in a count-min sketch of DEPTH rows of WIDTH cells. Cells stop at 255, which is above any least number of documents asked for; so a cell never
   underestimates min(count, 255). Only cells that aren't zero leave the task. Cells are merged by sums, and the merged sketch, DEPTH * WIDTH bytes whatever the corpus, is broadcast.
2. The texts are read again; a term of which the sketch says that fewer than ``least`` documents hold it is dropped before anything is shuffled. The others are summed up by task, then exactly by (lang, source, term), and those in too few documents go.
   If the sketch is too narrow for a corpus, fewer terms are dropped early, and the result is the same.
3. Sums over all kept terms of a pair of sources split into what depends on one source's counts alone (from a histogram of its counts, against the other's value for a term that it lacks), and what the terms in both change, for
   which sources meet on (lang, term). Terms in neither are one product. So a pair's work is that of the terms in both.

All arithmetic is exact: p = 1 + floor(SCALE * (count + 1) / (N + V)), in decimals where 64 bits could overflow.

Nulls: null text, lang and source count as ''. A text without terms still makes its group occur. Equal rows are documents of their own. Texts of any length are read whole. An empty table gives no rows; extra columns
are ignored. Equal values are ranked by the item's UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches

#: Cells of a row of the sketch (a power of two), rows, and the bytes of one piece of it that are merged at a time.
WIDTH, DEPTH, PIECE = 1 << 22, 3, 1 << 16
LEAST, SCALE, TOP = 3, 1_000_000_000, 200
#: Distinct terms, and terms of single documents, that a task holds before it sends what it has counted.
WORDS, PENDING = 1 << 19, 1 << 22
#: A-Z to a-z, bytes of letters and of all code points above 127 as they are, all else to a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))

SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
     w AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
     kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
     counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
     groups AS (SELECT DISTINCT lang, source FROM d),
     v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
     totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM groups g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
     p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v) AS q
           FROM totals t JOIN kept k ON t.lang = k.lang JOIN v ON v.lang = t.lang LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
     pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
               ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
     terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
     ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
                UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


class _Numbers(dict):
    """Numbers terms from 0 as they are asked for."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


class Tally:
    """Occurrences and documents of terms by group, within one task. A group is a language, or a language and a source."""

    def __init__(self) -> None:
        self.numbers: dict[str, _Numbers] = {}
        self.pending: dict[tuple[str, str], list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, lang: str, source: str, text: str) -> None:
        found = terms(text)
        if found:
            numbers = self.numbers.setdefault(lang, _Numbers())
            places, n = np.unique(np.array(list(map(numbers.__getitem__, found)), dtype=np.int32), return_counts=True)
            self.pending.setdefault((lang, source), []).append((places, n.astype(np.int32)))
            self.size += len(places)

    def full(self) -> bool:
        return self.size >= PENDING or sum(map(len, self.numbers.values())) >= WORDS

    def counts(self) -> Iterator[tuple[str, str, np.ndarray, np.ndarray, np.ndarray]]:
        """lang, source, numbers of terms, occurrences, documents."""
        for (lang, source), parts in self.pending.items():
            places = np.concatenate([p for p, _ in parts])
            size = len(self.numbers[lang])
            df = np.bincount(places, minlength=size)
            n = np.bincount(places, weights=np.concatenate([c for _, c in parts]), minlength=size)  # exact below 2 ** 53
            some = np.flatnonzero(df)
            yield lang, source, some, n[some].astype(np.int64), df[some]


class Sketch:
    """A count-min sketch with cells that stop at 255."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells, self.width = cells, cells.shape[1]

    @staticmethod
    def places(keys: list[bytes], width: int, depth: int) -> np.ndarray:
        """One cell a row for each key, from two halves of one hash."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))
        low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        return np.stack([((low + np.uint64(r) * high) & np.uint64(width - 1)).astype(np.int64) for r in range(depth)])

    def least(self, keys: list[bytes]) -> np.ndarray:
        """An upper bound of each key's count, below 255."""
        at = self.places(keys, self.width, len(self.cells))
        return np.min([row[a] for row, a in zip(self.cells, at, strict=True)], axis=0)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def _key(lang: str, term: bytes) -> bytes:
    """Terms hold no space, so this is unambiguous."""
    return term + b" " + lang.encode("utf-8", "surrogatepass")


def pieces(docs: DataFrame, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """Each task's sketch in pieces of PIECE cells that have any: piece, cells (numbers within the piece) and counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, tally = np.zeros((depth, width), dtype=np.uint8), Tally()

        def add() -> None:
            for lang, _, some, _, df in tally.counts():
                names = list(tally.numbers[lang])
                for row, a in zip(cells, Sketch.places([_key(lang, names[i]) for i in some.tolist()], width, depth), strict=True):
                    np.minimum(row + np.bincount(a, weights=df, minlength=width), 255, out=row, casting="unsafe")

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tally.add(lang, "", text)
                if tally.full():
                    add()
                    tally = Tally()
        add()
        flat = cells.reshape(-1)
        for first in range(0, len(flat), PIECE):
            some = np.flatnonzero(flat[first : first + PIECE])
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([first // PIECE], pa.int32()), pa.array([some.astype("<u2").tobytes()]), pa.array([flat[first + some].tobytes()])], ["piece", "cells", "counts"])

    return docs.select("lang", "text").mapInArrow(count, "piece int, cells binary, counts binary")


def _sums(parts: DataFrame) -> DataFrame:
    """The pieces' sums, each streamed: rows of a piece come one after another."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(PIECE, dtype=np.uint8)

        def done() -> pa.RecordBatch:
            some = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([some.astype("<u2").tobytes()]), pa.array([total[some].tobytes()])], ["piece", "cells", "counts"])

        for batch in batches:
            for piece, cells, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if piece != now:
                    if now is not None:
                        yield done()
                    now, total[:] = piece, 0
                at = np.frombuffer(cells, dtype="<u2")
                total[at] = np.minimum(total[at].astype(np.int64) + np.frombuffer(counts, dtype=np.uint8), 255)
        if now is not None:
            yield done()

    return parts.sortWithinPartitions("piece").mapInArrow(add, "piece int, cells binary, counts binary")


def merged(docs: DataFrame, scratch: Scratch, width: int = WIDTH, depth: int = DEPTH) -> Sketch:
    """The whole corpus's sketch, DEPTH * WIDTH bytes. Each piece is merged in several tasks first, so that the tasks' sketches of a piece need not meet in one."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = _sums(pieces(docs, width, depth).repartition(tasks, "piece", F.pmod(F.xxhash64("cells", "counts"), F.lit(8))))
    whole = scratch.save(_sums(first.repartition(tasks, "piece")), "sketch")
    flat = np.zeros(width * depth, dtype=np.uint8)
    for r in whole.toLocalIterator():  # at most width * depth / PIECE rows
        flat[r["piece"] * PIECE + np.frombuffer(r["cells"], dtype="<u2").astype(np.int64)] = np.frombuffer(r["counts"], dtype=np.uint8)
    return Sketch(flat.reshape(depth, width))


def counted(docs: DataFrame, sketch: Sketch, least: int = LEAST) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents), summed up by task, without terms that the sketch rules out."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch.cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tally = Sketch(shared.value), Tally()

        def send() -> Iterator[pa.RecordBatch]:
            names = {lang: list(numbers) for lang, numbers in tally.numbers.items()}
            possible = {lang: known.least([_key(lang, t) for t in own]) >= least for lang, own in names.items()}
            texts = {lang: pa.array(own, pa.binary()).cast(pa.string()) for lang, own in names.items()}
            for lang, source, some, n, df in tally.counts():
                keep = possible[lang][some]
                some, n, df = some[keep], n[keep], df[keep]
                for i in range(0, len(some), 20_000):
                    part = slice(i, i + 20_000)
                    size = len(some[part])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array([source] * size), texts[lang].take(pa.array(some[part])), pa.array(n[part]), pa.array(df[part])], ["lang", "source", "term", "n", "df"])

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                tally.add(lang, source, text)
                if tally.full():
                    yield from send()
                    tally = Tally()
        yield from send()

    return docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, df long")


def _p(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + v)), exactly."""
    big = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", big(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), big(total + v))


def _f(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q); p and q are at most SCALE + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(spark: SparkSession, docs: DataFrame, least: int = LEAST, top: int = TOP, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    small_batches(spark)
    scratch = Scratch(spark, "divergence")
    d = _documents(docs)
    sketch = merged(d, scratch, width, depth)
    summed = counted(d, sketch, least).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    by_term = Window.partitionBy("lang", "term")  # as many rows as the language has sources
    kept = summed.withColumn("lang_n", F.sum("n").over(by_term)).withColumn("lang_df", F.sum("df").over(by_term)).filter(F.col("lang_df") >= least)
    first = F.row_number().over(by_term.orderBy("source")) == 1
    kept = scratch.save(kept.withColumn("first", first).drop("df", "lang_df"), "kept")

    # One row a language and one a group: few next to the terms. Spark broadcasts them where their size allows it.
    langs = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    groups = d.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["v", "lang_total", "total", "own"])
    zero = F.when(F.col("v") > 0, _p(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(1)
    groups = scratch.save(groups.withColumn("p0", zero.cast("long")), "groups")
    scored = kept.join(groups, ["lang", "source"]).withColumn("p", _p(F.col("n"), F.col("total"), F.col("v")))
    scored = scratch.save(scored.withColumn("q", _p(F.col("lang_n"), F.col("lang_total"), F.col("v"))).select("lang", "source", "term", "n", "p", "q", "p0"), "scored")

    ranked = _pairs(groups, scored, scratch).unionByName(_terms(scored, top))
    return ranked.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _terms(scored: DataFrame, top: int) -> DataFrame:
    """Terms that a group has more of than its language. Each task keeps its first ``top`` of a group before the exchange."""
    t = scored.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return t.withColumn("rank", rank).filter(F.col("rank") <= top)


def _pairs(groups: DataFrame, scored: DataFrame, scratch: Scratch) -> DataFrame:
    """Every group against the other sources of its language."""
    mine = groups.select("lang", "source", "own", "v", F.col("p0").alias("p0"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("own").alias("item_own"), F.col("p0").alias("q0"))
    all_ = mine.join(other, "lang").filter("source <> item")
    # What a group's counts give against a value that doesn't depend on the term, from its histogram.
    histogram = scored.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    against = histogram.join(other, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(
        F.sum(F.col("m") * _f(F.col("p"), F.col("q0"))).alias("as_p"), F.sum(F.col("m") * _f(F.col("q0"), F.col("p"))).alias("as_q")
    )
    against = scratch.save(against, "against")
    # Terms that both have, each pair of sources once.
    a = scored.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("za"))
    b = scored.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("zb"))
    pa_, pb, za, zb = (F.col(c) for c in ("pa", "pb", "za", "zb"))
    both = a.join(b, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(
        F.count("*").alias("common"), F.sum(_f(pa_, pb) - _f(pa_, zb) - _f(za, pb)).alias("ab"), F.sum(_f(pb, pa_) - _f(pb, za) - _f(zb, pa_)).alias("ba")
    )
    both = scratch.save(both, "both")
    both = both.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "common", F.col("ab").alias("change")).unionByName(both.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "common", F.col("ba").alias("change")))
    swapped = against.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "as_q")
    keys = ["lang", "source", "item"]
    t = all_.join(against.drop("as_q"), keys, "left").join(swapped, keys, "left").join(both, keys, "left").na.fill(0, ["as_p", "as_q", "common", "change"])
    neither = (F.col("v") - F.col("own") - F.col("item_own") + F.col("common")) * _f(F.col("p0"), F.col("q0"))
    t = t.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("as_p") + F.col("as_q") + F.col("change") + neither).alias("value"))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
