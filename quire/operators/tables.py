"""Tables in positioned words: lines, columns, plausibility and headers."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import dealt, ship

#: Fixed values of the detection.
TOLERANCE, AGREEMENT, LEAST_ROWS, LEAST_COLUMNS, GAP, LINE_GAP, LONGEST_CELL, LONGEST_OF_TWO = 4.0, 0.75, 3, 2, 0.9, 3.0, 55, 40
MARKER = r"^(?:[•·▪▫◦‣⁃\-–—*+>]|[(\[]*(?:[0-9]{1,4}|\p{L}{1,2})[.)\]:]+|[(\[]+(?:[0-9]{1,4}|\p{L}{1,2})[.)\]:]*)$"


def numeric(x: Column | str) -> Column:
    """TD10."""
    x = F.col(x) if isinstance(x, str) else x
    return x.rlike(r"[0-9]") & x.rlike(r"^[0-9\s£$€%.,\-+()/:]+$")


def marker(x: Column | str) -> Column:
    x = F.trim(F.col(x) if isinstance(x, str) else x)
    return (F.length(x) <= 5) & x.rlike(MARKER)


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches again, but none ends within a page; what is held is a batch and the page that it ends in."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, page = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "page_no"))
        last = held[-1].slice(held[-1].num_rows - 1) if held else batch.slice(0, 1)
        new = np.flatnonzero((doc != np.append(last.column("doc_id").to_numpy(), doc[:-1])) | (page != np.append(last.column("page_no").to_numpy(), page[:-1])))
        if len(new):
            done = [*held, batch.slice(0, new[-1])]
            held = [batch.slice(new[-1])]
            if any(x.num_rows for x in done):
                yield pa.Table.from_batches(done).combine_chunks()
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _by_page(words: DataFrame, order: list[str], run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` over tables of whole pages, whose words come in the given order. Numbering the rows of a document is what sorts them: frames that are dealt by doc_id already are not dealt again."""
    ship(words.sparkSession)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_pages(batches):
            yield from run(table).to_batches(max_chunksize=10_000)

    numbered = words.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", *order)))
    return numbered.mapInArrow(pages, f"doc_id {words.schema['doc_id'].dataType.simpleString()}, {schema}")


def _floats(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].to_numpy() for n in names]


def _pages(table: pa.Table) -> np.ndarray:
    """A number for each row's page, ascending."""
    doc, page = _floats(table, "doc_id", "page_no")
    return np.cumsum(np.append(True, (doc[1:] != doc[:-1]) | (page[1:] != page[:-1]))) - 1


def _line_starts(page: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether each word starts a line. Only stretches of words whose bands may overlap are walked; a word wholly below all before it on its page starts one in any case, and one in the band of the word before it never does."""
    out = np.append(True, (page[1:] != page[:-1]) | (t[1:] != t[:-1]) | (b[1:] != b[:-1]) | (t[1:] <= b[1:]))
    at = np.flatnonzero(out)
    page, b, t = page[at], b[at], t[at]
    lowest = pd.Series(b).groupby(page).cummin().to_numpy()
    sure = np.append(True, (page[1:] != page[:-1]) | (t[1:] <= lowest[:-1]) | (t[1:] <= b[1:]))
    new, top, bottom = sure.copy(), 0.0, 0.0
    for i in np.flatnonzero(~sure):
        if sure[i - 1]:
            top, bottom = t[i - 1], b[i - 1]
        shorter = min(top - bottom, t[i] - b[i])
        if shorter > 0 and min(top, t[i]) - max(bottom, b[i]) > 0.5 * shorter:
            top, bottom = max(top, t[i]), min(bottom, b[i])
        else:
            new[i], top, bottom = True, t[i], b[i]
    out[at] = new
    return out


def _with_lines(table: pa.Table) -> pa.Table:
    """Words from the top of their pages, with their line_no."""
    page = _pages(table)
    line = np.cumsum(_line_starts(page, *_floats(table, "b", "t")))
    first = line[np.flatnonzero(np.append(True, page[1:] != page[:-1]))]
    return table.append_column("line_no", pa.array(line - first[page], pa.int32()))


_WORDS = ("word_ord", "text", "l", "b", "r", "t", "bold")
_SWEEP = ["down", "l", "word_ord"]


def _swept(words: DataFrame) -> DataFrame:
    return words.filter(F.trim("text") != "").select("doc_id", F.col("page_no").cast("int").alias("page_no"), (-F.col("t")).alias("down"), F.col("word_ord").cast("int").alias("word_ord"), *_WORDS[1:])


def to_lines(words: DataFrame) -> DataFrame:
    """TD1: words of a page swept from the top; a word joins the growing line if they overlap by more than half of the lower height. Whole pages pass, several at a time."""
    names = ["doc_id", "page_no", *_WORDS, "line_no"]
    return _by_page(_swept(words), _SWEEP, lambda table: _with_lines(table).select(names), "page_no int, word_ord int, text string, l double, b double, r double, t double, bold boolean, line_no int")


def _starting(lines: DataFrame) -> DataFrame:
    """Adds _start: whether a word is the first of its line or stands behind a wide gap."""
    w = Window.partitionBy("doc_id", "page_no", "line_no").orderBy("l", "word_ord")
    all_ = Window.partitionBy("doc_id", "page_no", "line_no")
    height = F.greatest(F.lit(1.0), F.max("t").over(all_) - F.min("b").over(all_))
    gap = F.col("l") - F.lag("r").over(w)
    return lines.withColumn("_gap", gap).withColumn("_h", height).withColumn("_start", F.col("_gap").isNull() | (F.col("_gap") > GAP * F.col("_h"))).drop("_gap", "_h")


def group_starts(lines: DataFrame) -> DataFrame:
    """TD2: left edges of the first word of each line and of every word behind a wide gap."""
    return _starting(lines).filter("_start").select("doc_id", "page_no", "line_no", F.col("l").alias("start"))


def _with_columns(rows: DataFrame, keys: list[str], start: str) -> DataFrame:
    """Adds columns: sorted means of the clusters of _start rows that most lines have a start at. All by windows within the keys, so rows that are dealt by one of them stay where they are.

    A start that is no further than the tolerance from a cluster's mean is in that cluster, for others are further than that from all of its starts.
    """
    w = Window.partitionBy(*keys, "_start").orderBy(start)
    r = rows.withColumn("_new", F.coalesce((F.col(start) - F.lag(start).over(w) > TOLERANCE).cast("int"), F.lit(1)))
    r = r.withColumn("_c", F.when(F.col("_start"), F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    own, page = Window.partitionBy(*keys, "_c"), Window.partitionBy(*keys)
    r = r.withColumn("_x", F.avg(start).over(own))
    r = r.withColumn("_agreeing", F.size(F.collect_set(F.when(F.abs(F.col(start) - F.col("_x")) <= TOLERANCE, F.col("line_no"))).over(own)))
    r = r.withColumn("_n", F.size(F.collect_set(F.when(F.col("_start"), F.col("line_no"))).over(page)))
    column = F.when(F.col("_start") & (F.col("_agreeing") >= F.greatest(F.lit(2), F.ceil(F.col("_n") * AGREEMENT))), F.col("_x"))
    return r.withColumn("columns", F.array_sort(F.collect_set(column).over(page))).drop("_new", "_c", "_x", "_agreeing", "_n", "_start")


def find_columns(starts: DataFrame, keys: list[str]) -> DataFrame:
    """TD3: clusters of starts no further apart than the tolerance; those whose mean most lines have a start at are columns."""
    c = _with_columns(starts.withColumn("_start", F.lit(True)), keys, "start").groupBy(*keys).agg(F.first("columns").alias("columns"))
    return c.select(*keys, "columns", F.posexplode("columns").alias("column_index", "x")).select(*keys, "x", "column_index", F.get("columns", F.col("column_index") + 1).alias("next_x"))


def with_columns_of_page(words: DataFrame) -> DataFrame:
    """TD2, TD3: words with their page's columns."""
    return _with_columns(_starting(words), ["doc_id", "page_no"], "l")


def _joined_columns(words: DataFrame, columns: DataFrame) -> DataFrame:
    by_page = columns.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list("x")).alias("columns"))
    return words.join(dealt(by_page), ["doc_id", "page_no"])


#: The number of the column, from 1, whose stretch a word's left edge lies in; 0 before the first.
_PLACE = f"size(filter(columns, x -> l >= x - {TOLERANCE}D))"


def respecting(columned: DataFrame) -> DataFrame:
    """TD5 over words with their page's columns."""
    over = F.coalesce(F.when(F.col("_place") > 0, F.col("r") > F.get("columns", F.col("_place"))), F.lit(False))
    return columned.filter(F.size("columns") > 1).withColumn("_place", F.expr(_PLACE)).groupBy("doc_id", "page_no", "line_no").agg((F.count_if(over) == 0).alias("respects"))


def row_respects(words: DataFrame, columns: DataFrame) -> DataFrame:
    """TD5: lines in which no word that starts in a column runs past the next one's start."""
    return respecting(_joined_columns(words, columns))


def celled(columned: DataFrame) -> DataFrame:
    """TD11 over words with their page's columns."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l", "word_ord", "text"))), lambda s: s["text"]), " ")
    c = columned.withColumn("column_index", F.expr(_PLACE) - 1).filter("column_index >= 0")
    return c.groupBy("doc_id", "page_no", "line_no", "column_index").agg(text.alias("text"), F.bool_and("bold").alias("bold"))


def assign_cells(words: DataFrame, columns: DataFrame) -> DataFrame:
    """TD11: words go to the column whose stretch their left edge lies in, joined by spaces; a cell is bold if all its words are."""
    return celled(_joined_columns(words, columns))


def _columns(lines: list[tuple[tuple[float, ...], int]]) -> tuple[float, ...]:
    """Places of columns on which lines agree, from the starts of each kind of line and how many lines are of it."""
    groups: list[list[float]] = []
    for x in sorted(x for starts, n in lines for x in starts * n):
        if groups and x - groups[-1][-1] <= TOLERANCE:
            groups[-1].append(x)
        else:
            groups.append([x])
    means = [sum(g) / len(g) for g in groups]
    need = max(2, math.ceil(sum(n for _, n in lines) * AGREEMENT))
    return tuple(m for m in means if sum(n for starts, n in lines if any(abs(x - m) <= TOLERANCE for x in starts)) >= need)


#: Columns of lines seen before, and how many are kept.
_known: dict[tuple, tuple[float, ...]] = {}
KNOWN, SPREAD = 100_000, 8


def _known_columns(kinds: Counter) -> tuple[float, ...]:
    key = tuple(kinds.items()) if len(kinds) == 1 else tuple(sorted(kinds.items()))
    found = _known.get(key)
    if found is None:
        if len(_known) >= KNOWN:
            _known.clear()
        found = _known[key] = _columns(key)
    return found


class _Lines:
    """Lines of whole pages: words sorted by line and left edge, with each line's first word, band and starts."""

    def __init__(self, table: pa.Table) -> None:
        page, line = _pages(table), table["line_no"].to_numpy()
        l, word_ord = _floats(table, "l", "word_ord")  # noqa: E741
        order = np.lexsort((word_ord, l, line, page))
        table = table.take(pa.array(order)) if (order[1:] < order[:-1]).any() else table
        page, line = page[order], line[order]
        new = np.append(True, (page[1:] != page[:-1]) | (line[1:] != line[:-1]))
        self.table, self.at = table, np.flatnonzero(new)
        self.line_of, self.page = np.cumsum(new) - 1, page[self.at]
        self.l, b, self.r, t = _floats(table, "l", "b", "r", "t")
        self.bottom, self.top = np.minimum.reduceat(b, self.at), np.maximum.reduceat(t, self.at)
        height = np.maximum(1.0, self.top - self.bottom)
        start = new | (self.l - np.append(0.0, self.r[:-1]) > GAP * height[self.line_of])
        edges = np.append(np.cumsum(start)[self.at] - 1, start.sum()).tolist()
        starts = self.l[start].tolist()
        self.starts = [tuple(starts[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
        self.words = np.diff(np.append(self.at, len(page)))
        follows = np.append(False, self.page[1:] == self.page[:-1])
        gap = np.append(0.0, self.bottom[:-1]) - self.top
        #: Whether a line may go on a table that ends at the line before it.
        self.near = (follows & (gap < LINE_GAP * height)).tolist()
        self._crossing: dict[tuple, list[bool]] = {}

    def crosses(self, line: int, columns: tuple[float, ...]) -> bool:
        """Whether a word that starts in a column runs past the next one's start: of all lines at once for the first few sets of columns, then line by line."""
        found = self._crossing.get(columns)
        if found is not None:
            return found[line]
        whole = len(self._crossing) < SPREAD
        words = slice(None) if whole else slice(self.at[line], self.at[line] + self.words[line])
        x, r = np.array(columns), self.r[words]
        own = np.searchsorted(x - TOLERANCE, self.l[words], "right")
        over = (own > 0) & (own < len(x)) & (r > np.append(x, np.inf)[own])
        if not whole:
            return bool(over.any())
        found = self._crossing[columns] = np.logical_or.reduceat(over, self.at).tolist()
        return found[line]

    def grown(self) -> Iterator[tuple[int, int, int, tuple[float, ...]]]:
        """The longest runs of lines, from each start in turn, that agree: first line, line behind the last, number on its page, columns."""
        at, nth, n, words, page = 0, 0, len(self.at), self.words.tolist(), self.page.tolist()
        while at < n:
            if at and page[at] != page[at - 1]:
                nth = 0
            best, end = None, at + 1
            if words[at] >= LEAST_COLUMNS:
                kinds = Counter((self.starts[at],))
                while end < n and self.near[end]:
                    kinds[self.starts[end]] += 1
                    columns = _known_columns(kinds)
                    if len(columns) < LEAST_COLUMNS or self.crosses(end, columns):
                        break
                    end += 1
                    if end - at >= LEAST_ROWS:
                        best = (end, columns)
            if best:
                yield at, best[0], nth, best[1]
                at, nth = best[0], nth + 1
            else:
                at += 1


def _found(table: pa.Table) -> tuple[_Lines, list[tuple[int, int, int, tuple[float, ...]]]]:
    lines = _Lines(table)
    return lines, list(lines.grown())


def _ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each first on, so many of each, and their places within their range."""
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(first, size) + within, within


def _lists(of: list[tuple[float, ...]], repeats: np.ndarray) -> pa.Array:
    sizes = np.repeat([len(x) for x in of], repeats) if of else np.zeros(0, dtype=np.int64)
    values = [v for x, n in zip(of, repeats.tolist(), strict=True) for v in x * n]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, pa.float64()))


def _candidate_lines(table: pa.Table) -> pa.Table:
    lines, found = _found(table)
    first, end, nth = (np.array([f[i] for f in found], dtype=np.int64) for i in range(3))
    own, row = _ranges(first, end - first)
    head = lines.table.take(pa.array(lines.at[own]))
    return pa.table({
        "doc_id": head["doc_id"], "page_no": head["page_no"], "table_id": pa.array(np.repeat(nth, end - first), pa.int32()), "line_no": head["line_no"],
        "row_no": pa.array(row, pa.int32()), "columns": _lists([f[3] for f in found], end - first),
    })


def candidates(lines: DataFrame) -> DataFrame:
    """TD4: the longest runs of lines, from each start in turn, that agree on two columns or more. Whole pages pass, several at a time.

    Gives doc_id, page_no, table_id, line_no, row_no and the columns' places.
    """
    rows = lines.select("doc_id", *(F.col(c).cast("int").alias(c) for c in ("page_no", "line_no", "word_ord")), "l", "b", "r", "t")
    return _by_page(rows, ["line_no", "l", "word_ord"], _candidate_lines, "page_no int, table_id int, line_no int, row_no int, columns array<double>")


def lined_candidates(words: DataFrame) -> DataFrame:
    """TD1 and TD4 in one pass over the words."""
    return _by_page(_swept(words), _SWEEP, lambda table: _candidate_lines(_with_lines(table)), "page_no int, table_id int, line_no int, row_no int, columns array<double>")


TABLE = ["doc_id", "page_no", "table_id"]
CELL = "struct<row_no int, column_index int, text string, bold boolean>"
_CELL_FIELDS = ("row_no", "column_index", "text", "bold")


def _cells(table: pa.Table) -> pa.Table:
    lines, found = _found(_with_lines(table))
    first, end, nth = (np.array([f[i] for f in found], dtype=np.int64) for i in range(3))
    width = np.array([len(f[3]) for f in found], dtype=np.int64)
    columns = np.array([x for f in found for x in f[3]])
    area = (end - first) * width
    # Where the cells of each line begin, and its table; lines outside tables have none.
    owner = np.full(len(lines.at), -1)
    own, row = _ranges(first, end - first)
    owner[own] = np.repeat(np.arange(len(found)), end - first)
    begin = np.zeros(len(lines.at), dtype=np.int64)
    begin[own] = np.repeat(np.cumsum(area) - area, end - first) + row * np.repeat(width, end - first)
    inside = np.flatnonzero(owner[lines.line_of] >= 0)
    of = owner[lines.line_of[inside]]
    base, place = (np.cumsum(width) - width)[of], np.full(len(inside), -1)
    for k in range(width.max(initial=0)):
        here = np.flatnonzero(width[of] > k)
        place[here] += lines.l[inside[here]] >= columns[base[here] + k] - TOLERANCE
    keep = place >= 0
    words, cell = inside[keep], begin[lines.line_of[inside[keep]]] + place[keep]
    n = int(area.sum())
    sizes = np.bincount(cell, minlength=n)
    texts = lines.table["text"].combine_chunks().take(pa.array(words))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), texts), " ")
    bold = lines.table["bold"].combine_chunks().take(pa.array(words))
    yes, no = (pc.fill_null(x, False).to_numpy(zero_copy_only=False) for x in (bold, pc.invert(bold)))
    all_bold = (np.bincount(cell[yes], minlength=n) > 0) & (np.bincount(cell[no], minlength=n) == 0)
    _, within = _ranges(np.zeros(len(found), dtype=np.int64), area)
    wide = np.repeat(width, area)
    items = pa.StructArray.from_arrays([pa.array(within // wide, pa.int32()), pa.array(within % wide, pa.int32()), joined, pa.array(all_bold)], names=_CELL_FIELDS)
    head = lines.table.take(pa.array(lines.at[first]))
    return pa.table({"doc_id": head["doc_id"], "page_no": head["page_no"], "table_id": pa.array(nth, pa.int32()), "cells": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(area)), pa.int32()), items)})


def candidate_tables(words: DataFrame) -> DataFrame:
    """TD1, TD4, TD11 in one pass over the words: a row a candidate (doc_id, page_no, table_id) with its cells (CELL, empty ones included) in order. A table is part of a page, which is what a task holds."""
    return _by_page(_swept(words), _SWEEP, _cells, f"page_no int, table_id int, cells array<{CELL}>")


def candidate_cells(words: DataFrame) -> DataFrame:
    """Cells (doc_id, page_no, table_id, row_no, column_index, text, bold) of all candidates, empty ones included."""
    return candidate_tables(words).select(*TABLE, F.inline("cells"))


def in_tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells as one row a table, as candidate_tables has them."""
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*_CELL_FIELDS))).alias("cells"))


def _count(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(items, test))


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x)


def plausible(cells: DataFrame, keys: list[str]) -> DataFrame:
    """TD6, TD7: whether cells make a table. The mean length is cut to a whole number before it is compared."""
    return plausible_tables(in_tables(cells, keys), keys)


def _plausible(cells: Column) -> tuple[Column, Column]:
    """TD6, TD7 of a table's cells, sorted by row: is_table, marker_column."""
    filled = F.filter(cells, lambda c: c["text"] != "")
    sizes = lambda items: _total(F.transform(items, lambda c: F.length(c["text"]).cast("long")))
    none = F.struct(F.lit(None).cast("int").alias("row"), F.lit(0).alias("now"), F.lit((1 << 31) - 1).alias("least"))

    def count(a: Column, c: Column) -> Column:
        one = F.when(c["text"] != "", 1).otherwise(0)
        ended = F.when(a["row"].isNull(), a["least"]).otherwise(F.least(a["least"], a["now"]))
        same = a["row"] == c["row_no"]
        return F.struct(c["row_no"].alias("row"), F.when(same, a["now"] + one).otherwise(one).alias("now"), F.when(same, a["least"]).otherwise(ended).alias("least"))

    least = F.aggregate(cells, none, count, lambda a: F.least(a["least"], a["now"]))
    cols = F.array_max(F.transform(cells, lambda c: c["column_index"])) + 1
    in_column = [F.filter(filled, lambda c: c["column_index"] == k) for k in (0, 1)]  # noqa: B023 -- called at once
    means = [F.coalesce(sizes(x) / F.nullif(F.size(x), F.lit(0)), F.lit(0.0)) for x in in_column]
    firsts = F.size(in_column[0])
    markers = (firsts >= 2) & (_count(in_column[0], lambda c: marker(c["text"])) >= firsts - 1)
    two = (cols != 2) | (~markers & (means[0] <= LONGEST_OF_TWO) & (means[1] <= LONGEST_OF_TWO))
    f = F.size(filled)
    ok = (f > 0) & (F.floor(sizes(filled) / F.greatest(f, F.lit(1))) <= LONGEST_CELL) & (2 * f >= F.size(cells)) & (least >= LEAST_COLUMNS) & two
    return ok, markers


def plausible_tables(tables: DataFrame, keys: list[str]) -> DataFrame:
    """TD6, TD7 over a row a table."""
    ok, markers = _plausible(F.col("cells"))
    return tables.select(*keys, ok.alias("is_table"), markers.alias("marker_column"))


def headers(cells: DataFrame, keys: list[str]) -> DataFrame:
    """TD8, TD9: whether the first row and the first column are headers."""
    return headers_of_tables(in_tables(cells, keys), keys)


def headers_of_tables(tables: DataFrame, keys: list[str], *keep: str) -> DataFrame:
    """TD8, TD9 over a row a table: adds header_row and header_column to its keys and what is to be kept."""
    facts = F.transform("cells", lambda c: F.struct(c["row_no"].alias("row"), c["column_index"].alias("col"), c["bold"].alias("bold"), (c["text"] != "").alias("f"), numeric(c["text"]).alias("n")))
    t = tables.select(*keys, *keep, facts.alias("_c"))
    c = F.col("_c")

    def column(k: Column) -> Column:
        own = F.filter(c, lambda x: x["col"] == k)
        n = lambda test: _count(own, test)
        return F.struct(
            k.alias("col"), F.exists(own, lambda x: (x["row"] == 0) & x["f"] & ~x["n"]).alias("label"), n(lambda x: (x["row"] > 0) & x["f"]).alias("below"), n(lambda x: (x["row"] > 0) & x["f"] & x["n"]).alias("below_n"),
            n(lambda x: x["f"]).alias("all"), n(lambda x: x["f"] & x["n"]).alias("all_n"),
        )

    top = F.filter(c, lambda x: (x["row"] == 0) & x["f"])
    bold = F.exists(top, lambda x: x["bold"]) & ~F.exists(top, lambda x: ~x["bold"]) & ~F.exists(c, lambda x: (x["row"] > 0) & x["bold"])
    t = t.select(*keys, *keep, F.transform(F.sequence(F.lit(0), F.array_max(F.transform(c, lambda x: x["col"]))), column).alias("_k"), F.coalesce(bold, F.lit(False)).alias("_bold"), (F.array_max(F.transform(c, lambda x: x["row"])) + 1).alias("_rows"))
    below = F.exists("_k", lambda x: x["label"] & (x["below"] > 0) & (2 * x["below_n"] > x["below"]))
    t = t.withColumn("header_row", (F.col("_rows") >= 2) & (F.col("_bold") | below))
    head = F.col("header_row")
    n, k = lambda x: F.when(head, x["below"]).otherwise(x["all"]), lambda x: F.when(head, x["below_n"]).otherwise(x["all_n"])
    labels = F.exists("_k", lambda x: (x["col"] == 0) & (n(x) >= 2) & (k(x) == 0))
    major = F.exists("_k", lambda x: (x["col"] > 0) & (n(x) >= 2) & (2 * k(x) > n(x)))
    return t.select(*keys, *keep, "header_row", (labels & major & (F.col("_rows") - head.cast("int") >= 2)).alias("header_column"))


def detect(words: DataFrame) -> DataFrame:
    """All steps: one row a table with its size and headers. Nothing is dealt out after the words."""
    size = lambda name: (F.array_max(F.transform("cells", lambda c: c[name])) + 1)
    t = candidate_tables(words).filter(_plausible(F.col("cells"))[0]).select(*TABLE, "cells", size("row_no").alias("n_rows"), size("column_index").alias("n_columns"))
    return headers_of_tables(t, TABLE, "n_rows", "n_columns")


def shape(cells: DataFrame) -> DataFrame:
    """Rows, columns, widest row and whether there are headers. cells: table_id, row_no, column_index, role."""
    per_row = cells.groupBy("table_id", "row_no").agg(F.count("*").alias("n"), F.bool_or(F.col("role") != "Data").alias("h"))
    return per_row.groupBy("table_id").agg(F.count("*").alias("n_rows"), F.max("n").alias("n_columns"), F.bool_or("h").alias("has_headers"))


def column_places(cells: DataFrame) -> DataFrame:
    """A cell's column is the sum of the spans before it in its row. cells: table_id, row_no, cell_ord, col_span."""
    w = Window.partitionBy("table_id", "row_no").orderBy("cell_ord").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("column_index", F.coalesce(F.sum("col_span").over(w), F.lit(0)))


def grid(cells: DataFrame) -> DataFrame:
    """Data rows with their label and values by column name; a column without a header is "Column n". Gives table_id, row_no, row_label, names, texts."""
    head_rows = cells.groupBy("table_id", "row_no").agg(F.bool_and(F.col("role") != "Data").alias("head"))
    names = cells.filter(F.col("role").isin("ColumnHeader", "Header")).groupBy("table_id", "column_index").agg(F.min_by("text", "row_no").alias("name"))
    width = cells.groupBy("table_id").agg(F.max("column_index").alias("w"))
    rows = cells.join(head_rows.filter("NOT head").select("table_id", "row_no"), ["table_id", "row_no"], "left_semi")
    label = rows.filter(F.col("role").isin("RowHeader", "Header")).groupBy("table_id", "row_no").agg(F.min_by("text", "column_index").alias("row_label"))
    full = rows.select("table_id", "row_no").distinct().join(width, "table_id").select("table_id", "row_no", F.explode(F.sequence(F.lit(0), "w")).alias("column_index"))
    full = full.join(names, ["table_id", "column_index"], "left").join(rows.select("table_id", "row_no", "column_index", "text"), ["table_id", "row_no", "column_index"], "left")
    item = F.struct("column_index", F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Column "), (F.col("column_index") + 1).cast("string"))).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    g = full.groupBy("table_id", "row_no").agg(F.array_sort(F.collect_list(item)).alias("c")).join(label, ["table_id", "row_no"], "left")
    return g.select("table_id", "row_no", "row_label", F.array_join(F.transform("c", lambda x: x["name"]), "|").alias("names"), F.array_join(F.transform("c", lambda x: x["text"]), "|").alias("texts"))


