"""Blocks and reading order of positioned words, by recursive cuts of a page.

A page's words are cut at the widest empty strip that runs through all of them, across or down, if it is wide enough for the text's size; the parts are cut in turn. What can't be cut is a block. Parts of a cut across follow from the top, those of
a cut down from the left. Whole pages pass, several at a time; each is cut for itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import _by_page, _floats, _line_starts, _pages

#: Strips count from so many times the median height of the words: down between columns, across between blocks.
DOWN, ACROSS = 1.5, 1.1


def _strips(low: np.ndarray, high: np.ndarray) -> tuple[float, float]:
    """The widest gap that no stretch covers, and its middle."""
    order = np.argsort(low, kind="stable")
    reach = np.maximum.accumulate(high[order])
    gaps = low[order][1:] - reach[:-1]
    if not len(gaps) or gaps.max() <= 0:
        return 0.0, 0.0
    k = int(gaps.argmax())
    return float(gaps[k]), float(reach[k] + gaps[k] / 2)


def cut(l: np.ndarray, b: np.ndarray, r: np.ndarray, t: np.ndarray, down: float = DOWN, across: float = ACROSS) -> np.ndarray:  # noqa: E741
    """Each word's block, numbered in reading order."""
    height = float(np.median(t - b)) if len(t) else 1.0
    out, n = np.zeros(len(l), dtype=np.int32), 0
    parts = [np.arange(len(l))]
    while parts:
        own = parts.pop()
        x, at_x = _strips(l[own], r[own])
        y, at_y = _strips(b[own], t[own])
        # In units of what each needs, the wider one is cut.
        if max(x, y) > 0 and max(x / down, y / across) >= height:
            if y / across >= x / down:
                first = b[own] >= at_y
            else:
                first = r[own] <= at_x
            parts += [own[~first], own[first]]
        else:
            out[own] = n
            n += 1
    return out


def to_blocks(words: DataFrame, down: float = DOWN, across: float = ACROSS) -> DataFrame:
    """words: doc_id, page_no, word_ord, text, l, b, r, t. Adds block_no (reading order of the blocks) and place (reading order of the words: block, line from the top, left edge). Equal places are ordered by word_ord."""

    kept = ("word_ord", "text", "l", "b", "r", "t")

    def run(table: pa.Table) -> pa.Table:
        page = _pages(table)
        l, b, r, t, word_ord = _floats(table, "l", "b", "r", "t", "word_ord")  # noqa: E741
        at = np.flatnonzero(np.append(True, page[1:] != page[:-1]))
        block = np.concatenate([cut(l[i:j], b[i:j], r[i:j], t[i:j], down, across) for i, j in zip(at, np.append(at[1:], len(page)), strict=True)])
        # Words of a block share a line while they overlap the line's band by more than half of the lower height.
        swept = np.lexsort((word_ord, l, -t, block, page))
        page, block = page[swept], block[swept]
        group = np.cumsum(np.append(True, (page[1:] != page[:-1]) | (block[1:] != block[:-1]))) - 1
        line = np.cumsum(_line_starts(group, b[swept], t[swept]))
        read = np.lexsort((word_ord[swept], l[swept], line))
        place = np.arange(len(page)) - at[page]
        out = table.take(pa.array(swept[read])).select(["doc_id", "page_no", *kept])
        return out.append_column("block_no", pa.array(block[read], pa.int32())).append_column("place", pa.array(place, pa.int32()))

    rows = words.select("doc_id", *(F.col(c).cast("int").alias(c) for c in ("page_no", "word_ord")), "text", *(F.col(c).cast("double").alias(c) for c in "lbrt"))
    return _by_page(rows, ["word_ord"], run, "page_no int, word_ord int, text string, l double, b double, r double, t double, block_no int, place int")
