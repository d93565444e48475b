"""Moving by character, word, line and sentence through a document's text.

A text and the positions asked for in it are dealt out once, as one row each. The positions come in ascending order and the text's units are found around them, so neither units nor positions of a document are gathered,
and no unit becomes a row. Offsets count characters from 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import fold

UNITS = ("Character", "Word", "Line", "Sentence")
#: What parts a text into pieces of a unit and what lies between; every character is in one piece.
PIECES = {"Word": r"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "Line": r"[^\n]*\n|[^\n]+", "Sentence": r"[^.!?\n]*[.!?]+[\x22')\]]*[\x20\t]*|[^.!?\n]+[\x20\t]*|\n"}
#: Behind it a new piece begins, or white space that is no unit goes on.
CUT = {"Word": " ", "Line": "\n", "Sentence": "\n"}
BLANK = " \t\n\v\f\r"
#: So many characters before a position are looked at first, if those from the last position to this one are more.
REACH = 256
_PATTERNS = {unit: re.compile(pattern) for unit, pattern in PIECES.items()}


def units(text: str, unit: str, begin: int = 0) -> Iterator[tuple[int, int]]:
    """Start and length of the text's words, lines or sentences that aren't blank, without the white space around them. begin: 0 or behind a cut."""
    for piece in _PATTERNS[unit].finditer(text, begin):
        bare = piece[0].rstrip(BLANK)
        if bare:
            n = len(bare.lstrip(BLANK))
            yield piece.start() + len(bare) - n, n


class _Place:
    """The unit that the last position is in or behind, and those before and after it."""

    def __init__(self, text: str, unit: str) -> None:
        self.text, self.unit, self.rest = text, unit, units(text, unit)
        self.before = self.here = None
        self.after = next(self.rest, None)

    def _skip(self, position: int) -> None:
        """Leaves out what lies far before a position: goes on from a cut that two units follow up to there. If the nearest cuts have none, those from further back are tried."""
        reach = REACH
        while self.after and self.after[0] < position - reach:
            cut = self.text.find(CUT[self.unit], position - reach, position) + 1
            if cut:
                rest = units(self.text, self.unit, cut)
                before, here = next(rest, None), next(rest, None)
                if here and here[0] <= position:
                    self.before, self.here, self.after, self.rest = before, here, next(rest, None), rest
                    return
            reach *= 4

    def at(self, position: int | None) -> tuple:
        if position is not None:
            self._skip(position)
            while self.after and self.after[0] <= position:
                self.before, self.here, self.after = self.here, self.after, next(self.rest, None)
        start, length = self.here or (None, None)
        return position, self.unit, start, length, self.after and self.after[0], self.before and self.before[0]


def _step(state: tuple[int | None, list[_Place]] | None, row: tuple) -> tuple[tuple, list[tuple]]:
    side, position, text = row
    if not side:
        return (len(text), [_Place(text, unit) for unit in PIECES]), []
    size, places = state = state or (None, [_Place("", unit) for unit in PIECES])
    out = [place.at(position) for place in places]
    if size is not None:
        here, after, before = (x if position is not None and 0 <= x < size else None for x in ((position or 0) + k for k in (0, 1, -1)))
        out.append((position, "Character", here, None if here is None else 1, after, before))
    return state, out


def moves(docs: DataFrame, positions: DataFrame) -> DataFrame:
    """For each position (doc_id, position) and unit: the start and length of the unit that it is in or behind (here), and the starts of the next and the previous unit; null where there is none. Previous is that before the unit it is in.

    docs: doc_id, text; null counts as empty. Positions in documents that aren't there have no characters.
    """
    texts = docs.select("doc_id", F.lit(0).alias("side"), F.lit(None).cast("long").alias("position"), F.coalesce("text", F.lit("")).alias("text"))
    asked = positions.select("doc_id", F.lit(1).alias("side"), F.col("position").cast("long").alias("position"), F.lit(None).cast("string").alias("text"))
    return fold(texts.unionByName(asked), "doc_id", ["side", "position", "text"], "position bigint, unit string, start bigint, length bigint, next bigint, previous bigint", _step, lambda _: ())
