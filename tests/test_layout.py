"""Blocks, spans, cursors and names against plain brute force."""

import random
import re

import numpy as np
import pytest

from quire.operators import blocks, cursor, spans, tree
from quire.sources import printed


def test_blocks_of_nested_columns():
    """A head, two columns of which the right one is split across, and a foot."""
    words, want = [], []

    def put(block, x, y, n, lines):
        for i in range(lines):
            for k in range(n):
                words.append((x + 30 * k, y - 14 * i - 10, x + 30 * k + 26, y - 14 * i))
                want.append(block)

    put(0, 60, 800, 14, 1)
    put(1, 60, 760, 5, 12)
    put(2, 320, 760, 5, 4)
    put(3, 320, 660, 5, 4)
    put(4, 60, 500, 14, 2)
    order = list(range(len(words)))
    random.Random(1).shuffle(order)
    l, b, r, t = (np.array([words[i][k] for i in order], dtype=float) for k in range(4))  # noqa: E741
    assert blocks.cut(l, b, r, t).tolist() == [want[i] for i in order]
    none = np.zeros(0)
    assert blocks.cut(none, none, none, none).tolist() == [] and blocks.cut(*(np.zeros(3),) * 4).tolist() == [0, 0, 0]


def test_printed_words_come_back_in_order(spark):
    texts = [(1, " ".join(f"w{i}" for i in range(700))), (2, "one"), (3, None), (4, "x " * 5), (5, "é" * 40 + " b")]
    words = printed.printed_words(spark.createDataFrame(texts, "doc_id long, text string"))
    got = {}
    for r in blocks.to_blocks(words).orderBy("doc_id", "page_no", "place").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {i: [w[: printed.LONGEST] for w in t.split()] for i, t in texts if t}


def brute_grid(cells):
    taken, out = set(), {}
    row, x = None, 0
    for r, o, cs, rs in sorted(cells):
        x = x if r == row else 0
        row = r
        while (r, x) in taken:
            x += 1
        out[r, o] = x
        taken |= {(r + dy, x + dx) for dy in range(rs) for dx in range(cs)}
        x += cs
    return out


@pytest.mark.parametrize("seed", range(5))
def test_cells_with_spans(spark, seed):
    rng = random.Random(seed)
    tables = {t: [(r, o, rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 4])) for r in range(rng.randint(1, 8)) for o in range(rng.randint(1, 6))] for t in range(20)}
    df = spark.createDataFrame([(t, *c) for t, cells in tables.items() for c in cells], "table_id long, row_no int, cell_ord int, col_span int, row_span int")
    got = {}
    for r in spans.placed(df).collect():
        got.setdefault(r["table_id"], {})[r["row_no"], r["cell_ord"]] = r["column_index"]
    assert got == {t: brute_grid(c) for t, c in tables.items()}


def test_headers_reach_over_spans(spark):
    rows = [
        (0, 0, 1, 2, "", "Data"), (0, 1, 2, 1, "Sales", "ColumnHeader"), (0, 2, 1, 2, "Note", "ColumnHeader"), (1, 0, 1, 1, "Q1", "ColumnHeader"), (1, 1, 1, 1, "Q2", "ColumnHeader"),
        (2, 0, 1, 2, "North", "RowHeader"), (2, 1, 1, 1, "1", "Data"), (2, 2, 1, 1, "2", "Data"), (2, 3, 1, 1, "x", "Data"), (3, 0, 2, 1, "3", "Data"), (3, 1, 1, 1, "y", "Data"), (4, 0, None, 0, "4", "Data"),
    ]
    df = spark.createDataFrame([(1, *r) for r in rows], "table_id long, row_no int, cell_ord int, col_span int, row_span int, text string, role string")
    full = df.na.fill(1).join(spans.placed(df), ["table_id", "row_no", "cell_ord"])
    got = {(r["row_no"], r["cell_ord"]): (r["column_header"], r["row_header"]) for r in spans.cell_headers(full).collect()}
    assert got == {(0, 0): (None, None), (2, 1): ("Q1", "North"), (2, 2): ("Q2", "North"), (2, 3): ("Note", "North"), (3, 0): ("Q1", "North"), (3, 1): ("Note", "North"), (4, 0): (None, None)}


def test_cursor_moves(spark):
    texts = {1: "One two.  Three!\n\n  four (five.) six\nseven", 2: "", 3: None, 4: "   \n ", 5: "word", 6: "x. y? z"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = [(i, p) for i, t in texts.items() for p in range(len(t or "") + 2)]
    got = {(r["doc_id"], r["position"], r["unit"]): (r["start"], r["next"], r["previous"]) for r in cursor.moves(df, spark.createDataFrame(asked, "doc_id long, position long")).collect()}
    assert len(got) == 4 * len(asked)
    for i, p in asked:
        text = texts[i] or ""
        for unit, pattern in cursor.PIECES.items():
            starts = [m.start() + len(m[0]) - len(m[0].lstrip()) for m in re.finditer(pattern, text) if m[0].strip()]
            before = [s for s in starts if s <= p]
            want = (before[-1] if before else None, next((s for s in starts if s > p), None), before[-2] if len(before) > 1 else None)
            assert got[i, p, unit] == want, (i, p, unit)
        inside = lambda x, n=len(text): x if 0 <= x < n else None
        assert got[i, p, "Character"] == (inside(p), inside(p + 1), inside(p - 1))


def test_names_lead_to_their_end_and_circles_nowhere(spark):
    chain = [(1, f"n{i}", i, f"n{i + 1}") for i in range(50)] + [(1, "n50", 50, None), (1, "a", 60, "b"), (1, "b", 61, "a"), (1, "self", 62, "self"), (1, "lost", 63, "gone"), (1, "n50", 70, "n0"), (2, "n3", 5, None)]
    got = {(r["doc_id"], r["name"]): r["element_id"] for r in tree.resolved_names(spark.createDataFrame(chain, "doc_id long, name string, element_id int, next_name string")).collect()}
    assert all(got[1, f"n{i}"] == 50 for i in range(51)) and [got[1, n] for n in ("a", "b", "self", "lost")] == [None] * 4 and got[2, "n3"] == 5
