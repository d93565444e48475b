"""Queries at size: how often their rows are dealt out, what is broadcast, and vectorised rules against plain ones."""

import random
import re

import pytest

from quire.operators import cursor
from quire.operators import tables as TD
from quire.operators import tree
from quire.plans import audit_queries, layout_queries, page_queries, table_queries
from quire.sources import markup, printed


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return plan(df).count("Exchange hashpartitioning")


@pytest.mark.parametrize("name,most", [("td_detected_tables_of_orders", 1), ("td06_td07_plausible_orders", 1), ("td08_td09_headers_of_orders", 1), ("td04_candidates_of_orders", 1), ("td01_lines_of_orders", 1)])
def test_orders_are_dealt_out_once(spark, sf_dir, name, most):
    """the words of an order stay with its line items all the way."""
    df = layout_queries.queries()[name](spark, sf_dir)
    assert exchanges(df) <= most and "Join" not in plan(df)


def _plain_lines(words):
    out, top, bottom, line, page = {}, 0.0, 0.0, -1, None
    for w in sorted(words, key=lambda w: (w["doc_id"], w["page_no"], -w["t"], w["l"], w["word_ord"])):
        if (w["doc_id"], w["page_no"]) != page:
            page, line = (w["doc_id"], w["page_no"]), -1
        shorter = min(top - bottom, w["t"] - w["b"])
        if line >= 0 and shorter > 0 and min(top, w["t"]) - max(bottom, w["b"]) > 0.5 * shorter:
            top, bottom = max(top, w["t"]), min(bottom, w["b"])
        else:
            line, top, bottom = line + 1, w["t"], w["b"]
        out[(*page, w["word_ord"])] = line
    return out


def _plain_tables(lines):
    """First and last line and columns of each table of a page's lines, each a list of (l, b, r, t)."""
    def starts(line):
        height = max(1.0, max(w[3] for w in line) - min(w[1] for w in line))
        return [line[0][0], *(b[0] for a, b in zip(line, line[1:], strict=False) if b[0] - a[2] > TD.GAP * height)]

    def columns(some):
        groups = []
        for x in sorted(x for line in some for x in starts(line)):
            if groups and x - groups[-1][-1] <= TD.TOLERANCE:
                groups[-1].append(x)
            else:
                groups.append([x])
        need = max(2, -(-len(some) * 3 // 4))
        return [m for m in (sum(g) / len(g) for g in groups) if sum(any(abs(x - m) <= TD.TOLERANCE for x in starts(line)) for line in some) >= need]

    out, at = [], 0
    while at < len(lines):
        best, end = None, at + 1
        while len(lines[at]) >= 2 and end < len(lines):
            bottom, top = min(w[1] for w in lines[end - 1]), max(w[3] for w in lines[end])
            if bottom - top >= TD.LINE_GAP * max(1.0, top - min(w[1] for w in lines[end])):
                break
            cols = columns(lines[at : end + 1])
            if len(cols) < 2 or any(x - TD.TOLERANCE <= w[0] < y - TD.TOLERANCE and w[2] > y for x, y in zip(cols, cols[1:], strict=False) for w in lines[end]):
                break
            end += 1
            if end - at >= 3:
                best = (end, cols)
        if best:
            out.append((at, *best))
            at = best[0]
        else:
            at += 1
    return out


def test_lines_tables_and_cells_are_those_of_the_plain_rules(spark):
    rng, words = random.Random(5), []
    for doc in range(6):
        for page in range(1, 12):
            places = [(row, x) for row in range(rng.choice((1, 3, 12, 20))) for x in (60.0, 160.0, 163.0, 300.0) if rng.random() < 0.9 - 0.7 * (x == 163.0)]
            for k, (row, x) in enumerate(places):
                l, t = x + rng.choice((0.0, 0.0, 0.0, 2.0)), 700.0 - 13 * row - rng.choice((0.0,) * 12 + (3.0, 6.5))  # noqa: E741
                words.append({"doc_id": doc, "page_no": page, "word_ord": 999 - k, "text": rng.choice(("a", "7", "bc", "d", "e", " ")), "l": l, "b": t - rng.choice((10.0,) * 9 + (14.0, 0.0)), "r": l + rng.choice((5.0,) * 9 + (20.0, 90.0, 150.0)), "t": t, "bold": rng.choice((True, False, None))})
    schema = "doc_id long, page_no int, word_ord int, text string, l double, b double, r double, t double, bold boolean"
    df = spark.createDataFrame([tuple(w[c.split()[0]] for c in schema.split(", ")) for w in words], schema).repartition(3)
    said = [w for w in words if w["text"].strip()]
    lines = _plain_lines(said)
    assert {(r["doc_id"], r["page_no"], r["word_ord"]): r["line_no"] for r in TD.to_lines(df).collect()} == lines
    by_page = {}
    for w in sorted(said, key=lambda w: (w["l"], w["word_ord"])):
        line = lines[w["doc_id"], w["page_no"], w["word_ord"]]
        by_page.setdefault((w["doc_id"], w["page_no"]), {}).setdefault(line, []).append(w)
    want, cells = {}, {}
    for page, found in by_page.items():
        ordered = [found[k] for k in sorted(found)]
        for nth, (first, end, cols) in enumerate(_plain_tables([[(w["l"], w["b"], w["r"], w["t"]) for w in line] for line in ordered])):
            for i in range(first, end):
                want[(*page, nth, i)] = (i - first, cols)
                for c, x in enumerate(cols):
                    own = [w for w in ordered[i] if w["l"] >= x - TD.TOLERANCE and (c + 1 == len(cols) or w["l"] < cols[c + 1] - TD.TOLERANCE)]
                    known = [w["bold"] for w in own if w["bold"] is not None]
                    cells[(*page, nth, i - first, c)] = (" ".join(w["text"] for w in own), bool(known) and all(known))
    assert len(want) > 50
    for got in (TD.candidates(TD.to_lines(df)), TD.lined_candidates(df)):
        assert {(r["doc_id"], r["page_no"], r["table_id"], r["line_no"]): (r["row_no"], r["columns"]) for r in got.collect()} == want
    assert {(r["doc_id"], r["page_no"], r["table_id"], r["row_no"], r["column_index"]): (r["text"], r["bold"]) for r in TD.candidate_cells(df).collect()} == cells


@pytest.mark.parametrize("name", ["c13_remove_empties_of_pages", "g04_bounds_roll_up_of_pages", "n05_position_in_tree_of_pages", "g09_k04_structure_trees_of_pages", "c14_j13_mark_furniture_of_documents", "tr04_nearest_section_of_pages", "n08_lists_of_pages", "s09_targets_of_pages", "tr02_moved_items_of_pages", "tr07_titles_as_artifacts_of_pages", "t03_full_text_of_pages", "c18_section_levels_of_pages", "a08_list_nesting_of_pages", "k01_html_of_pages"])
def test_trees_are_never_broadcast(spark, sf_dir, name):
    """What is read out of pages is larger than Spark reckons; no side of a join goes through the driver."""
    df = {**page_queries.queries(), **table_queries.queries()}[name](spark, sf_dir)
    assert "BroadcastExchange" not in plan(df)


@pytest.mark.parametrize("name,most", [("td05_rows_of_orders", 1), ("td11_cells_of_orders", 1), ("td03_columns_of_orders", 1), ("j04_options_of_orders", 4), ("j05_enclosing_words_of_orders", 4), ("j08_j09_headers_with_spans_of_orders", 2), ("s04_blocks_of_documents", 1)])
def test_rows_are_dealt_out_seldom(spark, sf_dir, name, most):
    """Windows and groups stay within what the rows are dealt by."""
    assert plan(layout_queries.queries()[name](spark, sf_dir)).count("Exchange hashpartitioning") <= most


def test_cursors_find_units_without_a_row_for_each(spark, sf_dir):
    """texts and positions are dealt out once, and no word, line or sentence is."""
    df = layout_queries.queries()["n04_cursor_of_documents"](spark, sf_dir)
    assert exchanges(df) <= 1 and "regexp_extract_all" not in plan(df) and "Join" not in plan(df)


@pytest.mark.parametrize("reach", [1, 7, 256])
def test_cursors_that_leave_out_text_find_the_same_units(spark, monkeypatch, reach):
    monkeypatch.setattr(cursor, "REACH", reach)
    rng = random.Random(reach)
    texts = ["", " \n", "word", "a\n" + "\n" * 3000 + "b c.", "x" * 3000 + " y", "one. " * 900] + ["".join(rng.choices("ab\u00e9\U0001f600.?!\"') \t\n\r", k=rng.randint(1, 3000))) for _ in range(12)]
    for text in texts:
        asked = sorted({0, len(text), len(text) + 5000, -3, *(rng.randint(0, len(text)) for _ in range(rng.choice((2, 6, 200))))})
        state, got = cursor._step(None, (0, None, text))[0], {}
        for p in (None, *asked):
            state, rows = cursor._step(state, (1, p, None))
            got |= {r[:2]: r[2:] for r in rows}
        assert len(got) == 4 * (len(asked) + 1)
        for unit, pattern in cursor.PIECES.items():
            all_ = [(m.start() + len(m[0]) - len(m[0].lstrip()), len(m[0].strip())) for m in re.finditer(pattern, text) if m[0].strip()]
            for p in (None, *asked):
                n = 0 if p is None else sum(s <= p for s, _ in all_)
                here = all_[n - 1] if n else (None, None)
                assert got[p, unit] == (*here, all_[n][0] if n < len(all_) else None, all_[n - 2][0] if n > 1 else None), (p, unit)


def test_cursors_in_documents_that_are_not_there(spark):
    docs = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, 0), (2, 2), (2, 2), (2, None), (3, 0)], "doc_id long, position long")
    got = sorted(((r["doc_id"], r["unit"], *r[3:]) for r in cursor.moves(docs, asked).collect() if r["unit"] in ("Character", "Word")), key=str)
    none, word = (None,) * 4, (2, 1, None, 0)
    want = [(1, "Character", *none), (1, "Word", *none), *[(2, "Character", 2, 1, None, 1)] * 2, (2, "Character", *none), *[(2, "Word", *word)] * 2, (2, "Word", None, None, 0, None), (3, "Word", *none)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("name", ["g09_k04_structure_trees_of_pages", "t03_full_text_of_pages", "k01_html_of_pages"])
def test_pages_are_read_once_and_stay_where_they_are(spark, sf_dir, name):
    """F3, F4, F6 of round 4: what is asked within pages takes one reading of each corpus, and no row of it is dealt out."""
    df = page_queries.queries()[name](spark, sf_dir)
    assert len(re.findall(r"MapInArrow \w+\(doc_id#\d+L?, html#\d+\)", plan(df))) == 2 and exchanges(df) == 0 and "Join" not in plan(df)


def test_texts_of_deep_pages_go_out_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(markup, "FLUSH_TEXT", 1000)
    deep = "<div>" * 60 + "<p>" + "word " * 40 + "</p><img alt=' a picture '>" + "</div>" * 60
    pages = spark.createDataFrame([(1, deep), (2, None), (3, ""), (4, "<p>x</p>"), (5, deep)], "page_id long, html string").coalesce(1)
    got = markup.over_trees(pages, tree.full_texts, "element_id int, full_text string", text_at=1).collect()
    want = {1: ["word " * 40 + "a picture"] * 60 + [("word " * 40).strip(), "a picture"], 4: ["x"]}
    want[5] = want[1]
    assert {d: [r["full_text"] for r in sorted(got, key=lambda r: r["element_id"]) if r["doc_id"] == d] for d in {r["doc_id"] for r in got}} == want


def test_audit_of_pages_deals_out_what_it_reads_once(spark, sf_dir):
    """F2 of round 4: all rules in one reading of the pages and one exchange; a page's texts and lists have no part in it."""
    df = audit_queries.queries()["audit_rules_over_pages"](spark, sf_dir)
    assert plan(df).count("MapInArrow") == 1 and exchanges(df) == 1 and "Join" not in plan(df)
    rows = markup.tree("<p>one two<ul><li>three<li>four</ul>five<p><h1>six</h1><h1> </h1><aside>seven</aside>")
    assert [r[4] for r in audit_queries.audited(rows)] == ["Heading", "Heading", "Run", "Paragraph"] and [r[7] for r in audit_queries.audited(rows)] == [0, 0, 7 + 5 + 4 + 3, 4]
    assert audit_queries.audited([]) == []


def test_lines_of_documents_stay_where_their_texts_are(spark, sf_dir):
    """F5 of round 4: whole texts are dealt out, never their words or lines, and no sort puts words in order to place them."""
    df = table_queries.queries()["c14_j13_mark_furniture_of_documents"](spark, sf_dir)
    assert "ENSURE_REQUIREMENTS" not in plan(df) and "Window" not in plan(df)


def test_pages_are_those_of_the_words(spark):
    docs = spark.createDataFrame([(1, None), (2, " \n"), (3, "a"), (4, "b " * printed.PER_PAGE), (5, "c " * (printed.PER_PAGE + 1)), (5, "d"), (None, "e")], "doc_id int, text string")
    want = printed.printed_words(docs).select("doc_id", "page_no").distinct()
    assert sorted(map(str, printed.printed_pages(docs).collect())) == sorted(map(str, want.collect()))
