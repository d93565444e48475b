"""Queries of layout inference and search: over the documents' lines and over literal words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import layout as L
from quire.operators import search as Q
from quire.operators import structure as C
from quire.sources import adapters as A

from .fixture import Fixture, Registry, sql_literal
from .text_queries import WS, rows, sql_map

R = Registry()

# ---- Lines of the documents -------------------------------------------------------------------------------------------------
CAPS = r"(len(regexp_extract_all(x, '\p{L}')) >= 4 AND NOT regexp_matches(x, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]'))"
ORD = r"'^(\(?([0-9]{1,3}|[a-zA-Z]|[ivxlcdmIVXLCDM]{1,6})[.)\]]\s)\s*(.*)$'"
BUL = rf"(regexp_matches(x, '^[{L.BULLETS}]\s') OR starts_with(x, '- '))"
BBODY = r"regexp_replace(x[3:], '^\s+', '')"
LAB = f"regexp_extract(x, {ORD}, 2)"
KIND = f"CASE WHEN {BUL} THEN CASE WHEN {BBODY} <> '' THEN 'Bullet' END WHEN regexp_extract(x, {ORD}, 3) = '' THEN NULL WHEN regexp_matches({LAB}, '^[0-9]+$') THEN 'Decimal' WHEN regexp_matches({LAB}, '^[ivxlcdmIVXLCDM]+$') AND (length({LAB}) > 1 OR {LAB} IN ('i', 'I')) THEN CASE WHEN regexp_matches({LAB}, '^[A-Z]') THEN 'UpperRoman' ELSE 'LowerRoman' END WHEN regexp_matches({LAB}, '^[A-Z]') THEN 'UpperAlpha' ELSE 'LowerAlpha' END"
LINES = f"""(SELECT doc_id, lang, reading_order, CAST(reading_order // {A.LINES_PER_PAGE} + 1 AS INTEGER) AS page_no, x AS text, {KIND} AS marker_kind,
CASE WHEN {KIND} IS NOT NULL THEN 'ListItem' WHEN length(x) BETWEEN 1 AND 60 AND NOT regexp_matches(x, '[.;,]$') AND {CAPS} THEN 'Heading' ELSE 'Paragraph' END AS kind
FROM (SELECT doc_id, lang, i - 1 AS reading_order, parts[i] AS x FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i)))"""


def kinds_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by language and kind."""
    return A.document_lines(spark, sf_dir).groupBy("lang", "kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


R.add("c08_a01_kinds_by_language", kinds_by_language, f"SELECT lang, kind, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM {LINES} GROUP BY lang, kind")
R.add("c10_list_markers_of_documents", lambda s, d: A.document_lines(s, d).filter("kind = 'ListItem'").select("doc_id", "reading_order", "marker_kind"), f"SELECT doc_id, CAST(reading_order AS INTEGER) AS reading_order, marker_kind FROM {LINES} WHERE kind = 'ListItem'")
R.add("c11_list_runs_of_documents", lambda s, d: C.list_runs(A.document_lines(s, d)), f"""WITH l AS {LINES}, g AS (SELECT *, reading_order - row_number() OVER (PARTITION BY doc_id ORDER BY reading_order) AS k FROM l WHERE kind = 'ListItem')
SELECT doc_id, CAST(min(reading_order) AS INTEGER) AS first, count(*) AS n_items, arg_min(marker_kind, reading_order) AS marker_kind, CASE WHEN count(*) >= 2 THEN 'List' ELSE 'Paragraph' END AS kind FROM g GROUP BY doc_id, k""")
MERGED = """, f AS (SELECT *, CASE WHEN kind = 'Paragraph' AND lag(kind) OVER w = 'Paragraph' AND lag(text) OVER w <> '' AND NOT regexp_matches(lag(text) OVER w, '[.!?:;"”)\\]]$') AND regexp_matches(text, '^\\p{Ll}') THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY reading_order)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY reading_order) AS run FROM f),
p AS (SELECT *, CASE WHEN lead(text) OVER (PARTITION BY doc_id, run ORDER BY reading_order) IS NULL THEN text WHEN text LIKE '%-' THEN text[1:length(text) - 1] ELSE text || ' ' END AS piece FROM g)
SELECT doc_id, CAST(min(reading_order) AS INTEGER) AS reading_order, arg_min(kind, reading_order) AS kind, count(*) AS n_fragments, string_agg(piece, '' ORDER BY reading_order) AS text FROM p GROUP BY doc_id, run"""
R.add("c12_merge_split_paragraphs", lambda s, d: C.merged_paragraphs(A.document_lines(s, d)), f"WITH l AS {LINES}{MERGED}")
PARTS = Fixture("parts", "doc_id int, reading_order int, kind string, text string", ((1, 0, "Paragraph", "This is a para-"), (1, 1, "Paragraph", "graph that runs"), (1, 2, "Paragraph", "over lines."), (1, 3, "Paragraph", "next one"), (1, 4, "Heading", "Title"), (1, 5, "Paragraph", "after (x)"), (1, 6, "Paragraph", "lower"), (2, 0, "Paragraph", "A"), (2, 1, "Paragraph", "1 digit")))
R.add("c12_merge_cases", lambda s, d: C.merged_paragraphs(PARTS.df(s)), f"WITH l AS {PARTS.sql()}{MERGED}")

# ---- Markers and headings ---------------------------------------------------------------------------------------------------
MARKED = Fixture("marked", "id int, x string", rows("1. First", "12) Second", "(a) Third", "iv. Fourth", "I. Fifth", "C. Sixth", "MIX] Seventh", "• Bullet", "- dash", "-no dash", "* ", "1234. too long", "v. letter", "ii) two", "plain", "", "+ plus", "1.No space", "— em"))
R.scalar("c10_list_marker_cases", MARKED, {"kind": (lambda: L.list_marker("x")["kind"], KIND), "body": (lambda: L.list_marker("x")["body"], f"CASE WHEN ({KIND}) IS NULL THEN NULL WHEN {BUL} THEN {BBODY} ELSE regexp_extract(x, {ORD}, 3) END")})
HEADS = Fixture("heads", "id int, x string, ratio double, bold boolean, lines int", rows(("Introduction", 1.6, False, 1), ("Introduction", 1.59, False, 1), ("Introduction", 1.35, False, 1), ("Introduction", 1.18, False, 1), ("Introduction", 1.17, True, 1), ("Introduction", 1.01, True, 1), ("WARNING", 1.0, False, 1), ("ABC", 1.0, False, 1), ("A sentence.", 2.0, True, 1), ("Introduction", 2.0, True, 4), ("x" * 141, 2.0, True, 1), ("", 2.0, True, 1)))
LEVEL = f"CASE WHEN length(x) = 0 OR length(x) > 140 OR lines > 3 OR regexp_matches(x, '[.;,]$') THEN NULL WHEN ratio >= 1.6 THEN 1 WHEN ratio >= 1.35 THEN 2 WHEN ratio >= 1.18 THEN 3 WHEN bold AND ratio >= 1.02 AND length(x) <= 80 THEN 4 WHEN {CAPS} AND length(x) <= 60 THEN 4 END"
R.scalar("c06_heading_level", HEADS, {"level": (lambda: L.heading_level("x", "ratio", "bold", "lines"), LEVEL)})
R.scalar("c07_heading_reason", HEADS, {"reason": (lambda: L.heading_reason("x", "ratio", "bold"), f"CASE WHEN ratio >= 1.18 THEN printf('%.1f', round_even(ratio, 1)) || ' times body size' || CASE WHEN bold THEN ' in bold' ELSE '' END WHEN bold THEN 'bold and short' WHEN {CAPS} THEN 'capitals only' ELSE 'stands apart' END")})
FONTS = Fixture("fonts", "id int, x string", rows("Courier New", "ABCDEE+Consolas-Bold", "Arial", "DejaVuSansMono", "Source Code Pro", "Times", None))
R.scalar("c09_monospaced", FONTS, {"y": (lambda: L.monospaced("x"), "regexp_matches(lower(x), '" + "|".join(L.MONOSPACED) + "')")})
BLOCKS = Fixture("blocks", "id int, x string, ratio double, bold boolean, lines int, italic boolean, indent double, body double, font string", rows(("1. Item", 1.0, False, 1, False, 0.0, 11.0, "Arial"), ("Title", 1.7, False, 1, False, 0.0, 11.0, "Arial"), ("q" * 41, 1.0, False, 2, True, 20.0, 11.0, "Arial"), ("q" * 40, 1.0, False, 2, True, 20.0, 11.0, "Arial"), ("x = 1;", 1.0, False, 1, False, 0.0, 11.0, "Courier"), ("Body text here.", 1.0, False, 1, False, 0.0, 11.0, None)))
R.scalar("c08_block_kind", BLOCKS, {"kind": (lambda: L.block_kind("x", "ratio", "bold", "lines", "italic", "indent", "body", "font"), f"CASE WHEN ({KIND}) IS NOT NULL THEN 'ListItem' WHEN ({LEVEL}) IS NOT NULL THEN 'Heading' WHEN italic AND indent > body AND length(x) > 40 THEN 'BlockQuote' WHEN coalesce(regexp_matches(lower(font), '{'|'.join(L.MONOSPACED)}'), FALSE) THEN 'Code' ELSE 'Paragraph' END")})

# ---- Words ------------------------------------------------------------------------------------------------------------------


def _words() -> tuple[tuple, ...]:
    """Six pages with a heading, body lines and a running footer; a second document of two pages."""
    out = []
    for doc, n_pages in ((1, 6), (2, 2)):
        for page in range(1, n_pages + 1):
            at = 0
            lines = [("Part " + "ABCDEF"[page - 1], 780.0, 18.0, True, "Arial-Bold"), ("Body text of this page", 700.0, 11.0, False, "Arial"), ("and more of it", 686.0, 11.0, False, "Arial"), ("Figures in italics", 600.0, 10.96, False, "Times-Italic"), (f"Form HB1 Page {page} of 6", 40.0, 8.0, False, "Arial")]
            for text, y, size, bold, font in lines:
                x = 60.0 if doc == 1 else 45.5
                for word in text.split(" "):
                    out.append((doc, page, at, word, x, y, x + 5.5 * len(word), y + size, font, size, bold, False))
                    x, at = x + 5.5 * len(word) + 5.5, at + 1
    return tuple(out)


WORDS = Fixture("words", "doc_id int, page_no int, word_ord int, text string, l double, b double, r double, t double, font string, size double, bold boolean, italic boolean", _words())
PAGES = Fixture("pagesizes", "doc_id int, page_no int, width double, height double", tuple((d, p, 595.0, 842.0) for d, n in ((1, 6), (2, 2), (3, 1)) for p in range(1, n + 1)))
R.add("c01_body_size", lambda s, d: C.body_size(WORDS.df(s)), f"WITH w AS {WORDS.sql()}, n AS (SELECT doc_id, round_even(size, 1) AS v, sum(length(text)) AS n, min(page_no * 1000000 + word_ord) AS first_at FROM w WHERE page_no <= 12 AND size > 0 GROUP BY 1, 2) SELECT doc_id, v AS body_size FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) = 1")
R.add("c02_a02_left_margin", lambda s, d: C.left_margin(WORDS.df(s)), f"WITH w AS {WORDS.sql()}, n AS (SELECT doc_id, trunc(l / 3) AS v, count(*) AS n, min(page_no * 1000000 + word_ord) AS first_at FROM w WHERE page_no <= 8 GROUP BY 1, 2) SELECT doc_id, v * 3.0 AS left_margin FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) = 1")
LETTERS = "sum(length(text))"
R.add("c03_c04_block_type", lambda s, d: C.block_type(WORDS.df(s), ["doc_id", "page_no", "b"]), f"""WITH w AS {WORDS.sql()}, s AS (SELECT doc_id, page_no, b, arg_min(v, -n * 1000 + o) AS dominant_size FROM (SELECT doc_id, page_no, b, round_even(size, 1) AS v, {LETTERS} AS n, min(word_ord) AS o FROM w GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
f AS (SELECT doc_id, page_no, b, arg_min(font, -n * 1000 + o) AS dominant_font FROM (SELECT doc_id, page_no, b, font, {LETTERS} AS n, min(word_ord) AS o FROM w GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
m AS (SELECT doc_id, page_no, b, 2 * coalesce(sum(length(text)) FILTER (WHERE bold OR contains(lower(font), 'bold')), 0) > {LETTERS} AS mostly_bold, 2 * coalesce(sum(length(text)) FILTER (WHERE italic OR regexp_matches(lower(font), 'italic|oblique')), 0) > {LETTERS} AS mostly_italic FROM w GROUP BY ALL)
SELECT m.*, dominant_size, dominant_font FROM m JOIN s USING (doc_id, page_no, b) JOIN f USING (doc_id, page_no, b)""")
LINE_SQL = f"(SELECT doc_id, page_no, round_even(b, 1) AS base, string_agg(text, ' ' ORDER BY l, word_ord) AS text, min(l) AS l, max(r) AS r, min(b) AS b, max(t) AS t, max(size) AS size, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY round_even(w.b, 1) DESC) AS line_no FROM {WORDS.sql()} w GROUP BY doc_id, page_no, round_even(b, 1))"
R.add("s04_lines_of_words", lambda s, d: C.lines_of(WORDS.df(s)), f"SELECT doc_id, page_no, base, text, l, r, b, t, size, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY base DESC) AS INTEGER) AS line_no FROM (SELECT doc_id, page_no, round_even(b, 1) AS base, string_agg(text, ' ' ORDER BY l, word_ord) AS text, min(l) AS l, max(r) AS r, min(b) AS b, max(t) AS t, max(size) AS size FROM {WORDS.sql()} GROUP BY 1, 2, 3)")
KEY = f"trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '{WS}', ' ', 'g'))"


def _furniture_sql(units: str) -> str:
    return f"""u AS {units}, p AS (SELECT * FROM {PAGES.sql()} WHERE page_no <= 30), n AS (SELECT doc_id, count(*) AS n_pages FROM p GROUP BY 1),
k AS (SELECT DISTINCT u.doc_id, u.page_no, {KEY} AS key FROM u JOIN p ON u.doc_id = p.doc_id AND u.page_no = p.page_no WHERE u.b >= 0.88 * height OR u.b <= 0.12 * height),
furn AS (SELECT k.doc_id, key, count(*) AS n FROM k JOIN n ON n.doc_id = k.doc_id WHERE length(key) >= 2 AND n_pages >= 4 GROUP BY k.doc_id, key, n_pages HAVING count(*) >= greatest(3, 2 * n_pages // 3))"""


SIMPLE_LINES = f"(SELECT doc_id, page_no, string_agg(text, ' ' ORDER BY l, word_ord) AS text, min(b) AS b, max(t) AS t FROM {WORDS.sql()} GROUP BY doc_id, page_no, round_even(b, 1))"
R.add("c05_a03_furniture_words", lambda s, d: C.furniture(WORDS.df(s), PAGES.df(s)), f"WITH {_furniture_sql(WORDS.sql())} SELECT * FROM furn")
R.add("c05_furniture_lines", lambda s, d: C.furniture(C.lines_of(WORDS.df(s)), PAGES.df(s)), f"WITH {_furniture_sql(SIMPLE_LINES)} SELECT * FROM furn")


def c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = C.lines_of(WORDS.df(spark))
    return C.mark_furniture(lines, C.furniture(lines, PAGES.df(spark)), PAGES.df(spark)).select("doc_id", "page_no", "text", "artifact_type")


R.add("c14_j13_mark_furniture", c14, f"WITH {_furniture_sql(SIMPLE_LINES)} SELECT u.doc_id, u.page_no, text, CASE WHEN f.key IS NULL THEN NULL WHEN b > 0.85 * height THEN 'header' WHEN t < 0.15 * height THEN 'footer' ELSE 'page furniture' END AS artifact_type FROM u LEFT JOIN furn f ON f.doc_id = u.doc_id AND f.key = {KEY.replace('text', 'u.text')} LEFT JOIN {PAGES.sql()} p ON p.doc_id = u.doc_id AND p.page_no = u.page_no")

# ---- Elements ---------------------------------------------------------------------------------------------------------------
TAGGED = Fixture("tagged", "doc_id int, element_id int, page_no int, tag string, scope string, numbering string, subtype string, actual_text string, expanded string, lang string, alt string", tuple((1 + i % 2, i, 1 + i % 3, *x) for i, x in enumerate((
    ("H1", None, None, None, " Title ", None, "en", None), ("H9", None, None, None, None, None, None, None), ("H", None, None, None, None, None, None, None), ("TH", "Row", None, None, None, None, None, None), ("TH", "Column", None, None, None, None, None, None), ("TH", None, None, None, None, None, None, None),
    ("TD", None, None, None, None, None, None, None), ("L", None, "Disc", None, None, None, None, None), ("L", None, "UpperRoman", None, None, None, None, None), ("L", None, None, None, None, None, None, None), ("Artifact", None, None, "Footer", None, None, None, None), ("Artifact", None, None, "Odd", None, None, None, None),
    ("Figure", None, None, None, None, None, None, " A chart "), ("Span", None, None, None, "", "NHS ", " fr ", None), ("Custom", None, None, None, None, None, None, None), ("", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None),
))))
some = lambda c: f"nullif(trim({c}), '')"
TAG_KIND = sql_map(C.TAG_KINDS, "tag", "CASE WHEN coalesce(tag, '') = '' THEN 'Unknown' ELSE 'Section' END")
R.add("c16_c17_c19_c20_tags", lambda s, d: C.from_tags(TAGGED.df(s)), f"SELECT doc_id, element_id, tag, {TAG_KIND} AS kind, CAST({sql_map({k: str(v) for k, v in C.TAG_LEVELS.items()}, 'tag', 'NULL')} AS INTEGER) AS heading_level, CASE WHEN tag = 'TH' THEN CASE scope WHEN 'Row' THEN 'RowHeader' WHEN 'Column' THEN 'ColumnHeader' ELSE 'Header' END WHEN tag = 'TD' THEN 'Data' END AS cell_role, CASE WHEN tag = 'L' THEN {sql_map(C.NUMBERINGS, 'numbering', sql_literal('None'))} END AS marker_kind, CASE WHEN tag = 'Artifact' THEN {sql_map(C.ARTIFACTS, 'subtype', sql_literal('page furniture'))} END AS artifact_type, coalesce({some('actual_text')}, {some('expanded')}) AS actual_text, {some('lang')} AS language, CASE WHEN {TAG_KIND} = 'Figure' THEN {some('alt')} END AS alt FROM {TAGGED.sql()}")
R.add("c15_strategy", lambda s, d: C.strategy(TAGGED.df(s)), f"SELECT doc_id, page_no, CASE WHEN count(*) FILTER (WHERE tag IN ({', '.join(map(sql_literal, C.TAG_KINDS))})) > 0 THEN 'tagged' ELSE 'layout' END AS strategy FROM {TAGGED.sql()} GROUP BY doc_id, page_no")
FIELDS = Fixture("fieldboxes", "doc_id int, field_id int, page_no int, l double, t double", ((1, 1, 2, 60.0, 700.0), (1, 2, 1, 60.0, 300.04), (1, 3, 1, 200.0, 300.0), (1, 4, 1, 60.0, 700.0), (2, 1, 1, 1.0, 1.0)))
R.add("c21_o03_tab_order", lambda s, d: C.tab_order(FIELDS.df(s)), f"SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, round_even(t, 1) DESC, l, field_id) AS INTEGER) AS tab_order FROM {FIELDS.sql()}")
ELEMENTS = Fixture("elems", "doc_id int, element_id int, parent_id int, page_no int, kind string, text string, from_tags boolean", ((1, 1, None, 0, "Document", None, False), (1, 2, 1, 1, "Page", None, False), (1, 3, 2, 1, "Figure", None, False), (1, 4, 2, 1, "Artifact", "footer text", False), (1, 5, 1, 2, "Page", None, False), (1, 6, 5, 2, "Figure", None, True), (1, 7, 5, 2, "Paragraph", "Text", True), (1, 8, 5, 2, "Paragraph", " ", True),
    (2, 1, None, 1, "Figure", None, False), (2, 2, None, 1, "Paragraph", "ab", False), (3, 1, None, 1, "Paragraph", "All", True), (3, 2, None, 1, "Heading", "tagged", True), (4, 1, None, 1, "Paragraph", "none", False), (4, 2, None, 1, "FormField", None, False)))
SCAN = f"(SELECT doc_id, page_no, count(*) FILTER (WHERE kind = 'Figure') > 0 AND count(*) FILTER (WHERE kind <> 'Artifact' AND length(trim(coalesce(text, ''))) > 2) = 0 AS is_image_only FROM {ELEMENTS.sql()} GROUP BY 1, 2)"
R.add("c22_image_only_pages", lambda s, d: C.image_only(ELEMENTS.df(s)), f"SELECT * FROM {SCAN}")
R.add("c23_tagged_status", lambda s, d: C.tagged_status(ELEMENTS.df(s)), f"WITH s AS (SELECT doc_id, bool_and(is_image_only) AS scan FROM {SCAN} GROUP BY 1), c AS (SELECT doc_id, count(*) FILTER (WHERE from_tags AND kind NOT IN ('Document', 'Page', 'Section')) / count(*) FILTER (WHERE kind NOT IN ('Document', 'Page', 'Section')) AS share FROM {ELEMENTS.sql()} GROUP BY 1) SELECT s.doc_id, CASE WHEN scan THEN 'ScannedWithoutText' WHEN share >= 0.9 THEN 'FullyTagged' WHEN share >= 0.1 THEN 'PartiallyTagged' ELSE 'Untagged' END AS status FROM s JOIN c ON s.doc_id = c.doc_id")
R.add("c13_remove_empties", lambda s, d: C.without_empty(ELEMENTS.df(s)), f"WITH e AS {ELEMENTS.sql()} SELECT * FROM e WHERE trim(coalesce(text, '')) <> '' OR kind IN ('Figure', 'FormField') OR EXISTS (SELECT 1 FROM e c WHERE c.doc_id = e.doc_id AND c.parent_id = e.element_id)")
BLOCKTOPS = Fixture("blocktops", "doc_id int, page_no int, ord int, t double", ((1, 1, 0, 800.0), (1, 1, 1, 700.0), (1, 1, 2, 750.0), (1, 1, 3, 300.0)))
TABLETOPS = Fixture("tabletops", "doc_id int, page_no int, table_id int, t double", ((1, 1, 1, 760.0), (1, 1, 2, 100.0), (1, 1, 3, 900.0), (2, 1, 1, 5.0)))
R.add("c24_insert_tables", lambda s, d: C.insert_before(TABLETOPS.df(s), BLOCKTOPS.df(s)), f"SELECT x.doc_id, x.page_no, table_id, coalesce(min(ord) FILTER (WHERE b.t < x.t), max(ord) + 1, 0) AS at FROM {TABLETOPS.sql()} x LEFT JOIN {BLOCKTOPS.sql()} b ON b.doc_id = x.doc_id AND b.page_no = x.page_no GROUP BY 1, 2, 3")

# ---- Search -----------------------------------------------------------------------------------------------------------------
OFFS = "(SELECT *, list_transform(range(1, len(s)), lambda i: CAST(list_sum(list_transform(s[1:i], lambda p: length(p))) + (i - 1) * {n} AS INTEGER)) AS ats FROM (SELECT *, string_split({x}, '{t}') AS s FROM e))"


def _search_sql(lines: str, term: str, case: bool = False, words_only: bool = False) -> str:
    x, t, n = ("text", term, len(term)) if case else ("lower(text)", term.lower(), len(term))
    word = f"WHERE NOT (place > 0 AND regexp_matches(text[place:place], '[\\p{{L}}\\p{{Nd}}]')) AND NOT regexp_matches(text[place + {n} + 1:place + {n} + 1], '[\\p{{L}}\\p{{Nd}}]')" if words_only else ""
    lo, hi = "greatest(0, place - 70)", f"least(length(text), place + {n} + 70)"
    before, after = f"text[{lo} + 1:place]", f"text[place + {n} + 1:{hi}]"
    left = f"CASE WHEN {lo} > 0 AND NOT regexp_matches(text[{lo}:{lo}], '\\s') THEN regexp_replace({before}, '^\\S+', '') ELSE {before} END"
    right = f"CASE WHEN {hi} < length(text) AND NOT regexp_matches(text[{hi} + 1:{hi} + 1], '\\s') THEN regexp_replace({after}, '\\S+$', '') ELSE {after} END"
    return f"""WITH e0 AS {lines}, e AS (SELECT *, last_value(CASE WHEN kind = 'Heading' AND trim(text) <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM e0 WHERE kind <> 'Artifact'),
o AS {OFFS.format(n=n, x=x, t=t)}, m AS (SELECT doc_id, reading_order, page_no, text, heading, unnest(ats) AS place FROM o), k AS (SELECT * FROM m {word})
SELECT doc_id, CAST(reading_order AS INTEGER) AS reading_order, page_no, place, CASE WHEN {lo} = 0 THEN '' ELSE '… ' END || trim({left} || text[place + 1:place + {n}] || {right}) || CASE WHEN {hi} = length(text) THEN '' ELSE ' …' END AS context, heading, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY reading_order, place) AS INTEGER) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM k"""


R.add("q01_q02_q04_q05_search", lambda s, d: Q.search(A.text_elements(s, d), "tion"), _search_sql(LINES, "tion"))
R.add("q03_whole_words", lambda s, d: Q.search(A.text_elements(s, d), "the", words_only=True), _search_sql(LINES, "the", words_only=True))
R.add("q01_match_case", lambda s, d: Q.search(A.text_elements(s, d), "The", match_case=True), _search_sql(LINES, "The", case=True))
R.add("q06_w04_next_match", lambda s, d: Q.next_match(Q.search(A.text_elements(s, d), "with", words_only=True)), f"WITH s AS ({_search_sql(LINES, 'with', words_only=True)}) SELECT doc_id, n, CAST(n % total + 1 AS INTEGER) AS next_n, CAST((n + total - 2) % total + 1 AS INTEGER) AS previous_n FROM s")


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict:
    return R.sql
