"""Queries of serialisation, announcements and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import announce as AN
from quire.functions import text as T
from quire.operators import render as K
from quire.operators import tree as TR
from quire.sources import adapters as A

from .fixture import Fixture, Registry, sql_literal
from .match_queries import CELLS, THREADS
from .structure_queries import LINES
from .text_queries import VAGUE, rows, sql_map
from .tree_queries import TREE, WALK

R = Registry()
esc = lambda x: f"replace(replace(replace(replace(replace(coalesce({x}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
said = lambda x: f"trim(coalesce({x}, '')) <> ''"
FLAT = Fixture("flat", "doc_id int, element_id int, reading_order int, page_no int, kind string, level int, text string, language string, rtl boolean, decorative boolean, alt string, target_kind string, target string, artifact_type string", tuple((1 + i // 9, i, i, 1 + i // 6, *x) for i, x in enumerate((
    ("Heading", None, "A & B", None, False, False, None, None, None, None), ("Heading", 7, "Deep", "fr", False, False, None, None, None, None), ("Paragraph", None, "Text <b>", None, True, False, None, None, None, None), ("Paragraph", None, " ", None, False, False, None, None, None, None), ("BlockQuote", None, "Quote", None, False, False, None, None, None, None),
    ("Code", None, "x = 1", None, False, False, None, None, None, None), ("Note", None, "Note", None, False, False, None, None, None, None), ("Artifact", None, "footer", None, False, False, None, None, None, "footer"), ("Figure", None, None, None, False, True, None, None, None, None), ("Figure", None, None, None, False, False, "A \"chart\"", None, None, None),
    ("Figure", None, None, None, False, False, None, None, None, None), ("Link", None, "here", None, False, False, None, "WebUrl", "https://example.org", None), ("Link", None, "", None, False, False, None, "WebUrl", "https://example.org", None), ("Link", None, "page", None, False, False, None, "InternalDestination", "p3", None), ("Caption", None, "Cap", None, False, False, None, None, None, None), ("ListItem", None, "Item", None, False, False, None, None, None, None),
))))
ATTRS = f"' id=\"e' || element_id || '\"' || CASE WHEN kind = 'Link' THEN '' ELSE ' tabindex=\"-1\"' END || CASE WHEN {said('language')} THEN ' lang=\"' || {esc('trim(language)')} || '\"' ELSE '' END || CASE WHEN rtl THEN ' dir=\"rtl\"' ELSE '' END"
TX = esc("text")
tag = lambda n: f"'<{n}' || {ATTRS} || '>' || {TX} || '</{n}>'"
HN = "'h' || greatest(1, least(6, coalesce(level, 2)))"
FLAT_SQL = f"""CASE WHEN kind = 'Artifact' THEN NULL WHEN kind = 'Figure' THEN CASE WHEN decorative THEN '<img' || {ATTRS} || ' alt="">' WHEN {said('alt')} THEN '<figure' || {ATTRS} || '><img alt="' || {esc('alt')} || '"><figcaption>' || {esc('alt')} || '</figcaption></figure>' ELSE '<button id="e' || element_id || '">Image without a description</button>' END
WHEN kind = 'Link' THEN '<a' || {ATTRS} || ' href="' || {esc('target')} || '">' || CASE WHEN {said('text')} THEN {TX} ELSE {esc('target')} END || '</a>' || CASE WHEN target_kind IN ('WebUrl', 'Email') AND {said('text')} AND text <> target THEN ' (' || {esc('target')} || ')' ELSE '' END
WHEN NOT {said('text')} THEN NULL WHEN kind = 'Heading' THEN '<' || {HN} || {ATTRS} || '>' || {TX} || '</' || {HN} || '>' WHEN kind = 'BlockQuote' THEN {tag('blockquote')} WHEN kind = 'Code' THEN '<pre' || {ATTRS} || '><code>' || {TX} || '</code></pre>' WHEN kind = 'Note' THEN {tag('aside')} WHEN kind IN ('Caption', 'Paragraph', 'ListItem') THEN {tag('p')} END"""
R.scalar("h02_h03_h04_h07_h08_h11_markup", FLAT, {"html": (lambda: K.flat_html(), FLAT_SQL)}, "doc_id,element_id,kind")
HTML_DOC = "WITH x AS (SELECT doc_id, page_no, string_agg(m, chr(10) ORDER BY reading_order) AS body FROM (SELECT *, {m} AS m FROM {t}) WHERE m IS NOT NULL GROUP BY 1, 2), n AS (SELECT doc_id, max(page_no) AS pages FROM {t} GROUP BY 1) SELECT x.doc_id, string_agg('<section aria-label=\"Page ' || page_no || CASE WHEN pages > 1 THEN ' of ' || pages ELSE '' END || '\">' || chr(10) || body || chr(10) || '</section>', chr(10) ORDER BY page_no) AS html FROM x JOIN n ON n.doc_id = x.doc_id GROUP BY x.doc_id"
R.add("k01_h01_document_html", lambda s, d: K.document_html(FLAT.df(s)), HTML_DOC.format(m=FLAT_SQL, t=FLAT.sql()))


def k01_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.document_lines(spark, sf_dir).withColumn("element_id", F.col("reading_order"))
    e = e.withColumn("level", F.when(F.col("kind") == "Heading", 4)).withColumn("language", F.col("lang"))
    return K.document_html(e.withColumns({"rtl": F.lit(False), "decorative": F.lit(False), "alt": F.lit(None).cast("string"), "target_kind": F.lit(None).cast("string"), "target": F.lit(None).cast("string")}))


AS_FLAT = f"(SELECT doc_id, reading_order AS element_id, reading_order, page_no, kind, CASE WHEN kind = 'Heading' THEN 4 END AS level, text, lang AS language, FALSE AS rtl, FALSE AS decorative, NULL AS alt, NULL AS target_kind, NULL AS target FROM {LINES})"
R.add("k01_html_of_documents", k01_documents, HTML_DOC.format(m=FLAT_SQL, t=AS_FLAT))
HEADS = Fixture("heads", "id int, title string, file string, lang string", rows(("Report & more", "a.pdf", "en-GB"), (" ", "b.pdf", None), (None, "c.pdf", "fr")))
R.scalar("h12_document_head", HEADS, {"head": (lambda: K.html_head("title", "file", "lang"), f"'<!DOCTYPE html><html lang=\"' || {esc(chr(99) + 'oalesce(nullif(trim(lang), ' + sql_literal('') + '), ' + sql_literal('en') + ')')} || '\"><head><meta charset=\"utf-8\"><meta http-equiv=\"Content-Security-Policy\" content=\"default-src ''none''\"><title>' || {esc('coalesce(nullif(trim(title), ' + sql_literal('') + '), file)')} || '</title></head>'")})
SPANS = Fixture("spancells", "table_id int, row_no int, cell_ord int, text string, role string, col_span int, row_span int", ((1, 0, 0, "Month", "ColumnHeader", 1, 1), (1, 0, 1, "Rev & cost", "Header", 2, 1), (1, 1, 0, "March", "RowHeader", 1, 2), (1, 1, 1, "4200", "Data", 1, 1), (1, 1, 2, "3100", "Data", 1, 1), (2, 0, 0, "a", "Header", 1, 1), (2, 0, 1, "b", "Data", 1, 1)))


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.table_html(SPANS.df(spark))


SCOPE = "CASE WHEN role = 'ColumnHeader' THEN 'col' WHEN role = 'RowHeader' THEN 'row' WHEN role = 'Header' THEN CASE WHEN head THEN 'col' ELSE 'row' END END"
CELL = f"'<' || CASE WHEN role = 'Data' THEN 'td' ELSE 'th scope=\"' || {SCOPE} || '\"' END || CASE WHEN col_span > 1 THEN ' colspan=\"' || col_span || '\"' ELSE '' END || CASE WHEN row_span > 1 THEN ' rowspan=\"' || row_span || '\"' ELSE '' END || '>' || {TX} || CASE WHEN role = 'Data' THEN '</td>' ELSE '</th>' END"
R.add("h05_table_html", rendered, f"""WITH c AS (SELECT *, bool_and(role <> 'Data') OVER (PARTITION BY table_id, row_no) AND row_no = min(row_no) OVER (PARTITION BY table_id) AS head FROM {SPANS.sql()}), r AS (SELECT table_id, row_no, head, '<tr>' || string_agg({CELL}, '' ORDER BY cell_ord) || '</tr>' AS row FROM c GROUP BY 1, 2, 3)
SELECT table_id, '<table>' || coalesce('<thead>' || string_agg(row, '' ORDER BY row_no) FILTER (WHERE head) || '</thead>', '') || '<tbody>' || coalesce(string_agg(row, '' ORDER BY row_no) FILTER (WHERE NOT head), '') || '</tbody></table>' AS html FROM r GROUP BY table_id""")


def h06(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = TREE.df(spark)
    parents = e.select("doc_id", F.col("element_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    w = TR.paths(spark, e).join(parents, ["doc_id", "parent_id"], "left").withColumn("marker_kind", F.when(F.col("element_id") == 7, "LowerAlpha").otherwise("Bullet"))
    return K.nested(K.list_events(w))


R.add("h06_nested_lists", h06, f"""WITH RECURSIVE {WALK}, l AS (SELECT we.doc_id, we.path, we.kind, we.text, we.element_id = 7 AS alpha FROM we WHERE kind IN ('List', 'ListItem')),
v AS (SELECT doc_id, path AS k, CASE WHEN kind = 'List' THEN CASE WHEN alpha THEN '<ol type="a">' ELSE '<ul>' END ELSE '<li>' || {TX} END AS m FROM l UNION ALL SELECT doc_id, path || '~', CASE WHEN kind = 'List' THEN CASE WHEN alpha THEN '</ol>' ELSE '</ul>' END ELSE '</li>' END FROM l) SELECT doc_id, string_agg(m, '' ORDER BY k) AS html FROM v GROUP BY doc_id""")
R.add("h09_comment_html", lambda s, d: A.threads(s, d).select("doc_id", "annotation_id", K.comment_html("author", "text", F.lit("")).alias("html")), f"SELECT doc_id, annotation_id, '<article><h3>' || {esc('author')} || '</h3><p>' || {TX} || '</p><button>Reply</button><button>Edit</button><button>Delete</button></article>' AS html FROM {THREADS}")
CONTROLS = Fixture("controls", "element_id int, field_kind string, label string, value string, required boolean, read_only boolean, invalid boolean, unlabelled boolean", ((1, "Text", "Name <1>", "x\"y", True, False, False, False), (2, "CheckBox", "Agree", "on", False, True, False, False), (3, "MultilineText", "Notes", "a & b", False, False, True, False), (4, "ComboBox", "unlabelled field", "", False, False, False, True)))
CN = sql_map(K.CONTROLS, "field_kind", "'input'")
R.scalar("h10_form_controls", CONTROLS, {"html": (K.control_html, f"'<label for=\"e' || element_id || '\">' || {esc('label')} || '</label><' || {CN} || ' id=\"e' || element_id || '\"' || CASE field_kind WHEN 'CheckBox' THEN ' type=\"checkbox\"' WHEN 'Text' THEN ' type=\"text\"' ELSE '' END || CASE WHEN required THEN ' required' ELSE '' END || CASE WHEN read_only THEN ' readonly' ELSE '' END || CASE WHEN invalid THEN ' aria-invalid=\"true\"' ELSE '' END || CASE WHEN field_kind = 'Text' THEN ' value=\"' || {esc('value')} || '\"' ELSE '' END || '>' || CASE WHEN {CN} = 'input' THEN '' ELSE {esc('value')} || '</' || {CN} || '>' END || CASE WHEN unlabelled THEN '<p>This field has no label.</p>' ELSE '' END")}, "element_id")

# ---- Linear text ------------------------------------------------------------------------------------------------------------
TRIM = "trim(coalesce(text, ''))"
FIG = f"CASE WHEN decorative THEN '[Decorative image]' WHEN {said('alt')} THEN '[Image: ' || alt || ']' ELSE '[Image with no description]' END"


def line_sql(mode: str) -> str:
    if mode == "Raw":
        return f"CASE WHEN kind NOT IN ('Document', 'Page', 'Section', 'TableRow', 'Table', 'List', 'Artifact') THEN nullif({TRIM}, '') END"
    art = f"'[' || artifact_type || ': ' || {TRIM} || ']'" if mode == "Layout" else "NULL"
    return f"CASE WHEN kind IN ('Document', 'Page', 'Section') THEN NULL WHEN kind = 'Artifact' THEN {art} WHEN kind = 'Figure' THEN {FIG} WHEN {TRIM} = '' THEN NULL WHEN kind = 'Heading' THEN 'Heading ' || coalesce(level, 0) || ': ' || {TRIM} WHEN kind = 'ListItem' THEN '  • ' || {TRIM} WHEN kind = 'Link' THEN '[Link: ' || {TRIM} || ']' WHEN kind = 'Caption' THEN 'Caption: ' || {TRIM} WHEN kind = 'BlockQuote' THEN 'Quote: ' || {TRIM} WHEN kind = 'Annotation' THEN '[comment: ' || {TRIM} || ']' ELSE {TRIM} END"


def text_sql(t: str, mode: str, line: str | None = None) -> str:
    rule = "0" if mode == "Raw" else "CASE WHEN page_no > coalesce(max(page_no) OVER (PARTITION BY doc_id ORDER BY reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AND page_no > 0 THEN length('--- Page ' || page_no || ' ---') + 4 ELSE 0 END"
    return f"""WITH e AS (SELECT *, {line or line_sql(mode)} AS line FROM {t}), k AS (SELECT *, {rule} AS rule, row_number() OVER (PARTITION BY doc_id ORDER BY reading_order) = 1 AS first FROM e WHERE line IS NOT NULL),
l AS (SELECT *, CASE WHEN first THEN 0 WHEN rule > 0 THEN 2 ELSE 0 END + rule + CASE WHEN rule > 0 OR NOT first THEN 4 ELSE 0 END AS lead FROM k)
SELECT doc_id, CAST(reading_order AS INTEGER) AS reading_order, CAST(sum(lead + length(line)) OVER (PARTITION BY doc_id ORDER BY reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(line) AS BIGINT) AS start, CAST(length(line) AS INTEGER) AS length, line FROM l"""


for _mode in ("Structured", "Layout", "Raw"):
    R.add(f"k02_x01_x02_text_{_mode.lower()}", lambda s, d, m=_mode: K.linear_text(FLAT.df(s), m), text_sql(FLAT.sql(), _mode))


def k02_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.text_elements(spark, sf_dir)
    return K.linear_text(e.withColumns({"level": F.lit(4), "alt": F.lit(None).cast("string"), "decorative": F.lit(False), "artifact_type": F.lit(None).cast("string")}))


R.add("k02_x04_w05_text_of_documents", k02_documents, text_sql(f"(SELECT *, 4 AS level, NULL AS alt, FALSE AS decorative, NULL AS artifact_type FROM {LINES})", "Structured"))
R.add("x03_row_lines", lambda s, d: K.row_lines(CELLS.df(s).withColumn("cell_ord", F.col("column_index"))), f"SELECT table_id, row_no, CASE WHEN bool_and(role <> 'Data') THEN '  Headings: ' ELSE '  ' END || string_agg(CASE WHEN {said('text')} THEN text ELSE '(blank)' END, '  |  ' ORDER BY column_index) AS line FROM {CELLS.sql()} GROUP BY 1, 2")

ALL_KINDS = Fixture("allkinds", "id int, kind string, level int, text string, alt string, decorative boolean, artifact_type string, target string, rows int, columns int, has_header boolean, items int, label string, required boolean, read_only boolean, value string, has_value boolean", rows(
    ("Table", None, None, None, False, None, None, 3, 1, True, 0, None, False, False, None, False), ("Table", None, None, None, False, None, None, 1, 2, False, 0, None, False, False, None, False), ("List", None, None, None, False, None, None, 0, 0, False, 1, None, False, False, None, False), ("List", None, "", None, False, None, None, 0, 0, False, 4, None, False, False, None, False),
    ("TableCell", None, " 42 ", None, False, None, None, 0, 0, False, 0, None, False, False, None, False), ("TableCell", None, None, None, False, None, None, 0, 0, False, 0, None, False, False, None, False), ("FormField", None, None, None, False, None, None, 0, 0, False, 0, "Name", True, False, "Ann", True), ("FormField", None, None, None, False, None, None, 0, 0, False, 0, "Date", False, True, "", False),
    ("Link", None, "", None, False, None, "example.org", 0, 0, False, 0, None, False, False, None, False), ("Link", None, "Report", None, False, None, "example.org", 0, 0, False, 0, None, False, False, None, False), ("Heading", 2, "Part", None, False, None, None, 0, 0, False, 0, None, False, False, None, False), ("Figure", None, None, "A map", False, None, None, 0, 0, False, 0, None, False, False, None, False)))
pls = lambda n, one: f"({n} || CASE WHEN {n} = 1 THEN ' {one}' ELSE ' {one}s' END)"
R.scalar("x02_lines_of_all_kinds", ALL_KINDS, {"line": (lambda: K.full_line("Structured"), f"CASE WHEN kind = 'Table' THEN 'Table: ' || {pls('rows', 'row')} || ', ' || {pls('columns', 'column')} || CASE WHEN has_header THEN '' ELSE ', no header cells' END WHEN kind = 'List' THEN 'List of ' || {pls('items', 'item')} WHEN kind = 'TableCell' THEN '    ' || CASE WHEN {TRIM} = '' THEN '(blank)' ELSE {TRIM} END WHEN kind = 'FormField' THEN '[form field: ' || concat_ws(', ', label, CASE WHEN required THEN 'required' END, CASE WHEN has_value THEN value ELSE 'not filled in' END, CASE WHEN read_only THEN 'read-only' END) || ']' WHEN kind = 'Link' AND {TRIM} = '' THEN '[Link: ' || coalesce(target, '') || ']' ELSE {line_sql('Structured')} END")})

# ---- Announcements ----------------------------------------------------------------------------------------------------------
PARTS = Fixture("parts", "id int, kind string, level int, n int, total int, text string, alt string, decorative boolean, marker string, author string", rows(
    ("Heading", 2, 0, 0, "Revenue", None, False, None, None), ("Heading", None, 0, 0, "Bare", None, False, None, None), ("List", None, 0, 3, None, None, False, "Bullet", None), ("List", None, 0, 1, None, None, False, "UpperRoman", None), ("List", None, 0, 0, None, None, False, None, None), ("ListItem", None, 2, 3, "Second", None, False, None, None),
    ("Table", None, 4, 1, None, None, False, None, None), ("Figure", None, 0, 0, None, "A chart", False, None, None), ("Figure", None, 0, 0, None, None, False, None, None), ("Figure", None, 0, 0, None, None, True, None, None), ("Annotation", None, 0, 2, "Nice", None, False, None, "Ann"), ("Page", None, 3, 0, None, None, False, None, None), ("Paragraph", None, 0, 0, "Plain", None, False, None, None)))
pl = lambda n, one: f"({n} || CASE WHEN {n} = 1 THEN ' {one}' ELSE ' {one}s' END)"
R.scalar("t26_kind_parts", PARTS, {"y": (AN.kind_parts, f"CASE kind WHEN 'Heading' THEN concat_ws(', ', CASE WHEN level IS NULL THEN 'heading' ELSE 'heading level ' || level END, text) WHEN 'List' THEN {sql_map(AN.LIST_NAMES, 'marker', sql_literal('list'))} || ', ' || CASE WHEN total = 0 THEN 'empty' ELSE 'with ' || {pl('total', 'item')} END WHEN 'ListItem' THEN 'item ' || n || ' of ' || total || ', ' || text WHEN 'Table' THEN 'table, ' || {pl('n', 'row')} || ', ' || {pl('total', 'column')} WHEN 'Figure' THEN CASE WHEN decorative THEN 'decorative image' WHEN {said('alt')} THEN 'figure, ' || alt ELSE 'figure, no description available' END WHEN 'Annotation' THEN concat_ws(', ', 'comment', CASE WHEN author IS NOT NULL THEN 'by ' || author END, text, CASE WHEN total > 0 THEN total || CASE WHEN total = 1 THEN ' reply' ELSE ' replies' END END) WHEN 'Page' THEN 'page ' || n ELSE text END")})
SAYS = ("kind", "text", "alt", "caption", "description", "target", "author", "anchored", "file_name", "size_text", "summary", "role", "row_header", "column_header", "label", "value", "button_caption", "hint", "label_source", "guidance", "action")
SAYS_INT, SAYS_BOOL = ("items", "rows", "columns", "replies", "nested_items", "column_span", "row_span"), ("decorative", "tiny", "has_header", "unsaved", "required", "read_only", "invalid", "modified", "signed")


def _says(**given: object) -> tuple:
    return tuple(given.get(n, False if n in SAYS_BOOL else None if n in SAYS or n == "nested_items" else 0) for n in (*SAYS, *SAYS_INT, *SAYS_BOOL))


SAID_BY = Fixture("saidby", "id int, " + ", ".join([*(f"{n} string" for n in SAYS), *(f"{n} int" for n in SAYS_INT), *(f"{n} boolean" for n in SAYS_BOOL)]), rows(
    _says(kind="Figure", alt="A chart"), _says(kind="Figure", caption="Sales"), _says(kind="Figure", decorative=True), _says(kind="Figure", tiny=True, alt=" "), _says(kind="Link", text="Report", target="example.org", hint="press Enter to follow"),
    _says(kind="Link", text="here", target="example.org"), _says(kind="Link", text="", target="example.org", description="the report"), _says(kind="Link", text=None, target="example.org"), _says(kind="Annotation", text="Nice", author="Ann", anchored="some words", replies=1, unsaved=True),
    _says(kind="Annotation", replies=3), _says(kind="Annotation", anchored="only this", hint="press Enter"), _says(kind="Attachment", file_name="a.csv", size_text="2 kilobytes", description="figures"), _says(kind="List", items=0), _says(kind="List", items=1), _says(kind="List", items=7),
    _says(kind="ListItem", text="One", nested_items=2), _says(kind="ListItem", text="Two"), _says(kind="Table", rows=2, columns=1, summary="Totals"), _says(kind="Table", rows=1, columns=3, has_header=True), _says(kind="TableRow", text="a, b"),
    _says(kind="TableCell", text="4200", has_header=True, row_header="March", column_header="Revenue"), _says(kind="TableCell", text="", has_header=True, column_header="Revenue", column_span=2), _says(kind="TableCell", text="Month", role="ColumnHeader", has_header=True, column_header="x", row_span=3), _says(kind="TableCell", text="5"),
    _says(kind="FormField", label="Name", value="Ann", required=True, label_source="nearby", guidance="at most 20 characters"), _says(kind="FormField", label="Date", value="", read_only=True, invalid=True, modified=True, label_source="name"), _says(kind="FormField", label="unlabelled field", label_source="none"),
    _says(kind="FormField", label="Sign", value="signed", signed=True, label_source="tooltip"), _says(kind="Button", label="b1", button_caption=" Send ", action="send this form's answers"), _says(kind="Button", label="Clear", button_caption=" ", read_only=True), _says(kind="Heading", text="Part"), _says(kind="Paragraph")))
VAGUE_TEXT = VAGUE.replace("(x", "(text").replace("trim(x)", "trim(text)")


def _content_sql(full: bool) -> str:
    by = "CASE WHEN coalesce(author, '') <> '' THEN 'by ' || author END" if full else "CAST(NULL AS VARCHAR)"
    cell = "CASE WHEN coalesce(role, 'Data') = 'Data' AND has_header THEN concat_ws(', ', nullif(row_header, ''), nullif(column_header, ''), coalesce(nullif(text, ''), 'blank')) ELSE coalesce(nullif(text, ''), 'blank') END" if full else "coalesce(nullif(text, ''), 'blank')"
    return f"""CASE kind WHEN 'Figure' THEN CASE WHEN decorative THEN '' WHEN {said('alt')} THEN alt WHEN coalesce(caption, '') <> '' THEN 'no description. Caption reads: ' || caption ELSE 'no description available' END
WHEN 'Link' THEN coalesce(nullif(description, ''), CASE WHEN coalesce(text, '') = '' THEN target WHEN NOT {VAGUE_TEXT} THEN text ELSE text || ', to ' || target END)
WHEN 'Annotation' THEN concat_ws(', ', {by}, 'over ' || nullif(anchored, ''), coalesce(nullif(text, ''), CASE WHEN {by} IS NULL AND coalesce(anchored, '') = '' THEN 'no text' END))
WHEN 'Attachment' THEN concat_ws(', ', file_name, nullif(description, ''){", size_text" if full else ""}) WHEN 'List' THEN CASE WHEN items = 0 THEN 'empty' ELSE 'with ' || {pls('items', 'item')} END
WHEN 'Table' THEN concat_ws('. ', {pls('rows', 'row')} || ', ' || {pls('columns', 'column')}, nullif(summary, '')) WHEN 'TableCell' THEN {cell} WHEN 'Button' THEN coalesce(nullif(trim(button_caption), ''), label) WHEN 'FormField' THEN concat_ws(', ', label, nullif(value, '')) ELSE coalesce(text, '') END"""


def _state_sql(full: bool, detailed: bool) -> str:
    on = lambda x, flag: x if flag else "CAST(NULL AS VARCHAR)"
    source = "CASE label_source WHEN 'none' THEN 'this field has no label in the document' WHEN 'nearby' THEN 'label guessed from the page' WHEN 'name' THEN 'label taken from the field''s internal name' END"
    field = f"concat_ws(', ', CASE WHEN required THEN 'required' END, CASE WHEN read_only THEN 'read-only' END, CASE WHEN invalid THEN 'invalid entry' END, {on(source, detailed)}, CASE WHEN modified THEN 'changed' END, {on('nullif(guidance, chr(0))', detailed)})"
    spans = "concat_ws(', ', CASE WHEN column_span > 1 THEN 'spans ' || column_span || ' columns' END, CASE WHEN row_span > 1 THEN 'spans ' || row_span || ' rows' END)"
    return f"""coalesce(CASE kind WHEN 'Figure' THEN {on(f"CASE WHEN NOT decorative AND NOT {said('alt')} AND NOT tiny THEN 'needs a description' END", full)}
WHEN 'Link' THEN concat_ws(', ', {on(f"CASE WHEN {VAGUE_TEXT} AND description IS NULL THEN 'link text does not describe its destination' END", full)}, {on("nullif(hint, '')", detailed)})
WHEN 'Annotation' THEN concat_ws(', ', CASE WHEN replies > 0 THEN replies || CASE WHEN replies = 1 THEN ' reply' ELSE ' replies' END END, CASE WHEN unsaved THEN 'not saved' END, {on("nullif(hint, '')", detailed)})
WHEN 'ListItem' THEN {on("CASE WHEN nested_items IS NOT NULL THEN 'contains a list of ' || nested_items || ' items' END", full)} WHEN 'Table' THEN {on("CASE WHEN NOT has_header THEN 'no header cells, so cells cannot be announced with their headings' END", full)}
WHEN 'TableCell' THEN {on(spans, full)} WHEN 'Button' THEN concat_ws(', ', {on("'will ' || nullif(action, '')", full)}, nullif({field}, '')) WHEN 'FormField' THEN concat_ws(', ', {on("CASE WHEN signed THEN 'signature not verified by this editor' END", detailed)}, nullif({field}, '')) END, '')"""


R.scalar("t26_contents_and_states", SAID_BY, {
    **{f"content_{v.lower()}": (lambda v=v: AN.content(v), _content_sql(v != "Terse")) for v in ("Terse", "Normal")},
    **{f"state_{v.lower()}": (lambda v=v: AN.state(v), _state_sql(v != "Terse", v == "Detailed")) for v in ("Terse", "Normal", "Detailed")},
})
OPEN = Fixture("opening", "id int, name string, pages int, status string, fields int, open_fields int, headings int, comments int", rows(("Report", 1, "FullyTagged", 0, 0, 3, 0), ("Form", 6, "Untagged", 9, 2, 0, 1), ("Scan", 2, "ScannedWithoutText", 0, 0, 0, 0), ("Mix", 3, "PartiallyTagged", 4, 0, 1, 5)))
R.scalar("t28_opening_announcement", OPEN, {"y": (AN.opening, f"concat_ws('. ', name, {pl('pages', 'page')}, {sql_map(AN.STATUS, 'status', sql_literal('unknown structure'))}, CASE WHEN fields > 0 THEN fields || ' form fields' || CASE WHEN open_fields > 0 THEN ', ' || open_fields || ' still to fill in' ELSE '' END END, CASE WHEN headings > 0 THEN headings || ' headings' END, CASE WHEN comments > 0 THEN {pl('comments', 'comment')} END) || '.'")})
R.scalar("t34_form_list_line", OPEN, {"y": (lambda: AN.form_line("name", F.col("status"), F.col("open_fields") > 0), "CASE WHEN open_fields > 0 THEN '* ' ELSE '  ' END || name || ': ' || status")})
R.scalar("t35_summary_sentences", OPEN, {"saved": (lambda: AN.note_count("fields"), "CASE WHEN fields = 0 THEN 'saved' ELSE 'saved, ' || fields || CASE WHEN fields = 1 THEN ' thing to note' ELSE ' things to note' END END"), "tagged": (lambda: AN.tag_sentence("headings", "pages", F.col("comments") / 5.0), f"CASE WHEN headings = 0 THEN 'nothing to tag' WHEN comments / 5.0 >= 0.66 THEN 'tagged ' || headings || ' items on ' || {pl('pages', 'page')} ELSE 'tagged ' || headings || ' items, only ' || CAST(round_even(comments / 5.0 * 100, 0) AS INTEGER) || ' percent of the text' END")})
NOTES = Fixture("notes", "id int, kind string, l double, b double, r double, t double", rows(("Comment", 100.0, 500.0, 300.0, 520.0), ("Highlight", 100.0, 500.0, 300.0, 520.0), ("Stamp", 1.0, 2.0, 3.0, 4.0)))
NOTE = "kind IN ('Comment', 'FreeText', 'FileAttachment')"
R.scalar("t37_comment_rectangle", NOTES, {"l": (lambda: AN.comment_box()["l"], "l"), "b": (lambda: AN.comment_box()["b"], f"CASE WHEN {NOTE} THEN t - 20 ELSE b END"), "r": (lambda: AN.comment_box()["r"], f"CASE WHEN {NOTE} THEN l + 20 ELSE r END"), "t": (lambda: AN.comment_box()["t"], "t")})


def t33(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of the pages as label and value."""
    e = A.page_elements(spark, sf_dir)
    g = e.groupBy("doc_id").agg(F.max(F.when(F.col("kind") == "Title", F.col("text"))).alias("title"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("Heading", "Link", "Figure")))
    return AN.properties(g, {"Title": "title", "Headings": "Heading", "Links": "Link", "Images": "Figure"})


PROP = f"(SELECT doc_id, max(text) FILTER (WHERE kind = 'Title') AS title, count(*) FILTER (WHERE kind = 'Heading') AS h, count(*) FILTER (WHERE kind = 'Link') AS l, count(*) FILTER (WHERE kind = 'Figure') AS f FROM {A.PAGE_ELEMENTS_SQL} GROUP BY doc_id)"
R.add("t33_document_properties", t33, f"SELECT doc_id, label, coalesce(nullif(value, ''), '(none)') AS value FROM (SELECT doc_id, 'Title' AS label, title AS value FROM {PROP} UNION ALL SELECT doc_id, 'Headings', h || '' FROM {PROP} UNION ALL SELECT doc_id, 'Links', l || '' FROM {PROP} UNION ALL SELECT doc_id, 'Images', f || '' FROM {PROP})")

# ---- Scans ------------------------------------------------------------------------------------------------------------------
IMAGES = Fixture("images", "doc_id int, page_no int, ord int, l double, b double, r double, t double, mask boolean", ((1, 1, 0, 1.0, 1.0, 9.0, 9.0, False), (1, 1, 1, 0.0, 0.0, 2.0, 2.0, True)))
R.add("s06_figure_scan", lambda s, d: IMAGES.df(s).select("doc_id", "page_no", "ord", F.lit("Figure").alias("kind"), F.col("mask").alias("decorative"), (F.col("r") - F.col("l")).alias("width")), f"SELECT doc_id, page_no, ord, 'Figure' AS kind, mask AS decorative, r - l AS width FROM {IMAGES.sql()}")
META = Fixture("meta", "doc_id int, title string, author string, xmp string", ((1, " Report ", "", "<pdfuaid:part>1</pdfuaid:part>"), (2, None, "Ann", "<x/>"), (3, "  ", None, None)))
R.add("s11_metadata", lambda s, d: META.df(s).select("doc_id", *(F.nullif(F.trim(c), F.lit("")).alias(c) for c in ("title", "author")), F.coalesce(F.contains("xmp", F.lit("pdfuaid")), F.lit(False)).alias("claims_ua")), f"SELECT doc_id, nullif(trim(title), '') AS title, nullif(trim(author), '') AS author, coalesce(contains(xmp, 'pdfuaid'), FALSE) AS claims_ua FROM {META.sql()}")
R.add("s01_s02_lenient_page_load", lambda s, d: _loaded(s, d), "SELECT page_id, CASE WHEN html IS NULL THEN 'missing' WHEN trim(html) = '' THEN 'empty' WHEN NOT contains(lower(html), '<html') THEN 'not html' ELSE 'ok' END AS state FROM pages")
R.add("t10_t24_roles_of_pages", lambda s, d: A.page_elements(s, d).groupBy(T.role("kind").alias("role")).agg(F.count("*").alias("n")), f"SELECT {sql_map(T.ROLES, 'kind', sql_literal(''))} AS role, count(*) AS n FROM {A.PAGE_ELEMENTS_SQL} GROUP BY 1")


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.sources import loader

    good, bad = loader.load_pages(A.read(spark, sf_dir, "pages"))
    return good.select("page_id", F.lit("ok").alias("state")).unionByName(bad.select("page_id", F.col("error").alias("state")))


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict:
    return R.sql
