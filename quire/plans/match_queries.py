"""Queries of matching and table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import match as J
from quire.operators import tables as TD
from quire.sources import adapters as A

from .fixture import Fixture, Registry
from .structure_queries import LINES, WORDS
from .text_queries import TIDY

R = Registry()
BOX = "l double, b double, r double, t double"
FIELDS = Fixture("fld", f"doc_id int, page_no int, field_id int, {BOX}", ((1, 1, 1, 190.0, 527.0, 350.0, 547.0), (1, 1, 2, 190.0, 242.0, 390.0, 262.0), (1, 1, 3, 190.0, 632.0, 470.0, 652.0), (1, 2, 4, 100.0, 100.0, 200.0, 104.0), (1, 2, 5, 300.0, 100.0, 400.0, 120.0)))
TEXTS = Fixture("txt", f"doc_id int, page_no int, ord int, kind string, text string, {BOX}", ((1, 1, 1, "Paragraph", "Reference number:", 60.0, 530.0, 150.0, 541.0), (1, 1, 2, "Paragraph", "* Full name:", 60.0, 635.0, 120.0, 646.0), (1, 1, 3, "Artifact", "header", 150.0, 242.0, 185.0, 262.0), (1, 2, 4, "Paragraph", "Above it", 110.0, 110.0, 180.0, 120.0), (1, 2, 5, "Paragraph", "Far left", 10.0, 100.0, 100.5, 104.0), (1, 2, 6, "Paragraph", "same gap a", 260.0, 100.0, 290.0, 120.0), (1, 2, 7, "Paragraph", "same gap b", 250.0, 100.0, 290.0, 120.0), (1, 2, 8, "Paragraph", " ", 295.0, 100.0, 299.0, 120.0)))
SAME = "(least(x.t - x.b, y.t - y.b) > 0 AND least(x.t, y.t) - greatest(x.b, y.b) > 0.3 * least(x.t - x.b, y.t - y.b))"
H = "greatest(x.t - x.b, 8)"
R.add("j01_nearest_label", lambda s, d: J.nearest_labels(FIELDS.df(s), TEXTS.df(s)), f"""WITH f AS {FIELDS.sql()}, c AS (SELECT x.*, y.ord, y.text, CASE WHEN {SAME} AND x.l - y.r BETWEEN 0 AND 12 * {H} THEN 1 WHEN y.l < x.r AND y.r > x.l AND y.b - x.t BETWEEN 0 AND 3 * {H} THEN 2 END AS phase, y.l AS yl, y.b AS yb, y.r AS yr FROM f x JOIN {TEXTS.sql()} y ON x.doc_id = y.doc_id AND x.page_no = y.page_no WHERE y.kind <> 'Artifact' AND trim(y.text) <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, field_id ORDER BY phase, CASE WHEN phase = 1 THEN l - yr ELSE yb - t END, ord) AS n FROM c WHERE phase IS NOT NULL)
SELECT f.doc_id, f.page_no, f.field_id, k.phase, CASE WHEN length({TIDY.replace('(x', '(k.text')}) > 80 THEN '' ELSE {TIDY.replace('(x', '(k.text')} END AS label FROM f LEFT JOIN k ON k.doc_id = f.doc_id AND k.field_id = f.field_id AND n = 1""")
OPTIONS = Fixture("opt", f"doc_id int, page_no int, option_id int, {BOX}", tuple((1, 1, i, 68.0, 456.0 - 25 * i, 82.0, 470.0 - 25 * i) for i in range(3)) + ((1, 1, 9, 500.0, 10.0, 514.0, 24.0),))
CAPS = Fixture("cap", f"doc_id int, page_no int, ord int, kind string, text string, {BOX}", tuple((1, 1, i, "Paragraph", t, 90.0, 457.0 - 25 * i, 140.0, 468.0 - 25 * i) for i, t in enumerate(("By email", "By phone:", "By post"))) + ((1, 1, 5, "Paragraph", "too far", 400.0, 457.0, 440.0, 468.0),))
R.add("j04_option_label", lambda s, d: J.option_labels(OPTIONS.df(s), CAPS.df(s)), f"WITH o AS {OPTIONS.sql()}, k AS (SELECT x.doc_id, x.option_id, y.text, row_number() OVER (PARTITION BY x.doc_id, x.option_id ORDER BY y.l - x.r, y.ord) AS n FROM o x JOIN {CAPS.sql()} y ON x.doc_id = y.doc_id AND x.page_no = y.page_no WHERE {SAME} AND y.l - x.r BETWEEN 0 AND 14 * {H}) SELECT o.doc_id, o.page_no, o.option_id, {TIDY.replace('(x', '(k.text')} AS label FROM o LEFT JOIN k ON k.doc_id = o.doc_id AND k.option_id = o.option_id AND n = 1")
REGIONS = Fixture("reg", f"doc_id int, page_no int, region_id int, {BOX}", ((1, 1, 1, 50.0, 680.0, 300.0, 720.0), (1, 2, 2, 0.0, 0.0, 595.0, 842.0), (1, 3, 3, 500.0, 500.0, 510.0, 510.0), (2, 1, 4, 60.0, 690.0, 80.0, 705.0)))
HIT = "y.l < x.r AND y.r > x.l AND y.b < x.t AND y.t > x.b"
R.add("j02_o05_words_in_region", lambda s, d: J.words_in(REGIONS.df(s), WORDS.df(s), 6), f"WITH k AS (SELECT x.doc_id, x.page_no, x.region_id, y.text, row_number() OVER (PARTITION BY x.region_id ORDER BY round_even(y.b, 1) DESC, y.l, y.word_ord) AS n FROM {REGIONS.sql()} x JOIN {WORDS.sql()} y ON x.doc_id = y.doc_id AND x.page_no = y.page_no WHERE {HIT}) SELECT doc_id, page_no, region_id, string_agg(text, ' ' ORDER BY n) AS text, count(*) AS n_words FROM k WHERE n <= 6 GROUP BY 1, 2, 3")
LINKBOX = Fixture("lnk", f"doc_id int, page_no int, ord int, text string, {BOX}", ((1, 1, 2, "second", 60.0, 690.0, 90.0, 710.0), (1, 1, 1, "first", 100.0, 700.0, 150.0, 712.0), (1, 2, 1, "other", 0.0, 0.0, 1.0, 1.0)))
R.add("j03_s07_first_overlap", lambda s, d: J.first_overlap(REGIONS.df(s), LINKBOX.df(s)), f"SELECT x.doc_id, x.page_no, x.region_id, arg_min(y.text, y.ord) AS text FROM {REGIONS.sql()} x JOIN {LINKBOX.sql()} y ON x.doc_id = y.doc_id AND x.page_no = y.page_no WHERE {HIT} GROUP BY 1, 2, 3")
POINTS = Fixture("pts", "doc_id int, page_no int, point_id int, x double, y double", ((1, 1, 1, 70.0, 535.0), (1, 1, 2, 400.0, 640.0), (1, 2, 3, 255.0, 110.0), (1, 2, 4, 590.0, 800.0), (1, 2, 5, 150.0, 109.0)))
BOXES = Fixture("bxs", f"doc_id int, page_no int, element_id int, ord int, {BOX}", ((1, 1, 1, 0, 0.0, 0.0, 595.0, 842.0), (1, 1, 2, 1, 60.0, 530.0, 150.0, 541.0), (1, 1, 3, 2, 190.0, 632.0, 470.0, 652.0), (1, 2, 4, 0, 250.0, 100.0, 290.0, 120.0), (1, 2, 5, 1, 250.0, 100.0, 290.0, 120.0), (1, 2, 6, 2, 100.0, 100.0, 200.0, 100.5)))
R.add("j05_smallest_enclosing", lambda s, d: J.smallest_enclosing(POINTS.df(s), BOXES.df(s)), f"WITH p AS {POINTS.sql()}, k AS (SELECT p.doc_id, p.point_id, e.element_id, row_number() OVER (PARTITION BY p.point_id ORDER BY greatest(r - l, 1) * greatest(t - b, 1), ord) AS n FROM p JOIN {BOXES.sql()} e ON e.doc_id = p.doc_id AND e.page_no = p.page_no WHERE p.x BETWEEN l - 8 AND r + 8 AND p.y BETWEEN b - 8 AND t + 8) SELECT p.doc_id, p.page_no, p.point_id, k.element_id FROM p LEFT JOIN k ON k.point_id = p.point_id AND n = 1")
SPANS = Fixture("spans", "doc_id int, element_id int, start int, length int", ((1, 10, 5, 10), (1, 11, 20, 5), (1, 12, 30, 1), (2, 13, 0, 3)))
PLACES = Fixture("positions", "doc_id int, position int", ((1, 0), (1, 5), (1, 14), (1, 15), (1, 22), (1, 99), (2, 2), (3, 1)))
R.add("j07_span_at_offset", lambda s, d: J.span_at(PLACES.df(s), SPANS.df(s)), f"SELECT p.doc_id, p.position, s.element_id, coalesce(p.position < s.start + s.length, FALSE) AS inside FROM {PLACES.sql()} p ASOF LEFT JOIN {SPANS.sql()} s ON p.doc_id = s.doc_id AND p.position >= s.start")
CHANGED = Fixture("changed", "doc_id int, name string, value string, pending_signature boolean", ((1, "a.b", "x", False), (1, "a.c", "y", False), (1, "sig", "z", True), (2, "a.b", "w", False)))
SAVED = Fixture("saved", "doc_id int, name string, raw_id int", ((1, "a.b", 7), (2, "z", 8)))
R.add("j10_missing_fields", lambda s, d: J.missing(CHANGED.df(s), SAVED.df(s)), f"SELECT doc_id, name FROM {CHANGED.sql()} c WHERE NOT pending_signature AND NOT EXISTS (SELECT 1 FROM {SAVED.sql()} s WHERE s.doc_id = c.doc_id AND s.name = c.name)")
R.add("j11_edited_fields", lambda s, d: J.matched(CHANGED.df(s), SAVED.df(s)), f"SELECT c.doc_id, c.name, c.value, s.raw_id, CASE WHEN s.raw_id IS NULL THEN 'no such field' END AS warning FROM {CHANGED.sql()} c LEFT JOIN {SAVED.sql()} s ON s.doc_id = c.doc_id AND s.name = c.name")
R.add("j11_orders_of_customers", lambda s, d: A.read(s, d, "orders").join(A.read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_custkey").isNull()).alias("missing")), "SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE c_custkey IS NULL) AS missing FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")


def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments with the number of replies to each."""
    t = A.threads(spark, sf_dir)
    replies = t.filter("in_reply_to IS NOT NULL").groupBy("doc_id", F.col("in_reply_to").alias("annotation_id")).agg(F.count("*").alias("replies"))
    return t.join(replies, ["doc_id", "annotation_id"], "left").select("doc_id", "annotation_id", "author", F.coalesce("replies", F.lit(0)).alias("replies"))


THREADS = "(SELECT conv_id AS doc_id, turn AS annotation_id, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS in_reply_to, role AS author, text FROM conversations)"
R.add("j12_s08_replies", j12, f"WITH t AS {THREADS} SELECT t.doc_id, t.annotation_id, t.author, count(r.doc_id) AS replies FROM t LEFT JOIN t r ON r.doc_id = t.doc_id AND r.in_reply_to = t.annotation_id GROUP BY 1, 2, 3")
def by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document the element asked for, of which some aren't there."""
    asked = A.read(spark, sf_dir, "documents", "doc_id").select("doc_id", (F.col("doc_id") % 9).cast("int").alias("reading_order"))
    return asked.join(A.text_elements(spark, sf_dir), ["doc_id", "reading_order"], "left").select("doc_id", "reading_order", "kind", "text")


R.add("j14_element_by_id", by_ids, f"SELECT d.doc_id, CAST(d.doc_id % 9 AS INTEGER) AS reading_order, l.kind, l.text FROM documents d LEFT JOIN {LINES} l ON l.doc_id = d.doc_id AND l.reading_order = d.doc_id % 9")
ANN = Fixture("ann", "doc_id int, object_id int, struct_key int", ((1, 1, 5), (1, 2, None), (1, 3, 6), (1, 4, None)))
TREE = Fixture("ptree", "doc_id int, struct_key int, tag_id int", ((1, 5, 50),))
REFS = Fixture("refs", "doc_id int, object_id int, tag_id int, depth int", ((1, 2, 60, 3), (1, 2, 61, 2), (1, 3, 62, 25), (1, 1, 63, 1)))
R.add("j15_object_reference", lambda s, d: J.by_reference(ANN.df(s), TREE.df(s), REFS.df(s)), f"WITH f AS (SELECT doc_id, object_id, arg_min(tag_id, depth * 1000 + tag_id) AS found FROM {REFS.sql()} WHERE depth <= 24 GROUP BY 1, 2) SELECT a.doc_id, a.object_id, coalesce(t.tag_id, f.found) AS tag_id, CASE WHEN t.tag_id IS NOT NULL THEN 'key' WHEN f.found IS NOT NULL THEN 'scan' END AS how FROM {ANN.sql()} a LEFT JOIN {TREE.sql()} t ON t.doc_id = a.doc_id AND t.struct_key = a.struct_key LEFT JOIN f ON f.doc_id = a.doc_id AND f.object_id = a.object_id")
R.add("j06_enclosing_heading", lambda s, d: _headings(s, d), f"SELECT doc_id, CAST(reading_order AS INTEGER) AS reading_order, last_value(CASE WHEN kind = 'Heading' AND trim(text) <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM {LINES}")


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators.search import last_heading

    w = Window.partitionBy("doc_id").orderBy("reading_order")
    return A.text_elements(spark, sf_dir).select("doc_id", "reading_order", last_heading(w).alias("heading"))


# ---- Table cells ------------------------------------------------------------------------------------------------------------
CELLS = Fixture("cells", "table_id int, row_no int, column_index int, text string, role string", ((1, 0, 0, "Month", "ColumnHeader"), (1, 0, 1, "Revenue", "ColumnHeader"), (1, 1, 0, "March", "RowHeader"), (1, 1, 1, "4200", "Data"), (1, 2, 0, "April", "RowHeader"), (1, 2, 1, "", "Data"), (2, 0, 0, "a", "Data"), (2, 0, 1, "b", "Data"), (2, 1, 0, "c", "Data"), (3, 0, 0, "H", "Header"), (3, 1, 0, "x", "Data"), (3, 2, 0, "sub", "ColumnHeader"), (3, 3, 0, "y", "Data"), (3, 3, 1, "z", "Data")))
HEADED = """SELECT table_id, row_no, column_index, text, role, last_value(CASE WHEN role IN ('ColumnHeader', 'Header') THEN text END IGNORE NULLS) OVER (PARTITION BY table_id, column_index ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS column_header,
last_value(CASE WHEN role IN ('RowHeader', 'Header') THEN text END IGNORE NULLS) OVER (PARTITION BY table_id, row_no ORDER BY column_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS row_header FROM """
SPOKEN = "concat_ws(', ', nullif(row_header, ''), nullif(column_header, ''), CASE WHEN text = '' THEN 'blank' ELSE text END)"
R.add("j08_j09_cell_headers", lambda s, d: J.column_headers(CELLS.df(s)), f"SELECT table_id, row_no, column_index, column_header, row_header, {SPOKEN} AS spoken FROM ({HEADED} {CELLS.sql()}) WHERE role = 'Data'")
ORDERCELLS = "(SELECT l_orderkey AS table_id, row_no, column_index, CASE column_index WHEN 0 THEN l_partkey || '' WHEN 1 THEN l_returnflag WHEN 2 THEN l_linestatus ELSE l_suppkey || '' END AS text, CASE WHEN column_index = 0 THEN 'RowHeader' ELSE 'Data' END AS role FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS row_no FROM lineitem), unnest([0, 1, 2, 3]) AS u(column_index))"


def _order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.order_cells(spark, sf_dir).withColumn("role", F.when(F.col("column_index") == 0, "RowHeader").otherwise("Data"))


def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = J.column_headers(_order_cells(spark, sf_dir))
    return c.groupBy("table_id").agg(F.count("row_header").alias("labelled"), F.min("spoken").alias("first"), F.max("spoken").alias("last"))


R.add("j09_headers_of_orders", j09, f"SELECT table_id, count(row_header) AS labelled, min({SPOKEN}) AS first, max({SPOKEN}) AS last FROM ({HEADED} {ORDERCELLS}) WHERE role = 'Data' GROUP BY table_id")
R.add("a07_table_shape_of_orders", lambda s, d: TD.shape(_order_cells(s, d)), f"SELECT table_id, count(*) AS n_rows, max(n) AS n_columns, bool_or(h) AS has_headers FROM (SELECT table_id, row_no, count(*) AS n, bool_or(role <> 'Data') AS h FROM {ORDERCELLS} GROUP BY 1, 2) GROUP BY 1")
SPANNED = Fixture("spanned", "table_id int, row_no int, cell_ord int, col_span int", ((1, 0, 0, 2), (1, 0, 1, 1), (1, 1, 0, 1), (1, 1, 1, 1), (1, 1, 2, 3), (1, 1, 3, 1)))
R.add("w01_column_index", lambda s, d: TD.column_places(SPANNED.df(s)), f"SELECT *, CAST(coalesce(sum(col_span) OVER (PARTITION BY table_id, row_no ORDER BY cell_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS column_index FROM {SPANNED.sql()}")
R.add("t30_grid_projection", lambda s, d: TD.grid(CELLS.df(s)), f"""WITH c AS {CELLS.sql()}, r AS (SELECT table_id, row_no FROM c GROUP BY 1, 2 HAVING NOT bool_and(role <> 'Data')), n AS (SELECT table_id, column_index, arg_min(text, row_no) AS name FROM c WHERE role IN ('ColumnHeader', 'Header') GROUP BY 1, 2),
g AS (SELECT r.table_id, r.row_no, k.column_index FROM r JOIN (SELECT DISTINCT table_id, column_index FROM c) k ON k.table_id = r.table_id), x AS (SELECT g.*, coalesce(nullif(n.name, ''), 'Column ' || (g.column_index + 1)) AS name, coalesce(c.text, '') AS text FROM g LEFT JOIN n ON n.table_id = g.table_id AND n.column_index = g.column_index LEFT JOIN c ON c.table_id = g.table_id AND c.row_no = g.row_no AND c.column_index = g.column_index),
l AS (SELECT table_id, row_no, arg_min(text, column_index) AS row_label FROM c WHERE role IN ('RowHeader', 'Header') GROUP BY 1, 2)
SELECT x.table_id, x.row_no, any_value(l.row_label) AS row_label, string_agg(name, '|' ORDER BY column_index) AS names, string_agg(text, '|' ORDER BY column_index) AS texts FROM x LEFT JOIN l ON l.table_id = x.table_id AND l.row_no = x.row_no GROUP BY 1, 2""")

# ---- Table detection --------------------------------------------------------------------------------------------------------


def _drawn(doc: int, rows: list[list[tuple[float, str]]], bold: int = -1) -> list[tuple]:
    """Words of rows of (x, text), 22 points apart from y = 722 down; 5.5 points a character."""
    out = []
    for k, row in enumerate(rows):
        for x, text in row:
            for word in text.split(" "):
                y = 722.0 - 22 * k
                out.append((doc, 1, len(out), word, x, y, x + 5.5 * len(word), y + 11, k == bold))
                x += 5.5 * len(word) + 5.5
    return out


_grid = lambda *rows: [list(zip((60.0, 200.0, 320.0), r, strict=False)) for r in rows]
DRAWN = Fixture("drawn", f"doc_id int, page_no int, word_ord int, text string, {BOX}, bold boolean", tuple(
    _drawn(1, _grid(("Month", "Amount", "Status"), ("January", "1,200", "Paid"), ("February", "900", "Paid"), ("March", "£450", "Due")))
    + _drawn(2, _grid(("Colour", "Shape", "Texture"), ("Red", "Round", "Smooth"), ("Blue", "Square", "Rough"), ("Green", "Flat", "Soft")), bold=0)
    + _drawn(3, [[(60.0, f"{n}."), (90.0, "a sentence of the list here")] for n in range(1, 5)])
    + _drawn(4, [[(60.0, "*"), (80.0, "bulleted text")] for _ in range(4)])
    + _drawn(5, [[(60.0, "Term"), (160.0, "a meaning that is well over forty characters long in all")] for _ in range(4)])
    + _drawn(6, [[(60.0, "prose that starts each line at one place")] for _ in range(4)])
    + _drawn(7, _grid(("a", "b"), ("c", "d")))
    + _drawn(8, [*_grid(("Month", "Amount", "Status"), ("January", "1,200", "Paid"), ("February", "900", "Paid"), ("March", "450", "Due")), [(60.0, "Then a paragraph that runs over the whole width of the page")]])
))
R.add("td01_words_to_lines", lambda s, d: TD.to_lines(DRAWN.df(s)).groupBy("doc_id", "line_no").agg(F.count("*").alias("n_words"), F.max("t").alias("top")))
R.add("td04_candidates", lambda s, d: TD.candidates(TD.to_lines(DRAWN.df(s))))
R.add("td_detected_tables", lambda s, d: TD.detect(DRAWN.df(s)))
LINED = f"(SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY t DESC) - 1 AS INTEGER) AS line_no FROM {DRAWN.sql()})"
lined = lambda s: DRAWN.df(s).withColumn("line_no", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.col("t").desc())) - 1)
STARTS = f"(SELECT doc_id, page_no, line_no, l AS start FROM (SELECT *, l - lag(r) OVER (PARTITION BY doc_id, line_no ORDER BY l, word_ord) AS gap, greatest(1, max(t) OVER (PARTITION BY doc_id, line_no) - min(b) OVER (PARTITION BY doc_id, line_no)) AS h FROM {LINED}) WHERE gap IS NULL OR gap > 0.9 * h)"
R.add("td02_group_starts", lambda s, d: TD.group_starts(lined(s)), f"SELECT * FROM {STARTS}")
COLUMNS = f"""(SELECT doc_id, page_no, x, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY x) - 1 AS INTEGER) AS column_index, lead(x) OVER (PARTITION BY doc_id, page_no ORDER BY x) AS next_x FROM (SELECT s.doc_id, s.page_no, m.x, count(DISTINCT s.line_no) AS agreeing, any_value(n.n) AS n FROM {STARTS} s JOIN (SELECT doc_id, page_no, avg(start) AS x FROM
(SELECT *, sum(new) OVER (PARTITION BY doc_id, page_no ORDER BY start, line_no) AS c FROM (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY doc_id, page_no ORDER BY start, line_no) <= 4 THEN 0 ELSE 1 END AS new FROM {STARTS})) GROUP BY doc_id, page_no, c) m ON m.doc_id = s.doc_id AND m.page_no = s.page_no AND abs(s.start - m.x) <= 4
JOIN (SELECT doc_id, count(DISTINCT line_no) AS n FROM {STARTS} GROUP BY 1) n ON n.doc_id = s.doc_id GROUP BY 1, 2, 3) WHERE agreeing >= greatest(2, ceil(n * 0.75)))"""
columns = lambda s: TD.find_columns(TD.group_starts(lined(s)), ["doc_id", "page_no"])
R.add("td03_columns", lambda s, d: columns(s), f"SELECT * FROM {COLUMNS}")
R.add("td05_rows_respect_columns", lambda s, d: TD.row_respects(lined(s), columns(s)), f"SELECT w.doc_id, w.page_no, w.line_no, count(*) FILTER (WHERE l >= x - 4 AND l < next_x - 4 AND r > next_x) = 0 AS respects FROM {LINED} w JOIN {COLUMNS} c ON c.doc_id = w.doc_id AND c.page_no = w.page_no WHERE next_x IS NOT NULL GROUP BY 1, 2, 3")
ASSIGNED = f"(SELECT w.doc_id, w.page_no, line_no, column_index, string_agg(text, ' ' ORDER BY l, word_ord) AS text, bool_and(bold) AS bold FROM {LINED} w JOIN {COLUMNS} c ON c.doc_id = w.doc_id AND c.page_no = w.page_no WHERE l >= x - 4 AND (next_x IS NULL OR l < next_x - 4) GROUP BY 1, 2, 3, 4)"
R.add("td11_cells", lambda s, d: TD.assign_cells(lined(s), columns(s)), f"SELECT * FROM {ASSIGNED}")
GRID = f"(SELECT g.doc_id, g.line_no AS row_no, k.column_index, coalesce(a.text, '') AS text, coalesce(a.bold, FALSE) AS bold FROM (SELECT DISTINCT doc_id, line_no FROM {LINED}) g JOIN {COLUMNS} k ON k.doc_id = g.doc_id LEFT JOIN {ASSIGNED} a ON a.doc_id = g.doc_id AND a.line_no = g.line_no AND a.column_index = k.column_index)"


def _full(spark: SparkSession) -> DataFrame:
    c = columns(spark)
    rows = lined(spark).select("doc_id", "page_no", "line_no").distinct().join(c.select("doc_id", "page_no", "column_index"), ["doc_id", "page_no"])
    cells = rows.join(TD.assign_cells(lined(spark), c), ["doc_id", "page_no", "line_no", "column_index"], "left")
    return cells.select("doc_id", F.col("line_no").alias("row_no"), "column_index", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("bold", F.lit(False)).alias("bold"))


MARK = r"length(trim(text)) <= 5 AND regexp_matches(trim(text), '^(?:[•·▪▫◦‣⁃\-–—*+>]|[(\[]*(?:[0-9]{1,4}|\p{L}{1,2})[.)\]:]+|[(\[]+(?:[0-9]{1,4}|\p{L}{1,2})[.)\]:]*)$')"
R.add("td06_td07_plausible", lambda s, d: TD.plausible(_full(s), ["doc_id"]), f"""WITH g AS {GRID}, a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE text <> '') AS f, coalesce(sum(length(text)), 0) AS len, max(column_index) + 1 AS cols, count(*) FILTER (WHERE column_index = 0 AND text <> '') AS firsts, count(*) FILTER (WHERE column_index = 0 AND text <> '' AND {MARK}) AS markers,
avg(length(text)) FILTER (WHERE column_index = 0 AND text <> '') AS m0, avg(length(text)) FILTER (WHERE column_index = 1 AND text <> '') AS m1 FROM g GROUP BY 1), r AS (SELECT doc_id, min(f) AS least FROM (SELECT doc_id, row_no, count(*) FILTER (WHERE text <> '') AS f FROM g GROUP BY 1, 2) GROUP BY 1)
SELECT a.doc_id, f > 0 AND len // greatest(f, 1) <= 55 AND 2 * f >= n AND least >= 2 AND (cols <> 2 OR (NOT (firsts >= 2 AND markers >= firsts - 1) AND coalesce(m0, 0) <= 40 AND coalesce(m1, 0) <= 40)) AS is_table, firsts >= 2 AND markers >= firsts - 1 AS marker_column FROM a JOIN r ON r.doc_id = a.doc_id""")
NUMERIC = r"(regexp_matches(text, '[0-9]') AND regexp_matches(text, '^[0-9\s£$€%.,\-+()/:]+$'))"
R.add("td08_td09_headers", lambda s, d: TD.headers(_full(s), ["doc_id"]), f"""WITH g AS {GRID}, c AS (SELECT doc_id, column_index, bool_or(row_no = 0 AND text <> '' AND NOT {NUMERIC}) AS label, count(*) FILTER (WHERE row_no > 0 AND text <> '') AS below, count(*) FILTER (WHERE row_no > 0 AND {NUMERIC}) AS below_n, count(*) FILTER (WHERE text <> '') AS al, count(*) FILTER (WHERE {NUMERIC}) AS al_n FROM g GROUP BY 1, 2),
b AS (SELECT doc_id, coalesce(bool_and(bold) FILTER (WHERE row_no = 0 AND text <> ''), FALSE) AND NOT coalesce(bool_or(bold) FILTER (WHERE row_no > 0), FALSE) AS bold_top, max(row_no) + 1 AS n_rows FROM g GROUP BY 1),
t AS (SELECT b.doc_id, n_rows, n_rows >= 2 AND (bold_top OR bool_or(label AND below > 0 AND 2 * below_n > below)) AS header_row FROM b JOIN c ON c.doc_id = b.doc_id GROUP BY b.doc_id, n_rows, bold_top)
SELECT t.doc_id, header_row, bool_or(column_index = 0 AND CASE WHEN header_row THEN below ELSE al END >= 2 AND CASE WHEN header_row THEN below_n ELSE al_n END = 0) AND bool_or(column_index > 0 AND CASE WHEN header_row THEN below ELSE al END >= 2 AND 2 * CASE WHEN header_row THEN below_n ELSE al_n END > CASE WHEN header_row THEN below ELSE al END) AND n_rows - CASE WHEN header_row THEN 1 ELSE 0 END >= 2 AS header_column FROM t JOIN c ON c.doc_id = t.doc_id GROUP BY t.doc_id, header_row, n_rows""")
R.add("td10_numeric_cells_of_orders", lambda s, d: A.order_cells(s, d).groupBy("column_index").agg(F.count("*").alias("n"), F.count_if(TD.numeric("text")).alias("n_numeric")), f"SELECT CAST(column_index AS INTEGER) AS column_index, count(*) AS n, count(*) FILTER (WHERE {NUMERIC}) AS n_numeric FROM {ORDERCELLS} GROUP BY 1")


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict:
    return R.sql
