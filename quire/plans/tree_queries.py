"""Queries of trees and navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import navigate as N
from quire.operators import tree as TR
from quire.sources import adapters as A

from .fixture import Fixture, Registry, sql_literal
from .structure_queries import LINES
from .text_queries import sql_map

R = Registry()
TREE = Fixture("tree", "doc_id int, element_id int, parent_id int, sibling_ord int, kind string, level int, role string, text string, page_no int, l double, b double, r double, t double, needs_attention boolean, annotation_kind string", tuple((*x, *(0.0,) * (4 - len(b)), *b, na, ak) for x, b, na, ak in (
    ((1, 1, None, 0, "Document", None, None, "", 0), (), False, None), ((1, 2, 1, 0, "Section", None, None, " ", 1), (), False, None), ((1, 3, 2, 0, "Heading", None, None, "Title", 1), (10.0, 700.0, 100.0, 720.0), False, None), ((1, 4, 2, 1, "List", None, None, None, 1), (), False, None),
    ((1, 5, 4, 0, "ListItem", None, None, "One", 1), (10.0, 600.0, 50.0, 610.0), False, None), ((1, 6, 4, 1, "ListItem", None, None, "Two", 1), (10.0, 580.0, 60.0, 590.0), False, None), ((1, 7, 6, 0, "List", None, None, "", 1), (), False, None), ((1, 8, 7, 0, "ListItem", None, None, "Nested", 1), (20.0, 560.0, 90.0, 570.0), False, None),
    ((1, 9, 1, 1, "Section", None, None, None, 2), (), False, None), ((1, 10, 9, 0, "Section", None, None, None, 2), (), False, None), ((1, 11, 10, 0, "Heading", None, None, "Deep", 2), (10.0, 700.0, 40.0, 715.0), False, None), ((1, 12, 10, 1, "Heading", 2, None, "Levelled", 2), (10.0, 650.0, 40.0, 665.0), False, None),
    ((1, 13, 9, 1, "Annotation", None, None, "note", 2), (5.0, 5.0, 9.0, 9.0), False, "Comment"), ((1, 14, 9, 2, "Annotation", None, None, "pop", 2), (5.0, 5.0, 9.0, 9.0), False, "Popup"), ((1, 15, 9, 3, "FormField", None, None, None, 2), (5.0, 50.0, 9.0, 59.0), True, None), ((1, 16, 9, 4, "TableCell", None, "ColumnHeader", "Head", 2), (5.0, 70.0, 9.0, 79.0), False, None),
    ((2, 1, None, 0, "Document", None, None, None, 0), (), False, None), ((2, 2, 1, 1, "Paragraph", None, None, "b", 1), (1.0, 1.0, 2.0, 2.0), False, None), ((2, 3, 1, 0, "Figure", None, None, None, 1), (3.0, 3.0, 4.0, 4.0), False, None), ((2, 4, 3, 0, "Paragraph", None, None, "under a figure", 1), (), False, None), ((2, 5, 99, 0, "Paragraph", None, None, "orphan", 1), (), False, None),
)))
WALK = f"""e AS {TREE.sql()}, w0 AS (SELECT doc_id, element_id, 0 AS depth, lpad(sibling_ord || '', 8, '0') AS path FROM e WHERE parent_id IS NULL
UNION ALL SELECT e.doc_id, e.element_id, depth + 1, path || '.' || lpad(sibling_ord || '', 8, '0') FROM e JOIN w0 ON e.doc_id = w0.doc_id AND e.parent_id = w0.element_id WHERE depth < 64),
w AS (SELECT w0.*, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS reading_order FROM w0), we AS (SELECT e.*, w.depth, w.path, w.reading_order FROM w JOIN e ON e.doc_id = w.doc_id AND e.element_id = w.element_id),
pr AS (SELECT d.doc_id, a.element_id AS ancestor_id, d.element_id, d.depth - a.depth AS distance FROM w d JOIN w a ON a.doc_id = d.doc_id AND starts_with(d.path, a.path || '.'))"""


def walked(spark: SparkSession) -> DataFrame:
    return TR.paths(spark, TREE.df(spark))


def both(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    w = walked(spark)
    return w, TR.descendants(w)


def add(name: str, spark_query, sql: str) -> None:
    R.add(name, lambda s, d: spark_query(*both(s)), f"WITH RECURSIVE {WALK} {sql}")


add("o02_reading_order", lambda w, p: w.select("doc_id", "element_id", "depth", "reading_order"), "SELECT doc_id, element_id, CAST(depth AS INTEGER) AS depth, CAST(reading_order AS INTEGER) AS reading_order FROM w")
add("tr03_descendants", lambda w, p: p, "SELECT doc_id, ancestor_id, element_id, CAST(distance AS INTEGER) AS distance FROM pr")
add("tr04_nearest_ancestor", lambda w, p: TR.nearest(w, p, "Section"), "SELECT pr.doc_id, pr.element_id, arg_min(ancestor_id, distance) AS ancestor_id FROM pr JOIN e ON e.doc_id = pr.doc_id AND e.element_id = ancestor_id AND kind = 'Section' GROUP BY 1, 2")
add("t03_full_text", lambda w, p: TR.full_text(w, p), "SELECT doc_id, a AS element_id, coalesce(string_agg(trim(text), ' ' ORDER BY reading_order) FILTER (WHERE trim(coalesce(text, '')) <> ''), '') AS full_text FROM (SELECT doc_id, element_id AS a, reading_order, text FROM we UNION ALL SELECT pr.doc_id, ancestor_id, reading_order, text FROM pr JOIN we ON we.doc_id = pr.doc_id AND we.element_id = pr.element_id) GROUP BY 1, 2")
add("g04_bounds_roll_up", lambda w, p: TR.rolled_bounds(w, p), "SELECT we.doc_id, we.element_id, " + ", ".join(f"CASE WHEN (we.r <= we.l OR we.t <= we.b) AND u.{c} IS NOT NULL THEN u.{c} ELSE we.{c} END AS {c}" for c in "lbrt") + " FROM we LEFT JOIN (SELECT pr.doc_id, ancestor_id, min(l) AS l, min(b) AS b, max(r) AS r, max(t) AS t FROM pr JOIN we ON we.doc_id = pr.doc_id AND we.element_id = pr.element_id WHERE r > l AND t > b GROUP BY 1, 2) u ON u.doc_id = we.doc_id AND u.ancestor_id = we.element_id")
add("c18_heading_levels", lambda w, p: TR.heading_levels(w, p), "SELECT we.doc_id, we.element_id, CAST(coalesce(we.level, greatest(1, least(6, count(a.kind) FILTER (WHERE a.kind IN ('Section', 'Document'))))) AS INTEGER) AS level FROM we LEFT JOIN pr ON pr.doc_id = we.doc_id AND pr.element_id = we.element_id LEFT JOIN e a ON a.doc_id = pr.doc_id AND a.element_id = pr.ancestor_id WHERE we.kind = 'Heading' GROUP BY we.doc_id, we.element_id, we.level")
add("a08_list_nesting", lambda w, p: TR.nesting(w, p), "SELECT l.doc_id, l.element_id, (SELECT count(*) FROM e i WHERE i.doc_id = l.doc_id AND i.parent_id = l.element_id AND i.kind = 'ListItem') AS items, 1 + (SELECT count(*) FROM pr JOIN e a ON a.doc_id = pr.doc_id AND a.element_id = pr.ancestor_id WHERE pr.doc_id = l.doc_id AND pr.element_id = l.element_id AND a.kind = 'List') AS level FROM we l WHERE l.kind = 'List'")
R.add("a12_count_within_bounds", lambda s, d: TR.paths(s, TREE.df(s), 2).groupBy("doc_id").agg(F.count("*").alias("n")), f"WITH RECURSIVE {WALK} SELECT doc_id, count(*) AS n FROM w WHERE depth <= 2 GROUP BY doc_id")
MARKS = Fixture("marks", "doc_id int, page_no int, mcid int, element_id int", ((1, 1, 0, 3), (1, 1, 2, 5), (1, 1, 3, 8), (1, 2, 1, 12), (1, 2, 2, 16), (2, 1, 0, 4)))
TAG = f"CASE WHEN kind = 'Heading' THEN 'H' || coalesce(level, 2) WHEN kind = 'TableCell' THEN CASE WHEN coalesce(role, 'Data') = 'Data' THEN 'TD' ELSE 'TH' END ELSE {sql_map(TR.TAGS, 'kind', 'NULL')} END"
R.add("g08_tag_of_kind", lambda s, d: TREE.df(s).select("doc_id", "element_id", TR.tag("kind", "level", "role").alias("tag")), f"SELECT doc_id, element_id, {TAG} AS tag FROM {TREE.sql()}")
R.add("g09_k04_structure_tree", lambda s, d: TR.structure_tree(*both(s), MARKS.df(s)), f"""WITH RECURSIVE {WALK}, m AS (SELECT doc_id, element_id, string_agg(page_no || ':' || mcid, ',' ORDER BY page_no, mcid) AS mcids FROM {MARKS.sql()} GROUP BY 1, 2), t AS (SELECT we.*, {TAG} AS tag, mcids FROM we LEFT JOIN m ON m.doc_id = we.doc_id AND m.element_id = we.element_id),
live AS (SELECT * FROM t WHERE tag IS NOT NULL AND (mcids IS NOT NULL OR EXISTS (SELECT 1 FROM pr JOIN t x ON x.doc_id = pr.doc_id AND x.element_id = pr.element_id WHERE pr.doc_id = t.doc_id AND pr.ancestor_id = t.element_id AND x.tag IS NOT NULL AND x.mcids IS NOT NULL))),
up AS (SELECT pr.doc_id, pr.element_id, arg_min(pr.ancestor_id, distance) AS parent_tag FROM pr JOIN live a ON a.doc_id = pr.doc_id AND a.element_id = pr.ancestor_id GROUP BY 1, 2)
SELECT l.doc_id, l.element_id, l.tag, up.parent_tag, CAST(l.reading_order AS INTEGER) AS reading_order, coalesce(l.mcids, '') AS mcids FROM live l LEFT JOIN up ON up.doc_id = l.doc_id AND up.element_id = l.element_id""")
R.add("a09_dense_marks", lambda s, d: TR.dense_marks(MARKS.df(s)).select("doc_id", "page_no", F.array_join("elements", ",", "-").alias("elements")), f"WITH m AS {MARKS.sql()}, g AS (SELECT doc_id, page_no, unnest(range(0, max(mcid) + 1)) AS i FROM m GROUP BY 1, 2) SELECT g.doc_id, g.page_no, string_agg(coalesce(element_id || '', '-'), ',' ORDER BY i) AS elements FROM g LEFT JOIN m ON m.doc_id = g.doc_id AND m.page_no = g.page_no AND m.mcid = g.i GROUP BY 1, 2")
R.add("tr05_sibling_index", lambda s, d: TR.sibling_index(TREE.df(s)), f"SELECT doc_id, element_id, CAST(row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY sibling_ord, element_id) - 1 AS INTEGER) AS sibling_index FROM {TREE.sql()}")
MOVES = Fixture("moves", "doc_id int, element_id int, place int", ((1, 13, 3), (2, 2, -5)))
R.add("tr02_move_child", lambda s, d: TR.move(TREE.df(s), MOVES.df(s)), f"""WITH s AS (SELECT e.doc_id, e.element_id, e.parent_id, row_number() OVER (PARTITION BY e.doc_id, e.parent_id ORDER BY sibling_ord, e.element_id) - 1 AS i, count(*) OVER (PARTITION BY e.doc_id, e.parent_id) AS n, place FROM {TREE.sql()} e LEFT JOIN {MOVES.sql()} m ON m.doc_id = e.doc_id AND m.element_id = e.element_id),
k AS (SELECT *, greatest(0, least(place, n - 1)) AS g FROM s) SELECT doc_id, element_id, parent_id, CAST(row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY CASE WHEN place IS NULL THEN 2 * i ELSE 2 * g + CASE WHEN g > i THEN 1 ELSE -1 END END, i) - 1 AS INTEGER) AS sibling_ord FROM k""")
R.add("tr01_refused_children", lambda s, d: TR.refused(TREE.df(s)), f"WITH e AS {TREE.sql()} SELECT e.doc_id, e.element_id, CASE WHEN p.kind IS NULL THEN 'no parent' ELSE 'takes no children' END AS reason FROM e LEFT JOIN e p ON p.doc_id = e.doc_id AND p.element_id = e.parent_id WHERE e.parent_id IS NOT NULL AND (p.kind IS NULL OR p.kind IN ({', '.join(map(sql_literal, TR.LEAVES))}))")
AT = Fixture("anchors", "doc_id int, element_id int", ((1, 10), (1, 16), (1, 3)))
R.add("tr06_comment_place", lambda s, d: TR.comment_place(TREE.df(s), AT.df(s)), f"WITH e AS {TREE.sql()} SELECT a.doc_id, a.element_id, CAST(coalesce((SELECT min(s.sibling_ord) FROM e s WHERE s.doc_id = e.doc_id AND s.parent_id = e.parent_id AND s.sibling_ord > e.sibling_ord AND s.kind <> 'Annotation'), (SELECT max(s.sibling_ord) + 1 FROM e s WHERE s.doc_id = e.doc_id AND s.parent_id = e.parent_id)) AS INTEGER) AS place FROM {AT.sql()} a JOIN e ON e.doc_id = a.doc_id AND e.element_id = a.element_id")
GONE = Fixture("gone", "doc_id int, element_id int, artifact_type string", ((1, 3, "header"), (2, 2, "footer")))
R.add("tr07_replace_as_artifact", lambda s, d: TR.as_artifacts(TREE.df(s), GONE.df(s)).select("doc_id", "element_id", "kind", "text", "artifact_type", "l"), f"SELECT e.doc_id, e.element_id, CASE WHEN g.artifact_type IS NOT NULL THEN 'Artifact' ELSE kind END AS kind, text, g.artifact_type, l FROM {TREE.sql()} e LEFT JOIN {GONE.sql()} g ON g.doc_id = e.doc_id AND g.element_id = e.element_id")
NAMED = Fixture("named", "doc_id int, field_id int, parent_id int, name string", ((1, 1, None, "applicant"), (1, 2, 1, "address"), (1, 3, 2, "postcode"), (1, 4, 2, ""), (1, 5, 4, "kid"), (2, 1, None, "solo")))
R.add("s10_field_names", lambda s, d: TR.qualified_names(s, NAMED.df(s)), f"WITH RECURSIVE f AS {NAMED.sql()}, t AS (SELECT doc_id, field_id, name AS full_name FROM f WHERE parent_id IS NULL UNION ALL SELECT f.doc_id, f.field_id, CASE WHEN coalesce(f.name, '') = '' THEN t.full_name ELSE t.full_name || '.' || f.name END FROM f JOIN t ON f.doc_id = t.doc_id AND f.parent_id = t.field_id) SELECT * FROM t")


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and suppliers as an outline, flattened depth first: level, title, number of suppliers below."""
    r = A.read(spark, sf_dir, "region").select(F.lit(1).alias("doc_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("element_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").alias("sibling_ord"), F.col("r_name").alias("text"))
    n = A.read(spark, sf_dir, "nation").select(F.lit(1).alias("doc_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("element_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.col("n_nationkey").alias("sibling_ord"), F.col("n_name").alias("text"))
    w = TR.paths(spark, r.unionByName(n))
    s = A.read(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("element_id")).agg(F.count("*").alias("suppliers"))
    return w.join(s, "element_id", "left").select("reading_order", "depth", "text", F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


R.add("s09_s12_outline_flatten", geography, """WITH t AS (SELECT r_regionkey AS a, -1 AS b, 0 AS depth, r_name AS text, 0 AS suppliers FROM region UNION ALL SELECT n_regionkey, n_nationkey, 1, n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) FROM nation)
SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS reading_order, CAST(depth AS INTEGER) AS depth, text, CAST(suppliers AS BIGINT) AS suppliers FROM t""")

# ---- Navigation -------------------------------------------------------------------------------------------------------------
SAID = "trim(coalesce(text, '')) <> ''"
STOPS = {k: f"kind = '{k}'" for k in ("Heading", "List", "ListItem", "Table", "TableCell", "Figure", "Link", "FormField")} | {f"HeadingAtLevel{n}": f"kind = 'Heading' AND level = {n}" for n in range(1, 7)} | {
    "UnfilledFormField": "kind = 'FormField' AND coalesce(needs_attention, FALSE)", "Annotation": "kind = 'Annotation' AND coalesce(annotation_kind, '') <> 'Popup'",
    "Paragraph": f"kind IN ({', '.join(map(sql_literal, N.READABLE))}) AND ({SAID} OR kind = 'Figure')", "Element": f"{SAID} OR kind IN ('Figure', 'FormField', 'Link', 'Annotation')"}


def _links_sql(source: str, names: list[str]) -> str:
    each = lambda k: f"""SELECT doc_id, CAST(reading_order AS INTEGER) AS reading_order, '{k}' AS granularity, CAST(first_value(a IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY reading_order ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS INTEGER) AS next, CAST(last_value(a IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER) AS previous,
CAST(min(a) OVER (PARTITION BY doc_id) AS INTEGER) AS first, CAST(max(a) OVER (PARTITION BY doc_id) AS INTEGER) AS last FROM (SELECT *, CASE WHEN {STOPS[k]} THEN reading_order END AS a FROM {source})"""  # noqa: E731
    return " UNION ALL ".join(each(k) for k in names)


R.add("n01_n02_next_links", lambda s, d: N.next_links(walked(s)), f"WITH RECURSIVE {WALK} {_links_sql('we', list(STOPS))}")


def headings_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.text_elements(spark, sf_dir).withColumn("needs_attention", F.lit(False)).withColumn("annotation_kind", F.lit(""))
    return N.next_links(e, ("Heading", "ListItem"))


R.add("n01_next_links_of_documents", headings_of_documents, _links_sql(LINES, ["Heading", "ListItem"]))
R.add("n03_page_landings", lambda s, d: N.page_landings(A.text_elements(s, d)), f"SELECT doc_id, page_no, CAST(coalesce(min(reading_order) FILTER (WHERE kind IN ({', '.join(map(sql_literal, N.READABLE))}) AND trim(text) <> ''), min(reading_order)) AS INTEGER) AS landing FROM {LINES} GROUP BY 1, 2")
ASK = Fixture("ask", "doc_id int, page int", ((0, 1), (0, 0), (0, 99), (2, -3)))
R.add("n03_go_to_page", lambda s, d: N.go_to_page(ASK.df(s).withColumn("doc_id", F.col("doc_id").cast("long")), N.page_landings(A.text_elements(s, d))), f"WITH l AS (SELECT doc_id, page_no, min(reading_order) AS landing FROM {LINES} WHERE trim(text) <> '' GROUP BY 1, 2), n AS (SELECT doc_id, max(page_no) AS pages FROM l GROUP BY 1) SELECT CAST(a.doc_id AS BIGINT) AS doc_id, a.page, CAST(greatest(1, least(page, pages)) AS INTEGER) AS page_no, CAST(l.landing AS INTEGER) AS landing, CASE WHEN page < 1 THEN 'first page' WHEN page > pages THEN 'last page' END AS note FROM {ASK.sql()} a JOIN n ON n.doc_id = a.doc_id LEFT JOIN l ON l.doc_id = a.doc_id AND l.page_no = greatest(1, least(page, pages))")
R.add("n04_words", lambda s, d: A.read(s, d, "documents").select("doc_id", F.size(N.words(F.col("text"))).cast("long").alias("n"), F.try_element_at(N.words(F.col("text")), F.lit(-1)).alias("last")), r"SELECT doc_id, len(w) AS n, w[-1] AS last FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)")
SENT = r"'(?s)\S.*?(?:[.!?][\"'')\]”’]*(?:\s|$)|$)'"
SENTENCES = Fixture("sents", "id int, x string", ((0, "One. Two! Three? Four"), (1, 'He said "stop." Then left.'), (2, "No end"), (3, "Version 2.5 is out. (Really!) Yes."), (4, ""), (5, "Trailing.  ")))
R.add("n04_sentences", lambda s, d: SENTENCES.df(s).select("id", F.array_join(N.sentences(F.col("x")), "|").alias("y")), f"SELECT id, coalesce(array_to_string(list_transform(regexp_extract_all(x, {SENT}), lambda q: trim(q)), '|'), '') AS y FROM {SENTENCES.sql()}")
BOUND = Fixture("bound", "id int, g string, dir string", tuple((i, g, d) for i, (g, d) in enumerate((g, d) for g in ("Heading", "Link", "Annotation", "Other") for d in ("Next", "Previous", "First"))))
UNIT = f"CASE WHEN g LIKE 'HeadingAtLevel_' THEN 'level ' || g[15:15] || ' headings' ELSE {sql_map(N.UNITS, 'g', sql_literal('content'))} END"
R.scalar("n07_boundary_message", BOUND, {"y": (lambda: N.boundary_message(F.col("g"), F.col("dir")), f"CASE dir WHEN 'Next' THEN 'No more ' || {UNIT} || ' after this point.' WHEN 'Previous' THEN 'No more ' || {UNIT} || ' before this point.' ELSE 'There are no ' || {UNIT} || ' in this document.' END")})


def n05_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, p = both(spark)
    said = F.concat_ws(": ", F.lower("kind"), F.nullif(F.trim(F.coalesce("text", F.lit(""))), F.lit("")))
    return N.position(w, p, w.select("doc_id", "element_id", said.alias("full"), F.lower("kind").alias("brief")))


R.add("n05_position_in_tree", n05_tree, f"""WITH RECURSIVE {WALK}, c AS (SELECT pr.doc_id, pr.element_id, lower(e.kind) AS brief, distance, row_number() OVER (PARTITION BY pr.doc_id, pr.element_id ORDER BY distance) AS k FROM pr JOIN e ON e.doc_id = pr.doc_id AND e.element_id = pr.ancestor_id WHERE e.kind IN ('List', 'Table', 'TableRow', 'Section', 'Figure')),
i AS (SELECT doc_id, element_id, 'inside ' || string_agg(brief, ', inside ' ORDER BY k) AS around FROM c WHERE k <= 3 GROUP BY 1, 2), h AS (SELECT *, last_value(CASE WHEN kind = 'Heading' THEN coalesce(text, '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head, max(page_no) OVER (PARTITION BY doc_id) AS pages FROM we)
SELECT h.doc_id, h.element_id, concat_ws(', ', concat_ws(': ', lower(kind), nullif(trim(coalesce(text, '')), '')), around, 'under the heading "' || head || '"', CASE WHEN page_no > 0 THEN 'page ' || page_no || ' of ' || pages END) || '.' AS position FROM h LEFT JOIN i ON i.doc_id = h.doc_id AND i.element_id = h.element_id""")
R.add("n05_where_am_i", lambda s, d: N.where_am_i(A.text_elements(s, d)), f"SELECT doc_id, CAST(reading_order AS INTEGER) AS reading_order, last_value(CASE WHEN kind = 'Heading' THEN text END IGNORE NULLS) OVER w AS heading, 'page ' || page_no || ' of ' || max(page_no) OVER (PARTITION BY doc_id) AS place, CAST(count(*) OVER w * 100 // count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS percent FROM {LINES} WINDOW w AS (PARTITION BY doc_id ORDER BY reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
R.add("n08_link_list", lambda s, d: A.page_elements(s, d).filter("kind = 'Link'").select("doc_id", "reading_order", F.concat_ws(", ", F.nullif("text", F.lit("")), "href").alias("line")), f"SELECT doc_id, CAST(reading_order AS INTEGER) AS reading_order, concat_ws(', ', nullif(text, ''), href) AS line FROM {A.PAGE_ELEMENTS_SQL} WHERE kind = 'Link'")


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict:
    return R.sql
