"""Queries of places: blocks of printed words, tables with spans, and moving through texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import blocks as B
from quire.operators import cursor as C
from quire.operators import match as J
from quire.operators import spans as S
from quire.operators import tables as TD
from quire.sources import adapters as A
from quire.sources import printed as P

from .fixture import Registry

R = Registry()


def read_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, printed in columns, in the order that their places give."""
    words = P.printed_words(A.read(spark, sf_dir, "documents", "doc_id", "text"))
    return B.to_blocks(words).select("doc_id", "page_no", "block_no", "place", "text")


#: The order in which the words were printed, which the places must give back.
R.add("s04_blocks_of_documents", read_blocks, f"SELECT doc_id, page_no, CAST(dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY part) - 1 AS INTEGER) AS block_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY true_ord) - 1 AS INTEGER) AS place, text FROM {P.PRINTED_SQL}")


def spanned_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables whose cells reach over columns and rows."""
    n = F.col("row_no") + F.col("column_index")
    c = A.order_cells(spark, sf_dir).select(
        "table_id", F.col("row_no").cast("int").alias("row_no"), F.col("column_index").cast("int").alias("cell_ord"), "text",
        F.when(n % 3 == 0, 2).otherwise(1).alias("col_span"), F.when((n + F.col("column_index")) % 5 == 0, 3).otherwise(1).alias("row_span"),
    )
    return c.withColumn("role", F.when(F.col("row_no") == 1, "ColumnHeader").when((F.col("cell_ord") == 0) & (F.col("table_id") % 2 == 0), "RowHeader").otherwise("Data"))


#: Columns by which the adapter numbers an order's rows.
ORDER = "l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
CELLS = f"""r AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS INTEGER) AS row_no FROM lineitem),
c0 AS (SELECT l_orderkey AS table_id, row_no, unnest([0, 1, 2, 3]) AS cell_ord, unnest([CAST(l_partkey AS VARCHAR), l_returnflag, l_linestatus, CAST(l_suppkey AS VARCHAR)]) AS text FROM r),
c AS (SELECT *, CASE WHEN (row_no + cell_ord) % 3 = 0 THEN 2 ELSE 1 END AS col_span, CASE WHEN (row_no + 2 * cell_ord) % 5 = 0 THEN 3 ELSE 1 END AS row_span, CASE WHEN row_no = 1 THEN 'ColumnHeader' WHEN cell_ord = 0 AND table_id % 2 = 0 THEN 'RowHeader' ELSE 'Data' END AS role, row_number() OVER (PARTITION BY table_id ORDER BY row_no, cell_ord) AS k FROM c0),
st AS (SELECT DISTINCT table_id, 0::BIGINT AS k, 0 AS row_no, 0 AS cell_ord, 0 AS x, 0 AS behind, []::INTEGER[] AS taken FROM c
UNION ALL SELECT table_id, k, row_no, cell_ord, x, x + col_span, list_transform(range(0, greatest(len(taken), x + col_span)), lambda i: CAST(CASE WHEN i >= x AND i < x + col_span THEN greatest(coalesce(taken[i + 1], 0), row_no + row_span) ELSE coalesce(taken[i + 1], 0) END AS INTEGER))
FROM (SELECT c.table_id, c.k, c.row_no, c.cell_ord, c.col_span, c.row_span, s.taken, CAST(list_min(list_filter(range(CASE WHEN c.row_no = s.row_no THEN s.behind ELSE 0 END, greatest(len(s.taken), s.behind) + 1), lambda i: coalesce(s.taken[i + 1], 0) <= c.row_no)) AS INTEGER) AS x FROM st s JOIN c ON c.table_id = s.table_id AND c.k = s.k + 1))"""


def placed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.placed(spanned_cells(spark, sf_dir))


def spanned_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cell_headers(S.placed(spanned_cells(spark, sf_dir), "col_span", "row_span", "text", "role"))


HEADERS = """p AS (SELECT c.*, s.x AS column_index FROM c JOIN st s ON s.table_id = c.table_id AND s.k = c.k), sl AS (SELECT *, row_no + dy AS y, column_index + dx AS x FROM (SELECT *, unnest(range(0, row_span)) AS dy FROM p), unnest(range(0, col_span)) AS u(dx)),
top AS (SELECT * FROM sl QUALIFY row_number() OVER (PARTITION BY table_id, y, x ORDER BY row_no DESC, cell_ord DESC) = 1),
h AS (SELECT *, last_value(CASE WHEN role IN ('ColumnHeader', 'Header') THEN text END IGNORE NULLS) OVER (PARTITION BY table_id, x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ch, last_value(CASE WHEN role IN ('RowHeader', 'Header') THEN text END IGNORE NULLS) OVER (PARTITION BY table_id, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rh FROM top)
SELECT table_id, row_no, cell_ord, arg_min(ch, dx * 1000 + dy) FILTER (WHERE ch IS NOT NULL) AS column_header, arg_min(rh, dy * 1000 + dx) FILTER (WHERE rh IS NOT NULL) AS row_header FROM h WHERE role = 'Data' GROUP BY 1, 2, 3"""


R.add("w01_cells_with_spans_of_orders", placed_cells, f"WITH RECURSIVE {CELLS} SELECT table_id, row_no, cell_ord, x AS column_index FROM st WHERE k > 0")
R.add("j08_j09_headers_with_spans_of_orders", spanned_headers, f"WITH RECURSIVE {CELLS}, {HEADERS}")


def cursor_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N4 from places all through every document: its start, a quarter, half, three quarters and its end."""
    d = A.read(spark, sf_dir, "documents", "doc_id", "text")
    n = F.length(F.coalesce("text", F.lit("")))
    return C.moves(d, d.select("doc_id", F.explode(F.array_distinct(F.array(*(F.floor(n * k / 4) for k in range(5))))).alias("position")))


def _units_sql(unit: str, pattern: str) -> str:
    pattern = pattern.replace("'", "''")
    space = r"[\x20\x09-\x0D]"
    return rf"""(SELECT doc_id, '{unit}' AS unit, pos + length(bare) - length(regexp_replace(bare, '^{space}+', '')) AS start, length(regexp_replace(bare, '^{space}+', '')) AS length FROM (SELECT doc_id, regexp_replace(ps[i], '{space}+$', '') AS bare, list_sum(list_transform(ps[1:i - 1], lambda q: length(q))) AS before0, coalesce(before0, 0) AS pos
FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS ps FROM documents), unnest(range(1, len(ps) + 1)) AS u(i)) WHERE length(bare) > 0)"""


R.add("n04_cursor_of_documents", cursor_moves, f"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents), p AS (SELECT DISTINCT doc_id, n, CAST(n * k // 4 AS BIGINT) AS position FROM d, unnest(range(0, 5)) AS q(k)),
u AS ({" UNION ALL ".join(f"SELECT * FROM {_units_sql(unit, pattern)}" for unit, pattern in C.PIECES.items())}), v AS (SELECT *, lag(start) OVER w AS before, lead(start) OVER w AS after FROM u WINDOW w AS (PARTITION BY doc_id, unit ORDER BY start)),
f AS (SELECT doc_id, unit, min(start) AS first FROM u GROUP BY 1, 2)
SELECT p.doc_id, p.position, x.unit, CAST(v.start AS BIGINT) AS start, CAST(v.length AS BIGINT) AS length, CAST(CASE WHEN v.start IS NULL THEN f.first ELSE v.after END AS BIGINT) AS next, CAST(v.before AS BIGINT) AS previous
FROM p CROSS JOIN (VALUES {", ".join(f"('{u}')" for u in C.PIECES)}) x(unit) ASOF LEFT JOIN v ON v.doc_id = p.doc_id AND v.unit = x.unit AND p.position >= v.start LEFT JOIN f ON f.doc_id = p.doc_id AND f.unit = x.unit
UNION ALL SELECT doc_id, position, 'Character', CASE WHEN position < n THEN position END, CASE WHEN position < n THEN 1 END, CASE WHEN position + 1 < n THEN position + 1 END, CASE WHEN position > 0 AND position - 1 < n THEN position - 1 END FROM p""")  # fmt: skip


# ---- Orders as printed tables -----------------------------------------------------------------------------------------------
ITEMS = CELLS[: CELLS.index(",\nc AS (")]
PRINTED = f"{ITEMS}, w AS {P.ORDERS_SQL}, n AS (SELECT doc_id, max(line_no) AS items FROM w GROUP BY 1)"
PAGE, TABLE = ["doc_id", "page_no"], ["doc_id", "page_no", "table_id"]


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.printed_orders(A.order_cells(spark, sf_dir, "int"))


def _columned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TD.with_columns_of_page(orders(spark, sf_dir))


def add(name: str, query, sql: str) -> None:
    R.add(name, query, f"WITH {PRINTED} {sql}")


add("td01_lines_of_orders", lambda s, d: TD.to_lines(orders(s, d)).select("doc_id", "page_no", "line_no", "word_ord", "text"), "SELECT doc_id, page_no, line_no, word_ord, text FROM w")
add("td02_starts_of_orders", lambda s, d: TD.group_starts(orders(s, d)), "SELECT doc_id, page_no, line_no, l AS start FROM w")
X = f"[{', '.join(map(str, P.COLUMNS))}]"
add("td03_columns_of_orders", lambda s, d: TD.find_columns(TD.group_starts(orders(s, d)), PAGE), f"SELECT doc_id, 1 AS page_no, {X}[i] AS x, CAST(i - 1 AS INTEGER) AS column_index, {X}[i + 1] AS next_x FROM n, unnest(range(1, 5)) AS u(i)")
add("td05_rows_of_orders", lambda s, d: TD.respecting(_columned(s, d)), "SELECT doc_id, page_no, line_no, bool_and(r <= [180.0, 300.0, 420.0, 1e9][place + 1]) AS respects FROM w WHERE place < 3 GROUP BY 1, 2, 3")
add("td11_cells_of_orders", lambda s, d: TD.celled(_columned(s, d)), "SELECT doc_id, page_no, line_no, place AS column_index, text, bold FROM w")
add("td04_candidates_of_orders", lambda s, d: TD.lined_candidates(orders(s, d)).select("doc_id", "page_no", "table_id", "line_no", "row_no", F.size("columns").alias("n_columns")), "SELECT w.doc_id, 1 AS page_no, 0 AS table_id, line_no, line_no AS row_no, 4 AS n_columns FROM w JOIN n ON n.doc_id = w.doc_id WHERE items >= 2 GROUP BY 1, line_no")
add("td06_td07_plausible_orders", lambda s, d: TD.plausible_tables(TD.candidate_tables(orders(s, d)), TABLE), "SELECT doc_id, 1 AS page_no, 0 AS table_id, TRUE AS is_table, FALSE AS marker_column FROM n WHERE items >= 2")
add("td08_td09_headers_of_orders", lambda s, d: TD.headers_of_tables(TD.candidate_tables(orders(s, d)), TABLE), "SELECT doc_id, 1 AS page_no, 0 AS table_id, TRUE AS header_row, doc_id % 3 = 0 AS header_column FROM n WHERE items >= 2")
add("td_detected_tables_of_orders", lambda s, d: TD.detect(orders(s, d)), "SELECT doc_id, 1 AS page_no, 0 AS table_id, items + 1 AS n_rows, 4 AS n_columns, TRUE AS header_row, doc_id % 3 = 0 AS header_column FROM n WHERE items >= 2")


def texts(words: DataFrame) -> DataFrame:
    return words.select(*PAGE, F.col("word_ord").alias("ord"), F.lit("Paragraph").alias("kind"), "text", "l", "b", "r", "t")


def _rows_as(words: DataFrame, name: str, left: float, right: float) -> DataFrame:
    """A box a row between two edges, numbered as its line."""
    return words.filter("place = 0").select(*PAGE, F.col("line_no").alias(name), F.lit(left).alias("l"), "b", F.lit(right).alias("r"), "t")


def labels_of_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field at the right of every row, but that of the head, which stands a line above the page's text."""
    w = orders(spark, sf_dir)
    f = _rows_as(w, "field_id", 500.0, 560.0)
    up = F.when(F.col("field_id") == 0, 15.0).otherwise(0.0)
    return J.nearest_labels(f.withColumn("b", F.col("b") + up).withColumn("t", F.col("t") + up), texts(w))


add("j01_labels_of_orders", labels_of_fields, "SELECT doc_id, page_no, line_no AS field_id, CASE WHEN line_no > 0 THEN 1 END AS phase, CASE WHEN line_no > 0 THEN text END AS label FROM w WHERE place = 3")
add("j04_options_of_orders", lambda s, d: J.option_labels(_rows_as(orders(s, d), "option_id", 40.0, 50.0), texts(orders(s, d))), "SELECT doc_id, page_no, line_no AS option_id, text AS label FROM w WHERE place = 0")
add("j02_o05_regions_of_orders", lambda s, d: J.words_in(orders(s, d).select(*PAGE).distinct().select(*PAGE, F.lit(1).alias("region_id"), F.lit(0.0).alias("l"), F.lit(0.0).alias("b"), F.lit(400.0).alias("r"), F.lit(842.0).alias("t")), orders(s, d), 6), "SELECT doc_id, page_no, 1 AS region_id, string_agg(text, ' ' ORDER BY word_ord) AS text, 6 AS n_words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY word_ord) AS k FROM w WHERE place < 3) WHERE k <= 6 GROUP BY 1, 2")
add("j03_first_words_of_orders", lambda s, d: J.first_overlap(_rows_as(orders(s, d), "region_id", 170.0, 560.0), texts(orders(s, d)).drop("kind")), "SELECT doc_id, page_no, line_no AS region_id, arg_min(text, word_ord) AS text FROM w WHERE r > 170 GROUP BY 1, 2, 3")
add("j05_enclosing_words_of_orders", lambda s, d: J.smallest_enclosing(orders(s, d).select(*PAGE, F.col("word_ord").alias("point_id"), ((F.col("l") + F.col("r")) / 2).alias("x"), ((F.col("b") + F.col("t")) / 2).alias("y")), orders(s, d).select(*PAGE, F.col("word_ord").alias("element_id"), F.col("word_ord").alias("ord"), "l", "b", "r", "t"), 2.0), "SELECT doc_id, page_no, word_ord AS point_id, word_ord AS element_id FROM w")
R.add("t30_rows_of_orders", lambda s, d: TD.grid(spanned_cells(s, d).withColumn("column_index", F.col("cell_ord")).select("table_id", "row_no", "column_index", "text", "role")), f"""WITH {CELLS[: CELLS.index("st AS (") - 2]}, h AS (SELECT table_id, cell_ord, text AS name FROM c WHERE row_no = 1)
SELECT c.table_id, c.row_no, max(c.text) FILTER (WHERE c.role = 'RowHeader') AS row_label, string_agg(h.name, '|' ORDER BY c.cell_ord) AS names, string_agg(c.text, '|' ORDER BY c.cell_ord) AS texts FROM c JOIN h ON h.table_id = c.table_id AND h.cell_ord = c.cell_ord WHERE c.row_no > 1 GROUP BY 1, 2""")


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict:
    return R.sql
