"""Documents laid out as positioned words, as a printed page holds them: the words of every text in two columns below a full line, so that order has to be found from places.

A page has a head line of HEAD words across both columns and two columns of LINES lines of PER_LINE words. Widths follow the words' lengths. word_ord is scrambled by a hash: it says nothing about the order. true_ord is that of the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, LINES, PER_LINE = 4, 20, 4
PER_PAGE = HEAD + 2 * LINES * PER_LINE
WIDTH, HEIGHT, LEFT, TOP, CHAR, SIZE, LEADING, COLUMN, GUTTER, LONGEST = 595.0, 842.0, 60.0, 780.0, 4.0, 10.0, 14.0, 220.0, 40.0, 11
WORD = r"[^\x20\x09-\x0D]+"


def printed_words(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Gives doc_id, page_no, true_ord, part (0 head, 1 and 2 the columns), line_no, word_ord, text (cut to LONGEST characters), l, b, r, t, size, bold."""
    # Texts are dealt out, not their words: what is done within a document afterwards stays where it is.
    t = docs.repartition("doc_id").select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("_0"))
    c = F.col
    # Each word comes with the few that may stand before it in its line, so that no sort is needed to sum up their widths. Behind the last word these go on for a few rows without one.
    back = range(1, max(HEAD, PER_LINE))
    t = t.withColumns({f"_{k}": F.concat(F.array_repeat(F.lit(""), k), "_0") for k in back})
    w = t.select("doc_id", F.posexplode(F.arrays_zip("_0", *(f"_{k}" for k in back))).alias("true_ord", "_w")).filter("_w._0 IS NOT NULL")
    in_part = lambda n: n - F.when(n < HEAD, 0).when(n < HEAD + LINES * PER_LINE, HEAD).otherwise(HEAD + LINES * PER_LINE)
    nth = in_part(c("true_ord") % PER_PAGE) % PER_LINE
    before = reduce(Column.__add__, (F.when(nth >= k, F.least(F.length(f"_w._{k}"), F.lit(LONGEST)) + 1).otherwise(0) for k in back))
    w = w.select("doc_id", "true_ord", c("_w._0").alias("text"), before.alias("_before")).withColumn("text", F.substring("text", 1, LONGEST))
    w = w.withColumn("page_no", (F.floor(c("true_ord") / PER_PAGE) + 1).cast("int")).withColumn("_n", c("true_ord") % PER_PAGE)
    w = w.withColumn("part", F.when(c("_n") < HEAD, 0).when(c("_n") < HEAD + LINES * PER_LINE, 1).otherwise(2))
    w = w.withColumn("line_no", F.when(c("part") == 0, 0).otherwise(F.floor(in_part(c("_n")) / PER_LINE)).cast("int"))
    x = F.when(c("part") == 2, LEFT + COLUMN + GUTTER).otherwise(LEFT) + CHAR * c("_before")
    top = F.when(c("part") == 0, F.lit(TOP)).otherwise(TOP - 3 * LEADING - LEADING * c("line_no"))
    out = w.withColumn("l", x).withColumn("r", c("l") + CHAR * F.length("text")).withColumn("t", top).withColumn("b", top - SIZE)
    size, bold = F.when(c("part") == 0, 16.0).otherwise(SIZE), c("part") == 0
    return out.select("doc_id", "page_no", "true_ord", "part", "line_no", F.pmod(F.xxhash64("doc_id", "true_ord"), F.lit(1 << 30)).cast("int").alias("word_ord"), "text", "l", "b", "r", "t", size.alias("size"), bold.alias("bold"))


def printed_pages(docs: DataFrame) -> DataFrame:
    """doc_id and page_no of all pages of printed_words(docs), each once, from the numbers of words; dealt out as these are."""
    t = docs.repartition("doc_id").select("doc_id", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).alias("_n"))
    # No filter of documents without words, which would come before the dealing and keep it from serving both the pages and the words.
    pages = F.when(F.col("_n") > 0, F.sequence(F.lit(1), F.ceil(F.col("_n") / PER_PAGE).cast("int")))
    return t.groupBy("doc_id").agg(F.max("_n").alias("_n")).select("doc_id", F.explode(pages).alias("page_no"))


#: The same in DuckDB, without word_ord.
PRINTED_SQL = f"""(SELECT doc_id, page_no, true_ord, part, line_no, text, l, t - {SIZE} AS b, l + {CHAR} * length(text) AS r, t, CASE WHEN part = 0 THEN 16.0 ELSE {SIZE} END AS size, part = 0 AS bold FROM (
SELECT *, CASE WHEN part = 2 THEN {LEFT + COLUMN + GUTTER} ELSE {LEFT} END + {CHAR} * coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, page_no, part, line_no ORDER BY true_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l, CASE WHEN part = 0 THEN {TOP} ELSE {TOP - 3 * LEADING} - {LEADING} * line_no END AS t FROM (
SELECT *, CAST(CASE part WHEN 0 THEN 0 WHEN 1 THEN (n - {HEAD}) // {PER_LINE} ELSE (n - {HEAD + LINES * PER_LINE}) // {PER_LINE} END AS INTEGER) AS line_no FROM (
SELECT *, CASE WHEN n < {HEAD} THEN 0 WHEN n < {HEAD + LINES * PER_LINE} THEN 1 ELSE 2 END AS part FROM (
SELECT doc_id, i - 1 AS true_ord, CAST((i - 1) // {PER_PAGE} + 1 AS INTEGER) AS page_no, (i - 1) % {PER_PAGE} AS n, substr(ws[i], 1, {LONGEST}) AS text FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents), unnest(range(1, len(ws) + 1)) AS u(i))))))"""

#: Printed tables: where the columns start, their heads, and the height of a row.
COLUMNS, HEADS, ROW = (60.0, 180.0, 300.0, 420.0), ("Part", "Flag", "Status", "Supplier"), 20.0


def printed_orders(cells: DataFrame) -> DataFrame:
    """Orders as printed tables, a page each: a bold head, and a row an item; of every third order the flag stands first. cells: table_id, row_no (from 1), column_index, text. Gives doc_id, page_no, word_ord, text, l, b, r, t, bold, line_no, place."""
    c = F.col
    # The head goes along with the first row, so that no second pass looks for the tables.
    head = F.struct(F.lit(0).alias("row_no"), F.get(F.array(*map(F.lit, HEADS)), c("column_index")).alias("text"))
    own = F.struct(c("row_no").cast("int").alias("row_no"), c("text").alias("text"))
    w = cells.select("table_id", "column_index", F.inline(F.when(c("row_no") == 1, F.array(own, head)).otherwise(F.array(own))))
    swapped = F.when(c("column_index") == 0, 1).when(c("column_index") == 1, 0).otherwise(c("column_index"))
    place = F.when(c("table_id") % 3 == 0, swapped).otherwise(c("column_index"))
    x = F.get(F.array(*map(F.lit, COLUMNS)), place.cast("int"))
    top = F.lit(TOP) - ROW * c("row_no")
    return w.select(
        c("table_id").cast("int").alias("doc_id"), F.lit(1).alias("page_no"), (c("row_no") * 4 + place).cast("int").alias("word_ord"), "text", x.alias("l"), (top - SIZE).alias("b"), (x + CHAR * F.length("text")).alias("r"), top.alias("t"),
        (c("row_no") == 0).alias("bold"), c("row_no").cast("int").alias("line_no"), place.cast("int").alias("place"),
    )


#: The same in DuckDB over ``c0`` (table_id, row_no, cell_ord, text).
ORDERS_SQL = f"""(SELECT CAST(table_id AS INTEGER) AS doc_id, 1 AS page_no, CAST(row_no * 4 + place AS INTEGER) AS word_ord, text, [{', '.join(map(str, COLUMNS))}][place + 1] AS l, {TOP} - {ROW} * row_no - {SIZE} AS b, [{', '.join(map(str, COLUMNS))}][place + 1] + {CHAR} * length(text) AS r, {TOP} - {ROW} * row_no AS t, row_no = 0 AS bold, CAST(row_no AS INTEGER) AS line_no, place
FROM (SELECT *, CAST(CASE WHEN table_id % 3 = 0 AND cell_ord < 2 THEN 1 - cell_ord ELSE cell_ord END AS INTEGER) AS place FROM (SELECT table_id, row_no, cell_ord, text FROM c0 UNION ALL SELECT table_id, 0, unnest([0, 1, 2, 3]), unnest([{', '.join(repr(h) for h in HEADS)}]) FROM (SELECT DISTINCT table_id FROM c0))))"""
