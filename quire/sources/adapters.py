"""Tables of the corpus as document elements. Every result is keyed by doc_id and ordered by reading_order within it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import layout as L

from . import markup as M

LINES_PER_PAGE = 40


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One element a line: doc_id, lang, reading_order, page_no, kind, marker_kind, marker, body, text. A page is LINES_PER_PAGE lines."""
    d = read(spark, sf_dir, "documents", "doc_id", "lang", "text")
    e = d.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("reading_order", "text"))
    e = e.withColumn("page_no", (F.floor(F.col("reading_order") / LINES_PER_PAGE) + 1).cast("int"))
    return L.classify_lines(e)


def text_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).select("doc_id", "lang", "reading_order", "page_no", "kind", "text")


def given_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, html, dealt out: a file may keep all its pages in one row group, which one task would read alone."""
    return read(spark, sf_dir, "pages", "page_id", "html").repartition(spark.sparkContext.defaultParallelism)


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of the HTML pages in order: doc_id, reading_order, tag, kind, level, text, href."""
    e = M.page_tree(given_pages(spark, sf_dir)).filter("kind <> 'Run'")
    level = F.when(F.col("kind") == "Heading", F.substring("tag", 2, 1).cast("int"))
    return e.select("doc_id", F.col("element_id").alias("reading_order"), "tag", "text", "kind", level.alias("level"), F.nullif(F.try_element_at("attrs", F.lit("href")), F.lit("")).alias("href"))


#: The same elements in DuckDB.
PAGE_ELEMENTS_SQL = f"(SELECT doc_id, element_id AS reading_order, tag, text, kind, CASE WHEN kind = 'Heading' THEN CAST(tag[2:2] AS INTEGER) END AS level, nullif({M.attribute_sql('href')}, '') AS href FROM {M.tree_sql()} WHERE kind <> 'Run')"

#: One page a customer with a form, an image, a table and links, of which every so many have a fault; both engines know this SQL.
CUSTOMER_PAGES = """SELECT c_custkey AS page_id, CASE WHEN c_custkey % 13 = 0 THEN concat('<html lang=en><title>', c_name, '</title><body><img src="scan.png" alt="Scan of a letter">') ELSE concat('<!DOCTYPE html><HTML', CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 = 1 THEN ' LANG=en' ELSE ' lang="en"' END, '><head>', CASE WHEN c_custkey % 5 = 0 THEN '<title> </title>' ELSE concat('<title>', c_name, '</title>') END, '</head><body>',
CASE WHEN c_custkey % 11 = 0 THEN '<h1> </h1>' ELSE concat('<h1 id="top">', c_name, ' &amp; partners</h1>') END, CASE WHEN c_custkey % 4 = 0 THEN '<h3>Details</h3>' ELSE '<h2>Details</h2>' END,
CASE WHEN c_custkey % 6 = 0 THEN concat('<div>Segment of ', c_name, ' is ', c_mktsegment, ' and this text stands in a plain division only.</div>') ELSE concat('<p>Segment: <b>', c_mktsegment, '</b>.<p>Nation ', CAST(c_nationkey AS STRING), ', balance ', CAST(CAST(c_acctbal AS DECIMAL(15, 2)) AS STRING), '</p>') END,
'<img src="logo.png" width="200" height="80"', CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN ' alt=""' ELSE concat(' ALT=', chr(39), 'Logo of ', c_name, chr(39)) END, '><img src="dot.gif" width="2" height="2">',
'<section><h2>Ways in</h2><ol><li>By telephone<ul><li>Extension ', CAST(c_custkey % 90 AS STRING), '<li>Desk ', CAST(c_nationkey AS STRING), '</ul>weekdays only<li>By letter</ol><blockquote>Ask for ', c_name, '</blockquote></section>',
'<form>', CASE WHEN c_custkey % 9 = 0 THEN '<input type="text" name="Text1">' WHEN c_custkey % 9 = 1 THEN '<p>Delivery date: <input type="text" name="fld7"></p>' WHEN c_custkey % 9 = 2 THEN '<input type="text" name="form.accountNumber">' WHEN c_custkey % 9 = 3 THEN '<label for=n>Your name</label><br><input id=n name=n1 required>'
WHEN c_custkey % 9 = 4 THEN '<label>Remarks <textarea name="t7" readonly>none &amp; nothing</textarea></label>' ELSE '<input type="text" name="q" title="Search">' END,
'<input type="hidden" name="token" value="1"><select name="nation" title="Nation"><option value="1">First<option value="2" selected>Second</select><input type=checkbox name=agree aria-label="I agree" checked><input type="submit" value="Send"></form>',
'<table>', CASE WHEN c_custkey % 8 = 0 THEN '<tr><td>Key<td>Nation</tr>' ELSE '<thead><tr><th>Key<th>Nation</thead>' END, '<tbody><tr><td>', CAST(c_custkey AS STRING), '<td>', CAST(c_nationkey AS STRING), '<tr><td>Balance</td><td>', CAST(CAST(c_acctbal AS DECIMAL(15, 2)) AS STRING), '</td></tr></table>',
'<p>More: ', CASE WHEN c_custkey % 10 = 0 THEN '<a href="/more">click here</a>' WHEN c_custkey % 10 = 1 THEN '<a href="/more" aria-label="All orders">here</a>' ELSE concat('<a href="/customers/', CAST(c_custkey AS STRING), '">orders of ', c_name, '</a>') END, ' or <a href="#top">back</a></p>', CASE WHEN c_custkey % 12 = 0 THEN '<p><a name="first" href="#second">one</a> <a id=second href=#third>two</a> <a id=third href=#top>three</a> <a id="round" href="#about">four</a> <a id="about" href="#round">five</a> <a href="#nowhere">six</a></p>' ELSE '' END, 'Last updated by hand.</body></html>') END AS html FROM customer"""


def customer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    # A row of a few numbers becomes a page: dealt out first, so that a small file doesn't make one task of all pages.
    return spark.sql(CUSTOMER_PAGES.replace("FROM customer", "FROM {customer}"), customer=c.repartition(spark.sparkContext.defaultParallelism))


def edit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an edit log: doc_id (the user), seq, made_at, op, target, value."""
    e = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("doc_id"), seq.alias("seq"), F.col("ts").alias("made_at"), F.col("event_type").alias("op"), F.col("event_id").alias("target"), "value")


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as comments: the first turn of each is a comment, the others reply to the one before."""
    c = read(spark, sf_dir, "conversations")
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("annotation_id"), before.alias("in_reply_to"), F.col("role").alias("author"), "text")


def order_cells(spark: SparkSession, sf_dir: str, key: str = "bigint") -> DataFrame:
    """Line items as table cells: a table an order, a row an item, four columns. (l_orderkey, l_linenumber) isn't a key, so rows are numbered over all columns. key: type of table_id, by which the rows are dealt."""
    li = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("table_id").orderBy(*(c for c in li.columns if c != "l_orderkey"))
    li = li.withColumn("table_id", F.col("l_orderkey").cast(key))
    r = li.withColumn("row_no", F.row_number().over(order))
    cells = F.array(*(F.struct(F.lit(i).alias("column_index"), F.col(c).cast("string").alias("text")) for i, c in enumerate(("l_partkey", "l_returnflag", "l_linestatus", "l_suppkey"))))
    return r.select("table_id", "row_no", F.inline(cells))
