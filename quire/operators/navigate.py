"""Movement through a document as tables of next links, and the units of text that a cursor moves by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import dealt

READABLE = ("Paragraph", "Heading", "ListItem", "BlockQuote", "Code", "Caption", "TableCell", "Figure")
#: Names of the units in boundary messages.
UNITS = {"Heading": "headings", "List": "lists", "ListItem": "list items", "Table": "tables", "TableCell": "cells", "Figure": "figures", "Link": "links", "FormField": "form fields", "UnfilledFormField": "form fields still to fill in", "Annotation": "comments", "Paragraph": "paragraphs"}


def granularities(levelled: bool = True) -> dict[str, Column]:
    """What each kind of movement stops at. Elements have kind, text, needs_attention, annotation_kind and, if ``levelled``, level.

    Pages, search matches and issues have tables of their own (N3, Q6, N6), and so have the units inside an element's text (N4).
    """
    kind, said = F.col("kind"), F.trim(F.coalesce("text", F.lit(""))) != ""
    plain = {k: kind == k for k in ("Heading", "List", "ListItem", "Table", "TableCell", "Figure", "Link", "FormField")}
    levels = {f"HeadingAtLevel{n}": (kind == "Heading") & (F.col("level") == n) for n in range(1, 7)} if levelled else {}
    return plain | levels | {
        "UnfilledFormField": (kind == "FormField") & F.coalesce("needs_attention", F.lit(False)),
        "Annotation": (kind == "Annotation") & (F.coalesce("annotation_kind", F.lit("")) != "Popup"),
        "Paragraph": kind.isin(*READABLE) & (said | (kind == "Figure")),
        "Element": said | kind.isin("Figure", "FormField", "Link", "Annotation"),
    }


def next_links(elements: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """For every element and granularity the next and previous stop and the first and last of the document; one sort serves all."""
    w = Window.partitionBy("doc_id").orderBy("reading_order")
    all_ = Window.partitionBy("doc_id")
    table = granularities("level" in elements.columns)
    out = []
    for name in names or tuple(table):
        at = F.when(table[name], F.col("reading_order"))
        out.append(F.struct(
            F.lit(name).alias("granularity"), F.first(at, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next"),
            F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("previous"), F.min(at).over(all_).alias("first"), F.max(at).over(all_).alias("last"),
        ))
    return elements.select("doc_id", "reading_order", F.array(*out).alias("l")).select("doc_id", "reading_order", F.inline("l"))


def page_landings(elements: DataFrame) -> DataFrame:
    """The first readable element of each page, else its first."""
    readable = F.col("kind").isin(*READABLE) & (F.trim("text") != "")
    g = elements.groupBy("doc_id", "page_no").agg(F.coalesce(F.min(F.when(readable, F.col("reading_order"))), F.min("reading_order")).alias("landing"))
    return g


def go_to_page(requests: DataFrame, landings: DataFrame) -> DataFrame:
    """Requested pages held within the document, with what is said if they weren't. requests: doc_id, page."""
    n = landings.groupBy("doc_id").agg(F.max("page_no").alias("pages"))
    r = requests.join(n, "doc_id").withColumn("page_no", F.greatest(F.lit(1), F.least("page", "pages")).cast("int"))
    note = F.when(F.col("page") < 1, "first page").when(F.col("page") > F.col("pages"), "last page")
    return r.join(landings, ["doc_id", "page_no"], "left").select("doc_id", "page", "page_no", "landing", note.alias("note"))


def words(text: Column) -> Column:
    """A blank text has none. White space is listed, since engines differ on whether a vertical tab is in its class."""
    return F.filter(F.split(text, r"[ \t\n\f\r]+"), lambda x: x != "")


def sentences(text: Column) -> Column:
    """A sentence ends at . ! or ? with closing marks and white space behind it."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)\S.*?(?:[.!?][\"')\]”’]*(?=\s|$)|$)"), F.lit(0)), lambda s: F.trim(s))


def boundary_message(granularity: Column, direction: Column) -> Column:
    """N7."""
    level = F.regexp_extract(granularity, "^HeadingAtLevel([1-6])$", 1)
    named = F.try_element_at(F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv)), granularity)
    unit = F.when(level != "", F.concat(F.lit("level "), level, F.lit(" headings"))).otherwise(F.coalesce(named, F.lit("content")))
    more = lambda end: F.concat(F.lit("No more "), unit, F.lit(end))
    return F.when(direction == "Next", more(" after this point.")).when(direction == "Previous", more(" before this point.")).otherwise(F.concat(F.lit("There are no "), unit, F.lit(" in this document.")))


#: What a position is said to lie inside, and how many of these are named.
CONTAINERS, MOST_CONTAINERS = ("List", "Table", "TableRow", "Section", "Figure"), 3


def position(walked: DataFrame, pairs: DataFrame, described: DataFrame) -> DataFrame:
    """What stands at each element in full: itself, the nearest containers, the last heading before it and the page.

    walked, pairs: a tree's elements with reading_order, kind, text, page_no, and its ancestors (see tree). described: doc_id, element_id, full (detailed words), brief (terse words).
    """
    above = described.join(dealt(walked.filter(F.col("kind").isin(*CONTAINERS)).select("doc_id", "element_id")), ["doc_id", "element_id"]).select("doc_id", F.col("element_id").alias("ancestor_id"), "brief")
    inside = pairs.join(dealt(above), ["doc_id", "ancestor_id"]).groupBy("doc_id", "element_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "brief"))), 1, MOST_CONTAINERS).alias("c"))
    w = Window.partitionBy("doc_id").orderBy("reading_order").rowsBetween(Window.unboundedPreceding, -1)
    e = walked.withColumn("head", F.last(F.when(F.col("kind") == "Heading", F.coalesce("text", F.lit(""))), ignorenulls=True).over(w)).withColumn("pages", F.max("page_no").over(Window.partitionBy("doc_id")))
    e = e.join(dealt(described), ["doc_id", "element_id"]).join(dealt(inside), ["doc_id", "element_id"], "left")
    around = F.when(F.size("c") > 0, F.concat(F.lit("inside "), F.array_join(F.transform("c", lambda x: x["brief"]), ", inside ")))
    under = F.when(F.col("head").isNotNull(), F.concat(F.lit('under the heading "'), F.col("head"), F.lit('"')))
    page = F.when(F.col("page_no") > 0, F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(" of "), F.col("pages").cast("string")))
    return e.select("doc_id", "element_id", F.concat(F.concat_ws(", ", "full", around, under, page), F.lit(".")).alias("position"))


def where_am_i(elements: DataFrame) -> DataFrame:
    """The last heading, page n of N and the share of the document that lies behind."""
    w = Window.partitionBy("doc_id").orderBy("reading_order").rowsBetween(Window.unboundedPreceding, 0)
    pages, n = F.max("page_no").over(Window.partitionBy("doc_id")), F.count("*").over(Window.partitionBy("doc_id"))
    place = F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(" of "), pages.cast("string"))
    return elements.select("doc_id", "reading_order", F.last(F.when(F.col("kind") == "Heading", F.col("text")), ignorenulls=True).over(w).alias("heading"), place.alias("place"), F.floor(F.count("*").over(w) * 100 / n).cast("int").alias("percent"))
