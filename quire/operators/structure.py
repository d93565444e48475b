"""Inference of document structure from words and elements. Windows and joins are keyed by doc_id, so documents run in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import layout as L
from quire.functions import text as T
from quire.runtime import dealt

#: Pages that the passes over a document look at, and the bands where furniture stands.
BODY_PAGES, MARGIN_PAGES, FURNITURE_PAGES, LEAST_PAGES, TOP_BAND, BOTTOM_BAND = 12, 8, 30, 4, 0.88, 0.12
DEFAULT_SIZE = 12.0
#: Structure tags and their kinds; heading tags and levels.
TAG_KINDS = {
    "Document": "Document", "DocumentFragment": "Document", "Part": "Section", "Art": "Section", "Sect": "Section", "Div": "Section",
    "H": "Heading", "H1": "Heading", "H2": "Heading", "H3": "Heading", "H4": "Heading", "H5": "Heading", "H6": "Heading", "H7": "Heading", "H8": "Heading", "H9": "Heading",
    "P": "Paragraph", "L": "List", "LI": "ListItem", "Lbl": "Paragraph", "LBody": "Paragraph", "Table": "Table", "TR": "TableRow", "TH": "TableCell", "TD": "TableCell",
    "THead": "Section", "TBody": "Section", "TFoot": "Section", "Figure": "Figure", "Formula": "Figure", "Caption": "Caption", "BlockQuote": "BlockQuote", "Code": "Code",
    "Note": "Note", "FENote": "Note", "TOC": "TableOfContents", "TOCI": "TableOfContents", "Link": "Link", "Form": "FormField", "Annot": "Annotation", "Artifact": "Artifact",
    "Span": "Paragraph", "Quote": "Paragraph", "Reference": "Paragraph", "BibEntry": "Paragraph", "Ruby": "Paragraph", "Warichu": "Paragraph", "Em": "Paragraph", "Strong": "Paragraph",
}
TAG_LEVELS = {"H1": 1, "H2": 2, "H3": 3, "H4": 4, "H5": 5, "H6": 6, "H7": 6, "H8": 6, "H9": 6}
NUMBERINGS = {"Disc": "Bullet", "Circle": "Bullet", "Square": "Bullet", "Decimal": "Decimal", "LowerAlpha": "LowerAlpha", "UpperAlpha": "UpperAlpha", "LowerRoman": "LowerRoman", "UpperRoman": "UpperRoman"}
ARTIFACTS = {"Header": "header", "Footer": "footer", "Watermark": "watermark", "Pagination": "page number", "Layout": "layout decoration"}


def most_common(df: DataFrame, keys: list[str], value: Column, weight: Column, position: Column, name: str) -> DataFrame:
    """A2: the value with the largest weight in each group; of equals, the one that is seen first. Sums first, so that hot groups shuffle few rows."""
    sums = df.groupBy(*keys, value.alias(name)).agg(F.sum(weight).alias("_n"), F.min(position).alias("_at"))
    return sums.groupBy(*keys).agg(F.max_by(name, F.struct("_n", -F.col("_at"))).alias(name))


def position() -> Column:
    return F.col("page_no").cast("long") * 1_000_000 + F.col("word_ord")


def body_size(words: DataFrame) -> DataFrame:
    """The most common size of letters on the first pages."""
    w = words.filter((F.col("page_no") <= BODY_PAGES) & (F.col("size") > 0) & (F.trim("text") != ""))
    found = most_common(w, ["doc_id"], F.bround("size", 1), F.length(F.regexp_replace("text", r"\s", "")), position(), "body_size")
    return words.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("body_size", F.lit(DEFAULT_SIZE)).alias("body_size"))


def left_margin(words: DataFrame) -> DataFrame:
    """The most common left edge on the first pages, in steps of three points."""
    found = most_common(words.filter(F.col("page_no") <= MARGIN_PAGES), ["doc_id"], (F.col("l") / 3).cast("int"), F.lit(1), position(), "step")
    return words.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", (F.coalesce("step", F.lit(0)) * 3.0).alias("left_margin"))


def block_type(words: DataFrame, keys: list[str]) -> DataFrame:
    """Dominant size and font of each block, and whether most of its letters are bold or italic."""
    n = F.length(F.regexp_replace("text", r"\s", ""))
    w = words.filter(n > 0)
    bold = F.col("bold") | F.contains(F.lower("font"), F.lit("bold"))
    italic = F.col("italic") | F.lower("font").rlike("italic|oblique")
    flags = w.groupBy(*keys).agg((2 * F.sum(F.when(bold, n).otherwise(0)) > F.sum(n)).alias("mostly_bold"), (2 * F.sum(F.when(italic, n).otherwise(0)) > F.sum(n)).alias("mostly_italic"))
    size = most_common(w, keys, F.bround("size", 1), n, position(), "dominant_size")
    font = most_common(w, keys, F.col("font"), n, position(), "dominant_font")
    return flags.join(size, keys).join(font, keys)


def lines_of(words: DataFrame) -> DataFrame:
    """Words with the same rounded bottom are a line; lines from the top, words from the left."""
    w = words.withColumn("base", F.bround("b", 1))
    inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l", "word_ord", "text"))), lambda s: s["text"]), " ")
    lines = w.groupBy("doc_id", "page_no", "base").agg(inside.alias("text"), F.min("l").alias("l"), F.max("r").alias("r"), F.min("b").alias("b"), F.max("t").alias("t"), F.max("size").alias("size"))
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy(F.col("base").desc())))


def _sizes(pages: DataFrame, name: str) -> DataFrame:
    """The pages of each document as one list, so that elements that are dealt by document stay where they are."""
    return pages.groupBy("doc_id").agg(F.collect_list(F.struct("page_no", "height")).alias(name))


def _height(name: str) -> Column:
    """The height of an element's page in the list of _sizes."""
    return F.get(F.col(name)["height"], (F.array_position(F.col(name)["page_no"], F.col("page_no")) - 1).cast("int"))


def furniture(units: DataFrame, pages: DataFrame) -> DataFrame:
    """Normalised texts that stand in the top or bottom band on most pages. units: words or lines. pages: each once."""
    first = _sizes(pages.filter(F.col("page_no") <= FURNITURE_PAGES), "_pages")
    u = units.filter(F.col("page_no") <= FURNITURE_PAGES).join(dealt(first), "doc_id").withColumn("height", _height("_pages")).filter((F.col("b") >= TOP_BAND * F.col("height")) | (F.col("b") <= BOTTOM_BAND * F.col("height")))
    keys = u.select("doc_id", F.size("_pages").alias("n_pages"), "page_no", T.furniture_key("text").alias("key")).filter(F.length("key") >= 2).distinct()
    seen = keys.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.max("n_pages").alias("n_pages"))
    return seen.filter((F.col("n_pages") >= LEAST_PAGES) & (F.col("n") >= F.greatest(F.lit(3), F.floor(2 * F.col("n_pages") / 3)))).select("doc_id", "key", "n")


def mark_furniture(elements: DataFrame, found: DataFrame, pages: DataFrame) -> DataFrame:
    """C14: text elements whose normalised text is furniture become artifacts of the band that they stand in. pages: each once."""
    # A document has few such texts: they come as one list a document with its pages, so elements that are dealt by it stay where they are.
    keys = found.groupBy("doc_id").agg(F.collect_set("key").alias("_keys"))
    marks = keys.join(dealt(_sizes(pages, "_pages")), "doc_id", "left")
    e = elements.join(dealt(marks), "doc_id", "left").withColumn("hit", F.array_contains("_keys", T.furniture_key("text"))).withColumn("height", F.when(F.col("hit"), _height("_pages"))).drop("_keys", "_pages")
    place = F.when(F.col("b") > 0.85 * F.col("height"), "header").when(F.col("t") < 0.15 * F.col("height"), "footer").otherwise("page furniture")
    return e.withColumn("artifact_type", F.when(F.col("hit"), place)).drop("hit", "height")


def runs(df: DataFrame, keys: list[str], order: str, flag: Column, name: str = "run") -> DataFrame:
    """Numbers the maximal runs of rows with the same flag."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.coalesce((flag != F.lag(flag).over(w)).cast("int"), F.lit(1))
    return df.withColumn("_changed", changed).withColumn(name, F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def list_runs(elements: DataFrame) -> DataFrame:
    """C11: runs of list items: doc_id, first, n_items, marker_kind of the first. A run of one is no list but a paragraph."""
    e = runs(elements.select("doc_id", "reading_order", "kind", "marker_kind"), ["doc_id"], "reading_order", F.col("kind") == "ListItem").filter("kind = 'ListItem'")
    g = e.groupBy("doc_id", "run").agg(F.min("reading_order").alias("first"), F.count("*").alias("n_items"), F.min_by("marker_kind", "reading_order").alias("marker_kind"))
    return g.select("doc_id", "first", "n_items", "marker_kind", F.when(F.col("n_items") >= 2, "List").otherwise("Paragraph").alias("kind"))


def merged_paragraphs(elements: DataFrame) -> DataFrame:
    """Paragraphs that run on into the next are one. The test sees neighbours only: the end of what is merged is the end of its last fragment."""
    w = Window.partitionBy("doc_id").orderBy("reading_order")
    both = (F.col("kind") == "Paragraph") & (F.lag("kind").over(w) == "Paragraph")
    goes_on = both & L.joins_next(F.lag("text").over(w), F.col("text"))
    e = elements.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "text"))), lambda s: s["text"])
    g = e.groupBy("doc_id", "_run").agg(F.min("reading_order").alias("reading_order"), F.min_by("kind", "reading_order").alias("kind"), F.count("*").alias("n_fragments"), parts.alias("_parts"))
    return g.select("doc_id", "reading_order", "kind", "n_fragments", L.joined(F.col("_parts")).alias("text"))


def tab_order(fields: DataFrame) -> DataFrame:
    """Fields by page, from the top, from the left."""
    w = Window.partitionBy("doc_id").orderBy("page_no", F.bround("t", 1).desc(), "l", "field_id")
    return fields.withColumn("tab_order", F.row_number().over(w))


def image_only(elements: DataFrame) -> DataFrame:
    """Pages with a figure and no text of over two characters outside artifacts."""
    text = (F.col("kind") != "Artifact") & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 2)
    return elements.groupBy("doc_id", "page_no").agg((F.bool_or(F.col("kind") == "Figure") & ~F.bool_or(text)).alias("is_image_only"))


def tagged_status(elements: DataFrame) -> DataFrame:
    """Scanned if every page is an image only; else by the share of content elements that the file itself declares."""
    pages = image_only(elements).groupBy("doc_id").agg(F.bool_and("is_image_only").alias("scan"))
    content = ~F.col("kind").isin("Document", "Page", "Section")
    share = elements.groupBy("doc_id").agg((F.count_if(content & F.col("from_tags")) / F.nullif(F.count_if(content), F.lit(0))).alias("share"))
    return share.join(pages, "doc_id").select("doc_id", F.when(F.col("scan"), "ScannedWithoutText").when(F.col("share") >= 0.9, "FullyTagged").when(F.col("share") >= 0.1, "PartiallyTagged").otherwise("Untagged").alias("status"))


def insert_before(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """The place of each table in the order of blocks: before the first block whose top is below the table's top, else last."""
    b = blocks.select("doc_id", "page_no", "ord", F.col("t").alias("block_top"))
    j = tables.join(b, ["doc_id", "page_no"], "left")
    return j.groupBy("doc_id", "page_no", "table_id").agg(F.coalesce(F.min(F.when(F.col("block_top") < F.col("t"), F.col("ord"))), F.max("ord") + 1, F.lit(0)).alias("at"))


def without_empty(elements: DataFrame) -> DataFrame:
    """Elements with children, text, or that are figures or fields."""
    # Every element stands at its own number and, bare, at its parent's, so the rows are read once and nothing is joined.
    one = lambda at, own: F.struct(F.col(at).alias("_at"), own.alias("_row"))
    row = F.struct(*elements.columns)
    both = elements.select("doc_id", F.inline(F.array(one("element_id", row), one("parent_id", F.when(F.lit(False), row))))).filter("_row IS NOT NULL OR _at IS NOT NULL")
    e = both.withColumn("_children", F.max(F.col("_row").isNull()).over(Window.partitionBy("doc_id", "_at"))).filter("_row IS NOT NULL").select("_row.*", "_children")
    return e.filter(F.col("_children") | (F.trim(F.coalesce("text", F.lit(""))) != "") | F.col("kind").isin("Figure", "FormField")).drop("_children")


def strategy(marked: DataFrame) -> DataFrame:
    """A page whose marked content has any known kind is read by its tags, else by its layout. marked: doc_id, page_no, tag (null: none)."""
    known = F.col("tag").isin(*TAG_KINDS)
    return marked.groupBy("doc_id", "page_no").agg(F.when(F.coalesce(F.bool_or(known), F.lit(False)), "tagged").otherwise("layout").alias("strategy"))


def from_tags(marked: DataFrame) -> DataFrame:
    """Kind, level, cell role, list numbering, artifact type, actual text and language of marked content."""
    look = lambda table, c: F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(c))
    some = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    kind = F.coalesce(look(TAG_KINDS, "tag"), F.when(F.coalesce("tag", F.lit("")) == "", "Unknown").otherwise("Section"))
    role = F.when(F.col("tag") == "TH", F.when(F.col("scope") == "Row", "RowHeader").when(F.col("scope") == "Column", "ColumnHeader").otherwise("Header")).when(F.col("tag") == "TD", "Data")
    return marked.select(
        "doc_id", "element_id", "tag", kind.alias("kind"), look(TAG_LEVELS, "tag").alias("heading_level"), role.alias("cell_role"),
        F.when(F.col("tag") == "L", F.coalesce(look(NUMBERINGS, "numbering"), F.lit("None"))).alias("marker_kind"),
        F.when(F.col("tag") == "Artifact", F.coalesce(look(ARTIFACTS, "subtype"), F.lit("page furniture"))).alias("artifact_type"),
        F.coalesce(some("actual_text"), some("expanded")).alias("actual_text"), some("lang").alias("language"), F.when(kind == "Figure", some("alt")).alias("alt"),
    )
