"""Serialisation: semantic HTML and linear text with spans, from ordered rows of markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lang(language: Column) -> Column:
    return F.when(~T.blank(language), F.concat(F.lit(' lang="'), T.html_escape(F.trim(language)), F.lit('"'))).otherwise("")


def flat_html() -> Column:
    """Markup of one element; null where there is none.

    Columns: element_id, kind, level, text, language, rtl, decorative, alt, target_kind, target.
    """
    c, said = F.col, ~T.blank("text")
    anchor = F.concat(F.lit(' id="e'), c("element_id").cast("string"), F.lit('"'))
    tab = F.when(c("kind") == "Link", "").otherwise(' tabindex="-1"')
    attrs = F.concat(anchor, tab, _lang(c("language")), F.when(c("rtl"), ' dir="rtl"').otherwise(""))
    text = T.html_escape("text")
    tag = lambda name: F.concat(F.lit(f"<{name}"), attrs, F.lit(">"), text, F.lit(f"</{name}>"))
    h = F.concat(F.lit("h"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(2)))).cast("string"))
    heading = F.concat(F.lit("<"), h, attrs, F.lit(">"), text, F.lit("</"), h, F.lit(">"))
    figure = (
        F.when(c("decorative"), F.concat(F.lit("<img"), attrs, F.lit(' alt="">')))
        .when(~T.blank("alt"), F.concat(F.lit("<figure"), attrs, F.lit('><img alt="'), T.html_escape("alt"), F.lit('"><figcaption>'), T.html_escape("alt"), F.lit("</figcaption></figure>")))
        .otherwise(F.concat(F.lit("<button"), anchor, F.lit(">Image without a description</button>")))
    )
    shown = F.when(said, text).otherwise(T.html_escape("target"))
    differs = c("target_kind").isin("WebUrl", "Email") & said & (c("text") != c("target"))
    link = F.concat(F.lit("<a"), attrs, F.lit(' href="'), T.html_escape("target"), F.lit('">'), shown, F.lit("</a>"), F.when(differs, F.concat(F.lit(" ("), T.html_escape("target"), F.lit(")"))).otherwise(""))
    k = c("kind")
    return (
        F.when(k == "Artifact", F.lit(None).cast("string")).when(k == "Figure", figure).when(k == "Link", link).when(~said, F.lit(None).cast("string")).when(k == "Heading", heading)
        .when(k == "BlockQuote", tag("blockquote")).when(k == "Code", F.concat(F.lit("<pre"), attrs, F.lit("><code>"), text, F.lit("</code></pre>"))).when(k == "Note", tag("aside"))
        .when(k == "Caption", tag("p")).when(k.isin("Paragraph", "ListItem"), tag("p"))
    )


def page_open(page: Column | str, pages: Column | str) -> Column:
    """H1."""
    of = F.when(_c(pages) > 1, F.concat(F.lit(" of "), _c(pages).cast("string"))).otherwise("")
    return F.concat(F.lit('<section aria-label="Page '), _c(page).cast("string"), of, F.lit('">'))


def document_html(elements: DataFrame) -> DataFrame:
    """K1 for flat kinds: one HTML string a document. A document's own rows are what one aggregate holds."""
    e = elements.withColumn("m", flat_html())
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("m").isNotNull(), F.struct("reading_order", "m")))), lambda s: s["m"]), "\n")
    p = e.groupBy("doc_id", "page_no").agg(body.alias("body"), F.count("m").alias("n"))
    g = p.groupBy("doc_id").agg(F.max("page_no").alias("pages"), F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("page_no", "body")))).alias("s"))
    sections = F.transform("s", lambda x: F.concat_ws("\n", page_open(x["page_no"], F.col("pages")), x["body"], F.lit("</section>")))
    return g.filter(F.size("s") > 0).select("doc_id", F.array_join(sections, "\n").alias("html"))


def html_head(title: Column | str, file_name: Column | str, language: Column | str) -> Column:
    """H12."""
    name = F.coalesce(F.nullif(F.trim(_c(title)), F.lit("")), _c(file_name))
    lang = F.coalesce(F.nullif(F.trim(_c(language)), F.lit("")), F.lit("en"))
    policy = "<meta http-equiv=\"Content-Security-Policy\" content=\"default-src 'none'\">"
    return F.concat(F.lit('<!DOCTYPE html><html lang="'), T.html_escape(lang), F.lit(f'"><head><meta charset="utf-8">{policy}<title>'), T.html_escape(name), F.lit("</title></head>"))


def nested(events: DataFrame) -> DataFrame:
    """Nested markup from events (doc_id, path, phase, markup): an element's close (phase 1) comes after all that lies below its path. Gives one string a document."""
    # "~" sorts behind digits and the dot, so a close follows every path that its own path begins.
    key = F.concat(F.col("path"), F.when(F.col("phase") == 1, "~").otherwise(""))
    return events.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), "markup"))), lambda s: s["markup"]), "").alias("html"))


#: List marker kinds and the HTML type of an ordered list.
LIST_TYPES = {"Decimal": "1", "LowerAlpha": "a", "UpperAlpha": "A", "LowerRoman": "i", "UpperRoman": "I"}


def list_events(walked: DataFrame) -> DataFrame:
    """H6: open and close events of lists and items; an item outside a list gets one of its own. walked: doc_id, path, kind, marker_kind, parent_kind, text."""
    k, type_ = F.col("kind"), F.try_element_at(T.mapping(LIST_TYPES), F.col("marker_kind"))
    name = F.when(type_.isNotNull(), "ol").otherwise("ul")
    orphan = (k == "ListItem") & (F.coalesce("parent_kind", F.lit("")) != "List")
    open_ = F.when(k == "List", F.concat(F.lit("<"), name, F.when(type_.isNotNull(), F.concat(F.lit(' type="'), type_, F.lit('"'))).otherwise(""), F.lit(">"))).when(orphan, F.concat(F.lit("<ul><li>"), T.html_escape("text"))).when(k == "ListItem", F.concat(F.lit("<li>"), T.html_escape("text")))
    close = F.when(k == "List", F.concat(F.lit("</"), name, F.lit(">"))).when(orphan, "</li></ul>").when(k == "ListItem", "</li>")
    e = walked.filter(k.isin("List", "ListItem"))
    return e.select("doc_id", "path", F.lit(0).alias("phase"), open_.alias("markup")).unionByName(e.select("doc_id", "path", F.lit(1).alias("phase"), close.alias("markup")))


def table_html(cells: DataFrame) -> DataFrame:
    """H5: tables with a thead if all of the first row are headers, scopes, and spans over 1. cells: table_id, row_no, cell_ord, text, role, col_span, row_span."""
    first = F.min("row_no").over(Window.partitionBy("table_id"))
    head = F.bool_and(F.col("role") != "Data").over(Window.partitionBy("table_id", "row_no")) & (F.col("row_no") == first)
    c = cells.withColumn("head", head)
    scope = F.when(F.col("role") == "ColumnHeader", "col").when(F.col("role") == "RowHeader", "row").when(F.col("role") == "Header", F.when(F.col("head"), "col").otherwise("row"))
    span = lambda n: F.when(F.col(f"{n}_span") > 1, F.concat(F.lit(f' {n}span="'), F.col(f"{n}_span").cast("string"), F.lit('"'))).otherwise("")
    tag = F.when(scope.isNotNull(), "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, F.when(scope.isNotNull(), F.concat(F.lit(' scope="'), scope, F.lit('"'))).otherwise(""), span("col"), span("row"), F.lit(">"), T.html_escape("text"), F.lit("</"), tag, F.lit(">"))
    ordered = lambda key, x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, x.alias("x")))), lambda s: s["x"]), "")
    rows = c.groupBy("table_id", "row_no", "head").agg(ordered("cell_ord", cell).alias("cells"))
    row = F.concat(F.lit("<tr>"), F.col("cells"), F.lit("</tr>"))
    t = rows.groupBy("table_id").agg(ordered("row_no", F.when(F.col("head"), row)).alias("thead"), ordered("row_no", F.when(~F.col("head"), row)).alias("tbody"))
    return t.select("table_id", F.concat(F.lit("<table>"), F.when(F.col("thead") != "", F.concat(F.lit("<thead>"), F.col("thead"), F.lit("</thead>"))).otherwise(""), F.lit("<tbody>"), F.col("tbody"), F.lit("</tbody></table>")).alias("html"))


def comment_html(author: Column | str, text: Column | str, anchored: Column | str) -> Column:
    """H9: a comment without its replies."""
    who = F.when(~T.blank(author), F.concat(F.lit("<h3>"), T.html_escape(author), F.lit("</h3>"))).otherwise("")
    quote = F.when(~T.blank(anchored), F.concat(F.lit("<blockquote>"), T.html_escape(anchored), F.lit("</blockquote>"))).otherwise("")
    return F.concat(F.lit("<article>"), who, F.lit("<p>"), T.html_escape(text), F.lit("</p>"), quote, *(F.lit(f"<button>{b}</button>") for b in ("Reply", "Edit", "Delete")), F.lit("</article>"))


#: Field kinds and their HTML controls.
CONTROLS = {"Text": "input", "MultilineText": "textarea", "CheckBox": "input", "ComboBox": "select", "ListBox": "select", "PushButton": "button"}


def control_html() -> Column:
    """A form control with its label and state. Columns: element_id, field_kind, label, value, required, read_only, invalid, unlabelled."""
    c = F.col
    name = F.coalesce(F.try_element_at(T.mapping(CONTROLS), c("field_kind")), F.lit("input"))
    type_ = F.when(c("field_kind") == "CheckBox", ' type="checkbox"').when(c("field_kind") == "Text", ' type="text"').otherwise("")
    state = F.concat(F.when(c("required"), " required").otherwise(""), F.when(c("read_only"), " readonly").otherwise(""), F.when(c("invalid"), ' aria-invalid="true"').otherwise(""))
    value = F.when(c("field_kind") == "Text", F.concat(F.lit(' value="'), T.html_escape("value"), F.lit('"'))).otherwise("")
    id_ = F.concat(F.lit("e"), c("element_id").cast("string"))
    tail = F.when(name == "input", "").otherwise(F.concat(T.html_escape("value"), F.lit("</"), name, F.lit(">")))
    warn = F.when(c("unlabelled"), "<p>This field has no label.</p>").otherwise("")
    return F.concat(F.lit('<label for="'), id_, F.lit('">'), T.html_escape("label"), F.lit("</label><"), name, F.lit(' id="'), id_, F.lit('"'), type_, state, value, F.lit(">"), tail, warn)


def text_line(mode: str) -> Column:
    """The line of an element in a reading mode (Structured, Layout or Raw); null where it has none. Columns: kind, level, text, alt, decorative, artifact_type."""
    c = F.col
    text = F.trim(F.coalesce("text", F.lit("")))
    some = F.nullif(text, F.lit(""))
    if mode == "Raw":
        return F.when(~c("kind").isin("Document", "Page", "Section", "TableRow", "Table", "List", "Artifact"), some)
    around = lambda a, b: F.concat(F.lit(a), text, F.lit(b))
    figure = F.when(c("decorative"), "[Decorative image]").when(~T.blank("alt"), F.concat(F.lit("[Image: "), c("alt"), F.lit("]"))).otherwise("[Image with no description]")
    k = c("kind")
    return (
        F.when(k.isin("Document", "Page", "Section"), F.lit(None).cast("string"))
        .when(k == "Artifact", F.concat(F.lit("["), c("artifact_type"), F.lit(": "), text, F.lit("]")) if mode == "Layout" else F.lit(None).cast("string")).when(k == "Figure", figure).when(some.isNull(), F.lit(None).cast("string"))
        .when(k == "Heading", F.concat(F.lit("Heading "), F.coalesce("level", F.lit(0)).cast("string"), F.lit(": "), text)).when(k == "ListItem", around("  • ", "")).when(k == "Link", around("[Link: ", "]"))
        .when(k == "Caption", around("Caption: ", "")).when(k == "BlockQuote", around("Quote: ", "")).when(k == "Annotation", around("[comment: ", "]")).otherwise(text)
    )


def full_line(mode: str) -> Column:
    """X2 for elements of all kinds: as text_line, with tables, lists, cells, fields and links that have no text of their own. Further columns: target, rows, columns, has_header, items, label, required, read_only, value, has_value."""
    if mode == "Raw":
        return text_line(mode)
    c, k = F.col, F.col("kind")
    n = lambda name, one: F.concat(c(name).cast("string"), F.when(c(name) == 1, f" {one}").otherwise(f" {one}s"))
    table = F.concat(F.lit("Table: "), n("rows", "row"), F.lit(", "), n("columns", "column"), F.when(c("has_header"), "").otherwise(", no header cells"))
    field = F.concat(F.lit("[form field: "), F.concat_ws(", ", "label", F.when(c("required"), "required"), F.when(c("has_value"), c("value")).otherwise("not filled in"), F.when(c("read_only"), "read-only")), F.lit("]"))
    return (
        F.when(k == "Table", table).when(k == "List", F.concat(F.lit("List of "), n("items", "item"))).when(k == "TableCell", F.concat(F.lit("    "), F.when(T.blank("text"), "(blank)").otherwise(F.trim("text"))))
        .when(k == "FormField", field).when((k == "Link") & T.blank("text"), F.concat(F.lit("[Link: "), F.coalesce("target", F.lit("")), F.lit("]"))).otherwise(text_line(mode))
    )


#: Columns with which tables, lists, cells and fields have lines of their own.
FULL = {"target", "rows", "columns", "has_header", "items", "label", "required", "read_only", "value", "has_value"}


def linear_text(elements: DataFrame, mode: str = "Structured") -> DataFrame:
    """doc_id, reading_order, start, length, line: lines with a rule where the page rises, and each line's place in the whole text.

    Elements with the columns of FULL get the lines of full_line, others those of text_line. Lines are parted by two line breaks of two characters. The text of a document is the lines and rules in order.
    """
    w = Window.partitionBy("doc_id").orderBy("reading_order")
    e = elements.withColumn("line", full_line(mode) if FULL <= set(elements.columns) else text_line(mode)).filter("line IS NOT NULL")
    before = F.max("page_no").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rise = (F.col("page_no") > F.coalesce(before, F.lit(0))) & (F.col("page_no") > 0) & F.lit(mode != "Raw")
    rule = F.when(rise, F.concat(F.lit("--- Page "), F.col("page_no").cast("string"), F.lit(" ---\r\n\r\n"))).otherwise("")
    first = F.row_number().over(w) == 1
    gap = F.when(first, "").when(rule != "", "\r\n").otherwise("")
    # A rule ends in a gap of its own; other lines are parted from the text before.
    lead = F.concat(gap, rule, F.when((F.length(F.concat(gap, rule)) > 0) | ~first, F.lit("\r\n\r\n")).otherwise(""))
    e = e.withColumn("lead", F.length(lead)).withColumn("size", F.col("lead") + F.length("line"))
    end = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return e.select("doc_id", "reading_order", (end - F.length("line")).alias("start"), F.length("line").alias("length"), "line")


def row_lines(cells: DataFrame) -> DataFrame:
    """A table row as a line. cells: table_id, row_no, cell_ord, text, role."""
    text = F.when(T.blank("text"), "(blank)").otherwise(F.col("text"))
    g = cells.groupBy("table_id", "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell_ord", text.alias("x")))), lambda s: s["x"]), "  |  ").alias("t"), F.bool_and(F.col("role") != "Data").alias("h"))
    return g.select("table_id", "row_no", F.concat(F.when(F.col("h"), "  Headings: ").otherwise("  "), F.col("t")).alias("line"))


def publish(df: DataFrame, path: str, check) -> str:
    """Write, audit, publish. Rows go to a staging folder; only if check(written) holds does it take the place of what was there, which is kept as a backup until then."""
    spark = df.sparkSession
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    staging, backup = jvm.org.apache.hadoop.fs.Path(path + ".staging"), jvm.org.apache.hadoop.fs.Path(path + ".backup")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(staging, True)
    df.write.parquet(path + ".staging")
    if not check(spark.read.parquet(path + ".staging")):
        fs.delete(staging, True)
        return "refused"
    fs.delete(backup, True)
    if fs.exists(target):
        fs.rename(target, backup)
    if not fs.rename(staging, target):
        if fs.exists(backup):
            fs.rename(backup, target)
        return "failed"
    fs.delete(backup, True)
    return "saved"
