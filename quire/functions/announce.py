"""What is said about elements and documents, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blank, mapping, truncate, vague_link

#: Names of lists by marker, and what a document's tagging is called.
LIST_NAMES = {"Bullet": "bulleted list", "Decimal": "numbered list", "LowerAlpha": "lettered list", "UpperAlpha": "lettered list", "LowerRoman": "roman numeral list", "UpperRoman": "roman numeral list"}
STATUS = {"FullyTagged": "tagged", "PartiallyTagged": "partly tagged", "Untagged": "untagged", "ScannedWithoutText": "scanned, no text"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def plural(n: Column | str, one: str, many: str | None = None) -> Column:
    return F.concat(_c(n).cast("string"), F.when(_c(n) == 1, f" {one}").otherwise(f" {many or one + 's'}"))


def kind_parts() -> Column:
    """Role and content by kind. Columns: kind, level, n, total, text, alt, decorative, marker, author."""
    c, k = F.col, F.col("kind")
    heading = F.concat_ws(", ", F.when(c("level").isNull(), "heading").otherwise(F.concat(F.lit("heading level "), c("level").cast("string"))), "text")
    list_ = F.concat(F.coalesce(F.try_element_at(mapping(LIST_NAMES), c("marker")), F.lit("list")), F.lit(", "), F.when(c("total") == 0, "empty").otherwise(F.concat(F.lit("with "), plural("total", "item"))))
    figure = F.when(c("decorative"), "decorative image").when(~blank("alt"), F.concat(F.lit("figure, "), c("alt"))).otherwise("figure, no description available")
    comment = F.concat_ws(", ", F.lit("comment"), F.when(c("author").isNotNull(), F.concat(F.lit("by "), c("author"))), "text", F.when(c("total") > 0, plural("total", "reply", "replies")))
    return (
        F.when(k == "Heading", heading).when(k == "List", list_).when(k == "ListItem", F.concat(F.lit("item "), c("n").cast("string"), F.lit(" of "), c("total").cast("string"), F.lit(", "), c("text")))
        .when(k == "Table", F.concat_ws(", ", F.lit("table"), plural("n", "row"), plural("total", "column"))).when(k == "Figure", figure).when(k == "Annotation", comment)
        .when(k == "Page", F.concat(F.lit("page "), c("n").cast("string"))).otherwise(c("text"))
    )


def _some(x: Column | str) -> Column:
    return F.nullif(F.coalesce(_c(x), F.lit("")), F.lit(""))


def content(verbosity: str) -> Column:
    """What an element of each kind says, before its state. Columns: kind, text, and of the kinds that have them alt, caption, decorative; description, target; author, anchored; file_name, size_text; items; rows,
    columns, summary, has_header, role, row_header, column_header; label, value, button_caption."""
    c, full = F.col, verbosity != "Terse"
    figure = F.when(c("decorative"), "").otherwise(F.coalesce(F.when(~blank("alt"), c("alt")), F.concat(F.lit("no description. Caption reads: "), _some("caption")), F.lit("no description available")))
    to = F.when(_some("text").isNull(), c("target")).when(~vague_link("text"), c("text")).otherwise(F.concat(c("text"), F.lit(", to "), c("target")))
    by, over = (F.concat(F.lit("by "), _some("author")) if full else F.lit(None).cast("string")), F.concat(F.lit("over "), truncate(_some("anchored"), 60))
    comment = F.concat_ws(", ", by, over, F.coalesce(truncate(_some("text"), 120), F.when(by.isNull() & over.isNull(), "no text")))
    items = F.when(c("items") == 0, "empty").otherwise(F.concat(F.lit("with "), plural("items", "item")))
    table = F.concat_ws(". ", F.concat_ws(", ", plural("rows", "row"), plural("columns", "column")), _some("summary"))
    value = F.coalesce(_some("text"), F.lit("blank"))
    cell = F.when((F.coalesce("role", F.lit("Data")) == "Data") & c("has_header"), F.concat_ws(", ", _some("row_header"), _some("column_header"), value)).otherwise(value) if full else value
    k = c("kind")
    return (
        F.when(k == "Figure", figure).when(k == "Link", F.coalesce(_some("description"), to)).when(k == "Annotation", comment).when(k == "Attachment", F.concat_ws(", ", "file_name", _some("description"), *(["size_text"] if full else [])))
        .when(k == "List", items).when(k == "Table", table).when(k == "TableCell", cell).when(k == "Button", F.coalesce(F.nullif(F.trim("button_caption"), F.lit("")), c("label"))).when(k == "FormField", F.concat_ws(", ", "label", _some("value"))).otherwise(F.coalesce("text", F.lit("")))
    )


def state(verbosity: str) -> Column:
    """An element's state. Columns besides those of content: tiny, hint, replies, unsaved, nested_items, column_span, row_span, required, read_only, invalid, label_source, modified, guidance, action, signed."""
    c, full, detailed = F.col, verbosity != "Terse", verbosity == "Detailed"
    if_ = lambda test, text, on=True: F.when(test, text) if on else F.lit(None).cast("string")
    hint = _some("hint") if detailed else F.lit(None).cast("string")
    sources = {"none": "this field has no label in the document", "nearby": "label guessed from the page", "name": "label taken from the field's internal name"}
    field = F.concat_ws(
        ", ", if_(c("required"), "required"), if_(c("read_only"), "read-only"), if_(c("invalid"), "invalid entry"), F.try_element_at(mapping(sources), c("label_source")) if detailed else F.lit(None).cast("string"),
        if_(c("modified"), "changed"), _some("guidance") if detailed else F.lit(None).cast("string"),
    )
    k = c("kind")
    figure = if_(~c("decorative") & blank("alt") & ~c("tiny"), "needs a description", full)
    link = F.concat_ws(", ", if_(vague_link("text") & c("description").isNull(), "link text does not describe its destination", full), hint)
    comment = F.concat_ws(", ", if_(c("replies") > 0, plural("replies", "reply", "replies")), if_(c("unsaved"), "not saved"), hint)
    cell = F.concat_ws(", ", if_(c("column_span") > 1, F.concat(F.lit("spans "), c("column_span").cast("string"), F.lit(" columns")), full), if_(c("row_span") > 1, F.concat(F.lit("spans "), c("row_span").cast("string"), F.lit(" rows")), full))
    item = if_(c("nested_items").isNotNull(), F.concat(F.lit("contains a list of "), c("nested_items").cast("string"), F.lit(" items")), full)
    out = (
        F.when(k == "Figure", figure).when(k == "Link", link).when(k == "Annotation", comment).when(k == "ListItem", item).when(k == "Table", if_(~c("has_header"), "no header cells, so cells cannot be announced with their headings", full)).when(k == "TableCell", cell)
        .when(k == "Button", F.concat_ws(", ", F.concat(F.lit("will "), _some("action")) if full else F.lit(None).cast("string"), _some(field))).when(k == "FormField", F.concat_ws(", ", if_(c("signed"), "signature not verified by this editor", detailed), _some(field)))
    )
    return F.coalesce(out, F.lit(""))


def value_in_speech() -> Column:
    """T27 for fields other than text. Columns: field_kind, checked, option (its words), position, options, chosen (words of all chosen ones), typed, signed, signer, signed_on, reason."""
    c, k = F.col, F.col("field_kind")
    n = c("options").cast("string")
    none = F.concat(F.lit("nothing selected, "), n, F.lit(" options"))
    one = F.concat(c("option"), F.lit(", "), c("position").cast("string"), F.lit(" of "), n)
    many = F.concat(F.size("chosen").cast("string"), F.lit(" of "), n, F.lit(" selected: "), F.array_join("chosen", ", "))
    choice = F.when(_some("typed").isNotNull(), F.concat(c("typed"), F.lit(", typed in"))).when(F.size("chosen") == 0, none).when(F.size("chosen") == 1, one).otherwise(many)
    said = F.concat_ws(", ", F.lit("signed"), F.concat(F.lit("by "), _some("signer")), F.concat(F.lit("on "), F.date_format("signed_on", "d MMMM yyyy")), F.concat(F.lit("reason: "), _some("reason")))
    return (
        F.when(k == "CheckBox", F.when(c("checked"), "checked").otherwise("not checked")).when(k == "RadioGroup", F.when(c("option").isNull(), none).otherwise(one)).when(k == "Choice", choice)
        .when(k == "Signature", F.when(c("signed"), said).otherwise("not signed")).otherwise("")
    )


def opening() -> Column:
    """T28. Columns: name, pages, status, fields, open_fields, headings, comments."""
    c = F.col
    fields = F.when(c("fields") > 0, F.concat(c("fields").cast("string"), F.lit(" form fields"), F.when(c("open_fields") > 0, F.concat(F.lit(", "), c("open_fields").cast("string"), F.lit(" still to fill in"))).otherwise("")))
    status = F.coalesce(F.try_element_at(mapping(STATUS), c("status")), F.lit("unknown structure"))
    heads = F.when(c("headings") > 0, F.concat(c("headings").cast("string"), F.lit(" headings")))
    return F.concat(F.concat_ws(". ", "name", plural("pages", "page"), status, fields, heads, F.when(c("comments") > 0, plural("comments", "comment"))), F.lit("."))


def form_line(label: Column | str, value: Column, attention: Column) -> Column:
    """T34."""
    return F.concat(F.when(attention, "* ").otherwise("  "), _c(label), F.lit(": "), value)


def note_count(n: Column | str) -> Column:
    """T35."""
    return F.when(_c(n) == 0, "saved").otherwise(F.concat(F.lit("saved, "), plural(n, "thing to note", "things to note")))


def tag_sentence(items: Column | str, pages: Column | str, share: Column) -> Column:
    """What tagging did; short of the coverage that is needed it says how far it came."""
    done = F.concat(F.lit("tagged "), _c(items).cast("string"), F.lit(" items"))
    return F.when(_c(items) == 0, "nothing to tag").when(share >= 0.66, F.concat(done, F.lit(" on "), plural(pages, "page"))).otherwise(F.concat(done, F.lit(", only "), F.bround(share * 100, 0).cast("int").cast("string"), F.lit(" percent of the text")))


def comment_box() -> dict[str, Column]:
    """Notes get a square of 20 points at the top left of what they are about; other comments its rectangle."""
    note = F.col("kind").isin("Comment", "FreeText", "FileAttachment")
    return {"l": F.col("l"), "b": F.when(note, F.col("t") - 20).otherwise(F.col("b")), "r": F.when(note, F.col("l") + 20).otherwise(F.col("r")), "t": F.col("t")}


def properties(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """One row a property."""
    pairs = F.array(*(F.struct(F.lit(k).alias("label"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("(none)")).alias("value")) for k, c in labels.items()))
    return df.select("doc_id", F.inline(pairs))


def all_of(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))
