"""K1: a document's tree as one semantic HTML document, with its tables, lists, links, forms and comments.

An element is an opening and a closing at places of one order: it opens at its element_id and closes behind last_id, the inner ones first. So markup of any depth is one sort by document, without paths or a stack, and it is given in chunks of
CHUNK openings and closings: no aggregate holds a document. What an element opens and closes with is SQL that reads its own row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.runtime import dealt, ship

CHUNK = 256
#: Characters of markup after which a task gives out what it has.
FLUSH = 2_000_000
#: Places before and behind all elements.
FIRST, LAST = -1, (1 << 31) - 1
POLICY = "<meta http-equiv=\"Content-Security-Policy\" content=\"default-src 'none'; img-src data:\">"


def quoted(text: str) -> str:
    """A text as SQL of either engine."""
    parts = [f"'{p}'" for p in text.split("'")]
    return parts[0] if len(parts) == 1 else "concat(" + ", chr(39), ".join(parts) + ")"


def duck(expression: str) -> str:
    """The same expression for DuckDB."""
    return expression.replace(" AS STRING)", " AS VARCHAR)")


def escaped(x: str) -> str:
    """T19 as SQL."""
    out = f"coalesce({x}, '')"
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = f"replace({out}, '{raw}', '{safe}')"
    return f"replace({out}, chr(39), '&#39;')"


def joined(*parts: str) -> str:
    """Texts of SQL put together; none may be null."""
    return "concat(" + ", ".join(parts) + ")"


_ID = joined("' id=\"e'", "CAST(element_id AS STRING)", "'\"'")
_TAB = joined(_ID, "' tabindex=\"-1\"'", f"CASE WHEN trim(coalesce(lang, '')) <> '' AND kind <> 'Document' THEN {joined(quoted(' lang=' + chr(34)), escaped('lang'), quoted(chr(34)))} ELSE '' END")
_HEAD = "concat('h', CAST(coalesce(level, 2) AS STRING))"
_ORDERED = "tag = 'ol'"
_ORPHAN = "coalesce(parent_tag, '') NOT IN ('ul', 'ol', 'menu')"
_NAMED = "source IN ('own')"
_LABEL = f"CASE WHEN {_NAMED} THEN '' ELSE {joined(quoted('<label for=' + chr(34) + 'e'), 'CAST(element_id AS STRING)', quoted(chr(34) + '>'), escaped('label'), 'CASE WHEN source = ' + quoted('none') + ' THEN ' + quoted(' <span class=warn>(this field has no label in the document)</span>') + ' ELSE ' + quoted('') + ' END', quoted('</label>'))} END"
_STATE = joined(
    "CASE WHEN required THEN ' required aria-required=\"true\"' ELSE '' END", "CASE WHEN read_only THEN ' readonly aria-readonly=\"true\"' ELSE '' END", "CASE WHEN invalid THEN ' aria-invalid=\"true\"' ELSE '' END",
    f"CASE WHEN trim(coalesce(guidance, '')) <> '' THEN {joined(quoted(' title=' + chr(34)), escaped('guidance'), quoted(chr(34)))} ELSE '' END",
)
_BUTTON = joined("'<button type=\"button\" class=\"act\"'", _ID, "CASE WHEN disabled THEN ' disabled' ELSE '' END", "'>'", escaped("coalesce(nullif(trim(text), ''), nullif(trim(value), ''), label)"))
_CONTROL = f"""CASE WHEN field_kind = 'PushButton' THEN {_BUTTON} WHEN field_kind = 'CheckBox' THEN {joined("'<input type=\"checkbox\"'", _ID, _STATE, "CASE WHEN checked THEN ' checked' ELSE '' END", "'>'", _LABEL)}
WHEN field_kind = 'RadioGroup' THEN {joined("'<input type=\"radio\"'", _ID, "' name=\"g'", escaped("name"), "'\" data-value=\"'", escaped("value"), "'\"'", "CASE WHEN read_only THEN ' disabled' ELSE '' END", "CASE WHEN checked THEN ' checked' ELSE '' END", "'>'", _LABEL)}
WHEN field_kind = 'ChoiceList' THEN {joined(_LABEL, "'<select'", _ID, _STATE, "CASE WHEN several THEN ' multiple size=\"4\">' ELSE '><option value=\"\">(not filled in)</option>' END")}
WHEN tag = 'textarea' THEN {joined(_LABEL, "'<textarea'", _ID, _STATE, "' rows=\"4\">'", escaped("text"))} ELSE {joined(_LABEL, "'<input type=\"text\"'", _ID, _STATE, "' value=\"'", escaped("value"), "'\">'")} END"""
_SCOPE = "CASE WHEN role = 'RowHeader' THEN 'row' WHEN role = 'ColumnHeader' OR row_place = 'head' THEN 'col' ELSE 'row' END"
_SPANS = joined("CASE WHEN col_span > 1 THEN concat(' colspan=\"', CAST(col_span AS STRING), '\"') ELSE '' END", "CASE WHEN row_span > 1 THEN concat(' rowspan=\"', CAST(row_span AS STRING), '\"') ELSE '' END")
_TAGS = {"Paragraph": "p", "BlockQuote": "blockquote", "Section": "section"}

#: What elements open with (H1 to H4, H5 to H8, H10, H11). Columns: those of rows().
OPEN = f"""CASE kind WHEN 'Heading' THEN {joined("'<'", _HEAD, _TAB, "'>'")} WHEN 'List' THEN {joined(f"CASE WHEN {_ORDERED} THEN '<ol' ELSE '<ul' END", _TAB, f"CASE WHEN {_ORDERED} THEN concat(' type=\"', CASE WHEN kind_of IN ('a', 'A', 'i', 'I') THEN kind_of ELSE '1' END, '\"') ELSE '' END", "'>'")}
WHEN 'ListItem' THEN {joined(f"CASE WHEN {_ORPHAN} THEN '<ul>' ELSE '' END", "'<li'", _TAB, "'>'")} WHEN 'Table' THEN {joined("'<table'", _TAB, "'>'")}
WHEN 'TableRow' THEN {joined("CASE row_place WHEN 'head' THEN '<thead>' WHEN 'first' THEN '<tbody>' ELSE '' END", "'<tr'", _TAB, "'>'")}
WHEN 'TableCell' THEN CASE WHEN role <> 'Data' THEN {joined("'<th'", _TAB, "' scope=\"'", _SCOPE, "'\"'", _SPANS, "'>'")} ELSE {joined("'<td'", _TAB, _SPANS, "'>'")} END
WHEN 'Caption' THEN CASE WHEN tag = 'caption' THEN {joined("'<caption'", _TAB, "'>'")} ELSE {joined("'<p class=\"caption\"'", _TAB, "'>'")} END WHEN 'Code' THEN {joined("'<pre'", _TAB, "'><code>'")}
WHEN 'Figure' THEN CASE WHEN decorative THEN {joined("'<img src=\"data:,\" alt=\"\" role=\"presentation\"'", _TAB, "'>'")} WHEN trim(coalesce(alt, '')) <> '' THEN {joined("'<img src=\"data:,\" alt=\"'", escaped("alt"), "'\"'", _TAB, "'>'")}
ELSE {joined("'<button type=\"button\" class=\"fix\"'", _ID, "' data-act=\"describe\">Image with no description. Activate to describe it.</button>'")} END
WHEN 'Link' THEN {joined("'<a'", _ID, "' href=\"'", escaped("href"), "'\">'", f"CASE WHEN trim(text) = '' THEN {escaped('href')} ELSE '' END")} WHEN 'Label' THEN {joined("'<label'", _ID, "CASE WHEN for_field IS NOT NULL THEN concat(' for=\"e', CAST(for_field AS STRING), '\"') ELSE '' END", "'>'")}
WHEN 'FormField' THEN {_CONTROL} WHEN 'Option' THEN {joined("'<option value=\"'", escaped("coalesce(value, text)"), "'\"'", "CASE WHEN selected THEN ' selected' ELSE '' END", "'>'", escaped("text"))} WHEN 'Run' THEN {escaped("text")}
{" ".join(f"WHEN '{k}' THEN {joined(quoted('<' + t), _TAB, quoted('>'), f'CASE WHEN tag = {quoted(chr(35) + "text")} THEN {escaped("text")} ELSE {quoted("")} END')}" for k, t in _TAGS.items())} ELSE '' END"""
CLOSE = f"""CASE kind WHEN 'Heading' THEN {joined("'</'", _HEAD, "'>'")} WHEN 'List' THEN CASE WHEN {_ORDERED} THEN '</ol>' ELSE '</ul>' END WHEN 'ListItem' THEN {joined("'</li>'", f"CASE WHEN {_ORPHAN} THEN '</ul>' ELSE '' END")}
WHEN 'Table' THEN CASE WHEN has_rows THEN '</tbody></table>' ELSE '</table>' END WHEN 'TableRow' THEN CASE WHEN row_place = 'head' THEN '</tr></thead><tbody>' ELSE '</tr>' END WHEN 'TableCell' THEN CASE WHEN role <> 'Data' THEN '</th>' ELSE '</td>' END
WHEN 'Caption' THEN CASE WHEN tag = 'caption' THEN '</caption>' ELSE '</p>' END WHEN 'Code' THEN '</code></pre>' WHEN 'Link' THEN {joined("'</a>'", f"CASE WHEN trim(text) <> '' AND href LIKE '%:%' AND text <> href THEN {joined(quoted(' ('), escaped('href'), quoted(')'))} ELSE '' END")} WHEN 'Label' THEN '</label>'
WHEN 'FormField' THEN CASE WHEN field_kind = 'PushButton' THEN '</button>' WHEN field_kind = 'ChoiceList' THEN '</select>' WHEN tag = 'textarea' THEN '</textarea>' ELSE '' END WHEN 'Option' THEN '</option>'
{" ".join(f"WHEN '{k}' THEN '</{t}>'" for k, t in _TAGS.items())} ELSE '' END"""
#: What stands around it all (H12, H1). Columns: doc_id, title, lang.
HEAD = joined(
    "'<!DOCTYPE html><html lang=\"'", escaped("coalesce(nullif(trim(lang), ''), 'en')"), quoted('"><head><meta charset="utf-8">' + POLICY + "<title>"), escaped("coalesce(nullif(trim(title), ''), concat('page ', CAST(doc_id AS STRING)))"), quoted('</title></head><body><main><section aria-label="Page 1">')
)
FOOT = "'</section></main></body></html>'"


def own_columns(tree: DataFrame, *more: str) -> DataFrame:
    """The columns of markup that an element's own row tells. tree: as markup.page_tree gives it, runs included. more: further columns to be kept."""
    a = lambda name: F.try_element_at("attrs", F.lit(name))
    has = lambda name: a(name).isNotNull()
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    k = F.col("kind")
    type_ = F.lower(F.coalesce(F.nullif(a("type"), F.lit("")), F.when(F.col("tag") == "button", "button").otherwise("text")))
    named, near, partial = F.coalesce(some(a("aria-label")), some(a("title"))), some(T.tidy_label(a("#before"))), a("name")
    source = F.when(some(a("#label")).isNotNull(), "own").otherwise(T.label_source(named, near, partial))
    return tree.select(
        "doc_id", "element_id", "last_id", "parent_id", "tag", "kind", "text", "parent_tag", F.when(k == "Heading", F.substring("tag", 2, 1).cast("int")).alias("level"), a("lang").alias("lang"), a("href").alias("href"), a("alt").alias("alt"), F.coalesce(a("alt") == "", F.lit(False)).alias("decorative"),
        a("type").alias("kind_of"), a("name").alias("name"), a("value").alias("value"), has("required").alias("required"), (has("readonly") | has("disabled")).alias("read_only"), has("disabled").alias("disabled"), has("checked").alias("checked"), has("selected").alias("selected"), has("multiple").alias("several"),
        F.coalesce(a("aria-invalid") == "true", F.lit(False)).alias("invalid"), a("placeholder").alias("guidance"), F.coalesce(a("colspan").try_cast("int"), F.lit(1)).alias("col_span"), F.coalesce(a("rowspan").try_cast("int"), F.lit(1)).alias("row_span"),
        F.when(F.col("tag") == "td", "Data").when(a("scope") == "row", "RowHeader").when(a("scope") == "col", "ColumnHeader").otherwise("Header").alias("role"),
        F.when(F.col("tag") == "select", "ChoiceList").when(type_.isin("submit", "button", "reset", "image"), "PushButton").when(type_ == "checkbox", "CheckBox").when(type_ == "radio", "RadioGroup").otherwise("Text").alias("field_kind"),
        source.alias("source"), T.label(named, near, partial).alias("label"), a("#table").try_cast("int").alias("table_id"), a("id").alias("id"), a("for").alias("for"), *more,
    )


def rows(tree: DataFrame) -> DataFrame:
    """The columns that markup is made of. tree: as markup.page_tree gives it, runs included."""
    k = F.col("kind")
    t = own_columns(tree)
    # A row is a head if all its cells are headers and it is its table's first; both need one small grouping of the cells.
    by_row = t.filter((k == "TableCell") & (F.col("parent_tag") == "tr")).groupBy("doc_id", "table_id", F.col("parent_id").alias("row_id")).agg(F.bool_and(F.col("role") != "Data").alias("all_heads"))
    first = F.min("row_id").over(Window.partitionBy("doc_id", "table_id")) == F.col("row_id")
    by_row = by_row.select("doc_id", "table_id", "row_id", F.when(first, F.when(F.col("all_heads"), "head").otherwise("first")).otherwise("other").alias("row_place"))
    tables = by_row.select("doc_id", F.col("table_id").alias("row_id")).distinct().withColumn("has_rows", F.lit(True))
    fields = t.filter((k == "FormField") & (F.col("id") != "")).groupBy("doc_id", F.col("id").alias("for")).agg(F.min("element_id").alias("for_field"))
    of = F.when(k == "TableCell", F.col("parent_id")).when(k == "TableRow", F.col("element_id"))
    t = t.drop("table_id").withColumn("row_id", of).join(dealt(by_row.drop("table_id")), ["doc_id", "row_id"], "left").drop("row_id")
    t = t.withColumn("row_id", F.when(k == "Table", F.col("element_id"))).join(dealt(tables), ["doc_id", "row_id"], "left").drop("row_id")
    t = t.withColumn("for", F.when(k == "Label", F.col("for"))).join(dealt(fields), ["doc_id", "for"], "left")
    return t.na.fill({"has_rows": False})


def serialised(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, chunk_no, html of events (doc_id, place, phase, nth, markup) in that order; one exchange."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "phase", "nth"))
    e = events.withColumn("_n", n)
    parts = F.array_sort(F.collect_list(F.struct("_n", "markup")))
    g = e.groupBy("doc_id", F.floor((F.col("_n") - 1) / chunk).cast("int").alias("chunk_no")).agg(parts.alias("p"))
    return g.select("doc_id", "chunk_no", F.array_join(F.transform("p", lambda x: x["markup"]), "").alias("html"))


def html_of(tree: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """K1: chunks of each document's HTML, to be put together in the order of chunk_no."""
    t = rows(tree).withColumn("_open", F.expr(OPEN)).withColumn("_close", F.expr(CLOSE))
    event = lambda place, phase, nth, text: F.struct(place.cast("int").alias("place"), F.lit(phase).alias("phase"), nth.cast("int").alias("nth"), text.alias("markup"))
    both = F.array(event(F.col("element_id"), 0, F.lit(0), F.col("_open")), event(F.col("last_id"), 1, -F.col("element_id"), F.col("_close")))
    inner = t.select("doc_id", F.inline(F.filter(both, lambda x: x["markup"] != "")))
    title = F.min(F.when(F.col("kind") == "Title", F.struct("element_id", "text")))["text"]
    around = tree.groupBy("doc_id").agg(title.alias("title"), F.max(F.when(F.col("tag") == "html", F.try_element_at("attrs", F.lit("lang")))).alias("lang"))
    ends = around.select("doc_id", F.inline(F.array(event(F.lit(FIRST), 0, F.lit(0), F.expr(HEAD)), event(F.lit(LAST), 1, F.lit(0), F.expr(FOOT)))))
    return serialised(inner.unionByName(ends), chunk)


#: What placed() gives, with its types.
PLACED = "element_id int, last_id int, parent_id int, tag string, kind string, attrs map<string,string>, text string, parent_tag string, row_place string, has_rows boolean, for_field int"


def placed(tree: Sequence[Sequence]) -> list[tuple]:
    """A page's rows (those of markup.tree) with what their markup takes from other rows, behind one of the page itself (kind #page) that has its title as text and its language."""
    if not tree:
        return []
    titles, langs, heads, tables, fields = [], [], {}, {}, {}
    for element, parent, _, _, _, tag, kind, attrs, text, parent_tag in tree:
        if kind == "TableCell":
            if parent_tag == "tr":
                table = attrs["#table"]
                heads[parent] = heads.get(parent, True) and tag != "td"
                tables[table] = min(tables.get(table, parent), parent)
        elif kind == "FormField":
            if attrs.get("id"):
                fields.setdefault(attrs["id"], element)
        elif kind == "Title":
            titles.append(text)
        elif tag == "html" and "lang" in attrs:
            langs.append(attrs["lang"])
    firsts, with_rows = set(tables.values()), {int(t) for t in tables if t}
    out = [(FIRST, LAST, None, "", "#page", {"lang": max(langs)} if langs else {}, titles[0] if titles else None, None, None, False, None)]
    for element, parent, _, last, _, tag, kind, attrs, text, parent_tag in tree:
        row = parent if kind == "TableCell" else element if kind == "TableRow" else None
        place = None if row not in heads else "other" if row not in firsts else "head" if heads[row] else "first"
        out.append((element, last, parent, tag, kind, attrs, text, parent_tag, place, kind == "Table" and element in with_rows, fields.get(attrs.get("for")) if kind == "Label" else None))
    return out


def html_of_placed(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """K1 of pages as placed() gives them, whose rows come together and in order: the same chunks without an exchange. Openings and closings stream past a stack of the elements that are open; a task holds these and one chunk."""
    ship(rows.sparkSession)
    page = F.col("kind") == "#page"
    t = own_columns(rows, "row_place", "has_rows", "for_field").withColumn("title", F.col("text"))
    t = t.select("doc_id", "element_id", "last_id", F.when(page, F.expr(HEAD)).otherwise(F.expr(OPEN)).alias("open"), F.when(page, F.expr(FOOT)).otherwise(F.expr(CLOSE)).alias("close"))

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, str]]:
        now, stack = None, []
        for batch in batches:
            for doc, element, last, opening, closing in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                while stack and (element == FIRST or stack[-1][0] < element):
                    yield now, False, stack.pop()[1]
                now = doc
                if opening:
                    yield doc, element == FIRST, opening
                if closing:
                    stack.append((last, closing))
        while stack:
            yield now, False, stack.pop()[1]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str]]:
        now, nth, parts = None, 0, []
        for doc, first, markup in events(batches):
            if parts and (first or len(parts) == chunk):
                yield now, nth, "".join(parts)
                nth, parts = nth + 1, []
            if first:
                now, nth = doc, 0
            parts.append(markup)
        if parts:
            yield now, nth, "".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)], ["doc_id", "chunk_no", "html"])
        out, size = [], 0
        for row in chunks(batches):
            out.append(row)
            size += len(row[2])
            if size >= FLUSH:
                yield packed(out)
                out, size = [], 0
        if out:
            yield packed(out)

    return t.mapInArrow(run, "doc_id long, chunk_no int, html string")


#: A comment with what it is about and what can be done, without its end: replies stand inside (H9). Columns: element_id, author, text, anchored.
COMMENT = joined(
    "'<aside class=\"comment\"'", _ID, "' tabindex=\"-1\" aria-label=\"Comment\"><p>'", f"CASE WHEN trim(coalesce(author, '')) <> '' THEN {joined(escaped('author'), quoted(': '))} ELSE '' END", escaped("text"), "'</p>'",
    f"CASE WHEN trim(coalesce(anchored, '')) <> '' THEN {joined(quoted('<p class=' + chr(34) + 'quoted' + chr(34) + '>On the text: '), escaped('anchored'), quoted('</p>'))} ELSE '' END", "'<p class=\"actions\">'",
    *(joined(f"'<button type=\"button\" class=\"act\" data-el=\"'", "CAST(element_id AS STRING)", f"'\" data-act=\"{act}\">{said}</button>'") for act, said in (("editComment", "Change this comment"), ("replyComment", "Reply to this comment"), ("deleteComment", "Delete this comment"))), "'</p>'",
)


def threads_html(walked: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """H9: comment threads with replies inside what they answer, to any depth. walked: tree.paths of doc_id, element_id, parent_id, author, text, anchored."""
    event = lambda place, phase, nth, text: F.struct(place.cast("int").alias("place"), F.lit(phase).alias("phase"), nth.cast("int").alias("nth"), text.alias("markup"))
    order = F.col("reading_order")
    return serialised(walked.select("doc_id", F.inline(F.array(event(order, 0, F.lit(0), F.expr(COMMENT)), event(F.col("last_order"), 1, -order, F.lit("</aside>"))))), chunk)
