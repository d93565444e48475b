"""HTML pages to element trees, in one pass over each page with a stack of open elements and no exchange.

Elements have an element_id that ascends in document order, and last_id, the highest one below them: an element holds exactly those from element_id to last_id, so ancestors and ranges need no paths. Ends that markup leaves out (of p, li,
td, tr, option and so on) are implied; inline tags such as b and span are no elements. Every run of text that isn't blank is in some element: in the nearest one that holds text and the link or label around it, in the artifact around it,
or, where it stands loose in a container, in a paragraph of its own. Runs are rows too (kind Run), so that markup can be written again in the same order.

Among the attributes are three that are found out: ``#label`` and ``#before`` of a form field (the text of its label, by id or around it, and the text just before it), and ``#table`` of a cell (its table's element_id).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import ship

#: Element kinds of HTML tags; other tags are sections, so that what they hold stays reachable.
KINDS = {
    "html": "Document", "title": "Title", "h1": "Heading", "h2": "Heading", "h3": "Heading", "h4": "Heading", "h5": "Heading", "h6": "Heading", "p": "Paragraph", "dt": "Paragraph", "dd": "Paragraph", "address": "Paragraph", "ul": "List", "ol": "List", "menu": "List", "li": "ListItem",
    "a": "Link", "blockquote": "BlockQuote", "pre": "Code", "img": "Figure", "table": "Table", "tr": "TableRow", "td": "TableCell", "th": "TableCell", "caption": "Caption", "figcaption": "Caption", "footer": "Artifact", "aside": "Artifact",
    "input": "FormField", "select": "FormField", "textarea": "FormField", "button": "FormField", "option": "Option", "label": "Label", "legend": "Label",
}
#: Tags that are no elements: text goes through inline ones, and those of VOID and SILENT have none.
INLINE = tuple("b i em strong span small u s sub sup code kbd samp var cite q abbr font big tt mark del ins time data bdi bdo wbr br hr dfn acronym strike nobr ruby rt rp picture svg".split())
SILENT = ("meta", "link", "base", "source", "track", "area", "col", "param")
SPACED = ("br", "hr")
VOID = ("img", "input", "embed")
#: Containers that only pass on what they hold, and that stand once in a page.
PASS, ONCE = ("head", "body", "thead", "tbody", "tfoot", "colgroup", "optgroup"), ("html", "head", "body")
HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements that hold text, those of them inside whose text also belongs to the block around them, and elements in a line of text.
HOLD = (*HEADS, "p", "li", "dt", "dd", "address", "td", "th", "caption", "figcaption", "blockquote", "pre", "title", "label", "legend", "button", "option", "textarea", "a")
WITHIN = ("a", "label")
#: Elements whose text is not written as runs: what they are says where it goes.
NAMED = ("title", "button", "option", "textarea")
LINED = (*WITHIN, "img", "input", "select", "textarea", "button", "option")
CELLS, ROWS = ("td", "th", "caption"), ("thead", "tbody", "tfoot")
SCOPE = ("table", *CELLS, "button", "html")
BLOCKS = ("address", "article", "aside", "blockquote", "center", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "header", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul")
#: What an opening tag ends, and what such ends don't reach beyond.
ENDS = {t: (("p",), SCOPE) for t in BLOCKS} | {t: (("p", *HEADS), (*SCOPE, "li", *(b for b in BLOCKS if b != "p"))) for t in HEADS} | {
    "li": (("li", "p"), ("ul", "ol", "menu", *SCOPE)), "dt": (("dt", "dd", "p"), ("dl", *SCOPE)), "dd": (("dt", "dd", "p"), ("dl", *SCOPE)), "a": (("a",), SCOPE), "tr": (("tr", *CELLS), ("table",)), "td": (CELLS, ("table",)), "th": (CELLS, ("table",)),
    **{t: ((*ROWS, "tr", *CELLS), ("table",)) for t in ROWS}, "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",)), "body": (("head", "title"), ()),
}
#: The same for closing tags: the topmost of the first ends, with all that is open in it.
CLOSES = {t: (HEADS, SCOPE) for t in HEADS} | {t: ((t,), ("table",)) for t in ("tr", *ROWS, *CELLS)} | {"table": (("table",), ()), "body": ((), ()), "html": ((), ())}
OTHER_STOPS = CELLS

_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
TOKEN = re.compile(rf"<(?:!--.*?(?:-->|\Z)|(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[\s/]+|=|[^\s/>=]+(?:\s*=\s*{_VALUE}?)?)*+)(?:>|\Z))", re.DOTALL)
ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))?)?""")
_TO_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.IGNORECASE) for t in ("script", "style", "title", "textarea")}
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0]+")
ADVERTS = {"ad", "ads", "advert", "advertisement"}

COLUMNS = "doc_id long, element_id int, parent_id int, sibling_ord int, last_id int, depth int, tag string, kind string, attrs map<string,string>, text string, parent_tag string"


NAMES = tuple(c.split()[0] for c in COLUMNS.split(", "))[1:]


def attributes(raw: str) -> dict[str, str]:
    """Names in lower case with their values, the first of each; quotes of both kinds or none, entities decoded."""
    if not raw or raw.isspace():
        return {}
    return dict(_attributes(raw) if len(raw) <= 100 else _attributes.__wrapped__(raw))


@lru_cache(maxsize=20_000)
def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(raw):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


_INLINE, _SILENT, _LINED, _NAMED, _VOID, _PASS, _ONCE, _HOLD, _WITHIN = map(frozenset, (INLINE, (*SILENT, "script", "style", ""), LINED, NAMED, VOID, PASS, ONCE, HOLD, WITHIN))


def tags(html: str) -> Iterator[tuple[str, bool, str, str]]:
    """Tags that matter, in order, each with its attributes and the text up to the next: (name, closing, attributes, text). The first has no name."""
    name, closing, attrs, run, at = "", False, "", "", 0
    search = TOKEN.search
    while m := search(html, at):
        start, stop = m.span()
        if start > at:
            run += html[at:start]
        at = stop
        ends, found, raw = m.groups()
        found = found.lower() if found else ""
        ends = ends == "/"
        if found in _SILENT:
            if not ends and (found == "script" or found == "style"):
                end = _TO_END[found].search(html, at)
                at = end.start() if end else len(html)
            continue
        if found in _INLINE:
            if found in SPACED:
                run += " "
            continue
        yield name, closing, attrs, run
        name, closing, attrs, run = found, ends, raw, ""
        if not ends and (found == "title" or found == "textarea"):
            end = _TO_END[found].search(html, at)
            stop = end.start() if end else len(html)
            run = html[at:stop]
            at = stop
    yield name, closing, attrs, run + html[at:]


def _cut(stack: list[tuple], ends: tuple[str, ...], stops: tuple[str, ...], topmost: bool) -> None:
    found = None
    for i in range(len(stack) - 1, -1, -1):
        name = stack[i][0]
        if name in ends:
            found = i
            if topmost:
                break
        elif name in stops:
            break
    if found is not None:
        del stack[found:]


_SETS = [{t: (frozenset(a), frozenset(b)) for t, (a, b) in table.items()} for table in (ENDS, CLOSES)]
_STOPS, _NONE = frozenset(OTHER_STOPS), (None, None, None, None, None, None)


def tree(html: str | None) -> list[list]:
    """A page's rows in order: element_id, parent_id, sibling_ord, last_id, depth, tag, kind, attributes, text, parent's tag."""
    rows: list[list] = []
    index: dict[int, list] = {}
    # Tag, element (that around it for those that pass on), the outermost artifact, the innermost holder of text with its tag, and the innermost one that isn't within a line.
    stack: list[tuple] = []
    children: dict[int | None, int] = {}
    pieces: dict[int, list[str]] = {}
    before, inside = "", {}  # the last run; the label around a field
    ends_of, closes_of = _SETS

    def add(element: int, parent: int | None, tag: str, kind: str, attrs: dict, text: str = "") -> None:
        nth = children[parent] = children.get(parent, -1) + 1
        above = index.get(parent)
        row = [element, parent, nth, element, 0 if above is None else above[4] + 1, tag, kind, attrs, text, None if above is None else above[5]]
        index[element] = row
        rows.append(row)

    for k, (tag, closing, raw, text) in enumerate(tags(html or "")):
        lined = tag in _LINED
        if closing:
            ends = closes_of.get(tag)
            _cut(stack, *(ends or ((tag,), _STOPS)), True)
        elif tag:
            ends = ends_of.get(tag)
            if ends:
                _cut(stack, *ends, False)
            if tag not in _ONCE or all(s[0] != tag for s in stack):
                _, around, artifact, held, held_tag, block = stack[-1] if stack else _NONE
                hidden = artifact is not None
                attrs = attributes(raw)
                kind = "Artifact" if tag == "div" and ADVERTS & set(attrs.get("class", "").split()) else KINDS.get(tag, "Section")
                own = around
                if not hidden and tag not in _PASS and not (tag == "input" and attrs.get("type", "").lower() == "hidden"):
                    own = 2 * k
                    if kind == "FormField":
                        attrs["#before"] = before.strip()
                        inside[own] = next((s[1] for s in reversed(stack) if s[0] == "label"), None)
                    elif kind == "TableCell":
                        attrs["#table"] = next((str(s[1]) for s in reversed(stack) if s[0] == "table"), "")
                    add(own, around, tag, kind, attrs, attrs.get("alt", "") if kind == "Figure" else "")
                if tag not in _VOID:
                    if tag in _HOLD:
                        held, held_tag = own, tag
                        if tag not in _WITHIN:
                            block = own
                    stack.append((tag, own, own if kind == "Artifact" and not hidden else artifact, held, held_tag, block))
        before = text = _SPACE.sub(" ", unescape(text) if "&" in text else text) if text else text
        if not text:
            continue
        _, around, artifact, held, held_tag, block = stack[-1] if stack else _NONE
        if artifact is not None:
            pieces.setdefault(artifact, []).append(text if lined else " " + text)
            continue
        if held_tag is None:
            said = text.strip()
            if said:
                add(2 * k + 1, around, "#text", "Paragraph", {}, said)
            continue
        piece = text if lined else " " + text
        pieces.setdefault(held, []).append(piece)
        if held_tag in _WITHIN and block is not None:
            pieces.setdefault(block, []).append(piece)
        if (lined or text.strip()) and held_tag not in _NAMED:
            add(2 * k + 1, around, "#text", "Run", {}, text)
    for element, parts in pieces.items():
        index[element][8] = _SPACE.sub(" ", "".join(parts)).strip()
    if inside:
        labels: dict[str, str] = {}
        for row in rows:
            if row[5] == "label" and row[7].get("for"):
                labels.setdefault(row[7]["for"], row[8])
        for element, around in inside.items():
            row = index[element]
            found = labels.get(row[7].get("id", "")) or (around is not None and index[around][8])
            if found:
                row[7]["#label"] = found
    for row in reversed(rows):
        if row[1] is not None:
            above = index[row[1]]
            if row[3] > above[3]:
                above[3] = row[3]
    return rows


def page_tree(pages: DataFrame) -> DataFrame:
    """COLUMNS of pages (page_id, html). A null or empty page has no rows."""
    return over_trees(pages, lambda rows: rows, COLUMNS.split(", ", 1)[1])


#: Rows and characters of text after which a task gives out what it has found.
FLUSH, FLUSH_TEXT = 10_000, 2_000_000
_TYPES = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_map(kind):
        return pa.array(values, kind)
    ends, held, named = [0], [], []
    for a in values:
        if a:
            held.extend(a)
            named.extend(a.values())
        ends.append(len(held))
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(held, pa.string()), pa.array(named, pa.string()))


def over_trees(pages: DataFrame, step: Callable[[list[list]], Iterable[Sequence]], schema: str, text_at: int | None = None) -> DataFrame:
    """doc_id and the columns of ``schema`` ('name type, ...') that step gives for each page's rows (those of tree), while the page is at hand: what is asked within pages takes neither an exchange nor a second reading.

    A page's rows stay together and in step's order. text_at: the column whose texts may be much longer than the page; it bounds what is held before it goes out.
    """
    ship(pages.sparkSession)
    fields = [f.split() for f in schema.split(", ")]
    names, types = ["doc_id", *(n for n, _ in fields)], [pa.int64(), *(_TYPES[t] for _, t in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(docs: list[int], out: list[Sequence]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([_column(c, t) for c, t in zip((docs, *zip(*out, strict=True)), types, strict=True)], names)

        for batch in batches:
            docs: list[int] = []
            out: list[Sequence] = []
            size = 0
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = step(tree(html.as_py()))
                if text_at is None:
                    out += found
                else:
                    for row in found:
                        out.append(row)
                        size += len(row[text_at])
                        if size >= FLUSH_TEXT:
                            docs += [page] * (len(out) - len(docs))
                            yield packed(docs, out)
                            docs, out, size = [], [], 0
                docs += [page] * (len(out) - len(docs))
                if len(out) >= FLUSH:
                    yield packed(docs, out)
                    docs, out, size = [], [], 0
            if out:
                yield packed(docs, out)

    return pages.select(F.col("page_id").cast("long").alias("doc_id"), "html").mapInArrow(run, f"doc_id long, {schema}")


# ---- The same in DuckDB -----------------------------------------------------------------------------------------------------
def _list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]::VARCHAR[]"


def attribute_sql(name: str, attrs: str = "attrs") -> str:
    """An attribute's value, decoded; null where it is missing."""
    pattern = rf"""(?i)(?:^|[\s"''/]){name}(?:\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>][^\s>]*)))?(?:$|[\s"''/])"""
    groups = " || ".join(f"regexp_extract(' ' || {attrs} || ' ', '{pattern}', {i})" for i in (1, 2, 3))
    return f"CASE WHEN regexp_matches(' ' || {attrs} || ' ', '{pattern}') THEN {decoded_sql(groups)} END"


def decoded_sql(text: str) -> str:
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{sign}')"
    return text


def tree_sql(table: str = "pages") -> str:
    """page_tree in DuckDB over a table of page_id and html, with attributes as written (attrs): the stack is walked tag by tag for all pages at once. ancestors: element_ids from the root down. Knows the entities of decoded_sql."""
    noise = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
    rule = lambda table, closing: ", ".join(f"('{t}', {closing}, {_list(a)}, {_list(b)})" for t, (a, b) in table.items())
    kinds = " ".join(f"WHEN '{t}' THEN '{k}'" for t, k in KINDS.items())
    is_in = lambda x, names: f"{x} IN ({', '.join(repr(n) for n in names)})"
    tidy = lambda x: rf"trim(regexp_replace({x}, '[ \t\n\r\f\v\x{{a0}}]+', ' ', 'g'))"
    places = lambda test, first="1": f"list_filter(range({first}, len(stack) + 1), lambda i: {test})"
    return rf"""(WITH RECURSIVE parts AS (SELECT page_id AS doc_id, i, ps[i] AS part, lower(regexp_extract(ps[i], '^/?([a-zA-Z][^\s/>]*)', 1)) AS name FROM (SELECT page_id, string_split(regexp_replace(html, '{noise}', ' ', 'g'), '<') AS ps FROM {table} WHERE html <> ''), unnest(range(1, len(ps) + 1)) AS u(i)),
txt AS (SELECT doc_id, i, name, part[1:1] = '/' AS closing, strpos(part, '>') AS e, name <> '' AND i > 1 AND NOT ({is_in("name", (*INLINE, *SILENT))}) AS real, part FROM parts),
runs AS (SELECT doc_id, i, name, closing, real, CASE WHEN e > 0 THEN part[length(name) + CASE WHEN closing THEN 2 ELSE 1 END : e - 1] ELSE '' END AS attrs, CASE WHEN {is_in("name", SPACED)} THEN ' ' ELSE '' END || CASE WHEN i = 1 THEN part WHEN e > 0 THEN part[e + 1 :] ELSE '' END AS t, count(*) FILTER (WHERE real) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM txt),
tok AS (SELECT doc_id, k, coalesce(max(name) FILTER (WHERE real), '') AS tag, coalesce(bool_or(closing) FILTER (WHERE real), FALSE) AS closing, coalesce(max(attrs) FILTER (WHERE real), '') AS attrs, regexp_replace({decoded_sql("string_agg(t, '' ORDER BY i)")}, '[ \t\n\r\f\v]+', ' ', 'g') AS text FROM runs GROUP BY doc_id, k),
rules(tag, closing, ends, stops) AS (VALUES {rule(ENDS, "FALSE")}, {rule(CLOSES, "TRUE")}),
rich AS (SELECT t.*, coalesce(r.ends, CASE WHEN t.closing THEN [t.tag] ELSE []::VARCHAR[] END) AS ends, coalesce(r.stops, CASE WHEN t.closing THEN {_list(OTHER_STOPS)} ELSE []::VARCHAR[] END) AS stops, coalesce(lower({attribute_sql("type")}) = 'hidden' AND t.tag = 'input', FALSE) AS secret,
CASE WHEN t.tag = 'div' AND regexp_matches(coalesce({attribute_sql("class")}, ''), '(^|\s)(ad|ads|advert|advertisement)(\s|$)') THEN 'Artifact' ELSE coalesce(CASE t.tag {kinds} END, 'Section') END AS kind FROM tok t LEFT JOIN rules r ON r.tag = t.tag AND r.closing = t.closing),
st AS (SELECT doc_id, k, []::VARCHAR[] AS stack, []::INTEGER[] AS ids, []::BOOLEAN[] AS arts, NULL::INTEGER AS own, NULL::INTEGER AS parent, []::INTEGER[] AS above FROM rich WHERE k = 0
UNION ALL SELECT doc_id, k, CASE WHEN push THEN list_append(stack, tag) ELSE stack END, CASE WHEN push THEN list_append(ids, coalesce(own, parent)) ELSE ids END, CASE WHEN push THEN list_append(arts, kind = 'Artifact' AND NOT hidden) ELSE arts END, own, parent, above
FROM (SELECT *, CASE WHEN NOT closing AND NOT hidden AND NOT twice AND NOT secret AND NOT ({is_in("tag", PASS)}) THEN CAST(2 * k AS INTEGER) END AS own, NOT closing AND NOT twice AND NOT ({is_in("tag", VOID)}) AS push
FROM (SELECT *, list_contains(arts, TRUE) AS hidden, {is_in("tag", ONCE)} AND list_contains(stack, tag) AS twice, ids[-1] AS parent, list_distinct(ids) AS above
FROM (SELECT doc_id, k, tag, closing, kind, secret, stack[1:keep] AS stack, ids[1:keep] AS ids, arts[1:keep] AS arts
FROM (SELECT *, coalesce(CASE WHEN closing THEN list_max({places("list_contains(ends, stack[i])", "b + 1")}) ELSE list_min({places("list_contains(ends, stack[i])", "b + 1")}) END - 1, len(stack)) AS keep
FROM (SELECT n.doc_id, n.k, n.tag, n.closing, n.kind, n.secret, n.ends, n.stops, s.stack, s.ids, s.arts, coalesce(list_max(list_filter(range(1, len(s.stack) + 1), lambda i: list_contains(n.stops, s.stack[i]) AND NOT list_contains(n.ends, s.stack[i]))), 0) AS b FROM st s JOIN rich n ON n.doc_id = s.doc_id AND n.k = s.k + 1)))))),
ctx AS (SELECT st.*, r.tag, r.kind, r.attrs, r.text, {is_in("r.tag", LINED)} AS lined, list_position(arts, TRUE) AS art, list_max({places(f"list_contains({_list(HOLD)}, stack[i])")}) AS h, list_max({places(f"list_contains({_list(tuple(t for t in HOLD if t not in WITHIN))}, stack[i])")}) AS block, ids[list_max({places("stack[i] = 'table'")})] AS table_id, ids[list_max({places("stack[i] = 'label'")})] AS around, trim(lag(r.text) OVER (PARTITION BY st.doc_id ORDER BY st.k)) AS before FROM st JOIN rich r ON r.doc_id = st.doc_id AND r.k = st.k),
pieces AS (SELECT doc_id, k, ids[art] AS element_id, lined, text FROM ctx WHERE art IS NOT NULL UNION ALL SELECT doc_id, k, ids[h], lined, text FROM ctx WHERE art IS NULL AND h IS NOT NULL UNION ALL SELECT doc_id, k, ids[block], lined, text FROM ctx WHERE art IS NULL AND {is_in("stack[h]", WITHIN)} AND block IS NOT NULL),
held AS (SELECT doc_id, element_id, {tidy("string_agg(CASE WHEN lined THEN text ELSE ' ' || text END, '' ORDER BY k)")} AS text FROM pieces WHERE text <> '' GROUP BY doc_id, element_id),
labels AS (SELECT c.doc_id, {attribute_sql("for")} AS id, arg_min(coalesce(h.text, ''), own) AS text FROM ctx c LEFT JOIN held h ON h.doc_id = c.doc_id AND h.element_id = c.own WHERE tag = 'label' AND own IS NOT NULL AND {attribute_sql("for")} <> '' GROUP BY 1, 2),
e AS (SELECT c.doc_id, own AS element_id, parent AS parent_id, list_sort(above) AS ancestors, tag, kind, attrs, CASE WHEN kind = 'Figure' THEN coalesce({attribute_sql("alt")}, '') ELSE coalesce(h.text, '') END AS text, CASE WHEN kind = 'TableCell' THEN table_id END AS table_id, CASE WHEN kind = 'FormField' THEN before END AS before, CASE WHEN kind = 'FormField' THEN nullif(coalesce(nullif(l.text, ''), r.text), '') END AS label
FROM ctx c LEFT JOIN held h ON h.doc_id = c.doc_id AND h.element_id = c.own LEFT JOIN held r ON r.doc_id = c.doc_id AND r.element_id = c.around LEFT JOIN labels l ON l.doc_id = c.doc_id AND l.id = {attribute_sql("id")} WHERE own IS NOT NULL
UNION ALL SELECT doc_id, CAST(2 * k + 1 AS INTEGER), ids[-1], list_sort(list_distinct(ids)), '#text', CASE WHEN h IS NULL THEN 'Paragraph' ELSE 'Run' END, '', CASE WHEN h IS NULL THEN trim(text) ELSE text END, NULL, NULL, NULL FROM ctx WHERE art IS NULL AND text <> '' AND (trim(text) <> '' OR (h IS NOT NULL AND lined)) AND (h IS NULL OR NOT {is_in("stack[h]", NAMED)})),
lasts AS (SELECT doc_id, a AS element_id, max(element_id) AS last_id FROM (SELECT doc_id, element_id, unnest(ancestors) AS a FROM e) GROUP BY 1, 2)
SELECT e.doc_id, e.element_id, e.parent_id, CAST(row_number() OVER (PARTITION BY e.doc_id, e.parent_id ORDER BY e.element_id) - 1 AS INTEGER) AS sibling_ord, coalesce(l.last_id, e.element_id) AS last_id, CAST(len(e.ancestors) AS INTEGER) AS depth, e.tag, e.kind, e.attrs, e.text, e.table_id, e.before, e.label, p.tag AS parent_tag, e.ancestors
FROM e LEFT JOIN e p ON p.doc_id = e.doc_id AND p.element_id = e.parent_id LEFT JOIN lasts l ON l.doc_id = e.doc_id AND l.element_id = e.element_id)"""
