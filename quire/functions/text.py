"""Text functions of documents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Str = Column | str

#: Field names that say nothing; link texts that say nothing; alternative texts that say nothing.
GENERIC_NAMES = ("text", "field", "untitled", "check", "box", "button", "radio", "form")
VAGUE_LINKS = ("click here", "here", "read more", "more", "link", "this link", "download", "continue", "go", "learn more", "see more", "details")
USELESS_ALT = ("image", "picture", "photo", "graphic", "figure", "untitled")
#: Spoken names of characters.
CHARACTER_NAMES = {
    ".": "full stop", ",": "comma", ";": "semicolon", ":": "colon", "'": "apostrophe", '"': "quote", "-": "hyphen", "_": "underscore", "(": "open bracket",
    ")": "close bracket", "/": "slash", "\\": "backslash", "@": "at", "&": "ampersand", "£": "pound sign", "$": "dollar sign", "%": "percent",
}
#: Spoken roles of element kinds.
ROLES = {
    "Document": "document", "Page": "page", "Section": "section", "Heading": "heading", "Paragraph": "paragraph", "List": "list", "ListItem": "list item",
    "Table": "table", "TableRow": "row", "TableCell": "cell", "Figure": "figure", "Caption": "caption", "BlockQuote": "quote", "Code": "code", "Note": "note",
    "Link": "link", "FormField": "form field", "Annotation": "comment", "Attachment": "attachment", "Artifact": "page furniture",
}


def _c(x: Str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mapping(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def tidy_space(x: Str) -> Column:
    """Soft hyphens go, runs of any white space become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(F.translate(_c(x), "­", ""), r"(?U)\s+", " "))


def for_speech(x: Str) -> Column:
    """Typographic quotes, dashes and spaces become plain; invisible characters go."""
    plain = F.translate(_c(x), "‘’‛“”‟–—−­​‌‍﻿�", "'''\"\"\"---")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def truncate(x: Str, most: int) -> Column:
    """T4: cut at the last space within ``most`` characters unless that loses more than half; an ellipsis marks the cut."""
    x = _c(x)
    head = F.substring(x, 1, most + 1)
    last = F.length(head) - F.instr(F.reverse(head), " ") + 1
    at = F.when((F.instr(head, " ") > 0) & (last - 1 >= most // 2), last - 1).otherwise(F.lit(most))
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.rtrim(F.substring(x, F.lit(1), at)), F.lit("…")))


def furniture_key(x: Str) -> Column:
    """T5: lower case, digit runs as #, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[0-9]+", "#"), r"(?U)\s+", " "))


def shorten(x: Str, most: int, head: int) -> Column:
    """Texts over ``most`` characters keep ``head`` and an ellipsis."""
    x = _c(x)
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, head), F.lit("…")))


def tidy_label(x: Str) -> Column:
    """Marks around a caption go; a caption over 80 characters is none."""
    out = F.regexp_replace(F.regexp_replace(_c(x), r"[:*†‡_\s]+$", ""), r"^[*†‡\s]+", "")
    return F.when(F.length(out) > 80, F.lit("")).otherwise(out)


def humanise(x: Str) -> Column:
    """A field name as words."""
    spaced = F.regexp_replace(F.regexp_replace(_c(x), r"(\p{Ll})(?=\p{Lu})", "$1 "), r"[_.\-]+", " ")
    spaced = F.trim(F.regexp_replace(spaced, " +", " "))
    return F.concat(F.lower(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 30))


def readable_name(x: Str) -> Column:
    """Whether a field name can serve as a label."""
    x = _c(x)
    stem = F.regexp_replace(x, r"[0-9_\- ]+$", "")
    named = (F.length(stem) >= 3) & stem.rlike(r"\p{L}") & ~F.lower(stem).isin(*GENERIC_NAMES)
    return F.coalesce((F.length(x) >= 3) & named, F.lit(False))


def partial_name(x: Str) -> Column:
    """What follows the last dot, unless the name ends in it."""
    x = _c(x)
    return F.when(x.endswith("."), x).otherwise(F.substring_index(x, ".", -1))


def blank(x: Str) -> Column:
    return F.coalesce(F.trim(_c(x)) == "", F.lit(True))


def label_source(tooltip: Str, recovered: Str, name: Str) -> Column:
    return F.when(~blank(tooltip), "tooltip").when(~blank(recovered), "nearby").when(readable_name(partial_name(name)), "name").otherwise("none")


def label(tooltip: Str, recovered: Str, name: Str) -> Column:
    """T10."""
    source = label_source(tooltip, recovered, name)
    return F.when(source == "tooltip", F.trim(_c(tooltip))).when(source == "nearby", F.trim(_c(recovered))).when(source == "name", humanise(partial_name(name))).otherwise("unlabelled field")


def vague_link(x: Str) -> Column:
    """Link text that says nothing about where it leads."""
    t = F.trim(F.coalesce(_c(x), F.lit("")))
    return (t == "") | ((F.length(t) > 60) & ~F.contains(t, F.lit(" "))) | F.lower(t).isin(*VAGUE_LINKS)


def spoken_target(kind: Str, target: Str) -> Column:
    """Host, and path where there is one, of a web address; other targets as they are."""
    target = _c(target)
    host = F.lower(F.regexp_extract(target, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    path = F.regexp_extract(target, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?", 1)
    path = F.when(path == "", "/").otherwise(path)
    plain = (path == "/") & ~F.contains(target, F.lit("?"))
    return F.when((_c(kind) == "WebUrl") & (host != ""), F.when(plain, host).otherwise(F.concat(host, F.lit(", path "), path))).otherwise(target)


def classify_uri(x: Str) -> Column:
    """Kind of a link's target."""
    low = F.lower(F.trim(_c(x)))
    return F.when(blank(x), "Unknown").when(low.startswith("mailto:"), "Email").when(low.startswith("file:"), "ExternalFile").when(low.startswith("javascript:"), "UnsupportedAction").otherwise("WebUrl")


def uri_target(x: Str) -> Column:
    x = F.trim(_c(x))
    return F.when(F.lower(x).startswith("mailto:"), F.substring(x, 8, 1 << 30)).otherwise(x)


#: Action types and the target kinds that they become.
ACTIONS = {"URI": "WebUrl", "GoTo": "InternalDestination", "GoToR": "ExternalFile", "GoToE": "EmbeddedFile", "Launch": "UnsupportedAction", "JavaScript": "UnsupportedAction"}


def classify_action(x: Str) -> Column:
    """T14."""
    return F.coalesce(F.try_element_at(mapping(ACTIONS), _c(x)), F.lit("UnsupportedAction"))


def spoken_size(x: Str) -> Column:
    """Bytes in words, with at most one decimal."""
    x = _c(x)
    tidy = lambda v: F.regexp_replace(F.format_string("%.1f", F.bround(v, 1)), r"\.0$", "")
    steps = ((1 << 30, "gigabytes"), (1 << 20, "megabytes"), (1 << 10, "kilobytes"))
    out = F.concat(x.cast("string"), F.lit(" bytes"))
    for size, name in reversed(steps):
        out = F.when(x >= size, F.concat(tidy(x / size), F.lit(f" {name}"))).otherwise(out)
    return out


def spell(x: Str) -> Column:
    """How a character is spoken."""
    first = F.substring(_c(x), 1, 1)
    named = F.coalesce(F.try_element_at(mapping(CHARACTER_NAMES), first), _c(x))
    return F.when(_c(x) == "", "blank").when(first.rlike(r"(?U)^\s$"), "space").when(first.rlike(r"^\p{Lu}$"), F.concat(F.lit("capital "), F.lower(first))).otherwise(named)


def pdf_date(x: Str, clamp: bool = False) -> Column:
    """D:YYYYMMDDHHmmSS with parts missing from the end; offsets are ignored. clamp cuts days at 28, as the tools that this follows do."""
    digits = F.regexp_extract(_c(x), r"^(?:D:)?([0-9]{4,14})", 1)
    part = lambda at, n, default: F.coalesce(F.try_to_number(F.nullif(F.substring(digits, at, n), F.lit("")), F.lit("9" * n)).cast("int"), F.lit(default))
    day = part(7, 2, 1)
    day = F.least(day, F.lit(28)) if clamp else day
    made = F.try_make_timestamp(part(1, 4, 1), part(5, 2, 1), day, part(9, 2, 0), part(11, 2, 0), part(13, 2, 0))
    return F.when(digits != "", made)


def pdf_date_text(ts: Str, offset_minutes: Str) -> Column:
    """D:yyyyMMddHHmmss and the offset as +HH'mm'."""
    off = _c(offset_minutes)
    size = F.abs(off)
    tail = F.concat(F.when(off < 0, "-").otherwise("+"), F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit("'"), F.lpad((size % 60).cast("string"), 2, "0"), F.lit("'"))
    return F.concat(F.lit("D:"), F.date_format(_c(ts), "yyyyMMddHHmmss"), tail)


def html_escape(x: Str) -> Column:
    """T19."""
    out = F.coalesce(_c(x), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def standard_font(x: Str) -> Column:
    """Whether the standard fonts have all characters."""
    return ~_c(x).rlike("[^\\u0000-\\u00ff]")


def pdf_literal(x: Str) -> Column:
    """Escapes for a literal string; what the standard fonts lack becomes a question mark."""
    out = F.regexp_replace(_c(x), r"([\\()])", r"\\$1")
    out = F.replace(F.replace(out, F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    return F.regexp_replace(out, "[^\\u0000-\\u00ff]", "?")


#: Language tags and their English names.
LANGUAGES = {"en": "English", "en-GB": "English (United Kingdom)", "en-US": "English (United States)", "fr": "French", "de": "German", "es": "Spanish", "it": "Italian", "cy": "Welsh"}


def language_name(x: Str) -> Column:
    """The tag itself where no name is known."""
    return F.coalesce(F.try_element_at(mapping(LANGUAGES), _c(x)), _c(x))


def role(kind: Str) -> Column:
    """T24."""
    return F.coalesce(F.try_element_at(mapping(ROLES), _c(kind)), F.lit(""))


def describe(kind: Str, content: Str, state: Str, position: Str, verbosity: Str) -> Column:
    """Role (not if terse), content, state and position (if detailed); never empty."""
    v = _c(verbosity)
    some = lambda x: F.nullif(F.trim(F.coalesce(_c(x), F.lit(""))), F.lit(""))
    out = F.concat_ws(", ", F.when(v != "Terse", some(role(kind))), some(content), some(state), F.when(v == "Detailed", some(position)))
    return F.coalesce(F.nullif(out, F.lit("")), F.nullif(role(kind), F.lit("")), F.lit("empty"))


def appearance_size(appearance: Str, height: Str) -> Column:
    """The font size operand, or one that fits the height."""
    given = F.regexp_extract(_c(appearance), r"([0-9]+\.?[0-9]*|\.[0-9]+)\s+Tf", 1).try_cast("double")
    return F.when(given > 0, given).otherwise(F.greatest(F.lit(6.0), F.least(F.lit(14.0), 0.65 * _c(height))))


def place_on_page(left: Str, bottom: Str, right: Str, top: Str, height: Str) -> dict[str, Column]:
    """Millimetres from the left and the bottom, and the third of the page by the centre."""
    mm = lambda x: F.bround(_c(x) * 25.4 / 72, 0).cast("int")
    centre = (_c(bottom) + _c(top)) / 2 / _c(height)
    third = F.when(centre < 1 / 3, "bottom").when(centre < 2 / 3, "middle").otherwise("top")
    return {"left_mm": mm(left), "bottom_mm": mm(bottom), "third": third}


def page_ranges(pages: Str) -> Column:
    """Ascending distinct page numbers as runs, "1 to 3, 7"; six runs at most, then "and others"."""
    runs = F.aggregate(
        _c(pages), F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, p: F.when(F.element_at(F.concat(acc, F.array(F.struct(F.lit(-9).alias("a"), F.lit(-9).alias("b")))), F.greatest(F.size(acc), F.lit(1)))["b"] == p - 1,
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), p.alias("b")))),
        ).otherwise(F.concat(acc, F.array(F.struct(p.alias("a"), p.alias("b"))))),
    )
    text = lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat(r["a"].cast("string"), F.lit(" to "), r["b"].cast("string")))
    shown = F.array_join(F.transform(F.slice(runs, 1, 6), text), ", ")
    return F.when(F.size(runs) > 6, F.concat(shown, F.lit(" and others"))).otherwise(shown)
