"""Layout classification of lines and blocks as column expressions and frame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Str = Column | str
#: Characters that start a bulleted item, and parts of names of monospaced fonts.
BULLETS = "•·▪▫◦‣⁃−–—*+"
MONOSPACED = ("courier", "consolas", "monaco", "menlo", "mono", "lucida console", "andale", "inconsolata", "source code", "dejavu sans mono", "roboto mono")
ORDERED = r"^(\(?([0-9]{1,3}|[a-zA-Z]|[ivxlcdmIVXLCDM]{1,6})[.)\]]\s)\s*(.*)$"
#: Size ratios of heading levels 1 to 3, the least ratio of a bold heading, and lengths.
RATIOS, BOLD_RATIO, LONGEST, BOLD_LONGEST, CAPS_LONGEST = (1.60, 1.35, 1.18), 1.02, 140, 80, 60


def _c(x: Str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def all_caps(x: Str) -> Column:
    """At least four letters, and all of them capitals."""
    x = _c(x)
    return (F.regexp_count(x, F.lit(r"\p{L}")) >= 4) & ~x.rlike(r"[\p{L}&&[^\p{Lu}]]")


def heading_level(text: Str, ratio: Str, bold: Str, lines: Str) -> Column:
    """1 to 4, or null."""
    t, r, n = _c(text), _c(ratio), F.length(_c(text))
    no = (n == 0) | (n > LONGEST) | (_c(lines) > 3) | t.rlike(r"[.;,]\z")
    out = F.when(no, F.lit(None).cast("int"))
    for level, least in enumerate(RATIOS, 1):
        out = out.when(r >= least, level)
    return out.when(_c(bold) & (r >= BOLD_RATIO) & (n <= BOLD_LONGEST), 4).when(all_caps(t) & (n <= CAPS_LONGEST), 4)


def heading_reason(text: Str, ratio: Str, bold: Str) -> Column:
    """C7."""
    weight = F.when(_c(bold), " in bold").otherwise("")
    return (
        F.when(_c(ratio) >= RATIOS[-1], F.concat(F.format_string("%.1f", F.bround(_c(ratio), 1)), F.lit(" times body size"), weight))
        .when(_c(bold), "bold and short").when(all_caps(text), "capitals only").otherwise("stands apart")
    )


def monospaced(font: Str) -> Column:
    """C9."""
    return F.lower(_c(font)).rlike("|".join(MONOSPACED))


def list_marker(text: Str) -> Column:
    """Struct of marker, kind and body, or null where the text is no list item."""
    t = _c(text)
    bullet = t.rlike(rf"^[{BULLETS}]\s") | t.startswith("- ")
    bullet_body = F.regexp_replace(F.substring(t, 3, 1 << 30), r"^\s+", "")
    label, body = F.regexp_extract(t, ORDERED, 2), F.regexp_extract(t, ORDERED, 3)
    roman = label.rlike("^[ivxlcdmIVXLCDM]+$") & ((F.length(label) > 1) | label.isin("i", "I"))
    upper = label.rlike("^[A-Z]")
    kind = F.when(label.rlike("^[0-9]+$"), "Decimal").when(roman, F.when(upper, "UpperRoman").otherwise("LowerRoman")).otherwise(F.when(upper, "UpperAlpha").otherwise("LowerAlpha"))
    s = lambda m, k, b: F.struct(m.alias("marker"), k.alias("kind"), b.alias("body"))
    return F.when(bullet & (bullet_body != ""), s(F.substring(t, 1, 1), F.lit("Bullet"), bullet_body)).when(~bullet & (body != ""), s(F.regexp_extract(t, ORDERED, 1), kind, body))


def block_kind(text: Str, ratio: Str, bold: Str, lines: Str, italic: Str, indent: Str, body_size: Str, font: Str) -> Column:
    """The first that fits of list item, heading, quote, code, paragraph."""
    return (
        F.when(list_marker(text).isNotNull(), "ListItem").when(heading_level(text, ratio, bold, lines).isNotNull(), "Heading")
        .when(_c(italic) & (_c(indent) > _c(body_size)) & (F.length(_c(text)) > 40), "BlockQuote").when(F.coalesce(monospaced(font), F.lit(False)), "Code").otherwise("Paragraph")
    )


def classify_lines(lines: DataFrame) -> DataFrame:
    """Lines of plain text (no sizes or fonts) as elements: adds kind, marker, marker_kind and body."""
    d = lines.withColumn("_m", list_marker("text"))
    head = heading_level("text", F.lit(1.0), F.lit(False), F.lit(1)).isNotNull()
    kind = F.when(F.col("_m").isNotNull(), "ListItem").when(head, "Heading").otherwise("Paragraph")
    return d.select("*", kind.alias("kind"), F.col("_m.marker").alias("marker"), F.col("_m.kind").alias("marker_kind"), F.coalesce("_m.body", "text").alias("body")).drop("_m")


def joins_next(first: Str, second: Str) -> Column:
    """Whether a paragraph runs on into the next."""
    a, b = _c(first), _c(second)
    return (a != "") & ~a.rlike("[.!?:;\"”)\\]]$") & b.rlike(r"^\p{Ll}")


def joined(parts: Column) -> Column:
    """Fragments in order: a hyphen at the end goes where the next starts in lower case, else a space comes between."""
    glue = lambda a, b: F.when((a.endswith("-")) & b.rlike(r"^\p{Ll}"), F.concat(F.substring(a, F.lit(1), F.length(a) - 1), b)).otherwise(F.concat(a, F.lit(" "), b))
    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.get(parts, F.lit(0)), glue)
