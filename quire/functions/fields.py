"""Form-field rules as column expressions: validation, matching, policy and what is said about a field.

Numbers are read as in en-GB: commas group digits, the point is decimal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank

Str = Column | str
#: Date patterns in the order they are tried, words of check boxes, and words that tell a field's format, in order.
DATE_PATTERNS = ("d/M/yyyy", "d-M-yyyy", "yyyy-MM-dd", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy", "MM/dd/yyyy")
TIME_PATTERNS = ("H:mm", "H:mm:ss", "h:mm a", "h a")
FALSE_WORDS = ("", "off", "no", "false", "0", "unchecked", "clear")
TRUE_WORDS = ("on", "yes", "true", "1", "checked", "tick", "ticked", "x")
FORMAT_WORDS = {
    "Email": ("e-mail", "email", "mail address"),
    "Date": ("date", "dob", "birth", "expiry", "expires"),
    "Time": ("time", "hour"),
    "Telephone": ("phone", "telephone", "mobile", "fax"),
    "PostalCode": ("postcode", "post code", "zip"),
    "Currency": ("amount", "total", "price", "cost", "salary", "fee", "£", "$", "€"),
    "Number": ("quantity", "number of", "count", "age", "year"),
    "DigitsOnly": ("account number", "reference number", "national insurance", "ssn"),
}
#: What a format asks for.
GUIDANCE = {
    "Number": "enter a number", "Currency": "enter an amount", "DigitsOnly": "enter digits only", "Date": "enter a date, for example 31/03/2026",
    "Time": "enter a time, for example 14:30", "Email": "enter an email address", "Telephone": "enter a telephone number", "PostalCode": "enter a postcode",
    "Comb": "enter one character per box",
}


def _c(x: Str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_number(x: Str) -> Column:
    """V3."""
    return F.regexp_replace(F.trim(_c(x)), ",", "").try_cast("double").isNotNull()


def is_currency(x: Str) -> Column:
    """V4: what is left of digits, points, commas and signs is an amount."""
    kept = F.regexp_replace(F.regexp_replace(_c(x), r"[^\p{Nd}.,+\-]", ""), ",", "")
    return kept.try_cast("decimal(38,10)").isNotNull()


def is_digits(x: Str) -> Column:
    """V5."""
    return _c(x).rlike(r"^\p{Nd}*$")


def as_date(x: Str) -> Column:
    """V6: the first pattern that fits, as dd/MM/yyyy; else null. Free-form dates are not read."""
    return F.date_format(F.coalesce(*(F.try_to_date(F.trim(_c(x)), p) for p in DATE_PATTERNS)), "dd/MM/yyyy")


def as_time(x: Str) -> Column:
    """V7: HH:mm or null."""
    return F.date_format(F.coalesce(*(F.try_to_timestamp(F.upper(F.trim(_c(x))), F.lit(p)) for p in TIME_PATTERNS)), "HH:mm")


def is_email(x: Str) -> Column:
    """V8."""
    return _c(x).rlike(r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$")


def is_telephone(x: Str) -> Column:
    """V9: at least five digits, and only signs that numbers are written with besides."""
    return _c(x).rlike(r"^[\p{Nd}+\-() .]*$") & (F.regexp_count(_c(x), F.lit(r"\p{Nd}")) >= 5)


def infer_format(tooltip: Str, name: Str, comb: Str) -> Column:
    """The first format one of whose words stands anywhere in tooltip and name."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(_c(tooltip), F.lit("")), F.coalesce(_c(name), F.lit(""))))
    out = F.when(_c(comb), "Comb")
    for kind, needles in FORMAT_WORDS.items():
        hit = F.lit(False)
        for n in needles:
            hit = hit | F.contains(hay, F.lit(n))
        out = out.when(hit, kind)
    return out.otherwise("PlainText")


def text_value(raw: Str, fmt: Str, max_length: Str, multiline: Str) -> Column:
    """V2: struct of accepted, value and reason. Empty always passes; then comb length, greatest length and format are checked in turn."""
    v = F.when(_c(multiline), F.replace(_c(raw), F.lit("\r\n"), F.lit("\n"))).otherwise(F.trim(F.replace(_c(raw), F.lit("\n"), F.lit(" "))))
    n, kind = F.length(v), _c(fmt)
    fits = (
        F.when(kind == "Number", is_number(v)).when(kind == "Currency", is_currency(v)).when(kind == "DigitsOnly", is_digits(v)).when(kind == "Date", as_date(v).isNotNull())
        .when(kind == "Time", as_time(v).isNotNull()).when(kind == "Email", is_email(v)).when(kind == "Telephone", is_telephone(v)).otherwise(True)
    )
    stored = F.when(kind == "Date", as_date(v)).when(kind == "Time", as_time(v)).when(kind.isin("Email", "Telephone"), F.trim(v)).otherwise(v)
    reason = F.when(n == 0, "cleared").when((kind == "Comb") & (n != _c(max_length)), "length").when(n > _c(max_length), "too long").when(~fits, "format").otherwise("set")
    accepted = reason.isin("cleared", "set")
    return F.struct(accepted.alias("accepted"), F.when(reason == "cleared", "").when(accepted, stored).alias("value"), reason.alias("reason"))


def gated(read_only: Str, result: Column) -> Column:
    """V1: a read-only field takes nothing."""
    no = F.struct(F.lit(False).alias("accepted"), F.lit(None).cast("string").alias("value"), F.lit("read-only").alias("reason"))
    return F.when(_c(read_only), no).otherwise(result)


def check_box(raw: Str, on: Str, off: Str) -> Column:
    """True, false, or null where the word is unknown."""
    w = F.lower(F.trim(_c(raw)))
    return F.when(w.isin(*FALSE_WORDS), False).when(w.isin(*TRUE_WORDS), True).when(w == F.lower(_c(on)), True).when(w == F.lower(_c(off)), False)


def needs_attention(read_only: Str, required: Str, has_value: Str, invalid: Str) -> Column:
    """V16."""
    return ~_c(read_only) & _c(required) & (~_c(has_value) | _c(invalid))


def needs_alt(decorative: Str, alt: Str) -> Column:
    """V17."""
    return ~_c(decorative) & blank(alt)


def tiny(*sizes: Str) -> Column:
    """Any known dimension over 0 and under 8."""
    out = F.lit(False)
    for s in sizes:
        out = out | F.coalesce((_c(s) > 0) & (_c(s) < 8), F.lit(False))
    return out


def button_policy(action: Str, target: Str) -> Column:
    """Refused, confirm or allowed."""
    a, there = _c(action), ~blank(target)
    return (
        F.when(a.isin("Script", "None"), "refused").when(a.isin("ImportData", "Print"), "refused").when(a.isin("SubmitForm", "OpenUrl"), F.when(there, "confirm").otherwise("refused"))
        .when(a == "ResetForm", "confirm").when(a == "GoToPage", F.when(there, "allowed").otherwise("refused")).otherwise("refused")
    )


def link_policy(kind: Str, target: Str, page: Str) -> Column:
    """Refused, allowed (a jump inside the document) or confirm; other schemes than the four are refused."""
    scheme = F.lower(F.regexp_extract(_c(target), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return (
        F.when((_c(kind) == "UnsupportedAction") | (F.coalesce(_c(target), F.lit("")) == ""), "refused")
        .when(_c(kind) == "InternalDestination", F.when(_c(page).isNotNull(), "allowed").otherwise("refused"))
        .when((scheme != "") & ~scheme.isin("http", "https", "mailto", "file"), "refused").otherwise("confirm")
    )


def good_alt(x: Str, useless: tuple[str, ...]) -> Column:
    """V20."""
    t = F.lower(F.trim(F.coalesce(_c(x), F.lit(""))))
    return (t != "") & ~t.isin(*useless)


def guidance(required: Str, fmt: Str, max_length: Str, multiline: Str) -> Column:
    """What is said on entering a text field."""
    k = _c(fmt)
    n = _c(max_length).cast("string")
    by_format = F.when((k == "DigitsOnly") & n.isNotNull(), F.concat(F.lit("enter "), n, F.lit(" digits")))
    by_format = by_format.when((k == "Comb") & n.isNotNull(), F.concat(F.lit("enter exactly "), n, F.lit(" characters, one per box")))
    for kind, text in GUIDANCE.items():
        by_format = by_format.when(k == kind, text)
    by_format = by_format.when(_c(multiline), "multi-line, press Alt+Enter for a new line")
    return F.concat_ws(". ", F.when(_c(required), "required"), by_format, F.when(n.isNotNull() & ~k.isin("Comb", "DigitsOnly"), F.concat(F.lit("at most "), n, F.lit(" characters"))))


def text_in_speech(value: Str, password: Str, multiline: Str) -> Column:
    """T27 for text fields."""
    v = F.coalesce(_c(value), F.lit(""))
    lines = F.size(F.split(v, "\n"))
    many = F.concat(F.rtrim(F.substring_index(v, "\n", 1)), F.lit(", "), lines.cast("string"), F.lit(" lines in total"))
    return F.when(v == "", "blank").when(_c(password), F.concat(F.length(v).cast("string"), F.lit(" characters entered"))).when(_c(multiline) & (lines > 1), many).otherwise(v)
