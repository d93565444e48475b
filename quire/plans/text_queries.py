"""Queries of the text functions over literal rows and over the documents' lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T

from .fixture import Fixture, Registry, sql_literal

R = Registry()
WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def rows(*values: object) -> tuple[tuple, ...]:
    return tuple((i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values))


def sql_map(table: dict[str, str], key: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = {sql_literal(k)} THEN {sql_literal(v)}" for k, v in table.items()) + f" ELSE {default} END"


TEXTS = Fixture("texts", "id int, x string", rows("a­b  c", "  plain  text\t\nnext ", "“x” – y​", "‘it’s’ — done﻿", "Page 12 of 120", "PAGE  3 of 4", "", None, "a" * 50 + " " + "b" * 20, "short", "word " * 30, "x" * 130, "Housing Benefit Application — Form HB1 — Page 5 of 6"))

R.scalar("t01_normalise_whitespace", TEXTS, {"y": (lambda: T.tidy_space("x"), f"trim(regexp_replace(replace(x, '­', ''), '{WS}', ' ', 'g'))")})
R.scalar("t02_prepare_for_speech", TEXTS, {"y": (lambda: T.for_speech("x"), f"trim(regexp_replace(regexp_replace(translate(x, '‘’‛“”‟–—−', '''''''\"\"\"---'), '[­​‌‍﻿�]', '', 'g'), '{WS}', ' ', 'g'))")})


def _cut(most: int) -> str:
    head = f"x[1:{most + 1}]"
    last = f"(length({head}) - strpos(reverse({head}), ' '))"
    return f"CASE WHEN length(x) <= {most} THEN x ELSE rtrim(x[1:CASE WHEN strpos({head}, ' ') > 0 AND {last} >= {most // 2} THEN {last} ELSE {most} END]) || '…' END"


R.scalar("t04_truncate", TEXTS, {"y60": (lambda: T.truncate("x", 60), _cut(60)), "y20": (lambda: T.truncate("x", 20), _cut(20))})
R.scalar("t05_repetition_key", TEXTS, {"y": (lambda: T.furniture_key("x"), f"trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '#', 'g'), '{WS}', ' ', 'g'))")})
R.scalar("t06_shorten", TEXTS, {f"y{m}": ((lambda m=m, h=h: T.shorten("x", m, h)), f"CASE WHEN length(x) <= {m} THEN x ELSE x[1:{h}] || '…' END") for m, h in ((50, 47), (40, 37), (60, 60))})

CAPTIONS = Fixture("captions", "id int, x string", rows("Reference number:", "* Full name *", "† Note ‡: ", "Email", "", None, "y" * 90, "__Name__"))
TIDY = r"regexp_replace(regexp_replace(x, '[:*†‡_\s]+$', ''), '^[*†‡\s]+', '')"
R.scalar("t07_tidy_label", CAPTIONS, {"y": (lambda: T.tidy_label("x"), f"CASE WHEN length({TIDY}) > 80 THEN '' ELSE {TIDY} END")})

NAMES = Fixture("names", "id int, x string", rows("applicantFullName", "applicant_full_name", "applicantNHSNumber", "form.applicant.address.postcode", "Text1", "text_", "field-12", "ab", "X1", "dateOfBirth", "name.", "Total__Due", "12345", "", None))
SPACED = r"trim(regexp_replace(regexp_replace(regexp_replace(x, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '[_.\-]+', ' ', 'g'), ' +', ' ', 'g'))"
HUMAN = f"lower(({SPACED})[1:1]) || ({SPACED})[2:]"
GENERIC = ", ".join(map(sql_literal, T.GENERIC_NAMES))
STEM = r"regexp_replace(x, '[0-9_\- ]+$', '')"
READABLE = f"coalesce(length(x) >= 3 AND length({STEM}) >= 3 AND regexp_matches({STEM}, '\\p{{L}}') AND lower({STEM}) NOT IN ({GENERIC}), FALSE)"
PARTIAL = "CASE WHEN x LIKE '%.' THEN x ELSE string_split(x, '.')[-1] END"
R.scalar("t08_humanise_name", NAMES, {"y": (lambda: T.humanise("x"), HUMAN)})
R.scalar("t09_readable_name", NAMES, {"y": (lambda: T.readable_name("x"), READABLE)})
R.scalar("t20_partial_name", NAMES, {"y": (lambda: T.partial_name("x"), PARTIAL)})

LABELS = Fixture("labelled", "id int, tooltip string, recovered string, name string", rows(("Full name ", None, "a.b"), (None, "Reference number", "ref"), ("  ", " ", "form.applicantFullName"), (None, None, "Text1"), (None, "", "a.dateOfBirth"), (None, None, None)))
PX = "(CASE WHEN name LIKE '%.' THEN name ELSE string_split(name, '.')[-1] END)"
SRC = f"CASE WHEN trim(coalesce(tooltip, '')) <> '' THEN 'tooltip' WHEN trim(coalesce(recovered, '')) <> '' THEN 'nearby' WHEN {READABLE.replace('(x', '(' + PX)} THEN 'name' ELSE 'none' END"
R.scalar("t10_label_resolution", LABELS, {
    "source": (lambda: T.label_source("tooltip", "recovered", "name"), SRC),
    "label": (lambda: T.label("tooltip", "recovered", "name"), f"CASE {SRC} WHEN 'tooltip' THEN trim(tooltip) WHEN 'nearby' THEN trim(recovered) WHEN 'name' THEN {HUMAN.replace('(x', '(' + PX)} ELSE 'unlabelled field' END"),
})

LINKS = Fixture("links", "id int, kind string, x string", rows(("WebUrl", "https://Example.org/report"), ("WebUrl", "https://example.org/"), ("WebUrl", "http://example.org?q=1"), ("WebUrl", "https://me@example.org:8080/a/b?x#y"), ("Email", "name@example.org"), ("WebUrl", "not a url"), ("Unknown", "")))
URL = r"'^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)'"
PATH = r"regexp_extract(x, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?', 1)"
HOST = f"lower(regexp_extract(x, {URL}, 1))"
R.scalar("t12_speakable_target", LINKS, {"y": (lambda: T.spoken_target("kind", "x"), f"CASE WHEN kind = 'WebUrl' AND {HOST} <> '' THEN CASE WHEN {PATH} IN ('', '/') AND strpos(x, '?') = 0 THEN {HOST} ELSE {HOST} || ', path ' || CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END END ELSE x END")}, "id,kind")

WORDS = Fixture("link_texts", "id int, x string", rows("read more", "Download the 2026 annual report", "https://example.org/" + "a" * 60, " Click Here ", "", None, "details", "More details"))
VAGUE = f"(trim(coalesce(x, '')) = '' OR (length(trim(coalesce(x, ''))) > 60 AND strpos(trim(x), ' ') = 0) OR lower(trim(coalesce(x, ''))) IN ({', '.join(map(sql_literal, T.VAGUE_LINKS))}))"
R.scalar("t11_uninformative_text", WORDS, {"y": (lambda: T.vague_link("x"), VAGUE)})

URIS = Fixture("uris", "id int, x string", rows("mailto:a@b.org", "MAILTO:x@y.org", "file:///tmp/a", "javascript:void(0)", "https://example.org", "", None, "www.example.org"))
R.scalar("t13_classify_uri", URIS, {
    "kind": (lambda: T.classify_uri("x"), "CASE WHEN trim(coalesce(x, '')) = '' THEN 'Unknown' WHEN lower(trim(x)) LIKE 'mailto:%' THEN 'Email' WHEN lower(trim(x)) LIKE 'file:%' THEN 'ExternalFile' WHEN lower(trim(x)) LIKE 'javascript:%' THEN 'UnsupportedAction' ELSE 'WebUrl' END"),
    "target": (lambda: T.uri_target("x"), "CASE WHEN lower(trim(x)) LIKE 'mailto:%' THEN trim(x)[8:] ELSE trim(x) END"),
})

ACTIONS = Fixture("actions", "id int, x string", rows("URI", "GoTo", "GoToR", "GoToE", "Launch", "JavaScript", "Named", None))
R.scalar("t14_classify_action", ACTIONS, {"kind": (lambda: T.classify_action("x"), sql_map(T.ACTIONS, "x", "'UnsupportedAction'"))})

SIZES = Fixture("sizes", "id int, x long", rows(0, 1, 1023, 1024, 1536, 1048576, 1600000, 5 << 30, 1075))
_TIDY = "regexp_replace(printf('%.1f', round_even({}, 1)), '\\.0$', '')"
R.scalar("t15_spoken_size", SIZES, {"y": (lambda: T.spoken_size("x"), "CASE WHEN x >= 1073741824 THEN " + _TIDY.format("x / 1073741824") + " || ' gigabytes' WHEN x >= 1048576 THEN " + _TIDY.format("x / 1048576") + " || ' megabytes' WHEN x >= 1024 THEN " + _TIDY.format("x / 1024") + " || ' kilobytes' ELSE x || ' bytes' END")})

CHARS = Fixture("characters", "id int, x string", rows(*T.CHARACTER_NAMES, "A", "É", "a", "7", " ", " ", "", "ß"))
R.scalar("t16_spell_character", CHARS, {"y": (lambda: T.spell("x"), f"CASE WHEN x = '' THEN 'blank' WHEN regexp_matches(x[1:1], '^{WS}$') THEN 'space' WHEN regexp_matches(x[1:1], '^\\p{{Lu}}$') THEN 'capital ' || lower(x[1:1]) ELSE {sql_map(T.CHARACTER_NAMES, 'x[1:1]', 'x')} END")})

DATES = Fixture("pdf_dates", "id int, x string", rows("D:20260331143005Z", "D:20260331143005+01'00'", "D:202603", "2026", "D:20260229", "20251230", "bad", "", None))


def _date(clamp: bool) -> str:
    d = "regexp_extract(x, '^(?:D:)?([0-9]{4,14})', 1)"
    part = lambda at, n, default: f"coalesce(try_cast(nullif({d}[{at}:{at + n - 1}], '') AS INTEGER), {default})"
    day = f"least({part(7, 2, 1)}, 28)" if clamp else part(7, 2, 1)
    text = f"printf('%04d-%02d-%02d %02d:%02d:%02d', {part(1, 4, 1)}, {part(5, 2, 1)}, {day}, {part(9, 2, 0)}, {part(11, 2, 0)}, {part(13, 2, 0)})"
    return f"CASE WHEN {d} <> '' THEN try_cast({text} AS TIMESTAMP) END"


R.scalar("t17_pdf_date_parse", DATES, {"at": (lambda: T.pdf_date("x"), _date(False)), "at_clamped": (lambda: T.pdf_date("x", True), _date(True))})
STAMPS = Fixture("stamps", "id int, ts timestamp, off int", rows(("2026-03-31 14:30:05", 60), ("2026-01-01 00:00:00", -330), ("2025-12-31 23:59:59", 0)))
R.scalar("t18_pdf_date_format", STAMPS, {"y": (lambda: T.pdf_date_text("ts", "off"), "'D:' || strftime(ts, '%Y%m%d%H%M%S') || CASE WHEN off < 0 THEN '-' ELSE '+' END || printf('%02d', abs(off) // 60) || '''' || printf('%02d', abs(off) % 60) || ''''")})

MARKUP = Fixture("markup", "id int, x string", rows("a < b & c > \"d\" 'e'", "&amp;", "plain", "", None, "(x) \\ y\tz\rw", "Zürich €5", "naïve Ā"))
R.scalar("t19_html_escape", MARKUP, {"y": (lambda: T.html_escape("x"), "replace(replace(replace(replace(replace(coalesce(x, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')")})
R.scalar("t21_standard_font", MARKUP, {"y": (lambda: T.standard_font("x"), r"NOT regexp_matches(x, '[^\x{0000}-\x{00FF}]')")})
R.scalar("t22_literal_string", MARKUP, {"y": (lambda: T.pdf_literal("x"), r"regexp_replace(replace(replace(replace(replace(replace(x, '\', '\\'), '(', '\('), ')', '\)'), chr(13), '\r'), chr(9), '\t'), '[^\x{0000}-\x{00FF}]', '?', 'g')")})
TAGS = Fixture("tags", "id int, x string", rows("en", "en-GB", "fr", "xx-YY", None))
R.scalar("t23_language_name", TAGS, {"y": (lambda: T.language_name("x"), sql_map(T.LANGUAGES, "x", "x"))})
KINDS = Fixture("kinds", "id int, kind string, content string, state string, pos string, verbosity string", rows(*((k, c, s, p, v) for k, (c, s, p) in zip(("Heading", "Paragraph", "Figure", "ListItem", "Unknown", "Unknown", "Link"), (("Revenue", "", "1 of 3"), ("Some text.", None, None), (None, "no description", ""), ("First", "", "item 1 of 3"), ("", "", ""), (" x ", None, "2"), ("", "", "")), strict=True) for v in ("Terse", "Normal", "Detailed"))))
ROLE = sql_map(T.ROLES, "kind", "''")
SOME = "nullif(trim(coalesce({}, '')), '')"
R.scalar("t24_role_name", KINDS, {"role": (lambda: T.role("kind"), ROLE)})
R.scalar("t25_describe", KINDS, {"y": (lambda: T.describe("kind", "content", "state", "pos", "verbosity"), f"coalesce(nullif(concat_ws(', ', CASE WHEN verbosity <> 'Terse' THEN nullif({ROLE}, '') END, {SOME.format('content')}, {SOME.format('state')}, CASE WHEN verbosity = 'Detailed' THEN {SOME.format('pos')} END), ''), nullif({ROLE}, ''), 'empty')")})
LOOKS = Fixture("appearances", "id int, da string, height double", rows(("/Helv 11 Tf 0 g", 20.0), ("/F1 0 Tf", 20.0), ("", 40.0), (None, 5.0), ("0 g /Helv 9.5 Tf", 12.0)))
TF = r"try_cast(nullif(regexp_extract(da, '([0-9]+\.?[0-9]*|\.[0-9]+)\s+Tf', 1), '') AS DOUBLE)"
R.scalar("t36_appearance_size", LOOKS, {"size": (lambda: T.appearance_size("da", "height"), f"CASE WHEN {TF} > 0 THEN {TF} ELSE greatest(6.0, least(14.0, 0.65 * height)) END")})
PLACES = Fixture("places", "id int, l double, b double, r double, t double, h double", rows((60.0, 700.0, 200.0, 720.0, 842.0), (190.5, 30.0, 300.0, 50.0, 842.0), (100.0, 400.0, 300.0, 430.0, 842.0)))
MID = "(b + t) / 2 / h"
R.scalar("t31_field_location", PLACES, {
    "left_mm": (lambda: T.place_on_page("l", "b", "r", "t", "h")["left_mm"], "CAST(round_even(l * 25.4 / 72, 0) AS INTEGER)"),
    "bottom_mm": (lambda: T.place_on_page("l", "b", "r", "t", "h")["bottom_mm"], "CAST(round_even(b * 25.4 / 72, 0) AS INTEGER)"),
    "third": (lambda: T.place_on_page("l", "b", "r", "t", "h")["third"], f"CASE WHEN {MID} < 1.0/3 THEN 'bottom' WHEN {MID} < 2.0/3 THEN 'middle' ELSE 'top' END"),
})

PAGES = Fixture("page_numbers", "id int, page int", tuple((i, p) for i, ps in enumerate(([1], [1, 2, 3], [1, 3, 4, 9], [1, 3, 5, 7, 9, 11], [1, 3, 5, 7, 9, 11, 13, 14], [2, 3, 3, 8])) for p in ps))


def t29(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = PAGES.df(spark).groupBy("id").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    return pages.select("id", T.page_ranges("pages").alias("y"))


R.add("t29_page_ranges", t29, f"""
WITH p AS (SELECT DISTINCT id, page FROM {PAGES.sql()}), g AS (SELECT id, page, page - row_number() OVER (PARTITION BY id ORDER BY page) AS k FROM p),
r AS (SELECT id, min(page) AS a, max(page) AS b FROM g GROUP BY id, k), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY a) AS i, count(*) OVER (PARTITION BY id) AS c FROM r)
SELECT id, string_agg(CASE WHEN a = b THEN a || '' ELSE a || ' to ' || b END, ', ' ORDER BY a) FILTER (WHERE i <= 6) || CASE WHEN max(c) > 6 THEN ' and others' ELSE '' END AS y FROM n GROUP BY id
""")  # fmt: skip


def t05_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition keys of all lines: how many lines share one."""
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    keys = lines.groupBy("lang", T.furniture_key("line").alias("key")).agg(F.count("*").alias("n"))
    return keys.groupBy("lang").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_lines"), F.max("n").alias("most"))


R.add("t05_repetition_keys_of_documents", t05_documents, r"""
WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT lang, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '\s+', ' ', 'g')) AS key, count(*) AS n FROM l GROUP BY ALL)
SELECT lang, count(*) AS n_keys, sum(n)::BIGINT AS n_lines, max(n) AS most FROM k GROUP BY lang
""")


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict:
    return R.sql
