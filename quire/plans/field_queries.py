"""Queries of form-field rules and geometry over literal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import announce as AN
from quire.functions import fields as V
from quire.functions import geometry as G
from quire.functions import text as T

from .fixture import Fixture, Registry, sql_literal
from .text_queries import rows

R = Registry()
lits = lambda xs: ", ".join(map(sql_literal, xs))

RAW = Fixture("raw", "id int, x string", rows("3/4/2026", "31-03-2026", "2026-03-31", "1.2.2026", "4 Mar 2026", "4 March 2026", "12/25/2026", "not a date", "123", "1,200.50", "£1,200.50", "-5", "1e3", "abc", "", "name@example.org", "a@b", "a b@c.de", "+44 (0)20 7946-0958", "1234", "tel 12345", "14:30", "9:05", "2:15 pm", "25:00"))
NUM = "try_cast(replace(trim(x), ',', '') AS DOUBLE) IS NOT NULL"
CUR = r"try_cast(nullif(replace(regexp_replace(x, '[^\p{Nd}.,+\-]', '', 'g'), ',', ''), '') AS DECIMAL(38,10)) IS NOT NULL"
DATE = "strftime(coalesce(" + ", ".join(f"CASE WHEN regexp_full_match(trim(x), '{p}') THEN try_strptime(trim(x), '{f}') END" for p, f in (("\\d{1,2}/\\d{1,2}/\\d{4}", "%d/%m/%Y"), ("\\d{1,2}-\\d{1,2}-\\d{4}", "%d-%m-%Y"), ("\\d{4}-\\d{2}-\\d{2}", "%Y-%m-%d"), ("\\d{1,2}\\.\\d{1,2}\\.\\d{4}", "%d.%m.%Y"), ("\\d{1,2} [A-Za-z]{3} \\d{4}", "%d %b %Y"), ("\\d{1,2} [A-Za-z]+ \\d{4}", "%d %B %Y"), ("\\d{2}/\\d{2}/\\d{4}", "%m/%d/%Y"))) + "), '%d/%m/%Y')"
TIME = "strftime(coalesce(" + ", ".join(f"CASE WHEN regexp_full_match(upper(trim(x)), '{p}') THEN try_strptime(upper(trim(x)), '{f}') END" for p, f in (("\\d{1,2}:\\d{2}", "%H:%M"), ("\\d{1,2}:\\d{2}:\\d{2}", "%H:%M:%S"), ("\\d{1,2}:\\d{2} [AP]M", "%I:%M %p"), ("\\d{1,2} [AP]M", "%I %p"))) + "), '%H:%M')"
EMAIL = r"regexp_matches(x, '^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$')"
PHONE = r"(regexp_matches(x, '^[\p{Nd}+\-() .]*$') AND len(regexp_extract_all(x, '\p{Nd}')) >= 5)"
R.scalar("v03_number", RAW, {"ok": (lambda: V.is_number("x"), NUM)})
R.scalar("v04_currency", RAW, {"ok": (lambda: V.is_currency("x"), CUR)})
R.scalar("v05_digits", RAW, {"ok": (lambda: V.is_digits("x"), r"regexp_matches(x, '^\p{Nd}*$')")})
R.scalar("v06_date", RAW, {"y": (lambda: V.as_date("x"), DATE)})
R.scalar("v07_time", RAW, {"y": (lambda: V.as_time("x"), TIME)})
R.scalar("v08_email", RAW, {"ok": (lambda: V.is_email("x"), EMAIL)})
R.scalar("v09_telephone", RAW, {"ok": (lambda: V.is_telephone("x"), PHONE)})

VALUES = Fixture("typed", "id int, x string, fmt string, most int, multi boolean, ro boolean", rows(
    ("3/4/2026", "Date", None, False, False), ("not a date", "Date", None, False, False), ("123", "Comb", 6, False, False), ("123456", "Comb", 6, False, False), ("£1,200.50", "Currency", None, False, False),
    ("", "Date", None, False, False), ("  ", "Number", 3, False, False), ("too long a value", "PlainText", 8, False, False), ("line one\nline two", "PlainText", None, False, False), ("a\r\nb", "PlainText", None, True, False),
    ("name@example.org", "Email", None, False, False), ("nobody", "Email", None, False, False), ("12a", "DigitsOnly", 5, False, False), ("14:30", "Time", None, False, False), ("x", "PlainText", None, False, True), ("020 7946 0958", "Telephone", None, False, False),
))
W = "(CASE WHEN multi THEN replace(x, chr(13) || chr(10), chr(10)) ELSE trim(replace(x, chr(10), ' ')) END)"
at = lambda e: e.replace("(x", f"({W}").replace("trim(x)", f"trim({W})")
FITS = f"(CASE fmt WHEN 'Number' THEN {at(NUM)} WHEN 'Currency' THEN {at(CUR)} WHEN 'DigitsOnly' THEN regexp_matches({W}, '^\\p{{Nd}}*$') WHEN 'Date' THEN {at(DATE)} IS NOT NULL WHEN 'Time' THEN {at(TIME)} IS NOT NULL WHEN 'Email' THEN {at(EMAIL)} WHEN 'Telephone' THEN {at(PHONE)} ELSE TRUE END)"
REASON = f"(CASE WHEN @gate length({W}) = 0 THEN 'cleared' WHEN fmt = 'Comb' AND length({W}) <> most THEN 'length' WHEN length({W}) > most THEN 'too long' WHEN NOT {FITS} THEN 'format' ELSE 'set' END)"
STORED = f"CASE fmt WHEN 'Date' THEN {at(DATE)} WHEN 'Time' THEN {at(TIME)} ELSE {W} END"
_value = lambda: V.text_value("x", "fmt", "most", "multi")
for name, spark_value, gate in (("v02_text_apply", _value, ""), ("v01_set_value_gate", lambda: V.gated("ro", _value()), "ro THEN 'read-only' WHEN ")):
    reason = REASON.replace("@gate", gate)
    R.scalar(name, VALUES, {
        "accepted": ((lambda f=spark_value: f()["accepted"]), f"{reason} IN ('cleared', 'set')"),
        "value": ((lambda f=spark_value: f()["value"]), f"CASE {reason} WHEN 'cleared' THEN '' WHEN 'set' THEN {STORED} END"),
        "reason": ((lambda f=spark_value: f()["reason"]), reason),
    })

FORMATS = Fixture("formats", "id int, tooltip string, name string, comb boolean", rows(("Email address", "email", False), (None, "dateOfBirth", False), (None, "notes", False), ("Message", "msg", False), ("Amount (£)", "a1", False), ("Mobile phone", None, False), ("Postcode", "pc", False), ("Account number", "acc", False), ("Box", "b", True), ("Start time", "st", False), (None, None, False)))
HAY = "lower(coalesce(tooltip, '') || ' ' || coalesce(name, ''))"
R.scalar("v10_format_inference", FORMATS, {"fmt": (lambda: V.infer_format("tooltip", "name", "comb"), "CASE WHEN comb THEN 'Comb' " + " ".join(f"WHEN {' OR '.join(f'contains({HAY}, {sql_literal(n)})' for n in ns)} THEN '{k}'" for k, ns in V.FORMAT_WORDS.items()) + " ELSE 'PlainText' END")})
BOXES = Fixture("boxes", "id int, x string, on_name string, off_name string", rows(("yes", "Yes", "Off"), ("on", "A", "B"), ("TRUE", "A", "B"), ("1", "A", "B"), ("ticked", "A", "B"), ("off", "A", "B"), ("", "A", "B"), ("agree", "Agree", "Refuse"), ("refuse", "Agree", "Refuse"), ("maybe", "A", "B")))
R.scalar("v11_checkbox_words", BOXES, {"checked": (lambda: V.check_box("x", "on_name", "off_name"), f"CASE WHEN lower(trim(x)) IN ({lits(V.FALSE_WORDS)}) THEN FALSE WHEN lower(trim(x)) IN ({lits(V.TRUE_WORDS)}) THEN TRUE WHEN lower(trim(x)) = lower(on_name) THEN TRUE WHEN lower(trim(x)) = lower(off_name) THEN FALSE END")})

# Option matching: candidates by priority, the best one wins; a prefix counts only if it is unique.
OPTIONS = Fixture("options", "field int, ord int, export string, display string", ((1, 1, "UK", "United Kingdom"), (1, 2, "NL", "Netherlands"), (1, 3, "NZ", "New Zealand"), (2, 1, "Opt1", "By email"), (2, 2, "Opt2", "By phone"), (2, 3, "Opt3", "By post"), (3, 1, "a", "Alpha"), (3, 2, "b", "Beta"), (3, 3, "A", "Gamma")))
ASKED = Fixture("asked", "id int, field int, x string", rows((1, "Neth"), (1, "Ne"), (1, "nl"), (1, "New Zealand"), (1, "united kingdom"), (1, "France"), (2, "By phone"), (2, "opt3"), (3, "A"), (3, "a"), (3, "alp"), (1, "")))
MULTI = Fixture("multi", "id int, field int, x string", rows((1, "NL; NZ"), (1, "NL;nl;UK"), (1, "NL;France"), (3, "Alpha;Beta;Gamma"), (1, " ; UK")))


def match_option(asked: DataFrame, options: DataFrame, prefix: bool) -> DataFrame:
    """Id, export of the option that the text names, by exact and then case-blind comparison, then a unique prefix; null if none."""
    t = F.trim("x")
    o = options.withColumnRenamed("field", "_field")
    low = lambda c: F.lower(F.col(c))
    p = F.when(F.col("export") == t, 1)
    p = p.when(F.col("display") == t, 2).when(low("export") == F.lower(t), 3).when(low("display") == F.lower(t), 4) if prefix else p.when(low("export") == F.lower(t), 3).when(low("display") == F.lower(t), 4)
    if prefix:
        p = p.when(low("display").startswith(F.lower(t)), 5)
    j = asked.join(o, F.col("field") == F.col("_field")).filter(t != "").withColumn("p", p).filter("p IS NOT NULL")
    best = j.groupBy("id").agg(F.min(F.struct("p", "ord", "export")).alias("m"), F.count_if(F.col("p") == 5).alias("n"))
    best = best.select("id", F.when((F.col("m.p") < 5) | (F.col("n") == 1), F.col("m.export")).alias("export"))
    return asked.select("id").join(best, "id", "left")


def _match_sql(asked: Fixture, prefix: bool, ask: str = "") -> str:
    second = "WHEN display = trim(x) THEN 2" if prefix else ""
    last = "WHEN starts_with(lower(display), lower(trim(x))) THEN 5" if prefix else ""
    return f"""WITH a AS {ask or asked.sql()}, j AS (SELECT a.id, ord, export, CASE WHEN export = trim(x) THEN 1 {second} WHEN lower(export) = lower(trim(x)) THEN 3 WHEN lower(display) = lower(trim(x)) THEN 4 {last} END AS p
FROM a JOIN {OPTIONS.sql()} o ON a.field = o.field WHERE trim(x) <> ''), b AS (SELECT id, arg_min(export, p * 100 + ord) AS export, min(p) AS p, count(*) FILTER (WHERE p = 5) AS n FROM j WHERE p IS NOT NULL GROUP BY id)
SELECT a.id, CASE WHEN b.p < 5 OR b.n = 1 THEN b.export END AS export FROM a LEFT JOIN b ON a.id = b.id"""


R.add("v12_radio_match", lambda s, d: match_option(ASKED.df(s), OPTIONS.df(s), False), _match_sql(ASKED, False))
R.add("v13_choice_match", lambda s, d: match_option(ASKED.df(s), OPTIONS.df(s), True), _match_sql(ASKED, True))


def v14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several choices at once: all must match; the exports in order of first mention."""
    parts = MULTI.df(spark).select("id", "field", F.posexplode(F.filter(F.transform(F.split("x", ";"), lambda p: F.trim(p)), lambda p: p != "")).alias("n", "x"))
    keyed = parts.select((F.col("id") * 100 + F.col("n")).alias("id"), "field", "x")
    got = match_option(keyed, OPTIONS.df(spark), True).select((F.col("id") / 100).cast("int").alias("id"), (F.col("id") % 100).alias("n"), "export")
    first = got.groupBy("id", "export").agg(F.min("n").alias("n"))
    return first.groupBy("id").agg((F.count_if(F.col("export").isNull()) == 0).alias("accepted"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("export").isNotNull(), F.struct("n", "export")))), lambda s: s["export"]), ";").alias("exports"))


ASKS = f"(SELECT CAST(id * 100 + i - 1 AS INTEGER) AS id, field, p[i] AS x FROM (SELECT id, field, list_filter(list_transform(string_split(x, ';'), lambda q: trim(q)), lambda q: q <> '') AS p FROM {MULTI.sql()}), unnest(range(1, len(p) + 1)) AS u(i))"
R.add("v14_multi_choice", v14, f"WITH g AS ({_match_sql(MULTI, True, ASKS)}), f AS (SELECT id // 100 AS id, export, min(id % 100) AS n FROM g GROUP BY 1, 2) SELECT CAST(id AS INTEGER) AS id, count(*) FILTER (WHERE export IS NULL) = 0 AS accepted, coalesce(string_agg(export, ';' ORDER BY n), '') AS exports FROM f GROUP BY id")
PICKS = Fixture("picks", "id int, field int, n int", rows((1, 1), (1, 3), (1, 0), (1, 4), (2, 2), (3, -1)))


def v15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options by their place from 1; outside there is none."""
    o = OPTIONS.df(spark).groupBy("field").agg(F.array_sort(F.collect_list(F.struct("ord", "export"))).alias("o"))
    n = F.col("n")
    return PICKS.df(spark).join(o, "field").select("id", F.when((n >= 1) & (n <= F.size("o")), F.get("o", n - 1)["export"]).alias("export"), F.size("o").alias("options"))


R.add("v15_select_by_index", v15, f"SELECT p.id, o.export, CAST(c.options AS INTEGER) AS options FROM {PICKS.sql()} p LEFT JOIN {OPTIONS.sql()} o ON o.field = p.field AND o.ord = p.n JOIN (SELECT field, count(*) AS options FROM {OPTIONS.sql()} GROUP BY field) c ON c.field = p.field")
STATES = Fixture("states", "id int, ro boolean, req boolean, val boolean, bad boolean", tuple((i, *(bool(i >> k & 1) for k in range(4))) for i in range(16)))
R.scalar("v16_needs_attention", STATES, {"y": (lambda: V.needs_attention("ro", "req", "val", "bad"), "NOT ro AND req AND (NOT val OR bad)")})
ALTS = Fixture("alts", "id int, deco boolean, alt string, w double, px int", rows((False, None, 100.0, 300), (False, " ", 5.0, None), (True, None, 100.0, None), (False, "A chart", 7.9, 8), (False, "image", 0.0, 7), (False, "Photo ", 50.0, 60)))
R.scalar("v17_alt_needed", ALTS, {"y": (lambda: V.needs_alt("deco", "alt"), "NOT deco AND trim(coalesce(alt, '')) = ''")})
R.scalar("g07_decorative_by_size", ALTS, {"y": (lambda: V.tiny("w", "px"), "coalesce(w > 0 AND w < 8, FALSE) OR coalesce(px > 0 AND px < 8, FALSE)")})
R.scalar("v20_alt_text_input", ALTS, {"y": (lambda: V.good_alt("alt", T.USELESS_ALT), f"trim(coalesce(alt, '')) <> '' AND lower(trim(coalesce(alt, ''))) NOT IN ({lits(T.USELESS_ALT)})")})
BUTTONS = Fixture("buttons", "id int, action string, target string", tuple((i, a, t) for i, (a, t) in enumerate((a, t) for a in ("SubmitForm", "ResetForm", "OpenUrl", "GoToPage", "Print", "ImportData", "Script", "None") for t in (None, "https://example.org"))))
R.scalar("v18_button_policy", BUTTONS, {"policy": (lambda: V.button_policy("action", "target"), "CASE WHEN action IN ('SubmitForm', 'OpenUrl') AND trim(coalesce(target, '')) <> '' THEN 'confirm' WHEN action = 'ResetForm' THEN 'confirm' WHEN action = 'GoToPage' AND trim(coalesce(target, '')) <> '' THEN 'allowed' ELSE 'refused' END")})
TARGETS = Fixture("targets", "id int, kind string, x string, page int", rows(("WebUrl", "https://example.org", None), ("WebUrl", "ftp://example.org", None), ("Email", "a@b.org", None), ("InternalDestination", "p3", 3), ("InternalDestination", "p3", None), ("UnsupportedAction", "javascript:x", None), ("WebUrl", "", None), ("ExternalFile", "file:///a", None)))
SCHEME = r"lower(regexp_extract(x, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1))"
R.scalar("v19_link_policy", TARGETS, {"policy": (lambda: V.link_policy("kind", "x", "page"), f"CASE WHEN kind = 'UnsupportedAction' OR coalesce(x, '') = '' THEN 'refused' WHEN kind = 'InternalDestination' THEN CASE WHEN page IS NOT NULL THEN 'allowed' ELSE 'refused' END WHEN {SCHEME} <> '' AND {SCHEME} NOT IN ('http', 'https', 'mailto', 'file') THEN 'refused' ELSE 'confirm' END")})
GUIDED = Fixture("guided", "id int, req boolean, fmt string, most int, multi boolean", tuple((i, i % 2 == 0, f, m, w) for i, (f, m, w) in enumerate((("Number", None, False), ("DigitsOnly", 8, False), ("DigitsOnly", None, False), ("Comb", 6, False), ("Comb", None, False), ("PlainText", None, True), ("PlainText", 20, False), ("Date", None, False), ("Email", 40, False)))))
R.scalar("t32_field_guidance", GUIDED, {"y": (lambda: V.guidance("req", "fmt", "most", "multi"), "concat_ws('. ', CASE WHEN req THEN 'required' END, CASE WHEN fmt = 'DigitsOnly' AND most IS NOT NULL THEN 'enter ' || most || ' digits' WHEN fmt = 'Comb' AND most IS NOT NULL THEN 'enter exactly ' || most || ' characters, one per box' " + " ".join(f"WHEN fmt = '{k}' THEN '{v}'" for k, v in V.GUIDANCE.items()) + " WHEN multi THEN 'multi-line, press Alt+Enter for a new line' END, CASE WHEN most IS NOT NULL AND fmt NOT IN ('Comb', 'DigitsOnly') THEN 'at most ' || most || ' characters' END)")})
SPOKEN = Fixture("spoken", "id int, x string, pw boolean, multi boolean", rows(("", False, False), (None, True, False), ("secret", True, False), ("one\ntwo\nthree", False, True), ("one ", False, True), ("a\nb", False, False)))
R.scalar("t27_value_in_speech", SPOKEN, {"y": (lambda: V.text_in_speech("x", "pw", "multi"), "CASE WHEN coalesce(x, '') = '' THEN 'blank' WHEN pw THEN length(x) || ' characters entered' WHEN multi AND contains(x, chr(10)) THEN rtrim(string_split(x, chr(10))[1]) || ', ' || len(string_split(x, chr(10))) || ' lines in total' ELSE x END")})

VALUES = Fixture("fieldvalues", "id int, field_kind string, checked boolean, option string, position int, options int, picked string, typed string, signed boolean, signer string, signed_on timestamp, reason string", rows(
    ("CheckBox", True, None, 0, 0, "", None, False, None, None, None), ("CheckBox", False, None, 0, 0, "", None, False, None, None, None), ("RadioGroup", False, "By post", 3, 3, "", None, False, None, None, None), ("RadioGroup", False, None, 0, 3, "", None, False, None, None, None),
    ("Choice", False, "Wales", 2, 4, "Wales", None, False, None, None, None), ("Choice", False, None, 0, 4, "", None, False, None, None, None), ("Choice", False, None, 0, 4, "Wales|Kent", "", False, None, None, None), ("Choice", False, None, 0, 4, "", "Leeds", False, None, None, None),
    ("Signature", False, None, 0, 0, "", None, False, "Ann", None, None), ("Signature", False, None, 0, 0, "", None, True, "Ann", "2026-04-03 10:00:00", "Agreed"), ("Signature", False, None, 0, 0, "", None, True, "", None, None), ("PushButton", False, None, 0, 0, "", None, False, None, None, None)))


def t27(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.when(F.col("picked") == "", F.array().cast("array<string>")).otherwise(F.split("picked", r"\|"))
    return VALUES.df(spark).withColumn("chosen", chosen).select("id", AN.value_in_speech().alias("y"))


R.add("t27_values_of_all_fields", t27, f"""SELECT id, CASE field_kind WHEN 'CheckBox' THEN CASE WHEN checked THEN 'checked' ELSE 'not checked' END WHEN 'RadioGroup' THEN CASE WHEN option IS NULL THEN 'nothing selected, ' || options || ' options' ELSE option || ', ' || position || ' of ' || options END
WHEN 'Choice' THEN CASE WHEN coalesce(typed, '') <> '' THEN typed || ', typed in' WHEN picked = '' THEN 'nothing selected, ' || options || ' options' WHEN strpos(picked, '|') = 0 THEN option || ', ' || position || ' of ' || options ELSE len(string_split(picked, '|')) || ' of ' || options || ' selected: ' || replace(picked, '|', ', ') END
WHEN 'Signature' THEN CASE WHEN signed THEN concat_ws(', ', 'signed', 'by ' || nullif(signer, ''), 'on ' || strftime(signed_on, '%-d %B %Y'), 'reason: ' || nullif(reason, '')) ELSE 'not signed' END ELSE '' END AS y FROM {VALUES.sql()}""")
ANNOTS = Fixture("annots", "side string, id int, source string, subtype string, l double, b double, r double, t double", (("old", 1, "s1", "Highlight", 1.0, 1.0, 9.0, 9.0), ("old", 2, None, "Text", 20.0, 20.0, 30.0, 30.0), ("old", 3, None, "Ink", 0.0, 0.0, 5.0, 5.0), ("new", 11, "s1", "Underline", 50.0, 50.0, 60.0, 60.0), ("new", 12, None, "Text", 20.9, 19.2, 30.0, 30.5), ("new", 13, None, "Ink", 2.0, 0.0, 5.0, 5.0)))


def v21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new annotations that are the same one: by source id, else by kind and nearly equal rectangles."""
    a = ANNOTS.df(spark)
    old, new = a.filter("side = 'old'").alias("o"), a.filter("side = 'new'").alias("n")
    near = F.lit(True)
    for c in "lbrt":
        near = near & (F.abs(F.col(f"o.{c}") - F.col(f"n.{c}")) <= 1.0)
    by_id = old.join(new, F.col("o.source") == F.col("n.source")).select(F.col("o.id").alias("old_id"), F.col("n.id").alias("new_id"))
    rest = old.join(by_id, F.col("o.id") == F.col("old_id"), "left_anti")
    by_place = rest.join(new, (F.col("o.subtype") == F.col("n.subtype")) & near).select(F.col("o.id").alias("old_id"), F.col("n.id").alias("new_id"))
    return by_id.unionByName(by_place)


R.add("v21_annotation_identity", v21, f"WITH a AS {ANNOTS.sql()}, i AS (SELECT o.id AS old_id, n.id AS new_id FROM a o JOIN a n ON o.side = 'old' AND n.side = 'new' AND o.source = n.source) SELECT * FROM i UNION ALL SELECT o.id, n.id FROM a o JOIN a n ON o.side = 'old' AND n.side = 'new' AND o.subtype = n.subtype AND abs(o.l - n.l) <= 1 AND abs(o.b - n.b) <= 1 AND abs(o.r - n.r) <= 1 AND abs(o.t - n.t) <= 1 WHERE o.id NOT IN (SELECT old_id FROM i)")


def v22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the documents that the standard Latin glyph set lacks, spaces and controls aside."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chars = docs.select("lang", F.explode(F.array_distinct(F.split("text", ""))).alias("c")).filter(~F.col("c").rlike(r"^[\s\p{Cc}\p{Cf}\p{Z}]?$"))
    glyphs = spark.range(33, 127).select(F.chr("id").alias("c"))
    return chars.groupBy("lang", "c").agg(F.count("*").alias("n_docs")).join(glyphs, "c", "left_anti")


R.add("v22_glyph_coverage", v22, r"WITH c AS (SELECT DISTINCT doc_id, lang, unnest(string_split(text, '')) AS c FROM documents) SELECT lang, c, count(*) AS n_docs FROM c WHERE NOT regexp_full_match(c, '[\s\p{Cc}\p{Cf}\p{Z}]?') AND NOT (unicode(c) BETWEEN 33 AND 126) GROUP BY lang, c")

BOUNDS = Fixture("regions", "id int, l double, b double, r double, t double, l2 double, b2 double, r2 double, t2 double", rows((100.0, 400.0, 300.0, 500.0, 200.0, 350.0, 420.0, 450.0), (0.0, 0.0, 0.0, 0.0, 10.0, 10.0, 20.0, 20.0), (10.0, 100.0, 50.0, 112.0, 60.0, 108.0, 90.0, 119.0), (10.0, 100.0, 50.0, 112.0, 60.0, 99.5, 90.0, 111.0)))
R.scalar("g01_region_algebra", BOUNDS, {
    "width": (lambda: G.width(G.region("l", "b", "r", "t")), "r - l"), "height": (lambda: G.height(G.region("l", "b", "r", "t")), "t - b"),
    "is_empty": (lambda: G.is_empty(G.region("l", "b", "r", "t")), "r - l <= 0 OR t - b <= 0"),
    "union_l": (lambda: G.union(G.region("l", "b", "r", "t"), G.region("l2", "b2", "r2", "t2"))["l"], "CASE WHEN r - l <= 0 OR t - b <= 0 THEN l2 WHEN r2 - l2 <= 0 OR t2 - b2 <= 0 THEN l ELSE least(l, l2) END"),
    "union_t": (lambda: G.union(G.region("l", "b", "r", "t"), G.region("l2", "b2", "r2", "t2"))["t"], "CASE WHEN r - l <= 0 OR t - b <= 0 THEN t2 WHEN r2 - l2 <= 0 OR t2 - b2 <= 0 THEN t ELSE greatest(t, t2) END"),
})
R.scalar("g02_shares_line", BOUNDS, {"y": (lambda: G.shares_line(G.region("l", "b", "r", "t"), G.region("l2", "b2", "r2", "t2"), 0.5), "least(t - b, t2 - b2) > 0 AND least(t, t2) - greatest(b, b2) > 0.5 * least(t - b, t2 - b2)")})
BOXED = Fixture("boxed", "id int, l double, b double, r double, t double, w double, h double, s double, pad double", rows((100.0, 400.0, 300.0, 500.0, 595.0, 842.0, 1.0, 0.0), (100.0, 400.0, 300.0, 500.0, 595.0, 842.0, 2.0, 0.0), (100.0, 400.0, 300.0, 500.0, 595.0, 842.0, 1.0, 10.0), (0.0, 0.0, 595.0, 842.0, 595.0, 842.0, 1.0, 20.0)))
X0, X1, Y0, Y1 = "greatest(0.0, l - pad) * s", "least(w, r + pad) * s", "greatest(0.0, h - t - pad) * s", "least(h, h - b + pad) * s"
R.scalar("g03_image_rectangle", BOXED, {n: ((lambda n=n: G.image_rectangle("l", "b", "r", "t", "w", "h", "s", "pad")[n]), f"CAST({e} AS INTEGER)") for n, e in (("x", f"round_even({X0}, 0)"), ("y", f"round_even({Y0}, 0)"), ("width", f"round_even({X1} - {X0}, 0)"), ("height", f"round_even({Y1} - {Y0}, 0)"))})
POINTS = Fixture("strokes", "id int, stroke int, x double, y double", ((1, 1, 0.1, 0.2), (1, 1, 0.6, 0.9), (1, 2, 1.4, 0.5), (2, 1, 0.5, 0.5), (3, 1, 0.5, 0.5), (3, 1, 0.55, 0.52), (4, 1, -0.5, 0.0), (4, 1, 0.2, 2.0), (4, 2, 0.9, 0.9), (4, 2, 0.95, 0.1)))


def g05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent of a drawn mark: strokes of one point go, points are held within 0 to 1; small marks are suspicious."""
    p = POINTS.df(spark).withColumns({c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) for c in "xy"})
    p = p.withColumn("n", F.count("*").over(Window.partitionBy("id", "stroke")))
    live = p.filter("n >= 2").groupBy("id").agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("e"))
    out = p.select("id").distinct().join(live, "id", "left").select("id", F.coalesce("e", F.lit(0.0)).alias("extent"))
    return out.withColumn("suspicious", F.col("extent") < 0.15)


R.add("g05_drawn_extent", g05, f"WITH p AS (SELECT id, stroke, greatest(0, least(1, x)) AS x, greatest(0, least(1, y)) AS y, count(*) OVER (PARTITION BY id, stroke) AS n FROM {POINTS.sql()}), e AS (SELECT id, greatest(max(x) - min(x), max(y) - min(y)) AS e FROM p WHERE n >= 2 GROUP BY id) SELECT i.id, coalesce(e, 0.0) AS extent, coalesce(e, 0.0) < 0.15 AS suspicious FROM (SELECT DISTINCT id FROM p) i LEFT JOIN e ON e.id = i.id")
R.scalar("g06_pitch", POINTS, {"pitch": (lambda: F.bround(G.pitch("x", "y"), 6), "round_even(220 * pow(2, greatest(0, least(1, x)) + 1 - greatest(0, least(1, y))), 6)")}, "id,stroke,x,y")


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict:
    return R.sql
