"""Audit queries: every rule on a faulty literal corpus, and the report over the HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import audit as AU
from quire.sources import adapters as A
from quire.sources import markup as M

from .fixture import Fixture, Registry, sql_literal
from .structure_queries import LINES
from .text_queries import HUMAN, PX, READABLE, VAGUE, WS

R = Registry()
DOCS = Fixture("docs", "doc_id int, title string, language string, displays_title boolean, tagged_status string, page_count int, has_outline boolean", (
    (1, None, None, True, "Untagged", 2, False), (2, "Scan", "en", True, "ScannedWithoutText", 3, False), (3, "Report", " ", False, "PartiallyTagged", 6, True), (4, "Good", "en-GB", True, "FullyTagged", 3, False), (5, "Long", "de", True, "Untagged", 4, True)))
PAGES = Fixture("pgs", "doc_id int, page_no int, height double, is_image_only boolean", tuple((d, p, 842.0, d == 2) for d, n in ((1, 2), (2, 3), (3, 6), (4, 3), (5, 4)) for p in range(1, n + 1)))
ELEMENTS = Fixture("els", "doc_id int, reading_order int, page_no int, kind string, level int, text string, b double", (
    (1, 2, 1, "Heading", 1, "Annual Report", 780.0), (1, 3, 1, "Paragraph", None, "This is the opening paragraph.", 700.0), (1, 4, 1, "Heading", 2, "Revenue", 650.0), (1, 12, 2, "Heading", 4, "Detailed figures", 780.0),
    *((3, 10 * p, p, "Paragraph", None, f"Form HB1  Page {p} of 6", 40.0) for p in range(1, 7)), (3, 3, 1, "Heading", None, " ", 780.0), (3, 5, 1, "Heading", 1, "", 700.0), (3, 15, 2, "Artifact", None, "Artifact text", 30.0), (4, 1, 1, "Heading", 1, "A", 500.0), (4, 2, 1, "Heading", 2, "B", 400.0), (4, 3, 2, "Heading", 1, "C", 500.0)))
FIGURES = Fixture("figs", "doc_id int, reading_order int, page_no int, decorative boolean, alt string, width double, height double, caption string", ((1, 10, 1, False, None, 250.0, 200.0, None), (3, 20, 2, False, "", 5.0, 100.0, None), (3, 21, 2, False, None, 7.0, 7.0, "dots"), (3, 22, 2, True, None, 50.0, 50.0, None), (3, 23, 2, False, " ", 50.0, 50.0, "Figure 1"), (4, 5, 1, False, "A chart", 90.0, 90.0, None)))
LINKS = Fixture("lks", "doc_id int, reading_order int, page_no int, text string, description string", ((1, 9, 1, "click here", None), (3, 30, 3, "Here", ""), (3, 31, 3, "more", "described"), (3, 32, 4, "", None), (4, 6, 2, "Annual report 2026", None)))
FIELDS = Fixture("flds", "doc_id int, reading_order int, page_no int, field_kind string, tooltip string, recovered string, name string", ((1, 20, 2, "Text", None, None, "Text1"), (3, 40, 5, "Text", None, "Full name", "f1"), (3, 41, 5, "Text", None, None, "dateOfBirth"), (3, 42, 5, "PushButton", None, None, "b"), (4, 7, 3, "Text", "Name", None, "n")))
CELLS = Fixture("cls", "doc_id int, reading_order int, page_no int, row_no int, column_index int, role string", ((1, 13, 2, 0, 0, "Data"), (1, 13, 2, 0, 1, "Data"), (1, 13, 2, 1, 0, "Data"), (1, 13, 2, 1, 1, "Data"), (4, 8, 3, 0, 0, "ColumnHeader"), (4, 8, 3, 0, 1, "ColumnHeader"), (4, 8, 3, 1, 0, "Data"), (4, 8, 3, 1, 1, "Data"), (4, 9, 3, 0, 0, "Data"), (4, 9, 3, 0, 1, "Data")))


def corpus(spark: SparkSession) -> AU.Corpus:
    return AU.Corpus(*(f.df(spark) for f in (DOCS, PAGES, ELEMENTS, FIGURES, LINKS, FIELDS, CELLS)))


def issue_sql(name: str, severity: object, fix: str, source: str, case: str, page: str = "0", n: str = "1", at: str = "NULL", arg1: str = "NULL", arg2: str = "NULL") -> str:
    text = lambda x: x if x.startswith("CASE") else sql_literal(x)
    return (
        f"SELECT doc_id, CAST({severity} AS INTEGER) AS severity, '{name}' AS rule, {text(fix)} AS fixability, CAST({page} AS INTEGER) AS page_no, CAST({n} AS BIGINT) AS n, CAST({at} AS BIGINT) AS reading_order, "
        f'{text(case)} AS "case", CAST({arg1} AS VARCHAR) AS arg1, CAST({arg2} AS VARCHAR) AS arg2 FROM {source}'
    )


def first_sql(name: str, severity: int, fix: str, source: str, one: str, many: str, *args: str) -> str:
    more = "".join(f", arg_min({a}, reading_order) AS a{k}" for k, a in enumerate(args))
    inner = f"(SELECT doc_id, arg_min(page_no, reading_order) AS p, count(*) AS n, min(reading_order) AS o{more} FROM {source} GROUP BY doc_id)"
    return issue_sql(name, severity, fix, inner, f"CASE WHEN n = 1 THEN '{one}' ELSE '{many}' END", "p", "n", "o", *(f"a{k}" for k in range(len(args))))


def short_sql(text: str) -> str:
    return f"CASE WHEN length({text}) <= 40 THEN {text} ELSE rtrim(({text})[1:37]) || '…' END"


def rule_sql(t: dict[str, str], name: str = "CAST(doc_id AS VARCHAR)") -> dict[str, str]:
    """SQL of each rule over the given tables."""
    src = f"CASE WHEN trim(coalesce(tooltip, '')) <> '' THEN 'tooltip' WHEN trim(coalesce(recovered, '')) <> '' THEN 'nearby' WHEN {READABLE.replace('(x', '(' + PX)} THEN 'name' ELSE 'none' END"
    label = f"CASE src WHEN 'nearby' THEN trim(recovered) WHEN 'name' THEN {HUMAN.replace('(x', '(' + PX)} END"
    key = f"trim(regexp_replace(regexp_replace(lower(e.text), '[0-9]+', '#', 'g'), '{WS}', ' ', 'g'))"
    tiny = "(coalesce(width > 0 AND width < 8, FALSE) OR coalesce(height > 0 AND height < 8, FALSE))"
    need = "NOT decorative AND trim(coalesce(alt, '')) = ''"
    runs = f"(SELECT doc_id, min(page_no) AS a, max(page_no) AS z FROM (SELECT doc_id, page_no, page_no - row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS g FROM {t['pages']} WHERE is_image_only) GROUP BY doc_id, g)"
    ranges = f"(SELECT doc_id, string_agg(CASE WHEN a = z THEN a || '' ELSE a || ' to ' || z END, ', ' ORDER BY a) FILTER (WHERE k <= 6) || CASE WHEN max(k) > 6 THEN ' and others' ELSE '' END AS runs FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM {runs}) GROUP BY doc_id)"
    r = {}
    r["R1 scanned pages"] = issue_sql("R1 scanned pages", 0, AU.NOT, f"(SELECT s.doc_id, s.n, s.p, page_count, runs FROM (SELECT doc_id, count(*) AS n, min(page_no) AS p FROM {t['pages']} WHERE is_image_only GROUP BY 1) s JOIN {t['documents']} d ON d.doc_id = s.doc_id JOIN {ranges} q ON q.doc_id = s.doc_id)", "CASE WHEN n = page_count THEN 'scan_all' ELSE 'scan_some' END", "p", "n", arg1="CASE WHEN n <> page_count THEN runs END")
    r["R2 unlabelled fields"] = issue_sql("R2 unlabelled fields", "CASE WHEN src = 'none' THEN 0 ELSE 2 END", AU.INPUT, f"(SELECT *, {src} AS src FROM {t['fields']} WHERE field_kind NOT IN ('PushButton', 'Signature')) WHERE src <> 'tooltip'", "CASE WHEN TRUE THEN 'label_' || src END", "page_no", at="reading_order", arg1=label)
    r["R3 missing image descriptions"] = (
        issue_sql("R3 missing image descriptions", 1, AU.INPUT, f"{t['figures']} WHERE {need} AND NOT {tiny}", "CASE WHEN trim(coalesce(caption, '')) = '' THEN 'image' ELSE 'image_caption' END", "page_no", at="reading_order")
        + " UNION ALL " + first_sql("R3 missing image descriptions", 3, AU.AUTO, f"(SELECT * FROM {t['figures']} WHERE {need} AND {tiny})", "tiny", "tiny")
    )
    r["R4 document tagging"] = issue_sql("R4 document tagging", "CASE WHEN tagged_status = 'Untagged' THEN 1 ELSE 2 END", AU.INPUT, f"{t['documents']} WHERE tagged_status IN ('Untagged', 'PartiallyTagged')", "CASE WHEN tagged_status = 'Untagged' THEN 'untagged' ELSE 'partly' END")
    r["R5 tables without headers"] = issue_sql("R5 tables without headers", 1, AU.INPUT, f"(SELECT doc_id, reading_order, page_no, count(*) || ' by ' || max(n) AS size FROM (SELECT doc_id, reading_order, page_no, row_no, count(*) AS n, bool_or(role <> 'Data') AS h FROM {t['cells']} GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3 HAVING NOT bool_or(h) AND count(*) >= 2 AND max(n) >= 2)", "table", "page_no", at="reading_order", arg1="size")
    r["R6 document language"] = issue_sql("R6 document language", 2, AU.AUTO, f"{t['documents']} WHERE trim(coalesce(language, '')) = ''", "language")
    r["R7 no headings"] = issue_sql("R7 no headings", "CASE WHEN has_outline THEN 2 ELSE 1 END", AU.INPUT, f"{t['documents']} WHERE page_count >= 3 AND tagged_status <> 'ScannedWithoutText' AND doc_id NOT IN (SELECT doc_id FROM {t['elements']} WHERE kind = 'Heading')", "CASE WHEN has_outline THEN 'headings_outline' ELSE 'headings' END", arg1="page_count")
    r["R8 skipped heading levels"] = first_sql("R8 skipped heading levels", 2, AU.INPUT, f"(SELECT * FROM (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY reading_order) AS prev FROM {t['elements']} WHERE kind = 'Heading' AND level IS NOT NULL) WHERE level > prev + 1)", "skip", "skips", short_sql("text"), "level")
    r["R9 unclear link text"] = first_sql("R9 unclear link text", 2, AU.INPUT, f"(SELECT * FROM {t['links']} WHERE {VAGUE.replace('(x', '(text')} AND trim(coalesce(description, '')) = '')", "link", "links")
    r["R10 document title"] = issue_sql("R10 document title", 3, f"CASE WHEN trim(coalesce(title, '')) = '' THEN '{AU.INPUT}' ELSE '{AU.AUTO}' END", f"{t['documents']} WHERE trim(coalesce(title, '')) = '' OR NOT displays_title", "CASE WHEN trim(coalesce(title, '')) = '' THEN 'title' ELSE 'title_hidden' END", arg1=f"CASE WHEN trim(coalesce(title, '')) = '' THEN {name} ELSE title END")
    r["R11 unmarked page furniture"] = issue_sql("R11 unmarked page furniture", 2, AU.AUTO, f"(SELECT k.doc_id, n, p, o, x FROM (SELECT e.doc_id, {key} AS key, count(*) AS n, min(reading_order) AS o, arg_min(e.page_no, reading_order) AS p, arg_min({short_sql('e.text')}, reading_order) AS x FROM {t['elements']} e JOIN {t['pages']} g ON g.doc_id = e.doc_id AND g.page_no = e.page_no WHERE kind <> 'Artifact' AND length(trim(e.text)) >= 3 AND (b >= 0.88 * height OR b <= 0.12 * height) GROUP BY 1, 2) k JOIN {t['documents']} d ON d.doc_id = k.doc_id WHERE length(key) >= 3 AND page_count >= 5 AND n >= greatest(4, page_count // 2))", "furniture", "p", "n", "o", "x")
    r["R12 empty headings"] = first_sql("R12 empty headings", 2, AU.AUTO, f"(SELECT * FROM {t['elements']} WHERE kind = 'Heading' AND trim(coalesce(text, '')) = '')", "empty", "empties")
    return r


def worded_sql(issues: str) -> str:
    """The issues with title, consequence and remedy."""
    words = []
    for k, column in enumerate(("title", "consequence", "remedy")):
        text = 'CASE "case" ' + " ".join(f"WHEN '{case}' THEN {sql_literal(m[k])}" for case, m in AU.MESSAGES.items()) + " END"
        words.append(f"replace(replace(replace({text}, '{{n}}', n || ''), '{{1}}', coalesce(arg1, '')), '{{2}}', coalesce(arg2, '')) AS {column}")
    return f"(SELECT *, {', '.join(words)} FROM ({issues}))"


LITERAL = {"documents": DOCS.sql(), "pages": PAGES.sql(), "elements": ELEMENTS.sql(), "figures": FIGURES.sql(), "links": LINKS.sql(), "fields": FIELDS.sql(), "cells": CELLS.sql()}
BY_RULE = rule_sql(LITERAL)
for _name, _rule in AU.RULES.items():
    R.add(_name.lower().replace(" ", "_").replace("r", "r0", 1) if _name[2] == " " else _name.lower().replace(" ", "_"), lambda s, d, f=_rule: f(corpus(s)), BY_RULE[_name])
ALL = " UNION ALL ".join(f"SELECT * FROM ({q})" for q in BY_RULE.values())
REPORT = f"SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY severity, page_no, title, reading_order NULLS FIRST, rule) AS INTEGER) AS n_in_report FROM {worded_sql(ALL)}"
R.add("o01_audit_report", lambda s, d: AU.report(AU.audit(corpus(s))), REPORT)
SAID = "['Blocking problem', 'Serious problem', 'Problem', 'Suggestion'][severity + 1]"
R.add("r_spoken_issues", lambda s, d: AU.spoken(AU.worded(AU.audit(corpus(s))), "Detailed").select("doc_id", "rule", "reading_order", "spoken"), f"SELECT doc_id, rule, reading_order, concat_ws('. ', {SAID}, title, CASE WHEN n > 1 THEN n || ' times' END, CASE WHEN page_no > 0 THEN 'page ' || page_no END, consequence, remedy) || '.' AS spoken FROM {worded_sql(ALL)}")
SUMS = f"(SELECT doc_id, count(*) AS issues, count(*) FILTER (WHERE severity = 0) AS blockers, count(*) FILTER (WHERE severity = 1) AS serious, count(*) FILTER (WHERE fixability <> '{AU.NOT}') AS fixable, count(*) FILTER (WHERE fixability = '{AU.NOT}') AS not_fixable FROM ({ALL}) GROUP BY 1)"
R.add("a06_severity_counts", lambda s, d: AU.summary(AU.audit(corpus(s))), f"SELECT * FROM {SUMS}")
TAGGED = "CASE tagged_status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AU.TAGGING.items()) + " ELSE 'of unknown structure' END"
SUMMARY = f"""SELECT d.doc_id, CASE WHEN issues IS NULL THEN d.doc_id || ' has no accessibility problems that this editor can detect. It is ' || {TAGGED}
ELSE concat_ws('. ', d.doc_id || ': ' || issues || CASE WHEN issues = 1 THEN ' problem found' ELSE ' problems found' END, CASE WHEN blockers > 0 THEN blockers || CASE WHEN blockers = 1 THEN ' blocks' ELSE ' block' END || ' reading altogether' END,
CASE WHEN serious > 0 THEN serious || ' serious' END, CASE WHEN fixable = 0 THEN 'none of them can be repaired here' ELSE fixable || ' can be repaired here' END, 'The document is ' || {TAGGED}) END || '.' AS text FROM {DOCS.sql()} d LEFT JOIN {SUMS} s ON s.doc_id = d.doc_id"""
R.add("r_summary_text", lambda s, d: AU.summary_text(DOCS.df(s), AU.summary(AU.audit(corpus(s)))), SUMMARY)
DONE = Fixture("done", "doc_id int, rule string, reading_order int", ((1, "R3 missing image descriptions", 10), (1, "R6 document language", None), (3, "R9 unclear link text", 99)))
R.add("r_guided_repair", lambda s, d: AU.repairs(AU.audit(corpus(s)), DONE.df(s)), f"SELECT doc_id, rule, reading_order, CASE string_split(rule, ' ')[1] {' '.join(f'WHEN {sql_literal(k)} THEN {sql_literal(v)}' for k, v in AU.REPAIRS.items())} ELSE 'explain' END AS repair_action FROM ({ALL}) i WHERE NOT EXISTS (SELECT 1 FROM {DONE.sql()} r WHERE r.doc_id = i.doc_id AND r.rule = i.rule AND r.reading_order IS NOT DISTINCT FROM i.reading_order)")
POS = Fixture("pos", "doc_id int, position int", ((1, 0), (1, 10), (1, 13), (1, 20), (3, 30)))
R.add("n06_next_issue", lambda s, d: AU.next_issue(AU.audit(corpus(s)), POS.df(s)), f"SELECT p.doc_id, p.position, min(i.reading_order) AS reading_order, arg_min(i.rule, i.reading_order * 10 + i.severity) AS rule FROM {POS.sql()} p JOIN ({ALL}) i ON i.doc_id = p.doc_id AND i.reading_order > p.position GROUP BY 1, 2")

# ---- Corpora: HTML pages, pages made from customers, and plain text documents ---------------------------------------------
HEIGHT = 842.0
COVERED = 0.66


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def _field_kind() -> Column:
    kind = F.lower(F.coalesce(F.nullif(_attr("type"), F.lit("")), F.when(F.col("tag") == "button", "button").otherwise("text")))
    return F.when(F.col("tag") == "select", "ChoiceList").when(kind.isin("submit", "button", "reset", "image"), "PushButton").when(kind == "checkbox", "CheckBox").when(kind == "radio", "RadioGroup").otherwise("Text")


#: What the audit reads of pages: elements of these kinds, of the first two with their text.
AUDITED = ("Title", "Heading", "Link", "Figure", "FormField", "TableCell")


def audited(rows: list[list]) -> list[tuple]:
    """A page's elements that the audit reads (rows of M.tree), and two rows for the lengths of its runs and of its loose texts. Other elements have no part in it, and would be most of what is dealt out."""
    out, held, loose = [], 0, 0
    for element, _, nth, _, _, tag, kind, attrs, text, _ in rows:
        if kind == "Run":
            held += len(text.strip(" "))
        elif kind in AUDITED:
            out.append((element, None, nth, tag, kind, attrs, text if kind in ("Title", "Heading", "Link") else "", 0))
        elif tag == "#text":
            loose += len(text.strip(" "))
        elif tag == "html":
            out.append((element, None, nth, tag, kind, attrs, "", 0))
    if rows:
        out += [(LAST, None, 0, "#text", "Run", {}, "", held), (LAST, None, 0, "#text", "Paragraph", {}, "", loose)]
    return out


#: The number that the two rows of lengths have, behind all elements.
LAST = (1 << 31) - 1


def markup_parts(pages: DataFrame, whole: bool = False) -> DataFrame:
    """Elements of pages with all that the audit reads, and the lengths of their runs of text (said). Every page is a document of one page. A field's label is what names it, be it aria-label, title or a label. whole: all elements and runs, with their texts."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    number = lambda name: _attr(name).try_cast("double")
    k = F.col("kind")
    if whole:
        e = M.page_tree(pages).withColumn("said", F.length(F.trim("text")))
    else:
        e = M.over_trees(pages, audited, "element_id int, parent_id int, sibling_ord int, tag string, kind string, attrs map<string,string>, text string, said int")
    return e.select(
        "doc_id", F.col("element_id").cast("long").alias("reading_order"), F.lit(1).alias("page_no"), "kind", F.when(k == "Heading", F.substring("tag", 2, 1).cast("int")).alias("level"), "text", F.lit(HEIGHT / 2).alias("b"), F.lit(HEIGHT).alias("height"),
        F.coalesce(_attr("alt") == "", F.lit(False)).alias("decorative"), _attr("alt").alias("alt"), F.lit(None).cast("string").alias("caption"), number("width").alias("width"), number("height").alias("image_height"),
        F.coalesce(some(_attr("aria-label")), _attr("title")).alias("description"), F.coalesce(some(_attr("aria-label")), some(_attr("title")), some(_attr("#label"))).alias("tooltip"), some(T.tidy_label(_attr("#before"))).alias("recovered"), _attr("name").alias("name"),
        F.when(k == "FormField", _field_kind()).alias("field_kind"), F.when(F.col("tag") == "th", "ColumnHeader").otherwise("Data").alias("role"), F.when(k == "TableCell", _attr("#table").try_cast("long")).alias("table_id"), F.col("sibling_ord").alias("nth"), "parent_id", "tag", _attr("lang").alias("lang"), "said",
    )


def markup_facts() -> dict[str, tuple[str, Column]]:
    """A page's own facts. It counts as tagged by the share of its text, without title and furniture, that stands in elements which say what it is."""
    kind = F.col("kind")
    length = lambda test: ("sum", F.when(test, F.col("said")).otherwise(0))
    return {
        "held": length(kind == "Run"), "loose": length((kind == "Paragraph") & (F.col("tag") == "#text")), "figures": ("max", (kind == "Figure").cast("int")),
        "heading": ("min", F.when(kind == "Title", F.struct("reading_order", "text"))), "lang": ("max", F.when(F.col("tag") == "html", F.col("lang"))), "name": ("max", F.col("doc_id")),
    }


def markup_documents() -> dict[str, Column]:
    c = F.col
    total = c("held") + c("loose")
    status = F.when(total == 0, F.when(c("figures") == 1, "ScannedWithoutText").otherwise("Untagged")).when(c("held") >= COVERED * total, "FullyTagged").when(c("held") > 0, "PartiallyTagged").otherwise("Untagged")
    return {
        "title": c("heading.text"), "language": c("lang"), "displays_title": F.lit(True), "tagged_status": status, "page_count": F.lit(1), "has_outline": F.lit(False),
        "doc_name": c("name").cast("string"), "scanned": F.when(status == "ScannedWithoutText", F.array(F.lit(1))).otherwise(F.array().cast("array<int>")),
    }


def markup_issues(pages: DataFrame) -> DataFrame:
    return AU.audit_once(markup_parts(pages), markup_facts(), markup_documents())


def markup_corpus(pages: DataFrame) -> AU.Corpus:
    """The same pages as separate tables, for the rules one by one."""
    e = markup_parts(pages, whole=True)
    docs = e.groupBy("doc_id").agg(*(AU.MERGE[how](v).alias(k) for k, (how, v) in markup_facts().items()))
    docs = docs.select("doc_id", *(v.alias(k) for k, v in markup_documents().items())).withColumnRenamed("doc_name", "name")
    cells = e.filter("kind = 'TableCell'").select("doc_id", F.col("table_id").alias("reading_order"), "page_no", F.col("parent_id").alias("row_no"), F.lit(0).alias("column_index"), "role")
    pages_ = docs.select("doc_id", F.lit(1).alias("page_no"), F.lit(HEIGHT).alias("height"), (F.size("scanned") > 0).alias("is_image_only"))
    real = e.filter("kind <> 'Run'")
    figures = real.filter("kind = 'Figure'").select("doc_id", "reading_order", "page_no", "decorative", "alt", "width", F.col("image_height").alias("height"), "caption")
    links = real.filter("kind = 'Link'").select("doc_id", "reading_order", "page_no", "text", "description")
    fields = real.filter("kind = 'FormField'").select("doc_id", "reading_order", "page_no", "field_kind", "tooltip", "recovered", "name")
    return AU.Corpus(docs, pages_, real.select("doc_id", "reading_order", "page_no", "kind", "level", "text", "b"), figures, links, fields, cells)


def text_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text documents: lines are elements, LINES_PER_PAGE of them a page. Only texts that a rule reads go on."""
    at = F.col("reading_order") % A.LINES_PER_PAGE
    e = A.document_lines(spark, sf_dir).withColumn("b", HEIGHT * (1 - (at + 1) / (A.LINES_PER_PAGE + 1))).withColumn("height", F.lit(HEIGHT))
    e = e.withColumn("text", F.when((F.col("kind") == "Heading") | AU._banded(e), F.col("text")))
    none = lambda kind: F.lit(None).cast(kind)
    e = e.select(
        "doc_id", F.col("reading_order").cast("long").alias("reading_order"), "page_no", "kind", none("int").alias("level"), "text", "b", "height", "lang", F.lit(False).alias("decorative"),
        *(none("string").alias(n) for n in ("alt", "caption", "description", "tooltip", "recovered", "name", "field_kind", "role")), *(none("double").alias(n) for n in ("width", "image_height")), none("long").alias("table_id"), none("int").alias("nth"),
    )
    facts = {
        "heading": ("min", F.when((F.col("kind") == "Heading") & ~T.blank("text"), F.struct("reading_order", "text"))), "language": ("max", F.col("lang")), "pages": ("max", F.col("page_no")), "name": ("max", F.col("doc_id")),
    }
    return AU.audit_once(e, facts, {
        "title": F.col("heading.text"), "language": F.col("language"), "displays_title": F.lit(True), "tagged_status": F.lit("Untagged"), "page_count": F.col("pages"), "has_outline": F.lit(False),
        "doc_name": F.col("name").cast("string"), "scanned": F.array().cast("array<int>"),
    })


def page_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of the given pages and of those made from customers."""
    given = markup_issues(A.given_pages(spark, sf_dir)).withColumn("corpus", F.lit("pages"))
    return given.unionByName(markup_issues(A.customer_pages(spark, sf_dir)).withColumn("corpus", F.lit("customers")))


#: The trees that the SQL of the audit reads.
TREES = f"given AS MATERIALIZED {M.tree_sql()}, made AS MATERIALIZED {M.tree_sql(f'({A.CUSTOMER_PAGES})')}"


def markup_sql(table: str) -> dict[str, str]:
    """The tables of markup_corpus in DuckDB, over one of TREES."""
    some = lambda x: f"nullif(trim({x}), '')"
    at = M.attribute_sql
    tidy = rf"regexp_replace(regexp_replace(before, '[:*†‡_\s]+$', ''), '^[*†‡\s]+', '')"
    kind = f"lower(coalesce(nullif({at('type')}, ''), CASE WHEN tag = 'button' THEN 'button' ELSE 'text' END))"
    e = f"""(SELECT doc_id, element_id AS reading_order, 1 AS page_no, kind, CASE WHEN kind = 'Heading' THEN CAST(tag[2:2] AS INTEGER) END AS level, text, {HEIGHT / 2} AS b, coalesce({at('alt')} = '', FALSE) AS decorative, {at('alt')} AS alt, NULL AS caption, TRY_CAST({at('width')} AS DOUBLE) AS width, TRY_CAST({at('height')} AS DOUBLE) AS height,
coalesce({some(at('aria-label'))}, {at('title')}) AS description, coalesce({some(at('aria-label'))}, {some(at('title'))}, {some('label')}) AS tooltip, {some(f"CASE WHEN length({tidy}) > 80 THEN '' ELSE {tidy} END")} AS recovered, {at('name')} AS name,
CASE WHEN tag = 'select' THEN 'ChoiceList' WHEN {kind} IN ('submit', 'button', 'reset', 'image') THEN 'PushButton' WHEN {kind} = 'checkbox' THEN 'CheckBox' WHEN {kind} = 'radio' THEN 'RadioGroup' ELSE 'Text' END AS field_kind,
CASE WHEN tag = 'th' THEN 'ColumnHeader' ELSE 'Data' END AS role, table_id AS t, parent_id AS row_no, tag, {at('lang')} AS lang FROM {table})"""
    docs = f"""(SELECT doc_id, title, language, TRUE AS displays_title, CASE WHEN total = 0 THEN CASE WHEN figure THEN 'ScannedWithoutText' ELSE 'Untagged' END WHEN marked >= {COVERED} * total THEN 'FullyTagged' WHEN marked > 0 THEN 'PartiallyTagged' ELSE 'Untagged' END AS tagged_status, 1 AS page_count, FALSE AS has_outline
FROM (SELECT doc_id, arg_min(text, reading_order) FILTER (WHERE kind = 'Title') AS title, max(lang) FILTER (WHERE tag = 'html') AS language, coalesce(sum(length(trim(text))) FILTER (WHERE kind = 'Run' OR (kind = 'Paragraph' AND tag = '#text')), 0) AS total, coalesce(sum(length(trim(text))) FILTER (WHERE kind = 'Run'), 0) AS marked, coalesce(bool_or(kind = 'Figure'), FALSE) AS figure FROM {e} GROUP BY doc_id))"""
    of = lambda k: f"(SELECT * FROM {e} WHERE kind = '{k}')"
    return {
        "documents": docs, "pages": f"(SELECT doc_id, 1 AS page_no, {HEIGHT} AS height, tagged_status = 'ScannedWithoutText' AS is_image_only FROM {docs})", "elements": f"(SELECT doc_id, reading_order, page_no, kind, level, text, b FROM {e} WHERE kind <> 'Run')",
        "figures": of("Figure"), "links": of("Link"), "fields": of("FormField"), "cells": f"(SELECT doc_id, t AS reading_order, page_no, row_no, role FROM {e} WHERE kind = 'TableCell')",
    }


def all_sql(tables: dict[str, str], name: str) -> str:
    rules = " UNION ALL ".join(f"SELECT * FROM ({q})" for q in rule_sql(tables).values())
    return f"SELECT *, '{name}' AS corpus FROM ({rules})"


TEXT_E = f"(SELECT doc_id, reading_order, page_no, kind, NULL::INTEGER AS level, text, lang, {HEIGHT} * (1 - (reading_order % {A.LINES_PER_PAGE} + 1) / {A.LINES_PER_PAGE + 1}.0::DOUBLE) AS b FROM {LINES})"
EMPTY = "(SELECT 1 AS doc_id, 1 AS reading_order, 1 AS page_no, FALSE AS decorative, '' AS alt, '' AS caption, 0.0 AS width, 0.0 AS height, '' AS text, '' AS description, '' AS field_kind, '' AS tooltip, '' AS recovered, '' AS name, 1 AS row_no, '' AS role WHERE FALSE)"
TEXT_TABLES = {
    "documents": f"(SELECT doc_id, arg_min(text, reading_order) FILTER (WHERE kind = 'Heading' AND trim(text) <> '') AS title, max(lang) AS language, TRUE AS displays_title, 'Untagged' AS tagged_status, max(page_no) AS page_count, FALSE AS has_outline FROM {TEXT_E} GROUP BY doc_id)",
    "pages": f"(SELECT DISTINCT doc_id, page_no, {HEIGHT} AS height, FALSE AS is_image_only FROM {TEXT_E})", "elements": TEXT_E, "figures": EMPTY, "links": EMPTY, "fields": EMPTY, "cells": EMPTY,
}
PAGE_SQL = all_sql(markup_sql("given"), "pages") + " UNION ALL " + all_sql(markup_sql("made"), "customers")
TEXT_SQL = all_sql(TEXT_TABLES, "documents")
R.add("audit_of_pages", page_issues, f"WITH {TREES} {PAGE_SQL}")
R.add("audit_of_documents", text_issues, TEXT_SQL.replace(", 'documents' AS corpus", ""))
R.add("audit_rules_over_pages", lambda s, d: markup_issues(A.customer_pages(s, d)), f"WITH {TREES} " + all_sql(markup_sql("made"), "customers").replace(", 'customers' AS corpus", ""))


def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of all corpora by severity and rule: in how many documents, and how many findings."""
    issues = page_issues(spark, sf_dir).unionByName(text_issues(spark, sf_dir).withColumn("corpus", F.lit("documents")))
    g = issues.groupBy("corpus", "severity", "rule", "case").agg(F.count_distinct("doc_id").alias("documents"), F.sum("n").alias("findings"))
    return g.select("corpus", F.element_at(F.array(*map(F.lit, AU.SEVERITIES)), F.col("severity") + 1).alias("severity"), "rule", "case", "documents", "findings")


R.add("audit_report_of_pages", page_report, f"WITH {TREES} SELECT corpus, ['blocker', 'serious', 'moderate', 'advisory'][severity + 1] AS severity, rule, \"case\", count(DISTINCT doc_id) AS documents, CAST(sum(n) AS BIGINT) AS findings FROM ({PAGE_SQL} UNION ALL {TEXT_SQL}) GROUP BY corpus, severity, rule, \"case\"")
R.add("s05_c16_page_elements", lambda s, d: A.page_elements(s, d), f"SELECT * FROM {A.PAGE_ELEMENTS_SQL}")
R.add("t13_link_targets_of_pages", lambda s, d: A.page_elements(s, d).filter("kind = 'Link'").groupBy(T.classify_uri("href").alias("target_kind"), T.vague_link("text").alias("vague")).agg(F.count("*").alias("n")), f"SELECT CASE WHEN trim(coalesce(href, '')) = '' THEN 'Unknown' WHEN lower(trim(href)) LIKE 'mailto:%' THEN 'Email' WHEN lower(trim(href)) LIKE 'file:%' THEN 'ExternalFile' WHEN lower(trim(href)) LIKE 'javascript:%' THEN 'UnsupportedAction' ELSE 'WebUrl' END AS target_kind, {VAGUE.replace('(x', '(text')} AS vague, count(*) AS n FROM {A.PAGE_ELEMENTS_SQL} WHERE kind = 'Link' GROUP BY 1, 2")
R.add("a01_views_of_pages", lambda s, d: A.page_elements(s, d).groupBy("doc_id").agg(*(F.count_if(F.col("kind") == k).alias(k.lower() + "s") for k in ("Heading", "Link", "Paragraph", "ListItem", "Artifact"))), "SELECT doc_id, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k.lower()}s" for k in ("Heading", "Link", "Paragraph", "ListItem", "Artifact")) + f" FROM {A.PAGE_ELEMENTS_SQL} GROUP BY doc_id")
R.add("w01_list_items_of_pages", lambda s, d: _items(s, d), f"WITH e AS {A.PAGE_ELEMENTS_SQL}, x AS (SELECT *, count(*) FILTER (WHERE kind = 'List') OVER (PARTITION BY doc_id ORDER BY reading_order) AS list_no FROM e) SELECT doc_id, CAST(reading_order AS INTEGER) AS reading_order, CAST(row_number() OVER (PARTITION BY doc_id, list_no ORDER BY reading_order) AS INTEGER) AS item, count(*) OVER (PARTITION BY doc_id, list_no) AS items FROM x WHERE kind = 'ListItem'")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item n of N of each list."""
    w = Window.partitionBy("doc_id").orderBy("reading_order")
    e = A.page_elements(spark, sf_dir).withColumn("list_no", F.count_if(F.col("kind") == "List").over(w)).filter("kind = 'ListItem'")
    p = Window.partitionBy("doc_id", "list_no")
    return e.select("doc_id", "reading_order", F.row_number().over(p.orderBy("reading_order")).alias("item"), F.count("*").over(p).alias("items"))


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict:
    return R.sql
