"""Queries of snapshots and edit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import changes as E
from quire.sources import adapters as A

from .fixture import Fixture, Registry

R = Registry()
COLS = "doc_id int, pages int, structure int, outline int, annotations int, fields int, text_len int, valid boolean"
BEFORE = Fixture("before", COLS, ((1, 6, 40, 3, 5, 9, 1000, True), (2, 6, 40, 3, 5, 9, 1000, True), (3, 6, 40, 3, 5, 9, 1000, True), (4, 6, 40, 3, 5, 9, 1000, True), (5, 6, 40, 3, 5, 9, 1000, True), (6, 6, 40, 3, 5, 9, 0, True), (7, 6, 40, 3, 5, 9, 1000, False)))
AFTER = Fixture("after", COLS, ((1, 6, 40, 3, 5, 9, 1000, True), (2, 6, 0, 3, 5, 9, 950, True), (3, 6, 38, 2, 4, 8, 949, True), (4, 5, 38, 3, 4, 8, 1000, True), (5, 6, 40, 3, 5, 9, 1000, False), (6, 6, 40, 3, 5, 9, 0, True), (7, 1, 1, 1, 1, 1, 1, True)))
EXPECTED = Fixture("expected", "doc_id int, d_pages int, d_structure int, d_annotations int, d_fields int", ((3, 0, -2, 0, -1), (4, None, -1, -1, None)))
_lack = lambda c, d: f"b.{c} + coalesce({d}, 0) - a.{c}"
_msg = lambda c, d, w: f"CASE WHEN {_lack(c, d)} > 0 THEN ({_lack(c, d)}) || ' {w}' END"
ITEMS = ", ".join((_msg("pages", "d_pages", "pages"), f"CASE WHEN {_lack('structure', 'd_structure')} > 0 THEN CASE WHEN a.structure = 0 THEN 'all tags' ELSE ({_lack('structure', 'd_structure')}) || ' tags' END END", _msg("outline", "0", "bookmarks"), _msg("annotations", "d_annotations", "comments or links"), _msg("fields", "d_fields", "fields"),
                   "CASE WHEN b.text_len > 0 AND a.text_len / b.text_len < 0.95 THEN 'about ' || CAST(floor((1 - a.text_len / b.text_len) * 100 + 1e-9) AS INTEGER) || ' percent of text' END"))
LOSS = f"(SELECT b.doc_id, CASE WHEN NOT a.valid THEN ['unreadable'] WHEN NOT b.valid THEN [] ELSE list_filter([{ITEMS}], lambda x: x IS NOT NULL) END AS l FROM {BEFORE.sql()} b JOIN {AFTER.sql()} a ON a.doc_id = b.doc_id LEFT JOIN {EXPECTED.sql()} e ON e.doc_id = b.doc_id)"
R.add("f02_losses", lambda s, d: E.losses(BEFORE.df(s), AFTER.df(s), EXPECTED.df(s)), f"SELECT doc_id, coalesce(array_to_string(l, '; '), '') AS losses, CAST(len(l) AS INTEGER) AS n FROM {LOSS}")


def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the HTML pages as documents of one page."""
    e = A.page_elements(spark, sf_dir)
    return E.fingerprint(e.select("doc_id", F.lit(1).alias("version"), F.lit(1).alias("page_no"), F.when(F.col("kind") == "Title", "Page").otherwise(F.col("kind")).alias("kind"), "text", (F.col("kind") != "Link").alias("from_tags")))


R.add("f01_fingerprints", f01, f"SELECT doc_id, 1 AS version, count(*) FILTER (WHERE kind = 'Title') AS pages, count(*) FILTER (WHERE kind <> 'Link') AS structure, 0::BIGINT AS outline, count(*) FILTER (WHERE kind = 'Link') AS annotations, 0::BIGINT AS fields, coalesce(sum(length(text)), 0)::BIGINT AS text_len, bool_or(kind <> 'Link') AS tagged FROM {A.PAGE_ELEMENTS_SQL} GROUP BY doc_id")


def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inventories: the documents and those that carry labels; toxic ones count as signed."""
    labels = A.read(spark, sf_dir, "labels")
    docs = A.read(spark, sf_dir, "documents", "doc_id", "n_chars")
    return E.disagreement(docs.select("doc_id", (F.col("n_chars") > 500).alias("has_structure")), labels.select("doc_id", (F.col("quality") == 1).alias("has_structure")), labels.filter("toxic = 1"))


R.add("f03_f04_reader_writer_disagreement", f03, "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(n_chars > 500, FALSE) AND NOT coalesce(quality = 1, FALSE) AS would_destroy, coalesce(toxic = 1, FALSE) AS is_signed, NOT (coalesce(n_chars > 500, FALSE) AND NOT coalesce(quality = 1, FALSE)) AND NOT coalesce(toxic = 1, FALSE) AS safe FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id")
LOG = Fixture("log", "doc_id int, seq int, made_at timestamp, op string, target string, value string, is_unsaved boolean, real_tags boolean", (
    (1, 1, "2026-01-01 10:00:00", "SetFieldValue", "a", "1", False, False), (1, 2, "2026-01-01 10:00:01.5", "SetFieldValue", "a", "2", False, False), (1, 3, "2026-01-01 10:00:03", "SetFieldValue", "a", "3", False, False), (1, 4, "2026-01-01 10:00:03.5", "SetFieldValue", "b", "4", False, False),
    (2, 1, "2026-01-01 10:00:00", "SetAltText", "f", "x", False, False), (2, 2, "2026-01-01 10:00:01", "SetAltText", "f", "y", False, False), (2, 3, "2026-01-01 10:01:00", "SetLanguage", "doc", "en", False, False), (2, 4, "2026-01-01 10:02:00", "SetHeadingLevel", "h", "2", False, True),
    (3, 1, "2026-01-01 10:00:00", "AddAnnotation", "n1", "", True, False), (3, 2, "2026-01-01 10:00:05", "DeleteAnnotation", "n1", "", True, False), (3, 3, "2026-01-01 10:00:06", "DeleteAnnotation", "old", "", False, False), (3, 4, "2026-01-01 10:00:07", "FlattenSignature", "s", "", False, False), (3, 5, "2026-01-01 10:00:09", "AddTag", "t", "", False, False), (3, 6, "2026-01-01 10:00:09", "DeleteAnnotation", "back", "", False, False), (3, 7, "2026-01-01 10:00:10", "AddAnnotation", "back", "", False, False)))
R.add("f06_expected_changes", lambda s, d: E.expected_changes(LOG.df(s)), f"SELECT doc_id, -count(*) FILTER (WHERE op = 'FlattenSignature') AS d_fields, count(*) FILTER (WHERE op IN ('AddAnnotation', 'ReplyAnnotation')) - count(*) FILTER (WHERE op = 'DeleteAnnotation' AND NOT is_unsaved) AS d_annotations, count(*) FILTER (WHERE op = 'AddTag') - count(*) FILTER (WHERE op = 'RemoveTag') AS d_structure FROM {LOG.sql()} GROUP BY doc_id")
FLAGS = Fixture("flags", "doc_id int, unsaved boolean, flatten boolean, tag boolean, writable boolean, safe boolean, verified boolean, first_page_ok boolean, pages int", ((1, False, False, False, True, True, True, True, 6), (4, False, False, False, True, True, True, True, 5), (5, True, False, False, False, True, True, True, 6), (6, False, True, False, True, False, True, True, 6), (2, False, False, True, True, True, True, False, 6)))
R.add("f08_dirty", lambda s, d: E.dirty(FLAGS.df(s), LOG.df(s)), f"SELECT doc_id, unsaved OR flatten OR tag OR EXISTS (SELECT 1 FROM {LOG.sql()} l WHERE l.doc_id = f.doc_id) AS dirty FROM {FLAGS.sql()} f")
MISSING = Fixture("lost", "doc_id int, name string", ((1, "a"), (1, "b")))
R.add("f07_post_write_verify", lambda s, d: E.verified(BEFORE.df(s), FLAGS.df(s), MISSING.df(s)), f"SELECT b.doc_id, coalesce(b.pages = f.pages AND first_page_ok AND NOT EXISTS (SELECT 1 FROM {MISSING.sql()} m WHERE m.doc_id = b.doc_id), FALSE) AS ok FROM {BEFORE.sql()} b LEFT JOIN {FLAGS.sql()} f ON f.doc_id = b.doc_id")


def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = FLAGS.df(spark)
    j = f.join(E.dirty(f, LOG.df(spark)), "doc_id").join(E.losses(BEFORE.df(spark), AFTER.df(spark), EXPECTED.df(spark)), "doc_id")
    return E.publishable(j)


R.add("f05_guarded_publish", f05, f"SELECT f.doc_id, CASE WHEN NOT (unsaved OR flatten OR tag OR EXISTS (SELECT 1 FROM {LOG.sql()} g WHERE g.doc_id = f.doc_id)) THEN 'no changes' WHEN NOT writable THEN 'refused' WHEN NOT safe THEN 'cancelled' WHEN NOT verified THEN 'failed' WHEN len(l) > 0 THEN 'cancelled' ELSE 'saved' END AS outcome FROM {FLAGS.sql()} f JOIN {LOSS} x ON x.doc_id = f.doc_id")
BOUNDED = Fixture("bounded", "doc_id int, l double, b double, r double, t double, tag string, from_tags boolean", ((1, 0.0, 0.0, 5.0, 5.0, "P", False), (1, 0.0, 0.0, 0.0, 0.0, "P", False), (2, 1.0, 1.0, 2.0, 2.0, None, False), (3, 1.0, 1.0, 2.0, 2.0, "H1", True)))
R.add("f09_taggable", lambda s, d: E.taggable(BOUNDED.df(s)), f"SELECT doc_id, count(*) FILTER (WHERE r > l AND t > b AND tag IS NOT NULL) AS taggable, CASE WHEN count(*) FILTER (WHERE r > l AND t > b AND tag IS NOT NULL) = 0 THEN 'refuse' WHEN bool_and(from_tags) THEN 'confirm' ELSE 'go on' END AS decision FROM {BOUNDED.sql()} GROUP BY doc_id")
R.add("e01_state_of_log", lambda s, d: E.state_of(LOG.df(s)), f"SELECT doc_id, op, target, arg_max(value, seq) AS value, count(*) AS edits FROM {LOG.sql()} GROUP BY 1, 2, 3")
FOLD = """, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM g), r AS (SELECT doc_id, k, seq, op, target, value, made_at AS anchor, 1 AS entry FROM o WHERE k = 1
UNION ALL SELECT o.doc_id, o.k, o.seq, o.op, o.target, o.value, CASE WHEN {m} THEN r.anchor ELSE o.made_at END, CASE WHEN {m} THEN r.entry ELSE r.entry + 1 END FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1)
SELECT doc_id, CAST(entry AS INTEGER) AS entry, any_value(op) AS op, any_value(target) AS target, CAST(min(seq) AS INTEGER) AS first_seq, CAST(count(*) AS INTEGER) AS n, arg_max(value, k) AS value FROM r GROUP BY doc_id, entry"""
SAME = "o.op = r.op AND o.target = r.target AND o.op IN ('SetFieldValue', 'EditAnnotation') AND epoch(o.made_at) - epoch(r.anchor) <= 2"
R.add("e03_merged_edits", lambda s, d: E.merged_edits(LOG.df(s)), f"WITH RECURSIVE g AS {LOG.sql()}{FOLD.format(m=SAME)}")
EVENTS = "(SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts AS made_at, event_type AS op, '' AS target, '' AS value FROM events)"
R.add("e03_merged_events", lambda s, d: E.merged_edits(A.edit_events(s, d).withColumn("target", F.lit("")).withColumn("value", F.lit("")), 3600.0, None), f"WITH RECURSIVE g AS {EVENTS}{FOLD.format(m='o.op = r.op AND epoch(o.made_at) - epoch(r.anchor) <= 3600')}")
STEPS = Fixture("steps", "doc_id int, seq int, op string, target string", ((1, 1, "do", "a"), (1, 2, "do", "b"), (1, 3, "undo", ""), (1, 4, "redo", ""), (1, 5, "undo", ""), (1, 6, "undo", ""), (1, 7, "undo", ""), (2, 1, "do", "x"), (2, 2, "undo", ""), (2, 3, "do", "y"), (2, 4, "redo", "")))
R.add("e04_e02_undo_redo", lambda s, d: E.undo_state(STEPS.df(s)))
THROTTLED = """, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY made_at, seq) AS k FROM g), r AS (SELECT doc_id, k, seq, epoch(made_at) AS at_s, TRUE AS kept FROM o WHERE k = 1
UNION ALL SELECT o.doc_id, o.k, o.seq, CASE WHEN epoch(o.made_at) - r.at_s < {gap} THEN r.at_s ELSE epoch(o.made_at) END, epoch(o.made_at) - r.at_s >= {gap} FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1) SELECT doc_id, CAST(seq AS BIGINT) AS seq FROM r WHERE kept"""
R.add("e09_throttle", lambda s, d: E.throttled(A.edit_events(s, d), 3600.0), f"WITH RECURSIVE g AS {EVENTS}{THROTTLED.format(gap=3600)}")
R.add("a04_e05_change_summary", lambda s, d: E.change_summary(A.edit_events(s, d)), f"WITH k AS (SELECT doc_id, op, count(*) AS n, min(seq) AS f FROM {EVENTS} GROUP BY 1, 2) SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, string_agg(n || ' ' || op, ', ' ORDER BY n DESC, f) AS summary FROM k GROUP BY 1")
R.add("e05_o05_recent_edits", lambda s, d: E.recent(A.edit_events(s, d)), "SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(seq AS INTEGER) AS seq, op, target FROM (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS op, event_id AS target FROM events) WHERE n <= 20")
CONF = "CASE WHEN op IN ('SetFieldValue', 'SetLanguage', 'SetTitle') THEN 0 WHEN op IN ('SetAltText', 'SetFieldLabel', 'AddAnnotation', 'ReplyAnnotation') THEN 1 WHEN op = 'SetHeadingLevel' THEN CASE WHEN real_tags THEN 2 ELSE 1 END WHEN op IN ('MarkArtifact', 'DeleteAnnotation') THEN 3 ELSE 2 END"
R.add("a05_e06_highest_risk", lambda s, d: E.highest_risk(LOG.df(s)), f"SELECT doc_id, ['Safe', 'Additive', 'Rewrites', 'Lossy'][max({CONF}) + 1] AS risk FROM {LOG.sql()} GROUP BY doc_id")
R.add("e07_deleted_annotations", lambda s, d: E.deleted(LOG.df(s)), f"SELECT doc_id, target FROM (SELECT doc_id, target, arg_max(op, seq) AS op, arg_max(is_unsaved, seq) AS u FROM {LOG.sql()} GROUP BY 1, 2) WHERE op = 'DeleteAnnotation' AND NOT u")
SPOKEN = Fixture("utterances", "doc_id int, seq int, interrupts boolean, text string", ((1, 1, True, "Page 2."), (1, 2, False, "Heading"), (1, 3, True, "Stop"), (1, 4, False, "go"), (1, 5, False, "on"), (2, 1, False, "first"), (2, 2, True, "second")))
R.add("e08_announcements", lambda s, d: E.announcements(SPOKEN.df(s)), f"SELECT doc_id, min(seq) AS seq, string_agg(text, ' ' ORDER BY seq) AS text FROM (SELECT *, sum(CASE WHEN interrupts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS a FROM {SPOKEN.sql()}) GROUP BY doc_id, a")


def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the pages' text by tags other than links."""
    e = A.page_elements(spark, sf_dir).filter(F.length("text") > 0)
    return E.coverage(e.select("doc_id", F.length("text").alias("length"), F.when(F.col("kind").isin("Paragraph", "Heading"), "P").alias("tag")))


R.add("a10_coverage", a10, f"SELECT doc_id, round_even(sum(CASE WHEN kind IN ('Paragraph', 'Heading') THEN length(text) ELSE 0 END) / sum(length(text)), 6) AS coverage, round_even(sum(CASE WHEN kind IN ('Paragraph', 'Heading') THEN length(text) ELSE 0 END) / sum(length(text)), 6) >= 0.66 AS tagged FROM {A.PAGE_ELEMENTS_SQL} WHERE length(text) > 0 GROUP BY doc_id")
STREAMS = Fixture("streams", "doc_id int, page_no int, content string", ((1, 1, "/P <</MCID 0>> BDC EMC /P <</MCID 12>> BDC"), (1, 2, "BT ET"), (2, 1, "/Span <</MCID  7 >> BDC")))
R.add("a11_next_mcid", lambda s, d: E.next_mark(STREAMS.df(s)), rf"SELECT doc_id, page_no, CAST(coalesce(list_max(list_transform(regexp_extract_all(content, '/MCID\s+(\d+)', 1), lambda x: CAST(x AS INTEGER))), -1) + 1 AS INTEGER) AS next_mcid FROM {STREAMS.sql()}")


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict:
    return R.sql
