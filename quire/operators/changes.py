"""Snapshots of documents compared, and edit logs folded. Logs stream through a fold in order; documents run in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold

#: The share of text that must remain, pages that its length is taken from, and the share of tags that makes a document tagged.
KEPT_TEXT, TEXT_PAGES, COVERAGE = 0.95, 20, 0.66
#: Confidence of edits in order.
CONFIDENCE = ("Safe", "Additive", "Rewrites", "Lossy")
COUNTERS = ("pages", "structure", "outline", "annotations", "fields")


def fingerprint(elements: DataFrame) -> DataFrame:
    """counters of a document version. elements: doc_id, version, page_no, kind, text, from_tags."""
    k = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return elements.groupBy("doc_id", "version").agg(
        k("Page").alias("pages"), F.count_if("from_tags").alias("structure"), k("Bookmark").alias("outline"), k("Annotation", "Link").alias("annotations"), k("FormField").alias("fields"),
        F.coalesce(F.sum(F.when(F.col("page_no") <= TEXT_PAGES, F.length("text"))), F.lit(0)).alias("text_len"), F.bool_or("from_tags").alias("tagged"),
    )


def losses(before: DataFrame, after: DataFrame, expected: DataFrame) -> DataFrame:
    """what each document lost: an array of messages. before, after: doc_id, COUNTERS, text_len, valid. expected: doc_id, d_<counter> (null: 0)."""
    names = (*COUNTERS, "text_len", "valid")
    j = before.select("doc_id", *(F.col(c).alias(f"b_{c}") for c in names)).join(after.select("doc_id", *(F.col(c).alias(f"a_{c}") for c in names)), "doc_id").join(expected, "doc_id", "left")
    out = []
    words = {"pages": "pages", "structure": "tags", "outline": "bookmarks", "annotations": "comments or links", "fields": "fields"}
    for c in COUNTERS:
        lack = F.col(f"b_{c}") + (F.coalesce(f"d_{c}", F.lit(0)) if c != "outline" else F.lit(0)) - F.col(f"a_{c}")
        text = F.concat(lack.cast("string"), F.lit(f" {words[c]}"))
        if c == "structure":
            text = F.when(F.col("a_structure") == 0, "all tags").otherwise(text)
        out.append(F.when(lack > 0, text))
    kept = F.col("a_text_len") / F.nullif(F.col("b_text_len"), F.lit(0))
    out.append(F.when(kept < KEPT_TEXT, F.concat(F.lit("about "), F.floor((1 - kept) * 100 + 1e-9).cast("string"), F.lit(" percent of text"))))
    found = F.when(~F.col("a_valid"), F.array(F.lit("unreadable"))).when(~F.col("b_valid"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*out)))
    return j.select("doc_id", F.array_join(found, "; ").alias("losses"), F.size(found).alias("n"))


def disagreement(readers: DataFrame, writers: DataFrame, signed: DataFrame) -> DataFrame:
    """what the reader sees and the writer would destroy. readers, writers: doc_id, has_structure. signed: doc_id."""
    j = readers.withColumnRenamed("has_structure", "r").join(writers.withColumnRenamed("has_structure", "w"), "doc_id", "full").join(signed.select("doc_id", F.lit(True).alias("s")).distinct(), "doc_id", "left")
    gone = F.coalesce("r", F.lit(False)) & ~F.coalesce("w", F.lit(False))
    return j.select("doc_id", gone.alias("would_destroy"), F.coalesce("s", F.lit(False)).alias("is_signed"), (~gone & F.col("s").isNull()).alias("safe"))


def expected_changes(log: DataFrame) -> DataFrame:
    """how the counters should change by the edits that stand. log: doc_id, op, is_unsaved."""
    op = F.col("op")
    net = F.count_if(op.isin("AddAnnotation", "ReplyAnnotation")) - F.count_if((op == "DeleteAnnotation") & ~F.col("is_unsaved"))
    return log.groupBy("doc_id").agg((-F.count_if(op == "FlattenSignature")).alias("d_fields"), net.alias("d_annotations"), (F.count_if(op == "AddTag") - F.count_if(op == "RemoveTag")).alias("d_structure"))


def dirty(documents: DataFrame, log: DataFrame) -> DataFrame:
    """F8: documents with something to save."""
    n = log.groupBy("doc_id").agg(F.count("*").alias("edits"))
    return documents.join(n, "doc_id", "left").select("doc_id", (F.col("unsaved") | F.col("flatten") | F.col("tag") | (F.coalesce("edits", F.lit(0)) > 0)).alias("dirty"))


def verified(before: DataFrame, after: DataFrame, missing: DataFrame) -> DataFrame:
    """after writing, the pages are as many, the first can be read and no field is missing."""
    m = missing.groupBy("doc_id").agg(F.count("*").alias("missing"))
    j = before.select("doc_id", F.col("pages").alias("b")).join(after.select("doc_id", "pages", "first_page_ok"), "doc_id", "left").join(m, "doc_id", "left")
    ok = F.coalesce((F.col("b") == F.col("pages")) & F.col("first_page_ok") & F.col("missing").isNull(), F.lit(False))
    return j.select("doc_id", ok.alias("ok"))


def publishable(docs: DataFrame) -> DataFrame:
    """the outcome of a guarded save, by the first test that stops it. docs: doc_id, dirty, writable, safe, verified, losses."""
    c = F.col
    return docs.select("doc_id", F.when(~c("dirty"), "no changes").when(~c("writable"), "refused").when(~c("safe"), "cancelled").when(~c("verified"), "failed").when(c("losses") != "", "cancelled").otherwise("saved").alias("outcome"))


def taggable(elements: DataFrame) -> DataFrame:
    """elements with bounds and a tag: none means refusal; a fully tagged document asks first."""
    n = F.count_if((F.col("r") > F.col("l")) & (F.col("t") > F.col("b")) & F.col("tag").isNotNull())
    g = elements.groupBy("doc_id").agg(n.alias("taggable"), F.bool_and("from_tags").alias("full"))
    return g.select("doc_id", "taggable", F.when(F.col("taggable") == 0, "refuse").when(F.col("full"), "confirm").otherwise("go on").alias("decision"))


MERGING = ("SetFieldValue", "EditAnnotation")


def merges(entry: tuple | list, op: str, target: str | None, s: float, window_seconds: float, ops: tuple[str, ...] | None) -> bool:
    """Whether an edit joins the open entry, which begins with op, target and the time of its first edit."""
    return (ops is None or op in ops) and op is not None and target is not None and entry[0] == op and entry[1] == target and s - entry[2] <= window_seconds


def merged_edits(log: DataFrame, window_seconds: float = 2.0, ops: tuple[str, ...] | None = MERGING) -> DataFrame:
    """Edits of one kind and target join the entry before them while they come within the window of that entry's first edit.

    Each decision depends on the entry that is open, so this is a fold over a document's log in order, not a session window; only that entry is held. log: doc_id, seq, made_at, op,
    target, value. Gives doc_id, entry (from 1), op, target, first_seq, n, value (the last one).
    """
    rows = log.select("doc_id", F.col("seq").cast("int").alias("seq"), F.col("made_at").cast("timestamp").cast("double").alias("s"), "op", F.col("target").cast("string").alias("target"), F.col("value").cast("string").alias("value"))

    def step(open_: list | None, row: tuple) -> tuple[list, list[tuple]]:
        seq, s, op, target, value = row  # open_: op, target, time, first_seq, n, value, number
        if open_ is not None and merges(open_, op, target, s, window_seconds, ops):
            open_[4:6] = open_[4] + 1, value
            return open_, []
        return [op, target, s, seq, 1, value, open_[6] + 1 if open_ else 1], done(open_)

    def done(open_: list | None) -> list[tuple]:
        return [] if open_ is None else [(open_[6], open_[0], open_[1], open_[3], open_[4], open_[5])]

    return fold(rows, "doc_id", ["seq", "s"], "entry int, op string, target string, first_seq int, n int, value string", step, done)


def undo_state(log: DataFrame) -> DataFrame:
    """What stands after a log of do, undo and redo: doc_id, done (ids in order), undone, refused (steps with nothing to act on)."""
    rows = log.select("doc_id", "seq", "op", F.col("target").cast("string").alias("id"))

    def step(state: tuple | None, row: tuple) -> tuple[tuple, list]:
        done, undone, refused = state or ([], [], 0)
        _, op, id_ = row
        source, goal = (done, undone) if op == "undo" else (undone, done)
        if op not in ("undo", "redo"):
            done.append(id_)
            undone = []
        elif source:
            goal.append(source.pop())
        else:
            refused += 1
        return (done, undone, refused), []

    text = lambda ids: ",".join(x for x in ids if x is not None)
    return fold(rows, "doc_id", ["seq"], "done string, undone string, refused int", step, lambda s: [(text(s[0]), text(s[1]), s[2])])


def throttled(events: DataFrame, gap: float) -> DataFrame:
    """Events that come at least ``gap`` seconds after the last one that was let through. events: doc_id, seq, made_at."""
    rows = events.select("doc_id", F.col("made_at").cast("timestamp").cast("double").alias("s"), F.col("seq").cast("bigint").alias("seq"))

    def step(last: float | None, row: tuple) -> tuple[float, list[tuple]]:
        s, seq = row
        return (last, []) if last is not None and s - last < gap else (s, [(seq,)])

    return fold(rows, "doc_id", ["s", "seq"], "seq bigint", step, lambda _: [])


def state_of(log: DataFrame) -> DataFrame:
    """The value that stands for each target and operation: that of the last edit."""
    return log.groupBy("doc_id", "op", "target").agg(F.max_by("value", "seq").alias("value"), F.count("*").alias("edits"))


def change_summary(log: DataFrame) -> DataFrame:
    """A4, E5: edits by kind, most first; of equals, the one that came first. Gives one line a document."""
    k = log.groupBy("doc_id", "op").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "first", F.concat_ws(" ", F.col("n").cast("string"), "op").alias("t"))))
    return k.groupBy("doc_id").agg(F.sum("n").alias("n"), F.array_join(F.transform(order, lambda s: s["t"]), ", ").alias("summary"))


def recent(log: DataFrame, most: int = 20) -> DataFrame:
    """The last edits, newest first."""
    w = Window.partitionBy("doc_id").orderBy(F.col("seq").desc())
    return log.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).select("doc_id", "n", "seq", "op", "target")


def confidence(op: Column, real_tags: Column) -> Column:
    """The ordinal of CONFIDENCE."""
    return F.when(op.isin("SetFieldValue", "SetLanguage", "SetTitle"), 0).when(op.isin("SetAltText", "SetFieldLabel", "AddAnnotation", "ReplyAnnotation"), 1).when(op == "SetHeadingLevel", F.when(real_tags, 2).otherwise(1)).when(op.isin("MarkArtifact", "DeleteAnnotation"), 3).otherwise(2)


def highest_risk(log: DataFrame) -> DataFrame:
    """A5: the least safe edit of each document by name."""
    return log.groupBy("doc_id").agg(F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.max(confidence(F.col("op"), F.col("real_tags"))) + 1).alias("risk"))


def deleted(log: DataFrame) -> DataFrame:
    """Annotations that stand deleted: the last step on each is a deletion that wasn't undone, and it had been saved before."""
    last = log.groupBy("doc_id", "target").agg(F.max_by(F.struct("op", "is_unsaved"), "seq").alias("s"))
    return last.filter("s.op = 'DeleteAnnotation' AND NOT s.is_unsaved").select("doc_id", "target")


def announcements(spoken: DataFrame) -> DataFrame:
    """Utterances up to the next interrupting one are one announcement. spoken: doc_id, seq, interrupts, text."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    s = spoken.withColumn("a", F.sum(F.col("interrupts").cast("int")).over(w))
    return s.groupBy("doc_id", "a").agg(F.min("seq").alias("seq"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text")).drop("a")


def coverage(marks: DataFrame) -> DataFrame:
    """A10: the share of shown text that a tag covers, and whether that is enough to call the document tagged. marks: doc_id, length, tag."""
    return marks.groupBy("doc_id").agg(F.bround(F.sum(F.when(F.col("tag").isNotNull(), F.col("length")).otherwise(0)) / F.sum("length"), 6).alias("coverage")).withColumn("tagged", F.col("coverage") >= COVERAGE)


def next_mark(streams: DataFrame) -> DataFrame:
    """The number behind the highest MCID in each content stream; 0 if there is none."""
    found = F.transform(F.regexp_extract_all("content", F.lit(r"/MCID\s+(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return streams.select("doc_id", "page_no", (F.coalesce(F.array_max(found), F.lit(-1)) + 1).alias("next_mcid"))
