"""Text search in reading order, with context and the heading that a match stands under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.arrays import let, sums_before

CONTEXT = 70


def offsets(text: Column, term: str, match_case: bool = False) -> Column:
    """Q2: places (from 0) of matches that don't overlap, found from left to right."""
    t, x = (term, text) if match_case else (term.lower(), F.lower(text))
    parts = F.transform(F.split(x, r"\Q" + t + r"\E"), lambda p: F.length(p))
    gaps = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return let(gaps, lambda g: F.transform(F.zip_with(sums_before(g), g, lambda before, own: before + own), lambda at, k: at + k * len(t)))


def whole_word(text: Column, at: Column, length: int) -> Column:
    """Q3: the neighbours are no letters or digits."""
    inner = r"[\p{L}\p{Nd}]"
    before = F.when(at > 0, F.substring(text, at, F.lit(1)).rlike(inner)).otherwise(False)
    return ~before & ~F.substring(text, at + length + 1, F.lit(1)).rlike(inner)


def context(text: Column, at: Column, length: int, radius: int = CONTEXT) -> Column:
    """Q4: up to ``radius`` characters to each side, cut at word edges, with ellipses where something is left out."""
    left = F.greatest(F.lit(0), at - radius)
    right = F.least(F.length(text), at + length + radius)
    before = F.substring(text, left + 1, at - left)
    after = F.substring(text, at + length + 1, right - at - length)
    cut_left = (left > 0) & ~F.substring(text, left, F.lit(1)).rlike(r"\s")
    before = F.when(cut_left, F.regexp_replace(before, r"^\S+", "")).otherwise(before)
    cut_right = (right < F.length(text)) & ~F.substring(text, right + 1, F.lit(1)).rlike(r"\s")
    after = F.when(cut_right, F.regexp_replace(after, r"\S+$", "")).otherwise(after)
    body = F.trim(F.concat(before, F.substring(text, at + 1, F.lit(length)), after))
    whole_left = (left == 0) & ~cut_left
    return F.concat(F.when(whole_left, "").otherwise("… "), body, F.when((right == F.length(text)) & ~cut_right, "").otherwise(" …"))


def search(elements: DataFrame, term: str, match_case: bool = False, words_only: bool = False, artifacts: bool = False, fields: bool = True, annotations: bool = True) -> DataFrame:
    """One row a match: doc_id, reading_order, page_no, place, context, heading, n, total. A blank term matches nothing."""
    term = term.strip()
    e = elements
    for on, kind in ((artifacts, "Artifact"), (fields, "FormField"), (annotations, "Annotation")):
        if not on:
            e = e.filter(F.col("kind") != kind)
    # Only elements with a match and headings are sorted; the nearest earlier heading is the one a match stands under.
    hit = F.contains(F.col("text"), F.lit(term)) if match_case else F.contains(F.lower("text"), F.lit(term.lower()))
    e = e.withColumn("_hit", hit & F.lit(bool(term)))
    w = Window.partitionBy("doc_id").orderBy("reading_order")
    e = e.filter((F.col("kind") == "Heading") | F.col("_hit")).withColumn("heading", last_heading(w)).filter("_hit")
    m = e.withColumn("place", F.explode(offsets(F.col("text"), term or "\u0000", match_case)))
    if words_only:
        m = m.filter(whole_word(F.col("text"), F.col("place"), len(term)))
    m = m.withColumn("context", context(F.col("text"), F.col("place"), len(term)))
    order = Window.partitionBy("doc_id").orderBy("reading_order", "place")
    return m.select("doc_id", "reading_order", "page_no", "place", "context", "heading", F.row_number().over(order).alias("n"), F.count("*").over(Window.partitionBy("doc_id")).alias("total"))


def last_heading(w) -> Column:
    """The nearest earlier heading that isn't empty."""
    head = F.when((F.col("kind") == "Heading") & (F.trim("text") != ""), F.col("text"))
    return F.last(head, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))


def next_match(matches: DataFrame) -> DataFrame:
    """Q6: the numbers of the next and the previous match, wrapping round."""
    return matches.select("doc_id", "n", ((F.col("n") % F.col("total")) + 1).cast("int").alias("next_n"), ((F.col("n") + F.col("total") - 2) % F.col("total") + 1).cast("int").alias("previous_n"))
