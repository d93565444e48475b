"""Matching of elements by place, order and name. Range conditions always come with the equality of document and page, so they run as hash or merge joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

PAGE = ["doc_id", "page_no"]


def _boxes(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    return df.select(*PAGE, *(F.col(c).alias(f"{prefix}{c}") for c in ("l", "b", "r", "t")), *(F.col(c).alias(f"{prefix}{c}") for c in keep))


def _hits(x: DataFrame, y: DataFrame, hit: Column) -> DataFrame:
    """Rows of x with those of y on the same page that they hit, or with none; x's rows stay dealt by page."""
    y = y.withColumnsRenamed({"doc_id": "_doc", "page_no": "_page"})
    return x.join(y, (F.col("doc_id") == F.col("_doc")) & (F.col("page_no") == F.col("_page")) & hit, "left")


def _same_line(tolerance: float) -> Column:
    """Boxes x and y share a line."""
    least = F.least(F.col("xt") - F.col("xb"), F.col("yt") - F.col("yb"))
    return (least > 0) & (F.least("xt", "yt") - F.greatest("xb", "yb") > tolerance * least)


def nearest_labels(fields: DataFrame, texts: DataFrame) -> DataFrame:
    """The text left of a field on its line, within 12 line heights; only if there is none, the one above within 3. The nearest wins, the first of equals.

    fields: doc_id, page_no, field_id, l, b, r, t. texts: doc_id, page_no, ord, kind, text, l, b, r, t.
    """
    x = _boxes(fields, "x", "field_id")
    y = _boxes(texts.filter((F.col("kind") != "Artifact") & (F.trim("text") != "")), "y", "ord", "text")
    height = F.greatest(F.col("xt") - F.col("xb"), F.lit(8.0))
    left, above = F.col("xl") - F.col("yr"), F.col("yb") - F.col("xt")
    beside = _same_line(0.3) & left.between(F.lit(0.0), 12 * height)
    over = (F.col("yl") < F.col("xr")) & (F.col("yr") > F.col("xl")) & above.between(F.lit(0.0), 3 * height)
    near = F.when(beside, F.struct(F.lit(1).alias("phase"), left.alias("gap"), "yord", "ytext")).when(over, F.struct(F.lit(2).alias("phase"), above.alias("gap"), "yord", "ytext"))
    out = _hits(x, y, near.isNotNull()).groupBy(*PAGE, F.col("xfield_id").alias("field_id")).agg(F.min(near).alias("near"))
    return out.select(*PAGE, "field_id", F.col("near.phase").alias("phase"), T.tidy_label("near.ytext").alias("label"))


def option_labels(options: DataFrame, texts: DataFrame) -> DataFrame:
    """The nearest text right of a radio option, within 14 line heights."""
    x = _boxes(options, "x", "option_id")
    y = _boxes(texts.filter((F.col("kind") != "Artifact") & (F.trim("text") != "")), "y", "ord", "text")
    gap = F.col("yl") - F.col("xr")
    reach = 14 * F.greatest(F.col("xt") - F.col("xb"), F.lit(8.0))
    hit = _same_line(0.3) & gap.between(F.lit(0.0), reach)
    near = F.when(F.col("_doc").isNotNull(), F.struct(gap.alias("gap"), "yord", "ytext"))
    return _hits(x, y, hit).groupBy(*PAGE, F.col("xoption_id").alias("option_id")).agg(F.min(near).alias("near")).select(*PAGE, "option_id", T.tidy_label("near.ytext").alias("label"))


def words_in(regions: DataFrame, words: DataFrame, most: int = 60) -> DataFrame:
    """The words that overlap a region, from the top and the left, the first ``most`` joined by spaces."""
    x, y = _boxes(regions, "x", "region_id"), _boxes(words, "y", "word_ord", "text")
    hit = (F.col("yl") < F.col("xr")) & (F.col("yr") > F.col("xl")) & (F.col("yb") < F.col("xt")) & (F.col("yt") > F.col("xb"))
    j = x.join(y, PAGE).filter(hit)
    order = Window.partitionBy(*PAGE, "xregion_id").orderBy(F.bround("yb", 1).desc(), "yl", "yword_ord")
    top = j.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "ytext"))), lambda s: s["ytext"]), " ")
    return top.groupBy(*PAGE, F.col("xregion_id").alias("region_id")).agg(text.alias("text"), F.count("*").alias("n_words"))


def first_overlap(annotations: DataFrame, links: DataFrame) -> DataFrame:
    """The first link, in source order, that overlaps an annotation."""
    x, y = _boxes(annotations, "x", "region_id"), _boxes(links, "y", "ord", "text")
    hit = (F.col("yl") < F.col("xr")) & (F.col("yr") > F.col("xl")) & (F.col("yb") < F.col("xt")) & (F.col("yt") > F.col("xb"))
    j = x.join(y, PAGE).filter(hit)
    return j.groupBy(*PAGE, F.col("xregion_id").alias("region_id")).agg(F.min_by("ytext", "yord").alias("text"))


def smallest_enclosing(points: DataFrame, elements: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """The smallest element round a point, give or take ``tolerance``; the first of equals."""
    y = _boxes(elements, "y", "element_id", "ord")
    near = lambda p, low, high: (F.col(p) >= F.col(low) - tolerance) & (F.col(p) <= F.col(high) + tolerance)
    inside = near("x", "yl", "yr") & near("y", "yb", "yt")
    area = F.greatest(F.col("yr") - F.col("yl"), F.lit(1.0)) * F.greatest(F.col("yt") - F.col("yb"), F.lit(1.0))
    best = F.min(F.when(F.col("_doc").isNotNull(), F.struct(area.alias("area"), "yord", "yelement_id")))
    return _hits(points.select(*PAGE, "point_id", "x", "y"), y, inside).groupBy(*PAGE, "point_id").agg(best.alias("m")).select(*PAGE, "point_id", F.col("m.yelement_id").alias("element_id"))


def span_at(positions: DataFrame, spans: DataFrame) -> DataFrame:
    """The span that holds a position, else the nearest one before it. One sort of both sides; no range join."""
    s = spans.select("doc_id", F.col("start").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("int").alias("position"), F.struct("element_id", "start", "length").alias("span"))
    p = positions.select("doc_id", F.col("position").alias("at"), F.lit(1).alias("side"), F.col("position").cast("int"), F.lit(None).cast(s.schema["span"].dataType).alias("span"))
    w = Window.partitionBy("doc_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    out = s.unionByName(p).withColumn("found", F.last("span", ignorenulls=True).over(w)).filter("side = 1")
    inside = F.col("position") < F.col("found.start") + F.col("found.length")
    return out.select("doc_id", "position", F.col("found.element_id").alias("element_id"), F.coalesce(inside, F.lit(False)).alias("inside"))


def column_headers(cells: DataFrame) -> DataFrame:
    """For every data cell, the nearest header above in its column and the nearest to its left in its row. cells: table_id, row_no, column_index, text, role."""
    above = Window.partitionBy("table_id", "column_index").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    left = Window.partitionBy("table_id", "row_no").orderBy("column_index").rowsBetween(Window.unboundedPreceding, -1)
    head = lambda *roles: F.when(F.col("role").isin(*roles), F.col("text"))
    c = cells.withColumn("column_header", F.last(head("ColumnHeader", "Header"), ignorenulls=True).over(above)).withColumn("row_header", F.last(head("RowHeader", "Header"), ignorenulls=True).over(left))
    spoken = F.concat_ws(", ", F.nullif("row_header", F.lit("")), F.nullif("column_header", F.lit("")), F.when(F.col("text") == "", "blank").otherwise(F.col("text")))
    return c.filter("role = 'Data'").select("table_id", "row_no", "column_index", "column_header", "row_header", spoken.alias("spoken"))


def missing(changed: DataFrame, saved: DataFrame) -> DataFrame:
    """Changed fields that the saved form lacks, by full name; pending signatures aside."""
    return changed.filter(~F.col("pending_signature")).join(saved.select("doc_id", "name").distinct(), ["doc_id", "name"], "left_anti").select("doc_id", "name")


def matched(edited: DataFrame, raw: DataFrame) -> DataFrame:
    """Edited fields with their raw ones; a miss gives a warning."""
    j = edited.join(raw.select("doc_id", "name", "raw_id"), ["doc_id", "name"], "left")
    return j.select("doc_id", "name", "value", "raw_id", F.when(F.col("raw_id").isNull(), "no such field").alias("warning"))


def by_reference(annotations: DataFrame, parent_tree: DataFrame, references: DataFrame) -> DataFrame:
    """The tag of an annotation by its parent-tree key, else by a tag that refers to the object within depth 24."""
    direct = annotations.join(parent_tree, ["doc_id", "struct_key"], "left")
    near = references.filter("depth <= 24").groupBy("doc_id", "object_id").agg(F.min_by("tag_id", F.struct("depth", "tag_id")).alias("found"))
    return direct.join(near, ["doc_id", "object_id"], "left").select("doc_id", "object_id", F.coalesce("tag_id", "found").alias("tag_id"), F.when(F.col("tag_id").isNotNull(), "key").when(F.col("found").isNotNull(), "scan").alias("how"))
