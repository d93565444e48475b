"""Element trees as adjacency lists. A path is computed once a corpus; ancestors and descendants are then prefix joins within a document."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.runtime import dealt, ship

from .fold import ARROW, fold

#: Fixed value: names of form fields are read to this depth.
FIELD_DEPTH = 32
#: Element kinds and their structure tags.
TAGS = {"Paragraph": "P", "Caption": "Caption", "BlockQuote": "BlockQuote", "Code": "Code", "Note": "Note", "List": "L", "ListItem": "LI", "Table": "Table", "TableRow": "TR", "Figure": "Figure", "Section": "Sect"}


def paths(spark: SparkSession, elements: DataFrame, most_depth: int | None = None, label: str | None = None) -> DataFrame:
    """O2: adds depth, path (padded places among siblings), reading_order (from 0, depth first) and last_order (the highest reading_order below). What no root leads to, such as a cycle, is left out.

    elements: doc_id, element_id, parent_id, sibling_ord and what else is to be kept. Rows are dealt by document and walked a document at a time, so a task holds
    one document, whatever its depth; the corpus is never held. most_depth: deeper elements are left out (A12). label: a column whose values that aren't blank are joined by dots from the root down, as full_name.
    """
    ship(spark)
    extra = [T.StructField("depth", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("reading_order", T.IntegerType()), T.StructField("last_order", T.IntegerType())]
    extra += [T.StructField("full_name", T.StringType())] if label else []
    schema = T.StructType([*elements.schema.fields, *extra])

    def walk(table: pa.Table) -> Iterator[pa.RecordBatch]:
        docs, ids, parents = (table[n].to_pylist() for n in ("doc_id", "element_id", "parent_id"))
        own = table[label].to_pylist() if label else None
        rows: list[int] = []
        found: tuple[list, ...] = ([], [], [], [], [])
        first = 0
        while first < len(docs):
            last = first
            children: dict = {}
            while last < len(docs) and docs[last] == docs[first]:
                children.setdefault(parents[last], []).append(last)
                last += 1
            below = lambda parent: children.pop(parent, ())  # noqa: E731, B023 -- each list is walked once, so cycles end
            stack = [(r, 0, f"{k:08d}", "") for k, r in reversed(list(enumerate(below(None))))]
            n = 0
            open_: list[int] = []  # rows whose last one isn't known, in found
            while stack:
                row, depth, path, name = stack.pop()
                if label and own[row]:
                    name = f"{name}.{own[row]}" if name else own[row]
                while open_ and found[0][open_[-1]] >= depth:
                    found[3][open_.pop()] = n - 1
                open_.append(len(rows))
                rows.append(row)
                for column, value in zip(found, (depth, path, n, n, name), strict=True):
                    column.append(value)
                n += 1
                if ids[row] is not None and (most_depth is None or depth < most_depth):
                    stack += [(r, depth + 1, f"{path}.{k:08d}", name) for k, r in reversed(list(enumerate(below(ids[row]))))]
            for at in open_:
                found[3][at] = n - 1
            first = last
        out = table.take(pa.array(rows, pa.int64()))
        types = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
        for field, values, kind in zip(extra, found, types, strict=False):
            out = out.append_column(field.name, pa.array(values, kind))
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            docs = batch.column("doc_id").to_pylist()
            cut = len(docs)
            while cut and docs[cut - 1] == docs[-1]:
                cut -= 1
            if held and (cut or docs[0] != held[-1].column("doc_id")[0].as_py()):
                yield from walk(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from walk(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from walk(pa.Table.from_batches(held))

    return elements.repartition("doc_id").sortWithinPartitions("doc_id", "sibling_ord", "element_id").mapInArrow(run, schema)


def descendants(walked: DataFrame) -> DataFrame:
    """TR3, TR4: every element with each of its ancestors: doc_id, ancestor_id, element_id, distance. One row for each pair that exists, found from the stretches of reading_order."""
    return interval_pairs(walked, "reading_order", "last_order")


def interval_pairs(tree: DataFrame, at: str = "element_id", last: str = "last_id") -> DataFrame:
    """TR3, TR4 of trees with a number that ascends in document order (``at``) and the highest one below each element (``last``): doc_id, ancestor_id, element_id, distance.

    A document's rows stream past a stack of the elements that still hold what follows, so a task holds one chain of ancestors, and pairs go out as they are found.
    """
    ship(tree.sparkSession)
    kinds = [tree.schema[n].dataType.simpleString() for n in ("doc_id", "element_id")]
    types = (ARROW[kinds[0]], ARROW[kinds[1]], ARROW[kinds[1]], pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = None, []
        out: list[tuple] = []
        names = ("doc_id", "ancestor_id", "element_id", "distance")
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for batch in batches:
            for doc, place, element, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc != now:
                    now, stack = doc, []
                while stack and stack[-1][1] < place:
                    stack.pop()
                for distance, (above, _) in enumerate(reversed(stack), 1):
                    out.append((doc, above, element, distance))
                    if len(out) >= 10_000:
                        yield packed(out)
                        out = []
                stack.append((element, end))
        if out:
            yield packed(out)

    rows = tree.select("doc_id", F.col(at).alias("_at"), "element_id", F.col(last).alias("_last")).repartition("doc_id").sortWithinPartitions("doc_id", "_at")
    return rows.mapInArrow(run, f"doc_id {kinds[0]}, ancestor_id {kinds[1]}, element_id {kinds[1]}, distance int")


def heading_parents(headings: DataFrame) -> DataFrame:
    """An outline of numbered headings: each one's parent is the nearest before it of a lower number. headings: doc_id, element_id (ascending), level from 1 to 6, and what else is to be kept. One sort; no document is gathered."""
    before = Window.partitionBy("doc_id").orderBy("element_id").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("level") > n, F.last(F.when(F.col("level") == n, F.col("element_id")), ignorenulls=True).over(before)) for n in range(1, 6)]
    return headings.withColumn("parent_id", F.greatest(*last))


def full_text(walked: DataFrame, pairs: DataFrame) -> DataFrame:
    """An element's own text and that of its descendants in order, empty ones left out."""
    own = walked.select("doc_id", F.col("element_id").alias("ancestor_id"), "reading_order", "text")
    below = pairs.join(dealt(walked.select("doc_id", "element_id", "reading_order", "text")), ["doc_id", "element_id"]).select("doc_id", "ancestor_id", "reading_order", "text")
    parts = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.struct("reading_order", F.trim("text").alias("text")))
    g = own.unionByName(below).groupBy("doc_id", "ancestor_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda s: s["text"]), " ").alias("full_text"))
    return g.withColumnRenamed("ancestor_id", "element_id")


def full_texts(rows: Sequence[Sequence]) -> Iterator[tuple[int, str]]:
    """T3 of a page at hand (rows of markup.tree): element_id and full_text of each element. Runs, artifacts and images have text of their own, so that a text stands once in what it is part of."""
    at, said = [], []
    for r in rows:
        if r[5] == "#text" or r[6] in ("Artifact", "Figure"):
            text = r[8].strip(" ")
            if text:
                at.append(r[0])
                said.append(text)
    for r in rows:
        if r[6] != "Run":
            first = bisect_left(at, r[0])
            yield r[0], " ".join(said[first : bisect_right(at, r[3], first)])


def rolled_bounds(walked: DataFrame, pairs: DataFrame) -> DataFrame:
    """An element without an extent gets the union of its descendants'."""
    solid = walked.filter("r > l AND t > b").select("doc_id", "element_id", "l", "b", "r", "t")
    below = pairs.join(dealt(solid), ["doc_id", "element_id"]).groupBy("doc_id", "ancestor_id").agg(F.min("l").alias("l2"), F.min("b").alias("b2"), F.max("r").alias("r2"), F.max("t").alias("t2"))
    j = walked.join(dealt(below.withColumnRenamed("ancestor_id", "element_id")), ["doc_id", "element_id"], "left")
    empty = (F.col("r") <= F.col("l")) | (F.col("t") <= F.col("b"))
    return j.select("doc_id", "element_id", *(F.when(empty & F.col(f"{c}2").isNotNull(), F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in "lbrt"))


def heading_levels(walked: DataFrame, pairs: DataFrame) -> DataFrame:
    """An unnumbered heading's level is the number of sections and documents around it, from 1 to 6."""
    kinds = walked.select("doc_id", F.col("element_id").alias("ancestor_id"), F.col("kind").alias("above"))
    n = pairs.join(dealt(kinds), ["doc_id", "ancestor_id"]).filter(F.col("above").isin("Section", "Document")).groupBy("doc_id", "element_id").agg(F.count("*").alias("n"))
    h = walked.filter("kind = 'Heading'").join(dealt(n), ["doc_id", "element_id"], "left")
    return h.select("doc_id", "element_id", F.coalesce("level", F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("n", F.lit(0)))).cast("int")).alias("level"))


def nearest(walked: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """TR4: the nearest ancestor of a kind."""
    k = walked.filter(F.col("kind") == kind).select("doc_id", F.col("element_id").alias("ancestor_id"))
    return pairs.join(dealt(k), ["doc_id", "ancestor_id"]).groupBy("doc_id", "element_id").agg(F.min_by("ancestor_id", "distance").alias("ancestor_id"))


def sibling_index(elements: DataFrame) -> DataFrame:
    """TR5, TR2: places among siblings from 0, renumbered without gaps."""
    w = Window.partitionBy("doc_id", "parent_id").orderBy("sibling_ord", "element_id")
    return elements.select("doc_id", "element_id", (F.row_number().over(w) - 1).alias("sibling_index"))


def move(elements: DataFrame, moves: DataFrame) -> DataFrame:
    """TR2: moves children to a place among their siblings, held within bounds. moves: doc_id, element_id, place."""
    now = elements.join(dealt(sibling_index(elements)), ["doc_id", "element_id"]).join(dealt(moves), ["doc_id", "element_id"], "left")
    n = F.count("*").over(Window.partitionBy("doc_id", "parent_id"))
    target = F.greatest(F.lit(0), F.least(F.col("place"), n - 1))
    key = F.when(F.col("place").isNull(), F.col("sibling_index") * 2.0).otherwise(target * 2 + F.when(target > F.col("sibling_index"), 1).otherwise(-1))
    w = Window.partitionBy("doc_id", "parent_id").orderBy("_key", "sibling_index")
    return now.withColumn("_key", key).select("doc_id", "element_id", "parent_id", (F.row_number().over(w) - 1).alias("sibling_ord"))


#: Kinds that take no children.
LEAVES = ("Link", "Figure", "Artifact", "Annotation")


def refused(elements: DataFrame) -> DataFrame:
    """TR1: children whose parent takes none, or isn't there."""
    p = elements.select("doc_id", F.col("element_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    j = elements.filter("parent_id IS NOT NULL").join(dealt(p), ["doc_id", "parent_id"], "left")
    return j.filter(F.col("parent_kind").isNull() | F.col("parent_kind").isin(*LEAVES)).select("doc_id", "element_id", F.when(F.col("parent_kind").isNull(), "no parent").otherwise("takes no children").alias("reason"))


def tag(kind: Column | str, level: Column | str, role: Column | str) -> Column:
    """The structure tag of an element, or null."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    table = F.create_map(*(F.lit(x) for kv in TAGS.items() for x in kv))
    head = F.concat(F.lit("H"), F.coalesce(c(level), F.lit(2)).cast("string"))
    return F.when(c(kind) == "Heading", head).when(c(kind) == "TableCell", F.when(F.coalesce(c(role), F.lit("Data")) == "Data", "TD").otherwise("TH")).otherwise(F.try_element_at(table, c(kind)))


def structure_tree(walked: DataFrame, pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Tags with their nearest tagged ancestor as parent and their marks. Elements with neither marks nor written descendants are left out.

    marks: doc_id, element_id, page_no, mcid.
    """
    t = walked.drop("parent_tag", "m").withColumn("tag", tag("kind", "level", "role"))
    own = marks.groupBy("doc_id", "element_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "mcid"))).alias("m"))
    t = t.join(dealt(own), ["doc_id", "element_id"], "left")
    written = t.filter("tag IS NOT NULL AND m IS NOT NULL").select("doc_id", "element_id")
    alive = written.union(pairs.join(dealt(written), ["doc_id", "element_id"]).select("doc_id", F.col("ancestor_id").alias("element_id"))).distinct()
    live = t.filter("tag IS NOT NULL").join(dealt(alive), ["doc_id", "element_id"], "left_semi")
    up = pairs.join(dealt(live.select("doc_id", F.col("element_id").alias("ancestor_id"))), ["doc_id", "ancestor_id"]).groupBy("doc_id", "element_id").agg(F.min_by("ancestor_id", "distance").alias("parent_tag"))
    ids = F.array_join(F.transform("m", lambda x: F.concat(x["page_no"].cast("string"), F.lit(":"), x["mcid"].cast("string"))), ",")
    return live.join(dealt(up), ["doc_id", "element_id"], "left").select("doc_id", "element_id", "tag", "parent_tag", "reading_order", F.coalesce(ids, F.lit("")).alias("mcids"))


def structure_of(rows: Sequence[Sequence], marks: Mapping[int, Sequence[str]]) -> list[tuple]:
    """G9, K4 of a page at hand (rows of markup.tree): element_id, tag, parent_tag, reading_order, mcids. marks: those of each element, in order.

    What is written makes all tagged elements around it be written, so the nearest tagged one is the parent.
    """
    found, nearest_tag, written = [], {}, set()
    for r in rows:
        element, kind = r[0], r[6]
        if kind != "Run":
            tagged = "H" + r[5][1] if kind == "Heading" else ("TH" if r[5] == "th" else "TD") if kind == "TableCell" else TAGS.get(kind)
            above = nearest_tag.get(r[1])
            nearest_tag[element] = above if tagged is None else element
            found.append((element, tagged, above, r[1]))
    out = []
    for element, tagged, above, parent in reversed(found):
        own = marks.get(element)
        if element in written or (tagged is not None and own):
            written.add(parent)
            if tagged is not None:
                out.append((element, tagged, above, element, ",".join(own) if own else ""))
    return out


def dense_marks(marks: DataFrame) -> DataFrame:
    """The elements of each page's marks as an array from 0, with nulls where a number is missing."""
    g = marks.groupBy("doc_id", "page_no").agg(F.map_from_entries(F.collect_list(F.struct("mcid", "element_id"))).alias("m"), F.max("mcid").alias("top"))
    return g.select("doc_id", "page_no", F.transform(F.sequence(F.lit(0), "top"), lambda i: F.try_element_at("m", i)).alias("elements"))


def qualified_names(spark: SparkSession, fields: DataFrame) -> DataFrame:
    """Full names of form fields, from the root's name down. fields: doc_id, field_id, parent_id, name."""
    e = fields.select("doc_id", F.col("field_id").alias("element_id"), "parent_id", F.col("field_id").alias("sibling_ord"), "name")
    return paths(spark, e, FIELD_DEPTH, "name").select("doc_id", F.col("element_id").alias("field_id"), "full_name")


def comment_place(elements: DataFrame, anchors: DataFrame) -> DataFrame:
    """TR6: where a new comment goes among the siblings: after its anchor and the comments that follow it at once. anchors: doc_id, element_id."""
    w = Window.partitionBy("doc_id", "parent_id").orderBy("sibling_ord")
    note = F.col("kind") == "Annotation"
    # The next sibling that is no comment ends the run.
    stop = F.first(F.when(~note, F.col("sibling_ord")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    last = F.max("sibling_ord").over(Window.partitionBy("doc_id", "parent_id"))
    return elements.withColumn("place", F.coalesce(stop, last + 1)).join(dealt(anchors), ["doc_id", "element_id"], "left_semi").select("doc_id", "element_id", "place")


def as_artifacts(elements: DataFrame, targets: DataFrame) -> DataFrame:
    """TR7: the elements become artifacts in the same place, with bounds and text kept. targets: doc_id, element_id, artifact_type."""
    j = elements.drop("artifact_type").join(dealt(targets), ["doc_id", "element_id"], "left")
    return j.withColumn("kind", F.when(F.col("artifact_type").isNotNull(), "Artifact").otherwise(F.col("kind")))


def nesting(walked: DataFrame, pairs: DataFrame) -> DataFrame:
    """Items of each list and how many lists it lies in, itself included."""
    lists = walked.filter("kind = 'List'").select("doc_id", "element_id")
    above = pairs.join(dealt(lists.withColumnRenamed("element_id", "ancestor_id")), ["doc_id", "ancestor_id"]).groupBy("doc_id", "element_id").agg(F.count("*").alias("n"))
    items = walked.filter("kind = 'ListItem'").groupBy("doc_id", F.col("parent_id").alias("element_id")).agg(F.count("*").alias("items"))
    return lists.join(dealt(above), ["doc_id", "element_id"], "left").join(dealt(items), ["doc_id", "element_id"], "left").select("doc_id", "element_id", F.coalesce("items", F.lit(0)).alias("items"), (F.coalesce("n", F.lit(0)) + 1).alias("level"))


def resolved_names(names: DataFrame) -> DataFrame:
    """Names that stand for other names, to their end. names: doc_id, name, element_id, next_name (null: the name is the element's own).

    A document's names stream into one table, and each is followed once: what was found on the way is kept. What goes round in a circle, or leads to a name that isn't there, has no element. Of elements with one name the first counts.
    """
    rows = names.select("doc_id", "name", F.col("element_id").cast("int").alias("element_id"), "next_name")

    def step(state: dict | None, row: tuple) -> tuple[dict, tuple]:
        state = {} if state is None else state
        state.setdefault(row[0], row[1:])
        return state, ()

    def end(state: dict) -> list[tuple]:
        found: dict[str, int | None] = {}
        for name in state:
            way, now = [], name
            while now in state and now not in found:
                found[now] = None  # until its end is known; a circle comes back to it
                way.append(now)
                element, following = state[now]
                if following is None:
                    found[now] = element
                    break
                now = following
            for x in way:
                found[x] = found.get(now)
        return list(found.items())

    return fold(rows, "doc_id", ["element_id"], "name string, element_id int", step, end)
