"""Mixing sources to target weights by Pareto order sampling after whole copies.

A source's target is its weight's share of all words, cut at ``most`` times its own words; what is cut off goes to the others by
weight until none is above (one water level, found from running sums over the sources). With rate = target / own words, every
document is taken floor(rate) times for certain. The rest of the target, the gap, is an unequal-probability sample.

Inclusion probabilities come from the sizes: documents are put in classes by the power of two of their size, a class's probability is min(1, c * 2 ** (TILT * class)), so that it rises with the root of the size, and c is the
water level at which the expected words, the sum of probability times size, are the gap. Short documents, the likelier ones to be left over, can then fill what long ones leave. Each document draws a uniform number, and documents are ranked by random odds u / (1 - u) over
inclusion odds p / (1 - p). The sample's fixed size is counted in words: in rank order, a document goes in if it fits what is left of the gap. So it is the longest start of the ranking that
fits, then the longest start of those after it that are no longer than the rest, and so on until no document fits; what is left is reported (``shortfall``).

A source may hold a third of all rows: ranks are binned, words summed by (source, bin), and only the one bin that holds a cut is sorted.

Null sources are one source that comes last; null texts have no words and are taken 0 times; a document without words always gets 0. Texts of any length are only counted.
Equal rows are numbered, and each draws for itself; ties of rank are ordered by doc_id, size, the row's hash and its number. An empty table gives no rows; extra columns are kept by
mixed_documents and ignored by op9.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, Scratch, documents, uniform
from .sharding import numbered, row_numbers

WEIGHTS, MOST, BINS, TILT, SEED, CLASSES = (5, 2, 1), 3, 1024, 0.5, 7, 64
#: Files of a table that has a few rows a source.
FILES = 4
RANK = "struct<bin:int,q:double,d:bigint,s:bigint,k:bigint,n:bigint>"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: source, source_size. Adds ``target``. Its windows run over one row a source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("double")
    s = sizes.withColumn("_w", w).withColumn("_ratio", most * F.col("source_size") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    all_rows = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # If the sources with smaller ratios are full, this is the level of those from here on.
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))) / F.sum("_w").over(after)
    s = s.withColumn("_level", level)
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(all_rows)
    s = s.withColumn("_at", first["_level"])
    target = F.least((most * F.col("source_size")).cast("double"), F.col("_at") * F.col("_w"))
    return s.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _class(size: Column) -> Column:
    """The power of two: 0 for sizes 0 and 1, 1 for 2 and 3, 2 for 4 to 7, ..."""
    return F.length(F.bin(F.greatest(size, F.lit(1)))) - 1


def _probabilities(by_class: DataFrame, plan: DataFrame, tilt: float) -> DataFrame:
    """by_class: source, class, words. Adds to the plan ``_p``, an inclusion probability for each class, with which the expected words are the gap. At most CLASSES rows a source."""
    c = by_class.join(plan.select(F.col("source").alias("_source"), "_gap"), F.col("source").eqNullSafe(F.col("_source")))
    c = c.withColumn("_share", F.pow(F.lit(2.0), tilt * F.col("class")))
    # Classes of long documents reach 1 first. If those before it have, this is the level of the others.
    order = Window.partitionBy("source").orderBy(F.col("class").desc())
    full = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weighed = F.sum(F.col("words") * F.col("_share")).over(order.rowsBetween(0, Window.unboundedFollowing))
    c = c.withColumn("_level", (F.col("_gap") - full) / weighed)
    level = F.max(F.when(F.col("_level") * F.col("_share") <= 1, F.struct("class", "_level"))).over(Window.partitionBy("source"))["_level"]
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(level, F.lit(1e300)) * F.col("_share")))
    by_source = c.withColumn("_one", p).groupBy("source").agg(F.collect_list(F.struct("class", "_one")).alias("_list"))
    by_source = by_source.select(F.col("source").alias("_source"), F.map_from_entries("_list").alias("_p"))
    return plan.join(by_source, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _ranked(docs: DataFrame, plan: DataFrame, seed: int, bins: int) -> DataFrame:
    """Adds each document's rank, a struct that starts with its bin and in which ties are ordered, to doc_id, source, size, _key, _copy and the source's plan."""
    u = uniform("doc_id", "size", "_key", "_copy", seed=seed)
    p = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), F.coalesce(F.try_element_at("_p", _class(F.col("size"))), F.lit(0.0))))
    d = docs.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    d = d.withColumn("_q", (u / (1 - u)) / (p / (1 - p)))
    bin_ = F.least(F.floor(F.col("_q") / (1 + F.col("_q")) * bins), F.lit(bins - 1)).cast("int")  # spreads the ranks about 1, where the cut is expected
    rank = F.struct(bin_.alias("bin"), F.col("_q").alias("q"), F.coalesce("doc_id", F.lit(-1)).cast("long").alias("d"), F.col("size").alias("s"), F.col("_key").alias("k"), F.col("_copy").alias("n"))
    return d.withColumn("_rank", rank).drop("_q")


def _sampled() -> Column:
    """Whether a pass has taken the document into the sample. ``_cuts``: the longest size of each pass, and where it ends in the rank order."""
    return F.exists("_cuts", lambda c: (F.col("size") <= c["limit"]) & (F.col("_rank") <= c["cut"]))


def plan_mix(sizes: DataFrame, scratch: Scratch, seed: int = SEED, tilt: float = TILT, bins: int = BINS) -> DataFrame:
    """One row a source: source_size, target, whole copies, probabilities, what is still lacking, and for each pass the longest size and where it ends in the rank order."""
    by_class = scratch.save(sizes.groupBy("source", _class(F.col("size")).alias("class")).agg(F.sum("size").alias("words")).coalesce(FILES), "classes")  # at most CLASSES rows a source
    plan = targets(by_class.groupBy("source").agg(F.sum("words").alias("source_size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("_whole", F.floor(rate + 1e-12).cast("long")).withColumn("_gap", F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size")))
    plan = plan.withColumn("_cuts", F.array().cast(f"array<struct<limit:bigint,cut:{RANK}>>"))
    plan = scratch.save(_probabilities(by_class.filter("words > 0"), plan, tilt).coalesce(FILES), "plan-0")
    k, before = 0, None
    while True:  # every pass takes a document at least, or is the last
        k += 1
        limit = F.lit(1 << 62) if k == 1 else F.floor("_gap").cast("long")
        plan = scratch.save(_pass(_ranked(sizes, plan.withColumn("_limit", limit), seed, bins), plan.withColumn("_limit", limit), k, scratch).coalesce(FILES), f"plan-{k}")
        now = plan.agg(F.sum("_gap")).first()[0]
        if now == before or not now:
            return plan
        before = now


def _pass(ranked: DataFrame, plan: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    d = ranked.filter((F.col("size") > 0) & (F.col("size") <= F.col("_limit")) & ~_sampled()).select("source", "size", "_rank", "_gap")
    by_bin = d.groupBy("source", F.col("_rank.bin").alias("_bin")).agg(F.sum("size").alias("_words"), F.first("_gap").alias("_gap"))
    run = F.sum("_words").over(Window.partitionBy("source").orderBy("_bin"))  # at most BINS rows a source
    by_bin = by_bin.withColumn("_before", run - F.col("_words")).filter("_before < _gap")
    last = by_bin.groupBy("source").agg(F.max(F.struct("_bin", "_before")).alias("_at"))
    last = scratch.save(last.select(F.col("source").alias("_source"), F.col("_at._bin").alias("_cut_bin"), F.col("_at._before").alias("_start")).coalesce(FILES), f"bins-{k}")
    inside = d.join(last, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_rank.bin") == F.col("_cut_bin")))
    order = Window.partitionBy("source").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_upto", F.col("_start") + F.sum("size").over(order)).filter("_upto <= _gap")
    cut = inside.groupBy("source").agg(F.max("_rank").alias("_last"), F.max("_upto").alias("_upto"))
    both = plan.join(last, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    both = both.join(cut.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left")
    zero = lambda name: F.lit(0).cast("long").alias(name)
    below = F.struct(F.col("_cut_bin").alias("bin"), F.lit(-1.0).alias("q"), zero("d"), zero("s"), zero("k"), zero("n"))
    found = F.when(F.col("_cut_bin").isNotNull(), F.array(F.struct(F.col("_limit").alias("limit"), F.coalesce("_last", below).alias("cut"))))
    cuts = F.concat("_cuts", F.coalesce(found, F.array().cast(f"array<struct<limit:bigint,cut:{RANK}>>")))
    names = [c for c in plan.columns if c not in ("_cuts", "_gap", "_limit")]
    return both.select(*names, cuts.alias("_cuts"), (F.col("_gap") - F.coalesce("_upto", "_start", F.lit(0))).alias("_gap"))


def mix(docs: DataFrame, plan: DataFrame, seed: int = SEED, bins: int = BINS) -> DataFrame:
    """docs: doc_id, source, size, _key, _copy and what else is to be kept. Adds source_size, target, copies (int), taken (long), and the source's shortfall in words."""
    d = _ranked(docs, plan, seed, bins)
    copies = F.when(F.col("size") > 0, F.least(F.col("_whole") + _sampled().cast("long"), F.lit(MOST))).otherwise(0).cast("int")
    return d.select(*docs.columns, "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), F.col("_gap").alias("shortfall"))


def _unhashed(kind: T.DataType) -> bool:
    """Whether a type holds a map or a variant, which have no hash."""
    if isinstance(kind, T.StructType):
        return any(_unhashed(f.dataType) for f in kind.fields)
    return _unhashed(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, T.MapType | T.VariantType)


def _key(docs: DataFrame) -> Column:
    """A hash of the whole row; maps and variants take part as JSON. It only tells which rows draw as copies of each other: every row keeps its own content."""
    col = lambda f: F.col(f"`{f.name}`")
    return F.xxhash64(*(F.to_json(F.struct(col(f).alias("v")), {"ignoreNullFields": "false"}) if _unhashed(f.dataType) else col(f) for f in docs.schema.fields))


def _size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, source, size, _key and _copy, a few bytes a document; the words are counted once."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"), _key(docs).alias("_key"))
    d = scratch.save(d, "counted")
    out = scratch.save(numbered(d, "doc_id", "source", "size", "_key"), "sizes")
    scratch.drop("counted")
    return out


def op9(spark: SparkSession, docs: DataFrame) -> DataFrame:
    scratch = Scratch(spark, "mix")
    sizes = sized(documents(docs, "source"), scratch)
    return mix(sizes, plan_mix(sizes, scratch)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "shortfall")


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with the columns they came with. Texts are not shuffled, but for those of equal rows: the plan has a row a source."""
    scratch = Scratch(spark, "mix")
    sizes = sized(docs, scratch)
    plan = plan_mix(sizes, scratch)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    d = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"), _key(docs).alias("_key"), F.lit(0).cast("long").alias("_copy"))
    again = scratch.save(sizes.filter("_copy = 1").select("_key").distinct(), "again")
    if again.isEmpty():
        return _repeated(mix(d, plan).select("_row", F.col("copies").cast("long").alias("n")))
    once = mix(d.join(again, "_key", "left_anti"), plan).select("_row", F.col("copies").cast("long").alias("n"))
    # Rows with equal ones are written with a number each, and numbered among their equals; each draws for itself.
    keys = ("doc_id", "source", "size", "_key")
    rows = scratch.save(d.join(again, "_key", "left_semi").drop("_copy").withColumn("_place", F.monotonically_increasing_id()), "copies")
    drawn = row_numbers(rows.select(*keys, F.col("_place").alias("_row")), *keys).withColumnRenamed("_row", "_place")
    many = rows.select("_row", "_place").join(mix(drawn, plan).select("_place", F.col("copies").cast("long").alias("n")), "_place").select("_row", "n")
    return _repeated(once.unionByName(many))


def _repeated(rows: DataFrame) -> DataFrame:
    """Each row n times; many copies are spread by lots."""
    lot = 1024
    lots = rows.filter("n > 0").select("_row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / lot))).alias("_lot"))
    last = F.least(F.col("n") - 1, (F.col("_lot") + 1) * lot - 1)
    return lots.select("_row", F.explode(F.sequence(F.col("_lot") * lot, last)).alias("_n")).select("_row.*")
