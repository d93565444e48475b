"""Statistics of whole texts as column expressions, shared by the quality operators.

A null text counts as empty; every statistic of an empty text is 0. Windows of five words are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, words

GRAM = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(places: Column) -> Column:
    """How many words the windows that start at the given ascending places cover."""
    return let(places, lambda p: F.aggregate(
        F.sequence(F.lit(1), F.size(p)),
        F.lit(0).cast("long"),
        lambda acc, k: acc + F.when(k == F.size(p), F.lit(GRAM)).otherwise(F.least(F.lit(GRAM), F.get(p, k) - F.get(p, k - 1))).cast("long"),
    ))


def repeat_words(w: Column) -> Column:
    """Words inside five-word windows that stand twice or more in the text."""
    at = lambda ws, i, k: F.get(ws, i + k)
    grams = let(w, lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - GRAM), lambda i: F.xxhash64(*(at(ws, i, k) for k in range(GRAM)))))

    def places(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
            hit = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(k > 0, same(k, k - 1)).otherwise(False) | F.when(k < F.size(s) - 1, same(k, k + 1)).otherwise(False))
            return F.sort_array(F.transform(hit, lambda k: F.get(s, k)["i"]))

        return let(ordered, twins)

    # Most texts repeat no window; counting distinct hashes settles those without a sort.
    counted = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(_covered(places(g))))
    return F.when(F.size(w) <= GRAM, F.lit(0).cast("long")).otherwise(counted)


def with_stats(df: DataFrame, more: bool = False) -> DataFrame:
    """Adds COUNTS (and further statistics) to a frame with ``text``; its other columns stay, the text goes."""
    kept = [c for c in df.columns if c != "text"]
    t = df.select(*kept, F.coalesce("text", F.lit("")).alias("_t"))
    t = t.withColumn("_w", words(F.col("_t")))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))
    t = t.withColumn("_l", lines)
    long = lambda c: c.cast("long")
    out = {
        "n_words": long(F.size("_w")),
        "word_chars": long(F.length(F.array_join("_w", ""))),
        "n_symbols": long(F.regexp_count("_t", F.lit("[#*$%&|<>]"))),
        "n_dup_lines": long(F.size("_l") - F.size(F.array_distinct("_l"))),
        "n_repeat_words": repeat_words(F.col("_w")),
        "n_lines": long(F.size("_l")),
        "n_distinct_words": long(F.size(F.array_distinct("_w"))),
    }
    if more:
        out |= {
            "n_digits": long(F.regexp_count("_t", F.lit("[0-9]"))),
            "n_upper": long(F.regexp_count("_t", F.lit("[A-Z]"))),
            "n_stops": long(F.regexp_count("_t", F.lit("[.!?]"))),
        }
    return t.select(*kept, *(v.alias(k) for k, v in out.items()))


#: Ratios that rules are learned over; the column expression and the same over a row read on the driver are built from one table.
RATIOS = {
    "mean_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "digits_per_char": ("n_digits", "word_chars"),
    "upper_per_char": ("n_upper", "word_chars"),
    "stops_per_word": ("n_stops", "n_words"),
}
LIST_FEATURES = ("n_words", "mean_word", "symbols_per_word", "dup_lines_share", "repeat_share", "distinct_share")
SCORE_FEATURES = ("n_words", *RATIOS)


def feature(name: str) -> Column:
    if name not in RATIOS:
        return F.col(name).cast("double")
    top, bottom = RATIOS[name]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)


def condition(name: str, sign: str, threshold: float) -> Column:
    return feature(name) <= float(threshold) if sign == "<=" else feature(name) > float(threshold)


def sample(labels: DataFrame, docs: DataFrame, target: str, names: tuple[str, ...], most: int, held_out: bool) -> tuple[list[list[float]], list[int], list[float]]:
    """At most ``most`` labelled documents' features, labels and weights, chosen by the hash of doc_id and read on the driver.

    held_out leaves out the rows whose crc32 of doc_id as text, mod 4, is 2. Rows with a null label or doc_id are left out; of several labels or texts of one doc_id the smallest counts, so that no
    doc_id gives more than one row. Each class fills half of the sample if it can; a weight is the number of labelled documents that a sampled one of its class stands for.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    if held_out:
        known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    pick = lambda v: known.filter(F.col("y") == v).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(most // 2)
    chosen = pick(0).unionByName(pick(1))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows of two numbers
    rows = with_stats(texts, more=True).select("doc_id", "y", F.struct(*(feature(n).alias(f"f{i}") for i, n in enumerate(names))).alias("f"))
    rows = rows.groupBy("doc_id", "y").agg(F.min("f").alias("f")).orderBy("doc_id").collect()  # at most ``most``
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).filter("y IN (0, 1)").collect()}
    y = [r["y"] for r in rows]
    return [list(r["f"]) for r in rows], y, [total[v] / min(total[v], most // 2) for v in y]
