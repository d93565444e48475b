"""Licence scan: ordered signature rules behind a keyword gate.

The rules (license_rules) are hand-written regular expressions in sections of falling priority: identifiers, sentences of the licences, names with a version, notices, names. From each, the stretches of
plain words that every match holds are taken as its keywords. A cheap regular expression, made from one keyword of each rule and the base phrases, picks the texts that can hold
a licence notice at all. Those are lower-cased and cut into words, and every rule all of whose keywords they contain is searched in the words joined by single spaces. A detection is suppressed
if one that takes precedence overlaps or contains it: higher priority first, then the longer, the earlier, the smaller label. What survives gives the labels and the score.

Nulls: a null text is empty. Texts without a notice have no labels (empty string) and score 0. Equal rows get equal results; extra columns are ignored; an empty table gives no rows.
Very long texts are scanned whole: positions of n matches are summed up in about n ** 1.5 steps.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, let
from .license_rules import SECTIONS

#: Word separators are ASCII characters other than digits and letters; case matters not, so capitals are word characters here.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BASE = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))

#: Words that stand in many texts without a licence: a stretch of these alone makes a poor gate.
COMMON = frozenset("under the terms of is in to a mit".split())


@dataclass(frozen=True)
class SignatureRule:
    label: str
    keywords: tuple[str, ...]
    regex: str
    priority: int
    relevance: float


def keywords(regex: str) -> tuple[str, ...]:
    """The stretches of plain words, each from a word's start on, that every match holds; the most telling first."""
    runs, now, inside, i = [], "", False, 0
    # ``inside``: whether what comes next may stand in the middle of a word.
    while i < len(regex):
        c, step = regex[i], 1
        literal = c not in "([\\."
        if c == "(":
            step = next(k for k in range(1, len(regex)) if regex.count("(", i, i + k) == regex.count(")", i, i + k))
        elif c == "[":
            step = regex.index("]", i) - i + 1
        elif c == "\\":
            step = 2
        after = re.match(r"\{[^}]*\}\??|[?+*]\??", regex[i + step :])
        if literal and not after:
            now += c
        else:
            runs.append((now, inside))
            now, inside = "", not (c == "(" and regex[i : i + step].removesuffix(")").endswith(" "))
        i += step + (after.end() if after else 0)
    runs.append((now, inside))
    found = []
    for run, mid in runs:
        text = run[1:] if run.startswith(" ") else (run.partition(" ")[2] if mid else run)
        if text.strip():
            found.append(text)
    return tuple(sorted(set(found), key=lambda k: (all(w in COMMON or w.isdigit() for w in k.split()), -len(k), k)))


#: The tag of an identifier, how rules say that it may be missing, and the score of an identifier without it.
TAG, BARE = "spdx license identifier ", 0.3
MAYBE_TAGGED = f"(?:{TAG})?"


def signature_rules() -> list[SignatureRule]:
    """All rules in the order of their sections. An identifier counts in full behind its tag; without it, the same words are a rule of the last rank, whose score says that they may be anything."""
    out = []
    last = min(priority for _, priority, _ in SECTIONS) - 1
    rule = lambda label, regex, priority, relevance: SignatureRule(label, keywords(regex), f" {regex}(?= )", priority, relevance)
    for rules, priority, relevance in SECTIONS:
        for line in rules.strip().split("\n"):
            label, regex = line.split(" | ")
            if regex.startswith(MAYBE_TAGGED):
                bare = regex.removeprefix(MAYBE_TAGGED)
                out += [rule(label, TAG + bare, priority, relevance), rule(label, bare, last, BARE)]
            else:
                out.append(rule(label, regex, priority, relevance))
    return out


def _any_of(phrases: Iterable[str]) -> str:
    """A regular expression for the phrases; what several begin with stands in it once. One that begins with another adds nothing."""
    rest: dict[str, set[str]] = {}
    for p in phrases:
        if not p:
            return ""
        rest.setdefault(p[0], set()).add(p[1:])
    parts = [(f"{SEPARATOR}+" if c == " " else re.escape(c)) + _any_of(r) for c, r in sorted(rest.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def gate(rules: list[SignatureRule]) -> str:
    """What every text holds that a rule or a base phrase can match: a keyword from a word's start on, its words parted by any separators."""
    return f"(?i)(?:^|{SEPARATOR})" + _any_of({r.keywords[0] for r in rules} | {" ".join(phrase) for _, phrase in BASE})


def _before(lengths: Column) -> Column:
    """For each number, the sum of those before it. Square-root many blocks keep the appended arrays short."""
    none = F.array().cast("array<int>")

    def run(numbers: Column, start: Column) -> Column:
        return F.aggregate(
            numbers, F.struct(start.cast("int").alias("at"), none.alias("out")),
            lambda acc, n: F.struct((acc["at"] + n).cast("int").alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"],
        )

    def blocked(a: Column, m: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), m - 1), lambda b: F.slice(a, b * m + 1, m))
        total = lambda block: F.aggregate(block, F.lit(0), lambda x, y: x + y)
        return let(blocks, lambda bs: let(run(F.transform(bs, total), F.lit(0)), lambda at: F.flatten(F.transform(bs, lambda block, b: run(block, F.get(at, b))))))

    return let(lengths, lambda a: let(F.ceil(F.sqrt(F.size(a))).cast("int"), lambda m: blocked(a, m)))


HIT = "struct<s:int,e:int,p:int,label:string,relevance:double>"


def _intervals(text: Column, rule: Column) -> Column:
    """Start, end and rule of each match. The pieces between matches give the places."""

    def placed(found: Column) -> Column:
        between = F.split(text, rule["regex"], F.lit(-1))
        size = lambda pieces: F.transform(pieces, F.length)

        def spans(gaps: Column, own: Column) -> Column:
            at = _before(F.zip_with(F.slice(gaps, 1, F.size(own)), own, lambda x, y: x + y))
            begin = lambda x, k: x + F.get(gaps, k)
            return let(at, lambda a: F.transform(a, lambda x, k: F.struct(
                begin(x, k).alias("s"), (begin(x, k) + F.get(own, k)).alias("e"), rule["priority"].alias("p"), rule["label"].alias("label"), rule["relevance"].alias("relevance"),
            )))

        return F.when(F.size(found) == 0, F.array().cast(f"array<{HIT}>")).otherwise(let(size(between), lambda gaps: let(size(found), lambda own: spans(gaps, own))))

    return let(F.regexp_extract_all(text, rule["regex"], F.lit(0)), placed)


def _beats(a: Column, b: Column) -> Column:
    rank = lambda x: F.struct(x["p"], x["e"] - x["s"], -x["s"])
    return (rank(a) > rank(b)) | ((rank(a) == rank(b)) & (a["label"] < b["label"]))


def _resolved(hits: Column) -> Column:
    """Labels and best relevance of the detections that are not suppressed. hits come in order of their start; at any time only those that reach beyond it are held."""
    held = "struct<s:int,e:int,p:int,label:string,relevance:double,ok:boolean>"
    start = F.struct(F.array().cast(f"array<{held}>").alias("live"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))
    put = lambda x, ok: F.struct(*(x[n].alias(n) for n in ("s", "e", "p", "label", "relevance")), ok.alias("ok"))

    def counted(acc: Column, over: Column) -> tuple[Column, Column]:
        kept = F.filter(over, lambda x: x["ok"])
        return F.array_union(acc["labels"], F.transform(kept, lambda x: x["label"])), F.greatest(acc["score"], F.coalesce(F.array_max(F.transform(kept, lambda x: x["relevance"])), F.lit(0.0)))

    def step(acc: Column, h: Column) -> Column:
        labels, score = counted(acc, F.filter(acc["live"], lambda x: x["e"] <= h["s"]))
        live = F.filter(acc["live"], lambda x: x["e"] > h["s"])
        mine = put(h, ~F.exists(live, lambda x: _beats(x, h)))
        return F.struct(F.array_append(F.transform(live, lambda x: put(x, x["ok"] & ~_beats(h, x))), mine).alias("live"), labels.alias("labels"), score.alias("score"))

    def done(acc: Column) -> Column:
        labels, score = counted(acc, acc["live"])
        return F.struct(labels.alias("labels"), score.alias("score"))

    return F.aggregate(hits, start, step, done)


def scan(docs: DataFrame, rules: list[SignatureRule] | None = None) -> DataFrame:
    rules = signature_rules() if rules is None else rules
    d = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    gated = F.when(F.col("_t").rlike(gate(rules)), F.translate("_t", CAPITALS, SMALL))
    d = d.select("doc_id", F.regexp_count("_t", F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"), F.regexp_extract_all(gated, F.lit(LOWER_WORD), F.lit(0)).alias("_w"))

    def places(phrase: tuple[str, ...]) -> Column:
        """Where the phrase's words stand consecutively."""
        same = lambda w, i: F.get(w, i) == phrase[0]

        def all_same(w: Column, i: Column) -> Column:
            out = F.coalesce(same(w, i), F.lit(False))
            for k, word in enumerate(phrase[1:], 1):
                out = out & F.coalesce(F.get(w, i + k) == word, F.lit(False))
            return out

        return let(F.col("_w"), lambda w: F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: all_same(w, i)))

    none = F.array().cast("array<int>")
    found = {label: F.coalesce(places(phrase), none) for label, phrase in BASE}
    d = d.select("doc_id", "n_words", "_w", *(v.alias(f"_at_{k}") for k, v in found.items()))
    table = F.array(*(F.struct(F.lit(r.label).alias("label"), F.array(*map(F.lit, r.keywords)).alias("keywords"), F.lit(r.regex).alias("regex"), F.lit(r.priority).alias("priority"), F.lit(float(r.relevance)).alias("relevance")) for r in rules))
    joined = F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" "))
    hits = let(joined, lambda t: F.sort_array(F.flatten(F.transform(F.filter(table, lambda r: F.forall(r["keywords"], lambda k: F.contains(t, F.concat(F.lit(" "), k)))), lambda r: _intervals(t, r)))))
    d = d.withColumn("_found", F.when(F.col("_w").isNotNull(), let(hits, _resolved)))
    base = F.array_compact(F.array(*(F.when(F.size(f"_at_{k}") > 0, F.lit(k)) for k, _ in BASE)))
    every = F.array_sort(F.flatten(F.array(*(F.col(f"_at_{k}") for k, _ in BASE))))
    d = d.withColumn("_base", base).withColumn("_every", every)
    method = F.coalesce(F.col("_found.labels"), F.array().cast("array<string>"))
    based = F.when(F.size("_base") > 0, F.lit(0.7)).otherwise(0.0)
    return d.select(
        "doc_id", "n_words", F.size("_every").cast("long").alias("n_base"),
        F.get("_every", F.lit(0)).cast("long").alias("first_word"), F.get("_every", F.size("_every") - 1).cast("long").alias("last_word"),
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", method)), ",").alias("labels"),
        F.greatest(F.coalesce(F.col("_found.score"), F.lit(0.0)), based).alias("score"),
    )
