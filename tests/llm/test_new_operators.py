"""Search, divergence and exact dedup against brute force on odd rows, and against SQL on a whole table."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import duck_rows, spark_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import block_names, divergence, lexical_search, mixing, queries, sharding, tokens
from quire.llm.common import Scratch

SPACE = re.compile(r"[\x20\x09-\x0D]")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_source_divergence", "op13_block_names"])
def test_query_equals_sql(spark, duck, sf_dir, name):
    cols, got = spark_rows(queries.queries()[name](spark, sf_dir))
    assert got and (cols, got) == duck_rows(duck, queries.oracle_sql()[name])


# ---- Exact dedup ------------------------------------------------------------------------------------------------------------
def brute_dedup(rows):
    norm = [SPACE.sub("", r[1] or "") for r in rows]
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[norm[i]].append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    return [(rows[i][0], None if min(groups[t])[1] else min(groups[t])[2], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(norm)], len(groups)


@pytest.mark.parametrize("block,chunk", [(1024, 1 << 23), (3, 2000), (16, 1)])
def test_exact_dedup(spark, docs, rows, block, chunk):
    out = block_names.op13(spark, docs, block, chunk).collect()
    want, n = brute_dedup(rows)
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out), key=key) == sorted(want, key=key)
    assert sum(r["kept"] for r in out) == n
    assert all(r["keep_id"] == r["doc_id"] for r in out if r["kept"])


def test_names_tell_blocks_and_orders_apart(spark):
    texts = ["ab", "ba", "abab", "abba", "aba b", "ababab", "ababababab", "abababab", "abab" * 3, "a", "", " \n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["keep_id"] for r in block_names.op13(spark, df, 2, 6).collect()}
    norm = [SPACE.sub("", t or "") for t in texts]
    for a in out:
        for b in out:
            assert (out[a] == out[b]) == (norm[a] == norm[b])


def test_exact_dedup_keeps_one_row_with_all_columns(spark, docs, rows):
    kept = block_names.keep_one(spark, docs)
    assert kept.columns == docs.columns
    got = [SPACE.sub("", r["text"] or "") for r in kept.collect()]
    assert len(got) == len(set(got)) == brute_dedup(rows)[1]


def test_a_block_of_many_documents_enters_the_exchange_once_a_chunk(spark):
    df = spark.createDataFrame([(i, "same words " * 20) for i in range(3000)], "doc_id long, text string").repartition(4)
    parts = Scratch(spark, "t").save(block_names._cut(df, 8, 1 << 15), "parts")
    chunks = parts.select("chunk").distinct().count()
    assert chunks > 8 and parts.filter("key IS NOT NULL").groupBy("key").count().agg({"count": "max"}).first()[0] <= chunks
    assert block_names.op13(spark, df, 8, 1 << 15).agg({"group_size": "min"}).first()[0] == 3000


def test_nothing_gives_nothing(spark, none):
    assert block_names.op13(spark, none).count() == block_names.keep_one(spark, none).count() == 0
    assert divergence.audit(spark, none).count() == 0
    assert lexical_search.search(spark, none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# ---- Search -----------------------------------------------------------------------------------------------------------------
def search_terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute_search(rows, items, top):
    counts = [(r[0], Counter(search_terms(r[1]))) for r in rows]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in set(items):
        found = []
        for doc_id, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in search_terms(text) if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:top])]
    return out


ITEMS = [(1, "REP eat this now"), (1, "REP eat this now"), (2, "one two three two two"), (2, "another text of the same id one"), (None, "text tail changed"), (4, ""), (5, None), (6, "nowhere-to-be-found"), (7, "日本語 ééé apache license 2.0")]


@pytest.mark.parametrize("item_bytes,shard_docs,shard_terms", [(1 << 22, 1 << 15, 1 << 21), (1, 5, 1 << 21), (40, 1 << 15, 100)])
def test_search(spark, docs, rows, item_bytes, shard_docs, shard_terms):
    more = [(100 + k, " ".join((rows[k][1] or "").split()[:40]) + " rep rep one") for k in range(8)]
    items = spark.createDataFrame([(*i, "x") for i in ITEMS + more], "item_id long, text string, doc_id string")
    out = lexical_search.search(spark, docs, items, 20, item_bytes, shard_docs, shard_terms)
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, out.select("item_id", "rank", "doc_id", "score").collect()), key=key) == sorted(brute_search(rows, ITEMS + more, 20), key=key)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 30), st.integers(1, 6), min_size=1), min_size=1, max_size=6), st.lists(st.integers(1, 3), min_size=6, max_size=6), st.integers(1, 4))
def test_merge_is_exact_whatever_it_skips(lists, reps, top):
    total = Counter()
    for x, r in zip(lists, reps, strict=False):
        for doc, gives in x.items():
            total[doc] += gives * r
    args = [(sorted(x), [x[d] for d in sorted(x)], max(x.values()), r) for x, r in zip(lists, reps, strict=False)]
    best = []
    lexical_search.merge(args, list(range(100, 131)), best, top)
    assert sorted(best, reverse=True) == [(s, 1, -d - 100) for d, s in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:top]]


@given(st.lists(st.integers(0, 2**62), max_size=30))
def test_packed_numbers_come_back(numbers):
    blob = b"xx" + lexical_search.pack(np.array(numbers, dtype=np.int64))
    got, end = lexical_search.unpack(blob, len(numbers), 2)
    assert got.tolist() == numbers and end == len(blob)


# ---- Divergence -------------------------------------------------------------------------------------------------------------
def brute_divergence(rows):
    """rows: text, lang, source."""
    words = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)))) for t, lang, source in rows]
    out = []
    for lang in {w[0] for w in words}:
        df, n, by = Counter(), Counter(), defaultdict(Counter)
        for x, source, c in words:
            if x == lang:
                df.update(c.keys())
                n.update(c)
                by[source].update(c)
        kept = {t for t in df if df[t] >= 3}
        v = len(kept)
        p = lambda c, t, v=v, kept=kept: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + v)
        f = lambda a, b: (a - b) ** 2 // b
        table = {s: {t: p(c, t) for t in kept} for s, c in by.items()}
        whole = {t: p(n, t) for t in kept}
        for s in by:
            pairs = [(-sum(f(table[s][t], table[o][t]) for t in kept), o) for o in by if o != s]
            words_ = [(-f(table[s][t], whole[t]), t) for t in kept if by[s][t] and table[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", sorted(words_, key=lambda x: (x[0], x[1].encode()))[:200])):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())))]
    return sorted(out)


@pytest.mark.parametrize("width", [1 << 16, 2])
def test_divergence(spark, docs, rows, width):
    df = docs.select("text", "lang", "source", "doc_id", "size")
    got = sorted(map(tuple, divergence.audit(spark, df, width=width).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == brute_divergence([(r[1], r[2], r[3]) for r in rows])


def test_divergence_of_odd_groups(spark):
    rows = [("only here", "en", "a"), ("only here", "en", "a"), ("Only HERE b", "en", None), (None, "en", "c"), ("", None, None), ("x1y", "fr", "q"), ("x y", "fr", "r"), ("x", "fr", "r"), ("é", "de", "s"), ("é", "de", "t"), ("É é", "de", "t")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = sorted(map(tuple, divergence.audit(spark, df, width=64).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == brute_divergence(rows) and {r[0] for r in got} == {"en", "fr", "de"}


def test_sketch_never_underestimates_and_drops_terms_early(spark, docs, rows):
    d = divergence._documents(docs)
    for width, sharp in ((1 << 16, True), (16, False)):
        sketch = divergence.merged(d, Scratch(spark, "t"), width)
        df = Counter((r[2] or "", t) for r in rows for t in set(divergence.terms(r[1])))
        keys = list(df)
        least = sketch.least([divergence._key(lang, t) for lang, t in keys]).tolist()
        assert all(a >= min(255, df[k]) for a, k in zip(least, keys, strict=True))
        sent = divergence.counted(d, sketch).select("term").distinct().count()
        assert (sent < len({t for _, t in df})) == sharp


# ---- Rows that must not be lost ---------------------------------------------------------------------------------------------
def test_rows_that_tie_but_differ_each_get_one_slot(spark):
    rows = [(1, "same text", i) for i in range(200)] + [(2, None, 7)] * 40 + [(None, "", 8)] * 3
    want = sorted(map(str, rows))
    for parts in (1, 4, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string, nth int").repartition(parts)
        out = sharding.sharded_documents(df, 5).collect()
        assert sorted(str((r["doc_id"], r["text"], r["nth"])) for r in out) == want
        assert len({(r["shard"], r["slot"]) for r in out}) == len(rows)
        assert max(Counter(r["shard"] for r in out).values()) - min(Counter(r["shard"] for r in out).values()) <= 1


def test_row_numbers_split_a_key_over_parts(spark):
    df = Scratch(spark, "t").save(spark.range(5000).selectExpr("id % 3 = 0 AS k", "id").repartition(6).selectExpr("IF(k, NULL, 1) AS k", "monotonically_increasing_id() AS _row"), "rows")
    got = sharding.row_numbers(df, "k").collect()
    for k, n in Counter(r["k"] for r in got).items():
        assert sorted(r["_copy"] for r in got if r["k"] == k) == list(range(n))
    assert len({r["_row"] for r in got}) == 5000


def test_mix_tells_rows_apart_by_their_maps(spark):
    schema = "doc_id long, text string, source string, m map<string,string>, n struct<a:array<map<string,int>>>"
    rows = [(1, "a b c d", "s", {"k": f"v{i}"}, ([{"x": i}],)) for i in range(4)] + [(1, "a b c d", "s", {"k": "v1"}, ([{"x": 1}],))] * 2
    out = mixing.mixed_documents(spark, spark.createDataFrame(rows, schema)).collect()
    assert sorted(r["m"]["k"] for r in out) == ["v0", "v1", "v1", "v1", "v2", "v3"]
    assert all(r["n"]["a"] == [{"x": int(r["m"]["k"][1])}] for r in out)


def test_mix_of_copies_is_repeatable(spark, docs):
    many = docs.unionByName(docs).unionByName(docs.limit(5))
    a, b = (sorted(map(str, mixing.mixed_documents(spark, d).collect())) for d in (many, many.repartition(7)))
    assert a == b and len(a) > 100


def test_a_file_that_is_written_twice_is_read_once(spark, docs, tmp_path):
    folder = f"file://{tmp_path}"
    first = tokens.write_shards(docs, tokens.default_tokenizer(), 2, folder, 3).collect()
    manifest = spark.createDataFrame(tokens.write_shards(docs, tokens.default_tokenizer(), 2, folder, 3).collect(), "file_no long, path string, n_docs long, n_tokens long")
    assert not {r["path"] for r in first} & {r["path"] for r in manifest.collect()}
    assert tokens.read_shards(manifest, folder, 3).count() == docs.count()
    assert tokens.drop_unnamed(manifest, folder) == len(first)
    assert tokens.read_shards(manifest, folder, 3).count() == docs.count()


def test_identifiers_without_their_tag_score_low(spark):
    from quire.llm import licenses

    texts = ["we met at epl 2 0 football score", "SPDX-License-Identifier: EPL-2.0", "dual licensed under MIT and Apache-2.0", "spdx license identifier apache 2 0 only"]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == ("epl-2.0", 0.3) and got[1] == ("epl-2.0", 1.0) and "apache-2.0" in got[2][0] and got[3][1] == 1.0


# ---- Quality queries against their rules in Python --------------------------------------------------------------------------
def features(text, names):
    from test_operators import stats
    from test_operators import words as split

    t = text or ""
    n, chars, symbols, dup, repeat = stats(t)
    lines = [x for x in t.split("\n") if split(x)]
    all_ = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "n_lines": len(lines), "n_distinct_words": len(set(split(t)))}
    all_ |= {"n_digits": len(re.findall("[0-9]", t)), "n_upper": len(re.findall("[A-Z]", t)), "n_stops": len(re.findall("[.!?]", t))}
    from quire.llm import textstats

    ratio = lambda name: all_[textstats.RATIOS[name][0]] / all_[textstats.RATIOS[name][1]] if all_[textstats.RATIOS[name][1]] else 0.0
    return all_, [ratio(x) if x in textstats.RATIOS else float(all_[x]) for x in names]


def test_op5_query_against_its_rules(spark, sf_dir):
    from quire.llm import decision_list, textstats

    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    rules = decision_list.fit(spark, docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = queries.queries()["op5_decision_list"](spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        counts, x = features(texts[r["doc_id"]], textstats.LIST_FEATURES)
        failed = counts["n_words"] < 10 or 100 * counts["n_repeat_words"] > 20 * counts["n_words"]
        hit = next((k for k, rule in enumerate(rules.rules) if rule.matches(np.array([x]), textstats.LIST_FEATURES)[0]), None)
        assert tuple(r[c] for c in textstats.COUNTS) == tuple(counts[c] for c in textstats.COUNTS)
        assert r["base_failed"] == failed and r["kept"] == (not failed and hit is None)


def test_op10_query_against_its_rules(spark, sf_dir):
    import zlib

    from quire.llm import rule_ensemble, textstats

    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = rule_ensemble.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = queries.queries()["op10_rule_ensemble"](spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        x = np.array([features(texts[r["doc_id"]], textstats.SCORE_FEATURES)[1]])
        z = model.intercept + sum(w * rule_ensemble.covers(rule, x)[0] for rule, w in zip(model.rules, model.weights, strict=True))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7)
