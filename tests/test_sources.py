import datetime
import random
from html.parser import HTMLParser

from quire.operators import changes, render, tree
from quire.operators import audit
from quire.plans import audit_queries
from quire.sources import adapters, markup
from quire.sources import loader
from quire.streaming import streams


def test_first_existing(tmp_path):
    f = tmp_path / "a.pdf"
    f.write_text("x")
    assert loader.first_existing(["", "  ", str(tmp_path), "/no/such", f' "{f}" ', "b"]) == str(f)
    assert loader.first_existing(["\0bad"]) is None


def test_settings(tmp_path):
    s = loader.Settings(verbosity="Terse")
    for k in range(12):
        s.opened(f"f{k}")
    s.opened("F5")
    s.save(str(tmp_path / "s.json"))
    assert loader.Settings.load(str(tmp_path / "s.json")) == s and s.recent_files[0] == "F5" and len(s.recent_files) == 10
    (tmp_path / "bad.json").write_text("[1")
    assert loader.Settings.load(str(tmp_path / "bad.json")) == loader.Settings()


def test_bad_pages_become_errors(spark):
    df = spark.createDataFrame([(1, "<html></html>"), (2, None), (3, " "), (4, "plain")], "page_id long, html string")
    good, bad = loader.load_pages(df)
    assert [r["page_id"] for r in good.collect()] == [1]
    assert {r["page_id"]: r["error"] for r in bad.collect()} == {2: "missing", 3: "empty", 4: "not html"}


def test_load_tables(spark, sf_dir):
    good, bad = loader.load_tables(spark, {"a": f"{sf_dir}/region.parquet", "b": f"{sf_dir}/none.parquet"})
    assert set(good) == {"a"} and set(bad) == {"b"}


def test_publish(spark, tmp_path):
    path = str(tmp_path / "t")
    assert render.publish(spark.range(3), path, lambda d: d.count() == 3) == "saved"
    assert render.publish(spark.range(1), path, lambda d: d.count() == 3) == "refused"
    assert spark.read.parquet(path).count() == 3
    assert render.publish(spark.range(5), path, lambda d: True) == "saved" and spark.read.parquet(path).count() == 5


def test_audit_stream_gives_what_the_batch_gives(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages.repartition(3).write.parquet(str(tmp_path / "in"))

    def blank_titles(df):
        return df.filter(~df["html"].rlike("<title>[^<]+")).select("page_id")

    q = streams.audit_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), blank_titles)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == blank_titles(pages).count()


def test_merge_stream_gives_what_the_batch_gives(spark, tmp_path):
    t = lambda s: datetime.datetime(2026, 1, 1, 10, 0) + datetime.timedelta(seconds=s)
    set_, edit, other = "SetFieldValue", "EditAnnotation", "SetTitle"
    rows = [
        (1, 1, t(0), set_, "a", "1"), (1, 2, t(1.5), set_, "a", "2"), (1, 3, t(3), set_, "a", "3"), (1, 4, t(3.5), set_, "b", "4"), (1, 5, t(4), set_, "a", "5"), (1, 6, t(4.5), set_, "a", "6"),
        (1, 7, t(5), edit, "a", "7"), (1, 8, t(20), other, "t", "8"), (1, 9, t(21), other, "t", "9"), (2, 1, t(0), edit, "n", "x"), (2, 2, t(2), edit, "n", "y"), (9, 1, t(900), "x", "x", ""),
    ]
    schema = "doc_id long, seq int, made_at timestamp, op string, target string, value string"
    log = spark.createDataFrame(rows, schema)
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    edits = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("made_at", "1 second")
    q = streams.merge_stream(edits).writeStream.format("memory").queryName("merged").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["doc_id"], r["value"], r["op"], r["target"], r["n"]) for r in spark.sql("SELECT * FROM merged WHERE doc_id < 9").collect())
    want = sorted((r["doc_id"], r["value"], r["op"], r["target"], r["n"]) for r in changes.merged_edits(log).filter("doc_id < 9").collect())
    assert got == want and [w[4] for w in want if w[0] == 1] == [2, 1, 1, 2, 1, 1, 1]


def brute_merge(rows, window, ops):
    out = {}
    for doc, seq, s, op, target, value in sorted(rows):
        entries = out.setdefault(doc, [])
        if entries and (ops is None or op in ops) and entries[-1][:2] == [op, target] and s - entries[-1][2] <= window:
            entries[-1][4] += 1
            entries[-1][5] = value
        else:
            entries.append([op, target, s, seq, 1, value])
    return sorted((d, k + 1, e[0], e[1], e[3], e[4], e[5]) for d, es in out.items() for k, e in enumerate(es))


def test_folds_over_a_long_log_of_one_user(spark):
    rng = random.Random(1)
    rows, at = [], 0.0
    for seq in range(30_000):
        at += rng.choice((0.3, 1.0, 2.5))
        rows.append((rng.choice((1, 1, 1, 2)), seq, at, rng.choice(("SetFieldValue", "SetFieldValue", "SetTitle")), rng.choice("aab"), str(seq)))
    log = spark.createDataFrame(rows, "doc_id int, seq int, s double, op string, target string, value string").selectExpr("doc_id", "seq", "timestamp_micros(cast(s * 1000000 as bigint)) AS made_at", "op", "target", "value")
    assert sorted(map(tuple, changes.merged_edits(log).collect())) == brute_merge(rows, 2.0, changes.MERGING)
    kept, last = [], {}
    for doc, seq, s, *_ in rows:
        if doc not in last or s - last[doc] >= 2.0 - 1e-9:
            kept.append((doc, seq))
            last[doc] = s
    assert abs(changes.throttled(log, 2.0).count() - len(kept)) <= 2
    steps = [(d, q, rng.choice(("do", "do", "undo", "redo")), str(q)) for d, q, *_ in rows]
    state = {r["doc_id"]: r for r in changes.undo_state(spark.createDataFrame(steps, "doc_id int, seq int, op string, target string")).collect()}
    for doc in (1, 2):
        done, undone, refused = [], [], 0
        for d, _, op, id_ in steps:
            if d != doc:
                continue
            if op == "undo" and done:
                undone.append(done.pop())
            elif op == "redo" and undone:
                done.append(undone.pop())
            elif op == "do":
                done.append(id_)
                undone = []
            else:
                refused += 1
        assert (state[doc]["done"], state[doc]["undone"], state[doc]["refused"]) == (",".join(done), ",".join(undone), refused)


def test_trees_of_a_million_elements_and_of_great_depth(spark):
    n = 1_200_000
    wide = spark.range(n).selectExpr("id div 1000 AS doc_id", "id % 1000 AS element_id", "CASE WHEN id % 1000 > 0 THEN (id % 1000 - 1) div 10 END AS parent_id", "id % 1000 AS sibling_ord")
    got = tree.paths(spark, wide).selectExpr("count(*)", "max(depth)", "max(reading_order)", "min(depth)").first()
    assert tuple(got) == (n, 3, 999, 0)
    chain = spark.range(300).selectExpr("1 AS doc_id", "id AS element_id", "CASE WHEN id > 0 THEN id - 1 END AS parent_id", "0 AS sibling_ord")
    walked = tree.paths(spark, chain)
    assert walked.agg({"depth": "max"}).first()[0] == 299 and tree.descendants(walked).count() == 300 * 299 // 2
    assert tree.paths(spark, chain, 64).count() == 65
    ring = spark.createDataFrame([(1, 1, 2, 0), (1, 2, 1, 0), (1, 3, None, 0), (1, 4, 3, 1), (1, 5, 3, 0)], "doc_id int, element_id int, parent_id int, sibling_ord int")
    assert [(r["element_id"], r["depth"]) for r in tree.paths(spark, ring).orderBy("reading_order").collect()] == [(3, 0), (5, 1), (4, 1)]
    assert tree.paths(spark, ring.limit(0)).count() == 0


def test_one_pass_finds_what_the_rules_find(spark, sf_dir):
    pages = adapters.customer_pages(spark, sf_dir)
    key = lambda r: tuple(map(str, r))
    once = sorted(map(tuple, audit_queries.markup_issues(pages).select(*audit.COLUMNS).collect()), key=key)
    each = sorted(map(tuple, audit.audit(audit_queries.markup_corpus(pages)).select(*audit.COLUMNS).collect()), key=key)
    assert once == each and {r[2].split(" ")[0] for r in once} == {"R1", "R2", "R3", "R4", "R5", "R6", "R8", "R9", "R10", "R12"}


class Reader(HTMLParser):
    """A page's elements with their parents by Python's parser, and all text that is shown."""

    ENDS = {"p": "p", "li": "li", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "", "tbody": "thead tr td th", "ul": "p", "ol": "p", "table": "p", "div": "p", "section": "p", "form": "p", "blockquote": "p", "h1": "p", "h2": "p", "h3": "p", "nav": "p", "footer": "p", "article": "p"}
    WALLS = {"li": "ul ol", "p": "td th table", "td": "table", "th": "table", "tr": "table", "tbody": "table", "option": "select"}

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.open, self.found, self.text, self.skip = [], [], "", False
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.skip = self.skip or tag in ("script", "style")
        if tag in markup.INLINE or tag in markup.SILENT or self.skip:
            return
        ends, walls = self.ENDS.get(tag, "").split(), self.WALLS.get(tag, "td th table").split()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] in ends:
                del self.open[i:]
            elif self.open[i] in walls:
                break
        if dict(attrs).get("type") != "hidden":
            self.found.append((tag, tuple(t for t in self.open if t not in markup.PASS)))
        if tag not in markup.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        self.skip = self.skip and tag not in ("script", "style")
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data):
        self.text += "" if self.skip else data


def test_trees_against_an_html_parser(spark, sf_dir):
    """Every element with its ancestors, but for those inside furniture, and every character of text, once."""
    pages = adapters.read(spark, sf_dir, "pages", "page_id", "html").unionByName(adapters.customer_pages(spark, sf_dir).selectExpr("page_id + 1000000 AS page_id", "html"))
    got = {}
    for r in markup.page_tree(pages).orderBy("doc_id", "element_id").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for page in pages.collect():
        rows, reader = got[page["page_id"]], Reader(page["html"])
        by_id = {r["element_id"]: r for r in rows}

        def above(r, by_id=by_id):
            return () if r["parent_id"] is None else (*above(by_id[r["parent_id"]]), by_id[r["parent_id"]]["tag"])

        furniture = {r["element_id"] for r in rows if r["kind"] == "Artifact"}
        mine = [(r["tag"], above(r)) for r in rows if r["tag"] != "#text"]
        hidden = [x for x in reader.found if x[0] not in markup.PASS and not any(t in ("footer", "aside") for t in x[1])]
        assert mine == hidden, page["page_id"]
        shown = [r["text"] for r in rows if r["tag"] == "#text" or r["element_id"] in furniture or r["tag"] in markup.NAMED]
        assert "".join("".join(shown).split()) == "".join(reader.text.split())
        assert all(r["last_id"] == max([x["element_id"] for x in rows if x["parent_id"] == r["element_id"]] + [by_id[x["element_id"]]["last_id"] for x in rows if x["parent_id"] == r["element_id"]] + [r["element_id"]]) for r in rows)


def test_odd_markup(spark):
    tree = lambda html: [(r[5], r[8], r[4]) for r in markup.tree(html) if r[5] != "#text" or r[6] == "Paragraph"]
    assert markup.tree(None) == markup.tree("") == markup.tree("<!-- only --><br>") == []
    assert tree("<ul><li>one<ul><li>inner</li></ul>tail</li></ul><p>x</p> loose text") == [("ul", "", 0), ("li", "one tail", 1), ("ul", "", 2), ("li", "inner", 3), ("p", "x", 0), ("#text", "loose text", 0)]
    assert tree("<p>a <b>b<p>c</b> d") == [("p", "a b", 0), ("p", "c d", 0)]
    assert tree("</p></div><td>x</td>1 < 2 &copy; &#8212;") == [("td", "x", 0), ("#text", "1 < 2 © —", 0)]
    assert tree("<table><tr><td><ul><li>a</table><li>b") == [("table", "", 0), ("tr", "", 1), ("td", "", 2), ("ul", "", 3), ("li", "a", 4), ("li", "b", 0)]
    assert markup.attributes(" A='x \"y\"' b = c/d e f=\"1&amp;2\" a=2") == {"a": 'x "y"', "b": "c/d", "e": "", "f": "1&2"}
    fields = [r[7] for r in markup.tree("<form><label for=n>Your name</label><br><input id=n> or <label>Mail <input id=m></label> then <input></form>") if r[6] == "FormField"]
    assert [(f.get("#label"), f["#before"]) for f in fields] == [("Your name", ""), ("Mail", "Mail"), (None, "then")]
    deep = "<div>" * 3000 + "x"
    assert [(r[4], r[3]) for r in markup.tree(deep)][-2:] == [(2999, 6001), (3000, 6001)]


def test_pairs_of_a_deep_tree(spark):
    pages = spark.createDataFrame([(1, "<div>" * 300 + "x"), (2, "<p>a<p>b")], "page_id long, html string")
    pairs = tree.interval_pairs(markup.page_tree(pages))
    assert {r["doc_id"]: r["n"] for r in pairs.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()} == {1: 300 * 301 // 2, 2: 2}
