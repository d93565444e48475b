"""Commands taken back, made again and refused; logs as batches and as streams."""

import random

import pytest

from quire.operators import edits
from quire.plans import edit_queries
from quire.sources import markup

PAGE = (
    "<html lang=en><title>T</title><body><h1>One</h1><p>para</p><img src=a alt=cat><img src=b alt=''><ul><li>x<li>y<li>z</ul><table><tr><td>a<td>b<tr><td>c<td>d</table>"
    "<form><input name=n value=7 title=N><input type=checkbox name=c><textarea readonly>kept</textarea><input type=submit value=Go></form></body></html>"
)


@pytest.fixture(scope="module")
def model(spark):
    rows = edits.model_of(markup.page_tree(spark.createDataFrame([(1, PAGE)], "page_id long, html string"))).collect()
    return {r["slot"]: r["value"] for r in rows}


def held(slots):
    return {k: v for k, v in slots.items() if v is not None}


def some_step(rng, number, slots):
    """A command of any kind on any element, fit or not."""
    ids = sorted({k.split(":")[0] for k in slots if k.endswith(":kind")})
    kind = rng.choice(list(edits.COMMANDS))
    fit = [i for i in ids if not edits.COMMANDS[kind] or slots.get(f"{i}:kind") in edits.COMMANDS[kind]]
    target = rng.choice(fit if fit and rng.random() < 0.9 else ids)
    value = rng.choice(["1", "3", "9", "Data", "RowHeader", "", None, " new text ", "Yes", "-2"])
    return ("make", number, kind, target, value)


def test_every_command_changes_what_it_says(model):
    slots, commands = dict(model), {}
    find = lambda kind, nth=0: [k.split(":")[0] for k, v in sorted(model.items(), key=lambda x: int(x[0].split(":")[0])) if k.endswith(":kind") and v == kind][nth]
    n = 0

    def make(kind, target, value=None):
        nonlocal n
        n += 1
        return edits.step("make", n, kind, target, value, slots, commands)

    assert make("AltText", find("Figure"), " a cat ") == "done" and slots[f"{find('Figure')}:alt"] == "a cat"
    assert make("Decorative", find("Figure")) == "done" and slots[f"{find('Figure')}:alt"] is None
    assert make("AltText", find("Heading"), "x") == "wrong target" and make("Nothing", "2") == "unknown command"
    assert make("HeadingLevel", find("Heading"), "7") == "no such level" and make("HeadingLevel", find("Heading"), "2") == "done"
    assert make("CellRole", find("TableCell"), "Boss") == "no such role" and make("HeaderRow", find("TableRow")) == "done" and slots[f"{find('TableCell', 1)}:role"] == "ColumnHeader" and slots[f"{find('TableCell', 2)}:role"] == "Data"
    assert make("FieldValue", find("FormField", 2), "x") == "read-only" and make("FieldValue", find("FormField", 1), "maybe") == "not a state" and make("FieldValue", find("FormField"), "8") == "done"
    assert make("ResetForm", "0") == "done" and slots[f"{find('FormField')}:value"] is None and slots[f"{find('FormField', 2)}:value"] == "kept" and make("ResetForm", "0") == "nothing to clear"
    assert make("Language", "0", "cy") == "done" and make("Title", "0", " ") == "done" and slots["0:language"] == "cy" and slots["0:title"] is None
    items = slots[f"{find('List')}:order"].split(",")
    assert make("Move", items[2], "0") == "done" and slots[f"{find('List')}:order"].split(",") == [items[2], items[0], items[1]] and make("Move", items[0], "x") == "no such place"
    assert make("Artifact", find("Paragraph")) == "done" and slots[f"{find('Paragraph')}:kind"] == "Artifact" and make("Sign", find("FormField"), "") == "nothing to draw"
    assert make("AddAnnotation", items[2], "note") == "done" and slots[f"{find('List')}:order"].split(",")[1] == str(-n)
    first = n
    assert make("AddAnnotation", items[2], "second") == "done" and slots[f"{find('List')}:order"].split(",")[2] == str(-n)
    assert make("ReplyAnnotation", str(-first), "answer") == "done" and slots[f"{-n}:in_reply_to"] == str(-first)
    assert make("EditAnnotation", str(-first), "new") == "done" and make("DeleteAnnotation", str(-first)) == "done" and make("DeleteAnnotation", str(-first)) == "not attached"
    deleted = n - 1
    assert edits.step("apply", deleted, None, None, None, slots, commands) == "already applied"
    assert edits.step("revert", deleted, None, None, None, slots, commands) == "done" and slots[f"{find('List')}:order"].split(",")[1] == str(-first)
    assert edits.step("revert", deleted, None, None, None, slots, commands) == "not applied" and edits.step("revert", 999, None, None, None, slots, commands) == "no such command" and edits.step("make", 1, "Sign", "0", "", slots, commands) == "number is taken"


@pytest.mark.parametrize("seed", range(12))
def test_taking_any_start_of_a_log_back_restores_the_model(model, seed):
    rng, slots, commands, done = random.Random(seed), dict(model), {}, []
    for number in range(1, 61):
        before = held(slots)
        outcome = edits.step(*some_step(rng, number, slots), slots, commands)
        if outcome == "done":
            done.append((number, before))
        else:
            assert held(slots) == before, "a refused command changes nothing"
        if number % 7 == 0 and done:  # there and back
            now = held(slots)
            assert edits.step("revert", done[-1][0], None, None, None, slots, commands) == "done" and held(slots) == done[-1][1]
            assert edits.step("apply", done[-1][0], None, None, None, slots, commands) == "done" and held(slots) == now
    assert len(done) > 20
    for number, before in reversed(done):
        assert edits.step("apply", number, None, None, None, slots, commands) == "already applied"
        assert edits.step("revert", number, None, None, None, slots, commands) == "done"
        assert edits.step("revert", number, None, None, None, slots, commands) == "not applied"
        assert held(slots) == before
    assert held(slots) == model


def test_fold_and_query_give_what_single_steps_give(spark, sf_dir):
    tree = edit_queries.edited_pages(spark, sf_dir)
    log = sorted(edit_queries.command_log(spark, sf_dir, tree).collect(), key=lambda r: (r["doc_id"], r["seq"]))
    models = {}
    for r in edits.model_of(tree).collect():
        models.setdefault(r["doc_id"], {})[r["slot"]] = r["value"]
    want, state, commands = [], {}, {}
    for r in log:
        slots = state.setdefault(r["doc_id"], dict(models[r["doc_id"]]))
        want.append((r["doc_id"], r["seq"], r["number"], edits.step(r["action"], r["number"], r["kind"], r["target"], r["value"], slots, commands.setdefault(r["doc_id"], {}))))
    out = edit_queries.commands(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["seq"], r["number"], r["outcome"]) for r in out if r["seq"] is not None) == sorted(want)
    changed = {(d, s, v) for d, slots in state.items() for s, v in slots.items() if v != models[d].get(s)}
    assert {(r["doc_id"], r["slot"], r["value"]) for r in out if r["seq"] is None} == changed
    outcomes = {r[3] for r in want}
    assert {"done", "wrong target", "not applied", "already applied", "not attached"} <= outcomes


def test_stream_gives_what_the_batch_gives(spark, tmp_path, model):
    rng, slots, commands, rows = random.Random(5), dict(model), {}, []
    for number in range(1, 40):
        s = some_step(rng, number, slots)
        edits.step(*s, slots, commands)
        rows.append((1, len(rows), *s))
        if number % 5 == 0:
            rows.append((1, len(rows), "revert", rng.randint(1, number), None, None, None))
            edits.step("revert", rows[-1][3], None, None, None, slots, commands)
    schema = "doc_id long, seq long, action string, number int, kind string, target string, value string"
    load = [(1, -1, "load", 0, k, None, v) for k, v in model.items()]
    spark.createDataFrame(load + rows[:25], schema).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame(rows[25:], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in ("a", "b"):  # two runs over one checkpoint: what the first left is found by the second
            source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in/" + ("a" if part == "a" else "*"))
            done = source.groupBy("doc_id").transformWithStateInPandas(edits.CommandProcessor(), edits.CommandProcessor.OUTPUT, "Append", "None")
            done.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("seq", "number", "outcome").collect()))
    m = spark.createDataFrame([(1, k, v) for k, v in model.items()], "doc_id long, slot string, value string")
    batch = edits.commands_of(m, spark.createDataFrame(rows, schema)).filter("seq IS NOT NULL")
    assert got == sorted(map(tuple, batch.select("seq", "number", "outcome").collect())) and len(got) == len(rows)


def test_history_of_one_user_holds_pointers_only(spark):
    rng = random.Random(2)
    rows = [(1, i, rng.choice(["edit", "edit", "undo", "redo"])) for i in range(4000)]
    done, undone, made, want = [], [], 0, []
    for _, i, op in rows:
        refused = (op == "undo" and not done) or (op == "redo" and not undone)
        if op == "edit":
            made, undone = made + 1, []
            done.append(made)
        elif not refused:
            (undone if op == "undo" else done).append((done if op == "undo" else undone).pop())
        want.append((i, done[-1] if done else 0, refused))
    got = edits.history(spark.createDataFrame(rows, "doc_id long, seq long, op string")).collect()
    assert sorted((r["seq"], r["top"], r["refused"]) for r in got) == want
