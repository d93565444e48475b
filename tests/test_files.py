"""Files that fail one by one, and saves that are stopped at each step."""

import json

import pytest

from quire.operators import versions
from quire.sources import files

PAGE = "<html><p>one</p></html>"


def test_each_file_gives_its_pages_or_its_failure(spark, tmp_path):
    put = {
        "a.html": PAGE.encode(), "b.html": f"{PAGE}\f{PAGE}é".encode(), "c.html": b"\xff\xfe", "d.html": b"no markup", "e.zip": files.zipped([PAGE, PAGE]), "f.zip": files.damaged(files.zipped([PAGE, PAGE])),
        "g.zip": files.zipped([PAGE], locked=True), "h.zip": b"PK not an archive", "i.html": f"{PAGE}\f \f{PAGE}".encode(), "j.html": b"",
    }
    for name, raw in put.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "k.dir").mkdir()
    paths = [str(tmp_path / n) for n in put] + [str(tmp_path / "none.html"), str(tmp_path / "k.dir"), " ", f"file://{tmp_path}/a.html"]
    for group in (1, 3, 64):
        good, bad = files.load_files(spark, paths, group=group)
        name = lambda r: r["path"].rsplit("/", 1)[-1]
        assert sorted((name(r), r["page_no"]) for r in good.collect()) == sorted([("a.html", 1), ("a.html", 1), ("b.html", 1), ("b.html", 2), ("e.zip", 1), ("e.zip", 2), ("f.zip", 2), ("i.html", 1), ("i.html", 3)])
        assert sorted((name(r), r["page_no"] or 0, r["problem"]) for r in bad.collect()) == sorted([
            ("c.html", 0, "malformed"), ("d.html", 0, "malformed"), ("f.zip", 1, "page"), ("g.zip", 0, "locked"), ("h.zip", 0, "malformed"), ("i.html", 2, "page"), ("j.html", 0, "malformed"),
            ("none.html", 0, "missing"), ("k.dir", 0, "unreadable"), (" ", 0, "no file"),
        ])
        assert good.rdd.getNumPartitions() == -(-len(paths) // group)
    good, bad = files.load_files(spark, str(tmp_path))
    assert good.count() == 8 and bad.filter("problem <> 'page'").count() == 5
    assert [r[4:] for r in files.read_document(str(tmp_path / "g.zip"), "wrong")] == [("locked", "the password is wrong")]


def test_no_permission_is_said(monkeypatch):
    class Closed:
        def open_input_stream(self, *a, **k):
            raise PermissionError("no")

    monkeypatch.setattr(files.pyarrow.fs, "LocalFileSystem", Closed)
    assert [r[1] + ": " + r[4] for r in files.read_document("/x")] == ["failed: no permission"]


def test_saves_and_refusals(spark, tmp_path):
    table = versions.Versions(spark, f"file://{tmp_path}/t")
    one, two = spark.range(5).selectExpr("id", "concat('text ', id) AS text"), spark.range(6).selectExpr("id", "concat('words ', id) AS text")
    check = versions.losses("id", "text")
    assert table.read() is None and table.save(one, check) == "saved" and table.save(two, check, after=1) == "saved"
    assert table.save(one, check).startswith("refused: 1 rows") and table.save(two.selectExpr("id", "'x' AS text"), check).startswith("refused: text would shrink") and table.save(two, check, after=1) == "lost"
    assert table.manifest()["number"] == 2 and table.read().count() == 6 and table.read(1).count() == 5 and table.manifest()["rows"] == 6
    assert table.clean(keep=2) == 0 and table.clean() == 1 and table.read(1) is None and table.read().count() == 6
    assert table.save(two.withColumn("m", versions.F.create_map("id", "text"))) == "saved" and table.save(two.limit(0)) == "saved" and table.read().count() == 0


@pytest.mark.parametrize("stage", ["_write", "_name", "_rename"])
@pytest.mark.parametrize("late", [False, True])
def test_a_save_that_is_stopped_leaves_one_version_whole(spark, tmp_path, monkeypatch, stage, late):
    table = versions.Versions(spark, f"file://{tmp_path}/t")
    assert table.save(spark.range(3).toDF("id")) == "saved"
    real = getattr(table, stage)

    def stop(*args):
        if late:
            real(*args)
        raise RuntimeError("the driver is gone")

    monkeypatch.setattr(table, stage, stop)
    with pytest.raises(RuntimeError):
        table.save(spark.range(7).toDF("id"))
    again = versions.Versions(spark, f"file://{tmp_path}/t")
    number = 2 if late and stage != "_write" else 1
    assert again.manifest()["number"] == number and again.read().count() == (7 if number == 2 else 3)
    again.clean()
    assert again.read().count() == (7 if number == 2 else 3) and again.save(spark.range(9).toDF("id")) == "saved" and again.read().count() == 9


def test_of_two_savers_one_is_told_that_it_lost(spark, tmp_path):
    a, b = (versions.Versions(spark, f"file://{tmp_path}/t") for _ in range(2))
    outcome = []

    def meanwhile(old, new):
        outcome.append(b.save(spark.range(2).toDF("id")))
        return None

    assert a.save(spark.range(1).toDF("id"), meanwhile) == "lost" and outcome == ["saved"] and a.read().count() == 2
    assert len(json.loads(json.dumps(a.manifest()))["folder"]) > 10


def test_rows_that_change_under_the_write_are_noticed(spark, tmp_path):
    table = versions.Versions(spark, f"file://{tmp_path}/t")
    table._write = lambda df, folder: versions.Versions._write(table, df, folder) | {"rows": 4}
    assert table.save(spark.range(5).toDF("id")).startswith("failed: ") and table.read() is None
