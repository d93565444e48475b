"""Expectations on literal rows that come from reading the reference's tests, not from SQL."""

from quire.operators import audit
from quire.plans import field_queries, match_queries, text_queries, tree_queries
from quire.plans.audit_queries import corpus


def _by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_faulty_document_report(spark):
    rows = audit.report(audit.audit(corpus(spark))).filter("doc_id = 1").orderBy("n_in_report").collect()
    assert [r["rule"].split(" ")[0] for r in rows] == ["R2", "R4", "R3", "R5", "R6", "R9", "R8", "R10"]
    assert [r["severity"] for r in rows] == [0, 1, 1, 1, 2, 2, 2, 3]


def test_a_broken_rule_can_be_left_out(spark):
    rules = {k: f for k, f in audit.RULES.items() if not k.startswith("R11")}
    assert audit.audit(corpus(spark), rules).filter("rule LIKE 'R11%'").count() == 0


def test_labels(spark):
    q = match_queries.queries()
    assert _by(q["j01_nearest_label"](spark, ""), "field_id", "label")[1] == "Reference number"
    assert list(_by(q["j04_option_label"](spark, ""), "option_id", "label").values())[:3] == ["By email", "By phone", "By post"]


def test_names(spark):
    got = _by(text_queries.queries()["t08_humanise_name"](spark, ""), "id", "y")
    assert got[0].lower() == got[1] == "applicant full name" and "NHS" in got[2]


def test_values(spark):
    got = {r["id"]: r for r in field_queries.queries()["v02_text_apply"](spark, "").collect()}
    assert got[0]["value"] == "03/04/2026" and not got[1]["accepted"] and not got[2]["accepted"] and got[3]["accepted"] and got[4]["accepted"] and got[5]["accepted"]
    choice = _by(field_queries.queries()["v13_choice_match"](spark, ""), "id", "export")
    assert choice[0] == "NL" and choice[1] is None


def test_tables(spark):
    got = {r["doc_id"]: r for r in match_queries.queries()["td_detected_tables"](spark, "").collect()}
    assert set(got) == {1, 2, 8}
    assert (got[1]["n_rows"], got[1]["n_columns"], got[1]["header_row"], got[1]["header_column"]) == (4, 3, True, True)
    assert got[2]["header_row"] and not got[2]["header_column"] and got[8]["n_rows"] == 4


def test_cell_is_spoken_with_its_headers(spark):
    rows = match_queries.queries()["j08_j09_cell_headers"](spark, "").collect()
    assert "March, Revenue, 4200" in {r["spoken"] for r in rows}


def test_reading_order_is_partition_independent(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    a = sorted(map(tuple, tree_queries.queries()["o02_reading_order"](spark, "").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    b = sorted(map(tuple, tree_queries.queries()["o02_reading_order"](spark, "").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == b
