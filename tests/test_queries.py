"""Every query of the reference's operators against its DuckDB SQL."""

import pytest
from compare import duck_rows, spark_rows

from quire.plans import audit_queries, change_queries, edit_queries, field_queries, file_queries, layout_queries, match_queries, page_queries, render_queries, structure_queries, table_queries, text_queries, tree_queries

MODULES = [audit_queries, change_queries, edit_queries, field_queries, file_queries, layout_queries, match_queries, page_queries, render_queries, structure_queries, table_queries, text_queries, tree_queries]
ALL = [(m, n) for m in MODULES for n in m.queries()]


@pytest.mark.parametrize("module,name", ALL, ids=[n for _, n in ALL])
def test_query(spark, duck, sf_dir, module, name):
    cols, got = spark_rows(module.queries()[name](spark, sf_dir))
    assert got, "nothing is compared with nothing"
    if name in module.oracle_sql():
        assert (cols, got) == duck_rows(duck, module.oracle_sql()[name])
    else:
        assert cols and got


def test_names_are_unique():
    names = [n for _, n in ALL]
    assert len(names) == len(set(names))


def test_every_operator_has_a_query():
    """Operators of the survey that stand for queries; those of devices and binary files are out of scope."""
    have = set("_".join(n for _, n in ALL).split("_"))
    want = [f"{p}{i:02d}" for p, n in (("t", 37), ("v", 22), ("j", 15), ("c", 24), ("r", 12), ("a", 12), ("o", 5), ("w", 5), ("f", 9), ("q", 6), ("n", 8), ("e", 9), ("x", 4), ("h", 12), ("g", 9), ("tr", 7)) for i in range(1, n + 1)]
    also = {"w02", "w03", "o04"}  # lag in r08, islands in c11, first and last in n01
    assert [w for w in want if w not in have and w not in also] == []
