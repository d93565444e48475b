"""The pipeline's stages on a small table, each against the rule that it stands for."""

import corpus_pipeline
from test_operators import grams, stats


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas())
        if name != "sharding":
            assert docs.columns == columns, name
    kept = seen["near-duplicates"].collect()
    assert all(stats(r["text"])[0] >= 10 for r in kept)
    unique = {r["doc_id"]: grams(r["text"]) for r in seen["decontamination"].collect()}
    ids = list(unique)
    assert not any(100 * len(unique[a] & unique[b]) >= 75 * len(unique[a] | unique[b]) for i, a in enumerate(ids) for b in ids[:i])
    items = [grams(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in seen["mixing"].collect()}
    assert clean == {i for i, g in unique.items() if not any(x and len(x & g) >= 0.75 * len(x) for x in items)}
    mixed = seen["sharding"].count()
    counts = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert docs.count() == mixed and max(counts) - min(counts) <= 1


def test_run_is_registered():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and [k for k, _ in corpus_pipeline.STAGES][0] == "quality rules"


def test_rest_works_without_these_folders(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "quire", tmp_path / "quire", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op') and k[2].isdigit() for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
