"""Queries that write the given tables to files and read them again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import versions
from quire.runtime import ship, working_folder
from quire.sources import adapters as A
from quire.sources import files

from .fixture import Registry

R = Registry()


def _put(pages: DataFrame, folder: str) -> DataFrame:
    """Writes each page as a file of two pages below a folder, by its number's remainder: 3 not at all, 4 not as text, 5 as a locked archive, 6 as an archive with a damaged page, 7 as a sound one, 8 with an empty page. Gives page_id and path."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            paths = []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kind, both = page % 10, [html, f"<p>second page of {page}</p>"]
                raw = {4: b"\xff\xfe\x00 no text", 5: files.zipped(both, locked=True), 6: files.damaged(files.zipped(both)), 7: files.zipped(both), 8: "\f".join([html, " "]).encode()}.get(kind, "\f".join(both).encode())
                name = f"page-{page:012d}"
                if kind != 3:
                    fs.create_dir(base, recursive=True)
                    with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                        out.write(raw)
                paths.append(f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths)], ["page_id", "path"])

    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(put, "page_id long, path string")


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read, and what is said of the rest."""
    folder = working_folder(spark, "files")
    _put(A.read(spark, sf_dir, "pages", "page_id", "html"), folder).write.parquet(f"{folder}-paths")
    paths = [r["path"] for r in spark.read.parquet(f"{folder}-paths").select("path").toLocalIterator()]  # a data source is given its paths by the driver
    good, bad = files.load_files(spark, paths)
    number = F.regexp_extract("path", "([0-9]+)$", 1).cast("long").alias("page_id")
    none = lambda kind: F.lit(None).cast(kind)
    return good.select(number, "page_no", F.length("html").alias("size"), none("string").alias("problem")).unionByName(bad.select(number, "page_no", none("int").alias("size"), "problem"))


R.add("s01_s02_files_with_failures", loaded, """WITH p AS (SELECT page_id, html, page_id % 10 AS k, 22 + length(CAST(page_id AS VARCHAR)) AS second FROM pages)
SELECT page_id, NULL::INTEGER AS page_no, NULL::INTEGER AS size, CASE k WHEN 3 THEN 'missing' WHEN 4 THEN 'malformed' ELSE 'locked' END AS problem FROM p WHERE k IN (3, 4, 5)
UNION ALL SELECT page_id, 1, CASE WHEN k <> 6 THEN CAST(length(html) AS INTEGER) END, CASE WHEN k = 6 THEN 'page' END FROM p WHERE k NOT IN (3, 4, 5)
UNION ALL SELECT page_id, 2, CASE WHEN k <> 8 THEN CAST(second AS INTEGER) END, CASE WHEN k = 8 THEN 'page' END FROM p WHERE k NOT IN (3, 4, 5)""")  # fmt: skip


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three saves of the documents, of which the second changes every text and the third would lose rows; then what stands."""
    table = versions.Versions(spark, working_folder(spark, "published"))
    docs = A.read(spark, sf_dir, "documents", "doc_id", "text")
    check = versions.losses("doc_id", "text")
    outcomes = [table.save(docs, check), table.save(docs.withColumn("text", F.concat("text", F.lit("!"))), check), table.save(docs.filter("doc_id % 2 = 0"), check)]
    said = F.lit(", ".join(o.split(":")[0] for o in outcomes))
    return table.read().select("doc_id", F.length("text").alias("size"), F.lit(table.manifest()["number"]).alias("version"), said.alias("outcomes"))


R.add("k03_f05_f07_published_documents", published, "SELECT doc_id, CAST(length(text) + 1 AS INTEGER) AS size, 2 AS version, 'saved, saved, refused' AS outcomes FROM documents")


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict:
    return R.sql
