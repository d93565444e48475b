"""Small literal tables that exist alike in Spark and in SQL, and the registry of queries."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
TYPES = {"string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "long": "BIGINT", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


def sql_literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int | float):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


#: Frames that stand in for fixtures while a query over tables is put together.
_stand_ins: dict[int, DataFrame] = {}


@dataclass(frozen=True)
class Source:
    """Rows of given tables for both engines: SQL that both know over tables of TABLES, or a frame of its own with its SQL."""

    sql: str
    frame: Callable[[SparkSession, str], DataFrame] | None = None

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        if self.frame is not None:
            return self.frame(spark, sf_dir)
        text, names = self.sql, [n for n in TABLES if re.search(rf"\b(FROM|JOIN) {n}\b", self.sql)]
        for n in names:  # in braces, so that Spark takes the frames for them
            text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
        return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


@dataclass(frozen=True)
class Fixture:
    """``columns`` as 'name type, ...' with the types of TYPES."""

    name: str
    columns: str
    rows: tuple[tuple, ...]

    def fields(self) -> list[tuple[str, str]]:
        return [tuple(x.split()) for x in self.columns.split(",")]

    def df(self, spark: SparkSession) -> DataFrame:
        if id(self) in _stand_ins:
            return _stand_ins[id(self)]
        text = ", ".join(f"{n} {'string' if t == 'timestamp' else t}" for n, t in self.fields())
        out = spark.createDataFrame(list(self.rows), text)
        for n, t in self.fields():
            if t == "timestamp":
                out = out.withColumn(n, out[n].cast("timestamp"))
        return out

    def sql(self) -> str:
        names = ", ".join(f"c{i}" for i in range(len(self.fields())))
        casts = ", ".join(f"CAST(c{i} AS {TYPES[t]}) AS {n}" for i, (n, t) in enumerate(self.fields()))
        rows = ", ".join("(" + ", ".join(map(sql_literal, r)) + ")" for r in self.rows)
        return f"(SELECT {casts} FROM (VALUES {rows}) AS v({names}))"

    def cte(self) -> str:
        return f"{self.name} AS {self.sql()}"


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}
        self.scalars: dict[str, tuple[Fixture, dict, str]] = {}

    def add(self, name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")
        self.queries[name] = query
        if sql:
            self.sql[name] = sql

    def instead(self, name: str, of: tuple[Registry, str], sources: dict[int, tuple[Fixture, Source]]) -> None:
        """A query of another registry over rows of given tables in place of its fixtures, in both engines."""
        registry, query = of

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for key, (fixture, source) in sources.items():
                df = source.df(spark, sf_dir)
                _stand_ins[key] = df.select(*(df[n].cast({"long": "bigint"}.get(t, t)).alias(n) for n, t in fixture.fields()))
            try:
                return registry.queries[query](spark, sf_dir)
            finally:
                for key in sources:
                    del _stand_ins[key]

        sql = registry.sql[query]
        for fixture, source in sources.values():
            casts = ", ".join(f"CAST({n} AS {TYPES[t]}) AS {n}" for n, t in fixture.fields())
            sql = sql.replace(fixture.sql(), f"(SELECT {casts} FROM ({source.sql}))")
        self.add(name, run, sql)

    def over(self, name: str, scalars: Registry, of: str, source: str) -> None:
        """The query ``of`` of column functions over rows of given tables instead of its fixture. source: SQL of both engines for a table with the fixture's columns, ``id`` among them, over tables of TABLES."""
        fixture, outputs, _ = scalars.scalars[of]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = Source(source).df(spark, sf_dir)
            types = {n: {"long": "bigint"}.get(t, t) for n, t in fixture.fields() if n != "id"}
            df = df.select("id", *(df[n].cast(t).alias(n) for n, t in types.items()))
            return df.select("id", *((c() if callable(c) else c).alias(n) for n, (c, _) in outputs.items()))

        casts = ", ".join(f"CAST({n} AS {TYPES[t]}) AS {n}" for n, t in fixture.fields() if n != "id")
        exprs = ", ".join(f"{e} AS {n}" for n, (_, e) in outputs.items())
        self.add(name, run, f"SELECT id, {exprs} FROM (SELECT id, {casts} FROM ({source}))")

    def scalar(self, name: str, fixture: Fixture, outputs: dict[str, tuple[Column | Callable[[], Column], str]], keys: str = "id") -> None:
        """A query of column functions over a fixture: per output the Spark column and the SQL expression."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fixture.df(spark).select(*keys.split(","), *((c() if callable(c) else c).alias(n) for n, (c, _) in outputs.items()))

        self.scalars[name] = (fixture, outputs, keys)
        exprs = ", ".join(f"{e} AS {n}" for n, (_, e) in outputs.items())
        self.add(name, run, f"SELECT {keys}, {exprs} FROM {fixture.sql()}")
