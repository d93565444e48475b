"""Tables that are replaced as a whole or not at all.

A version is a folder that nothing names yet. While it is written its rows are counted and summed up in the same job, and it is read back and held against these figures and against the caller's check. Then a manifest of the next number is
put in place by a rename that fails where there is one. Readers take the manifest with the highest number. So whatever stops a save, readers find the old version whole or the new one whole, and of two savers at once one is told that it lost.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Versions:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop, self._conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def manifest(self, number: int | None = None) -> dict | None:
        """The manifest of a number, or the last one; null if there is none."""
        if number is None:
            names = [x.getPath().getName() for x in self._fs.listStatus(self._path("manifests"))] if self._fs.exists(self._path("manifests")) else []
            number = max((int(n) for n in names if n.isdigit()), default=0)
        if not number or not self._fs.exists(self._path(f"manifests/{number:012d}")):
            return None
        stream = self._fs.open(self._path(f"manifests/{number:012d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, number: int | None = None) -> DataFrame | None:
        found = self.manifest(number)
        return None if found is None else self.spark.read.schema(T.StructType.fromJson(found["schema"])).parquet(f"{self.root}/{found['folder']}")

    def save(self, df: DataFrame, check: Callable[[DataFrame | None, DataFrame], str | None] = lambda old, new: None, after: int | None = None) -> str:
        """Publishes df as the next version. check(old, new) gives a reason to refuse or nothing. after: the number that the caller has read; a newer one means that the save is lost, and so does another saver that comes first.

        Gives 'saved', 'failed: ...' if what was written isn't what came, 'refused: ...' or 'lost'.
        """
        last = self.manifest()
        number = last["number"] if last else 0
        if after is not None and after != number:
            return "lost"
        folder = f"versions/{uuid.uuid4().hex}"
        seen = self._write(df, folder)
        written = self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}")
        found = written.agg(*figures(written)).first().asDict()
        reason = None if found == seen else f"failed: {seen} were written and {found} are there"
        if reason is None and (why := check(self.read(number) if number else None, written)):
            reason = f"refused: {why}"
        if reason is None and not self._name(number + 1, {"number": number + 1, "folder": folder, "schema": df.schema.jsonValue(), **seen}):
            reason = "lost"
        if reason is not None:
            self._fs.delete(self._path(folder), True)
        return reason or "saved"

    def _write(self, df: DataFrame, folder: str) -> dict:
        """Writes the rows and gives their figures, taken in the write itself."""
        watch = Observation(uuid.uuid4().hex)
        df.observe(watch, *figures(df)).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return dict(watch.get)

    def _name(self, number: int, manifest: dict) -> bool:
        """Puts the manifest in place; False if there is one of its number."""
        self._fs.mkdirs(self._path("manifests"))
        target, mine = self._path(f"manifests/{number:012d}"), self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(mine, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        return self._rename(mine, target)

    def _rename(self, mine, target) -> bool:
        none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._hadoop.FileContext.getFileContext(target.toUri(), self._conf).rename(mine, target, none)
        except Exception as error:
            self._fs.delete(mine, False)
            if "FileAlreadyExists" not in str(error):
                raise
            return False
        return True

    def clean(self, keep: int = 1) -> int:
        """Drops all versions but the last ``keep`` and what stopped saves have left; gives how many folders. Not while a save runs."""
        if not self._fs.exists(self._path("versions")):
            return 0
        last = (self.manifest() or {"number": 0})["number"]
        numbers = range(max(1, last - keep + 1), last + 1)
        named = {m["folder"] for n in numbers if (m := self.manifest(n))}
        gone = [x.getPath() for x in self._fs.listStatus(self._path("versions")) if f"versions/{x.getPath().getName()}" not in named]
        for path in gone:
            self._fs.delete(path, True)
        for x in self._fs.listStatus(self._path("manifests")) if self._fs.exists(self._path("manifests")) else []:
            name = x.getPath().getName()
            if not name.isdigit() or int(name) not in numbers:
                self._fs.delete(x.getPath(), False)
        return len(gone)


def figures(df: DataFrame) -> list:
    """Rows, and a sum over hashes of whole rows (maps and variants, which have none, don't count), whatever their order."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.pmod(F.xxhash64(F.lit(1), *cols), F.lit(1 << 31))), F.lit(0)).alias("sum")]


def losses(key: str, text: str, least: float = 0.95) -> Callable[[DataFrame | None, DataFrame], str | None]:
    """F2 as a check: a version that lacks rows of the one before, or more than 1 - least of its text, is refused."""

    def check(old: DataFrame | None, new: DataFrame) -> str | None:
        if old is None:
            return None
        size = lambda df: df.agg(F.count_distinct(key).alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("t")).first()
        a, b = size(old), size(new)
        gone = old.join(new, key, "left_anti").count()
        return f"{gone} rows would be lost" if gone else f"text would shrink from {a['t']} to {b['t']} characters" if b["t"] < least * a["t"] else None

    return check
