"""Sources that never fail as a whole: what can't be read becomes a row of errors."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable pages, and page_id with an error for the others; one bad page doesn't stop the rest."""
    problem = F.when(F.col("html").isNull(), "missing").when(F.trim("html") == "", "empty").when(~F.contains(F.lower("html"), F.lit("<html")), "not html")
    p = pages.withColumn("error", problem)
    return p.filter("error IS NULL").drop("error"), p.filter("error IS NOT NULL").select("page_id", "error")


def load_tables(spark: SparkSession, paths: dict[str, str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Tables that can be opened, and why the others can't."""
    good, bad = {}, {}
    for name, path in paths.items():
        try:
            good[name] = spark.read.parquet(path)
        except Exception as error:  # any reader's failure is a result here
            bad[name] = type(error).__name__ if str(error) else "unreadable"
    return good, bad


def first_existing(arguments: list[str]) -> str | None:
    """The first argument that names a file; blanks, folders and what can't be a path are passed over."""
    for raw in arguments:
        name = raw.strip().strip('"').strip()
        try:
            if name and Path(name).is_file():
                return name
        except (OSError, ValueError):
            continue
    return None


@dataclass
class Settings:
    """What a reader may set."""

    verbosity: str = "Normal"
    reading_mode: str = "Structured"
    speech_rate: float = 1.0
    recent_files: list[str] = field(default_factory=list)

    def opened(self, name: str, most: int = 10) -> None:
        """The file comes first; ten are kept."""
        self.recent_files = [name, *(f for f in self.recent_files if f.lower() != name.lower())][:most]

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    @classmethod
    def load(cls, path: str) -> Settings:
        """Any failure gives the defaults."""
        try:
            raw = json.loads(Path(path).read_text())
            known = {f.name for f in fields(cls)}
            return cls(**{k: v for k, v in raw.items() if k in known})
        except (OSError, ValueError, TypeError, AttributeError):
            return cls()
