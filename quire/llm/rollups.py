"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A store is a folder with a log. A batch writes a ``ledger``, signed counts a document, and new ``totals``: the totals of the state it saw plus the sums of its ledger. It is committed by
an entry in ``log``, numbered one above the last, which names the live ledgers and the totals. The entry is written under another name and renamed, which fails if the number is taken: then another
writer was first, and the batch is made anew from the new state. So an entry is there as a whole or not at all, two deletes of one document can't both take back its counts, and a batch
that is sent again, or whose writer died half-way, changes nothing or is simply run again. A marker in ``batches`` tells that a batch is in; only the last entry's may be missing, and whoever comes next puts it there.

Inserts add counts; deletes take back whatever the ledgers hold for a document; revised counts take back and add. Totals are read, not summed up again. Once there are LEDGERS live ledgers, a
batch merges them into one with the net counts of each document, so what a delete has to read doesn't grow with history.

Nulls: null sources, languages and texts (no tokens) are values like others. Documents with a null doc_id can be inserted but not addressed:
deletes and revised counts leave what they have as it is. Repeated rows count each. Batches without rows commit like others; an empty store has no totals. Extra columns are ignored; texts of any length are counted whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, documents, small_batches, table
from .tokens import Encoder, default_tokenizer, gathered

KEY = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"
#: So many ledgers are read by a delete at most, and so often a commit is tried while other writers come first.
LEDGERS, TRIES = 8, 20
#: Bytes of text that a worker counts together, and pieces that it remembers in each of two generations: that much is held beside a JVM that is not small.
COUNTED_BYTES, REMEMBERED = 1 << 21, 150_000


def counted(docs: DataFrame, path: str, version: str) -> DataFrame:
    """One count a document with the tokenizer at ``path``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path, REMEMBERED)
        for batch in gathered(batches, 3, COUNTED_BYTES):
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(encoder.count(batch.column(3)))], ["doc_id", "source", "lang", "tokens"])

    d = documents(docs, "source", "lang").select("doc_id", "source", "lang", "text")
    d = d.mapInArrow(count, "doc_id long, source string, lang string, tokens long")
    return d.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), "tokens")


def counted_words(docs: DataFrame, version: str = "words") -> DataFrame:
    d = documents(docs, "source", "lang")
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return d.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), n.alias("tokens"))


class TokenRollup:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _write(self, name: str, text: str) -> bool:
        """Puts a file there as a whole; False if there is one of that name."""
        target, mine = self._path(name), self._path(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        stream = self._fs.create(mine, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(mine, target, none)
        except Exception as error:
            self._fs.delete(mine, False)
            if "FileAlreadyExists" not in str(error):
                raise
            return False
        return True

    def _state(self) -> dict:
        """The last log entry: number, batch, ledgers and totals."""
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path("log"))] if self._fs.exists(self._path("log")) else []
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return {"number": 0, "batch": None, "ledgers": [], "totals": None}
        stream = self._fs.open(self._path(f"log/{max(numbers):012d}"))
        state = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        if not self._fs.exists(self._path(f"batches/{state['batch']}")):
            self._write(f"batches/{state['batch']}", str(state["number"]))
        return state

    def commit(self, batch: str, make: Callable[[dict], DataFrame]) -> bool:
        """make(state) gives the batch's ledger for a state: LEDGER columns with signed docs and tokens. False if the batch is committed already."""
        for _ in range(TRIES):
            state = self._state()
            if self._fs.exists(self._path(f"batches/{batch}")):
                return False
            name = f"data/{batch}-{uuid.uuid4().hex}"
            make(state).write.option("compression", "zstd").parquet(f"{self.root}/{name}/ledger")
            own = self._read([f"{name}/ledger"], LEDGER)
            delta = own.select(*KEY, "docs", "tokens").groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            before = self._read([state["totals"]] if state["totals"] else [], TOTALS)
            sums = before.unionByName(delta).groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")
            sums.write.parquet(f"{self.root}/{name}/totals")
            ledgers = [*state["ledgers"], f"{name}/ledger"]
            if len(ledgers) > LEDGERS:
                net = self._read(ledgers, LEDGER).groupBy("doc_id", *KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")
                net.write.option("compression", "zstd").parquet(f"{self.root}/{name}/merged")
                ledgers = [f"{name}/merged"]
            number = state["number"] + 1
            if self._write(f"log/{number:012d}", json.dumps({"number": number, "batch": batch, "ledgers": ledgers, "totals": f"{name}/totals"})):
                self._state()  # the batch's marker
                return True
            self._fs.delete(self._path(name), True)
        raise RuntimeError(f"batch {batch}: other writers came first {TRIES} times")

    def _read(self, names: list[str], schema: str) -> DataFrame:
        paths = [f"{self.root}/{n}" for n in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def insert(self, batch: str, counts: DataFrame) -> bool:
        return self.commit(batch, lambda state: self._signed(counts, 1))

    def delete(self, batch: str, ids: DataFrame) -> bool:
        """Takes back all that the ledgers hold for the documents in ``ids``."""
        return self.commit(batch, lambda state: self._back(state, ids.select("doc_id")))

    def revise(self, batch: str, counts: DataFrame) -> bool:
        """New counts for documents and tokenizers: the old ones are taken back. Those of null doc_ids, whose old ones can't be, are left out."""
        counts = counts.filter("doc_id IS NOT NULL")
        return self.commit(batch, lambda state: self._back(state, counts.select("doc_id", "tokenizer")).unionByName(self._signed(counts, 1)))

    @staticmethod
    def _signed(counts: DataFrame, sign: int) -> DataFrame:
        return counts.select("doc_id", *KEY, F.lit(sign).cast("long").alias("docs"), (sign * F.col("tokens")).cast("long").alias("tokens"))

    def _back(self, state: dict, keys: DataFrame) -> DataFrame:
        mine = self._read(state["ledgers"], LEDGER).join(keys.distinct(), keys.columns, "left_semi")
        net = mine.groupBy("doc_id", *KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")
        return net.select("doc_id", *KEY, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))

    def totals(self) -> DataFrame:
        state = self._state()
        sums = self._read([state["totals"]] if state["totals"] else [], TOTALS)
        return sums.select(*KEY, F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after these batches: all documents under two tokenizer versions, one of them sent twice; toxic ones deleted; the word counts of German documents revised to character counts."""
    small_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    store = TokenRollup(spark, Scratch(spark, "rollup").path("store"))
    store.insert("load-bpe", counted(docs, default_tokenizer(), "byte_bpe_50k"))
    store.insert("load-words", counted_words(docs))
    store.insert("load-words", counted_words(docs))
    store.delete("toxic", labels.filter("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id")))
    german = documents(docs, "source", "lang").filter("lang = 'de'").join(labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    revised = german.select("doc_id", "source", "lang", F.lit("words").alias("tokenizer"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("tokens"))
    store.revise("german", revised)
    return store.totals()
