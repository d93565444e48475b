"""Queries of edit commands and their history: events as the edits of customers' pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import edits as E
from quire.sources import adapters as A
from quire.sources import markup as M

from .fixture import Registry

R = Registry()


def edited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of the pages of customers who have events."""
    users = A.read(spark, sf_dir, "events", "user_id").distinct().withColumnRenamed("user_id", "page_id")
    return M.page_tree(A.customer_pages(spark, sf_dir).join(users, "page_id", "left_semi"))


def command_log(spark: SparkSession, sf_dir: str, tree: DataFrame) -> DataFrame:
    """Events as steps on the user's page: three in five make a command that suits the element picked (now and then one that doesn't), the others revert or apply again one of those made so far."""
    e = A.read(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.col("event_id")
    makes = n % 5 < 3
    e = e.select(F.col("user_id").alias("doc_id"), n, "value", F.row_number().over(order).alias("seq"), F.count_if(makes).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("made"))
    by_kind: dict[str, list[str]] = {}
    for command, kinds in E.COMMANDS.items():
        for k in kinds or ("Document", "Title"):
            by_kind.setdefault(k, []).append(command)
    suits = F.create_map(*(x for k, names in by_kind.items() for x in (F.lit(k), F.array(*map(F.lit, names)))))
    of_page = Window.partitionBy("doc_id")
    elements = tree.filter(~F.col("kind").isin("Run", "Option", "Label")).select("doc_id", "element_id", "kind", (F.row_number().over(of_page.orderBy("element_id")) - 1).alias("place"), F.count("*").over(of_page).alias("of"))
    e = e.join(elements.groupBy("doc_id").agg(F.max("of").alias("of")), "doc_id").withColumn("place", (n % F.col("of")).cast("int")).join(elements.drop("of"), ["doc_id", "place"])
    own = F.try_element_at(suits, F.col("kind"))
    notes = F.array(*map(F.lit, ("ReplyAnnotation", "EditAnnotation", "DeleteAnnotation")))
    pick = (F.floor(n / 7) % F.greatest(F.lit(1), F.col("made") - 1) + 1).cast("int")
    on_note, odd = n % 4 == 0, n % 11 == 0
    kind = F.when(on_note, F.get(notes, (n % 3).cast("int"))).when(odd, "HeadingLevel").otherwise(F.coalesce(F.get(own, (F.floor(n / 3) % F.greatest(F.lit(1), F.size(own))).cast("int")), F.lit("Sign")))
    target = F.when(on_note, -pick).otherwise(F.col("element_id")).cast("string")
    amount = F.format_string("%.2f", F.col("value"))
    value = (
        F.when(kind.isin("HeadingLevel", "Move"), (n % 8).cast("string")).when(kind == "CellRole", F.get(F.array(*map(F.lit, (*E.ROLES, "Footer"))), (n % 5).cast("int"))).when(n % 9 == 0, "  ").otherwise(F.concat(F.lit(" edit "), amount))
    )
    action = F.when(makes, "make").when(n % 5 == 3, "revert").otherwise("apply")
    return e.select("doc_id", "seq", action.alias("action"), F.when(makes, F.col("made")).otherwise(F.greatest(F.lit(1), pick)).alias("number"), F.when(makes, kind).alias("kind"), F.when(makes, target).alias("target"), F.when(makes, value).alias("value"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = edited_pages(spark, sf_dir)
    return E.commands_of(E.model_of(t), command_log(spark, sf_dir, t))


#: The state is a machine over what was there before; tests take logs back step by step and hold streams against batches.
R.add("e01_e02_commands_of_events", commands)


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = A.edit_events(spark, sf_dir)
    n = F.col("target") % 7
    return E.history(log.select("doc_id", "seq", F.when(n < 3, F.col("op")).when(n < 6, "undo").otherwise("redo").alias("op")))


R.add("e04_history_of_events", histories, """WITH RECURSIVE l AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE WHEN event_id % 7 < 3 THEN 'do' WHEN event_id % 7 < 6 THEN 'undo' ELSE 'redo' END AS op FROM events),
h AS (SELECT DISTINCT doc_id, 0::BIGINT AS seq, []::INTEGER[] AS done, []::INTEGER[] AS undone, 0 AS made, NULL::INTEGER AS entry, NULL::INTEGER AS below, FALSE AS refused FROM l
UNION ALL SELECT l.doc_id, l.seq, CASE WHEN op = 'do' THEN list_append(done, made + 1) WHEN op = 'undo' THEN done[1:len(done) - 1] WHEN len(undone) > 0 THEN list_append(done, undone[-1]) ELSE done END, CASE WHEN op = 'do' THEN []::INTEGER[] WHEN op = 'undo' THEN CASE WHEN len(done) > 0 THEN list_append(undone, done[-1]) ELSE undone END ELSE undone[1:len(undone) - 1] END,
CASE WHEN op = 'do' THEN made + 1 ELSE made END, CASE WHEN op = 'do' THEN made + 1 WHEN op = 'undo' THEN done[-1] ELSE undone[-1] END, CASE WHEN op = 'do' THEN coalesce(done[-1], 0) WHEN op = 'undo' AND len(done) > 0 THEN coalesce(done[-2], 0) WHEN op = 'redo' AND len(undone) > 0 THEN coalesce(done[-1], 0) END, (op = 'undo' AND len(done) = 0) OR (op = 'redo' AND len(undone) = 0)
FROM h JOIN l ON l.doc_id = h.doc_id AND l.seq = h.seq + 1) SELECT doc_id, seq, entry, below, coalesce(done[-1], 0) AS top, refused FROM h WHERE seq > 0""")  # fmt: skip


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict:
    return R.sql
