"""Increments as a stream: each micro-batch of exported messages is merged into a versioned baseline, once.

The baseline is a table of messages with the batch that brought them, -1 for what it began with. A batch is held
against what the batches before it left, never against its own rows, and overwrites its own part only: a batch that is
replayed after a failure finds what it found before and leaves what it left before. What follows from the messages
(routes, coverage, the ledger, checks, questions) is derived from a version of them, so that any version can be rebuilt.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from talkframe.functions import lexicon as L
from talkframe.operators import changes as C
from talkframe.operators import evidence as V
from talkframe.operators import exchanges as E
from talkframe.operators import messages as M
from talkframe.operators import review as R

_MESSAGES = T.StructType([*M.SCHEMA.fields, T.StructField("batch", T.LongType())])
_CONFLICTS = "conv_id string, memory_id long, message long, quote string, batch long"


def _part(folder: str, name: str, batch: int | None = None) -> str:
    return f"{folder.rstrip('/')}/{name}" + ("" if batch is None else f"/batch={batch}")


def begin(m: DataFrame, folder: str, facts: DataFrame | None = None) -> None:
    """A baseline of messages, and of memories (conv_id, memory_id, status, quote) that later messages may contradict.

    One that is there already is never overwritten.
    """
    spark = m.sparkSession
    m.select(M.SCHEMA.names).write.mode("errorifexists").parquet(_part(folder, "messages", -1))
    facts = spark.createDataFrame([], "conv_id string, memory_id long, status string, quote string") if facts is None else facts
    facts.select("conv_id", F.col("memory_id").cast("long").alias("memory_id"), "status", "quote").write.mode("errorifexists").parquet(_part(folder, "facts"))
    spark.createDataFrame([], _CONFLICTS).drop("batch").write.mode("errorifexists").parquet(_part(folder, "conflicts", -1))


def messages_of(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """Messages with the batch that brought them, up to and with a batch."""
    rows = spark.read.schema(_MESSAGES).parquet(_part(folder, "messages"))
    return rows if version is None else rows.where(F.col("batch") <= version)


def conflicts_of(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    rows = spark.read.schema(_CONFLICTS).parquet(_part(folder, "conflicts"))
    return rows if version is None else rows.where(F.col("batch") <= version)


def merge_batch(incoming: DataFrame, batch: int, folder: str, marks: Sequence[str] = L.CONFLICT_MARKS, stop: Sequence[str] = L.CONFLICT_STOP_GRAMS, cjk: bool = True) -> None:
    """Add to the baseline what a batch has beyond the versions before it, numbered on, and the conflicts that it raises."""
    spark = incoming.sparkSession
    known = messages_of(spark, folder, batch - 1)
    added = C.additions(known.drop("batch"), incoming.select(M.SCHEMA.names))
    last = known.join(incoming.select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id").agg(F.max("seq").alias("last"))
    numbered = added.join(last, "conv_id", "left").withColumn("seq", F.coalesce("last", F.lit(0)) + F.col("message"))
    numbered.select(M.SCHEMA.names).write.mode("overwrite").parquet(_part(folder, "messages", batch))
    mine = spark.read.schema(M.SCHEMA).parquet(_part(folder, "messages", batch)).withColumn("message", F.col("seq"))
    facts = spark.read.parquet(_part(folder, "facts"))
    C.conflicts(mine, facts, marks, stop, cjk).write.mode("overwrite").parquet(_part(folder, "conflicts", batch))


def merging(stream: DataFrame, folder: str, once: bool = True, **rules) -> StreamingQuery:
    """Start merging a stream of messages into the baseline of a folder; `once`: of what there is now."""
    writer = stream.writeStream.foreachBatch(lambda rows, batch: merge_batch(rows, batch, folder, **rules)).option("checkpointLocation", _part(folder, "checkpoint"))
    return (writer.trigger(availableNow=True) if once else writer).start()


@dataclass
class Rebuilt:
    """What follows from a version: messages, items that pass the strict check, routes, coverage, ledger, specificity, questions."""

    messages: DataFrame
    items: DataFrame
    routes: DataFrame
    coverage: DataFrame
    ledger: DataFrame
    specificity: DataFrame
    questions: DataFrame


def doubted(ledger: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The ledger; memories with a conflict are uncertain until someone confirms them."""
    marked = ledger.join(conflicts.select("conv_id", F.col("memory_id").alias("item_id")).distinct().withColumn("doubt", F.lit(True)), ["conv_id", "item_id"], "left")
    now = {"status": "uncertain", "validity": "needs_confirmation", "confidence": "uncertain"}
    return marked.withColumns({c: F.when(F.col("doubt"), v).otherwise(F.col(c)) for c, v in now.items()}).drop("doubt")


def rebuilt(
    spark: SparkSession, folder: str, sides: DataFrame, items: DataFrame, memories: DataFrame, analyse: Callable[[DataFrame], DataFrame],
    version: int | None = None, situations: Sequence[tuple[str, str, str, str]] = L.SITUATIONS, most_lines: int = 3, most_chars: int = 80,
) -> Rebuilt:
    """Everything anew from the messages of a version.

    items and what `analyse` finds in the additions: conv_id, item_id, section, text; of the latter those stay whose
    quotes all stand in the additions. memories: conv_id, item_id, section, text, claim. sides: conv_id, target,
    counterpart. Each step is a table of the folder, which the next ones read, for each version its own.
    """
    at = _part(folder, f"derived/{'last' if version is None else version}/")

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(at + name)
        return spark.read.schema(rows.schema).parquet(at + name)

    m = messages_of(spark, folder, version)
    added = m.where("batch >= 0").drop("batch")
    m = m.drop("batch")
    found = kept(analyse(added).select("conv_id", "item_id", "section", "text"), "found")
    findings = kept(R.evidence_checks(found, added), "findings")
    repeats = items.select("conv_id", "section", "text").distinct()
    both = items.select("conv_id", "item_id", "section", "text").unionByName(R.applied(found, findings, strict=True).join(repeats, ["conv_id", "section", "text"], "left_anti"))
    both = kept(both, "items")
    pairs = kept(E.classified(E.exchanges(m, sides, most_lines, most_chars), situations), "pairs")
    routes = kept(E.scenarios(pairs, situations=situations), "routes")
    covered = kept(E.coverage(pairs, routes, m, sides, situations), "coverage")
    conflicts = conflicts_of(spark, folder, version)
    ledger = kept(doubted(V.ledger(memories, m), conflicts), "ledger")
    scores = kept(V.specificity(V.claims_of(both).select("conv_id", "item_id", "text", "claim"), m, sides.select("conv_id", "target")), "specificity")
    asked = R.questions(scores, covered, ledger)
    said = conflicts.select("conv_id", F.concat(F.lit("conflict-"), F.col("memory_id").cast("string"), F.lit("-"), F.col("message").cast("string")).alias("id"), F.lit("conflict").alias("type"), F.lit("high").alias("priority"))
    return Rebuilt(m, both, routes, covered, ledger, scores, asked.unionByName(said))
