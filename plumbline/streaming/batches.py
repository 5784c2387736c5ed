"""Bounded streams: records arrive as micro-batches, counts are kept, knowledge is frozen and applied to the stream.

Sources are file streams read with trigger(availableNow), which end when what is there has been read.  State is a table of
counts that each batch appends to, so a restarted batch replaces its own part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, tasks

MIN_GROUP, MIN_GROUPS, CONFIDENCE = 2, 2, 0.95


def counted(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Runs the stream of (d, v) to its end; each batch writes its counts under its own number."""

    def fold(batch: DataFrame, number: int) -> None:
        batch.where("d is not null and v is not null").groupBy("d", "v").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def modes(counts: DataFrame) -> DataFrame:
    """(d, mode, n): the most frequent target of each determinant, the largest text among equals; empty unless enough groups
    agree well enough."""
    total = counts.groupBy("d", "v").agg(F.sum("n").alias("n"))
    top = total.groupBy("d").agg(F.max_by("v", F.struct("n", "v")).alias("mode"), F.max("n").alias("mode_n"), F.sum("n").alias("n"))
    good = F.col("n") >= MIN_GROUP
    gate = top.agg((F.count(F.when(good, 1)) >= MIN_GROUPS).alias("enough"), (F.sum(F.when(good, F.col("mode_n")).otherwise(0)) / F.sum("n") >= CONFIDENCE).alias("sure")).where("enough and sure").select(F.lit(1).alias("one"))
    return top.where(good).join(F.broadcast(gate)).select("d", "mode", "n")


def landed(rows: DataFrame, folder: str, parts: int = 3, source: DataFrame | None = None) -> int:
    """Writes rows as files for a stream of ``parts`` or more batches; the number of files of a batch.  Files, which are read by
    a task each, don't grow with the table, and a batch has as many as there are cores to read them.  source: a table that
    has as many rows or more and is cheaper to count."""
    spark = rows.sparkSession
    files = max(parts, tasks(spark, (rows if source is None else source).count(), rounds=parts))
    rows.repartition(files).write.parquet(folder)
    return max(1, min(spark.sparkContext.defaultParallelism, files // parts))


def functional(rows: DataFrame, spark: SparkSession, parts: int = 3) -> DataFrame:
    """rows: (id, d, v), written as files and streamed in ``parts`` or more batches."""
    folder = shared_folder(spark)
    files = landed(rows, f"{folder}/in", parts)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    counted(stream, f"{folder}/counts", f"{folder}/state")
    return modes(spark.read.parquet(f"{folder}/counts"))


def apply_knowledge(rows: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(id, code, old_value, new_value) of records against frozen knowledge; rows may be a stream."""
    joined = rows.join(knowledge.select("d", "mode"), "d").where("v is null or v <> mode")
    code = F.when(F.col("v").isNull(), "missing_from_functional_relation").otherwise("functional_relation_violation")
    return joined.select("id", code.alias("code"), F.col("v").alias("old_value"), F.col("mode").alias("new_value"))
