"""Repair of bounded streams: summaries of micro-batches, knowledge from them, and the loop to a quiet end.

A stream is a folder of files with a schema, read with trigger(availableNow), a number of files a batch.  No batch is held
back: what a batch adds is a small table of sums under the batch's number, so a batch that runs again after a failure
replaces what it wrote before.  Sums of many batches are folded into one table now and then.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import arithmetic as ar
from ..operators import dependencies as dep
from ..operators import repair as rp
from ..operators.repair import CELL
from ..sources import publish
from ..sources.shared import shared_folder

MIN_GROUP, MIN_GROUPS, CONFIDENCE = 2, 2, 0.95
ENUM_SHARE, REQUIRED, MIN_ROWS = 0.75, 0.95, 4
#: Batches whose sums are folded into one table; most cycles, and quiet ones that end the loop.
FOLD, CYCLES, QUIET = 64, 6, 2


@dataclass
class Summary:
    """make: from a batch to rows of keys and numbers to add up."""

    make: Callable[[DataFrame], DataFrame]
    numbers: list[str] = field(default_factory=lambda: ["n"])


def open_stream(spark: SparkSession, folder: str, schema: StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def summarise(stream: DataFrame, summaries: dict[str, Summary], work: str) -> dict[str, DataFrame]:
    """Runs a stream to its end; each summary's sums over all batches."""
    spark = stream.sparkSession

    def added(name: str) -> DataFrame:
        got = spark.read.parquet(f"{work}/{name}/parts").drop("batch")
        keys = [c for c in got.columns if c not in summaries[name].numbers]
        return got.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in summaries[name].numbers))

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, s in summaries.items():
            s.make(batch).write.mode("overwrite").parquet(f"{work}/{name}/parts/batch={number}")
        batch.unpersist()
        if number and number % FOLD == 0:  # the parts before this batch as one, under the number of the first
            for name in summaries:
                jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
                parts = jvm.org.apache.hadoop.fs.Path(f"{work}/{name}/parts")
                fs = parts.getFileSystem(conf)
                old = [s.getPath() for s in fs.listStatus(parts)]
                added(name).write.mode("overwrite").parquet(f"{work}/{name}/folded")
                for path in old:
                    fs.delete(path, True)
                fs.rename(jvm.org.apache.hadoop.fs.Path(f"{work}/{name}/folded"), jvm.org.apache.hadoop.fs.Path(f"{work}/{name}/parts/batch={number}"))

    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start().awaitTermination()
    return {name: added(name) for name in summaries}


# Summaries, and what they say when a stream is over.


def functional_counts(key: str, pairs: list[tuple[str, str]]) -> Summary:
    return Summary(lambda b: dep.long_pairs(b, pairs, key).where("d is not null and v is not null").groupBy("det", "target", "d", "v").agg(F.count(F.lit(1)).alias("n")))


def functional(counts: DataFrame) -> DataFrame:
    """(det, target, d, mode, n): the greatest of a determinant's most frequent targets, for dependencies that hold nearly
    always and have two good groups or more, so that a constant determinant is none."""
    top = counts.groupBy("det", "target", "d").agg(F.max_by("v", F.struct("n", "v")).alias("mode"), F.max("n").alias("mode_n"), F.sum("n").alias("n"))
    good = F.col("n") >= MIN_GROUP
    sure = top.groupBy("det", "target").agg(F.count(F.when(good, 1)).alias("groups"), (F.sum(F.when(good, F.col("mode_n")).otherwise(0)) / F.sum("n")).alias("share")).where(f"groups >= {MIN_GROUPS} and share >= {CONFIDENCE}")
    return top.where(good).join(F.broadcast(sure.select("det", "target")), ["det", "target"]).select("det", "target", "d", "mode", "n")


def arithmetic_counts(fields: list[str]) -> Summary:
    def make(b: DataFrame) -> DataFrame:
        rules = ar.formulas(fields)
        aggs = [x for i, r in enumerate(rules) for x in (F.count(F.when(ar.holds(b, *r), 1)).alias(f"s{i}"), F.count(ar.holds(b, *r)).alias(f"d{i}"))]
        items = F.array(*(F.struct(F.lit(t).alias("target"), F.lit(a).alias("a"), F.lit(op).alias("op"), F.lit(c).alias("b"), F.col(f"s{i}").alias("support"), F.col(f"d{i}").alias("decided")) for i, (t, a, op, c) in enumerate(rules)))
        return b.agg(*aggs).select(F.explode(items).alias("f")).select("f.*")

    return Summary(make, ["support", "decided"])


def arithmetic(counts: DataFrame) -> DataFrame:
    return counts.where(f"decided >= {MIN_ROWS} and support / decided >= {CONFIDENCE}")


def aggregate_counts(target: str, items: str, value: str | None) -> Summary:
    """Whether a record's number is the sum of its items' values, or with no value named their number."""
    made = (lambda: F.aggregate(F.transform(items, lambda x: x[value].cast("decimal(37,9)")), F.lit(0).cast("decimal(38,9)"), lambda a, x: (a.cast("decimal(37,9)") + x).cast("decimal(38,9)"))) if value else (lambda: F.size(items).cast("decimal(38,9)"))
    kind = "aggregate_sum" if value else "aggregate_count"
    return Summary(lambda b: b.select((F.col(target).cast("decimal(38,9)") == made()).alias("ok")).agg(F.lit(kind).alias("kind"), F.lit(target).alias("output"), F.count(F.when(F.col("ok"), 1)).alias("support"), F.count("ok").alias("decided")), ["support", "decided"])


def value_counts(fields: list[str]) -> Summary:
    item = lambda c: F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
    return Summary(lambda b: b.select(F.explode(F.array(*map(item, fields))).alias("p")).select("p.*").where("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")))


def spellings(counts: DataFrame) -> DataFrame:
    """(field, value, canonical): spellings of one word of which one dominates."""
    group = counts.groupBy("field", F.upper("value").alias("f")).agg(F.count(F.lit(1)).alias("k"), F.max_by("value", F.struct("n", "value")).alias("canonical"), (F.max("n") / F.sum("n")).alias("share")).where(f"k > 1 and share >= {ENUM_SHARE}")
    return counts.withColumn("f", F.upper("value")).join(group, ["field", "f"]).where("value <> canonical").select("field", "value", "canonical")


def leaf_counts(regime: str, raw: str) -> Summary:
    """Which leaves the records of a regime have; the row without a leaf counts the records."""
    from ..sources import leaves

    def make(b: DataFrame) -> DataFrame:
        paths = F.transform(leaves(F.col(raw)), lambda x: x["path"])
        rows = b.select(F.col(regime).cast("string").alias("regime"), F.explode(F.concat(F.array(F.lit("")), F.coalesce(F.array_distinct(paths), F.array().cast("array<string>")))).alias("path"))
        return rows.groupBy("regime", "path").agg(F.count(F.lit(1)).alias("n"))

    return Summary(make)


def required_leaves(counts: DataFrame) -> DataFrame:
    """(path): leaves that nearly all records of every regime have."""
    total = counts.where("path = ''").select("regime", F.col("n").alias("rows"))
    regimes = total.agg(F.count(F.lit(1)).alias("regimes"))
    have = counts.where("path <> ''").join(total, "regime").where(f"n >= {REQUIRED} * rows").groupBy("path").agg(F.count(F.lit(1)).alias("k"))
    return have.join(F.broadcast(regimes)).where("k = regimes").select("path")


def regimes(counts: DataFrame) -> DataFrame:
    """(regime, records, leaves): modal_regime of a stream, with the leaves that nearly all its records have."""
    total = counts.where("path = ''").select("regime", F.col("n").alias("records"))
    have = counts.where("path <> ''").join(total, "regime").where(f"n >= {REQUIRED} * records")
    return have.groupBy("regime", "records").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("leaves"))


def fold_counts(key: str, pairs: list[tuple[str, str]]) -> Summary:
    return Summary(lambda b: dep.long_pairs(b, pairs, key).where("d is not null and v is not null").groupBy("det", "target", F.pmod("row_id", F.lit(2)).alias("fold"), "d", "v").agg(F.count(F.lit(1)).alias("n")))


def falsified(counts: DataFrame) -> DataFrame:
    """(det, target, status) from counts by parity of the row.  Folds whose clear modes differ refute; a target with one value
    needs no determinant; else the dependency stands against its baseline, the share of the commonest target."""
    by = counts.groupBy("det", "target", "fold", "d").agg(F.max_by("v", F.struct("n", "v")).alias("mode"), F.sum("n").alias("n"))
    folds = by.where("n >= 2").groupBy("det", "target", "d").agg(F.count_distinct("mode").alias("modes")).groupBy("det", "target").agg(F.count(F.when(F.col("modes") > 1, 1)).alias("against"))
    whole = counts.groupBy("det", "target", "d", "v").agg(F.sum("n").alias("n"))
    fit = whole.groupBy("det", "target", "d").agg(F.max("n").alias("top"), F.sum("n").alias("n")).groupBy("det", "target").agg((F.sum("top") / F.sum("n")).alias("fit"))
    plain = whole.groupBy("det", "target", "v").agg(F.sum("n").alias("n")).groupBy("det", "target").agg((F.max("n") / F.sum("n")).alias("base"), F.count(F.lit(1)).alias("values"))
    status = F.when(F.col("against") > 0, "ACTIVE_REFUTED").when(F.col("values") <= 1, "NEGATIVE_CONTROL_INVARIANT").when(F.col("fit") > F.col("base"), "ADVERSARIAL_SURVIVED").otherwise("OBSERVED_STABLE")
    return fit.join(plain, ["det", "target"]).join(folds, ["det", "target"], "left").select("det", "target", status.alias("status"))


def discover(spark: SparkSession, folder: str, schema: StructType, key: str, pairs: list[tuple[str, str]], numbers: list[str], words: list[str], work: str, files: int = 1) -> DataFrame:
    """(kind, inputs, output, support): all relations that one pass over a stream finds."""
    asked = {"functional": functional_counts(key, pairs), "arithmetic": arithmetic_counts(numbers), "values": value_counts(words)}
    got = summarise(open_stream(spark, folder, schema, files), asked, work)
    a = functional(got["functional"]).groupBy("det", "target").agg(F.sum("n").alias("support")).select(F.lit("functional_stream").alias("kind"), F.col("det").alias("inputs"), F.col("target").alias("output"), "support")
    b = arithmetic(got["arithmetic"]).select(F.lit("exact_arithmetic_stream").alias("kind"), F.concat_ws(" ", "a", "op", "b").alias("inputs"), F.col("target").alias("output"), "support")
    c = spellings(got["values"]).groupBy("field").agg(F.count(F.lit(1)).alias("support")).select(F.lit("enum_representation_stream").alias("kind"), F.lit("").alias("inputs"), F.col("field").alias("output"), "support")
    return a.unionByName(b).unionByName(c)


# The loop.


def candidates(rows: DataFrame, key: str, knowledge: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Candidates of records against frozen knowledge (det, target, d, mode); rows may be a stream."""
    met = dep.long_pairs(rows, pairs, key).join(knowledge.select("det", "target", "d", "mode"), ["det", "target", "d"]).where("v is null or v <> mode")
    return met.select("row_id", F.col("target").alias("field"), F.col("v").alias("old_value"), F.col("mode").alias("new_value"), F.concat(F.lit("fd "), "det").alias("analyzer"), F.lit(1).alias("tier"))


def choose(found: DataFrame) -> DataFrame:
    """One value for each cell: of the highest tier, if all its candidates of that tier agree."""
    return rp.select_unique(rp.authority(found)[0]).select(*CELL, "old_value", "new_value")


def repair_stream(spark: SparkSession, folder: str, schema: StructType, key: str, pairs: list[tuple[str, str]], out: str, files: int = 1, cycles: int = CYCLES, quiet: int = QUIET) -> dict:
    """Repairs a folder of files as a stream and publishes the result at ``out``/records with its ``journal``.

    A cycle reads the stream twice: once for its knowledge, once to apply it, batch by batch, writing the records and the
    journal of each batch under its number.  It ends after so many quiet cycles; before anything is published, the journal
    is undone on the result and must give the records that came in.  Status PASS, or OPEN_REPAIRABLE after ``cycles``, or
    REFUSED if the inverse fails (then nothing is published)."""
    fields = sorted({t for _, t in pairs})
    work, now, calm, journals, changed = shared_folder(spark), folder, 0, [], []
    for cycle in range(cycles):
        here = f"{work}/{cycle}"
        counts = summarise(open_stream(spark, now, schema, files), {"functional": functional_counts(key, pairs)}, f"{here}/knowledge")["functional"]
        known = functional(counts)
        known.write.parquet(f"{here}/known")
        known = spark.read.parquet(f"{here}/known")

        def one(batch: DataFrame, number: int, here=here, known=known) -> None:
            batch = batch.persist()
            choose(candidates(batch, key, known, pairs)).write.mode("overwrite").parquet(f"{here}/journal/batch={number}")
            patches = spark.read.parquet(f"{here}/journal/batch={number}")
            rp.apply_patches(batch, key, patches, fields).write.mode("overwrite").parquet(f"{here}/records/batch={number}")
            batch.unpersist()

        open_stream(spark, now, schema, files).writeStream.foreachBatch(one).option("checkpointLocation", f"{here}/state").trigger(availableNow=True).start().awaitTermination()
        journal = spark.read.parquet(f"{here}/journal").drop("batch")
        changed.append(journal.count())
        calm = calm + 1 if not changed[-1] else 0
        if changed[-1]:
            journals.append(journal)
            spark.read.schema(schema).parquet(f"{here}/records/*").write.parquet(f"{here}/now")
            now = f"{here}/now"
        if calm >= quiet:
            break
    result = spark.read.schema(schema).parquet(now)
    back = rp.replay_inverse(result, key, fields, journals)
    if rp.digest(back) != rp.digest(spark.read.schema(schema).parquet(folder)):
        return {"status": "REFUSED", "cycles": len(changed), "changed": changed}
    stage = f"{work}/stage"
    result.write.parquet(f"{stage}/records")
    told = None
    for step, j in enumerate(journals):
        one_step = j.withColumn("step", F.lit(step))
        told = one_step if told is None else told.unionByName(one_step)
    empty = spark.createDataFrame([], "row_id long, field string, old_value string, new_value string, step int")
    (empty if told is None else told).write.parquet(f"{stage}/journal")
    publish(spark, stage, out)
    return {"status": "PASS" if calm >= quiet else "OPEN_REPAIRABLE", "cycles": len(changed), "changed": changed}


def undo(spark: SparkSession, out: str, schema: StructType, key: str, fields: list[str]) -> DataFrame:
    """The records that a published repair began with, from its records and its journal backwards."""
    journal = spark.read.parquet(f"{out}/journal")
    steps = sorted(r[0] for r in journal.select("step").distinct().collect())  # a few cycles
    return rp.replay_inverse(spark.read.schema(schema).parquet(f"{out}/records"), key, fields, [journal.where(F.col("step") == s).drop("step") for s in steps])


def record_issues(batch: DataFrame, key: str, checks: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(row_id, stage, code): the stages of a record's own checks (schema, rules, moments, states), each from a batch to rows
    of (row_id, code), in the order in which they are given."""
    out = None
    for number, (stage, check) in enumerate(checks.items()):
        one = check(batch).select("row_id", F.lit(f"{number} {stage}").alias("stage"), "code")
        out = one if out is None else out.unionByName(one)
    return out


def issue_counts(key: str, checks: dict[str, Callable[[DataFrame], DataFrame]]) -> Summary:
    return Summary(lambda b: record_issues(b, key, checks).groupBy("stage", "code").agg(F.count(F.lit(1)).alias("n")))


