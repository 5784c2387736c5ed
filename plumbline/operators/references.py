"""Keys, references and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import dealt

UNIQUE, OVERLAP = 0.90, 0.90


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Every occurrence of a repeated key, with the number of occurrences.  Only repeated keys travel."""
    again = df.groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")
    return again.select(*key, "occurrences", F.lit("duplicate_identifier").alias("code"))


def uniqueness(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, present, distinct_values, confidence, registry): a field is a key from UNIQUE on, a registry only if exact."""
    item = lambda c: F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
    rows = df.select(F.explode(F.array(*map(item, fields))).alias("p")).select("p.*").where("value is not null")
    counts = rows.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("field").agg(F.sum("n").alias("present"), F.count(F.lit(1)).alias("distinct_values"))
    return counts.withColumn("confidence", F.col("distinct_values") / F.col("present")).where(F.col("confidence") >= UNIQUE).withColumn("registry", F.col("distinct_values") == F.col("present"))


def overlaps(refs: DataFrame, ref_field: str, registries: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(target, overlap, confidence) for each registry: rows of the reference whose value it has."""
    out = None
    counted = refs.where(F.col(ref_field).isNotNull()).groupBy(F.col(ref_field).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    for name, (df, field) in sorted(registries.items()):
        ids = df.select(F.col(field).cast("string").alias("v")).distinct()
        one = counted.join(ids.withColumn("hit", F.lit(1)), "v", "left").agg(F.lit(name).alias("target"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("overlap"), F.sum("n").alias("observed"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("confidence", F.col("overlap") / F.col("observed"))


def best_registry(found: DataFrame) -> DataFrame:
    """The one best registry of ``overlaps``; a tie is reported as ambiguous without a target."""
    ranked = found.where(F.col("confidence") >= OVERLAP)
    top = ranked.agg(F.max(F.struct("confidence", "overlap")).alias("best"))
    tied = ranked.join(top).where((F.col("confidence") == F.col("best.confidence")) & (F.col("overlap") == F.col("best.overlap")))
    return tied.agg(F.count(F.lit(1)).alias("ties"), F.min("target").alias("target"), F.max("confidence").alias("confidence")).where("ties > 0").select(F.when(F.col("ties") == 1, F.col("target")).alias("target"), F.when(F.col("ties") > 1, F.lit("ambiguous_reference_target")).alias("code"), "confidence")


def dangling(refs: DataFrame, key: str, ref_field: str, registry: DataFrame, id_field: str, prefix: str = "") -> DataFrame:
    """References without a target: a candidate if exactly one identifier differs by case only, else dangling."""
    ids = registry.select(F.col(id_field).cast("string").alias("target_id")).distinct()
    lost = refs.select(F.col(key).alias("row_id"), F.col(ref_field).cast("string").alias("old_value")).where("old_value is not null").join(ids, F.col("old_value") == F.col("target_id"), "left_anti")
    folded = ids.groupBy(F.upper("target_id").alias("folded")).agg(F.count(F.lit(1)).alias("n"), F.min("target_id").alias("only")).where("n = 1")
    joined = lost.join(folded, F.upper("old_value") == F.col("folded"), "left")
    code = F.when(F.col("only").isNotNull(), F.lit(prefix + "reference_representation_variant")).otherwise(F.lit(prefix + "dangling_reference"))
    return joined.select("row_id", code.alias("code"), "old_value", F.col("only").alias("new_value"))


def latest_event(events: DataFrame, path: str, ordinal: str, value: str) -> DataFrame:
    """(path, value): the last event of each path."""
    return events.groupBy(F.col(path).alias("path")).agg(F.max_by(value, ordinal).alias("value"), F.max(ordinal).alias("ordinal"))


def residue(left: DataFrame, right: DataFrame, group: str, key: str, quantity: str) -> DataFrame:
    """Keys whose summed quantities differ between two lists of the same group: the multiset residue."""
    both = side_by_side(left, right, [group, key], {"left_quantity": F.col(quantity)}, {"right_quantity": F.col(quantity)})
    sums = both.groupBy(group, key, "apart").agg(F.sum("left_quantity").alias("left_quantity"), F.sum("right_quantity").alias("right_quantity")).drop("apart").na.fill(0, ["left_quantity", "right_quantity"])
    return sums.withColumn("difference", F.col("left_quantity") - F.col("right_quantity")).where("difference <> 0")


def side_by_side(left: DataFrame, right: DataFrame, keys: list[str], of_left: dict[str, Column], of_right: dict[str, Column]) -> DataFrame:
    """(keys, the columns of both sides, apart): the rows of two tables under each other, null in the other's columns, dealt by
    their keys.  Grouped by the keys and ``apart`` they are what a full outer join of both sides' groups is, which doesn't join
    null with null, without a sort and with one exchange."""
    def side(df: DataFrame, own: dict[str, Column], name: str) -> DataFrame:
        lost = F.lit(False)
        for k in keys:
            lost = lost | F.col(k).isNull()
        return df.select(*keys, *(c.alias(n) for n, c in own.items()), F.when(lost, name).alias("apart"))

    return dealt(side(left, of_left, "left").unionByName(side(right, of_right, "right"), allowMissingColumns=True), *keys)


def top_with_ties(df: DataFrame, group: str, score: str, item: str) -> DataFrame:
    """(group, item, tied): the best item of each group and whether another is as good."""
    order = Window.partitionBy(group).orderBy(F.desc(score))
    ranked = df.withColumns({"rank": F.rank().over(order), "row": F.row_number().over(order.orderBy(F.desc(score), item))})
    return ranked.where("rank = 1").groupBy(group).agg(F.min_by(item, "row").alias("item"), (F.count(F.lit(1)) > 1).alias("tied"))
