"""Profiles: types, shapes, required keys, enumerations, heavy hitters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def kind(v: Column) -> Column:
    """JSON type name of a text that holds a JSON value."""
    return (
        F.when(v.isNull(), None).when(v == "null", "null").when(v.isin("true", "false"), "boolean")
        .when(v.rlike(r"^-?[0-9]+$"), "integer").when(v.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), "number")
        .when(v.startswith("["), "array").when(v.startswith("{"), "object").otherwise("string")
    )


def type_consensus(values: DataFrame, confidence: float = 0.90, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """values: (row_id, field, value as JSON text).  (relations, outliers)."""
    typed = values.withColumn("type", kind(F.col("value"))).where("type <> 'null'")
    counts = typed.groupBy("field", "type").agg(F.count(F.lit(1)).alias("n"))
    by_field = Window.partitionBy("field")
    top = counts.withColumns({"observed": F.sum("n").over(by_field), "r": F.row_number().over(by_field.orderBy(F.desc("n"), "type"))}).where(f"r = 1 and observed >= {least}")
    relations = top.withColumn("confidence", F.col("n") / F.col("observed")).where(F.col("confidence") >= confidence).select("field", "type", F.col("n").alias("support"), "observed", "confidence")
    outliers = typed.join(relations.select("field", F.col("type").alias("expected")), "field").where("type <> expected").select("row_id", "field", F.lit("type_outlier").alias("code"), F.col("type").alias("found"), "expected")
    return relations, outliers


def shapes(keys: DataFrame, share: float = 0.80) -> DataFrame:
    """keys: (row_id, keys array).  The most common key set if its share is large enough."""
    counts = keys.groupBy(F.array_join(F.array_sort("keys"), ",").alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("observed"))
    top = counts.orderBy(F.desc("n"), "shape").limit(1)
    return top.join(total).withColumn("confidence", F.col("n") / F.col("observed")).where(F.col("confidence") >= share)


def required_keys(keys: DataFrame, share: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(relations, missing rows) of keys that nearly all rows have."""
    counts = keys.select(F.explode("keys").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("support"))
    total = keys.agg(F.count(F.lit(1)).alias("observed"))
    relations = counts.join(total).withColumn("confidence", F.col("support") / F.col("observed")).where(F.col("confidence") >= share)
    needed = relations.agg(F.array_sort(F.collect_list("field")).alias("needed"))  # one row; as many as there are fields
    missing = keys.join(needed).select("row_id", F.explode(F.array_except("needed", "keys")).alias("field")).withColumn("code", F.lit("missing_required_key"))
    return relations, missing


def enum_domain(df: DataFrame, key: str, field: str, most: int = 16, support: int = 2, confidence: float = 0.90, normal: float = 0.75) -> DataFrame:
    """Rows whose text is a spelling variant of a canonical value (candidate) or outside the domain."""
    counts = df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("observed"))
    canonical = counts.where(f"n >= {support}").withColumn("f", F.upper("v"))
    ranked = canonical.withColumn("top", F.row_number().over(Window.partitionBy("f").orderBy(F.desc("n"), "v")))
    domain = ranked.where("top = 1").select("f", F.col("v").alias("canonical"), F.col("n").alias("canonical_n"))
    size = canonical.agg(F.count(F.lit(1)).alias("values"))
    judged = counts.withColumn("f", F.upper("v")).join(domain, "f", "left")
    share = F.col("canonical_n") / (F.col("canonical_n") + F.col("n"))
    variant = F.col("canonical").isNotNull() & (F.col("v") != F.col("canonical")) & (share >= normal)
    status = F.when(F.col("v") == F.col("canonical"), "member").when(variant, "enum_representation_variant").when(F.col("n") >= support, "member").otherwise("enum_domain_outlier")
    judged = judged.withColumn("code", status)
    recognised = judged.where("code <> 'enum_domain_outlier'").agg(F.sum("n").alias("recognised"))
    gate = total.join(size).join(recognised).where(f"values <= {most} and values <= observed / 2 and recognised / observed >= {confidence}")
    bad = judged.where("code <> 'member'").join(F.broadcast(gate.select("observed"))).select("v", "code", F.when(F.col("code") == "enum_representation_variant", F.col("canonical")).alias("new_value"))
    return df.select(F.col(key).alias("row_id"), F.col(field).alias("v")).join(bad, "v").select("row_id", "code", F.col("v").alias("old_value"), "new_value")


def unpivot(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(row_id, field, value): values as JSON texts."""
    item = lambda c: F.struct(F.lit(c).alias("field"), F.get_json_object(F.to_json(F.struct(F.col(c).alias("x")), {"ignoreNullFields": "false"}), "$.x").alias("value"))
    return df.select(F.col(key).alias("row_id"), F.explode(F.array(*map(item, fields))).alias("p")).select("row_id", "p.*")


def field_profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, present, distinct_values, least, most) in one pass."""
    item = lambda c: F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
    rows = df.select(F.explode(F.array(*map(item, fields))).alias("p")).select("p.*")
    return rows.groupBy("field").agg(F.count("value").alias("present"), F.count_distinct("value").alias("distinct_values"), F.min("value").alias("least"), F.max("value").alias("most"))


def heavy_hitters(df: DataFrame, field: str, k: int = 64) -> DataFrame:
    return df.groupBy(F.col(field).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def regime_detect(df: DataFrame, fields: list[str], shape: Column, least: int = 2, most: int = 8, gain: float = 0.10) -> DataFrame:
    """(field, regimes, gain): discriminators whose values make row shapes more uniform, best first."""
    item = lambda c: F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
    rows = df.withColumn("shape", shape).select("shape", F.explode(F.array(*map(item, fields))).alias("p")).select("shape", "p.*")
    whole = df.withColumn("shape", shape).groupBy("shape").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("base"))
    counts = rows.where("value is not null").groupBy("field", "value", "shape").agg(F.count(F.lit(1)).alias("n"))
    by_value = counts.groupBy("field", "value").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    by_field = by_value.groupBy("field").agg(F.count(F.lit(1)).alias("regimes"), F.min("n").alias("smallest"), (F.sum("top") / F.sum("n")).alias("coherence"))
    return by_field.join(whole).where(f"regimes between 2 and {most} and smallest >= {least}").withColumn("gain", F.col("coherence") - F.col("base")).where(F.col("gain") >= gain).select("field", "regimes", "gain")
