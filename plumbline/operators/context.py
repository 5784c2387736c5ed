"""Context sources beside the table at hand: relations that hold elsewhere, defaults, authorities, logs, witnesses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dependencies as dep
from .repair import CELL


def align(df: DataFrame, identity: dict[str, str]) -> DataFrame:
    """A source's columns under the names that its identities give them; others keep theirs.  Two columns of one identity are
    refused."""
    names = [identity.get(c, c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("two columns have one identity")
    return df.toDF(*names)


def compare_versions(old: DataFrame, new: DataFrame, key: str, identity: dict[str, str]) -> DataFrame:
    """(row_id, field, old_value, new_value): cells that differ between two versions of a table, of which the new one has
    other column names.  A row that only one of them has differs in all its fields."""
    now = align(new, identity)
    fields = [c for c in old.columns if c != key and c in now.columns]
    long = lambda df, name: df.select(F.col(key).alias("row_id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields))).alias("c")).select("row_id", "c.*")
    return long(old, "old_value").join(long(now, "new_value"), CELL, "full_outer").where("not old_value <=> new_value")


def lifecycle(development: DataFrame, heldout: DataFrame, pairs: list[tuple[str, str]], key: str = "id") -> DataFrame:
    """(det, target, status, rows, mismatches, groups): what became of dependencies learnt on development rows when they met
    others.  heldout has source_group: rows of one group are no independent evidence of each other; null marks rows that
    share their origin with the development rows.

    DEVELOPMENT_CONFLICT: a determinant has two values already there.  DISCOVERED: no held-out row has a known determinant.
    GLOBAL_REFUTED: an independent group contradicts.  DEPENDENT_REPLICATION_ONLY: none is independent.
    HELDOUT_CONFIRMED by one independent group, PORTABLE by two or more."""
    learnt = dep.modes(dep.long_pairs(development, pairs, key), "det", "target")
    exact = learnt.groupBy("det", "target").agg((F.sum("mode_n") == F.sum("n")).alias("exact"))
    rows = dep.long_pairs(heldout, pairs, key, F.col("source_group")).where("v is not null")
    test = rows.join(learnt.select("det", "target", "d", "mode"), ["det", "target", "d"])
    found = test.groupBy("det", "target").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("v") != F.col("mode"), 1)).alias("mismatches"),
        F.count(F.when(F.col("scope").isNotNull() & (F.col("v") != F.col("mode")), 1)).alias("against"), F.count_distinct("scope").alias("groups"),
    )
    joined = exact.join(found, ["det", "target"], "left").na.fill(0, ["rows", "mismatches", "against", "groups"])
    status = (
        F.when(~F.col("exact"), "DEVELOPMENT_CONFLICT").when(F.col("rows") == 0, "DISCOVERED").when(F.col("against") > 0, "GLOBAL_REFUTED")
        .when(F.col("groups") == 0, "DEPENDENT_REPLICATION_ONLY").when(F.col("groups") == 1, "HELDOUT_CONFIRMED").otherwise("PORTABLE")
    )
    return joined.select("det", "target", status.alias("status"), "rows", "mismatches", "groups")


def assimilate(df: DataFrame, key: str, field: str, defaults: DataFrame | None = None, authority: list[DataFrame] = (), log: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, conflicts).  Sources are (row_id, value); log is (row_id, ordinal, value).  An authoritative value replaces
    what differs (authoritative_source_mismatch); else the last logged value does (event_projection_mismatch), else a default
    fills what is missing (missing_value_with_default).  Two authorities that differ, or two logged values of one last
    ordinal, are a conflict (source_registry_conflict) and nothing is proposed for the cell."""
    rows = df.select(F.col(key).alias("row_id"), F.col(field).cast("string").alias("old_value"))
    told = None
    for a in authority:
        one = a.select("row_id", F.col("value").cast("string").alias("value"))
        told = one if told is None else told.unionByName(one)
    empty = rows.select("row_id", F.lit(None).cast("string").alias("v"), F.lit(0).cast("long").alias("k")).limit(0)
    given = empty if told is None else told.where("value is not null").groupBy("row_id").agg(F.min("value").alias("v"), F.count_distinct("value").alias("k"))
    if log is None:
        last = empty
    else:
        ends = log.groupBy("row_id").agg(F.max("ordinal").alias("ordinal"))
        last = log.join(ends, ["row_id", "ordinal"]).groupBy("row_id").agg(F.min(F.col("value").cast("string")).alias("v"), F.count_distinct(F.col("value").cast("string")).alias("k"))
    spare = empty if defaults is None else defaults.select("row_id", F.col("value").cast("string").alias("v"), F.lit(1).cast("long").alias("k"))
    named = lambda d, n: d.select("row_id", F.col("v").alias(f"{n}_v"), F.col("k").alias(f"{n}_k"))
    joined = rows.join(named(given, "a"), "row_id", "left").join(named(last, "l"), "row_id", "left").join(named(spare, "d"), "row_id", "left")
    clash = (F.coalesce("a_k", F.lit(0)) > 1) | (F.col("a_k").isNull() & (F.coalesce("l_k", F.lit(0)) > 1))
    new = F.coalesce("a_v", "l_v", F.when(F.col("old_value").isNull(), F.col("d_v")))
    code = F.when(F.col("a_v").isNotNull(), "authoritative_source_mismatch").when(F.col("l_v").isNotNull(), "event_projection_mismatch").otherwise("missing_value_with_default")
    tier = F.when(F.col("a_v").isNotNull(), 3).when(F.col("l_v").isNotNull(), 2).otherwise(1)
    wanted = joined.where(~clash & new.isNotNull() & ~new.eqNullSafe(F.col("old_value")))
    candidates = wanted.select("row_id", F.lit(field).alias("field"), "old_value", new.alias("new_value"), code.alias("analyzer"), tier.alias("tier"))
    return candidates, joined.where(clash).select("row_id", F.lit(field).alias("field"), F.lit("source_registry_conflict").alias("code"))


def witnesses(open_cells: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """(row_id, field, status, value, sources): open cells (row_id, field, key) looked up in sources (source_id, key, field,
    value).  MATERIALIZED if all sources that know the cell say one value, CONFLICT if they differ, MISSING if none knows."""
    told = None
    for s in sources:
        one = s.select("source_id", "key", "field", F.col("value").cast("string").alias("value")).where("value is not null")
        told = one if told is None else told.unionByName(one)
    known = told.groupBy("key", "field").agg(F.count_distinct("value").alias("values"), F.min("value").alias("value"), F.count_distinct("source_id").alias("sources"))
    joined = open_cells.join(known, ["key", "field"], "left")
    status = F.when(F.col("values").isNull(), "MISSING").when(F.col("values") == 1, "MATERIALIZED").otherwise("CONFLICT")
    return joined.select("row_id", "field", status.alias("status"), F.when(F.col("values") == 1, F.col("value")).alias("value"), F.coalesce("sources", F.lit(0).cast("long")).alias("sources"))
