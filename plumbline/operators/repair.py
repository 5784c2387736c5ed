"""Candidates to patches: gates, selection, application, inverse, and the loop to a fixed point.

Candidates are rows (row_id, field, old_value, new_value, analyzer, tier); values are texts.  Tiers: 3 authoritative,
2 derived, 1 inferred.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["row_id", "field"]


def authority(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(allowed, conflicts): of each cell only the highest tier counts; two values at the authoritative tier allow none."""
    best = candidates.groupBy(*CELL).agg(F.max("tier").alias("top"))
    high = candidates.join(best, CELL).where("tier = top").drop("top")
    clash = high.where("tier = 3").groupBy(*CELL).agg(F.count_distinct("new_value").alias("values")).where("values > 1")
    return high.join(clash, CELL, "left_anti"), clash.withColumn("code", F.lit("authority_conflict"))


def select_unique(candidates: DataFrame) -> DataFrame:
    """The value of each cell on which all its candidates agree; a cell with two values is left alone."""
    return candidates.groupBy(*CELL).agg(F.min("old_value").alias("old_value"), F.min("new_value").alias("new_value"), F.count_distinct("new_value").alias("values"), F.count_distinct("analyzer").alias("analyzers")).where("values = 1").drop("values")


def status(candidates: DataFrame) -> DataFrame:
    """(row_id, field, status): UNIQUE or MULTIPLE by the values that are left after each analyzer's domain is intersected."""
    domains = candidates.groupBy(*CELL, "analyzer").agg(F.collect_set("new_value").alias("domain"))
    # Values that every analyzer of the cell admits.
    votes = domains.select(*CELL, F.explode("domain").alias("v")).groupBy(*CELL, "v").agg(F.count(F.lit(1)).alias("n"))
    need = domains.groupBy(*CELL).agg(F.count(F.lit(1)).alias("need"))
    left = need.join(votes, CELL).groupBy(*CELL).agg(F.count(F.when(F.col("n") == F.col("need"), 1)).alias("k"))
    return left.select(*CELL, F.when(F.col("k") == 1, "UNIQUE").when(F.col("k") > 1, "MULTIPLE").otherwise("NONE").alias("status"))


def control(candidates: DataFrame, allowed: list[str] | None = None, immutable: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(reachable, unreachable) by field globs."""
    from ..functions import glob_regex

    ok = F.lit(True)
    if allowed is not None:
        ok = F.lit(False)
        for g in allowed:
            ok = ok | F.col("field").rlike(glob_regex(g))
    for g in immutable:
        ok = ok & ~F.col("field").rlike(glob_regex(g))
    return candidates.where(ok), candidates.where(~ok).select(*CELL, F.lit("IDENTIFIABLE_BUT_UNREACHABLE").alias("code"))


def boundary(candidates: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Candidates whose value stays within its field's bounds; contradictory bounds allow none."""
    ok = F.lit(True)
    for field, (low, high) in bounds.items():
        v = F.col("new_value").try_cast("decimal(38,9)")
        inside = F.lit(not (low is not None and high is not None and low > high))
        if low is not None:
            inside = inside & F.coalesce(v >= low, F.lit(False))
        if high is not None:
            inside = inside & F.coalesce(v <= high, F.lit(False))
        ok = ok & ((F.col("field") != field) | inside)
    return candidates.where(ok)


def robust(candidates: DataFrame, uncertainty: DataFrame) -> DataFrame:
    """uncertainty: (field, radius).  Candidates that move a number by more than its uncertainty."""
    joined = candidates.join(F.broadcast(uncertainty), "field", "left")  # a row for each field
    far = F.abs(F.col("new_value").try_cast("decimal(38,9)") - F.col("old_value").try_cast("decimal(38,9)")) > F.col("radius")
    return joined.where(F.col("radius").isNull() | F.coalesce(far, F.lit(True))).drop("radius")


def apply_patches(df: DataFrame, key: str, patches: DataFrame, fields: list[str]) -> DataFrame:
    """The table with patches (row_id, field, old_value, new_value) applied where the old value is still there."""
    wide = patches.where(F.col("field").isin(fields)).groupBy("row_id").pivot("field", fields).agg(F.min(F.struct(F.lit(1).alias("hit"), "old_value", "new_value")))
    joined = df.join(wide.select("row_id", *(F.col(f).alias(f"_p_{f}") for f in fields)), F.col(key) == F.col("row_id"), "left")
    out: dict[str, Column] = {}
    for f in fields:
        patch = F.col(f"_p_{f}")
        still = (patch["hit"] == 1) & F.col(f).cast("string").eqNullSafe(patch["old_value"])
        out[f] = F.when(still, patch["new_value"].cast(df.schema[f].dataType)).otherwise(F.col(f))
    return joined.withColumns(out).select(*df.columns)


def inverse(patches: DataFrame) -> DataFrame:
    return patches.withColumns({"old_value": F.col("new_value"), "new_value": F.col("old_value")})


def digest(df: DataFrame) -> tuple[int, int, int]:
    """Order-independent digest of a table: number of rows, sum and exclusive or of their hashes; the sum tells apart rows
    that come twice."""
    row = F.xxhash64(*df.columns)
    got = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
    return got[0], int(got[1] or 0), got[2] or 0


def fixed_point(df: DataFrame, key: str, fields: list[str], analyze: Callable[[DataFrame], DataFrame], checkpoint, cycles: int = 8, quiet: int = 2, relations: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, list[DataFrame], str]:
    """(table, journal of patch tables, status): analyses and applies unique candidates until ``quiet`` cycles change nothing,
    neither the table nor, if asked for, the relations that hold in it.  A digest seen before with other cycles between
    stops the loop as oscillation."""
    journal, calm, seen, told = [], 0, {digest(df)}, None
    for cycle in range(cycles):
        if relations is not None:
            now = digest(relations(df))
            calm = calm if told in (None, now) else 0
            told = now
        patches = checkpoint(select_unique(authority(analyze(df))[0]).select(*CELL, "old_value", "new_value"), f"patches-{cycle}")
        if patches.isEmpty():
            calm += 1
            if calm >= quiet:
                return df, journal, "PASS"
            continue
        calm = 0
        journal.append(patches)
        df = checkpoint(apply_patches(df, key, patches, fields), f"cycle-{cycle}")
        now = digest(df)
        if now in seen:
            return df, journal, "OSCILLATION"
        seen.add(now)
    return df, journal, "OPEN_REPAIRABLE"


def order_independent(df: DataFrame, key: str, fields: list[str], analyze: Callable[[DataFrame], DataFrame], checkpoint) -> bool:
    """Whether the fixed point is the same from the rows in another order and other partitions."""
    ends = []
    for name, rows in (("given", df), ("turned", df.orderBy(F.desc(key)).repartition(7, F.xxhash64(key)))):
        done, _, status = fixed_point(checkpoint(rows, f"{name}-rows"), key, fields, analyze, lambda t, n, name=name: checkpoint(t, f"{name}-{n}"))
        ends.append((status, digest(done.select(*sorted(df.columns)))))
    return ends[0] == ends[1]


def replay_inverse(df: DataFrame, key: str, fields: list[str], journal: list[DataFrame]) -> DataFrame:
    for patches in reversed(journal):
        df = apply_patches(df, key, inverse(patches), fields)
    return df
