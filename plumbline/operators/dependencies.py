"""Functional dependencies: discovery, scopes, sparse recovery, falsification."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_SUPPORT, MIN_GROUP, CONFIDENCE, MAX_FIELDS = 4, 3, 0.95, 12
SCOPE_SUPPORT, SCOPE_GROUP = 3, 2
SPARSE_FLOOR, SPARSE_MODE, SPARSE_MARGIN, SPARSE_OTHER = 0.60, 3, 2, 1


def fields_of(fields: list[str]) -> tuple[list[str], list[str]]:
    """(fields that dependencies are sought among, those left out): the first MAX_FIELDS by name.  Pairs of others can be asked
    for by name."""
    return sorted(fields)[:MAX_FIELDS], sorted(fields)[MAX_FIELDS:]


def pairs_of(fields: list[str]) -> list[tuple[str, str]]:
    return list(permutations(fields_of(fields)[0], 2))


def long_pairs(df: DataFrame, pairs: list[tuple[str, str]], key: str, scope: Column | None = None) -> DataFrame:
    """(row_id, scope, det, target, d, v): a row for each pair of fields; one scan for all pairs."""
    item = lambda d, t: F.struct(F.lit(d).alias("det"), F.lit(t).alias("target"), F.col(d).cast("string").alias("d"), F.col(t).cast("string").alias("v"))
    scope = F.lit("") if scope is None else scope.cast("string")
    return df.select(F.col(key).alias("row_id"), scope.alias("scope"), F.explode(F.array(*(item(d, t) for d, t in pairs))).alias("p")).select("row_id", "scope", "p.*")


def modes(rows: DataFrame, *keys: str) -> DataFrame:
    """For each key and determinant: mode (the smallest value among equals), its count, the second count, all rows."""
    counts = rows.where("d is not null and v is not null").groupBy(*keys, "d", "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "d").orderBy(F.desc("n"), "v")))
    return ranked.groupBy(*keys, "d").agg(
        F.max(F.when(F.col("r") == 1, F.col("v"))).alias("mode"),
        F.max(F.when(F.col("r") == 1, F.col("n"))).alias("mode_n"),
        F.coalesce(F.max(F.when(F.col("r") == 2, F.col("n"))), F.lit(0)).alias("second_n"),
        F.sum("n").alias("n"),
    )


def functional(df: DataFrame, key: str, fields: list[str], pairs: list[tuple[str, str]] | None = None, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(relations, candidates).  Confidence: rows in the modes of groups of MIN_GROUP or more, over all observed rows; a row
    of such a group with another or no target is a violation whose candidate is the group's mode."""
    rows = long_pairs(df, pairs or pairs_of(fields), key)
    found = modes(rows, "det", "target")
    good = F.col("n") >= MIN_GROUP
    relations = found.groupBy("det", "target").agg(F.sum(F.when(good, F.col("mode_n")).otherwise(0)).alias("support"), F.sum("n").alias("observed"))
    relations = relations.where(f"observed >= {MIN_SUPPORT}").withColumn("confidence", F.col("support") / F.col("observed")).where(F.col("confidence") >= confidence)
    table = found.where(good).join(F.broadcast(relations.select("det", "target", "confidence")), ["det", "target"])  # at most 132 relations
    # Rows meet the values that break a relation, which are few, not the modes of all groups: a determinant that very many
    # rows have is only joined for what is wrong with it.
    values = rows.where("d is not null").groupBy("det", "target", "d", "v").agg(F.count(F.lit(1)).alias("rows"))
    wrong = values.join(table.select("det", "target", "d", "mode", "confidence"), ["det", "target", "d"]).where("v is null or v <> mode").select("det", "target", "d", F.col("v").alias("w"), "mode", "confidence")
    at = wrong.alias("w")
    bad = rows.alias("r").join(at, (F.col("r.det") == F.col("w.det")) & (F.col("r.target") == F.col("w.target")) & (F.col("r.d") == F.col("w.d")) & F.col("r.v").eqNullSafe(F.col("w.w")))
    code = F.when(F.col("r.v").isNull(), F.lit("missing_from_functional_relation")).otherwise(F.lit("functional_relation_violation"))
    return relations, bad.select("r.row_id", "r.det", "r.target", code.alias("code"), F.col("r.v").alias("old_value"), F.col("mode").alias("new_value"), "confidence")


def violations_of(df: DataFrame, key: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(row_id, det, target, old_value, new_value) of dependencies that are known to hold: rows of a group of MIN_GROUP or more
    with another target than its mode.  A group's rows are all that its candidates depend on, so a part of a table that
    holds whole groups gives what the whole table gives for them."""
    rows = long_pairs(df, pairs, key)
    found = modes(rows, "det", "target").where(F.col("n") >= MIN_GROUP).select("det", "target", "d", "mode")
    return rows.join(found, ["det", "target", "d"]).where("v is null or v <> mode").select("row_id", "det", "target", F.col("v").alias("old_value"), F.col("mode").alias("new_value"))


def sparse_recovery(df: DataFrame, key: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Candidates where confidence is between the floor and the usual threshold, but every group has a clear mode and
    stray values come once each."""
    rows = long_pairs(df, pairs, key)
    found = modes(rows, "det", "target")
    table = found.groupBy("det", "target").agg(
        F.sum("mode_n").alias("support"), F.sum("n").alias("observed"),
        F.bool_and((F.col("n") >= MIN_GROUP) & (F.col("mode_n") >= SPARSE_MODE) & (F.col("mode_n") - F.col("second_n") >= SPARSE_MARGIN) & (F.col("second_n") <= SPARSE_OTHER)).alias("clear"),
    ).withColumn("confidence", F.col("support") / F.col("observed")).where(f"clear and confidence >= {SPARSE_FLOOR} and confidence < {CONFIDENCE}")
    good = found.join(F.broadcast(table.select("det", "target", "confidence")), ["det", "target"])
    return rows.join(good.select("det", "target", "d", "mode", "confidence"), ["det", "target", "d"]).where("v <> mode").select("row_id", "det", "target", F.col("v").alias("old_value"), F.col("mode").alias("new_value"), "confidence")


def scoped(df: DataFrame, key: str, scope: str, pairs: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Functional dependencies inside each value of a scope field."""
    rows = long_pairs(df, pairs, key, F.col(scope)).where("scope is not null")
    found = modes(rows, "scope", "det", "target")
    good = F.col("n") >= SCOPE_GROUP
    relations = found.groupBy("scope", "det", "target").agg(F.sum(F.when(good, F.col("mode_n")).otherwise(0)).alias("support"), F.sum("n").alias("observed"))
    relations = relations.where(f"observed >= {SCOPE_SUPPORT}").withColumn("confidence", F.col("support") / F.col("observed")).where(F.col("confidence") >= CONFIDENCE)
    table = found.where(good).join(relations.select("scope", "det", "target", "confidence"), ["scope", "det", "target"])
    bad = rows.join(table.select("scope", "det", "target", "d", "mode", "confidence"), ["scope", "det", "target", "d"]).where("v is null or v <> mode")
    code = F.when(F.col("v").isNull(), F.lit("missing_from_scoped_relation")).otherwise(F.lit("scoped_relation_violation"))
    return relations, bad.select("row_id", "scope", "det", "target", code.alias("code"), F.col("v").alias("old_value"), F.col("mode").alias("new_value"))


def falsify(df: DataFrame, ordinal: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(det, target, status).  Folds by row parity that map a determinant to different modes refute; a target with one value
    is explained without the determinant; a rotation of the determinant by a row must lower the agreement."""
    rows = long_pairs(df, pairs, ordinal).where("d is not null and v is not null")
    agreement = lambda found: found.groupBy("det", "target").agg((F.sum("mode_n") / F.sum("n")).alias("agreement"), F.count_distinct("mode").alias("values"))
    whole = agreement(modes(rows, "det", "target"))
    folds = modes(rows.withColumn("fold", F.pmod("row_id", F.lit(2))), "det", "target", "fold").groupBy("det", "target", "d").agg(F.count_distinct("mode").alias("k"), F.min("n").alias("least"), F.count(F.lit(1)).alias("folds"))
    conflicts = folds.groupBy("det", "target").agg(F.sum(F.when((F.col("k") > 1) & (F.col("least") >= 2), 1).otherwise(0)).alias("conflicts"))
    turned = rows.withColumn("next", F.col("row_id") + 1).drop("d").join(rows.select(F.col("row_id").alias("next"), "det", "target", "d"), ["next", "det", "target"])
    control = agreement(modes(turned, "det", "target")).select("det", "target", F.col("agreement").alias("control"))
    joined = whole.join(conflicts, ["det", "target"]).join(control, ["det", "target"], "left")
    status = (
        F.when(F.col("conflicts") > 0, "ACTIVE_REFUTED").when(F.col("values") <= 1, "NEGATIVE_CONTROL_INVARIANT")
        .when(F.col("control") < F.col("agreement"), "ADVERSARIAL_SURVIVED").otherwise("OBSERVED_STABLE")
    )
    return joined.select("det", "target", status.alias("status"))


def blind_trial(df: DataFrame, key: str, det: str, target: str) -> DataFrame:
    """Hide each target and rebuild it from the others with its determinant: outcome counts."""
    rows = long_pairs(df, [(det, target)], key).where("d is not null and v is not null")
    counts = rows.groupBy("d", "v").agg(F.count(F.lit(1)).alias("n"))
    others = counts.alias("a").join(counts.alias("b"), F.col("a.d") == F.col("b.d")).select(F.col("a.d").alias("d"), F.col("a.v").alias("v"), F.col("a.n").alias("rows"), F.col("b.v").alias("w"), (F.col("b.n") - F.when(F.col("a.v") == F.col("b.v"), 1).otherwise(0)).alias("n")).where("n > 0")
    ranked = others.withColumn("r", F.row_number().over(Window.partitionBy("d", "v").orderBy(F.desc("n"), "w"))).where("r = 1")
    outcome = counts.join(ranked.select("d", "v", "w"), ["d", "v"], "left").withColumn("outcome", F.when(F.col("w").isNull(), "NO_PEERS").when(F.col("w") == F.col("v"), "RECOVERED").otherwise("MISSED"))
    return outcome.groupBy("outcome").agg(F.sum("n").cast("long").alias("n_rows"))
