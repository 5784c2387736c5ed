"""Parent values that are aggregates of their children: sums, counts, balances, moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import DEC, decimal, exact, minus, over, plus, times, total

CONFIDENCE, MIN_SUPPORT, MIN_DISTINCT = 0.95, 4, 2
SUM_NAMES = r"(?i)^(total|sum|subtotal|amount|.*_(total|sum))$"
COUNT_NAMES = r"(?i)^(count|n|size|.*_count)$"


def discover(parents: DataFrame, key: str, target: str, children: DataFrame, foreign: str, value: Column, kind: str) -> tuple[DataFrame, DataFrame]:
    """(relation, candidates): whether parents' target is the sum of the children's value ("sum") or their number
    ("count") nearly always, and the rows where it isn't.  Children are summed before they meet their parents."""
    made = exact_sum(exact(value)) if kind == "sum" else F.count(F.lit(1)).cast(DEC)
    sums = children.groupBy(F.col(foreign).alias("row_id")).agg(made.cast(DEC).alias("expected"))
    rows = parents.select(F.col(key).alias("row_id"), exact(target).alias("found")).join(sums, "row_id")
    relation = rows.where("found is not null").agg(F.count(F.lit(1)).alias("decided"), F.count(F.when(F.col("found") == F.col("expected"), 1)).alias("support"), F.approx_count_distinct("expected").alias("d"))
    relation = relation.where(f"decided >= {MIN_SUPPORT} and d >= {MIN_DISTINCT} and support / decided >= {CONFIDENCE}").select(F.lit(f"aggregate_{kind}").alias("kind"), F.lit(target).alias("output"), "support", "decided")
    bad = rows.where("found is null or found <> expected").join(F.broadcast(relation.select("kind")))
    code = F.concat("kind", F.when(F.col("found").isNull(), "_missing").otherwise("_violation"))
    return relation, bad.select("row_id", code.alias("code"), F.col("found").alias("old_value"), F.col("expected").alias("new_value"))


def exact_sum(c: Column) -> Column:
    """The sum of DEC numbers; null beyond 28 digits before the point, or if a number in the group was lost."""
    return F.try_sum(c).cast(DEC)


def linear_balance(df: DataFrame, key: str, terms: dict[str, int], target: str) -> DataFrame:
    """Rows where the terms with their coefficients don't sum to zero; the target solves each."""
    others = [times(exact(f), decimal(c)) for f, c in sorted(terms.items()) if f != target]
    wanted = over(F.negative(total(F.lit(0).cast(DEC), *others)), decimal(terms[target]))
    return df.select(F.col(key).alias("row_id"), exact(target).alias("old_value"), wanted.alias("new_value")).where("new_value is not null and (old_value is null or old_value <> new_value)").withColumn("code", F.lit("conservation_violation"))


def declared(parents: DataFrame, key: str, target: str, children: DataFrame, foreign: str, kind: str, value: Column | None = None) -> DataFrame:
    """(row_id, code, old_value, new_value): parents whose declared target isn't the sum of their children's values, or their
    number.  A declared rule needs no support: a parent without children has a sum and a number of 0."""
    made = exact_sum(exact(value)) if kind == "sum" else F.count(F.lit(1)).cast(DEC)
    sums = children.groupBy(F.col(foreign).alias("row_id")).agg(made.alias("m"), F.count(F.lit(1)).alias("n"))
    rows = parents.select(F.col(key).alias("row_id"), exact(target).alias("old_value")).join(sums, "row_id", "left")
    rows = rows.withColumn("new_value", F.when(F.col("n").isNull(), F.lit(0).cast(DEC)).otherwise(F.col("m"))).where("new_value is not null and (old_value is null or old_value <> new_value)")
    return rows.select("row_id", F.concat(F.lit(f"aggregate_{kind}"), F.when(F.col("old_value").isNull(), "_missing").otherwise("_violation")).alias("code"), "old_value", "new_value")


def multisets(left: DataFrame, right: DataFrame, group: str, pairs: list[tuple[str, str]], confidence: float = CONFIDENCE) -> DataFrame:
    """(key, quantity, support, decided): pairs of a key and a quantity by which two lists of a group hold the same nearly
    always, whatever the order and however the quantities are split."""
    from .references import side_by_side

    out = None
    for key, quantity in pairs:
        own = lambda df: df.select(F.col(group).alias("g"), F.col(key).cast("string").alias("k"), exact(quantity).alias("x"))
        both = side_by_side(own(left), own(right), ["g", "k"], {"a": F.col("x")}, {"b": F.col("x")})
        both = both.groupBy("g", "k", "apart").agg(exact_sum(F.col("a")).alias("a"), exact_sum(F.col("b")).alias("b"))
        by_group = both.groupBy("g").agg(F.bool_and(F.coalesce(F.coalesce("a", F.lit(0).cast(DEC)) == F.coalesce("b", F.lit(0).cast(DEC)), F.lit(False))).alias("same"))
        one = by_group.agg(F.lit(key).alias("key"), F.lit(quantity).alias("quantity"), F.count(F.when(F.col("same"), 1)).alias("support"), F.count(F.lit(1)).alias("decided"))
        out = one if out is None else out.unionByName(one)
    return out.where(f"decided >= {MIN_SUPPORT} and support / decided >= {confidence}")


def declared_multiset(left: DataFrame, right: DataFrame, group: str, key: str, quantity: str, row: str) -> DataFrame:
    """(row_id, old_value, new_value): the right list is declared to hold what the left one does.  A group whose lists differ in
    one key only, which one row of the right list has, is repaired in that row; other residues are left to people."""
    from .references import residue

    rest = residue(left.select(group, key, quantity), right.select(group, key, quantity), group, key, quantity)
    single = rest.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias(key), F.min("difference").alias("difference")).where("n = 1").drop("n")
    rows = right.join(single, [group, key])
    alone = rows.groupBy(group).agg(F.count(F.lit(1)).alias("hits")).where("hits = 1").select(group)
    return rows.join(alone, group).select(F.col(row).alias("row_id"), F.col(quantity).alias("old_value"), (F.col(quantity) + F.col("difference")).alias("new_value"))


def inferred_moments(parents: DataFrame, key: str, targets: list[str], children: DataFrame, foreign: str, fields: list[str], confidence: float = CONFIDENCE) -> DataFrame:
    """(kind, output, value, weight, support, decided): parents' numbers that nearly always are a mean, a weighted mean or a
    population variance of their children's fields.  Only targets whose names say so are tried, all pairs of fields at once;
    numbers are compared by cross-multiplication."""
    means = [t for t in targets if any(w in t.lower() for w in ("mean", "average", "avg"))]
    spreads = [t for t in targets if "var" in t.lower()]
    whole = {f.name for f in children.schema if isinstance(f.dataType, T.IntegralType)}

    def product(f: str, w: str) -> Column:  # of whole numbers as one of 64 bits, which is many times cheaper, unless it is longer
        short = F.try_multiply(F.col(f).cast("bigint"), F.col(w).cast("bigint")).cast(DEC)
        return F.coalesce(short, times(exact(f), exact(w))) if {f, w} <= whole else times(exact(f), exact(w))

    aggs = [F.count(F.lit(1)).cast(DEC).alias("n")]
    for f in fields:
        aggs += [exact_sum(exact(f)).alias(f"s_{f}"), exact_sum(product(f, f)).alias(f"q_{f}")]
        aggs += [exact_sum(product(*sorted((f, w)))).alias(f"x_{f}_{w}") for w in fields if w != f]
    rows = parents.join(children.groupBy(F.col(foreign).alias(key)).agg(*aggs), key)
    tests = []
    for t in means:
        for f in fields:
            tests.append(("mean", t, f, None, times(exact(t), F.col("n")) == F.col(f"s_{f}")))
            tests += [("weighted_mean", t, f, w, times(exact(t), F.col(f"s_{w}")) == F.col(f"x_{f}_{w}")) for w in fields if w != f]
    for t in spreads:
        tests += [("variance", t, f, None, times(exact(t), times(F.col("n"), F.col("n"))) == minus(times(F.col("n"), F.col(f"q_{f}")), times(F.col(f"s_{f}"), F.col(f"s_{f}")))) for f in fields]
    counts = [x for i, test in enumerate(tests) for x in (F.count(F.when(test[4], 1)).alias(f"s{i}"), F.count(exact(test[1])).alias(f"d{i}"))]
    items = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(t).alias("output"), F.lit(f).alias("value"), F.lit(w).cast("string").alias("weight"), F.col(f"s{i}").alias("support"), F.col(f"d{i}").alias("decided")) for i, (k, t, f, w, _) in enumerate(tests)))
    return rows.agg(*counts).select(F.explode(items).alias("f")).select("f.*").where(f"decided >= {MIN_SUPPORT} and support / decided >= {confidence}")


def lowest_terms(numerator: Column, denominator: Column) -> Column:
    """struct(num, den) of two integers without a common factor, the denominator positive: Euclid's remainders, of which 64-bit
    integers need fewer than 93 and mostly a dozen."""
    from ..functions import let

    n, d = numerator.cast("bigint"), denominator.cast("bigint")
    start = F.struct(F.abs(n).alias("a"), F.abs(d).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], s["b"]).alias("b")))
    factor = F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: F.greatest(s["a"], F.lit(1).cast("bigint")))
    sign = F.when(d < 0, -1).otherwise(1)
    return F.when(d != 0, let({"n": n, "d": d, "g": factor}, lambda v: F.struct(F.call_function("div", sign * v["n"], v["g"]).alias("num"), F.call_function("div", F.abs(v["d"]), v["g"]).alias("den"))))


def moments(children: DataFrame, group: str, value: Column, weight: Column | None = None, other: Column | None = None, ddof: int = 0) -> DataFrame:
    """Exact moments of each group from power sums: weighted sum and mean, variance, covariance, total of the weights.  The
    quotients are exact rationals, kept as numerator and denominator; a zero weight or too few rows give null."""
    w = F.lit(1).cast("decimal(19,4)") if weight is None else weight.cast("decimal(19,4)")
    x = value.cast("decimal(19,4)")
    y = x if other is None else other.cast("decimal(19,4)")
    sums = children.groupBy(F.col(group).alias("row_id")).agg(
        F.sum(w).alias("w"), F.sum((w * x).cast("decimal(28,8)")).alias("wx"), F.count(x).alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum((x * y).cast("decimal(28,8)")).alias("xy"),
    )
    return sums.select(
        "row_id", F.col("wx").cast(DEC).alias("weighted_sum"),
        F.col("wx").cast("decimal(38,8)").alias("mean_num"), F.when(F.col("w") != 0, F.col("w")).cast("decimal(38,4)").alias("mean_den"),
        (F.col("n") * F.col("xy") - (F.col("x") * F.col("y")).cast("decimal(38,8)")).cast("decimal(38,8)").alias("cov_num"), F.when(F.col("n") > ddof, F.col("n") * (F.col("n") - ddof)).alias("cov_den"),
    )


def check_mean(found: DataFrame, made: DataFrame) -> DataFrame:
    """found: (row_id, value).  Rows whose value isn't the weighted mean: compared by cross-multiplication, so nothing is
    rounded; the candidate is given where the mean has a finite expansion of nine places."""
    joined = found.join(made, "row_id").where("mean_den is not null")
    num, den, value = exact("mean_num"), exact("mean_den"), exact("value")
    holds = F.coalesce(times(value, den) == num, F.lit(False))
    return joined.where(~holds | F.col("value").isNull()).select("row_id", F.lit("weighted_mean_violation").alias("code"), value.alias("old_value"), over(num, den).alias("new_value"))


def unit_normalise(df: DataFrame, key: str, value: str, unit: str, table: DataFrame) -> DataFrame:
    """table: (unit, scale, offset, base).  Rows in another unit than the base, with both new values as one edit."""
    joined = df.select(F.col(key).alias("row_id"), exact(value).alias("old_value"), F.col(unit).alias("unit")).join(F.broadcast(table), "unit")
    return joined.where("unit <> base").select("row_id", "old_value", F.col("unit").alias("old_unit"), plus(times(F.col("old_value"), exact("scale")), exact("offset")).alias("new_value"), F.col("base").alias("new_unit"))
