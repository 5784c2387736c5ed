"""Exact arithmetic between fields, balances, sequences and time offsets."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import exact, minus, over, plus, times

CONFIDENCE, MIN_SUPPORT, DIRECTION, SEQUENTIAL = 0.95, 4, 0.90, 0.75
SPARSE_FLOOR, SPARSE_SUPPORT, SPARSE_MARGIN = 0.60, 4, 2
#: Conditional sums in one aggregation; more are spread over several passes, so that generated code stays small.
PER_PASS = 100


def formulas(fields: list[str]) -> list[tuple[str, str, str, str]]:
    """(target, a, op, b) over distinct fields; sums and products once."""
    out = []
    for target in sorted(fields):
        others = [f for f in sorted(fields) if f != target]
        for a, b in combinations(others, 2):
            out += [(target, a, "+", b), (target, a, "*", b), (target, a, "-", b), (target, b, "-", a), (target, a, "/", b), (target, b, "/", a)]
    return out


_VALUE = {"+": plus, "-": minus, "*": times, "/": over}


def value_of(a: str, op: str, b: str) -> Column:
    """The formula's exact value; null if it isn't defined or has more digits than DEC."""
    return _VALUE[op](exact(a), exact(b))


def holds(df: DataFrame, target: str, a: str, op: str, b: str) -> Column:
    """Whether a row's formula holds; null if it isn't decided.  Integral columns are compared as 64-bit integers (a
    quotient by multiplying back), which is several times faster than decimals; an overflow is undecided.  A product or
    quotient with more places than a number can have equals none."""
    integral = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if not all(isinstance(df.schema[c].dataType, integral) for c in (target, a, b)):
        t, x, y = exact(target), exact(a), exact(b)
        if op == "/":  # t = x / y as t * y = x
            t, x, y, op = x, t, F.when(y != 0, y), "*"
        known = t.isNotNull() & x.isNotNull() & y.isNotNull()
        made = _VALUE[op](x, y)
        fits = (F.abs(x.cast("double") * y.cast("double")) < 1e18) & (F.abs(x) < 10**18) & (F.abs(y) < 10**18)
        return F.when(known, F.coalesce(made == t, F.when(fits, F.lit(False)) if op == "*" else None) if op == "*" else made == t)
    t, x, y = (F.col(c).cast("bigint") for c in (target, a, b))
    if op == "/":
        return F.when(y != 0, F.try_multiply(t, y) == x)
    return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y) == t


def binary(df: DataFrame, fields: list[str], confidence: float = CONFIDENCE) -> DataFrame:
    """(target, a, op, b, support, decided, confidence) of formulas that hold nearly always: one pass, partial sums only."""
    found = None
    every = formulas(fields)
    for at in range(0, len(every), PER_PASS):
        part = every[at : at + PER_PASS]
        aggs = []
        for i, (target, a, op, b) in enumerate(part):
            held = holds(df, target, a, op, b)
            aggs += [F.count(F.when(held, 1)).alias(f"s{i}"), F.count(held).alias(f"d{i}")]
        items = F.array(*(F.struct(F.lit(t).alias("target"), F.lit(a).alias("a"), F.lit(op).alias("op"), F.lit(b).alias("b"), F.col(f"s{i}").alias("support"), F.col(f"d{i}").alias("decided")) for i, (t, a, op, b) in enumerate(part)))
        one = df.agg(*aggs).select(F.explode(items).alias("f")).select("f.*")
        found = one if found is None else found.unionByName(one)
    return found.where(f"decided >= {MIN_SUPPORT}").withColumn("confidence", F.col("support") / F.col("decided")).where(F.col("confidence") >= confidence)


def violations(df: DataFrame, key: str, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """(row_id, target, formula, code, old_value, new_value) of given formulas."""
    item = lambda t, a, op, b: F.struct(F.lit(t).alias("target"), F.lit(f"{a} {op} {b}").alias("formula"), exact(t).alias("old_value"), value_of(a, op, b).alias("new_value"))
    rows = df.select(F.col(key).alias("row_id"), F.explode(F.array(*(item(*r) for r in rules))).alias("f")).select("row_id", "f.*").where("new_value is not null and (old_value is null or old_value <> new_value)")
    return rows.withColumn("code", F.when(F.col("old_value").isNull(), "missing_exact_value").otherwise("exact_arithmetic_violation"))


def consensus(found: DataFrame) -> DataFrame:
    """Cells for which at least two formulas propose one value, and none another."""
    return found.groupBy("row_id", "target").agg(F.count_distinct("formula").alias("formulas"), F.count_distinct("new_value").alias("values"), F.min("new_value").alias("new_value")).where("formulas >= 2 and values = 1").select("row_id", "target", "formulas", "new_value")


def sparse(df: DataFrame, key: str, rule: tuple[str, str, str, str]) -> DataFrame:
    """Repairs of a formula that fails often, if its errors are all different: no systematic other relation explains them."""
    target, a, op, b = rule
    rows = df.select(F.col(key).alias("row_id"), exact(target).alias("old_value"), value_of(a, op, b).alias("new_value")).where("old_value is not null and new_value is not null").withColumn("residual", minus(F.col("old_value"), F.col("new_value")))
    by_residual = rows.groupBy("residual").agg(F.count(F.lit(1)).alias("n"))
    gate = by_residual.agg(F.sum("n").alias("n"), F.coalesce(F.max(F.when(F.col("residual") == 0, F.col("n"))), F.lit(0)).alias("support"), F.coalesce(F.max(F.when(F.col("residual") != 0, F.col("n"))), F.lit(0)).alias("most"))
    gate = gate.where(f"support / n >= {SPARSE_FLOOR} and support >= {SPARSE_SUPPORT} and most <= 1 and support - most >= {SPARSE_MARGIN}")
    return rows.where("residual <> 0").join(F.broadcast(gate.select("support"))).select("row_id", "old_value", "new_value")


def direction(keys: DataFrame, inputs: list[str], output: str) -> DataFrame:
    """keys: (keys array).  Share of rows whose key order puts the inputs before the output."""
    at = lambda k: F.array_position("keys", k)
    present = F.lit(True)
    before = F.lit(True)
    for i in inputs:
        present &= at(i) > 0
        before &= at(i) < at(output)
    rows = keys.where(present & (at(output) > 0))
    return rows.agg(F.count(F.lit(1)).alias("decided"), F.count(F.when(before, 1)).alias("before")).withColumn("directed", (F.col("decided") >= MIN_SUPPORT) & (F.col("before") >= DIRECTION * F.col("decided")))


def balances(df: DataFrame, fields: list[str], confidence: float = CONFIDENCE) -> DataFrame:
    """(left_side, right_side, support, decided): x1 + x2 = y1 + y2 over all groups of four fields (eight at most)."""
    sides = []
    for four in combinations(sorted(fields)[:8], 4):
        w = four[0]
        for x in four[1:]:
            y, z = (f for f in four[1:] if f != x)
            sides.append((w, x, y, z))
    aggs, items = [], []
    for i, (w, x, y, z) in enumerate(sides):
        left, right = plus(exact(w), exact(x)), plus(exact(y), exact(z))
        aggs += [F.count(F.when(left == right, 1)).alias(f"s{i}"), F.count(left == right).alias(f"d{i}"), (F.max(left) != F.min(left)).alias(f"v{i}")]
        items.append(F.struct(F.lit(f"{w}+{x}").alias("left_side"), F.lit(f"{y}+{z}").alias("right_side"), F.col(f"s{i}").alias("support"), F.col(f"d{i}").alias("decided"), F.col(f"v{i}").alias("varies")))
    return df.agg(*aggs).select(F.explode(F.array(*items)).alias("f")).select("f.*").where(f"varies and decided >= {MIN_SUPPORT} and support / decided >= {confidence}").drop("varies")


def sequence(df: DataFrame, ordinal: str, field: str, partition: str) -> DataFrame:
    """Interior values off a sequence whose neighbours agree on them.  The step of a partition is the modal difference of
    neighbours; each faulty cell disrupts two."""
    order = Window.partitionBy(partition).orderBy(ordinal)
    rows = df.select(F.col(partition).alias("part"), F.col(ordinal).alias("row_id"), F.col(field).alias("v"), F.lag(field).over(order).alias("before"), F.lead(field).over(order).alias("after"))
    steps = rows.where("v is not null and before is not null").groupBy("part", (F.col("v") - F.col("before")).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    by_part = Window.partitionBy("part")
    best = steps.withColumns({"total": F.sum("n").over(by_part), "r": F.row_number().over(by_part.orderBy(F.desc("n"), "step"))}).where("r = 1 and step <> 0")
    best = best.withColumn("confidence", F.col("n") / (F.col("n") + F.ceil((F.col("total") - F.col("n")) / 2))).where(F.col("confidence") >= SEQUENTIAL)
    joined = rows.join(best.select("part", "step"), "part")
    expected = F.col("before") + F.col("step")
    return joined.where((expected == F.col("after") - F.col("step")) & (F.col("v").isNull() | (F.col("v") != expected))).select("part", "row_id", F.when(F.col("v").isNull(), "missing_sequence_value").otherwise("sequence_violation").alias("code"), F.col("v").alias("old_value"), expected.alias("new_value"))


def time_offset(df: DataFrame, key: str, start: str, end: str, confidence: float = CONFIDENCE) -> DataFrame:
    """Rows whose end isn't start plus the modal offset, with the end that is."""
    rows = df.select(F.col(key).alias("row_id"), F.col(start).alias("start"), F.col(end).alias("end"), F.expr(f"timestampdiff(SECOND, `{start}`, `{end}`)").alias("delta"))
    counts = rows.where("delta is not null").groupBy("delta").agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.max(F.struct("n", F.negative("delta").alias("last"))).alias("top"), F.sum("n").alias("total")).where(f"total >= {MIN_SUPPORT} and top.n / total >= {confidence} and top.last <= 0")
    joined = rows.join(F.broadcast(best.select(F.negative("top.last").alias("offset"))))
    return joined.where("start is not null and (delta is null or delta <> offset)").select("row_id", F.when(F.col("end").isNull(), "missing_temporal_endpoint").otherwise("temporal_delta_violation").alias("code"), (F.col("start") + F.make_dt_interval(secs=F.col("offset").cast("decimal(18,6)"))).alias("new_value"))
