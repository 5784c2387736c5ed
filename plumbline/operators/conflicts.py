"""Conflicts between candidates: blocks, least transfers, critical pairs, routes, symmetry, dominance, cones.

Options are rows (row_id, option_id, path, value, ...): a repair that sets some paths of a row.  Paths are JSON Pointers; one
path lies over another if it is the same or above it.  Rows are independent of each other, so all of this is grouped or
joined by row.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import tasks
from . import repair as rp
from .repair import CELL
from .systems import components

#: Options of a block among which the least transfer is searched, and most that it may take.
MOST_OPTIONS, MOST_TAKEN = 8, 4


def prefixes(path: Column) -> Column:
    """A pointer and all pointers above it, the whole document included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))


def overlaps(options: DataFrame) -> DataFrame:
    """(row_id, a, b, path_a, path_b, value_a, value_b): pairs of options of a row of which a path of the first lies over one
    of the second; two options that set one path come once, by their ids.

    Each path looks for its own above it, so the pairs are found by an equality join, not by comparing all."""
    own = options.select("row_id", F.col("option_id").alias("a"), F.col("path").alias("path_a"), F.col("value").alias("value_a"), F.col("path").alias("at"))
    below = options.select("row_id", F.col("option_id").alias("b"), F.col("path").alias("path_b"), F.col("value").alias("value_b"), F.explode(prefixes(F.col("path"))).alias("at"))
    return own.join(below, ["row_id", "at"]).where("a <> b and (path_a <> path_b or a < b)").drop("at")


def blocks(options: DataFrame, checkpoint) -> DataFrame:
    """(row_id, option_id, block): options of a row that overlap, directly or through others, are one block, named by its
    smallest option.  Blocks are independent: what is decided in one says nothing about another."""
    key = lambda o: F.concat_ws("\x1f", F.col("row_id").cast("string"), F.col(o).cast("string"))
    edges = overlaps(options).select(key("a").alias("a"), key("b").alias("b"))
    found = components(edges, checkpoint)
    named = options.select("row_id", "option_id", key("option_id").alias("node")).distinct().join(found, "node", "left")
    return named.select("row_id", "option_id", F.coalesce(F.substring_index("root", "\x1f", -1), F.col("option_id").cast("string")).alias("block"))


def least_transfer(options: DataFrame) -> DataFrame:
    """(row_id, block, taken, resolved, status): of each block the options to take.  options: (row_id, block, option_id, path,
    value, resolves array, cost), a row for each path.

    Of all sets of up to MOST_TAKEN options that set no path twice, nor one below another, the one that resolves most counts, then
    the cheapest, then the one with fewest paths.  Two sets as good that set different values abstain.  A block of more than
    MOST_OPTIONS options is left open, not searched in part.  Blocks are independent, so their choices together are the
    choice for the whole."""
    by_option = options.groupBy("row_id", "block", "option_id").agg(F.array_sort(F.collect_list(F.struct("path", "value"))).alias("sets"), F.max("cost").alias("cost"), F.array_sort(F.flatten(F.collect_set("resolves"))).alias("resolves"))
    by_block = by_option.groupBy("row_id", "block").agg(F.array_sort(F.collect_list(F.struct("option_id", "sets", "cost", "resolves"))).alias("all"))

    @F.pandas_udf("struct<taken:array<string>,resolved:long,status:string>")
    def choose(blocks_: pd.Series) -> pd.DataFrame:
        out = []
        for own in blocks_:
            own = [(str(o["option_id"]), {(s["path"], s["value"]) for s in o["sets"]}, float(o["cost"]), set(o["resolves"])) for o in own]
            if len(own) > MOST_OPTIONS:
                out.append(([], 0, "OPEN"))
                continue
            best, found = None, []
            for n in range(1, MOST_TAKEN + 1):
                for some in itertools.combinations(own, n):
                    sets = set().union(*(o[1] for o in some))
                    paths = sorted(p for p, _ in sets)
                    if any(a == b or b.startswith(a + "/") for a, b in itertools.combinations(paths, 2)):
                        continue
                    metric = (-len(set().union(*(o[3] for o in some))), sum(o[2] for o in some), len(sets))
                    if best is None or metric < best:
                        best, found = metric, []
                    if metric == best:
                        found.append(([o[0] for o in some], frozenset(sets)))
            if best is None or not best[0]:
                out.append(([], 0, "NONE"))
            elif len({s for _, s in found}) > 1:
                out.append(([], -best[0], "TIE"))
            else:
                out.append((min(t for t, _ in found), -best[0], "UNIQUE"))
        return pd.DataFrame(out, columns=["taken", "resolved", "status"])

    return by_block.select("row_id", "block", choose("all").alias("c")).select("row_id", "block", "c.*")


def critical_pairs(options: DataFrame) -> DataFrame:
    """(row_id, a, b, path_a, path_b, joinable): pairs of options that touch the same place, and whether both orders end in
    one document: equal values at one path, or a container that already holds what the other sets below it."""
    below = F.substr("path_b", F.length("path_a") + 1)
    inside = F.when(F.col("path_a") == F.col("path_b"), F.col("value_a") == F.col("value_b")).otherwise(F.coalesce(F.try_variant_get(F.try_parse_json("value_a"), F.lit("$"), "variant").isNotNull() & (_at(F.col("value_a"), below) == F.col("value_b")), F.lit(False)))
    return overlaps(options).withColumn("joinable", inside).select("row_id", "a", "b", "path_a", "path_b", "joinable")


def _at(raw: Column, pointer: Column) -> Column:
    from .patches import get_at

    return get_at(raw, pointer)


def confluent(options: DataFrame) -> DataFrame:
    """(row_id, pairs, joinable): a row whose critical pairs all join ends in one document whatever the order."""
    return critical_pairs(options).groupBy("row_id").agg(F.count(F.lit(1)).alias("pairs"), F.bool_and("joinable").alias("joinable"))


def routes(df: DataFrame, key: str, fields: list[str], orders: dict[str, list[Callable[[DataFrame], DataFrame]]], checkpoint, cycles: int = 8) -> DataFrame:
    """(route, status, digest, cycles): every route run to its end.  A route is an order of analyses: each cycle applies the
    first of them that finds unique repairs.  Repairs are accepted only if all routes end in one table (see ``agreed``)."""
    rows = []
    for name, analyses in orders.items():
        now, done, status = df, 0, "OPEN_REPAIRABLE"
        for cycle in range(cycles):
            for number, analyze in enumerate(analyses):
                patches = checkpoint(rp.select_unique(rp.authority(analyze(now))[0]).select(*CELL, "old_value", "new_value"), f"{name}-{cycle}-{number}")
                if not patches.isEmpty():
                    now, done = checkpoint(rp.apply_patches(now, key, patches, fields), f"{name}-table-{cycle}"), done + 1
                    break
            else:
                status = "PASS"
                break
        n, total, odd = rp.digest(now)
        rows.append((name, status, f"{n}:{total}:{odd}", done))
    return df.sparkSession.createDataFrame(rows, "route string, status string, digest string, cycles int")


def agreed(found: DataFrame) -> DataFrame:
    """(routes, terminals, accepted) of what ``routes`` found."""
    return found.agg(F.count(F.lit(1)).alias("routes"), F.count_distinct("digest").alias("terminals"), ((F.count_distinct("digest") == 1) & F.bool_and(F.col("status") == "PASS")).alias("accepted"))


def symmetric(options: DataFrame, members: DataFrame) -> DataFrame:
    """(row_id, array_path, options): choices that differ only by which of several equal members of an array they touch.  No
    evidence tells such members apart, so the choice is blocked.  options: (row_id, option_id, array_path, position);
    members: (row_id, array_path, position, member)."""
    n = tasks(members.sparkSession, members.count())
    there = "row_id is not null and array_path is not null and position is not null"
    # One column each: of several, a constant one would be taken out of the join's keys and all rows dealt again.
    place = F.struct("row_id", "array_path", "position").alias("place")
    same = F.when(F.length("member") > 64, F.concat(F.lit("#"), F.sha2("member", 256))).otherwise(F.concat(F.lit("="), "member"))
    touched = options.where(there).select(place, "option_id").repartition(n, "place").join(members.where(there).select(place, same.alias("same")).repartition(n, "place"), "place")
    equal = touched.select(F.struct("place.row_id", "place.array_path", "same").alias("equal"), "place.position", "option_id").repartition(n, "equal")
    tied = equal.groupBy("equal").agg((F.min("position") < F.max("position")).alias("several"), F.count_distinct("option_id").alias("options")).where("several and options > 1")
    return tied.groupBy("equal.row_id", "equal.array_path").agg(F.sum("options").alias("options"))


def resolved_sets(df: DataFrame, key: str, candidates: DataFrame, rules: dict[str, Column], fields: list[str]) -> DataFrame:
    """(row_id, option_id, resolved, introduced): which rules a candidate (row_id, option_id, field, new_value) mends and which
    it breaks, by evaluating all of them on the row as it is and as the candidate would make it.  Rules are conditions of a
    row; null is unknown and counts as kept."""
    names = F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit(True)).alias("ok")) for n, c in rules.items()))
    joined = df.withColumn("_before", names).join(candidates.withColumnRenamed("row_id", "_row"), F.col(key) == F.col("_row"))
    changed = joined.withColumns({f: F.when(F.col("field") == f, F.col("new_value").try_cast(df.schema[f].dataType)).otherwise(F.col(f)) for f in fields})
    both = F.zip_with("_before", names, lambda a, b: F.struct(a["name"].alias("name"), a["ok"].alias("a"), b["ok"].alias("b")))
    pick = lambda a, b: F.array_sort(F.transform(F.filter("_both", lambda x: (x["a"] == a) & (x["b"] == b)), lambda x: x["name"]))
    return changed.withColumn("_both", both).select(F.col("_row").alias("row_id"), "option_id", pick(False, True).alias("resolved"), pick(True, False).alias("introduced"))


def dominated(found: DataFrame) -> DataFrame:
    """Candidates (row_id, option_id, resolved, introduced) that resolve a strict subset of what another of their row does
    without breaking anything that they keep."""
    by_row = found.groupBy("row_id").agg(F.collect_list(F.struct("option_id", "resolved", "introduced")).alias("all"))  # of one row: a few
    mine = by_row.select("row_id", "all", F.explode("all").alias("c"))
    none = lambda a, b: F.size(F.array_except(a, b)) == 0
    better = F.exists("all", lambda o: none(F.col("c.resolved"), o["resolved"]) & ~none(o["resolved"], F.col("c.resolved")) & none(o["introduced"], F.col("c.introduced")))
    return mine.where(better).select("row_id", "c.option_id")


def closure(edges: DataFrame, checkpoint, most: int = 32) -> DataFrame:
    """(src, dst): all pairs that a path of directed edges (src, dst) joins, by doubling: each round joins paths with paths, so
    their number grows with the logarithm of the longest.  The edges are those of a graph of fields, not of rows."""
    paths = checkpoint(edges.select("src", "dst").distinct(), "paths-0")
    n = paths.count()
    for step in range(1, most):
        longer = paths.alias("a").join(paths.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        paths = checkpoint(paths.unionByName(longer).distinct(), f"paths-{step}")
        if (m := paths.count()) == n:
            return paths
        n = m
    raise RuntimeError(f"paths did not close in {most} rounds")


def cones(relations: DataFrame, checkpoint) -> DataFrame:
    """(field, backward, forward): for each field of relations (inputs array, output) the fields that it depends on, and those
    that depend on it."""
    edges = relations.select(F.explode("inputs").alias("src"), F.col("output").alias("dst")).where("src <> dst")
    pairs = closure(edges, checkpoint)
    fields = edges.select(F.col("src").alias("field")).unionByName(edges.select(F.col("dst").alias("field"))).distinct()
    up = pairs.groupBy(F.col("dst").alias("field")).agg(F.array_sort(F.collect_set("src")).alias("backward"))
    down = pairs.groupBy(F.col("src").alias("field")).agg(F.array_sort(F.collect_set("dst")).alias("forward"))
    empty = F.array().cast("array<string>")
    return fields.join(up, "field", "left").join(down, "field", "left").select("field", F.coalesce("backward", empty).alias("backward"), F.coalesce("forward", empty).alias("forward"))


def debt(issues: DataFrame, candidates: DataFrame) -> DataFrame:
    """(errors, warnings, cells, open): what is left to mend, in the order in which it counts: issues (row_id, field, code,
    severity) by severity, cells that have one, and of those the ones without a unique candidate."""
    cells = issues.select(*CELL).distinct()
    unique = rp.select_unique(candidates).select(*CELL)
    kinds = issues.agg(F.count(F.when(F.col("severity") == "error", 1)).alias("errors"), F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings"))
    left = cells.agg(F.count(F.lit(1)).alias("cells")).join(cells.join(unique, CELL, "left_anti").agg(F.count(F.lit(1)).alias("open")))
    return kinds.join(left)


def descends(before: DataFrame, after: DataFrame) -> DataFrame:
    """(descends): whether the debt after a step is smaller, compared in order."""
    own = F.struct("errors", "warnings", "cells", "open")
    return after.select(own.alias("a")).join(before.select(own.alias("b"))).select((F.col("a") < F.col("b")).alias("descends"))
