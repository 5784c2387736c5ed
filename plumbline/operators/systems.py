"""Graphs, state machines and ordered migrations."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def graph_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, item): duplicate nodes, malformed edges, edges to nodes that don't exist.  nodes(id), edges(src, dst)."""
    text = lambda c: F.col(c).cast("string")
    twice = nodes.groupBy(text("id").alias("item")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_node_identity").alias("code"), "item")
    pair = F.concat(F.coalesce(text("src"), F.lit("?")), F.lit(">"), F.coalesce(text("dst"), F.lit("?")))
    bad = edges.where("src is null or dst is null").select(F.lit("malformed_edge").alias("code"), pair.alias("item"))
    whole = edges.where("src is not null and dst is not null")
    ids = nodes.select("id").distinct()
    lost = whole.join(ids, whole["dst"] == ids["id"], "left_anti").unionByName(whole.join(ids, whole["src"] == ids["id"], "left_anti")).distinct()
    return twice.unionByName(bad).unionByName(lost.select(F.lit("dangling_edge").alias("code"), pair.alias("item")))


def reachable(edges: DataFrame, roots: DataFrame, checkpoint, most: int = 1000) -> DataFrame:
    """(id) of nodes reachable from roots(id): frontiers, each written before the next is made.  checkpoint: takes a
    DataFrame and a name and returns it with its lineage cut.  A path of more than ``most`` edges raises."""
    seen = checkpoint(roots.select("id").distinct(), "frontier-0")
    frontier = seen
    for step in range(1, most + 2):
        nxt = edges.join(frontier, edges["src"] == frontier["id"]).select(F.col("dst").alias("id")).distinct()
        frontier = checkpoint(nxt.join(seen, "id", "left_anti"), f"frontier-{step}")
        if frontier.isEmpty():
            return seen
        seen = checkpoint(seen.unionByName(frontier), f"seen-{step}")
    raise RuntimeError(f"paths of more than {most} edges")


def components(edges: DataFrame, checkpoint, most: int = 200) -> DataFrame:
    """(node, root): connected components of the undirected edges (a, b), root the smallest node.  Rounds of grouped minima:
    a node's neighbours move to its smallest one, so paths halve and the number of rounds grows with their logarithm."""
    now = checkpoint(edges.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").where("a <> b").distinct(), "edges-0")
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 40)))).first())
    before = state(now)
    for step in range(1, most):
        both = now.select("a", "b").unionByName(now.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        large = both.join(least, "a").where("b > a").selectExpr("b AS a", "m AS b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").selectExpr("b AS a", "m AS b").unionByName(low.selectExpr("a", "m AS b"))
        now = checkpoint(small.where("a <> b").distinct(), f"edges-{step}")
        if (after := state(now)) == before:
            return now.selectExpr("a AS node", "b AS root").unionByName(now.selectExpr("b AS node", "b AS root").distinct())
        before = after
    raise RuntimeError(f"components did not settle in {most} rounds")


def topological_levels(nodes: DataFrame, edges: DataFrame, checkpoint, most: int = 1000) -> DataFrame:
    """(id, level): nodes peeled off as soon as nothing unpeeled leads to them; nodes of cycles, and behind them, are left out.
    More than ``most`` levels raise."""
    done, left = None, checkpoint(nodes.select("id").distinct(), "left-0")
    alive = edges
    for level in range(most + 1):
        ready = checkpoint(left.join(alive.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level)), f"ready-{level}")
        if ready.isEmpty():
            break
        if level == most:
            raise RuntimeError(f"more than {most} levels")
        done = ready if done is None else done.unionByName(ready)
        left = checkpoint(left.join(ready.select("id"), "id", "left_anti"), f"left-{level + 1}")
        alive = checkpoint(alive.join(ready.select(F.col("id").alias("src")), "src", "left_anti"), f"alive-{level + 1}")
    return done if done is not None else nodes.select("id", F.lit(0).alias("level")).limit(0)


def graph_structure(nodes: DataFrame, edges: DataFrame, roots: DataFrame, checkpoint) -> DataFrame:
    """(code, item): nodes on a cycle or behind one (graph_cycle) and nodes that no root leads to (unreachable_nodes).  Edges to
    nodes that don't exist take no part."""
    ids = nodes.select(F.col("id")).distinct()
    whole = edges.where("src is not null and dst is not null").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    levels = topological_levels(ids, whole, checkpoint)
    stuck = ids.join(levels.select("id"), "id", "left_anti").select(F.lit("graph_cycle").alias("code"), F.col("id").cast("string").alias("item"))
    seen = reachable(whole, roots, lambda df, name: checkpoint(df, f"seen-{name}"))
    lost = ids.join(seen, "id", "left_anti").select(F.lit("unreachable_nodes").alias("code"), F.col("id").cast("string").alias("item"))
    return stuck.unionByName(lost)


def order_repairs(rows: DataFrame, edges: DataFrame, checkpoint) -> DataFrame:
    """(row_id, code, old_value, new_value): nodes (id, position) that stand before one that leads to them.  If the graph orders
    all nodes in one way only, the place that it gives is the repair; else the order is ambiguous."""
    at = rows.select("id", F.col("position").cast("long").alias("position"))
    pairs = edges.join(at.select(F.col("id").alias("src"), F.col("position").alias("a")), "src").join(at.select(F.col("id").alias("dst"), F.col("position").alias("b")), "dst")
    wrong = pairs.where("a >= b")
    levels = topological_levels(rows.select("id"), edges, checkpoint)
    one_way = levels.groupBy("level").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") == 1).alias("one"), F.sum("n").alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("rows"))
    gate = one_way.join(total).select((F.col("one") & (F.col("n") == F.col("rows"))).alias("unique"))
    misplaced = at.join(levels, "id").where("position <> level").join(F.broadcast(gate))
    broken = F.lit(not wrong.isEmpty())
    code = F.when(F.col("unique"), "topological_order_violation").otherwise("topological_order_ambiguous")
    return misplaced.where(broken).select(F.col("id").alias("row_id"), code.alias("code"), F.col("position").alias("old_value"), F.when(F.col("unique"), F.col("level").cast("long")).alias("new_value"))


def reciprocal_repairs(edges: DataFrame) -> DataFrame:
    """(src, dst, code) of edges that symmetry asks for: repairable if it is the only one missing."""
    lost = missing_reciprocal(edges)
    n = lost.agg(F.count(F.lit(1)).alias("n"))
    return lost.join(F.broadcast(n)).select("src", "dst", F.when(F.col("n") == 1, "missing_reciprocal_edge").otherwise("multiple_reciprocal_edges_missing").alias("code"))


def missing_reciprocal(edges: DataFrame) -> DataFrame:
    """(src, dst) of the edges that symmetry asks for and that aren't there."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).where("src <> dst").distinct()
    return back.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def state_issues(rows: DataFrame, machine: str, ordinal: str, state: str, transitions: list[tuple[str, str]], initial: list[str]) -> DataFrame:
    """(machine, row_id, code, old_value, new_value): states that the one before can't lead to.  A state is repaired if
    exactly one fits both neighbours, an initial one if exactly one initial state leads to the next."""
    order = Window.partitionBy(machine).orderBy(ordinal)
    at = rows.select(F.col(machine).alias("machine"), F.col(ordinal).alias("row_id"), F.col(state).alias("s"), F.lag(state).over(order).alias("before"), F.lead(state).over(order).alias("after"))
    allowed = sorted(set(transitions))
    array = F.array(*(F.lit(f"{a}>{b}") for a, b in allowed))
    ok = lambda a, b: F.array_contains(array, F.concat(a, F.lit(">"), b))
    states = F.array(*(F.lit(x) for x in sorted({x for t in allowed for x in t} | set(initial))))
    first = F.col("before").isNull()
    wrong = F.when(first, ~F.col("s").isin(initial)).otherwise(~ok(F.col("before"), F.col("s")))
    # A faulty state breaks the transition into it and the one out of it: it is reported where both are.
    out_broken = F.col("after").isNull() | ~ok(F.col("s"), F.col("after"))
    options = F.filter(states, lambda x: F.when(first, x.isin(initial)).otherwise(ok(F.col("before"), x)) & (F.col("after").isNull() | ok(x, F.col("after"))))
    code = F.when(first, "initial_state_violation").when(F.col("after").isNull(), "terminal_transition_violation").otherwise("invalid_transition_state")
    found = at.where(wrong & out_broken).withColumn("o", options)
    return found.select("machine", "row_id", code.alias("code"), F.col("s").alias("old_value"), F.when(F.size("o") == 1, F.get("o", F.lit(0))).alias("new_value"))


def shortest_path(transitions: list[tuple[str, str]], start: str, goal: str) -> list[str] | None:
    frontier, seen = [[start]], {start}
    while frontier:
        path = frontier.pop(0)
        if path[-1] == goal:
            return path
        for a, b in sorted(set(transitions)):
            if a == path[-1] and b not in seen:
                seen.add(b)
                frontier.append([*path, b])
    return None


def plan_migration(steps: dict[str, dict], needs: dict[str, list[str]]) -> list[str] | None:
    """An order of steps that respects needs, or None if there is none, or if two steps that nothing orders touch the same
    field.  A step has ``rename`` (old, new), ``drop`` or ``set`` (field, value)."""
    order: list[str] = []
    while len(order) < len(steps):
        ready = sorted(s for s in steps if s not in order and all(n in order for n in needs.get(s, [])))
        if not ready:
            return None
        order.append(ready[0])
    before = {s: set() for s in steps}
    for s in order:
        for n in needs.get(s, []):
            before[s] |= {n} | before[n]
    touched = {s: {x for k in ("rename", "drop", "set") for x in ([step[k]] if isinstance(step.get(k), str) else list(step.get(k, ()))[: 2 if k == "rename" else 1])} for s, step in steps.items()}
    for a, b in permutations(steps, 2):
        if a < b and a not in before[b] and b not in before[a] and touched[a] & touched[b]:
            return None
    return order


def migrate(df: DataFrame, steps: dict[str, dict], order: list[str]) -> DataFrame:
    for name in order:
        step = steps[name]
        if "rename" in step:
            df = df.withColumnRenamed(*step["rename"])
        if "drop" in step:
            df = df.drop(step["drop"])
        if "set" in step:
            field, expression = step["set"]
            df = df.withColumn(field, F.expr(expression))
    return df


def migration_status(df: DataFrame, steps: dict[str, dict], needs: dict[str, list[str]], target: list[str]) -> tuple[str, list[str]]:
    """(status, plan) of an ordered migration to a table with the target's columns.  AT_TARGET: it has them.  A plan is whole
    or nothing: migration_steps_missing, migration_dependency_error (a step needs an unknown one, or they need each other in
    a circle), migration_order_underspecified (two steps in no order touch one field), migration_precondition_failed (a step
    would rename, drop or read a field that isn't there, or the plan doesn't end at the target), else migration_available."""
    import ast

    if sorted(df.columns) == sorted(target):
        return "AT_TARGET", []
    if not steps:
        return "migration_steps_missing", []
    if any(n not in steps for own in needs.values() for n in own):
        return "migration_dependency_error", []
    from graphlib import CycleError, TopologicalSorter

    try:
        TopologicalSorter({s: needs.get(s, []) for s in steps}).prepare()
    except CycleError:
        return "migration_dependency_error", []
    order = plan_migration(steps, needs)
    if order is None:
        return "migration_order_underspecified", []
    have = set(df.columns)
    for name in order:
        step = steps[name]
        reads = {n.id for n in ast.walk(ast.parse(step["set"][1], mode="eval")) if isinstance(n, ast.Name)} if "set" in step else set()
        if "rename" in step and (step["rename"][0] not in have or step["rename"][1] in have) or "drop" in step and step["drop"] not in have or not reads <= have:
            return "migration_precondition_failed", []
        if "rename" in step:
            have = have - {step["rename"][0]} | {step["rename"][1]}
        have -= {step["drop"]} if "drop" in step else set()
        have |= {step["set"][0]} if "set" in step else set()
    return ("migration_available", order) if sorted(have) == sorted(target) else ("migration_precondition_failed", [])
