"""Queries of declared laws: rule files, satisfiability, boundaries, expressions, conservation, moments, systems, functions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import functions as fn
from .. import sources as src
from ..operators import aggregates as agg
from ..operators import dependencies as dep
from ..operators import governance as gv
from ..operators import patches as pt
from ..operators import references as ref
from ..operators import rules as rl
from ..operators import schema as sc
from ..operators import systems as sy
from ..sources.shared import cutter, shared_folder
from .inputs import t, using, view


def _chain(spark, d, last):
    """Rules that lead from the first region to the last, and a last one about it."""
    keys = [r[0] for r in t(spark, d, "region").select("r_regionkey").orderBy("r_regionkey").collect()]  # five regions
    rules = [{"id": "start", "kind": "any_of", "of": [f"r{keys[0]}"]}] + [{"id": f"step{a}", "kind": "implies", "of": [f"r{a}"], "then": f"r{b}"} for a, b in zip(keys, keys[1:], strict=False)]
    return [*rules, {"id": "free", "kind": "exactly_one", "of": ["x", "y"]}, last(keys)]


def rule_sat(spark, d):
    """Rules made from a table that can't all hold; those that are needed for that."""
    rules = _chain(spark, d, lambda keys: {"id": "end", "kind": "not_both", "of": [f"r{keys[0]}", f"r{keys[-1]}"]})
    return spark.createDataFrame([(i,) for i in rl.conflicting_rules(rules)], "rule_id string")


def rule_sat_values(spark, d):
    """Two values of one field exclude each other without a rule that says so."""
    names = [r[0] for r in t(spark, d, "region").select("r_name").orderBy("r_name").limit(2).collect()]
    rules = [{"id": n, "kind": "any_of", "of": [{"field": "region", "equals": n}]} for n in names] + [{"id": "there", "kind": "any_of", "of": [{"field": "region", "present": True}]}]
    return spark.createDataFrame([(i,) for i in rl.conflicting_rules(rules)], "rule_id string")


def _flags(spark, d):
    return t(spark, d, "part").selectExpr("p_partkey AS id", "p_size > 25 AS a", "p_partkey % 3 = 0 AS b", "CASE WHEN p_partkey % 83 = 0 THEN NULL ELSE p_size > 40 END AS c", "p_brand AS brand")


_RULES = [
    {"id": "c needs a", "kind": "implies", "of": ["c"], "then": "a"}, {"id": "a or b", "kind": "any_of", "of": ["a", "b"]}, {"id": "not both", "kind": "not_both", "of": ["b", "c"]},
    {"id": "brand", "kind": "implies", "of": [{"field": "brand", "equals": "Brand#11"}], "then": "b"},
]


def logic_authoritative(spark, d):
    """Declared rules that can all hold, judged row by row."""
    return rl.authoritative(_flags(spark, d), "id", _RULES).select("row_id", "rule_id", "code")


def logic_unsat(spark, d):
    """Rules that can't all hold judge no row."""
    return rl.authoritative(_flags(spark, d), "id", [*_RULES, {"id": "all", "kind": "any_of", "of": ["a"]}, {"id": "none", "kind": "implies", "of": ["a"], "then": "z"}, {"id": "no z", "kind": "not_both", "of": ["a", "z"]}]).select("rule_id", "code")


def src_rule_files(spark, d):
    """Rules written to a file and read with their whitelist and limits."""
    path = shared_folder(spark) + "/rules.json"
    src.write_json(spark, [{"id": f"n{r[0]}", "kind": "implies", "of": [f"nation{r[0]}"], "then": f"region{r[1]}"} for r in t(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()], path)  # 25 nations
    rules = rl.load_rules(src.read_document(spark, path).first()["raw"])
    return spark.createDataFrame([(r["id"], r["kind"], r["then"]) for r in rules], "rule_id string, kind string, then string")


def src_sources_manifest(spark, d):
    """Context documents named by a manifest, each with its role and group."""
    folder = shared_folder(spark)
    n = t(spark, d, "nation")
    manifest = []
    for source_id, role, group, where in (("a", "defaults", "g1", "true"), ("b", "authoritative", "g2", "n_nationkey < 5"), ("c", "heldout", "g2", "n_regionkey = 1")):
        src.write_json(spark, [{"k": r[0]} for r in n.where(where).select("n_nationkey").collect()], f"{folder}/{source_id}.json")  # 25 nations
        manifest.append({"source_id": source_id, "role": role, "independent_group": group, "path": f"{source_id}.json"})
    src.write_json(spark, manifest, f"{folder}/manifest.json")
    return src.read_sources(spark, f"{folder}/manifest.json").groupBy("source_id", "role", "independent_group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.try_variant_get("value", "$.k", "long")).alias("total"))


def dsl_parse(spark, d):
    """Rules written from a table's columns and limits, parsed and evaluated."""
    top = t(spark, d, "part").agg(F.max("p_size").alias("m"), F.min("p_size").alias("n")).first()
    text = f"# limits\nsize maximum {top['m'] - 5}  # from the table\nsize minimum {top['n'] + 5}\nbrand pattern \"^Brand#[0-9]+$\"\nexpr total = a + b\nlinear 2 a + b - c = 0\nscope /parts"
    rules = rl.parse_rules(text)
    found = rl.evaluate(t(spark, d, "part").selectExpr("p_partkey AS id", "p_size AS size", "p_brand AS brand"), "id", rules.simple)
    return found.groupBy("field", "code").agg(F.count(F.lit(1)).alias("n"))


def boundary_project(spark, d):
    """Numbers under bounds: as they are, moved to the nearest, or without one nearest."""
    status, value = sc.boundary_status(F.col("x"), {"minimum": 6, "exclusiveMaximum": 40, "multipleOf": 4})
    return t(spark, d, "part").selectExpr("p_partkey AS id", "p_size AS x").select("id", status.alias("status"), value.alias("value"))


def boundary_registry(spark, d):
    """Bounds of a schema and of rules, made from the table, met path by path."""
    top = t(spark, d, "part").agg(F.max("p_size").alias("m"), F.min("p_size").alias("n")).first()
    schema = {"properties": {"size": {"type": "integer", "minimum": top["n"], "maximum": top["m"]}, "price": {"exclusiveMinimum": top["m"], "$ref": "#/$defs/p"}}, "$defs": {"p": {"maximum": top["m"]}}}
    rows = sc.boundary_registry(schema, rl.parse_rules(f"size maximum {top['m'] - 1}").simple)
    number = lambda x: None if x is None else float(x)
    return spark.createDataFrame([(r["path"], number(r.get("minimum")), number(r.get("maximum")), r["contradiction"]) for r in rows], "path string, low double, high double, contradiction boolean")


def expr_parse(spark, d):
    """Values, unknowns and domain errors of one expression."""
    df = t(spark, d, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size END AS a", "p_partkey % 4 AS b")
    text = "product(a, 2) / b + sqrt(b * b)"
    return df.select("id", rl.expression_status(text).alias("status"), rl.compile_expression(text).alias("value"))


def expr_solve(spark, d):
    """An equation solved for a field behind a product and a difference."""
    df = t(spark, d, "part").selectExpr("p_partkey AS id", "p_size AS size", "4 * p_size - 6 + CASE WHEN p_partkey % 113 = 0 THEN 1 ELSE 0 END AS y")
    return rl.expression_rule(df, "id", "2 * (2 * size - 3)", "y", target="size").select("row_id", "code", "new_value")


def _parents(spark, d):
    sums = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("c"))
    o = t(spark, d, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("q", F.lit(0)).alias("q"), F.coalesce("c", F.lit(0)).alias("c"))
    return o.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN q + 1 WHEN o_orderkey % 5 = 0 THEN NULL ELSE q END AS total", "CASE WHEN o_orderkey % 2 = 0 THEN c + 1 ELSE c END AS items")


def cons_aggregate_sum(spark, d):
    """A declared sum is repaired however often it is broken."""
    return agg.declared(_parents(spark, d), "o_orderkey", "total", t(spark, d, "lineitem"), "l_orderkey", "sum", F.col("l_quantity"))


def cons_aggregate_count(spark, d):
    return agg.declared(_parents(spark, d), "o_orderkey", "items", t(spark, d, "lineitem"), "l_orderkey", "count")


def _lists(spark, d):
    left = t(spark, d, "lineitem").selectExpr("l_orderkey AS g", "l_suppkey AS supplier", "l_partkey AS part", "CAST(l_quantity AS BIGINT) AS quantity", "l_orderkey * 10 + l_linenumber AS row")
    right = left.selectExpr("g", "supplier", "part", "quantity + CASE WHEN g % 101 = 0 AND row % 10 <= 2 THEN row % 10 ELSE 0 END AS quantity", "row")
    return left, right


def multiset_balance(spark, d):
    """By which key and quantity two lists hold the same."""
    left, right = _lists(spark, d)
    return agg.multisets(left, right, "g", [("supplier", "quantity"), ("part", "quantity"), ("supplier", "part")])


def cons_multiset(spark, d):
    """A declared list: a residue in one key that one row has is repaired, others are left."""
    left, right = _lists(spark, d)
    return agg.declared_multiset(left, right, "g", "supplier", "quantity", "row")


def mom_inferred(spark, d):
    """Which numbers of suppliers are a mean or a variance of their lines, found by trying all fields."""
    l = t(spark, d, "lineitem").selectExpr("l_suppkey AS s", "CAST(l_quantity AS BIGINT) AS quantity", "l_linenumber AS line")  # noqa: E741
    sums = l.groupBy("s").agg(F.sum(F.expr("quantity * line")).alias("x"), F.sum("line").alias("w"), F.sum("quantity").alias("q"), F.count(F.lit(1)).alias("n"), F.sum(F.expr("quantity * quantity")).alias("qq"))
    # Only suppliers whose quotients are finite decimals have the numbers; others have none.
    num = sums.select("s", fn.over(fn.exact("x"), fn.exact("w")).alias("weighted_avg"), fn.over(fn.exact("q"), fn.exact("n")).alias("mean_quantity"), fn.over(fn.exact(F.expr("n * qq - q * q")), fn.exact(F.expr("n * n"))).alias("var_quantity"))
    num = num.withColumn("mean_quantity", F.when(F.col("s") % 50 == 7, fn.plus(F.col("mean_quantity"), fn.decimal(1))).otherwise(F.col("mean_quantity")))
    return agg.inferred_moments(num, "s", ["weighted_avg", "mean_quantity", "var_quantity"], l, "s", ["quantity", "line"])


def agg_exact_rational(spark, d):
    """Mean prices as fractions in lowest terms."""
    sums = t(spark, d, "orders").groupBy("o_orderstatus").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint").alias("cents"), F.count(F.lit(1)).alias("n"))
    return sums.select("o_orderstatus", agg.lowest_terms(F.col("cents"), F.col("n") * 100).alias("r")).select("o_orderstatus", "r.num", "r.den")


# Systems.


def _graph(spark, d):
    n = t(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id")
    edges = t(spark, d, "nation").where("n_nationkey > 0").selectExpr("CAST(n_nationkey DIV 2 AS BIGINT) AS src", "CAST(n_nationkey AS BIGINT) AS dst").where("dst <> 12")
    return n, edges.unionByName(t(spark, d, "nation").where("n_nationkey = 20").selectExpr("CAST(20 AS BIGINT) AS src", "CAST(10 AS BIGINT) AS dst"))


def sys_cycle(spark, d):
    """Nodes on or behind a cycle, and those that no root leads to."""
    nodes, edges = _graph(spark, d)
    return sy.graph_structure(nodes, edges.where("dst > 0"), spark.range(1, 2), cutter(spark))


def sys_order(spark, d):
    """Places of nodes whose order the graph leaves no choice about."""
    rows = t(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "CASE n_nationkey WHEN 4 THEN 9 WHEN 9 THEN 4 ELSE n_nationkey END AS position")
    edges = t(spark, d, "nation").where("n_nationkey > 0").selectExpr("CAST(n_nationkey - 1 AS BIGINT) AS src", "CAST(n_nationkey AS BIGINT) AS dst")
    return sy.order_repairs(rows, edges, cutter(spark))


def sys_order_ambiguous(spark, d):
    """A graph that allows several orders repairs none."""
    nodes, edges = t(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "24 - n_nationkey AS position"), t(spark, d, "nation").where("n_nationkey > 0").selectExpr("CAST(0 AS BIGINT) AS src", "CAST(n_nationkey AS BIGINT) AS dst")
    return sy.order_repairs(nodes, edges, cutter(spark)).select("row_id", "code", "new_value")


def sys_reciprocal_repair(spark, d):
    """One missing edge is repaired, several aren't."""
    e = t(spark, d, "nation").selectExpr("n_nationkey AS src", "24 - n_nationkey AS dst")
    return sy.reciprocal_repairs(e.where("src <> 3")).unionByName(sy.reciprocal_repairs(e.where("src > 2")))


def sys_migration_status(spark, d):
    """What can be said of a migration before anything is changed."""
    df = t(spark, d, "part").select("p_partkey", "p_size", "p_type")
    steps = {"rename": {"rename": ("p_size", "size")}, "double": {"set": ("twice", "size * 2")}, "drop": {"drop": "p_type"}}
    cases = {
        "whole": (df, steps, {"double": ["rename"]}, ["p_partkey", "size", "twice"]), "there": (df, steps, {}, ["p_partkey", "p_size", "p_type"]), "none": (df, {}, {}, ["x"]), "unknown": (df, steps, {"double": ["lost"]}, ["x"]),
        "circle": (df, steps, {"double": ["rename"], "rename": ["double"]}, ["x"]), "either": (df, {"a": {"drop": "p_type"}, "b": {"drop": "p_type"}}, {}, ["p_partkey", "p_size"]), "early": (df, {"double": steps["double"]}, {}, ["p_partkey", "p_size", "p_type", "twice"]),
    }
    rows = [(name, *sy.migration_status(*case)) for name, case in cases.items()]
    return spark.createDataFrame([(n, s, ",".join(p)) for n, s, p in rows], "name string, status string, plan string")


# Windows, references, gates.


def win_duplicates(spark, d):
    """Every row of a repeated identifier, with its place among them."""
    w = Window.partitionBy("l_orderkey", "l_linenumber")
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").withColumn("occurrences", F.count(F.lit(1)).over(w))
    return rows.where("occurrences > 1")


def win_rotation(spark, d):
    """Agreement of a column with itself one, two and three rows later, as negative control of a dependency."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = t(spark, d, "orders").select("o_orderpriority", *(F.lead("o_orderpriority", k).over(w).alias(f"p{k}") for k in (1, 2, 3)))
    counts = [F.struct(F.lit(k).alias("shift"), F.col(f"p{k}").isNotNull().alias("there"), (F.col(f"p{k}") == F.col("o_orderpriority")).alias("same")) for k in (1, 2, 3)]
    return rows.select(F.explode(F.array(*counts)).alias("c")).where("c.there").groupBy("c.shift").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("c.same"), 1)).alias("equal"))


def score(spark, d):
    """One number for a table's issues: errors count 10, warnings 3, the rest 1."""
    issues = view(spark, d, "ord").selectExpr("CASE WHEN broken_customer <> customer_id THEN 'error' WHEN status = 'P' THEN 'warning' WHEN priority LIKE '1%' THEN 'information' END AS severity").where("severity is not null")
    weight = F.when(F.col("severity") == "error", 10).when(F.col("severity") == "warning", 3).otherwise(1)
    return issues.agg(F.sum(weight).alias("score"), F.count(F.lit(1)).alias("issues"))


def bundle_ambiguity(spark, d):
    """A reference that two registries hold equally well, and one that a single registry holds best."""
    n, c = t(spark, d, "nation"), t(spark, d, "customer")
    tie = {"a": (n, "n_nationkey"), "b": (n.where("n_nationkey >= 0"), "n_nationkey"), "c": (n.where("n_nationkey < 3"), "n_nationkey")}
    one = {"a": (n, "n_nationkey"), "c": (n.where("n_nationkey < 24"), "n_nationkey")}
    best = lambda registries, name: ref.best_registry(ref.overlaps(c, "c_nationkey", registries)).withColumn("bundle", F.lit(name))
    return best(tie, "tie").unionByName(best(one, "one"))


def fw_falsify(spark, d):
    """Candidates of relations that the falsifier refutes, or finds to need no determinant, are dropped."""
    df = view(spark, d, "cust").withColumn("constant", F.when(F.col("id") % 83 == 0, F.lit(None)).otherwise(F.lit("x")))
    pairs = [("nation", "region"), ("nation", "constant")]
    found = dep.functional(df, "id", [], pairs)[1]
    gate = dep.falsify(df, "id", pairs).where("status in ('ACTIVE_REFUTED', 'NEGATIVE_CONTROL_INVARIANT')").select("det", "target")
    return found.join(F.broadcast(gate), ["det", "target"], "left_anti").select("row_id", "target", "new_value")  # a row for each pair of fields


def fd_fields(spark, d):
    """Which fields dependencies are sought among, and which are left out beyond the limit."""
    names = [f"f{i:02d}" for i in range(14)]
    used, left = dep.fields_of(names)
    return t(spark, d, "region").limit(1).select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.lit(n in used).alias("used")) for n in [*used, *left]))).alias("f")).select("f.*")


# Scalar functions.


def fn_exact_equal(spark, d):
    df = t(spark, d, "part").selectExpr("p_partkey", "concat(p_size, '.000000001') AS a", "CASE p_partkey % 3 WHEN 0 THEN concat(p_size, '.0000000010') WHEN 1 THEN concat(p_size, '.0000000011') ELSE CAST(p_size AS STRING) END AS b")
    return df.select("p_partkey", fn.exact_equal("a", "b").alias("same"), fn.times(fn.exact("a"), fn.exact(F.lit("1000"))).alias("product"))


def fn_root(spark, d):
    df = t(spark, d, "part").selectExpr("p_partkey", "p_size")
    return df.select("p_partkey", fn.exact_root(fn.exact("p_size"), 2).alias("root"), fn.power(fn.exact("p_size"), 3).alias("cube"))


def fn_number_like(spark, d):
    df = t(spark, d, "part").selectExpr("p_partkey", "p_size", "CASE p_partkey % 3 WHEN 0 THEN '\"5\"' WHEN 1 THEN '2.5' ELSE '7' END AS example")
    return df.select("p_partkey", fn.canonical_number_like(fn.exact("p_size"), F.col("example")).alias("text"))


def fn_iso_like(spark, d):
    """Dates parsed, moved and written in the style of an example."""
    df = t(spark, d, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") WHEN 2 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') ELSE 'none' END AS x")
    moved = F.timestamp_seconds(fn.seconds("x") + 86400)
    return df.select("o_orderkey", fn.iso_like(moved, F.col("x")).alias("next"))


def fn_merkle(spark, d):
    """The root over a table's rows in order."""
    return fn.merkle_root(t(spark, d, "nation"), F.concat_ws("|", "n_nationkey", "n_name"), F.col("n_nationkey"))


def fn_deep_equal(spark, d):
    df = t(spark, d, "part").selectExpr("p_partkey", "concat('{\"a\":', p_size, ',\"b\":[true,null]}') AS x", "CASE p_partkey % 4 WHEN 0 THEN concat('{\"b\":[true,null],\"a\":', p_size, '.0}') WHEN 1 THEN concat('{\"a\":', p_size, ',\"b\":[1,null]}') WHEN 2 THEN concat('{\"a\":', p_size, ',\"b\":[null,true]}') ELSE concat('{\"a\":', p_size, ',\"b\":[true,null]}') END AS y")

    @F.pandas_udf("boolean")
    def same(a, b):
        import pandas as pd

        return pd.Series([pt.equal(json.loads(x), json.loads(y)) for x, y in zip(a, b, strict=True)])

    return df.select("p_partkey", same("x", "y").alias("same"))


def fn_safe_pattern(spark, d):
    """Patterns that would be matched without bound are refused, not tried."""
    names = [r[0] for r in t(spark, d, "region").select("r_name").orderBy("r_name").collect()]  # five regions
    patterns = [p for n in names for p in (f"^{n}$", f"({n}+)+x", f"[{n}")]
    return spark.createDataFrame([(p, sc.safe_pattern(p)) for p in patterns], "pattern string, safe boolean")


def fn_casefold(spark, d):
    df = t(spark, d, "part").selectExpr("p_partkey", "CASE p_partkey % 3 WHEN 0 THEN 'STRASSE' WHEN 1 THEN 'ΣΑΣ' ELSE p_brand END AS a", "CASE p_partkey % 3 WHEN 0 THEN 'straße' WHEN 1 THEN 'σασ' ELSE upper(p_brand) END AS b")
    return df.select("p_partkey", (fn.fold("a") == fn.fold("b")).alias("same"))


def fn_affinity(spark, d):
    names = t(spark, d, "part").columns
    return spark.createDataFrame([(a, b, fn.affinity(a, b)) for a in names for b in names if a < b], "a string, b string, share double").where("share > 0")


_NAMES = """rule_sat rule_sat_values logic_authoritative logic_unsat src_rule_files src_sources_manifest dsl_parse boundary_project boundary_registry expr_parse expr_solve cons_aggregate_sum cons_aggregate_count multiset_balance
cons_multiset mom_inferred agg_exact_rational sys_cycle sys_order sys_order_ambiguous sys_reciprocal_repair sys_migration_status win_duplicates win_rotation score bundle_ambiguity fw_falsify fd_fields fn_exact_equal fn_root fn_number_like
fn_iso_like fn_merkle fn_deep_equal fn_safe_pattern fn_casefold fn_affinity"""
QUERIES = {name: globals()[name] for name in _NAMES.split()}
_F = "WITH f AS (SELECT p_partkey AS id, p_size > 25 AS a, p_partkey % 3 = 0 AS b, CASE WHEN p_partkey % 83 = 0 THEN NULL ELSE p_size > 40 END AS c, p_brand = 'Brand#11' AS d FROM part) "
_P = "WITH s AS (SELECT l_orderkey AS k, sum(l_quantity::BIGINT) AS q, count(*) AS c FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS row_id, coalesce(q, 0) AS q, coalesce(c, 0) AS c FROM orders LEFT JOIN s ON k = o_orderkey) "
_L = "WITH l AS (SELECT l_orderkey AS g, l_suppkey AS supplier, l_partkey AS part, l_quantity::BIGINT AS a, l_quantity::BIGINT + CASE WHEN l_orderkey % 101 = 0 AND l_linenumber <= 2 THEN l_linenumber ELSE 0 END AS b, l_orderkey * 10 + l_linenumber AS row FROM lineitem)"
ORACLES = {
    "rule_sat": "SELECT 'start' AS rule_id UNION ALL SELECT 'end' UNION ALL SELECT 'step' || r_regionkey FROM region WHERE r_regionkey < (SELECT max(r_regionkey) FROM region)",
    "rule_sat_values": "SELECT r_name AS rule_id FROM (SELECT r_name FROM region ORDER BY r_name LIMIT 2)",
    "logic_authoritative": _F + "SELECT id AS row_id, 'c needs a' AS rule_id, 'logical_constraint_violation' AS code FROM f WHERE c AND NOT a UNION ALL SELECT id, 'a or b', 'logical_constraint_violation' FROM f WHERE NOT a AND NOT b UNION ALL SELECT id, 'not both', 'logical_constraint_violation' FROM f WHERE b AND c UNION ALL SELECT id, 'brand', 'logical_constraint_violation' FROM f WHERE d AND NOT b",
    "logic_unsat": "SELECT x.rule_id, 'logical_rule_system_unsat' AS code FROM (VALUES ('all'), ('none'), ('no z')) x(rule_id) WHERE EXISTS (SELECT 1 FROM part)",
    "src_rule_files": "SELECT 'n' || n_nationkey AS rule_id, 'implies' AS kind, 'region' || n_regionkey AS \"then\" FROM nation",
    "src_sources_manifest": "SELECT x.source_id, x.role, x.independent_group, count(*) AS n, sum(n_nationkey)::BIGINT AS total FROM nation, (VALUES ('a', 'defaults', 'g1'), ('b', 'authoritative', 'g2'), ('c', 'heldout', 'g2')) x(source_id, role, independent_group) WHERE x.source_id = 'a' OR x.source_id = 'b' AND n_nationkey < 5 OR x.source_id = 'c' AND n_regionkey = 1 GROUP BY ALL",
    "dsl_parse": "WITH m AS (SELECT max(p_size) - 5 AS hi, min(p_size) + 5 AS lo FROM part) SELECT 'size' AS field, CASE WHEN p_size > hi THEN 'maximum_violation' ELSE 'minimum_violation' END AS code, count(*) AS n FROM part, m WHERE p_size > hi OR p_size < lo GROUP BY ALL UNION ALL SELECT 'brand', 'pattern_violation', count(*) FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[0-9]+$') HAVING count(*) > 0",
    "boundary_project": "WITH x AS (SELECT p_partkey AS id, p_size AS v, greatest(8, least(36, p_size // 4 * 4)) AS lo, greatest(8, least(36, (p_size + 3) // 4 * 4)) AS hi FROM part) SELECT id, CASE WHEN v % 4 = 0 AND v BETWEEN 8 AND 36 THEN 'VALID' WHEN lo <> hi AND v - lo = hi - v THEN 'AMBIGUOUS' ELSE 'UNIQUE' END AS status, CASE WHEN lo = hi OR abs(v - lo) < abs(hi - v) THEN lo WHEN abs(v - lo) > abs(hi - v) THEN hi END::DECIMAL(38,9) AS value FROM x",
    "boundary_registry": "SELECT '/size' AS path, min(p_size)::DOUBLE AS low, max(p_size)::DOUBLE - 1 AS high, min(p_size) > max(p_size) - 1 AS contradiction FROM part UNION ALL SELECT '/price', NULL, max(p_size), true FROM part",
    "expr_parse": "WITH x AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size END::BIGINT AS a, (p_partkey % 4)::BIGINT AS b FROM part), y AS (SELECT *, (2 * a * 1000000000) % nullif(b, 0) = 0 AS finite FROM x) SELECT id, CASE WHEN a IS NULL THEN 'UNKNOWN' WHEN coalesce(finite, false) THEN 'VALUE' ELSE 'DOMAIN_ERROR' END AS status, CASE WHEN finite THEN (2 * a * 1000000000 // b + b * 1000000000)::DECIMAL(38,9) * 0.000000001 END::DECIMAL(38,9) AS value FROM y",
    "expr_solve": "SELECT p_partkey AS row_id, 'expression_violation' AS code, (p_size + 0.25)::DECIMAL(38,9) AS new_value FROM part WHERE p_partkey % 113 = 0",
    "cons_aggregate_sum": _P + "SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 'aggregate_sum_violation' ELSE 'aggregate_sum_missing' END AS code, CASE WHEN row_id % 3 = 0 THEN q + 1 END::DECIMAL(38,9) AS old_value, q::DECIMAL(38,9) AS new_value FROM o WHERE row_id % 3 = 0 OR row_id % 5 = 0",
    "cons_aggregate_count": _P + "SELECT row_id, 'aggregate_count_violation' AS code, (c + 1)::DECIMAL(38,9) AS old_value, c::DECIMAL(38,9) AS new_value FROM o WHERE row_id % 2 = 0",
    "multiset_balance": _L + ", x AS (SELECT 'supplier' AS key, 'quantity' AS quantity, g, supplier AS k, sum(a) AS a, sum(b) AS b FROM l GROUP BY ALL UNION ALL SELECT 'part', 'quantity', g, part, sum(a), sum(b) FROM l GROUP BY ALL UNION ALL SELECT 'supplier', 'part', g, supplier, sum(part), sum(part) FROM l GROUP BY ALL), y AS (SELECT key, quantity, g, bool_and(a = b) AS same FROM x GROUP BY ALL) SELECT key, quantity, count(*) FILTER (same) AS support, count(*) AS decided FROM y GROUP BY ALL HAVING count(*) >= 4 AND count(*) FILTER (same) >= 0.95 * count(*)",
    "cons_multiset": _L + ", x AS (SELECT g, supplier, sum(a) - sum(b) AS diff, count(*) AS hits FROM l GROUP BY ALL HAVING sum(a) <> sum(b)), y AS (SELECT g, min(supplier) AS supplier, min(diff) AS diff, min(hits) AS hits FROM x GROUP BY g HAVING count(*) = 1) SELECT row AS row_id, b AS old_value, (b + diff)::BIGINT AS new_value FROM l JOIN y ON y.g = l.g AND y.supplier = l.supplier WHERE hits = 1",
    "mom_inferred": """WITH s AS (SELECT l_suppkey AS s, sum(l_quantity::BIGINT * l_linenumber) AS x, sum(l_linenumber) AS w, sum(l_quantity::BIGINT) AS q, count(*) AS n, sum(l_quantity::BIGINT * l_quantity::BIGINT) AS qq FROM lineitem GROUP BY 1),
        f AS (SELECT *, (x * 1000000000) % w = 0 AS fx, (q * 1000000000) % n = 0 AS fq, ((n * qq - q * q) * 1000000000) % (n * n) = 0 AS fv, s % 50 = 7 AS bad FROM s),
        r AS (SELECT 'weighted_mean' AS kind, 'weighted_avg' AS output, 'quantity' AS value, 'line' AS weight, count(*) FILTER (fx) AS support, count(*) FILTER (fx) AS decided FROM f UNION ALL SELECT 'mean', 'mean_quantity', 'quantity', NULL, count(*) FILTER (fq AND NOT bad), count(*) FILTER (fq) FROM f UNION ALL SELECT 'variance', 'var_quantity', 'quantity', NULL, count(*) FILTER (fv), count(*) FILTER (fv) FROM f) SELECT * FROM r WHERE decided >= 4 AND support >= 0.95 * decided""",
    "agg_exact_rational": "SELECT o_orderstatus, (cents // gcd(cents, n))::BIGINT AS num, (n // gcd(cents, n))::BIGINT AS den FROM (SELECT o_orderstatus, (sum(o_totalprice::DECIMAL(18,2)) * 100)::BIGINT AS cents, count(*) * 100 AS n FROM orders GROUP BY 1)",
    "sys_cycle": """WITH RECURSIVE e AS (SELECT n_nationkey // 2 AS s, n_nationkey AS t FROM nation WHERE n_nationkey > 0 AND n_nationkey <> 12 UNION ALL SELECT 20, 10 FROM nation WHERE n_nationkey = 20), p AS (SELECT s, t FROM e WHERE s <> 0 UNION SELECT p.s, e.t FROM p JOIN e ON e.s = p.t)
        SELECT 'graph_cycle' AS code, n_nationkey::VARCHAR AS item FROM nation WHERE n_nationkey IN (SELECT t FROM p WHERE s IN (SELECT s FROM p WHERE s = t)) UNION ALL SELECT 'unreachable_nodes', n_nationkey::VARCHAR FROM nation WHERE n_nationkey <> 1 AND n_nationkey NOT IN (SELECT t FROM p WHERE s = 1)""",
    "sys_order": "SELECT n_nationkey AS row_id, 'topological_order_violation' AS code, (13 - n_nationkey)::BIGINT AS old_value, n_nationkey::BIGINT AS new_value FROM nation WHERE n_nationkey IN (4, 9)",
    "sys_order_ambiguous": "SELECT n_nationkey AS row_id, 'topological_order_ambiguous' AS code, NULL::BIGINT AS new_value FROM nation WHERE 24 - n_nationkey <> CASE WHEN n_nationkey = 0 THEN 0 ELSE 1 END",
    "sys_reciprocal_repair": "WITH e AS (SELECT n_nationkey AS s, 24 - n_nationkey AS t FROM nation) SELECT t AS src, s AS dst, 'missing_reciprocal_edge' AS code FROM e WHERE s = 21 UNION ALL SELECT t, s, 'multiple_reciprocal_edges_missing' FROM e WHERE t <= 2",
    "sys_migration_status": "SELECT * FROM (VALUES ('whole', 'migration_available', 'drop,rename,double'), ('there', 'AT_TARGET', ''), ('none', 'migration_steps_missing', ''), ('unknown', 'migration_dependency_error', ''), ('circle', 'migration_dependency_error', ''), ('either', 'migration_order_underspecified', ''), ('early', 'migration_precondition_failed', '')) x(name, status, plan) WHERE EXISTS (SELECT p_partkey, p_size, p_type FROM part)",
    "win_duplicates": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n AS occurrences FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1",
    "win_rotation": "WITH w AS (SELECT o_orderpriority AS p, k.k, lead(o_orderpriority, k.k) OVER (PARTITION BY o_custkey, k.k ORDER BY o_orderkey) AS q FROM orders, (VALUES (1), (2), (3)) k(k)) SELECT k AS shift, count(*) AS n, count(*) FILTER (p = q) AS equal FROM w WHERE q IS NOT NULL GROUP BY k",
    "score": using("ord") + ", i AS (SELECT CASE WHEN broken_customer <> customer_id THEN 10 WHEN status = 'P' THEN 3 WHEN priority LIKE '1%' THEN 1 END AS w FROM ord) SELECT sum(w)::BIGINT AS score, count(w) AS issues FROM i",
    "bundle_ambiguity": "WITH c AS (SELECT count(*) FILTER (c_nationkey < 24)::DOUBLE / count(*) AS less FROM customer) SELECT NULL::VARCHAR AS target, 'ambiguous_reference_target' AS code, 1.0::DOUBLE AS confidence, 'tie' AS bundle UNION ALL SELECT CASE WHEN less < 1 THEN 'a' END, CASE WHEN less < 1 THEN NULL ELSE 'ambiguous_reference_target' END, 1.0, 'one' FROM c",
    "fw_falsify": using("cust") + ", m AS (SELECT nation, region, count(*) AS n FROM cust WHERE region IS NOT NULL GROUP BY ALL), g AS (SELECT nation, first(region ORDER BY n DESC, region::VARCHAR) AS mode, sum(n) AS n, max(n) AS top FROM m GROUP BY nation), s AS (SELECT sum(CASE WHEN n >= 3 THEN top ELSE 0 END)::DOUBLE / sum(n) >= 0.95 AS sure FROM g) SELECT id AS row_id, 'region' AS target, mode::VARCHAR AS new_value FROM cust JOIN g ON g.nation = cust.nation, s WHERE sure AND g.n >= 3 AND (region IS NULL OR region <> mode)",
    "fd_fields": "SELECT 'f' || lpad(i::VARCHAR, 2, '0') AS field, i < 12 AS used FROM range(14) r(i) WHERE EXISTS (SELECT 1 FROM region)",
    "fn_exact_equal": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS same, (p_size * 1000 + 0.000001)::DECIMAL(38,9) AS product FROM part",
    "fn_root": "SELECT p_partkey, CASE WHEN round(sqrt(p_size)) ** 2 = p_size THEN round(sqrt(p_size)) END::DECIMAL(38,9) AS root, (p_size::BIGINT * p_size * p_size)::DECIMAL(38,9) AS cube FROM part",
    "fn_number_like": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '\"' || p_size || '\"' WHEN 1 THEN p_size || '.0' ELSE p_size::VARCHAR END AS text FROM part",
    "fn_iso_like": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') END AS next FROM orders",
    "fn_merkle": "WITH RECURSIVE l AS (SELECT 0 AS depth, list(sha256(n_nationkey || '|' || n_name) ORDER BY n_nationkey) AS h, count(*) AS n FROM nation UNION ALL SELECT depth + 1, list_transform(range(1, len(h) + 1, 2), lambda i: CASE WHEN i = len(h) THEN h[i] ELSE sha256(h[i] || h[i + 1]) END), n FROM l WHERE len(h) > 1) SELECT n AS n_rows, h[1] AS root FROM l WHERE len(h) = 1",
    "fn_deep_equal": "SELECT p_partkey, p_partkey % 4 IN (0, 3) AS same FROM part",
    "fn_safe_pattern": "SELECT p.pattern, p.safe FROM region, LATERAL (VALUES ('^' || r_name || '$', true), ('(' || r_name || '+)+x', false), ('[' || r_name, false)) p(pattern, safe)",
    "fn_casefold": "SELECT p_partkey, true AS same FROM part",
    "fn_affinity": "WITH c AS (SELECT column_name AS n, string_split(lower(column_name), '_') AS w FROM (DESCRIBE part)) SELECT a.n AS a, b.n AS b, len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) AS share FROM c a JOIN c b ON a.n < b.n WHERE len(list_intersect(a.w, b.w)) > 0",
}
