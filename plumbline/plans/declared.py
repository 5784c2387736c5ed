"""Queries of declared rules, schemas, graphs, state machines, repairs, sources and scalar functions."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from .. import functions as fn
from .. import sources as src
from ..operators import repair as rp
from ..operators import rules as rl
from ..operators import schema as sc
from ..operators import systems as sy
from ..sources.shared import cutter, dealt
from ..sources.syntax import repaired
from ..streaming import batches
from .inputs import t, using, view

_BOOL = "p_size > 25 AS a, p_partkey % 3 = 0 AS b, CASE WHEN p_partkey % 83 = 0 THEN p_size <= 25 OR p_partkey % 3 <> 0 ELSE p_size > 25 AND p_partkey % 3 = 0 END AS c, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey % 5 = 0 END AS d"


def _flags(spark, d):
    return t(spark, d, "part").selectExpr("p_partkey AS id", *_BOOL.split(", "), "p_brand AS brand", "p_size AS size")


def pred_present(spark, d):
    return _flags(spark, d).where(~rl.present("d")).select("id")


def pred_equals(spark, d):
    return _flags(spark, d).select("id", rl.equals("brand", "Brand#11").alias("holds"))


def pred_truthy(spark, d):
    return _flags(spark, d).where(~rl.truthy("d", "boolean")).select("id")


def rule_implies(spark, d):
    return _flags(spark, d).where(~rl.implies([F.col("a"), F.col("b")], F.col("c"))).select("id")


def rule_exactly_one(spark, d):
    return _flags(spark, d).where(~rl.exactly_one(F.col("a"), F.col("b"), F.col("d"))).select("id")


def rule_any_of(spark, d):
    return _flags(spark, d).where(~rl.any_of(F.col("a"), F.col("b"), F.col("d"))).select("id")


def rule_not_both(spark, d):
    return _flags(spark, d).where(~rl.not_both(F.col("a"), F.col("b"))).select("id")


def rule_repair_candidates(spark, d):
    bad = _flags(spark, d).where(~rl.implies([F.col("a"), F.col("b")], F.col("c")))
    return bad.select("id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(v).alias("new_value")) for f, v in (("c", True), ("a", False), ("b", False))))).alias("x")).select("id", "x.*")





def logic_exactly_one(spark, d):
    df = t(spark, d, "lineitem").selectExpr("l_returnflag = 'A' AS fa", "l_returnflag = 'N' AS fn", "l_returnflag = 'R' OR l_orderkey % 1000 = 0 AS fr")
    return rl.infer_exactly_one(df, ["fa", "fn", "fr"])


def logic_implies2(spark, d):
    return rl.infer_implies(_flags(spark, d).drop("id", "d", "brand", "size"), ["a", "b", "c"]).where("target = 'c'")


RULES = """
size minimum 3        # bounds of one field are met together
size maximum 45
brand enum ["Brand#11", "Brand#12", "Brand#13"]
brand pattern "^Brand#[0-9]+$"
brand maxLength 8
d require
"""


def dsl_simple(spark, d):
    df = _flags(spark, d).withColumn("brand", F.when(F.col("id") % 41 == 0, F.lower("brand")).otherwise(F.col("brand")))
    return rl.evaluate(df, "id", rl.parse_rules(RULES).simple)



def dsl_numeric_intersection(spark, d):
    df = t(spark, d, "part").select(F.col("p_partkey").alias("id"), fn.project(F.col("p_size"), 4, 40, 3).alias("nearest"), F.col("p_size").cast(fn.DEC).alias("size"))
    return df.where("nearest is null or nearest <> size").select("id", "nearest")





def expr_eval(spark, d):
    return view(spark, d, "part2").select("id", rl.compile_expression("max(size, 10) * 2 + abs(tripled - 90) % 7 - floor(size / 4)").alias("value"))


def expr_rule(spark, d):
    return rl.expression_rule(view(spark, d, "part2"), "id", "tripled", "size + doubled")



def linear_system(spark, d):
    df = t(spark, d, "part").selectExpr("p_partkey AS id", "p_size AS a", "CAST(p_partkey % 9 AS INT) AS b", "CAST(p_size + p_partkey % 9 + CASE WHEN p_partkey % 61 = 0 THEN 5 ELSE 0 END AS INT) AS c", "CAST(p_size + p_partkey % 9 + 4 AS INT) AS e")
    one = Fraction(1)
    return rl.linear_system(df, "id", [({"a": one, "b": one, "c": -one}, Fraction(0)), ({"c": one, "e": -one}, Fraction(-4))])


SCHEMA = {
    "type": "object", "required": ["k", "u"], "additionalProperties": {"type": ["integer", "string"]},
    "properties": {"k": {"type": "integer", "minimum": 5, "multipleOf": 2}, "u": {"$ref": "#/$defs/user"}},
    "dependentRequired": {"k": ["u"]}, "$defs": {"user": {"oneOf": [{"type": "integer", "maximum": 100}, {"type": "string", "minLength": 2}]}},
}


def _documents(spark, d):
    return t(spark, d, "events").selectExpr("event_id AS id", "CASE WHEN event_id % 40 = 0 THEN to_json(named_struct('k', event_id % 20)) WHEN event_id % 30 = 0 THEN to_json(named_struct('k', 'x', 'u', 1)) ELSE to_json(named_struct('k', event_id % 20, 'u', user_id)) END AS raw")


def schema_validate(spark, d):
    return sc.validate(_documents(spark, d), "raw", SCHEMA).drop("raw")


def schema_violations(spark, d):
    return sc.violations(_documents(spark, d), "id", "raw", SCHEMA)




def sys_graph(spark, d):
    nodes = t(spark, d, "nation").selectExpr("n_nationkey AS id").unionByName(t(spark, d, "nation").where("n_nationkey = 3").selectExpr("n_nationkey AS id"))
    edges = t(spark, d, "nation").selectExpr("n_nationkey AS src", "CASE WHEN n_nationkey = 24 THEN NULL WHEN n_nationkey % 7 = 6 THEN n_nationkey + 100 ELSE n_nationkey + 1 END AS dst")
    return sy.graph_issues(nodes, edges)


def set_components(spark, d):
    """Customers tied to the third of their key, unless a seventh key breaks the tie: each with the least key it is tied to."""
    edges = t(spark, d, "customer").where("c_custkey > 2 and c_custkey % 7 <> 0").selectExpr("CAST(c_custkey DIV 3 AS BIGINT) AS a", "c_custkey AS b")
    return sy.components(edges, cutter(spark))


def sys_reachable(spark, d):
    """Nodes reachable from the smallest key along division by three: iterative frontiers."""
    edges = t(spark, d, "customer").where("c_custkey > 1").selectExpr("CAST(c_custkey DIV 3 AS BIGINT) AS src", "c_custkey AS dst")
    return sy.reachable(edges, spark.range(1, 2), cutter(spark))


def sys_topological(spark, d):
    nodes = t(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id")
    edges = t(spark, d, "nation").where("n_nationkey > 0").selectExpr("CAST(n_nationkey DIV 2 AS BIGINT) AS src", "CAST(n_nationkey AS BIGINT) AS dst").where("src <> dst")
    return sy.topological_levels(nodes, edges, cutter(spark))


def sys_reciprocal(spark, d):
    return sy.missing_reciprocal(t(spark, d, "nation").selectExpr("n_nationkey AS src", "(n_nationkey * 3 + 1) % 25 AS dst"))


def sys_state_machine(spark, d):
    rows = t(spark, d, "conversations").where("role in ('user', 'assistant')").selectExpr("conv_id", "turn", "CASE WHEN (conv_id + turn) % 37 = 0 THEN 'tool' ELSE role END AS role")
    return sy.state_issues(rows, "conv_id", "turn", "role", [("user", "assistant"), ("assistant", "user")], ["user"])


def sys_migration(spark, d):
    steps = {"rename": {"rename": ("p_size", "size")}, "double": {"set": ("twice", "size * 2")}, "drop": {"drop": "p_type"}}
    order = sy.plan_migration(steps, {"double": ["rename"]})
    return sy.migrate(t(spark, d, "part").select("p_partkey", "p_size", "p_type"), steps, order)


def _candidates(spark, d):
    base = view(spark, d, "cust").where("id % 97 = 0 OR id % 89 = 0").selectExpr("id AS row_id", "'/region' AS field", "CAST(region AS STRING) AS old_value", "nation")
    a = base.selectExpr("row_id", "field", "old_value", "CAST(nation % 5 AS STRING) AS new_value", "'fd' AS analyzer", "1 AS tier")
    b = base.where("row_id % 2 = 0").selectExpr("row_id", "field", "old_value", "CAST(nation % 4 AS STRING) AS new_value", "'rule' AS analyzer", "CASE WHEN row_id % 8 = 0 THEN 3 ELSE 1 END AS tier")
    c = base.where("row_id % 16 = 0").selectExpr("row_id", "field", "old_value", "'9' AS new_value", "'source' AS analyzer", "3 AS tier")
    return a.unionByName(b).unionByName(c)


_CAND = """, base AS (SELECT id AS row_id, '/region' AS field, region::VARCHAR AS old_value, nation FROM cust WHERE id % 97 = 0 OR id % 89 = 0),
k AS (SELECT row_id, field, old_value, (nation % 5)::VARCHAR AS new_value, 'fd' AS analyzer, 1 AS tier FROM base UNION ALL SELECT row_id, field, old_value, (nation % 4)::VARCHAR, 'rule', CASE WHEN row_id % 8 = 0 THEN 3 ELSE 1 END FROM base WHERE row_id % 2 = 0 UNION ALL SELECT row_id, field, old_value, '9', 'source', 3 FROM base WHERE row_id % 16 = 0)
"""


def fw_authority(spark, d):
    return rp.authority(_candidates(spark, d))[0].select("row_id", "field", "new_value", "analyzer")








def _region_candidates(df):
    from ..operators import dependencies as dep

    found = dep.functional(df, "id", [], [("nation", "region")])[1]
    return found.select("row_id", F.lit("region").alias("field"), "old_value", "new_value", F.lit("fd").alias("analyzer"), F.lit(1).alias("tier"))


def patch_apply(spark, d):
    df = view(spark, d, "cust").select("id", "nation", "region")
    return rp.apply_patches(df, "id", rp.select_unique(_region_candidates(df)), ["region"])


def fixed_point(spark, d):
    df = view(spark, d, "cust").select("id", "nation", "region")
    return rp.fixed_point(df, "id", ["region"], _region_candidates, cutter(spark))[0]


def patch_replay_inverse(spark, d):
    df = view(spark, d, "cust").select("id", "nation", "region")
    done, journal, _ = rp.fixed_point(df, "id", ["region"], _region_candidates, cutter(spark))
    return rp.replay_inverse(done, "id", ["region"], journal)


def set_union_dedup(spark, d):
    c = _candidates(spark, d).select("row_id", "new_value")
    return c.unionByName(c).dropDuplicates(["row_id", "new_value"])


def set_intersect_domains(spark, d):
    a = t(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_suppkey", "l_partkey")
    b = t(spark, d, "lineitem").where("l_returnflag = 'A'").select("l_suppkey", "l_partkey")
    return a.intersect(b)


def set_difference_novel(spark, d):
    a = t(spark, d, "lineitem").where("l_linenumber <= 3").select("l_orderkey", "l_linenumber")
    return a.exceptAll(t(spark, d, "lineitem").where("l_linenumber <= 2 and l_orderkey % 2 = 0").select("l_orderkey", "l_linenumber"))


def set_symmetric_diff(spark, d):
    a, b = view(spark, d, "cust").select("id", "region"), view(spark, d, "cust").selectExpr("id", "nation % 5 AS now")
    return a.join(b, "id", "full_outer").where("not region <=> now").select("id", "region", "now")







_HOSTILE = ('{"k":1,"k":2}', '{"k":NaN}', '{"k":', '{"k":1} x', '{"k":1e999}', '{"k":"\\\\ud800"}', '1,2', '1] , [2', "")


def src_strict_json(spark, d):
    cases = " ".join(f"WHEN {i} THEN '{text}'" for i, text in enumerate(_HOSTILE))
    raw = t(spark, d, "events").selectExpr("event_id", f"CASE event_id % 12 {cases} WHEN 9 THEN concat('\ufeff', props) WHEN 10 THEN concat(' ', props, ' ') ELSE props END AS raw")
    return raw.select("event_id", src.strict(F.col("raw")).isNotNull().alias("valid"))




def scan_object_arrays(spark, d):
    """Pointers of arrays of three objects or more, one of them nested below another object."""
    lines = F.collect_list(F.struct("l_linenumber"))
    raw = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(lines.alias("lines"), F.collect_list("l_suppkey").alias("suppliers"), F.struct(lines.alias("a/b")).alias("more"))).alias("raw"))
    return raw.select("l_orderkey", F.array_join(src.object_array_paths(F.col("raw")), ",").alias("arrays"))


def scan_leaf_paths(spark, d):
    """Scalar leaves at any depth; arrays are values."""
    raw = t(spark, d, "part").selectExpr("p_partkey", """concat('{"size":', p_size, ',"a/b":{"name":"', p_brand, '","list":[', p_size, '],"x":{"x":{"x":{"x":{"x":{"deep":null}}}}}}}') AS raw""")
    return dealt(raw, "p_partkey").select("p_partkey", F.explode(src.leaves(F.col("raw"))).alias("x")).select("p_partkey", "x.*")


def scan_tree_walk(spark, d):
    """Every node of a document, containers before what they hold."""
    raw = t(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.array(F.struct(F.col("p_size").alias("n"))).alias("list"), F.col("p_brand").alias("name"))).alias("raw"))
    return dealt(raw, "p_partkey").select("p_partkey", F.explode(src.tree(F.col("raw"))).alias("x")).select("p_partkey", "x.*")



def syn_min_repair(spark, d):
    raw = t(spark, d, "events").selectExpr("event_id", "get_json_object(props, '$.k') AS k", "props").selectExpr("event_id", "CASE event_id % 9 WHEN 0 THEN concat('{\"k\":', k, ',}') WHEN 1 THEN concat('{k: ', k, '}') WHEN 2 THEN concat('{''k'': ', k, ', ''s'': ''/* ', k, ' */''}') WHEN 3 THEN concat('{\"k\":', k, '} // end') WHEN 4 THEN concat('{\"k\":', k) WHEN 5 THEN concat('{\"k\":', k, ',\"k\":1}') WHEN 6 THEN '{\"k\":\"\\\\ud800\"}' WHEN 7 THEN concat(props, ' x') ELSE props END AS raw")
    return raw.select("event_id", repaired("raw").alias("r")).select("event_id", "r.value", "r.how")


def fn_decimal(spark, d):
    return t(spark, d, "part").selectExpr("p_partkey AS id", "CASE p_partkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN concat(p_size, '.50') ELSE '' END AS v").select("id", fn.exact("v").alias("number"))


def fn_selector_bits(spark, d):
    return t(spark, d, "part").select("p_partkey", fn.selector_bits("p_partkey").alias("bits"))


def fn_pointer(spark, d):
    return t(spark, d, "part").select("p_partkey", fn.pointer("part", F.col("p_type"), "a/b~c").alias("pointer"))


def fn_digest(spark, d):
    return t(spark, d, "part").select("p_partkey", fn.digest(F.to_json(F.struct(F.col("p_size").alias("z"), F.col("p_partkey").alias("a")))).alias("digest"))


def fn_quotient(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.array_join(F.array_sort(F.array_distinct(F.split("o_orderpriority", ""))), "").alias("letters"))


def fn_iso_time(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


def st_functional(spark, d):
    """Counts per (determinant, target) of a stream of micro-batches, folded into modes; two good groups are needed."""
    return batches.functional(view(spark, d, "cust").select("id", F.col("nation").cast("string").alias("d"), F.col("region").cast("string").alias("v")), spark, parts=3)


def st_apply(spark, d):
    return batches.apply_knowledge(view(spark, d, "cust").select("id", F.col("nation").cast("string").alias("d"), F.col("region").cast("string").alias("v")), st_functional(spark, d))






_NAMES = """pred_present pred_equals pred_truthy rule_implies rule_exactly_one rule_any_of rule_not_both rule_repair_candidates logic_exactly_one logic_implies2 dsl_simple dsl_numeric_intersection expr_eval expr_rule linear_system schema_validate schema_violations sys_graph set_components sys_reachable sys_topological sys_reciprocal sys_state_machine sys_migration fw_authority patch_apply fixed_point patch_replay_inverse set_union_dedup set_intersect_domains set_difference_novel set_symmetric_diff src_strict_json scan_object_arrays scan_leaf_paths scan_tree_walk syn_min_repair fn_decimal fn_selector_bits fn_pointer fn_digest fn_quotient fn_iso_time st_functional st_apply"""
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_P = f"WITH p AS (SELECT p_partkey AS id, {_BOOL}, p_brand AS brand, p_size AS size FROM part) "
_REPAIRED = using("cust") + "SELECT id, nation, CASE WHEN region IS NULL OR id % 97 = 0 THEN nation % 5 ELSE region END::INT AS region FROM cust"
_FDK = using("cust") + ", m AS (SELECT nation::VARCHAR AS d, first(r ORDER BY n DESC, r) AS mode, max(n) AS mode_n, sum(n)::BIGINT AS n FROM (SELECT nation, region::VARCHAR AS r, count(*) AS n FROM cust WHERE region IS NOT NULL GROUP BY ALL) GROUP BY nation) "
_NEAR = "WITH x AS (SELECT p_partkey AS id, p_size AS v, greatest(6, least(39, p_size // 3 * 3)) AS lo, greatest(6, least(39, (p_size + 2) // 3 * 3)) AS hi FROM part) SELECT id, CASE WHEN lo = hi THEN lo WHEN abs(v - lo) < abs(hi - v) THEN lo WHEN abs(v - lo) > abs(hi - v) THEN hi END::DECIMAL(38,9) AS nearest FROM x WHERE NOT (lo = hi AND lo = v)"
_LEAF = "SELECT p_partkey, '/size' AS path, p_size::VARCHAR AS value, 'integer' AS kind FROM part UNION ALL SELECT p_partkey, '/a~1b/name', '\"' || p_brand || '\"', 'string' FROM part UNION ALL SELECT p_partkey, '/a~1b/list', '[' || p_size || ']', 'array' FROM part UNION ALL SELECT p_partkey, '/a~1b/x/x/x/x/x/deep', 'null', 'null' FROM part"
_TREE = """SELECT p_partkey, '' AS path, '{"list":[{"n":' || p_size || '}],"name":"' || p_brand || '"}' AS value, 'object' AS kind FROM part UNION ALL SELECT p_partkey, '/list', '[{"n":' || p_size || '}]', 'array' FROM part
    UNION ALL SELECT p_partkey, '/list/0', '{"n":' || p_size || '}', 'object' FROM part UNION ALL SELECT p_partkey, '/list/0/n', p_size::VARCHAR, 'integer' FROM part UNION ALL SELECT p_partkey, '/name', '"' || p_brand || '"', 'string' FROM part"""
_DOCS = "WITH e AS (SELECT event_id AS id, event_id % 20 AS k, user_id AS u, CASE WHEN event_id % 40 = 0 THEN 1 WHEN event_id % 30 = 0 THEN 2 ELSE 0 END AS f FROM events) "
ORACLES = {
    "pred_present": _P + "SELECT id FROM p WHERE d IS NULL",
    "pred_equals": _P + "SELECT id, brand = 'Brand#11' AS holds FROM p",
    "pred_truthy": _P + "SELECT id FROM p WHERE NOT d",
    "rule_implies": _P + "SELECT id FROM p WHERE a AND b AND NOT c",
    "rule_exactly_one": _P + "SELECT id FROM p WHERE a::INT + b::INT + d::INT <> 1",
    "rule_any_of": _P + "SELECT id FROM p WHERE NOT a AND NOT b AND NOT d",
    "rule_not_both": _P + "SELECT id FROM p WHERE a AND b",
    "rule_repair_candidates": _P + "SELECT id, x.field, x.new_value FROM p, (VALUES ('c', true), ('a', false), ('b', false)) x(field, new_value) WHERE a AND b AND NOT c",
    "logic_exactly_one": "WITH f AS (SELECT l_returnflag = 'A' AS fa, l_returnflag = 'N' AS fn, l_returnflag = 'R' OR l_orderkey % 1000 = 0 AS fr FROM lineitem) SELECT 'fa,fn,fr' AS fields, count(*) FILTER (fa::INT + fn::INT + fr::INT = 1) AS support, count(*) AS decided FROM f",
    "logic_implies2": _P + "SELECT 'a' AS a, 'b' AS b, 'c' AS target, true AS value, count(*) FILTER (c) AS support, count(*) AS decided FROM p WHERE a AND b",
    "dsl_simple": _P + """, q AS (SELECT id, size, d, CASE WHEN id % 41 = 0 THEN lower(brand) ELSE brand END AS brand FROM p)
        SELECT id AS row_id, 'size' AS field, 'minimum_violation' AS code, size::VARCHAR AS old_value, '3' AS new_value FROM q WHERE size < 3 UNION ALL SELECT id, 'size', 'maximum_violation', size::VARCHAR, '45' FROM q WHERE size > 45
        UNION ALL SELECT id, 'brand', 'enum_violation', brand, CASE WHEN upper(brand) IN ('BRAND#11', 'BRAND#12', 'BRAND#13') THEN 'B' || lower(brand)[2:] END FROM q WHERE brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13')
        UNION ALL SELECT id, 'brand', 'pattern_violation', brand, NULL FROM q WHERE NOT regexp_matches(brand, '^Brand#[0-9]+$') UNION ALL SELECT id, 'brand', 'maxLength_violation', brand, NULL FROM q WHERE length(brand) > 8 UNION ALL SELECT id, 'd', 'required_missing', NULL, NULL FROM q WHERE d IS NULL""",
    "dsl_numeric_intersection": _NEAR, 
    "expr_eval": using("part2") + "SELECT id, (greatest(size, 10) * 2 + abs(tripled - 90) % 7 - size // 4)::DECIMAL(38,9) AS value FROM part2",
    "expr_rule": using("part2") + "SELECT id AS row_id, 'expression_violation' AS code, (3 * size)::DECIMAL(38,9) AS new_value FROM part2 WHERE tripled <> 3 * size",
    "linear_system": "SELECT p_partkey AS row_id, 'linear_system_violation' AS code, 'c' AS field, (p_size + p_partkey % 9)::DECIMAL(38,9) AS new_value FROM part WHERE p_partkey % 61 = 0",
    "schema_validate": _DOCS + "SELECT id, f = 0 AND k >= 5 AND k % 2 = 0 AND u <= 100 AS ok FROM e",
    "schema_violations": _DOCS + """, near AS (SELECT *, CASE WHEN k < 6 THEN 6 END::VARCHAR AS nk FROM e)
        SELECT id AS row_id, '/k' AS path, 'schema_minimum_violation' AS code, 'warning' AS severity, k::VARCHAR AS old_value, nk AS new_value FROM near WHERE f < 2 AND k < 5 UNION ALL SELECT id, '/k', 'schema_multiple_of_violation', 'warning', k::VARCHAR, nk FROM near WHERE f < 2 AND k % 2 <> 0
        UNION ALL SELECT id, '/k', 'schema_type_violation', 'error', '"x"', NULL FROM e WHERE f = 2 UNION ALL SELECT id, '/u', 'schema_required_missing', 'warning', NULL, NULL FROM e WHERE f = 1 UNION ALL SELECT id, '/u', 'schema_dependent_required_missing', 'warning', NULL, NULL FROM e WHERE f = 1 UNION ALL SELECT id, '/u', 'schema_oneof_violation', 'warning', u::VARCHAR, NULL FROM e WHERE f = 0 AND u > 100""",
    "sys_graph": "SELECT 'duplicate_node_identity' AS code, '3' AS item UNION ALL SELECT 'malformed_edge', '24>?' UNION ALL SELECT 'dangling_edge', n_nationkey || '>' || (n_nationkey + 100) FROM nation WHERE n_nationkey % 7 = 6",
    "set_components": "WITH RECURSIVE up AS (SELECT c_custkey AS node, c_custkey AS z FROM customer WHERE c_custkey > 2 UNION ALL SELECT node, z // 3 FROM up WHERE z > 2 AND z % 7 <> 0), w AS (SELECT node, min(z) AS root FROM up GROUP BY node), e AS (SELECT c_custkey AS k FROM customer WHERE c_custkey > 2 AND c_custkey % 7 <> 0) SELECT DISTINCT n AS node, coalesce((SELECT root FROM w WHERE w.node = n), n) AS root FROM (SELECT k AS n FROM e UNION SELECT k // 3 FROM e)",
    "sys_reachable": "WITH RECURSIVE r AS (SELECT 1::BIGINT AS id UNION SELECT c_custkey FROM customer, r WHERE c_custkey > 1 AND c_custkey // 3 = r.id) SELECT id FROM r",
    "sys_topological": "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey = 0 THEN 0 ELSE floor(log2(n_nationkey)) + 1 END::INT AS level FROM nation",
    "sys_reciprocal": "WITH e AS (SELECT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst FROM nation) SELECT DISTINCT dst AS src, src AS dst FROM e WHERE src <> dst AND (dst, src) NOT IN (SELECT (src, dst) FROM e)",
    "sys_state_machine": """WITH r AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 37 = 0 THEN 'tool' ELSE role END AS s FROM conversations WHERE role IN ('user', 'assistant')), x AS (SELECT *, lag(s) OVER w AS b, lead(s) OVER w AS a FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        ok(f, g) AS (VALUES ('user', 'assistant'), ('assistant', 'user')), y AS (SELECT *, CASE WHEN b IS NULL THEN s <> 'user' ELSE (b, s) NOT IN (SELECT (f, g) FROM ok) END AS bad_in, a IS NULL OR (s, a) NOT IN (SELECT (f, g) FROM ok) AS bad_out FROM x),
        o AS (SELECT conv_id, turn, v FROM y, (VALUES ('assistant'), ('user')) q(v) WHERE bad_in AND bad_out AND CASE WHEN b IS NULL THEN v = 'user' ELSE (b, v) IN (SELECT (f, g) FROM ok) END AND (a IS NULL OR (v, a) IN (SELECT (f, g) FROM ok)))
        SELECT conv_id AS machine, turn AS row_id, CASE WHEN b IS NULL THEN 'initial_state_violation' WHEN a IS NULL THEN 'terminal_transition_violation' ELSE 'invalid_transition_state' END AS code, s AS old_value, (SELECT CASE WHEN count(*) = 1 THEN min(v) END FROM o WHERE o.conv_id = y.conv_id AND o.turn = y.turn) AS new_value FROM y WHERE bad_in AND bad_out""",
    "sys_migration": "SELECT p_partkey, p_size AS size, p_size * 2 AS twice FROM part",
    "fw_authority": using("cust") + _CAND + "SELECT k.row_id, k.field, new_value, analyzer FROM k JOIN (SELECT row_id, max(tier) AS top, count(DISTINCT new_value) FILTER (tier = 3) AS n FROM k GROUP BY row_id) m ON k.row_id = m.row_id AND tier = top WHERE n <= 1",
    "patch_apply": _REPAIRED, "fixed_point": _REPAIRED,
    "patch_replay_inverse": using("cust") + "SELECT id, nation, region FROM cust",
    "set_union_dedup": using("cust") + _CAND + "SELECT DISTINCT row_id, new_value FROM k",
    "set_intersect_domains": "SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'",
    "set_difference_novel": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 3 EXCEPT ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 2 = 0",
    "set_symmetric_diff": using("cust") + "SELECT id, region, nation % 5 AS now FROM cust WHERE region IS DISTINCT FROM nation % 5",
    "src_strict_json": "SELECT event_id, event_id % 12 > 8 AS valid FROM events",
    "scan_object_arrays": "SELECT l_orderkey, CASE WHEN count(*) >= 3 THEN '/lines,/more/a~1b' ELSE '' END AS arrays FROM lineitem GROUP BY 1",
    "scan_leaf_paths": _LEAF, "scan_tree_walk": _TREE,
    "syn_min_repair": """SELECT event_id, CASE WHEN event_id % 9 = 2 THEN '{"k":' || (props->>'$.k') || ',"s":"/* ' || (props->>'$.k') || ' */"}' WHEN event_id % 9 IN (5, 6, 7) THEN NULL ELSE '{"k":' || (props->>'$.k') || '}' END AS value,
        CASE event_id % 9 WHEN 0 THEN 'trailing_comma' WHEN 1 THEN 'unquoted_keys' WHEN 2 THEN 'single_quotes' WHEN 3 THEN 'comments' WHEN 4 THEN 'edits:1' WHEN 8 THEN 'valid' ELSE 'refused' END AS how FROM events""",
    "fn_decimal": "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 1 THEN p_size + 0.5 END::DECIMAL(38,9) AS number FROM part",
    "fn_selector_bits": "SELECT p_partkey, CASE WHEN p_partkey <= 1 THEN 0 ELSE length(ltrim(bin(p_partkey - 1), '0')) END::BIGINT AS bits FROM part",
    "fn_pointer": "SELECT p_partkey, '/part/' || p_type || '/a~1b~0c' AS pointer FROM part",
    "fn_digest": "SELECT p_partkey, sha256('{\"a\":' || p_partkey || ',\"z\":' || p_size || '}') AS digest FROM part",
    "fn_quotient": "SELECT o_orderkey, array_to_string(list_sort(list_distinct(string_split(o_orderpriority, ''))), '') AS letters FROM orders",
    "fn_iso_time": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders",
    "st_functional": _FDK + "SELECT d, mode, n FROM m WHERE n >= 2",
    "st_apply": _FDK + "SELECT id, CASE WHEN region IS NULL THEN 'missing_from_functional_relation' ELSE 'functional_relation_violation' END AS code, region::VARCHAR AS old_value, mode AS new_value FROM cust JOIN m ON m.d = nation::VARCHAR WHERE region IS NULL OR region::VARCHAR <> mode",
}
