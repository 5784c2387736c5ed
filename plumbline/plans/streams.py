"""Queries over streams: files read in micro-batches, knowledge from sums, the loop to a quiet end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as rl
from ..operators import schema as sc
from ..sources.shared import shared_folder
from ..streaming import batches
from ..streaming import driver as dr
from .inputs import t, using, view

PARTS = 3


def _landed(spark, rows, source=None):
    """(folder, schema, files of a batch) of rows written as files that a stream reads in PARTS batches or more."""
    folder = shared_folder(spark) + "/in"
    return folder, rows.schema, batches.landed(rows, folder, PARTS, source)


def _summary(spark, rows, summary, source=None):
    folder, schema, files = _landed(spark, rows, source)
    return dr.summarise(dr.open_stream(spark, folder, schema, files), {"x": summary}, shared_folder(spark))["x"]


_PAIRS = [("nation", "region"), ("segment", "region")]


def st_discover(spark, d):
    """All relations of one pass."""
    rows = view(spark, d, "item").selectExpr("order_id * 10 + line AS id", "charge", "discount", "quantity", "flag", "state")
    folder, schema, files = _landed(spark, rows)
    return dr.discover(spark, folder, schema, "id", [("flag", "state"), ("state", "flag")], ["charge", "discount", "quantity"], ["flag"], shared_folder(spark), files).select("kind", "inputs", "output", "support")


def st_arith(spark, d):
    return dr.arithmetic(_summary(spark, view(spark, d, "item").select("charge", "discount", "quantity"), dr.arithmetic_counts(["charge", "discount", "quantity"])))


def st_aggregate(spark, d):
    """Whether an order's number is the sum of its items' quantities."""
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").cast("bigint").alias("q"))).alias("items"), F.sum(F.col("l_quantity").cast("bigint")).alias("s"))
    rows = lines.select("l_orderkey", "items", (F.col("s") + F.when(F.col("l_orderkey") % 173 == 0, 1).otherwise(0)).alias("total"))
    return _summary(spark, rows, dr.aggregate_counts("total", "items", "q"), t(spark, d, "lineitem"))


def st_enum(spark, d):
    return dr.spellings(_summary(spark, view(spark, d, "cust").select("spelled"), dr.value_counts(["spelled"])))


def _events(spark, d):
    return t(spark, d, "events").selectExpr("event_id", "event_type", "CASE WHEN event_id % 71 = 0 AND event_type = 'click' THEN '{}' WHEN event_type = 'view' THEN concat('{\"k\":', get_json_object(props, '$.k'), ',\"v\":{\"w\":1}}') ELSE props END AS raw")


def st_required(spark, d):
    """Leaves that nearly all records of every regime have."""
    return dr.required_leaves(_summary(spark, _events(spark, d), dr.leaf_counts("event_type", "raw")))


def st_modal(spark, d):
    return dr.regimes(_summary(spark, _events(spark, d), dr.leaf_counts("event_type", "raw")))


def st_falsify(spark, d):
    """Parity folds and the baseline of a stream's dependencies."""
    rows = view(spark, d, "cust").selectExpr("id", "nation", "region", "segment", "'same' AS same")
    return dr.falsified(_summary(spark, rows, dr.fold_counts("id", [("nation", "region"), ("nation", "segment"), ("segment", "same")])))


def st_choose(spark, d):
    """One value a cell, by tier, from the candidates of a stream's records."""
    rows = view(spark, d, "cust").select("id", "nation", "region", "segment")
    known = dr.functional(_summary(spark, rows, dr.functional_counts("id", _PAIRS)))
    found = dr.candidates(rows, "id", known, _PAIRS)
    given = rows.where("id % 89 = 0 and id % 2 = 0").select(F.col("id").alias("row_id"), F.lit("region").alias("field"), F.col("region").cast("string").alias("old_value"), F.lit("8").alias("new_value"), F.lit("source").alias("analyzer"), F.lit(3).alias("tier"))
    return dr.choose(found.unionByName(given)).select("row_id", "field", "new_value")


def st_record_bridge(spark, d):
    """Each record's own checks, stage after stage, summed over the batches of a stream."""
    rows = t(spark, d, "part").selectExpr("p_partkey AS id", "p_size AS size", "CASE WHEN p_partkey % 61 = 0 THEN p_size + 1 ELSE p_size END AS twin", "concat('{\"k\":', CASE WHEN p_partkey % 7 = 0 THEN '\"x\"' ELSE CAST(p_size AS STRING) END, '}') AS raw")
    checks = {
        "schema": lambda b: sc.violations(b, "id", "raw", {"properties": {"k": {"type": "integer", "maximum": 30}}}),
        "rules": lambda b: rl.evaluate(b, "id", rl.parse_rules("size minimum 5").simple),
        "expression": lambda b: rl.expression_rule(b, "id", "twin", "size"),
    }
    return _summary(spark, rows, dr.issue_counts("id", checks))


def _repaired(spark, d):
    rows = view(spark, d, "cust").select("id", "nation", "region")
    folder, schema, files = _landed(spark, rows)
    out = shared_folder(spark) + "/out"
    told = dr.repair_stream(spark, folder, schema, "id", [("nation", "region")], out, files)
    return told, out, schema


def st_driver(spark, d):
    """Cycles to two quiet ones, the inverse verified, the result published."""
    _, out, schema = _repaired(spark, d)
    return spark.read.schema(schema).parquet(f"{out}/records")


def st_driver_status(spark, d):
    told, _, _ = _repaired(spark, d)
    return spark.createDataFrame([(told["status"], told["cycles"], told["changed"][0])], "status string, cycles int, changed long")


def st_journal_inverse(spark, d):
    """The published journal, backwards, gives the records that came in."""
    _, out, schema = _repaired(spark, d)
    return dr.undo(spark, out, schema, "id", ["region"])


_NAMES = "st_discover st_arith st_aggregate st_enum st_required st_modal st_falsify st_choose st_record_bridge st_driver st_driver_status st_journal_inverse"
QUERIES = {name: globals()[name] for name in _NAMES.split()}
_ITEM = using("item")
_CUST = using("cust")
_SUMS = ", s AS (SELECT count(*) FILTER (charge = quantity + discount) AS support, count(*) AS decided FROM item), f AS (SELECT * FROM (VALUES ('charge', 'discount', '+', 'quantity'), ('discount', 'charge', '-', 'quantity'), ('quantity', 'charge', '-', 'discount')) x(target, a, op, b))"
_FD = ", {0} AS (SELECT d, first(v ORDER BY n DESC, v DESC) AS mode, max(n) AS top, sum(n)::BIGINT AS n FROM (SELECT {1}::VARCHAR AS d, {2}::VARCHAR AS v, count(*) AS n FROM {3} WHERE {1} IS NOT NULL AND {2} IS NOT NULL GROUP BY ALL) GROUP BY d)"
_SURE = "SELECT 1 FROM {0} HAVING count(*) FILTER (n >= 2) >= 2 AND sum(CASE WHEN n >= 2 THEN top ELSE 0 END)::DOUBLE / sum(n) >= 0.95"
_MENDED = _CUST + "SELECT id, nation, CASE WHEN region IS NULL OR id % 97 = 0 THEN nation % 5 ELSE region END::INT AS region FROM cust"
ORACLES = {
    "st_discover": _ITEM + _SUMS + _FD.format("fs", "flag", "state", "item") + _FD.format("sf", "state", "flag", "item") + """SELECT 'exact_arithmetic_stream' AS kind, a || ' ' || op || ' ' || b AS inputs, target AS output, support FROM f, s WHERE support >= 0.95 * decided
        UNION ALL SELECT 'functional_stream', 'flag', 'state', sum(n) FILTER (n >= 2)::BIGINT FROM fs HAVING EXISTS (""" + _SURE.format("fs") + ") UNION ALL SELECT 'functional_stream', 'state', 'flag', sum(n) FILTER (n >= 2)::BIGINT FROM sf HAVING EXISTS (" + _SURE.format("sf") + ") UNION ALL SELECT 'enum_representation_stream', '', 'flag', count(*) FROM (SELECT flag FROM item GROUP BY flag) HAVING count(*) > count(DISTINCT lower(flag))",
    "st_arith": _ITEM + _SUMS + "SELECT target, a, op, b, support, decided FROM f, s WHERE support >= 0.95 * decided",
    "st_aggregate": "SELECT 'aggregate_sum' AS kind, 'total' AS output, count(*) FILTER (l_orderkey % 173 <> 0) AS support, count(*) AS decided FROM (SELECT DISTINCT l_orderkey FROM lineitem)",
    "st_enum": _CUST + ", c AS (SELECT spelled AS v, lower(spelled) AS f, count(*) AS n FROM cust GROUP BY 1), g AS (SELECT f, first(v ORDER BY n DESC, v DESC) AS canonical FROM c GROUP BY f HAVING count(*) > 1 AND max(n)::DOUBLE / sum(n) >= 0.75) SELECT 'spelled' AS field, v AS value, canonical FROM c JOIN g ON g.f = c.f WHERE v <> canonical",
    "st_required": "SELECT '/k' AS path FROM (SELECT avg((NOT (event_id % 71 = 0 AND event_type = 'click'))::INT) AS s FROM events GROUP BY event_type) HAVING min(s) >= 0.95",
    "st_modal": "SELECT event_type AS regime, count(*) AS records, CASE WHEN event_type = 'view' THEN '/k,/v/w' ELSE '/k' END AS leaves FROM events GROUP BY event_type HAVING avg((NOT (event_id % 71 = 0 AND event_type = 'click'))::INT) >= 0.95",
    "st_falsify": _CUST + """, x AS (SELECT id % 2 AS fold, p.* FROM cust, LATERAL (VALUES ('nation', 'region', nation::VARCHAR, region::VARCHAR), ('nation', 'segment', nation::VARCHAR, segment), ('segment', 'same', segment, 'same')) p(det, target, d, v) WHERE p.v IS NOT NULL),
        c AS (SELECT det, target, fold, d, v, count(*) AS n FROM x GROUP BY ALL), b AS (SELECT det, target, fold, d, first(v ORDER BY n DESC, v DESC) AS mode, sum(n) AS n FROM c GROUP BY ALL), g AS (SELECT det, target, count(*) FILTER (k > 1) AS against FROM (SELECT det, target, d, count(DISTINCT mode) AS k FROM b WHERE n >= 2 GROUP BY ALL) GROUP BY ALL),
        w AS (SELECT det, target, d, v, sum(n) AS n FROM c GROUP BY ALL), fit AS (SELECT det, target, sum(top)::DOUBLE / sum(n) AS fit FROM (SELECT det, target, d, max(n) AS top, sum(n) AS n FROM w GROUP BY ALL) GROUP BY ALL), pl AS (SELECT det, target, max(n)::DOUBLE / sum(n) AS base, count(*) AS k FROM (SELECT det, target, v, sum(n) AS n FROM w GROUP BY ALL) GROUP BY ALL)
        SELECT fit.det, fit.target, CASE WHEN against > 0 THEN 'ACTIVE_REFUTED' WHEN k <= 1 THEN 'NEGATIVE_CONTROL_INVARIANT' WHEN fit > base THEN 'ADVERSARIAL_SURVIVED' ELSE 'OBSERVED_STABLE' END AS status FROM fit JOIN pl ON pl.det = fit.det AND pl.target = fit.target JOIN g ON g.det = fit.det AND g.target = fit.target""",
    "st_choose": _CUST + _FD.format("m", "nation", "region", "cust") + "SELECT id AS row_id, 'region' AS field, CASE WHEN id % 89 = 0 AND id % 2 = 0 THEN '8' ELSE mode END AS new_value FROM cust LEFT JOIN m ON m.d = nation::VARCHAR AND m.n >= 2 WHERE id % 89 = 0 AND id % 2 = 0 OR (region IS NULL OR region::VARCHAR <> mode) AND mode IS NOT NULL",
    "st_record_bridge": """SELECT * FROM (SELECT '0 schema' AS stage, 'schema_type_violation' AS code, count(*) FILTER (p_partkey % 7 = 0) AS n FROM part UNION ALL SELECT '0 schema', 'schema_maximum_violation', count(*) FILTER (p_partkey % 7 <> 0 AND p_size > 30) FROM part
        UNION ALL SELECT '1 rules', 'minimum_violation', count(*) FILTER (p_size < 5) FROM part UNION ALL SELECT '2 expression', 'expression_violation', count(*) FILTER (p_partkey % 61 = 0) FROM part) WHERE n > 0""",
    "st_driver": _MENDED,
    "st_driver_status": _CUST + "SELECT 'PASS' AS status, 3 AS cycles, count(*) AS changed FROM cust WHERE region IS NULL OR region <> nation % 5",
    "st_journal_inverse": _CUST + "SELECT id, nation, region FROM cust",
}
