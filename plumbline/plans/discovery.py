"""Queries of profiles and dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dependencies as dep
from ..operators import profile
from .inputs import t, using, view

FD_PAIRS = [("nation", "region"), ("nation", "segment"), ("region", "nation"), ("segment", "region")]
_LONG = "rows_ AS (" + " UNION ALL ".join(f"SELECT id AS row_id, '{d}' AS det, '{v}' AS target, {d}::VARCHAR AS d, {v}::VARCHAR AS v FROM cust" for d, v in FD_PAIRS) + ")"
_COUNTS = "c AS (SELECT det, target, d, v, count(*) AS n FROM rows_ WHERE d IS NOT NULL AND v IS NOT NULL GROUP BY ALL), m AS (SELECT det, target, d, first(v ORDER BY n DESC, v) AS mode, max(n) AS mode_n, sum(n)::BIGINT AS n, coalesce((list(n ORDER BY n DESC, v))[2], 0) AS second_n FROM c GROUP BY det, target, d)"
_REL = "r AS (SELECT det, target, sum(CASE WHEN n >= 3 THEN mode_n ELSE 0 END)::BIGINT AS support, sum(n)::BIGINT AS observed FROM m GROUP BY det, target HAVING sum(n) >= 4 AND sum(CASE WHEN n >= 3 THEN mode_n ELSE 0 END)::DOUBLE / sum(n) >= 0.95)"


def fd_functional(spark, d):
    return dep.functional(view(spark, d, "cust"), "id", [], FD_PAIRS)[1].drop("confidence")


def fd_relations(spark, d):
    return dep.functional(view(spark, d, "cust"), "id", [], FD_PAIRS)[0]


def fd_sparse_recovery(spark, d):
    """Customers of whose regions one in seven is a stray value that comes once."""
    df = view(spark, d, "cust").selectExpr("id", "nation AS k", "CASE WHEN id % 7 = 3 THEN 1000 + id ELSE nation % 5 END AS v")
    return dep.sparse_recovery(df, "id", [("k", "v")]).drop("confidence")


def fd_scoped(spark, d):
    df = view(spark, d, "cust")
    return dep.scoped(df, "id", "segment", [("nation", "region")])[1]


def relation_falsify(spark, d):
    df = view(spark, d, "cust").withColumn("constant", F.lit("x"))
    return dep.falsify(df, "id", [("nation", "region"), ("nation", "segment"), ("nation", "constant")])


def info_bounds(spark, d):
    return dep.blind_trial(view(spark, d, "cust"), "id", "nation", "region")


_PROPS = "CASE WHEN event_id % 50 = 0 THEN to_json(named_struct('k', concat('s', event_id))) WHEN event_id % 71 = 0 THEN '{}' ELSE props END"
_DUCK_PROPS = "CASE WHEN event_id % 50 = 0 THEN '{\"k\":\"s' || event_id || '\"}' WHEN event_id % 71 = 0 THEN '{}' ELSE props END"


def _values(spark, d):
    e = t(spark, d, "events").selectExpr("event_id AS row_id", f"{_PROPS} AS raw")
    return e.select("row_id", F.lit("k").alias("field"), F.get_json_object("raw", "$.k").alias("value")).where("value is not null")


def type_consensus(spark, d):
    return profile.type_consensus(_values(spark, d))[1]


def _keys(spark, d):
    e = t(spark, d, "events").selectExpr("event_id AS row_id", f"{_PROPS} AS raw")
    return e.select("row_id", F.json_object_keys("raw").alias("keys"))


def dominant_shape(spark, d):
    return profile.shapes(_keys(spark, d)).select("shape", F.col("n").alias("support"), F.col("observed").cast("long").alias("observed"))


def required_key(spark, d):
    return profile.required_keys(_keys(spark, d))[1]


def enum_domain(spark, d):
    return profile.enum_domain(view(spark, d, "cust"), "id", "spelled")


def agg_profile(spark, d):
    return profile.field_profile(view(spark, d, "ord"), ["status", "priority", "customer_id"])


def agg_heavy_hitters(spark, d):
    return profile.heavy_hitters(t(spark, d, "lineitem"), "l_suppkey", 64)


def regime_detect(spark, d):
    df = view(spark, d, "item")
    shape = F.concat_ws(",", F.when(F.col("flag") == "R", "refund"), F.lit("charge"))
    return profile.regime_detect(df, ["flag", "state"], shape)


def regime_analyze(spark, d):
    """Dependencies inside each regime: the flag is the scope."""
    df = view(spark, d, "item").withColumns({"id": F.col("order_id") * 100 + F.col("line"), "mark": F.when(F.col("order_id") % 1009 == 0, "?").otherwise(F.concat("flag", F.lit("-"), "state"))})
    return dep.scoped(df, "id", "flag", [("state", "mark")])[0].select("scope", "det", "target", "support", "observed")


QUERIES = {f.__name__: f for f in (fd_functional, fd_relations, fd_sparse_recovery, fd_scoped, relation_falsify, info_bounds, type_consensus, dominant_shape, required_key, enum_domain, agg_profile, agg_heavy_hitters, regime_detect, regime_analyze)}
_CODE = "CASE WHEN v IS NULL THEN '{0}' ELSE '{1}' END AS code"
ORACLES = {
    "fd_functional": using("cust") + f", {_LONG}, {_COUNTS}, {_REL} SELECT row_id, det, target, {_CODE.format('missing_from_functional_relation', 'functional_relation_violation')}, v AS old_value, mode AS new_value FROM rows_ JOIN m USING (det, target, d) JOIN r USING (det, target) WHERE m.n >= 3 AND (v IS NULL OR v <> mode)",
    "fd_relations": using("cust") + f", {_LONG}, {_COUNTS}, {_REL} SELECT det, target, support, observed, support::DOUBLE / observed AS confidence FROM r",
    "fd_sparse_recovery": using("cust") + """, x AS (SELECT id, nation AS k, CASE WHEN id % 7 = 3 THEN 1000 + id ELSE nation % 5 END::VARCHAR AS v FROM cust), c0 AS (SELECT k, v, count(*) AS n FROM x GROUP BY k, v), c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, v) AS r FROM c0),
        m AS (SELECT k, max(v) FILTER (r = 1) AS mode, max(n) FILTER (r = 1) AS top, coalesce(max(n) FILTER (r = 2), 0) AS second, sum(n) AS n FROM c GROUP BY k), g AS (SELECT bool_and(n >= 3 AND top >= 3 AND top - second >= 2 AND second <= 1) AND sum(top)::DOUBLE / sum(n) >= 0.6 AND sum(top)::DOUBLE / sum(n) < 0.95 AS clear FROM m)
        SELECT id AS row_id, 'k' AS det, 'v' AS target, v AS old_value, mode AS new_value FROM x JOIN m ON m.k = x.k, g WHERE clear AND v <> mode""",
    "fd_scoped": using("cust") + """, c AS (SELECT segment AS scope, nation::VARCHAR AS d, region::VARCHAR AS v, count(*) AS n FROM cust WHERE region IS NOT NULL GROUP BY ALL),
        m AS (SELECT scope, d, first(v ORDER BY n DESC, v) AS mode, max(n) AS mode_n, sum(n) AS n FROM c GROUP BY scope, d),
        r AS (SELECT scope FROM m GROUP BY scope HAVING sum(n) >= 3 AND sum(CASE WHEN n >= 2 THEN mode_n ELSE 0 END)::DOUBLE / sum(n) >= 0.95)
        SELECT id AS row_id, segment AS scope, 'nation' AS det, 'region' AS target, CASE WHEN region IS NULL THEN 'missing_from_scoped_relation' ELSE 'scoped_relation_violation' END AS code, region::VARCHAR AS old_value, mode AS new_value
        FROM cust JOIN m ON m.scope = segment AND m.d = nation::VARCHAR JOIN r ON r.scope = segment WHERE m.n >= 2 AND (region IS NULL OR region::VARCHAR <> mode)""",
    "relation_falsify": using("cust") + """, x AS (SELECT id, nation::VARCHAR AS d, t.target, t.v FROM cust, LATERAL (VALUES ('region', region::VARCHAR), ('segment', segment), ('constant', 'x')) t(target, v) WHERE t.v IS NOT NULL),
        c AS (SELECT target, d, v, count(*) AS n FROM x GROUP BY ALL), m AS (SELECT target, d, first(v ORDER BY n DESC, v) AS mode, max(n) AS mode_n, sum(n) AS n FROM c GROUP BY target, d),
        a AS (SELECT target, sum(mode_n)::DOUBLE / sum(n) AS agreement, count(DISTINCT mode) AS vals FROM m GROUP BY target),
        fc AS (SELECT target, id % 2 AS fold, d, v, count(*) AS n FROM x GROUP BY ALL), fm AS (SELECT target, fold, d, first(v ORDER BY n DESC, v) AS mode, sum(n) AS n FROM fc GROUP BY target, fold, d),
        f AS (SELECT target, sum(CASE WHEN k > 1 AND least >= 2 THEN 1 ELSE 0 END) AS conflicts FROM (SELECT target, d, count(DISTINCT mode) AS k, min(n) AS least FROM fm GROUP BY target, d) GROUP BY target),
        tc AS (SELECT x.target, y.d, x.v, count(*) AS n FROM x JOIN x y ON y.target = x.target AND y.id = x.id + 1 GROUP BY ALL),
        tm AS (SELECT target, sum(mode_n)::DOUBLE / sum(n) AS control FROM (SELECT target, d, max(n) AS mode_n, sum(n) AS n FROM tc GROUP BY target, d) GROUP BY target)
        SELECT 'nation' AS det, target, CASE WHEN conflicts > 0 THEN 'ACTIVE_REFUTED' WHEN vals <= 1 THEN 'NEGATIVE_CONTROL_INVARIANT' WHEN control < agreement THEN 'ADVERSARIAL_SURVIVED' ELSE 'OBSERVED_STABLE' END AS status FROM a JOIN f USING (target) LEFT JOIN tm USING (target)""",
    "info_bounds": using("cust") + """, c AS (SELECT nation AS d, region::VARCHAR AS v, count(*) AS n FROM cust WHERE region IS NOT NULL GROUP BY ALL),
        o AS (SELECT a.d, a.v, a.n AS rows_, b.v AS w, b.n - (a.v = b.v)::INT AS n FROM c a JOIN c b ON a.d = b.d WHERE b.n - (a.v = b.v)::INT > 0),
        g AS (SELECT d, v, first(w ORDER BY n DESC, w) AS w FROM o GROUP BY d, v)
        SELECT CASE WHEN w IS NULL THEN 'NO_PEERS' WHEN w = c.v THEN 'RECOVERED' ELSE 'MISSED' END AS outcome, sum(n)::BIGINT AS n_rows FROM c LEFT JOIN g ON c.d = g.d AND c.v = g.v GROUP BY ALL""",
    "type_consensus": f"SELECT event_id AS row_id, 'k' AS field, 'type_outlier' AS code, 'string' AS found, 'integer' AS expected FROM (SELECT event_id, {_DUCK_PROPS} AS raw FROM events) WHERE raw LIKE '%:\"%'",
    "dominant_shape": "SELECT 'k' AS shape, count(*) FILTER (event_id % 50 = 0 OR event_id % 71 <> 0) AS support, count(*) AS observed FROM events",
    "required_key": "SELECT event_id AS row_id, 'k' AS field, 'missing_required_key' AS code FROM events WHERE event_id % 71 = 0 AND event_id % 50 <> 0",
    "enum_domain": using("cust") + "SELECT id AS row_id, CASE WHEN upper(spelled) = segment THEN 'enum_representation_variant' ELSE 'enum_domain_outlier' END AS code, spelled AS old_value, CASE WHEN upper(spelled) = segment THEN segment END AS new_value FROM cust WHERE spelled <> segment",
    "agg_profile": using("ord") + " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS present, count(DISTINCT {c}) AS distinct_values, min({c}::VARCHAR) AS least, max({c}::VARCHAR) AS most FROM ord" for c in ("status", "priority", "customer_id")),
    "agg_heavy_hitters": "SELECT l_suppkey::VARCHAR AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 64",
    "regime_detect": using("item") + "SELECT 'flag' AS field, count(DISTINCT flag) AS regimes, 1.0::DOUBLE - greatest(sum((flag = 'R')::INT), sum((flag <> 'R')::INT))::DOUBLE / count(*) AS gain FROM item",
    "regime_analyze": using("item") + """, c AS (SELECT flag, state, CASE WHEN order_id % 1009 = 0 THEN '?' ELSE flag || '-' || state END AS v, count(*) AS n FROM item GROUP BY ALL)
        SELECT flag AS scope, 'state' AS det, 'mark' AS target, sum(top)::BIGINT AS support, sum(n)::BIGINT AS observed FROM (SELECT flag, state, max(n) AS top, sum(n) AS n FROM c GROUP BY flag, state) GROUP BY flag""",
}
