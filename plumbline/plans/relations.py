"""Queries of keys, references, arithmetic and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import aggregates as agg
from ..operators import arithmetic as ar
from ..operators import references as ref
from .inputs import t, using, view


def id_uniqueness(spark, d):
    return ref.uniqueness(t(spark, d, "orders"), ["o_orderkey", "o_custkey"])


def duplicate_identifier(spark, d):
    return ref.duplicates(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])




def _customers(spark, d):
    return t(spark, d, "customer").selectExpr("concat('C', c_custkey) AS cid")


def _refs(spark, d):
    return view(spark, d, "ord").selectExpr("id", "CASE WHEN id % 307 = 0 THEN concat('c', customer_id) ELSE concat('C', broken_customer) END AS ref")


def fk_reference(spark, d):
    return ref.dangling(_refs(spark, d), "id", "ref", _customers(spark, d), "cid")


def join_cross_document(spark, d):
    return ref.dangling(_refs(spark, d), "id", "ref", _customers(spark, d), "cid", "cross_document_")


def join_semi_overlap(spark, d):
    registries = {"customer": (t(spark, d, "customer"), "c_custkey"), "supplier": (t(spark, d, "supplier"), "s_suppkey"), "part": (t(spark, d, "part"), "p_partkey")}
    return ref.overlaps(view(spark, d, "ord"), "broken_customer", registries)



def join_anti_dangling(spark, d):
    return view(spark, d, "ord").join(t(spark, d, "customer"), F.col("broken_customer") == F.col("c_custkey"), "left_anti").select("id", "broken_customer")


def join_casefold(spark, d):
    a = view(spark, d, "cust").select("id", "spelled")
    b = t(spark, d, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    return a.join(F.broadcast(b), F.lower("spelled") == F.lower("segment")).where("spelled <> segment").select("id", "spelled", "segment")  # a domain of at most 16


def join_lookup_equi(spark, d):
    return t(spark, d, "supplier").join(F.broadcast(t(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")  # nations are 25


def join_full_outer_residue(spark, d):
    rows = t(spark, d, "lineitem").selectExpr("l_orderkey AS order_id", "l_suppkey AS supplier", "CAST(l_quantity AS BIGINT) AS quantity", "l_linenumber AS line")
    other = rows.selectExpr("order_id", "supplier", "quantity + CASE WHEN order_id % 501 = 0 AND line = 1 THEN 2 ELSE 0 END AS quantity")
    return ref.residue(rows.drop("line"), other, "order_id", "supplier", "quantity")


def join_neighbour(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t(spark, d, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


def join_event_latest(spark, d):
    return ref.latest_event(t(spark, d, "events"), "user_id", "event_id", "event_type")



def arith_binary(spark, d):
    return ar.binary(view(spark, d, "item"), ["quantity", "discount", "tax", "charge"])


def arith_violations(spark, d):
    df = view(spark, d, "part2")
    return ar.violations(df, "id", [("tripled", "size", "+", "doubled")])


def arith_consensus(spark, d):
    df = view(spark, d, "part2").withColumn("three", F.lit(3))
    return ar.consensus(ar.violations(df, "id", [("tripled", "size", "+", "doubled"), ("tripled", "size", "*", "three")]))


def arith_sparse_recovery(spark, d):
    df = t(spark, d, "part").selectExpr("p_partkey AS id", "p_size AS a", "CAST(p_partkey AS BIGINT) AS b", "p_size + CAST(p_partkey AS BIGINT) + CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey AS BIGINT) * p_partkey ELSE 0 END AS total")
    return ar.sparse(df, "id", ("total", "a", "+", "b"))


def arith_direction(spark, d):
    raw = t(spark, d, "part").selectExpr("CASE WHEN p_partkey % 20 = 0 THEN to_json(named_struct('total', 1, 'a', 2, 'b', 3)) ELSE to_json(named_struct('a', 2, 'b', 3, 'total', 1)) END AS raw")
    return ar.direction(raw.select(F.json_object_keys("raw").alias("keys")), ["a", "b"], "total")


def balance_4(spark, d):
    df = t(spark, d, "part").selectExpr("p_size AS a", "CAST(p_partkey AS INT) AS b", "p_size + 5 AS c", "CAST(p_partkey - 5 + CASE WHEN p_partkey % 97 = 0 THEN 1 ELSE 0 END AS INT) AS d")
    return ar.balances(df, ["a", "b", "c", "d"])


def temporal_delta(spark, d):
    df = t(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderdate AS start", "CASE WHEN o_orderkey % 103 = 0 THEN o_orderdate + INTERVAL 9 DAY WHEN o_orderkey % 107 = 0 THEN NULL ELSE o_orderdate + INTERVAL 3 DAY END AS end")
    return ar.time_offset(df, "id", "start", "end")


def sequence_step(spark, d):
    df = t(spark, d, "events").selectExpr("event_id", "event_id % 50 AS stream", "CASE WHEN event_id % 333 = 0 THEN -1 ELSE event_id * 2 END AS n")
    return ar.sequence(df, "event_id", "n", "stream")


def win_lag_diff(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t(spark, d, "events").select("event_id", F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")).alias("gap"))


def win_top1(spark, d):
    counts = t(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return ref.top_with_ties(counts, "l_suppkey", "n", "l_returnflag")


def win_fold_parity(spark, d):
    return t(spark, d, "orders").groupBy(F.pmod("o_orderkey", F.lit(2)).alias("fold"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))



def win_lag_one_control(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t(spark, d, "orders").withColumn("before", F.lag("o_orderstatus").over(w)).groupBy("before", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def win_symmetry_orbit(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", F.sha2(F.concat_ws("|", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int")), 256).alias("member"))
    return rows.groupBy("l_orderkey", "member").agg(F.count(F.lit(1)).alias("orbit")).where("orbit > 1")


def _parents(spark, d):
    sums = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"), F.count(F.lit(1)).alias("c"))
    fault = F.when(F.col("l_orderkey") % 173 == 0, 1).otherwise(0)
    return sums.select("l_orderkey", (F.col("q") + fault).alias("total"), (F.col("c") + fault).alias("item_count"))


def agg_sum(spark, d):
    return agg.discover(_parents(spark, d), "l_orderkey", "total", t(spark, d, "lineitem"), "l_orderkey", F.col("l_quantity"), "sum")[1]


def agg_count(spark, d):
    return agg.discover(_parents(spark, d), "l_orderkey", "item_count", t(spark, d, "lineitem"), "l_orderkey", F.lit(1), "count")[1]


cons_aggregate_sum, cons_aggregate_count = agg_sum, agg_count


def cons_balance(spark, d):
    df = t(spark, d, "part").selectExpr("p_partkey AS id", "p_size AS opening", "CAST(p_partkey % 7 AS INT) AS received", "CAST(p_partkey % 3 AS INT) AS sold", "CAST(p_size + p_partkey % 7 - p_partkey % 3 + CASE WHEN p_partkey % 59 = 0 THEN 100 ELSE 0 END AS INT) AS closing")
    return agg.linear_balance(df, "id", {"opening": 1, "received": 1, "sold": -1, "closing": -1}, "closing")


def _moments(spark, d):
    return agg.moments(t(spark, d, "lineitem"), "l_orderkey", F.col("l_quantity"), F.col("l_linenumber"))


def mom_weighted_sum(spark, d):
    return _moments(spark, d).select("row_id", "weighted_sum")


def mom_weighted_mean(spark, d):
    made = _moments(spark, d)
    found = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.round(F.avg("l_quantity"), 3).cast("decimal(38,3)").alias("value"))
    return agg.check_mean(found, made).select("row_id", "old_value", "new_value")


def mom_variance(spark, d):
    return agg.moments(t(spark, d, "lineitem"), "l_orderkey", F.col("l_quantity"), ddof=1).select("row_id", F.col("cov_num").alias("num"), F.col("cov_den").alias("den"))


def mom_covariance(spark, d):
    return agg.moments(t(spark, d, "lineitem"), "l_suppkey", F.col("l_quantity"), other=F.col("l_linenumber")).select("row_id", F.col("cov_num").alias("num"), F.col("cov_den").alias("den"))


def mom_probability_total(spark, d):
    p = t(spark, d, "lineitem").select("l_orderkey", F.col("l_discount").cast("decimal(9,4)").alias("p"))
    total = p.groupBy("l_orderkey").agg(F.sum("p").alias("total"), F.count(F.when((F.col("p") < 0) | (F.col("p") > 1), 1)).alias("out_of_range"))
    return total.where("total <> 1").select("l_orderkey", F.col("total").cast("decimal(38,4)").alias("total"), "out_of_range")


def mom_uncertainty_variance(spark, d):
    u = t(spark, d, "lineitem").select("l_orderkey", F.col("l_tax").cast("decimal(9,4)").alias("u"))
    return u.groupBy("l_orderkey").agg(F.sum((F.col("u") * F.col("u")).cast("decimal(18,8)")).cast("decimal(38,8)").alias("variance"))


def mom_unit_normalize(spark, d):
    table = spark.createDataFrame([("cm", "0.01", 0, "m"), ("m", "1", 0, "m"), ("km", "1000", 0, "m")], "unit string, scale string, offset int, base string")
    df = t(spark, d, "part").selectExpr("p_partkey AS id", "p_size AS value", "CASE p_partkey % 3 WHEN 0 THEN 'cm' WHEN 1 THEN 'm' ELSE 'km' END AS unit")
    return agg.unit_normalise(df, "id", "value", "unit", table)


def agg_distinct(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_suppkey").alias("suppliers"))


def agg_hash_counter(spark, d):
    return t(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


def agg_mode(spark, d):
    counts = t(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("l_suppkey").agg(F.min_by("l_returnflag", F.struct(F.negative("n"), "l_returnflag")).alias("mode"))


def agg_mode_lex(spark, d):
    counts = t(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("l_suppkey").agg(F.max_by("l_returnflag", F.struct("n", "l_returnflag")).alias("mode"))



def agg_sum_issue_score(spark, d):
    """Weighted count of issues: error 10, warning 3, information 1."""
    weight = F.when(F.col("code") == "dangling_reference", 10).when(F.col("code").endswith("variant"), 3).otherwise(1)
    return fk_reference(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("score"))




def agg_status_counts(spark, d):
    return view(spark, d, "ord").groupBy("status", "priority").agg(F.count(F.lit(1)).alias("n"))


_NAMES = """id_uniqueness duplicate_identifier fk_reference join_cross_document join_semi_overlap join_anti_dangling join_casefold join_lookup_equi join_full_outer_residue join_neighbour join_event_latest arith_binary arith_violations arith_consensus arith_sparse_recovery arith_direction balance_4 temporal_delta sequence_step win_lag_diff win_top1 win_fold_parity win_lag_one_control win_symmetry_orbit agg_sum agg_count cons_balance mom_weighted_sum mom_weighted_mean mom_variance mom_covariance mom_probability_total mom_uncertainty_variance mom_unit_normalize agg_distinct agg_hash_counter agg_mode agg_mode_lex agg_sum_issue_score agg_status_counts"""
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_DUP = "SELECT l_orderkey, l_linenumber, count(*) AS occurrences, 'duplicate_identifier' AS code FROM lineitem GROUP BY ALL HAVING count(*) > 1"
_FK = using("ord") + ", r AS (SELECT id, CASE WHEN id % 307 = 0 THEN concat('c', customer_id) ELSE concat('C', broken_customer) END AS ref FROM ord), c AS (SELECT concat('C', c_custkey) AS cid FROM customer), x AS (SELECT id AS row_id, ref AS old_value, (SELECT min(cid) FROM c WHERE lower(cid) = lower(ref)) AS new_value FROM r WHERE ref NOT IN (SELECT cid FROM c))"
_FK_ROWS = "SELECT row_id, CASE WHEN new_value IS NULL THEN '{0}dangling_reference' ELSE '{0}reference_representation_variant' END AS code, old_value, new_value FROM x"
_RESIDUE = """WITH a AS (SELECT l_orderkey AS order_id, l_suppkey AS supplier, sum(l_quantity::BIGINT)::BIGINT AS q, sum(CASE WHEN l_orderkey % 501 = 0 AND l_linenumber = 1 THEN 2 ELSE 0 END)::BIGINT AS e FROM lineitem GROUP BY ALL)
SELECT order_id, supplier, q AS left_quantity, q + e AS right_quantity, -e AS difference FROM a WHERE e <> 0"""
_SUMS = "WITH s AS (SELECT l_orderkey AS row_id, sum(l_quantity::BIGINT)::BIGINT AS q, count(*) AS c FROM lineitem GROUP BY ALL) "
_SUM = _SUMS + "SELECT row_id, 'aggregate_sum_violation' AS code, (q + 1)::DECIMAL(38,9) AS old_value, q::DECIMAL(38,9) AS new_value FROM s WHERE row_id % 173 = 0"
_COUNT = _SUMS + "SELECT row_id, 'aggregate_count_violation' AS code, (c + 1)::DECIMAL(38,9) AS old_value, c::DECIMAL(38,9) AS new_value FROM s WHERE row_id % 173 = 0"
_SCORE = _FK + "SELECT code, count(*) AS n, sum(CASE WHEN code = 'dangling_reference' THEN 10 ELSE 3 END)::BIGINT AS score FROM (" + _FK_ROWS.format("") + ") GROUP BY code"
ORACLES = {
    "id_uniqueness": "SELECT * FROM (SELECT 'o_orderkey' AS field, count(o_orderkey) AS present, count(DISTINCT o_orderkey) AS distinct_values, count(DISTINCT o_orderkey)::DOUBLE / count(o_orderkey) AS confidence, count(DISTINCT o_orderkey) = count(o_orderkey) AS registry FROM orders UNION ALL SELECT 'o_custkey', count(o_custkey), count(DISTINCT o_custkey), count(DISTINCT o_custkey)::DOUBLE / count(o_custkey), false FROM orders) WHERE confidence >= 0.9",
    "duplicate_identifier": _DUP, 
    "fk_reference": _FK + _FK_ROWS.format(""), "join_cross_document": _FK + _FK_ROWS.format("cross_document_"),
    "join_semi_overlap": using("ord") + " UNION ALL ".join(f"SELECT '{n}' AS target, count(*) FILTER (broken_customer IN (SELECT {k} FROM {n})) AS overlap, count(*) AS observed, count(*) FILTER (broken_customer IN (SELECT {k} FROM {n}))::DOUBLE / count(*) AS confidence FROM ord" for n, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))),
    "join_anti_dangling": using("ord") + "SELECT id, broken_customer FROM ord ANTI JOIN customer ON broken_customer = c_custkey",
    "join_casefold": using("cust") + "SELECT id, spelled, segment FROM cust WHERE spelled <> segment AND lower(spelled) = lower(segment)",
    "join_lookup_equi": "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "join_full_outer_residue": _RESIDUE, 
    "join_neighbour": "SELECT conv_id, turn, role, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "join_event_latest": "SELECT user_id AS path, arg_max(event_type, event_id) AS value, max(event_id) AS ordinal FROM events GROUP BY user_id",
    "arith_binary": using("item") + "SELECT * FROM (SELECT 'charge' AS target, 'discount' AS a, '+' AS op, 'quantity' AS b, count(*) FILTER (charge = quantity + discount) AS support, count(*) AS decided, count(*) FILTER (charge = quantity + discount)::DOUBLE / count(*) AS confidence FROM item UNION ALL SELECT 'discount', 'charge', '-', 'quantity', count(*) FILTER (charge = quantity + discount), count(*), count(*) FILTER (charge = quantity + discount)::DOUBLE / count(*) FROM item UNION ALL SELECT 'quantity', 'charge', '-', 'discount', count(*) FILTER (charge = quantity + discount), count(*), count(*) FILTER (charge = quantity + discount)::DOUBLE / count(*) FROM item)",
    "arith_violations": using("part2") + "SELECT id AS row_id, 'tripled' AS target, 'size + doubled' AS formula, tripled::DECIMAL(38,9) AS old_value, (size + doubled)::DECIMAL(38,9) AS new_value, 'exact_arithmetic_violation' AS code FROM part2 WHERE tripled <> size + doubled",
    "arith_consensus": using("part2") + "SELECT id AS row_id, 'tripled' AS target, 2::BIGINT AS formulas, (3 * size)::DECIMAL(38,9) AS new_value FROM part2 WHERE tripled <> 3 * size",
    "arith_sparse_recovery": "SELECT p_partkey AS row_id, (p_size + p_partkey + p_partkey::BIGINT * p_partkey)::DECIMAL(38,9) AS old_value, (p_size + p_partkey)::DECIMAL(38,9) AS new_value FROM part WHERE p_partkey % 5 = 0 AND p_partkey > 0",
    "arith_direction": "SELECT count(*) AS decided, count(*) FILTER (p_partkey % 20 <> 0) AS before, count(*) >= 4 AND count(*) FILTER (p_partkey % 20 <> 0) >= 0.9 * count(*) AS directed FROM part",
    "balance_4": "SELECT 'a+b' AS left_side, 'c+d' AS right_side, count(*) FILTER (p_partkey % 97 <> 0) AS support, count(*) AS decided FROM part",
    "temporal_delta": """WITH x AS (SELECT o_orderkey AS id, o_orderdate::TIMESTAMP AS s, CASE WHEN o_orderkey % 103 = 0 THEN o_orderdate::TIMESTAMP + INTERVAL 9 DAY WHEN o_orderkey % 107 = 0 THEN NULL ELSE o_orderdate::TIMESTAMP + INTERVAL 3 DAY END AS e FROM orders), c AS (SELECT epoch(e)::BIGINT - epoch(s)::BIGINT AS delta, count(*) AS n FROM x WHERE e IS NOT NULL GROUP BY 1),
        b AS (SELECT first(delta ORDER BY n DESC, delta) AS off FROM c HAVING sum(n) >= 4 AND max(n)::DOUBLE / sum(n) >= 0.95 AND first(delta ORDER BY n DESC, delta) >= 0)
        SELECT id AS row_id, CASE WHEN e IS NULL THEN 'missing_temporal_endpoint' ELSE 'temporal_delta_violation' END AS code, s + to_seconds(off) AS new_value FROM x, b WHERE e IS NULL OR epoch(e)::BIGINT - epoch(s)::BIGINT <> off""",
    "sequence_step": """WITH r AS (SELECT event_id, event_id % 50 AS stream, CASE WHEN event_id % 333 = 0 THEN -1 ELSE event_id * 2 END AS n FROM events), x AS (SELECT *, lag(n) OVER w AS before, lead(n) OVER w AS after FROM r WINDOW w AS (PARTITION BY stream ORDER BY event_id))
        SELECT stream AS part, event_id AS row_id, 'sequence_violation' AS code, n AS old_value, before + 100 AS new_value FROM x WHERE before + 100 = after - 100 AND n <> before + 100""",
    "win_lag_diff": "SELECT event_id, ((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id))) // 1000000)::BIGINT AS gap FROM events",
    "win_top1": "WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT l_suppkey, max(n) AS m FROM c GROUP BY 1) SELECT c.l_suppkey, min(l_returnflag) AS item, count(*) > 1 AS tied FROM c JOIN m ON c.l_suppkey = m.l_suppkey AND n = m GROUP BY 1",
    "win_fold_parity": "SELECT o_orderkey % 2 AS fold, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL",
    "win_lag_one_control": "SELECT before, o_orderstatus, count(*) AS n FROM (SELECT o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) GROUP BY ALL",
    "win_symmetry_orbit": "SELECT l_orderkey, sha256(concat_ws('|', l_returnflag, l_linestatus, l_quantity::INT::VARCHAR)) AS member, count(*) AS orbit FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "agg_sum": _SUM, "agg_count": _COUNT, 
    "cons_balance": "WITH x AS (SELECT p_partkey AS id, p_size AS opening, p_partkey % 7 AS received, p_partkey % 3 AS sold, p_size + p_partkey % 7 - p_partkey % 3 + CASE WHEN p_partkey % 59 = 0 THEN 100 ELSE 0 END AS closing FROM part) SELECT id AS row_id, closing::DECIMAL(38,9) AS old_value, (opening + received - sold)::DECIMAL(38,9) AS new_value, 'conservation_violation' AS code FROM x WHERE opening + received - sold - closing <> 0",
    "mom_weighted_sum": "SELECT l_orderkey AS row_id, sum(l_quantity::DECIMAL(18,4) * l_linenumber)::DECIMAL(38,9) AS weighted_sum FROM lineitem GROUP BY 1",
    "mom_weighted_mean": "WITH g AS (SELECT l_orderkey AS row_id, sum(l_quantity::BIGINT * l_linenumber)::BIGINT AS num, sum(l_linenumber)::BIGINT AS den, round(avg(l_quantity), 3)::DECIMAL(38,3) AS v FROM lineitem GROUP BY 1), q AS (SELECT *, (num * 1000000000 // den + CASE WHEN 2 * (num * 1000000000 % den) >= den THEN 1 ELSE 0 END) AS nano FROM g) SELECT row_id, v::DECIMAL(38,9) AS old_value, CASE WHEN nano * den = num * 1000000000 THEN (nano::DECIMAL(38,9) * 0.000000001)::DECIMAL(38,9) END AS new_value FROM q WHERE v * den <> num",
    "mom_variance": "SELECT l_orderkey AS row_id, (count(*) * sum(l_quantity::BIGINT * l_quantity::BIGINT) - sum(l_quantity::BIGINT) * sum(l_quantity::BIGINT))::DECIMAL(38,8) AS num, CASE WHEN count(*) > 1 THEN count(*) * (count(*) - 1) END AS den FROM lineitem GROUP BY 1",
    "mom_covariance": "SELECT l_suppkey AS row_id, (count(*) * sum(l_quantity::BIGINT * l_linenumber) - sum(l_quantity::BIGINT) * sum(l_linenumber))::DECIMAL(38,8) AS num, count(*) * count(*) AS den FROM lineitem GROUP BY 1",
    "mom_probability_total": "SELECT l_orderkey, sum(l_discount::DECIMAL(9,4))::DECIMAL(38,4) AS total, count(*) FILTER (l_discount < 0 OR l_discount > 1) AS out_of_range FROM lineitem GROUP BY 1 HAVING sum(l_discount::DECIMAL(9,4)) <> 1",
    "mom_uncertainty_variance": "SELECT l_orderkey, sum(l_tax::DECIMAL(9,4) * l_tax::DECIMAL(9,4))::DECIMAL(38,8) AS variance FROM lineitem GROUP BY 1",
    "mom_unit_normalize": "SELECT p_partkey AS row_id, p_size::DECIMAL(38,9) AS old_value, CASE p_partkey % 3 WHEN 0 THEN 'cm' ELSE 'km' END AS old_unit, (CASE p_partkey % 3 WHEN 0 THEN p_size::DECIMAL(18,2) * 0.01 ELSE p_size::DECIMAL(18,2) * 1000 END)::DECIMAL(38,9) AS new_value, 'm' AS new_unit FROM part WHERE p_partkey % 3 <> 1",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1",
    "agg_hash_counter": "SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL",
    "agg_mode": "SELECT l_suppkey, first(l_returnflag ORDER BY n DESC, l_returnflag) AS mode FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1",
    "agg_mode_lex": "SELECT l_suppkey, first(l_returnflag ORDER BY n DESC, l_returnflag DESC) AS mode FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1",
    "agg_sum_issue_score": _SCORE, 
    "agg_status_counts": using("ord") + "SELECT status, priority, count(*) AS n FROM ord GROUP BY ALL",
}
