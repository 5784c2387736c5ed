"""Queries of conflicts between candidates, governance, context sources, structure and certificates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import arithmetic as ar
from ..operators import certificates as ct
from ..operators import conflicts as cf
from ..operators import context as cx
from ..operators import dependencies as dep
from ..operators import governance as gv
from ..operators import repair as rp
from ..operators import structure as st
from ..sources.shared import cutter, dealt, shared_folder
from .inputs import t, using, view

#: Options that Spark and the SQL read alike.
_OPTIONS = """SELECT p_partkey AS row_id, 'a' AS option_id, '/x' AS path, CASE WHEN p_partkey % 6 = 0 THEN '{"y":1}' ELSE CAST(p_size AS STRING) END AS value FROM part UNION ALL SELECT p_partkey, 'b', '/x/y', '1' FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'c', '/z', p_brand FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'd', '/z', CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE 'q' END FROM part WHERE p_partkey % 4 = 0"""


def _sql(spark, d, sql, *tables):
    for name in tables:
        t(spark, d, name).createOrReplaceTempView(f"_in_{name}")
        sql = sql.replace(f"FROM {name}", f"FROM _in_{name}").replace(f"JOIN {name}", f"JOIN _in_{name}")
    return spark.sql(sql)


def _options(spark, d):
    return _sql(spark, d, _OPTIONS, "part")


def factorize(spark, d):
    """Options of a row whose paths lie over each other, directly or through others, are one block."""
    return cf.blocks(_options(spark, d), cutter(spark))


def rewrite_algebra(spark, d):
    return cf.critical_pairs(_options(spark, d))


def confluence(spark, d):
    return cf.confluent(_options(spark, d))


def min_transfer(spark, d):
    """Of each block the cheapest set of options that mends most."""
    options = _options(spark, d).join(cf.blocks(_options(spark, d), cutter(spark)), ["row_id", "option_id"])
    resolves = F.when(F.col("option_id") == "a", F.array(F.lit(1))).when(F.col("option_id") == "b", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(3)))
    made = cf.least_transfer(options.withColumns({"resolves": resolves, "cost": F.lit(1)}))
    return made.select("row_id", "block", F.array_join("taken", ",").alias("taken"), "resolved", "status")


_CUST = using("cust")


def _analyses():
    by_fd = lambda df: dep.functional(df, "id", [], [("nation", "region")])[1].select("row_id", F.lit("region").alias("field"), "old_value", "new_value", F.lit("fd").alias("analyzer"), F.lit(1).alias("tier"))
    by_rule = lambda df: df.where("region is null or region <> nation % 5").select(F.col("id").alias("row_id"), F.lit("region").alias("field"), F.col("region").cast("string").alias("old_value"), (F.col("nation") % 5).cast("string").alias("new_value"), F.lit("rule").alias("analyzer"), F.lit(2).alias("tier"))
    shift = lambda df: df.where("region is null").select(F.col("id").alias("row_id"), F.lit("region").alias("field"), F.lit(None).cast("string").alias("old_value"), F.lit("9").alias("new_value"), F.lit("guess").alias("analyzer"), F.lit(1).alias("tier"))
    return by_fd, by_rule, shift


def parallel_routes(spark, d):
    """Two orders of analyses run to their ends: they agree, so the repairs are accepted."""
    df, (by_fd, by_rule, _) = view(spark, d, "cust").select("id", "nation", "region"), _analyses()
    return cf.agreed(cf.routes(df, "id", ["region"], {"fd first": [by_fd, by_rule], "rule first": [by_rule, by_fd]}, cutter(spark)))


def parallel_routes_refused(spark, d):
    """Routes that end in different tables."""
    df, (by_fd, _, shift) = view(spark, d, "cust").select("id", "nation", "region"), _analyses()
    return cf.agreed(cf.routes(df, "id", ["region"], {"fd": [by_fd], "guess": [shift]}, cutter(spark)))


def symmetry_block(spark, d):
    """Options that touch equal lines of one order."""
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.lit("/lines").alias("array_path"), F.col("l_linenumber").alias("position"), F.concat_ws("|", "l_returnflag", "l_linestatus").alias("member"))
    options = lines.where("position <= 3").select("row_id", "array_path", "position", F.concat(F.lit("o"), "position").alias("option_id"))
    return cf.symmetric(options, lines)


def causal_cone(spark, d):
    """What depends on what, over relations that were found in the data."""
    found = ar.binary(view(spark, d, "item"), ["charge", "discount", "quantity", "tax"]).select(F.array("a", "b").alias("inputs"), F.col("target").alias("output"))
    return cf.cones(found, cutter(spark)).select("field", F.array_join("backward", ",").alias("backward"), F.array_join("forward", ",").alias("forward"))


def causal_dominance(spark, d):
    """Candidates evaluated on the row that each would make: one that mends fewer rules than another is dropped."""
    df = t(spark, d, "part").selectExpr("p_partkey AS id", "p_size AS size", "CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS twin", "CASE WHEN p_partkey % 7 = 0 THEN 3 * p_size + 1 ELSE 3 * p_size END AS triple")
    bad = df.where("id % 7 = 0").selectExpr("id AS row_id", "explode(array(named_struct('option_id', 'low', 'field', 'size', 'new_value', CAST(size + 1 AS STRING)), named_struct('option_id', 'twin', 'field', 'twin', 'new_value', CAST(size AS STRING)), named_struct('option_id', 'none', 'field', 'twin', 'new_value', CAST(size + 2 AS STRING)))) AS x").select("row_id", "x.*")
    rules = {"twin": F.col("twin") == F.col("size"), "triple": F.col("triple") == 3 * F.col("size"), "near": F.abs(F.col("triple") - 3 * F.col("size")) <= 2}
    return cf.dominated(cf.resolved_sets(df, "id", bad, rules, ["size", "twin"]))


_CAND = """, base AS (SELECT id AS row_id, '/region' AS field, CAST(region AS STRING) AS old_value, nation FROM cust WHERE id % 97 = 0 OR id % 89 = 0),
k AS (SELECT row_id, field, old_value, CAST(nation % 5 AS STRING) AS new_value, 'fd' AS analyzer, 1 AS tier FROM base UNION ALL SELECT row_id, field, old_value, CAST(nation % 4 AS STRING), 'rule', CASE WHEN row_id % 8 = 0 THEN 3 ELSE 1 END FROM base WHERE row_id % 2 = 0
UNION ALL SELECT row_id, field, old_value, '9', 'source', 3 FROM base WHERE row_id % 16 = 0 UNION ALL SELECT row_id, '/segment', 'x', 'y', 'fd', 1 FROM base WHERE row_id % 3 = 0 UNION ALL SELECT row_id, '/region/name', 'x', 'y', 'fd', 1 FROM base WHERE row_id % 5 = 0)
"""


def _candidates(spark, d):
    view(spark, d, "cust").createOrReplaceTempView("cust")
    return spark.sql("WITH " + _CAND.lstrip(", ") + "SELECT * FROM k")


def federation(spark, d):
    """What actors agree on."""
    return gv.federate(_candidates(spark, d))[0].select("row_id", "field", "new_value", F.array_join("actors", ",").alias("actors"))


def federation_conflicts(spark, d):
    says = F.array_join(F.transform("says", lambda s: F.concat(s["new_value"], F.lit(":"), F.array_join(s["actors"], ","))), ";")
    return gv.federate(_candidates(spark, d))[1].select("row_id", "field", says.alias("says"))


def federation_packets(spark, d):
    return gv.packets(_candidates(spark, d))


def federation_pairs(spark, d):
    return gv.active_pairs(_candidates(spark, d))


def federation_compose(spark, d):
    """Relations that follow from customer to region by way of the nation, and from order to region by way of both."""
    edges = spark.createDataFrame([("orders", "customer"), ("customer", "nation"), ("nation", "region")], "src string, dst string")
    fields = t(spark, d, "region").limit(1).select(F.lit("region").alias("src"), F.lit("name").alias("dst"))
    return gv.compose(edges.unionByName(fields), cutter(spark))


def fast_select(spark, d):
    return gv.select_with_evidence(_candidates(spark, d))[0].select("row_id", "field", "new_value")


def fast_select_deferred(spark, d):
    return gv.select_with_evidence(_candidates(spark, d), least=2)[1]


def identifiability(spark, d):
    """Cells by what their sources leave open: candidates, and for some an enumeration."""
    c = _candidates(spark, d)
    domains = c.select("row_id", "field", F.col("analyzer").alias("source"), F.col("new_value").alias("value")).unionByName(c.where("row_id % 11 = 0").select("row_id", "field", F.lit("enum").alias("source"), F.explode(F.array(*map(F.lit, "01234"))).alias("value")))
    return gv.identify(c.unionByName(c.limit(0)).select("row_id", "field").unionByName(c.where("row_id % 7 = 0").select("row_id", F.lit("/other").alias("field"))), domains)


def fw_control(spark, d):
    """Immutable paths, operations and a budget."""
    rules = [{"path": "/region/**", "budget": 5}, {"path": "/segment", "immutable": True}, {"path": "/region/name", "operations": ["add"]}]
    return gv.control(_candidates(spark, d).where("tier = 1"), rules)[1].select("row_id", "field", "reason").distinct()


def fw_boundary(spark, d):
    """Candidates that would break a rule of the row that they change; contradictory bounds block all of a field."""
    df = view(spark, d, "cust").select("id", "nation", "region")
    k = _candidates(spark, d).where("field = '/region'").select("row_id", F.concat_ws(":", "analyzer", "new_value").alias("option_id"), F.lit("region").alias("field"), "new_value")
    found = cf.resolved_sets(df, "id", k, {"range": F.col("region").between(0, 3), "parity": (F.col("region") + F.col("nation")) >= 2}, ["region"])
    return found.where("size(introduced) = 0").select("row_id", "option_id")


def fw_robust(spark, d):
    """Uncertainty, hysteresis, clock and regime."""
    k = _candidates(spark, d).where("field = '/region'").unionByName(_candidates(spark, d).where("field = '/segment'").withColumns({"old_value": F.lit("1"), "new_value": F.lit("9")}))
    rules = spark.createDataFrame([("/region", "1", None, None, None, "1"), ("/segment", None, "2024-01-01 00:00:00", 3600, None, None)], "field string, radius string, observed_at string, max_age long, regime string, hysteresis string")
    rules = rules.withColumns({"radius": fn.exact("radius"), "hysteresis": fn.exact("hysteresis"), "observed_at": F.col("observed_at").cast("timestamp")})
    return gv.robust(k, rules, F.lit("2024-01-02 00:00:00").cast("timestamp")).select("row_id", "field", "analyzer", "gate")


def fw_semantic(spark, d):
    """Rules and the sources that they claim to come from."""
    n = t(spark, d, "nation")
    sources = n.select(F.concat(F.lit("s"), "n_nationkey").alias("source_id"), F.col("n_name").alias("text"))
    rules = n.select(F.concat(F.lit("r"), "n_nationkey").alias("rule_id"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.lower("n_name")).alias("text"), F.when(F.col("n_nationkey") % 5 == 0, "INFERRED").otherwise("SOURCE_EXACT").alias("claim"), F.concat(F.lit("s"), "n_nationkey").alias("source_id"))
    made = n.select(F.concat(F.lit("d"), "n_nationkey").alias("rule_id"), F.lit("derived").alias("text"), F.lit("DERIVED_EXACT").alias("claim"), F.lit(None).cast("string").alias("source_id"))
    parents = n.select(F.concat(F.lit("d"), "n_nationkey").alias("rule_id"), F.concat(F.lit("r"), "n_nationkey").alias("parent_id"))
    return gv.verified_rules(rules.unionByName(made), sources, parents, cutter(spark)).select("rule_id", "provenance", "active")


def authority_scope(spark, d):
    """Customers ask to change their orders: direct scopes by segment, delegations between nations, times and versions."""
    asks = t(spark, d, "customer").selectExpr("c_custkey AS request_id", "concat('n', c_nationkey) AS source_id", "CASE WHEN c_custkey % 5 = 0 THEN '/orders/1/price' ELSE '/orders/1/status' END AS path", "CASE WHEN c_custkey % 7 = 0 THEN 'remove' ELSE 'replace' END AS operation", "'doc' AS document", "'v1' AS version", "CASE WHEN c_custkey % 11 = 0 THEN CAST('2030-01-01' AS TIMESTAMP) ELSE CAST('2024-01-01' AS TIMESTAMP) END AS at")
    n = t(spark, d, "nation")
    columns = ["'/orders/*/status' AS path_glob", "'replace' AS operation", "'*' AS document", "'v1' AS version", "CAST(NULL AS TIMESTAMP) AS valid_from", "CAST('2025-01-01' AS TIMESTAMP) AS valid_until"]
    scopes = n.where("n_nationkey % 6 = 0").selectExpr("concat('n', n_nationkey) AS source_id", *columns)
    delegations = n.where("n_nationkey > 0").selectExpr("concat('d', lpad(n_nationkey, 2, '0')) AS delegation_id", "concat('n', n_nationkey - 1) AS grantor", "concat('n', n_nationkey) AS delegate", "n_nationkey % 6 = 4 AS revoked", *columns)
    return gv.authorise(asks, scopes, delegations, cutter(spark)).select("request_id", "authorised", "reason", F.array_join("chain", ",").alias("chain"))


def multisource_lifecycle(spark, d):
    """Dependencies learnt on two thirds of the customers and tested on the rest, by the group that each comes from."""
    df = view(spark, d, "cust").where("id % 97 <> 0").withColumn("copied", F.col("segment"))
    held = df.where("id % 3 = 0").withColumn("source_group", F.when(F.col("id") % 6 == 0, F.col("segment")))
    return cx.lifecycle(df.where("id % 3 <> 0"), held, [("nation", "region"), ("nation", "segment"), ("segment", "copied")])


def _sources(spark, d):
    c = t(spark, d, "customer")
    auth = [c.where("c_custkey % 200 = 0").selectExpr("c_custkey AS row_id", "7 AS value"), c.where("c_custkey % 400 = 0").selectExpr("c_custkey AS row_id", "CASE WHEN c_custkey % 800 = 0 THEN 7 ELSE 8 END AS value")]
    log = t(spark, d, "events").where("user_id % 50 = 0").selectExpr("user_id AS row_id", "event_id AS ordinal", "event_id % 10 AS value")
    return c.selectExpr("c_custkey AS row_id", "-1 AS value"), auth, log


def multisource_assimilate(spark, d):
    """Authorities override, the log's last value comes next, defaults fill what is missing."""
    defaults, auth, log = _sources(spark, d)
    return cx.assimilate(view(spark, d, "cust"), "id", "region", defaults, auth, log)[0].select("row_id", "new_value", "analyzer", "tier")


def multisource_conflicts(spark, d):
    defaults, auth, log = _sources(spark, d)
    return cx.assimilate(view(spark, d, "cust"), "id", "region", defaults, auth, log)[1]


def materialize_witness(spark, d):
    """Missing cells looked up in two sources."""
    lost = view(spark, d, "cust").where("region is null").selectExpr("id AS row_id", "'region' AS field", "CAST(nation AS STRING) AS key")
    n = t(spark, d, "nation")
    first = n.where("n_nationkey < 20").selectExpr("'a' AS source_id", "CAST(n_nationkey AS STRING) AS key", "'region' AS field", "n_regionkey AS value")
    second = n.where("n_nationkey % 3 = 0").selectExpr("'b' AS source_id", "CAST(n_nationkey AS STRING) AS key", "'region' AS field", "n_regionkey + n_nationkey % 2 AS value")
    return cx.witnesses(lost, [first, second])


def join_source_identity(spark, d):
    """Two versions of a table under other names of its columns, aligned and compared."""
    old = t(spark, d, "part").selectExpr("p_partkey AS id", "p_size AS size", "p_brand AS brand")
    new = t(spark, d, "part").selectExpr("p_partkey AS part_id", "CASE WHEN p_partkey % 113 = 0 THEN p_size + 1 ELSE p_size END AS extent", "CASE WHEN p_partkey % 127 = 0 THEN NULL ELSE p_brand END AS brand")
    return cx.compare_versions(old, new, "id", {"part_id": "id", "extent": "size"})


def struct_rename(spark, d):
    """Documents in which one key has another name."""
    raw = t(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 47 = 0 THEN to_json(named_struct('brand', p_brand, 'part_sz', p_size)) WHEN p_partkey % 53 = 0 THEN to_json(named_struct('brand', p_brand, 'part_text', p_brand)) WHEN p_partkey % 59 = 0 THEN to_json(named_struct('brand', p_brand, 'other', p_size)) ELSE to_json(named_struct('brand', p_brand, 'part_size', p_size)) END AS raw")
    return st.moves(raw, "p_partkey", "raw", share=0.9)


def _orders(spark, d):
    line = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 61 == 0, F.concat(F.lit('{"line":'), "l_linenumber", F.lit("}"))).otherwise(F.concat(F.lit('{"line":'), "l_linenumber", F.lit(',"qty":'), F.col("l_quantity").cast("int"), F.lit("}")))
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(line)), ",").alias("lines"))
    return lines.select("l_orderkey", F.concat(F.lit('{"lines":['), "lines", F.lit("]}")).alias("raw"))


def morphology(spark, d):
    """Lines of orders that lack a key that nearly all lines have."""
    return st.morphology(_orders(spark, d), "l_orderkey", "raw")[1].groupBy("row_id", "missing", "code").agg(F.count(F.lit(1)).alias("n"))


def morphology_relations(spark, d):
    return st.morphology(_orders(spark, d), "l_orderkey", "raw")[0].where("container <> ''").select("container", F.array_join("shape", ",").alias("shape"), "support", "observed")


def graph_discover(spark, d):
    """Documents that hold a graph, by the names and keys of its lists; one whose edges don't agree on a key is none."""
    raw = t(spark, d, "part").selectExpr("p_partkey", """CASE p_partkey % 4 WHEN 0 THEN concat('{"g":{"nodes":[{"id":', p_size, '}],"links":[{"from":1,"to":', p_size, '}]}}') WHEN 1 THEN '{"vertices":[{"id":1}],"edges":[{"source":1,"dst":1},{"source":1}]}' WHEN 2 THEN '{"vertices":[{"name":"a"}],"edges":[{"src":1,"target":1}]}' ELSE '{"nodes":[],"edges":[]}' END AS raw""")
    return st.graphs(dealt(raw, "p_partkey"), "p_partkey", "raw")


def schema_evolution(spark, d):
    """Keys that only some regimes of documents have."""
    raw = t(spark, d, "events").selectExpr("event_type", "CASE event_type WHEN 'click' THEN concat('{\"id\":', event_id, ',\"x\":1}') WHEN 'view' THEN concat('{\"id\":', event_id, '}') ELSE concat('{\"id\":', event_id, ',\"ref\":', user_id, '}') END AS raw")
    return st.evolution(raw, "event_type", "raw")


# Certificates.


def proof_digest(spark, d):
    """Digest of a table that doesn't depend on the order or the partitions of its rows, and in which no row cancels another."""
    o = t(spark, d, "orders")
    return ct.table_digest(o, F.sha2(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus"), 256))


def _run(spark, d):
    df, (by_fd, *_) = view(spark, d, "cust").select("id", "nation", "region"), _analyses()
    done, journal, _ = rp.fixed_point(df, "id", ["region"], by_fd, cutter(spark))
    return df, done, journal


def certifier(spark, d):
    """A run's claims checked anew from its input, output and journal."""
    df, done, journal = _run(spark, d)
    return ct.certify(df, done, "id", ["region"], journal)[0]


def certifier_refuses(spark, d):
    """The same with an output that one row was changed in."""
    df, done, journal = _run(spark, d)
    wrong = done.withColumn("nation", F.when(F.col("id") == 5, F.col("nation") + 1).otherwise(F.col("nation")))
    return ct.certify(df, wrong, "id", ["region"], journal)[0]


def proof_packet(spark, d):
    """A proof written as a packet and opened again."""
    df, done, journal = _run(spark, d)
    proof = ct.Proof.open(ct.certify(df, done, "id", ["region"], journal)[1].packet())
    kinds = [(n["kind"].split(" ")[0],) for n in proof.nodes.values()]
    return spark.createDataFrame(kinds, "kind string").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _issues(spark, d):
    k = _candidates(spark, d)
    cells = k.select("row_id", "field").distinct()
    more = cells.where("row_id % 7 = 0").select("row_id", F.lit("/lost").alias("field")).distinct()
    path = F.concat(F.lit("path:/"), F.col("row_id").cast("string"), "field")
    return cells.unionByName(more).select("row_id", "field", F.lit("violation").alias("code"), F.array(path, F.concat(F.lit("source:s"), F.col("row_id") % 4)).alias("tokens"))


def open_obligations(spark, d):
    """Issues that no unique candidate settles."""
    return ct.obligations(_issues(spark, d), _candidates(spark, d)).select("kind", "row_id", "field")


def open_wake(spark, d):
    """Obligations that a change of some paths, or of a source, touches; a change above or below a path does too."""
    registry = ct.obligations(_issues(spark, d), _candidates(spark, d))
    changes = t(spark, d, "customer").where("c_custkey % 1000 = 0").selectExpr("concat('path:/', c_custkey) AS token").unionByName(spark.createDataFrame([("source:s3",), ("path:/97/region/name/first",), ("relation:none",)], "token string"))
    return ct.wake(registry, changes)[0].select("row_id", "field", F.array_join("hits", " ").alias("hits"))


def sink_open_registry(spark, d):
    """The registry saved with its digest and loaded again."""
    folder = shared_folder(spark) + "/open"
    ct.save_obligations(ct.obligations(_issues(spark, d), _candidates(spark, d)), folder)
    return ct.load_obligations(spark, folder).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def incremental(spark, d):
    """Only rows of the touched determinants are analysed again: the candidates are those of the whole analysis for them."""
    df = view(spark, d, "cust").select("id", "nation", "region")
    (by_fd, *_) = _analyses()
    touched = df.where("id % 500 = 0").select("nation").distinct()
    part = dep.violations_of(df.join(touched, "nation", "left_semi"), "id", [("nation", "region")]).select("row_id", "new_value")
    whole = by_fd(df).select("row_id", "new_value").join(df.join(touched, "nation", "left_semi").select(F.col("id").alias("row_id")), "row_id", "left_semi")
    return part.withColumn("side", F.lit(1)).unionByName(whole.withColumn("side", F.lit(2))).groupBy("row_id", "new_value").agg(F.count_distinct("side").alias("sides"))


def _typed(spark, d):
    df, (by_fd, *_) = view(spark, d, "cust").select("id", "nation", "region", "segment"), _analyses()
    cands = by_fd(df)
    issues = cands.select(F.lit("nation>region").alias("relation_id"), "row_id", "field", F.lit("functional_relation_violation").alias("code"))
    relations = spark.createDataFrame([("nation>region", "functional", ["nation"], "region"), ("segment>segment", "functional", ["segment"], "segment")], "relation_id string, kind string, inputs array<string>, output string")
    return ct.typed_form(df, "id", ["nation", "region", "segment"], relations, issues, cands)


def typed_ir(spark, d):
    """Terminals of an analysis with the truth of each."""
    return _typed(spark, d)[2].select("relation_id", "row_id", "satisfied", "reconstruction")


def typed_ir_nodes(spark, d):
    return _typed(spark, d)[0].groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("digest").alias("digests"))


def typed_ir_constraints(spark, d):
    return _typed(spark, d)[1].select("relation_id", "satisfied", "violations")


def horizon(spark, d):
    """Cells whose input is the same in three runs and whose output isn't."""
    inp = t(spark, d, "part").selectExpr("p_partkey AS id", "p_size AS size")
    out = lambda fault: t(spark, d, "part").selectExpr("p_partkey AS id", f"3 * p_size + CASE WHEN {fault} THEN 1 ELSE 0 END AS size")
    m = lambda df: ct.manifest(df, "id", ["size"])
    other = t(spark, d, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 3 = 0 THEN p_size + 100 ELSE p_size END AS size")
    return ct.divergent([(m(inp), m(out("p_partkey % 113 = 0"))), (m(inp), m(out("false"))), (m(other), m(out("p_partkey % 50 = 0")))])


def q_descent(spark, d):
    """Debt before and after the unique candidates are applied."""
    c = _candidates(spark, d)
    issues = c.select("row_id", "field").distinct().withColumns({"code": F.lit("violation"), "severity": F.when(F.col("field") == "/region", "error").otherwise("warning")})
    solved = rp.select_unique(c).select("row_id", "field")
    before, after = cf.debt(issues, c), cf.debt(issues.join(solved, ["row_id", "field"], "left_anti"), c)
    return before.withColumn("stage", F.lit("before")).unionByName(after.withColumn("stage", F.lit("after"))).join(cf.descends(before, after))


def fixed_point_order(spark, d):
    """The fixed point from two orders of rows, and with the relations quiet too."""
    df, (by_fd, *_) = view(spark, d, "cust").select("id", "nation", "region"), _analyses()
    same = rp.order_independent(df, "id", ["region"], by_fd, cutter(spark))
    relations = lambda x: dep.functional(x, "id", [], [("nation", "region")])[0].drop("confidence")
    done, journal, status = rp.fixed_point(df, "id", ["region"], by_fd, cutter(spark), relations=relations)
    return done.agg(F.sum("region").alias("regions"), F.count("region").alias("filled")).withColumns({"order_independent": F.lit(same), "status": F.lit(status), "steps": F.lit(len(journal))})


_NAMES = """fixed_point_order factorize rewrite_algebra confluence min_transfer parallel_routes parallel_routes_refused symmetry_block causal_cone causal_dominance federation federation_conflicts federation_packets federation_pairs federation_compose fast_select
fast_select_deferred identifiability fw_control fw_boundary fw_robust fw_semantic authority_scope multisource_lifecycle multisource_assimilate multisource_conflicts materialize_witness join_source_identity struct_rename morphology
morphology_relations graph_discover schema_evolution proof_digest certifier certifier_refuses proof_packet open_obligations open_wake sink_open_registry incremental typed_ir typed_ir_nodes typed_ir_constraints horizon q_descent"""
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_O = f"WITH o AS ({_OPTIONS}) "
_K = _CUST + _CAND
_CELLS = ", c AS (SELECT row_id, field, count(DISTINCT new_value) AS v, count(DISTINCT analyzer) AS a, max(tier) AS tier, min(new_value) AS nv FROM k GROUP BY ALL), g AS (SELECT row_id, count(*) AS n, bool_or(field = '/region/name') AND bool_or(field = '/region') AS tangled FROM c GROUP BY ALL)"
_ISSUES = ", cells AS (SELECT DISTINCT row_id, field FROM k), i AS (SELECT * FROM cells UNION SELECT row_id, '/lost' FROM cells WHERE row_id % 7 = 0), u AS (SELECT row_id, field, count(DISTINCT new_value) AS v FROM k GROUP BY ALL), ob AS (SELECT CASE WHEN v > 1 THEN 'OPEN_AMBIGUOUS' ELSE 'OPEN_UNREPAIRABLE' END AS kind, i.row_id, i.field FROM i LEFT JOIN u ON u.row_id = i.row_id AND u.field = i.field WHERE v IS NULL OR v <> 1)"
_FIXED = ", f AS (SELECT id, CASE WHEN region IS NULL OR id % 97 = 0 THEN nation % 5 ELSE region END AS region FROM cust)"
_SURFACES = "SELECT * FROM (VALUES ('input', true), ('replay', {0}), ('inverse', {0}), ('untouched', {0}), ('preconditions', true), ('idempotent', true), ('hashes', true)) s(surface, ok)"
ORACLES = {
    "fixed_point_order": _CUST + _FIXED + "SELECT sum(region)::BIGINT AS regions, count(region) AS filled, true AS order_independent, 'PASS' AS status, 1 AS steps FROM f",
    "factorize": _O + "SELECT row_id, option_id, CASE WHEN option_id IN ('a', 'b') THEN 'a' WHEN option_id = 'c' OR row_id % 3 = 0 THEN 'c' ELSE 'd' END AS block FROM o",
    "rewrite_algebra": _O + "SELECT x.row_id, x.option_id AS a, y.option_id AS b, x.path AS path_a, y.path AS path_b, CASE WHEN x.path = y.path THEN x.value = y.value ELSE x.value = '{\"y\":1}' END AS joinable FROM o x JOIN o y ON x.row_id = y.row_id AND x.option_id <> y.option_id AND (x.path = y.path AND x.option_id < y.option_id OR starts_with(y.path, x.path || '/'))",
    "confluence": _O + "SELECT x.row_id, count(*) AS pairs, bool_and(CASE WHEN x.path = y.path THEN x.value = y.value ELSE x.value = '{\"y\":1}' END) AS joinable FROM o x JOIN o y ON x.row_id = y.row_id AND x.option_id <> y.option_id AND (x.path = y.path AND x.option_id < y.option_id OR starts_with(y.path, x.path || '/')) GROUP BY x.row_id",
    "min_transfer": "SELECT p_partkey AS row_id, 'a' AS block, CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE 'a' END AS taken, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS resolved, 'UNIQUE' AS status FROM part UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'c' ELSE 'd' END, CASE WHEN p_partkey % 12 = 0 AND p_partkey % 5 <> 0 THEN '' WHEN p_partkey % 3 = 0 THEN 'c' ELSE 'd' END, 1, CASE WHEN p_partkey % 12 = 0 AND p_partkey % 5 <> 0 THEN 'TIE' ELSE 'UNIQUE' END FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 4 = 0",
    "parallel_routes": _CUST + "SELECT 2::BIGINT AS routes, CASE WHEN bool_and(fd = rule) THEN 1 ELSE 2 END::BIGINT AS terminals, bool_and(fd = rule) AS accepted FROM (SELECT nation, mode(region) AS fd, nation % 5 AS rule FROM cust WHERE region IS NOT NULL GROUP BY nation)",
    "parallel_routes_refused": _CUST + "SELECT 2::BIGINT AS routes, CASE WHEN count(*) > 0 THEN 2 ELSE 1 END::BIGINT AS terminals, count(*) = 0 AS accepted FROM cust WHERE region IS NULL OR region <> nation % 5",
    "symmetry_block": "SELECT row_id, array_path, sum(n)::BIGINT AS options FROM (SELECT l_orderkey AS row_id, '/lines' AS array_path, count(DISTINCT l_linenumber) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey, l_returnflag, l_linestatus HAVING count(DISTINCT l_linenumber) > 1) GROUP BY ALL",
    "causal_cone": using("item") + """, r AS (SELECT CASE WHEN count(*) FILTER (charge = quantity + discount) >= 0.95 * count(*) THEN 1 END AS yes FROM item), e AS (SELECT x.s, x.t FROM r, (VALUES ('discount', 'charge'), ('quantity', 'charge'), ('charge', 'discount'), ('quantity', 'discount'), ('charge', 'quantity'), ('discount', 'quantity')) x(s, t) WHERE yes = 1),
        c AS (WITH RECURSIVE p AS (SELECT s, t FROM e UNION SELECT p.s, e.t FROM p JOIN e ON e.s = p.t) SELECT * FROM p) SELECT f AS field, (SELECT string_agg(s, ',' ORDER BY s) FROM c WHERE t = f) AS backward, (SELECT string_agg(t, ',' ORDER BY t) FROM c WHERE s = f) AS forward FROM (SELECT DISTINCT s AS f FROM e)""",
    "causal_dominance": "WITH p AS (SELECT p_partkey AS row_id, p_size AS s FROM part WHERE p_partkey % 7 = 0), c AS (SELECT row_id, 'low' AS option_id, s + 1 AS a, s + 1 AS b, 3 * s + 1 AS c FROM p UNION ALL SELECT row_id, 'twin', s, s, 3 * s + 1 FROM p UNION ALL SELECT row_id, 'none', s, s + 2, 3 * s + 1 FROM p), m AS (SELECT row_id, option_id, (a = b)::INT AS mends, (c <> 3 * a AND abs(c - 3 * a) > 2)::INT AS breaks FROM c) SELECT row_id, option_id FROM m x WHERE EXISTS (SELECT 1 FROM m y WHERE y.row_id = x.row_id AND y.mends > x.mends AND y.breaks <= x.breaks)",
    "federation": _K + "SELECT row_id, field, min(new_value) AS new_value, string_agg(DISTINCT analyzer, ',' ORDER BY analyzer) AS actors FROM k GROUP BY row_id, field HAVING count(DISTINCT new_value) = 1 AND count(DISTINCT analyzer) > 1",
    "federation_conflicts": _K + "SELECT row_id, field, string_agg(says, ';' ORDER BY new_value) AS says FROM (SELECT row_id, field, new_value, new_value || ':' || string_agg(DISTINCT analyzer, ',' ORDER BY analyzer) AS says FROM k GROUP BY row_id, field, new_value) GROUP BY row_id, field HAVING count(*) > 1",
    "federation_packets": _K + "SELECT analyzer AS actor, count(*) AS proposals, count(DISTINCT (row_id, field)) AS cells, sum(('0x' || sha256(row_id || chr(31) || field || chr(31) || new_value)[1:12])::BIGINT)::DECIMAL(38,0) AS digest FROM k GROUP BY analyzer",
    "federation_pairs": _K + "SELECT a.analyzer AS first, b.analyzer AS second, count(*) AS cells, count(*) FILTER (a.new_value = b.new_value) AS agree FROM k a JOIN k b ON a.row_id = b.row_id AND a.field = b.field AND a.analyzer < b.analyzer GROUP BY ALL",
    "federation_compose": "WITH RECURSIVE e AS (SELECT * FROM (VALUES ('orders', 'customer'), ('customer', 'nation'), ('nation', 'region')) x(src, dst) UNION ALL SELECT 'region', 'name' FROM region WHERE r_regionkey = 0), p AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON e.src = p.dst) SELECT * FROM p WHERE (src, dst) NOT IN (SELECT (src, dst) FROM e)",
    "fast_select": _K + _CELLS + "SELECT c.row_id, field, nv AS new_value FROM c JOIN g ON g.row_id = c.row_id WHERE v = 1 AND NOT (tangled AND field LIKE '/region%') AND NOT (n > 1 AND tier < 3)",
    "fast_select_deferred": _K + _CELLS + "SELECT * FROM (SELECT c.row_id, field, CASE WHEN v > 1 THEN 'AMBIGUOUS' WHEN tangled AND field LIKE '/region%' THEN 'OVERLAP' WHEN a < 2 AND tier < 3 THEN 'EVIDENCE' WHEN n > 1 AND tier < 3 THEN 'SEVERAL_FIELDS' END AS reason FROM c JOIN g ON g.row_id = c.row_id) WHERE reason IS NOT NULL",
    "identifiability": _K + """, dm AS (SELECT row_id, field, analyzer AS source, new_value AS value FROM k UNION ALL SELECT row_id, field, 'enum', x.v FROM k, (VALUES ('0'), ('1'), ('2'), ('3'), ('4')) x(v) WHERE row_id % 11 = 0), s AS (SELECT row_id, field, count(DISTINCT source) AS n FROM dm GROUP BY ALL), vt AS (SELECT row_id, field, value, count(DISTINCT source) AS n FROM dm GROUP BY ALL),
        z AS (SELECT s.row_id, s.field, count(*) FILTER (vt.n = s.n) AS solutions FROM s JOIN vt ON vt.row_id = s.row_id AND vt.field = s.field GROUP BY ALL), i AS (SELECT DISTINCT row_id, field FROM k UNION SELECT row_id, '/other' FROM k WHERE row_id % 7 = 0)
        SELECT i.row_id, i.field, CASE WHEN solutions IS NULL THEN 'INSUFFICIENT' WHEN solutions = 1 THEN 'UNIQUE' WHEN solutions > 1 THEN 'MULTIPLE' ELSE 'NONE' END AS status, coalesce(solutions, 0) AS solutions, CASE WHEN solutions IS NULL THEN 'any source' WHEN solutions > 1 THEN ceil(log2(solutions))::INT || ' bits' WHEN solutions = 0 THEN 'a withdrawn source' END AS witness FROM i LEFT JOIN z ON z.row_id = i.row_id AND z.field = i.field""",
    "fw_control": _K + ", x AS (SELECT *, CASE WHEN field = '/segment' THEN 'IMMUTABLE' WHEN field = '/region/name' THEN 'OPERATION' END AS why FROM k WHERE tier = 1), b AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS r FROM x WHERE why IS NULL), e AS (SELECT min(row_id) AS cut FROM b WHERE r = 6) SELECT DISTINCT row_id, field, coalesce(why, 'BUDGET') AS reason FROM x, e WHERE why IS NOT NULL OR row_id >= cut",
    "fw_boundary": _K + "SELECT k.row_id, analyzer || ':' || new_value AS option_id FROM k JOIN cust ON cust.id = k.row_id WHERE field = '/region' AND NOT (coalesce(region BETWEEN 0 AND 3, true) AND NOT new_value::INT BETWEEN 0 AND 3) AND NOT (coalesce(region + k2.nation >= 2, true) AND NOT new_value::INT + k2.nation >= 2)".replace("k2.", "cust."),
    "fw_robust": _K + "SELECT row_id, field, analyzer, CASE WHEN field = '/segment' THEN 'STALE' WHEN old_value IS NULL THEN 'PASS' WHEN abs(new_value::INT - old_value::INT) <= 1 THEN 'WITHIN_UNCERTAINTY' WHEN abs(new_value::INT - old_value::INT) <= 2 THEN 'WITHIN_HYSTERESIS' ELSE 'PASS' END AS gate FROM k WHERE field IN ('/region', '/segment')",
    "fw_semantic": "WITH r AS (SELECT n_nationkey AS k, n_name = CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE lower(n_name) END AS same FROM nation) SELECT 'r' || k AS rule_id, CASE WHEN same THEN 'SOURCE_EXACT' WHEN k % 5 = 0 THEN 'INFERRED' ELSE 'UNVERIFIED' END AS provenance, same OR k % 5 = 0 AS active FROM r UNION ALL SELECT 'd' || k, CASE WHEN same THEN 'DERIVED_EXACT' ELSE 'UNVERIFIED' END, same FROM r",
    "authority_scope": """WITH a AS (SELECT c_custkey AS request_id, c_nationkey AS n, CASE WHEN c_custkey % 5 = 0 THEN 'PATH_OUT_OF_SCOPE' WHEN c_custkey % 7 = 0 THEN 'OPERATION_OUT_OF_SCOPE' WHEN c_custkey % 11 = 0 THEN 'AUTHORITY_EXPIRED' END AS out FROM customer)
        SELECT request_id, CASE WHEN out IS NULL THEN n % 6 < 4 ELSE false END AS authorised, CASE WHEN n % 6 = 0 THEN coalesce(out, 'DIRECT_SCOPE_MATCH') WHEN out IS NULL AND n % 6 < 4 THEN 'DELEGATED_SCOPE_MATCH' ELSE 'NO_DIRECT_AUTHORITY' END AS reason,
        CASE WHEN out IS NULL AND n % 6 BETWEEN 1 AND 3 THEN array_to_string(list_transform(range(0, (n % 6)::BIGINT), lambda i: 'd' || lpad((n - i)::VARCHAR, 2, '0')), ',') ELSE '' END AS chain FROM a""",
    "multisource_lifecycle": _CUST + """, x AS (SELECT id, CASE WHEN id % 6 = 0 THEN segment END AS grp, p.det, p.target, p.d, p.v FROM cust, LATERAL (VALUES ('nation', 'region', nation::VARCHAR, region::VARCHAR), ('nation', 'segment', nation::VARCHAR, segment), ('segment', 'copied', segment, segment)) p(det, target, d, v) WHERE id % 97 <> 0 AND v IS NOT NULL),
        n AS (SELECT det, target, d, v, count(*) AS n FROM x WHERE id % 3 <> 0 GROUP BY ALL), m AS (SELECT det, target, d, first(v ORDER BY n DESC, v) AS mode, max(n) AS top, sum(n) AS n FROM n GROUP BY ALL), e AS (SELECT det, target, sum(top) = sum(n) AS exact FROM m GROUP BY ALL),
        h AS (SELECT x.det, x.target, count(*) AS rows, count(*) FILTER (x.v <> mode) AS mismatches, count(*) FILTER (grp IS NOT NULL AND x.v <> mode) AS against, count(DISTINCT grp) AS groups FROM x JOIN m ON m.det = x.det AND m.target = x.target AND m.d = x.d WHERE id % 3 = 0 GROUP BY ALL)
        SELECT e.det, e.target, CASE WHEN NOT exact THEN 'DEVELOPMENT_CONFLICT' WHEN rows = 0 THEN 'DISCOVERED' WHEN against > 0 THEN 'GLOBAL_REFUTED' WHEN groups = 0 THEN 'DEPENDENT_REPLICATION_ONLY' WHEN groups = 1 THEN 'HELDOUT_CONFIRMED' ELSE 'PORTABLE' END AS status, rows, mismatches, groups FROM e JOIN h ON h.det = e.det AND h.target = e.target""",
    "multisource_assimilate": _CUST + """, l AS (SELECT user_id AS id, arg_max(event_id % 10, event_id)::VARCHAR AS v FROM events WHERE user_id % 50 = 0 GROUP BY 1), j AS (SELECT cust.id, region::VARCHAR AS r, CASE WHEN cust.id % 200 = 0 THEN '7' END AS a, l.v, cust.id % 400 = 0 AND cust.id % 800 <> 0 AS clash FROM cust LEFT JOIN l ON l.id = cust.id)
        SELECT id AS row_id, coalesce(a, v, '-1') AS new_value, CASE WHEN a IS NOT NULL THEN 'authoritative_source_mismatch' WHEN v IS NOT NULL THEN 'event_projection_mismatch' ELSE 'missing_value_with_default' END AS analyzer, CASE WHEN a IS NOT NULL THEN 3 WHEN v IS NOT NULL THEN 2 ELSE 1 END AS tier FROM j WHERE NOT clash AND coalesce(a, v, CASE WHEN r IS NULL THEN '-1' END) IS DISTINCT FROM r AND coalesce(a, v, CASE WHEN r IS NULL THEN '-1' END) IS NOT NULL""",
    "multisource_conflicts": "SELECT c_custkey AS row_id, 'region' AS field, 'source_registry_conflict' AS code FROM customer WHERE c_custkey % 400 = 0 AND c_custkey % 800 <> 0",
    "materialize_witness": _CUST + ", w AS (SELECT n_nationkey AS n, n_regionkey AS v, 'a' AS s FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey, n_regionkey + n_nationkey % 2, 'b' FROM nation WHERE n_nationkey % 3 = 0), a AS (SELECT n, count(DISTINCT v) AS k, min(v)::VARCHAR AS v, count(DISTINCT s) AS s FROM w GROUP BY n) SELECT id AS row_id, 'region' AS field, CASE WHEN k IS NULL THEN 'MISSING' WHEN k = 1 THEN 'MATERIALIZED' ELSE 'CONFLICT' END AS status, CASE WHEN k = 1 THEN v END AS value, coalesce(s, 0) AS sources FROM cust LEFT JOIN a ON a.n = nation WHERE region IS NULL",
    "join_source_identity": "SELECT p_partkey AS row_id, 'size' AS field, p_size::VARCHAR AS old_value, (p_size + 1)::VARCHAR AS new_value FROM part WHERE p_partkey % 113 = 0 UNION ALL SELECT p_partkey, 'brand', p_brand, NULL FROM part WHERE p_partkey % 127 = 0",
    "struct_rename": "SELECT p_partkey AS row_id, 'part_sz' AS from_key, 'part_size' AS to_key FROM part WHERE p_partkey % 47 = 0",
    "morphology": "SELECT l_orderkey AS row_id, 'qty' AS missing, 'recursive_morphology_missing_key' AS code, count(*) AS n FROM lineitem WHERE (l_orderkey + l_linenumber) % 61 = 0 GROUP BY 1",
    "morphology_relations": "SELECT 'lines' AS container, 'line,qty' AS shape, count(*) FILTER ((l_orderkey + l_linenumber) % 61 <> 0) AS support, count(*) AS observed FROM lineitem HAVING count(*) FILTER ((l_orderkey + l_linenumber) % 61 <> 0) >= 0.75 * count(*)",
    "graph_discover": "SELECT p_partkey AS row_id, CASE p_partkey % 4 WHEN 0 THEN '/g' ELSE '' END AS path, CASE p_partkey % 4 WHEN 0 THEN 'nodes' ELSE 'vertices' END AS nodes, CASE p_partkey % 4 WHEN 0 THEN 'links' ELSE 'edges' END AS edges, CASE p_partkey % 4 WHEN 0 THEN 'id' ELSE 'name' END AS id_key, CASE p_partkey % 4 WHEN 0 THEN 'from' ELSE 'src' END AS from_key, CASE p_partkey % 4 WHEN 0 THEN 'to' ELSE 'target' END AS to_key FROM part WHERE p_partkey % 2 = 0",
    "schema_evolution": "WITH e AS (SELECT DISTINCT event_type AS r FROM events) SELECT 'x' AS key, 'click' AS regimes, string_agg(r, ',' ORDER BY r) FILTER (r <> 'click') AS missing_in FROM e HAVING bool_or(r = 'click') UNION ALL SELECT 'ref', string_agg(r, ',' ORDER BY r) FILTER (r NOT IN ('click', 'view')), string_agg(r, ',' ORDER BY r) FILTER (r IN ('click', 'view')) FROM e",
    "proof_digest": "WITH h AS (SELECT sha256(concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus)) AS h FROM orders) SELECT count(*) AS n_rows, sum(('0x' || h[1:14])::BIGINT)::DECIMAL(38,0) AS low, sum(('0x' || h[15:28])::BIGINT)::DECIMAL(38,0) AS high FROM h",
    "certifier": _SURFACES.format("true"), "certifier_refuses": _SURFACES.format("false"),
    "proof_packet": _CUST + "SELECT * FROM (VALUES ('before', 1::BIGINT), ('step', 1), ('after', 1), ('verdict', 1)) p(kind, n) WHERE kind <> 'step' OR EXISTS (SELECT 1 FROM cust WHERE region IS NULL OR region <> nation % 5)",
    "open_obligations": _K + _ISSUES + "SELECT * FROM ob",
    "open_wake": _K + _ISSUES + """, h AS (SELECT row_id, field, 'path:/' || row_id AS hit FROM ob WHERE row_id % 1000 = 0 UNION ALL SELECT row_id, field, 'source:s3' FROM ob WHERE row_id % 4 = 3 UNION ALL SELECT row_id, field, 'path:/97/region/name/first' FROM ob WHERE row_id = 97 AND field IN ('/region', '/region/name'))
        SELECT row_id, field, string_agg(hit, ' ' ORDER BY hit) AS hits FROM h GROUP BY ALL""",
    "sink_open_registry": _K + _ISSUES + "SELECT kind, count(*) AS n FROM ob GROUP BY kind",
    "incremental": _CUST + "SELECT id AS row_id, (nation % 5)::VARCHAR AS new_value, 2::BIGINT AS sides FROM cust WHERE (region IS NULL OR region <> nation % 5) AND nation IN (SELECT nation FROM cust WHERE id % 500 = 0)",
    "typed_ir": _CUST + "SELECT 'nation>region' AS relation_id, id AS row_id, 'FALSE' AS satisfied, 'TRUE' AS reconstruction FROM cust WHERE region IS NULL OR region <> nation % 5",
    "typed_ir_nodes": _CUST + "SELECT 'nation' AS field, 'integer' AS kind, count(*) AS n, count(DISTINCT nation) AS digests FROM cust UNION ALL SELECT 'region', CASE WHEN region IS NULL THEN 'null' ELSE 'integer' END, count(*), greatest(count(DISTINCT region), 1) FROM cust GROUP BY region IS NULL, 2 UNION ALL SELECT 'segment', 'string', count(*), count(DISTINCT segment) FROM cust",
    "typed_ir_constraints": _CUST + "SELECT 'nation>region' AS relation_id, CASE WHEN count(*) > 0 THEN 'FALSE' ELSE 'TRUE' END AS satisfied, count(*) AS violations FROM cust WHERE region IS NULL OR region <> nation % 5 UNION ALL SELECT 'segment>segment', 'TRUE', 0",
    "horizon": "SELECT '/' || p_partkey || '/size' AS path, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 3 END::BIGINT AS runs, 2::BIGINT AS outputs FROM part WHERE p_partkey % 113 = 0 OR p_partkey % 50 = 0 AND p_partkey % 3 <> 0",
    "q_descent": _K + ", x AS (SELECT row_id, field, count(DISTINCT new_value) AS v FROM k GROUP BY ALL), b AS (SELECT count(*) FILTER (field = '/region') AS errors, count(*) FILTER (field <> '/region') AS warnings, count(*) AS cells, count(*) FILTER (v > 1) AS open FROM x), a AS (SELECT count(*) FILTER (field = '/region') AS errors, count(*) FILTER (field <> '/region') AS warnings, count(*) AS cells, count(*) AS open FROM x WHERE v > 1) SELECT b.*, 'before' AS stage, (SELECT errors FROM a) < errors AS descends FROM b UNION ALL SELECT a.*, 'after', a.errors < (SELECT errors FROM b) FROM a",
}
