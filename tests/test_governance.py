"""Patches, conflicts, governance, certificates, context, structure and streams on small and odd inputs."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline import functions as fn
from plumbline import sources as src
from plumbline.operators import aggregates as agg
from plumbline.operators import certificates as ct
from plumbline.operators import conflicts as cf
from plumbline.operators import context as cx
from plumbline.operators import dependencies as dep
from plumbline.operators import governance as gv
from plumbline.operators import patches as pt
from plumbline.operators import repair as rp
from plumbline.operators import rules as rl
from plumbline.operators import structure as st
from plumbline.operators import systems as sy
from plumbline.sources.shared import cutter
from plumbline.streaming import driver as dr


def test_patches_undo_exactly():
    rng = random.Random(4)
    make = lambda depth: rng.choice([1, "s", None, True, 2.5]) if depth == 0 else rng.choice([lambda: [make(depth - 1) for _ in range(rng.randrange(3))], lambda: {k: make(depth - 1) for k in "ab/"[: rng.randrange(4)]}])()

    def pointers(v, at=""):
        yield at
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            yield from pointers(x, f"{at}/{fn.escape(str(k))}")

    done = 0
    for _ in range(400):
        doc = make(3)
        ops = []
        for _ in range(rng.randrange(1, 4)):
            paths = list(pointers(doc))
            kind = rng.choice(["add", "remove", "replace", "move", "copy", "test"])
            op = {"op": kind, "path": rng.choice(paths) + rng.choice(["", "/new", "/0", "/-"])}
            op |= {"from": rng.choice(paths)} if kind in ("move", "copy") else {"value": make(1)}
            ops.append(op)
        before = copy.deepcopy(doc)
        try:
            new, undo = pt.apply(doc, ops)
        except (pt.PatchError, TypeError):
            assert pt.equal(doc, before)
            continue
        done += 1
        assert pt.equal(doc, before) and pt.equal(pt.apply(new, undo)[0], before), (before, ops)
    assert done > 60


def test_patch_refusals():
    doc = {"a": [1, {"b": 2}]}
    for ops in ([{"op": "remove", "path": "/x"}], [{"op": "test", "path": "/a/0", "value": True}], [{"op": "add", "path": "/a/9", "value": 1}], [{"op": "move", "from": "/a", "path": "/a/0"}], [{"op": "replace", "path": "/a/00", "value": 1}], [{"op": "fly", "path": "/a"}], [{"op": "replace", "path": "/a/0", "value": 2, "old": 7}]):
        with pytest.raises(pt.PatchError):
            pt.apply(doc, ops)
    assert pt.equal({"a": 1.0, "b": [None]}, {"b": [None], "a": 1}) and not pt.equal(1, True) and not pt.equal([1, 2], [2, 1])


def test_pointer_columns(spark):
    df = spark.createDataFrame([('{"a/b":{"~":[1]}}', "/a~1b/~0/0"), ("[1]", "/1"), ("x", "/a"), (None, "/a"), ("{}", "")], "raw string, p string")
    got = df.select(pt.get_at(F.col("raw"), F.col("p")).alias("g"), pt.set_at(F.col("raw"), F.col("p"), F.lit("7")).alias("s"), pt.delete_at(F.col("raw"), F.col("p")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("1", '{"a/b":{"~":[7]}}', '{"a/b":{"~":[]}}'), (None, "[1,7]", None), (None, None, None), (None, None, None), ("{}", "7", None)]


OPTIONS = "row_id long, block string, option_id string, path string, value string, resolves array<int>, cost int"


def test_least_transfer(spark):
    rows = [
        (1, "x", "a", "/p", "1", [1], 1), (1, "x", "b", "/q", "2", [2], 1), (1, "x", "c", "/p", "9", [1, 2], 5),  # a and b together are cheaper than c
        (2, "x", "a", "/p", "1", [1], 1), (2, "x", "b", "/p", "2", [1], 1),  # a tie
        (3, "x", "a", "/p", "1", [], 1), (4, "x", "a", "/p", "1", [1], 1), (4, "x", "b", "/p/q", "2", [2], 1), (4, "x", "c", "/p", "3", [1, 2], 9),  # one path below another
        *[(5, "x", f"o{i}", f"/p{i}", "1", [i], 1) for i in range(9)],
    ]
    got = {r["row_id"]: (r["taken"], r["status"]) for r in cf.least_transfer(spark.createDataFrame(rows, OPTIONS)).collect()}
    assert got == {1: (["a", "b"], "UNIQUE"), 2: ([], "TIE"), 3: ([], "NONE"), 4: (["c"], "UNIQUE"), 5: ([], "OPEN")}
    assert cf.least_transfer(spark.createDataFrame([], OPTIONS)).count() == 0


def test_closure_of_a_cycle_and_a_chain(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(20)] + [("a", "b"), ("b", "a")], "src string, dst string")
    got = {(r[0], r[1]) for r in cf.closure(edges, cutter(spark)).collect()}
    assert len(got) == 20 * 21 // 2 + 4 and ("a", "a") in got and ("n0", "n20") in got


def test_authority_over_delegations(spark):
    scope = "path_glob string, operation string, document string, version string, valid_from timestamp, valid_until timestamp"
    scopes = spark.createDataFrame([("root", "/a/**", "*", "*", "*", None, None)], "source_id string, " + scope)
    chain = [("d1", "root", "x", False), ("d2", "x", "y", False), ("d3", "y", "x", False), ("d4", "root", "z", True)]
    delegations = spark.createDataFrame([(*c, "/a/b", "*", "*", "*", None, None) for c in chain], "delegation_id string, grantor string, delegate string, revoked boolean, " + scope)
    asks = spark.createDataFrame([(1, "root", "/a/q"), (2, "y", "/a/b"), (3, "y", "/a/q"), (4, "z", "/a/b"), (5, "nobody", "/a/b")], "request_id long, source_id string, path string").withColumns({"operation": F.lit("replace"), "document": F.lit(None).cast("string"), "version": F.lit(None).cast("string"), "at": F.lit(None).cast("timestamp")})
    got = {r["request_id"]: (r["authorised"], r["chain"]) for r in gv.authorise(asks, scopes, delegations, cutter(spark)).collect()}
    assert got == {1: (True, []), 2: (True, ["d2", "d1"]), 3: (False, []), 4: (False, []), 5: (False, [])}
    short = {r["request_id"]: r["authorised"] for r in gv.authorise(asks, scopes, delegations, cutter(spark), hops=1).collect()}
    assert not short[2]


CAND = "row_id long, field string, old_value string, new_value string, analyzer string, tier int"


def test_control_budget_and_precedence(spark):
    rows = [(i, "/a", "0", "1", "x", 3 if i == 7 else 1) for i in range(10)]
    kept, out = gv.control(spark.createDataFrame(rows, CAND), [{"path": "/a", "budget": 3}])
    assert sorted(r["row_id"] for r in kept.collect()) == [0, 1, 7] and out.count() == 7
    assert gv.control(spark.createDataFrame(rows, CAND), [{"path": "/a", "budget": 10}])[1].count() == 0
    assert gv.control(spark.createDataFrame(rows, CAND), [{"path": "/**", "permission": False}])[0].count() == 0
    assert gv.precedence([("a", "b"), ("b", "c")]) == ["a", "b", "c"] and gv.precedence([("a", "b"), ("b", "a")]) is None


def test_certificates_notice_changes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string")
    one, two = ct.table_digest(df).first(), ct.table_digest(df.repartition(3)).first()
    assert one == two != ct.table_digest(df.where("id = 1")).first() and ct.table_digest(df.where("id = 2")).first() != ct.table_digest(df.limit(0)).first()
    proof = ct.Proof()
    a = proof.add("x", {"n": 1})
    proof.add("y", {"n": 2}, a)
    packet = proof.packet()
    assert ct.Proof.open(packet).root() == proof.root()
    with pytest.raises(ValueError):
        ct.Proof.open(packet.replace('"n":1', '"n":7'))
    with pytest.raises(ValueError):
        proof.add("z", {}, "nowhere")
    issues = spark.createDataFrame([(1, "/f", "c", ["path:/1/f", "relation:r"]), (2, "/f", "c", ["path:/2/f"])], "row_id long, field string, code string, tokens array<string>")
    registry = ct.obligations(issues, spark.createDataFrame([(2, "/f", "x", "y", "an", 1)], CAND))
    assert [r["row_id"] for r in registry.collect()] == [1]
    ct.save_obligations(registry, str(tmp_path / "open"))
    assert ct.load_obligations(spark, str(tmp_path / "open")).count() == 1
    spark.read.parquet(str(tmp_path / "open/obligations")).withColumn("code", F.lit("other")).write.parquet(str(tmp_path / "bad/obligations"))
    spark.read.parquet(str(tmp_path / "open/digest")).write.parquet(str(tmp_path / "bad/digest"))
    with pytest.raises(ValueError):
        ct.load_obligations(spark, str(tmp_path / "bad"))


@pytest.mark.parametrize(("token", "wakes"), [("path:/1/f", True), ("path:/1", True), ("path:/1/f/deep", True), ("path:/11", False), ("relation:r", True), ("relation:*", True), ("rel*", True), ("global:*", True), ("source:x", False)])
def test_wake(spark, token, wakes):
    registry = spark.createDataFrame([("o1", ["path:/1/f", "relation:r"])], "obligation_id string, tokens array<string>")
    woken, left = ct.wake(registry, spark.createDataFrame([(token,)], "token string"))
    assert (woken.count(), left.count()) == ((1, 0) if wakes else (0, 1))


def test_assimilate_and_versions(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7), (4, 8)], "id long, v int")
    src_ = lambda rows: spark.createDataFrame(rows, "row_id long, value int")
    log = spark.createDataFrame([(3, 1, 9), (3, 2, 10), (4, 1, 1), (4, 1, 2)], "row_id long, ordinal long, value int")
    found, clash = cx.assimilate(df, "id", "v", src_([(1, 0), (2, 0)]), [src_([(1, 6)])], log)
    assert {(r["row_id"], r["new_value"], r["tier"]) for r in found.collect()} == {(1, "6", 3), (2, "0", 1), (3, "10", 2)} and [r["row_id"] for r in clash.collect()] == [4]
    assert cx.assimilate(df, "id", "v")[0].count() == 0
    with pytest.raises(ValueError):
        cx.align(df, {"id": "v"})


def test_rules_of_files():
    good = json.dumps([{"id": "a", "kind": "implies", "of": ["x"], "then": "y"}])
    assert rl.load_rules(good)[0]["then"] == "y"
    for bad in ("{}", '[{"id":"a","kind":"maybe","of":[]}]', '[{"id":"a","kind":"any_of","of":["x"]},{"id":"a","kind":"any_of","of":["x"]}]', '[{"id":"a","kind":"implies","of":["x"]}]', json.dumps([{"id": i, "kind": "any_of", "of": ["x"]} for i in range(257)])):
        with pytest.raises(ValueError):
            rl.load_rules(bad)
    equal = lambda v: {"field": "f", "equals": v}
    assert rl.conflicting_rules([{"id": 1, "kind": "any_of", "of": [equal(1)]}, {"id": 2, "kind": "any_of", "of": [equal(2)]}, {"id": 3, "kind": "any_of", "of": ["g"]}]) == [1, 2]
    assert rl.conflicting_rules([{"id": 1, "kind": "any_of", "of": [equal(1)]}, {"id": 2, "kind": "not_both", "of": [{"field": "f", "present": True}, {"field": "f", "present": True}]}]) in ([], [1, 2])


def test_sources_of_a_manifest(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k":1}]')
    entry = {"source_id": "a", "role": "defaults", "independent_group": "g", "path": "a.json"}
    (tmp_path / "m.json").write_text(json.dumps([entry]))
    assert src.read_sources(spark, str(tmp_path / "m.json")).count() == 1
    for bad in ([entry, entry], [entry | {"path": "../a.json"}], [entry | {"more": 1}]):
        (tmp_path / "m.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            src.read_sources(spark, str(tmp_path / "m.json"))


def test_declared_lists_and_fractions(spark):
    left = spark.createDataFrame([(1, "a", 5, 10), (1, "b", 2, 11), (2, "a", 1, 20), (2, "a", 1, 21)], "g long, k string, q long, row long")
    right = spark.createDataFrame([(1, "a", 4, 10), (1, "b", 2, 11), (2, "a", 1, 20), (2, "a", 2, 21)], "g long, k string, q long, row long")
    assert [tuple(r) for r in agg.declared_multiset(left, right, "g", "k", "q", "row").collect()] == [(10, 4, 5)]  # in group 2 either row could be wrong
    df = spark.createDataFrame([(6, 4), (-6, 4), (6, -4), (0, 5), (5, 0), (None, 1), (7, 7)], "n long, d long")
    assert [None if r[0] is None else tuple(r[0]) for r in df.select(agg.lowest_terms(F.col("n"), F.col("d"))).collect()] == [(3, 2), (-3, 2), (-3, 2), (0, 1), None, (None, 1), (1, 1)]
    parents = spark.createDataFrame([(1, 3.5), (9, 0.0), (8, None)], "id long, total double")
    kids = spark.createDataFrame([(1, 1.5), (1, 2.0)], "p long, v double")
    assert [(r["row_id"], r["code"], float(r["new_value"])) for r in agg.declared(parents, "id", "total", kids, "p", "sum", F.col("v")).collect()] == [(8, "aggregate_sum_missing", 0.0)]


def test_structure_of_documents(spark):
    rows = [(i, json.dumps({"list": [{"a": 1, "b": 2}, {"a": 1}] if i == 3 else [{"a": 1, "b": 2}] * 2})) for i in range(8)] + [(9, "no json"), (10, None)]
    relations, issues = st.morphology(spark.createDataFrame(rows, "id long, raw string"), "id", "raw")
    assert [(r["row_id"], r["path"], r["missing"]) for r in issues.collect()] == [(3, "/list/1", "b")] and {r["container"] for r in relations.collect()} >= {"list"}
    assert st.graphs(spark.createDataFrame([(1, "{}"), (2, None)], "id long, raw string"), "id", "raw").count() == 0


def test_structure_writes_no_node_that_it_does_not_need(spark, monkeypatch):
    monkeypatch.setattr(st.src, "tree", None)
    rows = [(i, json.dumps({"g": {"nodes": [{"id": i}], "links": [{"from": 1, "to": i}, {"from": 2, "dst": i} if i == 3 else {"from": 2, "to": i}]}})) for i in range(8)]
    docs = spark.createDataFrame(rows, "id long, raw string")
    assert [(r["row_id"], r["path"], r["missing"]) for r in st.morphology(docs, "id", "raw")[1].collect()] == [(3, "/g/links/1", "to")]
    assert sorted(tuple(r) for r in st.graphs(docs, "id", "raw").collect()) == [(i, "/g", "nodes", "links", "id", "from", "to") for i in range(8) if i != 3]


def test_order_and_migration(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, position long")
    chain = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert sy.order_repairs(rows, chain, cutter(spark)).count() == 0  # nothing stands wrongly
    assert sy.graph_structure(rows.select("id"), chain, rows.select("id").limit(0), cutter(spark)).where("code = 'unreachable_nodes'").count() == 3
    df = rows
    assert sy.migration_status(df, {"a": {"rename": ("id", "position")}}, {}, ["x"]) == ("migration_precondition_failed", [])
    assert sy.migration_status(df, {"a": {"set": ("z", "gone + 1")}}, {}, ["id", "position", "z"]) == ("migration_precondition_failed", [])


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"K{i % 4}", i % 4 if i != 9 else 77) for i in range(80)], "id long, k string, v int")
    rows.repartition(6).write.parquet(str(tmp_path / "in"))
    told = dr.repair_stream(spark, str(tmp_path / "in"), rows.schema, "id", [("k", "v")], str(tmp_path / "out"))
    assert told["status"] == "PASS" and told["changed"][0] == 1 and sum(told["changed"][1:]) == 0
    done = spark.read.schema(rows.schema).parquet(str(tmp_path / "out/records"))
    assert done.count() == 80 and done.where("v <> cast(substr(k, 2) as int)").count() == 0
    assert rp.digest(dr.undo(spark, str(tmp_path / "out"), rows.schema, "id", ["v"])) == rp.digest(rows)
    again = dr.repair_stream(spark, str(tmp_path / "out/records"), rows.schema, "id", [("k", "v")], str(tmp_path / "again"))
    assert again["status"] == "PASS" and sum(again["changed"]) == 0 and spark.read.parquet(str(tmp_path / "again/journal")).count() == 0


def test_sums_of_many_batches_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dr, "FOLD", 2)
    rows = spark.range(40).select(F.col("id"), (F.col("id") % 3).cast("string").alias("f"))
    rows.repartition(7).write.parquet(str(tmp_path / "in"))
    got = dr.summarise(dr.open_stream(spark, str(tmp_path / "in"), rows.schema), {"v": dr.value_counts(["f"])}, str(tmp_path / "work"))["v"]
    assert {r["value"]: r["n"] for r in got.collect()} == {"0": 14, "1": 13, "2": 13}
    assert len(list((tmp_path / "work/v/parts").glob("batch=*"))) < 7


def test_known_relations_need_no_support(spark):
    df = spark.createDataFrame([(i, "a", "x" if i else "y") for i in range(4)], "id long, k string, v string")
    assert [(r["row_id"], r["new_value"]) for r in dep.violations_of(df, "id", [("k", "v")]).collect()] == [(0, "x")]
