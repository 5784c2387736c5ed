"""Repair and abstention on small inputs."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from plumbline import functions as fn
from plumbline import sources as src
from plumbline.operators import aggregates as agg
from plumbline.operators import arithmetic as ar
from plumbline.operators import dependencies as dep
from plumbline.operators import profile
from plumbline.operators import references as ref
from plumbline.operators import repair as rp
from plumbline.operators import rules as rl
from plumbline.operators import schema as sc
from plumbline.operators import systems as sy
from plumbline.sources.shared import cutter
from plumbline.sources.syntax import repair


def test_functional_repairs_missing_value(spark):
    df = spark.createDataFrame([(i, c, {"CA": "CAD", "US": "USD"}[c]) for i, c in enumerate("CA US".split() * 4)] + [(8, "CA", None)], "id long, country string, currency string")
    got = dep.functional(df, "id", ["country", "currency"])[1].where("det = 'country'").collect()
    assert [(r["row_id"], r["code"], r["new_value"]) for r in got] == [(8, "missing_from_functional_relation", "CAD")]


def test_functional_abstains_on_ambiguous_map(spark):
    df = spark.createDataFrame([(i, "A", v) for i, v in enumerate([1, 2, 1, 2, 9])], "id long, x string, y int")
    assert dep.functional(df, "id", ["x", "y"], [("x", "y")])[1].count() == 0


def test_falsifier_blocks_constant(spark):
    df = spark.createDataFrame([(i, f"K{(i * i + i // 7) % 5}", (i * i + i // 7) % 5, "same") for i in range(60)], "id long, k string, v int, c string")
    got = {(r["det"], r["target"]): r["status"] for r in dep.falsify(df, "id", [("k", "v"), ("k", "c")]).collect()}
    assert got == {("k", "v"): "ADVERSARIAL_SURVIVED", ("k", "c"): "NEGATIVE_CONTROL_INVARIANT"}


def test_arithmetic_and_consensus(spark):
    df = spark.createDataFrame([(i, i, 2 * i, 3 * i if i != 7 else 999) for i in range(1, 30)], "id long, a int, b int, total int")
    found = {(r["target"], r["a"], r["op"], r["b"]) for r in ar.binary(df, ["a", "b", "total"]).collect()}
    assert ("total", "a", "+", "b") in found
    fixed = ar.violations(df, "id", [("total", "a", "+", "b")]).collect()
    assert [(r["row_id"], int(r["new_value"])) for r in fixed] == [(7, 21)]


def test_division_by_zero_is_undecided(spark):
    df = spark.createDataFrame([(1, 1, 0, 5)], "id long, a int, b int, t int")
    assert ar.violations(df, "id", [("t", "a", "/", "b")]).count() == 0


def test_sequence(spark):
    df = spark.createDataFrame([(i, "p", v) for i, v in enumerate([10, 20, 30, 999, 50, 60])], "i long, p string, v int")
    assert [(r["row_id"], r["new_value"]) for r in ar.sequence(df, "i", "v", "p").collect()] == [(3, 40)]


def test_enum_variant_and_outlier(spark):
    df = spark.createDataFrame([(i, "OPEN") for i in range(6)] + [(i, "SHUT") for i in range(6, 12)] + [(12, "open")], "id long, state string")
    assert [(r["row_id"], r["code"], r["new_value"]) for r in profile.enum_domain(df, "id", "state").collect()] == [(12, "enum_representation_variant", "OPEN")]


def test_reference_case_fix_and_dangling(spark):
    users = spark.createDataFrame([(f"U{i}",) for i in range(1, 10)], "id string")
    orders = spark.createDataFrame([(1, "U1"), (2, "u9"), (3, "NOPE"), (4, None)], "id long, user_id string")
    got = {r["row_id"]: (r["code"], r["new_value"]) for r in ref.dangling(orders, "id", "user_id", users, "id").collect()}
    assert got == {2: ("reference_representation_variant", "U9"), 3: ("dangling_reference", None)}


def test_ambiguous_registry(spark):
    a = spark.createDataFrame([(1,), (2,)], "id int")
    refs = spark.createDataFrame([(1,), (2,)], "r int")
    got = ref.best_registry(ref.overlaps(refs, "r", {"a": (a, "id"), "b": (a, "id")})).first()
    assert got["target"] is None and got["code"] == "ambiguous_reference_target"


def test_weighted_mean_abstains_without_finite_expansion(spark):
    items = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 10, 1), (2, 20, 3)], "g long, v int, w int")
    made = agg.moments(items, "g", F.col("v"), F.col("w"))
    found = spark.createDataFrame([(1, 0.0), (2, 0.0)], "row_id long, value double")
    got = {r["row_id"]: r["new_value"] for r in agg.check_mean(found, made).collect()}
    assert got[1] is None and float(got[2]) == 17.5


def test_linear_needs_one_culprit(spark):
    one = Fraction(1)
    df = spark.createDataFrame([(1, 5, 7, 99, 3, 15)], "id long, a int, b int, c int, d int, e int")
    both = [({"a": one, "b": one, "c": -one}, Fraction(0)), ({"c": one, "d": one, "e": -one}, Fraction(0))]
    got = rl.linear_system(df, "id", both).first()
    assert (got["field"], int(got["new_value"])) == ("c", 12)
    assert rl.linear_system(df, "id", both[:1]).first()["field"] is None


def test_boundaries(spark):
    df = spark.createDataFrame([(-7.0,), (3.2,), (3.0,)], "x double")
    assert [float(r[0]) for r in df.select(fn.project(F.col("x"), 0)).collect()] == [0.0, 3.2, 3.0]
    got = [None if r[0] is None else float(r[0]) for r in df.select(fn.project(F.col("x"), step=2)).collect()]
    assert got == [None, 4.0, None]  # as near to -8 as to -6; 3 to 2 as to 4


def test_unsatisfiable_core():
    assert rl.unsatisfiable_core([[1], [-1, 2], [-2], [3]]) == [0, 1, 2]
    assert rl.unsatisfiable_core([[1, 2], [-1]]) == []


def test_expression_inverse():
    assert rl.solve_for("a + 2 * x", "x", "t") is not None
    assert rl.solve_for("abs(x)", "x", "t") is None
    with pytest.raises(ValueError):
        rl.compile_expression("__import__('os')")


def numbers(spark, pairs, column):
    df = spark.createDataFrame(pairs, "a string, b string")
    return [None if r[0] is None else str(r[0].normalize() if r[0] else 0) for r in df.select(column).collect()]


def test_exact_arithmetic_keeps_every_place_or_gives_null(spark):
    pairs = [("0.001", "0.0001"), ("1", "512"), ("1", "3"), ("1e-9", "1"), ("123456789012345678.123456789", "2"), ("0.0000000001", "1"), ("-7.5", "2"), ("99999999999999999999", "10000000000"), ("x", "1"), ("4", "0"), ("true", "1")]
    a, b = fn.exact("a"), fn.exact("b")
    assert numbers(spark, pairs, fn.times(a, b)) == ["1E-7", "512", "3", "1E-9", "246913578024691356.246913578", None, "-15", None, None, "0", None]
    assert numbers(spark, pairs, fn.over(a, b)) == ["1E+1", "0.001953125", None, "1E-9", None, None, "-3.75", None, None, None, None]
    assert numbers(spark, [("1", "1e-9"), ("99999999999999999999999999999", "1")], fn.plus(a, b)) == ["1.000000001", None]
    df = spark.createDataFrame([("0.0000000001", "0"), ("1.00000000004", "1"), ("1.50", "1.5"), ("1e2", "100")], "a string, b string")
    assert [r[0] for r in df.select(fn.exact_equal("a", "b")).collect()] == [None, None, True, True]
    one = spark.range(1).select(*(fn.finite_decimal(F.lit(1), F.lit(n)).alias(f"q{n}") for n in (128, 512, 1024, 3, 0))).first()
    assert [None if v is None else float(v) for v in one] == [1 / 128, 1 / 512, 1 / 1024, None, None]


def test_decimal_formulas_hold_and_fail_exactly(spark):
    df = spark.createDataFrame([(i, f"0.00{i}", "0.0001", f"0.000000{i}", f"{i}.000000001") for i in range(1, 9)], "id long, a string, b string, c string, d string")
    found = {(r["target"], r["a"], r["op"], r["b"]) for r in ar.binary(df, ["a", "b", "c"]).collect()}
    assert ("c", "a", "*", "b") in found and ("a", "c", "/", "b") in found
    rows = df.select(ar.holds(df, "c", "a", "*", "b").alias("yes"), ar.holds(df, "d", "a", "*", "a").alias("no")).collect()
    assert all(r["yes"] for r in rows) and not any(r["no"] for r in rows)
    assert rl.expression_rule(df, "id", "c", "a * b").count() == 0
    assert {str(r["new_value"].normalize()) for r in rl.expression_rule(df.where("id = 3"), "id", "d", "a * b").collect()} == {"3E-7"}


def test_expression_status_roots_and_powers(spark):
    df = spark.createDataFrame([("4", "0"), ("2", "1"), (None, "1"), ("-8", "2")], "a string, b string")
    read = lambda e: [None if r[0] is None else float(r[0]) for r in df.select(rl.compile_expression(e)).collect()]
    assert read("sqrt(a)") == [2, None, None, None] and read("a ** (1 / 3)") == [None, None, None, -2] and read("a ** -2") == [0.0625, 0.25, None, 0.015625]
    assert read("product(a, b, 3) + sum(a, b)") == [4, 9, None, -54] and read("max(a, b)") == [4, 2, None, 2]
    assert [r[0] for r in df.select(rl.expression_status("a / b")).collect()] == ["DOMAIN_ERROR", "VALUE", "UNKNOWN", "VALUE"]


@pytest.mark.parametrize(("schema", "good", "bad"), [
    ({"type": "integer"}, ["1", "1.0"], ["1.5", '"1"', "true"]),
    ({"enum": ["a", 1, None]}, ['"a"', "1", "null"], ['"b"']),
    ({"minimum": 2, "exclusiveMaximum": 5, "multipleOf": 0.5}, ["2", "4.5", '"x"'], ["1", "5", "2.2"]),
    ({"minLength": 2, "maxLength": 3, "pattern": "^a"}, ['"ab"', "7"], ['"a"', '"abcd"', '"bb"']),
    ({"minItems": 1, "maxItems": 2, "uniqueItems": True, "items": {"type": "integer"}}, ["[1]", "[1,2]", "{}"], ["[]", "[1,1]", '["a"]', "[1,2,3]"]),
    ({"prefixItems": [{"type": "string"}], "items": {"type": "integer"}}, ['["a",1]', "[]"], ["[1]", '["a","b"]']),
    ({"contains": {"minimum": 5}, "minContains": 1, "maxContains": 1}, ["[1,5]"], ["[1]", "[5,6]"]),
    ({"required": ["a"], "properties": {"a": {"type": "string"}}, "additionalProperties": False}, ['{"a":"x"}', "3"], ["{}", '{"a":1}', '{"a":"x","b":1}']),
    ({"patternProperties": {"^n_": {"type": "number"}}, "propertyNames": {"maxLength": 4}}, ['{"n_a":1}'], ['{"n_a":"x"}', '{"long_name":1}']),
    ({"minProperties": 1, "maxProperties": 1}, ['{"a":1}'], ["{}", '{"a":1,"b":2}']),
    ({"dependentRequired": {"a": ["b"]}, "dependentSchemas": {"c": {"required": ["d"]}}}, ["{}", '{"a":1,"b":2}'], ['{"a":1}', '{"c":1}']),
    ({"allOf": [{"minimum": 1}], "anyOf": [{"const": 1}, {"const": 2}], "not": {"const": 2}}, ["1"], ["2", "3", "0"]),
    ({"oneOf": [{"minimum": 5}, {"multipleOf": 2}]}, ["7", "4"], ["6", "3"]),
    ({"if": {"minimum": 5}, "then": {"maximum": 7}, "else": {"const": 0}}, ["6", "0"], ["8", "3"]),
    ({"$ref": "#/$defs/x", "$defs": {"x": {"type": "string"}}}, ['"a"'], ["1"]),
    ({"$ref": "#/$defs/x", "required": ["c"], "$defs": {"x": {"type": "object", "required": ["b"], "minProperties": 1}}}, ['{"c":1}'], ["{}", '{"b":1}', "1"]),
    ({"$ref": "#/$defs/x", "$defs": {"x": {"$ref": "#/$defs/x"}}}, [], ["1"]),
    ({"$ref": "#/$defs/none"}, [], ["1"]),
    ({"pattern": "(a+)+b"}, ["1"], ['"ab"']),
    ({"properties": {"a'b": {"const": 1}, 'c"d': {"const": 2}}}, ["{}", '{"a\'b":1}'], ['{"a\'b":2}', '{"c\\"d":1}']),
    ({"properties": {"a": {"type": "null"}}, "required": ["a"]}, ['{"a":null}'], ["{}", '{"a":1}']),
    ({"minimum": 0.000000000000000001, "maximum": 1e300}, ["1", "1e299", "0.000000000000000001"], ["0", "-1e200"]),
    (True, ["1"], []), (False, [], ["1"]),
])
def test_schema(spark, schema, good, bad):
    df = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in bad], "raw string, want boolean")
    for r in sc.validate(df, "raw", schema, column="got").select("raw", "want", "got", sc.valid(F.try_parse_json("raw"), schema).alias("inline")).collect():
        assert r["got"] == r["want"] == r["inline"], r
    broken = {r["row_id"] for r in sc.violations(df, "raw", "raw", schema).collect()}
    assert broken == set(bad)


def test_schema_violations_recurse_and_repair(spark):
    tree = {"type": "object", "properties": {"k": {"items": {"$ref": "#/$defs/tree"}}}}
    schema = {
        "type": "object", "required": ["a", "z"], "$defs": {"tree": tree}, "dependentSchemas": {"e": {"properties": {"l": {"minItems": 2}}}}, "patternProperties": {"^n_": {"type": "integer"}},
        "properties": {
            "a": {"type": "integer", "minimum": 5, "multipleOf": 2, "maximum": 9}, "z": {"default": 7}, "e": {"enum": ["Open", "Shut"]}, "l": {"prefixItems": [{"type": "string"}], "items": {"minimum": 3}},
            "c": {"const": {"x": 1}}, "n": {"properties": {"q": {"pattern": "^a"}}, "additionalProperties": False}, "t": {"$ref": "#/$defs/tree"}, "x": {"exclusiveMinimum": 3, "maximum": 9},
        },
        "allOf": [{"if": {"properties": {"e": {"const": "Open"}}, "required": ["e"]}, "then": {"properties": {"a": {"maximum": 6}}}}],
    }
    texts = [
        '{"a":3,"e":"open","l":["x",1,5],"c":{"x":1.0},"n":{"q":"b","w/v":1}}', '{"a":8,"z":null,"e":"Open","l":[1],"c":1}', '{"a":"x","z":1}', "[]",
        '{"a":6,"z":1,"t":{"k":[{}]}}', '{"a":6,"z":1,"x":3,"n_a":"s"}', '{"a":6,"z":1,"x":12}', '{"a":6,"z":1}',
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, raw string")
    got = sorted(((r["row_id"], r["path"], r["code"].removeprefix("schema_"), r["new_value"]) for r in sc.violations(df, "id", "raw", schema).collect()), key=str)
    assert got == sorted([
        (0, "/a", "minimum_violation", "6"), (0, "/a", "multiple_of_violation", "6"), (0, "/e", "enum_violation", '"Open"'), (0, "/l/1", "minimum_violation", "3"), (0, "/n/q", "pattern_violation", None),
        (0, "/n/w~1v", "additional_property", None), (0, "/z", "required_missing", "7"), (1, "/a", "maximum_violation", "6"), (1, "/c", "const_violation", '{"x": 1}'), (1, "/l", "min_items_violation", None),
        (1, "/l/0", "type_violation", None), (2, "/a", "type_violation", None), (3, "", "type_violation", None), (4, "/t/k/0", "ref_cycle", None), (5, "/n_a", "type_violation", None),
        (5, "/x", "exclusive_minimum_violation", None), (6, "/x", "maximum_violation", "9"),
    ], key=str)


def test_boundaries_of_a_number(spark):
    status = lambda x, bounds, integer=False: tuple(spark.createDataFrame([(x,)], "x string").select(*sc.boundary_status(F.col("x"), bounds, integer)).first())
    lattice = {"minimum": 0, "exclusiveMaximum": 10, "multipleOf": 3}
    assert [status(x, lattice)[0] for x in ("-4", "7", "7.5", "12", "3", "x")] == ["UNIQUE", "UNIQUE", "AMBIGUOUS", "UNIQUE", "VALID", "INVALID"]
    assert float(status("12", lattice)[1]) == 9 and status("1", {"exclusiveMinimum": 2})[0] == "NO_MINIMUM" and status("1", {"minimum": 2, "maximum": 1})[0] == "EMPTY"
    assert float(status("1.2", {}, True)[1]) == 1 and float(status("9", {"minimum": 2, "maximum": 5})[1]) == 5
    registry = sc.boundary_registry({"properties": {"a": {"minimum": 3}}, "allOf": [{"properties": {"a": {"maximum": 2}}}]}, rl.parse_rules("b minimum 1\nb exclusiveMaximum 1").simple)
    assert [(r["path"], r["contradiction"]) for r in registry] == [("/a", True), ("/b", True)]


def test_graph_and_states(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("B",)], "id string")
    edges = spark.createDataFrame([("A", "B"), ("B", "X"), (None, "A")], "src string, dst string")
    assert {(r["code"], r["item"]) for r in sy.graph_issues(nodes, edges).collect()} == {("duplicate_node_identity", "B"), ("malformed_edge", "?>A"), ("dangling_edge", "B>X")}
    moves = [("NEW", "PAID"), ("PAID", "SHIPPED"), ("SHIPPED", "DELIVERED")]
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(["NEW", "BAD", "SHIPPED", "DELIVERED"])], "m long, i long, s string")
    got = sy.state_issues(rows, "m", "i", "s", moves, ["NEW"]).first()
    assert (got["row_id"], got["new_value"]) == (1, "PAID")
    assert sy.shortest_path(moves, "NEW", "DELIVERED") == ["NEW", "PAID", "SHIPPED", "DELIVERED"]
    assert sy.plan_migration({"a": {"drop": "x"}, "b": {"drop": "x"}}, {}) is None
    assert sy.plan_migration({"a": {}, "b": {}}, {"a": ["b"], "b": ["a"]}) is None


def test_topological_levels_leave_cycles_out(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id long")
    edges = spark.createDataFrame([(0, 1), (2, 3), (3, 2), (3, 4)], "src long, dst long")
    got = {r["id"]: r["level"] for r in sy.topological_levels(nodes, edges, lambda df, _: df.cache()).collect()}
    assert got == {0: 0, 1: 1}


def test_authority_and_conflict(spark):
    rows = [(1, "f", "a", "b", "x", 3), (1, "f", "a", "c", "y", 1), (2, "f", "a", "b", "x", 3), (2, "f", "a", "c", "y", 3)]
    df = spark.createDataFrame(rows, "row_id long, field string, old_value string, new_value string, analyzer string, tier int")
    allowed, conflicts = rp.authority(df)
    assert [r["new_value"] for r in allowed.collect()] == ["b"]
    assert [r["row_id"] for r in conflicts.collect()] == [2]


@pytest.mark.parametrize("partitions", [1, 5])
def test_fixed_point_inverse_and_idempotence(spark, partitions):
    df = spark.createDataFrame([(i, f"K{i % 4}", i % 4 if i != 9 else 77) for i in range(80)], "id long, k string, v int").repartition(partitions)

    def analyze(t):
        return dep.functional(t, "id", [], [("k", "v")])[1].select("row_id", F.lit("v").alias("field"), "old_value", "new_value", F.lit("fd").alias("analyzer"), F.lit(1).alias("tier"))

    cut = lambda t, _: t.cache()
    done, journal, status = rp.fixed_point(df, "id", ["v"], analyze, cut)
    assert status == "PASS" and done.where("v <> cast(substr(k, 2) as int)").count() == 0
    assert rp.digest(rp.replay_inverse(done, "id", ["v"], journal)) == rp.digest(df)
    assert rp.fixed_point(done, "id", ["v"], analyze, cut)[1] == []


def test_patch_needs_the_old_value(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, f string")
    patches = spark.createDataFrame([(1, "f", "a", "x"), (2, "f", "zzz", "y")], "row_id long, field string, old_value string, new_value string")
    assert {r["id"]: r["f"] for r in rp.apply_patches(df, "id", patches, ["f"]).collect()} == {1: "x", 2: "b"}


@pytest.mark.parametrize(("text", "want"), [
    ('{"a":1}', '{"a":1}'), ('{"a":1,}', '{"a":1}'), ("{a:1}", '{"a":1}'), ("{'a':'it'}", '{"a":"it"}'), ('{"a":1} // c', '{"a":1}'), ('{"a":/* c */1}', '{"a":1}'),
    ('﻿{"a":1}', '{"a":1}'), ('{"a":[1,2', '{"a":[1,2]}'), ('{"a":1 "b":2}', '{"a":1,"b":2}'), ('{"a":"//x"}', '{"a":"//x"}'),
    ('{"a":1,"a":2}', None), ('{"a":NaN}', None), (None, None), ("{'a':'/* keep */'}", '{"a":"/* keep */"}'), ("{'u':'http://x'}", '{"u":"http://x"}'), ('{"s":"\\ud800"}', None), ('{"a":1e999}', None),
    ('{"a":1} x', None), ("{'a':'say \"hi\"'}", '{"a":"say \\"hi\\""}'), ('{"a":1 /* x', None), ('{"a":1\r// c\r,"b":2}', '{"a":1,"b":2}'), ("{'a':'it\\'s'}", '{"a":"it\'s"}'), ('{"a":"b', '{"a":"b"}'),
])
def test_syntax(text, want):
    assert repair(text)[0] == want


def test_sources(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('﻿{"a":1}\n\n{"a":1,"a":2}\n{"a":NaN}\n')
    got = src.read_records(spark, str(tmp_path / "r.jsonl")).select(F.col("value").isNotNull().alias("ok")).collect()
    assert [r["ok"] for r in got] == [True, False, False]
    (tmp_path / "r.json").write_text('[{"a":1},{"a":2}]')
    assert src.read_records(spark, str(tmp_path / "r.json")).count() == 2
    (tmp_path / "b/c").mkdir(parents=True)
    (tmp_path / "b/x.json").write_text("{}")
    (tmp_path / "b/c/y.json").write_text("[1]")
    assert src.read_bundle(spark, str(tmp_path / "b")).where("value is not null").count() == 2
    df = spark.createDataFrame([(2, "b"), (1, "a")], "i long, s string")
    src.write_records(df, str(tmp_path / "out"), "i")
    assert [r["raw"] for r in src.read_records(spark, str(tmp_path / "out"), "jsonl").orderBy("line").collect()] == ['{"s":"a"}', '{"s":"b"}']
    src.write_report({"issues": df, "relations": df}, str(tmp_path / "report"))
    src.write_report({"issues": df.limit(1)}, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report/issues")).count() == 1 and not (tmp_path / "report/relations").exists()
    src.write_report({"issues": df, "relations": df}, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report/issues")).count() == 2


def test_strict_refuses_what_is_no_single_value(spark):
    bad = ['{"a":1} x', '{"a":1e999}', "-1e400", '"\\ud800"', '"\\ude00"', '"\\ud800\\\\ude00"', "1,2", "1] , [2", '1, "v":2', '1},{"v":2', "", " ", '{"a":1,"a":2}', "NaN", "[1", "9" * 400, None]
    good = ['{"a":1}', " 1 ", "null", '"\\ud83d\\ude00"', '"\\\\ud800"', '"1e999"', "\ufeff[1]", "1e300", '"' + "x" * 100_000 + '"', '"' + "\\\\n" * 3000 + '"']
    df = spark.createDataFrame([(t, False) for t in bad] + [(t, True) for t in good], "raw string, want boolean")
    for r in df.select("raw", "want", src.strict(F.col("raw")).isNotNull().alias("got")).collect():
        assert r["got"] == r["want"], r["raw"][:60]


def test_limits_of_long_and_wide_texts(spark):
    texts = ['"' + "x" * 200_000 + '"', '["' + "\\n" * 50_000 + '"]', '"' + "9" * 5000 + '"', "9" * 5000, "[" + "1," * 60 + "1]", '{"' + "k" * 60 + '":1}', '[[],{},[1,2],"a,b"]', '"\\ud800"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    got = df.select("i", src.within_limits(F.col("raw")).alias("ok"), src.within_limits(F.col("raw"), width=50).alias("narrow"), src.within_limits(F.col("raw"), key=50).alias("keys"), src.nodes(F.col("raw")).alias("n"), src.depth(F.col("raw")).alias("d")).orderBy("i").collect()
    assert [r["ok"] for r in got] == [True, True, True, False, True, True, True, False]
    assert not got[4]["narrow"] and got[6]["narrow"] and not got[5]["keys"] and (got[6]["n"], got[6]["d"]) == (7, 2)


def test_limits_refuse(spark):
    df = spark.createDataFrame([("[[1]]",), ('"[[[["',), ("[" * 5 + "]" * 5,)], "raw string")
    assert [r[0] for r in df.select(src.within_limits(F.col("raw"), levels=3)).collect()] == [True, True, False]


def test_bundles_and_documents(spark, tmp_path):
    docs = spark.createDataFrame([("a.json", '{"x":1}'), ("b/c.json", "[1,2]")], "name string, value string")
    assert src.write_bundle(docs, str(tmp_path / "out")) == 2
    assert {r["name"]: r["raw"] for r in src.read_bundle(spark, str(tmp_path / "out")).collect()} == {"a.json": '{\n  "x": 1\n}\n', "b/c.json": "[\n  1,\n  2\n]\n"}
    for bad in ([("../x.json", "1")], [("/x.json", "1")], [("x.json", "{")], [("x.json", "1"), ("x.json", "2")]):
        with pytest.raises(ValueError):
            src.write_bundle(spark.createDataFrame(bad, "name string, value string"), str(tmp_path / "out"))
    assert (tmp_path / "out/a.json").exists()
    with pytest.raises(ValueError):
        src.read_bundle(spark, str(tmp_path / "out"), count=1)
    with pytest.raises(ValueError):
        src.read_document(spark, str(tmp_path / "out/a.json"), limit=3)
    assert src.read_document(spark, str(tmp_path / "out/a.json")).first()["value"] is not None
    (tmp_path / "far.json").write_text("1")
    (tmp_path / "out/link.json").symlink_to(tmp_path / "far.json")
    with pytest.raises(ValueError):
        src.read_bundle(spark, str(tmp_path / "out"))
    src.write_json(spark, {"b": 1, "a": [None]}, str(tmp_path / "one.json"))
    src.write_json(spark, {"b": 2}, str(tmp_path / "one.json"))
    assert (tmp_path / "one.json").read_text() == '{\n  "b": 2\n}\n' and len(list(tmp_path.glob("one.json*"))) == 1
    assert src.envelope("PASS", issues=0) == ('{"exit_code":0,"issues":0,"status":"PASS"}', 0) and src.envelope("IO_ERROR")[1] == 30


def test_trees_and_components(spark):
    raw = spark.createDataFrame([('{"a":{"b":[{"c":null},2]},"d":1.5}',), ('{"a":1,"a":2}',), (None,)], "raw string")
    got = [r[0] for r in raw.select(src.tree(F.col("raw"))).collect()]
    assert [(x["path"], x["kind"]) for x in got[0]] == [("", "object"), ("/a", "object"), ("/a/b", "array"), ("/a/b/0", "object"), ("/a/b/0/c", "null"), ("/a/b/1", "integer"), ("/d", "number")] and got[1:] == [None, None]
    assert [[x["path"] for x in r[0]] for r in raw.limit(1).select(src.leaves(F.col("raw"))).collect()] == [["/a/b", "/d"]]
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000), (2000, 1500), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in sy.components(edges, cutter(spark)).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1500: 1000, 2000: 1000}
    with pytest.raises(RuntimeError):
        sy.reachable(spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long"), spark.range(1), lambda df, _: df.cache(), most=3)


def test_pointers():
    assert fn.unescape(fn.escape("a/b~c")) == "a/b~c"
    import re

    assert re.match(fn.glob_regex("/a/*/c"), "/a/b/c") and not re.match(fn.glob_regex("/a/*/c"), "/a/b/d/c")
    assert re.match(fn.glob_regex("/a/**"), "/a/b/d") and re.match(fn.glob_regex("/a/**"), "/a")


ODD = ['{"a":{"b":[{"c":null,"a":1},2,[{"5":{"z":{}}}]]},"d":1.5}', '[{"b":1,"a/b":{"~":{}}},"x"]', "7", '{"a":1,"a":2}', '{"a":"\\ud800"}', '{"\\ud83d\\ude00":{"\u00e9":[]}}', '{"x":[NaN]}', '{"a":{}} x', "", None]


def test_objects_are_those_of_the_tree(spark):
    raw = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "i int, raw string")
    of_tree = raw.select("i", F.explode(src.tree(F.col("raw"))).alias("n")).where("n.kind = 'object'").select("i", "n.path", F.array_sort(F.json_object_keys("n.value")).alias("keys"))
    got = raw.select("i", F.explode(src.objects(F.col("raw"))).alias("n")).select("i", "n.path", "n.keys")
    assert got.collect() == of_tree.collect() and got.count() == 11
    assert [r["i"] for r in raw.where(src.objects(F.col("raw")).isNull()).collect()] == [3, 4, 6, 7, 8, 9]
    some = raw.select(F.explode(src.objects(F.col("raw"), (("a", "q"), ("c", "d")))).alias("n")).select("n.path", "n.value").collect()
    assert [tuple(r) for r in some] == [("", '{"a":{"b":[{"a":1,"c":null},2,[{"5":{"z":{}}}]]},"d":1.5}'), ("/a/b/0", '{"a":1,"c":null}')]
