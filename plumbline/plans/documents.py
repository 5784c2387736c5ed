"""Queries of documents: files read and written, pointers, patches, lexical steps, schema keywords."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import functions as fn
from .. import sources as src
from ..operators import patches as pt
from ..operators import schema as sc
from ..sources import syntax
from ..sources.shared import dealt, shared_folder
from .inputs import t, using, view


def _lines(spark, d):
    return t(spark, d, "events").selectExpr("event_id", "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat(props, ' x') ELSE concat('{\"id\":', event_id, ',\"p\":', props, '}') END AS raw")


def src_jsonl(spark, d):
    """Records of a JSONL file written from the events: blank lines are skipped, lines that are no strict JSON have no value."""
    path = shared_folder(spark) + "/lines.jsonl"
    _lines(spark, d).select(F.col("raw").alias("value")).write.text(path)
    read = src.read_records(spark, path)
    return read.select(F.try_variant_get("value", "$.id", "long").alias("id"), F.try_variant_get("value", "$.p.k", "long").alias("k"), F.col("value").isNotNull().alias("valid"))


def src_json_array(spark, d):
    """Records of one file with a top-level array."""
    path = shared_folder(spark) + "/array.json"
    rows = [{"key": r["n_nationkey"], "name": r["n_name"]} for r in t(spark, d, "nation").orderBy("n_nationkey").collect()]  # 25 nations
    src.write_json(spark, rows, path)
    return src.read_records(spark, path).select("line", F.try_variant_get("value", "$.name", "string").alias("name"))


def src_auto_format(spark, d):
    """Files of both formats, read by their names."""
    folder = shared_folder(spark)
    regions = t(spark, d, "region").select("r_regionkey", "r_name")
    out = None
    for name in ("a.jsonl", "b.NDJSON", "c.json"):
        if src.format_of(name) == "jsonl":
            regions.coalesce(1).select(F.to_json(F.struct("r_regionkey", "r_name")).alias("value")).write.text(f"{folder}/{name}")
        else:
            src.write_json(spark, [r.asDict() for r in regions.collect()], f"{folder}/{name}")  # five regions
        one = src.read_records(spark, f"{folder}/{name}").agg(F.count("value").alias("n"), F.sum(F.try_variant_get("value", "$.r_regionkey", "long")).alias("total")).select(F.lit(name).alias("name"), F.lit(src.format_of(name)).alias("format"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


def _region_documents(spark, d):
    n = t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("nations"))
    return n.select(F.concat(F.lit("r"), "n_regionkey", F.lit("/region.json")).alias("name"), F.to_json(F.struct(F.col("n_regionkey").alias("key"), "nations")).alias("value"))


def src_bundle_dir(spark, d):
    """A folder of documents, read with its bounds."""
    folder = shared_folder(spark) + "/bundle"
    src.write_bundle(_region_documents(spark, d), folder)
    return src.read_bundle(spark, folder).select("name", F.try_variant_get("value", "$.key", "long").alias("key"), F.size(F.try_variant_get("value", "$.nations", "array<string>")).alias("nations"))


def src_json_file(spark, d):
    path = shared_folder(spark) + "/one.json"
    src.write_json(spark, {"count": t(spark, d, "part").count(), "max": t(spark, d, "part").agg(F.max("p_size")).first()[0]}, path)
    return src.read_document(spark, path).select(F.try_variant_get("value", "$.count", "long").alias("count"), F.try_variant_get("value", "$.max", "long").alias("max"))


sink_json_atomic = src_json_file


def sink_bundle_staged(spark, d):
    """Documents published twice: the second bundle replaces the first as a whole."""
    folder = shared_folder(spark) + "/bundle"
    documents = _region_documents(spark, d)
    src.write_bundle(documents, folder)
    n = src.write_bundle(documents.where("name <> 'r0/region.json'"), folder)
    return src.read_bundle(spark, folder).agg(F.count("value").alias("n"), F.min("name").alias("first")).withColumn("written", F.lit(n).cast("long"))


def sink_report(spark, d):
    folder = shared_folder(spark) + "/report"
    ord_ = view(spark, d, "ord")
    issues = ord_.where("broken_customer <> customer_id").select("id", F.lit("dangling_reference").alias("code"))
    src.write_report({"issues": issues, "summary": issues.groupBy("code").agg(F.count(F.lit(1)).alias("n"))}, folder)
    return spark.read.parquet(f"{folder}/summary")


def sink_records(spark, d):
    """Records written in order and read back."""
    path = shared_folder(spark) + "/records"
    src.write_records(t(spark, d, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_brand").alias("brand")), path, "p_partkey")
    back = src.read_records(spark, path, "jsonl")
    return back.select(F.try_variant_get("value", "$.size", "long").alias("size"), F.try_variant_get("value", "$.brand", "string").alias("brand"), F.col("raw").startswith('{"size"').alias("in_order"))


def sink_machine_envelope(spark, d):
    open_ = view(spark, d, "ord").where("broken_customer <> customer_id").count()
    text, code = src.envelope("OPEN_REPAIRABLE" if open_ else "PASS", issues=open_)
    return spark.createDataFrame([(text, code)], "envelope string, code int")


# Pointers and patches.


def _nested(spark, d):
    return t(spark, d, "part").selectExpr("p_partkey", """concat('{"a/b":{"list":[', p_size, ',{"n":"', p_brand, '"}]},"k":null}') AS raw""")


def ptr_get(spark, d):
    at = F.when(F.col("p_partkey") % 3 == 0, "/a~1b/list/1/n").when(F.col("p_partkey") % 3 == 1, "/a~1b/list/0").otherwise("/a~1b/none")
    return _nested(spark, d).select("p_partkey", pt.get_at(F.col("raw"), at).alias("value"))


def ptr_set(spark, d):
    at = F.when(F.col("p_partkey") % 3 == 0, "/a~1b/list/1/n").when(F.col("p_partkey") % 3 == 1, "/new").otherwise("/none/x")
    return _nested(spark, d).select("p_partkey", pt.set_at(F.col("raw"), at, F.lit("[true]")).alias("value"))


def ptr_delete(spark, d):
    at = F.when(F.col("p_partkey") % 3 == 0, "/a~1b/list/0").when(F.col("p_partkey") % 3 == 1, "/k").otherwise("/none")
    return _nested(spark, d).select("p_partkey", pt.delete_at(F.col("raw"), at).alias("value"))


def _document_patches(spark, d):
    """Plans of several operations: a test and a move; an add, a copy and a remove; a test that fails."""
    base = t(spark, d, "part").select("p_partkey", "p_size")
    rows = [
        ("p_partkey % 3 = 0", 1, "test", "/k", None, "null"), ("p_partkey % 3 = 0", 2, "move", "/list", "/a~1b/list", None),
        ("p_partkey % 3 = 1", 1, "add", "/a~1b/list/0", None, '"first"'), ("p_partkey % 3 = 1", 2, "copy", "/k2", "/a~1b/list/0", None), ("p_partkey % 3 = 1", 3, "remove", "/k", None, None),
        ("p_partkey % 3 = 2", 1, "replace", "/k", None, "1"), ("p_partkey % 3 = 2", 2, "test", "/k", None, "2"),
    ]
    lit = lambda v: F.lit(v).cast("string")
    parts = [base.where(w).select(F.col("p_partkey").alias("row_id"), F.lit(seq).alias("seq"), lit(op).alias("op"), lit(path).alias("path"), lit(source).alias("source"), lit(value).alias("value")) for w, seq, op, path, source, value in rows]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def patch_operations(spark, d):
    """add, remove, replace, move, copy, test in atomic plans."""
    return pt.patch_documents(_nested(spark, d), "p_partkey", "raw", _document_patches(spark, d)).select("p_partkey", "value", "status")


def patch_document_inverse(spark, d):
    """The inverse of what a plan did gives the canonical document back."""
    done = pt.patch_documents(_nested(spark, d), "p_partkey", "raw", _document_patches(spark, d))
    return done.select("p_partkey", pt.patched(F.col("value"), F.col("inverse"))["value"].alias("value"))


# Lexical steps, each on texts that only it can mend, with strings that it must leave alone.


def _step(spark, d, raw, function):
    @F.pandas_udf("string")
    def run(texts):
        return texts.map(function)

    return t(spark, d, "events").selectExpr("event_id", f"{raw} AS raw").select("event_id", fn.canonical(run("raw")).alias("value"))


_K = "get_json_object(props, '$.k')"


def syn_trailing_comma(spark, d):
    return _step(spark, d, f"concat('{{\"k\":[', {_K}, ' , ],\"s\":\",]\" , }}')", syntax.trailing_commas)


def syn_comments(spark, d):
    return _step(spark, d, f"concat('/* ', event_id, ' */{{\"k\":', {_K}, ',\"s\":\"/* no */ // no\"}} // end')", syntax.strip_comments)


def syn_unquoted_keys(spark, d):
    return _step(spark, d, f"concat('{{k:', {_K}, ', $_x:\"a:b, c:\"}}')", lambda text: syntax.quote_keys(text.replace("$_x", "_x")))


def syn_single_quotes(spark, d):
    raw = f"""replace(concat('{{~k~: ', {_K}, ',~s~:~say "it" ', char(92), '~s~}}'), '~', char(39))"""
    return _step(spark, d, raw, syntax.single_quotes)


def syn_bom(spark, d):
    raw = t(spark, d, "events").select("event_id", F.concat(F.lit(src.BOM), "props").alias("raw"))
    return raw.select("event_id", F.to_json(src.strict(F.col("raw"))).alias("value"))


def syn_edit_frontier(spark, d):
    """How many texts one edit away from a broken one are strict JSON, and how many values those have."""

    @F.pandas_udf("struct<valid:long,values:long>")
    def run(texts):
        import pandas as pd

        out = []
        for text in texts:
            try:
                json.loads(text)
                tries = []
            except json.JSONDecodeError as e:
                tries = set(syntax.frontier(text, e.pos))
            good = []
            for x in tries:
                try:
                    good.append(json.dumps(syntax.parse_strict(x), sort_keys=True))
                except ValueError:
                    pass
            out.append((len(good), len(set(good))))
        return pd.DataFrame(out, columns=["valid", "values"])

    raw = t(spark, d, "events").selectExpr("event_id", f"concat('{{\"a\":{{\"k\":', {_K}, '}}') AS raw")
    return raw.select("event_id", run("raw").alias("r")).select("event_id", (F.col("r.valid") > 0).alias("mended"), F.col("r.values").alias("values"))


def sec_limits(spark, d):
    """Depth, length, digits and strings beyond their bounds; long strings are no depth."""
    raw = t(spark, d, "part").selectExpr("p_partkey AS id", """CASE p_partkey % 4 WHEN 0 THEN concat(repeat('[', p_size), '1', repeat(']', p_size)) WHEN 1 THEN concat('"', repeat('[', 5000), '"') WHEN 2 THEN concat('[', repeat('9', p_size), ']') ELSE concat('["', repeat('9', 60), '",', p_size, ']') END AS raw""")
    return raw.select("id", src.within_limits(F.col("raw"), text=6000, levels=40, number=30).alias("ok"), src.nodes(F.col("raw")).cast("long").alias("nodes"))


# Each schema keyword: rows that it refuses, with the repair if it has one.

_KEYWORDS = {
    "type": ({"type": "integer"}, "CASE WHEN {n} % 3 = 0 THEN '\"x\"' WHEN {n} % 3 = 1 THEN {n} || '.0' ELSE {n} || '.5' END", "{n} % 3 <> 1", "type_violation", None),
    "const": ({"const": 7}, "{s}", "{s} <> 7", "const_violation", "'7'"),
    "enum": ({"enum": ["Ab", "c"]}, "CASE WHEN {n} % 2 = 0 THEN '\"AB\"' ELSE '\"c\"' END", "{n} % 2 = 0", "enum_violation", "'\"Ab\"'"),
    "minimum": ({"minimum": 10}, "{s}", "{s} < 10", "minimum_violation", "'10'"),
    "maximum": ({"maximum": 10.5}, "{s}", "{s} > 10", "maximum_violation", "'10.5'"),
    "exclusiveMinimum": ({"exclusiveMinimum": 10, "type": "integer"}, "{s}", "{s} <= 10", "exclusive_minimum_violation", "'11'"),
    "exclusiveMaximum": ({"exclusiveMaximum": 10}, "{s}", "{s} >= 10", "exclusive_maximum_violation", None),
    "multipleOf": ({"multipleOf": 4}, "{s}", "{s} % 4 <> 0", "multiple_of_violation", "CASE {s} % 4 WHEN 1 THEN ({s} - 1) || '' WHEN 3 THEN ({s} + 1) || '' END"),
    "minLength": ({"minLength": 3}, "'\"' || repeat('x', {s} % 6) || '\"'", "{s} % 6 < 3", "min_length_violation", None),
    "maxLength": ({"maxLength": 3}, "'\"' || repeat('x', {s} % 6) || '\"'", "{s} % 6 > 3", "max_length_violation", None),
    "pattern": ({"pattern": "^x{2}y?$"}, "'\"' || repeat('x', {s} % 6) || '\"'", "{s} % 6 <> 2", "pattern_violation", None),
    "minItems": ({"minItems": 2}, "'[' || CASE WHEN {n} % 2 = 0 THEN '1' ELSE '1,2,3' END || ']'", "{n} % 2 = 0", "min_items_violation", None),
    "maxItems": ({"maxItems": 2}, "'[' || CASE WHEN {n} % 2 = 0 THEN '1' ELSE '1,2,3' END || ']'", "{n} % 2 <> 0", "max_items_violation", None),
    "uniqueItems": ({"uniqueItems": True}, "'[1,' || CASE WHEN {n} % 2 = 0 THEN '1.0' ELSE 'true' END || ']'", "{n} % 2 = 0", "unique_items_violation", None),
    "prefixItems": ({"prefixItems": [True, {"minimum": 10}]}, "'[0,' || {s} || ',0]'", "{s} < 10", "minimum_violation@/1", "'10'"),
    "items": ({"prefixItems": [True], "items": {"minimum": 10}}, "'[0,' || {s} || ']'", "{s} < 10", "minimum_violation@/1", "'10'"),
    "contains": ({"contains": {"minimum": 10}}, "'[1,' || {s} || ']'", "{s} < 10", "min_contains_violation", None),
    "maxContains": ({"contains": {"minimum": 10}, "maxContains": 1}, "'[10,' || {s} || ']'", "{s} >= 10", "max_contains_violation", None),
    "minProperties": ({"minProperties": 2}, "CASE WHEN {n} % 2 = 0 THEN '{{\"a\":1}}' ELSE '{{\"a\":1,\"b\":2,\"c\":3}}' END", "{n} % 2 = 0", "min_properties_violation", None),
    "maxProperties": ({"maxProperties": 2}, "CASE WHEN {n} % 2 = 0 THEN '{{\"a\":1}}' ELSE '{{\"a\":1,\"b\":2,\"c\":3}}' END", "{n} % 2 <> 0", "max_properties_violation", None),
    "required": ({"required": ["b"], "properties": {"b": {"default": [1]}}}, "CASE WHEN {n} % 2 = 0 THEN '{{\"a\":1}}' ELSE '{{\"b\":1}}' END", "{n} % 2 = 0", "required_missing@/b", "'[1]'"),
    "properties": ({"properties": {"a": {"properties": {"b": {"maximum": 10}}}}}, "'{{\"a\":{{\"b\":' || {s} || '}}}}'", "{s} > 10", "maximum_violation@/a/b", "'10'"),
    "patternProperties": ({"patternProperties": {"^n": {"maximum": 10}}}, "'{{\"n1\":' || {s} || ',\"m\":99}}'", "{s} > 10", "maximum_violation@/n1", "'10'"),
    "additionalProperties": ({"properties": {"a": True}, "additionalProperties": False}, "CASE WHEN {n} % 2 = 0 THEN '{{\"a\":1,\"z\":2}}' ELSE '{{\"a\":1}}' END", "{n} % 2 = 0", "additional_property@/z", None),
    "propertyNames": ({"propertyNames": {"maxLength": 1}}, "CASE WHEN {n} % 2 = 0 THEN '{{\"ab\":1}}' ELSE '{{\"a\":1}}' END", "{n} % 2 = 0", "property_name_violation@/ab", None),
    "dependentRequired": ({"dependentRequired": {"a": ["b"]}, "properties": {"b": {"default": 0}}}, "CASE WHEN {n} % 2 = 0 THEN '{{\"a\":1}}' ELSE '{{\"c\":1}}' END", "{n} % 2 = 0", "dependent_required_missing@/b", "'0'"),
    "dependentSchemas": ({"dependentSchemas": {"a": {"properties": {"b": {"minimum": 10}}}}}, "'{{\"' || CASE WHEN {n} % 2 = 0 THEN 'a' ELSE 'c' END || '\":1,\"b\":' || {s} || '}}'", "{n} % 2 = 0 AND {s} < 10", "minimum_violation@/b", "'10'"),
    "allOf": ({"allOf": [{"minimum": 10}, {"maximum": 20}]}, "{s}", "{s} < 10", "minimum_violation", "'10'"),
    "anyOf": ({"anyOf": [{"maximum": 10}, {"multipleOf": 20}]}, "{s}", "{s} > 10 AND {s} % 20 <> 0", "anyof_violation", None),
    "oneOf": ({"oneOf": [{"maximum": 10}, {"multipleOf": 5}]}, "{s}", "({s} <= 10) = ({s} % 5 = 0)", "oneof_violation", None),
    "not": ({"not": {"multipleOf": 2}}, "{s}", "{s} % 2 = 0", "not_violation", None),
    "if": ({"if": {"minimum": 10}, "then": {"multipleOf": 1000}, "else": {"const": 1}}, "{s}", "{s} >= 10", "multiple_of_violation", "CASE WHEN {s} < 500 THEN '0' END"),
    "ref": ({"$ref": "#/$defs/x", "maximum": 20, "$defs": {"x": {"minimum": 10, "maximum": 5}}}, "{s}", "{s} > 20", "maximum_violation", "'20'"),
    "false": ({"properties": {"a": False}}, "CASE WHEN {n} % 2 = 0 THEN '{{\"a\":1}}' ELSE '{{}}' END", "{n} % 2 = 0", "false_violation@/a", None),
}
#: Codes that a keyword's schema also gives, which its row leaves out.
_BESIDE = ("schema_const_violation",)


def _keyword(name):
    schema, text, _, code, _ = _KEYWORDS[name]
    code, _, path = code.partition("@")

    def query(spark, d):
        raw = t(spark, d, "part").selectExpr("p_partkey", f"CAST({text.format(n='p_partkey', s='p_size')} AS STRING) AS raw")
        raw = dealt(raw, "p_partkey")
        found = sc.violations(raw, "p_partkey", "raw", schema).where(F.col("code") == f"schema_{code}")
        ok = sc.validate(raw, "raw", schema)
        return ok.join(found.withColumnRenamed("row_id", "p_partkey"), "p_partkey", "left").select("p_partkey", "path", "new_value", "ok")

    query.__doc__ = f"Violations and validity by the keyword {name}."
    return query


def _keyword_sql(name):
    schema, _, bad, code, new = _KEYWORDS[name]
    fill = lambda x: x.format(n="p_partkey", s="p_size")
    wrong = {"if": "p_size >= 10 AND p_size % 1000 <> 0 OR p_size < 10 AND p_size <> 1", "allOf": "p_size < 10 OR p_size > 20", "ref": "p_size < 10 OR p_size > 20"}.get(name, fill(bad))
    return f"SELECT p_partkey, CASE WHEN {fill(bad)} THEN '{code.partition('@')[2]}' END AS path, CASE WHEN {fill(bad)} THEN {fill(new) if new else 'NULL'} END::VARCHAR AS new_value, NOT ({wrong}) AS ok FROM part"


_NAMES = """src_jsonl src_json_array src_auto_format src_bundle_dir src_json_file sink_json_atomic sink_bundle_staged sink_report sink_records sink_machine_envelope ptr_get ptr_set ptr_delete patch_operations patch_document_inverse
syn_trailing_comma syn_comments syn_unquoted_keys syn_single_quotes syn_bom syn_edit_frontier sec_limits"""
QUERIES = {name: globals()[name] for name in _NAMES.split()} | {f"schema_{k}": _keyword(k) for k in _KEYWORDS}
_DOC = """WITH p AS (SELECT p_partkey, p_size AS s, p_brand AS b FROM part) """
_ONE = "SELECT count(*) AS count, max(p_size)::BIGINT AS max FROM part"
_J = "(props->>'$.k')"
ORACLES = {
    "src_jsonl": "SELECT CASE WHEN event_id % 5 > 1 THEN event_id END AS id, CASE WHEN event_id % 5 > 1 THEN (props->>'$.k')::BIGINT END AS k, event_id % 5 > 1 AS valid FROM events WHERE event_id % 5 <> 0",
    "src_json_array": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS line, n_name AS name FROM nation",
    "src_auto_format": "SELECT f.name, f.format, count(*) AS n, sum(r_regionkey)::BIGINT AS total FROM region, (VALUES ('a.jsonl', 'jsonl'), ('b.NDJSON', 'jsonl'), ('c.json', 'array')) f(name, format) GROUP BY ALL",
    "src_bundle_dir": "SELECT 'r' || n_regionkey || '/region.json' AS name, n_regionkey::BIGINT AS key, count(*)::INT AS nations FROM nation GROUP BY n_regionkey",
    "src_json_file": _ONE, "sink_json_atomic": _ONE,
    "sink_bundle_staged": "SELECT count(DISTINCT n_regionkey) AS n, 'r' || min(n_regionkey) || '/region.json' AS first, count(DISTINCT n_regionkey) AS written FROM nation WHERE n_regionkey > 0",
    "sink_report": using("ord") + "SELECT 'dangling_reference' AS code, count(*) AS n FROM ord WHERE broken_customer <> customer_id",
    "sink_records": "SELECT p_size::BIGINT AS size, p_brand AS brand, true AS in_order FROM part",
    "sink_machine_envelope": using("ord") + "SELECT '{\"exit_code\":' || CASE WHEN count(*) > 0 THEN 11 ELSE 0 END || ',\"issues\":' || count(*) || ',\"status\":\"' || CASE WHEN count(*) > 0 THEN 'OPEN_REPAIRABLE' ELSE 'PASS' END || '\"}' AS envelope, CASE WHEN count(*) > 0 THEN 11 ELSE 0 END::INT AS code FROM ord WHERE broken_customer <> customer_id",
    "ptr_get": _DOC + "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '\"' || b || '\"' WHEN 1 THEN s::VARCHAR END AS value FROM p",
    "ptr_set": _DOC + """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{"a/b":{"list":[' || s || ',{"n":[true]}]},"k":null}' WHEN 1 THEN '{"a/b":{"list":[' || s || ',{"n":"' || b || '"}]},"k":null,"new":[true]}' END AS value FROM p""",
    "ptr_delete": _DOC + """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{"a/b":{"list":[{"n":"' || b || '"}]},"k":null}' WHEN 1 THEN '{"a/b":{"list":[' || s || ',{"n":"' || b || '"}]}}' END AS value FROM p""",
    "patch_operations": _DOC + """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{"a/b":{},"k":null,"list":[' || s || ',{"n":"' || b || '"}]}' WHEN 1 THEN '{"a/b":{"list":["first",' || s || ',{"n":"' || b || '"}]},"k2":"first"}'
        ELSE '{"a/b":{"list":[' || s || ',{"n":"' || b || '"}]},"k":null}' END AS value, CASE WHEN p_partkey % 3 = 2 THEN 'REFUSED' ELSE 'APPLIED' END AS status FROM p""",
    "patch_document_inverse": _DOC + """SELECT p_partkey, '{"a/b":{"list":[' || s || ',{"n":"' || b || '"}]},"k":null}' AS value FROM p""",
    "syn_trailing_comma": f"SELECT event_id, '{{\"k\":[' || {_J} || '],\"s\":\",]\"}}' AS value FROM events",
    "syn_comments": f"SELECT event_id, '{{\"k\":' || {_J} || ',\"s\":\"/* no */ // no\"}}' AS value FROM events",
    "syn_unquoted_keys": f"SELECT event_id, '{{\"_x\":\"a:b, c:\",\"k\":' || {_J} || '}}' AS value FROM events",
    "syn_single_quotes": f"SELECT event_id, '{{\"k\":' || {_J} || ',\"s\":\"say \\\"it\\\" ''s\"}}' AS value FROM events",
    "syn_bom": f"SELECT event_id, '{{\"k\":' || {_J} || '}}' AS value FROM events",
    "syn_edit_frontier": "SELECT event_id, true AS mended, 1::BIGINT AS values FROM events",
    "sec_limits": "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_size <= 40 WHEN 1 THEN true WHEN 2 THEN p_size < 30 ELSE true END AS ok, CASE p_partkey % 4 WHEN 0 THEN p_size + 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END::BIGINT AS nodes FROM part",
} | {f"schema_{k}": _keyword_sql(k) for k in _KEYWORDS}
