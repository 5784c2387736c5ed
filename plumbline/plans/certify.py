"""Queries of conflict analysis, certificates, pointers, syntax steps and stream statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from .. import sources as src
from ..operators import arithmetic as ar
from ..operators import conflicts as cf
from ..operators import profile
from ..sources import syntax
from .declared import _CAND, _candidates
from .inputs import t, using, view


















def json_finite_number(spark, d):
    return t(spark, d, "part").select("p_partkey", fn.finite_decimal(F.col("p_size"), F.col("p_partkey") % 12 + 1).alias("value"))





def agg_spill_registry(spark, d):
    """Exact counts of a determinant with very many groups: the hash aggregate spills, nothing is dropped."""
    return t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("groups"))







def src_schema_openapi(spark, d):
    from ..operators import schema as sc

    document = {"components": {"schemas": {"E": {"type": "object", "properties": {"k": {"$ref": "#/components/schemas/K"}}, "required": ["k"]}, "K": {"type": "integer", "maximum": 50}}}}
    own = sc.openapi_schemas(document)["E"]
    return sc.validate(t(spark, d, "events").select("event_id", "props"), "props", own, root=document).drop("props")


_NAMES = """json_finite_number agg_spill_registry src_schema_openapi"""
QUERIES = {name: globals()[name] for name in _NAMES.split()}
_K = using("cust") + _CAND
ORACLES = {
    "json_finite_number": "WITH x AS (SELECT p_partkey, p_size, p_partkey % 12 + 1 AS q FROM part) SELECT p_partkey, CASE WHEN (p_size::BIGINT * 1000000000) % q = 0 THEN ((p_size::BIGINT * 1000000000) // q)::DECIMAL(38,9) * 0.000000001 END::DECIMAL(38,18) AS value FROM x",
    "agg_spill_registry": "SELECT n, count(*) AS groups FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey) GROUP BY n",
    "src_schema_openapi": "SELECT event_id, (props->>'$.k')::BIGINT <= 50 AS ok FROM events",
}
