"""Structure of documents: recurring containers, moved keys, carriers of graphs, changed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import functions as fn
from .. import sources as src

SHAPE, MIN_ROWS = 0.75, 4
# Names of the lists that make a graph, and of the ends of its edges.
NODES, EDGES, FROM, TO = ("nodes", "vertices"), ("edges", "links"), ("source", "src", "from"), ("target", "dst", "to")


def containers(docs: DataFrame, key: str, raw: str) -> DataFrame:
    """(row_id, path, container, keys): every object of the documents with the name of the member that holds it (its list's
    for an item) and its own keys."""
    nodes = docs.select(F.col(key).alias("row_id"), F.explode(src.objects(F.col(raw))).alias("n"))
    names = F.split("n.path", "/")
    last = F.element_at(names, -1)
    holder = F.when(last.rlike("^[0-9]+$") & (F.size(names) > 2), F.element_at(names, -2)).otherwise(last)
    return nodes.select("row_id", F.col("n.path").alias("path"), holder.alias("container"), F.col("n.keys").alias("keys"))


def morphology(docs: DataFrame, key: str, raw: str, share: float = SHAPE, least: int = MIN_ROWS) -> tuple[DataFrame, DataFrame]:
    """(relations, issues): containers of one name that recur, of which most have one shape (``recursive_morphology``), and
    objects of them that lack a key of it.  What a missing key held is not inferred."""
    found = containers(docs, key, raw)
    counts = found.groupBy("container", "keys").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("container")
    top = counts.withColumns({"observed": F.sum("n").over(by), "r": F.row_number().over(by.orderBy(F.desc("n"), "keys"))}).where(f"r = 1 and observed >= {least} and n / observed >= {share}")
    relations = top.select("container", F.col("keys").alias("shape"), F.col("n").alias("support"), "observed")
    issues = found.join(F.broadcast(relations.select("container", "shape")), "container").select("row_id", "path", F.explode(F.array_except("shape", "keys")).alias("missing"))  # a row for each kind of container
    return relations, issues.withColumn("code", F.lit("recursive_morphology_missing_key"))


def moves(docs: DataFrame, key: str, raw: str, share: float = 0.95) -> DataFrame:
    """(row_id, from_key, to_key): documents that lack one key which nearly all have, and have one that nearly none has, if
    their names are related and the value has the type that the missing key's values have: the key has moved."""
    parsed = docs.select(F.col(key).alias("row_id"), F.from_json(raw, "map<string,string>").alias("m"), F.json_object_keys(raw).alias("keys"))
    total = parsed.agg(F.count(F.lit(1)).alias("total"))
    entries = parsed.select("row_id", F.explode("m").alias("k", "v"))
    kinds = entries.groupBy("k", _kind(F.col("v")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("k")
    keys = kinds.withColumns({"rows": F.sum("n").over(by), "r": F.row_number().over(by.orderBy(F.desc("n"), "kind"))}).where("r = 1").join(F.broadcast(total))
    agreed = keys.where(f"rows >= {share} * total").agg(F.array_sort(F.collect_list(F.struct("k", "kind"))).alias("agreed"))  # as many as there are keys
    lost = F.array_except(F.transform("agreed", lambda a: a["k"]), "keys")
    extra = F.array_except("keys", F.transform("agreed", lambda a: a["k"]))
    found = parsed.join(F.broadcast(agreed)).withColumns({"lost": lost, "extra": extra}).where("size(lost) = 1 and size(extra) = 1")
    found = found.select("row_id", F.get("extra", F.lit(0)).alias("from_key"), F.get("lost", F.lit(0)).alias("to_key"), F.get(F.filter("agreed", lambda a: a["k"] == F.get("lost", F.lit(0))), F.lit(0))["kind"].alias("kind"), "m")
    words = lambda c: F.split(F.lower(F.regexp_replace(c, "-", "_")), "_")
    related = F.size(F.array_intersect(words(F.col("from_key")), words(F.col("to_key")))) > 0
    return found.where(related & (_kind(F.element_at("m", F.col("from_key"))) == F.col("kind"))).select("row_id", "from_key", "to_key")


def _kind(v: Column) -> Column:
    return F.when(v.isNull(), "null").when(v.isin("true", "false"), "boolean").when(fn.exact(v).isNotNull(), "number").when(v.startswith("["), "array").when(v.startswith("{"), "object").otherwise("string")


def graphs(docs: DataFrame, key: str, raw: str) -> DataFrame:
    """(row_id, path, nodes, edges, id_key, from_key, to_key): objects that hold a list of nodes and one of edges.  The keys
    are those that all items have; an object whose items don't agree on one is no carrier."""
    parts = docs.select(F.col(key).alias("row_id"), F.explode(src.objects(F.col(raw), (NODES, EDGES))).alias("n"))
    first = lambda names: F.get(F.array_intersect(F.array(*map(F.lit, names)), "n.keys"), F.lit(0))
    found = parts.withColumns({"nodes": first(NODES), "edges": first(EDGES)}).where("nodes is not null and edges is not null")
    v = F.try_parse_json("n.value")
    items = lambda m, c: F.from_json(F.element_at(m, F.col(c)), "array<map<string,string>>")
    common = lambda c, names: F.get(F.filter(F.array(*map(F.lit, names)), lambda k: F.forall(c, lambda x: F.map_contains_key(x, k))), F.lit(0))

    def keys(w: Column) -> Column:
        named = F.struct(common(w["ns"], ("id", "name", "key")).alias("id_key"), common(w["es"], FROM).alias("from_key"), common(w["es"], TO).alias("to_key"))
        return F.when((F.size(w["ns"]) > 0) & (F.size(w["es"]) > 0), named)

    # Texts are parsed once: a generator's rows are never computed again for a filter on them.
    told = fn.let({"m": F.from_json(F.to_json(v), "map<string,string>")}, lambda u: fn.let({"ns": items(u["m"], "nodes"), "es": items(u["m"], "edges")}, keys))
    keyed = found.select("row_id", F.col("n.path").alias("path"), "nodes", "edges", F.explode(F.array(told)).alias("k"))
    return keyed.where("k.id_key is not null and k.from_key is not null and k.to_key is not null").select("row_id", "path", "nodes", "edges", "k.id_key", "k.from_key", "k.to_key")


def evolution(docs: DataFrame, regime: str, raw: str, share: float = 0.95) -> DataFrame:
    """(key, regimes, missing_in): keys that nearly all documents of some regimes have and none of the others: what has come or
    gone between versions."""
    rows = docs.select(F.col(regime).cast("string").alias("regime"), F.json_object_keys(raw).alias("keys")).where("regime is not null")
    total = rows.groupBy("regime").agg(F.count(F.lit(1)).alias("rows"))
    have = rows.select("regime", F.explode("keys").alias("key")).groupBy("regime", "key").agg(F.count(F.lit(1)).alias("n"))
    grid = have.select("key").distinct().crossJoin(total)  # keys by regimes, a row for each
    told = grid.join(have, ["regime", "key"], "left").withColumn("share", F.coalesce("n", F.lit(0)) / F.col("rows"))
    by_key = told.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("share") >= share, F.col("regime")))).alias("regimes"), F.array_sort(F.collect_list(F.when(F.col("share") == 0, F.col("regime")))).alias("missing_in"), F.count(F.lit(1)).alias("k"))
    return by_key.where("size(regimes) > 0 and size(missing_in) > 0 and size(regimes) + size(missing_in) = k").select("key", F.array_join("regimes", ",").alias("regimes"), F.array_join("missing_in", ",").alias("missing_in"))
