"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that they belong to).  Each pattern offers its words
up to ``max_repeats`` times, every further repetition at a higher cost; the cheapest flow from patterns to source quotas
says how many words of each pattern each source takes.  A pattern is then taken whole as often as its flow allows and
the rest is filled with documents in the order of a keyed hash.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Workspace, count_words, table

WEIGHTS = (5.0, 2.0, 1.0)
SEED = "mix-1"
#: Hex digits of the keyed hash by which a pattern's documents are dealt into 16**BUCKET_DIGITS ordered buckets.
BUCKET_DIGITS = 3
#: Most patterns of sources that the driver solves.
MAX_PATTERNS = 10_000
#: Behind every hexadecimal digit.
AFTER_ALL = "g"


def targets(sizes: list[float], weights: list[float], total: float, max_repeats: float) -> list[float]:
    """Shares of total by weight, none above max_repeats times its size; what a cap frees is shared by weight again."""
    order = sorted(range(len(sizes)), key=lambda i: (max_repeats * sizes[i] / weights[i], i))
    left, weight, out = float(total), float(sum(weights)), [0.0] * len(sizes)
    for at, i in enumerate(order):
        level = left / weight if weight > 0 else 0.0
        if max_repeats * sizes[i] / weights[i] >= level:
            for j in order[at:]:
                out[j] = min(level * weights[j], float(max_repeats * sizes[j]))
            break
        out[i] = float(max_repeats * sizes[i])
        left, weight = left - out[i], weight - weights[i]
    return out


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int], max_repeats: int) -> list[dict[int, int]]:
    """Words that each pattern gives each of its sources.  The k-th use of a pattern's words costs k - 1 a word.

    Successive cheapest augmenting paths; the graph has a node for each pattern and source, so its size does not depend
    on the number of documents.
    """
    n, m = len(capacity), len(quota)
    start, end = n + m, n + m + 1
    to, left, cost, out = [], [], [], defaultdict(list)

    def arc(u: int, v: int, most: int, price: int) -> int:
        for x, y, c, p in ((u, v, most, price), (v, u, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            left.append(c)
            cost.append(p)
        return len(to) - 2

    for p in range(n):
        for k in range(max_repeats):
            arc(start, p, capacity[p], k)
    between = {(p, s): arc(p, n + s, 1 << 62, 0) for p in range(n) for s in members[p]}
    for s in range(m):
        arc(n + s, end, quota[s], 0)
    while True:
        far, came, queue, queued = {start: 0}, {}, deque([start]), {start}
        while queue:
            u = queue.popleft()
            queued.discard(u)
            for e in out[u]:
                v = to[e]
                if left[e] > 0 and far[u] + cost[e] < far.get(v, 1 << 60):
                    far[v], came[v] = far[u] + cost[e], e
                    if v not in queued:
                        queued.add(v)
                        queue.append(v)
        if end not in far:
            break
        path, v = [], end
        while v != start:
            path.append(came[v])
            v = to[came[v] ^ 1]
        flow = min(left[e] for e in path)
        for e in path:
            left[e] -= flow
            left[e ^ 1] += flow
    return [{s: left[between[p, s] ^ 1] for s in members[p] if left[between[p, s] ^ 1]} for p in range(n)]


def _temporary(columns: list[str], *names: str) -> list[str]:
    """The names, with as many underscores before them as no column has."""
    mark = "_"
    while any(f"{mark}{n}" in columns for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def mix(docs: DataFrame, doc_id: str, size: str, sources: str, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = 3, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, plan).  documents: the given rows with ``repeats`` (times taken, 0 to max_repeats), ``taken`` (words)
    and ``takers`` (the source that each repetition counts for); given columns of these three names are replaced, all
    others stay as they are.  plan: source, source_size, target, planned.

    sources is an array column; a null array or element stands for the null source, which sorts last.  Weights repeat
    over the sources in code point order.  A null size counts as 0 and such documents are never taken.  A pattern's
    documents are taken in the order of a keyed hash of their id (of the whole row if the id is null) up to the one that
    ends nearest to what the flow asks for.  Rows with one hash, repeated ids that is, are taken or left together, so
    reruns agree whatever the partitions.  An empty table gives empty results.

    A plan of cuts is all that reaches the rows: which hash each pattern is taken up to.  It is found from sums over
    buckets of the hash and a look into the one bucket of each cut; so no text is shuffled.  The patterns are counted
    first; more than MAX_PATTERNS are refused, as the flow between them and the sources is solved on the driver.
    """
    spark = docs.sparkSession
    n_, p_, o_, b_, r_ = _temporary(docs.columns, "size", "pattern", "order", "bucket", "route")
    keyed = F.array_sort(F.array_distinct(F.transform(F.coalesce(F.col(sources), F.array(F.lit(None).cast("string"))), lambda s: F.when(s.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), s)))))
    keyed = F.when(F.size(keyed) == 0, F.array(F.lit("1"))).otherwise(keyed)
    hashed = [f"`{f.name}`" for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    own = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("row "), F.xxhash64(*hashed).cast("string")))
    marked = docs.withColumns({n_: F.coalesce(F.col(size).cast("long"), F.lit(0)), p_: keyed, o_: F.md5(F.concat_ws(":", F.lit(seed), own).cast("binary"))})
    # Sizes may cost a pass over the texts, so what decides is written once; the texts are read again where rows are chosen.
    work = Workspace(spark, "mixing")
    slim = work.write(marked.select(F.col(n_).alias("size"), F.col(p_).alias("pattern"), F.col(o_).alias("order"), F.substring(o_, 1, BUCKET_DIGITS).alias("bucket")), "slim")

    totals = slim.groupBy("pattern").agg(F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of sources; merge sources that always come together")
    found = sorted((tuple(r["pattern"]), r["n"]) for r in totals)
    names = sorted({s for p, _ in found for s in p}, key=lambda s: (s[0], s[1:]))
    index = {s: i for i, s in enumerate(names)}
    members = [[index[s] for s in p] for p, _ in found]
    sizes = [0] * len(names)
    for (_, n), of in zip(found, members, strict=True):
        for i in of:
            sizes[i] += n
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], sum(n for _, n in found), max_repeats)
    flows = min_cost_flow([n for _, n in found], members, [int(t) for t in wanted], max_repeats)
    whole = {s: None if s[0] == "1" else s[1:] for s in names}
    plan = spark.createDataFrame([(whole[s], sizes[i], wanted[i], sum(f.get(i, 0) for f in flows)) for i, s in enumerate(names)], "source string, source_size long, target double, planned long")

    # The k-th use of a pattern runs through its documents from place 0 to its size; a cut is a place within one use.
    cuts: list[tuple[list[str], int, int]] = []
    routes: list[tuple[list[str], int, list[tuple[int, int, str]]]] = []
    for (pattern, n), flow in zip(found, flows, strict=True):
        full, rest = divmod(sum(flow.values()), n) if n else (0, 0)
        takers, at = [], 0
        for s, given in sorted(flow.items()):
            while given:
                use, place = divmod(at, n)
                step = min(given, n - place)
                takers.append((use, place + step, whole[names[s]]))
                at, given = at + step, given - step
        routes.append((list(pattern), full, takers))
        cuts += [(list(pattern), use, end) for use, end, _ in takers if end < n]
    ends = _places(slim, cuts, spark)
    work.drop("slim")
    rows = []
    for pattern, full, takers in routes:
        steps = [(use, ends.get((tuple(pattern), use, end), AFTER_ALL), taker) for use, end, taker in takers]
        rows.append((pattern, steps))
    step = T.StructType([T.StructField("use", T.IntegerType()), T.StructField("before", T.StringType()), T.StructField("taker", T.StringType())])
    shape = T.StructType([T.StructField(p_, T.ArrayType(T.StringType())), T.StructField(r_, T.ArrayType(step))])
    placed = marked.join(F.broadcast(spark.createDataFrame(rows, shape)), p_)  # a row for each pattern, MAX_PATTERNS at most
    # Of each use the first step whose cut lies behind the document takes it.
    mine = F.filter(r_, lambda x: F.col(o_) < x["before"])
    first = F.transform(F.array_distinct(F.transform(mine, lambda x: x["use"])), lambda u: F.get(F.filter(mine, lambda x: x["use"] == u), F.lit(0))["taker"])
    takers = F.when(F.col(n_) > 0, first).otherwise(F.array().cast("array<string>"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("repeats", "taken", "takers")]
    placed = placed.select(*kept, n_, takers.alias("takers")).withColumn("repeats", F.size("takers").cast("long"))
    return placed.select(*kept, "repeats", (F.col("repeats") * F.col(n_)).alias("taken"), "takers"), plan


def _places(slim: DataFrame, cuts: list[tuple[list[str], int, int]], spark: SparkSession) -> dict[tuple, str]:
    """For each cut (pattern, use, place) the least hash of the pattern that isn't before it.  Rows of one hash are before a
    cut if their middle is."""
    if not cuts:
        return {}
    sums = slim.groupBy("pattern", "bucket").agg(F.sum("size").alias("n"))
    order = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("end", F.sum("n").over(order)).withColumn("base", F.col("end") - F.col("n"))
    shape = T.StructType([T.StructField("pattern", T.ArrayType(T.StringType())), T.StructField("use", T.IntegerType()), T.StructField("place", T.LongType())])
    asked = F.broadcast(spark.createDataFrame(cuts, shape))  # at most one for each pattern and source of it, and one more
    where = sums.join(asked, "pattern").where("place >= base and place < end").select("pattern", "bucket", "use", "place", "base")
    groups = slim.join(F.broadcast(where.select("pattern", "bucket").distinct()), ["pattern", "bucket"]).groupBy("pattern", "bucket", "order").agg(F.sum("size").alias("n"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = groups.withColumn("to", F.sum("n").over(inside))
    behind = groups.join(F.broadcast(where), ["pattern", "bucket"]).where("2 * (base + to) - n > 2 * place").groupBy("pattern", "use", "place").agg(F.min("order").alias("before"))
    found = {(tuple(r["pattern"]), r["use"], r["place"]): r["bucket"] + AFTER_ALL for r in where.collect()}
    return found | {(tuple(r["pattern"]), r["use"], r["place"]): r["before"] for r in behind.collect()}


def op10_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array("source").alias("sources"), count_words("text").alias("size"))
    taken, plan = mix(docs, "doc_id", "size", "sources")
    taken = taken.withColumn("_source", F.element_at("sources", 1))
    plan = plan.withColumnRenamed("source", "_source")
    own = taken["_source"].eqNullSafe(plan["_source"])
    return taken.join(F.broadcast(plan), own).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight FROM s),
r AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio FROM w),
c AS (SELECT *, (SELECT sum(size) FROM d)::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER o, 0) AS room, (sum(weight) OVER ()) - coalesce(sum(weight) OVER o, 0) AS rest
      FROM r WINDOW o AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(room / rest, ratio) AS level FROM c WHERE ratio >= room / rest),
t AS (SELECT source, source_size, least(coalesce(level, 1e300) * weight, 3.0::DOUBLE * source_size) AS target FROM r, l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS used,
      sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws(':', 'mix-1', d.doc_id::VARCHAR)), d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE size * (used // source_size + CASE WHEN 2 * upto - size <= 2 * (used % source_size) THEN 1 ELSE 0 END) END::BIGINT AS taken FROM p
"""
