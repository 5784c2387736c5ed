"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

The statistics of a text are transformed to five roughly symmetric numbers.  Each group's centre and scatter come from
the minimum covariance determinant: from three deterministic starts (no correlation, and the correlations of two bounded
transforms of the numbers) concentration steps keep the three quarters of the documents that are nearest by the last
estimate and estimate again from those, until the determinant no longer falls; of the three ends the one of least
determinant counts.  So junk, up to a quarter of a group, doesn't shape what it is judged by.  A document far from its
group's centre by Mahalanobis distance is rejected.

Groups are (language, source).  Estimates are made for all documents, for each language and for each group, and each is
drawn towards its parent's as if the parent came with PRIOR documents: a large group is judged by itself, a small one
mostly by its language, and nothing switches at a size.

All of it is SQL.  The numbers are held as multiples of 1/1024, so that sums are exact integers whatever the order in
which partitions are added.  A step is one pass over the numbers: moments are added up for each group, start and bin of
distance, and which bins hold the nearest three quarters is found from those sums.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, Workspace, broadcast_if_small, table

SYMBOLS = "#*$%&|<>"
GAP = " \t\n\x0b\f\r"
UNIT = 1024
#: The transformed statistics, in SQL that Spark and DuckDB share, and for each the least standard deviation assumed:
#: most documents have no symbols or repeats at all, and a scatter of zero would reject every other one.
FEATURES = (
    ("log2(1.0 + n_words)", 0.5),
    ("log2((1.0 + word_chars) / (1.0 + n_words))", 0.15),
    ("sqrt(n_symbols / (1.0 + word_chars))", 0.05),
    ("sqrt(n_dup_lines / (1.0 + n_words))", 0.05),
    ("sqrt(n_repeat_words / (1.0 + n_words))", 0.08),
)
D = len(FEATURES)
KEEP = 0.75
#: 0.75 / P(chi2_7 <= q) with P(chi2_5 <= q) = 0.75: makes the scatter of the nearest three quarters that of a normal sample.
CONSISTENCY = 1.4121
#: Squared distance beyond which a document is rejected: the chi-square quantile of 5 degrees for a chance of 1 in 100,000.
CUTOFF = 30.856
#: Documents that the estimate of a group's parent counts for.
PRIOR = 50.0
STARTS = 3
#: Steps of the SQL that the query is compared with; the query itself goes on until no determinant falls.
SQL_STEPS = 16
_PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The given rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.  A null text is empty.

    Repeats are found inside the row: hashes of words, hashes of eight of them, a sort of those with their places if any
    occurs twice.  So a long text costs n log n and nothing is shuffled."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  evaluates value once
    own = F.coalesce(F.col(text), F.lit(""))
    # Without white space at its ends a text splits into words only, so none has to be filtered out.
    inner = F.btrim(own, F.lit(GAP))
    words = F.when(inner != "", F.split(inner, SPACE)).otherwise(F.array().cast("array<string>"))
    symbols = functools.reduce(lambda a, b: a + b, (F.octet_length(own) - F.octet_length(F.replace(own, F.lit(c), F.lit(""))) for c in SYMBOLS))

    def covered(places):
        """Words in the 8-word windows that start at these ascending places."""
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
        step = lambda a, p: F.struct((p + 8).alias("end"), (a["total"] + p + 8 - F.greatest(p, a["end"])).alias("total"))
        return F.aggregate(places, zero, step, lambda a: a["total"])

    def twice(grams):
        placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda v, i: F.coalesce(F.get(s, i - 1)["g"] == v["g"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["g"] == v["g"], F.lit(False)))
        return covered(F.array_sort(F.transform(let(placed, again), lambda v: v["i"])))

    def repeats(h):
        grams = F.transform(F.sequence(F.lit(1), F.size(h) - 7), lambda i: F.xxhash64(F.slice(h, i, 8)))
        return F.when(F.size(h) >= 8, let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(twice(g)))).otherwise(F.lit(0))

    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), let(hashed(w), repeats).cast("long").alias("n_repeat_words")))
    lines = F.filter(F.split(own, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    dup_lines = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    out = docs.withColumns({"_counted": counted, "n_symbols": symbols.cast("long"), "n_dup_lines": dup_lines})
    return out.withColumns({c: F.col(f"_counted.{c}") for c in ("n_words", "word_chars", "n_repeat_words")}).drop("_counted")


BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def _quantised() -> list[str]:
    return [f"CAST(floor({sql} * {UNIT}.0 + 0.5) AS BIGINT) AS z{i}" for i, (sql, _) in enumerate(FEATURES)]


def _keys(lang: str, source: str) -> list[str]:
    """A document's group at each level: all, its language, its language and source.  A null is a value of its own."""
    named = f"coalesce(CAST(length({lang}) AS STRING) || ':' || {lang}, '-')"
    return ["'0'", f"'1' || {named}", f"'2' || {named} || coalesce(':' || {source}, '')"]


_Z = [f"z{i}" for i in range(D)]
_MOMENTS = ["n", *(f"s{i}" for i in range(D)), *(f"s{i}_{j}" for i, j in _PAIRS)]
_PARAMETERS = [*(f"m{i}" for i in range(D)), *(f"w{i}_{j}" for i, j in _PAIRS)]
_STATE = [*_PARAMETERS, *(f"c{i}_{j}" for i, j in _PAIRS), "det"]
_SCALES = [f"greatest(1.4826e0 * CAST(d{i} AS DOUBLE), {FEATURES[i][1] * UNIT!r}e0) AS a{i}" for i in range(D)]


def _sums(names: list[str], tag: str, centred: bool) -> list[str]:
    """Sums of products, and of the values themselves, of integers."""
    out = [f"sum({names[i]} * {names[j]}) AS {tag}{i}_{j}" for i, j in _PAIRS]
    return [*(f"sum({x}) AS {tag}{i}" for i, x in enumerate(names)), *out] if centred else out


def _bounded() -> list[list[str]]:
    """Selections that add to each document's numbers, scaled as y, two bounded forms as integers: t by coordinates, u by
    the length of the whole vector."""
    scaled = [f"(z{i} - m{i}) / a{i} AS y{i}" for i in range(D)]
    length = "sqrt(" + " + ".join(f"y{i} * y{i}" for i in range(D)) + ") AS r"
    near = [f"CAST(floor(1024.0e0 * (y{i} / (1.0e0 + abs(y{i}))) + 0.5e0) AS BIGINT) AS t{i}" for i in range(D)]
    return [scaled, [length, *near], [f"CASE WHEN r > 0.0e0 THEN CAST(floor(1024.0e0 * (y{i} / r) + 0.5e0) AS BIGINT) ELSE 0 END AS u{i}" for i in range(D)]]


def _start(number: int) -> list[list[str]]:
    """Selections from scales and the sums of the bounded forms to a scatter: correlations times the robust scales."""
    if number == 0:
        return [[(f"a{i} * a{i}" if i == j else "0.0e0") + f" AS c{i}_{j}" for i, j in _PAIRS]]
    if number == 1:
        spread = [f"CAST(t{i}_{j} AS DOUBLE) / n - (CAST(t{i} AS DOUBLE) / n) * (CAST(t{j} AS DOUBLE) / n) AS v{i}_{j}" for i, j in _PAIRS]
    else:
        spread = [f"CAST(u{i}_{j} AS DOUBLE) / n AS v{i}_{j}" for i, j in _PAIRS]
    whole = [(f"a{i} * a{i}" if i == j else f"CASE WHEN v{i}_{i} > 0.0e0 AND v{j}_{j} > 0.0e0 THEN 0.99e0 * v{i}_{j} / sqrt(v{i}_{i} * v{j}_{j}) * (a{i} * a{j}) ELSE 0.0e0 END") + f" AS c{i}_{j}" for i, j in _PAIRS]
    return [spread, whole]


def _from_moments() -> list[list[str]]:
    out = [[f"s{i} / n AS m{i}" for i in range(D)]]
    out.append([f"{CONSISTENCY}e0 * (s{i}_{j} / n - m{i} * m{j})" + (f" + {(FEATURES[i][1] * UNIT) ** 2!r}e0" if i == j else "") + f" AS c{i}_{j}" for i, j in _PAIRS])
    return out


def _factor() -> list[list[str]]:
    """Selections, one after the other, from a scatter c to the inverse w of its Cholesky factor, and its root determinant.
    Each adds columns that use those before only: the factor column by column, then its inverse."""
    out = []
    for j in range(D):
        out.append([f"sqrt(c{j}_{j}" + "".join(f" - l{j}_{k} * l{j}_{k}" for k in range(j)) + f") AS l{j}_{j}"])
        if j + 1 < D:
            out.append([f"(c{i}_{j}" + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j)) + f") / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, D)])
    out.append([*(f"1.0e0 / l{i}_{i} AS w{i}_{i}" for i in range(D)), " * ".join(f"l{i}_{i}" for i in range(D)) + " AS det"])
    for gap in range(1, D):
        out.append(["(0.0e0" + "".join(f" - l{i}_{k} * w{k}_{i - gap}" for k in range(i - gap, i)) + f") * w{i}_{i} AS w{i}_{i - gap}" for i in range(gap, D)])
    return out


def _drawn(own: str, parent: str) -> list[str]:
    """Estimates of a group, of n documents, drawn towards its parent's."""
    each = [*(f"m{i}" for i in range(D)), *(f"c{i}_{j}" for i, j in _PAIRS)]
    return [f"({own}.n * {own}.{x} + {PRIOR}e0 * {parent}.{x}) / ({own}.n + {PRIOR}e0) AS {x}" for x in each]


def _distance() -> str:
    rows = ["(" + " + ".join(f"w{i}_{j} * (z{j} - m{j})" for j in range(i + 1)) + ")" for i in range(D)]
    return " + ".join(f"{r} * {r}" for r in rows)


#: Distances in steps of 1/32; documents of one bin are near or far together.
BIN = f"CAST(least(floor(sqrt({_distance()}) * 32.0e0), 1000000.0e0) AS INTEGER)"


def _chain(df: DataFrame, stages: list[list[str]]) -> DataFrame:
    for columns in stages:
        df = df.selectExpr("*", *columns)
    return df


def outliers(stats: DataFrame, lang: str, source: str, work: Workspace) -> DataFrame:
    """Rows of a written table of statistics with base_failed, kept and distance.

    What is written are the rows' numbers, and tables with a row for each group, start and bin; where those aren't small
    (very many sources) the joins are shuffled, and Spark splits the groups that are hot."""
    kept = [f"`{c}`" for c in stats.columns]
    keys = _keys(f"`{lang}`", f"`{source}`")
    rows = stats.selectExpr(*kept, f"({BASE_FAILED}) AS base_failed", *(f"{k} AS _k{i}" for i, k in enumerate(keys)), *_quantised())
    rows = work.write(rows, "features")
    fit = rows.where("not base_failed").selectExpr("explode(array(_k0, _k1, _k2)) AS _g", *_Z)

    medians = work.write(fit.groupBy("_g").agg(*(F.expr(f"CAST(percentile(z{i}, 0.5) AS DOUBLE) AS m{i}") for i in range(D)), F.expr("CAST(count(*) AS DOUBLE) AS n")), "medians")
    spread = fit.join(broadcast_if_small(medians, 512), "_g").groupBy("_g").agg(*(F.expr(f"percentile(abs(z{i} - m{i}), 0.5) AS d{i}") for i in range(D)))
    scales = work.write(medians.join(spread, "_g").selectExpr("*", *_SCALES), "scales")
    bounded = _chain(fit.join(broadcast_if_small(scales, 512), "_g"), _bounded()).groupBy("_g")
    bounded = bounded.agg(*map(F.expr, _sums([f"t{i}" for i in range(D)], "t", True) + _sums([f"u{i}" for i in range(D)], "u", False)))
    ready = work.write(scales.join(bounded, "_g"), "bounded")
    now = None
    for number in range(STARTS):
        one = _chain(ready, _start(number) + _factor()).selectExpr("_g", f"{number} AS start", *_STATE).withColumn("det", F.lit(1.0e300))
        now = one if now is None else now.unionByName(one)
    now, step, done = work.write(now, "step0"), 0, []
    while not now.isEmpty():
        step += 1
        placed = fit.join(broadcast_if_small(now, 512), "_g").selectExpr("_g", "start", *_Z, f"{BIN} AS b")
        bins = work.write(placed.groupBy("_g", "start", "b").agg(F.count(F.lit(1)).alias("n"), *map(F.expr, _sums(_Z, "s", True))), f"bins{step}")
        by = Window.partitionBy("_g", "start")
        near = bins.withColumns({"_all": F.sum("n").over(by), "_upto": F.sum("n").over(by.orderBy("b"))}).where(f"_upto - n < {KEEP}e0 * _all")
        moments = near.groupBy("_g", "start").agg(*(F.expr(f"CAST(sum(CAST({x} AS DECIMAL(38,0))) AS DOUBLE) AS {x}") for x in _MOMENTS))
        new = _chain(moments, _from_moments() + _factor()).selectExpr("_g", "start", *_STATE)
        both = now.alias("o").join(new.alias("x"), ["_g", "start"])
        falls = F.col("x.det") < F.col("o.det")
        both = work.write(both.select("_g", "start", falls.alias("falls"), *(F.when(falls, F.col(f"x.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in _STATE)), f"step{step}")
        done.append(both.where("not falls").drop("falls"))
        now = both.where("falls").drop("falls")
        work.drop(f"bins{step}")
    if not done:  # no document to estimate from
        return rows.selectExpr(*kept, "base_failed", "CAST(NULL AS DOUBLE) AS distance", "false AS kept")
    ends = functools.reduce(DataFrame.unionByName, done).withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy("det", "start"))).where("_r = 1").drop("_r", "start")
    ends = work.write(ends.join(medians.select("_g", "n"), "_g"), "ends")

    groups = rows.where("not base_failed").select("_k0", "_k1", "_k2").distinct()
    at = lambda level: ends.where(F.col("_g").startswith(str(level))).withColumnRenamed("_g", f"_k{level}")
    langs = groups.select("_k0", "_k1").distinct().join(at(1), "_k1").alias("own").join(at(0).alias("up"), "_k0").selectExpr("_k1", *_drawn("own", "up"))
    own = groups.join(at(2), "_k2").alias("own").join(langs.alias("up"), "_k1").selectExpr("_k2", *_drawn("own", "up"))
    own = work.write(_chain(own, _factor()).select("_k2", *_PARAMETERS), "estimates")
    judged = rows.join(broadcast_if_small(own, 512), "_k2", "left").withColumn("distance", F.expr(_distance()))
    return judged.selectExpr(*kept, "base_failed", "distance", f"NOT base_failed AND coalesce(distance <= {CUTOFF}e0, true) AS kept")


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) for every row.

    A null text is empty and fails the base rules; null languages and sources are groups of their own.  Whole texts are
    read, however long.  Repeated rows count as often as they come; other columns are ignored, whatever their names.  An
    empty table gives no rows; where all documents fail the base rules there is nothing to estimate and distance is null.
    """
    work = Workspace(docs.sparkSession, "quality")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang"), F.col(source).alias("_source"))
    stats = work.write(statistics(own, "_text").drop("_text"), "statistics")
    judged = outliers(stats, "_lang", "_source", work)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op2_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents")).drop("distance")


def _sql() -> str:
    z = ", ".join(_Z)
    chain = lambda select, stages: functools.reduce(lambda inner, columns: f"SELECT *, {', '.join(columns)} FROM ({inner})", stages, select)
    k0, k1, k2 = _keys("lang", "source")
    state = ", ".join(_STATE)
    starts = " UNION ALL ".join(f"SELECT _g, {i} AS start, {', '.join(_STATE[:-1])}, 1.0e300 AS det FROM ({chain('SELECT * FROM bd', _start(i) + _factor())})" for i in range(STARTS))
    parts = [rf"""t AS MATERIALIZED (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
v AS MATERIALIZED (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM v WHERE len(w) >= 8),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM g),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM h),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM c WHERE n > 1) GROUP BY doc_id),
st AS MATERIALIZED (SELECT v.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM v LEFT JOIN r ON r.doc_id = v.doc_id),
f AS MATERIALIZED (SELECT *, ({BASE_FAILED}) AS base_failed, {k0} AS k0, {k1} AS k1, {k2} AS k2, {", ".join(_quantised())} FROM st),
x AS MATERIALIZED (SELECT unnest([k0, k1, k2]) AS _g, {z} FROM f WHERE NOT base_failed),
md AS MATERIALIZED (SELECT _g, {", ".join(f"quantile_cont(z{i}, 0.5)::DOUBLE AS m{i}" for i in range(D))}, count(*)::DOUBLE AS n FROM x GROUP BY _g),
sp AS (SELECT _g, {", ".join(f"quantile_cont(abs(z{i} - m{i}), 0.5) AS d{i}" for i in range(D))} FROM x JOIN md USING (_g) GROUP BY _g),
sc AS MATERIALIZED (SELECT md.*, {", ".join(_SCALES)} FROM md JOIN sp USING (_g)),
bd AS MATERIALIZED (SELECT sc.*, b.* EXCLUDE (_g) FROM sc JOIN (SELECT _g, {", ".join(_sums([f"t{i}" for i in range(D)], "t", True) + _sums([f"u{i}" for i in range(D)], "u", False))} FROM ({chain("SELECT x.*, sc.* EXCLUDE (_g) FROM x JOIN sc USING (_g)", _bounded())}) GROUP BY _g) b USING (_g)),
p0 AS MATERIALIZED ({starts})"""]
    for step in range(SQL_STEPS):
        parts.append(f"a{step} AS MATERIALIZED (SELECT _g, start, {BIN} AS b, count(*) AS n, {', '.join(_sums(_Z, 's', True))} FROM x JOIN p{step} USING (_g) GROUP BY ALL)")
        sums = ", ".join(f"CAST(sum(CAST({m} AS DECIMAL(38,0))) AS DOUBLE) AS {m}" for m in _MOMENTS)
        near = f"SELECT *, sum(n) OVER (PARTITION BY _g, start) AS total, sum(n) OVER (PARTITION BY _g, start ORDER BY b) AS upto FROM a{step}"
        moments = f"SELECT _g, start, {sums} FROM ({near}) WHERE upto - n < {KEEP}e0 * total GROUP BY _g, start"
        parts.append(f"n{step} AS MATERIALIZED (SELECT _g, start, {state} FROM ({chain(moments, _from_moments() + _factor())}))")
        parts.append(f"p{step + 1} AS MATERIALIZED (SELECT _g, start, {', '.join(f'CASE WHEN x.det < o.det THEN x.{c} ELSE o.{c} END AS {c}' for c in _STATE)} FROM p{step} o JOIN n{step} x USING (_g, start))")
    parts.append(f"e AS MATERIALIZED (SELECT q.*, md.n FROM p{SQL_STEPS} q JOIN md USING (_g) QUALIFY row_number() OVER (PARTITION BY _g ORDER BY det, start) = 1)")
    parts.append(f"lg AS MATERIALIZED (SELECT own._g AS k1, {', '.join(_drawn('own', 'up'))} FROM e own, e up WHERE own._g[1] = '1' AND up._g = '0')")
    drawn = f"SELECT own._g AS k2, {', '.join(_drawn('own', 'up'))} FROM (SELECT DISTINCT k1, k2 FROM f WHERE NOT base_failed) pairs JOIN e own ON own._g = pairs.k2 JOIN lg up ON up.k1 = pairs.k1"
    parts.append(f"es AS MATERIALIZED (SELECT k2, {', '.join(_PARAMETERS)} FROM ({chain(drawn, _factor())}))")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND coalesce({_distance()} <= {CUTOFF}e0, true)) AS kept FROM f LEFT JOIN es USING (k2)"


OP2_SQL = _sql()
