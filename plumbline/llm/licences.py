"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

A file's passages are its lines with a marker word, its paragraphs with one, and all those paragraphs together; so a one-line
notice, a header comment and a whole licence file are each compared as what they are.  Passages and templates are vectors of
term counts weighted by inverse document frequency.  The frequency of every term counts that comes in one passage of a
thousand or more, as a share of the passages: the same header scores the same in a corpus of any size.  A tag
``SPDX-License-Identifier:`` names its licence by itself.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, broadcast_if_small, count_words, table
from .licence_texts import TEMPLATES

MARKERS = "licen[cs]e|copyright|spdx|warrant|redistribut|all rights reserved|permission|public[ \\t]*\\n?[ \\t]*domain"
LINE = rf"(?im)^[^\n]*(?:{MARKERS})[^\n]*$"
BLANK = r"\n[ \t\r\f]*\n[ \t\r\f\n]*"
TERM = "[a-z]+|[0-9]+"
#: Years and other long numbers say nothing about a licence.
NUMBER = "^[0-9]{3,}$"
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)"
#: Least cosine at which a template names the licence, and least share of a file's words for a licence file.
LEAST, SHARE = 0.6, 0.34
#: Least share of the passages from which a term's frequency counts, and what is added to the share.
COMMON, SMOOTH = 0.001, 0.01


def _template_terms() -> list[tuple[int, str, str, int]]:
    """(template, licence, term, count)."""
    terms = lambda text: (t for t in re.findall(TERM, text.lower()) if not re.match(NUMBER, t))
    return [(i, name, term, n) for i, (name, text) in enumerate(TEMPLATES) for term, n in sorted(Counter(terms(text)).items())]


def scan(files: DataFrame, file_id: str = "file_id", path: str = "path", text: str = "text") -> DataFrame:
    """(file_id, path, licence, similarity, origin, n_passage_words) for every row.  origin: "own", the directory that the
    licence is inherited from, or null.

    A passage names the licence of its nearest template (the first by name among equals) if the cosine is LEAST or more; of
    a file's passages the nearest counts, the first by licence among equals, and similarity is null if no word of any is a
    template's.  n_passage_words: of the longest passage that names the file's licence.  A file of whose words that is SHARE
    or more is a licence file: it speaks for its directory and those below.  Several in a
    directory: the licence that most of them name, then the first by name.  A null text has no passage, a null path no
    directory; the root directory is "".  Texts are read whole, however long.  Repeated rows each give a row and each count;
    other columns are ignored, whatever their names.  An empty table gives no rows.
    """
    spark = files.sparkSession
    work = Workspace(spark, "licences")
    own = F.coalesce(F.col(text), F.lit(""))
    marked = own.rlike(f"(?i)(?:{MARKERS})")
    paragraphs = F.filter(F.split(own, BLANK), lambda p: p.rlike(f"(?i)(?:{MARKERS})"))
    passages = F.concat(F.regexp_extract_all(own, F.lit(LINE), F.lit(0)), F.col("paragraphs"), F.array(F.array_join("paragraphs", "\n\n")))
    rows = files.select(F.col(file_id).alias("file_id"), F.col(path).alias("path"), F.when(marked, own).alias("text"), F.when(marked, paragraphs).alias("paragraphs"), F.when(marked, count_words(own)).otherwise(F.lit(0)).alias("n_words"))
    own = F.col("text")
    rows = rows.withColumns({"passages": F.array_sort(F.array_distinct(passages)), "spdx": F.nullif(F.regexp_extract(own, SPDX, 1), F.lit("")), "dir": F.regexp_replace(F.coalesce("path", F.lit("")), "/?[^/]*$", "")})
    rows = rows.withColumn("bundle", F.when(F.col("passages").isNotNull(), F.md5(F.array_join(F.transform("passages", lambda p: F.md5(p.cast("binary"))), "").cast("binary"))))
    rows = work.write(rows.drop("text", "paragraphs"), "rows")

    # Each distinct set of passages, and each distinct passage, is scored once; how often it comes weighs in the frequencies.
    bundles = work.write(rows.where("bundle is not null").groupBy("bundle").agg(F.count(F.lit(1)).alias("times"), F.any_value("passages").alias("passages")), "bundles")
    single = bundles.select("bundle", "times", F.explode("passages").alias("text")).withColumn("passage", F.md5(F.col("text").cast("binary")))
    distinct = work.write(single.groupBy("passage").agg(F.sum("times").alias("times"), F.any_value("text").alias("text")), "passages")
    terms = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)), lambda t: ~t.rlike(NUMBER))
    counted = work.write(distinct.select("passage", "times", F.explode(terms).alias("term")).groupBy("passage", "times", "term").agg(F.count(F.lit(1)).alias("tf")), "terms")
    total = distinct.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n")).first()["n"]
    share = F.col("df") / F.lit(float(max(total, 1)))
    idf = lambda s: F.log(F.lit(1.0) + F.lit(1.0) / (F.coalesce(s, F.lit(0.0)) + F.lit(SMOOTH)))
    common = work.write(counted.groupBy("term").agg(F.sum("times").alias("df")).where(share >= COMMON).select("term", idf(share).alias("idf")), "common")
    templates = spark.createDataFrame(_template_terms(), "template int, licence string, term string, n int")
    vectors = templates.join(common, "term", "left").withColumn("weight", F.col("n") * F.coalesce("idf", idf(F.lit(None).cast("double"))))
    norms = vectors.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    vectors = F.broadcast(vectors.join(norms, "template").select("template", "licence", "term", (F.col("weight") / F.col("norm")).alias("weight")))  # the templates' terms
    weighed = counted.join(broadcast_if_small(common, 64), "term", "left").withColumn("value", F.col("tf") * F.coalesce("idf", idf(F.lit(None).cast("double"))))
    lengths = weighed.groupBy("passage").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
    dots = weighed.join(vectors, "term").groupBy("passage", "template", "licence").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    sized = distinct.select("passage", count_words("text").alias("words"))
    near = dots.join(lengths, "passage").withColumn("similarity", F.round(F.col("dot") / F.col("length"), 4))
    near = work.write(near.groupBy("passage").agg(F.max("similarity").alias("similarity"), F.min_by("licence", F.struct(-F.col("similarity"), "licence")).alias("nearest")), "near")
    near = near.join(sized, "passage")
    named = single.select("bundle", "passage").join(near, "passage").groupBy("bundle", "nearest").agg(F.max("similarity").alias("similarity"), F.max(F.when(F.col("similarity") >= LEAST, F.col("words"))).alias("words"))
    best = named.groupBy("bundle").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "nearest", "words")).alias("first")).select("bundle", (-F.col("first.s")).alias("similarity"), "first.nearest", F.col("first.words").alias("n_passage_words"))
    best = work.write(best, "best")
    scored = rows.drop("passages").join(broadcast_if_small(best, 96), "bundle", "left")
    scored = scored.withColumns({"own": F.coalesce("spdx", F.when(F.col("similarity") >= LEAST, F.col("nearest"))), "similarity": F.when(F.col("spdx").isNotNull(), F.lit(1.0)).otherwise(F.col("similarity")), "n_passage_words": F.coalesce("n_passage_words", F.lit(0).cast("long"))})
    scored = work.write(scored.drop("bundle", "nearest", "spdx"), "scored")
    work.drop("rows", "bundles", "passages", "terms", "near", "best")

    speaking = scored.where(f"own is not null and path is not null and n_passage_words >= {SHARE} * n_words")
    votes = speaking.groupBy("dir", "own").agg(F.count(F.lit(1)).alias("n"))
    rule = votes.groupBy("dir").agg(F.min_by("own", F.struct(-F.col("n"), "own")).alias("inherited")).withColumnRenamed("dir", "ancestor")
    asking = scored.where("own is null and path is not null").select("dir").distinct()
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    up = asking.select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.concat_ws("/", F.slice(parts, F.lit(1), k)))).alias("depth", "ancestor"))
    nearest = up.join(rule, "ancestor").groupBy("dir").agg(F.max_by(F.struct("inherited", "ancestor"), "depth").alias("near"))
    joined = scored.join(nearest, "dir", "left")
    inherited = F.col("own").isNull() & F.col("path").isNotNull()
    return joined.select("file_id", "path", F.coalesce("own", F.when(inherited, F.col("near.inherited"))).alias("licence"), "similarity", F.when(F.col("own").isNotNull(), F.lit("own")).when(inherited, F.col("near.ancestor")).alias("origin"), "n_passage_words")


def op9_licences(spark, sf_dir):
    """Documents as files doc_id.txt in source/lang directories."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")
    return scan(files, "doc_id").withColumnRenamed("file_id", "doc_id")


def _sql() -> str:
    values = ", ".join(f"({i}, '{name}', '{term}', {n})" for i, name, term, n in _template_terms())
    idf = f"ln(1.0::DOUBLE + 1.0::DOUBLE / (coalesce(share, 0.0::DOUBLE) + {SMOOTH}::DOUBLE))"
    return rf"""
WITH f AS (SELECT doc_id, concat_ws('/', source, lang, doc_id::VARCHAR || '.txt') AS path, coalesce(text, '') AS text FROM documents),
g AS MATERIALIZED (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, text, list_filter(string_split_regex(text, '{BLANK}'), lambda p: regexp_matches(p, '(?i)(?:{MARKERS})')) AS paragraphs FROM f),
r AS MATERIALIZED (SELECT doc_id, path, dir, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words, CASE WHEN len(paragraphs) > 0 THEN list_distinct(list_concat(regexp_extract_all(text, '{LINE}'), paragraphs, [array_to_string(paragraphs, chr(10) || chr(10))])) END AS passages,
  nullif(regexp_extract(text, '{SPDX}', 1), '') AS spdx FROM g),
tt(template, licence, term, n) AS (VALUES {values}),
ps AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS k, p FROM (SELECT doc_id, unnest(passages) AS p FROM r)),
c AS MATERIALIZED (SELECT doc_id, k, term, count(*) AS tf FROM (SELECT doc_id, k, unnest(regexp_extract_all(lower(p), '{TERM}')) AS term FROM ps) WHERE NOT regexp_matches(term, '{NUMBER}') GROUP BY ALL),
df AS MATERIALIZED (SELECT term, count(*)::DOUBLE / (SELECT greatest(count(*), 1) FROM ps) AS share FROM c GROUP BY term HAVING share >= {COMMON}),
tw AS MATERIALIZED (SELECT template, licence, term, n * {idf} AS weight FROM tt LEFT JOIN df USING (term)),
norm AS (SELECT template, sqrt(sum(weight * weight)) AS norm FROM tw GROUP BY template),
w AS MATERIALIZED (SELECT doc_id, k, term, tf * {idf} AS value FROM c LEFT JOIN df USING (term)),
len AS (SELECT k, sqrt(sum(value * value)) AS length FROM w GROUP BY k),
dot AS (SELECT doc_id, k, template, licence, round(sum(value * weight / norm) / any_value(length), 4) AS similarity FROM w JOIN tw USING (term) JOIN norm USING (template) JOIN len USING (k) GROUP BY ALL),
near1 AS (SELECT doc_id, k, max(similarity) AS similarity, first(licence ORDER BY similarity DESC, licence) AS nearest FROM dot GROUP BY doc_id, k),
sz AS (SELECT k, len(regexp_extract_all(p, '[^\x20\x09-\x0D]+'))::BIGINT AS words FROM ps),
named AS (SELECT doc_id, nearest, max(similarity) AS similarity, max(CASE WHEN similarity >= {LEAST} THEN words END) AS words FROM near1 JOIN sz USING (k) GROUP BY ALL),
best AS (SELECT doc_id, max(similarity) AS similarity, first(nearest ORDER BY similarity DESC, nearest) AS nearest, arg_min({{'w': words}}, (-similarity, nearest)).w AS n_passage_words FROM named GROUP BY doc_id),
s AS MATERIALIZED (SELECT r.doc_id, path, dir, n_words, coalesce(n_passage_words, 0) AS n_passage_words, CASE WHEN spdx IS NOT NULL THEN 1.0 ELSE similarity END::DOUBLE AS similarity, coalesce(spdx, CASE WHEN similarity >= {LEAST} THEN nearest END) AS own FROM r LEFT JOIN best USING (doc_id)),
rule AS (SELECT dir, first(own ORDER BY n DESC, own) AS inherited FROM (SELECT dir, own, count(*) AS n FROM s WHERE own IS NOT NULL AND n_passage_words >= {SHARE} * n_words GROUP BY ALL) GROUP BY dir),
near AS (SELECT s.doc_id, arg_max({{'l': inherited, 'd': rule.dir}}, length(rule.dir)) AS near FROM s JOIN rule ON rule.dir = '' OR rule.dir = s.dir OR starts_with(s.dir, rule.dir || '/') WHERE own IS NULL GROUP BY s.doc_id)
SELECT s.doc_id, s.path, coalesce(own, near.l) AS licence, similarity, CASE WHEN own IS NOT NULL THEN 'own' ELSE near.d END AS origin, n_passage_words FROM s LEFT JOIN near USING (doc_id)
"""


OP9_SQL = _sql()
