"""From raw documents to token ids in five stages, each written as Parquet and read again by the next.

Rows that carry an id more than once are told apart by a hash of their text.  Texts are taken whole, however long; columns
beside those of documents go through unread, whatever their names; an empty table gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import Workspace, broadcast_if_small, count_words, sifted
from plumbline.llm.jaccard import jaccard_components
from plumbline.llm.mixing import mix
from plumbline.llm.pieces import piece_digests
from plumbline.llm.quality import outliers, statistics
from plumbline.llm.substring import substring_dedup
from plumbline.llm.token_files import vocabulary_path

def _hash():
    return F.xxhash64(F.lit(9), F.col("text"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose (doc_id, hash of the text) is among gone, a written table."""
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_gone")).distinct()
    rows, rest, gone = sifted(docs, [F.col("doc_id"), _hash()], gone, ["_id", "_gone"], 32)
    return _joined(rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (_hash() == F.col("_gone")), "left_anti"), rest)


def _joined(rows: DataFrame, rest: DataFrame | None) -> DataFrame:
    return rows if rest is None else rows.unionByName(rest)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.  A null text has no words, so it goes; repeated rows are judged alike; null
    languages and sources are groups of their own."""
    work = Workspace(spark, "quality-stage")
    stats = work.write(statistics(docs.select("doc_id", "lang", "source", "text", _hash().alias("_hash"))).drop("text"), "statistics")
    judged = outliers(stats, "lang", "source", work)
    return _without(docs, work.write(judged.where("not kept").select("doc_id", "_hash"), "rejected"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays (one without an id only if none has one), and of
    repeated rows one.

    A document here is an id, null or not, and a text; the join knows it by a 64-bit hash of both."""
    work = Workspace(spark, "jaccard-stage")
    keyed = docs.withColumn("_key", F.xxhash64(F.lit(11), F.col("doc_id").isNull(), "doc_id", "text"))
    found = jaccard_components(keyed.select(F.col("_key").alias("doc_id"), "text")).where("doc_id <> component_id")
    found = work.write(found.select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_root")).distinct(), "linked")
    members = work.write(found.unionAll(found.select(F.col("_root").alias("_key"), "_root").distinct()), "members")
    ranked = keyed.select("_key", "doc_id", _hash().alias("_hash")).join(broadcast_if_small(members, 16), "_key").select("_root", "doc_id", "_hash", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash").alias("rank"))
    ranked = work.write(ranked.distinct(), "ranked")
    first = work.write(ranked.groupBy("_root").agg(F.min("rank").alias("first")), "first")
    gone = ranked.join(broadcast_if_small(first, 40), "_root").where("rank <> first").select("doc_id", "_hash")
    kept = _without(docs, work.write(gone, "gone"))
    again = work.write(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_id")), "again")
    rows, rest, repeated = sifted(kept, [F.col("doc_id")], again, ["_id"], 16)
    single = _joined(rows.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti"), rest)
    several = rows.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return single.unionByName(several.dropDuplicates(["doc_id", "text"]))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; a text that loses none stays as it is, null included, and a document
    of which no word is left goes.  Rows without id, and rows of one id among themselves, remove nothing."""
    done = substring_dedup(docs).where("n_removed = 0 or kept <> ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    own = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("rest.n_chars"))}
    return done.select(*(own.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix doesn't take go; one that it takes several times comes as often.  One without words is never
    taken; rows of one id are taken or left together, rows without id each by themselves."""
    sized = docs.withColumns({"_sources": F.array("source"), "_words": count_words("text")})
    taken, _ = mix(sized, "doc_id", "_words", "_sources")
    return taken.where("repeats > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, lossless, ids) of every row.  Copies of a row that the mix takes several times are
    numbered, so that each draws its own dropout; a null text is empty and has no ids."""
    same = Window.partitionBy("doc_id", _hash()).orderBy("doc_id")
    return piece_digests(docs.select("doc_id", "text", F.row_number().over(same).alias("_copy")), vocabulary_path("piece_bpe_32k.model"), copy="_copy")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing", mixture),
    ("sentencepiece", token_ids),
]
#: The last stage can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            work.drop(f"stage{i - 1}")
    return docs
