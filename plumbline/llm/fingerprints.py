"""Canonical exact digests: normalised text, wide xxhash, byte comparison inside equal buckets."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, broadcast_if_small, partitions, table
from .textkit import pieces

_SPACES = re.compile(r"\s+")


def canonical(text: str | None) -> bytes:
    """NFKC, then case folding, then NFKC again (folding can leave composable marks), white space runs as one space,
    none at the ends; UTF-8.  Null is the empty text.  A lone surrogate is kept as its three bytes."""
    if not text:
        return b""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return _SPACES.sub(" ", text).strip(" ").encode("utf-8", "surrogatepass")


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def likeness(a: bytes, b: bytes, digest_a: str, digest_b: str) -> float:
    """1 if the digests are equal and the bytes behind them too, else 0."""
    return 1.0 if digest_a == digest_b and a == b else 0.0


#: Bytes of text that are held as Python objects at a time.
BATCH_BYTES = 4 << 20


def fingerprints(docs: DataFrame, text: str = "text", column: str = "fingerprint") -> DataFrame:
    """The given rows, nulls, repeats and empty tables included, with the digest of their canonical text; a given column of
    that name is replaced."""
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != column), T.StructField(column, T.StringType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at, BATCH_BYTES):
            own = pa.array([digest(canonical(t)) for t in batch.column(at).to_pylist()], pa.string())
            arrays = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != column]
            yield pa.RecordBatch.from_arrays([*arrays, own], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def _digests(docs: DataFrame, doc_id: str, text: str, with_bytes: bool) -> DataFrame:
    """(doc_id, fingerprint, canonical_sha256[, bytes])."""
    names = ["doc_id", "fingerprint", "canonical_sha256", *(["bytes"] if with_bytes else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, BATCH_BYTES):
            texts = [canonical(t) for t in batch.column(1).to_pylist()]
            made = [batch.column(0), pa.array([digest(t) for t in texts], pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays([*made, *([pa.array(texts, pa.binary())] if with_bytes else [])], names)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, fingerprint string, canonical_sha256 string" + (", bytes binary" if with_bytes else "")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def with_classes(made: DataFrame, docs: DataFrame, doc_id: str, text: str, work: Workspace) -> DataFrame:
    """A written table of digests (doc_id, fingerprint, canonical_sha256, ...) of docs with class_id: the smallest doc_id
    among the documents with equal canonical bytes.

    Buckets are equal digests by xxhash and, should two texts ever share one, by SHA-256.  Inside a bucket the bytes are
    compared: the least and the greatest text of it are aggregated before the shuffle, so of a hot bucket a task sends one
    text, and texts of which there is one aren't sent where the buckets can be broadcast.  Texts that share both digests and
    differ raise.  A bucket of null ids only has a null class.
    """
    key = ["fingerprint", "canonical_sha256"]
    buckets = work.write(made.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("class_id")).where("n > 1").drop("n"), "buckets")
    bound = broadcast_if_small(buckets, 160)
    texts = _digests(docs, doc_id, text, True).join(F.broadcast(buckets.select(*key)) if bound is not buckets else buckets.select(*key), key)
    if not texts.groupBy(*key).agg(F.min("bytes").alias("least"), F.max("bytes").alias("most")).where("least <> most").isEmpty():
        raise ValueError("different texts share both digests")
    return made.join(bound, key, "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))


def exact_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, canonical_sha256, class_id) for every row: see ``with_classes``.  A null text is empty; repeated
    rows are copies of each other; an empty table gives no rows."""
    work = Workspace(docs.sparkSession, "classes")
    return with_classes(work.write(_digests(docs, doc_id, text, False), "digests"), docs, doc_id, text, work)


def with_next(docs: DataFrame, doc_id: str, text: str, buckets: int | None = None) -> DataFrame:
    """(bucket, guest, doc_id, text): rows in buckets of doc_id ranges, sorted within partitions so that each document is
    followed by the next smaller one.  The first document of the range below comes again as a guest at a bucket's end,
    after the smallest document the largest of all.  One shuffle of the texts; the range bounds and the guests' ids
    (one for each bucket) are all that reaches the driver.  Null ids come last; equal ids are ordered by text.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * partitions(spark)
    ids = docs.select(F.col(doc_id).cast("long").alias("id"))
    bounds = ids.where("id is not null").approxQuantile("id", [i / buckets for i in range(1, buckets)], 0.2 / buckets)
    cuts = np.unique(np.array(bounds, dtype="int64"))

    known = {r["b"]: r["top"] for r in _range(ids.select(F.coalesce("id", F.lit(-(1 << 63))).alias("id")), cuts, "id").groupBy("b").agg(F.max("id").alias("top")).collect()}
    order = sorted(known)
    guests = [(known[b], order[i + 1] if i + 1 < len(order) else order[0]) for i, b in enumerate(order)]
    hosts = F.broadcast(spark.createDataFrame(guests, "gid long, host int"))  # a row for each bucket
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    rows = _range(rows, cuts, "k").join(hosts, F.col("k") == F.col("gid"), "left")
    rows = rows.withColumn("place", F.explode(F.when(F.col("host").isNull(), F.array(F.struct(F.col("b").alias("bucket"), F.lit(0).alias("guest")))).otherwise(F.array(F.struct(F.col("b").alias("bucket"), F.lit(0).alias("guest")), F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest"))))))
    rows = rows.select("place.bucket", "place.guest", "doc_id", "text", "k").repartition(partitions(spark), "bucket")
    return rows.sortWithinPartitions("bucket", "guest", F.desc("k"), F.xxhash64("text"), "text").drop("k")


#: Range bounds that are compiled into the plan; more are searched by a Bucketizer.
TREE_CUTS = 1024


def _range(rows: DataFrame, cuts: np.ndarray, column: str) -> DataFrame:
    """rows with b, the index of the range of a value: a balanced tree of comparisons, or for very many ranges a binary
    search over bounds as doubles (large ids that round to one double share a range either way)."""
    if len(cuts) > TREE_CUTS:
        from pyspark.ml.feature import Bucketizer

        bounds = np.unique(cuts.astype(float)).tolist()
        splits = [-float("inf"), *bounds, float("inf")]
        found = Bucketizer(splits=splits, inputCol="_value", outputCol="_range").transform(rows.withColumn("_value", F.col(column).cast("double")))
        return found.withColumn("b", F.col("_range").cast("int")).drop("_value", "_range")

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) < F.lit(int(cuts[mid])), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return rows.withColumn("b", tree(0, len(cuts)).cast("int"))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document with the digest of its text and of its edited text (see ``with_next``): the last third of its code
    points replaced by as many first ones of the next document, and the SHA-256 of its canonical text.  A null text is
    empty; the only document is its own next.  Repeated rows each give a row; rows of one id are in the order of a hash of
    their texts.  Texts are held in batches of BATCH_BYTES, a longer one alone.  Other columns are ignored, whatever their
    names; an empty table gives no rows."""
    ordered = with_next(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        out: list[tuple] = []

        def pair(row, nxt):
            own, after = row[3] or "", nxt[3] or ""
            n = len(own)
            k = n // 3
            edited = own[: n - k] + after[:k]
            raw = edited.encode("utf-8", "surrogatepass")
            a, b, c = row[4], canonical(edited), nxt[4]
            da, db, dc = row[5], digest(b), nxt[5]
            return row[2], n, hashlib.sha256(raw).hexdigest(), da, db, likeness(a, b, da, db), likeness(a, c, da, dc), hashlib.sha256(a).hexdigest()

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
            return made

        for batch in pieces(batches, 3, BATCH_BYTES):
            for bucket, guest, own_id, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if guest and held and held[0] == bucket and held[1]:
                    continue  # of equal guests the first counts
                c = canonical(own)
                now = (bucket, guest, own_id, own, c, digest(c))
                if held and held[0] == bucket and not held[1]:
                    out.append(pair(held, now))
                    if len(out) >= 2000:
                        yield flush()
                held = now
        if out:
            yield flush()

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "canonical_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, canonical_sha256 string")


def op4_fingerprints(spark, sf_dir):
    """With class_id: the smallest doc_id of the documents with equal canonical texts."""
    docs = table(spark, sf_dir, "documents")
    work = Workspace(spark, "fingerprints")
    return with_classes(work.write(edited_fingerprints(docs), "edited"), docs, "doc_id", "text", work)
