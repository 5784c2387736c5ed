"""Shared helpers: intermediate tables, sizes, connected components."""

from __future__ import annotations

import atexit
import functools
import tempfile
import threading
import uuid
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Largest side that an operator broadcasts, and only after measuring it.
BROADCAST_BYTES = 8 << 20
#: Most bits in which the keys of a larger table are looked up, 16 or more for each key below that.
SIFT_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  Only a local session may go without spark.checkpoint.dir."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = _local_dir()
    return known.rstrip("/")


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="plumbline-")


#: Folders of this process's workspaces; ``release`` deletes them, at the latest when the process ends.
_ROOTS: dict[str, SparkSession] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning, _lock = [0, None], threading.Lock()
#: On a file system of files a table that is soon gone needs no checksum beside each file; other stores don't read this.
_SCRATCH = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def release(spark: SparkSession | None = None) -> None:
    """Deletes the tables of all workspaces (of a session).  Results that still read them can't be computed afterwards."""
    for root, own in list(_ROOTS.items()):
        if spark is None or own is spark:
            _ROOTS.pop(root)
            _delete(own, root)


@atexit.register
def _at_end() -> None:
    try:
        release()
    except Exception as e:  # the JVM may have gone before
        warnings.warn(f"work tables were left behind: {e}", stacklevel=1)


class Workspace:
    """Tables written to the shared folder to cut lineage; each can be deleted once it is used up, and all that are left go
    with ``release``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
        _ROOTS[self.root] = spark

    def write(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").options(**_SCRATCH)
        # The table replaces the shuffle files behind it.  The setting is the session's, so the first of several writes
        # at a time sets it and the last restores it.
        with _lock:
            if not _cleaning[0]:
                _cleaning[1] = self.spark.conf.get(_CLEAN, None)
                self.spark.conf.set(_CLEAN, "true")
            _cleaning[0] += 1
        try:
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        finally:
            with _lock:
                _cleaning[0] -= 1
                if not _cleaning[0]:
                    self.spark.conf.set(_CLEAN, _cleaning[1]) if _cleaning[1] is not None else self.spark.conf.unset(_CLEAN)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Broadcast a written table if its counted rows stay below BROADCAST_BYTES; else leave the join to Spark."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def sifted(rows: DataFrame, keys: list[Column], known: DataFrame, of: list[str], row_bytes: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(rows that may have their keys among `of` of known, rows that surely don't, known) for a join on these keys.

    A small known, a written table, comes with a hint to broadcast it; then all rows may match, and none are surely apart.
    Else one bit for each hash of its keys is broadcast, SIFT_BITS at most, so that of wide rows only those are shuffled that
    match, and a few beside them.  Nulls are keys like others."""
    n = known.count()
    if n * row_bytes <= BROADCAST_BYTES:
        return rows, None, F.broadcast(known)
    chunk = 8 * 4096  # bits of a bitmap
    width = min(SIFT_BITS, max(chunk, 1 << (16 * n - 1).bit_length()))
    place = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(width))
    at = known.select(place(map(F.col, of)).alias("p")).select(F.expr(f"p div {chunk}").alias("_sift_chunk"), F.expr(f"p % {chunk}").alias("p"))
    bits = at.repartition("_sift_chunk").groupBy("_sift_chunk").agg(F.bitmap_construct_agg("p").alias("_sift_bits"))
    placed = rows.withColumn("_sift_place", place(keys)).join(F.broadcast(bits), F.expr(f"_sift_place div {chunk}") == F.col("_sift_chunk"), "left")
    byte = f"cast(conv(hex(substring(_sift_bits, cast(_sift_place % {chunk} div 8 as int) + 1, 1)), 16, 10) as int)"
    may = F.expr(f"coalesce(shiftright({byte}, cast(_sift_place % 8 as int)) & 1, 0)")
    own = lambda df: df.select(*(F.col(f"`{c}`") for c in rows.columns))
    return own(placed.where(may == 1)), own(placed.where(may == 0)), known


def words(text: Column | str) -> Column:
    """The words of a text; none for a null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def count_words(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


#: Edges that a task contracts at a time.
CHUNK_EDGES = 250_000
MOST_ROUNDS = 200


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's edges as stars: each node to the smallest of its component in the chunk."""
    root: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = a, b
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            while (up := root.setdefault(y, y)) != y:
                root[y] = y = root[up]
            if x != y:
                root[max(x, y)] = min(x, y)
    found = []
    for x in root:
        y = x
        while root[y] != y:
            y = root[y]
        if x != y:
            found.append((x, y))
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def components(edges: DataFrame, work: Workspace, name: str, chunk: int = 0) -> DataFrame:
    """(node, root): connected components of the undirected edges (a, b), root the smallest node.

    Edges are dealt into chunks of a fixed size and each chunk is contracted to stars, which leaves short paths and at
    most one edge for each node of a chunk.  If there is more than one chunk, alternating large-star and small-star rounds,
    each a grouped minimum over a written table, join them; their number grows with the logarithm of the longest path.  No
    edge list reaches the driver, and a node with very many edges is only ever aggregated.  Nodes without an edge are not
    in the result.  A path that MOST_ROUNDS don't settle, longer than any 64-bit ids can make, raises.
    """
    state = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    given = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    given = work.write(given, f"{name}-edges")
    chunks = max(1, -(-given.count() // (chunk or CHUNK_EDGES)))
    dealt = given.repartition(chunks) if chunks > 1 else given.coalesce(1)
    now = work.write(dealt.mapInArrow(_contract, "a long, b long"), f"{name}-0")
    work.drop(f"{name}-edges")
    before = state(now)
    for round_ in range(1, MOST_ROUNDS if chunks > 1 else 1):
        large = _star(now, large=True)
        small = _star(large, large=False)
        now = work.write(small.distinct(), f"{name}-{round_}")
        work.drop(f"{name}-{round_ - 1}")
        if (after := state(now)) == before:
            break
        before = after
    else:
        if chunks > 1:
            raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges are (a, b) with a > b.  Large: larger neighbours of each node move to its smallest neighbour or itself.
    Small: a node and its smaller neighbours move to the smallest of them."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = edges.withColumnRenamed("a", "u").join(least, "u")
        moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b")
