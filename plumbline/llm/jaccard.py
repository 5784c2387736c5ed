"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmap signatures, sorted-array intersection.

Two documents link when 100 * |A and B| >= 80 * |A or B| for their sets of 5-word shingles (64-bit hashes).  Linked
sets share one of the first |A| - ceil(0.8 |A|) + 1 elements in any common order (prefix filtering), so documents meet
only in tiles: one such element and a band of set sizes, neighbours' bands included.  The order puts elements that were
counted most often last, which keeps passages that very many documents share out of the prefixes; it decides how much
work there is, never what is found.  In a tile the bitmaps (one bit for each hash modulo a power of two near the set's
size) bound the overlap from above, and what passes is decided by intersecting the sorted arrays.

Only components are asked for, so a tile isn't expanded into all its pairs.  Equal sets are one class from the start.
First every set of a tile is compared with its neighbour by size and with the tile's hub, the set that shares most of
its prefix with others (the text that a group of near copies comes from).  Then, in tiles that still hold several
components, with the hub outside the first hub's component.  Last come all pairs whose ends are still apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, components, sifted, table
from .textkit import pieces, shingle_sets

#: Shingles that a task reports as frequent, and that all tasks together put last in the order: a hint, 16 bytes each.
LOCAL_HEAVY, HEAVY, HEAVY_LEAST = 4096, 65536, 8
NUM, DEN = 80, 100
#: Rounds in which tiles that are still open are compared with hubs before all their pairs are.
HUB_ROUNDS = 1


def frequent(docs: DataFrame, text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the most frequent shingles, sorted by hash; every text is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def merged(keys, counts):
            own, n = np.unique(np.concatenate(held), return_counts=True)
            worth = np.isin(own, keys) | (n > 1)
            own, n = own[worth], n[worth]
            all_keys, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
            total = np.zeros(len(all_keys), np.int64)
            np.add.at(total, at, np.concatenate([counts, n]))
            if len(all_keys) > 8 * LOCAL_HEAVY:
                top = np.sort(np.argpartition(-total, 4 * LOCAL_HEAVY)[: 4 * LOCAL_HEAVY])
                all_keys, total = all_keys[top], total[top]
            return all_keys, total

        for batch in pieces(batches, 0):
            for s in shingle_sets(batch.column(0), k):
                held.append(s)
                size += len(s)
            if size > 2_000_000:
                keys, counts = merged(keys, counts)
                held.clear()
                size = 0
        if held:
            keys, counts = merged(keys, counts)
        top = np.argsort(-counts, kind="stable")[:LOCAL_HEAVY]
        top = top[counts[top] >= HEAVY_LEAST // 2]
        yield pa.RecordBatch.from_arrays([pa.array(keys[top].view(np.int64)), pa.array(counts[top])], ["h", "n"])

    found = docs.select(text).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_LEAST).orderBy(F.desc("n"), "h").limit(HEAVY).toPandas()
    order = np.argsort(hashes := found["h"].to_numpy(np.int64).view(np.uint64))
    return hashes[order], found["n"].to_numpy(np.int64)[order]


def bitmap(values: np.ndarray) -> bytes:
    """One bit for each value modulo a power of two of at least twice their number.  Unrelated sets are far below the bound
    at that width already; the bitmaps go with every pair, so more bits cost more than the pairs that they would hold back."""
    width = max(64, 2 << max(0, int(len(values) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(values & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_bound(a: bytes, b: bytes, n: int, m: int) -> int:
    """No two sets with these bitmaps and sizes have a larger intersection: each bit set on one side only stands for an
    element of that side that the other lacks.  The wider bitmap is folded to the width of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    only_x, only_y = int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum())
    return min(n - only_x, m - only_y)


def linked(common: int, n: int, m: int) -> bool:
    return DEN * common >= NUM * (n + m - common)


def signatures(docs: DataFrame, doc_id: str, text: str, k: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, n, digest, prefix, bits): set size, 128-bit digest of the set, the prefix's hashes, the bitmap."""
    keys, counts = heavy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            sizes, digests, prefixes, bits = [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                n = len(s)
                sizes.append(n)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if n and len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    weight = np.where(keys[at] == s, counts[at], 0)
                    if weight.any():
                        s = s[np.argsort(weight, kind="stable")]
                prefixes.append(s[: n - (NUM * n + DEN - 1) // DEN + 1].tobytes() if n else b"")
                bits.append(bitmap(s) if n else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "n", "digest", "prefix", "bits"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n int, digest binary, prefix binary, bits binary")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cid, n, prefix = batch.columns
        counts = np.asarray(pc.binary_length(prefix), np.int64) // 8
        keys = np.frombuffer(b"".join(prefix.to_pylist()), np.int64)
        sizes = np.repeat(np.asarray(n), counts)
        left = sizes - (np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(np.asarray(cid), counts)), pa.array(sizes), pa.array(left)], ["key", "cid", "n", "left"])


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [linked(min(overlap_bound(x, y, n, m), n, m), n, m) for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            cids, digests = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [(c, raw) for c, d, s in zip(cids, digests, shingle_sets(batch.column(2), k), strict=True) if hashlib.blake2b(raw := s.tobytes(), digest_size=16).digest() == d]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([r for _, r in found], pa.binary())], ["cid", "elements"])

    return run


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = len(y) - 1
            keep.append(linked(int((y[at] == x).sum()), len(x), len(y)))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: set size, and the smallest doc_id reachable by links.

    A null or wordless text has an empty set and is alone.  Rows with equal texts are one class whatever their ids; a
    null id is never the smallest unless all ids of the component are null.  Repeated rows each give a row.  Whole texts
    are shingled, however long; other columns are ignored, whatever their names; an empty table gives no rows.

    Components are all that is returned: a pair that is already in one component by other links is not verified, so links
    are not counted.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "jaccard")
    sig = work.write(signatures(docs, doc_id, text, k, frequent(docs, text, k)), "signatures")
    classes = sig.where("n > 0").groupBy("n", "digest").agg(F.min("doc_id").alias("least"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    classes = work.write(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # Each table goes as soon as what is still needed of it stands elsewhere.
    members = work.write(sig.select("doc_id", "n", "digest"), "members")
    work.drop("signatures")

    by_size = Window.partitionBy("key").orderBy("n", "cid")
    keys = classes.select("cid", "n", "prefix").mapInArrow(_tiles, "key long, cid long, n int, left int")
    tiles = keys.select("key", "cid", "n", "left", F.lag(F.struct("cid", "n", "left")).over(by_size).alias("before"), F.lead("cid").over(by_size).alias("after"))
    tiles = work.write(tiles.where("before is not null or after is not null").drop("after"), "tiles")
    classes = work.write(classes.drop("prefix"), "classes-bits")
    work.drop("classes")
    support = tiles.groupBy("cid").agg(F.count(F.lit(1)).alias("support"))
    members_of = tiles.select("key", "cid", "n", "left").join(support, "cid")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) of classes that link, written."""
        side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
        pairs = work.write(pairs.distinct(), f"{name}-pairs")  # the shuffled tiles go before bitmaps are shuffled
        near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
        near = work.write(near.mapInArrow(_may_link, "a long, b long"), f"{name}-near")
        work.drop(f"{name}-pairs")
        ends = near.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "digest", "least"), "cid")
        ends = work.write(ends, f"{name}-ends")
        own = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text"))
        own, _, ends = sifted(own, [F.col("_id")], ends, ["least"], 64)
        texts = own.join(ends, F.coalesce("_id", F.lit(-(1 << 63))) == F.coalesce("least", F.lit(-(1 << 63))))
        sets = texts.select("cid", "digest", "text").mapInArrow(_sets(k), "cid long, elements binary").dropDuplicates(["cid"])
        sets = work.write(sets, f"{name}-sets")
        part = lambda c: sets.select(F.col("cid").alias(c), F.col("elements").alias(f"elements_{c}"))
        both = near.join(part("a"), "a").join(part("b"), "b").select("a", "b", "elements_a", "elements_b")
        out = work.write(both.mapInArrow(_intersect, "a long, b long"), f"{name}-links")
        work.drop(f"{name}-near", f"{name}-ends", f"{name}-sets")
        return out

    rank = F.struct("support", F.negative("cid").alias("last"), "n", "left", "root")

    def may(n, m, left_n, left_m):
        """Whether two sets of a tile may link: by their sizes, and by what each has from the tile's element on.  For the
        first element that two sets share, the latter bounds their overlap; if they link, they pass there."""
        n, m = n.cast("long"), m.cast("long")
        return (DEN * F.least(n, m) >= NUM * F.greatest(n, m)) & ((DEN + NUM) * F.least(left_n, left_m).cast("long") >= NUM * (n + m))

    def with_hubs(rows: DataFrame, hubs: DataFrame) -> DataFrame:
        hub = hubs.select("key", F.negative("hub.last").alias("a"), F.col("hub.n").alias("n_a"), F.col("hub.left").alias("left_a"), F.col("hub.root").alias("root_a"))
        return rows.join(hub, "key").where((F.col("root") != F.col("root_a")) & may(F.col("n"), F.col("n_a"), F.col("left"), F.col("left_a"))).select("a", F.col("cid").alias("b"))

    def placed_by(roots: DataFrame) -> DataFrame:
        """Rows of tiles that still hold several components."""
        placed = members_of.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        several = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        return placed.join(several, "key", "left_semi")

    neighbours = tiles.where("before is not null").where(may(F.col("before.n"), F.col("n"), F.col("before.left"), F.col("left"))).select(F.col("before.cid").alias("a"), F.col("cid").alias("b"))
    apart = members_of.withColumn("root", F.col("cid"))
    first = verified(neighbours.unionAll(with_hubs(apart, apart.groupBy("key").agg(F.max(rank).alias("hub")))), "first")
    links = first
    roots = work.write(components(links, work, "roots"), "roots")
    for turn in range(HUB_ROUNDS):
        placed = work.write(placed_by(roots), f"open{turn}")
        hubs = placed.groupBy("key").agg(F.max(rank).alias("hub"))
        others = placed.join(hubs, "key").where("root <> hub.root").groupBy("key").agg(F.max(rank).alias("hub"))
        more = verified(with_hubs(placed, others).unionAll(with_hubs(placed, hubs)), f"hub{turn}")
        work.drop(f"open{turn}")
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more)
        roots = work.write(components(links, work, f"roots{turn}"), f"roots-{turn}")

    band = F.floor(F.log("n") / np.log(DEN / NUM)).cast("int")
    placed = work.write(placed_by(roots).withColumn("band", band), "open")
    small = placed.select("key", F.explode(F.array("band", F.col("band") + 1)).alias("band"), F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"), F.col("root").alias("root_a"))
    large = placed.select("key", "band", F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("left").alias("left_b"), F.col("root").alias("root_b"))
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    across = small.join(large, ["key", "band"]).where(ordered & may(F.col("n_a"), F.col("n_b"), F.col("left_a"), F.col("left_b")) & (F.col("root_a") != F.col("root_b"))).select("a", "b")
    second = verified(across, "last")
    work.drop("open", "tiles")

    joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(second)
    final = components(joined, work, "final").withColumnRenamed("node", "cid")
    known = classes.select("cid", "n", "digest", "least").join(final, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    known = work.write(known, "known")
    work.drop("classes-bits")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = known.join(least, "root").select("n", "digest", "component_id")
    alone = members.where("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return members.where("n > 0").join(of_class, ["n", "digest"]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").unionAll(alone)


def op3_jaccard(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS v FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(v) >= 5 THEN list_transform(range(1, len(v) - 3), lambda i: array_to_string(v[i:i + 4], ' ')) WHEN len(v) > 0 THEN [array_to_string(v, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT w.doc_id, count(g)::BIGINT AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node)
SELECT r.node AS doc_id, any_value(n.n) AS n_shingles, min(r.root) AS component_id FROM r JOIN n ON n.doc_id = r.node GROUP BY r.node
"""
