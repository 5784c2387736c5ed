"""Passages that also stand in an earlier document: what substring and suffix-array dedup have in common.

A window is ``length`` consecutive units (words or bytes) of one text.  A unit is removed if a window over it also starts
in a document with a smaller id.  Holding every window of the corpus against every shard of it would grow with the square
of the corpus, so windows are first brought together by content.

1. Exact copies of a text are settled by a digest: all windows of the later ones are repeats.
2. Every window has an anchor: of the runs of ``gram`` units in it the one with the least hash.  Equal windows have equal
   anchors, and neighbouring windows mostly share theirs, so there are far fewer anchors than windows.  Anchors of at
   least two documents are kept.
3. For a kept anchor each document sends the stretch of text that its windows with this anchor cover.  Stretches of an
   anchor meet in one shard, in the order of their documents, and the shard finds the repeated spans exactly (a suffix
   automaton for words, a suffix array for bytes).
4. An anchor that very many windows share has no shard, so what a task holds is bounded.  Its windows get a second anchor
   by longer runs beside the first, and their stretches meet by both; the few that are still shared by very many are taken
   apart by a 128-bit hash of the whole window.  Equal windows still meet, and the least owner of each is a grouped minimum.
5. The spans of each document go back to its text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, Workspace, broadcast_if_small
from .textkit import U64, binary_rows, buffers, give_back, mix, pieces, word_hashes, word_spans
from .suffixes import packed

NO_ID = -(1 << 63)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Units:
    """Words or bytes of a batch of texts."""

    def __init__(self, column: pa.Array, kind: str, length: int, grams: tuple[int, ...] = ()):
        self.kind, self.length, self.grams = kind, length, grams
        self.data, offsets = buffers(column)
        if kind == "words":
            self.starts, self.ends, self.first = word_spans(self.data, offsets)
            self.values = word_hashes(self.data, self.starts, self.ends)
        else:
            self.first, self.values = offsets, mix(packed(self.data))
        self._keys: list[np.ndarray] = []

    def hashes(self, size: int, salt: int) -> np.ndarray:
        """Hashes of ``size`` consecutive units; those that cross rows have no meaning."""
        if self.kind == "words":
            places = range(size)
        else:
            places = [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]
        n = max(0, len(self.values) - size + 1)
        total = np.zeros(n, np.uint64)
        for place in places:
            total += self.values[place : place + n] * U64(_odd(salt, place))
        return mix(total)

    def key(self, level: int) -> np.ndarray:
        """The anchor, at a level, of the window from each unit on."""
        while len(self._keys) <= level:
            gram = self.grams[len(self._keys)]
            own = sliding_min(self.hashes(gram, 0), self.length - gram + 1)
            self._keys.append(own if not self._keys else mix(self._keys[-1]) + own)
        return self._keys[level]

    @functools.cached_property
    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, first unit) of every window."""
        counts = np.maximum(np.diff(self.first) - self.length + 1, 0)
        rows = np.repeat(np.arange(len(counts)), counts)
        return rows, np.arange(len(rows)) + np.repeat(self.first[:-1] - (np.cumsum(counts) - counts), counts)

    def runs(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, a, b): stretches of consecutive windows a, ..., b - 1 of one row with one anchor."""
        rows, at = self.places
        anchor = self.key(level)[at]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(at)))
        return rows[heads], anchor[heads], at[heads], at[heads] + sizes

    def sizes(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, number of bytes) of the units a, ..., b - 1 + length - 1 each."""
        last = b + self.length - 2
        lo, hi = (self.starts[a], self.ends[last]) if self.kind == "words" else (a, last + 1)
        return lo, hi - lo

    def stretch(self, a: np.ndarray, b: np.ndarray) -> pa.Array:
        """The bytes of the units a, ..., b - 1 + length - 1 each."""
        lo, sizes = self.sizes(a, b)
        take = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)
        return binary_rows(self.data[take], sizes)


@functools.cache
def _odd(salt: int, place: int) -> int:
    """An odd 64-bit number for each place of a window."""
    return int(mix(np.array([salt << 32 | place], np.uint64))[0]) | 1


#: Anchors fall into so many buckets; a task tells which of them it has seen LOCAL times or more.
BUCKETS, LOCAL = 1 << 22, 32
#: Windows of buckets that have been told so often, over all tasks, go to the next level at once.
HOT_ROWS = 20_000


def _anchors(kind: str, length: int, grams: tuple[int, ...]):
    """(anchor, id, seq, size): the anchors of each text with the bytes of their stretches.  At a task's end rows without id: a
    bucket of anchors and how often it came, if that is often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen = ["anchor", "id", "seq", "size"], np.zeros(BUCKETS, np.uint32)
        for batch in pieces(batches, 2):
            units = Units(batch.column(2), kind, length, grams)
            rows, anchor, a, b = units.runs(0)
            if not len(rows):
                continue
            sizes = units.sizes(a, b)[1]
            once = np.lexsort((anchor, rows))
            rows, anchor = rows[once], anchor[once]
            keep = np.ones(len(rows), bool)
            keep[1:] = (rows[1:] != rows[:-1]) | (anchor[1:] != anchor[:-1])
            sizes = np.add.reduceat(sizes[once], np.flatnonzero(keep))
            rows, anchor = pa.array(rows[keep]), anchor[keep]
            buckets, times = np.unique(anchor & U64(BUCKETS - 1), return_counts=True)
            seen[buckets.astype(np.int64)] += times.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(sizes)], names)
        often = np.flatnonzero(seen >= LOCAL)
        yield pa.RecordBatch.from_arrays([pa.array(often), pa.nulls(len(often), pa.int64()), pa.array(np.zeros(len(often), np.int32)), pa.array(seen[often].astype(np.int64))], names)

    return run


def _among(asked: np.ndarray, rows: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each value, of a row, is in that row's list; rows ascend."""
    counts = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    values = lists.flatten().to_numpy().view(np.uint64)
    values = values[np.lexsort((values, np.repeat(np.arange(len(counts)), counts)))]
    ends, bounds, found = np.cumsum(counts), np.searchsorted(rows, np.arange(len(counts) + 1)), np.zeros(len(rows), bool)
    for i in np.flatnonzero(counts).tolist():
        own, mine = values[ends[i] - counts[i] : ends[i]], slice(bounds[i], bounds[i + 1])
        at = np.minimum(np.searchsorted(own, asked[mine]), len(own) - 1)
        found[mine] = own[at] == asked[mine]
    return found


def _stretches(kind: str, length: int, grams: tuple[int, ...]):
    """(level, anchor, id, seq, at, n, bytes): a text's stretches by the first anchors that its first list has, and by both
    anchors where its second list has the first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            units = Units(batch.column(2), kind, length, grams)
            for level in (0, 1):
                lists = batch.column(3 + level)
                if not len(lists.flatten()):
                    continue
                rows, anchor, a, b = units.runs(level)
                found = _among(units.key(0)[a], rows, lists)
                rows, anchor, a, b = rows[found], anchor[found], a[found], b[found]
                if not len(rows):
                    continue
                base, take = units.first[:-1][rows], pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), level, np.int32)), pa.array(anchor.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(a - base), pa.array(b - a + length - 1), units.stretch(a, b)], ["level", "anchor", "id", "seq", "at", "n", "bytes"])

    return run


def _windows(kind: str, length: int):
    """(h1, h2, id, seq): the distinct windows of each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            units = Units(batch.column(2), kind, length)
            rows, at = units.places
            found = np.stack([rows.astype(np.uint64), units.hashes(length, 1)[at], units.hashes(length, 2)[at]])
            found = found[:, np.lexsort(found[::-1])]
            new = np.ones(found.shape[1], bool)
            new[1:] = (found[:, 1:] != found[:, :-1]).any(axis=0)
            take = pa.array(found[0, new].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found[1, new].view(np.int64)), pa.array(found[2, new].view(np.int64)), batch.column(0).take(take), batch.column(1).take(take)], ["h1", "h2", "id", "seq"])

    return run


class Owners:
    """Hashes of windows with their least owners, for texts of which some windows are in question."""

    def __init__(self, h1: list[int], h2: list[int], least: list[int]):
        one = np.array(h1, np.int64).view(np.uint64) + mix(np.array(h2, np.int64).view(np.uint64))
        order = np.argsort(one, kind="stable")
        self.one, self.h2, self.least = one[order], np.array(h2, np.int64).view(np.uint64)[order], np.array(least, np.int64)[order]

    def before(self, h1: np.ndarray, h2: np.ndarray, owner: int) -> np.ndarray:
        """Which windows an owner before this one has."""
        if not len(self.one):
            return np.zeros(len(h1), bool)
        asked = h1 + mix(h2)
        at = np.minimum(np.searchsorted(self.one, asked), len(self.one) - 1)
        return (self.one[at] == asked) & (self.h2[at] == h2) & (self.least[at] < owner)


def hot_spans(ids: pa.Array, texts: pa.Array, hot: pa.Array, owners: Owners | None, kind: str, length: int) -> list[list[tuple[int, int]]]:
    """For each text with a list, the unit spans of its windows that the owners know, or whose hashes (h1, h2) are listed."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
    rows = np.flatnonzero(np.asarray(hot.is_valid()))
    if not len(rows):
        return out
    units = Units(texts.take(pa.array(rows)), kind, length)
    h1, h2 = units.hashes(length, 1), units.hashes(length, 2)
    for r, lo, hi in zip(rows.tolist(), units.first[:-1].tolist(), units.first[1:].tolist(), strict=True):
        own = slice(lo, max(lo, hi - length + 1))
        pairs = hot[r].values
        if owners is not None:
            gone = owners.before(h1[own], h2[own], ids[r].as_py())
        else:
            gone = Owners(pairs.field(0).to_pylist(), pairs.field(1).to_pylist(), [0] * len(pairs)).before(h1[own], h2[own], 1)
        for at in np.flatnonzero(gone).tolist():
            if out[r] and out[r][-1][1] >= at:
                out[r][-1] = (out[r][-1][0], at + length)
            else:
                out[r].append((at, at + length))
    return out


class Solver:
    """Finds the repeats among the differing stretches of one shard."""

    def solve(self, anchors: np.ndarray, ids: np.ndarray, stretches: list[bytes], goes_on: bool) -> list[list[tuple[int, int]]]:
        """For each stretch the unit spans that an earlier stretch of a smaller id repeats.  Stretches come by anchor and
        id, each once.  goes_on: the anchor of the last call's last stretch comes again, with ids not smaller."""
        raise NotImplementedError


#: Bytes of stretches that a task holds at a time; an anchor with more is solved in several shards.
SHARD_BYTES = 1 << 20
#: An anchor with more bytes of stretches goes to the next level.
HOT_BYTES = 2 << 20
#: Parts into which the windows of one hash are dealt where their owners are too many to broadcast.
SALTS = 16


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole anchors, about SHARD_BYTES at a time; a larger anchor comes in parts."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.nbytes for t in held) < SHARD_BYTES:
            continue
        table = pa.concat_tables(held).combine_chunks()
        anchors = table["anchor"].to_numpy()
        cut = int(np.argmax(anchors == anchors[-1]))
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        held = [rest]
        if rest.nbytes >= SHARD_BYTES:
            yield rest
            held = []
    if held:
        yield pa.concat_tables(held).combine_chunks()


def shard(solver: Callable[[], Solver]):
    """From stretches sorted by anchor, id and seq to spans (id, seq, a, b).  A stretch that equals one of a smaller id is
    a repeat as a whole; only anchors with differing stretches are solved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, seen = solver(), None, {}
        for table in _parts(batches):
            if not table.num_rows:
                continue
            anchors, ids, seq, at, n = (table[c].to_numpy() for c in ("anchor", "id", "seq", "at", "n"))
            coded = table["bytes"].combine_chunks().dictionary_encode()
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            code, stretches = coded.indices.to_numpy(), coded.dictionary
            goes_on = anchors[0] == last
            low = np.full(len(stretches), np.iinfo(np.int64).max)
            np.minimum.at(low, code, ids)
            first = np.full(len(stretches), len(code))
            np.minimum.at(first, code, np.arange(len(code)))
            if goes_on:  # stretches that an earlier part of this anchor has had
                for c in np.flatnonzero(anchors[first] == last):
                    low[c] = min(low[c], seen.get(stretches[int(c)].as_py(), low[c]))
            whole = ids > low[code]
            out = [np.stack([ids[whole], seq[whole], at[whole], at[whole] + n[whole]])]
            _, of, many = np.unique(anchors[first], return_inverse=True, return_counts=True)
            open_ = np.flatnonzero((many[of] > 1) | (goes_on & (anchors[first] == last)) | (anchors[first] == anchors[-1]))
            open_ = open_[np.argsort(first[open_], kind="stable")]
            if goes_on:
                open_ = open_[[stretches[int(c)].as_py() not in seen if anchors[first[c]] == last else True for c in open_]]
            solved = own.solve(anchors[first[open_]], low[open_], stretches.take(pa.array(open_)).to_pylist(), goes_on)
            if anchors[0] != anchors[-1] or not goes_on:
                seen = {}
            for c in np.flatnonzero(anchors[first] == anchors[-1]):
                seen.setdefault(stretches[int(c)].as_py(), low[c])
            last = anchors[-1]
            spans = {int(c): s for c, s in zip(open_, solved, strict=True) if s}
            if spans:
                for r in np.flatnonzero(~whole & np.isin(code, np.fromiter(spans, np.int64))):
                    out.append(np.array([[ids[r], seq[r], at[r] + a, at[r] + b] for a, b in spans[int(code[r])]]).T)
            rows = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1].astype(np.int32)), pa.array(rows[2]), pa.array(rows[3])], ["id", "seq", "a", "b"])
        own, seen = None, {}
        give_back()

    return run


def repeated_spans(docs: DataFrame, doc_id: str, text: str, kind: str, length: int, gram: int, solver: Callable[[], Solver], work: Workspace):
    """((doc_id, text, copy, spans, hot, rest) for every row, owners): whether it is a copy of the text of a smaller id,
    [a, b) unit spans to remove (null if none), possibly overlapping, what ``hot_spans`` needs for further windows to remove,
    and the other columns as a struct.  owners: a broadcast of Owners, or None.

    solver: see ``shard``.
    A row without id is compared with nothing.  Rows of one id, with one text or several, don't remove each other.
    Intermediate tables stay in the work folder until its owner drops them.
    """
    h = [F.xxhash64(F.lit(i), F.coalesce("text", F.lit(""))) for i in (1, 2)]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (doc_id, text)]
    rest = F.struct(*others) if others else F.lit(None).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), rest.alias("rest"))
    marks = work.write(rows.where("id is not null").select("id", h[0].alias("h1"), h[1].alias("h2")), "marks")
    firsts = marks.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    texts_of = marks.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi")).where("lo <> hi").select("id")
    several = marks.join(texts_of, "id", "left_semi").distinct().withColumn("seq", F.row_number().over(Window.partitionBy("id").orderBy("h1", "h2")))
    odd = marks.join(firsts, ["h1", "h2"]).where("id > least").select("id", "h1", "h2").distinct().withColumn("copy", F.lit(True))
    odd = work.write(odd.join(several, ["id", "h1", "h2"], "full_outer").select("id", "h1", "h2", F.coalesce("copy", F.lit(False)).alias("copy"), F.coalesce("seq", F.lit(0)).alias("seq")), "odd")
    rows = rows.withColumns({"h1": h[0], "h2": h[1]}).join(broadcast_if_small(odd, 64), ["id", "h1", "h2"], "left")
    rows = rows.select("id", F.coalesce("seq", F.lit(0)).alias("seq"), "text", F.coalesce("copy", F.lit(False)).alias("copy"), "rest")

    own = rows.where("not copy and id is not null").select("id", "seq", "text")
    spark, grams = docs.sparkSession, (gram, length - max(3, length // 5))
    pair, owners = "array<struct<h1:long,h2:long>>", None
    schema, spans = "level int, anchor long, id long, seq int, at long, n long, bytes binary", "id long, seq int, a long, b long"
    meet = lambda df: df.drop("level").repartition("anchor").sortWithinPartitions("anchor", "id", "seq").mapInArrow(shard(solver), spans)
    anchors = work.write(own.mapInArrow(_anchors(kind, length, grams), "anchor long, id long, seq int, size long"), "anchors")
    often = work.write(anchors.where("id is null").groupBy(F.col("anchor").alias("bucket")).agg(F.sum("size").alias("n")).where(F.col("n") >= HOT_ROWS).select("bucket", F.lit(True).alias("often")), "often")
    # An anchor that comes very often is a group for each document here: it is hot whatever its group would say.
    rows_ = anchors.where("id is not null").withColumn("bucket", F.col("anchor").bitwiseAND(F.lit(BUCKETS - 1))).join(broadcast_if_small(often, 16), "bucket", "left")
    rows_ = rows_.select("anchor", "id", "seq", "size", F.coalesce("often", F.lit(False)).alias("often"), F.when(F.col("often"), F.col("id")).alias("salt"))
    by_anchor = Window.partitionBy("anchor", "salt")
    known = rows_.withColumns({"lo": F.min("id").over(by_anchor), "hi": F.max("id").over(by_anchor), "total": F.sum("size").over(by_anchor)}).where("often or lo < hi")
    known = known.select("id", "seq", "anchor", (F.col("often") | (F.col("total") > HOT_BYTES)).alias("hot"))
    shared = known.groupBy("id", "seq").agg(F.collect_list(F.when(~F.col("hot"), F.col("anchor"))).alias("anchors"), F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    shared = work.write(shared, "shared")
    work.drop("anchors", "often")
    stretches, gone = own.join(shared, ["id", "seq"]).select("id", "seq", "text", "anchors", "hot").mapInArrow(_stretches(kind, length, grams), schema), None
    if shared.where("size(hot) > 0").isEmpty():
        found = meet(stretches)
    else:
        stretches = work.write(stretches, "stretches")
        fine = stretches.where("level = 1")
        size = F.sum(F.length("bytes"))
        still = work.write(fine.groupBy("anchor").agg(size.alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi")).where((F.col("size") > HOT_BYTES) & (F.col("lo") < F.col("hi"))).select("anchor"), "still")
        found = meet(stretches.join(broadcast_if_small(still, 16), "anchor", "left_anti"))
        if not still.isEmpty():
            left = fine.join(broadcast_if_small(still, 16), "anchor", "left_semi").select("id", "seq", "bytes")
            windows = work.write(left.mapInArrow(_windows(kind, length), "h1 long, h2 long, id long, seq int").distinct(), "windows")
            least = work.write(windows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("last")).where("least < last").drop("last"), "least")
            if least.count() * 24 <= BROADCAST_BYTES:  # counted: the texts in question are looked up where they are
                got = least.toPandas()
                owners = spark.sparkContext.broadcast(Owners(got["h1"].tolist(), got["h2"].tolist(), got["least"].tolist()))
                gone = windows.select("id", "seq").distinct().withColumn("hot", F.array().cast(pair))
            else:
                salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
                gone = windows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).join(salted, ["h1", "h2", "salt"]).where("id > least").groupBy("id", "seq").agg(F.collect_list(F.struct("h1", "h2")).alias("hot"))
    found = found.groupBy("id", "seq").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    found = found.withColumn("hot", F.lit(None).cast(pair)) if gone is None else found.join(gone, ["id", "seq"], "full_outer")
    found = work.write(found, "spans")
    work.drop("shared", "stretches", "still", "windows", "least")
    return rows.join(found, ["id", "seq"], "left").select(F.col("id").alias("doc_id"), "text", "copy", "spans", "hot", "rest"), owners


def union(spans) -> list[tuple[int, int]]:
    """Maximal spans of possibly overlapping or touching ones."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
