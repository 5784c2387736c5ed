"""Suffix-array dedup of byte substrings.

Shards of stretches (see repeats.py) get a suffix array each, by Larsson-Sadakane refinement up to the length that
matters.  Neighbours with a common prefix of that length are one window, owned by its smallest document.  An anchor with
more stretches than a shard holds is spread over several; a later shard finds its windows in the earlier ones by binary
search over their distinct windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, table
from .textkit import pieces
from .repeats import Solver, hot_spans, repeated_spans, union
from .suffixes import WindowShard

WINDOW, GRAM = 50, 16


class ByteSolver(Solver):
    def __init__(self, length: int = WINDOW):
        self.length, self.earlier = length, []

    def solve(self, anchors, ids, stretches, goes_on):
        if not goes_on:
            self.earlier = []
        if not stretches:
            return []
        data = np.frombuffer(b"".join(stretches), np.uint8)
        sizes = np.array([len(s) for s in stretches])
        offsets = np.cumsum(sizes) - sizes
        counts = np.maximum(sizes - self.length + 1, 0)
        row = np.repeat(np.arange(len(sizes)), counts)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts, owners = offsets[row] + inside, ids[row]
        own = WindowShard(data, starts, owners, self.length)
        least = own.least
        again = anchors[row] == anchors[0] if self.earlier else np.zeros(len(row), bool)
        if again.any():
            for shard in self.earlier:
                least[again] = np.minimum(least[again], shard.find(data, starts[again], np.iinfo(np.int64).max))
        gone = least < owners
        if anchors[0] != anchors[-1]:
            self.earlier = []
        of_last = anchors[row] == anchors[-1]  # may go on in the next shard
        self.earlier.append(own if of_last.all() else WindowShard(data[starts[of_last][0] :], starts[of_last] - starts[of_last][0], owners[of_last], self.length))
        out: list[list[tuple[int, int]]] = [[] for _ in stretches]
        head = gone.copy()
        head[1:] &= ~(gone[:-1] & (row[1:] == row[:-1]))
        tail = gone.copy()
        tail[:-1] &= ~(gone[1:] & (row[1:] == row[:-1]))
        for r, a, b in zip(row[head].tolist(), inside[head].tolist(), inside[tail].tolist(), strict=True):
            out[r].append((a, b + self.length))
        return out


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row: a byte of the UTF-8 text goes if it is in ``length``
    consecutive bytes that also start in a document with a smaller id; kept: the other bytes (not always valid UTF-8).

    A null text is empty.  Rows without id, and rows of one id among themselves, remove nothing.
    """
    work = Workspace(docs.sparkSession, "suffix")
    found, owners = repeated_spans(docs.select(doc_id, text), doc_id, text, "bytes", length, gram, lambda: ByteSolver(length), work)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                rows = []
                hot = hot_spans(part.column(0), part.column(1), part.column(4), owners and owners.value, "bytes", length)
                for own, copy, spans, more in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), hot, strict=True):
                    data = (own or "").encode("utf-8", "surrogatepass")
                    drop = [(0, len(data))] if copy and len(data) >= length else union([(s["a"], s["b"]) for s in spans or ()] + more)
                    left, at = [], 0
                    for a, b in drop:
                        left.append(data[at:a])
                        at = b
                    left.append(data[at:])
                    rows.append((len(data), sum(b - a for a, b in drop), len(drop), b"".join(left)))
                n, gone, many, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix(spark, sf_dir):
    done = suffix_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
