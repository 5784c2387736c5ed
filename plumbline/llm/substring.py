"""Substring dedup: suffix automata of reference shards and matching statistics.

``automaton_dedup`` streams documents against one broadcast automaton of a reference table of bounded size.  Within a
corpus the references are all documents with a smaller id, which have no bound; ``substring_dedup`` deals them into
shards by content (see repeats.py), and each shard streams its documents, in order, against the automaton of those
before them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import SuffixAutomaton, spans
from .common import Workspace, table
from .textkit import pieces
from .repeats import Solver, hot_spans, repeated_spans, union

WINDOW, GRAM = 13, 4
_WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
#: Largest reference that is broadcast, in words.
REFERENCE_WORDS = 200_000


class WordSolver(Solver):
    """One automaton for each anchor; a document is streamed before it is added, so it meets smaller ids only."""

    def __init__(self, length: int = WINDOW):
        self.length, self.automaton = length, SuffixAutomaton()

    def solve(self, anchors, ids, stretches, goes_on):
        out, last, waiting, of = [], anchors[0] if goes_on and len(anchors) else None, [], None
        for anchor, doc, raw in zip(anchors.tolist(), ids.tolist(), stretches, strict=True):
            if anchor != last:
                self.automaton, last, waiting, of = SuffixAutomaton(), anchor, [], None
            if doc != of:
                for words in waiting:
                    self.automaton.add(words)
                waiting, of = [], doc
            words = raw.split()
            out.append(spans(self.automaton.statistics(words), self.length))
            waiting.append(words)
        for words in waiting:
            self.automaton.add(words)
        return out


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept, rest) for every row, rest being its other columns: a word goes if it is in ``length`` consecutive words that also
    start in a document with a smaller id; kept: the remaining words, joined by a space (the whole text if none goes).

    A null text has no words.  Rows without id, and rows of one id among themselves, remove nothing.
    """
    work = Workspace(docs.sparkSession, "substring")
    found, owners = repeated_spans(docs, doc_id, text, "words", length, gram, lambda: WordSolver(length), work)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                totals, gone, kept = [], [], []
                hot = hot_spans(part.column(0), part.column(1), part.column(4), owners and owners.value, "words", length)
                for own, copy, spans_, more in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), hot, strict=True):
                    words = _WORDS.findall((own or "").encode("utf-8", "surrogatepass"))
                    drop = [(0, len(words))] if copy and len(words) >= length else union([(s["a"], s["b"]) for s in spans_ or ()] + more)
                    left, at = [], 0
                    for a, b in drop:
                        left += words[at:a]
                        at = b
                    left += words[at:]
                    totals.append(len(words))
                    gone.append(len(words) - len(left))
                    kept.append(b" ".join(left))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), part.column(5)], ["doc_id", "text", "n_words", "n_removed", "kept", "rest"])

    counts = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    return found.mapInArrow(run, T.StructType([found.schema["doc_id"], found.schema["text"], *counts, found.schema["rest"]]))


def automaton_dedup(docs: DataFrame, references: DataFrame, text: str = "text", reference_text: str = "text", length: int = WINDOW) -> DataFrame:
    """The given rows with ``matched``: maximal word spans [a, b) that repeat at least ``length`` words of a reference.
    References are shards of at most REFERENCE_WORDS words, each broadcast as an automaton and streamed against in turn;
    their size is counted first, and more than 64 shards are refused."""
    counted = references.select(F.sum(F.regexp_count(F.coalesce(reference_text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).first()["n"] or 0
    if counted > 64 * REFERENCE_WORDS:
        raise ValueError(f"{counted} words are too many to broadcast; use substring_dedup over both tables")
    shards, size = [SuffixAutomaton()], 0
    for row in references.select(reference_text).toLocalIterator():
        words = _WORDS.findall((row[0] or "").encode("utf-8", "surrogatepass"))
        if size and size + len(words) > REFERENCE_WORDS:
            shards, size = [*shards, SuffixAutomaton()], 0
        shards[-1].add(words)
        size += len(words)
    sent = docs.sparkSession.sparkContext.broadcast([(s.next, s.link, s.length) for s in shards])
    at = docs.columns.index(text)
    span = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("matched", T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = []
        for next_, link, size_ in sent.value:
            own.append(a := SuffixAutomaton())
            a.next, a.link, a.length = next_, link, size_
        for batch in batches:
            found = []
            for t in batch.column(at).to_pylist():
                words = _WORDS.findall((t or "").encode("utf-8", "surrogatepass"))
                found.append([{"a": a, "b": b} for a, b in union(s for x in own for s in spans(x.statistics(words), length))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], [*batch.schema.names, "matched"])

    return docs.mapInArrow(run, schema)


def op6_substring(spark, sf_dir):
    done = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS v FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(v) - 11)) AS i, v FROM w WHERE len(v) >= 13),
h AS (SELECT doc_id, i, array_to_string(v[i:i + 12], ' ') AS s FROM g),
m AS (SELECT s, min(doc_id) AS least FROM h GROUP BY s),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM h JOIN m USING (s) WHERE least < doc_id),
x AS (SELECT doc_id, list(k) AS gone FROM r GROUP BY doc_id),
u AS (SELECT doc_id, unnest(v) AS word, unnest(range(1, len(v) + 1)) AS k FROM w WHERE len(v) > 0),
kept AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.k) AS t FROM u ANTI JOIN r ON u.doc_id = r.doc_id AND u.k = r.k GROUP BY u.doc_id)
SELECT w.doc_id, len(v)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN x ON x.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
