"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Merges are taken from an agenda by score, leftmost first.  Each candidate that comes up is skipped with the dropout rate;
it may come up again when a neighbour has changed the pair.  The draws are keyed by (seed, doc_id, text, number of the
copy, place of the part in the text), so each occurrence of a word has its own, the same on every machine and rerun.  All
segmentations decode to the text.

No piece of the vocabulary has a space mark behind another character, so a merge never crosses from a word into the
spaces after it: a text is cut there.  What a part becomes depends only on which of its candidates are skipped, counted
in the order in which they come up.  So the draws are made as distances between skips, for all occurrences at once, and
what is remembered is the ids of (part, skips).
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, repeat
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .textkit import U64, binary_rows, buffers, give_back, mix, pieces
from .token_files import LETTER, STOP, vocabulary_path

SEED, RATE = 7, 0.1
#: (part, skips) whose ids a worker remembers (about 300 bytes each) and bytes of text that it encodes at a time.  A larger
#: memory is not faster: what one batch leaves that the next has again are the common parts, and those come first.
CACHED_PARTS, BATCH_BYTES = 1 << 16, 4 << 20
_MASK = (1 << 64) - 1
_STEP, _COPY = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
SPACE_MARK = "▁"


#: Longest part that is merged by scanning its pairs.
SHORT = 40
#: Parts of more bytes are merged anew for each occurrence.
LONG = 64
#: Parts that are merged at once.
MERGED_ROWS = 1 << 14


@functools.cache
def _tails(rate: float) -> np.ndarray:
    """Ascending, of 64-bit fractions: the chances that more than 0, 1, ... candidates are kept before the next skip."""
    keep = max(0, min(_MASK, int((1.0 - rate) * (1 << 64))))
    tails, now = [], keep
    while now:
        tails.append(now)
        now = now * keep >> 64
    return np.array(tails[::-1], np.uint64)


def _kept(keys: np.ndarray, turn, rate: float) -> np.ndarray:
    """Number of candidates kept between a part's skips turn - 1 and turn."""
    tails = _tails(rate)
    return len(tails) - np.searchsorted(tails, mix(keys + (np.atleast_1d(turn).astype(np.uint64) + U64(1)) * _STEP), side="right")


def _skips(key: int, rate: float, at: int = -1, turn: int = 0) -> Iterator[int]:
    """The numbers of the candidates that a part with this key skips, without end; those after at, of which there were turn."""
    while True:
        for kept in _kept(np.array([key], np.uint64), np.arange(turn, turn + 16), rate).tolist():
            at += kept + 1
            yield at
        turn += 16


class PieceModel:
    """Scores and bytes of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.rank: list[float] = []
        self.text: list[bytes] = []
        self.byte_id = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.rank.append(-model.get_score(i))
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append(b"")
            else:
                self.ids[piece] = i
                self.text.append(piece.replace(SPACE_MARK, " ").encode())
        self.none = float("inf")
        self.rank.append(self.none)
        self.rank_of = {piece: self.rank[i] for piece, i in self.ids.items()}
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.ids):
            raise ValueError("a piece of this model has a space mark behind another character")
        # All pairs of pieces that make a piece, sorted, and the pieces that single characters are.
        pairs = sorted((a * len(self.rank) + b, i) for p, i in self.ids.items() for c in range(1, len(p)) if (a := self.ids.get(p[:c])) is not None and (b := self.ids.get(p[c:])) is not None)
        self.pair_keys, self.pair_made = np.array([*(k for k, _ in pairs), 1 << 62], np.int64), np.array([*(i for _, i in pairs), 0], np.int32)
        self.pair_rank = np.array([*(self.rank[i] for _, i in pairs), self.none])
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_char[0x20], self.of_char[ord(SPACE_MARK)] = self.of_char[ord(SPACE_MARK)], -1
        #: No piece has a stop behind an ASCII letter: a text can be cut there too.
        self.stops_apart = not any(re.search(r"[A-Za-z][.,;:!?]", p) for p in self.ids)

    def encode(self, part: str, variant: int = 0, rate: float = 0.0, seed: int = SEED) -> list[int]:
        """Ids of a part; its spaces are space marks, a space mark in the text itself becomes bytes."""
        if not rate:
            return self.merge(part)[0]
        return self.merge(part, _skips(xxhash.xxh64_intdigest(part.encode("utf-8", "surrogatepass"), (seed * 1_000_003 + variant) & _MASK), rate))[0]

    def merge(self, part: str, skips: Iterable[int] = ()) -> tuple[list[int], int]:
        """Ids of a part of which the candidates with these numbers, ascending, are skipped; number of its candidates."""
        ids, skips = self.ids, iter(skips)
        symbols = [SPACE_MARK if c == " " else ("" if c == SPACE_MARK else c) for c in part] if SPACE_MARK in part or " " in part[1:] else [SPACE_MARK, *part[1:]] if part[:1] == " " else list(part)
        if len(symbols) <= SHORT:
            symbols, seen = self._scan(symbols, skips)
        else:
            symbols, seen = self._heap(symbols, skips)
        known = list(map(ids.get, symbols))
        if None not in known:
            return known, seen
        out: list[int] = []
        for s, i in zip(symbols, known, strict=True):
            out += [i] if i is not None else [self.byte_id[b] for b in (s or SPACE_MARK).encode("utf-8", "surrogatepass")]
        return out, seen

    def merge_all(self, parts: list[bytes], skips: np.ndarray, keys: np.ndarray | None = None, rate: float = 0.0) -> tuple[list[bytes], np.ndarray]:
        """(ids, number of candidates) of each part, as merge finds them, all parts at once.  A row of skips has the numbers
        of a part's first skips; with keys, those after them are drawn, else there are none."""
        texts = [part.decode("utf-8", "surrogatepass") for part in parts]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        symbols = self.of_char[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begin = np.cumsum(sizes) - sizes
        odd = sizes > LONG
        odd[np.repeat(np.arange(len(texts)), sizes)[symbols < 0]] = True
        found, seen = [b""] * len(texts), np.zeros(len(texts), np.int64)
        for i in np.flatnonzero(odd).tolist():
            own = skips[i].tolist()
            tokens, seen[i] = self.merge(texts[i], own if keys is None else chain(own, _skips(int(keys[i]), rate, own[-1], len(own))))
            found[i] = array("I", tokens).tobytes()
        rows = np.flatnonzero(~odd)
        rows = rows[np.argsort(sizes[rows], kind="stable")]
        for at in range(0, len(rows), MERGED_ROWS):
            own = rows[at : at + MERGED_ROWS]
            flat, counts, seen[own] = self._lockstep(symbols, begin[own], sizes[own], skips[own], None if keys is None else keys[own], rate)
            raw, ends = flat.tobytes(), (4 * np.cumsum(counts)).tolist()
            for i, a, b in zip(own.tolist(), [0, *ends], ends, strict=False):
                found[i] = raw[a:b]
        return found, seen

    def _lockstep(self, symbols: np.ndarray, begin: np.ndarray, sizes: np.ndarray, skips: np.ndarray, keys: np.ndarray | None, rate: float):
        """The ids of parts of pieces, one part's behind the other's, their numbers and the numbers of candidates.  A row is a
        part as a linked list; the column behind the last is its end on both sides."""
        n, end = len(sizes), int(sizes.max(initial=0))
        width, base = end + 1, len(self.rank)
        place = np.arange(width)
        sym = np.where(place < sizes[:, None], symbols[np.minimum(begin[:, None] + place, len(symbols) - 1)] if len(symbols) else -1, -1).astype(np.int64).ravel()
        right = np.where(place + 1 < sizes[:, None], place + 1, end).ravel()
        left = np.tile(np.where(place > 0, place - 1, end), n)
        ranks, made = np.full(n * width, self.none), np.zeros(n * width, np.int32)

        def look(at: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
            key = np.where((first >= 0) & (second >= 0), first * base + second, -1)
            found = np.searchsorted(self.pair_keys, key)
            ranks[at] = np.where(self.pair_keys[found] == key, self.pair_rank[found], self.none)
            made[at] = self.pair_made[found]

        row0 = np.arange(n) * width
        at = np.flatnonzero(sym >= 0)
        look(at, sym[at], sym[at // width * width + right[at]])
        seen, turn = np.zeros(n, np.int64), np.zeros(n, np.int64)
        known = skips.shape[1]
        skip = skips[:, 0].copy() if known else np.full(n, -1, np.int64)
        table, live = ranks.reshape(n, width), np.arange(n)
        while len(live):
            best = table[live].argmin(1)
            at = row0[live] + best
            going = ranks[at] < self.none
            live, at = live[going], at[going]
            skipped = seen[live] == skip[live]
            seen[live] += 1
            over = live[skipped]
            ranks[at[skipped]] = self.none
            turn[over] += 1
            more = turn[over] < known
            skip[over[more]] = skips[over[more], turn[over[more]]]
            later = over[~more]
            skip[later] = -1 if keys is None else skip[later] + 1 + _kept(keys[later], turn[later], rate)
            at, row = at[~skipped], row0[live[~skipped]]
            second = row + right[at]
            third = right[second]
            sym[at], sym[second], ranks[second] = made[at], -1, self.none
            right[at], left[row + third] = third, at - row
            look(at, sym[at], sym[row + third])
            before = row + left[at]
            look(before, sym[before], sym[at])
        kept = sym >= 0
        return sym[kept].astype(np.uint32), kept.reshape(n, width).sum(1), seen

    def _scan(self, symbols: list[str], skips: Iterator[int]) -> tuple[list[str], int]:
        """The agenda as a list of the current pairs' ranks: faster than a heap for a word."""
        get, none = self.rank_of.get, self.none
        ranks = [get(a + b, none) if a and b else none for a, b in zip(symbols, symbols[1:], strict=False)] if "" in symbols else list(map(get, map(add, symbols, symbols[1:]), repeat(none)))
        seen, skip = 0, next(skips, -1)
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            seen += 1
            if seen - 1 == skip:
                ranks[i], skip = none, next(skips, -1)
                continue
            symbols[i] = s = symbols[i] + symbols.pop(i + 1)
            ranks.pop(i)
            if i < len(ranks):
                b = symbols[i + 1]
                ranks[i] = get(s + b, none) if b else none
            if i:
                a = symbols[i - 1]
                ranks[i - 1] = get(a + s, none) if a else none
        return symbols, seen

    def _heap(self, symbols: list, skips: Iterator[int]) -> tuple[list[str], int]:
        ids, rank = self.ids, self.rank
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), n]
        agenda: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            a, b = symbols[i], symbols[j]
            if a and b and (merged := ids.get(a + b)) is not None:
                agenda.append((rank[merged], i, merged, len(a) + len(b)))

        for i in range(n - 1):
            offer(i, i + 1)
        heapq.heapify(agenda)
        seen, skip = 0, next(skips, -1)
        while agenda:
            _, i, merged, size = heapq.heappop(agenda)
            a = symbols[i]
            j = right[i]
            if a is None or j >= n or (b := symbols[j]) is None or len(a) + len(b) != size or ids.get(a + b) != merged:
                continue
            seen += 1
            if seen - 1 == skip:
                skip = next(skips, -1)
                continue
            symbols[i], symbols[j] = a + b, None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            known = len(agenda)
            if left[i] >= 0:
                offer(left[i], i)
            if right[i] < n:
                offer(i, right[i])
            new = agenda[known:]
            del agenda[known:]
            for item in new:
                heapq.heappush(agenda, item)
        return [x for x in symbols if x is not None], seen

    def decode(self, tokens) -> str:
        """The text: bytes of the pieces without the space put before it.  Inverse of encoding."""
        raw = b"".join(map(self.text.__getitem__, tokens))
        return raw[1:].decode("utf-8", "surrogatepass")


@functools.cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


class DropoutEncoder:
    def __init__(self, path: str, rate: float = RATE, seed: int = SEED):
        self.model, self.rate, self.seed = model(path), rate, seed
        self.known: dict[tuple[bytes, tuple[int, ...]], tuple[bytes, int]] = {}

    def _merged(self, part: bytes, skips: tuple[int, ...]) -> tuple[bytes, int]:
        """(ids, number of candidates) of a part, remembered."""
        found = self.known.get((part, skips))
        if found is None:
            tokens, seen = self.model.merge(part.decode("utf-8", "surrogatepass"), skips)
            found = array("I", tokens).tobytes(), seen
            if len(self.known) < CACHED_PARTS:
                self.known[part, skips] = found
        return found

    def _all_merged(self, wanted: list[tuple[bytes, tuple[int, ...]]], turn: int) -> list[tuple[bytes, int]]:
        """_merged of each, all with so many skips."""
        out = list(map(self.known.get, wanted))
        new = [i for i, known in enumerate(out) if known is None]
        skips = np.array([wanted[i][1] for i in new], np.int64).reshape(len(new), turn)
        for i, tokens, n in zip(new, *(x if isinstance(x, list) else x.tolist() for x in self.model.merge_all([wanted[i][0] for i in new], skips)), strict=True):
            out[i] = tokens, n
            if len(self.known) < CACHED_PARTS:
                self.known[wanted[i]] = out[i]
        return out

    def key(self, doc_id, text) -> int:
        return xxhash.xxh64_intdigest(text, xxhash.xxh64_intdigest(str(doc_id), self.seed))

    def encode(self, ids: list, column: pa.Array, copies: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids before each; one more entry).  An empty text has none.  Rows of one id, text and
        number of the copy get equal ids."""
        spaced = pc.binary_join_element_wise(*(pa.scalar(c, pa.large_string()) if isinstance(c, str) else c for c in ("", column.cast(pa.large_string()), " ")))  # a space before each text
        spaced = pc.if_else(pc.equal(pc.binary_length(column), 0), pa.scalar("", pa.large_string()), spaced)
        data, offsets = buffers(spaced)
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            cut[1:-1] = (data[1:] == 0x20) & (data[:-1] != 0x20)
            if self.model.stops_apart:
                cut[1:-1] |= LETTER[data[:-1]] & STOP[data[1:]]
        cut[offsets] = True
        starts = np.flatnonzero(cut)
        ends = starts if len(starts) and starts[-1] == len(data) else np.append(starts, len(data))
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = raw.dictionary_encode()
        first = np.searchsorted(ends, offsets)  # parts before each text
        distinct = coded.dictionary.to_pylist()
        node = coded.indices.to_numpy().astype(np.int64)  # the (part, skips) that each occurrence has come to
        if self.rate:
            found, node = self._dropped(ids, copies, data, offsets, ends, first, distinct, node)
        else:
            found = [self._merged(part, ())[0] for part in distinct]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        begin, own = np.cumsum(sizes) - sizes, sizes[node]
        total = np.concatenate([[0], np.cumsum(own)])
        take = np.arange(total[-1]) - np.repeat(total[:-1], own) + np.repeat(begin[node], own)
        return flat[take], total[first]

    def _dropped(self, ids: list, copies, data, offsets, ends, first, distinct: list[bytes], node: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """(ids of all (part, skips) that come up, which of them each occurrence has)."""
        keys = np.array([self.key(i, data[a:b]) for i, a, b in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)
        if copies is not None:
            keys = keys + np.asarray(copies).astype(np.uint64) * _COPY
        parts = np.diff(first)
        keys = mix(np.repeat(keys, parts) + (ends[:-1] - np.repeat(offsets[:-1], parts)).astype(np.uint64) * _STEP)
        where: list[tuple[bytes, tuple[int, ...]]] = []
        found: list[bytes] = []
        seen: list[int] = []
        parents: list[tuple[bytes, tuple[int, ...]]] = [(part, ()) for part in distinct]
        code, node = node, np.zeros(len(node), np.int64)
        active, skip, turn = np.arange(len(node)), _kept(keys, 0, self.rate), 0
        while len(active):
            # What one occurrence alone comes to is merged by all its skips at once, else by those so far.
            times = np.bincount(code, minlength=len(parents))
            fresh = np.fromiter((p not in self.known for p in parents), bool, len(parents))
            alone = ((times == 1) & fresh | np.fromiter((len(p) > LONG for p, _ in parents), bool, len(parents)))[code]
            own, at = active[alone], code[alone].tolist()
            skips = np.column_stack([np.array([parents[i][1] for i in at], np.int64).reshape(len(at), turn), skip[own]])
            tokens, counts = self.model.merge_all([parents[i][0] for i in at], skips, keys[own], self.rate)
            node[own] = len(found) + np.arange(len(own))
            where += [(parents[i][0], ()) for i in at]
            seen += [0] * len(own)
            found += tokens
            if len(self.known) < CACHED_PARTS:
                for i, j in zip(np.flatnonzero(counts <= skip[own]).tolist(), range(CACHED_PARTS - len(self.known)), strict=False):
                    if len(parents[at[i]][0]) <= LONG:
                        self.known[parents[at[i]]] = tokens[i], int(counts[i])
            active, code = active[~alone], code[~alone]
            wanted, at = np.unique(code, return_inverse=True)
            base = len(found)
            wanted = [parents[w] for w in wanted.tolist()]
            for part, (tokens, n) in zip(wanted, self._all_merged(wanted, turn), strict=True):
                where.append(part)
                found.append(tokens)
                seen.append(n)
            node[active] = base + at
            active = active[skip[active] < np.array(seen, np.int64)[node[active]]]
            width = max(seen, default=0) + 1
            wanted, code = np.unique(node[active] * width + skip[active], return_inverse=True)
            parents = [(where[w // width][0], (*where[w // width][1], w % width)) for w in wanted.tolist()]
            turn += 1
            skip[active] += 1 + _kept(keys[active], turn, self.rate)
        return found, node


def _inputs(docs: DataFrame, doc_id: str, text: str, copy: str | None) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.col(copy) if copy else F.lit(0)).cast("long").alias("copy"))


def encode_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", rate: float = RATE, seed: int = SEED, copy: str | None = None) -> DataFrame:
    """(doc_id, text, ids): ids as little-endian 32-bit integers.  A null text is empty and has none; rows of one id, text
    and copy (a column that numbers repeated rows; all 0 without it) give equal results.  Texts are encoded in batches of
    BATCH_BYTES, a longer one whole and alone; other columns are ignored, and an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = DropoutEncoder(path, rate, seed)
        for batch in pieces(batches, 1, BATCH_BYTES):
            tokens, at = own.encode(batch.column(0).to_pylist(), batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), binary_rows(tokens.astype("<u4"), np.diff(at))], ["doc_id", "text", "ids"])
        own = None
        give_back()

    kind = docs.schema[doc_id].dataType.simpleString()
    return _inputs(docs, doc_id, text, copy).mapInArrow(run, f"doc_id {kind}, text string, ids binary")


def decode_pieces(encoded: DataFrame, path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """The given rows with the text of their ids."""
    at, schema = encoded.columns.index(ids), T.StructType([*encoded.schema.fields, T.StructField(column, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            texts = [own.decode(np.frombuffer(i or b"", "<u4").tolist()) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, column])

    return encoded.mapInArrow(run, schema)


def piece_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", copy: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, lossless, ids): number and unsigned crc32 of a document's ids, whether they decode to its
    text, and the ids as little-endian 32-bit integers.  copy: as for encode_pieces.  Every row gives a row, ids null or
    repeated included; a null text is empty; texts are encoded in batches of BATCH_BYTES, a longer one whole and alone.
    Other columns are ignored, whatever their names; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = DropoutEncoder(path)
        for batch in pieces(batches, 1, BATCH_BYTES):  # encoded and decoded in one pass: the ids don't leave the worker
            tokens, at = own.encode(batch.column(0).to_pylist(), batch.column(1), batch.column(2))
            tokens, spans = tokens.astype("<u4"), list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            same = [own.model.decode(tokens[a:b].tolist()) == text for (a, b), text in zip(spans, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array([zlib.crc32(tokens[a:b]) for a, b in spans], pa.int64()), pa.array(same), binary_rows(tokens, np.diff(at))], ["doc_id", "n_pieces", "ids_crc32", "lossless", "ids"])
        own = None
        give_back()

    kind = docs.schema[doc_id].dataType.simpleString()
    return _inputs(docs, doc_id, text, copy).mapInArrow(run, f"doc_id {kind}, n_pieces long, ids_crc32 long, lossless boolean, ids binary")


def op7_pieces(spark, sf_dir, vocabulary: str = "piece_bpe_32k.model"):
    return piece_digests(table(spark, sf_dir, "documents"), vocabulary_path(vocabulary))
