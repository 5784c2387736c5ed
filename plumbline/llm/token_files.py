"""Token ids in bit-packed files.

A file is a Parquet part whose rows are blocks.  Parts and their blocks are in ascending doc_id order.  A block holds
whole documents, at least BLOCK_TOKENS ids (the last may hold fewer):

    shard       number of the part
    first       ids in the part before the block
    width       bits of an id: the fewest that hold the vocabulary
    ids         doc_id of each document in it
    ends        ids in the block up to the end of each document
    least, most smallest and largest doc_id, for pruning a lookup
    payload     the ids, width bits each, most significant bit first

Id i of a block stands in bits width * i and following, so any document is read without those before it.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, partitions, table
from .textkit import buffers, pieces

BLOCK_TOKENS = 1 << 16
#: Pieces of text whose ids a worker remembers, about 200 bytes each.
CACHED_PIECES = 1 << 20
#: Letters below are letters to every Unicode version.
LATIN_END = "\u0250"
SCHEMA = "shard int, first long, width int, ids array<long>, ends array<long>, least long, most long, payload binary"
_KINDS = pa.schema([("shard", pa.int32()), ("first", pa.int64()), ("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("least", pa.int64()), ("most", pa.int64()), ("payload", pa.binary())])


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((ids.astype(np.uint32)[:, None] >> shifts) & 1).astype(np.uint8).ravel()).tobytes()


def unpack(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids start, ..., stop - 1 of a block."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f">u{width // 8}", stop - start, start * width // 8).astype(np.uint32)
    lo, hi = start * width // 8, -(-stop * width // 8)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, hi - lo, lo))[start * width - lo * 8 :][: (stop - start) * width]
    out = np.zeros(stop - start, np.uint32)
    for k in range(width):
        out = (out << np.uint32(1)) | bits[k::width]
    return out


@functools.cache
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_SPLIT_NEXT = np.zeros(256, bool)
_SPLIT_NEXT[[*range(0x21, 0x7F), *range(0xC3, 0xE0)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".,;:!?"]] = True


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order."""
    own = {b for lo, hi in ((33, 127), (161, 173), (174, 256)) for b in range(lo, hi)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


_BYTE_CHARS = _byte_chars()


class PieceEncoder:
    """Encodes batches of texts by their distinct pieces.

    The byte-level pattern never joins a space that something visible follows with what stands before it, nor a letter
    with a following stop; so a text can be cut there and its pieces encoded on their own.  Each distinct piece of a batch
    is encoded once, and the most frequent are remembered for later batches.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known = _tokenizer(path), {}

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Ascending byte places at which pieces start; those of texts are among them."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            cut[:-2] = (data[:-1] == 0x20) & _SPLIT_NEXT[data[1:]]
            cut[1:-1] |= LETTER[data[:-1]] & STOP[data[1:]]
        cut[offsets] = True
        return np.flatnonzero(cut)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids before each text; one more entry)."""
        data, offsets = buffers(column)
        starts = self.pieces(data, offsets)
        if len(starts) and starts[-1] == len(data):
            ends = starts
        else:
            ends = np.append(starts, len(data))
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = raw.dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        found = [self.known.get(p) for p in distinct]
        new = [i for i, f in enumerate(found) if f is None]
        model, other = self.tokenizer.model, []
        for i in new:
            p = distinct[i]
            # Letters, with a space before them or not, are one unit of the pattern: the model takes them as they are.
            word = p.decode().removeprefix(" ")
            if word.isalpha() and max(word) < LATIN_END:
                found[i] = array("I", [t.id for t in model.tokenize(p.decode("latin-1").translate(_BYTE_CHARS))]).tobytes()
            else:
                other.append(i)
        for lo in range(0, len(other), 10_000):
            part = other[lo : lo + 10_000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([distinct[i].decode() for i in part], add_special_tokens=False), strict=True):
                found[i] = array("I", e.ids).tobytes()
        for i in new[: CACHED_PIECES - len(self.known)]:
            self.known[distinct[i]] = found[i]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        begin = np.cumsum(sizes) - sizes
        own = sizes[code]
        total = np.concatenate([[0], np.cumsum(own)])
        take = np.arange(total[-1]) - np.repeat(total[:-1], own) + np.repeat(begin[code], own)
        return flat[take], total[np.searchsorted(ends, offsets)]


def write_tokens(docs: DataFrame, work: Workspace, encoder: Callable[[], PieceEncoder], vocabulary: int, end_id: int, doc_id: str = "doc_id", text: str = "text", name: str = "tokens") -> DataFrame:
    """Encodes the texts, each followed by end_id, and writes them as ``name``; returns the written table of blocks.

    A null text is empty, so it gives only the end id.  Documents without id come first; those of one id, repeated rows
    included, are in the order of a hash of their text.  A text is encoded whole, however long, and its ids are one block
    with what was gathered before it.  Other columns are ignored, whatever their names; an empty table gives no blocks.
    """
    from pyspark import TaskContext

    width = width_of(vocabulary)
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, first = encoder(), TaskContext.get().partitionId(), 0
        held, ids, ends = [], [], []

        def block():
            nonlocal first
            tokens = np.concatenate(held)
            real = [i for i in ids if i is not None]
            row = [[shard], [first], [width], [list(ids)], [list(ends)], [min(real, default=None)], [max(real, default=None)], [pack(tokens, width)]]
            first += len(tokens)
            held.clear(), ids.clear(), ends.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _KINDS.types, strict=True)], schema=_KINDS)

        for batch in pieces(batches, 1, 8 << 20):
            tokens, at = own.encode(batch.column(1))
            for i, (doc, a, b) in enumerate(zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)):
                held.append(np.append(tokens[a:b], np.uint32(end_id)))
                ids.append(doc)
                ends.append((ends[-1] if ends else 0) + b - a + 1)
                if ends[-1] >= BLOCK_TOKENS:
                    yield block()
        if ids:
            yield block()

    return work.write(ordered.mapInArrow(run, SCHEMA), name)


def read_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the blocks: ids of all documents before it, its own, and
    the unsigned crc32 of its ids as little-endian 32-bit integers.  Every written row gives a row, ids null or repeated
    included; a table without blocks gives none."""
    spark: SparkSession = blocks.sparkSession
    sizes = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum(F.element_at("ends", -1)).alias("n")).collect()}  # a row for each file
    base, rows = 0, []
    for shard in sorted(sizes):
        rows.append((shard, base))
        base += sizes[shard]
    bases = F.broadcast(spark.createDataFrame(rows, "shard int, base long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, width, ids, ends, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = unpack(payload, width, 0, ends[-1]).astype("<u4")
                starts = [0, *ends[:-1]]
                crc = [zlib.crc32(tokens[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array([first + a for a in starts], pa.int64()), pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()), pa.array(crc, pa.int64())], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = blocks.select("shard", "first", "width", "ids", "ends", "payload").mapInArrow(run, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(bases, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(blocks: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, tokens) of some documents; only blocks whose range holds one of the ids are read.  An id that several rows
    have gives a row for each, an unknown one none; null can't be asked for."""
    near = functools.reduce(lambda a, b: a | b, [(F.col("least") <= i) & (F.col("most") >= i) for i in doc_ids], F.lit(False))
    wanted = set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, ids, ends, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = [(d, unpack(payload, width, a, b).tolist()) for d, a, b in zip(ids, [0, *ends[:-1]], ends, strict=True) if d in wanted]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int64()), pa.array([t for _, t in out], pa.list_(pa.int64()))], ["doc_id", "tokens"])

    return blocks.where(near).select("width", "ids", "ends", "payload").mapInArrow(run, "doc_id long, tokens array<long>")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_files(spark, sf_dir, vocabulary: str = "byte_bpe_50k.json"):
    path = vocabulary_path(vocabulary)
    size = _tokenizer(path).get_vocab_size()
    work = Workspace(spark, "tokens")
    return read_documents(write_tokens(table(spark, sf_dir, "documents"), work, lambda: PieceEncoder(path), size, 0))
