"""The pipeline's stages, each against what it should do to its own input."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("plumbline.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_llm import SCHEMA, brute_components, brute_mcd, brute_words, make_docs, words  # noqa: E402

from plumbline.llm import mixing, pieces, quality  # noqa: E402
from plumbline.llm.token_files import vocabulary_path  # noqa: E402


def test_stages(spark):
    rows = make_docs(seed=8, n=90)
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r["doc_id"] for r in quality.quality(docs).where("kept").collect()}
    one = corpus_pipeline.quality_rules(spark, docs, "").cache()
    assert {r["doc_id"] for r in one.collect()} == kept and one.columns == docs.columns

    before = [tuple(r) for r in one.collect()]
    wanted = {i for i, (_, root) in brute_components(before).items() if i == root}
    two = corpus_pipeline.near_duplicates(spark, one, "").cache()
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(wanted) and two.columns == docs.columns

    before = [tuple(r) for r in two.collect()]
    want = {i: v for i, v in brute_words(before).items() if v[2] or not v[1]}
    three = corpus_pipeline.repeated_passages(spark, two, "").cache()
    got = {r["doc_id"]: r for r in three.collect()}
    texts = {r[0]: r[1] for r in before}
    assert set(got) == set(want) and three.columns == docs.columns
    for i, (_, gone, left) in want.items():
        assert got[i]["text"] == (left if gone else texts[i]) and got[i]["n_chars"] == len(got[i]["text"])

    four = corpus_pipeline.mixture(spark, three, "").cache()
    assert four.columns == docs.columns and {r["doc_id"] for r in four.collect()} <= set(got)
    five = corpus_pipeline.token_ids(spark, four, "")
    assert five.count() == four.count() and five.where("not lossless").count() == 0


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame(make_docs(seed=9, n=40) + make_docs(seed=9, n=40)[:10], SCHEMA)
    two = corpus_pipeline.near_duplicates(spark, docs, "")
    assert two.groupBy("doc_id").count().where("count > 1").count() == 0
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, "").cache()
        assert none.count() == 0


def brute_quality(spark, rows):
    """Ids that the quality rules keep: base statistics in plain Python are tested elsewhere, the distances here by numpy."""
    made = {r["doc_id"]: r for r in quality.statistics(spark.createDataFrame(rows, SCHEMA)).collect()}
    fit = [r for r in made.values() if not (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])]
    raw = [(np.log2(1 + r["n_words"]), np.log2((1 + r["word_chars"]) / (1 + r["n_words"])), np.sqrt(r["n_symbols"] / (1 + r["word_chars"])), np.sqrt(r["n_dup_lines"] / (1 + r["n_words"])), np.sqrt(r["n_repeat_words"] / (1 + r["n_words"]))) for r in fit]
    away = brute_mcd(np.floor(np.array(raw) * 1024 + 0.5), [(r["lang"], r["source"]) for r in fit])
    return {r["doc_id"] for r, d in zip(fit, away) if d <= quality.CUTOFF}


def brute_mix(rows):
    """(id, times) of what is taken of rows (id, source, size)."""
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s))
    sizes = [sum(n for _, s, n in rows if s == name) for name in names]
    out = {}
    for name, size, target in zip(names, sizes, mixing.targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(names))], sum(sizes), 3)):
        full, rest = divmod(int(target), size) if size else (0, 0)
        at = 0
        for i, _, n in sorted((r for r in rows if r[1] == name), key=lambda r: hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest()):
            out[i] = (full + (2 * at + n <= 2 * rest)) if n else 0
            at += n
    return out


def brute_ids(own, doc_id, text, copy):
    """Ids of a text, each part merged anew from the draws of its own place."""
    raw, out, place = (" " + text).encode() if text else b"", [], 0
    key = np.array([own.key(doc_id, np.frombuffer(raw, np.uint8))], np.uint64) + np.array([copy], np.uint64) * pieces._COPY
    for i in range(1, len(raw) + 1):
        if i == len(raw) or (raw[i] == 32 and raw[i - 1] != 32) or (own.model.stops_apart and chr(raw[i]) in ".,;:!?" and chr(raw[i - 1]).isascii() and chr(raw[i - 1]).isalpha()):
            k = int(pieces.mix(key + np.array([place], np.uint64) * pieces._STEP)[0])
            out += own.model.merge(raw[place:i].decode(), pieces._skips(k, pieces.RATE))[0]
            place = i
    return np.array(out, "<u4").tobytes()


def test_run(spark, tmp_path):
    rows = make_docs(seed=21, n=120)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_pieces", "ids_crc32", "lossless", "ids"]
    kept = brute_quality(spark, rows)
    left = [r for r in rows if r[0] in kept]
    roots = {i for i, (_, root) in brute_components(left).items() if i == root}
    left = [r for r in left if r[0] in roots]
    passages = brute_words(left)
    left = [(i, passages[i][2] if passages[i][1] else t, lang, source) for i, t, lang, source, _ in left if passages[i][2] or not passages[i][1]]
    times = brute_mix([(i, source, len(words(t))) for i, t, _, source in left])
    own = pieces.DropoutEncoder(vocabulary_path("piece_bpe_32k.model"))
    want = sorted((i, brute_ids(own, i, t, k)) for i, t, _, _ in left for k in range(1, times[i] + 1))
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in got.collect()) == want and len(want) > 20
    assert got.where("not lossless").count() == 0


def test_copies_draw_their_own_dropout(spark):
    docs = spark.createDataFrame([(1, "international segmentation of words " * 20)] * 3 + [(2, "")] * 2, "doc_id long, text string")
    got = corpus_pipeline.token_ids(spark, docs, "").collect()
    assert len({r["ids_crc32"] for r in got if r["doc_id"] == 1}) == 3 and len(got) == 5 and all(r["lossless"] for r in got)
    again = corpus_pipeline.token_ids(spark, docs.repartition(3), "").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_near_duplicates_without_or_with_shared_ids(spark):
    text = lambda word: " ".join(f"{word}{i}" for i in range(60))
    near = lambda word: text(word) + " more"
    rows = [(1, text("a")), (None, near("a")), (None, text("clean")), (2, text("b")), (3, near("b")), (3, text("other")), (None, text("c")), (None, near("c")), (4, text("d")), (4, text("d")), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    rest = [r for r in got if r not in ((None, text("c")), (None, near("c")))]
    assert sorted(rest, key=str) == sorted([(1, text("a")), (None, text("clean")), (2, text("b")), (3, text("other")), (4, text("d")), (None, None)], key=str)
    assert len(got) == len(rest) + 1


def test_stages_shuffle_only_rows_that_may_go(spark, monkeypatch):
    """Where too many rows go to broadcast them, the others' texts are not shuffled, and the stages give the same."""
    from plumbline.llm import common

    rows = [(i if i % 9 else None, f"text {i % 400} of number {i}", i) for i in range(2000)] + [(7, "text 7 of number 7", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _p int")
    gone = docs.where("doc_id % 40 = 0 or (doc_id is null and _p % 90 = 0)").withColumn("_hash", corpus_pipeline._hash())
    gone = common.Workspace(spark, "t").write(gone.select("doc_id", "_hash"), "gone")
    want, pairs = sorted(map(str, corpus_pipeline._without(docs, gone).collect())), sorted(map(str, corpus_pipeline.near_duplicates(spark, docs, "").collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    made = corpus_pipeline._without(docs, gone)
    assert sorted(map(str, made.collect())) == want and len(want) < len(rows)
    assert sorted(map(str, corpus_pipeline.near_duplicates(spark, docs, "").collect())) == pairs
    seen = []
    kind = type(docs)
    monkeypatch.setattr(kind, "join", lambda self, other, on=None, how=None, f=kind.join: (how == "left_anti" and seen.append(self.count())) or f(self, other, on, how))
    corpus_pipeline._without(docs, gone)
    assert seen and max(seen) < len(rows) / 2
