"""The operators for training data: against brute force, exact round trips, and on odd tables."""

import hashlib
import pathlib
import random
import textwrap
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("plumbline.llm")
from pyspark.sql import functions as F  # noqa: E402

from plumbline.llm import chat, fingerprints, jaccard, licences, mixing, pieces, quality, registry, substring, suffix_dedup, suffixes, token_files  # noqa: E402
from plumbline.llm.automaton import SuffixAutomaton, spans  # noqa: E402
from plumbline.llm.common import Workspace, components  # noqa: E402
from plumbline.llm import repeats  # noqa: E402
from plumbline.llm.repeats import sliding_min, union  # noqa: E402
from plumbline.llm.textkit import shingle_sets  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
BPE, SP = token_files.vocabulary_path("byte_bpe_50k.json"), token_files.vocabulary_path("piece_bpe_32k.model")


def words(text):
    out, now = [], ""
    for c in text or "":
        if c in SPACES:
            if now:
                out.append(now)
            now = ""
        else:
            now += c
    return [*out, now] if now else out


def make_docs(seed=1, n=60):
    """Small vocabulary, copies, near copies, shared passages, a very long text, odd texts, a null, a shared id."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "straße", "ﬁ", "#", "▁x", "日本"]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not texts:
            t = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 120)))
        elif kind == 1:
            t = rng.choice(texts) or ""
        elif kind == 2:
            w = words(rng.choice(texts)) or ["a"]
            w[rng.randrange(len(w))] = "edit"
            t = "  ".join(w)
        elif kind == 3:
            t = " ".join(rng.choice(vocabulary) for _ in range(20)) + "\n" + " ".join(passage[: rng.randrange(5, 30)]) + "\nw1"
        elif kind == 4:
            t = "\n".join(["same line here"] * rng.randrange(1, 6)) + " ".join(passage)
        else:
            t = " ".join(passage * 2)
        texts.append(t)
    texts += ["", " \n\t", "one", "a b c d", " ".join(f"x{i % 700}" for i in range(6000)), "a" * 400, "a" * 300, None, "ab c " * 30, "no break space here"]
    ids = list(range(0, 2 * len(texts), 2))
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 5}" if i % 7 else None, len(t or "")) for i, t in zip(ids, texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard(docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute_components(rows)


def test_jaccard_odd(spark, empty):
    assert jaccard.jaccard_components(empty).count() == 0
    long = " ".join(f"t{i}" for i in range(50))
    odd = spark.createDataFrame([(None, long, "k"), (5, long, "k"), (5, long, "k"), (5, "other words here", "k"), (3, None, "k"), (4, "", "k")], "doc_id long, text string, key string").withColumn("n", F.lit(1)).withColumn("cid", F.lit("x"))
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.jaccard_components(odd).collect())
    assert got == sorted([("None", 46, "5"), ("5", 46, "5"), ("5", 46, "5"), ("5", 1, "5"), ("3", 0, "3"), ("4", 0, "4")])


def test_jaccard_keeps_only_what_it_still_reads(spark, docs, rows, monkeypatch):
    """Without a broadcast, as on larger tables; work tables go once they are used up."""
    from plumbline.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "_ROOTS", {})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    (root,) = common._ROOTS
    left = {p.name for p in pathlib.Path(root).iterdir()}
    assert got == brute_components(rows) and {"members", "known"} <= left
    assert not left & {"signatures", "classes", "classes-bits", "tiles", "open", "open0"}


def test_sifted(spark, monkeypatch):
    from plumbline.llm import common

    docs = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    known = docs.where("doc_id is null or doc_id % 20 = 0").select(F.col("doc_id").alias("_id"))
    assert common.sifted(docs, [F.col("doc_id")], known, ["_id"], 16)[1] is None
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    may, apart, _ = common.sifted(docs, [F.col("doc_id")], known, ["_id"], 16)
    got, rest = [r["doc_id"] for r in may.collect()], [r["doc_id"] for r in apart.collect()]
    assert may.columns == apart.columns == docs.columns and sorted(map(str, got + rest)) == sorted(map(str, [None, *range(1, 20_000)]))
    assert {r["_id"] for r in known.collect()} <= set(got) and len(got) < 4000


def test_bitmap_bounds_the_overlap():
    rng = np.random.default_rng(3)
    for n, m in ((5, 7), (100, 120), (700, 90)):
        a = np.unique(rng.integers(0, 2**62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**62, m, dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        assert common <= jaccard.overlap_bound(jaccard.bitmap(a), jaccard.bitmap(b), len(a), len(b)) <= min(len(a), len(b))


def test_shingle_hashes_agree_with_sets(rows):
    texts = [r[1] for r in rows]
    assert [len(s) for s in shingle_sets(pa.array(texts, pa.string()))] == [len(shingles(t)) for t in texts]


@pytest.mark.parametrize("chunk", [0, 40])
def test_components_of_a_long_chain(spark, chunk):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long").repartition(4)
    got = {r["node"]: r["root"] for r in components(edges, Workspace(spark, "t"), "c", chunk).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def brute_words(rows, n=13):
    low = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - n + 1):
            low.setdefault(tuple(w[k : k + n]), i)
    out = {}
    for i, t, *_ in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - n + 1) if low[tuple(w[k : k + n])] < i for j in range(n)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def brute_bytes(rows, n=50):
    low = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            low.setdefault(b[k : k + n], i)
    out = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if low[b[k : k + n]] < i:
                gone[k : k + n] = b"\1" * n
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1])), bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("hot", [1 << 20, 300])
def test_substring(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_BYTES", hot)  # anchors with more are taken apart by window
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.substring_dedup(docs).collect()}
    assert got == brute_words(rows)


@pytest.mark.parametrize("salted", [False, True])
def test_hot_windows_without_a_broadcast(docs, rows, salted, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_BYTES", 0)  # no anchor has a shard
    if salted:
        monkeypatch.setattr(repeats, "BROADCAST_BYTES", 0)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.substring_dedup(docs).collect()}
    assert got == brute_words(rows)


@pytest.mark.parametrize("often", [1, 6])
def test_anchors_that_come_often_skip_a_level(docs, rows, often, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_ROWS", often)
    monkeypatch.setattr(repeats, "BUCKETS", 1 << 10)
    plain = repeats._anchors

    def local(kind, length, grams):
        inner = plain(kind, length, grams)

        def run(batches):
            import plumbline.llm.repeats as r

            r.LOCAL, r.BUCKETS = 1, 1 << 10
            yield from inner(batches)

        return run

    monkeypatch.setattr(repeats, "_anchors", local)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.substring_dedup(docs).collect()} == brute_words(rows)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(docs).collect()} == brute_bytes(rows)


@pytest.mark.parametrize("hot", [1 << 20, 2000, 0])
@pytest.mark.parametrize("small", [False, True])
def test_suffix(docs, rows, small, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_BYTES", hot)
    if small:  # anchors are spread over several shards and merged by binary search
        class Small(suffix_dedup.ByteSolver):
            def __init__(self, length=50):
                import plumbline.llm.repeats as r

                r.SHARD_BYTES = 2000
                super().__init__(length)

        monkeypatch.setattr(suffix_dedup, "ByteSolver", Small)
        monkeypatch.setattr(repeats, "SHARD_BYTES", 2000)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == brute_bytes(rows)


def test_dedup_odd(spark, empty):
    assert substring.substring_dedup(empty).count() == 0 and suffix_dedup.suffix_dedup(empty).count() == 0
    long = " ".join(f"t{i}" for i in range(20))
    odd = spark.createDataFrame([(None, long, 1), (5, long, 1), (5, "x " + long, 1), (5, long, 1), (9, long + " y", 1), (9, long, 1), (3, None, 1)], "doc_id long, text string, id int").withColumns({"seq": F.lit(1), "rest": F.lit("x")})
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["rest"]["rest"]) for r in substring.substring_dedup(odd).collect())
    assert got == Counter({(None, 20, 0, "x"): 1, (5, 20, 0, "x"): 2, (5, 21, 0, "x"): 1, (9, 21, 20, "x"): 1, (9, 20, 20, "x"): 1, (3, 0, 0, "x"): 1})


def test_solvers_over_several_shards():
    """One anchor whose stretches come in three calls."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(6)}" for _ in range(40)]
    parts, ids = [], []
    for i in range(30):
        a = rng.randrange(15)
        parts.append(" ".join(base[a : a + 22]).encode())
        ids.append(i)
    rows = [(i, p.decode()) for i, p in zip(ids, parts)]
    for solver, want in ((substring.WordSolver(13), {i: v[1] for i, v in brute_words(rows).items()}), (suffix_dedup.ByteSolver(50), {i: v[1] for i, v in brute_bytes(rows).items()})):
        got, seen = {}, set()
        for lo in range(0, 30, 10):
            own = [(i, p) for i, p in zip(ids[lo : lo + 10], parts[lo : lo + 10]) if p not in seen and not seen.add(p)]
            res = solver.solve(np.full(len(own), 7), np.array([i for i, _ in own]), [p for _, p in own], lo > 0)
            got |= {i: sum(b - a for a, b in union(s)) for (i, _), s in zip(own, res)}
        assert got == {i: want[i] for i in got}


def test_automaton():
    rng = random.Random(2)
    texts = [[rng.choice("abc") for _ in range(rng.randrange(1, 25))] for _ in range(20)]
    a = SuffixAutomaton()
    for t in texts:
        a.add(t)
    runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(50):
        q = [rng.choice("abcd") for _ in range(20)]
        want = [next((n for n in range(i + 1, 0, -1) if tuple(q[i - n + 1 : i + 1]) in runs), 0) for i in range(20)]
        assert a.statistics(q) == want
    assert spans([0, 1, 2, 3, 0, 3], 2) == [(1, 6)] or spans([0, 1, 2, 3, 0, 3], 2)


def test_automaton_dedup(spark):
    ref = spark.createDataFrame([(" ".join(f"t{i}" for i in range(30)),), (None,)], "text string")
    docs = spark.createDataFrame([(1, "a b " + " ".join(f"t{i}" for i in range(5, 25)) + " c"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: [(m["a"], m["b"]) for m in r["matched"]] for r in substring.automaton_dedup(docs, ref).collect()}
    assert got == {1: [(2, 22)], 2: []}


@pytest.mark.parametrize("data", [b"", b"a", b"banana", b"\0\0\0\0\0\0\0\0\0\0\0", b"abababababababababababab" * 5, bytes(random.Random(1).choices(b"ab\0", k=400))])
def test_suffix_array(data):
    order = suffixes.suffix_array(np.frombuffer(data, np.uint8))
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    if data:
        lcp = suffixes.kasai(data, order)
        packed = suffixes.packed(np.frombuffer(data, np.uint8))
        for n in (8, 10, 16):
            ok = [k for k in range(1, len(data)) if order[k] + n <= len(data) and order[k - 1] + n <= len(data)]
            a, b = order[ok], order[[k - 1 for k in ok]]
            assert suffixes.common_at_least(packed, a, b, n).tolist() == [bool(lcp[k] >= n) for k in ok]


def test_sliding_min():
    x = np.array(random.Random(1).sample(range(100), 40), dtype=np.uint64)
    for w in (1, 2, 5, 10, 35):
        assert sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(len(x) - w + 1)]


def test_quality_base(docs, rows):
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        t = t or ""
        w = words(t)
        grams = defaultdict(list)
        for k in range(len(w) - 7):
            grams[tuple(w[k : k + 8])].append(k)
        again = {k + j for at in grams.values() if len(at) > 1 for k in at for j in range(8)}
        lines = [x for x in t.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        r = got[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, i
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_rejects_outliers_and_keeps_the_rest(spark, empty):
    rng = random.Random(4)
    clean = [(i, " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota").strip() + str(rng.randrange(500)) for _ in range(rng.randrange(80, 400))), "en", "s") for i in range(200)]
    junk = [(1000 + i, "# $ % & | < > * " * 20 + " ".join(f"v{j}" for j in range(300)), "en", "s") for i in range(20)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.quality(df).collect()}
    assert not any(got[1000 + i] for i in range(20)) and sum(got[i] for i in range(200)) >= 198
    assert quality.quality(empty).count() == 0


def brute_mcd(z, keys):
    """Distances by numpy: z (documents x 5), keys (documents) of (language, source)."""
    floors = np.diag([(f * 1024) ** 2 for _, f in quality.FEATURES])

    def estimate(x):
        m = np.median(x, axis=0)
        a = np.maximum(1.4826 * np.median(abs(x - m), axis=0), np.sqrt(np.diag(floors)))
        y = (x - m) / a
        r = np.sqrt((y**2).sum(axis=1, keepdims=True))
        t = np.floor(1024 * y / (1 + abs(y)) + 0.5)
        u = np.floor(1024 * np.divide(y, r, out=np.zeros_like(y), where=r > 0) + 0.5)
        best = None
        for form in (None, np.cov(t.T, bias=True), u.T @ u / len(u)):
            c = np.diag(a**2)
            if form is not None:
                d = np.sqrt(np.diag(form))
                ok = np.outer(d > 0, d > 0) & ~np.eye(5, dtype=bool)
                c = c + np.where(ok, 0.99 * form / np.where(ok, np.outer(d, d), 1) * np.outer(a, a), 0)
            centre, least = m, np.inf
            while True:
                away = np.floor(32 * np.sqrt(np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(c), x - centre)))
                near = x[away <= np.sort(away)[int(np.ceil(0.75 * len(x))) - 1]]
                m2, c2 = near.mean(axis=0), 1.4121 * np.cov(near.T, bias=True) + floors
                if np.sqrt(np.linalg.det(c2)) >= least * (1 - 1e-12):
                    break
                centre, c, least = m2, c2, np.sqrt(np.linalg.det(c2))
            if best is None or least < best[0] * (1 - 1e-12):
                best = (least, centre, c)
        return len(x), best[1], best[2]

    drawn = lambda own, up: tuple((own[0] * a + 50 * b) / (own[0] + 50) for a, b in zip(own[1:], up))
    everything, out = estimate(z)[1:], np.zeros(len(z))
    for lang in {k[0] for k in keys}:
        of_lang = np.array([k[0] == lang for k in keys])
        up = drawn(estimate(z[of_lang]), everything)
        for key in {k for k in keys if k[0] == lang}:
            mine = np.array([k == key for k in keys])
            m, c = drawn(estimate(z[mine]), up)
            out[mine] = np.einsum("ij,jk,ik->i", z[mine] - m, np.linalg.inv(c), z[mine] - m)
    return out


def test_quality_distances_against_numpy(spark):
    rng = random.Random(11)
    rows = []
    for i in range(420):
        source = rng.choice(["a", "a", "a", "b", "b", None])
        lang = rng.choice(["en", "en", "de", None]) if i else "rare"
        n = int(2 ** rng.gauss(7 if source == "a" else 6, 0.7)) + 20
        text = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9 if lang == "en" else 14) + (rng.choice("#$%") if rng.random() < (0.9 if i % 29 == 5 else 0.02) else "") * (i % 29 == 5 and 9 or 1) + str(j % 90) for j in range(n))
        rows.append((i, text + "\nsame\nsame" * (i % 4 == 0), lang, source))
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("not base_failed").collect()
    at = {r[0]: (r[2], r[3]) for r in rows}
    raw = [(np.log2(1 + r["n_words"]), np.log2((1 + r["word_chars"]) / (1 + r["n_words"])), np.sqrt(r["n_symbols"] / (1 + r["word_chars"])), np.sqrt(r["n_dup_lines"] / (1 + r["n_words"])), np.sqrt(r["n_repeat_words"] / (1 + r["n_words"]))) for r in got]
    want = brute_mcd(np.floor(np.array(raw) * 1024 + 0.5), [at[r["doc_id"]] for r in got])
    assert len(got) > 300 and np.allclose([r["distance"] for r in got], want, rtol=1e-6)
    assert [r["kept"] for r in got] == (want <= quality.CUTOFF).tolist() and 0 < sum(not r["kept"] for r in got) < 100


def test_mixing(spark, docs, rows, empty):
    sized = docs.withColumns({"sources": F.array("source"), "size": F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))})
    taken, plan = mixing.mix(sized, "doc_id", "size", "sources")
    got = taken.collect()
    assert len(got) == len(rows)
    by = defaultdict(int)
    for r in got:
        assert r["taken"] == r["repeats"] * r["size"] <= 3 * r["size"]
        by[r["source"]] += r["taken"]
    largest = max(r["size"] for r in got)
    for p in plan.collect():
        assert abs(p["target"] - by[p["source"]]) <= largest / 2 + 1
    assert sorted((r["doc_id"], r["repeats"]) for r in mixing.mix(sized.repartition(5), "doc_id", "size", "sources")[0].collect()) == sorted((r["doc_id"], r["repeats"]) for r in got)
    none = empty.withColumns({"sources": F.array("source"), "size": F.lit(1)})
    assert mixing.mix(none, "doc_id", "size", "sources")[0].count() == 0
    odd = sized.select("doc_id", "size", F.array(F.concat("source", F.lit("\x1f"), "lang")).alias("sources"), F.lit(7).alias("_size"), F.lit("p").alias("_pattern"), F.lit(9).alias("_bucket"), F.lit(1).alias("taken"))
    got, plan = mixing.mix(odd, "doc_id", "size", "sources")
    assert all((r["_size"], r["_pattern"], r["_bucket"]) == (7, "p", 9) for r in got.collect()) and got.columns.count("taken") == 1
    assert "s1\x1fen" in {r["source"] for r in plan.collect()}
    lost = sized.select(F.lit(None).cast("long").alias("doc_id"), "size", "sources", "text")
    got = mixing.mix(lost, "doc_id", "size", "sources")[0]
    assert got.select("repeats").distinct().count() > 1 and got.exceptAll(mixing.mix(lost.repartition(7), "doc_id", "size", "sources")[0]).count() == 0


def test_mixing_refuses_too_many_patterns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 3)
    df = spark.range(8).select(F.col("id").alias("doc_id"), F.lit(1).alias("size"), F.array(F.col("id").cast("string")).alias("sources"))
    with pytest.raises(ValueError):
        mixing.mix(df, "doc_id", "size", "sources")


def test_mixing_overlapping_sources(spark):
    rows = [(i, 10, ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["a", "b"]) for i in range(90)] + [(90, 10, None), (91, None, ["a"]), (92, 10, [])]
    df = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>")
    taken, plan = mixing.mix(df, "doc_id", "size", "sources", weights=(1.0, 4.0))
    words_of = Counter()
    for r in taken.collect():
        assert len(r["takers"]) == r["repeats"] <= 3
        for s in r["takers"]:
            words_of[s] += r["size"]
    for p in plan.collect():
        assert abs(words_of[p["source"]] - p["target"]) <= 20, p


def test_targets():
    assert mixing.targets([10, 100, 100], [5, 2, 1], 210, 3) == [30, 120, 60]
    assert sum(mixing.targets([1, 1], [1, 1], 10, 3)) == 6
    flow = mixing.min_cost_flow([10, 10], [[0], [0, 1]], [15, 5], 3)
    assert sum(f.get(0, 0) for f in flow) == 15 and sum(f.get(1, 0) for f in flow) == 5


@pytest.mark.parametrize("tree", [1024, 1])
def test_fingerprints(docs, rows, spark, empty, tree, monkeypatch):
    monkeypatch.setattr(fingerprints, "TREE_CUTS", tree)
    order = sorted(rows, key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + nxt[:n]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["near_edited"] == 1) == (fingerprints.canonical(t) == fingerprints.canonical(edited))
        assert (r["near_next"] == 1) == (fingerprints.canonical(t) == fingerprints.canonical(nxt))
        assert r["fingerprint"] == fingerprints.digest(fingerprints.canonical(t))
    assert fingerprints.edited_fingerprints(empty).count() == 0
    one = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert fingerprints.edited_fingerprints(one).first()["near_next"] == 1
    odd = spark.createDataFrame([(None, "x"), (None, None), (1, "a"), (1, "a"), (1, "b")], "doc_id long, text string").withColumn("bucket", F.lit(3))
    assert fingerprints.edited_fingerprints(odd).count() == 5


def test_canonical():
    assert fingerprints.canonical("  Straße ﬁ\n") == fingerprints.canonical("STRASSE  FI") == b"strasse fi"
    assert fingerprints.canonical("é") == fingerprints.canonical(unicodedata.normalize("NFD", "É")) and fingerprints.canonical(None) == b""


def test_exact_classes(docs, rows, spark, monkeypatch):
    want = {}
    for i, t, *_ in sorted(rows):
        want.setdefault(fingerprints.canonical(t), i)
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.exact_classes(docs).collect()}
    assert got == {i: want[fingerprints.canonical(t)] for i, t, *_ in rows}
    both = fingerprints.fingerprints(docs.select("doc_id", "text", F.lit("x").alias("fingerprint")))
    assert both.columns.count("fingerprint") == 1 and both.where("fingerprint = 'x'").count() == 0


def test_token_files(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    blocks = token_files.write_tokens(docs, Workspace(spark, "t"), lambda: token_files.PieceEncoder(BPE), 50257, 0)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_documents(blocks).collect()}
    at = 0
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes())), i
        at += len(ids)
    one = token_files.lookup(blocks, [rows[0][0]]).first()
    assert one["tokens"] == [*library.encode(rows[0][1] or "", add_special_tokens=False).ids, 0]
    none = token_files.write_tokens(empty, Workspace(spark, "t"), lambda: token_files.PieceEncoder(BPE), 50257, 0)
    assert token_files.read_documents(none).count() == 0


@pytest.mark.parametrize("width", [1, 7, 8, 13, 16, 17, 31, 32])
def test_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 500).astype(np.uint32)
    packed = token_files.pack(ids, width)
    assert len(packed) == -(-500 * width // 8)
    assert (token_files.unpack(packed, width, 0, 500) == ids).all() and (token_files.unpack(packed, width, 33, 401) == ids[33:401]).all()


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(list("ab .,'!?\n\t1é 　s日-<|>▁  ")) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


def test_pieces_of_text_encode_as_the_whole():
    from tokenizers import Tokenizer

    texts = odd_texts(3000, 6)
    ids, at = token_files.PieceEncoder(BPE).encode(pa.array(texts))
    for t, a, b, e in zip(texts, at[:-1], at[1:], Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)):
        assert ids[a:b].tolist() == e.ids, t


def test_sentencepiece_without_dropout_and_round_trip():
    import sentencepiece

    texts = odd_texts(1500, 7)
    library = sentencepiece.SentencePieceProcessor(model_file=SP)
    ids, at = pieces.DropoutEncoder(SP, rate=0.0).encode(list(range(len(texts))), pa.array(texts))
    for t, a, b in zip(texts, at[:-1], at[1:]):
        if "▁" not in t:
            assert ids[a:b].tolist() == library.encode(t), t
    own = pieces.model(SP)
    ids, at = pieces.DropoutEncoder(SP, rate=0.3).encode(list(range(len(texts))), pa.array(texts))
    assert [own.decode(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:])] == texts
    assert len({tuple(own.encode(" international", v, 0.3)) for v in range(8)}) > 2
    long = " " + "abc" * 100
    scanned = own.encode(long[:40], 1, 0.2)
    short, pieces.SHORT = pieces.SHORT, 0
    try:
        assert own.encode(long[:40], 1, 0.2) == scanned
    finally:
        pieces.SHORT = short


@pytest.mark.parametrize("rows", [3, 1 << 14])
def test_parts_merged_at_once_as_one_by_one(rows, monkeypatch):
    monkeypatch.setattr(pieces, "MERGED_ROWS", rows)
    own, rng = pieces.model(SP), np.random.default_rng(5)
    parts = [p.encode("utf-8", "surrogatepass") for t in odd_texts(30, 4) for p in (t[:9], " " + t[9:40], t) if p]
    parts += [w.encode() for w in (" internationalisation", "a", " ", "   x", "▁x", " 日本語", "aaaaaaaaaaaa", " \x00é", " word" * 30)]
    for known in (0, 1, 3):
        skips = np.cumsum(rng.integers(1, 4, (len(parts), known)), 1) - 1
        got, seen = own.merge_all(parts, skips)
        want = [own.merge(p.decode("utf-8", "surrogatepass"), s) for p, s in zip(parts, skips.tolist(), strict=True)]
        assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [ids for ids, _ in want] and seen.tolist() == [n for _, n in want]
    keys = rng.integers(0, 2**62, len(parts), dtype=np.uint64)
    first = pieces._kept(keys, 0, 0.4)
    got, _ = own.merge_all(parts, first[:, None], keys, 0.4)
    assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [own.merge(p.decode("utf-8", "surrogatepass"), pieces._skips(int(k), 0.4))[0] for p, k in zip(parts, keys, strict=True)]
    assert own.merge_all([], np.zeros((0, 2), np.int64))[0] == []


def test_dropout_is_drawn_for_each_occurrence(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "international", "of", "segmentation"]) for _ in range(400)) for _ in range(30)] + ["日本語のテキスト" * 40 + " international"] + odd_texts(200, 8)
    own = pieces.DropoutEncoder(SP, rate=0.2)
    ids, at = own.encode(list(range(len(texts))), pa.array(texts))
    words = {}
    for n, (a, b, t) in enumerate(zip(at[:-1], at[1:], texts)):  # every part anew, from the draws of its own place
        want, raw = [], (" " + t).encode() if t else b""
        key = own.key(n, np.frombuffer(raw, np.uint8))
        place, parts = 0, []
        for i in range(1, len(raw) + 1):
            if i == len(raw) or (raw[i] == 32 and raw[i - 1] != 32) or (own.model.stops_apart and chr(raw[i]) in ".,;:!?" and chr(raw[i - 1]).isascii() and chr(raw[i - 1]).isalpha()):
                parts.append((place, raw[place:i]))
                place = i
        for place, part in parts:
            k = int(pieces.mix(np.array([key], np.uint64) + np.array([place], np.uint64) * pieces._STEP)[0])
            tokens = own.model.merge(part.decode(), pieces._skips(k, 0.2))[0]
            want += tokens
            words.setdefault(part, []).append(tuple(tokens))
        assert ids[a:b].tolist() == want
        assert own.model.decode(want) == t
    for word in (b" international", b" segmentation"):
        found = words[word]
        plain = tuple(own.model.merge(word.decode())[0])
        drawn = [own.model.merge(word.decode(), [i for i in range(60) if rng.random() < 0.2])[0] for _ in range(3000)]
        assert len(set(found)) > 8 and len(found) > 2000
        assert abs(sum(f == plain for f in found) / len(found) - sum(tuple(f) == plain for f in drawn) / 3000) < 0.05
    again, _ = own.encode([5, 5], pa.array([texts[0]] * 2), pa.array([1, 2]))
    assert again[: len(again) // 2].tolist() != again[len(again) // 2 :].tolist()


def test_piece_query(docs, rows, empty):
    got = pieces.piece_digests(docs, SP).collect()
    assert len(got) == len(rows) and all(r["lossless"] for r in got)
    assert pieces.piece_digests(docs.repartition(7), SP).exceptAll(pieces.piece_digests(docs, SP)).count() == 0
    assert pieces.piece_digests(empty, SP).count() == 0
    own = {r["doc_id"]: r for r in pieces.decode_pieces(pieces.encode_pieces(docs, SP), SP).collect()}
    for r in got:
        assert bytes(r["ids"]) == bytes(own[r["doc_id"]]["ids"]) and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_pieces"]
    assert {i: r["decoded"] for i, r in own.items()} == {i: t or "" for i, t, *_ in rows}


def test_chat(spark):
    turns = lambda c, n, tail=(): [(c, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(n)] + list(tail)
    rows = turns(1, 2) + turns(2, 4) + turns(3, 4) + turns(4, 3, [(4, 3, "user", "other <|im_end|>")]) + turns(4, 1) + [(None, 0, "user", "x"), (6, 0, None, None), (7, None, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(9)).withColumn("a", F.lit(9))
    got = {r["conv_id"]: r for r in chat.render(df).collect()}
    assert set(got) == {2, 4, None, 6, 7}
    assert (got[2]["n_turns"], got[2]["n_copies"]) == (4, 2) and got[4]["n_turns"] == 4
    assert got[4]["rendered"].endswith("other < |im_end|><|im_end|>\n") and got[6]["rendered"] == "<|im_start|>unknown\n<|im_end|>\n"
    assert chat.render(df.limit(0)).count() == 0


def test_licences(spark):
    rows = [
        ("r/LICENSE", "Released under the MIT License."), ("r/a/x.py", "code"), ("r/a/b/y.py", "Licensed under the Apache License, Version 2.0.\n" + "code " * 50), ("r/a/b/z.py", None),
        ("q/x.py", "we like the license of others and permission to speak freely about it"), (None, "Released under the MIT License."), ("r/a/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "file_id long, path string, text string").withColumn("term", F.lit(1)).withColumn("dir", F.lit("no"))
    got = {r["file_id"]: (r["licence"], r["origin"]) for r in licences.scan(df).collect()}
    assert got == {0: ("MIT", "own"), 1: ("GPL-3.0", "r/a"), 2: ("Apache-2.0", "own"), 3: ("GPL-3.0", "r/a"), 4: (None, None), 5: ("MIT", "own"), 6: ("GPL-3.0", "own")}
    assert licences.scan(df.limit(0)).count() == 0


def test_whole_licences_headers_and_tags(spark):
    from plumbline.llm.licence_texts import TEMPLATES

    wrap = lambda t, by: "\n\n".join(by + ("\n" + by).join(textwrap.wrap(p, 70)) for p in t.split("\n\n"))
    longest = {}
    for name, text in TEMPLATES:
        if len(text) > len(longest.get(name, "")):
            longest[name] = text
    rows, want = [], {}
    for i, (name, text) in enumerate(sorted(longest.items())):
        head = "Copyright (c) 2021 Acme Widgets Inc. and contributors\n\n" if len(text) > 200 else ""
        rows.append((i, f"{i}/LICENSE", head + wrap(text, "")))
        rows.append((100 + i, f"{i}/a/x.py", head + wrap(text, "# ") + "\n\n" + "code() # of something else\n" * 400))
        want |= {i: name, 100 + i: name, 300 + i: name}
        rows.append((300 + i, f"{i}/a/b/y.py", "plain = code"))
    rows += [(200, "t/x.c", "// SPDX-License-Identifier: MIT\nint x;"), (201, "t/y.c", "We permit nothing; permission to speak was granted by the king, who held the copyright of all songs.")]
    df = spark.createDataFrame(rows, "file_id long, path string, text string")
    for copies in (1, 40):  # the same in a larger corpus
        many = df.unionByName(df.crossJoin(spark.range(copies - 1)).where("file_id < 100").select(F.col("file_id"), F.concat(F.lit("more/"), F.col("id").cast("string"), F.lit("/"), "path").alias("path"), "text"))
        got = {r["file_id"]: (r["licence"], r["origin"]) for r in licences.scan(many).collect() if not r["path"].startswith("more/")}
        assert {i: got[i][0] for i in want} == want
        assert got[200] == ("MIT", "own") and got[201] == (None, None) and all(got[300 + i][1] == str(i) for i in range(len(longest)))


def test_native_plans_have_no_python(spark, docs):
    plan = chat.render(spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for made in (quality.statistics(docs), quality.quality(docs), licences.scan(docs.withColumnRenamed("lang", "path"), "doc_id")):
        plan = made._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_work_tables_are_deleted(spark, monkeypatch):
    import os

    from plumbline.llm import common

    monkeypatch.setattr(common, "_ROOTS", {})
    work = Workspace(spark, "gone")
    assert work.write(spark.range(3), "t").count() == 3 and os.path.isdir(work.root)
    common.release(spark)
    assert not os.path.exists(work.root) and common._ROOTS == {}


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
