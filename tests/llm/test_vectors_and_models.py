"""Nearest neighbours by brute force; classifiers by held-out accuracy."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from posegrid.llm import nearest, quality, queries, toxicity  # noqa: E402


def close(df, want):
    got = sorted(tuple(r) for r in df.collect())
    want = sorted(want)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=1e-15)


def test_nearest_odd(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(60)]  # many ties
    rows += [(100, None), (101, [0.0] * 4), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan"), 1.0, 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (110, [1.0, 2.0]), (110, [1.0, 2.0]), (115, [1.0, 2.5]), (20, [0.5] * 4), (120, [1e-300, 0.0, 0.0, 0.0]), (130, [1e150, 1.0, 1.0, 1.0]), (140, [])]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, ids string, score double")
    close(nearest.nearest(df, k=5, every=10), brute.nearest(rows, 5, 10))
    assert nearest.nearest(df.limit(0)).count() == 0


def test_nearest_of_huge_and_tiny_vectors(spark):
    rows = [(0, [1e155, 0.0]), (1, [1e155, 1e150]), (2, [1e155, 2e150]), (10, [1e-160, 1e-160]), (11, [2e-160, 0.0]), (12, [1e200, -1e200]), (13, [1e200, 1e200]), (14, [3.0, 4.0]), (20, [1e300, 1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with np.errstate(over="ignore", under="ignore"):
        close(nearest.nearest(df, k=3, every=10), brute.nearest(rows, 3, 10))


def test_nearest_grid(spark, monkeypatch):
    """Several blocks of queries against several groups of candidate blocks."""
    for name, value in (("QUERY_BLOCK", 8), ("BLOCK", 16), ("TILE", 3), ("GROUP", 2)):
        monkeypatch.setattr(nearest, name, value)
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(0, 1, (300, 6)), np.repeat(r.normal(0, 1, (1, 6)), 100, 0), 1 + 1e-9 * r.normal(0, 1, (100, 6))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    close(nearest.nearest(df, k=4, every=7), brute.nearest(rows, 4, 7))


def test_nearest_tables(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    close(queries.op4_nearest(spark, sf_dir), brute.nearest(rows, 10, 100))


def held_out(spark, sf_dir, name, label):
    found = getattr(queries, name)(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", label)
    rows = found.join(labels, "doc_id").where(f"held_out and {label} is not null").collect()
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found.collect())
    return np.array([r["score"] for r in rows]), np.array([r[label] for r in rows])


#: Two toxic texts in a hundred are too few to learn from in smaller tables.
BIG = "/root/testdata/sf0.1"


@pytest.mark.skipif(not Path(BIG).is_dir(), reason="no test tables")
def test_toxicity_held_out(spark):
    score, y = held_out(spark, BIG, "op8_toxicity", "toxic")
    assert brute.auc(score, y) > 0.95 and ((score >= 0.5) == y).mean() > 0.95


@pytest.mark.skipif(not Path(BIG).is_dir(), reason="no test tables")
def test_quality_held_out(spark):
    score, y = held_out(spark, BIG, "op9_quality", "quality")
    assert brute.auc(score, y) > 0.9 and ((score >= 0.5) == y).mean() > 0.85


SCHEMA = "doc_id long, text string, label string, score string, words string, raw string, term string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "l", None, "w", "r", "t") for i, t in [(1, None), (2, ""), (3, "  "), (4, "one two"), (4, "one two"), (None, "no id"), (5, "long words " * 50_000), (6, "x" * 9000), (7, "ünï 漢字")]], SCHEMA)


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_models_on_odd_tables(spark, odd, module, label):
    f = getattr(module, "toxicity" if label == "toxic" else "quality")
    kinds = f"doc_id long, {label} int, score string, text string"
    for rows in ([], [(1, 1, "a", "b"), (2, 0, "a", "b"), (4, 1, None, None), (4, 1, None, None), (None, 1, "a", "b"), (5, None, "a", "b"), (6, 0, "a", "b"), (7, 0, "a", "b")]):
        labels = spark.createDataFrame(rows, kinds)
        got = f(odd, labels).collect()
        assert len(got) == 9 and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
        assert f(odd.limit(0), labels).count() == 0


def distance_at_most_one(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def test_automaton_is_the_levenshtein_ball():
    r = random.Random(4)
    terms = ["rendal", "rendom", "hat", "wibble", "wobble", "зоргблат"]
    a = toxicity.compile_automaton([(t, False) for t in terms])
    words = ["hat", "hot", "ha", "зоргблут", "зоргблаат", "зоргблуут"]
    for t in terms:
        for _ in range(200):
            w = list(t)
            for _ in range(r.randrange(0, 3)):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randrange(2)] = r.choice(["", "e", "q", "ö"])
            words.append("".join(w) or "z")
    got = a.run(words)
    for w, code in zip(words, got):
        near = [t for t in terms if t == w or (len(t) >= 5 and distance_at_most_one(t, w))]
        assert (code > 0) == bool(near), w
        if code:
            assert ((code - 1) & 1) == (w not in terms)


def test_quotation_counts_less(spark):
    r = random.Random(1)
    plain = lambda: " ".join(r.choice("mer tol vas pin dro kel".split()) for _ in range(30))
    rows = [(i, plain() + (" zorgblat fimplune zorgblat" if i % 2 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    m = toxicity.learn(docs, labels, F.lit(True)).matcher()
    quoted, bare, wrong = m.score(b'they said "zorgblat" there'), m.score(b"they said zorgblat there"), m.score(b"they said zorgblut there")
    assert quoted < bare and wrong > m.score(b"they said nothing there")


def test_chunks_cover_the_text():
    for n in (0, 1, 256, 257, 480, 481, 5000):
        raw = bytes(k % 251 for k in range(n))
        chunks = quality.cut(raw)
        assert chunks.shape[1] == quality.CHUNK
        if n > quality.CHUNK:
            assert bytes(chunks[0]) == raw[: quality.CHUNK] and bytes(chunks[-1]) == raw[-quality.CHUNK :]
            assert len(chunks) == -(-(n - quality.CHUNK) // quality.STEP) + 1


def test_misspellings_are_found():
    a = toxicity.compile_automaton([("zorgblat", False), ("зоргблат", False)])
    m = toxicity.Lexicon([], a, np.ones(5), np.zeros(3)).matcher()
    for w in ("zorgblat", "Zorgblat,", "zorgblut", "zorgbl4t", "z0rgblat", "zorgb1at", "zorg-blat", "z.o.r.g.b.l.a.t", "zörgblat", "(zorg_blat)", "зоргблут", "ЗОРГБЛААТ"):
        assert len(m.hits(f"they said {w} there".encode())) == 1, w
    for w in ("zorgbluut", "zarg-blet", "blat", "z0rgbl4t"):
        assert m.hits(f"they said {w} there".encode()) == [], w
    # words are counted, not chunks: every piece of a chunk is one
    assert [k for k, _, _ in m.hits(b"a zorgblat/nothing/zorgblut b zorgblat")] == [1, 3, 5]


def test_hits_are_those_of_a_plain_scan():
    """Every hit, its word number and whether it is quoted, by a scan without an automaton or caches."""
    r = random.Random(6)
    terms = ["rendal", "hat", "wibble", "зорг", "mörkel"]
    m = toxicity.Lexicon([], toxicity.compile_automaton([(t, False) for t in terms]), np.ones(11), np.zeros(3)).matcher()
    pool = [*terms, "rendel", "hats", "wib-ble", "w.i.b.b.l.e", "zorg", "зорк", "morkel", "other", "words", "a1", "--", "hat/hat", "“rendal”", '"wibble', 'rendal"']
    for _ in range(60):
        text = " ".join(r.choice(pool) for _ in range(r.randrange(0, 40)))
        want, words, marks = [], 0, [c for chunk in text.split() for c in chunk if c in "\"“”«»„"]
        seen = 0
        for chunk in text.split():
            own = sum(c in "\"“”«»„" for c in chunk)
            after = len(marks) - seen - own
            quoted = own >= 2 or (seen % 2 == 1 and own + after > 0) or (seen % 2 == 0 and own == 1 and after > 0)
            pieces = "".join(c if c.isalnum() else " " for c in chunk.lower()).split()
            near = lambda w: any(t == w or (len(t) >= 5 and distance_at_most_one(t, w)) for t in terms)
            hits = [k for k, w in enumerate(pieces) if near(w)]
            if not hits and len(pieces) > 1 and near("".join(pieces)):
                hits = [0]
            want += [(words + k, quoted) for k in hits]
            words += max(1, len(pieces))
            seen += own
        assert [(k, q) for k, _, q in m.hits(text.encode())] == want, text


def test_network_is_a_plain_loop():
    """Convolution, pooling and the last layer, one multiplication after the other."""
    r = np.random.default_rng(8)
    net = quality.Network(r.normal(0, 1, (quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), r.normal(0, 1, quality.FILTERS).astype(np.float32), r.normal(0, 1, 2 * quality.FILTERS + 1), r.normal(0, 1, 2 * quality.FILTERS), r.random(2 * quality.FILTERS) + 0.5)
    texts = [b"", b"short", bytes(r.integers(0, 256, 700).astype(np.uint8)), bytes(r.integers(0, 256, 300).astype(np.uint8))]
    for raw, got in zip(texts, net.combine(quality.text_features(net, texts))):
        padded = raw.ljust(quality.CHUNK, b"\0")
        starts = [*range(0, len(padded) - quality.CHUNK, quality.STEP), len(padded) - quality.CHUNK]
        best = [[max(0.0, max(sum(float(net.table[j, padded[s + p + j], f]) for j in range(quality.WIDTH)) + float(net.bias[f]) for p in range(quality.CHUNK - quality.WIDTH + 1))) for f in range(quality.FILTERS)] for s in starts]
        x = [sum(b[f] for b in best) / len(best) for f in range(quality.FILTERS)] + [max(b[f] for b in best) for f in range(quality.FILTERS)]
        z = sum((v - c) / s * w for v, c, s, w in zip(x, net.center, net.scale, net.out)) + net.out[-1]
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-4


def test_disagreeing_labels_and_text_ids(spark):
    r = random.Random(3)
    rows = [(f"d{i}", " ".join(r.choice("mer tol vas pin dro kel".split()) for _ in range(30)) + (" zorgblat fimplune" if i % 2 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows + rows[:10], "doc_id string, text string")
    labels = spark.createDataFrame([(i, k % 2, k % 2) for k, (i, _) in enumerate(rows)] + [(i, 0, 0) for i, _ in rows], "doc_id string, toxic int, quality int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 130 and all(x["predicted"] == int(x["doc_id"][1:]) % 2 for x in got)
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, toxicity.toxicity(docs, labels).collect()))
    assert quality.quality(docs, labels).count() == 130


def test_long_texts_in_bands():
    """Chunks of a long text are views: features as of all chunks at once, and little memory beside the text."""
    import tracemalloc

    r = np.random.default_rng(12)
    net = quality.Network(r.normal(0, 1, (quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), r.normal(0, 1, quality.FILTERS).astype(np.float32), r.normal(0, 1, 2 * quality.FILTERS + 1), np.zeros(2 * quality.FILTERS), np.ones(2 * quality.FILTERS))
    edge = quality.BAND * quality.STEP
    for n in (edge + 1, edge + quality.CHUNK, 2 * edge + 77):
        raw = r.integers(0, 256, n).astype(np.uint8).tobytes()
        assert np.allclose(quality.long_maxima(net, raw), net.maxima(quality.cut(raw)))
        assert np.allclose(quality.text_features(net, [b"x", raw, b""])[1], quality.pooled(net.maxima(quality.cut(raw))))
    raw = bytes(20_000_000)
    tracemalloc.start()
    quality.text_features(net, [raw])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000
