"""Language scores, clusters and codes against plain loops over Python integers."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from posegrid.llm import clusters, codes, exact, language, queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
END = b""


def low(raw: bytes) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in raw)


def floor_of(x: float, factor: int) -> int:
    return math.floor(Fraction(x) * factor)


# --- language ----------------------------------------------------------------


class Plain:
    """The language model with exact quantised counts in dictionaries, no filter."""

    def __init__(self, texts: list[bytes], order: int, mu: float):
        self.order, self.mu = order, mu
        self.grams: Counter = Counter()
        self.words: Counter = Counter()
        for raw in texts:
            own = self.tokens(raw)
            self.words.update(own[order - 1 :])
            for k in range(1, order + 1):
                for e in range(order - 1 if k == order else order - 2, len(own)):
                    if e >= 0 and e - k + 1 >= 0:
                        self.grams[tuple(own[e - k + 1 : e + 1])] += 1
        self.total, self.distinct = sum(self.words.values()), len(self.words)

    def tokens(self, raw: bytes) -> list:
        return [None] * (self.order - 1) + WORD.findall(low(raw)) + [END]

    def count(self, gram: tuple) -> float:
        n = self.grams.get(gram, 0)
        return float(language.typical(language.level(np.array([n])))[0])

    def row(self, raw: bytes) -> tuple:
        own = self.tokens(raw)
        score = base = known = 0.0
        for e in range(self.order - 1, len(own)):
            c = self.words.get(own[e], 0)
            known += c > 0
            base += math.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))
            p = min((self.count((own[e],)) + 0.5) / (self.total + 0.5 * (self.distinct + 1)), 1)
            for k in range(2, self.order + 1):
                h = self.count(tuple(own[e - k + 1 : e]))
                p = (min(self.count(tuple(own[e - k + 1 : e + 1])), h, self.count(tuple(own[e - k + 2 : e + 1]))) + self.mu * p) / (h + self.mu)
            score += math.log10(p)
        return len(own) - self.order + 1, int(known), base, score


def held(i) -> bool:
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1


def odd_texts() -> list[tuple]:
    r = random.Random(9)
    some = lambda n: " ".join(r.choice(["tap", "Mel", "rovan", "sil,", "örk", "Zu.", "a-word-of-more-than-fifteen-bytes", "a-word-of-more-than-fifteen-bytez", "x"]) for _ in range(n))
    rows = [(i, some(r.randrange(0, 60))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, " \t\n\x0b "), (103, "one"), (103, "one"), (None, "a row without an id"), (None, None), (104, some(6000)), (104, "other"), (105, "y" * 9000), (106, "nul \0 here   wide \x85 space \x1f x"), (107, "TAP tap ÖRK örk")]


SCHEMA = "doc_id long, text string, held_out string, score string, key string, n string, a string, b string, c string, band string, raw string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, *["q"] * 9) for i, t in rows], SCHEMA)


def check_language(df, rows, order, mu=language.MU):
    m = Plain([(t or "").encode() for i, t in rows if not held(i)], order, mu)
    got = sorted((tuple(r) for r in df.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[2], x[6]))
    want = [(i, held(i), *m.row((t or "").encode())) for i, t in rows]
    want = sorted(((i, h, n, k, m.total, b, s) for i, h, n, k, b, s in want), key=lambda x: (x[0] is None, x[0] or 0, x[2], x[6]))
    assert df.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-11)
    return np.array([g[6] for g in got]), np.array([w[6] for w in want])


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_odd(spark, order):
    rows = odd_texts()
    df = table_of(spark, rows).repartition(3)
    # hardly any false member in a small filter: scores are those of exact quantised counts
    got, want = check_language(language.language_scores(df, order=order, bits=256), rows, order)
    assert np.allclose(got, want, rtol=2e-3, atol=1e-9)
    assert language.language_scores(df.limit(0), order=order).count() == 0


def test_language_without_training(spark):
    rows = [(i, "some words") for i in range(400) if held(i)]
    got, _ = check_language(language.language_scores(table_of(spark, rows)), rows, 2)
    assert not got.any()


def test_language_filter_beyond_broadcast(spark, monkeypatch):
    """Parts that stay where they are give the same scores, long texts in bands included."""
    rows = odd_texts() + [(200, "tap  Mel sil, " * 400_000)]
    df = table_of(spark, rows).repartition(3)
    want = sorted(map(str, language.language_scores(df, order=3).collect()))
    monkeypatch.setattr(language, "BROADCAST_BYTES", 0)
    assert sorted(map(str, language.language_scores(df, order=3).collect())) == want


@pytest.mark.parametrize("together", [1, 16])
def test_language_messages_to_a_large_filter(spark, monkeypatch, together):
    """Bands ask shards, not cells: their number does not grow with bands times cells."""
    r = random.Random(8)
    rows = [(k, " ".join(f"{r.choice('abcd')}{r.randrange(3000)}" for _ in range(60_000))) for k in range(8)]
    df = table_of(spark, rows).coalesce(1)
    monkeypatch.setattr(language, "CELL", 1 << 13)  # some 90 cells
    want = sorted(map(str, language.language_scores(df).collect()))
    sent, dealt = [], type(df).repartition

    def seen(self, *by):
        if "grams" in self.columns and isinstance(by[0], str) and by[0] in ("cell", "shard"):
            sent.append(self.where("grams IS NOT NULL").count())
        return dealt(self, *by)

    monkeypatch.setattr(type(df), "repartition", seen)
    monkeypatch.setattr(language, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(language, "UNIT", together, raising=False)
    monkeypatch.setattr(language, "SHARD_BYTES", 1 << 18, raising=False)
    assert sorted(map(str, language.language_scores(df).collect())) == want
    assert len(sent) == 1 and 0 < sent[0] <= 80


def test_language_rare_words_by_join(spark, monkeypatch):
    rows = odd_texts()
    monkeypatch.setattr(language, "SHARE", 4)
    check_language(language.language_scores(table_of(spark, rows).repartition(3)), rows, 2)


def test_bands_change_nothing(monkeypatch):
    """Grams and places of a text cut in small bands are those of the whole text."""
    r = random.Random(3)
    raw = " ".join(r.choice(["ab", "cde", "Fgh,", "a-word-of-more-than-fifteen-bytes"]) for _ in range(400)).encode() + b"  "
    for order in (1, 2, 3, 4):
        found = []
        for size in (1 << 20, 64):
            monkeypatch.setattr(language, "BAND", size)
            total, news = Counter(), []
            for band in language.bands(iter([(0, 1, False, raw), (1, 2, False, b""), (2, 3, False, b"x y")]), order):
                t = language.Tokens(band, order)
                for k, g in enumerate(t.grams(), 1):
                    total.update(g[t.counted(k)].tolist())
                news += t.s[t.new].tolist()
            found.append((total, news))
        assert found[0] == found[1]


def test_filter_never_misses():
    r = np.random.default_rng(1)
    grams = np.unique(r.integers(0, 1 << 63, 20_000).astype(np.uint64))
    counts = np.minimum((1 / r.random(len(grams))).astype(np.int64), 1 << 40)
    counts[:3] = [1, 1 << 40, 1 << 61]
    cells = 7
    cell = language.cell_of(grams, cells)
    f = language.Filter.of({c: language.part(grams[cell == c], counts[cell == c]).tobytes() for c in range(cells)}, cells)
    found, want = f.levels(grams), language.level(counts)
    assert (found >= want).all() and (found > want).mean() < 0.05
    other = f.levels(r.integers(0, 1 << 63, 20_000).astype(np.uint64))
    assert (other > 0).mean() < 0.05
    least = language.thresholds()
    for c in [*range(1, 200), 10**6, 10**12]:
        q = int(language.level(np.array([c]))[0])
        assert least[q - 1] <= c < least[q] and least[q - 1] <= language.typical(np.array([q]))[0] < least[q]


def test_language_on_tables(spark, sf_dir):
    df = queries.op11_language(spark, sf_dir)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got, want = check_language(df, rows, 2)
    # a false member can change a short text's score by any share, but hardly the sum of all
    assert abs(got.sum() - want.sum()) < 0.002 * abs(want.sum())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    exact_, want = check_language(language.language_scores(docs, bits=256), rows, 2)
    assert np.allclose(exact_, want, rtol=1e-9)
    out = [r for r in df.collect() if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


# --- clusters ----------------------------------------------------------------


def plain_clusters(rows, k, rounds, dim, factor, seed=1):
    kept = [(i, [floor_of(x, factor) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda v: min(range(len(centers)), key=lambda j: (far(v, centers[j]), j))
    for _ in range(rounds):
        own = [[] for _ in centers]
        for _, v in kept:
            own[place(v)].append(v)
        centers = [[sum(c) // len(o) for c in zip(*o)] if o else centers[j] for j, o in enumerate(own)]
    found = [(i, j, far(v, centers[j])) for i, v in kept for j in [place(v)]]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    fit = lambda n: n if n <= exact.LONG_MAX else None
    return [(i, j, fit(d), fit(inertia[j]), fit(sum(inertia.values())), hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()) for i, j, d in found]


def plain_codes(rows, parts, entries, rounds, factor):
    kept = [(i, label, [floor_of(x, factor) for x in v]) for i, v, label in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for size in {len(v) for _, _, v in kept}:
        own = [r for r in kept if len(r[2]) == size]
        d = size // parts
        first = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
        books = [[r[2][p * d : (p + 1) * d] for r in first] for p in range(parts)]
        place = lambda v, book: min(range(len(book)), key=lambda j: (far(v, book[j]), j))
        for _ in range(rounds):
            for p in range(parts):
                near = [[] for _ in books[p]]
                for r in own:
                    v = r[2][p * d : (p + 1) * d]
                    near[place(v, books[p])].append(v)
                books[p] = [[sum(c) // len(n) for c in zip(*n)] if n else books[p][e] for e, n in enumerate(near)]
        told = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for i, label, v in own:
            at = [place(v[p * d : (p + 1) * d], books[p]) for p in range(parts)]
            out.append((i, label, "".join(f"{a:02x}" for a in at), sum(far(v[p * d : (p + 1) * d], books[p][a]) for p, a in enumerate(at)), told))
    fit = lambda n: n if n <= exact.LONG_MAX else None
    total = Counter()
    for _, label, _, e, _ in out:
        total[label] += e
    alone = {label: all(fit(e) is not None for _, x, _, e, _ in out if x == label) for label in total}
    return [(i, c, fit(e), fit(total[label]) if alone[label] else None, t) for i, label, c, e, t in out]


def same(df, want):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)


def odd_vectors(dim: int, huge: bool) -> list[tuple]:
    r = random.Random(dim)
    rows = [(i, [r.choice([-0.51, -0.25, 0.0, 0.25, 0.5, 1 / 3]) for _ in range(dim)], r.choice([None, 1, 2])) for i in range(150)]
    rows += [(200 + i, [0.125] * dim, 1) for i in range(60)] + [(300, None, 1), (301, [], 2), (302, [None] * dim, 1), (303, [float("nan")] * dim, 1), (304, [float("inf")] + [0.0] * (dim - 1), 1), (305, [0.5] * (dim + 1), 1), (306, [0.25] * 2 * dim, 3), (307, [0.0] * 2 * dim, 3), (None, [0.3] * dim, None), (7, [0.1] * dim, 1), (7, [0.1] * dim, 1)]
    if huge:
        rows += [(400, [1e30] * dim, 4), (401, [-1e300] + [0.5] * (dim - 1), 4), (402, [1.7e308] * dim, 5), (403, [3e6] * dim, 5), (404, [2e6 + 0.5] * dim, 5)]
    return rows


VECTORS = "vec_id long, embedding array<double>, label int, code string, v string, key string, size string, cluster string, sums string, n string"


@pytest.mark.parametrize("huge", [False, True])
def test_clusters_odd(spark, huge):
    rows = odd_vectors(8, huge)
    df = spark.createDataFrame([(*r, *["q"] * 7) for r in rows], VECTORS).repartition(3)
    same(clusters.clusters(df, k=7, rounds=4, dim=8), plain_clusters([r[:2] for r in rows], 7, 4, 8, 64))
    assert clusters.clusters(df.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    same(clusters.clusters(few, k=7, rounds=2, dim=8), plain_clusters([r[:2] for r in rows if r[0] is not None and r[0] < 3], 7, 2, 8, 64))


def test_clusters_tables(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    same(queries.op12_clusters(spark, sf_dir), plain_clusters(rows, 16, 3, 64, 64))


def test_bounds_rule_out_and_never_wrongly():
    """Every bound holds after every move, ties included, and most distances are never computed."""
    r = np.random.default_rng(2)
    middles = r.integers(-400, 400, (10, 6))
    x = np.concatenate([middles[r.integers(0, 10, 2000)] + r.integers(-9, 10, (2000, 6)), np.repeat(r.integers(-3, 4, (1, 6)), 50, 0)]).astype(np.int64)
    now = clusters.Centroids(x[:10].tolist())
    block, computed = clusters.Block(x, k=10), []
    for _ in range(8):
        computed.append(block.assign(now))
        d2 = ((x[:, None] - np.array(now.rows)[None]) ** 2).sum(2)
        assert np.array_equal(block.cluster, d2.argmin(1))
        assert (block.upper >= np.sqrt(d2.min(1))).all() and (block.lower <= np.sqrt(d2)).all()
        moved = clusters.Centroids([(x[block.cluster == j].sum(0) // max(1, (block.cluster == j).sum())).tolist() for j in range(10)])
        block.move(moved.moved(now))
        now = moved
    assert computed[-1] < 0.15 * computed[0] < 0.15 * x.shape[0] * 10


# --- codes -------------------------------------------------------------------


@pytest.mark.parametrize("huge", [False, True])
@pytest.mark.parametrize("share", [1000, 3])
def test_codes_odd(spark, monkeypatch, huge, share):
    monkeypatch.setattr(codes, "SHARE", share)
    rows = odd_vectors(8, huge)
    df = spark.createDataFrame([(*r, *["q"] * 7) for r in rows], VECTORS).repartition(3)
    same(codes.compress(df, parts=4, entries=9, rounds=3), plain_codes(rows, 4, 9, 3, 256))
    assert codes.compress(df.limit(0)).count() == 0


def test_codes_tables(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    same(queries.op13_codes(spark, sf_dir), plain_codes(rows, 16, 64, 2, 256))


def test_weighted_sums_are_exact():
    r = random.Random(4)
    x = np.array([[r.randrange(-(1 << 30), 1 << 30) for _ in range(3)] for _ in range(500)], np.int64)
    w = np.array([r.choice([1, 2, 1 << 40, (1 << 62) - 1]) for _ in range(500)], np.int64)
    at = np.array([r.randrange(4) for _ in range(500)])
    want = [[sum(int(v[d]) * int(n) for v, n, a in zip(x, w, at) if a == e) for d in range(3)] + [sum(int(n) for n, a in zip(w, at) if a == e)] for e in range(5)]
    assert codes.weighted_sums(x, w, at, 5) == want == codes.weighted_sums(x.astype(object), w, at, 5)
