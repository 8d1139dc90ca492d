"""Text operators against the tokenizers library, plain versions and exact round trips."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from posegrid.llm import bpe, coder, decontaminate, jaccard, queries, repeats, sharding, token_counts, token_files, vocab  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, raw string, key string, ids string, score string, label string, words string, h string, cell string, n string, f string, rest string, shard string"


def pieces(r: random.Random, n: int) -> str:
    return " ".join(r.choice(["tap", "Mel", "rovan", "sil,", "örk", "Zu.", "dah", "12", "don't", "qua-lix"]) for _ in range(n))


def odd_texts() -> list[tuple]:
    r = random.Random(5)
    long = pieces(r, 30_000)
    passage = pieces(r, 80)
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "a row without an id"), (None, None), (5, long), (6, "x" * 5000), (7, "x" * 5000),
        (8, "special <|endoftext|> inside <|startoftext|> texts<|endoftext|>"), (9, "nul \0 here and there  two  spaces \n\n new\r\nline "), (10, "😀 naïve ﬁne Ünïcode 漢字 한국어 é"),
        (11, pieces(r, 30) + " " + passage + " " + pieces(r, 20)), (12, pieces(r, 10) + " " + passage + "."), (13, passage + " " + passage), (14, passage), (15, passage), (16, long[:40_000]), (17, "ab" * 600),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, *[None if k % 2 else "z" for k in range(2)], None, *["q"] * 12) for i, t in odd_texts()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab.default_path(name))
    t.no_truncation()
    t.no_padding()
    return t


def same(df, want):
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


# -- token counts, BPE, token files ------------------------------------------------


def counted(rows, limit=2048):
    t = library(vocab.WORD_BPE)
    n = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    out = []
    for i, x in rows:
        x = x or ""
        total, cut = n(x), len(x)
        if total > limit:  # the token after the limit ends behind the cut; some characters around it decide
            near = t.encode(x, add_special_tokens=False).offsets[limit][1]
            cut = max(k for k in range(max(0, near - 40), min(len(x), near + 40)) if n(x[:k]) <= limit)
        out.append((i, len(brute.raw(x)), total, total > limit, len(brute.raw(x[:cut]))))
    return out


def test_token_counts(spark, odd, empty, real, sf_dir):
    same(token_counts.token_counts(odd), counted(odd_texts()))
    same(queries.op1_token_counts(spark, sf_dir), counted(real))
    assert token_counts.token_counts(empty).count() == 0


def test_prefix_tables(odd):
    t, texts = library(vocab.WORD_BPE), dict(odd_texts())
    n = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    rows = {r["doc_id"]: r for r in token_counts.prefix_tables(odd.where("doc_id in (1, 2, 8, 9, 10, 11)"), [7, 10**6]).collect()}
    for i in (1, 2, 8, 9, 10, 11):
        text = texts[i] or ""
        assert list(rows[i]["counts"]) == [n(text[:k]) for k in range(len(text) + 1)]
        longest = max(k for k in range(len(text) + 1) if n(text[:k]) <= 7)
        assert list(rows[i]["cuts"]) == [len(text[:longest].encode()), len(text.encode())]


@pytest.mark.parametrize("text", ["Tokenization unbelievably rearranged, isn't it? they'll've antidisestablishment", "漢字かな交じり文をトークン化する" * 3, "cafe\u0301 nai\u0308ve ﬁne İstanbul ǅ", "a<|endoftext|>b <|endoftext|><|startoftext|>c!!'s 12'3", "   ", "x" * 300, "here\xa0and\u2003there\xa0"])
def test_count_at_every_prefix(text):
    c, t = token_counts.counter(vocab.default_path(vocab.WORD_BPE)), library(vocab.WORD_BPE)
    raw = text.encode()
    table = c.table(raw)
    want = [len(t.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    assert c.prefix_counts(raw).tolist() == want
    for k in range(len(text) + 1):
        assert c.count_at(raw, table, len(text[:k].encode())) == want[k]
    for budget in range(max(want) + 2):
        assert c.cut(raw, table, budget) == len(text[: max(k for k, n in enumerate(want) if n <= budget)].encode())


def digested(rows):
    t = library(vocab.BYTE_BPE)
    out = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        out.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.decode(ids, skip_special_tokens=False).encode())))
    return out


def test_bpe(spark, odd, empty, real, sf_dir):
    same(bpe.encode_decode(odd), digested(odd_texts()))
    same(queries.op5_bpe(spark, sf_dir), digested(real))
    assert bpe.encode_decode(empty).count() == 0
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(odd)).collect()}
    assert all(back[i] == (t or "") for i, t in odd_texts() if i is not None)


def filed(rows):
    t, start, out = library(vocab.WORD_BPE), 0, []
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, brute.raw(r[1]))):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, odd, empty, real, sf_dir):
    # of two rows with a null id the one with the null text comes first
    same(token_files.round_trip(odd), filed(odd_texts()))
    same(queries.op10_token_files(spark, sf_dir), filed(real))
    assert token_files.round_trip(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_coder_round_trip(seed):
    r = np.random.default_rng(seed)
    ids = [np.zeros(0, np.int64), r.integers(0, coder.MOST, 3000), np.full(5000, 7), r.zipf(1.3, 20_000) % 49_000, np.tile(r.integers(0, 99, 17), 400), np.array([0, coder.MOST - 1])][seed]
    data = coder.pack(ids)
    assert np.array_equal(coder.unpack(data), ids)
    if len(ids) > 100:
        assert len(data) < 4 * len(ids)
        broken = bytearray(data)
        broken[-len(data) // 3] ^= 0x55
        with pytest.raises(coder.BlockError):
            coder.unpack(bytes(broken))


def entropy(ids) -> float:
    c = np.bincount(ids)
    c = c[c > 0]
    return float(-(c * np.log2(c / c.sum())).sum() / 8)


def test_coder_learns():
    """Ids drawn one by one cost little more than their entropy, ids with contexts much less."""
    r = np.random.default_rng(1)
    drawn = np.minimum(r.zipf(1.3, 150_000), 49_000)
    assert len(coder.pack(drawn)) < 1.12 * entropy(drawn)
    phrases = [np.minimum(r.zipf(1.3, 12), 49_000) for _ in range(3000)]
    text = np.concatenate([phrases[min(k, 2999)] for k in r.zipf(1.2, 20_000)])
    assert len(coder.pack(text)) < 0.6 * entropy(text)


def test_blocks_are_read_on_their_own(monkeypatch):
    monkeypatch.setattr(coder, "BLOCK", 5000)
    ids = np.random.default_rng(2).zipf(1.4, 12_345) % 30_000
    data = coder.pack(ids)
    table = [coder.struct.unpack_from("<III", data, 20 + 12 * k) for k in range(3)]
    at = 20 + 12 * 3 + table[0][1]
    assert np.array_equal(coder.decode_block(data[at : at + table[1][1]], 5000), ids[5000:10_000])


# -- sharding -----------------------------------------------------------------------


def test_sharding(spark, odd, empty, real, sf_dir):
    for rows, df in ((odd_texts(), sharding.assign(odd)), (real, queries.op2_sharding(spark, sf_dir))):
        got = df.collect()
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(((i, len(brute.raw(t)) + 1, zlib.crc32(brute.raw(t))) for i, t in rows), key=repr)
        assert {r["law"] for r in got} <= {"key"} and {r["shard"] for r in got} <= set(range(8))
        for s in range(8):
            own = sorted(r["slot"] for r in got if r["shard"] == s)
            assert own == list(range(len(own)))
        assert all(r["grown_shard"] in (r["shard"], 8) for r in got)
    assert sharding.assign(empty).count() == 0


def test_weight_changes_stay_in_their_subtree(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    from pyspark.sql import functions as F

    def with_weight(w):
        racks = lambda r: tuple(sharding.Node(f"r{r}/k{k}", tuple(sharding.leaf(f"r{r}/k{k}/s{s}", 4 * r + 2 * k + s, w if (r, k, s) == (1, 1, 1) else 1.0) for s in range(2))) for k in range(2))
        return sharding.Node("root", tuple(sharding.Node(f"r{r}", racks(r)) for r in range(2)))

    k = F.col("doc_id")
    moved = keys.select(sharding.choose(k, with_weight(1.0)).alias("a"), sharding.choose(k, with_weight(2.0)).alias("b")).where("a != b").groupBy("a", "b").count().collect()
    # rows go up the path of the node that grew: into region 1, into its rack 1, into its shard 1
    assert moved and all(r["b"] >= 4 for r in moved if r["a"] < 4)
    assert all(r["b"] in (6, 7) for r in moved if 4 <= r["a"] < 6) and all(r["b"] == 7 for r in moved if r["a"] == 6)
    share = keys.select(sharding.choose(k, with_weight(2.0)).alias("s")).groupBy("s").count().collect()
    assert all(abs(r["count"] / 20_000 - (2 if r["s"] == 7 else 1) / 9) < 0.02 for r in share)


# -- near copies ----------------------------------------------------------------------


def copies(r: random.Random) -> list[tuple]:
    """Texts with chains of changes, at and around the limits."""
    rows = [(i, t) for i, t in odd_texts() if len(brute.raw(t)) < 3000]
    n = 100
    for _ in range(25):
        words = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 8, 40, 120]))]
        for _ in range(r.randrange(1, 6)):
            rows.append((n, " ".join(words)))
            n += 1
            for _ in range(r.randrange(0, 3)):
                words[r.randrange(len(words))] = f"w{r.randrange(400)}"
    return rows


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard(spark, width, percent):
    rows = copies(random.Random(width))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, cell string")
    same(jaccard.jaccard_join(df, width, percent), brute.jaccard_components(rows, width, percent))


def test_jaccard_on_tables(spark, real, empty, sf_dir):
    same(queries.op3_jaccard_join(spark, sf_dir), brute.jaccard_components(real, 3, 90))
    assert jaccard.jaccard_join(empty).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in jaccard.keep_one(docs, 5, 80).collect()}
    assert kept == {i for i, _, c in brute.jaccard_components(real, 5, 80) if i == c}


def repeated(r: random.Random) -> list[tuple]:
    """Rows that repeat ids, texts or both, with near copies among them."""
    a, b, c, d, e = ([f"v{r.randrange(10**6)}" for _ in range(60)] for _ in range(5))
    near = lambda w, k: " ".join([*w[:-1], f"u{k}"])
    a, b, c, d, e = (" ".join(w) for w in (a, b, c, d, e))
    return [
        (30, a), (30, a), (31, b), (31, near(a.split(), 1)), (32, near(a.split(), 2)), (None, near(a.split(), 3)), (None, a),
        (None, c), (None, c), (None, near(c.split(), 4)), (None, d), (33, e), (33, near(e.split(), 5)), (None, e), (None, ""), (None, ""), (34, " "), (34, " "),
    ]


def test_keep_one_decides_by_rows(spark):
    rows = [(i, t) for i, t in odd_texts() if len(brute.raw(t)) < 3000] + repeated(random.Random(9))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    kept = jaccard.keep_one(df, 5, 80)
    assert kept.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    # numbered in the order of their ids, null ids last
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    groups: dict = {}
    for (i, t), (_, _, c) in zip(order, brute.jaccard_components(list(enumerate(t for _, t in order)), 5, 80)):
        groups.setdefault(c, []).append((i, t))
    assert len(got) == len(groups)
    for own in groups.values():
        there = {x for x in own if x in got}
        assert len(there) == 1 and {i for i, _ in there} == {own[0][0]}


def test_counts_bound_the_difference():
    r = np.random.default_rng(7)
    sets = []
    for n in (0, 1, 5, 300, 340, 2000, 5000, 9000):
        own = r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        sets += [np.unique(own), np.unique(np.concatenate([own[n // 10 :], r.integers(0, 1 << 63, n // 10).astype(np.uint64)]))]
    full, some = [jaccard.fine_counts(x) for x in sets], [jaccard.fine_counts(x, jaccard.CELL_BITS) for x in sets]
    a, b = (x.ravel() for x in np.meshgrid(range(len(sets)), range(len(sets))))
    far = jaccard.Counts([x.tobytes() for x in some]).differences(a, b)
    for i, j, d in zip(a, b, far):
        true = len(np.setxor1d(sets[i], sets[j]))
        assert d <= true and d == jaccard.least_difference(some[i], some[j]) and jaccard.least_difference(full[i], full[j]) <= true
    assert (jaccard.coarse([x.tobytes() for x in some]).sum(1) <= [len(x) for x in sets]).all()


def test_pivots_lose_no_pair():
    r = np.random.default_rng(3)
    base = r.poisson(6, (40, jaccard.BUCKETS))
    counts = np.maximum(np.repeat(base, 30, 0) + r.integers(-1, 2, (1200, jaccard.BUCKETS)) * (r.random((1200, jaccard.BUCKETS)) < 0.1), 0)
    sizes, labels = counts.sum(1), np.arange(1200)
    got = {(int(a), int(b)) for x, y in jaccard.near_pairs(counts, sizes, labels, 80) for a, b in zip(x, y)}
    far = np.abs(counts[:, None, :] - counts[None, :, :]).sum(2)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(far * 180 <= 20 * (sizes[:, None] + sizes[None, :]))) if a < b}
    assert {tuple(sorted(p)) for p in got} == want


def test_crowded_cell_is_exact_and_ends():
    """Sets within a few elements of each other: cutting around pivots saves little."""
    r = np.random.default_rng(3)
    counts = (r.integers(0, 6, 64) + (r.random((900, 64)) < 0.2) * r.integers(-2, 3, (900, 64))).clip(0).astype("<i4")
    counts = counts[np.argsort(counts.sum(1), kind="stable")]
    sizes, labels = counts.sum(1).astype(np.int64), r.integers(0, 450, 900)
    found = [(int(a), int(b)) for x, y in jaccard.near_pairs(counts, sizes, labels, 90) for a, b in zip(x, y)]
    far = np.abs(counts[:, None] - counts[None]).sum(2)
    i, j = np.nonzero(np.triu((far * 190 <= 10 * (sizes[:, None] + sizes[None])) & (labels[:, None] != labels[None]), 1))
    assert len(found) == len(set(found))
    assert set(found) == set(zip(i.tolist(), j.tolist()))


def test_no_rows_for_pairs_of_a_large_group(spark, monkeypatch):
    """Near copies, most of them just apart: what comes out of their cells does not grow with their square."""
    r = np.random.default_rng(3)
    texts = []
    for k in range(240):
        words = [f"w{j}" for j in range(100)]
        for at in r.choice(100, 7, replace=False):
            words[at] = f"x{k}y{at}"
        texts.append(" ".join(words))
    rows, counts, written = list(enumerate(texts)), {}, jaccard.written

    def counted(df, name):
        out = written(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(jaccard.jaccard_join(df, 1, 80), brute.jaccard_components(rows, 1, 80))
    assert counts["jaccard-more"] < len(rows) and counts["jaccard-touching"] < counts["jaccard-open"], counts


def test_links_of_a_cell(spark):
    """Pairs whose counts allow a link come out where their texts are linked and nothing connects them yet."""
    texts = [b"a b c d e f g h i j", b"a b c d e f g h i k", b"a b c d e f g h i l", b"A b c d e f g h i j m", b"q b c d e r g h i j"]
    sets = [np.array(x) for x in jaccard.shingle_sets(texts, 1)]
    rows = [(1, k > 2, len(x), k, k, bytearray(jaccard.fine_counts(x).tobytes()), bytearray(t)) for k, (x, t) in enumerate(zip(sets, texts))]
    rows += [(2, v, n, k, k, c, t) for _, v, n, k, _, c, t in rows[:2]]
    df = spark.createDataFrame(rows, "cell long, visits boolean, n int, id long, label long, counts binary, raw binary")
    met = lambda x: x.repartition("cell").sortWithinPartitions("cell", "visits", "n", "id")
    found = met(df).mapInArrow(jaccard._residual(80, 1), "a long, b long")
    assert {tuple(x) for x in found.collect()} == {(0, 1), (0, 2), (0, 3)}
    near = met(df.drop("raw")).mapInArrow(jaccard._touching(80), "a long, b long").collect()
    assert {x for p in near for x in p} >= {0, 1, 2, 3} and len(near) < 5


@pytest.mark.parametrize("rounds", [0, 2])
def test_crowded_cells_are_spread(spark, rounds):
    """Cells that are cut by joins, around pivots or in blocks, keep every pair that the whole cell has."""
    r = np.random.default_rng(4)
    base = r.poisson(6, (12, jaccard.BUCKETS))
    counts = np.maximum(np.repeat(base, 25, 0) + r.integers(-1, 2, (300, jaccard.BUCKETS)) * (r.random((300, jaccard.BUCKETS)) < 0.15), 0)
    n = counts.sum(1)
    rows = [(7 if k % 10 else 8, False, int(n[k]), k, k % 40, counts[k].astype(np.uint8).tobytes()) for k in range(300)]
    df = spark.createDataFrame(rows, "cell long, visits boolean, n int, id long, label long, counts binary")
    cut = jaccard.spread(df, 80, crowd=20, rounds=rounds)
    assert cut.where("NOT visits").groupBy("cell").count().agg({"count": "max"}).first()[0] < 150
    found = cut.repartition("cell").sortWithinPartitions("cell", "visits", "n", "id").mapInArrow(jaccard._residual(80), "a long, b long").distinct()
    far = np.abs(counts[:, None] - counts[None]).sum(2)
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if (a % 10 == 0) == (b % 10 == 0) and a % 40 != b % 40 and far[a, b] * 180 <= 20 * (n[a] + n[b])}
    assert want and {tuple(p) for p in found.collect()} == want


def test_words_with_equal_polynomial_hashes_are_not_linked(spark):
    """A Thue-Morse word and its complement: any polynomial modulo 2**64 gives both the same value."""
    signs = [0]
    for _ in range(10):
        signs += [1 - x for x in signs]
    rows = [(k + 1, "".join("ab"[x ^ k] for x in signs)) for k in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(jaccard.jaccard_join(df, 3, 90), [(1, 1, 1), (2, 1, 2)])
    assert decontaminate.overlaps(df, spark.createDataFrame([(1, " ".join([rows[0][1]] * 8))], "item_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, rows[0][1] + "c" + rows[1][1])], "doc_id long, text string")
    same(repeats.removed(twice), brute.removed([(1, rows[0][1] + "c" + rows[1][1])]))


# -- repeats --------------------------------------------------------------------------


def shared_passages(r: random.Random) -> list[tuple]:
    passages = [pieces(r, r.choice([30, 50, 120])) for _ in range(5)]
    rows = [(i, t) for i, t in odd_texts() if len(brute.raw(t)) < 50_000]
    for n in range(60):
        rows.append((200 + n, " ".join(pieces(r, r.randrange(0, 90)) if r.random() < 0.5 else (p := r.choice(passages))[r.randrange(len(p) // 3) :] for _ in range(r.randrange(1, 6)))))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_repeats(spark, seed):
    rows = shared_passages(random.Random(seed))
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, raw string, key string")
    same(repeats.removed(df), brute.removed(rows))


@pytest.mark.parametrize("band", [3, 12])
def test_large_groups_are_halved(spark, monkeypatch, band):
    """A passage in many surroundings: groups over the band are split down to single strings."""
    monkeypatch.setattr(repeats, "BAND", band)
    r = random.Random(8)
    passage = pieces(r, 60)[:240]
    rows = [(n, pieces(r, r.randrange(0, 20)) + passage[r.randrange(0, 30) : 240 - r.randrange(0, 30)] + pieces(r, r.randrange(0, 20))) for n in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(repeats.removed(df), brute.removed(rows))


def test_repeats_on_tables(spark, real, empty, sf_dir):
    same(queries.op7_repeats(spark, sf_dir), brute.removed(real))
    assert repeats.removed(empty).count() == 0


def test_without_repeats_keeps_columns(odd):
    kept = repeats.without_repeats(odd)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    rows = odd_texts()
    want = []
    for (i, t), spans in zip(rows, brute.removed_spans([t for _, t in rows])):
        raw, parts, at = brute.raw(t), [], 0
        for a, e in [*spans, (len(raw), len(raw))]:
            parts.append(raw[at:a].decode("utf-8", "ignore"))
            at = e
        want.append((i, None if t is None else "".join(parts)))
    assert got == sorted(want, key=repr)


# -- decontamination --------------------------------------------------------------------


def test_overlaps(spark, real, odd, empty, sf_dir):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in queries.op6_decontamination(spark, sf_dir).collect()}
    assert got == brute.overlaps(real, items)
    frame = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (None, "no id at all for these words here now ok", "z"), (3, "one", "z")], "item_id long, text string, words string")
    assert decontaminate.overlaps(odd, frame).count() == 0
    assert decontaminate.overlaps(empty, frame).count() == 0 and decontaminate.overlaps(odd, frame.limit(0)).count() == 0
    assert decontaminate.keep_clean(odd, frame).collect() == odd.collect()


@pytest.mark.parametrize("changed", [(), (6,), (0, 12), (3, 9), (5, 7), (4, 8)])
def test_substitutions_are_found(spark, changed):
    item = [f"term{k}" for k in range(13)]
    words = [f"x{k}" if k in changed else w for k, w in enumerate(item)]
    docs = spark.createDataFrame([(1, "before it " + " ".join(words) + " after"), (2, " ".join(item[:6]))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    assert [(r["doc_id"], r["n_equal"]) for r in decontaminate.overlaps(docs, bench).collect()] == [(1, 13 - len(changed))]


def test_masks_cover_all_that_counts():
    from itertools import combinations

    for size in range(6, 14):
        allowed = max(k for k in range(size) if (size - k) * decontaminate.WINDOW >= decontaminate.NEED * size)
        for bad in combinations(range(size), allowed):
            assert any(all(p + k not in bad for k, bit in enumerate(m) if bit == "1") for m in decontaminate.MASKS for p in range(size + 1 - len(m))), (size, bad)


def test_one_word_many_times_over(spark):
    docs = spark.createDataFrame([(1, "x " * 8000), (2, "x " * 10 + "y z " * 300), (3, "x " * 4)], "doc_id long, text string")
    items = spark.createDataFrame([(5, "x " * 200), (6, "y z " * 20)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["n_equal"]) for r in decontaminate.overlaps(docs, items).collect()} == {(1, 5, 13), (2, 6, 13)}


def test_a_full_bit_table_loses_nothing(spark, real, sf_dir, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(map(tuple, decontaminate.overlaps(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "MOST_BITS", 1 << 10)
    assert sorted(map(tuple, decontaminate.overlaps(docs, items).collect())) == want


def test_items_without_an_id_clean_too(spark):
    item = " ".join(f"q{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "nothing of it " * 10)], "doc_id long, text string")
    items = spark.createDataFrame([(None, item), (None, None)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.keep_clean(docs, items).collect()] == [2]
    assert decontaminate.overlaps(docs, items).count() == 0
