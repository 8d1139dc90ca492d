"""The corpus pipeline against plain versions of its stages, each on its own input."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from posegrid.llm.storage import written  # noqa: E402


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf_dir), name))
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(df.columns == steps[0].columns for df in steps[1:-1])


def test_toxicity_stage(spark, steps, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
    there, kept = ({i for i, _ in rows(df)} for df in steps[:2])
    # the tables of these tests have a dozen toxic texts to learn from; accuracy is tested on larger ones
    assert kept <= there and len((toxic & there) - kept) >= 0.5 * len(toxic & there) and len(clean & kept) >= 0.95 * len(clean & there)


def test_near_copies_stage(steps):
    found = brute.jaccard_components(rows(steps[1]), 5, 80)
    assert {i for i, _ in rows(steps[2])} == {i for i, _, c in found if i == c}


def test_repeats_stage(steps):
    own, kept = rows(steps[2]), dict(rows(steps[3]))
    assert set(kept) == {i for i, _ in own}
    for (i, t), spans in zip(own, brute.removed_spans([t for _, t in own])):
        raw, at, parts = brute.raw(t), 0, []
        for a, e in [*spans, (len(raw), len(raw))]:
            parts.append(raw[at:a].decode("utf-8", "ignore"))
            at = e
        assert kept[i] == (None if t is None else "".join(parts))


def test_leaks_stage(spark, steps, sf_dir):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    own = rows(steps[3])
    gone = {d for d, _ in brute.overlaps(own, items)}
    assert {i for i, _ in rows(steps[4])} == {i for i, _ in own} - gone


def test_encoding_stage(steps):
    from tokenizers import Tokenizer

    from posegrid.llm import vocab

    t = Tokenizer.from_file(vocab.default_path(vocab.BYTE_BPE))
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in rows(steps[4])}
    assert {r["doc_id"]: list(r["ids"]) for r in steps[5].collect()} == want


def test_run_is_the_stages(spark, steps, sf_dir):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, steps[-1].collect()))


def test_repeated_rows_keep_one_text(spark, sf_dir, tmp_path):
    """Repeated ids, texts and null ids: one copy of a text leaves the pipeline whole, and texts that share an id stay."""
    from collections import Counter

    from tokenizers import Tokenizer

    from posegrid.llm import vocab
    from test_texts import repeated

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = docs.agg({"doc_id": "max"}).first()[0]
    import random

    rows = [(None if i is None else i + top, t) for i, t in repeated(random.Random(9))]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    docs.unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    t = Tokenizer.from_file(vocab.default_path(vocab.BYTE_BPE))
    ids = lambda x: tuple(t.encode(x, add_special_tokens=False).ids)
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r["doc_id"] is None or r["doc_id"] > top)
    c, d = ({ids(x) for x in own} for own in ([x for i, x in rows if i is None][2:5], [x for i, x in rows if i is None][5:6]))
    nulls = Counter(k for (i, k), n in got.items() if i is None for _ in range(n))
    assert sum(nulls[k] for k in c) == 1 and all(nulls[k] == 1 for k in d) and nulls[()] == 2 and sum(nulls.values()) == 4
    named = {i - top: sorted(k for (j, k), n in got.items() if j == i for _ in range(n)) for i in {j for j, _ in got} - {None}}
    assert named.keys() == {30, 31, 33, 34} and named[30] == [ids(rows[0][1])] and named[31] == [ids(rows[2][1])]
    assert len(named[33]) == 1 and named[33][0] in {ids(rows[11][1]), ids(rows[12][1])} and named[34] == [ids(" ")] * 2


CLASHING = "doc_id long, text string, key string, t string, raw string, cells string, `row` string, h string, u string, there string, ids string, `a.b` string"


def odd_docs(spark):
    from test_texts import odd_texts

    rows = [(i, t, *["z" if k % 2 else None for k in range(10)]) for i, t in odd_texts() if len(brute.raw(t)) < 6000 or i == 5]
    return spark.createDataFrame(rows, CLASHING)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_on_odd_and_empty_tables(spark, sf_dir, stage):
    """Nulls, empty and very long texts, repeated rows and columns of any name; what stays is as it was."""
    docs = odd_docs(spark)
    out = stage[1](spark, docs, sf_dir)
    assert out.columns == docs.columns
    was, found = [(r["doc_id"], r["text"]) for r in docs.collect()], out.collect()
    got = [(r["doc_id"], r["text"]) for r in found]
    assert all([r[c] for c in docs.columns[2:]] == ["z" if k % 2 else None for k in range(10)] for r in found)
    want = {
        "toxicity": sorted(was, key=repr), "benchmark_decontamination": sorted(was, key=repr),
        "ngram_jaccard_join": None, "suffix_array_dedup": None,
    }[stage[0]]
    if want is not None:
        assert sorted(got, key=repr) == want
    elif stage[0] == "ngram_jaccard_join":
        order = sorted(was, key=lambda x: (x[0] is None, x[0] or 0))
        groups = {c for _, _, c in brute.jaccard_components(list(enumerate(t for _, t in order)), 5, 80)}
        assert len(got) == len(groups) and len([x for x in got if x[1] is None]) == 2
    else:
        assert sorted(i or 0 for i, _ in got) == sorted(i or 0 for i, _ in was) and sum(t is None for _, t in got) == 2
    assert stage[1](spark, docs.limit(0), sf_dir).count() == 0


def test_encoding_of_odd_and_empty_tables(spark, sf_dir):
    docs = odd_docs(spark)
    got = corpus_pipeline.encode(spark, docs, sf_dir).collect()
    assert len(got) == docs.count() and all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert [r["n_tokens"] for r in got if r["doc_id"] in (1, 2)] == [0, 0]
    assert corpus_pipeline.encode(spark, docs.limit(0), sf_dir).count() == 0


def test_nothing_is_left_behind(spark, sf_dir):
    """What a run writes on its way is deleted, but for its result and the small tables that lazy results read."""
    from pathlib import Path

    from posegrid.llm.storage import shared_dir

    top = Path(shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in top.iterdir()}
    corpus_pipeline.run(spark, sf_dir).count()
    new = {p.name.rpartition("-")[0] for p in top.iterdir() if p.name not in before}
    assert new <= {"pipeline-bpe_encoding", "jaccard-rows", "jaccard-roots", "repeat-ranges", "benchmark-overlaps"}, new
