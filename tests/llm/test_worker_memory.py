"""What a worker keeps from one operator to the next."""

from __future__ import annotations

import re
from pathlib import Path

from posegrid.llm import bpe, vocab


def _mb() -> float:
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_freed_memory_goes_back(monkeypatch):
    """Small blocks that are free but lie among used ones do not stay with the worker."""
    monkeypatch.setattr(vocab, "_HELD", {})
    some = [bytes(1000) for _ in range(300_000)]
    pinned = some[::2000]
    del some
    before = _mb()
    vocab.held(("probe",), lambda: pinned)
    assert before - _mb() > 150


def test_a_stage_keeps_fewer_words(spark, monkeypatch):
    """``encode`` gives its ids by slices and with small caches."""
    asked = []
    found = bpe.codec(bpe.default_path(bpe.BYTE_BPE), 10, 5)
    monkeypatch.setattr(bpe, "codec", lambda *x: asked.append(x[1:]) or found)
    # the function that a task gets, called here
    frame = type("Frame", (), {"mapInArrow": lambda self, f, kinds: f, "schema": spark.range(1).toDF("doc_id").schema})()
    docs = type("Docs", (), {"select": lambda self, *c: frame})()
    import pyarrow as pa

    texts = [f"word{k} again{k % 7}." for k in range(600)]
    out = list(bpe.encode(docs)([pa.record_batch([pa.array(range(600)), pa.array(texts)], names=["doc_id", "text"])]))
    assert asked == [(bpe.FEW_PIECES, bpe.FEW_WORDS)] and max(b.num_rows for b in out) <= bpe.SLICE
    assert [x for b in out for x in b.column("ids").to_pylist()] == [found.encode(t).tolist() for t in texts]
    assert len(found.pieces) <= 10 and len(found.words) <= 5
