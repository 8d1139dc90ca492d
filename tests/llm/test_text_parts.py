"""Letters in lower case and marks are looked up apart; large blocks have many short lanes."""

from __future__ import annotations

import random

import numpy as np

from posegrid.llm import coder, token_files, vocab


def test_letters_and_marks_are_parts():
    raw = "The the, THE. Été été! don't a.b a1 <|ENDOFTEXT|> ... x×y".encode()
    starts, number, parts = token_files.distinct_parts(raw)
    got = [parts[k].decode() for k in number.to_pylist()]
    assert got == ["the", "the", ",", "the", ".", "été", "été", "!", "don't", "a.b", "a1", "<|ENDOFTEXT|>", "...", "x×y"]
    assert len(parts) == len(set(parts)) and starts.tolist() == sorted(set(starts.tolist()))
    assert token_files.distinct_parts(raw, False)[2][:3] == [b"The", b"the,", b"THE."]
    assert token_files.distinct_parts(b" \n")[2] == []


def test_parts_give_what_the_library_gives():
    e, r = token_files.ChunkEncoder(vocab.default_path(vocab.WORD_BPE)), random.Random(7)
    some = [*"  \n\taBéÉßÞ×÷ÿ1²ª',.!<|", "'s", "'LL", "́", "中", "İ", "\x00", "\x1c", "\u0085", " ", "<|endoftext|>"]
    texts = ["".join(r.choice(some) for _ in range(r.randrange(30))) for _ in range(1500)]
    assert e.simple
    for _ in range(2):  # anew, and from what is known then
        for t, ids in zip(texts, e.batch([t.encode() for t in texts])):
            assert ids.tolist() == e.library.encode(t, add_special_tokens=False).ids, t


def test_large_blocks_have_short_lanes(monkeypatch):
    monkeypatch.setattr(coder, "_MANY", 10_000)
    ids = np.random.default_rng(1).zipf(1.3, 50_001) % 49_000
    assert coder._layout(len(ids))[0] == len(ids) // coder.STEPS
    data = coder.pack(ids)
    assert np.array_equal(coder.unpack(data), ids) and len(data) < 4 * len(ids)
    assert coder._layout(coder.BLOCK)[0] == coder.LANES
