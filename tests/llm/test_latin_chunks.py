"""Chunks of Latin letters go to the library's model, with the library's ids; equal letters go once."""

from __future__ import annotations

from posegrid.llm import token_files, vocab


def test_latin_letters_go_to_the_model():
    e = token_files.ChunkEncoder(vocab.default_path(vocab.WORD_BPE))
    asked = []
    own = e.modelled
    e.modelled = lambda part: asked.append(part) or own(part)
    chunks = [w.encode() for w in ("Été", "éTÉ", "été,", "été...", "STRASSE", "straße!", "a×b", "a÷", "l'été", "x1", "naïve.)", "ÿÞø")]
    got = e.fresh(chunks)
    assert e.simple
    for c, ids in zip(chunks, got):
        assert ids == token_files.array("I", e.library.encode(c.decode(), add_special_tokens=False).ids).tobytes(), c
    assert "été".encode() in asked and b"strasse" in asked and len(asked) == len(set(asked))


def test_white_space_of_all_kinds():
    e = token_files.ChunkEncoder(vocab.default_path(vocab.WORD_BPE))
    texts = ["", " ", "\x0ba\x0c", "a\tb\r\nc  d", "　x y", "été\n", "word word\tword\nword", "<|endoftext|> a"]
    for t, ids in zip(texts, e.batch([t.encode() for t in texts])):
        assert ids.tolist() == e.library.encode(t, add_special_tokens=False).ids
    assert e.batch([]) == []
