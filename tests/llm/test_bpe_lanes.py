"""Words are merged side by side with the library's ids, and each distinct piece and word once."""

from __future__ import annotations

import random

from tokenizers import Tokenizer

from posegrid.llm import bpe, vocab

PATH = vocab.default_path(vocab.BYTE_BPE)


def test_lanes_give_what_heaps_give():
    c, r = bpe.ByteBpe(PATH), random.Random(3)
    words = [" " + "".join(r.choice(["th", "e", "ing", "é", "on", "q", "ß", "er", "xx"]) for _ in range(r.randrange(1, 12))) for _ in range(300)]
    words = [w.encode() for w in words] + [b"a", b" ", b"x" * bpe.LANE_BYTES, b"y" * (bpe.LANE_BYTES + 1), b"ab" * 500]
    heaps = c._merged
    want = [heaps(c.base[[*w]].tolist()) for w in words]
    asked = []
    c._merged = lambda ids: asked.append(len(ids)) or heaps(ids)
    assert c.merge(words) == want
    assert all(n > bpe.LANE_BYTES for n in asked)  # only the long ones have heaps


def test_a_word_is_merged_once():
    c, asked = bpe.ByteBpe(PATH), []
    own = c.merge
    c.merge = lambda words: asked.extend(words) or own(words)
    text = "the threnody, the threnody. The thréné\nthe threnody 'tis 22 it's"
    c.batch([text.encode(), text.encode()])
    c.batch([text.encode()])
    assert len(asked) == len(set(asked)) and asked.count(b" threnody") == 1


def test_pieces_begin_where_pre_tokens_do():
    c, library, r = bpe.ByteBpe(PATH), Tokenizer.from_file(PATH), random.Random(4)
    some = [*"   \n\t\r\x0b\x0c aBéß×÷1²½ªµ',.!", "　", " ", " ", "\u0085", " ", "'s", "'ll", "中", "🙂", "\x1c", "\0", "<|endoftext|>", "​"]
    texts = ["".join(r.choice(some) for _ in range(r.randrange(30))) for _ in range(1500)] + ["", " ", "a ", " a"]
    got = c.batch([t.encode() for t in texts])
    assert c.latin
    for t, ids in zip(texts, got):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t
        assert c.decode(ids) == t.encode()
    assert c.batch([]) == []
