"""Byte-level BPE: encoding with a merge queue, decoding by concatenation.

A word is a doubly linked list of symbols.  A priority queue holds every
adjacent pair that has a merge rank; the lowest rank, leftmost first, is merged,
the two new neighbours are queued, and queue entries whose symbols have changed
meanwhile are dropped.  Words that are met for the first time are merged side by
side in lanes: each lane has its list and its queue, and a step takes the lowest
entry of every lane.  Long words, and few ones, have a heap each.  Texts are cut
where a pre-token begins, and each distinct piece of a band of texts is looked up
once.  Decoding joins the vocabulary's byte strings.

Defined results: a null text is encoded as an empty one (no ids); repeated rows
give repeated rows; an empty table gives an empty table; other columns are
ignored by ``encode_decode`` and kept by ``normalize_texts``.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocab import BYTE_BPE, RecentCache, byte_letters, default_path, held, load_spec

#: Entries kept by a worker for pieces of text, and for words.
PIECE_ENTRIES, WORD_ENTRIES = 600_000, 300_000
#: The same for ``encode``, a stage among others in workers and executors that have grown before it.
FEW_PIECES, FEW_WORDS = 100_000, 50_000
#: Texts whose ids ``encode`` holds at a time, and bytes of text that ``encode_decode`` encodes at a time.
SLICE, BAND = 256, 1 << 23
#: Words that are merged side by side at most, bytes of a word there at most, and words for which lanes pay.
LANES, LANE_BYTES, FEW = 4096, 64, 16

_ACCENTED = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
_LETTER = rb"(?:[A-Za-z]|" + _ACCENTED + rb")"
#: Pieces of ASCII and letters of Latin-1, in UTF-8, and the pre-tokens of such a piece.
_LATIN = re.compile(rb"(?:[\t-\r -~]|" + _ACCENTED + rb")*")
_WORDS = re.compile(rb"'(?:[stmd]|re|ve|ll)| ?" + _LETTER + rb"+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\s+(?!\S)|\s+")
_PROBES = ("I'm it's we'd they'll 'tis don't you're I've O'S", "a, b. (c)-d \"e\" 1st 22/7 x_y  z", "a\n\nb\n c \n d\t\te\r\nf \x0bg\x0c ", "été ÀÖØÞ ßöøÿ c'était, l'à!? €", " ", "\n", "...'s 's...9's")
#: Bytes that can stand behind a space where a pre-token begins; those that may begin other white space are left out.
_BEHIND = np.zeros(256, bool)
_BEHIND[[b for b in range(0x21, 256) if b not in (0xC2, 0xE1, 0xE2, 0xE3)]] = True
#: No entry in a queue, no symbol, and what makes a pair's place in the table of merges.
_NONE, _NOTHING, _HASH = (1 << 31) - 1, (1 << 20) - 1, np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 19


class ByteBpe:
    """Encoder and decoder for one byte-level BPE tokenizer file."""

    def __init__(self, path: str, pieces: int = PIECE_ENTRIES, words: int = WORD_ENTRIES):
        from tokenizers import Tokenizer

        spec = load_spec(path)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.base = np.array([vocab[byte_letters()[b]] for b in range(256)], np.int32)
        #: left and right id in one number -> rank and merged id in one number
        self.merges = {vocab[a] << 20 | vocab[b]: k << 20 | vocab[a + b] for k, (a, b) in enumerate(merges)}
        self._fill_table()
        byte_of = {letter: b for b, letter in byte_letters().items()}
        size = max(vocab.values()) + 1
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"] if t["content"]}
        size = max([size, *(i + 1 for i in self.specials.values())])
        bytes_of = [b""] * size
        for token, i in vocab.items():
            bytes_of[i] = bytes(byte_of[x] for x in token) if all(x in byte_of for x in token) else token.encode()
        for token, i in self.specials.items():
            bytes_of[i] = token.encode()
        self.bytes_of = strings(bytes_of)
        self.text_of = strings([b"%d," % i for i in range(size)])
        self.special_pattern = re.compile(b"(" + b"|".join(re.escape(s.encode()) for s in self.specials) + b")") if self.specials else None
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.letter_bytes = {ord(letter): b for letter, b in byte_of.items()}
        self.latin = all(_WORDS.findall(p) == self._split(p) for t in _PROBES for p in (t.encode(), *t.encode().split()) if _LATIN.fullmatch(p))
        self.pieces = RecentCache(pieces)
        self.words = RecentCache(words)

    def _fill_table(self) -> None:
        """The merges as arrays: pairs in an open hash table, their ranks beside them, and merged ids by rank."""
        pairs = np.fromiter(self.merges, np.int64, len(self.merges))
        found = np.fromiter(self.merges.values(), np.int64, len(self.merges))
        bits = max(_TABLE_BITS, len(pairs).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.pairs, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        taken: set[int] = set()
        for at, pair, rank in zip((pairs.view(np.uint64) * _HASH >> self.shift).tolist(), pairs.tolist(), (found >> 20).tolist()):
            while at in taken:
                at = at + 1 & self.mask
            taken.add(at)
            self.pairs[at], self.ranks[at] = pair, rank * 2 * LANE_BYTES
        self.merged = np.zeros(int((found >> 20).max(initial=0)) + 1, np.int32)
        self.merged[found >> 20] = found & 0xFFFFF

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, with room for a place below them; ``_NONE`` for pairs that are not merged."""
        pairs = left.astype(np.int64) << 20 | right
        at = (pairs.view(np.uint64) * _HASH >> self.shift).view(np.int64)
        there = self.pairs[at]
        out = self.ranks[at]
        other = np.flatnonzero(there != pairs)
        out[other] = _NONE
        other = other[there[other] >= 0]
        while len(other):
            at[other] = at[other] + 1 & self.mask
            there = self.pairs[at[other]]
            same = there == pairs[other]
            out[other[same]] = self.ranks[at[other[same]]]
            other = other[~same & (there >= 0)]
        return out

    def _split(self, piece: bytes) -> list[bytes]:
        """Pre-tokens by the tokenizer file's own rules."""
        return [w.translate(self.letter_bytes).encode("latin-1") for w, _ in self.split(piece.decode())]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids (32-bit integers) of pre-tokens."""
        found = [b""] * len(words)
        order = sorted((k for k, w in enumerate(words) if len(w) <= LANE_BYTES), key=lambda k: len(words[k]))
        if len(order) < FEW:
            order = []
        for k in range(0, len(order), LANES):
            some = order[k : k + LANES]
            for j, ids in zip(some, self._lanes([words[j] for j in some])):
                found[j] = ids
        return [ids or self._merged(self.base[[*w]].tolist()) for w, ids in zip(words, found)]

    def _lanes(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are merged side by side, a lane for each, symbols by place and lane."""
        lanes, sizes = len(words), np.array([*map(len, words)])
        longest = int(sizes.max())
        place = np.arange(longest + 1, dtype=np.int32)[:, None]
        # behind the longest word's last symbol stands nothing: neighbours that do not exist lie there
        ids = np.full((longest + 1, lanes), _NOTHING, np.int32)
        ids.T[place.T < sizes[:, None]] = self.base[np.frombuffer(b"".join(words), np.uint8)]
        after = np.where(place + 1 < sizes, place + 1, np.int32(longest))
        before = np.broadcast_to(np.where(place > 0, place - 1, np.int32(longest)), ids.shape).copy()
        queue = np.full(ids.shape, _NONE, np.int32)
        queue[:-1] = self._ranked(ids[:-1].ravel(), ids[1:].ravel()).reshape(longest, lanes) | place[:-1]
        done, own = np.empty((longest, lanes), np.int32), np.arange(lanes)
        while True:
            lowest = queue[:-1].min(0)
            lane = np.flatnonzero(lowest != _NONE)
            if len(lane) <= 0.8 * len(lowest):
                # lanes whose queue is empty are done, the others move together
                ended = np.flatnonzero(lowest == _NONE)
                done[:, own[ended]] = ids[:-1, ended]
                if not len(lane):
                    break
                ids, after, before, queue = (np.ascontiguousarray(x[:, lane]) for x in (ids, after, before, queue))
                own, lowest = own[lane], lowest[lane]
                lane = np.arange(len(lane))
            else:
                lowest = lowest[lane]
            n = len(own)
            symbol, next_, last, entry = ids.ravel(), after.ravel(), before.ravel(), queue.ravel()
            k = lowest & (2 * LANE_BYTES - 1)
            here = k * n + lane
            right = next_[here] * n + lane
            symbol[here] = new = self.merged[lowest // (2 * LANE_BYTES)]
            symbol[right], entry[right] = -1, _NONE
            next_[here] = far = next_[right]
            far = far * n + lane
            last[far] = k
            near = last[here]
            left = near * n + lane
            rank = self._ranked(np.concatenate([new, symbol[left]]), np.concatenate([symbol[far], new]))
            entry[here], entry[left] = rank[: len(k)] | k, rank[len(k) :] | near
        done = done.T
        stays = (done >= 0) & (done != _NOTHING)
        upto = np.cumsum(4 * stays.sum(1)).tolist()
        raw = done[stays].tobytes()
        return [raw[a:b] for a, b in zip([0, *upto], upto)]

    def _merged(self, ids: list[int]) -> bytes:
        n, ranked, spot = len(ids), self.merges.get, (1 << 32) - 1
        queue = [m >> 20 << 32 | k for k in range(n - 1) if (m := ranked(ids[k] << 20 | ids[k + 1])) is not None]
        if not queue:
            return array("i", ids).tobytes()
        heapify(queue)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while queue:
            entry = heappop(queue)
            k = entry & spot
            right = after[k]
            if right < 0 or ids[k] < 0 or (m := ranked(ids[k] << 20 | ids[right])) is None or m >> 20 != entry >> 32:
                continue  # stale: one of the two symbols has gone or changed
            ids[k] = merged = m & 0xFFFFF
            ids[right] = -1
            after[k] = far = after[right]
            if far >= 0:
                before[far] = k
                if (m := ranked(merged << 20 | ids[far])) is not None:
                    heappush(queue, m >> 20 << 32 | k)
            left = before[k]
            if left >= 0 and (m := ranked(ids[left] << 20 | merged)) is not None:
                heappush(queue, m >> 20 << 32 | left)
        return array("i", [i for i in ids if i >= 0]).tobytes()

    def fresh(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces that begin and end where pre-tokens do."""
        cut = [_WORDS.findall(p) if self.latin and _LATIN.fullmatch(p) else self._split(p) for p in pieces]
        known = {w: self.words.get(w) for ws in cut for w in ws}
        missing = [w for w, ids in known.items() if ids is None]
        for w, ids in zip(missing, self.merge(missing)):
            known[w] = ids
            if len(w) <= 64:
                self.words.keep(w, ids)
        return [known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws]) for ws in cut]

    def batch(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; special strings in it become their special ids."""
        special = {k for k, raw in enumerate(texts) if self.special_pattern and self.special_pattern.search(raw)}
        plain = [b"" if k in special else raw for k, raw in enumerate(texts)]
        raw, ends = b"".join(plain), np.cumsum([0, *map(len, plain)])
        if raw:
            starts, number, pieces = distinct_pieces(raw, np.unique(ends[:-1][np.diff(ends) > 0]))
            found = [*map(self.pieces.get, pieces)]
            missing = [k for k, ids in enumerate(found) if ids is None]
            for k, ids in zip(missing, self.fresh([pieces[k] for k in missing])):
                found[k] = ids
                if len(pieces[k]) <= 64:
                    self.pieces.keep(pieces[k], ids)
            # the bytes of all pieces' ids in the order of the text, and where each begins
            _, upto, data = pa.array(found, pa.large_binary()).take(number).buffers()
            upto = np.frombuffer(upto, np.int64, len(number) + 1) >> 2
            cuts = upto[np.searchsorted(starts, ends)].tolist()
            ids = np.frombuffer(data, np.int32, cuts[-1])
        else:
            cuts, ids = [0] * len(ends), np.zeros(0, np.int32)
        return [self._with_specials(texts[k]) if k in special else ids[a:b] for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]

    def _with_specials(self, raw: bytes) -> np.ndarray:
        parts = self.special_pattern.split(raw)
        own = [np.array([self.specials[p.decode()]], np.int32) for p in parts[1::2]]
        between = self.batch(parts[::2])
        return np.concatenate([x for pair in zip(between, own) for x in pair] + between[-1:])

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text."""
        return self.batch([text.encode()])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return concatenated(ids, *self.bytes_of)

    def digest(self, ids: np.ndarray) -> str:
        return hashlib.sha256(concatenated(ids, *self.text_of)[:-1]).hexdigest()


def distinct_pieces(raw: bytes, texts: np.ndarray) -> tuple[np.ndarray, pa.Array, list[bytes]]:
    """Where pieces of texts start, the number of each, and the piece of each number; ``texts``: where the texts that are not empty start.

    A pre-token starts at every space with something else than white space behind it.
    """
    own = np.frombuffer(raw, np.uint8)
    first = own == 0x20
    first[:-1] &= _BEHIND[own[1:]]
    first[texts[1:] - 1] = first[-1] = False
    first[texts] = True
    starts = np.flatnonzero(first)
    offsets = np.append(starts, len(own))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    _, ends, data = coded.dictionary.buffers()
    ends, data = np.frombuffer(ends, np.int64, len(coded.dictionary) + 1).tolist(), data.to_pybytes()
    return starts, coded.indices, [data[a:e] for a, e in zip(ends, ends[1:])]


def strings(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings in one array, and where each begins and how long it is."""
    sizes = np.array([len(v) for v in values], np.int64)
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(sizes) - sizes, sizes


def concatenated(ids: np.ndarray, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int = 1 << 18) -> bytes:
    """The strings of these ids one after the other."""
    out = []
    for k in range(0, len(ids), step):
        some = ids[k : k + step]
        n = sizes[some]
        ends = np.cumsum(n)
        out.append(letters[np.arange(ends[-1]) + np.repeat(starts[some] - ends + n, n)].tobytes())
    return b"".join(out)


def codec(path: str, pieces: int = PIECE_ENTRIES, words: int = WORD_ENTRIES) -> ByteBpe:
    return held(("bpe", path, pieces, words), lambda: ByteBpe(path, pieces, words))


def _raw(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def _bands(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Neighbouring texts of about ``BAND`` bytes together, or one larger text."""
    band, size = [], 0
    for raw in texts:
        if band and size + len(raw) > BAND:
            yield band
            band, size = [], 0
        band.append(raw)
        size += len(raw)
    if band:
        yield band


def encode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` array<int> of every whole text."""
    path = tokenizer or default_path(BYTE_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, FEW_PIECES, FEW_WORDS)
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                b = whole.slice(k, SLICE)
                yield pa.record_batch([b.column(0), pa.array(c.batch(_raw(b.column(1))), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(ids: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` from the rows of ``encode``; null ids give an empty text."""
    path = tokenizer or default_path(BYTE_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([c.decode(np.array(i.as_py() or [], np.int32)).decode("utf-8", "replace") for i in b.column(1)], pa.string())], names=["doc_id", "text"])

    rows = ids.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def encode_decode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of every whole text's ids and of what they decode to.

    Columns: ``doc_id``, ``n_tokens`` long, ``ids_sha256`` and
    ``decoded_sha256``.  One pass over the input and no shuffle.
    """
    path = tokenizer or default_path(BYTE_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, a, d = [], [], []
            for texts in _bands(_raw(b.column(1))):
                for ids in c.batch(texts):
                    n.append(len(ids))
                    a.append(c.digest(ids))
                    d.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
