"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts of the n-grams of the training texts are quantised to levels that grow
by a constant factor.  An n-gram of level q is entered in the filter q times,
as (n-gram, 1) to (n-gram, q), so its level is the number of membership probes
that succeed one after the other; a probe never misses what was entered.
Probabilities are smoothed from the shortest n-gram to the longest:
``P(w|h) = (c(h w) + mu * P(w|shorter h)) / (c(h) + mu)``.

The filter is made of parts, one for each cell of the n-grams' hashes, every
one as large as its own entries need.  While all parts together stay below
``BROADCAST_BYTES`` they are broadcast to the workers.  A larger filter stays
where it was written, cut into shards of many cells: ``UNIT`` bands of text together
send their distinct n-grams to the shards and get the levels back, with the same
results.

Exact counts of tokens stand beside it.  Words of at most 15 bytes are their own
key, longer ones are known by 15 bytes of their BLAKE2b digest.  Of tokens that
make up at least one in ``SHARE`` of the corpus there are at most ``SHARE``;
they go to all tasks, and the others, none of which is frequent, meet their
counts in a join.

Defined results: a null text is an empty one, whose only token is the end; very
long texts are taken in bands cut at white space, with the words before as
context; a null id counts as an empty text for the folds; equal rows give equal
rows; an empty table gives an empty one, and with nothing to learn from, every
probability is 1; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact import peeked
from .shingles import _LOWER, SPACE, mix
from .storage import drop, written

_U = np.uint64
#: Words of the longest n-grams, and weight of the shorter history in a probability.
ORDER, MU = 2, 300.0
#: The least count of each level is this times the one before, or one more.
GROWTH = 1.5
#: Bits of the filter for each entry; an entry sets three bits in each of two words.
BITS = 10
#: Filters up to this size are broadcast.
BROADCAST_BYTES = 128 << 20
#: Tokens that at least one in so many is, have their counts sent to all tasks.
SHARE = 65_536
#: Bytes of text that a task looks at together, n-grams that it holds before it
#: hands them on, and n-grams (with repeats) that a cell stands for.
BAND, HELD, CELL = 1 << 20, 1_000_000, 1 << 21
#: Bands that ask a larger filter together, and bytes of such a filter that answer
#: together.  A message is what a unit asks of a shard: there are as many as units
#: times shards, so both are large.
UNIT, SHARD_BYTES = 16, 4 << 20

_ODD = _U(0xD6E8FEB86659FD93)
_STEP = _U(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_PART = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def thresholds() -> np.ndarray:
    """The least count of level 1, 2, ..."""
    out = [1]
    while out[-1] < 1 << 62:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return np.array(out, np.int64)


_LEAST = thresholds()


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(_LEAST, counts, side="right")


def typical(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that have this level."""
    middle = np.concatenate([[0.0], (_LEAST[:-1] + _LEAST[1:] - 1) / 2, [float(_LEAST[-1])]])
    return middle[levels]


# --- texts to tokens ---------------------------------------------------------


def bands(rows: Iterator[tuple], order: int) -> Iterator[list[tuple]]:
    """Groups of (key, doc_id, held_out, raw, before, first, last) of at most
    about ``BAND`` bytes.  A longer text is cut at white space; ``before`` has
    the ``order - 1`` words before a piece."""
    group, size = [], 0
    for key, doc_id, held_out, raw in rows:
        if group and size + len(raw) > BAND:
            yield group
            group, size = [], 0
        at, before = 0, b""
        while len(raw) - at > BAND:
            found = _SPACE.search(raw, at + BAND)
            stop = found.start() if found else len(raw)
            if stop == len(raw):
                break
            piece = raw[at:stop]
            yield [(key, doc_id, held_out, piece, before, at == 0, False)]
            if order > 1:
                before = b" ".join((before + b" " + piece).rsplit(None, order - 1)[-(order - 1) :])
            at = stop
        group.append((key, doc_id, held_out, raw[at:], before, at == 0, True))
        size += len(raw) - at + 64
    if group:
        yield group


def word_keys(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that stand for a word: bytes 0 to 7; bytes 8 to 14 and the length."""
    held = np.concatenate([flat, np.zeros(24, np.uint8)])
    eight = np.ndarray(len(flat) + 16, "<u8", held, strides=(1,))
    size = ends - starts
    a = eight[starts] & _PART[np.minimum(size, 8)]
    b = np.where(size > 8, eight[starts + 8] & _PART[np.clip(size - 8, 0, 7)], _U(0)) | (size.astype(_U) << _U(56))
    for k in np.flatnonzero(size > 15):
        digest = hashlib.blake2b(flat[starts[k] : ends[k]].tobytes(), digest_size=15).digest()
        a[k], b[k] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:] + b"\xff", "little")
    return a, b


def key_hash(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    return mix(mix(a ^ (_STEP + _U(salt))) * _ODD + b)


class Tokens:
    """The tokens of a band, each piece behind ``order - 1`` tokens of context.

    ``s``: hashes; ``row``: the piece; ``word``: number in ``a``, ``b`` (the end and
    the begin of a text are the last two); ``new``: tokens of the piece itself;
    ``after``: these, and the last context token, the history of the first;
    ``seen``: ``new``, and the last context token of a text's first piece.
    """

    def __init__(self, band: list[tuple], order: int):
        pieces = [x for r in band for x in (r[4], r[3])]
        flat = _LOWER[np.frombuffer(b" ".join(pieces), np.uint8)]
        edge = np.diff(np.concatenate([[True], SPACE[flat], [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        a, b = word_keys(flat, starts, ends)
        #: the end is the word without letters
        self.a, self.b = np.append(a, _U([0, 0])), np.append(b, _U([0, 254 << 56]))
        self.hash = key_hash(self.a, self.b)
        cuts = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in pieces]))
        first_word = cuts[0::2]  # of the piece: its context's words lie before it
        n_words = cuts[1::2] - first_word
        n_before = first_word - np.concatenate([[0], cuts[1:-1:2]])
        last = np.array([r[6] for r in band])
        first = np.array([r[5] for r in band])
        context = order - 1
        size = context + n_words + last
        base = np.cumsum(size) - size
        total = int(size.sum())
        self.row = np.repeat(np.arange(len(band)), size)
        place = np.arange(total) - base[self.row] - context
        self.new = place >= 0
        word = np.where(self.new, first_word[self.row] + place, len(a) + 1)
        word[(base + size - 1)[last]] = len(a)
        for j in range(1, order):
            own = n_before >= j
            word[(base + context - j)[own]] = (first_word - j)[own]
        self.word, self.s = word, self.hash[word]
        self.seen, self.after = self.new.copy(), self.new.copy()
        if context:
            self.seen[(base + context - 1)[first]] = True
            self.after[base + context - 1] = True
        self.order = order

    def grams(self) -> list[np.ndarray]:
        """Hashes of the n-grams of 1, 2, ... tokens that end at each place."""
        out = [mix(self.s ^ _ODD)]
        for k in range(2, self.order + 1):
            before = np.concatenate([np.zeros(1, _U), out[-1][:-1]])
            out.append(mix(before * _ODD + self.s + _U(k)))
        return out

    def counted(self, k: int) -> np.ndarray:
        """Where n-grams of ``k`` tokens count: histories are shorter than the order."""
        return self.seen if k < self.order else self.new

    def needed(self, k: int) -> np.ndarray:
        """Where scoring asks for n-grams of ``k`` tokens."""
        return self.after if k < self.order else self.new

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """A word number for each distinct word, and which of them each word is."""
        found, which = np.unique(self.hash, return_inverse=True)
        first = np.zeros(len(found), np.int64)
        first[which] = np.arange(len(which))
        if not (np.array_equal(self.a[first][which], self.a) and np.array_equal(self.b[first][which], self.b)):
            _, first, which = np.unique(np.rec.fromarrays([self.a, self.b]), return_index=True, return_inverse=True)
        return first, which


def distinct(x: np.ndarray) -> np.ndarray:
    """The numbers that there are, ascending; sorting is faster here than ``np.unique``."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def combined(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their counts added up."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, n = k[order], n[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[begin], np.add.reduceat(n, begin) if len(begin) else n


def cell_of(grams: np.ndarray, cells: int) -> np.ndarray:
    return ((mix(grams ^ _ODD) >> _U(32)) * _U(cells)) >> _U(32)


# --- the filter --------------------------------------------------------------


def _spots(grams: np.ndarray, j: np.ndarray | int, size: np.ndarray | int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two words of a part of ``size`` words, with three bits in each, of entry (n-gram, j)."""
    x = mix(grams + np.asarray(j).astype(_U) * _STEP)
    out = []
    for _ in range(2):
        mask = np.zeros(len(x), _U)
        for s in (0, 6, 12):
            mask |= _U(1) << ((x >> _U(s)) & _U(63))
        out.append(((((x >> _U(32)) * np.asarray(size).astype(_U)) >> _U(32)).astype(np.int64), mask))
        x = mix(x + _STEP)
    return out


def part(grams: np.ndarray, counts: np.ndarray, per_entry: int = BITS) -> np.ndarray:
    """The filter's part for distinct n-grams of one cell, as 64-bit words."""
    levels = level(counts)
    size = max(1, -(-int(levels.sum()) * per_entry // 64))
    bits = np.zeros(size, _U)
    for j in range(1, int(levels.max(initial=0)) + 1):
        for at, mask in _spots(grams[levels >= j], j, size):
            np.bitwise_or.at(bits, at, mask)
    return bits


@dataclass
class Filter:
    """All parts, one after the other, and where each begins."""

    bits: np.ndarray
    begin: np.ndarray

    @staticmethod
    def of(parts: dict[int, bytes | pa.Buffer], cells: int) -> Filter:
        """Of the parts of some or all cells; n-grams of other cells have level 0."""
        arrays = [np.frombuffer(parts.get(c, b""), _U) for c in range(cells)]
        return Filter(np.concatenate(arrays), np.concatenate([[0], np.cumsum([len(x) for x in arrays])]))

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """The number of probes that succeed, one after the other."""
        out = np.zeros(len(grams), np.int64)
        cell = cell_of(grams, len(self.begin) - 1).astype(np.int64)
        begin, size = self.begin[cell], (self.begin[1:] - self.begin[:-1])[cell]
        live = np.flatnonzero(size > 0)
        j = 0
        while len(live) and j < len(_LEAST):
            j += 1
            (at, m), (at2, m2) = _spots(grams[live], j, size[live])
            hit = (self.bits[begin[live] + at] & m) == m
            hit[hit] = (self.bits[(begin[live] + at2)[hit]] & m2[hit]) == m2[hit]
            live = live[hit]
            out[live] = j
        return out


# --- exact counts ------------------------------------------------------------


class Frequent:
    """Exact counts of the frequent tokens, found by a hash that tells them apart."""

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray):
        a, b = a.view(np.uint64), b.view(np.uint64)
        self.salt = 0
        while len(np.unique(key_hash(a, b, self.salt))) < len(a):
            self.salt += 1
        order = np.argsort(key_hash(a, b, self.salt))
        self.a, self.b, self.c = a[order], b[order], c[order]
        self.hash = key_hash(self.a, self.b, self.salt)

    def counts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The count of each word, 0 for those that are not frequent."""
        if not len(self.a):
            return np.zeros(len(a), np.int64)
        at = np.minimum(np.searchsorted(self.hash, key_hash(a, b, self.salt)), len(self.a) - 1)
        return np.where((self.a[at] == a) & (self.b[at] == b), self.c[at], 0)


# --- learning ----------------------------------------------------------------


@dataclass
class Totals:
    """Tokens of the training texts, distinct ones, words of the longest n-grams,
    and the weight of the shorter history."""

    total: int
    distinct: int
    order: int = ORDER
    mu: float = MU


@dataclass
class Model:
    """``words``: ``a``, ``b``, ``c`` of every token of the training texts; ``parts``:
    ``cell``, ``bits``; ``size`` bytes of filter."""

    totals: Totals
    words: DataFrame
    parts: DataFrame
    cells: int
    size: int


def _texts(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, doc_id, held_out, raw): the key is the row's own in its task."""
    n = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    for b in batches:
        ids, held, raw = b.columns
        for k in range(b.num_rows):
            yield n, ids[k].as_py(), held[k].as_py(), raw[k].as_py()
            n += 1


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a``, ``b``, ``c`` of the words that a task has seen, some times added up."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def added() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, c = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((b, a))
        a, b, c = a[order], b[order], c[order]
        begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return a[begin], b[begin], np.add.reduceat(c, begin)

    def out(words) -> pa.RecordBatch:
        a, b, c = words
        return pa.record_batch([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(c)], names=["a", "b", "c"])

    for band in bands(_rows(batches), 1):
        t = Tokens(band, 1)
        first, which = t.distinct()
        counts = np.bincount(which[t.word], minlength=len(first))
        some = counts > 0
        held.append((t.a[first][some], t.b[first][some], counts[some].astype(np.int64)))
        if sum(len(x[0]) for x in held) > HELD:
            held[:] = [added()]
            if len(held[0][0]) > HELD // 2:
                yield out(held.pop())
    if held:
        yield out(added())


def _count_grams(order: int, cells: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []

        def out():
            k, n = combined(keys, counts)
            keys.clear()
            counts.clear()
            cell = cell_of(k, cells)
            by = np.argsort(cell, kind="stable")
            k, n, cell = k[by], n[by], cell[by]
            edges = np.concatenate([np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])), [len(k)]])
            spans = [*zip(edges[:-1], edges[1:])]
            return pa.record_batch([pa.array([int(cell[x]) for x, _ in spans], pa.int32()), pa.array([k[x:y].tobytes() for x, y in spans], pa.binary()), pa.array([n[x:y].tobytes() for x, y in spans], pa.binary())], names=["cell", "grams", "counts"])

        for band in bands(_rows(batches), order):
            t = Tokens(band, order)
            own = [g[t.counted(k + 1)] for k, g in enumerate(t.grams())]
            k, n = np.unique(np.concatenate(own), return_counts=True)
            keys.append(k)
            counts.append(n)
            if sum(map(len, keys)) > HELD:
                merged = combined(keys, counts)
                keys[:], counts[:] = [merged[0]], [merged[1]]
                if len(merged[0]) > HELD // 2:
                    yield out()
        if keys:
            yield out()

    return run


def _build(per_entry: int) -> Callable:
    """The parts of the cells that a task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        new: dict[int, int] = {}  # n-grams of a cell since they were last added up
        for b in batches:
            for cell, k, n in zip(*(c.to_pylist() for c in b.columns)):
                own = held.setdefault(cell, [])
                own.append((np.frombuffer(k, _U), np.frombuffer(n, np.int64)))
                new[cell] = new.get(cell, 0) + len(own[-1][0])
                if new[cell] > CELL:
                    own[:], new[cell] = [combined(*zip(*own))], 0
        for cell in [*held]:
            grams, counts = combined(*zip(*held.pop(cell)))
            yield pa.record_batch([pa.array([cell], pa.int32()), pa.array([part(grams, counts, per_entry).tobytes()], pa.binary())], names=["cell", "bits"])

    return run


def learn(docs: DataFrame, usable: Column | None = None, order: int = ORDER, mu: float = MU, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts of all tokens and n-grams of the rows that are ``usable``; two passes."""
    rows = _texts(docs if usable is None else docs.where(usable), F.lit(False), id_col, text_col)
    counted = rows.mapInArrow(_count_words, "a long, b long, c long")
    words = written(counted.groupBy("a", "b").agg(F.sum("c").alias("c")), "lm-words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    cells = max(1, -(-total * order // CELL))
    tasks = max(cells, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    grams = rows.mapInArrow(_count_grams(order, cells), "cell int, grams binary, counts binary")
    parts = written(grams.repartition(tasks, "cell").mapInArrow(_build(bits), "cell int, bits binary"), "lm-filter")
    size = parts.agg(F.coalesce(F.sum(F.octet_length("bits").cast("long")), F.lit(0))).first()[0]
    return Model(Totals(total, distinct, order, mu), words, parts, cells, size)


# --- scoring -----------------------------------------------------------------


def log_probabilities(t: Tokens, model: Totals, levels: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The smoothed log10 probability of each new token."""
    at = np.flatnonzero(t.new)
    p = shorter = None
    for k, g in enumerate(t.grams(), 1):
        where = t.needed(k)
        found, which = np.unique(g[where], return_inverse=True)
        counts = np.zeros(len(g))
        counts[where] = typical(levels(found))[which]
        if k == 1:
            p = np.minimum((counts[at] + 0.5) / (model.total + 0.5 * (model.distinct + 1)), 1.0)
        else:
            history = shorter[at - 1]
            # an n-gram is no more frequent than what it contains
            own = np.minimum(counts[at], np.minimum(history, shorter[at]))
            p = (own + model.mu * p) / (history + model.mu)
        shorter = counts
    return np.log10(p)


def asked(t: Tokens) -> np.ndarray:
    """The distinct n-grams that ``log_probabilities`` looks up, ascending."""
    return distinct(np.concatenate([g[t.needed(k)] for k, g in enumerate(t.grams(), 1)]))


_PIECE = "n_tokens long, n_known long, base double, score double, rare array<struct<a:long,b:long,n:long>>"


def score_band(band: list[tuple], model: Totals, hot: Frequent, levels: Callable) -> list[pa.Array]:
    """Columns ``n_tokens``, ``n_known``, ``base``, ``score``, ``rare`` of the pieces of a band.

    ``n_known`` and ``base`` are of the tokens in ``hot``; the others are in ``rare``.
    """
    t = Tokens(band, model.order)
    n = len(band)
    row = t.row[t.new]
    scores = np.bincount(row, weights=log_probabilities(t, model, levels), minlength=n)
    first, which = t.distinct()
    counts = hot.counts(t.a[first], t.b[first])
    word = which[t.word[t.new]]
    own = counts[word]
    known = np.bincount(row, weights=own > 0, minlength=n).astype(np.int64)
    base = np.bincount(row, weights=np.where(own > 0, np.log10(own + 0.5), 0.0), minlength=n)
    some = own == 0
    cell, times = np.unique(row[some] * len(first) + word[some], return_counts=True)
    at, which = cell // max(len(first), 1), cell % max(len(first), 1)
    structs = pa.StructArray.from_arrays([pa.array(x) for x in (t.a[first][which].astype(np.int64), t.b[first][which].astype(np.int64), times.astype(np.int64))], names=["a", "b", "n"])
    rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(n + 1)).astype(np.int32)), structs)
    return [pa.array(np.bincount(row, minlength=n).astype(np.int64)), pa.array(known), pa.array(base), pa.array(scores), rare]


def _piece_batch(band: list[tuple], columns: list[pa.Array], id_type: pa.DataType) -> pa.RecordBatch:
    ids = [pa.array([r[0] for r in band], pa.int64()), pa.array([r[1] for r in band], id_type), pa.array([r[2] for r in band], pa.bool_())]
    names = ["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"]
    return pa.record_batch(ids + columns, names=names)


def _by_broadcast(rows: DataFrame, model: Model, hot) -> DataFrame:
    found = model.parts.toArrow()  # at most BROADCAST_BYTES
    whole = Filter.of({c: b.as_buffer() for c, b in zip(found["cell"].to_pylist(), found["bits"])}, model.cells)
    del found
    held = rows.sparkSession.sparkContext.broadcast(whole)
    del whole
    totals = model.totals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, batches = peeked(batches)
        for band in bands(_rows(batches), totals.order):
            yield _piece_batch(band, score_band(band, totals, hot.value, held.value.levels), head.schema.field(0).type)

    return rows.mapInArrow(run, f"key long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, {_PIECE}")


def _by_shuffle(rows: DataFrame, model: Model, hot) -> tuple[DataFrame, list[DataFrame]]:
    """As ``_by_broadcast``; n-grams go to the filter's shards and their levels come back."""
    spark = rows.sparkSession
    totals, order, cells = model.totals, model.totals.order, model.cells
    shards, together = max(1, min(cells, -(-model.size // SHARD_BYTES))), UNIT
    id_type = rows.schema["doc_id"].dataType.simpleString()
    own = f"band long, key long, doc_id {id_type}, held_out boolean, raw binary, before binary, first boolean, last boolean"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, batches = peeked(batches)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for band in bands(_rows(batches), order):
            kinds = [pa.int64(), head.schema.field(0).type, pa.bool_(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_()]
            columns = [pa.array(x, k) for x, k in zip(zip(*band), kinds)]
            yield pa.record_batch([pa.array([number] * len(band), pa.int64()), *columns], names=["band", "key", "doc_id", "held_out", "raw", "before", "first", "last"])
            number += 1

    pieces = written(rows.mapInArrow(cut, own), "lm-bands")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the pieces of a unit ask of each shard; a unit that lies in two tasks asks twice."""
        number, band, held = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            grams = distinct(np.concatenate(held))
            held.clear()
            if not len(grams):
                return
            shard = (cell_of(grams, cells) * _U(shards)) // _U(cells)
            by = np.argsort(shard, kind="stable")
            grams, shard = grams[by], shard[by]
            edges = np.concatenate([np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), [len(grams)]])
            spans = [*zip(edges[:-1], edges[1:])]
            n = len(spans)
            yield pa.record_batch([pa.array([int(shard[x]) for x, _ in spans], pa.int32()), pa.array([number // together] * n, pa.int64()), pa.array([grams[x:y].tobytes() for x, y in spans], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["shard", "unit", "grams", "cell", "bits"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[0] != number:
                    if band:
                        held.append(asked(Tokens(band, order)))
                    if held and r[0] // together != number // together:
                        yield from out()
                    number, band = r[0], []
                band.append(r[1:])
        if band:
            held.append(asked(Tokens(band, order)))
            yield from out()

    # no shuffle: a piece has the words before it, so it knows what it asks
    questions = pieces.mapInArrow(ask, "shard int, unit long, grams binary, cell int, bits binary")
    of_cell = F.expr(f"CAST(CAST(cell AS long) * {shards} DIV {cells} AS int)")
    both = model.parts.select(of_cell.alias("shard"), F.lit(None).cast("long").alias("unit"), F.lit(None).cast("binary").alias("grams"), "cell", "bits").unionByName(questions)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, whole = None, {}, None
        for b in batches:
            shards_, units, grams, in_cell, bits = b.columns
            for k in range(b.num_rows):
                if (shard := shards_[k].as_py()) != now:
                    now, parts, whole = shard, {}, None
                if not units[k].is_valid:
                    parts[in_cell[k].as_py()] = bits[k].as_py()
                    continue
                if whole is None:
                    whole, parts = Filter.of(parts, cells), {}
                g = np.frombuffer(grams[k].as_buffer(), _U)
                yield pa.record_batch([units[k : k + 1], grams[k : k + 1], pa.array([whole.levels(g).astype(np.uint8).tobytes()], pa.binary())], names=["unit", "grams", "levels"])

    # a shard's parts come before the questions that they answer
    answers = both.repartition("shard").sortWithinPartitions("shard", F.col("unit").asc_nulls_first()).mapInArrow(answer, "unit long, grams binary, levels binary")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in pieces.schema.fields]
    back = answers.select("unit", *none, "grams", "levels").unionByName(pieces.select(F.expr(f"band DIV {together}").alias("unit"), "*", F.lit(None).cast("binary").alias("grams"), F.lit(None).cast("binary").alias("levels")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, number, band, known, kind = None, None, [], [], None
        grams, levels = np.zeros(0, _U), np.zeros(0, np.uint8)

        def out():
            return _piece_batch(band, score_band(band, totals, hot.value, lambda g: levels[np.searchsorted(grams, g)].astype(np.int64)), kind)

        for b in batches:
            kind = b.schema.field("doc_id").type
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if (r[0], r[1]) != (unit, number):
                    if band:
                        yield out()
                    if r[0] != unit:
                        known = []
                    unit, number, band = r[0], r[1], []
                if r[9] is not None:
                    known.append((np.frombuffer(r[9], _U), np.frombuffer(r[10], np.uint8)))
                    continue
                if known:
                    grams, levels = (np.concatenate(x) for x in zip(*known))
                    by = np.argsort(grams)
                    grams, levels, known = grams[by], levels[by], []
                band.append(r[2:9])
        if band:
            yield out()

    # the answers to a unit come before its bands
    scored = back.repartition("unit").sortWithinPartitions("unit", F.col("band").asc_nulls_first(), "key").mapInArrow(finish, f"key long, doc_id {id_type}, held_out boolean, {_PIECE}")
    return scored, [pieces]


def score(docs: DataFrame, model: Model, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``base_score`` is from exact counts of tokens, ``score`` from the filter.
    """
    spark = docs.sparkSession
    rows = _texts(docs, F.lit(False) if held_out is None else held_out, id_col, text_col)
    # at most SHARE rows: each stands for one in SHARE of all tokens
    frequent = F.col("c") * SHARE >= model.totals.total
    found = model.words.where(frequent).toArrow()
    hot = spark.sparkContext.broadcast(Frequent(*(np.array(found[c]) for c in ("a", "b", "c"))))
    scored, left = (_by_broadcast(rows, model, hot), []) if model.size <= BROADCAST_BYTES else _by_shuffle(rows, model, hot)
    pieces = written(scored, "lm-scored")
    drop(*left)
    met = pieces.select("key", F.inline("rare")).join(model.words.where(~frequent), ["a", "b"])
    more = met.select("key", F.col("n").alias("n_known"), (F.col("n") * F.log10(F.col("c") + 0.5)).alias("base"))
    more = more.groupBy("key").agg(F.sum("n_known").alias("n_known"), F.sum("base").alias("base"))
    all_rows = pieces.drop("rare").unionByName(more, allowMissingColumns=True)
    sums = all_rows.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    unknown = (F.col("n_tokens") - F.col("n_known")) * F.lit(float(np.log10(0.5)))
    of_all = float(np.log10(model.totals.total + 0.5 * (model.totals.distinct + 1)))
    base = F.col("base") + unknown - F.col("n_tokens") * F.lit(of_all)
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.totals.total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def language_scores(docs: DataFrame, folds: int = 5, held_out: int = 1, order: int = ORDER, mu: float = MU, bits: int = BITS) -> DataFrame:
    """Scores of all documents, learned from the rows that are not held out."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    return score(docs, learn(docs, fold != held_out, order, mu, bits), fold == held_out)
