"""Adaptive context-mixing range coder for token ids.

A stream is cut into blocks that are reset, coded and checksummed on their own,
so any block can be read without the others.  Inside a block, lanes (runs of
neighbouring ids) are coded side by side in array operations and share what the
block has learned so far; step ``t`` codes the ``t``-th id of every lane.

* Orders 1 and 2: each context (the last id, the last two) keeps two candidates
  with confidences; hits raise them, misses lower them and let newcomers in.
* Mixing: the four confidences and whether the orders agree make a mixing state.
  For each state the weights of the four candidates and of an escape are learned
  from how often each came true there, so an order that is seldom right loses
  its weight wherever that is so.
* Order 0: after an escape the id itself is coded by its frequency in the block
  so far, without the two first candidates, which it is not; every id of the block's range
  always has some weight.

Weights and frequencies are held between refreshes, whose steps are fixed.  The
range coder has a 64-bit state and 32-bit words; a block's lanes share one
stream of words, in the order in which decoding asks for them.  All of it is
integer arithmetic, so any machine decodes what another one wrote.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Lanes of a full block, and the ids of each.
LANES, STEPS = 16384, 128
BLOCK = LANES * STEPS
#: A lane of a smaller block has about so many ids at least.
SHORTEST = 512
#: A block of so many ids has learned enough for lanes of ``STEPS``.
_MANY = 1 << 20
#: Ids stay below this.
MOST = 1 << 24
_MAGIC = b"PGT4"
_U = np.uint64
_LOW = _U(0xFFFFFFFF)
_ONE, _TWO = 16, 18  # bits of the tables of contexts
_NOBODY = np.int32(MOST << 3)
_WEIGHT_BITS = 16
_CHOICES = 5  # two candidates of order 2, two of order 1, escape
_STATES = 1 << 11
#: Ids of the block count so much more than the one that every id starts with.
_SEEN = 32
#: Blocks with ids from here on are coded as pairs of symbols of 12 bits each.
_LARGE, _HALF = 1 << 18, 1 << 12


def _refreshes(steps: int) -> set[int]:
    """Steps before which weights and frequencies are refreshed: all first ones, then ever fewer."""
    out, at = set(), 1
    while at < steps:
        out.add(at)
        at += max(1, min(16, at // 4))
    return out


def _turns() -> np.ndarray:
    """What becomes of a context's two candidates, by their confidences and misses: one number each.

    Bits: by how much the confidences change (and 1), whether a newcomer takes the second place, whether they swap.
    """
    i = np.arange(256)
    ca, hit_a, cb, hit_b = i & 7, i >> 3 & 1 == 0, i >> 4 & 7, i >> 7 == 0
    after_a = ca + (hit_a & (ca < 7)) - (~hit_a & (ca > 1))
    newcomer = ~hit_a & ~hit_b & (cb <= 1)
    after_b = np.where(hit_a | hit_b, cb + (hit_b & (cb < 7)), np.where(newcomer, cb, cb - 1))
    swap = np.where(newcomer, 1, after_b) > after_a
    return (after_a - ca + 1 | after_b - cb + 1 << 2 | newcomer << 4 | swap << 5).astype(np.int32)


_TURNS = _turns()


class _Model:
    """What a block has learned."""

    def __init__(self, lanes: int, steps: int, top: int):
        # contexts of order 2, then those of order 1; a context's two candidates lie in one number
        self.table = np.full((1 << _TWO) + (1 << _ONE), int(_NOBODY) << 32 | int(_NOBODY), np.int64)
        self.last = self.before = np.zeros(lanes, np.int32)
        self.due = _refreshes(steps)
        # what is seen of a state at first: candidates count by their confidences
        s = np.arange(_STATES)
        a2, a1, b2, b1 = s >> 8, s >> 5 & 7, s >> 2 & 3, s & 3
        start = np.stack([4 * a2, b2, 2 * a1, b1, np.full(_STATES, 8)], 1)
        start[:, 2] = np.where(s >> 4 & 1, 0, start[:, 2])
        self.weights = (16 * start + 1).astype(np.int64)
        self.top = top
        self.counts = np.zeros(top + 1, np.int32)
        self.chosen: list[np.ndarray] = []
        self.coded: list[np.ndarray] = []
        self.refresh()

    def refresh(self) -> None:
        if self.chosen:
            self.weights += 24 * np.bincount(np.concatenate(self.chosen), minlength=_STATES * _CHOICES).reshape(_STATES, _CHOICES)
            self.weights = np.where(self.weights.sum(1, keepdims=True) > 1 << 20, (self.weights + 1) >> 1, self.weights)
            self.counts += np.bincount(np.concatenate(self.coded), minlength=len(self.counts)).astype(np.int32)
            self.chosen, self.coded = [], []
        width = 1 + self.weights * ((1 << _WEIGHT_BITS) - _CHOICES) // self.weights.sum(1, keepdims=True)
        width[:, -1] += (1 << _WEIGHT_BITS) - width.sum(1)
        ends = np.cumsum(width, 1)
        # start and width of a choice, and the ends of all but the last, in one number each
        self.slots = (ends - width << _WEIGHT_BITS | width).astype(np.uint32).ravel()
        self.ends = np.ascontiguousarray(ends[:, : _CHOICES - 1].astype(np.uint16)).view(_U).ravel()
        frequency = _SEEN * self.counts + 1
        # behind the last id one that stands for all that the block does not have; all of it fits 32 bits
        self.upto = np.zeros(len(frequency) + 1, np.int32)
        np.cumsum(frequency, out=self.upto[1:])
        self.frequency, self.total = np.append(frequency, np.int32(0)), self.upto[-1]

    def predict(self, m: int) -> np.ndarray:
        """The mixing state of the first ``m`` lanes; the candidates are in ``said``."""
        last = self.last[:m].astype(np.uint32)
        at2 = (last * np.uint32(0x9E3779B1) + self.before[:m].astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - _TWO)
        self.at = np.concatenate([at2, (last & np.uint32((1 << _ONE) - 1)) + np.uint32(1 << _TWO)]).astype(np.intp)
        both = self.table[self.at]
        # first and second candidates, those of order 2 before those of order 1
        self.a, self.b = a, b = both.astype(np.int32), (both >> 32).astype(np.int32)
        self.said = a[:m], b[:m], a[m:], b[m:]
        self.sure_a, self.sure_b = sure, b = a & 7, b & 7
        agree = (a[:m] ^ a[m:]) < 8
        b = np.minimum(b, 3)
        # a confidence of 7 for the first candidates, up to 3 for the second ones
        self.state = ((sure[:m] << 8) + (sure[m:] << 5) + (agree.view(np.int8).astype(np.int32) << 4) + (b[:m] << 2) + b[m:]).astype(np.intp)
        return self.state

    def slot(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where states' choices begin, and how wide they are."""
        slots = self.slots[place]
        return (slots >> np.uint32(_WEIGHT_BITS)).astype(_U), (slots & np.uint32((1 << _WEIGHT_BITS) - 1)).astype(_U)

    def excluded(self, some: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The first candidates of some lanes, the smaller id first, and the frequency each takes away."""
        a, b = (np.minimum(c[some] >> 3, self.top + 1) for c in (self.said[0], self.said[2]))
        low, high = np.minimum(a, b), np.maximum(a, b)
        return [(low, self.frequency[low]), (high, np.where(low == high, 0, self.frequency[high]))]

    def learn(self, m: int, ids: np.ndarray, place: np.ndarray) -> None:
        """``place``: state and choice."""
        a, b, eight = self.a, self.b, np.uint32(8)
        here = np.concatenate([ids, ids]) << 3
        # an id that is not the candidate's differs above the confidence's bits
        of_a = (np.minimum((a ^ here).view(np.uint32), eight) & eight).view(np.int32) | self.sure_a
        of_b = (np.minimum((b ^ here).view(np.uint32), eight) & eight).view(np.int32) | self.sure_b
        turn = _TURNS[of_a | of_b << 4]
        a = a + ((turn & 3) - 1)
        b = b + ((turn >> 2 & 3) - 1)
        b ^= (b ^ (here + 1)) & -(turn >> 4 & 1)
        swap = (a ^ b) & -(turn >> 5)
        self.table[self.at] = (b ^ swap).astype(np.int64) << 32 | (a ^ swap)
        self.chosen.append(place)
        self.coded.append(ids)
        self.before, self.last = self.last[:m], ids

    def first(self, ids: np.ndarray) -> np.ndarray:
        """The first of four candidates that came true; 4 for none."""
        here = ids << 3
        a, b, c, d = (((x ^ here) >= 8).view(np.int8) for x in self.said)
        return a * (b * (c * (d + np.int8(1)) + np.int8(1)) + np.int8(1))


def _layout(n: int) -> tuple[int, np.ndarray]:
    """Lanes of a block of ``n`` ids, longest first, and how many are alive at each step."""
    lanes = max(1, min(LANES, n // (SHORTEST if n < _MANY else STEPS)))
    steps, over = -(-n // lanes), n % lanes
    alive = np.full(steps, lanes)
    if over:
        alive[-1] = over
    return lanes, alive


def _dealt(ids: np.ndarray, lanes: int, steps: int) -> np.ndarray:
    """The ids by step and lane; a lane's ids are neighbours in the block."""
    over = len(ids) - (steps - 1) * lanes  # lanes with an id at the last step
    out = np.zeros((steps, lanes), np.int32)
    out[:, :over] = ids[: over * steps].reshape(over, steps).T
    if over < lanes:
        out[:-1, over:] = ids[over * steps :].reshape(lanes - over, steps - 1).T
    return out


def _joined(dealt: np.ndarray, n: int) -> np.ndarray:
    steps, lanes = dealt.shape
    over = n - (steps - 1) * lanes
    return np.concatenate([dealt[:, :over].T.ravel(), dealt[:-1, over:].T.ravel()]) if n else np.zeros(0, np.int32)


def _halves(ids: np.ndarray) -> np.ndarray:
    """Two symbols for each id: its upper half, told from the lower ones, and its lower half."""
    return np.stack([(ids >> 12) + _HALF, ids & (_HALF - 1)], 1).ravel()


def encode_block(ids: np.ndarray) -> bytes:
    """The words of a block, after its largest id."""
    largest = int(ids.max(initial=0))
    if largest >= _LARGE:
        ids = _halves(ids)
    n, top = len(ids), int(ids.max(initial=0))
    lanes, alive = _layout(n)
    steps = len(alive)
    dealt = _dealt(ids.astype(np.int32), lanes, steps)
    model = _Model(lanes, steps, top)
    low, span = np.zeros(lanes, _U), np.full(lanes, np.iinfo(_U).max, _U)
    out, pos = np.zeros((2 * steps + 4, lanes), np.uint32), np.zeros(lanes, np.int64)
    carries: list[tuple[np.ndarray, np.ndarray]] = []
    asked: list[tuple[np.ndarray, np.ndarray]] = []

    def settle(m: int, before: np.ndarray) -> None:
        """Note carries, and write a word where the span has become small."""
        carry = low[:m] < before
        if carry.any():
            who = np.flatnonzero(carry)
            carries.append((pos[who] - 1, who))
        who = np.flatnonzero(span[:m] <= _LOW)
        if len(who):
            code, at = low[who], pos[who]
            out[at, who] = code >> _U(32)
            asked.append((at + 2, who))
            pos[who] = at + 1
            low[who] = code << _U(32)
            span[who] <<= _U(32)

    for t in range(steps):
        m = int(alive[t])
        if t in model.due:
            model.refresh()
        now = dealt[t, :m]
        state = model.predict(m)
        choice = model.first(now)
        place = state * _CHOICES + choice
        r = span[:m] >> _U(_WEIGHT_BITS)
        before = low[:m].copy()
        start, width = model.slot(place)
        low[:m] += r * start
        span[:m] = r * width
        settle(m, before)
        escaped = np.flatnonzero(choice == 4)
        if len(escaped):
            own = now[escaped]
            (x, f), (y, g) = model.excluded(escaped)
            at = model.upto[own] - f * (x < own) - g * (y < own)
            unit = span[escaped] // (model.total - f - g).astype(_U)
            before = low[:m].copy()
            low[escaped] += unit * at.astype(_U)
            span[escaped] = unit * model.frequency[own].astype(_U)
            settle(m, before)
        model.learn(m, now, place)
    every = np.arange(lanes)
    for shift in (_U(32), _U(0)):
        out[pos, every] = (low >> shift) & _LOW
        pos += 1
    for at, who in reversed(carries):  # from the last word back, as far as a carry runs
        while len(at):
            out[at, who] += np.uint32(1)
            over = out[at, who] == 0
            at, who = at[over] - 1, who[over]
    order = [out[0], out[1], *(out[at, who] for at, who in asked)]
    return struct.pack("<II", largest, top) + np.concatenate(order).astype("<u4").tobytes()


def decode_block(coded: bytes, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    largest, top = struct.unpack_from("<II", coded)
    if largest >= MOST or top >= _LARGE:
        raise ValueError("no such block")
    if largest >= _LARGE:
        halves = _decoded(coded, 2 * n, top).reshape(-1, 2)
        return (halves[:, 0] - _HALF << 12) + halves[:, 1]
    return _decoded(coded, n, top)


def _decoded(coded: bytes, n: int, top: int) -> np.ndarray:
    words = np.frombuffer(coded, "<u4", offset=8).astype(_U)
    lanes, alive = _layout(n)
    steps = len(alive)
    dealt = np.zeros((steps, lanes), np.int32)
    model = _Model(lanes, steps, top)
    code = words[:lanes] << _U(32) | words[lanes : 2 * lanes]
    span, read = np.full(lanes, np.iinfo(_U).max, _U), 2 * lanes

    def settle(m: int) -> None:
        nonlocal read
        who = np.flatnonzero(span[:m] <= _LOW)
        if len(who):
            code[who] = code[who] << _U(32) | words[read : read + len(who)]
            read += len(who)
            span[who] <<= _U(32)

    for t in range(steps):
        m = int(alive[t])
        if t in model.due:
            model.refresh()
        state = model.predict(m)
        r = span[:m] >> _U(_WEIGHT_BITS)
        v = np.minimum(code[:m] // r, _U((1 << _WEIGHT_BITS) - 1)).astype(np.uint16)
        ends = model.ends[state].view(np.uint16).reshape(m, _CHOICES - 1)
        choice = sum((v >= ends[:, k]).view(np.int8) for k in range(_CHOICES - 1))
        place = state * _CHOICES + choice
        start, width = model.slot(place)
        code[:m] -= r * start
        span[:m] = r * width
        settle(m)
        a2, b2, a1, b1 = model.said
        now = np.where(choice < 2, np.where(choice == 0, a2, b2), np.where(choice == 2, a1, b1)) >> 3
        escaped = np.flatnonzero(choice == 4)
        if len(escaped):
            (x, f), (y, g) = model.excluded(escaped)
            rest = model.total - f - g
            unit = span[escaped] // rest.astype(_U)
            v = np.minimum(code[escaped] // unit, (rest - 1).astype(_U)).astype(np.int32)
            gone = f * (model.upto[x] <= v)
            gone += g * (model.upto[y] <= v + gone)
            v += gone
            # neighbours are found faster one after the other; place and lane are sorted as one number
            order = np.sort(v.astype(np.int64) << 16 | np.arange(len(v)))
            at = np.empty(len(v), np.int32)
            at[order & 0xFFFF] = np.searchsorted(model.upto, (order >> 16).astype(np.int32), "right") - 1
            code[escaped] -= unit * (model.upto[at] - gone).astype(_U)
            span[escaped] = unit * model.frequency[at].astype(_U)
            settle(m)
            now[escaped] = at
        dealt[t, :m] = now
        model.learn(m, now, place)
    return _joined(dealt, n)


class BlockError(ValueError):
    """A block whose checksum does not match its ids."""


def pack(ids: np.ndarray) -> bytes:
    """A stream of ids below 2**24: header, block table (ids, bytes, checksum), blocks."""
    ids = np.asarray(ids, np.int64)
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < MOST:
        raise ValueError("an id is below 0 or not below 2**24")
    blocks = [ids[k : k + BLOCK] for k in range(0, len(ids), BLOCK)]
    coded = [encode_block(b) for b in blocks]
    head = [_MAGIC, struct.pack("<QII", len(ids), BLOCK, len(blocks))]
    head += [struct.pack("<III", len(b), len(c), zlib.crc32(b.astype("<u4").tobytes())) for b, c in zip(blocks, coded)]
    return b"".join(head + coded)


def unpack(data: bytes) -> np.ndarray:
    """The ids of a stream; raises ``BlockError`` where a block has been damaged."""
    if data[:4] != _MAGIC:
        raise BlockError("not a token stream")
    total, _, n = struct.unpack_from("<QII", data, 4)
    table = [struct.unpack_from("<III", data, 20 + 12 * k) for k in range(n)]
    at, out = 20 + 12 * n, []
    for k, (count, size, crc) in enumerate(table):
        try:
            ids = decode_block(data[at : at + size], count)
        except (IndexError, ValueError, struct.error) as e:
            raise BlockError(f"block {k} cannot be read") from e
        at += size
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise BlockError(f"block {k} is damaged")
        out.append(ids.astype(np.int64))
    found = np.concatenate(out) if out else np.zeros(0, np.int64)
    if len(found) != total:
        raise BlockError("the stream is cut short")
    return found
