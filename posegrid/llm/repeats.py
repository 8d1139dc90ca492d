"""Removal of every byte that lies in a 200-byte string which starts elsewhere too.

The suffixes of a corpus, sorted, stand beside those they share most with; a
repeated string is a run of neighbours with long common prefixes.  Merging the
sorted suffixes of shards by refining their interleave, one byte an iteration,
gives that order and the common prefixes, but takes 200 passes over all bytes.
It is not done here; nothing is merged from shards.  Instead:

1. Every 200-byte string has an anchor inside it (``anchors``), and equal strings
   have equal anchors.  Neighbouring strings with one anchor place are a run.
   Runs are grouped by anchor; an anchor that occurs once has no repeats, and
   runs equal as a whole, by their hash, are repeated as a whole.
2. What is left are runs that share an anchor and differ somewhere around it,
   each different text once.  Their bytes after the anchor, and their bytes
   before it read backwards, are sorted from scratch: ``refined`` deals the rows
   of a group out byte by byte until no two neighbours are alike, and notes at
   which byte neighbours part.  A string that has ``l`` bytes before
   the anchor is repeated if another row agrees for ``l`` bytes backwards and
   for ``100 - l`` bytes forwards.

Rows meet by anchor and by the 50 bytes on the side where the string has more.
A group that is still large, a phrase in very many surroundings, is halved by
joins: the strings with fewer bytes before the anchor must also agree in more
bytes after it, and the other way round, until a group is small or has but one
string, whose rows are counted.  So no group meets in one task as a whole.

Defined results: a null text is an empty one; a very long text is cut into
pieces that overlap, so no string is lost; texts below 200 bytes lose nothing;
equal texts of 200 bytes or more lose everything, repeated rows of one id too; an
empty table gives an empty table; other columns are ignored by ``removed`` and
kept by ``without_repeats``.  Removal is by bytes; ``without_repeats`` drops what
is left of a character that was cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import K, LENGTH, runs
from .storage import drop, written

EXTRA = LENGTH - K
HALF = EXTRA // 2
#: Rows merged at a time, unless one group has more.
BAND = 20_000
_U = np.uint64


def refined(rows: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of rows of bytes and the common prefix of each with the one before.

    ``rows`` holds one row of bytes for each suffix, of which ``sizes`` count;
    rows of different groups have nothing in common (-1).  Each iteration deals
    the interleave out by one more byte, keeping the order it has so far.
    """
    order = np.argsort(groups, kind="stable")
    common = np.full(len(order), rows.shape[1] + 1, np.int64)
    if not len(order):
        return order, common
    common[0] = -1
    common[1:][groups[order[1:]] != groups[order[:-1]]] = -1
    for depth in range(rows.shape[1]):
        bucket = np.cumsum(common <= depth)
        # only buckets of two rows or more can still be refined
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        wide = np.repeat(np.diff(edge) > 1, np.diff(edge))
        live = np.flatnonzero(wide)
        if not len(live):
            break
        who = order[live]
        letter = np.where(sizes[who] > depth, rows[who, depth].astype(np.int64) + 1, 0)
        key = bucket[live] * 257 + letter
        turn = np.argsort(key, kind="stable")
        order[live] = who[turn]
        key = key[turn]
        parts = np.flatnonzero((key[1:] != key[:-1]) & (bucket[live][1:] == bucket[live][:-1])) + 1
        common[live[parts]] = depth
    return order, common


def repeated_strings(left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray, groups: np.ndarray, low: np.ndarray, high: np.ndarray, several: np.ndarray) -> np.ndarray:
    """For each row, which strings (by bytes before the anchor) occur twice or more.

    ``left`` is read backwards from the anchor.  Row ``i`` has the strings with
    ``low[i]`` to ``high[i]`` bytes before it; ``several`` marks rows that stand
    for two runs or more.
    """
    n = len(groups)
    out = np.zeros((n, EXTRA + 1), bool)
    sides = []
    for rows, sizes in ((left, left_size), (right, right_size)):
        order, common = refined(rows, sizes, groups)
        sides.append((order, common))
    for l in range(EXTRA + 1):
        live = np.flatnonzero((low <= l) & (l <= high))
        if not len(live):
            continue
        key = np.zeros(n, np.int64)
        for (order, common), depth in zip(sides, (l, EXTRA - l)):
            own = np.empty(n, np.int64)
            own[order] = np.cumsum(common < depth)
            key = key * (n + 1) + own
        _, inverse, counts = np.unique(key[live], return_inverse=True, return_counts=True)
        total = np.bincount(inverse, weights=1 + several[live])
        out[live, l] = total[inverse] > 1
    return out


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, raws = b.column(0), b.column(1)
        out: list[list[np.ndarray]] = []
        for k, raw in zip(keys.to_pylist(), raws):
            anchor, run, place, first, last = runs(raw.as_py())
            if len(anchor):
                out.append([anchor.view(np.int64), run.view(np.int64), np.full(len(anchor), k), place << 16 | (place - first) << 8 | (place - last)])
        if out:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names=["anchor", "run", "key", "place"])


_CONTEXTS = "group long, key long, place long, several boolean, low int, high int, least int, most int, left binary, right binary"


def _group(anchor: bytes, least: int, most: int, left: bytes, right: bytes) -> int:
    """What rows must agree in: strings with ``least`` to ``most`` bytes before the anchor have these bytes around it."""
    h = hashlib.blake2b(anchor, digest_size=8, person=bytes([least, most]))
    h.update(left[:least])
    h.update(right[: EXTRA - most])
    return int.from_bytes(h.digest(), "little", signed=True)


def _halves(anchor: bytes, row: tuple, least: int, most: int) -> Iterator[tuple]:
    """A row once for each half of the range of bytes before the anchor that it has strings in."""
    key, place, several, low, high, left, right = row
    middle = (least + most) // 2
    for a, e in ((least, middle), (middle + 1, most)):
        lo, hi = max(low, a), min(high, e)
        if lo <= hi:
            yield _group(anchor, a, e, left, right), key, place, several, lo, hi, a, e, left, right


def _as_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *(pa.int32(),) * 4, pa.binary(), pa.binary())
    return pa.record_batch([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], names=[c.split()[0] for c in _CONTEXTS.split(", ")])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run asked for, the bytes around the anchor, by the half it is grouped by."""
    for b in batches:
        out: list[tuple] = []
        for n in range(b.num_rows):
            key, raw = b.column("key")[n].as_py(), b.column("raw")[n].as_py()
            for ask in b.column("asks")[n].as_py():
                place = ask["place"]
                p, high, low = place >> 16, place >> 8 & 255, place & 255
                row = key, place, ask["several"], low, high, raw[p - high : p][::-1], raw[p + K : p + K + EXTRA - low]
                out += _halves(ask["anchor"].to_bytes(8, "little", signed=True), row, 0, EXTRA)
        yield _as_batch(out)


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large groups, by half the range; the group they came from stands for the anchor."""
    for b in batches:
        out: list[tuple] = []
        for group, key, place, several, low, high, least, most, left, right in zip(*(c.to_pylist() for c in b.columns)):
            out += _halves(group.to_bytes(8, "little", signed=True), (key, place, several, low, high, left, right), least, most)
        yield _as_batch(out)


def _settled(contexts: DataFrame, band: int) -> tuple[DataFrame, list[DataFrame]]:
    """``key``, ``start`` and ``stop`` of what the strings that occur twice or more cover,
    and the written tables that are read for it."""
    found, scratch = None, []

    def add(part: DataFrame):
        nonlocal found
        found = part if found is None else found.union(part)

    def small(rows: DataFrame):
        add(rows.repartition("group").sortWithinPartitions("group").mapInArrow(_resolved, "key long, start long, stop long"))

    rows = contexts
    while True:
        # groups of one string stay in the counts at any size: nothing is left to compare
        large = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("a"), F.first("most").alias("e")).where(F.col("n") > band)
        large = written(large, "repeat-large")
        scratch.append(large)
        if large.isEmpty():
            small(rows)
            return found, scratch
        small(rows.join(large, "group", "left_anti"))
        inside = rows.join(large, "group")
        anchor = F.shiftright("place", 16)
        same = inside.where("a = e").select("key", (anchor - F.col("least")).alias("start"), (anchor - F.col("least") + LENGTH).alias("stop"))
        add(same)  # more than one row, all of one string
        rows = written(inside.where("a < e").select(*contexts.columns).mapInArrow(_halved, _CONTEXTS), "repeat-halves")
        scratch.append(rows)


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of text, for each document, that the repeated strings of a group cover."""
    held: list[tuple] = []

    def settle(rows):
        groups, keys, places, several, low, high, _, _, left, right = zip(*rows)
        ls, rs = np.array([len(x) for x in left]), np.array([len(x) for x in right])
        pad = lambda x: np.frombuffer(b"".join(v.ljust(EXTRA, b"\0") for v in x), np.uint8).reshape(-1, EXTRA)
        found = repeated_strings(pad(left), ls, pad(right), rs, np.unique(groups, return_inverse=True)[1], np.array(low), np.array(high), np.array(several, int))
        row, l = np.nonzero(found)
        if not len(row):
            return None
        # neighbouring strings of a row cover one range
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (l[1:] != l[:-1] + 1)])
        a = np.flatnonzero(new)
        e = np.concatenate([a[1:], [len(row)]]) - 1
        anchor = np.array(places)[row[a]] >> 16
        return pa.record_batch([pa.array(np.array(keys)[row[a]]), pa.array(anchor - l[e]), pa.array(anchor - l[a] + LENGTH)], names=["key", "start", "stop"])

    for b in batches:
        held += zip(*(b.column(c).to_pylist() for c in range(b.num_columns)))
        while len(held) > BAND:
            cut = BAND
            while cut < len(held) and held[cut][0] == held[cut - 1][0]:
                cut += 1
            if cut == len(held):
                break
            if (found := settle(held[:cut])) is not None:
                yield found
            held = held[cut:]
    if held and (found := settle(held)) is not None:
        yield found


def covered(raw: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the ranges cover."""
    out: list[list[int]] = []
    for a, e in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return [(a, e) for a, e in out]


def _spans(docs: DataFrame, id_col: str, text_col: str, others: list[str]) -> DataFrame:
    """``rest`` (the id and other columns), ``raw`` and ``ranges`` (start << 32 | stop) of every row."""
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"), raw.alias("raw"), F.xxhash64(id_col, raw).alias("key"))
    found = written(rows.where(F.octet_length("raw") >= LENGTH).select("key", "raw").mapInArrow(_rows_of, "anchor long, run long, key long, place long"), "repeat-places")
    # A passage may have any number of copies: counts are summed where the rows lie, and
    # rows meet them in joins of tables, whose large groups Spark can split.
    repeated = written(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") > 1), "repeat-anchors")
    several = written(found.join(repeated, "anchor"), "repeat-rows")
    drop(found, repeated)
    kinds = written(several.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("same"), F.min(F.struct("key", "place")).alias("first")), "repeat-kinds")
    counted = several.join(kinds, ["anchor", "run"])
    whole, first = F.col("same") > 1, (F.struct("key", "place") == F.col("first")) & (F.col("same") < F.col("all"))
    place = F.col("place")
    start = F.shiftright(place, 16) - F.shiftright(place, 8).bitwiseAND(F.lit(255))
    stop = F.shiftright(place, 16) - place.bitwiseAND(F.lit(255)) + LENGTH
    by_doc = written(
        counted.groupBy("key").agg(
            F.collect_set(F.when(whole, F.shiftleft(start, 32).bitwiseOR(stop))).alias("ranges"),
            F.collect_list(F.when(first, F.struct("anchor", "place", whole.alias("several")))).alias("asks"),
        ),
        "repeat-runs",
    )
    drop(several, kinds)
    asked = by_doc.where(F.size("asks") > 0).select("key", "asks")
    contexts = written(rows.join(asked, "key").select("key", "raw", "asks").mapInArrow(_contexts, _CONTEXTS), "repeat-contexts")
    settled, scratch = _settled(contexts, BAND)
    more = settled.groupBy("key").agg(F.collect_set(F.shiftleft(F.col("start"), 32).bitwiseOR(F.col("stop"))).alias("more"))
    both = by_doc.select("key", "ranges").join(more, "key", "left").select("key", F.concat("ranges", F.coalesce("more", F.array().cast("array<bigint>"))).alias("ranges"))
    both = written(both, "repeat-ranges")
    drop(by_doc, contexts, *scratch)
    return rows.join(both, "key", "left").select("rest", "raw", "ranges")


def _ranges(packed: list[int] | None) -> list[tuple[int, int]]:
    return [(x >> 32, x & 0xFFFFFFFF) for x in packed or ()]


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What every document loses, and a digest of what it keeps.

    Columns: ``doc_id``, ``n_bytes``, ``n_removed`` and ``n_spans`` long,
    ``kept_sha256`` string.
    """
    rows = _spans(docs, id_col, text_col, [id_col]).select(F.col(f"rest.{id_col}").alias("doc_id"), "raw", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, ranges in zip(b.column("raw"), b.column("ranges").to_pylist()):
                raw = raw.as_py()
                gone = covered(raw, _ranges(ranges))
                kept, at = hashlib.sha256(), 0
                for a, e in gone:
                    kept.update(raw[at:a])
                    at = e
                kept.update(raw[at:])
                out.append((len(raw), sum(e - a for a, e in gone), len(gone), kept.hexdigest()))
            yield pa.record_batch([b.column(0)] + [pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with all their columns, the text without its repeated bytes (null: null)."""
    others = [c for c in docs.columns if c != text_col]
    flag = "there"
    while flag in others:
        flag += "_"
    rows = _spans(docs.withColumn(flag, F.col(text_col).isNotNull()), id_col, text_col, [*others, flag])
    kinds = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, ranges in zip(b.column("raw"), b.column("ranges").to_pylist()):
                raw, at, kept = raw.as_py(), 0, []
                for a, e in covered(raw, _ranges(ranges)):
                    kept.append(raw[at:a])
                    at = e
                kept.append(raw[at:])
                out.append("".join(x.decode("utf-8", "ignore") for x in kept))
            yield pa.record_batch([b.column("rest"), pa.array(out, pa.string())], names=["rest", "kept"])

    kept = rows.mapInArrow(run, _with_text(rows))
    cols = [F.when(F.col(f"rest.`{flag}`"), F.col("kept")).cast(kinds[c].dataType).alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return kept.select(*cols)


def _with_text(rows: DataFrame):
    from pyspark.sql.types import StringType, StructType

    return StructType([rows.schema["rest"]]).add("kept", StringType())
