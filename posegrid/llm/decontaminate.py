"""Benchmark decontamination by spaced seeds.

A mask picks some of the words in a short span and ignores the others, so its
hash survives substitutions at the ignored places.  Every span of the test items
and of the documents is hashed under each mask, and the two sides are joined on
the hashes.  A bit table of the items' hashes, of bounded size, goes to the
tasks first, so that of the documents only spans that may have a partner are
shuffled; a benchmark that fills the table makes the join larger, not wrong.

Documents and items that met are compared word by word: an overlap counts where,
in some window of ``WINDOW`` words, at least ``NEED`` are equal.  The masks are
chosen so that any such window of 13 words, or a whole item of 6 to 12, has a
span that one of them matches.

Defined results: null or blank texts, and items of fewer words than the shortest
mask spans, overlap with nothing; items shorter than a window count as one
window; repeated rows give repeated pairs; items without an id make no pairs,
but clean like the others; a text of one word many times over, or a very long
one, is compared like any other; an empty table on either side gives no pairs;
other columns, whatever their names, are ignored by ``overlaps`` and kept by
``keep_clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mix, words
from .storage import drop, written

MASKS = ("110111", "1110101", "1011011")
WINDOW, NEED = 13, 11
#: Bits of the table for each span of the items, and at most for all; places that a span has in it.
BITS_A_SPAN, MOST_BITS, PROBES = 16, 1 << 26, 4
#: Words of a document that are compared with an item at a time.
BAND = 1 << 14
_U = np.uint64
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every span under a mask, in word order."""
    n = len(hashes) - len(mask) + 1
    out = np.full(max(n, 0), int(mask, 2), _U)
    for k, bit in enumerate(mask):
        if bit == "1" and n > 0:
            out = (out * _U(0x9FB21C651E98DF25) + hashes[k : k + n]) ^ (out >> _U(31))
    return mix(out)


def all_seeds(raw: bytes) -> np.ndarray:
    own = words(raw)[0]
    return np.concatenate([seeds(own, m) for m in MASKS])


def _places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Where spans are noted in a table of a power of two of bits."""
    for k in range(PROBES):
        h = mix(h + _U(k + 1))
        yield (h & _U(bits - 1)).astype(np.int64)


def bit_table(spans: DataFrame) -> np.ndarray:
    """The bit table of the items' hashes, bytes of 8 bits each; built where the items lie."""
    n = max(1, spans.count())
    bits = min(MOST_BITS, max(1 << 10, 1 << (BITS_A_SPAN * n - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate([*_places(b.column(0).to_numpy().view(_U), bits)]))
            yield pa.record_batch([pa.array(at >> 6), pa.array((_U(1) << (at & 63).astype(_U)).view(np.int64))], names=["at", "bit"])

    # At most MOST_BITS / 64 rows come to the driver.
    found = spans.select("h").mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits >> 6, np.int64)
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return table.view(np.uint8)


def noted(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Those of the hashes that all their places in the table have."""
    bits, live = 8 * len(table), np.arange(len(h))
    for k in range(PROBES):
        if not len(live):
            break
        # each probe is asked only for what the ones before let through
        x = h[live]
        for j in range(k + 1):
            x = mix(x + _U(j + 1))
        at = (x & _U(bits - 1)).astype(np.int64)
        live = live[(table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
    return h[live]


def word_list(raw: bytes) -> list[bytes]:
    return _WORDS.findall(raw.lower())


def best_window(item: list[bytes], own: list[bytes]) -> tuple[int, int, int] | None:
    """Equal words, words and first word (in the document) of the best window, if it counts.

    Of windows with as many equal words the one that is first in the document.
    """
    size = min(WINDOW, len(item))
    if size < min(map(len, MASKS)) or len(own) < size:
        return None
    number: dict[bytes, int] = {}
    x = np.array([number.setdefault(w, len(number)) for w in item], np.int32)
    y = np.array([number.get(w, -1) for w in own], np.int32)
    best = (0, 0)
    for a in range(0, len(y) - size + 1, BAND):
        part = y[a : a + BAND + size - 1]
        rows, cols = len(x) - size + 1, len(part) - size + 1
        equal = np.zeros((rows, cols), np.int8)
        for j in range(size):
            equal += x[j : j + rows, None] == part[None, j : j + cols]
        most = equal.max(0)
        at = int(most.argmax())
        if most[at] > best[0]:
            best = int(most[at]), a + at
    return (best[0], size, best[1]) if best[0] * WINDOW >= NEED * size else None


def _found(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with the two hashes ``t`` and ``u`` of its texts in a struct ``row``, and the overlaps of the texts.

    The overlaps (a written table): ``t``, ``u``, ``item_id``, ``n_equal``,
    ``n_words`` and ``first_word``; equal texts are compared once.
    """
    raw = F.col(text_col).cast("binary")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(raw).alias("t"), F.xxhash64(F.lit(1), raw).alias("u"), raw.alias("raw"))
    item_raw = F.col(item_text).cast("binary")
    own = items.where(item_raw.isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), item_raw.alias("item"), F.xxhash64(item_raw).alias("i"))

    def item_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, r in zip(b.column("i").to_pylist(), b.column("item")):
                h = np.unique(all_seeds(r.as_py()))
                yield pa.record_batch([pa.array(np.full(len(h), k, np.int64)), pa.array(h.view(np.int64))], names=["i", "h"])

    spans = written(own.select("i", "item").mapInArrow(item_spans, "i long, h long").distinct(), "benchmark-spans")
    table = bit_table(spans)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = [np.unique(noted(all_seeds(r.as_py() or b""), table)) for r in b.column("raw")]
            hit = pa.array([len(h) > 0 for h in some], pa.bool_())
            kept = b.filter(hit)
            yield pa.record_batch([*kept.select(["t", "u", "raw"]).columns, pa.array([h.view(np.int64) for h in some if len(h)], pa.list_(pa.int64()))], names=["t", "u", "raw", "hashes"])

    hits = rows.select("t", "u", "raw").mapInArrow(look, "t long, u long, raw binary, hashes array<long>").dropDuplicates(["t", "u"])
    hits = written(hits, "benchmark-hits")
    pairs = hits.select("t", "u", F.explode("hashes").alias("h")).join(spans, "h").select("t", "u", "i").distinct()
    pairs = written(pairs, "benchmark-pairs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [best_window(word_list(x.as_py()), word_list(y.as_py())) for x, y in zip(b.column("item"), b.column("raw"))]
            kept = b.filter(pa.array([o is not None for o in out], pa.bool_()))
            out = [o for o in out if o is not None]
            yield pa.record_batch([*kept.select(["t", "u", "item_id"]).columns, *(pa.array([o[c] for o in out], k) for c, k in enumerate((pa.int32(), pa.int32(), pa.int64())))], names=["t", "u", "item_id", "n_equal", "n_words", "first_word"])

    both = hits.select("t", "u", "raw").join(pairs, ["t", "u"]).join(own, "i").select("t", "u", "item_id", "item", "raw")
    found = written(both.mapInArrow(compare, "t long, u long, item_id long, n_equal int, n_words int, first_word long"), "benchmark-overlaps")
    drop(spans, hits, pairs)
    return rows.select("row", "t", "u"), found


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of documents and test items that overlap.

    Columns: ``doc_id``, ``item_id`` long, ``n_equal`` int and ``n_words`` int (of
    the best window), ``first_word`` long (its place in the document).
    """
    rows, found = _found(docs, items, text_col, item_id, item_text)
    return rows.select(F.col(f"row.`{id_col}`").alias("doc_id"), "t", "u").join(found.where(F.col("item_id").isNotNull()), ["t", "u"]).select("doc_id", "item_id", "n_equal", "n_words", "first_word")


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that overlap with no test item, with an id or without, with all their columns."""
    rows, found = _found(docs, items, text_col, item_id, item_text)
    # a null text hashes like nothing else that is found, so it stays
    return rows.join(found.select("t", "u").distinct(), ["t", "u"], "left_anti").select("row.*")
