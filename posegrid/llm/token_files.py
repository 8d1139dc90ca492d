"""Token ids of whole documents in checksummed, compressed files, and back.

A file row is a segment: the index of its documents (id and number of tokens)
and their ids packed by ``coder``.  Segments hold whole documents in ascending
id order; parts (range partitions of the id) hold segments in order.

Defined results: a null text has only the end id; documents of equal id stand
in text order; a null id comes first; an empty table gives no segments and no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import coder
from .shingles import SPACE
from .storage import new_path
from .vocab import WORD_BPE, RecentCache, default_path, held, to_letters

#: Ids of a segment, unless one document alone has more.
SEGMENT = coder.BLOCK
#: Bytes of text that are encoded at a time, and parts of texts whose ids a worker keeps.
BAND, CHUNK_ENTRIES = 1 << 23, 900_000
#: Chunks that are encoded anew at a time, and letters and marks whose ids are kept for them.
FRESH, PART_ENTRIES = 20_000, 300_000
#: Documents of a part, on average, at most: more documents make more parts.
PART_ROWS = 100_000
#: Letters of Latin-1 in UTF-8 (all but the multiplication and division signs) and ASCII marks after them, without the apostrophe.
_LETTERS = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
_MARKS = re.compile(rb"[!-&(-/:-@\[-`{-~]+")
_PART = re.compile(_MARKS.pattern + rb"|(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: What a byte is: white space, an ASCII letter, an ASCII mark (without the apostrophe), or something else.
_BLANK, _LETTER, _MARK, _OTHER = 0, 1, 2, 4
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[SPACE] = _BLANK
_KIND[[b for b in range(128) if chr(b).isalpha()]] = _LETTER
_KIND[[b for b in range(128) if _MARKS.fullmatch(bytes([b]))]] = _MARK
_KINDS = _KIND.tobytes()
SEGMENTS = "part int, seg int, first long, n_ids long, doc_ids array<long>, n_tokens array<int>, data binary"


class ChunkEncoder:
    """Ids of texts by the tokenizers library, each distinct part encoded once.

    Only for tokenizers that drop white space: there a text's ids are the ids of
    its white-space separated chunks one after the other.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()).encode() or b"(?!)")
        self.model = self.library.model
        probes = [w + m for w in (b"a", b"Word", b"NOTHING", b"zxqjkv", b"dont", b"rearranged") for m in (b"", b".", b",", b"!?", b"...", b")-", b"<|", b"$%&*+/:;=@[\\]^_`{}~#\"(")]
        probes += ["".join(w).encode() for c in map(chr, range(0xC0, 0x100)) if c.isalpha() for w in ((c,), ("a", c), (c, "b"), ("N", c, c, "t", ".)"), (c, "É"))]
        probes += [m for m in (b".", b",", b"!?", b"...", b")-", b"<|", b"$%&*+/:;=@[\\]^_`{}~#\"(")]
        whole = [array("I", self.library.encode(p.decode(), add_special_tokens=False).ids).tobytes() for p in probes]
        parts = [_LETTERS.fullmatch(p).groups() if _LETTERS.match(p) else (b"", p) for p in probes]
        self.simple = all(b"".join(map(self.modelled, filter(None, pair))) == w for pair, w in zip(parts, whole))
        self.known = RecentCache(CHUNK_ENTRIES)
        self.parts: dict[bytes, bytes] = {}

    def modelled(self, part: bytes) -> bytes:
        text = part.lower().decode("ascii") if part.isascii() else to_letters(part.decode("utf-8").lower().encode())
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def missed(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts of texts that are not known: letters in lower case or marks alone, or whole chunks of another form."""
        out, rest, tokenize = [], [], self.model.tokenize
        for k, p in enumerate(parts):
            if self.simple and _PART.fullmatch(p):
                out.append(array("I", [t.id for t in tokenize(p.decode("ascii") if p.isascii() else to_letters(p))]).tobytes())
            else:
                out.append(b"")
                rest.append(k)
        for k, ids in zip(rest, self.fresh([parts[k] for k in rest])):
            out[k] = ids
        return out

    def fresh(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk.

        The rules around the library's model cost more than the model; a chunk of
        Latin letters and marks after them, which they only set in lower case and cut
        in two, goes to the model at once where probes have shown that this is so.
        """
        out, rest, parts = [], [], self.parts
        if len(parts) > PART_ENTRIES:
            parts.clear()
        parts[b""] = b""
        plain = map(_LETTERS.fullmatch, chunks) if self.simple else [None] * len(chunks)
        for k, m in enumerate(plain):
            if not m:
                out.append(b"")
                rest.append(k)
                continue
            # the same letters come in upper and lower case and before other marks
            letters, marks = m[1].lower(), m[2]
            if (first := parts.get(letters)) is None:
                first = parts[letters] = self.modelled(letters)
            if (last := parts.get(marks)) is None:
                last = parts[marks] = self.modelled(marks)
            out.append(first + last)
        for k, e in zip(rest, self.library.encode_batch_fast([chunks[k].decode("utf-8") for k in rest], add_special_tokens=False)):
            out[k] = array("I", e.ids).tobytes()
        return out

    def batch(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; every distinct part of all of them is looked up or encoded once."""
        whole = {k for k, raw in enumerate(texts) if self.special.search(raw)}
        plain = [b"" if k in whole else raw for k, raw in enumerate(texts)]
        starts, number, parts = distinct_parts(b" ".join(plain), self.simple)
        found = [*map(self.known.young.get, parts)]
        missing = [k for k, ids in enumerate(found) if ids is None]
        for k in missing:
            found[k] = self.known.get(parts[k])
        missing = [k for k in missing if found[k] is None]
        for k in range(0, len(missing), FRESH):
            some = missing[k : k + FRESH]
            for j, ids in zip(some, self.missed([parts[j] for j in some])):
                found[j] = ids
                if len(parts[j]) <= 64:
                    self.known.keep(parts[j], ids)
        # the bytes of all parts' ids in the order of the text, and where each begins
        _, upto, data = pa.array(found, pa.large_binary()).take(number).buffers()
        upto = np.frombuffer(upto, np.int64, len(number) + 1) >> 2
        ids = np.frombuffer(data, "<u4", int(upto[-1])) if len(number) else np.zeros(0, "<u4")
        cuts = upto[np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in plain]))].tolist()
        return [np.array(self.library.encode(raw.decode("utf-8"), add_special_tokens=False).ids, "<u4") if k in whole else ids[cuts[k] : cuts[k + 1]] for k, raw in enumerate(texts)]


def distinct_parts(raw: bytes, cut: bool = True) -> tuple[np.ndarray, pa.Array, list[bytes]]:
    """Where parts start, the number of each, and the part of each number.

    Parts are the white-space separated chunks; with ``cut``, one of Latin letters
    and marks after them is two parts, and its letters are in lower case.
    """
    own = np.frombuffer(raw, np.uint8)
    kind, low = np.frombuffer(bytearray(raw.translate(_KINDS)), np.uint8), own
    first = kind != _BLANK
    kept = first.copy()
    first[1:] &= ~kept[:-1]
    if cut:
        lead = np.flatnonzero(own == 0xC3)
        after = own[lead + 1]
        good = (after != 0x97) & (after != 0xB7)
        lead, after = lead[good], after[good]
        kind[lead] = kind[lead + 1] = _LETTER
        low = np.frombuffer(bytearray(raw.lower()), np.uint8)
        low[lead + 1] = after + np.where(after < 0x9F, np.uint8(0x20), np.uint8(0))
        # letters behind a mark and bytes of other kinds make a chunk one that stays whole
        turn = kind[1:] ^ kind[:-1]
        turn = np.flatnonzero(turn == (_LETTER ^ _MARK)) + 1
        back = kind[turn] == _LETTER
        odd = np.concatenate([np.flatnonzero(kind == _OTHER), turn[back]])
        turn = turn[~back]
        if len(odd):
            starts = np.flatnonzero(first)
            stays = np.zeros(len(starts) + 1, bool)
            stays[np.searchsorted(starts, odd, "right")] = True
            turn = turn[~stays[np.searchsorted(starts, turn, "right")]]
            ends = np.append(starts[1:], len(own))
            for a, b in zip(starts[stays[1:]].tolist(), ends[stays[1:]].tolist()):
                low[a:b] = own[a:b]
        first[turn] = True
    starts = np.flatnonzero(first)
    ends = np.cumsum(kept, dtype=np.int32 if len(own) < 1 << 31 else np.int64)
    offsets = np.append(ends[starts] - 1, ends[-1:]).astype(np.int64)
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[kept])])
    coded = parts.dictionary_encode()
    if not len(starts):
        return starts, coded.indices, []
    _, ends, data = coded.dictionary.buffers()
    ends, data = np.frombuffer(ends, np.int64, len(coded.dictionary) + 1).tolist(), data.to_pybytes()
    return starts, coded.indices, [data[a:e] for a, e in zip(ends, ends[1:])]


def encoder(path: str) -> ChunkEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held(("ids", path), lambda: ChunkEncoder(path))


def _encoded(encode: ChunkEncoder, texts: pa.Array) -> Iterator[np.ndarray]:
    band, size = [], 0
    for raw in texts:
        raw = raw.as_py() or b""
        if band and size + len(raw) > BAND:
            yield from encode.batch(band)
            band, size = [], 0
        band.append(raw)
        size += len(raw)
    yield from encode.batch(band)


def write(docs: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id`` and write the segments."""
    place = tokenizer or default_path(WORD_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(place), TaskContext.get().partitionId()
        docs, ids, size, seg, first = [], [], 0, 0, 0
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())

        def segment():
            row = (part, seg, first, size, [d for d, _ in docs], [n for _, n in docs], coder.pack(np.concatenate(ids)))
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], names=["part", "seg", "first", "n_ids", "doc_ids", "n_tokens", "data"])

        for b in batches:
            for d, own in zip(b.column(0), _encoded(encode, b.column(1))):
                own = np.append(own, np.uint32(end_id))
                if docs and size + len(own) > SEGMENT:
                    yield segment()
                    seg, first = seg + 1, first + size
                    docs, ids, size = [], [], 0
                docs.append((d.as_py(), len(own)))
                ids.append(own)
                size += len(own)
        if docs:
            yield segment()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PART_ROWS))
    rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "raw").mapInArrow(run, SEGMENTS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32``.

    Each block's checksum is verified.  Only one row for each part meets in one
    task, to place the parts one after the other.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                part, first, docs, sizes, data = (b.column(c)[k].as_py() for c in ("part", "first", "doc_ids", "n_tokens", "data"))
                raw = memoryview(coder.unpack(data).astype("<u4").tobytes())
                ends = np.cumsum(np.array(sizes, np.int64))
                starts = ends - sizes
                crc = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(starts, ends)]
                yield pa.record_batch([pa.array([part] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(starts + first, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["part", "doc_id", "place", "n_tokens", "ids_crc32"])

    rows = segments.select("part", "first", "doc_ids", "n_tokens", "data").mapInArrow(run, "part int, doc_id long, place long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # One row for each range partition that was written: the number of partitions bounds it.
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("place")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, end_id: int = 2, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to the shared folder and read them back."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, path, end_id, tokenizer, id_col, text_col)
    return read(spark, path)
