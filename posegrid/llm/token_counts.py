"""Exact token counts at every prefix, by dynamic programming.

In byte-pair encoding a token sequence is the encoding of its text exactly when
each adjacent pair of tokens is, on its own, the encoding of the pair's text.
So every prefix of a word has one last token, and

    count(prefix) = count(prefix without its last token) + 1

gives the number of tokens at all prefixes in one pass.  The table answers
"how many tokens has the text up to here" and "how far can I go with this
budget", at any character, without encoding anything again.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a very long
text, with white space or without, is counted whole; repeated rows give repeated
rows; an empty table gives an empty table; other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocab import WORD_BPE, BoundedCache, default_path, held, load_spec, to_letters

#: Entries kept by a worker for white-space separated chunks, words, prefixes of words and token pairs.
CHUNK_ENTRIES, WORD_ENTRIES, PREFIX_ENTRIES, PAIR_ENTRIES = 800_000, 300_000, 400_000, 400_000
#: Chunks whose counts at every prefix a worker keeps.
INSIDE_ENTRIES = 50_000

_PLAIN = re.compile(r"([A-Za-zß-öø-ÿÀ-ÖØ-Þ]+)([.,]?)")


class PrefixCounter:
    """Token counts of all prefixes under a word-level BPE tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = load_spec(path)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab = frozenset(model["vocab"])
        self.longest = max(map(len, self.vocab))
        self.rank = {tuple(m): k for k, m in enumerate(model["merges"])}
        self.specials = [t["content"] for t in spec["added_tokens"] if t["content"]]
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.special_bytes = [s.encode() for s in self.specials]
        rules = Tokenizer.from_file(path)
        self.normalize, self.split = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.chunks: BoundedCache = BoundedCache(CHUNK_ENTRIES)
        self.words: BoundedCache = BoundedCache(WORD_ENTRIES)
        self.insides: BoundedCache = BoundedCache(INSIDE_ENTRIES)
        self.pairs: BoundedCache = BoundedCache(PAIR_ENTRIES)
        self.prefixes: BoundedCache = BoundedCache(PREFIX_ENTRIES)

    # -- pairs ---------------------------------------------------------------

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the two tokens' symbols gives just these two again."""
        known = self.pairs.get((left, right))
        if known is None:
            parts = self._symbols(left) + self._symbols(right)
            while len(parts) > 1:
                best = min((self.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:])))
                if best[0] == 1 << 60:
                    break
                k = best[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            known = self.pairs.keep((left, right), parts == [left, right])
        return known

    # -- one word ------------------------------------------------------------

    def inner(self, letters: str) -> tuple[list[str], list[int]]:
        """Last token and token count of each prefix that does not end the word.

        Words share prefixes, so each prefix's result is kept for other words.
        """
        last, count, known, keep = [""], [0], self.prefixes.get, len(letters) <= 64
        for i in range(1, len(letters) + 1):
            here = known(letters[:i]) if keep else None
            if here is None:
                here = self._step(letters, i, last, count)
                if keep:
                    self.prefixes.keep(letters[:i], here)
            last.append(here[0])
            count.append(here[1])
        return last, count

    def _step(self, letters: str, i: int, last: list[str], count: list[int]) -> tuple[str, int]:
        vocab, pairs, fits = self.vocab, self.pairs, self.compatible
        for j in range(max(0, i - self.longest), i):
            token = letters[j:i]
            if token in vocab and (j == 0 or (fits(last[j], token) if (known := pairs.get((last[j], token))) is None else known)):
                return token, count[j] + 1
        raise ValueError(f"no token ends at {letters[:i]!r}")

    def closing(self, letters: str, i: int, last: list[str], count: list[int]) -> int:
        """Token count of the word that ends after ``i`` letters."""
        if not self.end:
            return count[i]
        for j in range(max(0, i - self.longest), i):
            token = letters[j:i] + self.end
            if token in self.vocab and (j == 0 or self.compatible(last[j], token)):
                return count[j] + 1
        raise ValueError(f"no token closes {letters[:i]!r}")

    def word(self, letters: str) -> int:
        known = self.words.get(letters)
        if known is None:
            if letters + self.end in self.vocab and self._reaches(letters + self.end):
                known = 1
            else:
                known = self.closing(letters, len(letters), *self.inner(letters[:-1]))
            if len(letters) <= 64:
                self.words.keep(letters, known)
        return known

    @lru_cache(maxsize=65_536)  # noqa: B019  one counter lives as long as its worker
    def _reaches(self, token: str) -> bool:
        parts = self._symbols(token)
        while len(parts) > 1:
            best = min((self.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 60:
                return False
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return True

    # -- one text ------------------------------------------------------------

    def chunk(self, raw: bytes) -> int:
        """Token count of a chunk without ASCII white space."""
        text = raw.decode("utf-8")
        plain = _PLAIN.fullmatch(text)
        if plain:
            total = self.word(to_letters(plain[1].lower().encode())) + (self.word(plain[2]) if plain[2] else 0)
        else:
            total = sum(self.word(w) for w, _ in self.split(self.normalize(text)))
        if len(raw) <= 64:
            self.chunks.keep(raw, total)
        return total

    def segments(self, raw: bytes) -> list[tuple[bytes, bool]]:
        """The text between special strings, and those strings (True)."""
        if not any(s in raw for s in self.special_bytes):
            return [(raw, False)]
        parts = self.special_pattern.split(raw.decode("utf-8"))
        return [(p.encode(), k % 2 == 1) for k, p in enumerate(parts) if p]

    def count(self, raw: bytes) -> int:
        total, known, fresh = 0, self.chunks.get, self.chunk
        for part, special in self.segments(raw):
            if special:
                total += 1
                continue
            for c in part.split():
                n = known(c)
                total += fresh(c) if n is None else n
        return total

    def inside(self, raw: bytes) -> np.ndarray:
        """Token count of every prefix of a chunk, by characters from 0 on."""
        known = self.insides.get(raw)
        if known is None:
            known = self._inside(raw.decode("utf-8"))
            if len(raw) <= 64:
                self.insides.keep(raw, known)
        return known

    def _inside(self, text: str) -> np.ndarray:
        whole = self.normalize(text)
        if len(whole) != len(text) or any(self.normalize(c) != d for c, d in zip(text, whole)):
            # characters that act on each other: each prefix for itself
            return np.array([sum(self.word(w) for w, _ in self.split(self.normalize(text[:i]))) for i in range(len(text) + 1)], np.int64)
        out, base = np.zeros(len(text) + 1, np.int64), 0
        for w, (a, e) in self.split(whole):
            part = whole[a:e]
            if part[:1] == "'" or not self.end:  # a short form may be split otherwise while it is not whole
                own = [sum(self.word(v) for v, _ in self.split(part[:i])) for i in range(1, len(part) + 1)]
            else:
                last, count = self.inner(w)
                at = np.cumsum([len(c.encode()) for c in part]).tolist()
                own = [self.closing(w, i, last, count) for i in at]
            out[a + 1 : e + 1] = base + np.array(own)
            base = int(out[e])
            out[e + 1 :] = base  # what the rules leave out, such as a no-break space, adds nothing
        return out

    def table(self, raw: bytes) -> tuple[list[int], list[int], list[int]]:
        """Byte starts and ends of the chunks, and the counts before each and after the last.

        A special string is one token once it is whole; while it is not, it belongs
        to the chunk that it would make with the text before it.
        """
        starts, ends, counts, total, base = [], [], [0], 0, 0
        for part, special in self.segments(raw):
            spans = [(0, len(part))] if special else [m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", part)]
            for a, b in spans:
                c = part[a:b]
                n = 1 if special else self.chunks.get(c)
                total += self.chunk(c) if n is None else n
                starts.append(base + a)
                ends.append(base + b)
                counts.append(total)
            base += len(part)
        return starts, ends, counts

    def _prefixes(self, raw: bytes, table: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets of the characters of chunk ``k`` and the text's count at each."""
        starts, ends, counts = table
        a, e = starts[k], ends[k]
        text = raw[a:e].decode("utf-8")
        at = a + np.cumsum([0] + [len(c.encode()) for c in text])
        if raw[a:e] not in self.special_bytes:
            return at, counts[k] + self.inside(raw[a:e])
        # up to here a special string is like any other text that touches the chunk before it
        before = k > 0 and ends[k - 1] == a and raw[starts[k - 1] : a] not in self.special_bytes
        first, upto = (starts[k - 1], counts[k - 1]) if before else (a, counts[k])
        own = self.inside(raw[first:e])[-len(at) :] + upto
        own[-1] = counts[k + 1]
        return at, own

    def count_at(self, raw: bytes, table: tuple, n_bytes: int) -> int:
        """Tokens of the first ``n_bytes`` bytes (cut back to a whole character)."""
        while 0 < n_bytes < len(raw) and raw[n_bytes] & 0xC0 == 0x80:
            n_bytes -= 1
        starts, ends, counts = table
        k = bisect_right(starts, n_bytes) - 1
        if k < 0 or n_bytes >= ends[k]:
            return counts[k + 1]
        at, own = self._prefixes(raw, table, k)
        return int(own[np.searchsorted(at, n_bytes)])

    def cut(self, raw: bytes, table: tuple, budget: int) -> int:
        """Bytes of the longest prefix, in whole characters, with at most ``budget`` tokens."""
        starts, ends, counts = table
        k = bisect_right(counts, budget) - 1
        if k == len(starts):
            return len(raw)
        # whole chunks up to here fit; of the rest only the next chunk may have a prefix that does
        at, own = self._prefixes(raw, table, k)
        return int(at[np.flatnonzero(own <= budget)[-1]])

    def prefix_counts(self, raw: bytes) -> np.ndarray:
        """The text's count at every character from 0 on."""
        table = self.table(raw)
        lead = np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)
        places = np.append(lead, len(raw))
        out = np.array(table[2])[np.searchsorted(table[1], places, "right")]
        for k in range(len(table[0])):
            at, own = self._prefixes(raw, table, k)
            i = int(np.searchsorted(places, at[0]))
            out[i + 1 : i + len(at)] = own[1:]
        return out


def counter(path: str) -> PrefixCounter:
    return held(("counts", path), lambda: PrefixCounter(path))


def token_counts(docs: DataFrame, limit: int = 2048, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes, tokens and ``over_limit`` of every whole text, and where the limit ends in it.

    Columns: ``doc_id`` (the id column), ``n_bytes`` long, ``n_tokens`` long,
    ``over_limit`` boolean, ``cut_bytes`` long (of the longest prefix, in whole
    characters, with at most ``limit`` tokens).  One pass and no shuffle.
    """
    path = tokenizer or default_path(WORD_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            sizes, totals, cuts = [], [], []
            for raw in b.column(1):
                raw = raw.as_py() or b""
                sizes.append(len(raw))
                totals.append(c.count(raw))
                cuts.append(len(raw) if totals[-1] <= limit else c.cut(raw, c.table(raw), limit))
            over = [n > limit for n in totals]
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array(over, pa.bool_()), pa.array(cuts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_bytes"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long")


def prefix_tables(docs: DataFrame, budgets: list[int], tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The prefix table of every text, to be stored, and where each budget ends in it.

    Columns: ``doc_id``, ``counts`` (exact tokens of the first 0, 1, 2, ...
    characters) and ``cuts`` (for each budget, bytes of the longest prefix that fits).
    """
    path = tokenizer or default_path(WORD_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            for k in range(0, b.num_rows, 64):  # tables are larger than texts
                some = b.slice(k, 64)
                raws = [raw.as_py() or b"" for raw in some.column(1)]
                tables = [c.table(raw) for raw in raws]
                yield pa.record_batch([some.column(0), pa.array([c.prefix_counts(raw) for raw in raws], pa.list_(pa.int64())), pa.array([[c.cut(raw, t, n) for n in budgets] for raw, t in zip(raws, tables)], pa.list_(pa.int64()))], names=["doc_id", "counts", "cuts"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, counts array<long>, cuts array<long>")
