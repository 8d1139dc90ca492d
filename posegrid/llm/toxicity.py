"""Toxicity: a learned lexicon, misspellings by Levenshtein automata, context windows.

Terms (words, and stems that words begin with) whose documents are toxic far
more often than others are learned from a bounded sample of labelled rows.
Their trie, intersected with Levenshtein automata of distance 1 over characters,
is compiled into one table-driven automaton, which runs over the distinct words
of a batch side by side.  Words hold letters and digits; a chunk of text with
signs inside is looked up in its pieces and, where none of them is a term,
without the signs.  Each hit has a weight, the log odds measured for its term at
its distance; inside quotation marks it counts for a share that is learned too.
The heaviest window of words and the sum over the text go into a logistic score.

Defined results: a null or empty text has no hit and gets the score of no hits;
a very long text is scored whole; repeated rows give repeated rows; where labels
of one document disagree the greater one holds; an empty table gives an empty
table; other columns, whatever their names, are ignored by ``score`` and kept by
``keep_clean``.  Where no term passes, every score is the share of toxic rows in
the sample (0 without labelled rows).  Nothing but the text enters a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shingles import shingle_set
from .storage import drop, written
from .vocab import BoundedCache, held

#: Labelled rows that the lexicon and the score are fitted on, those of least hash.
TRAIN_ROWS = 12_000
#: A term stands in this many toxic texts, in this share of them, and more often
#: than chance would have it (likelihood ratio; 20 is a chance of about 1 in 100,000).
MIN_SUPPORT, MIN_SHARE, MIN_RATIO = 4, 0.01, 20
MIN_ODDS = 2.5
STEMS = (4, 5, 6, 7, 8)
#: Words of a window, and what a quoted hit is thought to count before any was seen.
WINDOW, QUOTED = 40, 0.4
CHUNK_ENTRIES, LONGEST = 150_000, 32

#: A chunk that is one word and no hit.
_PLAIN = (1,)
_PIECES = re.compile(r"[^\W_]+")
_QUOTES = re.compile(rb'"|\xe2\x80\x9c|\xe2\x80\x9d|\xc2\xab|\xc2\xbb|\xe2\x80\x9e')


# -- automaton ------------------------------------------------------------------


@dataclass
class Automaton:
    """A deterministic automaton over classes of characters.

    ``letters`` are the characters that terms have, ascending; class 0 is any other
    one.  ``accept[state]`` is 0 or 1 + 2 * term + distance.
    """

    letters: np.ndarray
    step: np.ndarray
    accept: np.ndarray

    def run(self, words: list[str]) -> np.ndarray:
        """The accepting code of each word; words beyond ``LONGEST`` characters count by their start."""
        n = len(words)
        flat = np.frombuffer("".join(w[:LONGEST].ljust(LONGEST, "\0") for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, LONGEST)
        at = np.minimum(np.searchsorted(self.letters, flat), len(self.letters) - 1)
        letters = np.where(self.letters[at] == flat, at + 1, 0)
        size = np.array([min(len(w), LONGEST) for w in words])
        order = np.argsort(-size, kind="stable")
        state = np.zeros(n, np.int32)
        for j in range(int(size.max(initial=0))):
            some = order[: n - np.searchsorted(size[order][::-1], j, side="right")]
            state[some] = self.step[state[some], letters[some, j]]
        found = self.accept[state]
        return np.where((np.array([len(w) for w in words]) > LONGEST) & (self.sticky[state] == 0), 0, found)

    sticky: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int8))


def compile_automaton(terms: list[tuple[str, bool]], fuzzy_from: int = 5) -> Automaton:
    """Intersect the terms' trie with Levenshtein automata of distance 1.

    ``terms``: letters, and whether it is a stem.  A stem accepts every word that
    begins with it; another term accepts itself, and from ``fuzzy_from`` letters on
    every word at distance 1.  A state is a set of (trie node, edits so far).
    """
    nodes: list[dict[str, int]] = [{}]
    ends: list[list[tuple[int, bool]]] = [[]]
    longest: list[int] = [0]  # of the terms below a node that allow an edit
    for t, (word, stem) in enumerate(terms):
        at, path = 0, [0]
        for b in word:
            if b not in nodes[at]:
                nodes[at][b] = len(nodes)
                nodes.append({})
                ends.append([])
                longest.append(0)
            at = nodes[at][b]
            path.append(at)
        ends[at].append((t, stem))
        if not stem and len(word) >= fuzzy_from:
            for p in path:
                longest[p] = 1
    alphabet = sorted({b for n in nodes for b in n})

    def closed(states: set[tuple[int, int]]) -> frozenset:
        out = set(states)
        for n, e in states:  # a letter of the term left out
            if e == 0 and longest[n]:
                out |= {(m, 1) for m in nodes[n].values() if longest[m]}
        return frozenset((n, e) for n, e in out if not (e == 1 and (n, 0) in out))

    def accepted(states: frozenset) -> int:
        best = None
        for n, e in states:
            if n < 0:
                code = (0, -1 - n)
            else:
                own = [(e, t) for t, stem in ends[n] if (e == 0 or (not stem and longest[n]))]
                code = min(own, default=None)
            if code and (best is None or code < best):
                best = code
        return 0 if best is None else 1 + 2 * best[1] + best[0]

    def after(states: frozenset, b: str | None) -> frozenset:
        out: set[tuple[int, int]] = set()
        for n, e in states:
            if n < 0:
                out.add((n, e))
                continue
            if b is not None and b in nodes[n] and (e == 0 or longest[nodes[n][b]]):
                m = nodes[n][b]
                out.add((m, e))
                if e == 0:
                    out |= {(-1 - t, 0) for t, stem in ends[m] if stem}
            if e == 0 and longest[n]:
                out.add((n, 1))  # a letter too many
                out |= {(m, 1) for c, m in nodes[n].items() if c != b and longest[m]}  # another letter
        return closed(out)

    first = closed({(0, 0)})
    number, rows, queue = {first: 0}, [], [first]
    while queue:
        state = queue.pop(0)
        row = []
        for b in [None, *alphabet]:
            to = after(state, b)
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            row.append(number[to])
        rows.append(row)
    accept = np.zeros(len(number), np.int32)
    sticky = np.zeros(len(number), np.int8)
    for s, k in number.items():
        accept[k] = accepted(s)
        sticky[k] = any(n < 0 for n, _ in s)
    return Automaton(np.array([ord(b) for b in alphabet] or [0], np.uint32), np.array(rows, np.int32), accept, sticky)


# -- scoring --------------------------------------------------------------------


@dataclass
class Lexicon:
    """What is sent to the tasks: terms of the bounded sample and a few numbers."""

    terms: list[tuple[str, bool]]
    automaton: Automaton | None
    #: by accepting code; 0 where a hit says nothing
    weight: np.ndarray
    coefficients: np.ndarray
    #: what a hit inside quotation marks counts, of one outside
    quoted: float = QUOTED

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """Finds and weighs the terms of texts; keeps what it knows about chunks."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.known: BoundedCache = BoundedCache(CHUNK_ENTRIES)

    def _look_up(self, chunks: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Of each chunk the number of its words, then (word, code) of its hits, one after the other."""
        runs = [_PIECES.findall(c.decode("utf-8").lower()) for c in chunks]
        # a chunk of several pieces is also a word without what stands between them
        words = [r for own in runs for r in (own if len(own) < 2 else [*own, "".join(own)])]
        codes = iter(self.lexicon.automaton.run(words).tolist() if words else [])
        out = {}
        for c, own in zip(chunks, runs):
            hits = [(k, x) for k, x in enumerate([next(codes) for _ in own]) if x]
            if len(own) > 1 and (x := next(codes)) and not hits:
                hits = [(0, x)]
            found = (max(1, len(own)), *(v for h in hits for v in h))
            out[c] = found = _PLAIN if found == _PLAIN else found
            if len(c) <= 64:
                self.known.keep(c, found)
        return out

    def hits(self, raw: bytes) -> list[tuple[int, int, bool]]:
        """(word number, accepting code, inside quotation marks) of each hit."""
        chunks = raw.split()
        codes = [*map(self.known.get, chunks)]
        if None in codes:
            new = self._look_up([*dict.fromkeys(c for c, x in zip(chunks, codes) if x is None)])
            codes = [new[c] if x is None else x for c, x in zip(chunks, codes)]
        found = [k for k, x in enumerate(codes) if len(x) > 1]
        if not found:
            return []
        first = np.cumsum([0] + [x[0] for x in codes])
        marks = np.array([k for k, c in enumerate(chunks) for _ in _QUOTES.findall(c)] if _QUOTES.search(raw) else [], np.int64)
        before, upto = np.searchsorted(marks, found, "left").tolist(), np.searchsorted(marks, found, "right").tolist()
        out = []
        for k, b, e in zip(found, before, upto):
            same, after = e - b, len(marks) - e
            quoted = same >= 2 or (b % 2 == 1 and same + after > 0) or (b % 2 == 0 and same == 1 and after > 0)
            x = codes[k]
            out += [(int(first[k]) + x[j], x[j + 1], quoted) for j in range(1, len(x), 2)]
        return out

    def features(self, hits: list[tuple[int, int, bool]]) -> tuple[float, float]:
        """Weight of the heaviest window, and log of the whole weight."""
        share = self.lexicon.quoted
        w = [(k, self.lexicon.weight[x] * (share if quoted else 1)) for k, x, quoted in hits]
        best = total = inside = 0.0
        start = 0
        for k, own in w:
            inside += own
            total += own
            while w[start][0] <= k - WINDOW:
                inside -= w[start][1]
                start += 1
            best = max(best, inside)
        return best, float(np.log1p(max(total, 0.0)))

    def score(self, raw: bytes) -> float:
        if self.lexicon.automaton is None:
            return float(self.lexicon.coefficients[0])
        a = self.lexicon.coefficients
        x = self.features(self.hits(raw))
        return float(1 / (1 + np.exp(-np.clip(a[0] + a[1] * x[0] + a[2] * x[1], -30, 30))))


# -- learning -------------------------------------------------------------------


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^\\p{L}]+"), lambda w: F.length(w) > 1))


def _stems(k: int) -> Column:
    """The first ``k`` letters of longer words, with a star."""
    return F.transform(F.filter("words", lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str, id_col: str, text_col: str) -> DataFrame:
    """``text`` and ``label`` of at most ``TRAIN_ROWS`` labelled rows.

    Of texts that share a label and the least hash of four words in a row only the
    first one in their order counts, so that copies don't pass a chance word off as
    a term.
    """
    marked = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # an id may stand for several rows: the bound holds for rows
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(TRAIN_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py().encode(), 4) for t in b.column(0)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([int(x[0] >> np.uint64(1)) if len(x) else -1 for x in sets], pa.int64())], names=["text", "label", "least"])

    return rows.select("text", "label").mapInArrow(run, "text string, label int, least long").groupBy("label", "least").agg(F.min("text").alias("text")).select("text", "label", _words(F.col("text")).alias("words"))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Fit the lexicon, the hits' weights and the score on the bounded sample."""
    rows = written(training_rows(docs, labels, usable, label_col, id_col, text_col), "toxicity-sample")
    try:
        return _fit(rows)
    finally:
        drop(rows)


def _fit(rows: DataFrame) -> Lexicon:
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    plain = Lexicon([], None, np.zeros(1), np.array([pos / max(1, pos + neg), 0, 0]))
    if not pos or not neg:
        return plain
    stems = [_stems(k) for k in STEMS]
    terms = rows.select("label", F.explode(F.array_distinct(F.concat("words", *stems))).alias("term"))
    odds = F.log((F.col("p") + 0.5) / F.lit(float(pos)) / ((F.col("q") + 0.5) / F.lit(float(neg))))
    counted = terms.groupBy("term").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q")).where(F.col("p") >= max(MIN_SUPPORT, MIN_SHARE * pos)).withColumn("odds", odds)
    share = pos / (pos + neg)
    ratio = 2 * (F.col("p") * F.log(F.col("p") / ((F.col("p") + F.col("q")) * share)) + F.when(F.col("q") > 0, F.col("q") * F.log(F.col("q") / ((F.col("p") + F.col("q")) * (1 - share)))).otherwise(0))
    best = counted.where((F.col("odds") >= MIN_ODDS) & (ratio >= MIN_RATIO)).orderBy(F.desc(F.col("p") * F.col("odds")), "term").collect()  # terms of TRAIN_ROWS texts
    stems_kept, kept = [], []
    support = {r["term"]: r["p"] for r in best}
    for term in support:
        w, stem = term.rstrip("*"), term.endswith("*")
        # A stem that mostly stands for one word would only hide that word's misspellings.
        if stem and any(2 * n >= support[term] for t, n in support.items() if t[-1] != "*" and t.startswith(term[:-1])):
            continue
        # What a better stem covers, or would be covered by, says nothing new.
        if len(w) < LONGEST - 1 and not any(w.startswith(x) or (stem and x.startswith(w)) for x in stems_kept):
            kept.append((w, stem))
            stems_kept += [w] * stem
    kept.sort()
    if not kept:
        return plain
    lexicon = Lexicon(kept, compile_automaton(kept), np.ones(2 * len(kept) + 1), np.zeros(3))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lexicon.matcher()
        for b in batches:
            out = [m.hits(t.as_py().encode()) for t in b.column(0)]
            yield pa.record_batch([b.column(1), pa.array([[h[0] for h in o] for o in out], pa.list_(pa.int32())), pa.array([[h[1] for h in o] for o in out], pa.list_(pa.int32())), pa.array([[h[2] for h in o] for o in out], pa.list_(pa.bool_()))], names=["label", "at", "code", "quoted"])

    # Bounded by TRAIN_ROWS; the hits of a text, by its terms.
    hits = rows.select("text", "label").mapInArrow(find, "label int, at array<int>, code array<int>, quoted array<boolean>").collect()
    p, q = np.zeros(len(lexicon.weight)), np.zeros(len(lexicon.weight))
    for r in hits:
        own = np.array(sorted(set(r["code"])), int)
        (p if r["label"] else q)[own] += 1
    weight = np.log((p + 0.5) / (pos + 1) / ((q + 0.5) / (neg + 1)))
    weight[(p < 3) | (weight < 1)] = 0  # too rare or too weak to say anything
    unseen = (p + q)[2::2] < 3  # misspellings that the sample hardly has: half of what the term says
    weight[2::2][unseen] = weight[1::2][unseen] / 2
    lexicon.weight = weight
    y = np.array([r["label"] for r in hits], float)
    best = None
    for share in np.linspace(0, 1, 11):  # what a quoted hit counts is fitted with the rest, from QUOTED on
        lexicon.quoted = float(share)
        m = lexicon.matcher()
        x = np.array([(1.0, *m.features([*zip(r["at"], r["code"], r["quoted"])])) for r in hits])
        a = logistic(x, y)
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        loss = -np.log(np.where(y == 1, p, 1 - p)).sum() + 0.5 * (a[1:] ** 2).sum() + 2 * (share - QUOTED) ** 2
        if best is None or loss < best[0]:
            best = loss, lexicon.quoted, a
    lexicon.quoted, lexicon.coefficients = best[1], best[2]
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; the first column is the intercept."""
    a = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ a)
        a += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return a


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every whole text, in one pass without a shuffle."""
    import random

    key = random.getrandbits(62)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held(("toxicity", key), lexicon.matcher)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([m.score(raw.as_py() or b"") for raw in b.column(1)], pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows scored below ``threshold``, with all their columns as they are."""
    import random

    key = random.getrandbits(62)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held(("toxicity", key), lexicon.matcher)
        for b in batches:
            keep = [m.score(t.as_py() or b"") < threshold for t in b.column("raw")]
            yield b.select(["row"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, StructType([rows.schema["row"]])).select("row.*")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Scores of all documents, learned from the rows that are not held out.

    Columns: ``doc_id``, ``held_out`` boolean, ``score`` double, ``predicted`` int.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    lexicon = learn(docs, labels, fold != held_out)
    scored = score(docs, lexicon)
    return scored.select("doc_id", (fold == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
