"""Tokenizer files: where they lie and how bytes are written in them.

A path may be given to every operator; without one, the installed package of
public tokenizer files tells where its files are.
"""

from __future__ import annotations

import ctypes
import gc
import json
from collections.abc import Callable
from functools import lru_cache
from itertools import islice
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def default_path(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the others take the code
    points from 256 upwards in ascending order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    spare = (b for b in range(256) if b not in letters)
    letters.update({b: chr(256 + k) for k, b in enumerate(spare)})
    return letters


@lru_cache(maxsize=1)
def letter_table() -> dict[int, str]:
    """For ``str.translate`` on text decoded as Latin-1."""
    return dict(byte_letters())


def to_letters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(letter_table())


_HELD: dict = {}


def held(key: tuple, build: Callable[[], T]) -> T:
    """A worker's large state for one operator: what the last operator kept makes room for it."""
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = build()
        give_back()
    return _HELD[key]


def give_back() -> None:
    """Return free memory to the system.

    A worker lives through many stages, and its allocators keep the pages that earlier
    ones have freed; they would count beside what this stage takes.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


class BoundedCache(dict):
    """A dict that drops the older half of its entries once it holds ``limit``."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def keep(self, key, value):
        if len(self) >= self.limit:
            for old in [*islice(self, len(self) // 2 + 1)]:
                del self[old]
        self[key] = value
        return value


class RecentCache:
    """Of at most ``limit`` entries those asked for of late, in two generations.

    Once the young generation is full it becomes the old one; what is found in
    the old one is young again.
    """

    def __init__(self, limit: int):
        self.half = max(1, limit // 2)
        self.young: dict = {}
        self.old: dict = {}

    def __len__(self) -> int:
        return len(self.young) + len(self.old)

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value
