"""Hashes of all words of many texts at once, on byte arrays."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

#: Bytes of text that are hashed at once; longer texts are cut at white space, never inside a word.
PIECE = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(text number, part) lists of about PIECE bytes; a long text comes in parts that end at white space."""
    owners, parts, held = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            stop = at + PIECE
            if stop < len(text):
                gap = _GAP.search(text, stop)
                stop = gap.end() if gap else len(text)
            owners.append(i)
            parts.append(text[at:stop])
            held += len(parts[-1])
            at = max(stop, 1)
            if held >= PIECE:
                yield owners, parts
                owners, parts, held = [], [], 0
    if owners:
        yield owners, parts


class Words:
    """Words of joined parts: starts, stops (in raw), part (of each word), hashes."""

    def __init__(self, parts: list[bytes], separators: np.ndarray = SPACE, fold: bool = False):
        joined = b"\n".join(parts) + b"\n"
        self.raw = np.frombuffer(joined, np.uint8)
        if fold:
            self.raw = LOWER[self.raw]
        gap = separators[self.raw]
        edge = np.diff(np.concatenate([[True], gap]).astype(np.int8))
        self.starts, self.stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        bounds = np.cumsum([len(p) + 1 for p in parts])
        self.part = np.searchsorted(bounds, self.starts, "right")
        if len(self.starts):
            place = np.arange(len(self.raw), dtype=np.int64)
            place -= np.repeat(self.starts, np.diff(np.append(self.starts, len(self.raw)))) if self.starts[0] == 0 else np.concatenate(
                [np.zeros(self.starts[0], np.int64), np.repeat(self.starts, np.diff(np.append(self.starts, len(self.raw))))])
            value = _BYTE[self.raw] * _PLACE[place & 255]
            value[gap] = 0
            self.hashes = mixed(np.add.reduceat(value, self.starts) + (self.stops - self.starts).astype(np.uint64))
        else:
            self.hashes = np.zeros(0, np.uint64)


def each(texts: list[bytes], use: Callable[[list[int], Words], None], **how) -> None:
    for owners, parts in pieces(texts):
        use(owners, Words(parts, **how))
