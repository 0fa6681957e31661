"""Token ids of whole texts by a public byte-level BPE tokenizer, as the library's encode(add_special_tokens=False) gives them.

Merges are the costly part and words repeat, so the texts of an Arrow batch are cut into chunks, each distinct chunk is
encoded by the library once, and a worker remembers short chunks. A chunk begins at each ASCII white space that something
other than white space follows. Such a cut is safe for byte-level pre-tokenizers: their pattern splits the last character
off a run of white space before a word, whatever stands before it. Texts that hold an added token of the file, special or
not, go to the library whole, as do all texts of a tokenizer of another kind. A test compares the ids with the library's.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .words import SPACE, mixed

#: Places for remembered chunks (28 bytes each), and ids of theirs after which a worker starts anew.
SLOTS = 1 << 20
POOL = 6_000_000
#: Bytes of a chunk that a place can hold; chunks that are longer are encoded once a batch.
SHORT = 16
#: The end-of-document id that the contracts append.
END = 0
_STEP = 1 << 22
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: First bytes of characters that are surely no white space, those that may be, and second bytes of white space then.
_SURE = np.array([0x21 <= b < 0x7F or b >= 0xC3 and b not in (0xE1, 0xE2, 0xE3) for b in range(256)])
_LEAD = np.isin(np.arange(256), (0xC2, 0xE1, 0xE2, 0xE3))
_SECOND = np.isin(np.arange(256), (0x80, 0x81, 0x85, 0x9A, 0xA0))


def starts_of(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First bytes of the chunks of joined texts; ends: where texts begin and end, which no chunk spans."""
    cut = np.zeros(len(raw), bool)
    for at in range(0, len(raw) - 1, _STEP):
        here = raw[at : at + _STEP + 2]
        n = min(_STEP, len(here) - 1)
        gap = np.flatnonzero(SPACE[here[:n]])
        after, second = here[gap + 1], here[np.minimum(gap + 2, len(here) - 1)]
        cut[at + gap[_SURE[after] | (_LEAD[after] & ~_SECOND[second])]] = True
    filled = np.diff(ends) > 0
    cut[ends[1:][filled] - 1] = False  # what follows the last character is another text
    cut[ends[:-1][filled]] = True
    return np.flatnonzero(cut)


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary file stands for: visible Latin-1 characters for themselves,
    characters from 256 on for the other bytes in ascending order."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str, slots: int = SLOTS, pool: int = POOL, plain: bool = False):
        """plain: the strings of special tokens are ordinary text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallel work
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        as_is = not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
        self.cuts = as_is and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.added = [] if plain else [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.library.encode_special_tokens = plain
        self.n_ids = self.library.get_vocab_size(with_added_tokens=True)
        # the files of byte-level tokenizers write each byte as one character
        self.size = np.zeros(self.n_ids, np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.size[i] = len(token)
        self.slots, self.most = slots, pool
        self.clear()

    def token_bytes(self) -> list[bytes]:
        """The bytes that each id stands for."""
        byte_of, out = byte_characters(), [b""] * self.n_ids
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        return out

    def starts_of(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return starts_of(raw, ends)

    def clear(self) -> None:
        self.lo, self.hi = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.at, self.count = np.zeros(self.slots, np.int64), np.full(self.slots, -1, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _library(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places in the pool, and numbers, of the ids of each chunk.

        A chunk that begins with white space and something else stays apart from what it is joined to, so such chunks are
        encoded as one text, whose ids are dealt out by the bytes that they stand for.
        """
        apart = np.array([x[0] in b" \t\n\v\f\r" and x[1:2] not in (b"", b" ", b"\t", b"\n", b"\v", b"\f", b"\r") and _SURE[x[1]] for x in chunks], bool)
        joined = [x for x, a in zip(chunks, apart, strict=True) if a]
        ids = np.array(self.library.encode(b"".join(joined).decode(), add_special_tokens=False).ids if joined else [], np.int64)
        count = np.zeros(len(chunks), np.int32)
        reached = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(x) for x in joined]), "right") if joined else np.zeros(0, np.int64)
        count[apart] = np.diff(reached, prepend=0)
        others = [e.ids for e in self.library.encode_batch([x.decode() for x, a in zip(chunks, apart, strict=True) if not a], add_special_tokens=False)]
        count[~apart] = [len(x) for x in others]
        total = len(ids) + sum(map(len, others))
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.pool[self.used + len(ids) : self.used + total] = [i for x in others for i in x]
        at = np.zeros(len(chunks), np.int64)
        at[apart] = self.used + np.cumsum(count[apart]) - count[apart]
        at[~apart] = self.used + len(ids) + np.cumsum(count[~apart]) - count[~apart]
        self.used += total
        return at, count

    def _known(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the pool, and numbers, of the ids of chunks of raw, which has 2 * SHORT bytes more."""
        at, count = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int32)
        eight = np.ndarray(len(raw) - 7, np.dtype("<u8"), raw.data, strides=(1,))
        lo, hi = eight[starts] & _MASK[np.minimum(sizes, 8)], eight[starts + 8] & _MASK[np.clip(sizes - 8, 0, 8)]
        short = sizes <= SHORT
        if (raw[starts[0] : starts[-1] + sizes[-1]] == 0).any():  # a zero byte looks like the end of a shorter chunk
            short &= np.add.reduceat(raw == 0, np.append(starts, starts[-1] + sizes[-1]))[:-1] == 0
        slot = (mixed(lo * np.uint64(0x9E3779B97F4A7C15) ^ hi * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(self.slots)).astype(np.int64)
        for way in (0, 1):
            own = np.flatnonzero(short & (count < 0)) if way else np.flatnonzero(short)
            place = slot[own] ^ way
            hit = (self.lo[place] == lo[own]) & (self.hi[place] == hi[own]) & (self.count[place] >= 0)
            at[own[hit]], count[own[hit]] = self.at[place[hit]], self.count[place[hit]]
        new = np.flatnonzero(short & (count < 0))
        if len(new):
            order = new[np.lexsort((hi[new], lo[new]))]
            first = np.ones(len(order), bool)
            first[1:] = (lo[order[1:]] != lo[order[:-1]]) | (hi[order[1:]] != hi[order[:-1]])
            one, which = order[first], np.cumsum(first) - 1
            a, c = self._library([raw[s : s + n].tobytes() for s, n in zip(starts[one].tolist(), sizes[one].tolist(), strict=True)])
            at[order], count[order] = a[which], c[which]
            place = slot[one]
            place = np.where(self.count[place] < 0, place, place ^ 1)  # what came first is likely frequent and stays
            self.lo[place], self.hi[place], self.at[place], self.count[place] = lo[one], hi[one], a, c
        long = np.flatnonzero(~short)
        if len(long):
            number: dict[bytes, int] = {}
            which = [number.setdefault(raw[s : s + n].tobytes(), len(number)) for s, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)]
            a, c = self._library(list(number))
            at[long], count[long] = a[which], c[which]
        return at, count

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts of a column (null as empty), and where those of each text begin and end."""
        if self.used > self.most:
            self.clear()
        column = pc.fill_null(column, "").cast(pa.large_string())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.zeros(int(ends[-1] - ends[0]) + 2 * SHORT, np.uint8)
        if len(raw) > 2 * SHORT:
            raw[: -2 * SHORT] = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        text = raw[: -2 * SHORT]
        whole = set(range(len(column))) if not self.cuts else self._with_added(text, ends)
        starts = self.starts_of(text, ends) if self.cuts else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(text)))
        if whole and len(starts):
            own = ~np.isin(np.searchsorted(ends, starts, "right") - 1, list(whole))
            starts, sizes = starts[own], sizes[own]
        at, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int32)
        for lo in range(0, len(starts), _STEP // 8):
            part = slice(lo, lo + _STEP // 8)
            at[part], count[part] = self._known(raw, starts[part], sizes[part])
        before = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        ids = self.pool[np.repeat(at - before[:-1], count) + np.arange(before[-1])]
        edge = before[np.searchsorted(starts, ends)]
        begin, end = edge[:-1].copy(), edge[1:].copy()
        more, n = [ids], len(ids)
        for i in sorted(whole):
            own = np.array(self.library.encode(text[ends[i] : ends[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            begin[i], end[i] = n, n + len(own)
            more.append(own)
            n += len(own)
        return np.concatenate(more).astype("<u4", copy=False), begin, end

    def _with_added(self, text: np.ndarray, ends: np.ndarray) -> set[int]:
        """Texts that hold an added token."""
        joined, found = text.tobytes(), set()
        for token in self.added:
            at = joined.find(token)
            while at >= 0:
                i = int(np.searchsorted(ends, at, "right")) - 1
                if at + len(token) <= ends[i + 1]:
                    found.add(i)
                at = joined.find(token, at + 1)
        return found

    def documents(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text and the end of document, little-endian unsigned 32-bit."""
        ids, begin, end = self.batch(column)
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            yield np.append(ids[a:b], np.array([END], "<u4"))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


class PieceEncoder(Encoder):
    """Ids of texts that begin with a space, which stands for the one that a sentencepiece BPE model puts before a text.

    No piece has a space after anything but spaces (checked), so each run of spaces and what follows it is a chunk.
    """

    def __init__(self, path: str, slots: int = SLOTS, pool: int = POOL):
        from sentencepiece import SentencePieceProcessor

        self.library, self.cuts, self.added = SentencePieceProcessor(model_file=path), True, []
        self.n_ids = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(self.n_ids)]
        self.space = self.library.piece_to_id("\u2581")
        if any("\u2581" in p.lstrip("\u2581") for p in self.pieces):
            raise ValueError("a piece goes on after a space")
        self.size = np.array([len(b) for b in self.token_bytes()], np.int64)
        self.slots, self.most = slots, pool
        self.clear()

    def token_bytes(self) -> list[bytes]:
        return [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(self.pieces)]

    def starts_of(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        space = raw == 0x20
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[ends[:-1][np.diff(ends) > 0]] = True
        return np.flatnonzero(cut)

    def _library(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode([x[1:].decode() for x in chunks], num_threads=1)
        # the model puts no space before an empty text
        found = [own if x != b" " else [self.space] for x, own in zip(chunks, found, strict=True)]
        count = np.fromiter(map(len, found), np.int32, len(found))
        total = int(count.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + total] = [i for x in found for i in x]
        at = self.used + np.cumsum(count, dtype=np.int64) - count
        self.used += total
        return at, count


def n_pieces(path: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path).get_piece_size()


@lru_cache(maxsize=2)
def pair_of_encoders(byte_path: str, piece_path: str) -> tuple[Encoder, PieceEncoder]:
    """One pair for each worker process; both take texts with a space before them, special strings as text."""
    return Encoder(byte_path, plain=True), PieceEncoder(piece_path)
