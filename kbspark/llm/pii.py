"""Operator 10: personal data, by base patterns and a skip-chain conditional random field.

Base patterns find e-mail addresses, IP addresses, payment cards and phone numbers in every whole text. The field adds
what they miss: its nodes are the tokens that hold a digit, an @ or a spelled-out one, and CONTEXT tokens on each side of
them. Potentials are a node's hashed features (shapes of the whole token, its neighbours and its run of numbers, check
sums, words beside it), a bigram table of neighbours, and an agreement term for each kind on skip links between distant
tokens of the same or similar content (equal letters and digits, or equal last seven digits); each token is linked to the
next such one, so links grow with the text. Tokens of base spans are given. Loopy sum-product messages pass over both
kinds of links, so a mention that its own form leaves open takes the label of another mention anywhere in the text. A
token that is surely of a kind becomes a span, joined with neighbours of its kind. Base spans always stay.

The field is trained here, on at most SAMPLE documents (smallest id hashes among those with a digit or @; the bound is a
parameter), all tokens of each. A document with base spans is also read in COPIES other versions, in which values are
written in ways that the patterns miss (without the plus, other separators, a spelled-out at), stand beside each other or
are mentioned again in part, among harmless numbers. Other tokens that look like personal data are unlabelled there. All
weights are learnt together. Features, not texts, come to the driver.

Nulls: null text is empty; null or repeated doc_ids are kept as rows. Positions are code points, ends exclusive. Spans
of different kinds may overlap, those of one kind never do. Of rows with one doc_id the text of the smallest MD5 may teach.
Without a base span in the sample nothing is added. An empty table gives no rows. Long runs of digits or letters
are matched in linear time: patterns start only where a run starts and never give characters back in vain.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, give_back, short_batches, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
SAMPLE = 3_000
COPIES = 8
EPOCHS = 10
FEATURES, N_FEATURES = 1 << 14, 23
#: Tokens on each side of a candidate that are nodes too.
CONTEXT = 2
ROUNDS, UNDAMPED = 24, 4
#: How unlikely other labels of a token of a base span are, as a logarithm.
GIVEN = 30.0
SURE = 0.9
#: How features, labels, chain and skip links travel.
_KINDS = (np.uint16, np.int8, np.int32, np.int32)
_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])
_SQL = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE_RUN = re.compile(r"[ ().0-9-]*")
_MARK = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[\w.%+@()\[\]-]+")
_NUMERIC = re.compile(r"[0-9._()+-]*[0-9][0-9._()+-]*")
_SPELLED = frozenset(("dot", "(dot)", "[dot]", "(at)", "[at]"))
_SPELLED_OUT = re.compile(r"(?<!\w)dot(?!\w)|[(\[]at[)\]]", re.IGNORECASE)
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT_RUN = re.compile(r"[0-9]+")
_COUNTS = re.compile(r"[0-9]+")
_PLAIN = re.compile(r"[^0-9A-Za-z]+")
_DIGITS = re.compile(r"[^0-9]+")


def digits(text: str) -> str:
    return _DIGITS.sub("", text)


def luhn(number: str) -> bool:
    odd, even = number[-1::-2], number[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's local part is all that may stand before an @; so each @ is looked at once."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def phones(text: str) -> Iterator[tuple[int, int]]:
    """A plus, a digit, then to the last digit of a run of digits and phone punctuation, two characters at least."""
    at = text.find("+")
    while at >= 0:
        stop = at + 1
        if text[stop : stop + 1].isascii() and text[stop : stop + 1].isdigit():
            run = _PHONE_RUN.match(text, stop + 1).end()
            while run > stop + 1 and not text[run - 1].isdigit():
                run -= 1
            if run - stop >= 3:
                yield at, run
                stop = run
        at = text.find("+", stop)


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind, then start; matches that fail their kind's test are left out."""
    spans: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        spans += (("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits(m[0])) <= 19 and luhn(d):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += (("phone", a, b) for a, b in phones(text) if 8 <= len(digits(text[a:b])) <= 15)
    return spans


def shape(token: str) -> str:
    """The whole token with each run of digits as its length after a 0, each run of letters as one a."""
    return _LETTERS.sub("a", _DIGIT_RUN.sub(lambda m: f"0{len(m[0])}", token))


def _feature(text: str) -> int:
    return zlib.crc32(text.encode()) % FEATURES


@dataclass
class Graph:
    """Tokens near candidates of a text with features, links of neighbours and skip links."""

    spans: list[tuple[int, int]]
    marked: np.ndarray
    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def graph(text: str) -> Graph:
    found = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]
    marks = [k for k, (t, *_) in enumerate(found) if _MARK.search(t) or t.lower() in _SPELLED]
    number = sorted({j for k in marks for j in range(max(0, k - CONTEXT), min(len(found), k + CONTEXT + 1))})
    place = {k: i for i, k in enumerate(number)}
    tokens = [found[k] for k in number]
    shapes = [shape(t) for t, *_ in tokens]
    words = [t.lower() if t.isalpha() else "" for t, *_ in tokens]
    # runs of numbers with a character between them at most, as one number in groups has
    first, runs = 0, []
    numeric = [bool(_NUMERIC.fullmatch(t)) for t, *_ in tokens]
    for i in range(1, len(tokens) + 1):
        if i == len(tokens) or not (numeric[i] and numeric[i - 1] and number[i] == number[i - 1] + 1 and tokens[i][1] - tokens[i - 1][2] <= 1):
            runs.append((first, i))
            first = i
    rows = [()] * len(tokens)
    for a, b in runs:
        run = "|".join(shapes[a:b]) if b - a <= 8 else f"{b - a} numbers"
        d = digits("".join(t for t, *_ in tokens[a:b]))
        own_run = f"{min(len(d), 24)} {13 <= len(d) <= 19 and luhn(d)}"
        for i in range(a, b):
            t, s = tokens[i][0], shapes[i]
            near = {k: place.get(number[i] + k, -1) for k in (-2, -1, 1, 2)}
            at = {k: shapes[j] if j >= 0 else "" for k, j in near.items()}
            word = {k: words[j] if j >= 0 else "" for k, j in near.items()}
            d = digits(t)
            core = t.strip(".,;:!?")
            parts = core.split(".")
            octets = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
            rows[i] = (
                "", f"s {s}", f"c {_COUNTS.sub('0', s)}", f"n {min(len(d), 24)} {numeric[i]}", f"@ {t.count('@')} {t.rfind('.') > t.find('@')}", f"ip {octets} {len(parts) if len(parts) < 6 else 6}",
                f"+ {t[:1] == '+'} {'(' in t} {'-' in t}", f"luhn {13 <= len(d) <= 19 and luhn(d)} {min(len(d), 20)}", f"before {at[-1]}", f"after {at[1]}", f"{at[-1]} {s}", f"{s} {at[1]}", f"{at[-1]} {s} {at[1]}",
                f"{at[-2]} {at[-1]} {s}", f"{s} {at[1]} {at[2]}", f"w {words[i]}", f"w-1 {word[-1]}", f"w-2 {word[-2]}", f"w+1 {word[1]} {word[2]}", f"run {run}", f"run {run} {i - a}", f"run of {own_run}", f"run at {i - a} of {b - a}",
            )
    chain = [(i - 1, i) for i in range(1, len(number)) if number[i] == number[i - 1] + 1]
    skip, seen = set(), ({}, {})
    for k in marks:
        i = place[k]
        plain = _PLAIN.sub("", found[k][0]).lower()
        d = digits(plain)
        for key, last in zip((plain, d[-7:] if len(d) >= 7 else ""), seen, strict=True):
            if len(key) >= 4:
                if key in last and number[last[key]] != k - 1:
                    skip.add((last[key], i))
                last[key] = i
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    features = np.array([[_feature(f) for f in r] for r in rows], np.int64).reshape(-1, N_FEATURES)
    return Graph([(a, b) for _, a, b in tokens], np.isin(number, marks), features, pairs(chain), pairs(sorted(skip)))


def labels_of(g: Graph, spans: list[Span]) -> np.ndarray:
    """Label of each token: the kind of the first span that it touches; O for others."""
    out = np.zeros(len(g.spans), np.int64)
    if len(out):
        starts, stops = np.array(g.spans).T
        for kind, a, b in reversed(spans):
            out[np.searchsorted(stops, a, "right") : np.searchsorted(starts, b, "left")] = LABELS.index(kind)
    return out


@dataclass
class Field:
    unary: np.ndarray  # features x labels
    bigram: np.ndarray  # labels x labels, of a token and the next
    agree: np.ndarray  # for each label, of two tokens that have it and a skip link

    def marginals(self, g: Graph, known: np.ndarray | None = None, rounds: int = ROUNDS) -> np.ndarray:
        """Of each token's labels, by loopy sum-product messages. known: labels that are given (0: none)."""
        own = self.unary[g.features].sum(axis=1)
        if known is not None:
            given = np.flatnonzero(known)
            own[given] = -GIVEN
            own[given, known[given]] = 0
        n = len(LABELS)
        a = np.concatenate([g.chain, g.skip])
        if len(a):
            tables = np.concatenate([np.repeat(self.bigram[None], len(g.chain), 0), np.repeat(np.diag(self.agree)[None], len(g.skip), 0)])
            source, target = np.concatenate([a[:, 0], a[:, 1]]), np.concatenate([a[:, 1], a[:, 0]])
            tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(a), 2 * len(a)), np.arange(len(a))])
            sent = np.zeros((2 * len(a), n))
            for k in range(rounds):
                belief = own.copy()
                np.add.at(belief, target, sent)
                new = np.logaddexp.reduce((belief[source] - sent[back])[:, :, None] + tables, axis=1)
                new -= new.max(axis=1, keepdims=True)
                if np.abs(new - sent).max() < 1e-6:
                    break
                sent = new if k < UNDAMPED else 0.5 * sent + 0.5 * new
            own = own.copy()
            np.add.at(own, target, sent)
        own = own - own.max(axis=1, keepdims=True)
        p = np.exp(own)
        return p / p.sum(axis=1, keepdims=True)


def added(text: str, field: Field, found: list[Span]) -> list[Span]:
    """Spans that the field adds: tokens that are surely of a kind, joined with neighbours of that kind; base spans are given."""
    g = graph(text)
    if not g.spans or not field.unary.any():
        return []
    base = labels_of(g, found)
    p = field.marginals(g, base)
    best = np.where(p.max(axis=1) >= SURE, p.argmax(axis=1), 0)
    best[base > 0] = 0
    follows = {int(b) for _, b in g.chain}
    spans: list[Span] = []
    evidence, last = [], -2
    for i in np.flatnonzero(best).tolist():
        kind, (a, b) = LABELS[best[i]], g.spans[i]
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not text[b - 1].isalnum() and text[b - 1] != ")":
            b -= 1
        if a == b:  # a mark between numbers
            last = i if last == i - 1 and i in follows and spans[-1][0] == kind else last
            continue
        if last == i - 1 and i in follows and spans[-1][0] == kind and a - spans[-1][2] <= 3 and "\n" not in text[spans[-1][2] : a]:
            spans[-1] = (kind, spans[-1][1], b)
            evidence[-1] |= bool(g.marked[i])
        else:
            spans.append((kind, a, b))
            evidence.append(bool(g.marked[i]))
        last = i
    # what is added never overlaps a span of its own kind
    clear = lambda s: not any(k == s[0] and a < s[2] and s[1] < b for k, a, b in found)
    return [s for s, marked in zip(spans, evidence, strict=True) if marked and clear(s)]


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def variant(kind: str, value: str, rng: random.Random) -> str:
    """A way of writing a value of a base pattern that the pattern may miss."""
    d = digits(value)
    if kind == "email":
        name, _, host = value.partition("@")
        at = rng.choice([" at ", " (at) ", "[at]", "(at)", " [at] ", " @ ", "@ "])
        return name + at + (host.replace(".", rng.choice([" dot ", " (dot) ", "[dot]"])) if rng.random() < 0.6 else host)
    if kind == "ip":
        return value.replace(".", rng.choice(["-", "_", ",", " . ", "[.]", ":"]))
    if kind == "card":
        return rng.choice([".", "_", "/", "  ", ", "]).join(d[i : i + 4] for i in range(0, len(d), 4))
    d = d[-10:]
    area, mid, end = d[:-7], d[-7:-4], d[-4:]
    return rng.choice(["1 ({}) {}-{}", "({}) {}-{}", "({}) {} {}", "{}-{}-{}", "{}.{}.{}", "{}/{}/{}", "001 {} {} {}", "1-{}-{}-{}", "+{} / {} / {}"]).format(area, mid, end)


def partial(kind: str, value: str, rng: random.Random) -> str:
    """Another mention of a value, that only the mention itself tells."""
    d = digits(value)
    return {"phone": f"{d[-7:-4]}-{d[-4:]}", "card": d, "ip": value.replace(".", "-"), "email": value.replace("@", rng.choice(["_", "."]))}[kind]


def harmless(rng: random.Random) -> str:
    """Numbers that are no personal data: dates, times, amounts, versions, serial numbers, wrong check sums, and the shapes of partial mentions."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    wrong = n(rng.randrange(13, 20))
    wrong = wrong[:-1] + str((int(wrong[-1]) + luhn(wrong)) % 10)
    return rng.choice([
        f"{rng.randrange(1900, 2100)}", f"20{n(2)}-0{rng.randrange(1, 10)}-1{n(1)}", f"1{n(1)}:{rng.randrange(10, 60)}", f"{n(3)}-{n(4)}", f"{n(3)}-{n(4)}", f"{rng.randrange(1, 999)},{n(3)},{n(3)}", f"v{n(1)}.{n(2)}.{n(1)}", f"{n(1)}.{n(2)}",
        wrong, wrong, f"{rng.randrange(256, 999)}.{n(2)}.{n(3)}.{n(2)}", n(rng.randrange(3, 13)), f"{rng.choice('ABCDEFGH')}{n(rng.randrange(4, 9))}", f"{n(2)}-{n(2)}-{n(3)}-{n(3)}", f"{rng.randrange(1, 31)}.{rng.randrange(1, 13)}.{rng.randrange(1950, 2030)}", f"{n(2)}/{n(2)}", f"{n(3)} {n(3)}", f"item_{n(2)}.part{n(1)}.box",
    ])


def varied(text: str, base: list[Span], rng: random.Random) -> tuple[str, list[Span], list[tuple[int, int]]]:
    """text with values written in other ways, mentioned again and beside each other, and harmless numbers: (text, spans, what is harmless)."""
    own, stop = [], 0
    for s in sorted(base, key=lambda s: (s[1], -s[2])):
        if s[1] >= stop:
            own.append(s)
            stop = s[2]
    cuts = [m.start() for m in re.finditer(r" (?=[^\W\d_])", text) if not any(a <= m.start() < b for _, a, b in own)]
    changes: list[tuple[int, int, list[tuple[str, str]]]] = []
    for kind, a, b in own:
        value = text[a:b]
        one = value if rng.random() < 0.4 else variant(kind, value, rng)
        beside = rng.choice(own) if rng.random() < 0.15 else None
        changes.append((a, b, [(kind, one), *([(beside[0], text[beside[1] : beside[2]])] if beside else [])]))
        if cuts and rng.random() < 0.5:
            at = rng.choice(cuts)
            changes.append((at, at, [(kind, rng.choice([partial, variant])(kind, value, rng))]))
    for _ in range(4):
        if cuts:
            at = rng.choice(cuts)
            changes.append((at, at, [("O", harmless(rng))]))
    out, spans, plain, done, size = [], [], [], 0, 0

    def put(piece: str) -> None:
        nonlocal size
        out.append(piece)
        size += len(piece)

    for a, b, values in sorted(changes, key=lambda c: c[:2]):
        put(text[done:a])
        for k, (kind, value) in enumerate(values):
            if k or a == b:
                put(" ")
            if kind == "O":
                plain.append((size, size + len(value)))
            else:
                spans.append((kind, size, size + len(value)))
            put(value)
        done = b
    put(text[done:])
    return "".join(out), spans, plain


def lesson(text: str, spans: list[Span], plain: list[tuple[int, int]]) -> tuple[Graph, np.ndarray]:
    """Graph and labels of a text; -1 for what looks like personal data but is none of spans, nor surely harmless."""
    g = graph(text)
    y = labels_of(g, spans)
    sure = labels_of(g, [("email", a, b) for a, b in plain]) > 0
    unsure = [bool("@" in t or (_NUMERIC.fullmatch(t) and len(digits(t)) >= 7)) for t in (text[a:b] for a, b in g.spans)]
    return g, np.where((y == 0) & ~sure & np.array(unsure, bool), -1, y)


def train(x: np.ndarray, y: np.ndarray, chain: np.ndarray, skip: np.ndarray, seed: int = 3) -> Field:
    """All weights together, by the pseudo-likelihood of each token's label given its neighbours'; Adagrad.

    y: labels, -1 where unknown. Such tokens are not learnt from, and tell their neighbours nothing.
    """
    n = len(LABELS)
    field = Field(np.zeros((FEATURES, n)), np.zeros((n, n)), np.zeros(n))
    if not (y > 0).any():
        return field
    before, after, linked = np.full(len(y), -1, np.int8), np.full(len(y), -1, np.int8), np.zeros((len(y), n), np.float32)
    before[chain[:, 1]], after[chain[:, 0]] = y[chain[:, 0]], y[chain[:, 1]]
    for a, b in ((0, 1), (1, 0)):
        known = skip[y[skip[:, b]] >= 0]
        np.add.at(linked, (known[:, a], y[known[:, b]]), 1)
    rng, seen = np.random.default_rng(seed), [np.full_like(w, 1e-6) for w in (field.unary, field.bigram, field.agree)]
    own = np.flatnonzero(y >= 0).astype(np.int32)
    for _ in range(EPOCHS):
        mix = rng.permutation(own)
        for at in range(0, len(mix), 512):
            i = mix[at : at + 512]
            # now and then a feature is hidden, so that no one of them decides alone
            f = np.where(rng.random(x[i].shape) < 0.2, 0, x[i])
            has_before, has_after = before[i] >= 0, after[i] >= 0
            z = field.unary[f].sum(axis=1) + linked[i] * field.agree
            z[has_before] += field.bigram[before[i][has_before]]
            z[has_after] += field.bigram[:, after[i][has_after]].T
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(i)), y[i]] -= 1
            p /= len(i)
            steps = [np.zeros_like(field.unary), np.zeros_like(field.bigram), (p * linked[i]).sum(axis=0)]
            for k in range(n):
                steps[0][:, k] = np.bincount(f.ravel(), np.repeat(p[:, k], f.shape[1]), FEATURES)
            np.add.at(steps[1], before[i][has_before], p[has_before])
            np.add.at(steps[1].T, after[i][has_after], p[has_after])
            for w, g, s in zip((field.unary, field.bigram, field.agree), steps, seen, strict=True):
                g += 1e-5 * w
                s += g * g
                w -= 0.15 * g / np.sqrt(s)
    return field


def lessons(texts: Iterable[tuple[int, str]], copies: int = COPIES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(features, labels, chain, skip) of each text as it is and, where it has base spans, of copies in other ways."""
    for doc_id, text in texts:
        base = base_spans(text)
        for k in range(1 + copies * bool(base)):
            rng = random.Random(f"{doc_id} {k}")
            g, y = lesson(*(varied(text, base, rng) if k or not base else (text, base, [])))
            if len(y):
                yield g.features, y, g.chain, g.skip


def joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Lessons as one: links are moved to where their tokens are now."""
    first = np.cumsum([0, *(len(p[1]) for p in parts)])
    return [np.concatenate([p[k] + first[i] if k > 1 else p[k] for i, p in enumerate(parts)]).astype(kind, copy=False) for k, kind in enumerate(_KINDS)]


def taken(rows: list[tuple[bytes, bytes, bytes, bytes]]) -> list[np.ndarray]:
    """The same of rows of bytes, the last row first. What has been copied goes at once: rows is empty then."""
    every = [np.empty(sum(len(r[k]) for r in rows) // np.dtype(kind).itemsize, kind) for k, kind in enumerate(_KINDS)]
    at, first = [0] * len(_KINDS), 0
    while rows:
        row = rows.pop()
        for k, kind in enumerate(_KINDS):
            own = np.frombuffer(row[k], kind)
            every[k][at[k] : at[k] + len(own)] = own + first if k > 1 else own
            at[k] += len(own)
        first += len(row[1])  # a byte a label
        if len(rows) % 256 == 0:
            del row, own
            give_back()
    return [every[0].reshape(-1, N_FEATURES), every[1], every[2].reshape(-1, 2), every[3].reshape(-1, 2)]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    short_batches(docs.sparkSession)
    marked = docs.where(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull())
    chosen = marked.select(F.col("doc_id").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, x in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if parts := list(lessons([(doc_id, x)])):  # a row a document, as each has its price on the driver
                    yield pa.RecordBatch.from_pydict({"doc_id": [doc_id]} | {c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(("x", "y", "chain", "skip"), joined(parts), strict=True)})

    known = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left_semi")  # `sample` ids at most
    least = known.groupBy("doc_id").agg(F.min_by("text", F.md5("text")).alias("text"))  # of a repeated doc_id, whatever the order of rows
    rows = least.mapInArrow(run, "doc_id long, x binary, y binary, chain binary, skip binary").collect()
    rows.sort(key=lambda r: r.doc_id, reverse=True)
    rows = [tuple(r)[1:] for r in rows]
    every = taken(rows)
    field = train(*every)
    del every
    give_back()
    return field


def find(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, in order."""
    if not (_MARK.search(text) or _SPELLED_OUT.search(text)):
        return [], []
    base = base_spans(text)
    return base, ordered(base + added(text, field, base))


def query(docs: DataFrame) -> DataFrame:
    field = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, x in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                base, spans = find(x.as_py() or "", field)
                rows.append((doc_id, *(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans)))
            if rows:
                yield batch_of(_OUT, zip(*rows, strict=True))

    return docs.select("doc_id", "text").mapInArrow(run, _SQL)


def masked(text: str, spans: list[Span]) -> str:
    """text with each stretch of spans replaced by its (first) kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += (text[at:a], f"[{kind.upper()}]")
        at = max(at, b)
    return "".join((*out, text[at:]))


def redact(docs: DataFrame) -> DataFrame:
    """docs with masked texts; n_chars, where there is one, is counted anew. Null texts stay null."""
    field = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            new = [None if x is None else masked(x, find(x, field)[1]) for x in b.column("text").to_pylist()]
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
