"""Operator 12 against both libraries and plain counting."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kbspark.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, run string, counts long"


def prose(rng, n):
    return " ".join("".join(rng.choice(["ta", "re", "mi", "ö", "the", "an", "ß", "."]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def rows():
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(1, 80)) for _ in range(60)]
    texts += [None, "", " ", "   ", "\n", "a", "a  b   c ", " lead", "tab\t\ttab", "line\nline\n\n  in", "<|endoftext|> and <s>", "▁ seen", "x▁y", "😀 é \x00 \x85", "ﬁ Å　½", "w" * 5_000, prose(rng, 8_000), "the the the " * 300]
    texts += texts[:3]
    return [(i if i % 17 else None, t, "r", 1) for i, t in enumerate(texts)]


def wanted(rows):
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    found, held_by = [], Counter()
    for _, text, *_ in rows:
        a = b = []
        if text:
            ids = tok.encode(" " + text, add_special_tokens=False).ids
            a = [(i, bytes(byte_of[c] for c in tok.id_to_token(i))) for i in ids]
            b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
            if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
                a = b = []
        spans = []
        for side in (a, b):
            ends = np.cumsum([0] + [len(x) for _, x in side]).tolist()
            spans.append([(i, lo, hi) for (i, _), lo, hi in zip(side, ends, ends[1:])])
        cuts = sorted({hi for *_, hi in spans[0]} & {hi for *_, hi in spans[1]})
        links, j = [], 0
        for i, lo, hi in spans[0]:
            while j and spans[1][j][1] > lo:
                j -= 1
            for k in range(j, len(spans[1])):
                j = k
                if spans[1][k][1] >= hi:
                    break
                if spans[1][k][2] > lo:
                    links.append((i, spans[1][k][0]))
        which = [defaultdict(list) for _ in range(2)]
        for side in (0, 1):
            for i, _, hi in spans[side]:
                which[side][next_cut(cuts, hi)].append(str(i))
        groups = ";".join(",".join(which[0][c]) + "|" + ",".join(which[1][c]) for c in cuts)
        held_by.update(set(links))
        found.append((len(a), len(b), len(cuts), links, hashlib.sha256(groups.encode()).hexdigest() if a else ""))
    top = defaultdict(int)
    for (i, _), n in held_by.items():
        top[i] = max(top[i], n)
    out = []
    for (doc, *_), (n_a, n_b, n_groups, links, digest) in zip(rows, found):
        out.append((doc, n_a, n_b, n_groups, len(links), sum(held_by[x] == top[x[0]] for x in links), sum(held_by[x] for x in links), digest))
    return out, held_by, top


def next_cut(cuts, end):
    return cuts[int(np.searchsorted(cuts, end))]


key = lambda r: tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("fan,frame,batch,share", [(32, 1 << 15, 4 << 20, 512), (2, 7, 3_000, 2)])
def test_op12_equals_brute_force(spark, monkeypatch, fan, frame, batch, share):
    for name, value in (("FAN", fan), ("SHARE", share)):
        monkeypatch.setattr(alignment, name, value)
    runs, spilled = alignment.runs, alignment._spill
    if frame == 7:  # small frames and batches, also in the workers
        def small(*paths):
            inner = spilled(*paths)

            def run(batches):
                alignment.FRAME, alignment.BATCH = frame, batch
                return inner(batches)
            return run
        monkeypatch.setattr(alignment, "_spill", small)
    out, held_by, top = wanted(rows())
    got, counts = alignment.align(spark.createDataFrame(rows(), SCHEMA).repartition(5), A, B)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(out, key=key)
    pairs = {(r.a_id, r.b_id): (r.n_docs, r.best) for r in alignment.links(counts, 32_000).collect()}
    assert pairs == {p: (n, n == top[p[0]]) for p, n in held_by.items()}
    assert runs is alignment.runs


def test_op12_empty_table(spark):
    assert alignment.query(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    blank = alignment.query(spark.createDataFrame([(1, None, "", 0), (2, "▁", "", 0)], SCHEMA), A, B).collect()
    assert sorted(map(tuple, blank)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_op12_merge_and_best(monkeypatch):
    monkeypatch.setattr(alignment, "FRAME", 5)
    rng = np.random.default_rng(4)
    total, runs = Counter(), []
    for _ in range(9):
        pairs = np.unique(rng.integers(0, 300, 80))
        counts = rng.integers(1, 70_000, len(pairs))
        total.update(dict(zip(pairs.tolist(), counts.tolist())))
        runs.append(alignment.write_run(pairs, counts))
    blocks = list(alignment.merge([*runs, b""]))
    got = [x for p, c in blocks for x in zip(p.tolist(), c.tolist())]
    assert got == sorted(total.items())
    top = defaultdict(int)
    for p, n in got:
        top[p // 20] = max(top[p // 20], n)
    best = [x for b in alignment.with_best(iter(blocks), 20) for x in zip(*(c.tolist() for c in b))]
    assert best == [(p, n, int(n == top[p // 20])) for p, n in got]
