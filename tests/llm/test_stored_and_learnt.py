"""What operator 2 stores and operator 5 learns, against plain loops."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np

from kbspark.llm import classifier, media, pii
from kbspark.llm.words import Words


def unpacked(png):
    """(width, height, samples) of an 8-bit grey PNG without line filters."""
    assert png[:8] == b"\x89PNG\r\n\x1a\n"
    at, data, head = 8, b"", None
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        assert struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        head, data = (struct.unpack(">IIBBBBB", body), data) if kind == b"IHDR" else (head, data + body if kind == b"IDAT" else data)
        at += 12 + n
    lines = zlib.decompress(data)
    width, height, depth, colour, *_ = head
    assert (depth, colour) == (8, 0) and len(lines) == height * (width + 1) and not any(lines[:: width + 1])
    return width, height, b"".join(lines[k * (width + 1) + 1 : (k + 1) * (width + 1)] for k in range(height))


def described(payload):
    n, counts = len(payload), Counter(payload)
    mean = sum(payload) / n
    deviation = math.sqrt(sum(c * (b - mean) ** 2 for b, c in counts.items()) / n)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    return [mean, deviation, entropy, *(sum(c for b, c in counts.items() if b // 64 == q) / n for q in range(4))]


def test_op2_stored_form_and_feature(spark, tmp_path):
    rng = random.Random(1)
    texts = {0: None, 1: "", 2: "a", 3: "é😀 " * 300, 4: "x" * 576, 5: "x" * 577, 6: "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(5_000)), 7: "a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    folder = f"file://{tmp_path}/a"
    media.archive(media.encoded(docs), folder)
    members = media.read_archive(spark, folder)
    held = {int(r.member.partition("/")[0]): r.media for r in members.collect()}
    got = {r.doc_id: r for r in media.query(docs).collect()}
    assert set(held) == set(got) == set(texts)
    for i, text in texts.items():
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        width, height, back = unpacked(bytes(held[i]))
        assert (width, width * height, back) == (576, len(payload), payload)
        assert (got[i].media_bytes, got[i].media_sha256) == (len(held[i]), hashlib.sha256(held[i]).hexdigest())
        assert np.allclose([float(x) for x in got[i].feature.split(":")], described(payload), atol=2e-4)
    assert got[2].media_sha256 == got[7].media_sha256 and got[2].feature == got[7].feature


def plain_vectors(texts):
    """Mean of the index vectors of each row's neighbours, word by word."""
    sums, seen = np.zeros((classifier.VOCABULARY, classifier.WIDTH)), np.zeros(classifier.VOCABULARY)
    for text in texts:
        w = Words([text.encode()])
        kinds = (w.hashes, classifier.form_hashes(w)) if len(w.hashes) else ()
        for kind, hashes in enumerate(kinds):
            rows = classifier.rows_of(*kinds)[kind].tolist()
            cells = classifier.index_vectors(hashes)
            for i in range(len(rows)):
                for j in (i - 1, i + 1):
                    if 0 <= j < len(rows):
                        seen[rows[i]] += 1
                        for c in cells[:, j].tolist():
                            sums[rows[i], c % classifier.WIDTH] += 1 if c < classifier.WIDTH else -1
    return np.divide(sums, seen[:, None], out=np.zeros_like(sums), where=seen[:, None] > 0)


def plain_pool(text, vectors):
    w = Words([text.encode()])
    n = len(w.hashes)
    out = np.zeros(classifier.INPUTS)
    if not n:
        return out
    width, hashes = classifier.WIDTH, w.hashes.tolist()
    for row, form in zip(*classifier.rows_of(w.hashes, classifier.form_hashes(w))):
        out[:width] += vectors[row]
        out[width : 2 * width] += vectors[form]
    for k in (1, 2):
        out[2 * width + k - 1] = sum(hashes[i] == hashes[i - k] for i in range(k, n))
    cells, signs = classifier.direct_cells(w.hashes)
    for c, s in zip(cells.T.tolist(), signs.T.tolist()):
        for at, sign in zip(c, s):
            out[2 * width + 2 + at] += sign
    return out / n


def test_op5_vectors_and_pooling_equal_plain_loops(spark):
    rng = random.Random(2)
    some = ["ta", "Re", "mi3", "ö", "lo-lo", "an", "x" * 300, "😀"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(50)] + ["", "one", "a a a a", "a b a b", " \n\t"]
    docs = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3)
    vectors, want = classifier.word_vectors(docs), plain_vectors(texts)
    assert np.allclose(vectors, want, atol=1e-6) and np.abs(want).sum() > 0
    got = classifier.pooled([t.encode() for t in texts], vectors)
    assert np.allclose(got, [plain_pool(t, vectors) for t in texts], atol=1e-6)


def test_lessons_travel_as_one_row_a_document():
    """Operator 10: what the driver gets of each document, added up, is the lessons of all one after the other; rows go as they are copied."""
    value = "write to ann.lee@example.org or call +1 555 010 0123 from 10.0.0.1, card 4111 1111 1111 1111 today"
    texts = [(i, f"{value} number {i}") for i in range(5)] + [(5, "room 12 at 10:30"), (6, "nothing")]
    own = [parts for t in texts if (parts := list(pii.lessons([t])))]
    every = [p for parts in own for p in parts]
    first = np.cumsum([0, *(len(p[1]) for p in every)])
    rows = [tuple(v.tobytes() for v in pii.joined(parts)) for parts in own][::-1]
    assert len(rows) < len(every)
    for k, got in enumerate(pii.taken(rows)):
        assert np.array_equal(got, np.concatenate([p[k] + first[i] if k > 1 else p[k] for i, p in enumerate(every)])) and len(got)
    assert not rows and [len(x) for x in pii.taken([])] == [0] * 4
