"""Operator 13 against a plain dynamic programme over strings."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import pytest

from kbspark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, place string, fault int"


def cheapest(rows):
    """(cost, ASCII-least letters) of rows (initial, has to go, truncated), from the last row to the first."""
    best = {(len(rows), q): (0, "") if q in (0, 3) else (10**9, "") for q in range(4)}
    to = {0: 2, 1: 2, 2: 3, 3: 2}
    for i in range(len(rows), -1, -1):
        for q in range(4) if i < len(rows) else ():
            initial, bad, cut = rows[i]
            add = lambda c, letter, n: (best[i + 1, n][0] + c, letter + best[i + 1, n][1])  # noqa: B023, E731
            ways = [add(3, "D", q)]
            if not bad:
                ways.append(add(2 + cut, "R", to[q]))
                if initial == "s" and q == 0:
                    ways.append(add(cut, "K", 1))
                if initial == "ua"[to[q] - 2]:
                    ways.append(add(cut, "K", to[q]))
            best[i, q] = min(ways)
        for _ in range(6):
            for q in range(4):
                c, s = best[i, to[q]]
                best[i, q] = min(best[i, q], (c + 2, "I" + s))
    return best[0, 0]


def wanted(rows):
    """The whole contract for rows (conv_id, turn, role, text)."""
    out, conversations = {}, defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        kept = conversations[conv]
        sp = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20, sp(role), sp(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, kept in conversations.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, light, n = set(), [], defaultdict(int)
        for _, role, text in kept:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            n[fault] += 1
            light.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, letters = cheapest(light)
        lines, at, state = [], 0, 0
        for x in letters:
            if x == "I":
                state = 3 if state == 2 else 2
                lines.append(("user:", "assistant:")[state - 2])
                continue
            _, role, text = kept[at]
            at += 1
            if x in "KR":
                state = 1 if x == "K" and role[0] == "s" else 3 if state == 2 else 2
                lines.append(f"{role if x == 'K' else ('user', 'assistant')[state - 2]}:{text}")
        turns = [t for t, *_ in kept if t is not None]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(light, light[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(rng, n):
    for conv in range(n):
        turn = rng.randrange(-2, 3)
        for _ in range(rng.choice([1, 2, 3, 5, 8, 60])):
            turn += rng.choice([1, 1, 1, 1, 0, 3])
            text = rng.choice(["Yes.", "No!", "é 😀?", "cut", "end. \n", "\x85", "", " \t", None, "a.b", "system."])
            yield conv, rng.choice([turn, turn, turn, turn, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sage"]), text, "x", 1


def test_op13_equals_brute_force(spark):
    rows = [*made(random.Random(3), 150), (None, None, None, None, None, None), (None, 1, "user", "Hi.", "p", 2), (None, 2, "assistant", "w" * 100_000 + ".", None, None)]
    got = {r.conv_id: tuple(r)[1:] for r in repair.query(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == wanted(rows)
    assert repair.query(spark.createDataFrame([], SCHEMA)).count() == 0


def test_op13_all_rows_dropped(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    r = repair.query(spark.createDataFrame([(conv, 0, "user", "Hi.", "", 0)], SCHEMA)).collect()
    assert [tuple(x) for x in r] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("part", [2, 3, 24])
def test_op13_parts_equal_brute_force(part, monkeypatch):
    monkeypatch.setattr(repair, "PART", part)
    repair._distances.cache_clear()
    rng = random.Random(part)
    for n in [*range(40)] * 8 + [700]:
        rows = tuple((rng.choice("suauaaux "), rng.random() < 0.15, rng.random() < 0.25) for _ in range(n))
        letters, _, cost = repair.audit(rows)
        assert (cost, letters) == cheapest(rows)
    repair._distances.cache_clear()


def test_op13_is_linear():
    rng, took = random.Random(1), []
    for n in (2_000, 16_000):
        rows = tuple((rng.choice("suauaaux"), rng.random() < 0.15, rng.random() < 0.25) for _ in range(n))
        repair._distances.cache_clear()
        start = time.process_time()
        repair.audit(rows)
        took.append(time.process_time() - start)
    assert took[1] < 24 * took[0]


def test_op13_repair_returns_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", "Why?"), (2, 0, "user", "Hi."), (2, 1, "assistant", "Hi.")]
    out = sorted(map(tuple, repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    for conv in (1, 2):
        roles = [r for c, _, r, _ in out if c == conv]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in roles)) and [p for c, p, *_ in out if c == conv] == list(range(1, len(roles) + 1))
    assert [r for r in out if r[0] == 2] == [(2, 1, "user", "Hi."), (2, 2, "assistant", "Hi.")]
