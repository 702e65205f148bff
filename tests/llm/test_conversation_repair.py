"""Operator 13 against a search over all edits, and against damage done in plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from stratalith.llm import conversation_repair as repair

KINDS = "conv_id long, turn long, role string, text string, key string, n int"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [] if kind == 0 else [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))


def cheapest(rows):
    """The least (cost, audit, repaired lines) by Dijkstra's search over (row, state)."""
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}
    names, seen, known = {"u": "user", "a": "assistant"}, set(), []
    for _, _, role, text in rows:
        words = WORD.findall(text)
        known.append((role, text, not words or (role, text) in seen, bool(words) and words[-1] not in ".!?"))
        seen.add((role, text))
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, i, state, lines = heapq.heappop(todo)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, lines
        if (i, state) in done:
            continue
        done.add((i, state))
        due = follows[state]
        heapq.heappush(todo, (cost + 3, audit + "I", i, due, (*lines, names[due] + ":")))
        if i < len(rows):
            role, text, gone, cut = known[i]
            heapq.heappush(todo, (cost + 4, audit + "D", i + 1, state, lines))
            if not gone:
                heapq.heappush(todo, (cost + 3 + 3 * cut, audit + "R", i + 1, due, (*lines, f"{names[due]}:{text}")))
                if role[:1] == due or (state == "" and role[:1] == "s"):
                    heapq.heappush(todo, (cost + 3 * cut, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
    raise AssertionError


def expected(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        own = in_order(r for r in damage(rows) if r[0] == conv)
        turns = {r[1] for r in own if r[1] is not None}
        words = [WORD.findall(r[3]) for r in own]
        again = [r[2:] in [o[2:] for o in own[:i]] for i, r in enumerate(own)]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:], strict=False)]
        cost, audit, lines = cheapest(own)
        found[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            sum(not w for w in words),
            sum(bool(w) and a for w, a in zip(words, again, strict=True)),
            sum(bool(w) and not a and w[-1] not in ".!?" for w, a in zip(words, again, strict=True)),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return found


def asked(spark, rows):
    df = repair.filled(spark.createDataFrame([(*r, "clash", 1) for r in rows], KINDS))
    return {r[0]: tuple(r)[1:] for r in repair.reports(repair.damaged(df), df).collect()}


TEXTS = ["Yes.", "No!", "cut off", "", " \n\t", "a. b", "Ünï.\n", "x" * 5000 + ".", None, "..", "\x1c", "end. "]
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", None, "s", " "]


def conversations(seed, number, turns, odd):
    rng = random.Random(seed)
    rows = []
    for conv in range(number):
        for turn in range(rng.randint(1, turns)):
            if rng.random() < odd:
                rows.append((conv if rng.random() < 0.95 else None, rng.choice([turn, None, 3, -5, 10**12]), rng.choice(ROLES), rng.choice(TEXTS)))
            else:
                rows.append((conv, turn, ("user", "assistant")[turn % 2], rng.choice(["Fine.", "Why?", f"Number {rng.randint(0, 99)}.", "open"])))
    return rows


@pytest.mark.parametrize("chunk", [4096, 3])
def test_reports_equal_a_search(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = conversations(1, 60, 12, 0.3) + [(1000, i, r, t) for i, (r, t) in enumerate([("assistant", "A."), ("assistant", "B."), ("user", "C."), ("tool", "D."), ("tool", "D.")] * 8)]
    rows += [r for r in rows if r[0] == 5]  # a conversation with all rows twice
    assert asked(spark, rows) == expected(rows)


def test_rules_change_nothing(spark, monkeypatch):
    rows = conversations(2, 40, 9, 0.2)
    wanted = expected(rows)
    assert asked(spark, rows) == wanted
    monkeypatch.setattr(repair, "ROUNDS", 0)
    assert asked(spark, rows) == wanted


def test_long_conversation_is_compressed(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(12_000)]
    df = repair.filled(spark.createDataFrame([(*r, "", 1) for r in rows], KINDS))
    *_, grammar, _ = repair.prepared(df)
    symbols = bytes([2, 4]) * 2000
    assert len(grammar.compressed(repair.np.frombuffer(symbols, repair.np.uint8).astype(repair.np.int64))) < 40
    got = repair.reports(df, df).collect()
    assert len(got) == 1 and got[0]["cost"] == 0 and got[0]["audit"] == "K" * 12_000
    turns = repair.repaired(df).orderBy("place").collect()
    assert [(t["place"], t["role"], t["text"]) for t in turns] == [(i, r, t) for i, (_, _, r, t) in enumerate(rows)]


def test_many_equal_rows(spark):
    rows = [(1, 0, "user", "Same.")] * 300 + [(1, 1, "assistant", "")] * 200 + [(2, 0, "user", "Hi.")]
    df = repair.filled(spark.createDataFrame([(*r, "", 1) for r in rows], KINDS))
    got = {r["conv_id"]: r for r in repair.reports(df, df).collect()}
    assert (got[1]["blank"], got[1]["duplicate"], got[1]["illegal"], got[1]["cost"]) == (200, 299, 299 + 199, 4 * 499 + 3)
    assert got[1]["audit"] == "K" + "D" * 499 + "I" and got[2]["audit"] == "KI"


def test_empty_table_and_lost_conversations(spark):
    assert asked(spark, []) == {}
    lost = next((1, t) for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert asked(spark, [(*lost, "user", "Gone.")]) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_ropes_keep_the_least_text():
    for a in range(9):
        for b in range(9):
            for (start, end), (cost, rope) in repair.product(repair.terminal(a), repair.terminal(b)).items():
                ways = [(x[0] + y[0], x[1] + y[1]) for (s, m), x in repair.terminal(a).items() for (m2, e), y in repair.terminal(b).items() if s == start and m == m2 and e == end]
                assert (cost, repair.spelled(rope)) == min(ways)
