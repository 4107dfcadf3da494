"""Repair of conversations against plain loops and against all edit strings."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tracemill.llm import conversations
from tracemill.llm.common import Run
from tracemill.llm.conversations import Path, damage_and_repair

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, audit) of rows (initial, fault), by whole strings from the end."""

    def options(state, i, rest, here):
        for role in "ua":
            if (state, role) in STEP and STEP[state, role] in here:
                cost, audit = here[STEP[state, role]]
                yield cost + 3, "I" + audit
        if i == len(rows):
            if state in ("", "a"):
                yield 0, ""
            return
        initial, fault = rows[i]
        yield rest[state][0] + 4, "D" + rest[state][1]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault else 0
            if (state, initial) in STEP:
                cost, audit = rest[STEP[state, initial]]
                yield cost + more, "K" + audit
            for role in "ua":
                if (state, role) in STEP:
                    cost, audit = rest[STEP[state, role]]
                    yield cost + more + 3, "R" + audit

    rest = None
    for i in range(len(rows), -1, -1):
        here = {}
        for _ in range(5):
            here = {s: min(found) for s in ("", "s", "u", "a") if (found := list(options(s, i, rest, here)))}
        rest = here
    return rest[""]


def by_all_strings(rows, limit):
    """(cost, audit) among all edit strings of at most ``limit`` letters."""
    best = None
    for length in range(len(rows), limit + 1):
        for letters in itertools.product("DIKR", repeat=length):
            if sum(x != "I" for x in letters) != len(rows):
                continue
            ends, i = {("", 0)}, 0
            for x in letters:
                new = set()
                for state, cost in ends:
                    if x == "I":
                        new |= {(STEP[state, r], cost + 3) for r in "ua" if (state, r) in STEP}
                        continue
                    initial, fault = rows[i]
                    if x == "D":
                        new.add((state, cost + 4))
                    elif fault not in ("blank", "duplicate"):
                        roles = [(initial, 0)] if x == "K" else [("u", 3), ("a", 3)]
                        new |= {(STEP[state, r], cost + c + (3 if fault else 0)) for r, c in roles if (state, r) in STEP}
                ends, i = new, i + (x != "I")
            for state, cost in ends:
                if state in ("", "a"):
                    best = min(best or (cost, "".join(letters)), (cost, "".join(letters)))
    return best


def repaired(rows, audit):
    out, state, rows = [], "", iter(rows)
    for edit in audit:
        if edit == "I":
            role, text = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state], ""
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            if edit == "R":
                role = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        out.append(f"{role}:{text}")
        state = STEP[state, role[0]]
    assert state in ("", "a")
    return "\n".join(out)


def brute(table, damage=True):
    held = {}
    for conv, turn, role, text in table:
        mine = held.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(fate, text)
        mine += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    out = []
    for conv, rows in held.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in rows:
            bare = text.rstrip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit = cheapest(list(zip(initials, faults, strict=True)))
        text = repaired([r[1:] for r in rows], audit)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, table):
    rows = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumns({n: F.lit("clash") for n in ("fault", "audit", "row", "digest")})
    return sorted((tuple(r) for r in damage_and_repair(rows.repartition(3)).collect()), key=str)


def talk(seed, conversations_held=250):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "", " \t\n", "cut off", "Done. ", "é?", "…", "a.b", "x" * 50 + ".", None]
    rows = []
    for conv in range(conversations_held):
        turn = 0
        for _ in range(rng.choice([1, 2, 3, 5, 8, 13])):
            turn += rng.choice([1, 1, 1, 2, 0])
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "", None, "ursula"])
            rows.append((rng.choice([conv, conv, conv, None]) if conv % 50 == 7 else conv, turn if rng.random() < 0.95 else None, role, rng.choice(texts)))
    return rows + rows[:30]


def test_damaged_conversations(spark):
    rows = talk(1)
    got = found(spark, rows)
    assert got == brute(rows)
    assert len({g[7] for g in got}) > 60 and all(sum(g[i] for g in got) for i in range(1, 7))


def test_long_conversation_empty_table_and_extremes(spark):
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["Good.", "bad", "Fine!"]) + str(i % 700) + rng.choice([".", ""])) for i in range(4000)]
    rows += [(8, 0, "user", "long " * 300_000 + "."), (8, 1, "assistant", "long " * 300_000), (9, None, None, None), (-3, -5, "a", "."), (10, 2**62, "user", "Hi."), (10, 0, "user", "Hi.")]
    dropped = next(i for i in range(10**6) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = found(spark, rows + [(dropped, 0, "user", "Hello.")])
    assert got == brute(rows + [(dropped, 0, "user", "Hello.")])
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in got
    assert found(spark, []) == []


def test_without_damage(spark):
    rows = talk(2, 60)
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    table = spark.createDataFrame(clean, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in conversations.repair(table, Run(spark, "t")).collect()), key=str) == brute(clean, damage=False)


SYMBOLS = {"x": ("u", "blank"), "s": ("s", None), "u": ("u", None), "a": ("a", None), "o": ("t", None), "U": ("u", "truncated"), "A": ("a", "truncated"), "S": ("s", "truncated")}


@pytest.mark.parametrize("length", [0, 1, 2, 3])
def test_audits_of_all_short_signatures(length):
    texts = ["".join(t) for t in itertools.product(SYMBOLS, repeat=length)]
    path = Path()
    for text in sorted(texts, key=lambda t: t[::-1]):
        got = path.audit(text[::-1].encode())
        assert got == cheapest([SYMBOLS[c] for c in text]), text
        if length < 3 or text in ("sua", "aau", "uxa", "ssu", "UUa", "oAo", "auS"):
            assert got == by_all_strings([SYMBOLS[c] for c in text], length + 3 + (length < 2)), text


def test_audits_of_long_signatures_share_their_suffixes():
    rng = random.Random(3)
    texts = sorted({"".join(rng.choice("xsuaoSUAOuauaua") for _ in range(rng.randrange(40))) for _ in range(400)}, key=lambda t: t[::-1])
    path = Path()
    for text in texts:
        symbols = dict(SYMBOLS, O=("t", "truncated"))
        assert path.audit(text[::-1].encode()) == cheapest([symbols[c] for c in text])
    assert conversations.before.cache_info().currsize < 2000
