"""Conversation repair against an exhaustive search, over every way of cutting the rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from gyrespark.llm import turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def cheapest(rows):
    """All edit strings in order of cost, then text, until one gives a legal conversation."""
    kinds, seen = [], set()
    for _, _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        if body:
            seen.add((role, text))
        kinds.append(kind)
    best = {("", 0): (0, "", ())}
    whole = re.compile("(s?(ua)+)?")
    # shortest paths over (role initials so far up to their last pair, row): initials reduce to four states
    def state(initials):
        return "" if not initials else initials if initials == "s" else initials[-1]
    table = {(0, ""): (0, "", ())}
    for row in range(len(rows) + 1):
        changed = True
        while changed:
            changed = False
            for (r, s), (c, a, lines) in list(table.items()):
                if r == row:
                    give = "assistant" if s == "u" else "user"
                    new = (c + 3, a + "I", (*lines, give + ":"))
                    key = (r, give[0])
                    if key not in table or new[:2] < table[key][:2]:
                        table[key], changed = new, True
        if row == len(rows):
            break
        _, _, role, text = rows[row]
        extra = 3 if kinds[row] == "truncated" else 0
        for (r, s), (c, a, lines) in list(table.items()):
            if r != row:
                continue
            moves = [(s, 4, "D", ())]
            if kinds[row] not in ("blank", "duplicate"):
                give = "assistant" if s == "u" else "user"
                moves.append((give[0], 3 + extra, "R", (f"{give}:{text}",)))
                if role[:1] == give[0] or (s == "" and role[:1] == "s"):
                    moves.append((role[0], extra, "K", (f"{role}:{text}",)))
            for to, cost, edit, line in moves:
                new = (c + cost, a + edit, (*lines, *line))
                if (row + 1, to) not in table or new[:2] < table[row + 1, to][:2]:
                    table[row + 1, to] = new
    del best, whole, state
    return min(table[len(rows), s] for s in ("", "a") if (len(rows), s) in table), kinds


def expected(rows):
    out = {}
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        (cost, audit, lines), kinds = cheapest(own)
        known = [r[1] for r in own if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


def made(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "And then", "", " \t", None, "Fine. \n", "é?", "x"]
    return [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(30)]), rng.choices(roles, [9, 9, 2, 1, 1, 1])[0],
             rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}.") for _ in range(n)]


@pytest.mark.parametrize("seed,block", [(1, 16_384), (2, 3), (3, 1), (4, 7)])
def test_against_search(spark, seed, block):
    rows = made(seed, 120)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(turns.repair(turns.damaged(frame), block)) == expected(rows)


def test_matrices_and_walks_agree():
    rng = random.Random(5)
    for _ in range(200):
        codes = bytes(rng.randrange(12) for _ in range(rng.randrange(40)))
        cut = rng.randrange(len(codes) + 1)
        end = turns.through(turns.matrix_of(codes[cut:]), turns.END)
        assert end == turns.backward(codes[cut:], turns.END)
        first, state = turns.walk(codes[:cut], end, 0)
        second, last = turns.walk(codes[cut:], turns.END, state)
        assert (first + second, last) == turns.walk(codes, turns.END, 0)


def test_least_audit_of_short_conversations():
    """Every edit string of bounded length, by brute force."""
    for codes in itertools.product([0, 1, 2, 6, 9], repeat=3):
        options = []
        for edits in itertools.product(["D", "K", "R", "I"], repeat=5):
            for length in range(3, 6):
                options.append(edits[:length])
        best = None
        for edits in set(options):
            if sum(e != "I" for e in edits) != 3:
                continue
            state, cost, row, fits = 0, 0, 0, True
            for e in edits:
                if e == "I":
                    state, cost = turns.NEXT[state], cost + 3
                    continue
                code, row = codes[row], row + 1
                extra, after, must_go = turns.STEPS[code]
                if e == "D":
                    cost += 4
                elif must_go or (e == "K" and after[state] is None):
                    fits = False
                    break
                else:
                    cost += extra + (3 if e == "R" else 0)
                    state = after[state] if e == "K" else turns.NEXT[state]
            if fits and state in (0, 3):
                best = min(best, (cost, "".join(edits))) if best else (cost, "".join(edits))
        edits, state = turns.walk(bytes(codes), turns.END, 0)
        assert (turns.backward(bytes(codes), turns.END)[0], edits + turns.ending(state)) == best


def test_hot_conversation_nulls_and_clashing_columns(spark):
    rows = [(7, i, ["user", "assistant"][i % 2], f"turn {i % 90}" + "." * (i % 5 > 0)) for i in range(900)] + [(None, None, None, None), (8, 1, "user", "é" * 200_000)]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", part int, number int, gone int").repartition(9)
    assert got(turns.repair(turns.damaged(frame), 50)) == expected(rows)


def test_empty_table(spark):
    assert got(turns.op13(spark.createDataFrame([], SCHEMA))) == {}
