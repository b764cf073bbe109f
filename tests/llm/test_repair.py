"""Conversation repair (12): search against all edits by dynamic programming, damage, awkward turns."""

import hashlib
import heapq
import random
import re
import time
import zlib

import pytest

from wartalens.llm import conversation_repair as repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, `Conv` string, audit string"
GRAMMAR = re.compile("(s?(ua)+)?")


def cheapest_by_queue(rows):
    """``(cost, audit)`` of ``(initial, fault)`` rows: a plain queue over whole paths, cheapest and ASCII-least first."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(rows) and GRAMMAR.fullmatch(roles):
            return cost, audit
        state = (i, roles[-1:] if roles != "" else "", audit if i == len(rows) and not GRAMMAR.fullmatch(roles) else None)
        if (i, roles[-1:], len(roles) > 0) in done:
            continue
        done.add((i, roles[-1:], len(roles) > 0))
        assert state is not None
        due = "a" if roles.endswith("u") else "u"
        moves = [("I", 5, i, due)]
        if i < len(rows):
            initial, fault = rows[i]
            moves.append(("D", 2, i + 1, ""))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if initial == due or (initial == "s" and roles == ""):
                    moves.append(("K", extra, i + 1, initial))
                moves.append(("R", 1 + extra, i + 1, due))
        for letter, more, j, said in moves:
            heapq.heappush(heap, (cost + more, audit + letter, j, roles + said))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """Every contract column for damaged conversations, from plain lists."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        kept = convs.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        said = [(role, text) for _, role, text in kept]
        fault = faults(said)
        turns = {t for t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        starts = [role[:1] for role, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:]))
        cost, audit = cheapest_by_queue(list(zip(starts, fault)))
        repaired, i, previous = [], 0, ""
        for letter in audit:
            due = "assistant" if previous == "u" else "user"
            role, text = said[i] if letter != "I" else (due, "")
            if letter in "IR":
                role = due
            if letter != "D":
                repaired.append(f"{role}:{text}")
                previous = role[:1]
            i += letter != "I"
        digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        out.append((conv, gaps, *[fault.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest))
    return sorted(map(repr, out))


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(spark, rows):
    frame = spark.createDataFrame([(*r, "c", "x") for r in rows], SCHEMA)
    found = repair.repair(repair.damaged(repair.turn_rows(frame)))
    return sorted(repr(tuple(row[c] for c in ["conv", *COLUMNS])) for row in found.collect())


def random_turns(seed, n_convs, longest):
    draw = random.Random(seed)
    texts = ["Yes.", "yes", "No!", "Why? ", " \n\t", "", "ok\n", "a b c.", None, "é…"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "u"]
    rows = []
    for conv in range(n_convs):
        for turn in range(draw.randrange(longest)):
            number = None if draw.random() < 0.05 else turn * draw.choice([1, 1, 1, 2])
            rows.append((conv, number, draw.choice(roles), draw.choice(texts)))
    return rows


@pytest.mark.parametrize("rows", [
    random_turns(1, 150, 9), random_turns(2, 8, 40), [], [(None, None, None, None)], [(1, 0, "user", "Hi.")] * 3,
    [(1, 0, "system", "S."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes."), (None, 5, "user", "x")],
])
def test_against_plain_lists(spark, rows):
    assert got(spark, rows) == brute(rows)


def test_search_is_cheapest_and_least():
    draw = random.Random(3)
    names = ["", "truncated", "blank", "duplicate"]
    for _ in range(1500):
        rows = [(draw.choice("uasx"), draw.choice(names)) for _ in range(draw.randrange(12))]
        codes = "".join(repair.code(role, names.index(fault)) for role, fault in rows)
        assert repair.cheapest_edits(codes) == cheapest_by_queue(rows)
        assert repair.needs(codes)[0][0] <= repair.cheapest_edits(codes)[0]


def test_long_conversation_in_proportion():
    draw = random.Random(4)
    codes = "".join(repair.code(draw.choice("uasx"), draw.choice([0, 0, 0, 1, 2, 3])) for _ in range(20_000))
    start = time.time()
    cost, audit = repair.cheapest_edits(codes)
    assert time.time() - start < 60 and cost >= repair.needs(codes)[0][0] and len(audit) >= len(codes)


def test_one_conversation_holds_most_rows(spark):
    draw = random.Random(6)
    rows = [(7, t, draw.choice(["user", "assistant"]), f"turn {t}{draw.choice(['.', '', '?'])}") for t in range(3000)] + random_turns(8, 20, 6)
    frame = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    turns = repair.damaged(repair.turn_rows(frame))
    found = repair.audits(turns)
    repaired = {}
    for row in sorted(repair.repaired_turns(turns, found).collect(), key=lambda r: (r.conv, r.position)):
        repaired.setdefault(row.conv, []).append((row.role, row.text))
    digests = {r.conv: r.repaired_sha256 for r in repair.repaired_digests(turns, found).collect()}
    assert set(digests) == {r[0] for r in rows}
    for conv, digest in digests.items():
        said = repaired.get(conv, [])
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest() == digest
        assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in said))
