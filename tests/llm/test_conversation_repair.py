"""Conversation repair against plain searches."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from parcelframe.llm import conversation_repair as C

from .conftest import clash

TURNS = "conv_id long, turn long, role string, text string"
ROLE = {"u": "user", "a": "assistant"}
GOOD = re.compile(r"(s?(ua)+)?")


def plain_search(rows):
    """(cost, ASCII-least audit) by all edits; rows: (initial, must go, truncated)."""

    @lru_cache(None)
    def go(i, made, left):
        """Least (cost, letters) from row i after role initials that are a prefix in state ``made``; ``left`` insertions."""
        best = []
        if i == len(rows) and made in ("", "a"):
            best.append((0, ""))
        after = "a" if made == "u" else "u"
        if left:
            cost, letters = go(i, after, left - 1)
            best.append((cost + 2, "I" + letters))
        if i < len(rows):
            initial, must, cut = rows[i]
            cost, letters = go(i + 1, made, 3)
            best.append((cost + 3, "D" + letters))
            if not must:
                cost, letters = go(i + 1, after, 3)
                best.append((cost + 2 + cut, "R" + letters))
                if initial == after or (initial == "s" and made == ""):
                    cost, letters = go(i + 1, initial, 3)
                    best.append((cost + cut, "K" + letters))
        return min(best, default=(10 ** 9, ""))

    return go(0, "", 3)


def symbol(initial, must, cut):
    return C.MUST if must else ("sua".find(initial) if initial in ("s", "u", "a") else 3) + 4 * cut


KINDS = [(i, False, cut) for i in "suax" for cut in (False, True)] + [("u", True, False)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_every_short_conversation(n):
    for rows in itertools.product(KINDS, repeat=n):
        assert C.cheapest(bytes(symbol(*r) for r in rows)) == plain_search(tuple(rows))


@pytest.mark.parametrize("seed", range(60))
def test_longer_conversations(seed):
    rng = random.Random(seed)
    rows = tuple(rng.choices(KINDS, weights=[rng.random() ** 3 + 0.01 for _ in KINDS], k=rng.randint(5, 60)))
    assert C.cheapest(bytes(symbol(*r) for r in rows)) == plain_search(rows)


def test_tables_are_small_and_a_block_equals_its_symbols():
    t = C.tables()
    assert len(t.vectors) < 200 and len(t.block) == len(t.vectors)
    rng = random.Random(1)
    for _ in range(300):
        v, own = rng.randrange(len(t.vectors)), bytes(rng.randrange(C.PAD) for _ in range(rng.randint(0, C.BLOCK)))
        vector, off = t.vectors[v], 0
        for s in own:
            vector, more = C.capped(C.stepped(vector, s))
            off += more
        assert t.block[v][C.block_number(own)] == (t.number[vector], off)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_report(rows, ids):
    """Report rows by conv_id, from damaged rows."""
    out = {}
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
        seen, marks, turns = set(), [], {r[1] for r in own} - {None}
        for _, _, role, text in own:
            last = text.rstrip(" \t\n\v\f\r")[-1:]
            marks.append("b" if not last else "d" if (role, text) in seen else "k" if last in ".!?" else "t")
            seen.add((role, text))
        cost, audit = plain_search(tuple((r[2][:1], m in "bd", m == "t") for r, m in zip(own, marks)))
        lines, state, at = [], "", 0
        for e in audit:
            new = "a" if state == "u" else "u"
            role, text = (own[at][2], own[at][3]) if e != "I" else ("", "")
            at += e != "I"
            if e == "K":
                state = role[0]
            elif e in "RI":
                state, role = new, ROLE[new]
            if e != "D":
                lines.append(f"{role}:{text}")
        assert GOOD.fullmatch("".join(x[0] for x in lines)) and at == len(own)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed, n=150):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "what", "", " \t", None, "é ü?", "Fine. ", "a.\nb", ".", "Long " * 40 + "end."]
    rows = []
    for conv in range(n):
        roles = ["system"] * (rng.random() < 0.3) + ["user", "assistant"] * rng.randint(0, 6)
        for turn, role in enumerate(roles):
            if rng.random() < 0.15:
                role = rng.choice(["user", "assistant", "system", "tool", "", None, "Xs"])
            rows.append((conv, turn if rng.random() < 0.93 else rng.choice([None, turn + 3, turn - 1]), role, rng.choice(texts) if rng.random() < 0.6 else f"text {conv} {turn}."))
    rows += [next((c, 0, "user", "Gone.") for c in itertools.count(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)]  # damage drops it
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, None, None)]
    return rows + rows[:5]


def report(rows, given):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in C.repair_report(rows, given).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_report_as_by_brute_force(spark, seed):
    rows = conversations(seed)
    given = clash(spark.createDataFrame(rows, TURNS)).repartition(6)
    want = plain_report(plain_damage(rows), {r[0] for r in rows})
    assert report(C.damaged(given), given) == want
    assert any(w[6] == "" for w in want.values()) and set("".join(w[6] for w in want.values())) == set("DIKR")
    undamaged = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert report(given, given) == plain_report(undamaged, {r[0] for r in rows})


def test_repaired_rows(spark):
    rows = conversations(3, 60)
    given = spark.createDataFrame(rows, TURNS)
    edits = C.audits(C.damaged(given)).cache()
    found = {}
    for r in sorted(C.repaired(C.damaged(given), edits).collect(), key=lambda r: (str(r.conv_id), r.step)):
        found.setdefault(r.conv_id, []).append(r)
    want = plain_report(plain_damage(rows), {r.conv_id for r in edits.collect()})
    assert {c: "".join(r.edit for r in own) for c, own in found.items()} == {c: w[6] for c, w in want.items()}
    for c, own in found.items():
        assert [r.step for r in own] == list(range(1, len(own) + 1))
        kept = [r for r in own if r.edit != "D"]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept).encode()).hexdigest() == want[c][7]
        assert all(r.text == "" and r.turn is None for r in own if r.edit == "I")


def test_long_conversation_and_text(spark):
    rng = random.Random(9)
    rows = [(1, k, rng.choice(["user", "assistant", "user", "assistant", "tool"]), rng.choice(["ok.", f"text {k}", f"T {k}!"])) for k in range(30_000)]
    rows += [(2, 0, "user", "x" * 3_000_000 + "."), (2, 1, "assistant", "y")]
    given = spark.createDataFrame(rows, TURNS)
    got = report(given, given)
    symbols, seen = [], set()
    for _, _, role, text in rows[:30_000]:
        symbols.append(C.MUST if (role, text) in seen else symbol(role[0], False, text[-1] not in ".!?"))
        seen.add((role, text))
    assert got[1][5:7] == C.cheapest(bytes(symbols)) and len(got[1][6]) >= 30_000
    assert got[2] == (0, 0, 0, 1, 0, 1, "KK", hashlib.sha256(b"user:" + b"x" * 3_000_000 + b".\nassistant:y").hexdigest())


def test_empty_table(spark):
    empty = spark.createDataFrame([], TURNS)
    assert C.repair_report(C.damaged(empty), empty).count() == 0
    assert C.repaired(empty, C.audits(empty)).count() == 0
