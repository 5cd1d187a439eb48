import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from partmill.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, digest string, n int"


def order(rows):
    """By turn, nulls first, then role, then digest; equal rows stay together."""
    key = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()[:16]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), key(r)))


def plain(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, hash of one conversation's rows (turn, role, text), each edit tried."""
    rows = order([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows])
    turns = [t for t, _, _ in rows if t is not None]
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    whole = re.compile(r"(s?(ua)+)?")

    @cache
    def best(k, state, put):
        """Least (cost, audit, repaired turns) of the rows from k; state: the last initial kept, '' at first."""
        out = [] if k < len(rows) or state in ("s", "u") else [(0, "", ())]

        def go(letter, cost, k, state, turn, put=0):
            if rest := best(k, state, put):
                out.append((cost + rest[0], letter + rest[1], (*([turn] if turn else []), *rest[2])))

        if put < 4:
            new = "a" if state == "u" else "u"
            go("I", 3, k, new, ({"a": "assistant", "u": "user"}[new], ""), put + 1)
        if k < len(rows):
            _, role, text = rows[k]
            more = 3 * (faults[k] == "truncated")
            go("D", 4, k + 1, state, None)
            if faults[k] not in ("blank", "duplicate"):
                new = "a" if state == "u" else "u"
                go("R", 3 + more, k + 1, new, ({"a": "assistant", "u": "user"}[new], text))
                if role[:1] and state + role[:1] in ("s", "u", "su", "ua", "au"):
                    go("K", more, k + 1, role[:1], (role, text))
        return min(out, key=lambda x: x[:2]) if out else None

    for k in range(len(rows), -1, -1):  # from the end, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(k, state, 0)
    cost, audit, kept = best(0, "", 0)
    assert whole.fullmatch("".join(r[0] for r, _ in kept))
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()


ROLES = ["user", "assistant", "system", "tool", "", None, "u", "student", "a b"]
TEXTS = ["Yes.", "No", "", None, " \n", "Why?", "What . ", "x!\t", "end ", " ", "..."]


def conversations(seed, number, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(number):
        kind = rng.random()
        for turn in range(rng.randrange(1, most)):
            role = ROLES[turn % 2] if rng.random() < kind else rng.choice(ROLES)
            text = f"Text {turn}." if rng.random() < kind else rng.choice(TEXTS)
            rows += [(None if conv == 3 else conv, rng.choice([turn] * 9 + [None, turn * 3, turn - 1]), role, text)] * rng.choice([1] * 12 + [2, 5])
    return rows


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("size", [1, 2, 5, 1024])
def test_every_conversation_by_trying_all_edits(spark, size):
    """Chunks of one row need the most passes; all sizes give the same."""
    rows = conversations(size, 60, 14)
    own = frame(spark, rows)
    found = repair.with_digests(own, repair.audits(own, size))
    got = {r[0]: tuple(r[1:]) for r in found.collect()}
    assert got == {k: plain(v) for k, v in by_conversation(rows).items()}


@pytest.mark.parametrize("kind", ["normal", "tools", "blank", "same"])
def test_a_long_conversation_over_many_chunks(spark, kind):
    """Also where vectors never converge: other roles cost alike whoever they become, and blank rows pass vectors on as they are."""
    rows = {
        "normal": [(1, k, "user" if k % 2 else "assistant", f"t{k}.") for k in range(400)],
        "tools": [(1, k, "tool", f"t{k}.") for k in range(399)] + [(1, 400, "user", "the end")],
        "blank": [(1, k, "user", " ") for k in range(300)] + [(1, 301, "user", "last.")],
        "same": [(1, k // 50, "user", "same.") for k in range(300)],
    }[kind]
    own = frame(spark, rows).repartition(3)
    got = {r[0]: tuple(r[1:]) for r in repair.with_digests(own, repair.audits(own, 16)).collect()}
    assert got == {1: plain([r[1:] for r in rows])}


def test_vectors_and_choices_agree_with_a_chunk_run_whole():
    rng = random.Random(3)
    for _ in range(200):
        codes = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randrange(1, 30)))
        whole = repair.swept(codes, repair.END)
        cut = rng.randrange(len(codes) + 1)
        tail = repair.swept(codes[cut:], repair.END)
        assert whole[:cut] == repair.swept(codes[:cut], tail[0])[:cut]
        assert whole[: cut + 1] == repair.swept(codes[:cut], tail[0], repair.swept(codes[:cut], (0, 0, 0, 0)))


def test_query_on_every_id(spark, tmp_path):
    rows = conversations(11, 80, 6) + [(500, k, "user", None) for k in range(9)] + [(None, None, None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    bad = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        bad.setdefault(conv, []).extend([(turn, "user" if draw == 4 else role, text)] * {0: 0, 3: 2}.get(draw, 1))
    want = {k: plain(v) for k, v in bad.items()}
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in repair.op11_repair(spark, str(tmp_path)).collect()}
    assert got == want and any(v == [] for v in bad.values())


def test_repaired_turns_and_empty_table(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c."), (2, 0, "assistant", "d.")]
    own = frame(spark, rows)
    found = repair.audits(own)
    got = sorted(map(tuple, repair.repaired(own, found).collect()))
    assert got == [(1, 0, "user", "a."), (1, 1, "assistant", ""), (1, 2, "user", "b."), (1, 3, "assistant", "c."), (2, 0, "user", ""), (2, 1, "assistant", "d.")]
    assert repair.audits(own.limit(0)).collect() == []
