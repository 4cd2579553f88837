"""Conversation repair, against a plain program over whole edit sequences."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from zlib import crc32

import pytest

from veilscan.llm import repair

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def in_order(rows):
    rows = [(c, t, *(" " if x is None else x for x in (r, s))) for c, t, r, s in rows]
    digest = lambda s: hashlib.sha256(s.encode()).digest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r[3])))


def plain_report(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation's rows, by a search
    over (cost, audit) of all ways."""
    rows, seen, faults = in_order(rows), set(), []
    for _, _, role, text in rows:
        signs = BLANK.findall(text)
        faults.append("blank" if not signs else "duplicate" if (role, text) in seen else
                      "truncated" if signs[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def insert(ways):
        ways = dict(ways)
        for _ in range(2):
            for state, (cost, audit, out) in list(ways.items()):
                for to in set(after[state]) - {"s"}:
                    new = (cost + 2, audit + "I", (*out, f"{names[to]}:"))
                    ways[to] = min(ways.get(to, new), new)
        return ways

    for (_, _, role, text), fault in zip(rows, faults):
        ways: dict = {}
        for state, (cost, audit, out) in insert(best).items():
            found = [(state, 3, "D", out)]
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if role[:1] in after[state]:
                    found.append((role[:1], more, "K", (*out, f"{role}:{text}")))
                found += [(to, 2 + more, "R", (*out, f"{names[to]}:{text}")) for to in set(after[state]) - {"s"}]
            for to, more, letter, kept in found:
                new = (cost + more, audit + letter, kept)
                ways[to] = min(ways.get(to, new), new)
        best = ways
    cost, audit, out = min(w for s, w in insert(best).items() if s in ("", "a"))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def by_conversation(rows):
    found: dict = {}
    for r in rows:
        found.setdefault(r[0], []).append(r)
    return found


COLUMNS = "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, has int, cost string")


def reported(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def some_rows(seed=1):
    rng, rows = random.Random(seed), []
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "user"]
    texts = ["Yes.", "no end", "", " \t\n", None, "What? ", "A.", "B!", "c. d", " ", "long " * 50 + "."]
    for conv in range(120):
        for _ in range(rng.randrange(1, 14)):
            rows.append((conv, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)))
    return rows + [(None, t, "user", "Hi.") for t in (None, 3, 3, 5)] + [(1 << 62, None, None, None)]


def test_report(spark):
    rows = some_rows()
    expected = sorted(((c, *plain_report(r)) for c, r in by_conversation(rows).items()), key=repr)
    assert reported(repair.report(frame(spark, rows))) == expected


def test_long_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(repair, "RUNS", 3)
    monkeypatch.setattr(repair, "UNROLLED", 7)
    rng = random.Random(8)
    rows = [(5, n, "user", f"question {n}?") for n in range(900)]
    rows += [(5, 1000 + n, rng.choice(["user", "assistant"]), rng.choice([f"{n}.", "same.", f"open {n}"])) for n in range(500)]
    rows += [(6, 1, "assistant", "copies.")] * 700
    expected = sorted(((c, *plain_report(r)) for c, r in by_conversation(rows).items()), key=repr)
    assert reported(repair.report(frame(spark, rows).repartition(5))) == expected


def test_repaired_turns_are_legal_and_give_the_digest(spark):
    rows = some_rows(2)
    turns = [r.asDict() for r in repair.repaired(frame(spark, rows)).collect()]
    digests = {r[0]: (r[-2], r[-1]) for r in reported(repair.report(frame(spark, rows)))}
    for conv, (audit, digest) in digests.items():
        mine = sorted((t for t in turns if t["conv_id"] == conv), key=lambda t: t["place"])
        assert "".join(t["edit"] for t in mine) == audit
        kept = [t for t in mine if t["edit"] != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in kept))
        assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in kept).encode()).hexdigest() == digest


def test_query_on_conversations_with_nulls(spark, tmp_path):
    rows = some_rows(3) + [(7000 + k, 0, "user", "Only.") for k in range(40)]
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    left = by_conversation(damaged(rows))
    empty = hashlib.sha256(b"").hexdigest()
    expected = sorted(((c, *(plain_report(left[c]) if c in left else (0, 0, 0, 0, 0, 0, "", empty))) for c in by_conversation(rows)), key=repr)
    assert reported(repair.query(spark, str(tmp_path))) == expected


def test_nothing(spark):
    nothing = frame(spark, [(1, 1, "user", "a")]).where("false")
    assert repair.report(nothing).count() == repair.repaired(nothing).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_powers_equal_single_steps(n):
    for symbol in [0, 1, 2, 3, 4, 5, 6, 7, 8]:
        costs = repair.AT_END
        for _ in range(n):
            costs = repair.times(repair.power(symbol, 0), costs)
        assert repair.advanced(symbol, n, repair.AT_END) == costs
