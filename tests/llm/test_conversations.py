"""Repair against all edit sequences, and the jobs' edges."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tapeforge.llm import conversations as c

SPACE = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        pick = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if pick == 1:
            text = ""
        elif pick == 2:
            text = re.sub("[.!?]", "", text)
        elif pick == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(pick, 1)
    return out


def brute_faults(rows):
    """Rows of one conversation, in order, as (role, text, fault)."""
    seen, out = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(SPACE)[-1:]
        out.append((role, text, "blank" if not end else "duplicate" if (role, text) in seen
                    else "truncated" if end not in ".!?" else ""))
        seen.add((role, text))
    return out


def brute_repair(rows):
    """Least (cost, audit) with its rows, over every sequence of edits; up to two rows inserted in a row, one among many rows."""
    inserts = [[("I", 5, r, "") for r in way] for n in range(3 if len(rows) < 3 else 2) for way in itertools.product(("user", "assistant"), repeat=n)]
    per_row = []
    for role, text, fault in rows:
        ways = [[("D", 2, None, None)]]
        if fault not in ("blank", "duplicate"):
            more = 5 * (fault == "truncated")
            ways += [[("K", more, role, text)], [("R", 1 + more, "user", text)], [("R", 1 + more, "assistant", text)]]
        per_row.append([w + i for w in ways for i in inserts])
    best = None
    for edits in itertools.product(inserts, *per_row):
        flat = [e for part in edits for e in part]
        given = [(r, t) for _, _, r, t in flat if r is not None]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in given)):
            found = (sum(e[1] for e in flat), "".join(e[0] for e in flat), given)
            best = found if best is None or found[:2] < best[:2] else best
    return best


def brute(rows, ids):
    out = {}
    for conv in ids:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        marked = brute_faults(mine)
        turns = {r[1] for r in mine if r[1] is not None}
        starts = [r[:1] for r, _, _ in marked]
        cost, audit, given = brute_repair(marked)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                     *(sum(f == k for _, _, f in marked) for k in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(starts)), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in given).encode()).hexdigest())
    return out


COLUMNS = "conv_id long, turn long, role string, text string, gaps string, seen boolean"  # the last two clash


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", True) for r in rows], COLUMNS).repartition(3)


def test_repair_equals_the_best_of_all_edits(spark):
    rnd = random.Random(11)
    rows = []
    for conv in [None, *range(150)]:
        for turn in range(rnd.randint(0, 3)):
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "u"])
            text = rnd.choice(["Yes.", "No!", "Cut", "", None, " \n", "é ß?\n ", "Other."])
            rows.append((conv, rnd.choice([turn, turn, turn * 3 - 2, None]), role, text))
    gone = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Yes."))
    want = brute(brute_damage(rows), {r[0] for r in rows})
    df = table(spark, rows)
    got = c.repair(c.damaged(df), df)
    assert got.columns == c.RESULT.fieldNames()
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == want
    assert want[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    # the audits applied to the rows give what was digested
    damaged = c.damaged(df)
    texts = {}
    for r in sorted(c.repaired_rows(damaged, c.repair(damaged)).collect(), key=lambda r: r.position):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, w in want.items():
        assert hashlib.sha256("\n".join(texts.get(conv, [])).encode()).hexdigest() == w[7]


def test_repair_of_nothing(spark):
    df = table(spark, [])
    assert c.repair(c.damaged(df), df).count() == 0 and c.repair(df).count() == 0


def test_long_conversation_against_dynamic_programme(spark):
    """Thousands of rows: a plain shortest path over (rows read, last role given) must agree."""
    rnd = random.Random(12)
    rows = [(1, t, rnd.choice(["system", "user", "assistant", "assistant"]), f"Row {rnd.choice([t, t, 7])}{rnd.choice('.!?,')}")
            for t in range(3000)]
    best = {"": (0, "")}

    def better(to, state, cost, audit):
        if state not in to or (cost, audit) < to[state]:
            to[state] = (cost, audit)

    def step(state, role):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, role))

    def closed(now):
        for _ in range(2):
            for state, (cost, audit) in list(now.items()):
                for r in "ua":
                    if to := step(state, r):
                        better(now, to, cost + 5, audit + "I")
        return now

    closed(best)
    for role, _, fault in brute_faults(rows):
        after = {}
        for state, (cost, audit) in best.items():
            better(after, state, cost + 2, audit + "D")
            if fault not in ("blank", "duplicate"):
                for r in {role[:1], "u", "a"}:
                    if to := step(state, r):
                        better(after, to, cost + (r != role[:1]) + 5 * (fault == "truncated"), audit + ("K" if r == role[:1] else "R"))
        best = closed(after)
    want = min(best[s] for s in ("", "a") if s in best)
    got = c.repair(table(spark, rows)).first()
    assert (got.cost, got.audit) == want and len(got.audit) >= 3000


def test_inserted_rows(spark, monkeypatch):
    """At the given costs deleting always beats inserting; cheaper inserts are taken, and applied."""
    monkeypatch.setitem(c.COST, c.INSERT, 1)
    parser = c.Parser()
    parser.start()
    for role in ("system", "user", "user", "assistant"):
        parser.row(role, b"x.", False, False)
    cost, audit, digest = parser.finish()
    assert (cost, audit) == (1, "KKIKK")
    rows = table(spark, [(1, t, r, "x.") for t, r in enumerate(("system", "user", "user", "assistant"))])
    found = spark.createDataFrame([(1, audit)], "conv_id long, audit string")
    got = sorted(c.repaired_rows(rows, found).collect(), key=lambda r: r.position)
    assert [(r.role, r.action) for r in got] == [("system", "K"), ("user", "K"), ("assistant", "I"), ("user", "K"), ("assistant", "K")]
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in got).encode()).hexdigest() == digest


def test_automaton_takes_the_language():
    goto, reduce, accept = c.automaton()
    parser = c.Parser()
    for n in range(7):
        for word in itertools.product("sua", repeat=n):
            cell = (0, None)
            for t in word:
                cell = cell and parser._shift(cell, t)
            assert (cell is not None and cell[0] in accept) == bool(re.fullmatch("(s?(ua)+)?", "".join(word))), word


@pytest.mark.parametrize("text", ["x" * 2_000_000 + ".", "\n" * 300_000])
def test_very_long_texts(spark, text):
    got = c.repair(table(spark, [(1, 0, "user", text), (1, 1, "assistant", "Fine.")])).first()
    assert got.audit == ("KK" if text[0] == "x" else "DD" if got.cost == 4 else "DIK")
