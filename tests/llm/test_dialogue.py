"""Repair of conversations against all edits tried one by one, and edge rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from conftest import DATA

from tessera.llm import dialogue

LEGAL = {"su", "ua", "au"}


def cheapest(rows):
    """The least (cost, audit, turns) of rows (role, text, fault): every sequence of edits that can end well is tried."""
    best = None

    def go(k, roles, cost, audit, turns, inserts):
        nonlocal best
        if not re.fullmatch("(s?(ua)*u?)?", roles) or (best and cost > best[0]):
            return
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit, turns), (cost, audit, turns))
        if inserts < 3:
            for role in ("user", "assistant"):
                go(k, roles + role[0], cost + 3, audit + "I", [*turns, role + ":"], inserts + 1)
        if k == len(rows):
            return
        role, text, fault = rows[k]
        go(k + 1, roles, cost + 4, audit + "D", turns, 0)
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            if role[:1]:
                go(k + 1, roles + role[0], cost + more, audit + "K", [*turns, f"{role}:{text}"], 0)
            for new in ("user", "assistant"):
                go(k + 1, roles + new[0], cost + 3 + more, audit + "R", [*turns, f"{new}:{text}"], 0)

    go(0, "", 0, "", [], 0)
    return best


def plain(rows):
    """{conv_id: result} of rows (conv_id, turn, role, text)."""
    said = lambda x: " " if x is None else str(x)
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    by = {}
    for conv, turn, role, text in rows:
        own, fate = by.setdefault(conv, []), zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        if fate:
            own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=key)
        seen, rows, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            end = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            rows.append((role, text, fault))
            if fault:
                counts[fault] += 1
        turns = {t for t, *_ in own if t is not None}
        illegal = sum((a[0][:1] + b[0][:1]) not in LEGAL for a, b in itertools.pairwise(rows))
        cost, audit, left = cheapest(rows)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def found(spark, rows, schema="conv_id long, turn long, role string, text string"):
    got = dialogue.repaired_conversations(dialogue.damaged(spark.createDataFrame(rows, schema).repartition(3))).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_against_all_edits(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in dialogue.op11_dialogue(spark, DATA).collect()}
    assert got == plain(rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.randrange(7)):
            turn = rng.choice([None, *range(6)])
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "tool", "", None]), rng.choice(["a.", "b!", "c", " \t", "", None, "d?\n"])))
    assert found(spark, rows) == plain(rows)


def test_one_conversation_in_many_pieces():
    """Pieces of any lengths fold to what the whole gives; copies and repeated roles included."""
    rng = random.Random(7)
    for _ in range(40):
        n = rng.randrange(1, 60)
        rows = [(rng.choice(["system", "user", "assistant", "x"]), f"t{k}.") for k in range(n)]
        classes = [(r[0] if r[0] in "sua" else "-", rng.choice([0, 0, 0, 1, 2])) for r, _ in rows]
        whole = dialogue.Fold(1)
        whole.add(rows, classes, {e: dialogue.paths(classes, e) for e in range(4)}, (0,) * 5 + (None, None))
        cut = dialogue.Fold(1)
        k = 0
        while k < n:
            m = rng.randrange(1, 8)
            part = classes[k : k + m]
            cut.add(rows[k : k + m], part, {e: dialogue.paths(part, e) for e in range(4)}, (0,) * 5 + (None, None))
            k += m
        assert [x for i, x in enumerate(whole.result()) if i != 5] == [x for i, x in enumerate(cut.result()) if i != 5]
    assert dialogue.step.cache_info().currsize < 5000


def test_long_conversation_over_partitions(spark):
    """A conversation with most of the rows, and a row with many copies, next to short ones."""
    rows = [(5, t, "user" if t % 2 == 0 else "assistant", f"text {t}." if t % 7 else "again") for t in range(3000)]
    rows += [(6, None, "user", "same.")] * 2000 + [(c, 0, "user", "hello.") for c in range(10, 300)]
    got = found(spark, rows)
    assert set(got) == {5, 6, *range(10, 300)}
    # a plain pass over whole strings, row by row
    kept = [(t, r, x) for c, t, r, x in rows if c == 5]
    audit = got[5][6]
    assert audit.count("D") + audit.count("K") + audit.count("R") == sum({0: 0, 3: 2}.get(zlib.crc32(f"5:{t}".encode()) % 20, 1) for t, _, _ in kept)
    fate = zlib.crc32(b"6: ") % 20
    assert got[6][2] == {0: 0, 3: 3999}.get(fate, 1999)


def test_edges(spark):
    assert found(spark, [(1, 1, None, None)], "conv_id long, turn long, role string, text string").keys() == {1}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, n string, k int, piece string")
    assert dialogue.repaired_conversations(dialogue.damaged(empty)).count() == 0
    more = spark.createDataFrame([(1, 1, "user", "x." * 3_000_000, "n", 1, "p"), (1, 2, "assistant", "é.", None, 2, "q")], "conv_id long, turn long, role string, text string, n string, k int, piece string")
    got = dialogue.repaired_conversations(dialogue.damaged(more)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain([tuple(r)[:4] for r in more.collect()])
