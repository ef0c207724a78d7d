"""Conversation repair against a search over all edit strings."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from monthpick.llm import conversation_repair as cr
from monthpick.llm.common import table
from monthpick.llm.queries import op11_conversation_repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def may_go_on(roles: str) -> bool:
    return re.fullmatch(r"s?(ua)*u?", roles) is not None


def cheapest(rows):
    """(cost, audit, repaired rows): best-first search by (cost, audit) with the grammar as text."""
    def kind(roles):  # what the rest depends on
        return ("start", "s", "u", "a")[0 if not roles else 1 + "sua".index(roles[-1])]

    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and GRAMMAR.fullmatch(roles):
            return cost, audit, list(out)
        if (i, kind(roles)) in seen:
            continue
        seen.add((i, kind(roles)))
        moves = [(3, "I", i, x, (x, "")) for x in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            moves.append((4, "D", i + 1, None, None))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                moves.append((more, "K", i + 1, role, (role, text)))
                moves += [(3 + more, "R", i + 1, x, (x, text)) for x in ("user", "assistant")]
        for c, letter, j, role, row in moves:
            if role is None:
                heapq.heappush(heap, (cost + c, audit + letter, j, roles, out))
            elif may_go_on(roles + role[:1]) and role[:1] in ("s", "u", "a"):
                heapq.heappush(heap, (cost + c, audit + letter, j, (roles + role[:1])[-3:] if len(roles) > 9 else roles + role[:1], (*out, row)))


def with_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")
        out.append((role, text, "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def report(conv, rows):
    """rows: (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faulty = with_faults([(r, t) for _, r, t in rows])
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, left = cheapest(faulty)
    n = lambda f: sum(x[2] == f for x in faulty)
    text = "\n".join(f"{r}:{t}" for r, t in left)
    return conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, n("blank"), n("duplicate"), n("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest()


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        here = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        here += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted((report(c, r) for c, r in out.items()), key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_whole_query(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(op11_conversation_repair(spark, sf)) == damaged(rows)


def test_symbols_against_search():
    r = random.Random(5)
    faults = {"": "", ".": "truncated"}
    for n in [*range(9)] * 60:
        symbols = [r.choice(cr.SYMBOLS) for _ in range(n)]
        if r.random() < 0.5:
            symbols = sorted(symbols)
        rows = [("user", "", "blank") if s == "-" else ({"s": "system", "u": "user", "a": "assistant", "o": "tool"}[s[0]], "x", faults[s[1:]]) for s in symbols]
        codes = bytes(map(cr.SYMBOLS.index, symbols))
        cost, audit, _ = cheapest(rows)
        assert (cr.product(codes) + cr.END).min(1)[cr.START] == cost
        assert cr.unroll(codes, cr.START, cr.END, True)[0] == audit
        # in two pieces
        a, b = codes[: n // 2], codes[n // 2 :]
        first, state = cr.unroll(a, cr.START, (cr.product(b) + cr.END).min(1), False)
        assert first + cr.unroll(b, state, cr.END, True)[0] == audit


def test_long_runs(monkeypatch):
    one = {s: bytes([cr.SYMBOLS.index(s)]) for s in cr.SYMBOLS}
    symbols = one["u"] * 997 + one["-"] * 64 + one["a."] * 1025 + one["o"] * 3
    whole = cr.unroll(symbols, cr.START, cr.END, True)
    for step in (1, 7, 64):
        monkeypatch.setattr(cr, "UNROLL", step)
        assert cr.unroll(symbols, cr.START, cr.END, True) == whole
    after = cr.END  # row by row, without powers
    for s in reversed(symbols):
        after = np.min([[c + after[to] for _, c, to in cr.edits(cr.SYMBOLS[s], q)] + [cr.NEVER] * (3 - len(cr.edits(cr.SYMBOLS[s], q))) for q in range(4)], 1)
        after = (cr.INSERTS + after).min(1)
    assert (cr.product(symbols) + cr.END).min(1)[cr.START] == after[cr.START]


@pytest.fixture
def odd():
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("system", "A."), ("user", None), (None, "b!"), ("assistant", "c"), ("User", "d."), ("", "e."), ("tool", "f?\n\t "), ("user", "g"), ("user", "g")])]
    rows += [(None, None, "user", "q?"), (None, None, "user", "q?"), (None, 3, "assistant", "a."), (None, 9, None, None)]
    rows += [(2, None, None, None), (3, 5, "assistant", "only."), (4, 7, "user", "\x0b\x0c"), (4, 7, "user", "x."), (4, 7, "assistant", "x.")]
    rows += [(50, t, ("user", "assistant")[t % 2], f"turn {t} é日.") for t in range(300)]
    rows += [(51, 0, "user", "again.")] * 500 + [(51, 1, "assistant", "again.")] * 300
    return rows


def test_odd_rows(spark, odd):
    df = spark.createDataFrame([(*r, 1, "x", b"y") for r in odd], "conv_id bigint, turn bigint, role string, text string, pos int, conv string, part binary")
    assert got(cr.repair_damaged(df)) == damaged(odd)


def test_conversations_over_many_tasks(spark, odd):
    df = spark.createDataFrame(odd, "conv_id bigint, turn bigint, role string, text string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        repair = cr.Repair(cr.damage(df))
        assert repair.audits.groupBy("conv").count().where("conv = '50'").first()["count"] > 1
        found = got(cr.repair_damaged(df))
        texts = {}
        for r in repair.rows().collect():
            texts.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
        sums = {c: len(rows) for c, rows in texts.items()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = damaged(odd)
    assert found == want
    for row in want:
        letters = row[7]
        assert sums.get(" " if row[0] is None else str(row[0]), 0) == len(letters) - letters.count("D")


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert cr.repair_damaged(df).count() == 0
