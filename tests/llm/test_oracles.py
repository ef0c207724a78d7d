"""The SQL of operators against their brute-force versions and odd rows (the whole queries are compared by tests/test_oracle.py)."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa

from monthpick.llm import oracles
from tests.llm import test_chat_tree as chats
from tests.llm import test_conversation_repair as repairs
from tests.llm import test_importance as draws
from tests.llm import test_substring_dedup as repeats


def run(sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    return [dict(zip(names, r)) for r in res.fetchall()]


def documents(rows):
    return pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})


def test_repeats():
    rng = random.Random(3)
    rows = [(k // 2, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for k in range(40)] + [(None, "a b " * 20), (90, None), (91, " \t")]
    got = run(oracles.substring_dedup(), documents=documents(rows))
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == repeats.brute(rows)


def test_repairs():
    rng = random.Random(4)
    rows = [(c, rng.choice([t, t, None]) if c % 7 == 0 else t, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["x.", "y", "", "z!\n", None, "w? "])) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "q."), (None, 2, "assistant", "a.")]
    columns = list(zip(*rows))
    table = pa.table({"conv_id": pa.array(columns[0], pa.int64()), "turn": pa.array(columns[1], pa.int64()), "role": pa.array(columns[2], pa.string()), "text": pa.array(columns[3], pa.string())})
    got = run(oracles.conversation_repair(), conversations=table)
    assert sorted((tuple(r[c] for c in repairs.COLUMNS) for r in got), key=repr) == repairs.damaged(rows)


def test_draws():
    words = " ".join(f"w{i % 37}" for i in range(25))
    rows = [(1, None), (2, ""), (3, "ÀB  c\x00d9`E"), (None, words), (4, words), (5, words + " more"), *((100 + i, f"{words} {i} Ünï—code") for i in range(60))]
    target = ["w1 w2 w3 w4", None, ""]
    got = run(oracles.importance(), documents=documents(rows), benchmark=pa.table({"text": pa.array(target, pa.string())}))
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got), key=repr) == draws.brute(rows, target)


def test_chats():
    rows = [r for r in chats.ROWS if "\0" not in (r[2] or "") + (r[3] or "")]
    columns = list(zip(*rows))
    table = pa.table({"conv_id": pa.array(columns[0], pa.int64()), "turn": pa.array(columns[1], pa.int64()), "role": pa.array(columns[2], pa.string()), "text": pa.array(columns[3], pa.string())})
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in run(oracles.chat_digests(), conversations=table) if r["conv_id"] != -7}
    assert got == chats.expected(rows)
