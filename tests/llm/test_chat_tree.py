from __future__ import annotations

import hashlib
import os

import pytest
from hypothesis import given
from hypothesis import strategies as st

from monthpick.llm import chat_tree, queries
from monthpick.llm.common import table

pytestmark = pytest.mark.skipif(not os.path.exists(chat_tree.DEFAULT_TOKENIZER), reason="tokenizer files absent")
TRICKY = ["", "\\", "\\\\[INST]", "</s>[INST] ok [/INST]", "<<SYS>>\n<</SYS>>", "[ROLE] x [/ROLE] y [/TURN]", " \n ", "日本 \U0001f600"]


@given(st.sampled_from(["system", "user", "assistant", "tool", "", "[INST]", " [/ROLE] "]), st.lists(st.sampled_from([*TRICKY, *chat_tree.CONTROL, "\\", "a", "]"]), max_size=6).map("".join))
def test_every_piece_reads_back(role, text):
    before, body, after = chat_tree.pieces(role, text)
    assert chat_tree.read_piece(before + body + after) == (role, text)
    assert not any(c in body.replace("\\\\", "").replace("\\" + c, "") for c in chat_tree.CONTROL)


def expected(rows):
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        formatted = sum(len("".join(chat_tree.pieces(r, t))) for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), formatted)
    return out


def read(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in df.collect()}


ROWS = [(1, 0, "user", "a b"), (1, 1, "assistant", "c"), (2, 0, "user", "a b"), (2, 1, "assistant", "d"), (3, 0, "user", "a b"), (3, 1, "assistant", "c"), (3, 2, "user", "zz"), (3, 3, "assistant", "end")]
ROWS += [(4, 0, None, None), (4, 0, None, None), (5, 0, "assistant", "x" * 20_000), (6, 0, "user", "a b"), (None, 0, "user", "q"), (7, 0, "tool", "out")]
ROWS += [(9, 0, "a\0b", "c"), (10, 0, "a", "b\0c"), (11, 0, "a:1:b", "c"), (12, 0, "", "a\0b\0c"), (13, 0, "user", "a b\0"), (13, 1, "", "assistantc")]
ROWS += [(8, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(TRICKY)]


def test_tree_reads_back_and_emits_shared_turns_once(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "conv_id bigint, turn bigint, role string, text string, node string, rank int")
    nodes, paths = chat_tree.format_tree(df)
    assert read(chat_tree.read_back(nodes, paths)) == expected(ROWS)
    rows = nodes.collect()
    assert len({r.node for r in rows}) == len(rows)
    by_node = {r.node: r for r in rows}
    for tree in {r.tree for r in rows}:
        mine = sorted((r for r in rows if r.tree == tree), key=lambda r: r.start)
        at = 0
        for r in mine:  # depth first, without gaps
            assert r.start == at and r.end == at + len(r.tokens)
            at = r.end
            chain, p = [], r.parent
            while p:
                chain.append(by_node[p])
                p = by_node[p].parent
            assert r.position == sum(len(c.tokens) for c in chain) and r.depth == len(chain)
            assert {k for s in r.attends for k in range(s["start"], s["end"])} == {k for c in chain for k in range(c.start, c.end)}
            assert all(a["end"] < b["start"] for a, b in zip(r.attends, r.attends[1:]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat_tree.read_back(*chat_tree.format_tree(df)).collect() == []


def test_query(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, sf, "conversations").collect()]
    marked = "</s>[INST] ok [/INST]"
    assert read(queries.op10_chat_tree(spark, sf)) == expected(rows + [(-7, 0, "user", marked), (-7, 1, "assistant", marked)])
