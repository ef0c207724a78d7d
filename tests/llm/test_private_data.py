from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from monthpick.llm import private_data, queries
from monthpick.llm.common import table

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in hit.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def spans(df):
    return {r.doc_id: [tuple(s) for s in r.base] for r in df.collect()}


def test_base_spans_match_the_plain_patterns(docs):
    texts = [
        None, "", "no data", "a@b.co_x@y.z", "x@y@z.com", "a@b", "..a..@-.-", "😀 é me@x.org😀 1.2.3.4", "256.1.1.1 0255.0.0.1 1.2.3.4.5.6.7.8", "1.2.3",
        "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111" * 2, "+1 (555) 555-1234 +12 34 +1 234 567 8 (9)", "+4)( 1", "1" * 5000, "1." * 3000, "a@" + "b." * 3000 + "c",
        "a" * 50_000 + "@x.yz", "+" + "1 " * 4000, "++49 30 123456-78.", "5500 0000 0000 0004 4111 1111 1111 1111",
    ]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    got = spans(private_data.find_private_data(docs(rows)))
    assert got == {i: brute(t) for i, t in rows}


def test_patterns_of_seeds_find_unseen_identifiers(docs):
    seeds = [(k, f"Please mail my card number {4111111111111111 + 0} today, reference user{k}@site{k}.com thanks") for k in range(1)]
    seeds += [(10 + k, f"word{k} contact address user{k}@mail{k}.org please reply {k}") for k in range(30)]
    odd = [(100, "contact address user7f839201(at)mailhost please reply"), (101, "price list a8392011b never mind")]
    got = {r.doc_id: r.spans for r in private_data.find_private_data(docs(seeds + odd)).collect()}
    assert [s["kind"] for s in got[100]] == ["email"]
    assert got[101] == []


def test_redaction_replaces_all_spans_and_keeps_rows(docs):
    rows = [(1, "mail a@b.co now"), (2, None), (3, "😀 1.2.3.4 x +1 (555) 555-1234"), (3, "😀 1.2.3.4 x +1 (555) 555-1234"), (4, "clean")]
    source = docs(rows)
    out = private_data.redact(source, private_data.find_private_data(source))
    assert out.columns == source.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect() if r.text) == [(1, "mail <email> now", 16), (3, "😀 <ip> x <phone>", 16), (3, "😀 <ip> x <phone>", 16), (4, "clean", 5)]
    assert out.where("text IS NULL").count() == 1


def test_empty_table(docs):
    assert private_data.find_private_data(docs([])).collect() == []


def test_query_matches_the_plain_patterns(spark, sf):
    got = {r.doc_id: r for r in queries.op2_private_data(spark, sf).collect()}
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        base = brute(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert got[r.doc_id].n_card == sum(k == "card" for k, _, _ in base)
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[r.doc_id].spans.split(","))


def test_no_python_in_the_plan(spark, sf):
    plan = queries.op2_private_data(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert F.col("x") is not None


def test_whole_tokens_of_any_make_are_candidates(docs):
    seeds = [(k, f"word{k} contact address user{k}@mail{k}.org please reply {k}") for k in range(30)]
    seeds += [(100 + k, f"item{k} dial number +49 30 {1234567 + k} after nine {k}") for k in range(30)]
    odd = {
        300: ("contact address john.doe(at)host please reply", "email", "john.doe(at)host"), 301: ("contact address user7f839201(at)mailhost please reply", "email", "user7f839201(at)mailhost"),
        302: ("first a@b.co or dial number 030 123 45 67 after nine", "phone", "030 123 45 67"), 303: ("x 1.2.3.4 then contact address jane[at]site please", "email", "jane[at]site"),
    }
    source = docs(seeds + [(k, t) for k, (t, _, _) in odd.items()] + [(400, "contact me at your address and reply please")] + [(500 + k, "this and that, reply and more") for k in range(5)])
    found = private_data.find_private_data(source)
    got = {r.doc_id: r for r in found.collect()}
    for k, (text, kind, value) in odd.items():
        assert (kind, text.index(value), text.index(value) + len(value)) in [tuple(s) for s in got[k].spans]
    assert got[400].spans == []
    clean = {r.doc_id: r.text for r in private_data.redact(source, found).collect()}
    assert clean[300] == clean[301] == "contact address <email> please reply"
    assert clean[302] == "first <email> or dial number <phone> after nine" and clean[303] == "x <ip> then contact address <email> please"


def two_rounds():
    """Texts of seeds, words that stand like them, and a word that only stands with those words."""
    rows = [(k, f"word{k} contact address user{k}@mail{k}.org please reply {k}") for k in range(60)]
    rows += [(100 + k, f"so ping me{k}@here{k}.net soon") for k in range(6)]
    rows += [(200 + k, f"now contact address v{k}(at)host please or ping v{k}(at)host soon") for k in range(10)]
    rows += [(300, "then ping late[at]host soon"), (301, "the list and the rest")]
    return rows + [(400 + k, f"word {k} dial +49 30 {1234567 + k} after the number") for k in range(20)]


def test_patterns_that_are_not_counted_change_no_score(docs, monkeypatch):
    source = docs(two_rounds())
    counted = []
    edges = private_data._token_edges
    monkeypatch.setattr(private_data, "_token_edges", lambda rows, patterns: counted.append(sorted(r.pattern for r in patterns.collect())) or edges(rows, patterns))
    got = {r.doc_id: r.spans for r in private_data.find_private_data(source).collect()}
    assert [s["kind"] for s in got[300]] == ["email"] and len(got[200]) == 2 and got[301] == []
    assert "L:ping" in counted[0] and "L:ping" not in counted[1] and "L:ping" in counted[2]  # only the second round needs it
    monkeypatch.setattr(private_data, "_can_be_sure", lambda believed: F.lit(True))
    assert {r.doc_id: r.spans for r in private_data.find_private_data(source).collect()} == got


def test_common_words_beside_seeds_make_no_edges(docs, monkeypatch):
    rows = [(k, f"mail the user{k}@mail{k}.org and go") for k in range(40)] + [(100 + k, f"see the thing{k} and go") for k in range(640)]
    staged = []
    stage = private_data.Scratch.stage
    monkeypatch.setattr(private_data.Scratch, "stage", lambda self, df: staged.append(stage(self, df)) or staged[-1])
    assert all(len(r.spans) == (r.doc_id < 100) for r in private_data.find_private_data(docs(rows)).collect())
    assert sum(x.where("kind = 'token'").count() for x in staged if x.columns == ["kind", "value", "pattern", "times"]) < 200
