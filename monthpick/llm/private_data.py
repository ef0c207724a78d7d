"""Personal data by bootstrapped contextual extraction, in DataFrame functions only (operator 2).

Regular expressions find the base spans (email, ip, card, phone) with their places.
They are the seeds: the words around a seed are lexical patterns.  All other tokens
between whitespace, and short runs of digit groups as one, are candidates.  Patterns and
values form a bipartite graph whose scores are computed in rounds: a pattern's confidence
for a kind is the share of the values in it that are believed to be of that kind, a
value's belief is the noisy-or of its confident patterns.  Candidates believed strongly
enough become spans of that kind, unless most of their places are in other patterns.

A pattern needs MIN_SUPPORT seeds of a kind to be confident, and few other values, so only
edges of patterns that can be confident are kept; that changes no score.  A pattern's
values in one of PROBE documents are a lower bound of all its values: with so many, and
even if all values believed so far were among them, common words are ruled out before
their edges are counted.  Those of all other patterns are counted over all documents.

All patterns are written so that the regex engine neither backtracks over long runs nor
recurses, and every pass over texts is linear.  Edges are counted before they are
shuffled, so a context that a third of all rows share is one row per task.

Edge cases: a null text is an empty one (no spans, the digest of the empty string);
repeated rows each get their result; ties between kinds go to the kind listed first; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthpick.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
#: The base patterns.  A match starts where a run starts or the match before ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A candidate: a few groups of digits, or what stands between whitespace.
TOKEN = r"[0-9]++(?:\x20[0-9]++){1,5}(?!\S)|\S++"
#: Characters on each side in which the neighbouring word is looked for.
REACH = 48
ROUNDS, MIN_SUPPORT, SMOOTH, MIN_PATTERN, MIN_BELIEF = 2, 5, 2.0, 0.8, 0.9
#: Share of a value's places that have to be in confident patterns, as far as one side of them tells.
MIN_INSIDE = 0.5
#: One of so many documents tells which patterns have too many values to be confident.
PROBE = 16


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        d = _digits(hit)
        return F.length(d).between(16, 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    return F.lit(True)


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind, start, end, value) of the valid matches; offsets are code points."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("value"))
        ok = x["hit"].isNotNull() & _valid(kind, x["hit"])
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    zipped = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    found = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    # an email has an @, and most texts don't
    return F.when(text.contains("@"), found).otherwise(empty) if kind == "email" else found


def _clean(c: Column) -> Column:
    """Lower case, each number masked as one sign."""
    return F.regexp_replace(F.lower(c), "[0-9][0-9\x20]*", "#")


def _around(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The words before and after the whole token or tokens that a span lies in."""
    before = F.substring(text, F.greatest(start - REACH, F.lit(0)) + 1, F.least(start, F.lit(REACH)))
    after = F.substring(text, end + 1, F.lit(REACH))
    return _clean(F.regexp_extract(before, r"(\S++)\s++\S*+$", 1)), _clean(F.regexp_extract(after, r"^\S*+\s++(\S++)", 1))


def base_spans(text: Column) -> Column:
    """All base spans, by kind as listed, then start."""
    return F.concat(*[_spans(text, k, PATTERNS[k]) for k in KINDS])


def find_private_data(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_key, base and all spans (arrays of kind, start, end), both ordered."""
    scratch = Scratch(documents.sparkSession, "private-data")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text")).withColumn("base", base_spans(F.col("text")))

    def with_context(s: Column) -> Column:
        left, right = _around(F.col("text"), s["start"], s["end"])
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), left.alias("left"), right.alias("right"))

    found = scratch.stage(rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.transform("base", with_context).alias("base")))
    beliefs = scratch.stage(_score(found, rows, scratch))
    hits = scratch.stage(_tokens(rows).join(beliefs, "value").select("doc_id", "text_key", "at", "pos", "value", "kind", "inside"))
    # a word that mostly stands elsewhere is no identifier, however sure the patterns are that it was seen in
    usual = hits.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.first("inside").alias("inside")).where(F.col("inside") >= MIN_INSIDE * F.col("n")).select("value")
    held = scratch.stage(hits.join(usual, "value", "left_semi").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("kind", "at", "pos", "value")).alias("hits")))
    again = rows.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    new = (
        again.alias("r").join(held.alias("h"), F.expr("r.doc_id <=> h.doc_id AND r.text_key = h.text_key"))
        .select("r.doc_id", "r.text_key", F.transform("h.hits", lambda h: _placed(F.col("r.text"), h)).alias("more"))
        .dropDuplicates(["doc_id", "text_key"])
    )
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = found.select("doc_id", "text_key", plain.alias("base")).alias("f").join(new.alias("n"), F.expr("f.doc_id <=> n.doc_id AND f.text_key = n.text_key"), "left")
    rank = F.array(*map(F.lit, KINDS))
    both = F.concat(F.col("base"), F.coalesce(F.col("more"), F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    order = lambda a, b: F.when(F.array_position(rank, a["kind"]) != F.array_position(rank, b["kind"]), F.array_position(rank, a["kind"]) - F.array_position(rank, b["kind"])).otherwise(a["start"] - b["start"]).cast("int")
    return out.select("f.doc_id", "f.text_key", "f.base", F.array_sort(both, order).alias("spans"))


def _pieces(text: Column, base: Column) -> Column:
    """The text between base spans: (at, piece, left, right), the last two the words beyond its ends."""
    empty = F.array().cast("array<struct<at:int,piece:string>>")
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"])
    cut = lambda at, end: F.struct(at.alias("at"), F.substring(text, at + 1, end - at).alias("piece"))

    def step(acc: Column, s: Column) -> Column:
        out = F.when(s["start"] > acc["at"], F.concat(acc["out"], F.array(cut(acc["at"], s["start"])))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    walked = F.aggregate(F.array_sort(base, order), F.struct(F.lit(0).alias("at"), empty.alias("out")), step)
    return F.when(F.size(base) == 0, F.array(cut(F.lit(0), F.length(text)))).otherwise(F.concat(walked["out"], F.array(cut(walked["at"], F.length(text)))))


def _tokens(rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, at, pos, value, left, right) of every token that no base span overlaps: token ``pos`` of the piece from ``at`` on."""
    text = F.col("text")

    def with_ends(p: Column) -> Column:
        end = p["at"] + F.length(p["piece"])
        before = F.substring(text, F.greatest(p["at"] - REACH, F.lit(0)) + 1, F.least(p["at"], F.lit(REACH)))
        after = F.substring(text, end + 1, F.lit(REACH))
        return F.struct(
            p["at"].alias("at"), p["piece"].alias("piece"), F.regexp_extract(before, r"(\S++)$", 1).alias("left"), F.regexp_extract(after, r"^(\S++)", 1).alias("right"),
            (p["piece"].rlike(r"^\S") & (p["at"] > 0)).alias("joined_left"), (p["piece"].rlike(r"\S\z") & (end < F.length(text))).alias("joined_right"),
        )

    pieces = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(F.transform(_pieces(text, F.col("base")), with_ends)).alias("p")).select("doc_id", "text_key", "p.*")
    tokens = pieces.withColumn("t", F.regexp_extract_all("piece", F.lit(TOKEN), F.lit(0))).drop("piece").where(F.size("t") > 0)
    n = F.size("t")
    left, right = F.concat(F.array("left"), F.slice("t", 1, n - 1)), F.concat(F.slice("t", 2, n - 1), F.array("right"))
    zipped = F.arrays_zip(F.col("t").alias("value"), left.alias("left"), right.alias("right"))
    # edge: what a base span overlaps
    whole = F.transform(zipped, lambda x, i: F.struct(i.alias("pos"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right"), ((i == 0) & F.col("joined_left") | (i == n - 1) & F.col("joined_right")).alias("edge")))
    out = tokens.select("doc_id", "text_key", "at", F.explode(whole).alias("x")).select("doc_id", "text_key", "at", "x.*").where("NOT edge")
    near_left, near_right = F.substring(F.col("left"), -(REACH - 1), REACH - 1), F.substring(F.col("right"), 1, REACH - 1)
    return out.select("doc_id", "text_key", "at", "pos", "value", _clean(near_left).alias("left"), _clean(near_right).alias("right"))


def _placed(text: Column, h: Column) -> Column:
    """(kind, start, end) of token ``pos`` of the piece from ``at`` on."""
    rest = F.substring(text, h["at"] + 1, F.length(text))
    gaps, tokens = F.split(rest, TOKEN, -1), F.regexp_extract_all(rest, F.lit(TOKEN), F.lit(0))
    start = h["at"] + F.length(F.array_join(F.slice(gaps, 1, h["pos"] + 1), "")) + F.length(F.array_join(F.slice(tokens, 1, h["pos"]), ""))
    return F.struct(h["kind"].alias("kind"), start.alias("start"), (start + F.length(h["value"])).alias("end"))


def _token_edges(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(value, pattern, times) of the tokens in the numbered ``patterns``."""
    tokens = _tokens(rows).select(F.lit("token").alias("kind"), "value", "left", "right")
    return _edges(tokens).join(patterns.select("pattern", "number"), "pattern").groupBy("value", F.col("number").alias("pattern")).agg(F.count(F.lit(1)).alias("times"))


def _edges(one: DataFrame) -> DataFrame:
    """(kind, value, pattern) of every context of a value."""
    patterns = F.array(F.concat(F.lit("L:"), "left"), F.concat(F.lit("R:"), "right"), F.concat(F.lit("B:"), "left", F.lit(" "), "right"))
    return one.select("kind", "value", F.explode(patterns).alias("pattern")).where("NOT (pattern IN ('L:', 'R:', 'B: '))")


def _can_be_sure(believed: dict[str, float]) -> Column:
    """Whether a pattern with the given seeds and at least ``least`` values can be confident for a kind, with all values that are believed."""
    shares = [(F.col(f"n_{k}") + believed[k]) / (F.col("least") + SMOOTH) for k in KINDS]
    # sums of beliefs depend on their order
    return F.coalesce(F.greatest(*[F.when(F.col(f"n_{k}") >= MIN_SUPPORT, x) for k, x in zip(KINDS, shares)]) >= MIN_PATTERN - 1e-6, F.lit(False))


def _score(found: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(value, kind, inside) of the candidates that the scoring rounds believe in; inside is how often they stand in confident patterns."""
    # (value, pattern) edges: each value and pattern once, with the seed's kind
    once = lambda edges: edges.groupBy("kind", "value", "pattern").agg(F.count(F.lit(1)).alias("times"))
    seeds = scratch.stage(once(_edges(found.select(F.explode("base").alias("s")).select("s.kind", "s.value", "s.left", "s.right"))))
    of_kind = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS]
    able = seeds.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *of_kind).where(F.greatest(*[F.col(f"n_{k}") for k in KINDS]) >= MIN_SUPPORT)
    # edges carry a number for a pattern; its remainder by 3 tells the side
    side = F.when(F.col("pattern").startswith("L:"), 0).when(F.col("pattern").startswith("R:"), 1).otherwise(2)
    able = scratch.stage(able.withColumn("number", F.monotonically_increasing_id() * 3 + side))
    some = _token_edges(rows.where(F.pmod(F.xxhash64("text"), F.lit(PROBE)) == 0), able)
    seen = some.groupBy(F.col("pattern").alias("number")).agg(F.count(F.lit(1)).alias("seen"))
    able = scratch.stage(able.join(seen, "number", "left").withColumn("least", F.col("n") + F.coalesce("seen", F.lit(0))).drop("n", "seen"))
    counted, bound, edges = F.lit(False), dict.fromkeys(KINDS, 0.0), None
    believed = None
    for _ in range(ROUNDS):
        if believed is not None:
            sums = {r["kind"]: r["total"] for r in believed.groupBy("kind").agg(F.sum("belief").alias("total")).collect()}  # a row for each kind
            bound = {k: max(v, sums.get(k, 0.0)) for k, v in bound.items()}
        new = able.where(_can_be_sure(bound) & ~counted).select("pattern", "number")
        if edges is None or not new.isEmpty():
            new = scratch.stage(new)
            of_seeds = seeds.join(new, "pattern").select("kind", "value", F.col("number").alias("pattern"), "times")
            more = scratch.stage(of_seeds.unionByName(_token_edges(rows, new).select(F.lit("token").alias("kind"), "value", "pattern", "times")))
            edges = more if edges is None else edges.unionByName(more)
        counted = _can_be_sure(bound)
        belief = F.when(F.col("kind") != "token", 1.0)
        known = edges.withColumn("as", F.when(F.col("kind") != "token", F.col("kind"))).withColumn("belief", belief)
        if believed is not None:
            more = believed.select("value", F.col("kind").alias("as2"), F.col("belief").alias("belief2"))
            known = known.join(more, "value", "left").withColumn("as", F.coalesce("as", "as2")).withColumn("belief", F.coalesce("belief", "belief2"))
        per = [F.sum(F.when(F.col("as") == k, F.col("belief"))).alias(f"b_{k}") for k in KINDS]
        support = [F.sum(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS]
        scored = known.groupBy("pattern").agg(F.count(F.lit(1)).alias("all"), *per, *support)
        options = F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(f"b_{k}") / (F.col("all") + SMOOTH)).alias("confidence"), F.col(f"n_{k}").alias("support")) for k in KINDS])
        sure = scored.select("pattern", F.explode(options).alias("o")).where((F.col("o.support") >= MIN_SUPPORT) & (F.col("o.confidence") >= MIN_PATTERN)).select("pattern", F.col("o.kind").alias("as_kind"), F.col("o.confidence").alias("confidence"))
        sides = [F.sum(F.when(F.col("pattern") % 3 == x, F.col("times"))) for x in range(3)]
        by_value = edges.where("kind = 'token'").join(sure, "pattern").groupBy("value", "as_kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("belief"), F.greatest(*sides).alias("inside"))
        best = by_value.groupBy("value").agg(F.max(F.struct("belief", (-F.array_position(F.array(*map(F.lit, KINDS)), F.col("as_kind"))).alias("first"), F.col("as_kind").alias("kind"), "inside")).alias("b"))
        believed = scratch.stage(best.select("value", "b.kind", "b.belief", "b.inside"))
    return believed.where(F.col("belief") >= MIN_BELIEF).select("value", "kind", "inside")


def redact(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``documents`` with every span replaced by its kind in angle brackets; n_chars follows the new text."""
    held = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"])).alias("_spans")).dropDuplicates(["_id", "_key"])
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.when(s["start"] >= acc["at"], F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise(""))
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    walked = F.aggregate(F.col("_spans"), start, step)
    cleaned = F.concat(walked["out"], F.substring(text, walked["at"] + 1, F.length(text)))
    # the spans grow with the documents: the same join at every size
    joined = documents.join(held.hint("merge"), (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_key")), "left")
    new = F.when(F.col("_spans").isNull(), text).otherwise(cleaned)
    out = joined.withColumn("text", new)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(documents.schema["n_chars"].dataType)))
    return out.select(*documents.columns)
