"""Main text of web pages by equivalence classes of tokens (operator 13).

Tokens are the starts and ends of block elements and the blocks of text, each by its path
of elements (``html_text``).  Over all pages of a host every token has an occurrence
vector, how often it occurs in each page; the vector's fingerprint is a sum (xor) over
pages, so it is one grouped aggregation with partial sums.  Tokens of one host that most
pages have and that share a vector are an equivalence class.  The sum of a token's first
positions orders a class: its tokens occur in the same pages, so a token that comes first
in each page has the lower sum.

Classes that are ordered and nest make the host's template.  Each page is read against it
with a stack of open instances: a class's first token opens an instance, its last closes
it, and a token that doesn't continue the innermost instance breaks the order or the
nesting.  Classes broken on more than a few pages are not valid and leave the template.
What is between two tokens of an instance is a slot.

The text of the remaining slots is the main text, without

* slots that the elements open at them call a menu, header, footer, sidebar, notice,
  advert, form, comments and the like (by element, class, id or role), and slots outside
  the article or main element where there is one,
* outside those, slots whose container's text is mostly links over the host,
* blocks of text that are themselves tokens of the template (the same on nearly all pages
  of a host with enough pages), unless they are most of what is left: then the page is a
  copy and its text stays.

A host's template is bounded by a page: its tokens are on most of the host's pages.  Pages
meet it by (host, one of ``SPREAD`` shares of the host), so a host with a third of all
pages is dealt out; page texts are staged once, and the optimizer sizes the join.

Edge cases: null html is empty and gives an empty text; null or odd urls are one host;
repeated rows are pages of their own; unclosed or crossed elements are closed as browsers
do; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthpick.llm.common import Scratch, blocks, mix
from monthpick.llm.html_text import ARTICLE, MAIN, NAMED, Parser

#: Share of a host's pages that have a template's tokens, and on which a class is ordered and nests.
SUPPORT = 0.8
#: Pages of a host from which on its template is deduced; from which on text alike on them is the template's.
MIN_PAGES = 2
MIN_TEXT_PAGES = 4
#: Tokens of a class at least.
MIN_CLASS = 2
#: Share of a container's text in links from which on it is a list of links.
LINKS = 0.5
#: Shares of a host that are joined apart.
SPREAD = 64
#: Tokens whose occurrences a task adds up before it hands them on.
_FLUSH = 200_000
#: Pages whose texts a task hands on at once.
_ROWS = 256
_PARSED = "page_id bigint, url string, host string, tokens array<bigint>, at array<int>, containers array<bigint>, texts array<string>, links array<int>, body array<tinyint>"
_COUNTS = "host string, token bigint, pages bigint, vector bigint, place bigint, chars bigint, links bigint"


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _lists(offsets: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def parse_pages(pages: DataFrame) -> DataFrame:
    """Tokens and blocks of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = Parser()
        for batch in batches:
            for a, b in blocks(pc.fill_null(pc.binary_length(batch.column(3)), 0).to_pylist()):
                part = batch.slice(a, b - a)
                tokens, token_ends, found, ends = [], [0], [], [0]
                for html in part.column(3).to_pylist():
                    t, x = parse(html or "")
                    tokens.extend(t)
                    found.extend(x)
                    token_ends.append(len(tokens))
                    ends.append(len(found))
                at, paths, texts, links, body = zip(*found) if found else ((),) * 5
                columns = [
                    *part.columns[:3],
                    _lists(token_ends, pa.array(_signed(tokens))),
                    _lists(ends, pa.array(at, pa.int32())),
                    _lists(ends, pa.array(_signed(paths))),
                    _lists(ends, pa.array(texts, pa.string())),
                    _lists(ends, pa.array(links, pa.int32())),
                    _lists(ends, pa.array(body, pa.int8())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _PARSED.split(", ")])

    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(run, _PARSED)


def token_counts(parsed: DataFrame) -> DataFrame:
    """For each host and token: pages, fingerprint of the occurrence vector, sum of first positions, characters and link characters directly in it.

    The token 0 of a host stands for its pages."""

    def totals(codes: dict, parts: list) -> Iterator[pa.RecordBatch]:
        host, token, vector, place, pages, chars, links = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((token, host))
        host, token = host[order], token[order]
        starts = np.flatnonzero(np.r_[True, (host[1:] != host[:-1]) | (token[1:] != token[:-1])])
        names = pa.array(list(codes))
        sums = [np.add.reduceat(x[order], starts) for x in (place, chars, links)]
        arrays = [names.take(pa.array(host[starts])), token[starts], np.add.reduceat(pages[order], starts), np.bitwise_xor.reduceat(vector[order], starts).view(np.int64), *sums]
        table = pa.Table.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in arrays], names=[x.split()[0] for x in _COUNTS.split(", ")])
        yield from table.to_batches(max_chunksize=20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, parts, size = {}, [], 0
        for batch in batches:
            hosts, pages = batch.column(0).to_pylist(), batch.column(1).to_numpy().view(np.uint64)
            tokens, containers, lengths, links = batch.column(2), batch.column(3), batch.column(4), batch.column(5)
            for i, host in enumerate(hosts):
                code = codes.setdefault(host, len(codes))
                t = tokens[i].values.to_numpy(zero_copy_only=False)
                unique, first, n = np.unique(t, return_index=True, return_counts=True)
                page = mix(np.array([pages[i]], np.uint64), 5)
                vector = mix(page ^ mix(n.astype(np.uint64), 3))
                # text directly in containers; a container is one of the tokens
                c, where = np.unique(containers[i].values.to_numpy(zero_copy_only=False), return_inverse=True)
                chars, linked = np.zeros((2, len(unique)), np.int64)
                if len(c):
                    known = np.searchsorted(unique, c)
                    known = np.where(unique[np.minimum(known, len(unique) - 1)] == c, known, -1)
                    for out, x in ((chars, lengths), (linked, links)):
                        total = np.bincount(where.ravel(), x[i].values.to_numpy(zero_copy_only=False), len(c)).astype(np.int64)
                        out[known[known >= 0]] = total[known >= 0]
                one = np.zeros(1, np.int64)
                parts.append((np.full(len(unique) + 1, code), np.r_[unique, one], np.r_[vector, page], np.r_[first, one], np.ones(len(unique) + 1, np.int64), np.r_[chars, one], np.r_[linked, one]))
                size += len(unique) + 1
                if size >= _FLUSH:
                    yield from totals(codes, parts)
                    codes, parts, size = {}, [], 0
        if parts:
            yield from totals(codes, parts)

    lengths = F.transform("texts", lambda x: F.length(x))
    rows = parsed.select("host", "page", "tokens", "containers", lengths.alias("lengths"), "links").mapInArrow(run, _COUNTS)
    return rows.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.expr("bit_xor(vector)").alias("vector"), F.sum("place").alias("place"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))


def equivalence_classes(counts: DataFrame) -> DataFrame:
    """host, pages, classes: array of (token, vector, place, text share in links) of tokens that most pages have and that share their vector with others."""
    hosts = counts.where("token = 0").select("host", F.col("pages").alias("n"))
    hosts = hosts.where(F.col("n") >= MIN_PAGES)
    share = F.pmod("token", F.lit(SPREAD)).cast("int")
    often = counts.where((F.col("token") != 0) & (F.col("pages") >= MIN_PAGES)).withColumn("share", share)
    dealt = hosts.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    most = often.join(dealt, ["host", "share"]).where(F.col("pages") >= SUPPORT * F.col("n"))
    ratio = F.when(F.col("chars") > 0, F.col("links") / F.col("chars")).otherwise(F.lit(0.0))
    token = F.struct("token", "vector", "place", ratio.alias("links"))
    return most.groupBy("host").agg(F.max("n").alias("pages"), F.array_sort(F.collect_list(token)).alias("classes"))


class Template:
    """The tokens of a host's valid classes, with the sweep over a page."""

    def __init__(self, pages: int, tokens: list[dict], broken: set[int]):
        self.pages = pages
        groups: dict[int, list[dict]] = {}
        for t in tokens:
            groups.setdefault(t["vector"], []).append(t)
        self.links = {t["token"]: t["links"] for t in tokens}
        #: token -> class, ordinal, size of the class
        self.where: dict[int, tuple[int, int, int]] = {}
        for vector, group in groups.items():
            if len(group) < MIN_CLASS or vector in broken:
                continue
            for k, t in enumerate(sorted(group, key=lambda t: (t["place"], t["token"]))):
                self.where[t["token"]] = (vector, k, len(group))

    def broken(self, tokens: list[int]) -> set[int]:
        """Classes whose tokens are out of order on a page, or cross a larger class."""
        out: set[int] = set()
        open_: list[list[int]] = []  # class, ordinal, size
        for t in tokens:
            place = self.where.get(t)
            if place is None or place[0] in out:
                continue
            vector, k, size = place
            if k == 0:
                open_.append([vector, 0, size])
                continue
            at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == vector), None)
            if at is None or open_[at][1] != k - 1:
                out.add(vector)
                open_ = [o for o in open_ if o[0] != vector]
                continue
            crossing = open_[at + 1 :]
            if any(o[2] > size for o in crossing):
                out.add(vector)
                open_ = [o for o in open_ if o[0] != vector]
                continue
            for o in crossing:
                out.add(o[0])
            del open_[at + 1 :]
            open_ = [o for o in open_ if o[0] not in out]
            at = next(i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == vector)
            open_[at][1] = k
            if k == size - 1:
                del open_[at]
        out.update(o[0] for o in open_)
        return out

    def is_text(self, token: int) -> bool:
        return self.pages >= MIN_TEXT_PAGES and token in self.where


NOTHING = Template(0, [], set())


def main_blocks(template: Template, tokens: list[int], at: list[int], containers: list[int], texts: list[str], links: list[int], body: list[int]) -> list[str]:
    """Blocks of the main text of a page, read against its host's template."""
    live = [i for i in range(len(texts)) if body[i] >= 0]
    sure = max((body[i] for i in live), default=0)
    inside = sure if sure in (ARTICLE, MAIN) else 0
    live = [i for i in live if body[i] >= inside]
    if not inside:
        own: dict[int, list[int]] = {}
        for i in live:
            x = own.setdefault(containers[i], [0, 0])
            x[0] += len(texts[i])
            x[1] += links[i]
        share = lambda c: template.links.get(c, own[c][1] / own[c][0])
        live = [i for i in live if share(containers[i]) < LINKS]
        if sure == NAMED:
            named = [i for i in live if body[i] == NAMED]
            # what is named so is the article if it has most of the text
            if 2 * sum(len(texts[i]) for i in named) > sum(len(texts[i]) for i in live):
                live = named
    slots = [i for i in live if not template.is_text(tokens[at[i]])]
    if 2 * sum(len(texts[i]) for i in slots) >= sum(len(texts[i]) for i in live):
        live = slots
    return [texts[i] for i in live]


def _with_template(parsed: DataFrame, templates: DataFrame, columns: list[str]) -> DataFrame:
    """Pages with their host's template, by shares of a host."""
    return parsed.join(templates, ["host", "share"], "left").select(*columns, F.col("pages"), F.col("classes"), F.col("broken"))


def _templates(batch: pa.RecordBatch, names: tuple[str, ...], memo: dict) -> Iterator[tuple[Template, list]]:
    """Rows as (template of the host, values of ``names``)."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    hosts, pages = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("host", "pages"))
    classes, broken = (batch.column(batch.schema.get_field_index(n)) for n in ("classes", "broken"))
    for i, (host, n) in enumerate(zip(hosts, pages)):
        if n is None:
            template = NOTHING
        elif host in memo:
            template = memo[host]
        else:
            if len(memo) >= 200:
                memo.clear()
            template = memo[host] = Template(n, classes[i].as_py(), set(broken[i].as_py() or ()))
        yield template, [c[i].as_py() for c in columns]


def broken_classes(parsed: DataFrame, templates: DataFrame) -> DataFrame:
    """host, broken: classes that are out of order or don't nest on more pages than SUPPORT leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, Template] = {}
        for batch in batches:
            rows: dict[tuple[str, int], int] = {}
            hosts = batch.column(0).to_pylist()
            for host, (template, (tokens,)) in zip(hosts, _templates(batch, ("tokens",), memo)):
                for vector in template.broken(tokens):
                    rows[host, vector] = rows.get((host, vector), 0) + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows]), pa.array([v for _, v in rows], pa.int64()), pa.array(list(rows.values()), pa.int64())], names=["host", "vector", "n"])

    seen = _with_template(parsed, templates, ["host", "tokens"]).mapInArrow(run, "host string, vector bigint, n bigint")
    return seen.groupBy("host", "vector").agg(F.sum("n").alias("n"))


def extract_text(pages: DataFrame) -> DataFrame:
    """Every row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    scratch = Scratch(pages.sparkSession, "html-extract")
    parsed = scratch.stage(parse_pages(pages).withColumn("page", F.monotonically_increasing_id()))
    parsed = parsed.withColumn("share", F.pmod(F.xxhash64("page"), F.lit(SPREAD)).cast("int"))
    classes = scratch.stage(equivalence_classes(token_counts(parsed)))
    shares = parsed.select("host", "share").distinct()
    none = F.lit(None).cast("array<bigint>")
    first = scratch.stage(shares.join(classes.withColumn("broken", none), "host"))
    bad = scratch.stage(broken_classes(parsed, first))
    limit = 1 - SUPPORT
    bad = bad.join(classes.select("host", "pages"), "host").where(F.col("n") > limit * F.col("pages")).groupBy("host").agg(F.collect_list("vector").alias("broken"))
    valid = scratch.stage(first.drop("broken").join(bad, "host", "left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, Template] = {}
        names = ("page_id", "url", "tokens", "at", "containers", "texts", "links", "body")
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                rows = [(page_id, url, "\n".join(main_blocks(template, *page))) for template, (page_id, url, *page) in _templates(batch.slice(a, _ROWS), names, memo)]
                ids, urls, texts = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = _with_template(parsed, valid, ["page_id", "url", "host", "tokens", "at", "containers", "texts", "links", "body"])
    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
