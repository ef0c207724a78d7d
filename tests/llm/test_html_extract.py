"""Main text extraction: planted pages of several makes, brute-force classes, odd pages."""

from __future__ import annotations

import html as H
import random
import re
from collections import Counter, defaultdict

import pytest

from monthpick.llm import html_extract as hx
from monthpick.llm.common import table
from monthpick.llm.html_text import Parser
from monthpick.llm.queries import op13_html_extract


def words(r, n):
    return " ".join(r.choice(["river", "stone", "übung", "café", "lantern", "4.5", "R&D", "moss", "a<b", "quiet"]) for _ in range(n)) + "."


@pytest.fixture
def frame(spark):
    def make(rows):
        return spark.createDataFrame([(i, u, h, "x", 1, "y") for i, u, h in rows], "page_id bigint, url string, html string, host string, n bigint, text string")

    return make


def got(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


def site_article(r, i):
    """Semantic elements, varying menus and adverts."""
    title, paras = words(r, 5), [words(r, r.randint(1, 40)) for _ in range(r.randint(1, 9))]
    menu = "".join(f"<li><a href='/{k}'>{H.escape(words(r, 2))}</a>" for k in range(r.randint(2, 6)))
    page = f"""<!doctype html><html><head><title>{H.escape(title)}</title><script>if (a < b) {{ x = "<p>no</p>" }}</script><style>p > b {{}}</style></head>
    <body class="has-sidebar"><header><div>Site {H.escape(words(r, 2))}</div></header><nav><ul>{menu}</ul></nav><!-- <p>off</p> -->
    <main><article class="post post-{i}"><header class="article-header"><h1>{H.escape(title)}</h1></header><div class="ad">{H.escape(words(r, 9))}</div>
    {"".join(f"<p>{H.escape(p)}" for p in paras)}<aside>{H.escape(words(r, 30))}</aside><form action=x><label>Name</label><input><button>Send</button></form><footer>Tags</footer></article>
    <section id=comments><article class="comment"><p>{H.escape(words(r, 60))}</p></article></section></main><footer>&copy; {H.escape(words(r, 3))}</footer></body></html>"""
    return page, [title, *paras]


def site_divs(r, i):
    """Nothing but div and table, with classes that say nothing; menus of links, texts alike on all pages, lists in the text."""
    title, paras, items = words(r, 6), [words(r, r.randint(20, 50)) for _ in range(r.randint(2, 5))], [words(r, 4) for _ in range(3)]
    links = "".join(f"<div class=k><a href=/{k}>{H.escape(words(r, 3))}</a></div>" for k in range(r.randint(3, 9)))
    page = f"""<html><body><div class=q1>Our Site &mdash; all the news</div><div class=q2>{links}</div><table><tr><td class=q3><h2>{H.escape(title)}</h2>
    {"".join(f"<div class=t>{H.escape(p)}<br/>and <b>more</b> <a href=x>here</a></div>" for p in paras)}<ul>{"".join(f"<li>{H.escape(x)}" for x in items)}</ul></table>
    <div class=cookie-consent>We use cookies. <b>{H.escape(words(r, 4))}</b></div><div class=q4>All rights reserved by the owners of this site</div></body></html>"""
    return page, [title, *[f"{p} and more here" for p in paras], *items]


@pytest.mark.parametrize("site", [site_article, site_divs])
@pytest.mark.parametrize("n", [1, 2, 12])
def test_planted_sites(frame, site, n):
    r = random.Random(n)
    pages = [site(r, i) for i in range(n)]
    found = got(hx.extract_text(frame([(i, f"https://u@Www.Site{n}.example:80/{i}", p) for i, (p, _) in enumerate(pages)])))
    for i, (_, want) in enumerate(pages):
        text = "\n".join(" ".join(w.split()) for w in want)
        if site is site_divs and n < hx.MIN_TEXT_PAGES:  # too few pages to know what all of them say
            assert text in found[i]
        else:
            assert found[i] == text


def test_whole_query(spark, sf):
    """The pages' own make: blocks of the article, read by pattern."""
    source = {r["page_id"]: r["html"] for r in table(spark, sf, "pages").collect()}
    rows = op13_html_extract(spark, sf).collect()
    assert len(rows) == len(source)
    for r in rows:
        article = source[r["page_id"]].split("<article>")[1].split("</article>")[0]
        parts = (" ".join(H.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article))
        want = "\n".join(p for p in parts if p)
        assert (r["text"], r["n_chars"]) == (want, len(want))


def test_classes_against_occurrence_vectors(spark, frame):
    r = random.Random(3)
    pages = [(i, "http://a.example/", site_divs(r, i)[0]) for i in range(7)] + [(10 + i, "http://b.example/", site_article(r, i)[0]) for i in range(5)]
    parsed = hx.parse_pages(frame(pages)).selectExpr("*", "page_id AS page").cache()
    vectors = defaultdict(lambda: defaultdict(list))
    for i, u, h in pages:
        for token, n in Counter(Parser()(h)[0]).items():
            vectors[u[7:16]][token].append((i, n))
    want = defaultdict(set)
    for host, tokens in vectors.items():
        n, groups = 7 if host == "a.example" else 5, defaultdict(set)
        for t, v in tokens.items():
            if len(v) >= 0.8 * n:
                groups[tuple(sorted(v))].add(t if t < 2**63 else t - 2**64)
        want[host] = set(map(frozenset, groups.values()))
    for row in hx.equivalence_classes(hx.token_counts(parsed)).collect():
        groups = defaultdict(set)
        for t in row["classes"]:
            groups[t["vector"]].add(t["token"])
        assert set(map(frozenset, groups.values())) == want[row["host"]]
        assert row["pages"] == (7 if row["host"] == "a.example" else 5)


def template(*groups):
    return hx.Template(9, [{"token": t, "vector": v, "place": k, "links": 0.0} for v, g in enumerate(groups) for k, t in enumerate(g)], set())


@pytest.mark.parametrize(
    "tokens, broken",
    [
        ([1, 2, 3], set()),
        ([1, 8, 9, 8, 9, 2, 7, 3], set()),  # repeats of a class within a slot
        ([8, 1, 2, 3, 9], set()),  # a larger class within a slot of a smaller
        ([1, 3, 2], {0}),
        ([1, 8, 2, 9, 3], {1}),  # crossed: the smaller goes
        ([8, 1, 9, 2, 3], {1}),
        ([1, 2], {0}),
        ([5], set()),
    ],
)
def test_order_and_nesting(tokens, broken):
    assert template([1, 2, 3], [8, 9]).broken(tokens) == broken


def test_copies_keep_their_text(frame):
    r = random.Random(8)
    page, want = site_divs(r, 0)
    other, theirs = site_divs(r, 1)
    found = got(hx.extract_text(frame([(i, "http://c.example", page) for i in range(9)] + [(9, "http://c.example", other)])))
    for i in range(9):
        assert all(" ".join(w.split()) in found[i] for w in want)
    assert found[9] == "\n".join(" ".join(w.split()) for w in theirs)


def test_broken_markup(frame):
    pages = {
        1: ("<article><p><b>One.<br><p>Two</b> <i>three<p>four</article><p>after", "One.\nTwo three\nfour"),
        2: ("a &lt;b&gt; &amp;amp; &#233;&nbsp;x < 3 <3 </ p> <?php echo ?> b", "a <b> &amp; é x < 3 <3 b"),
        3: ("<p>x<script>document.write('</p>')", "x"),
        4: ("<p title='a>b' class=\"q>r\">in</p><!-- open <p>gone", "in"),
        5: ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><th>3</table>", "a\nb\nc\nd\n1\n2\n3"),
        6: ("plain text,\n\t only", "plain text, only"),
        7: ("<form><main><p>kept</p></main><p>field</p></form>", "kept"),
        8: ("<p>one<span class='ad'>BUY</span> two<textarea><p>x</textarea> three</p>", "one two\nthree"),
        9: ("<nav>only <a>menus</a></nav>", ""),
        10: (None, ""),
        11: ("", ""),
        12: ("<ARTICLE><H1>Caps</H1><P CLASS=Intro>Lead</P></ARTICLE>", "Caps\nLead"),
        13: ("<div class=post><h1>T</h1><p>text</p><div class='post-comments'><p>no</p></div></div>", "T\ntext"),
        14: ("<pre>a\n  b</pre><blockquote>q<p>r</blockquote><figure><img alt=no><figcaption>cap</figcaption></figure>", "a b\nq\nr\ncap"),
    }
    found = got(hx.extract_text(frame([(i, f"http://h{i}.example", h) for i, (h, _) in pages.items()])))
    assert found == {i: text for i, (_, text) in pages.items()}


def test_odd_rows(frame, spark):
    assert hx.extract_text(frame([])).count() == 0
    long = "<article>" + "".join(f"<p>word{i} &amp; {i}</p>" for i in range(60_000)) + "</article>"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, long), (1, None, long), (None, "::", deep), (3, None, None), (3, "", "<p>again</p>"), (3, "", "<p>again</p>")]
    out = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in hx.extract_text(frame(rows)).collect()), key=repr)
    whole = "\n".join(f"word{i} & {i}" for i in range(60_000))
    assert out == sorted([(1, None, whole, len(whole))] * 2 + [(None, "::", "deep", 4), (3, None, "", 0), (3, "", "again", 5), (3, "", "again", 5)], key=repr)
