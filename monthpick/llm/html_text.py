"""HTML as tokens with paths and blocks of text, for one page (helper of operator 13)."""

from __future__ import annotations

import re
from html import unescape

import xxhash

from monthpick.llm.common import Memo

_TAG = re.compile(r"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>|<[!?/][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Elements whose content is not markup, up to their end tag.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block of text where they start and end.
BLOCK = frozenset(
    "html head body title article section main nav aside header footer hgroup address h1 h2 h3 h4 h5 h6 p div blockquote pre center "
    "ul ol li dl dt dd menu table caption thead tbody tfoot tr td th colgroup figure figcaption form fieldset legend details summary "
    "dialog template select option optgroup textarea button script style noscript iframe hr object svg math canvas audio video".split()
)
#: Elements that end an open paragraph where they start.
_ENDS_P = BLOCK - frozenset("html head body title td th tr thead tbody tfoot caption colgroup li dt dd option optgroup legend summary script style noscript iframe template button select textarea object svg math canvas audio video figcaption".split())
#: What a start tag ends of its own kind, and the elements beyond which it doesn't look.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"})}
#: Elements whose text is never an article's.
NOISE = frozenset("head title script style noscript template iframe nav footer aside form select option textarea button dialog menu object svg math canvas audio video noembed noframes xmp".split())
#: Words of a class, id or role that say the same of other elements.
CUES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside complementary ad ads adv advert adverts advertisement advertising adsense "
    "banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup modal overlay "
    "share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond footer contentinfo masthead topbar toolbar "
    "widget widgets pagination pager skip search searchform form dialog copyright legal".split()
)
_NOT = frozenset("with without has no non is".split())
#: How surely an element is the article: an article, the main part, or something named so.
NAMED, MAIN, ARTICLE = 1, 2, 3
_BODY_NAMES = frozenset("article articlebody post posts entry story content main".split())
_END = 0x5851F42D4C957F2D
_FORM, _NOISE = 1, 2


def _signature(tag: str, attributes: str) -> tuple[str, bool, int, bool]:
    """Name for paths, whether it is noise, how surely it is the article, whether it is a page header."""
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    names = [t for k in ("class", "id", "role") for t in found.get(k, "").split()]
    words = [[w.lower() for w in _WORD.findall(n)] for n in names]
    words = [w for w in words if w and not _NOT & set(w)]
    noise = tag in NOISE
    if tag == "article":  # an article's own names count only whole
        noise = any(len(w) == 1 and w[0] in CUES for w in words)
    elif tag not in ("html", "body", "main"):
        noise = noise or any(w[0] in CUES or w[-1] in CUES for w in words)
    role = found.get("role", "").lower()
    body = ARTICLE if tag == "article" or role == "article" or found.get("itemprop", "").lower() == "articlebody" else MAIN if tag == "main" or role == "main" else 0
    if not body and tag in ("div", "section", "td") and any(w[0] in _BODY_NAMES or w[-1] in _BODY_NAMES for w in words):
        body = NAMED
    header = tag == "header" or any(w[-1] == "header" for w in words)
    return re.sub("[0-9]+", "#", " ".join([tag, *sorted(names)])), noise, body, header


class Parser:
    """Pages to tokens and blocks.  Memos are bounded and shared by the pages of a task.

    A token is a block element's start or end, by the path of block elements to it, or a
    block's text, by its path.  Inline elements belong to the text.
    """

    def __init__(self):
        self.signature = Memo(lambda key: _signature(*key))
        self.path = Memo(lambda key: xxhash.xxh3_64_intdigest(f"{key[0]} {key[1]}".encode()))

    def __call__(self, html: str) -> tuple[list[int], list[tuple[int, int, str, int, int]]]:
        """Tokens, and for each block: index of its token, path, text, characters in links, sureness of the article (-1: noise)."""
        tokens: list[int] = []
        blocks: list[tuple[int, int, str, int, int]] = []
        # open elements: tag, is a block, path, noise, sureness, is a link
        stack: list[tuple[str, bool, int, int, int, bool]] = [("", True, 0, 0, 0, False)]
        text: list[str] = []
        linked: list[str] = []
        at, end = 0, len(html)
        lower = None

        def close_block():
            if text:
                whole = " ".join(unescape("".join(text)).split())
                if whole:
                    _, _, path, noise, body, _ = next(e for e in reversed(stack) if e[1])
                    links = len(" ".join(unescape("".join(linked)).split())) if linked else 0
                    blocks.append((len(tokens), path, whole, links, -1 if noise else body))
                    tokens.append(xxhash.xxh3_64_intdigest(whole.encode("utf-8", "surrogatepass"), seed=path & 0x7FFFFFFFFFFFFFFF))
                text.clear()
                linked.clear()

        def add(piece: str):
            entry = stack[-1]
            if not entry[1] and entry[3] and not next(e for e in reversed(stack) if e[1])[3]:
                return  # an inline advert within a text
            text.append(piece)
            if entry[5]:
                linked.append(piece)

        def pop_to(index: int):
            if any(e[1] for e in stack[index:]):
                close_block()
            while len(stack) > index:
                entry = stack.pop()
                if entry[1]:
                    tokens.append(entry[2] ^ _END)

        while at < end:
            m = _TAG.search(html, at)
            if m is None:
                add(html[at:])
                break
            if m.start() > at:
                add(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "br":
                    add(" ")
                    continue
                block = tag in BLOCK
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        pop_to(i)
                        break
                    if stack[i][1] and not block:  # an inline element's end doesn't end blocks
                        break
                continue
            if tag == "br" or tag == "wbr":
                add(" " if tag == "br" else "")
                continue
            name, noise, body, header = self.signature[tag, m[3]] if len(m[3]) < 400 else _signature(tag, m[3])
            block = tag in BLOCK
            if block:
                close_block()
                if tag in _ENDS_P:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == "p":
                            pop_to(i)
                            break
                        if stack[i][1]:
                            break
                if tag in _SIBLINGS:
                    kind, beyond = _SIBLINGS[tag]
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] in kind:
                            pop_to(i)
                            break
                        if stack[i][0] in beyond:
                            break
            above = stack[-1]
            path = self.path[above[2], name] if block else above[2]
            sure = max(above[4], body)
            # a page's header is noise, an article's holds its headline
            own = (_FORM if tag == "form" else _NOISE) if noise or (header and not sure and tag not in ("html", "body")) else 0
            # a form around an article doesn't hide it
            inherited = 0 if body >= MAIN and above[3] == _FORM else above[3]
            if block:
                tokens.append(path)
            if tag in VOID or (m[3].endswith("/") and tag in ("svg", "math")):
                if block:
                    tokens.append(path ^ _END)
                continue
            stack.append((tag, block, path, max(own, inherited), sure, above[5] or tag == "a"))
            if tag in RAW:
                lower = html.lower() if lower is None else lower
                close = lower.find("</" + tag, at) if len(lower) == end else html.find("</" + tag, at)
                close = end if close < 0 else close
                if not stack[-1][3]:
                    add(html[at:close])
                at = close
        pop_to(1)
        close_block()
        return tokens, blocks
