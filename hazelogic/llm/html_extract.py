"""Main-text extraction: a linear-chain CRF over the leaf blocks of a page.

A tolerant scanner builds a page's elements and cuts it into leaf blocks: runs
of text between tags that begin or end a block. Features of a block's ancestors
(their names and the words of their class, id and role) and of its text feed a
conditional random field of two labels, boilerplate and content. Words of
ancestors count by where they stand, on the two innermost elements or further
out, and not at all on the page's frame, the elements around its core (`main`,
the longest `article`, or else what holds most of the text): what a frame is
called says little about a paragraph. The field is trained in numpy on
labelled pages and decoded by Viterbi. The pages come from `labelled_pages`,
which lays out articles with and without furniture and wrappers in many
templates, so their labels are exact.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- blocks

_TAG = re.compile(r"<(?:!--(?:.*?-->|.*)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|[!?][^>]*(?:>|$)|/(?P<end>[a-zA-Z][^\s>/]*)[^>]*(?:>|$)|(?P<tag>[a-zA-Z][^\s>/]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<self>/?)(?:>|$))", re.S)
#: The same where quotes don't match: a tag then ends at the next `>`.
_LOOSE = re.compile(r"<(?P<tag>[a-zA-Z][^\s>/]*)(?P<attrs>[^>]*)(?:>|$)")
_ATTR = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
#: Elements that run to their own end tag, or to the end of the page.
RAW = frozenset("script style textarea iframe noembed noframes xmp".split())
#: Elements whose content no reader sees; they end with an ancestor at the latest.
UNSEEN = frozenset("template svg select canvas audio video noscript datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark math mi mn mo mrow msub msup object q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_P_ENDERS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An opening tag of the key ends the open ones of the value, as far as the next container.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table div article section main body html td th aside nav form".split())


class Block:
    """A leaf block: its text, its share of linked characters, and its element's number in the page."""

    __slots__ = ("text", "linked", "at")

    def __init__(self, text: str, linked: float, at: int):
        self.text, self.linked, self.at = text, linked, at


class Page:
    """The elements of a page, each with its parent's number, name and words of class, id and role.

    Element 0 stands for the page. Parents come before their children, so one
    pass over the lists reaches all ancestors: nothing is kept by block and
    ancestor, and deep pages take memory in proportion to their tags.
    """

    def __init__(self, html: str | None):
        self.parent, self.name, self.marks = [0], [""], [()]
        self.blocks: list[Block] = []
        self._scan(html or "")

    def _scan(self, html: str) -> None:
        stack, open_ = [0], Counter()
        text: list[str] = []
        linked, link, hidden = 0, 0, 0  # link, hidden: the depth at which one began, or 0
        at, size = 0, len(html)

        def flush() -> None:
            nonlocal linked
            if text:
                got = " ".join("".join(text).split())
                if got:
                    self.blocks.append(Block(got, min(1.0, linked / len(got)), stack[-1]))
                text.clear()
            linked = 0

        def put(piece: str, plain: bool = True) -> None:
            nonlocal linked
            if piece and not hidden:
                piece = unescape(piece) if plain else piece
                text.append(piece)
                if link:
                    linked += len(piece)

        def close(to: int) -> None:
            nonlocal link, hidden
            for k in stack[to:]:
                open_[self.name[k]] -= 1
            del stack[to:]
            link, hidden = link if link <= to else 0, hidden if hidden <= to - 1 else 0

        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                put(html[at:])
                break
            put(html[at:lt])
            m = _TAG.match(html, lt) or _LOOSE.match(html, lt)
            if not m:
                put("<")
                at = lt + 1
                continue
            at = m.end()
            got = m.groupdict()
            if got.get("cdata"):
                put(got["cdata"], plain=False)
            elif got.get("end"):
                name = got["end"].lower()
                if name in INLINE:
                    link = 0 if name == "a" else link
                    if name == "br":
                        put(" ")
                    continue
                flush()
                if open_[name] > 0:
                    to = len(stack) - 1
                    while to and self.name[stack[to]] != name and self.name[stack[to]] not in ("body", "html"):
                        to -= 1
                    if self.name[stack[to]] == name:
                        close(to)
            elif got.get("tag"):
                name, attrs = got["tag"].lower(), got["attrs"]
                if name in INLINE:
                    if name == "br":
                        put(" ")
                    elif name == "a":
                        link = len(stack) if "href" in attrs.lower() else 0
                    continue
                if name in RAW:
                    flush()
                    if not got.get("self") or name in ("script", "style"):
                        end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                        at = end.end() if end else size
                    continue
                flush()
                shut = _CLOSES.get(name, ()) or ({"p"} if name in _P_ENDERS else ())
                if any(open_[x] > 0 for x in shut):
                    for to in range(len(stack) - 1, 0, -1):
                        if self.name[stack[to]] in shut:
                            close(to)
                            break
                        if self.name[stack[to]] in _SCOPE and name != "tr":
                            break
                if name not in VOID and not got.get("self"):
                    words, unseen = _marks(attrs) if attrs else ((), False)
                    self.parent.append(stack[-1])
                    self.name.append(name)
                    self.marks.append(words)
                    stack.append(len(self.name) - 1)
                    open_[name] += 1
                    if (unseen or name in UNSEEN) and not hidden:
                        hidden = len(stack) - 1
        flush()


def _marks(attrs: str) -> tuple[tuple[str, ...], bool]:
    """Words of class, id and role; and whether the element is hidden."""
    out: list[str] = []
    hidden = bool(re.search(r"(?:^|\s)hidden(?:\s|/|$|=)", attrs))
    for k, *v in _ATTR.findall(attrs):
        k, v = k.lower(), next((x for x in v if x), "")
        if k in ("class", "id", "role", "itemprop", "aria-label"):
            out += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower())
        elif k == "style" and re.search(r"display\s*:\s*none", v):
            hidden = True
    return tuple(out), hidden


# ---------------------------------------------------------------- features

_TAGS = "article main section nav header footer aside form head title h1 h2 h3 h4 h5 h6 p li ul ol dl dd dt table td th tr blockquote pre figure figcaption label button legend fieldset address details summary caption dialog menu div".split()
#: Words of class, id and role, by what they speak for.
_HINTS = {
    "ad": "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion",
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination toc tabs topbar sitemap skip",
    "head": "header masthead top branding logo hero",
    "foot": "footer foot bottom copyright legal colophon imprint",
    "side": "sidebar side aside rail related recommended more popular trending widget widgets tags complementary",
    "note": "cookie cookies consent notice notices gdpr alert popup modal overlay subscribe newsletter paywall toast",
    "talk": "comment comments commentlist reply replies respond disqus discussion thread feedback reviews",
    "share": "share sharing social follow buttons toolbar tools meta byline print",
    "form": "form search login signin signup register input field",
    "hide": "hidden invisible sr offscreen",
    "body": "content article post entry story body main text articlebody maincontent prose page",
}
_HINT_OF = {w: h for h, ws in _HINTS.items() for w in ws.split()}
_STRONG = frozenset("ad nav foot side note talk share form hide".split())
_WHERE = ("own", "inner")
_NAMES = ["bias", "first", "last", "only", *(f"in:{t}" for t in _TAGS), *(f"is:{t}" for t in _TAGS), *(f"{w}:{h}" for w in _WHERE for h in (*_HINTS, "any")), "len<3", "len<10", "len<30", "len>=30", "link>0", "link>.3", "link>.7", "ends.", "comma", "bar", "copy", "upper", "digits", "in core", "after core", "before core", "core article", "core main", "core none", "bare", "after h1", "no article yet"]
_INDEX = {n: i for i, n in enumerate(_NAMES)}
_TAG_BIT = {t: 1 << i for i, t in enumerate(_TAGS)}
_HINT_BIT = {h: 1 << i for i, h in enumerate(_HINTS)}
_STRONG_BITS = sum(_HINT_BIT[h] for h in _STRONG)
#: Names of the tags and hints of a mask.
_names = lru_cache(maxsize=4096)(lambda kind, mask: tuple(x for x, bit in (_TAG_BIT if kind == "tag" else _HINT_BIT).items() if mask & bit))
#: An element with this share of a page's text is a candidate for its core.
_MOST = 0.6


def _core(page: Page, sizes: list[int], hints: list[int]) -> int:
    """The element around the main text: `main`, the longest article, or the innermost with most of the text."""
    best, chosen = -1, 0
    inside = [False] * len(page.name)  # a reader's comments: an article in a list, or below such words
    for k in range(1, len(page.name)):
        up = page.parent[k]
        inside[k] = inside[up] or page.name[up] in ("li", "aside", "footer", "nav") or bool(hints[k] & _HINT_BIT["talk"]) and page.name[k] not in ("body", "html")
        if page.name[k] == "article":
            worth = (not inside[k], sizes[k])
            if best < 0 or worth > best_worth:  # noqa: F821
                best, best_worth = k, worth
    main = next((k for k in range(1, len(page.name)) if page.name[k] == "main" or "role" and page.marks[k][:1] == ("main",) and page.name[k] == "div"), 0)
    if best >= 0 and (not main or sizes[best] * 4 >= sizes[main]):
        return best
    if main:
        return main
    for k in range(1, len(page.name)):  # the innermost comes last
        if sizes[k] >= _MOST * sizes[0] and page.name[k] not in ("html", "body", "p", "li", "td"):
            chosen = k
    return chosen


def features(page: Page) -> np.ndarray:
    """One row of 0/1 features for each block."""
    n, found = len(page.name), page.blocks
    sizes = [0] * n
    for b in found:
        sizes[b.at] += len(b.text)
    for k in range(n - 1, 0, -1):
        sizes[page.parent[k]] += sizes[k]
    hints = [0] * n
    for k, ws in enumerate(page.marks):
        for w in ws:
            if w in _HINT_OF:
                hints[k] |= _HINT_BIT[_HINT_OF[w]]
    core = _core(page, sizes, hints)
    frame, k = {0, core}, core
    while k:
        k = page.parent[k]
        frame.add(k)
    tags, inner, within = [0] * n, [0] * n, [False] * n
    for k in range(1, n):
        up = page.parent[k]
        tags[k] = tags[up] | _TAG_BIT.get(page.name[k], 0)
        inner[k] = inner[up] | (0 if k in frame or page.name[k] in ("html", "body") else hints[k])
        within[k] = within[up] or k == core
    kind = {"article": "core article", "main": "core main"}.get(page.name[core], "core none" if not core else "core main" if "main" in page.marks[core] else "")
    x = np.zeros((len(found), len(_NAMES)), np.float32)
    heading = any(page.name[b.at] == "h1" for b in found)
    seen = passed = False
    for i, b in enumerate(found):
        on, k = ["bias"], b.at
        on += [f"in:{t}" for t in _names("tag", tags[k])]
        if page.name[k] in _TAG_BIT:
            on.append(f"is:{page.name[k]}")
        own = 0 if k in frame else hints[k] | (0 if page.parent[k] in frame else hints[page.parent[k]])
        for where, mask in zip(_WHERE, (own, inner[k]), strict=True):
            on += [f"{where}:{h}" for h in _names("hint", mask)] + [f"{where}:any"] * bool(mask & _STRONG_BITS)
        words = len(b.text.split())
        on.append("len<3" if words < 3 else "len<10" if words < 10 else "len<30" if words < 30 else "len>=30")
        on += ["link>0"] * (b.linked > 0) + ["link>.3"] * (b.linked > 0.3) + ["link>.7"] * (b.linked > 0.7)
        on += ["ends."] * (b.text[-1] in ".!?…»\"”") + ["comma"] * ("," in b.text) + ["bar"] * ("|" in b.text and b.linked > 0) + ["copy"] * ("©" in b.text)
        on += ["upper"] * b.text.isupper() + ["digits"] * (sum(map(str.isdigit, b.text[:200])) > 20)
        seen |= page.name[k] == "h1"
        passed |= within[k]
        on += [kind] * bool(kind) + ["in core" if within[k] else "after core" if passed else "before core"] * bool(core)
        on += ["bare"] * (not tags[k]) + ["after h1"] * seen + ["no article yet"] * (heading and not seen)
        on += ["first"] * (i == 0) + ["last"] * (i == len(found) - 1) + ["only"] * (len(found) == 1)
        x[i, [_INDEX[f] for f in on]] = 1
    return x


# ---------------------------------------------------------------- the field


class Crf:
    """Weights of the two labels, of steps between them, and of the first block."""

    def __init__(self):
        self.w, self.t, self.s = np.zeros((len(_NAMES), 2)), np.zeros((2, 2)), np.zeros(2)

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 120, rate: float = 0.1, l2: float = 1e-4) -> Crf:
        """Maximises the conditional log-likelihood by Adam over all pages at once."""
        n, most = len(pages), max(len(y) for _, y in pages)
        flat, hot = np.concatenate([a for a, _ in pages]).astype(np.float32), np.eye(2)[np.concatenate([y for _, y in pages])]
        at = np.concatenate([i * most + np.arange(len(y)) for i, (_, y) in enumerate(pages)])  # a block's place in the padded pages
        on = np.zeros(n * most, bool)
        on[at] = True
        on = on.reshape(n, most)
        first = np.cumsum([0, *(len(y) for _, y in pages[:-1])])
        step = sum(np.einsum("ti,tj->ij", np.eye(2)[y[:-1]], np.eye(2)[y[1:]]) for _, y in pages)
        params, moment, power = [self.w, self.t, self.s], [0, 0, 0], [0, 0, 0]
        both = lambda x, t: np.stack([np.logaddexp(x[:, 0] + t[0, j], x[:, 1] + t[1, j]) for j in (0, 1)], axis=1)
        for r in range(1, rounds + 1):
            e = np.zeros((n * most, 2))
            e[at] = flat @ self.w.astype(np.float32)
            e = e.reshape(n, most, 2)
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0] + self.s
            for k in range(1, most):
                alpha[:, k] = np.where(on[:, k, None], both(alpha[:, k - 1], self.t) + e[:, k], alpha[:, k - 1])
            for k in range(most - 2, -1, -1):
                beta[:, k] = np.where(on[:, k + 1, None], both(e[:, k + 1] + beta[:, k + 1], self.t.T), 0)
            z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            one = np.exp(alpha + beta - z[:, None, None]).reshape(-1, 2)[at]
            two = alpha[:, :-1, :, None] + self.t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
            two = np.exp(np.where(on[:, 1:, None, None], two, -np.inf)).sum(axis=(0, 1))
            miss = hot - one
            grads = [flat.T @ miss.astype(np.float32) / n - l2 * self.w, (step - two) / n - l2 * self.t, miss[first].sum(axis=0) / n]
            for i, g in enumerate(grads):
                moment[i], power[i] = 0.9 * moment[i] + 0.1 * g, 0.999 * power[i] + 0.001 * g * g
                params[i] += rate * (moment[i] / (1 - 0.9**r)) / (np.sqrt(power[i] / (1 - 0.999**r)) + 1e-8)
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The likeliest labels of a page's blocks (Viterbi)."""
        if not len(x):
            return np.zeros(0, int)
        e = x @ self.w
        best, back = e[0] + self.s, np.zeros((len(x), 2), int)
        for k in range(1, len(x)):
            go = best[:, None] + self.t
            back[k] = go.argmax(axis=0)
            best = go.max(axis=0) + e[k]
        labels = np.zeros(len(x), int)
        labels[-1] = best.argmax()
        for k in range(len(x) - 1, 0, -1):
            labels[k - 1] = back[k, labels[k]]
        return labels


# ---------------------------------------------------------------- labelled pages

#: Content carries this mark in the page source, so each block's label is known.
_IN = "\ue000"
#: Words that themes put on outer elements, whatever stands inside them; half of them are also hints.
_THEME = "single has no with open wide full layout grid col row container wrapper wrap page site app root theme dark lang en logged left right sidebar comments menu main header footer nav search post template default ad share boxed sticky top widget related cookie hidden js inner outer block".split()


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page of a random template and the label of each of its blocks (1: content)."""
    pick, maybe = rng.choice, lambda p: rng.random() < p
    syllables = "ba re to ni sol ka lim ver da es tra un pel mo ri gan chi ent ous ly".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    stops = pick([[".", ".", ".", "!", "?"], [".", ".", ":", ". [3]", ";"], [""], [". [1]", " [12]", ".)"]])
    sentence = lambda: words(2, 18).capitalize() + pick([*stops, ", " + words(2, 6) + "."])
    paragraph = lambda: " ".join(sentence() for _ in range(pick([1, 1, 2, 3, 6])))

    def links(n: int) -> str:
        shape = pick(["ul", "ol", "div", "p", "span"])
        if shape in ("ul", "ol"):
            return f"<{shape}>" + "".join(f"<li><a href='/{word()}'>{words(1, 3)}</a></li>" for _ in range(n)) + f"</{shape}>"
        return f"<{shape}>" + pick([" | ", " ", " · "]).join(f"<a href='#'>{words(1, 2)}</a>" for _ in range(n)) + f"</{shape}>"

    def named(inner: str, names: list[str], tags: tuple[str, ...] = ("div", "section")) -> str:
        tag = pick(tags)
        name = " ".join(names)
        return f'<{tag} {pick(["class", "class", "id"])}="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    def noisy(most: int) -> list[str]:
        return ["-".join(rng.sample(_THEME, rng.randint(1, 3))) for _ in range(rng.randint(0, most))]

    def furniture(kind: str) -> str:
        inner = {
            "ad": lambda: pick([sentence(), paragraph(), f"<p>{sentence()}</p><a href='#'>{words(1, 3)}</a>"]),
            "nav": lambda: links(rng.randint(3, 9)),
            "head": lambda: pick([f"<a href='/'>{words(1, 3)}</a>", f"<p>{sentence()}</p>", words(1, 4), f"<h2>{words(1, 3)}</h2>", f"<h1><a href='/'>{words(1, 3)}</a></h1>"]),
            "foot": lambda: pick([f"&copy; {word()}.example &middot; {sentence()}", f"<p>&copy; 2020 {words(1, 4)}</p>" + links(3), f"<p>{sentence()}</p>", f"<div>{words(1, 4)} {rng.randint(1990, 2030)}</div>" + links(2)]),
            "side": lambda: pick([f"<h3>{words(1, 3)}</h3>" + links(4), f"<p>{paragraph()}</p>", f"<h4>{words(1, 2)}</h4><p>{sentence()}</p>"]),
            "note": lambda: pick([f"<p>{sentence()}</p><button>{word()}</button>", paragraph(), f"{sentence()} <a href='#'>{word()}</a>"]),
            "talk": lambda: f"<h3>{words(1, 2)}</h3>" + talk(),
            "share": lambda: pick([links(3), words(1, 4)]),
            "form": lambda: f"<label>{words(1, 3)}</label><input name='q'><button>{word()}</button>" + pick(["", f"<p>{sentence()}</p>", f"<textarea>{sentence()}</textarea>"]),
        }[kind]()
        own = {"nav": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form", "ad": "aside"}.get(kind)
        if own and kind != "ad" and maybe(0.55):
            return f"<{own}>{inner}</{own}>"
        if kind == "nav" and maybe(0.25):
            return inner
        return named(inner, [pick(_HINTS[kind].split()) + pick(["", "-box", "_wrap", " wide", "-1"])], (own or "div", "div"))

    def talk() -> str:
        n = rng.randint(1, 6)
        shape = pick(["div", "article", "li", "p"])
        one = lambda: f"<b>{word()}</b><p>{paragraph()}</p>"
        if shape == "li":
            return "<ol>" + "".join(f"<li>{pick([one(), sentence(), f'<article>{one()}</article>'])}</li>" for _ in range(n)) + "</ol>"
        return "".join(f"<p>{paragraph()}</p>" if shape == "p" else f"<{shape} class='comment'>{one()}</{shape}>" for _ in range(n))

    def content(n: int) -> list[str]:
        out = []
        for i in range(n):
            body = paragraph()
            body = pick([body, body, body, f"<b>{body}</b>", f"<b>{body}<br>", f"{body} <a href='#'>{words(1, 3)}</a> {sentence()}", f"{body}<br>{sentence()}", f"<span class='{' '.join(noisy(1))}'>{body}</span>", words(1, 4) + pick([".", "", " |", " ***"])])
            kind = pick(["p"] * 9 + ["li", "blockquote", "h2", "pre", "table", "div", "h3", "figure"]) if i else "p"
            out.append({"li": f"<ul><li>{_IN}{body}</li><li>{_IN}{sentence()}</li></ul>", "table": f"<table><tr><td>{_IN}{words(1, 3)}</td><td>{_IN}{words(1, 3)}</td></tr></table>", "figure": f"<figure><img src='x'><figcaption>{_IN}{sentence()}</figcaption></figure>"}.get(kind) or f"<{kind}>{_IN}{body}</{kind}>")
            if kind == "p" and maybe(0.15):
                out[-1] = out[-1].removesuffix("</p>")
        return out

    title = words(2, 12).capitalize() + pick(["", ".", "&amp;"])
    parts = content(pick([1, 1, 2, 3, 4, 8, 14]))
    for _ in range(pick([0, 0, 0, 1, 2])):
        parts.insert(rng.randint(1, len(parts)), furniture(pick(["ad", "side", "note", "share"])))
    h1 = pick([f"<h1>{_IN}{title}</h1>"] * 3 + [f"<h1><a href='#'>{_IN}{title}</a></h1>", f"<h2>{_IN}{title}</h2>", ""])
    if h1 and maybe(0.15):
        h1 = f"<header>{h1}</header>"
    inner = h1 + "".join(parts)
    hint = pick("content article post entry story main text body".split())
    shape = pick(["article", "article", "main", "role", "hint", "hint", "nested", "both", "div", "bare", "bare", "text"])
    own = f' class="{" ".join(noisy(3))}"' if maybe(0.5) else ""
    said = furniture("talk") if maybe(0.35) else ""
    if shape == "text":  # no tags at all, or none around the text
        inner = f"{_IN}{paragraph()}"
    article = {"article": f"<article{own}>{inner}</article>", "main": f"<main{own}>{inner}</main>", "role": f'<div role="main">{inner}</div>', "hint": f'<div class="{hint}">{inner}</div>', "nested": f'<div id="wrapper"><div class="{hint}-{pick(["body", "text", "wrap"])}">{inner}</div></div>', "both": f'<main{own}><article class="post">{inner}</article>{said}</main>', "div": f"<div>{inner}</div>", "bare": inner, "text": inner}[shape]
    before = after = []
    if maybe(0.75):
        before = [furniture(k) for k in ("head", "nav", "note", "ad", "form", "share") if maybe({"nav": 0.85, "ad": 0.4}.get(k, 0.25))]
        after = [furniture(k) for k in ("share", "side", "ad", "form", "note", "nav", "foot") if maybe({"foot": 0.85, "side": 0.35}.get(k, 0.2))]
        rng.shuffle(before)
        before = [*before, furniture("side")] if maybe(0.25) else before
        after = [said, *after] if said and shape != "both" else after
    if shape in ("bare", "text") and (before or after) and maybe(0.5):
        before, after = [b for b in before if "<nav" in b or "<header" in b], [a for a in after if "<footer" in a or "copy" in a]
    page = "".join(before) + f"<!-- {word()} -->" * maybe(0.3) + article + "".join(after)
    for _ in range(pick([0, 0, 1, 1, 2, 3])):  # outer elements of any name
        page = named(page, noisy(3), ("div", "div", "section"))
    if maybe(0.85):
        body = f' class="{" ".join(noisy(5))}"' if maybe(0.6) else ""
        extra = pick(["", f"<style>.{word()} {{color:red}}</style>", f"<script src='/{word()}.js'></script>", f"<script>if (a < b) {word()}('</div>')</script>"])
        page = f"<html lang='en'><head><title>{title}</title>{extra}</head><body{body}>{page}" + pick(["</body></html>", ""])
    return page.replace(_IN, ""), [int(_IN in b.text) for b in Page(page).blocks]


def labelled_pages(n: int = 1500, seed: int = 7) -> list[tuple[Page, np.ndarray]]:
    """`n` generated pages and the labels of their blocks; the same for the same seed."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        html, labels = labelled_page(rng)
        page = Page(html)
        if len(page.blocks) == len(labels) and page.blocks:
            out.append((page, np.array(labels)))
    return out


@lru_cache(maxsize=2)
def trained(pages: int = 1500, seed: int = 7) -> Crf:
    """The model of `labelled_pages`; some seconds, once per process."""
    return Crf().fit([(features(p), y) for p, y in labelled_pages(pages, seed)])


# ---------------------------------------------------------------- the operator


def main_text(page: str | None, model: Crf) -> str:
    """The content blocks of a page, joined by one space; empty if none."""
    found = Page(page)
    return " ".join(b.text for b, y in zip(found.blocks, model.decode(features(found)), strict=True) if y)


def extract(pages: DataFrame, model: Crf | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (the main text) and n_chars of every row.

    Null and empty pages and pages without content have an empty text. Whole
    pages are read, however long; repeated rows are each returned; other
    columns are not read; an empty table gives an empty result.
    """
    given = pages.sparkSession.sparkContext.broadcast(model or trained())  # two weights for each feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        for b in batches:
            texts = [main_text(h, m) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
