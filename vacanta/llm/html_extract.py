"""Main text of web pages by a maximum-scoring subsequence (operator 5).

A page is a sequence of words and tags. A word scores by where it stands: by the open
elements around it, the words in their classes, ids and roles, whether it is in a link,
and how long its block is. A tag scores below zero. All weights are learnt from labelled
pages (``labelled_pages`` writes some hundreds, from a rule): those of words by logistic
regression, those of tags as log-odds. One linear scan finds the contiguous region of the
highest sum, which is the article: what lies outside of it is left out, whatever it is.

Inside the region those elements are left out that hold no article by their tag (forms,
menus, scripts and the like), and those between content whose names weigh like
boilerplate; the scan has cut off such elements at the ends.

Character references are decoded; white space in a block becomes one space; blocks are
joined by one newline in page order. ``br`` and table cells count as white space.

Defined results: null and empty pages, and pages without a word, give an empty text; ties
between regions give the first, and of equal ends the nearest; where no word scores above
zero, words score 1 but for those in elements that are left out or named like boilerplate;
a tag that the end of the page cuts off is dropped, as is a
comment or script that never ends; pages of any length are read whole; rows that repeat
are each returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from .common import map_values, table
from .training import Adam, sigmoid

# ------------------------------------------------------------------ fixed values
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|iframe|textarea|title|xmp|noembed|noframes"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
SPACES = frozenset("br td th".split())
#: Elements that hold no article's text by their tag; a header does only inside article or main.
REMOVED = frozenset("nav footer aside form menu dialog head svg select button object canvas noscript template".split())
#: Elements that an opening tag of the first kind closes, if one of them is the innermost.
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# ------------------------------------------------------------------

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s>/]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s>/]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/]+)")
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Words of a block from which on it counts as long.
LONG_BLOCK = 12
#: The most that a word may score either way, and what evidence of its names leaves an element inside the region out.
MOST, CUT = 2.0, -1.5
#: What words and tags of elements score that are left out.
LEFT_OUT = -0.1
#: What a tag scores at most and at least, and one that no labelled page has.
TAG_MOST, TAG_LEAST, OTHER_TAG = -0.02, -4.0, -0.3


@lru_cache(maxsize=4096)
def element_features(tag: str, attrs: str) -> tuple[tuple[str, float], ...]:
    """Features of an element: its tag, and the words of its names, which share one vote a name."""
    out: dict[str, float] = {"<" + tag: 1.0}
    if attrs:
        found: dict[str, str] = {}
        for m in _ATTR.finditer(attrs):
            found.setdefault((m[1] or m[5]).lower(), unescape(m[2] or m[3] or m[4] or "").lower())
        if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
            out[" hidden"] = 1.0
        if "role" in found:
            out["role " + found["role"].strip()] = 1.0
        for name in (found.get("class", "") + " " + found.get("id", "")).split():
            parts = _NAME.findall(name)
            for part in parts:
                out[part] = max(out.get(part, 0.0), 1 / len(parts))
    return tuple(out.items())


class Item(NamedTuple):
    """A tag, or text with the features of the elements around it (their greatest values)."""

    text: str | None
    tag: str
    removed: bool
    around: int  # number of a set of features in ``Page.sets``
    link: bool


def read(page: str) -> tuple[list[Item], list[dict[str, float]]]:
    """The items of a page in order, and the sets of features that they name."""
    stack: list[tuple[str, bool, int]] = []
    is_open: Counter[str] = Counter()
    sets: list[dict[str, float]] = [{}]
    out: list[Item] = []

    def leave(to: int) -> None:
        for tag, _, _ in stack[to:]:
            is_open[tag] -= 1
        del stack[to:]

    for m in _TOKEN.finditer(page):
        removed, around = stack[-1][1:] if stack else (False, 0)
        if (text := m["text"]) is not None:
            out.append(Item(text, "", removed, around, is_open["a"] > 0))
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, attrs = tag.lower(), m["attrs"] if m["tag"] else m["attrs2"]
        if m["end"] or m["end2"]:
            if is_open[tag]:
                leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            out.append(Item(None, "/" + tag, removed, around, False))
            continue
        while stack and stack[-1][0] in CLOSES.get(tag, ()):
            leave(len(stack) - 1)
        removed, around = stack[-1][1:] if stack else (False, 0)
        inner = tag == "header" and is_open["article"] + is_open["main"] > 0
        removed = removed or tag in REMOVED or (tag == "header" and not inner)
        if tag not in VOID and not (attrs.endswith("/") and tag == "svg"):
            if tag not in INLINE or attrs:
                own = dict(sets[around])
                for name, value in element_features("inner-header" if inner else tag, attrs):
                    own[name] = max(own.get(name, 0.0), value)
                if own != sets[around]:
                    sets.append(own)
                    around = len(sets) - 1
            stack.append((tag, removed, around))
            is_open[tag] += 1
        out.append(Item(None, tag, removed, around, False))
    return out, sets


def block_lengths(items: list[Item]) -> list[int]:
    """For each item the words of its block."""
    out, start, words = [0] * len(items), 0, 0
    for i, x in enumerate([*items, Item(None, "/end", False, 0, False)]):
        if x.text is not None:
            words += len(x.text.split())
        elif x.tag.lstrip("/") not in INLINE and x.tag.lstrip("/") not in SPACES:
            out[start:i] = [words] * (i - start)
            start, words = i, 0
    return out


# ---------------------------------------------------------------- labelled pages


def labelled_pages(n: int = 400, seed: int = 5) -> Iterator[list[tuple[str, bool]]]:
    """Pages as pieces of HTML, each marked as the article's or not.

    Layouts, names and texts are drawn at random: articles in every common kind of
    element, with headings, lists, quotes, tables and links; boilerplate around and between
    their blocks, named as sites name it or not at all; article elements whose names have
    words that boilerplate has as well.
    """
    rng = random.Random(seed)
    say = lambda low, high: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))
    pick = lambda words: rng.choice(words.split())
    links = lambda k: "<ul>" + "".join(f'<li><a href="/{i}">{say(1, 3)}</a></li>' for i in range(k)) + "</ul>"
    # names that sites give to what is no article, and to articles
    kinds = {
        "menu": "menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar masthead header pagination pager",
        "side": "sidebar related recommended recommendations widget popular trending promo",
        "note": "ad ads advert advertisement adverts advertising banner sponsored sponsor promo promotion cookie consent notice gdpr alert popup modal overlay disclaimer",
        "form": "newsletter subscribe subscription signup login search",
        "share": "share sharing social",
        "foot": "footer copyright legal colophon",
        "talk": "comment comments respond replies reply discussion disqus commentlist",
    }
    roles = {"menu": "navigation banner menu toolbar", "side": "complementary", "note": "alert dialog alertdialog", "form": "search form", "foot": "contentinfo"}
    tags = {"menu": "nav header div ul", "side": "aside div section", "note": "div aside p section", "form": "form div", "share": "div ul p", "foot": "footer div", "talk": "section div"}
    article = "article main section div td"
    names = "content post entry story article body text page main container wrapper hentry prose copy"

    def inside(kind: str) -> str:
        if kind in ("menu", "share"):
            return links(rng.randint(2, 8)) if rng.random() < 0.8 else say(1, 4)
        if kind == "side":
            return f"<h3>{say(1, 3)}</h3>" + (links(rng.randint(2, 7)) if rng.random() < 0.7 else f"<p>{say(4, 20)}</p>")
        if kind == "form":
            return f'<label>{say(1, 4)}</label><input name="q"><p>{say(3, 12)}</p><button>{say(1, 2)}</button>'
        if kind == "talk":
            return "".join(f"<div><b>{say(1, 2)}</b><p>{say(4, 40)}</p></div>" for _ in range(rng.randint(1, 5)))
        return f"<p>{say(3, 18)}</p>" if rng.random() < 0.5 else say(3, 18)

    def boiler(kind: str) -> str:
        tag, draw, mark = pick(tags[kind]), rng.random(), ""
        name = pick(kinds[kind])
        if draw < 0.7:
            joined = name + rng.choice(["", "", "", "-box", "-wrap", "-bar", "-area", "-list", f"-{rng.randint(1, 9)}", "_inner"])
            mark = f' {rng.choice(["class", "class", "id"])}="{joined}"'
        elif draw < 0.8 and kind in roles:
            mark = f' role="{pick(roles[kind])}"'
        elif tag in ("div", "section", "p", "ul"):
            mark = f' class="{name}"'
        if rng.random() < 0.04:
            mark = " hidden" if rng.random() < 0.5 else ' style="display:none"'
        return f"<{tag}{mark}>{inside(kind)}</{tag}>"

    def stray() -> str:
        """Words that stand outside the article, without a name that tells so."""
        return rng.choice(["<div>{}</div>", "<p>{}</p>", "<span>{}</span>", "<div><div>{}</div></div>"]).format(say(2, 10))

    def block() -> str:
        odd = rng.random()
        own = f' class="{pick("menu share social notice ad comment related banner login header")}-{pick("title history text story lead quote board page study note")}"' if odd < 0.06 else f' class="{pick("lead intro para block quote caption title subtitle headline dropcap")}"' if odd < 0.2 else ""
        words = say(1, 12) if rng.random() < 0.3 else say(6, 60)
        if rng.random() < 0.3:
            words += f' <a href="/x">{say(1, 4)}</a> <em>{say(1, 3)}</em> {say(0, 20)}'
        kind = rng.random()
        if kind < 0.62:
            return f"<p{own}>{words}</p>"
        if kind < 0.72:
            return f"<h2{own}>{say(2, 8)}</h2>"
        if kind < 0.8:
            return f"<ul{own}>" + "".join(f"<li>{say(2, 14)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.86:
            return f"<blockquote{own}><p>{words}</p></blockquote>"
        if kind < 0.9:
            return "<table>" + "".join(f"<tr><td>{say(1, 3)}</td><td>{say(1, 3)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if kind < 0.94:
            return f'<figure><img src="/i"><figcaption>{say(3, 12)}</figcaption></figure>'
        return f"<div{own}>{words}</div>" if kind < 0.98 else f"<pre>{words}</pre>"

    for _ in range(n):
        body = [(f"<h1>{say(2, 10)}</h1>", True)] if rng.random() < 0.9 else []
        tag = pick(article)
        if body and tag in ("article", "main") and rng.random() < 0.3:
            body = [("<header>", False), *body, (f"<p>{say(2, 8)}</p></header>", True)]
        for _ in range(rng.randint(1, 14)):
            body.append((block(), True))
            if rng.random() < 0.08:
                body.append((boiler(pick("side note note form share")), False))
        if body[-1][1] is False:
            body.append((block(), True))
        if rng.random() < 0.2:
            body.append((boiler("talk"), False))
        name = f' class="{pick(names)}{rng.choice(["", "", "-" + pick(names), "-body", "-2", "-" + pick("box wrap area inner list bar")])}"' if rng.random() < (0.4 if tag in ("article", "main") else 0.8) else ""
        outer = rng.choice([("", ""), ("", ""), ("<main>", "</main>"), ('<div id="page">', "</div>"), ('<div class="wrapper">', "</div>"), ("<section>", "</section>")])
        if tag == "td":
            outer = ("<table><tr>", "</tr></table>")
        before = [boiler(k) for k in ("menu", "note", "form", "side") if rng.random() < {"menu": 0.9, "note": 0.5, "form": 0.2, "side": 0.2}[k]]
        after = [boiler(k) for k in ("talk", "share", "side", "form", "note", "foot") if rng.random() < {"foot": 0.9, "talk": 0.4}.get(k, 0.25)]
        for place in (before, after):
            if rng.random() < 0.4:
                place.insert(rng.randint(0, len(place)), stray())
        head = f"<!DOCTYPE html><html><head><title>{say(2, 6)}</title></head><body>"
        yield [(head + "".join(before) + outer[0] + f"<{tag}{name}>", False), *body, (f"</{tag}>" + outer[1] + "".join(after) + "</body></html>", False)]


# ---------------------------------------------------------------- weights


class Weights:
    """Of words by the features around them, and of tags."""

    def __init__(self, word: dict[str, float], tag: dict[str, float]):
        self.word, self.tag = word, tag

    def evidence(self, around: dict[str, float]) -> float:
        get = self.word.get
        return sum(get(name, 0.0) * value for name, value in around.items())

    def scores(self, items: list[Item], sets: list[dict[str, float]]) -> list[float]:
        """The score of each item."""
        found, lengths = [self.evidence(s) for s in sets], block_lengths(items)
        base, link, long = (self.word.get(k, 0.0) for k in (" all", " link", " long"))
        score, foreign = [], self.foreign(sets, {})
        for x, n in zip(items, lengths, strict=True):
            if x.text is None:
                # inline markup says nothing about where an article ends
                odds = max(LEFT_OUT, self.tag.get(x.tag, OTHER_TAG)) if x.removed or foreign[x.around] else self.tag.get(x.tag, OTHER_TAG)
                score.append(0.0 if x.tag.lstrip("/") in INLINE else odds)
                continue
            words = len(x.text.split())
            one = base + found[x.around] + (link if x.link else 0.0) + (long if n >= LONG_BLOCK else 0.0)
            # what its tag or names leave out must not cut an article in two
            score.append(words * (LEFT_OUT if x.removed or foreign[x.around] else max(-MOST, min(MOST, one))))
        return score

    def foreign(self, sets: list[dict[str, float]], home: dict[str, float]) -> list[bool]:
        """For each set whether its names, but for those of ``home``, weigh like boilerplate."""
        own = ({k: v for k, v in s.items() if k[0] != "<" and k not in home} for s in sets)
        return [self.evidence(s) < CUT for s in own]


def learn(pages: Iterator[list[tuple[str, bool]]], steps: int = 200) -> Weights:
    """Weights from pieces of pages and whether they are the article's."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    number = {" all": 0, " link": 1, " long": 2}
    for pieces in pages:
        html, mine = "", []
        for piece, of_article in pieces:
            html += piece
            mine.append((len(html), of_article))
        items, sets = read(html)
        at, k = 0, 0
        where = [m.end() for m in _TOKEN.finditer(html) if m["text"] is not None or m["tag"] or m["tag2"]]
        for x, n, at in zip(items, block_lengths(items), where, strict=True):
            while mine[k][0] < at:
                k += 1
            good = mine[k][1]
            if x.text is None:
                seen[good][x.tag] += 1
            elif (words := len(x.text.split())) and not x.removed:
                row = [(0, 1.0), (1, float(x.link)), (2, float(n >= LONG_BLOCK))]
                row += [(number.setdefault(name, len(number)), value) for name, value in sets[x.around].items()]
                counts[good][tuple(row)] += min(words, LONG_BLOCK)
    rows = [(row, y, n) for y in (0, 1) for row, n in counts[y].items()]
    x, y, w = np.zeros((len(rows), len(number))), np.array([r[1] for r in rows], dtype=float), np.array([r[2] for r in rows], dtype=float)
    for i, (row, _, _) in enumerate(rows):
        for j, value in row:
            x[i, j] = value
    w *= np.where(y == 1, 0.5 / (w * y).sum(), 0.5 / (w * (1 - y)).sum())
    beta = np.zeros(len(number))
    step = Adam([beta], 0.1)
    for _ in range(steps):
        step.step([x.T @ ((sigmoid(x @ beta) - y) * w) + 1e-4 * beta])
    total = [sum(c.values()) for c in seen]
    odds = {t: math.log((seen[1][t] + 0.5) / total[1]) - math.log((seen[0][t] + 0.5) / total[0]) for t in seen[0] | seen[1]}
    return Weights({name: float(beta[i]) for name, i in number.items()}, {t: max(TAG_LEAST, min(TAG_MOST, v)) for t, v in odds.items()})


@lru_cache(maxsize=1)
def weights() -> Weights:
    return learn(labelled_pages())


# ---------------------------------------------------------------- extraction


def best_region(scores: list[float]) -> tuple[int, int]:
    """The first contiguous run of the highest sum, as a half-open range; empty if none is above 0."""
    best, found, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        run += s
        if run > best:
            best, found = run, (start, i + 1)
        elif run <= 0:
            run, start = 0.0, i + 1
    return found


def extract(page: str | None, weight: Weights | None = None) -> str:
    """The main text of one page."""
    items, sets = read(page or "")
    weight = weight or weights()
    scores = weight.scores(items, sets)
    first, last = best_region(scores)
    if first == last:  # nothing tells an article: any words will do that no element's names speak against
        foreign = weight.foreign(sets, {})
        scores = [s if x.text is None or x.removed or foreign[x.around] else float(len(x.text.split())) for s, x in zip(scores, items, strict=True)]
        first, last = best_region(scores)
    content = [i for i in range(first, last) if items[i].text is not None and scores[i] > 0]
    words: Counter[int] = Counter()
    for i in content:
        words[items[i].around] += len(items[i].text.split())
    foreign = weight.foreign(sets, sets[words.most_common(1)[0][0]] if words else {})
    blocks, block = [], []
    for i in range(first, last):
        x = items[i]
        if x.text is not None:
            between = bool(content) and content[0] < i < content[-1]
            if not x.removed and not (between and foreign[x.around]):
                block.append(x.text)
        elif (name := x.tag.lstrip("/")) in SPACES:
            block.append(" ")
        elif name not in INLINE and block:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    clean = (" ".join(unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def extract_pages(pages: DataFrame, weight: Weights | None = None) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages`` (page_id, url, html)."""
    weight = weight or weights()

    def row(page: str | None) -> tuple[str, int]:
        text = extract(page, weight)
        return text, len(text)

    return map_values(pages.select("page_id", "url", "html"), "html", lambda: row, "text string, n_chars long")


def op5_html_extract(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))
