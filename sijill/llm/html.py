"""Main text of web pages as the maximum-scoring run of tokens.

A page is a sequence of tokens, words and tags. Each has a weight learned from labelled pages: the log-odds of being
inside the main text, of its words by the elements that are open around them (their names and the words of their class and
id), of its tags by their share. Words of articles and paragraphs score positive, tags and the words of menus, forms and
the like negative. One linear scan finds the contiguous run with the greatest sum; it is widened to whole blocks, and
blocks in it whose own words score negative (an advert or readers' comments within an article) are left out.

The labelled pages are made by rule in ``labelled``: page frames of different kinds around generated articles, bare ones and
ones with names that say nothing among them, with every text marked as article or not. Training counts weighted evidence
once on the driver; the weights are a small table. They are whole millionths, so the sum over the open elements is kept up
as elements open and close and a page takes time in proportion to its length, however many its pieces or deep its nesting.

Tags are read as the HTML standard says: quotes open a value only behind an equals sign, ``/>`` closes foreign elements only,
a script ends at its end tag. Scripts, styles, comments, the head and what a browser doesn't show have no words. References are
decoded, white space within a block becomes one space, and blocks are joined by a line break.

Edge cases: a null or blank page, and one without any positive word, gives an empty text; text without any tag is one
block; markup that is cut off or not closed counts as far as it goes; of equal runs the first counts; repeated rows are alike;
an empty table gives an empty result; null ids and urls stay; other columns are neither read nor clash.
"""

from __future__ import annotations

import functools
import html as stdlib_html
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sijill.llm.common import prepare

# Fixed values of HTML: elements without content, without words to show, those whose content is no markup, and those that are no blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template textarea title iframe select canvas audio video noembed noframes xmp desc metadata datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow ms msub msup mtext object q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
#: Elements that an end tag or an implied end within them doesn't reach out of.
BORDERS = frozenset("table td th caption button object template svg math".split())
#: What an opening tag closes if it is open, and the elements that this doesn't reach out of.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
}

#: Limits of a word's weight: an advert within an article costs less than the article's words give, so it doesn't cut it.
LOW, HIGH = -0.2, 4.0
RIDGE = 0.5
#: Weights are whole numbers of this part.
UNIT = 1_000_000

_ATTRIBUTE = r"[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?+"
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![A-Za-z]))[^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|" + _ATTRIBUTE + r")*+)(?:>|\Z)", re.S)
_MARK = re.compile(r"(?:^|(?<=[\s/\"']))(?:class|id|role|aria-label|itemprop)\s*+=\s*+(?:\"([^\"]*+)|'([^']*+)|([^\s>]++))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


def _traits(name: str, rest: str) -> tuple[str, ...]:
    out = ["<" + name]
    if rest:
        for m in _MARK.finditer(rest):
            out += [p.lower() for p in _PART.findall(m[1] or m[2] or m[3] or "")]
    return tuple(dict.fromkeys(out))


class _Open:
    """The open elements, the traits around what comes next and their summed weight; each step costs its own elements only."""

    def __init__(self, weights: dict[str, int]):
        self.weights, self.sum = weights, 0
        self.names: list[str | None] = []
        self.traits: list[tuple[str, ...]] = []
        self.where: dict[str, list[int]] = {}
        self.borders: list[int] = []
        self.around: Counter[str] = Counter()

    def last(self, *names: str) -> int:
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=-1)

    def push(self, name: str, traits: tuple[str, ...]) -> None:
        if name in BORDERS:
            self.borders.append(len(self.names))
        self.where.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.traits.append(traits)
        for t in traits:
            self.around[t] += 1
            if self.around[t] == 1:
                self.sum += self.weights.get(t, 0)

    def _lose(self, at: int) -> None:
        for t in self.traits[at]:
            self.around[t] -= 1
            if not self.around[t]:
                del self.around[t]
                self.sum -= self.weights.get(t, 0)
        self.where[self.names[at]].remove(at) if self.where[self.names[at]][-1] != at else self.where[self.names[at]].pop()
        self.names[at], self.traits[at] = None, ()

    def cut(self, at: int) -> None:
        """Close all from ``at`` on."""
        while len(self.names) > at:
            k = len(self.names) - 1
            if self.names[k] is not None:
                if self.borders and self.borders[-1] == k:
                    self.borders.pop()
                self._lose(k)
            self.names.pop(), self.traits.pop()

    def close(self, name: str) -> None:
        at = self.last(name)
        if at < 0 or (self.borders and self.borders[-1] > at and name not in BORDERS | {"tr", "tbody", "thead", "tfoot"}):
            return
        if name in INLINE and name not in BORDERS and any(n is not None and n not in INLINE for n in self.names[at + 1 : at + 9]):
            self._lose(at)  # an inline element's end closes no block that began in it
        else:
            self.cut(at)


#: A block: its text, and for each of its pieces the number of words, the summed weight and (if asked for) the traits around it; and the number of tags before it.
Block = tuple[str, list[tuple[int, int, tuple[str, ...]]], int]


def blocks(page: str, weights: dict[str, int], with_traits: bool = False) -> list[Block]:
    """The blocks in page order."""
    out: list[Block] = []
    open_ = _Open(weights)
    text: list[str] = []
    pieces: list[tuple[int, int, tuple[str, ...]]] = []
    endless: set[str] = set()
    tags = 0

    def flush():
        nonlocal tags
        if pieces:
            out.append((_SPACE.sub(" ", "".join(text)).strip(), list(pieces), tags))
            pieces.clear()
            tags = 0
        text.clear()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            piece = stdlib_html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if n := len(piece.split()):
                pieces.append((n, open_.sum, tuple(open_.around) if with_traits else ()))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), m[1] == "/"
        if name == "br":  # a line break within a block is white space
            text.append(" ")
            continue
        inline = name in INLINE
        if not inline:
            flush()
        tags += 1
        if closing:
            open_.close(name)
            continue
        if name in UNSEEN and not (m[0].endswith("/>") and open_.last("svg", "math") >= 0):
            stop = None
            if name not in endless:
                stop = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
                if stop is None:
                    endless.add(name)  # nor does any later one end
            if stop:
                at = stop.end()
            elif name in ("script", "style", "noscript", "iframe", "xmp", "noembed", "noframes", "title", "textarea"):
                break  # of what isn't closed all that follows is content
            continue
        if name in VOID or m[0].endswith("/>") and (name in ("svg", "math") or open_.last("svg", "math") >= 0):
            continue
        if not inline and (p := open_.last("p")) >= 0 and not (open_.borders and open_.borders[-1] > p):
            open_.cut(p)
        if name in CLOSES:
            closed, borders = CLOSES[name]
            within = open_.last(*borders)
            k = min((x for c in closed if (x := open_.last(c)) > within), default=-1)
            if k >= 0:
                open_.cut(k)
        traits = _traits(name, m[3])
        if name == "a":  # a link says more with the block that it is in
            inner = next((n for n in reversed(open_.names[-8:]) if n is not None and n not in INLINE), "")
            traits += (f"<{inner} a",)
        open_.push(name, traits)
    flush()
    return out


# ------------------------------------------------------------------ labelled pages

# Words that class and id names of page parts are made of.
_NAMES = {
    "menu": "nav navigation menu navbar mainmenu topnav subnav breadcrumb breadcrumbs pagination pager tabs toc skip dropdown megamenu hamburger links",
    "header": "header masthead topbar logo branding banner site hero",
    "footer": "footer copyright colophon legal bottom imprint foot",
    "aside": "sidebar widget aside related recommended recommendations trending popular newsletter subscribe rail secondary complementary more read teaser sidenav promo",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay privacy paywall announcement notification disclaimer toast dialog warning",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsense adsbygoogle dfp outbrain taboola adbox adslot commercial",
    "form": "form login search signup signin register contact subscribe newsletter subscription input",
    "comments": "comments comment commentlist replies reply disqus discussion responses response reviews respond thread feedback",
    "share": "share social sharing sharebar toolbar follow buttons",
}
_ARTICLE = "article post entry content story text body main page single hentry prose copy"
_AROUND = {
    "menu": ["<nav{}>{}</nav>", "<nav{}><ul>{}</ul></nav>", "<div{}><ul>{}</ul></div>", "<ul{}>{}</ul>", '<div{} role="navigation">{}</div>', "<menu{}>{}</menu>"],
    "header": ["<header{}>{}</header>", "<div{}>{}</div>", '<header{} role="banner">{}</header>'],
    "footer": ["<footer{}>{}</footer>", "<div{}>{}</div>", '<footer{} role="contentinfo">{}</footer>'],
    "aside": ["<aside{}>{}</aside>", "<div{}>{}</div>", "<section{}>{}</section>", '<div{} role="complementary">{}</div>'],
    "notice": ["<div{}>{}</div>", '<div{} role="alert">{}</div>', "<section{}>{}</section>", '<div{} role="dialog">{}</div>', "<dialog{}>{}</dialog>"],
    "advert": ["<div{}>{}</div>", "<section{}>{}</section>", "<ins{}>{}</ins>", "<aside{}>{}</aside>"],
    "form": ["<form{}>{}</form>", "<form{}><fieldset>{}</fieldset></form>", '<div{}><form action="/x">{}</form></div>'],
    "comments": ["<section{}>{}</section>", "<div{}>{}</div>", "<ol{}>{}</ol>", "<ul{}>{}</ul>", '<div{} id="comments">{}</div>'],
    "share": ["<div{}>{}</div>", "<ul{}>{}</ul>"],
}
#: Elements that name their kind without a class.
_PLAIN = ("<nav", "<header", "<footer", "<aside", "<form", "<menu", "<dialog")


def labelled(n: int = 900, seed: int = 17) -> list[tuple[str, list[tuple[str, bool]]]]:
    """Pages and, in page order, their texts, each with whether it belongs to the main text."""
    rng = random.Random(seed)
    syllables = "ba ne lo ri mu sta ker vin tho and ea ing qu".split()

    def words(k: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(k)).capitalize() + rng.choice([".", ".", "!", "?"])

    def many(low: int, high: int) -> str:
        return words(rng.randint(low, high))

    def nothing() -> str:
        """A name that says nothing."""
        return "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") for _ in range(rng.randint(2, 3))) + rng.choice(["", "-x", "__in", "-1"])

    def attribute(names: str, always: bool) -> str:
        if not always and rng.random() < 0.4:
            return f' class="{nothing()}"' if rng.random() < 0.3 else ""
        own = [rng.choice(names.split()) for _ in range(rng.randint(1, 2))]
        own += [nothing()] if rng.random() < 0.4 else []
        rng.shuffle(own)
        shape = rng.choice([" class=\"{}\"", " id=\"{}\"", " class={}"])
        return shape.format(("-" if shape.endswith("{}") else rng.choice(["-", " "])).join(own))

    def junk(kind: str, marks: list) -> str:
        inner = []
        for _ in range(rng.randint(1, 5)):
            t = many(1, 5) if kind in ("menu", "share", "header") else many(3, 30) if kind == "comments" else many(3, 18)
            marks.append((t, False))
            shapes = {
                "menu": ["<li><a href='/x'>{}</a></li>", "<li>{}</li>", "<a href='/x'>{}</a><hr>"],
                "form": ["<p>{}</p>", "<label>{}</label><br><hr>", "<h3>{}</h3>", "<button>{}</button>", "<legend>{}</legend>"],
                "comments": ["<p>{}</p>", "<div>{}</div>", "<li>{}</li>", "<li><p>{}</p></li>", "<article><p>{}</p></article>"],
                "share": ["<li><a href='/s'>{}</a></li>", "<li>{}</li>", "<div><a href='/s'>{}</a></div>"],
            }.get(kind, ["<p>{}</p>", "<div>{}</div>", "<h4>{}</h4>", "<p><a href='/y'>{}</a></p>", "<ul><li><a href='/y'>{}</a></li></ul>"])
            inner.append(rng.choice(shapes).format(t))
        if kind in ("notice", "advert") and rng.random() < 0.2:
            marks[-len(inner) :] = [(t, False)]
            return f"<p{attribute(_NAMES[kind], True)}>{t}</p>"
        shape = rng.choice(_AROUND[kind])
        return shape.format(attribute(_NAMES[kind], not shape.startswith(_PLAIN)), "".join(inner))

    def frame(inner: str) -> str:
        shape = rng.choice(["<article{}>{}</article>", "<main{}>{}</main>", "<div{}>{}</div>", "<section{}>{}</section>", "{}", "{}", "<main{}><article>{}</article></main>", "<div{}><div>{}</div></div>", "<table{}><tr><td>{}</td></tr></table>"])
        return inner if shape == "{}" else shape.format(attribute(_ARTICLE, False), inner)

    out = []
    for _ in range(n):
        marks: list[tuple[str, bool]] = []
        often = rng.choice([0.0, 0.3, 0.6])
        page = ""
        for kind in ("notice", "header", "menu", "advert", "form", "aside"):
            if rng.random() < often:
                page += junk(kind, marks)
        inner = ""
        if rng.random() < 0.8:
            title = many(1, 9)
            marks.append((title, True))
            inner += rng.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>", "<hgroup><h1>{}</h1></hgroup>"]).format(title)
        for _ in range(rng.choice([1, 1, 2, 3, 5, 9])):
            if rng.random() < 0.15 * (often > 0):
                inner += junk(rng.choice(["advert", "aside", "share", "form", "notice", "menu", "comments"]), marks)
            t = many(1, 40)
            marks.append((t, True))
            inner += rng.choice(
                ["<p>{}</p>"] * 8
                + ["<p><b>{}</b></p>", "<p>{}", "<h2>{}</h2>", "<h3>{}</h3>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<ol><li>{}</ol>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>"]
                + ["<div>{}</div>", "<section>{}</section>", "<p><em>{}</em></p>", "<dl><dd>{}</dd></dl>", "<p><span>{}</span></p>", '<p class="lead">{}</p>', "<p><a href='/z'>{}</a></p>", "<address>{}</address>", "<details><summary>{}</summary></details>"]
            ).format(t)
        if often and rng.random() < 0.15:
            inner += junk("comments", marks)
        page += frame(inner)
        for kind in ("share", "comments", "aside", "advert", "form", "menu", "footer"):
            if rng.random() < often:
                page += junk(kind, marks)
        if rng.random() < 0.9:
            page = f"<!DOCTYPE html><html><head><title>x</title></head><body>{page}</body></html>"
        out.append((page, marks))
    return out


class Weights:
    """A word's weight is ``base`` plus those of the traits around it, in UNITs; a tag costs ``tag``."""

    def __init__(self, base: int, traits: dict[str, int], tag: int):
        self.base, self.traits, self.tag = base, traits, tag

    def score(self, block: Block) -> int:
        low, high = int(LOW * UNIT), int(HIGH * UNIT)
        return sum(n * max(low, min(high, self.base + s)) for n, s, _ in block[1])


@functools.lru_cache(1)
def trained() -> Weights:
    """Logistic weights of the traits over the pieces of the labelled pages, by Newton steps; the tags' by their share."""
    rows, tags, words_in = [], 0, 0
    for page, marks in labelled():
        found = blocks(page, {}, True)
        assert [t for t, _, _ in found] == [t for t, _ in marks]
        for (_, pieces, before), (_, good) in zip(found, marks, strict=True):
            rows += [(traits, float(good), min(n, 12)) for n, _, traits in pieces]
            tags += before * good
            words_in += sum(n for n, _, _ in pieces) * good
    seen = Counter(t for r in rows for t in r[0])
    names = sorted(t for t, n in seen.items() if n >= 5)
    column = {t: i for i, t in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1.0
    for i, (traits, _, _) in enumerate(rows):
        x[i, [column[t] for t in traits if t in column]] = 1.0
    y, w = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float) / 4
    beta = np.zeros(len(names) + 1)
    ridge = np.append(np.full(len(names), RIDGE), 1e-3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = x.T * (w * np.maximum(p * (1 - p), 1e-4))
        beta -= np.linalg.solve(curve @ x + np.diag(ridge), x.T @ (w * (p - y)) + ridge * beta)
    whole = np.rint(beta * UNIT).astype(int).tolist()
    return Weights(whole[-1], dict(zip(names, whole[:-1], strict=True)), -round(min(0.5, 0.25 * tags / max(words_in, 1)) * UNIT))


# ------------------------------------------------------------------ extraction


def extract(page: str, weights: Weights | None = None) -> str:
    """The main text of one page."""
    weights = weights or trained()
    found = blocks(page, weights.traits)
    score = [weights.score(b) for b in found]
    # the linear scan: a run of tokens is best cut at a block's border
    best, begin, end = 0, 0, 0
    run, start = 0, 0
    for i, (_, _, tags) in enumerate(found):
        run += weights.tag * tags
        if run <= 0:
            run, start = 0, i
        run += score[i]
        if run > best:
            best, begin, end = run, start, i + 1
    return "\n".join(found[i][0] for i in range(begin, end) if score[i] > 0)


def _extracted(batches, weights: Weights):
    for b in batches:
        text = pa.array([extract(h, weights) if h else "" for h in b.column("html").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), text], ["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """A row for each row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    prepare(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = own.mapInArrow(functools.partial(_extracted, weights=trained()), "page_id long, url string, text string")
    return out.select("*", F.length("text").cast("long").alias("n_chars"))
