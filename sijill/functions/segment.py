"""Folds that SQL can't say: window segmentation, fuzzy ratios and Unicode forms, as Arrow-batched functions."""

from __future__ import annotations

import difflib
import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TARGET, MOST, TAIL = 280, 600, 40
_PARAGRAPH = re.compile(r"\n\s*\n+")
_BREAK = re.compile(r"(?<=[.!?؟؛])\s+|\n+")


def _cut(text: str) -> Iterator[str]:
    """Pieces of at most MOST characters, cut at the last blank behind TARGET if there is one."""
    while len(text) > MOST:
        at = text.rfind(" ", TARGET, MOST)
        at = MOST if at < 0 else at
        yield text[:at]
        text = text[at:].lstrip()
    yield text


def _pieces(paragraph: str) -> Iterator[str]:
    """A short paragraph itself; of a longer one its sentences, packed to about TARGET characters; what is over MOST is cut, and its pieces stay apart."""
    if len(paragraph) <= MOST:
        yield paragraph
        return
    parts = [x for x in (s.strip() for s in _BREAK.split(paragraph)) if x]
    if len(parts) < 2:
        yield from _cut(paragraph)
        return
    held = ""
    for s in parts:
        if held and (len(s) > MOST or len(held) >= TARGET or len(held) + 1 + len(s) > MOST):
            yield held
            held = ""
        if len(s) > MOST:
            yield from _cut(s)
        else:
            held = f"{held} {s}" if held else s
    if held:
        yield held


def windows(text: str | None, most: int = 40) -> list[str]:
    """Paragraphs up to MOST characters, longer ones in pieces, white space collapsed; a tail under TAIL joins the window before
    if that leaves room. Ends with the ``most``-th window, whatever follows."""
    out: list[str] = []
    for paragraph in _PARAGRAPH.split((text or "").replace("\r\n", "\n").replace("\r", "\n")):
        for piece in _pieces(paragraph.strip()):
            if len(out) >= most:
                return out
            w = " ".join(piece.split())
            if w and out and len(w) < TAIL and len(out[-1]) + 1 + len(w) <= MOST:
                out[-1] = f"{out[-1]} {w}"
            elif w:
                out.append(w)
    return out


def segment(c, most: int = 40) -> Column:
    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: windows(t, most))

    return run(c)


def ratio(a, b, size: int | None = None, least: float = 0.0) -> Column:
    """Of matching blocks, as difflib has it; of the first ``size`` characters. Where a cheaper bound is under ``least``, that bound."""

    def one(p: str | None, q: str | None) -> float:
        m = difflib.SequenceMatcher(None, (p or "")[:size], (q or "")[:size])
        for bound in (m.real_quick_ratio, m.quick_ratio) if least else ():
            if (x := bound()) < least:
                return x
        return m.ratio()

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)])

    return run(a, b)


def nfkc_rtl(c) -> Column:
    """Lines with text in compatibility form and without NUL, if the text has any right-to-left character."""
    rtl = re.compile("[֐-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]")

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: t if t is None or not rtl.search(t) else "\n".join(unicodedata.normalize("NFKC", v).replace("\x00", "") if v.strip() else v for v in t.split("\n")))

    return run(c)


# ------------------------------------------------------------------ late interaction


def ngrams(text: str, n: int = 4) -> list[str]:
    """Overlapping n-grams of the lower-case normalized text, none equal to the one before; a shorter text is one."""
    t = " ".join((text or "").lower().split())
    found = [t[i : i + n] for i in range(len(t) - n + 1)] if len(t) >= n else [t] if t else []
    return [g for i, g in enumerate(found) if not i or g != found[i - 1]]


@functools.lru_cache(4096)
def token_matrix(text: str) -> np.ndarray:
    """A unit vector of the MD5 bytes of each n-gram."""
    m = np.array([list(hashlib.md5(g.encode()).digest()) for g in ngrams(text)], float).reshape(-1, 16) / 255
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(size == 0, 1, size)


def max_similarity(query: str, doc: str) -> float:
    """Mean over the query's n-grams of the best dot product with the document's; 0 if either has none."""
    q, d = token_matrix(query or ""), token_matrix(doc or "")
    return float((q @ d.T).max(1).mean()) if len(q) and len(d) else 0.0


def max_sim(query, doc) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([max_similarity(p, q) for p, q in zip(x, y, strict=True)])

    return run(query, doc)
