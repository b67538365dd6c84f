"""Ranked search against brute force, whatever tier proves an item, and on the edge cases its docstring defines."""

import math
import random
import re
from collections import Counter

import pytest

from sijill.llm import search as S
from sijill.llm.common import prepare

DOCS = "doc_id long, text string, lang string, score long, item_id long, row long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    own = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    count, length = len(own), sum(c.total() for _, c in own)
    df = Counter(x for _, c in own for x in c)
    out = []
    for item, text in items:
        found = []
        for d, c in own:
            m = 75 + 25 * c.total() * count // length
            score = sum(n * math.floor(1000 * math.log((2 * count + 2) / (2 * df[x] + 1))) * (1_000_000_000 * c[x] // (1000 * c[x] + 12 * m)) for x, n in Counter(terms(text)).items() if c[x])
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:20], 1)]
    return sorted(out, key=str)


def corpus(n=400, seed=3):
    """Texts of words of very unequal frequency, with passages of the items in some and groups of copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Ünï", "日本", "a1b2"]
    say = lambda k: " ".join(words[int(len(words) * rng.random() ** 3)] for _ in range(k))
    items = [(i, say(rng.randint(3, 25))) for i in range(12)]
    docs = [(i, say(rng.randint(1, 80))) for i in range(n)]
    docs += [(n + k, f"{say(rng.randint(0, 30))}, {items[k % 4][1]} {say(5)}") for k in range(100)]
    return docs + [(n + 200 + k, docs[7][1]) for k in range(60)], items


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, "en", 5, 6, 7) for d, t in docs], DOCS), spark.createDataFrame(items, "item_id long, text string")


def rows(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("least,shares", [(S.LEAST, S.SHARES), ((1, 3), (0.01, 0.1)), ((8, 60), (0.05, 0.3)), ((10_000, 10_000), (1, 1))])
def test_search_matches_brute_force(spark, monkeypatch, least, shares):
    monkeypatch.setattr(S, "LEAST", least)
    monkeypatch.setattr(S, "SHARES", shares)
    docs, items = corpus()
    a, b = frames(spark, docs, items)
    assert rows(S.search(a.repartition(5), b)) == brute(docs, items)


def test_items_fall_through_to_lower_tiers(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAST", (30, 90))
    monkeypatch.setattr(S, "SHARES", (0.01, 0.1))
    docs, items = corpus()
    rare = " ".join(f"rare{k}" for k in range(6))  # all its postings are in the first tier
    docs += [(5000 + k, f"{rare} {t}") for k, (_, t) in enumerate(docs[:25])]
    a, b = frames(spark, docs, [*items, (99, rare)])
    prepare(spark)
    (block,) = S._blocks(b)
    tiers, weights = S.index(a, spark.sparkContext.broadcast(block))
    proved = [{block.ids[r["item"]] for r in t.select("item").distinct().collect()} for t in S._searched(tiers, weights)]
    assert len(proved) > 1 and 99 in proved[0] and len(proved[-1]) < len(items) + 1 and sorted(x for p in proved for x in p) == sorted([*range(12), 99])


def test_bounds_hold(spark):
    """Of each posting outside the first tiers the impact is within its term's bound, and the tiers hold each posting once."""
    docs, items = corpus()
    a, b = frames(spark, docs, items)
    (block,) = S._blocks(b)
    tiers, weights = S.index(a, spark.sparkContext.broadcast(block))
    seen = Counter()
    for r in tiers.collect():
        for k in range(1, S.TIERS + 1):
            for t, c in zip(r[f"term{k}"], r[f"impact{k}"], strict=True):
                seen[r["doc_id"], t] += 1
                assert all(c <= weights.bounds[j][t] for j in range(1, k))
    assert set(seen.values()) == {1}
    assert len(seen) == sum(len(set(terms(t)) & {x for _, i in items for x in terms(i)}) for _, t in docs)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " .,; "), (None, "alpha beta"), (4, "alpha beta " * 50_000), (5, "Alpha"), (5, "Alpha"), (6, "ÄLPHA älpha"), (7, "beta gamma"), (8, "delta")]
    items = [(1, "alpha"), (2, None), (3, ""), (4, "..."), (5, "unknown words"), (6, "ÄLPHA"), (7, "alpha alpha beta")]
    a, b = frames(spark, docs, items)
    assert rows(S.search(a, b)) == brute(docs, items)
    assert rows(S.search(a, b.union(b))) == brute(docs, items)
    assert rows(S.search(a.where("false"), b)) == rows(S.search(a, b.where("false"))) == rows(S.search(a.where("doc_id < 4"), b)) == []


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(S, "ITEMS", 5)
    docs, items = corpus(60)
    assert rows(S.search(*frames(spark, docs, items))) == brute(docs, items)


def test_sums_are_exact():
    import numpy as np

    values = np.array([(1 << 60) + 1, 3, (1 << 55) + 7], np.int64)
    assert S._total(values, np.array([0, 0, 2]), 3).tolist() == [(1 << 60) + 4, 0, (1 << 55) + 7]
