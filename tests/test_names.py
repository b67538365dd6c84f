"""The fuzzy join of names against all pairs, whatever the length of its lists, and without a cross join in its plan."""

import difflib
import random

import pytest

from sijill.operators import citations, names


def tokens(s):
    return {t for t in s.split() if len(t) > 1}


def score(a, b):
    x, y = tokens(a), tokens(b)
    j = len(x & y) / len(x | y) if x and y else 0.0
    return 0.4 * j + 0.6 * difflib.SequenceMatcher(None, a, b).ratio()


def made(n, seed):
    """Names of one to six words, one of them in half of the names; some with letters lost, doubled or changed, or words joined."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("ابتحدرسعلمنوي") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    out = []
    for _ in range(n):
        name = [rng.choice(words) for _ in range(rng.randint(1, 5))] + ["العامة"] * (rng.random() < 0.5)
        name = list(" ".join(name))
        for _ in range(rng.choice([0, 0, 0, 1, 2, 3])):
            k = rng.randrange(len(name) + 1)
            name[k : k + rng.randint(0, 2)] = [rng.choice("ابتحدرسعلمنوي ")] * rng.randint(0, 2)
        out.append(" ".join("".join(name).split()))
    return out


@pytest.mark.parametrize("least,block", [(0.5, 4096), (0.5, 7), (0.6, 4096), (0.72, 5), (0.95, 4096)])
def test_similar_names_match_all_pairs(spark, monkeypatch, least, block):
    monkeypatch.setattr(names, "BLOCK", block)
    base = made(150, 1)
    left, right = base + ["ا", "اب", "ابت", "", None, "كلمة واحدة"], made(150, 2) + base[:40] + ["ا", "اب", "ابت", "ابتث", "", None, "كلمةواحدة", "واحدة كلمة"]
    a = spark.createDataFrame([(x,) for x in left], "a string")
    b = spark.createDataFrame([(x,) for x in right], "b string")
    found = {(r["a"], r["b"]): r["score"] for r in names.similar(a, b, least).collect()}
    expected = {(x, y): s for x in {*left} for y in {*right} if x and y and (s := score(x, y)) >= least}
    assert found == pytest.approx(expected)
    assert least > 0.6 or any(not tokens(x) & tokens(y) for x, y in expected)  # found by their character pairs


def test_repeated_pairs_come_once_and_without_cross_join(spark):
    rows = spark.createDataFrame([(x, x) for x in made(80, 3)], "a string, b string")
    found = names.similar(rows, rows)
    assert found.count() == found.distinct().count()
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Cross" not in plan
    with pytest.raises(ValueError):
        names.similar(rows, rows, 0.3)


def test_ties_go_to_the_first_title(spark):
    names_ = spark.createDataFrame([("نظام العمل",), ("لائحة العمل",), ("غير معروف تماما",), (None,), ("نظام",)], "name string")
    titles = spark.createDataFrame([(7, "نظام العمل"), (3, "قانون العمل"), (9, None), (None, "العمل"), (4, "نظام العمال")], "title_id long, title string")
    found = {r["name"]: (r["title_id"], r["title"], r["match_score"]) for r in citations.resolve(names_, titles).collect()}
    assert found == {"نظام العمل": (3, "قانون العمل", 1.0), "لائحة العمل": (3, "قانون العمل", 1.0)}
