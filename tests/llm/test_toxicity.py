"""The lexicon by held-out labels and against a naive search, and the edge cases its docstring defines."""

import math
import random
import zlib

import pytest

from sijill.llm import toxicity as T

DOCS = "doc_id long, text string, lang string, score string, toxic string"
BAD = ["vilgar", "zotter", "kreng"]


def corpus(n=600, seed=1):
    """Texts of invented words; toxic ones hold two bad words with any ending or spelling; clean ones may hold ``kreng fish``."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("bdfgmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(8, 120))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(rng.randint(2, 4)):
                text.insert(rng.randint(0, len(text)), rng.choice(BAD) + rng.choice(["", "", "ig", "ung", "s", "en", "ka"]))
        elif rng.random() < 0.04:
            text.insert(rng.randint(0, len(text)), "kreng fish")
        docs.append((i, " ".join(text), "en", "x", "y"))
        labels.append((i, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = corpus()
    rows, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    return rows, marks, T.learn(rows, marks)


def test_held_out(spark, learned):
    rows, marks, _ = learned
    truth = {r["doc_id"]: r["toxic"] for r in marks.collect()}
    found = T.score(rows, marks).collect()
    held = [r for r in found if r["held_out"]]
    assert len(found) == 600 and {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_labels_of_held_out_rows_teach_nothing(spark, learned):
    rows, marks, _ = learned
    turned = marks.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    key = lambda x: sorted((r["doc_id"], r["score"]) for r in x.collect())
    assert key(T.score(rows, marks)) == key(T.score(rows, turned))


def test_spellings_and_phrases(learned):
    model = learned[2]
    assert {e.strip()[:4] for e in model.weights} == {"vilg", "zott", "kren"} and " kreng fish " in model.phrases
    bad = model.score("you vilgar zotter")
    # digits and signs, look-alikes of other scripts, full width, invisible characters, capitals
    for text in ("you v1lg4r z0773r", "you vi1gar zotter", "you vіlgаr zоttеr", "you ｖｉｌｇａｒ ZOTTER", "you vil​gar, zot­ter!", "you v1lg@r zοtter"):
        assert model.score(text) == pytest.approx(bad), text
    assert bad > 0.5 > model.score("you are kind")
    assert model.score("a kreng fish and kreng fish") == model.score("a fresh fish and other fish")
    assert model.score("1078 3457 вилка") == model.score("a b c")


def naive(model, text):
    """The sum of weights, entry by entry at each place."""
    line, n = T.folded(text)
    free = {at + k for p in model.phrases for at in range(len(line)) if line.startswith(p, at) for k in (0, p.index(" ", 1))}
    return math.fsum(w for e, w in model.weights.items() for at in range(len(line)) if line.startswith(e, at) and at not in free), n


def test_sums_match_a_naive_search(learned, monkeypatch):
    model = learned[2]
    texts = [r[1] for r in corpus(60, 5)[0]] + ["", " ", "vilgar", "kreng fish kreng", "vilgar " * 300, "x" * 5000, "kreng\n" * 40 + "fish"]
    expected = [naive(model, t) for t in texts]
    for size in (T.PIECE, 40, 7):  # long texts are worked on in pieces
        monkeypatch.setattr(T, "PIECE", size)
        for t, (weight, n) in zip(texts, expected, strict=True):
            assert model.sums(t) == (pytest.approx(weight), n)


def test_copies_make_no_entries(spark):
    docs, labels = corpus(300)
    copied = "an odd but harmless sentence of many copies that someone marked"
    docs += [(1000 + i, copied, "en", "x", "y") for i in range(60)]
    labels += [(1000 + i, 1) for i in range(60)]
    model = T.learn(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.weights and not any(e.strip() in copied for e in model.weights)


def test_edges(spark, learned):
    rows, marks, _ = learned
    odd = spark.createDataFrame([(1, None, "", "", ""), (2, "", None, None, None), (3, "  \n", "", "", ""), (None, "vilgar zotter", "", "", ""), (1, "vilgar zotter kreng", "", "", ""), (4, "vilgar " * 200_000, "", "", "")], DOCS)
    mixed = marks.union(spark.createDataFrame([(None, 1), (700, None), (2, 0), (2, 1), (5, 7)], "doc_id long, toxic int"))
    found = T.score(rows.union(odd), mixed).collect()
    by = [r for r in found if r["doc_id"] in (None, 2, 3)]
    assert len(found) == 606 and not [r for r in found if r["doc_id"] is None][0]["held_out"]
    empty = {r["score"] for r in by if r["doc_id"] in (2, 3)}
    assert min(empty) < 0.5 and all(r["predicted"] == 1 for r in found if r["doc_id"] in (None, 4) and r["score"] > 0.9)
    assert T.score(rows.where("false"), marks).collect() == []
    assert {r["score"] for r in T.score(rows, marks.where("toxic = 0")).collect()} == {0.0}
    assert {r["score"] for r in T.score(rows, marks.where("false")).collect()} == {0.0}
