"""Reading order of words on pages against a literal reading of the rules."""

import random
import re
import unicodedata

from sijill.operators import layout

SCHEMA = "doc_id long, page int, pos long, x0 double, top double, text string"
ARABIC = re.compile("[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]")


def read(words):
    """A page's lines from (x0, top, text) in the order of the file."""
    bands = {}
    for x, top, t in words:
        t = unicodedata.normalize("NFKC", t.replace("\0", ""))
        if t.strip():
            bands.setdefault(round(top / 5) * 5, []).append((x, t))
    out = []
    for _, line in sorted(bands.items()):
        line.sort(key=(lambda w: -w[0]) if any(ARABIC.search(t) for _, t in line) else (lambda w: w[0]))
        out.append(" ".join(t[::-1] if ARABIC.search(t) else t for _, t in line))
    return out


def pages(seed=1):
    rng = random.Random(seed)
    said = ["word", "12", "ﻼﻤﻌﻟا", "ماظن", "ﬁne", "x\0y", " ", "　", "\0", "ﷺ", "two²", "مَّ", "שלום"]
    for doc in range(20):
        for page in range(rng.randint(1, 4)):
            # places often tie, and tops stand on the borders of bands
            yield doc, page, [(float(rng.randint(0, 8) * 10), rng.choice([0.0, 2.4, 2.5, 2.6, 7.5, 12.5, 40.0, 41.3, 43.0, 700.25]), rng.choice(said)) for _ in range(rng.randint(0, 25))]


def test_lines_and_texts(spark):
    made = list(pages())
    words = spark.createDataFrame([(d, p, i, x, t, w) for d, p, l in made for i, (x, t, w) in enumerate(l)], SCHEMA).repartition(5)
    lines = {(r["doc_id"], r["page"], r["line"]): r["text"] for r in layout.page_lines(words).collect()}
    assert lines == {(d, p, i): t for d, p, l in made for i, t in enumerate(read(l), 1)}
    listed = spark.createDataFrame([(d, p) for d, p, _ in made], "doc_id long, page int")
    texts = {r["doc_id"]: r["text"] for r in layout.page_texts(layout.page_lines(words), listed).collect()}
    assert texts == {d: "\n\n".join("\n".join(read(l)) for k, _, l in made if k == d).strip() for d in range(20)}


def test_edges(spark):
    words = spark.createDataFrame([(1, 0, 0, None, None, "b"), (1, 0, 1, 0.0, 0.0, "a"), (1, 0, 2, 0.0, 0.0, None), (2, 1, 0, 1.0, 1.0, " "), (3, 0, 0, 5.0, 5.0, "x"), (3, 0, 0, 5.0, 5.0, "x")], SCHEMA)
    assert {(r["doc_id"], r["text"]) for r in layout.page_lines(words).collect()} == {(1, "b a"), (3, "x x")}
    listed = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (4, 0)], "doc_id long, page int")
    plain = spark.createDataFrame([(1, "other"), (2, " ﻼﻤ\nline\0 "), (5, "ﬁne"), (6, None)], "doc_id long, raw string")
    found = {r["doc_id"]: r["text"] for r in layout.pdf_texts(words, listed, plain).collect()}
    assert found[1] == "b a" and found[2] == "لام\nline" and found[4] == "" and found[5] == "ﬁne" and found[6] == ""
    assert layout.page_lines(words.where("false")).collect() == []
