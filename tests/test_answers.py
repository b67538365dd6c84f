"""Malformed answers of a model keep what is valid, against the rules in plain Python."""

import json

from pyspark.sql import functions as F

from sijill.functions import answers as A

VALUES = [None, "", "  ", "text", " padded\n", 0, 7, 2.5, 0.5, True, False, [], ["a", 1], {}, {"k": "v"}, "x" * 500, "must pay a penalty"]


def objects(raw):
    return [x for x in raw if isinstance(x, dict)] if isinstance(raw, list) else []


def said(x):
    return json.dumps(x, separators=(",", ":")) if isinstance(x, (list, dict)) else str(x)


def text(x, default=""):
    return (said(x) if x else default).strip() or default


def severity(t):
    return "high" if "penalty" in t else "low"


def bullets(raw, limit):
    rows = [(text(x.get("title"), "T"), text(x.get("description")), x.get("severity")) for x in objects(raw)]
    return [(t, d[:450], said(s) if s is not None else severity(d)) for t, d, s in rows if d][:limit]


def dates(raw, limit):
    rows = [(text(x.get("label"), A.DATE_LABEL)[:120], text(x.get("value")), x.get("source")) for x in objects(raw)]
    return [(n, v[:120], said(s)[:120] if s else None) for n, v, s in rows if v][:limit]


def cited(raw, limit):
    rows = [(text(x.get("snippet")), x.get("section_ref"), x.get("relevance")) for x in objects(raw)]
    return [(s[:400], said(r)[:120] if r else None, float(n) if isinstance(n, (int, float)) else None) for s, r, n in rows if s][:limit]


def test_malformed_answers(spark):
    lists = [[{a: v, b: w, c: u} for v in VALUES for w, u in ((VALUES[k], VALUES[-k]),)] for k in range(len(VALUES)) for a, b, c in (("title", "description", "severity"),)]
    more = [[{"label": v, "value": w, "source": u} for v, w, u in zip(VALUES, VALUES[k:] + VALUES[:k], reversed(VALUES), strict=True)] for k in range(len(VALUES))]
    refs = [[{"snippet": w, "section_ref": v, "relevance": u} for v, w, u in zip(VALUES, VALUES[k:] + VALUES[:k], VALUES[::-1], strict=True)] for k in range(len(VALUES))]
    made = [{"b": b, "key_dates": d, "citations": c} for b, d, c in zip(lists, more, refs, strict=True)]
    made += [{"b": ["no object", 5, None, [], {"description": "good"}], "key_dates": "no list", "citations": {"snippet": "no list"}}, {}, {"b": None}]
    rows = [(i, ["", "```json\n", "Here it is: "][i % 3] + json.dumps(x, ensure_ascii=i % 2 == 0) + ["", "\n```", " - done"][i % 3]) for i, x in enumerate(made)]
    rows += [(900, None), (901, ""), (902, "no json"), (903, "{broken"), (904, '[{"description": "a list"}]x'), (905, '{"b": [}')]
    v = A.answer("raw")
    table = spark.createDataFrame(rows, "id long, raw string").repartition(3)
    found = {r["id"]: r for r in table.select("id", A.bullets(v, "b", "T", 5).alias("b"), A.key_dates(v, limit=7).alias("d"), A.citations(v, limit=30).alias("c")).collect()}
    for i, x in enumerate(made):
        assert [tuple(r) for r in found[i]["b"]] == bullets(x.get("b"), 5), i
        assert [tuple(r) for r in found[i]["d"]] == dates(x.get("key_dates"), 7), i
        assert [tuple(r) for r in found[i]["c"]] == cited(x.get("citations"), 30), i
    assert all(not found[i][c] for i in (900, 901, 902, 903, 905) for c in "bdc")
    assert table.where(F.lit(False)).select(A.bullets(v, "b", "T", 5)).collect() == []
