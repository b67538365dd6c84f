"""The offline run: from judgments to triplets, and again with unchanged, reordered and changed inputs."""

import dataclasses

import pytest

from sijill.plans import offline
from sijill.plans.pipeline import Manifest


def tables(spark):
    said = "حكمت المحكمة بما جاء في المادة 7 من نظام العمل، وكذلك المادة 9 من نظام الشركات. "
    judgments = spark.createDataFrame([(i, said * (1 + i % 3), "labor_law") for i in range(12)] + [(99, "short", "labor_law"), (None, said, None)], "id long, text string, category string")
    titles = spark.createDataFrame([(1, "نظام العمل"), (2, "نظام الشركات"), (3, "نظام المرور")], "title_id long, title string")
    chunks = spark.createDataFrame([(c, c % 4, c // 4, f"المادة {c % 12}", "labor_law", f"the content of the chunk {c}") for c in range(60)], "chunk_id long, reg_id long, chunk_index long, article_ref string, category string, content string")
    return {"judgments": judgments, "titles": titles, "chunks": chunks}


def noted(made):
    """The stages, each telling when it is made."""
    return [dataclasses.replace(s, make=lambda *a, _s=s, **k: (made.append(_s.name), _s.make(*a, **k))[1]) for s in offline.stages(near=30)]


def test_run_and_rerun(spark, tmp_path):
    out, path, given, made = str(tmp_path / "out"), str(tmp_path / "m.json"), tables(spark), []
    first = offline.run(spark, given, noted(made), out, Manifest(path, "r"))
    assert made == ["ingest", "citations", "qa", "triplets"] and first["ingest"].count() == 12
    triplets = sorted(first["triplets"].collect())
    assert triplets and {r["reg_id"] for r in triplets} == {1, 2}
    doc = Manifest(path, "r").doc
    counters = doc["stages"]["triplets"]["counters"]
    assert doc["status"] == "done" and counters["total_cases"] == 12 and counters["total_triplets_train"] + counters["total_triplets_val"] == len(triplets)
    assert [a["stage"] for a in doc["artifacts"]] == made and doc["latest"]["triplets"].startswith(out)

    made.clear()  # the same rows in another order and other partitions
    again = {k: t.orderBy(t.columns[0], ascending=False).repartition(3) for k, t in given.items()}
    second = offline.run(spark, again, noted(made), out, Manifest(path, "r"))
    assert made == [] and sorted(second["triplets"].collect()) == triplets
    assert {s["status"] for s in Manifest(path, "r").doc["stages"].values()} == {"reused"}

    more = given | {"titles": given["titles"].where("title_id <> 2")}
    third = offline.run(spark, more, noted(made), out, Manifest(path, "r"))
    assert made == ["citations", "qa", "triplets"] and {r["reg_id"] for r in third["triplets"].collect()} == {1}
    made.clear()  # back to the first inputs: what was written for them is still there
    offline.run(spark, given, noted(made), out, Manifest(path, "r"))
    doc = Manifest(path, "r").doc
    assert made == [] and len(doc["artifacts"]) == 7 and doc["latest"]["citations"] == doc["artifacts"][1]["path"]


def test_a_failure_is_taken_up(spark, tmp_path):
    given = tables(spark)
    broken = [dataclasses.replace(s, make=lambda *a, **k: 1 / 0) if s.name == "citations" else s for s in offline.stages()[:3]]
    m = Manifest(str(tmp_path / "m.json"), "r")
    with pytest.raises(ZeroDivisionError):
        offline.run(spark, given, broken, str(tmp_path / "out"), m)
    assert m.doc["status"] == "failed" and m.doc["stages"]["citations"]["status"] == "failed" and len(m.doc["artifacts"]) == 1
    made = []
    offline.run(spark, given, noted(made)[:3], str(tmp_path / "out"), Manifest(str(tmp_path / "m.json"), "r"))
    assert made == ["citations", "qa"]


def test_fingerprints(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "y", "z"), (2, "y", "z")], "a long, b string, c string")
    same = a.repartition(2).select("c", "a", "b")
    assert offline.fingerprint(a) == offline.fingerprint(same)
    others = [a.distinct(), a.withColumnRenamed("c", "d"), a.selectExpr("cast(a as int) a", "b", "c"), a.selectExpr("a", "c as b", "b as c"), a.fillna(""), a.where("false")]
    assert len({offline.fingerprint(x) for x in [a, *others]}) == 7
