"""Rounds after a ranking: what is asked, what a failing model leads to, and which regulations each round adds."""

import json

from pyspark.sql import functions as F

from sijill.functions import blocks
from sijill.operators import agentic, ranking
from sijill.plans import queries

CASES = [(1, "first case", "labor"), (2, None, "labor"), (3, "third", None), (4, "nothing passed", "labor"), (5, "case five", "labor")]


def case_table(spark):
    return spark.createDataFrame(CASES, "case_id long, text string, case_type string")


def test_prompts(spark):
    found = spark.createDataFrame([(1, r, f"T{r}", "labor_law", r / 100) for r in range(20)] + [(2, 7, None, None, 0.5)], "case_id long, reg_id long, title string, category string, score double")
    said = {r["case_id"]: r for r in agentic.prompts(case_table(spark), found).collect()}
    assert sorted(said) == [1, 2] and said[1]["n_found"] == 15 and said[2]["n_found"] == 1
    assert said[1]["prompt"].startswith("Case:\nfirst case\n\nFound:\n- T19 (labor_law) — score: 0.190\n") and said[1]["prompt"].endswith("... and 5 more")
    assert said[2]["prompt"] == "Case:\n\n\nFound:\n- Unknown (N/A) — score: 0.500"


def test_a_failing_model_becomes_a_warning(spark):
    def model(prompt):
        if prompt == "slow":
            raise TimeoutError
        if prompt == "broken":
            raise KeyError("x")
        return json.dumps({"has_gaps": True, "refined_queries": [prompt, "four", "further words", "third one"]})

    asked = spark.createDataFrame([(1, 3, "slow"), (2, 3, "broken"), (3, 3, "asked words"), (4, 15, "never asked")], "case_id long, n_found long, prompt string")
    found = {(r["case_id"], r["round"]): (r["warning"], r["query"]) for r in agentic.gap_queries(agentic.ask(asked, model)).collect()}
    assert found == {(1, None): ("agentic_timeout", None), (2, None): ("agentic_error:KeyError", None), (3, 1): (None, "asked words"), (3, 2): (None, "further words"), (4, None): ("agentic_sufficient_candidates", None)}


def test_rounds_match_a_loop(spark):
    profile = ranking.Profile()
    texts = {r: [f"unit {r} common words", ["overtime pay rules", "end of service award", "notice period of work", "overtime pay", "other things entirely", ""][r % 6]] for r in range(24)}
    category = {r: ["labor_law", "civil_law"][r % 2] for r in texts}
    units = spark.createDataFrame([(r, [(i, t) for i, t in enumerate(u)]) for r, u in texts.items()], "reg_id long, units array<struct<unit_pos:long,text:string>>")
    regs = spark.createDataFrame(list(category.items()), "reg_id long, category string")
    passed = [(1, 0, 0.9), (1, 6, 0.8), (3, 1, 0.7), (5, 2, 0.6)]
    asked = [(1, 1, "overtime pay rules"), (1, 2, "notice period of work"), (3, 1, "end of service award"), (3, 2, "other things entirely"), (4, 1, "overtime pay"), (5, 1, None)]
    found = agentic.expanded(spark.createDataFrame(passed, "case_id long, reg_id long, final_score double"), spark.createDataFrame(asked, "case_id long, round int, query string"), units, regs, case_table(spark), profile)

    kind = {c: t for c, _, t in CASES}
    expected = {(c, r): (0, None, s) for c, r, s in passed}
    for step in (1, 2):
        fresh = {}
        for c, n, q in asked:
            if n != step or q is None or c not in {x for x, _, _ in passed}:
                continue
            a = blocks.hash_matrix([q])
            for r, u in texts.items():
                m = blocks.hash_matrix(u)
                s = blocks.rounded((m @ a.T)[:, 0] / (blocks.norms(m) * blocks.norms(a)))
                i = max((k for k, t in enumerate(u) if t), key=lambda k: (s[k], -k))
                final = 0.55 * s[i] + 0.1 * (kind[c] == "labor" and category[r] == "labor_law")
                if (c, r) not in expected and s[i] >= 0.24 and final >= 0.21:
                    fresh[c, r] = (step, i, round(final, 9))
        expected |= fresh
    assert {(r["case_id"], r["reg_id"]): (r["round"], r["unit_pos"], round(r["final_score"], 9)) for r in found.collect()} == expected
    assert {v[0] for v in expected.values()} == {0, 1, 2} and found.count() == len(expected)


def test_registered_rounds_add_regulations(spark):
    rows = queries.QUERIES["agentic_rounds"](spark, "/root/testdata/sf0.01")
    assert rows.count() == rows.select("case_id", "reg_id").distinct().count()
    assert {r["round"] for r in rows.select("round").distinct().collect()} >= {0, 1}
    assert rows.where((F.col("round") > 0) & F.col("unit_pos").isNull()).count() == 0
