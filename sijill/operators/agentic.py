"""Further retrieval rounds: when to ask a model for gaps, what its answer says, and the queries that it leads to."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sijill.functions import text as T
from sijill.functions import vectors as V
from sijill.operators import ranking
from sijill.session import settled, ship

#: With five times so many regulations found no round follows; queries of fewer characters don't count; rounds of a case.
ENOUGH, LEAST_QUERY, ROUNDS = 3, 5, 2
#: Of a case's text and of its found regulations so much goes into a prompt.
MOST_TEXT, MOST_FOUND = 4000, 15
ANSWER = "has_gaps boolean, gap_description string, refined_queries array<string>, missing_domains array<string>"


def prompt_lines(found: DataFrame, most: int = 10) -> DataFrame:
    """(case_id, n, lines): what was found (case_id, reg_id, title, category, score), best first, for the prompt."""
    rows = found.groupBy("case_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "reg_id", "title", "category"))).alias("x"))
    said = F.transform(F.slice("x", 1, most), lambda x: F.concat(F.lit("- "), F.coalesce(x["title"], F.lit("Unknown")), F.lit(" ("), F.coalesce(x["category"], F.lit("N/A")), F.lit(") — score: "), F.format_string("%.3f", -x["s"])))
    more = F.when(F.col("n") > most, F.array(F.concat(F.lit("... and "), F.col("n") - most, F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return rows.select("case_id", "n", F.array_join(F.concat(said, more), "\n").alias("lines"))


def gap_queries(answers: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(case_id, warning, round, query) of a model's answers (case_id, n_found, raw): a row a query, or one with a null query and why.

    The answer is JSON, possibly in code fences. Enough found, a warning that the answer comes with, no answer, no JSON, no gaps (no
    warning) and no usable query end the rounds; queries under LEAST_QUERY characters are left out, ``rounds`` at most stay.
    """
    if "warning" not in answers.columns:
        answers = answers.withColumn("warning", F.lit(None).cast("string"))
    raw = F.trim(F.coalesce("raw", F.lit("")))
    parsed = F.from_json(T.salvage_json("raw"), ANSWER)
    usable = F.slice(F.filter(F.coalesce("a.refined_queries", F.array().cast("array<string>")), lambda q: F.length(F.trim(q)) >= LEAST_QUERY), 1, rounds)
    rows = answers.select("case_id", "n_found", F.col("warning").alias("given"), raw.alias("raw"), parsed.alias("a")).withColumn("q", usable)
    gaps = F.coalesce("a.has_gaps", F.lit(False))
    warning = (
        F.when(F.col("n_found") >= 5 * ENOUGH, "agentic_sufficient_candidates")
        .when(F.col("given").isNotNull(), F.col("given"))
        .when(F.col("raw") == "", "agentic_empty_response")
        .when(F.col("a").isNull() | F.coalesce("a.has_gaps", "a.gap_description", F.col("a.refined_queries").cast("string"), F.col("a.missing_domains").cast("string")).isNull(), "agentic_parse_failed")
        .when(gaps & (F.size("q") == 0), "agentic_no_queries_generated")
    )
    rows = rows.withColumn("warning", warning).withColumn("q", F.when(F.col("warning").isNull() & gaps, F.col("q")).otherwise(F.array().cast("array<string>")))
    return rows.select("case_id", "warning", F.posexplode_outer("q").alias("round", "query")).select("case_id", "warning", (F.col("round") + 1).alias("round"), "query")


# ------------------------------------------------------------------ rounds


def prompts(cases: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, n_found, prompt) of each case (case_id, text) that has regulations (``found``: case_id, reg_id, title, category, score).

    n_found counts the first MOST_FOUND at most. A null text is empty; cases without a regulation aren't asked about.
    """
    best = V.top_k(found, ["case_id"], [F.desc("score"), F.col("reg_id")], MOST_FOUND, "_r")
    said = F.concat(F.lit("Case:\n"), F.left(F.coalesce("text", F.lit("")), F.lit(MOST_TEXT)), F.lit("\n\nFound:\n"), F.col("lines"))
    return cases.join(prompt_lines(best), "case_id").select("case_id", F.col("n").alias("n_found"), said.alias("prompt"))


def ask(asked: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """(case_id, n_found, raw, warning): what ``model`` answers to each prompt; an error becomes a warning. Enough found: it isn't asked."""
    ship(asked.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            said = [_answer(model, x) if n < 5 * ENOUGH else (None, None) for x, n in zip(p["prompt"], p["n_found"], strict=True)]
            yield pd.DataFrame({"case_id": p["case_id"], "n_found": p["n_found"], "raw": [r for r, _ in said], "warning": [w for _, w in said]})

    return asked.mapInPandas(run, "case_id long, n_found long, raw string, warning string")


def _answer(model: Callable[[str], str], prompt: str) -> tuple[str | None, str | None]:
    try:
        return model(prompt), None
    except TimeoutError:
        return None, "agentic_timeout"
    except Exception as e:  # noqa: BLE001  whatever a provider raises ends the case's rounds, not the job
        return None, f"agentic_error:{type(e).__name__}"


def expanded(passed: DataFrame, queries: DataFrame, units: DataFrame, regulations: DataFrame, cases: DataFrame, profile: ranking.Profile, rounds: int = ROUNDS) -> DataFrame:
    """``passed`` (case_id, reg_id, final_score) and what the rounds of ``queries`` (case_id, round, query) add, with round and unit_pos.

    A round scores its queries against the ``units`` (reg_id, units) of all regulations that the case hasn't got yet: those that
    passed or that an earlier round added are a table, which each round anti-joins and adds to. A regulation's score is its best
    unit's (of equal ones the first), its final score has only the semantic and the category's weight (``regulations``: reg_id,
    category; ``cases``: case_id, case_type), and both face the relaxed gates. Rows that passed have round 0 and no unit. Null
    queries, and cases without a regulation that passed, add nothing.
    """
    ws, _, _, wp = profile.weights
    least = max(0.0, profile.threshold)
    all_ = passed.select("case_id", "reg_id", "final_score", F.lit(0).alias("round"), F.lit(None).cast("long").alias("unit_pos"))
    all_ = settled(all_)
    queries = settled(queries.where("query is not null").join(all_.select("case_id").distinct(), "case_id", "left_semi").select("case_id", "round", "query"))
    for r in range(1, rounds + 1):
        asked = queries.where(F.col("round") == r).select("case_id", F.col("query").alias("text"))
        best = ranking.best_units(asked, units, 1).join(all_.select("case_id", "reg_id"), ["case_id", "reg_id"], "left_anti")
        rows = best.join(regulations.select("reg_id", "category"), "reg_id").join(cases.select("case_id", "case_type"), "case_id")
        rows = rows.withColumn("final_score", ws * F.col("score") + wp * V.category_prior("case_type", "category"))
        new = rows.where((F.col("score") > 0) & (F.col("score") >= 0.8 * least) & (F.col("final_score") >= 0.7 * least))
        all_ = settled(all_.unionByName(new.select("case_id", "reg_id", "final_score", F.lit(r).alias("round"), "unit_pos")))
    return all_
