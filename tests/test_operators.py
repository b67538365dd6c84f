import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sijill.functions import blocks
from sijill.operators import agentic, chat, citations, fragments, insights, ranking, training
from sijill.plans import pipeline
from sijill.plans import queries as registered
from sijill.session import ship
from sijill.sources import extract, fetch, tables
from sijill.streaming import paged


def fixture(spark, case_type, text, regs):
    cases = spark.createDataFrame([(1, case_type, text)], "case_id long, case_type string, text string")
    frags = spark.createDataFrame([(1, "f0", 0, "case", text, False)], "case_id long, fragment_id string, frag_pos long, source string, text string, auto boolean")
    units = spark.createDataFrame([(r, 0, t) for r, _, t in regs], "reg_id long, unit_pos long, text string")
    rows = spark.createDataFrame([(r, c, True) for r, c, _ in regs], "reg_id long, category string, fallback boolean")
    return cases, frags, units, rows


def test_composite_finds_the_related_regulation(spark):
    p = ranking.Profile(strict=False, threshold=0.1)
    cases, frags, units, regs = fixture(spark, "commercial", "breach of a supply contract and late delivery of goods", [(201, "commercial_law", "supply contract delivery of goods between merchants"), (202, "labor_law", "working hours of an employee"), (203, "civil_law", "ownership of land")])
    rows = ranking.composite(ranking.features(ranking.compared(frags, ranking.grouped_units(units), p), frags, p), regs, cases, p)
    found = [r["reg_id"] for r in ranking.ranked(ranking.gate(rows, p), p).orderBy("rank").collect()]
    assert found[0] == 201
    assert ranking.gate(rows, ranking.Profile(threshold=0.1)).count() <= len(found)


def test_profile_weights():
    assert ranking.Profile(semantic=0, support=0, lexical=0, category=0).weights == ranking.Profile().weights
    assert sum(ranking.Profile(semantic=1, support=1).weights) == pytest.approx(1)


def test_diversified_lines():
    assert ranking.diversified([("a", 1), ("a", 2), ("b", 1), ("b", 3)]) == [0, 3, 1]
    assert ranking.diversified([("a", 1)]) == [0]


def test_blend(spark):
    rows = spark.createDataFrame([(1, 1, 0.80), (1, 2, 0.7), (1, 3, 0.6)], "case_id long, reg_id long, final_score double")
    verdicts = spark.createDataFrame([(1, 1, True, "high"), (1, 2, False, "low"), (1, 99, True, "high")], "case_id long, reg_id long, applicable boolean, confidence string")
    found = {r["reg_id"]: (r["status"], round(r["blended"], 6)) for r in ranking.blend(rows, verdicts).collect()}
    assert found == {1: ("approved", 0.83), 3: ("skipped", 0.6)}


def test_stage_label():
    assert ranking.stage_label() == "composite_v1"
    assert ranking.stage_label(hyde=True, agentic=True, colbert=True, rerank_=True, gemini=True) == "hyde_composite_agentic_colbert_rerank_gemini_v1"


def test_citations(spark):
    ship(spark)
    text = "المادة 75 من نظام العمل السعودي، والمادة 75 من نظام العمل. ثم المادة ٨ وكذلك " + "كلام " * 10
    rows = citations.extract(spark.createDataFrame([(1, text), (2, "قصير")], "id long, text string"))
    found = {(r["pattern"], r["article_ref"], r["name"], r["article_number"]) for r in rows.collect()}
    assert found == {(0, "75", "العمل", 75), (2, "٨", "", 8)}
    titles = spark.createDataFrame([(5, "نظام العمل"), (6, "نظام الشركات")], "title_id long, title string")
    done = citations.with_confidence(rows, citations.resolve(rows.where("name <> ''"), titles)).collect()
    assert {(r["article_ref"], r["title_id"], r["confidence"]) for r in done} == {("75", 5, "high"), ("٨", None, "low")}


def test_amendment(spark):
    rows = spark.createDataFrame([(1, "A. B.", "A. C. C.")], "doc_id long, old_text string, new_text string")
    assert {(r["change"], r["sentence"]) for r in insights.amendment(rows).collect()} == {("added", "C."), ("removed", "B.")}


def test_merge(spark):
    a = spark.createDataFrame([("x", 0, 1), ("", 1, 2), (None, 2, 3)], "id string, pos long, v int")
    b = spark.createDataFrame([("x", 0, 4), ("y", 1, 5)], "id string, pos long, v int")
    assert {(r["id"], r["v"]) for r in training.merge([a, b]).collect()} == {("x", 1), ("y", 5)}
    assert tuple(training.merge_stats([a, b]).first()) == (2, 1, 2)


def test_extraction(spark):
    ship(spark)
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    rows = [("text/html", "a", b"<p>A <b>b</b><script>x</script></p>"), ("", "a.pdf", b"<!DOCTYPE html><p>h"), ("", "a.docx", docx.getvalue()), ("", "a.csv", b"x;y\n1;2\n;\n"), ("", "a.doc", b"?"), ("text/plain", "b", b" t \xff"), (None, None, None)]
    found = extract.extract(spark.createDataFrame(rows, "content_type string, name string, content binary"), strict=True).collect()
    got = [(r["method"], r["status"], r["text"]) for r in found]
    assert got[:4] == [("html", "ok", "A b"), ("html", "ok", "h"), ("docx", "ok", "Hi a | b"), ("csv", "ok", "x | y 1 | 2")]
    assert got[4][1] == "error" and got[5][2] == "t �" and got[6][1] == "error"


def test_urls(spark):
    rows = spark.createDataFrame([("https://a.gov.sa/x",), ("http://a.gov.sa",), ("https://evilgov.sa",), ("https://10.0.0.1",), (None,)], "u string")
    assert [r[0] for r in rows.select(extract.allowed_url("u", ("gov.sa",))).collect()] == [True, False, False, False, False]


def test_chat_history(spark):
    rows = spark.createDataFrame([(1, t, r, "x" * 6000) for t, r in enumerate(["system", "user", "assistant", "user"])], "conv_id long, turn long, role string, text string")
    found = chat.history(rows, 2).orderBy("turn").collect()
    assert [r["role"] for r in found] == ["user", "model", "user"] and found[0]["text"].endswith("…(truncated)")


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n\n{bad\n{"id": "2"}\n')
    assert tables.json_lines(spark, str(tmp_path / "a.jsonl"), "id string").count() == 2
    assert tables.invalid_lines(spark, str(tmp_path / "a.jsonl"), "id string").count() == 1


def test_pipeline_resumes(tmp_path):
    done, m = [], pipeline.Manifest(str(tmp_path / "m.json"), "r")
    stages = {"merge": lambda: done.append("merge"), "citations": lambda: 1 / 0}
    with pytest.raises(ZeroDivisionError):
        pipeline.run(stages, "citations,merge", m)
    stages["citations"] = lambda: done.append("citations")
    assert pipeline.run(stages, None, pipeline.Manifest(str(tmp_path / "m.json"), "r")).doc["status"] == "done" and done == ["merge", "citations"]
    with pytest.raises(ValueError):
        pipeline.chosen("merge,other")


def test_paged_source(spark):
    ship(spark)
    waits, calls = [], []

    def flaky(page):
        calls.append(page)
        if len(calls) < 3:
            raise OSError
        return [("a", page, "t")]

    assert paged.fetched(flaky, 0, pause=waits.append) == [("a", 0, "t")] and waits == [4.0, 8.0]
    source = paged.paged_source("pages_test", lambda p: [(f"{p}-{i}", p, "t") for i in range(2)], 3)
    rows = paged.read(spark, source)
    assert rows.count() == 6 and paged.unseen(rows, rows.where("page = 0")).count() == 4


def test_registered_queries_have_oracles():
    assert len(registered.QUERIES) >= 55 and set(registered.ORACLES) == set(registered.QUERIES)


def test_envelope_limits(spark, small):
    from sijill.plans import queries
    from sijill.sources import extract

    assert (extract.MOST_BYTES, extract.MOST_CHARS) == (15_000_000, 120_000)
    rows = spark.createDataFrame([(1, "text", 15_000_000, "x" * 120_001), (2, "text", 15_000_001, "x"), (3, "text", 20_001, "x" * 2_001)], "doc_id long, method string, size long, raw string")
    found = {r["doc_id"]: (r["status"], r["error_code"], len(r["text"] or ""), list(r["warnings"])) for r in extract.envelope(rows).collect()}
    assert found == {1: ("ok", None, 120_000, ["text_truncated"]), 2: ("error", "payload_too_large", 0, []), 3: ("ok", None, 2_001, [])}
    assert queries.QUERIES["extraction_envelope"](spark, small).where("status <> 'ok' or warnings <> ''").count() == 0


def test_full_stats_and_history(spark, small):
    from sijill.plans import queries

    said = queries.QUERIES["citations_resolved"](spark, small).groupBy("confidence").count().collect()
    got = queries.QUERIES["citation_stats"](spark, small).first()
    assert {k: got[k] for k in ("high", "medium", "low") if got[k]} == {r["confidence"]: r["count"] for r in said} and got["high"] > 0
    turns = {}
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"]))
    kept = {(c, t) for c, rows in turns.items() for t, role in sorted(rows)[-20:] if role in ("user", "assistant", "model")}
    assert {(r["conv_id"], r["turn"]) for r in queries.QUERIES["history_trim"](spark, small).collect()} == kept
    assert max(map(len, turns.values())) > 4


def test_scores_match_brute_force(spark):
    ship(spark)
    rng = np.random.default_rng(3)
    v = rng.integers(-5, 6, (60, 8)).astype(float)
    v[5], v[9] = 0.0, v[8]
    rows = spark.createDataFrame([(i, x.tolist(), str(i % 3)) for i, x in enumerate(v)] + [(99, None, "0")], "id long, what array<double>, grp string").repartition(5)
    q = rows.where("id % 7 = 0 and id < 99").select("id", "what")
    n = np.where((v * v).sum(1) == 0, 1, np.sqrt((v * v).sum(1)))
    s = v @ v.T / n[:, None] / n
    every = {(r["query_id"], r["id"]): r["score"] for r in blocks.scored(q, rows.drop("grp")).collect()}
    assert every == pytest.approx({(a, b): s[a, b] for a in range(0, 60, 7) for b in range(60)})
    best = blocks.scored(q, rows, 2).collect()
    for a in range(0, 60, 7):
        for g in range(3):
            found = sorted((r for r in best if r["query_id"] == a and r["grp"] == str(g)), key=lambda r: (-round(r["score"], 6), r["id"]))[:2]
            assert [r["id"] for r in found] == sorted(range(g, 60, 3), key=lambda b: (-round(s[a, b], 6), b))[:2]
    assert blocks.scored(q.limit(0), rows).count() == 0


def test_query_blocks_change_nothing(spark, small, monkeypatch):
    expected = sorted(map(tuple, registered.QUERIES["sim_rank"](spark, small).collect()))
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 8 * 1024 * 7)
    assert sorted(map(tuple, registered.QUERIES["sim_rank"](spark, small).collect())) == expected


def test_fragments_and_units(spark):
    ship(spark)
    cases = spark.createDataFrame([(1, "one\n\n" + "two " * 30), (2, "x"), (3, "  ")], "case_id long, text string")
    given = spark.createDataFrame([(2, "f", 0, "document", "word. " * 200), (2, "g", 1, "case", " kept  as it is "), (2, "h", 2, "case", " ")], "case_id long, fragment_id string, pos long, source string, text string")
    rows = fragments.case_fragments(cases, given).orderBy("case_id", "frag_pos").collect()
    assert [r["fragment_id"] for r in rows if r["case_id"] == 1] == ["case_seg_00", "case_seg_01"]
    own = [r for r in rows if r["case_id"] == 2]
    assert [r["fragment_id"] for r in own][:2] == ["f:s00", "f:s01"] and own[-1]["text"] == " kept  as it is " and not own[-1]["auto"] and own[0]["auto"]
    more = fragments.with_hypotheses(fragments.case_fragments(cases), fragments.hypotheses(cases, lambda t, arabic: "a hypothetical article" if "two" in t else ""))
    assert [r["source"] for r in more.where("case_id = 1").orderBy("frag_pos").collect()] == ["case", "case", "hyde"] and more.where("case_id = 2").count() == 1
    assert fragments.hypotheses(cases).where("warning = 'hyde_disabled' and text is null").count() == 3
    regs = spark.createDataFrame([(1, "T", "c", "body"), (2, " T ", None, " "), (3, None, "", None)], "reg_id long, title string, category string, content_text string")
    chunks = spark.createDataFrame([(1, 0, 10, "  "), (4, 1, 11, " said ")], "reg_id long, chunk_index long, chunk_id long, text string")
    assert {(r["reg_id"], r["text"], r["fallback"]) for r in fragments.regulation_units(regs, chunks).collect()} == {(1, "T (c) body", True), (2, "T", True), (4, "said", False)}


def test_triplet_fallbacks(spark):
    cases = spark.createDataFrame([(1, "x" * 60, "a"), (2, "y" * 60, "none"), (3, "short", "a"), (4, "z" * 60, "a")], "id long, text string, category string")
    cited = spark.createDataFrame([(1, 1, None), (2, 1, 5), (3, 1, None), (4, None, None)], "id long, reg_id long, article_number long")
    chunks = spark.createDataFrame([(c, c % 3, 0, f"المادة {c}", "a" if c < 4 else "b", f"content of the chunk {c}" if c != 2 else "tiny") for c in range(1, 7)], "chunk_id long, reg_id long, chunk_index long, article_ref string, category string, content string")
    scores = spark.createDataFrame([(1, 3, 0.9), (1, 1, 0.8), (1, 2, 0.7)], "id long, chunk_id long, score double")
    first = training.latest_first_chunk(chunks.withColumn("version_id", chunks["reg_id"]), spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "version_id long, version_number long"))
    made = training.triplets(cases, cited, chunks, scores, first)
    rows = made.collect()
    assert {r["id"] for r in rows} == {1, 2} and {r["positive"] for r in rows} == {"content of the chunk 1"}
    assert {(r["negative"], r["origin"]) for r in rows if r["id"] == 1} == {("content of the chunk 3", "hard"), ("content of the chunk 3", "random")}
    assert {r["origin"] for r in rows if r["id"] == 2} <= {"random", "any"} and all("chunk 1" not in r["negative"] and "chunk 4" not in r["negative"] for r in rows)
    again, counts = training.counted_triplets(cases, cited, chunks, scores, first)
    assert sorted(again.collect()) == sorted(rows)
    assert counts == {"total_cases": 4, "skipped_no_text": 1, "cases_with_citations": 3, "cases_with_resolved_citations": 2, "total_positives_found": 2, "skipped_no_positive": 0, "total_triplets_train": len([r for r in rows if r["split"] == "train"]), "total_triplets_val": len([r for r in rows if r["split"] == "val"])}
    more = cited.union(spark.createDataFrame([(1, 2, None), (1, 2, None), (2, 77, 1), (2, 1, 5)], "id long, reg_id long, article_number long"))
    counts = training.counted_triplets(cases, more, chunks, scores, first, query=20)[1]
    assert (counts["total_positives_found"], counts["skipped_no_positive"]) == (3, 3)  # the tiny chunk twice, a regulation without chunks, a repeated citation
    counts = training.counted_triplets(cases, more, chunks, scores, first, query=1000)[1]
    assert (counts["skipped_no_text"], counts["total_positives_found"], counts["skipped_no_positive"], counts["total_triplets_train"]) == (3, 0, 0, 0)


def test_draws_fall_back_to_the_whole_category(spark, monkeypatch):
    monkeypatch.setattr(training, "DRAWN", 2)
    chunks = spark.createDataFrame([(c, c, "a", "long enough content here") for c in range(40)], "chunk_id long, reg_id long, category string, content string")
    cases = spark.createDataFrame([(i, "a") for i in range(30)], "id long, category string")
    found = training.drawn(cases, spark.createDataFrame([(i, i) for i in range(30)], "id long, reg_id long"), chunks, 3).collect()
    by = {}
    for r in found:
        by.setdefault(r["id"], set()).add(r["chunk_id"])
    assert len(by) == 30 and all(len(c) == 3 and i not in c for i, c in by.items())


def test_measures_and_reports(spark):
    base, tuned = (spark.createDataFrame(x, "metric string, value double") for x in ([("m", 0.5), ("only", 1.0)], [("m", 0.75)]))
    assert [tuple(r) for r in training.improvement(base, tuned).collect()] == [("m", 0.5, 0.75, 0.25)]
    rows = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.9)], "checkpoint string, cosine_accuracy_10 double")
    assert tuple(training.best_checkpoint(rows).first()) == ("c", 0.9)


def test_sentence_analyses(spark):
    ship(spark)
    rows = spark.createDataFrame([(1, "You must pay. You MUST pay. A fine follows."), (2, " "), (3, None), (4, "Plain words. More words.")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in insights.analysis(rows).collect()}
    assert [b["description"] for b in got[1]["obligations"]] == ["You must pay."] and got[1]["risk_flags"][0]["severity"] == "high"
    assert got[2]["status"] == got[3]["status"] == "error" and got[3]["obligations"] == []
    assert [b["title"] for b in got[4]["risk_flags"]] == ["مؤشر مخاطر"] * 2
    pair = spark.createDataFrame([(1, "A. B.", "A. B."), (2, "", "x")], "doc_id long, old_text string, new_text string")
    same = {r["doc_id"]: r for r in insights.impact(pair).collect()}
    assert same[1]["minor"] and same[1]["what_changed"] == [] and len(same[1]["legal_impact"]) == 2 and same[2]["status"] == "error"
    marked = spark.createDataFrame([(1, 1, 0, "later", 2), (1, 1, 3, "first", 1), (1, 1, 9, "none", 9)], "case_id long, doc_id long, index long, text string, rank long")
    assert insights.case_summary(marked).first()["summary"] == "later first"


def test_gap_answers(spark):
    found = spark.createDataFrame([(1, r, f"t{r}", None, r / 100) for r in range(12)], "case_id long, reg_id long, title string, category string, score double")
    said = agentic.prompt_lines(found).first()
    assert said["lines"].split("\n")[0] == "- t11 (N/A) — score: 0.110" and said["lines"].endswith("... and 2 more")
    rows = spark.createDataFrame([(1, 0, '{"has_gaps": true, "refined_queries": ["a good query", "x"]}'), (2, 0, None), (3, 99, "{}"), (4, 0, "[1]")], "case_id long, n_found long, raw string")
    assert {(r["case_id"], r["warning"], r["query"]) for r in agentic.gap_queries(rows).collect()} == {(1, None, "a good query"), (2, "agentic_empty_response", None), (3, "agentic_sufficient_candidates", None), (4, "agentic_parse_failed", None)}


def test_other_sources(spark, tmp_path, monkeypatch):
    ship(spark)
    regs = spark.createDataFrame([(1, "t", "c", "active"), (2, "u", "d", "old")], "id long, title string, category string, status string")
    assert tables.active_regulations(regs).count() == 1
    chunks = spark.createDataFrame([(1, 1, [1.0]), (2, 1, None)], "id long, regulation_id long, embedding array<double>")
    assert [r["id"] for r in tables.embedded_chunks(chunks, regs.drop("status")).collect()] == [1]
    monkeypatch.delenv("DATABASE_URL", raising=False)
    (tmp_path / ".env").write_text("A=1\nDATABASE_URL='db://x'\n")
    assert tables.database_url((str(tmp_path),)) == "db://x" and tables.database_url(("/nowhere",)) is None
    tables.write_csv(regs, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert tables.write_stats(regs.groupBy().count(), str(tmp_path / "s.json")) == {"count": 2}
    tables.write_errors(spark.createDataFrame([("1", "bad")], "id string, error string"), str(tmp_path / "errors"))
    assert spark.read.json(str(tmp_path / "errors")).first()["error"] == "bad"
    said = spark.createDataFrame([('{"pages": [{"text": "a"}, "b"], "x": 1}',), ("nothing",), (None,)], "j string").select(extract.harvest("j")).collect()
    assert [r[0] for r in said] == ["a\nb", "", ""]
    plan = fetch.ocr_plan(spark.createDataFrame([("pdf", 10, False), ("pdf", 900, False), ("html", 0, False)], "method string, n_chars long, rtl boolean"), None, "second")
    assert [(r["needs_ocr"], r["provider"]) for r in plan.collect()] == [(True, "second"), (False, None), (False, None)]
    assert extract.rtf_text(rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\f0 Caf\'e9 \b bold\b0\par next \u1593?}".decode()) == "Café bold\nnext ع"


def test_scores_of_texts_are_those_of_the_dense_product(monkeypatch):
    rng = np.random.default_rng(5)
    words = ["labor", "Contract", "case", *[f"w{i}" for i in range(300)]]
    texts = [" ".join(rng.choice(words, n)) for n in (1, 5, 40, 2000, 7)] + [None, "", "  ", "x" * 1500]
    block = blocks.hash_matrix([t for t in texts if t])
    m, n = blocks.hash_matrix(texts), blocks.norms(block)
    dense = (m @ block.T) / (blocks.norms(m)[:, None] * n)
    assert (blocks.text_scores(texts, block.T.copy(), n) == dense).all()
    monkeypatch.setattr(blocks, "PRODUCT_BYTES", 8 * block.shape[0] * 3)
    assert (blocks.text_scores(texts, block.T.copy(), n) == dense).all()
    assert blocks.text_scores([None], block.T.copy(), n).tolist() == [[0.0] * len(n)]


def test_a_unit_is_cut_into_tokens_once(spark):
    p = ranking.Profile(strict=False, threshold=0.1)
    cases, frags, units, regs = fixture(spark, "commercial", "late delivery of goods, 3 days", [(201, "commercial_law", "Delivery of goods, of goods in 3 days"), (202, "labor_law", "?!"), (203, "civil_law", "land")])
    pairs = ranking.compared(frags, ranking.grouped_units(units), p)
    assert {r["reg_id"]: r["lexical_overlap"] for r in pairs.collect()} == {201: 4 / 6, 202: 0.0, 203: 0.0}
    rows = ranking.gate(ranking.composite(ranking.features(pairs, frags, p), regs, cases, p), p)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(lower") == 1


def test_a_task_passes_on_what_multi_source_and_hard_negatives_need(spark):
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.normal(size=(80, 6)), np.repeat(rng.normal(size=(4, 6)), 10, 0)])  # copies tie
    v[40:60] = v[0] + rng.normal(size=(20, 6)) / 4  # some are relevant
    kinds, tiers = ("regulation", "judgment"), ("official", "trusted", "unverified", "unknown")
    rows = [(i, kinds[i % 2], tiers[int(t)], i, x.tolist()) for i, (x, t) in enumerate(zip(v, rng.integers(0, 4, len(v)), strict=True))]
    sources = spark.createDataFrame(rows, "source_id long, source_type string, trust_tier string, pos long, what array<double>").repartition(4)
    cases = sources.where("source_id % 15 = 0").select(F.col("source_id").alias("case_id"), "what")
    every = blocks.scored(cases.select(F.col("case_id").alias("id"), "what"), sources.select(F.col("source_id").alias("id"), "what")).select(F.col("query_id").alias("case_id"), F.col("id").alias("source_id"), "score")
    few = ranking.source_scores(cases, sources, 5, 0.1)
    assert few.count() < every.count()
    found = [sorted(map(tuple, ranking.multi_source(best, sources.drop("what"), 5, 0.1).collect())) for best in (every, few)]
    assert found[0] == found[1] and len(found[0]) > 20
    own = cases.select(F.col("case_id").alias("id"), F.explode(F.array(F.col("case_id") % 5, F.lit(3))).alias("reg_id"))
    chunks = sources.select(F.col("source_id").alias("chunk_id"), (F.col("source_id") % 5).alias("reg_id"), F.lit("a content that is long enough").alias("content"))
    best = blocks.scored(cases.select(F.col("case_id").alias("id"), "what"), sources.select(F.col("source_id").alias("id"), "what", (F.col("source_id") % 5).alias("grp")), 10, own.select("id", F.col("reg_id").alias("grp")))
    assert best.groupBy("query_id").count().where("count > 40").count() == 0  # ten a task at most
    named = lambda s, a, b: s.select(F.col(a).alias("id"), F.col(b).alias("chunk_id"), F.round("score", 6).alias("score"))
    found = [sorted(map(tuple, training.hard_negatives(s, own, chunks).collect())) for s in (named(every, "case_id", "source_id"), named(best, "query_id", "id"))]
    assert found[0] == found[1] and len(found[0]) == 3 * cases.count()


def test_an_article_is_looked_up_once(spark):
    cited = spark.createDataFrame([(i, 1, 5) for i in range(50)] + [(60, 1, 9), (61, 1, 0), (62, 1, None), (63, 2, 5)], "id long, reg_id long, article_number long")
    chunks = spark.createDataFrame([(1, 1, 2, "Art 15", "b"), (2, 1, 1, "Art 50", "a"), (3, 1, 0, "Art 7", "first"), (4, 1, 0, None, "none")], "chunk_id long, reg_id long, chunk_index long, article_ref string, content string")
    rows = training.chunk_by_article(cited, chunks, spark.createDataFrame([(1, "first")], "reg_id long, content string"))
    assert {r["id"]: r["positive"] for r in rows.collect()} == dict.fromkeys(range(50), "a") | {60: "first", 61: "first", 62: "first", 63: None}
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_one_file_of_customers_is_spread(spark, small):
    plan = registered.QUERIES["address_ranges"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 4" in plan


def test_a_reference_without_its_semicolon_is_decoded():
    assert extract.html_text("<h1>and&amp;&amp</h1><p>a&am</p>") == "and&& a&am"


def test_impact_of_next_reads_a_text_once(spark):
    rows = [(1, "A must b. The Employer\t  pays.  Same. same."), (2, "A worker left. Same. SAME. New; end"), (2, "Same."), (3, None), (4, " \n "), (6, "Alone."), (None, "No id.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = docs.select("doc_id", F.col("text").alias("old_text")).join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("new_text")), "doc_id")
    found = insights.impact_of_next(docs)
    assert sorted(map(str, found.collect())) == sorted(map(str, insights.impact(pairs).collect()))
    assert found.count() == 5
    both = {r["doc_id"]: r for r in found.where("doc_id = 1").orderBy(F.size("what_changed").desc()).limit(1).collect()}[1]
    assert both["affected_parties"] == ["أصحاب العمل والمنشآت", "العاملون والموظفون"] and both["status"] == "ok"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") == 1
    used = registered.amendment_impact(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in used and used.count("Relation [") == 1


def test_a_blank_text_is_no_missing_one(spark, tmp_path):
    import duckdb

    rows = [(1, ""), (2, " \n\t "), (3, None), (4, " a\n b "), (5, "x" * 15_000_001), (6, "ab " * 40_001)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: tuple(r) for r in registered.extraction_envelope(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert found == {r[0]: r for r in con.execute(registered.ORACLES["extraction_envelope"]).fetchall()}
    assert found[2][1] == "" and found[3][1] is None and found[5][2] == "error"


def test_impact_takes_whole_texts(spark):
    same = "Some words here. " * 3000  # over 40,000 characters
    docs = spark.createDataFrame([(1, f"{same}Gone at the end."), (2, f"{same}A company shall pay.")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, f"{same}Gone at the end.", f"{same}A company shall pay.")], "doc_id long, old_text string, new_text string")
    for found in (insights.impact_of_next(docs), insights.impact(pairs)):
        r = found.first()
        assert [b["description"] for b in r["what_changed"]] == ["تمت إضافة نص: A company shall pay.", "تم حذف/تعديل نص: Gone at the end."]
        assert r["affected_parties"] == ["أصحاب العمل والمنشآت"]
    assert "40000" not in registered.ORACLES["amendment_impact"]
