"""Rules of verification, of the pool of laws and of used references, with their fallbacks and ties."""

from sijill.operators import chat, ranking, training


def test_rows_behind_the_first_stay(spark):
    rows = spark.createDataFrame([(1, r, 1 - r / 100) for r in range(20)] + [(2, r, 0.5) for r in range(3)], "case_id long, reg_id long, final_score double")
    verdicts = spark.createDataFrame([(1, 0, True, "high"), (1, 1, False, "high"), (1, 2, None, "high"), (1, 17, False, "high"), (2, 9, True, "high")], "case_id long, reg_id long, applicable boolean, confidence string")
    found = {(r["case_id"], r["reg_id"]): (r["status"], round(r["blended"], 6), r["warning"]) for r in ranking.blend(rows, verdicts).collect()}
    assert len(found) == 22 and (1, 1) not in found
    assert found[1, 0] == ("approved", 1.0, None) and found[1, 2] == ("skipped", 0.98, None) and found[1, 14] == ("skipped", 0.86, None)
    assert found[1, 15] == (None, 0.85, None) and found[1, 17] == (None, 0.83, None)
    assert {v for (c, _), v in found.items() if c == 2} == {(None, 0.5, "gemini_fallback_used")}


def test_pool_keeps_the_order_of_the_cases(spark):
    laws = spark.createDataFrame([(5, 0, "a"), (1, 1, "b"), (1, 0, "c "), (5, 1, "c "), (9, 0, "d"), (5, 2, None), (5, 3, "a"), (1, 2, "")], "case_pos long, pos long, text string")
    cases = spark.createDataFrame([(1,), (3,), (5,), (9,), (None,), (3,)], "case_pos long")
    found = [tuple(r) for r in training.pool(cases, laws, 3).orderBy("case_pos", "pos").collect()]
    assert found == [("c ", 1, 0), ("b", 1, 1), ("", 1, 2), ("a", 5, 0)]


def test_used_references(spark):
    answers = spark.createDataFrame([(1, 1, "by the Labor Law, Article 5"), (1, 3, "Article 9 only"), (2, 1, None), (3, 1, "nothing")], "conv_id long, turn int, answer string")
    given = [(1, 2, 7, "Labor Law", "", 70), (1, 1, 7, "other", "Article 5", 71), (1, 1, 8, "", "", 80), (1, 1, 9, None, None, 90), (1, 3, 8, "", "Article 9", 81), (2, 1, 7, "Labor Law", None, 70), (3, 1, 7, "", "Article 5", 70)]
    refs = spark.createDataFrame(given, "conv_id long, pos int, reg_id long, title string, article string, chunk_id long")
    assert {tuple(r) for r in chat.used_references(answers, refs).collect()} == {(1, 1, 7, "other", "Article 5", 71), (1, 3, 8, "", "Article 9", 81)}
    assert {tuple(r) for r in chat.used_references(answers, refs.where("article is null or article = ''")).collect()} == {(1, 1, 7, "Labor Law", None, 70)}
