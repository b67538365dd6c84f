from pyspark.sql import functions as F

from sijill.functions import folds, segment, vectors
from sijill.functions import text as T


def one(spark, value, column):
    return spark.range(1).select(F.lit(value).alias("x")).select(column("x")).first()[0]


def test_clips_and_tokens(spark):
    assert one(spark, "  a \n b\t", T.normalize_space) == "a b"
    assert one(spark, "x" * 400, T.clip) == "x" * 320 + "..."
    assert one(spark, "ab " * 200, T.clip_at_word).endswith("ab…")
    assert sorted(one(spark, "Ab ab c d_e العمل", T.token_set)) == ["ab", "d_e", "العمل"]


def test_ngrams(spark):
    assert one(spark, "hello world", T.char_ngrams)[0::7] == ["hell", "orld"]
    assert one(spark, "ab", T.char_ngrams) == ["ab"]
    assert one(spark, "", T.char_ngrams) == []
    assert segment.ngrams("hello world")[-1] == "orld"


def test_sentences(spark):
    assert one(spark, "One. Two!  Three؟ Four", T.sentences) == ["One.", "Two!", "Three؟", "Four"]
    rows = one(spark, "One. Two.", T.sentences_with_offsets)
    assert [(r["text"], r["start"], r["end"]) for r in rows] == [("One.", 0, 4), ("Two.", 5, 9)]


def test_arabic(spark):
    assert one(spark, "Labor dispute نزاع", T.is_arabic) is False
    assert one(spark, "أَحْكَام", T.normalize_arabic) == "احكام"
    for said, n in (("75/1", 751), ("٧٥", 75), ("الخامسة والعشرون", 25), ("الثانية عشرة", 12), ("شيء", None)):
        assert one(spark, said, T.arabic_number) == n
    assert one(spark, "نظام العمل", T.regulation_name) == "العمل"
    assert one(spark, "العمل، و", T.clean_name) == "العمل،"


def test_families(spark):
    assert one(spark, "You MUST pay", T.severity) == "medium"
    assert one(spark, "a fine of 5", T.severity) == "high"
    assert one(spark, "finest", T.severity) == "low"
    assert one(spark, "on 2024-01-02 and 3/4/2024 and 2024-01-02", T.key_dates) == ["2024-01-02", "3/4/2024"]


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(vectors.cosine("a", "b")).collect()] == [1.0, 0.0, -1.0, 0.0]
    short = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert short.select(vectors.strict_cosine("a", "b")).first()[0] == 0.0


def test_windows():
    assert segment.windows("") == [] and segment.windows(None) == []
    assert segment.windows("short") == ["short"]
    long = " ".join(f"Sentence number {i} is here." for i in range(100))
    found = segment.windows(long)
    assert " ".join(found) == long and max(map(len, found)) <= 600
    assert len(segment.windows("\n\n".join(["y" * 500] * 60))) == 40
    assert segment.windows("a" * 100 + "\n\ntail") == ["a" * 100 + " tail"]
    assert all(len(w) <= 600 for w in segment.windows("z" * 2000))


def test_max_sim():
    assert abs(segment.max_similarity("hello world", "hello world") - 1) < 1e-6
    assert segment.max_similarity("", "x") == 0.0


def test_windows_follow_the_rules():
    assert segment.windows("a  b\nc  d") == ["a b c d"]  # white space is collapsed
    assert segment.windows("x" * 50 + "\r\r" + "y" * 50) == ["x" * 50, "y" * 50]  # a lone return breaks lines
    s = lambda n, c: c * (n - 1) + "."
    long = ("w" * 9 + " ") * 65 + "end."  # 654 characters: its rest stays apart from what follows
    found = segment.windows(" ".join([long, s(60, "a"), s(60, "b")]))
    assert [len(w) for w in found] == [599, 54, 121]
    assert segment.windows("\n\n".join(["y" * 500] * 40 + ["tail"]))[-1] == "y" * 500  # behind the last window nothing is added


def test_folds_are_linear(spark):
    import time

    text = "One more sentence. " * 20_000
    rows = spark.createDataFrame([(text,)], "t string")
    rows.select(F.size(T.sentences_with_offsets("t"))).first()
    began = time.time()
    assert rows.select(F.size(T.sentences_with_offsets("t"))).first()[0] == 20_000
    assert time.time() - began < 5
    found = rows.select(T.within_budget(T.sentences_with_offsets("t"), 100)).first()[0]
    assert [len(s["text"]) for s in found] == [18] * 5 + [10]
    assert spark.range(1).select(folds.offsets(F.array().cast("array<int>"))).first()[0] == []


def test_small_rules(spark):
    assert spark.range(1).select(T.drop_adjacent(F.array(*[F.lit(x) for x in "aabba"]))).first()[0] == list("aba")
    assert one(spark, "١٢- المادة الأولى", T.bullet_title) == "١٢"
    assert one(spark, "Scope: all employers", T.bullet_title) == "Scope"
    assert one(spark, "```json\n{\"a\": 1}\n```", T.salvage_json) == '{"a": 1}' and one(spark, "none", T.salvage_json) is None
    assert one(spark, "x الوقائع abc", T.facts_section).startswith("الوقائع")
    assert one(spark, "  abcdef ", lambda c: T.truncate(c, 5)) == "abc"
    assert one(spark, "ﻻ\n\x00x", segment.nfkc_rtl) == "لا\nx" and one(spark, "ﬁ", segment.nfkc_rtl) == "ﬁ"
    assert one(spark, "1", lambda c: vectors.lookup(vectors.COURT_CATEGORY, c)) == "commercial_law"
