"""Citations of regulations in Arabic judgments, their resolution by fuzzy names, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sijill.functions import text as T
from sijill.operators.names import similar

# Fixed values of the citation grammar: an article's reference, kinds of regulation, and what may follow a name.
_DIGITS = r"[0-9٠-٩]+(?:\s*/\s*[0-9٠-٩]+)?"
_ORDINAL = r"ال[\x{0600}-\x{06FF}]+(?:\s+و(?:ال)?[\x{0600}-\x{06FF}]+)*"
_NAME = r"\s+([\x{0600}-\x{06FF}\s]{3,60}?)(?=[،.؛:\s\)\(]|$)"
PATTERNS = (
    rf"(?U)المادة\s+({_ORDINAL}|{_DIGITS})\s+من\s+(نظام|لائحة|قانون|مرسوم){_NAME}",
    rf"(?U)المادة\s+({_DIGITS})\s+من\s+(نظام|لائحة|قانون){_NAME}",
    rf"(?U)المادة\s+({_DIGITS})(?=[\s،.؛:\)\(]|$)()()",
)


#: Control characters that mark matches and their groups; no pattern matches them, so those of a text become another one.
_MARKS = "\x01\x02"


def extract(judgments: DataFrame, least: int = 50) -> DataFrame:
    """A row a citation: id, pattern (0 full, 1 numbered, 2 bare), pos, article_ref, article_number, kind, name; first of its key only."""
    rows = judgments.where(F.length("text") >= least).select("id", F.translate(T.normalize_arabic("text"), _MARKS, "\x03\x03").alias("t"))
    found = []
    for k, p in enumerate(PATTERNS):  # one scan a pattern: matches become parts between marks, their groups parts of these
        parts = F.split(F.regexp_replace("t", p, "\x01$1\x02$2\x02$3\x01"), "\x01")
        found.append(F.transform(F.filter(parts, lambda x, i: i % 2 == 1), _tagged(k)))
    rows = rows.select("id", F.posexplode(F.concat(*found)).alias("pos", "c")).select("id", "pos", F.col("c.p").alias("pattern"), F.trim("c.a").alias("article_ref"), F.col("c.k").alias("kind"), T.clean_name(F.trim("c.n")).alias("name"))
    key = Window.partitionBy("id", "article_ref", "name").orderBy("pattern", "pos")
    ref = Window.partitionBy("id", "article_ref").orderBy("pattern", "pos")
    rows = rows.withColumn("k", F.row_number().over(key)).withColumn("r", F.row_number().over(ref)).where("k = 1 and (pattern < 2 or r = 1)").drop("k", "r")
    return rows.withColumn("article_number", T.arabic_number("article_ref"))


def _tagged(pattern: int):
    return lambda x: F.struct(F.lit(pattern).alias("p"), *[F.split_part(x, F.lit("\x02"), F.lit(g)).alias(n) for g, n in ((1, "a"), (2, "k"), (3, "n"))])


def resolve(names: DataFrame, titles: DataFrame, least: float = 0.5) -> DataFrame:
    """The best title (title_id, title) for each distinct name: 0.4 of the token overlap and 0.6 of the sequence ratio, ``least`` or more.

    Names and titles are compared without a leading kind of regulation, alike ones once; of equal scores the least title_id wins.
    Null names and titles, and those of a kind alone, match nothing.
    """
    left = names.select("name").distinct().withColumn("a", T.regulation_name("name"))
    right = titles.select("title_id", "title", T.regulation_name("title").alias("b")).where("title_id is not null")
    right = right.groupBy("b").agg(F.min(F.struct("title_id", "title")).alias("t"))
    scored = similar(left, right, least).join(right, "b")
    best = scored.groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("s"), "t")).alias("x"))
    return left.join(best, "a").select("name", "x.t.title_id", "x.t.title", F.round(-F.col("x.s"), 3).alias("match_score"))


def with_confidence(found: DataFrame, resolved: DataFrame) -> DataFrame:
    rows = found.join(resolved, "name", "left")
    confidence = F.when(F.col("pattern") == 0, F.when(F.col("match_score") >= 0.7, "high").otherwise("medium")).when((F.col("pattern") == 1) & F.col("match_score").isNotNull(), "medium").otherwise("low")
    return rows.withColumn("confidence", confidence)


def stats(judgments: DataFrame, found: DataFrame) -> DataFrame:
    """Totals, rates and the distribution of confidence, in one row."""
    per = found.groupBy("id").agg(F.count("*").alias("n"), *[F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")])
    rows = judgments.select("id").join(per, "id", "left").fillna(0)
    return rows.agg(F.count("*").alias("total_cases"), F.count_if(F.col("n") > 0).alias("cases_with_citations"), F.sum("n").alias("total_citations"), F.sum("high").alias("high"), F.sum("medium").alias("medium"), F.sum("low").alias("low")).select(
        "*", F.round(F.col("cases_with_citations") / F.greatest(F.lit(1), "total_cases"), 3).alias("citation_rate"), F.round(F.col("total_citations") / F.greatest(F.lit(1), "total_cases"), 2).alias("mean_citations")
    )
