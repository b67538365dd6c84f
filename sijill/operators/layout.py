"""Reading order of words on pages: lines from vertical bands, right-to-left lines turned, pages and documents put together.

A parser of PDF files is a provider; what it gives is a table of words with their page and place. A line is a band of BAND points;
a band with any right-to-left word is read from the right, and such words, which come in the order they are drawn, are reversed.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sijill.functions.segment import nfkc_rtl

BAND = 5
#: The blocks of characters that are read from the right.
DRAWN = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"


def compatible(c: str) -> Column:
    """Without NUL and in compatibility form; null stays null."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: t if t is None or t.isascii() and "\x00" not in t else unicodedata.normalize("NFKC", t.replace("\x00", "")))

    return run(c)


def page_lines(words: DataFrame) -> DataFrame:
    """(doc_id, page, line, text) of ``words`` (doc_id, page, pos, x0, top, text); lines count from 1 down the page.

    pos is a word's place in the file; of words at one place the earlier one comes first. Blank and null words drop out, a null
    place is 0; repeated rows stand twice.
    """
    rows = words.select("doc_id", "page", F.rint(F.coalesce("top", F.lit(0.0)) / BAND).alias("band"), F.coalesce(F.col("x0").cast("double"), F.lit(0.0)).alias("x"), "pos", compatible("text").alias("w"))
    rows = rows.where(~F.coalesce(F.col("w").rlike(r"^(?U)[\s\x{1c}-\x{1f}]*$"), F.lit(True))).withColumn("rtl", F.col("w").rlike(DRAWN))
    turned = F.col("rtl").cast("int")
    found = rows.groupBy("doc_id", "page", "band").agg(F.max(turned).alias("turn"), F.collect_list(F.struct("x", "pos", F.when(F.col("rtl"), F.reverse("w")).otherwise(F.col("w")).alias("w"))).alias("l"))
    order = F.array_sort(F.transform("l", lambda v: F.struct(F.when(F.col("turn") == 1, -v["x"]).otherwise(v["x"]).alias("k"), v["pos"].alias("pos"), v["w"].alias("w"))))
    found = found.select("doc_id", "page", "band", F.array_join(F.transform(order, lambda v: v["w"]), " ").alias("text"))
    down = Window.partitionBy("doc_id", "page").orderBy("band")
    return found.select("doc_id", "page", F.row_number().over(down).cast("long").alias("line"), "text")


def page_texts(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): a document's lines, an empty line between pages, trimmed. ``pages`` (doc_id, page) names pages without words too."""
    found = lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda v: v["text"]), "\n").alias("t"))
    if pages is not None:
        found = pages.select("doc_id", "page").distinct().join(found, ["doc_id", "page"], "left")
    whole = F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("t", F.lit("")).alias("t")))), lambda v: v["t"])
    return found.groupBy("doc_id").agg(F.regexp_replace(F.array_join(whole, "\n\n"), r"(?U)^\s+|\s+$", "").alias("text"))


def pdf_texts(words: DataFrame, pages: DataFrame, plain: DataFrame) -> DataFrame:
    """(doc_id, text) for each document of ``pages`` or ``plain`` (doc_id, raw): from words in reading order, else the plain parser's lines."""
    found = page_texts(page_lines(words), pages).join(plain, "doc_id", "full")
    raw = nfkc_rtl(F.regexp_replace(F.coalesce("raw", F.lit("")), r"(?U)^\s+|\s+$", ""))
    return found.select("doc_id", F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).otherwise(raw).alias("text"))
