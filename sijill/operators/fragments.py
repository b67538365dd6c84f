"""Fragments of a case and units of a regulation, before they are scored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sijill.functions import text as T
from sijill.functions.segment import MOST, segment
from sijill.session import ship

#: A case's text and whether it is Arabic: a hypothetical article, or nothing.
Provider = Callable[[str, bool], str | None]


def case_fragments(cases: DataFrame, given: DataFrame | None = None, most: int = 60) -> DataFrame:
    """(case_id, fragment_id, frag_pos, source, text, auto): the given fragments, long ones divided; else windows of the text.

    ``given``: case_id, fragment_id, pos, source, text. Blank ones drop out; ``most`` fragments a case stay.
    """
    ship(cases.sparkSession)
    own = cases
    parts = None
    if given is not None:
        said = T.strip("text")
        rows = given.where(said != "").withColumn("w", segment(F.when(F.length(said) > MOST, said), 20))
        rows = rows.withColumn("w", F.when(F.size("w") > 1, F.col("w")).otherwise(F.array("text")))
        rows = rows.select("case_id", "fragment_id", "pos", "source", F.size("w").alias("n"), F.posexplode("w").alias("i", "text"))
        name = F.when(F.col("n") > 1, F.concat("fragment_id", F.format_string(":s%02d", "i"))).otherwise(F.col("fragment_id"))
        parts = rows.select("case_id", name.alias("fragment_id"), "pos", "i", "source", "text", (F.col("n") > 1).alias("auto"))
        own = cases.join(given.where(said != "").select("case_id").distinct(), "case_id", "left_anti")
    auto = own.select("case_id", F.posexplode(segment(F.col("text"))).alias("pos", "text")).select("case_id", F.format_string("case_seg_%02d", "pos").alias("fragment_id"), F.col("pos").cast("long").alias("pos"), F.lit(0).alias("i"), F.lit("case").alias("source"), "text", F.lit(True).alias("auto"))
    rows = auto if parts is None else parts.withColumn("pos", F.col("pos").cast("long")).unionByName(auto)
    w = Window.partitionBy("case_id").orderBy("pos", "i")
    return rows.withColumn("frag_pos", F.row_number().over(w).cast("long") - 1).where(F.col("frag_pos") < most).select("case_id", "fragment_id", "frag_pos", "source", "text", "auto")


def with_hypotheses(fragments: DataFrame, hypotheses: DataFrame, most: int = 4000, least: int = 20) -> DataFrame:
    """``fragments`` and, behind a case's own, a fragment of source ``hyde`` for its hypothesis (case_id, text).

    A hypothesis is what a provider wrote for the case's first ``most`` characters; it is trimmed, left out under ``least``
    characters and cut at ``most``. Cases without fragments get none; null texts are left out.
    """
    said = T.strip("text")
    made = hypotheses.where(F.length(said) >= least).select("case_id", F.left(said, F.lit(most)).alias("text"))
    last = fragments.groupBy("case_id").agg((F.max("frag_pos") + 1).alias("frag_pos"))
    more = made.join(last, "case_id").select("case_id", F.lit("hyde_hypothetical").alias("fragment_id"), "frag_pos", F.lit("hyde").alias("source"), "text", F.lit(False).alias("auto"))
    return fragments.unionByName(more)


def hypotheses(cases: DataFrame, provider: Provider | None = None, most: int = 4000) -> DataFrame:
    """(case_id, text, warning) of a provider that gets the first ``most`` characters and whether they are Arabic.

    Without a provider all are null with the warning ``hyde_disabled``; too short an answer is ``hyde_empty_response``, a failure of
    the connection ``hyde_error``: ranking goes on with the case's own fragments.
    """
    ship(cases.sparkSession)
    rows = cases.select("case_id", F.left("text", F.lit(most)).alias("text"))
    if provider is None:
        return rows.select("case_id", F.lit(None).cast("string").alias("text"), F.lit("hyde_disabled").alias("warning"))
    arabic = T.is_arabic("text")

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for case, text, is_arabic in zip(p["case_id"], p["text"], p["arabic"], strict=True):
                try:
                    said = (provider(text, bool(is_arabic)) or "").strip()
                    out.append((case, said[:most], None) if len(said) >= 20 else (case, None, "hyde_empty_response"))
                except OSError:
                    out.append((case, None, "hyde_error"))
            yield pd.DataFrame(out, columns=["case_id", "text", "warning"])

    kind = dict(cases.dtypes)["case_id"]
    return rows.where("text is not null").withColumn("arabic", arabic).mapInPandas(asked, f"case_id {kind}, text string, warning string")


def regulation_units(regulations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(reg_id, unit_pos, chunk_id, text, fallback): a regulation's chunks that aren't blank, in order; without any the title, the
    category in brackets and the content as one unit, blank parts left out."""
    said = T.strip("text")
    filled = chunks.where(said != "").select("reg_id", F.col("chunk_index").cast("long").alias("unit_pos"), "chunk_id", said.alias("text"), F.lit(False).alias("fallback"))
    parts = F.array(T.strip("title"), F.concat(F.lit("("), T.strip(F.when(T.strip("category") != "", F.col("category"))), F.lit(")")), T.strip("content_text"))
    whole = F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " ")
    rest = regulations.join(filled.select("reg_id").distinct(), "reg_id", "left_anti").select("reg_id", F.lit(0).cast("long").alias("unit_pos"), F.lit(None).cast("long").alias("chunk_id"), whole.alias("text"), F.lit(True).alias("fallback"))
    return filled.unionByName(rest.where("text <> ''"))
