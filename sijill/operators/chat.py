"""What a chat model is given: trimmed history and a context block; and which references its answer uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_MESSAGE, MOST_CONTEXT = 5000, 12000


def history(messages: DataFrame, max_turns: int = 10) -> DataFrame:
    """The last two messages a turn of each conversation, long ones cut; roles of others than user and model drop out."""
    role = F.when(F.col("role") == "user", "user").when(F.col("role").isin("assistant", "model"), "model")
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    rows = messages.withColumn("r", F.row_number().over(last)).where(F.col("r") <= 2 * max_turns)
    cut = F.when(F.length("text") > MOST_MESSAGE, F.concat(F.left("text", F.lit(MOST_MESSAGE)), F.lit("…(truncated)"))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), cut.alias("text")).where("role is not null")


def context(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """(conv_id, context): counts of cases by type, sorted, then chunks with a header each, cut at a limit.

    ``cases``: conv_id, case_type; ``chunks``: conv_id, pos, title, text.
    """
    by_type = cases.groupBy("conv_id", "case_type").agg(F.count("*").alias("n"))
    head = by_type.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("case_type", "n"))), lambda x: F.concat(x["case_type"], F.lit(": "), x["n"].cast("string"))), "\n").alias("head"))
    body = chunks.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title", "text"))), lambda x: F.concat(F.lit("["), x["title"], F.lit("]\n"), x["text"])), "\n").alias("body"))
    rows = head.join(body, "conv_id", "full").select("conv_id", F.concat_ws("\n", "head", "body").alias("c"))
    return rows.select("conv_id", F.when(F.length("c") > MOST_CONTEXT, F.concat(F.left("c", F.lit(MOST_CONTEXT)), F.lit("\n...(truncated)"))).otherwise(F.col("c")).alias("context"))


def used_references(answers: DataFrame, references: DataFrame) -> DataFrame:
    """(conv_id, turn, reg_id, title, article, chunk_id): of the references given for an answer those that it uses, one a regulation.

    ``references``: conv_id, pos, reg_id, title, article, chunk_id; ``answers``: conv_id, turn, answer. A reference is used if its
    title or its article, either not empty, stands in the answer; of a regulation's the first by pos (of equal ones by chunk_id)
    counts. An empty article comes out as null; null answers use nothing.
    """
    said = lambda c: (F.col(c) != "") & F.contains("answer", F.col(c))
    rows = answers.join(references, "conv_id").where(F.coalesce(said("title"), F.lit(False)) | F.coalesce(said("article"), F.lit(False)))
    first = rows.groupBy("conv_id", "turn", "reg_id").agg(F.min(F.struct("pos", "chunk_id", "title", "article")).alias("x"))
    return first.select("conv_id", "turn", "reg_id", F.coalesce("x.title", F.lit("")).alias("title"), F.nullif("x.article", F.lit("")).alias("article"), "x.chunk_id")
