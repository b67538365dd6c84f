"""A corpus made ready in stages; each stage works on what its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sijill.llm import decontaminate, langid, mixing, neardup, pii
from sijill.llm.common import read, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects go.

    Null texts and those without a letter are rejected; without any labelled document all are; a null id isn't learned from;
    repeated rows are judged alike; all columns stay.
    """
    return langid.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8).

    Null and empty texts are near to nothing and stay; repeated rows of one id and text stay or go together; of rows that share an
    id but not a text only the copies go; a null id goes if its group has a named one, else it stays; all columns stay.
    """
    return neardup.deduplicated(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item in them go.

    Null and empty texts and items match nothing; repeated rows match alike; without a benchmark all stay; all columns stay.
    """
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind.

    Null texts stay null, empty ones empty; overlapping spans give way as one; n_chars follows a changed text; all rows and
    other columns stay.
    """
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many times.

    Null and empty texts have no words and aren't taken; a null source is a source of its own; repeated rows are documents of their
    own; all columns stay, mix_size, mix_target and mix_copies join them.
    """
    return mixing.mixed(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: SQL can't say what a trained model decides; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
