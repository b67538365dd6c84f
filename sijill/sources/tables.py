"""Sources and sinks: JSON lines, database tables, a registry of sources, and writers."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of a JSON-lines file; bad lines drop out, or raise if ``strict``."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def invalid_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.where(F.try_parse_json("value").isNull()).select(F.col("value").alias("line"))


def database_url(folders: tuple[str, ...] = (".",)) -> str | None:
    """DATABASE_URL of the environment, else of the first .env file that has it."""
    if found := os.environ.get("DATABASE_URL"):
        return found
    for f in (Path(d) / ".env" for d in folders):
        if f.exists():
            for line in f.read_text().splitlines():
                if line.startswith("DATABASE_URL="):
                    return line.partition("=")[2].strip().strip("\"'")
    return None


def table(spark: SparkSession, url: str, name: str, **options) -> DataFrame:
    """A database table; filters and column choices on it are pushed into the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def active_regulations(regulations: DataFrame) -> DataFrame:
    return regulations.where("status = 'active'").select("id", "title", "category")


def embedded_chunks(chunks: DataFrame, regulations: DataFrame) -> DataFrame:
    return chunks.where("embedding is not null").join(regulations.select(F.col("id").alias("regulation_id"), "title", "category"), "regulation_id")


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """The enabled sources of a folder of JSON files, by name; ``enabled`` is true unless said otherwise."""
    rows = spark.read.option("multiLine", True).schema("name string, path string, enabled boolean, dedupe_key string").json(folder)
    return rows.withColumn("enabled", F.coalesce("enabled", F.lit(True))).where("enabled").orderBy("name")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header. Spark writes no byte-order mark; readers that need one set it as they join the parts."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_stats(df: DataFrame, path: str) -> dict:
    """One row of counters as a JSON document; it is one row, so the driver writes it."""
    row = df.first().asDict(recursive=True)
    Path(path).write_text(json.dumps(row, ensure_ascii=False, indent=1, default=str))
    return row


def write_errors(df: DataFrame, path: str, again: bool = False) -> None:
    """Rows that a stage couldn't use, beside its output, as JSON lines; none are dropped silently. ``again``: in place of what is there."""
    df.write.mode("overwrite" if again else "append").json(path)
