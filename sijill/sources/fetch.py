"""Documents over HTTPS: an allow-list in SQL, then conditional requests by a provider, which is none by default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sijill.session import ship
from sijill.sources.extract import allowed_url

#: url, etag, last modified -> status, content type, body, etag.
Fetch = Callable[[str, str | None, str | None], tuple[int, str | None, bytes | None, str | None]]
SCHEMA = "url string, http int, content_type string, content binary, etag string"


def fetch(urls: DataFrame, hosts: tuple[str, ...], get: Fetch | None = None) -> DataFrame:
    """``urls`` (url, etag, modified) with status: ok, not_modified, http_<code>, blocked, or disabled without a provider."""
    ship(urls.sparkSession)
    rows = urls.withColumn("allowed", allowed_url("url", hosts))
    if get is None:
        return rows.select("url", F.when(F.col("allowed"), "disabled").otherwise("blocked").alias("status"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("binary").alias("content"), "etag")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(u, *get(u, e, m)) for u, e, m in zip(p["url"], p["etag"], p["modified"], strict=True)], columns=["url", "http", "content_type", "content", "etag"])

    found = rows.where("allowed").select("url", "etag", "modified").mapInPandas(run, SCHEMA)
    status = F.when(F.col("http") == 304, "not_modified").when(F.col("http") >= 400, F.concat(F.lit("http_"), F.col("http").cast("string"))).otherwise("ok")
    done = found.select("url", status.alias("status"), "content_type", F.when(F.col("http") < 300, F.col("content")).alias("content"), "etag")
    blocked = rows.where("not allowed").select("url", F.lit("blocked").alias("status"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("binary").alias("content"), "etag")
    return done.unionByName(blocked)


def ocr_plan(rows: DataFrame, primary: str | None = None, secondary: str | None = None, below: int = 400) -> DataFrame:
    """Which text recognition a document needs and who gives it: ``rows`` have method, n_chars and rtl."""
    needs = ((F.col("n_chars") < below) & F.col("method").isin("pdf", "image")) | ((F.col("method") == "pdf") & F.col("rtl"))
    first = F.lit(primary) if primary else F.lit(None).cast("string")
    return rows.withColumn("needs_ocr", needs).withColumn("provider", F.when(needs, F.coalesce(first, F.lit(secondary) if secondary else F.lit(None).cast("string"))))
