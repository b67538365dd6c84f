"""Text recognition as a chain: the parser's text, a first provider for what needs one, a second for what the first didn't read.

Only rows that need recognition bring their bytes to Python, once: a task asks the first provider and, row by row, the second for
what it failed. How each row came by its text is said in four columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sijill.functions.text import normalize_space
from sijill.operators.layout import DRAWN
from sijill.session import ship
from sijill.sources.extract import OCR_BELOW

#: bytes, content type, file name -> text; an error or no text: it failed.
Read = Callable[[bytes, str, str], str | None]


@dataclass(frozen=True)
class Provider:
    name: str
    read: Read


_SAID = "recognized string, extraction_method string, ocr_provider_used string, fallback_stage string, said array<string>"


def needs_ocr(method: str = "method", text: str = "raw", below: int = OCR_BELOW):
    """PDF files and images with less than ``below`` characters of text, and all PDF files with text that is read from the right."""
    short = F.length(normalize_space(F.coalesce(text, F.lit("")), drop_nul=True)) < below
    return (F.col(method).isin("pdf", "image") & short) | ((F.col(method) == "pdf") & F.coalesce(F.col(text).rlike(DRAWN), F.lit(False)))


def _asked(provider: Provider | None, stage: str, data: bytes, kind: str, name: str) -> tuple[str | None, str | None]:
    failed = f"{stage} OCR provider failed."
    if provider is None:
        return None, f"{stage} OCR provider isn't configured."
    try:
        found = provider.read(data, kind, name)
    except Exception as e:  # noqa: BLE001  whatever a provider raises, the next one is asked
        return None, str(e) or failed
    return (found, None) if found else (None, failed)


def chained(primary: Provider | None, secondary: Provider | None, data: bytes | None, kind: str | None, name: str | None) -> tuple[str | None, str, str, str, list[str]]:
    """(text, method, provider, stage, warnings) of one file; no text and parser_only if both fail."""
    args, said = (data or b"", kind or "application/octet-stream", name or "document"), []
    for provider, stage, method, before in ((primary, "Primary", "ocr_primary", "none"), (secondary, "Secondary", "ocr_secondary", "secondary")):
        text, failure = _asked(provider, stage, *args)
        if text:
            return text, method, provider.name, before, said
        said.append(failure)
    return None, "", "none", "parser_only", said


def recognized(rows: DataFrame, primary: Provider | None = None, secondary: Provider | None = None, below: int = OCR_BELOW) -> DataFrame:
    """``rows`` (method, content_type, name, content, raw, and others) with text, extraction_method, ocr_provider_used, fallback_stage and warnings in place of content and raw.

    Where both providers fail the parser's text stays and the method ends in _fallback. Null bytes are none, a null type and name
    have defaults, a null text is empty; warnings that rows have come first.
    """
    ship(rows.sparkSession)
    if "warnings" not in rows.columns:
        rows = rows.withColumn("warnings", F.array().cast("array<string>"))
    rows = rows.withColumn("raw", F.coalesce("raw", F.lit(""))).withColumn("extraction_method", F.concat(F.lit("parser_"), F.col("method")))
    needs = F.coalesce(needs_ocr(below=below), F.lit(False))
    kept = rows.where(~needs).drop("content").withColumnsRenamed({"raw": "text"}).withColumns({"ocr_provider_used": F.lit("none"), "fallback_stage": F.lit("none")})
    names = [f.name for f in rows.schema if f.name not in ("content", "extraction_method")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names) + ", " + _SAID

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = [chained(primary, secondary, None if d is None else bytes(d), k, n) for d, k, n in zip(p["content"], p["content_type"], p["name"], strict=True)]
            yield p[names].assign(**{c: [x[i] for x in found] for i, c in enumerate(("recognized", "extraction_method", "ocr_provider_used", "fallback_stage", "said"))})

    read = rows.where(needs).mapInPandas(run, schema)
    method = F.when(F.col("recognized").isNull(), F.concat(F.lit("parser_"), F.col("method"), F.lit("_fallback"))).otherwise(F.col("extraction_method"))
    read = read.withColumns({"extraction_method": method, "text": F.coalesce("recognized", "raw"), "warnings": F.concat(F.coalesce("warnings", F.array().cast("array<string>")), "said")}).drop("recognized", "said", "raw")
    return kept.unionByName(read)
