"""What a model's answer says, as far as it is usable: JSON as VARIANT, walked in the JVM, malformed parts left out.

An answer that isn't an object, or can't be parsed, gives nothing. Of a list those entries count that are objects and have the text
they need; the first ``limit`` of them stay, and their texts are cut. Values that aren't text are written out (2.0 as 2); empty ones (null,
false, zero, an empty text, list or object) give way to a default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sijill.functions import text as T

# What stands in for a date's label, and the lengths that texts are cut to.
DATE_LABEL = "تاريخ نظامي مهم"
DESCRIPTION, SHORT, SNIPPET = 450, 120, 400


def answer(c: str | Column) -> Column:
    """The object in a model's answer, in code fences or among other text, as VARIANT; null if there is none."""
    found = F.try_parse_json(T.salvage_json(c))
    return F.when(_kind(found).startswith("OBJECT"), found)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _written(v: Column) -> Column:
    """A value as text; null for null."""
    kind = _kind(v)
    truth = F.when(F.try_variant_get(v, "$", "boolean"), "True").otherwise("False")
    return F.when(kind == "VOID", F.lit(None).cast("string")).when(kind == "BOOLEAN", truth).when(kind.rlike("^(ARRAY|OBJECT)"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))


def _said(v: Column) -> Column:
    """A value as text; null for empty ones."""
    kind, written = _kind(v), _written(v)
    zero = kind.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.try_variant_get(v, "$", "double") == 0)
    return F.when(~zero & ~((kind == "BOOLEAN") & (written == "False")) & ~written.isin("", "[]", "{}"), written)


def _text(v: Column, default: str = "") -> Column:
    return F.coalesce(F.nullif(T.strip(F.coalesce(_said(v), F.lit(default))), F.lit("")), F.lit(default))


def _entries(v: Column, key: str) -> Column:
    """The objects in the list under ``key``; none if that isn't a list."""
    found = F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(found, lambda x: _kind(x).startswith("OBJECT"))


def _kept(entries: Column, row, needed: str, limit: int) -> Column:
    return F.slice(F.filter(F.transform(entries, row), lambda x: x[needed] != ""), 1, max(1, limit))


def bullets(v: Column, key: str, title: str, limit: int) -> Column:
    """(title, description, severity) entries with a description; a missing severity follows from the description."""

    def row(x: Column) -> Column:
        description, severity = _text(_field(x, "description")), _written(_field(x, "severity"))
        return F.struct(_text(_field(x, "title"), title).alias("title"), F.left(description, F.lit(DESCRIPTION)).alias("description"), F.coalesce(severity, T.severity(description)).alias("severity"))

    return _kept(_entries(v, key), row, "description", limit)


def key_dates(v: Column, key: str = "key_dates", limit: int = 8) -> Column:
    """(label, value, source) entries with a value."""
    short = lambda c: F.left(c, F.lit(SHORT))
    return _kept(_entries(v, key), lambda x: F.struct(short(_text(_field(x, "label"), DATE_LABEL)).alias("label"), short(_text(_field(x, "value"))).alias("value"), short(_said(_field(x, "source"))).alias("source")), "value", limit)


def citations(v: Column, key: str = "citations", limit: int = 6) -> Column:
    """(snippet, section_ref, relevance) entries with a snippet; a relevance that isn't a number is null."""

    def row(x: Column) -> Column:
        relevance = _field(x, "relevance")
        kind = _kind(relevance)
        number = F.when(kind.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(relevance, "$", "double")).when(kind == "BOOLEAN", F.try_variant_get(relevance, "$", "boolean").cast("double"))
        return F.struct(F.left(_text(_field(x, "snippet")), F.lit(SNIPPET)).alias("snippet"), F.left(_said(_field(x, "section_ref")), F.lit(SHORT)).alias("section_ref"), number.alias("relevance"))

    return _kept(_entries(v, key), row, "snippet", limit)
