"""Embeddings, cosine and scores as DataFrame transforms. The hash embedding is sparse and in whole numbers, so sums are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sijill.functions.folds import let
from sijill.functions.text import col

DIMS = 1024
#: The words that have a dimension of their own, and the first dimension of hashed tokens.
FLAGS = ("contract", "labor", "case")
FIRST = 4


def hash_dim(token) -> Column:
    """The dimension of a token: its SHA-1's first four bytes, little end first, over the hashed dimensions."""
    h = F.sha1(F.encode(col(token), "utf-8"))
    swapped = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return (F.conv(swapped, 16, 10).cast("long") % (DIMS - FIRST) + FIRST).cast("int")


def hash_embed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dim, v) of the deterministic embedding, times 100. Tokens are counted a text first, then distinct tokens hashed.

    Cosine doesn't change with the factor, and all values are whole: dot products and norms are exact in any order.
    """
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    low = F.lower("t")
    flags = base.select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.when(F.contains(low, F.lit(w)), 100).otherwise(0).cast("long").alias("v")) for i, w in enumerate(FLAGS)], F.struct(F.lit(3).alias("dim"), F.least(F.length("t"), F.lit(1000)).cast("long").alias("v")))).alias("e")).select("id", "e.dim", "e.v")
    tokens = base.select("id", F.explode(F.filter(F.split(low, r"(?U)\s+"), lambda x: x != "")).alias("token")).groupBy("id", "token").agg((F.count("*") * 100).alias("v"))
    hashed = tokens.select("id", hash_dim("token").alias("dim"), "v")
    return flags.where("v > 0").unionByName(hashed).groupBy("id", "dim").agg(F.sum("v").alias("v"))


def norm(v) -> Column:
    n = F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(n == 0, 1.0).otherwise(n)


def dot(a, b) -> Column:
    """Over the shorter of the two."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b) -> Column:
    """A zero vector's norm counts as one."""
    return dot(a, b) / (norm(a) * norm(b))


def strict_cosine(a, b) -> Column:
    """0 for empty vectors, zero vectors and those of unequal length."""
    x, y = col(a), col(b)
    return F.when((F.size(x) == 0) | (F.size(x) != F.size(y)), 0.0).otherwise(cosine(x, y))


def normalized(v) -> Column:
    return let(norm(v), lambda n: F.transform(col(v), lambda x: x.cast("double") / n))


def clamp(x, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(x)))


def parse_vector(c) -> Column:
    """A vector written as [a, b, ...]; null if it isn't one."""
    return F.from_json(col(c), "array<double>")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def hash_share(c) -> Column:
    """Where in 0 to 1 an id falls: its MD5's first eight digits over the greatest."""
    return F.conv(F.substring(F.md5(F.encode(col(c).cast("string"), "utf-8")), 1, 8), 16, 10).cast("double") / 4294967295.0


def hash_split(c, share: float = 0.2) -> Column:
    return F.when(hash_share(c) < share, "val").otherwise("train")


#: Confidence words, trust tiers, and the categories of case and court types.
CONFIDENCE = {"high": 1.0, "medium": 0.6, "low": 0.3}
TRUST = {"official": 1.0, "trusted": 0.9, "discovered": 0.6, "unverified": 0.4}
CASE_CATEGORY = {"labor": "labor_law", "commercial": "commercial_law", "civil": "civil_law", "criminal": "criminal_law", "administrative": "procedural_law", "family": "civil_law"}
COURT_CATEGORY = {"1": "commercial_law", "2": "labor_law", "3": "criminal_law", "4": "civil_law", "5": "procedural_law"}


def lookup(table: dict, c, default=None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), col(c).cast("string"))
    return found if default is None else F.coalesce(found, F.lit(default))


def category_prior(case_type, category) -> Column:
    return F.when(lookup(CASE_CATEGORY, case_type) == col(category), 1.0).otherwise(0.0)
