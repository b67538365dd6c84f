"""Models behind a protocol: a provider takes a batch of texts and gives a vector each. The default is deterministic and needs no model."""

from __future__ import annotations

import hashlib
import math
import struct
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sijill.functions.vectors import DIMS, FIRST, FLAGS, col
from sijill.session import ship

Provider = Callable[[list[str]], list[list[float]]]


def hash_vector(text: str) -> list[float]:
    """The dense form of the hash embedding, not normalized."""
    low, out = text.lower(), [0.0] * DIMS
    for i, word in enumerate(FLAGS):
        out[i] = float(word in low)
    out[len(FLAGS)] = min(len(text) / 100.0, 10.0)
    for token in low.split():
        out[FIRST + int.from_bytes(hashlib.sha1(token.encode()).digest()[:4], "little") % (DIMS - FIRST)] += 1.0
    return out


def deterministic(batch: list[str]) -> list[list[float]]:
    return [hash_vector(t) for t in batch]


def chain(providers: list[Provider], attempts: int = 2, pause: float = 0.5) -> Provider:
    """The first provider that gives a vector for each text; each is tried again after a failure of its connection."""

    def run(batch: list[str]) -> list[list[float]]:
        last: Exception | None = None
        for p in providers:
            for attempt in range(attempts):
                try:
                    found = p(batch)
                except OSError as e:
                    last = e
                    time.sleep(pause * attempt)
                    continue
                if len(found) != len(batch):
                    last = ValueError(f"{len(found)} vectors for {len(batch)} texts")
                    break
                return found
        raise last or ValueError("no provider")

    return run


def embed(df: DataFrame, text: str, provider: Provider = deterministic, batch: int = 16, normalize: bool = False, out: str = "embedding") -> DataFrame:
    """Adds a vector for each text. Distinct texts only go to the provider; rows with a null text get null."""
    ship(df.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts, vectors = p["_text"].tolist(), []
            for i in range(0, len(texts), batch):
                vectors += provider(texts[i : i + batch])
            if normalize:
                vectors = [[x / (math.sqrt(sum(y * y for y in v)) or 1.0) for x in v] for v in vectors]
            yield pd.DataFrame({"_key": p["_key"], "_vector": vectors})

    key = F.sha2(F.col(text), 256)
    distinct = df.select(key.alias("_key"), F.col(text).alias("_text")).where("_text is not null").dropDuplicates(["_key"])
    vectors = distinct.mapInPandas(run, "_key string, _vector array<double>")
    return df.withColumn("_key", key).join(vectors, "_key", "left").drop("_key").withColumnRenamed("_vector", out)


def missing_only(df: DataFrame, text: str, vector: str, provider: Provider = deterministic) -> DataFrame:
    """Embeds the rows without a vector and keeps the others as they are."""
    new = embed(df.where(F.col(vector).isNull()).drop(vector), text, provider, out=vector)
    return df.where(F.col(vector).isNotNull()).unionByName(new)


def binary_vector(c) -> Column:
    """A vector in a database's binary form: its length in two bytes, two unused, then four bytes a component, little end first."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        def one(b):
            if b is None or len(b) < 4:
                return None
            n = struct.unpack_from("<H", b)[0]
            return list(map(float, struct.unpack_from(f"<{n}f", b, 4))) if len(b) >= 4 + 4 * n else None

        return x.map(one)

    return run(col(c))
