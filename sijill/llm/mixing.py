"""Mixing sources to target weights by the cube method.

A source's rate f is its target over its size. Every document is taken floor(f) times, and once more with probability
f - floor(f); the cube method draws these additional takes. In its flight phase the vector of inclusion probabilities
moves at random inside the unit cube along directions in the null space of the constraints (words and documents taken),
so both totals stay what they are while one document after another becomes 0 or 1, until fewer documents than
constraints + 1 are open. Flights run in blocks of a source; what they leave open (two documents a block at most) is
dealt into blocks again, some thousandfold fewer at each level, until one block a source is left. Only there the landing
phase gives up the constraints, first the documents' and then the words'.

Rows alike in id, source and size are counted first and numbered then, so however many there are, the blocks that they are
dealt to by a hash of row and number hold about BLOCK rows each, and any partitioning of the input gives one result. Up to
MOST_SOURCES sources are weighed on the driver and joined by broadcast; more of them are weighed in tables by the same rule.

Edge cases: a null or blank text has size 0 and takes nothing; a null source is a source of its own, after the others;
repeated rows are documents of their own; an empty table gives an empty result; other columns are left out (``mix``)
or kept (``mixed``), whatever their names; a document larger than its source's target may be taken whole by chance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sijill.llm.common import WORD, prepare, stored

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source gives more than so many times its words.
MOST_REPEATS = 3.0
#: Documents that one flight handles.
BLOCK = 2048
#: Sources the driver weighs against each other (some 100 bytes each); more are weighed in tables.
MOST_SOURCES = 100_000
#: Rows alike that one row stands for while they are dealt out.
ALIKE = 4096

_NEAR = 1e-9


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Words to take of each source: all words shared by weight, none above ``most`` times its size."""
    open_, out, left = [i for i, s in enumerate(sizes) if s > 0], [0.0] * len(sizes), float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in above:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


# ------------------------------------------------------------------ the cube method


def flight(pi: list[float], size: list[float], rng: np.random.Generator, landing: bool = False) -> np.ndarray:
    """Move ``pi`` until at most two entries are neither 0 nor 1, keeping its sum and its sum of sizes; none if landing.

    Each step's direction is the largest open document's unit vector projected on the constraints' null space: it settles
    that document while all others give way a little, so the few that stay open are the smallest, and so is the landing's
    error.
    """
    out = np.clip(np.asarray(pi, float), 0.0, 1.0)
    out[out <= _NEAR], out[out >= 1 - _NEAR] = 0.0, 1.0
    open_ = np.flatnonzero((out > 0) & (out < 1))
    open_ = open_[np.argsort(-np.asarray(size, float)[open_], kind="stable")]
    s = np.asarray(size, float)[open_]
    p = out[open_]
    draws = iter(rng.random(len(open_) + 8).tolist())
    while len(p) > 2 or landing and len(p):
        if len(p) > 2:
            n, one, two = len(p), s.sum(), (s * s).sum()
            det = two * n - one * one
            if det > 1e-9 * two * n:
                k = int(np.argmax(1 - (two - 2 * one * s + n * s * s) / det > 1e-9))  # the first that can move at all
                u = -(((s[k] * n - one) * s + (two - s[k] * one)) / det)
            else:
                k, u = 0, np.full(n, -1.0 / n)
            u[k] += 1.0
        elif len(p) == 2:  # the landing gives up the documents' total, then the words'
            u = np.array([s[1], -s[0]]) if s[1] > 0 else np.array([1.0, 0.0])
        else:
            u = np.ones(1)
        u[np.abs(u) < 1e-12] = 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - p) / u, np.where(u < 0, p / -u, np.inf)).min()
            down = np.where(u > 0, p / u, np.where(u < 0, (1 - p) / -u, np.inf)).min()
        p = p + u * (up if next(draws) * (up + down) < down else -down)
        p[p <= _NEAR], p[p >= 1 - _NEAR] = 0.0, 1.0
        settled = (p == 0) | (p == 1)
        out[open_[settled]] = p[settled]
        open_, s, p = open_[~settled], s[~settled], p[~settled]
    out[open_] = p
    return out


def _fly(landing: bool, key: list[str]):
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", *[c for c in key if c != "source"], "copy"], kind="stable")
        rng = np.random.default_rng([int(rows["source_no"].iloc[0]), int(rows["block"].iloc[0]), int(rows["level"].iloc[0])])
        rows["open"] = flight(rows["open"].to_numpy(), rows["size"].to_numpy(), rng, landing)
        return rows

    return block


# ------------------------------------------------------------------ the operator


def _targets_in_tables(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source_no, source, size, n, target) of any number of sources, as ``targets`` has it.

    Their order is that of a range partitioning, numbered by the partitions' counts; a round adds up the sources that aren't at
    their limit, until none more gets there. All sums are whole numbers, so they are the same in any order.
    """
    spark = sources.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = sources.withColumn("last", F.col("source").isNull()).repartitionByRange(width, "last", "source").sortWithinPartitions("last", "source")
    ordered = stored(ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "mix-sources")
    counts = {r["part"]: r["count"] for r in ordered.groupBy("part").count().collect()}  # a row a partition
    before = {p: sum(n for q, n in counts.items() if q < p) for p in counts}
    number = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("part")] + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    rows = ordered.withColumn("source_no", number).withColumn("weight", weight).select("source_no", "source", "size", "n", "weight")
    unit, full = 0.0, F.lit(False)
    while True:
        open_ = ~full & (F.col("size") > 0)
        r = rows.agg(F.sum("size").alias("all"), F.sum(F.when(full, F.col("size"))).alias("capped"), F.sum(F.when(open_, F.col("weight"))).alias("weights")).first()
        if not r["weights"]:
            break
        unit = (r["all"] - most * (r["capped"] or 0)) / r["weights"]
        above = F.col("weight") * unit > most * F.col("size")
        if rows.where(open_ & above).isEmpty():
            break
        full = full | (above & (F.col("size") > 0))
        rows = stored(rows.drop("full").withColumn("full", full), "mix-sources")
        full = F.col("full")
    goal = F.when(F.col("size") == 0, 0.0).when(full, most * F.col("size")).otherwise(F.col("weight") * unit)
    return rows.withColumn("target", goal).select("source_no", "source", "size", "n", "target")


def _source_table(docs: DataFrame, weights: tuple[float, ...], most: float) -> tuple[DataFrame, bool]:
    """A row a source: source_no, source, source_size, target, whole, open, blocks; and whether they are few. ``docs``: source, size, n."""
    spark = docs.sparkSession
    sources = stored(docs.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")), "mix-by-source")
    few = sources.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    if few:
        rows = sorted(sources.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
        goal = targets([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], most)
        table = spark.createDataFrame([(i, r["source"], r["size"], r["n"], t) for i, (r, t) in enumerate(zip(rows, goal, strict=True))], "source_no long, source string, size long, n long, target double")
    else:
        table = stored(_targets_in_tables(sources, weights, most), "mix-targets")
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    whole = F.least(F.floor(rate + _NEAR), F.lit(int(most)))
    table = table.withColumn("whole", whole).withColumn("open", F.least(F.greatest(rate - whole, F.lit(0.0)), F.lit(1.0)))
    return table.select("source_no", "source", F.col("size").alias("source_size"), "target", "whole", "open", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")), few


def decide(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """For each of the ``n`` documents of a row (key..., source, size, n): key..., copy (0 to n - 1), its source's size and target,
    and ``times``, how often the mix takes it. Rows have distinct keys."""
    prepare(rows.sparkSession)
    key = [c for c in rows.columns if c != "n"]
    table, few = _source_table(rows, weights, most)
    level, parts = 0, []
    # what stands for many rows alike is spread before it is dealt out
    spread = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(ALIKE).cast("long"))).alias("_from")).repartition(*key, "_from")
    each = spread.select(*key, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + ALIKE, F.col("n")) - 1)).alias("copy"))
    each = each.withColumnRenamed("source", "_name").join(F.broadcast(table) if few else table, F.col("_name").eqNullSafe(table["source"])).drop("_name")
    work = each.withColumn("order", F.xxhash64(*[c for c in key if c != "source"], "copy"))
    while True:
        work = work.withColumns({"block": F.pmod("order", F.greatest("blocks", F.lit(1))), "level": F.lit(level)})
        last = level > 0 and work.agg(F.max("blocks")).first()[0] in (None, 1)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in work.schema])
        done = stored(work.groupBy("source_no", "block").applyInPandas(_fly(last, key), schema), f"mix-{level}")
        closed = (F.col("open") == 0) | (F.col("open") == 1)
        parts.append(done.where(closed))
        if last:
            break
        left = done.where(~closed)
        count = left.groupBy("source_no").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        work = left.drop("blocks").join(F.broadcast(count) if few else count, "source_no")
        work = work.select(*[c for c in done.columns if c not in ("block", "level")])
        level += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*key, "copy", "source_size", "target", (F.col("whole") + F.col("open").cast("long")).alias("times"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in("text").alias("size"))
    alike = stored(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    return decide(alike, weights, most).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """The rows of ``docs`` of which the mix takes any words, with all their columns and mix_size, mix_target, mix_copies.

    The rows are written with a number first. Those alike in id, source, size and a hash of the text are numbered again
    among themselves, within each partition and then by the partitions' counts, so no task holds all of them.
    """
    row = next(n for n in ("_row" + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    key = ["doc_id", "h", "source", "size"]
    sized = rows.select(F.col(row).alias("_at"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("source").cast("string").alias("source"), words_in("text").alias("size"))
    sized = stored(sized.withColumn("part", F.shiftright("_at", 33)), "mix-sizes")
    times = stored(decide(sized.groupBy(*key).agg(F.count("*").alias("n")), weights, most), "mix-times").where("times > 0 and size > 0")
    counts = sized.groupBy(*key, "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).where("before is not null")
    same = lambda a, b, more: (a["doc_id"].eqNullSafe(b["doc_id"])) & (a["h"] == b["h"]) & a["source"].eqNullSafe(b["source"]) & (a["size"] == b["size"]) & more
    placed = sized.withColumn("k", F.row_number().over(Window.partitionBy(*key, "part").orderBy("_at")) - 1)
    placed = placed.join(before, same(placed, before, placed["part"] == before["part"]), "left").select(*[placed[c] for c in key], "_at", (F.col("k") + F.coalesce("before", F.lit(0))).alias("copy"))
    plan = placed.join(times, same(placed, times, placed["copy"] == times["copy"])).select("_at", placed["size"].alias("mix_size"), F.col("target").alias("mix_target"), F.col("times").alias("mix_copies"))
    return rows.join(plan, rows[row] == plan["_at"]).select(*[rows[f"`{c}`"] for c in docs.columns], "mix_size", "mix_target", "mix_copies")


__all__ = ["decide", "flight", "mix", "mixed", "targets"]
