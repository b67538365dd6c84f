"""Near-duplicate embeddings by collision-counting projections.

Vectors are projected on many random lines. Two unit vectors at the threshold cosine are ``FAR`` apart, so on a line they
differ by a normal variable of that deviation. Of the lines,

* some route: cut into cells of width WIDE and taken several at a time they form a table's key, and only vectors with
  a key in common meet. As many lines a table are used as keep unlike vectors apart at this number of vectors, and as many
  tables as let a pair at the threshold meet with probability RECALL;
* COUNTED others are sorted within a bucket, and a pair collides on a line if one lies in the window of half-width
  WINDOW around the other. Pairs with ``collisions`` or more of them are verified by cosine in double precision; that number
  is calibrated to lose a pair at the threshold with probability 1 - RECALL at most.

Single projections can't keep unlike vectors apart without comparing a fixed share of all pairs (two unlike vectors share a
window of a line with probability 0.22), so the routing lines bound which pairs are counted; that both lose few is measured
against brute force in the tests.

Vectors alike in every component and their label are one class with a number and a weight, so copies cost nothing and ids play
no part in comparing. A bucket of more than BLOCK classes is cut into blocks, each pair of blocks is a group, and the groups of
a bucket are dealt to the tasks one after the other, so no task grows with the bucket. Pairs never become rows: a group
gives each class's number of links and an edge to the least class it is joined with there. A pair that meets in several
tables counts in the first.

Edge cases: vectors that are null, zero, or hold null or non-finite components, and those with a null label, link with
nothing and are components of their own; vectors of different lengths don't link; a vector with a null vec_id links as any
other, never names a component (null if all ids in it are) and isn't kept; rows that share an id are vectors of their own,
each with its own links; an empty table gives an empty result; other columns are neither read nor clash.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sijill.llm.common import mix, numbers, prepare, stored
from sijill.llm.neardup import components

COSINE = 0.98
RECALL = 0.99999
#: Cells of a routing line and half-widths of a window, for unit vectors on standard normal lines.
WIDE = 2.0
WINDOW = 0.4
COUNTED = 32
BLOCK = 320
#: Up to this size a group's pairs are looked at all together with those of other groups.
SMALL = 48

FAR = math.sqrt(2 - 2 * COSINE)


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def _same_cell(far: float) -> float:
    """How likely two vectors that far apart share a cell of a line."""
    r = WIDE / far
    return 1 - 2 * _phi(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int) -> tuple[int, int]:
    """Lines a table, and tables, for ``n`` vectors: unlike ones (at right angles) share few buckets, like ones at least one."""
    lines = max(6, math.ceil(math.log(max(n, 2)) / -math.log(_same_cell(math.sqrt(2)))))
    return lines, math.ceil(math.log(1 - RECALL) / math.log(1 - _same_cell(FAR) ** lines))


def collisions(lines: int = COUNTED) -> int:
    """The largest count that a pair at the threshold reaches with probability RECALL."""
    p = 2 * _phi(WINDOW / FAR) - 1
    lost, c = 0.0, 0
    while True:
        lost += math.comb(lines, c) * p**c * (1 - p) ** (lines - c)
        if lost > 1 - RECALL:
            return c
        c += 1


@functools.lru_cache(8)
def _lines(dims: int, seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(n, dims)).T


def _unit(v) -> np.ndarray:
    """A unit vector in double precision."""
    v = np.asarray(v, float)
    v = v / np.abs(v).max()
    return v / np.sqrt((v * v).sum())


def _keyed(batches, lines: int, tables: int):
    shift = np.random.default_rng(41).uniform(0, WIDE, lines * tables)
    for b in batches:
        units = [_unit(v) for v in b.column("embedding").to_numpy(zero_copy_only=False)]
        labels = np.array(b.column("label_hash").to_pylist(), np.int64).view(np.uint64)
        size = np.array([len(v) for v in units], np.int64)
        out = np.zeros((len(units), tables), np.uint64)
        for n in np.unique(size).tolist():
            some = np.flatnonzero(size == n)
            cells = np.floor((np.stack([units[i] for i in some]) @ _lines(n, 40, lines * tables) + shift) / WIDE).astype(np.int64).view(np.uint64).reshape(len(some), tables, lines)
            key = mix(numbers(42 + n, tables)[None, :] ^ labels[some][:, None])
            for i in range(lines):
                key = mix(key ^ cells[:, :, i]) + np.uint64(i)
            out[some] = key
        offsets = np.arange(len(units) + 1, dtype=np.int32) * tables
        rest = [b.column(c) for c in ("node", "weight")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(units, pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel().view(np.int64)))], ["node", "weight", "unit", "keys"])


# ------------------------------------------------------------------ groups


def _counted_pairs(lines: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) with ``least`` collisions or more, from the sorted lines of one group."""
    n = len(lines)
    order = [np.argsort(lines[:, k], kind="stable") for k in range(COUNTED)]
    place = [lines[o, k] for k, o in enumerate(order)]
    rank = np.empty((COUNTED, n), np.int32)
    for k, o in enumerate(order):
        rank[k, o] = np.arange(n)
    found = []
    step = max(1, (1 << 20) // n)
    for a in range(0, n, step):
        rows = np.arange(a, min(n, a + step))
        count = np.zeros((len(rows), n), np.uint8)
        for k in range(COUNTED):  # the window around each query is a range of the sorted line
            low = np.searchsorted(place[k], lines[rows, k] - WINDOW, "left")[:, None]
            high = np.searchsorted(place[k], lines[rows, k] + WINDOW, "right")[:, None]
            count += (rank[k] >= low) & (rank[k] < high)
            if 0 < k + least - COUNTED and k % 8 == 7 and not (count >= k + 1 + least - COUNTED).any():
                break  # no pair can get there any more
        i, j = np.nonzero(count >= least)
        found.append((rows[i][rows[i] < j], j[rows[i] < j]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def links(unit: np.ndarray, side: np.ndarray, keys: np.ndarray, table: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs within each group that don't meet in an earlier table. ``side``: 0 and 1 meet each other, 2 all; ``edges``: where groups begin, and the end."""
    least = collisions()
    lines = unit @ _lines(unit.shape[1], 43, COUNTED)
    size, pairs = np.diff(edges), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for n in np.unique(size).tolist():
        begins = edges[:-1][size == n]
        if n > SMALL:
            for begin in begins.tolist():
                i, j = _counted_pairs(lines[begin : begin + n], least)
                pairs.append((begin + i, begin + j))
        elif n > 1:
            i, j = np.triu_indices(n, 1)
            step = max(1, (1 << 16) // len(i))
            for c in range(0, len(begins), step):
                x, y = ((begins[c : c + step, None] + k).ravel() for k in (i, j))
                good = (np.abs(lines[x] - lines[y]) <= WINDOW).sum(1) >= least
                pairs.append((x[good], y[good]))
    i, j = np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
    good = (side[i] == 2) | (side[i] != side[j])
    i, j = i[good], j[good]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for c in range(0, len(i), 1 << 14):
        x, y = i[c : c + (1 << 14)], j[c : c + (1 << 14)]
        linked = (unit[x] * unit[y]).sum(1) >= COSINE
        x, y = x[linked], y[linked]
        first = ~((keys[x] == keys[y]) & (np.arange(keys.shape[1]) < table[x, None])).any(1)
        found.append((x[first], y[first]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _least(n: int, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of ``n`` the least id that it is joined with by the pairs."""
    label = ids.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        if (new == label).all():
            return label
        label = new


def _counted(batches):
    """Rows of one group are consecutive. Yields for each class with links in a group: their number and the least one joined."""

    def done(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        node, weight, size, side, table = (rows.column(c).to_numpy() for c in ("node", "weight", "size", "side", "t"))
        keys = np.stack(rows.column("keys").to_numpy())
        vectors = rows.column("unit").to_numpy()
        out = [(node[:0], weight[:0], node[:0])]
        for n in np.unique(size):  # a group's vectors are of one length, its key has it
            some = np.flatnonzero(size == n)
            own = group[some]
            edges = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
            x, y = links(np.stack(vectors[some]), side[some], keys[some], table[some], edges)
            if len(x):
                count = np.bincount(x, weight[some][y], len(some)) + np.bincount(y, weight[some][x], len(some))
                least = _least(len(some), x, y, node[some])
                hit = np.flatnonzero(count)
                out.append((node[some][hit], count[hit].astype(np.int64), least[hit]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["node", "links", "least"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        group = b.column("grp").to_numpy()
        other = np.flatnonzero(group != group[-1])
        last = int(other[-1]) + 1 if len(other) else 0  # where the batch's last group begins
        if held and not last and held[-1].column("grp")[-1].as_py() == group[0]:
            held.append(b)  # the whole batch goes on with the last group
            continue
        if held or last:
            rows = pa.Table.from_batches([*held, b.slice(0, last)]).combine_chunks()
            yield done(rows, rows.column("grp").to_numpy())
        held = [b.slice(last)]
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield done(rows, rows.column("grp").to_numpy())


# ------------------------------------------------------------------ the operator


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """A row for each row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    prepare(spark)
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), "embedding").withColumn("good", F.coalesce(good, F.lit(False)))
    named = [F.when(F.col("good"), F.xxhash64("label", F.size("embedding"), "embedding", F.lit(s))).alias(f"h{s}") for s in (1, 2)]
    rows = rows.select("vec_id", "embedding", F.xxhash64("label").alias("label_hash"), "good", *named)
    classes = rows.where("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("label_hash").alias("label_hash"), F.first("embedding").alias("embedding"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "emb-classes")
    lines, tables = plan(classes.count())
    keyed = classes.select("node", "weight", "label_hash", "embedding").mapInArrow(functools.partial(_keyed, lines=lines, tables=tables), "node long, weight long, unit array<double>, keys array<long>")
    keyed = stored(keyed, "emb-keys")
    narrow = keyed.select("node", F.posexplode("keys").alias("t", "key"))
    open_ = stored(narrow.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("cells")), "emb-open")
    met = narrow.join(open_, ["t", "key"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    placed = met.select("node", "t", "key", "own", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other"))
    low, high = F.least("own", "other").cast("long"), F.greatest("own", "other").cast("long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.select(
        "node",
        "t",
        F.xxhash64("t", "key", low, high).alias("grp"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        F.pmod(F.pmod(F.xxhash64("t", "key"), F.lit(n)) + F.floor(high * (high + 1) / 2) + low, F.lit(n)).cast("int").alias("task"),
    )
    full = stored(placed, "emb-placed").join(keyed, "node")
    grouped = full.repartitionById(n, "task").sortWithinPartitions("grp", "node").select("grp", "t", "node", "side", "weight", F.size("unit").alias("size"), "unit", "keys")
    counted = stored(grouped.mapInArrow(_counted, "node long, links long, least long"), "emb-counted")
    joined = components(counted.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    total = counted.groupBy("node").agg(F.sum("links").alias("links"))
    far = classes.select("node", "h1", "h2", "id", "weight").join(total, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = far.groupBy("component").agg(F.min("id").alias("component_id"))
    found = far.join(ids, "component").select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.drop("embedding").join(found, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
