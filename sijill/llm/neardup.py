"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges.

1. One pass over the texts gives each document the size of its set of word shingles, a 128-bit sum that names the set,
   and a signature: one permutation of the shingles, cut into SLOTS bins, the least hash of each bin. An empty bin borrows
   from the full bin that a fixed random order of its own names first, so two sets agree in a slot with a probability
   equal to their similarity.
2. Documents with equal sets are one class with a number; the rest works on one text a class, and ids play no part in it.
3. A band of ROWS slots is a bucket. First each member of a bucket has one candidate edge, to the least hub of its buckets:
   a group of copies costs a star, not all its pairs. The links confirmed so form components. Then, twice, the members
   of a bucket that are not in its largest component are compared with that component, which leaves the bucket. What is
   left, few classes a bucket, is compared all with all. So every two classes in a bucket are in one component or
   were compared, or can't be linked, and no link within a bucket is lost.
4. To compare with a component, all members and all outsiders are measured against one of its members, the pivot, which takes
   time in proportion to their number. One minus the similarity is a metric: two sets can only be linked if their distances to
   the pivot differ by no more than a link's, and if their sizes are near enough. So members and outsiders are cut into bands of
   distance and of size, and only neighbouring bands meet. A cluster of copies and what only shares a passage with it never do.
5. Comparing is exact, on the full sets made again from the texts, in groups of at most about FAN texts a side; large
   bands and buckets are cut into such blocks, and the blocks of one are dealt to the tasks one after the other. Pairs never
   become rows: a group gives each class the least one it is joined with there.
6. Components of these edges come from label propagation with pointer jumping, on tables.

Edge cases: null and blank texts have no shingles and are linked with nothing; texts shorter than a shingle have one, all
their words; a document with a null doc_id links as any other, never names a component (null if all ids in it are) and isn't
kept; repeated rows are copies with one id, all kept if that id is; rows that share an id but not a text are documents of
their own, each with its own component; an empty table gives an empty result; other columns are neither read nor clash.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sijill.llm.common import mix, numbers, prepare, release, shingle_sets, stored, texts

#: Long bands keep apart what shares a passage only; so many of them lose a pair at 0.8 with a probability of 8 in a million.
SLOTS = 512
ROWS = 8
#: Documents of a block; two blocks meet in a group.
FAN = 256
FAN_SHINGLES = 1 << 18
#: Rows of a table of ids or groups that is broadcast, some 30 bytes each; with more, a shuffle join does it.
MOST_IDS = 2_000_000
#: Components that are broadcast with their ids, some 20 bytes each.
BROAD = 100_000


# ------------------------------------------------------------------ signatures


@functools.lru_cache(2)
def _borrow(slots: int) -> np.ndarray:
    """For each slot (row) the rank of each bin in the order in which an empty slot asks the bins."""
    return mix(numbers(21, slots)[:, None] ^ numbers(22, slots)[None, :]).argsort(1).argsort(1).astype(np.int32)


def signature(shingles: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """``shingles``: distinct hashes in ascending order, at least one."""
    bits = slots.bit_length() - 1
    edges = np.searchsorted(shingles, np.arange(slots, dtype=np.uint64) << np.uint64(64 - bits))
    full = np.flatnonzero(np.diff(np.append(edges, len(shingles))))
    out = np.empty(slots, np.uint64)
    out[full] = shingles[edges[full]]
    if len(full) < slots:
        empty = np.setdiff1d(np.arange(slots), full, assume_unique=True)
        out[empty] = out[full[_borrow(slots)[empty][:, full].argmin(1)]]
    return out


def bands(sign: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key a band, the band's number in it."""
    parts = sign.reshape(-1, rows)
    key = numbers(23, len(parts))
    for i in range(rows):
        key = mix(key ^ parts[:, i])
    return key


def keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The buckets of a set; none, if only an equal set is similar enough."""
    if 100 * len(shingles) < percent * (len(shingles) + 1):
        return np.zeros(0, np.uint64)
    return bands(signature(shingles))


def _signed(batches, width: int, percent: int):
    for b in batches:
        sizes, high, low, own = [], [], [], []
        for part in texts(b.column("text")):
            for s in shingle_sets(part, width):
                sizes.append(len(s))
                high.append(int(mix(s ^ numbers(24, 1)[0]).sum(dtype=np.uint64).view(np.int64)))
                low.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                own.append(keys(s, percent).view(np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in own])]).astype(np.int32)
        flat = np.concatenate(own) if own else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("th"), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            ["doc_id", "th", "n_shingles", "high", "low", "keys"],
        )


# ------------------------------------------------------------------ comparing


def _joined(sets: list[np.ndarray], ids: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """For each document the least id it is joined with by links of the group. ``side``: 0 and 1 meet each other, 2 all."""
    size = np.array([len(s) for s in sets])
    left = np.flatnonzero(side != 1)
    every = np.concatenate([sets[i] for i in left]) if len(left) else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(np.arange(len(left)), size[left])[order]
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for j in np.flatnonzero(side != 0):
        low, high = np.searchsorted(every, sets[j], "left"), np.searchsorted(every, sets[j], "right")
        n = high - low
        where = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        same = np.bincount(owner[where], minlength=len(left))
        linked = left[(same > 0) & (100 * same >= percent * (size[left] + size[j] - same))]
        linked = linked[linked != j]
        x.append(linked)
        y.append(np.full(len(linked), j))
    x, y = np.concatenate(x), np.concatenate(y)
    label = ids.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        if (new == label).all():
            return label
        label = new


def _compared(batches, width: int, percent: int, pivot: bool):
    """Rows of one group are consecutive.

    Yields (a, b, same): a node and the least one it is joined with there; or, with ``pivot``, each node of side 1, the one of
    side 0, and the number of shingles that they share.
    """
    held: list[tuple[np.ndarray, int, int]] = []
    last, found = None, []

    def done() -> pa.RecordBatch:
        sets, ids, side = [h[0] for h in held], np.array([h[1] for h in held]), np.array([h[2] for h in held])
        least = _joined(sets, ids, side, percent)
        some = least != ids
        return _links(ids[some], least[some], np.zeros(some.sum(), np.int64))

    for b in batches:
        groups, ids, side = (b.column(c).to_pylist() for c in ("grp", "node", "side"))
        for part in texts(b.column("text")):
            for i, s in enumerate(shingle_sets(part, width), part.first):
                if pivot:  # it comes first in its group, and only it is held
                    if side[i] == 0:
                        held = [(s, ids[i], 0)]
                    else:
                        one = held[0][0]
                        found.append((ids[i], held[0][1], int(np.count_nonzero(one[np.minimum(np.searchsorted(one, s), len(one) - 1)] == s))))
                    continue
                if held and groups[i] != last:
                    yield done()
                    held = []
                last = groups[i]
                held.append((s, ids[i], side[i]))
        if found:
            yield _links(*(np.array(c, np.int64) for c in zip(*found, strict=True)))
            found = []
    if held and not pivot:
        yield done()


def _links(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(same)], ["a", "b", "same"])


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of ``nodes`` (node, rid, th): a text is found by its row's id and its hash; of rows alike one text."""
    nodes = nodes.select("node", "rid", F.col("th").alias("h"))
    few = nodes.limit(MOST_IDS + 1).count() <= MOST_IDS
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = own.join(F.broadcast(nodes) if few else nodes, (F.col("th") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("rid")))
    return found.groupBy("node").agg(F.min("text").alias("text"))


def _small(table: DataFrame) -> DataFrame:
    """A stored table of a row a group, broadcast if it has at most MOST_IDS rows: then no group's rows are sent to one place."""
    return F.broadcast(table) if table.limit(MOST_IDS + 1).count() <= MOST_IDS else table


class _Work:
    """What all steps share: the texts of the classes in buckets, and the shingles' width and the similarity."""

    def __init__(self, texts_: DataFrame, width: int, percent: int):
        self.texts, self.width, self.percent = texts_, width, percent
        self.n = int(texts_.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(self, rows: DataFrame, pivot: bool = False) -> DataFrame:
        """(a, b, same) of ``rows`` (grp, task, node, side), as ``_compared`` has it."""
        rows = stored(rows, "dedup-groups")
        dealt = rows.join(self.texts, "node").repartitionById(self.n, "task").sortWithinPartitions("grp", "side", "node").select("grp", "node", "side", "text")
        return stored(dealt.mapInArrow(functools.partial(_compared, width=self.width, percent=self.percent, pivot=pivot), "a long, b long, same long"), "dedup-links")

    def task(self, of: str, place: Column) -> Column:
        """The blocks of one group go to one task after the other."""
        return F.pmod(F.pmod(F.xxhash64(of), F.lit(self.n)) + place, F.lit(self.n)).cast("int")

    def measured(self, pairs: DataFrame, sizes: DataFrame) -> DataFrame:
        """(node, whole, size, far) of ``pairs`` (node, whole): the node's size, and its distance to the node ``whole``."""
        cells = _small(stored(pairs.groupBy("whole").agg(F.ceil(F.count("*") / FAN).cast("int").alias("cells")), "dedup-cells"))  # one text is held at a time
        one = cells.select("whole", F.col("whole").alias("node"), _to("cells").alias("i"), F.lit(0).alias("side"))
        two = pairs.join(cells, "whole").select("whole", "node", F.pmod(F.xxhash64("node"), "cells").cast("int").alias("i"), F.lit(1).alias("side"))
        rows = one.unionByName(two).select(F.xxhash64("whole", "i").alias("grp"), self.task("whole", F.col("i")).alias("task"), "node", "side")
        found = self.compare(rows, True).select(F.col("a").alias("node"), F.col("b").alias("whole"), "same")
        found = found.join(sizes, "node").join(sizes.select(F.col("node").alias("whole"), F.col("size").alias("other")), "whole")
        union = F.col("size") + F.col("other") - F.col("same")
        return found.select("node", "whole", "size", (1 - F.col("same") / union).alias("far"), (100 * F.col("same") >= self.percent * union).alias("linked"))

    def band(self, size: str) -> Column:
        """Sets of linked sizes are in one or in neighbouring bands."""
        return F.floor(F.log(F.col(size)) / (math.log(100 / self.percent) + 1e-6)).cast("int")

    def ring(self, far: str) -> Column:
        """Sets that may be linked by their distances to a pivot are in one or in neighbouring rings."""
        return F.floor(F.col(far) / (1 - self.percent / 100 + 1e-6)).cast("int")

    def grid(self, outside: DataFrame, inside: DataFrame) -> DataFrame:
        """Groups in which each ``node`` of ``outside`` (of, node, size) meets all of ``inside`` with the same ``of``."""
        cells = _small(stored(outside.groupBy("of").agg(_cells().alias("across")).join(inside.groupBy("of").agg(_cells().alias("down")), "of"), "dedup-cells"))
        one = inside.join(cells, "of").select("of", "node", "across", F.pmod(F.xxhash64("node"), "down").cast("int").alias("i"), _to("across").alias("j"), F.lit(0).alias("side"))
        two = outside.join(cells, "of").select("of", "node", "across", F.pmod(F.xxhash64("node"), "across").cast("int").alias("j"), _to("down").alias("i"), F.lit(1).alias("side"))
        return one.unionByName(two).select(F.xxhash64("of", "i", "j").alias("grp"), self.task("of", F.col("i") * F.col("across") + F.col("j")).alias("task"), "node", "side")

    def against(self, work: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
        """Edges (a, b) by which the nodes of ``work`` (whole, node) are joined to members of component ``whole``."""
        wholes = _small(stored(work.select("whole").distinct(), "dedup-wholes"))
        members = labels.withColumnRenamed("component", "whole").join(wholes, "whole", "left_semi").where("node <> whole").select("node", "whole")
        found = stored(self.measured(work.select("node", "whole").unionByName(members), sizes), "dedup-measured")
        mine = found.join(members, ["node", "whole"], "left_semi").select("node", "whole", "size", "far")
        pivots = wholes.join(sizes, wholes["whole"] == sizes["node"]).select("node", "whole", "size", F.lit(0.0).alias("far"))
        others = found.join(work, ["node", "whole"], "left_semi")
        direct = others.where("linked").select(F.col("node").alias("a"), F.col("whole").alias("b"))
        beside = lambda c: F.explode(F.sequence(c - 1, c + 1))
        place = F.xxhash64("whole", "sb", "db").alias("of")
        inside = mine.unionByName(pivots).select("node", "whole", self.band("size").alias("sb"), self.ring("far").alias("db"), "size").select(place, "node", "size")
        outside = others.where("not linked").select("node", "whole", "size", beside(self.band("size")).alias("sb"), self.ring("far").alias("d")).select("node", "whole", "size", "sb", beside(F.col("d")).alias("db")).select(place, "node", "size")
        return direct.unionByName(self.compare(self.grid(outside, inside)).select("a", "b"))

    def among(self, live: DataFrame) -> DataFrame:
        """Edges among the members of each bucket of ``live`` (key, node, size): those of one size band, and those of neighbouring ones."""
        banded = stored(live.select("key", "node", "size", self.band("size").alias("sb")), "dedup-banded")
        cells = _small(stored(banded.groupBy("key", "sb").agg(_cells().alias("cells"), F.count("*").alias("n")).where("n > 1"), "dedup-cells"))
        placed = banded.join(cells, ["key", "sb"]).select(F.xxhash64("key", "sb").alias("of"), "node", F.pmod(F.xxhash64("node"), "cells").cast("int").alias("own"), _to("cells").alias("other"))
        side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
        low, high = F.least("own", "other"), F.greatest("own", "other")
        same = placed.select(F.xxhash64("of", low, high).alias("grp"), self.task("of", F.floor(high * (high + 1) / 2) + low).alias("task"), "node", side.alias("side"))
        next_ = self.grid(banded.select(F.xxhash64("key", F.col("sb") - 1, F.lit("next")).alias("of"), "node", "size"), banded.select(F.xxhash64("key", "sb", F.lit("next")).alias("of"), "node", "size"))
        return self.compare(same.unionByName(next_)).select("a", "b")


def _to(cells: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(cells) - 1))


def _cells() -> Column:
    """Blocks of at most about FAN sets and FAN_SHINGLES of their elements; a larger set is a block of its own."""
    return F.greatest(F.ceil(F.count("*") / FAN), F.ceil(F.sum("size") / FAN_SHINGLES)).cast("int")


# ------------------------------------------------------------------ components


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that it reaches.

    Each step takes the least label among a node and its neighbours, then jumps to the label's own label; the number of
    steps grows with the logarithm of the longest path. The tables are cut each step and never leave the executors.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "dedup-edges")
    large = max(1000, both.count() // BROAD)
    hubs = stored(both.groupBy("b").count().where(F.col("count") > large).select("b"), "dedup-hubs")  # at most BROAD, and so are their labels
    few, some = both.join(F.broadcast(hubs), "b", "left_anti"), both.join(F.broadcast(hubs), "b", "left_semi")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).select(F.col("a").alias("node"), "component"), "dedup-labels")
    any_hub = not hubs.isEmpty()
    while True:
        seen = few.join(labels, few["b"] == labels["node"]).select("a", "component")
        if any_hub:
            known = labels.join(F.broadcast(hubs), labels["node"] == hubs["b"], "left_semi").select(F.col("node").alias("b"), "component")
            seen = seen.unionByName(some.join(F.broadcast(known), "b").select("a", "component"))
        near = seen.groupBy("a").agg(F.min("component").alias("near"))
        step = stored(labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("component", "near").alias("best")), "dedup-step")
        # only labels that have a lower one themselves jump, each of them once; so the nodes of one large component aren't sent to one place
        lower = labels.where("component < node").select(F.col("node").alias("best"), F.col("component").alias("far"))
        jump = stored(step.select("best").distinct().join(lower, "best"), "dedup-jumps")
        new = step.join(_small(jump), "best", "left")
        new = stored(new.select("node", F.col("component").alias("old"), F.least("best", "far").alias("component")), "dedup-labels")
        release(labels, step, jump)
        if new.where("old <> component").isEmpty():
            release(both, hubs)
            return new.select("node", "component")
        labels = new


# ------------------------------------------------------------------ the operator


def _linked(members: DataFrame, work: _Work) -> DataFrame | None:
    """(node, component) over the links of ``members`` (key, node, size), buckets of two and more; None without any."""
    live = members.withColumn("component", F.col("node"))
    sizes = stored(members.select("node", "size").distinct(), "dedup-sizes")
    if sizes.isEmpty():
        return None
    hubs = live.groupBy("key").agg(F.min("node").alias("hub"))
    star = stored(live.join(hubs, "key").where("node <> hub").groupBy("node").agg(F.min("hub").alias("whole")), "dedup-star")
    links = work.measured(star, sizes).where("linked").select(F.col("node").alias("a"), F.col("whole").alias("b"))
    labels = components(links)
    for _ in range(2):
        live = _relabelled(live, labels)
        parts = live.groupBy("key", "component").agg(F.count("*").alias("n"))
        main = parts.groupBy("key").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("whole"), F.count("*").alias("parts")).where("parts > 1").select("key", "whole")
        live = stored(live.join(main, "key").where("component <> whole"), "dedup-live")
        todo = stored(live.select("whole", "node").distinct(), "dedup-work")
        if todo.isEmpty():
            return labels
        links = stored(links.unionByName(work.against(todo, labels, sizes)), "dedup-all-links")
        labels = components(links)
        live = live.drop("whole")
    live = _relabelled(live, labels)
    open_ = live.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
    rest = stored(live.join(open_, "key", "left_semi").select("key", "node", "size"), "dedup-rest")
    return labels if rest.isEmpty() else components(links.unionByName(work.among(rest)))


def _named(names: DataFrame, n: int) -> DataFrame:
    """(h, l, component_id) of ``names`` (h, l, node, rid, component): the least id of its component.

    The largest components, at most BROAD of them, are broadcast; so no task of the join holds more than a BROAD-th of all classes.
    """
    large = max(1000, n // BROAD)
    least = names.groupBy("component").agg(F.min("rid").alias("least"), F.count("*").alias("n"))
    big = least.where(F.col("n") > large).select(F.col("component").alias("b"), F.col("least").alias("of_big"), F.lit(True).alias("is_big"))
    names = names.join(F.broadcast(big), names["component"] == F.col("b"), "left")
    names = names.withColumn("k", F.when(F.col("is_big"), -1 - F.col("node")).otherwise(F.col("component")))
    rest = least.where(F.col("n") <= large).select(F.col("component").alias("k"), F.col("least").alias("of_rest"))
    return names.join(rest, "k", "left").select("h", "l", F.when(F.col("is_big"), F.col("of_big")).otherwise(F.col("of_rest")).alias("component_id"))


def _relabelled(live: DataFrame, labels: DataFrame) -> DataFrame:
    new = labels.withColumnRenamed("component", "new")
    return live.join(new, "node", "left").select("key", "node", "size", F.coalesce("new", "component").alias("component"))


def classes(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    return _classes(docs, width, percent).drop("th")


def _classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sign = functools.partial(_signed, width=width, percent=percent)
    signed = own.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(sign, "doc_id long, th long, n_shingles long, high long, low long, keys array<long>")
    signed = stored(signed, "dedup-signed")
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    reps = signed.where("n_shingles > 0").groupBy("high", "low").agg(row.alias("r"), F.first("n_shingles").alias("size"))
    reps = stored(reps.select("high", "low", "size", F.col("r.doc_id").alias("rid"), F.col("r.th").alias("th")).withColumn("node", F.monotonically_increasing_id()), "dedup-classes")
    rep = [F.col(c).alias(f"_{c}") for c in ("high", "low", "rid", "th")]
    here = (F.col("high") == F.col("_high")) & (F.col("low") == F.col("_low")) & (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_rid"))
    keys_of = signed.where("size(keys) > 0").select("doc_id", "th", "high", "low", "keys").join(reps.select(*rep, "node", "size"), here)
    keyed = stored(keys_of.select("node", "size", "keys"), "dedup-keys").select("node", "size", F.explode("keys").alias("key"))
    buckets = stored(keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key"), "dedup-buckets")
    members = stored(keyed.join(buckets, "key", "left_semi").distinct(), "dedup-members")  # rows alike have a class's keys twice
    texts_ = stored(_texts_of(own, reps.join(members.select("node").distinct(), "node", "left_semi")), "dedup-texts")
    found = _linked(members, _Work(texts_, width, percent))
    names = reps.select(F.col("high").alias("h"), F.col("low").alias("l"), "node", "rid")
    names = names.withColumn("component", F.col("node")) if found is None else names.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = _named(names, reps.count())
    out = signed.drop("keys").join(names, (F.col("high") == F.col("h")) & (F.col("low") == F.col("l")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    kept: Column = F.coalesce(F.col("doc_id") == component, F.lit(False))
    return out.select("doc_id", "th", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is their component's, with their columns.

    A row with a null id goes if its component has a named one, else it stays. Rows are matched by id and a hash of the text, so of
    rows that share an id but not a text only those go that are copies.
    """
    gone = _classes(docs, width, percent).where("not kept and component_id is not null").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    return docs.join(gone, (F.xxhash64(docs["text"].cast("string")) == gone["_th"]) & docs["doc_id"].eqNullSafe(gone["_id"]), "left_anti")
