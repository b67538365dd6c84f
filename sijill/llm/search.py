"""Ranked lexical search over a tiered index: postings of high impact first, the rest only for items that need it.

A posting's impact is what a term adds to a document's score per unit of its weight. For each term the postings of highest
impact make the first tier, the next ones the second, the rest the third; the greatest impact below a tier is the term's residual
bound. A document's postings stand in one row, a column a tier, so that a scan of the first tiers reads no others. A scan sums, for
each open item and document, what the tiers read so far give (a lower bound) and adds the bounds of the terms not met (an upper
bound); a task passes on its best ``TOP`` documents an item and the greatest upper bound of all others. The best candidates get
their exact score from their whole rows. An item is done when no other document's upper bound reaches its last place; those without
that proof are searched again with one more tier, at last with all, where bounds are exact scores.

The index covers every document, and of the terms those that items ask for. Bound: items go in blocks of ``ITEMS`` and
``ITEM_BYTES``, each with an index of its own. Terms are compared by 64-bit hashes.

Edge cases: null texts and those without a term aren't counted and never found; a null ``doc_id`` counts in all totals but isn't
ranked; repeated rows are documents of their own, ranked next to each other; benchmark rows alike in id and text are one item,
others with the same id items of their own; items without terms, or none at all, and an empty table give no rows; equal scores
rank by id, and rows of one id and score by their place in the table; other columns neither count nor clash.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sijill.llm.common import Texts, prepare, release, stored, texts, word_hashes

TOP = 20
#: Items of a block, and bytes of their texts.
ITEMS, ITEM_BYTES = 2000, 1 << 20
#: A term's postings in the first tier, and in the first two: a share of them, but so many at least (more where a bin goes on).
SHARES, LEAST = (1 / 64, 1 / 8), (256, 2048)
TIERS = len(SHARES) + 1
#: Impacts are under a million; a bin of them is so wide.
BIN = 1 << 14
_BINS = 1_000_000 // BIN + 1
#: Cells (document, item) that are summed at a time.
_CELLS = 1 << 20

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


# ------------------------------------------------------------------ terms


def terms(part: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each term of the slice: letters and digits, and all beyond ASCII, A-Z taken as a-z."""
    inside = np.zeros(len(part.data) + 2, bool)
    inside[1:-1] = _INSIDE[part.data]
    first = np.zeros(len(part.data) + 1, bool)
    first[part.offsets] = True
    begin = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    return word_hashes(part.data, begin, end), np.searchsorted(part.offsets, begin, "right") - 1


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """What a term that stands ``tf`` times in a document of ``n`` terms adds per unit of its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * n * docs // words))


class Block:
    """Items of one index: their terms (sorted hashes), and for each term the items that hold it and how often."""

    def __init__(self, rows: list):
        self.ids, hashes, owners = [r["item_id"] for r in rows], [], []
        for i, r in enumerate(rows):
            for part in texts(pa.array([r["text"]], pa.string())):
                h, _ = terms(part)
                hashes.append(h)
                owners.append(np.full(len(h), i))
        self.terms, term = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]), return_inverse=True)
        pairs, self.times = np.unique(term * len(rows) + np.concatenate([*owners, np.zeros(0, np.int64)]).astype(np.int64), return_counts=True)
        self.term, self.item = pairs // len(rows), pairs % len(rows)


class Weights:
    """A block with what a scan of some tiers needs: a term's weight and residual bound, its bins' limits, and the open items."""

    def __init__(self, block: Block, docs: int, words: int, weight: np.ndarray, cuts: np.ndarray, bounds: np.ndarray):
        self.block, self.docs, self.words, self.weight, self.cuts, self.bounds = block, docs, words, weight, cuts, bounds

    def scan(self, tier: int, items: list[int]) -> Scan:
        return Scan(self, tier, items)


class Scan:
    """The open items as columns: for term t the entries ``at[t]`` to ``at[t + 1]`` of ``column`` and ``gain`` (weight times repeats)."""

    def __init__(self, weights: Weights, tier: int, items: list[int]):
        b, self.items, self.tier = weights.block, np.array(items, np.int64), tier
        column = np.full(len(b.ids), -1)
        column[self.items] = np.arange(len(items))
        open_ = column[b.item] >= 0
        term, self.column, self.gain = b.term[open_], column[b.item[open_]], b.times[open_] * weights.weight[b.term[open_]]
        self.at = np.searchsorted(term, np.arange(len(b.terms) + 1))
        self.bound = weights.bounds[min(tier, TIERS - 1)]
        self.unmet = np.zeros(len(items), np.int64)
        np.add.at(self.unmet, self.column, self.gain * self.bound[term])
        self.ids = [b.ids[i] for i in items]

    def sums(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (rows, items) from the postings (row, term, impact)."""
        n = self.at[term + 1] - self.at[term]
        which = np.repeat(np.arange(len(term)), n)
        entry = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + self.at[term][which]
        cell, width = row[which] * len(self.ids) + self.column[entry], len(self.ids)
        total = functools.partial(_total, cell=cell, size=rows * width)
        low = total(self.gain[entry] * impact[which]).reshape(rows, width)
        if self.tier >= TIERS:
            return low, low
        return low, low + self.unmet - total(self.gain[entry] * self.bound[term[which]]).reshape(rows, width)


def _total(values: np.ndarray, cell: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of whole numbers a cell: the high and the low bits apart, as doubles hold 53."""
    high, low = values >> 26, values & ((1 << 26) - 1)
    return (np.bincount(cell, high, size).astype(np.int64) << 26) + np.bincount(cell, low, size).astype(np.int64)


# ------------------------------------------------------------------ index


def _lists(owner: np.ndarray, rows: int, *values: np.ndarray) -> list[pa.Array]:
    at = pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32())
    return [pa.ListArray.from_arrays(at, pa.array(v.astype(np.int32))) for v in values]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each entry of a list column."""
    at = np.asarray(column.offsets)
    return np.repeat(np.arange(len(column)), np.diff(at)), np.asarray(column.values)[at[0] : at[-1]].astype(np.int64)


def _counted(batches, shared):
    """(row, doc_id, n, term, tf) a document: how many terms it has, and of the block's terms which and how often."""
    known = shared.value.terms
    for b in batches:
        sizes, owners, found, times = [], [], [], []
        for part in texts(b.column("text")):
            h, owner = terms(part)
            sizes.append(np.bincount(owner, minlength=part.n))
            place = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            hit = known[place] == h if len(known) else np.zeros(len(h), bool)
            pairs, tf = np.unique(owner[hit] * len(known) + place[hit], return_counts=True)
            owners.append(part.first + pairs // max(len(known), 1))
            found.append(pairs % max(len(known), 1))
            times.append(tf)
        n = np.concatenate([*sizes, np.zeros(0, np.int64)])
        join = lambda x: np.concatenate([*x, np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(n, pa.int64()), *_lists(join(owners), len(n), join(found), join(times))], ["row", "doc_id", "n", "term", "tf"])


def _postings(b: pa.RecordBatch, docs: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, term = _flat(b.column("term"))
    return row, term, impacts(_flat(b.column("tf"))[1], np.asarray(b.column("n"))[row], docs, max(words, 1))


def _binned(batches, size: int, docs: int, words: int):
    """(term, bin, n, most): a task's postings by term and bin of impact."""
    n, most = np.zeros(size * _BINS, np.int64), np.zeros(size * _BINS, np.int64)
    for b in batches:
        _, term, impact = _postings(b, docs, words)
        key = term * _BINS + impact // BIN
        n += np.bincount(key, minlength=len(n))
        np.maximum.at(most, key, impact)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (some // _BINS, some % _BINS, n[some], most[some])], ["term", "bin", "n", "most"])


def _tiered(batches, shared):
    """(row, doc_id, term1, impact1, term2, ...): each posting in the column of its tier."""
    w = shared.value
    for b in batches:
        row, term, impact = _postings(b, w.docs, w.words)
        tier = (impact // BIN < w.cuts[:, term]).sum(0)
        columns = [c for k in range(TIERS) for c in _lists(row[tier == k], b.num_rows, term[tier == k], impact[tier == k])]
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *columns], ["row", "doc_id", *[f"{c}{k}" for k in range(1, TIERS + 1) for c in ("term", "impact")]])


_TIERED = "row long, doc_id long, " + ", ".join(f"term{k} array<int>, impact{k} array<int>" for k in range(1, TIERS + 1))


def index(docs: DataFrame, block) -> tuple[DataFrame, Weights]:
    """The tiered index of ``docs`` (doc_id, text) for the terms of a broadcast ``Block``, stored, and its weights."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = own.mapInArrow(functools.partial(_counted, shared=block), "row long, doc_id long, n long, term array<int>, tf array<int>")
    counted = stored(counted.where("n > 0"), "search-counts")
    total = counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    size = len(block.value.terms)
    bins = counted.mapInArrow(functools.partial(_binned, size=size, docs=total["docs"], words=total["words"]), "term long, bin long, n long, most long")
    bins = bins.groupBy("term", "bin").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    falling = Window.partitionBy("term").orderBy(F.desc("bin"))
    whole = Window.partitionBy("term")
    bins = bins.withColumn("above", F.sum("n").over(falling) - F.col("n")).withColumn("df", F.sum("n").over(whole))
    kept = [F.col("above") < F.greatest(F.lit(least), F.ceil(F.col("df") * share)) for share, least in zip(SHARES, LEAST, strict=True)]
    cuts = bins.groupBy("term").agg(F.first("df").alias("df"), *[F.min(F.when(k, F.col("bin"))).alias(f"cut{i}") for i, k in enumerate(kept)], *[F.coalesce(F.max(F.when(~k, F.col("most"))), F.lit(0)).alias(f"bound{i}") for i, k in enumerate(kept)])
    weight, limit, bound = np.zeros(size, np.int64), np.zeros((len(SHARES), size), np.int64), np.zeros((TIERS, size), np.int64)
    for r in cuts.collect():  # a row a term of the block
        weight[r["term"]] = math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * r["df"] + 1)))
        for i in range(len(SHARES)):
            limit[i, r["term"]], bound[i, r["term"]] = r[f"cut{i}"], r[f"bound{i}"]
    # bounds[k]: what is left when tiers 1 to k are read
    weights = Weights(block.value, total["docs"], total["words"], weight, limit, np.concatenate([np.zeros((1, size), np.int64), bound[: TIERS - 1]]))
    tiers = stored(counted.where("doc_id is not null and size(term) > 0").mapInArrow(functools.partial(_tiered, shared=docs.sparkSession.sparkContext.broadcast(weights)), _TIERED), "search-tiers")
    release(counted)
    return tiers, weights


# ------------------------------------------------------------------ search


def _read(b: pa.RecordBatch, tiers: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The postings of rows ``first`` to ``last`` in the first tiers."""
    part = b.slice(first, last - first)
    terms_, impacts_ = ([_flat(part.column(f"{c}{k}")) for k in range(1, tiers + 1)] for c in ("term", "impact"))
    return tuple(np.concatenate(x) for x in ([r for r, _ in terms_], [v for _, v in terms_], [v for _, v in impacts_]))


def _scanned(batches, shared):
    """(item, row, doc_id, low, high): a task's TOP documents an item by lower bound, and (row null) the greatest upper bound of all others."""
    scan = shared.value
    width, none = len(scan.ids), np.zeros((5, 0), np.int64)
    rest, least, best = np.zeros(width, np.int64), np.zeros(width, np.int64), none
    for b in batches:
        rows, ids = np.asarray(b.column("row")), np.asarray(b.column("doc_id"))
        step = max(1, _CELLS // max(width, 1))
        for first in range(0, b.num_rows, step):
            last = min(first + step, b.num_rows)
            low, high = scan.sums(*_read(b, scan.tier, first, last), last - first)
            some = (low >= least) & (low > 0)
            rest = np.maximum(rest, np.where(some, 0, high).max(0))
            r, c = np.nonzero(some)
            best, out = _leading(np.concatenate([best, np.stack([c, rows[first + r], ids[first + r], low[r, c], high[r, c]])], 1))
            np.maximum.at(rest, out[0], out[4])
            full = np.bincount(best[0], minlength=width) >= TOP
            last_low = np.full(width, np.iinfo(np.int64).max)
            np.minimum.at(last_low, best[0], best[3])
            least = np.where(full, last_low, 0)
    items = np.concatenate([best[0], np.arange(width)]).astype(np.int64)
    null = pa.nulls(width, pa.int64())
    columns = [pa.concat_arrays([pa.array(best[k]), null]) for k in (1, 2, 3)]
    yield pa.RecordBatch.from_arrays([pa.array(scan.items[items] if width else items), *columns, pa.array(np.concatenate([best[4], rest]))], ["item", "row", "doc_id", "low", "high"])


def _leading(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of columns (item, row, doc_id, low, high) the first TOP an item by low, doc_id and row, and the others."""
    order = np.lexsort((found[1], found[2], -found[3], found[0]))
    found = found[:, order]
    place = np.arange(found.shape[1]) - np.searchsorted(found[0], found[0])
    return found[:, place < TOP], found[:, place >= TOP]


def _exact(batches, shared):
    """(item, row, doc_id, score) of rows with the items (``items``) that they are candidates of."""
    scan = shared.value
    column = {int(i): k for k, i in enumerate(scan.items)}
    for b in batches:
        out = []
        for k, (row, doc, items) in enumerate(zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), b.column("items").to_pylist(), strict=True)):
            low, _ = scan.sums(*_read(b, TIERS, k, k + 1), 1)
            out += [(i, row, doc, int(low[0, column[i]])) for i in items]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], ["item", "row", "doc_id", "score"])


def _ranked(scores: DataFrame) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "row")
    return scores.where("score > 0").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= TOP)


def _searched(tiers: DataFrame, weights: Weights):
    """Tables (item, doc_id, rank, score), each of the items that a tier proves."""
    share = tiers.sparkSession.sparkContext.broadcast
    items = list(range(len(weights.block.ids)))
    for tier in range(1, TIERS + 1):
        if not items:
            return
        read = tiers.select("row", "doc_id", *[f"{c}{k}" for k in range(1, tier + 1) for c in ("term", "impact")])
        found = read.mapInArrow(functools.partial(_scanned, shared=share(weights.scan(tier, items))), "item long, row long, doc_id long, low long, high long")
        found = stored(found, "search-found")
        if tier == TIERS:
            yield _ranked(found.where("row is not null").withColumnRenamed("low", "score"))
            return
        by = Window.partitionBy("item").orderBy(F.desc("low"))
        last = found.where("row is not null").withColumn("r", F.row_number().over(by)).where(F.col("r") == TOP).select("item", F.col("low").alias("last"))
        near = found.where("row is not null").join(last, "item", "left").where("last is null or high >= last")
        near = near.groupBy("row").agg(F.collect_list("item").alias("items"))
        exact = tiers.join(near, "row").mapInArrow(functools.partial(_exact, shared=share(weights.scan(TIERS, items))), "item long, row long, doc_id long, score long")
        ranked = stored(_ranked(exact), "search-ranked")
        rest = found.where("row is null").groupBy("item").agg(F.max("high").alias("rest"))
        proof = rest.join(ranked.where(F.col("rank") == TOP).select("item", "score"), "item", "left").where("rest = 0 or rest < score").select("item")
        done = {r["item"] for r in proof.collect()}
        if done:
            yield ranked.where(F.col("item").isin(sorted(done)))
        items = [i for i in items if i not in done]


def _blocks(benchmark: DataFrame):
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    block, size = [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():  # a partition at a time
        block.append(r)
        size += len(r["text"])
        if len(block) >= ITEMS or size >= ITEM_BYTES:
            yield Block(block)
            block, size = [], 0
    if block:
        yield Block(block)


_SCHEMA = "item_id long, rank int, doc_id long, score long"


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The TOP best documents of ``docs`` (doc_id, text) for each item of ``benchmark`` (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    prepare(spark)
    out = []
    for block in _blocks(benchmark):
        tiers, weights = index(docs, spark.sparkContext.broadcast(block))
        names = spark.createDataFrame(list(enumerate(block.ids)), "item long, item_id long")
        for ranked in _searched(tiers, weights):
            out.append(ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return functools.reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], _SCHEMA)
