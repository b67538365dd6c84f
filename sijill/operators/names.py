"""Fuzzy join of short names: 0.4 of the token overlap and 0.6 of the ratio of matching blocks, a threshold or more, all such pairs.

Pairs come from inverted lists, never from a cross join. A pair with a common token is found by its rarest one (with thresholds over
0.6 common tokens are certain beyond a share, and the most frequent tokens of a name needn't be looked up). A pair without one needs
a ratio of ``least / 0.6``: with S characters together and u of them unmatched, at most u + 1 blocks match, so at least
S / 2 - 1 - 1.5 u character pairs are common, and one of them is among the rarest pairs of both names. Lists longer than ``BLOCK`` are
cut to a grid of blocks on both sides, so no task gets a frequent token whole. Two blocks meet as matrices: common tokens,
characters and character pairs, counted by products of hashed rows (never too low), bound the score from above; for what is left
the longest common subsequence does, which no matching blocks exceed (bit-parallel, 64 characters a word, all pairs of a block at
once). Pairs within the bounds are scored where they met, and only those that make the threshold leave the task.
"""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sijill.functions import text as T
from sijill.session import ship

#: Rows of a list that meet others at a time; entries of all lists that one group holds.
BLOCK, GROUP = 2048, 100_000
#: Columns of the hashed rows; characters that the longest common subsequence tells apart.
TOKENS, CHARACTERS, PAIRS, ALPHABET = 256, 256, 256, 96
_SLACK = 1e-6


def _numbered(parts: Column) -> Column:
    """Each entry with how often it stood before, so that repeats differ."""
    return F.transform(parts, lambda x, i: F.concat(x, F.lit("\0"), F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda y: y == x))))


def _side(rows: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` with their tokens and numbered character pairs (a lone character is its own)."""
    rows = rows.where(F.length(key) > 0)
    pairs = F.when(F.length(key) == 1, F.array(F.col(key))).otherwise(F.transform(F.sequence(F.lit(1), F.length(key) - 1), lambda i: F.substr(F.col(key), i, F.lit(2))))
    return rows.select(F.col(key).alias("s"), F.length(key).alias("n"), T.word_tokens(key).alias("tokens"), pairs.alias("pairs")).withColumn("pairs", _numbered(F.col("pairs")))


def _needed(total, least: float):
    """A lower bound of the character pairs that two names of ``total`` characters share, if their ratio alone makes the score."""
    return total * (1.5 * least / 0.6 - 1) - 1 - _SLACK


def _prefixes(left: DataFrame, right: DataFrame, what: str, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``prefix``: the ``keep`` rarest entries of ``what`` of each name, in order of their frequency on both sides."""
    entries = [side.select("s", F.explode(what).alias("e")) for side in (left, right)]
    df = entries[0].unionByName(entries[1]).groupBy("e").agg(F.count("*").alias("df"))
    found = []
    for side, rows in zip((left, right), entries, strict=True):
        order = rows.join(df, "e").groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "e"))), lambda x: x["e"]).alias("prefix"))
        found.append(side.join(order, "s").withColumn("prefix", F.slice("prefix", 1, F.greatest(F.lit(1), keep).cast("int"))))
    return found[0], found[1]


def _hashed(values: np.ndarray, owner: np.ndarray, rows: int, width: int) -> np.ndarray:
    """A row an owner: how many of its (value, how often it stood before) fall to each column."""
    order = np.lexsort((values, owner))
    v, o = values[order].astype(np.uint64), owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    key = (v * np.uint64(0x9E3779B97F4A7C15) + (np.arange(len(v)) - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    return np.bincount(o * width + (key % np.uint64(width)).astype(np.int64), minlength=rows * width).reshape(rows, width).astype(np.float32)


class _Rows:
    """Distinct names of a group as matrices."""

    def __init__(self, table: pa.Table, known: dict[str, int]):
        rows = table.select(["s", "tokens"]).to_pandas().drop_duplicates("s")
        names, tokens = rows["s"].tolist(), rows["tokens"].tolist()
        self.sets = [frozenset(t) for t in tokens]
        self.names, self.place = np.array(names, object), {x: i for i, x in enumerate(names)}
        self.length, self.count = np.array([len(x) for x in names]), np.array([len(t) for t in tokens])
        n, joined = len(names), "".join(names)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(n), self.length)
        self.characters = _hashed(codes, owner, n, CHARACTERS)
        both = owner[1:] == owner[:-1]
        self.pairs = _hashed((codes[:-1] << 21 | codes[1:])[both], owner[1:][both], n, PAIRS)
        ids = np.array([known.setdefault(t, len(known)) for x in tokens for t in x], np.int64)
        self._align(codes, owner)
        self.tokens = _hashed(ids, np.repeat(np.arange(n), self.count), n, TOKENS)


    def _align(self, codes: np.ndarray, owner: np.ndarray) -> None:
        """Of names up to 64 characters: the characters in order, and for each character the bits of its places."""
        n, letter = len(self.names), codes % ALPHABET
        at = np.arange(len(codes)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        short = at < 64
        self.letters = np.full((n, 64), ALPHABET, np.int64)
        self.letters[owner[short], at[short]] = letter[short]
        self.places = np.zeros((n, ALPHABET + 1), np.uint64)
        np.bitwise_or.at(self.places, (owner[short], letter[short]), np.uint64(1) << at[short].astype(np.uint64))

    def subsequence(self, i: np.ndarray, other: _Rows, j: np.ndarray) -> np.ndarray:
        """At least the longest common subsequence of names ``i`` and ``j`` of ``other``; of longer names all they could share."""
        free = np.full(len(i), ~np.uint64(0))
        for k in range(int(min(64, other.length[j].max(initial=0)))):
            met = free & self.places[i, other.letters[j, k]]
            free = (free + met) | (free - met)
        least = np.minimum(self.length[i], other.length[j])
        return np.where(np.maximum(self.length[i], other.length[j]) > 64, least, 64 - np.bitwise_count(free))


def _compared(one: pa.Table, two: pa.Table, least: float, by_pairs: bool) -> pa.Table:
    """(a, b, score) of two groups, ``least`` or more; with ``by_pairs`` of those whose ratio alone may be enough."""
    known: dict[str, int] = {}
    found: list[tuple[str, str, float]] = []
    if one.num_rows and two.num_rows:
        left, right = _Rows(one, known), _Rows(two, known)
        lists = [t.select(["e", "_down", "_across", "s"]).to_pandas().groupby(["e", "_down", "_across"])["s"].agg(list) for t in (one, two)]
        for key in lists[0].index.intersection(lists[1].index):
            i, j = (np.array([side.place[x] for x in own[key]]) for side, own in ((left, lists[0]), (right, lists[1])))
            total = left.length[i][:, None] + right.length[j]
            common = np.minimum(left.characters[i] @ right.characters[j].T, np.minimum(left.length[i][:, None], right.length[j]))
            if by_pairs:
                some = 1.2 * common >= (least - _SLACK) * total
                some &= np.maximum(left.pairs[i] @ right.pairs[j].T, total == 2) >= np.maximum(1, _needed(total, least))
            else:
                same = np.minimum(left.tokens[i] @ right.tokens[j].T, np.minimum(left.count[i][:, None], right.count[j]))
                some = 0.4 * same / (left.count[i][:, None] + right.count[j] - same) + 1.2 * common / total >= least - _SLACK
            x, y = np.nonzero(some)
            overlap = 0.0 if by_pairs else 0.4 * same[x, y] / (left.count[i[x]] + right.count[j[y]] - same[x, y])
            near = overlap + 1.2 * left.subsequence(i[x], right, j[y]) / total[x, y] >= least - _SLACK
            found += _scored(left, i[x[near]], right, j[y[near]], least)
    columns = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)], ["a", "b", "score"])


def _scored(left: _Rows, i: np.ndarray, right: _Rows, j: np.ndarray, least: float) -> list[tuple[str, str, float]]:
    out, order = [], np.argsort(j, kind="stable")
    matcher, last = difflib.SequenceMatcher(None), None
    for p, q in zip(i[order].tolist(), j[order].tolist(), strict=True):
        same = len(left.sets[p] & right.sets[q])
        overlap = 0.4 * (same / (len(left.sets[p]) + len(right.sets[q]) - same)) if same else 0.0
        if q != last:
            matcher.set_seq2(right.names[q])
            last = q
        matcher.set_seq1(left.names[p])
        if overlap + 0.6 * matcher.quick_ratio() >= least - _SLACK and (score := overlap + 0.6 * matcher.ratio()) >= least:
            out.append((left.names[p], right.names[q], score))
    return out


def _met(left: DataFrame, right: DataFrame, least: float, by_pairs: bool = False) -> DataFrame:
    """(a, b, score) of the pairs whose prefixes meet; a pair that meets more than once comes more than once."""
    lists = [side.select("s", "tokens", F.explode("prefix").alias("e")) for side in (left, right)]
    sizes = [rows.groupBy("e").agg(F.count("*").alias(f"_n{i}"), F.ceil(F.count("*") / BLOCK).cast("int").alias(n)) for i, (rows, n) in enumerate(zip(lists, ("down", "across"), strict=True))]
    grid = sizes[0].join(sizes[1], "e")
    entries = grid.agg(F.coalesce(F.sum(F.col("_n0") * F.col("across") + F.col("_n1") * F.col("down")), F.lit(0))).first()[0]
    groups = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries // GROUP))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.join(grid.drop("_n0", "_n1"), "e").withColumn(f"_{own}", F.pmod(F.xxhash64("s"), own).cast("int"))
        rows = rows.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("down", "across")
        return rows.groupBy(F.pmod(F.xxhash64("e", "_down", "_across"), F.lit(groups)).alias("_group"))

    compare = lambda one, two: _compared(one, two, least, by_pairs)
    return dealt(lists[0], "down", "across").cogroup(dealt(lists[1], "across", "down")).applyInArrow(compare, "a string, b string, score double")


def similar(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, score) of all pairs of ``left`` (a) and ``right`` (b) that score ``least`` (0.5 to 1) or more.

    Repeated names count once; null and empty ones match nothing.
    """
    if not 0.5 <= least <= 1:
        raise ValueError("the threshold must be from 0.5 to 1")
    ship(left.sparkSession)
    one, two = _side(left.select("a").distinct(), "a"), _side(right.select("b").distinct(), "b")
    certain, size = max(0.0, (least - 0.6) / 0.4), F.size("tokens")
    found = _met(*_prefixes(one, two, "tokens", size - F.greatest(F.lit(1), F.ceil(size * certain - _SLACK)) + 1), least)
    if least <= 0.6:
        r = least / 0.6
        shortest = F.col("n") + F.ceil(F.col("n") * r / (2 - r) - _SLACK)
        found = found.union(_met(*_prefixes(one, two, "pairs", F.size("pairs") - F.greatest(F.lit(1), F.ceil(_needed(shortest, least))) + 1), least, True))
    return found.distinct()
