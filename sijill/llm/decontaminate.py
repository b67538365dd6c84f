"""Benchmark decontamination by SimHash of item-sized windows, a multi-index over Hamming blocks, and an exact check.

Texts are words of letters and digits, in lower case; shingles are SHINGLE words. A benchmark item's fingerprint is the
SimHash of its shingles. A document's fingerprints are those of its windows that are as long as an item: sizes are in
classes a sixth apart, windows of a class begin a sixth of its size apart, and running sums of the shingles' bits give
their fingerprints, so a passage of an item meets a window that differs by a twelfth at either end at most. A fingerprint is cut into BLOCKS blocks; one within RADIUS of an
item's must be within RADIUS // BLOCKS of it in some block, and lists over all values of a block name the items within
that: none within the radius is missed, and only the items that a list names are compared. But a copy near LIKE may lie outside the radius or between the windows; so any text
that has LIKE of an item's number of shingles in common with it, which every match must have, is checked over its whole
length as well, and no match is lost. Items that a window's fingerprint is within RADIUS of are then checked exactly:
around the window, the best run of as many words as the item has must have a weighted similarity of the two shingle
multisets (sum of the least counts over sum of the greatest) of LIKE or more. A run may be shorter at a text's ends, so a
whole text that is shorter than the item is compared as well.

The benchmark is read in blocks of ITEMS items, each with a pass over the documents, so what goes to the executors has
a fixed bound; one block is the usual case. A worker's lists take some 6 KB an item, 120 MB for ITEMS of them. Items of less
than a shingle's words are one shingle; they match wherever the document has just these words in a row.

Edge cases: null and blank texts and items match nothing; repeated rows match alike; a null id is reported as null;
an empty table gives an empty result; an item may match several places of a document, the most similar is reported, of
equal ones the first; columns other than ids and texts play no part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sijill.llm.common import Texts, prepare, shingle_hashes, texts, word_hashes

SHINGLE = 5
LIKE = 0.8
#: Windows of a class begin its size over GRID apart; so do the sizes of the classes.
GRID = 6
RADIUS = 15
BLOCKS = 4
#: Items of one pass, and the bytes of their texts.
ITEMS = 20_000
ITEM_BYTES = 8 << 20
#: Bytes of texts whose running sums are held at a time: so many that they stay in a core's cache.
TEXT_BYTES = 1 << 18

# Bytes that words are made of: ASCII letters and digits, and all of other alphabets; case folds as in ASCII and Latin-1.
_PART = np.zeros(256, bool)
for _from, _to in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _PART[_from:_to] = True


def tokens(batch: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of letters and digits, and for each text (and the end) the number of its first."""
    data, n = batch.data, len(batch.data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(batch.n + 1, np.int64)
    part = _PART[data]
    edge = np.zeros(n + 1, bool)
    edge[batch.offsets] = True
    edge[0] = True
    begin = np.flatnonzero(part & (np.concatenate([[True], ~part[:-1]]) | edge[:-1]))
    edge[n] = True
    end = np.flatnonzero(part & (np.concatenate([~part[1:], [True]]) | edge[1:])) + 1
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E)]
    if len(capital):
        data = data.copy()
        data[capital] += 32
    return word_hashes(data, begin, end), np.searchsorted(begin, batch.offsets)


# ------------------------------------------------------------------ fingerprints and their index


def step(size: int) -> int:
    return max(1, size // GRID)


def size_class(size: int) -> int:
    """The nearest of 1, 2, ... , each a GRID-th above the one before."""
    low = 1
    while low + step(low) <= size:
        low += step(low)
    return low if size - low <= low + step(low) - size else low + step(low)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """(n, 64) of 0 and 1."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _packed(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes, axis=1, bitorder="little").view(np.uint64).ravel()


def simhash(shingles: np.ndarray) -> int:
    return int(_packed((2 * _bits(shingles).sum(0, dtype=np.int64) > len(shingles))[None, :])[0]) if len(shingles) else 0


class Index:
    """The items' shingles and, for each size class, tables over the values of each Hamming block."""

    def __init__(self, ids: list[int], words: list[np.ndarray]):
        self.ids, self.words = ids, words
        self.length = [len(w) for w in words]
        self.shingles = [np.unique(shingle_hashes(w, SHINGLE), return_counts=True) for w in words]
        self.classes: dict[int, list[int]] = {}
        for i, n in enumerate(self.length):
            if n >= SHINGLE:
                self.classes.setdefault(size_class(n - SHINGLE + 1), []).append(i)
        self.short = [i for i, n in enumerate(self.length) if 0 < n < SHINGLE]
        self.prints = np.array([simhash(shingle_hashes(w, SHINGLE)) for w in words], np.uint64)
        long = [i for i, n in enumerate(self.length) if n >= SHINGLE]
        keys = np.concatenate([np.zeros(0, np.uint64), *[self.shingles[i][0] for i in long]])
        order = np.argsort(keys, kind="stable")
        self.owners = np.repeat(np.array(long, np.int64), [len(self.shingles[i][0]) for i in long])[order]
        self.keys, first = np.unique(keys[order], return_index=True)
        self.upto = np.append(first, len(keys))
        self.lists = None

    def built(self) -> Index:
        """With the lists, which each worker makes for itself: for a class and a block, the items near each of its 65536 values."""
        if self.lists is None:
            self.marks = np.zeros(1 << 20, bool)
            self.marks[(self.keys >> np.uint64(44)).astype(np.int64)] = True
            values = np.arange(1 << 16, dtype=np.uint16)
            masks = values[np.bitwise_count(values) <= RADIUS // BLOCKS]
            self.lists = {}
            for size, items in self.classes.items():
                own = np.array(items, np.int32)
                blocks = self.prints[own].view(np.uint16).reshape(-1, BLOCKS)
                lists = []
                for k in range(BLOCKS):
                    near = (blocks[:, k][:, None] ^ masks).ravel()
                    order = np.argsort(near, kind="stable")
                    upto = np.zeros((1 << 16) + 1, np.int32)
                    np.cumsum(np.bincount(near, minlength=1 << 16), out=upto[1:])
                    lists.append((upto, np.repeat(np.arange(len(own), dtype=np.uint16), len(masks))[order]))  # places in the class: ITEMS are fewer than 65536
                self.lists[size] = lists
            lengths = sorted({self.length[i] for i in self.short})
            self.runs = []
            for n in lengths:
                some = [i for i in self.short if self.length[i] == n]
                h = np.array([shingle_hashes(self.words[i], n)[0] for i in some], np.uint64)
                order = np.argsort(h, kind="stable")
                self.runs.append((n, h[order], np.array(some)[order]))
        return self

    def near(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of a print, item) of the class within the radius."""
        blocks = prints.view(np.uint16).reshape(-1, BLOCKS)
        found, own = [np.zeros(0, np.int64)], np.array(self.classes[size], np.int64)
        step = max(1, (1 << 22) // max(1, len(self.classes[size])))  # so many prints that their candidates fit a few MB
        for begin in range(0, len(prints), step):
            for k, (upto, items) in enumerate(self.lists[size]):
                block = blocks[begin : begin + step, k]
                first = upto[block].astype(np.int64)
                n = upto[block.astype(np.int64) + 1] - first
                which = np.repeat(np.arange(begin, begin + len(n)), n)
                item = own[items[np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(which))]]
                good = np.bitwise_count(prints[which] ^ self.prints[item]) <= RADIUS
                found.append(which[good] * len(self.ids) + item[good])
        return np.divmod(np.unique(np.concatenate(found)), len(self.ids))

    def said(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, first word) of the short items that stand in a text's words, each at its first place."""
        for n, hashes, items in self.runs:
            if len(words) >= n:
                runs = shingle_hashes(words, n)
                low = np.searchsorted(hashes, runs, "left")
                hit = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == runs)
                first = dict(zip(low[hit[::-1]].tolist(), hit[::-1].tolist(), strict=True))
                for at, where in first.items():
                    for item in items[at : np.searchsorted(hashes, hashes[at], "right")].tolist():
                        yield item, where

    def sharing(self, shingles: np.ndarray, edges: np.ndarray) -> list[tuple[int, int]]:
        """Pairs (text, item): LIKE times as many of the text's shingles as the item has are the item's."""
        hit = np.flatnonzero(self.marks[(shingles >> np.uint64(44)).astype(np.int64)])
        if not len(hit):
            return []
        at = np.minimum(np.searchsorted(self.keys, shingles[hit]), len(self.keys) - 1)
        same = self.keys[at] == shingles[hit]
        text = np.searchsorted(edges, hit[same], "right") - 1
        pair, times = np.unique(text * len(self.keys) + at[same], return_counts=True)
        text, at = np.divmod(pair, len(self.keys))
        n = self.upto[at + 1] - self.upto[at]
        items = self.owners[np.repeat(self.upto[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        pair, back = np.unique(np.repeat(text, n) * len(self.ids) + items, return_inverse=True)
        text, items = np.divmod(pair, len(self.ids))
        enough = np.bincount(back, np.repeat(times, n)) >= LIKE * (np.array(self.length)[items] - SHINGLE + 1) if len(pair) else pair
        return list(zip(text[enough].tolist(), items[enough].tolist(), strict=True)) if len(pair) else []

    # -------------------------------------------------------------- the exact check

    def similarity(self, item: int, shingles: np.ndarray) -> float:
        keys, counts = self.shingles[item]
        got, times = np.unique(shingles, return_counts=True)
        at = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
        same = keys[at] == got
        least = np.minimum(counts[at[same]], times[same]).sum()
        return float(least / (counts.sum() + times.sum() - least))

    def best(self, item: int, shingles: np.ndarray, around: int, far: int) -> tuple[float, int, int]:
        """The most similar run of the item's length that begins within ``far`` of ``around``, its first word and its number of words.

        A run may reach over the text's ends, where what is in the text counts; so a text shorter than the item is compared whole.
        """
        n, keys, total = self.length[item] - SHINGLE + 1, self.shingles[item][0], len(shingles)
        begin = np.arange(max(1 - n, around - far), min(around + far, total - 1) + 1)
        if not len(begin):
            return 0.0, around, 0
        left, right = max(0, int(begin[0])), min(total, int(begin[-1]) + n)
        span = shingles[left:right]
        known = keys[np.minimum(np.searchsorted(keys, span), len(keys) - 1)] == span
        if np.count_nonzero(known) < LIKE * n:  # no run there can be like it
            return 0.0, around, 0
        upto = np.concatenate([[0], np.cumsum(known)])
        first, last = np.maximum(begin, 0) - left, np.minimum(begin + n, total) - left
        same = upto[last] - upto[first]
        most = same / (n + last - first - same)  # no run is more similar than that
        best, at, words = 0.0, around, 0
        for i in np.flatnonzero(same >= LIKE * n).tolist():  # nor one with fewer of its shingles
            if most[i] > best and (s := self.similarity(item, span[first[i] : last[i]])) > best:
                best, at, words = s, left + int(first[i]), int(last[i] - first[i]) + SHINGLE - 1
        return best, at, words


def windows(index: Index, shingles: np.ndarray):
    """For each size class: the class, the items that a window is near and the windows' first shingles.

    ``shingles``: of several texts, one behind the other. A window may span two texts; the exact check doesn't.
    The running sums hold a bit's count in a lane of 8 bits (of 16 or 32, for longer items), so one addition counts for
    several bits; a difference of two sums is right as long as a window's counts fit their lanes, whatever carries before.
    """
    n = len(shingles)
    if not n:
        return
    lane = next(k for k in (np.uint8, np.uint16, np.uint32) if max(index.lists, default=1) <= np.iinfo(k).max)
    ones = _bits(shingles).astype(lane, copy=False).view(np.uint64)
    sums = np.zeros((n + 1, ones.shape[1]), np.uint64)
    np.cumsum(ones, axis=0, out=sums[1:])
    for size in index.lists:
        k = min(size, n)
        begin = np.append(np.arange(0, n - k, step(size)), n - k)
        votes = (sums[begin + k] - sums[begin]).view(lane)
        which, items = index.near(size, _packed(votes > lane(k // 2)))
        yield size, items, begin[which]


def _found(index: Index, column: pa.Array) -> dict[tuple[int, int], tuple[float, int, int]]:
    """By row and item: the similarity, the first word and the number of words of the best match."""
    out: dict[tuple[int, int], tuple[float, int, int]] = {}
    for part in texts(column, TEXT_BYTES):
        words, at = tokens(part)
        edges, pieces = [0], []
        for i in range(part.n):
            own = words[at[i] : at[i + 1]]
            pieces.append(shingle_hashes(own, SHINGLE) if len(own) >= SHINGLE else np.zeros(0, np.uint64))
            edges.append(edges[-1] + len(pieces[-1]))
            for item, word in index.said(own):
                out[part.first + i, item] = (1.0, word, index.length[item])
        every = np.concatenate(pieces)
        for r, item in index.sharing(every, np.array(edges)):
            like, word, n = index.best(item, pieces[r], 0, len(pieces[r]))
            if like >= LIKE:
                out[part.first + r, item] = (like, word, n)
        for size, items, begins in windows(index, every):
            first = np.searchsorted(edges, begins, "right") - 1
            last = np.searchsorted(edges, begins + size, "left") - 1  # a window may reach into other texts
            for item, begin, x, y in zip(items.tolist(), begins.tolist(), first.tolist(), last.tolist(), strict=True):
                for r in range(x, min(y, part.n - 1) + 1):
                    if len(pieces[r]) and out.get((part.first + r, item), (0.0,))[0] < 1.0:
                        like, word, n = index.best(item, pieces[r], max(0, begin - edges[r]), size // 2)
                        key = (part.first + r, item)
                        if like >= LIKE and (key not in out or (-like, word) < (-out[key][0], out[key][1])):
                            out[key] = (like, word, n)
    return out


def _searched(batches, shared):
    index = shared.value.built()
    for b in batches:
        out = _found(index, b.column("text"))
        keys = sorted(out)
        ids = b.column("doc_id").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[r] for r, _ in keys], pa.int64()),
                pa.array([index.ids[i] for _, i in keys], pa.int64()),
                pa.array([out[k][1] for k in keys], pa.int64()),
                pa.array([out[k][2] for k in keys], pa.int64()),
                pa.array([out[k][0] for k in keys], pa.float64()),
            ],
            ["doc_id", "item_id", "start_word", "n_words", "similarity"],
        )


def _clean(batches, shared, text: str):
    index = shared.value.built()
    for b in batches:
        column = b.column(text)
        mask = np.ones(len(column), bool)
        mask[[r for r, _ in _found(index, column)]] = False
        yield b.filter(pa.array(mask))


_SCHEMA = "doc_id long, item_id long, start_word long, n_words long, similarity double"


def _index(rows: list) -> Index:
    ids, words = [], []
    for r in rows:
        for part in texts(pa.array([r["text"] or ""])):
            ids.append(r["item_id"])
            words.append(tokens(part)[0])
    return Index(ids, words)


def _blocks(benchmark: DataFrame):
    """Broadcast indexes of at most ITEMS items and about ITEM_BYTES of text each."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    block, size = [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():  # a partition at a time
        block.append(r)
        size += len(r["text"])
        if len(block) >= ITEMS or size >= ITEM_BYTES:
            yield benchmark.sparkSession.sparkContext.broadcast(_index(block))
            block, size = [], 0
    if block:
        yield benchmark.sparkSession.sparkContext.broadcast(_index(block))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Where documents have a benchmark item: doc_id, item_id, start_word, n_words, similarity."""
    prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [own.mapInArrow(functools.partial(_searched, shared=x), _SCHEMA) for x in _blocks(benchmark)]
    return functools.reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], _SCHEMA)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark item, with their columns, in one pass without a join."""
    prepare(docs.sparkSession)
    out = docs
    for x in _blocks(benchmark):
        out = out.mapInArrow(functools.partial(_clean, shared=x, text="text"), docs.schema)
    return out


__all__ = ["Index", "decontaminated", "matches", "simhash", "tokens", "windows"]
