"""Toxicity by a weighted lexicon, found by Aho-Corasick in folded text, less what exception phrases cover, over the length.

Folding lowers case, takes compatibility forms together, drops invisible characters, and within words that have a Latin letter
takes look-alikes of other scripts and digits or signs that stand for letters as these letters (a 1 as i and as l). Entries are
words and beginnings of words. They and their weights (log ratio of their frequencies) are learned from labelled rows: an entry
must be in more toxic rows than clean ones, and more frequent there than chance explains, by a likelihood ratio of ``LEAST_RATIO`` (more
where many candidates compete), not only in rows but in neighbourhoods too (as many of equal weight as its words before and after make), or copies of one text would make entries; of
entries of which one begins another only the more telling stays. Pairs of words around an entry that clean rows have and toxic ones (nearly) never are
exception phrases. The score is logistic in the sum of weights over a power of the number of words, fitted to the same rows.

Bound: of more than ``MOST`` labelled rows of a class a sample by a hash of the id is learned from.

Edge cases: null and blank texts have no words and get the score of a sum of 0; labels that are null, or of both kinds for an id,
aren't learned from, nor are rows without an id (they are scored, and not held out); without labelled rows of both classes all
scores are 0; a text is worked on in pieces cut at white space, so long ones are scored whole; repeated rows are scored alike and
each learned from; an empty table gives no rows; other columns neither count nor clash.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sijill.llm.common import fold, prepare, release, stored

#: Labelled rows a class that are learned from, at most.
MOST = 100_000
#: An entry's least toxic rows and likelihood ratio; lengths of beginnings of words.
LEAST_ROWS, LEAST_RATIO, BEGINNINGS = 4, 16.0, range(3, 11)
#: An exception phrase's least clean rows, and the greatest share of toxic ones among its rows.
LEAST_CLEAN, MOST_TOXIC = 3, 0.05
#: One in so many clean rows is counted first, which most entries fail by.
SCREEN = 16
#: Powers of the number of words among which the fit chooses, and its penalty.
POWERS, PENALTY = (0.1, 0.2, 0.35, 0.5, 0.75, 1.0), 1.0
#: Characters of a text that are worked on at a time.
PIECE = 1 << 18

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

_LOOK = str.maketrans(LOOKALIKES)
_SIGNS = str.maketrans(SIGNS)
_SIGNS_L = str.maketrans(SIGNS | {"1": "l"})
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_WORD = re.compile(r"[\w@$]+")
_FOREIGN = re.compile("(?<= )(?=[^ ]*[a-z])[^ ]*[" + "".join(LOOKALIKES) + "][^ ]*(?= )")
_MIXED = re.compile(r"(?<= )(?=[^ ]*[^\W\d_])[^ ]*[0134578@$][^ ]*(?= )")


# ------------------------------------------------------------------ folding


def _spelt(match: re.Match) -> str:
    word = match[0]
    return f"{word.translate(_SIGNS)} {word.translate(_SIGNS_L)}" if "1" in word else word.translate(_SIGNS)


def folded(text: str) -> tuple[str, int]:
    """The words, each between spaces, and how many; a word with a 1 among letters stands twice."""
    text = text.lower()
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text).lower())
    words = _WORD.findall(text)
    line = f" {' '.join(words)} " if words else ""
    if not text.isascii():
        line = _FOREIGN.sub(lambda m: m[0].translate(_LOOK), line)
    return _MIXED.sub(_spelt, line), len(words)


def pieces(text: str) -> Iterator[str]:
    """``text`` cut at white space, each part about PIECE characters or one word."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            space = re.compile(r"\s").search(text, end)
            end = space.start() if space else len(text)
        yield text[at:end]
        at = end


def lines(text: str) -> Iterator[tuple[str, int, int, int]]:
    """Folded pieces with a word of each neighbour around: the line, where its own words begin and end, and their number."""
    before, held = "", None
    for piece in pieces(text):
        line, n = folded(piece)
        if not n:
            continue
        if held:
            yield _framed(before, *held, line[: line.index(" ", 1)])
            before = held[0][held[0].rindex(" ", 0, -1) : -1]
        held = (line, n)
    if held:
        yield _framed(before, *held, "")


def _framed(before: str, line: str, n: int, after: str) -> tuple[str, int, int, int]:
    return before + line + (after[1:] + " " if after else ""), len(before), len(before) + len(line) - 1, n


# ------------------------------------------------------------------ the model


class Model:
    """Weights of entries (`` word `` or `` beginning``), exception phrases (`` one two ``), and the fitted line."""

    def __init__(self, weights: dict[str, float], phrases: set[str], power: float = 0.5, slope: float = 0.0, base: float = -math.inf):
        self.weights, self.phrases, self.power, self.slope, self.base = weights, phrases, power, slope, base

    @functools.cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Built once a worker."""
        auto = ahocorasick.Automaton()
        for entry in (*self.weights, *self.phrases):
            auto.add_word(entry, entry)
        auto.make_automaton()
        return auto

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def hits(self, text: str) -> tuple[list[tuple[str, str, int]], int]:
        """Entries found in ``text``, each with its line and place there, and the number of words."""
        found, total = [], 0
        for line, begin, end, n in lines(text):
            total += n
            found += [(e, line, at) for e, at in self.within(line) if begin <= at < end]
        return found, total

    def within(self, line: str) -> list[tuple[str, int]]:
        """Entries in a folded line that no exception phrase covers, and where."""
        found, free = [], set()
        for end, entry in self.automaton.iter(line) if self.weights else ():
            at = end + 1 - len(entry)
            if entry in self.phrases:
                free |= {at, at + entry.index(" ", 1)}  # where its two words begin
            else:
                found.append((entry, at))
        return [x for x in found if x[1] not in free]

    def sums(self, text: str) -> tuple[float, int]:
        found, n = self.hits(text)
        return math.fsum(self.weights[e] for e, _, _ in found), n

    def score(self, text: str) -> float:
        if self.base == -math.inf:
            return 0.0
        weight, n = self.sums(text)
        return float(logistic(self.slope * weight / (1 + n) ** self.power + self.base))


def logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fitted(weight: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """(power, slope, base) of the least penalized loss, by Newton's method."""
    best = None
    for power in POWERS:
        x = weight / (1 + words) ** power
        scale = float(x.max()) or 1.0
        x, w = np.stack([x / scale, np.ones(len(x))], 1), np.zeros(2)
        penalty = np.array([PENALTY / 100, 0.0])
        for _ in range(50):
            p = logistic(x @ w)
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (p - toxic) + penalty * w)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        p = np.clip(logistic(x @ w), 1e-12, 1 - 1e-12)
        loss = -(toxic * np.log(p) + (1 - toxic) * np.log(1 - p)).sum() + (penalty * w * w).sum() / 2
        if best is None or loss < best[0]:
            best = (loss, power, float(w[0] / scale), float(w[1]))
    return best[1:]


# ------------------------------------------------------------------ learning


def _folding(batches):
    for b in batches:
        out = ["".join(folded(p)[0] for p in pieces(t or "")).replace("  ", " ") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("text"), pa.array(out, pa.string())], ["toxic", "text", "line"])


def candidates(word: str) -> list[str]:
    return [f" {word[:k]}" for k in BEGINNINGS if k < len(word)] + [f" {word} "]


def _counted(batches, known=None):
    """Rows of (entry, n): in how many rows each entry stands; of ``known`` ones only, if given."""
    counts: Counter = Counter()
    only = None if known is None else known.value
    for b in batches:
        cache: dict[str, list[str]] = {}
        for line in b.column("line").to_pylist():
            words = set(line.split())
            for w in words - cache.keys():
                cache[w] = candidates(w) if only is None else [c for c in candidates(w) if c in only]
            counts.update(set().union(*map(cache.__getitem__, words)))
        if len(counts) > 500_000:
            yield _counts(counts)
            counts.clear()
    yield _counts(counts)


def _met(batches, shared):
    """As ``_counted``, for few entries: found by the automaton."""
    auto = shared.value.automaton
    counts: Counter = Counter()
    for b in batches:
        for line in b.column("line").to_pylist() if shared.value.weights else ():
            counts.update({e for _, e in auto.iter(line)})
    yield _counts(counts)


def _counts(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["entry", "n"])


def _placed(batches, shared):
    """Rows of (entry, toxic, near, n): in how many rows an entry stands between the words that ``near`` is a hash of."""
    model = shared.value
    for b in batches:
        counts: Counter = Counter()
        for toxic, line in zip(b.column("toxic").to_pylist(), b.column("line").to_pylist(), strict=True):
            counts.update({(e, toxic, _near(line, at)) for e, at in model.within(line)})
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([e for e, _, _ in keys], pa.string()), pa.array([t for _, t, _ in keys], pa.int32()), pa.array([h for _, _, h in keys], pa.int64()), pa.array(list(counts.values()), pa.int64())], ["entry", "toxic", "near", "n"])


def _near(line: str, at: int) -> int:
    """A hash of the words before and after the one at ``at``."""
    end = line.index(" ", at + 1)
    before, after = line[line.rfind(" ", 0, at) + 1 : at], line[end + 1 : line.find(" ", end + 1) if end + 1 < len(line) else end + 1]
    return int.from_bytes(hashlib.blake2b(f"{before} {after}".encode(), digest_size=8).digest(), "little", signed=True)


def _phrased(batches, shared):
    """Rows of (phrase, toxic): the pairs of words around each entry found, each once a text."""
    model = shared.value
    for b in batches:
        out: list[tuple[str, int]] = []
        for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
            out += [(p, toxic) for p in {p for _, line, at in model.hits(text or "")[0] for p in around(line, at)}]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([t for _, t in out], pa.int32())], ["phrase", "toxic"])


def around(line: str, at: int) -> list[str]:
    """The word at ``at`` with the one before and with the one after it."""
    end = line.index(" ", at + 1)
    out = [line[line.rindex(" ", 0, at) : end + 1]] if at else []
    return out + ([line[at : line.index(" ", end + 1) + 1]] if end + 1 < len(line) else [])


def _summed(batches, shared):
    model = shared.value
    for b in batches:
        rows = [model.sums(t or "") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([w for w, _ in rows], pa.float64()), pa.array([n for _, n in rows], pa.int64())], ["toxic", "weight", "words"])


def telling(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, n_tried: int) -> list[tuple[float, str, float]]:
    """(likelihood ratio, entry, weight) of the entries that are more frequent among toxic rows than chance among ``n_tried`` explains."""
    share, found = n_toxic / (n_toxic + n_clean), []
    least = max(LEAST_RATIO, 2 * math.log(n_tried or 1))
    for entry, a in toxic.items():
        b = clean.get(entry, 0)
        if a <= max(share, 0.5) * (a + b):
            continue
        ratio = 2 * (a * math.log(a / (share * (a + b))) + (b * math.log(b / ((1 - share) * (a + b))) if b else 0.0))
        weight = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
        if ratio >= least and weight > 0:
            found.append((ratio, entry, weight))
    return found


def lexicon(found: list[tuple[float, str, float]]) -> dict[str, float]:
    """Weights of the entries, the most telling first (of equals the longer one), without those that begin or continue one of them."""
    kept: dict[str, float] = {}
    begun: set[str] = set()
    for _, entry, weight in sorted(found, key=lambda x: (-x[0], -len(x[1]), x[1])):
        bare = entry.rstrip()
        if entry == bare and bare in begun or any(bare[:k] in kept for k in range(2, len(bare) + 1)):
            continue
        kept[entry] = weight
        begun.update(bare[:k] for k in range(2, len(bare) + 1))
    return kept


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model that the labelled rows of ``docs`` (doc_id, text; ``labels``: doc_id, toxic) teach."""
    spark = docs.sparkSession
    prepare(spark)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most").drop("_most")
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model({}, set())
    for k, n in sizes.items():
        if n > MOST:
            marked = marked.where((F.col("toxic") != k) | (F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 40)) < F.lit(int(MOST / n * (1 << 40)))))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marked), "doc_id")
    rows = stored(own.select("toxic", "text").mapInArrow(_folding, "toxic int, text string, line string"), "toxicity-labelled")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        release(rows)
        return Model({}, set())

    count = lambda found, least: {r["entry"]: r["n"] for r in found.groupBy("entry").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()}
    share = lambda x: spark.sparkContext.broadcast(x)
    # a task passes on each entry that it meets, so there are no more tasks than cores, however many files the rows lie in
    few = rows.coalesce(spark.sparkContext.defaultParallelism)
    clean = few.where("toxic = 0").select("line")
    toxic = count(few.where("toxic = 1").select("line").mapInArrow(_counted, "entry string, n long"), LEAST_ROWS)
    # an entry that fails by its toxic rows alone, or by a part of the clean ones, fails by all of them too
    some = {e: toxic[e] for _, e, _ in telling(toxic, {}, sizes[1], sizes[0], len(toxic))}
    part = clean.where(F.pmod(F.xxhash64("line"), F.lit(SCREEN)) == 0).mapInArrow(functools.partial(_counted, known=share(frozenset(some))), "entry string, n long")
    some = {e: toxic[e] for _, e, _ in telling(some, count(part, 1), sizes[1], sizes[0], len(toxic))}
    whole = clean.mapInArrow(functools.partial(_met, shared=share(Model(some, set()))), "entry string, n long")
    some = telling(some, count(whole, 1), sizes[1], sizes[0], len(toxic))
    sets = rows.select("toxic", "line").mapInArrow(functools.partial(_placed, shared=share(Model({e: w for _, e, w in some}, set()))), "entry string, toxic int, near long, n long")
    sets = sets.groupBy("entry", "toxic", "near").agg(F.sum("n").cast("double").alias("n")).groupBy("entry", "toxic").agg((F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("n"))
    sets = {(r["entry"], r["toxic"]): r["n"] for r in sets.collect()}
    weights = lexicon(telling(*({e: sets[e, k] for _, e, _ in some if (e, k) in sets} for k in (1, 0)), sizes[1], sizes[0], len(toxic)))
    first = share(Model(weights, set()))
    pairs = rows.select("toxic", "text").mapInArrow(functools.partial(_phrased, shared=first), "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    phrases = {r["phrase"] for r in pairs.where((F.col("n") - F.col("a") >= LEAST_CLEAN) & (F.col("a") <= MOST_TOXIC * F.col("n"))).collect()}
    model = Model(weights, phrases - weights.keys())
    sums = rows.select("toxic", "text").mapInArrow(functools.partial(_summed, shared=share(model)), "toxic int, weight double, words long").toPandas()
    release(rows)
    model.power, model.slope, model.base = fitted(sums["weight"].to_numpy(), sums["words"].to_numpy(float), sums["toxic"].to_numpy(float))
    return model


# ------------------------------------------------------------------ scoring


def _scored(batches, shared):
    model = shared.value
    for b in batches:
        found = [model.score(t.as_py() or "") for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], ["doc_id", "held_out", "score", "predicted"])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each of ``docs`` (doc_id, text): doc_id, held_out, score, predicted; labels of held-out ids aren't learned from."""
    shown = labels.where(fold("doc_id") != 0)
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, shown))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(functools.partial(_scored, shared=model), "doc_id long, held_out boolean, score double, predicted int")
