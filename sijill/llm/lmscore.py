"""Language-model scores by a probabilistic suffix tree, beside a word-count baseline.

A text becomes tokens: its words in lower case, each with a blank behind it, then one end. The tree's symbols are the bytes
of that sequence, so its probability of the sequence is one of the text's tokens. A context is up to DEPTH bytes. Contexts of
up to NEAR bytes are always retained; a longer one is if it was seen LEAST_TIMES times, whatever the corpus's size, and its
next-symbol distribution diverges from that of its suffix: the Kullback-Leibler divergence times the context's count must be
LEAST_GAIN nats; suffixes of retained contexts are retained. A retained context's distribution is all its counts smoothed by
its suffix's distribution (weight SMOOTH), down to the plain byte frequencies. A symbol is scored in the longest retained
suffix of what came before it.

1. One pass counts words and (DEPTH + 1)-grams of the training texts, pre-aggregated in each task.
2. The tree grows with the corpus, so it is never in one place: grams are partitioned by the NEAR + 1 bytes before the symbol, which
   all contexts that may be pruned share, and each partition prunes its own branches, in partitions of about PART counted rows that
   are summed as they come. Only the contexts of up to NEAR bytes go to all.
3. One pass scores all texts. Frequent grams (LOOKUP of all symbols, so at most 1 / LOOKUP) and the baseline's frequent words
   (FREQUENT of all tokens, so at most 1 / FREQUENT) are looked up there, 16 bytes a gram and 24 a word, 130 MB at most; that is only a shortcut: the other symbols leave as (row, gram) and meet their
   branch of the tree in its partition, the other words as (row, word, times) meet their counts in a shuffle join.

Edge cases: a null text is empty, its only token is the end; a null id isn't trained on and not held out; repeated rows
count each time; without training texts every base probability is that of an empty corpus; an empty table gives an empty
result; other columns are neither read nor clash.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sijill.llm.common import _LOWER, Texts, fold, numbers, prepare, stored, texts, word_hashes

DEPTH = 5
NEAR = 2
LEAST_TIMES = 8
LEAST_GAIN = 3.0
SMOOTH = 12.0
LOOKUP = 2e-7
FREQUENT = 5e-7
#: Distinct keys that a task's pre-aggregation holds before it passes them on.
HELD = 1_000_000
#: Counted rows of a partition of the tree, and those a task takes in before it sums them; bytes of text that are scored at a time.
PART = 1_000_000
SLICE = 1 << 20

_START, _BLANK, _END = 0x09, 0x20, 0x0A
_AGAIN = numbers(14, 256)


# ------------------------------------------------------------------ symbols


def symbols(batch: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all token sequences; where each text's begin (and the end); where each token begins (and the end); and the number of each text's first token (and the end)."""
    begin, end, first = batch.words()
    sizes = np.concatenate([end - begin + 1, np.ones(batch.n, np.int64)])  # words and their blanks, then each text's end
    # order: a text's words, then its end
    order = np.insert(np.arange(len(begin)), first[1:], len(begin) + np.arange(batch.n)) if batch.n else np.zeros(0, np.int64)
    sizes = sizes[order]
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(at[-1], _BLANK, np.uint8)
    token = first + np.arange(batch.n + 1)
    ends = token[1:] - 1
    out[at[ends]] = _END
    is_word = np.ones(len(order), bool)
    is_word[ends] = False
    starts = at[:-1][is_word]
    inside = np.repeat(starts - begin, end - begin)  # shift from where a word's bytes are to where they go
    source = np.flatnonzero(_inside(batch, begin, end))
    out[source + inside] = _LOWER[batch.data[source]]
    return out, at[token], at, token


def _inside(batch: Texts, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    mark = np.zeros(len(batch.data) + 1, np.int8)
    mark[begin] += 1
    mark[end] -= 1
    return np.cumsum(mark[:-1]).astype(bool)


def grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each symbol the DEPTH before it in its text and itself, as one number."""
    n = len(data)
    wide = np.full(n + DEPTH * (len(at) - 1), _START, np.uint8)
    where = np.arange(n) + np.repeat(DEPTH * np.arange(1, len(at)), np.diff(at))
    wide[where] = data
    out = np.zeros(n, np.uint64)
    for k in range(DEPTH, -1, -1):
        out = out << np.uint64(8) | wide[where - k]
    return out


# ------------------------------------------------------------------ counting


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _tokens(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Each token's bytes with its blank. Binary, as texts may hold what isn't UTF-8 once cut; order and equality are those of bytes."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def token_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each token's bytes: that two tokens share both is left out of account."""
    return word_hashes(data, at[:-1], at[1:]), word_hashes(data, at[:-1], at[1:], _AGAIN)


def _known(words: pa.Table, below: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of the words, in order of the first, and their base scores: 24 bytes a word, whatever its length."""
    column = words["word"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    names, again = [], []
    for i in range(0, len(column), 100_000):
        some = column.slice(i, 100_000).to_pylist()
        data, at = np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in some])])
        x, y = token_hashes(data, at)
        names.append(x)
        again.append(y)
    order = np.argsort(np.concatenate(names), kind="stable")
    return np.concatenate(names)[order], np.concatenate(again)[order], np.log10((words["c"].to_numpy() + 0.5) / below)[order]


def _counted(batches):
    schema = pa.schema([("word", pa.binary()), ("gram", pa.int64()), ("times", pa.int64())])
    keys, counts, held = [], [], 0
    words, word_rows = [], 0

    def flush_grams():
        k, c = _summed(keys, counts)
        keys.clear(), counts.clear()
        return k, c

    def flush_words():
        t = pa.concat_tables(words).group_by("word").aggregate([("times", "sum")])
        words.clear()
        return pa.table({"word": t["word"], "times": t["times_sum"]})

    def out(word=None, times=None, gram=None):
        n = len(times)
        for i in range(0, n, 100_000):
            m = min(n - i, 100_000)
            w = word.slice(i, m).combine_chunks() if word is not None else pa.nulls(m, pa.binary())
            g = pa.array(gram[i : i + m].view(np.int64)) if gram is not None else pa.nulls(m, pa.int64())
            c = times.slice(i, m).combine_chunks() if word is not None else pa.array(times[i : i + m])
            yield pa.RecordBatch.from_arrays([w, g, c.cast(pa.int64())], schema=schema)

    for b in batches:
        for part in texts(b.column("text")):
            data, first, at, _ = symbols(part)
            g, c = np.unique(grams(data, first), return_counts=True)
            keys.append(g)
            counts.append(c.astype(np.int64))
            held += len(g)
            v = pc.value_counts(_tokens(data, at))
            words.append(pa.table({"word": v.field("values"), "times": v.field("counts")}))
            word_rows += len(v)
            if held > 2 * HELD:
                k, c = flush_grams()
                if len(k) > HELD:
                    yield from out(gram=k, times=c)
                    held = 0
                else:
                    keys.append(k)
                    counts.append(c)
                    held = len(k)
            if word_rows > HELD:
                t = flush_words()
                if len(t) > HELD // 2:
                    yield from out(word=t["word"], times=t["times"])
                    word_rows = 0
                else:
                    words.append(t)
                    word_rows = len(t)
    if keys:
        k, c = flush_grams()
        yield from out(gram=k, times=c)
    if words:
        t = flush_words()
        yield from out(word=t["word"], times=t["times"])


# ------------------------------------------------------------------ the tree


class Tree:
    """Retained contexts by depth, sorted, with their totals; entries by depth, sorted, with counts."""

    def __init__(self, plain: np.ndarray, contexts: list[np.ndarray], totals: list[np.ndarray], entries: list[np.ndarray], counts: list[np.ndarray]):
        self.plain = (plain + 0.5) / (plain.sum() + 0.5 * 256)
        self.contexts, self.totals, self.entries, self.counts = map(list, (contexts, totals, entries, counts))
        self._prune()

    def _prune(self) -> None:
        for d in range(NEAR, DEPTH):
            self._keep(d, self.totals[d] >= LEAST_TIMES)
        keep: list[np.ndarray] = []
        for d in range(DEPTH):
            ctx, ent = self.contexts[d], self.entries[d]
            if d < NEAR or not len(ctx):
                keep.append(np.ones(len(ctx), bool))
                continue
            gain = np.zeros(len(ctx))
            np.add.at(gain, np.searchsorted(ctx, ent >> np.uint64(8)), self.counts[d] * np.log(self.probability(ent, d + 1) / self.probability(ent, d)))
            keep.append(gain >= LEAST_GAIN)
        for d in range(DEPTH - 1, NEAR, -1):  # suffixes of retained contexts stay
            kept = self.contexts[d][keep[d]] & np.uint64((1 << (8 * d)) - 1)
            keep[d - 1] |= np.isin(self.contexts[d - 1], kept)
        for d in range(NEAR, DEPTH):
            self._keep(d, keep[d])

    def _keep(self, d: int, keep: np.ndarray) -> None:
        if len(self.contexts[d]):
            stay = keep[np.searchsorted(self.contexts[d], self.entries[d] >> np.uint64(8))]
            self.entries[d], self.counts[d] = self.entries[d][stay], self.counts[d][stay]
            self.contexts[d], self.totals[d] = self.contexts[d][keep], self.totals[d][keep]

    def probability(self, g: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """Of each gram's last symbol in the longest retained suffix, of ``depth`` bytes at most, of what is before it."""
        p = self.plain[(g & np.uint64(255)).astype(np.int64)]
        alive = np.ones(len(g), bool)
        for d in range(depth):
            ctx, ent = self.contexts[d], self.entries[d]
            if not len(ctx):
                break
            own = g & np.uint64((1 << (8 * (d + 2))) - 1)
            before = own >> np.uint64(8)
            at = np.minimum(np.searchsorted(ctx, before), len(ctx) - 1)
            alive &= ctx[at] == before
            if len(ent):
                e = np.minimum(np.searchsorted(ent, own), len(ent) - 1)
                c = np.where(ent[e] == own, self.counts[d][e], 0)
            else:
                c = np.zeros(len(own))
            p = np.where(alive, (c + SMOOTH * p) / (self.totals[d][at] + SMOOTH), p)
        return p


def _levels(g: np.ndarray, times: np.ndarray, depths) -> list[list[np.ndarray]]:
    """Contexts, totals, entries and counts for each of the depths."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for d in depths:
        e, n = _summed([g & np.uint64((1 << (8 * (d + 1))) - 1)], [times])
        k, t = _summed([e >> np.uint64(8)], [n])
        for x, y in zip(out, (k, t.astype(float), e, n.astype(float)), strict=True):
            x.append(y)
    return out


def branches(low: tuple[np.ndarray, list], g: np.ndarray, times: np.ndarray) -> Tree:
    """The tree's branches over all grams of some NEAR bytes; ``low``: the plain counts and the levels up to NEAR."""
    return Tree(low[0], *[a + b for a, b in zip(low[1], _levels(g, times, range(NEAR + 1, DEPTH + 1)), strict=True)])


class Counts:
    """Distinct grams and their counts, summed whenever PART rows or as many as are held have come, so partial counts don't pile up."""

    def __init__(self):
        self.grams, self.times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._keys, self._counts, self._waiting = [], [], 0

    def add(self, g: np.ndarray, times: np.ndarray) -> None:
        self._keys.append(g)
        self._counts.append(times)
        self._waiting += len(g)
        if self._waiting > max(PART, len(self.grams)):
            self.summed()

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        if self._waiting:
            self.grams, self.times = _summed([self.grams, *self._keys], [self.times, *self._counts])
            self._keys, self._counts, self._waiting = [], [], 0
        return self.grams, self.times


def _low(grams_: DataFrame) -> tuple[tuple[np.ndarray, list], int]:
    """Plain counts and levels up to NEAR, whose number is bounded by that of byte triples; and the number of counted rows."""
    few = grams_.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * (NEAR + 1))) - 1)).alias("entry")).agg(F.sum("times").alias("times"), F.count("*").alias("rows")).toArrow()
    e, c = few["entry"].to_numpy().astype(np.uint64), few["times"].to_numpy()
    plain = np.bincount((e & np.uint64(255)).astype(np.int64), weights=c, minlength=256)
    return (plain, _levels(e, c, range(1, NEAR + 1))), int(few["rows"].to_numpy().sum())


def _frequent(batches, shared, least: float):
    """(gram, log) of a partition's grams that are seen ``least`` times."""
    counts = Counts()
    for b in batches:
        counts.add(b.column("gram").to_numpy().view(np.uint64), b.column("times").to_numpy())
    g, c = counts.summed()
    if (c >= least).any():
        often = g[c >= least]
        logs = np.log10(branches(shared.value, g, c).probability(often))
        yield pa.RecordBatch.from_arrays([pa.array(often.view(np.int64)), pa.array(logs)], ["gram", "log"])


def _answered(batches, shared):
    """(row, log) of a partition's asked symbols. Its counted grams (times isn't null) come first."""
    counts, tree = Counts(), None
    for b in batches:
        counted = b.column("times").is_valid().to_numpy(zero_copy_only=False)
        g = b.column("gram").to_numpy().view(np.uint64)
        counts.add(g[counted], b.column("times").drop_null().to_numpy())
        if counted.all():
            continue
        if tree is None:
            tree = branches(shared.value, *counts.summed())
            counts = Counts()
        row = b.column("row").filter(pa.array(~counted))
        yield pa.RecordBatch.from_arrays([row, pa.array(np.log10(tree.probability(g[~counted])))], ["row", "log"])


class Scorer:
    """log10 of the frequent grams' probabilities, NaN for others, kept for the grams met last in a table of fixed size."""

    SLOTS = 20

    def __init__(self, frequent: np.ndarray, logs: np.ndarray):
        self.frequent, self.known = frequent, logs
        self.keys = np.full(1 << self.SLOTS, (1 << 64) - 1, np.uint64)
        self.logs = np.zeros(1 << self.SLOTS)

    def __call__(self, g: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.full(len(g), np.nan)
        slot = (g * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        out = self.logs[slot]
        missed = np.flatnonzero(self.keys[slot] != g)
        if len(missed):
            new, back = np.unique(g[missed], return_inverse=True)
            at = np.minimum(np.searchsorted(self.frequent, new), len(self.frequent) - 1)
            logs = np.where(self.frequent[at] == new, self.known[at], np.nan)
            out[missed] = logs[back]
            where = (new * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.SLOTS)).astype(np.int64)
            self.keys[where], self.logs[where] = new, logs
            # of two new grams in one slot the last write won in both arrays
        return out


# ------------------------------------------------------------------ scoring


def _scored(batches, shared):
    frequent, gram_logs, hashes, checks, logs = shared.value
    scorer = Scorer(frequent, gram_logs)
    row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_frequent", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("word", pa.binary()), ("times", pa.int64()), ("gram", pa.int64())])
    for b in batches:
        for part in texts(b.column("text"), SLICE):
            data, first, at, token = symbols(part)
            g = grams(data, first)
            logp = np.concatenate([scorer(some) for some in np.array_split(g, max(1, len(data) >> 19))])
            asked = np.flatnonzero(np.isnan(logp))
            logp[asked] = 0.0
            score = np.add.reduceat(logp, first[:-1])
            tokens = _tokens(data, at)
            found, base = np.zeros(len(tokens), bool), np.zeros(len(tokens))
            if len(hashes):
                names, again = token_hashes(data, at)
                index = np.minimum(np.searchsorted(hashes, names), len(hashes) - 1)
                found = (hashes[index] == names) & (checks[index] == again)
                base[found] = logs[index[found]]
            base = np.add.reduceat(base, token[:-1])
            count = np.add.reduceat(found.astype(np.int64), token[:-1])
            n = part.n
            rows = row + np.arange(n)
            row += n
            own = b.slice(part.first, n)
            yield pa.RecordBatch.from_arrays([pa.array(rows), own.column("doc_id"), own.column("held_out"), pa.array(np.diff(token)), pa.array(count), pa.array(base), pa.array(score), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema)
            for x in np.array_split(asked, len(asked) // 100_000 + 1) if len(asked) else ():
                m = len(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows[np.searchsorted(first, x, "right") - 1]), *[pa.nulls(m, f.type) for f in list(schema)[1:9]], pa.array(g[x].view(np.int64))], schema=schema)
            rare = np.flatnonzero(~found)
            if len(rare):
                t = pa.table({"row": rows[np.searchsorted(token, rare, "right") - 1], "word": tokens.take(pa.array(rare))}).group_by(["row", "word"]).aggregate([([], "count_all")]).combine_chunks()
                for r in t.to_batches(max_chunksize=100_000):
                    m = r.num_rows
                    yield pa.RecordBatch.from_arrays([r.column("row"), *[pa.nulls(m, f.type) for f in list(schema)[1:7]], r.column("word"), r.column("count_all").cast(pa.int64()), pa.nulls(m, pa.int64())], schema=schema)


def score(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    prepare(spark)
    part = fold("doc_id")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part == 1, F.lit(False)).alias("held_out"), (part != 1).alias("train"), F.col("text").cast("string").alias("text"))
    counted = stored(own.where("train").select("text").mapInArrow(_counted, "word binary, gram long, times long"), "lm-counted")
    grams_ = counted.where("gram is not null").select("gram", "times")
    vocabulary = stored(counted.where("word is not null").groupBy("word").agg(F.sum("times").alias("c")), "lm-words")
    low, rows = _low(grams_)
    branch = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * (NEAR + 1))) - 1))
    parts = max(2 * spark.sparkContext.defaultParallelism, rows // PART + 1)  # a number of its own: joined ones would hold more
    shared_low = spark.sparkContext.broadcast(low)
    often = grams_.repartition(parts, branch).mapInArrow(functools.partial(_frequent, shared=shared_low, least=max(1.0, LOOKUP * low[0].sum())), "gram long, log double").orderBy("gram").toArrow()
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    below = n + 0.5 * (v + 1)
    common = vocabulary.where(F.col("c") >= F.lit(max(1.0, FREQUENT * n))).orderBy("word").toArrow() if v else None
    hashes, checks, logs = _known(common, below) if common else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0))
    shared = spark.sparkContext.broadcast((often["gram"].to_numpy().view(np.uint64), often["log"].to_numpy(), hashes, checks, logs))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_frequent long, base double, score double, word binary, times long, gram long"
    scored = stored(own.select("doc_id", "held_out", "text").mapInArrow(functools.partial(_scored, shared=shared), schema), "lm-scored")
    # the frequent words aren't among the rare tokens, so the join needs only the others
    others = vocabulary.where(F.col("c") < F.lit(max(1.0, FREQUENT * n)))
    rare = scored.where("word is not null").select("row", "word", "times").join(others, "word", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(float(below)))
    asked = scored.where("gram is not null").select("row", "gram", F.lit(None).cast("long").alias("times"))
    told = grams_.select(F.lit(None).cast("long").alias("row"), "gram", "times")
    answers = told.unionByName(asked).repartition(parts, branch).sortWithinPartitions(F.col("times").isNull()).mapInArrow(functools.partial(_answered, shared=shared_low), "row long, log double")
    more = rare.select("row", (F.col("times") * log).alias("base"), F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("known"), F.lit(0.0).alias("log"))
    more = more.unionByName(answers.select("row", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"), "log"))
    summed = more.groupBy("row").agg(F.sum("base").alias("more"), F.sum("known").alias("known"), F.sum("log").alias("asked"))
    out = scored.where("word is null and gram is null").select("row", "doc_id", "held_out", "n_tokens", "n_frequent", "base", "score").join(summed, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("asked", F.lit(0.0))).alias("score"),
    )
