"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

A text's features are the character n-grams (on UTF-8 bytes, 2 to 4 of them) of its words with a border before and after
each word, hashed to ``BUCKETS`` rows of an embedding matrix; the text is the average of its rows, a linear layer and a
softmax give the languages, any number of them. The matrices are trained in numpy by stochastic gradient descent on a bounded
sample of labelled rows: ``SAMPLE`` rows a language are expected, ``SAMPLE_ALL`` over all languages (one each, if they are
more), of which the driver gets the hashed counts of the ``PAIRS`` most frequent n-grams (4 bytes each), not texts. A fifth of
the sample is kept from training and calibrates: it sets the temperature of the softmax, and the rejection threshold, which
is where the loss on it is least, a wrong language that is kept counting as much as ``COST`` right ones that are rejected (1: what
is more likely wrong than right goes).

As average and linear layer are linear, the trained matrices fold into one of BUCKETS x languages as long as there are at most
DIM languages; beyond, the two matrices are applied one after the other, so the model stays at some 2 MB and 130 bytes a
language. The executors score whole texts a slice of bytes at a time.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; a null id is never trained on and
not held out; repeated rows are predicted alike; of equal scores the language first in order counts; an empty table, or one
without labels, predicts ``und``; columns other than doc_id, text and lang play no part, and only they are read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sijill.llm.common import Texts, fold, mix, prepare, texts

BUCKETS = 1 << 14
DIM = 16
SAMPLE = 1000
SAMPLE_ALL = 30_000
PAIRS = 1024
EPOCHS = 6
RATE = 0.5
COST = 1.0
#: Scores under this count as no decision even if calibration would allow them.
LEAST = 0.3

# Case folding on bytes: A-Z, and the second byte of the Latin-1 capitals after 0xC3. Letters and bytes above ASCII stay,
# all else is a border between words.
_FOLD = np.zeros(256, np.uint64)
_FOLD[97:123] = np.arange(1, 27)
_FOLD[65:91] = np.arange(1, 27)
_FOLD[128:256] = np.arange(32, 160)


def features(batch: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts of the slice, one behind the other, and where each text's begin."""
    data = batch.data
    n = len(data)
    at = batch.offsets
    code = np.zeros(n + 2 * batch.n + 4, np.uint64)
    shift = np.arange(batch.n, dtype=np.int64) * 2 + 1  # two borders between texts
    place = np.arange(n) + np.repeat(shift, np.diff(at))
    letters = _FOLD[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E)]
    letters[capital] += 32
    code[place] = letters
    two = code[:-3] << np.uint64(8) | code[1:-2]
    three = two << np.uint64(8) | code[2:-1]
    four = three << np.uint64(8) | code[3:]
    inner = code[1:-2] > 0
    keep = (
        (code[:-3] > 0) & inner,  # two letters
        (code[1:-2] > 0) & ((code[:-3] > 0) | (code[2:-1] > 0)),  # three places around a letter
        (code[1:-2] > 0) & (code[2:-1] > 0),  # four places around two letters
    )
    grams = np.stack([two + np.uint64(1 << 40), three + np.uint64(2 << 40), four + np.uint64(3 << 40)], 1)
    kept = np.stack(keep, 1)
    hashed = (mix(grams[kept]) >> np.uint64(50)).astype(np.int32)
    upto = np.concatenate([[0], np.cumsum(kept.sum(1))])
    begin = np.minimum(at[:-1] + shift - 1, len(kept))
    return hashed, np.append(upto[begin], len(hashed)) if batch.n else np.zeros(1, np.int64)


# ------------------------------------------------------------------ training


class Model:
    """Languages, the embeddings (BUCKETS x width), a layer of width x languages (None: folded into them), the bias, and the rejection threshold."""

    def __init__(self, langs: list[str], embed: np.ndarray, layer: np.ndarray, bias: np.ndarray, threshold: float):
        fold_ = len(langs) <= embed.shape[1]
        self.embed = (embed @ layer if fold_ else embed).astype(np.float32)
        self.layer = None if fold_ else layer
        self.langs, self.bias, self.threshold = langs, bias, threshold


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, langs: list[str], seed: int = 7) -> Model:
    """``rows``: buckets and counts of each text, in their stored width. A fifth of the rows calibrates, the rest trains."""
    rng = np.random.default_rng(seed)
    k = len(langs)
    embed = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, k)), np.zeros(k)
    out[: min(DIM, k), : min(DIM, k)] += np.eye(DIM, k)[: min(DIM, k), : min(DIM, k)] * 0.1
    order = rng.permutation(len(rows))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]

    def weight(i: int) -> np.ndarray:  # made anew each time: kept, they would take four times the sample
        c = rows[i][1].astype(float)
        return c / max(c.sum(), 1)

    steps, step = EPOCHS * max(1, -(-len(used) // 16)), 0
    for _ in range(EPOCHS):
        used = rng.permutation(used)
        for j in range(0, len(used), 16):
            some = used[j : j + 16]
            weights = [weight(i) for i in some]
            hidden = np.stack([w @ embed[rows[i][0]] for i, w in zip(some, weights, strict=True)])
            error = _softmax(hidden @ out + bias)
            error[np.arange(len(some)), labels[some]] -= 1
            rate = RATE * (1 - step / steps)
            back = error @ out.T
            out -= rate * hidden.T @ error
            bias -= rate * 0.1 * error.mean(0)
            for i, w, b in zip(some, weights, back, strict=True):
                embed[rows[i][0]] -= (rate * 20) * w[:, None] * b
            step += 1
    temperature, threshold = 1.0, LEAST
    if len(held):
        logits = np.stack([weight(i) @ embed[rows[i][0]] for i in held]) @ out + bias
        truth = labels[held]

        def loss(t: float) -> float:
            p = np.log(np.maximum(_softmax(logits * t), 1e-12))
            return -(0.99 * p[np.arange(len(held)), truth] + 0.01 * p.mean(1)).mean()  # never sure beyond all doubt

        temperature = min((2.0**e for e in np.arange(-4, 4.25, 0.25)), key=loss)
        p = _softmax(logits * temperature)
        threshold = rejection(p.max(1), p.argmax(1) == truth)
    return Model(langs, embed, out * temperature, bias * temperature, threshold)


def rejection(score: np.ndarray, right: np.ndarray) -> float:
    """The threshold of the least loss: COST for each wrong one kept, 1 for each right one rejected; of equal ones the lowest, LEAST or more."""
    order = np.argsort(score, kind="stable")
    s, r = score[order], right[order]
    rejected, wrong = np.concatenate([[0], np.cumsum(r)]), np.concatenate([[0], np.cumsum(~r)])
    lost = rejected + COST * (wrong[-1] - wrong)  # with the first k rejected
    cuts = np.concatenate([[0.0], (s[1:] + s[:-1]) / 2, [1.0]]) if len(s) else np.zeros(1)
    return max(LEAST, float(cuts[int(lost.argmin())]))


def _counts(batches):
    for b in batches:
        for part in texts(b.column("text")):
            hashed, at = features(part)
            ids, langs, keys, counts = [], [], [], []
            for i in range(part.n):
                u, c = np.unique(hashed[at[i] : at[i + 1]], return_counts=True)
                if len(u) > PAIRS:
                    most = np.sort(np.argsort(-c, kind="stable")[:PAIRS])
                    u, c = u[most], c[most]
                ids.append(b.column("doc_id")[part.first + i].as_py())
                langs.append(b.column("lang")[part.first + i].as_py())
                keys.append(u.astype(np.uint16).tobytes())
                counts.append(np.minimum(c, 65535).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "lang", "keys", "counts"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from the labelled rows whose fold isn't 0; None if there are none.

    The sample takes each row of a language with one probability by a hash of its id, so it is spread over the whole
    table and the same in each run.
    """
    prepare(docs.sparkSession)
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id") != 0))
    counts = labelled.select("lang").groupBy("lang").count().collect()  # a row a language
    if not counts:
        return None
    langs = sorted(r["lang"] for r in counts)
    each = max(1, min(sample, SAMPLE_ALL // len(langs)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, each / r["count"]) * (1 << 62))) for r in counts], "_lang string, _share long")
    picked = labelled.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 62)) < F.col("_share")).select("doc_id", "text", "lang")
    rows = picked.mapInArrow(_counts, "doc_id long, lang string, keys binary, counts binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["keys"]))
    rows = [r for r in rows if r["keys"]]
    if not rows:
        return None
    found = [(np.frombuffer(r["keys"], np.uint16), np.frombuffer(r["counts"], np.uint16)) for r in rows]
    number = {lang: i for i, lang in enumerate(langs)}
    return train(found, np.array([number[r["lang"]] for r in rows]), langs)


# ------------------------------------------------------------------ prediction


def scores(model: Model, batch: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The best language's number and its calibrated probability for each text of the slice."""
    hashed, at = features(batch)
    total = np.zeros((batch.n, model.embed.shape[1]))
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for k in range(total.shape[1]):
            total[full, k] = np.add.reduceat(model.embed[:, k][hashed].astype(np.float64), at[full])
        total[full] /= np.diff(at)[full, None]
    p = _softmax((total if model.layer is None else total @ model.layer) + model.bias)
    return p.argmax(1), p.max(1)


def _predict(batches, shared):
    model = shared.value
    for b in batches:
        best, score = [], []
        for part in texts(b.column("_text")):
            x, y = scores(model, part)
            best.append(x)
            score.append(y)
        rest = [c for c in b.schema.names if c != "_text"]
        columns = [b.column(c) for c in rest]
        lang = np.array(model.langs, object)[np.concatenate(best)] if best else np.zeros(0, object)
        yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())], [*rest, "_lang", "_score"])


def _letter(c: str):
    return F.coalesce(F.col(c).rlike(r"\p{L}"), F.lit(False))


def predict(model: Model | None, docs: DataFrame, keep: list[str], prefix: str = "") -> DataFrame:
    """Columns ``keep`` of ``docs`` and lang_pred, score, rejected, each with ``prefix``."""
    prepare(docs.sparkSession)
    names = {c: f"_k{i}" for i, c in enumerate(keep)}
    rows = docs.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("text").cast("string").alias("_text"), _letter("text").alias("_letter"))
    back = [F.col(n).alias(c) for c, n in names.items()]
    if model is None:
        return rows.select(*back, F.lit("und").alias(f"{prefix}lang_pred"), F.lit(0.0).alias(f"{prefix}score"), F.lit(True).alias(f"{prefix}rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text") + ", _lang string, _score double"
    out = rows.mapInArrow(functools.partial(_predict, shared=shared), schema)
    return out.select(
        *back,
        F.when(F.col("_letter"), F.col("_lang")).otherwise("und").alias(f"{prefix}lang_pred"),
        F.when(F.col("_letter"), F.col("_score")).otherwise(0.0).alias(f"{prefix}score"),
        (~F.col("_letter") | (F.col("_score") < model.threshold)).alias(f"{prefix}rejected"),
    )


def identify(docs: DataFrame) -> DataFrame:
    """Learn from ``docs`` and predict each of its rows: doc_id, held_out, lang_pred, score, rejected."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "text")
    return predict(fit(docs), rows, ["doc_id", "held_out"])


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model, learned from them, doesn't reject, with their columns."""
    found = predict(fit(docs), docs, docs.columns, "_langid_")
    return found.where("not _langid_rejected").drop("_langid_lang_pred", "_langid_score", "_langid_rejected")


__all__ = ["Model", "accepted", "fit", "identify", "predict", "train"]
