"""Quality by importance resampling: two generative models over hashed n-grams, and Gumbel top-k.

Word unigrams and bigrams are hashed to BUCKETS. The raw model counts them over all documents, the target model over
labelled good ones (quality 1; of more than MOST_TARGETS of them a sample by a hash of the id). A document's log
importance is the sum over its n-grams of the log ratio of the two models' smoothed probabilities; adding a
Gumbel variable, fixed by a hash of the document, and taking the top KEEP of all documents is sampling without
replacement in proportion to the importance. The top's threshold comes exactly from histograms of bounded size.

Edge cases: null and blank texts have importance 0 (log) and take part; without labels no document is preferred; a
null id is never a target; repeated rows draw one variable and are selected together, as are ties at the
threshold; an empty table gives an empty result; other columns are neither read nor clash.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sijill.llm.common import Texts, mix, numbers, prepare, stored, texts, word_hashes

BUCKETS = 10_000
KEEP = 0.5
SMOOTH = 1.0
MOST_TARGETS = 100_000


def features(batch: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the slice's texts, unigrams then bigrams, and the number of the text of each."""
    begin, end, at = batch.words()
    words = word_hashes(batch.data, begin, end)
    owner = np.repeat(np.arange(batch.n), np.diff(at))
    pairs = mix(words[:-1] * numbers(31, 1)[0] + words[1:])
    same = owner[1:] == owner[:-1]
    hashed = np.concatenate([words, pairs[same]])
    return (hashed % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([owner, owner[1:][same]])


def _counted(batches, shared):
    targets = shared.value
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        ids = b.column("doc_id").fill_null(0).to_numpy()
        known = np.isin(ids, targets) & ~np.asarray(b.column("doc_id").is_null())
        for part in texts(b.column("text")):
            buckets, owner = features(part)
            raw += np.bincount(buckets, minlength=BUCKETS)
            good += np.bincount(buckets[known[part.first + owner]], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(good)], ["bucket", "n_raw", "n_good"])


def _weighed(batches, ratio: np.ndarray):
    for b in batches:
        out = []
        for part in texts(b.column("text")):
            buckets, owner = features(part)
            out.append(np.bincount(owner, ratio[buckets], part.n))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("noise"), pa.array(np.concatenate(out) if out else [], pa.float64())], ["doc_id", "noise", "log_weight"])


def threshold(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the long column ``key``; four histograms of at most 65536 bins find it."""
    if k <= 0:
        return None
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        rows = keys if prefix is None else keys.where(F.shiftright("key", shift + 16) == F.lit(prefix))
        bins = rows.groupBy(F.shiftright("key", shift).alias("bin")).count().collect()
        for r in sorted(bins, key=lambda r: -r["bin"]):
            if r["count"] >= left:
                prefix = r["bin"]
                break
            left -= r["count"]
        else:
            return min((r["bin"] for r in bins), default=None) if shift == 48 else None
    return prefix


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, log_weight, gumbel_key, selected."""
    spark = docs.sparkSession
    prepare(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    n = good.count()
    if n > MOST_TARGETS:
        good = good.where(F.pmod(F.xxhash64("doc_id", F.lit("target")), F.lit(1 << 40)) < F.lit(int(MOST_TARGETS / n * (1 << 40))))
    targets = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in good.collect()], np.int64)))
    counted = own.mapInArrow(functools.partial(_counted, shared=targets), "bucket long, n_raw long, n_good long")
    rows = counted.groupBy("bucket").agg(F.sum("n_raw").alias("r"), F.sum("n_good").alias("g")).orderBy("bucket").collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["r"], r["g"]
    ratio = np.log((target + SMOOTH) / (target.sum() + SMOOTH * BUCKETS)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS))
    if not target.sum():
        ratio[:] = 0.0
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("gumbel")), 11).cast("double") + 0.5) / float(1 << 53)
    noisy = own.withColumn("noise", -F.log(-F.log(uniform)))
    weighed = noisy.mapInArrow(functools.partial(_weighed, ratio=ratio), "doc_id long, noise double, log_weight double")
    # millionths of a nat, as whole numbers: what is compared is what is shown
    keyed = stored(weighed.select("doc_id", "log_weight", F.round((F.col("log_weight") + F.col("noise")) * 1e6).cast("long").alias("key")), "quality-keys")
    k = math.ceil(keep * keyed.count())
    least = threshold(keyed, k)
    return keyed.select("doc_id", "log_weight", (F.col("key") / 1e6).alias("gumbel_key"), (F.col("key") >= F.lit(least) if least is not None else F.lit(False)).alias("selected"))
