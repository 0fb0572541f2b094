"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, vec

#: Hash buckets of the n-gram models; labelled rows that the target model (three quarters) and the cut (the rest) are fitted on, at most.
BUCKETS, FIT_ROWS = 1 << 16, 20_000
#: A wrongly rejected good document costs as much as so many wrongly kept bad ones.
REJECT_COST = 8.0
#: A document weighs as this many of its n-grams would: its mean log ratio times STRENGTH. The mean is taken as if PRIOR n-grams more had a ratio of 0, so that a text of a few words isn't sure of anything.
STRENGTH, PRIOR = 2.5, 20

_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 4, 8
_KIND[[ord(c) for c in ".,;:?!'\"()-"]] = 16
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 32


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text's n-grams (1 and 2 words, 1 to 3 word shapes in a row) and how many n-grams each text has.

    A pair of equal words is one n-gram whatever the word. A word's shape is which kinds of characters it has, its length in four classes, and whether it repeats the word before.
    """
    h, starts, ends, woff = vec.words(raw, off)
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    shape = np.bitwise_or.reduceat(_KIND[raw], starts).astype(np.uint64)
    shape |= (np.minimum(ends - starts, 15) >> 2).astype(np.uint64) << np.uint64(6)
    first = np.zeros(n + 1, bool)
    first[woff] = True
    first = first[:-1]
    again = np.append(False, (h[1:] == h[:-1]) & ~first[1:])
    shape |= again.astype(np.uint64) << np.uint64(8)
    pair = np.where(again, np.uint64(0), np.append(h[:1], h[:-1]) * vec.MULT + h)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(woff))
    mask = np.uint64(BUCKETS - 1)
    two = np.empty(n, np.uint64)
    two[0], two[1:] = shape[0], (shape[:-1] << np.uint64(9)) | shape[1:]
    three = np.empty(n, np.uint64)
    three[:2], three[2:] = two[:2], (two[1:-1] << np.uint64(9)) | shape[2:]
    one_back = np.append(False, doc[1:] == doc[:-1])
    two_back = np.append([False] * min(n, 2), doc[2:] == doc[:-2]) if n > 1 else np.zeros(n, bool)
    grams = np.stack([vec.mix(h ^ np.uint64(1)), vec.mix(shape + np.uint64(1 << 40)), vec.mix(two + np.uint64(2 << 40)), vec.mix(three + np.uint64(3 << 40)), vec.mix(pair ^ np.uint64(4 << 40))], 1) & mask
    on = np.stack([np.ones(n, bool), np.ones(n, bool), one_back, two_back, one_back], 1)
    count = np.add.reduceat(on.sum(1), woff[:-1][np.diff(woff) > 0])
    size = np.zeros(len(off) - 1, np.int64)
    size[np.diff(woff) > 0] = count
    return grams[on].astype(np.int64), size


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the task's n-grams, in all texts and in those of the target."""
    total = np.zeros((2, BUCKETS), np.int64)
    for rows, raw, off in vec.slices(batches, 2 << 20):
        grams, size = features(raw, off)
        total[0] += np.bincount(grams, minlength=BUCKETS)
        good = np.repeat(rows.column("quality").fill_null(0).to_numpy(zero_copy_only=False) == 1, size)
        total[1] += np.bincount(grams[good], minlength=BUCKETS)
    on = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(total[0][on]), pa.array(total[1][on])], ["bucket", "raw", "target"])


def _scores(ratio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = ratio.value
        for rows, raw, off in vec.slices(batches, 2 << 20):
            grams, size = features(raw, off)
            edges = np.concatenate([[0], np.cumsum(size)])
            total = np.concatenate([[0.0], np.cumsum(of[grams])])
            summed = np.round(total[edges[1:]] - total[edges[:-1]], 6)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(summed), pa.array(np.round(STRENGTH * summed / (size + PRIOR), 9))], ["doc_id", "log_ratio", "log_weight"])

    return run


def sample_of(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, quality, fold (0 to 3) of at most `rows` labelled documents, those of the least hashes. Labels with a null are left out; of several labels of a document the least counts."""
    own = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("fold", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(4)).cast("int"))


def cut_of(good: np.ndarray, bad: np.ndarray) -> float:
    """The log weight that tells these apart at the least cost: in the middle of the gap between a row that is rejected and one that is kept. Without bad ones nothing is cut off."""
    if not len(bad):
        return -np.inf
    ratio = np.concatenate([good, bad])
    order = np.argsort(ratio, kind="stable")
    ratio, is_good = ratio[order], (np.arange(len(ratio)) < len(good))[order]
    # Cost of rejecting the first i: the good ones among them and the bad ones above; a cut lies between different ratios only.
    cost = REJECT_COST * np.concatenate([[0], np.cumsum(is_good)]) + np.concatenate([[0], np.cumsum(is_good) - np.arange(1, len(ratio) + 1)]) + len(bad)
    cost[1:-1][ratio[1:] == ratio[:-1]] = np.inf
    best = int(np.argmin(cost))
    if best == 0:
        return -np.inf
    return float((ratio[best - 1] + ratio[best]) / 2) if best < len(ratio) else float(np.nextafter(ratio[-1], np.inf))


def log_ratios(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(doc_id, log_ratio, log_weight), written, and the cut in log_weight.

    log_ratio is the sum over a text's n-grams of log(p_target / p_raw): the raw model counts the n-grams of all
    documents, the target model those of the documents labelled good in three folds of sample_of(labels), which at FIT_ROWS
    ids is small enough to be broadcast. The cut is where the fourth fold's documents are told apart best, so no text is
    cut by what was learned from it. log_weight tempers the sum: a document's n-grams aren't
    independent, and a sum over thousands of them would leave nothing to chance. A text without words has the ratio 0. Without good labels all ratios are 0 and
    nothing is cut off; nor is it without bad ones.
    """
    spark = docs.sparkSession
    whole = shared.texts(docs)
    sample = shared.written(sample_of(labels), "labels")
    fit = sample.where("fold > 0").select("doc_id", "quality")
    counted = whole.join(F.broadcast(fit), "doc_id", "left").select("text", "quality").mapInArrow(_counts, "bucket int, raw long, target long")
    model = np.zeros((2, BUCKETS))
    for r in counted.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).toLocalIterator():  # BUCKETS rows at most
        model[:, r[0]] = r[1], r[2]
    raw, target = model
    ratio = np.log((target + 0.5) / (target.sum() + 0.5 * BUCKETS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)) if target.any() else np.zeros(BUCKETS)
    scored = shared.written(whole.mapInArrow(_scores(spark.sparkContext.broadcast(ratio)), "doc_id long, log_ratio double, log_weight double"), "ratios")
    if not target.any():
        return scored, -np.inf
    other = sample.where("fold = 0").select("doc_id", "quality")
    rows = scored.join(F.broadcast(other), "doc_id").groupBy("doc_id").agg(F.min("log_weight"), F.min("quality")).collect()  # FIT_ROWS rows at most; of a repeated doc_id the least counts
    return scored, cut_of(np.array([r[1] for r in rows if r[2] == 1]), np.array([r[1] for r in rows if r[2] != 1]))


def top_k(keys: DataFrame, k: int) -> DataFrame:
    """The rows of the k largest keys (doc_id, key), ties by the larger doc_id: counts per bin give the bin of the k-th, finer and finer, and only the last bin is sorted."""
    inside, sure, left = F.lit(True), F.lit(False), k
    for width in (4096.0, 16.0, 1 / 16, 1 / 4096):
        bins = keys.where(inside).groupBy(F.floor(F.col("key") / width).alias("bin")).count().orderBy(F.desc("bin"))
        at = None
        for r in bins.toLocalIterator():
            if r["count"] > left:
                at = r["bin"]
                break
            left -= r["count"]
        if at is None:
            return keys.where(inside | sure)
        here = F.floor(F.col("key") / width)
        sure, inside = sure | (inside & (here > at)), inside & (here == at)
    edge = keys.where(inside).orderBy(F.desc("key"), F.desc("doc_id")).limit(left)
    return keys.where(sure).unionByName(edge)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, log_ratio, log_weight, sample_key, kept.

    sample_key = log_weight + a standard Gumbel number from the hash of seed and doc_id; kept are the k largest, which is a
    sample of k without replacement in proportion to the weights, the tempered ratios of target and raw model. k is the
    caller's budget; without one it is the number of documents whose weight is at the cut or above: the labels say how many,
    the sampling which. A document whose weight is a few units below another's may be drawn in its stead, one far below
    hardly. Repeated rows count each; rows without a doc_id are left out; an empty table gives an empty result.
    """
    scored, cut = log_ratios(docs, labels)
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keys = shared.written(scored.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), "keys")
    k = keys.where(F.col("log_weight") >= F.lit(float(cut))).count() if k is None else k
    top = shared.written(top_k(keys.select("doc_id", "key"), k).select("doc_id").distinct().withColumn("kept", F.lit(True)), "top")
    return keys.join(top, "doc_id", "left").select("doc_id", "log_ratio", "log_weight", F.col("key").alias("sample_key"), F.coalesce("kept", F.lit(False)).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0) -> DataFrame:
    """The documents that resample() keeps, all columns."""
    keep = resample(docs, labels, k, seed).where("kept").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))
