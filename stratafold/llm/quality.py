"""Quality by importance resampling (Xie et al., "Data selection for language models via importance resampling").

Two generative models of hashed n-grams, one of target text (documents labelled
of good quality) and one of raw text (all documents), give each document an
importance weight, the ratio of its likelihoods; documents are then drawn
without replacement by Gumbel top-k: those with the k largest log-weight plus
Gumbel noise stay.

An n-gram here is a word's letters, its marks, its shape, and pairs of
neighbouring words, marks and shapes. Counts are over whole texts and all
documents, in BUCKETS hash buckets (a size fixed by the method, not by the
corpus). The log-weight is the sum over n-grams; `sharpness` multiplies it
before the noise is added.

k: a logistic regression on CALIBRATION_ROWS labelled documents at most (chosen
by hash; rows of one doc_id count as one, by their average) maps the mean log
ratio of a document's n-grams to the chance that it is good; k is the number of documents for which that chance is at least
`least_chance`. Where no document is labelled bad, or none good, all stay.

The k-th largest key is found exactly, by counting keys in 4096 bins and
refining the bin that holds it; no rows are collected and none sorted globally.

Defined cases: null and empty texts have no n-grams and log-weight 0; ties in
the key are ordered by doc_id and row; repeated rows are rows of their own with
equal weight; an empty table gives no rows; other columns are kept by
`resampled_documents` only. Labels of one document that disagree count as bad.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.arrowtext import Words, WordTable, bound_batches, give_back, mixed, segment_sums, slices, text_column, words_of
from stratafold.llm.shared import checked_broadcast, saved

BUCKETS = 1 << 14
CALIBRATION_ROWS = 20_000
LEAST_CHANCE = 0.2
SHARPNESS = 1.0
SEED = 3
_CLASSES = {"upper": 1, "lower": 2, "digit": 3, "mark": 4}


def _describe(word: str) -> tuple[str, str, int]:
    """(letters in lower case, marks, shape) of a word."""
    letters = "".join(c for c in word if c.isalnum())
    marks = "" if len(letters) == len(word) else "".join(c for c in word if not c.isalnum())
    if not letters:
        shape = 0
    elif letters.isdigit():
        shape = 1
    elif not letters.isalpha():
        shape = 2
    elif letters.islower():
        shape = 3
    elif len(letters) > 1 and letters.isupper():
        shape = 4
    else:
        shape = 5 if letters[0].isupper() and letters[1:].islower() else 6
    return letters.lower(), marks, shape


def described(words: list[str]) -> np.ndarray:
    """(hash of letters, hash of marks, shape) of each word."""
    import xxhash

    one = lambda v: xxhash.xxh64_intdigest(v, SEED)
    return np.array([(one(a), one(b), c) for a, b, c in map(_describe, words)], np.uint64).reshape(-1, 3)


def ngram_buckets(words: Words, table: WordTable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, text that holds it), texts in order within each of the kinds of n-gram. `table` remembers `described` words."""
    rows = table.of(words.distinct) if table else described(words.distinct.to_pylist())
    letters, marks, shape = (np.ascontiguousarray(x)[words.index] for x in rows.T)
    owner = words.owner()
    pair = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    one, two, odd = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    form = mixed(marks * odd + shape)
    kinds = [
        (mixed(letters), owner),
        (mixed(form + one), owner),
        (mixed(letters[:-1] * two + letters[1:])[pair], owner[1:][pair]),
        (mixed(form[:-1] * two + form[1:] + odd)[pair], owner[1:][pair]),
        (mixed((letters[:-1] == letters[1:]).astype(np.uint64) + two)[pair], owner[1:][pair]),
    ]
    return (np.concatenate([k for k, _ in kinds]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([o for _, o in kinds])


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of target rows and of all rows (text, target)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, table = np.zeros((2, BUCKETS)), WordTable(described)
        for batch in batches:
            texts, target = text_column(batch), batch.column("target").to_numpy(zero_copy_only=False)
            for first, n in slices(texts):
                buckets, owner = ngram_buckets(words_of(texts.slice(first, n)), table)
                total[1] += np.bincount(buckets, minlength=BUCKETS)
                total[0] += np.bincount(buckets[target[first : first + n][owner]], minlength=BUCKETS)
        del table
        give_back()
        used = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], ["bucket", "target", "raw"])

    found = rows.mapInArrow(run, "bucket long, target double, raw double").groupBy("bucket").agg(F.sum("target"), F.sum("raw")).collect()
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, t, r in found:
        target[b], raw[b] = t, r
    return target, raw


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), each smoothed by half a count."""
    return np.log((target + 0.5) / (target.sum() + 0.5 * BUCKETS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * BUCKETS))


def _chance(mean: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of a logistic regression on one standardised input, by Newton's method with a small ridge."""
    centre, spread = mean.mean(), mean.std() or 1.0
    x = np.stack([(mean - centre) / spread, np.ones(len(mean))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), x.T @ (good - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w[0] / spread, w[1] - w[0] * centre / spread


def kth_largest(rows: DataFrame, key: str, k: int) -> float:
    """The k-th largest value of a double column (k from 1 to the number of rows), exactly, in a few counting passes."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    while True:
        if k <= 1 or not low < high:
            return high if k <= 1 else low
        width = (high - low) / 4096
        number = F.least(F.floor((F.col(key) - low) / F.lit(width)), F.lit(4095))
        bins = rows.filter(F.col(key).between(low, high)).groupBy(number.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy(F.desc("b")).collect()
        for b in bins:
            if k <= b["n"]:
                if b["n"] == 1 or b["low"] == b["high"] or (b["low"], b["high"]) == (low, high):
                    if b["n"] > 1 and b["low"] < b["high"]:  # bins no longer part them: the values are as close as doubles can be
                        return rows.filter(F.col(key).between(low, high)).orderBy(F.desc(key)).limit(k).agg(F.min(key)).first()[0]
                    return b["high"]
                low, high = b["low"], b["high"]
                break
            k -= b["n"]


def weigh(docs: DataFrame, labels: DataFrame, seed: int = SEED, sharpness: float = SHARPNESS, least_chance: float = LEAST_CHANCE) -> DataFrame:
    """doc_id, row_key, n_grams, log_weight, mean_ratio, chance, gumbel_key and selected of each row of `docs`."""
    bound_batches(docs.sparkSession)
    good = saved(labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(labels["doc_id"].cast("long").alias("_id")).agg(F.min("quality").alias("_good")))
    target = checked_broadcast(good.filter("_good = 1").select("_id"))
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["doc_id"], docs["text"]).alias("row_key"), docs["text"].cast("string").alias("text"))
    marked = text.join(target, F.col("doc_id") == F.col("_id"), "left").select("text", F.col("_id").isNotNull().alias("target"))
    ratio = log_ratios(*_counts(marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(described)
        for batch in batches:
            texts, weights, grams = text_column(batch), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for first, n in slices(texts):
                buckets, owner = ngram_buckets(words_of(texts.slice(first, n)), table)
                weights[first : first + n] = np.bincount(owner, weights=ratio[buckets], minlength=n)
                grams[first : first + n] = np.bincount(owner, minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(grams), pa.array(weights)], ["doc_id", "row_key", "n_grams", "log_weight"])
        del table
        give_back()

    weights = saved(text.mapInArrow(run, "doc_id long, row_key long, n_grams long, log_weight double"))
    mean = F.col("log_weight") / F.greatest("n_grams", F.lit(1))
    sample = good.orderBy(F.xxhash64("_id"), "_id").limit(CALIBRATION_ROWS)
    fit = weights.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).filter("n_grams > 0").groupBy("doc_id").agg(F.avg(mean).alias("mean"), F.max("_good").alias("_good")).orderBy("doc_id").toPandas()  # at most CALIBRATION_ROWS
    both = fit["_good"].nunique() == 2
    slope, shift = _chance(fit["mean"].to_numpy(), fit["_good"].to_numpy(float)) if both else (0.0, 50.0)
    chance = F.lit(1.0) / (1.0 + F.exp(-(mean * slope + shift)))
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "row_key"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = weights.withColumns({"mean_ratio": mean, "chance": chance, "gumbel_key": F.col("log_weight") * sharpness - F.log(-F.log(uniform))})
    return selected_of(keyed, keyed.filter(F.col("chance") >= least_chance).count())


def selected_of(keyed: DataFrame, k: int) -> DataFrame:
    """`keyed` with selected: the k rows of the largest gumbel_key, ties by doc_id and row_key; of rows alike in all three any."""
    if k == 0:
        return keyed.withColumn("selected", F.lit(False))
    bar = kth_largest(keyed, "gumbel_key", k)
    above = keyed.filter(F.col("gumbel_key") > bar).count()
    ties = keyed.filter(F.col("gumbel_key") == bar)
    if above + ties.count() == k:
        return keyed.withColumn("selected", F.col("gumbel_key") >= bar)
    # the rows alike in which the cut falls differ in nothing: any of them may stay
    last = ties.select("doc_id", "row_key").orderBy("doc_id", "row_key").limit(k - above).agg(F.max(F.struct(F.col("doc_id"), F.col("row_key")))).first()[0]
    own, at = F.struct(F.col("doc_id"), F.col("row_key")), F.struct(F.lit(last["doc_id"]).cast("long"), F.lit(last["row_key"]).cast("long"))
    tied = F.col("gumbel_key") == bar
    cut = tied & (own == at)
    before = keyed.filter(tied & (own < at)).count()
    rest = keyed.filter(~cut).withColumn("selected", (F.col("gumbel_key") > bar) | (tied & (own < at)))
    return rest.unionByName(first_of(keyed.filter(cut), k - above - before, "selected"))


def first_of(rows: DataFrame, n: int, name: str) -> DataFrame:
    """`rows` with a column that holds for `n` of them: the first of each partition in turn. The driver gets a number a partition."""
    numbered = saved(rows.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    allowed = {}
    for r in sorted(numbered.groupBy(part.alias("p")).count().collect(), key=lambda r: r["p"]):
        allowed[r["p"]] = min(n, r["count"])
        n -= allowed[r["p"]]
    most = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in allowed.items() for x in pair)), part) if allowed else F.lit(0)
    return numbered.withColumn(name, place < most).drop("_at")


def resampled_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that the resampling selects; of rows alike in doc_id and text as many as it selects."""
    weights = saved(weigh(docs, labels, **options))
    gone = saved(weights.filter("NOT selected").groupBy(F.col("row_key").alias("_gone")).count())
    key = F.xxhash64(docs["doc_id"], docs["text"])
    kept = docs.join(checked_broadcast(gone.select("_gone")), key == F.col("_gone"), "left_anti").select(*[docs[c] for c in docs.columns])
    # at most one key has rows on both sides of the cut
    for r in weights.filter("selected").join(gone, F.col("row_key") == F.col("_gone"), "left_semi").groupBy("row_key").count().collect():
        some = first_of(docs.filter(key == r["row_key"]), r["count"], "_stays")
        kept = kept.unionByName(some.filter("_stays").select(*docs.columns))
    return kept
