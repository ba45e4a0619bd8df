import re
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stratafold.llm import lm_scoring as lm

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, good):
    """Scores by dictionaries over all rows."""
    texts = [(d, [xxhash.xxh64_intdigest(w) >> (64 - lm.CLASS_BITS) for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))]) for d, t in rows]
    pairs = lambda t: list(zip(["<s>", *t[:-1]], t))
    words = [Counter(w for d, t in texts if x or d in good for w in t) for x in (0, 1)]
    grams = [Counter(p for d, t in texts if x or d in good for p in pairs(t)) for x in (0, 1)]
    contexts = [Counter(p[0] for d, t in texts if x or d in good for p in pairs(t)) for x in (0, 1)]
    total = [sum(w.values()) for w in words]
    scale = [1, total[0] / total[1] if total[1] else 0]

    def p(word, before, x):
        one = (words[x][word] * scale[x] + 0.5) / (total[x] * scale[x] + 0.5 * lm.CLASSES)
        return (grams[x][before, word] * scale[x] + 50 * one) / (contexts[x][before] * scale[x] + 50)

    out = []
    for d, t in texts:
        loss = [sum(-log(p(w, v, x)) for v, w in pairs(t)) / max(1, len(t)) for x in (0, 1)]
        out.append((d, len(t), *loss, loss[0] - loss[1]))
    return out


def same(got, want):
    got, want = (sorted(map(tuple, x), key=lambda r: (str(r[0]), r[1], round(r[2], 6))) for x in (got, want))
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and np.allclose(g[2:], w[2:], atol=1e-9)


@pytest.mark.parametrize("run_pairs, common", [(1 << 20, 8), (30, 3), (30, 10**9)])
def test_scores_match_brute_force(spark, monkeypatch, run_pairs, common):
    """Whatever the runs and wherever a pair is counted."""
    monkeypatch.setattr(lm, "RUN_PAIRS", run_pairs)
    monkeypatch.setattr(lm, "COMMON", common)
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(["a", "b", "C", "dd", "e", f"rare{i}"], int(rng.integers(0, 40)), p=[0.4, 0.2, 0.15, 0.1, 0.1, 0.05]))) for i in range(40)]
    rows += [(40, None), (41, " \n"), (42, "a"), (3, rows[3][1]), (None, "a b a b"), (43, "the " * 70_000)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS).withColumn("score", F.lit("clash")).withColumn("target", F.lit(1))
    good = {3, 7, 8, 20, 42}
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(43)] + [(7, 1, 0), (9, 1, 0), (None, 1, 0)], LABELS)
    same(lm.cross_entropy_differences(docs, labels).collect(), brute(rows, good))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_rule_is_the_same_at_every_size(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in labels.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").collect()}
    same(lm.cross_entropy_differences(docs, labels).collect(), brute([(r.doc_id, r.text) for r in docs.collect()], good))


def test_a_text_that_occurs_twice_is_told_apart(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(4000)]
    once = [" ".join(rng.choice(words, 200)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate([*once, *once[:10]])], DOCS)
    got = {r.doc_id: r.loss_background for r in lm.cross_entropy_differences(docs, spark.createDataFrame([(i, 1, 0) for i in range(70)], LABELS)).collect()}
    assert max(got[i] for i in range(10)) < min(got[i] for i in range(10, 60))


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    words = np.zeros((2, lm.CLASSES))
    words[:, rng.integers(0, lm.CLASSES, 50)] = rng.integers(1, 9, (2, 50))
    pairs = np.unique(rng.integers(0, lm.CLASSES, 300)) + 7 * lm.CLASSES
    counts = rng.integers(0, 5, (2, len(pairs))).astype(float)
    contexts = np.zeros((2, lm.CLASSES + 1))
    contexts[:, 7] = counts.sum(axis=1)
    model = lm.Model(words, contexts, np.empty(0, np.int64), np.zeros((2, 0)))
    for before in (7, lm.CLASSES):
        keys = before * lm.CLASSES + np.arange(lm.CLASSES)
        own = np.zeros((2, lm.CLASSES))
        if before == 7:
            own[:, pairs % lm.CLASSES] = counts
        assert np.allclose(np.exp(-model.losses(keys, own)).sum(axis=1), 1)


def test_codes_come_back():
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, lm.CLASSES * (lm.CLASSES + 1), 1000)
    codes = lm.spread(pairs)
    assert (lm.unspread(codes) == pairs).all()
    for ranges in (1, 7, 1000):
        place = lm.range_of(codes, ranges)
        for part in np.unique(place):
            inside = np.sort(codes[place == part] - lm.first_of(int(part), ranges))
            docs, half = np.arange(len(inside)).astype("<u2"), inside * 0.5
            back = lm.unplaned(lm.planes(lm.steps(inside), docs, half), "<u8", "<u2", "<f8")
            assert (np.cumsum(back[0], dtype=np.uint64) == inside).all() and (back[1] == docs).all() and (back[2] == half).all()
        assert place.min() >= 0 and place.max() < ranges and (codes >= lm.first_of(place, ranges)).all()


def test_target_like_text_scores_lower(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = lm.cross_entropy_differences(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg("score").alias("m")).collect()
    by = {r.quality: r.m for r in got}
    assert by[1] < by[0]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a a a b", None, None, 0)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert abs(lm.cross_entropy_differences(docs, none).first().score) < 1e-12
    assert lm.cross_entropy_differences(docs.limit(0), none).count() == 0
