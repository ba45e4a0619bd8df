import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratafold.llm import quality
from stratafold.llm.arrowtext import words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_kth_largest_is_exact(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=2000), np.full(50, 0.25), rng.normal(size=200) * 1e6]).tolist()
    df = spark.createDataFrame([(v,) for v in values], "x double").cache()
    for k in (1, 2, 100, 777, 1000, 1040, len(values)):
        assert quality.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


def test_weights_match_brute_force_and_the_top_k_is_the_top_k(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = quality.weigh(docs, labels).toPandas().set_index("doc_id")
    rows = docs.select("doc_id", "text").toPandas()
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    buckets = {d: quality.ngram_buckets(words_of(pa.array([t])))[0] for d, t in rows.itertuples(index=False)}
    target, raw = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for d, b in buckets.items():
        np.add.at(raw, b, 1)
        if d in good:
            np.add.at(target, b, 1)
    ratio = quality.log_ratios(target, raw)
    for d, b in buckets.items():
        assert abs(got.loc[d].log_weight - ratio[b].sum()) < 1e-6 and got.loc[d].n_grams == len(b)
    k = int((got.chance >= quality.LEAST_CHANCE).sum())
    assert set(got[got.selected].index) == set(got.sort_values("gumbel_key").index[-k:])


def test_clean_stays_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = quality.resampled_documents(docs, labels).join(labels, "doc_id").groupBy("quality").count().collect()
    by = {r.quality: r["count"] for r in kept}
    assert by[1] == labels.filter("quality = 1").count()
    assert by.get(0, 0) <= 0.1 * labels.filter("quality = 0").count()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Good words here."), (4, "Good words here."), (5, "$$$ %%% !!"), (None, "no id"), (6, "long " * 100_000)]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], DOCS).withColumn("selected", F.lit("clash"))
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (4, 1, 0), (None, 1, 0), (6, None, 1)], "doc_id long, quality int, toxic int")
    out = quality.weigh(docs, labels).collect()
    assert len(out) == len(rows) and {r.log_weight for r in out if r.doc_id in (1, 2, 3)} == {0.0}
    assert quality.resampled_documents(docs, labels).columns == docs.columns
    none = spark.createDataFrame([], DOCS)
    assert quality.weigh(none, labels).count() == 0 and quality.resampled_documents(none, labels).count() == 0
    assert quality.weigh(docs, labels.limit(0)).filter("selected").count() == len(rows)


def test_a_document_of_many_rows_counts_once_in_the_calibration(spark):
    """Its rows are averaged, whatever their number, and no document is left out for it."""
    rows = [(i, ("good words stand here " if i % 2 else "$$$ %%% !! ") * 5 + str(i)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    frame = lambda some: spark.createDataFrame([(i, t, None, "s", 0) for i, t in some], DOCS)
    got = quality.weigh(frame(rows + [rows[0]] * 500), labels).groupBy("doc_id").agg(F.max("selected").alias("s")).collect()
    assert {r.doc_id for r in got if r.s} == set(range(1, 40, 2))


def test_marks_after_the_eighth_tell_words_apart():
    one, other = (quality._describe("a" + "-" * 8 + mark) for mark in "!?")
    assert one != other and one[0] == other[0] == "a"


@pytest.mark.parametrize("seed", range(2))
def test_exactly_k_rows_stay_where_rows_alike_stand_at_the_cut(spark, seed):
    rows = [(i, f"text {i}") for i in range(10)] + [(99, "alike")] * 10
    docs = spark.createDataFrame([(i, t, None, "s", n) for n, (i, t) in enumerate(rows)], DOCS).repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    weights = quality.weigh(docs, labels, seed=seed, sharpness=0.0)
    assert weights.filter("selected").count() == weights.filter(F.col("chance") >= quality.LEAST_CHANCE).count()
    keyed = weights.drop("selected").cache()
    keys = sorted((r.gumbel_key for r in keyed.collect()), reverse=True)
    for k in (3, 8, 11, 13, 19):
        got = quality.selected_of(keyed, k).filter("selected").collect()
        assert sorted((r.gumbel_key for r in got), reverse=True) == keys[:k]


def test_documents_alike_stay_as_often_as_selected(spark, monkeypatch):
    rows = [(i, f"text {i}") for i in range(10)] + [(99, "alike")] * 10
    docs = spark.createDataFrame([(i, t, None, "s", n) for n, (i, t) in enumerate(rows)], DOCS).repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    own = quality.weigh
    for k in (5, 14):
        monkeypatch.setattr(quality, "weigh", lambda d, l, **options: quality.selected_of(own(d, l, sharpness=0.0).drop("selected"), k))
        kept = quality.resampled_documents(docs, labels).collect()
        assert len(kept) == k and len({r.n_chars for r in kept}) == k
