import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratafold.llm import toxicity as tox

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def test_isotonic_is_the_pooled_mean():
    x, y = tox.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert np.interp([1, 2, 3, 4], x, y).tolist() == [0, 0.5, 0.5, 1]


def test_equal_margins_have_one_level():
    """Whatever the order of the rows, and as the pooled means of all levels say."""
    x, y = tox.isotonic(np.zeros(4), np.array([0.0, 0, 0, 1]))
    assert np.interp(0, x, y) == 0.25
    rng = np.random.default_rng(1)
    margin, label = rng.integers(0, 6, 60).astype(float), rng.integers(0, 2, 60).astype(float)
    means = [np.interp(np.arange(6.0), *tox.isotonic(margin[o], label[o])) for o in (np.arange(60), rng.permutation(60))]
    assert np.allclose(*means)
    best = [max(min(label[(margin >= a) & (margin <= b)].mean() for b in range(m, 6)) for a in range(m + 1)) for m in range(6)]
    assert np.allclose(means[0], best)


def test_a_document_of_many_rows_is_learned_from_once(spark):
    rows = [(i % 2, f"you idiot number {i}" if i % 2 else f"a kind word {i}") for i in range(400)] + [(i, "you idiot" if i % 3 == 0 else "good day") for i in range(2, 60)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i == 1 or (i > 1 and i % 3 == 0))) for i in range(60)], LABELS)
    seen = []
    own = tox._lexicons
    try:
        tox._lexicons = lambda train, size: seen.append(train.count()) or own(train, size)
        model = tox.train(docs, labels)
    finally:
        tox._lexicons = own
    usable = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60))
    assert seen == [usable] and 0 < model.share < 1


def test_features_of_small_texts():
    lexicon = {"idiot": 5.0, "nasty-": 2.5}
    x = tox.features(pa.array(["You idiot!", "", "1d1ot NASTYish word far far far far far you", "plain"]), lexicon)
    f = {n: x[:, i] for i, n in enumerate(tox.FEATURES)}
    assert f["strong"].tolist() == [0.5, 0, 1 / 9, 0]
    assert f["weak"].tolist() == [0, 0, 1 / 9, 0]
    assert f["near_you"].tolist() == [0.5, 0, 0, 0]
    assert f["undone"].tolist() == [0, 0, 1, 0]
    assert f["exclaims"][0] == 1 / 9


def test_long_words_are_undone_and_white_space_is_ascii(spark):
    lexicon = {"idiot": 5.0}
    x = tox.features(pa.array(["id!ot", "id!ot" + "." * 60, "an\u00a0idiot\u00a0here"]), lexicon)
    assert x[:, tox.FEATURES.index("heaviest")].tolist() == [5.0, 5.0, 0.0]
    train = spark.createDataFrame([(i, "an\u00a0idiot\u00a0here" if i % 2 else "good day", i % 2, i % tox.FOLDS) for i in range(40)], "doc_id long, text string, toxic int, fold int")
    assert all("idiot" not in lexicon for lexicon in tox._lexicons(train, 64))


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) & (x[:, 2] > 0.5)).astype(float)
    margin = tox.Trees().fit(x[:1500], y[:1500]).margin(x[1500:])
    assert ((margin > 0) == y[1500:]).mean() > 0.97


def test_held_out_texts_are_told_apart_and_never_learned_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = tox.train(docs, labels)
    got = tox.score(docs, model).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    held = both[both.held_out]
    rank, y = held.score.rank().to_numpy(), held.toxic.to_numpy()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / y.sum() / (len(y) - y.sum())
    assert auc > 0.93 and (held[held.toxic == 0].predicted == 0).mean() > 0.99
    flipped = labels.withColumn("toxic", F.when(tox.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = tox.score(docs, tox.train(docs, flipped)).toPandas()
    assert (again.sort_values("doc_id").score.to_numpy() == got.sort_values("doc_id").score.to_numpy()).all()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x " * 300_000), (3, "x " * 300_000), (None, "idiot")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (None, 0, 1), (3, 0, None)], LABELS)
    for own in (labels, labels.limit(0)):
        got = tox.score(docs, tox.train(docs, own)).collect()
        assert len(got) == 5 and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert tox.score(docs.limit(0), tox.train(docs.limit(0), labels)).count() == 0


def brute_score(model, text):
    """One text's score by loops: features by their definitions, trees walked node by node, levels joined by straight lines."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = []
    for w in words:
        letters = [i for i, c in enumerate(w.lower()) if c.isalpha()]
        core = w.lower()[letters[0] : letters[-1] + 1] if letters else ""
        core = core if core.isalpha() else ""
        weigh = lambda c: max([model.lexicon.get(t, 0.0) for t in ([c] + [c[:n] + "-" for n in (4, 5, 6, 7) if len(c) > n] if len(c) >= 4 else [])], default=0.0)
        odd = any(c.isalpha() for c in w) and not core
        undone = "".join(c for c in w.lower().translate(tox.LOOKALIKE) if c.isalpha())
        seen.append({"w": w, "core": core, "weight": weigh(core), "seen": weigh(undone) if odd and len(w) < 64 else weigh(core), "odd": odd, "letters": sum(c.isalpha() for c in w)})
    n, letters, chars = max(1, len(words)), max(1, sum(s["letters"] for s in seen)), max(1, sum(map(len, words)))
    strong = sum(s["seen"] >= tox.STRONG for s in seen)
    weak = sum(tox.WEAK <= s["seen"] < tox.STRONG for s in seen)
    you = [i for i, s in enumerate(seen) if s["core"] in tox.SECOND_PERSON]
    near = sum(s["seen"] >= tox.WEAK and any(abs(i - j) <= tox.NEAR_WORDS for j in you) for i, s in enumerate(seen))
    uppers = [sum(c.isupper() for c in s["w"]) for s in seen]
    x = {
        "strong": strong / n, "weak": weak / n, "weight": sum(s["seen"] for s in seen) / n, "heaviest": max([s["seen"] for s in seen], default=0.0), "near_you": near / n,
        "capitals": sum(uppers) / letters, "capital_words": sum(s["letters"] > 1 and u == s["letters"] for s, u in zip(seen, uppers)) / n,
        "marks": sum(not c.isalnum() for s in seen for c in s["w"]) / chars, "exclaims": sum(s["w"].count("!") for s in seen) / chars, "obfuscated": sum(s["odd"] for s in seen) / n,
        "undone": float(sum(s["seen"] > 0 and s["weight"] == 0 for s in seen)), "words": math.log1p(len(words)), "strong_count": min(strong, 50), "weak_count": min(weak, 50),
    }
    margin = model.trees.start
    for pick, cut, value in model.trees.trees:
        node = 0
        for _ in range(tox.DEPTH):
            f = int(pick[node])
            node = 2 * node + 1 + (sum(e < x[tox.FEATURES[f]] for e in model.trees.edges[f]) > cut[node])
        margin += value[node - (2**tox.DEPTH - 1)]
    return 0.999 * float(np.interp(margin, *model.knots)) + 0.001 / (1 + math.exp(-margin))


def test_the_query_matches_a_score_by_loops(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = tox.train(docs, labels)
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "YOU id10t!!! $tupid"), (-3, "")], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in some.collect()}
    for r in tox.score(some, model).collect():
        want = brute_score(model, texts[r.doc_id])
        assert abs(r.score - want) < 1e-9 and r.predicted == int(want >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
