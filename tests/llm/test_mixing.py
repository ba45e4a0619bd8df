import numpy as np
from pyspark.sql import functions as F

from stratafold.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: 3 * sizes[s] for s in over})


def test_targets_and_takes(spark):
    rng = np.random.default_rng(0)
    rows, n = [], 0
    for source, count in (("a", 40), ("b", 3), ("é", 90), ("z", 5), (None, 20), ("Z", 1), ("empty", 2)):
        for _ in range(count):
            rows.append((n, " ".join(["w"] * int(rng.integers(1, 300))) if source != "empty" else None, "en", source, 0))
            n += 1
    docs = spark.createDataFrame(rows, DOCS)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    want = brute_targets(sizes)
    got = mixing.takes(docs).toPandas().set_index("doc_id")
    assert len(got) == len(rows)
    taken = {}
    for r in rows:
        g = got.loc[r[0]]
        assert abs(g.target - want[r[3]]) < 1e-5 and g.source_size == sizes[r[3]] and g["size"] == len((r[1] or "").split())
        assert 0 <= g.taken <= 3 * g["size"]
        taken[r[3]] = taken.get(r[3], 0) + g.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    again = mixing.takes(docs.repartition(7)).toPandas().set_index("doc_id")
    assert (again.sort_index() == got.sort_index()).all().all()


def test_splitting_tree_is_exact_and_hypergeometric(spark):
    quotas = [40, 25, 0, 35]
    one = spark.createDataFrame([(quotas,)], "quotas array<long>")
    leaves = [r.quotas for r in mixing.split_quotas(one, 8).orderBy("shard").collect()]
    assert np.array(leaves).sum(axis=0).tolist() == quotas
    assert max(sum(x) for x in leaves) - min(sum(x) for x in leaves) <= 1
    draws = spark.range(20_000).selectExpr(f"{mixing.hypergeometric_sql('100', '40', '30', 'pmod(xxhash64(id), 9007199254740992) / 9007199254740992D')} AS x").toPandas().x
    assert abs(draws.mean() - 12) < 0.06 and abs(draws.var() - 30 * 0.4 * 0.6 * 70 / 99) < 0.2
    assert draws.min() >= 0 and draws.max() <= 30
    law = np.bincount(np.random.default_rng(1).hypergeometric(40, 60, 30, 200_000), minlength=31) / 200_000
    assert np.abs(np.bincount(draws, minlength=31) / 20_000 - law).max() < 0.01


def test_hypergeometric_edges(spark):
    for p, k, n in ((0, 0, 0), (5, 5, 3), (5, 0, 3), (7, 3, 0), (7, 3, 7), (1, 1, 1), (10**7, 5 * 10**6, 10**6)):
        x = spark.sql(f"SELECT min({mixing.hypergeometric_sql(str(p), str(k), str(n), '(id / 10D)')}) AS a, max({mixing.hypergeometric_sql(str(p), str(k), str(n), '(id / 10D)')}) AS b FROM range(10)").first()
        assert max(0, n - (p - k)) <= x.a <= x.b <= min(k, n)


def test_shards_hold_disjoint_blocks_of_exact_quota(spark):
    docs = spark.createDataFrame([(i, "w " * (700 if i else 30_000), "en", f"s{i % 3}", 0) for i in range(300)], DOCS)
    sources = mixing.targets(mixing.sized(docs)).toPandas().sort_values("source_no")
    pieces = mixing.dealt(docs, shards=4).filter("shard IS NOT NULL").toPandas()
    assert (pieces.words > 0).all() and (pieces.groupby(["source_no", "block"]).words.sum() <= mixing.LEAST_BLOCK).all()
    by_block = pieces.groupby(["source_no", "block"]).shard.nunique()
    assert (by_block == 1).all() and by_block.groupby("source_no").size().tolist() == (-(-sources.quota // mixing.LEAST_BLOCK)).tolist()
    assert pieces.groupby("source_no").words.sum().tolist() == sources.quota.tolist()
    vector = spark.createDataFrame([((-(-sources.quota // mixing.LEAST_BLOCK)).tolist(),)], "quotas array<long>")
    leaves = {r.shard: r.quotas for r in mixing.split_quotas(vector, 4).collect()}
    for shard, quotas in leaves.items():
        own = pieces[pieces["shard"] == shard].drop_duplicates(["source_no", "block"]).groupby("source_no").size()
        assert [int(own.get(n, 0)) for n in sources.source_no] == quotas
    assert not mixing.mix(docs, shards=4).toPandas().duplicated(["source_no", "pos", "epoch"]).any()


def test_the_query_follows_the_tree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * 700, "en", f"s{i % 3}", 0) for i in range(300)], DOCS)
    own = mixing.takes(docs).toPandas().set_index("doc_id").sort_index()
    assert len(set(own.shards)) > 10 and own.taken.sum() == 300 * 700
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, shards, seed: quotas.selectExpr("0 AS shard", "quotas"))
    one = mixing.takes(docs).toPandas().set_index("doc_id").sort_index()
    assert set(one.shards) == {"0", ""} and (one.taken == own.taken).all()
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, shards, seed: quotas.selectExpr("0 AS shard", "transform(quotas, q -> q - 1) AS quotas"))
    assert mixing.takes(docs).toPandas().taken.sum() < own.taken.sum()


def test_mixed_documents_repeat_whole_rows(spark):
    rows = [(i, f"text {i} " + "w " * 50, "en", "a" if i < 5 else "b", 7) for i in range(40)] + [(3, "text 3 " + "w " * 50, "en", "a", 7), (50, None, "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("shard", F.lit("s"))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = out.toPandas()
    assert set(got.shard) == {"s"} and 50 not in set(got.doc_id)
    assert set(map(tuple, got[["doc_id", "text"]].values)) <= {(r[0], r[1]) for r in rows}
    assert (got[got.source == "a"].doc_id.value_counts().drop(3) == 3).all() and (got.doc_id == 3).sum() == 6


def test_hot_ids_and_rows_alike_share_no_bin(spark, monkeypatch):
    """A third of the ids null, a third one id, some rows repeated: bins stay small, and each row gets its own words."""
    monkeypatch.setattr(mixing, "ALIKE_ROWS", 7)
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {i} " + "w " * (i % 50), "en", "ab"[i % 2], 0) for i in range(3000)]
    rows += [(100_000, "alike words here", "en", "a", 0)] * 40 + [(9, "w " * 60_000, "en", "b", 0), (None, None, "en", None, 0), (None, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("place", F.lit("clash")).withColumn("bin", F.lit(1))
    places = mixing.sized(docs).groupBy("source", F.substring("place", 1, 2)).agg(F.countDistinct("place").alias("n")).agg(F.max("n"), F.avg("n")).first()
    assert places[0] <= 5 * places[1]
    got = mixing.takes(docs).toPandas()
    assert len(got) == len(rows) and got["size"].sum() == sum(len((r[1] or "").split()) for r in rows)
    want = brute_targets({s: sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in ("a", "b", None)})
    for source, own in got.groupby("source_size"):
        target = own.target.iloc[0]
        assert abs(own.taken.sum() - target) <= 0.5 and any(abs(target - t) < 1e-5 for t in want.values())
    assert (got.taken <= 3 * got["size"]).all() and len(got[got.doc_id == 100_000]) == 40
    pieces = mixing.dealt(docs).filter("shard IS NOT NULL").toPandas()
    assert not pieces.duplicated(["source_no", "pos", "epoch", "block"]).any()


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert mixing.takes(docs).count() == 0 and mixing.mixed_documents(docs).count() == 0
