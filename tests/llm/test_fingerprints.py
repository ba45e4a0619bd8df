import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratafold.llm import fingerprints as fp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(text):
    votes = np.zeros(64)
    for w in re.split(r"[\x20\x09-\x0D]+", text):
        if w:
            h, weight = xxhash.xxh64_intdigest(w.encode(), 42), min(len(w), 12) ** 2
            votes += [weight if h >> b & 1 else -weight for b in range(64)]
    return sum(1 << b for b in range(64) if votes[b] > 0)


def expected(rows):
    rows = [(d, t or "") for d, t in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    marks = [brute(t) for _, t in rows]
    out = []
    for i, (d, t) in enumerate(rows):
        n, follower = len(t), rows[(i + 1) % len(rows)][1]
        edited = t[: n - n // 2] + follower[: n // 2]
        e = brute(edited)
        like = lambda a, b: 1 - (a ^ b).bit_count() / 64
        near = sum((marks[i] ^ m).bit_count() <= 3 for m in marks) - 1 if d is not None and d % 50 == 0 else None
        out.append((d, n, hashlib.sha256(edited.encode()).hexdigest(), f"{marks[i]:016x}", f"{e:016x}", like(marks[i], e), like(marks[i], marks[(i + 1) % len(rows)]), near))
    return sorted(out, key=str)


def got(docs):
    return sorted((tuple(r) for r in fp.document_fingerprints(docs).collect()), key=str)


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(docs) == expected([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("ids", [range(0, 3000, 7), [-(2**62), -5, 0, 3, 2**62], [50], [4, 2, 100]])
def test_order_across_bins(spark, ids, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_BIN", 2)
    rows = [(i, f"é{i} words of text {i % 5} é") for i in ids]
    assert got(spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS).repartition(3)) == expected(rows)


def test_many_rows_of_one_or_no_doc_id_follow_by_their_hash(spark, monkeypatch):
    """And no bin holds them all."""
    monkeypatch.setattr(fp, "ROWS_PER_BIN", 8)
    rows = [(None, f"no id {i} words") for i in range(300)] + [(7, f"crowded {i} here") for i in range(300)] + [(i, f"own {i} text") for i in range(0, 300)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS).repartition(5)
    hashed = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    placed = fp._binned(docs)
    order = [r.text for r in placed.filter("tail = 0").orderBy("bin", F.col("doc_id").asc_nulls_first(), "hash").collect()]
    assert order == [t for _, t in rows]
    assert placed.groupBy("bin").count().agg(F.max("count")).first()[0] <= 60
    assert placed.groupBy("bin").agg(F.sum("tail").alias("t")).filter("t <> 1").count() == 0
    want = {}
    for i, (d, t) in enumerate(rows):
        follower = rows[(i + 1) % len(rows)][1]
        want.setdefault(d, []).append(hashlib.sha256((t[: len(t) - len(t) // 2] + follower[: len(t) // 2]).encode()).hexdigest())
    found = {}
    for r in fp.document_fingerprints(docs).collect():
        found.setdefault(r.doc_id, []).append(r.edited_sha256)
    assert {d: sorted(v) for d, v in found.items()} == {d: sorted(v) for d, v in want.items()}


def test_bins_stay_even_whatever_ids_repeat_or_cluster(spark, monkeypatch):
    """An id of 1 % and one of a third of all rows, ids far apart, rows alike in all."""
    monkeypatch.setattr(fp, "ROWS_PER_BIN", 16)
    monkeypatch.setattr(fp, "FINE", 4)
    rows = [(7, f"one {i}") for i in range(30)] + [(9, f"third {i}") for i in range(1000)] + [(2**40 + i, f"far {i}") for i in range(700)] + [(i * i, f"own {i}") for i in range(10, 500)] + [(11, "alike")] * 700 + [(None, "no id")] * 90
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS).repartition(5)
    placed = fp._binned(docs)
    sizes = [r["n"] for r in placed.filter("tail = 0").groupBy("bin").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 2 * 16 + 8 * 4 and len(sizes) >= len(rows) // 16 - 2
    hashed = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    assert [r.text for r in placed.filter("tail = 0").orderBy("bin", F.col("doc_id").asc_nulls_first(), "hash").collect()] == [t for _, t in rows]
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + rows[(i + 1) % len(rows)][1][: len(t) // 2]).encode()).hexdigest() for i, (_, t) in enumerate(rows))
    assert sorted(r.edited_sha256 for r in fp.document_fingerprints(docs).collect()) == want


def test_votes_of_long_texts_are_summed_by_parts(spark, monkeypatch):
    monkeypatch.setattr(fp, "PART_WORDS", 50)
    texts = [" ".join(f"word{i * k % 97}" for i in range(n)) for n, k in ((49, 3), (50, 5), (51, 7), (1000, 11))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    assert {r.k: r.fp & (2**64 - 1) for r in fp.fingerprinted(df, ["k"]).collect()} == {k: brute(t) for k, t in enumerate(texts)}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a" * 300_001), (None, "no id"), (50, "𝔘𝔫 two three"), (100, "𝔘𝔫 two three")]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS).withColumn("bin", F.lit("clash")).withColumn("fp", F.lit("x"))
    assert got(docs) == expected(rows)
    again = spark.createDataFrame([(7, "same text", None, None, 0)] * 3, DOCS)
    assert got(again) == expected([(7, "same text")] * 3)
    assert fp.document_fingerprints(docs.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_block_tables_find_all_within_the_radius_once(spark, blocks):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 60)]
    near = [b ^ sum(1 << int(k) for k in rng.choice(63, int(rng.integers(1, 6)), replace=False)) for b in base for _ in range(3)]
    stored = sorted({*base, *near})
    found = fp.within_radius(spark.createDataFrame([(b,) for b in base], "probe long"), spark.createDataFrame([(s,) for s in stored], "fp long"), 3, blocks).collect()
    want = sorted((b, s) for b in base for s in stored if ((b ^ s) & (2**64 - 1)).bit_count() <= 3)
    assert sorted(map(tuple, found)) == want
