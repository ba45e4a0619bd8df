import re
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafold.llm import filter_audit as fa

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    """The failed filters of each row, by loops."""
    out = []
    for doc, text, _ in rows:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        copies = [d for d, t, _ in rows if (t or "") == text and d is not None]
        own = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": re.search("[#$%&*|]", text) is not None, "E": doc is not None and any(d < doc for d in copies),
        }
        out.append({f for f, failed in own.items() if failed})
    return out


def audited(rows, labels):
    found, out = fails(rows), set()
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    for part in {s or "" for _, _, s in rows}:
        own = [(d, f) for (d, _, s), f in zip(rows, found) if (s or "") == part]
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for i, f in enumerate(order):
                removed, before = [x for x in left if f in x[1]], left
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(removed)
                redundant = sum(f in x[1] for x in own) - sum(f in x[1] for x in before)
                steps.append((part, order, i + 1, len(left), len(removed), redundant, sum(x[1] == {f} for x in own), sum(x[0] in good for x in removed), sum(x[0] in toxic for x in removed), f))
        out |= {(*s[:-1], shapley[s[-1]]) for s in steps}
    return out


def made(seed, n=120):
    rng = np.random.default_rng(seed)
    words = ["a", "b", "C", "D#", "e", "fog", "é", "x|y", "Gh"]
    text = lambda: None if rng.random() < 0.1 else " ".join(rng.choice(words, int(rng.integers(0, 4)))) if rng.random() < 0.5 else " ".join(f"w{i}{rng.choice(words)}" for i in range(int(rng.integers(150, 260))))
    some = [text() for _ in range(n // 3)]
    rows = [(int(rng.integers(0, n)) if rng.random() < 0.85 else None, some[int(rng.integers(0, len(some)))], [None, "", "p", "q"][int(rng.integers(0, 4))]) for _ in range(n)]
    labels = [(int(rng.integers(0, n)) if rng.random() < 0.9 else None, [None, 0, 1][int(rng.integers(0, 3))], [None, 0, 1][int(rng.integers(0, 3))]) for _ in range(n)]
    return rows, labels


@pytest.mark.parametrize("seed", range(4))
def test_every_step_of_every_order(spark, seed):
    rows, labels = made(seed)
    rows += rows[:5]  # rows alike
    docs = spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit("clash")).withColumn("good", F.lit("clash")).withColumn("n", F.lit(7))
    got = fa.audit(docs, spark.createDataFrame(labels, LABELS).withColumn("toxic_lost", F.lit(1))).collect()
    want = audited(rows, labels)
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_the_sql_agrees(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = fa.audit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    found = duck.execute(fa.ORACLE)
    places = [[d[0] for d in found.description].index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in places) for r in found.fetchall())


def test_inversion_from_joint_counts():
    rng = np.random.default_rng(0)
    exactly = rng.integers(0, 50, 32)  # documents that fail a set and nothing else
    joint = np.array([sum(exactly[t] for t in range(32) if t & s == s) for s in range(32)])
    assert (fa.MOEBIUS @ joint == [sum(exactly[t] for t in range(32) if t & s == 0) for s in range(32)]).all()
    shapley = fa.SHARES @ joint
    assert shapley.sum() == 120 * (exactly.sum() - exactly[0])  # the orders share all that goes


def test_copies_of_one_text_everywhere(spark):
    rows = [(i % 50, "same text", "p" if i % 3 else None) for i in range(4000)] + [(None, "same text", "p")] * 30 + [(60, "x " * 30_000, "p")]
    got = fa.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS)).collect()
    firsts = {part: sum(1 for d, t, s in rows if t == "same text" and (s or "") == part and d not in (None, 0)) for part in ("", "p")}
    e = {r.part: r.removed for r in got if r.filter_order == "EABCD" and r.step == 1}
    assert e == firsts


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert fa.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], DOCS)
    assert {r.removed for r in fa.audit(one, labels).collect() if r.filter_order.startswith("A") and r.step == 1} == {1}
