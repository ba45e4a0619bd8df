"""Indexes of any size, and exact medians."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from stratafold.operators import layout
from stratafold.sources import json_documents, sinks


def test_an_index_is_sorted_files_with_a_table(spark, tmp_path):
    rows = [("hot", i, f"v{i}") for i in range(500)] + [(f"key {i}", 0, "one") for i in range(60)] + [("Élan", 1, None), ("zebra", 2, 'quote " and \n line'), ("", 3, "empty key")]
    df = spark.createDataFrame(rows, "key string, at int, value string").repartition(5)
    path = f"file://{tmp_path}/index"
    sinks.write_index(df, "key", "at", path, line_rows=7, file_lines=11)
    kind = "at: int, value: string"
    got = json_documents.index_rows(spark, path, kind).collect()
    want = {}
    for key, at, value in sorted(rows, key=lambda r: r[1]):
        want.setdefault(key, []).append((at, value))
    found = {}
    for r in sorted(got, key=lambda r: r.ord):
        assert r.ord == len(found.setdefault(r.key, []))
        found[r.key].append((r.at, r.value))
    assert found == want
    contents = spark.read.parquet(f"{path}/contents").collect()
    assert len(contents) > 5 and max(c.lines for c in contents) < 60
    order = [r.k for r in spark.createDataFrame([(k,) for k in want], "k string").orderBy(F.collate("k", "UNICODE")).collect()]
    spans = sorted((order.index(c.first_key), order.index(c.last_key)) for c in contents)
    assert all(a <= b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    some = json_documents.index_rows(spark, path, kind, ["Élan", "hot", "nowhere"])
    assert some.filter("key = 'hot'").count() == 500 and some.count() == 501
    assert len(json_documents.index_rows(spark, path, kind, ["zebra"]).inputFiles()) == 1
    assert json_documents.index_rows(spark, path, kind, []).count() == 0
    sinks.write_index(df.limit(0), "key", "at", path)
    assert json_documents.index_rows(spark, path, kind).count() == 0 and json_documents.index_rows(spark, path, kind, ["hot"]).count() == 0
    with pytest.raises(Exception, match="null key"):
        sinks.write_index(spark.createDataFrame([(None, 1, "v")], "key string, at int, value string"), "key", "at", path)


def test_medians_are_exact(spark):
    groups = {"a": [3.0, 1.0, 2.0], "b": [1e308, -1e308, 5.0, 6.0], "c": [0.1 + 0.2, 0.3, 0.3, 0.30000000000000004], "d": [7.0], None: [float(i % 997) ** 3 for i in range(4000)], "e": [1.0, math.inf, math.inf], "f": [-math.inf, 2.0, 4.0, math.inf], "g": [1.0] * 50 + [2.0] * 50}
    rows = [(k, v, -v) for k, values in groups.items() for v in values] + [("a", None, None), ("none", None, None)]
    got = {r.k: r for r in layout.medians(spark.createDataFrame(rows, "k string, x double, y double").repartition(3), ["k"], ["x", "y"]).collect()}
    assert got.keys() == {*groups, "none"} and got["none"].x is None
    for k, values in groups.items():
        if k != "e":
            assert got[k].x == pytest.approx(round(statistics.median(values), 6), abs=1e-6) and got[k].y == pytest.approx(-got[k].x)
    assert layout.medians(spark.createDataFrame([], "k string, x double"), ["k"], ["x"]).count() == 0
