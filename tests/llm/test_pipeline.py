from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_each_stage_works_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            rows = docs.collect()
            assert docs.columns == columns and {(r.doc_id, r.text) for r in rows} <= set(before.items())
            assert i == 0 or {r.lang for r in rows} <= {"de", "en", "es", "fr"}
            kept.append({r.doc_id for r in rows})
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] and len(kept[2]) < len(before)
    pieces = docs
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept[3]
    got = corpus_pipeline.run(spark, SF)
    total = [d.agg(F.sum("length"), F.countDistinct("doc_id")).first() for d in (pieces, got)]
    assert total[0] == total[1]


def test_entry_lists_every_operator_and_the_pipeline():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, tmp_path, rows, labels):
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("fp", "sig", "size", "shard", "row_key", "chance", "selected"):
        docs = docs.withColumn(name, F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), docs


def test_odd_rows_and_clashing_names(spark, tmp_path):
    """Nulls in any column, repeated rows, texts without words, a long text: each stage keeps the columns and no clean row is lost."""
    good = [(i, f"the words of document {i} stand here and there and tell of thing {i * 7} and of place {i * 13} " * (1 + i % 3), "en", f"s{i % 3}", 1) for i in range(60)]
    odd = [(100, None, None, None, None), (101, "", "en", "s0", 0), (None, "the words of a text without an id stand here too", None, "s1", 1), (102, "the long one " + " ".join(f"of the {i} and" for i in range(30_000)), "en", "s2", 1), good[0], good[1]]
    sf, docs = folder(spark, tmp_path, good + odd, [(i, 1, 0) for i in range(60)] + [(None, 1, 0), (100, None, None)])
    now = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        now = stage(spark, now, sf)
        now.write.parquet(f"{tmp_path}/stage{i}")
        now = spark.read.parquet(f"{tmp_path}/stage{i}")
        assert now.columns == docs.columns
        ids = {r.doc_id for r in now.select("doc_id").collect()}
        assert {*range(60), None, 102} <= ids if i < 3 else ids
    out = corpus_pipeline.run(spark, sf).toPandas()
    by = out.sort_values(["sequence_id", "offset"])
    assert ((by.groupby("sequence_id").length.cumsum() - by.length) == by.offset).all()


def test_empty_tables(spark, tmp_path):
    sf, docs = folder(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 0
