"""Jobs from files to files: rules over documents, derived documents, indexes of entities.

Each reads JSON by glob, and writes one JSON document per name; they return what
they did as a relation, for a log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.operators import derived, rules
from stratafold.session import saved
from stratafold.sources import json_documents, sinks

_FIELDS = ("id", "source", "level", "title", "headingStyle", "location", "icon", "icons", "content", "tags")


def write_documents(sections: DataFrame, name: str, order: str, path: str, version: str | None = None) -> None:
    """A JSON document per `name`, its sections in order: an object with version and content, or without a version their array. A document's file is written by one task."""
    item = F.struct(*(c for c in _FIELDS if c in sections.columns))
    content = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), item.alias("s")))), lambda r: r["s"])
    whole = sections.groupBy(F.col(name).alias("document")).agg(content.alias("content"))
    value = F.to_json("content") if version is None else F.to_json(F.struct(F.lit(version).alias("version"), "content"))
    whole.select("document", value.alias("value")).write.mode("overwrite").partitionBy("document").text(path)


def transform(spark: SparkSession, source: str, ordered_rules: list[rules.Rule], path: str) -> DataFrame:
    """Apply rules to the documents of `source` and write them; (doc, sections, changed) of each."""
    read = json_documents.documents(spark, source)
    before = saved(read.withColumn("ord", F.col("ord").cast("long") * 1000).withColumn("source", F.col("doc")).drop("doc"))
    after = saved(rules.apply(before, ordered_rules))
    write_documents(after, "source", "ord", path, "1")
    counts = after.groupBy("source").agg(F.count("*").alias("sections"))
    return rules.changed_rows(before, after).join(counts, "source").select(F.col("source").alias("doc"), "sections", "changed")


def derive(spark: SparkSession, source: str, specs: dict[str, dict], path: str) -> DataFrame:
    """Write derived documents of the documents of `source`; (document, source, sections) of each.

    A specification names what it is: {'flat': target, 'sort', 'with_children'},
    {'groups': [Group], 'sort'} or {'aid': [AidGroup]}.
    """
    sections = saved(json_documents.documents(spark, source).withColumn("source", F.col("doc")).drop("doc"))
    out = None
    for name, spec in specs.items():
        if "flat" in spec:
            rows = derived.flat(sections, spec["flat"], spec.get("sort", "title"), spec.get("with_children", False))
        elif "groups" in spec:
            rows = derived.grouped(sections, spec["groups"], spec.get("sort", "title"))
        else:
            rows = derived.player_aid(sections, spec["aid"], name)
        rows = rows.withColumn("document", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    made = saved(out)
    write_documents(made, "document", "place", path)
    return made.groupBy("document", "source").agg(F.count("*").alias("sections"))


def extract(indexes: dict[str, tuple[DataFrame, str, str]], path: str) -> None:
    """Write each relation as an index by its key, rows of a key in an order: <path>/<name>."""
    for name, (df, key, order) in indexes.items():
        sinks.write_index(df, key, order, f"{path}/{name}")
