"""Row-local rules over a stream of sections: the same rule functions, on an unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratafold.operators.rules import Rule, apply

SECTIONS = "source string, ord long, id string, level int, title string, content string, tags array<string>"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """Sections from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(SECTIONS).parquet(folder)


def rewrite(stream: DataFrame, rules: list[Rule], to: str, checkpoint: str):
    """Start a query that rewrites arriving sections and appends them as Parquet; rules must be row-local (no anchors, no descendants)."""
    return apply(stream, rules).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
