"""Scans of JSON documents with fixed schemas; a missing or broken file can be an empty relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())
SECTION = T.StructType([T.StructField(n, T.IntegerType() if n == "level" else _TEXTS if n in ("icons", "tags") else T.StringType()) for n in "id source level title headingStyle location icon icons content tags".split()])
DOCUMENT = T.StructType([T.StructField("version", T.StringType()), T.StructField("content", T.ArrayType(SECTION))])


def documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Sections of rulebook files with ord, their place in the document; a document is named by its first section's source, and one without fails."""
    raw = spark.read.option("multiLine", True).schema(DOCUMENT).json(paths)
    checked = raw.withColumn("content", F.when((F.size("content") > 0) & F.get("content", F.lit(0))["source"].isNotNull(), F.col("content")).otherwise(F.raise_error(F.lit("a document needs content and a source")).cast(raw.schema["content"].dataType)))
    rows = checked.select(F.get("content", F.lit(0))["source"].alias("doc"), F.posexplode("content").alias("ord", "s"))
    return rows.select("doc", "ord", "s.*")


def registry(sections: DataFrame) -> DataFrame:
    """Documents by slug, sorted, with how many sections they have."""
    return sections.groupBy("doc").agg(F.count("*").alias("sections")).orderBy("doc")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop))


def json_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON relation; no rows where the file is missing, none from a file that doesn't parse."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not _exists(spark, path):
        return spark.createDataFrame([], kind)
    bad = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", bad, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.filter("r IS NOT NULL AND r._bad IS NULL").select("r.*").drop("_bad")


def keyed_index(spark: SparkSession, path: str, row: str) -> DataFrame:
    """(key, ord, row's fields) of a file that maps keys to lists of rows, in the order of its keys."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.posexplode(F.map_entries(F.from_json("value", f"map<string, array<struct<{row}>>>"))).alias("k", "e"))
    rows = entries.select("k", F.col("e.key").alias("key"), F.posexplode("e.value").alias("ord", "r"))
    return rows.select("key", "k", "ord", "r.*")


def index_rows(spark: SparkSession, path: str, row: str, keys: list[str] | None = None) -> DataFrame:
    """(key, ord, row's fields) of an index that `sinks.write_index` wrote; with `keys` only theirs, from the files that can hold one by the index's own table."""
    lines = f"{path}/lines"
    if keys is None:
        text = spark.read.text(lines)
    else:
        wanted = [F.lit(k) for k in keys]
        collated = lambda c: F.collate(c, "UNICODE")
        near = spark.read.parquet(f"{path}/contents").filter(F.exists(F.array(*wanted) if wanted else F.array().cast("array<string>"), lambda k: (collated(k) >= collated(F.col("first_key"))) & (collated(k) <= collated(F.col("last_key")))))
        files = [r.file for r in near.select("file").collect()]  # the files that hold the keys asked for
        text = spark.read.text([f"{lines}/{f}" for f in files]) if files else spark.createDataFrame([], "value string")
    entries = text.select(F.from_json("value", f"key string, first bigint, rows array<struct<{row}>>").alias("e"))
    if keys is not None:
        entries = entries.filter(F.col("e.key").isin(*keys))
    rows = entries.select("e.key", "e.first", F.posexplode("e.rows").alias("at", "r"))
    return rows.select("key", (F.col("first") + F.col("at")).alias("ord"), "r.*")


def backfilled(df: DataFrame, column: str, *others: str, default: str = "Neutral") -> DataFrame:
    """A column filled from others, then by a literal."""
    return df.withColumn(column, F.coalesce(column, *others, F.lit(default)))


def save_files(spark: SparkSession, paths: str | list[str], **more: Column) -> DataFrame:
    """(source, save) of object-tree files; source is the file's stem. `more` columns may ask of the file's `_metadata`, such as the place `first` of a tree's piece."""
    text = spark.read.text(paths, wholetext=True)
    return text.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("source"), F.col("value").alias("save"), *(c.alias(n) for n, c in more.items()))


def newest_file(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, modificationTime, length) of the file changed last below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "modificationTime", "length")
    return files.agg(F.max_by(F.struct("path", "modificationTime", "length"), F.struct("modificationTime", "path")).alias("_f")).select("_f.*")
