"""Sinks: sorted JSON indexes, content-addressed files, and number literals kept as they were."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from stratafold.operators.ordered import placed_within
from stratafold.session import saved


#: Rows of a key that one line of an index holds, and lines of one of its files.
LINE_ROWS, FILE_LINES = 1000, 100_000


def write_index(df: DataFrame, key: str, order: str, path: str, line_rows: int = LINE_ROWS, file_lines: int = FILE_LINES) -> None:
    """An index that maps each key to its rows, in `order` (unique in a key), at any size: files of JSON lines sorted by the collation of the key, and a table of what each file holds.

    A line has a key, the number of its rows that stand before, and at most
    `line_rows` rows, so a hot key is many lines; lines are dealt to files by ranges
    of keys. `path`/lines holds the files and `path`/contents the table, which is
    written last: an index without it is not whole. A null key is an error.
    """
    rest = [c for c in df.columns if c != key]
    named = df.select(F.when(F.col(key).isNull(), F.raise_error(F.lit("an index has no null key")).cast("string")).otherwise(F.col(key).cast("string")).alias("_key"), F.struct(*rest).alias("_row"), F.col(order).alias("_order"))
    placed = placed_within(named, ["_key"], "_order", "_place").withColumn("_first", F.floor((F.col("_place") - 1) / line_rows) * line_rows)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("_place", "_row"))), lambda r: r["_row"])
    lines = saved(placed.groupBy("_key", "_first").agg(rows.alias("rows")).select(F.collate("_key", "UNICODE").alias("_at"), F.col("_first").cast("long").alias("first"), F.to_json(F.struct(F.col("_key").alias("key"), F.col("_first").cast("long").alias("first"), "rows")).alias("value")))
    files = max(1, -(-lines.count() // file_lines))
    dealt = lines.repartitionByRange(files, "_at", "first").sortWithinPartitions("_at", "first")
    dealt.select("value").write.mode("overwrite").text(f"{path}/lines")
    back = df.sparkSession.read.text(f"{path}/lines").select(F.col("_metadata.file_name").alias("file"), F.get_json_object("value", "$.key").alias("k"), F.length("value").alias("n"))
    own = F.struct(F.collate("k", "UNICODE").alias("c"), F.col("k"))
    contents = back.groupBy("file").agg(F.min(own).alias("a"), F.max(own).alias("z"), F.count("*").alias("lines"), F.sum("n").alias("chars"))
    contents.select("file", F.col("a.k").alias("first_key"), F.col("z.k").alias("last_key"), "lines", "chars").write.mode("overwrite").parquet(f"{path}/contents")


def content_addressed(df: DataFrame, data: str, page: str, coverage: str) -> DataFrame:
    """Each content once by its SHA-1, with the pages it is on and the most of a page it covers."""
    return df.groupBy(F.sha1(data).alias("hash")).agg(F.count("*").alias("seen"), F.count_distinct(page).alias("pages"), F.max(coverage).alias("coverage"), F.min(page).alias("first_page"))


#: Keys whose numbers are 32-bit floats.
FLOAT_KEYS = frozenset("r g b a x y z posX posY posZ rotX rotY rotZ scaleX scaleY scaleZ xSize ySize".split())


def same_number(value: Column, before: Column, float_key: Column) -> Column:
    """Equal as 32-bit floats, or near enough under a float key."""
    near = F.abs(value - before) <= F.greatest(F.lit(1e-5), F.greatest(F.abs(value), F.abs(before)) * 1e-6)
    return (value.cast("float") == before.cast("float")) | (float_key & near)


def short_literal(value: Column) -> Column:
    """A number's text: whole numbers without a point, from 1e10 on with as few significant digits as their 32-bit float needs; 32-bit floats with as few decimals as they need; else all digits."""
    single, whole = value.cast("float"), value == F.floor(value)
    digits = [F.format_string(f"%.{n}e", value).cast("double") for n in range(15)]
    few = F.coalesce(*(F.when(d.cast("float") == single, d) for d in digits), value)
    integer = F.when(F.abs(value) >= 1e10, few).otherwise(value).cast("decimal(38,0)").cast("string")
    decimals = [F.format_string(f"%.{n}f", value) for n in range(10)]
    exact = F.coalesce(*(F.when(d.cast("double").cast("float") == single, d) for d in decimals))
    return F.when(whole, integer).when(single.cast("double") == value, F.coalesce(exact, value.cast("string"))).otherwise(value.cast("string"))


def kept_literals(values: DataFrame, baselines: list[DataFrame]) -> DataFrame:
    """(path, text): the number's literal from the first baseline (path, literal) that has an equal number at its path, else its own; whole numbers under float keys get '.0'."""
    out = values.withColumn("_key", F.element_at(F.split("path", r"\."), -1))
    is_float = F.col("_key").isin(*sorted(FLOAT_KEYS))
    hits = []
    for n, b in enumerate(baselines):
        out = out.join(b.select("path", F.col("literal").alias(f"_b{n}")), "path", "left")
        hits.append(F.when(same_number(F.col("value"), F.col(f"_b{n}").cast("double"), is_float), F.col(f"_b{n}")))
    own = F.concat(short_literal(F.col("value")), F.when(is_float & (F.col("value") == F.floor("value")), ".0").otherwise(""))
    return out.select("path", F.coalesce(*hits, own).alias("text"))


@pandas_udf(ArrayType(StructType([StructField("path", StringType()), StructField("literal", StringType())])))
def number_tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The number literals of JSON texts with their paths, as they are written."""
    import json

    class Literal(str):
        pass

    def walk(node, path, out):
        if isinstance(node, dict):
            for k, v in node.items():
                walk(v, [*path, k], out)
        elif isinstance(node, list):
            for i, v in enumerate(node):
                walk(v, [*path, str(i)], out)
        elif isinstance(node, Literal):
            out.append({"path": ".".join(path), "literal": str(node)})
        return out

    for s in texts:
        yield s.map(lambda t: walk(json.loads(t, parse_int=Literal, parse_float=Literal), [], []) if t else [])
