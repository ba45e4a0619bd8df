"""Order as data: first and last by an ordinal, keep-first, suffixes, sorts, ranges, row packing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from stratafold.operators.ranges import RANGE_ROWS, folded
from stratafold.session import saved


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key: a grouped minimum, which combines before it shuffles."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def last_value_at_first_place(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Like a map built from pairs: a key keeps its first place and its last value."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(F.min(order).alias(order), F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, order, "_r.*")


def preferred_first(df: DataFrame, keys: list[str], preferred: Column, order: str) -> DataFrame:
    """The first row of each key for which `preferred` holds, else its first row."""
    return first_by(df.withColumn("_o", F.struct((~F.coalesce(preferred, F.lit(False))).alias("late"), F.col(order))), keys, "_o").drop("_o")


def first_non_null(column: str, order: str) -> Column:
    """An aggregate: the first value that isn't null."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order)))


def suffixed(df: DataFrame, base: str, order: list[str], name: str = "slug") -> DataFrame:
    """The second and later rows of a base get -2, -3, ... in order."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return df.withColumn(name, F.when(n == 1, F.col(base)).otherwise(F.concat(base, F.lit("-"), n.cast("string"))))


def collated(c: Column) -> Column:
    """Sort key of a locale-aware comparison."""
    return F.collate(c, "UNICODE")


def pinned_first(c: Column, pinned: str = "Neutral") -> list[Column]:
    """Sort keys: the pinned value, then the rest by collation."""
    return [(c != pinned).asc(), collated(c).asc_nulls_last()]


def domain_rank(c: Column, first: str = "Leader") -> Column:
    """0 for the first, a trailing number, else 1000."""
    return F.when(c == first, 0).otherwise(F.coalesce(F.nullif(F.regexp_extract(c, r"(\d+)\s*$", 1), F.lit("")).cast("int"), F.lit(1000)))


def by_parameter(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column has the value asked for; where no row has it, those with the least one."""
    asked = F.max(F.when(F.col(column) == F.lit(value), F.col(column)))
    wanted = df.agg(F.coalesce(asked, F.min(column)).alias("_wanted"))
    return df.join(F.broadcast(wanted), F.col(column) == F.col("_wanted")).drop("_wanted")  # one row


def in_domain(c: Column, domain: list[str]) -> Column:
    """An array's values in the order of a fixed domain."""
    return F.filter(F.array(*map(F.lit, domain)), lambda d: F.array_contains(c, d))


def next_level_one_id(df: DataFrame) -> Column:
    """An aggregate: one above the greatest level-1 id."""
    return F.coalesce(F.max(F.when(F.col("level") == 1, F.split("id", r"\.")[0].cast("int"))), F.lit(0)) + 1


def placed(df: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """`df` with each row's place, from 1, in an order over all rows.

    Rows are dealt by ranges of the order and written; a range's places begin
    after the rows of the ranges before it, one number per range. No task holds
    more than a range.
    """
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = saved(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    rows = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}  # one row per range
    before = np.concatenate(([0], np.cumsum([rows[k] for k in sorted(rows)])))
    starts = {k: int(before[i]) for i, k in enumerate(sorted(rows))}
    start = F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in starts.items() for x in kv)), F.col("_range").cast("long")) if starts else F.lit(0).cast("long")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn(name, (start + inside).cast("bigint")).drop("_range")


def replace_range(df: DataFrame, group: str, order: str, starts: Column, ends: Column, changes: dict[str, Column]) -> DataFrame:
    """Per group, the first row where `starts` holds to the first at or after it where `ends` does become one row, the first with `changes`; groups without both stay."""
    begin = df.filter(F.coalesce(starts, F.lit(False))).groupBy(group).agg(F.min(order).alias("_from"))
    till = df.filter(F.coalesce(ends, F.lit(False))).join(begin, group).filter(F.col(order) >= F.col("_from")).groupBy(group).agg(F.min("_from").alias("_from"), F.min(order).alias("_to"))
    met = df.join(till, group, "left")
    kept = met.filter(F.col("_to").isNull() | (F.col(order) <= F.col("_from")) | (F.col(order) > F.col("_to")))
    here = F.col(order) == F.col("_from")
    return kept.select(*(F.when(F.coalesce(here, F.lit(False)), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns))


def carried_forward(column: str, group: list[str], order: str) -> Column:
    """The last value that isn't null, up to each row."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def pending_to_next(column: str, group: list[str], order: str) -> Column:
    """The next value that isn't null, from each row on."""
    return F.first(column, ignorenulls=True).over(Window.partitionBy(*group).orderBy(order).rowsBetween(0, Window.unboundedFollowing))


@pandas_udf(ArrayType(StructType([StructField("row", IntegerType()), StructField("width", DoubleType())])))
def _rows(texts: pd.Series, room: pd.Series, fixed: pd.Series, gap: pd.Series) -> pd.Series:
    def one(wanted, room, fixed, gap):
        if wanted is None or room <= 0:
            return []
        text = np.clip(np.asarray(wanted, float), 1.0, max(1.0, room - fixed))
        row, left = np.zeros(len(text), int), room
        for i, need in enumerate(text + fixed):
            fresh = i == 0 or need + gap > left
            row[i] = (row[i - 1] if i else -1) + fresh
            left = (room if fresh else left - gap) - need
        used = np.bincount(row, text + fixed + gap) - gap if len(row) else np.zeros(0)
        grown = text * (1 + np.maximum(0, room - used) / np.maximum(np.bincount(row, text), 1e-300))[row] if len(row) else text
        return [{"row": int(r), "width": float(w)} for r, w in zip(row, grown)]

    return pd.Series([one(*x) for x in zip(texts, room, fixed, gap)])


def packed_rows(texts: Column, room: Column, card: Column, entry_gap: Column, row_gap: Column) -> Column:
    """The row and the justified text width of each entry (a card, a gap and a text) when rows are filled greedily in order; a row's rest is shared by its texts in proportion."""
    return _rows(texts, room, card + entry_gap, row_gap)


def rows_filled(entries: DataFrame, group: list[str], order: str, text: str, room: float, card: float, entry_gap: float, row_gap: float, range_rows: int = RANGE_ROWS) -> DataFrame:
    """`entries` with row_start (the order of the first entry of its row), row (from 0) and width, when rows are filled greedily in order.

    An entry is a card, a gap and a text at least 1 and at most what the room leaves;
    it opens a row if it doesn't fit behind a row gap, and what a row has left is
    shared by its texts in proportion. A group may be of any size: the room left
    crosses batches and ranges (`ranges.folded`), rows are numbered by their starts,
    and a row's sums are grouped. Without room there are no rows; a null text counts
    as the least one.
    """
    fixed = card + entry_gap
    least = F.least(F.greatest(F.coalesce(F.col(text).cast("double"), F.lit(1.0)), F.lit(1.0)), F.lit(max(1.0, room - fixed)))

    def step(state: list, row: tuple) -> tuple[list, tuple]:
        need, at = fixed + row[0], row[1]
        start, used = state
        if start is None or used + row_gap + need > room:
            return [at, need], (at, need)
        used += need + row_gap
        return [start, used], (start, used)

    if room <= 0:
        return entries.limit(0).selectExpr("*", f"CAST(`{order}` AS BIGINT) AS row_start", "0 AS row", "0.0D AS width")
    wanted = entries.withColumns({"_text": least, "_at": F.col(order).cast("long")})
    filled = saved(folded(wanted, group, [order], ["_text", "_at"], step, [None, 0.0], "row_start long, _used double", range_rows))
    sums = filled.groupBy(*group, "row_start").agg(F.sum("_text").alias("_texts"), F.max("_used").alias("_full"))
    # a group's rows are far fewer than its entries; they are numbered by their starts
    rows = placed_within(sums, group, "row_start").select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.col("row_start").alias("_s"), "_texts", "_full", (F.col("place") - 1).cast("int").alias("row"))
    same = F.col("row_start") == F.col("_s")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    joined = filled.join(rows, same)
    width = F.col("_text") + F.greatest(F.lit(0.0), F.lit(room) - F.col("_full")) * F.col("_text") / F.col("_texts")
    return joined.withColumn("width", width).select(*entries.columns, "row_start", "row", "width")


def placed_within(df: DataFrame, group: list[str], order: str, name: str = "place", range_rows: int = RANGE_ROWS) -> DataFrame:
    """`df` with each row's place, from 1, in its group, which may be of any size: ranges number their rows, and a range goes on behind the group's rows in the ranges before it."""
    keys = [F.col(c) for c in (*group, order)]
    ranges = max(1, -(-df.count() // range_rows))
    dealt = saved(df.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_range", *group).orderBy(order))
    if ranges == 1:
        return dealt.withColumn(name, inside.cast("long")).drop("_range")
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_range", *group).count().withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    late = counts.filter("_before > 0").select(F.col("_range").alias("_r"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(group)), "_before")
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    joined = dealt.withColumn(name, inside.cast("long")).join(F.broadcast(late), same, "left")  # at most one group of a range goes on
    return joined.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).select(*df.columns, name)
