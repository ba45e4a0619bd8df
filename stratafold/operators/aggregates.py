"""Grouping: merges by identity, nested counts, unions, shares, quantifiers, frequency filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.session import saved


def bucketed(df: DataFrame, key: str, columns: list[str], order: str, name: str = "rows") -> DataFrame:
    """A keyed list of distinct rows in order of first appearance. Distinct rows meet before lists are built."""
    once = df.groupBy(key, *columns).agg(F.min(order).alias("_o"))
    return once.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", *columns))), lambda r: F.struct(*(r[c].alias(c) for c in columns))).alias(name))


def merged(df: DataFrame, identity: list[str], order: str, first: list[str] = (), fill: list[str] = (), unite: list[str] = (), place: str | None = None, box: str | None = None) -> DataFrame:
    """One row per identity: copies; `first` columns of the first row, `fill` columns' first value that isn't null, `unite` arrays as sorted sets; copies per place and per box in order of first appearance.

    Rows are read once: what each place and box of an identity has is written, and
    all else is made of it, so a hot identity is combined early.
    """
    kept = [c for c in (place, box) if c]
    late = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    united_ = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    found = [F.count("*").alias("_n"), F.min(order).alias("_o"), *(F.min_by(c, order).alias(f"_first_{c}") for c in first), *(united_(c).alias(f"_set_{c}") for c in unite)]
    found += [x for c in fill for x in (F.min_by(F.col(c), late(c)).alias(f"_fill_{c}"), F.min(late(c)).alias(f"_at_{c}"))]
    parts = df.groupBy(*dict.fromkeys([*identity, *kept])).agg(*found)
    if kept:
        parts = saved(parts)
    aggs = [F.sum("_n").alias("copies"), F.min("_o").alias(order)]
    aggs += [F.min_by(f"_first_{c}", "_o").alias(c) for c in first]
    aggs += [F.min_by(f"_fill_{c}", f"_at_{c}").alias(c) for c in fill]
    aggs += [F.array_sort(united_(f"_set_{c}")).alias(c) for c in unite]
    out = parts.groupBy(*identity).agg(*aggs)
    for column, name in ((place, "locations"), (box, "boxes")):
        if column:
            counts = parts.filter(F.col(column).isNotNull()).groupBy(*identity, column).agg(F.sum("_n").alias("count"), F.min("_o").alias("_o"))
            lists = counts.groupBy(*identity).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.struct(F.col(column).alias("value"), "count").alias("r")))), lambda x: x["r"]).alias(name))
            met = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in identity]
            out = out.alias("l").join(lists.alias("r"), met, "left").select("l.*", f"r.{name}")
    return out


def united(a: DataFrame, b: DataFrame, key: str, sums: list[str], sets: list[str], domain: list[str] | None = None) -> DataFrame:
    """Two relations merged by key: sums added, arrays united (in domain order if given), other columns from `a` first."""
    rest = [c for c in a.columns if c not in (key, *sums, *sets)]
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    unite = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    order = (lambda x: F.filter(F.array(*map(F.lit, domain)), lambda d: F.array_contains(x, d))) if domain else F.array_sort
    return both.groupBy(key).agg(*(F.sum(c).alias(c) for c in sums), *(order(unite(c)).alias(c) for c in sets), *(F.min_by(c, "_side").alias(c) for c in rest))


def united_structs(a: Column, b: Column) -> Column:
    """Structs of `a`, then those of `b` not among them, compared field by field."""
    return F.array_distinct(F.concat(a, b))


def filled_map(a: Column, b: Column) -> Column:
    """Per key the value of `a`, else of `b`."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, y))


def total_copies(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, x: s + x["count"])


def share(df: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """Rows per key, and their percentage of the rows in `within` (all, if empty)."""
    n = df.groupBy(*within, *keys).agg(F.count("*").alias("n"))
    if within:
        return n.withColumn("pct", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy(*within)), 6))
    total = n.agg(F.sum("n").alias("_all"))
    return n.join(F.broadcast(total), F.lit(True)).withColumn("pct", F.round(F.col("n") * 100 / F.col("_all"), 6)).drop("_all")  # one row


def unique_value(c: Column, drop_empty: bool = True) -> Column:
    """An aggregate: the value if all that are given are one, else null."""
    value = F.nullif(c, F.lit("")) if drop_empty else c
    return F.when(F.min(value) == F.max(value), F.min(value))


def every(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """Keys all of whose rows meet the condition, and that have rows (relational division)."""
    return df.groupBy(key).agg(F.bool_and(F.coalesce(condition, F.lit(False))).alias("_all")).filter("_all").select(key)


def some_not_all(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """Keys of which some rows meet the condition and some don't."""
    c = F.coalesce(condition, F.lit(False))
    return df.groupBy(key).agg(F.bool_or(c).alias("_any"), F.bool_and(c).alias("_all")).filter("_any AND NOT _all").select(key)


def conditional_counts(df: DataFrame, key: str, conditions: dict[str, Column]) -> DataFrame:
    return df.groupBy(key).agg(*(F.count_if(c).alias(n) for n, c in conditions.items()))


def nested_subtotals(df: DataFrame, outer: str, inner: str, copies: str) -> DataFrame:
    """Per outer key: entries (inner, copies) sorted by inner, how many, and the copies of all."""
    one = df.groupBy(outer, inner).agg(F.sum(copies).alias(copies))
    return one.groupBy(outer).agg(F.array_sort(F.collect_list(F.struct(inner, copies))).alias("entries"), F.count("*").alias("cards"), F.sum(copies).alias("copies"))


def frequent_removed(df: DataFrame, item: str, page: str, group: list[str], coverage: str | None = None, most_share: float = 0.5, most_coverage: float = 0.7) -> DataFrame:
    """Rows whose item stands on at most `most_share` of its group's pages and never covers more than `most_coverage` of one."""
    pages = df.groupBy(*group).agg(F.count_distinct(page).alias("_pages"))
    seen = df.groupBy(*group, item).agg(F.count_distinct(page).alias("_on"), *([F.max(coverage).alias("_cover")] if coverage else []))
    bad = seen.join(pages, group).filter((F.col("_on") > F.col("_pages") * most_share) | (F.col("_cover") > most_coverage if coverage else F.lit(False)))
    return df.join(bad.select(*group, item), [*group, item], "left_anti")


def pack_rollup(packs: list[tuple[DataFrame, str]], parts: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Distinct pack names of several relations, each with the sorted set of names of every part (relation, its pack, its name); parts are grouped before they are joined."""
    names = None
    for df, column in packs:
        one = df.select(F.col(column).alias("pack")).filter("pack IS NOT NULL")
        names = one if names is None else names.unionByName(one)
    out = names.distinct()
    for label, (df, pack, name) in parts.items():
        out = out.join(df.groupBy(F.col(pack).alias("pack")).agg(F.array_sort(F.collect_set(name)).alias(label)), "pack", "left")
    return out.select("pack", *(F.coalesce(p, F.array().cast("array<string>")).alias(p) for p in parts))


def non_empty_parts(packs: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """A row (key, part, items) per pack and part that has any, in the order of `parts` (ord)."""
    rows = F.array(*(F.struct(F.lit(n).alias("ord"), F.lit(p).alias("part"), F.col(p).alias("items")) for n, p in enumerate(parts)))
    return packs.select(key, F.inline(F.filter(rows, lambda r: F.size(r["items"]) > 0)))
