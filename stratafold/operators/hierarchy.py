"""Hierarchies in dotted ids: numbering, heading levels, heading paths, descendants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.functions.text import title_key, title_text
from stratafold.operators.ranges import RANGE_ROWS, folded
from stratafold.plans.target import prefixes

LEVELS = 8


def clamp_level(level: Column) -> Column:
    return F.least(F.lit(8), F.greatest(F.lit(1), level))


def relative_level(child: Column, match: Column) -> Column:
    """The level of a descendant below a match that stands at level 2."""
    return clamp_level(F.lit(2) + child - match)


def numbered(df: DataFrame, doc: str, order: str, level: str = "level", name: str = "id", levels: int = 8) -> DataFrame:
    """Dotted ids from levels: a counter per level that a lower level resets, 0 for levels passed over.

    A counter is the running count of its level less that count at its last
    reset, so all windows share one order and a document is sorted once.
    """
    by_doc = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counts = {k: F.count_if(F.col(level) == k).over(by_doc) for k in range(1, levels + 1)}
    out = df.select("*", *(c.alias(f"_c{k}") for k, c in counts.items()))
    reset = {k: F.last(F.when(F.col(level) < k, F.col(f"_c{k}")), ignorenulls=True).over(by_doc) for k in counts}
    out = out.select("*", *((F.col(f"_c{k}") - F.coalesce(r, F.lit(0))).alias(f"_n{k}") for k, r in reset.items()))
    path = F.slice(F.array(*(F.col(f"_n{k}") for k in counts)), F.lit(1), F.col(level))
    return out.withColumn(name, F.array_join(F.transform(path, lambda n: n.cast("string")), ".")).drop(*(f"_{x}{k}" for k in counts for x in "cn"))


def heading_levels(strengths: Column, levels: Column | None = None) -> Column:
    """Levels of headings in order, from their strengths (smaller is stronger): the one given in `levels`, else one below the lowest open stronger heading, at most 8.

    A heading closes all headings of lower levels and the one of its own.
    """
    top = 8
    pairs = F.arrays_zip(strengths.alias("strength"), (levels if levels is not None else F.transform(strengths, lambda _: F.lit(None).cast("int"))).alias("level"))

    def step(s: Column, h: Column) -> Column:
        stronger = F.transform(s["open"], lambda o, i: F.when(o < h["strength"], i + 1).otherwise(0))
        level = F.coalesce(h["level"], F.least(F.lit(top), F.array_max(stronger) + 1))
        seen = F.transform(s["open"], lambda o, i: F.when(i + 1 == level, h["strength"]).when(i + 1 < level, o))
        return F.struct(seen.alias("open"), F.concat(s["out"], F.array(level)).alias("out"))

    start = F.struct(F.array_repeat(F.lit(None).cast("int"), top).alias("open"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(pairs, start, step, lambda s: s["out"])


def _open_headings(state: list, row: tuple) -> tuple[list, tuple]:
    """One heading's level among the open ones, and what it leaves open: `state` holds the strengths open at levels 1, 2, ..., null for levels passed over."""
    strength, level = row
    if level is None:
        stronger = [i for i, s in enumerate(state, 1) if s is not None and s < strength]
        level = min(LEVELS, (stronger[-1] if stronger else 0) + 1)
    return [*state[: level - 1], *[None] * (level - 1 - len(state)), strength], (level,)


def with_heading_levels(headings: DataFrame, doc: str, order: str, strength: str = "strength", level: str | None = None, name: str = "heading_level", range_rows: int = RANGE_ROWS) -> DataFrame:
    """One heading a row, with its level: the one given in column `level`, else one below the lowest open stronger heading, at most 8.

    A heading closes those of lower levels and the one of its own, so what decides
    is the nearest stronger heading that is still open. Documents may be of any
    size: ranges of headings run at the same time (`ranges.folded`). A given level
    must lie in 1 to 8, and a strength must not be null.
    """
    given = F.lit(None).cast("int") if level is None else F.col(level).cast("int")
    bad = F.col(strength).isNull() | F.coalesce(~given.between(1, LEVELS), F.lit(False))
    checked = headings.withColumn("_given", F.when(bad, F.raise_error(F.lit("a heading needs a strength, and a level from 1 to 8 if any")).cast("int")).otherwise(given))
    return folded(checked, [doc], [order], [strength, "_given"], _open_headings, [], f"`{name}` int", range_rows).drop("_given")


def descendants(sections: DataFrame, parents: DataFrame) -> DataFrame:
    """Each (source, id) of parents with its descendants: parent_id and the section's columns."""
    under = sections.withColumn("parent_id", F.explode(prefixes(F.col("id"))))
    return under.join(parents.select("source", F.col("id").alias("parent_id")).distinct(), ["source", "parent_id"])


def heading(c: Column) -> Column:
    """A heading as headings compare: its title key without trailing dots and colons."""
    return F.trim(F.regexp_replace(title_key(c), "[.:]+$", ""))


def heading_text(value: str) -> str:
    return title_text(value.strip()).rstrip(".:").strip()


def heading_path(sections: DataFrame, headings: list[str], doc: str | None = None) -> DataFrame:
    """Sections reached by a path of titles, each below the one before; 'a|b' allows either, trailing dots and colons don't count.

    A section that several parents reach is listed once.
    """
    keyed = sections.withColumn("_h", heading(F.col("title")))
    here = keyed if doc is None else keyed.filter(F.col("source") == doc)
    found = here.filter(F.col("_h").isin(*(heading_text(h) for h in headings[0].split("|"))))
    for h in headings[1:]:
        ask = F.col("_h").isin(*(heading_text(x) for x in h.split("|")))
        found = descendants(here.filter(ask), found).drop("parent_id").dropDuplicates(["source", "id"])
    return found.drop("_h")
