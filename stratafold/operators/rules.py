"""Ordered rewrite rules over sections: each rule sees what the rules before it left.

A rule is a function of (sections) -> sections, made by the builders below from a
selector and its arguments; `apply` folds them. Each rule is a projection, or an
equi-join where it must find an anchor, so the fold is one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.functions import text as tx
from stratafold.operators.ordered import next_level_one_id, replace_range
from stratafold.plans.target import All, Leaf, matching

Rule = Callable[[DataFrame], DataFrame]


def apply(sections: DataFrame, rules: list[Rule]) -> DataFrame:
    return reduce(lambda df, rule: rule(df), rules, sections)


def _change(target, column: str, make: Callable[[Column], Column]) -> Rule:
    def rule(df: DataFrame) -> DataFrame:
        hit = matching(df, target, "_hit")
        return hit.withColumn(column, F.when(F.col("_hit"), make(F.col(column))).otherwise(F.col(column))).select(*df.columns)

    return rule


def ignore_images(target, hashes: list[str]) -> Rule:
    return _change(target, "content", lambda c: tx.strip_images(c, hashes))


def dedupe_images(target, hashes: list[str]) -> Rule:
    return _change(target, "content", lambda c: tx.dedupe_images(c, hashes))


def replace_text(target, find: str, to: str) -> Rule:
    return _change(target, "content", lambda c: tx.replace_first(c, find, to))


def replace_title(target, title: str) -> Rule:
    return _change(target, "title", lambda c: F.lit(title))


def set_level(target, level: int) -> Rule:
    return _change(target, "level", lambda c: F.lit(level))


def add_tag(target, *tags: str) -> Rule:
    """Append the tags a section lacks."""
    own = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return _change(target, "tags", lambda c: F.concat(own(c), F.array_except(F.array(*map(F.lit, tags)), own(c))))


def move_image(target_doc: str | None, image: str, anchor: str, before: bool) -> Rule:
    """The image goes from all of a document to just before or after the anchor, in the first section that has it; without image or anchor nothing changes."""

    def rule(df: DataFrame) -> DataFrame:
        mine = F.lit(True) if target_doc is None else F.col("source") == target_doc
        found = df.filter(mine).groupBy("source").agg(
            F.min(F.when(F.contains("content", F.lit(anchor)), F.col("ord"))).alias("_at"),
            F.min_by(F.get(F.filter(F.regexp_extract_all("content", F.lit(f"({tx._one_image(image)})"), 1), lambda x: x != ""), F.lit(0)), F.when(F.array_contains(tx.image_hashes(F.col("content")), image), F.col("ord"))).alias("_ref"),
        ).filter("_at IS NOT NULL AND _ref IS NOT NULL")
        met = df.join(found, "source", "left")
        bare = tx.strip_images(F.col("content"), [image])
        at = F.position(F.lit(anchor), bare)
        cut = at if before else at + len(anchor)
        placed = F.concat(F.substr(bare, F.lit(1), cut - 1), F.lit("" if before else "\n\n"), F.col("_ref"), F.lit("\n\n" if before else ""), F.substr(bare, cut))
        content = F.when(F.col("_at").isNull(), F.col("content")).when(F.col("ord") == F.col("_at"), placed).otherwise(bare)
        return met.withColumn("content", content).select(*df.columns)

    return rule


def replace_between(from_, to, title: str, tags: tuple[str, ...] = (), content: str = "", target=All()) -> Rule:
    """Per document, the sections of `target` from the first that `from_` selects to the first at or after it that `to` does, and all between, become one.

    It keeps the first one's id, source, level and place, and has the title, the content and the first one's tags and these.
    """

    def rule(df: DataFrame) -> DataFrame:
        hit = df
        for name, t in (("_hit_in", target), ("_hit_from", from_), ("_hit_to", to)):
            hit = matching(hit, t, name)
        own = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
        changes = {"title": F.lit(title), "content": F.lit(content), "tags": F.concat(own, F.array(*map(F.lit, tags)).cast("array<string>"))}
        changes |= {c: F.lit(None).cast(df.schema[c].dataType) for c in ("icon", "icons") if c in df.columns}
        return replace_range(hit, "source", "ord", F.col("_hit_in") & F.col("_hit_from"), F.col("_hit_in") & F.col("_hit_to"), changes).select(*df.columns)

    return rule


def split_footer(title: str, target_doc: str | None = None) -> Rule:
    """The last section's footer becomes a level-1 section of its own; a second run changes nothing."""

    def rule(df: DataFrame) -> DataFrame:
        mine = df if target_doc is None else df.filter(F.col("source") == target_doc)
        last = mine.groupBy("source").agg(F.max("ord").alias("_last"), next_level_one_id(mine).alias("_next"), F.max_by("title", "ord").alias("_title"))
        met = df.join(last.filter(F.col("_title") != title), "source", "left")
        parts = tx.footer_split(F.col("content"))
        hit = (F.col("ord") == F.col("_last")) & parts["footer"].isNotNull()
        marked = met.withColumns({"_parts": parts, "_hit": F.coalesce(hit, F.lit(False))})
        body = marked.withColumn("content", F.when(F.col("_hit"), F.col("_parts.body")).otherwise(F.col("content"))).select(*df.columns)
        new = {"ord": F.col("ord") + 1, "id": F.col("_next").cast("string"), "level": F.lit(1), "title": F.lit(title), "content": F.col("_parts.footer"), "tags": F.lit(None).cast("array<string>")}
        foot = marked.filter("_hit").select(*(new.get(c, F.col(c)).alias(c) for c in df.columns))
        return body.unionByName(foot)

    return rule


def colour_rules(colours: list[str]) -> list[Rule]:
    """Sections under '<Colour> Spells' get the tags spell and <colour>Magic."""
    from stratafold.plans.target import ChildrenOf

    return [add_tag(ChildrenOf(Leaf(title=f"^{c} Spells$")), "spell", f"{c.lower()}Magic") for c in colours]


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per source, the rows that differ in any column, by place."""
    columns = [c for c in before.columns if c not in ("source", "ord")]
    a, b = before.select("source", "ord", F.struct(*columns).alias("a")), after.select("source", "ord", F.struct(*columns).alias("b"))
    return a.join(b, ["source", "ord"], "full_outer").groupBy("source").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


