"""Relations derived across documents: flat and grouped selections, player aids, reclassified tags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.functions.text import alnum_key
from stratafold.operators.hierarchy import descendants, relative_level
from stratafold.operators.ordered import collated, placed
from stratafold.plans.target import select


#: Tag of the made-up header rows of a player aid.
HEADER_TAG = "syntheticHeader"


@dataclass(frozen=True)
class Group:
    header: object
    items: object


@dataclass(frozen=True)
class Pick:
    target: object
    with_children: bool = False


@dataclass(frozen=True)
class AidGroup:
    title: str
    items: tuple[Pick, ...] = field(default_factory=tuple)


def sort_keys(by: str = "title") -> list[Column]:
    """Sort keys of derived documents: by 'title', or by 'source' and then title; places in the document part the rest."""
    title, source = collated(F.col("title")), F.col("source")
    return {"title": [title, source, F.col("ord")], "source": [source, title, F.col("ord")]}[by]


def flat(sections: DataFrame, target, sort: str = "title", with_children: bool = False) -> DataFrame:
    """What a selector picks from all documents, sorted, each followed by its descendants if asked: place, then the section's columns."""
    picked = select(sections, target)
    if not with_children:
        return placed(picked, sort_keys(sort)).select("place", *sections.columns)
    ranked = placed(picked, sort_keys(sort), "_rank")
    under = descendants(sections, picked).join(ranked.select("source", F.col("id").alias("parent_id"), "_rank"), ["source", "parent_id"]).drop("parent_id")
    both = ranked.withColumn("_own", F.lit(0)).unionByName(under.withColumn("_own", F.lit(1)))
    return placed(both, ["_rank", "_own", "ord"]).select("place", *sections.columns)


def grouped(sections: DataFrame, groups: list[Group], sort: str = "title") -> DataFrame:
    """Per group its header at level 1 and its sorted items at level 2; a group without a header is left out."""
    out = None
    for n, g in enumerate(groups):
        header = select(sections, g.header).orderBy("source", "ord").limit(1).withColumns({"level": F.lit(1), "_part": F.lit(0)})
        items = select(sections, g.items).withColumns({"level": F.lit(2), "_part": F.lit(1)})
        rows = header.unionByName(items).withColumn("_group", F.lit(n))
        out = rows if out is None else out.unionByName(rows)
    headed = out.filter("_part = 0").select("_group")
    out = out.join(headed, "_group", "left_semi")
    return placed(out, ["_group", "_part", *sort_keys(sort)]).select("place", *sections.columns)


def player_aid(sections: DataFrame, groups: list[AidGroup], slug: str = "player-aid") -> DataFrame:
    """Made-up header rows (numbered from 1, of document `slug`, tagged), and picks in the order written, each section once across all groups, with its level relative to the match that brought it first."""
    out = None

    def add(df: DataFrame) -> None:
        nonlocal out
        out = df if out is None else out.unionByName(df)

    rank = ["_g", "_i", "_match", "_k", "ord"]
    for n, g in enumerate(groups):
        for i, pick in enumerate(g.items):
            picked = select(sections, pick.target)
            match = F.struct("source", "ord")
            add(picked.withColumns({"_match": match, "level": F.lit(2), "_g": F.lit(n), "_i": F.lit(i), "_k": F.lit(0)}))
            if pick.with_children:
                parents = picked.select("source", F.col("id").alias("parent_id"), F.col("level").alias("_level"), match.alias("_match"))
                under = descendants(sections, picked).join(parents, ["source", "parent_id"])
                add(under.withColumn("level", relative_level(F.col("level"), F.col("_level"))).drop("parent_id", "_level").withColumns({"_g": F.lit(n), "_i": F.lit(i), "_k": F.lit(1)}))
    header = lambda n, title: {"id": F.lit(str(n + 1)), "source": F.lit(slug), "title": F.lit(title), "level": F.lit(1), "content": F.lit(""), "tags": F.array(F.lit(HEADER_TAG))}
    one = sections.sparkSession.range(1)
    heads = [one.select(*(header(n, g.title).get(c, F.lit(None)).cast(sections.schema[c].dataType).alias(c) for c in sections.columns)).withColumns({"_g": F.lit(n), "_i": F.lit(-1), "_k": F.lit(0)}) for n, g in enumerate(groups)]
    if out is not None:
        rest = [c for c in out.columns if c not in ("source", "id")]
        out = out.groupBy("source", "id").agg(F.min_by(F.struct(*rest), F.struct(*rank)).alias("_r")).select("source", "id", "_r.*")
        heads = [h.withColumn("_match", F.lit(None).cast(out.schema["_match"].dataType)) for h in heads]
    for h in heads:
        add(h)
    return placed(out, [c for c in rank if c in out.columns]).select("place", *sections.columns)


def reclassified(sections: DataFrame, decks: DataFrame, replaced: list[str]) -> DataFrame:
    """Tags among `replaced` give way to the decks known for the title; without a known deck or such a tag nothing changes. `decks` has title and deck."""
    known = decks.groupBy(alnum_key(F.col("title")).alias("_key")).agg(F.array_sort(F.collect_set("deck")).alias("_decks"))
    met = sections.join(known, alnum_key(sections["title"]) == F.col("_key"), "left")
    old = F.array(*map(F.lit, replaced))
    hit = F.col("_decks").isNotNull() & F.arrays_overlap("tags", old)
    return met.withColumn("tags", F.when(hit, F.concat(F.array_except("tags", old), "_decks")).otherwise(F.col("tags"))).select(*sections.columns)
