"""Links into documents: by paths of headings, by titles below a reference section, by presets; merged, each once, in order.

A link has source, id, title, anchor, href, content (with children under '### title'
if asked) and sort_group. Sections are those of `plans.target`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.functions.text import blocks, block_anchor, link_preview, slug, title_forms, title_key, title_or_prefix_key
from stratafold.operators.hierarchy import descendants, heading, heading_path, heading_text

#: Paths of headings by what is asked of; {} is the name, 'a|b' either title.
PRESETS = {
    "site": ["Treasure Site Reference|Treasure Site and Merchant Reference", "{}"],
    "legendary location": ["Legendary Location Manifest", "{}"],
    "class advantage": ["Class Advantages", "{}"],
    "lineage advantage": ["Lineage Advantages", "{}"],
    "spell": ["Spell Manifest", "{}"],
}
#: Sections below which titles are looked up.
REFERENCES = {"monster": "Monster Reference|Monster Manifest", "native": "Native Reference"}


def linked(sections: DataFrame, children: DataFrame | None = None, anchor: str | None = None, sort_group: int = 0) -> DataFrame:
    """A link to each section; with `children` (source, parent_id, ord, title, content) their previews follow its own."""
    rows = sections
    own = F.col("content") if anchor is None else F.array_join(F.filter(blocks(F.col("content")), lambda b: F.startswith(block_anchor(b), F.lit(anchor))), "\n\n")
    below = None
    if children is not None:
        listed = children.groupBy("source", F.col("parent_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title", "content"))), lambda c: F.struct(c["title"].alias("title"), c["content"].alias("content"))).alias("_below"))
        rows = sections.join(listed, ["source", "id"], "left")
        below = F.coalesce("_below", F.array().cast("array<struct<title:string,content:string>>"))
    preview = link_preview(own, below)
    href = F.concat(F.lit("/"), F.col("source"), F.lit("#"), slug(F.concat_ws("-", F.col("id"), F.col("title") if anchor is None else F.lit(anchor))))
    return rows.select("source", "id", "title", F.lit(anchor).cast("string").alias("anchor"), href.alias("href"), preview["markdown"].alias("content"), preview["icons"].alias("icons"), F.lit(sort_group).alias("sort_group"))


def by_path(sections: DataFrame, headings: list[str], doc: str | None = None, with_children: bool = False, anchor: str | None = None, sort_group: int = 0) -> DataFrame:
    """Links to the sections that a path of headings leads to, in one document or in all."""
    found = heading_path(sections, headings, doc)
    return linked(found, descendants(sections, found) if with_children else None, anchor, sort_group)


def preset(sections: DataFrame, kind: str, name: str) -> DataFrame:
    """Links of a preset for a name."""
    return by_path(sections, [h.replace("{}", name) for h in PRESETS[kind]])


def below_reference(sections: DataFrame, kind: str, names: DataFrame, name: str = "name", prefix: bool = True) -> DataFrame:
    """(name, link): sections below a reference section whose title, in any case, is a form of a name, or with `prefix` begins with one and a space."""
    parents = sections.filter(heading(F.col("title")).isin(*(heading_text(h) for h in REFERENCES[kind].split("|"))))
    under = descendants(sections, parents).drop("parent_id").dropDuplicates(["source", "id"])
    forms = names.select(name, F.explode(title_forms(F.lower(title_key(F.col(name))))).alias("_form")).distinct()
    titles = title_or_prefix_key(F.col("title")) if prefix else F.array(F.lower(title_key(F.col("title"))))
    met = under.withColumn("_form", F.explode(F.array_distinct(titles))).join(forms, "_form").select(name, "source", "id").distinct()
    return met.join(linked(sections), ["source", "id"]).select(name, *linked(sections).columns)


def merged(*parts: DataFrame) -> DataFrame:
    """All links, each section and anchor once, as its least sort group has it."""
    every = reduce(lambda a, b: a.unionByName(b), parts)
    rest = [c for c in every.columns if c not in ("source", "id", "anchor")]
    return every.groupBy("source", "id", "anchor").agg(F.min_by(F.struct(*rest), F.col("sort_group")).alias("_r")).select("source", "id", "anchor", "_r.*").select(*every.columns)


def order() -> list[Column | str]:
    """Sort keys of links: made-up tags last, then by document, title, anchor and id as readers sort them."""
    read = lambda c: F.collate(F.coalesce(F.col(c), F.lit("")), "UNICODE")
    return ["sort_group", read("source"), read("title"), read("anchor"), read("id")]
