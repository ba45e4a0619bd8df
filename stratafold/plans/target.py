"""Selectors over sections, compiled to predicates and semi-joins.

A section table has source, ord, id, level, title, content and tags; ids are
dotted paths. A selector is a tree of the classes below. Row-local trees become
one predicate; a tree with ChildrenOf marks the sections by an equi-join on the
prefixes of their ids, never by a nested loop.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    """All given fields hold; patterns are searched for, tags must all be there."""

    doc: str | None = None
    id: str | None = None
    title: str | None = None
    content: str | None = None
    levels: tuple[int, ...] = ()
    tags: tuple[str, ...] = ()


@dataclass(frozen=True)
class All:
    pass


@dataclass(frozen=True)
class And:
    """All parts hold; none of no parts."""

    parts: tuple = field(default_factory=tuple)


@dataclass(frozen=True)
class Or:
    parts: tuple = field(default_factory=tuple)


@dataclass(frozen=True)
class Not:
    """The rest of the document. A document named inside isn't asked again, so Not(Leaf(doc=...)) selects nothing."""

    part: object


@dataclass(frozen=True)
class ChildrenOf:
    """Descendants of what `parent` selects, in its document, without it."""

    parent: object


def prefixes(id_: Column) -> Column:
    """Ids of the ancestors of a dotted id."""
    parts = F.split(id_, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).otherwise(F.array().cast("array<string>"))


def _leaf(t: Leaf) -> Column:
    asks = []
    if t.id is not None:
        asks.append(F.col("id") == t.id)
    if t.title is not None:
        asks.append(F.col("title").rlike(t.title))
    if t.content is not None:
        asks.append(F.col("content").rlike(t.content))
    if t.levels:
        asks.append(F.col("level").isin(*t.levels))
    if t.tags:
        own = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
        asks.append(F.size(F.array_except(F.array(*map(F.lit, t.tags)), own)) == 0)
    return F.coalesce(reduce(lambda a, b: a & b, asks, F.lit(True)), F.lit(False))


def document_gate(t, source: Column) -> Column:
    """Documents that a selector can select from."""
    if isinstance(t, Leaf):
        return F.lit(True) if t.doc is None else source == t.doc
    if isinstance(t, And):
        return reduce(lambda a, b: a & b, (document_gate(p, source) for p in t.parts), F.lit(True))
    if isinstance(t, Or):
        return reduce(lambda a, b: a | b, (document_gate(p, source) for p in t.parts), F.lit(False))
    if isinstance(t, ChildrenOf):
        return document_gate(t.parent, source)
    return F.lit(True)


def _marks(sections: DataFrame, t) -> tuple[DataFrame, Column]:
    """(`sections` with helper columns, the predicate on them)."""
    if isinstance(t, All):
        return sections, F.lit(True)
    if isinstance(t, Leaf):
        return sections, _leaf(t)
    if isinstance(t, (And, Or)):
        out = []
        for p in t.parts:
            sections, c = _marks(sections, p)
            out.append(c & document_gate(p, F.col("source")) if isinstance(t, Or) else c)
        return sections, reduce((lambda a, b: a & b) if isinstance(t, And) else (lambda a, b: a | b), out) if out else F.lit(False)
    if isinstance(t, Not):
        sections, c = _marks(sections, t.part)
        return sections, ~c
    base = [c for c in sections.columns if not c.startswith("_under")]
    parents = select(sections.select(*base), t.parent).select("source", F.col("id").alias("_parent"))
    name = f"_under{len([c for c in sections.columns if c.startswith('_under')])}"
    under = sections.select("source", "id", F.explode(prefixes(F.col("id"))).alias("_parent")).join(parents, ["source", "_parent"], "left_semi")
    under = under.select("source", "id").distinct().withColumn(name, F.lit(True))
    return sections.join(under, ["source", "id"], "left"), F.coalesce(F.col(name), F.lit(False))


def select(sections: DataFrame, target) -> DataFrame:
    """The sections that a selector selects."""
    marked, c = _marks(sections, target)
    return marked.filter(document_gate(target, F.col("source")) & c).select(*sections.columns)


def matching(sections: DataFrame, target, name: str = "matched") -> DataFrame:
    """`sections` with a boolean column for the selector."""
    marked, c = _marks(sections, target)
    return marked.withColumn(name, document_gate(target, F.col("source")) & c).select(*sections.columns, name)
