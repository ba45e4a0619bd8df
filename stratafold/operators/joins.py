"""Joins the library's relations meet by: keyed lookups, cascades, fuzzy names, manifests, audits.

All are equi-joins on derived keys; sides are left to Catalyst and AQE, which
broadcast only by measured size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.functions.text import heads, name_variants, slug, title_key
from stratafold.operators.ordered import first_by, last_by
from stratafold.session import saved


def lookup(df: DataFrame, table: DataFrame, keys: list[str], order: str | None = None, last: bool = True) -> DataFrame:
    """LEFT join on null-safe keys to a table made unique first: its last row of a key wins, or its first."""
    side = table if order is None else (last_by if last else first_by)(table, keys, order).drop(order)
    side = side.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    met = reduce(lambda a, b: a & b, (df[k].eqNullSafe(side[f"_k_{k}"]) for k in keys))
    return df.join(side, met, "left").drop(*(f"_k_{k}" for k in keys))


def strict(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join that fails on a key the table lacks."""
    side = table.withColumnRenamed(key, "_key")
    met = df.join(side, df[key] == F.col("_key"), "left")
    return met.withColumn(key, F.when(F.col("_key").isNull(), F.raise_error(F.concat(F.lit("unknown key: "), F.coalesce(df[key].cast("string"), F.lit("null")))).cast(df.schema[key].dataType)).otherwise(df[key])).drop("_key")


def _by_title(asked: DataFrame, index: DataFrame, ids: list[str]) -> DataFrame:
    """`asked` (ids, _k) met with `index` (_ik): rows of the very title, else of the title in any case; _exact tells which."""
    met = asked.join(index, F.lower("_k") == F.lower("_ik")).withColumn("_exact", F.col("_k") == F.col("_ik"))
    best = met.groupBy(*ids).agg(F.bool_or("_exact").alias("_any"))
    return met.join(best, ids).filter("_exact = _any").drop("_any", "_k", "_ik")


def cascade(names: DataFrame, index: DataFrame, aliases: DataFrame, key: str = "name", order: str = "ord", categories: dict[str, str] | None = None) -> DataFrame:
    """Names resolved by title: (key, match_rank, alias_ord, matched...).

    Titles of all sides are compared as `title_key` has them. Rank 1 is the very
    title, 2 the title in any case (all rows); where both miss, 3 is what the
    name's aliases lead to, each by the same two ways, in alias order. A name
    without an alias that is a category (name -> prefix) has, as rank 4, all
    titles that begin with the prefix. An alias that leads nowhere gives nothing.
    """
    index = saved(index.withColumn("_ik", title_key(F.col(key))).drop(key))
    asked = saved(names.select(key).distinct().withColumn("_k", title_key(F.col(key))))
    direct = _by_title(asked, index, [key]).withColumns({"match_rank": F.when(F.col("_exact"), 1).otherwise(2), "alias_ord": F.lit(0)}).drop("_exact")
    titles = index.select(F.lower("_ik").alias("_title")).distinct()
    missed = saved(asked.join(titles, F.lower("_k") == F.col("_title"), "left_anti"))
    known = aliases.select(title_key(F.col("alias")).alias("_k"), title_key(F.col("target")).alias("_to"), F.col(order).cast("int").alias("alias_ord"))
    led = missed.join(known, "_k").select(key, "alias_ord", F.col("_to").alias("_k"))
    via = _by_title(led, index, [key, "alias_ord"]).withColumn("match_rank", F.lit(3)).drop("_exact")
    out = direct.unionByName(via)
    if categories:
        of = F.coalesce(*(F.when(F.startswith("_ik", F.lit(p)), F.lit(c)) for c, p in categories.items()))
        loose = missed.join(known.select("_k"), "_k", "left_anti").join(index.withColumn("_k", of).drop("_ik"), "_k").drop("_k")
        out = out.unionByName(loose.withColumns({"match_rank": F.lit(4), "alias_ord": F.lit(0)}))
    return out


def manifest(rows: DataFrame, cards: DataFrame, key: str, both: bool = False) -> DataFrame:
    """Every manifest row with its cards counted, even none; with `both`, cards without a manifest row too."""
    n = cards.groupBy(key).agg(F.count("*").alias("cards"))
    return rows.withColumn("listed", F.lit(True)).join(n, key, "full_outer" if both else "left").withColumns({"cards": F.coalesce("cards", F.lit(0).cast("bigint")), "listed": F.coalesce("listed", F.lit(False))})


def preferred_key(left: DataFrame, first: DataFrame, first_key: str, second: DataFrame, second_key: str) -> DataFrame:
    """Joined by the first key where the row has one, else by the second: a first key that misses doesn't fall back."""
    by_first = left.filter(F.col(first_key).isNotNull()).join(first, first_key, "left")
    by_second = left.filter(F.col(first_key).isNull()).join(second, second_key, "left")
    return by_first.unionByName(by_second, allowMissingColumns=True)


def any_key(a: DataFrame, b: DataFrame, id_a: str, id_b: str, keys_a: Column, keys_b: Column) -> DataFrame:
    """Pairs that share any of several keys, once each: the keys are exploded and met by an equi-join."""
    left = a.select(id_a, F.explode(F.array_distinct(keys_a)).alias("_k"))
    right = b.select(id_b, F.explode(F.array_distinct(keys_b)).alias("_k"))
    return left.join(right, "_k").select(id_a, id_b).distinct()


def name_keys(c: Column) -> Column:
    """What two names may agree on: the name, its lower case, its slug."""
    return F.array(c, F.lower(c), slug(c, ascii_only=True))


def fuzzy_names(asked: DataFrame, groups: DataFrame, name: str, group: str, priority: str) -> DataFrame:
    """The first group (by priority) one of whose forms a form of the name equals or begins with as whole words: (name, group)."""
    left = asked.select(name).distinct().select(name, F.explode(_begun(F.col(name))).alias("_form"))
    right = groups.select(group, priority, F.explode(name_variants(F.col(group))).alias("_form"))
    met = left.join(right, "_form")
    return met.groupBy(name).agg(F.min_by(group, F.struct(priority, group)).alias(group))


def _begun(c: Column) -> Column:
    """The beginnings, in whole words, of all forms of a name."""
    return F.array_distinct(F.flatten(F.transform(name_variants(c), heads)))


def casters(spells: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, spell, sides, casters): spells (spell, side, ord, caster) that a group (group, chips) casts.

    A caster meets a group if one of its forms is the group's or begins with it as
    whole words, and a chip if their forms are equal. Sides are in the order
    front, back; casters in the order they stand, front first, each once.
    """
    rows = spells.select("spell", "side", "ord", "caster")
    whole = rows.select("*", F.explode(name_variants(F.col("caster"))).alias("_form"), F.lit(True).alias("_whole"))
    begun = rows.select("*", F.explode(_begun(F.col("caster"))).alias("_form"), F.lit(False).alias("_whole"))
    named = groups.select("group", F.explode(name_variants(F.col("group"))).alias("_form"), F.lit(False).alias("_whole"))
    chips = groups.select("group", F.explode("chips").alias("_chip")).select("group", F.explode(name_variants(F.col("_chip"))).alias("_form"), F.lit(True).alias("_whole"))
    met = whole.unionByName(begun).join(named.unionByName(chips), ["_form", "_whole"])
    place = F.struct((F.col("side") != "front").alias("late"), F.col("ord"))
    once = met.groupBy("group", "spell", "caster").agg(F.min(place).alias("_o"), F.collect_set("side").alias("_sides"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_o", "caster"))), lambda x: x["caster"])
    sides = F.flatten(F.collect_set("_sides"))
    return once.groupBy("group", "spell").agg(F.filter(F.array(F.lit("front"), F.lit("back")), lambda s: F.array_contains(sides, s)).alias("sides"), listed.alias("casters"))


def title_or_prefix(forms: DataFrame, sections: DataFrame, form: str, title: str = "title") -> DataFrame:
    """Sections whose title is a form or begins with a form and a space."""
    return sections.withColumn(form, F.explode(F.array_distinct(heads(F.col(title))))).join(forms.select(form).distinct(), form)


def with_nested_key(df: DataFrame, nested: Column, keys: DataFrame, key: str, id_: str) -> DataFrame:
    """Rows whose array holds a key of `keys` (semi-join)."""
    hit = df.select(id_, F.explode(nested).alias(key)).join(keys.select(key), key, "left_semi").select(id_).distinct()
    return df.join(hit, id_, "left_semi")


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among `keys`; a null key stays (anti-join)."""
    return df.join(keys.select(key).filter(F.col(key).isNotNull()), key, "left_anti")


def resolved(targets: DataFrame, dimensions: list[tuple[str, DataFrame, str]], key: str) -> DataFrame:
    """Each target's kind: the first dimension (kind, relation, its key) that holds it; targets that none holds go."""
    known = None
    for n, (kind, df, column) in enumerate(dimensions):
        one = df.select(F.col(column).alias(key)).distinct().select(key, F.lit(n).alias("_n"), F.lit(kind).alias("kind"))
        known = one if known is None else known.unionByName(one)
    best = known.groupBy(key).agg(F.min_by("kind", "_n").alias("kind"))
    return targets.join(best, key)


def references(slugs: DataFrame, table: DataFrame, slug_: str, forms: Column) -> DataFrame:
    """Rows of a reference table for each slug: the exact slug's, else those of any title form; links are fanned out, made-up tags last."""
    asked = slugs.select(slug_, F.posexplode(F.array_distinct(F.concat(F.array(F.col(slug_)), forms))).alias("_n", "_form"))
    met = asked.join(table.withColumnRenamed(slug_, "_form"), "_form")
    best = met.groupBy(slug_).agg(F.min("_n").alias("_best"))
    return met.join(best, slug_).filter("_n = _best").select(slug_, F.col("_form").alias("entry"), "link", F.startswith("link", F.lit("_")).cast("int").alias("sort_group"))


def titled(asked: DataFrame, known: DataFrame, reference: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """(reference, title): titles of the entries of `known` (slug, name, title) whose slug is the reference's, or its alias, or whose name is the reference as titles compare; the reference itself where there is none."""
    own = slug(F.col(reference))
    if aliases:
        table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
        own = F.coalesce(F.element_at(table, own), own)
    keys = lambda a, b: F.explode(F.array(F.concat(F.lit("s "), a), F.concat(F.lit("n "), title_key(b)))).alias("_k")
    left = asked.select(reference).distinct().select(reference, keys(own, F.col(reference)))
    met = left.join(known.select("title", keys(F.col("slug"), F.col("name"))), "_k").select(reference, "title").distinct()
    return asked.join(met, reference, "left").withColumn("title", F.coalesce("title", reference))


def injected(rows: DataFrame, wanted: DataFrame, tokens: DataFrame, key: str, order: str) -> DataFrame:
    """`rows` and, for each wanted key they lack, a row made of the first token with that key."""
    missing = wanted.select(key).distinct().join(rows.select(key), key, "left_anti")
    made = first_by(tokens, [key], order).join(missing, key, "left_semi")
    return rows.withColumn("made_up", F.lit(False)).unionByName(made.select(*rows.columns).withColumn("made_up", F.lit(True)))


def layout_match(boards: DataFrame, layouts: DataFrame, items: str = "items") -> DataFrame:
    """Boards with the layout that has the same multiset of items."""
    key = lambda c: F.array_join(F.array_sort(c), "\0")
    return boards.withColumn("_k", key(F.col(items))).join(layouts.select(key(F.flatten("rows")).alias("_k"), "rows"), "_k", "left").drop("_k")


def position_in(rows: Column, item: Column) -> Column:
    """(row, column) of an item in a layout, from 0."""
    at = F.filter(F.transform(rows, lambda r, i: F.struct(i.alias("row"), (F.array_position(r, item) - 1).cast("int").alias("column"))), lambda p: p["column"] >= 0)
    return F.get(at, F.lit(0))


def zipped(a: Column, b: Column) -> Column:
    """Pairs by array index; the longer side's rest meets null."""
    return F.arrays_zip(a.alias("a"), b.alias("b"))


def audit(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Expected rows that are missing or have another value."""
    met = expected.alias("e").join(actual.select(F.col(key).alias("_k"), F.col(value).alias("found")), F.col(f"e.{key}") == F.col("_k"), "left")
    return met.filter(~F.col(f"e.{value}").eqNullSafe(F.col("found"))).select("e.*", "found", F.col("_k").isNull().alias("missing")).drop("_k")


def detail(base: DataFrame, key: str, parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """`base` with an array of structs per part (relation with the key, its columns), each grouped before the join; empty where there is none."""
    out = base
    for name, (df, columns) in parts.items():
        rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(rows, key, "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    return out
