"""Extractors of entities from flattened object trees: each takes the table of `tree.named` and declarative tables, and returns rows.

Precedence among sources is a number that a grouped minimum decides by; nothing
is looked up row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.functions.text import braced_table, first_mapped, function_body, pretty_name, text, title_key, trimmed
from stratafold.operators.aggregates import merged
from stratafold.operators.layout import circular
from stratafold.operators.ordered import first_by, last_by
from stratafold.operators.tree import field, nearest_ancestor


def magic_colours(tags: Column) -> Column:
    """Colours named by tags that end in Magic."""
    return F.transform(F.filter(tags, lambda t: F.endswith(t, F.lit("Magic"))), lambda t: F.regexp_replace(t, "Magic$", ""))


def deck_of(back: Column, decks: dict[str, str], container: Column, name: Column, promoted: tuple[str, str, str, frozenset[str]]) -> Column:
    """The deck of a card's back; `promoted` (from, to, container, names) moves named cards of a container to another deck."""
    deck = F.element_at(F.create_map(*(F.lit(x) for kv in decks.items() for x in kv)), back)
    old, new, box, names = promoted
    return F.when((deck == old) & (container == box) & name.isin(*sorted(names)), F.lit(new)).otherwise(deck)


def snap_points(name: str = "AttachedSnapPoints") -> Column:
    """The node's points with three numbers, by x, z and y."""
    points = F.transform(field(name, "array<variant>"), lambda p: F.struct(*(F.try_variant_get(p, f"$.Position.{a}", "double").alias(a) for a in "xzy")))
    return F.array_sort(F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & p["z"].isNotNull()))


def by_guid(lists: DataFrame, nodes: DataFrame, keep_missing: bool) -> DataFrame:
    """Rows (guid, ord, other, label) met with the last node that has the other guid; with `keep_missing` a guid that leads nowhere keeps its label as a name."""
    last = last_by(nodes.select(F.col("guid").alias("other"), F.col("path").alias("_o"), "nickname"), ["other"], "_o").drop("_o")
    met = lists.join(last, "other", "left" if keep_missing else "inner")
    return met.withColumn("name", F.coalesce("nickname", "label")).drop("nickname")


def tile_kind(clearings: Column) -> Column:
    return F.when(F.size(clearings) == 4, F.lit("Civilisation")).otherwise(F.lit("Wilderness"))


def header_rows(*rows: tuple[Column, str, Column]) -> Column:
    """(kind, value) of those rows whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(c, F.struct(F.lit(k).alias("kind"), v.alias("value"))) for c, k, v in rows)))


def source_details(kinds: list[tuple[str, DataFrame]], icons: DataFrame, key: str = "terrain") -> DataFrame:
    """Rows of several kinds in a fixed order, with their terrain's icon."""
    out = None
    for n, (kind, df) in enumerate(kinds):
        one = df.withColumns({"kind": F.lit(kind), "kind_ord": F.lit(n)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.join(icons, key, "left")


def reward_labels(rewards: Column, plural: dict[str, str] | None = None) -> Column:
    """'+N Label' of positive numbers by label; above one the label's plural, or with an s."""
    names = F.create_map(*(F.lit(x) for kv in (plural or {"": ""}).items() for x in kv))
    return F.transform(F.array_sort(F.map_entries(F.map_filter(rewards, lambda _, v: v > 0))), lambda e: F.concat(F.lit("+"), e["value"].cast("string"), F.lit(" "), F.when(e["value"] > 1, F.coalesce(F.element_at(names, e["key"]), F.concat(e["key"], F.lit("s")))).otherwise(e["key"])))


def with_choices(cubes: Column, description: Column) -> Column:
    """Cube rows (type, name, count) rewritten by every 'Choose One A or One B Cube' and every 'Choose N Coloured Magic Cubes'.

    The first takes one of each colour from the rows of a type, that of cubes of
    these colours, 'Spell' if any is (and if none is there), and adds a row
    'a|b'; the second adds N of 'any'.
    """
    either = r"(?i)Choose\s+One\s+([A-Za-z]+)\s+or\s+One\s+([A-Za-z]+)\s+Cube"
    coloured = r"(?i)Choose\s+(\d+)\s+Colou?red\s+Magic\s+Cubes?"
    row = lambda type_, name, count: F.struct(type_.alias("type"), name.alias("name"), count.cast("int").alias("count"))
    plain = F.transform(cubes, lambda c: row(c["type"], c["name"], c["count"]))

    def less(rows: Column, type_: Column, colour: Column) -> Column:
        at = F.array_min(F.filter(F.transform(rows, lambda c, i: F.when((c["type"] == type_) & (c["name"] == colour), i)), lambda i: i.isNotNull()))
        taken = F.transform(rows, lambda c, i: row(c["type"], c["name"], c["count"] - F.when(i == at, 1).otherwise(0)))
        return F.filter(taken, lambda c, i: (c["count"] > 0) | ~F.coalesce(i == at, F.lit(False)))

    def choose(rows: Column, clause: Column) -> Column:
        a, b = (F.lower(F.regexp_extract(clause, either, i)) for i in (1, 2))
        types = F.transform(F.filter(rows, lambda c: c["name"].isin(a, b)), lambda c: c["type"])
        type_ = F.when(F.array_contains(types, "Spell"), F.lit("Spell")).otherwise(F.coalesce(F.get(types, F.lit(0)), F.lit("Spell")))
        return F.concat(less(less(rows, type_, a), type_, b), F.array(row(type_, F.concat(a, F.lit("|"), b), F.lit(1))))

    chosen = F.aggregate(F.regexp_extract_all(description, F.lit(either), 0), plain, choose)
    any_ = F.transform(F.regexp_extract_all(description, F.lit(coloured), 1), lambda n: row(F.lit("Spell"), F.lit("any"), n))
    return F.when(description.isNull(), plain).otherwise(F.concat(chosen, any_))


def clearing_offsets(script: str = "script") -> Column:
    """(guid, name, points) rows of a script's '["guid"]={ {x,y,z}, ... }, -- name' table, in order."""
    row = r'\["(\w+)"\]\s*=\s*\{((?:\s*\{[^{}]*\},?)*)\s*\},?\s*--\s*([^\n]*)'
    rows = F.regexp_extract_all(script, F.lit(row), 0)
    point = lambda p: F.transform(F.split(F.regexp_replace(p, r"[{}\s]", ""), ","), lambda x: x.cast("double"))
    return F.transform(rows, lambda r: F.struct(F.regexp_extract(r, row, 1).alias("guid"), text(F.regexp_extract(r, row, 3)).alias("name"), F.transform(F.regexp_extract_all(F.regexp_extract(r, row, 2), F.lit(r"\{[^{}]*\}"), 0), point).alias("points")))


def map_tiles(nodes: DataFrame, scripts: DataFrame, tile_type: int = 1) -> DataFrame:
    """Tiles below a named bag (their terrain) whose guid has clearing offsets: terrain, name, guid, points, kind."""
    offsets = scripts.select(F.inline(clearing_offsets())).withColumnRenamed("name", "tile")
    tiles = nearest_ancestor(nodes).filter(F.col("ancestor").isNotNull() & (F.variant_get("node", "$.CustomImage.CustomTile.Type", "int") == tile_type))
    met = tiles.join(offsets, "guid")
    return met.select(F.col("ancestor").alias("terrain"), F.coalesce("nickname", "tile").alias("name"), "guid", "points", tile_kind(F.col("points")).alias("kind"))


def _placed(rows: DataFrame, boxes: dict[str, str], default: str) -> DataFrame:
    return rows.withColumns({"place": F.col("ancestry"), "box": F.coalesce(first_mapped(F.col("ancestry"), boxes), F.lit(default))})


def chip_tiles(nodes: DataFrame, prefix: str, known: tuple[str, ...] = ()) -> DataFrame:
    """Custom tiles with notes that are chips, with image and back: marked by a script that begins with `prefix`; or of a `known` group; or with both faces inside a container of chips, or, without a name of their own, inside one named like their notes."""
    image, back = (text(F.variant_get("node", f"$.CustomImage.{p}", "string")) for p in ("ImageURL", "ImageSecondaryURL"))
    tiles = nodes.filter((F.col("kind") == "Custom_Tile") & F.variant_get("node", "$.CustomImage", "variant").isNotNull()).withColumns({"notes": text(F.col("notes")), "image": image, "back": back}).filter("notes IS NOT NULL")
    group = title_key(pretty_name(F.col("notes")))
    above = F.split(title_key(F.array_join(F.transform("ancestry", lambda a: pretty_name(a)), "\x01")), "\x01")  # all names at once, composed in one call
    inside = F.exists("ancestry", lambda a: a.rlike(r"(?i)\bchips\b")) | (F.col("nickname").isNull() & F.array_contains(above, group))
    unmarked = F.col("image").isNotNull() & F.col("back").isNotNull() & inside
    return tiles.filter(F.coalesce(F.startswith("script", F.lit(prefix)), F.lit(False)) | unmarked | group.isin(*known))


def chips(nodes: DataFrame, prefix: str, boxes: dict[str, str], default_box: str = "base", known: tuple[str, ...] = ()) -> DataFrame:
    """Chips (`chip_tiles`) keyed by their notes: copies by image pair, per place (its ancestors' names) and per box; a chip without a face is none."""
    rows = chip_tiles(nodes, prefix, known).filter("image IS NOT NULL").withColumn("key", title_key(F.col("notes")))
    return merged(_placed(rows, boxes, default_box), ["key", "image", "back"], "path", first=["nickname"], fill=["description"], unite=["tags"], place="place", box="box")


#: How scripts fetch an object, and what a table of guids and labels has.
FETCHED, LISTED, LABELLED = r'\b([A-Za-z_]\w*)\s*=\s*getObjectFromGUID\("([0-9a-f]{6})"\)', r'\["([0-9a-f]{6})"\]\s*=\s*\{([^}]*)\}\s*,?\s*--\s*([^\r\n]*)', r'"([0-9a-f]{6})"\s*,?\s*--\s*([^\r\n]*)'


def site_monsters(nodes: DataFrame, scripts: DataFrame, chip_rows: DataFrame, site: Column, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(source, site, ord, group, monster, image) rows of sites from scripts.

    A node is a site if `site` gives its name. Its own function `guardian` fetches
    monsters by guid into variables; a site without any has what the table
    Guardians of its save's script (`scripts`: source, script) lists. A fetched
    chip (`chip_rows`, of `chip_tiles`; the last of a guid) names the group, and the
    monster where its variable is Guardian and a number; other variables name the
    monster, and its first word the group where there is no chip. Labels name the
    monsters of the table, chips those without a label.
    """
    known = last_by(chip_rows.select("source", "guid", "path", pretty_name(F.col("notes")).alias("chip"), "image"), ["source", "guid"], "path").drop("path")
    sites = nodes.withColumn("site", text(site)).filter("site IS NOT NULL").select("source", "path", F.col("guid").alias("site_guid"), "site", "script")
    fetched = F.transform(F.regexp_extract_all(function_body(F.col("script"), "guardian"), F.lit(FETCHED), 0), lambda x: F.struct(F.regexp_extract(x, FETCHED, 1).alias("variable"), F.regexp_extract(x, FETCHED, 2).alias("guid")))
    own = sites.select("source", "site", "path", F.posexplode(fetched).alias("at", "f")).select("source", "site", F.struct("path", "at").alias("ord"), "f.*").filter(~F.col("variable").isin(*ignored))
    said = pretty_name(F.regexp_replace("variable", r"\d+$", ""))
    generic = F.col("variable").rlike(r"(?i)^Guardian\d*$")
    monster = F.when(generic, F.coalesce("chip", pretty_name(F.col("variable")))).otherwise(said)
    group = F.when(generic, monster).otherwise(F.coalesce("chip", F.split(said, " ")[0]))
    local = own.join(known, ["source", "guid"], "left").select("source", "site", "ord", group.alias("group"), monster.alias("monster"), "image")

    rows = scripts.select("source", F.posexplode(F.regexp_extract_all(braced_table(F.col("script"), "Guardians = {"), F.lit(LISTED), 0)).alias("line", "row"))
    listed = rows.select("source", "line", F.regexp_extract("row", LISTED, 1).alias("site_guid"), F.regexp_extract("row", LISTED, 3).alias("label"), F.posexplode(F.regexp_extract_all(F.regexp_extract("row", LISTED, 2), F.lit(LABELLED), 0)).alias("at", "one"))
    named = last_by(sites.select("source", "site_guid", "path", "site"), ["source", "site_guid"], "path").drop("path")
    met = listed.withColumn("guid", F.regexp_extract("one", LABELLED, 1)).join(named, ["source", "site_guid"], "left").join(known, ["source", "guid"], "left")
    met = met.withColumns({"site": F.coalesce("site", text(title_key(F.col("label")))), "monster": F.coalesce(text(pretty_name(text(F.regexp_extract("one", LABELLED, 2)))), F.col("chip")), "ord": F.struct(F.array("line").alias("path"), "at")}).filter("site IS NOT NULL AND monster IS NOT NULL")
    world = met.join(local.select("source", "site").distinct(), ["source", "site"], "left_anti").select("source", "site", "ord", F.coalesce("chip", "monster").alias("group"), "monster", "image")
    return local.unionByName(world)


def faced(nodes: DataFrame, faces: DataFrame) -> DataFrame:
    """Tiles whose front is one of `faces` (face, kind, both, scale): both sides alike, or one side and the scale; every copy stays a row."""
    front, back, scale = (F.variant_get("node", f"$.{p}", k) for p, k in (("CustomImage.ImageURL", "string"), ("CustomImage.ImageSecondaryURL", "string"), ("Transform.scaleX", "double")))
    rows = nodes.filter(F.col("nickname").isNotNull()).withColumns({"face": front, "_back": back, "_scale": scale})
    met = rows.join(faces.withColumnsRenamed({"kind": "site_kind", "scale": "_want"}), "face")
    return met.filter((F.col("both") & (F.col("_back") == F.col("face"))) | (~F.col("both") & (F.abs(F.col("_scale") - F.col("_want")) <= 0.001))).select("nickname", "site_kind", "description", "ancestry", "guid", "face")


def tokens(nodes: DataFrame, dimension: DataFrame) -> DataFrame:
    """Tokens by the dimension (url, terrain) of their back: the exact URL's, else that of a URL with the same last segment; copies and nicknames per terrain and image."""
    tail = lambda c: F.element_at(F.split(c, "/"), -1)
    rows = nodes.withColumns({"image": F.variant_get("node", "$.CustomImage.ImageURL", "string"), "back": F.variant_get("node", "$.CustomImage.ImageSecondaryURL", "string")}).filter("back IS NOT NULL")
    exact = dimension.select(F.col("url").alias("back"), F.col("terrain").alias("_exact")).dropDuplicates(["back"])
    ends = dimension.groupBy(tail(F.col("url")).alias("_tail")).agg(F.min("terrain").alias("_near"))
    met = rows.join(exact, "back", "left").withColumn("_tail", tail(F.col("back"))).join(ends, "_tail", "left").withColumn("terrain", F.coalesce("_exact", "_near")).filter("terrain IS NOT NULL")
    return met.groupBy("terrain", "image").agg(F.count("*").alias("copies"), F.array_sort(F.collect_set("nickname")).alias("names"))


def boards(nodes: DataFrame, sites: dict[str, list[str]]) -> DataFrame:
    """Nodes tagged side<N>: merchants named in the script, sites by a table or the notes, the image or that of state 2; boards with neither go."""
    merchants = F.array_sort(F.array_distinct(F.regexp_extract_all("script", F.lit(r'merchant\s*=\s*"([^"]+)"'), 1)))
    table = F.create_map(*(x for k, v in sites.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if sites else F.lit(None).cast("map<string,array<string>>")
    noted = F.filter(F.transform(F.split(F.coalesce("notes", F.lit("")), ","), lambda s: text(s)), lambda s: s.isNotNull())
    rows = nodes.filter(F.exists("tags", lambda t: t.rlike(r"^side\d+$")))
    image = F.coalesce(F.nullif(F.variant_get("node", "$.CustomImage.ImageURL", "string"), F.lit("")), F.variant_get("node", "$.States['2'].CustomImage.ImageURL", "string"))
    out = rows.select("guid", "nickname", F.coalesce(merchants, F.array().cast("array<string>")).alias("merchants"), F.coalesce(F.try_element_at(table, F.col("nickname")), noted).alias("sites"), image.alias("image"))
    return out.filter((F.size("merchants") > 0) | (F.size("sites") > 0))


def monsters(local: DataFrame, world: DataFrame, overrides: DataFrame) -> DataFrame:
    """(site, monster) rows: a site's override, else what its own script says, else what the global table says."""
    ranked = None
    for n, df in enumerate((overrides, local, world)):
        one = df.select("site", "monster", F.lit(n).alias("_n"))
        ranked = one if ranked is None else ranked.unionByName(one)
    best = ranked.groupBy("site").agg(F.min("_n").alias("_best"))
    return ranked.join(best, "site").filter("_n = _best").select("site", "monster")


def civ_locations(locations: DataFrame, boards: DataFrame, tiles: DataFrame) -> DataFrame:
    """(pack, name): locations (name) of a pack: those its boards (pack, sites, merchants) name, and those its tiles (pack, name, clearings) of four clearings are; names compare as titles."""
    named = boards.select("pack", F.explode(F.concat("sites", "merchants")).alias("_n")).unionByName(tiles.filter("clearings = 4").select("pack", F.col("name").alias("_n")))
    return locations.withColumn("_k", title_key(F.col("name"))).join(named.select("pack", title_key(F.col("_n")).alias("_k")).distinct(), "_k").select("pack", "name")


def tile_monsters(tiles: DataFrame, scripted: DataFrame, table: DataFrame) -> DataFrame:
    """Tiles' monsters: the script's rows (name, monster), else the table's (terrain, feature, monster) for the tile's tags; civilised tiles have none."""
    wild = tiles.filter("kind <> 'Civilisation'")
    said = wild.select("terrain", "name").join(scripted, "name")
    tagged = wild.join(scripted.select("name").distinct(), "name", "left_anti").select("terrain", "name", F.explode("tags").alias("feature")).join(table, ["terrain", "feature"])
    return said.select("terrain", "name", "monster").unionByName(tagged.select("terrain", "name", "monster").distinct())


def live_lines(script: Column) -> Column:
    """A script without the lines that are commented out."""
    return F.array_join(F.filter(F.split(script, "\n"), lambda s: ~s.rlike(r"^\s*--")), "\n")


def native_name(label: Column, group: Column, singular: dict[str, str] | None = None) -> Column:
    """A native's name from its label: a number or 'leader' stands behind the group's name, or its `singular`; others are names."""
    plain = trimmed(label)
    shown = pretty_name(F.regexp_replace(plain, r"([A-Za-z])(\d+)", "$1 $2"))
    of = F.coalesce(*(F.when(title_key(group) == k, F.lit(v)) for k, v in (singular or {}).items()), group)
    return F.when(plain.rlike(r"(?i)^(\d+|leader)$"), F.concat_ws(" ", of, shown)).otherwise(shown)


def native_summons(nodes: DataFrame, scripts: DataFrame, chip_rows: DataFrame, known: tuple[str, ...], singular: dict[str, str] | None = None, corrections: dict[str, str] | None = None) -> DataFrame:
    """(source, location, group, ord, name, image) rows of natives from scripts; a group of a location comes from the first of four kinds of script that has it.

    1. The table nativeGroups of a save's script (`scripts`: source, script) lists the
       `known` groups, at 'Native Setup'. 2. Its tables Natives and NativesAlt name, by
       the label of an entry (or its correction), groups of the first; lines that are
       commented out count for nothing. 3. Functions setup<Name>(clearing, rotation) of a
       named node fetch chips (`chip_rows`), each guid once. 4. The function
       summonNatives of a named node names groups of the first.
    """
    chip = last_by(chip_rows.select("source", "guid", "path", pretty_name(F.col("notes")).alias("chip"), "image"), ["source", "guid"], "path").drop("path")
    group_row = r"\b([a-z]+)\s*=\s*\{([\s\S]*?)\n\s*\},"
    label_row = r'"([0-9a-f]{6})"\s*,?\s*--\s*([^\n\r]+)'
    groups = scripts.select("source", F.posexplode(F.regexp_extract_all(braced_table(F.col("script"), "nativeGroups = {"), F.lit(group_row), 0)).alias("line", "row"))
    groups = groups.withColumn("group", pretty_name(F.regexp_extract("row", group_row, 1))).filter(title_key(F.col("group")).isin(*known))
    listed = groups.select("source", "line", "group", F.posexplode(F.regexp_extract_all(F.regexp_extract("row", group_row, 2), F.lit(label_row), 0)).alias("at", "one"))
    listed = listed.withColumn("guid", F.regexp_extract("one", label_row, 1)).join(chip.drop("chip"), ["source", "guid"], "left")
    base = listed.select("source", "group", F.struct(F.array("line").alias("path"), "at").alias("ord"), native_name(F.regexp_extract("one", label_row, 2), F.col("group"), singular).alias("name"), "image")

    named = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r'\bgroup\s*=\s*"([^"]+)"'), 1), lambda g: pretty_name(g))
    entry = r'(?m)^\s*\["[0-9a-f]{6}"\]\s*=\s*\{([\s\S]*?)^\s*\},?\s*--\s*([^\r\n]*)'
    table = lambda name: F.coalesce(F.regexp_extract_all(braced_table(F.concat(F.lit("\n"), "script"), f"\n{name} = {{"), F.lit(entry), 0), F.array().cast("array<string>"))
    entries = scripts.select("source", F.explode(F.concat(table("Natives"), table("NativesAlt"))).alias("row")).withColumn("location", text(F.regexp_extract("row", entry, 2)))
    if corrections:
        entries = entries.withColumn("location", F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in corrections.items() for x in kv)), F.col("location")), F.col("location")))
    by_table = entries.filter("location IS NOT NULL").select("source", "location", F.explode(named(live_lines(F.regexp_extract("row", entry, 1)))).alias("group")).distinct()

    placed = nodes.select("source", "path", text(F.col("nickname")).alias("location"), "script").filter("location IS NOT NULL")
    summoned = placed.select("source", "location", F.explode(named(function_body(F.col("script"), "summonNatives"))).alias("group")).distinct()
    setup = F.regexp_extract_all("script", F.lit(r"function\s+setup[A-Z][A-Za-z]+\(clearing,\s*rotation\)([\s\S]*?)(?=\nfunction\s|\z)"), 1)
    fetched = placed.select("source", "location", "path", F.posexplode(F.regexp_extract_all(F.array_join(setup, "\n"), F.lit(FETCHED), 0)).alias("at", "one"))
    fetched = fetched.select("source", "location", F.struct("path", "at").alias("ord"), F.regexp_extract("one", FETCHED, 1).alias("variable"), F.regexp_extract("one", FETCHED, 2).alias("guid")).join(chip, ["source", "guid"])
    own = first_by(fetched, ["source", "location", "chip", "guid"], "ord").select("source", "location", F.col("chip").alias("group"), "ord", native_name(F.col("variable"), F.col("chip"), singular).alias("name"), "image")

    kinds = [base.withColumn("location", F.lit("Native Setup")), by_table.join(base, ["source", "group"]), own, summoned.join(base, ["source", "group"])]
    rows = None
    for n, df in enumerate(kinds):
        one = df.select("source", "location", "group", "ord", "name", "image", F.lit(n).alias("_n"))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy("source", "location", "group").agg(F.min("_n").alias("_n"))
    return rows.join(best, ["source", "location", "group", "_n"], "left_semi").drop("_n")


def natives(sources: list[DataFrame]) -> DataFrame:
    """(location, group, ...) rows of several sources: per location and group the first row of the first source that has one."""
    out = None
    for n, df in enumerate(sources):
        one = df.withColumn("_o", F.struct(F.lit(n).alias("n"), F.col("ord").alias("o")))
        out = one if out is None else out.unionByName(one)
    return first_by(out, ["location", "group"], "_o").drop("_o")


def specialists(nodes: DataFrame, back: str, container: str = "Specialists") -> DataFrame:
    """Cards of a back inside a container: name and attribute of 'Name (Attribute)', and the prices their description names."""
    rows = nodes.filter(F.array_contains("ancestry", container) & (F.col("back") == back))
    split = r"^(.*?)\s*\(([^()]*)\)\s*$"
    name = F.when(F.col("nickname").rlike(split), F.regexp_extract("nickname", split, 1)).otherwise(F.col("nickname"))
    prices = F.transform(F.regexp_extract_all("description", F.lit(r"(\d+)\s*(?:gold|G\b)"), 1), lambda p: p.cast("int"))
    return rows.select(name.alias("name"), F.nullif(F.regexp_extract("nickname", split, 2), F.lit("")).alias("attribute"), prices.alias("prices"))


def legendary(places: DataFrame, cards: DataFrame) -> DataFrame:
    """Places (name, treasure) with their treasure's card, or its name alone."""
    first = first_by(cards.select(F.col("name").alias("treasure"), "ord", "face"), ["treasure"], "ord")
    return places.join(first, "treasure", "left").select("name", F.struct("treasure", "face").alias("treasure"))


#: Below this saturation a colour is pale, above this brightness bright; weights of hue, saturation and brightness.
PALE, BRIGHT, WEIGHTS = 0.18, 0.65, (4.0, 1.0, 1.0)


def clearing_type(colour: Column, samples: list[tuple[str, tuple[float, float, float]]], weights: tuple[float, float, float] = WEIGHTS) -> Column:
    """The type of a clearing's (h, s, v): pale and bright is river, pale is caves, else the nearest sample, hue on a circle."""
    rows = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), *(F.lit(float(x)).alias(a) for a, x in zip("hsv", p))) for i, (k, p) in enumerate(samples)))
    sq = lambda x: x * x
    far = lambda r: weights[0] * sq(circular(colour["h"], r["h"])) + weights[1] * sq(colour["s"] - r["s"]) + weights[2] * sq(colour["v"] - r["v"])
    nearest = F.array_min(F.transform(rows, lambda r: F.struct(far(r).alias("d"), r["i"].alias("i"), r["k"].alias("k"))))["k"]
    return F.when((colour["s"] < PALE) & (colour["v"] > BRIGHT), F.lit("river")).when(colour["s"] < PALE, F.lit("caves")).otherwise(nearest)
