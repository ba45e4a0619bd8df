"""Object trees in JSON: flattening with ancestry, nearest typed ancestors, sprite cells, extractors.

A tree is one document, so it is walked in one pass where it lies: no shuffle,
no step per level, and nodes go out in batches of bounded size. A node goes out
without what it contains, which has rows of its own, so the output grows with
the tree and not with its depth. A node's path is a list of places, which orders
all nodes depth-first. A tree too large for one text comes in pieces (`flatten`),
each of which is walked where it lies.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.functions.text import text
from stratafold.session import ship

NODES = "source string, path array<int>, node string, lineage array<struct<kind: string, guid: string, name: string>>"
_LINEAGE = pa.list_(pa.struct([("kind", pa.string()), ("guid", pa.string()), ("name", pa.string())]))
#: Nodes and characters that are sent on at a time.
SENT_NODES, SENT_CHARS = 10_000, 4 << 20


def walk(tree: dict, roots: str, children: tuple[str, ...], states: bool, first: int = 0) -> Iterator[tuple[list[int], dict, list[dict]]]:
    """(path, node, lineage) depth-first: roots, then what they hold; with `states`, alternate states after the contained objects. Of a piece, whose roots hold objects from place `first` on, the roots go out only if that is 0."""

    def said(node: dict, key: str) -> str | None:
        value = node.get(key)
        return value if value is None or isinstance(value, str) else json.dumps(value)

    tops = tree.get(roots) if isinstance(tree, dict) else None
    stack = [([i], node, []) for i, node in enumerate(tops or [])][::-1]
    while stack:
        path, node, lineage = stack.pop()
        if not isinstance(node, dict):
            continue
        if not first or len(path) > 1:
            yield path, node, lineage
        below = [x for c in children for x in node.get(c) or []]
        if states:
            below += list((node.get("States") or {}).values())
        if below:
            own = [*lineage, {"kind": said(node, "Name"), "guid": said(node, "GUID"), "name": (said(node, "Nickname") or "").strip().strip("\ufeff").strip() or None}]
            stack += [([*path, i], x, own) for i, x in enumerate(below, first if len(path) == 1 else 0)][::-1]


def flatten(saves: DataFrame, save: str = "save", roots: str = "ObjectStates", children: tuple[str, ...] = ("ContainedObjects",), states: bool = False) -> DataFrame:
    """(source, path, node, ancestry, depth, lineage) of every object: roots, then what they hold, to any depth.

    `saves` has source and the JSON text. ancestry lists the names of the
    ancestors that have one, outermost first, and lineage all ancestors (kind,
    guid, name); with `states`, alternate states are visited after the contained
    objects. A null or empty text has no objects; one that isn't JSON is an error.

    A tree of any size comes in pieces: rows of one source whose texts have the same
    root, without states of its own, and a slice of what it holds each, with the place
    of the slice's first object in a column `first` (null: 0, where a whole tree begins).
    """
    ship(saves.sparkSession)
    names = ["source", "path", "node", "lineage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chars = [], 0

            def flush() -> pa.RecordBatch:
                columns = list(zip(*rows)) if rows else [()] * 4
                kinds = (pa.string(), pa.list_(pa.int32()), pa.string(), _LINEAGE)
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

            for source, value, first in zip(batch.column("source").to_pylist(), batch.column("save"), batch.column("first").to_pylist()):
                if not (written := value.as_py()):
                    continue
                for path, node, lineage in walk(json.loads(written), roots, children, states, first):
                    own = json.dumps({k: v for k, v in node.items() if k not in children}, ensure_ascii=False)
                    rows.append((source, path, own, lineage))
                    chars += len(own)
                    if len(rows) >= SENT_NODES or chars >= SENT_CHARS:
                        yield flush()
                        rows, chars = [], 0
            yield flush()

    first = F.coalesce(F.col("first").cast("int"), F.lit(0)) if "first" in saves.columns else F.lit(0)
    found = saves.select(F.col("source").cast("string").alias("source"), F.col(save).alias("save"), first.alias("first")).mapInArrow(run, NODES)
    named_ = F.filter("lineage", lambda a: a["name"].isNotNull())
    return found.select("source", "path", F.parse_json("node").alias("node"), F.transform(named_, lambda a: a["name"]).alias("ancestry"), (F.size("path") - 1).alias("depth"), "lineage")


def field(name: str, kind: str = "string") -> Column:
    """A field of the node."""
    return F.variant_get(F.col("node"), f"$.{name}", kind)


def named(nodes: DataFrame) -> DataFrame:
    """Nodes with the fields extractors ask for."""
    return nodes.select(
        "source", "path", "ancestry", "lineage", "node",
        field("GUID").alias("guid"), field("Name").alias("kind"), text(field("Nickname")).alias("nickname"), text(field("Description")).alias("description"),
        field("GMNotes").alias("notes"), field("LuaScript").alias("script"), F.array_sort(F.coalesce(field("Tags", "array<string>"), F.array().cast("array<string>"))).alias("tags"),
    )


def sprite_cell(nodes: DataFrame) -> DataFrame:
    """face, back, row and column of each card: CardID's hundreds name the deck (else the only one), the rest the cell; cells outside the grid go."""
    deck = "map<string, struct<FaceURL: string, BackURL: string, NumWidth: int, NumHeight: int>>"
    cards = nodes.select("*", field("CardID", "int").alias("_card"), F.from_json(F.to_json(F.variant_get("node", "$.CustomDeck", "variant")), deck).alias("_decks")).filter("_card IS NOT NULL")
    number = F.floor(F.col("_card") / 100).cast("string")
    one = F.coalesce(F.try_element_at("_decks", number), F.when(F.size("_decks") == 1, F.get(F.map_values("_decks"), F.lit(0))))
    cell = cards.withColumns({"_deck": one, "_cell": F.col("_card") % 100})
    out = cell.withColumns({"face": F.col("_deck.FaceURL"), "back": F.col("_deck.BackURL"), "row": F.floor(F.col("_cell") / F.col("_deck.NumWidth")).cast("int"), "col": (F.col("_cell") % F.col("_deck.NumWidth")).cast("int")})
    return out.filter(F.col("row") < F.col("_deck.NumHeight")).drop("_card", "_decks", "_deck", "_cell")


def nearest_ancestor(nodes: DataFrame, kind: str = "Bag") -> DataFrame:
    """Each node with the guid and name of its nearest ancestor of a kind that has a name."""
    up = F.filter("lineage", lambda a: (a["kind"] == kind) & a["name"].isNotNull())
    nearest = F.get(up, F.size(up) - 1)
    return nodes.withColumns({"ancestor_guid": nearest["guid"], "ancestor": nearest["name"]})


def any_depth(nodes: DataFrame, condition: Column) -> DataFrame:
    """Roots (source, place) below or at which a node meets the condition."""
    return nodes.filter(condition).select("source", F.get("path", F.lit(0)).alias("place")).distinct()


def near(c: Column, value: float, by: float = 0.001) -> Column:
    return F.abs(c - value) <= by


def urls(nodes: DataFrame, fields: dict[str, str], last: bool = True) -> DataFrame:
    """Each URL of the named fields once, with the lineage of its last (or first) bearer."""
    pairs = F.filter(F.array(*(F.struct(F.lit(k).alias("field"), field(p).alias("url")) for k, p in fields.items())), lambda x: x["url"].isNotNull() & (x["url"] != ""))
    rows = nodes.select("source", "path", "ancestry", F.inline(pairs))
    pick = F.max_by if last else F.min_by
    return rows.groupBy("url").agg(pick(F.struct("source", "field", "ancestry"), F.struct("source", "path")).alias("_r")).select("url", "_r.*")


def extracted(nodes: DataFrame, condition: Column, key: Column, identity: list[str], boxes: dict[str, str], default_box: str = "base") -> DataFrame:
    """A keyed multimap of an entity: its nodes by identity, copies, and copies per ancestry and per box (the first ancestor that names one)."""
    from stratafold.functions.text import first_mapped
    from stratafold.operators.aggregates import merged

    rows = nodes.filter(condition).withColumns({"key": key, "place": F.col("ancestry"), "box": F.coalesce(first_mapped(F.col("ancestry"), boxes), F.lit(default_box))})
    return merged(rows, ["key", *identity], "path", first=["nickname"], fill=["description"], unite=["tags"], place="place", box="box")


def guid_lists(scripts: DataFrame, script: str = "script") -> DataFrame:
    """(guid, ord, other, label) from a global script's table of guid lists: '["a"] = {"b", "c"}, --label'."""
    rows = scripts.select(F.posexplode(F.regexp_extract_all(script, F.lit(r'\["\w+"\]\s*=\s*\{[^{}]*\}[^\n]*'), 0)).alias("ord", "_row"))
    guid, label = F.regexp_extract("_row", r'^\["(\w+)"\]', 1), F.nullif(F.trim(F.regexp_extract("_row", r"--(.*)$", 1)), F.lit(""))
    return rows.select(guid.alias("guid"), "ord", F.explode(F.regexp_extract_all(F.regexp_extract("_row", r"\{([^{}]*)\}", 1), F.lit('"(\\w+)"'), 1)).alias("other"), label.alias("label"))
