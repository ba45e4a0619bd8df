import json

import pytest
from pyspark.sql import functions as F

from stratafold.operators import aggregates as ag
from stratafold.operators import derived, hierarchy, joins, layout, ordered, rules, tree
from stratafold.plans import target as tg
from stratafold.sources import json_documents, sinks, web

SECTION = "source string, ord long, id string, level int, title string, content string, tags array<string>"
TITLES = [("1", 1, "Intro"), ("2", 1, "Spells"), ("2.1", 2, "Fire"), ("2.1.1", 3, "Bolt"), ("2.2", 2, "Ice"), ("20", 1, "Other"), ("20.1", 2, "Fire")]


@pytest.fixture(scope="module")
def sections(spark):
    return spark.createDataFrame([("book", i, id_, level, title, f"text {title}", ["t"] if level > 1 else None) for i, (id_, level, title) in enumerate(TITLES)], SECTION)


def ids(df):
    return [r.id for r in df.orderBy("ord").collect()]


@pytest.mark.parametrize(
    "target, want",
    [
        (tg.All(), [t[0] for t in TITLES]),
        (tg.And(), []),
        (tg.Not(tg.And()), [t[0] for t in TITLES]),
        (tg.Leaf(title="^Fire$"), ["2.1", "20.1"]),
        (tg.ChildrenOf(tg.Leaf(title="^Spells$")), ["2.1", "2.1.1", "2.2"]),
        (tg.ChildrenOf(tg.ChildrenOf(tg.Leaf(title="^Spells$"))), ["2.1.1"]),
        (tg.And((tg.ChildrenOf(tg.Leaf(title="^Spells$")), tg.Not(tg.Leaf(title="Ice")))), ["2.1", "2.1.1"]),
        (tg.Not(tg.Leaf(doc="book")), []),
        (tg.Leaf(doc="other"), []),
        (tg.Leaf(tags=("t",), levels=(3,)), ["2.1.1"]),
        (tg.Or((tg.Leaf(id="1"), tg.Leaf(doc="other"))), ["1"]),
    ],
)
def test_selectors(sections, target, want):
    assert ids(tg.select(sections, target)) == want
    assert [r.id for r in tg.matching(sections, target).filter("matched").orderBy("ord").collect()] == want


def test_children_meet_by_an_equi_join(sections):
    plan = tg.select(sections, tg.ChildrenOf(tg.Leaf(title="^Spells$")))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_numbering(spark):
    levels = [1, 2, 4, 4, 3, 1, 3]
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate(levels)], "doc string, ord int, level int")
    got = [r.id for r in hierarchy.numbered(df, "doc", "ord").orderBy("ord").collect()]
    assert got == ["1", "1.1", "1.1.0.1", "1.1.0.2", "1.1.1", "2", "2.0.1"]


def test_heading_levels_and_paths(spark, sections):
    levels = lambda *c: spark.range(1).select(hierarchy.heading_levels(*c).alias("x")).first().x
    assert levels(F.array(*map(F.lit, [1, 3, 2, 3, 1]))) == [1, 2, 2, 3, 1]
    given = F.array(*(F.lit(x).cast("int") for x in (3, None, None, 1, None, 2, None)))
    assert levels(F.array(*map(F.lit, [30, 40, 35, 10, 40, 20, 15])), given) == [3, 4, 4, 1, 2, 2, 2]
    assert ids(hierarchy.heading_path(sections, ["Spells|Other", "Fire:"])) == ["2.1", "20.1"]


def test_rules_in_order(sections):
    out = rules.apply(sections, [rules.add_tag(tg.Leaf(title="Fire"), "hot", "t"), rules.replace_title(tg.Leaf(tags=("hot",)), "Flame"), rules.replace_text(tg.Leaf(title="Flame"), "text", "$& of"), rules.set_level(tg.Leaf(id="1"), 3)])
    by = {r.id: r for r in out.collect()}
    assert by["2.1"].title == "Flame" and by["2.1"].tags == ["t", "hot"] and by["20.1"].content == "text of Fire" and by["1"].level == 3
    assert rules.changed_rows(sections, out).first().changed == 3


def test_moving_an_image(spark):
    rows = [("b", 0, "1", 1, "A", "one ![](/images/z.png) two", None), ("b", 1, "2", 1, "B", "anchor here and anchor", None)]
    df = spark.createDataFrame(rows, SECTION)
    for before, want in ((True, "![](/images/z.png)\n\nanchor here and anchor"), (False, "anchor\n\n![](/images/z.png) here and anchor")):
        got = rules.move_image("b", "z", "anchor", before)(df).orderBy("ord").collect()
        assert got[1].content == want and "z.png" not in got[0].content
    assert rules.move_image("b", "none", "anchor", True)(df).exceptAll(df).count() == 0


def test_range_becomes_one_section(spark):
    df = spark.createDataFrame([("b", i, str(i + 1), 1 + i % 2, t, t, ["old"] if t == "from" else None) for i, t in enumerate(["a", "from", "x", "to", "z", "to"])], SECTION)
    at = lambda t: tg.Leaf(title=f"^{t}$")
    got = rules.replace_between(at("from"), at("to"), "Gap", ("gap", "more"), "filled")(df).orderBy("ord").collect()
    assert [(r.id, r.level, r.title, r.content, r.tags) for r in got] == [("1", 1, "a", "a", None), ("2", 2, "Gap", "filled", ["old", "gap", "more"]), ("5", 1, "z", "z", None), ("6", 2, "to", "to", None)]
    assert rules.replace_between(at("z"), at("from"), "Gap")(df).count() == 6
    inside = rules.replace_between(at("from"), at("to"), "Gap", target=tg.Not(at("to")))(df)
    assert inside.exceptAll(df).count() == 0 and inside.count() == 6
    later = rules.replace_between(at("from"), at("to"), "Gap", target=tg.Not(tg.Leaf(id="4")))(df).orderBy("ord").collect()
    assert [r.title for r in later] == ["a", "Gap"]
    assert rules.replace_between(at("x"), at("x"), "Gap")(df).filter("title = 'Gap'").first().content == ""


def test_footer_is_split_once(spark):
    df = spark.createDataFrame([("b", 0, "3", 1, "a", "x", None), ("b", 1, "3.1", 2, "last", "body\n\n![](/images/a.png)\n![](/images/b.png)", None)], SECTION)
    rule = rules.split_footer("Footer")
    once = rule(df)
    got = once.orderBy("ord").collect()
    assert [(r.id, r.level, r.title) for r in got][-1] == ("4", 1, "Footer") and got[1].content == "body"
    assert rule(once).exceptAll(once).count() == 0 and rule(once).count() == 3


def test_derived(sections):
    got = derived.flat(sections, tg.Leaf(levels=(2,)), with_children=True).orderBy("place").collect()
    assert [r.id for r in got] == ["2.1", "2.1.1", "20.1", "2.2"]
    aid = [derived.AidGroup("G", (derived.Pick(tg.Leaf(title="^Fire$"), True),)), derived.AidGroup("H", (derived.Pick(tg.ChildrenOf(tg.Leaf(title="^Spells$"))),))]
    rows = derived.player_aid(sections, aid).orderBy("place").collect()
    assert [(r.level, r.title) for r in rows] == [(1, "G"), (2, "Fire"), (3, "Bolt"), (2, "Fire"), (1, "H"), (2, "Ice")]
    assert [tuple(rows[i][1:4]) + (rows[i].tags,) for i in (0, 4)] == [("player-aid", None, "1", ["syntheticHeader"]), ("player-aid", None, "2", ["syntheticHeader"])]


def test_a_section_keeps_the_place_that_brought_it_first(spark):
    """A nested match is first met as a child of the match before it."""
    df = spark.createDataFrame([("b", i, id_, level, title, "", None) for i, (id_, level, title) in enumerate([("1", 1, "A"), ("1.1", 2, "A sub"), ("1.1.1", 3, "leaf"), ("2", 1, "Z")])], SECTION)
    pick = derived.Pick(tg.Leaf(title="^A"), True)
    rows = derived.player_aid(df, [derived.AidGroup("G", (derived.Pick(tg.Leaf(title="^Z")), pick))], "aid").orderBy("place").collect()
    assert [(r.level, r.title, r.source) for r in rows] == [(1, "G", "aid"), (2, "Z", "b"), (2, "A", "b"), (3, "A sub", "b"), (4, "leaf", "b")]


def test_derived_sorts(sections):
    by_source = derived.flat(sections, tg.Leaf(levels=(2,)), sort="source").orderBy("place").collect()
    assert [r.title for r in by_source] == ["Fire", "Fire", "Ice"]
    got = derived.grouped(sections, [derived.Group(tg.Leaf(title="^Intro$"), tg.Leaf(levels=(2,))), derived.Group(tg.Leaf(title="^no$"), tg.All())]).orderBy("place").collect()
    assert [(r.level, r.title) for r in got] == [(1, "Intro"), (2, "Fire"), (2, "Fire"), (2, "Ice")]


def test_places_are_those_of_one_sort(spark):
    """Over ranges, whatever their number, with ties, nulls and an empty table."""
    df = spark.range(500).selectExpr("CASE WHEN id % 7 > 0 THEN id % 11 END AS a", "id AS b")
    order = [F.col("a").desc_nulls_last(), "b"]
    got = [r.b for r in ordered.placed(df, order).orderBy("place").collect()]
    assert got == [r.b for r in df.orderBy(*order).collect()]
    assert sorted(r.place for r in ordered.placed(df, order).collect()) == list(range(1, 501))
    assert ordered.placed(df.limit(0), order).count() == 0
    plan = ordered.placed(df, order)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_merging_copies(spark):
    df = spark.createDataFrame([("k", 2, "b", None, ["y"], "box2"), ("k", 1, "a", "first", ["x", "y"], "box1"), ("k", 3, "c", "later", [], "box2")], "key string, ord int, name string, note string, tags array<string>, box string")
    r = ag.merged(df, ["key"], "ord", first=["name"], fill=["note"], unite=["tags"], place="box").first()
    assert (r.copies, r.name, r.note, r.tags) == (3, "a", "first", ["x", "y"])
    assert [(x.value, x["count"]) for x in r.locations] == [("box1", 1), ("box2", 2)]


def test_cascade(spark):
    index = spark.createDataFrame([("Sword", 1), ("SWORD", 2), ("Axe", 3), ("shield", 4), ("SHIELD", 5)], "name string, row int")
    aliases = spark.createDataFrame([("Blade", "Axe", 1), ("Blade", "Sword", 0), ("Nope", "Missing", 0)], "alias string, target string, ord int")
    names = spark.createDataFrame([("Sword",), ("Shield",), ("Blade",), ("Nope",)], "name string")
    got = sorted((r.name, r.match_rank, r.row) for r in joins.cascade(names, index, aliases).collect())
    assert got == [("Blade", 3, 1), ("Blade", 3, 3), ("Shield", 2, 4), ("Shield", 2, 5), ("Sword", 1, 1)]


def test_cascade_compares_titles_as_titles(spark):
    index = spark.createDataFrame([("Fire Bolt", 1), ("Adventurers Kit", 2), ("Coin of A", 3), ("Coin of B", 4)], "name string, row int")
    aliases = spark.createDataFrame([("Flame’s Dart", "fire bolt", 0), ("Coins", "nowhere", 0)], "alias string, target string, ord int")
    names = spark.createDataFrame([("Flames Dart",), ("Adventurer's Kit",), ("Coin",), ("Coins",), ("fire BOLT",)], "name string")
    got = sorted((r.name, r.match_rank, r.row) for r in joins.cascade(names, index, aliases, categories={"Coin": "Coin of ", "Coins": "Coin of "}).collect())
    assert got == [("Adventurer's Kit", 1, 2), ("Coin", 4, 3), ("Coin", 4, 4), ("Flames Dart", 3, 1), ("fire BOLT", 2, 1)]


def test_casters(spark):
    spells = spark.createDataFrame([("Bolt", "back", 0, "Goblins of Rust"), ("Bolt", "front", 1, "Goblin"), ("Bolt", "front", 0, "Imp"), ("Hex", "front", 0, "Imps Lord"), ("Hex", "back", 0, "Wolves")], "spell string, side string, ord int, caster string")
    groups = spark.createDataFrame([("Goblins", ["Imp"]), ("wolf", []), ("Wolf", ["Imps"])], "group string, chips array<string>")
    got = {(r.group, r.spell): (r.sides, r.casters) for r in joins.casters(spells, groups).collect()}
    assert got == {("Goblins", "Bolt"): (["front", "back"], ["Imp", "Goblin", "Goblins of Rust"]), ("Wolf", "Bolt"): (["front"], ["Imp"]), ("Wolf", "Hex"): (["back"], ["Wolves"])}


def test_strict_join_fails_on_a_miss(spark):
    left, right = spark.createDataFrame([("a",), ("z",)], "k string"), spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(Exception, match="unknown key: z"):
        joins.strict(left, right, "k").collect()


def test_fuzzy_names_and_prefixes(spark):
    groups = spark.createDataFrame([("wolf", 1), ("giant spider", 2)], "grp string, pr int")
    asked = spark.createDataFrame([("wolves",), ("giant spiders den",), ("wolfhound",), ("giant spider queen",)], "name string")
    got = {r.name: r.grp for r in joins.fuzzy_names(asked, groups, "name", "grp", "pr").collect()}
    assert got == {"wolves": "wolf", "giant spiders den": "giant spider", "giant spider queen": "giant spider"}
    titles = spark.createDataFrame([("Fire Bolt",), ("Firefly",), ("Fire",)], "title string")
    forms = spark.createDataFrame([("Fire",)], "form string")
    assert sorted(r.title for r in joins.title_or_prefix(forms, titles, "form").collect()) == ["Fire", "Fire Bolt"]


def test_board_layouts(spark):
    boards = spark.createDataFrame([(1, ["b", "a", "c"]), (2, ["a", "a"])], "id int, items array<string>")
    layouts = spark.createDataFrame([([["a", "b"], ["c"]],)], "rows array<array<string>>")
    got = {r.id: r.p for r in joins.layout_match(boards, layouts).select("id", joins.position_in(F.col("rows"), F.lit("c")).alias("p")).collect()}
    assert tuple(got[1]) == (1, 0) and got[2] is None


SAVE = {
    "ObjectStates": [
        {"Name": "Bag", "GUID": "g1", "Nickname": " Box ", "ContainedObjects": [
            {"Name": "Card", "GUID": "c1", "Nickname": "Ace", "CardID": 90508, "Tags": ["z", "a"], "CustomDeck": {"905": {"FaceURL": "f", "BackURL": "b", "NumWidth": 10, "NumHeight": 7}}},
            {"Name": "Bag", "GUID": "g2", "Nickname": "", "ContainedObjects": [{"Name": "Card", "GUID": "c2", "Nickname": "Ace", "CardID": 171, "CustomDeck": {"9": {"FaceURL": "f", "BackURL": "b", "NumWidth": 10, "NumHeight": 7}}}]},
        ]},
        {"Name": "Card", "GUID": "c3", "Nickname": "Ace", "CardID": 205, "CustomDeck": {"2": {"FaceURL": "f", "BackURL": "b", "NumWidth": 2, "NumHeight": 2}}, "States": {"2": {"Name": "Tile", "GUID": "s"}}},
    ]
}


def test_trees(spark):
    saves = spark.createDataFrame([("s", json.dumps(SAVE))], "source string, save string")
    nodes = tree.named(tree.flatten(saves))
    by = {r.guid: r for r in nodes.drop("node").collect()}
    assert sorted(by) == ["c1", "c2", "c3", "g1", "g2"] and by["c2"].ancestry == ["Box"] and by["c1"].tags == ["a", "z"] and by["g1"].nickname == "Box"
    assert {r.guid for r in tree.named(tree.flatten(saves, states=True)).select("guid").collect()} == {*by, "s"}
    cells = {r.guid: (r.row, r.col) for r in tree.sprite_cell(nodes).select("guid", "row", "col").collect()}
    assert cells == {"c1": (0, 8)}
    near = {r.guid: r.ancestor_guid for r in tree.nearest_ancestor(nodes).select("guid", "ancestor_guid").collect()}
    assert near["c2"] == "g1" and near["c3"] is None
    out = tree.extracted(nodes, F.col("kind") == "Card", F.col("nickname"), ["kind"], {"Box": "box one"}).first()
    assert out.copies == 3 and [(b.value, b["count"]) for b in out.boxes] == [("box one", 2), ("base", 1)]
    assert [r.place for r in tree.any_depth(nodes, F.col("guid") == "c2").collect()] == [0]


def test_a_deep_and_a_wide_tree(spark):
    """No level, row or recursion limit; paths, ancestors and alternate states stay right."""
    leaf = {"Name": "Card", "GUID": "leaf", "Nickname": "end"}
    for i in range(300):
        leaf = {"Name": "Bag", "GUID": f"g{i}", "Nickname": "" if i == 0 else f"n{i}", "ContainedObjects": [leaf], "States": {"2": {"Name": "Tile", "GUID": f"s{i}"}}}
    wide = {"Name": "Bag", "GUID": "w", "Nickname": "Wide", "ContainedObjects": [{"Name": "Card", "GUID": f"c{i}"} for i in range(30_000)]}
    saves = spark.createDataFrame([("deep", json.dumps({"ObjectStates": [leaf]})), ("wide", json.dumps({"ObjectStates": [wide]})), ("none", None), ("empty", "{}"), ("list", "[1]"), ("bare", json.dumps({"ObjectStates": [None, {"Nickname": 5, "ContainedObjects": None}]}))], "source string, save string")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "1000")
    nodes = tree.nearest_ancestor(tree.named(tree.flatten(saves)))
    count = {r.source: r["count"] for r in nodes.groupBy("source").count().collect()}
    assert count == {"deep": 301, "wide": 30_001, "bare": 1}
    last = nodes.filter("guid = 'leaf'").first()
    assert len(last.path) == 301 and last.ancestor_guid == "g1" and last.ancestry == [f"n{i}" for i in range(299, 0, -1)]
    assert nodes.filter("ancestor = 'Wide'").count() == 30_000
    states = tree.named(tree.flatten(saves, states=True)).filter("source = 'deep'")
    assert states.count() == 601 and [r.path for r in states.filter("guid = 's299'").collect()] == [[0, 1]]


def test_guid_lists(spark):
    df = spark.createDataFrame([('x\n["ab1"] = {"c", "d"}, --The Label\n["e"] = {}',)], "script string")
    got = [(r.guid, r.other, r.label) for r in tree.guid_lists(df).collect()]
    assert got == [("ab1", "c", "The Label"), ("ab1", "d", "The Label")]


def test_layout(spark):
    row = spark.range(1)
    pack = lambda ws, room=100.0: row.select(ordered.packed_rows(F.array(*map(F.lit, ws)).cast("array<double>"), *map(F.lit, (room, 10.0, 5.0, 2.0))).alias("x")).first().x
    got = pack([20.0, 20.0, 20.0, 30.0, 500.0])
    assert [r.row for r in got] == [0, 0, 1, 1, 2]
    assert [round(r.width, 3) for r in got] == [34.0, 34.0, 27.2, 40.8, 85.0]
    assert pack([]) == [] and pack([5.0], 0.0) == []
    h = row.select(layout.hsv(F.lit(255), F.lit(0), F.lit(255)).alias("x")).first().x
    assert (round(h.h, 4), h.s, h.v) == (0.8333, 1, 1)
    assert row.select(layout.joined_lines(F.array(F.lit("well-"), F.lit("known fact"))).alias("x")).first().x == "well-known fact"
    spans = spark.createDataFrame([(1, 0, "b", "He"), (1, 1, "b", "llo"), (1, 2, "i", "x"), (1, 3, "b", "y")], "line int, ord int, font string, t string")
    assert [r.t for r in layout.merged_spans(spans, ["line"], "ord", ["font"], "t").orderBy("ord").collect()] == ["Hello", "x", "y"]
    images = spark.createDataFrame([(1, 1, 0.0, 30.0)], "page int, image int, y0 double, y1 double")
    lines = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 10.0, 28.0), (2, 3, 0.0, 30.0)], "page int, line int, y0 double, y1 double")
    assert layout.best_overlap(images, lines).first().line == 2
    assert row.select(layout.heading_level(F.lit("B"), F.lit(18.5), F.lit("red"), [("B", 18, "red", 1)]).alias("x")).first().x == 1


def test_an_image_without_height_has_the_line_it_lies_inside_of(spark):
    images = spark.createDataFrame([(1, 1, 49.0, 49.0), (1, 2, 60.0, 60.0), (1, 3, 20.0, 120.0)], "page int, image int, y0 double, y1 double")
    lines = spark.createDataFrame([(1, 1, 0.0, 30.0), (1, 2, 40.0, 60.0), (1, 3, 45.0, 50.0), (2, 4, 40.0, 90.0), (1, 5, 30.0, 110.0)], "page int, line int, y0 double, y1 double")
    assert sorted((r.image, r.line) for r in layout.best_overlap(images, lines).collect()) == [(1, 2), (2, 5), (3, 5)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"version": "1", "content": [{"id": "1", "source": "core", "level": 1, "title": "T", "content": "c"}, {"id": "2", "level": 1, "title": "U"}]}))
    (tmp_path / "bad.json").write_text('{"x": ')
    (tmp_path / "index.json").write_text(json.dumps({"b": [{"n": 1}, {"n": 2}], "a": [{"n": 3}]}))
    docs = json_documents.documents(spark, str(tmp_path / "a.json"))
    assert [(r.doc, r.ord, r.id) for r in docs.collect()] == [("core", 0, "1"), ("core", 1, "2")]
    assert json_documents.json_or_empty(spark, str(tmp_path / "none.json"), "x int").count() == 0
    assert json_documents.json_or_empty(spark, str(tmp_path / "bad.json"), "x int").count() == 0
    assert [(r.key, r.n) for r in json_documents.keyed_index(spark, str(tmp_path / "index.json"), "n: int").orderBy("k", "ord").collect()] == [("b", 1), ("b", 2), ("a", 3)]
    assert json_documents.save_files(spark, str(tmp_path / "a.json")).first().source == "a"
    assert json_documents.newest_file(spark, str(tmp_path)).first().length > 0


def test_links_and_names(spark):
    page = '<img src="a/x.png"><a href="/y.jpg?z=1">t</a><img src="a/x.png"><div style="background-image:url(//c.d/q.gif)"><a href="p.html">'
    df = spark.createDataFrame([(1, "http://h.com/d/e.html", page)], "id int, url string, html string")
    assert {r.image for r in web.image_links(df, "id", "url", "html").collect()} == {"http://h.com/d/a/x.png", "http://h.com/y.jpg?z=1", "http://c.d/q.gif"}
    names = spark.createDataFrame([("f.png", 1), ("f.png", 2), ("g.png", 3)], "name string, ord int")
    assert sorted(r.name for r in web.unique_names(names, "name", ["ord"]).collect()) == ["f-2.png", "f.png", "g.png"]


def test_number_literals(spark):
    base = spark.createDataFrame([('{"posX": 1.50, "n": [1, 2.0], "s": "3"}',)], "t string").select(F.explode(sinks.number_tokens("t")).alias("e")).select("e.*")
    assert sorted(map(tuple, base.collect())) == [("n.0", "1"), ("n.1", "2.0"), ("posX", "1.50")]
    new = spark.createDataFrame([("posX", 1.500001), ("n.0", 1.0), ("n.1", 5.0), ("posY", 2.0), ("f", 0.10000000149011612), ("d", 0.1), ("big", 12345678848.0)], "path string, value double")
    assert {r.path: r.text for r in sinks.kept_literals(new, [base]).collect()} == {"posX": "1.50", "n.0": "1", "n.1": "5", "posY": "2.0", "f": "0.1", "d": "0.1", "big": "12345679000"}


def test_tables_of_a_scratch_go_but_the_kept_one(spark):
    from stratafold import session

    with session.scratch(spark) as keep:
        inner = session.saved(spark.range(3))
        kept = keep(inner.filter("id > 0"))
    assert kept.count() == 2 and session.saved(spark.range(1)).count() == 1
    with pytest.raises(Exception):
        spark.read.parquet(inner._stratafold_path)
    session.dropped(kept)
    with pytest.raises(Exception):
        spark.read.parquet(kept._stratafold_path)


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from stratafold import session

    far = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077"), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(far)


def test_references_by_slug_or_name(spark):
    known = spark.createDataFrame([("red-mage", "Red Mage", "Mage of Red"), ("red-mage", "Red Mage", "Second"), ("x", "Wizard’s Aid", "Aid")], "slug string, name string, title string")
    asked = spark.createDataFrame([("Red mage!",), ("Wizards Aid",), ("Old Name",), ("Nobody",)], "reference string")
    got = sorted((r.reference, r.title) for r in joins.titled(asked, known, "reference", {"old-name": "red-mage"}).collect())
    assert got == [("Nobody", "Nobody"), ("Old Name", "Mage of Red"), ("Old Name", "Second"), ("Red mage!", "Mage of Red"), ("Red mage!", "Second"), ("Wizards Aid", "Aid")]
    one = ordered.by_parameter(asked, "reference", "Old Name").collect(), ordered.by_parameter(asked, "reference", "?").collect()
    assert [[r.reference for r in x] for x in one] == [["Old Name"], ["Nobody"]]


def test_streamed_rules(spark, sections, tmp_path):
    from stratafold.streaming import sections as stream

    sections.write.parquet(str(tmp_path / "in"))
    stream.rewrite(stream.arriving(spark, str(tmp_path / "in")), [rules.add_tag(tg.Leaf(title="Fire"), "hot")], str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("array_contains(tags, 'hot')").count() == 2


def test_entry_works_without_the_llm_parts(monkeypatch):
    import sys

    import __spark_entry__

    for gone in ("corpus_pipeline", "stratafold.llm"):
        with monkeypatch.context() as m:
            for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("stratafold.llm")]:
                m.delitem(sys.modules, name)
            m.setitem(sys.modules, gone, None)
            names = __spark_entry__.queries()
            assert "derived_grouped" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
            assert set(__spark_entry__.oracle_sql()) <= set(names)
