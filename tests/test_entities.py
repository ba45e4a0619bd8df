import json

from pyspark.sql import functions as F

from stratafold.operators import entities as en
from stratafold.operators import pages, tree


def nodes_of(spark, *objects, states=False):
    return tree.named(tree.flatten(spark.createDataFrame([("s", json.dumps({"ObjectStates": list(objects)}))], "source string, save string"), states=states))


def bag(name, *inside, guid="b"):
    return {"Name": "Bag", "GUID": guid, "Nickname": name, "ContainedObjects": list(inside)}


def tile(guid, name=None, front=None, back=None, **more):
    return {"Name": "Custom_Tile", "GUID": guid, "Nickname": name, "CustomImage": {"ImageURL": front, "ImageSecondaryURL": back, "CustomTile": {"Type": 1}}, **more}


def test_chips_count_copies_per_place(spark):
    chip = lambda g: tile(g, "x", "f", "k", GMNotes=" Wolf’s Den ", LuaScript="-- chip\nz")
    rows = en.chips(nodes_of(spark, bag("Forest", chip("1"), chip("2")), chip("3"), tile("4", LuaScript="other")), "-- chip", {"Forest": "wild"}).collect()
    assert len(rows) == 1 and rows[0].key == "Wolfs Den" and rows[0].copies == 3
    assert [(x.value, x["count"]) for x in rows[0].boxes] == [("wild", 2), ("base", 1)] and [(x.value, x["count"]) for x in rows[0].locations] == [(["Forest"], 2), ([], 1)]
    assert en.chips(nodes_of(spark, tile("5", "x", None, "k", GMNotes="n", LuaScript="-- chip"), tile("6", "x", " ", "k", GMNotes="n", LuaScript="-- chip")), "-- chip", {}).count() == 0


def test_unmarked_chips_are_known_by_container_or_group(spark):
    plain = lambda name=None, notes="AdultDragons", back="k": tile("g", name, "f", back, GMNotes=notes, LuaScript="function onLoad() end")
    count = lambda *objects, known=(): sorted((r.key, r.copies) for r in en.chips(nodes_of(spark, *objects), "chipName =", {}, known=known).collect())
    assert count(bag("Hills Chips", plain("named"))) == [("AdultDragons", 1)]
    assert count(bag("Adult Dragons", plain(), plain())) == [("AdultDragons", 2)]
    assert count(bag("Adult Dragons", plain("named")), bag("Chipshop", plain()), bag("Chips", plain(back=None)), bag("Chips", plain(notes=" "))) == []
    assert count(plain(notes="wardens")) == [] and count(plain(notes="wardens", back=None), known=("Wardens",)) == [("wardens", 1)]
    assert count(bag("Chips", {"Name": "Custom_Tile", "GMNotes": "n", "LuaScript": "chipName ="})) == []


def test_natives_of_a_location_come_from_the_first_script_that_has_the_group(spark):
    chip = lambda guid, notes: tile(guid, None, f"f{guid}", "k", GMNotes=notes, LuaScript="chipName = 1")
    fetch = 'function setupCamp(clearing, rotation)\n leader = getObjectFromGUID("00000a")\n a1 = getObjectFromGUID("00000b")\n again = getObjectFromGUID("00000a")\n no = getObjectFromGUID("0000ff")\nend\nfunction other()\n z = getObjectFromGUID("00000c")\nend'
    summon = 'function summonNatives()\n x = { group = "hunters" }, { group = "nobody" }\nend'
    script = 'nativeGroups = {\n hunters = {\n  "00000a", -- leader\n  "00000c", -- Big2\n },\n strangers = {\n "00000b", -- x\n },\n}\nNatives = {\n ["0000aa"] = {\n  { group = "hunters" },\n  -- { group = "wardens" },\n }, -- Ford\n}\n'
    nodes = nodes_of(spark, chip("00000a", "hunters"), chip("00000b", "wardens"), chip("00000c", "hunters"), tile("1", "Camp", LuaScript=fetch), tile("2", "Ford", LuaScript=summon), tile("3", "Hill", LuaScript=summon))
    scripts = spark.createDataFrame([("s", script), ("t", None)], "source string, script string")
    rows = en.native_summons(nodes, scripts, en.chip_tiles(nodes, "chipName ="), ("Hunters",), {"Hunters": "Hunter"}).orderBy("location", "group", "ord").collect()
    both = [("Hunters", "Hunter Leader", "f00000a"), ("Hunters", "Big 2", "f00000c")]
    want = {"Camp": [("Hunters", "Hunter Leader", "f00000a"), ("Wardens", "A 1", "f00000b")], "Ford": both, "Hill": both, "Native Setup": both}
    assert {k: [(r.group, r.name, r.image) for r in rows if r.location == k] for k in {r.location for r in rows}} == want


PLACES = "source string, path array<int>, ancestry array<string>, lineage array<struct<kind: string, guid: string, name: string>>, guid string, kind string, nickname string, description string, notes string, script string, tags array<string>"


def test_places_order_as_numbers_and_ancestors_one_by_one(spark):
    row = lambda place, name, ancestry: ("s", [0, place], ancestry, [], "g", "Custom_Tile", name, f"about {name}", "N", "-- chip", [])
    rows = [row(1_000_001, "last", ["a / b"]), row(999_999, "first", ["a", "b"]), row(1_000_000, "middle", ["a / b"])]
    nodes = spark.createDataFrame(rows, PLACES).withColumn("node", F.parse_json(F.lit('{"CustomImage": {"ImageURL": "f"}}')))
    (chip,) = en.chips(nodes, "-- chip", {}).collect()
    assert (chip.nickname, chip.description) == ("first", "about first") and [(x.value, x["count"]) for x in chip.locations] == [(["a", "b"], 1), (["a / b"], 2)]
    (one,) = tree.extracted(nodes, F.lit(True), F.col("notes"), ["guid"], {}).collect()
    assert (one.nickname, one.description) == ("first", "about first") and [(x.value, x["count"]) for x in one.locations] == [(["a", "b"], 1), (["a / b"], 2)]
    lists = spark.createDataFrame([("s", 0, "g", "L")], "guid string, ord int, other string, label string")
    assert [r.name for r in en.by_guid(lists, nodes, False).collect()] == ["last"]


def test_sites_by_face(spark):
    faces = spark.createDataFrame([("f", "site", True, None), ("g", "civ", False, 0.5)], "face string, kind string, both boolean, scale double")
    rows = nodes_of(spark, tile("1", "A", "f", "f"), tile("2", "B", "f", "z"), tile("3", "C", "g", "z", Transform={"scaleX": 0.5}), tile("4", "D", "g", "z", Transform={"scaleX": 0.7}), tile("5", "A", "f", "f"))
    assert sorted(r.nickname for r in en.faced(rows, faces).collect()) == ["A", "A", "C"]


def test_tokens_by_url_or_last_segment(spark):
    dim = spark.createDataFrame([("http://a/x", "Hills"), ("http://a/y", "Woods")], "url string, terrain string")
    rows = nodes_of(spark, tile("1", "N1", "i", "http://a/x"), tile("2", "N2", "i", "http://other/x"), tile("3", "N3", "j", "http://b/y"), tile("4", "N4", "j", "http://b/none"))
    got = {(r.terrain, r.image): (r.copies, r.names) for r in en.tokens(rows, dim).collect()}
    assert got == {("Hills", "i"): (2, ["N1", "N2"]), ("Woods", "j"): (1, ["N3"])}


def test_boards(spark):
    script = 'merchant = "Zed"\nmerchant = "Abe"'
    first = {"Name": "Board", "GUID": "1", "Nickname": "North", "Tags": ["side1"], "LuaScript": script, "CustomImage": {"ImageURL": ""}, "States": {"2": {"CustomImage": {"ImageURL": "two"}}}}
    second = {"Name": "Board", "GUID": "2", "Nickname": "South", "Tags": ["side2"], "GMNotes": "Inn, Mill"}
    empty = {"Name": "Board", "GUID": "3", "Nickname": "None", "Tags": ["side1"]}
    got = {r.guid: (r.merchants, r.sites, r.image) for r in en.boards(nodes_of(spark, first, second, empty), {"North": ["Fort"]}).collect()}
    assert got == {"1": (["Abe", "Zed"], ["Fort"], "two"), "2": ([], ["Inn", "Mill"], None)}


def test_map_tiles(spark):
    script = '["t1"]={ {1,2,3}, {0.5,-1,2}, }, -- Hollow\n["t2"]={ {1,1,1}, {1,1,1}, {1,1,1}, {1,1,1} }, -- Town\n["t9"]={ }, -- Nowhere'
    scripts = spark.createDataFrame([(script,)], "script string")
    rows = en.map_tiles(nodes_of(spark, bag("Hills", tile("t1"), tile("t2", "City")), tile("t9")), scripts).collect()
    got = {r.guid: (r.terrain, r.name, r.points, r.kind) for r in rows}
    assert got["t1"] == ("Hills", "Hollow", [[1, 2, 3], [0.5, -1, 2]], "Wilderness") and got["t2"][1::2] == ("City", "Civilisation") and set(got) == {"t1", "t2"}


def test_precedence_of_monsters_and_natives(spark):
    make = lambda rows: spark.createDataFrame(rows, "site string, monster string")
    got = en.monsters(make([("a", "local"), ("b", "local")]), make([("a", "world"), ("c", "world")]), make([("b", "fixed")])).collect()
    assert sorted(map(tuple, got)) == [("a", "local"), ("b", "fixed"), ("c", "world")]
    rows = lambda v: spark.createDataFrame(v, "location string, `group` string, ord int, v string")
    got = en.natives([rows([("x", "g", 2, "late"), ("x", "g", 1, "first")]), rows([("x", "g", 0, "other"), ("y", "g", 0, "only")])]).collect()
    assert sorted((r.location, r.v) for r in got) == [("x", "first"), ("y", "only")]
    tiles = spark.createDataFrame([("t", "one", "Wilderness", ["lair"]), ("t", "two", "Wilderness", ["lair"]), ("t", "city", "Civilisation", ["lair"])], "terrain string, name string, kind string, tags array<string>")
    scripted, table = spark.createDataFrame([("one", "wolf")], "name string, monster string"), spark.createDataFrame([("t", "lair", "bear")], "terrain string, feature string, monster string")
    assert sorted((r.name, r.monster) for r in en.tile_monsters(tiles, scripted, table).collect()) == [("one", "wolf"), ("two", "bear")]


def test_guids_last_wins_and_missing_keep_labels(spark):
    nodes = nodes_of(spark, tile("g", "Old"), tile("g", "New"))
    lists = spark.createDataFrame([("s", 0, "g", "L1"), ("s", 1, "none", "L2")], "guid string, ord int, other string, label string")
    assert [r.name for r in en.by_guid(lists, nodes, False).collect()] == ["New"]
    assert sorted(r.name for r in en.by_guid(lists, nodes, True).collect()) == ["L2", "New"]


def test_specialists_and_legends(spark):
    df = spark.createDataFrame([(["Specialists"], "b", "Ann (Swift)", "Costs 12 gold or 3 gold"), (["Specialists"], "b", "Bob", None), (["Other"], "b", "Cy", None)], "ancestry array<string>, back string, nickname string, description string")
    got = {r.name: (r.attribute, r.prices) for r in en.specialists(df, "b").collect()}
    assert got == {"Ann": ("Swift", [12, 3]), "Bob": (None, None)}
    places, cards = spark.createDataFrame([("p", "Crown"), ("q", "Lost")], "name string, treasure string"), spark.createDataFrame([("Crown", 2, "f2"), ("Crown", 1, "f1")], "name string, ord int, face string")
    assert {r.name: tuple(r.treasure) for r in en.legendary(places, cards).collect()} == {"p": ("Crown", "f1"), "q": ("Lost", None)}


def test_small_projections(spark):
    row = spark.range(1)
    one = lambda c: row.select(c.alias("x")).first().x
    assert one(en.magic_colours(F.array(F.lit("redMagic"), F.lit("spell")))) == ["red"]
    assert one(en.reward_labels(F.create_map(F.lit("Foot"), F.lit(2), F.lit("Cube"), F.lit(1), F.lit("None"), F.lit(0)), {"Foot": "Feet"})) == ["+1 Cube", "+2 Feet"]
    cube = lambda t, n, c: F.struct(F.lit(t).alias("type"), F.lit(n).alias("name"), F.lit(c).alias("count"))
    cubes = F.array(cube("Item", "red", 1), cube("Spell", "red", 2), cube("Spell", "blue", 1), cube("Item", "grey", 1))
    choose = lambda text: [tuple(r) for r in one(en.with_choices(cubes, F.lit(text)))]
    assert choose("Choose One Red or One Blue Cube") == [("Item", "red", 1), ("Spell", "red", 1), ("Item", "grey", 1), ("Spell", "red|blue", 1)]
    assert choose("choose one grey or one pink cube; Choose  One Grey or One White Cube") == [("Item", "red", 1), ("Spell", "red", 2), ("Spell", "blue", 1), ("Item", "grey|pink", 1), ("Spell", "grey|white", 1)]
    same = [("Item", "red", 1), ("Spell", "red", 2), ("Spell", "blue", 1), ("Item", "grey", 1)]
    assert choose("Choose 2 Coloured Magic Cubes, then Choose 1 Colored magic cube") == [*same, ("Spell", "any", 2), ("Spell", "any", 1)]
    assert choose("Choose 2 Coloured") == same == choose(None)
    assert [tuple(r) for r in one(en.header_rows((F.lit(True), "a", F.lit("1")), (F.lit(False), "b", F.lit("2"))))] == [("a", "1")]
    deck = en.deck_of(F.lit("u"), {"u": "deep"}, F.lit("box"), F.lit("Crown"), ("deep", "legendary", "box", frozenset({"Crown"})))
    assert one(deck) == "legendary"
    hsv = lambda h, s, v: F.struct(F.lit(h).alias("h"), F.lit(s).alias("s"), F.lit(v).alias("v"))
    samples = [("red", (0.98, 0.9, 0.5)), ("green", (0.3, 0.9, 0.5))]
    assert [one(en.clearing_type(hsv(*c), samples)) for c in ((0.02, 0.8, 0.5), (0.5, 0.1, 0.9), (0.5, 0.1, 0.2), (0.35, 0.9, 0.5))] == ["red", "river", "caves", "green"]
    assert one(en.live_lines(F.lit("a\n -- b\nc"))) == "a\nc"
    points = {"AttachedSnapPoints": [{"Position": {"x": 2, "y": 0, "z": 1}}, {"Position": {"x": 1, "y": 0, "z": 5}}, {"Position": {"x": 1, "y": 0, "z": "no"}}]}
    got = nodes_of(spark, {"Name": "B", "GUID": "1", **points}).select(en.snap_points().alias("x")).first().x
    assert [(p.x, p.z) for p in got] == [(1, 5), (2, 1)]


LINES = "doc string, page int, col int, ord int, block int, kind string, text string, level int"


def test_figures_find_their_heading(spark):
    rows = [
        ("d", 1, 0, 0, 0, "text", "Intro", 1), ("d", 1, 0, 1, 1, "text", "first line of well-", None), ("d", 1, 0, 2, 1, "text", "known words", None), ("d", 1, 0, 3, 2, "image", "tail", None),
        ("d", 1, 1, 4, 3, "image", "lead", None), ("d", 1, 1, 5, 4, "text", "Next", 2), ("d", 1, 1, 6, 5, "bullet", "one", None), ("d", 1, 1, 7, 5, "bullet", "two", None),
        ("d", 2, 0, 8, 6, "image", "still", None), ("d", 2, 0, 9, 7, "text", "more text", None), ("d", 2, 1, 10, 8, "image", "alone", None), ("d", 3, 0, 11, 9, "text", "Deep", 4),
    ]
    got = pages.sections_of(spark.createDataFrame(rows, LINES)).orderBy("ord").collect()
    assert [(r.id, r.level, r.title) for r in got] == [("1", 1, "Intro"), ("1.1", 2, "Next"), ("1.1.0.1", 4, "Deep")]
    assert got[0].content == "first line of well-known words\n\n![](/images/tail.png)"
    assert got[1].content == "![](/images/lead.png)\n\n- one\n- two\n\n![](/images/still.png)\n\nmore text\n\n![](/images/alone.png)"


def test_emphasis_and_figures(spark):
    row = spark.range(1)
    assert row.select(pages.emphasis(F.lit(" a b "), F.lit(True), F.lit(True)).alias("x")).first().x == " ***a b*** "
    sections = spark.createDataFrame([("d", "T", 1, 0), ("d", "T", 3, 5)], "doc string, title string, page int, ord int")
    figures = spark.createDataFrame([("d", 3, "T", "sum", "a summon"), ("d", 9, "T", "x", "x")], "doc string, page int, title string, expected string, found string")
    assert {r.page: r.ord for r in pages.annotated(sections, figures).collect()} == {3: 5, 9: 0}


def test_a_tree_in_pieces_is_the_whole_tree(spark):
    bag = lambda *guids: json.dumps({"ObjectStates": [{"Name": "Bag", "GUID": "b", "Nickname": "Box", "ContainedObjects": [{"GUID": g, "States": {"2": {"GUID": f"{g}2"}}} for g in guids]}]})
    rows = lambda df: sorted((r.source, list(r.path), r.guid, list(r.ancestry), r.depth) for r in tree.flatten(df, states=True).withColumn("guid", tree.field("GUID")).collect())
    whole = rows(spark.createDataFrame([("s", bag(*"vwxyz"))], "source string, save string"))
    pieces = rows(spark.createDataFrame([("s", 4, bag("z")), ("s", None, bag("v", "w")), ("s", 2, bag("x", "y"))], "source string, first int, save string"))
    assert pieces == whole and len(whole) == 11


def test_trees_of_the_queries_come_in_bounded_pieces(spark):
    from stratafold import queries, queries_more

    tables = queries.Tables(spark, "/root/testdata/sf0.001")
    whole, cut = (queries_more._tile_saves(tables, n) for n in (10**6, 3))
    assert max(len(json.loads(r.save)["ObjectStates"][0]["ContainedObjects"]) for r in cut.collect()) == 3
    said = lambda df: sorted((r.source, list(r.path), r.node) for r in tree.flatten(df).withColumn("node", F.to_json("node")).filter("depth > 0").collect())
    assert said(cut) == said(whole) != []


def test_merged_reads_its_rows_once(spark):
    from stratafold.operators.aggregates import merged

    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    schema = "key string, ord int, name string, note string, tags array<string>, place string, box string"
    rows = [("a", 3, "x", "late", ["t"], "p", "m"), ("a", 1, None, None, ["u", "t"], "q", "m"), ("a", 2, "y", "early", None, "p", None), (None, 1, "z", None, [], None, "m")]
    got = merged(spark.createDataFrame(rows, schema).mapInArrow(passed, schema), ["key"], "ord", first=["name"], fill=["note"], unite=["tags"], place="place", box="box")
    said = {r.key: (r.copies, r.ord, r.name, r.note, r.tags, *([tuple(x) for x in c] if c else None for c in (r.locations, r.boxes))) for r in got.collect()}
    assert said == {"a": (3, 1, None, "early", ["t", "u"], [("q", 1), ("p", 2)], [("m", 2)]), None: (1, 1, "z", None, [], None, [("m", 1)])}
    assert read.value == len(rows)
