import pytest
from pyspark.sql import functions as F

from stratafold.functions import text as tx


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "make, value, want",
    [
        (tx.slug, "élan Vital!", "e-lan-vital"),
        (tx.slug, "--", ""),
        (tx.title_key, "Wizard’s “Eye” isn't", 'Wizards "Eye" isnt'),
        (tx.alnum_key, "Ab-c 1", "abc1"),
        (tx.text, "  x\n", "x"),
        (tx.text, "  \n", None),
        (tx.title_case, "core-book of-rules", "Core Book of Rules"),
        (tx.pretty_name, "caveBear old", "Cave Bear Old"),
        (tx.clean_name, "a/b/Sly Fox token (2)", "Sly Fox"),
        (tx.doc_family, "core-rules-2", "core"),
        (tx.name_variants, "wolves of woods", ["wolves of woods", "wolf of woods", "wolves of wood"]),
        (tx.blocks, "a\n\n\n b\n\n \n\nc", ["a", " b", "c"]),
        (tx.squeezed, "\na\n\n\n\nb \n", "a\n\nb"),
    ],
)
def test_scalars(spark, make, value, want):
    assert one(spark, make(F.col("v")), v=value) == want


def test_replace_first(spark):
    c = F.col("v")
    assert one(spark, tx.replace_first(c, "b", "[$&|$`|$'|$$]"), v="abcb") == "a[b|a|cb|$]cb"
    assert one(spark, tx.replace_first(c, "z", "x"), v="abc") == "abc"


def test_images(spark):
    c = F.col("v")
    text = "![](/images/a1.png)\n\nx ![](/images/p/b2.jpg)\n\n![](/images/a1.png)"
    assert one(spark, tx.image_hashes(c), v=text) == ["a1", "b2", "a1"]
    assert one(spark, tx.strip_images(c, ["a1"]), v=text) == "x ![](/images/p/b2.jpg)"
    assert one(spark, tx.dedupe_images(c, ["a1"]), v=text) == "![](/images/a1.png)\n\nx ![](/images/p/b2.jpg)"
    assert one(spark, tx.strip_images(c, ["a1"]), v="keep\n\n\n\nthis") == "keep\n\n\n\nthis"


def test_nodes_and_back(spark):
    text = "plain\n\n![](/images/a1.png)\n\n![](/images/b2.png)\nside text\n\nend"
    nodes = one(spark, tx.content_nodes(F.col("v")), v=text)
    assert [n.kind for n in nodes] == ["markdown", "image", "mediaAside", "markdown"] and nodes[2].images == ["b2"]
    assert one(spark, tx.nodes_to_markdown(tx.content_nodes(F.col("v"))), v=text) == text


def test_anchors(spark):
    text = "**Big Rule.** a\n\nmore\n\n2) Other thing. b\n\nLast: c"
    c = F.col("v")
    assert one(spark, F.transform(tx.blocks(c), tx.block_anchor), v=text) == ["big-rule", None, "other-thing", "last"]
    assert one(spark, tx.anchored_slice(c, "big"), v=text) == ["**Big Rule.** a", "more"]
    assert one(spark, tx.block_range(c, 2, 1), v=text) == ["more", "2) Other thing. b"]


def test_footer(spark):
    two = "body\n\n![](/images/a.png)\n![](/images/b.png)"
    got = one(spark, tx.footer_split(F.col("v")), v=two)
    assert got.body == "body" and got.footer.count("![]") == 2
    assert one(spark, tx.footer_split(F.col("v")), v="body\n\n![](/images/a.png)").footer is None
    assert one(spark, tx.footer_split(F.col("v")), v="body\n\n![](/images/a.png) Copyright X").footer is not None


def test_scripts(spark):
    script = 'function one()\n a = 3\n b = 0\nend\nfunction two()\n draw("c", 2, -0.5)\n draw("d", 1, 1)\nend\nt = { x = { 1 }, y }  z'
    c = F.col("v")
    assert one(spark, tx.braced_table(c, "t ="), v=script) == "{ x = { 1 }, y }"
    assert one(spark, tx.function_body(c, "one"), v=script).strip().endswith("end")
    assert one(spark, tx.assignments(tx.function_body(c, "one")), v=script) == {"a": 3}
    assert one(spark, tx.calls(c, "draw"), v=script) == [["c", "2", "-0.5"], ["d", "1", "1"]]


def test_maps_and_labels(spark):
    assert one(spark, tx.first_mapped(F.col("v"), {"b": "B"}, "none"), v=["a", "b"]) == "B"
    assert one(spark, tx.count_label(F.col("v"), "copy", "copies"), v=2) == "2 copies"
    assert one(spark, tx.join_labels(F.lit("a"), F.lit(None), F.lit("b"))) == "a · b"
    with pytest.raises(Exception, match="unknown name"):
        one(spark, tx.case_map(F.col("v"), {"core": "c"}, strict=True), v="other")
