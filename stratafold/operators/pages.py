"""Sections from page layouts: figures find their heading, lines become blocks, headings number the document.

A line table has doc, page, col, ord (reading order in the document), block,
kind (text, bullet or image), text (or the image's hash) and level (of headings).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.operators.hierarchy import numbered, with_heading_levels
from stratafold.operators.layout import dominant_span, heading_level, joined_lines, standalone_strength
from stratafold.operators.ranges import RANGE_ROWS, folded


def figure_sections(lines: DataFrame) -> DataFrame:
    """`lines` with section: how many headings stand before or at a line in its document.

    An image before the first text of its column goes to that text's section if
    the text is a heading; if it isn't, or the column has no text, it stays with
    the section before. Nothing is carried into another column or page.
    """
    before = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("section", F.count(F.when(F.col("level").isNotNull(), 1)).over(before))
    words = F.col("kind") != "image"
    column = Window.partitionBy("doc", "page", "col")
    first = F.min(F.when(words, F.struct("ord", F.col("level").isNotNull().alias("heading")))).over(column)
    early = (F.col("kind") == "image") & (F.col("ord") < first["ord"]) & first["heading"]
    return marked.withColumn("section", F.col("section") + F.when(F.coalesce(early, F.lit(False)), 1).otherwise(0))


def sections_of(lines: DataFrame, source: str = "doc") -> DataFrame:
    """source, ord, id, level, title, content: a section per heading, its blocks as paragraphs, bullet lists and image references."""
    placed = figure_sections(lines).filter("section > 0")
    heads = placed.filter("level IS NOT NULL").select("doc", F.col("section").alias("ord"), "level", F.col("text").alias("title"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda r: r["text"])
    body = placed.filter("level IS NULL").groupBy("doc", "section", "block", "kind").agg(F.min("ord").alias("_o"), texts.alias("_t"))
    piece = (
        F.when(F.col("kind") == "image", F.array_join(F.transform("_t", lambda h: F.concat(F.lit("![](/images/"), h, F.lit(".png)"))), "\n"))
        .when(F.col("kind") == "bullet", F.array_join(F.transform("_t", lambda t: F.concat(F.lit("- "), t)), "\n"))
        .otherwise(joined_lines(F.col("_t")))
    )
    content = body.groupBy("doc", F.col("section").alias("ord")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", piece.alias("p")))), lambda r: r["p"]), "\n\n").alias("content"))
    whole = heads.join(content, ["doc", "ord"], "left").withColumn("content", F.coalesce("content", F.lit("")))
    return numbered(whole, "doc", "ord").select(F.col("doc").alias(source), "ord", "id", "level", "title", "content")


def emphasis(text: Column, bold: Column, italic: Column) -> Column:
    """Text in its marks; white space stays outside them."""
    core = F.trim(text)
    mark = F.concat(F.when(bold, "**").otherwise(""), F.when(italic, "*").otherwise(""))
    lead, tail = F.regexp_extract(text, r"^(\s*)", 1), F.regexp_extract(text, r"(\s*)$", 1)
    return F.when(core == "", text).otherwise(F.concat(lead, mark, core, F.reverse(mark), tail))


SPANS = "array<struct<text: string, font: string, size: double, colour: string>>"
#: Fixed value: what a bullet's first visible span is.
BULLET = "\u2022"


def rendered(spans: Column, bullet: Column) -> Column:
    """A line's spans as Markdown: neighbours of one style are one run in its marks; a bullet's mark is left out."""
    full = F.filter(spans, lambda s: s["text"] != "")
    marked = bullet & (F.trim(F.get(full, F.lit(0))["text"]) == BULLET)
    some = F.when(marked, F.slice(full, 2, F.greatest(F.size(full), F.lit(1)))).otherwise(full)
    styled = F.transform(some, lambda s: F.struct(F.contains(s["font"], F.lit("Bold")).alias("bold"), F.contains(s["font"], F.lit("It")).alias("italic"), s["text"].alias("text")))
    none = F.array().cast("array<struct<bold: boolean, italic: boolean, text: string>>")

    def step(runs: Column, s: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        joined = F.struct(s["bold"].alias("bold"), s["italic"].alias("italic"), F.concat(last["text"], s["text"]).alias("text"))
        same = (last["bold"] == s["bold"]) & (last["italic"] == s["italic"])
        return F.when(same, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(joined))).otherwise(F.concat(runs, F.array(s)))

    runs = F.aggregate(styled, none, step)
    return F.trim(F.array_join(F.transform(runs, lambda r: F.when(r["text"].rlike("[A-Za-z0-9]"), emphasis(r["text"], r["bold"], r["italic"])).otherwise(r["text"])), ""))


def line_level(spans: Column, table: list[tuple[str, int, str, int]]) -> Column:
    """A line's heading level from its visible spans: the first span's if that is 1 to 3 or if all spans have one, else the longest span's."""
    seen = F.filter(spans, lambda s: F.trim(s["text"]) != "")
    level = lambda s: heading_level(s["font"], s["size"], s["colour"], table)
    first = level(F.get(seen, F.lit(0)))
    return F.when(F.size(seen) > 0, F.when((first <= 3) | (first.isNotNull() & F.forall(seen, lambda s: level(s).isNotNull())), first).otherwise(level(dominant_span(seen))))


def _lines_read(state: list, row: tuple) -> tuple[list, tuple]:
    """One line of a block: what is being read (nothing, a paragraph or bullets), where it began, and where its bullet began."""
    kind, at = row
    reading, item, bullet = state
    if kind == "heading":
        return ["", None, None], (kind, at, None)
    if kind == "bullet":
        item = item if reading == "bullets" else at
        return ["bullets", item, at], ("bullets", item, at)
    if reading == "":
        reading, item = "para", at
    return [reading, item, bullet], (reading, item, bullet)


def line_items(lines: DataFrame, headings: list[tuple[str, int, str, int]], font: str, blacks: list[str], skipped: Column | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Items of page blocks: headings, paragraphs and bullet lists, from lines (doc, page, block, ord, spans, x1).

    A finite-state pass reads a block's lines in order: a heading stands alone, a
    bullet opens a list or goes on with it, and any other line goes on with the
    bullet or paragraph being read, or opens a paragraph. The state runs through
    ranges of lines (`ranges.folded`), so a block may be of any size. `headings`
    gives levels by font, size and colour; a bold black line of `font` by itself is
    a heading with a strength instead of a level, unless it is a part of a sentence
    that runs over lines (a line looks at its neighbours in the block, which lies on one
    page). `skipped` names lines to leave out. `ord` is unique in a document.

    Returns doc, page, block, ord (of the item's first line), kind (heading, para,
    bullets), level, strength, text. Lines without visible text are left out, lists
    without any text too; null spans are no spans.
    """
    spans = F.coalesce(F.col("spans").cast(SPANS), F.array().cast(SPANS))
    words = F.array_join(F.transform(spans, lambda s: F.coalesce(s["text"], F.lit(""))), "")
    edge = lines.groupBy("doc", "page", "block").agg(F.max("x1").alias("_edge"))
    met = lines.alias("l").join(edge.alias("e"), F.col("l.doc").eqNullSafe(F.col("e.doc")) & F.col("l.page").eqNullSafe(F.col("e.page")) & F.col("l.block").eqNullSafe(F.col("e.block"))).select("l.*", "_edge")
    seen = F.filter("_spans", lambda s: F.trim(s["text"]) != "")
    sign = lambda s: F.struct(s["font"], F.bround(s["size"]), s["colour"])
    read = met.withColumns({"_spans": spans, "_text": F.trim(words)})
    read = read.withColumns({"_first": sign(F.get(seen, F.lit(0))).cast("string"), "_last": sign(F.get(seen, F.size(seen) - 1)).cast("string"), "_ends": F.col("x1") >= F.col("_edge") - 2, "_low": F.col("_text").rlike(r"^\p{Ll}"), "_level": line_level(F.col("_spans"), headings)})
    # a line that goes on in lower case, in the same type, where the line before reached the edge
    row = Window.partitionBy("doc", "page", "block").orderBy("ord")
    goes_on = F.coalesce(F.lag("_ends").over(row) & F.col("_low") & (F.lag("_last").over(row) == F.col("_first")), F.lit(False))
    follows = read.withColumn("_all", F.lit(True) if skipped is None else ~F.coalesce(skipped, F.lit(False))).withColumn("_goes_on", goes_on)
    both = follows.withColumn("_continued", F.lead("_goes_on").over(row)).filter((F.col("_text") != "") & F.col("_all"))
    strength = F.when(F.col("_level").isNotNull(), F.col("_level") * 10).when(~(F.col("_goes_on") | F.coalesce("_continued", F.lit(False))), standalone_strength(F.col("_text"), F.col("_spans"), font, blacks))
    bullet = F.trim(F.get(seen, F.lit(0))["text"]) == BULLET
    told = both.withColumn("_strength", strength).withColumn("_kind", F.when(F.col("_strength").isNotNull(), "heading").when(bullet, "bullet").otherwise("text"))
    title = F.trim(F.regexp_replace(F.regexp_replace("_text", "\x08", " "), r"\s+", " "))
    text = F.when(F.col("_kind") == "heading", title).otherwise(rendered(F.col("_spans"), F.col("_kind") == "bullet"))
    # a line goes on as its Markdown alone: ranges are written and dealt without spans
    read_ = folded(told.select("doc", "page", "block", "ord", text.alias("_md"), "_level", "_strength", "_kind", F.col("ord").cast("long").alias("_at")), ["doc", "page", "block"], ["ord"], ["_kind", "_at"], _lines_read, ["", None, None], "_reading string, _item long, _bullet long", range_rows)
    key = ["doc", "page", "block", "_item", "_reading"]
    said = lambda order, value, between: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("t")))), lambda r: r["t"] != ""), lambda r: r["t"]), between)
    parts = read_.groupBy(*key, "_bullet").agg(said("ord", "_md", " ").alias("_part"), F.max("_level").alias("level"), F.max("_strength").alias("strength"))
    listed = F.when((F.col("_reading") == "bullets") & (F.trim("_part") != ""), F.concat(F.lit("- "), F.trim("_part"))).when(F.col("_reading") == "bullets", F.lit("")).otherwise(F.col("_part"))
    items = parts.withColumn("_part", listed).groupBy(*key).agg(said("_bullet", "_part", "\n").alias("text"), F.max("level").alias("level"), F.max("strength").alias("strength"))
    return items.filter((F.col("_reading") != "bullets") | (F.col("text") != "")).select("doc", "page", "block", F.col("_item").alias("ord"), F.col("_reading").alias("kind"), "level", "strength", "text")


def headed(items: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Heading items of `line_items` with the level that the open headings before them give, where their type gives none."""
    return with_heading_levels(items.filter("kind = 'heading'"), "doc", "ord", "strength", "level", "heading_level", range_rows)


def annotated(sections: DataFrame, figures: DataFrame) -> DataFrame:
    """Figures (doc, page, title, expected, found) with the section they go to: the same title on the same page, else the first with that title; one without its expected text fails."""
    checked = figures.withColumn("title", F.when(F.contains("found", "expected"), F.col("title")).otherwise(F.raise_error(F.concat(F.lit("the crop lacks its text: "), F.col("expected"))).cast("string")))
    met = checked.join(sections.select("doc", "title", F.col("page").alias("_page"), "ord"), ["doc", "title"])
    return met.groupBy(*figures.columns).agg(F.min_by("ord", F.struct((F.col("_page") != F.col("page")).alias("far"), F.col("ord"))).alias("ord"))
