"""Passes whose state crosses ranges, against loops."""

import random

import pytest
from pyspark.sql import functions as F

from stratafold.operators import hierarchy, ordered, pages
from stratafold.operators.ranges import folded


def levels_by_loop(rows):
    """Levels of (strength, given) headings in order."""
    open_, out = [None] * 8, []
    for strength, given in rows:
        level = given
        if level is None:
            level = min(8, 1 + max([i + 1 for i, s in enumerate(open_) if s is not None and s < strength], default=0))
        open_[level - 1 :] = [strength] + [None] * (8 - level)
        out.append(level)
    return out


@pytest.mark.parametrize("range_rows", [7, 60, 10_000])
def test_heading_levels_over_ranges(spark, range_rows):
    rng = random.Random(range_rows)
    docs = {d: [(rng.randint(1, 12), rng.choice([None, None, None, rng.randint(1, 8)])) for _ in range(n)] for d, n in (("big", 300), ("small", 3), (None, 40), ("x", 1))}
    rows = [(d, i, s, g) for d, headings in docs.items() for i, (s, g) in enumerate(headings)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc string, ord int, strength int, level int")
    got = hierarchy.with_heading_levels(df, "doc", "ord", level="level", range_rows=range_rows).collect()
    for d, headings in docs.items():
        assert [r.heading_level for r in sorted((r for r in got if r.doc == d), key=lambda r: r.ord)] == levels_by_loop(headings)
    assert hierarchy.with_heading_levels(df.limit(0), "doc", "ord").count() == 0
    with pytest.raises(Exception, match="from 1 to 8"):
        hierarchy.with_heading_levels(df.withColumn("level", F.lit(9)), "doc", "ord", level="level").collect()


def test_a_million_headings_of_one_document(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("'d' AS doc", "id AS ord", "CAST(pmod(xxhash64(id), 9) AS INT) AS strength", "CAST(NULL AS INT) AS level")
    got = hierarchy.with_heading_levels(df, "doc", "ord").select("ord", "strength", "heading_level").toPandas().sort_values("ord")
    assert got.heading_level.tolist() == levels_by_loop([(s, None) for s in got.strength.tolist()])


def test_null_keys_and_ties_of_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("b", 1), ("b", 2)], "g string, o int")
    got = folded(df, ["g"], ["o"], ["o"], lambda s, row: (s + row[0], (s + row[0],)), 0, "total long", 2).collect()
    assert sorted((str(r.g), r.o, r.total) for r in got) == [("None", 1, 1), ("None", 2, 3), ("a", 1, 1), ("b", 1, 1), ("b", 2, 3)]


def rows_by_loop(texts, room, card, entry_gap, row_gap):
    rows, row, used = [], [], 0.0
    for i, wanted in enumerate(texts):
        text = max(1.0, min(wanted, max(1.0, room - card - entry_gap)))
        need = card + entry_gap + text
        if row and used + row_gap + need > room:
            rows.append((row, used))
            row, used = [], 0.0
        used += need + (row_gap if row else 0)
        row.append((i, text))
    rows += [(row, used)] if row else []
    return {i: (n, text + max(0.0, room - used) * text / sum(t for _, t in row)) for n, (row, used) in enumerate(rows) for i, text in row}


@pytest.mark.parametrize("range_rows", [5, 10_000])
def test_rows_are_filled_greedily(spark, range_rows):
    rng = random.Random(3)
    groups = {g: [rng.uniform(-3, 90) for _ in range(n)] for g, n in (("a", 60), ("b", 1), (None, 9))}
    df = spark.createDataFrame([(g, i, w, "kept") for g, ws in groups.items() for i, w in enumerate(ws)], "g string, i int, w double, row string").withColumnRenamed("row", "other")
    got = ordered.rows_filled(df, ["g"], "i", "w", 100.0, 10.0, 5.0, 2.0, range_rows).collect()
    for g, ws in groups.items():
        want = rows_by_loop(ws, 100.0, 10.0, 5.0, 2.0)
        own = {r.i: (r.row, r.width) for r in got if r.g == g}
        assert own.keys() == want.keys() and all(own[i][0] == want[i][0] and own[i][1] == pytest.approx(want[i][1]) for i in own)
    assert ordered.rows_filled(df, ["g"], "i", "w", 0.0, 10.0, 5.0, 2.0).count() == 0
    assert {r.width for r in ordered.rows_filled(df.filter("g = 'b'").withColumn("w", F.lit(None).cast("double")), ["g"], "i", "w", 100.0, 10.0, 5.0, 2.0).collect()} == {85.0}


HEADINGS = [("Fancy", 18, "red", 1), ("Fancy", 18, "brown", 2), ("Serif-Bold", 14, "black", 4)]
LINES = f"doc string, page int, block int, ord int, x1 double, spans {pages.SPANS}"


def items_by_loop(lines):
    out, blocks = [], {}
    for line in sorted(lines, key=lambda r: r[3]):
        blocks.setdefault(line[:3], []).append(line)
    for (doc, page, block), own in blocks.items():
        edge = max(x[4] for x in own)
        text = lambda x: "".join(s[0] for s in x[5] or []).strip()
        seen = lambda x: [s for s in x[5] or [] if s[0].strip()]
        sign = lambda s: (s[1], round(s[2]), s[3])
        level_of = lambda s: next((v for f, z, c, v in HEADINGS if (f, z, c) == sign(s)), None)
        mode, para, bullets, at = "", [], [], None

        def flush():
            nonlocal mode, para, bullets
            if mode == "para":
                out.append((doc, page, block, at, "para", None, None, " ".join(p for p in para if p)))
            if mode == "bullets" and any(bullets):
                out.append((doc, page, block, at, "bullets", None, None, "\n".join(f"- {b}" for b in bullets if b)))
            mode, para, bullets = "", [], []

        def goes_on(a, b):
            return seen(a) and seen(b) and a[4] >= edge - 2 and text(b)[:1].islower() and sign(seen(a)[-1]) == sign(seen(b)[0])

        for i, x in enumerate(own):
            if not text(x):
                continue
            first = level_of(seen(x)[0])
            dominant = max(seen(x), key=lambda s: len(s[0]))
            level = first if first is not None and (first <= 3 or all(level_of(s) for s in seen(x))) else level_of(dominant)
            strength = level * 10 if level else None
            if level is None and all(s[1] == "Serif-Bold" and s[3] == "black" for s in seen(x)) and text(x) != "•" and len(text(x)) <= 80 and not text(x).endswith((".", ")")):
                strength = {12: 60, 11: 70}.get(round(seen(x)[0][2])) if len({round(s[2]) for s in seen(x)}) == 1 else None
                if (i and goes_on(own[i - 1], x)) or (i + 1 < len(own) and goes_on(x, own[i + 1])):
                    strength = None
            if strength is not None:
                flush()
                out.append((doc, page, block, x[3], "heading", level, strength, " ".join(text(x).split())))
                continue
            runs = []
            spans = [s for s in x[5] if s[0]]
            bullet = seen(x)[0][0].strip() == "•"
            for s in spans[1:] if bullet and spans[0][0].strip() == "•" else spans:
                style = ("**" if "Bold" in s[1] else "") + ("*" if "It" in s[1] else "")
                if runs and runs[-1][0] == style:
                    runs[-1][1] += s[0]
                else:
                    runs.append([style, s[0]])
            md = "".join(t if not t.strip() or not any(c.isascii() and c.isalnum() for c in t) else t[: len(t) - len(t.lstrip())] + m + t.strip() + m[::-1] + t[len(t.rstrip()) :] for m, t in runs).strip()
            if bullet:
                if mode != "bullets":
                    flush()
                    mode, at = "bullets", x[3]
                bullets.append(md)
            elif mode == "bullets":
                bullets[-1] = (bullets[-1] + " " + md).strip()
            else:
                if mode == "":
                    mode, at = "para", x[3]
                para.append(md)
        flush()
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, range_rows", [(0, 9), (1, 50), (2, 10_000)])
def test_lines_become_items(spark, seed, range_rows):
    rng = random.Random(seed)
    fonts = [("Fancy", 18.2, "red"), ("Serif-Bold", 14.0, "black"), ("Serif-Bold", 12.0, "black"), ("Serif-Bold", 11.0, "black"), ("Serif", 10.0, "black"), ("Serif-It", 10.0, "black"), ("Serif-BoldIt", 10.0, "black"), ("Serif", 10.0, "black")]
    texts = ["One word", " goes on", "lower case", "•", " ", "", "Ends here.", "two  spaces ", "!", "X"]
    lines = []
    for doc, blocks in (("a", 12), ("b", 1), (None, 2)):
        at = 0
        for block in range(blocks):
            for _ in range(rng.randint(1, 40 if doc == "a" else 5)):
                font = rng.choice(fonts)
                spans = [(rng.choice(texts), *(font if rng.random() < 0.7 else rng.choice(fonts))) for _ in range(rng.randint(0, 3))]
                if rng.random() < 0.25:
                    spans = [("•", "Serif", 10.0, "black"), *spans]
                lines.append((doc, block // 3, block, at, rng.choice([100.0, 99.0, 50.0]), spans or None))
                at += 1
    got = pages.line_items(spark.createDataFrame(lines, LINES).withColumn("level", F.lit("clash")), HEADINGS, "Serif-Bold", ["black"], range_rows=range_rows)
    assert sorted(map(tuple, got.collect()), key=str) == items_by_loop(lines)
    heads = pages.headed(got, range_rows).collect()
    own = sorted((r for r in heads if r.doc == "a"), key=lambda r: r.ord)
    assert [r.heading_level for r in own] == levels_by_loop([(r.strength, r.level) for r in own])
    assert pages.line_items(spark.createDataFrame([], LINES), HEADINGS, "Serif-Bold", ["black"]).count() == 0


def test_lines_are_dealt_as_their_markdown_alone(spark, monkeypatch):
    dealt, folded = [], pages.folded
    monkeypatch.setattr(pages, "folded", lambda df, *rest: dealt.append(set(df.columns)) or folded(df, *rest))
    assert pages.line_items(spark.createDataFrame([], LINES), HEADINGS, "Serif-Bold", ["black"]).count() == 0
    assert "_md" in dealt[0] and not dealt[0] & {"_spans", "_text"}
