"""SimHash document fingerprints and search by permuted block tables. DataFrame and SQL functions only.

Fingerprint: each word's XXH64 votes on 64 signed bits with a weight that grows
with the word's length (its square up to MAX_WEIGHT letters), so that a language's
short common words carry little; a bit is 1 if its votes sum above zero. The
sums of two bits share one long, 32 bits each: 32 sums a row keep the aggregate
in generated code. A lane holds the votes of PART_WORDS words, so longer texts are
summed by parts, whose halves are then added apart.

Search: fingerprints within `radius` bits agree on at least one of radius + 1
blocks (Manku et al., "Detecting near-duplicates for web crawling"). A table per
block holds the fingerprints permuted so that this block leads; probes meet the
rows with the same lead, a match must be met in the first table that can meet it,
and is verified by counting differing bits. `blocks` above radius + 1 takes more
and longer leads: every choice of blocks - radius blocks is a table.

`edited_pairs` pairs each text with an edited one that ends in the beginning of
the next document by doc_id. The order is found inside bins of equal numbers of
rows: ids and text hashes alone are put in order by ranges, and every n-th of them
begins a bin, whatever ids repeat or cluster. Rows alike in both are spread over the
bins that begin with them. The first document of each bin is also sent to the bin
before, so no task holds all rows.

Defined cases: null text is the empty text; a text without words has fingerprint
zero; a null doc_id comes before all others; rows that tie in doc_id follow in
order of their text's hash; with one row, that row is its own next; repeated rows
are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratafold.llm.shared import checked_broadcast, saved

MAX_WEIGHT = 12
RADIUS = 3
BLOCKS = 6
#: The queries of the search: rows whose doc_id this divides.
QUERY_EVERY = 50
#: Rows of a bin, unless that makes more than MOST_BINS (what the driver and each task hold of bins).
ROWS_PER_BIN, MOST_BINS = 512, 1 << 14
#: Bins whose first rows are looked through at once.
FINE = 128
#: Words of a text whose votes one lane can hold: PART_WORDS * MAX_WEIGHT ** 2 < 2 ** 32.
PART_WORDS = 1 << 23
_LANES = 0x0000000100000001
SPACE = r"[\x20\x09-\x0D]+"


def _vote_sums() -> list[Column]:
    weight = F.pow(F.least(F.length("word"), F.lit(MAX_WEIGHT)), 2).cast("long")
    hashed = F.xxhash64("word")
    lanes = [F.shiftrightunsigned(hashed, i).bitwiseAND(F.lit(_LANES)) if i else hashed.bitwiseAND(F.lit(_LANES)) for i in range(32)]
    return [F.sum(lane * weight).alias(f"s{i}") for i, lane in enumerate(lanes)] + [F.sum(weight).alias("all_votes")]


def _half_sums() -> list[Column]:
    halves = [F.sum(F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"b{i}") for i in range(32)] + [F.sum(F.shiftrightunsigned(F.col(f"s{i}"), 32)).alias(f"b{i + 32}") for i in range(32)]
    return [*halves, F.sum("all_votes").alias("all_votes")]


def _fingerprint() -> Column:
    """The fingerprint from the sums of `_half_sums`."""
    bits = [F.when(2 * F.col(f"b{i}") > F.col("all_votes"), F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(64)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def fingerprinted(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """`keys` (which name a row) and fp of each row. Where `rows` is dealt by some of the keys, nothing is shuffled."""
    words = rows.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), SPACE)).alias("at", "word"))
    parts = words.groupBy(*keys, F.floor(F.col("at") / PART_WORDS).cast("int").alias("part")).agg(*_vote_sums())
    return parts.groupBy(*keys).agg(*_half_sums()).select(*keys, _fingerprint().alias("fp"))


def hexed(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: str, b: str) -> Column:
    """1 less the share of differing bits."""
    return F.lit(1.0) - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def _leads(blocks: int, radius: int) -> list[int]:
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(c)) for c in combinations(masks, blocks - radius)]


def within_radius(probes: DataFrame, stored: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(probe, fp) pairs of a table of distinct fingerprints `probe` and one of distinct `fp` that differ in at most `radius` bits, each once."""
    leads = _leads(blocks, radius)
    table = lambda of: F.inline(F.array(*(F.struct(F.lit(i).alias("table_no"), F.col(of).bitwiseAND(F.lit(m).cast("long")).alias("lead")) for i, m in enumerate(leads))))
    differ = F.col("probe").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*(F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(i)) for i, m in enumerate(leads)))
    a, b = probes.select("probe", table("probe")), stored.select("fp", table("fp"))
    met = (a["table_no"] == b["table_no"]) & (a["lead"] == b["lead"])
    return a.join(b, met & (F.bit_count(differ) <= radius) & (first == a["table_no"])).select("probe", "fp")


def _bounds(keys: DataFrame, rows: int) -> list[tuple[int | None, int]]:
    """The first (doc_id, hash) of each bin of about `rows` rows, in order; rows alike may begin several bins."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc()]
    counted = keys.groupBy("doc_id", "hash").agg(F.count("*").alias("n"))
    ranges = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = saved(counted.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    before, at = {}, 0
    for r in sorted(dealt.groupBy("range").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["range"]):  # one row per range
        before[r["range"]] = at
        at += r["n"]
    if not before:
        return []
    start = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair)), F.col("range").cast("long"))
    inside = F.sum("n").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = dealt.withColumn("start", start + inside)
    first, last = F.expr(f"CAST(ceil(start / {rows}) AS BIGINT)"), F.expr(f"(start + n - 1) div {rows}")
    begun = placed.select("doc_id", "hash", "start", (last - first + 1).alias("bins")).filter("bins > 0")
    found = sorted(begun.collect(), key=lambda r: r["start"])  # at most a row per bin
    return [(r["doc_id"], r["hash"]) for r in found for _ in range(r["bins"])]


def _rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small table of the plan itself."""
    names = [c.split()[0] for c in schema.split(", ")]
    fields = ", ".join(c.replace(" ", ": ") for c in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), f"array<struct<{fields}>>")))


def _binned(docs: DataFrame) -> DataFrame:
    """Rows (bin, tail, doc_id, text, hash): every row in its bin, and the first of each bin once more (tail = 1) in the bin before, cyclically.

    Bins follow each other in the order of doc_id (null first) and the text's hash. A
    row whose key begins bins goes to one of them, any other to the last bin that
    begins before it.
    """
    spark = docs.sparkSession
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    keys = saved(own.select("doc_id", "hash"))
    bounds = _bounds(keys, max(ROWS_PER_BIN, -(-keys.count() // MOST_BINS)))
    if not bounds:
        return own.withColumns({"bin": F.lit(0), "tail": F.lit(0)})
    kind = "array<struct<i: bigint, h: bigint>>"
    written = [[{"i": i, "h": h} for i, h in bounds[at : at + FINE]] for at in range(0, len(bounds), FINE)]
    fine = F.from_json(F.lit(json.dumps(written)), f"array<{kind}>")
    coarse = F.from_json(F.lit(json.dumps([part[0] for part in written])), kind)

    def less(b: Column) -> Column:
        return F.when(b["i"].isNull(), F.col("doc_id").isNotNull() | (b["h"] < F.col("hash"))).otherwise(F.coalesce((b["i"] < F.col("doc_id")) | ((b["i"] == F.col("doc_id")) & (b["h"] < F.col("hash"))), F.lit(False)))

    def same(b: Column) -> Column:
        return b["i"].eqNullSafe(F.col("doc_id")) & (b["h"] == F.col("hash"))

    # how many bins begin before the row's key: full runs of FINE, then within the run
    run = F.greatest(F.size(F.filter(coarse, less)) - 1, F.lit(0))
    inside = own.withColumn("run", run).withColumn("low", F.col("run") * FINE + F.size(F.filter(F.get(fine, F.col("run")), less)))
    here = F.size(F.filter(F.get(fine, F.floor(F.col("low") / FINE).cast("int")), same))
    number = Counter(bounds)
    if repeated := sorted({k for k, after in zip(bounds, bounds[1:]) if k == after}, key=str):
        crowd = F.broadcast(_rows(spark, "ci bigint, ch bigint, bins int", [(i, h, number[i, h]) for i, h in repeated]))  # fewer rows than bins
        inside = inside.join(crowd, F.col("doc_id").eqNullSafe(F.col("ci")) & (F.col("hash") == F.col("ch")), "left")
        here = F.coalesce("bins", here)
    begun = F.greatest(F.coalesce(here, F.lit(0)), F.lit(0))
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.greatest(begun, F.lit(1)))
    binned = inside.withColumn("bin", F.when(begun > 0, F.col("low") + spread).otherwise(F.col("low") - 1).cast("int")).select("bin", "doc_id", "text", "hash")
    starts = _rows(spark, "bin int, i bigint, h bigint", [((n or len(bounds)) - 1, i, h) for n, (i, h) in enumerate(bounds)])  # a row per bin
    distinct = starts.select("i", "h").distinct()
    met = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h"))
    texts = own.join(F.broadcast(distinct), met, "left_semi").groupBy("doc_id", "hash").agg(F.min("text").alias("text"))
    tails = texts.join(F.broadcast(starts), met).select("bin", "doc_id", "text", "hash", F.lit(1).alias("tail"))
    return binned.withColumn("tail", F.lit(0)).unionByName(tails)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Rows (bin, rn, tail, doc_id, text, edited), in doc_id order within bins; a bin's last row (tail = 1) is the row after the bin."""
    order = "OVER (PARTITION BY bin ORDER BY tail, doc_id NULLS FIRST, hash, text)"
    placed = _binned(docs).repartition("bin").selectExpr("*", f"row_number() {order} AS rn", f"lead(text) {order} AS next_text", f"lag(tail) {order} AS tail_before")
    half = "CAST(length(text) div 2 AS INT)"
    edited = f"concat(left(text, length(text) - {half}), left(coalesce(next_text, ''), {half})) AS edited"
    return placed.filter("tail = 0 OR tail_before = 0").selectExpr("bin", "rn", "tail", "doc_id", "text", edited)


def document_fingerprints(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_docs.

    near_docs, for rows whose doc_id QUERY_EVERY divides: how many other rows have
    a fingerprint within the radius.
    """
    about = "named_struct('doc_id', doc_id, 'n_chars', CAST(length(text) AS BIGINT), 'edited_sha256', sha2(edited, 256))"
    rows = edited_pairs(docs).selectExpr("bin", "rn", "tail", f"inline(array(named_struct('kind', 0, 'text', text, 'about', {about}), named_struct('kind', 1, 'text', edited, 'about', {about})))")
    rows = rows.selectExpr("bin", "rn", "tail", "kind", "text", "about.doc_id", "about.n_chars", "about.edited_sha256").filter("kind = 0 OR tail = 0")
    marked = fingerprinted(rows, ["bin", "rn", "tail", "doc_id", "n_chars", "edited_sha256", "kind"])
    order = "OVER (PARTITION BY bin ORDER BY rn, kind)"
    beside = marked.selectExpr("*", f"lead(fp) {order} AS edited_fp", f"lead(fp, 2) {order} AS next_fp").filter("kind = 0 AND tail = 0")
    found = saved(beside.select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"))
    asks = (F.col("doc_id") % QUERY_EVERY) == 0
    distinct = found.groupBy("fp").agg(F.count("*").alias("rows"), F.max(F.coalesce(asks, F.lit(False))).alias("asks"))
    distinct = saved(distinct)
    met = within_radius(distinct.filter("asks").select(F.col("fp").alias("probe")), distinct.select("fp"), radius, blocks)
    near = met.join(distinct.select("fp", "rows"), "fp").groupBy("probe").agg((F.sum("rows") - 1).alias("near_docs"))
    asked = found.filter(asks).join(near, F.col("fp") == F.col("probe"), "left").drop("probe")
    out = asked.unionByName(found.filter(~F.coalesce(asks, F.lit(False))).withColumn("near_docs", F.lit(None).cast("long")))
    return out.select("doc_id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), "near_docs")
