"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame and SQL functions only.

1. Sizes: words of each text. Sources in code-point order (null last) weigh
   WEIGHTS, repeating; targets share the total by weight, and a target above
   MAX_EPOCHS times its source's size stops there and its excess is reshared by
   weight. That fixed point is a water level, found in one ordered pass.
2. Each source's documents are put in a permuted order by hash; the target is a
   run of words over that order, begun anew at each epoch. The place of each
   document comes from two prefix sums, over hash bins of the source and inside
   each bin, so no task holds a whole source.
3. The run is cut into blocks. The block quotas of all sources, one vector, are
   split in two at each node of a tree over the output shards; a node's left
   part is a multivariate hypergeometric draw, taken source by source from the
   conditional hypergeometric law by inversion from its mode. Leaves hold each
   shard's exact quota per source.
4. Each source's blocks are permuted and dealt to the shards by those quotas, so
   shards hold disjoint blocks and all blocks are dealt. A shard's rows are then
   shuffled by hash.

Every draw is a hash of the seed and its place, so runs agree.

One row per source goes through one task (ranking, the water level, the quota
vector), as sources and weights are a configuration; blocks are at most MAX_BLOCKS
and one per source.

Defined cases: null text has size 0 and is never taken; a source of size 0 has
target 0; a document that the end of the target cuts is taken for the words
before the cut (`cut="words"`) or whole if at least half lies before it
(`cut="documents"`); repeated rows are documents of their own; an empty table
gives no rows; other columns are kept by `mixed_documents` only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.shared import checked_broadcast, saved

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SHARDS = 64
SEED = 20
MAX_BLOCKS = 1 << 16
LEAST_BLOCK = 4096
#: Words of a shard's part that one task shuffles, about.
TASK_WORDS = 4 << 20
WORD = r"[^\x20\x09-\x0D]+"
#: Hash bins of a source: the first hexadecimal digits of a row's place, at least BIN_DIGITS, more above BIN_ROWS rows a bin.
BIN_DIGITS, BIN_ROWS = 3, 1 << 16
#: Rows alike that one task takes apart.
ALIKE_ROWS = 1 << 18


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, row_key and the permuting hash of each row."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(
        docs["doc_id"].alias("doc_id"),
        docs["source"].alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(docs["doc_id"], docs["text"]).alias("row_key"),
        F.md5(F.concat_ws(":", F.lit(str(SEED)), F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.md5(text))).alias("place"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source_no, source, source_size, target and the whole words `quota` of each source."""
    view = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights_sql = f"array({', '.join(map(str, weights))})"
    return view.sparkSession.sql(
        f"""
        WITH ranked AS (
          SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_no, sum(source_size) OVER () AS total FROM {{view}}
        ), weighed AS (
          SELECT *, CAST(element_at({weights_sql}, CAST((source_no - 1) % {len(weights)} AS INT) + 1) AS DOUBLE) AS weight,
            CAST({max_epochs} * source_size AS DOUBLE) AS most FROM ranked
        ), levels AS (
          SELECT *, most / weight AS full_at,
            (total - coalesce(sum(most) OVER (ORDER BY most / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D))
            / sum(weight) OVER (ORDER BY most / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
        ), settled AS (
          SELECT *, max(CASE WHEN level <= full_at THEN level END) OVER () AS water FROM levels
        )
        SELECT source_no, source, source_size, round(least(most, coalesce(water, 0D) * weight), 6) AS target,
          CAST(round(least(most, coalesce(water, 0D) * weight)) AS BIGINT) AS quota FROM settled
        """,
        view=view,
    )


def _let(name: str, value: str, then: str) -> str:
    """SQL: `then` with `name` standing for `value`, which is computed once."""
    return f"transform(array({value}), {name} -> {then})[0]"


def hypergeometric_sql(population: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL for the number of marked ones among `drawn` of `population`, by inversion of `uniform` outwards from the mode.

    The walk goes 12 standard deviations and 12 steps to either side, which leaves out less than 1e-30.
    """
    up = "(z.k - i) * (z.n - i) / ((i + 1D) * (z.p - z.k - z.n + i + 1D))"
    down = "i * (z.p - z.k - z.n + i) / ((z.k - i + 1D) * (z.n - i + 1D))"

    def total(steps: str, ratio: str) -> str:
        return f"aggregate({steps}, struct(1D AS w, 0D AS s), (a, i) -> struct(a.w * {ratio} AS w, a.s + a.w * {ratio} AS s), a -> a.s)"

    def walk(steps: str, ratio: str, from_: str, next_: str) -> str:
        return (
            f"aggregate({steps}, struct(1D AS w, {from_} AS s, m AS x, false AS hit), (a, i) -> struct(a.w * {ratio} AS w, a.s + a.w * {ratio} AS s, "
            f"CASE WHEN a.hit THEN a.x ELSE {next_} END AS x, a.hit OR v < a.s + a.w * {ratio} AS hit), a -> a.x)"
        )

    ups, downs = "slice(sequence(m, r.b), 1, CAST(r.b - m AS INT))", "slice(sequence(m, r.a), 1, CAST(m - r.a AS INT))"
    inner = _let(
        "t",
        f"struct({total(ups, up)} AS u, {total(downs, down)} AS d)",
        _let("v", f"{uniform} * (1D + t.u + t.d)", f"CASE WHEN v < 1D THEN m WHEN v < 1D + t.u THEN {walk(ups, up, '1D', 'i + 1')} ELSE {walk(downs, down, '1D + t.u', 'i - 1')} END"),
    )
    spread = "CAST(12 + ceil(12 * sqrt(z.n * (z.k / greatest(z.p, 1D)) * (1 - z.k / greatest(z.p, 1D)) * greatest(z.p - z.n, 0D) / greatest(z.p - 1, 1D))) AS BIGINT)"
    bounded = _let("r", f"struct(greatest(CAST(greatest(0D, z.n - (z.p - z.k)) AS BIGINT), m - {spread}) AS a, least(CAST(least(z.k, z.n) AS BIGINT), m + {spread}) AS b)", inner)
    moded = _let("m", "CAST(floor((z.n + 1) * (z.k + 1) / (z.p + 2)) AS BIGINT)", bounded)
    return _let("z", f"struct(CAST({population} AS DOUBLE) AS p, CAST({marked} AS DOUBLE) AS k, CAST({drawn} AS DOUBLE) AS n)", moded)


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(shard, quota array) of one row `quotas` (an array, by source): the leaves of the splitting tree."""
    nodes = quotas.selectExpr("0 AS first", f"{shards} AS till", "quotas")
    uniform = f"(CAST(conv(left(md5(concat_ws(':', {seed}, first, till, size(s.xs))), 13), 16, 10) AS DOUBLE) / {1 << 52}D)"
    draw = _let("x", hypergeometric_sql("s.p", "q", "s.n", uniform), "struct(s.p - q AS p, s.n - x AS n, array_append(s.xs, x) AS xs)")
    total = "aggregate(quotas, 0L, (s, q) -> s + q)"
    left_of = f"aggregate(quotas, struct({total} AS p, CAST(round({total} * CAST(half AS DOUBLE) / (till - first)) AS BIGINT) AS n, CAST(array() AS ARRAY<BIGINT>) AS xs), (s, q) -> {draw}, s -> s.xs)"
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        halved = nodes.selectExpr("*", "(till - first) div 2 AS half").selectExpr("*", f"CASE WHEN half > 0 THEN {left_of} END AS taken")
        nodes = halved.selectExpr(
            "inline(CASE WHEN half = 0 THEN array(struct(first, till, quotas)) ELSE array("
            "struct(first, CAST(first + half AS INT) AS till, taken AS quotas), struct(CAST(first + half AS INT) AS first, till, zip_with(quotas, taken, (q, x) -> q - x) AS quotas)) END)"
        )
    return nodes.selectExpr("first AS shard", "quotas")


def _plan(sources: DataFrame, block: int, shards: int, seed: int) -> DataFrame:
    """(source_no, block, shard): every block of every source, dealt by the leaves' quotas in a permuted order."""
    counted = sources.selectExpr("source_no", f"CAST(ceil(quota / {block}) AS BIGINT) AS blocks")
    vector = counted.agg(F.array_sort(F.collect_list(F.struct("source_no", "blocks"))).alias("v")).selectExpr("transform(v, s -> s.blocks) AS quotas")
    leaves = split_quotas(vector, shards, seed).selectExpr("shard", "posexplode(quotas) AS (at, quota)")
    dealt = leaves.selectExpr("at + 1 AS source_no", "shard", "quota", "sum(quota) OVER (PARTITION BY at ORDER BY shard) - quota AS before").filter("quota > 0")
    dealt = dealt.selectExpr("source_no", "shard", "explode(sequence(before, before + quota - 1)) AS turn")
    blocks = counted.filter("blocks > 0").selectExpr("source_no", "explode(sequence(0L, blocks - 1)) AS block")
    turns = blocks.selectExpr("source_no", "block", f"CAST(row_number() OVER (PARTITION BY source_no ORDER BY md5(concat_ws(':', {seed}, source_no, block)), block) - 1 AS BIGINT) AS turn")
    return turns.join(dealt, ["source_no", "turn"]).select("source_no", "block", "shard")


def dealt(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """What each dealt block has of each document and epoch: doc_id, row_key, source_no, pos, size, source_size, target, epoch, block, words, shard; a row without block and shard for documents that no block reaches.

    (source_no, pos) names a row of `docs`. Words are taken only where a shard got their block.
    """
    sizes = saved(sized(docs))
    sources = saved(targets(sizes, weights, max_epochs))
    number, total = sources.agg(F.count("*"), F.coalesce(F.sum("quota"), F.lit(0))).first()
    if not number:
        return sizes.selectExpr("doc_id", "row_key", "0 AS source_no", "0L AS pos", "size", "0L AS source_size", "0D AS target", "0 AS epoch", "0L AS block", "0L AS words", "0 AS shard")
    block = max(LEAST_BLOCK, -(-total // MAX_BLOCKS))
    named = sizes.join(checked_broadcast(sources.withColumnRenamed("source", "name"), number), F.expr("source <=> name"))
    rows, alike = sizes.count(), "sum(alike)"
    digits = BIN_DIGITS
    while rows > BIN_ROWS * 16**digits:
        digits += 1
    # rows alike share a place, so they are one row here, and follow each other
    binned = named.withColumn("bin", F.substring("place", 1, digits)).groupBy("source_no", "bin", "place", "doc_id", "row_key", "size", "source_size", "target", "quota").agg(F.count("*").alias("alike"))
    inside = "OVER (PARTITION BY source_no, bin ORDER BY place, doc_id, row_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    placed = saved(binned.selectExpr("*", f"sum(size * alike) {inside} - size * alike AS words_in", f"{alike} {inside} - alike AS rows_in"))
    bins = placed.groupBy("source_no", "bin").agg(F.sum(F.col("size") * F.col("alike")).alias("words"), F.sum("alike").alias("rows"))
    over = "OVER (PARTITION BY source_no ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    bins = bins.selectExpr("source_no", "bin", f"sum(words) {over} - words AS words_before", f"sum(rows) {over} - rows AS rows_before")
    parted = placed.join(bins, ["source_no", "bin"]).withColumn("some", F.explode(F.expr(f"sequence(0L, (alike - 1) div {ALIKE_ROWS})")))
    if placed.filter(F.col("alike") > ALIKE_ROWS).count():
        parted = parted.repartition("source_no", "place", "some")
    each = parted.withColumn("nth", F.explode(F.expr(f"sequence(some * {ALIKE_ROWS}, least(alike, (some + 1) * {ALIKE_ROWS}) - 1)")))
    started = each.selectExpr("*", "words_before + words_in + nth * size AS start", "rows_before + rows_in + nth AS pos")
    till = "least(e * source_size + start + size, quota)"
    cuts = f"transform(sequence((e * source_size + start) div {block}, ({till} - 1) div {block}), b -> struct(e AS epoch, b AS block, least({till}, (b + 1) * {block}) - greatest(e * source_size + start, b * {block}) AS words))"
    pieces = f"flatten(transform(filter(sequence(0, {max_epochs - 1}), e -> size > 0 AND e * source_size + start < quota), e -> {cuts}))"
    pieces = started.selectExpr("doc_id", "row_key", "source_no", "pos", "size", "source_size", "target", f"inline_outer({pieces})")
    plan = saved(_plan(sources, block, shards, seed))
    return pieces.join(checked_broadcast(plan), ["source_no", "block"], "left").selectExpr("doc_id", "row_key", "source_no", "pos", "size", "source_size", "target", "epoch", "block", "words", "shard")


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document and epoch that takes words of it: doc_id, row_key, source_no, pos, size, epoch, taken, shard (of its first block) and shuffle_key."""
    some = dealt(docs, **options).filter("shard IS NOT NULL").groupBy("source_no", "pos", "epoch", "doc_id", "row_key", "size")
    out = some.agg(F.sum("words").alias("taken"), F.min_by("shard", "block").alias("shard"))
    return out.withColumn("shuffle_key", F.xxhash64(F.lit(options.get("seed", SEED)), "source_no", "pos", "epoch"))


def takes(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes of each row of `docs`: doc_id, size, source_size, target, taken, copies begun, and the shards that have words of it, in order."""
    rows = dealt(docs, **options).groupBy("source_no", "pos", "doc_id", "size", "source_size", "target")
    has = F.col("shard").isNotNull()
    out = rows.agg(
        F.coalesce(F.sum(F.when(has, F.col("words"))), F.lit(0)).alias("taken"),
        F.size(F.collect_set(F.when(has, F.col("epoch")))).cast("bigint").alias("copies"),
        F.array_join(F.transform(F.array_sort(F.collect_set("shard")), lambda s: s.cast("string")), ",").alias("shards"),
    )
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")


def mixed_documents(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """The rows of `docs` as often as the mix takes them whole (at least half of it at the cut), by shard and shuffled in it."""
    taken = mix(docs, shards=shards, **options).filter("2 * taken >= size")
    pieces = saved(taken.selectExpr("row_key AS _mix_key", "source_no", "pos", "epoch", "taken", "shard AS _mix_shard", "shuffle_key AS _mix_order"))
    parts = max(1, -(-(pieces.agg(F.sum("taken")).first()[0] or 0) // (shards * TASK_WORDS)))
    keyed = docs.withColumn("_mix_row", F.xxhash64(docs["doc_id"], docs["text"]))
    repeated = saved(pieces.filter("epoch = 0").groupBy("_mix_key").agg(F.count("*").alias("_mix_rows")).filter("_mix_rows > 1"))
    again = repeated.count()
    if again:  # rows alike in doc_id and text: the n-th of them in the mix meets the n-th in the table
        pieces = pieces.selectExpr("*", "dense_rank() OVER (PARTITION BY _mix_key ORDER BY source_no, pos) AS _mix_turn")
        side = checked_broadcast(repeated, again)
        met = F.col("_mix_row") == F.col("_mix_key")
        others = ", ".join(f"to_json(struct(`{c}`))" for c in docs.columns if c != "text")
        alike = keyed.join(side, met, "left_semi").withColumn("_mix_nth", F.expr(f"row_number() OVER (PARTITION BY _mix_row ORDER BY {others})"))
        keyed = keyed.join(side, met, "left_anti").withColumn("_mix_nth", F.lit(1)).unionByName(alike)
    else:
        keyed, pieces = keyed.withColumn("_mix_nth", F.lit(1)), pieces.withColumn("_mix_turn", F.lit(1))
    pieces = pieces.drop("source_no", "pos", "epoch", "taken")
    found = keyed.join(checked_broadcast(pieces), F.expr("_mix_row = _mix_key AND _mix_nth = _mix_turn"))
    shuffled = found.repartition(shards * parts, F.col("_mix_shard"), F.expr(f"pmod(_mix_order, {parts})")).sortWithinPartitions("_mix_shard", "_mix_order")
    return shuffled.select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, row_number() OVER () AS row_no, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS place FROM documents
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS no, sum(source_size) OVER () AS total
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)
), weighed AS (
  SELECT *, CAST([5, 2, 1][CAST((no - 1) % 3 AS INT) + 1] AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS most FROM ranked
), levels AS (
  SELECT *, most / weight AS full_at,
    (total - coalesce(sum(most) OVER (ORDER BY most / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), settled AS (
  SELECT *, max(CASE WHEN level <= full_at THEN level END) OVER () AS water FROM levels
), targets AS (
  SELECT no, source, source_size, least(most, coalesce(water, 0) * weight) AS exact FROM settled
), numbered AS (
  SELECT no, source, source_size, exact, CAST(round(exact) AS BIGINT) AS quota FROM targets
), plan AS (
  SELECT *, greatest(4096, CAST(ceil(sum(quota) OVER () / 65536.0) AS BIGINT)) AS block FROM numbered
), blocks AS (
  SELECT no, block, CAST(ceil(quota / block) AS BIGINT) AS n FROM plan
), start_ AS (
  SELECT list(n ORDER BY no) AS quotas FROM blocks
), tree AS (
  -- a node's shards first..till, its quotas by source, and how far its left part has been drawn: the next source, what is left to draw from, to draw, and what was drawn
  SELECT 0 AS first, 64 AS till, quotas, 1 AS s, list_sum(quotas) AS p, round(list_sum(quotas) * 32 / 64.0) AS n, CAST([] AS BIGINT[]) AS xs FROM start_
  UNION ALL
  SELECT r.first, r.till, r.quotas, r.s, r.p, r.n, r.xs FROM (
    SELECT unnest(CASE WHEN s <= len(quotas) THEN [{'first': first, 'till': till, 'quotas': quotas, 's': s + 1, 'p': p - quotas[s], 'n': n - x, 'xs': list_append(xs, x)}]
      ELSE [{'first': first, 'till': first + half, 'quotas': xs, 's': 1, 'p': list_sum(xs), 'n': round(list_sum(xs) * (half // 2) / CAST(half AS DOUBLE)), 'xs': CAST([] AS BIGINT[])},
            {'first': first + half, 'till': till, 'quotas': [a[1] - a[2] for a in list_zip(quotas, xs)], 's': 1, 'p': list_sum(quotas) - list_sum(xs), 'n': round((list_sum(quotas) - list_sum(xs)) * (half // 2) / CAST(half AS DOUBLE)), 'xs': CAST([] AS BIGINT[])}] END) AS r
    FROM (
      -- inversion of the hypergeometric law: the mode, then upwards, then downwards
      SELECT *, walk[1 + len([i for i in range(1, len(walk)) if list_sum(w[1:i]) <= u * list_sum(w)])] AS x FROM (
        SELECT *, [exp(lgamma(k + 1) - lgamma(y + 1) - lgamma(k - y + 1) + lgamma(p - k + 1) - lgamma(n - y + 1) - lgamma(p - k - n + y + 1)
          - (lgamma(k + 1) - lgamma(m + 1) - lgamma(k - m + 1) + lgamma(p - k + 1) - lgamma(n - m + 1) - lgamma(p - k - n + m + 1))) for y in walk] AS w FROM (
          SELECT *, list_concat([m], range(m + 1, CAST(least(k, n) AS BIGINT) + 1), list_reverse(range(CAST(greatest(0, n - (p - k)) AS BIGINT), m))) AS walk FROM (
            SELECT *, CAST(floor((n + 1) * (k + 1) / (p + 2.0)) AS BIGINT) AS m, CAST('0x' || substr(md5(concat_ws(':', 20, first, till, s - 1)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM (
              SELECT *, (till - first) // 2 AS half, coalesce(quotas[s], 0) AS k FROM tree WHERE till - first > 1))))
      )
    )
), leaves AS (
  SELECT first AS shard, unnest(range(1, len(quotas) + 1)) AS no, unnest(quotas) AS quota FROM tree WHERE till - first = 1
), shares AS (
  SELECT shard, no, quota, sum(quota) OVER (PARTITION BY no ORDER BY shard) - quota AS before FROM leaves
), turns AS (
  SELECT no, b, row_number() OVER (PARTITION BY no ORDER BY md5(concat_ws(':', 20, no, b)), b) - 1 AS turn FROM (SELECT no, unnest(range(n)) AS b FROM blocks)
), dealt AS (
  SELECT t.no, t.b, s.shard FROM turns t JOIN shares s ON s.no = t.no AND t.turn >= s.before AND t.turn < s.before + s.quota
),
placed AS (
  SELECT s.doc_id, s.size, t.no, t.source_size, t.exact, t.quota, t.block,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - s.size AS start
  FROM sized s JOIN plan t ON s.source IS NOT DISTINCT FROM t.source
), epochs AS (
  SELECT *, e * source_size + start AS first, least(e * source_size + start + size, quota) AS till FROM placed, (VALUES (0), (1), (2)) v(e) WHERE size > 0 AND e * source_size + start < quota
), pieces AS (
  SELECT *, unnest(range(first // block, (till - 1) // block + 1)) AS b FROM epochs
), words AS (
  SELECT p.doc_id, p.no, p.start, p.e, least(p.till, (p.b + 1) * p.block) - greatest(p.first, p.b * p.block) AS words, d.shard
  FROM pieces p JOIN dealt d ON d.no = p.no AND d.b = p.b
), summed AS (
  SELECT doc_id, no, start, CAST(sum(words) AS BIGINT) AS taken, count(DISTINCT e) AS copies, array_to_string(list_sort(list(DISTINCT shard)), ',') AS shards FROM words GROUP BY ALL
)
SELECT p.doc_id, p.size, p.source_size, round(p.exact, 6) AS target, coalesce(w.taken, 0) AS taken, coalesce(w.copies, 0) AS copies, coalesce(w.shards, '') AS shards
FROM placed p LEFT JOIN summed w ON w.doc_id IS NOT DISTINCT FROM p.doc_id AND w.no = p.no AND w.start = p.start AND p.size > 0
"""
