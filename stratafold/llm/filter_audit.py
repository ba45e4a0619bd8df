"""How five document filters interact, from the counts of documents that fail them together.

One pass over the texts decides filters A to D and takes each text's SHA-256;
filter E (a copy of a text with a smaller id) then needs only digests and ids.
Rows alike in digest, id and part are counted together before anything else, so
a text with millions of copies is one row per copy's id and, a step later, one
row per part. What is left are counts per (part, failed filters, labels), at most
128 rows a part, from which a grouped sum of flag products gives J(S), the
documents that fail every filter of S, for all 32 sets S.

Everything asked follows from J by inclusion-exclusion:

- survivors of a set T: the Moebius inversion sum over S within T of (-1)^|S| J(S);
- removed by a filter after others: the difference of two survivor counts;
- unique failures of f: survivors of all filters but f, less the survivors of all;
- the Harsanyi dividend of S in the game "documents removed by T" is
  (-1)^(|S|+1) J(S), and f's Shapley value shares it evenly among S's filters.
  Over all 120 orders that is 120 / |S|, a whole number, so all is exact.

Defined cases: null text is the empty text (words 0, so A fails; B and C do not);
null source is the part ''; a null id has no smaller id, is no smaller id of
another row, and has no label, so such rows never fail E; rows alike in id and
text are no copies of each other; a document with several label rows is good or
toxic if one says so; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm.arrowtext import bound_batches, slices, text_column, words_of
from stratafold.llm.shared import checked_broadcast, saved

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITAL_PERCENT = 200, 50, 2
MARKS = "[#$%&*|]"
TEXT_FLAGS = "doc_id long, part string, digest binary, a boolean, b boolean, c boolean, d boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), *((c, pa.bool_()) for c in "abcd")])
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

SETS = np.arange(1 << len(FILTERS))
SIZE = np.array([int(s).bit_count() for s in SETS])
#: survivors = MOEBIUS @ J: (-1)^|S| where S lies within T.
MOEBIUS = np.where((SETS[:, None] & SETS[None, :]) == SETS[None, :], 1 - 2 * (SIZE[None, :] % 2), 0).astype(np.int64)
#: Shapley sums over all orders = SHARES @ J: the dividend of S, shared among its filters.
SHARES = np.array([[(1 if SIZE[s] % 2 else -1) * 120 // SIZE[s] if s >> f & 1 else 0 for s in SETS] for f in range(len(FILTERS))], np.int64)


def text_flags(texts: pa.Array) -> dict[str, np.ndarray]:
    """Which of filters A to D each text fails."""
    words = words_of(texts)
    count = np.diff(words.begin)
    owner = words.owner()
    seen = np.unique(owner * max(len(words.distinct), 1) + words.index)
    distinct = np.bincount(seen // max(len(words.distinct), 1), minlength=len(texts)) if len(seen) else np.zeros(len(texts), np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    at = np.flatnonzero((data >= 65) & (data <= 90))
    capitals = np.diff(np.searchsorted(at, offsets - offsets[0]))
    length = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return {
        "a": count < LEAST_WORDS,
        "b": 100 * distinct < LEAST_DISTINCT_PERCENT * count,
        "c": 100 * capitals > MOST_CAPITAL_PERCENT * length,
        "d": pc.match_substring_regex(texts, MARKS).to_numpy(zero_copy_only=False),
    }


def flagged(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per row: id, part, the text's digest and the filters A to D that it fails."""
    bound_batches(docs.sparkSession)

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            for first, count in slices(texts):
                own = texts.slice(first, count)
                found = text_flags(own)
                digests = pa.array([hashlib.sha256(t.as_buffer()).digest() for t in own.cast(pa.binary())], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, count), batch.column("part").slice(first, count), digests, *(pa.array(found[c]) for c in "abcd")], schema=_ARROW)

    source = docs.select(docs[doc_col].cast("long").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(flags, TEXT_FLAGS)


def outcomes(docs: DataFrame, labels: DataFrame, doc_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Documents by part, failed filters (columns a to e, 0 or 1) and labels (good, toxic): at most 128 rows a part."""
    rows = saved(flagged(docs, doc_col, text_col, part_col).groupBy("digest", "doc_id", "part", "a", "b", "c", "d").agg(F.count("*").alias("n")))
    known = saved(labels.filter(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(F.max(F.coalesce(labels["quality"] == 1, F.lit(False))).alias("good"), F.max(F.coalesce(labels["toxic"] == 1, F.lit(False))).alias("toxic")))
    # rows without an id have no label and fail no E: they need neither join nor digest
    named, nameless = rows.filter(F.col("doc_id").isNotNull()), rows.filter(F.col("doc_id").isNull())
    marked = named.join(checked_broadcast(known), "doc_id", "left").select("digest", "doc_id", "part", "a", "b", "c", "d", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    # per text, part and labels: how many rows, and the least id with its rows (ids differ here, so the least has one count)
    met = saved(marked.groupBy("digest", "part", "a", "b", "c", "d", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first")))
    least = met.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    firsts = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    parted = met.join(least, "digest").withColumn("firsts", firsts)
    keys = ["part", "a", "b", "c", "d", "good", "toxic"]
    no = F.lit(False)
    every = (
        parted.select(*keys, F.explode(F.array(F.struct(no.alias("e"), F.col("firsts").alias("n")), F.struct(F.lit(True).alias("e"), (F.col("n") - F.col("firsts")).alias("n")))).alias("x")).select(*keys, "x.e", "x.n")
        .unionByName(nameless.select("part", "a", "b", "c", "d", no.alias("good"), no.alias("toxic"), no.alias("e"), "n"))
    )
    ints = [F.col(c).cast("int").alias(c) for c in "abcde"]
    return every.groupBy("part", *"abcde", "good", "toxic").agg(F.sum("n").alias("n")).select("part", *ints, "good", "toxic", "n")


def joint_failures(found: DataFrame) -> DataFrame:
    """Per part: `every`, `good` and `toxic`, arrays of 32 counts of documents that fail all filters of a set (bit 0: A)."""

    def products(weight: Column) -> Column:
        sums = []
        for s in SETS:
            flags = [F.col(c) for i, c in enumerate("abcde") if s >> i & 1]
            product = weight
            for flag in flags:
                product = product * flag
            sums.append(F.sum(product))
        return F.array(*sums)

    n = F.col("n")
    return found.groupBy("part").agg(products(n).alias("every"), products(n * F.col("good").cast("int")).alias("good"), products(n * F.col("toxic").cast("int")).alias("toxic"))


def audited(joint: DataFrame) -> DataFrame:
    """Every order of the filters, step by step, from the joint failures alone."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for i, f in enumerate(order):
            steps.append(("".join(FILTERS[x] for x in order), i + 1, f, before))
            before |= 1 << f
    names, places = [s[0] for s in steps], [s[1] for s in steps]
    own, before = np.array([s[2] for s in steps]), np.array([s[3] for s in steps])
    after = before | 1 << own
    all_but, everything = len(SETS) - 1 - (1 << own), len(SETS) - 1

    def audit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, every, good, toxic in zip(frame["part"], frame["every"], frame["good"], frame["toxic"]):
                every, good, toxic = (np.asarray(x, np.int64) for x in (every, good, toxic))
                left, left_good, left_toxic = MOEBIUS @ every, MOEBIUS @ good, MOEBIUS @ toxic
                removed = left[before] - left[after]
                yield pd.DataFrame({
                    "part": part, "filter_order": names, "step": places, "kept": left[after], "removed": removed,
                    "redundant": every[1 << own] - removed, "unique_fails": left[all_but] - left[everything],
                    "good_lost": left_good[before] - left_good[after], "toxic_lost": left_toxic[before] - left_toxic[after], "shapley": (SHARES @ every)[own],
                })

    return joint.mapInPandas(audit, AUDIT)


def audit(docs: DataFrame, labels: DataFrame, doc_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step. See the module's text."""
    return audited(joint_failures(outcomes(docs, labels, doc_col, text_col, part_col)))


ORACLE = f"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (
  SELECT *, [w FOR w IN string_split_regex(text, '[\\x20\\x09-\\x0D]+') IF w <> ''] AS words FROM texts),
firsts AS (SELECT text, min(doc_id) AS least FROM texts GROUP BY text),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT w.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    (len(words) < {LEAST_WORDS})::INT AS a, (100 * len(list_distinct(words)) < {LEAST_DISTINCT_PERCENT} * len(words))::INT AS b,
    (100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > {MOST_CAPITAL_PERCENT} * length(w.text))::INT AS c,
    regexp_matches(w.text, '{MARKS}')::INT AS d, coalesce(w.doc_id > f.least, false)::INT AS e
  FROM worded w JOIN firsts f ON w.text = f.text LEFT JOIN marks m ON w.doc_id = m.doc_id),
classes AS (
  SELECT part, good, toxic, count(*) AS n,
    CASE WHEN a = 1 THEN 'A' ELSE '' END || CASE WHEN b = 1 THEN 'B' ELSE '' END || CASE WHEN c = 1 THEN 'C' ELSE '' END || CASE WHEN d = 1 THEN 'D' ELSE '' END || CASE WHEN e = 1 THEN 'E' ELSE '' END AS failset
  FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
gone AS (
  SELECT c.part, o.filter_order, c.good, c.toxic, c.failset, c.n,
    CASE WHEN c.failset = '' THEN 9 ELSE list_min([instr(o.filter_order, l) FOR l IN string_split(c.failset, '')]) END AS gone_at
  FROM classes c CROSS JOIN orders o),
audit AS (
  SELECT g.part, g.filter_order, s.step, substr(g.filter_order, s.step, 1) AS letter,
    sum(CASE WHEN gone_at > s.step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone_at = s.step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone_at < s.step AND contains(failset, substr(g.filter_order, s.step, 1)) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failset = substr(g.filter_order, s.step, 1) THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN gone_at = s.step AND good = 1 THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN gone_at = s.step AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
  FROM gone g JOIN steps s ON g.filter_order = s.filter_order GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM audit
"""
