"""Phrase collocations per language from suffix automata of shards.

Each task cuts its texts into shards of bounded size and builds one generalised
suffix automaton per shard over the words of all pieces, down to DEPTH words,
level by level in numpy: a node of level k is one distinct phrase, known by its
suffix (its suffix link) and its prefix of level k - 1; its endpos count is the
number of places where it ends. Phrases whose endpos are those of a longer one
are one state with it. Links stop at infrequent phrases: a phrase can only be
frequent if its suffix and prefix are, so levels are counted in turn, one word,
two, then three and four, by grouped sums over 40-bit keys that the automata send
(BUCKETS rows a shard: 13 bits name the row, 27 bits and a count fill an int each),
and keys of frequent phrases set bits in a filter of a fixed FILTER_BITS. The filter
may let too much through (keys that collide, or more phrases than it has bits), never
too little. The last pass sends the phrases themselves, by states, and their exact
sums decide. The work of each level grows with the input; nothing is kept by a
share, a sample or a cap.

A candidate is dropped if a longer candidate around it has LEAST_COVER of its
count. Counts fall along a chain of extensions, so it is enough to look at those by
one word: each candidate tells its suffix link and its prefix its count.

Defined cases: null text is the empty text; null lang is `und`; repeated rows and
rows without an id count each; an empty table gives no rows, as does a language
without candidates; words longer than a shard are whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratafold.llm.arrowtext import bound_batches, give_back, mixed, slices, text_column, word_hashes
from stratafold.llm.packing import gathered
from stratafold.llm.shared import saved

DEPTH, LEAST, TOP = 4, 30, 2000
SCALE, LEAST_COVER = 2_000_000, (80, 100)
#: Bytes of text in one automaton, and bits of the filter (16 MB, in the driver and each task).
SHARD, FILTER_BITS = 8 << 20, 1 << 27
#: Rows of a shard's keys, by their highest bits; the bits after them, and those of the count that is sent beside.
BUCKETS, LOW_BITS, COUNT_BITS = 1 << 13, 27, 5
#: Parts in which a language's best are looked for first.
TOP_PARTS = 64
BREAKS = ".,;:!?\n\v\f\r"
BLANKS = " \t"
_SEED = 0x9E3779B97F4A7C15


@dataclass
class Tokens:
    """Words of a shard: `index` into `distinct`, `piece` and `text` of each; `counted` is False for words repeated from the shard before."""

    distinct: pa.Array
    index: np.ndarray
    piece: np.ndarray
    text: np.ndarray
    counted: np.ndarray


_OUTSIDE = np.zeros(256, bool)
_OUTSIDE[[ord(c) for c in BREAKS + BLANKS]] = True


def tokens_of(texts: pa.Array, repeated: int = 0) -> Tokens:
    """Lower-cased words of each text with their pieces; the first `repeated` words of the first text do not count."""
    texts = pc.ascii_lower(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    if low == high:
        none = np.empty(0, np.int64)
        return Tokens(pa.array([], pa.string()), none, none, none, none.astype(bool))
    outside = _OUTSIDE[np.frombuffer(texts.buffers()[2], np.uint8)[low:high]]
    cut = ~outside
    cut[1:] &= outside[:-1]
    cut[offsets[:-1][np.diff(offsets) > 0] - low] = True
    starts = np.flatnonzero(cut) + low
    ends = pa.py_buffer(np.append(starts, high).astype(np.int32).tobytes())
    coded = pa.Array.from_buffers(pa.string(), len(starts), [None, ends, texts.buffers()[2]]).dictionary_encode()
    # a distinct chunk is a word and what follows it; only a text's first chunk may have no word
    words = pc.ascii_rtrim(coded.dictionary, BREAKS + BLANKS).dictionary_encode()
    breaks = pc.match_substring_regex(coded.dictionary, f"[{BREAKS}]").to_numpy(zero_copy_only=False)
    chunk = coded.indices.to_numpy(zero_copy_only=False)
    text = np.searchsorted(offsets, starts, side="right") - 1
    ended = np.ones(len(chunk), bool)
    ended[:-1] = breaks[chunk[:-1]] | (text[1:] != text[:-1])
    piece = np.cumsum(np.concatenate(([False], ended[:-1])))
    index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)[chunk]
    full = pc.binary_length(words.dictionary).to_numpy()[index] > 0
    counted = np.ones(int(full.sum()), bool)
    counted[:repeated] = False
    return Tokens(words.dictionary, index[full], piece[full], text[full], counted)


def shards(texts: pa.Array, limit: int = SHARD) -> Iterator[tuple[np.ndarray, Tokens]]:
    """(rows of the texts, their words) of shards of about `limit` bytes; a longer text is cut between words, and its shards overlap by DEPTH - 1 words that count once."""
    for first, count in slices(texts, limit):
        own = texts.slice(first, count)
        if count > 1 or len(own[0].as_buffer() or b"") <= limit:
            yield np.arange(first, first + count), tokens_of(own)
            continue
        data = np.frombuffer(own[0].as_buffer(), np.uint8)
        at, before = 0, []
        while at < len(data):
            end = min(at + limit, len(data))
            while end < len(data):  # go on to the end of a word
                outside = _OUTSIDE[data[end - 1 : end + limit]]
                near = np.flatnonzero(outside[1:] & ~outside[:-1])
                if len(near):
                    end += int(near[0])
                    break
                end = min(end + limit, len(data))
            part = " ".join(before) + data[at:end].tobytes().decode()
            found = tokens_of(pa.array([part]), len(before))
            yield np.full(1, first), found
            own_piece = np.flatnonzero(found.piece == found.piece[-1:])[-(DEPTH - 1) :]
            before = found.distinct.take(pa.array(found.index[own_piece])).to_pylist()
            at = end


@dataclass
class Level:
    """Distinct phrases of one length: key, endpos count, suffix link and prefix (nodes of the level above), and one place where each ends."""

    key: np.ndarray
    count: np.ndarray
    link: np.ndarray
    prefix: np.ndarray
    end: np.ndarray


class SuffixAutomaton:
    """Levels 1 to `depth` of a shard's phrases that the filter lets through; levels above `filtered` keep all phrases with suffix and prefix."""

    def __init__(self, tokens: Tokens, group: np.ndarray, group_hash: np.ndarray, depth: int, bits: np.ndarray | None, filtered: int):
        self.tokens, self.levels = tokens, []
        if not len(tokens.index):
            return
        word = word_hashes(tokens.distinct)
        one = len(tokens.distinct)
        at = self._level(group * one + tokens.index, np.ones(len(tokens.index), bool), np.full(len(tokens.index), -1), 0, word, group_hash[group], bits if filtered >= 1 else None)
        for k in range(2, depth + 1):
            ok = np.zeros(len(at), bool)
            ok[1:] = (at[1:] >= 0) & (at[:-1] >= 0)
            if k == 2:
                ok[1:] &= tokens.piece[1:] == tokens.piece[:-1]
            if not ok.any():
                return
            ends = np.flatnonzero(ok)
            code = np.zeros(len(at), np.int64)
            code[ends] = at[ends - 1] * len(self.levels[-1].key) + at[ends]
            at = self._level(code, ok, at, k - 1, word, None, bits if filtered >= k else None)

    def _level(self, code: np.ndarray, ok: np.ndarray, above: np.ndarray, k: int, word: np.ndarray, seed: np.ndarray | None, bits: np.ndarray | None) -> np.ndarray:
        """Add a level of the phrases that `code` tells apart where `ok`; the node at each place, -1 for none."""
        ends = np.flatnonzero(ok)
        _, first, inverse = np.unique(code[ends], return_index=True, return_inverse=True)
        count = np.bincount(inverse, weights=self.tokens.counted[ends], minlength=len(first)).astype(np.int64)
        end = ends[first]
        link, prefix = (above[end], above[end - 1]) if k else (np.full(len(end), -1),) * 2
        start = seed[end] if k == 0 else self.levels[-1].key[prefix]
        key = mixed(start * np.uint64(_SEED) + word[self.tokens.index[end]] + np.uint64(k + 1))
        at = np.full(len(code), -1)
        kept = np.ones(len(end), bool) if bits is None else holds(bits, key)
        number = np.where(kept, np.cumsum(kept) - 1, -1)
        at[ends] = number[inverse]
        self.levels.append(Level(key[kept], count[kept], link[kept], prefix[kept], end[kept]))
        return at

    def states(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length of the longest phrase, lengths of the shortest, nodes) of states: phrases with the same endpos, each the suffix of the next."""
        shortest = [np.full(len(level.key), k + 1) for k, level in enumerate(self.levels)]
        joined = [np.zeros(len(level.key), bool) for level in self.levels]
        for k in range(1, len(self.levels)):
            above, own = self.levels[k - 1], self.levels[k]
            same = own.count == above.count[own.link]
            # at most one extension to the left has all of a phrase's places, unless none counts
            shortest[k][same] = shortest[k - 1][own.link[same]]
            joined[k - 1][own.link[same]] = True
        for k, level in enumerate(self.levels):
            nodes = np.flatnonzero(~joined[k] & (level.count > 0))
            yield k + 1, shortest[k][nodes], nodes

    def phrases(self, k: int, nodes: np.ndarray) -> pa.Array:
        """The phrases of nodes of length k."""
        end = self.levels[k - 1].end[nodes]
        columns = [self.tokens.distinct.take(pa.array(self.tokens.index[end - k + 1 + j])) for j in range(k)]
        return pc.binary_join_element_wise(*columns, " ") if k > 1 else columns[0]


def _low(key: np.ndarray) -> np.ndarray:
    """The LOW_BITS bits of a key behind those of its bucket."""
    return key >> np.uint64(64 - LOW_BITS - (BUCKETS - 1).bit_length()) & np.uint64((1 << LOW_BITS) - 1)


def packed_keys(key: np.ndarray, count: np.ndarray, unit: int) -> tuple[np.ndarray, pa.Array]:
    """(buckets, ints of each): a key's low bits above its count in units, rounded up and cut where one shard alone makes a phrase frequent."""
    order = np.argsort(key)
    key = key[order]
    units = np.minimum(-(-count[order] // unit), (1 << COUNT_BITS) - 1)
    values = (_low(key) << np.uint64(COUNT_BITS) | units.astype(np.uint64)).astype(np.uint32).view(np.int32)
    bucket = (key >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int32)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    offsets = pa.array(np.append(first, len(key)).astype(np.int32))
    return bucket[first], pa.ListArray.from_arrays(offsets, pa.array(values))


def holds(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold."""
    bit = _low(key) & np.uint64(64 * len(bits) - 1)
    return (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


def _source(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("string").alias("text"))


def _automata(batches: Iterator[pa.RecordBatch], depth: int, bits: Broadcast | None, filtered: int) -> Iterator[tuple[SuffixAutomaton, np.ndarray, pa.Array]]:
    """(automaton, language of each word, languages) of a task's shards."""
    for batch in gathered(batches):
        langs = batch.column("lang").dictionary_encode()
        code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        hashes = word_hashes(langs.dictionary, 1)
        for rows, tokens in shards(text_column(batch)):
            group = code[rows[tokens.text]]
            yield SuffixAutomaton(tokens, group, hashes, depth, None if bits is None else bits.value, filtered), group, langs.dictionary
    give_back()


def _frequent_bits(source: DataFrame, depths: tuple[int, ...], bits: np.ndarray | None, least: int, size: int) -> np.ndarray:
    """The filter with the phrases of `depths` words added that are frequent."""
    spark = source.sparkSession
    known = None if bits is None else spark.sparkContext.broadcast(bits)

    unit = -(-least // ((1 << COUNT_BITS) - 1))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for automaton, _, _ in _automata(batches, max(depths), known, min(depths) - 1):
            for level in (automaton.levels[k - 1] for k in depths if k <= len(automaton.levels)):
                met = level.count > 0
                yield pa.RecordBatch.from_arrays(list(packed_keys(level.key[met], level.count[met], unit)), ["bucket", "keys"])

    sent = source.mapInArrow(send, "bucket int, keys array<int>").repartition("bucket").select("bucket", F.explode("keys").alias("x"))
    low = F.shiftrightunsigned("x", COUNT_BITS)
    summed = sent.groupBy("bucket", low.alias("low")).agg(F.sum(F.col("x").bitwiseAND((1 << COUNT_BITS) - 1)).alias("units")).filter(F.col("units") * unit >= least)
    bit = F.col("low").bitwiseAND(size - 1)
    found = summed.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63))).alias("bits"))
    rows = found.toArrow()  # at most a row for 64 bits of the filter
    out = np.zeros(size // 64, np.uint64) if bits is None else bits
    out[rows.column("word").to_numpy()] |= rows.column("bits").to_numpy().view(np.uint64)
    if known is not None:
        known.destroy()
    return out


def phrase_counts(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of 1 to DEPTH words with at least `least` occurrences, and one row per language with null phrase, 0 words and its number of words."""
    spark = docs.sparkSession
    bound_batches(spark)
    source = _source(docs, text_col, lang_col)
    bits = None
    for depths in ((1,), (2,), (3, 4)):
        bits = _frequent_bits(source, depths, bits, least, filter_bits)
    known = spark.sparkContext.broadcast(bits)
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("shortest", pa.int32()), ("longest", pa.int32()), ("n", pa.int64())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for automaton, group, langs in _automata(batches, DEPTH, known, DEPTH):
            total = np.bincount(group[automaton.tokens.counted], minlength=len(langs))
            zero = pa.array(np.zeros(len(langs), np.int32))
            yield pa.RecordBatch.from_arrays([langs, pa.nulls(len(langs), pa.string()), zero, zero, pa.array(total)], schema=schema)
            for k, shortest, nodes in automaton.states():
                level = automaton.levels[k - 1]
                lang = langs.take(pa.array(group[level.end[nodes]]))
                yield pa.RecordBatch.from_arrays([lang, automaton.phrases(k, nodes), pa.array(shortest.astype(np.int32)), pa.array(np.full(len(nodes), k, np.int32)), pa.array(level.count[nodes])], schema=schema)

    states = source.mapInArrow(send, "lang string, phrase string, shortest int, longest int, n long")
    each = states.select("lang", "phrase", F.explode(F.sequence("shortest", "longest")).alias("words"), "longest", "n")
    suffix = F.when(F.col("words") < F.col("longest"), F.expr("substring_index(phrase, ' ', -words)")).otherwise(F.col("phrase"))
    counts = each.groupBy("lang", suffix.alias("phrase"), "words").agg(F.sum("n").alias("f"))
    return saved(counts.filter((F.col("f") >= least) | (F.col("words") == 0)))


def _exact(c: Column | str) -> Column:
    return F.col(c).cast("decimal(20,0)") if isinstance(c, str) else c.cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", filter_bits: int = FILTER_BITS) -> DataFrame:
    """Each language's first `top` phrases by score: lang, rank, phrase, a, l, r, n, score. See the module's text."""
    if least < 1 or top < 1 or not 64 <= filter_bits <= 1 << LOW_BITS or filter_bits & (filter_bits - 1):
        raise ValueError("least and top are at least 1, filter_bits is a power of two from 64 to 2^LOW_BITS")
    counts = phrase_counts(docs, least, text_col, lang_col, filter_bits)
    totals = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    known = counts.filter("words > 0").select("lang", "phrase", "f")
    candidates = counts.filter("words > 1").withColumnRenamed("f", "a")
    # every candidate tells its suffix link and its prefix its count
    longer = candidates.filter("words > 2").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', 1 - words)"), F.expr("substring_index(phrase, ' ', words - 1)"))).alias("phrase"))
    covered = longer.groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    share, whole = LEAST_COVER
    open_ = F.col("cover").isNull() | (_exact("cover") * F.lit(whole) < _exact("a") * F.lit(share))
    kept = candidates.join(covered, ["lang", "phrase"], "left").filter(open_).drop("cover")
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "words")
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - words)").alias("tail"))
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    met = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    score = F.expr(f"(cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = met.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")
    # two steps, so that no task sorts a whole language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
worded AS (SELECT lang, [w FOR w IN string_split_regex(piece, '[\\x20\\x09]+') IF w <> ''] AS words FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k))),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE k > 1 AND f >= {LEAST}),
covers AS (
  SELECT lang, array_to_string(words[i : i + j - 1], ' ') AS phrase, max(a) AS cover
  FROM (SELECT lang, a, words, j, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM candidates)) GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN covers o ON c.lang = o.lang AND c.phrase = o.phrase
  WHERE o.cover IS NULL OR {LEAST_COVER[1]} * o.cover::HUGEINT < {LEAST_COVER[0]} * c.a::HUGEINT),
cuts AS (
  SELECT lang, phrase, a, c, array_to_string(words[1 : c], ' ') AS head, array_to_string(words[c + 1 : k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)),
scored AS (
  SELECT x.lang, x.phrase, x.a, x.c, h.f AS l, t.f AS r, ({SCALE}::HUGEINT * x.a // (h.f::HUGEINT + t.f))::BIGINT AS score
  FROM cuts x JOIN counts h ON h.lang = x.lang AND h.phrase = x.head JOIN counts t ON t.lang = x.lang AND t.phrase = x.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON r.lang = t.lang WHERE r.rank <= {TOP}
"""
