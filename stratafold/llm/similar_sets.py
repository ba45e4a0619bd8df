"""Exact search for texts whose sets of word shingles have a Jaccard similarity of SIMILARITY or more.

It follows the SimHash search, which finds similar texts only by chance of their
bits. Nothing is estimated; each step leaves out only what cannot be similar.

1. A set that is similar to another shares at least `overlap` of its n shingles
   with it, so in any order of all shingles at least k of its first
   n - overlap + k. Each set asks of so many of its shingles whether another set
   asks of them too (`_asked`), with k a SLACK of n; two similar sets have the lesser
   k of both among their first shingles in common, and a set with fewer is out.
2. The sets left ask of all their shingles; one that shares fewer than `overlap`
   is out. Shingles of many sets are listed on the way.
3. Sets of like size that share one of their first n - overlap + 1 shingles, those
   of many sets last, are one family (k = 1). Families are components of that relation.
4. A family's sets meet in one task, or cut into pieces, in one for each pair of
   pieces; there every pair that could be similar is counted out, unless links
   found before join it (`similar_in_buckets`). Pairs of pieces come in rounds, so
   that disk holds a fixed number of copies of a set however large its family is; a
   family that is one class needs no more of them.

Asking costs a row per range of shingles and run of texts, with its shingles and
sets packed; a shingle that several sets of a run share is answered there and
goes out once, so a shingle that a third of all sets share is as cheap as any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.arrowtext import bound_batches, give_back, mixed, slices, text_column, word_hashes, words_of
from stratafold.llm.components import Forest, components, spanning_forest
from stratafold.llm.shared import checked_broadcast, dropped, saved

WORDS, SIMILARITY = 5, 0.8
#: Share of its shingles that a set must share among its first ones, and shingles that are asked of at a time.
SLACK, AT_ONCE = 0.1, 1 << 20
#: Shingles of a range, on the average.
RANGE = 1 << 19
#: A shingle of more sets goes last, the commonest at the very end; at most so many do.
HOT, HOT_MOST = 20, 500_000
#: Shingles and sets of a piece of a family, about, and pairs that are held at a time.
PIECE, PIECE_SETS, PAIRS_AT_ONCE = 1 << 20, 1 << 12, 1 << 19
#: Offsets between pieces that meet in a round; a set of a cut family is written at most twice for each.
OFFSETS = 4
SLICE = 1 << 20


def shingle_sets(texts: pa.Array, width: int = WORDS) -> list[np.ndarray]:
    """The set of hashes of the shingles of each text, sorted; a text of fewer words has one shingle, one of none an empty set."""
    words = words_of(pc.ascii_lower(texts))
    own = word_hashes(words.distinct)[words.index]
    count = np.diff(words.begin)
    end = np.repeat(words.begin[1:], count)
    at = np.arange(len(own))
    spread = mixed(own)
    for k in range(1, width):
        more = np.flatnonzero(at + k < end)
        spread[more] = mixed(spread[more] * np.uint64(0x9E3779B97F4A7C15) + own[more + k])
    shingles = np.where(count > 0, np.maximum(1, count - width + 1), 0)
    kept = at - np.repeat(words.begin[:-1], count) < np.repeat(shingles, count)
    return [np.unique(s) for s in np.split(spread[kept], np.cumsum(shingles)[:-1])]


def signature(own: np.ndarray) -> np.uint64:
    """A hash of a set."""
    return np.add.reduce(mixed(own), dtype=np.uint64)


def overlap(size: np.ndarray | int) -> np.ndarray:
    """Shingles that a set of `size` shares at least with any similar one."""
    return np.ceil(SIMILARITY * np.asarray(size) - 1e-9).astype(np.int64)


def slack(size: np.ndarray | int) -> np.ndarray:
    return np.maximum(1, np.ceil(SLACK * np.asarray(size) - 1e-9)).astype(np.int64)


PACKED = "range long, kind int, a binary, b binary"


def packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["range", "kind", "a", "b"])


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(range, its rows (kind, a, b)) from batches sorted by range."""
    place, held = None, []
    for batch in batches:
        for r, *row in zip(*(batch.column(c).to_pylist() for c in ("range", "kind", "a", "b"))):
            if r != place and held:
                yield place, held
                held = []
            place = r
            held.append(tuple(row))
    if held:
        yield place, held


class Asker:
    """Shingles asked of by one run of sets, packed by range: rows (range, kind, a, b).

    Kind 0 asks: low halves of shingles and the set of each. Kind 1 tells of
    shingles that several sets of the run share: low halves, and how many. Kind 2
    has what needs no asking: sets and how many shared shingles each has.
    """

    def __init__(self, ranges: int, first: int):
        self.ranges, self.turn = ranges, first
        self.tokens: list[np.ndarray] = []
        self.signs: list[int] = []
        self.seen: set[int] = set()
        self.size = 0

    def add(self, tokens: np.ndarray, sign: int) -> None:
        if sign not in self.seen:
            self.seen.add(sign)
            self.tokens.append(tokens)
            self.signs.append(sign)
            self.size += len(tokens)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.tokens:
            return
        signs = np.repeat(np.asarray(self.signs, np.uint64), list(map(len, self.tokens)))
        tokens = np.concatenate(self.tokens)
        order = np.argsort(tokens)
        tokens, signs = tokens[order], signs[order]
        first = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]) != 0)
        n = np.diff(np.append(first, len(tokens)))
        shared = np.repeat(n > 1, n)
        out = []
        asks, theirs, told, times = tokens[~shared], signs[~shared], tokens[first[n > 1]], n[n > 1].astype("<u4")
        for kind, keys, values in ((0, asks, theirs.astype("<u8")), (1, told, times)):
            place = range_of(keys, self.ranges)
            low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
            edges = np.flatnonzero(np.diff(place, prepend=-1))
            for a, b in zip(edges, np.append(edges[1:], len(keys))):
                out.append((int(place[a]), kind, low[a:b].tobytes(), values[a:b].tobytes()))
        known, times = np.unique(signs[shared], return_counts=True)
        if len(known):
            out.append((self.turn % self.ranges, 2, known.astype("<u8").tobytes(), times.astype("<u4").tobytes()))
        self.turn += 1
        self.tokens, self.signs, self.size = [], [], 0
        self.seen.clear()
        for at in range(0, len(out), 256):
            yield packed_rows(out[at : at + 256])


def range_of(tokens: np.ndarray, ranges: int) -> np.ndarray:
    """Which of so many even ranges of hashes each lies in."""
    return ((tokens >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def answered(place: int, often: int, kinds: list[int], a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sets, shared shingles of each, shingles of more than `often` sets, how many sets) from all rows of one range."""
    joined = lambda kind, of, dtype: np.frombuffer(b"".join(x for k, x in zip(kinds, of) if k == kind), dtype)
    low, signs = joined(0, a, "<u4"), joined(0, b, "<u8")
    told, times = joined(1, a, "<u4"), joined(1, b, "<u4")
    passed, passed_n = joined(2, a, "<u8"), joined(2, b, "<u4")
    if len(low):  # the same set may have asked in several runs
        order = np.lexsort((signs, low))
        low, signs = low[order], signs[order]
        new = np.append(True, (low[1:] != low[:-1]) | (signs[1:] != signs[:-1]))
        low, signs = low[new], signs[new]
    distinct, at, n = np.unique(np.concatenate([low, told]), return_inverse=True, return_counts=True)
    total = np.bincount(at, np.concatenate([np.ones(len(low)), times.astype(float)]), len(distinct)).astype(np.int64)
    hit = total[at[: len(low)]] > 1
    found, back = np.unique(np.concatenate([signs[hit], passed]), return_inverse=True)
    shared = np.bincount(back, np.concatenate([np.ones(int(hit.sum())), passed_n.astype(float)]), len(found)).astype(np.int64)
    hot = np.flatnonzero(total > often)
    # a shingle's high half isn't sent: hot shingles are told by range and low half
    return found, shared, (np.uint64(place) << np.uint64(32)) | distinct[hot].astype(np.uint64), total[hot]


def short_key(tokens: np.ndarray, ranges: int) -> np.ndarray:
    """Range and low half of shingles, as `answered` tells hot ones by."""
    return (range_of(tokens, ranges).astype(np.uint64) << np.uint64(32)) | (tokens & np.uint64(0xFFFFFFFF))


def _asked(rows: DataFrame, ranges: int, sets_of, names: list[str]) -> DataFrame:
    """(sig, shared, hot): how many of the shingles it asks of each set shares with another (hot null), and shingles of many sets (hot: the key, shared: how many). Answers go back packed too. `sets_of(batch)` gives (sig, shingles) pairs."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        asker = Asker(ranges, TaskContext.get().partitionId())
        for batch in batches:
            for sign, tokens in sets_of(batch):
                asker.add(tokens, sign)
                if asker.size >= AT_ONCE:
                    yield from asker.rows()
        yield from asker.rows()
        give_back()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, held in by_range(batches):
            found, shared, hot, times = answered(place, HOT, *map(list, zip(*held)))
            back = (mixed(found) % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(back, kind="stable")
            back, found, shared = back[order], found[order], shared[order]
            edges = np.flatnonzero(np.diff(back, prepend=-1))
            out = [(int(back[a]), 2, found[a:b].astype("<u8").tobytes(), shared[a:b].astype("<u4").tobytes()) for a, b in zip(edges, np.append(edges[1:], len(back)))]
            if len(hot):
                out.append((place, 3, hot.astype("<u8").tobytes(), times.astype("<u4").tobytes()))
            if out:
                yield packed_rows(out)
        give_back()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_range(batches):
            joined = lambda kind, of, dtype: np.frombuffer(b"".join(h[of] for h in held if h[0] == kind), dtype)
            found, at = np.unique(joined(2, 1, "<u8"), return_inverse=True)
            shared = np.bincount(at, joined(2, 2, "<u4"), len(found)).astype(np.int64)
            hot, times = joined(3, 1, "<u8"), joined(3, 2, "<u4").astype(np.int64)
            keys = pa.array(np.concatenate([found, np.zeros(len(hot), np.uint64)]).astype(np.uint64).view(np.int64))
            hot_keys = pa.array(np.concatenate([np.zeros(len(found), np.uint64), hot]).astype(np.uint64).view(np.int64), mask=np.arange(len(found) + len(hot)) < len(found))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate([shared, times])), hot_keys], ["sig", "shared", "hot"])
        give_back()

    asked = rows.select(*names).mapInArrow(ask, PACKED)
    answers = asked.repartition("range").sortWithinPartitions("range").mapInArrow(answer, PACKED)
    return answers.repartition("range").sortWithinPartitions("range").mapInArrow(gather, "sig long, shared long, hot long")


def _ranges(shingles: int, spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles // RANGE))


def candidate_sets(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(sig, n, s): the sets of `docs` that may have a similar one, s their shingles with those of many sets last. `marked` has row_key, sig and n of each row."""
    spark = docs.sparkSession
    total = marked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = _ranges(int(total * (1 - SIMILARITY + SLACK)), spark)

    def first_of_each(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        texts = text_column(batch)
        for first, n in slices(texts, SLICE):
            for own in shingle_sets(texts.slice(first, n)):
                if len(own):
                    yield int(signature(own)), own[: len(own) - int(overlap(len(own))) + int(slack(len(own)))]

    first = saved(_asked(docs.select(docs["text"].cast("string").alias("text")), ranges, first_of_each, ["text"]).filter("hot IS NULL").groupBy("sig").agg(F.sum("shared").alias("shared")))
    needed = f"greatest(1, ceil({SLACK} * ceil({SIMILARITY} * n - 1e-9) - 1e-9))"  # the slack of the smallest set that can be similar
    one = marked.filter("n > 0").groupBy("sig").agg(F.min("row_key").alias("row_key"), F.min("n").alias("n"))
    left = saved(one.join(first, "sig").filter(f"shared >= {needed}").select("sig", "row_key", "n"))
    text = docs.select(F.xxhash64(docs["doc_id"], docs["text"]).alias("row_key"), docs["text"].cast("string").alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            for at, n in slices(texts, SLICE):
                own = [s.view(np.int64) for s in shingle_sets(texts.slice(at, n))]
                yield pa.RecordBatch.from_arrays([batch.column("sig").slice(at, n), pa.array(list(map(len, own)), pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["sig", "n", "s"])

    sets = saved(text.join(checked_broadcast(left), "row_key").select("sig", "text").mapInArrow(whole, "sig long, n long, s array<long>"))
    total = left.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = _ranges(total, spark)

    def all_of_each(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for sign, own in zip(batch.column("sig").to_numpy().view(np.uint64).tolist(), batch.column("s")):
            yield sign, own.values.to_numpy().view(np.uint64)

    second = saved(_asked(sets, ranges, all_of_each, ["sig", "s"]))
    left = second.filter("hot IS NULL").groupBy("sig").agg(F.sum("shared").alias("shared")).join(left, "sig").filter(f"shared >= ceil({SIMILARITY} * n - 1e-9)").select("sig")
    left = saved(left)
    often = second.filter("hot IS NOT NULL").orderBy(F.desc("shared"), "hot").limit(HOT_MOST).select("hot", "shared").toPandas()  # at most HOT_MOST
    hot = often["hot"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot)
    sent = spark.sparkContext.broadcast((hot[order], often["shared"].to_numpy(np.int64)[order]))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, times = sent.value
        for batch in batches:
            out = []
            for own in batch.column("s"):
                tokens = own.values.to_numpy().view(np.uint64)
                if len(hot):
                    key = short_key(tokens, ranges)
                    at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                    tokens = tokens[np.lexsort((tokens, np.where(hot[at] == key, times[at], 0)))]
                out.append(tokens.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("sig"), batch.column("n"), pa.array(out, pa.list_(pa.int64()))], ["sig", "n", "s"])

    out = saved(sets.join(checked_broadcast(left), "sig", "left_semi").dropDuplicates(["sig"]).select("sig", "n", "s").mapInArrow(ordered, "sig long, n long, s array<long>"))
    dropped(sets)
    return out


def families(sets: DataFrame) -> DataFrame:
    """(sig, family): sets (sig, n, s) that share one of their first n - overlap + 1 shingles with another of like size, directly or through others.

    The sizes of a shingle's sets fall into runs: a run ends where the next size is
    too large for a set similar to one before it. A run's sets are linked to one of them.
    """
    first = sets.select("sig", "n", F.explode(F.slice("s", F.lit(1), (F.col("n") - F.ceil(SIMILARITY * F.col("n") - 1e-9) + 1).cast("int"))).alias("token"))
    by_size, whole_run = Window.partitionBy("token").orderBy("n"), Window.partitionBy("token", "run")
    sizes = first.groupBy("token", "n").agg(F.min("sig").alias("least"), F.count("*").alias("many")).withColumn("before", F.lag("n").over(by_size))
    runs = sizes.withColumn("run", F.sum(F.expr(f"CASE WHEN before < ceil({SIMILARITY} * n - 1e-9) THEN 1 ELSE 0 END")).over(by_size))
    met = saved(runs.select("token", "n", F.min("least").over(whole_run).alias("least"), F.sum("many").over(whole_run).alias("many")).filter("many > 1").drop("many"))
    edges = saved(first.join(checked_broadcast(met), ["token", "n"]).filter("sig <> least").select(F.col("sig").alias("a"), F.col("least").alias("b")).distinct())
    roots = saved(components(edges))
    return roots.select(F.col("node").alias("sig"), F.col("root").alias("family")).unionByName(roots.select(F.col("root").alias("sig"), F.col("root").alias("family")).distinct())


def shared_bits(bucket: np.ndarray, owner: np.ndarray, token: np.ndarray, seen: np.ndarray, n: int) -> np.ndarray | None:
    """Rows of bits, one for each shingle that several sets of the row's bucket have; None if they would take more than the shingles themselves.

    Sets of a dense family have few shingles between them, and two rows of bits are
    compared at once where two sets are looked up shingle by shingle.
    """
    used = seen[token] > 1
    owner, token = owner[used], token[used]
    _, first = np.unique(token, return_index=True)
    order = np.argsort(bucket[owner[first]], kind="stable")
    number = np.arange(len(order)) - np.searchsorted(own := bucket[owner[first]][order], own)
    words = int(number.max(initial=0)) // 64 + 1
    if n * words > len(owner):
        return None
    place = np.empty(len(seen), np.int64)
    place[token[first][order]] = number
    at = place[token]
    bits = np.zeros((n, words), np.uint64)
    np.bitwise_or.at(bits, (owner, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    return bits


def similar_in_buckets(bucket: np.ndarray, side: np.ndarray, node: np.ndarray, shingles: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of nodes whose classes are those of all similar pairs of one bucket.

    `shingles` has the sets of all rows, one after the other. Candidates share a
    shingle of their prefixes, rarest first; a forest of them is verified at a time,
    and pairs that are still apart go on until each is verified or joined. A side
    of 2 meets all rows of its bucket; 0 and 1 meet only each other.
    """
    n, number = len(size), np.arange(len(size))
    owner, begin = np.repeat(number, size), np.cumsum(size) - size
    values, token, seen = np.unique(mixed(shingles.view(np.uint64) + mixed(bucket)[owner]), return_inverse=True, return_counts=True)
    held = np.sort(owner * len(values) + token)
    _, first, same = np.unique(node, return_index=True, return_inverse=True)
    forest = Forest(n)
    forest.label = first[same]
    order = np.lexsort((token, seen[token], owner))
    used = (np.arange(len(owner)) - begin[owner] <= (size - overlap(size))[owner]) & (seen[token[order]] > 1)
    token_at, row = token[order][used], owner[used]
    order = np.lexsort((size[row], token_at))
    token_at, row = token_at[order], row[order]
    step = 2 * int(size.max(initial=0)) + 2
    at = np.arange(len(row))
    partners = np.searchsorted(token_at * step + size[row], token_at * step + np.floor(size[row] / SIMILARITY + 1e-9).astype(np.int64), side="right") - at - 1
    ends, failed, start = np.cumsum(partners), np.empty(0, np.int64), 0
    bits = shared_bits(bucket, owner, token, seen, n)

    def verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = []
        if bits is not None:
            for part in np.array_split(np.arange(len(a)), 1 + len(a) * bits.shape[1] // PAIRS_AT_ONCE):
                x, y = a[part], b[part]
                common = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
                out.append(common >= SIMILARITY * (size[x] + size[y] - common) - 1e-9)
            return np.concatenate(out)
        for part in np.array_split(np.arange(len(a)), 1 + size[a].sum() // PAIRS_AT_ONCE):
            x, y = a[part], b[part]
            if not len(x):
                continue
            base = np.cumsum(size[x]) - size[x]
            place = np.repeat(begin[x] - base, size[x]) + np.arange(size[x].sum())
            asked = np.repeat(y, size[x]) * len(values) + token[place]
            found = held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked
            common = np.add.reduceat(found, base, dtype=np.int64)
            out.append(common >= SIMILARITY * (size[x] + size[y] - common) - 1e-9)
        return np.concatenate(out)

    while start < len(row):
        base = ends[start - 1] if start else 0
        last = max(start + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, side="right")))
        m = partners[start:last]
        a = np.repeat(at[start:last], m)
        b = row[a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)]
        a = row[a]
        meets = ((side[a] == 2) | (side[a] != side[b])) & (forest.label[a] != forest.label[b])
        pairs = np.sort(np.minimum(a, b)[meets] * n + np.maximum(a, b)[meets])
        if len(failed):
            pairs = pairs[failed[np.minimum(np.searchsorted(failed, pairs), len(failed) - 1)] != pairs]
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        rounds, bad = 0, [failed]
        while len(pairs := pairs[forest.label[pairs // n] != forest.label[pairs % n]]):
            a, b = pairs // n, pairs % n
            pick = spanning_forest(n, forest.label[a], forest.label[b]) if rounds < 20 else np.arange(min(len(a), 1 << 14))
            good = verified(a[pick], b[pick])
            forest.link(a[pick[good]], b[pick[good]])
            bad.append(pairs[pick[~good]])
            pairs = np.delete(pairs, pick)
            rounds += 1
        failed = np.sort(np.concatenate(bad), kind="stable")
        start = last
    moved = np.flatnonzero(node != node[forest.label])
    return node[moved], node[forest.label[moved]]


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole buckets (key, i, j), several small ones at a time, from batches sorted by bucket."""
    held: list[pa.Table] = []

    def keys_of(rows: pa.Table) -> np.ndarray:
        return np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], axis=1)

    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        keys = keys_of(rows)
        last = np.all(keys == keys[-1], axis=1)
        cut = int(np.argmax(last))
        if held and not np.array_equal(keys_of(held[0].slice(0, 1))[0], keys[-1]):  # what is held ends in this batch
            yield pa.concat_tables([*held, rows.slice(0, cut)])
            held = []
        elif cut:
            yield rows.slice(0, cut)
        held.append(rows.slice(cut))
    if held:
        yield pa.concat_tables(held)


def meetings(first: int) -> str:
    """The pieces (i, j, side) in which piece `own` of `pieces` meets others in the round of offsets from `first`; offset 0 is a round of its own.

    Each pair of pieces is at one offset, at most half their number, around the ring of pieces.
    """
    if not first:
        return "array(struct(own AS i, own AS j, 2 AS side))"
    offsets = f"filter(sequence({first}, {first + OFFSETS - 1}), d -> 2 * d <= pieces)"
    others = f"array_distinct(flatten(transform({offsets}, d -> array(cast(pmod(own + d, pieces) AS int), cast(pmod(own - d, pieces) AS int)))))"
    return f"transform({others}, k -> struct(least(k, own) AS i, greatest(k, own) AS j, CASE WHEN k < own THEN 1 ELSE 0 END AS side))"


def _links(sets: DataFrame, dealt: DataFrame, first: int) -> DataFrame:
    """Links (a, b) of the nodes of `dealt` (sig, node, key, own, pieces) that a round of pieces finds among `sets` (sig, s)."""
    rows = sets.select("sig", "s").join(checked_broadcast(dealt), "sig").selectExpr("node", "s", "key", f"inline({meetings(first)})")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_buckets(batches):
            keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], axis=1)
            bucket = np.concatenate(([0], np.cumsum(np.any(keys[1:] != keys[:-1], axis=1)))).astype(np.uint64)
            lists = rows.column("s").combine_chunks()
            side, node = (rows.column(c).to_numpy().astype(np.int64) for c in ("side", "node"))
            a, b = similar_in_buckets(bucket, side, node, lists.flatten().to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        give_back()

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Links (a, b) of the fingerprints of `marked` (row_key, fp, sig, n) whose classes are those of all pairs of similar texts; rows of one sig have one fp."""
    bound_batches(docs.sparkSession)
    sets = candidate_sets(docs, marked)
    members = families(sets)
    fps = marked.groupBy("sig").agg(F.min("fp").alias("fp"))
    whole = saved(members.join(sets.select("sig", "n"), "sig").join(fps, "sig").withColumnRenamed("family", "key"))
    pieces = saved(whole.groupBy("key").agg(F.greatest(F.ceil(F.sum("n") / F.lit(PIECE)), F.ceil(F.count("*") / F.lit(PIECE_SETS))).cast("int").alias("pieces")))
    dealt = saved(whole.join(checked_broadcast(pieces), "key").selectExpr("sig", "fp AS node", "key", "cast(pmod(xxhash64(sig), pieces) AS int) AS own", "pieces"))
    links = saved(_links(sets, dealt, 0))
    most = pieces.agg(F.max("pieces")).first()[0] or 1
    for first in range(1, most // 2 + 1, OFFSETS):
        roots = saved(components(links))
        cut = dealt.filter(F.col("pieces") >= 2 * first).join(checked_broadcast(roots.withColumnRenamed("node", "own_node")), F.col("node") == F.col("own_node"), "left")
        cut = saved(cut.select("sig", F.coalesce("root", "node").alias("node"), "key", "own", "pieces"))
        apart = saved(cut.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("key"))
        if not (families_left := apart.count()):
            break
        found = _links(sets, saved(cut.join(checked_broadcast(apart, families_left), "key", "left_semi")), first)
        links = saved(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
    return links
