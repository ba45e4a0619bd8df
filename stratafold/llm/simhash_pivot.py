"""SimHash near-duplicates, searched with pivot distance tables.

A document's fingerprint is the majority vote, bit by bit, of the XXH64 of its
word shingles. Fingerprints link if they differ in at most `radius` bits.

Search. Equal fingerprints are one node. The 64 bits are cut into blocks, and
each choice of blocks that `radius` differences must leave untouched is a table
whose rows meet by the bits of those blocks, so that every link is met in some
table. More distinct fingerprints take more blocks, so that a bucket keeps to a
few dozen; any number of blocks finds the same links. In a bucket, the Hamming
distances to PIVOTS reference fingerprints are tabulated once. By the triangle
inequality two fingerprints within the radius differ by at most the radius in
every coordinate: rows are sorted by the first coordinate and only meet those in
its window, pairs whose largest coordinate difference exceeds the radius are
discarded, and the survivors are verified by counting differing bits. Buckets
over CHUNK rows are cut into chunks and every pair of chunks is a bucket of its
own, so no task holds more than two chunks of a bucket and no link is lost.

A bucket gives a spanning forest of the links it found, not all of them; classes
are the connected components of all forests.

`without_near_duplicates` takes the fingerprints of the sets of five-word shingles,
and also links all texts whose sets have a Jaccard similarity of 0.8 or more, which
`similar_sets` finds exactly.

Defined cases: null text is the empty text; a text without words has fingerprint
zero and links like any other; repeated rows are in one class; a null doc_id
never names a class unless the class has no other; an empty table gives no rows;
other columns of the input are ignored by `near_duplicates` and kept by
`without_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm import similar_sets
from stratafold.llm.arrowtext import bound_batches, give_back, slices, text_column
from stratafold.llm.components import Forest, components
from stratafold.llm.shared import BROADCAST_ROWS, checked_broadcast, saved

SHINGLE_WORDS, SEED, RADIUS = 4, 42, 4
PIVOTS = 16
#: Rows of a bucket that are compared as one piece.
CHUNK = 4096
#: Pairs that are held at a time.
PAIRS_AT_ONCE = 1 << 20
SLICE = 1 << 20


def shingle_hashes(texts: pa.Array, width: int = SHINGLE_WORDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every shingle of every text in order, number of shingles of each text)."""
    import xxhash

    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    joined = pc.binary_join(words, " ")
    data = joined.buffers()[2]
    data = data.to_pybytes() if data is not None else b""
    text_ends = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64)
    full = np.diff(text_ends) > 0
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8)[: text_ends[-1]] == 32)
    begins = np.sort(np.concatenate([text_ends[:-1][full], spaces + 1]))
    ends = np.sort(np.concatenate([text_ends[1:][full], spaces]))
    first = np.searchsorted(begins, text_ends[:-1])
    count = np.searchsorted(begins, text_ends[1:]) - first
    shingles = np.where(count > 0, np.maximum(1, count - width + 1), 0)
    total = np.cumsum(shingles)
    number = np.arange(total[-1] if len(total) else 0)
    at = np.repeat(first - (total - shingles), shingles) + number
    till = np.minimum(at + width - 1, np.repeat(first + count - 1, shingles))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(data[a:b], seed) for a, b in zip(begins[at].tolist(), ends[till].tolist())), np.uint64, len(at)), shingles


def majority(hashes: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Of each text, the bits set in over half of its hashes."""
    set_bits = np.zeros((len(shingles), 64), np.int64)
    some = np.flatnonzero(shingles)
    if len(some):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits[some] = np.add.reduceat(bits, (np.cumsum(shingles) - shingles)[some], axis=0, dtype=np.int32)
    over_half = 2 * set_bits > shingles[:, None]
    return np.packbits(over_half, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints_of(texts: pa.Array, width: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers."""
    return majority(*shingle_hashes(texts, width, seed))


def fingerprints(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, row_key, fp): row_key tells rows of one doc_id and different texts apart; fp has the fingerprint's bits."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            for first, n in slices(texts, SLICE):
                fps = pa.array(fingerprints_of(texts.slice(first, n), width, seed).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), batch.column("row_key").slice(first, n), fps], ["doc_id", "row_key", "fp"])

    rows = docs.select(docs[doc_col].cast("long").alias("doc_id"), F.xxhash64(docs[doc_col], docs[text_col]).alias("row_key"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row_key long, fp long")


def _block_edges(blocks: int) -> list[tuple[int, int]]:
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return list(zip(cuts, cuts[1:]))


def blocks_for(count: int, radius: int = RADIUS) -> int:
    """Least number of blocks whose tables keep the mean bucket of `count` random fingerprints to 64."""
    blocks = radius + 1
    while blocks < radius + 6 and count > 64 * 2 ** (64 * (blocks - radius) / blocks):
        blocks += 1
    return blocks


def _tables(blocks: int, radius: int) -> list[Column]:
    """A struct (table, key) for each choice of blocks that stay untouched."""
    out = []
    for table, kept in enumerate(combinations(_block_edges(blocks), blocks - radius)):
        mask = sum(((1 << (b - a)) - 1) << a for a, b in kept)
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(table).alias("table"), F.col("fp").bitwiseAND(F.lit(signed).cast("long")).alias("key")))
    return out


def _pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same on every machine."""
    return np.random.Generator(np.random.PCG64(7)).integers(0, 2**64 - 1, count, dtype=np.uint64, endpoint=True)


def links_in_buckets(bucket: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int = RADIUS, pivots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among rows of equal `bucket`: pairs of fingerprints.

    A side of 2 meets all rows of its bucket; 0 and 1 meet only each other.
    """
    pivots = _pivots() if pivots is None else pivots
    distance = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int16)
    order = np.lexsort((distance[:, 0], bucket))
    bucket, side, fp, distance = bucket[order], side[order], fp[order], distance[order]
    place = bucket.astype(np.int64) * 256 + distance[:, 0]
    number = np.arange(len(fp))
    partners = np.searchsorted(place, place + radius, side="right") - number - 1
    ends, forest, first = np.cumsum(partners), Forest(len(fp)), 0
    while first < len(fp):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, side="right")))
        n = partners[first:last]
        a = np.repeat(number[first:last], n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        meets = (side[a] == 2) | (side[a] != side[b])
        a, b = a[meets], b[meets]
        for k in range(1, distance.shape[1]):
            near = np.abs(distance[a, k] - distance[b, k]) <= radius
            a, b = a[near], b[near]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        forest.link(a[near], b[near])
        first = last
    moved = np.flatnonzero(forest.label != number)
    return fp[moved], fp[forest.label[moved]]


def _pieces(columns: list[str]) -> str:
    """The pieces (i, j, side) that a row meets in of its bucket of `n` rows."""
    pieces = f"cast(ceil(n / {CHUNK}) AS int)"
    own = f"cast(pmod(xxhash64({', '.join(columns)}), {pieces}) AS int)"
    return (
        f"CASE WHEN n <= {CHUNK} THEN array(struct(0 AS i, 0 AS j, 2 AS side)) ELSE transform(sequence(0, {pieces} - 1), k -> "
        f"struct(least(k, {own}) AS i, greatest(k, {own}) AS j, CASE WHEN k = {own} THEN 2 WHEN k < {own} THEN 1 ELSE 0 END AS side)) END"
    )


def _meetings(rows: DataFrame, columns: list[str], few: bool) -> DataFrame:
    """`rows` (columns, table, key), which may be broadcast if there are `few`, with the pieces of buckets they meet in (i, j, side), dealt and sorted by piece. Buckets of one row go."""
    rows = rows if few else rows.hint("merge")  # Spark's estimate of its size leaves out that a row is in every table
    sizes = rows.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = rows.join(sizes, ["table", "key"]).selectExpr(*columns, "table", "key", f"{_pieces(columns)} AS meetings").selectExpr(*columns, "table", "key", "inline(meetings)")
    return met.repartition("table", "key", "i", "j").sortWithinPartitions("table", "key", "i", "j").select(*columns, "side", "table", "key", "i", "j")


def _by_bucket(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket number, rows) of whole buckets, from batches sorted by bucket; a row is its columns and side."""
    held: list[np.ndarray] = []
    n = len(columns) + 1

    def whole(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        same = np.all(rows[1:, n:] == rows[:-1, n:], axis=1)
        return np.concatenate(([0], np.cumsum(~same))), np.ascontiguousarray(rows[:, :n])

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*columns, "side", "table", "key", "i", "j")], axis=1)
        if not len(rows):
            continue
        rows = np.concatenate([*held, rows])
        last = np.all(rows[:, n:] == rows[-1, n:], axis=1)
        cut = int(np.argmax(last))
        if cut:
            yield whole(rows[:cut])
        held = [rows[cut:]]
    if held:
        yield whole(held[0])


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) of a table of distinct fingerprints `fp` whose components are those of all links."""
    bound_batches(distinct.sparkSession)
    count = distinct.count()
    tables = _tables(blocks_for(count, radius), radius)
    parted = _meetings(distinct.select("fp", F.inline(F.array(*tables))), ["fp"], count * len(tables) <= BROADCAST_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches, ["fp"]):
            a, b = links_in_buckets(bucket, rows[:, 1], np.ascontiguousarray(rows[:, 0]).view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
        give_back()

    return parted.mapInArrow(run, "a long, b long")


def classes(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`marked` (doc_id, row_key, fp) with component_id, the least doc_id that links reach."""
    distinct = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), radius))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(best, "root").select("fp", "component_id")
    return marked.join(named, "fp", "left")


def near_duplicates(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    found = classes(saved(fingerprints(docs, doc_col, text_col, width, seed)), radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def marked_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, fp, sig, n) of each row, from its set of five-word shingles: fingerprint, signature and size."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            for first, n in slices(texts, SLICE):
                sets = similar_sets.shingle_sets(texts.slice(first, n))
                sizes = np.asarray(list(map(len, sets)))
                fps = majority(np.concatenate(sets), sizes)
                signs = np.asarray([similar_sets.signature(s) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), batch.column("row_key").slice(first, n), pa.array(fps.view(np.int64)), pa.array(signs.view(np.int64)), pa.array(sizes)], ["doc_id", "row_key", "fp", "sig", "n"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["doc_id"], docs["text"]).alias("row_key"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row_key long, fp long, sig long, n long")


def without_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` that stay when one row of each class does: one with the least doc_id, a null one if there is no other.

    Classes are those of linked fingerprints and of similar texts together.
    """
    marked = saved(marked_sets(docs))
    distinct = saved(marked.select("fp").distinct())
    roots = saved(components(saved(links(distinct, radius).unionByName(similar_sets.similar(docs, marked)))))
    rooted = marked.select("doc_id", "row_key", "fp").join(checked_broadcast(roots), F.col("fp") == F.col("node"), "left").select("doc_id", "row_key", F.coalesce("root", "fp").alias("root"))
    rooted = saved(rooted.groupBy("root", "row_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
    best = saved(rooted.groupBy("root").agg(F.min_by("row_key", F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("stays")))
    gone = saved(rooted.join(best, F.col("row_key") == F.col("stays"), "left_anti").select(F.col("row_key").alias("_gone")))
    kept = docs.withColumn("_row_key", F.xxhash64(docs["doc_id"], docs["text"])).join(checked_broadcast(gone), F.col("_row_key") == F.col("_gone"), "left_anti")
    again = saved(rooted.filter("n > 1").join(best, F.col("row_key") == F.col("stays"), "left_semi").select(F.col("row_key").alias("_again")))
    number = again.count()
    if not number:
        return kept.select(*docs.columns)
    again = checked_broadcast(again, number)
    repeated = kept.join(again, F.col("_row_key") == F.col("_again"), "left_semi").dropDuplicates(["_row_key"])
    single = kept.join(again, F.col("_row_key") == F.col("_again"), "left_anti")
    return single.unionByName(repeated).select(*docs.columns)
