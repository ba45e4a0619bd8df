"""Cross-entropy difference scores (Moore & Lewis, "Intelligent selection of language model training data").

Two bigram models, one of target text (documents labelled of good quality) and
one of the background (all documents), are matched: they share one vocabulary,
one smoothing, and the background's counts are scaled to the target's number of
words. A word's loss is -log p(word | word before); a document's score is the mean
of its words' target loss less background loss, so lower is nearer to the target.

The vocabulary is CLASSES classes of words by hash, a size of the method. Counts
are exact and cover every word of every document, and every pair of neighbouring
classes is kept, however rare. p(w | v) = (c(v, w) + P p(w)) / (c(v) + P), which
sums to one over the vocabulary.

Words are counted first; those counts are of fixed size and go to every task.
Pairs grow with the corpus and never meet in one place:
1. A run of documents scores its pairs as if no other run had them, and sends each
   document's pairs to the range of pairs they lie in, packed.
2. A range has all counts of its pairs. It sends back, per run and document, how
   much the loss of pairs that other runs have too differs from what was assumed.
3. A run's documents and what came back are summed.
Pairs that are common in a sample of documents are counted with the words, so no
range holds a pair that a large part of all documents has; the sample decides
where a pair is counted and not what its count is.

Defined cases: null text is the empty text; a text without words has losses and
score 0; without labelled target documents the models are equal and every score
is 0; repeated rows are rows of their own; an empty table gives no rows; other
columns are ignored. Labels of one document that disagree count as bad.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.arrowtext import BATCH_ROWS, bound_batches, give_back, segment_sums, slices, text_column, word_hashes, words_of
from stratafold.llm.shared import checked_broadcast, saved

CLASS_BITS = 19
CLASSES = 1 << CLASS_BITS
PAIR_PRIOR, WORD_PRIOR = 50.0, 0.5
#: Documents of the sample that common pairs are looked up in, the least times such a pair is in it, and how many at most.
SAMPLE, COMMON, COMMON_MOST = 20_000, 3, 500_000
#: Pairs and documents of a run, pairs of a range on the average.
RUN_PAIRS, RUN_DOCS, RANGE = 1 << 20, 1 << 15, 1 << 20
#: Pairs are numbers below 2 ** KEY_BITS; an odd factor spreads them, its inverse brings them back.
KEY_BITS = 2 * CLASS_BITS + 1
FACTOR = 0x1E3779B97F4A7C15 % (1 << KEY_BITS) | 1
BACK = pow(FACTOR, -1, 1 << KEY_BITS)
_MASK = np.uint64((1 << KEY_BITS) - 1)


def pairs_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, word's class, where each text's words begin); the class before a text's first word is CLASSES."""
    words = words_of(pc.ascii_lower(texts))
    ids = (word_hashes(words.distinct) >> np.uint64(64 - CLASS_BITS)).astype(np.int64)[words.index]
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[words.begin[:-1][np.diff(words.begin) > 0]] = CLASSES
    return before * CLASSES + ids, ids, words.begin


def spread(pairs: np.ndarray) -> np.ndarray:
    return pairs.astype(np.uint64) * np.uint64(FACTOR) & _MASK


def unspread(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(BACK) & _MASK).astype(np.int64)


class Model:
    """Counts (row 0 of the target, row 1 of the background) of words, of words that others follow, and of common pairs."""

    def __init__(self, words: np.ndarray, contexts: np.ndarray, common: np.ndarray, common_counts: np.ndarray):
        total = words.sum(axis=1)
        self.words_in_all = int(total[1])
        self.scale = np.array([1.0, total[0] / total[1] if total[1] else 0.0])
        scaled = self.scale[:, None]
        self.prior = PAIR_PRIOR * (words * scaled + WORD_PRIOR) / (total[:, None] * scaled + WORD_PRIOR * CLASSES)
        self.follow = np.log(contexts * scaled + PAIR_PRIOR)
        self.common, self.common_counts = common, common_counts

    def losses(self, pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(2, n) losses of a pair's second word, if the pair has these counts (2, n)."""
        return self.follow[:, pairs >> CLASS_BITS] - np.log(counts * self.scale[:, None] + self.prior[:, pairs & (CLASSES - 1)])

    def place(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each pair is a common one, its place)."""
        if not len(self.common):
            return np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64)
        at = np.minimum(np.searchsorted(self.common, pairs), len(self.common) - 1)
        return self.common[at] == pairs, at


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, target) of each row, in an order that a second run repeats."""
    good = saved(labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(labels["doc_id"].cast("long").alias("_id")).agg(F.min("quality").alias("_good")).filter("_good = 1").select("_id"))
    number = good.count()
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    side = checked_broadcast(good, number)
    rows = text.join(side, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", F.col("_id").isNotNull().alias("target"))
    return rows if side is not good else saved(rows)


def _common(rows: DataFrame) -> np.ndarray:
    """Pairs that are common in a sample of rows, sorted."""
    number = rows.count()
    some = rows.select("text")
    some = some.sample(fraction=SAMPLE / number, seed=1) if number > SAMPLE else some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            for first, n in slices(texts):
                found, count = np.unique(pairs_of(texts.slice(first, n))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found[count > 1]), pa.array(count[count > 1])], ["pair", "n"])

    counts = some.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    return np.sort(counts.orderBy(F.desc("n"), "pair").limit(COMMON_MOST).toPandas()["pair"].to_numpy(np.int64))


def train(rows: DataFrame) -> Model:
    """Count the words and the common pairs of all `rows` (text, target)."""
    spark = rows.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(_common(rows))  # at most COMMON_MOST
    # keys: a class, CLASSES + the class of a last word, 2 * CLASSES for texts, then places of common pairs
    begins, size = 2 * CLASSES, 2 * CLASSES + 1 + len(sent.value)
    width = -(-size // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            texts, target = text_column(batch), batch.column("target").to_numpy(zero_copy_only=False)
            for first, n in slices(texts, 4 << 20):
                pairs, ids, begin = pairs_of(texts.slice(first, n))
                full = np.diff(begin) > 0
                own = target[first : first + n]
                marks = [(ids, np.repeat(own, np.diff(begin))), (CLASSES + ids[begin[1:][full] - 1], own[full]), (np.full(int(full.sum()), begins), own[full])]
                if len(sent.value):
                    at = np.minimum(np.searchsorted(sent.value, pairs), len(sent.value) - 1)
                    hit = sent.value[at] == pairs
                    marks.append((begins + 1 + at[hit], marks[0][1][hit]))
                keys, wanted = (np.concatenate(m) for m in zip(*marks))
                total[1] += np.bincount(keys, minlength=size)
                total[0] += np.bincount(keys[wanted], minlength=size)
        used = np.flatnonzero(total[1])
        edges = np.searchsorted(used, np.arange(0, size + width, width))
        for place, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                yield packed(place, (used[a:b] - place * width).astype("<u4"), total[:, used[a:b]].astype("<u8"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, held in _groups(batches, "range", ("keys", "counts")):
            keys = np.concatenate([np.frombuffer(k, "<u4") for k, _ in held])
            times = np.concatenate([np.frombuffer(c, "<u8").reshape(2, -1) for _, c in held], axis=1)
            found, at = np.unique(keys, return_inverse=True)
            yield packed(place, found.astype("<u4"), np.stack([np.bincount(at, row, len(found)) for row in times]).astype("<u8"))

    def packed(place: int, keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([keys.tobytes()], pa.binary()), pa.array([times.tobytes()], pa.binary())], ["range", "keys", "counts"])

    schema = "range long, keys binary, counts binary"
    parts = rows.select("text", "target").mapInArrow(run, schema).repartition("range").sortWithinPartitions("range").mapInArrow(add, schema)
    counts = np.zeros((2, size))
    for place, keys, times in parts.collect():  # at most 2 * CLASSES + 1 + COMMON_MOST counts, whatever the corpus
        counts[:, place * width + np.frombuffer(keys, "<u4").astype(np.int64)] = np.frombuffer(times, "<u8").reshape(2, -1)
    words = counts[:, :CLASSES]
    contexts = np.concatenate([words - counts[:, CLASSES:begins], counts[:, begins : begins + 1]], axis=1)
    return Model(words, contexts, sent.value, counts[:, begins + 1 :])


class Run:
    """Documents whose pairs are scored and sent together."""

    def __init__(self, model: Model, ranges: int, base: int):
        self.model, self.ranges, self.base = model, ranges, base
        self._begin()

    def _begin(self) -> None:
        self.codes: list[np.ndarray] = []
        self.docs, self.target, self.words, self.known = [], [], [], []
        self.size = 0

    def add(self, texts: pa.Array, docs: list, target: np.ndarray) -> None:
        pairs, _, begin = pairs_of(texts)
        owner = np.repeat(np.arange(len(docs)), np.diff(begin))
        hit, at = self.model.place(pairs)
        loss = np.zeros((2, len(pairs)))
        loss[:, hit] = self.model.losses(pairs[hit], self.model.common_counts[:, at[hit]])
        self.known.append(np.stack([segment_sums(row, begin) for row in loss]))
        rest = ~hit
        self.codes.append(spread(pairs[rest]) << np.uint64(15) | (owner[rest] + len(self.docs)).astype(np.uint64))
        self.docs += docs
        self.target.append(target)
        self.words.append(np.diff(begin))
        self.size += int(rest.sum())

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The run's documents with the losses it can tell, and their pairs by range: steps between sorted codes, documents (the highest bit tells the target's) and times."""
        if not self.docs:
            return
        codes, times = np.unique(np.concatenate(self.codes), return_counts=True)
        own, doc, target = codes >> np.uint64(15), (codes & np.uint64(0x7FFF)).astype(np.int64), np.concatenate(self.target)
        local = sums(own, times, target[doc])
        loss = self.model.losses(unspread(own), local) * times
        losses = np.concatenate(self.known, axis=1) + np.stack([np.bincount(doc, row, len(self.docs)) for row in loss])
        yield _row(self.base % self.ranges, self.base, b"", (self.docs, np.concatenate(self.words), *losses))
        place = range_of(own, self.ranges)
        inside = own - first_of(place, self.ranges)
        marked = (doc | np.where(target[doc], 0x8000, 0)).astype("<u2")
        edges = np.flatnonzero(np.diff(place, prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(own))):
            yield _row(int(place[a]), self.base, planes(steps(inside[a:b]), marked[a:b], times[a:b].astype("<u4")), None)
        self.base += len(self.docs)
        self._begin()


def range_of(codes: np.ndarray, ranges: int) -> np.ndarray:
    """Which of so many even ranges each code lies in."""
    width = -(-(1 << KEY_BITS) // ranges)
    return (codes // np.uint64(width)).astype(np.int64)


def first_of(place: np.ndarray | int, ranges: int) -> np.ndarray:
    return np.asarray(place).astype(np.uint64) * np.uint64(-(-(1 << KEY_BITS) // ranges))


def sums(keys: np.ndarray, times: np.ndarray, target: np.ndarray) -> np.ndarray:
    """(2, n): for each of sorted keys, how often it is there in all, in target rows and in all rows."""
    if not len(keys):
        return np.zeros((2, 0))
    new = np.append(True, keys[1:] != keys[:-1])
    run = np.cumsum(new) - 1
    return np.stack([np.bincount(run, times * target), np.bincount(run, times)])[:, run]


def planes(*columns: np.ndarray) -> bytes:
    """Columns of numbers, byte by byte: bytes of one rank, which are alike, stand together and shrink."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns))


def unplaned(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def steps(sorted_: np.ndarray) -> np.ndarray:
    """The steps between sorted numbers."""
    return np.diff(sorted_, prepend=np.uint64(0)).astype("<u8")


SENT = "range long, base long, body binary, ids array<long>, n array<long>, target array<double>, background array<double>"
_SENT = pa.schema([("range", pa.int64()), ("base", pa.int64()), ("body", pa.binary()), ("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("target", pa.list_(pa.float64())), ("background", pa.list_(pa.float64()))])


def _row(place: int, base: int, body: bytes, lists: tuple | None) -> pa.RecordBatch:
    values = (place, base, body, *(lists or (None,) * 4))
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _SENT)], schema=_SENT)


def corrections(model: Model, place: int, ranges: int, held: list[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(base, documents, (2, n) what to add to their losses) of each run whose pairs others have too; `held` has (base, body) of all runs of one range."""
    runs = []
    for base, body in held:
        own, docs, times = unplaned(body, "<u8", "<u2", "<u4")
        runs.append((base, np.cumsum(own, dtype=np.uint64), docs, times))
    if len(runs) < 2:
        return
    run = np.repeat(np.arange(len(runs)), [len(r[1]) for r in runs])
    inside, docs, times = (np.concatenate([r[i] for r in runs]) for i in (1, 2, 3))
    order = np.argsort(inside, kind="stable")  # runs of one pair stay together
    inside, docs, times, run = inside[order], docs[order], times[order].astype(np.int64), run[order]
    target = docs >= 0x8000
    total = sums(inside, times, target)
    both = np.append(True, (inside[1:] != inside[:-1]) | (run[1:] != run[:-1]))
    part = np.cumsum(both) - 1
    local = np.stack([np.bincount(part, times * target), np.bincount(part, times)])[:, part]
    changed = np.flatnonzero(local[1] != total[1])
    if not len(changed):
        return
    pairs = unspread(inside[changed] + first_of(place, ranges))
    more = (model.losses(pairs, total[:, changed]) - model.losses(pairs, local[:, changed])) * times[changed]
    key = run[changed] << 15 | (docs[changed] & 0x7FFF)
    found, back = np.unique(key, return_inverse=True)
    added = np.stack([np.bincount(back, row, len(found)) for row in more])
    edges = np.flatnonzero(np.diff(found >> 15, prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(found))):
        yield runs[int(found[a] >> 15)][0], (found[a:b] & 0x7FFF).astype("<u2"), added[:, a:b]


SCHEMA = "doc_id long, n_words long, loss_target double, loss_background double, score double"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _groups(batches: Iterator[pa.RecordBatch], key: str, columns: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """(key, rows) of whole groups, from batches sorted by key."""
    now, held = None, []
    for batch in batches:
        for k, *row in zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in columns)):
            if k != now and held:
                yield now, held
                held = []
            now = k
            held.append(tuple(row))
    if held:
        yield now, held


def score(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, mean losses by both models and their difference, of each of `rows` (doc_id, text, target), which `model` was trained on."""
    spark = rows.sparkSession
    bound_batches(spark)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-model.words_in_all // RANGE))
    sent = spark.sparkContext.broadcast(model)  # of fixed size

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run = Run(sent.value, ranges, TaskContext.get().partitionId() << 40)
        for batch in batches:
            texts, ids, target = text_column(batch), batch.column("doc_id").to_pylist(), batch.column("target").to_numpy(zero_copy_only=False)
            for first, n in slices(texts):
                run.add(texts.slice(first, n), ids[first : first + n], target[first : first + n])
                if run.size >= RUN_PAIRS or len(run.docs) + BATCH_ROWS > RUN_DOCS:
                    yield from run.rows()
        yield from run.rows()
        give_back()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, held in _groups(batches, "range", ("base", "body", "ids", "n", "target", "background")):
            for base, *_, ids, n, target, background in held:
                if ids is not None:
                    yield _row(place, base, b"", (ids, n, target, background))
            for base, docs, more in corrections(sent.value, place, ranges, [h[:2] for h in held if h[2] is None]):
                yield _row(place, base, planes(docs, *more.astype("<f8")), None)
        give_back()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _groups(batches, "base", ("body", "ids", "n", "target", "background")):
            ids, n, *losses = next(h[1:] for h in held if h[1] is not None)
            losses = np.asarray(losses)
            for body, own, *_ in held:
                if own is None:
                    docs, *more = unplaned(body, "<u2", "<f8", "<f8")
                    losses[:, docs] += np.asarray(more)
            count = np.asarray(n, np.int64)
            target, background = losses / np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(count), pa.array(target), pa.array(background), pa.array(target - background)], _NAMES)

    sent_rows = rows.select("doc_id", "text", "target").mapInArrow(send, SENT)
    answers = sent_rows.repartition("range").sortWithinPartitions("range", "base").mapInArrow(answer, SENT)
    return answers.repartition("base").sortWithinPartitions("base", "range").mapInArrow(gather, SCHEMA)


def cross_entropy_differences(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, loss_target, loss_background and score of each row of `docs`."""
    rows = labelled(docs, labels)
    return score(rows, train(rows))
