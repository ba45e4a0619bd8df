"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of words in a lexicon, in two strengths, and of
their summed weights; how many of them stand near a word of the second person;
rates of capitals, of words in capitals, of punctuation, of exclamation marks
and of words written with obfuscating marks or digits; lexicon words found only
after such marks are undone; and the text's length.

The lexicon is learned: words and word beginnings of 4 to 7 letters whose
presence tells toxic from other labelled texts, by log-odds. At most TRAIN_ROWS
labelled rows (chosen by hash of doc_id) are used, and never those held out.
Training rows are featured by a lexicon learned without their own fold, the
trees' margins are calibrated on out-of-fold predictions, and the final trees
see all training rows. Everything learned has a fixed size (LEXICON_SIZE terms,
TREES trees), so it travels with the task, whatever the corpus.

Only the text is an input. Defined cases: null text is the empty text and is
scored like any other; repeated rows get equal scores; of a document with several
texts one is learned from; equal margins get one level of the calibration; rows of one document whose
labels disagree count as toxic; where training labels hold one class only, that
class's share is every score; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm.arrowtext import WordTable, bound_batches, segment_sums, slices, text_column, words_of
from stratafold.llm.shared import saved

#: What parts words, in learning as in scoring.
SPACE = r"[\x20\x09-\x0D]+"
TRAIN_ROWS = 12_000
LEXICON_SIZE = 1024
FOLDS, TREES, DEPTH, RATE, BINS = 4, 60, 4, 0.15, 32
THRESHOLD = 0.7
NEAR_WORDS = 5
STRONG, WEAK, LEAST_TEXTS = 4.0, 2.0, 4
#: Words of the second person, and characters that stand for letters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre tú te ti tus usted vosotros".split())
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
FEATURES = ("strong", "weak", "weight", "heaviest", "near_you", "capitals", "capital_words", "marks", "exclaims", "obfuscated", "undone", "words", "strong_count", "weak_count")


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def plain(word: str) -> str:
    """A word's letters from its first letter to its last, in lower case, if nothing else is between them; else ''."""
    low = word.lower()
    if low.isalpha():
        return low
    first = next((i for i, c in enumerate(low) if c.isalpha()), None)
    if first is None:
        return ""
    last = max(i for i, c in enumerate(low) if c.isalpha())
    core = low[first : last + 1]
    return core if core.isalpha() else ""


def undone(word: str) -> str:
    """A word with look-alike characters read as letters and other marks dropped."""
    return "".join(c for c in word.lower().translate(LOOKALIKE) if c.isalpha())


def terms(core: str) -> list[str]:
    """What a lexicon can hold of a word: itself, and its beginnings marked by '-'."""
    return [core, *(core[:n] + "-" for n in (4, 5, 6, 7) if len(core) > n)] if len(core) >= 4 else []


def _weight(core: str, lexicon: dict[str, float]) -> float:
    return max((lexicon.get(t, 0.0) for t in terms(core)), default=0.0)


def word_rows(words: list[str], lexicon: dict[str, float]) -> np.ndarray:
    """Of each word: weight, weight with look-alikes undone, whether it is a second person, length, letters, capitals, whether it is in capitals, exclamation marks, whether it is obfuscated, marks."""
    table = np.zeros((len(words), 10))
    for i, w in enumerate(words):
        core = plain(w)
        letters = core if len(core) == len(w) else "".join(c for c in w if c.isalpha())
        weight = _weight(core, lexicon)
        odd = bool(letters) and not core
        seen = weight
        if odd:
            seen = _weight(undone(w), lexicon)
        uppers = sum(map(str.isupper, w)) if not w.islower() else 0
        table[i] = (weight, seen, core in SECOND_PERSON, len(w), len(letters), uppers, len(letters) > 1 and uppers == len(letters), w.count("!"), odd, sum(not c.isalnum() for c in w) if len(letters) != len(w) else 0)
    return table


def word_table(lexicon: dict[str, float]) -> WordTable:
    return WordTable(lambda words: word_rows(words, lexicon))


def features(texts: pa.Array, lexicon: dict[str, float], table: WordTable | None = None) -> np.ndarray:
    """A row of FEATURES for each text. `table` remembers the `word_rows` of words."""
    words = words_of(texts)
    n = len(texts)
    rows = (table.of(words.distinct) if table else word_rows(words.distinct.to_pylist(), lexicon))[words.index]
    weight, seen = rows[:, 0], rows[:, 1]
    count = np.diff(words.begin).astype(float)
    per = lambda x: segment_sums(np.ascontiguousarray(x, dtype=float), words.begin)
    rate = lambda x, of: x / np.maximum(of, 1)
    hits = np.flatnonzero(seen >= WEAK)
    owner = words.owner()
    you = np.flatnonzero(rows[:, 2])
    near = np.zeros(len(rows))
    if len(you) and len(hits):
        at = np.searchsorted(you, hits)
        for other in (you[np.minimum(at, len(you) - 1)], you[np.maximum(at - 1, 0)]):
            near[hits[(np.abs(other - hits) <= NEAR_WORDS) & (owner[other] == owner[hits])]] = 1
    heaviest = np.zeros(n)
    np.maximum.at(heaviest, owner, seen)
    letters, chars = per(rows[:, 4]), per(rows[:, 3])
    strong, weak = per(seen >= STRONG), per((seen >= WEAK) & (seen < STRONG))
    columns = (
        rate(strong, count), rate(weak, count), rate(per(seen), count), heaviest, rate(per(near), count), rate(per(rows[:, 5]), letters), rate(per(rows[:, 6]), count),
        rate(per(rows[:, 9]), chars), rate(per(rows[:, 7]), chars), rate(per(rows[:, 8]), count), per((seen > 0) & (weight == 0)), np.log1p(count), strong, weak,
    )
    return np.stack(columns, axis=1)


class Trees:
    """Logistic gradient boosting of complete trees of DEPTH over binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.trees: list[tuple] = []
        binned = self.binned(x)
        margin = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += self._walk(binned, tree)
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        node, pick, cut = np.zeros(len(b), np.int64), np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for f in range(b.shape[1]):
                cell = (node - first) * BINS + b[:, f]
                gs = np.bincount(cell, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(cell, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                pick[first : first + width][better], cut[first : first + width][better] = f, at[better]
            node = 2 * node + 1 + (b[np.arange(len(b)), pick[node]] > cut[node])
        leaf = node - (2**DEPTH - 1)
        value = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        return pick, cut, value

    def _walk(self, b: np.ndarray, tree: tuple) -> np.ndarray:
        pick, cut, value = tree
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (b[rows, pick[node]] > cut[node])
        return value[node - (2**DEPTH - 1)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return self.start + sum((self._walk(b, t) for t in self.trees), np.zeros(len(b)))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares non-decreasing map from margin to label (pool adjacent violators)."""
    levels, at = np.unique(margin, return_inverse=True)
    weight = np.bincount(at, minlength=len(levels)).astype(float)
    blocks: list[list[float]] = []  # mean, weight, least and greatest margin
    for m, v, w in zip(levels, np.bincount(at, y, len(levels)) / weight, weight):
        blocks.append([float(v), float(w), m, m])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, _, high = blocks.pop()
            v1, w1, low, _ = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, low, high])
    x = np.array([e for b in blocks for e in (b[2], b[3])])
    return x, np.array([b[0] for b in blocks for _ in (0, 1)])


class Model:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon: dict[str, float], trees: Trees | None, knots: tuple[np.ndarray, np.ndarray] | None, share: float):
        self.lexicon, self.trees, self.knots, self.share = lexicon, trees, knots, share

    def score(self, texts: pa.Array, table: WordTable | None = None) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        margin = self.trees.margin(features(texts, self.lexicon, table))
        # a thousandth of the uncalibrated chance keeps the order inside a level of the calibration
        return 0.999 * np.interp(margin, *self.knots) + 0.001 / (1 + np.exp(-margin))


def _lexicons(train: DataFrame, size: int) -> list[dict[str, float]]:
    """Lexicons learned without fold 0, 1, ..., and one from all folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            texts, fold, toxic = text_column(batch).to_pylist(), batch.column("fold").to_pylist(), batch.column("toxic").to_pylist()
            for text, f, y in zip(texts, fold, toxic):
                for t in {t for w in {plain(w) for w in re.split(SPACE, text)} for t in terms(w)}:
                    found.setdefault(t, Counter())[2 * f + y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([c[i] for c in found.values()], pa.int64()) for i in range(2 * FOLDS))], ["term", *names])

    names = [f"n{i}" for i in range(2 * FOLDS)]
    counts = train.mapInArrow(run, "term string, " + ", ".join(f"{n} long" for n in names)).groupBy("term").agg(*(F.sum(n).alias(n) for n in names))
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in train.groupBy("fold", "toxic").count().collect()}
    toxic, clean = sum(F.col(n) for n in names[1::2]), sum(F.col(n) for n in names[::2])
    ratio = F.log((toxic + 0.5) / (clean + 0.5))
    rows = counts.filter(toxic >= LEAST_TEXTS).orderBy(F.desc(ratio), "term").limit(4 * size).collect()
    out = []
    for left in [*range(FOLDS), None]:
        keep = [f for f in range(FOLDS) if f != left]
        total = [sum(sizes.get((f, y), 0) for f in keep) for y in (0, 1)]
        odds = {}
        for r in rows:
            c, t = (sum(r[f"n{2 * f + y}"] for f in keep) for y in (0, 1))
            if t >= LEAST_TEXTS - 1:
                odds[r["term"]] = float(np.log((t + 0.5) / (total[1] - t + 0.5)) - np.log((c + 0.5) / (total[0] - c + 0.5)))
        best = sorted((v, k) for k, v in odds.items() if v >= WEAK)[-size:]
        out.append({k: v for v, k in best})
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, lexicon_size: int = LEXICON_SIZE) -> Model:
    """Learn from at most `rows` labelled documents that aren't held out."""
    bound_batches(docs.sparkSession)
    usable = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(labels["doc_id"].cast("long").alias("_id")).agg(F.max("toxic").alias("toxic"))
    usable = usable.filter(~held_out(F.col("_id")))
    sample = F.broadcast(usable.orderBy(F.xxhash64("_id"), "_id").limit(rows))  # at most TRAIN_ROWS narrow rows
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    joined = text.join(sample, F.col("doc_id") == F.col("_id")).select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    known = saved(joined.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"), F.max("fold").alias("fold")))  # at most TRAIN_ROWS
    lexicons = _lexicons(known, lexicon_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, fold = text_column(batch), batch.column("fold").to_numpy()
            both = []
            for first, n in slices(texts):
                part, f = texts.slice(first, n), fold[first : first + n]
                own = np.zeros((n, len(FEATURES)))
                for k in np.unique(f):
                    own[f == k] = features(part.filter(pa.array(f == k)), lexicons[k])
                both.append(own)
            x = np.concatenate(both) if both else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), batch.column("toxic"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "fold", "toxic", "x"])

    table = known.mapInArrow(run, "doc_id long, fold int, toxic int, x array<double>").toPandas()
    table = table.sort_values(["doc_id", "toxic"], kind="stable")
    y, fold = table["toxic"].to_numpy(float), table["fold"].to_numpy()
    if len(np.unique(y)) < 2:
        return Model({}, None, None, float(y.mean()) if len(y) else 0.0)
    x = np.array(table["x"].tolist())
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        own = fold == k
        if own.any() and (~own).any():
            margin[own] = Trees().fit(x[~own], y[~own]).margin(x[own])
    return Model(lexicons[-1], Trees().fit(x, y), isotonic(margin, y), float(y.mean()))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of `docs`."""
    bound_batches(docs.sparkSession)
    packed = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(packed)
        table = word_table(own.lexicon)
        for batch in batches:
            texts = text_column(batch)
            parts = [own.score(texts.slice(a, n), table) for a, n in slices(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(parts) if parts else np.empty(0))], ["doc_id", "score"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
