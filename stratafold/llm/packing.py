"""Sum-of-squares online packing of tokenised documents into windows of a fixed capacity.

Each input partition is one stream. A document's ids are cut at the capacity;
full windows are done at once, and the rest goes to the fill level h that makes
the sum of squared level counts smallest (Csirik et al., "On the sum-of-squares
algorithm for bin packing"). The counts are one array indexed by level, so one
placement costs one vector expression whatever the number of open windows.

Open windows are settled when they hold `SETTLE_TOKENS`, and at the end of the
stream: the emptiest windows are cut up to fill the gaps of the fullest ones
until one partly filled window is left, which the stream goes on with. What is
left at the end is cut at powers of two, lengths that need no padding. Memory is
therefore bounded by `SETTLE_TOKENS`, not by the partition.

Defined cases: null text is the empty text and gives the end id alone; repeated
rows are separate documents; an empty table gives no rows; other columns of the
input are ignored. A sequence id is the partition's number and a counter, so a
task that runs again on the same rows gives the same ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from stratafold.llm.arrowtext import bound_batches, give_back, slices, text_column, words_of

CAPACITY = 4096
END_ID = 2
SETTLE_TOKENS = 4 << 20
#: Words whose ids a worker remembers.
REMEMBERED_WORDS = 300_000
#: Bytes of text that are split into words at a time.
SLICE = 4 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


class WordTokenizer:
    """Ids of whole texts by a tokenizer that never joins across ASCII white space.

    Distinct words are encoded once and remembered, across tasks of one worker;
    beyond REMEMBERED_WORDS the half that was met last stays. New words are
    encoded many at a time. Words of letters, with or without marks behind, give
    as many ends of words as they have parts, which tells their ids apart; others
    are parted by a control character that has one id of its own, and a word that
    holds that character is encoded alone.
    """

    MARK = "\x01"
    #: ASCII characters that are neither letters, digits nor white space.
    MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    AT_ONCE = 50_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        (self.mark_id,) = self.model.encode(self.MARK, add_special_tokens=False).ids
        vocabulary = self.model.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known = pa.array([], pa.string())
        self.ids, self.begin = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.met = np.empty(0, np.int64)
        self.turn = 0

    def _encode(self, text: str) -> np.ndarray:
        return np.asarray(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _by_ends(self, words: pa.Array, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, number of ids of each word) of words of `parts` parts; None if the ends of words don't add up."""
        ids = self._encode(" ".join(words.to_pylist()))
        ends = np.flatnonzero(self.ends_word[ids])
        if len(ends) != parts.sum() or (len(ids) and ends[-1] != len(ids) - 1):
            return None
        return ids, np.diff(ends[np.cumsum(parts) - 1] + 1, prepend=0)

    def _by_marks(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of any words."""
        plain = [w for w in words if self.MARK not in w]
        ids = self._encode(f" {self.MARK} ".join(plain))
        marks = np.flatnonzero(ids == self.mark_id)
        rest, lengths = np.delete(ids, marks), np.diff(marks, prepend=-1, append=len(ids)) - 1
        if len(plain) == len(words):
            return rest, lengths
        parts = iter(np.split(rest, np.cumsum(lengths)[:-1]) if plain else [])
        own = [self._encode(w) if self.MARK in w else next(parts) for w in words]
        return np.concatenate(own), np.asarray(list(map(len, own)))

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Encode new words; where each is remembered."""
        letters = pc.utf8_is_alpha(words)
        marked = pc.utf8_is_alpha(pc.utf8_rtrim(words, self.MARKS))
        parts = np.where(letters.to_numpy(zero_copy_only=False), 1, 2)
        regular = marked.to_numpy(zero_copy_only=False)
        slot, first = np.empty(len(words), np.int64), len(self.known)
        for rows in (np.flatnonzero(regular), np.flatnonzero(~regular)):
            slot[rows] = first + np.arange(len(rows))
            first += len(rows)
            for at in range(0, len(rows), self.AT_ONCE):
                own = rows[at : at + self.AT_ONCE]
                some = words.take(pa.array(own))
                found = self._by_ends(some, parts[own]) if regular[own[0]] else None
                ids, lengths = found or self._by_marks(some.to_pylist())
                self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(lengths)])
                self.ids = np.concatenate([self.ids, ids])
                self.known = pa.concat_arrays([self.known, some])
        self.met = np.concatenate([self.met, np.full(len(words), self.turn)])
        return slot

    def _forget_some(self) -> None:
        """Keep the half of REMEMBERED_WORDS that was met last."""
        keep = np.sort(np.argsort(-self.met, kind="stable")[: REMEMBERED_WORDS // 2])
        length = np.diff(self.begin)[keep]
        begin = np.concatenate(([0], np.cumsum(length)))
        self.ids = self.ids[np.repeat(self.begin[keep] - begin[:-1], length) + np.arange(begin[-1])]
        self.known, self.begin, self.met = self.known.take(pa.array(keep)), begin, self.met[keep]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin)."""
        # the tokenizer reads special tokens before it lowers case, so texts that may hold one stay as they are
        split = words_of(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        self.turn += 1
        if len(self.known) > REMEMBERED_WORDS:
            self._forget_some()
        found = pc.index_in(split.distinct, self.known)
        slot = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        if found.null_count:
            slot[slot < 0] = self._learn(split.distinct.filter(pc.is_null(found)))
        self.met[slot] = self.turn
        slot = slot[split.index]
        begin, length = self.begin[slot], self.begin[slot + 1] - self.begin[slot]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total, dtype=np.int64)
        source += np.repeat(begin - (ends - length), length)
        return self.ids[source], np.concatenate(([0], ends))[split.begin]


class SumOfSquares:
    """Windows of one stream. `emit(parts)` gets the parts of a finished window; a part is (doc, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, emit: Callable[[list[tuple]], None]):
        self.capacity, self.emit = capacity, emit
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(capacity + 1)]
        self.held = 0

    def level_for(self, size: int) -> int:
        """The fill level to place `size` on; 0 opens a window. Ties go to the fullest level."""
        room = self.capacity - size
        # growth of the sum of squares, less 1, by level: opening, then moving a window up from h, closing at the capacity
        growth = 2 * (self.count[size:] - self.count[: room + 1]) + 1
        growth[0] = 2 * self.count[size]
        growth[room] -= 1 if room else 0
        growth[1:][self.count[1 : room + 1] == 0] = np.iinfo(np.int64).max
        return room - int(np.argmin(growth[::-1]))

    def add(self, doc: int, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.capacity:
            self.emit([(doc, at, ids[at : at + self.capacity], n)])
            at += self.capacity
        if at < n:
            self.place((doc, at, ids[at:].copy(), n))
        if self.held > SETTLE_TOKENS:
            self.settle()

    def place(self, part: tuple) -> None:
        size = len(part[2])
        level = self.level_for(size)
        window = self._pop(level) if level else []
        window.append(part)
        self._push(level + size, window)

    def _pop(self, level: int) -> list[tuple]:
        self.count[level] -= 1
        self.held -= level
        return self.open[level].pop()

    def _push(self, level: int, window: list[tuple]) -> None:
        if level == self.capacity:
            self.emit(window)
        else:
            self.count[level] += 1
            self.held += level
            self.open[level].append(window)

    def settle(self) -> None:
        """Fill the fullest open windows with cuts of the emptiest until at most one is open."""
        levels = [h for h in np.flatnonzero(self.count) for _ in range(self.count[h])]
        windows = [self._pop(h) for h in levels]
        low, high, loose = 0, len(windows) - 1, []
        while low < high or (low == high and loose):
            gap = self.capacity - levels[high]
            while gap and (loose or low < high):
                if not loose:
                    loose, low = windows[low], low + 1
                    continue
                doc, start, ids, n = loose.pop()
                if len(ids) > gap:
                    loose.append((doc, start + gap, ids[gap:], n))
                    ids = ids[:gap]
                windows[high].append((doc, start, ids, n))
                gap -= len(ids)
            levels[high] = self.capacity - gap
            if gap:
                break
            self.emit(windows[high])
            high -= 1
        rest = (windows[high] if low <= high else []) + loose
        if rest:
            self._push(sum(len(p[2]) for p in rest), rest)

    def close(self) -> None:
        """Settle, then cut the last window at powers of two, which need no padding."""
        self.settle()
        for level in np.flatnonzero(self.count):
            rest = self._pop(int(level))
            for bit in reversed(range(int(level).bit_length())):
                size, part = (1 << bit) & int(level), []
                while size:
                    doc, start, ids, n = rest.pop(0)
                    if len(ids) > size:
                        rest.insert(0, (doc, start + size, ids[size:], n))
                        ids = ids[:size]
                    part.append((doc, start, ids, n))
                    size -= len(ids)
                if part:
                    self.emit(part)


def gathered(batches: Iterator[pa.RecordBatch], limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about `limit` bytes, as a longer run of text has fewer new words for its length."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: where it lies in its document and in its sequence. See the module's text."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer_path = str(tokenizer_path)
    bound_batches(docs.sparkSession)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = _tokenizer(tokenizer_path)
        base = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        made = 0

        def emit(parts: list[tuple]) -> None:
            nonlocal made
            at = 0
            for doc, start, ids, n in parts:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()), n, base + made, at))
                at += len(ids)
            made += 1

        def flush() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(ARROW_SCHEMA)
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=ARROW_SCHEMA)
            rows.clear()
            return batch

        windows = SumOfSquares(capacity, emit)
        for batch in gathered(batches):
            texts, docs_ = text_column(batch, "text"), batch.column("doc_id").to_pylist()
            for first, count in slices(texts, SLICE):
                ids, begin = tokenizer.encode(texts.slice(first, count))
                for i in range(count):
                    windows.add(docs_[first + i], np.append(ids[begin[i] : begin[i + 1]], np.uint32(end_id)))
                if len(rows) >= 20_000:
                    yield flush()
        windows.close()
        yield flush()
        give_back()

    source = docs.select(docs[doc_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(stream, SCHEMA)
