"""Vector best-fit packing: sequences with room for tokens, documents and attention cost.

A piece of n tokens asks for (n, 1, n * n): its tokens, one document, and the
pairs of tokens that attend to each other. A sequence has what is left of three
capacities, and takes a piece only if all three have room. Among those that do,
`norm` takes the one whose weighted residuals are least after the piece is in
(Panigrahy et al., "Heuristics for vector bin packing"), `dot` the one whose
weighted dot product of demand and residual is largest. Both are searched exactly:
open sequences lie in levels by residual tokens, a level's token term bounds its
score, and the search ends where no later level can be better.

Each input partition is one stream. Documents longer than a sequence are cut from
their end, so only the first piece is shorter; full pieces are sequences of their
own. Pieces are gathered up to HELD_PIECES and placed longest first, and open
sequences stay open to the end of the stream. A placed piece needs no memory but a
row, so what a worker holds is bounded by HELD_PIECES (with `ids`, HELD_TOKENS) and
by three numbers per open sequence.

Defined cases: null text is the empty text and gives the end id alone; repeated
rows and rows without an id are documents of their own; an empty table gives no
rows; other columns are ignored. A sequence id is the partition's number and a
counter, so a task that runs again on the same rows gives the same ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from stratafold.llm.arrowtext import bound_batches, give_back, slices, text_column
from stratafold.llm.packing import gathered

CAPACITY = 2048
END_ID = 0
#: Weights of the token, document and attention terms of a score: tokens decide, the others part equal fits.
WEIGHTS = (1.0, 1e-4, 1e-4)
HELD_PIECES, HELD_TOKENS = 250_000, 8 << 20
#: Chunks whose ids a worker remembers, and bytes of text that are cut into chunks at a time.
REMEMBERED, SLICE = 300_000, 4 << 20
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_FIELDS = [("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset"))]


class ByteTokenizer:
    """Ids of whole texts by a byte-level tokenizer that splits words before white space.

    A text is cut before each run of ASCII white space, and between an ASCII letter
    and an ASCII mark; the tokenizer never joins across such a cut, so a chunk has ids
    of its own, which are found once and remembered, across tasks of one worker. New
    chunks that can stand side by side are encoded joined, and parted again by the
    bytes each id stands for, with the file's own merges run by `tiktoken` where ids
    are in the order of merges (five times as fast). Texts with other white space,
    whose runs a cut could part, or with a special token are encoded whole.
    """

    #: White space beyond ASCII.
    OTHER_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    ASCII_SPACE = b" \t\n\v\f\r"
    MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    #: Chunks above these bytes are encoded by themselves.
    LONG = 1000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.merger = self._merger(path)
        self.specials = [t.content for t in self.model.get_added_tokens_decoder().values()]
        vocabulary = self.model.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a byte-level token has one character a byte
            self.bytes[i] = len(token)
        self.space, self.letter, self.mark = (np.zeros(256, bool) for _ in range(3))
        self.space[list(self.ASCII_SPACE)] = self.mark[list(self.MARKS)] = True
        self.letter[65:91] = self.letter[97:123] = True
        self.known = pa.array([], pa.string())
        self.ids, self.begin = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.met = np.empty(0, np.int64)
        self.turn = 0

    @staticmethod
    def _merger(path: str):
        """The file's merges as a `tiktoken` encoding; None unless its ids are bytes' ids and then the merges' in order."""
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        merged = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        names = sorted(model["vocab"], key=model["vocab"].get)
        # a byte's character is itself if it is printed, else one from 256 on, in order
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printed)))}
        if [model["vocab"][n] for n in names] != list(range(len(names))) or sorted(names[:256]) != sorted(byte) or names[256:] != ["".join(m) for m in merged]:
            return None
        ranks = {bytes(byte[c] for c in name): i for i, name in enumerate(names)}
        return tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _joined(self, text: str) -> np.ndarray:
        return self._each([text])[0] if self.merger is None else self.merger.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(chunks of all texts, number of chunks before each text); the chunks lie on the texts' own buffer."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        low, high = int(offsets[0]), int(offsets[-1])
        if low == high:
            return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[low:high]
        blank = self.space[data]
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        cut[1:] |= self.mark[data[1:]] & self.letter[data[:-1]]
        cut[offsets[:-1][np.diff(offsets) > 0] - low] = True
        starts = np.flatnonzero(cut) + low
        ends = pa.py_buffer(np.append(starts, high).astype(np.int32).tobytes())
        return pa.Array.from_buffers(pa.string(), len(starts), [None, ends, texts.buffers()[2]]), np.searchsorted(starts, offsets)

    def _learn(self, chunks: pa.Array) -> np.ndarray:
        """Encode new chunks; where each is remembered."""
        regular = pc.match_substring_regex(chunks, r"^[ \t\n\v\f\r](?s:.)*[^ \t\n\v\f\r]$").to_numpy(zero_copy_only=False) & (pc.binary_length(chunks).to_numpy() <= self.LONG)
        slot, first = np.empty(len(chunks), np.int64), len(self.known)
        for rows, joined in ((np.flatnonzero(regular), True), (np.flatnonzero(~regular), False)):
            if not len(rows):
                continue
            some = chunks.take(pa.array(rows))
            slot[rows] = first + np.arange(len(rows))
            first += len(rows)
            found = None
            if joined:
                ids = self._joined("".join(some.to_pylist()))
                ends = np.cumsum(pc.binary_length(some).to_numpy().astype(np.int64))
                reached = np.cumsum(self.bytes[ids])
                at = np.searchsorted(reached, ends)
                if at[-1] < len(ids) and (reached[at] == ends).all():
                    found = ids, np.diff(at + 1, prepend=0)
            if found is None:
                parts = self._each(some.to_pylist())
                found = np.concatenate(parts), np.asarray([len(p) for p in parts], np.int64)
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(found[1])])
            self.ids = np.concatenate([self.ids, found[0]])
            self.known = pa.concat_arrays([self.known, some])
        self.met = np.concatenate([self.met, np.full(len(chunks), self.turn)])
        return slot

    def _forget_some(self) -> None:
        """Keep the half of REMEMBERED that was met last."""
        keep = np.sort(np.argsort(-self.met, kind="stable")[: REMEMBERED // 2])
        length = np.diff(self.begin)[keep]
        begin = np.concatenate(([0], np.cumsum(length)))
        self.ids = self.ids[np.repeat(self.begin[keep] - begin[:-1], length) + np.arange(begin[-1])]
        self.known, self.begin, self.met = self.known.take(pa.array(keep)), begin, self.met[keep]

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        chunks, first = self._chunks(texts)
        self.turn += 1
        if len(self.known) > REMEMBERED:
            self._forget_some()
        coded = chunks.dictionary_encode()
        found = pc.index_in(coded.dictionary, self.known)
        slot = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        if found.null_count:
            slot[slot < 0] = self._learn(coded.dictionary.filter(pc.is_null(found)))
        self.met[slot] = self.turn
        slot = slot[coded.indices.to_numpy(zero_copy_only=False)]
        begin, length = self.begin[slot], self.begin[slot + 1] - self.begin[slot]
        ends = np.cumsum(length)
        source = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        source += np.repeat(begin - (ends - length), length)
        return self.ids[source], np.concatenate(([0], ends))[first]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin)."""
        odd = pc.match_substring_regex(texts, self.OTHER_SPACE)
        for special in self.specials:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        if not pc.any(odd).as_py():
            return self._encode_plain(texts)
        ids, begin = self._encode_plain(pc.if_else(odd, "", texts))
        parts = np.split(ids, begin[1:-1])
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        for i, own in zip(whole, self._each(texts.filter(odd).to_pylist())):
            parts[i] = own
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


class VectorBestFit:
    """Open sequences by what they have left of tokens, documents and attention cost."""

    def __init__(self, capacity: int, documents: int, attention: int, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS):
        if rule not in ("norm", "dot") or documents < 1 or attention < 1 or min(weights) < 0:
            raise ValueError("rule is norm or dot, capacities are at least 1 and weights at least 0")
        self.capacity, self.documents, self.attention, self.rule = capacity, documents, attention, rule
        self.by_tokens, self.by_documents, self.by_attention = weights
        self.count = np.zeros(capacity + 1, np.int64)
        self.levels: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(capacity + 1)]
        self.made = 0

    def score(self, size: int, left: int, documents: int, attention: int) -> float:
        """Lower is better."""
        if self.rule == "norm":
            return self.by_tokens * ((left - size) / self.capacity) ** 2 + self.by_documents * ((documents - 1) / self.documents) ** 2 + self.by_attention * ((attention - size * size) / self.attention) ** 2
        return -(self.by_tokens * size * left / self.capacity**2 + self.by_documents * documents / self.documents**2 + self.by_attention * size * size * attention / self.attention**2)

    def bound(self, size: int, left: int) -> float:
        """No sequence with `left` tokens, or with a level that is searched later, scores less."""
        if self.rule == "norm":
            return self.by_tokens * ((left - size) / self.capacity) ** 2
        return -(self.by_tokens * size * left / self.capacity**2 + self.by_documents / self.documents + self.by_attention * size * size / self.attention)

    def choose(self, size: int) -> tuple[int, tuple[int, int]] | None:
        """(tokens left, (documents left, attention left)) of the best open sequence; None if none has room."""
        levels = np.flatnonzero(self.count[size:]) + size
        best, found = float("inf"), None
        for left in levels.tolist() if self.rule == "norm" else levels[::-1].tolist():
            if self.bound(size, left) >= best:
                break
            for state in self.levels[left]:
                if state[0] >= 1 and state[1] >= size * size:
                    score = self.score(size, left, *state)
                    if score < best or (score == best and found and found[0] == left and state < found[1]):
                        best, found = score, (left, state)
        return found

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        found = self.choose(size)
        if found is None:
            sequence, left, documents, attention = self.made, self.capacity, self.documents, self.attention
            self.made += 1
        else:
            left, (documents, attention) = found
            level = self.levels[left]
            sequence = level[found[1]].pop()
            if not level[found[1]]:
                del level[found[1]]
            self.count[left] -= 1
        if left > size and documents > 1 and attention > size * size:
            self.levels[left - size].setdefault((documents - 1, attention - size * size), []).append(sequence)
            self.count[left - size] += 1
        return sequence, self.capacity - left


_tokenizers: dict[str, ByteTokenizer] = {}


def _tokenizer(path: str) -> ByteTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ByteTokenizer(path)
    return _tokenizers[path]


def pieces_of(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones behind a first one that may be shorter."""
    first = (n - 1) % longest + 1
    return [(0, first), *((start, longest) for start in range(first, n, longest))]


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, documents: int | None = None, attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS, end_id: int = END_ID, ids: bool = False, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its place in its document and in its sequence; with `ids` also its token ids.

    `documents` and `attention` bound a sequence's pieces and the sum of their squared
    lengths; left out, they are the most that `capacity` tokens can hold, so that only
    the choice among sequences depends on them. See the module's text.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer_path = str(tokenizer_path)
    documents, attention = documents or capacity, attention or capacity**2
    longest = min(capacity, isqrt(attention))
    VectorBestFit(capacity, documents, attention, rule, weights)
    bound_batches(docs.sparkSession)
    schema = pa.schema([*_FIELDS, ("ids", pa.list_(pa.int32()))] if ids else _FIELDS)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = _tokenizer(tokenizer_path)
        base = TaskContext.get().partitionId() << 40
        open_ = VectorBestFit(capacity, documents, attention, rule, weights)
        held: list[tuple] = []
        rows: list[tuple] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            rows.clear()
            return batch

        def settle() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda piece: -piece[3])
            for piece in held:
                sequence, offset = open_.place(piece[3])
                rows.append((*piece[:5], base + sequence, offset, *piece[5:]))
                if len(rows) >= 20_000:
                    yield flush()
            held.clear()
            yield flush()

        for batch in gathered(batches):
            texts, names = text_column(batch), batch.column("doc_id").to_pylist()
            for first, count in slices(texts, SLICE):
                found, begin = tokenizer.encode(texts.slice(first, count))
                for i in range(count):
                    own = np.append(found[begin[i] : begin[i + 1]], np.uint32(end_id)).astype("<u4", copy=False)
                    for piece, (start, length) in enumerate(pieces_of(len(own), longest)):
                        part = own[start : start + length]
                        held.append((names[first + i], piece, start, length, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if ids else [])))
                        tokens += length
                    if len(held) >= HELD_PIECES or (ids and tokens >= HELD_TOKENS):
                        yield from settle()
                        tokens = 0
        yield from settle()
        give_back()

    source = docs.select(docs[doc_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(stream, SCHEMA + (", ids array<int>" if ids else ""))
