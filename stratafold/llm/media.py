"""Media columns: payloads stored in, and read back from, progressive JPEG.

The unit in which the format is lossless is the quantised transform coefficient:
a payload's bytes, less 128, are the 64 coefficients of a block, quantised by 1,
and blocks fill the 4:2:0 units of a nearly square image in order. Reading
accumulates all scans into coefficient arrays, takes the payload from them, and
turns them into full-resolution RGB tensors, from which features come. A
comment in each file says how much of it is payload.

Payloads over FRAME_BYTES are a run of files, one after the other in the same
column. Files are written and read a few at a time (SLICE bytes of payload), and
digests and features go on from file to file, so beside a text and its stored form
memory does not grow with the text.

Defined cases: null text is the empty text; the payload is the UTF-8 text and
zero bytes up to a positive multiple of 64; equal texts give equal columns;
repeated rows are rows of their own; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from stratafold.llm import jpeg
from stratafold.llm.arrowtext import bound_batches, slices, text_column

FRAME_BYTES = 1 << 20
SLICE = 2 << 20
UNIT = 384


def frames_of(payload: bytes) -> tuple[list[np.ndarray], tuple[int, int]]:
    """Coefficient planes (Y, Cb, Cr) and (wide, high) in units of a payload of whole blocks."""
    wide, high = jpeg.grid(-(-len(payload) // UNIT))
    cells = np.zeros(wide * high * UNIT, np.int16)
    cells[: len(payload)] = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    cells = cells.reshape(high, wide, 6, 64)
    luma = cells[:, :, :4].reshape(high, wide, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(2 * high, 2 * wide, 64)
    return [luma, cells[:, :, 4], cells[:, :, 5]], (wide, high)


def payload_of(image: jpeg.Image, coefficients: np.ndarray) -> bytes:
    """The payload of an image that `frames_of` has laid out."""
    (size,) = struct.unpack(">Q", next(c for c in image.comments if c[:8] == b"payload:")[8:])
    high, wide = image.components[1].blocks
    planes = [coefficients[c.base : c.base + c.blocks[0] * c.blocks[1]] for c in image.components]
    luma = planes[0].reshape(high, 2, wide, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
    cells = np.concatenate([luma, planes[1].reshape(-1, 1, 64), planes[2].reshape(-1, 1, 64)], axis=1).reshape(-1)
    return (cells[:size] + 128).astype(np.uint8).tobytes()


def store(texts: list[bytes]) -> list[bytes]:
    """The stored form of each text."""
    out: list[list[bytes]] = [[] for _ in texts]
    held: list[tuple] = []
    size = 0

    def write() -> None:
        owners, planes, shapes, comments = zip(*held)
        for i, file in zip(owners, jpeg.write(list(planes), list(shapes), list(comments))):
            out[i].append(file)
        held.clear()

    for i, text in enumerate(texts):
        whole = len(text) + (-len(text) % 64 or (0 if text else 64))
        for at in range(0, whole, FRAME_BYTES):
            part = text[at : at + FRAME_BYTES]
            part += bytes(min(FRAME_BYTES, whole - at) - len(part))
            held.append((i, *frames_of(part), b"payload:" + struct.pack(">Q", len(part))))
            size += len(part)
            if size >= SLICE:
                write()
                size = 0
    if held:
        write()
    return [b"".join(files) for files in out]


def parse_all(media: bytes) -> Iterator[jpeg.Image]:
    """The files of a stored form, one after the other."""
    at = 0
    while at < len(media):
        image = jpeg.parse(media, at)
        at = image.end
        yield image


class Feature:
    """Number of tensors, size of the first, mean colour in thousandths, and a 4 x 4 thumbnail of brightness, both over all tensors."""

    def __init__(self) -> None:
        self.number, self.cells, self.first = 0, 0, None
        self.sums, self.bright, self.area = np.zeros(3, np.int64), np.zeros((4, 4), np.int64), np.zeros((4, 4), np.int64)

    def add(self, t: np.ndarray) -> None:
        self.first = self.first or t.shape
        down, across = ([n * k // 4 for k in range(4)] for n in t.shape[:2])
        bands = np.add.reduceat(t, down, axis=0, dtype=np.uint32)  # of the four bands: columns and colours
        parts = np.add.reduceat(bands, across, axis=1, dtype=np.int64)
        self.sums += parts.sum(axis=(0, 1))
        self.bright += parts.sum(axis=2)
        self.area += np.outer(*([b - a for a, b in zip(edge, [*edge[1:], n])] for edge, n in zip((down, across), t.shape)))
        self.cells += t.shape[0] * t.shape[1]
        self.number += 1

    def __str__(self) -> str:
        thumb = self.bright // (3 * self.area)
        return f"{self.number}x{self.first[1]}x{self.first[0]};{','.join(str(int(s) * 1000 // self.cells) for s in self.sums)};{''.join(f'{min(255, int(v)):02x}' for v in thumb.ravel())}"


class ReadBack:
    """What a stored form gives back, file by file."""

    def __init__(self, doc_id: int | None, n_bytes: int, stored: bytes):
        self.about = doc_id, n_bytes
        self.stored = len(stored), hashlib.sha256(stored).hexdigest()
        self.size, self.digest, self.tail, self.feature = 0, hashlib.sha256(), b"", Feature()

    def add(self, image: jpeg.Image, coefficients: np.ndarray) -> None:
        payload = payload_of(image, coefficients)
        self.size += len(payload)
        self.digest.update(payload)
        self.tail = (self.tail + payload[-64:])[-64:]
        self.feature.add(jpeg.rgb(image, coefficients))

    def row(self) -> tuple:
        return (*self.about, self.size, self.digest.hexdigest(), zlib.crc32(self.tail), *self.stored, str(self.feature))


ENCODED = "doc_id long, n_bytes long, media binary"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
TENSORS = "doc_id long, frame int, height int, width int, rgb binary"


def encode(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the stored form of each row's text."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = text_column(batch), batch.column("doc_id")
            for first, n in slices(texts, SLICE):
                raw = texts.slice(first, n).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), pa.array(list(map(len, raw)), pa.int64()), pa.array(store(raw), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(docs[doc_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, ENCODED)


def _decoded(media: Iterator[bytes]) -> Iterator[list[tuple[int, jpeg.Image, np.ndarray]]]:
    """Runs of (row, image, coefficients of the images read along with it) of stored forms, in order, of about SLICE bytes of payload."""
    held: list[tuple[int, jpeg.Image]] = []
    size = 0
    for row, stored in enumerate(media):
        for image in parse_all(stored):
            held.append((row, image))
            size += sum(c.blocks[0] * c.blocks[1] for c in image.components) * 64
            if size >= SLICE:
                coefficients = jpeg.read([i for _, i in held])
                yield [(r, i, coefficients) for r, i in held]
                held, size = [], 0
    if held:
        coefficients = jpeg.read([i for _, i in held])
        yield [(r, i, coefficients) for r, i in held]


def tensors(encoded: DataFrame) -> DataFrame:
    """The full-resolution RGB tensors of a media column, one row per file: height x width x 3 bytes."""
    bound_batches(encoded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in TENSORS.split(", ")]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            ids, frame, at = batch.column("doc_id").to_pylist(), 0, -1
            for run in _decoded(m.as_py() for m in batch.column("media")):
                rows = []
                for row, image, coefficients in run:
                    frame, at = (frame + 1 if row == at else 0), row
                    made = jpeg.rgb(image, coefficients)
                    rows.append((ids[row], frame, made.shape[0], made.shape[1], made.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    return encoded.select("doc_id", "media").mapInArrow(decode, TENSORS)


def read_back(encoded: DataFrame) -> DataFrame:
    """What the stored bytes give back: payload digests, the stored form's digest, and a feature of the RGB tensors."""
    bound_batches(encoded.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGEST.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in DIGEST.split(", ")]
        for batch in batches:
            ids, sizes, media, rows = batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), []
            at, back = -1, None
            for run in _decoded(m.as_py() for m in media):
                for row, image, coefficients in run:
                    if row != at:
                        if back is not None:
                            rows.append(back.row())
                        at, back = row, ReadBack(ids[row], sizes[row], media[row].as_py())
                    back.add(image, coefficients)
            if back is not None:
                rows.append(back.row())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names)

    return encoded.select("doc_id", "n_bytes", "media").mapInArrow(read, DIGEST)
