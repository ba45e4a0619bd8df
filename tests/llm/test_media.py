import hashlib
import struct
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafold.llm import jpeg, media

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def image_of(units, make):
    wide, high = jpeg.grid(units)
    return [make((2 * high, 2 * wide, 64)), make((high, wide, 64)), make((high, wide, 64))], (wide, high)


def test_known_zigzag():
    assert jpeg.ZIGZAG[:15].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4] and sorted(jpeg.ZIGZAG) == list(range(64))


def test_coefficients_survive_all_scans():
    rng = np.random.default_rng(0)
    kinds = [
        lambda s: rng.integers(-128, 128, s),
        lambda s: (rng.random(s) < 0.1) * rng.integers(-128, 128, s),
        lambda s: (rng.random(s) < 0.01) * rng.integers(-2, 3, s),
        lambda s: np.zeros(s, np.int64),
        lambda s: rng.integers(-1, 2, s),
        lambda s: rng.integers(-1000, 1000, s),
    ]
    images = [image_of(u, k) for u in (1, 2, 5, 30) for k in kinds]
    files = jpeg.write([c for c, _ in images], [s for _, s in images], [b""] * len(images))
    parsed = [jpeg.parse(f) for f in files]
    got = jpeg.read(parsed)
    for (planes, _), image in zip(images, parsed):
        for plane, c in zip(planes, image.components):
            assert (got[c.base : c.base + plane.size // 64] == plane.reshape(-1, 64)).all()


def slow_read(data):
    """Coefficients of a one-component file, symbol by symbol, as the standard describes it."""
    image = jpeg.parse(data)
    c = image.components[0]
    out = np.zeros((c.blocks[0] * c.blocks[1], 64), int)
    for _, tables, first, last, high, low, every, parts in image.scans:
        n = every or len(out)
        for part, raw in enumerate(parts):
            bits = "".join(f"{b:08b}" for b in raw.replace(b"\xff\x00", b"\xff"))
            at, eob, pred = 0, 0, 0

            def take(k):
                nonlocal at
                at += k
                return int(bits[at - k : at], 2) if k else 0

            def symbol(t):
                nonlocal at
                found = int(t.look[int(bits[at : at + 16].ljust(16, "1"), 2)])
                at += found >> 8
                return found & 255

            def value(size):
                v = take(size)
                return v if not size or v >> (size - 1) else v - (1 << size) + 1

            for block in out[part * n : (part + 1) * n]:
                if first == 0:
                    if high:
                        block[0] |= take(1) << low
                    else:
                        pred += value(symbol(tables[0][0]))
                        block[0] = pred << low
                    continue
                k = first
                if not high:
                    if eob:
                        eob -= 1
                        continue
                    while k <= last:
                        s = symbol(tables[0][1])
                        if s & 15:
                            k += s >> 4
                            block[k] = value(s & 15) << low
                            k += 1
                        elif s == 0xF0:
                            k += 16
                        else:
                            eob = (1 << (s >> 4)) + take(s >> 4) - 1
                            break
                    continue
                while k <= last:
                    run, new = 64, 0
                    if not eob:
                        s = symbol(tables[0][1])
                        run = s >> 4
                        if s & 15:
                            new = (1 << low) if take(1) else -(1 << low)
                        elif s != 0xF0:
                            eob, run = (1 << run) + take(run), 64
                    while k <= last:
                        if block[k]:
                            if take(1):
                                block[k] += np.sign(block[k]) << low
                        elif run == 0:
                            block[k] = new
                            k += 1
                            break
                        else:
                            run -= 1
                        k += 1
                if eob:
                    eob -= 1
    return out


def bit_string(codes):
    bits = "".join(f"{c:0{n}b}" for c, n in codes if n)
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


@pytest.mark.parametrize("seed", range(4))
def test_ends_of_several_blocks_and_refined_bands_are_read(seed):
    """A grey file with band ends over many blocks (which the writer never makes), against the slow reader."""
    rng = np.random.default_rng(seed)
    flat = jpeg.Table(bytes([0] * 7 + [240] + [0] * 8), bytes(s for s in range(256) if s & 15 < 15))
    wide = high = 40
    n = 25
    frame = struct.pack(">BHHB", 8, high, wide, 1) + bytes((1, 0x11, 0))
    out = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0]) + bytes([2]) * 64) + jpeg._segment(0xC2, frame)
    out += b"".join(jpeg._segment(0xC4, bytes([k]) + flat.counts + flat.symbols) for k in (0, 0x10))
    code = lambda s: (int(flat.code[s]), int(flat.length[s]))

    def scan(first, last, high_, low, codes):
        return jpeg._segment(0xDA, bytes((1, 1, 0, first, last, high_ << 4 | low))) + bit_string(codes)

    dc = [c for _ in range(n) for c in (code(3), (int(rng.integers(0, 8)), 3))]
    out += scan(0, 0, 0, 1, dc) + scan(0, 0, 1, 0, [(int(rng.integers(0, 2)), 1) for _ in range(n)])
    codes, block, state = [], 0, np.zeros((n, 64), bool)
    while block < n:
        k = 1
        while True:
            if rng.random() < 0.3 or k > 63:
                if k <= 63:
                    r = int(rng.integers(0, 4))
                    span = min((1 << r) + int(rng.integers(0, 1 << r)), n - block)
                    r = span.bit_length() - 1
                    codes += [code(r << 4), (span - (1 << r), r)]
                    block += span
                else:
                    block += 1
                break
            run = int(rng.integers(0, min(6, 64 - k)))
            codes += [code(run << 4 | 2), (int(rng.integers(0, 4)), 2)]
            state[block, k + run] = True
            k += run + 1
    out += scan(1, 63, 0, 1, codes)
    codes, block = [], 0  # refining: random new values, correction bits for known ones, then an end over the rest
    old = state.copy()
    for block in range(int(rng.integers(0, n))):
        k = 1
        while k <= 63:
            zeros = [i for i in range(k, 64) if not old[block, i]]
            if len(zeros) < 3 or rng.random() < 0.3:
                codes += [code(0), *((int(rng.integers(0, 2)), 1) for i in range(k, 64) if old[block, i])]
                break
            run = int(rng.integers(0, min(5, len(zeros) - 1)))
            land = zeros[run]
            codes += [code(run << 4 | 1), (int(rng.integers(0, 2)), 1), *((int(rng.integers(0, 2)), 1) for i in range(k, land) if old[block, i])]
            k = land + 1
        else:
            continue
    done = block + 1 if codes else 0
    while done < n:
        span = min(n - done, 3)
        r = span.bit_length() - 1
        codes += [code(r << 4), (span - (1 << r), r), *((int(rng.integers(0, 2)), 1) for b in range(done, done + span) for i in range(1, 64) if old[b, i])]
        done += span
    out += scan(1, 63, 1, 0, codes) + b"\xff\xd9"
    image = jpeg.parse(out)
    got = jpeg.read([image])
    assert (got == slow_read(out)).all() and np.abs(got).sum()
    assert jpeg.rgb(image, got).shape == (40, 40, 3)


def test_samples_are_the_inverse_transform():
    rng = np.random.default_rng(1)
    q = rng.integers(-60, 60, (5, 64))
    got = jpeg.samples(q, np.ones(64, np.int64))
    block = np.zeros((5, 64))
    block[:, jpeg.ZIGZAG] = q
    u = np.arange(8)
    c = np.where(u == 0, np.sqrt(0.5), 1.0)
    one = 0.5 * c[:, None] * np.cos((2 * u[None] + 1) * u[:, None] * np.pi / 16)
    want = np.einsum("nuv,ux,vy->nxy", block.reshape(5, 8, 8), one, one) + 128
    assert np.abs(got.reshape(5, 8, 8) - np.clip(want, 0, 255)).max() <= 0.51


def expected(rows):
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        out.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    return sorted(out, key=str)


def test_a_long_payload_is_a_run_of_files(monkeypatch):
    monkeypatch.setattr(media, "FRAME_BYTES", 6400)
    text = bytes(i * i % 251 for i in range(20_001))
    images = list(media.parse_all(media.store([text])[0]))
    coefficients = jpeg.read(images)
    assert len(images) == 4
    assert b"".join(media.payload_of(i, coefficients) for i in images) == text + bytes(-len(text) % 64)


def feature_of(tensors):
    feature = media.Feature()
    for t in tensors:
        feature.add(t)
    return str(feature)


def test_a_feature_looks_at_all_files():
    dark, light = np.zeros((16, 16, 3), np.uint8), np.full((16, 32, 3), 90, np.uint8)
    assert feature_of([dark]).endswith("00" * 16) and feature_of([light]).endswith("5a" * 16)
    both = feature_of([dark, light])
    assert both.startswith("2x16x16;60000,60000,60000;") and both.endswith("3c" * 16)


def test_memory_does_not_grow_with_a_text(monkeypatch):
    monkeypatch.setattr(media, "FRAME_BYTES", 1 << 15)
    monkeypatch.setattr(media, "SLICE", 1 << 16)
    peaks = []
    for size in (1 << 17, 1 << 20):
        text = np.random.default_rng(0).integers(32, 123, size, np.uint8).tobytes()
        jpeg.read(list(media.parse_all(media.store([text[:1000]])[0])))  # tables are made once
        tracemalloc.start()
        (stored,) = media.store([text])
        back = media.ReadBack(1, size, stored)
        for run in media._decoded([stored]):
            for _, image, coefficients in run:
                back.add(image, coefficients)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert back.row()[:4] == (1, size, size, hashlib.sha256(text).hexdigest())
    assert peaks[1] - peaks[0] < 4 * (1 << 20) < 40 * (1 << 20)  # the stored form, once in pieces and once whole


def test_digests(spark):
    rows = [(0, None), (1, ""), (2, "a" * 64), (3, "é" * 33), (4, "long text, " * 20_000), (4, "long text, " * 20_000), (None, "no id"), (5, "".join(map(chr, range(1, 3000))))]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS).withColumn("media", F.lit("clash"))
    encoded = media.encode(docs)
    got = media.read_back(encoded).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(rows)
    stored = {r.doc_id: bytes(r.media) for r in encoded.collect()}
    for r in got:
        assert r.media_bytes == len(stored[r.doc_id]) and r.media_sha256 == hashlib.sha256(stored[r.doc_id]).hexdigest()
    assert len({r.feature for r in got if r.doc_id in (0, 1)}) == 1 and len({r.feature for r in got}) == 6
    made = media.tensors(encoded).collect()
    assert all(len(t.rgb) == t.height * t.width * 3 for t in made)
    assert media.read_back(media.encode(docs.limit(0))).count() == 0


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((tuple(r)[:5] for r in media.read_back(media.encode(docs)).collect()), key=str)
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])
