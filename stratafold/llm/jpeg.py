"""Progressive JPEG, written and read in numpy, many images at a time.

Bit streams are read in lock step: each step reads one symbol of every entropy-
coded interval of a scan, over all images of the batch, so the cost of a step is
shared. The reader takes baseline-ordered or progressive Huffman streams of 8-bit
precision with any sampling factors, restart intervals, spectral selection and
successive approximation; the writer makes one fixed progression (SCANS).

Scans are accumulated into coefficient arrays, one per component. Samples come
from an inverse transform with a basis in integers, so equal coefficients give
equal samples whatever is computed beside them; chroma is upsampled by
repetition and RGB is stored at full resolution.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np

#: The order in which a block's coefficients are sent.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
SAMPLING = ((2, 2), (1, 1), (1, 1))
#: (components, first, last, high, low) of the writer's scans.
SCANS = (
    ((0, 1, 2), 0, 0, 0, 1),
    *(((c,), 1, 5, 0, 1) for c in range(3)),
    *(((c,), 6, 63, 0, 0) for c in range(3)),
    ((0, 1, 2), 0, 0, 1, 0),
    *(((c,), 1, 5, 1, 0) for c in range(3)),
)
RESTART_BLOCKS = 16


# -- Huffman tables ---------------------------------------------------------


@dataclass
class Table:
    """A Huffman table: code and length by symbol, and (length, symbol) by the next 16 bits."""

    counts: bytes
    symbols: bytes
    code: np.ndarray = field(init=False)
    length: np.ndarray = field(init=False)
    look: np.ndarray = field(init=False)

    def __post_init__(self):
        self.code, self.length = np.zeros(256, np.int64), np.zeros(256, np.int64)
        self.look = np.zeros(1 << 16, np.int32)
        code = at = 0
        for n, count in enumerate(self.counts, 1):
            for _ in range(count):
                s = self.symbols[at]
                self.code[s], self.length[s] = code, n
                self.look[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
                code, at = code + 1, at + 1
            code <<= 1
        self._joint: dict[int, np.ndarray] = {}

    def joint(self, low: int) -> np.ndarray:
        """By the next 16 bits: bits taken (6), zeros before the value (4), steps onward (7, past any band at a block's end), 1 spare, and the value.

        0 where code and value need more than 16 bits, or a block's end covers several blocks.
        """
        if low not in self._joint:
            found = self.look.astype(np.int64)
            length, run, size = found >> 8, (found >> 4) & 15, found & 15
            window = np.arange(1 << 16, dtype=np.int64) << 40
            value = _value(window, length, size) << low
            end = (size == 0) & (run < 15)
            entry = (value << 18) | (np.where(end, 127, run + 1) << 10) | (np.where(end, 0, run) << 6) | (length + size)
            entry[(length == 0) | (length + size > 16) | (end & (run > 0))] = 0
            self._joint[low] = entry
        return self._joint[low]


def _table_from(weights: dict[int, float]) -> Table:
    """Huffman code lengths of weighted symbols, none over 16 bits, and the code of all ones left free."""
    import heapq

    weights = dict(weights)
    while True:
        heap = [(w, i, (s,)) for i, (s, w) in enumerate(sorted({**weights, -1: 0}.items()))]
        heapq.heapify(heap)
        depth = dict.fromkeys([*weights, -1], 0)
        while len(heap) > 1:
            (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in x + y:
                depth[s] += 1
            heapq.heappush(heap, (a + b, i, x + y))
        if max(depth.values()) <= 16:
            break
        least = min(weights.values())
        weights = {s: w + least for s, w in weights.items()}
    order = sorted(weights, key=lambda s: (depth[s], s))
    return Table(bytes(sum(depth[s] == n for s in order) for n in range(1, 17)), bytes(order))


@cache
def writer_tables() -> tuple[Table, Table, Table]:
    """DC, AC and refining tables by rule: weights halve with each size away from 6 and fall four-fold with each zero of a run."""
    dc = _table_from({s: 2.0 ** -abs(s - 4) for s in range(12)})
    ac = _table_from({0: 0.05, 0xF0: 0.001} | {r << 4 | s: 4.0**-r * 2.0 ** -abs(s - 6) for r in range(16) for s in range(1, 11)})
    refine = _table_from({0: 1.0, 0xF0: 0.01} | {r << 4 | 1: 2.0**-r for r in range(16)})
    return dc, ac, refine


# -- Writing ----------------------------------------------------------------


def _pack_bits(value: np.ndarray, length: np.ndarray, stream: np.ndarray, streams: int) -> list[bytes]:
    """Bit strings by stream (codes in order of stream), each filled up with ones and with 0 after every byte of ones."""
    length = length.astype(np.int64)
    total = np.bincount(stream, length, streams).astype(np.int64)
    size = (total + 7) // 8
    first_byte = np.concatenate(([0], np.cumsum(size)))
    before = np.cumsum(length) - length
    first_bit = np.cumsum(total) - total
    at = first_byte[stream] * 8 + before - first_bit[stream]
    out = np.zeros(int(first_byte[-1]) // 4 + 4, np.uint64)

    def put(value: np.ndarray, length: np.ndarray, at: np.ndarray) -> None:
        """Add bit strings at ascending places; no two share a bit."""
        if not len(value):
            return
        word = at >> 5
        shifted = value.astype(np.uint64) << (64 - (at & 31) - length).astype(np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[starts]] += np.add.reduceat(shifted >> np.uint64(32), starts)
        out[word[starts] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), starts)

    put(value, length, at)
    pad = (-total) % 8
    some = np.flatnonzero(pad)
    put((1 << pad[some]) - 1, pad[some], first_byte[:-1][some] * 8 + total[some])
    data = out.astype(">u4").view(np.uint8)[: first_byte[-1]]
    ones = np.flatnonzero(data == 255)
    stuffed = np.insert(data, ones + 1, 0).tobytes()
    ends = first_byte + np.searchsorted(ones, first_byte)
    return [stuffed[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _size_of(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def _shift_to_zero(v: np.ndarray, low: int) -> np.ndarray:
    return np.where(v < 0, -((-v) >> low), v >> low)


def _scan_codes(blocks: np.ndarray, component: np.ndarray, interval: np.ndarray, scan: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, length, interval) of each code of a scan over blocks (n x 64, in zigzag order)."""
    _, first, last, high, low = scan
    dc, ac, refine = writer_tables()
    if first == 0:
        v = blocks[:, 0] >> low
        if high:
            return (v & 1).astype(np.int64), np.ones(len(v), np.int64), interval
        diff = v.copy()
        for c in range(3):  # differences inside an interval, component by component
            own = np.flatnonzero(component == c)
            d = np.diff(v[own], prepend=0)
            d[np.concatenate(([True], interval[own][1:] != interval[own][:-1]))[: len(own)]] = 0
            fresh = np.concatenate(([True], interval[own][1:] != interval[own][:-1]))[: len(own)]
            d[fresh] = v[own][fresh]
            diff[own] = d
        size = _size_of(diff)
        return dc.code[size] << size | _extra(diff, size), dc.length[size] + size, interval
    band = blocks[:, first : last + 1]
    if not high:
        v = _shift_to_zero(band, low)
        row, col = np.nonzero(v)
        value = v[row, col]
        before = np.concatenate(([-1], col[:-1])) if len(col) else col
        before = np.where(np.concatenate(([True], row[1:] != row[:-1]))[: len(row)], -1, before)
        run = col - before - 1
        size = _size_of(value)
        symbol = (run & 15) << 4 | size
        code, length = ac.code[symbol] << size | _extra(value, size), ac.length[symbol] + size
        keys, codes, lengths = [row * 1024 + col * 8 + 7], [code], [length]
        for k in range(int(run.max(initial=0)) // 16):  # runs of sixteen zeros before a value
            long = np.flatnonzero(run >> 4 > k)
            keys.append(row[long] * 1024 + col[long] * 8 + k)
            codes.append(np.full(len(long), ac.code[0xF0]))
            lengths.append(np.full(len(long), ac.length[0xF0]))
        open_end = np.flatnonzero(v[:, -1] == 0)
        keys.append(open_end * 1024 + 1023)
        codes.append(np.full(len(open_end), ac.code[0]))
        lengths.append(np.full(len(open_end), ac.length[0]))
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        key = key[order]
        return np.concatenate(codes)[order], np.concatenate(lengths)[order], interval[key >> 10]
    # Refining: one bit for each coefficient known before; new ones are +-1 with the zeros before them counted. Bands here are at most 15 wide, so no run of sixteen occurs.
    assert last - first < 15
    shifted = np.abs(band) >> low
    known, new = shifted > 1, shifted == 1
    n, width = band.shape
    still = np.zeros(n, np.int64)  # known coefficients' bits since the last symbol, which follow the next symbol
    still_n, run = np.zeros(n, np.int64), np.zeros(n, np.int64)
    last_new = np.where(new.any(axis=1), width - 1 - new[:, ::-1].argmax(axis=1), -1)
    keys, codes, lengths = [], [], []
    rows = np.arange(n)

    def send(which: np.ndarray, symbol: np.ndarray, sign: np.ndarray | None, at: int) -> None:
        c, m = refine.code[symbol], refine.length[symbol]
        if sign is not None:
            c, m = c << 1 | sign, m + 1
        keys.append(which * 1024 + at)
        codes.append(c << still_n[which] | still[which])
        lengths.append(m + still_n[which])
        still[which] = still_n[which] = run[which] = 0

    for k in range(width):
        old = known[:, k]
        still[old] = still[old] << 1 | (shifted[old, k] & 1)
        still_n[old] += 1
        zero = ~old & ~new[:, k] & (k <= last_new)
        run[zero] += 1
        fresh = np.flatnonzero(new[:, k])
        send(fresh, run[fresh] << 4 | 1, (band[fresh, k] > 0).astype(np.int64), k)
    rest = rows[last_new < width - 1]
    send(rest, np.zeros(len(rest), np.int64), None, 1023)
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    return np.concatenate(codes)[order], np.concatenate(lengths)[order], interval[key[order] >> 10]


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, mark, len(body) + 2) + body


def grid(units: int) -> tuple[int, int]:
    """Columns and rows of units of a nearly square image that holds `units`."""
    wide = min(4095, max(1, int(np.ceil(np.sqrt(units)))))
    return wide, -(-units // wide)


def write(coefficients: list[list[np.ndarray]], shape: list[tuple[int, int]], comments: list[bytes]) -> list[bytes]:
    """Progressive files of images of whole 4:2:0 units; coefficients[image][component] is (blocks high, blocks wide, 64) in zigzag order, quantised by 1."""
    dc, ac, refine = writer_tables()
    heads, scans = [], [[] for _ in coefficients]
    for (wide, high), comment in zip(shape, comments):
        frame = struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + b"".join(bytes((i + 1, h << 4 | v, 0)) for i, (h, v) in enumerate(SAMPLING))
        heads.append(
            b"\xff\xd8" + _segment(0xFE, comment) + _segment(0xDB, bytes([0]) + bytes([1]) * 64) + _segment(0xC2, frame)
            + b"".join(_segment(0xC4, bytes([kind]) + t.counts + t.symbols) for kind, t in ((0x00, dc), (0x10, ac), (0x11, refine)))
        )
    for scan in SCANS:
        comps, first, last, high, low = scan
        blocks, component, per_unit, units = [], [], 6 if len(comps) > 1 else 1, []
        for planes, (w, h) in zip(coefficients, shape):
            if len(comps) > 1:
                y = planes[0].reshape(h, 2, w, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
                each = np.concatenate([y, planes[1].reshape(-1, 1, 64), planes[2].reshape(-1, 1, 64)], axis=1).reshape(-1, 64)
            else:
                each = planes[comps[0]].reshape(-1, 64)
            blocks.append(each)
            units.append(len(each) // per_unit)
        every = RESTART_BLOCKS if per_unit == 1 else max(1, RESTART_BLOCKS // per_unit)
        intervals = [-(-u // every) for u in units]
        begin = np.concatenate(([0], np.cumsum(intervals)))
        interval = np.concatenate([begin[i] + np.arange(u * per_unit) // (every * per_unit) for i, u in enumerate(units)])
        component = np.concatenate([np.tile([0, 0, 0, 0, 1, 2], u) if per_unit > 1 else np.full(u, comps[0]) for u in units])
        strings = _pack_bits(*_scan_codes(np.concatenate(blocks).astype(np.int64), component, interval, scan), int(begin[-1]))
        table = 0x01 if high and first else 0x00
        sos = _segment(0xDD, struct.pack(">H", every)) + _segment(0xDA, bytes([len(comps)]) + b"".join(bytes((c + 1, table)) for c in comps) + bytes((first, last, high << 4 | low)))
        for i in range(len(units)):
            own = strings[begin[i] : begin[i + 1]]
            scans[i].append(sos + own[0] + b"".join(bytes((255, 0xD0 + (k % 8))) + s for k, s in enumerate(own[1:])))
    return [head + b"".join(parts) + b"\xff\xd9" for head, parts in zip(heads, scans)]


# -- Reading ----------------------------------------------------------------


@dataclass
class Component:
    number: int
    across: int
    down: int
    quant: int
    blocks: tuple[int, int] = (0, 0)  # (high, wide), of whole units
    own: tuple[int, int] = (0, 0)  # (high, wide), of the component alone
    base: int = 0  # place of its first block in the batch's array


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)
    scans: list[tuple] = field(default_factory=list)
    end: int = 0


def parse(data: bytes, start: int = 0) -> Image:
    """Headers and scans of the file that begins at `start`; a scan is (components, tables, first, last, high, low, every, intervals' bytes)."""
    image, tables, every, at = Image(), {}, 0, start + 2
    if data[start:at] != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    while at < len(data):
        mark = data[at + 1]
        if mark == 0xD9:
            image.end = at + 2
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xFE:
            image.comments.append(body)
        elif mark == 0xDB:
            i = 0
            while i < len(body):
                n = 128 if body[i] >> 4 else 64
                image.quants[body[i] & 15] = np.frombuffer(body[i + 1 : i + 1 + n], ">u2" if n == 128 else np.uint8).astype(np.int64)
                i += n + 1
        elif mark in (0xC0, 0xC1, 0xC2):
            if body[0] != 8:
                raise ValueError("only 8-bit samples are read")
            image.height, image.width, n = struct.unpack_from(">HHB", body, 1)
            image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            most = [max(getattr(c, k) for c in image.components) for k in ("across", "down")]
            units = -(-image.width // (8 * most[0])), -(-image.height // (8 * most[1]))
            for c in image.components:
                c.blocks = units[1] * c.down, units[0] * c.across
                c.own = -(-(-(-image.height * c.down // most[1])) // 8), -(-(-(-image.width * c.across // most[0])) // 8)
        elif mark in (0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError(f"coding process {mark:#x} is not read")
        elif mark == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                tables[body[i]] = _known_table(bytes(body[i + 1 : i + 17]), bytes(body[i + 17 : i + 17 + n]))
                i += 17 + n
        elif mark == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            n = body[0]
            picks = [next(i for i, c in enumerate(image.components) if c.number == body[1 + 2 * k]) for k in range(n)]
            used = [body[2 + 2 * k] for k in range(n)]
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            end, parts, begin = at, [], at
            while True:
                end = data.index(b"\xff", end)
                if data[end + 1] == 0:
                    end += 2
                elif 0xD0 <= data[end + 1] <= 0xD7:
                    parts.append(data[begin:end])
                    end += 2
                    begin = end
                else:
                    break
            parts.append(data[begin:end])
            at = end
            image.scans.append((picks, [(tables.get(u >> 4), tables.get(0x10 | u & 15)) for u in used], first, last, approx >> 4, approx & 15, every, parts))
    return image


@cache
def _known_table(counts: bytes, symbols: bytes) -> Table:
    return Table(counts, symbols)


class _Bits:
    """The intervals of a scan, one bit pointer each."""

    def __init__(self, parts: list[bytes]):
        joined = b"".join(p.replace(b"\xff\x00", b"\xff") + bytes(8) for p in parts)
        lengths = np.array([len(p) - p.count(b"\xff\x00") + 8 for p in parts], np.int64)
        raw = np.frombuffer(joined + bytes(8), np.uint8).astype(np.int64)
        self.window = np.zeros(len(raw) - 7, np.int64)  # the 56 bits from each byte on
        for k in range(7):
            self.window |= raw[k : k + len(self.window)] << (48 - 8 * k)
        self.at = (np.cumsum(lengths) - lengths) * 8

    def peek(self, which: np.ndarray) -> np.ndarray:
        """The next 48 bits, as the high bits of 56."""
        at = self.at[which]
        return (self.window[at >> 3] << (at & 7)) & ((1 << 56) - 1)


@lru_cache(maxsize=128)
def _alone(own: tuple[int, int], wide: int) -> np.ndarray:
    """Places of a component's own blocks, row by row, if it is sent alone."""
    return (np.arange(own[0])[:, None] * wide + np.arange(own[1])[None, :]).ravel()


@lru_cache(maxsize=128)
def _together(units: tuple[int, int], sides: tuple[tuple[int, int], ...], bases: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """(place of each block, index of its component, blocks of a unit) if components of `sides` blocks down and across a unit are sent together."""
    places, which = [], []
    for k, ((down, across), base) in enumerate(zip(sides, bases)):
        number = np.arange(units[0] * down * units[1] * across).reshape(units[0], down, units[1], across).transpose(0, 2, 1, 3).reshape(units[0] * units[1], -1)
        places.append(base + number)
        which.append(np.full(number.shape, k))
    place = np.concatenate(places, axis=1)
    return place.ravel(), np.concatenate(which, axis=1).ravel(), place.shape[1]


def _layout(image: Image, scan: tuple) -> tuple[np.ndarray, np.ndarray, int]:
    """(place of each block in sending order, index of its component in the scan, blocks between restarts). Images of one shape share what doesn't hang on where their blocks begin."""
    picks, every = scan[0], scan[6]
    some = [image.components[p] for p in picks]
    base = some[0].base
    if len(picks) == 1:
        place = base + _alone(some[0].own, some[0].blocks[1])
        return place, np.zeros(len(place), np.int64), every or len(place)
    units = some[0].blocks[0] // some[0].down, some[0].blocks[1] // some[0].across
    place, which, size = _together(units, tuple((c.down, c.across) for c in some), tuple(c.base - base for c in some))
    return base + place, which, (every or units[0] * units[1]) * size


def _read_scan(group: list[tuple[Image, tuple]], out: np.ndarray) -> None:
    """Add one scan of several images of equal parameters and tables to the coefficients `out`."""
    _, tables, first, last, high, low, _, _ = group[0][1]
    places, which, parts, counts = [], [], [], []
    for image, scan in group:
        place, component, every = _layout(image, scan)
        places.append(place)
        which.append(component)
        n = -(-len(place) // every)
        counts += [min(every, len(place) - every * i) for i in range(n)]
        parts += scan[7][:n]
    place, component, counts = np.concatenate(places), np.concatenate(which), np.array(counts, np.int64)
    begin = np.cumsum(counts) - counts
    bits, lanes = _Bits(parts), np.arange(len(counts))
    if first == 0:
        done = np.zeros((len(counts), len(tables)), np.int64)
        for step in range(int(counts.max(initial=0))):
            live = lanes[counts > step]
            at = begin[live] + step
            top = bits.peek(live)
            if high:
                out[place[at], 0] |= ((top >> 55) & 1) << low
                bits.at[live] += 1
                continue
            c = component[at]
            found = tables[0][0].look[top >> 40] if len(tables) == 1 or all(t[0] is tables[0][0] for t in tables) else np.choose(c, [t[0].look[top >> 40] for t in tables])
            length, size = found >> 8, found & 15
            done[live, c] += _value(top, length, size)
            out[place[at], 0] = done[live, c] << low
            bits.at[live] += length + size
        if last == 0:
            return
    table = tables[0][1]
    flat = out.reshape(-1)
    block, k = np.zeros(len(counts), np.int64), np.full(len(counts), max(first, 1))
    skip = np.zeros(len(counts), np.int64)  # blocks that a band's end still covers
    if not high:
        joint = table.joint(low)
        lane = lanes[counts > 0]
        at, block, k = bits.at[lane], np.zeros(len(lane), np.int64), np.full(len(lane), max(first, 1))
        base = place[begin[lane]] * 64
        while len(lane):
            entry = joint[(bits.window[at >> 3] >> (40 - (at & 7))) & 0xFFFF]
            if not entry.all():
                entry = entry.copy()
                _long_entries(bits, table, at, entry, block, low)
            at += entry & 63
            flat[base + k + ((entry >> 6) & 15)] = entry >> 18
            k += (entry >> 10) & 127
            over = np.flatnonzero(k > last)
            if len(over):
                block[over] += 1
                k[over] = max(first, 1)
                more = block < counts[lane]
                if not more.all():
                    lane, at, block, k, base = lane[more], at[more], block[more], k[more], base[more]
                    over = np.flatnonzero(k == max(first, 1))
                base[over] = place[begin[lane[over]] + block[over]] * 64
        return
    # Refining: a lane goes from coefficient to coefficient; `run` zeros are passed before the coming value is set, and known coefficients take a bit each.
    run, coming, passing = np.full(len(counts), -1), np.zeros(len(counts), np.int64), np.zeros(len(counts), bool)
    live = lanes[counts > 0]
    bit = 1 << low
    while len(live):
        ask = live[(run[live] < 0) & (skip[live] == 0)]
        if len(ask):
            top = bits.peek(ask)
            found = table.look[top >> 40].astype(np.int64)
            length, r, size = found >> 8, (found >> 4) & 15, found & 15
            sign = (top >> (55 - length)) & 1
            coming[ask] = np.where(size > 0, np.where(sign == 1, bit, -bit), 0)
            ends = (size == 0) & (r < 15)
            extra = (top >> (56 - length - r)) & ((1 << r) - 1)
            skip[ask] = np.where(ends, (1 << r) + extra, 0)
            run[ask] = np.where(ends, -1, r)
            bits.at[ask] += length + np.where(size > 0, 1, np.where(ends, r, 0))
        cell = place[begin[live] + block[live]] * 64 + k[live]
        now = flat[cell]
        known = now != 0
        if known.any():
            some = np.flatnonzero(known)
            lane = live[some]
            one = (bits.peek(lane) >> 55) & 1
            bits.at[lane] += 1
            flat[cell[some]] += np.where(one == 1, np.sign(now[some]) * bit, 0)
        zero = np.flatnonzero(~known)
        lane = live[zero]
        landing = (run[lane] == 0) & (skip[lane] == 0)
        flat[cell[zero[landing]]] = coming[lane[landing]]
        run[lane] -= skip[lane] == 0
        k[live] += 1
        over = live[k[live] > last]
        if len(over):
            k[over] = first
            block[over] += 1
            skip[over] = np.maximum(skip[over] - 1, 0)
            run[over] = -1
            live = live[block[live] < counts[live]]


def _long_entries(bits: _Bits, table: Table, at: np.ndarray, entry: np.ndarray, block: np.ndarray, low: int) -> None:
    """Fill in the entries that `Table.joint` leaves 0; ends of several blocks move `block` on to the last of them."""
    which = np.flatnonzero(entry == 0)
    top = (bits.window[at[which] >> 3] << (at[which] & 7)) & ((1 << 56) - 1)
    found = table.look[top >> 40].astype(np.int64)
    length, run, size = found >> 8, (found >> 4) & 15, found & 15
    if (length == 0).any():
        raise ValueError("a code that the scan's table does not hold")
    end = (size == 0) & (run < 15)
    bits_more = np.where(end, run, size)
    raw = (top >> (56 - length - bits_more)) & ((1 << bits_more) - 1)
    block[which] += np.where(end, (1 << np.where(end, run, 0)) + raw - 1, 0)
    value = _value(top, length, size) << low
    entry[which] = (value << 18) | (np.where(end, 127, run + 1) << 10) | (np.where(end, 0, run) << 6) | (length + bits_more)


def _value(top: np.ndarray, length: np.ndarray, size: np.ndarray) -> np.ndarray:
    raw = (top >> (56 - length.astype(np.int64) - size)) & ((1 << size.astype(np.int64)) - 1)
    return np.where(raw < (1 << np.maximum(size.astype(np.int64) - 1, 0)), raw - (1 << size.astype(np.int64)) + 1, raw) * (size > 0)


def read(images: list[Image]) -> np.ndarray:
    """The quantised coefficients of all blocks of parsed images, in zigzag order; a component's blocks begin at its `base`."""
    total = 0
    for image in images:
        for c in image.components:
            c.base = total
            total += c.blocks[0] * c.blocks[1]
    out = np.zeros((total, 64), np.int64)
    for number in range(max((len(i.scans) for i in images), default=0)):
        groups: dict[tuple, list] = {}
        for image in images:
            if number < len(image.scans):
                s = image.scans[number]
                groups.setdefault((len(s[0]), *((id(a), id(b)) for a, b in s[1]), *s[2:6]), []).append((image, s))
        for group in groups.values():
            _read_scan(group, out)
    return out


# -- Samples ----------------------------------------------------------------


@cache
def _basis() -> np.ndarray:
    """(zigzag coefficient, sample) of the inverse transform, times 2**20 and rounded."""
    u = np.arange(8)
    scale = np.where(u == 0, np.sqrt(1 / 8), 0.5)
    one = scale[:, None] * np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16)
    return np.rint(np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG] * 2**20)


def samples(blocks: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8-bit samples of blocks of quantised coefficients. Sums of integers below 2**53 are exact, in any order."""
    sums = (blocks * quant).astype(np.float64) @ _basis()
    sums *= 2.0**-20
    sums += 128.5
    np.floor(sums, out=sums)
    return np.clip(sums, 0, 255, out=sums).astype(np.uint8)


def rgb(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """The image's full-resolution (height, width, 3) tensor; one component is grey."""
    planes = []
    down, across = max(c.down for c in image.components), max(c.across for c in image.components)
    for c in image.components:
        n = c.blocks[0] * c.blocks[1]
        s = samples(coefficients[c.base : c.base + n], image.quants[c.quant])
        plane = s.reshape(*c.blocks, 8, 8).swapaxes(1, 2).reshape(c.blocks[0] * 8, c.blocks[1] * 8)
        planes.append(plane.repeat(down // c.down, axis=0).repeat(across // c.across, axis=1)[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, cb, cr = planes[0].astype(np.int32) << 16, planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    half = 1 << 15
    out = np.empty((image.height, image.width, 3), np.uint8)
    for i, v in enumerate((y + round(1.402 * 65536) * cr, y - round(0.344136 * 65536) * cb - round(0.714136 * 65536) * cr, y + round(1.772 * 65536) * cb)):
        out[:, :, i] = np.clip((v + half) >> 16, 0, 255)
    return out
