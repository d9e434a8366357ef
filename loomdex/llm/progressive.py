"""A progressive JPEG codec in numpy, for many images at a time.

Encoding takes quantised coefficients, so it loses nothing. Decoding accumulates spectral-selection and successive-approximation scans in
coefficient arrays; images' restart segments advance together, a symbol (or, in refinement, a coefficient) a step.

Coefficients are kept by block in zigzag order, images end to end. An image's blocks are its components' one after
another, each component's grid in raster order. Here "segment" means the entropy-coded run between restart markers.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from functools import lru_cache

import numpy as np

from loomdex.llm.files import gather


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Natural place of each zigzag position, walked by diagonals."""
    cells = [(i, d - i) for d in range(15) for i in (range(min(d, 7), max(0, d - 7) - 1, -1) if d % 2 == 0 else range(max(0, d - 7), min(d, 7) + 1))]
    return np.array([r * 8 + c for r, c in cells])


# ---------------------------------------------------------------- tables
#: Code lengths by rule. AC: sizes 1 to 8 without a run take 4 bits, the other 168 symbols 9. DC: 12 sizes at 4 bits.
AC_SYMBOLS = [s for s in range(1, 9)] + [r << 4 | s for r in range(16) for s in range(11) if not (r == 0 and 1 <= s <= 8)]
AC_COUNTS = [0, 0, 0, 8, 0, 0, 0, 0, 168] + [0] * 7
DC_SYMBOLS, DC_COUNTS = list(range(12)), [0, 0, 0, 12] + [0] * 12


def codes(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Canonical (code, length) by symbol."""
    code, at, value, size = 0, 0, np.zeros(256, np.uint64), np.zeros(256, np.uint8)
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            value[s], size[s] = code, length
            code += 1
        at += n
        code <<= 1
    return value, size


@lru_cache(maxsize=64)
def lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for each 16-bit prefix."""
    value, size = codes(list(counts), list(symbols))
    sym, length = np.zeros(1 << 16, np.uint8), np.full(1 << 16, 16, np.uint8)
    for s in symbols:
        n = int(size[s])
        first = int(value[s]) << (16 - n)
        sym[first : first + (1 << (16 - n))], length[first : first + (1 << (16 - n))] = s, n
    return sym, length


def magnitude(v: np.ndarray) -> np.ndarray:
    """Bits of |v|."""
    return np.frexp(np.abs(v).astype(np.float32))[1].astype(np.uint64)


def extra_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """JPEG's additional bits: v itself, or v - 1 below zero, cut to size."""
    return (np.where(v < 0, v - 1, v).astype(np.int64).view(np.uint64)) & ((np.uint64(1) << size) - np.uint64(1))


# ---------------------------------------------------------------- layout
class Layout:
    """Geometry of one image size: sampling factors, block grids, and the block order of each kind of scan."""

    def __init__(self, width: int, height: int, sampling: tuple[tuple[int, int], ...]):
        self.width, self.height, self.sampling = width, height, sampling
        hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
        self.mcus_x, self.mcus_y = -(-width // (8 * hmax)), -(-height // (8 * vmax))
        self.grids = [(self.mcus_y * v, self.mcus_x * h) for h, v in sampling]
        sizes = [r * c for r, c in self.grids]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.blocks = int(self.first[-1])
        self.real = [(-(-(-(-height * v // vmax)) // 8), -(-(-(-width * h // hmax)) // 8)) for h, v in sampling]
        self._orders: dict[tuple, tuple[np.ndarray, np.ndarray, int]] = {}

    def order(self, components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
        """(blocks, their components, blocks to an MCU) of a scan."""
        if components not in self._orders:
            if len(components) == 1:
                c = components[0]
                rows, cols = self.real[c]
                got = (self.first[c] + (np.arange(rows)[:, None] * self.grids[c][1] + np.arange(cols)).ravel(), np.full(rows * cols, c), 1)
            else:
                y, x = np.divmod(np.arange(self.mcus_x * self.mcus_y), self.mcus_x)
                each, which = [], []
                for c in components:
                    h, v = self.sampling[c]
                    for j in range(v):
                        for i in range(h):
                            each.append(self.first[c] + (y * v + j) * self.grids[c][1] + x * h + i)
                            which.append(c)
                got = (np.stack(each, axis=1).ravel(), np.tile(which, len(y)), len(which))
            self._orders[components] = got
        return self._orders[components]


@lru_cache(maxsize=4096)
def layout(width: int, height: int, sampling: tuple[tuple[int, int], ...]) -> Layout:
    return Layout(width, height, sampling)


# ---------------------------------------------------------------- encoding
#: (components, first, last coefficient, high, low bit): spectral bands first at half precision, then the last bit.
SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1),
    ((0,), 1, 5, 0, 1), ((1,), 1, 5, 0, 1), ((2,), 1, 5, 0, 1),
    ((0,), 6, 63, 0, 1), ((1,), 6, 63, 0, 1), ((2,), 6, 63, 0, 1),
    ((0, 1, 2), 0, 0, 1, 0),
    ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0),
)


def put_bits(value: np.ndarray, size: np.ndarray, segment_of: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in order to bytes; each segment is padded with ones to a whole byte. Returns bytes and segment ends."""
    bits = np.bincount(segment_of, weights=size, minlength=segments).astype(np.int64)
    whole = -(-bits // 8)
    start = (np.cumsum(whole) - whole) * 8
    before = np.cumsum(size) - size
    opening = np.cumsum(bits) - bits
    at = (before - opening[segment_of] + start[segment_of]).astype(np.int64)
    pad = (whole * 8 - bits).astype(np.int64)
    total = int(whole.sum())
    words = np.zeros(total // 8 + 2, np.uint64)
    some = size > 0

    def lay(at: np.ndarray, value: np.ndarray, size: np.ndarray) -> None:
        word, over = at >> 6, (at & 63) + size - 64
        high = np.where(over <= 0, value << np.minimum(np.maximum(-over, 0), 63).astype(np.uint64), value >> np.maximum(over, 0).astype(np.uint64))
        new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[new]] |= np.add.reduceat(high, new)
        split = over > 0
        words[word[split] + 1] |= value[split] << (np.int64(64) - over[split]).astype(np.uint64)

    if some.any():
        lay(at[some], value[some], size[some].astype(np.int64))
    short = pad > 0
    if short.any():
        lay((start + bits)[short], (np.uint64(1) << pad[short].astype(np.uint64)) - np.uint64(1), pad[short])
    return words.astype(">u8").view(np.uint8)[:total], np.cumsum(whole)


def paired(value: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring tokens of a row as one, and again, as long as the longest fits a word."""
    while value.shape[1] > 1 and 2 * int(size.max(initial=0)) <= 62:
        if value.shape[1] % 2:
            value, size = np.pad(value, ((0, 0), (0, 1))), np.pad(size, ((0, 0), (0, 1)))
        right = size[:, 1::2]
        value, size = (value[:, ::2] << right.astype(np.uint64)) | value[:, 1::2], size[:, ::2] + right
    return value, size


@lru_cache(maxsize=8)
def dense_tokens(low: int) -> tuple[np.ndarray, np.ndarray]:
    """Value and size of the token of each coefficient from -1024 to 1023 that no zero stands before."""
    code, length = codes(AC_COUNTS, AC_SYMBOLS)
    raw = np.arange(-1024, 1024)
    v = np.where(raw < 0, -((-raw) >> low), raw >> low)
    size = magnitude(v)
    return (code[size] << size) | extra_bits(v, size), length[size].astype(np.int64) + size.astype(np.int64)


def first_tokens(blocks: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """A band's first pass: (blocks, band + 1) values and sizes; a coefficient's token holds its zero runs, the last slot the end of block."""
    code, length = codes(AC_COUNTS, AC_SYMBOLS)
    n, width = blocks.shape
    if not ((np.abs(blocks) >> low) == 0).any():  # no runs and no ends of block
        value, size = dense_tokens(low)
        return paired(value[blocks + 1024], size[blocks + 1024])
    v = np.where(blocks < 0, -((-blocks) >> low), blocks >> low)
    on = v != 0
    place = np.arange(width)
    last = np.maximum.accumulate(np.where(on, place, -1), axis=1)
    run = place - 1 - np.concatenate([np.full((n, 1), -1), last[:, :-1]], axis=1)
    size = magnitude(v)
    symbol = ((run & 15) << 4) | size.astype(np.int64)
    value = (code[symbol] << size) | extra_bits(v, size)
    bits = length[symbol].astype(np.int64) + size.astype(np.int64)
    if run.max(initial=0) > 15:
        for k in range(1, 4):  # 16 zeros each, ahead of the coefficient
            far = on & (run >= 16 * k)
            value = np.where(far, value | (code[0xF0] << bits.astype(np.uint64)), value)
            bits = bits + np.where(far, length[0xF0], 0)
    end = last[:, -1:] < width - 1
    return paired(np.concatenate([np.where(on, value, 0), np.where(end, code[0], 0)], axis=1).astype(np.uint64), np.concatenate([np.where(on, bits, 0), np.where(end, length[0], 0)], axis=1))


def refining_tokens(blocks: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A band's refinement: flat (value, size, block) tokens in order."""
    code, length = codes(AC_COUNTS, AC_SYMBOLS)
    size = np.abs(blocks) >> low
    old, new = size > 1, size == 1
    n, width = blocks.shape
    if old.all():  # end of block, then a bit for each
        flags = np.zeros((n, 64), np.uint8)
        flags[:, 64 - width :] = size & 1
        value = np.stack([np.full(n, code[0]), np.packbits(flags, axis=1).view(">u8")[:, 0].astype(np.uint64)], axis=1)
        return value.ravel(), np.tile(np.array([length[0], width], np.int64), n), np.repeat(np.arange(n), 2)
    bit = (size & 1).astype(np.uint64)
    plain = ~new.any(axis=1)
    # Blocks without new coefficients: end of block, then a bit for each old one.
    values = np.concatenate([np.full((n, 1), code[0]), np.where(old, bit, 0)], axis=1).astype(np.uint64)
    sizes = np.concatenate([np.full((n, 1), length[0]), old], axis=1).astype(np.int64)
    if plain.all():
        return values.ravel(), sizes.ravel(), np.repeat(np.arange(n), width + 1)
    out_v, out_s, out_b, from_ = [], [], [], 0
    for b in np.flatnonzero(~plain).tolist():
        out_v.append(values[from_:b].ravel())
        out_s.append(sizes[from_:b].ravel())
        out_b.append(np.repeat(np.arange(from_, b), width + 1))
        tokens, run, held = [], 0, []
        left = int(new[b].sum())
        for k in range(width):
            if old[b, k]:
                held.append((int(bit[b, k]), 1))
            elif not new[b, k]:
                run += 1
                if run == 16 and left:
                    tokens += [(int(code[0xF0]), int(length[0xF0])), *held]
                    run, held = 0, []
            else:
                tokens += [(int(code[run << 4 | 1]), int(length[run << 4 | 1])), (int(blocks[b, k] > 0), 1), *held]
                run, held, left = 0, [], left - 1
        if run or held:
            tokens += [(int(code[0]), int(length[0])), *held]
        out_v.append(np.array([t[0] for t in tokens], np.uint64))
        out_s.append(np.array([t[1] for t in tokens], np.int64))
        out_b.append(np.full(len(tokens), b))
        from_ = b + 1
    out_v.append(values[from_:].ravel())
    out_s.append(sizes[from_:].ravel())
    out_b.append(np.repeat(np.arange(from_, n), width + 1))
    return np.concatenate(out_v), np.concatenate(out_s), np.concatenate(out_b)


def segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def encode(coefs: np.ndarray, layouts: list[Layout], comments: list[bytes], interval: int = 8) -> list[bytes]:
    """A file for each image. coefs: (all blocks, 64) by image; all images have the same three components."""
    counts = np.array([x.blocks for x in layouts], np.int64)
    base = np.cumsum(counts) - counts
    ends_of: list[list[bytes]] = [[] for _ in layouts]
    dc_code, dc_length = codes(DC_COUNTS, DC_SYMBOLS)
    for components, first, last, high, low in SCRIPT:
        orders = [x.order(components) for x in layouts]
        sizes = np.array([len(o[0]) for o in orders], np.int64)
        block = np.concatenate([o[0] for o in orders]) + np.repeat(base, sizes)
        which = np.concatenate([o[1] for o in orders])
        unit = interval * orders[0][2]
        inside = np.arange(len(block)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        per = -(-sizes // unit)  # segments of each image
        seg = inside // unit + np.repeat(np.cumsum(per) - per, sizes)
        if first == 0:
            dc = coefs[block, 0].astype(np.int64)
            if high == 0:
                dc >>= low
                before = np.zeros(len(dc), np.int64)
                for c in components:
                    own = np.flatnonzero(which == c)
                    same = np.concatenate([[False], seg[own][1:] == seg[own][:-1]])
                    before[own] = np.where(same, np.concatenate([[0], dc[own][:-1]]), 0)
                diff = dc - before
                size = magnitude(diff)
                value, bits, owner = (dc_code[size] << size) | extra_bits(diff, size), dc_length[size].astype(np.int64) + size.astype(np.int64), seg
            else:
                value, bits, owner = (dc >> low & 1).astype(np.uint64), np.ones(len(dc), np.int64), seg
        else:
            band = coefs[block, first : last + 1].astype(np.int64)
            if high == 0:
                value, bits = first_tokens(band, low)
                owner = np.repeat(seg, value.shape[1])
                value, bits = value.ravel(), bits.ravel()
            else:
                value, bits, owner = refining_tokens(band, low)
                owner = seg[owner]
        data, stop = put_bits(value, bits, owner, int(per.sum()))
        # Stuff a zero after each 0xFF; restart markers go between an image's segments.
        stuffed = np.flatnonzero(data == 0xFF)
        again = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        final = again == np.repeat(per, per) - 1
        cut = stop[~final]
        mark = 0xD0 + (again[~final] & 7)
        spots = np.concatenate([stuffed + 1, cut, cut])
        added = np.concatenate([np.zeros(len(stuffed), np.int64), np.full(len(cut), 0xFF), mark])
        rank = np.concatenate([np.zeros(len(stuffed)), np.full(len(cut), 1), np.full(len(cut), 2)])
        sort = np.lexsort((rank, spots))
        raw = np.insert(data, spots[sort], added[sort].astype(np.uint8)).tobytes()
        ends = stop[np.cumsum(per) - 1]
        # Extra bytes up to an image's end: its stuffing and its markers.
        ends = ends + np.searchsorted(stuffed, ends) + 2 * np.searchsorted(cut, ends)
        head = segment(0xDA, bytes([len(components)]) + b"".join(bytes([c + 1, 0]) for c in components) + bytes([first, last, high << 4 | low]))
        at = 0
        for i, e in enumerate(ends.tolist()):
            ends_of[i] += [head, raw[at:e]]
            at = e
    tables = segment(0xDB, bytes([0]) + bytes([1] * 64)) + segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])) + segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])) + segment(0xDD, struct.pack(">H", interval))
    out = []
    for x, note, scans in zip(layouts, comments, ends_of):
        frame = struct.pack(">BHHB", 8, x.height, x.width, len(x.sampling)) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(x.sampling))
        out.append(b"".join([b"\xff\xd8", segment(0xFE, note), tables, segment(0xC2, frame), *scans, b"\xff\xd9"]))
    return out


# ---------------------------------------------------------------- decoding
class Image:
    """A parsed file: its layout, tables, comment and scans."""

    def __init__(self, data: bytes, offset: int, marks: list[int]):
        """marks: places, in the data of all files, of 0xFF bytes that are neither stuffed nor before a restart marker."""
        at, end = offset + 2, offset + len(data)
        dc, ac, quant, self.comment, self.scans, interval, ids, self.layout = {}, {}, {}, b"", [], 0, {}, None
        while at < end:
            kind = data[at - offset + 1]
            if kind == 0xD9:
                break
            (size,) = struct.unpack_from(">H", data, at - offset + 2)
            body = data[at - offset + 4 : at - offset + 2 + size]
            at += 2 + size
            if kind == 0xFE:
                self.comment = body
            elif kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    (ac if body[0] >> 4 else dc)[body[0] & 15] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif kind == 0xDD:
                (interval,) = struct.unpack(">H", body)
            elif kind == 0xC2:
                _, height, width, n = struct.unpack_from(">BHHB", body)
                parts = [body[6 + 3 * c : 9 + 3 * c] for c in range(n)]
                ids = {p[0]: c for c, p in enumerate(parts)}
                self.layout = layout(width, height, tuple((p[1] >> 4, p[1] & 15) for p in parts))
                which = [p[2] for p in parts]
            elif 0xC0 <= kind <= 0xCF and kind != 0xC8:
                raise ValueError("not a progressive file")
            elif kind == 0xDA:
                n = body[0]
                components = tuple(ids[body[1 + 2 * c]] for c in range(n))
                names = [body[2 + 2 * c] for c in range(n)]
                first, last, bits = body[1 + 2 * n : 4 + 2 * n]
                stop = marks[bisect_left(marks, at)]
                tables = tuple((dc.get(t >> 4) if first == 0 else ac.get(t & 15)) for t in names)
                self.scans.append((components, first, last, bits >> 4, bits & 15, interval, tables, at, stop))
                at = stop
        self.quant = [quant[q] for q in which]


class Bits:
    """A chunk's entropy bytes without stuffing, with a 64-bit window at each byte."""

    def __init__(self, data: np.ndarray, stuffed: np.ndarray):
        self.stuffed = stuffed
        clean = np.concatenate([np.delete(data, stuffed), np.zeros(16, np.uint8)])
        n = len(clean) - 8
        self.window = np.zeros(n, np.uint64)
        for i in range(8):
            self.window |= clean[i : n + i].astype(np.uint64) << np.uint64(56 - 8 * i)

    def place(self, at: np.ndarray) -> np.ndarray:
        """Bit position of a byte of the original data."""
        return (at - np.searchsorted(self.stuffed, at)) * 8

    def peek(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from a bit position, at the top of a word."""
        return self.window[at >> 3] << (at & 7).astype(np.uint64)


U = np.uint64


def top(window: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first n bits; n may be 0."""
    return ((window >> U(1)) >> (U(63) - n.astype(np.uint64))).astype(np.int64)


def extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (bits < (np.int64(1) << np.maximum(size - 1, 0))), bits - (np.int64(1) << size) + 1, bits)


def decode(files: list[bytes]) -> tuple[np.ndarray, list[Image]]:
    """Coefficients of all files' blocks (int16, zigzag order) and the parsed images."""
    data = np.frombuffer(b"".join(files), np.uint8)
    sizes = np.array([len(f) for f in files], np.int64)
    offsets = (np.cumsum(sizes) - sizes).tolist()
    ff = np.flatnonzero(data[:-1] == 0xFF)
    after = data[ff + 1]
    restart = ff[(after >= 0xD0) & (after <= 0xD7)]
    marks = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))].tolist()
    images = [Image(f, o, marks) for f, o in zip(files, offsets)]
    base = np.concatenate([[0], np.cumsum([x.layout.blocks for x in images])]).astype(np.int64)
    coefs = np.zeros((int(base[-1]), 64), np.int16)
    bits = Bits(data, ff[after == 0] + 1)
    for turn in range(max((len(x.scans) for x in images), default=0)):
        kinds: dict[tuple, list[int]] = {}
        for i, x in enumerate(images):
            if turn < len(x.scans):
                components, first, last, high, low, interval, tables, *_ = x.scans[turn]
                kinds.setdefault((components, first, last, high, low, interval, tables), []).append(i)
        for (components, first, last, high, low, interval, tables), which in kinds.items():
            orders = [images[i].layout.order(components) for i in which]
            count = np.array([len(o[0]) for o in orders], np.int64)
            block = np.concatenate([o[0] for o in orders]) + np.repeat(base[which], count)
            comp = np.concatenate([o[1] for o in orders])
            unit = interval * orders[0][2] if interval else 1 << 40
            per = -(-count // unit)
            n_of = np.minimum(np.repeat(count, per) - (np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)) * unit, unit)
            start, stop = (np.array([images[i].scans[turn][k] for i in which], np.int64) for k in (7, 8))
            lo = np.searchsorted(restart, start)
            inner = restart[gather(lo, per - 1)] + 2
            at = np.empty(int(per.sum()), np.int64)
            heads = np.cumsum(per) - per
            rest = np.ones(len(at), bool)
            rest[heads] = False
            at[heads], at[rest] = start, inner
            at = bits.place(at)
            opening = np.cumsum(n_of) - n_of
            if first == 0:
                decode_dc(bits, coefs, block, comp, at, opening, n_of, high, low, dict(zip(components, tables)))
            elif high == 0:
                first_pass(bits, coefs, block, at, opening, n_of, first, last, low, tables[0])
            else:
                refine(bits, coefs, block, at, opening, n_of, first, last, low, tables[0])
    return coefs, images


def decode_dc(bits: Bits, coefs: np.ndarray, block: np.ndarray, comp: np.ndarray, at: np.ndarray, opening: np.ndarray, count: np.ndarray, high: int, low: int, tables: dict) -> None:
    before = np.zeros((len(at), max(tables) + 1), np.int64)
    at = at.copy()
    rows = np.arange(len(at))
    for step in range(int(count.max(initial=0))):
        rows = rows[count[rows] > step]
        spot = opening[rows] + step
        b, window = block[spot], bits.peek(at[rows])
        if high:
            coefs[b, 0] |= ((window >> U(63)).astype(np.int16)) << low
            at[rows] += 1
            continue
        size, length = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        head = (window >> U(48)).astype(np.int64)
        for c, table in tables.items():
            own = comp[spot] == c
            sym, ln = lookup(*table)
            size[own], length[own] = sym[head[own]], ln[head[own]]
        value = extended(top(window << length.astype(np.uint64), size), size)
        c = comp[spot]
        before[rows, c] += value
        coefs[b, 0] = before[rows, c] << low
        at[rows] += length + size


def first_pass(bits: Bits, coefs: np.ndarray, block: np.ndarray, at: np.ndarray, opening: np.ndarray, count: np.ndarray, first: int, last: int, low: int, table: tuple) -> None:
    """All segments advance by a symbol a step; those that have ended are dropped now and then."""
    sym, ln = lookup(*table)
    flat = coefs.reshape(-1)
    at, spot, stop = at.copy(), opening.copy(), opening + count
    k = np.full(len(at), first, np.int64)
    while len(at):
        live = spot < stop
        if not live.all():
            if not live.any():
                return
            at, spot, stop, k = at[live], spot[live], stop[live], k[live]
        for _ in range(last - first + 1):  # at least so many symbols before a look at who has ended
            window = bits.peek(at)
            head = (window >> U(48)).astype(np.int64)
            s, length = sym[head].astype(np.int64), ln[head].astype(np.int64)
            run, size = s >> 4, s & 15
            rest = window << length.astype(np.uint64)
            value = size > 0
            if value.all():
                k += run
                flat[block[spot] * 64 + k] = extended(top(rest, size), size) << low
                at += length + size
                k += 1
                step = k > last
                spot += step
                k[step] = first
            else:
                v = np.flatnonzero(value)
                k[v] += run[v]
                flat[block[spot[v]] * 64 + k[v]] = extended(top(rest[v], size[v]), size[v]) << low
                k[v] += 1
                at[v] += length[v] + size[v]
                z = np.flatnonzero(~value & (run == 15))
                k[z] += 16
                at[z] += length[z]
                e = np.flatnonzero(~value & (run < 15))
                blocks = (np.int64(1) << run[e]) + top(rest[e], run[e])
                at[e] += length[e] + run[e]
                spot[e] += blocks
                k[e] = first
                step = k > last
                spot[step] += 1
                k[step] = first
            done = spot >= stop
            if done.any():
                break


def refine(bits: Bits, coefs: np.ndarray, block: np.ndarray, at: np.ndarray, opening: np.ndarray, count: np.ndarray, first: int, last: int, low: int, table: tuple) -> None:
    """Block by block for all segments. Those inside an end-of-block run take one correction bit for each old coefficient at
    once; the others go coefficient by coefficient."""
    sym, ln = lookup(*table)
    at, left = at.copy(), np.zeros(len(at), np.int64)
    rows = np.arange(len(at))
    unit = np.int16(1 << low)

    def read(who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A symbol: (zeros to pass, coefficient to place or 0, whether the block ends); end-of-block runs are noted."""
        window = bits.peek(at[who])
        head = (window >> U(48)).astype(np.int64)
        s, length = sym[head].astype(np.int64), ln[head].astype(np.int64)
        run, size = s >> 4, s & 15
        rest = window << length.astype(np.uint64)
        ends = (size == 0) & (run < 15)
        left[who[ends]] = (np.int64(1) << run[ends]) + top(rest[ends], run[ends])
        positive = (rest >> U(63)) > 0
        place = np.where(size > 0, np.where(positive, unit, -unit), 0)
        at[who] += length + np.where(ends, run, (size > 0).astype(np.int64))
        return run, place, ends

    def correct(b: np.ndarray, who: np.ndarray, start: np.ndarray | int) -> None:
        """Correction bits of all old coefficients from `start` on."""
        band = coefs[b, first : last + 1]
        old = band != 0
        if not np.isscalar(start):
            old &= np.arange(first, last + 1) >= start[:, None]
        nth = np.cumsum(old, axis=1)
        spot = at[who][:, None] + nth - 1
        bit = (bits.window[np.maximum(spot, 0) >> 3] >> (U(63) - (np.maximum(spot, 0) & 7).astype(np.uint64))) & U(1)
        more = old & (bit > 0)
        band += np.where(more, np.where(band < 0, -unit, unit), 0).astype(np.int16)
        coefs[b, first : last + 1] = band
        at[who] += nth[:, -1]

    for step in range(int(count.max(initial=0))):
        rows = rows[count[rows] > step]
        fresh = rows[left[rows] == 0]
        going = np.zeros(0, np.int64)
        if len(fresh):
            run, place, ends = read(fresh)
            going, run, place = fresh[~ends], run[~ends], place[~ends]
        quiet = rows[left[rows] > 0]
        if len(quiet):
            correct(block[opening[quiet] + step], quiet, 0)
            left[quiet] -= 1
        if not len(going):
            continue
        need = np.zeros(len(going), bool)
        b = block[opening[going] + step]
        for k in range(first, last + 1):
            ask = np.flatnonzero(need)
            if len(ask):
                run[ask], place[ask], ends = read(going[ask])
                need[ask] = False
                out = ask[ends]
                if len(out):
                    correct(b[out], going[out], np.full(len(out), k))
                    left[going[out]] -= 1
                    keep = np.ones(len(going), bool)
                    keep[out] = False
                    going, run, place, need, b = going[keep], run[keep], place[keep], need[keep], b[keep]
                    if not len(going):
                        break
            c = coefs[b, k]
            old = np.flatnonzero(c != 0)
            if len(old):
                bit = bits.peek(at[going[old]]) >> U(63)
                c[old] += np.where(bit > 0, np.where(c[old] < 0, -unit, unit), 0).astype(np.int16)
                at[going[old]] += 1
            zero = c == 0
            hit = zero & (run == 0)
            c[hit] = place[hit]
            need |= hit
            run[zero & ~hit] -= 1
            coefs[b, k] = c


# ---------------------------------------------------------------- pixels
@lru_cache(maxsize=1)
def inverse_transform() -> np.ndarray:
    """64 zigzag coefficients to 64 samples, times 2**13, in whole numbers: sums are exact in float64, in any order."""
    n = np.arange(8)
    basis = np.cos((2 * n[:, None] + 1) * n[None, :] * np.pi / 16) * np.where(n == 0, np.sqrt(0.125), 0.5)
    full = np.einsum("yu,xv->uvyx", basis, basis).reshape(64, 64)
    return np.rint(full[zigzag()] * (1 << 13))


def samples(coefs: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(blocks, 8, 8) of 0 to 255."""
    got = (coefs.astype(np.float64) * quant) @ inverse_transform()
    return np.clip(np.floor(got / (1 << 13) + 0.5) + 128, 0, 255).astype(np.uint8).reshape(-1, 8, 8)


def rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """The usual conversion in 16-bit fixed point."""
    y, cb, cr = y.astype(np.int32) << 16, cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    half = 1 << 15
    parts = (y + 91881 * cr + half, y - 22554 * cb - 46802 * cr + half, y + 116130 * cb + half)
    return np.stack([np.clip(p >> 16, 0, 255).astype(np.uint8) for p in parts], axis=-1)


def planes(coefs: np.ndarray, image: Image) -> list[np.ndarray]:
    """Each component at its own resolution, cut to whole MCUs."""
    x = image.layout
    out = []
    for c, (rows, cols) in enumerate(x.grids):
        got = samples(coefs[x.first[c] : x.first[c + 1]], image.quant[c])
        out.append(got.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8))
    return out


def tensor(coefs: np.ndarray, image: Image) -> np.ndarray:
    """(height, width, 3): chroma upsampled to full resolution."""
    x = image.layout
    hmax, vmax = max(h for h, _ in x.sampling), max(v for _, v in x.sampling)
    full = [np.repeat(np.repeat(p, vmax // v, axis=0), hmax // h, axis=1) for p, (h, v) in zip(planes(coefs, image), x.sampling)]
    if len(full) == 1:
        full = [full[0], np.full_like(full[0], 128), np.full_like(full[0], 128)]
    return rgb(*(p[: x.height, : x.width] for p in full))
