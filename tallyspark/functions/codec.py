"""Baseline JPEG in NumPy: coefficients from bytes and back, pixels from coefficients and back, resampling and a structural score.

Only sequential Huffman files of 8 bits are read (progressive ones raise ``Unreadable``); files that are
written have Huffman tables made for their own symbols.  Parsers raise ``Unreadable`` on whatever is broken.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np

from ..operators.blocks import LUMA, half_res, zigzag
from .jpeg import segment

# The standard chroma quantisation table (ITU-T T.81, Annex K), row by row.
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    *[99] * 32,
]
MAX_SIDE = 65_535
ORDER = np.array(zigzag())
#: Bytes of a scan that are looked up at once, bytes behind them that a block which starts in them can reach, and codes that are packed at once.
WINDOW, BLOCK_BYTES, PACKED = 1 << 16, 280, 1 << 18


class Unreadable(ValueError):
    """Bytes that are no JPEG this codec can read."""


@dataclass
class Component:
    """One plane: sampling factors, quantisation slot and blocks (rows x columns x 64, natural order)."""

    number: int
    h: int
    v: int
    slot: int
    blocks: np.ndarray


@dataclass
class Image:
    """What a file holds before the transform: planes of quantised coefficients and their tables (natural order)."""

    width: int
    height: int
    components: list[Component]
    tables: dict[int, np.ndarray] = field(default_factory=dict)


# bits


def _lengths(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (code, bits) of a canonical table."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out[symbol] = (code, bits)
            code += 1
        at += n
        code <<= 1
    return out


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """bits << 8 | symbol for every 16 bits that may come next, 0 where no code fits."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, (code, bits) in _lengths(counts, symbols).items():
        first = code << (16 - bits)
        table[first : first + (1 << (16 - bits))] = bits << 8 | symbol
    return table


def _upcoming(data: np.ndarray) -> np.ndarray:
    """The 16 bits that begin at every bit of the bytes but the last two."""
    word = data[:-2].astype(np.intp) << 16 | data[1:-1].astype(np.intp) << 8 | data[2:]
    return (word[:, None] >> np.arange(8, 0, -1) & 0xFFFF).ravel()


@lru_cache(maxsize=1)
def _goes_on() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By what an entry of ``_lookup`` goes on: bits of a first coefficient (0 where none can be), bits and places of a further one.

    What ends a block goes on by more places than there are.
    """
    found = np.arange(17 << 8)
    length, symbol = found >> 8, found & 255
    size, run = symbol & 15, symbol >> 4
    places = np.where((found > 0) & (size > 0), run + 1, np.where((found > 0) & (run == 15), 16, 64))
    return tuple(x.astype(np.uint8) for x in (np.where((found > 0) & (symbol <= 11), length + symbol, 0), np.maximum(length + size, 1), places))


class _Others:
    """What every bit of a window says as the start of a code of a further coefficient."""

    def __init__(self, table: np.ndarray, upcoming: np.ndarray):
        self.found = table[upcoming]
        _, bits, ahead = _goes_on()
        self.bits, self.ahead = bits[self.found].tobytes(), ahead[self.found].tobytes()


def _values(upcoming: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed numbers of ``size`` bits from those bits on."""
    raw = upcoming[at] >> (16 - size)
    return np.where(raw >> np.maximum(size - 1, 0) > 0, raw, raw - (1 << size) + 1) * (size > 0)


def _stretch(data: bytes, coders: list[tuple[np.ndarray, np.ndarray]], out: np.ndarray) -> None:
    """Reads an entropy-coded stretch without stuffed zeros into ``out`` (blocks x 64, natural order, zeros); first coefficients as changes.

    ``coders`` has the tables of the blocks of a unit.  Which code comes where is looked up for all bits
    of a window at once; what is left to a loop is to go from code to code.
    """
    end, at, done, first_bits = 8 * len(data), 0, 0, _goes_on()[0].tobytes()
    padded = np.frombuffer(data + bytes(BLOCK_BYTES), np.uint8)
    while done < len(out):
        start = at >> 3
        upcoming = _upcoming(padded[start : start + WINDOW + BLOCK_BYTES])
        at, limit = at & 7, min(8 * WINDOW, end - 8 * start)
        other = {key: _Others(ac, upcoming) for key, ac in {id(ac): ac for _, ac in coders}.items()}
        ways = [(dc, other[id(ac)].bits, other[id(ac)].ahead) for dc, ac in coders]
        begun, codes, until = [], [], []
        go = codes.append
        block = done
        while block < len(out) and at < limit:
            dc, bits, ahead = ways[block % len(ways)]
            begun.append(at)
            found = dc[upcoming[at]]
            if not (step := first_bits[found]):
                raise Unreadable("coefficient out of range" if found else "broken code")
            at += step
            k = 1
            while k < 64:
                go(at)
                k += ahead[at]
                at += bits[at]
            until.append(len(codes))
            block += 1
        if block == done:
            raise Unreadable("broken code")
        _fill(upcoming, coders, other, np.array(begun), np.array(codes), np.array(until), done, out)
        done, at = block, at + 8 * start
    if at > end:
        raise Unreadable("scan ends early")


def _fill(upcoming: np.ndarray, coders: list, other: dict, begun: np.ndarray, codes: np.ndarray, until: np.ndarray, done: int, out: np.ndarray) -> None:
    """Puts the coefficients whose codes start at ``begun`` and, up to ``until`` for each block, at ``codes`` into ``out`` from block ``done`` on."""
    numbers = np.arange(done, done + len(begun))
    of_code = np.repeat(numbers, np.diff(until, prepend=0))
    found, found_first = np.empty(len(codes), np.int32), np.empty(len(begun), np.int32)
    for i, (dc, ac) in enumerate(coders):
        mine, mine_first = of_code % len(coders) == i, numbers % len(coders) == i
        found[mine], found_first[mine_first] = other[id(ac)].found[codes[mine]], dc[upcoming[begun[mine_first]]]
    if not found.all():
        raise Unreadable("broken code")
    size = found & 15
    total = np.cumsum(_goes_on()[2][found], dtype=np.int64)
    place = total - np.concatenate([[0], total])[np.concatenate([[0], until[:-1]])][of_code - done]
    there = size > 0
    if (place[there] > 63).any():
        raise Unreadable("too many coefficients")
    out[of_code[there], ORDER[place[there]]] = _values(upcoming, (codes + (found >> 8))[there], size[there])
    out[numbers, 0] = _values(upcoming, begun + (found_first >> 8), found_first & 255)


# files


def read(data: bytes) -> Image:
    """Coefficients and tables of a baseline file."""
    if data[:2] != b"\xff\xd8":
        raise Unreadable("no start")
    at, tables, huffman, frame, every = 2, {}, {}, None, 0
    while True:
        while at < len(data) and data[at] == 0xFF and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise Unreadable("no marker")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise Unreadable("segment overruns file")
        at += 2 + size
        try:
            if marker == 0xDB:
                _read_steps(body, tables)
            elif marker == 0xC4:
                _read_codes(body, huffman)
            elif marker in (0xC0, 0xC1):
                frame = _read_frame(body)
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise Unreadable("not a baseline file")
            elif marker == 0xDD:
                every = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                if frame is None:
                    raise Unreadable("scan without frame")
                image = replace(frame, tables=tables)
                if any(c.slot not in tables for c in image.components):
                    raise Unreadable("no quantisation table")
                _read_scan(body, data, at, image, huffman, every)
                return image
        except (IndexError, struct.error, KeyError) as broken:
            raise Unreadable(f"broken segment {marker:#x}") from broken


def _read_steps(body: bytes, tables: dict[int, np.ndarray]) -> None:
    at = 0
    while at < len(body):
        wide, slot = body[at] >> 4, body[at] & 15
        values = np.frombuffer(body, ">u2" if wide else "u1", 64, at + 1) if at + 65 + 64 * wide <= len(body) and wide < 2 else None
        if values is None:
            raise Unreadable("short table")
        table = np.zeros(64, np.int32)
        table[ORDER] = values
        tables[slot] = table
        at += 65 + 64 * wide


def _read_codes(body: bytes, huffman: dict[int, np.ndarray]) -> None:
    at = 0
    while at < len(body):
        counts = body[at + 1 : at + 17]
        n = sum(counts)
        if len(counts) < 16 or at + 17 + n > len(body):
            raise Unreadable("short table")
        huffman[body[at]] = _lookup(counts, body[at + 17 : at + 17 + n])
        at += 17 + n


def _read_frame(body: bytes) -> Image:
    bits, height, width, n = struct.unpack_from(">BHHB", body)
    if bits != 8 or n not in (1, 3) or not width or not height or len(body) < 6 + 3 * n:
        raise Unreadable("unsupported frame")
    given = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    if n == 1:
        given = [(given[0][0], 1, 1, given[0][3])]
    top_h, top_v = max(h for _, h, _, _ in given), max(v for _, _, v, _ in given)
    if not all(1 <= h <= 4 and 1 <= v <= 4 and top_h % h == 0 and top_v % v == 0 for _, h, v, _ in given):
        raise Unreadable("unsupported sampling")
    wide, high = -(-width // (8 * top_h)), -(-height // (8 * top_v))
    if wide * high * sum(h * v for _, h, v, _ in given) > 4_000_000:
        raise Unreadable("too large for this codec")
    return Image(width, height, [Component(number, h, v, slot, np.zeros((high * v, wide * h, 64), np.int16)) for number, h, v, slot in given])


def _read_scan(body: bytes, data: bytes, at: int, image: Image, huffman: dict[int, np.ndarray], every: int) -> None:
    chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    if set(chosen) != {c.number for c in image.components}:
        raise Unreadable("planes in several scans")
    coders = [(huffman[chosen[c.number] >> 4], huffman[16 | chosen[c.number] & 15]) for c in image.components for _ in range(c.h * c.v)]
    first = image.components[0]
    columns, rows = first.blocks.shape[1] // first.h, first.blocks.shape[0] // first.v
    units, unit = rows * columns, 0
    stream = np.zeros((units, len(coders), 64), np.int16)
    while unit < units:
        end = at
        while True:
            end = data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(data):
                end = len(data)
                break
            if data[end + 1] == 0:
                end += 2
                continue
            break
        last = min(units, unit + every) if every else units
        part = stream[unit:last]
        _stretch(data[at:end].replace(b"\xff\0", b"\xff"), coders, part.reshape(-1, 64))
        begin = 0
        for c in image.components:
            changes = part[:, begin : begin + c.h * c.v, 0]
            values = np.cumsum(changes, dtype=np.int64).reshape(changes.shape)
            if np.abs(values).max() > 32_767:
                raise Unreadable("coefficient out of range")
            part[:, begin : begin + c.h * c.v, 0] = values
            begin += c.h * c.v
        unit = last
        at = end + 2
        if unit < units and not (end + 1 < len(data) and 0xD0 <= data[end + 1] <= 0xD7):
            raise Unreadable("no restart marker")
    begin = 0
    for c in image.components:
        placed = stream[:, begin : begin + c.h * c.v].reshape(rows, columns, c.v, c.h, 64)
        c.blocks = placed.transpose(0, 2, 1, 3, 4).reshape(rows * c.v, columns * c.h, 64)
        begin += c.h * c.v


def _codes(counts: Counter) -> tuple[bytes, bytes]:
    """(numbers of codes by length, symbols) of an optimal code of at most 16 bits that leaves out all ones."""
    heap = [(n, i, [symbol]) for i, (symbol, n) in enumerate(sorted(counts.items()))] + [(0, -1, [-1])]
    heapq.heapify(heap)
    length = Counter()
    serial = len(heap)
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for symbol in a + b:
            length[symbol] += 1
        heapq.heappush(heap, (n + m, serial, a + b))
        serial += 1
    by_length = Counter(length.values())
    for bits in range(max(by_length), 16, -1):
        while by_length[bits] > 0:
            shorter = max(b for b in range(1, bits - 1) if by_length[b])
            by_length[bits] -= 2
            by_length[bits - 1] += 1
            by_length[shorter + 1] += 2
            by_length[shorter] -= 1
    longest = max(b for b in by_length if by_length[b])
    by_length[longest] -= 1  # the place of the code that is all ones
    order = sorted(counts, key=lambda s: (length[s], s))
    return bytes(by_length[b] for b in range(1, 17)), bytes(order)


def _bit_length(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _symbols(stream: np.ndarray, tables: np.ndarray, changes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, extra value, extra bits) of blocks in zig-zag order; a code is the key of its table << 8 | symbol.

    A block has its change of the first coefficient, its other coefficients, each behind codes for 16 zeros, and an end where zeros are left.
    """
    block, place = np.nonzero(stream[:, 1:])
    value = stream[block, place + 1].astype(np.int64)
    fresh = np.ones(len(block), bool)
    fresh[1:] = block[1:] != block[:-1]
    run = place - np.where(fresh, 0, np.concatenate([[0], place[:-1] + 1]))
    size = _bit_length(np.abs(value))
    ended = np.zeros(len(stream), bool)
    ended[block[place == 62]] = True
    # places: each block's first code, its coefficients behind their zeros, its end
    long = run >> 4
    codes = np.bincount(block, 1 + long, len(stream)).astype(np.int64) + 1 + ~ended
    starts = np.concatenate([[0], np.cumsum(codes)])
    within = np.cumsum(1 + long)
    before = np.concatenate([[0], within])[np.searchsorted(block, np.arange(len(stream)))]
    at = starts[block] + within - before[block]
    key, extra, bits = np.zeros((3, starts[-1]), np.int64)
    key[:] = np.repeat(16 | tables, codes) << 8 | 0xF0
    first = _bit_length(np.abs(changes))
    key[starts[:-1]] = tables << 8 | first
    extra[starts[:-1]], bits[starts[:-1]] = np.where(changes > 0, changes, changes + (1 << first) - 1), first
    key[at] = (16 | tables[block]) << 8 | (run & 15) << 4 | size
    extra[at], bits[at] = np.where(value > 0, value, value + (1 << size) - 1), size
    key[starts[1:][~ended] - 1] = (16 | tables[~ended]) << 8
    return key, extra, bits


def _packed(words: np.ndarray, sizes: np.ndarray) -> bytes:
    """Words of so many bits one behind the other; the last byte is filled with ones."""
    pieces, rest = [], np.zeros(0, np.uint8)
    for first in range(0, len(words), PACKED):
        word, size = words[first : first + PACKED], sizes[first : first + PACKED]
        ends = np.cumsum(size)
        shift = np.repeat(ends, size) - 1 - np.arange(ends[-1])
        bits = np.concatenate([rest, (np.repeat(word, size) >> shift & 1).astype(np.uint8)])
        whole = len(bits) // 8 * 8
        pieces.append(np.packbits(bits[:whole]).tobytes())
        rest = bits[whole:]
    if len(rest):
        pieces.append(np.packbits(np.concatenate([rest, np.ones(8 - len(rest), np.uint8)])).tobytes())
    return b"".join(pieces)


def write(image: Image) -> bytes:
    """A baseline file of the coefficients, without metadata; its Huffman tables are optimal for them."""
    first = image.components[0]
    columns, rows = first.blocks.shape[1] // first.h, first.blocks.shape[0] // first.v
    parts, changes = [], []
    for c in image.components:
        part = c.blocks[:, :, ORDER].reshape(rows, c.v, columns, c.h, 64).transpose(0, 2, 1, 3, 4).reshape(rows * columns, c.h * c.v, 64)
        parts.append(part)
        changes.append(np.diff(part[:, :, 0].ravel().astype(np.int64), prepend=0).reshape(part.shape[:2]))
    tables = np.repeat([min(i, 1) for i in range(len(parts))], [p.shape[1] for p in parts])
    key, extra, bits = _symbols(np.concatenate(parts, 1).reshape(-1, 64), np.tile(tables, rows * columns), np.concatenate(changes, 1).ravel())
    counts = {}
    for code, n in enumerate(np.bincount(key).tolist()):
        if n:
            counts.setdefault(code >> 8, Counter())[code & 255] = n
    for table in set(tables.tolist()):
        counts.setdefault(16 | table, Counter({0: 1}))
    made = {key: _codes(c) for key, c in sorted(counts.items())}
    word, length = np.zeros((2, 32 << 8), np.int64)
    for table, m in made.items():
        for symbol, (code, n) in _lengths(*m).items():
            word[table << 8 | symbol], length[table << 8 | symbol] = code, n
    scanned = _packed(word[key] << bits | extra, length[key] + bits)
    steps = b"".join(segment(0xDB, bytes([16 * int(t.max() > 255) | slot]) + t[ORDER].astype(">u2" if t.max() > 255 else "u1").tobytes()) for slot, t in sorted(image.tables.items()))
    planes = b"".join(bytes([c.number, c.h << 4 | c.v, c.slot]) for c in image.components)
    frame = segment(0xC0, struct.pack(">BHHB", 8, image.height, image.width, len(image.components)) + planes)
    codes = b"".join(segment(0xC4, bytes([key]) + numbers + symbols) for key, (numbers, symbols) in made.items())
    scan = segment(0xDA, bytes([len(image.components)]) + b"".join(bytes([c.number, 0x11 * min(i, 1)]) for i, c in enumerate(image.components)) + b"\0\x3f\0")
    return b"\xff\xd8" + steps + frame + codes + scan + scanned.replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def transcode(data: bytes) -> bytes:
    """The same coefficients under optimal codes; pixels stay identical, metadata goes."""
    return write(read(data))


def spectral_scans(components: int) -> list[tuple[list[int], int, int]]:
    """(planes, first, last coefficient) of the scans of a progressive file: all first coefficients, then low and high bands plane by plane."""
    return [(list(range(components)), 0, 0), *[([i], a, b) for a, b in ((1, 5), (6, 63)) for i in range(components)]]


# pixels


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    return basis


def _plane(c: Component, table: np.ndarray) -> np.ndarray:
    rows, columns, _ = c.blocks.shape
    freq = (c.blocks.astype(np.float64) * table).reshape(rows, columns, 8, 8)
    basis = _cosines()
    part = np.einsum("ku,rckl,lv->rcuv", basis, freq, basis, optimize=True) + 128
    return part.transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)


def pixels(image: Image) -> np.ndarray:
    """height x width x (1 or 3) bytes."""
    top_h, top_v = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = [np.repeat(np.repeat(_plane(c, image.tables[c.slot]), top_v // c.v, 0), top_h // c.h, 1)[: image.height, : image.width] for c in image.components]
    if len(planes) == 1:
        return np.clip(np.round(planes[0]), 0, 255).astype(np.uint8)[:, :, None]
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
    return np.clip(np.round(rgb), 0, 255).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    return pixels(read(data))


def as_rgb(image: np.ndarray) -> np.ndarray:
    """Three channels, gray repeated."""
    return np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image


def scaled(base: list[int], quality: float) -> np.ndarray:
    """The table for a quality of 1 to 100."""
    quality = min(max(int(quality), 1), 100)
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255).astype(np.int32)


def coefficients(image: np.ndarray, tables: dict[int, np.ndarray], chroma: tuple[int, int] = (2, 2)) -> Image:
    """Quantised coefficients of pixels; chroma planes are averaged over blocks of that many columns and rows."""
    height, width, channels = image.shape
    if not 0 < width <= MAX_SIDE or not 0 < height <= MAX_SIDE:
        raise Unreadable("a JPEG can't have these sides")
    if channels == 1:
        factors, planes = [(1, 1)], [image[:, :, 0].astype(float)]
    else:
        r, g, b = (image[:, :, i].astype(float) for i in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        factors, planes = [chroma, (1, 1), (1, 1)], [y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402]
    top_h, top_v = factors[0]
    wide, high = -(-width // (8 * top_h)) * 8 * top_h, -(-height // (8 * top_v)) * 8 * top_v
    components = []
    for i, ((h, v), plane) in enumerate(zip(factors, planes)):
        full = np.pad(plane, ((0, high - height), (0, wide - width)), "edge")
        sy, sx = top_v // v, top_h // h
        small = full.reshape(high // sy, sy, wide // sx, sx).mean((1, 3)) - 128
        part = small.reshape(small.shape[0] // 8, 8, small.shape[1] // 8, 8).transpose(0, 2, 1, 3)
        freq = np.einsum("ku,rcuv,lv->rckl", _cosines(), part, _cosines(), optimize=True).reshape(*part.shape[:2], 64)
        slot = min(i, 1)
        components.append(Component(i + 1, h, v, slot, np.round(freq / tables[slot]).astype(np.int16)))
    return Image(width, height, components, {k: t for k, t in tables.items() if k < len(planes)})


def encode(image: np.ndarray, quality: float, chroma: tuple[int, int] = (2, 2)) -> bytes:
    """A baseline file of pixels."""
    return write(coefficients(image, {0: scaled(LUMA, quality), 1: scaled(CHROMA, quality)}, chroma))


def requantized(image: Image, quality: float) -> Image:
    """Coefficients in steps of that quality, never finer than the file's own, rounded half away from zero."""
    tables = {}
    for i, c in enumerate(image.components):
        if c.slot not in tables:
            own = image.tables[c.slot]
            tables[c.slot] = np.clip(np.maximum(scaled(LUMA if i == 0 else CHROMA, quality), own), 1, np.maximum(255, own))
    components = []
    for c in image.components:
        old, new = image.tables[c.slot].astype(np.int64), tables[c.slot].astype(np.int64)
        size = (np.abs(c.blocks.astype(np.int64)) * old * 2 + new) // (2 * new)
        components.append(replace(c, blocks=(np.sign(c.blocks) * size).astype(np.int16)))
    return replace(image, components=components, tables=tables)


# resampling


@lru_cache(maxsize=64)
def _weights(source: int, target: int) -> np.ndarray:
    """target x source weights of Lanczos windows of three lobes, wider where the image shrinks."""
    ratio = source / target
    centre = (np.arange(target) + 0.5) * ratio - 0.5
    x = (np.arange(source)[None, :] - centre[:, None]) / max(1.0, ratio)
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
    return w / w.sum(1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Lanczos resampling."""
    part = np.tensordot(_weights(image.shape[0], height), image.astype(float), (1, 0))
    part = np.tensordot(part, _weights(image.shape[1], width), (1, 1)).transpose(0, 2, 1)
    return np.clip(np.round(part), 0, 255).astype(np.uint8)


def thumbnail(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Box averages: quick, and good enough for a preview."""
    rows, columns = (np.arange(n + 1) * m // n for n, m in ((height, image.shape[0]), (width, image.shape[1])))
    sums = np.zeros((image.shape[0] + 1, image.shape[1] + 1, image.shape[2]))
    sums[1:, 1:] = image.astype(float).cumsum(0).cumsum(1)
    upper, lower = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1)
    left, right = columns[:-1], np.maximum(columns[1:], columns[:-1] + 1)
    area = (lower - upper)[:, None, None] * (right - left)[None, :, None]
    total = sums[lower][:, right] - sums[upper][:, right] - sums[lower][:, left] + sums[upper][:, left]
    return np.clip(np.round(total / area), 0, 255).astype(np.uint8)


# scores


def _luminance(image: np.ndarray) -> np.ndarray:
    return image[:, :, 0].astype(float) if image.shape[2] == 1 else image.astype(float) @ [0.299, 0.587, 0.114]


def error_map(a: np.ndarray, b: np.ndarray, window: int = 8) -> np.ndarray:
    """1 - structural similarity (Wang et al. 2004) of the window around each pixel, of equal-sized images."""

    def mean(x: np.ndarray) -> np.ndarray:
        padded = np.pad(x, ((window // 2, window - window // 2 - 1), (window // 2, window - window // 2 - 1)), "reflect" if min(x.shape) > window else "edge")
        sums = np.zeros((padded.shape[0] + 1, padded.shape[1] + 1))
        sums[1:, 1:] = padded.cumsum(0).cumsum(1)
        return (sums[window:, window:] - sums[:-window, window:] - sums[window:, :-window] + sums[:-window, :-window]) / window**2

    x, y = _luminance(a), _luminance(b)
    mx, my = mean(x), mean(y)
    vx, vy, both = mean(x * x) - mx * mx, mean(y * y) - my * my, mean(x * y) - mx * my
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return 1 - (2 * mx * my + c1) * (2 * both + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))


def score(errors: np.ndarray) -> float:
    """0 to 100 for the mean of an error map; 100 where images are the same."""
    return float(np.clip(100 * (1 - errors.mean()), 0, 100))


def compare(a: np.ndarray, b: np.ndarray, side: int) -> dict:
    """global score, and score, difficulty and area of tiles of about that side, row by row.

    The global score of images of 1024 pixels and more is taken at half the resolution; a tile's difficulty is its mean error.
    """
    tiles = []
    errors = error_map(a, b)
    for y, h in spans(a.shape[0], side):
        for x, w in spans(a.shape[1], side):
            part = errors[y : y + h, x : x + w]
            tiles.append({"score": score(part), "difficulty": float(part.mean()), "area": w * h})
    whole = errors
    if min(a.shape[:2]) >= 1024:
        small = [half_res(as_rgb(m), m.shape[1], m.shape[0], 3) for m in (a, b)]
        whole = error_map(*small)
    return {"global": score(whole), "tiles": tiles}


def spans(length: int, side: int, least: int = 96) -> list[tuple[int, int]]:
    """(start, size) pieces that cover 0..length; a rest shorter than ``least`` joins the last one."""
    n = max(1, length // side + (length % side >= least))
    return [(i * side, length - i * side if i == n - 1 else side) for i in range(n)]
