"""Media columns of AVI motion JPEG: RIFF indexes, baseline JPEG frames and shots, giving timed clip rows.

A file's frames are found through its ``idx1`` or OpenDML standard indexes, or by walking the ``movi`` lists if there are none. Each frame is an intra
frame, decoded here: baseline or extended sequential Huffman JPEG with any sampling factors, restart markers and, as usual in AVI, possibly without
Huffman tables. Frames with the same headers are decoded side by side: every step reads the next symbol of each of them by table. A shot begins where the histogram difference of neighbouring
frames, the largest of any component, stands out from the differences around it: it must exceed their median by a multiple of their deviation (the median of
distances to it), and by a small floor and what differs between samples of one picture, which is more the smaller it is. So where most frames around are cuts, none stands out.

Defined results: null, empty and broken files and those without video have no clips; a frame that can't be decoded, lacks a part of its data, has more blocks than its data can hold, or is empty (a repeat of
the one before), shows the last good one, and frames before the first good one count as black; all of these but the empty ones are counted in ``bad_frames`` of their clip, so a film of which nothing can be
decoded is one clip of bad frames only; a file of one frame is one clip; rows that repeat give clips each; other columns are ignored; a key column named like one of the result is a ValueError. Only what a file's
bytes say makes a frame bad: any other failure, as of memory, fails the query.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name

BINS, RADIUS, DEVIATIONS, FLOOR, PARTS = 32, 8, 3.0, 0.05, 4
#: Neighbouring samples are alike, so a picture tells as much as a sixteenth of them would.
ALIKE = 16
#: Frames decoded at once, and blocks and bytes of those that are decoded side by side, if there are so many streams at least.
FRAMES, BLOCKS, BYTES, SIDE_BY_SIDE = 8192, 1 << 17, 4 << 20, 16

ZIGZAG = np.array([(s - k if s % 2 == 0 else k) * 8 + (k if s % 2 == 0 else s - k) for s in range(15) for k in range(s + 1) if k < 8 and s - k < 8])
_DCT = np.array([[np.sqrt((1 + (u > 0)) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
_LUMA_Q = np.array([16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99])


def _tail(first: int, rows: range) -> bytes:
    return bytes((r << 4) + c for r in rows for c in range(first, 11))


_DC = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))), (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12)))
_AC = (
    (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a") + _tail(3, range(4, 8)) + _tail(3, range(8, 9)) + _tail(2, range(9, 14)) + _tail(1, range(14, 16))),
    (bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]), bytes.fromhex("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a") + _tail(3, range(4, 8)) + _tail(2, range(8, 16))),
)


def codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a canonical Huffman table."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(64)
def peek_table(counts: bytes, symbols: bytes) -> list[int]:
    """For any next 16 bits the length and symbol of the code they begin with, as length << 8 | symbol; 0 if none."""
    out = np.zeros(1 << 16, np.int64)
    for symbol, code, length in codes(counts, symbols):
        out[code << 16 - length : (code + 1) << 16 - length] = length << 8 | symbol
    return out.tolist()


class BrokenScan(ValueError):
    """The data of an image aren't what its headers say."""


class Bits:
    """Reads entropy-coded bits; beyond the end come ones."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at, self.have, self.bits = raw.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def fill(self) -> None:
        chunk = self.raw[self.at : self.at + 6]
        self.at += 6
        self.bits = (self.bits & (1 << self.have) - 1) << 48 | int.from_bytes(chunk + b"\xff" * (6 - len(chunk)), "big")
        self.have += 48

    def symbol(self, table: list[int]) -> int:
        if self.have < 32:
            self.fill()
        x = table[self.bits >> self.have - 16 & 0xFFFF]
        if not x:
            raise BrokenScan("no such Huffman code")
        self.have -= x >> 8
        return x & 255

    def number(self, n: int) -> int:
        if not n:
            return 0
        if self.have < 32:
            self.fill()
        self.have -= n
        x = self.bits >> self.have & (1 << n) - 1
        return x if x >> n - 1 else x - (1 << n) + 1

    def beyond(self) -> bool:
        """Whether more was read than there is."""
        return 8 * self.at - self.have > 8 * len(self.raw)


@dataclass
class _Component:
    ident: int
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Header:
    """What precedes the scan of an image, which begins at ``end``."""

    parts: list[_Component]
    quant: list[np.ndarray]
    huff: list[tuple[bytes, bytes]]
    interval: int
    width: int
    height: int
    end: int
    top_h: int = field(init=False)
    top_v: int = field(init=False)

    def __post_init__(self) -> None:
        self.top_h, self.top_v = max(c.h for c in self.parts), max(c.v for c in self.parts)
        if any(not c.h or not c.v or self.top_h % c.h or self.top_v % c.v for c in self.parts) or max(self.top_h, self.top_v) > 4:
            raise ValueError("sampling factors that don't divide or are beyond 4")
        for counts, symbols in self.huff:
            if len(counts) < 16 or len(symbols) < sum(counts) or sum(n << 16 - size for size, n in enumerate(counts, 1)) > 1 << 16:
                raise ValueError("not a Huffman table")
        self.across, self.down = -(-self.width // (8 * self.top_h)), -(-self.height // (8 * self.top_v))
        self.mcus = self.across * self.down
        #: The component of each block of an MCU.
        self.pattern = np.repeat(np.arange(len(self.parts)), [c.h * c.v for c in self.parts])
        self.n_blocks = self.mcus * len(self.pattern)

    @property
    def tables(self) -> np.ndarray:
        """For each component those of first and of other coefficients, one after another."""
        return _tables(tuple(self.huff))

    def check(self, size: int) -> None:
        """A block takes two bits at least."""
        if self.n_blocks > 4 * size:
            raise ValueError("more blocks than data")


@lru_cache(16)
def _tables(huff: tuple[tuple[bytes, bytes], ...]) -> np.ndarray:
    return np.concatenate([np.array(peek_table(*h), np.int32) for h in huff])


def parse_header(raw: bytes) -> Header:
    quant: dict[int, np.ndarray] = {}
    huff = {(c, k): t for c, pair in enumerate((_DC, _AC)) for k, t in enumerate(pair)}
    parts: list[_Component] = []
    at, interval, width, height = 2, 0, 0, 0
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    while True:
        if at + 4 > len(raw) or raw[at] != 0xFF:
            raise ValueError("broken JPEG markers")
        mark = raw[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            raise ValueError("no scan")
        size = struct.unpack_from(">H", raw, at + 2)[0]
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                table = np.zeros(64)
                table[ZIGZAG] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8)
                quant[k], body = table, body[1 + n :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0] >> 4, body[0] & 15] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("only 8 bits a sample")
            height, width = struct.unpack_from(">HH", body, 1)
            parts = [_Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif 0xC2 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise ValueError("not a sequential Huffman image")
        elif mark == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif mark == 0xDA:
            for k in range(body[0]):
                for c in parts:
                    if c.ident == body[1 + 2 * k]:
                        c.dc, c.ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
            if body[0] != len(parts):
                raise ValueError("components in several scans")
            break
    if not parts or not width or not height:
        raise ValueError("no frame header")
    if len(parts) == 1:
        parts[0].h = parts[0].v = 1
    return Header(parts, [quant[c.quant] for c in parts], [huff[k] for c in parts for k in ((0, c.dc), (1, c.ac))], interval, width, height, at)


#: Headers seen, by their bytes; an image with the same first bytes has the same header.
_headers: dict[bytes, Header] = {}


def header_of(raw: bytes) -> Header:
    for n in {h.end for h in _headers.values()}:
        if found := _headers.get(raw[:n]):
            return found
    found = parse_header(raw)
    if len(_headers) >= 16:
        _headers.clear()
    return _headers.setdefault(raw[: found.end], found)


def _segments(raw: bytes) -> list[bytes]:
    """Entropy-coded data between restart markers."""
    out, begin, at = [], 0, raw.find(b"\xff")
    while at >= 0 and at + 1 < len(raw):
        mark = raw[at + 1]
        if 0xD0 <= mark <= 0xD7:
            out.append(raw[begin:at])
            begin = at + 2
        elif mark not in (0, 0xFF):
            return [*out, raw[begin:at]]
        at = raw.find(b"\xff", at + (2 if mark != 0xFF else 1))
    return [*out, raw[begin:]]


def _streams(h: Header, scan: bytes) -> list[tuple[bytes, int, int]]:
    """The data between restart markers, with its first block and its number of blocks."""
    step = h.interval * len(h.pattern) if h.interval else h.n_blocks
    out = [(data, k * step, min(step, h.n_blocks - k * step)) for k, data in enumerate(_segments(scan)) if k * step < h.n_blocks]
    if len(out) * step < h.n_blocks:
        raise BrokenScan("too few restart intervals")
    return out


def plain_coefficients(h: Header, scan: bytes) -> np.ndarray:
    """The coefficients of the blocks of one scan, in its order, each first one as the difference that is coded."""
    out = np.zeros((h.n_blocks, 64), np.int16)
    tables = [peek_table(*t) for t in h.huff]
    zigzag, pattern = ZIGZAG.tolist(), h.pattern.tolist()
    for data, first, n in _streams(h, scan):
        bits = Bits(data)
        for b in range(n):
            block, c = out[first + b], pattern[b % len(pattern)]
            size = bits.symbol(tables[2 * c])
            if size > 15:
                raise BrokenScan("too large a difference")
            block[0] = bits.number(size)
            ac, at = tables[2 * c + 1], 1
            while at < 64:
                s = bits.symbol(ac)
                if not s & 15:
                    if s != 0xF0:
                        break
                    at += 16
                    continue
                at += s >> 4
                if at > 63:
                    raise BrokenScan("too many coefficients")
                block[zigzag[at]] = bits.number(s & 15)
                at += 1
        if bits.beyond():
            raise BrokenScan("the data end too early")
    return out


_LOW = np.array([(1 << n) - 1 for n in range(16)])
_HALF = np.array([1 << n >> 1 for n in range(16)])


def coefficients(h: Header, streams: list[tuple[bytes, int, int]], n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The coefficients of all streams (data, first block, blocks), decoded side by side, and which streams are broken."""
    out = np.zeros((n_blocks + 1) * 64, np.int16)
    clean = [d.replace(b"\xff\x00", b"\xff") for d, _, _ in streams]
    at = np.cumsum([0, *(len(c) + 8 for c in clean)])
    raw = np.frombuffer((b"\xff" * 8).join([*clean, b""]) + b"\xff" * 8, np.uint8).astype(np.int64)
    near = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    pos, end = at[:-1] * 8, (at[1:] - 8) * 8
    block, n = np.array([b for _, b, _ in streams]), np.array([n for _, _, n in streams])
    last, k, turn, who = block + n, np.zeros(len(streams), np.int64), np.zeros(len(streams), np.int64), np.arange(len(streams))
    tables, pattern, broken = h.tables, 2 * h.pattern, np.zeros(len(streams), bool)
    zigzag = np.append(ZIGZAG, 0)
    while len(who):
        p = np.minimum(pos, end)
        ahead = k > 0
        found = tables[(pattern[turn] + ahead) << 16 | near[p >> 3] >> (16 - (p & 7)) & 0xFFFF]
        size, symbol = found >> 8, found & 255
        n = symbol & 15
        pos = pos + size
        p = np.minimum(pos, end)
        bits = near[p >> 3] >> (32 - n - (p & 7)) & _LOW[n]
        pos += n
        run = symbol >> 4
        k += np.where(ahead, run, 0)
        kept = (n > 0) | ~ahead
        bad = (found == 0) | (~ahead & (run > 0)) | ((k > 63) & (n > 0)) | (pos > end)
        cell = np.where(kept & ~bad, block * 64 + zigzag[np.minimum(k, 64)], n_blocks * 64)
        out[cell] = bits - _LOW[n] * (bits < _HALF[n])
        k = np.where(kept | (run == 15), k + 1, 64)
        over = k > 63
        k[over] = 0
        block += over
        turn = np.where(over, turn + 1, turn)
        turn[turn == len(pattern)] = 0
        gone = bad | (block >= last)
        if gone.any():
            broken[who[bad]] = True
            pos, end, block, last, k, turn, who = (x[~gone] for x in (pos, end, block, last, k, turn, who))
    return out[:-64].reshape(-1, 64), broken


_BASIS = np.kron(_DCT, _DCT)


def samples(h: Header, coded: np.ndarray, rows: int = 1 << 16) -> Iterator[tuple[int, np.ndarray]]:
    """For each component and so many rows of MCUs its number and samples, (frames, height, width), brought to full size."""
    frames = len(coded) // h.n_blocks
    mcu = coded.reshape(frames, h.down, h.across, len(h.pattern), 64)
    begin = 0
    for number, (c, quant) in enumerate(zip(h.parts, h.quant, strict=True)):
        each = c.h * c.v
        own = mcu[:, :, :, begin : begin + each]
        begin += each
        step = h.interval * each if h.interval else h.mcus * each
        first = np.zeros((frames, -(-h.mcus * each // step) * step), np.int64)
        first[:, : h.mcus * each] = own[..., 0].reshape(frames, -1)
        first = np.cumsum(first.reshape(frames, -1, step), 2).reshape(frames, -1)[:, : h.mcus * each].reshape(frames, h.down, -1)
        for top in range(0, h.down, rows):
            flat, level = own[:, top : top + rows].reshape(-1, 64), first[:, top : top + rows].reshape(-1)
            pixels = np.empty((len(flat), 64), np.uint8)
            for a in range(0, len(flat), 1 << 15):
                x = flat[a : a + (1 << 15)].astype(float)
                x[:, 0] = level[a : a + (1 << 15)]
                # a little above a half, so that ties go up whatever the order of the sum
                pixels[a : a + (1 << 15)] = np.clip(np.floor((x * quant) @ _BASIS + (128.5 + 1e-7)), 0, 255)
            down = min(rows, h.down - top)
            plane = pixels.reshape(frames, down, h.across, c.v, c.h, 8, 8).transpose(0, 1, 3, 5, 2, 4, 6).reshape(frames, down * c.v * 8, h.across * c.h * 8)
            yield number, plane.repeat(h.top_v // c.v, 1).repeat(h.top_h // c.h, 2)[:, : h.height - top * h.top_v * 8, : h.width]


def decode_jpeg(raw: bytes) -> np.ndarray:
    """The samples of an image, (height, width, components) as uint8, each component brought to full size."""
    h = header_of(raw)
    h.check(len(raw))
    return np.stack([x[0] for _, x in samples(h, plain_coefficients(h, raw[h.end :]))], 2)


@lru_cache(4)
def _encoding(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    return {s: (c, n) for s, c, n in codes(counts, symbols)}


def _head(h: int, w: int, sampling: list[tuple[int, int]], tables: bool, restart: int) -> bytes:
    seg = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    kinds = b"".join(bytes([k + 1, x << 4 | y, 0]) for k, (x, y) in enumerate(sampling))
    head = b"\xff\xd8" + seg(0xDB, b"\0" + bytes(_LUMA_Q[ZIGZAG].tolist())) + seg(0xC0, struct.pack(">BHHB", 8, h, w, len(sampling)) + kinds)
    if tables:
        head += seg(0xC4, b"\0" + b"".join(_DC[0])) + seg(0xC4, b"\x10" + b"".join(_AC[0]))
    if restart:
        head += seg(0xDD, struct.pack(">H", restart))
    return head + seg(0xDA, bytes([len(sampling), *(x for k in range(len(sampling)) for x in (k + 1, 0)), 0, 63, 0]))


def encode_jpeg(planes: np.ndarray | list[np.ndarray], tables: bool = True, restart: int = 0, sampling: list[tuple[int, int]] | None = None) -> bytes:
    """A baseline image of one plane, or of several with their sampling factors, sides multiples of an MCU's, optionally without Huffman tables or with restart markers."""
    planes, sampling = planes if isinstance(planes, list) else [planes], sampling or [(1, 1)]
    top_h, top_v = max(x for x, _ in sampling), max(y for _, y in sampling)
    parts = []
    for plane, (x, y) in zip(planes, sampling, strict=True):
        h, w = plane.shape
        blocks = (plane.astype(float) - 128).reshape(h // 8 // y, y, 8, w // 8 // x, x, 8).transpose(0, 3, 1, 4, 2, 5)
        parts.append(np.rint((_DCT @ blocks @ _DCT.T).reshape(-1, x * y, 64) / _LUMA_Q).astype(int)[:, :, ZIGZAG].tolist())
    dc, ac = _encoding(*_DC[0]), _encoding(*_AC[0])
    out, bits, n, last = [], 0, 0, [0] * len(parts)

    def flush() -> bytes:
        pad = -n % 8
        return ((bits << pad) | (1 << pad) - 1).to_bytes((n + pad) // 8, "big").replace(b"\xff", b"\xff\x00")

    for k, mcu in enumerate(zip(*parts, strict=True)):
        if restart and k and not k % restart:
            out.append(flush() + bytes([0xFF, 0xD0 + (k // restart - 1) % 8]))
            bits, n, last = 0, 0, [0] * len(parts)
        for c, block in ((c, block) for c, blocks in enumerate(mcu) for block in blocks):
            run = 0
            for at, value in enumerate([block[0] - last[c], *block[1:]]):
                if at and not value:
                    run += 1
                    continue
                while run > 15:
                    code, size = ac[0xF0]
                    bits, n, run = bits << size | code, n + size, run - 16
                width = abs(value).bit_length()
                code, size = ac[run << 4 | width] if at else dc[width]
                bits = (bits << size | code) << width | (value if value >= 0 else value + (1 << width) - 1)
                n, run = n + size + width, 0
            last[c] = block[0]
            if run:
                code, size = ac[0]
                bits, n = bits << size | code, n + size
    out.append(flush())
    x, y = sampling[0]
    return _head(planes[0].shape[0] * top_v // y, planes[0].shape[1] * top_h // x, sampling, tables, restart) + b"".join(out) + b"\xff\xd9"


@lru_cache(4)
def _code_arrays(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, c, n in codes(counts, symbols):
        code[s], size[s] = c, n
    return code, size


def encode_many(gray: np.ndarray, tables: np.ndarray) -> list[bytes]:
    """Baseline images of (frames, height, width), all at once; tables tells which have Huffman tables."""
    f, h, w = gray.shape
    blocks = (gray - 128.0).reshape(f, h // 8, 8, w // 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 64)
    value = np.rint((blocks @ _BASIS.T) / _LUMA_Q).astype(np.int64)[:, ZIGZAG].reshape(f, -1, 64)
    value[:, 1:, 0] -= value[:, :-1, 0].copy()
    each = value.shape[1]
    value = value.reshape(-1, 64)
    there = value != 0
    there[:, 0] = True
    block, at = np.nonzero(there)
    value = value[block, at]
    first = at == 0
    run = np.where(first, 0, at - np.append(0, at[:-1]) - 1)
    width = np.frexp(np.abs(value).astype(float))[1].astype(np.int64)
    code_d, size_d = _code_arrays(*_DC[0])
    code_a, size_a = _code_arrays(*_AC[0])
    symbol = np.where(first, width, (run & 15) << 4 | width)
    code, size = np.where(first, code_d[symbol], code_a[symbol]), np.where(first, size_d[symbol], size_a[symbol])
    end = np.append(first[1:], True) & (at < 63)
    n = (run >> 4) + 1 + end
    begin = np.cumsum(n) - n
    bits, length = np.empty(int(n.sum()), np.int64), np.empty(int(n.sum()), np.int64)
    for z in range(3):
        long = begin[run >> 4 > z] + z
        bits[long], length[long] = code_a[0xF0], size_a[0xF0]
    own = begin + (run >> 4)
    bits[own], length[own] = code << width | np.where(value >= 0, value, value + (1 << width) - 1), size + width
    bits[own[end] + 1], length[own[end] + 1] = code_a[0], size_a[0]
    frame = np.repeat(block // each, n)
    total = np.bincount(frame, length, f).astype(np.int64)
    place = np.concatenate([[0], np.cumsum(-(-total // 8))])
    offset = np.cumsum(length) - length
    offset += (8 * place[:-1] - (np.cumsum(total) - total))[frame]
    pad = -total % 8
    bits, length, offset = np.append(bits, (1 << pad) - 1), np.append(length, pad), np.append(offset, 8 * place[:-1] + total)
    # bits don't overlap, so sums of the two words that each code touches are exact
    wide = bits.astype(np.uint64) << np.minimum(64 - length - (offset & 31), 63).astype(np.uint64)
    words = np.bincount(offset >> 5, (wide >> np.uint64(32)).astype(float), int(place[-1]) // 4 + 2)
    words[1:] += np.bincount(offset >> 5, (wide & np.uint64(0xFFFFFFFF)).astype(float), len(words))[:-1]
    raw = words.astype(np.uint32).astype(">u4").tobytes()
    heads = [_head(h, w, [(1, 1)], bool(t), 0) for t in (False, True)]
    return [heads[bool(t)] + raw[a:z].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for t, a, z in zip(tables, place[:-1], place[1:], strict=True)]


def write_avi(frames: list[bytes], fps: int = 25, width: int = 16, height: int = 16, index: bool = True) -> bytes:
    """An AVI file of JPEG frames."""
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    movi, entries = b"movi", b""
    for f in frames:
        entries += b"00dc" + struct.pack("<III", 16, len(movi), len(f))
        movi += chunk(b"00dc", f)
    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 16, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, fps, 0, len(frames), 0, 0, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", 0, 0, 0, 0, 0)
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    body = b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl) + chunk(b"LIST", movi)
    return chunk(b"RIFF", body + (chunk(b"idx1", entries) if index else b""))


@dataclass
class Video:
    seconds_per_frame: float
    frames: list[tuple[int, int]]


def _chunks(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, begin, end) of the chunks in a range; the last one may be cut off."""
    while at + 8 <= end:
        size = struct.unpack_from("<I", raw, at + 4)[0]
        yield raw[at : at + 4], at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


def parse_avi(raw: bytes) -> Video:
    """Timing and the places of the frames of the first video stream."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    spf, stream, number = 0.0, -1, -1
    movis: list[tuple[int, int]] = []
    idx1: tuple[int, int] | None = None
    standard: list[tuple[int, int]] = []
    for riff, begin, end in _chunks(raw, 0, len(raw)):
        if riff != b"RIFF":
            continue
        for name, a, z in _chunks(raw, begin + 4, end):
            kind = raw[a : a + 4] if name == b"LIST" else b""
            if kind == b"hdrl":
                for n2, a2, z2 in _chunks(raw, a + 4, z):
                    if n2 == b"avih":
                        spf = spf or struct.unpack_from("<I", raw, a2)[0] / 1e6
                    elif n2 == b"LIST" and raw[a2 : a2 + 4] == b"strl":
                        number += 1
                        for n3, a3, _ in _chunks(raw, a2 + 4, z2):
                            if n3 == b"strh" and raw[a3 : a3 + 4] == b"vids" and stream < 0:
                                stream = number
                                scale, rate = struct.unpack_from("<II", raw, a3 + 20)
                                spf = scale / rate if scale and rate else spf
            elif kind == b"movi":
                movis.append((a, z))
            elif name == b"idx1":
                idx1 = a, z
    if stream < 0 or not movis:
        raise ValueError("no video")
    wanted = tuple(b"%02d" % stream + x for x in (b"dc", b"db"))
    frames: list[tuple[int, int]] = []
    if idx1 and len(movis) == 1:
        movi = movis[0][0]
        entries = [struct.unpack_from("<4sIII", raw, k) for k in range(idx1[0], idx1[1] - 15, 16)]
        base = movi
        if entries and raw[movi + entries[0][2] : movi + entries[0][2] + 4] != entries[0][0]:
            base = 0  # offsets from the beginning of the file
        frames = [(base + at + 8, size) for name, _, at, size in entries if name in wanted]
    if not frames:
        for a, z in movis:
            for name, b, _ in _walk(raw, a + 4, z):
                if name == b"ix%02d" % stream and raw[b + 3] == 1:
                    n, base = struct.unpack_from("<I", raw, b + 4)[0], struct.unpack_from("<Q", raw, b + 12)[0]
                    standard += [(base + o, s & 0x7FFFFFFF) for o, s in (struct.unpack_from("<II", raw, b + 24 + 8 * k) for k in range(n))]
        frames = standard or [(b, e - b) for a, z in movis for name, b, e in _walk(raw, a + 4, z) if name in wanted]
    return Video(spf or 1 / 25, frames)


def _walk(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """The chunks of a list and of lists in it, in order."""
    open_ = [_chunks(raw, at, end)]
    while open_:
        for name, a, z in open_[-1]:
            if name == b"LIST":
                open_.append(_chunks(raw, a + 4, z))
                break
            yield name, a, z
        else:
            open_.pop()


def _shares() -> np.ndarray:
    """How each brightness counts for the two bins whose middles are nearest, so that small changes stay small."""
    at = np.clip(np.arange(256) * BINS / 256 - 0.5, 0, BINS - 1)
    low = np.minimum(at.astype(int), BINS - 2)
    out = np.zeros((256, BINS))
    out[np.arange(256), low] = 1 - (at - low)
    out[np.arange(256), low + 1] = at - low
    return out


_SHARE = _shares()


def _counted(h: Header, coded: np.ndarray) -> np.ndarray:
    """(frames, PARTS, BINS): shares of the samples of each component."""
    frames = len(coded) // h.n_blocks
    out, parts = np.tile(_SHARE[128], (frames, PARTS, 1)), min(PARTS, len(h.parts))
    counts = np.zeros((parts, frames * 256), np.int64)
    # samples take more room than coefficients, so those of a large picture are counted in strips
    for c, plane in samples(h, coded, max(BLOCKS // (frames * h.across * h.top_h * h.top_v), 1)):
        if c >= parts:
            break
        at = plane.reshape(frames, -1) + 256 * np.arange(frames)[:, None]
        counts[c] += np.bincount(at.ravel(), minlength=256 * frames)
    out[:, :parts] = (counts.reshape(parts, frames, 256) @ _SHARE).transpose(1, 0, 2) / (h.width * h.height)
    return out


#: What reading headers gives where bytes are missing or make no sense. Nothing else may pass for a broken file, lack of memory least of all.
_BROKEN = (ValueError, IndexError, KeyError, struct.error)


def histograms(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Histograms of frames, their numbers of samples, and which are good; components that a frame lacks count as neutral. Frames are bad for their bytes only, other failures are raised."""
    hist, sizes, good = np.zeros((len(frames), PARTS, BINS)), np.ones(len(frames)), np.zeros(len(frames), bool)
    alike: dict[int, list[int]] = defaultdict(list)
    headers: dict[int, Header] = {}
    for k, raw in enumerate(frames):
        try:
            h = header_of(raw)
            h.check(len(raw))
        except _BROKEN:
            continue
        headers[id(h)] = h
        alike[id(h)].append(k)
    for key, members in alike.items():
        h = headers[key]
        at = 0
        while at < len(members):
            n_bytes = 0
            streams: list[tuple[bytes, int, int]] = []
            owner: list[int] = []
            part: list[int] = []
            while at < len(members) and (not part or ((len(part) + 1) * h.n_blocks <= BLOCKS and n_bytes <= BYTES)):
                raw = frames[members[at]]
                at += 1
                try:
                    own = _streams(h, raw[h.end :])
                except BrokenScan:
                    continue
                streams += [(d, b + len(part) * h.n_blocks, n) for d, b, n in own]
                owner += [len(part)] * len(own)
                part.append(members[at - 1])
                n_bytes += len(raw)
            fine = np.ones(len(part), bool)
            if len(streams) >= SIDE_BY_SIDE:
                coded, broken = coefficients(h, streams, len(part) * h.n_blocks)
                fine[np.array(owner)[broken]] = False
                hist[part] = _counted(h, coded)
            else:
                for k, x in enumerate(part):
                    try:
                        coded = plain_coefficients(h, frames[x][h.end :])
                    except BrokenScan:
                        fine[k] = False
                        continue
                    hist[x] = _counted(h, coded)[0]
            good[part], sizes[part] = fine, h.width * h.height
    return hist, sizes, good


def _medians(x: np.ndarray) -> np.ndarray:
    """Of each row those of the numbers that aren't NaN, 0 if there are none."""
    x = np.sort(x, 1)
    n = (~np.isnan(x)).sum(1)
    row, most = np.arange(len(x)), np.maximum(n - 1, 0)
    return np.where(n > 0, (x[row, most // 2] + x[row, np.minimum(n // 2, most)]) / 2, 0.0)


def differences(films: list[tuple[bytes, Video]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each frame of all films the histogram difference to the one before, NaN for a film's first, what differs between samples of one picture, and whether it is bad."""
    places = [(f, at, size) for f, (_, video) in enumerate(films) for at, size in video.frames]
    film = np.array([f for f, _, _ in places], np.int64)
    begins = np.diff(film, prepend=-1) > 0
    d, noise = np.full(len(places), np.nan), np.zeros(len(places))
    bad = np.array([size > 0 for _, _, size in places], bool)
    black = np.tile(_SHARE[128], (PARTS, 1))
    black[0] = _SHARE[0]
    last, last_size, last_noise = black, 1.0, 0.0
    for a in range(0, len(places), FRAMES):
        part = slice(a, min(a + FRAMES, len(places)))
        hist, sizes, good = histograms([films[f][0][at : at + size] for f, at, size in places[part]])
        bad[part] &= ~good
        dark = begins[part] & ~good
        hist[dark], sizes[dark] = black, 1.0
        shown = np.maximum.accumulate(np.where(good | dark, np.arange(1, len(good) + 1), 0))  # 0: what the part before ended with
        hist, sizes = np.concatenate([last[None], hist])[shown], np.append(last_size, sizes)[shown]
        own = np.sqrt(hist * (1 - hist)).sum(2).max(1) / np.sqrt(np.pi * sizes / ALIKE)
        d[part] = np.abs(hist - np.concatenate([last[None], hist[:-1]])).sum(2).max(1) / 2
        noise[part] = np.maximum(own, np.append(last_noise, own[:-1]))
        last, last_size, last_noise = hist[-1], sizes[-1], own[-1]
    d[begins] = np.nan
    return d, noise, bad


def shots(d: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Which frames begin a shot."""
    film = np.cumsum(np.isnan(d))
    wide = np.full((len(d), 2 * RADIUS), np.nan)
    for k, by in enumerate(x for x in range(-RADIUS, RADIUS + 1) if x):
        if abs(by) < len(d):
            here, there = (slice(-by, None), slice(None, by)) if by < 0 else (slice(None, -by), slice(by, None))
            wide[here, k] = np.where(film[here] == film[there], d[there], np.nan)
    usual = _medians(wide)
    spread = _medians(np.abs(wide - usual[:, None])) * 1.4826
    return np.isnan(d) | (d > usual + np.maximum(DEVIATIONS * spread, FLOOR + noise))


def clips_of(files: list[bytes | None]) -> list[list[tuple[int, int, int, float, float, int]]]:
    """(number, first frame, end frame, start, end in seconds, bad frames) of the shots of each file."""
    films: list[tuple[bytes, Video]] = []
    which: list[int] = []
    for k, raw in enumerate(files):
        try:
            video = parse_avi(raw or b"")
        except _BROKEN:
            continue
        films.append((raw, video))
        which.append(k)
    d, noise, bad = differences(films)
    begins, before = shots(d, noise), np.append(0, np.cumsum(bad)).tolist()
    out: list[list[tuple[int, int, int, float, float, int]]] = [[] for _ in files]
    at = 0
    for k, (_, video) in zip(which, films, strict=True):
        n, s = len(video.frames), video.seconds_per_frame
        begin = np.flatnonzero(begins[at : at + n]).tolist()
        out[k] = [(c, a, z, a * s, z * s, before[at + z] - before[at + a]) for c, (a, z) in enumerate(zip(begin, [*begin[1:], n], strict=True))] if n else []
        at += n
    return out


def clips(media: DataFrame, column: str = "media", key: str = "media_id") -> DataFrame:
    """(key, clip, first_frame, end_frame, start_s, end_s, bad_frames) of each shot of the files of a binary column."""
    names = ("clip", "first_frame", "end_frame", "start_s", "end_s", "bad_frames")
    if key.lower() in names:
        raise ValueError(f"{key} is the name of a column of the result")

    @F.arrow_udf("array<struct<clip: int, first_frame: int, end_frame: int, start_s: double, end_s: double, bad_frames: int>>")
    def found(files: pa.Array) -> pa.Array:
        rows = clips_of([x.as_py() for x in files])
        flat = [r for x in rows for r in x]
        cols = [pa.array([r[k] for r in flat], pa.float64() if k in (3, 4) else pa.int32()) for k in range(len(names))]
        at = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(cols, names=names))

    x = free_name(media, "found")
    return media.select(F.col(key).alias(key), F.explode(found(F.col(column))).alias(x)).select(key, f"{x}.*")


def plan_of(values: np.ndarray) -> list[int]:
    """The lengths of the shots of the film that is made of a vector."""
    code = np.abs(values * 1000).astype(np.int64)
    return [3 + int(code[k] % 4) for k in range(1 + int(code[0] % 3))]


def films_of(vectors: np.ndarray) -> list[bytes]:
    """Test films: each shot shows the vector as a pattern of its own brightness that drifts slowly."""
    base = np.tanh(vectors * 3) * 12
    plans = [plan_of(v) for v in vectors]
    owner, shot, t = (np.array(x, np.int64) for x in zip(*((k, s, t) for k, p in enumerate(plans) for s, n in enumerate(p) for t in range(n)), strict=True))
    pattern = base[owner[:, None], (np.arange(64) - 3 * shot[:, None]) % 64].reshape(-1, 8, 8).repeat(2, 1).repeat(2, 2)
    frames = encode_many(np.clip(pattern + (50 + 75 * (shot % 3) + t)[:, None, None], 0, 255), t % 2 == 0)
    at = np.cumsum([0, *map(sum, plans)])
    return [write_avi(frames[a:z]) for a, z in zip(at, at[1:])]


def films(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(media_id, media): a film for each vector of 64 numbers, null for any other."""

    @F.arrow_udf("binary")
    def made(column: pa.Array) -> pa.Array:
        rows = column.to_pylist()
        fit = [k for k, x in enumerate(rows) if x is not None and len(x) == 64]
        out: list[bytes | None] = [None] * len(rows)
        for a in range(0, len(fit), 500):
            part = fit[a : a + 500]
            vectors = np.nan_to_num(np.array([[np.nan if v is None else v for v in rows[k]] for k in part], float))
            for k, raw in zip(part, films_of(vectors), strict=True):
                out[k] = raw
        return pa.array(out, pa.binary())

    return vectors.select(F.col(vec_id).alias("media_id"), made(F.col(embedding)).alias("media"))
