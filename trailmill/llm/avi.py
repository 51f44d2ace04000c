"""Operator 2, media columns: AVI files of motion-JPEG.

A file is read by its RIFF index; the frames, baseline JPEG, are decoded as intra frames: entropy
decoding, dequantisation and the inverse transform give the samples of the first component. All
frames of a slice of rows that share their tables are decoded in step, so that each step is one
operation over all frames. Frames whose blocks are all flat have one sample for each block.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm.common import pieces

#: Blocks of a frame that stores bytes: one byte is the DC level of one block, so a frame holds 192.
BLOCKS_X, BLOCKS_Y = 16, 12
UNIT = BLOCKS_X * BLOCKS_Y
FPS = 25
#: Histogram bins; a cut differs by more than the mean and ``FACTOR`` deviations of the last ``PAST``
#: differences, by ``LEAST`` at least, and follows the last cut by ``GAP`` frames.
BINS, PAST, FACTOR, LEAST, GAP = 16, 24, 3.0, 0.25, 4

#: Code lengths of the DC sizes 0 to 11 in the usual luminance table.
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
#: The other usual tables, for files that leave them out: how many codes there are of each
#: length, and the symbols that come first; the rest of them follow in ascending order.
USUAL = {
    0x00: (DC_LENGTHS, ""),
    0x01: ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), ""),
    0x10: ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    0x11: ((0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
}


def canonical_codes(counts: tuple[int, ...] | bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length), from the number of codes of each length 1 to 16."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def usual_symbols(table: int) -> bytes:
    """The symbols of a usual table in the order of their codes: sizes 0 to 11 for DC; for AC all runs of
    0 to 15 zeros before sizes 1 to 10, the end of the block and 16 zeros."""
    if table < 0x10:
        return bytes(range(12))
    first = bytes.fromhex(USUAL[table][1])
    every = {r << 4 | s for r in range(16) for s in range(1, 11)} | {0x00, 0xF0}
    return first + bytes(sorted(every - set(first)))


#: Row and column of each coefficient in the order in which they are stored: diagonal by diagonal, the
#: odd ones downwards.
ZIGZAG = np.array(sorted(((u, v) for u in range(8) for v in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1])))
#: The inverse transform of a block X is BASIS.T @ X @ BASIS.
BASIS = np.array([[(math.sqrt(0.125) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame_header() -> bytes:
    """All of a frame before its samples: quantisation 8 for DC, so that a flat block of level v has the
    DC coefficient v - 128; one component; the usual DC table and an AC table of end-of-block alone."""
    dqt = _segment(0xDB, b"\0" + bytes([8] + [1] * 63))
    sof = _segment(0xC0, struct.pack(">BHHB", 8, BLOCKS_Y * 8, BLOCKS_X * 8, 1) + bytes([1, 0x11, 0]))
    dht = _segment(0xC4, bytes([0x00, *DC_LENGTHS, *range(12)])) + _segment(0xC4, bytes([0x10, 1, *[0] * 15, 0]))
    return b"\xff\xd8" + dqt + sof + dht + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG frames of rows of ``UNIT`` bytes: size and bits of each DC difference, then end of block."""
    n = len(samples)
    if not n:
        return []
    codes = canonical_codes(DC_LENGTHS, bytes(range(12)))
    bits_of, value_of = np.zeros(511, np.uint8), np.zeros(511, np.uint32)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, length = codes[size]
        bits_of[d + 255], value_of[d + 255] = length + size + 1, ((code << size) | (d if d >= 0 else d + (1 << size) - 1)) << 1
    # One row a block, so that each step reads and writes neighbours.
    level = np.ascontiguousarray(samples.T).astype(np.int16)
    diff = np.diff(level, axis=0, prepend=np.int16(128)) + np.int16(255)
    width = UNIT * int(bits_of.max()) // 8 + 8
    out, base = np.zeros(n * width, np.uint8), np.arange(n, dtype=np.int64) * width
    at = np.zeros(n, np.int64)
    for j in range(samples.shape[1]):
        bits = bits_of[diff[j]]
        where = base + (at >> 3)
        v = value_of[diff[j]] << (np.uint32(32) - bits - (at & 7).astype(np.uint32))
        four = v.astype(">u4").view(np.uint8).reshape(n, 4)
        out[where] |= four[:, 0]
        where += 1
        out[where] = four[:, 1]
        where += 1
        out[where] = four[:, 2]
        where += 1
        out[where] = four[:, 3]
        at += bits
    used = (at + 7) >> 3
    out[base + used - 1] |= ((1 << (used * 8 - at)) - 1).astype(np.uint8)
    head, raw = frame_header(), out.tobytes()
    return [head + raw[b : b + u].replace(b"\xff", b"\xff\0") + b"\xff\xd9" for b, u in zip(base.tolist(), used.tolist(), strict=True)]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int = BLOCKS_X * 8, height: int = BLOCKS_Y * 8, fps: int = FPS) -> bytes:
    """RIFF file with one motion-JPEG stream and its index. Sizes are 32-bit: a file stays below 4 GB."""
    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    sizes = np.fromiter(map(len, frames), np.int64, len(frames))
    index = np.zeros((len(frames), 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10
    index[:, 2] = 4 + np.cumsum(sizes + (sizes & 1) + 8) - (sizes + (sizes & 1) + 8)
    index[:, 3] = sizes
    body = b"AVI " + head + _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames)) + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_index(data: bytes) -> tuple[float, list[tuple[int, int]]]:
    """Frames a second, and (start, end) of the video frames by the file's index, whose offsets count from
    the list of frames or from the start of the file; chunk by chunk where it has none. No frames if the
    data is not such a file or is cut short."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        return 0.0, []
    fps, movi, found = 0.0, None, None
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if kind == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            s = data.find(b"strh", at, at + size)
            while s >= 0 and data[s + 8 : s + 12] != b"vids":
                s = data.find(b"strh", s + 4, at + size)
            if s >= 0 and s + 36 <= len(data):
                scale, rate = struct.unpack_from("<II", data, s + 28)
                fps = rate / scale if scale else 0.0
        elif kind == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = (at + 8, min(at + 8 + size, len(data)))
        elif kind == b"idx1":
            raw = data[at + 8 : at + 8 + size // 16 * 16]
            found = np.frombuffer(raw[: len(raw) // 16 * 16], "<u4").reshape(-1, 4).astype(np.int64)
        at += 8 + size + (size & 1)
    if movi is None:
        return fps, []
    if found is not None:
        video = found[(found[:, 0] >> 16 == 0x6364) | (found[:, 0] >> 16 == 0x6264)]  # ..dc and ..db
        base = movi[0]
        if len(video) and data[base + video[0, 2] :][:4] != int(video[0, 0]).to_bytes(4, "little"):
            base = 0
        starts = base + video[:, 2] + 8
        ends = starts + video[:, 3]
        whole = ends <= movi[1]
        return fps, list(zip(starts[whole].tolist(), ends[whole].tolist(), strict=True))
    out, at = [], movi[0] + 4
    while at + 8 <= movi[1]:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"LIST":  # a group of chunks: its parts come next
            at += 12
            continue
        if data[at + 2 : at + 4] in (b"dc", b"db") and at + 8 + size <= movi[1]:
            out.append((at + 8, at + 8 + size))
        at += 8 + size + (size & 1)
    return fps, out


class FrameTables:
    """What the segments before a frame's samples say. ``ok`` is False for other than baseline JPEG.
    Code tables that a frame leaves out are the usual ones."""

    def __init__(self, header: bytes):
        quant, codes, self.ok, comps, order, at = {}, {}, False, {}, [], 2
        self.blocks = self.per_restart = 0
        while at + 4 <= len(header):
            marker, size = header[at + 1], int.from_bytes(header[at + 2 : at + 4], "big")
            body = header[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    counts, n = body[1:17], sum(body[1:17])
                    codes[body[0]] = self._lookup(canonical_codes(counts, body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xC0:
                h, w = struct.unpack(">HH", body[1:5])
                comps = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
                self.size = (w, h)
            elif marker in (0xC1, 0xC2, 0xC3):
                return
            elif marker == 0xDD:
                self.per_restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                order = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
        if not comps or len(order) != len(comps) or not all(self.size):
            return
        for t in {x for _, dc, ac in order for x in (dc, 16 | ac)} - set(codes):
            if t in USUAL:
                codes[t] = self._lookup(canonical_codes(USUAL[t][0], usual_symbols(t)))
        try:
            one = len(order) == 1
            hmax, vmax = max(c[0] for c in comps.values()), max(c[1] for c in comps.values())
            w, h = self.size
            across, down = -(-w // (8 if one else 8 * hmax)), -(-h // (8 if one else 8 * vmax))
            #: For each block of a unit: component, its steps, DC and AC tables.
            self.plan = [(i, quant[comps[c][2]], codes[dc], codes[16 | ac]) for i, (c, dc, ac) in enumerate(order) for _ in range(1 if one else comps[c][0] * comps[c][1])]
        except KeyError:
            return
        x, y = (1, 1) if one else comps[order[0][0]][:2]
        self.own, self.units = x * y, across * down
        #: Height and width of the first component in blocks and in samples, and where its blocks stand.
        self.grid = (down * y, across * x)
        self.plane = (h, w) if one else (-(-h * y // vmax), -(-w * x // hmax))
        unit, k = np.divmod(np.arange(self.units * self.own), self.own)
        self.places = (unit // across * y + k // x) * self.grid[1] + unit % across * x + k % x
        self.per_restart = min(self.per_restart or self.units, self.units)
        self.ok = len(self.plan[0][1]) == 64

    @staticmethod
    def _lookup(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """For each 16 bits that may come next: symbol and code length (0: none)."""
        symbols, lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for s, (code, n) in codes.items():
            part = slice(code << (16 - n), (code + 1) << (16 - n))
            symbols[part], lengths[part] = s, n
        return symbols, lengths


def _header_end(frame: bytes) -> int:
    """Where the samples of a frame begin; 0 if it is no JPEG."""
    if frame[:2] != b"\xff\xd8":
        return 0
    at = 2
    while at + 4 <= len(frame) and frame[at] == 0xFF:
        end = at + 2 + int.from_bytes(frame[at + 2 : at + 4], "big")
        if frame[at + 1] == 0xDA:
            return end
        at = end
    return 0


def _decode_group(tables: FrameTables, scans: list[bytes], units: int) -> tuple[np.ndarray, list[tuple[np.ndarray, int, np.ndarray, np.ndarray]]]:
    """(levels, coefficients) of ``units`` units of scans that share their tables. Levels are the DC
    coefficients of the first component, dequantised, one row a block; the others are
    (scans, block, places, values), dequantised. Bits that lie beyond the data are 0."""
    n = len(scans)
    sizes = np.fromiter(map(len, scans), np.int64, n) + 8
    b = np.frombuffer(b"".join([s + b"\0" * 8 for s in scans]) + b"\0" * 8, np.uint8)
    five = np.zeros(len(b) - 4, np.int64)  # the 40 bits that begin at each byte
    for k in range(5):
        five = (five << 8) | b[k : len(b) - 4 + k]
    ends = np.cumsum(sizes)
    pos = (ends - sizes) * 8
    stop = (ends - 6) * 8
    out = np.zeros((units * tables.own, n), np.int32)
    pred = np.zeros((len({p[0] for p in tables.plan}), n), np.int64)
    others: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []
    col = 0
    for block in range(units * len(tables.plan)):
        comp, quant, (dc_symbol, dc_length), (ac_symbol, ac_length) = tables.plan[block % len(tables.plan)]
        shift = 24 - (pos & 7)
        word = five[pos >> 3]
        next16 = (word >> shift) & 0xFFFF
        size, length = dc_symbol[next16], dc_length[next16]
        top = np.left_shift(1, size)
        extra = (word >> (shift + 16 - length - size)) & (top - 1)
        pred[comp] += extra - (top - 1) * (extra < (top >> 1))
        pos += np.maximum(length + size, 1)
        np.minimum(pos, stop, out=pos)
        if comp == 0:
            out[col] = pred[0] * quant[0]
            col += 1
        # Coefficients beyond the first. Many blocks have none: one step for all, then only those that have.
        shift = 24 - (pos & 7)
        word = five[pos >> 3]
        next16 = (word >> shift) & 0xFFFF
        symbol, length = ac_symbol[next16], ac_length[next16]
        if not symbol.any():
            pos += np.maximum(length, 1)
            np.minimum(pos, stop, out=pos)
            continue
        todo, k = np.arange(n), np.ones(n, np.int64)
        while len(todo):
            at = pos[todo]
            shift, word = 24 - (at & 7), five[at >> 3]
            next16 = (word >> shift) & 0xFFFF
            symbol, length = ac_symbol[next16], ac_length[next16]
            size, k = symbol & 15, k + (symbol >> 4)
            pos[todo] = np.minimum(at + np.maximum(length + size, 1), stop[todo])
            valued = (size > 0) & (k < 64)
            if comp == 0 and valued.any():
                v = np.flatnonzero(valued)
                top = np.left_shift(1, size[v])
                extra = (word[v] >> (shift[v] + 16 - length[v] - size[v])) & (top - 1)
                others.append((todo[v], col - 1, k[v], (extra - (top - 1) * (extra < (top >> 1))) * quant[k[v]]))
            go = (symbol > 0) & (k < 63)
            todo, k = todo[go], k[go] + 1
    return out, others


#: Marks between stretches that can be decoded on their own.
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


class _Frames:
    """Frames with one set of tables: their stretches are decoded in step, then put together."""

    def __init__(self, tables: FrameTables):
        self.tables, self.n = tables, 0
        self.scans: dict[int, list[tuple[int, int, bytes]]] = {}  # units: (frame, first unit, bits)

    def add(self, scan: bytes) -> int:
        t = self.tables
        if scan.endswith(b"\xff\xd9"):
            scan = scan[:-2]
        parts = _RESTART.split(scan) if t.per_restart < t.units else [scan]
        for k, part in enumerate(parts[: -(-t.units // t.per_restart)]):
            first = k * t.per_restart
            self.scans.setdefault(min(t.per_restart, t.units - first), []).append((self.n, first, part.replace(b"\xff\0", b"\xff")))
        self.n += 1
        return self.n - 1

    def samples(self) -> np.ndarray:
        """One row for each frame: its samples row by row, or the levels of its blocks if all blocks of all
        these frames are flat."""
        t = self.tables
        levels = np.zeros((self.n, t.units * t.own), np.int32)
        rows, blocks, places, values = [], [], [], []
        for units, scans in self.scans.items():
            found, others = _decode_group(t, [x[2] for x in scans], units)
            frame, first = (np.array([x[i] for x in scans]) for i in (0, 1))
            levels[frame[:, None], first[:, None] * t.own + np.arange(units * t.own)] = found.T
            for who, block, place, value in others:
                rows.append(frame[who])
                blocks.append(first[who] * t.own + block)
                places.append(place)
                values.append(value)
        # A flat block has the level of its first coefficient in all samples.
        flat = np.clip((levels + 1028) >> 3, 0, 255).astype(np.uint8)
        order = np.empty_like(t.places)
        order[t.places] = np.arange(len(t.places))
        if not rows:
            return flat[:, order]
        rows, blocks, places, values = (np.concatenate(x) for x in (rows, blocks, places, values))
        which, inverse = np.unique(rows * levels.shape[1] + blocks, return_inverse=True)
        coefficients = np.zeros((len(which), 8, 8))
        coefficients[inverse, ZIGZAG[places, 0], ZIGZAG[places, 1]] = values
        at = np.divmod(which, levels.shape[1])
        coefficients[:, 0, 0] = levels[at]
        whole = np.repeat(flat[:, :, None], 64, axis=2)
        whole[at] = np.clip(np.rint(BASIS.T @ coefficients @ BASIS + 128.0), 0, 255).reshape(-1, 64)
        (high, wide), (h, w) = t.grid, t.plane
        picture = whole[:, order].reshape(self.n, high, wide, 8, 8).swapaxes(2, 3).reshape(self.n, high * 8, wide * 8)
        return np.ascontiguousarray(picture[:, :h, :w]).reshape(self.n, -1)


def decode_files(files: list[bytes | None]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each file its frames a second, the samples of its frames, one row a frame, and the numbers of
    these frames. An empty frame repeats the one before. Frames that are no baseline JPEG are left out;
    so are all of a file whose frames differ in size."""
    known: dict[bytes, FrameTables] = {}
    groups: dict[bytes, _Frames] = {}
    rates: list[float] = []
    wanted: list[list[tuple[int, bytes, int]]] = []  # for each file: frame number, group, row there
    header = b""
    for data in files:
        fps, spans = read_index(data) if data else (0.0, [])
        rates.append(fps)
        wanted.append([])
        for j, (s, e) in enumerate(spans):
            if s == e:
                if wanted[-1]:
                    wanted[-1].append((j, *wanted[-1][-1][1:]))
                continue
            if not header or not data.startswith(header, s):
                header = data[s : s + _header_end(data[s:e])]
                if header and header not in known:
                    known[header] = FrameTables(header)
            if header and known[header].ok:
                g = groups.setdefault(header, _Frames(known[header]))
                wanted[-1].append((j, header, g.add(data[s + len(header) : e])))
    decoded = {h: g.samples() for h, g in groups.items()}
    out = []
    for fps, rows in zip(rates, wanted, strict=True):
        same = len({decoded[h].shape[1] for _, h, _ in rows}) == 1
        if not same:
            out.append((fps, np.zeros((0, 0), np.uint8), np.zeros(0, np.int64)))
            continue
        one = len({h for _, h, _ in rows}) == 1
        samples = decoded[rows[0][1]][[k for _, _, k in rows]] if one else np.stack([decoded[h][k] for _, h, k in rows])
        out.append((fps, samples, np.array([j for j, _, _ in rows])))
    return out


def cuts_of(samples: np.ndarray) -> list[int]:
    """Frames at which a shot begins, 0 included: their histogram differs from the one before by more
    than the recent differences let expect."""
    n = len(samples)
    if not n:
        return []
    step = max(1, (1 << 22) // samples.shape[1])
    parts = [samples[i : i + step] for i in range(0, n, step)]
    hist = np.concatenate([np.bincount((np.arange(len(p))[:, None] * BINS + (p // (256 // BINS))).ravel(), minlength=len(p) * BINS).reshape(-1, BINS) for p in parts])
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * samples.shape[1])
    sums, squares = (np.concatenate(([0.0], np.cumsum(x))) for x in (diff, diff * diff))
    i = np.arange(len(diff))
    lo = np.maximum(0, i - PAST)
    many = np.maximum(i - lo, 1)
    mean = (sums[i] - sums[lo]) / many
    dev = np.sqrt(np.maximum((squares[i] - squares[lo]) / many - mean * mean, 0))
    cuts = [0]
    for f in (np.flatnonzero((diff > mean + FACTOR * dev) & (diff > LEAST)) + 1).tolist():
        if f - cuts[-1] >= GAP:
            cuts.append(f)
    return cuts


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, _n_bytes, _media``: the UTF-8 of each text, padded with blanks to a positive multiple
    of 192, as a motion-JPEG file that stores each byte as the level of one block. A null text is empty."""
    d = docs.select(id_col, F.coalesce(text_col, F.lit("")).cast("binary").alias("_text"))
    schema = d.select(id_col, F.lit(0).cast("long").alias("_n_bytes"), F.lit(b"").alias("_media")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, 1, 2 << 20):
                texts = p.column(1).to_pylist()
                padded = [t.ljust(max(1, -(-len(t) // UNIT)) * UNIT) for t in texts]
                frames = encode_frames(np.frombuffer(b"".join(padded), np.uint8).reshape(-1, UNIT))
                files, at = [], 0
                for t in padded:
                    n = len(t) // UNIT
                    files.append(write_avi(frames[at : at + n]))
                    at += n
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], names=[id_col, "_n_bytes", "_media"])

    return d.mapInArrow(run, schema)


def _decoded(b: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None], list[tuple[float, np.ndarray, np.ndarray]]]]:
    for p in pieces(b, at):
        files = p.column(at).to_pylist()
        yield p, files, decode_files(files)


def clips(media: DataFrame, media_col: str = "_media") -> DataFrame:
    """A row for each shot: the columns of ``media`` but ``media_col``, and ``_clip`` (from 0),
    ``_start_s``, ``_end_s``, ``_frames``, ``_level`` (mean sample).

    Nulls, other data than AVI files of baseline motion-JPEG, and files without whole frames have no
    rows. Repeated rows have equal clips; an empty table gives none. A column that is named like a
    result is replaced. Times go by the numbers of the frames, those left out included.
    """
    keep = [c for c in media.columns if c not in (media_col, "_clip", "_start_s", "_end_s", "_frames", "_level")]
    names = [f"_c{i}" for i in range(len(keep))]
    d = media.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(media_col).alias("_file"))
    more = [("_clip", "int"), ("_start_s", "double"), ("_end_s", "double"), ("_frames", "long"), ("_level", "double")]
    schema = d.drop("_file").selectExpr("*", *(f"cast(null as {t}) as {n}" for n, t in more)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, _, decoded in _decoded(b, len(names)):
                row, cols = [], [[], [], [], [], []]
                for i, (fps, samples, number) in enumerate(decoded):
                    cuts = cuts_of(samples)
                    until = [*number.tolist(), int(number[-1]) + 1] if len(number) else []
                    for k, (s, e) in enumerate(zip(cuts, [*cuts[1:], len(samples)], strict=False)):
                        row.append(i)
                        for c, v in zip(cols, (k, until[s] / (fps or FPS), until[e] / (fps or FPS), e - s, float(samples[s:e].mean())), strict=True):
                            c.append(v)
                take = pa.array(row, pa.int64())
                types = (pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([*(p.column(i).take(take) for i in range(len(names))), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*names, *(n for n, _ in more)])

    return d.mapInArrow(run, schema).toDF(*keep, *(n for n, _ in more))


def describe(media: DataFrame, media_col: str = "_media") -> DataFrame:
    """The columns of ``media`` but ``media_col``, and what the file holds when it is read back:
    ``_payload_bytes``, ``_payload_sha256``, ``_tail_crc32`` (of the last 16 samples), ``_media_bytes``,
    ``_media_sha256`` and ``_feature`` (clips, mean level and a hash of the shot borders).

    Null or unreadable media have no samples: 0 bytes and the hashes of nothing. An empty table stays
    empty; a column that is named like a result is replaced.
    """
    keep = [c for c in media.columns if c not in (media_col, "_payload_bytes", "_payload_sha256", "_tail_crc32", "_media_bytes", "_media_sha256", "_feature")]
    names = [f"_c{i}" for i in range(len(keep))]
    d = media.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(media_col).alias("_file"))
    more = [("_payload_bytes", "long"), ("_payload_sha256", "string"), ("_tail_crc32", "long"), ("_media_bytes", "long"), ("_media_sha256", "string"), ("_feature", "string")]
    schema = d.drop("_file").selectExpr("*", *(f"cast(null as {t}) as {n}" for n, t in more)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, files, decoded in _decoded(b, len(names)):
                cols: list[list] = [[], [], [], [], [], []]
                for f, (fps, samples, _) in zip(files, decoded, strict=True):
                    payload, cuts = samples.tobytes(), cuts_of(samples)
                    level = float(samples.mean()) if len(samples) else 0.0
                    border = zlib.crc32(np.array(cuts, "<u4").tobytes())
                    values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(f or b""), hashlib.sha256(f or b"").hexdigest(), f"clips={len(cuts)};fps={fps:g};level={level:.3f};cuts={border:08x}")
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([*(p.column(i) for i in range(len(names))), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*names, *(n for n, _ in more)])

    return d.mapInArrow(run, schema).toDF(*keep, *(n for n, _ in more))
