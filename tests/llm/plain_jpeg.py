"""A plain baseline JPEG writer and AVI writer, sample by sample, for files that the operator did not write."""

from __future__ import annotations

import math
import struct

import numpy as np

DC = {0: ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), list(range(12))), 1: ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), list(range(12)))}


def codes(counts, symbols):
    out, code, it = {}, 0, iter(symbols)
    for n, many in enumerate(counts, 1):
        for _ in range(many):
            out[next(it)] = format(code, f"0{n}b")
            code += 1
        code *= 2
    return out


def zigzag():
    out, r, c, up = [], 0, 0, True
    for _ in range(64):
        out.append((r, c))
        if up:
            if c == 7:
                r, up = r + 1, False
            elif r == 0:
                c, up = c + 1, False
            else:
                r, c = r - 1, c + 1
        elif r == 7:
            c, up = c + 1, True
        elif c == 0:
            r, up = r + 1, True
        else:
            r, c = r + 1, c - 1
    return out


def transform(block):
    c = lambda k: math.sqrt(0.5) if k == 0 else 1.0
    cos = [[math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)]
    return [[0.25 * c(u) * c(v) * sum((float(block[x][y]) - 128) * cos[u][x] * cos[v][y] for x in range(8) for y in range(8)) for v in range(8)] for u in range(8)]


def bits_of(v):
    n = abs(v).bit_length()
    return n, (format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else "")


def write(planes, sampling, ac, quant=1, restart=0, tables=True):
    """``planes``: arrays of the components at their own size; ``ac``: (counts, symbols) for tables 0 and 1."""
    h, w = planes[0].shape
    steps = [[quant + (r + c) // 4 for c in range(8)] for r in range(8)]
    order, dc_codes, ac_codes = zigzag(), [codes(*DC[t]) for t in (0, 1)], [codes(*a) for a in ac]
    hmax, vmax = max(s[0] for s in sampling), max(s[1] for s in sampling)
    one = len(planes) == 1
    across, down = -(-w // (8 * (1 if one else hmax))), -(-h // (8 * (1 if one else vmax)))
    out, pred, text, count = b"", [0] * len(planes), "", 0

    def flush(text):
        text += "1" * (-len(text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")

    for my in range(down):
        for mx in range(across):
            if restart and count and count % restart == 0:
                out += flush(text) + bytes([0xFF, 0xD0 + (count // restart - 1) % 8])
                text, pred = "", [0] * len(planes)
            count += 1
            for k, (plane, (sx, sy)) in enumerate(zip(planes, sampling, strict=True)):
                sx, sy = (1, 1) if one else (sx, sy)
                padded = np.pad(plane, ((0, 64), (0, 64)), mode="edge")
                for by in range(sy):
                    for bx in range(sx):
                        y, x = (my * sy + by) * 8, (mx * sx + bx) * 8
                        f = transform(padded[y : y + 8, x : x + 8])
                        z = [round(f[r][c] / steps[r][c]) for r, c in order]
                        t = min(k, 1)
                        n, b = bits_of(z[0] - pred[k])
                        pred[k] = z[0]
                        text += dc_codes[t][n] + b
                        run = 0
                        last = max((i for i in range(1, 64) if z[i]), default=0)
                        for i in range(1, last + 1):
                            if not z[i]:
                                run += 1
                                continue
                            while run > 15:
                                text += ac_codes[t][0xF0]
                                run -= 16
                            n, b = bits_of(z[i])
                            text += ac_codes[t][run << 4 | n] + b
                            run = 0
                        if last < 63:
                            text += ac_codes[t][0x00]
    out += flush(text)
    seg = lambda m, body: struct.pack(">BBH", 0xFF, m, len(body) + 2) + body
    head = b"\xff\xd8" + seg(0xE0, b"AVI1\0\0") + seg(0xDB, b"\0" + bytes(steps[r][c] for r, c in order))
    if restart:
        head += seg(0xDD, struct.pack(">H", restart))
    head += seg(0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([k + 1, s[0] << 4 | s[1], 0]) for k, s in enumerate(sampling)))
    if tables:
        for t in range(min(2, len(planes))):
            head += seg(0xC4, bytes([t, *DC[t][0], *DC[t][1]])) + seg(0xC4, bytes([0x10 | t, *ac[t][0], *ac[t][1]]))
    head += seg(0xDA, bytes([len(planes)]) + b"".join(bytes([k + 1, min(k, 1) * 0x11]) for k in range(len(planes))) + bytes([0, 63, 0]))
    return head + out + b"\xff\xd9"


def avi(frames, fps=10, absolute=False, index=True, grouped=False):
    chunk = lambda k, b: k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1)
    sound = chunk(b"LIST", b"strl" + chunk(b"strh", b"auds" + b"\0" * 52))
    video = chunk(b"LIST", b"strl" + chunk(b"strh", b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), 0, 0, 0, 0, 0, 0, 0)))
    head = b"AVI " + chunk(b"LIST", b"hdrl" + sound + video)
    body, at = b"movi", []
    for f in frames:
        if grouped:
            body += b"LIST" + struct.pack("<I", 4 + 8 + len(f) + (len(f) & 1)) + b"rec "
        at.append(len(body))
        body += chunk(b"01dc", f)
    base = 8 + len(head) + 8 if absolute else 0
    idx = b"".join(struct.pack("<4sIII", b"01dc", 16, base + a, len(f)) for a, f in zip(at, frames, strict=True))
    whole = head + chunk(b"LIST", body) + (chunk(b"idx1", idx) if index else b"")
    return b"RIFF" + struct.pack("<I", len(whole)) + whole
