"""Luminance of baseline JPEG frames of any coder: quantisation and Huffman tables of the file, restarts, sampling.

Frames without Huffman tables, as motion-JPEG files often hold, use the standard's typical ones. Progressive,
arithmetic, lossless and 12-bit frames and all damage that shows raise ValueError.
"""

from __future__ import annotations

import struct

import numpy as np

ZIGZAG = np.array([y * 8 + x for s in range(15) for y, x in sorted(((y, s - y) for y in range(8) if 0 <= s - y < 8), reverse=s % 2 == 0)])
_k, _x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
DCT = (np.cos((2 * _x + 1) * _k * np.pi / 16) * np.where(_k == 0, np.sqrt(1 / 8), 0.5)).astype(np.float32)

#: Fixed values of the format: codes of each length, and the first symbols, of the typical tables. The symbols not named
#: follow in ascending order.
TYPICAL = {
    (0, 0): ("00 01 05 01 01 01 01 01 01", ""),
    (0, 1): ("00 03 01 01 01 01 01 01 01 01 01", ""),
    (1, 0): ("00 02 01 03 03 02 04 03 05 05 04 04 00 00 01 7d", "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    (1, 1): ("00 02 01 02 04 04 03 04 07 05 04 04 00 01 02 77", "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
}


def codes(lengths: bytes, symbols: bytes) -> list[int]:
    """For each 16-bit prefix the length of its code times 256 plus the symbol; 0 where no code begins so."""
    table = np.zeros(1 << 16, np.int64)
    code, at = 0, 0
    for size, count in enumerate(lengths, 1):
        for _ in range(count):
            if code >> size or at >= len(symbols):
                raise ValueError("a Huffman table overflows")
            table[code << 16 - size : code + 1 << 16 - size] = size << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table.tolist()


def typical_symbols(kind: int, chroma: int) -> tuple[bytes, bytes]:
    """Code lengths and symbols of a typical table; kind 0 is DC, 1 AC."""
    lengths, first = (bytes.fromhex(x) for x in TYPICAL[kind, chroma])
    known = range(12) if kind == 0 else sorted([0, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))])
    return lengths.ljust(16, b"\0"), first + bytes(x for x in known if x not in first)


_typical: dict[tuple[int, int], list[int]] = {}


def _segment_blocks(data: bytes, mcus: int, plan: list[tuple[int, list[int], list[int]]], out: list[list[list[int]]]) -> None:
    """Decodes mcus units of a restart segment; plan: component, DC and AC codes of each block of a unit."""
    acc = have = at = 0
    last = [0] * len(out)
    for _ in range(mcus):
        for component, dc, ac in plan:
            block = [0] * 64
            k = 0
            while k < 64:
                if have < 32:
                    acc = (acc & (1 << have) - 1) << 64 | int.from_bytes(data[at : at + 8].ljust(8, b"\0"), "big")
                    have += 64
                    at += 8
                code = (ac if k else dc)[acc >> have - 16 & 0xFFFF]
                if not code:
                    raise ValueError("an unknown code")
                have -= code >> 8
                symbol = code & 255
                size = symbol & 15 if k else symbol
                if size > 15:
                    raise ValueError("a coefficient out of range")
                value = 0
                if size:
                    have -= size
                    value = acc >> have & (1 << size) - 1
                    if not value >> size - 1:
                        value -= (1 << size) - 1
                if not k:
                    last[component] += value
                    block[0] = last[component]
                    k = 1
                elif size:
                    k += symbol >> 4
                    if k > 63:
                        raise ValueError("a run past its block")
                    block[k] = value
                    k += 1
                elif symbol == 0xF0:
                    k += 16
                else:
                    break
            out[component].append(block)
    if at * 8 - have > len(data) * 8:
        raise ValueError("a scan is cut off")


def _segments(frame: bytes, at: int) -> tuple[list[bytes], int]:
    """Restart segments of the entropy-coded data from a place, without stuffing, and where they end."""
    parts, first = [], at
    while True:
        at = frame.find(b"\xff", at)
        if at < 0 or at + 1 >= len(frame):
            raise ValueError("a scan is cut off")
        marker = frame[at + 1]
        if marker == 0:
            at += 2
        elif marker == 0xFF:
            at += 1
        else:
            parts.append(frame[first:at].replace(b"\xff\0", b"\xff"))
            if not 0xD0 <= marker <= 0xD7:
                return parts, at
            at += 2
            first = at


def luma(frame: bytes) -> np.ndarray:
    """The pixels of the first component, (height, width) of 0 to 255."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    quant: dict[int, np.ndarray] = {}
    huffman: dict[tuple[int, int], list[int]] = {}
    interval, shape, parts = 0, None, []
    at = 2
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise ValueError("no marker")
        marker = frame[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        n = struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + n]
        if n < 2 or len(body) != n - 2:
            raise ValueError("a segment is cut off")
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                if len(body) < 1 + 64 * (1 + wide):
                    raise ValueError("a quantisation table is cut off")
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.float32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                if len(body) < 17 or len(body) < 17 + sum(body[1:17]):
                    raise ValueError("a Huffman table is cut off")
                count = sum(body[1:17])
                huffman[body[0] >> 4, body[0] & 15] = codes(body[1:17], body[17 : 17 + count])
                body = body[17 + count :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body[:2].rjust(2, b"\0"))[0]
        elif marker in (0xC0, 0xC1):
            if len(body) < 6 or body[0] != 8 or len(body) < 6 + 3 * body[5] or not body[5]:
                raise ValueError("a frame header of another kind")
            height, width = struct.unpack_from(">HH", body, 1)
            parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            if not height or not width or any(not 1 <= p[1] <= 4 or not 1 <= p[2] <= 4 for p in parts):
                raise ValueError("a frame without pixels")
            shape = height, width
        elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a baseline frame")
        elif marker == 0xDA:
            if shape is None or len(body) < 1 + 2 * body[0]:
                raise ValueError("a scan without a frame")
            scans, at = _segments(frame, at)
            named = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            if parts[0][0] not in [c[0] for c in named]:
                continue  # a scan of colours alone
            return _pixels(shape, parts, named, scans, interval, quant, huffman)
    raise ValueError("a JPEG frame without a scan")


def _pixels(shape: tuple[int, int], parts: list, named: list, scans: list[bytes], interval: int, quant: dict, huffman: dict) -> np.ndarray:
    def table(kind: int, of: int) -> list[int]:
        if (kind, of) in huffman:
            return huffman[kind, of]
        if huffman or of > 1:
            raise ValueError("a scan without its Huffman table")
        if (kind, of) not in _typical:
            _typical[kind, of] = codes(*typical_symbols(kind, of))
        return _typical[kind, of]

    of = {p[0]: p for p in parts}
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    _, h, v, q = parts[0]
    alone = len(named) == 1
    if alone:  # a unit is a block then, whatever the sampling
        down, across = (-(-(-(-size * own // most)) // 8) for size, own, most in ((shape[0], v, most_v), (shape[1], h, most_h)))
        h = v = 1
    else:
        down, across = -(-shape[0] // (8 * most_v)), -(-shape[1] // (8 * most_h))
    plan, mine = [], 0
    for k, (name, dc, ac) in enumerate(named):
        if name not in of:
            raise ValueError("a scan of an unknown component")
        mine = k if name == parts[0][0] else mine
        plan += [(k, table(0, dc), table(1, ac))] * (1 if alone else of[name][1] * of[name][2])
    out: list[list[list[int]]] = [[] for _ in named]
    left = down * across
    for scan in scans:
        some = min(interval or left, left)
        _segment_blocks(scan, some, plan, out)
        left -= some
    if left:
        raise ValueError("a scan is cut off")
    if q not in quant:
        raise ValueError("a frame without its quantisation table")
    value = np.empty((len(out[mine]), 64), np.float32)
    value[:, ZIGZAG] = np.array(out[mine], np.float32) * quant[q]
    half = (value.reshape(-1, 8) @ DCT).reshape(-1, 8, 8).transpose(0, 2, 1)
    pixel = (half.reshape(-1, 8) @ DCT).reshape(down, across, v, h, 8, 8)  # columns first inside a block
    plane = pixel.transpose(0, 2, 5, 1, 3, 4).reshape(down * v * 8, across * h * 8)
    high, wide = (-(-shape[0] * parts[0][2] // most_v), -(-shape[1] * parts[0][1] // most_h))
    return np.clip(plane[:high, :wide] + 128, 0, 255)
