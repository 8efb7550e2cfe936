"""JPEG (sequential), BMP and GIF: 8-bit samples as arrays of height x width x (1 or 3)."""

from __future__ import annotations

import math
import re
import struct

import numpy as np


class Unsupported(ValueError):
    """A file of a known format that uses something this decoder does not read."""


def _size(w: int, h: int, limit: int) -> None:
    if w <= 0 or h <= 0 or w * h > limit:
        raise ValueError("the image is empty or too large")


# ---------------------------------------------------------------- BMP


def decode_bmp(data: bytes, limit: int) -> np.ndarray:
    """Uncompressed files of 1, 4 or 8 bits with a palette, 24 or 32 bits; rows from below or from above."""
    try:
        start, header, w, h, _, depth, packing = struct.unpack_from("<I", data, 10) + struct.unpack_from("<IiiHHI", data, 14)
    except struct.error as err:
        raise ValueError("the file is damaged") from err
    _size(w, abs(h), limit)
    if header < 40 or len(data) < 54 or depth not in (1, 4, 8, 24, 32) or packing not in ((0, 3) if depth == 32 else (0,)):
        raise Unsupported("this kind of BMP is not read")
    stride = (w * depth + 31) // 32 * 4
    if len(data) < start + stride * abs(h):
        raise ValueError("the file is damaged")
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)
    if depth >= 24:
        px = rows[:, : w * depth // 8].reshape(abs(h), w, depth // 8)[:, :, 2::-1]
    else:
        colors = struct.unpack_from("<I", data, 46)[0] or 1 << depth
        palette = np.zeros((256, 3), np.uint8)
        own = np.frombuffer(data, np.uint8, 4 * min(colors, 256), 14 + header).reshape(-1, 4)
        palette[: len(own)] = own[:, 2::-1]
        bits = np.unpackbits(rows, axis=1).reshape(abs(h), -1, depth)[:, :w]
        px = palette[(bits * (1 << np.arange(depth)[::-1])).sum(axis=2)]
    return px[::-1] if h > 0 else px


# ---------------------------------------------------------------- GIF


def _gif_codes(data: bytes, width: int, n: int) -> bytes:
    """Palette places of n pixels: codes from the low bit up, one code wider once the table is full for a width."""
    clear = 1 << width
    base = [bytes([k]) for k in range(clear)] + [b"", b""]
    table, size, last, out, total = list(base), width + 1, b"", [], 0
    held = bits = 0
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= size:
            code = held & ((1 << size) - 1)
            held >>= size
            bits -= size
            if code == clear:
                table, size, last = list(base), width + 1, b""
                continue
            if code == clear + 1 or total >= n:
                return b"".join(out)
            if code > len(table) or (code == len(table) and not last):
                raise ValueError("the file is damaged")
            entry = table[code] if code < len(table) else last + last[:1]
            out.append(entry)
            total += len(entry)
            if last and len(table) < 4096:
                table.append(last + entry[:1])
                size += len(table) == 1 << size and size < 12
            last = entry
    return b"".join(out)


def decode_gif(data: bytes, limit: int) -> np.ndarray:
    """First picture of a file on its whole canvas, black around it."""
    try:
        w, h, flags = struct.unpack_from("<HHB", data, 6)
        _size(w, h, limit)
        colors = lambda at, f: np.frombuffer(data, np.uint8, 3 << ((f & 7) + 1), at).reshape(-1, 3)
        pos, palette = 13, None
        if flags & 128:
            palette = colors(pos, flags)
            pos += palette.size
        while data[pos] == 33:  # extensions
            pos += 2
            while data[pos]:
                pos += data[pos] + 1
            pos += 1
        if data[pos] != 44:
            raise ValueError("the file holds no picture")
        x, y, pw, ph, own = struct.unpack_from("<HHHHB", data, pos + 1)
        pos += 10
        if own & 128:
            palette = colors(pos, own)
            pos += palette.size
        width, pos, parts = data[pos], pos + 1, []
        while data[pos]:
            parts.append(data[pos + 1 : pos + 1 + data[pos]])
            pos += data[pos] + 1
    except (struct.error, IndexError) as err:
        raise ValueError("the file is damaged") from err
    _size(pw, ph, limit)
    if palette is None or not 2 <= width <= 8:
        raise Unsupported("this kind of GIF is not read")
    flat = np.zeros(pw * ph, np.uint8)
    got = np.frombuffer(_gif_codes(b"".join(parts), width, pw * ph), np.uint8)[: pw * ph]
    flat[: len(got)] = got
    rows = flat.reshape(ph, pw)
    if own & 64:  # interlaced: every eighth row, then those between
        order = np.concatenate([np.arange(a, ph, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
        rows = rows[np.argsort(order)]
    out = np.zeros((h, w, 3), np.uint8)
    seen = palette[np.minimum(rows, len(palette) - 1)][: max(0, h - y), : max(0, w - x)]
    out[y : y + seen.shape[0], x : x + seen.shape[1]] = seen
    return out


# ---------------------------------------------------------------- JPEG

_WAVES = np.array([[math.sqrt((1 if k == 0 else 2) / 8) * math.cos((2 * n + 1) * k * math.pi / 16) for n in range(8)] for k in range(8)])


def _zigzag() -> np.ndarray:
    """Place in the block of each coefficient in the order of the file: diagonals, every other one upwards."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """256 * code length + symbol for every 16 bits that begin with a code; 0 where none does."""
    out = np.zeros(1 << 16, np.int64)
    at = k = 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[k : k + n]:
            span = 1 << (16 - length)
            out[at : at + span] = 256 * length + symbol
            at += span
        k += n
    return out.tolist()


class _Plane:
    """One component: sampling factors, tables, and its coefficients block by block in raster order."""

    def __init__(self, across: int, down: int, table: int) -> None:
        self.across, self.down, self.table = across, down, table
        self.dc: list[int] = []
        self.ac: list[int] = []

    def reserve(self, units_x: int, units_y: int) -> None:
        self.width, self.height = units_x * self.across, units_y * self.down
        self.values = [0] * (64 * self.width * self.height)

    def samples(self, quant: np.ndarray) -> np.ndarray:
        blocks = np.zeros((self.height * self.width, 64))
        blocks[:, _zigzag()] = np.array(self.values, np.int64).reshape(-1, 64) * quant
        own = np.einsum("ki,nkl,lj->nij", _WAVES, blocks.reshape(-1, 8, 8), _WAVES, optimize=True) + 128
        return np.clip(np.rint(own), 0, 255).reshape(self.height, self.width, 8, 8).swapaxes(1, 2).reshape(self.height * 8, self.width * 8)


def _scan(segment: bytes, first: int, last: int, units_x: int, planes: list[_Plane]) -> None:
    """Coefficients of the units from first to last, coded in one segment between restarts."""
    held = bits = pos = 0
    data = segment + bytes(64)
    before = [0] * len(planes)
    for unit in range(first, last):
        uy, ux = divmod(unit, units_x)
        for k, plane in enumerate(planes):
            values, dc, ac = plane.values, plane.dc, plane.ac
            for part in range(plane.across * plane.down):
                v, h = divmod(part, plane.across)
                base = 64 * ((uy * plane.down + v) * plane.width + ux * plane.across + h)
                at = 0
                while at < 64:
                    if bits < 32:
                        held = (held & ((1 << bits) - 1)) << 48 | int.from_bytes(data[pos : pos + 6].ljust(6, b"\0"), "big")
                        bits += 48
                        pos += 6
                    found = (ac if at else dc)[held >> (bits - 16) & 0xFFFF]
                    if not found or pos > len(data) + 64:
                        raise ValueError("the file is damaged")
                    bits -= found >> 8
                    zeros, size = (found >> 4 & 15, found & 15) if at else (0, found & 255)
                    if at and not size:
                        if zeros != 15:
                            break
                        at += 16
                        continue
                    at += zeros
                    value = 0
                    if size:
                        bits -= size
                        value = held >> bits & ((1 << size) - 1)
                        if not value >> (size - 1):
                            value -= (1 << size) - 1
                    if at == 0:
                        before[k] += value
                        value = before[k]
                    if at > 63:
                        raise ValueError("the file is damaged")
                    values[base + at] = value
                    at += 1


def decode_jpeg(data: bytes, limit: int) -> np.ndarray:
    """Sequential Huffman files of 8 bits, gray or three components; progressive and four-colour ones are refused."""
    quants: dict[int, np.ndarray] = {}
    codes: dict[int, list[int]] = {}
    planes: dict[int, _Plane] = {}
    w = h = restart = 0
    adobe: int | None = None
    pos = 2
    try:
        while True:
            while data[pos] != 255 or data[pos + 1] in (0, 255):
                pos += 1
            mark = data[pos + 1]
            pos += 2
            if mark == 0xD9:
                raise ValueError("the file holds no picture")
            n = struct.unpack_from(">H", data, pos)[0]
            body = data[pos + 2 : pos + n]
            pos += n
            if mark == 0xDB:
                while body:
                    wide, own = body[0] >> 4, body[0] & 15
                    size = 128 if wide else 64
                    quants[own] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[1 + size :]
            elif mark == 0xC4:
                while body:
                    total = sum(body[1:17])
                    codes[body[0]] = _lookup(body[1:17], body[17 : 17 + total])
                    body = body[17 + total :]
            elif mark in (0xC0, 0xC1):
                if body[0] != 8 or body[5] not in (1, 3):
                    raise Unsupported("this kind of JPEG is not read")
                h, w = struct.unpack_from(">HH", body, 1)
                _size(w, h, limit)
                planes = {body[6 + 3 * k]: _Plane(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])}
            elif 0xC0 <= mark <= 0xCF:
                raise Unsupported("progressive or arithmetic JPEG is not read")
            elif mark == 0xDD:
                restart = struct.unpack(">H", body[:2])[0]
            elif mark == 0xEE and body[:5] == b"Adobe":
                adobe = body[11]
            elif mark == 0xDA:
                break
        if not planes or body[0] != len(planes):
            raise Unsupported("this kind of JPEG is not read")
        for k in range(body[0]):
            plane = planes[body[1 + 2 * k]]
            plane.dc, plane.ac = codes[body[2 + 2 * k] >> 4], codes[16 + (body[2 + 2 * k] & 15)]
    except (IndexError, struct.error, KeyError) as err:
        raise ValueError("the file is damaged") from err
    own = list(planes.values())
    if len(own) == 1:
        own[0].across = own[0].down = 1
    if not all(1 <= p.across <= 4 and 1 <= p.down <= 4 and p.table in quants for p in own):
        raise ValueError("the file is damaged")
    wide, tall = max(p.across for p in own), max(p.down for p in own)
    units_x, units_y = -(-w // (8 * wide)), -(-h // (8 * tall))
    for plane in own:
        plane.reserve(units_x, units_y)
    stop = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]").search(data, pos)
    segments = re.split(rb"\xff+[\xd0-\xd7]", data[pos : stop.start() if stop else len(data)])
    step = restart or units_x * units_y
    for k, segment in enumerate(segments):
        if k * step < units_x * units_y:
            _scan(segment.replace(b"\xff\x00", b"\xff"), k * step, min((k + 1) * step, units_x * units_y), units_x, own)
    full = [np.repeat(np.repeat(p.samples(quants[p.table]), tall // p.down, axis=0), wide // p.across, axis=1)[:h, :w] for p in own]
    if len(full) == 1:
        return full[0][:, :, None].astype(np.uint8)
    if adobe == 0:
        return np.stack(full, axis=2).astype(np.uint8)
    y, cb, cr = full[0], full[1] - 128, full[2] - 128
    return np.clip(np.rint(np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), axis=2)), 0, 255).astype(np.uint8)
