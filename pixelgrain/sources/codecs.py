"""PNG, TIFF and DICOM decoding to rasters with numpy and zlib, photos by their own module, and a PNG encoder."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..operators.measure import Calibration
from ..plans.arrays import Raster
from . import photos
from .photos import Unsupported

MAX_PIXELS = 120_000_000
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def is_png(data: bytes) -> bool:
    return data[:8] == PNG_MAGIC


def is_tiff(data: bytes) -> bool:
    return data[:4] in (b"II*\0", b"MM\0*")


def is_dicom(data: bytes, name: str = "") -> bool:
    return data[128:132] == b"DICM" or name.lower().endswith((".dcm", ".dicom"))


def _checked(w: int, h: int, limit: int) -> None:
    if w <= 0 or h <= 0:
        raise ValueError("the image is empty")
    if w * h > limit:
        raise ValueError("the image is too large")


def gray_if_neutral(image: Raster) -> Raster:
    """A colour image whose channels agree everywhere becomes gray."""
    d = image.data
    if image.is_color and (d[:, :, 0] == d[:, :, 1]).all() and (d[:, :, 1] == d[:, :, 2]).all():
        return image.put(d[:, :, 0], clamp=False)
    return image


def from_rgba(data: bytes, w: int, h: int) -> Raster:
    """8-bit RGBA samples; alpha is dropped."""
    if len(data) != 4 * w * h:
        raise ValueError("the data does not fit the size")
    return gray_if_neutral(Raster.of(np.frombuffer(data, np.uint8).reshape(h, w, 4)[:, :, :3]))


def _unfilter(raw: bytes, h: int, stride: int, step: int) -> np.ndarray:
    """Rows of a PNG without their filters: none, left, up, mean of both, Paeth's predictor."""
    out = np.zeros((h + 1, stride), np.uint8)
    rows = np.frombuffer(raw, np.uint8, h * (stride + 1)).reshape(h, stride + 1)
    for y in range(h):
        kind, line, up = int(rows[y, 0]), rows[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 2:
            out[y + 1] = line + up
        elif kind == 1:
            pad = np.zeros(-(-stride // step) * step, np.uint8)
            pad[:stride] = line
            out[y + 1] = np.cumsum(pad.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind in (3, 4):
            now, above, src = [0] * (stride + step), [0] * step + up.tolist(), line.tolist()
            for i in range(stride):
                a, b = now[i], above[i + step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = above[i]
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                now[i + step] = (src[i] + guess) & 255
            out[y + 1] = now[step:]
        else:
            raise ValueError("unknown row filter")
    return out[1:]


def decode_png(data: bytes, limit: int = MAX_PIXELS) -> Raster | None:
    """All colour types and depths; None for interlaced files. Alpha is dropped, checksums are not verified."""
    pos, packed, palette, head = 8, [], None, None
    while pos + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[pos : pos + 8])
        body = data[pos + 8 : pos + 8 + n]
        pos += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    if head is None or not packed:
        raise ValueError("the file is damaged")
    w, h, depth, color, _, _, interlaced = head
    if interlaced:
        return None
    _checked(w, h, limit)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if channels is None:
        raise ValueError("unknown colour type")
    stride = (w * channels * depth + 7) // 8
    try:
        raw = zlib.decompress(b"".join(packed))
        rows = _unfilter(raw, h, stride, max(1, channels * depth // 8))
    except (zlib.error, ValueError) as e:
        raise ValueError("the file is damaged") from e
    if depth == 16:
        px = rows.copy().view(">u2").astype(np.float32).reshape(h, w, channels)
    elif depth == 8:
        px = rows[:, : w * channels].reshape(h, w, channels)
    else:
        bits = np.unpackbits(rows, axis=1)[:, : w * depth].reshape(h, w, depth)
        px = (bits @ (1 << np.arange(depth - 1, -1, -1)))[:, :, None]
        if color == 0:
            px = px * (255 // ((1 << depth) - 1))
    if color == 3:
        if palette is None:
            raise ValueError("the palette is missing")
        px = palette[np.minimum(px[:, :, 0], len(palette) - 1)]
    px = px[:, :, :3] if px.shape[2] >= 3 else px[:, :, :1]
    return gray_if_neutral(Raster.of(px, 0, 65535 if depth == 16 else 255))


def encode_png(samples: np.ndarray) -> bytes:
    """8-bit gray or RGB samples as a PNG."""
    a = np.asarray(samples, np.uint8)
    a = a if a.ndim == 3 else a[:, :, None]
    h, w, ch = a.shape
    raw = np.concatenate((np.zeros((h, 1), np.uint8), a.reshape(h, w * ch)), axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if ch == 1 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes from the high bit down, one code wider just before a width is full."""
    clear, stop = 256, 257
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, previous, out = list(base), 9, b"", []
    held, bits = 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == stop:
            break
        if code == clear:
            table, width, previous = list(base), 9, b""
            continue
        entry = table[code] if code < len(table) else previous + previous[:1]
        if not entry:
            raise ValueError("the file is damaged")
        out.append(entry)
        if previous:
            table.append(previous + entry[:1])
        previous = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


_TIFF_SIZES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 16: (8, "Q")}


def decode_tiff(data: bytes, limit: int = MAX_PIXELS) -> Raster:
    """First directory, strips, both byte orders; none, LZW, deflate or PackBits; 8 and 16 bits or 32-bit floats."""
    e = "<" if data[:2] == b"II" else ">"
    read = lambda fmt, at: struct.unpack_from(e + fmt, data, at)
    try:
        (at,) = read("I", 4)
        (count,) = read("H", at)
        tags: dict[int, list[int]] = {}
        for k in range(count):
            tag, kind, n = read("HHI", at + 2 + 12 * k)
            if kind not in _TIFF_SIZES or kind == 2:
                continue
            size, letter = _TIFF_SIZES[kind]
            place = at + 10 + 12 * k if size * n <= 4 else read("I", at + 10 + 12 * k)[0]
            tags[tag] = list(read(f"{n}{letter}", place))
    except struct.error as err:
        raise ValueError("the file is damaged") from err
    one = lambda tag, default: tags.get(tag, [default])[0]
    w, h, depth, packing, photo, samples = one(256, 0), one(257, 0), one(258, 1), one(259, 1), one(262, 1), one(277, 1)
    form, predictor, per_strip = one(339, 1), one(317, 1), one(278, 1 << 31)
    _checked(w, h, limit)
    if 322 in tags or 324 in tags or (one(284, 1) != 1 and samples > 1):
        raise Unsupported("tiles and separate planes are not read")
    if photo not in (0, 1, 2) or samples > 4 or not ((form in (1, 2) and depth in (8, 16)) or (form == 3 and depth == 32)):
        raise Unsupported("this kind of TIFF is not read")
    unpack = {1: bytes, 5: lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}.get(packing)
    if unpack is None:
        raise Unsupported("this compression is not read")
    kind = np.dtype({8: "u1", 16: "u2", 32: "f4"}[depth] if form != 2 else {8: "i1", 16: "i2"}[depth]).newbyteorder(e)
    parts = []
    try:
        for k, (start, n) in enumerate(zip(tags[273], tags[279], strict=True)):
            rows = min(per_strip, h - k * per_strip)
            body = unpack(data[start : start + n])
            part = np.frombuffer(body, kind, rows * w * samples).reshape(rows, w, samples)
            if predictor == 2 and form != 3:
                part = np.cumsum(part, axis=1, dtype=part.dtype.newbyteorder("="))
            elif predictor not in (1, 2):
                raise Unsupported("this predictor is not read")
            parts.append(part)
    except (KeyError, zlib.error, IndexError) as err:
        raise ValueError("the file is damaged") from err
    px = np.concatenate(parts).astype(np.float32)
    px = px[:, :, :3] if samples >= 3 and photo == 2 else px[:, :, :1]
    if form == 3:
        good = px[np.isfinite(px)]
        lo, hi = (float(good.min()), float(good.max())) if good.size else (0.0, 1.0)
        px = np.where(np.isfinite(px), px, lo)
        hi = hi if hi > lo else lo + 1
    else:
        lo, hi = (0.0, float(2**depth - 1)) if form == 1 else (-float(2 ** (depth - 1)), float(2 ** (depth - 1) - 1))
    if photo == 0:
        px = lo + hi - px
    return gray_if_neutral(Raster.of(px, lo, hi))


_LONG = {b"OB", b"OW", b"OF", b"OD", b"OL", b"SQ", b"UC", b"UR", b"UT", b"UN"}


_OPEN = 0xFFFFFFFF
_ITEM, _ITEM_END, _LIST_END = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)


def _element(data: bytes, pos: int, explicit: bool) -> tuple[tuple[int, int], bytes, int, int]:
    """(tag, kind, length, place of the value) of the element at pos; items and their ends have no kind."""
    tag = struct.unpack_from("<HH", data, pos)
    if tag[0] == 0xFFFE or not explicit:
        return tag, b"", struct.unpack_from("<I", data, pos + 4)[0], pos + 8
    kind = data[pos + 4 : pos + 6]
    if kind in _LONG:
        return tag, kind, struct.unpack_from("<I", data, pos + 8)[0], pos + 12
    return tag, kind, struct.unpack_from("<H", data, pos + 6)[0], pos + 8


def _after_list(data: bytes, pos: int, explicit: bool) -> int:
    """Place behind a list of open length whose first item is at pos; lists inside it may be open too."""
    levels = [_LIST_END]  # the end that each open level waits for
    while levels:
        tag, kind, n, pos = _element(data, pos, explicit)
        if tag == levels[-1]:
            levels.pop()
        elif n != _OPEN:
            pos += n
        else:
            levels.append(_ITEM_END if tag == _ITEM else _LIST_END)
    return pos


def _full_range_rgb(px: np.ndarray) -> np.ndarray:
    """RGB of luma and two colour differences around 128."""
    y, cb, cr = (px[:, :, k].astype(np.float32) for k in range(3))
    cb, cr = cb - 128, cr - 128
    return np.clip(np.rint(np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), axis=2)), 0, 255)


def decode_dicom(data: bytes, limit: int = MAX_PIXELS) -> tuple[Raster, Calibration | None]:
    """First frame of an uncompressed little-endian file: rescaled values, pixel spacing in mm. Only the image's own
    fields are read, nothing about a patient; lists are passed over. Colour is 8 bits and isn't rescaled."""
    pos = 132 if data[128:132] == b"DICM" else 0
    fields: dict[tuple[int, int], bytes] = {}
    explicit = True
    try:
        while pos + 8 <= len(data):
            group, element = struct.unpack_from("<HH", data, pos)
            if group != 2 and (2, 0x10) in fields:
                explicit = fields[2, 0x10].rstrip(b"\0 ") != b"1.2.840.10008.1.2"
            tag, kind, n, start = _element(data, pos, explicit or group == 2)
            if n == _OPEN:
                if tag == (0x7FE0, 0x10):
                    raise Unsupported("compressed DICOM is not read")
                pos = _after_list(data, start, explicit and kind != b"UN")
                continue
            if kind != b"SQ":
                fields[tag] = data[start : start + n]
            pos = start + n
            if tag == (0x7FE0, 0x10):
                break
    except struct.error as err:
        raise ValueError("the file is damaged") from err
    syntax = fields.get((2, 0x10), b"1.2.840.10008.1.2.1").rstrip(b"\0 ")
    if syntax not in (b"1.2.840.10008.1.2", b"1.2.840.10008.1.2.1"):
        raise Unsupported("compressed DICOM is not read")
    number = lambda tag, default: struct.unpack("<H", fields[tag][:2])[0] if tag in fields else default
    text = lambda tag: [v for v in fields.get(tag, b"").decode("latin-1").strip(" \0").split("\\") if v.strip()]
    h, w = number((0x28, 0x10), 0), number((0x28, 0x11), 0)
    _checked(w, h, limit)
    samples, depth, stored, signed = number((0x28, 2), 1), number((0x28, 0x100), 16), number((0x28, 0x101), 16), number((0x28, 0x103), 0)
    photo = (text((0x28, 4)) or [""])[0].strip()
    if depth not in (8, 16) or not 0 < stored <= depth or samples not in (1, 3) or (0x7FE0, 0x10) not in fields or (samples == 3 and (depth != 8 or photo not in ("RGB", "YBR_FULL"))):
        raise Unsupported("this kind of DICOM is not read")
    kind = np.dtype(f"<u{depth // 8}")
    if len(fields[0x7FE0, 0x10]) < w * h * samples * kind.itemsize:
        raise ValueError("the file is damaged")
    raw = np.frombuffer(fields[0x7FE0, 0x10], kind, w * h * samples)
    if samples == 3:
        px = raw.reshape(h, w, 3) if number((0x28, 6), 0) == 0 else np.moveaxis(raw.reshape(3, h, w), 0, 2)
        image = Raster.of(_full_range_rgb(px) if photo == "YBR_FULL" else px.astype(np.float32))
    else:
        px = (raw & ((1 << stored) - 1)).astype(np.float32).reshape(h, w, 1)
        if signed:
            px = np.where(px >= 2.0 ** (stored - 1), px - 2.0**stored, px)
        slope = float((text((0x28, 0x1053)) or ["1"])[0]) or 1.0
        shift = float((text((0x28, 0x1052)) or ["0"])[0])
        lo, hi = (-(2.0 ** (stored - 1)), 2.0 ** (stored - 1) - 1) if signed else (0.0, 2.0**stored - 1)
        lo, hi = sorted((lo * slope + shift, hi * slope + shift))
        px = px * slope + shift
        image = Raster.of(lo + hi - px if photo == "MONOCHROME1" else px, lo, hi)
    spacing = [float(v) for v in text((0x28, 0x30)) or text((0x18, 0x1164))]
    square = len(spacing) == 2 and min(spacing) > 0 and abs(spacing[0] - spacing[1]) < 0.01 * max(spacing)
    return image, Calibration(spacing[1], "mm") if square else None


def decode(data: bytes, name: str = "") -> tuple[Raster, Calibration | None] | None:
    """DICOM, TIFF, PNG, JPEG, BMP or GIF by magic bytes; None for anything else."""
    if is_dicom(data, name):
        return decode_dicom(data)
    if is_tiff(data):
        return decode_tiff(data), None
    if is_png(data):
        image = decode_png(data)
        return None if image is None else (image, None)
    for magic, read in ((b"\xff\xd8\xff", photos.decode_jpeg), (b"BM", photos.decode_bmp), (b"GIF8", photos.decode_gif)):
        if data.startswith(magic):
            px = read(data, MAX_PIXELS)
            return gray_if_neutral(Raster.of(px)), None
    return None


def describe(image: Raster, kind: str) -> str:
    w, h = image.size
    return f"{kind} {w}×{h} {'colour' if image.is_color else 'gray'} {'8' if image.eight_bit else '16' if (image.lo, image.hi) == (0, 65535) else 'other '}bit"
