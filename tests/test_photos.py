"""JPEG, BMP and GIF against files that are put together here."""

import math
import struct

import numpy as np
import pytest

from pixelgrain.sources import codecs, photos

RNG = np.random.default_rng(5)


def bmp(px, depth, palette=None, upwards=True):
    h, w = px.shape[:2]
    if depth >= 24:
        rows = px[:, :, ::-1] if depth == 24 else np.concatenate((px[:, :, ::-1], np.zeros((h, w, 1), np.uint8)), axis=2)
        rows = rows.reshape(h, -1)
    else:
        bits = (px[:, :, None] >> np.arange(depth)[::-1]) & 1
        rows = np.packbits(bits.reshape(h, -1).astype(np.uint8), axis=1)
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
    table = b"" if palette is None else np.pad(palette[:, ::-1], ((0, 0), (0, 1))).astype(np.uint8).tobytes()
    body = (rows[::-1] if upwards else rows).astype(np.uint8).tobytes()
    start = 54 + len(table)
    return b"BM" + struct.pack("<IHHI", start + len(body), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h if upwards else -h, 1, depth, 0, len(body), 0, 0, 0 if palette is None else len(palette), 0) + table + body


@pytest.mark.parametrize("depth", [1, 4, 8, 24, 32])
@pytest.mark.parametrize("upwards", [True, False])
def test_bmp(depth, upwards):
    if depth >= 24:
        px = RNG.integers(0, 256, (5, 7, 3)).astype(np.uint8)
        assert (photos.decode_bmp(bmp(px, depth, upwards=upwards), 1000) == px).all()
        return
    palette = RNG.integers(0, 256, (1 << depth, 3)).astype(np.uint8)
    px = RNG.integers(0, 1 << depth, (5, 7))
    assert (photos.decode_bmp(bmp(px, depth, palette, upwards), 1000) == palette[px]).all()


def gif_codes(values, width):
    """Codes of growing width, a phrase of the table for each, as bytes from the low bit up."""
    clear, bits, held = 1 << width, [], ()

    def put(code, size):
        bits.extend((code >> k) & 1 for k in range(size))

    def fresh():
        return {(k,): k for k in range(clear)}, clear + 2, width + 1

    table, after, size = fresh()
    put(clear, size)
    for v in values:
        if (*held, v) in table:
            held = (*held, v)
            continue
        put(table[held], size)
        table[(*held, v)] = after
        size += after == 1 << size and size < 12
        after += 1
        held = (v,)
        if after == 4096:
            put(table[held], size)
            put(clear, size)
            table, after, size = fresh()
            held = ()
    if held:
        put(table[held], size)
    put(clear + 1, size)
    return np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()


def gif(places, palette, canvas, corner=(0, 0), interlaced=False, own=False):
    h, w = places.shape
    rows = places[np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])] if interlaced else places
    width = max(2, (len(palette) - 1).bit_length())
    flag, table = 128 | (width - 1), palette.tobytes()
    data = gif_codes(rows.ravel().tolist(), width)
    parts = b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255))
    head = b"GIF89a" + struct.pack("<HHBBB", canvas[1], canvas[0], 0 if own else flag, 0, 0) + (b"" if own else table)
    place = struct.pack("<HHHHB", corner[1], corner[0], w, h, (64 if interlaced else 0) | (flag if own else 0))
    return head + b"\x21\xfe\x03abc\0" + b"," + place + (table if own else b"") + bytes([width]) + parts + b"\0;"


@pytest.mark.parametrize("interlaced", [True, False])
@pytest.mark.parametrize("own", [True, False])
def test_gif(interlaced, own):
    palette = RNG.integers(0, 256, (16, 3)).astype(np.uint8)
    places = RNG.integers(0, 16, (90, 120))
    places[20:60] = 3
    want = np.zeros((95, 130, 3), np.uint8)
    want[4:94, 7:127] = palette[places]
    assert (photos.decode_gif(gif(places, palette, (95, 130), (4, 7), interlaced, own), 20000) == want).all()


def spectrum(block):
    waves = np.array([[math.sqrt((1 if k == 0 else 2) / 8) * math.cos((2 * n + 1) * k * math.pi / 16) for n in range(8)] for k in range(8)])
    return waves @ (block - 128.0) @ waves.T


def zigzag():
    r, c, out = 0, 0, []
    for _ in range(64):
        out.append((r, c))
        if (r + c) % 2 == 0:
            r, c = (r + 1, c) if c == 7 else (r, c + 1) if r == 0 else (r - 1, c + 1)
        else:
            r, c = (r, c + 1) if r == 7 else (r + 1, c) if c == 0 else (r + 1, c - 1)
    return out


def jpeg(planes, size, factors, restart=0, mark=0xC0, adobe=None):
    """planes: samples of whole units; every table has steps of 1; codes of 4 and 8 bits in order of symbols."""
    h, w = size
    wide, tall = max(f[0] for f in factors), max(f[1] for f in factors)
    units_x, units_y = -(-w // (8 * wide)), -(-h // (8 * tall))
    ac = [0x00, 0xF0, *(16 * z + s for z in range(16) for s in range(1, 11))]
    bits, out = [], bytearray()

    def put(value, n):
        bits.extend((value >> k) & 1 for k in range(n - 1, -1, -1))

    def flush():
        bits.extend([1] * (-len(bits) % 8))
        out.extend(np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\0"))
        bits.clear()

    def number(v):
        size_ = abs(v).bit_length()
        return size_, v if v > 0 else v + (1 << size_) - 1

    before = [0] * len(planes)
    for unit in range(units_x * units_y):
        if restart and unit and unit % restart == 0:
            flush()
            out.extend([0xFF, 0xD0 + (unit // restart - 1) % 8])
            before = [0] * len(planes)
        uy, ux = divmod(unit, units_x)
        for k, (plane, (across, down)) in enumerate(zip(planes, factors, strict=True)):
            for v in range(down):
                for x in range(across):
                    y0, x0 = 8 * (uy * down + v), 8 * (ux * across + x)
                    coded = np.rint(spectrum(plane[y0 : y0 + 8, x0 : x0 + 8])).astype(int)
                    line = [int(coded[p]) for p in zigzag()]
                    n, own = number(line[0] - before[k])
                    before[k] = line[0]
                    put(n, 4)
                    put(own, n)
                    zeros = 0
                    for c in line[1:]:
                        if c == 0:
                            zeros += 1
                            continue
                        while zeros > 15:
                            put(ac.index(0xF0), 8)
                            zeros -= 16
                        n, own = number(c)
                        put(ac.index(16 * zeros + n), 8)
                        put(own, n)
                        zeros = 0
                    if zeros:
                        put(0, 8)
    flush()

    def segment(kind, body):
        return bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body

    n = len(planes)
    head = b"\xff\xd8" + (b"" if adobe is None else segment(0xEE, b"Adobe" + struct.pack(">HHHB", 100, 0, 0, adobe))) + segment(0xDB, b"\0" + b"\1" * 64)
    head += segment(mark, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([k + 1, 16 * f[0] + f[1], 0]) for k, f in enumerate(factors)))
    head += segment(0xC4, bytes([0, 0, 0, 0, 12] + [0] * 12) + bytes(range(12))) + segment(0xC4, bytes([16] + [0] * 7 + [len(ac)] + [0] * 8) + bytes(ac))
    head += segment(0xDD, struct.pack(">H", restart)) if restart else b""
    return head + segment(0xDA, bytes([n]) + b"".join(bytes([k + 1, 0]) for k in range(n)) + b"\0\x3f\0") + bytes(out) + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 2])
def test_jpeg_gray(restart):
    px = RNG.integers(0, 256, (24, 40)).astype(float)
    got = photos.decode_jpeg(jpeg([px], (19, 37), [(1, 1)], restart), 10000)
    assert got.shape == (19, 37, 1) and np.abs(got[:, :, 0] - px[:19, :37]).max() <= 2


@pytest.mark.parametrize("factors", [(1, 1), (2, 1), (2, 2)])
def test_jpeg_colour(factors):
    across, down = factors
    h, w = 16 * down, 24 * across
    luma, cb, cr = RNG.integers(60, 190, (h, w)).astype(float), RNG.integers(118, 139, (16, 24)).astype(float), RNG.integers(118, 139, (16, 24)).astype(float)
    size = (h - 3, w - 5)
    got = photos.decode_jpeg(jpeg([luma, cb, cr], size, [factors, (1, 1), (1, 1)]), 10000)
    b, r = (np.repeat(np.repeat(p, down, 0), across, 1) - 128 for p in (cb, cr))
    want = np.stack((luma + 1.402 * r, luma - 0.344136 * b - 0.714136 * r, luma + 1.772 * b), axis=2)
    assert got.shape == (*size, 3) and np.abs(got - np.clip(want, 0, 255)[: size[0], : size[1]]).max() <= 4


def test_jpeg_stored_as_rgb():
    px = [RNG.integers(0, 256, (8, 8)).astype(float) for _ in range(3)]
    got = photos.decode_jpeg(jpeg(px, (8, 8), [(1, 1)] * 3, adobe=0), 100)
    assert np.abs(got - np.stack(px, axis=2)).max() <= 2


def test_refused_and_damaged():
    px = np.full((8, 8), 90.0)
    with pytest.raises(codecs.Unsupported):
        photos.decode_jpeg(jpeg([px], (8, 8), [(1, 1)], mark=0xC2), 100)
    with pytest.raises(ValueError, match="too large"):
        photos.decode_jpeg(jpeg([px], (8, 8), [(1, 1)]), 60)
    palette = np.zeros((4, 3), np.uint8)
    whole = {"bmp": bmp(np.zeros((4, 4), int), 8, np.zeros((256, 3), np.uint8)), "gif": gif(np.zeros((4, 4), int), palette, (4, 4)), "jpeg": jpeg([px], (8, 8), [(1, 1)])}
    for data in whole.values():
        image, scale = codecs.decode(data)
        assert image.data.shape[2] == 1 and scale is None
        for cut in (4, 20, 30):
            with pytest.raises(ValueError):
                codecs.decode(data[:cut])
