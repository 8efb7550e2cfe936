"""The steps on one image as numpy arrays: what an executor runs for each row of an images table."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np

from .. import kernels
from ..functions.expressions import LUMA, MAX_DENSITY, NOISE_PRIME, STAIN_ORDER, noise_state, stain_weights
from ..operators.filters import box_radii, gaussian_weights


@dataclass(frozen=True)
class Raster:
    """float32 samples, height x width x channels (1 or 3), and the nominal range, which is metadata."""

    data: np.ndarray
    lo: float = 0.0
    hi: float = 255.0

    @classmethod
    def of(cls, data: np.ndarray, lo: float = 0.0, hi: float = 255.0) -> Raster:
        data = np.asarray(data, np.float32)
        if data.ndim == 2:
            data = data[:, :, None]
        if data.ndim != 3 or data.shape[2] not in (1, 3) or not hi > lo:
            raise ValueError("an image has 1 or 3 channels and a range that is not empty")
        return cls(data, float(lo), float(hi))

    @property
    def size(self) -> tuple[int, int]:
        return self.data.shape[1], self.data.shape[0]

    @property
    def is_color(self) -> bool:
        return self.data.shape[2] == 3

    @property
    def span(self) -> float:
        return self.hi - self.lo

    @property
    def eight_bit(self) -> bool:
        return self.lo == 0 and self.hi == 255

    def gray(self) -> np.ndarray:
        if not self.is_color:
            return self.data[:, :, 0]
        w = np.array(LUMA, np.float32)
        return w[0] * self.data[:, :, 0] + w[1] * self.data[:, :, 1] + w[2] * self.data[:, :, 2]

    def put(self, data: np.ndarray, clamp: bool = True) -> Raster:
        data = np.asarray(data, np.float32)
        if data.ndim == 2:
            data = data[:, :, None]
        return replace(self, data=np.clip(data, self.lo, self.hi) if clamp else data)


def planes(image: Raster, f) -> np.ndarray:
    return np.stack([f(image.data[:, :, c]) for c in range(image.data.shape[2])], axis=2)


def histogram(values: np.ndarray, bins: int, lo: float, hi: float) -> np.ndarray:
    return np.bincount(np.clip(((values.astype(np.float64) - lo) * bins / (hi - lo)).astype(np.int64), 0, bins - 1).ravel(), minlength=bins)


def quantile(counts: np.ndarray, q: float, lo: float, hi: float) -> float:
    total = counts.sum()
    if not total:
        return 0.0
    run = np.cumsum(counts)
    k = int(np.flatnonzero((run >= q * total) & (counts > 0))[0])
    step = (hi - lo) / len(counts)
    return lo + k * step + (q * total - (run[k] - counts[k])) / counts[k] * step


def blur(image: Raster, sigma: float) -> Raster:
    if sigma <= 0:
        return image

    def one(plane: np.ndarray) -> np.ndarray:
        if sigma <= 3:
            return kernels.line_filter(plane, gaussian_weights(sigma))
        for r in box_radii(sigma):
            plane = kernels.box_filter(plane, r)
        return plane

    return image.put(planes(image, one), clamp=False)


def with_luminance(image: Raster, new: np.ndarray) -> Raster:
    if not image.is_color:
        return image.put(new, clamp=False)
    old = image.gray() - image.lo
    ratio = np.divide(new - image.lo, old, out=np.zeros_like(old), where=old > 1e-6)
    scaled = image.lo + (image.data - image.lo) * ratio[:, :, None]
    return image.put(np.where(old[:, :, None] > 1e-6, scaled, new[:, :, None]))


def auto_contrast(image: Raster, percent: float) -> Raster:
    g = image.gray()
    lo, hi = float(g.min()), float(g.max())
    if not hi > lo:
        return image
    counts = histogram(g, 1024, lo, hi)
    p = min(max(percent, 0), 49) / 100
    a, b = quantile(counts, p, lo, hi), quantile(counts, 1 - p, lo, hi)
    return image.put(image.lo + (image.data.astype(np.float64) - a) * (image.span / (b - a))) if b > a else image


def equalize(image: Raster) -> Raster:
    g = image.gray()
    lo, hi = float(g.min()), float(g.max())
    if not hi > lo:
        return image
    top = hi + 1e-3
    counts = histogram(g, 256, lo, top)
    cdf = np.cumsum(counts) / counts.sum()
    place = np.clip(((g.astype(np.float64) - lo) * 256 / (top - lo)).astype(int), 0, 255)
    return with_luminance(image, (image.lo + cdf[place] * image.span).astype(np.float32))


def clahe(image: Raster, tiles: int, clip: float) -> Raster:
    g = image.gray()
    lo, hi = float(g.min()), float(g.max())
    if not hi > lo:
        return image
    h, w = g.shape
    tx, ty = min(max(tiles, 1), 32, w), min(max(tiles, 1), 32, h)
    place = np.clip(((g.astype(np.float64) - lo) * (256 / (hi - lo + 1e-6))).astype(int), 0, 255)
    xs, ys = (np.arange(tx + 1) * (w / tx)).astype(int), (np.arange(ty + 1) * (h / ty)).astype(int)
    maps = np.empty((ty, tx, 256))
    for j in range(ty):
        for i in range(tx):
            counts = np.bincount(place[ys[j] : ys[j + 1], xs[i] : xs[i + 1]].ravel(), minlength=256).astype(float)
            n = counts.sum()
            limit = max(1.0, clip * n / 256)
            cut = np.minimum(counts, limit)
            maps[j, i] = np.cumsum(cut + (counts - cut).sum() / 256) / n

    def sides(n: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(n) + 0.5) / (n / count) - 0.5
        a = np.clip(np.floor(at).astype(int), 0, count - 1)
        return a, np.minimum(a + 1, count - 1), np.clip(at - a, 0, 1)

    (xa, xb, fx), (ya, yb, fy) = sides(w, tx), sides(h, ty)
    take = lambda y, x: maps[y[:, None], x[None, :], place]
    fx, fy = fx[None, :], fy[:, None]
    v = (1 - fy) * ((1 - fx) * take(ya, xa) + fx * take(ya, xb)) + fy * ((1 - fx) * take(yb, xa) + fx * take(yb, xb))
    return with_luminance(image, (image.lo + v * image.span).astype(np.float32))


def stain(image: Raster, index: int) -> Raster:
    if not image.is_color:
        raise ValueError("stain separation needs a colour image")
    v = image.data.astype(np.float64)
    od = -np.log10(np.maximum(np.clip(np.rint(v), 0, 255), 1) / 255) if image.eight_bit else -np.log10(np.maximum(v, 1) / image.hi)
    amount = od @ np.array(stain_weights(STAIN_ORDER[index]))
    return Raster.of(np.clip(amount, 0, MAX_DENSITY), 0, MAX_DENSITY)


def sobel(image: Raster) -> Raster:
    p = np.pad(image.gray(), 1, mode="edge")
    dx, sx = p[:, 2:] - p[:, :-2], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    gx, gy = dx[:-2] + 2 * dx[1:-1] + dx[2:], sx[2:] - sx[:-2]
    return Raster.of(np.clip(image.lo + np.sqrt(gx * gx + gy * gy) / 4, image.lo, image.hi), image.lo, image.hi)


def background(image: Raster, sigma: float, divide: bool) -> Raster:
    bg = blur(image, max(1.0, sigma)).data
    if not divide:
        return image.put(image.lo + (image.data - bg))
    return image.put(image.lo + (image.data - image.lo) / np.maximum(bg - image.lo, np.float32(1e-3)) * (float(bg.mean(dtype=np.float64)) - image.lo))


def noise(image: Raster, sd: float, salt: float, seed: int) -> Raster:
    """Drawn from seed and position by the same integer arithmetic as for pixel relations."""
    h, w, channels = image.data.shape
    y, x = np.mgrid[0:h, 0:w].astype(np.int64)
    draw = lambda what: (noise_state(seed, what, y, x) + 0.5) / NOISE_PRIME
    normal = np.stack([np.sqrt(-2 * np.log(draw(2 + 2 * c))) * np.cos(2 * math.pi * draw(3 + 2 * c)) for c in range(channels)], axis=2)
    out = np.clip(image.data + sd * image.span * normal, image.lo, image.hi)
    return image.put(np.where((draw(0) < salt)[:, :, None], np.where((draw(1) < 0.5)[:, :, None], image.hi, image.lo), out))


def resize(image: Raster, factor: float) -> Raster:
    if not factor > 0:
        raise ValueError("the factor must be positive")
    return image.put(planes(image, lambda p: kernels.area_resize(p, factor)), clamp=False)


def content_box(image: Raster, threshold: float, bright: bool, margin: int) -> tuple[int, int, int, int] | None:
    g = image.gray()
    hit = g > threshold if bright else g < threshold
    ys, xs = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    if not len(ys):
        return None
    x0, y0 = max(0, xs[0] - margin), max(0, ys[0] - margin)
    return int(x0), int(y0), int(min(g.shape[1] - 1, xs[-1] + margin) - x0 + 1), int(min(g.shape[0] - 1, ys[-1] + margin) - y0 + 1)


def crop(a: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    x, y = min(max(x, 0), a.shape[1] - 1), min(max(y, 0), a.shape[0] - 1)
    return a[y : y + max(1, height), x : x + max(1, width)]


# ---------------------------------------------------------------- thresholds on counts


def otsu(counts: np.ndarray) -> int:
    c = counts.astype(float)
    wb, sb = np.cumsum(c), np.cumsum(c * np.arange(len(c)))
    wf = wb[-1] - wb
    ok = (wb > 0) & (wf > 0)
    ok[-1] = False
    gap = np.divide(sb, wb, out=np.zeros_like(sb), where=ok) - np.divide(sb[-1] - sb, wf, out=np.zeros_like(sb), where=ok)
    between = np.where(ok, wb * wf * gap * gap, 0)
    best = between.max()
    if best <= 0:
        return 0
    top = np.flatnonzero(between >= best * (1 - 1e-12))
    return int(top[0] + top[-1]) // 2


def triangle(counts: np.ndarray) -> int:
    filled = np.flatnonzero(counts)
    if not len(filled):
        return 0
    first, last, peak = int(filled[0]), int(filled[-1]), int(np.argmax(counts))
    if first == last:
        return first
    up = last - peak > peak - first
    stop = last if up else first
    at = np.arange(min(peak, stop), max(peak, stop) + 1)
    far = np.abs((float(counts[stop]) - counts[peak]) * at - (stop - peak) * counts[at].astype(float) + stop * float(counts[peak]) - float(counts[stop]) * peak)
    k = int(at[np.argmax(far)])
    return min(max(k if up else k - 1, 0), len(counts) - 2)


def isodata(counts: np.ndarray, rounds: int = 100) -> int:
    at, c = np.arange(len(counts)), counts.astype(float)
    if not c.sum():
        return 0
    t = (at * c).sum() / c.sum()
    for _ in range(rounds):
        low = at <= t
        n0, n1 = c[low].sum(), c[~low].sum()
        if not n0 or not n1:
            break
        new = ((at * c)[low].sum() / n0 + (at * c)[~low].sum() / n1) / 2
        done = abs(new - t) < 0.5
        t = new
        if done:
            break
    return min(max(math.floor(t), 0), len(counts) - 2)


def find_threshold(image: Raster, method: str, within: np.ndarray | None = None) -> float:
    g = image.gray()
    v = g[within] if within is not None else g.ravel()
    if not v.size:
        return image.lo
    lo, hi = (0.0, 256.0) if image.eight_bit else (float(v.min()), float(v.max()))
    hi = hi if hi > lo else lo + 1
    counts = histogram(v, 256, lo, hi)
    mean = int(min(255, max(0, (float(v.mean(dtype=np.float64)) - lo) * 256 / (hi - lo))))
    level = {"otsu": lambda: otsu(counts), "triangle": lambda: triangle(counts), "isodata": lambda: isodata(counts), "mean": lambda: mean}[method]()
    return lo + (level + 1) * (hi - lo) / 256


def hsv_mask(image: Raster, hue, saturation, value) -> np.ndarray:
    if not image.is_color:
        raise ValueError("choosing by colour needs a colour image")
    u = np.clip((image.data.astype(np.float64) - image.lo) / image.span, 0, 1)
    r, g, b = u[:, :, 0], u[:, :, 1], u[:, :, 2]
    top, d = u.max(axis=2), np.ptp(u, axis=2)
    safe = np.where(d > 1e-9, d, 1)
    h = np.where(top == r, np.fmod((g - b) / safe, 6), np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) * 60
    h = np.where(d > 1e-9, np.where(h < 0, h + 360, h), 0)
    s = np.where(top > 0, d / np.where(top > 0, top, 1), 0)
    in_hue = (h >= hue[0]) & (h <= hue[1]) if hue[0] <= hue[1] else (h >= hue[0]) | (h <= hue[1])
    return in_hue & (s >= saturation[0]) & (s <= saturation[1]) & (top >= value[0]) & (top <= value[1])


def kmeans(image: Raster, k: int, seed: int = 1, sample: int = 60_000) -> tuple[np.ndarray, np.ndarray, Raster]:
    """(cluster per pixel, centres, image of the centres); clusters go from dark to bright."""
    k = min(max(k, 2), 8)
    f = ((image.data.reshape(-1, image.data.shape[2]).astype(np.float64) - image.lo) / image.span)
    centers = kernels.kmeans(f[:: max(1, len(f) // sample)].copy(), k, seed)
    bright = centers @ np.array(LUMA) if image.is_color else centers[:, 0]
    centers = centers[np.argsort(bright, kind="stable")]
    own = np.concatenate([kernels.nearest(part, centers)[0] for part in np.array_split(f, max(1, len(f) // 500_000))])
    shown = image.lo + centers * image.span
    return own.reshape(image.data.shape[:2]), shown, image.put(shown[own].reshape(image.data.shape), clamp=False)


def find_template(image: Raster, template: Raster, low: float = 0.6, most: int = 20) -> list[dict]:
    """Places like the template at full resolution, best first: the correlation of every place comes from one transform."""
    g, t = image.gray(), template.gray()
    (th, tw), (h, w) = t.shape, g.shape
    if min(th, tw) < 3 or th > h or tw > w:
        raise ValueError("the template must have 3 pixels on each side and fit into the image")
    return [{"x": x, "y": y, "width": tw, "height": th, "score": round(s, 4)} for x, y, s in kernels.peaks(kernels.correlation(g, t), tw, th, low, most)]
