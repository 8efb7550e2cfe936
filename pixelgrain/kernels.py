"""Whole-image algorithms on numpy arrays, for what has no relational form; run inside Arrow batches, one image at a time."""

from __future__ import annotations

import math

import numpy as np


# ---------------------------------------------------------------- labels and distances


def label(mask: np.ndarray, eight: bool = True) -> tuple[np.ndarray, int]:
    """Connected objects numbered from 1 in the raster order of their first pixels; union-find over runs of rows."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    row, start = np.nonzero(step == 1)
    stop = np.nonzero(step == -1)[1]
    n = len(row)
    out = np.zeros((h, w), np.int32)
    if not n:
        return out, 0
    first = np.searchsorted(row, np.arange(h + 1))
    reach = 1 if eight else 0
    # runs of the row above that a run touches: those that end after its start and start before its end
    shift = row * (w + 4)
    low = np.searchsorted(shift + stop, (row - 1) * (w + 4) + start - reach, "right")
    high = np.searchsorted(shift + start, (row - 1) * (w + 4) + stop + reach, "left")
    low, high = np.maximum(low, first[np.maximum(row - 1, 0)]), np.minimum(high, first[row])
    parent = list(range(n))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for k in np.flatnonzero((high > low) & (row > 0)).tolist():
        for j in range(int(low[k]), int(high[k])):
            a, b = find(k), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    root = np.array([find(k) for k in range(n)])
    _, ids = np.unique(root, return_inverse=True)
    length = stop - start
    flat = np.repeat(row * w + start - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
    out.ravel()[flat] = np.repeat(ids + 1, length)
    return out, int(ids.max()) + 1


def squared_distance(target: np.ndarray, far: float = 1e20) -> np.ndarray:
    """Squared Euclidean distance of every pixel to the nearest True pixel, in time linear in the pixels but for a logarithm.

    Columns give the distance to the nearest target above or below. In a row the best column never moves back as x moves
    on, so halving finds it: the middle of each gap searches only between the choices of its two neighbours, for all rows
    and all gaps of a level at once.
    """
    h, w = target.shape
    steps = np.where(target, 0, h + w)
    for line in (steps, steps[::-1]):
        for y in range(1, h):
            np.minimum(line[y], line[y - 1] + 1, out=line[y])
    none = 4 * (h + w) ** 2
    g = np.where(steps >= h + w, none, steps.astype(np.int64) ** 2)
    choice = np.zeros((h, w + 2), np.int64)  # with a column on either side that holds the widest bounds
    choice[:, w + 1] = w - 1
    best = np.empty((h, w), np.int64)
    gap = 1 << max(0, (w - 1).bit_length())
    seen = np.array([-1, w])
    while gap >= 1:
        x = np.arange(gap - 1, w, 2 * gap) if gap > 1 else np.setdiff1d(np.arange(w), seen)
        x = np.setdiff1d(x, seen)
        if len(x):
            at = np.searchsorted(seen, x)
            low, high = choice[:, seen[at - 1] + 1], choice[:, seen[at] + 1]
            for rows in np.array_split(np.arange(h), max(1, h * w >> 21)):
                size = (high[rows] - low[rows] + 1).ravel()
                ends = np.cumsum(size)
                column = np.arange(ends[-1]) - np.repeat(ends - size - low[rows].ravel(), size)
                cell = np.repeat(np.arange(len(size)), size)
                cost = (g[rows[0] + cell // len(x), column] + np.square(column - x[cell % len(x)])) * w + column
                least = np.minimum.reduceat(cost, ends - size).reshape(len(rows), len(x))
                best[rows[:, None], x] = least // w
                choice[rows[:, None], x + 1] = least % w
            seen = np.sort(np.concatenate((seen, x)))
        gap //= 2
    return np.where(best >= none, far, best.astype(float))


def distance_to_background(mask: np.ndarray) -> np.ndarray:
    """Distance of object pixels to the background; what lies outside the image counts as background."""
    padded = np.pad(~mask, 1, constant_values=True)
    return np.sqrt(squared_distance(padded))[1:-1, 1:-1]


def distance_to_foreground(mask: np.ndarray) -> np.ndarray:
    return np.sqrt(squared_distance(mask))


MORPHOLOGY = ("erode", "dilate", "open", "close")


def morphology(mask: np.ndarray, op: str, radius: float) -> np.ndarray:
    if radius <= 0:
        return mask
    if op == "erode":
        return mask & (distance_to_background(mask) > radius)
    if op == "dilate":
        return distance_to_foreground(mask) <= radius if mask.any() else mask
    first, second = ("erode", "dilate") if op == "open" else ("dilate", "erode")
    return morphology(morphology(mask, first, radius), second, radius)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Background that is not 4-connected to the border becomes object."""
    outside, _ = label(np.pad(~mask, 1, constant_values=True), eight=False)
    return mask | (outside[1:-1, 1:-1] != outside[0, 0]) & ~mask


def areas(labels: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(labels.ravel(), minlength=n + 1)


def size_filter(mask: np.ndarray, low: float, high: float = 0) -> np.ndarray:
    labels, n = label(mask)
    size = areas(labels, n)
    keep = (size >= low) & ((size <= high) if high > 0 else True)
    keep[0] = False
    return keep[labels]


def border_labels(labels: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate((labels[0], labels[-1], labels[:, 0], labels[:, -1])))


def clear_border(mask: np.ndarray) -> np.ndarray:
    labels, n = label(mask)
    keep = np.ones(n + 1, bool)
    keep[border_labels(labels)] = False
    keep[0] = False
    return keep[labels]


def watershed(mask: np.ndarray, tolerance: float = 1.0) -> np.ndarray:
    """Flood from the highest distance down; a pixel between two hills that both rise by tolerance above it is a cut.

    Pixels are numbered by height, equal ones in raster order, so "flooded before" is a smaller number and a table of the
    eight neighbours' numbers is all that the flood looks at. Hills are few and have a table of their own: the hill that
    each has become part of, and its top. Lower hills that meet without a cut become part of the highest.
    """
    h, w = mask.shape
    height = np.pad(distance_to_background(mask), 1).astype(np.float32)
    inside = np.flatnonzero(height.ravel() > 0)
    by_height = inside[np.lexsort((inside, -height.ravel()[inside]))]
    n = len(by_height)
    number = np.full(height.size, n, np.int64)
    number[by_height] = np.arange(n)
    around = np.array([dy * (w + 2) + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx], np.int64)
    near = number[by_height[:, None] + around]
    flooded = near < np.arange(n)[:, None]
    hill = np.full(n + 1, -1).tolist()
    part_of: list[int] = []
    top: list[float] = []

    def whole(k: int) -> int:
        while part_of[k] != k:
            k = part_of[k]
        return k

    levels = height.ravel()[by_height].tolist()
    for k, (level, numbers, before) in enumerate(zip(levels, near.tolist(), flooded.tolist(), strict=True)):
        met: dict[int, None] = {}
        for j, early in zip(numbers, before, strict=True):
            if early and hill[j] >= 0:
                hill[j] = whole(hill[j])
                met[hill[j]] = None
        if not met:
            hill[k] = len(top)
            part_of.append(len(top))
            top.append(level)
        elif len(met) == 1:
            (hill[k],) = met
        else:
            highest = max(met, key=top.__getitem__)
            steep = {m for m in met if top[m] - level >= tolerance}
            divided = len(steep) > 1
            for m in met.keys() - (steep if divided else set()) - {highest}:
                part_of[m] = highest
            if not divided:
                hill[k] = highest
    out = np.zeros(height.size, bool)
    out[by_height] = np.array(hill[:n], np.int64) >= 0 if n else False
    return out.reshape(h + 2, w + 2)[1:-1, 1:-1]


# ---------------------------------------------------------------- shapes of objects

#: Chain-code weights of straight and diagonal steps and of corners, and the closing term.
STRAIGHT, DIAGONAL, CORNER, CLOSING = 0.980, 1.406, -0.091, math.pi


def perimeter(shape: np.ndarray) -> float:
    """Length of the outer contour of one object, from the edges between its pixels and the outside.

    The edges are followed from the first pixel's upper one, object on the right. Where they go on straight the contour
    makes a straight step, where they turn left (the object is on both sides of a corner of the outside, or goes on over
    a corner) a diagonal one, where they turn right none.
    """
    grid = np.pad(shape, 1)
    found = np.flatnonzero(grid)
    if not len(found):
        return 0.0
    wide = grid.shape[1]
    inside = grid.ravel().tolist()
    # by heading (east, south, west, north): the next corner, and the pixels ahead on the left and the right of a corner
    move, left, right = (1, wide, -1, -wide), (-wide, 0, -1, -wide - 1), (0, -1, -wide - 1, -wide)
    corner = begin = int(found[0])
    heading = 0
    turns: list[int] = []  # direction of each step, in eighths
    while True:
        corner += move[heading]
        if inside[corner + left[heading]]:
            turns.append((2 * heading - 1) % 8)
            heading = (heading - 1) % 4
        elif inside[corner + right[heading]]:
            turns.append(2 * heading)
        else:
            heading = (heading + 1) % 4
        if corner == begin and heading == 0:
            break
    if not turns:
        return CLOSING
    steps = np.array(turns)
    diagonal = int((steps % 2).sum())
    corners = int((steps != np.roll(steps, 1)).sum())
    return STRAIGHT * (len(steps) - diagonal) + DIAGONAL * diagonal + CORNER * corners + CLOSING


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull of distinct points, counter-clockwise."""
    pts = sorted({(float(x), float(y)) for x, y in points})
    if len(pts) < 3:
        return np.array(pts)

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def hull_measures(shape: np.ndarray) -> tuple[float, float]:
    """(largest diameter, hull area) from the outer pixel corners of each row of an object."""
    rows = np.flatnonzero(shape.any(axis=1))
    left = shape[rows].argmax(axis=1)
    right = shape.shape[1] - shape[rows][:, ::-1].argmax(axis=1)
    hull = convex_hull(np.concatenate([np.column_stack((side, rows + d)) for side in (left, right) for d in (0, 1)]))
    gaps = hull[:, None, :] - hull[None, :, :]
    nxt = np.roll(hull, -1, axis=0)
    return float(np.sqrt(np.square(gaps).sum(axis=2)).max()), float(abs((hull[:, 0] * nxt[:, 1] - nxt[:, 0] * hull[:, 1]).sum()) / 2)


# ---------------------------------------------------------------- filters


def line_filter(plane: np.ndarray, weights: list[float]) -> np.ndarray:
    r = len(weights) // 2
    for axis in (1, 0):
        pad = np.pad(plane, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = plane.shape[axis]
        total = np.zeros_like(plane)
        for k, weight in enumerate(weights):
            total += np.float32(weight) * (pad[:, k : k + n] if axis else pad[k : k + n])
        plane = total
    return plane


def box_filter(plane: np.ndarray, r: int) -> np.ndarray:
    if r == 0:
        return plane
    for axis in (1, 0):
        pad = np.pad(plane, [(r + 1, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge").astype(np.float64)
        sums = np.cumsum(pad, axis=axis)
        n = plane.shape[axis]
        take = lambda a, s=sums, ax=axis: s[:, a : a + n] if ax else s[a : a + n]
        plane = ((take(2 * r + 1) - take(0)) / (2 * r + 1)).astype(np.float32)
    return plane


def median_filter(plane: np.ndarray, radius: int) -> np.ndarray:
    """Middle of the square around each pixel; bands of rows keep memory bounded."""
    r = min(max(radius, 1), 7)
    side = 2 * r + 1
    pad = np.pad(plane, r, mode="edge")
    out = np.empty_like(plane)
    band = max(1, (8 << 20) // (plane.shape[1] * side * side * 4))
    for y in range(0, plane.shape[0], band):
        part = np.lib.stride_tricks.sliding_window_view(pad[y : y + band + 2 * r], (side, side))
        flat = part.reshape(part.shape[0], part.shape[1], side * side)
        out[y : y + band] = np.partition(flat, side * side // 2, axis=2)[:, :, side * side // 2]
    return out


def kmeans(features: np.ndarray, k: int, seed: int = 1, rounds: int = 50) -> np.ndarray:
    """Lloyd iterations from a k-means++ start on rows of features; ties to the lower index, empty clusters stay."""
    rng = np.random.default_rng(seed)
    centers = features[[int(rng.integers(len(features)))]]
    while len(centers) < k:
        d = nearest(features, centers)[1]
        total = d.sum()
        pick = int(rng.integers(len(features))) if total <= 0 else min(int(np.searchsorted(np.cumsum(d), rng.random() * total)), len(features) - 1)
        centers = np.concatenate((centers, features[[pick]]))
    before = None
    for _ in range(rounds):
        own, _ = nearest(features, centers)
        if before is not None and (own == before).all():
            break
        before = own
        count = np.bincount(own, minlength=k)
        for j in range(features.shape[1]):
            sums = np.bincount(own, features[:, j], k)
            centers[:, j] = np.where(count > 0, sums / np.maximum(count, 1), centers[:, j])
    return centers


def nearest(features: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.square(features[:, None, :] - centers[None, :, :]).sum(axis=2)
    own = d.argmin(axis=1)
    return own, d[np.arange(len(d)), own]


# ---------------------------------------------------------------- template search


def correlation(image: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation at every place where the template fits; 0 where either side is flat."""
    th, tw = template.shape
    h, w = image.shape
    out = np.zeros((h - th + 1, w - tw + 1))
    t = template.astype(np.float64) - template.mean(dtype=np.float64)
    norm = math.sqrt(float(np.square(t).sum()))
    if norm < 1e-9:
        return out
    img = image.astype(np.float64)
    sums = [np.pad(np.cumsum(np.cumsum(p, axis=0), axis=1), ((1, 0), (1, 0))) for p in (img, img * img)]
    total, square = (s[th:, tw:] - s[:-th, tw:] - s[th:, :-tw] + s[:-th, :-tw] for s in sums)
    size = (h + th - 1, w + tw - 1)
    cross = np.fft.irfft2(np.fft.rfft2(img, size) * np.fft.rfft2(t[::-1, ::-1], size), size)[th - 1 : h, tw - 1 : w]
    variance = square - total * total / (th * tw)
    good = variance > max(1e-9, 1e-12 * float(square.max()))
    out[good] = cross[good] / (np.sqrt(variance[good]) * norm)
    return out


def peaks(score: np.ndarray, tw: int, th: int, low: float, most: int) -> list[tuple[int, int, float]]:
    """(x, y, score) of places that no place within half a template beats; equal ones go to the earlier pixel.

    Places are taken from the best one down; each covers what is within half a template, so a place that is covered has a
    better or earlier one beside it and is none.
    """
    rx, ry = max(1, tw // 2), max(1, th // 2)
    at = np.flatnonzero(score >= low)
    at = at[np.argsort(-score.ravel()[at], kind="stable")]
    covered = np.zeros(score.shape, bool)
    out: list[tuple[int, int, float]] = []
    for y, x in zip(*(c.tolist() for c in np.unravel_index(at, score.shape)), strict=True):
        free = not covered[y, x]
        covered[max(0, y - ry) : y + ry + 1, max(0, x - rx) : x + rx + 1] = True
        if free:
            out.append((x, y, float(score[y, x])))
            if len(out) == most:
                break
    return out


def area_resize(plane: np.ndarray, factor: float) -> np.ndarray:
    """Area-weighted means for smaller images, bilinear values for larger ones; one axis after the other."""
    for axis in (0, 1):
        plane = np.moveaxis(_resize_rows(np.moveaxis(plane, axis, 0), factor), 0, axis)
    return plane.astype(np.float32)


def _resize_rows(rows: np.ndarray, factor: float) -> np.ndarray:
    n = rows.shape[0]
    m = max(1, round(n * factor))
    if m == n:
        return rows
    step = n / m
    if factor < 1:
        sums = np.concatenate((np.zeros((1, *rows.shape[1:])), np.cumsum(rows, axis=0, dtype=np.float64)))
        edge = np.minimum(np.arange(m + 1) * step, n)
        whole = np.minimum(np.floor(edge).astype(int), n - 1)
        at = sums[whole] + (edge - whole).reshape(-1, *[1] * (rows.ndim - 1)) * rows[whole]
        return np.diff(at, axis=0) / step
    at = np.clip((np.arange(m) + 0.5) * step - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    part = (at - low).reshape(-1, *[1] * (rows.ndim - 1))
    return (1 - part) * rows[low] + part * rows[np.minimum(low + 1, n - 1)]
