"""Neighbourhood filters as windows along rows and columns, and offset joins where a whole square is needed.

A window is partitioned by image and line, never by image alone, so the parallelism is the number of lines.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import NOISE_PRIME, noise_state
from ..model import clamp, value_columns
from . import stats

BOX_PASSES = 3


def gaussian_weights(sigma: float) -> list[float]:
    r = max(1, math.ceil(3 * sigma))
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def box_radii(sigma: float) -> list[int]:
    """Radii of three boxes whose variances add up to about sigma squared: odd widths, the narrower ones first."""
    n = BOX_PASSES
    low = math.floor(math.sqrt(12 * sigma * sigma / n + 1))
    low -= low % 2 == 0
    m = round((12 * sigma * sigma - n * low * low - 4 * n * low - 3 * n) / (-4 * low - 4))
    return [max(((low if i < m else low + 2) - 1) // 2, 0) for i in range(n)]


def _line(axis: str):
    return W.partitionBy("image_id", "y" if axis == "x" else "x").orderBy(axis)


def neighbour(column: str, axis: str, offset: int) -> Column:
    """The value offset pixels along an axis; past the edge the edge's own value."""
    w = _line(axis)
    if offset == 0:
        return F.col(column)
    edge = F.first(column).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) if offset < 0 else F.last(column).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    moved = F.lag(column, -offset).over(w) if offset < 0 else F.lead(column, offset).over(w)
    return F.coalesce(moved, edge)


def convolve(pixels: DataFrame, axis: str, weights: list[float]) -> DataFrame:
    r = len(weights) // 2
    total = lambda c: reduce(lambda a, b: a + b, [neighbour(c, axis, k - r) * F.lit(w) for k, w in enumerate(weights)])
    return pixels.withColumns({c: total(c) for c in value_columns(pixels)})


def box_blur(pixels: DataFrame, axis: str, r: int) -> DataFrame:
    """Mean of 2r + 1 values along an axis, edges replicated: one frame sum plus what lies past either end."""
    if r == 0:
        return pixels
    w = _line(axis)
    size = F.col("width" if axis == "x" else "height")
    every = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before, after = F.greatest(F.lit(0), r - F.col(axis)), F.greatest(F.lit(0), F.col(axis) + r - (size - 1))
    mean = lambda c: (F.sum(c).over(w.rowsBetween(-r, r)) + before * F.first(c).over(every) + after * F.last(c).over(every)) / (2 * r + 1)
    return pixels.withColumns({c: mean(c) for c in value_columns(pixels)})


def gaussian_exact(pixels: DataFrame, sigma: float) -> DataFrame:
    weights = gaussian_weights(sigma)
    return convolve(convolve(pixels, "x", weights), "y", weights)


def gaussian_boxes(pixels: DataFrame, sigma: float) -> DataFrame:
    """All passes along x, then all along y: with replicated edges the axes commute, and pixels move twice in all."""
    for axis in ("x", "y"):
        for r in box_radii(sigma):
            pixels = box_blur(pixels, axis, r)
    return pixels


def gaussian(pixels: DataFrame, sigma: float) -> DataFrame:
    """Exact up to sigma 3, three boxes beyond."""
    if sigma <= 0:
        return pixels
    return gaussian_exact(pixels, sigma) if sigma <= 3 else gaussian_boxes(pixels, sigma)


def median(pixels: DataFrame, radius: int = 1) -> DataFrame:
    """Middle value of the square of side 2r + 1, edges replicated: lines are gathered first along x, then along y."""
    r = min(max(int(radius), 1), 7)
    out = pixels
    for c in value_columns(pixels):
        rows = out.withColumn("_row", F.array(*(neighbour(c, "x", k) for k in range(-r, r + 1))))
        square = F.flatten(F.array(*(neighbour("_row", "y", k) for k in range(-r, r + 1))))
        out = rows.withColumn("_all", square).withColumn(c, F.element_at(F.array_sort("_all"), 2 * r * (r + 1) + 1)).drop("_row", "_all")
    return out


def sharpen(pixels: DataFrame, sigma: float = 1.5, amount: float = 0.8) -> DataFrame:
    names = value_columns(pixels)
    kept = pixels.withColumns({f"_{c}": F.col(c) for c in names})
    blurred = gaussian(kept, sigma)
    return blurred.withColumns({c: clamp(F.col(f"_{c}") + amount * (F.col(f"_{c}") - F.col(c))) for c in names}).drop(*(f"_{c}" for c in names))


def sobel(pixels: DataFrame) -> DataFrame:
    """A quarter of the gradient's length above the lower end of the range, as a gray image."""
    g = stats.gray_values(pixels)
    along = g.withColumns({"_dx": neighbour("v", "x", 1) - neighbour("v", "x", -1), "_sx": neighbour("v", "x", -1) + 2 * F.col("v") + neighbour("v", "x", 1)})
    gx = neighbour("_dx", "y", -1) + 2 * F.col("_dx") + neighbour("_dx", "y", 1)
    gy = neighbour("_sx", "y", 1) - neighbour("_sx", "y", -1)
    return along.withColumns({"_gx": gx, "_gy": gy}).withColumn("v", clamp(F.col("lo") + F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")) / 4)).drop("_dx", "_sx", "_gx", "_gy")


def background(pixels: DataFrame, sigma: float = 40.0, divide: bool = False) -> DataFrame:
    """Take a broad blur for the uneven background and subtract it, or divide by it and restore its mean."""
    names = value_columns(pixels)
    kept = pixels.withColumns({f"_{c}": F.col(c) for c in names})
    blurred = gaussian(kept, max(1.0, sigma))
    if not divide:
        out = blurred.withColumns({c: clamp(F.col("lo") + F.col(f"_{c}") - F.col(c)) for c in names})
    else:
        # one mean over all samples of the image
        means = blurred.groupBy("image_id").agg(F.avg(sum((F.col(c) for c in names), F.lit(0.0)) / len(names)).alias("_mean"))
        joined = blurred.join(means, "image_id")
        out = joined.withColumns({c: clamp(F.col("lo") + (F.col(f"_{c}") - F.col("lo")) / F.greatest(F.col(c) - F.col("lo"), F.lit(1e-3)) * (F.col("_mean") - F.col("lo"))) for c in names}).drop("_mean")
    return out.drop(*(f"_{c}" for c in names))


def noise(pixels: DataFrame, sd_percent: float = 5.0, salt_percent: float = 0.0, seed: int = 1) -> DataFrame:
    """Gaussian and salt-and-pepper noise from seed and position: the same on every partitioning, retry and path."""
    span = F.col("hi") - F.col("lo")
    draw = lambda what: (noise_state(F.lit(seed).cast("long"), F.lit(what).cast("long"), F.col("y").cast("long"), F.col("x").cast("long")) + 0.5) / float(NOISE_PRIME)
    out = {}
    for k, c in enumerate(value_columns(pixels)):
        normal = F.sqrt(-2 * F.log(draw(2 + 2 * k))) * F.cos(2 * math.pi * draw(3 + 2 * k))
        out[c] = F.when(draw(0) < salt_percent / 100, F.when(draw(1) < 0.5, F.col("hi")).otherwise(F.col("lo"))).otherwise(clamp(F.col(c) + (sd_percent / 100) * span * normal))
    return pixels.withColumns(out)
