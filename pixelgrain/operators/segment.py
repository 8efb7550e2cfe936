"""From images to masks: thresholds, colour ranges, regions and k-means classes. A mask is a pixel relation with m."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import with_hsv
from ..model import is_color, value_columns
from . import stats

MASK = ["image_id", "width", "height", "y", "x", "m"]


def threshold(pixels: DataFrame, method: str = "otsu", value: float | None = None, bright: bool = True) -> DataFrame:
    """Bright objects are at or above the threshold, dark ones below it; found per image unless it is given."""
    g = stats.gray_values(pixels)
    if method == "manual":
        g = g.withColumn("threshold", F.lit(float(value)))
    else:
        g = g.join(stats.find_threshold(g, method), "image_id")
    return g.withColumn("m", (F.col("v") >= F.col("threshold")) if bright else (F.col("v") < F.col("threshold"))).select(*MASK)


def value_between(pixels: DataFrame, low: float, high: float) -> DataFrame:
    return stats.gray_values(pixels).withColumn("m", F.col("v").between(low, high)).select(*MASK)


def color_threshold(pixels: DataFrame, hue=(220.0, 300.0), saturation=(20.0, 100.0), value=(0.0, 100.0)) -> DataFrame:
    """Closed ranges of hue (degrees, wrapping if the first is larger), saturation and value (percent)."""
    if not is_color(pixels):
        raise ValueError("this step needs a colour image")
    h, s, v = F.col("_h"), F.col("_s"), F.col("_v")
    in_hue = h.between(*hue) if hue[0] <= hue[1] else (h >= hue[0]) | (h <= hue[1])
    m = in_hue & s.between(saturation[0] / 100, saturation[1] / 100) & v.between(value[0] / 100, value[1] / 100)
    return with_hsv(pixels).withColumn("m", m).select(*MASK)


def inside(shape: str, points: list[tuple[float, float]]) -> Column:
    """Whether a pixel's centre lies in a region: half-open rectangle, ellipse, or polygon by the even-odd rule."""
    cx, cy = F.col("x") + 0.5, F.col("y") + 0.5
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    if shape == "rectangle":
        return (cx >= min(xs)) & (cx < max(xs)) & (cy >= min(ys)) & (cy < max(ys))
    if shape == "ellipse":
        rx, ry = (max(xs) - min(xs)) / 2, (max(ys) - min(ys)) / 2
        if rx <= 0 or ry <= 0:
            return F.lit(False)
        dx, dy = (cx - (max(xs) + min(xs)) / 2) / rx, (cy - (max(ys) + min(ys)) / 2) / ry
        return dx * dx + dy * dy <= 1
    if shape != "polygon" or len(points) < 3:
        raise ValueError("a region is a rectangle, an ellipse or a polygon of three points or more")
    edges = zip(points, points[-1:] + points[:-1], strict=True)
    crossings = [F.when(((F.lit(float(ay)) > cy) != (F.lit(float(by)) > cy)) & (cx < (bx - ax) * (cy - ay) / (by - ay) + ax), 1).otherwise(0) for (ax, ay), (bx, by) in edges if ay != by]
    return reduce(lambda a, b: a + b, crossings) % 2 == 1


def region(pixels: DataFrame, shape: str, points: list[tuple[float, float]]) -> DataFrame:
    """Mask of a region; the bounding box comes first so that it prunes."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    box = F.col("x").between(min(xs) - 1, max(xs) + 1) & F.col("y").between(min(ys) - 1, max(ys) + 1)
    return pixels.withColumn("m", box & inside(shape, points)).select(*MASK)


def invert(mask: DataFrame) -> DataFrame:
    return mask.withColumn("m", ~F.col("m"))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels in both masks."""
    other = b.where("m").select("image_id", "y", "x", F.lit(True).alias("_b"))
    return a.join(other, ["image_id", "y", "x"], "left").withColumn("m", F.col("m") & F.coalesce("_b", F.lit(False))).select(*MASK)


def assign_clusters(pixels: DataFrame, centers: list[tuple[float, ...]]) -> DataFrame:
    """Nearest centre (values in the nominal range scaled to 0..1); ties go to the lower index."""
    span = F.col("hi") - F.col("lo")
    scaled = [(F.col(c) - F.col("lo")) / span for c in value_columns(pixels)]
    options = [F.struct(reduce(lambda a, b: a + b, [(s - F.lit(float(c))) * (s - F.lit(float(c))) for s, c in zip(scaled, center, strict=True)]).alias("d"), F.lit(k).alias("k")) for k, center in enumerate(centers)]
    return pixels.withColumn("cluster", F.array_min(F.array(*options))["k"])


def cluster_sums(pixels: DataFrame, centers: list[tuple[float, ...]]) -> DataFrame:
    """One Lloyd step: mean of the members of each cluster, by cluster; empty ones are missing."""
    span = F.col("hi") - F.col("lo")
    return assign_clusters(pixels, centers).groupBy("image_id", "cluster").agg(F.count(F.lit(1)).alias("n"), *(F.avg((F.col(c) - F.col("lo")) / span).alias(c) for c in value_columns(pixels)))
