"""Geometry: coordinate expressions, and overlap joins for resizing. All of them also work on mask and label relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import value_columns
from . import stats


def crop(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """The rectangle, moved and shrunk to lie inside, at least one pixel."""
    x0 = F.greatest(F.lit(0), F.least(F.lit(int(x)), F.col("width") - 1))
    y0 = F.greatest(F.lit(0), F.least(F.lit(int(y)), F.col("height") - 1))
    w = F.greatest(F.lit(1), F.least(F.lit(int(width)), F.col("width") - x0))
    h = F.greatest(F.lit(1), F.least(F.lit(int(height)), F.col("height") - y0))
    d = pixels.withColumns({"_x": x0, "_y": y0, "_w": w, "_h": h})
    return _cut(d)


def _cut(d: DataFrame) -> DataFrame:
    """Keep and shift what lies in the rectangle _x, _y, _w, _h."""
    inside = d.where((F.col("x") >= F.col("_x")) & (F.col("x") < F.col("_x") + F.col("_w")) & (F.col("y") >= F.col("_y")) & (F.col("y") < F.col("_y") + F.col("_h")))
    moved = {"x": (F.col("x") - F.col("_x")).cast("int"), "y": (F.col("y") - F.col("_y")).cast("int"), "width": F.col("_w").cast("int"), "height": F.col("_h").cast("int")}
    return inside.withColumns(moved).drop("_x", "_y", "_w", "_h")


def content_bounds(pixels: DataFrame, threshold: float, bright: bool = True, margin: int = 4) -> DataFrame:
    """(image_id, x, y, w, h) of the padded box around content; images without content have no row."""
    g = stats.gray_values(pixels)
    hit = F.col("v") > threshold if bright else F.col("v") < threshold
    box = g.where(hit).groupBy("image_id", "width", "height").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    x, y = F.greatest(F.lit(0), F.col("x0") - margin), F.greatest(F.lit(0), F.col("y0") - margin)
    return box.select("image_id", x.alias("_x"), y.alias("_y"), (F.least(F.col("width") - 1, F.col("x1") + margin) - x + 1).alias("_w"), (F.least(F.col("height") - 1, F.col("y1") + margin) - y + 1).alias("_h"))


def auto_crop(pixels: DataFrame, threshold: float, bright: bool = True, margin: int = 4) -> DataFrame:
    """Crop to content; images without any pass unchanged."""
    d = pixels.join(content_bounds(pixels, threshold, bright, margin), "image_id", "left")
    whole = {"_x": F.coalesce("_x", F.lit(0)), "_y": F.coalesce("_y", F.lit(0)), "_w": F.coalesce("_w", "width"), "_h": F.coalesce("_h", "height")}
    return _cut(d.withColumns(whole))


def flip(pixels: DataFrame, horizontal: bool = True) -> DataFrame:
    if horizontal:
        return pixels.withColumn("x", F.col("width") - 1 - F.col("x"))
    return pixels.withColumn("y", F.col("height") - 1 - F.col("y"))


def rotate(pixels: DataFrame, turn: int = 0) -> DataFrame:
    """0: right by 90 degrees, 1: by 180, 2: left by 90."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    if turn == 1:
        return pixels.withColumns({"x": w - 1 - x, "y": h - 1 - y})
    to = {"x": h - 1 - y, "y": x} if turn == 0 else {"x": y, "y": w - 1 - x}
    return pixels.withColumns(to | {"width": h, "height": w})


def _new_size(size: str, factor: float) -> Column:
    return F.greatest(F.lit(1), F.rint(F.col(size) * factor).cast("int"))


def resize(pixels: DataFrame, factor: float = 0.5) -> DataFrame:
    """Smaller: area-weighted means. A source pixel is sent to the few target pixels it overlaps, then summed."""
    if not factor > 0:
        raise ValueError("the factor must be positive")
    if factor >= 1:
        return resize_up(pixels, factor)
    d = pixels.withColumns({"_nw": _new_size("width", factor), "_nh": _new_size("height", factor)})
    for axis, size, new in (("x", "width", "_nw"), ("y", "height", "_nh")):
        step = F.col(size) / F.col(new)
        first, last = F.floor(F.col(axis) / step).cast("int"), F.least(F.ceil((F.col(axis) + 1) / step).cast("int"), F.col(new)) - 1
        d = d.withColumn(f"_t{axis}", F.explode(F.sequence(F.least(first, F.col(new) - 1), F.greatest(F.least(first, F.col(new) - 1), last))))
        d = d.withColumn(f"_w{axis}", F.least(F.col(axis) + 1, (F.col(f"_t{axis}") + 1) * step) - F.greatest(F.col(axis).cast("double"), F.col(f"_t{axis}") * step)).where(F.col(f"_w{axis}") > 0)
    weight = F.col("_wx") * F.col("_wy")
    sums = d.groupBy("image_id", F.col("_nw").alias("width"), F.col("_nh").alias("height"), "lo", "hi", F.col("_ty").alias("y"), F.col("_tx").alias("x"))
    return sums.agg(*((F.sum(F.col(c) * weight) / F.sum(weight)).alias(c) for c in value_columns(pixels)))


def bilinear(pixels: DataFrame, points: DataFrame) -> DataFrame:
    """Values at points (image_id, px, py, and any other columns), centre-aligned, edges replicated: four equi-joins."""
    sizes = pixels.groupBy("image_id").agg(F.first("width").alias("_w"), F.first("height").alias("_h"))
    at = points.join(sizes, "image_id")
    cx, cy = (F.greatest(F.lit(0.0), F.least(F.col(p), F.col(s) - 1.0)) for p, s in (("px", "_w"), ("py", "_h")))
    at = at.withColumns({"_cx": cx, "_cy": cy})
    at = at.withColumns({"_x0": F.floor("_cx").cast("int"), "_y0": F.floor("_cy").cast("int")})
    at = at.withColumns({"_x1": F.least(F.col("_x0") + 1, F.col("_w") - 1), "_y1": F.least(F.col("_y0") + 1, F.col("_h") - 1), "_fx": F.col("_cx") - F.col("_x0"), "_fy": F.col("_cy") - F.col("_y0")})
    names = value_columns(pixels)
    for k, (xs, ys) in enumerate((("_x0", "_y0"), ("_x1", "_y0"), ("_x0", "_y1"), ("_x1", "_y1"))):
        corner = pixels.select("image_id", F.col("x").alias(xs), F.col("y").alias(ys), *(F.col(c).alias(f"_{c}{k}") for c in names))
        at = at.join(corner, ["image_id", xs, ys])
    fx, fy = F.col("_fx"), F.col("_fy")
    mixed = {c: (1 - fy) * ((1 - fx) * F.col(f"_{c}0") + fx * F.col(f"_{c}1")) + fy * ((1 - fx) * F.col(f"_{c}2") + fx * F.col(f"_{c}3")) for c in names}
    return at.select(*points.columns, *(e.alias(c) for c, e in mixed.items()))


def resize_up(pixels: DataFrame, factor: float) -> DataFrame:
    keys = pixels.select("image_id", "width", "height", "lo", "hi").distinct()
    keys = keys.withColumns({"_nw": _new_size("width", factor), "_nh": _new_size("height", factor)})
    grid = keys.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("_nh") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("_nw") - 1)))
    points = grid.select("image_id", F.col("_nw").alias("width"), F.col("_nh").alias("height"), "lo", "hi", "y", "x", ((F.col("x") + 0.5) * F.col("width") / F.col("_nw") - 0.5).alias("px"), ((F.col("y") + 0.5) * F.col("height") / F.col("_nh") - 0.5).alias("py"))
    return bilinear(pixels, points).drop("px", "py")


def line_profile(pixels: DataFrame, x0: float, y0: float, x1: float, y1: float, units_per_pixel: float = 1.0) -> DataFrame:
    """(image_id, i, distance, value) along a line: about one sample per pixel, bilinear at pixel centres."""
    length = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
    n = max(2, -int(-length // 1) + 1)
    spark = pixels.sparkSession
    t = F.col("id") / (n - 1)
    g = stats.gray_values(pixels)
    samples = spark.range(n).select(F.col("id").cast("int").alias("i"), (t * length * units_per_pixel).alias("distance"), (F.lit(float(x0)) + t * (x1 - x0) - 0.5).alias("px"), (F.lit(float(y0)) + t * (y1 - y0) - 0.5).alias("py"))
    points = g.select("image_id").distinct().crossJoin(F.broadcast(samples))
    return bilinear(g, points).select("image_id", "i", "distance", F.col("v").alias("value"))


def region_box(points: list[tuple[float, float]], width: int, height: int) -> tuple[int, int, int, int]:
    """Pixel rectangle (x, y, width, height) of a region, cut at the image's edges; for cropping to it."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    x0, y0 = (min(max(int(v // 1), 0), n) for v, n in ((min(xs), width), (min(ys), height)))
    x1, y1 = (min(max(-int(-v // 1), 0), n) for v, n in ((max(xs), width), (max(ys), height)))
    return x0, y0, max(0, x1 - x0), max(0, y1 - y0)
