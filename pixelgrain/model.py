"""Data model: images as rows with a float array, and pixel frames as relations.

``images``: image_id, width, height, channels (1 or 3), nominal_min, nominal_max, data ARRAY<FLOAT> (row-major,
interleaved). ``pixels``: image_id, width, height, lo, hi, y, x and v (gray) or r, g, b (colour); lo and hi are the
nominal range, which is never inferred from the data. ``masks`` and ``labels`` are pixel relations with m BOOLEAN or
label INT. image_id is part of every key, so every operator works on any number of images at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE_SCHEMA = "image_id string, width int, height int, channels int, nominal_min float, nominal_max float, data array<float>"
KEY = ["image_id", "width", "height", "lo", "hi"]
GRAY = [*KEY, "y", "x", "v"]
COLOR = [*KEY, "y", "x", "r", "g", "b"]


def is_color(pixels: DataFrame) -> bool:
    return "r" in pixels.columns


def value_columns(pixels: DataFrame) -> list[str]:
    return ["r", "g", "b"] if is_color(pixels) else ["v"]


def map_values(pixels: DataFrame, f) -> DataFrame:
    """f(column) applied to every channel."""
    return pixels.withColumns({c: f(F.col(c)) for c in value_columns(pixels)})


def clamp(c: Column, lo: Column | str = "lo", hi: Column | str = "hi") -> Column:
    low, high = (F.col(e) if isinstance(e, str) else e for e in (lo, hi))
    return F.greatest(low, F.least(high, c))


def explode_pixels(images: DataFrame, channels: int) -> DataFrame:
    """Pixel frame of the images with that many channels."""
    own = images.where(F.col("channels") == channels)
    base = own.select("image_id", "width", "height", F.col("nominal_min").cast("double").alias("lo"), F.col("nominal_max").cast("double").alias("hi"), F.posexplode(_groups(channels)).alias("i", "p"))
    names = ["v"] if channels == 1 else ["r", "g", "b"]
    values = [F.col("p").cast("double").alias("v")] if channels == 1 else [F.col("p")[k].cast("double").alias(n) for k, n in enumerate(names)]
    return base.select(*KEY, F.expr("cast(i div width as int)").alias("y"), (F.col("i") % F.col("width")).alias("x"), *values)


def _groups(channels: int) -> Column:
    if channels == 1:
        return F.col("data")
    return F.expr("transform(sequence(0, width * height - 1), i -> slice(data, i * 3 + 1, 3))")


def implode_pixels(pixels: DataFrame) -> DataFrame:
    """One row per image with its samples in raster order; the order comes from the positions, not from the scan."""
    names = value_columns(pixels)
    at = (F.col("y") * F.col("width") + F.col("x")).alias("i")
    values = F.array(*(F.col(n).cast("float") for n in names)).alias("p")
    cells = pixels.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(at, values))).alias("cells"))
    return cells.select(
        "image_id",
        "width",
        "height",
        F.lit(len(names)).alias("channels"),
        F.col("lo").cast("float").alias("nominal_min"),
        F.col("hi").cast("float").alias("nominal_max"),
        F.flatten(F.col("cells.p")).alias("data"),
    )
