"""Per-pixel adjustments as projections; histogram-driven ones join a table of a few rows per image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import MAX_DENSITY, density, luma, stain_weights
from ..model import clamp, is_color, map_values
from . import stats

CHANNELS = ("r", "g", "b")
MEASURED = ("luminance", "red", "green", "blue", "hematoxylin", "eosin", "dab")


def _require_color(pixels: DataFrame) -> None:
    if not is_color(pixels):
        raise ValueError("this step needs a colour image")


def gray(pixels: DataFrame) -> DataFrame:
    return stats.gray_values(pixels)


def channel(pixels: DataFrame, index: int = 0) -> DataFrame:
    if not is_color(pixels):
        return pixels
    return pixels.withColumn("v", F.col(CHANNELS[index])).drop(*CHANNELS)


def stain(pixels: DataFrame, name: str = "dab") -> DataFrame:
    """Amount of a stain as a gray image of 0 to 3."""
    _require_color(pixels)
    lo, hi = F.col("lo"), F.col("hi")
    amount = sum((density(F.col(c), lo, hi) * w for c, w in zip(CHANNELS, stain_weights(name), strict=True)), F.lit(0.0))
    return pixels.withColumn("v", clamp(amount, F.lit(0.0), F.lit(MAX_DENSITY))).withColumns({"lo": F.lit(0.0), "hi": F.lit(MAX_DENSITY)}).drop(*CHANNELS)


def invert(pixels: DataFrame) -> DataFrame:
    return map_values(pixels, lambda v: clamp(F.col("lo") + F.col("hi") - v))


def window_level(pixels: DataFrame, level: float, width: float) -> DataFrame:
    if not width > 0:
        raise ValueError("the width must be positive")
    out = map_values(pixels, lambda v: clamp((v - (level - width / 2)) * (255.0 / width), F.lit(0.0), F.lit(255.0)))
    return out.withColumns({"lo": F.lit(0.0), "hi": F.lit(255.0)})


def _stretched(v: Column, low: Column, high: Column) -> Column:
    return clamp(F.col("lo") + (v - low) * ((F.col("hi") - F.col("lo")) / (high - low)))


def stretch(pixels: DataFrame, low: float, high: float) -> DataFrame:
    return map_values(pixels, lambda v: _stretched(v, F.lit(float(low)), F.lit(float(high))))


def auto_contrast(pixels: DataFrame, saturated_percent: float = 0.35) -> DataFrame:
    """Stretch between two quantiles of a 1024-bin histogram; images where they meet stay as they are."""
    gray_px = stats.gray_values(pixels)
    ranges = gray_px.groupBy("image_id").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("high > low")
    hist = stats.histogram(gray_px, 1024, ranges)
    p = min(max(saturated_percent, 0.0), 49.0) / 100
    lows = stats.histogram_quantile(hist, p, 1024).withColumnRenamed("quantile", "_low")
    highs = stats.histogram_quantile(hist, 1 - p, 1024).withColumnRenamed("quantile", "_high")
    bounds = lows.join(highs, "image_id").where("_high > _low")
    joined = pixels.join(bounds, "image_id", "left")
    return map_values(joined, lambda v: F.when(F.col("_low").isNull(), v).otherwise(_stretched(v, F.col("_low"), F.col("_high")))).drop("_low", "_high")


def brightness_contrast(pixels: DataFrame, brightness_percent: float = 0.0, contrast: float = 1.0) -> DataFrame:
    span = F.col("hi") - F.col("lo")
    mid = F.col("lo") + span / 2
    return map_values(pixels, lambda v: clamp((v - mid) * contrast + mid + (brightness_percent / 100) * span))


def gamma(pixels: DataFrame, value: float = 0.7) -> DataFrame:
    if not value > 0:
        raise ValueError("gamma must be positive")
    span = F.col("hi") - F.col("lo")
    return map_values(pixels, lambda v: clamp(F.col("lo") + span * F.pow(clamp((v - F.col("lo")) / span, F.lit(0.0), F.lit(1.0)), F.lit(value))))


def replace_luminance(pixels: DataFrame, old: Column, new: Column) -> DataFrame:
    """Gray: the new value. Colour: channels scaled by new over old luminance, the new value where the old is dark."""
    if not is_color(pixels):
        return pixels.withColumn("v", new)
    k = F.try_divide(new - F.col("lo"), old - F.col("lo"))
    return map_values(pixels, lambda v: clamp(F.when(old - F.col("lo") <= 1e-6, new).otherwise(F.col("lo") + (v - F.col("lo")) * k)))


def _luminance(pixels: DataFrame) -> Column:
    return luma(*(F.col(c) for c in CHANNELS)) if is_color(pixels) else F.col("v")


def equalize(pixels: DataFrame) -> DataFrame:
    """256-bin cumulative distribution over the data's range, spread over the nominal range."""
    with_y = pixels.withColumn("_y", _luminance(pixels))
    ranges = with_y.groupBy("image_id").agg(F.min("_y").alias("low"), F.max("_y").alias("_top")).where("_top > low").select("image_id", "low", (F.col("_top") + 1e-3).alias("high"))
    hist = stats.histogram(with_y.select("image_id", F.col("_y").alias("v")), 256, ranges)
    cdf = hist.withColumn("_cdf", F.sum("n").over(W.partitionBy("image_id").orderBy("bin")) / F.sum("n").over(W.partitionBy("image_id"))).select("image_id", F.col("bin").alias("_bin"), "_cdf")
    binned = with_y.join(ranges, "image_id", "left").withColumn("_bin", stats.bin_of(F.col("_y"), F.col("low"), F.col("high"), 256)).drop("low", "high")
    joined = binned.join(cdf, ["image_id", "_bin"], "left")
    new = F.coalesce(F.col("lo") + F.col("_cdf") * (F.col("hi") - F.col("lo")), F.col("_y"))
    return replace_luminance(joined, F.col("_y"), new).drop("_y", "_bin", "_cdf")


def clahe(pixels: DataFrame, tiles: int = 8, clip: float = 2.5) -> DataFrame:
    """Equalisation per tile with clipped counts, blended between the four nearest tile centres.

    The tile maps are image x tiles x 256 rows; pixels look up their four by equi-joins on (image, tile, bin).
    """
    bins, tiles = 256, min(max(int(tiles), 1), 32)
    with_y = pixels.withColumn("_y", _luminance(pixels))
    ranges = with_y.groupBy("image_id").agg(F.min("_y").alias("_vmin"), F.max("_y").alias("_vmax")).where("_vmax > _vmin")
    d = with_y.join(ranges, "image_id", "left")
    d = d.withColumn("_bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("_y") - F.col("_vmin")) * (bins / (F.col("_vmax") - F.col("_vmin") + 1e-6))).cast("int"))))
    for axis, size in (("x", "width"), ("y", "height")):
        count = F.least(F.lit(tiles), F.col(size))
        step = F.col(size) / count
        # the tile that holds a pixel has integer bounds floor(k * step)
        guess = F.floor((F.col(axis) + 1) / step - 1e-12)
        own = F.greatest(F.lit(0), F.least(count - 1, F.when(F.floor(guess * step) > F.col(axis), guess - 1).otherwise(guess)))
        place = (F.col(axis) + 0.5) / step - 0.5
        a = F.greatest(F.lit(0), F.least(count - 1, F.floor(place)))
        d = d.withColumns({f"_t{axis}": own.cast("int"), f"_{axis}a": a.cast("int"), f"_{axis}b": F.least(a + 1, count - 1).cast("int"), f"_f{axis}": clamp(place - a, F.lit(0.0), F.lit(1.0))})
    counts = d.where("_bin IS NOT NULL").groupBy("image_id", "_ty", "_tx", "_bin").agg(F.count(F.lit(1)).cast("double").alias("n"))
    frame = counts.select("image_id", "_ty", "_tx").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("_bin"))
    full = frame.join(counts, ["image_id", "_ty", "_tx", "_bin"], "left").fillna(0.0, ["n"])
    tile = W.partitionBy("image_id", "_ty", "_tx")
    limit = F.greatest(F.lit(1.0), F.lit(clip) * F.col("total") / bins)
    full = full.withColumn("total", F.sum("n").over(tile)).withColumn("cut", F.least("n", limit)).withColumn("extra", F.sum(F.greatest(F.col("n") - limit, F.lit(0.0))).over(tile) / bins)
    maps = full.select("image_id", "_ty", "_tx", "_bin", (F.sum(F.col("cut") + F.col("extra")).over(tile.orderBy("_bin")) / F.col("total")).alias("_map"))
    for k, (ty, tx) in enumerate((("_ya", "_xa"), ("_ya", "_xb"), ("_yb", "_xa"), ("_yb", "_xb"))):
        own = maps.select("image_id", F.col("_ty").alias(ty), F.col("_tx").alias(tx), "_bin", F.col("_map").alias(f"_m{k}"))
        d = d.join(own, ["image_id", ty, tx, "_bin"], "left")
    fx, fy = F.col("_fx"), F.col("_fy")
    blend = (1 - fy) * ((1 - fx) * F.col("_m0") + fx * F.col("_m1")) + fy * ((1 - fx) * F.col("_m2") + fx * F.col("_m3"))
    new = F.coalesce(F.col("lo") + blend * (F.col("hi") - F.col("lo")), F.col("_y"))
    out = replace_luminance(d, F.col("_y"), new)
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def measured(pixels: DataFrame, name: str = "luminance") -> tuple[DataFrame, bool]:
    """(gray image of a measured channel, whether a gray input fell back to luminance)."""
    if name not in MEASURED:
        raise ValueError(f"unknown channel {name!r}")
    if name == "luminance" or not is_color(pixels):
        return gray(pixels), name != "luminance"
    if name in ("red", "green", "blue"):
        return channel(pixels, ("red", "green", "blue").index(name)), False
    return stain(pixels, {"hematoxylin": "hematoxylin_hdab", "eosin": "eosin_he", "dab": "dab"}[name]), False
