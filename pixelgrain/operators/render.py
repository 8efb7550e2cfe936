"""Display: ranges, colour maps, overlays and blending as pixel relations; alpha, red, green, blue are 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import is_color, value_columns
from . import stats
from .filters import neighbour

MAPS = ("gray", "fire", "viridis")
#: Stops of the viridis map (place, red, green, blue).
VIRIDIS = ((0.0, 68, 1, 84), (0.13, 71, 44, 122), (0.25, 59, 81, 139), (0.38, 44, 113, 142), (0.5, 33, 144, 141), (0.63, 39, 173, 129), (0.75, 92, 200, 99), (0.88, 170, 220, 50), (1.0, 253, 231, 37))
#: Colours of marks, of negative, selected and excluded objects.
MARK, NEGATIVE, SELECTED, EXCLUDED = (0xFF, 0x5F, 0xAA), (0x4C, 0xC9, 0xF0), (0x45, 0xD1, 0x9A), (0x9A, 0xA5, 0xAC)


def byte(c: Column) -> Column:
    """Rounded half up and clamped."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(c + 0.5).cast("int")))


def lut(name: str) -> list[tuple[int, int, int]]:
    """256 colours of a map."""

    def level(v: float) -> int:
        return min(255, max(0, int(v + 0.5))) if v > 0 else 0

    out = []
    for i in range(256):
        t = i / 255
        if name == "fire":
            out.append(tuple(level((3 * t - k) * 255) for k in range(3)))
        elif name == "viridis":
            k = max(j for j in range(len(VIRIDIS) - 1) if j == 0 or t > VIRIDIS[j][0])
            a, b = VIRIDIS[k], VIRIDIS[k + 1]
            f = (t - a[0]) / (b[0] - a[0])
            out.append(tuple(level(p + (q - p) * f) for p, q in zip(a[1:], b[1:], strict=True)))
        else:
            out.append((i, i, i))
    return out


def display_range(pixels: DataFrame) -> DataFrame:
    """(image_id, dlo, dhi): 0 to 255 for 8-bit images, else the 0.1 % and 99.9 % quantiles of 2048 bins."""
    g = stats.gray_values(pixels)
    info = g.groupBy("image_id").agg(((F.first("lo") == 0) & (F.first("hi") == 255)).alias("eight"), F.min("v").alias("vmin"), F.max("v").alias("vmax"))
    ranges = info.where("NOT eight AND vmax > vmin").select("image_id", F.col("vmin").alias("low"), F.col("vmax").alias("high"))
    hist = stats.histogram(g.join(ranges.select("image_id"), "image_id", "left_semi"), 2048, ranges)
    a = stats.histogram_quantile(hist, 0.001, 2048).withColumnRenamed("quantile", "qa")
    b = stats.histogram_quantile(hist, 0.999, 2048).withColumnRenamed("quantile", "qb")
    d = info.join(a, "image_id", "left").join(b, "image_id", "left")
    ok = F.col("qb") > F.col("qa")
    low = F.when(F.col("eight"), F.lit(0.0)).when(ok, F.col("qa")).otherwise(F.col("vmin"))
    high = F.when(F.col("eight"), F.lit(255.0)).when(ok, F.col("qb")).when(F.col("vmax") > F.col("vmin"), F.col("vmax")).otherwise(F.col("vmin") + 1)
    return d.select("image_id", low.alias("dlo"), high.alias("dhi"))


def colorize(pixels: DataFrame, name: str = "gray", ranges: DataFrame | None = None) -> DataFrame:
    """(image_id, y, x, red, green, blue) of an image under a linear stretch; maps colour gray images only."""
    d = pixels.join(ranges if ranges is not None else display_range(pixels), "image_id")
    scale = 255.0 / F.greatest(F.col("dhi") - F.col("dlo"), F.lit(1e-9))
    levels = {c: byte((F.col(c) - F.col("dlo")) * scale) for c in value_columns(pixels)}
    if is_color(pixels):
        return d.select("image_id", "y", "x", levels["r"].alias("red"), levels["g"].alias("green"), levels["b"].alias("blue"))
    table = lut(name)
    pick = lambda k: F.element_at(F.array(*(F.lit(row[k]) for row in table)), levels["v"] + 1)
    return d.select("image_id", "y", "x", pick(0).alias("red"), pick(1).alias("green"), pick(2).alias("blue"))


def _edge(column: str) -> Column:
    """Whether a pixel is at the image border or differs from one of its four neighbours."""
    same = (neighbour(column, "x", -1) == F.col(column)) & (neighbour(column, "x", 1) == F.col(column)) & (neighbour(column, "y", -1) == F.col(column)) & (neighbour(column, "y", 1) == F.col(column))
    border = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("width") - 1) | (F.col("y") == F.col("height") - 1)
    return border | ~same


def _paint(d: DataFrame, color: Column, alpha: Column) -> DataFrame:
    return d.withColumns({"_c": color, "alpha": alpha}).select("image_id", "y", "x", "alpha", F.col("_c")[0].alias("red"), F.col("_c")[1].alias("green"), F.col("_c")[2].alias("blue"))


def _rgb(c: tuple[int, int, int]) -> Column:
    return F.array(*(F.lit(v) for v in c))


def mask_overlay(mask: DataFrame, color: tuple[int, int, int] = MARK) -> DataFrame:
    """Object pixels with alpha 255 on the outline and 110 inside."""
    d = mask.withColumn("_e", _edge("m")).where("m")
    return _paint(d, _rgb(color), F.when(F.col("_e"), 255).otherwise(110))


def object_color(id_: Column) -> Column:
    """Hues a golden angle apart, saturation 0.65, full value."""
    h = (id_ * 137.508) % 360
    c = 0.65
    x = c * (1 - F.abs((h / 60) % 2 - 1))
    m, top = 1 - c, F.lit(c)
    sector = F.floor(h / 60).cast("int")
    zero = F.lit(0.0)
    pick = lambda *v: F.element_at(F.array(*v), sector + 1)
    parts = (pick(top, x, zero, zero, x, top), pick(x, top, top, x, zero, zero), pick(zero, zero, x, top, top, x))
    return F.array(*(byte((p + m) * 255) for p in parts))


def label_overlay(labels: DataFrame, coloring: str = "uniform", selected: int = 0, positive: DataFrame | None = None) -> DataFrame:
    """Objects in one colour, a colour each, or by class (positive: image_id, id, positive)."""
    d = labels.withColumn("_e", _edge("label")).where("label > 0")
    color = _rgb(MARK)
    if coloring == "per_object":
        color = object_color(F.col("label"))
    elif coloring == "classified" and positive is not None:
        d = d.join(positive.select("image_id", F.col("id").alias("label"), F.col("positive").alias("_p")), ["image_id", "label"], "left")
        color = F.when(F.coalesce("_p", F.lit(False)), _rgb(MARK)).otherwise(_rgb(NEGATIVE))
    chosen = F.col("label") == selected
    return _paint(d, F.when(chosen, _rgb(SELECTED)).otherwise(color), F.when(F.col("_e"), 255).when(chosen, 150).otherwise(100))


def excluded_overlay(mask: DataFrame) -> DataFrame:
    """Dotted gray outline and a sparse pattern inside for objects that were taken out by hand."""
    d = mask.withColumn("_e", _edge("m")).where("m")
    s = F.col("x") + F.col("y")
    alpha = F.when(F.col("_e"), F.when(F.expr("((x + y) div 2) % 2 = 0"), 255).otherwise(60)).when(s % 6 == 0, 140)
    return _paint(d.withColumn("_a", alpha).where("_a IS NOT NULL"), _rgb(EXCLUDED), F.col("_a"))


def compose(base: DataFrame, overlay: DataFrame, opacity: float = 1.0) -> DataFrame:
    """Overlay blended over a base of the same size; rounded half to even."""
    names = ("red", "green", "blue")
    top = overlay.select("image_id", "y", "x", F.col("alpha").alias("_a"), *(F.col(c).alias(f"_{c}") for c in names))
    d = base.join(top, ["image_id", "y", "x"], "left")
    a = F.col("_a") / 255.0 * opacity
    return d.select("image_id", "y", "x", *(F.when(a > 0, F.rint(F.col(c) * (1 - a) + F.col(f"_{c}") * a).cast("int")).otherwise(F.col(c)).alias(c) for c in names))


def mask_image(mask: DataFrame) -> DataFrame:
    level = F.when(F.col("m"), 255).otherwise(0)
    return mask.select("image_id", "y", "x", level.alias("red"), level.alias("green"), level.alias("blue"))
