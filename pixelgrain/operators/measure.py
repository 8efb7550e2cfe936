"""Measurement of labelled objects: one aggregation for sums, Arrow kernels for outlines, projections for the rest."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import kernels
from . import stats


@dataclass(frozen=True)
class Calibration:
    units_per_pixel: float = 1.0
    unit: str = "px"

    def __post_init__(self) -> None:
        if not (self.units_per_pixel > 0 and math.isfinite(self.units_per_pixel)) or not self.unit.strip():
            raise ValueError("a calibration needs a positive length and a unit")

    @classmethod
    def from_known_length(cls, pixels: float, length: float, unit: str) -> Calibration:
        if not pixels > 0:
            raise ValueError("the measured length must be positive")
        return cls(length / pixels, unit)

    @property
    def is_calibrated(self) -> bool:
        return self.unit != "px"

    @property
    def area_unit(self) -> str:
        return self.unit + "²"

    def length(self, pixels: float) -> float:
        return pixels * self.units_per_pixel

    def area(self, pixels: float) -> float:
        return pixels * self.units_per_pixel**2

    def scaled(self, factor: float) -> Calibration:
        """Calibration after resizing by factor."""
        return Calibration(self.units_per_pixel / factor, self.unit) if self.is_calibrated else self

    def __str__(self) -> str:
        return f"1 px = {self.units_per_pixel:.6g} {self.unit}"


@dataclass(frozen=True)
class PositiveRule:
    threshold: float
    above: bool = True


@dataclass(frozen=True)
class Options:
    """Sizes are in calibrated units; max_area 0 means none."""

    min_area: float = 0.0
    max_area: float = 0.0
    exclude_edges: bool = False
    eight_connected: bool = True
    exclude_points: tuple[tuple[float, float], ...] = ()
    positive: PositiveRule | None = None
    intensity_label: str = "luminance"
    calibration: Calibration = field(default_factory=Calibration)


def accumulate(labels: DataFrame, intensity: DataFrame | None = None) -> DataFrame:
    """Sums per object: pixels, moments of pixel centres, intensity sums, box, edge flag. One hash aggregation.

    labels may carry a boolean column inner that is false where a neighbour lies outside a region of interest.
    """
    d = labels.where("label > 0")
    if intensity is not None:
        d = d.join(stats.gray_values(intensity).select("image_id", "y", "x", "v"), ["image_id", "y", "x"], "left")
    else:
        d = d.withColumn("v", F.lit(None).cast("double"))
    cx, cy, v = F.col("x") + 0.5, F.col("y") + 0.5, F.col("v")
    edge = "x = 0 OR y = 0 OR x = width - 1 OR y = height - 1" + (" OR NOT inner" if "inner" in labels.columns else "")
    return d.groupBy("image_id", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(cx).alias("sx"), F.sum(cy).alias("sy"), F.sum(cx * cx).alias("sxx"), F.sum(cy * cy).alias("syy"), F.sum(cx * cy).alias("sxy"),
        F.sum(v).alias("si"), F.sum(v * v).alias("sii"), F.min(v).alias("imin"), F.max(v).alias("imax"),
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.max(F.expr(edge)).alias("edge"),
    )


def outlines(labels: DataFrame) -> DataFrame:
    """(image_id, label, perimeter, feret, hull_area) in pixels; one Arrow group per object, so a task holds one object."""

    def run(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        shape = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
        shape[y - y.min(), x - x.min()] = True
        feret, hull = kernels.hull_measures(shape)
        return pa.table({"image_id": [table.column("image_id")[0].as_py()], "label": pa.array([table.column("label")[0].as_py()], pa.int32()), "perimeter": [kernels.perimeter(shape)], "feret": [feret], "hull_area": [hull]})

    own = labels.where("label > 0").select("image_id", "label", "y", "x")
    return own.groupBy("image_id", "label").applyInArrow(run, "image_id string, label int, perimeter double, feret double, hull_area double")


def feret_by_rows(labels: DataFrame) -> DataFrame:
    """Largest diameter as a relation: the outer corners of each row of an object, paired within the object."""
    rows = labels.where("label > 0").groupBy("image_id", "label", "y").agg(F.min("x").alias("a"), (F.max("x") + 1).alias("b"))
    corner = F.explode(F.array(*(F.struct(F.col(c).alias("px"), (F.col("y") + d).alias("py")) for c in ("a", "b") for d in (0, 1))))
    pts = rows.select("image_id", "label", corner.alias("p")).select("image_id", "label", "p.px", "p.py").distinct()
    other = pts.select("image_id", "label", F.col("px").alias("qx"), F.col("py").alias("qy"))
    gap = F.sqrt(F.pow(F.col("px") - F.col("qx"), 2) + F.pow(F.col("py") - F.col("qy"), 2))
    return pts.join(other, ["image_id", "label"]).groupBy("image_id", "label").agg(F.max(gap).alias("feret"))


def moments(sums: DataFrame) -> DataFrame:
    """Centroid and fitted ellipse in pixels from accumulated sums; angles count from +x, y upward, in 0 to 180."""
    n = F.col("n")
    d = sums.withColumns({"centroid_x": F.col("sx") / n, "centroid_y": F.col("sy") / n})
    mx, my = F.col("centroid_x"), F.col("centroid_y")
    d = d.withColumns({"_20": F.col("sxx") / n - mx * mx + 1.0 / 12, "_02": F.col("syy") / n - my * my + 1.0 / 12, "_11": F.col("sxy") / n - mx * my})
    half, mid = (F.col("_20") - F.col("_02")) / 2, (F.col("_20") + F.col("_02")) / 2
    root = F.sqrt(half * half + F.col("_11") * F.col("_11"))
    raw = -0.5 * F.atan2(2 * F.col("_11"), F.col("_20") - F.col("_02")) * 180 / math.pi
    return d.withColumns({"major_axis": 4 * F.sqrt(mid + root), "minor_axis": 4 * F.sqrt(F.greatest(mid - root, F.lit(1e-12))), "angle": F.when(raw < 0, raw + 180).otherwise(raw)}).drop("_20", "_02", "_11")


def particles(labels: DataFrame, intensity: DataFrame | None = None, options: Options | None = None, shapes: bool = True) -> DataFrame:
    """One row per kept object with all measures; ids are renumbered in label order.

    Filters apply in order: smallest area, largest area, edge, excluded points. Without filters ids equal labels.
    """
    o = options or Options()
    u = o.calibration.units_per_pixel
    d = dropped(labels, accumulate(labels, intensity), o).where("reason IS NULL").drop("reason")
    d = moments(d)
    if shapes:
        d = d.join(outlines(labels), ["image_id", "label"])
    else:
        d = d.withColumns({c: F.lit(0.0) for c in ("perimeter", "feret", "hull_area")})
    n = F.col("n").cast("double")
    has = intensity is not None
    value = lambda c: F.coalesce(c, F.lit(0.0)) if has else F.lit(0.0)
    sd = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("sii") - F.col("si") * F.col("si") / n, n - 1))))
    mean = F.col("si") / n
    rule = o.positive
    positive = F.lit(None).cast("boolean") if rule is None or not has else (mean >= rule.threshold if rule.above else mean < rule.threshold)
    return d.select(
        "image_id",
        F.row_number().over(W.partitionBy("image_id").orderBy("label")).alias("id"),
        F.col("n").cast("int").alias("pixel_count"),
        (n * u * u).alias("area"),
        (F.col("perimeter") * u).alias("perimeter"),
        F.when(F.col("perimeter") > 0, F.least(F.lit(1.0), 4 * math.pi * n / (F.col("perimeter") * F.col("perimeter")))).otherwise(F.lit(0.0)).alias("circularity"),
        "centroid_x",
        "centroid_y",
        (2 * F.sqrt(n / math.pi) * u).alias("equivalent_diameter"),
        (F.col("major_axis") * u).alias("major_axis"),
        (F.col("minor_axis") * u).alias("minor_axis"),
        "angle",
        (F.col("major_axis") / F.col("minor_axis")).alias("aspect_ratio"),
        (F.col("feret") * u).alias("feret"),
        F.when(F.col("hull_area") > 0, F.least(F.lit(1.0), n / F.col("hull_area"))).otherwise(F.lit(1.0)).alias("solidity"),
        value(mean).alias("mean_intensity"),
        value(sd).alias("std_intensity"),
        value(F.col("imin")).alias("min_intensity"),
        value(F.col("imax")).alias("max_intensity"),
        value(F.col("si")).alias("integrated_intensity"),
        F.col("x0").alias("bounds_x"),
        F.col("y0").alias("bounds_y"),
        (F.col("x1") - F.col("x0") + 1).alias("bounds_width"),
        (F.col("y1") - F.col("y0") + 1).alias("bounds_height"),
        F.col("edge").alias("touches_edge"),
        positive.alias("positive"),
    )


def dropped(labels: DataFrame, sums: DataFrame, o: Options) -> DataFrame:
    """sums with reason: null for kept objects, else the first filter that drops one."""
    area = F.col("n") * o.calibration.units_per_pixel**2
    d = sums
    if o.exclude_points:
        wanted = {(math.floor(y), math.floor(x)) for x, y in o.exclude_points}
        points = labels.sparkSession.createDataFrame(sorted(wanted), "y int, x int")
        hit = labels.where("label > 0").join(F.broadcast(points), ["y", "x"]).select("image_id", "label").distinct().withColumn("_out", F.lit(True))
        d = d.join(hit, ["image_id", "label"], "left")
    else:
        d = d.withColumn("_out", F.lit(None).cast("boolean"))
    reason = F.when(area < o.min_area, "small")
    if o.max_area > 0:
        reason = reason.when(area > o.max_area, "large")
    if o.exclude_edges:
        reason = reason.when(F.col("edge"), "edge")
    return d.withColumn("reason", reason.when(F.col("_out"), "excluded")).drop("_out")


def summary(images: DataFrame, found: DataFrame, options: Options | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """One row per image, zeros for images without objects. images: (image_id, analyzed_pixels)."""
    o = options or Options()
    square = o.calibration.units_per_pixel**2
    agg = found.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("count"), F.sum("pixel_count").alias("_px"), F.avg("area").alias("mean_area"), F.percentile("area", F.lit(0.5)).alias("median_area"), F.coalesce(F.stddev_samp("area"), F.lit(0.0)).alias("std_area"), F.avg("circularity").alias("mean_circularity"), F.sum("integrated_intensity").alias("_i"), F.count_if(F.coalesce(F.col("positive"), F.lit(False))).alias("positive_count")
    )
    d = images.join(agg, "image_id", "left").fillna(0).fillna(0.0)
    out = excluded.groupBy("image_id").agg(F.count(F.lit(1)).alias("excluded_count")) if excluded is not None else None
    d = d.join(out, "image_id", "left").fillna(0, ["excluded_count"]) if out is not None else d.withColumn("excluded_count", F.lit(0).cast("long"))
    whole = F.col("analyzed_pixels") * square
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    percent = share(100.0 * F.col("positive_count"), F.col("count")) if o.positive is not None else F.lit(0.0)
    return d.select(
        "image_id", "count", (F.col("_px") * square).alias("total_area"), "mean_area", "median_area", "std_area", whole.alias("analyzed_area"), share(100.0 * F.col("_px"), F.col("analyzed_pixels")).alias("area_fraction"), "mean_circularity",
        share(F.col("_i"), F.col("_px")).alias("mean_intensity"), share(F.col("count").cast("double"), whole).alias("density"), F.lit(o.calibration.area_unit).alias("area_unit"), F.lit(o.calibration.unit).alias("length_unit"), F.lit(o.intensity_label).alias("intensity_label"), "excluded_count", "positive_count", percent.alias("positive_percent"),
    )


#: Features by key: (class of unit, header). An unknown key means area.
FEATURES = {
    "area": ("area", "Area"), "perimeter": ("length", "Perimeter"), "circularity": ("none", "Circularity"), "equivalent_diameter": ("length", "Equivalent diameter"), "major_axis": ("length", "Major axis"), "minor_axis": ("length", "Minor axis"), "angle": ("degree", "Angle"),
    "aspect_ratio": ("none", "Aspect ratio"), "feret": ("length", "Feret diameter"), "solidity": ("none", "Solidity"), "mean_intensity": ("intensity", "Mean intensity"), "std_intensity": ("intensity", "Intensity sd"), "integrated_intensity": ("intensity", "Integrated intensity"),
}


def feature_header(key: str, options: Options | None = None) -> str:
    o = options or Options()
    kind, title = FEATURES.get(key, FEATURES["area"])
    unit = {"area": o.calibration.area_unit, "length": o.calibration.unit, "degree": "°", "intensity": o.intensity_label, "none": ""}[kind]
    return f"{title} ({unit})" if unit else title


def sort_particles(found: DataFrame, key: str = "id", descending: bool | None = None) -> DataFrame:
    """By id ascending, by any measure descending first; ties by image and id."""
    column = key if key in ("id", "positive") or key in FEATURES else "area"
    down = column != "id" if descending is None else descending
    return found.orderBy(F.col(column).desc() if down else F.col(column), "image_id", "id")


def first_rows(found: DataFrame, n: int = 300) -> DataFrame:
    return found.orderBy("image_id", "id").limit(n)


def auto_positive_threshold(found: DataFrame) -> DataFrame:
    """(threshold) of mean intensities by Otsu's method, rounded to 4 places; needs two objects."""
    return stats.otsu_values(found, "mean_intensity").select(F.bround("threshold", 4).alias("threshold"))


def labels_at(labels: DataFrame, points: DataFrame) -> DataFrame:
    """(image_id, px, py, label) of the objects under points (image_id, px, py); points on background or outside have none."""
    at = points.select("image_id", "px", "py", F.floor("px").cast("int").alias("x"), F.floor("py").cast("int").alias("y"))
    return at.join(labels.where("label > 0").select("image_id", "x", "y", "label"), ["image_id", "x", "y"]).select("image_id", "px", "py", "label")


def toggle_exclusion(labels: DataFrame, excluded: DataFrame, click: DataFrame) -> DataFrame:
    """Excluded points after a click: an object without points gets this one, an excluded object loses all of its points."""
    clicked = labels_at(labels, click)
    own = labels_at(labels, excluded)
    hit = own.join(clicked.select("image_id", "label"), ["image_id", "label"], "left_semi")
    kept = excluded.join(hit.select("image_id", "px", "py"), ["image_id", "px", "py"], "left_anti")
    added = clicked.join(own.select("image_id", "label"), ["image_id", "label"], "left_anti").select("image_id", "px", "py")
    return kept.select("image_id", "px", "py").unionByName(added)
