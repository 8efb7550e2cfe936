"""Mask refinement: whole-image kernels grouped by image, relational forms where the plan stays linear."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import kernels
from .segment import MASK

_PIXEL = "image_id string, width int, height int, y int, x int"


def per_image(mask: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], name: str = "m", kind: str = "boolean") -> DataFrame:
    """kernel over each image's mask as an array; one Arrow group per image, pixels come back as rows."""

    def run(table: pa.Table) -> pa.Table:
        image, w, h = table.column("image_id")[0].as_py(), table.column("width")[0].as_py(), table.column("height")[0].as_py()
        grid = np.zeros((h, w), bool)
        grid[table.column("y").to_numpy(), table.column("x").to_numpy()] = table.column("m").to_numpy(zero_copy_only=False)
        out = kernel(grid)
        ys, xs = np.divmod(np.arange(w * h, dtype=np.int32), np.int32(w))
        same = lambda v, t: pa.array(np.full(w * h, v, t)) if not isinstance(v, str) else pa.array([v]).take(pa.array(np.zeros(w * h, np.int32)))
        return pa.table({"image_id": same(image, None), "width": same(w, np.int32), "height": same(h, np.int32), "y": pa.array(ys), "x": pa.array(xs), name: pa.array(out.ravel())})

    return mask.select(*MASK).groupBy("image_id").applyInArrow(run, f"{_PIXEL}, {name} {kind}")


def labels(mask: DataFrame, eight: bool = True) -> DataFrame:
    """label INT per pixel, 0 for background, numbered in raster order of first pixels."""
    return per_image(mask, lambda m: kernels.label(m, eight)[0].astype(np.int32), "label", "int")


def distance_to_background(mask: DataFrame) -> DataFrame:
    return per_image(mask, lambda m: kernels.distance_to_background(m), "d", "double")


def distance_to_foreground(mask: DataFrame) -> DataFrame:
    """1e10 where the image has no object."""
    return per_image(mask, lambda m: kernels.distance_to_foreground(m), "d", "double")


def morphology(mask: DataFrame, op: str = "open", radius: float = 1.5) -> DataFrame:
    if op not in kernels.MORPHOLOGY:
        raise ValueError(f"unknown operation {op!r}")
    return per_image(mask, lambda m: kernels.morphology(m, op, radius))


def dilate_by_offsets(mask: DataFrame, radius: float) -> DataFrame:
    """Dilation as a relation: object pixels moved by every offset of the disc, then distinct."""
    r = int(radius)
    disc = [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dx * dx + dy * dy <= radius * radius]
    offsets = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in disc))
    moved = mask.where("m").select("image_id", "width", "height", "y", "x", F.explode(offsets).alias("o")).select("image_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()
    return mask.join(moved.withColumn("_hit", F.lit(True)), ["image_id", "y", "x"], "left").withColumn("m", F.coalesce("_hit", F.lit(False))).select(*MASK)


def fill_holes(mask: DataFrame) -> DataFrame:
    return per_image(mask, kernels.fill_holes)


def watershed(mask: DataFrame, tolerance: float = 1.0) -> DataFrame:
    return per_image(mask, lambda m: kernels.watershed(m, tolerance))


def _keep(mask: DataFrame, labelled: DataFrame, good: DataFrame) -> DataFrame:
    """mask reduced to the objects (image_id, label) in good."""
    kept = labelled.where("label > 0").join(good, ["image_id", "label"], "left_semi").select("image_id", "y", "x", F.lit(True).alias("_k"))
    return mask.join(kept, ["image_id", "y", "x"], "left").withColumn("m", F.coalesce("_k", F.lit(False))).select(*MASK)


def size_filter(mask: DataFrame, low: float = 20, high: float = 0) -> DataFrame:
    """Objects of low to high pixels (0: no upper end), 8-connected."""
    own = labels(mask)
    size = own.where("label > 0").groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"))
    good = size.where((F.col("n") >= low) & ((F.col("n") <= high) if high > 0 else F.lit(True)))
    return _keep(mask, own, good.select("image_id", "label"))


def clear_border(mask: DataFrame) -> DataFrame:
    own = labels(mask)
    edge = "x = 0 OR y = 0 OR x = width - 1 OR y = height - 1"
    touching = own.where("label > 0").groupBy("image_id", "label").agg(F.max(F.expr(edge)).alias("edge"))
    return _keep(mask, own, touching.where("NOT edge").select("image_id", "label"))


def shape_filter(mask: DataFrame, circularity=(0.0, 1.0), aspect_max: float = 0.0, solidity_min: float = 0.0) -> DataFrame:
    """Objects whose shape lies in the ranges, with a slack of 1e-9."""
    from .measure import particles

    e = 1e-9
    own = labels(mask)
    good = particles(own).where(F.col("circularity").between(circularity[0] - e, circularity[1] + e) & (F.col("solidity") >= solidity_min - e) & ((F.col("aspect_ratio") <= aspect_max + e) if aspect_max > 0 else F.lit(True)))
    return _keep(mask, own, good.select("image_id", F.col("id").alias("label")))
