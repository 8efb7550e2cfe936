"""Recipes over images: one pass over an images table, an image per row, all steps of the recipe fused in one kernel.

There is no shuffle: an image is decoded, processed and measured where its row is read, so a folder of any size runs
at the speed of its scan. Errors are data: a step that can't be used leaves the state as it was and a warning, a file
that can't be processed gives an error row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import kernels
from ..operators.adjust import MEASURED
from ..operators.measure import Calibration, Options
from . import arrays
from .arrays import Raster
from .catalog import State, StepNotApplicable, lookup
from .recipe import Measure, Recipe, Step

MAX_PIXELS = 120_000_000


@dataclass(frozen=True)
class Outcome:
    applied: bool
    info: str | None = None
    warning: str | None = None


@dataclass(frozen=True)
class Run:
    """States after each step; the first one is the input."""

    states: tuple[State, ...]
    outcomes: tuple[Outcome, ...]
    signatures: tuple[str, ...]

    def after(self, index: int) -> State:
        return self.states[index + 1]


def run_steps(image: Raster, steps: tuple[Step, ...], calibration: Calibration | None = None, previous: Run | None = None) -> Run:
    """All steps in order; results of a common prefix of an earlier run on the same input are used again."""
    start = State(image, image, None, calibration or Calibration())
    signatures = tuple(s.signature() for s in steps)
    states, outcomes = [start], []
    if previous is not None and previous.states[0].image is image and previous.states[0].calibration == start.calibration:
        same = 0
        while same < min(len(signatures), len(previous.signatures)) and signatures[same] == previous.signatures[same]:
            same += 1
        states, outcomes = list(previous.states[: same + 1]), list(previous.outcomes[:same])
    for step in steps[len(outcomes) :]:
        state = replace(states[-1], info=None, warning=None)
        if not step.enabled:
            states.append(state)
            outcomes.append(Outcome(False, "off"))
            continue
        try:
            new = lookup(step.kind).apply(state, step.get)
            states.append(new)
            outcomes.append(Outcome(True, new.info, new.warning))
        except (StepNotApplicable, ValueError) as e:
            states.append(state)
            outcomes.append(Outcome(False, None, str(e)))
    return Run(tuple(states), tuple(outcomes), signatures)


def measured_channel(image: Raster, name: str) -> tuple[np.ndarray, str]:
    """(gray values, label); gray images fall back to luminance."""
    if name == "luminance" or not image.is_color:
        return image.gray(), "luminance"
    k = MEASURED.index(name)
    if k <= 3:
        return image.data[:, :, k - 1], name
    return arrays.stain(image, {"hematoxylin": 2, "eosin": 1, "dab": 3}[name]).data[:, :, 0], name


def shape_table(labels: np.ndarray, n: int) -> list[dict]:
    """Outline measures of each label in pixels."""
    ys, xs = np.nonzero(labels)
    own = labels[ys, xs] - 1
    count = np.bincount(own, minlength=n)
    order = np.argsort(own, kind="stable")
    ends = np.cumsum(count)
    out = []
    for k in range(n):
        at = order[ends[k] - count[k] : ends[k]]
        y, x = ys[at], xs[at]
        shape = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
        shape[y - y.min(), x - x.min()] = True
        around = kernels.perimeter(shape)
        feret, hull = kernels.hull_measures(shape)
        a = float(count[k])
        cx, cy = x + 0.5, y + 0.5
        m20, m02, m11 = cx.var() + 1 / 12, cy.var() + 1 / 12, ((cx - cx.mean()) * (cy - cy.mean())).mean()
        root = math.sqrt(((m20 - m02) / 2) ** 2 + m11 * m11)
        major, minor = 4 * math.sqrt((m20 + m02) / 2 + root), 4 * math.sqrt(max((m20 + m02) / 2 - root, 1e-12))
        angle = -0.5 * math.atan2(2 * m11, m20 - m02) * 180 / math.pi
        out.append({
            "pixels": int(a), "perimeter": around, "circularity": min(1.0, 4 * math.pi * a / (around * around)) if around > 0 else 0.0, "cx": float(cx.mean()), "cy": float(cy.mean()), "major": major, "minor": minor, "angle": angle + 180 if angle < 0 else angle,
            "aspect_ratio": major / minor, "feret": feret, "solidity": min(1.0, a / hull) if hull > 0 else 1.0, "x0": int(x.min()), "y0": int(y.min()), "x1": int(x.max()), "y1": int(y.max()),
        })
    return out


PARTICLE = (
    "image_id string, id int, pixel_count int, area double, perimeter double, circularity double, centroid_x double, centroid_y double, equivalent_diameter double, major_axis double, minor_axis double, angle double, aspect_ratio double, feret double, solidity double, "
    "mean_intensity double, std_intensity double, min_intensity double, max_intensity double, integrated_intensity double, bounds_x int, bounds_y int, bounds_width int, bounds_height int, touches_edge boolean, positive boolean"
)
SUMMARY = (
    "image_id string, count long, total_area double, mean_area double, median_area double, std_area double, analyzed_area double, area_fraction double, mean_circularity double, mean_intensity double, density double, area_unit string, length_unit string, "
    "intensity_label string, excluded_count long, positive_count long, positive_percent double, note string, error string"
)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _ARROW[t]) for n, t in fields], [n for n, _ in fields])


def analyze(state: State, measure: Measure, region: np.ndarray | None = None, points: tuple[tuple[float, float], ...] = ()) -> tuple[list[dict], dict] | None:
    """(particles, summary) of a state's mask; None without a mask. Filters apply in order: sizes, edge, excluded points."""
    if state.mask is None:
        return None
    source = state.original if measure.intensity_from_original else state.image
    if source.size != (state.mask.shape[1], state.mask.shape[0]):
        source = state.image
    values, label = measured_channel(source, measure.channel)
    o: Options = measure.options(state.calibration, label)
    target = state.mask if region is None else state.mask & region
    labels, n = kernels.label(target, o.eight_connected)
    h, w = labels.shape
    border = np.zeros((h, w), bool)
    border[[0, -1]] = border[:, [0, -1]] = True
    if region is not None:
        p = np.pad(region, 1)
        border |= region & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:])
    edge = np.zeros(n + 1, bool)
    edge[np.unique(labels[border])] = True
    out = np.zeros(n + 1, bool)
    for x, y in points:
        if 0 <= math.floor(x) < w and 0 <= math.floor(y) < h:
            out[labels[math.floor(y), math.floor(x)]] = True
    flat, v = labels.ravel(), values.ravel().astype(np.float64)
    total, square = np.bincount(flat, v, n + 1), np.bincount(flat, v * v, n + 1)
    low, high = np.full(n + 1, np.inf), np.full(n + 1, -np.inf)
    np.minimum.at(low, flat, v)
    np.maximum.at(high, flat, v)
    u = o.calibration.units_per_pixel
    found, excluded = [], 0
    for k, m in enumerate(shape_table(labels, n), 1):
        a, area = m["pixels"], m["pixels"] * u * u
        if area < o.min_area or (o.max_area > 0 and area > o.max_area) or (o.exclude_edges and edge[k]):
            continue
        if out[k]:
            excluded += 1
            continue
        mean = total[k] / a
        rule = o.positive
        found.append({
            "id": len(found) + 1, "pixel_count": a, "area": area, "perimeter": m["perimeter"] * u, "circularity": m["circularity"], "centroid_x": m["cx"], "centroid_y": m["cy"], "equivalent_diameter": 2 * math.sqrt(a / math.pi) * u, "major_axis": m["major"] * u, "minor_axis": m["minor"] * u, "angle": m["angle"],
            "aspect_ratio": m["aspect_ratio"], "feret": m["feret"] * u, "solidity": m["solidity"], "mean_intensity": mean, "std_intensity": math.sqrt(max(0.0, (square[k] - total[k] ** 2 / a) / (a - 1))) if a > 1 else 0.0, "min_intensity": low[k], "max_intensity": high[k], "integrated_intensity": total[k],
            "bounds_x": m["x0"], "bounds_y": m["y0"], "bounds_width": m["x1"] - m["x0"] + 1, "bounds_height": m["y1"] - m["y0"] + 1, "touches_edge": bool(edge[k]), "positive": None if rule is None else bool(mean >= rule.threshold if rule.above else mean < rule.threshold),
        })
    areas = np.array([p["area"] for p in found])
    pixels = sum(p["pixel_count"] for p in found)
    seen = int(region.sum()) if region is not None else w * h
    positives = sum(p["positive"] is True for p in found)
    some = len(found) > 0
    summary = {
        "count": len(found), "total_area": pixels * u * u, "mean_area": float(areas.mean()) if some else 0.0, "median_area": float(np.median(areas)) if some else 0.0, "std_area": float(areas.std(ddof=1)) if len(areas) > 1 else 0.0, "analyzed_area": seen * u * u, "area_fraction": 100.0 * pixels / seen if seen else 0.0,
        "mean_circularity": float(np.mean([p["circularity"] for p in found])) if some else 0.0, "mean_intensity": float(sum(p["integrated_intensity"] for p in found) / pixels) if pixels else 0.0, "density": len(found) / (seen * u * u) if seen else 0.0, "area_unit": o.calibration.area_unit, "length_unit": o.calibration.unit,
        "intensity_label": label, "excluded_count": excluded, "positive_count": positives, "positive_percent": 100.0 * positives / len(found) if some and o.positive else 0.0,
    }
    return found, summary


#: Bytes of rows that go to a worker at once; a larger image goes alone.
BATCH_BYTES = 32 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches in bytes, whatever number of rows it allows."""
    now = spark.conf.get(_BATCH_KEY)
    size = int(now) if now.lstrip("-").isdigit() else 0
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def _map(images: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    bound_batches(images.sparkSession)
    src = images.select("path", "content") if "content" in images.columns else images
    return src.mapInArrow(run, schema)


def _files(batch: pa.RecordBatch) -> Iterator[tuple[str, Raster | str, Calibration | None]]:
    from ..sources.files import read_image

    for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
        try:
            image, calibration = read_image(path, content.as_py() or b"")
            if image.size[0] * image.size[1] > MAX_PIXELS:
                raise ValueError("the image is empty or too large")
            yield path, image, calibration
        except ValueError as e:
            yield path, str(e), None


def _rasters(batch: pa.RecordBatch) -> Iterator[tuple[str, Raster | str, Calibration | None]]:
    """(image_id, image or error text, calibration of the file) of each row; sample arrays are read without copies.

    Rows are an images table's, or files (path, content) that are decoded here.
    """
    names = batch.schema.names
    if "content" in names:
        yield from _files(batch)
        return
    data = batch.column("data")
    offs, flat = data.offsets.to_numpy(), data.values.to_numpy(zero_copy_only=False)
    cells = {n: batch.column(n).to_pylist() for n in names if n != "data"}
    for k in range(batch.num_rows):
        image_id, w, h, ch = (cells[n][k] for n in ("image_id", "width", "height", "channels"))
        error = cells["error"][k] if "error" in cells else None
        unit = cells.get("unit", [None] * batch.num_rows)[k]
        calibration = Calibration(cells["units_per_pixel"][k], unit) if unit else None
        try:
            if error:
                raise ValueError(error)
            if not w or not h or w * h > MAX_PIXELS:
                raise ValueError("the image is empty or too large")
            yield image_id, Raster.of(flat[offs[k] : offs[k + 1]].reshape(h, w, ch), cells["nominal_min"][k], cells["nominal_max"][k]), calibration
        except (ValueError, TypeError) as e:
            yield image_id, str(e), calibration


def _process(recipe: Recipe, emit: Callable[[str, Run | str, tuple | None], list[dict]], schema: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, image, calibration in _rasters(batch):
                if isinstance(image, str):
                    yield _batch(emit(image_id, image, None), schema)
                    continue
                done = run_steps(image, recipe.steps, recipe.calibration or calibration)
                yield _batch(emit(image_id, done, analyze(done.states[-1], recipe.measure)), schema)

    return run


def _particle_rows(image_id: str, done: Run | str, result: tuple | None) -> list[dict]:
    return [p | {"image_id": image_id} for p in result[0]] if result else []


def _summary_rows(image_id: str, done: Run | str, result: tuple | None) -> list[dict]:
    if isinstance(done, str):
        return [{"image_id": image_id, "error": done}]
    note = next((o.warning for o in done.outcomes if o.warning), None)
    if result is None:
        return [{"image_id": image_id, "note": note, "error": "the recipe has no segmentation step"}]
    return [result[1] | {"image_id": image_id, "note": note}]


def particles(images: DataFrame, recipe: Recipe) -> DataFrame:
    """Objects of all images under a recipe; images that fail have none."""
    return _map(images, _process(recipe, _particle_rows, PARTICLE), PARTICLE)


def summaries(images: DataFrame, recipe: Recipe) -> DataFrame:
    """One row per image: the roll-up, or the reason of a failure; the first warning is kept as a note."""
    return _map(images, _process(recipe, _summary_rows, SUMMARY), SUMMARY)


RESULT = f"{SUMMARY}, particles array<struct<{PARTICLE.split(', ', 1)[1].replace(' ', ':').replace(',:', ',')}>>"


def results(images: DataFrame, recipe: Recipe) -> DataFrame:
    """One row per image: its summary and the list of its objects, from one run of the recipe."""
    kind = pa.list_(pa.struct([(n, _ARROW[t]) for n, t in (c.split() for c in PARTICLE.split(", ")[1:])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, image, calibration in _rasters(batch):
                done = image if isinstance(image, str) else run_steps(image, recipe.steps, recipe.calibration or calibration)
                found = None if isinstance(done, str) else analyze(done.states[-1], recipe.measure)
                summary = _batch(_summary_rows(image_id, done, found), SUMMARY)
                yield pa.RecordBatch.from_arrays([*summary.columns, pa.array([found[0] if found else []], kind)], [*summary.schema.names, "particles"])

    return _map(images, run, RESULT)


IMAGE = "image_id string, width int, height int, channels int, nominal_min float, nominal_max float, data array<float>"


def transform(images: DataFrame, recipe: Recipe, mask: bool = False) -> DataFrame:
    """The images after all steps, or their masks as 0 and 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, image, _ in _rasters(batch):
                if isinstance(image, str):
                    continue
                state = run_steps(image, recipe.steps).states[-1]
                if mask and state.mask is None:
                    continue
                out = Raster.of(state.mask * 255.0) if mask else state.image
                w, h = out.size
                flat = pa.array(out.data.ravel())
                cells = ([image_id], [w], [h], [out.data.shape[2]], [out.lo], [out.hi])
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float32(), pa.float32())
                columns = [pa.array(c, t) for c, t in zip(cells, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], _names(IMAGE))

    return _map(images, run, IMAGE)


def outcomes(images: DataFrame, recipe: Recipe) -> DataFrame:
    """(image_id, step, kind, applied, info, warning) of every step on every image."""
    schema = "image_id string, step int, kind string, applied boolean, info string, warning string"

    def rows(image_id: str, done: Run | str, result: tuple | None) -> list[dict]:
        if isinstance(done, str):
            return [{"image_id": image_id, "step": -1, "applied": False, "warning": done}]
        return [{"image_id": image_id, "step": k, "kind": s.kind, "applied": o.applied, "info": o.info, "warning": o.warning} for k, (s, o) in enumerate(zip(recipe.steps, done.outcomes, strict=True))]

    return _map(images, _process(recipe, rows, schema), schema)


def template_matches(images: DataFrame, template: Raster, low: float = 0.6, most: int = 20) -> DataFrame:
    """(image_id, x, y, width, height, score) of places like the template in every image."""
    schema = "image_id string, x int, y int, width int, height int, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, image, _ in _rasters(batch):
                if not isinstance(image, str):
                    yield _batch([m | {"image_id": image_id} for m in arrays.find_template(image, template, low, most)], schema)

    return _map(images, run, schema)


def batch_totals(found: DataFrame) -> DataFrame:
    """Counts over a batch of summaries: images, failures, objects."""
    return found.agg(F.count(F.lit(1)).alias("images"), F.count("error").alias("failed"), F.coalesce(F.sum("count"), F.lit(0)).alias("objects"))
