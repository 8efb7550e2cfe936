"""Outputs: CSV and TSV texts, PNG files and a single-file HTML report."""

from __future__ import annotations

import base64
import html
import math
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.measure import FEATURES, Calibration, Options, feature_header
from ..plans.recipe import Recipe

BOM = "﻿"
#: Columns of the particle table as (header, field); {a}, {l} and {i} are area unit, length unit, intensity.
PARTICLE_COLUMNS = (
    ("番号", "id"), ("面積 ({a})", "area"), ("周囲長 ({l})", "perimeter"), ("円形度", "circularity"), ("相当直径 ({l})", "equivalent_diameter"), ("長軸 ({l})", "major_axis"), ("短軸 ({l})", "minor_axis"), ("角度 (度)", "angle"), ("縦横比", "aspect_ratio"), ("フェレ径 ({l})", "feret"), ("充実度", "solidity"),
    ("平均（{i}）", "mean_intensity"), ("標準偏差（{i}）", "std_intensity"), ("最小（{i}）", "min_intensity"), ("最大（{i}）", "max_intensity"), ("合計（{i}）", "integrated_intensity"), ("重心 X (px)", "centroid_x"), ("重心 Y (px)", "centroid_y"), ("左 (px)", "bounds_x"), ("上 (px)", "bounds_y"), ("幅 (px)", "bounds_width"), ("高さ (px)", "bounds_height"), ("ふちに触れる", "touches_edge"), ("画素数", "pixel_count"),
)
#: Columns of the summary table.
SUMMARY_COLUMNS = (
    ("ファイル", "image_id"), ("数", "count"), ("面積の合計 ({a})", "total_area"), ("平均の面積 ({a})", "mean_area"), ("面積の中央値 ({a})", "median_area"), ("面積の標準偏差 ({a})", "std_area"), ("占有率 (%)", "area_fraction"), ("調べた範囲の面積 ({a})", "analyzed_area"), ("密度 (個/{a})", "density"), ("平均の円形度", "mean_circularity"), ("平均（{i}）", "mean_intensity"), ("陽性の数", "positive_count"), ("陽性率 (%)", "positive_percent"), ("手で除いた数", "excluded_count"), ("メモ", "note"),
)
YES, NO, POSITIVE, NEGATIVE, FILE = "はい", "いいえ", "陽性", "陰性", "ファイル"


def escape(cell: str, separator: str = ",") -> str:
    """A formula is defused with an apostrophe; separators, quotes and line ends are quoted."""
    if cell[:1] in ("=", "+", "-", "@") and cell:
        try:
            float(cell)
        except ValueError:
            cell = "'" + cell
    if any(c in cell for c in (separator, '"', "\r", "\n")):
        return '"' + cell.replace('"', '""') + '"'
    return cell


def number(v: float | int | None, digits: int = 4) -> str:
    """Shortest form with at most so many decimals; nothing for what is not finite."""
    if v is None or (isinstance(v, float) and not math.isfinite(v)):
        return ""
    text = f"{v:.{digits}f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    return "0" if text in ("-0", "") else text


def _table(rows: list[list[str]], separator: str) -> str:
    return "".join(separator.join(escape(c, separator) for c in row) + "\r\n" for row in rows)


def particles_csv(rows: list[dict], options: Options | None = None, separator: str = ",") -> str:
    """Particle table; a file column comes first where rows name an image, the class last where rows have one."""
    o = options or Options()
    with_file, with_class = any(r.get("image_id") is not None for r in rows), any(r.get("positive") is not None for r in rows)
    names = {"a": o.calibration.area_unit, "l": o.calibration.unit, "i": o.intensity_label}
    out = [[FILE] * with_file + [h.format(**names) for h, _ in PARTICLE_COLUMNS] + [POSITIVE] * with_class]
    for r in rows:
        cells = [(YES if r[f] else NO) if f == "touches_edge" else number(r[f]) for _, f in PARTICLE_COLUMNS]
        mark = {True: POSITIVE, False: NEGATIVE, None: ""}[r.get("positive")]
        out.append([r.get("image_id") or ""] * with_file + cells + [mark] * with_class)
    return _table(out, separator)


def summaries_csv(rows: list[dict], classified: bool = False) -> str:
    """Summary table with the units of the first success; failures keep only their name and reason."""
    first = next((r for r in rows if not r.get("error")), {})
    names = {"a": first.get("area_unit") or "px²", "l": first.get("length_unit") or "px", "i": first.get("intensity_label") or "luminance"}
    out = [[h.format(**names) for h, _ in SUMMARY_COLUMNS]]
    for r in rows:
        if r.get("error"):
            out.append([r["image_id"], *[""] * (len(SUMMARY_COLUMNS) - 2), r["error"]])
            continue
        other = "" if r["length_unit"] == names["l"] else f"単位が違います（{r['length_unit']}）"
        hidden = () if classified else ("positive_count", "positive_percent")
        out.append([r["image_id"], *("" if f in hidden else number(r[f], 6 if f == "density" else 4) for _, f in SUMMARY_COLUMNS[1:-1]), other])
    return _table(out, ",")


def defused(c: str) -> F.Column:
    """A column as text in which no cell begins a formula."""
    v = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.when(v.rlike("^[=+@-]") & v.try_cast("double").isNull(), F.concat(F.lit("'"), v)).otherwise(v)


def csv_lines(found: DataFrame, columns: list[str], separator: str = ",") -> DataFrame:
    """Rows as escaped lines in one column, for distributed text output of tables too large for one file."""

    def cell(c: str):
        safe = defused(c)
        return F.when(safe.rlike(f'[{separator}"\\r\\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)

    return found.select(F.concat_ws(separator, *(cell(c) for c in columns)).alias("value"))


def histogram_svg(bins: list[tuple[float, float, int]], marker: float | None = None, width: int = 320, height: int = 120) -> str:
    if not bins:
        return ""
    top = max(n for *_, n in bins) or 1
    step = width / len(bins)
    bars = "".join(f'<rect x="{k * step:.2f}" y="{height - height * n / top:.2f}" width="{max(step - 1, 0.5):.2f}" height="{height * n / top:.2f}"/>' for k, (*_, n) in enumerate(bins))
    low, high = bins[0][0], bins[-1][1]
    line = ""
    if marker is not None and high > low and low <= marker <= high:
        x = (marker - low) / (high - low) * width
        line = f'<line x1="{x:.2f}" x2="{x:.2f}" y1="0" y2="{height}" stroke="red"/>'
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}">{bars}{line}</svg>'


@dataclass(frozen=True)
class Report:
    """Inputs of a report; all frames are small and already collected."""

    title: str
    summary: dict
    particles: list[dict]
    recipe: Recipe
    outcomes: list[dict] = field(default_factory=list)
    images: dict[str, bytes] = field(default_factory=dict)
    distributions: dict[str, list[tuple[float, float, int]]] = field(default_factory=dict)
    options: Options = field(default_factory=Options)
    created: datetime | None = None
    max_rows: int = 300


def param_text(kind: str, key: str, value: float) -> str:
    from ..plans.catalog import lookup

    p = next(p for p in lookup(kind).params if p.key == key)
    if p.choices:
        return p.choices[min(max(int(np.rint(value)), 0), len(p.choices) - 1)]
    return f"{number(float(value))} {p.unit}".strip()


def build_html(r: Report) -> str:
    """One self-contained page: key figures, images as data URIs, distributions, steps, the first objects. Text is escaped."""
    e = html.escape
    figures = "".join(f"<dt>{e(k)}</dt><dd>{e(number(v) if isinstance(v, (int, float)) else str(v))}</dd>" for k, v in r.summary.items() if v is not None)
    pictures = "".join(f'<figure><img alt="{e(name)}" src="data:image/png;base64,{base64.b64encode(png).decode()}"><figcaption>{e(name)}</figcaption></figure>' for name, png in r.images.items())
    charts = "".join(f"<h3>{e(feature_header(k, r.options))}</h3>{histogram_svg(bins)}" for k, bins in r.distributions.items())
    steps = []
    for k, s in enumerate(r.recipe.steps):
        told = r.outcomes[k] if k < len(r.outcomes) else {}
        used = ", ".join(f"{key} = {param_text(s.kind, key, v)}" for key, v in sorted(s.values.items()))
        steps.append(f"<li>{e(s.kind)}{'' if s.enabled else ' (off)'} {e(used)} <em>{e(told.get('info') or '')}</em> <strong>{e(told.get('warning') or '')}</strong></li>")
    keys = ["id", *FEATURES]
    head = "".join(f"<th>{e('id' if k == 'id' else feature_header(k, r.options))}</th>" for k in keys)
    body = "".join("<tr>" + "".join(f"<td>{e(number(p[k]))}</td>" for k in keys) + "</tr>" for p in r.particles[: r.max_rows])
    more = f"<p>{len(r.particles) - r.max_rows} more objects are not shown.</p>" if len(r.particles) > r.max_rows else ""
    made = f"<p>{e(r.created.isoformat(timespec='minutes'))}</p>" if r.created else ""
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{e(r.title)}</title></head><body><h1>{e(r.title)}</h1>{made}<dl>{figures}</dl>{pictures}{charts}<ol>{"".join(steps)}</ol><table><tr>{head}</tr>{body}</table>{more}</body></html>'


def write_batch(images: DataFrame, recipe: Recipe, folder: str) -> None:
    """Outputs of a batch of images or files: summaries and particles as Parquet and CSV parts, and the recipe as JSON.

    Every image is decoded and processed once; the tables come from the written results.
    """
    from ..plans import engine

    spark = images.sparkSession
    engine.results(images, recipe).write.mode("overwrite").parquet(f"{folder}/results")
    done = spark.read.schema(engine.RESULT).parquet(f"{folder}/results")
    done.drop("particles").write.mode("overwrite").parquet(f"{folder}/summaries")
    done.select("image_id", F.inline("particles")).write.mode("overwrite").parquet(f"{folder}/particles")
    calibration = recipe.calibration or Calibration()
    units = {"a": calibration.area_unit, "l": calibration.unit, "i": recipe.measure.channel}
    for name, columns in (("summaries", SUMMARY_COLUMNS), ("particles", ((FILE, "image_id"), *PARTICLE_COLUMNS))):
        rows = spark.read.parquet(f"{folder}/{name}")
        cells = [defused(f).alias(title.format(**units)) for title, f in columns if f in rows.columns]
        rows.select(*cells).write.mode("overwrite").option("header", "true").option("escape", '"').option("lineSep", "\r\n").csv(f"{folder}/{name}_csv")
    spark.createDataFrame([(recipe.to_json(),)], "value string").write.mode("overwrite").text(f"{folder}/recipe")
