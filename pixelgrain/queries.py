"""Registered queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from . import model
from .functions.expressions import NOISE_PRIME, stain_weights
from .operators import adjust, filters, geometry, measure, refine, render, segment, stats
from .plans import engine
from .plans.arrays import Raster
from .plans.catalog import METHODS
from .plans.recipe import Measure, Recipe, Step

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def num(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


# ---------------------------------------------------------------- adjustments


def values(pixels: DataFrame, digits: int = 5) -> DataFrame:
    names = ["r", "g", "b"] if "r" in pixels.columns else ["v"]
    return pixels.select("image_id", "y", "x", *((F.round(n, digits) + 0.0).alias(n) for n in names))


def gray_query(name: str, op: Callable[[DataFrame], DataFrame], expr: str, source: str = "gray", extra: str = "", digits: int = 5) -> None:
    """A query whose result is a gray image: expr over px (and joined tables) as v."""
    sql = {"gray": fx.GRAY_SQL, "color": fx.COLOR_SQL, "batch": fx.BATCH_SQL, "embedding": fx.EMB_SQL}[source]
    load = getattr(fx, source)
    add(name, lambda s, d: values(op(load(s, d)), digits), f"WITH RECURSIVE {sql}{', ' + extra if extra else ''} SELECT image_id, y, x, round({expr}, {digits}) + 0.0::DOUBLE AS v FROM px")


def clip(e: str, lo: float = 0.0, hi: float = 255.0) -> str:
    return f"greatest({num(lo)}, least({num(hi)}, {e}))"


LUMA_SQL = "CAST(CAST(0.299 AS FLOAT) * CAST(r AS FLOAT) + CAST(0.587 AS FLOAT) * CAST(g AS FLOAT) + CAST(0.114 AS FLOAT) * CAST(b AS FLOAT) AS DOUBLE)"
gray_query("gray", adjust.gray, LUMA_SQL, "color", digits=3)
gray_query("channel", lambda p: adjust.channel(p, 1), "g", "color")


def od(c: str) -> str:
    return f"-log10(greatest({clip(f'round_even({c}, 0)')}, 1.0::DOUBLE) / 255.0::DOUBLE)"


for _query, _stain in (("stain_dab", "dab"), ("stain_hematoxylin", "hematoxylin_hdab"), ("stain_hematoxylin_he", "hematoxylin_he"), ("stain_eosin", "eosin_he")):
    _w = stain_weights(_stain)
    gray_query(_query, lambda p, s=_stain: adjust.stain(p, s), clip(" + ".join(f"{od(c)} * {num(w)}" for c, w in zip("rgb", _w, strict=True)), 0, 3), "color")
gray_query("invert", adjust.invert, clip("255.0::DOUBLE - v"))
gray_query("window_level", lambda p: adjust.window_level(p, 100, 120), clip("(v - 40.0::DOUBLE) * (255.0::DOUBLE / 120.0::DOUBLE)"))
gray_query("stretch", lambda p: adjust.stretch(p, 30, 200), clip("(v - 30.0::DOUBLE) * (255.0::DOUBLE / 170.0::DOUBLE)"))
gray_query("brightness_contrast", lambda p: adjust.brightness_contrast(p, 10, 1.3), clip("(v - 127.5::DOUBLE) * 1.3::DOUBLE + 127.5::DOUBLE + 25.5::DOUBLE"))
gray_query("gamma", lambda p: adjust.gamma(p, 0.7), clip("255.0::DOUBLE * pow(v / 255.0::DOUBLE, 0.7::DOUBLE)"))


def hist_sql(bins: int, low: str, high: str, source: str = "px", value: str = "v") -> str:
    b = f"greatest(0, least({bins - 1}, CAST(floor(({value} - ({low})) * {bins} / (({high}) - ({low}))) AS INTEGER)))"
    return f"""counts AS (SELECT image_id, {b} AS bin, count(*) AS n FROM {source} GROUP BY 1, 2),
hist AS (SELECT i.image_id, CAST(b.range AS INTEGER) AS bin, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT image_id FROM {source}) i CROSS JOIN range({bins}) b LEFT JOIN counts c ON c.image_id = i.image_id AND c.bin = b.range)"""


def quantile_sql(name: str, q: str, bins: int, low: str, high: str) -> str:
    return f"""{name} AS (SELECT image_id, first({low} + bin * (({high}) - ({low})) / {bins} + ({q} * total - (cum - n)) / n * ((({high}) - ({low})) / {bins}) ORDER BY bin) AS q
  FROM (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY bin)::DOUBLE AS cum, sum(n) OVER (PARTITION BY image_id)::DOUBLE AS total FROM hist) WHERE n > 0 AND cum >= {q} * total GROUP BY 1)"""


EDGE = "edge AS (SELECT min(v) AS lo, max(v) AS hi FROM px)"
LO, HI = "(SELECT lo FROM edge)", "(SELECT hi FROM edge)"
gray_query(
    "auto_contrast",
    lambda p: adjust.auto_contrast(p, 0.35),
    clip("(v - (SELECT q FROM qa)) * (255.0::DOUBLE / ((SELECT q FROM qb) - (SELECT q FROM qa)))"),
    extra=f"{EDGE}, {hist_sql(1024, LO, HI)}, {quantile_sql('qa', num(0.0035), 1024, LO, HI)}, {quantile_sql('qb', num(1 - 0.0035), 1024, LO, HI)}",
)
_top = f"({HI} + 0.001::DOUBLE)"
add(
    "equalize",
    lambda s, d: values(adjust.equalize(fx.gray(s, d))),
    f"""WITH {fx.GRAY_SQL}, {EDGE}, {hist_sql(256, LO, _top)},
cdf AS (SELECT bin, sum(n) OVER (ORDER BY bin)::DOUBLE / sum(n) OVER ()::DOUBLE AS c FROM hist)
SELECT image_id, y, x, round(c * 255.0::DOUBLE, 5) + 0.0::DOUBLE AS v FROM px JOIN cdf ON cdf.bin = least(255, CAST(floor((v - {LO}) * 256 / ({_top} - {LO})) AS INTEGER))""",
)
add(
    "clahe",
    lambda s, d: values(adjust.clahe(fx.gray(s, d), 8, 2.5), 4),
    f"""WITH {fx.GRAY_SQL}, {EDGE},
b AS (SELECT *, least(255, CAST(floor((v - {LO}) * (256 / ({HI} - {LO} + 0.000001::DOUBLE))) AS INTEGER)) AS bin, x // 8 AS tx, y // 6 AS ty, (x + 0.5::DOUBLE) / 8 - 0.5::DOUBLE AS gx, (y + 0.5::DOUBLE) / 6 - 0.5::DOUBLE AS gy FROM px),
p AS (SELECT *, greatest(0, CAST(floor(gx) AS INTEGER)) AS xa, least(7, greatest(0, CAST(floor(gx) AS INTEGER)) + 1) AS xb, greatest(0, CAST(floor(gy) AS INTEGER)) AS ya, least(7, greatest(0, CAST(floor(gy) AS INTEGER)) + 1) AS yb FROM b),
f AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, gx - xa)) AS fx, greatest(0.0::DOUBLE, least(1.0::DOUBLE, gy - ya)) AS fy FROM p),
h AS (SELECT t.range // 8 AS ty, t.range % 8 AS tx, k.range AS bin, coalesce(c.n, 0)::DOUBLE AS n FROM range(64) t CROSS JOIN range(256) k LEFT JOIN (SELECT ty, tx, bin, count(*) AS n FROM b GROUP BY ALL) c ON c.ty = t.range // 8 AND c.tx = t.range % 8 AND c.bin = k.range),
e AS (SELECT *, greatest(1.0::DOUBLE, 2.5::DOUBLE * 48 / 256) AS lim FROM h),
m AS (SELECT ty, tx, bin, sum(least(n, lim) + ex) OVER (PARTITION BY ty, tx ORDER BY bin) / 48.0::DOUBLE AS c FROM (SELECT *, sum(greatest(n - lim, 0.0::DOUBLE)) OVER (PARTITION BY ty, tx) / 256 AS ex FROM e))
SELECT image_id, f.y, f.x, round(((1 - fy) * ((1 - fx) * m0.c + fx * m1.c) + fy * ((1 - fx) * m2.c + fx * m3.c)) * 255.0::DOUBLE, 4) + 0.0::DOUBLE AS v FROM f
JOIN m m0 ON m0.ty = ya AND m0.tx = xa AND m0.bin = f.bin JOIN m m1 ON m1.ty = ya AND m1.tx = xb AND m1.bin = f.bin
JOIN m m2 ON m2.ty = yb AND m2.tx = xa AND m2.bin = f.bin JOIN m m3 ON m3.ty = yb AND m3.tx = xb AND m3.bin = f.bin""",
)
add(
    "brightness_contrast_color",
    lambda s, d: values(adjust.brightness_contrast(fx.color(s, d), -5, 1.1)),
    f"WITH {fx.COLOR_SQL} SELECT image_id, y, x, " + ", ".join(f"round({clip(f'({c} - 127.5::DOUBLE) * 1.1::DOUBLE + 127.5::DOUBLE - 12.75::DOUBLE')}, 5) + 0.0::DOUBLE AS {c}" for c in "rgb") + " FROM px",
)
gray_query("measured_channel", lambda p: adjust.measured(p, "dab")[0], clip(" + ".join(f"{od(c)} * {num(w)}" for c, w in zip("rgb", stain_weights("dab"), strict=True)), 0, 3), "color")

# ---------------------------------------------------------------- filters


def line_sql(name: str, source: str, axis: str, weights: list[float]) -> str:
    """One pass of a line filter as a join with clamped offsets."""
    r, size = len(weights) // 2, 64 if axis == "x" else 48
    table = ", ".join(f"({k - r}, {num(w)})" for k, w in enumerate(weights))
    other = "y" if axis == "x" else "x"
    return f"{name} AS (SELECT p.image_id, p.y, p.x, sum(q.v * w.w) AS v FROM {source} p CROSS JOIN (VALUES {table}) w(o, w) JOIN {source} q ON q.image_id = p.image_id AND q.{other} = p.{other} AND q.{axis} = greatest(0, least({size - 1}, p.{axis} + w.o)) GROUP BY ALL)"


def blur_sql(sigma: float, boxes: bool, source: str = "px", name: str = "blur") -> str:
    passes = [[1 / (2 * r + 1)] * (2 * r + 1) for r in filters.box_radii(sigma) for _ in "xy"] if boxes else [filters.gaussian_weights(sigma)] * 2
    out, last = [], source
    for k, w in enumerate(passes):
        now = name if k == len(passes) - 1 else f"{name}{k}"
        out.append(line_sql(now, last, "xy"[k % 2], w))
        last = now
    return ", ".join(out)


def filter_query(name: str, op: Callable[[DataFrame], DataFrame], ctes: str, select: str, digits: int = 4) -> None:
    add(name, lambda s, d: values(op(fx.gray(s, d)), digits), f"WITH {fx.GRAY_SQL}, {ctes} SELECT image_id, y, x, round({select}, {digits}) + 0.0::DOUBLE AS v FROM px JOIN blur b USING (image_id, y, x)")


for _n, _op, _c, _e in (
    ("gaussian_exact", lambda p: filters.gaussian(p, 1.5), blur_sql(1.5, False), "b.v"),
    ("gaussian_boxes", lambda p: filters.gaussian(p, 5.0), blur_sql(5.0, True), "b.v"),
    ("sharpen", lambda p: filters.sharpen(p, 1.5, 0.8), blur_sql(1.5, False), clip("px.v + 0.8::DOUBLE * (px.v - b.v)")),
    ("background_subtract", lambda p: filters.background(p, 8.0), blur_sql(8.0, True), clip("px.v - b.v")),
    ("background_divide", lambda p: filters.background(p, 8.0, True), blur_sql(8.0, True), clip("px.v / greatest(b.v, 0.001::DOUBLE) * (SELECT avg(v) FROM blur)")),
):
    filter_query(_n, _op, _c, _e)
_square = "CROSS JOIN (SELECT a.range - 1 AS dx, b.range - 1 AS dy FROM range(3) a CROSS JOIN range(3) b) o JOIN px q ON q.x = greatest(0, least(63, p.x + dx)) AND q.y = greatest(0, least(47, p.y + dy))"
add("median_r1", lambda s, d: values(filters.median(fx.gray(s, d), 1)), f"WITH {fx.GRAY_SQL} SELECT p.image_id, p.y, p.x, quantile_disc(q.v, 0.5) + 0.0::DOUBLE AS v FROM px p {_square} GROUP BY ALL")
add(
    "sobel",
    lambda s, d: values(filters.sobel(fx.gray(s, d))),
    f"WITH {fx.GRAY_SQL}, g AS (SELECT p.image_id, p.y, p.x, sum(q.v * dx * (2 - abs(dy))) AS gx, sum(q.v * dy * (2 - abs(dx))) AS gy FROM px p {_square} GROUP BY ALL) SELECT image_id, y, x, round(least(255.0::DOUBLE, sqrt(gx * gx + gy * gy) / 4), 5) + 0.0::DOUBLE AS v FROM g",
)


def draw_sql(what: int, seed: int) -> str:
    """A draw between 0 and 1 as noise makes it, in whole numbers up to the last division."""
    prime = NOISE_PRIME
    state = f"(({seed * 7919 + what * 104729 + 1} + y::BIGINT * 15485863 + x::BIGINT * 32452843) % {prime})"
    for k in (12345, 67891, 23457):
        state = f"list_transform([{state}], lambda h: ((h * h % {prime}) * 48271 + h * 69621 + {k}) % {prime})[1]"
    return f"(({state} + 0.5::DOUBLE) / {prime}.0::DOUBLE)"


gray_query("noise_seeded", lambda p: filters.noise(p, 5, 2, 7), f"CASE WHEN {draw_sql(0, 7)} < 0.02::DOUBLE THEN CASE WHEN {draw_sql(1, 7)} < 0.5::DOUBLE THEN 255.0::DOUBLE ELSE 0.0::DOUBLE END ELSE {clip(f'v + 12.75::DOUBLE * sqrt(-2 * ln({draw_sql(2, 7)})) * cos(2 * pi() * {draw_sql(3, 7)})')} END")

# ---------------------------------------------------------------- geometry


def geometry_query(name: str, op: Callable[[DataFrame], DataFrame], sql: str, with_: str = "") -> None:
    add(name, lambda s, d: values(op(fx.gray(s, d))), f"WITH {fx.GRAY_SQL}{with_} {sql}")


geometry_query("crop", lambda p: geometry.crop(p, 10, 5, 30, 100), "SELECT image_id, y - 5 AS y, x - 10 AS x, v FROM px WHERE x >= 10 AND x < 40 AND y >= 5")
geometry_query("auto_crop", lambda p: geometry.auto_crop(p, 200.0, True, 1), "SELECT image_id, CAST(y - y0 AS INTEGER) AS y, CAST(x - x0 AS INTEGER) AS x, v FROM px, box WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1", ", box AS (SELECT greatest(0, min(x) - 1) AS x0, least(63, max(x) + 1) AS x1, greatest(0, min(y) - 1) AS y0, least(47, max(y) + 1) AS y1 FROM px WHERE v > 200)")
geometry_query("flip_h", lambda p: geometry.flip(p, True), "SELECT image_id, y, 63 - x AS x, v FROM px")
geometry_query("flip_v", lambda p: geometry.flip(p, False), "SELECT image_id, 47 - y AS y, x, v FROM px")
geometry_query("rotate_cw", lambda p: geometry.rotate(p, 0), "SELECT image_id, x AS y, 47 - y AS x, v FROM px")
geometry_query("rotate_180", lambda p: geometry.rotate(p, 1), "SELECT image_id, 47 - y AS y, 63 - x AS x, v FROM px")
geometry_query("rotate_ccw", lambda p: geometry.rotate(p, 2), "SELECT image_id, 63 - x AS y, y AS x, v FROM px")
geometry_query("resize_half", lambda p: geometry.resize(p, 0.5), "SELECT image_id, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, round(sum(v) / 4, 5) + 0.0::DOUBLE AS v FROM px GROUP BY ALL")


def bilinear_sql(points: str, out: str) -> str:
    return f"""{points},
c AS (SELECT *, greatest(0.0::DOUBLE, least(63.0::DOUBLE, px_)) AS cx, greatest(0.0::DOUBLE, least(47.0::DOUBLE, py_)) AS cy FROM pts),
e AS (SELECT *, CAST(floor(cx) AS INTEGER) AS x0, CAST(floor(cy) AS INTEGER) AS y0, least(63, CAST(floor(cx) AS INTEGER) + 1) AS x1, least(47, CAST(floor(cy) AS INTEGER) + 1) AS y1, cx - floor(cx) AS fx, cy - floor(cy) AS fy FROM c),
s AS (SELECT e.*, (1 - fy) * ((1 - fx) * a.v + fx * b.v) + fy * ((1 - fx) * g.v + fx * h.v) AS v FROM e
  JOIN px a ON a.x = e.x0 AND a.y = e.y0 JOIN px b ON b.x = e.x1 AND b.y = e.y0 JOIN px g ON g.x = e.x0 AND g.y = e.y1 JOIN px h ON h.x = e.x1 AND h.y = e.y1) {out}"""


geometry_query("resize_up", lambda p: geometry.resize(p, 1.5), "", ", " + bilinear_sql("pts AS (SELECT CAST(b.range AS INTEGER) AS y, CAST(a.range AS INTEGER) AS x, (a.range + 0.5::DOUBLE) * 64 / 96 - 0.5::DOUBLE AS px_, (b.range + 0.5::DOUBLE) * 48 / 72 - 0.5::DOUBLE AS py_ FROM range(96) a CROSS JOIN range(72) b)", "SELECT 'R' AS image_id, y, x, round(v, 5) + 0.0::DOUBLE AS v FROM s"))
add(
    "line_profile",
    lambda s, d: geometry.line_profile(fx.gray(s, d), 3.0, 4.0, 33.0, 44.0, 0.5).select("i", F.round("distance", 6).alias("distance"), F.round("value", 5).alias("value")),
    f"WITH {fx.GRAY_SQL}, " + bilinear_sql("pts AS (SELECT CAST(range AS INTEGER) AS i, range / 50.0::DOUBLE * 25 AS distance, 3 + range / 50.0::DOUBLE * 30 - 0.5::DOUBLE AS px_, 4 + range / 50.0::DOUBLE * 40 - 0.5::DOUBLE AS py_ FROM range(51))", "SELECT i, round(distance, 6) AS distance, round(v, 5) AS value FROM s"),
)
add(
    "bilinear_sample",
    lambda s, d: geometry.bilinear(fx.gray(s, d), s.range(200).select(F.lit("R").alias("image_id"), "id", (F.col("id") * 0.37 - 2).alias("px"), (F.col("id") * 0.29 - 3).alias("py"))).select("id", F.round("v", 5).alias("v")),
    f"WITH {fx.GRAY_SQL}, " + bilinear_sql("pts AS (SELECT range AS id, range * 0.37::DOUBLE - 2 AS px_, range * 0.29::DOUBLE - 3 AS py_ FROM range(200))", "SELECT id, round(v, 5) AS v FROM s"),
)

# ---------------------------------------------------------------- statistics

BIN8 = hist_sql(256, "0.0::DOUBLE", "256.0::DOUBLE")
add("pixel_histogram", lambda s, d: stats.histogram(fx.gray(s, d)).select("image_id", "bin", "n"), f"WITH {fx.GRAY_SQL}, {BIN8} SELECT image_id, bin, n FROM hist")
add("pixel_histogram_batch", lambda s, d: stats.histogram(fx.batch(s, d)).select("image_id", "bin", "n"), f"WITH {fx.BATCH_SQL}, {BIN8} SELECT image_id, bin, n FROM hist")
add(
    "pixel_histogram_wide",
    lambda s, d: stats.histogram(fx.embedding(s, d)).select("image_id", "bin", "n"),
    f"WITH {fx.EMB_SQL}, {EDGE}, {hist_sql(256, LO, HI)} SELECT image_id, bin, n FROM hist",
)
add(
    "histogram_stats",
    lambda s, d: stats.histogram_stats(fx.batch(s, d)).select("image_id", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "vmin", "vmax"),
    f"WITH {fx.BATCH_SQL} SELECT image_id, count(*) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd, min(v) AS vmin, max(v) AS vmax FROM px GROUP BY 1",
)
add("histogram_mode", lambda s, d: stats.mode_bin(stats.histogram(fx.batch(s, d))), f"WITH {fx.BATCH_SQL}, {BIN8} SELECT image_id, first(bin + 0.5::DOUBLE ORDER BY n DESC, bin) AS mode FROM hist GROUP BY 1")
for _name, _q in (("histogram_quantile", 0.9), ("histogram_median", 0.5)):
    add(
        _name,
        lambda s, d, q=_q: stats.histogram_quantile(stats.histogram(fx.batch(s, d)), q).select("image_id", F.round("quantile", 6).alias("quantile")),
        f"WITH {fx.BATCH_SQL}, {BIN8}, {quantile_sql('qq', num(_q), 256, '0.0::DOUBLE', '256.0::DOUBLE')} SELECT image_id, round(q, 6) AS quantile FROM qq",
    )
add("value_range", lambda s, d: stats.value_range(fx.color(s, d)), f"WITH {fx.COLOR_SQL} SELECT image_id, min(least(r, g, b)) AS vmin, max(greatest(r, g, b)) AS vmax FROM px GROUP BY 1")


def described(d: DataFrame) -> DataFrame:
    names = ("mean", "sd", "vmin", "q1", "median", "q3", "vmax", "cv_percent", "sem")
    return d.select(*(c for c in d.columns if c not in names), *(F.round(c, 4).alias(c) for c in names))


def describe_sql(column: str, source: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    c = column
    return f"""SELECT {lead}count(*) AS n, round(avg({c}), 4) AS mean, round(coalesce(stddev_samp({c}), 0), 4) AS sd, round(min({c}), 4) AS vmin, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median,
round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c}), 4) AS vmax, round(CASE WHEN avg({c}) <> 0 THEN 100 * coalesce(stddev_samp({c}), 0) / abs(avg({c})) ELSE 0 END, 4) AS cv_percent, round(coalesce(stddev_samp({c}), 0) / sqrt(count(*)), 4) AS sem FROM {source} {"GROUP BY " + by if by else ""}"""


add("describe", lambda s, d: described(stats.describe(fx.table(s, d, "events"), "value")), describe_sql("value", "events"))
add("describe_by_type", lambda s, d: described(stats.describe(fx.table(s, d, "events"), "value", ["event_type"])), describe_sql("value", "events", "event_type"))
add("cv_sem", lambda s, d: described(stats.describe(fx.table(s, d, "orders"), "o_totalprice", ["o_orderpriority"])).select("o_orderpriority", "cv_percent", "sem"), f"SELECT o_orderpriority, cv_percent, sem FROM ({describe_sql('o_totalprice', 'orders', 'o_orderpriority')})")
add(
    "value_histogram_fd",
    lambda s, d: stats.value_histogram(fx.table(s, d, "events"), "value").select(F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "n"),
    """WITH s AS (SELECT count(*)::DOUBLE AS total, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
k AS (SELECT *, CAST(greatest(5, least(40, CASE WHEN q3 > q1 THEN ceil((hi - lo) / (2 * (q3 - q1) / cbrt(total))) ELSE ceil(log2(total) + 1) END)) AS INTEGER) AS k FROM s),
w AS (SELECT *, (hi - lo) / k AS step FROM k), c AS (SELECT least(CAST(floor((value - lo) / step) AS INTEGER), k - 1) AS bin, count(*) AS n FROM events, w GROUP BY ALL)
SELECT round(lo + b.range * step, 6) AS lower, round(CASE WHEN b.range = k - 1 THEN hi ELSE lo + (b.range + 1) * step END, 6) AS upper, coalesce(n, 0) AS n FROM w CROSS JOIN range(100) b LEFT JOIN c ON c.bin = b.range WHERE b.range < k""",
)

OTSU = """prefix AS (SELECT *, sum(n) OVER w AS wb, sum(bin * n) OVER w AS sb, sum(n) OVER e AS tot, sum(bin * n) OVER e AS sall FROM (SELECT image_id, bin, n::DOUBLE AS n FROM hist) WINDOW w AS (PARTITION BY image_id ORDER BY bin), e AS (PARTITION BY image_id)),
between_ AS (SELECT *, CASE WHEN wb > 0 AND tot - wb > 0 AND bin < 255 THEN wb * (tot - wb) * (sb / wb - (sall - sb) / (tot - wb)) * (sb / wb - (sall - sb) / (tot - wb)) ELSE 0 END AS bt FROM prefix),
best AS (SELECT *, max(bt) OVER (PARTITION BY image_id) AS top FROM between_),
level AS (SELECT image_id, CAST(coalesce((min(bin) FILTER (top > 0 AND bt >= top * (1 - 1e-12)) + max(bin) FILTER (top > 0 AND bt >= top * (1 - 1e-12))) // 2, 0) AS INTEGER) AS bin FROM best GROUP BY 1)"""
TRIANGLE = """ends AS (SELECT image_id, min(bin) FILTER (n > 0) AS first, max(bin) FILTER (n > 0) AS last, first(bin ORDER BY n DESC, bin) AS peak, max(n) AS top FROM hist GROUP BY 1),
dir AS (SELECT *, (last - peak) > (peak - first) AS up, CASE WHEN (last - peak) > (peak - first) THEN last ELSE first END AS stop FROM ends),
far AS (SELECT d.*, h.bin, abs((s.n - top) * h.bin - (stop - peak) * h.n + stop * top - s.n * peak) AS dist FROM dir d JOIN hist s ON s.image_id = d.image_id AND s.bin = d.stop JOIN hist h ON h.image_id = d.image_id AND h.bin BETWEEN least(peak, stop) AND greatest(peak, stop)),
level AS (SELECT image_id, greatest(0, least(254, CASE WHEN any_value(up) THEN first(bin ORDER BY dist DESC, bin) ELSE first(bin ORDER BY dist DESC, bin) - 1 END)) AS bin FROM far GROUP BY 1)"""
ISODATA = """it(image_id, i, t, done) AS (SELECT image_id, 0, sum(bin * n)::DOUBLE / sum(n)::DOUBLE, false FROM hist GROUP BY 1
  UNION ALL SELECT image_id, i + 1, (a / n0 + b / n1) / 2, abs((a / n0 + b / n1) / 2 - t) < 0.5 FROM (
    SELECT it.image_id, it.i, it.t, sum(h.bin * h.n) FILTER (h.bin <= it.t)::DOUBLE AS a, sum(h.n) FILTER (h.bin <= it.t)::DOUBLE AS n0, sum(h.bin * h.n) FILTER (h.bin > it.t)::DOUBLE AS b, sum(h.n) FILTER (h.bin > it.t)::DOUBLE AS n1
    FROM it JOIN hist h ON h.image_id = it.image_id WHERE NOT it.done AND it.i < 100 GROUP BY ALL) WHERE n0 > 0 AND n1 > 0),
level AS (SELECT image_id, greatest(0, least(254, CAST(floor(arg_max(t, i)) AS INTEGER))) AS bin FROM it GROUP BY 1)"""
MEAN = "level AS (SELECT image_id, CAST(floor(avg(v)) AS INTEGER) AS bin FROM px GROUP BY 1)"
LEVELS = {"otsu": OTSU, "triangle": TRIANGLE, "isodata": ISODATA, "mean": MEAN}
for _method, _level in LEVELS.items():
    for _src, _sql in (("gray", fx.GRAY_SQL), ("batch", fx.BATCH_SQL)):
        add(
            f"threshold_{_method}" + ("" if _src == "gray" else "_batch"),
            lambda s, d, m=_method, f=_src: segment.threshold(getattr(fx, f)(s, d), m).where("m").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("y0"), F.max("x").alias("x1")).join(stats.find_threshold(getattr(fx, f)(s, d), m), "image_id"),
            f"WITH RECURSIVE {_sql}, {BIN8}, {_level} SELECT px.image_id, count(*) AS n, min(y) AS y0, max(x) AS x1, any_value(bin) + 1.0::DOUBLE AS threshold FROM px JOIN level USING (image_id) WHERE v >= bin + 1 GROUP BY 1",
        )
add(
    "otsu_values",
    lambda s, d: stats.otsu_values(fx.table(s, d, "orders"), "o_totalprice").select(F.round("threshold", 4).alias("threshold")),
    f"WITH px AS (SELECT 'values' AS image_id, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS v FROM orders), {EDGE}, {hist_sql(256, LO, HI)}, {OTSU} SELECT round(lo + (bin + 1) * (hi - lo) / 256, 4) AS threshold FROM level, edge",
)

# ---------------------------------------------------------------- masks


def mask_rows(mask: DataFrame) -> DataFrame:
    return mask.where("m").select("image_id", "y", "x")


def mask_query(name: str, op: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    add(name, lambda s, d: mask_rows(op(s, d)), sql)


def otsu_mask(s: SparkSession, d: str, source: str = "gray") -> DataFrame:
    return segment.threshold(getattr(fx, source)(s, d), "otsu")


mask_query("threshold_manual", lambda s, d: segment.threshold(fx.gray(s, d), "manual", 120.0), f"WITH {fx.GRAY_SQL} SELECT image_id, y, x FROM px WHERE v >= 120")
mask_query("threshold_dark", lambda s, d: segment.threshold(fx.gray(s, d), "manual", 60.0, False), f"WITH {fx.GRAY_SQL} SELECT image_id, y, x FROM px WHERE v < 60")
mask_query("threshold_range", lambda s, d: segment.value_between(fx.gray(s, d), 50, 100), f"WITH {fx.GRAY_SQL} SELECT image_id, y, x FROM px WHERE v BETWEEN 50 AND 100")
mask_query(
    "hsv_mask",
    lambda s, d: segment.color_threshold(fx.color(s, d), (300.0, 60.0), (5.0, 100.0), (20.0, 100.0)),
    f"""WITH {fx.COLOR_SQL}, u AS (SELECT *, r / 255 AS a, g / 255 AS b_, b / 255 AS c FROM px), t AS (SELECT *, greatest(a, b_, c) AS top, greatest(a, b_, c) - least(a, b_, c) AS dd FROM u),
h AS (SELECT *, CASE WHEN dd <= 1e-9 THEN 0 WHEN top = a THEN 60 * fmod((b_ - c) / dd, 6) WHEN top = b_ THEN 60 * ((c - a) / dd + 2) ELSE 60 * ((a - b_) / dd + 4) END AS hr, CASE WHEN top > 0 THEN dd / top ELSE 0 END AS s FROM t)
SELECT image_id, y, x FROM (SELECT *, CASE WHEN hr < 0 THEN hr + 360 ELSE hr END AS h FROM h) WHERE (h >= 300 OR h <= 60) AND s BETWEEN 0.05::DOUBLE AND 1 AND top BETWEEN 0.2::DOUBLE AND 1""",
)
mask_query("roi_rect", lambda s, d: segment.region(fx.gray(s, d), "rectangle", [(10.2, 5.5), (40.7, 30.5)]), f"WITH {fx.GRAY_SQL} SELECT image_id, y, x FROM px WHERE x + 0.5 >= 10.2 AND x + 0.5 < 40.7 AND y + 0.5 >= 5.5 AND y + 0.5 < 30.5")
mask_query("roi_ellipse", lambda s, d: segment.region(fx.gray(s, d), "ellipse", [(8.0, 6.0), (50.0, 40.0)]), f"WITH {fx.GRAY_SQL} SELECT image_id, y, x FROM px WHERE ((x + 0.5::DOUBLE - 29) / 21) * ((x + 0.5::DOUBLE - 29) / 21) + ((y + 0.5::DOUBLE - 23) / 17) * ((y + 0.5::DOUBLE - 23) / 17) <= 1")
_poly = [(5.0, 5.0), (55.3, 8.7), (40.1, 42.9), (30.7, 20.2), (12.4, 44.6)]
_edges = list(zip(_poly, _poly[-1:] + _poly[:-1], strict=True))
_cross = " + ".join(f"CASE WHEN ({num(ay)} > y + 0.5::DOUBLE) <> ({num(by)} > y + 0.5::DOUBLE) AND x + 0.5::DOUBLE < ({num(bx)} - {num(ax)}) * (y + 0.5::DOUBLE - {num(ay)}) / ({num(by)} - {num(ay)}) + {num(ax)} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in _edges)
mask_query("roi_polygon", lambda s, d: segment.region(fx.gray(s, d), "polygon", _poly), f"WITH {fx.GRAY_SQL} SELECT image_id, y, x FROM px WHERE ({_cross}) % 2 = 1")

FG = f"{BIN8}, {OTSU}, fg AS (SELECT px.image_id, y, x, v FROM px JOIN level USING (image_id) WHERE v >= bin + 1)"
HEAD = f"WITH RECURSIVE {fx.GRAY_SQL}, {FG}"
NEXT8 = "(SELECT a.range - 1 AS dx, b.range - 1 AS dy FROM range(3) a CROSS JOIN range(3) b WHERE a.range <> 1 OR b.range <> 1)"
NEXT4 = "(VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(dx, dy)"


def labels_sql(source: str = "fg", name: str = "lab", eight: bool = True) -> str:
    """Smallest pixel index of each object by propagation over neighbours, ids in order of it."""
    step = f"{NEXT8} o" if eight else NEXT4
    return f"""{name}_e AS (SELECT f.image_id, f.y * 64 + f.x AS a, (f.y + dy) * 64 + f.x + dx AS b FROM {source} f CROSS JOIN {step} JOIN {source} g ON g.image_id = f.image_id AND g.y = f.y + dy AND g.x = f.x + dx),
{name}_c(image_id, p, root) AS (SELECT image_id, y * 64 + x, y * 64 + x FROM {source} UNION SELECT c.image_id, e.b, c.root FROM {name}_c c JOIN {name}_e e ON e.image_id = c.image_id AND e.a = c.p WHERE c.root < e.b),
{name}_r AS (SELECT image_id, p, min(root) AS root FROM {name}_c GROUP BY 1, 2),
{name} AS (SELECT image_id, CAST(p // 64 AS INTEGER) AS y, CAST(p % 64 AS INTEGER) AS x, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS INTEGER) AS label FROM {name}_r)"""


for _eight in (True, False):
    add(f"label{8 if _eight else 4}", lambda s, d, e=_eight: refine.labels(otsu_mask(s, d), e).where("label > 0").select("image_id", "y", "x", "label"), f"{HEAD}, {labels_sql(eight=_eight)} SELECT image_id, y, x, label FROM lab")
add(
    "label8_batch",
    lambda s, d: refine.labels(otsu_mask(s, d, "batch")).where("label > 0").select("image_id", "y", "x", "label"),
    f"WITH RECURSIVE {fx.BATCH_SQL}, {FG}, {labels_sql()} SELECT image_id, y, x, label FROM lab",
)
add("label_areas", lambda s, d: refine.labels(otsu_mask(s, d)).where("label > 0").groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n")), f"{HEAD}, {labels_sql()} SELECT image_id, label, count(*) AS n FROM lab GROUP BY 1, 2")
add("mask_count", lambda s, d: otsu_mask(s, d, "batch").groupBy("image_id").agg(F.count_if("m").alias("n")), f"WITH {fx.BATCH_SQL}, {FG} SELECT image_id, count(*) AS n FROM fg GROUP BY 1")
mask_query("invert_mask", lambda s, d: segment.invert(otsu_mask(s, d)), f"{HEAD} SELECT image_id, y, x FROM px ANTI JOIN fg USING (image_id, y, x)")
mask_query("mask_and", lambda s, d: segment.both(otsu_mask(s, d), segment.region(fx.gray(s, d), "rectangle", [(10, 5), (40, 30)])), f"{HEAD} SELECT image_id, y, x FROM fg WHERE x BETWEEN 10 AND 39 AND y BETWEEN 5 AND 29")

OUTSIDE = "back AS (SELECT a.range - 1 AS x, b.range - 1 AS y FROM range(66) a CROSS JOIN range(50) b ANTI JOIN fg ON fg.x = a.range - 1 AND fg.y = b.range - 1)"
add(
    "distance_bg",
    lambda s, d: refine.distance_to_background(otsu_mask(s, d)).where("d > 0").select("image_id", "y", "x", F.round("d", 6).alias("d")),
    f"{HEAD}, {OUTSIDE} SELECT image_id, fg.y, fg.x, round(sqrt(min((fg.x - back.x) * (fg.x - back.x) + (fg.y - back.y) * (fg.y - back.y))), 6) AS d FROM fg CROSS JOIN back GROUP BY ALL",
)
NEAR = "near AS (SELECT p.image_id, p.y, p.x, sqrt(min((fg.x - p.x) * (fg.x - p.x) + (fg.y - p.y) * (fg.y - p.y))) AS d FROM px p CROSS JOIN fg GROUP BY ALL)"
add("distance_fg", lambda s, d: refine.distance_to_foreground(otsu_mask(s, d)).select("image_id", "y", "x", F.round("d", 6).alias("d")), f"{HEAD}, {NEAR} SELECT image_id, y, x, round(d, 6) AS d FROM near")
R = 1.5


def dilate_sql(source: str, name: str) -> str:
    disc = f"(SELECT a.range - 1 AS dx, b.range - 1 AS dy FROM range(3) a CROSS JOIN range(3) b WHERE (a.range - 1) * (a.range - 1) + (b.range - 1) * (b.range - 1) <= {R * R})"
    return f"{name} AS (SELECT DISTINCT px.image_id, px.y, px.x FROM {source} f CROSS JOIN {disc} o JOIN px ON px.image_id = f.image_id AND px.y = f.y + dy AND px.x = f.x + dx)"


def erode_sql(source: str, name: str) -> str:
    disc = f"(SELECT a.range - 1 AS dx, b.range - 1 AS dy FROM range(3) a CROSS JOIN range(3) b WHERE (a.range - 1) * (a.range - 1) + (b.range - 1) * (b.range - 1) <= {R * R})"
    return f"{name} AS (SELECT f.image_id, f.y, f.x FROM {source} f CROSS JOIN {disc} o JOIN {source} g ON g.image_id = f.image_id AND g.y = f.y + dy AND g.x = f.x + dx GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM {disc}))"


for _op, _sql in (("erode", erode_sql("fg", "m")), ("dilate", dilate_sql("fg", "m")), ("open", erode_sql("fg", "m0") + ", " + dilate_sql("m0", "m")), ("close", dilate_sql("fg", "m0") + ", " + erode_sql("m0", "m"))):
    mask_query(_op, lambda s, d, o=_op: refine.morphology(otsu_mask(s, d), o, R), f"{HEAD}, {_sql} SELECT image_id, y, x FROM m")
mask_query("dilate_by_offsets", lambda s, d: refine.dilate_by_offsets(otsu_mask(s, d), R), f"{HEAD}, {dilate_sql('fg', 'm')} SELECT image_id, y, x FROM m")
mask_query(
    "fill_holes",
    lambda s, d: refine.fill_holes(otsu_mask(s, d)),
    f"{HEAD}, bg AS (SELECT px.image_id, px.y, px.x FROM px ANTI JOIN fg USING (image_id, y, x)), out_(y, x) AS (SELECT y, x FROM bg WHERE x = 0 OR y = 0 OR x = 63 OR y = 47 UNION SELECT b.y, b.x FROM out_ u CROSS JOIN {NEXT4} JOIN bg b ON b.y = u.y + dy AND b.x = u.x + dx) SELECT image_id, y, x FROM px ANTI JOIN out_ USING (y, x)",
)
mask_query("size_filter", lambda s, d: refine.size_filter(otsu_mask(s, d), 3, 40), f"{HEAD}, {labels_sql()}, ok AS (SELECT label FROM lab GROUP BY 1 HAVING count(*) BETWEEN 3 AND 40) SELECT image_id, y, x FROM lab SEMI JOIN ok USING (label)")
mask_query("clear_border", lambda s, d: refine.clear_border(otsu_mask(s, d)), f"{HEAD}, {labels_sql()}, ok AS (SELECT label FROM lab GROUP BY 1 HAVING NOT bool_or(x = 0 OR y = 0 OR x = 63 OR y = 47)) SELECT image_id, y, x FROM lab SEMI JOIN ok USING (label)")
mask_query("watershed", lambda s, d: refine.watershed(otsu_mask(s, d), 0.5), None)
mask_query("shape_filter", lambda s, d: refine.shape_filter(otsu_mask(s, d), (0.3, 1.0), 4.0, 0.5), None)

# ---------------------------------------------------------------- objects

SUMS = """acc AS (SELECT l.image_id, l.label, count(*)::DOUBLE AS n, sum(l.x + 0.5::DOUBLE) AS sx, sum(l.y + 0.5::DOUBLE) AS sy, sum((l.x + 0.5::DOUBLE) * (l.x + 0.5::DOUBLE)) AS sxx, sum((l.y + 0.5::DOUBLE) * (l.y + 0.5::DOUBLE)) AS syy, sum((l.x + 0.5::DOUBLE) * (l.y + 0.5::DOUBLE)) AS sxy,
sum(px.v) AS si, sum(px.v * px.v) AS sii, min(px.v) AS imin, max(px.v) AS imax, min(l.x) AS x0, min(l.y) AS y0, max(l.x) AS x1, max(l.y) AS y1, bool_or(l.x = 0 OR l.y = 0 OR l.x = 63 OR l.y = 47) AS edge FROM lab l JOIN px ON px.image_id = l.image_id AND px.y = l.y AND px.x = l.x GROUP BY 1, 2)"""
MOMENTS = """mo AS (SELECT *, sx / n AS mx, sy / n AS my, sxx / n - (sx / n) * (sx / n) + 1.0::DOUBLE / 12 AS m20, syy / n - (sy / n) * (sy / n) + 1.0::DOUBLE / 12 AS m02, sxy / n - (sx / n) * (sy / n) AS m11 FROM acc),
ell AS (SELECT *, 4 * sqrt((m20 + m02) / 2 + sqrt(((m20 - m02) / 2) * ((m20 - m02) / 2) + m11 * m11)) AS major, 4 * sqrt(greatest((m20 + m02) / 2 - sqrt(((m20 - m02) / 2) * ((m20 - m02) / 2) + m11 * m11), 1e-12)) AS minor FROM mo)"""
OBJECTS = f"{HEAD}, {labels_sql()}, {SUMS}"


def objects(s: SparkSession, d: str, options: measure.Options | None = None, shapes: bool = False, source: str = "gray") -> DataFrame:
    return measure.particles(refine.labels(otsu_mask(s, d, source)), getattr(fx, source)(s, d), options, shapes)


def rounded(d: DataFrame, *names: str, digits: int = 5) -> DataFrame:
    return d.select(*(F.round(c, digits).alias(c) if c in names else F.col(c) for c in d.columns))


add(
    "particles_moments",
    lambda s, d: objects(s, d).select("id", "pixel_count", F.round("centroid_x", 6).alias("centroid_x"), F.round("centroid_y", 6).alias("centroid_y"), F.round("major_axis", 5).alias("major_axis"), F.round("minor_axis", 5).alias("minor_axis"), F.round("equivalent_diameter", 5).alias("equivalent_diameter"), F.round("aspect_ratio", 5).alias("aspect_ratio")),
    f"{OBJECTS}, {MOMENTS} SELECT label AS id, CAST(n AS INTEGER) AS pixel_count, round(mx, 6) AS centroid_x, round(my, 6) AS centroid_y, round(major, 5) AS major_axis, round(minor, 5) AS minor_axis, round(2 * sqrt(n / pi()), 5) AS equivalent_diameter, round(major / minor, 5) AS aspect_ratio FROM ell",
)
add(
    "particles_intensity",
    lambda s, d: objects(s, d).select("id", *(F.round(c, 5).alias(c) for c in ("mean_intensity", "std_intensity", "min_intensity", "max_intensity", "integrated_intensity"))),
    f"{OBJECTS} SELECT label AS id, round(si / n, 5) AS mean_intensity, round(CASE WHEN n < 2 THEN 0 ELSE sqrt(greatest(0, (sii - si * si / n) / (n - 1))) END, 5) AS std_intensity, imin AS min_intensity, imax AS max_intensity, si AS integrated_intensity FROM acc",
)
add("particles_bounds", lambda s, d: objects(s, d).select("id", "bounds_x", "bounds_y", "bounds_width", "bounds_height", "touches_edge"), f"{OBJECTS} SELECT label AS id, x0 AS bounds_x, y0 AS bounds_y, x1 - x0 + 1 AS bounds_width, y1 - y0 + 1 AS bounds_height, edge AS touches_edge FROM acc")
FERET = """rows_ AS (SELECT label, y, min(x) AS a, max(x) + 1 AS b FROM lab GROUP BY 1, 2), pts AS (SELECT DISTINCT label, unnest([a, b, a, b]) AS qx, unnest([y, y, y + 1, y + 1]) AS qy FROM rows_),
fer AS (SELECT p.label, max(sqrt((p.qx - q.qx) * (p.qx - q.qx) + (p.qy - q.qy) * (p.qy - q.qy))) AS feret FROM pts p JOIN pts q ON q.label = p.label GROUP BY 1)"""
add("particles_feret", lambda s, d: measure.outlines(refine.labels(otsu_mask(s, d))).select("label", F.round("feret", 6).alias("feret")), f"{OBJECTS}, {FERET} SELECT label, round(feret, 6) AS feret FROM fer")
add("feret_by_rows", lambda s, d: measure.feret_by_rows(refine.labels(otsu_mask(s, d))).select("label", F.round("feret", 6).alias("feret")), f"{OBJECTS}, {FERET} SELECT label, round(feret, 6) AS feret FROM fer")
add("particles_outline", lambda s, d: measure.outlines(refine.labels(otsu_mask(s, d))))
add(
    "exclude_points",
    lambda s, d: objects(s, d, measure.Options(min_area=2, exclude_edges=True, exclude_points=((20.5, 20.5), (30.2, 11.7), (41.0, 33.9), (900.0, 3.0)))).select("id", "pixel_count", "bounds_x", "bounds_y"),
    f"{OBJECTS}, hit AS (SELECT DISTINCT label FROM lab WHERE (x, y) IN ((20, 20), (30, 11), (41, 33))) SELECT CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS id, CAST(n AS INTEGER) AS pixel_count, x0 AS bounds_x, y0 AS bounds_y FROM acc ANTI JOIN hit USING (label) WHERE n >= 2 AND NOT edge",
)
add("classify_positive", lambda s, d: objects(s, d, measure.Options(positive=measure.PositiveRule(200.0))).select("id", "positive"), f"{OBJECTS} SELECT label AS id, si / n >= 200 AS positive FROM acc")


def summary(s: SparkSession, d: str, options: measure.Options, source: str = "gray") -> DataFrame:
    pixels = getattr(fx, source)(s, d)
    images = pixels.groupBy("image_id").agg(F.count(F.lit(1)).alias("analyzed_pixels"))
    out = measure.summary(images, objects(s, d, options, False, source), options)
    return out.select("image_id", "count", *(F.round(c, 5).alias(c) for c in ("total_area", "mean_area", "median_area", "std_area", "analyzed_area", "area_fraction", "mean_intensity", "density", "positive_percent")), "positive_count", "area_unit")


def summary_sql(u: float, where: str, rule: str, unit: str) -> str:
    a = num(u * u)
    return f"""SELECT i.image_id, count(o.label) AS count, round(coalesce(sum(o.n), 0) * {a}, 5) AS total_area, round(coalesce(avg(o.n * {a}), 0), 5) AS mean_area, round(coalesce(quantile_cont(o.n * {a}, 0.5), 0), 5) AS median_area, round(coalesce(stddev_samp(o.n * {a}), 0), 5) AS std_area,
round(3072 * {a}, 5) AS analyzed_area, round(100 * coalesce(sum(o.n), 0) / 3072, 5) AS area_fraction, round(coalesce(sum(o.si) / sum(o.n), 0), 5) AS mean_intensity, round(count(o.label) / (3072 * {a}), 5) AS density,
round(coalesce(100.0::DOUBLE * count(*) FILTER ({rule}) / nullif(count(o.label), 0), 0), 5) AS positive_percent, count(*) FILTER ({rule}) AS positive_count, '{unit}' AS area_unit FROM (SELECT DISTINCT image_id FROM px) i LEFT JOIN (SELECT * FROM acc WHERE {where}) o ON o.image_id = i.image_id GROUP BY 1"""


add("summary", lambda s, d: summary(s, d, measure.Options(positive=measure.PositiveRule(200.0))), f"{OBJECTS} {summary_sql(1, 'true', 'si / o.n >= 200', 'px²')}")
_calibrated = measure.Options(min_area=0.5, exclude_edges=True, positive=measure.PositiveRule(200.0, False), calibration=measure.Calibration(0.5, "µm"))
add("summary_calibrated", lambda s, d: summary(s, d, _calibrated), f"{OBJECTS} {summary_sql(0.5, 'n * 0.25 >= 0.5 AND NOT edge', 'si / o.n < 200', 'µm²')}")
add("batch_summary", lambda s, d: summary(s, d, measure.Options(positive=measure.PositiveRule(200.0)), "batch"), f"WITH RECURSIVE {fx.BATCH_SQL}, {FG}, {labels_sql()}, {SUMS} {summary_sql(1, 'true', 'si / o.n >= 200', 'px²')}")
add(
    "sort_particles",
    lambda s, d: measure.sort_particles(objects(s, d), "mean_intensity").select("id", F.round("mean_intensity", 5).alias("mean_intensity")),
    f"{OBJECTS} SELECT label AS id, round(si / n, 5) AS mean_intensity FROM acc ORDER BY si / n DESC, label",
)
add("top_particles", lambda s, d: objects(s, d).orderBy(F.col("pixel_count").desc(), "id").limit(10).select("id", "pixel_count"), f"{OBJECTS} SELECT label AS id, CAST(n AS INTEGER) AS pixel_count FROM acc ORDER BY n DESC, label LIMIT 10")
add("first_rows", lambda s, d: measure.first_rows(objects(s, d), 20).select("id", "pixel_count"), f"{OBJECTS} SELECT label AS id, CAST(n AS INTEGER) AS pixel_count FROM acc ORDER BY label LIMIT 20")
add(
    "auto_positive_threshold",
    lambda s, d: measure.auto_positive_threshold(objects(s, d)),
    f"WITH RECURSIVE {fx.GRAY_SQL}, {FG}, {labels_sql()}, {SUMS}, px2 AS (SELECT 'values' AS image_id, CAST(CAST(si / n AS FLOAT) AS DOUBLE) AS v FROM acc), e2 AS (SELECT min(v) AS lo, max(v) AS hi FROM px2), "
    + hist_sql(256, "(SELECT lo FROM e2)", "(SELECT hi FROM e2)", "px2").replace("counts AS", "counts2 AS").replace("JOIN counts c", "JOIN counts2 c").replace("hist AS", "hist2 AS")
    + ", " + OTSU.replace("FROM hist)", "FROM hist2)").replace("prefix", "prefix2").replace("between_", "between2").replace("best", "best2").replace("level AS", "level2 AS")
    + " SELECT round_even(lo + (bin + 1) * (hi - lo) / 256, 4) AS threshold FROM level2, e2",
)

# ---------------------------------------------------------------- classes, search, display

CENTERS = [(0.1,), (0.45,), (0.8,)]
_dist = [f"(v / 255 - {num(c[0])}) * (v / 255 - {num(c[0])})" for c in CENTERS]
add("kmeans_assign", lambda s, d: segment.assign_clusters(fx.gray(s, d), CENTERS).select("image_id", "y", "x", "cluster"), f"WITH {fx.GRAY_SQL} SELECT image_id, y, x, CASE WHEN {_dist[0]} <= {_dist[1]} AND {_dist[0]} <= {_dist[2]} THEN 0 WHEN {_dist[1]} <= {_dist[2]} THEN 1 ELSE 2 END AS cluster FROM px")
add("kmeans_update", lambda s, d: segment.cluster_sums(fx.gray(s, d), CENTERS).select("cluster", "n", F.round("v", 6).alias("v")), f"WITH {fx.GRAY_SQL}, a AS (SELECT v, CASE WHEN {_dist[0]} <= {_dist[1]} AND {_dist[0]} <= {_dist[2]} THEN 0 WHEN {_dist[1]} <= {_dist[2]} THEN 1 ELSE 2 END AS cluster FROM px) SELECT cluster, count(*) AS n, round(avg(v / 255), 6) AS v FROM a GROUP BY 1")
add("display_range", lambda s, d: render.display_range(fx.embedding(s, d)).select(F.round("dlo", 6).alias("dlo"), F.round("dhi", 6).alias("dhi")), f"WITH {fx.EMB_SQL}, {EDGE}, {hist_sql(2048, LO, HI)}, {quantile_sql('qa', num(0.001), 2048, LO, HI)}, {quantile_sql('qb', num(0.999), 2048, LO, HI)} SELECT round(qa.q, 6) AS dlo, round(qb.q, 6) AS dhi FROM qa, qb")


def fire(k: int) -> str:
    return f"CAST(greatest(0, least(255, floor((v / 255 * 3 - {k}) * 255 + 0.5::DOUBLE))) AS INTEGER)"


add("lut_render", lambda s, d: render.colorize(fx.gray(s, d), "fire"), f"WITH {fx.GRAY_SQL} SELECT image_id, y, x, {fire(0)} AS red, {fire(1)} AS green, {fire(2)} AS blue FROM px")
add("lut_render_color", lambda s, d: render.colorize(fx.color(s, d)), f"WITH {fx.COLOR_SQL} SELECT image_id, y, x, CAST(r AS INTEGER) AS red, CAST(g AS INTEGER) AS green, CAST(b AS INTEGER) AS blue FROM px")
_around = "(SELECT count(*) FROM fg q WHERE abs(q.x - fg.x) + abs(q.y - fg.y) = 1)"
_outline = f"CASE WHEN x = 0 OR y = 0 OR x = 63 OR y = 47 OR {_around} < 4 THEN 255 ELSE 110 END"
_mark = ", ".join(f"{v} AS {n}" for v, n in zip(render.MARK, ("red", "green", "blue"), strict=True))
add("overlay_edges", lambda s, d: render.mask_overlay(otsu_mask(s, d)), f"{HEAD} SELECT image_id, y, x, {_outline} AS alpha, {_mark} FROM fg")
add(
    "compose",
    lambda s, d: render.compose(render.colorize(fx.gray(s, d)), render.mask_overlay(otsu_mask(s, d)), 0.6),
    f"{HEAD}, o AS (SELECT y, x, {_outline} / 255.0::DOUBLE * 0.6::DOUBLE AS a FROM fg) SELECT image_id, px.y, px.x, "
    + ", ".join(f"CAST(CASE WHEN a > 0 THEN round_even(v * (1 - a) + {m} * a, 0) ELSE v END AS INTEGER) AS {n}" for m, n in zip(render.MARK, ("red", "green", "blue"), strict=True))
    + " FROM px LEFT JOIN o ON o.y = px.y AND o.x = px.x",
)
add("mask_image", lambda s, d: render.mask_image(otsu_mask(s, d)), f"{HEAD} SELECT px.image_id, px.y, px.x, " + ", ".join(f"CASE WHEN fg.y IS NULL THEN 0 ELSE 255 END AS {n}" for n in ("red", "green", "blue")) + " FROM px LEFT JOIN fg ON fg.y = px.y AND fg.x = px.x")
add("label_overlay", lambda s, d: render.label_overlay(refine.labels(otsu_mask(s, d)), "per_object", 3))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of the derived raster above Otsu's threshold, with all measures."""
    return objects(spark, sf_dir, shapes=True)


add("flagship", flagship)


# ---------------------------------------------------------------- recipes: the fused path over images as rows

OTSU_STEP = Step("threshold", {"method": METHODS.index("otsu")})


def recipe_images(s: SparkSession, d: str, source: str, steps: tuple[Step, ...], mask: bool = False) -> DataFrame:
    """Pixels of the images of a fixture after a recipe; of its mask the object pixels."""
    out = model.explode_pixels(engine.transform(model.implode_pixels(getattr(fx, source)(s, d)), Recipe(steps=steps), mask), 1)
    return out.where("v > 0").select("image_id", "y", "x") if mask else values(out)


for _name, _steps in {
    "invert": (Step("invert"),),
    "median_r1": (Step("median", {"radius": 1}),),
    "crop": (Step("crop", {"x": 10, "y": 5, "width": 30, "height": 100}),),
    "flip_h": (Step("flip", {"direction": 0}),),
    "flip_v": (Step("flip", {"direction": 1}),),
    "rotate_cw": (Step("rotate", {"rotation": 0}),),
    "rotate_180": (Step("rotate", {"rotation": 1}),),
    "rotate_ccw": (Step("rotate", {"rotation": 2}),),
}.items():
    add(f"recipe_{_name}", lambda s, d, steps=_steps: recipe_images(s, d, "gray", steps), SQL[_name])
for _name, _steps in {
    "threshold_manual": (Step("threshold", {"method": METHODS.index("manual"), "value": 120}),),
    "threshold_dark": (Step("threshold", {"method": METHODS.index("manual"), "value": 60, "bright": 1}),),
    "invert_mask": (OTSU_STEP, Step("invertMask")),
    "erode": (OTSU_STEP, Step("morphology", {"op": 0, "radius": R})),
    "dilate": (OTSU_STEP, Step("morphology", {"op": 1, "radius": R})),
    "open": (OTSU_STEP, Step("morphology", {"op": 2, "radius": R})),
    "close": (OTSU_STEP, Step("morphology", {"op": 3, "radius": R})),
    "fill_holes": (OTSU_STEP, Step("fillHoles")),
    "size_filter": (OTSU_STEP, Step("sizeFilter", {"min": 3, "max": 40})),
    "clear_border": (OTSU_STEP, Step("clearBorder")),
}.items():
    add(f"recipe_{_name}", lambda s, d, steps=_steps: recipe_images(s, d, "gray", steps, True), SQL[_name])


def recipe_particles(s: SparkSession, d: str) -> DataFrame:
    return engine.particles(model.implode_pixels(fx.gray(s, d)), Recipe(steps=(OTSU_STEP,)))


add(
    "recipe_particles_moments",
    lambda s, d: recipe_particles(s, d).select("id", "pixel_count", F.round("centroid_x", 6).alias("centroid_x"), F.round("centroid_y", 6).alias("centroid_y"), *(F.round(c, 5).alias(c) for c in ("major_axis", "minor_axis", "equivalent_diameter", "aspect_ratio"))),
    SQL["particles_moments"],
)
add("recipe_particles_intensity", lambda s, d: recipe_particles(s, d).select("id", *(F.round(c, 5).alias(c) for c in ("mean_intensity", "std_intensity", "min_intensity", "max_intensity", "integrated_intensity"))), SQL["particles_intensity"])
add("recipe_particles_bounds", lambda s, d: recipe_particles(s, d).select("id", "bounds_x", "bounds_y", "bounds_width", "bounds_height", "touches_edge"), SQL["particles_bounds"])
add("recipe_particles_feret", lambda s, d: recipe_particles(s, d).select(F.col("id").alias("label"), F.round("feret", 6).alias("feret")), SQL["particles_feret"])


def recipe_summary(s: SparkSession, d: str) -> DataFrame:
    out = engine.summaries(model.implode_pixels(fx.batch(s, d)), Recipe(steps=(OTSU_STEP,), measure=Measure(classify=True, positive_threshold=200.0)))
    return out.select("image_id", "count", *(F.round(c, 5).alias(c) for c in ("total_area", "mean_area", "median_area", "std_area", "analyzed_area", "area_fraction", "mean_intensity", "density", "positive_percent")), "positive_count", "area_unit")


add("recipe_batch_summary", recipe_summary, SQL["batch_summary"])

#: Place and size of the part of the image that is searched for.
PART_X, PART_Y, PART_W, PART_H = 20, 15, 8, 6
LOW_SCORE = 0.35


def template_search(s: SparkSession, d: str) -> DataFrame:
    image = fx.gray(s, d)
    part = image.where(F.col("x").between(PART_X, PART_X + PART_W - 1) & F.col("y").between(PART_Y, PART_Y + PART_H - 1)).orderBy("y", "x").select("v").collect()
    cut = Raster.of(np.array([r.v for r in part], np.float32).reshape(PART_H, PART_W))
    return engine.template_matches(model.implode_pixels(image), cut, LOW_SCORE, 20).select("image_id", "x", "y", "width", "height", F.round("score", 3).alias("score"))


add(
    "template_search",
    template_search,
    f"""WITH {fx.GRAY_SQL}, t AS (SELECT x - {PART_X} AS dx, y - {PART_Y} AS dy, v - avg(v) OVER () AS t FROM px WHERE x BETWEEN {PART_X} AND {PART_X + PART_W - 1} AND y BETWEEN {PART_Y} AND {PART_Y + PART_H - 1}),
c AS (SELECT p.image_id, p.x - t.dx AS x, p.y - t.dy AS y, sum(p.v * t.t) AS cross_, sum(p.v * p.v) - sum(p.v) * sum(p.v) / count(*) AS var_, sum(t.t * t.t) AS norm_ FROM px p CROSS JOIN t WHERE p.x - t.dx BETWEEN 0 AND {64 - PART_W} AND p.y - t.dy BETWEEN 0 AND {48 - PART_H} GROUP BY ALL),
m AS (SELECT image_id, x, y, CASE WHEN var_ > 1e-9 THEN cross_ / sqrt(var_ * norm_) ELSE 0.0::DOUBLE END AS score FROM c),
top AS (SELECT a.image_id, a.x, a.y, a.score FROM m a JOIN m b ON abs(a.x - b.x) <= {PART_W // 2} AND abs(a.y - b.y) <= {PART_H // 2} WHERE a.score >= {LOW_SCORE} GROUP BY ALL HAVING a.score >= max(b.score))
SELECT image_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, {PART_W} AS width, {PART_H} AS height, round(round(score, 4), 3) AS score FROM top ORDER BY score DESC LIMIT 20""",
)
