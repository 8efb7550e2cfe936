"""Histograms, statistics and automatic thresholds, all per image in one aggregation and windows over few bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import luma
from ..model import KEY, is_color


def gray_values(pixels: DataFrame) -> DataFrame:
    if is_color(pixels):
        return pixels.withColumn("v", luma(F.col("r"), F.col("g"), F.col("b"))).drop("r", "g", "b")
    return pixels


def value_range(pixels: DataFrame) -> DataFrame:
    """(image_id, vmin, vmax) over all samples."""
    if is_color(pixels):
        return pixels.groupBy("image_id").agg(F.min(F.least("r", "g", "b")).alias("vmin"), F.max(F.greatest("r", "g", "b")).alias("vmax"))
    return pixels.groupBy("image_id").agg(F.min("v").alias("vmin"), F.max("v").alias("vmax"))


def bin_of(v: Column, low: Column, high: Column, bins: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((v - low) * bins / (high - low)).cast("int")))


def histogram_range(pixels: DataFrame) -> DataFrame:
    """(image_id, low, high): 0 to 256 for 8-bit images, else the data's range, opened to 1 if it is a point."""
    eight = (F.first("lo") == 0) & (F.first("hi") == 255)
    low, high = F.min("v"), F.max("v")
    return pixels.groupBy("image_id").agg(F.when(eight, F.lit(0.0)).otherwise(low).alias("low"), F.when(eight, F.lit(256.0)).when(high > low, high).otherwise(low + 1).alias("high"))


def histogram(pixels: DataFrame, bins: int = 256, ranges: DataFrame | None = None) -> DataFrame:
    """(image_id, low, high, bin, n) with every bin of every image; truncation toward the lower bin, ends clamped.

    ranges: (image_id, low, high) where the range is given. The counts shuffle as image x bin partial sums.
    """
    gray = gray_values(pixels)
    ranges = histogram_range(gray) if ranges is None else ranges
    counts = gray.select("image_id", "v").join(ranges, "image_id").groupBy("image_id", bin_of(F.col("v"), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = ranges.select("image_id", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(counts, ["image_id", "bin"], "left").select("image_id", "low", "high", "bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def histogram_stats(pixels: DataFrame) -> DataFrame:
    """count, mean, sd (n - 1, 0 below two), min, max per image."""
    gray = gray_values(pixels)
    return gray.groupBy("image_id").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"), F.min("v").alias("vmin"), F.max("v").alias("vmax"))


def mode_bin(hist: DataFrame) -> DataFrame:
    """Centre of the first fullest bin."""
    best = hist.groupBy("image_id").agg(F.max_by(F.struct("bin", "low", "high"), F.struct(F.col("n"), -F.col("bin"))).alias("b"), F.count(F.lit(1)).alias("bins"))
    return best.select("image_id", (F.col("b.low") + (F.col("b.bin") + 0.5) * (F.col("b.high") - F.col("b.low")) / F.col("bins")).alias("mode"))


def histogram_quantile(hist: DataFrame, q: float, bins: int = 256) -> DataFrame:
    """First filled bin whose running count reaches q of all, linear inside it."""
    w = W.partitionBy("image_id").orderBy("bin")
    run = hist.withColumn("cum", F.sum("n").over(w)).withColumn("total", F.sum("n").over(W.partitionBy("image_id")))
    hit = run.where((F.col("n") > 0) & (F.col("cum") >= F.lit(q) * F.col("total")))
    first = hit.groupBy("image_id").agg(F.min_by(F.struct("bin", "n", "cum", "total", "low", "high"), "bin").alias("s"))
    step = (F.col("s.high") - F.col("s.low")) / bins
    inside = (F.lit(q) * F.col("s.total") - (F.col("s.cum") - F.col("s.n"))) / F.col("s.n")
    return first.select("image_id", (F.col("s.low") + F.col("s.bin") * step + inside * step).alias("quantile"))


def otsu(hist: DataFrame, bins: int = 256) -> DataFrame:
    """(image_id, bin): middle of the plateau of the largest between-class variance; 0 where there is none."""
    w = W.partitionBy("image_id").orderBy("bin")
    every = W.partitionBy("image_id")
    d = hist.select("image_id", "bin", F.col("n").cast("double").alias("n"), (F.col("bin") * F.col("n")).cast("double").alias("s"))
    d = d.withColumns({"wb": F.sum("n").over(w), "sb": F.sum("s").over(w), "total": F.sum("n").over(every), "sum_all": F.sum("s").over(every)})
    wf = F.col("total") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("sum_all") - F.col("sb")) / wf
    between = F.when((F.col("wb") > 0) & (wf > 0) & (F.col("bin") < bins - 1), F.col("wb") * wf * gap * gap).otherwise(F.lit(0.0))
    d = d.withColumn("between", between).withColumn("best", F.max("between").over(every))
    level = F.when((F.col("best") > 0) & (F.col("between") >= F.col("best") * (1 - 1e-12)), F.col("bin"))
    return d.groupBy("image_id").agg(F.coalesce(F.floor((F.min(level) + F.max(level)) / 2).cast("int"), F.lit(0)).alias("bin"))


def triangle(hist: DataFrame, bins: int = 256) -> DataFrame:
    """(image_id, bin): farthest point from the line between the peak and the farther end of the histogram."""
    every = W.partitionBy("image_id")
    filled = F.when(F.col("n") > 0, F.col("bin"))
    d = hist.withColumns({"first": F.min(filled).over(every), "last": F.max(filled).over(every), "peak": F.max_by("bin", F.struct(F.col("n"), -F.col("bin"))).over(every), "top": F.max("n").over(every)})
    up = (F.col("last") - F.col("peak")) > (F.col("peak") - F.col("first"))
    d = d.withColumn("up", up).withColumn("stop", F.when(F.col("up"), F.col("last")).otherwise(F.col("first")))
    d = d.withColumn("low_n", F.max(F.when(F.col("bin") == F.col("stop"), F.col("n"))).over(every))
    dx, dy = F.col("stop") - F.col("peak"), F.col("low_n") - F.col("top")
    far = F.abs(dy * F.col("bin") - dx * F.col("n") + F.col("stop") * F.col("top") - F.col("low_n") * F.col("peak"))
    within = F.col("bin").between(F.least("peak", "stop"), F.greatest("peak", "stop"))
    best = d.where(within).withColumn("far", far).groupBy("image_id").agg(F.max_by(F.struct("bin", "up", "first", "last"), F.struct(F.col("far"), -F.col("bin"))).alias("s"))
    level = F.when(F.col("s.first") == F.col("s.last"), F.col("s.first")).when(F.col("s.up"), F.col("s.bin")).otherwise(F.col("s.bin") - 1)
    clamped = F.when(F.col("s.first") == F.col("s.last"), level).otherwise(F.greatest(F.lit(0), F.least(F.lit(bins - 2), level)))
    return best.select("image_id", clamped.cast("int").alias("bin"))


def isodata(hist: DataFrame, bins: int = 256, rounds: int = 100) -> DataFrame:
    """(image_id, bin): the threshold that lies midway between the means of its two sides, by iteration on one row per image."""
    one = hist.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", F.col("n").cast("double").alias("n")))), lambda s: s["n"]).alias("c"))
    total = "aggregate(c, 0D, (a, x) -> a + x)"
    first = f"aggregate(zip_with(c, sequence(0, {bins - 1}), (x, i) -> x * i), 0D, (a, x) -> a + x) / greatest({total}, 1D)"
    sums = "aggregate(zip_with(c, sequence(0, {k}), (x, i) -> IF(i <= s.t, struct(x * i AS a, x AS n0, 0D AS b, 0D AS n1), struct(0D AS a, 0D AS n0, x * i AS b, x AS n1))), struct(0D AS a, 0D AS n0, 0D AS b, 0D AS n1), (p, x) -> struct(p.a + x.a AS a, p.n0 + x.n0 AS n0, p.b + x.b AS b, p.n1 + x.n1 AS n1))".format(k=bins - 1)
    step = f"""transform(array({sums}), q -> CASE WHEN s.done OR q.n0 = 0 OR q.n1 = 0 THEN struct(s.t AS t, true AS done)
      ELSE struct((try_divide(q.a, q.n0) + try_divide(q.b, q.n1)) / 2 AS t, abs((try_divide(q.a, q.n0) + try_divide(q.b, q.n1)) / 2 - s.t) < 0.5 AS done) END)[0]"""
    t = F.expr(f"aggregate(sequence(1, {rounds}), struct({first} AS t, false AS done), (s, i) -> {step}, s -> s.t)")
    return one.select("image_id", F.when(F.expr(total) == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(bins - 2), F.floor(t).cast("int")))).alias("bin"))


def mean_bin(pixels: DataFrame, hist: DataFrame, bins: int = 256) -> DataFrame:
    ranges = hist.select("image_id", "low", "high").distinct()
    return histogram_stats(pixels).join(ranges, "image_id").select("image_id", bin_of(F.col("mean"), F.col("low"), F.col("high"), bins).alias("bin"))


def threshold_value(hist: DataFrame, level: DataFrame, bins: int = 256) -> DataFrame:
    """(image_id, threshold): lower edge of the bin after level."""
    ranges = hist.groupBy("image_id").agg(F.first("low").alias("low"), F.first("high").alias("high"))
    return ranges.join(level, "image_id").select("image_id", (F.col("low") + (F.col("bin") + 1) * (F.col("high") - F.col("low")) / bins).alias("threshold"))


METHODS = ("manual", "otsu", "triangle", "mean", "isodata")


def find_threshold(pixels: DataFrame, method: str, bins: int = 256) -> DataFrame:
    """(image_id, threshold) by an automatic method."""
    hist = histogram(pixels, bins)
    levels = {"otsu": lambda: otsu(hist), "triangle": lambda: triangle(hist), "isodata": lambda: isodata(hist), "mean": lambda: mean_bin(pixels, hist)}
    if method not in levels:
        raise ValueError(f"no automatic method {method!r}")
    return threshold_value(hist, levels[method]())


def finite(values: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return values.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def describe(values: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, sd, min, q1, median, q3, max, cv_percent, sem of the finite values; exact quartiles (type 7)."""
    c = F.col(column)
    out = finite(values.withColumn(column, c.cast("double")), column).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("sd"), F.min(c).alias("vmin"), F.percentile(c, F.lit(0.25)).alias("q1"), F.percentile(c, F.lit(0.5)).alias("median"), F.percentile(c, F.lit(0.75)).alias("q3"), F.max(c).alias("vmax")
    )
    return out.withColumns({"cv_percent": F.when(F.col("mean") != 0, 100 * F.col("sd") / F.abs("mean")).otherwise(F.lit(0.0)), "sem": F.when(F.col("n") > 0, F.try_divide("sd", F.sqrt("n"))).otherwise(F.lit(0.0))})


def value_histogram(values: DataFrame, column: str, bin_count: int | None = None) -> DataFrame:
    """(lower, upper, n) of equal bins: their number by Freedman-Diaconis, by Sturges where the quartiles agree, 5 to 40."""
    own = finite(values.select(F.col(column).cast("double").alias("v")), "v")
    s = own.agg(F.count(F.lit(1)).alias("total"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile("v", F.lit(0.25)).alias("q1"), F.percentile("v", F.lit(0.75)).alias("q3"))
    iqr, span = F.col("q3") - F.col("q1"), F.col("high") - F.col("low")
    fd = F.ceil(F.try_divide(span, F.try_divide(2 * iqr, F.cbrt(F.col("total").cast("double")))))
    auto = F.when(iqr > 0, fd).otherwise(F.ceil(F.log2(F.col("total").cast("double")) + 1))
    k = F.greatest(F.lit(1), F.lit(bin_count)) if bin_count else F.greatest(F.lit(5), F.least(F.lit(40), auto))
    s = s.where("total > 0").withColumn("k", F.when(span < 1e-12, F.lit(1)).otherwise(k).cast("int")).withColumn("step", F.col("high") / F.col("k") - F.col("low") / F.col("k"))
    s = s.withColumn("step", span / F.col("k"))
    counts = own.crossJoin(F.broadcast(s)).groupBy(F.when(F.col("step") > 0, F.least(F.floor(F.try_divide(F.col("v") - F.col("low"), F.col("step"))).cast("int"), F.col("k") - 1)).otherwise(F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = s.select("low", "high", "k", "step", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"))
    upper = F.when(F.col("bin") == F.col("k") - 1, F.col("high")).otherwise(F.col("low") + (F.col("bin") + 1) * F.col("step"))
    return frame.join(F.broadcast(counts), "bin", "left").select((F.col("low") + F.col("bin") * F.col("step")).alias("lower"), upper.alias("upper"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def otsu_values(values: DataFrame, column: str) -> DataFrame:
    """(threshold) of a column by Otsu's method on 256 bins over the data's range; the minimum where it is a point."""
    own = finite(values.select(F.lit("values").alias("image_id"), F.col(column).cast("float").cast("double").alias("v")), "v")
    ranges = own.groupBy("image_id").agg(F.min("v").alias("low"), F.max("v").alias("top")).withColumn("high", F.when(F.col("top") - F.col("low") < 1e-9, F.col("low") + 1).otherwise(F.col("top")))
    hist = histogram(own.select("image_id", "v"), 256, ranges.select("image_id", "low", "high"))
    out = threshold_value(hist, otsu(hist)).join(ranges, "image_id")
    return out.select(F.when(F.col("top") - F.col("low") < 1e-9, F.col("low")).otherwise(F.col("threshold")).alias("threshold"))
