"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Relational queries run on rasters derived from lineitem. Two numbers per recipe step compare with the published
latency of one step on one 2000 x 1500 x 3 image: seconds for a single such image, and megapixels a second over a
batch, where the fixed cost of a job is spread. Images are PNG files in a folder, read as users' folders are, so both
numbers hold the decoding too; "decode" is a recipe without steps. Each figure goes to stderr as it comes.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pixelgrain import queries
from pixelgrain.plans import engine
from pixelgrain.plans.recipe import Recipe, Step
from pixelgrain.sources import codecs
from pixelgrain.sources.files import find_images

QUERIES = ("flagship", "pixel_histogram_batch", "threshold_otsu_batch", "clahe", "gaussian_exact", "median_r1", "sobel", "resize_half", "label8_batch", "open", "particles_moments", "batch_summary", "describe_by_type", "value_histogram_fd")
STEPS = ("gray", "stain", "gaussian", "background", "sobel", "clahe", "colorThreshold", "threshold")
WIDTH, HEIGHT, BATCH = 2000, 1500, int(os.environ.get("BENCH_BATCH", "64"))


def write_images(n: int, path: str) -> None:
    """n colour images with smooth content as PNG files; eight different ones, then the same again under other names."""
    os.makedirs(path)
    y, x = np.mgrid[0:HEIGHT, 0:WIDTH]
    base = np.stack([128 + 100 * np.sin(x / (31 + c)) * np.cos(y / (23 + c)) for c in range(3)], axis=2)
    coded = [codecs.encode_png(np.clip(np.rint(base + k), 0, 255).astype(np.uint8)) for k in range(min(n, 8))]
    for k in range(n):
        with open(f"{path}/image{k:03d}.png", "wb") as file:
            file.write(coded[k % 8])


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 3)


def told(name: str, value: float) -> float:
    print(f"{name}: {value}", file=sys.stderr, flush=True)
    return value


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "16m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    spark.range(10).count()
    for name in QUERIES:
        frame = queries.QUERIES[name](spark, sf_dir)
        seconds[name] = told(name, timed(lambda f=frame: f.write.format("noop").mode("overwrite").save()))
    folder = tempfile.mkdtemp(prefix="bench-images-")  # one machine: executors of a local session read it
    latency, rate = {}, {}
    try:
        write_images(1, f"{folder}/one")
        write_images(BATCH, f"{folder}/many")
        for kind in ("decode", *STEPS):
            recipe = Recipe(steps=() if kind == "decode" else (Step(kind),))
            work = lambda name, r=recipe: engine.outcomes(find_images(spark, f"{folder}/{name}"), r).agg(F.count("applied")).collect()
            work("one")
            latency[kind] = told(f"{kind}, one image", timed(lambda: work("one")))
            took = told(f"{kind}, {BATCH} images", timed(lambda: work("many")))
            seconds[f"step_{kind}_x{BATCH}"] = took
            rate[kind] = round(BATCH * WIDTH * HEIGHT / 1e6 / took, 1)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1], "step_seconds_one_image": latency, "step_mpx_per_s_batch": rate}), flush=True)


if __name__ == "__main__":
    main()
