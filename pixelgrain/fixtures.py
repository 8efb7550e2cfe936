"""Rasters that follow from the driver's tables by closed formulas, for Spark and, as SQL, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 64, 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid(spark: SparkSession) -> DataFrame:
    return spark.range(WIDTH * HEIGHT).select(F.col("id").alias("k"))


def _cells(spark: SparkSession, sf_dir: str, by: str | None, **sums: str) -> DataFrame:
    """Sums over lineitem per cell, scaled to whole numbers of 0 to 255 by the largest cell of the image; empty cells are 0."""
    items = table(spark, sf_dir, "lineitem")
    image = F.col(by) if by else F.lit("R")
    cells = items.groupBy(image.alias("image_id"), ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % (WIDTH * HEIGHT)).alias("k")).agg(*(F.sum(F.expr(e)).alias(n) for n, e in sums.items()))
    peaks = cells.groupBy("image_id").agg(*(F.max(n).alias(f"max_{n}") for n in sums))
    frame = peaks.crossJoin(F.broadcast(_grid(spark))).join(cells, ["image_id", "k"], "left")
    scaled = [F.floor(F.coalesce(F.col(n), F.lit(0.0)) * 255.0 / F.col(f"max_{n}")).cast("double").alias(n) for n in sums]
    return frame.select(
        "image_id", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(0.0).alias("lo"), F.lit(255.0).alias("hi"), F.expr(f"cast(k div {WIDTH} as int)").alias("y"), (F.col("k") % WIDTH).cast("int").alias("x"), *scaled
    )


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, None, v="l_quantity")


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "l_returnflag", v="l_quantity")


def color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, None, r="l_quantity", g="round(l_discount * 100)", b="round(l_tax * 100)")


def embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster with a row per vector: values outside 0 to 255, with a nominal range of -1 to 1."""
    vectors = table(spark, sf_dir, "embeddings")
    height = vectors.agg(F.max("vec_id") + 1).first()[0] or 0
    rows = vectors.select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "e"))
    return rows.select(F.lit("E").alias("image_id"), F.lit(64).alias("width"), F.lit(int(height)).alias("height"), F.lit(-1.0).alias("lo"), F.lit(1.0).alias("hi"), "y", F.col("x").cast("int").alias("x"), F.col("e").cast("double").alias("v"))


def _cells_sql(by: str, sums: dict[str, str]) -> str:
    agg = ", ".join(f"sum({e}) AS {n}" for n, e in sums.items())
    peak = ", ".join(f"max({n}) AS max_{n}" for n in sums)
    out = ", ".join(f"floor(coalesce(c.{n}, 0.0::DOUBLE) * 255.0::DOUBLE / p.max_{n}) AS {n}" for n in sums)
    return f"""cells AS (SELECT {by} AS image_id, (l_orderkey * 31 + l_linenumber * 17) % {WIDTH * HEIGHT} AS k, {agg} FROM lineitem GROUP BY 1, 2),
peaks AS (SELECT image_id, {peak} FROM cells GROUP BY 1),
px AS (SELECT p.image_id, CAST(g.k // {WIDTH} AS INTEGER) AS y, CAST(g.k % {WIDTH} AS INTEGER) AS x, {out}
  FROM peaks p CROSS JOIN (SELECT range AS k FROM range({WIDTH * HEIGHT})) g LEFT JOIN cells c ON c.image_id = p.image_id AND c.k = g.k)"""


GRAY_SQL = _cells_sql("'R'", {"v": "l_quantity"})
BATCH_SQL = _cells_sql("l_returnflag", {"v": "l_quantity"})
COLOR_SQL = _cells_sql("'R'", {"r": "l_quantity", "g": "round(l_discount * 100)", "b": "round(l_tax * 100)"})
EMB_SQL = "px AS (SELECT 'E' AS image_id, CAST(vec_id AS INTEGER) AS y, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
