"""Extension: a recipe over the images that arrive in a folder, as a stream; each file is processed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import engine
from ..plans.recipe import Recipe

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, recipe: Recipe) -> DataFrame:
    """Streaming summaries of the files of a folder."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.*").load(folder)
    return engine.summaries(files, recipe)


def start(spark: SparkSession, folder: str, recipe: Recipe, out: str, checkpoint: str) -> StreamingQuery:
    """Append summaries to Parquet under out until stopped."""
    return watch(spark, folder, recipe).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(out)
