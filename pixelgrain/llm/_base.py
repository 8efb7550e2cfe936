"""Session helpers shared by the corpus operators.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which every executor can read, so a lost
executor never loses them; nothing is kept in block storage of one executor or in a machine-local temporary folder.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that go to a Python worker at once; a longer row goes alone.
BATCH_BYTES = 4 << 20
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is configured a temporary one is set in local mode, and only there."""
    folder = spark.conf.get(_KEY, None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_KEY} to a folder that all executors can read")
        folder = "file://" + tempfile.mkdtemp(prefix="corpus-shared-")
        spark.conf.set(_KEY, folder)
    return folder.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches in bytes: what a worker and its task hold must not depend on the length of texts."""
    now = spark.conf.get(_BATCH_KEY)
    size = int(now) if now.lstrip("-").isdigit() else 0
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives executor loss."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    collect_garbage(spark)
    return out


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver drop shuffle files of finished jobs now instead of at its next memory shortage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame | None) -> None:
    """Delete the shared files behind a materialized table that no later step reads."""
    if df is None:
        return
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        for entry in list(_made):
            if folder.endswith(entry[1].rsplit("/", 1)[1]):
                _delete(*entry)
                _made.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean_up() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str | Column) -> Column:
    """UTF-8 bytes of a text column, null as empty: Arrow kernels get raw buffers and nothing is decoded twice."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("binary"), F.lit(b""))


def id_bitmap(ids: DataFrame, column: str, bits: int = 1 << 23) -> DataFrame:
    """Words of a bitmap over hashed ids: at most bits/64 rows however many ids there are, so it may be broadcast."""
    h = F.pmod(F.xxhash64(F.col(column)), F.lit(bits))
    return (
        ids.select(F.floor(h / 64).cast("int").alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), {bits}) % 64 as int))").alias("_bit"))
        .groupBy("_word")
        .agg(F.bit_or("_bit").alias("_bits"))
    )


def prefilter(df: DataFrame, column: str, ids: DataFrame, id_column: str, bits: int = 1 << 23) -> DataFrame:
    """Drop most rows of df whose id is not among ids before a shuffle join; rows may be let through, never lost."""
    words = F.broadcast(id_bitmap(ids, id_column, bits))
    h = F.pmod(F.xxhash64(F.col(column)), F.lit(bits))
    tagged = df.withColumn("_h", h)
    joined = tagged.join(words, F.floor(F.col("_h") / 64).cast("int") == F.col("_word"), "inner")
    return joined.where(F.expr("(shiftrightunsigned(_bits, cast(_h % 64 as int)) & 1L) = 1L")).drop("_h", "_word", "_bits")


def without_rows(docs: DataFrame, dropped: DataFrame, keys: list[Column], bits: int = 1 << 26) -> DataFrame:
    """Rows of docs whose keys are not among the rows of dropped (same number of columns, in order), columns as they were.

    Rows that a bitmap of fixed size over hashed keys clears stay where they are; only the others are compared, null
    equal to null, in a shuffle. No column of docs can clash with those that are used on the way.
    """
    names = [f"_key_{k}_{uuid.uuid4().hex[:8]}" for k in range(len(keys))]
    word, mask, slot = (f"_{n}_{uuid.uuid4().hex[:8]}" for n in ("word", "mask", "slot"))
    gone = materialize(dropped.toDF(*names).distinct(), "dropped")
    place = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(bits))
    words = gone.select(place(names).alias(slot)).select((F.col(slot) / 64).cast("int").alias(word), F.expr(f"shiftleft(1L, cast({slot} % 64 as int))").alias(mask)).groupBy(word).agg(F.bit_or(mask).alias(mask))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    wide = docs.withColumn(slot, place(keys)).join(F.broadcast(words), (F.col(slot) / 64).cast("int") == F.col(word), "left")
    hit = F.coalesce(F.expr(f"(shiftrightunsigned({mask}, cast({slot} % 64 as int)) & 1L) = 1L"), F.lit(False))
    clear = wide.where(~hit).select(*columns)
    same = reduce(lambda a, b: a & b, (k.eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)))
    rest = wide.where(hit).select(*columns).join(gone, same, "left_anti")
    return clear.unionAll(rest)
