"""Image folders: a binary file scan whose rows are decoded where they are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import IMAGE_SCHEMA
from ..operators.measure import Calibration
from ..plans.arrays import Raster
from . import codecs

#: Extensions that count as images; files without one are looked at for DICOM.
EXTENSIONS = ("png", "tif", "tiff", "dcm", "dicom", "jpg", "jpeg", "bmp", "gif")
LOADED = f"{IMAGE_SCHEMA}, units_per_pixel double, unit string, error string"


def find_images(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, length, content) of the image files of a folder, in no order; no file is moved or opened to be passed over.

    Files without an extension are opened to look for DICOM, only where there are any.
    """
    from ..plans.engine import bound_batches

    bound_batches(spark)
    glob = ",".join("*." + "".join(f"[{c}{c.upper()}]" for c in e) for e in EXTENSIONS)
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    named = scan.option("pathGlobFilter", f"{{{glob}}}").load(folder).select("path", "length", "content")
    bare = scan.option("pathGlobFilter", "*").load(folder).where(~F.element_at(F.split("path", "/"), -1).contains("."))
    if bare.select("path").isEmpty():
        return named
    return named.unionByName(bare.where(F.substring("content", 129, 4) == b"DICM").select("path", "length", "content"))


def read_image(path: str, content: bytes) -> tuple[Raster, Calibration | None]:
    """The decoded file; a ValueError has the reason where that is not possible."""
    found = codecs.decode(content, path)
    if found is None:
        raise ValueError("the format is not supported")
    return found


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in LOADED.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            w = h = ch = lo = hi = units = unit = error = None
            flat = np.zeros(0, np.float32)
            try:
                image, calibration = read_image(path, content.as_py())
                (w, h), ch, lo, hi, flat = image.size, image.data.shape[2], image.lo, image.hi, image.data.ravel()
                units, unit = (calibration.units_per_pixel, calibration.unit) if calibration else (None, None)
            except ValueError as e:
                error = str(e)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float32(), pa.float32())
            head = [pa.array([v], t) for v, t in zip((path, w, h, ch, lo, hi), kinds, strict=True)]
            data = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*head, data, pa.array([units], pa.float64()), pa.array([unit], pa.string()), pa.array([error], pa.string())], names)


def load_images(files: DataFrame) -> DataFrame:
    """Images table of (path, content) rows; a file that can't be read is a row with its reason in error.

    Recipes take (path, content) rows as they are, which moves the coded bytes only; this is for working with samples.
    """
    return files.select("path", "content").mapInArrow(_decode, LOADED)
