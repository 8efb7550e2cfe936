"""Column expressions of the point operations and colour spaces, and the small matrices they need."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import clamp

#: Luma weights and stain vectors (optical density of red, green, blue).
LUMA = (0.299, 0.587, 0.114)
HEMATOXYLIN, EOSIN, DAB = (0.650, 0.704, 0.286), (0.072, 0.990, 0.105), (0.268, 0.570, 0.776)
MAX_DENSITY = 3.0
STAINS = {"hematoxylin_he": (HEMATOXYLIN, EOSIN, 0), "eosin_he": (HEMATOXYLIN, EOSIN, 1), "hematoxylin_hdab": (HEMATOXYLIN, DAB, 0), "dab": (HEMATOXYLIN, DAB, 1)}
STAIN_ORDER = tuple(STAINS)


def unit(v: tuple[float, ...]) -> tuple[float, ...]:
    n = math.sqrt(sum(x * x for x in v))
    return tuple(x / n for x in v)


def stain_matrix(a: tuple[float, ...], b: tuple[float, ...]) -> list[tuple[float, ...]]:
    """Unit rows: both stains and the direction at right angles to them."""
    u, v = unit(a), unit(b)
    w = unit(tuple(u[(k + 1) % 3] * v[(k + 2) % 3] - u[(k + 2) % 3] * v[(k + 1) % 3] for k in range(3)))
    return [u, v, w]


def inverse(m: list[tuple[float, ...]]) -> list[list[float]]:
    """Inverse of a 3 x 3 matrix by cofactors; ValueError if the rows are too much alike."""
    minor = lambda r, c: m[(r + 1) % 3][(c + 1) % 3] * m[(r + 2) % 3][(c + 2) % 3] - m[(r + 1) % 3][(c + 2) % 3] * m[(r + 2) % 3][(c + 1) % 3]
    det = sum(m[0][c] * minor(0, c) for c in range(3))
    if abs(det) < 1e-12:
        raise ValueError("the stain vectors are too similar")
    return [[minor(c, r) / det for c in range(3)] for r in range(3)]


def stain_weights(stain: str) -> tuple[float, float, float]:
    """What red, green and blue densities add to the amount of a stain."""
    a, b, k = STAINS[stain]
    inv = inverse(stain_matrix(a, b))
    return inv[0][k], inv[1][k], inv[2][k]


def stain_color(stain: str, amount: float = 1.0) -> tuple[int, int, int]:
    a, b, k = STAINS[stain]
    return tuple(int(min(255, max(0, round(255 * 10 ** (-c * amount))))) for c in unit((a, b)[k]))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Luma in 32-bit arithmetic."""
    w = [F.lit(x).cast("float") for x in LUMA]
    r, g, b = (c.cast("float") for c in (r, g, b))
    return (w[0] * r + w[1] * g + w[2] * b).cast("double")


def density(v: Column, lo: Column, hi: Column) -> Column:
    """Optical density; 8-bit images use whole levels."""
    eight = -F.log10(F.greatest(clamp(F.rint(v), F.lit(0.0), F.lit(255.0)), F.lit(1.0)) / 255.0)
    return F.when((lo == 0) & (hi == 255), eight).otherwise(-F.log10(F.greatest(v, F.lit(1.0)) / hi))


def with_hsv(pixels: DataFrame) -> DataFrame:
    """pixels with _h in degrees, _s and _v of 0 to 1; a gray pixel has hue 0. In stages, so that no expression repeats."""
    unit_of = lambda c: clamp((F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0), F.lit(1.0))
    d = pixels.withColumns({f"_{c}": unit_of(c) for c in "rgb"})
    d = d.withColumns({"_v": F.greatest("_r", "_g", "_b"), "_d": F.greatest("_r", "_g", "_b") - F.least("_r", "_g", "_b")})
    part = lambda a, c: F.try_divide(F.col(a) - F.col(c), F.col("_d"))
    sector = F.when(F.col("_v") == F.col("_r"), part("_g", "_b") % 6).when(F.col("_v") == F.col("_g"), part("_b", "_r") + 2).otherwise(part("_r", "_g") + 4)
    d = d.withColumn("_h", F.when(F.col("_d") <= 1e-9, F.lit(0.0)).otherwise(60 * sector))
    d = d.withColumns({"_h": F.when(F.col("_h") < 0, F.col("_h") + 360).otherwise(F.col("_h")), "_s": F.coalesce(F.try_divide("_d", "_v"), F.lit(0.0))})
    return d.drop("_r", "_g", "_b", "_d")


#: A Mersenne prime: products of two states stay below 2^62.
NOISE_PRIME = 2147483647


def noise_state(seed, what, y, x):
    """A number below NOISE_PRIME from seed, kind of draw and position; columns, arrays and numbers alike, in exact integers."""
    state = (seed * 7919 + what * 104729 + y * 15485863 + x * 32452843 + 1) % NOISE_PRIME
    for add in (12345, 67891, 23457):
        state = ((state * state % NOISE_PRIME) * 48271 + state * 69621 + add) % NOISE_PRIME
    return state
