"""Column expressions over dense vectors (arrays of numbers).

Elements are widened to double before arithmetic. "l2sq" is the squared Euclidean distance, never rooted; "cosine" is
always the distance 1 - cosine. A null vector gives null; vectors of different lengths give null as well, since the
missing elements are null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Machine epsilon of single precision, by which norms of stored vectors are kept from zero.
EPSILON = 1.1920928955078125e-07


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def l2sq(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2sq_int(a: Column, b: Column) -> Column:
    """Squared distance of integer vectors, in integers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long"))), F.lit(0).cast("long"), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_norm(v: Column) -> Column:
    return _sum(F.transform(v, lambda x: x.cast("double") * x.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def cosine_similarity(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a vector is zero."""
    return 1 - F.coalesce(cosine_similarity(a, b), F.when(F.size(a) == F.size(b), F.lit(0.0)))


def inner_product_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


METRICS: dict[str, Callable[[Column, Column], Column]] = {"l2": l2sq, "cosine": cosine_distance, "inner_product": inner_product_distance}


def distance(metric: str) -> Callable[[Column, Column], Column]:
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}; there are {', '.join(METRICS)}")
    return METRICS[metric]


def normalize(v: Column) -> Column:
    """Divided by the root of epsilon plus the squared norm, so that a zero vector stays zero."""
    length = F.sqrt(F.lit(EPSILON) + squared_norm(v))
    return F.get(F.transform(F.array(F.struct(v.alias("v"), length.alias("n"))), lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"])), F.lit(0))


def cast_elements(v: Column, to: str) -> Column:
    """Element type ``to``: float, double, int, or the C-like int8 and uint8, which drop the fraction and wrap around."""
    if to == "int8":
        return F.transform(v, lambda x: (F.pmod(x.cast("long") + 128, F.lit(256)) - 128).cast("tinyint"))
    if to == "uint8":
        return F.transform(v, lambda x: F.pmod(x.cast("long"), F.lit(256)).cast("smallint"))
    return F.transform(v, lambda x: x.cast(to))


def quantize_int8(v: Column, bias: float, scale: float) -> Column:
    """(x - bias) * (256 / scale), truncated and saturated to -128..127."""
    step = 256.0 / scale
    return F.transform(v, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), ((x.cast("double") - F.lit(float(bias))) * F.lit(step)).cast("int"))).cast("tinyint"))


def pad(v: Column, multiple: int = 8) -> Column:
    """Filled with zeros to a multiple of ``multiple`` elements."""
    return F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), F.pmod(-F.size(v), F.lit(multiple)).cast("int")))


def unpad(v: Column, dim: int) -> Column:
    return F.slice(v, 1, dim)
