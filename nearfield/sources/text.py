"""Vectors as text: whitespace- or tab-separated rows, and tab-separated records whose vector is a comma list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_tsv(lines: DataFrame, dim: int | None = None) -> DataFrame:
    """``lines`` (id, value) as (id, vec); rows that haven't ``dim`` numbers raise."""
    parts = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    return lines.select("id", _checked(F.transform(parts, lambda x: x.cast("float")), dim).alias("vec"))


def format_tsv(vectors: DataFrame, separator: str = "\t") -> DataFrame:
    """(id, value): the elements of each vector as text."""
    return vectors.select("id", F.array_join(F.transform("vec", lambda x: x.cast("string")), separator).alias("value"))


def parse_records(lines: DataFrame, dim: int | None = None) -> DataFrame:
    """``id [TAB meta] TAB v,v,...`` as (key, meta, vec): the vector is the last of three, two or one fields."""
    f = F.split("value", "\t")
    n = F.size(f)
    numbers = F.transform(F.split(F.get(f, F.least(n, F.lit(3)) - 1), ","), lambda x: F.trim(x).cast("float"))
    return lines.select(
        F.when(n >= 2, F.get(f, F.lit(0))).alias("key"), F.when(n >= 3, F.get(f, F.lit(1))).alias("meta"), _checked(numbers, dim).alias("vec")
    )


def _checked(vec: Column, dim: int | None) -> Column:
    if dim is None:
        return vec
    return F.when(F.size(vec) == dim, vec).otherwise(F.raise_error(F.concat(F.lit(f"a row without {dim} numbers: "), F.size(vec).cast("string"))).cast("array<float>"))
