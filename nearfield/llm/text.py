"""Column expressions over texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than space and the controls 9 to 13.
GAP = r"[ \t-\r]+"


def let(value: Column, body) -> Column:
    """``body`` of ``value`` as a lambda variable: the value is computed once, however often ``body`` names it.

    An outer expression inside a lambda is computed anew for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty for null and for texts without a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words of ``text`` as a long, without building lambda calls per word."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " "))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, " "))).cast("long")


def bucket(key: Column, n: int) -> Column:
    """A spread-out bucket number below ``n`` that DuckDB can compute as well: from the first 28 bits of an MD5."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") % n).cast("int")
