"""Bounded samples of labelled rows, for the operators that learn a model on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts longer than this aren't taken into a sample, so that a sample's bytes are bounded as well as its rows.
MAX_SAMPLE_BYTES = 65536


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


def sample_labelled(documents: DataFrame, labelled: DataFrame, label: str, per_label: dict | int) -> list[tuple]:
    """(text, label) rows for training: about ``per_label`` for each label value, by a hash of the id.

    ``labelled`` has doc_id and the label column, without the rows that must stay unseen. At most 1.25 times
    ``per_label`` ids of each value are drawn; they are the only data that is broadcast. Null texts are left out. An id
    that has two labels teaches nothing; each text of an id that comes more than once in ``documents`` gets its label,
    up to twice as many texts as ids in all.
    """
    known = labelled.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias(label), F.max(label).alias("_other"))
    known = known.filter(F.col(label) == F.col("_other")).select("doc_id", label)
    counts = known.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    want = F.lit(per_label)
    if isinstance(per_label, dict):
        want = F.lit(0)
        for value, n in per_label.items():
            want = F.when(F.col(label) == F.lit(value), n).otherwise(want)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    drawn = known.join(counts, label).withColumn("_want", want).filter(place < F.col("_want") / F.col("_n") * (1 << 30)).select("doc_id", label, "_want", place.alias("_place")).cache()
    most = int(1.25 * (drawn.select(label, "_want").distinct().agg(F.sum("_want")).first()[0] or 0)) + 1
    ids = drawn.orderBy("_place", "doc_id").limit(most).select("doc_id", label)
    texts = documents.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.octet_length("text") <= MAX_SAMPLE_BYTES))
    rows = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", label).orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(2 * most).collect()
    drawn.unpersist()
    return [(r[1], r[2]) for r in sorted(rows, key=lambda r: (r[0], r[1]))]
