"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source has the same expected number of copies, its source's target over its source's size. The
expected copies are prefix-summed over the source's documents, one random offset is added, and a document is emitted
once for each integer boundary its share of the sum crosses. Since the documents are summed in order of size, every
range of sizes gets its share and the words taken come close to the target.

The prefix sum is two-level, so that no task holds a source: documents are cut into even ranges of the order (source,
size class, bucket, size, doc_id); the counts of the ranges, which are aggregates, are summed per source, and a
document's place within its range comes from a window over the range. Rows equal in every column that would fill ranges
are counted, and go on as one row.

Targets follow from one closed form: with water level L, a source of weight w and size s gets min(w * L, 3 * s), and
L is chosen so that the targets add up to all sizes.

Defined results: null texts have size 0; a null source is a source of its own and comes last; documents of size 0 take
0 words; null and repeated doc_ids are allowed, rows equal in (source, size, doc_id) are interchangeable; an empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import ranges
from .text import bucket, n_words

#: Weights of the sources, in order of code points, repeating.
WEIGHTS = (1, 2, 3)
#: No source is repeated more often than this.
MAX_COPIES = 3
#: Buckets that spread documents of one size class by their ids, and rows that a range of the order should hold.
BUCKETS = 32
RANGE_ROWS = 1 << 15
#: Bytes of the counts of ranges that are sent to all tasks; more go through a shuffle.
MAX_BROADCAST = 1 << 24
SEED = 17


def size_class(size: Column) -> Column:
    """A number that grows with ``size``: 16 classes for each power of two, one for each size below 32."""
    bits = F.length(F.bin(size))
    low = F.greatest(bits - 5, F.lit(0))
    return (bits * 32 + F.floor(size / F.pow(F.lit(2.0), low))).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """From (source, source_size), one row a source: adds weight and target.

    The windows without a key run over one row a source, which is an aggregate of the corpus.
    """
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), place + 1)
    fill = Window.orderBy((max_copies * F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    leveled = (
        sizes.withColumn("weight", weight)
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_left", F.col("_total") - max_copies * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        # the first source, in order of its cap over its weight, that the water doesn't fill
        .withColumn("_open", max_copies * F.col("source_size") * F.col("_rest") >= F.col("weight") * F.col("_left"))
        .withColumn("_level_left", F.first(F.when(F.col("_open"), F.col("_left")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("_level_rest", F.first(F.when(F.col("_open"), F.col("_rest")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    cap = (max_copies * F.col("source_size")).cast("double")
    level = (F.col("weight") * F.col("_level_left")).cast("double") / F.col("_level_rest").cast("double")
    return leveled.select("source", "source_size", "weight", F.least(cap, level).alias("target"))


def source_offset(source: Column, seed: int) -> Column:
    """The random offset of a source, in [0, 1): from a digest of the seed and its name, the same in every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


KEY = ["_source", "_class", "_bucket", "_size", "_known", "_id", "_hash"]


def add_key(documents: DataFrame) -> DataFrame:
    """``documents`` (doc_id, source, size, ...) with the key of the order in which they are summed."""
    return documents.withColumns(
        {
            "_source": F.xxhash64(F.col("source").isNull(), "source"),
            "_class": size_class(F.col("size")).cast("bigint"),
            "_bucket": bucket(F.col("doc_id"), BUCKETS).cast("bigint"),
            "_size": F.col("size"),
            "_known": F.col("doc_id").isNull().cast("bigint"),
            "_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0).cast("bigint")),
            "_hash": F.xxhash64(*documents.columns),
        }
    )


def _groups(documents: DataFrame, seed: int, weights: tuple[int, ...], max_copies: int, carry: tuple[str, ...], range_rows: int) -> DataFrame:
    """(doc_id, source, size, source_size, target, _last, _n, _each, _offset, carry): groups of equal rows, mostly of one.

    The rows of a group have the places from ``_last`` - ``_n`` + 1 to ``_last`` in their source.
    """
    sized = documents.select("doc_id", "source", n_words(F.col("text")).alias("size"), *carry)
    if not carry:
        sized = cut(sized)
    sample = (lambda df: add_key(df)) if not carry else (lambda df: add_key(df.select("doc_id", "source", n_words(F.col("text")).alias("size"), *carry)))
    placed, heavy = ranges.in_ranges(sized if not carry else documents, sample, KEY, range_rows)
    placed = placed.withColumn("_n", F.lit(1).cast("bigint"))
    if heavy is not None:
        plain = [*sized.columns, *KEY, "_range"]
        merged = placed.filter(heavy).groupBy("_range", "_hash").agg(F.first(F.struct(*[c for c in plain if c not in ("_range", "_hash")])).alias("_row"), F.count(F.lit(1)).alias("_n"))
        merged = merged.select("_range", "_hash", "_row.*", "_n")
        placed = placed.filter(~heavy).unionByName(merged)
    cells = placed.groupBy("source", "_range").agg(F.sum("_n").alias("_rows"), F.sum(F.col("size") * F.col("_n")).alias("_words"))
    if carry:
        cells = cut(cells)
    before = cells.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    targets = source_targets(cells.groupBy("source").agg(F.sum("_words").cast("bigint").alias("source_size")), weights, max_copies)
    t = targets.select(F.col("source").alias("_name"), "source_size", "target")
    known = before.join(t, before["source"].eqNullSafe(t["_name"])).select(F.col("source").alias("_name"), F.col("_range").alias("_cell"), "_before", "source_size", "target")
    if carry:
        # held and of a known size before the join, which would else shuffle the texts again where it is planned too early
        known = cut(known)
        held = known.agg(F.sum(F.coalesce(F.octet_length("_name"), F.lit(0)) + 64)).collect()[0][0] or 0
        known = F.broadcast(known) if held <= MAX_BROADCAST else known
    within = Window.partitionBy("source", "_range").orderBy(*KEY[1:]).rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("_upto", F.sum("_n").over(within))
    same = ranked["source"].eqNullSafe(known["_name"]) & (ranked["_range"] == known["_cell"])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return ranked.join(known, same).select("doc_id", "source", "size", "source_size", "target", (F.col("_before") + F.col("_upto")).alias("_last"), "_n", each.alias("_each"), source_offset(F.col("source"), seed).alias("_offset"), *carry)


def plan_copies(documents: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row.

    The sizes are counted once and held in the shared folder.
    """
    rows = _groups(documents, seed, weights, max_copies, (), range_rows)
    place = F.explode(F.sequence(F.col("_last") - F.col("_n") + 1, F.col("_last"))).alias("_place")
    crossed = F.floor(F.col("_each") * F.col("_place") + F.col("_offset")) - F.floor(F.col("_each") * (F.col("_place") - 1) + F.col("_offset"))
    return rows.select("*", place).select("doc_id", "source", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def mix(documents: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of the mix: each row of ``documents`` as often as its copies say, with the columns of ``documents``.

    The texts are read twice rather than held, and go through one shuffle, that of the ranges.
    """
    names = documents.columns
    own = {c: f"_own{i}" for i, c in enumerate(names) if c not in ("doc_id", "source")}
    held = documents.select("doc_id", "source", "text", *[F.col(c).alias(a) for c, a in own.items()])
    rows = _groups(held, seed, weights, max_copies, tuple(own.values()), range_rows)
    copies = F.floor(F.col("_each") * F.col("_last") + F.col("_offset")) - F.floor(F.col("_each") * (F.col("_last") - F.col("_n")) + F.col("_offset"))
    out = [F.col(own.get(c, c)).alias(c) for c in names]
    emitted = rows.withColumn("_copies", copies.cast("bigint")).filter("_copies > 0")
    return emitted.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).select(*out)


COLUMNS = ["doc_id", "size", "source_size", "target", "taken", "copies"]

#: The same in DuckDB.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
c AS (
  SELECT *, length(CASE WHEN size = 0 THEN '0' ELSE bin(size) END) AS bits,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 7) AS BIGINT) % 32 AS bucket FROM d),
e AS (SELECT *, bits * 32 + CAST(floor(size / pow(2.0, greatest(bits - 5, 0))) AS BIGINT) AS class FROM c),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM e GROUP BY source),
w AS (SELECT *, CAST([1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight FROM s),
f AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0) AS BIGINT) AS left_size,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS rest, 3 * source_size / weight AS fill
  FROM w WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT left_size, rest FROM f WHERE 3 * source_size * rest >= weight * left_size ORDER BY fill, source NULLS LAST LIMIT 1),
t AS (SELECT f.source, source_size, least(CAST(3 * source_size AS DOUBLE), CAST(weight * l.left_size AS DOUBLE) / CAST(l.rest AS DOUBLE)) AS target FROM f, l),
p AS (
  SELECT e.*, source_size, target, row_number() OVER (PARTITION BY e.source ORDER BY class, bucket, size, doc_id NULLS LAST) AS place,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS each,
         CAST('0x' || substr(md5('17:' || coalesce('=' || e.source, '')), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST(floor(each * place + u) - floor(each * (place - 1) + u) AS BIGINT) AS copies FROM p)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM k
"""


def offset_of(source: str | None, seed: int = SEED) -> float:
    """source_offset in Python, for tests."""
    text = f"{seed}:" + ("" if source is None else "=" + source)
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32
