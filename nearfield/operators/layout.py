"""Page layouts: which rows lie together, as tables, and the conversions between their forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SECTOR = 4096
#: Filler of a page that isn't full.
INVALID = 4294967295


def rows_per_page(dim: int, degree: int, element_bytes: int = 4) -> int:
    """Rows of vector, count and neighbours that fit a page; one where a row is longer than a page."""
    return max(1, SECTOR // ((degree + 1) * 4 + dim * element_bytes))


def page_layout(ids: DataFrame, per_page: int) -> DataFrame:
    """(id, page, slot): consecutive ids share a page."""
    return ids.select("id", F.floor(F.col("id") / per_page).cast("long").alias("page"), F.pmod("id", F.lit(per_page)).cast("long").alias("slot"))


def create_layout(vectors: DataFrame, graph: DataFrame, per_page: int, degree: int, layout: DataFrame | None = None) -> DataFrame:
    """(page, slot, id, vec, nbrs): vectors with their neighbours, cut to ``degree``, in order of pages.

    A node without neighbours raises when it is read, since a search can't leave it. ``layout`` (id, page, slot) takes
    the place of consecutive ids.
    """
    joined = vectors.select("id", "vec").join(graph.select("id", "nbrs"), "id")
    checked = joined.withColumn("nbrs", F.when(F.size("nbrs") > 0, F.slice("nbrs", 1, degree)).otherwise(F.raise_error(F.concat(F.lit("no neighbours: "), F.col("id").cast("string"))).cast("array<bigint>")))
    placed = checked.join(layout, "id") if layout is not None else checked.join(page_layout(vectors, per_page), "id")
    return placed.select("page", "slot", "id", "vec", "nbrs").repartitionByRange("page").sortWithinPartitions("page", "slot")


def expand_pages(layout: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page, id) of all rows that share a page with a wanted id; each page is read once."""
    pages = layout.join(wanted.select("id").distinct(), "id", "left_semi").select("page").distinct()
    return layout.join(pages, "page", "left_semi").select("page", "id")


def pad_pages(layout: DataFrame, capacity: int) -> DataFrame:
    """(page, ids): every page with ``capacity`` entries in order of slots, filled with INVALID."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("slot", "id"))), lambda s: s["id"])
    full = layout.groupBy("page").agg(ids.alias("ids"))
    return full.select("page", F.concat("ids", F.array_repeat(F.lit(INVALID).cast("long"), F.greatest(F.lit(0), capacity - F.size("ids")))).alias("ids"))


def tags_to_pages(tags: DataFrame, capacity: int) -> DataFrame:
    """(page, slot, id): a list of location and id cut into pages of ``capacity`` by location."""
    return tags.select(F.floor(F.col("loc") / capacity).cast("long").alias("page"), F.pmod("loc", F.lit(capacity)).cast("long").alias("slot"), F.col("tag").alias("id"))


def fill_holes(tags: DataFrame, heads: DataFrame, hole: int = 2147483647) -> DataFrame:
    """(loc, tag): the k-th location that holds ``hole`` gets the k-th head id in order. Heads are few: one a cluster."""
    holes = tags.filter(F.col("tag") == hole).select("loc", F.row_number().over(Window.orderBy("loc")).alias("_k"))
    ranked = heads.select(F.col("id").alias("_head"), F.row_number().over(Window.orderBy("id")).alias("_k"))
    found = holes.join(ranked, "_k").select("loc", "_head")
    return tags.join(found, "loc", "left").select("loc", F.coalesce("_head", "tag").alias("tag"))


def identity_tags(ids: DataFrame) -> DataFrame:
    return ids.select("id", F.col("id").alias("tag"))
