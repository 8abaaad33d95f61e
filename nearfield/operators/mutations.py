"""Inserts, deletes and consolidation of a graph index, on immutable tables: each gives the new tables.

Deleted rows are a table of ids: searches pass through them without returning them, until ``consolidate`` takes them
out of the neighbour lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .graphs import edge_list, prune_groups, search_graph
from .knn import top_k


def lazy_delete(tags: DataFrame, deleted: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tags left, deleted ids, tags that don't exist) after deleting the tags in ``wanted`` (tag)."""
    wanted = wanted.select("tag").distinct()
    gone = tags.join(wanted, "tag", "left_semi")
    left = tags.join(wanted, "tag", "left_anti")
    failed = wanted.join(tags.select("tag"), "tag", "left_anti")
    return left, deleted.select("id").union(gone.select("id")).distinct(), failed


EMPTY = "cast(array() as array<bigint>)"


def expand_candidates(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """(src, dst) for live nodes with a deleted neighbour: the live neighbours and the deleted ones' live neighbours.

    Where ``edges`` has a shard, each shard is a graph of its own and the result has it too.
    """
    own_shard = ["shard"] if "shard" in edges.columns else []
    edges = edges.select(*own_shard, "src", "dst")
    gone = deleted.select(F.col("id").alias("dead")).distinct()
    live_src = edges.join(gone, edges["src"] == gone["dead"], "left_anti")
    to_dead = live_src.join(gone, live_src["dst"] == gone["dead"]).select(*own_shard, "src", "dead")
    touched = to_dead.select(*own_shard, "src").distinct()
    second = edges.select(*own_shard, F.col("src").alias("dead"), "dst")
    through = to_dead.join(second, [*own_shard, "dead"]).select(*own_shard, "src", "dst")
    own = live_src.join(touched, [*own_shard, "src"], "left_semi").select(*own_shard, "src", "dst")
    both = own.union(through).filter("src <> dst").distinct()
    return both.join(gone, both["dst"] == gone["dead"], "left_anti")


def shard_edges(nodes: DataFrame) -> DataFrame:
    """(shard, src, dst) of nodes."""
    return nodes.select("shard", F.col("id").alias("src"), F.explode("nbrs").alias("dst"))


def prune_lists(lists: DataFrame, points: DataFrame, degree: int, alpha: float) -> DataFrame:
    """(shard, id, nbrs) from (shard, id, vec, cand), the candidates one a row, and ``points`` (cand, cvec)."""
    full = lists.join(points.select("cand", "cvec"), "cand")
    key = F.struct("shard", "id")
    named = full.select(F.xxhash64("shard", "id").alias("_key"), key.alias("_row"), "vec", "cand", "cvec")
    pruned = prune_groups(named.select(F.col("_key").alias("id"), "vec", "cand", "cvec"), degree, alpha, own=False)
    rows = named.select(F.col("_key").alias("id"), "_row.shard", F.col("_row.id").alias("_id")).distinct()
    return rows.join(pruned, "id").select("shard", F.col("_id").alias("id"), "nbrs")


def consolidate(nodes: DataFrame, deleted: DataFrame, degree: int, alpha: float = 1.2) -> DataFrame:
    """(shard, id, vec, nbrs) without the deleted rows; lists that held one are rebuilt from second neighbours and pruned."""
    gone = deleted.select("id").distinct()
    live = nodes.join(gone, "id", "left_anti").select("shard", "id", "vec", "nbrs")
    candidates = expand_candidates(shard_edges(nodes), deleted).select("shard", F.col("src").alias("id"), F.col("dst").alias("cand"))
    points = live.select(F.col("id").alias("cand"), F.col("vec").alias("cvec")).dropDuplicates(["cand"])
    rebuilt = prune_lists(candidates.join(live.select("shard", "id", "vec"), ["shard", "id"]), points, degree, alpha).withColumnRenamed("nbrs", "new")
    dead = gone.select(F.col("id").alias("dst"))
    emptied = shard_edges(live).join(dead, "dst", "left_semi").select("shard", F.col("src").alias("id")).distinct().withColumn("hit", F.lit(True))
    joined = live.join(rebuilt, ["shard", "id"], "left").join(emptied, ["shard", "id"], "left")
    return joined.select("shard", "id", "vec", F.when(F.col("hit"), F.coalesce("new", F.expr(EMPTY))).otherwise(F.col("nbrs")).alias("nbrs"))


def insert(nodes: DataFrame, new: DataFrame, degree: int, pool: int, alpha: float = 1.2, centers=None, probes: int = 2) -> DataFrame:
    """(shard, id, vec, nbrs) with the rows of ``new`` (id, vec); rows whose id is there already take its place.

    Each new row is searched for in the old graph and goes to the shard of the nearest row found. There it is linked to
    what pruning leaves of the rows found and of the other new rows near them, and linked back. A list that has over twice
    ``degree`` neighbours then is pruned with the vectors. What pruning would leave without any link to it stays linked:
    an old row as it was, and new rows in a tree below their nearest old row, ``degree`` to each.
    """
    old = nodes.join(new.select("id"), "id", "left_anti").select("shard", "id", "vec", "nbrs")
    fresh = new.select("id", F.col("vec").cast("array<float>").alias("vec"))
    asked = fresh.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    found = cut(search_graph(old, asked, pool, pool, centers=centers, probes=probes).select(F.col("qid").alias("id"), F.col("id").alias("cand"), "rank"))
    shards = old.select(F.col("id").alias("cand"), "shard")
    home = found.filter("rank = 1").join(shards, "cand").groupBy("id").agg(F.min("shard").alias("shard"))
    near = cut(found.join(home, "id").join(shards, ["cand", "shard"]).select("shard", "id", "cand", "rank"))
    # new rows meet through the old row both are nearest to, each with the next DEGREE ones in order
    nearest = near.filter("rank = 1").select("shard", F.col("cand").alias("at"), "id")
    order = Window.partitionBy("shard", "at").orderBy("id")
    placed = nearest.withColumn("_k", F.row_number().over(order))
    after = placed.select("shard", "at", F.col("_k").alias("_next"), F.col("id").alias("cand"))
    mates = placed.withColumn("_next", F.explode(F.sequence(F.col("_k") + 1, F.col("_k") + int(degree)))).join(after, ["shard", "at", "_next"]).select("shard", "id", "cand")
    both = near.select("shard", "id", "cand").unionByName(mates).unionByName(mates.select("shard", F.col("cand").alias("id"), F.col("id").alias("cand"))).distinct()
    points = cut(old.select(F.col("id").alias("cand"), F.col("vec").alias("cvec")).dropDuplicates(["cand"]).unionByName(fresh.select(F.col("id").alias("cand"), F.col("vec").alias("cvec"))))
    linked = cut(prune_lists(both.join(fresh, "id"), points, degree, alpha))
    added = fresh.join(home, "id", "left").join(linked.select("id", "nbrs"), "id", "left").select(F.coalesce("shard", F.lit(0)).cast("long").alias("shard"), "id", "vec", F.coalesce("nbrs", F.expr(EMPTY)).alias("nbrs"))
    back = shard_edges(linked).select("shard", F.col("dst").alias("id"), F.col("src").alias("more")).groupBy("shard", "id").agg(F.sort_array(F.collect_set("more")).alias("more"))
    joined = old.unionByName(added).join(back, ["shard", "id"], "left").withColumn("union", F.array_union("nbrs", F.coalesce("more", F.expr(EMPTY))))
    crowded = joined.filter(F.col("more").isNotNull() & (F.size("union") > int(2 * degree))).select("shard", "id", "vec", "union")
    pruned = prune_lists(crowded.select("shard", "id", "vec", F.explode("union").alias("cand")), points, degree, alpha).withColumnRenamed("nbrs", "kept")
    # rows that a pruned list held and that no list of the shard holds any more
    lists = cut(joined.join(pruned, ["shard", "id"], "left").select("shard", "id", "vec", F.coalesce("kept", "union").alias("nbrs"), F.when(F.col("kept").isNotNull(), F.col("union")).alias("before")))
    linked_to = lists.select("shard", F.explode("nbrs").alias("id")).distinct()
    cut_off = lists.select("shard", F.col("id").alias("at"), F.explode("before").alias("id")).join(linked_to, ["shard", "id"], "left_anti")
    # the first node that held it takes it back; of many at one node, in a tree below it
    first = cut_off.groupBy("shard", "id").agg(F.min("at").alias("home"))
    tree = first.withColumn("k", F.row_number().over(Window.partitionBy("shard", "home").orderBy("id")) - 1)
    parents = tree.select("shard", "home", F.col("k").alias("up"), F.col("id").alias("parent"))
    below = tree.withColumn("up", F.floor((F.col("k") - 1) / int(degree)).cast("int")).join(parents, ["shard", "home", "up"], "left").select("shard", F.coalesce("parent", "home").alias("at"), "id")
    again = below.groupBy("shard", F.col("at").alias("id")).agg(F.sort_array(F.collect_set("id")).alias("again"))
    whole = lists.select("shard", "id", "vec", "nbrs").join(again, ["shard", "id"], "left")
    return whole.select("shard", "id", "vec", F.when(F.col("again").isNull(), F.col("nbrs")).otherwise(F.array_union("nbrs", "again")).alias("nbrs"))


def eager_delete(nodes: DataFrame, wanted: DataFrame, degree: int, alpha: float = 1.2, mode: int = 1) -> DataFrame:
    """(shard, id, vec, nbrs) without the given ids and all edges to them, at once.

    Mode 1 takes the edges away and no more; a list may become short. Mode 2 links the neighbours before a deleted row to
    those after it, and prunes: ``consolidate``.
    """
    if mode not in (1, 2):
        raise ValueError(f"no mode {mode!r} of eager deletion")
    if mode == 2:
        return consolidate(nodes, wanted, degree, alpha)
    gone = wanted.select("id").distinct()
    live = nodes.join(gone, "id", "left_anti").select("shard", "id", "vec", "nbrs")
    left = shard_edges(live).join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").groupBy("shard", F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("left"))
    return live.join(left, ["shard", "id"], "left").select("shard", "id", "vec", F.coalesce("left", F.expr(EMPTY)).alias("nbrs"))


def visited_in_neighbours(edges: DataFrame, visited: DataFrame, wanted: DataFrame) -> DataFrame:
    """(src, dst): edges to a wanted row from rows that a search visited (id): the lists an eager deletion may mend."""
    to = edges.select("src", "dst").join(wanted.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    return to.join(visited.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select("src", "dst")


def frozen_point(nodes: DataFrame, id: int) -> DataFrame:
    """(shard, id, vec, nbrs, frozen): ``nodes`` and, in each shard, a copy of its medoid as an entry that no search returns.

    The copy has the id ``id`` less the shard's number, which must be free, and a link to the medoid besides its links.
    """
    from ..functions.vectors import l2sq

    mean = nodes.select("shard", F.posexplode("vec").alias("pos", "x")).groupBy("shard", "pos").agg(F.avg("x").alias("x")).groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("center"))
    scored = nodes.join(mean, "shard").withColumn("_d", l2sq(F.col("vec"), F.col("center")))
    first = scored.groupBy("shard").agg(F.min(F.struct("_d", "id", "vec", "nbrs")).alias("m"))
    copy = first.select("shard", (F.lit(int(id)) - F.col("shard")).cast("long").alias("id"), "m.vec", F.array_union("m.nbrs", F.array("m.id")).alias("nbrs"), F.lit(True).alias("frozen"))
    return nodes.select("shard", "id", "vec", "nbrs", F.lit(False).alias("frozen")).unionByName(copy)


def clear(nodes: DataFrame, tags: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of an index without a row."""
    return nodes.limit(0), tags.limit(0), deleted.limit(0)


def live_data(nodes: DataFrame, tags: DataFrame, deleted: DataFrame) -> DataFrame:
    """(id, tag, vec) of the live rows of a compacted index; raises where deleted rows are still there."""
    if not nodes.join(deleted.select("id"), "id", "left_semi").isEmpty():
        raise ValueError("the index holds deleted rows; consolidate it first")
    return nodes.select("id", "vec").dropDuplicates(["id"]).join(tags, "id").select("id", "tag", "vec")


def vector_of(nodes: DataFrame, tags: DataFrame, tag: int) -> list[float] | None:
    """The vector that owns a tag, or None."""
    row = tags.filter(F.col("tag") == tag).join(nodes.select("id", "vec"), "id").select("vec").first()
    return list(row[0]) if row else None


def active_tags(tags: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags whose row is live, tags whose row is deleted), each (tag)."""
    gone = deleted.select("id").distinct()
    return tags.join(gone, "id", "left_anti").select("tag"), tags.join(gone, "id", "left_semi").select("tag")


def compact_ids(live: DataFrame, range_rows: int = 1 << 16) -> DataFrame:
    """(id, new_id): live ids renumbered from zero in their order.

    Two-level: ids are sorted into even ranges, the ranges' counts are summed, and ids are numbered within a range, so that
    no task orders all of them, however far apart they are. The ids are held in the shared folder meanwhile.
    """
    ids = cut(live.select("id").distinct())
    parts = max(1, -(-ids.count() // range_rows))
    placed = cut(ids.repartitionByRange(parts, "id").withColumn("_cell", F.spark_partition_id()))
    counts = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_cell", F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = placed.withColumn("_k", F.row_number().over(Window.partitionBy("_cell").orderBy("id")))
    return within.join(before, "_cell").select("id", (F.col("_before") + F.col("_k") - 1).alias("new_id"))


def compact(nodes: DataFrame) -> DataFrame:
    """Nodes and edges with dense ids; edges to nodes that aren't there go."""
    names = compact_ids(nodes)
    edges = edge_list(nodes).join(names.select(F.col("id").alias("src"), F.col("new_id").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("new_id").alias("b")), "dst")
    nbrs = edges.groupBy(F.col("a").alias("id")).agg(F.sort_array(F.collect_list("b")).alias("nbrs"))
    moved = nodes.select("id", "vec").join(names, "id").select(F.col("new_id").alias("id"), "vec")
    return moved.join(nbrs, "id", "left").select("id", "vec", F.coalesce("nbrs", F.expr("cast(array() as array<bigint>)")).alias("nbrs"))


def upsert_latest(changes: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last change of each key: one row a key, found by a partial aggregate before the shuffle."""
    rest = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max(F.struct(*[o.alias(f"_o{k}") for k, o in enumerate(order)], *rest)).alias("_m"))
    return last.select(key, *[F.col(f"_m.{c}") for c in rest])


def churn(ids: DataFrame, cycles: int, delete_share: float, insert_share: float, id: str = "id") -> DataFrame:
    """(cycle, op, id): a repeatable workload of deletes of active ids and inserts of inactive ones, by hashes."""
    from .filters import spread

    out = None
    for c in range(cycles):
        h = spread(F.col(id), 7919 * (c + 1)) / float(1 << 32)
        part = ids.withColumn("cycle", F.lit(c)).withColumn("op", F.when(h < delete_share, "delete").when(h < delete_share + insert_share, "insert")).filter("op IS NOT NULL").select("cycle", "op", F.col(id).alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def live_results(results: DataFrame, tags: DataFrame, k: int) -> DataFrame:
    """(qid, rank, tag, dist): results whose id still owns a tag, ranked anew and cut to ``k``."""
    return top_k(results.select("qid", "id", "dist").join(tags, "id"), k).select("qid", "rank", "id", "tag", "dist")
