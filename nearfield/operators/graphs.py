"""Proximity graphs: exact neighbour graphs, robust pruning, incremental building, and the ways to search them.

The numpy part works on one shard in memory; shards are made so that one fits a worker. A search takes a pool of at most
``L`` candidates per query, expands the best ones, and ranks by exact distance what it has read; the modes differ in
what is expanded when: ``beam`` up to ``width`` nodes a round, ``page`` also all rows that share a page with them,
``pipe`` one more for each that is done, by a policy of widths, ``batch`` as beam, all queries of a shard in step with
one matrix operation a round, ``fast`` from a single start, without a list of what was read. With a pool as large as the
shard each finds the exact neighbours: every part of the graph that can't be reached from the medoid has an entry node.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship
from .knn import knn_all, matrix, nearest, routed, top_k

SLACK = 1.3
ALPHA_STEP = 1.2


# DataFrames of edges


def knn_graph(vectors: DataFrame, k: int) -> DataFrame:
    """(src, dst, rank, dist): the ``k`` exact nearest other rows of every row, found on the executors.

    The edges are held in the shared folder, as what works on a graph reads them more than once.
    """
    return cut(knn_all(vectors, k).select(F.col("qid").alias("src"), F.col("id").alias("dst"), "rank", "dist"))


def shard_graph(shards: DataFrame, k: int) -> DataFrame:
    """(shard, src, dst, rank, dist): the ``k`` exact nearest other rows in the same shard, of (shard, id, vec)."""
    rows = shards.select(F.col("shard").cast("long").alias("cell"), "id", "vec")
    found = routed(rows, rows.select("cell", F.col("id").alias("qid"), F.col("vec").alias("qvec")), k + 1).filter("qid <> id")
    w = Window.partitionBy("cell", "qid").orderBy("dist", "id")
    ranked = found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return ranked.select(F.col("cell").alias("shard"), F.col("qid").alias("src"), F.col("id").alias("dst"), "rank", "dist")


def reverse_edges(edges: DataFrame) -> DataFrame:
    """Edges and their reverses, each once."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, nbrs) from bounded-degree edges."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("nbrs"))


def edge_list(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("id").alias("src"), F.explode("nbrs").alias("dst"))


def merge_shards(edges: DataFrame, degree: int, ordered: bool = True) -> DataFrame:
    """(id, nbrs) of all shards' edges (src, dst[, dist]): united, each neighbour once, cut to ``degree``.

    ``ordered`` keeps the nearest ones by (dist, dst); otherwise a hash of the edge decides, as a repeatable shuffle.
    """
    order = F.struct("dist", "dst") if ordered else F.struct(F.xxhash64("src", "dst").alias("dist"), "dst")
    once = edges.filter("src <> dst").groupBy("src", "dst").agg(F.min("dist").alias("dist")) if ordered else edges.filter("src <> dst").select("src", "dst").distinct()
    return once.groupBy(F.col("src").alias("id")).agg(F.transform(F.slice(F.array_sort(F.collect_list(order)), 1, degree), lambda s: s["dst"]).alias("nbrs"))


# one shard in memory


def robust_prune(dist: np.ndarray, among: np.ndarray, degree: int, alpha: float, most: int = 750) -> list[int]:
    """Places of the candidates that stay, of candidates in order of ``dist``; ``among`` are distances between them.

    Candidate j shades candidate i by dist[i] / among[j, i]. For a factor that rises from 1 to alpha in steps, the first
    candidate in order that no taken one before it shades by more than the factor is taken, until ``degree`` are.
    """
    n = min(len(dist), most)
    with np.errstate(divide="ignore", invalid="ignore"):
        shade = np.where(among[:n, :n] > 0, dist[None, :n] / among[:n, :n], np.inf)
    shade[np.tril_indices(n)] = 0  # only what comes before shades
    deepest, out = np.zeros(n), []
    free = np.ones(n, bool)
    factor = 1.0
    while factor <= alpha + 1e-9:
        at = 0
        while len(out) < degree:
            open_to = np.flatnonzero(free[at:] & (deepest[at:] <= factor))
            if not len(open_to):
                break
            at += int(open_to[0])
            out.append(at)
            free[at] = False
            deepest = np.maximum(deepest, shade[at])
        factor *= ALPHA_STEP
    return out


def _l2(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    d = rows - q
    return np.einsum("ij,ij->i", d, d)


@dataclass
class Stats:
    hops: int = 0
    reads: int = 0
    comparisons: int = 0


@dataclass
class Shard:
    """Vectors, adjacency and, where given, PQ codes and pages of one shard."""

    ids: np.ndarray
    vecs: np.ndarray
    nbrs: list[np.ndarray]
    entries: list[int] = field(default_factory=list)
    codes: np.ndarray | None = None
    pages: np.ndarray | None = None

    def __post_init__(self):
        if not self.entries and len(self.ids):
            self.entries = [medoid_of(self.vecs, self.ids)]

    def table(self) -> np.ndarray:
        """The neighbour lists as a matrix, filled with -1."""
        out = np.full((len(self.nbrs), max(1, max(map(len, self.nbrs), default=1))), -1, np.int64)
        for k, x in enumerate(self.nbrs):
            out[k, : len(x)] = x
        return out

    def cover(self) -> None:
        """Add the lowest node of each part of the graph that no entry leads to, as an entry."""
        links = self.table()
        seen = np.zeros(len(self.ids), bool)
        front = np.array(self.entries, np.int64)
        while True:
            while len(front):
                seen[front] = True
                out = np.unique(links[front])
                out = out[out >= 0]
                front = out[~seen[out]]
            rest = np.flatnonzero(~seen)
            if not len(rest):
                return
            self.entries.append(int(rest[0]))
            front = rest[:1]


    def closure(self, starts: list[int], by_page: bool = False) -> np.ndarray:
        """Places that ``starts`` lead to over links, and over shared pages where ``by_page`` is set."""
        links = self.table()
        page = np.unique(self.pages, return_inverse=True)[1] if by_page and self.pages is not None else None
        seen = np.zeros(len(self.ids), bool)
        front = np.unique(np.array(starts, np.int64))
        while len(front):
            if page is not None:
                front = np.flatnonzero(np.bincount(page[front], minlength=page.max() + 1)[page] > 0)
                front = front[~seen[front]]
            seen[front] = True
            out = np.unique(links[front])
            out = out[out >= 0]
            front = out[~seen[out]]
        return np.flatnonzero(seen)


def distinct(vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, group): the places of the first row of each vector, and for every row the number of its vector."""
    whole, width = np.ascontiguousarray(vecs).tobytes(), vecs.itemsize * (vecs.shape[1] if vecs.ndim == 2 else 1)
    numbers: dict[bytes, int] = {}
    group = np.array([numbers.setdefault(whole[at : at + width], len(numbers)) for at in range(0, len(whole), width)], np.int64)
    return np.unique(group, return_index=True)[1], group


def without_copies(shard: Shard, first: np.ndarray, group: np.ndarray) -> Shard:
    """A node a vector, with the links and entries of all its rows: equal rows would crowd others out of a pool."""
    links = shard.table()
    r, c = np.nonzero(links >= 0)
    n = len(first)
    pair = np.unique(group[r] * n + group[links[r, c]])
    src, dst = np.divmod(pair, n)
    src, dst = src[src != dst], dst[src != dst]
    ends = np.searchsorted(src, np.arange(n + 1))
    nbrs = [dst[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    entries = list(dict.fromkeys(group[shard.entries].tolist()))
    return Shard(shard.ids[first], shard.vecs[first], nbrs, entries, None if shard.codes is None else shard.codes[first])


def with_copies(found: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, group: np.ndarray, k: int, deleted: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """The first ``k`` rows of the vectors found, in order of (distance, id)."""
    members = np.argsort(group, kind="stable")
    members = members if deleted is None else members[~deleted[members]]
    ends = np.searchsorted(group[members], np.arange(group.max() + 2))
    out = []
    for place, d in found:
        rows = [members[ends[x] : ends[x + 1]][:k] for x in place]  # ids are in order
        at, far = np.concatenate([np.empty(0, np.int64), *rows]), np.repeat(d, [len(x) for x in rows])
        order = np.lexsort((ids[at], far))[:k]
        out.append((at[order], far[order]))
    return out


def exhaust(shard: Shard, queries: np.ndarray, k: int, own: list[list[int] | None], deleted: np.ndarray | None = None, by_page: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """What ``search_shard`` finds with a pool that no row of the shard can be pushed out of, for many queries.

    Such a search expands all that its start nodes lead to, in whatever order, so that this is followed once for all queries
    with the same start nodes, and their distances to it are worked out together.
    """
    out: list = [None] * len(queries)
    alike: dict[tuple[int, ...], list[int]] = {}
    for i, x in enumerate(own):
        alike.setdefault(tuple(x or shard.entries), []).append(i)
    for starts, which in alike.items():
        read = shard.closure(list(starts), by_page)
        read = read if deleted is None else read[~deleted[read]]
        at, place, d = nearest("l2", np.arange(len(which)), queries[which], shard.ids[read], shard.vecs[read], k)
        place = np.searchsorted(shard.ids, place)  # ids are in order
        ends = np.searchsorted(at, np.arange(len(which) + 1))
        for n, i in enumerate(which):
            out[i] = place[ends[n] : ends[n + 1]], d[ends[n] : ends[n + 1]]
    return out


def medoid_of(vecs: np.ndarray, ids: np.ndarray) -> int:
    d = _l2(vecs.mean(0), vecs)
    return int(np.lexsort((ids, d))[0])


#: Width of the pipeline by a fifth of the place of the first node that isn't expanded; fixed values.
STATIC_WIDTHS = (4, 4, 8, 8, 16, 16, 24, 24, 32)
#: Share of reads that may be wasted while the pipeline widens.
WASTE = 0.1


def search_shard(shard: Shard, query: np.ndarray, k: int, pool: int, width: int = 4, mode: str = "beam", table: np.ndarray | None = None, starts: list[int] | None = None, deleted: np.ndarray | None = None, max_rounds: int | None = None, stats: Stats | None = None, policy: str = "adaptive", deadline: float | None = None):
    """(places, distances) of up to ``k`` rows nearest to ``query``, in order of (distance, id).

    ``table`` scores candidates by PQ codes, otherwise exact distances do. ``deleted`` marks rows that are passed through
    but not returned; the pool grows so that ``pool`` live rows are kept. ``max_rounds`` and ``deadline``, in seconds, stop
    early. ``policy`` is how a pipe widens: "adaptive" by one a round from 4, once the search has come near its goal and
    while few reads are wasted, which are those that had left the pool; "static" by STATIC_WIDTHS; "naive" at once.
    """
    stats = stats if stats is not None else Stats()
    began = time.perf_counter()
    starts = list(dict.fromkeys(starts or shard.entries))[: 1 if mode == "fast" else None]
    if not starts:
        return np.empty(0, np.int64), np.empty(0)

    def rough(at: np.ndarray) -> np.ndarray:
        stats.comparisons += len(at)
        if table is None:
            return _l2(query, shard.vecs[at])
        return table[np.arange(table.shape[0]), shard.codes[at]].sum(1)

    seen = np.zeros(len(shard.ids), bool)
    first = np.array(starts)
    seen[first] = True
    place, score, done = first, rough(first), np.zeros(len(first), bool)
    order = np.lexsort((shard.ids[place], score))
    place, score, done = place[order], score[order], done[order]
    read: list[np.ndarray] = []
    was_read = np.zeros(len(shard.ids), bool)
    step, rounds, wasted = (width if mode != "pipe" or policy == "naive" else 4), 0, 0
    while not done.all() and (max_rounds is None or rounds < max_rounds) and (deadline is None or time.perf_counter() - began < deadline):
        rounds += 1
        waiting = np.flatnonzero(~done)
        if mode == "pipe" and policy == "static":
            step = min(width, STATIC_WIDTHS[min(int(waiting[0]) // 5, len(STATIC_WIDTHS) - 1)])
        elif mode == "pipe" and policy == "adaptive" and waiting[0] >= 5 and step < width and wasted <= WASTE * max(stats.reads, 1):
            step += 1
        take = waiting[:step]
        done[take] = True
        now = place[take]
        stats.hops += len(now)
        if mode == "page" and shard.pages is not None:
            now = np.flatnonzero(np.isin(shard.pages, shard.pages[now]))
            done |= np.isin(place, now)
        now = now[~was_read[now]]
        if not len(now):
            continue
        was_read[now] = True
        seen[now] = True
        stats.reads += len(np.unique(shard.pages[now])) if mode == "page" and shard.pages is not None else len(now)
        read.append(now)
        new = np.unique(np.concatenate([shard.nbrs[x] for x in now])) if len(now) else now
        new = new[~seen[new]]
        if not len(new):
            continue
        seen[new] = True
        place, score, done = np.concatenate([place, new]), np.concatenate([score, rough(new)]), np.concatenate([done, np.zeros(len(new), bool)])
        order = np.lexsort((shard.ids[place], score))
        place, score, done = place[order], score[order], done[order]
        if deleted is None:
            size = pool
        else:
            live = np.cumsum(~deleted[place])
            size = int(np.searchsorted(live, pool) + 1)
        place, score, done = place[:size], score[:size], done[:size]
        wasted += int((~np.isin(now, place)).sum())
    if mode == "fast" and table is None:
        found, d = place[:pool], score[:pool]
        if deleted is not None:
            found, d = found[~deleted[found]], d[~deleted[found]]
        return found[:k], d[:k]
    found = np.concatenate(read) if read else np.empty(0, np.int64)
    if deleted is not None:
        found = found[~deleted[found]]
    d = _l2(query, shard.vecs[found])
    stats.comparisons += len(found) if table is not None else 0
    order = np.lexsort((shard.ids[found], d))[:k]
    return found[order], d[order]


def search_batch(shard: Shard, queries: np.ndarray, k: int, pool: int, width: int = 4, tables: np.ndarray | None = None, starts: np.ndarray | None = None, deleted: np.ndarray | None = None, max_rounds: int | None = None, stats: Stats | None = None, links: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """``search_shard`` in beam mode for many queries in step: a round expands up to ``width`` nodes of every query.

    ``tables`` are the queries' look-up tables and ``starts`` their own start nodes, filled with -1. Queries go in parts
    whose matrices have at most BATCH_CELLS cells.
    """
    stats = stats if stats is not None else Stats()
    links = shard.table() if links is None else links
    n, dim = len(shard.ids), shard.vecs.shape[1] if shard.vecs.ndim == 2 else 0
    if not n:
        return [(np.empty(0, np.int64), np.empty(0))] * len(queries)
    most = max(1, BATCH_CELLS // (width * links.shape[1] * max(dim, 1) + n + 1))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), most):
        part = slice(at, at + most)
        out += _in_step(shard, queries[part], k, min(pool, n), width, None if tables is None else tables[part], None if starts is None else starts[part], deleted, max_rounds, stats, links)
    return out


#: Cells of the matrices of a part of the queries that advance in step.
BATCH_CELLS = 1 << 23


def _in_step(shard, queries, k, pool, width, tables, starts, deleted, max_rounds, stats, links):
    n, every = len(queries), np.arange(len(queries))

    def rough(q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of flat pairs of query and place."""
        stats.comparisons += len(at)
        if tables is None:
            d = shard.vecs[at] - queries[q]
            return np.einsum("ij,ij->i", d, d)
        return tables[q[:, None], np.arange(tables.shape[1])[None], shard.codes[at]].sum(1)

    if starts is None:
        starts = np.tile(np.array(list(dict.fromkeys(shard.entries)))[None], (n, 1))
    # a place beyond the shard stands for nothing, with an infinite score
    none = len(shard.ids)
    ids = np.append(shard.ids, np.iinfo(np.int64).max)
    gone = np.append(deleted if deleted is not None else np.zeros(none, bool), True)
    seen = np.zeros((n, none + 1), bool)
    seen[:, none] = True
    read = np.zeros((n, none + 1), bool)
    place = np.where(starts < 0, none, starts)
    score = np.full(place.shape, np.inf)
    q, c = np.nonzero(place < none)
    score[q, c] = rough(q, place[q, c])
    seen[every[:, None], place] = True
    done = place == none
    rounds = 0
    while not done.all() and (max_rounds is None or rounds < max_rounds):
        order = np.lexsort((ids[place], score), axis=1) if rounds == 0 else np.argsort(done, axis=1, kind="stable")[:, :0]
        if rounds == 0:
            place, score, done = (np.take_along_axis(x, order, 1) for x in (place, score, done))
        rounds += 1
        take = ~done & (np.cumsum(~done, 1) <= width)
        q, c = np.nonzero(take)
        done |= take
        now = place[q, c]
        stats.hops += len(now)
        stats.reads += len(now)
        read[q, now] = True
        new = links[now]
        flat_q, flat = np.repeat(q, new.shape[1]), new.ravel()
        flat_q, flat = flat_q[flat >= 0], flat[flat >= 0]
        fresh = ~seen[flat_q, flat]
        pair = np.unique(flat_q[fresh] * (none + 1) + flat[fresh])
        flat_q, flat = np.divmod(pair, none + 1)
        if not len(flat):
            continue
        seen[flat_q, flat] = True
        each = np.bincount(flat_q, minlength=n)
        column = np.arange(len(flat_q)) - np.repeat(np.cumsum(each) - each, each)
        more = np.full((n, int(each.max())), none)
        more_score = np.full(more.shape, np.inf)
        more[flat_q, column] = flat
        more_score[flat_q, column] = rough(flat_q, flat)
        place, score, done = np.concatenate([place, more], 1), np.concatenate([score, more_score], 1), np.concatenate([done, more == none], 1)
        order = np.lexsort((ids[place], score), axis=1)
        place, score, done = (np.take_along_axis(x, order, 1) for x in (place, score, done))
        if deleted is None:
            place, score, done = place[:, :pool], score[:, :pool], done[:, :pool]
        else:
            over = np.cumsum(~gone[place], 1) - ~gone[place] >= pool  # after the last live row that fits
            place, score, done = np.where(over, none, place), np.where(over, np.inf, score), done | over
            last = max(1, int((place < none).sum(1).max()))
            place, score, done = place[:, :last], score[:, :last], done[:, :last]
    out = []
    for i in range(n):
        found = np.flatnonzero(read[i, :none])
        found = found[~gone[found]]
        d = _l2(queries[i], shard.vecs[found])
        order = np.lexsort((shard.ids[found], d))[:k]
        out.append((found[order], d[order]))
    return out


def prune_node(shard: Shard, node: int, candidates: np.ndarray, degree: int, alpha: float, saturate: bool = True) -> np.ndarray:
    """The neighbours a node gets of ``candidates``; filled up with the nearest where ``saturate`` is set and alpha is over 1."""
    candidates = np.unique(candidates[candidates != node])
    if not len(candidates):
        return candidates
    d = _l2(shard.vecs[node], shard.vecs[candidates])
    order = np.lexsort((shard.ids[candidates], d))[:750]
    candidates, d = candidates[order], d[order]
    x = shard.vecs[candidates]
    sq = (x**2).sum(1)
    among = np.maximum(sq[:, None] - 2 * x @ x.T + sq[None], 0)
    keep = robust_prune(d, among, degree, alpha)
    if saturate and alpha > 1 and len(keep) < degree:
        taken = set(keep)
        keep += [i for i in range(len(candidates)) if i not in taken][: degree - len(keep)]
    return candidates[keep]


def build_shard(ids: np.ndarray, vecs: np.ndarray, degree: int, pool: int, alpha: float = 1.2, saturate: bool = True, seed: int = 0) -> Shard:
    """Two passes over all nodes (alpha 1, then ``alpha``): search from the medoid, prune what was read, link both ways.

    Nodes go in batches that double up to a fiftieth of the shard: a batch is searched in step in the graph as it is, then
    its lists and the links back are made. Lists over SLACK * degree are pruned as they arise, all to ``degree`` at the end.
    Of equal rows the first is built in; the others hang below it in a tree and share its links.
    """
    n = len(ids)
    first, group = distinct(vecs)
    if len(first) < n:
        inner = build_shard(ids[first], vecs[first], degree, pool, alpha, saturate, seed)
        shard = Shard(ids, vecs, [first[inner.nbrs[g]] for g in group])
        order = np.argsort(group, kind="stable")
        wide = max(1, degree // 2)
        for same in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            links = shard.nbrs[same[0]]
            if len(same) > 1:
                shard.nbrs[same[0]] = np.append(links[: degree - 1], same[1])
            for at in range(1, len(same)):
                below = same[2 + (at - 1) * wide : 2 + at * wide]
                shard.nbrs[same[at]] = np.concatenate([below, links[max(0, len(links) - (degree - len(below))) :]])
        connect(shard, degree)
        return shard
    rng = np.random.default_rng(seed)
    shard = Shard(ids, vecs, [np.empty(0, np.int64)] * n)
    if n < 2:
        return shard
    for turn, a in enumerate((1.0, alpha)):
        order, at, size = rng.permutation(n), 0, 1 if turn == 0 else max(1, n // 50)
        while at < n:
            batch = order[at : at + size]
            at, size = at + size, min(2 * size, max(1, n // 50))
            new: dict[int, list[int]] = {}
            for node, (found, _) in zip(batch, search_batch(shard, vecs[batch], n, pool), strict=True):
                shard.nbrs[node] = prune_node(shard, node, np.concatenate([found, shard.nbrs[node]]), degree, a, saturate)
                for other in shard.nbrs[node]:
                    new.setdefault(int(other), []).append(int(node))
            for other, back in new.items():
                both = np.union1d(shard.nbrs[other], back)
                shard.nbrs[other] = prune_node(shard, other, both, degree, a, saturate) if len(both) > SLACK * degree else both
    prune_all(shard, degree, alpha, saturate)
    connect(shard, degree)
    return shard


def connect(shard: Shard, degree: int) -> int:
    """Link every node that the entries don't lead to, so that they do; how many links that took. Lists stay within ``degree``.

    Pruning can leave rows without a link to them, most of all one of many equal rows. The links by which a node was first
    reached are a tree, which stays; such a row goes to the first of its own neighbours in it, else to the nearest node,
    that has room in the tree, in place of that node's farthest neighbour outside the tree where the list is full.
    """
    n = len(shard.ids)
    parent = np.full(n, -1, np.int64)
    seen = np.zeros(n, bool)
    children = np.zeros(n, np.int64)

    def follow(front: list[int]) -> None:
        while front:
            after: list[int] = []
            for at in front:
                links = shard.nbrs[at]
                fresh = links[~seen[links]]
                seen[fresh], parent[fresh] = True, at
                children[at] += len(fresh)
                after += fresh.tolist()
            front = after

    seen[shard.entries] = True
    follow(list(shard.entries))
    made = 0
    for node in np.flatnonzero(~seen).tolist():
        if seen[node]:
            continue
        near = shard.nbrs[node][seen[shard.nbrs[node]]]
        near = near[children[near] < degree]
        if not len(near):
            near = np.flatnonzero(seen & (children < degree))
        near = near[np.lexsort((shard.ids[near], _l2(shard.vecs[node], shard.vecs[near])))]
        at = int(near[0])
        links = shard.nbrs[at]
        if len(links) >= degree:
            spare = links[parent[links] != at]
            far = spare[np.lexsort((shard.ids[spare], _l2(shard.vecs[at], shard.vecs[spare])))[-1]]
            links = links[links != far]
        shard.nbrs[at] = np.append(links, node)
        seen[node], parent[node] = True, at
        children[at] += 1
        made += 1
        follow([node])
    return made


def prune_all(shard: Shard, degree: int, alpha: float = 1.2, saturate: bool = True) -> int:
    """Prune every list that is longer than ``degree``; how many there were."""
    over = [node for node, x in enumerate(shard.nbrs) if len(x) > degree]
    for node in over:
        shard.nbrs[node] = prune_node(shard, node, shard.nbrs[node], degree, alpha, saturate)
    return len(over)


# shards in Spark

NODES = "shard long, id long, vec array<float>, nbrs array<long>"
#: Tasks over which shards to build are dealt, most of them empty: by their size several would be merged into one.
BUILD_TASKS = 256


def build_graph(shards: DataFrame, degree: int, pool: int, alpha: float = 1.2, saturate: bool = True) -> DataFrame:
    """(shard, id, vec, nbrs): every shard's graph, each built in a task of its own, all shards at once."""
    ship(shards.sparkSession)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids = t.column("id").to_numpy()
        s = build_shard(ids, matrix(t.column("vec")), degree, pool, alpha, saturate)
        return pa.table({"shard": t.column("shard"), "id": t.column("id"), "vec": t.column("vec").cast(pa.list_(pa.float32())), "nbrs": pa.array([ids[x].tolist() for x in s.nbrs], pa.list_(pa.int64()))})

    return shards.select(F.col("shard").cast("long"), "id", F.col("vec").cast("array<float>")).filter("vec IS NOT NULL").repartition(BUILD_TASKS, "shard").groupBy("shard").applyInArrow(run, NODES)


def load_shard(t: pa.Table, with_pages: bool = False) -> Shard:
    t = t.sort_by("id")
    ids = t.column("id").to_numpy()
    flat = t.column("nbrs").combine_chunks()
    offsets, values = flat.offsets.to_numpy(), flat.values.to_numpy() if len(flat.values) else np.empty(0, np.int64)
    at = np.searchsorted(ids, values)
    at[at == len(ids)] = 0
    inside = ids[at] == values  # edges out of the shard lead nowhere here
    nbrs = [at[a:b][inside[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    pages = t.column("page").to_numpy() if with_pages else None
    return Shard(ids, matrix(t.column("vec")), nbrs, pages=pages)


MODES = ("beam", "page", "pipe", "batch", "fast")
STATS = "qid long, shard long, hops long, reads long, comparisons long, seconds double"


def route(queries: DataFrame, centers: tuple[np.ndarray, np.ndarray], probes: int) -> DataFrame:
    """(shard, qid, qvec): every query with the ``probes`` shards whose centers are nearest to it."""
    from . import clusters

    near = clusters.nearest_centers(queries.select(F.col("qid").alias("id"), F.col("qvec").alias("vec")), centers, probes)
    return near.select(F.col("id").alias("qid"), F.col("center").alias("shard")).join(queries.select("qid", "qvec"), "qid").select("shard", "qid", "qvec")


def search_graph(nodes: DataFrame, queries: DataFrame, k: int, pool: int, width: int = 4, mode: str = "batch", model=None, deleted: DataFrame | None = None, entries: DataFrame | None = None, max_rounds: int | None = None, centers: tuple[np.ndarray, np.ndarray] | None = None, probes: int = 2, policy: str = "adaptive", starts: DataFrame | None = None, deadline: float | None = None, stats: bool = False, once: bool = True) -> DataFrame:
    """(qid, rank, id, dist): the queries are taken to shards and searched for there; results are merged.

    ``nodes`` has (shard, id, vec, nbrs[, codes][, page]). With ``centers`` (shard numbers and their centers) a query goes
    to the ``probes`` nearest shards; without, to all. Queries meet a shard's nodes in its task by a join on the shard: where
    the nodes are stored in buckets of it, only the queries are shuffled. With a PQ ``model`` candidates are scored by the
    stored codes, or by codes made here where there are none. ``deleted`` (id) is passed through but not returned.
    ``entries`` (shard, id) are start nodes besides the shard's medoid, ``starts`` (qid, id) a query's own ones. A row that
    is in several shards is found once, unless ``once`` is off. With ``stats`` the result is the count of work instead.
    """
    if mode not in MODES:
        raise ValueError(f"no search mode {mode!r}")
    spark = nodes.sparkSession
    ship(spark)
    stored = model is not None and "codes" in nodes.columns
    rows = nodes.select("shard", "id", "vec", "nbrs", *(["page"] if mode == "page" else []), *(["codes"] if stored else []))
    if deleted is not None:
        rows = rows.join(deleted.select("id").distinct().withColumn("deleted", F.lit(True)), "id", "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    if entries is not None:
        rows = rows.join(entries.select("shard", "id").distinct().withColumn("entry", F.lit(True)), ["shard", "id"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    with_deleted, with_entries = deleted is not None, entries is not None
    known = queries.filter("qvec IS NOT NULL").select("qid", "qvec")
    asked = route(known, centers, probes) if centers is not None else known.join(nodes.select("shard").distinct(), F.lit(True)).select("shard", "qid", "qvec")
    if starts is not None:
        asked = asked.join(starts.groupBy("qid").agg(F.sort_array(F.collect_set("id")).alias("starts")), "qid", "left").select("shard", "qid", "qvec", "starts")
    with_starts = starts is not None
    shipped = spark.sparkContext.broadcast(model)
    empty = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("dist", pa.float64())])

    def run(key: tuple, q: pa.Table, t: pa.Table) -> pa.Table:
        model = shipped.value
        if not q.num_rows or not t.num_rows:
            return pa.table({c: [] for c in STAT_NAMES}, schema=STAT_SCHEMA) if stats else empty.empty_table()
        q, t = q.sort_by("qid"), t.sort_by("id")
        shard = load_shard(t, mode == "page")
        if model is not None:
            shard.codes = matrix(t.column("codes"), np.int64) if stored else model.encode(shard.vecs).astype(np.int64)
        gone = t.column("deleted").to_numpy(zero_copy_only=False) if with_deleted else None
        if with_entries:
            shard.entries = [*shard.entries, *np.flatnonzero(t.column("entry").to_numpy(zero_copy_only=False)).tolist()]
        if mode != "fast":
            shard.cover()
        qids, vectors = q.column("qid").to_numpy(), matrix(q.column("qvec"))
        own: list[list[int] | None] = [None] * len(qids)
        if with_starts:
            for i, x in enumerate(q.column("starts").to_pylist()):
                at = np.searchsorted(shard.ids, x or [])
                own[i] = [int(a) for a, v in zip(at, x or [], strict=True) if a < len(shard.ids) and shard.ids[a] == v] or None
        counted, found = [], []
        ids, group, dead = shard.ids, None, gone
        if pool >= len(shard.ids) and mode != "fast" and not stats and max_rounds is None and deadline is None:
            found = exhaust(shard, vectors, k, own, gone, mode == "page")
        elif not stats and mode != "page":
            first, same = distinct(shard.vecs)
            if len(first) < len(ids):
                shard, group = without_copies(shard, first, same), same
                gone = None if gone is None else np.bincount(same, ~gone) == 0
                own = [x if x is None else list(dict.fromkeys(same[x].tolist())) for x in own]
        if found:
            pass
        elif mode == "batch" and not stats and not with_starts and deadline is None:
            tables = None if model is None else (lambda part: np.array([model.table(x) for x in part]))
            links = shard.table()
            for at in range(0, len(qids), QUERIES_IN_STEP):
                part = vectors[at : at + QUERIES_IN_STEP]
                found += search_batch(shard, part, k, pool, width, None if tables is None else tables(part), None, gone, max_rounds, links=links)
        else:
            for i, x in enumerate(vectors):
                s, began = Stats(), time.perf_counter()
                found.append(search_shard(shard, x, k, pool, width, "beam" if mode == "batch" else mode, None if model is None else model.table(x), own[i], gone, max_rounds, s, policy, deadline))
                counted.append((int(qids[i]), key[0].as_py(), s.hops, s.reads, s.comparisons, time.perf_counter() - began))
        if stats:
            return pa.table(dict(zip(STAT_NAMES, map(list, zip(*counted, strict=True)), strict=True)), schema=STAT_SCHEMA)
        if group is not None:
            found = with_copies(found, ids, group, k, dead)
        at = np.concatenate([a for a, _ in found])
        return pa.table({"qid": np.repeat(qids, [len(a) for a, _ in found]), "id": ids[at], "dist": np.concatenate([d for _, d in found])}, schema=empty)

    asked = asked.select(F.col("shard").alias("q_shard"), *[F.col(c).alias(c) for c in asked.columns if c != "shard"])  # columns of its own
    local = asked.groupBy("q_shard").cogroup(rows.groupBy("shard")).applyInArrow(run, STATS if stats else "qid long, id long, dist double")
    if stats:
        return local
    if once:
        local = local.groupBy("qid", "id").agg(F.min("dist").alias("dist"))
    return top_k(local, k).select("qid", "rank", "id", "dist")


STAT_SCHEMA = pa.schema([("qid", pa.int64()), ("shard", pa.int64()), ("hops", pa.int64()), ("reads", pa.int64()), ("comparisons", pa.int64()), ("seconds", pa.float64())])
STAT_NAMES = STAT_SCHEMA.names
#: Queries of a shard whose look-up tables are held at once.
QUERIES_IN_STEP = 512


def sample_entries(vectors: DataFrame, queries: DataFrame, p: float = 0.01, k: int = 10) -> DataFrame:
    """(qid, id): start nodes of each query, its ``k`` nearest rows of a sample with probability ``p``, by exact search."""
    from .filters import sample_or_first
    from .knn import exact_knn

    return exact_knn(sample_or_first(vectors.select("id", "vec"), p), queries, k).select("qid", "id")


def prune_groups(candidates: DataFrame, degree: int, alpha: float = 1.2, saturate: bool = True, own: bool = True) -> DataFrame:
    """(id, nbrs) from (id, vec, cand, cvec): robust pruning of each node's bounded list of candidates.

    ``own`` says that ids and candidates are of one kind, so that a node's own id is no candidate; else ``id`` is a key only.
    """
    ship(candidates.sparkSession)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("cand")
        if own:
            t = t.filter(pc.not_equal(t.column("cand"), key[0]))
        if not t.num_rows:
            return pa.table({"id": pa.array([key[0].as_py()], pa.int64()), "nbrs": pa.array([[]], pa.list_(pa.int64()))})
        ids = np.concatenate([[key[0].as_py()], t.column("cand").to_numpy()])
        vecs = np.concatenate([matrix(t.column("vec").slice(0, 1)), matrix(t.column("cvec"))])
        s = Shard(ids, vecs, [], entries=[0])
        keep = prune_node(s, 0, np.arange(1, len(ids)), degree, alpha, saturate)
        return pa.table({"id": pa.array([ids[0]], pa.int64()), "nbrs": pa.array([ids[keep].tolist()], pa.list_(pa.int64()))})

    return candidates.groupBy("id").applyInArrow(run, "id long, nbrs array<long>")


def reached(nodes: DataFrame) -> DataFrame:
    """(shard, id, nbrs, reached): whether the medoid of its shard leads to a node."""
    ship(nodes.sparkSession)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        shard = load_shard(t)
        links, seen, front = shard.table(), np.zeros(t.num_rows, bool), np.array(shard.entries)
        while len(front):
            seen[front] = True
            out = np.unique(links[front])
            out = out[out >= 0]
            front = out[~seen[out]]
        return pa.table({"shard": t.column("shard"), "id": t.column("id"), "nbrs": t.column("nbrs"), "reached": pa.array(seen)})

    return nodes.select("shard", "id", "vec", "nbrs").groupBy("shard").applyInArrow(run, "shard long, id long, nbrs array<long>, reached boolean")
