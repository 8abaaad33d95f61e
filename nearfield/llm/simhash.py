"""Near-duplicate detection with SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint has 64 bits, from the XXH64 (seed 42) of every shingle of three lower-cased words; fingerprints that
differ in three bits or fewer are linked, and a component is what can be reached over links.

Finding links. The fingerprint is cut into three segments of 22, 21 and 21 bits, each padded to a word of the perfect
(23, 12) Golay code, whose decoder maps a word to the index of the one codeword within three bits. With three errors or
fewer, by pigeonhole, at least one of these holds: two segments are equal; one is equal and another has exactly one
error; each has exactly one error. A key is made for each case, of equal segments as they are and of codeword indices
for the segments with one error. One error flips a segment's parity, so that of two segments that differ in one bit
just one is even: an even segment gives the index it decodes to, an odd one gives the indices of all words one flip
away (six at most), and the two meet. Keys have 33 bits or more, so that a key is shared by chance by few fingerprints
even among billions.

Keys that two different fingerprints share are grouped; a group is compared in numpy, verified by the count of
differing bits, and gives a spanning forest of its links, never all pairs. Groups over GROUP_ROWS are cut into blocks
and every pair of blocks is a group of its own, so that no task holds more than two blocks. Equal fingerprints are one
class from the start. Components come from large-star and small-star rounds over the forest edges, in DataFrames.

Defined results: null and word-free texts have fingerprint zero and link like any other; null doc_ids are allowed, and
a component without any other id has a null id; repeated rows belong to one component; an empty table gives an empty
result. Columns besides doc_id and text are passed over, whatever their names. Texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Segments of the fingerprint: lowest bit and bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101
#: Largest group of fingerprints compared as one, and groups small enough to list their links.
GROUP_ROWS = 4096
SMALL_GROUP = 12
#: Hashes summed in one go.
PIECE = 1 << 16


# fingerprints


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``size`` lower-cased words joined by a space; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII gaps only
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(line, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = len(words) - size + 1
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes."""
    hashes = shingle_hashes(text)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        part = hashes[at : at + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    ship(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


# keys


@cache
def golay_index() -> np.ndarray:
    """For each word of 23 bits, the index of the codeword within three bits of it."""
    data = np.arange(4096, dtype=np.int64)
    rest = data << 11
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    codewords = data << 11 | rest
    flips = [0] + [1 << i for i in range(23)]
    patterns = sorted({a ^ b ^ c for a in flips for b in flips for c in flips})
    index = np.full(1 << 23, -1, np.int16)
    for e in patterns:
        if e.bit_count() <= 3:
            index[codewords ^ e] = data
    return index


def near_indices(segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices that a segment gives for exactly one error, and which of them count: one if even, six at most if odd."""
    index = golay_index()
    flipped = np.sort(index[segment[:, None] ^ (1 << np.arange(bits))[None]].astype(np.int64), axis=1)
    fresh = np.ones(flipped.shape, bool)
    fresh[:, 1:] = flipped[:, 1:] != flipped[:, :-1]
    order = np.argsort(~fresh, axis=1, kind="stable")[:, :8]
    found, valid = np.take_along_axis(flipped, order, 1), np.take_along_axis(fresh, order, 1)
    even = np.bitwise_count(segment) % 2 == 0
    found[even, 0] = index[segment[even]]
    valid[even] = False
    valid[even, 0] = True
    width = max(1, int(valid.sum(1).max(initial=1)))
    return found[:, :width], valid[:, :width]


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place in fps) for every key of every fingerprint; the top bits of a key tell its kind."""
    fps = fps.view(np.uint64)
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    near = [near_indices(p, bits) for p, (_, bits) in zip(parts, SEGMENTS, strict=True)]
    every = np.arange(len(fps))
    found, rows = [], []
    kind = 0
    for i, j in ((0, 1), (0, 2), (1, 2)):
        found.append(kind << 48 | parts[i] << 22 | parts[j])
        rows.append(every)
        kind += 1
    for i in range(3):
        for j in range(3):
            if i != j:
                r, c = np.nonzero(near[j][1])
                found.append(kind << 48 | parts[i][r] << 12 | near[j][0][r, c])
                rows.append(r)
                kind += 1
    (a, va), (b, vb), (c, vc) = near
    r, x, y, z = np.nonzero(va[:, :, None, None] & vb[:, None, :, None] & vc[:, None, None, :])
    found.append(kind << 48 | a[r, x] << 24 | b[r, y] << 12 | c[r, z])
    rows.append(r)
    return np.concatenate(found), np.concatenate(rows)


def keyed(classes: DataFrame) -> DataFrame:
    """(key, fp): the keys of every different fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy()
            for at in range(0, len(fps), 8192):
                part = fps[at : at + 8192]
                k, r = keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(part[r])], ["key", "fp"])

    return classes.select("fp").mapInArrow(run, "key long, fp long")


# links


def forest(fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (place, place) of a spanning forest of the links among ``fps``: each member is reached once."""
    left = np.arange(len(fps))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            chunk, frontier = frontier[:128], frontier[128:]
            close = np.bitwise_count(fps[chunk][:, None] ^ fps[left][None]) <= max_bits
            hit = close.any(0)
            if hit.any():
                a.append(chunk[close[:, hit].argmax(0)])
                b.append(left[hit])
                frontier = np.concatenate([frontier, left[hit]])
                left = left[~hit]
    empty = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def linked(groups: list[np.ndarray], fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints within the groups of sorted rows; ``groups`` are the columns that tell groups apart."""
    n = len(fps)
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = np.any([g[1:] != g[:-1] for g in groups], axis=0)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    of = np.repeat(np.arange(len(starts)), sizes)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    small = np.flatnonzero(np.repeat(sizes <= SMALL_GROUP, sizes))
    for d in range(1, SMALL_GROUP):
        i = small[small + d < n]
        i = i[of[i] == of[np.minimum(i + d, n - 1)]]
        if not len(i):
            break
        close = np.bitwise_count(fps[i] ^ fps[i + d]) <= MAX_BITS
        a.append(fps[i[close]])
        b.append(fps[i[close] + d])
    for g in np.flatnonzero(sizes > SMALL_GROUP):
        own = fps[starts[g] : starts[g] + sizes[g]]
        x, y = forest(own)
        a.append(own[x])
        b.append(own[y])
    if not a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    pairs = np.stack([np.concatenate(a), np.concatenate(b)], 1)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(classes: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): forest edges between different fingerprints that differ in three bits or fewer."""
    every = keyed(classes)
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # by sort-merge: what Spark takes from the classes for the size of their keys is far too low, and it would broadcast them
    counted = every.hint("merge").join(shared.hint("merge"), "key")
    blocks = F.ceil(F.col("n") / group_rows).cast("int")
    met = (
        counted.withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4

        def out(part):
            x, y = linked(part[:3], part[3].view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

        for batch in batches:
            rows = [np.concatenate([h, batch.column(k).to_numpy().astype(np.int64)]) for k, h in enumerate(held)]
            if not len(rows[0]):
                continue
            # the last group may go on in the next batch
            last = np.all([c == c[-1] for c in rows[:3]], axis=0)
            whole = len(last) - int(last[::-1].argmin() if not last.all() else len(last))
            held = [c[whole:] for c in rows]
            if whole:
                yield out([c[:whole] for c in rows])
        if len(held[0]):
            yield out(held)

    return met.mapInArrow(run, "a long, b long").distinct()


# components


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node of its component.

    Large-star and small-star rounds; each is a minimum per node, combined before its shuffle, and a join on the node,
    whose large partitions adaptive execution splits. Rounds grow with the logarithm of the longest path; a result that
    still changes after ``max_rounds`` raises, since it would lose links.
    """
    now = cut(edges.select("a", "b").filter("a <> b"))
    mark = None
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = cut(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), "m").union(low.select("u", "m")).filter("u <> m").distinct()
        now = cut(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == tuple(state):
            break
        mark = tuple(state)
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def link_documents(documents: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row."""
    rows = cut(fingerprints(documents))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(classes, group_rows)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(found, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(documents: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row of each component, the one with the least doc_id, with the columns of ``documents``.

    Of rows equal in doc_id and text one is kept, the least by its other columns. A row is found again by its id and the
    hash of its text. Only rows whose id and text come more than once are grouped; the others go through the join alone.
    """
    linked_rows = link_documents(documents, group_rows)
    # ids before nulls, then the text's hash: the first of each component, and how often it is there
    known = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    counted = linked_rows.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = cut(counted.groupBy("root").agg(F.min(F.struct(known.alias("key"), "n")).alias("k")).select(F.col("k.key.doc_id").alias("_id"), F.col("k.key.text_hash").alias("_hash"), F.col("k.n").alias("_n")))
    own = unused("_text_hash", documents)
    hashed = documents.withColumn(own, F.xxhash64("text"))

    def kept(keepers: DataFrame) -> DataFrame:
        return hashed.join(keepers, hashed["doc_id"].eqNullSafe(keepers["_id"]) & (hashed[own] == keepers["_hash"]), "left_semi")

    single = kept(first.filter("_n = 1")).select(*documents.columns)
    many = kept(first.filter("_n > 1")).groupBy("doc_id", own).agg(F.min(F.struct(*documents.columns)).alias("_row"))
    return single.unionByName(many.select("_row.*"))


def unused(name: str, df: DataFrame) -> str:
    """``name``, made longer until ``df`` has no such column."""
    while name in df.columns:
        name += "_"
    return name
