"""Readers and writers of dense binary vector formats.

Files are found with Spark and read by ranges of rows: each task opens a file through Arrow's file systems, seeks and
reads its rows, so a file of any size is many tasks' work. Row numbers run on over the files in order of their paths.
Truth sets and graph files, whose parts can't be told apart without reading them, are one task's work and under 2 GB.
``write_bin_parts`` writes a directory of files, a file a task; the other writers stream the rows in order of id through
the driver, a bounded part at a time, into one file.

Formats, all little-endian: "bin" is rows, columns (32-bit each) and a row-major matrix, with the header in a block of
its own in the sector-aligned form; "xvecs" rows each begin with their 32-bit length; a truth set is rows, columns, ids
and, by the size of the file, distances and tags; a graph file is size, degree, entry point and frozen count, then for
each node its number of neighbours and the neighbours; a disk index is a sector with nine 64-bit numbers as a "bin", then
sectors of nodes, each its vector, number of neighbours and neighbours; PQ pivots are a sector with five offsets as a
"bin", then four "bin" blocks: pivots, center, order of dimensions, borders of chunks.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import normalize
from ..session import cut, ship

TYPES = {"float": ("<f4", "array<float>", pa.float32()), "int8": ("<i1", "array<tinyint>", pa.int8()), "uint8": ("<u1", "array<smallint>", pa.int16()), "uint32": ("<u4", "array<bigint>", pa.int64())}
SECTOR = 4096
PART_ROWS = 8192


def _files(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[tuple]], schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    """(file, then the columns of ``schema``) of every record ``parse`` yields as columns for each file."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path"), b.column("content"), strict=True):
                for columns in parse(content.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(columns[0])), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["file", *names])

    return files.mapInArrow(run, f"file string, {schema}")


def header(content: bytes) -> tuple[int, int]:
    rows, columns = struct.unpack_from("<ii", content)
    if rows < 0 or columns < 0:
        raise ValueError(f"a header of {rows} rows and {columns} columns")
    return rows, columns


def _open(path: str):
    from pyarrow import fs

    if ":/" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    system, at = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return system.open_input_file(unquote(at) if path.startswith("file:") else at)


def read_at(path: str, offset: int, size: int) -> bytes:
    with _open(path) as f:
        got = f.read_at(size, offset)
    if len(got) != size:
        raise ValueError(f"{path} ends before {offset + size}")
    return got


def _heads(spark: SparkSession, path: str, head: Callable[[str, int], tuple[int, ...]], names: list[str]) -> DataFrame:
    """(file, length, ``names``) of every file: whole numbers that ``head`` reads of (file, length). No content is loaded."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [head(f, n) for f, n in zip(b.column("file").to_pylist(), b.column("length").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("length"), *[pa.array(x, pa.int64()) for x in zip(*found, strict=True)]] if found else [b.column("file"), b.column("length"), *[pa.array([], pa.int64()) for _ in names]], ["file", "length", *names])

    return files.mapInArrow(run, "file string, length long, " + ", ".join(f"{n} long" for n in names))


def _ranges(heads: DataFrame, rows: str, part_rows: int) -> DataFrame:
    """``heads`` with _first and _rows of each range of rows and _before, the rows of all files with a lesser path; a range a task."""
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    known = heads.withColumn("_before", F.coalesce(F.sum(rows).over(order), F.lit(0).cast("long"))).filter(F.col(rows) > 0)
    parts = known.withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col(rows) - 1, F.lit(part_rows).cast("long"))))
    parts = parts.withColumn("_rows", F.least(F.lit(part_rows).cast("long"), F.col(rows) - F.col("_first")))
    return parts.repartition(max(1, parts.count()))  # by number, so that adaptive execution doesn't merge the tasks of these short rows


#: Rows of a range that a task reads.
RANGE_ROWS = 1 << 18


def _read_rows(parts: DataFrame, parse: Callable[[dict], Iterator[tuple]], schema: str, types: list[pa.DataType]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.to_pylist():
                for columns in parse(part):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return parts.mapInArrow(run, schema)


def read_bin(spark: SparkSession, path: str, kind: str = "float", header_bytes: int = 8) -> DataFrame:
    """(id, vec) of "bin" files; ``header_bytes`` 4096 for the sector-aligned form."""
    dtype = np.dtype(TYPES[kind][0])

    def head(file: str, length: int) -> tuple[int, int]:
        rows, columns = header(read_at(file, 0, 8))
        if length != header_bytes + rows * columns * dtype.itemsize:
            raise ValueError(f"{length} bytes don't hold {rows} rows of {columns}")
        return rows, columns

    def parse(part: dict) -> Iterator[tuple]:
        columns = part["columns"]
        for at in range(part["_first"], part["_first"] + part["_rows"], PART_ROWS):
            n = min(PART_ROWS, part["_first"] + part["_rows"] - at)
            values = np.frombuffer(read_at(part["file"], header_bytes + at * columns * dtype.itemsize, n * columns * dtype.itemsize), dtype).reshape(n, columns)
            yield part["_before"] + np.arange(at, at + n), values.astype(dtype if kind in ("float", "int8") else np.int64).tolist()

    parts = _ranges(_heads(spark, path, head, ["rows", "columns"]), "rows", RANGE_ROWS)
    return _read_rows(parts, parse, f"id long, vec {TYPES[kind][1]}", [pa.int64(), pa.list_(TYPES[kind][2])])


def read_bin_header(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, columns) from the first eight bytes of each file."""
    return _heads(spark, path, lambda file, length: header(read_at(file, 0, 8)), ["rows", "columns"]).select("file", "rows", "columns")


def max_id(spark: SparkSession, path: str) -> int | None:
    """The greatest id of the id maps under ``path``."""
    return read_ids(spark, path).agg(F.max("id")).first()[0]


def to_global(local: DataFrame, maps: DataFrame) -> DataFrame:
    """``local`` (shard, local_id, ...) with the id that the shard's map (shard, local_id, id) gives."""
    return local.join(maps.select("shard", "local_id", "id"), ["shard", "local_id"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(loc, id) of a one-column uint32 file: tags, id maps, delete lists."""
    return read_bin(spark, path, "uint32").select(F.col("id").alias("loc"), F.get("vec", F.lit(0)).alias("id"))


def read_xvecs(spark: SparkSession, path: str, kind: str = "float") -> DataFrame:
    """(id, vec) of fvecs ("float"), bvecs ("uint8") and ivecs ("uint32") files."""
    dtype = np.dtype(TYPES[kind][0])

    def head(file: str, length: int) -> tuple[int, int]:
        if not length:
            return 0, 0
        (dim,) = struct.unpack("<i", read_at(file, 0, 4))
        if dim < 0 or length % (4 + dim * dtype.itemsize):
            raise ValueError(f"{length} bytes don't hold rows of {dim}")
        return length // (4 + dim * dtype.itemsize), dim

    def parse(part: dict) -> Iterator[tuple]:
        record = np.dtype([("dim", "<i4"), ("vec", TYPES[kind][0], (part["columns"],))])
        for at in range(part["_first"], part["_first"] + part["_rows"], PART_ROWS):
            n = min(PART_ROWS, part["_first"] + part["_rows"] - at)
            rows = np.frombuffer(read_at(part["file"], at * record.itemsize, n * record.itemsize), record)
            if (rows["dim"] != part["columns"]).any():
                raise ValueError("rows of different lengths")
            yield part["_before"] + np.arange(at, at + n), rows["vec"].astype(dtype if kind in ("float", "int8") else np.int64).tolist()

    parts = _ranges(_heads(spark, path, head, ["rows", "columns"]), "rows", RANGE_ROWS)
    return _read_rows(parts, parse, f"id long, vec {TYPES[kind][1]}", [pa.int64(), pa.list_(TYPES[kind][2])])


#: The numbers of a disk index's first sector.
DISK_HEADER = ("rows", "dim", "medoid", "node_bytes", "per_sector", "n_frozen", "frozen", "tags_at", "end")


def read_disk_index(spark: SparkSession, path: str, kind: str = "float") -> DataFrame:
    """(id, vec, nbrs, page, slot) of disk index files, by ranges of sectors."""
    dtype = np.dtype(TYPES[kind][0])

    def head(file: str, length: int) -> tuple[int, ...]:
        n, _ = header(read_at(file, 0, 8))
        if n < 9:
            raise ValueError(f"a header of {n} numbers is none of a disk index")
        return struct.unpack("<9Q", read_at(file, 8, 72))

    def parse(part: dict) -> Iterator[tuple]:
        dim, size, per = part["dim"], part["node_bytes"], part["per_sector"]
        pages = read_at(part["file"], SECTOR * (1 + part["_first"]), SECTOR * part["_rows"])
        out: list[list] = [[], [], [], [], []]
        for k in range(part["_rows"]):
            for slot in range(per):
                id = (part["_first"] + k) * per + slot
                if id >= part["rows"]:
                    break
                at = k * SECTOR + slot * size
                (degree,) = struct.unpack_from("<I", pages, at + dim * dtype.itemsize)
                for column, value in zip(out, (part["_before"] + id, np.frombuffer(pages, dtype, dim, at).tolist(), np.frombuffer(pages, "<u4", degree, at + dim * dtype.itemsize + 4).tolist(), part["_first"] + k, slot), strict=True):
                    column.append(value)
        yield tuple(out)

    heads = _heads(spark, path, head, list(DISK_HEADER)).withColumn("sectors", F.ceil(F.col("rows") / F.col("per_sector")).cast("long"))
    parts = _ranges(heads, "sectors", max(1, RANGE_ROWS // 32)).withColumn("_before", F.lit(0).cast("long"))
    return _read_rows(parts, parse, f"id long, vec {TYPES[kind][1]}, nbrs array<bigint>, page long, slot long", [pa.int64(), pa.list_(TYPES[kind][2]), pa.list_(pa.int64()), pa.int64(), pa.int64()])


def write_disk_index(nodes: DataFrame, file: str, degree: int, medoid: int, kind: str = "float") -> int:
    """(id, vec, nbrs) with ids from 0 without a gap as one disk index file; lists are cut to ``degree``, none may be empty."""
    dtype, n, dim = np.dtype(TYPES[kind][0]), 0, 0
    page, per, size = b"", 1, 0
    with open(file, "wb") as out:
        out.write(b"\0" * SECTOR)
        for r in _stream(nodes.select("id", F.struct("id", "vec", "nbrs").alias("r")), "r"):
            if r["id"] != n or not r["nbrs"]:
                raise ValueError(f"row {n} is missing or has no neighbours")
            if not n:
                dim = len(r["vec"])
                size = (degree + 1) * 4 + dim * dtype.itemsize
                per = SECTOR // size
                if not per:
                    raise ValueError("a node is longer than a sector")
            nbrs = np.array(r["nbrs"][:degree], "<u4")
            page += (np.array(r["vec"]).astype(dtype).tobytes() + struct.pack("<I", len(nbrs)) + nbrs.tobytes()).ljust(size, b"\0")
            n += 1
            if n % per == 0:
                out.write(page.ljust(SECTOR, b"\0"))
                page = b""
        if page:
            out.write(page.ljust(SECTOR, b"\0"))
        end = out.tell()
        out.seek(0)
        out.write(struct.pack("<ii9Q", 9, 1, n, dim, medoid, size, per, 0, 0, end, end))
    return n


def write_pivots(model, file: str) -> None:
    """A PQ model whose chunks have 256 pivots each, as a file of pivots."""
    pivots = np.concatenate([p for p in model.pivots], 1)
    blocks = [(pivots, "<f4"), (model.center[:, None], "<f4"), (np.arange(len(model.center))[:, None], "<u4"), (np.array(model.offsets)[:, None], "<u4")]
    at = [SECTOR]
    with open(file, "wb") as out:
        out.write(b"\0" * SECTOR)
        for values, dtype in blocks:
            out.write(struct.pack("<ii", *values.shape) + values.astype(dtype).tobytes())
            at.append(out.tell())
        out.seek(0)
        out.write(struct.pack("<ii5Q", 5, 1, *at))


def read_pivots(path: str):
    """The PQ model of a file of pivots."""
    from ..operators.pq import PQModel

    at = struct.unpack("<5Q", read_at(path, 8, 40))

    def block(k: int, dtype: str) -> np.ndarray:
        raw = read_at(path, at[k], at[k + 1] - at[k])
        return np.frombuffer(raw, dtype, offset=8).reshape(header(raw))

    pivots, center, order, offsets = block(0, "<f4"), block(1, "<f4")[:, 0], block(2, "<u4")[:, 0], block(3, "<u4")[:, 0]
    if (order != np.arange(len(order))).any():
        raise ValueError("dimensions in another order")
    return PQModel(center.astype(float), [int(x) for x in offsets], [pivots[:, a:b].astype(float) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])


def write_bin_parts(df: DataFrame, path: str, kind: str = "float", rows: int = RANGE_ROWS) -> DataFrame:
    """(file, rows) of a directory of "bin" files that hold (id, vec) in order of id, each written by a task of its own.

    ``path`` must be one that all executors can write to. A task that runs again writes the same file again.
    """
    from pyspark import TaskContext

    dtype = np.dtype(TYPES[kind][0])
    ship(df.sparkSession)
    ids = cut(df.select("id"))
    parts = max(1, -(-ids.count() // rows))
    ordered = df.select("id", "vec").repartitionByRange(parts, "id").sortWithinPartitions("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name, n, columns = f"{path.rstrip('/')}/part-{TaskContext.get().partitionId():06d}.bin", 0, 0
        system, at = fs.FileSystem.from_uri(name) if ":/" in name else (fs.LocalFileSystem(), name)
        held = []
        for b in batches:
            for vec in b.column("vec").to_pylist():
                if n and len(vec) != columns:
                    raise ValueError(f"a row of {len(vec)} elements, not {columns}")
                columns, n = len(vec), n + 1
                held.append(np.array(vec).astype(dtype).tobytes())
        system.create_dir(at.rpartition("/")[0], recursive=True)
        with system.open_output_stream(at) as out:
            out.write(struct.pack("<ii", n, columns))
            for x in held:
                out.write(x)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "rows"])

    return ordered.mapInArrow(run, "file string, rows long")


def random_vectors(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """(id, vec) of ``n`` random vectors of whole numbers in -128..127, to warm a search up where there is no sample."""
    number = lambda k: (F.pmod(F.xxhash64("id", k, F.lit(seed)), F.lit(256)) - 128).cast("float")
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(dim)), number).alias("vec"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rank, id, dist, tag) of truth sets; dist and tag are null where the file has none, tag is then the id."""

    def parse(content: bytes) -> Iterator[tuple]:
        rows, k = header(content)
        cells = rows * k
        blocks = (len(content) - 8) / (4 * cells) if cells else 0
        if blocks not in (0, 1, 2, 3):
            raise ValueError(f"{len(content)} bytes are no truth set of {rows} rows of {k}")
        ids = np.frombuffer(content, "<u4", cells, 8).astype(np.int64)
        dist = np.frombuffer(content, "<f4", cells, 8 + 4 * cells).astype(float).tolist() if blocks >= 2 else [None] * cells
        tags = np.frombuffer(content, "<u4", cells, 8 + 8 * cells).astype(np.int64) if blocks == 3 else ids
        q, r = np.divmod(np.arange(cells), max(k, 1))
        yield q, r + 1, ids, dist, tags

    df = _files(spark, path, parse, "qid long, rank long, id long, dist double, tag long", ["qid", "rank", "id", "dist", "tag"], [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()])
    return df.drop("file")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(id, nbrs) of a graph file."""

    def parse(content: bytes) -> Iterator[tuple]:
        (size,) = struct.unpack_from("<Q", content)
        if size != len(content):
            raise ValueError(f"{len(content)} bytes of a graph of {size}")
        words = np.frombuffer(content, "<u4", offset=24).astype(np.int64)
        at, out = 0, []
        while at < len(words):
            n = int(words[at])
            out.append(words[at + 1 : at + 1 + n].tolist())
            at += n + 1
        yield np.arange(len(out)), out

    return _files(spark, path, parse, "id long, nbrs array<bigint>", ["id", "nbrs"], [pa.int64(), pa.list_(pa.int64())]).drop("file")


# writers


def _stream(df: DataFrame, column: str, order: str = "id") -> Iterator:
    for row in df.select(order, column).orderBy(order).toLocalIterator(prefetchPartitions=True):
        yield row[column]


def write_bin(df: DataFrame, file: str, kind: str = "float", header_bytes: int = 8, dim: int | None = None) -> int:
    """Rows of (id, vec) in order of id as one "bin" file; with ``dim`` padded elements beyond it are dropped."""
    dtype, n, columns = np.dtype(TYPES[kind][0]), 0, 0
    with open(file, "wb") as out:
        out.write(b"\0" * header_bytes)
        for vec in _stream(df, "vec"):
            vec = vec[:dim] if dim else vec
            if n and len(vec) != columns:
                raise ValueError(f"row {n} has {len(vec)} elements, not {columns}")
            columns = len(vec)
            out.write(np.array(vec).astype(dtype).tobytes())
            n += 1
        out.seek(0)
        out.write(struct.pack("<ii", n, columns))
    return n


def write_xvecs(df: DataFrame, file: str, kind: str = "float", unit: bool = False) -> int:
    """Rows in order of id as one file, with ``unit`` divided by their lengths."""
    df = df.select("id", normalize(F.col("vec")).alias("vec")) if unit else df
    dtype, n = np.dtype(TYPES[kind][0]), 0
    with open(file, "wb") as out:
        for vec in _stream(df, "vec"):
            out.write(struct.pack("<i", len(vec)) + np.array(vec).astype(dtype).tobytes())
            n += 1
    return n


def write_ids(df: DataFrame, file: str, id: str = "id", order: str = "loc") -> int:
    return write_bin(df.select(F.col(order).alias("id"), F.array(F.col(id)).alias("vec")), file, "uint32")


def write_truth(truth: DataFrame, file: str, k: int) -> int:
    """Three blocks: ids, distances and tags (ids where there is no tag); every query must have ``k`` rows."""
    tag = F.col("tag") if "tag" in truth.columns else F.col("id")
    rows = truth.filter(F.col("rank") <= k).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "dist", F.coalesce(tag, F.col("id")).alias("tag")))).alias("r"))
    blocks: list[list[bytes]] = [[], [], []]
    n = 0
    for r in _stream(rows, "r", "qid"):
        if len(r) != k:
            raise ValueError(f"{len(r)} rows of a query, not {k}")
        blocks[0].append(np.array([x["id"] for x in r], "<u4").tobytes())
        blocks[1].append(np.array([x["dist"] for x in r], "<f4").tobytes())
        blocks[2].append(np.array([x["tag"] for x in r], "<u4").tobytes())
        n += 1
    with open(file, "wb") as out:
        out.write(struct.pack("<ii", n, k))
        for b in blocks:
            out.writelines(b)
    return n


def write_result(results: DataFrame, prefix: str, pool: int, k: int) -> str:
    """The ids of results as PREFIX_L_idx_uint32.bin."""
    file = f"{prefix}_{pool}_idx_uint32.bin"
    rows = results.filter(F.col("rank") <= k).groupBy(F.col("qid").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("vec"))
    write_bin(rows, file, "uint32")
    return file


def write_graph(graph: DataFrame, file: str, entry: int = 0, frozen: int = 0) -> int:
    n = degree = 0
    with open(file, "wb") as out:
        out.write(b"\0" * 24)
        for nbrs in _stream(graph, "nbrs"):
            out.write(struct.pack("<I", len(nbrs)) + np.array(nbrs, "<u4").tobytes())
            degree = max(degree, len(nbrs))
            n += 1
        size = out.tell()
        out.seek(0)
        out.write(struct.pack("<QIIQ", size, degree, entry, frozen))
    return n
