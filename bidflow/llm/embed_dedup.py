"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Unit vectors are projected onto many random directions. Two vectors of cosine c lie sqrt(2 - 2c)
apart, so their projections differ by a centred normal amount that is small against the spread of
all projections. Directions are taken in tables of ``g``: each direction's order is cut into
strips of width ``STRIP``, and vectors that share all strips of a table are candidates. ``g`` grows
with the logarithm of the number of vectors, so that strips hold few unrelated ones; the number of
tables follows from the wanted recall at the threshold. For every candidate pair the windows around
one vector's projections that hold the other's are counted, over all directions of all tables; a pair
whose count reaches the calibrated number is verified by its exact cosine in double precision. A pair
that several tables find counts in the first of them alone, so links need no distinct.

Equal vectors form one class. A table's cell of more than ``BLOCK`` classes is cut into blocks, and
pairs of blocks are compared in tasks of their own. Tasks return sums and local components, never
pairs: as many rows as they read at most.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths don't link; rows with a null id link with nothing and have a
null component; repeated rows are vectors of their own, linked with each other; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidflow.llm.common import read, stored
from bidflow.llm.graph import components
from bidflow.llm.shingles import mixed

COSINE = 0.95
#: Of pairs at the threshold itself; closer pairs are found more often.
RECALL = 0.95
STRIP = 1.6  # in units of the projections' spread over random unit vectors
SHARING = 32  # unrelated vectors in a cell
BLOCK = 1024
SEED = 7


class Directions:
    """Random directions in tables, for vectors of dim components."""

    def __init__(self, dim: int, rows: int, cosine: float, recall: float):
        spread = 1 / math.sqrt(dim)
        apart = math.sqrt(2 - 2 * cosine) * spread
        unrelated = NormalDist(0, math.sqrt(2) * spread)
        width = STRIP * spread
        steps = [(k + 0.5) / 200 for k in range(200)]
        same = sum(2 * width * (1 - x) * unrelated.pdf(x * width) for x in steps) / 200
        near = 1 - math.sqrt(2 / math.pi) * apart / width
        self.g = max(1, math.ceil(math.log(max(rows, 2) / SHARING) / -math.log(same)))
        self.tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**self.g)))
        self.width, self.window = width, 2 * apart
        m, p = self.g * self.tables, 2 * NormalDist().cdf(2) - 1
        self.least = max(1, math.floor(m * p - 4 * math.sqrt(m * p * (1 - p))))
        rng = np.random.default_rng([SEED, dim])
        axes = rng.standard_normal((dim, m))
        self.axes, self.shift = axes / np.linalg.norm(axes, axis=0), rng.uniform(0, width, m)

    def cells(self, projected: np.ndarray) -> np.ndarray:
        """Cell of each row in each table."""
        strips = np.floor((projected + self.shift) / self.width).astype(np.int64).view(np.uint64)
        out = np.zeros((len(projected), self.tables), np.uint64) + np.arange(1, self.tables + 1, dtype=np.uint64)
        for k in range(self.g):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + strips[:, k :: self.g])
        return out.view(np.int64)


def unit(data: list[bytes], dim: int) -> np.ndarray:
    x = np.stack([np.frombuffer(d, np.float32 if len(d) == 4 * dim else np.float64) for d in data]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def parsed(vectors: DataFrame) -> DataFrame:
    """vec_id, key and data (components, in 32 bits where that is exact; both null unless the vector can be linked), dim."""

    def run(batches):
        for batch in batches:
            keys, data, dims = [], [], []
            for v in batch.column("v"):
                x = np.array([], float)
                if v.is_valid and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                ok = bool(len(x) and np.isfinite(x).all() and x.any())
                x = x + 0.0  # one zero
                with np.errstate(over="ignore", under="ignore"):
                    short = x.astype(np.float32)
                keys.append(xxhash.xxh3_128_digest(x.tobytes()) if ok else None)
                data.append((short if (short == x).all() else x).tobytes() if ok else None)
                dims.append(len(x) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(data, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "key", "data", "dim"])

    return vectors.mapInArrow(run, "vec_id long, key binary, data binary, dim int")


def placed(classes: DataFrame, directions: dict[int, Directions], cells_alone: bool = False) -> DataFrame:
    """Each class in its cells: (cell, id, many, dim, data, table), or (cell)."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                d = directions[dim]
                cells = d.cells(unit(part.column("data").to_pylist(), dim) @ d.axes)
                for t in range(d.tables):
                    cell = pa.array(cells[:, t])
                    if cells_alone:
                        yield pa.RecordBatch.from_arrays([cell], names=["cell"])
                    else:
                        yield pa.RecordBatch.from_arrays([cell, *(part.column(c) for c in ("id", "many", "dim", "data")), pa.array(np.full(part.num_rows, t, np.int32))], names=["cell", "id", "many", "dim", "data", "table"])

    return classes.select("id", "many", "dim", "data").mapInArrow(run, "cell long" if cells_alone else "cell long, id long, many long, dim int, data binary, table int")


def _links_of(batch: pa.RecordBatch, directions: dict[int, Directions], cosine: float):
    """(id, links, root) of rows that lie sorted by group."""
    n = batch.num_rows
    group, table, ids, many, dims, own, left, right = (batch.column(c).to_numpy() for c in ("group", "table", "id", "many", "dim", "block", "left", "right"))
    links, root = np.zeros(n, np.int64), np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for dim in np.unique(dims).tolist():
        d, at = directions[dim], np.flatnonzero(dims == dim)
        x = unit([v for v, k in zip(batch.column("data").to_pylist(), (dims == dim).tolist()) if k], dim)
        projected = x @ d.axes
        cells = d.cells(projected)
        g, t = group[at], table[at]
        crossing, b = (left != right)[at], own[at]
        for k in range(1, len(at)):
            i = np.flatnonzero(g[k:] == g[:-k])
            if not len(i):
                break
            i = i[~crossing[i] | (b[i] != b[i + k])]
            for c in range(0, len(i), 50_000):
                a = i[c : c + 50_000]
                z = a + k
                first = (cells[a] == cells[z]).argmax(axis=1) == t[a]
                a, z = a[first], z[first]
                near = (np.abs(projected[a] - projected[z]) <= d.window).sum(axis=1) >= d.least
                a, z = a[near], z[near]
                linked = np.einsum("ij,ij->i", x[a], x[z]) >= cosine
                found.append((at[a[linked]], at[z[linked]]))
    for a, z in found:
        np.add.at(links, a, many[z])
        np.add.at(links, z, many[a])
    if found:
        a, z = (np.concatenate(p) for p in zip(*found))
        while True:  # local components
            low = np.minimum(root[a], root[z])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, z, low)
            root = root[root]
            if (root == before).all():
                break
    hit = links > 0
    return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[root[hit]])], names=["id", "links", "root"])


def compared(rows: DataFrame, directions: dict[int, Directions], cosine: float) -> DataFrame:
    def run(batches):
        rest = None  # rows of a group that may go on in the next batch
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            group = batch.column("group").to_numpy()
            if not len(group):
                continue
            others = np.flatnonzero(group != group[-1])
            whole = int(others[-1]) + 1 if len(others) else 0
            rest = batch.slice(whole)
            if whole:
                yield _links_of(batch.slice(0, whole), directions, cosine)
        if rest is not None and rest.num_rows:
            yield _links_of(rest, directions, cosine)

    return rows.mapInArrow(run, "id long, links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    table = stored(parsed(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))), "vectors")
    classes = stored(
        table.where("key is not null and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("many"), F.min_by("data", "vec_id").alias("data"), F.min("dim").alias("dim")),
        "vector-classes",
    )
    counts = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row per vector length
    directions = {dim: Directions(dim, n, cosine, recall) for dim, n in counts.items()}
    cells = placed(classes, directions)
    # Stored, so that the join reads both sides by shuffle and Spark can split a hot cell.
    large = stored(placed(classes, directions, True).groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK), "large-cells")
    blocks = F.coalesce(F.ceil(F.col("size") / (BLOCK // 2)), F.lit(1)).cast("int")
    split = cells.join(large, "cell", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    paired = split.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("cell", "table", "id", "many", "dim", "data", "block", F.least("block", "with").alias("left"), F.greatest("block", "with").alias("right"))
    keyed = paired.withColumn("group", F.xxhash64("cell", "left", "right", "dim", "table"))
    dealt = keyed.drop("cell").repartition("group").sortWithinPartitions("group")
    found = stored(compared(dealt, directions, cosine), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    part = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "vector-components").withColumnRenamed("node", "id")
    mine = classes.select("key", "id", "many").join(links, "id", "left").join(part, "id", "left")
    mine = mine.select("key", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    joined = table.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(mine, "key", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op9_projection_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
