"""Exact top-k search by inner product, by a three-phase uniform threshold over vertical lists.

Components become integers, floor(``SCALE`` * x). A vector's components are split into ``LISTS`` runs; each
run makes a list of its own, which scores a vector by the inner product over the run alone. A query's
score is the sum of its lists' scores, and no list sees another.

1. Every list names its ``k`` best vectors for a query. The named ones are looked up in the other lists;
   the k-th best of their sums, tau, is a bound that the k-th best score can't be below.
2. tau, dealt evenly over the lists, goes to every list with the query. A list sends all entries at its
   share or above: a vector that no list sends scores below tau. The sums of vectors that all lists sent
   are exact, and raise tau; a vector sent by some lists is given up if it can't reach tau even with the
   most that the silent lists can add (one less than their shares).
3. What is left is looked up in the silent lists; the k best of the exact scores are the result.

Lists are computed in tiles of at most about ``ROWS`` rows by ``QUERIES`` queries (the stated queries against
all rows, in blocks), dealt out by hashes of ids; a tile is one product of two matrices, in single or
double precision where that is exact, in whole numbers of any size elsewhere. A query's entries are
merged by query and vector, so no task gathers all entries of a query; k best rows are cut before they
are shuffled. No limit stands on what a list sends.

Edge cases: vectors that are null or hold null or non-finite components take no part, neither do rows
with a null id; of several rows with one id one counts, the least by its components' bytes; vectors are
compared with those of their own length alone; empty vectors score 0 with each other; ties go to the
smaller id; components too large for a double count as the largest double, and a list's scores beyond
2**61 count as that; if a query has fewer than k candidates all are returned; an empty table, or one
without an id divisible by ``every``, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidflow.llm.common import discard, read, stored

K = 5
EVERY = 50
SCALE = 256
LISTS = 2
ROWS, QUERIES = 8192, 2048
MOST = 1 << 61


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, data): floor(SCALE * x) of each component, as 32-bit integers, or as doubles where one doesn't fit."""

    def run(batches):
        for batch in batches:
            ids, dims, data = [], [], []
            for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("v"), strict=True):
                if vec_id is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    with np.errstate(over="ignore"):
                        x = np.clip(np.floor(x * SCALE), -np.finfo(float).max, np.finfo(float).max)
                    ids.append(vec_id)
                    dims.append(len(x))
                    data.append((x.astype("<i4") if (np.abs(x) < 1 << 31).all() else x.astype("<f8")).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], names=["vec_id", "dim", "data"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(run, "vec_id long, dim int, data binary")


def lists(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, lst, part): each vector's components, cut into LISTS runs."""
    one = integers(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min(F.struct("dim", "data")).alias("x")).select("vec_id", "x.*")
    wide = F.when(F.col("dim") == 0, 0).otherwise(F.length("data") / F.greatest("dim", F.lit(1))).cast("int")
    start = lambda g: F.floor(F.col("dim") * g / LISTS).cast("int") * wide
    run = lambda g: F.struct(F.lit(g).alias("lst"), F.substring("data", start(g) + 1, start(g + 1) - start(g)).alias("part"))
    return one.select("vec_id", "dim", F.explode(F.array(*map(run, range(LISTS)))).alias("x")).select("vec_id", "dim", "x.*")


def matrix(parts: list[bytes], dim: int, lst: int) -> np.ndarray:
    """Rows of a list as doubles."""
    n = (lst + 1) * dim // LISTS - lst * dim // LISTS
    return np.array([np.frombuffer(p, "<i4" if len(p) == 4 * n else "<f8") for p in parts], np.float64).reshape(len(parts), n)


def products(x: np.ndarray, q: np.ndarray, pairwise: bool = False) -> np.ndarray:
    """Exact inner products of the rows of x and q, as 64-bit integers within MOST: of each with each, or pair by pair."""
    n = max(x.shape[1], 1)
    high = [np.abs(m).max(axis=1, initial=0) for m in (x, q)]
    most = n * high[0].max(initial=0) * high[1].max(initial=0)
    kind = np.float32 if most < 1 << 24 else np.float64
    large = [h >= np.sqrt((1 << 53) / n) for h in high] if most >= 1 << 53 else [h < 0 for h in high]
    safe = [np.where(big[:, None], 0, m).astype(kind) for big, m in zip(large, (x, q), strict=True)]
    out = np.einsum("ij,ij->i", *safe, dtype=np.float64) if pairwise else safe[0] @ safe[1].T
    out = out.astype(np.int64)
    whole = lambda v: [int(c) for c in v]
    exact = lambda i, j: max(-MOST, min(MOST, sum(a * b for a, b in zip(whole(x[i]), whole(q[j]), strict=True))))
    if pairwise:
        for i in np.flatnonzero(large[0] | large[1]):
            out[i] = exact(i, i)
    else:
        for i, j in np.argwhere(large[0][:, None] | large[1][None, :]):
            out[i, j] = exact(i, j)
    return out


def tiles(table: DataFrame, queries: DataFrame, run, schema: str) -> DataFrame:
    """run(vec ids, rows of a list, query ids, queries of the list, cutoffs, list) -> columns, for each tile of each list."""
    n, m = (df.select(F.ceil(F.count("*") / LISTS)).first()[0] for df in (table, queries))
    stripes, blocks = max(1, -(-n // ROWS)), max(1, -(-m // QUERIES))
    dealt = lambda many, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    key = ["dim", "lst", "stripe", "block"]
    left = table.select("vec_id", "dim", "lst", "part", dealt(stripes, 0).alias("stripe"), every(blocks).alias("block"))
    right = queries.select("vec_id", "dim", "lst", "part", "cutoff", dealt(blocks, 1).alias("block"), every(stripes).alias("stripe"))
    names = [f.split()[0] for f in schema.split(", ")]

    def tile(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64())] * len(names), names=names)
        dim, lst = (rows.column(c)[0].as_py() for c in ("dim", "lst"))
        x, q = (matrix(t.column("part").to_pylist(), dim, lst) for t in (rows, asked))
        cutoffs = asked.column("cutoff").fill_null(-LISTS * MOST).to_numpy()
        found = run(rows.column("vec_id").to_numpy(), x, asked.column("vec_id").to_numpy(), q, cutoffs, lst)
        return pa.table([pa.array(c, pa.int64()) for c in found], names=names)

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(tile, schema)


#: lists has a bit for each list that an entry is of.
_ENTRY = "query long, vec_id long, lists long, score long"


def _entries(queries: np.ndarray, ids: np.ndarray, lst: int, scores: np.ndarray):
    return queries, ids, np.full(len(ids), 1 << lst), scores


def named(table: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, vec_id, lists, score): the k best of each list."""

    def run(ids, x, asked, q, _, lst):
        scores = products(q, x)
        scores[asked[:, None] == ids[None, :]] = -2 * MOST
        k_here = min(k, len(ids))
        best = np.argpartition(-scores, k_here - 1, axis=1)[:, :k_here]
        own = np.take_along_axis(scores, best, axis=1).ravel()
        keep = own > -2 * MOST
        return _entries(np.repeat(asked, k_here)[keep], ids[best.ravel()][keep], lst, own[keep])

    return best_of(tiles(table, queries, run, _ENTRY), k, "query", "lists").drop("rank")


def sent(table: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, vec_id, lists, score): all entries of each list at its share of the query's cutoff or above."""

    def run(ids, x, asked, q, cutoffs, lst):
        scores = products(q, x)
        i, j = np.nonzero((scores >= ((cutoffs + lst) // LISTS)[:, None]) & (asked[:, None] != ids[None, :]))
        return _entries(asked[i], ids[j], lst, scores[i, j])

    return tiles(table, queries, run, _ENTRY)


def best_of(entries: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best entries of each group with their rank; Spark cuts groups before it shuffles them."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merged(entries: DataFrame) -> DataFrame:
    """(query, vec_id, score, lists): the entries of each vector added up."""
    return entries.groupBy("query", "vec_id").agg(F.sum("score").alias("score"), F.sum("lists").alias("lists"))


def _has(g: int) -> Column:
    return F.col("lists").bitwiseAND(1 << g) != 0


def resolved(partial: DataFrame, table: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, vec_id, score): partial (query, vec_id, score, lists) with the scores of the missing lists looked up."""

    def run(batches):
        for batch in batches:
            dims, lst = (batch.column(c).to_numpy() for c in ("dim", "lst"))
            rows, asked, score = batch.column("part").to_pylist(), batch.column("asked").to_pylist(), np.zeros(batch.num_rows, np.int64)
            for dim, g in {*zip(dims.tolist(), lst.tolist(), strict=True)}:
                at = np.flatnonzero((dims == dim) & (lst == g))
                score[at] = products(matrix([rows[i] for i in at], dim, g), matrix([asked[i] for i in at], dim, g), pairwise=True)
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("vec_id"), pa.array(score)], names=["query", "vec_id", "score"])

    missing = partial.select("query", "vec_id", F.explode(F.array_compact(F.array(*(F.when(~_has(g), g) for g in range(LISTS))))).alias("lst"))
    asked = queries.select(F.col("vec_id").alias("query"), "lst", F.col("part").alias("asked"))
    pairs = missing.join(table.hint("merge"), ["vec_id", "lst"]).join(asked.hint("merge"), ["query", "lst"]).select("query", "vec_id", "dim", "lst", "part", "asked")
    looked_up = pairs.mapInArrow(run, "query long, vec_id long, score long")
    return partial.select("query", "vec_id", "score").unionByName(looked_up).groupBy("query", "vec_id").agg(F.sum("score").alias("score"))


def kth(entries: DataFrame, k: int) -> DataFrame:
    """(query, cutoff): the k-th best score of the queries with k entries at least."""
    return best_of(entries, k, "query").where(F.col("rank") == k).select("query", F.col("score").alias("cutoff"))


def search(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, the k rows of highest score."""
    table = stored(lists(vectors, id_col, vector_col), "vector-lists")
    queries = stored(table.where(F.col("vec_id") % every == 0), "vector-queries")
    asked = lambda cutoffs: queries.join(cutoffs.withColumnRenamed("query", "vec_id"), "vec_id", "left")

    first = merged(named(table, queries.withColumn("cutoff", F.lit(None).cast("long")), k))
    cutoffs = stored(kth(resolved(first, table, queries), k), "cutoffs")

    entries = stored(merged(sent(table, asked(cutoffs))), "sent-entries")
    exact = entries.where(F.col("lists") == (1 << LISTS) - 1)
    raised = kth(exact, k).unionByName(cutoffs).groupBy("query").agg(F.max("cutoff").alias("raised"))
    reach = F.col("score") + sum(F.when(_has(g), 0).otherwise(_share(g)) for g in range(LISTS))
    left = entries.join(cutoffs, "query", "left").join(raised, "query", "left").where(F.col("raised").isNull() | (reach >= F.col("raised")))

    found = best_of(resolved(left.select("query", "vec_id", "score", "lists"), table, queries), k, "query")
    out = stored(found.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "best-vectors")
    discard(table, queries, cutoffs, entries)
    return out


def _share(g: int) -> Column:
    """The most that list g can add to a vector that it hasn't sent: one less than its share, in whole numbers."""
    shared = F.col("cutoff") + g
    return F.call_function("div", shared - F.pmod(shared, F.lit(LISTS)), F.lit(LISTS)) - 1


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))
