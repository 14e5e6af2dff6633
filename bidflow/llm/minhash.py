"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is that of its distinct shingles; its sketch holds the ``k`` smallest hashes.
Documents of equal sets form one class, so exact copies cost one sketch. Inverted lists of
retained values generate candidates: a pair of the wanted similarity shares at least ``least(n)``
retained values (up to a chance below one in a million; exactly for sets that fit the sketch), so
it suffices to index the rarest ``k - least + 1`` values of each class, and passages or lines that
very many documents share stay out of the index. Each list is compared with one hub at first, the
member whose values are the most common; a pair is confirmed on its full sets after the sketch of
the union has let it pass. Connected components of these links leave only the pairs of a list that
lie in different components. Those outside a list's largest component are compared with all its
members, block by block on full sets in tasks of bounded size, which return links that span what
they found and never pairs. Connectivity is thus that of all pairs.

Edge cases: documents without words link with nothing and are their own component; rows with a
null id link with nothing, have a null component and are kept; repeated ids are one node of the
link graph; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidflow.llm.common import compressed, read, rows, stored, uncompressed
from bidflow.llm.graph import components
from bidflow.llm.shingles import shingle_set

K = 32
WORDS = 5
PERCENT = 75
#: Hashes in a block of sets that a task compares with another.
BLOCK_HASHES = 1 << 20
#: Sets in such a block, so that a task's table of pairs is bounded too, however short the texts.
BLOCK_SETS = 2048


def sketches(docs: DataFrame, k: int, words: int) -> DataFrame:
    """doc_id, n (set size), key (of the whole set), sketch (its k smallest hashes)."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(text, words) for (text,) in rows([batch], "text")]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            small = [s[:k].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(small, pa.list_(pa.int64()))], names=["doc_id", "n", "key", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, key binary, sketch array<long>")


def least_shared(n, k: int, percent: int):
    """Retained values that a set of n shingles shares with any set it is linked to (Column).

    Sets up to k: 0.6 n at 75 percent, from the sizes alone. Larger ones: the lower tail of a
    binomial count of k draws at that similarity, below one in a million.
    """
    similar = percent / 100
    tail = max(1, int(k * similar - 5.3 * (k * similar * (1 - similar)) ** 0.5))
    return F.when(n <= k, F.ceil(n * (0.8 * similar))).otherwise(F.lit(tail))


def candidates_pass(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb, sa, sb) whose sizes and union sketch allow the similarity."""
    similar = percent / 100
    tail = max(1, int(k * similar - 5.3 * (k * similar * (1 - similar)) ** 0.5))

    def run(batches):
        for batch in batches:
            keep = []
            for na, nb, sa, sb in zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("sa"), batch.column("sb")):
                x = sa.values.to_numpy(zero_copy_only=False).view(np.uint64)
                y = sb.values.to_numpy(zero_copy_only=False).view(np.uint64)
                union = np.union1d(x, y)
                both = np.intersect1d(x, y, assume_unique=True)
                if na <= k and nb <= k:
                    keep.append(100 * len(both) >= percent * len(union))
                elif len(union) < k:
                    keep.append(True)
                else:
                    keep.append(int((both <= union[k - 1]).sum()) >= tail)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sized = pairs.where((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))
    return sized.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in rows([batch], "xa", "xb"):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c: sets.select(F.col("id").alias(c), F.col("hashes").alias(f"x{c}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def spanning(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Pairs (k, l) that connect what the links left-right of n nodes connect, at most one a node."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            break
    moved = np.flatnonzero(root != np.arange(n))
    return np.stack([root[moved], moved], 1)


def similar_in(ids: np.ndarray, parts: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Links that span all pairs of one side with the other that differ in part and are similar."""
    x, y = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    size = np.array([len(s) for s in sets])
    both = np.zeros((len(x), len(y)), np.float32)
    if len(x) and len(y):
        flat = [np.concatenate([sets[k] for k in side.tolist()]) for side in (x, y)]
        owner = [np.repeat(np.arange(len(side)), size[side]) for side in (x, y)]
        found = [np.unique(f, return_index=True, return_counts=True) for f in flat]
        common, i, j = np.intersect1d(found[0][0], found[1][0], assume_unique=True, return_indices=True)
        # A hash that one document alone has tells nothing, though the document may stand on both sides.
        first = [ids[side][o[u[1][k]]] for side, o, u, k in zip((x, y), owner, found, (i, j))]
        common = common[(found[0][2][i] > 1) | (found[1][2][j] > 1) | (first[0] != first[1])]
        columns = []
        for f, o in zip(flat, owner):
            at = np.searchsorted(common, f)
            at[at == len(common)] = 0
            here = common[at] == f if len(common) else np.zeros(len(f), bool)
            order = np.argsort(at[here], kind="stable")
            columns.append((at[here][order], o[here][order]))
        for low in range(0, len(common), 4096):  # the product of the membership matrices, a strip at a time
            strips = []
            for (at, o), n in zip(columns, (len(x), len(y))):
                i, j = np.searchsorted(at, [low, low + 4096])
                strip = np.zeros((n, min(4096, len(common) - low)), np.float32)
                strip[o[i:j], at[i:j] - low] = 1
                strips.append(strip)
            both += strips[0] @ strips[1].T
    union = size[x][:, None] + size[y][None, :] - both
    a, b = np.nonzero((100 * both >= percent * union) & (parts[x][:, None] != parts[y][None, :]))
    return ids[spanning(x[a], y[b], len(ids))]


def compared(rows_: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of rows (task, side, id, part, hashes) that lie sorted by task; a task's rows fit a worker."""

    def links(table: pa.Table) -> pa.RecordBatch:
        task = table.column("task").to_numpy()
        edges = np.flatnonzero(np.r_[True, task[1:] != task[:-1], True])
        ids, parts, sides = (table.column(c).to_numpy() for c in ("id", "part", "side"))
        out = [np.zeros((0, 2), np.int64)]
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            sets = [np.frombuffer(h, np.uint64) for h in table.column("hashes").slice(i, j - i).to_pylist()]
            out.append(similar_in(ids[i:j], parts[i:j], sides[i:j], sets, percent))
        found = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # of the last task, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column("task").to_numpy()
            others = np.flatnonzero(task != task[-1])
            whole = int(others[-1]) + 1 if len(others) else 0
            if whole or (held and held[-1].column("task")[0] != batch.column("task")[0]):
                yield links(pa.Table.from_batches([*held, batch.slice(0, whole)]))
                held = []
            held.append(batch.slice(whole))
        if held:
            yield links(pa.Table.from_batches(held))

    return rows_.mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id and full set (binary) of the documents in wanted (id).

    Texts meet the ids compressed, in the same plan at every size: wanted grows with the documents.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shingle_set(t, words).tobytes() for t in uncompressed(batch)], pa.binary())], names=["id", "hashes"])

    texts = compressed(docs.select(F.col("doc_id").alias("id"), "text"))
    # Of several texts with one id, one stands for the id.
    return texts.join(wanted.hint("merge"), "id", "left_semi").dropDuplicates(["id"]).mapInArrow(run, "id long, hashes binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = stored(sketches(docs, k, words), "sketches")
    classes = stored(
        table.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), F.min_by("sketch", "doc_id").alias("sketch")),
        "classes",
    )
    postings = classes.select("id", "n", F.explode("sketch").alias("value"))
    # Stored, so that the joins read both sides by shuffle and Spark can split a hot value.
    shared = stored(postings.groupBy("value").agg(F.count("*").alias("many")).where("many > 1"), "shared-values")
    kept = F.least(F.col("n"), F.lit(k))
    lists = (
        postings.join(shared, "value")
        .groupBy("id", "n")
        .agg(F.sort_array(F.collect_list(F.struct("many", "value"))).alias("found"), F.sum("many").alias("weight"))  # at most k
        # Values that no other class has are the rarest: they take their part of the prefix.
        .withColumn("use", kept - least_shared(F.col("n"), k, percent) + 1 - (kept - F.size("found")))
        .where("use > 0")
        .select("id", "n", "weight", F.explode(F.slice("found", F.lit(1), F.col("use").cast("int"))).alias("x"))
        .select("id", "n", "weight", F.col("x.value").alias("value"))
    )
    lists = stored(lists, "lists")
    sketch_of = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    hubs = stored(lists.groupBy("value").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("a"), F.count("*").alias("many")).where("many > 1").select("value", "a"), "hubs")
    pairs = lists.join(hubs, "value").where("a <> id").select("a", F.col("id").alias("b")).distinct()
    passed = stored(candidates_pass(pairs.join(sketch_of("b"), "b").join(sketch_of("a"), "a"), k, percent), "candidates")
    # Of both rounds: all that share a value.
    sets = stored(full_sets(docs, lists.join(hubs, "value", "left_semi").select("id").distinct(), words), "sets")
    found = stored(confirmed(passed, sets, percent), "links")
    part = components(found, "hub-components")

    # What is left: pairs of one list in different components, at least one of them outside the list's largest.
    marked = stored(lists.join(part.withColumnRenamed("node", "id"), "id", "left").select("id", "n", "value", F.coalesce("component", "id").alias("part")), "marked")
    sizes = marked.groupBy("value", "part").agg(F.count("*").alias("many")).groupBy("value").agg(F.max_by("part", F.struct("many", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    mixed = marked.join(stored(sizes.select("value", "main"), "mixed-lists"), "value")
    # Lists of one main component are one task family, so that a pair of several lists is compared once.
    members = stored(mixed.groupBy("main", "id", "n", "part").agg(F.lit(1).alias("one")).drop("one"), "members")
    rest = members.where("part <> main")
    blocks = lambda df, name: df.groupBy("main").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_HASHES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias(name))
    counts = stored(blocks(rest, "nx").join(blocks(members, "ny"), "main"), "blocks")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fields = ["main", "id", "part", "hashes", "side", "i", "j"]
    left = rest.join(counts, "main").withColumns({"side": F.lit(0), "i": own("nx")}).withColumn("j", every("ny"))
    right = members.join(counts, "main").withColumns({"side": F.lit(1), "j": own("ny")}).withColumn("i", every("nx"))
    both = left.join(sets, "id").select(fields).unionByName(right.join(sets, "id").select(fields))
    tasks = both.select(F.xxhash64("main", "i", "j").alias("task"), "side", "id", "part", "hashes").repartition("task").sortWithinPartitions("task")
    part = components(found.unionByName(stored(compared(tasks, percent), "more-links")), "near-components")

    mine = classes.select("key", F.col("id").alias("node")).join(part, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    joined = table.select("doc_id", "n", "key").join(mine, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op4_bottomk_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
