"""Ranked lexical search over tries of frequency-ordered term vectors, by branch-and-bound.

Documents are restricted to the terms that items hold. A task puts its documents into FP-trees: terms
are ordered from the most to the least frequent, and documents whose vectors start alike share a path
(paths that don't branch are one edge, and equal vectors one leaf). A node keeps, for each term below or
on the way to it, the largest tf of its subtree, and the subtree's least m. The score of a document grows with tf and
falls with m, so a node's maxima give a bound for all its documents. Each item goes down the tree depth
first, best bound first, and leaves out the subtrees whose bound is below the score of its
``k``-th best document so far. Items go together: a node's bound is one product of its maxima with the
weights of the items that are still alive there. Bests are carried on from tree to tree; those of all
tasks are ranked in Spark.

Scores are whole numbers: w = floor(1000 ln((2N+2)/(2df+1))), m = 75 + (25 n N) div L, and the score sums
w * ((1000000000 tf) div (1000 tf + 12 m)) over an item's terms, repeats included. The bound of a leaf is
the score itself.

Texts are read once per block of items; ``ITEM_BYTES`` bounds the texts of a block, hence the vocabulary
that tasks get (items are dealt to blocks by a hash; one with a longer text makes a large block). A tree holds ``TREE_TERMS`` terms of documents, or one document.

Edge cases: a null or empty text has no term and is in no result; N, L and df count all documents with a
term, those with a null id too, which rank behind the others of the same score; repeated rows of
documents are documents of their own; an item that occurs again with its text counts once, with another
text it is an item of its own under the same id; items without a term, and items none of whose terms
occurs, have no row; texts of any length are read whole, one at a time; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidflow.llm.common import discard, read, rows, stored

K = 20
ITEM_BYTES = 2 << 20
#: Items that go down a tree together.
ABREAST = 256
CELLS = 1 << 22
TREE_TERMS = 400_000
#: Bytes of a term: 0-9, a-z and all beyond ASCII; A-Z become lower case, all else is blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def item_blocks(items: DataFrame, id_col: str, text_col: str):
    """Lists of (item id, Counter of terms), each of items with ITEM_BYTES of text at most if hashes deal evenly."""
    asked = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text")).where("item_id is not null and text is not null").distinct()
    total = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // ITEM_BYTES)) if total > ITEM_BYTES else 1
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        found = [(i, c) for i, text in part.collect() if (c := Counter(terms(bytes(text))))]
        if found:
            yield found


def restricted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs): numbers and occurrences of the terms of a document that items hold; n counts all its terms."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        ours = known.value
        for batch in batches:
            ids, sizes, numbers, tfs = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if words := terms(text.as_py()):
                    counts = Counter(words)
                    found = [(ours[t], c) for t, c in counts.items() if t in ours]
                    ids.append(doc_id)
                    sizes.append(len(words))
                    numbers.append(np.array([t for t, _ in found], "<i4").tobytes())
                    tfs.append(np.array([c for _, c in found], "<i8" if len(words) >= 1 << 31 else "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(numbers, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "terms", "tfs"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return named.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def frequencies(table: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary occurs: added up within tasks, then by term."""

    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], names=["term", "df"])

    found = table.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # one row per term of the block
    out = np.zeros(size, np.int64)
    for r in found:
        out[r["term"]] = r["df"]
    return out


class Tree:
    """An FP-tree over documents: (id, m, ranks ascending from the most frequent term, tfs)."""

    def __init__(self, docs: list):
        docs.sort(key=lambda d: d[2])
        ranks = [np.frombuffer(d[2], ">u4").astype(np.int64) for d in docs]
        same = [a[2] == b[2] for a, b in zip(docs, docs[1:])]
        starts = [0, *(i + 1 for i, s in enumerate(same) if not s)]
        ends = [*starts[1:], len(docs)]
        #: Of a leaf: (ids, ms, tfs) of its documents.
        self.leaves, maxima, least = [], [], []
        for i, j in zip(starts, ends):
            tfs = np.stack([d[3] for d in docs[i:j]])
            ms = np.array([d[1] for d in docs[i:j]])
            self.leaves.append(([d[0] for d in docs[i:j]], ms, tfs))
            maxima.append((ranks[i], tfs.max(axis=0)))
            least.append(ms.min())
        self.children: dict[int, list[int]] = {}
        self.maxima, self.least = maxima, least
        vectors = [ranks[i] for i in starts]
        shared = []
        for a, b in zip(vectors, vectors[1:]):
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            shared.append(int(differ[0]) if len(differ) else n)
        self.root = self._build(shared)

    def _join(self, nodes: list[int]) -> int:
        """A node above others: the maxima of each term over all of them."""
        ranks = np.concatenate([self.maxima[n][0] for n in nodes])
        tfs = np.concatenate([self.maxima[n][1] for n in nodes])
        order = np.argsort(ranks, kind="stable")
        ranks, tfs = ranks[order], tfs[order]
        first = np.flatnonzero(np.diff(ranks, prepend=-1))
        self.maxima.append((ranks[first], np.maximum.reduceat(tfs, first) if len(first) else tfs))
        self.least.append(min(self.least[n] for n in nodes))
        self.children[len(self.maxima) - 1] = nodes
        return len(self.maxima) - 1

    def _build(self, shared: list[int]) -> int:
        """The root, from how many leading terms each leaf shares with the one before: nodes are closed as paths part."""
        open_: list[tuple[int, list[int]]] = [(0, [])]  # depth and children of the nodes on the path
        for leaf in range(len(self.leaves)):
            depth = shared[leaf] if leaf < len(shared) else 0  # what goes on to the next leaf
            if depth > open_[-1][0]:
                open_.append((depth, []))
            open_[-1][1].append(leaf)
            while depth < open_[-1][0]:
                closed = self._join(open_.pop()[1])
                if depth > open_[-1][0]:
                    open_.append((depth, []))
                open_[-1][1].append(closed)
        return self._join(open_[0][1])


class Bests:
    """The k best documents of each item; score of the last of them, below 1 while there are fewer."""

    def __init__(self, items: int, k: int):
        self.k, self.held, self.last = k, [[] for _ in range(items)], np.zeros(items, np.int64)

    def part(self, start: int, items: int) -> Bests:
        """The same bests, of some items alone."""
        out = Bests(0, self.k)
        out.held, out.last = self.held[start : start + items], self.last[start : start + items]
        return out

    def add(self, item: int, score: int, doc_id: int | None):
        heap, entry = self.held[item], (score, (0, -doc_id) if doc_id is not None else (-1, 0))
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.last[item] = heap[0][0]


def descend(tree: Tree, weights: np.ndarray, items: np.ndarray, bests: Bests) -> int:
    """Search a tree for some items (columns of weights); how many nodes were looked at."""

    def bounds(ranks, tfs, m, alive):
        return (1_000_000_000 * tfs // (1000 * tfs + 12 * m)) @ weights[ranks[:, None], alive]

    stack, seen = [(tree.root, items, None)], 0
    while stack:
        node, alive, bound = stack.pop()
        if bound is not None:
            good = bound >= np.maximum(bests.last[alive], 1)
            alive = alive[good]
            if not len(alive):
                continue
        if node < len(tree.leaves):
            ids, ms, tfs = tree.leaves[node]
            held = np.flatnonzero((weights[tree.maxima[node][0][:, None], alive] != 0).any(axis=1))  # terms of no item alive add nothing
            ranks, tfs = tree.maxima[node][0][held], tfs[:, held]
            alike: dict[tuple, list[int]] = {}
            for i in range(len(ids)):
                alike.setdefault((int(ms[i]), tfs[i].tobytes()), []).append(i)
            for own in alike.values():
                scores = bounds(ranks, tfs[own[0]], ms[own[0]], alive)
                own = heapq.nsmallest(bests.k, own, key=lambda i: (ids[i] is None, ids[i] or 0))
                for at in np.flatnonzero(scores >= np.maximum(bests.last[alive], 1)):
                    for i in own:
                        bests.add(int(alive[at]), int(scores[at]), ids[i])
            continue
        below = [(n, bounds(*tree.maxima[n], tree.least[n], alive)) for n in tree.children[node]]
        seen += len(below)
        below.sort(key=lambda x: int(x[1].max()))  # the last goes first
        stack += [(n, alive, b) for n, b in below]
    return seen


def abreast(weights: list):
    """(start, end) of the items that go down a tree together: ABREAST at most, and CELLS weights if they share no term, or one item."""
    start = held = 0
    for end, (ranks, _) in enumerate(weights):
        if end > start and (end - start == ABREAST or (end - start + 1) * (held + len(ranks)) > CELLS):
            yield start, end
            start, held = end, 0
        held += len(ranks)
    yield start, len(weights)


def searched(table: DataFrame, order: np.ndarray, weights: list, total: int, words: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best of each item within each task. order: rank of each term; weights: (rank, weight) lists of items."""
    shared = table.sparkSession.sparkContext.broadcast((order, weights))

    def run(batches):
        order, weights = shared.value
        bests, held, size = Bests(len(weights), k), [], 0
        groups = list(abreast(weights))

        def flush():
            for start, end in groups:
                some = weights[start:end]  # columns of the items that go together, over the terms that they hold
                ranks = np.unique(np.concatenate([r for r, _ in some]))
                if narrow := [d for x in held if (d := _narrowed(x, ranks))[2]]:
                    dense = np.zeros((len(ranks), len(some)), np.int64)
                    for i, (r, w) in enumerate(some):
                        dense[np.searchsorted(ranks, r), i] = w
                    descend(Tree(narrow), dense, np.arange(len(some)), bests.part(start, len(some)))
            held.clear()

        for batch in batches:
            for doc_id, n, numbers, tfs in rows([batch], "doc_id", "n", "terms", "tfs"):
                ranks = order[np.frombuffer(numbers, "<i4")]
                by = np.argsort(ranks)
                counts = np.frombuffer(tfs, "<i4" if len(tfs) == len(numbers) else "<i8").astype(np.int64)
                held.append((doc_id, 75 + 25 * n * total // words, ranks[by].astype(">u4").tobytes(), counts[by]))
                size += len(ranks)
                if size >= TREE_TERMS:
                    flush()
                    size = 0
        flush()
        found = [(i, -e[1][1] if e[1][0] == 0 else None, e[0]) for i, heap in enumerate(bests.held) for e in heap]
        item, doc_id, score = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return table.mapInArrow(run, "item int, doc_id long, score long")


def _narrowed(doc: tuple, ranks: np.ndarray) -> tuple:
    """A document restricted to the terms of some items, numbered among these."""
    own = np.frombuffer(doc[2], ">u4").astype(np.int64)
    at = np.searchsorted(ranks, own)
    held = np.flatnonzero(ranks[np.minimum(at, len(ranks) - 1)] == own)
    return doc[0], doc[1], at[held].astype(">u4").tobytes(), doc[3][held]


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: for each item, the k documents of highest score above 0."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in item_blocks(items, item_col, item_text_col):
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, c in block for t in c))}
        table = stored(restricted(docs, vocabulary, id_col, text_col), "restricted-documents")
        df = frequencies(table, len(vocabulary))
        total, words = table.agg(F.count("*"), F.sum("n")).first()
        order = np.empty(len(df), np.int64)
        order[np.argsort(-df, kind="stable")] = np.arange(len(df))
        weight = [math.floor(1000 * math.log((2 * total + 2) / (2 * int(f) + 1))) for f in df]
        weights = [(np.array([order[vocabulary[t]] for t in c]), np.array([n * weight[vocabulary[t]] for t, n in c.items()])) for _, c in block]
        best = searched(table.where(F.length("terms") > 0), order, weights, total, words or 1, k)
        window = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], "item int, item_id long")
        out = out.unionByName(stored(ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked-documents"))
        discard(table)
    return out


def op11_fp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
