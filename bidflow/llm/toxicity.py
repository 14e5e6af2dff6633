"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Examples are a bounded sample of labelled documents (``per_class`` of each label, those with the
smallest hashes, whatever their length; exact copies of one label count as one), never those that are held out. All terms of the examples
make the vocabulary; document frequencies come from all documents. A term's weight is its TF-IDF
times a factor of 1 or more that grows with its chi-square with the label, so that terms that tell
the labels apart count for more and none is left out. The examples' unit vectors stand in an inverted
index. Postings of rare terms are added in full; those of frequent terms are cut into blocks with the
largest weight of each term in each block. A document visits blocks by falling upper bound and
stops when no other block can reach its k-th similarity, so its neighbours are exact; all that
tie with the k-th count. Similarity-weighted votes, weighted back to the labels' shares among
all labelled documents, are calibrated by isotonic regression on leave-one-out votes.

Edge cases: null and empty texts have no terms and take the share of label 1 among the examples
without terms; labels other than 0 and 1 and null labels are ignored, a text labelled both ways
counts as label 1 if at least half of its labels are; without labels every score is 0. Repeated
rows are scored alike. Input columns are kept; the names ``score``, ``predicted``, ``neighbours``
and ``terms`` are replaced if they occur; ``terms`` names the text's terms with a strong tie to a label.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidflow.llm.common import discard, read, rows, stored

PER_CLASS = 4096
NEIGHBOURS = 15
#: Nearest examples that a result names.
EVIDENCE = 3
THRESHOLD = 0.3
BLOCK = 128
#: Texts that are scored together.
AT_ONCE = 64
#: Rows that a task takes from Arrow at a time.
ROWS = 1024
#: A term in more than this share of the examples' vectors is frequent.
FREQUENT = 1 / 16
#: Chi-square up to which a term's tie to the label may be chance (p = 0.05): its factor is 1, beyond it chi-square / CHANCE.
CHANCE = 3.84
#: A result names terms from this chi-square (p below 1e-8) and ratio of the odds in the two labels, either way.
CHI_SQUARE = 33.0
ODDS = 4.0
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def numbers_of(text: str | None, vocabulary: dict[str, int]) -> np.ndarray:
    """The number of each word of the text that is in the vocabulary."""
    found = words(text)
    numbers = np.fromiter(map(vocabulary.get, found, repeat(-1)), np.int64, len(found))
    return numbers[numbers >= 0]


def held_out(doc_id="doc_id"):
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    """Block-max index of the examples' distinct vectors, which are maps from term number to term frequency."""

    vocabulary: dict[str, int]
    idf: np.ndarray  # times the term's factor
    strong: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # terms that results name
    count: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))  # examples of each vector by label
    ids: list = field(default_factory=list)  # of each vector's examples, those of label 1 first
    share: np.ndarray = field(default_factory=lambda: np.ones(2))  # labelled documents that an example of each label stands for
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of each term's postings
    docs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # postings by term: vectors ascending
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # and their unit weights
    raw: np.ndarray = field(default_factory=lambda: np.zeros(0))  # calibration
    calibrated: np.ndarray = field(default_factory=lambda: np.zeros(0))
    empty_score: float = 0.0
    frequent: tuple | None = None  # made where it is used: number of each frequent term or -1, block x term x vector, term x block maxima

    def __getstate__(self):
        return self.__dict__ | {"frequent": None}

    def unit(self, of: np.ndarray, terms: np.ndarray, tf: np.ndarray, m: int) -> np.ndarray:
        """Weights of the terms of m vectors; ``of`` tells which one each term is of."""
        w = (1 + np.log(tf)) * self.idf[terms]
        return w / np.sqrt(np.bincount(of, w * w, m))[of]

    @property
    def postings(self):
        """By term: vectors ascending, unit weights, their blocks."""
        for a, b in zip(self.starts[:-1], self.starts[1:]):
            yield self.docs[a:b], self.weights[a:b], self.docs[a:b] // BLOCK

    def build(self, vectors: list[np.ndarray]) -> None:
        of, terms, tf = flat(vectors)
        weights = self.unit(of, terms, tf, len(vectors))
        order = np.argsort(terms, kind="stable")
        self.docs, self.weights = of[order].astype(np.int32), weights[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(self.idf)))])
        self.frequent = None

    def dense(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.frequent is None:
            many = np.diff(self.starts)
            chosen = np.flatnonzero(many > max(1, FREQUENT * len(self.count)))
            number = np.full(len(many), -1)
            number[chosen] = np.arange(len(chosen))
            blocks = -(-len(self.count) // BLOCK)
            table = np.zeros((blocks, len(chosen), BLOCK))
            for f, t in enumerate(chosen):
                docs = self.docs[self.starts[t] : self.starts[t + 1]]
                table[docs // BLOCK, f, docs % BLOCK] = self.weights[self.starts[t] : self.starts[t + 1]]
            self.frequent = number, table, np.ascontiguousarray(table.max(2, initial=0).T)
        return self.frequent

    def nearest(self, of: np.ndarray, terms: np.ndarray, tf: np.ndarray, m: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of m queries: vectors of positive cosine whose examples are among the k nearest or tie with the k-th, the nearest first; cosines."""
        number, table, maxima = self.dense()
        blocks = len(table)
        w = self.unit(of, terms, tf, m)
        f = number[terms]
        often = f >= 0
        q = np.zeros((m, table.shape[1]))
        q[of[often], f[often]] = w[often]
        rare, w, of = terms[~often], w[~often], of[~often]
        many = self.starts[rare + 1] - self.starts[rare]
        at = np.arange(many.sum()) + np.repeat(self.starts[rare] - np.cumsum(many) + many, many)
        width = blocks * BLOCK
        total = np.bincount(np.repeat(of * width, many) + self.docs[at], np.repeat(w, many) * self.weights[at], m * width).astype(float).reshape(m, blocks, BLOCK)
        # Per block, the most that frequent terms can add to what rare ones gave.
        bounds = total.max(2, initial=0) + q @ maxima
        order = np.argsort(-bounds, axis=1)
        kth, done, each = np.zeros(m), np.zeros((m, blocks), bool), np.arange(m)[:, None]
        for low, high in ((0, 4), (4, 16), (16, blocks)):  # by falling bound; what can't reach the k-th so far is left out
            wanted = np.zeros((m, blocks), bool)
            wanted[each, order[:, low:high]] = True
            wanted &= (bounds > 0) & (bounds >= kth[:, None] - 1e-9)
            for b in np.flatnonzero(wanted.any(0)).tolist():
                here = np.flatnonzero(wanted[:, b])
                total[here, b] += q[here] @ table[b]
            done |= wanted
            # A vector stands for one example at least: the k-th vector is no nearer than the k-th example.
            first = order[:, :high]
            if low == high or high >= blocks or k > first.shape[1] * BLOCK:
                continue
            known = np.where(done[each, first][:, :, None], total[each, first], 0).reshape(m, -1)
            kth = np.maximum(kth, np.partition(known, known.shape[1] - k, axis=1)[:, known.shape[1] - k])
        known = total.reshape(m, width)
        hidden = ~done
        if hidden.any():
            total[hidden] = 0
        examples, out = self.count.sum(1), []
        for i in range(m):
            docs = np.flatnonzero((known[i] > 0) & (known[i] >= kth[i] - 1e-9))
            docs = docs[np.lexsort((docs, -known[i, docs]))]
            enough = np.searchsorted(np.cumsum(examples[docs]), k)
            if enough < len(docs):
                docs = docs[known[i, docs] >= known[i, docs[enough]] - 1e-9]
            out.append((docs, known[i, docs]))
        return out

    def vote(self, docs: np.ndarray, sims: np.ndarray, count: np.ndarray) -> float | None:
        w = sims[:, None] * count * self.share
        return float(w[:, 1].sum() / w.sum()) if w.sum() > 0 else None

    def left_out(self, numbers: list[int], vectors: list[np.ndarray], k: int) -> list[tuple[float, int, float]]:
        """(vote of its other neighbours, label, weight) of the examples of the vectors with these numbers."""
        votes = []
        for low in range(0, len(vectors), AT_ONCE):
            some = vectors[low : low + AT_ONCE]
            for i, (docs, sims) in zip(numbers[low:], self.nearest(*flat(some), len(some), k + 1)):
                for y in (0, 1):
                    if n := self.count[i, y]:
                        count = self.count[docs]
                        count[docs == i, y] -= 1
                        if (v := self.vote(docs, sims, count)) is not None:
                            votes.append((v, y, n * self.share[y]))
        return votes

    def calibrate(self, votes: list[tuple[float, int, float]]) -> None:
        """Isotonic regression of the labels on the votes."""
        merged: list[list] = []  # votes, weighted label, weight
        for v, y, w in sorted(votes):
            if merged and merged[-1][0][-1] == v:
                merged[-1][1] += w * y
                merged[-1][2] += w
            else:
                merged.append([[v], y * w, w])
            while len(merged) > 1 and merged[-2][1] / merged[-2][2] >= merged[-1][1] / merged[-1][2]:
                last = merged.pop()
                merged[-1] = [merged[-1][0] + last[0], merged[-1][1] + last[1], merged[-1][2] + last[2]]
        # Between the steps' middles scores grow evenly, so that votes that differ keep their order.
        self.raw = np.array([sum(m[0]) / len(m[0]) for m in merged])
        self.calibrated = np.array([m[1] / m[2] for m in merged])

    def score(self, texts: list, k: int, found: dict[bytes, tuple]) -> list[tuple[float, list, list]]:
        """For each text: the score, the ids of the nearest examples, and the strong terms; found holds those of texts seen lately."""
        keys = [xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass")) for text in texts]
        if len(found) > 20_000:
            found.clear()
        new = [*{key: text for key, text in zip(keys, texts) if key not in found}.items()]
        for low in range(0, len(new), AT_ONCE):
            some = new[low : low + AT_ONCE]
            lists = [numbers_of(text, self.vocabulary) for _, text in some]
            of = np.repeat(np.arange(len(some)), [len(x) for x in lists])
            at, tf = np.unique(of * max(1, len(self.idf)) + np.concatenate(lists), return_counts=True)
            of, terms = np.divmod(at, max(1, len(self.idf)))
            ends = np.searchsorted(of, np.arange(len(some) + 1))
            near = self.nearest(of, terms, tf, len(some), k) if len(self.count) else [(np.zeros(0, np.int64), np.zeros(0))] * len(some)
            for i, ((key, _), (docs, sims)) in enumerate(zip(some, near)):
                mine = terms[ends[i] : ends[i + 1]]
                raw = self.vote(docs, sims, self.count[docs])
                score = self.empty_score if raw is None else float(np.interp(raw, self.raw, self.calibrated)) if len(self.raw) else raw
                found[key] = score, [x for d in docs[:EVIDENCE].tolist() for x in self.ids[d]][:EVIDENCE], mine[self.strong[mine]].tolist()
        return [found[key] for key in keys]


def flat(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which vector, term and frequency of vectors that are rows (term, frequency)."""
    pairs = np.concatenate(vectors)
    return np.repeat(np.arange(len(vectors)), [len(v) for v in vectors]), pairs[:, 0].astype(np.int64), pairs[:, 1]


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, label, doc_id) of at most per_class examples of each label, and how many there would be without that bound.

    The order is that of a hash of the whole text, which doesn't follow its length.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    texts = docs.where(F.length("text") > 0).select("doc_id", "text", F.xxhash64("text").alias("key"))
    # Only ids and keys are shuffled to meet the labels.
    marked = stored(texts.select("doc_id", "key").join(known, "doc_id").groupBy("key", "label").agg(F.min("doc_id").alias("doc_id")), "labelled")
    sizes = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = marked.where("label = 1").orderBy("key").limit(per_class).unionByName(marked.where("label = 0").orderBy("key").limit(per_class))
    rows_ = [tuple(r) for r in chosen.select("key", "doc_id", "label").collect()]  # at most 2 x per_class
    discard(marked)
    chosen = docs.sparkSession.createDataFrame(rows_, "key long, doc_id long, label int")
    picked = texts.join(F.broadcast(chosen), ["doc_id", "key"])
    return picked.dropDuplicates(["key", "label"]).select("text", "label", "doc_id"), sizes


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, k: int = NEIGHBOURS) -> Model:
    """A model of the labelled documents (columns doc_id, text; doc_id, toxic)."""
    docs = docs.select("doc_id", "text")
    examples, sizes = sample(docs, labels.select("doc_id", "toxic"), per_class)
    examples = stored(examples, "examples")
    n = Counter({r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()})

    def differing(batches):
        seen = {0: Counter(), 1: Counter()}
        for text, label in rows(batches, "text", "label"):
            seen[label].update(set(words(text)))
        terms = [*(seen[0].keys() | seen[1].keys())]
        yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "n0": pa.array([seen[0][t] for t in terms], pa.int64()), "n1": pa.array([seen[1][t] for t in terms], pa.int64())})

    counted = examples.mapInArrow(differing, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total = max(1, n[0] + n[1])
    both = F.col("n0") + F.col("n1")
    chi = total * (F.col("n1") * n[0] - F.col("n0") * n[1]) ** 2 / (n[0] * n[1] * both * (total - both)) if n[0] and n[1] else F.lit(0.0)
    odds = (F.col("n1") + 0.5) * (n[0] - F.col("n0") + 0.5) / ((F.col("n0") + 0.5) * (n[1] - F.col("n1") + 0.5))
    chi = F.when(both < total, chi).otherwise(0.0)
    strong = (both >= 5) & (chi >= CHI_SQUARE) & ((odds >= ODDS) | (odds <= 1 / ODDS))
    terms = counted.select("term", F.greatest(F.lit(1.0), chi / CHANCE).alias("factor"), strong.alias("strong")).toArrow().sort_by("term")  # as many as the sample has at most
    chosen = terms["term"].to_pylist()
    vocabulary = {t: i for i, t in enumerate(chosen)}

    def frequencies(batches):
        seen, many = np.zeros(len(vocabulary), np.int64), 0
        for (text,) in rows(batches, "text"):
            many += 1
            seen[numbers_of(text, vocabulary)] += 1  # once, however often the term is there
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"term": pa.array([-1, *found.tolist()], pa.int32()), "n": pa.array([many, *seen[found].tolist()], pa.int64())})

    df, every = np.zeros(len(chosen)), 0
    if chosen:
        seen = docs.select("text").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # as many as terms
        term, n_docs = seen["term"].to_numpy(), seen["n"].to_numpy()
        df[term[term >= 0]], every = n_docs[term >= 0], int(n_docs[term < 0].sum())
    idf = (np.log((1 + every) / (1 + df)) + 1) * terms["factor"].to_numpy()
    model = Model(vocabulary, idf, terms["strong"].to_numpy())

    def vectors(batches):
        for text, label, doc in rows(batches, "text", "label", "doc_id"):
            counts = np.stack(np.unique(numbers_of(text, vocabulary), return_counts=True), 1).astype(np.int32).tobytes()
            yield pa.RecordBatch.from_pydict({"label": pa.array([label], pa.int32()), "doc_id": pa.array([doc], pa.int64()), "counts": pa.array([counts], pa.binary())})

    table = stored(examples.mapInArrow(vectors, "label int, doc_id long, counts binary"), "example-vectors")
    found = table.toArrow()  # at most 2 x per_class
    discard(examples)
    alike: dict[bytes, list[list]] = {}
    for label, doc, counts in zip(*(found[c].to_pylist() for c in ("label", "doc_id", "counts"))):
        alike.setdefault(counts, [[], []])[label].append(doc)
    model.share = np.array([sizes.get(y, 0) / max(1, n[y]) for y in (0, 1)])
    if b"" in alike:
        w = np.array([len(x) for x in alike.pop(b"")]) * model.share
        model.empty_score = float(w[1] / w.sum())
    pairs = {v: np.frombuffer(v, np.int32).reshape(-1, 2) for v in alike}
    many = np.bincount(np.concatenate([x[:, 0] for x in pairs.values()]), minlength=len(chosen)) if pairs else None
    # Vectors with the same most frequent terms (of a language, a topic) share blocks.
    vectors = sorted(alike, key=lambda v: (sorted(zip(-many[pairs[v][:, 0]], pairs[v][:, 0]))[:6], v))
    model.count = np.array([[len(x) for x in alike[v]] for v in vectors], float).reshape(-1, 2)
    model.ids = [(sorted(alike[v][1]) + sorted(alike[v][0]))[:EVIDENCE] for v in vectors]
    if vectors:
        model.build([pairs[v] for v in vectors])

        number = {xxhash.xxh3_128_digest(v): i for i, v in enumerate(vectors)}
        bare = replace(model, vocabulary={}, ids=[])

        def votes(batches):
            for batch in batches:
                mine = batch.column("counts").to_pylist()
                found = bare.left_out([number[xxhash.xxh3_128_digest(v)] for v in mine], [np.frombuffer(v, np.int32).reshape(-1, 2) for v in mine], k)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [[]] * 3, (pa.float64(), pa.int32(), pa.float64()))], names=["vote", "label", "weight"])

        every = table.where(F.length("counts") > 0).select("counts").distinct().repartition(-(-len(vectors) // 512))
        model.calibrate([tuple(r) for r in every.mapInArrow(votes, "vote double, label int, weight double").collect()])  # two a vector at most
    discard(table)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", k: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score, predicted, the nearest examples' ids and the terms that were found."""
    added = T.StructType().add("score", T.DoubleType()).add("predicted", T.IntegerType()).add("neighbours", T.ArrayType(T.LongType())).add("terms", T.ArrayType(T.StringType()))
    docs = docs.drop(*added.names)
    schema = T.StructType([*docs.schema.fields, *added.fields])
    names = {model.vocabulary[t]: t for t in model.vocabulary if model.strong[model.vocabulary[t]]}

    def run(batches):
        found: dict[bytes, tuple] = {}
        for batch in (whole.slice(low, ROWS) for whole in batches for low in range(0, whole.num_rows, ROWS)):
            results = model.score(batch.column(text_col).to_pylist(), k, found)
            scores = [score for score, _, _ in results]
            near = [examples if score >= threshold else [] for score, examples, _ in results]
            terms = [[names[t] for t in strong] for _, _, strong in results]
            new = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(near, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added.names])

    return docs.mapInArrow(run, schema)


def op10_knn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "neighbours", "terms")
