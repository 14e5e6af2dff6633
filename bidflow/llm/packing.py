"""Pattern packing of tokenised documents by non-negative least squares.

Every document becomes its token ids plus an end id. A document longer than ``max_tokens`` is
cut; its first piece takes the remainder, so that all later pieces are full. The lengths of
all pieces form a histogram of ``max_tokens`` bins, whatever the size of the corpus. Patterns
are multisets of at most three lengths that fill a sequence exactly; non-negative least squares
fits how often to repeat each. The fit is rounded down to whole repeats that the histogram
allows, and what is left is packed best-fit decreasing, length by length.

Only the histogram and the plan (both bounded by ``max_tokens``) reach the driver. Pieces find
their places in parallel: the rank of a piece among those of its length is the number of such
pieces in earlier tasks plus its number within its own task, and the plan maps (length, rank)
to sequence and offset.

Edge cases: a null text is empty (one piece, the end id alone); a null id stays null; repeated
rows are packed once each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidflow.llm.common import read, rows, stored

MAX_TOKENS = 1024
END_ID = 2

@lru_cache(maxsize=2)
def _encoder(name: str) -> "Encoder":
    return Encoder(name)


class Encoder:
    """Token ids of a byte-level vocabulary as little-endian unsigned 32-bit values.

    The ranks of the same vocabulary give the same ids as its tokenizer file, five times as
    fast; a text that spells out a special token goes through the tokenizer itself.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n % most or min(n, most)
    return [(0, first), *((at, most) for at in range(first, n, most))]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


def pieces_of(docs: DataFrame, id_col: str, text_col: str, max_tokens: int, tokenizer: str, end_id: int, keep_ids: bool = False) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in its task."""

    def run(batches):
        encoder, seen = _encoder(tokenizer), Counter()
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        kept: list[tuple] = []

        def out():
            columns = list(zip(*kept)) or [[]] * 8
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank", "ids"][: 7 + keep_ids]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)][: 7 + keep_ids], names)
            kept.clear()
            return batch

        for doc, text in rows(batches, "doc_id", "text"):
            data = encoder.encode(text or "") + end
            for k, (start, length) in enumerate(cut(len(data) // 4, max_tokens)):
                ids = data[4 * start : 4 * (start + length)]
                kept.append((doc, k, start, length, zlib.crc32(ids), part, seen[length], ids if keep_ids else None))
                seen[length] += 1
            if len(kept) >= 20_000:
                yield out()
        yield out()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


def patterns_for(lengths: np.ndarray, most: int) -> np.ndarray:
    """Rows of at most three lengths (0: none) that sum to most and all occur."""
    there = np.zeros(most + 1, bool)
    there[lengths] = True
    found = [np.array([[most, 0, 0]])] if there[most] else []
    half = np.arange(1, most // 2 + 1)
    half = half[there[half] & there[most - half]]
    found.append(np.stack([most - half, half, 0 * half], 1))
    small = np.flatnonzero(there[: most // 3 + 1])
    for c in small[small > 0]:
        b = np.arange(c, (most - c) // 2 + 1)
        a = most - c - b
        ok = there[a] & there[b]
        found.append(np.stack([a[ok], b[ok], np.full(ok.sum(), c)], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|, A the lengths in each pattern; accelerated gradient steps."""
    n, used = len(histogram), patterns > 0
    flat = patterns.ravel()

    def lengths_of(x):
        return np.bincount(flat, weights=np.repeat(x, 3) * used.ravel(), minlength=n)

    def back(r):
        return (r[patterns] * used).sum(1)

    v = np.ones(len(patterns))
    for _ in range(15):  # the largest eigenvalue of A'A
        v = back(lengths_of(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(lengths_of(v))))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(lengths_of(y) - histogram))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def best_fit(histogram: dict[int, int], most: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths of a sequence, how many such sequences)."""
    open_: dict[int, list[list]] = {}
    for length in sorted(histogram, reverse=True):
        n, room = histogram[length], length
        while n and room <= most:
            if not open_.get(room):
                room += 1
                continue
            group = open_[room][-1]
            take = min(n, group[1])
            group[1] -= take
            n -= take
            if not group[1]:
                open_[room].pop()
            open_.setdefault(room - length, []).append([(*group[0], length), take])
            room = max(length, room - length)
        each = most // length
        for many, count in ((each, n // each), (n % each, 1)):
            if many and count:
                open_.setdefault(most - many * length, []).append([(length,) * many, count])
    return [(tuple(g[0]), g[1]) for groups in open_.values() for g in groups]


def plan(histogram: dict[int, int], most: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences to make: (lengths, how many), which together use the histogram up."""
    left = np.zeros(most + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    made = []
    patterns = patterns_for(np.flatnonzero(left), most)
    if len(patterns):
        x = repeats(patterns, left.astype(float))
        for k in np.argsort(-x, kind="stable"):
            whole = int(x[k] + 1e-6)
            if not whole:
                if x[k] < 0.5:
                    break
                whole = 1
            need = Counter(int(v) for v in patterns[k] if v)
            whole = min(whole, *(int(left[v]) // c for v, c in need.items()))
            if whole:
                made.append((tuple(int(v) for v in patterns[k] if v), whole))
                for v, c in need.items():
                    left[v] -= c * whole
    return made + best_fit({int(v): int(left[v]) for v in np.flatnonzero(left)}, most)


def runs_of(sequences: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank."""
    ranks, out, base = Counter(), [], 0
    for lengths, many in sequences:
        at = 0
        for length in lengths:
            out.append((length, ranks[length], base, at))
            ranks[length] += many
            at += length
        base += many
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, tokenizer: str = "byte_bpe_50k", end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and offset that each is packed at.

    keep_ids adds the ids of each piece (binary, little-endian unsigned 32-bit).
    """
    table = stored(pieces_of(docs, id_col, text_col, max_tokens, tokenizer, end_id, keep_ids), "pieces")
    counts = stored(table.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_tokens rows
    runs = runs_of(plan(histogram, max_tokens))
    keys = (runs[:, 0] << 44) + runs[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            columns = {c: batch.column(c) for c in names} | {"sequence_id": pa.array(runs[at, 2] + rank - runs[at, 1]), "offset": pa.array(runs[at, 3])}
            yield pa.RecordBatch.from_pydict(columns)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = table.join(ahead, ["part", "length"]).select(*names, (F.col("ahead") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "") + ", sequence_id long, offset long")


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
