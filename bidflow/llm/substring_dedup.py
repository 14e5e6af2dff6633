"""Removal of word runs that occur more than once in the corpus, by growing repeated windows.

A window is ``length`` consecutive words of one document. Lengths double level by level (9, 18, 35
words), and only what repeats at one level is extended to the next, until none is left:

1. Runs of a quarter of the length. Of the runs in a window the one with the least hash is its
   anchor; equal windows have equal anchors, so one run in fourteen stands for all. Anchors that
   occur once drop out, and with them all windows around them.
2. Runs of twice that length that hold a surviving anchor: every window around it holds the run that
   goes on to its right or the one that begins to its left. Runs that occur once drop out likewise.
3. The whole length: a surviving run is extended to both sides over all windows that it stands for.
   A segment that occurs again is covered from end to end. Where segments differ, single windows
   decide, of each repeated segment only for one occurrence.

Words and runs are compared by 64-bit hashes, windows of the whole length by two of them (of the
run within and of all their words). Only anchors and windows are shuffled, and each text at most
twice, compressed.

Edge cases: a null or empty text has no words; documents shorter than a window lose nothing; a
window that repeats within one document counts; windows are judged on the input; repeated rows are
documents of their own (so all their windows repeat); null ids are allowed; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidflow.llm.common import compressed, discard, read, stored, uncompressed
from bidflow.llm.shingles import mixed, run_hashes, word_hashes

LENGTH = 35
#: Words that are handled at a time; longer texts are taken in overlapping parts.
PART = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 - 2)  # 3 modulo 8: differences of its powers keep most bits
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 15)
        _POWERS["up"] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE)])
        _POWERS["down"] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _INVERSE)])
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Prefixes:
    """Hashes of any runs of a sequence of word hashes."""

    def __init__(self, h: np.ndarray):
        up, self.down = _powers(len(h))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def anchors(h: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """First and last window of each group of windows that share an anchor and a run of twice its length; hashes of anchor, run and segment."""
    short = -(-length // 4)
    double = 2 * short
    runs = run_hashes(h, short)
    low = (runs & ~np.uint64(PART * 2 - 1)) | np.arange(len(runs), dtype=np.uint64)
    width, wide = 1, length - short + 1
    while width < wide:
        step = min(width, wide - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    at = (low & np.uint64(PART * 2 - 1)).astype(np.int64)
    # Windows from length - double words before the anchor on hold the run to its right, earlier ones that to its left.
    right = np.arange(len(at)) >= at - (length - double)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (right[1:] != right[:-1])])
    last = np.r_[first[1:] - 1, len(at) - 1]
    at, right = at[first], right[first]
    doubled = run_hashes(h, double)[np.where(right, at, at + short - double)]
    segment = mixed(Prefixes(h).of(first, last + length) + (at - first).astype(np.uint64))
    return first, last, runs[at], doubled, segment


def _words(batch: pa.RecordBatch, column: str):
    for text in batch.column(column).cast(pa.binary()).to_pylist():
        yield text.split() if text else []


def find_anchors(docs: DataFrame, length: int) -> DataFrame:
    """Rows (did, th, place, anchor, run, segment); place: first window * 64 + further windows."""

    def run(batches):
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy() for c in ("did", "th"))
            parts: list[list] = [[], [], [], [], [], []]
            for k, words in enumerate(_words(batch, "text")):
                for start in range(0, max(0, len(words) - length + 1), PART):
                    first, last, anchor, doubled, segment = anchors(word_hashes(words[start : start + PART + length - 1]), length)
                    n = len(first)
                    for part, x in zip(parts, (np.full(n, ids[k]), np.full(n, keys[k]), (first + start) * 64 + last - first, *(x.view(np.int64) for x in (anchor, doubled, segment)))):
                        part.append(x)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names=["did", "th", "place", "anchor", "run", "segment"])

    return docs.select("did", "th", "text").mapInArrow(run, "did long, th long, place long, anchor long, run long, segment long")


def _unpacked(batch: pa.RecordBatch):
    for data in uncompressed(batch):
        yield data.split()


def find_windows(docs: DataFrame, length: int) -> DataFrame:
    """Windows at the places of each document: (did, th, start, run, window, weight); weight 2 stands for windows known to repeat."""

    def run(batches):
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy() for c in ("did", "th"))
            ends = np.concatenate([[0], np.cumsum(batch.column("places").value_lengths().to_numpy())])
            every = [batch.column("places").flatten().field(c).to_numpy() for c in ("place", "run", "known")]
            parts: list[list] = [[], [], [], [], [], []]
            for k, words in enumerate(_unpacked(batch)):
                place, runs, known = (x[ends[k] : ends[k + 1]] for x in every)
                many = (place & 63) + 1
                starts = np.repeat(place >> 6, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                runs, known = np.repeat(runs, many), np.repeat(known, many)
                hashes = word_hashes(words)
                for at in range(0, len(words), PART):
                    here = (starts >= at) & (starts < at + PART)
                    if here.any():
                        s = starts[here] - at
                        window = Prefixes(hashes[at : at + PART + length]).of(s, s + length)
                        n = len(s)
                        for part, x in zip(parts, (np.full(n, ids[k]), np.full(n, keys[k]), s + at, runs[here], window.view(np.int64), known[here] + 1)):
                            part.append(x)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names=["did", "th", "start", "run", "window", "weight"])

    return docs.mapInArrow(run, "did long, th long, start long, run long, window long, weight long")


def removed(docs: DataFrame, length: int, keep_text: bool) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if wanted, the kept text."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for words, places in zip(_unpacked(batch), batch.column("places").to_pylist()):
                n = len(words)
                if places:
                    places = np.array(places, np.int64)
                    edges = np.zeros(n + 1, np.int64)
                    np.add.at(edges, places >> 6, 1)
                    np.add.at(edges, (places >> 6) + (places & 63) + length, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                kept = b" ".join(words)
                for column, x in zip(out, (n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if keep_text else None)):
                    column.append(x)
            arrays = [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays[: 4 + keep_text], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + keep_text])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """Per document what is left when all words of repeated windows are removed."""
    if not 4 <= length <= 80:
        raise ValueError("length must be 4 to 80 words")
    doc_id = F.col(id_col).cast("long")
    docs = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("did"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    packed = compressed(docs)

    found = stored(find_anchors(docs, length), "anchors")

    def repeated(table: DataFrame, level: str) -> DataFrame:
        """The rows whose hash at this level occurs again."""
        # Stored, so that the join reads both sides by shuffle and Spark can split a hot hash.
        again = stored(table.groupBy(level).agg(F.count("*").alias("many")).where("many > 1").select(level), f"again-{level}")
        kept = stored(table.join(again, level), f"repeated-{level}")
        discard(table, again)
        return kept

    kept = repeated(repeated(found, "anchor").drop("anchor"), "run")
    one = F.min(F.struct("did", "th", "place")).alias("one")
    segments = stored(kept.groupBy("run", "segment").agg(F.count("*").alias("many"), one), "segments")
    whole = kept.join(segments.where("many > 1").select("run", "segment"), ["run", "segment"]).select("did", "th", "place")
    differ = segments.groupBy("run").agg(F.count("*").alias("kinds")).where("kinds > 1").select("run")
    wanted = segments.join(differ, "run").select("one.did", "one.th", F.struct("one.place", "run", (F.col("many") > 1).cast("long").alias("known")).alias("place"))
    wanted = wanted.groupBy("did", "th").agg(F.collect_list("place").alias("places"))

    # Rows that repeat with id and text are one document here: their anchors all repeat.
    windows = stored(find_windows(packed.join(wanted, ["did", "th"]).dropDuplicates(["did", "th"]).select("did", "th", "data", "places"), length), "windows")
    twice = stored(windows.groupBy("run", "window").agg(F.sum("weight").alias("many")).where("many > 1").select("run", "window"), "twice")
    single = windows.where("weight = 1").join(twice, ["run", "window"]).select("did", "th", (F.col("start") * 64).alias("place"))

    covered = whole.unionByName(single).groupBy("did", "th").agg(F.collect_set("place").alias("places"))
    return removed(packed.join(covered, ["did", "th"], "left").select("doc_id", "data", "places"), length, keep_text)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
