"""What filters do to each other, in every order they could be applied in, by wide packed counters.

Five filters give each document a mask of those it fails; whether it is labelled good or toxic are
two more bits. What happens to a document at each of the 5 steps of each of the 120 orders follows
from its mask alone, so every mask is mapped, once, to a big integer of 64-bit fields: for each of
the 600 steps one field of each counter (kept, removed, redundant, good lost, toxic lost), then one
field a filter for documents that fail it alone. A task adds one integer a document to the sum of the
document's part; sums of tasks are added up, salted first, and unpacked. A field holds a number of
documents, which is below 2**63, so no sum carries into the next field.

A: fewer than ``MIN_WORDS`` words; B: fewer than half of the words distinct; C: more than 2 % capitals
A-Z; D: holds any of ``#$%&*|``; E: the same text as a document with a smaller id. Texts are compared by
128-bit hashes: the smallest id of each text is found by an aggregate, and meets the documents by id,
not by text, so that no task holds a group of copies.

Edge cases: a null text is empty (and the same text as an empty one); a null part is the empty string,
its own rows and those of an empty string count together; a row with a null id fails E never and makes
nobody fail; repeated rows are documents of their own, none of them fails E by the other; documents
without labels are neither good nor toxic, of several labels of a document any 1 counts; texts of any
length are read whole, one at a time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidflow.llm.common import discard, read, rows, stored

FILTERS = "ABCDE"
MIN_WORDS = 200
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTERS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
COPY, GOOD, TOXIC = 1 << 4, 1 << 5, 1 << 6
STEPS = len(ORDERS) * len(FILTERS)
FIELDS = STEPS * len(COUNTERS) + len(FILTERS)
#: Sums that a task holds at a time, and groups that the sums of one part are first added up in.
HELD, SALTS = 1024, 64
_SYMBOLS, _CAPITALS, _TAILS = b"#$%&*|", bytes(range(65, 91)), bytes(range(128, 192))


def outcomes(mask: int) -> dict[str, list[bool]]:
    """Of a mask, for each counter: whether it counts at each step of each order."""
    out: dict[str, list[bool]] = {c: [] for c in COUNTERS}
    for order in ORDERS:
        here = True
        for letter in order:
            fails = bool(mask >> FILTERS.index(letter) & 1)
            removed = here and fails
            for counter, holds in zip(COUNTERS, (here and not fails, removed, fails and not here, removed and mask & GOOD, removed and mask & TOXIC), strict=True):
                out[counter].append(bool(holds))
            here = here and not fails
    return out


@cache
def packed(mask: int) -> int:
    """The big integer of a mask: a 1 in the field of all that it counts in."""
    flags = np.array([outcomes(mask)[c] for c in COUNTERS]).T.ravel()
    alone = [mask & 31 == 1 << i for i in range(len(FILTERS))]
    return int.from_bytes(np.append(flags, alone).astype("<i8").tobytes(), "little")


def facts(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc_id, part, mask, digest): the filters that a text fails by itself, and a hash of the text."""

    def failed(text: bytes) -> int:
        words = text.split()  # bytes are split at ASCII blanks alone
        points = len(text.translate(None, _TAILS))
        found = [len(words) < MIN_WORDS, 100 * len(set(words)) < 50 * len(words), 100 * (len(text) - len(text.translate(None, _CAPITALS))) > 2 * points, len(text.translate(None, _SYMBOLS)) < len(text)]
        return sum(1 << i for i, x in enumerate(found) if x)

    def run(batches):
        for batch in batches:
            masks, digests = [], []
            for value in batch.column("text"):
                text = value.as_py() or b""
                masks.append(failed(text))
                digests.append(xxhash.xxh3_128_digest(text))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("binary").alias("text"))
    return named.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask) of every document, with bits for E and for the labels."""
    table = stored(facts(docs, id_col, text_col, part_col), "filter-facts")
    first = table.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_set("digest").alias("firsts"))
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    bit = lambda holds, value: F.when(holds, value).otherwise(0)
    copy = F.col("doc_id").isNotNull() & ~F.coalesce(F.array_contains("firsts", F.col("digest")), F.lit(False))
    joined = table.join(first.hint("merge"), "doc_id", "left").join(told.hint("merge"), "doc_id", "left")
    out = joined.select("part", (F.col("mask") + bit(copy, COPY) + bit(F.col("good"), GOOD) + bit(F.col("toxic"), TOXIC)).cast("int").alias("mask"))
    out.stored_at = table.stored_at
    return out


def _row(part: str, salt: int, total: int, press) -> dict:
    return {"part": part, "salt": salt, "total": press(total.to_bytes(8 * FIELDS, "little"))}


_SUMS = pa.schema([("part", pa.string()), ("salt", pa.int32()), ("total", pa.binary())])


def counted(table: DataFrame) -> DataFrame:
    """(part, salt, total): the sums of each task, one integer a document."""

    def run(batches):
        press, salt, sums = zstandard.ZstdCompressor(level=1).compress, TaskContext.get().partitionId() % SALTS, {}
        for batch in batches:
            for part, mask in rows([batch], "part", "mask"):
                sums[part] = sums.get(part, 0) + packed(mask)
                if len(sums) > HELD:
                    yield pa.RecordBatch.from_pylist([_row(p, salt, t, press) for p, t in sums.items()], _SUMS)
                    sums = {}
        yield pa.RecordBatch.from_pylist([_row(p, salt, t, press) for p, t in sums.items()], _SUMS)

    return table.mapInArrow(run, "part string, salt int, total binary")


def _sums(batches):
    """(part, salt, total) of rows that lie sorted by part and salt, one group at a time."""
    unpack, key, total = zstandard.ZstdDecompressor().decompress, None, 0
    for batch in batches:
        for part, salt, data in rows([batch], "part", "salt", "total"):
            if (part, salt) != key:
                if key is not None:
                    yield *key, total
                key, total = (part, salt), 0
            total += int.from_bytes(unpack(data), "little")
    if key is not None:
        yield *key, total


def summed(table: DataFrame) -> DataFrame:
    def run(batches):
        press = zstandard.ZstdCompressor(level=1).compress
        for part, salt, total in _sums(batches):
            yield pa.RecordBatch.from_pylist([_row(part, salt, total, press)], _SUMS)

    return table.repartition("part", "salt").sortWithinPartitions("part", "salt").mapInArrow(run, "part string, salt int, total binary")


def unpacked(table: DataFrame) -> DataFrame:
    """One row per part, order and step, from the sums of each part."""
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches):
        orders = pa.array(np.repeat(ORDERS, len(FILTERS)).tolist())
        steps = pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)))
        letter = np.array([FILTERS.index(x) for order in ORDERS for x in order])
        for part, _, total in _sums(batches):
            fields = np.frombuffer(total.to_bytes(8 * FIELDS, "little"), "<i8")
            counts = dict(zip(COUNTERS, fields[: STEPS * len(COUNTERS)].reshape(STEPS, len(COUNTERS)).T, strict=True))
            shapley = np.array([counts["removed"][letter == i].sum() for i in range(len(FILTERS))])
            found = counts | {"unique_fails": fields[STEPS * len(COUNTERS) :][letter], "shapley": shapley[letter]}
            yield pa.RecordBatch.from_arrays([pa.array([part] * STEPS, pa.string()), orders, steps, *(pa.array(np.ascontiguousarray(found[n])) for n in names[3:])], names=names)

    whole = table.select("part", F.lit(0).alias("salt"), "total")
    return whole.repartition("part").sortWithinPartitions("part").mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names[3:]))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    table = masks(docs, labels, id_col, text_col, part_col)
    sums = stored(summed(counted(table)), "filter-sums")
    discard(table)
    return unpacked(sums)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
