"""Benchmark decontamination by template canonicalisation.

Words become templates: numbers (digits, number words, numbers with a unit attached), names
(capitalised words) and units turn into typed slots, other words lose case and surrounding
punctuation. All windows of ``WINDOW`` template words of the benchmark are hashed; documents are
searched for the same hashes, whatever fills the slots. Windows are matched in a second form too, in
which names are words in lower case, so that copies count in whatever case they are written.
Matching windows of one item are chained along one alignment, and an alignment counts when it
covers at least ``COVER`` of the item's windows and its slots are consistent: each value of the item
stands for one value of the document throughout, and no two names for the same one. Exact copies and
questions with other numbers or names thus both count; texts that merely share a frame don't.
Items shorter than a window are matched as a whole.

Windows of both tables are made in tasks and meet in a hash join. A bitmap of the benchmark's hashes,
of at most ``MOST_BITS`` bits, keeps nearly all other windows of the documents out of the shuffle; a
larger benchmark only lets more of them through. Matches are counted by document, item and alignment,
and only documents with enough of them are read again to check their slots.

Edge cases: null and empty texts of either table match nothing; null ids are allowed; repeated rows
are reported each; repeated items are reported each; empty tables give an empty result; other
columns are ignored by :func:`contaminated` and kept by :func:`clean`.
"""

from __future__ import annotations

import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidflow.llm.common import compressed, discard, read, rows, stored, uncompressed
from bidflow.llm.shingles import mixed, run_hashes

WINDOW = 8
#: Share of an item's windows that a passage must cover.
COVER = 0.6
#: Of the bitmap: 32 MB.
MOST_BITS = 1 << 28
#: Bits of the bitmap for each window of the benchmark, each of which sets two.
BITS_EACH = 32
_CHUNK = 1 << 15
#: Distinct words that a task keeps at a time.
KNOWN_WORDS = 300_000
#: Fixed lists of units and number words.
UNITS = frozenset(b"mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur mph kmh kph hz khz mhz w kw v volt volts degree degrees percent".split())
NUMBER_WORDS = frozenset(b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split())
_NUMBER = re.compile(rb"[$+-]?\d[\d.,:/]*%?([a-z]*)")
_EDGE = b".,;:!?\"'()[]{}<>|*#&$%_-"
_ENDS = frozenset(b".!?:|")
_NUM, _UNIT, _CAPITAL, _ENDING, _EMPTY = 1, 2, 4, 8, 16
#: Template words of the slots.
NUMBER, NAME, MEASURE = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"<num>", b"<name>", b"<unit>"))
NAMED, PLAIN = 0, 1  # forms


class Words(dict):
    """Template words of texts, as hashes; what a distinct word is, is found once, when it is first asked for its number."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.hashes, self.flags = array("Q"), array("B")

    def __missing__(self, raw: bytes) -> int:
        word = raw.strip(_EDGE)
        low, first = word.lower(), word[0] if word else 0
        capital = 65 <= first <= 90
        if first > 127 or not word.isascii():
            text = word.decode("utf-8", "surrogatepass")
            low, capital = text.casefold().encode("utf-8", "surrogatepass"), text[:1].isupper()
        number = low in NUMBER_WORDS
        if first < 58 and not number and (m := _NUMBER.fullmatch(low)):  # digits and signs come before all letters
            number = not m[1] or m[1] in UNITS
        self.hashes.append(xxhash.xxh3_64_intdigest(low))
        self.flags.append(_NUM * number + _UNIT * (low in UNITS) + _CAPITAL * (capital and not number) + _ENDING * (raw[-1] in _ENDS) + _EMPTY * (not word))
        n = self[raw] = len(self)
        return n

    def __call__(self, text: str | bytes | None) -> Canonical:
        raws = (text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")).split()
        if len(self) > KNOWN_WORDS:
            self.forget()
        at = np.fromiter(map(self.__getitem__, raws), np.int64, len(raws))
        flags = np.frombuffer(self.flags, np.uint8)[at]
        opening = np.concatenate([[True], flags[:-1] & _ENDING != 0])[: len(at)]
        kept = flags & _EMPTY == 0
        return Canonical(np.frombuffer(self.hashes, np.uint64)[at[kept]], flags[kept], opening[kept])


class Canonical:
    """Words of a text that aren't punctuation alone: hashes of their values and of their templates in both forms."""

    def __init__(self, values: np.ndarray, flags: np.ndarray, opening: np.ndarray):
        number = flags & _NUM != 0
        unit = (flags & _UNIT != 0) & np.concatenate([[False], number[:-1]])[: len(number)] & ~number
        self.name = (flags & _CAPITAL != 0) & ~unit
        self.values, self.opening, self.slot = values, opening, number | unit | self.name
        plain = np.where(number, NUMBER, np.where(unit, MEASURE, values))
        self.templates = (np.where(self.name, NAME, plain), plain)

    def ordinary(self) -> set[int]:
        """Values of words in lower case."""
        return set(self.values[~self.slot].tolist())

    def keys(self, size: int) -> list[np.ndarray]:
        """Hashes of the windows of so many words, by form."""
        return [mixed(run_hashes(t, size) + np.uint64(2 * size + form)).view(np.int64) for form, t in enumerate(self.templates)]


def consistent(item: Canonical, doc: Canonical, form: int, shift: int, ordinary: set[int]) -> bool:
    """Whether slots map one to one where item and document are aligned.

    In the form without names, names stand in the item's slots. A sentence may open with another
    ordinary word than the item's.
    """
    a, b = max(0, -shift), min(len(item.values), len(doc.values) - shift)
    x, y = slice(a, b), slice(a + shift, b + shift)
    here = item.slot[x] & (item.templates[NAMED][x] == doc.templates[NAMED][y])
    if form == PLAIN:
        here |= item.name[x] & np.isin(doc.values[y], item.values[item.name])
    to: dict[tuple, int] = {}
    back: dict[int, int] = {}
    at = np.flatnonzero(here)
    columns = (item.name[x][at], item.opening[x][at] & doc.opening[y][at], item.templates[NAMED][x][at], item.values[x][at], doc.values[y][at])
    for name, opening, slot, v, w in zip(*(c.tolist() for c in columns)):
        if opening and name and (v in ordinary or w in ordinary):
            continue
        if to.setdefault((slot, v), w) != w or name and back.setdefault(w, v) != v:
            return False
    return True


def alignment(item: Canonical, doc: Canonical, form: int, shifts: list[tuple[int, int]], total: int, cover: float, ordinary: set[int]) -> tuple | None:
    """(windows matched, start, exact) of the best alignment of an item (shift, windows matched) that counts."""
    best = None
    for shift, n in shifts:
        if n >= cover * total and (best is None or (n, -shift) > (best[0], -best[1])) and consistent(item, doc, form, shift, ordinary):
            part = doc.values[max(0, shift) : max(0, shift) + len(item.values)]
            best = n, shift, len(part) == len(item.values) and bool((part == item.values).all())
    if best or len(shifts) < 2:
        return best
    # Words put in or left out: windows lie on several alignments and count by their sum.
    shifts, low = sorted(shifts), 0
    for high in range(len(shifts)):  # alignments that lie within the item's own length
        while shifts[high][0] - shifts[low][0] > len(item.values) // 2:
            low += 1
        n = min(total, sum(x[1] for x in shifts[low : high + 1]))
        if n >= cover * total and (best is None or n > best[0]) and all(consistent(item, doc, form, s, ordinary) for s, _ in shifts[low : high + 1]):
            best = n, shifts[low][0], False
    return best


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(key, form, size, item, at, total) of all windows of the items (item, text)."""

    def run(batches):
        words = Words()
        for item, text in rows(batches, "item", "text"):
            found = words(text)
            if size := min(window, len(found.values)):
                for form, keys in enumerate(found.keys(size)):
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array(np.full(n, form, np.int32)), pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, item)), pa.array(np.arange(n, dtype=np.int64)), pa.array(np.full(n, n, np.int64))],
                        names=["key", "form", "size", "item", "at", "total"],
                    )

    return items.mapInArrow(run, "key long, form int, size int, item long, at long, total long")


def bitmap(windows: DataFrame) -> tuple[np.ndarray, int]:
    """Bits that the keys set, packed, and how many bits there are."""
    bits = _CHUNK
    while bits < min(MOST_BITS, BITS_EACH * windows.count()):
        bits *= 2
    places = F.explode(F.array(F.col("key").bitwiseAND(bits - 1), F.shiftrightunsigned("key", 32).bitwiseAND(bits - 1)))
    chunks = windows.select(places.alias("place")).select(F.shiftright("place", 15).alias("chunk"), F.col("place").bitwiseAND(_CHUNK - 1).alias("bit")).groupBy("chunk").agg(F.collect_set("bit").alias("bits"))  # at most _CHUNK

    def run(batches):
        for chunk, which in rows(batches, "chunk", "bits"):
            part = np.zeros(_CHUNK, bool)
            part[which] = True
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "packed": pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for r in chunks.mapInArrow(run, "chunk long, packed binary").collect():  # MOST_BITS at most
        at = r["chunk"] * _CHUNK // 8
        out[at : at + _CHUNK // 8] = np.frombuffer(r["packed"], np.uint8)
    return out, bits


def hits(docs: DataFrame, sizes: list[int], packed: np.ndarray, bits: int) -> DataFrame:
    """(did, th, row, key, at) of the windows of documents whose bits are set; row tells repeated rows apart."""
    low = np.uint64(bits - 1)

    def run(batches):
        words, row = Words(), TaskContext.get().partitionId() << 33
        for batch in batches:
            parts: list[list] = [[], [], [], [], []]
            for did, th, text in rows([batch], "did", "th", "text"):
                row += 1
                found = words(text)
                for size in sizes:
                    for keys in found.keys(size):
                        k = keys.view(np.uint64)
                        p = k & low
                        at = np.flatnonzero(packed[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1)
                        p = k[at] >> np.uint64(32) & low
                        at = at[np.flatnonzero(packed[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1)]
                        if len(at):
                            n = len(at)
                            for part, x in zip(parts, (np.full(n, did), np.full(n, th), np.full(n, row), keys[at], at)):
                                part.append(x)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names=["did", "th", "row", "key", "at"])

    return docs.select("did", "th", "text").mapInArrow(run, "did long, th long, row long, key long, at long")


def found(docs: DataFrame, benchmark: DataFrame, window: int, cover: float) -> DataFrame:
    """(did, th, item_id, start_word, windows, of_windows, exact): once for each text (did, th) and row of the benchmark."""
    items = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length("text") > 0).withColumn("item", F.monotonically_increasing_id()), "items")
    windows = stored(item_windows(items, window), "item-windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most ``window``
    # Stored, so that the join reads both sides by shuffle and Spark can split a hot window.
    seen = stored(hits(docs, sizes, *bitmap(windows)), "window-hits")
    both = seen.join(windows.withColumnRenamed("at", "place"), "key").groupBy("did", "th", "row", "item", "form", (F.col("at") - F.col("place")).alias("shift")).agg(F.count("*").alias("n"), F.min("total").alias("total"))
    chained = both.groupBy("did", "th", "row", "item", "form").agg(F.collect_list(F.struct("shift", "n")).alias("shifts"), F.sum("n").alias("n"), F.min("total").alias("total"))
    enough = stored(chained.where(F.col("n") >= cover * F.col("total")).drop("row", "n").dropDuplicates(["did", "th", "item", "form"]), "candidate-passages")
    texts = compressed(docs.select("did", "th", "text")).join(enough.select("did", "th").distinct(), ["did", "th"], "left_semi").dropDuplicates(["did", "th"])
    forms = enough.groupBy("did", "th", "item").agg(F.collect_list(F.struct("form", "shifts", "total")).alias("forms"))  # two at most
    pairs = forms.join(items.withColumnRenamed("text", "item_text"), "item").join(texts, ["did", "th"])

    def check(batches):
        words, last = Words(), (None, None, None)
        for batch in batches:
            out = []
            for did, th, item_id, item_text, forms, data in zip(*(batch.column(c).to_pylist() for c in ("did", "th", "item_id", "item_text", "forms")), uncompressed(batch)):
                if last[0] != data:
                    doc = words(data)
                    last = data, doc, doc.ordinary()
                item = words(item_text)
                for f in sorted(forms, key=lambda f: f["form"]):
                    if best := alignment(item, last[1], f["form"], [(s["shift"], s["n"]) for s in f["shifts"]], f["total"], cover, last[2] | item.ordinary()):
                        out.append((did, th, item_id, best[1], best[0], f["total"], best[2]))
                        break
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 6 + [pa.bool_()])], names=["did", "th", "item_id", "start_word", "windows", "of_windows", "exact"])

    out = stored(pairs.select("did", "th", "item_id", "item_text", "forms", "data").mapInArrow(check, "did long, th long, item_id long, start_word long, windows long, of_windows long, exact boolean"), "passages")
    discard(items, windows, seen, enough)
    return out


def keys_of(id_col: str, text_col: str):
    """What names a document: its id and text."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), F.xxhash64(text_col)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cover: float = COVER) -> DataFrame:
    """One row for each document and item that it contains."""
    did, th = keys_of(id_col, text_col)
    docs = docs.select(F.col(id_col).alias("doc_id"), did.alias("did"), th.alias("th"), F.col(text_col).alias("text"))
    return docs.select("doc_id", "did", "th").join(found(docs, benchmark, window, cover), ["did", "th"]).drop("did", "th")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cover: float = COVER) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    did, th = keys_of(id_col, text_col)
    gone = found(docs.select(did.alias("did"), th.alias("th"), F.col(text_col).alias("text")), benchmark, window, cover).select("did", "th").distinct()
    # Names that no column has.
    a, b = (f"__{uuid.uuid4().hex}" for _ in range(2))
    return docs.join(gone.toDF(a, b), (did == F.col(a)) & (th == F.col(b)), "left_anti")


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
