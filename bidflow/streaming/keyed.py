"""The portals' state as keyed state of a stream, with timers for rows that are seen no more.

Each (portal_id, external_id) has a value in Spark's state store: the row as it was kept, its fingerprint,
and when it expires. A micro-batch reads and writes the keys that it holds, nothing else; the store
keeps versions and change logs in the checkpoint, so a lost executor or a restart loses nothing. Every
sighting gives one row of outcomes; a row that is open and isn't seen for ``days`` gives EXPIRED once the watermark has passed its timer.

Fingerprints and texts of the fields are found in Spark before the rows are grouped; the processor
compares strings, and the diffs are made in Spark from what it tells. Of several rows of a key in one
micro-batch the latest counts (if several are of the same time, the greatest by its texts); rows later
than the watermark are dropped by Spark, as an older page mustn't overwrite a newer one.

Outcomes are a Parquet table under ``path``, written once per micro-batch; :func:`events` is its event log,
:func:`counters` its counts, and :func:`state` reads the rows from the state store itself.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from bidflow.functions.hashing import as_text, fingerprint
from bidflow.operators import cdc
from bidflow.operators.progress import measured
from bidflow.streaming.listings import STATE

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KINDS = {"int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "timestamp_ntz": T.TimestampNTZType()}
_ROW = [T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in STATE.split(", "))]
_FIELDS = [f for f in _ROW if f.name not in (*cdc.KEY, "last_seen_at")]
_NAMES = [f.name for f in _FIELDS]
#: What a key's value holds: the kept row, when it was seen last and is due to expire (milliseconds), and the texts that diffs compare.
KEPT = T.StructType([*_FIELDS, T.StructField("seen_ms", T.LongType()), T.StructField("due_ms", T.LongType()), T.StructField("fingerprint", T.StringType()), T.StructField("texts", T.ArrayType(T.StringType()))])
TOLD = T.StructType(
    [
        *(f for f in _ROW if f.name in cdc.KEY), T.StructField("outcome", T.StringType()), T.StructField("seen_ms", T.LongType()), T.StructField("old_status", T.StringType()), T.StructField("new_status", T.StringType()),
        T.StructField("old_texts", T.ArrayType(T.StringType())), T.StructField("new_texts", T.ArrayType(T.StringType())), T.StructField("row", T.StructType(_FIELDS)),
    ]
)


def prepared(records: DataFrame, late: str) -> DataFrame:
    """records (fields of the state, with fetched_at: timestamp) with fingerprint, texts and time of sighting, under a watermark."""
    timed = records.withColumn("fetched_at", F.coalesce("fetched_at", F.current_timestamp())).withWatermark("fetched_at", late)
    there = {f.name: F.col(f.name).cast(f.dataType) if f.name in records.columns else F.lit(None).cast(f.dataType) for f in _ROW}
    whole = timed.select("fetched_at", *(there[n].alias(n) for n in (*cdc.KEY, *_NAMES)))
    kinds = dict(whole.dtypes)
    texts = F.array(*(as_text(n, kinds[n]) for n in cdc.SIGNIFICANCE))
    return whole.select("*", F.unix_millis("fetched_at").alias("seen_ms"), fingerprint(whole).alias("fingerprint"), texts.alias("texts"))


class Keeper(StatefulProcessor):
    """Keeps one row a key, tells what becomes of it, and lets it expire."""

    def __init__(self, days: int):
        self.patience = days * 86_400_000

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", KEPT)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = max(rows, key=lambda r: (r["seen_ms"], [(t is not None, t or "") for t in r["texts"]]))
        old = self.kept.get()
        old = None if old is None else dict(zip(KEPT.names, old, strict=True))
        same = old is not None and old["fingerprint"] == new["fingerprint"]
        seen = new["seen_ms"] if old is None else max(new["seen_ms"], old["seen_ms"])
        due = seen + self.patience
        if old is None or old["due_ms"] != due:
            if old is not None:
                self.handle.deleteTimer(old["due_ms"])
            self.handle.registerTimer(due)
        source = old if same else new
        self.kept.update((*(source[n] for n in _NAMES), seen, due, source["fingerprint"], source["texts"]))
        outcome = "NEW" if old is None else "UNCHANGED" if same else "UPDATED"
        row = None if same else Row(*_NAMES)(*(new[n] for n in _NAMES))
        texts = (None, None) if old is None or same else (old["texts"], new["texts"])
        yield Row(*TOLD.names)(*key, outcome, seen, old and old["status"], source["status"], *texts, row)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        old = dict(zip(KEPT.names, self.kept.get(), strict=True))
        if old["status"] == "OPEN":
            yield Row(*TOLD.names)(*key, "EXPIRED", old["seen_ms"], "OPEN", "OPEN", None, None, None)

    def close(self) -> None:
        pass


def outcomes(records: DataFrame, days: int = 30, late: str = "1 hour") -> DataFrame:
    """What becomes of every key that is sighted or expires: outcome, event (null if unchanged), changes, last_seen_at, and the new row where there is one."""
    told = prepared(records, late).groupBy(*cdc.KEY).transformWithState(Keeper(days), TOLD, "append", "eventTime")
    moved = ~F.col("old_status").eqNullSafe(F.col("new_status")) & F.col("new_status").isin("CLOSED", "AWARDED", "EXPIRED")
    event = F.when(F.col("outcome").isin("NEW", "EXPIRED"), F.col("outcome")).when(F.col("outcome") == "UPDATED", F.when(moved, F.col("new_status")).otherwise("UPDATED"))
    return told.select(*cdc.KEY, "outcome", event.alias("event"), _changes().alias("changes"), F.timestamp_millis("seen_ms").alias("last_seen_at"), "row")


def _changes() -> Column:
    """The fields whose texts differ, in the order of their significance's list; empty and null are equal."""

    def one(i: int, name: str, level: str) -> Column:
        old, new = (F.get(F.col(c), F.lit(i)) for c in ("old_texts", "new_texts"))
        differs = ~F.nullif(old, F.lit("")).eqNullSafe(F.nullif(new, F.lit("")))
        return F.when(differs, F.struct(F.lit(name).alias("field"), old.alias("old"), new.alias("new"), F.lit(level).alias("significance")))

    return F.array_compact(F.array(*(one(i, n, s) for i, (n, s) in enumerate(cdc.SIGNIFICANCE.items()))))


def keep(records: DataFrame, path: str, days: int = 30, late: str = "1 hour") -> StreamingQuery:
    """Run through what is there and end; another call goes on from where this one ended. A listener of progress.Progress is told the counters."""
    spark = records.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        told = measured(outcomes(records, days, late))
        return told.writeStream.format("parquet").option("path", f"{path}/outcomes").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def state(spark: SparkSession, path: str) -> DataFrame:
    """The portals' state, from the state store of the last micro-batch."""
    stored = spark.read.format("statestore").option("stateVarName", "kept").load(f"{path}/checkpoint")
    seen = F.timestamp_millis("value.seen_ms").cast("timestamp_ntz")
    return stored.select(*(f"key.{k}" for k in cdc.KEY), *(f"value.{n}" for n in _NAMES), seen.alias("last_seen_at"))


def told(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/outcomes")


def events(spark: SparkSession, path: str) -> DataFrame:
    """The event log of all micro-batches."""
    return cdc.events_of(told(spark, path))


def counters(spark: SparkSession, path: str) -> DataFrame:
    """Per portal what all micro-batches found."""
    return cdc.run_counters(told(spark, path).where("outcome <> 'EXPIRED'"))
