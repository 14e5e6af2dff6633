"""Counters of a run, taken in the pass that writes it, and told while it goes on."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "run"


def _counts() -> list:
    of = lambda outcome, name: F.count_if(F.col("outcome") == outcome).alias(name)
    return [F.count_if(F.col("outcome") != "EXPIRED").alias("found"), of("NEW", "new"), of("UPDATED", "updated"), of("UNCHANGED", "unchanged"), of("EXPIRED", "expired")]


def measured(classes: DataFrame, observation: Observation | str = NAME) -> DataFrame:
    """classes (outcome) as they are; whatever action or stream runs over them counts their outcomes on the way."""
    return classes.observe(observation, *_counts())


def write_measured(classes: DataFrame, write: Callable[[DataFrame], None]) -> dict[str, int]:
    """Write classes once and return their counters, without a second pass."""
    seen = Observation()
    write(measured(classes, seen))
    return seen.get


class Progress(StreamingQueryListener):
    """Tells of each micro-batch with rows that measured() has counted: its number, its counters, and those of all so far."""

    def __init__(self, tell: Callable[[int, dict, dict], None], name: str = NAME):
        self.tell, self.name, self.total = tell, name, Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            counts = {k: v or 0 for k, v in row.asDict().items()}
            if any(counts.values()):
                self.total.update(counts)
                self.tell(event.progress.batchId, counts, dict(self.total))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
