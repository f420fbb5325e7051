"""Counts that come out of the job that writes the rows, without a job of their own."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Sources that ``lookup.cascade`` and ``analyze.label`` name.
SOURCES = ("rules", "history", "cluster", "none")


def watched(ledger: DataFrame, name: str = "ledger") -> tuple[DataFrame, Observation]:
    """The ledger, and an observation of its rows: n_rows, n_undated, n_credits, n_untyped, first_date, last_date.

    ``observation.get`` has the figures once an action has read all rows; a limit that stops early, a task that runs
    twice or a plan that reads the ledger twice would count what was read, so watch the rows right before a write."""
    known = F.col("type").isin("CREDIT", "DEBIT")
    figures = [
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("date").isNull()).alias("n_undated"), F.count_if(F.col("type") == "CREDIT").alias("n_credits"),
        F.count_if(~F.coalesce(known, F.lit(False))).alias("n_untyped"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    ]
    seen = Observation(name)
    return ledger.observe(seen, *figures), seen


def label_hits(labelled: DataFrame, sources: tuple[str, ...] = SOURCES, name: str = "labels") -> tuple[DataFrame, Observation]:
    """Labelled rows, and an observation of n_rows, n_<source> for each source, and n_other_source (null ones too)."""
    source = F.col("label_source")
    each = [F.count_if(source == s).alias(f"n_{s}") for s in sources]
    other = F.count_if(~F.coalesce(source.isin(*sources), F.lit(False))).alias("n_other_source")
    seen = Observation(name)
    return labelled.observe(seen, F.count(F.lit(1)).alias("n_rows"), *each, other), seen


def hit_rates(seen: Observation) -> dict[str, float]:
    """Shares of the rows of ``label_hits``, four digits; 0 without rows."""
    got = dict(seen.get)
    rows = got.pop("n_rows") or 0
    return {name[2:]: round((n or 0) / rows, 4) if rows else 0.0 for name, n in got.items()}


def _entry(name: str | None) -> dict:
    return {"name": name, "batches": 0, "rows": 0, "dropped": 0, "observed": {}, "ended": False}


class Progress(StreamingQueryListener):
    """Per streaming query: batches, rows read, rows dropped by the watermark, and the last observed figures.

    Add it by ``spark.streams.addListener``; figures of a batch arrive shortly after it.  One small entry is kept for
    each query, however long it runs."""

    def __init__(self):
        self._lock = threading.Lock()
        self._queries: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._queries.setdefault(str(event.id), _entry(event.name))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            entry = self._queries.setdefault(str(p.id), _entry(p.name))
            entry["batches"] += 1
            entry["rows"] += p.numInputRows
            entry["dropped"] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
            entry["observed"].update({k: v.asDict() for k, v in (p.observedMetrics or {}).items()})

    def onQueryIdle(self, event) -> None:
        """Nothing to count."""

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            if str(event.id) in self._queries:
                self._queries[str(event.id)]["ended"] = True

    def of(self, query_id: str) -> dict:
        with self._lock:
            return dict(self._queries.get(str(query_id), {}))
