"""Run metrics that are taken while a result is written: counts, errors and time without a second pass."""

from __future__ import annotations

import threading
import time
from collections import deque

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

NAME = "run_metrics"
LEDGER = ("run_id string, status string, versions long, completed long, failed long, skipped long, proposals_created long, "
          "requires_review_count long, first_error string, latency_ms long")
KEPT = 10_000


def ledger_metrics() -> list[Column]:
    """Aggregates over rows of ``extraction.run_ledger``, one pass, a bounded state per task."""
    status = F.col("status")
    return [
        F.count(F.lit(1)).alias("versions"), *[F.count_if(status == s).alias(s) for s in ("completed", "failed", "skipped")],
        F.coalesce(F.sum("proposals_created"), F.lit(0)).alias("proposals_created"),
        F.coalesce(F.sum("requires_review_count"), F.lit(0)).alias("requires_review_count"),
        F.min(F.when(status == "failed", F.concat_ws(": ", F.col("version_id").cast("string"), "error_summary"))).alias("first_error"),
    ]


def run_status(completed: int, failed: int) -> str:
    return "partial" if failed and completed else "failed" if failed else "completed"


def _row(run_id: str, m: dict, latency_ms: int) -> tuple:
    return (run_id, run_status(m["completed"], m["failed"]), m["versions"], m["completed"], m["failed"], m["skipped"], m["proposals_created"],
            m["requires_review_count"], m["first_error"], latency_ms)


def write_measured(ledger: DataFrame, path: str, run_id: str) -> DataFrame:
    """Write the rows of a run and return its ledger row; the counts come from the same pass that writes."""
    seen = Observation(f"{NAME}-{run_id}")
    started = time.perf_counter()
    ledger.observe(seen, *ledger_metrics()).write.mode("overwrite").parquet(path)
    took = int((time.perf_counter() - started) * 1000)
    return ledger.sparkSession.createDataFrame([_row(run_id, seen.get, took)], LEDGER)


def measured_stream(ledger: DataFrame) -> DataFrame:
    """A streaming ledger whose batches report to a :class:`LedgerListener`."""
    return ledger.observe(NAME, *ledger_metrics())


class LedgerListener(StreamingQueryListener):
    """One ledger row for every micro-batch of a measured stream; the newest ``KEPT`` rows stay in the driver."""

    def __init__(self) -> None:
        self.rows: deque[tuple] = deque(maxlen=KEPT)
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        """Nothing to record before a batch."""

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        seen = progress.observedMetrics.get(NAME)
        if seen is not None and seen["versions"]:
            with self._lock:
                self.rows.append(_row(f"{progress.name or progress.id}/{progress.batchId}", seen.asDict(), int(progress.durationMs.get("triggerExecution", 0))))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        """Nothing arrived."""

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        """Batches that ended are recorded already."""

    def ledger(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            return spark.createDataFrame(list(self.rows), LEDGER)
