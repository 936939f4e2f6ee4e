"""The current status of jobs from status events as they arrive.

Every job has a state of its own: the newest event so far in the order ``(updated_at, seq)``,
as in :func:`reporank.operators.jobs.latest_status`. An event that comes late or twice changes
nothing; one that is newer gives a new row of output.

With ``keep_ms`` a finished job (done or failed) is forgotten that long after its last event by
the clock, so the state holds jobs that are under way; the sink's rows stay. An event of a
forgotten job that is no newer than its last one counts as new then, so ``keep_ms`` is longer
than events can be late. Timers by the clock keep a query running: it needs a trigger that
goes on, as ``availableNow`` would never end. Without ``keep_ms`` nothing is forgotten.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FINISHED = ("done", "failed")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestStatus(StatefulProcessor):
    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at long, seq long, status string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.newest.get() if self.newest.exists() else None
        best = held and (held[0], held[1], held[2])
        for row in rows:
            one = (row.at, row.seq, row.status)
            if best is None or one[:2] > best[:2]:
                best = one
        if best is None or (held and best[:2] == (held[0], held[1])):
            return
        self.newest.update(best)
        if self.keep_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if best[2] in FINISHED:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        yield Row(job_id=key[0], at=best[0], seq=best[1], status=best[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.newest.clear()
        return iter([])

    def close(self) -> None:
        pass


def status_changes(events: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """``(job_id, status, updated_at, seq)`` of every job whose status changed in a batch.

    ``events`` streams ``job_id, status, updated_at, seq``. The last row of a job in the sink,
    by ``(updated_at, seq)``, is its current status. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    job = events.schema["job_id"].dataType.simpleString()
    slim = events.select("job_id", F.unix_micros("updated_at").alias("at"), F.col("seq").cast("long").alias("seq"), "status")
    changed = slim.groupBy("job_id").transformWithState(
        LatestStatus(keep_ms), f"job_id {job}, at long, seq long, status string", "Update", "None" if keep_ms is None else "ProcessingTime"
    )
    return changed.select("job_id", "status", F.timestamp_micros("at").alias("updated_at"), "seq")
