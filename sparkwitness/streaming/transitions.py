"""Evidence status transitions while the coordinates of a context move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coordinates import CONTEXT_FIELDS, fields, overall_status

OUTPUT = "context_set string, evidence_id string, observed_at timestamp, before string, after string"
BUCKETS = 1024  # keys of the state, each of which costs some calls per trigger


def _processor(expire_ms: int):
    """The stateful step.  It is made here, so that workers get it by value and need no copy of this package."""
    from pyspark.sql.streaming import StatefulProcessor

    class InOrder(StatefulProcessor):
        """Holds the rows of a bucket of evidence until the watermark has passed them, then compares neighbours of one evidence in event time.

        A timer fires once the watermark has reached it; a timer that has fired is gone, so the next is always later.  Calls to the
        state cost far more than rows, so the rows of a bucket share them; a status is read and written by itself.
        """

        def init(self, handle):
            self.handle = handle
            self.waiting = handle.getListState("waiting", "context_set string, evidence_id string, at long, sequence long, status string")
            self.last = handle.getMapState("last", "context_set string, evidence_id string", "at long, status string")
            self.sweep = handle.getValueState("sweep", "at long")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            passed, first = timerValues.getCurrentWatermarkInMs(), None
            for frame in rows:
                micros = frame["observed_at"].astype("datetime64[us]").astype("int64")
                given = zip(frame["context_set"], frame["evidence_id"], micros, frame["sequence"], frame["status"], strict=True)
                kept = [(c, e, int(a), int(s), t) for c, e, a, s, t in given if -(-int(a) // 1000) > passed]
                if kept:
                    self.waiting.appendList(kept)
                    first = min([k[2] for k in kept] + ([] if first is None else [first]))
            if first is not None:
                self.handle.registerTimer(-(-first // 1000))
            yield pd.DataFrame()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            passed = timerValues.getCurrentWatermarkInMs()
            ready, rest = {}, []
            for row in self.waiting.get() if self.waiting.exists() else ():
                if -(-row[2] // 1000) <= passed:
                    ready.setdefault((row[0], row[1]), []).append(tuple(row)[2:])
                else:
                    rest.append(tuple(row))
            out, newest = [], None
            for one, found in ready.items():
                last = self.last.getValue(one)
                for at, _, status in sorted(found):
                    if last is not None and last[1] != status and at - last[0] <= expire_ms * 1000:
                        out.append((*one, pd.Timestamp(at, unit="us"), last[1], status))
                    last = (at, status)
                self.last.updateValue(one, last)
                newest = last[0] if newest is None else max(newest, last[0])
            if ready:
                if rest:
                    self.waiting.put(rest)
                else:
                    self.waiting.clear()
            if rest:
                self.handle.registerTimer(-(-min(r[2] for r in rest) // 1000))
            self._forget(passed, newest)
            yield pd.DataFrame(out, columns=["context_set", "evidence_id", "observed_at", "before", "after"])

        def _forget(self, passed, newest):
            """Drops statuses that no row that may still come is near enough to compare; a sweep is due when the newest kept is that old."""
            gone = lambda at: -(-at // 1000) + expire_ms + 1
            due = self.sweep.get()[0] if self.sweep.exists() else None
            if due is not None and due <= passed:
                kept = [(tuple(k), v[0]) for k, v in self.last.iterator()]
                for one, at in kept:
                    if gone(at) <= passed:
                        self.last.removeKey(one)
                newest, due = max((at for _, at in kept if gone(at) > passed), default=None), None
                if newest is None:
                    self.sweep.clear()
            if due is None and newest is not None:
                due = max(gone(newest), passed + 1)
                self.sweep.update((due,))
                self.handle.registerTimer(due)

        def close(self):
            pass

    return InOrder()


def status_transitions(contexts: DataFrame, evidence: DataFrame, delay: str = "1 hour", expire_days: int = 30, buckets: int = BUCKETS) -> DataFrame:
    """Stream of ``contexts(context_set, observed_at, sequence, repository, revision, work, path)``
    against static evidence; one row whenever the status of an evidence changes.

    Status is computed by built-in expressions before the stateful step, which only compares neighbours.  Rows are
    compared in the order of (observed_at, sequence), once the watermark has passed them: the answer does not depend on triggers
    or on the order of files, as long as no row is later than ``delay``, and rows within ``delay`` of the newest are not
    decided yet.  A status more than ``expire_days`` older than the next one is forgotten.  State is the rows within the delay
    and one status per evidence, in ``buckets`` of evidence, so a task holds the waiting rows of one bucket; it needs a session of ``sinks.stateful_session``.
    """
    moving = contexts.withWatermark("observed_at", delay).select(
        "context_set", "observed_at", "sequence", *[F.col(f).alias(f"_ctx_{f}") for f in CONTEXT_FIELDS]
    )
    statuses = moving.join(evidence, "context_set").select(
        "context_set", "evidence_id", "observed_at", "sequence",
        overall_status(fields(""), fields("_ctx_")).alias("status"),
    )
    bucketed = statuses.withColumn("_bucket", F.pmod(F.xxhash64("context_set", "evidence_id"), F.lit(buckets)))
    return bucketed.groupBy("_bucket").transformWithStateInPandas(
        _processor(expire_days * 86_400_000), OUTPUT, "append", "EventTime"
    )
