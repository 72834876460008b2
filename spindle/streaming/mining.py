"""Process mining over a stream of transitions: each case keeps its own state, settled as the watermark passes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from spindle.operators import changes
from spindle.sources import tables

EVENT = "transition_id string, case_id string, entity_type string, entity_id string, from_state string, activity string, reason string, occurred_at timestamp, source_commit_at timestamp, previous_event_at timestamp, event_index int, seconds_since_previous long"
_COLUMNS = [c.split()[0] for c in EVENT.split(", ")]
_ORDER = ["occurred_at", "source_commit_at", "transition_id"]
#: State store that keeps what doesn't fit in memory on disk; stateful processors need it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _micros(at) -> int | None:
    return None if at is None or at is pd.NaT else at.value // 1000 if isinstance(at, pd.Timestamp) else int(pd.Timestamp(at).value // 1000)


class CaseEvents(StatefulProcessor):
    """Numbers the events of a case as they come, in the order of their times.

    State: how many events are settled and the time of the last, and the events after the watermark, which later ones
    may still precede. A timer at the earliest of these settles all that the watermark has passed, so that
    the state of a case is as long as events may be late. An event that comes again while it is open changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "n long, last_us long")
        self.open = handle.getListState("open", "transition_id string, from_state string, activity string, reason string, occurred_us long, commit_us long")

    def _settled(self) -> tuple[int, int | None]:
        held = self.settled.get() if self.settled.exists() else None
        return (0, None) if held is None else (held[0], held[1])

    def _waiting(self) -> list[tuple]:
        """Open events in order: (occurred, commit, id), from, activity, reason."""
        return self._sorted([((v[4], v[5], v[0]), v[1], v[2], v[3]) for v in self.open.get()] if self.open.exists() else [])

    @staticmethod
    def _sorted(rows: list[tuple]) -> list[tuple]:
        return sorted(rows, key=lambda r: (r[0][0], r[0][1] is not None, r[0][1] or 0, r[0][2]))

    def _keep(self, waiting: list[tuple]) -> None:
        """Open events are read and written as one list, since each call on a state is a message between processes."""
        if waiting:
            self.open.put([(i, source, activity, reason, at, commit) for (at, commit, i), source, activity, reason in waiting])
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = self._waiting()
        known = {r[0][2] for r in waiting}
        kind = ident = None
        first = None
        for frame in rows:
            for r in frame.itertuples(index=False):
                kind, ident = r.entity_type, r.entity_id
                if r.transition_id in known:
                    continue
                known.add(r.transition_id)
                at = _micros(r.occurred_at)
                text = [None if v is None or v != v else v for v in (r.from_state, r.to_state, r.reason)]
                waiting.append(((at, _micros(r.source_commit_at), r.transition_id), *text))
                first = at if first is None else min(first, at)
        if first is None:
            return
        n, last = self._settled()
        out, waiting = [], self._sorted(waiting)
        self._keep(waiting)
        for (at, commit, transition), source, activity, reason in waiting:
            n += 1
            if at >= first:  # events before the first new one keep their numbers and neighbours
                out.append((transition, key[0], kind, ident, source, activity, reason, pd.Timestamp(at, unit="us"), pd.NaT if commit is None else pd.Timestamp(commit, unit="us"), pd.NaT if last is None else pd.Timestamp(last, unit="us"), n, None if last is None else _seconds(last, at)))
            last = at
        self.handle.registerTimer(waiting[0][0][0] // 1000 + 1)
        frame = pd.DataFrame(out, columns=_COLUMNS)
        frame["seconds_since_previous"] = frame["seconds_since_previous"].astype("Int64")
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        n, last = self._settled()
        waiting = self._waiting()
        gone = sum(at <= passed * 1000 for (at, *_), *_ in waiting)
        if gone:
            self.settled.update((n + gone, waiting[gone - 1][0][0]))
            self._keep(waiting[gone:])
        else:
            self.settled.update((n, last))
        if waiting[gone:]:
            self.handle.registerTimer(waiting[gone][0][0] // 1000 + 1)
        return iter(())

    def close(self) -> None:
        pass


def _seconds(start: int, end: int) -> int:
    """Whole seconds between times in microseconds."""
    return int((end - start) / 1_000_000)


def event_updates(transitions: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows of the event log that are new or have a new number or neighbour, as the stream ``transitions`` comes.

    Needs transition_id (string), entity_type, entity_id, from_state, to_state, reason, occurred_at, source_commit_at. The
    last row given for a transition counts. Events without time or entity belong to no case and are left out, as are events
    that come later than ``late``. The session's state store must be ``STORE``.
    """
    rows = transitions.filter("occurred_at IS NOT NULL AND entity_type IS NOT NULL AND entity_id IS NOT NULL").withWatermark("occurred_at", late)
    by_case = rows.withColumn("case_id", F.concat("entity_type", F.lit(":"), "entity_id")).groupBy("case_id")
    return by_case.transformWithStateInPandas(CaseEvents(), EVENT, "Update", "EventTime")


def mine_stream(transitions: DataFrame, root: str, name: str, checkpoint: str, late: str = "1 hour", parts: int = 64) -> StreamingQuery:
    """Keeps table ``name`` the event log of all that has come: each batch's rows are merged by their case's part. Runs until the source is read up.

    A batch that is run again merges the same rows into the same places. ``process.case_summary`` and
    ``transition_summary`` of the table are those of the batch.
    """
    part = F.pmod(F.xxhash64("case_id"), F.lit(parts))

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                tables.merge_into(batch, root, name, lambda old, new: changes.upsert(old, new, ["case_id", "transition_id"]), ["case_id", "transition_id"], part, True)
        finally:
            batch.unpersist()

    return event_updates(transitions, late).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
