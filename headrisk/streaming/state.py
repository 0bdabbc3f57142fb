"""Keyed state of the alert streams.

Events are kept until the watermark has passed them and are then taken in the order of their times, so results depend neither on the borders
of micro-batches nor on the order of arrival. Whatever can no longer change a result is cleared: a key without recent events keeps no state.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from headrisk.functions.pacing import Pacer, Wait

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PENDING_DDL = "msg_id bigint, at_ms bigint"
DELAYED_DDL = "msg_id bigint, requested_at bigint, shown_at bigint"
PACED_STREAM_DDL = "owner string, msg_id bigint, group_key string, shown_at bigint, folded bigint"
JUNK_LIKE = ("junk", "trash", "spam")
ALERT, MOVED, GONE = 2, 0, 1


def millis(column) -> list:
    return [int(t.timestamp() * 1000 + 0.5) if t.tzinfo else int(pd.Timestamp(t, tz="UTC").timestamp() * 1000 + 0.5)
            for t in column]


class PendingAlert(StatefulProcessor):
    """One message: requests that the watermark has not passed, and the one that waits."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.requests = handle.getListState("requests", "at bigint")
        self.waiting = handle.getValueState("waiting", "at bigint")

    def handleInputRows(self, key, rows, timerValues):
        for requests in rows:
            at = sorted(set(millis(requests["assessed_at"])))
            self.requests.appendList([(t,) for t in at])
            for t in at:
                self.handle.registerTimer(t)
        yield pd.DataFrame({"msg_id": [], "at_ms": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted({int(at) for (at,) in self.requests.get()})
        last, kept = int(self.waiting.get()[0]) if self.waiting.exists() else None, []
        for at in held:
            if at <= now and (last is None or at >= last + self.delay_ms):
                last = at
                kept.append((key[0], at))
        later = [(at,) for at in held if at > now]
        if later:
            self.requests.put(later)
        else:
            self.requests.clear()
        if last is not None and last + self.delay_ms > now:
            self.waiting.update((last,))
            self.handle.registerTimer(last + self.delay_ms)
        else:
            self.waiting.clear()
        yield pd.DataFrame(kept, columns=["msg_id", "at_ms"])

    def close(self) -> None:
        pass


class DelayedAlert(StatefulProcessor):
    """One message: events that the watermark has not passed, the alert that waits, and where the message was last."""

    def __init__(self, delay_ms: int, keep_ms: int):
        self.delay_ms, self.keep_ms = delay_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "at bigint, kind int")
        self.wait = handle.getValueState("wait", "requested bigint, place_at bigint, gone boolean")

    def handleInputRows(self, key, rows, timerValues):
        for events in rows:
            at = millis(events["at"])
            gone = (events["kind"] == "deleted") | events["junk"].fillna(False).astype(bool) | events["folder_type"].isin(JUNK_LIKE)
            kinds = [ALERT if kind == "alert" else GONE if g else MOVED for kind, g in zip(events["kind"], gone)]
            self.events.appendList(list(zip(at, kinds)))
            for t in set(at):
                self.handle.registerTimer(t)
        yield pd.DataFrame({"msg_id": [], "requested_at": [], "shown_at": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted((int(at), int(kind)) for at, kind in self.events.get())
        wait = Wait(self.delay_ms, self.keep_ms, *(self.wait.get() if self.wait.exists() else ()))
        shown = []
        for at, kind in held:
            if at <= now:
                shown += wait.alert(at) if kind == ALERT else wait.moved(at, kind == GONE)
        shown += wait.settle(now)
        self._save(wait, [e for e in held if e[0] > now], now)
        yield pd.DataFrame([(key[0], *s) for s in shown], columns=["msg_id", "requested_at", "shown_at"])

    def _save(self, wait: Wait, later: list, now: int) -> None:
        if later:
            self.events.put(later)
        else:
            self.events.clear()
        wait.forget(now)
        if wait.requested is None and wait.place_at is None:
            self.wait.clear()
            return
        self.wait.update((wait.requested, wait.place_at, wait.gone))
        if wait.requested is not None:
            self.handle.registerTimer(wait.requested + self.delay_ms)
        if wait.place_at is not None:
            self.handle.registerTimer(wait.place_at + self.keep_ms + 1)

    def close(self) -> None:
        pass


class PacedAlerts(StatefulProcessor):
    """One owner: alerts that the watermark has not passed, when one was shown last, and the alerts that wait."""

    def __init__(self, interval_ms: int, queue_max: int):
        self.interval_ms, self.queue_max = interval_ms, queue_max

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alerts = handle.getListState("alerts", "at bigint, msg_id bigint, group_key string, eligible boolean")
        self.clock = handle.getValueState("clock", "last bigint, drain_at bigint")
        self.queue = handle.getListState("queue", "msg_id bigint, group_key string, eligible boolean")

    def handleInputRows(self, key, rows, timerValues):
        for alerts in rows:
            at = millis(alerts["at"])
            self.alerts.appendList([(t, int(m), g, bool(e)) for t, m, g, e in zip(at, alerts["msg_id"], alerts["group_key"], alerts["eligible"])])
            for t in set(at):
                self.handle.registerTimer(t)
        yield self._frame(key[0], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        last, drain_at = self.clock.get() if self.clock.exists() else (None, None)
        pacer = Pacer(self.interval_ms, self.queue_max, last, drain_at, [tuple(q) for q in self.queue.get()])
        held = sorted((tuple(a) for a in self.alerts.get()), key=lambda a: a[:2])
        shown = []
        for at, msg_id, group, eligible in held:
            if at <= now:
                shown += pacer.drain_until(at)
                shown += pacer.offer(at, msg_id, group, eligible)
        shown += pacer.drain_until(now)
        self._save(pacer, [a for a in held if a[0] > now], now)
        yield self._frame(key[0], shown)

    def _save(self, pacer: Pacer, later: list, now: int) -> None:
        for state, rows in ((self.alerts, later), (self.queue, [tuple(q) for q in pacer.queue])):
            if rows:
                state.put(rows)
            else:
                state.clear()
        if pacer.queue:
            self.clock.update((pacer.last, pacer.drain_at))
            self.handle.registerTimer(int(pacer.drain_at))
        elif pacer.last is not None and pacer.last + self.interval_ms > now:
            self.clock.update((pacer.last, None))
            self.handle.registerTimer(int(pacer.last) + self.interval_ms)
        else:
            self.clock.clear()

    @staticmethod
    def _frame(owner, shown) -> pd.DataFrame:
        return pd.DataFrame([(owner, *s) for s in shown], columns=["owner", "msg_id", "group_key", "shown_at", "folded"])

    def close(self) -> None:
        pass
