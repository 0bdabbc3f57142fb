"""Order-dependent alert logic, fed row by row in time order."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle

# executors get these few functions with the task, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PACED_DDL = "owner string, msg_id bigint, group_key string, shown_at bigint, folded bigint"
PACED_COLUMNS = ["owner", "msg_id", "group_key", "shown_at", "folded"]


class Pacer:
    """Pacing of one owner: at most one alert per interval, the rest waits in a short queue.

    A queue longer than its bound loses its oldest entry. When the queue drains, entries of the
    same account and folder fold into one alert with a count.
    """

    def __init__(self, interval: int, queue_max: int, last=None, drain_at=None, queue=()):
        self.interval, self.queue_max = interval, queue_max
        self.last, self.drain_at, self.queue = last, drain_at, list(queue)

    def drain_until(self, now) -> list:
        """Alerts the timer shows up to ``now``; an alert that lost its message is skipped."""
        shown = []
        while self.queue and self.drain_at is not None and self.drain_at <= now:
            msg_id, group, eligible = self.queue.pop(0)
            if eligible:
                same = [q for q in self.queue if q[1] == group]
                self.queue = [q for q in self.queue if q[1] != group]
                self.last = self.drain_at
                shown.append((msg_id, group, self.drain_at, 1 + sum(bool(q[2]) for q in same)))
            self.drain_at += self.interval
        if not self.queue:
            self.drain_at = None
        return shown

    def offer(self, now: int, msg_id: int, group: str, eligible: bool) -> list:
        if self.last is None or now - self.last >= self.interval:
            self.last = now
            return [(msg_id, group, now, 1)]
        self.queue = [*self.queue, (msg_id, group, eligible)][-self.queue_max:]
        if self.drain_at is None:
            self.drain_at = self.last + self.interval
        return []


class Wait:
    """One message: an alert waits for a delay and is shown if the message has not gone meanwhile.

    Where the message is holds for ``keep`` from when it was told; after that it counts as still there.
    What falls due at the time of an event is settled before the event.
    """

    def __init__(self, delay: int, keep: int, requested=None, place_at=None, gone=None):
        self.delay, self.keep, self.requested, self.place_at, self.gone = delay, keep, requested, place_at, gone

    def settle(self, now: int) -> list:
        """The request and the time of the alert that is due by ``now``, if it is shown."""
        if self.requested is None or self.requested + self.delay > now:
            return []
        asked, due, self.requested = self.requested, self.requested + self.delay, None
        gone = self.place_at is not None and self.gone and due - self.place_at <= self.keep
        return [] if gone else [(asked, due)]

    def alert(self, at: int) -> list:
        shown = self.settle(at)
        self.requested = at if self.requested is None else self.requested
        return shown

    def moved(self, at: int, gone: bool) -> list:
        shown = self.settle(at)
        self.place_at, self.gone = at, gone
        return shown

    def forget(self, now: int) -> None:
        """Drop a place that can no longer hide an alert; what is due by ``now`` is settled already."""
        if self.place_at is not None and self.place_at + self.keep < now:
            self.place_at = self.gone = None


def pace_sorted(interval: int, queue_max: int):
    """Pace the stretches of a partition sorted by owner, stretch and time."""
    def run(batches):
        current, pacer = None, None
        for pdf in batches:
            out = []
            for owner, segment, at, msg_id, group, eligible in pdf[
                    ["owner", "segment", "at_ms", "msg_id", "group_key", "eligible"]].itertuples(index=False):
                if (owner, segment) != current:
                    if pacer is not None:
                        out += [(current[0], *s) for s in pacer.drain_until(float("inf"))]
                    current, pacer = (owner, segment), Pacer(interval, queue_max)
                out += [(owner, *s) for s in pacer.drain_until(at)]
                out += [(owner, *s) for s in pacer.offer(int(at), int(msg_id), group, bool(eligible))]
            yield pd.DataFrame(out, columns=PACED_COLUMNS)
        if pacer is not None:
            yield pd.DataFrame([(current[0], *s) for s in pacer.drain_until(float("inf"))], columns=PACED_COLUMNS)
    return run


def keep_after_wait(delay: int):
    """Keep the first time of every wait; input sorted by message, stretch and time."""
    def run(batches):
        current, last = None, None
        for pdf in batches:
            keep = []
            for msg_id, segment, at in pdf[["msg_id", "segment", "at_ms"]].itertuples(index=False):
                fresh = (msg_id, segment) != current or at >= last + delay
                if fresh:
                    current, last = (msg_id, segment), at
                keep.append(fresh)
            yield pdf.loc[keep, ["msg_id", "at_ms"]]
    return run
