"""Monitoring folds on state variables and event-time timers, kept in the RocksDB store.

No batch of a key is gathered. Rows come one by one in any order; what has to be judged in time order waits in the store
until the watermark has passed it, and a timer calls for it.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: How a host stands to its site: the lead, one whose alerts the lead's replace, one that is only seen through the lead.
LEAD, REPLACED, THROUGH = 0, 1, 2


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, as state variables with timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class TickFold(StatefulProcessor):
    """Ticks of a key in time order: fold(memory, at_s, values) -> (memory, rows without the key).

    A tick waits under its time; a timer at that time, which fires when the watermark has passed it, folds it. Ticks of one
    time are joined by `both`. Timers fire in the order of their times.
    """

    def __init__(self, key: str, values: list[str], kinds: str, memory: str, start: tuple, fold: Callable, both: Callable, out: str):
        self.values, self.kinds, self.memory_kind, self.start, self.fold, self.both = values, kinds, memory, start, fold, both
        self.row = Row(key, "at_s", out)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at_s long", self.kinds)
        self.memory = handle.getValueState("memory", self.memory_kind)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            own, at = tuple(r[v] for v in self.values), (r["at_s"],)
            held = self.waiting.getValue(at)
            self.waiting.updateValue(at, own if held is None else self.both(tuple(held), own))
            if held is None:
                self.handle.registerTimer(r["at_s"] * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs() // 1000
        values = self.waiting.getValue((at,))
        self.waiting.removeKey((at,))
        memory, rows = self.fold(tuple(self.memory.get()) if self.memory.exists() else self.start, at, tuple(values))
        self.memory.update(memory)
        for r in rows:
            yield self.row(*key, at, *r)

    def close(self) -> None:
        pass


def folded(ticks: DataFrame, key: str, values: list[str], kinds: str, memory: str, start: tuple, fold: Callable, both: Callable, out: str) -> DataFrame:
    """TickFold over a stream of (key, at_s, values); ticks at or behind the watermark are late and dropped."""
    d = ticks.select(key, "at_s", *values, F.timestamp_seconds("at_s").alias("_time")).withWatermark("_time", "0 seconds")
    return d.groupBy(key).transformWithState(TickFold(key, values, kinds, memory, start, fold, both, out.split()[0]), f"{key} long, at_s long, {out}", "append", "EventTime")


def stall_counter(ticks: DataFrame, key: str, grew: int) -> DataFrame:
    """ticks(key, at_s, size_n, done_n) -> how many ticks in a row the size grew by `grew` while nothing was done; progress or a
    smaller size resets, a quiet tick holds. Of two ticks of one time the larger size and the larger number done count."""

    def fold(memory, at, values):
        size, done, n = memory
        now, finished = values
        if size is None or now < size or finished != done:
            n = 0
        elif now - size >= grew:
            n += 1
        return (now, finished, n), [(n,)]

    both = lambda a, b: tuple(max(x, y) for x, y in zip(a, b))
    return folded(ticks, key, ["size_n", "done_n"], "size_n long, done_n long", "size_n long, done_n long, n long", (None, None, 0), fold, both, "stalled long")


def fix_budget(ticks: DataFrame, key: str, window_s: int, budget: int) -> DataFrame:
    """ticks(key, at_s, faulty) -> `fix` (at most `budget` in a window), one `escalate` when the budget is spent, and on the next
    healthy tick `recover`, or `recover-after-escalation`. Of two ticks of one time a faulty one counts."""

    def fold(memory, at, values):
        fixes, last = [x for x in memory[0] if x >= at - window_s], memory[1]
        if values[0]:
            if len(fixes) < budget:
                return ([*fixes, at], "fix"), [("fix",)]
            return (fixes, "escalate"), [] if last == "escalate" else [("escalate",)]
        said = {"fix": "recover", "escalate": "recover-after-escalation"}.get(last)
        return (fixes, None if said else last), [(said,)] if said else []

    both = lambda a, b: (max(a[0], b[0]),)
    return folded(ticks, key, ["faulty"], "faulty int", "fixes array<long>, last string", ([], None), fold, both, "verdict string")


def cover(lo: list[int], hi: list[int], t: int, budget: int) -> None:
    """Add [t, t + budget] to sorted disjoint stretches; the order in which readings come does not matter."""
    i, j = bisect.bisect_left(hi, t), bisect.bisect_right(lo, t + budget)
    start, end = (min(t, lo[i]), max(t + budget, hi[j - 1])) if i < j else (t, t + budget)
    lo[i:j], hi[i:j] = [start], [end]


class SiteHeartbeat(StatefulProcessor):
    """Readings of the hosts of a site -> alerts. Of each host the store holds the stretches that its readings cover, its own
    state and the one shown; edges are judged in time order, up to the watermark."""

    def __init__(self, key: str):
        self.row = Row(key, "host", "at_s", "state")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hosts = handle.getMapState("hosts", "host long", "role int, lo array<long>, hi array<long>, down boolean, shown boolean")
        self.judged = handle.getValueState("judged", "at_s long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known: dict[int, list] = {}
        for r in rows:
            if r["host"] not in known:
                held = self.hosts.getValue((r["host"],))
                known[r["host"]] = [held[0], list(held[1]), list(held[2]), held[3], held[4]] if held else [r["role"], [], [], False, False]
            cover(known[r["host"]][1], known[r["host"]][2], r["at_s"], r["budget"])
        for host, own in known.items():
            self.hosts.updateValue((host,), tuple(own))
        return self.settle(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self.settle(key, timerValues)

    def settle(self, key, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        judged = self.judged.get()[0] if self.judged.exists() else -1
        hosts = {k[0]: [v[0], list(v[1]), list(v[2]), v[3], v[4]] for k, v in self.hosts.iterator()}
        edges, ahead = [], []
        for host, (_, lo, hi, _, _) in hosts.items():
            for t, down in (*((t, True) for t in hi), *((t, False) for t in lo)):
                if t > now:
                    ahead.append(t)
                elif t > judged:
                    edges.append((t, host, down))
        edges.sort()
        out, at = [], 0
        while at < len(edges):
            t = edges[at][0]
            while at < len(edges) and edges[at][0] == t:
                hosts[edges[at][1]][3] = edges[at][2]
                at += 1
            out += [self.row(*key, host, t, said) for host, said in shown(hosts)]
        for host, own in hosts.items():
            last = bisect.bisect_right(own[2], now)  # what ended before the watermark is judged; it is only remembered as down
            own[1], own[2] = own[1][last:], own[2][last:]
            self.hosts.updateValue((host,), tuple(own))
        self.judged.update((max(now, judged),))
        if ahead:
            self.handle.registerTimer(min(ahead) * 1000)
        return iter(out)

    def close(self) -> None:
        pass


def shown(hosts: dict[int, list]) -> list[tuple[int, str]]:
    """Judge a site once: set the shown state of each host (role, _, _, down, shown) and tell the changes.

    While a lead is down, its alert stands for those it replaces, whose own are dropped without a recovery; what is seen through
    it is unknown and stays as it was."""
    dark = any(role == LEAD and down for role, _, _, down, _ in hosts.values())
    out = []
    for host, own in sorted(hosts.items()):
        role, _, _, down, before = own
        if dark and role == REPLACED:
            own[4] = False
        elif not (dark and role == THROUGH):
            own[4] = down
            if down != before:
                out.append((host, "down" if down else "up"))
    return out


def heartbeat(readings: DataFrame, key: str, late: str) -> DataFrame:
    """readings(key = site, host, role, budget, at_s) -> (site, host, at_s, state): `down` when a host has been silent for longer than its
    own budget, `up` when it reports again, as the site's lead lets it be seen."""
    d = readings.select(key, "host", "role", "budget", "at_s", F.timestamp_seconds("at_s").alias("_time")).withWatermark("_time", late)
    return d.groupBy(key).transformWithState(SiteHeartbeat(key), f"{key} long, host long, at_s long, state string", "append", "EventTime")
