"""Stateful stream processors that take the events of a key in time order, whatever order they arrive in."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from placeweave.functions.numbers import micros

#: Events wait in slots of so many milliseconds; one is read and removed as a whole once the watermark has passed it.
SLOT_MS = 60_000


class InOrder(StatefulProcessor):
    """Buffers events per slot of time and hands them to ``event`` in order of (time, id).

    State of a key is a map of slots that the watermark has not passed, and one value of ``memory``. A batch
    touches only the slots of its own rows, and a timer only those that are over, so a busy key is not copied in and out
    as a whole. ``passed`` may forget the memory; then the key leaves no state.
    """

    def __init__(self, key, columns):
        self.key, self.columns = key, columns

    def init(self, handle):
        self.handle = handle
        self.memory = handle.getValueState("memory", "at bigint, id bigint")
        self.slots = handle.getMapState("slots", "slot bigint", "stamps array<bigint>, ids array<bigint>")

    def handleInputRows(self, key, rows, timerValues):
        found = {}
        for batch in rows:
            for at, event in zip(batch["micros"].tolist(), batch["event_id"].tolist()):
                found.setdefault(at // (SLOT_MS * 1000), []).append((at, event))
        for slot, events in found.items():
            known = [[], []]
            if self.slots.containsKey((slot,)):
                known = [list(x) for x in self.slots.getValue((slot,))]
            else:
                self.handle.registerTimer((slot + 1) * SLOT_MS)
            self.slots.updateValue((slot,), (known[0] + [e[0] for e in events], known[1] + [e[1] for e in events]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        floor = timerValues.getCurrentWatermarkInMs() // SLOT_MS
        out = []
        for slot in sorted(s[0] for s in self.slots.keys() if s[0] < floor):
            stamps, ids = self.slots.getValue((slot,))
            self.slots.removeKey((slot,))
            for at, event in sorted(zip(stamps, ids)):
                out += self.event(at, event)
        out += self.passed(floor * SLOT_MS * 1000)
        yield pd.DataFrame([(key[0], *row) for row in out], columns=self.columns)

    def wake(self, at_us):
        """Call ``passed`` again once the watermark has left ``at_us`` behind."""
        self.handle.registerTimer((at_us // (SLOT_MS * 1000) + 1) * SLOT_MS)

    def event(self, at, event):
        raise NotImplementedError

    def passed(self, floor_us):
        raise NotImplementedError

    def close(self):
        pass


class Fresh(InOrder):
    """Memory is the last miss, kept as long as an event can still fall within its lifetime."""

    def __init__(self, key, ttl_us):
        super().__init__(key, [key, "event_id", "micros", "hit"])
        self.ttl_us = ttl_us

    def event(self, at, event):
        hit = self.memory.exists() and at - self.memory.get()[0] <= self.ttl_us
        if not hit:
            self.memory.update((at, event))
            self.wake(at + self.ttl_us)
        return [(event, at, hit)]

    def passed(self, floor_us):
        if self.memory.exists() and self.memory.get()[0] + self.ttl_us < floor_us:
            self.memory.clear()
        return []


class Quiet(InOrder):
    """Memory is the newest event, which leaves if none follows within the delay."""

    def __init__(self, key, delay_us):
        super().__init__(key, [key, "event_id", "micros"])
        self.delay_us = delay_us

    def event(self, at, event):
        out = []
        if self.memory.exists():
            last, name = self.memory.get()
            if at - last > self.delay_us:
                out.append((name, last))
        self.memory.update((at, event))
        self.wake(at + self.delay_us)
        return out

    def passed(self, floor_us):
        if self.memory.exists():
            last, name = self.memory.get()
            if last + self.delay_us < floor_us:
                self.memory.clear()
                return [(name, last)]
        return []


def processed(events: DataFrame, key: str, processor: InOrder, schema: str, lateness: str) -> DataFrame:
    """The stream of ``processor`` over (key, event_id, ts). Sessions need the RocksDB state store."""
    kind = dict(events.dtypes)[key]
    marked = events.select(key, "event_id", "ts", micros(events["ts"]).alias("micros")).withWatermark("ts", lateness)
    return marked.groupBy(key).transformWithStateInPandas(
        processor, f"{key} {kind}, event_id bigint, micros bigint{schema}", "Append", "EventTime"
    )
