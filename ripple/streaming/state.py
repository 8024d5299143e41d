"""Streaming forms with state by key: one unit per commit pair, the newest unit of a group, and the wait for a base graph.

Each emits a row whenever its answer for a unit changes, with numbers that grow; ``latest`` keeps the last one. The answers do not depend
on how the input is cut into batches. State lies in RocksDB and is a few values per key (and a short row per live unit).
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ripple.streaming.events import BASE_WAIT, DELIVERY_MEMORY

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Units are forgotten when the watermark passes their last delivery by so many milliseconds; timers are set to whole days.
DAY_MS = 24 * 3600 * 1000
MEMORY_MS = 30 * DAY_MS

UNIT = "unit_id string, trigger string, pr_number long, delivery_id string, received_us long"
TRIPLE = "repo_id long, base_sha string, head_sha string"
FIRST = f"{TRIPLE}, {UNIT}, last_us long, revision long, gone boolean"
FLAG = f"{TRIPLE}, unit_id string, superseded boolean, revision long, step long"
OUTCOME = f"{TRIPLE}, unit_id string, outcome string"


def _only(state):
    return state.get() if state.exists() else None


def _expiry(last_us: int) -> int:
    return -(-(last_us // 1000 + MEMORY_MS) // DAY_MS) * DAY_MS


class FirstUnit(StatefulProcessor):
    """Key (repo, base, head): the unit delivered first, and when it was delivered last."""

    def init(self, handle):
        self.handle = handle
        self.first = handle.getValueState("first", f"{UNIT}, last_us long, revision long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = old = _only(self.first)
        unit = tuple(held[:5]) if held else None
        last, revision = (held[5], held[6]) if held else (0, 0)
        for r in rows:
            new = (r.unit_id, r.trigger, r.pr_number, r.delivery_id, r.received_us)
            if unit is None or (new[4], new[3]) < (unit[4], unit[3]):
                unit = new
            last = max(last, r.received_us)
        if old and tuple(old[:5]) == unit and old[5] == last:
            return
        revision += 1
        self.first.update((*unit, last, revision))
        self.handle.registerTimer(_expiry(last))
        row = lambda u, gone: Row(*FIELDS)(*key, *u, last, revision, gone)
        if old and tuple(old[1:3]) != unit[1:3]:  # it now belongs to another pull request or stream
            yield row(tuple(old[:5]), True)
        yield row(unit, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = _only(self.first)
        if held and _expiry(held[5]) <= timerValues.getCurrentWatermarkInMs():
            self.first.clear()
        return iter(())

    def close(self):
        pass


FIELDS = ["repo_id", "base_sha", "head_sha", "unit_id", "trigger", "pr_number", "delivery_id", "received_us", "last_us", "revision", "gone"]


class NewestUnit(StatefulProcessor):
    """Key (repo, trigger, pull request): every unit but the one delivered last is superseded."""

    def init(self, handle):
        self.handle = handle
        self.marks = handle.getMapState("marks", "base_sha string, head_sha string", "last_us long, unit_id string, revision long, gone boolean")
        self.newest = handle.getValueState("newest", "last_us long, base_sha string, head_sha string, step long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """State is asked once for every pair of a batch and told once; flags are emitted as they stand at its end."""
        held = _only(self.newest)
        was, step = (tuple(held[:3]), held[3]) if held else (None, 0)
        old, new, expiries = {}, {}, set()
        for r in rows:
            pair = (r.base_sha, r.head_sha)
            expiries.add(_expiry(r.last_us))
            if pair not in old:
                found = self.marks.getValue(pair) if self.marks.containsKey(pair) else None
                old[pair] = tuple(found) if found is not None else None
            known = new.get(pair, old[pair])
            if known is None or known[2] < r.revision:
                new[pair] = (r.last_us, r.unit_id, r.revision, bool(r.gone))  # those gone are remembered, as older rows may come later
        for expiry in expiries:
            self.handle.registerTimer(expiry)
        if not new:
            return
        for pair, mark in new.items():
            self.marks.updateValue(pair, mark)
        live = [(m[0], *pair) for pair, m in new.items() if not m[3]]
        if was and was[1:] in new and (new[was[1:]][3] or new[was[1:]][0] < was[0]):  # the newest one has left the group
            newest = max(((m[0], *pair) for pair, m in self.marks.iterator() if not m[3]), default=None)
        else:
            newest = max(live + ([was] if was else []), default=None)
        told = {pair: m for pair, m in new.items() if not m[3]}
        for other in (was, newest):
            if other and (was is None or newest is None or was[1:] != newest[1:]) and other[1:] not in new:
                told[other[1:]] = tuple(self.marks.getValue(other[1:]))
        for pair, mark in told.items():
            step += 1
            yield Row("repo_id", "base_sha", "head_sha", "unit_id", "superseded", "revision", "step")(key[0], *pair, mark[1], pair != newest[1:], mark[2], step)
        if newest:
            self.newest.update((*newest, step))
        elif held:
            self.newest.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, held = timerValues.getCurrentWatermarkInMs(), _only(self.newest)
        for pair in [k for k, v in self.marks.iterator() if _expiry(v[0]) <= now and (not held or tuple(held[1:3]) != tuple(k))]:
            self.marks.removeKey(pair)
        return iter(())

    def close(self):
        pass


class BaseWait(StatefulProcessor):
    """Key (repo, base): units meet the first moment at which their base was usable, or fail when their time is over."""

    def init(self, handle):
        self.handle = handle
        self.usable = handle.getValueState("usable", "at_us long")
        self.waiting = handle.getMapState("waiting", "head_sha string", "unit_id string, deadline_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = _only(self.usable)
        usable = held[0] if held else None
        for r in rows:
            if r.unit_id is None:
                usable = r.at_us if usable is None else min(usable, r.at_us)
            elif usable is not None and usable <= r.deadline_us:
                yield self._row(key, r.head_sha, r.unit_id, "use")
            else:
                self.waiting.updateValue((r.head_sha,), (r.unit_id, r.deadline_us))
                self.handle.registerTimer(-(-r.deadline_us // 1000))
        if usable is not None and (held is None or usable < held[0]):
            self.usable.update((usable,))
            yield from self._ended(key, lambda deadline: usable <= deadline, "use")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        yield from self._ended(key, lambda deadline: deadline <= now, "failed")

    def _ended(self, key, over, outcome):
        for (head,), (unit, deadline) in [x for x in self.waiting.iterator() if over(x[1][1])]:
            self.waiting.removeKey((head,))
            yield self._row(key, head, unit, outcome)

    def _row(self, key, head, unit, outcome):
        return Row("repo_id", "base_sha", "head_sha", "unit_id", "outcome")(*key, head, unit, outcome)

    def close(self):
        pass


def first_units(units: DataFrame) -> DataFrame:
    """Changes of the first unit of each (repo, base, head); ``gone`` rows take a unit out of a group that it has left."""
    rows = units.select("repo_id", "base_sha", "head_sha", "unit_id", "trigger", F.col("pr_number").cast("long").alias("pr_number"), "delivery_id",
                        F.unix_micros("received_at").alias("received_us"), F.col("received_at").alias("seen")).withWatermark("seen", DELIVERY_MEMORY)
    return rows.groupBy("repo_id", "base_sha", "head_sha").transformWithState(FirstUnit(), FIRST, "Update", "EventTime")


def newest_units(changes: DataFrame) -> DataFrame:
    """Changes of the superseded flag, from the rows of ``first_units``."""
    rows = changes.withColumn("seen", F.timestamp_micros("last_us")).withWatermark("seen", DELIVERY_MEMORY)
    return rows.groupBy("repo_id", "trigger", "pr_number").transformWithState(NewestUnit(), FLAG, "Update", "EventTime")


def awaited(units: DataFrame, log: DataFrame, late: str, wait: str = BASE_WAIT) -> DataFrame:
    """``use`` or ``failed`` of each unit, once; a unit that still waits has no row.

    ``units``: repo_id, base_sha, head_sha, unit_id, received_at; ``log``: repo_id, sha, status, at. Rows may come ``late`` by so much event
    time; a unit fails when the watermark passes its deadline and its base was not usable until then.
    """
    none = lambda kind: F.lit(None).cast(kind)
    u = units.select("repo_id", "base_sha", "head_sha", "unit_id", F.unix_micros(F.col("received_at") + F.expr(f"INTERVAL {wait}")).alias("deadline_us"),
                     none("long").alias("at_us"), F.col("received_at").alias("seen")).withWatermark("seen", late)
    v = log.filter(F.col("status").isin("ready", "superseded")).select(
        "repo_id", F.col("sha").alias("base_sha"), none("string").alias("head_sha"), none("string").alias("unit_id"), none("long").alias("deadline_us"),
        F.unix_micros("at").alias("at_us"), F.col("at").alias("seen")).withWatermark("seen", late)
    return u.unionByName(v).groupBy("repo_id", "base_sha").transformWithState(BaseWait(), OUTCOME, "Update", "EventTime")


def latest(rows: DataFrame, *order: str) -> DataFrame:
    """The last row of each (repo, base, head)."""
    key = ["repo_id", "base_sha", "head_sha"]
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("l")).select(*key, "l.*")
