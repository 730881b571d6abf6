"""Calculations that remember earlier micro-batches: due actions, request windows, status changes.

State lies in Spark's own state store, with timers on the data clock (the watermark)
where something has to happen later. Spark recovers it with the stream's checkpoint; only
changed entries are written. Every call of the store and every group costs a round trip between
Spark and Python, so keys are dealt by hash into buckets that are handled as one group.

The time column is dropped behind the watermark, so Spark does not throw late
rows away by itself: each processor sees them and says what they are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rowmill.functions.numbers import floor_div
from rowmill.operators.limits import LIMIT, WINDOW_MS
from rowmill.spec import ENFORCED_TRANSITIONS

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 1024
# Fewer, as each has a group per time slice.
ACCOUNT_BUCKETS = 64
RETURNED = 10_000


def use_state_store(spark: SparkSession) -> None:
    """Timers and typed state need the RocksDB store; set for streams that start from now on."""
    spark.conf.set(STORE, ROCKSDB)


class DueActions(StatefulProcessor):
    """Holds the actions of one bucket until the data clock passes their time; the latest row of an action counts.

    The state is one value: what is known of each action as ``id: (seen_us, due_ms, forget_ms)``, without
    a ``due_ms`` once it is released or withdrawn, and the one timer of the bucket.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("actions", "timer_ms bigint, known binary")

    def _load(self) -> tuple[int | None, dict]:
        found = self.state.get()
        return (None, {}) if found is None else (found[0], pickle.loads(found[1]))

    def _store(self, timer: int | None, known: dict) -> None:
        """The timer stands at the least time at which something has to happen."""
        due = min((t if due is None else min(due, t) for _, due, t in known.values()), default=None)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.state.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        self.state.update((due, pickle.dumps(known)))

    def _released(self, pairs: list[tuple[Any, int]], clock: int) -> Iterator[pd.DataFrame]:
        if pairs:
            yield pd.DataFrame(pairs, columns=["id", "due_ms"]).assign(released_ms=clock)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        clock = timerValues.getCurrentWatermarkInMs()
        newest: dict = {}
        for part in rows:
            for action, *order in zip(*(part[c].tolist() for c in ("id", "seen_us", "withdrawn", "due_ms"))):
                if action not in newest or order > newest[action]:
                    newest[action] = order
        timer, known = self._load()
        released = []
        for action, (seen, withdrawn, due) in newest.items():
            if action in known and known[action][0] > seen:
                continue
            forget = max(seen // 1000, due, clock) + self.keep_ms
            if not withdrawn and due <= clock:
                released.append((action, due))
            known[action] = (seen, None if withdrawn or due <= clock else due, forget)
        self._store(timer, known)
        yield from self._released(released, clock)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        clock = timerValues.getCurrentWatermarkInMs()
        timer, known = self._load()
        released = [(action, due) for action, (_, due, _) in known.items() if due is not None and due <= clock]
        known = {
            action: (seen, None if due is None or due <= clock else due, forget)
            for action, (seen, due, forget) in known.items()
            if forget > clock
        }
        self._store(timer, known)
        yield from self._released(released, clock)


def due_stream(
    actions: DataFrame,
    clock: str = "created_at",
    action: str = "id",
    due: str = "scheduled_at",
    withdrawn: Column | None = None,
    delay: str = "0 seconds",
    keep_ms: int = 7 * 86_400_000,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``id``, ``due_ms``, ``released_ms`` of every scheduled action once the data clock has passed its time.

    The clock is the greatest value of the ``clock`` column in earlier micro-batches less ``delay``; rows of
    all actions move it. An action that is due already when its row arrives is released at once. A newer row
    of the same action takes the place of the one that waits, and one that fits ``withdrawn`` cancels it; older
    rows that come late change nothing until ``keep_ms`` after the action's time. Rows without an id or a
    clock value, and rows without a time that withdraw nothing, are left out. Actions are dealt by hash into
    ``buckets``, which stay the same for a checkpoint; a bucket with new rows is written anew.
    """
    use_state_store(actions.sparkSession)
    micros = F.unix_micros(F.col(clock).cast("timestamp"))
    # The clock counts whole milliseconds, so a time between two is due at the later one.
    due_ms = F.ceil(F.unix_micros(F.col(due).cast("timestamp")) / F.lit(1000)).cast("bigint")
    gone = F.lit(False) if withdrawn is None else F.coalesce(withdrawn, F.lit(False))
    wanted = F.col("id").isNotNull() & (F.col("due_ms").isNotNull() | F.col("withdrawn"))
    rows = (
        actions.select(
            F.col(clock).cast("timestamp").alias("clock"),
            F.col(action).alias("id"),
            due_ms.alias("due_ms"),
            micros.alias("seen_us"),
            gone.alias("withdrawn"),
        )
        .withWatermark("clock", delay)
        # One condition on the time column, so that it is not moved below the watermark: all rows move the clock.
        .filter(F.when(F.col("clock").isNotNull(), wanted))
        .drop("clock")
        # Only rows that withdraw have no time; a null would turn the numbers of its batch into doubles.
        .withColumn("due_ms", F.coalesce("due_ms", F.lit(0)))
        .withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    )
    kind = rows.schema["id"].dataType.simpleString()
    return rows.groupBy("bucket").transformWithStateInPandas(
        DueActions(keep_ms), f"id {kind}, due_ms bigint, released_ms bigint", "append", "EventTime"
    )


class SlidingLimit(StatefulProcessor):
    """Requests of one bucket of accounts and time slice, judged when the data clock has passed the slice.

    What a micro-batch brings is one entry of the list.
    """

    COLUMNS = ["account_id", "ms", "event_id", "no_event", "own"]

    def __init__(self, limit: int, window_ms: int, span_ms: int):
        self.limit, self.window_ms, self.span_ms = limit, window_ms, span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.requests = handle.getListState("requests", "packed binary")

    def _returned(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """In parts, with the event ids that are null."""
        for k in range(0, len(rows), RETURNED):
            part = rows.iloc[k : k + RETURNED]
            event_id = part["event_id"].astype("Int64").mask(part["no_event"])
            yield part[["account_id", "ms"]].assign(event_id=event_id, in_window=part["in_window"].astype("Int64"), allowed=part["allowed"].astype("boolean"), late=part["late"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        end = (key[1] + 1) * self.span_ms
        decided = timerValues.getCurrentWatermarkInMs() >= end
        kept = []
        for part in rows:
            nobody = part["account_id"].isna()
            now = part[part["own"] & (nobody | decided)]
            if len(now):
                late = now["account_id"].notna()
                yield from self._returned(now.assign(in_window=pd.NA, allowed=late.map({True: pd.NA, False: False}), late=late))
            if not decided and not nobody.all():
                kept.append(part.loc[~nobody, self.COLUMNS])
        if kept:
            if not self.requests.exists():
                self.handle.registerTimer(end)
            self.requests.appendValue((pickle.dumps(pd.concat(kept)),))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pickle.loads(packed) for (packed,) in self.requests.get()], ignore_index=True)
        self.requests.clear()
        # Times of one account lie together, further from those of the next than a window.
        ms = rows["ms"].to_numpy() - rows["ms"].min()
        place = pd.factorize(rows["account_id"])[0].astype(np.int64) * (ms.max() + self.window_ms + 1) + ms
        entries = np.unique(place)
        before = np.searchsorted(entries, place - self.window_ms + 1)
        n = np.searchsorted(entries, place, side="right") - before
        judged = rows.assign(in_window=n, allowed=n <= self.limit, late=False)
        yield from self._returned(judged[judged["own"]])


def sliding_limit_stream(
    requests: DataFrame,
    ts: str = "ts",
    limit: int = LIMIT,
    window_ms: int = WINDOW_MS,
    slice_windows: int = 1,
    delay: str = "1 minute",
    buckets: int = ACCOUNT_BUCKETS,
) -> DataFrame:
    """Live form of the sliding window: ``account_id``, ``ms``, ``event_id``, ``in_window``, ``allowed``, ``late``.

    Needs ``account_id string, ms bigint, event_id bigint`` and the request's time in ``ts``. Requests are
    held per bucket of accounts (dealt by hash) and slice of ``slice_windows`` windows, so a busy account is spread over
    keys; those of a slice's last window are held by the next one too. Once the clock (greatest time of
    earlier micro-batches less ``delay``) has passed a slice, its requests get the verdict of
    ``limits.sliding_limit`` over all that have arrived by then, late ones included. Requests that
    arrive even later are returned at once with ``late`` and no verdict; they still count in the next
    slice if that is open. A request without an account is rejected at once.
    """
    use_state_store(requests.sparkSession)
    span = window_ms * slice_windows
    own = floor_div(F.col("ms"), span)
    reach = floor_div(F.col("ms") + (window_ms - 1), span)
    rows = (
        requests.select(F.col(ts).cast("timestamp").alias("clock"), F.col("account_id").cast("string").alias("account_id"), "ms", "event_id")
        .withWatermark("clock", delay)
        .drop("clock")
        .withColumn("home", own)
        .withColumn("slice", F.explode(F.array_distinct(F.array(own, F.when(F.col("account_id").isNotNull(), reach).otherwise(own)))))
        .withColumn("own", F.col("slice") == F.col("home"))
        # A null would turn the numbers of its batch into doubles.
        .withColumn("no_event", F.col("event_id").isNull())
        .withColumn("event_id", F.coalesce("event_id", F.lit(0)))
        .withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("account_id", F.col("event_id").cast("string"))), F.lit(buckets)))
    )
    return rows.groupBy("bucket", "slice").transformWithStateInPandas(
        SlidingLimit(limit, window_ms, span),
        "account_id string, ms bigint, event_id bigint, in_window bigint, allowed boolean, late boolean",
        "append",
        "EventTime",
    )


class StatusCycle(StatefulProcessor):
    """The last status of every action of a bucket; every change is judged against the one before.

    Rows are held as numbers and returned in parts, so an action with most of a micro-batch's rows takes few bytes for each.
    """

    def __init__(self, allowed: Iterable[tuple[str, str]], keep_ms: int | None):
        self.allowed, self.keep_ms = frozenset(allowed), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "action_id string", "status string", self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        actions: dict = {}
        statuses: dict = {}
        parts = []
        for part in rows:
            coded = (
                [names.setdefault(v, len(names)) for v in part[c].tolist()]
                for c, names in (("action_id", actions), ("status", statuses))
            )
            numbers = (part[c].to_numpy() for c in ("no_event", "event_id", "no_time", "ms"))
            parts.append([*(np.array(c, np.int32) for c in coded), *numbers])
        action, status, no_event, event_id, no_time, ms = map(np.concatenate, zip(*parts))
        del parts
        # Nulls come first, as in Spark's order.
        order = np.lexsort((event_id, ~no_event, ms, ~no_time, action))
        action, status, no_event, event_id, no_time, ms = (c[order] for c in (action, status, no_event, event_id, no_time, ms))
        starts = np.flatnonzero(np.append(True, action[1:] != action[:-1]))
        names = list(actions)
        firsts = [self.last.getValue((names[a],)) for a in action[starts].tolist()]
        for a, at in zip(action[starts].tolist(), [*(starts[1:] - 1).tolist(), len(action) - 1]):
            self.last.updateValue((names[a],), (list(statuses)[status[at]],))
        previous = np.empty_like(status)
        previous[1:] = status[:-1]
        previous[starts] = [statuses.setdefault(None if f is None else f[0], len(statuses)) for f in firsts]
        steps = pd.DataFrame({"previous": previous, "status": status}).drop_duplicates()
        words = np.array(list(statuses), object)
        width = len(words)
        fine = {p * width + s for p, s in zip(*(steps[c].tolist() for c in steps)) if words[p] is None or (words[p], words[s]) in self.allowed}
        people = np.array(names, object)
        for k in range(0, len(action), RETURNED):
            cut = slice(k, k + RETURNED)
            yield pd.DataFrame(
                {
                    "action_id": people[action[cut]],
                    "ms": pd.Series(ms[cut]).astype("Int64").mask(no_time[cut]),
                    "event_id": pd.Series(event_id[cut]).astype("Int64").mask(no_event[cut]),
                    "status": words[status[cut]],
                    "previous_status": words[previous[cut]],
                    "allowed": np.isin(previous[cut].astype(np.int64) * width + status[cut], list(fine)),
                }
            )


def status_stream(
    changes: DataFrame,
    transitions: Iterable[tuple[str, str]] = ENFORCED_TRANSITIONS,
    keep_ms: int | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Verdict on every status change against the preceding one of its action.

    Input ``action_id string, ms bigint, event_id bigint, status string``; adds ``previous_status`` and
    ``allowed``. The rows of one micro-batch are taken in time order, after all earlier ones. With ``keep_ms`` the
    status of an action that has not changed for so long (by the processing clock) is forgotten. Rows
    without an action are left out. Actions are dealt by hash into ``buckets``; each has an entry of its own in the state.
    """
    use_state_store(changes.sparkSession)
    rows = changes.select(
        "action_id",
        "status",
        # A null would turn the numbers of its batch into doubles.
        F.col("ms").isNull().alias("no_time"),
        F.coalesce("ms", F.lit(0)).alias("ms"),
        F.col("event_id").isNull().alias("no_event"),
        F.coalesce("event_id", F.lit(0)).alias("event_id"),
        F.pmod(F.xxhash64("action_id"), F.lit(buckets)).alias("bucket"),
    ).filter("action_id IS NOT NULL")
    return rows.groupBy("bucket").transformWithStateInPandas(
        StatusCycle(tuple(transitions), keep_ms),
        "action_id string, ms bigint, event_id bigint, status string, previous_status string, allowed boolean",
        "append",
        "None" if keep_ms is None else "ProcessingTime",
    )


def session_counts(requests: DataFrame, ts: str = "ts", gap: str = "59999 milliseconds", delay: str = "10 minutes") -> DataFrame:
    """Requests per session on a stream.

    The gap is one millisecond short of the window because Spark joins rows that
    lie exactly one gap apart, while the counter has expired by then. It needs
    instants in whole milliseconds.
    """
    return (
        requests.withWatermark(ts, delay)
        .groupBy("account_id", F.session_window(ts, gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .select("account_id", F.col("s.start").alias("session_start"), "requests")
    )
