"""Request-rate analysis per account.

Both limiters look back a fixed time, so each account's requests are cut into
slices and no account has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmill.functions.numbers import floor_div

WINDOW_MS = 60_000
LIMIT = 10_000


def sliding_counts(
    requests: DataFrame, account: str = "account_id", ms: str = "ms", window_ms: int = WINDOW_MS, slice_windows: int = 60
) -> DataFrame:
    """Distinct request milliseconds per account in the window that ends at each of them.

    Requests in one millisecond are one entry, and an entry exactly one window
    old has left. The entries are cut into slices of ``slice_windows`` windows;
    the last window of a slice is copied into the next one as look-back, so a
    group holds at most ``(slice_windows + 1) * window_ms`` entries.
    """
    span = window_ms * slice_windows
    entries = requests.select(F.col(account), F.col(ms)).filter(F.col(account).isNotNull()).distinct()
    own = floor_div(F.col(ms), span)
    # An entry also matters to the next slice when its window reaches into it.
    reach = floor_div(F.col(ms) + (window_ms - 1), span)
    copies = entries.withColumn("__home", own).withColumn(
        "__slice", F.explode(F.array_distinct(F.array(own, reach)))
    )
    back = Window.partitionBy(account, "__slice").orderBy(ms).rangeBetween(-(window_ms - 1), 0)
    counted = copies.withColumn("in_window", F.count(F.lit(1)).over(back))
    return counted.filter(F.col("__slice") == F.col("__home")).select(account, ms, "in_window")


def sliding_limit(
    requests: DataFrame,
    account: str = "account_id",
    ms: str = "ms",
    limit: int = LIMIT,
    window_ms: int = WINDOW_MS,
    slice_windows: int = 60,
) -> DataFrame:
    """Requests with their window count and whether they are allowed.

    A rejected request still counts for the later ones. A request without an
    account is rejected.
    """
    counts = sliding_counts(requests, account, ms, window_ms, slice_windows)
    joined = requests.join(counts, [account, ms], "left")
    return joined.withColumn("allowed", F.coalesce(F.col("in_window") <= limit, F.lit(False)))


def sliding_summary(limited: DataFrame, account: str = "account_id") -> DataFrame:
    return limited.groupBy(account).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(~F.col("allowed")).alias("rejected"),
        F.max("in_window").alias("peak_in_window"),
    )


def session_limit(
    requests: DataFrame,
    account: str = "account_id",
    ms: str = "ms",
    tie: str = "event_id",
    limit: int = 100,
    window_ms: int = WINDOW_MS,
    slice_ms: int = 600_000,
    slice_ties: int = 1_000_000,
) -> DataFrame:
    """Counter with an expiry that every request renews.

    The count starts over after a quiet gap of at least ``window_ms``. Adds
    ``current``, ``allowed``, ``remaining`` and ``reset_ms``.

    Requests are folded to one row per account, millisecond and ``slice_ties`` values of the unique
    whole number ``tie``. Sessions are found over the milliseconds, ``slice_ms`` of them at a time, and
    a request adds only its place within its own fold. So no window holds more than
    ``slice_ties`` requests or ``slice_ms`` milliseconds, however many requests an account has at once.
    """
    rows = requests.withColumn("__part", floor_div(F.col(tie).cast("bigint"), slice_ties))
    folds = rows.groupBy(account, ms, "__part").agg(F.count(F.lit(1)).alias("__n"))
    instants = folds.groupBy(account, ms).agg(F.sum("__n").alias("__n"))
    instants = instants.withColumn("__slice", floor_div(F.col(ms), slice_ms))
    local = Window.partitionBy(account, "__slice").orderBy(ms)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.col(ms) - F.lag(ms).over(local) >= window_ms
    # Requests of the slice before this instant, and the running number that opened a session there.
    first = instants.withColumns({"__inside": F.sum("__n").over(upto) - F.col("__n"), "__gap": gap})
    opened = first.withColumn("__open", F.when(F.col("__gap"), F.col("__inside") + 1))
    # What a later slice needs to know of an earlier one, one row per account and slice.
    parts = opened.groupBy(account, "__slice").agg(
        F.sum("__n").alias("__count"),
        F.min(ms).alias("__from"),
        F.max(ms).alias("__to"),
        F.max("__open").alias("__last_open"),
    )
    by_slice = Window.partitionBy(account).orderBy("__slice")
    earlier = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    linked = parts.withColumns(
        {
            "__before": F.coalesce(F.sum("__count").over(earlier), F.lit(0)),
            "__fresh": F.coalesce(F.col("__from") - F.lag("__to").over(by_slice) >= window_ms, F.lit(True)),
        }
    )
    # Running number of the request that opened the latest session so far.
    opener = F.col("__before") + F.coalesce(F.col("__last_open"), F.when(F.col("__fresh"), F.lit(1)))
    carried = linked.withColumn("__opener", opener).select(
        account,
        "__slice",
        "__before",
        F.when(F.col("__fresh"), F.col("__before") + 1)
        .otherwise(F.max("__opener").over(earlier))
        .alias("__start"),
    )
    here = opened.withColumn("__here", F.max("__open").over(upto)).join(carried, [account, "__slice"])
    numbered = here.select(
        account,
        ms,
        # Requests of the session before this instant.
        (F.col("__before") + F.col("__inside") + 1 - F.coalesce(F.col("__before") + F.col("__here"), F.col("__start"))).alias("__session"),
    )
    # One row per fold; an instant has as many as the ties have slices.
    ahead = Window.partitionBy(account, ms).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = folds.withColumn("__ahead", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).join(numbered, [account, ms])
    bases = bases.select(account, ms, "__part", (F.col("__session") + F.col("__ahead")).alias("__base"))
    place = F.row_number().over(Window.partitionBy(account, ms, "__part").orderBy(tie))
    joined = rows.withColumn("__place", place).join(bases, [account, ms, "__part"])
    current = (F.col("__base") + F.col("__place")).cast("bigint")
    return joined.select(
        *[F.col(c) for c in requests.columns],
        current.alias("current"),
        (current <= limit).alias("allowed"),
        F.greatest(F.lit(0), F.lit(limit) - current).cast("bigint").alias("remaining"),
        (F.col(ms) + window_ms).alias("reset_ms"),
    )


def session_summary(limited: DataFrame, account: str = "account_id") -> DataFrame:
    """Sessions per account: how many, the longest, rejected requests."""
    return limited.groupBy(account).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("current") == 1).alias("sessions"),
        F.max("current").alias("longest"),
        F.count_if(~F.col("allowed")).alias("rejected"),
    )
