"""Keyed changes of a stored table.

Every operation is an equi-join of two sides that are unique on the join key:
repeated keys of a change set are folded first with a partial aggregate, so a
key that fills a third of the change set does not skew the join. No join is
hinted; a small change set is broadcast by Spark from its measured size, a
large one is shuffled. Results are new tables: write them to a new path and
never over the path being read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.operators.validate import check_records
from rowmill.spec import CONFLICT_MODES, CONTACTS, EntitySpec


def latest_per_key(changes: DataFrame, key: str, order: str, first: bool = False) -> DataFrame:
    """Last (or first) row of every key; rows without a key are left out.

    Only the row numbers are folded by key, in a hash aggregate; the rows meet the
    winners on key and number, which are unique.
    """
    pick = F.min if first else F.max
    keyed = changes.filter(F.col(key).isNotNull())
    winners = keyed.groupBy(key).agg(pick(order).alias(order))
    return keyed.join(winners, [key, order]).select(key, *[c for c in changes.columns if c != key])


def _prefixed(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return df.select(key, *[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias("__hit"))


def bulk_update(
    target: DataFrame,
    updates: DataFrame,
    key: str = "id",
    columns: Sequence[str] = ("name", "age"),
    order: str = "row_number",
    now: Column | None = None,
    touch: str = "updated_at",
) -> DataFrame:
    """Target with ``columns`` replaced for matching keys, nulls included.

    The last row per key wins. Keys without a target row change nothing.
    """
    latest = _prefixed(latest_per_key(updates.select(key, order, *columns), key, order), key, columns)
    joined = target.join(latest, key, "left")
    hit = F.coalesce("__hit", F.lit(False))
    stamp = F.current_timestamp() if now is None else now
    out = []
    for c in target.columns:
        if c in columns:
            out.append(F.when(hit, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c))
        elif c == touch:
            out.append(F.when(hit, stamp).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def missing_updates(
    updates: DataFrame, target: DataFrame, key: str = "id", failed_by: str = "id", email: str = "email"
) -> DataFrame:
    """Updates that hit nothing, with a message.

    ``failed_by="email"`` reports an update whose email is not among the emails
    of the updated rows, even when its id matched.
    """
    if failed_by == "id":
        missing = updates.join(target.select(key), key, "left_anti")
        return missing.withColumn(
            "error", F.concat_ws(" ", F.lit("Contact with id"), F.col(key), F.lit("not found for update"))
        )
    if failed_by != "email":
        raise ValueError("failed_by must be 'id' or 'email'")
    keys = updates.select(key).distinct()
    updated_emails = target.join(keys, key, "left_semi").select(email).distinct()
    missing = updates.join(updated_emails, email, "left_anti").select(*updates.columns)
    return missing.withColumn(
        "error", F.concat_ws(" ", F.lit("Contact with email"), F.col(email), F.lit("not found for update"))
    )


def update_outcomes(
    updates: DataFrame, target: DataFrame, spec: EntitySpec = CONTACTS, order: str = "row_number"
) -> DataFrame:
    """Outcome of every update row: ``updated`` or ``failed`` with a reason.

    Rows that break the record schema fail before the match.
    """
    key = spec.key
    checked = check_records(updates, spec)
    known = target.select(key, F.lit(True).alias("__known"))
    joined = checked.join(known, key, "left")
    missing = F.concat_ws(" ", F.lit("Contact with id"), F.col(key), F.lit("not found for update"))
    error = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("__known").isNull(), missing)
    return joined.select(
        order,
        key,
        F.when(error.isNull(), "updated").otherwise("failed").alias("outcome"),
        error.alias("error"),
    )


def outcome_counts(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Outcome rows counted, overall or per group."""
    is_failure = F.col("outcome").isin("failed", "error")
    is_skip = F.col("outcome") == "skipped"
    return outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(~is_failure & ~is_skip).alias("successful"),
        F.count_if(is_failure).alias("failed"),
        F.count_if(is_skip).alias("skipped"),
    )


def stable_id(key: Column) -> Column:
    """UUID-shaped id derived from a key, the same on every recomputation."""
    h = F.md5(key.cast("string"))
    return F.concat_ws(
        "-", *[F.substring(h, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )


def _check_mode(on_conflict: str) -> None:
    if on_conflict not in CONFLICT_MODES:
        raise ValueError(f"on_conflict must be one of {', '.join(CONFLICT_MODES)}")


def upsert_outcomes(
    target: DataFrame,
    incoming: DataFrame,
    key: str = "email",
    order: str = "row_number",
    on_conflict: str = "skip",
) -> DataFrame:
    """Outcome of every incoming row, as if the rows were applied in order.

    A row creates when it is the first of its key and the target does not hold
    the key; any other row is a conflict. Rows are matched to the first of
    their key by row number, so a frequent key never meets in one task.
    """
    _check_mode(on_conflict)
    firsts = incoming.groupBy(key).agg(F.min(order).alias(order))
    creating = firsts.join(target.select(key), key, "left_anti").select(
        order, F.lit(True).alias("__creates")
    )
    # A missing key never conflicts: unique indexes admit any number of nulls.
    creates = F.coalesce("__creates", F.lit(False)) | F.col(key).isNull()
    conflict = {"skip": "skipped", "update": "updated", "error": "error"}[on_conflict]
    joined = incoming.join(creating, order, "left")
    outcome = F.when(creates, "created").otherwise(conflict)
    error = F.when(outcome == "error", F.concat_ws(" ", F.lit("duplicate value for"), F.lit(key), F.col(key)))
    return joined.select(order, key, outcome.alias("outcome"), error.alias("error"))


def upsert(
    target: DataFrame,
    incoming: DataFrame,
    key: str = "email",
    columns: Sequence[str] = ("name", "age"),
    order: str = "row_number",
    on_conflict: str = "skip",
    now: Column | None = None,
    id_column: str | None = "id",
) -> DataFrame:
    """New state of the target after the incoming rows.

    ``skip`` and ``error`` keep stored rows and add the first row of each new
    key; ``update`` takes the last row of each key for stored and new keys.
    """
    _check_mode(on_conflict)
    updating = on_conflict == "update"
    source = incoming.select(key, order, *columns)
    picked = latest_per_key(source, key, order, first=not updating).drop(order)
    fresh = _prefixed(picked, key, columns)
    # Stored rows without a key cannot meet anything either; they stay out of the join.
    stored_keyless = target.filter(F.col(key).isNull())
    keyed = target.filter(F.col(key).isNotNull()).withColumn("__old", F.lit(True)).join(fresh, key, "full_outer")
    old = F.coalesce("__old", F.lit(False))
    hit = F.coalesce("__hit", F.lit(False))
    stamp = F.current_timestamp() if now is None else now
    out = []
    for c in target.columns:
        if c in columns:
            take_new = hit if updating else hit & ~old
            out.append(F.when(take_new, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c))
        elif c == id_column and c != key:
            out.append(F.when(old, F.col(c)).otherwise(stable_id(F.col(key))).alias(c))
        elif c == "created_at":
            out.append(F.when(old, F.col(c)).otherwise(stamp).alias(c))
        elif c == "updated_at":
            changed = (hit & old) | ~old if updating else ~old
            out.append(F.when(changed, stamp).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    state = keyed.select(*out)
    # Rows without a key cannot meet anything; they are all new rows.
    keyless = incoming.filter(F.col(key).isNull())
    state = state.unionByName(stored_keyless)
    return state.unionByName(_as_new_rows(keyless, target, columns, key, order, stamp, id_column))


def _as_new_rows(rows, target, columns, key, order, stamp, id_column) -> DataFrame:
    out = []
    for name, kind in target.dtypes:
        if name in columns or name == key:
            value = F.col(name)
        elif name == id_column:
            value = stable_id(F.concat(F.lit("row-"), F.col(order).cast("string")))
        elif name in ("created_at", "updated_at"):
            value = stamp
        else:
            value = F.lit(None)
        out.append(value.cast(kind).alias(name))
    return rows.select(*out)


def upsert_stats(
    stats: DataFrame, incoming: DataFrame, order: str = "row_number", now: Column | None = None
) -> DataFrame:
    """Statistics per action replaced or added; missing counters become 0."""
    counters = ["total_records", "successful_records", "failed_records", "skipped_records"]
    filled = incoming.select(
        "action_id",
        order,
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) if c in incoming.columns
          else F.lit(0).cast("bigint").alias(c) for c in counters],
    )
    return upsert(stats, filled.filter(F.col("action_id").isNotNull()), "action_id", counters, order, "update", now, None)


def patch(
    target: DataFrame,
    patches: DataFrame,
    columns: Sequence[str],
    key: str = "id",
    order: str = "row_number",
    now: Column | None = None,
    touch: str = "updated_at",
) -> DataFrame:
    """Set only the given columns of matching rows.

    A patch row carries ``has_<column>`` flags, which separate a column that is
    absent from one that is set to null. Patches of a key apply in order.
    """
    folded = patches.filter(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.max_by(F.struct(c), F.when(F.col(f"has_{c}"), F.col(order))).alias(f"__set_{c}") for c in columns],
        F.lit(True).alias("__hit"),
    )
    joined = target.join(folded, key, "left")
    hit = F.coalesce("__hit", F.lit(False))
    stamp = F.current_timestamp() if now is None else now
    out = []
    for c in target.columns:
        if c in columns:
            given = F.col(f"__set_{c}")
            out.append(F.when(given.isNotNull(), given[c]).otherwise(F.col(c)).alias(c))
        elif c == touch:
            out.append(F.when(hit, stamp).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def not_found(changes: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """Distinct keys of a change set that the target does not hold."""
    return changes.select(key).distinct().join(target.select(key), key, "left_anti")


def lookup(target: DataFrame, keys: DataFrame, key: str = "email", ignore_case: bool = True) -> DataFrame:
    """Target rows whose key is in the list; keys are lower-cased first."""
    wanted = keys.select((F.lower(F.col(key)) if ignore_case else F.col(key)).alias(key)).distinct()
    return target.join(wanted, key, "left_semi")


def exists(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Every distinct key with whether the target holds it."""
    held = target.select(key).distinct().withColumn("found", F.lit(True))
    return keys.select(key).distinct().join(held, key, "left").select(
        key, F.coalesce("found", F.lit(False)).alias("found")
    )


def delete(target: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Target without the listed keys."""
    return target.join(keys.select(key).distinct(), key, "left_anti").select(*target.columns)


def delete_cascade(
    parent: DataFrame, children: DataFrame, keys: DataFrame, key: str, reference: str
) -> tuple[DataFrame, DataFrame]:
    """Parent and child tables without the listed keys and what refers to them."""
    gone = keys.select(F.col(key).alias(reference))
    return delete(parent, keys, key), delete(children, gone, reference)


def orphans(children: DataFrame, parent: DataFrame, reference: str, key: str) -> DataFrame:
    """Child rows whose reference has no parent row."""
    return children.join(parent.select(F.col(key).alias(reference)).distinct(), reference, "left_anti").select(
        *children.columns
    )


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def email_conflicts(
    updates: DataFrame, target: DataFrame, key: str = "id", email: str = "email", order: str = "row_number"
) -> DataFrame:
    """Updates whose email another row of the target owns.

    The target side is folded to its smallest and largest owner per email, which
    decides whether a different owner exists without listing all of them.
    """
    owners = target.filter(F.col(email).isNotNull()).groupBy(email).agg(
        F.min(key).alias("__low"), F.max(key).alias("__high")
    )
    joined = updates.join(owners, email, "inner")
    other = F.when(F.col("__low") != F.col(key), F.col("__low")).when(
        F.col("__high") != F.col(key), F.col("__high")
    )
    return joined.filter(other.isNotNull()).select(order, key, email, other.alias("owner_id"))


def apply_status_updates(
    actions: DataFrame, updates: DataFrame, order: str = "row_number", now: Column | None = None
) -> DataFrame:
    """Latest status per action applied; an update without a status only touches ``updated_at``."""
    folded = updates.filter(F.col("id").isNotNull()).groupBy("id").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col(order))).alias("__status"),
        F.lit(True).alias("__hit"),
    )
    stamp = F.current_timestamp() if now is None else now
    hit = F.coalesce("__hit", F.lit(False))
    joined = actions.join(folded, "id", "left")
    changed = {
        "status": F.coalesce("__status", "status"),
        "updated_at": F.when(hit, stamp).otherwise(F.col("updated_at")),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in actions.columns])


def actions_with_stats(actions: DataFrame, stats: DataFrame) -> DataFrame:
    """Detail view: every action with its counters, null when it has none."""
    counters = [c for c in stats.columns if c not in ("action_id", "created_at", "updated_at")]
    right = stats.select(F.col("action_id").alias("id"), *counters)
    return actions.join(right, "id", "left")


def union_failures(*failures: DataFrame) -> DataFrame:
    """All failure lists as one, columns matched by name."""
    out = failures[0]
    for more in failures[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
