"""Seed files: typed load, and synthetic contacts, actions and statistics.

Synthetic values come from a hash of the row's key and a seed, so they are the
same on every run, partitioning and recomputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.functions import text
from rowmill.functions.numbers import parse_int, try_instant
from rowmill.operators.merge import latest_per_key, stable_id
from rowmill.session import scratch_dir

EXTRA_COUNTERS = ("batch_size", "retry_count", "max_retries", "priority")


def _count(name: str) -> Column:
    return F.coalesce(parse_int(F.col(name)), F.lit(0)).cast("bigint").alias(name)


def load_contacts(rows: DataFrame, order: str = "row_number") -> DataFrame:
    """Typed contacts, last row per id; an age that is not a number, or 0, is null."""
    typed = rows.select(
        "id",
        "name",
        "email",
        F.nullif(parse_int(F.col("age")), F.lit(0)).cast("int").alias("age"),
        order,
    )
    return latest_per_key(typed, "id", order).drop(order)


def load_actions(rows: DataFrame, order: str = "row_number") -> DataFrame:
    """Typed actions, last row per id; the four queue columns are optional."""
    plain = ["account_id", "entity_type", "action_type", "status", "file_path"]
    counters = ["total_entities", "file_size", *[c for c in EXTRA_COUNTERS if c in rows.columns]]
    typed = rows.select(
        "id",
        *plain,
        *[try_instant(text.non_empty(F.col(c))).alias(c) for c in ("scheduled_at", "started_at", "completed_at")],
        F.coalesce(text.non_empty(F.col("configuration")), F.lit("{}")).alias("configuration"),
        text.non_empty(F.col("error_message")).alias("error_message"),
        *[_count(c) for c in counters],
        order,
    )
    return latest_per_key(typed, "id", order).drop(order)


def load_stats(rows: DataFrame, order: str = "row_number") -> DataFrame:
    """Typed statistics, last row per action."""
    names = ("total_records", "successful_records", "failed_records", "skipped_records")
    typed = rows.select("action_id", *[_count(c) for c in names], order)
    return latest_per_key(typed, "action_id", order).drop(order)


def _broken(contacts: DataFrame, actions: DataFrame, stats: DataFrame) -> DataFrame:
    """``problem``, ``key`` of rows that must not be loaded."""

    def blank(key: str) -> Column:
        return F.coalesce(text.strip(F.col(key)), F.lit("")) == ""

    def rows(df: DataFrame, problem: str, key: str) -> DataFrame:
        return df.select(F.lit(problem).alias("problem"), F.col(key).alias("key"))

    def keyless(df: DataFrame, name: str, key: str) -> DataFrame:
        return rows(df.filter(blank(key)), f"{name} without {key}", key)

    strays = stats.join(actions.select(F.col("id").alias("action_id")), "action_id", "left_anti")
    listed = [
        keyless(contacts, "contact", "id"),
        keyless(actions, "action", "id"),
        keyless(stats, "statistics", "action_id"),
        rows(strays.filter(~blank("action_id")), "statistics of an unknown action", "action_id"),
    ]
    return listed[0].union(listed[1]).union(listed[2]).union(listed[3])


class SeedError(ValueError):
    """Seed files that do not fit together; ``problems`` holds all broken rows."""

    def __init__(self, message: str, problems: DataFrame):
        super().__init__(message)
        self.problems = problems


def load_all(spark: SparkSession, contacts: DataFrame, actions: DataFrame, stats: DataFrame, path: str) -> dict[str, DataFrame]:
    """Clear and load the three tables under ``path`` from the rows of their files, as one ordered job.

    Everything is typed and written to a folder of its own first, and checked there: every row has a key, and
    all statistics belong to an action of the same load. Only then the tables are replaced, statistics last and
    removed first, so no reader finds statistics without their action. A load that fails before that
    leaves the tables as they were; one that fails later is repeated as a whole, with the same result.
    """
    staged = scratch_dir(spark, "seed-load")
    typed = {"contacts": load_contacts(contacts), "actions": load_actions(actions), "stats": load_stats(stats)}
    for name, df in typed.items():
        df.write.parquet(f"{staged}/{name}")
    kept = {name: spark.read.schema(df.schema).parquet(f"{staged}/{name}") for name, df in typed.items()}
    problems = _broken(**kept)
    found = problems.orderBy("problem", "key").first()
    if found is not None:
        raise SeedError(f"{found['problem']}: {found['key']}", problems)
    # Children are cleared before their parents, and loaded after them.
    kept["stats"].limit(0).write.mode("overwrite").parquet(f"{path}/stats")
    for name in ("contacts", "actions", "stats"):
        kept[name].write.mode("overwrite").parquet(f"{path}/{name}")
    return {name: spark.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in kept.items()}


def draw(key: Column, salt: str, low: int | Column, high: int | Column) -> Column:
    """Whole number in ``[low, high]`` from the hash of a key."""
    first = low if isinstance(low, Column) else F.lit(low)
    last = high if isinstance(high, Column) else F.lit(high)
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(salt))), 1, 8), 16, 10)
    width = F.greatest(last - first + 1, F.lit(1))
    return (first + bits.cast("bigint") % width).cast("bigint")


def pick(key: Column, salt: str, values: tuple[str, ...]) -> Column:
    """One of the values from the hash of a key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (draw(key, salt, 0, len(values) - 1) + 1).cast("int"))


FIRST_NAMES = ("Ada", "Ben", "Cleo", "Dina", "Emil", "Fay", "Gus", "Hana")
LAST_NAMES = ("Abbott", "Brandt", "Cruz", "Diaz", "Egede", "Fabre", "Grant", "Holm")
# Statuses of generated actions.
STATUSES = ("completed", "failed", "processing", "queued", "cancelled", "scheduled", "validating")


def synthetic_contacts(keys: DataFrame, key: str = "id") -> DataFrame:
    """A contact per key, for example of ``spark.range(n)``; ages 18 to 80."""
    k = F.col(key)
    return keys.select(
        stable_id(F.concat(F.lit("contact-"), k.cast("string"))).alias("id"),
        F.concat_ws(" ", pick(k, "first", FIRST_NAMES), pick(k, "last", LAST_NAMES)).alias("name"),
        F.concat(F.lit("contact"), k.cast("string"), F.lit("@example.com")).alias("email"),
        draw(k, "age", 18, 80).cast("int").alias("age"),
    )


def synthetic_actions(keys: DataFrame, key: str = "id", accounts: tuple[str, ...] = ("account-1", "account-2")) -> DataFrame:
    """An action per key with counters that fit its status."""
    k = F.col(key)
    base = keys.select(
        stable_id(F.concat(F.lit("action-"), k.cast("string"))).alias("id"),
        pick(k, "account", accounts).alias("account_id"),
        F.lit("contact").alias("entity_type"),
        F.lit("bulk_update").alias("action_type"),
        pick(k, "status", STATUSES).alias("status"),
        draw(k, "total", 100, 5000).alias("total_entities"),
        k.alias("__k"),
    )
    total, status, seed = F.col("total_entities"), F.col("status"), F.col("__k")
    done = (
        F.when(status == "completed", total)
        .when(status == "failed", draw(seed, "done", F.lit(0), total - 1))
        .when(status == "processing", draw(seed, "done", F.lit(0), total))
        .when(status == "cancelled", draw(seed, "done", F.lit(0), F.floor(total / 2)))
        .otherwise(F.lit(0))
    )
    counted = base.withColumn("successful_records", done.cast("bigint"))
    good = F.col("successful_records")
    failed = (
        F.when(status == "failed", total - good)
        .when(status.isin("processing", "validating"), draw(seed, "failed", F.lit(0), F.floor(total / 5)))
        .otherwise(F.lit(0))
    )
    counted = counted.withColumn("failed_records", failed.cast("bigint"))
    skipped = (
        F.when(status == "failed", draw(seed, "skipped", F.lit(0), F.floor(F.col("failed_records") / 2)))
        .when(status == "cancelled", total - good)
        .when(status.isin("processing", "validating"), draw(seed, "skipped", F.lit(0), F.floor(total / 10)))
        .otherwise(F.lit(0))
    )
    full = counted.withColumn("skipped_records", skipped.cast("bigint"))
    return full.withColumns(
        {
            "configuration": F.concat(
                F.lit('{"deduplication":'), pick(seed, "dedup", ("true", "false")), F.lit("}")
            ),
            "file_path": F.concat_ws("/", F.lit("/uploads"), F.col("account_id"), F.concat(F.col("id"), F.lit(".csv"))),
            "file_size": draw(seed, "size", 1000, 1_000_000),
            "retry_count": F.when(status == "failed", draw(seed, "retry", 1, 3)).otherwise(F.lit(0)).cast("bigint"),
            "max_retries": F.lit(3).cast("bigint"),
            "priority": draw(seed, "priority", 1, 10),
        }
    ).drop("__k")


def synthetic_stats(actions: DataFrame) -> DataFrame:
    """Statistics rows of generated actions."""
    return actions.select(
        F.col("id").alias("action_id"),
        F.col("total_entities").alias("total_records"),
        "successful_records",
        "failed_records",
        "skipped_records",
    )


def update_file(
    rows: DataFrame, column: str = "name", key: str = "id", n: int | None = None, order: str = "row_number", seed: str = "update"
) -> DataFrame:
    """All rows, or the first ``n``, with one column replaced by ten letters and digits from a hash."""
    fresh = F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed))), 1, 10)
    picked = rows if n is None else rows.orderBy(order).limit(n)
    return picked.withColumn(column, fresh)
