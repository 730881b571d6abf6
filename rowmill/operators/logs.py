"""Service labels for container logs and reports over structured log lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Services a label can name.
SERVICES = (
    "api",
    "chunking-workers",
    "processing-workers",
    "postgres",
    "redis",
    "minio",
    "db-seed",
    "pgadmin",
    "minio-init",
    "loki",
    "grafana",
    "promtail",
)

RETENTION_DAYS = 7


def service_label(container: Column, project: str, services: Sequence[str] = SERVICES) -> Column:
    """Service in ``/<project>-<service>[-anything]``, null for other names."""
    # Longest name first, so that "minio-init" is not read as "minio".
    names = "|".join(sorted(services, key=len, reverse=True))
    found = F.regexp_extract(container, rf"^/{project}-({names})(?:-[^\n]*)?\z", 1)
    return F.nullif(found, F.lit(""))


def container_name(container: Column) -> Column:
    """Name without the leading slash."""
    return F.regexp_extract(container, r"^/([^\n]*)\z", 1)


def allowed_container(container: Column, allow: Sequence[str]) -> Column:
    """Whether a name matches one of the listed patterns."""
    return container.rlike("|".join(f"(?:{p})" for p in allow))


# Services whose containers are numbered, by any project, by this project; the rest has one container each.
SCALED = ("api", "chunking-workers", "processing-workers")
ONE_OFF = ("db-seed", "minio-init")


def default_allow(project: str, prefix: str, services: Sequence[str] = SERVICES) -> list[str]:
    """Patterns of the containers whose logs are collected: numbered ones, and ``<prefix>-<service>``."""
    single = [s for s in services if s not in SCALED + ONE_OFF]
    return [f".*-{s}-.*" for s in SCALED] + [f"{project}-{s}-.*" for s in ONE_OFF] + [f"{prefix}-{s}" for s in single]


# Label and the column it is taken from.
META_LABELS = {"image": "container_image", "instance": "container_id", "log_stream": "stream"}


def label_logs(
    logs: DataFrame, project: str, allow: Sequence[str] | None = None, container: str = "container"
) -> DataFrame:
    """Log rows of allowed containers with the labels ``container_name`` and ``job``.

    ``image``, ``instance`` and ``log_stream`` are added where the rows have the column they come from.
    """
    name = F.col(container)
    rows = logs if allow is None else logs.filter(allowed_container(name, allow))
    meta = {label: F.col(source) for label, source in META_LABELS.items() if source in logs.columns}
    return rows.withColumns({"container_name": container_name(name), "job": service_label(name, project), **meta})


LOG_SCHEMA = (
    "timestamp string, level string, message string, service string, traceId string, accountId string"
)


def parse_logs(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSON log lines to typed columns; a line that is not JSON gives nulls."""
    parsed = lines.withColumn("__log", F.from_json(F.col(line), LOG_SCHEMA))
    return parsed.select(
        F.try_to_timestamp("__log.timestamp").alias("ts"),
        "__log.level",
        "__log.message",
        "__log.service",
        F.col("__log.traceId").alias("trace_id"),
        F.col("__log.accountId").alias("account_id"),
    )


def retained(logs: DataFrame, now: Column, days: int = RETENTION_DAYS, ts: str = "ts") -> DataFrame:
    """Log rows within the retention time."""
    return logs.filter(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS"))


def level_counts(logs: DataFrame, by: Sequence[str] = ("level",)) -> DataFrame:
    return logs.groupBy(*by).agg(F.count(F.lit(1)).alias("lines"))


def trace_summary(logs: DataFrame) -> DataFrame:
    """Lines, errors and time span per trace."""
    return logs.filter(F.col("trace_id").isNotNull()).groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("level") == "error").alias("errors"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
