"""Entity declarations: columns, rules and limits as plain data.

A new entity is one more ``EntitySpec``; the operators only read the spec.
Rules are functions from columns to boolean columns, so every check stays a
native expression inside the scan's code generation.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.functions import numbers, text

# Error codes, messages and patterns that reports are compared on.
REQUIRED_FIELD_MISSING = "REQUIRED_FIELD_MISSING"
INVALID_EMAIL_FORMAT = "INVALID_EMAIL_FORMAT"
INVALID_AGE_RANGE = "INVALID_AGE_RANGE"
FIELD_TOO_LONG = "FIELD_TOO_LONG"
BUSINESS_RULE_VIOLATION = "BUSINESS_RULE_VIOLATION"
DATA_TYPE_MISMATCH = "DATA_TYPE_MISMATCH"
SUSPICIOUS_CONTENT = "SUSPICIOUS_CONTENT"

ACTION_STATUSES = ("queued", "scheduled", "validating", "processing", "completed", "failed", "cancelled")
CONFLICT_MODES = ("skip", "update", "error")

_ANY = r"[^\n\r\x{2028}\x{2029}]*"
SECURITY_PATTERNS = (
    (r"^=", "Excel formula detected"),
    (r"^@", "Excel function detected"),
    (r"^\+", "Excel formula detected"),
    (r"^-", "Excel formula detected"),
    (r"(?i)<script", "Script tag detected"),
    (r"(?i)javascript:", "JavaScript protocol detected"),
    (rf"(?i)data:{_ANY}base64", "Base64 data URI detected"),
)
HEADER_PATTERNS = SECURITY_PATTERNS[:6]

EMAIL_SHAPE = rf"^[^@{text.SPACE}]+@[^@{text.SPACE}]+\.[^@{text.SPACE}]+\z"
EMAIL_STRICT = r"(?i)^[a-z0-9_'+\-.]*[a-z0-9_+\-]@([a-z0-9][a-z0-9\-]*\.)+[a-z]{2,}\z"
UUID_SHAPE = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
ACCOUNT_SHAPE = r"^[a-zA-Z0-9_-]+\z"


def strict_email(c: Column) -> Column:
    """Address check of the record schema: no leading dot, no double dot, dotted domain."""
    return c.rlike(EMAIL_STRICT) & ~c.startswith(".") & ~c.contains("..")


@dataclass(frozen=True)
class FieldRule:
    """Format check of one field, run on present and non-empty text.

    ``check`` sees the mapped text and the cleaned value. ``clean`` gets the mapped text, which is stripped already.
    """

    field: str
    check: Callable[[Column, Column], Column]
    code: str
    message: str
    clean: Callable[[Column], Column] | None = None
    max_length: int | None = None


@dataclass(frozen=True)
class SchemaCheck:
    """Check of a cleaned field; ``fails`` sees the raw text and the cleaned value."""

    field: str
    message: str
    fails: Callable[[Column, Column], Column]


@dataclass(frozen=True)
class BusinessRule:
    """Named rule over several cleaned fields; ``holds`` gets a field to column map."""

    name: str
    fields: tuple[str, ...]
    message: str
    holds: Callable[[Mapping[str, Column]], Column]


@dataclass(frozen=True)
class EntitySpec:
    name: str
    key: str
    schema: T.StructType
    required: tuple[str, ...] = ()
    # (file column, entity field); a later present column replaces an earlier one
    aliases: tuple[tuple[str, str], ...] = ()
    rules: tuple[FieldRule, ...] = ()
    schema_checks: tuple[SchemaCheck, ...] = ()
    business_rules: tuple[BusinessRule, ...] = ()
    renames: Mapping[str, str] = field(default_factory=dict)

    @property
    def fields(self) -> list[str]:
        """Entity fields in mapping order."""
        return list(dict.fromkeys(target for _, target in self.aliases))

    def rename_columns(self, df):
        """Camel-case columns to the stored names."""
        return df.withColumnsRenamed({old: new for old, new in self.renames.items() if old in df.columns})


def contacts_spec(age_low: int = 1, age_high: int = 150) -> EntitySpec:
    """Contact entity; the age range is an option because the stored table allows 0 to 120."""
    return EntitySpec(
        name="contact",
        key="id",
        schema=T.StructType(
            [
                T.StructField("id", T.StringType()),
                T.StructField("name", T.StringType()),
                T.StructField("email", T.StringType()),
                T.StructField("age", T.IntegerType()),
                T.StructField("created_at", T.TimestampType()),
                T.StructField("updated_at", T.TimestampType()),
            ]
        ),
        required=("id",),
        aliases=(
            ("email", "email"),
            ("name", "name"),
            ("full_name", "name"),
            ("first_name", "name"),
            ("age", "age"),
        ),
        rules=(
            FieldRule(
                "email",
                lambda raw, c: raw.rlike(EMAIL_SHAPE),
                INVALID_EMAIL_FORMAT,
                "Invalid email format",
                F.lower,
                255,
            ),
            FieldRule(
                "name",
                lambda raw, c: (raw != "") & ~text.longer_than(raw, 255),
                DATA_TYPE_MISMATCH,
                "Name must be between 1 and 255 characters",
                None,
                255,
            ),
            FieldRule(
                "age",
                lambda raw, c: F.coalesce(c.between(age_low, age_high), F.lit(False)),
                INVALID_AGE_RANGE,
                f"Age must be a number between {age_low} and {age_high}",
                numbers.parse_int,
            ),
        ),
        schema_checks=(
            SchemaCheck("name", "Name cannot be empty", lambda raw, c: raw.isNotNull() & (c == "")),
            SchemaCheck("name", "Name too long", lambda raw, c: text.longer_than(c, 255)),
            SchemaCheck("email", "Required", lambda raw, c: raw.isNull()),
            SchemaCheck("email", "Invalid email format", lambda raw, c: raw.isNotNull() & ~strict_email(c)),
            SchemaCheck("age", "Expected number, received nan", lambda raw, c: raw.isNotNull() & c.isNull()),
            SchemaCheck("age", f"Number must be greater than or equal to {age_low}", lambda raw, c: c < age_low),
            SchemaCheck("age", f"Number must be less than or equal to {age_high}", lambda raw, c: c > age_high),
        ),
        business_rules=(
            BusinessRule(
                "age_with_name_consistency",
                ("age", "name"),
                "Name is required when age is provided",
                lambda f: ~(F.coalesce(f["age"] != 0, F.lit(False)) & text.is_blank(f["name"])),
            ),
        ),
        renames={"createdAt": "created_at", "updatedAt": "updated_at"},
    )


CONTACTS = contacts_spec()

ACTIONS = EntitySpec(
    name="bulk_action",
    key="id",
    schema=T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("account_id", T.StringType()),
            T.StructField("entity_type", T.StringType()),
            T.StructField("action_type", T.StringType()),
            T.StructField("status", T.StringType()),
            T.StructField("total_entities", T.LongType()),
            T.StructField("scheduled_at", T.TimestampType()),
            T.StructField("started_at", T.TimestampType()),
            T.StructField("completed_at", T.TimestampType()),
            T.StructField("configuration", T.StringType()),
            T.StructField("error_message", T.StringType()),
            T.StructField("file_path", T.StringType()),
            T.StructField("file_size", T.LongType()),
            T.StructField("created_at", T.TimestampType()),
            T.StructField("updated_at", T.TimestampType()),
        ]
    ),
    required=("id", "account_id", "entity_type", "action_type"),
    renames={
        "accountId": "account_id",
        "entityType": "entity_type",
        "actionType": "action_type",
        "totalEntities": "total_entities",
        "scheduledAt": "scheduled_at",
        "startedAt": "started_at",
        "completedAt": "completed_at",
        "errorMessage": "error_message",
        "createdAt": "created_at",
        "updatedAt": "updated_at",
    },
)

ACTION_STATS = EntitySpec(
    name="bulk_action_stat",
    key="action_id",
    schema=T.StructType(
        [
            T.StructField("action_id", T.StringType()),
            T.StructField("total_records", T.LongType()),
            T.StructField("successful_records", T.LongType()),
            T.StructField("failed_records", T.LongType()),
            T.StructField("skipped_records", T.LongType()),
            T.StructField("created_at", T.TimestampType()),
            T.StructField("updated_at", T.TimestampType()),
        ]
    ),
    required=("action_id",),
    renames={
        "actionId": "action_id",
        "totalRecords": "total_records",
        "successfulRecords": "successful_records",
        "failedRecords": "failed_records",
        "skippedRecords": "skipped_records",
        "createdAt": "created_at",
        "updatedAt": "updated_at",
    },
)

# Allowed status changes (from, to).
ENFORCED_TRANSITIONS = (
    ("queued", "processing"),
    ("queued", "cancelled"),
    ("queued", "validating"),
    ("validating", "processing"),
    ("validating", "cancelled"),
    ("validating", "failed"),
    ("processing", "completed"),
    ("processing", "failed"),
    ("processing", "cancelled"),
    ("failed", "queued"),
    ("cancelled", "queued"),
)
MODEL_TRANSITIONS = (
    ("queued", "processing"),
    ("queued", "cancelled"),
    ("processing", "completed"),
    ("processing", "failed"),
    ("processing", "cancelled"),
    ("failed", "queued"),
    ("validating", "processing"),
    ("validating", "cancelled"),
    ("validating", "queued"),
    ("cancelled", "queued"),
)
