"""Row validation and cleaning: one projection, no shuffle.

``validate`` maps file columns to entity fields, collects every rule violation
of a row in step order, and adds the cleaned values. All steps are expressions
over the row, so a scan with validation stays one stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions import text
from rowmill.functions.numbers import parse_int, ratio
from rowmill.spec import (
    BUSINESS_RULE_VIOLATION,
    CONTACTS,
    DATA_TYPE_MISMATCH,
    FIELD_TOO_LONG,
    REQUIRED_FIELD_MISSING,
    SECURITY_PATTERNS,
    SUSPICIOUS_CONTENT,
    UUID_SHAPE,
    BusinessRule,
    EntitySpec,
)


def _error(field: str, value: Column, code: str, message: str) -> Column:
    return F.struct(
        F.lit(field).alias("field"),
        F.coalesce(value.cast("string"), F.lit("")).alias("value"),
        F.lit(code).alias("code"),
        F.lit(message).alias("message"),
        F.lit("error").alias("severity"),
    )


def _warning(field: str, value: Column, message: str, suggestion: str) -> Column:
    return F.struct(
        F.lit(field).alias("field"),
        F.substring(value, 1, 20).alias("value"),
        F.lit(message).alias("message"),
        F.lit(suggestion).alias("suggestion"),
    )


def _collect(items: Sequence[Column], like: Column) -> Column:
    """Array of the non-null items, empty but typed when there are none."""
    return F.array_compact(F.array(*items, F.when(F.lit(False), like)))


def map_fields(
    df: DataFrame,
    spec: EntitySpec = CONTACTS,
    extras: bool = True,
    keep: Sequence[str] = ("row_number",),
    keep_key: bool = True,
) -> DataFrame:
    """Entity fields with stripped values, other columns lower-cased and stripped.

    Null marks an absent cell, the empty string a present empty one. ``keep``
    names columns that are carried along and are not file cells.
    """
    by_name = {c.lower().strip(): c for c in df.columns if c not in keep}
    carried = [F.col(c) for c in keep if c in df.columns]
    mapped = []
    for target in spec.fields:
        # A later alias replaces an earlier one when its cell is present.
        sources = [by_name[a] for a, t in spec.aliases if t == target and a in by_name]
        cell = F.coalesce(*[F.col(c) for c in reversed(sources)]) if sources else F.lit(None)
        mapped.append(text.strip(cell.cast("string")).alias(target))
    aliased = {a for a, _ in spec.aliases}
    others = [name for name in by_name if name not in aliased]
    if not extras:
        others = [name for name in others if keep_key and name in spec.required]
    return df.select(*carried, *mapped, *[text.strip(F.col(by_name[n]).cast("string")).alias(n) for n in others])


def required_errors(spec: EntitySpec, columns: Sequence[str]) -> list[Column]:
    found = []
    for name in spec.required:
        value = F.col(name) if name in columns else F.lit(None).cast("string")
        message = f"Required field '{name}' is missing or empty"
        found.append(F.when(text.is_blank(value), _error(name, value, REQUIRED_FIELD_MISSING, message)))
    return found


def format_errors(spec: EntitySpec, cleaned: dict[str, Column]) -> list[Column]:
    """Format rule, then length limit, field by field."""
    found = []
    rules = {rule.field: rule for rule in spec.rules}
    for name in spec.fields:
        rule = rules.get(name)
        if rule is None or name not in cleaned:
            continue
        value = F.col(name)
        filled = ~text.is_blank(value)
        found.append(F.when(filled & ~rule.check(value, cleaned[name]), _error(name, value, rule.code, rule.message)))
        if rule.max_length:
            limit = rule.max_length
            message = f"Field '{name}' exceeds maximum length of {limit}"
            cut = F.concat(F.substring(value, 1, 50), F.lit("..."))
            found.append(F.when(text.longer_than(value, limit), _error(name, cut, FIELD_TOO_LONG, message)))
    return found


def field_warnings(spec: EntitySpec, columns: Sequence[str]) -> list[Column]:
    """Control characters in fields with a rule. Mapped cells are stripped, so
    ``text.has_loose_space`` can only hold on raw cells and is not asked here."""
    found = []
    for rule in spec.rules:
        if rule.field not in columns:
            continue
        value = F.col(rule.field)
        filled = ~text.is_blank(value)
        found.append(
            F.when(
                filled & text.has_control_chars(value),
                _warning(
                    rule.field, value, "Field contains control characters", "Remove non-printable characters"
                ),
            )
        )
    return found


def _shown(value: Column) -> Column:
    """Cleaned value as text; zero and null show as the empty string."""
    as_text = value.cast("string")
    return F.when(as_text == "0", F.lit("")).otherwise(F.coalesce(as_text, F.lit("")))


def schema_errors(spec: EntitySpec, cleaned: dict[str, Column]) -> list[Column]:
    return [
        F.when(
            F.coalesce(check.fails(F.col(check.field), cleaned[check.field]), F.lit(False)),
            _error(check.field, _shown(cleaned[check.field]), DATA_TYPE_MISMATCH, check.message),
        )
        for check in spec.schema_checks
        if check.field in cleaned
    ]


def business_errors(rules: Sequence[BusinessRule], cleaned: dict[str, Column]) -> list[Column]:
    return [
        F.when(
            ~rule.holds(cleaned),
            _error(
                ",".join(rule.fields),
                F.concat_ws(",", *[_shown(cleaned[f]) for f in rule.fields]),
                BUSINESS_RULE_VIOLATION,
                rule.message,
            ),
        )
        for rule in rules
    ]


def _may_be_suspicious(value: Column) -> Column:
    """Cheap test that holds wherever a security pattern matches, and rarely elsewhere."""
    lowered = F.lower(value)
    return (
        F.substring(value, 1, 1).isin("=", "@", "+", "-")
        | lowered.contains("<script")
        | lowered.contains("javascript:")
        | (lowered.contains("data:") & lowered.contains("base64"))
    )


def security_errors(columns: Sequence[str]) -> list[Column]:
    """Per text field an array with one error for each suspicious pattern it matches.

    Plain text searches rule out the usual clean cell; the patterns themselves
    run only on the rest.
    """
    none = F.array()

    def found(name: str) -> Column:
        value = F.col(name)

        def error(message: str) -> Column:
            return F.struct(
                F.lit(name).alias("field"),
                value.alias("value"),
                F.lit(SUSPICIOUS_CONTENT).alias("code"),
                F.lit(f"Security violation: {message}").alias("message"),
                F.lit("error").alias("severity"),
            )

        # Constant patterns, so each is compiled once.
        hits = F.array_compact(F.array(*[F.when(value.rlike(p), error(m)) for p, m in SECURITY_PATTERNS]))
        return F.when(_may_be_suspicious(value), hits).otherwise(none)

    return [found(name) for name in columns]


def validate(
    df: DataFrame,
    spec: EntitySpec = CONTACTS,
    strict: bool = False,
    empty_optional: str = "error",
    business_rules: Sequence[BusinessRule] | None = None,
    max_errors: int | None = None,
    keep: Sequence[str] = ("row_number",),
) -> DataFrame:
    """Mapped and cleaned rows with ``errors``, ``warnings`` and ``is_valid``.

    ``strict`` drops columns the entity does not know. ``empty_optional="null"``
    reads present but empty optional cells as absent instead of reporting them.
    """
    if empty_optional not in ("error", "null"):
        raise ValueError("empty_optional must be 'error' or 'null'")
    mapped = map_fields(df, spec, extras=not strict, keep=keep)
    if empty_optional == "null":
        required = {c.field for c in spec.schema_checks if c.message == "Required"} | set(spec.required)
        mapped = mapped.withColumns(
            {c: text.non_empty(F.col(c)) for c in spec.fields if c not in required}
        )
    cells = [c for c in mapped.columns if c not in keep]
    # Cleaned values get columns of their own, so each is computed once per row.
    prepared = mapped.withColumns(
        {f"__clean_{r.field}": r.clean(F.col(r.field)) for r in spec.rules if r.clean and r.field in cells}
    )
    cleaned = {c: F.col(f"__clean_{c}") if f"__clean_{c}" in prepared.columns else F.col(c) for c in cells}
    rules = spec.business_rules if business_rules is None else business_rules
    problems = [
        *required_errors(spec, cells),
        *format_errors(spec, cleaned),
        *schema_errors(spec, cleaned),
        *business_errors(rules, cleaned),
    ]
    sample = _error("", F.lit(""), "", "")
    errors = F.concat(_collect(problems, sample), *security_errors(cells))
    if max_errors is not None:
        errors = F.slice(errors, 1, max_errors)
    warnings = _collect(field_warnings(spec, cells), _warning("", F.lit(""), "", ""))
    # In a step of its own: inside the lambdas a name must mean the mapped text,
    # not the cleaned column that the last select calls the same.
    out = prepared.withColumns({"errors": errors, "warnings": warnings})
    return out.select(
        *[F.col(c) for c in keep if c in out.columns],
        *[cleaned[c].alias(c) for c in cells],
        "errors",
        "warnings",
        (F.size("errors") == 0).alias("is_valid"),
    )


def valid_rows(validated: DataFrame) -> DataFrame:
    return validated.filter("is_valid").drop("errors", "warnings", "is_valid")


def quarantined_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(~F.col("is_valid"))


def pack_extras(validated: DataFrame, spec: EntitySpec = CONTACTS, keep: Sequence[str] = ("row_number",)) -> DataFrame:
    """Columns the entity does not store become one ``extras`` map."""
    own = {*spec.fields, *spec.required, "errors", "warnings", "is_valid", *keep}
    extra = [c for c in validated.columns if c not in own]
    pairs = [x for c in extra for x in (F.lit(c), F.col(c).cast("string"))]
    packed = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return validated.select(
        *[F.col(c) for c in validated.columns if c in own],
        F.map_filter(packed, lambda k, v: v.isNotNull()).alias("extras"),
    )


def validation_totals(validated: DataFrame) -> DataFrame:
    """One row of counters over the whole input."""
    return validated.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if("is_valid").alias("valid_rows"),
        F.count_if(~F.col("is_valid")).alias("invalid_rows"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("total_errors"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("total_warnings"),
    )


def error_breakdown(validated: DataFrame, by: str = "code") -> DataFrame:
    """Errors counted by ``code``, ``field`` or ``message``."""
    if by not in ("code", "field", "message"):
        raise ValueError("by must be code, field or message")
    # The outer form, because for the plain one Spark infers a filter on the array
    # and evaluates all rules a second time below it.
    found = validated.select(F.explode_outer("errors").alias("e")).filter(F.col("e").isNotNull())
    return found.groupBy(F.col(f"e.{by}").alias(by)).agg(F.count(F.lit(1)).alias("errors"))


def error_samples(validated: DataFrame, n: int, order: str = "row_number") -> DataFrame:
    """First ``n`` errors in row order; a top-k, not a full sort."""
    return (
        validated.select(order, F.posexplode_outer("errors").alias("position", "e"))
        .filter(F.col("e").isNotNull())
        .orderBy(order, "position")
        .limit(n)
        .select(order, "position", "e.*")
    )


def error_rate(validated: DataFrame, max_rate: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """Share of invalid rows and whether it passes the gate, overall or per group."""
    counts = validated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(~F.col("is_valid")).alias("invalid_rows"),
    )
    share = ratio(F.col("invalid_rows"), F.col("total_rows"))
    return counts.withColumn("error_rate", share).withColumn(
        "passes", F.col("invalid_rows") <= F.col("total_rows") * F.lit(max_rate)
    )


def require_error_rate(validated: DataFrame, max_rate: float = 0.1) -> None:
    """Raise when too many rows are invalid."""
    row = error_rate(validated, max_rate).first()
    if not row["passes"]:
        raise ValueError(
            f"Too many validation errors: {row['invalid_rows']}/{row['total_rows']} rows failed"
        )


def check_records(df: DataFrame, spec: EntitySpec = CONTACTS, uuid_key: bool = False) -> DataFrame:
    """Schema check of typed records before a write; adds ``problem``, null when fine."""
    cleaned = {c: F.col(c) for c in df.columns}
    found = []
    if uuid_key and spec.key in df.columns:
        key = F.col(spec.key)
        found.append(F.when(key.isNotNull() & ~key.rlike(UUID_SHAPE), F.lit(f"{spec.key}: Invalid uuid")))
    for check in spec.schema_checks:
        if check.field in cleaned:
            value = F.col(check.field)
            found.append(
                F.when(
                    F.coalesce(check.fails(value, value), F.lit(False)),
                    F.lit(f"{check.field}: {check.message}"),
                )
            )
    joined = F.concat_ws(", ", F.array_compact(F.array(*found, F.lit(None).cast("string"))))
    return df.withColumn(
        "problem", F.when(joined != "", F.concat(F.lit("Validation failed: "), joined))
    )


def update_records(df: DataFrame) -> DataFrame:
    """Chunk rows to update records: stripped id and name, lower-cased email, whole-number age."""
    return df.select(
        text.strip(F.col("id")).alias("id"),
        F.lower(text.strip(F.col("email"))).alias("email"),
        text.strip(F.col("name")).alias("name"),
        parse_int(F.col("age")).cast("int").alias("age"),
        *[F.col(c) for c in df.columns if c not in ("id", "email", "name", "age")],
    )
