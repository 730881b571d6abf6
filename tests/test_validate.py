from pyspark.sql import functions as F

from rowmill.functions import numbers, text
from rowmill.operators import validate as v
from rowmill.spec import BusinessRule, contacts_spec


def rows_of(spark, cells, columns="row_number long, id string, email string, name string, age string"):
    return spark.createDataFrame(cells, columns)


def codes(spark, cells, **options):
    out = v.validate(rows_of(spark, cells), **options).orderBy("row_number").collect()
    return [[(e["field"], e["code"]) for e in row["errors"]] for row in out]


def test_clean_row_is_valid_and_cleaned(spark):
    row = v.validate(rows_of(spark, [(1, "7", " Ab@X.Io\t", " Bo﻿", "12abc")])).first()
    assert row["is_valid"] and (row["email"], row["name"], row["age"]) == ("ab@x.io", "Bo", 12)


def test_errors_and_their_order(spark):
    found = codes(
        spark,
        [
            (1, "", "a@b.io", "n", "30"),
            (2, "1", "a@b", "n", "30"),
            (3, "1", "a@b.io", "", ""),
            (4, "1", "a@b.io", "n", "0"),
            (5, "1", "a@b.io", "n", "151"),
            (6, "1", "a@b.io", "n", "-5"),
            (7, "1", "a@b.io", "n", "+5"),
            (8, "1", "a@b.io", None, "30"),
            (9, "1", "a@b.io", "x" * 256, None),
            (10, "1", None, "n", None),
            (11, "1", "", "n", None),
            (12, "1", ".a@b.io", "n", None),
        ],
    )
    rule, schema = "INVALID_AGE_RANGE", "DATA_TYPE_MISMATCH"
    assert found == [
        [("id", "REQUIRED_FIELD_MISSING")],
        [("email", "INVALID_EMAIL_FORMAT"), ("email", schema)],
        [("name", schema), ("age", schema)],
        [("age", rule), ("age", schema)],
        [("age", rule), ("age", schema)],
        [("age", rule), ("age", schema), ("age", "SUSPICIOUS_CONTENT")],
        [("age", "SUSPICIOUS_CONTENT")],
        [("age,name", "BUSINESS_RULE_VIOLATION")],
        [("name", schema), ("name", "FIELD_TOO_LONG"), ("name", schema)],
        [("email", schema)],
        [("email", schema)],
        [("email", schema)],
    ]


def test_one_error_per_security_pattern(spark):
    cells = [(1, "1", "a@b.io", "=<ScRiPt JavaScript: DATA:x;BASE64", None), (2, "1", "a@b.io", "data:x\nbase64", None)]
    out = v.validate(rows_of(spark, cells)).orderBy("row_number").collect()
    assert [e["message"].split(": ")[1] for e in out[0]["errors"]] == [
        "Excel formula detected",
        "Script tag detected",
        "JavaScript protocol detected",
        "Base64 data URI detected",
    ]
    assert out[0]["errors"][0]["value"] == cells[0][3]
    assert out[1]["is_valid"] and len(out[1]["warnings"]) == 1


def test_security_looks_at_extra_columns_unless_strict(spark):
    df = spark.createDataFrame([(1, "1", "a@b.io", "@x")], "row_number long, id string, email string, note string")
    assert not v.validate(df).first()["is_valid"]
    strict = v.validate(df, strict=True)
    assert strict.first()["is_valid"] and "note" not in strict.columns


def test_empty_optional_cells_can_be_absent(spark):
    assert codes(spark, [(1, "1", "a@b.io", "", "")], empty_optional="null") == [[]]
    assert codes(spark, [(1, "1", "", "", "")], empty_optional="null") == [[("email", "DATA_TYPE_MISMATCH")]]


def test_aliases_later_present_cell_wins(spark):
    df = spark.createDataFrame(
        [(1, "a", "b", "c"), (2, "a", "b", None), (3, "a", None, None), (4, "a", "b", "")],
        "row_number long, name string, full_name string, first_name string",
    )
    names = [r["name"] for r in v.map_fields(df).orderBy("row_number").collect()]
    assert names == ["c", "b", "a", ""]


def test_limit_of_errors_own_rule_and_age_range(spark):
    assert codes(spark, [(1, "", "x", "", "0")], max_errors=1) == [[("id", "REQUIRED_FIELD_MISSING")]]
    rule = BusinessRule("short", ("name",), "too short", lambda f: F.length(f["name"]) > 1)
    row = v.validate(rows_of(spark, [(1, "1", "a@b.io", "n", "30")]), business_rules=[rule]).first()
    assert [(e["message"], e["value"]) for e in row["errors"]] == [("too short", "n")]
    narrow = v.validate(rows_of(spark, [(1, "1", "a@b.io", "n", "121")]), contacts_spec(0, 120)).first()
    assert narrow["errors"][0]["message"] == "Age must be a number between 0 and 120"


def test_gate_raises_above_the_rate(spark):
    good = v.validate(rows_of(spark, [(i, "1", "a@b.io", "n", "1") for i in range(9)]))
    bad = v.validate(rows_of(spark, [(99, "", "a@b.io", "n", "1")]))
    v.require_error_rate(good.unionByName(bad), 0.1)
    try:
        v.require_error_rate(good.unionByName(bad).unionByName(bad), 0.1)
    except ValueError as error:
        assert "2/11" in str(error)
    else:
        raise AssertionError("gate did not close")


def test_valid_and_quarantine_add_up(spark):
    checked = v.validate(rows_of(spark, [(1, "1", "a@b.io", "n", "1"), (2, "", "a@b.io", "n", "1")]))
    assert v.valid_rows(checked).count() + v.quarantined_rows(checked).count() == 2
    assert "errors" not in v.valid_rows(checked).columns


def test_rules_need_no_shuffle(spark):
    plan = v.validate(rows_of(spark, [(1, "1", "a@b.io", "n", "1")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_text_helpers(spark):
    df = spark.createDataFrame(
        [("  a \n b﻿", "\U0001f600" * 3, "a@b@c")], "s string, e string, m string"
    )
    row = df.select(
        text.strip(F.col("s")).alias("strip"),
        text.collapse_space(F.col("s")).alias("one"),
        text.unit_length(F.col("e")).alias("units"),
        text.longer_than(F.col("e"), 5).alias("longer"),
        text.longer_than(F.col("e"), 6).alias("not_longer"),
        text.email_domain(F.col("m")).alias("domain"),
        text.email_domain(F.col("s")).alias("no_domain"),
        text.sanitize_name(F.lit(" _First  Name (x)_ ")).alias("name"),
        text.mask_secrets(F.lit("PASSWORD = 'a' token='b'")).alias("mask"),
        text.mask_secrets(F.lit("x" * 201)).alias("cut"),
        numbers.percent(F.lit(1), F.lit(3)).alias("third"),
        numbers.percent(F.lit(2), F.lit(3)).alias("two_thirds"),
        numbers.percent(F.lit(2), F.lit(0)).alias("none"),
    ).first()
    assert row["strip"] == "a \n b" and row["one"] == " a b "
    assert row["units"] == 6 and row["longer"] and not row["not_longer"]
    assert (row["domain"], row["no_domain"], row["name"]) == ("b", "", "first_name_x")
    assert row["mask"] == "password='***' token='***'" and row["cut"] == "x" * 200 + "..."
    assert (row["third"], row["two_thirds"], row["none"]) == (33.33, 66.67, 0.0)
