import os

import pytest
from pyspark.sql import functions as F

from rowmill.sources import delimited, files, progress, seeds, tables


def put(folder, name, content, encoding="utf-8"):
    with open(os.path.join(folder, name), "w", encoding=encoding, newline="") as f:
        f.write(content)


def test_read_keeps_empty_and_marks_missing_cells(spark, folder):
    put(folder, "a.csv", 'id, Name ,"age"\n1,"a ""q"", b",30\n2,,\n3,x\n\n4," s ",5\n')
    rows = delimited.read_delimited(spark, folder).orderBy("row_number").collect()
    assert [(r["row_number"], r["id"], r["name"], r["age"]) for r in rows] == [
        (1, "1", 'a "q", b', "30"),
        (2, "2", "", ""),
        (3, "3", "x", None),
        (4, "4", " s ", "5"),
    ]


def test_row_numbers_over_many_splits(spark, folder):
    for part in range(3):
        put(folder, f"{part}.csv", "id,v\n" + "".join(f"{part * 10_000 + i},{'x' * (i % 50)}\n" for i in range(10_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        rows = delimited.read_delimited(spark, folder)
        assert rows.rdd.getNumPartitions() > 10
        bad = rows.filter(F.col("row_number") != F.col("id").cast("bigint") + 1).count()
        assert (rows.count(), bad) == (30_000, 0)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        shuffled = delimited.read_delimited(spark, folder)
        assert shuffled.filter(F.col("row_number") != F.col("id").cast("bigint") + 1).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_options_separator_encoding_multi_line_and_cap(spark, folder):
    put(folder, "a.csv", "id;v\n1;'a\nb'\n2;é\n3;z\n", "latin-1")
    rows = delimited.read_delimited(
        spark, folder, ["id", "v"], sep=";", quote="'", escape="'", encoding="ISO-8859-1", multi_line=True, max_rows=2
    ).orderBy("row_number").collect()
    assert [(r["id"], r["v"]) for r in rows] == [("1", "a\nb"), ("2", "é")]


def test_last_of_a_repeated_column_is_kept(spark, folder):
    put(folder, "a.csv", "id,v,v\n1,a,b\n")
    row = delimited.read_delimited(spark, folder).first()
    assert (row["id"], row["v"]) == ("1", "b")


def test_header_audit_and_structure(spark, folder):
    put(folder, "ok.csv", '"id",Email , name\n1,"a,b",c\n2,x,y\n')
    put(folder, "bad.csv", "email,=x,,email\n1,2,3,4\n1,2\n")
    put(folder, "long.csv", "id," + "n" * 1000 + "\n")
    audited = delimited.audit_headers(delimited.header_lines(spark, folder))
    found = {os.path.basename(r["file_path"]): r for r in audited.collect()}
    assert found["ok.csv"]["is_valid"] and found["ok.csv"]["normalized"] == ["id", "email", "name"]
    bad = found["bad.csv"]
    assert (bad["missing"], bad["duplicates"], bad["suspicious"], bad["has_empty_name"]) == (["id"], ["email"], ["=x"], True)
    assert found["long.csv"]["is_too_long"]
    shape = {os.path.basename(r["file_path"]): (r["data_lines"], r["bad_lines"]) for r in delimited.check_structure(spark, folder).collect()}
    assert shape == {"ok.csv": (2, 0), "bad.csv": (2, 1), "long.csv": (0, 0)}
    naive = {os.path.basename(r["file_path"]): r["bad_lines"] for r in delimited.check_structure(spark, folder, naive=True).collect()}
    assert naive["ok.csv"] == 1
    positions = delimited.column_positions(audited).filter("name = 'email' and occurrences = 2").first()
    assert positions["position"] == 3


def test_write_quotes_everything_and_reads_back(spark, folder):
    df = spark.createDataFrame([("1", 'a"b', None), ("2", " x,\t", "")], "id string, v string, w string")
    delimited.write_delimited(df, f"{folder}/out", files=1)
    text = "".join(r["value"] + "\n" for r in spark.read.text(f"{folder}/out").collect())
    assert '"id","v","w"' in text and '"1","a""b",""' in text and '"2"," x,\t",""' in text
    back = delimited.read_delimited(spark, f"{folder}/out").orderBy("row_number").collect()
    assert [(r["id"], r["v"], r["w"]) for r in back] == [("1", 'a"b', ""), ("2", " x,\t", "")]


def test_manifest_and_gate(spark, folder):
    put(folder, "a.csv", "hello\n")
    listing = files.file_checksums(spark, folder).withColumn("path", files.file_name(F.col("path")))
    manifest = spark.createDataFrame(
        [("a.csv", 6, "b1946ac92492d2347c6235b4d2611184"), ("b.csv", 6, "x")],
        "path string, expected_length long, expected_checksum string",
    )
    found = {r["path"]: r["verdict"] for r in files.check_manifest(manifest, listing).collect()}
    assert found == {"a.csv": "ok", "b.csv": "file not found"}
    wrong = manifest.withColumn("expected_checksum", F.lit("x"))
    assert files.check_manifest(wrong, listing).filter("verdict = 'checksum mismatch'").count() == 1
    assert files.list_files(spark, folder, "*.csv").count() == 1


def test_paths(spark):
    paths = {
        "private/Accounts/a/Action/b/raw.csv": "raw",
        "private/Accounts/a/Action/b/Chunks/j/chunk12.csv": "chunk",
        "private/Accounts/a/Action/b/Chunks/processing/chunk_001.csv": "chunk",
        "private/Accounts/a/Action/b/processing/x": "processing",
        "private/Accounts/a/Action/b/c/raw.csv": None,
        "x/private/Accounts/a/Action/b/raw.csv": None,
    }
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    found = {r["path"]: r["k"] for r in df.select("path", files.path_kind(F.col("path")).alias("k")).collect()}
    assert found == paths


def test_states_of_a_table_never_overwrite(spark, folder):
    tables.write_table(spark.range(3), f"{folder}/t1")
    old = tables.read_table(spark, f"{folder}/t1")
    tables.write_table(old.filter("id > 0"), f"{folder}/t2", sort_by="id")
    assert old.count() == 3 and tables.read_table(spark, f"{folder}/t2").count() == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_table(old, f"{folder}/t2")
    plan = tables.read_table(spark, f"{folder}/t2", {"id": 2})._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,2)]" in plan


def test_observed_counters_and_progress(spark):
    df = spark.range(10).withColumn("is_valid", F.col("id") > 2)
    counted, seen = progress.observe_scan(df)
    counted.collect()
    assert seen.get == {"processed_rows": 10, "valid_rows": 7, "invalid_rows": 3}
    report = spark.createDataFrame(
        [("a", 1, 0, 100, 0, 0), ("b", 1, 50, 100, 10, 1000), ("c", 1, 200, 100, 4, 10), ("d", 1, 5, 0, 2, 0)],
        "run_id string, batch_id long, processed_bytes long, total_bytes long, processed_rows long, elapsed_ms long",
    )
    found = {r["run_id"]: (r["percentage"], r["estimated_total_rows"], r["remaining_ms"], r["rows_per_second"]) for r in progress.progress_report(report).collect()}
    assert found["a"] == (0.0, 0, 0.0, 0.0) and found["b"] == (50.0, 20, 1000.0, 10.0)
    assert found["c"][0] == 100.0 and found["d"] == (0.0, 2, 0.0, 0.0)


def test_seed_load_casts(spark):
    rows = spark.createDataFrame(
        [(1, "1", "a", "e", "0"), (2, "1", "b", "e", "12y"), (3, "2", "c", "e", "x")], "row_number long, id string, name string, email string, age string"
    )
    assert sorted(tuple(r) for r in seeds.load_contacts(rows).collect()) == [("1", "b", "e", 12), ("2", "c", "e", None)]
    made = seeds.synthetic_stats(seeds.synthetic_actions(spark.range(500))).collect()
    assert all(0 <= r["successful_records"] <= r["total_records"] <= 5000 for r in made)


def test_files_meet_by_column_name(spark, folder):
    put(folder, "a.csv", "id,email,name\n1,a@x.io,Ann\n")
    put(folder, "b.csv", "id,name,email\n9,Zed,z@x.io\n")
    put(folder, "c.csv", "NAME, Id\nKim,5\n")
    rows = delimited.read_delimited(spark, folder).orderBy("row_number").collect()
    assert [(r["row_number"], r["id"], r["email"], r["name"]) for r in rows] == [
        (1, "1", "a@x.io", "Ann"), (2, "9", "z@x.io", "Zed"), (3, "5", None, "Kim"),
    ]


def test_two_thousand_headers_in_one_scan(spark, folder):
    """Every file has its columns in an order of its own, some are missing, one is repeated."""
    import itertools

    names = ["id", "a", "b", "c", "d", "e", "f"]
    orders = list(itertools.islice(itertools.permutations(names), 2000))
    for n, order in enumerate(orders):
        kept = [c for c in order if c != "b" or n % 2]
        head = ",".join(c.upper() if n % 3 else f'"{c}"' for c in kept) + (",a" if n % 7 == 0 else "")
        cells = ",".join(f'"{c}, {n}"' if c != "id" else str(n) for c in kept) + (f",last {n}" if n % 7 == 0 else "")
        put(folder, f"{n:04d}.csv", head + "\n" + cells + "\n")
    rows = delimited.read_delimited(spark, folder)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation[") <= 2 and "Union" not in plan
    found = {r["id"]: r for r in rows.collect()}
    assert len(found) == 2000
    for n in range(2000):
        row = found[str(n)]
        assert row["row_number"] == n + 1
        assert row["a"] == (f"last {n}" if n % 7 == 0 else f"a, {n}")
        assert row["b"] == (f"b, {n}" if n % 2 else None)
        assert [row[c] for c in "cdef"] == [f"{c}, {n}" for c in "cdef"]


def test_offset_and_raw_line_of_every_row(spark, folder):
    texts = {
        "a.csv": "id,näme\r\n" + "".join(f'{i},"{"日本é"[: i % 4]}, {i}"\r\n' for i in range(3000)),
        "b.csv": "\n  \nid;x,name\n\n1,one\n\n\n2,zwö" + "ß" * 100,
        "c.csv": "﻿id,name\n" + "".join(f"{i},{'x' * (i % 90)}\n" + "\n" * (i % 3) for i in range(2000)),
        "d.csv": "id,name\n",
    }
    for name, content in texts.items():
        put(folder, name, content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        rows = delimited.read_delimited(spark, folder, places=True)
        found = rows.collect()
        plain = {r["row_number"]: r["source_file"] for r in delimited.read_delimited(spark, folder).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r["row_number"] for r in found) == list(range(1, 5003))
    assert plain == {r["row_number"]: r["source_file"] for r in found}
    lines_of = {}
    for r in sorted(found, key=lambda r: r["row_number"]):
        name = os.path.basename(r["source_file"])
        with open(os.path.join(folder, name), "rb") as f:
            f.seek(r["byte_offset"])
            assert f.readline().rstrip(b"\r\n").decode() == r["raw_line"]
        lines_of.setdefault(name, []).append(r["raw_line"])
    for name, content in texts.items():
        filled = [x.rstrip("\r") for x in content.lstrip("﻿").split("\n") if x.strip()]
        assert lines_of.get(name, []) == filled[1:]


def test_a_scan_set_up_with_other_task_sizes_is_refused(spark, folder):
    put(folder, "a.csv", "id,v\n" + "".join(f"{i},x\n" for i in range(5000)))
    rows = delimited.read_delimited(spark, folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        with pytest.raises(Exception, match="sizes of scan tasks have changed"):
            rows.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_measured_scan(spark, folder):
    os.makedirs(f"{folder}/in")
    put(folder, "in/a.csv", "id,v\n1,é\n\n2,y\n3,\n")
    put(folder, "in/b.csv", "id,v\n4,z")
    put(folder, "in/c.csv", "id,v\n")
    row = progress.measured_scan(spark, f"{folder}/in", lambda df: df.withColumn("is_valid", F.col("v") != ""), f"{folder}/out").first()
    assert (row["processed_rows"], row["valid_rows"], row["invalid_rows"], row["empty_rows"]) == (4, 3, 1, 1)
    size = sum(os.path.getsize(f"{folder}/in/{n}.csv") for n in "abc")
    assert row["processed_bytes"] == row["total_bytes"] == size
    assert row["rows_per_second"] == pytest.approx(4 / row["seconds"]) and row["bytes_per_second"] == pytest.approx(size / row["seconds"])
    assert spark.read.parquet(f"{folder}/out").count() == 4


def seed_rows(spark, stats):
    contacts = spark.createDataFrame([("c1", "n", "e", "7", 1), ("c1", "m", "e", "0", 2), ("c2", "o", "e", "x", 3)], "id string, name string, email string, age string, row_number long")
    names = ["id", "account_id", "entity_type", "action_type", "status", "file_path", "total_entities", "file_size", "scheduled_at", "started_at", "completed_at", "configuration", "error_message"]
    actions = spark.createDataFrame([(f"a{i}", *["x"] * 12, i) for i in range(3)], ", ".join(f"{n} string" for n in names) + ", row_number long")
    counters = spark.createDataFrame(stats, "action_id string, total_records string, successful_records string, failed_records string, skipped_records string, row_number long")
    return contacts, actions, counters


def test_seed_load_replaces_all_or_nothing(spark, folder):
    def tables_of():
        return {n: sorted(tuple(r) for r in spark.read.parquet(f"{folder}/{n}").collect()) for n in ("contacts", "actions", "stats")}

    first = seeds.load_all(spark, *seed_rows(spark, [("a0", "5", "4", "1", "no", 1), ("a0", "6", "", "1", "0", 2), ("a1", "x", "1", "2", "3", 3)]), folder)
    assert sorted(tuple(r) for r in first["stats"].collect()) == [("a0", 6, 0, 1, 0), ("a1", 0, 1, 2, 3)]
    before = tables_of()
    assert len(before["contacts"]) == 2 and len(before["actions"]) == 3
    with pytest.raises(seeds.SeedError, match="unknown action: a9") as caught:
        seeds.load_all(spark, *seed_rows(spark, [("a9", "1", "1", "0", "0", 1), (" ", "1", "1", "0", "0", 2)]), folder)
    assert {tuple(r) for r in caught.value.problems.collect()} == {("statistics of an unknown action", "a9"), ("statistics without action_id", " ")}
    assert tables_of() == before
    contacts, actions, counters = seed_rows(spark, [])
    seeds.load_all(spark, contacts.filter("id = 'c2'"), actions.filter("id = 'a2'"), counters, folder)
    after = tables_of()
    assert [len(after[n]) for n in ("contacts", "actions", "stats")] == [1, 1, 0]
