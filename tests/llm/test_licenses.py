"""License scans: equivalent layouts and spellings meet, others do not."""

from pyspark.sql import functions as F

from rowmill.llm import licenses
from rowmill.llm.licenses import AS_IS, KNOWN, MIT_BODY, PERMISSION


def test_scan(spark):
    known = licenses.known_digests(spark.createDataFrame(KNOWN, "license string, text string"))
    mit = "  Copyright (c) 2001-2020 Some Body <a@b.c>\r\nAll rights reserved.\n * " + MIT_BODY.replace('"', "”").replace("\n", "\n * ").lower()
    cases = [
        (mit, "MIT"),
        (mit.replace("sublicense", "sub licence"), "MIT"),
        (MIT_BODY.replace("copyright holders", "copyright owners"), "MIT"),
        (MIT_BODY.replace("without restriction", "with restriction"), None),
        (f"© 1999 X\n{PERMISSION}.\n\n{AS_IS}", "0BSD"),
        ("// released UNDER the mit licence", "MIT"),
        ("Released under the MIT License. Really.", None),
        ("", None), (None, None), ("Copyright 2020 Nobody", None), (" \n", None), ("word " * 100_000, None),
        ("Copyright law applies to the MIT License.", None),
    ]
    rows = [(k, t, "x", "y") for k, (t, _) in enumerate(cases)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string, digest string")
    found = licenses.scan(docs, known).collect()
    assert len(found) == 2 * len(cases)
    assert all(r.license == cases[r.doc_id][1] for r in found)
    assert licenses.scan(docs.limit(0), known).collect() == []
    lines = spark.createDataFrame([(1, "text\nReleased under the MIT License.\n\nLicensed under CC-BY 4.0"), (2, None)], "doc_id long, text string")
    more = licenses.known_digests(spark.createDataFrame([("X", "Sublicense it, per cent"), ("Y", "é ok")], "license string, text string"))
    odd = spark.createDataFrame([(1, "  // Sub-Licence it: percent!\n“É ok”\n(é) OK")], "doc_id long, text string")
    assert sorted(map(tuple, licenses.scan_lines(odd, more).collect())) == [(1, 1, "X"), (1, 2, "Y"), (1, 3, "Y")]
    assert sorted(map(tuple, licenses.scan_lines(lines, known).collect())) == [(1, 2, "MIT"), (1, 4, "CC-BY-4.0")]


def test_neighbours_are_replaced_alike(spark):
    text = spark.range(1).select(licenses.canonical(F.lit("Licence licence, sub-licence copyright owner")).alias("t")).first().t
    assert text == "license license sublicense copyright holder"


def test_lines_stay_where_they_are(spark):
    """Only lines whose first word, in any spelling, opens a known form are digested, and none is shuffled for that."""
    known = licenses.known_digests(spark.createDataFrame([("X", "Sublicense it"), ("Y", "Licensed work"), ("Z", "while true")], "license string, text string"))
    spelled = {r.first for r in licenses.first_spellings(known).collect()}
    assert spelled == {"sublicense", "sub", "sublicence", "licensed", "licenced", "while", "whilst"}
    texts = ["Sub-Licence it", "LICENCED work\nsub it", "\u201cWhilst\u201d true", "sublicense"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licenses.scan_lines(docs, known)
    assert sorted(map(tuple, found.collect())) == [(0, 1, "X"), (1, 1, "Y"), (2, 1, "Z")]
    assert "BroadcastHashJoin [first" in found._jdf.queryExecution().sparkPlan().toString()


def test_lines_are_digested_once(spark):
    """No filter makes the form of a line, neither again nor before the first word has picked the lines."""
    known = licenses.known_digests(spark.createDataFrame([("X", "Sublicense it")], "license string, text string"))
    docs = spark.createDataFrame([(1, "Sublicense it")], "doc_id long, text string")
    plan = licenses.scan_lines(docs, known)._jdf.queryExecution().sparkPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "content#" in line and ("sha2(" in line or "regexp_extract(" in line)]


def test_every_equivalent_is_found(spark):
    """The search for words to replace leaves none of them out."""
    rows = [(f"a {old} z",) for old, new in licenses.EQUIVALENT if old != new]
    found = spark.createDataFrame(rows, "x string").select("x", licenses.canonical(F.col("x")).alias("form")).collect()
    turned = {r.x: r.form for r in found}
    for old, new in licenses.EQUIVALENT:
        if old != new:
            assert turned[f"a {old} z"] == f"a {new} z", old
