"""Nested settings against the merge patch in plain Python."""

import json
import random

from pyspark.sql import functions as F

from rowmill.functions import json as js


def patched(base, patch):
    if not isinstance(patch, dict):
        return patch
    out = dict(base) if isinstance(base, dict) else {}
    for name, value in patch.items():
        if value is None:
            out.pop(name, None)
        else:
            out[name] = patched(out.get(name), value)
    return out


def value(rng, depth):
    kind = rng.randrange(7 if depth else 5)
    if kind < 5:
        return [None, True, rng.randrange(100), "té\"x", [1, {"k": 2}]][kind]
    return {rng.choice("abcd"): value(rng, depth - 1) for _ in range(rng.randrange(4))}


def without_nulls(doc):
    return {k: without_nulls(v) if isinstance(v, dict) else v for k, v in doc.items() if v is not None}


def test_merge_equals_plain_python(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        # Stored settings have no null members: a merged object does not keep them.
        base, patch = without_nulls({k: value(rng, 2) for k in "ab"}), {k: value(rng, 3) for k in rng.sample("abcd", 3)}
        rows.append((json.dumps(base), json.dumps(patch)))
    rows += [("not json", '{"a":{"b":null,"c":1}}'), (None, "{}"), ("[1]", '{"x":1}'), ('{"a":1}', "[2]"), ('{"a":1}', None), ('{"a":1}', "oops")]
    df = spark.createDataFrame(rows, "doc string, patch string")
    found = df.select("doc", "patch", js.merge_json(F.col("doc"), F.col("patch")).alias("new"), js.json_keys(F.col("doc")).alias("names")).collect()
    for r in found[:400]:
        expected = patched(json.loads(r["doc"]), json.loads(r["patch"]))
        assert json.loads(r["new"]) == expected
        assert list(json.loads(r["new"])) == sorted(expected)
        assert r["names"] == sorted(json.loads(r["doc"]))
    assert [r["new"] for r in found[400:]] == ['{"a":{"c":1}}', "{}", '{"x":1}', '{"a":1}', '{"a":1}', '{"a":1}']


def test_lookups_with_defaults(spark):
    df = spark.createDataFrame([('{"a":{"b":"5"},"l":[[1,2],[],[0.5]]}',), ("no",), (None,), ('{"a":1,"l":[1]}',)], "doc string")
    rows = df.select(
        js.get_or(F.col("doc"), "$.a.b", "string", F.lit("-")).alias("b"),
        js.get_or(F.col("doc"), "$.a", "int", F.lit(9)).alias("a"),
        js.total_of_lists(F.col("doc"), "$.l").alias("l"),
    ).collect()
    assert [tuple(r) for r in rows] == [("5", 9, 3.5), ("-", 9, 0.0), ("-", 9, 0.0), ("-", 1, 0.0)]
