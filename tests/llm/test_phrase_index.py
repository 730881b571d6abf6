"""The positional index against loops over all words."""

import os
import random
import re

import duckdb
import pytest

from rowmill.llm import phrase_index
from rowmill.llm.queries import ORACLE, QUERIES

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return [w.decode() for w in WORD.findall((text or "").encode().lower())]


def leaks_by_loop(docs, items, width=10):
    windows = {}
    for item, text in items:
        words = words_of(text)
        size = min(width, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for key, text in docs:
        words, hit, named = words_of(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    named |= windows[tuple(words[i : i + size])]
        out.append((key, len(words), len(hit), sorted(str(n) for n in named if n is not None)))
    return sorted(out, key=repr)


def found_rows(df):
    return sorted(((r[0], r["n_words"], r["n_hit"], r["items"]) for r in df.collect()), key=repr)


def few_words(rng, n, kinds):
    return " ".join(f"W{rng.randrange(kinds)}" for _ in range(n))


@pytest.mark.parametrize("kinds", [2, 6, 500])
def test_windows_equal_the_loop(spark, kinds):
    rng = random.Random(kinds)
    items = [(i, few_words(rng, rng.randrange(0, 40), kinds)) for i in range(25)] + [(3, "W1 W0 W1"), (7, "w0"), (None, "W0 W0 W1 W1")]
    docs = [(i, few_words(rng, rng.randrange(0, 300), kinds)) for i in range(60)]
    for i in range(60, 90):
        _, text = rng.choice(items)
        docs.append((i, few_words(rng, 20, kinds) + " -- " + text.replace(" ", ", ").lower() + "; " + few_words(rng, 20, kinds)))
    docs += [(90, None), (91, ""), (None, "w0 w1 w0 w0"), (90, "W1! w0. w1?"), (92, "w1 w0"), (93, "w1")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "'t' AS term", "2 AS block").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "'t' AS terms")
    assert found_rows(phrase_index.contamination(df, bench)) == leaks_by_loop(docs, items)


def test_words_beyond_ascii_and_text_ends(spark):
    docs = [(1, "Ünï-cödé ÉTÉ été\x00x"), (2, "a b c"), (3, "d e"), (4, "Σας x"), (5, "été x")]
    items = [("é", "été X"), ("b", "c d"), ("c", "E"), ("u", "ünï cödé"), ("v", "Ünï cödé")]
    found = phrase_index.contamination(
        spark.createDataFrame(docs, "doc_id int, text string").coalesce(1), spark.createDataFrame(items, "item_id string, text string")
    )
    assert found_rows(found) == leaks_by_loop(docs, items)
    named = {r["doc_id"]: r["items"] for r in found.collect()}
    # Capitals beyond ASCII stay as they are; no phrase runs from one text into the next.
    assert named == {1: ["v", "é"], 2: [], 3: ["c"], 4: [], 5: ["é"]}


def test_long_text_over_one_block(spark):
    text = "x y " * 60_000 + "needle in a haystack that nobody would look for twice today"
    docs = [(i, text) for i in range(6)]
    found = phrase_index.contamination(
        spark.createDataFrame(docs, "doc_id int, text string").coalesce(1),
        spark.createDataFrame([(1, "A haystack that nobody would look for twice today"), (2, "x y x y x y x y x y x")], "item_id int, text string"),
    )
    assert {tuple(map(str, r)) for r in found_rows(found)} == {(str(i), "120011", "120009", "['1', '2']") for i in range(6)}


def test_empty_tables(spark):
    no_docs, no_items = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert phrase_index.contamination(no_docs, items).collect() == []
    assert found_rows(phrase_index.contamination(docs, no_items)) == [(1, 2, 0, [])]


def test_proximity_equals_the_loop(spark):
    rng = random.Random(5)
    docs = [(i, few_words(rng, rng.randrange(0, 400), 60)) for i in range(40)]
    items = [(i, few_words(rng, rng.randrange(1, 8), 70)) for i in range(30)]
    index = phrase_index.PhraseIndex(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    found = phrase_index.find_near(index, spark.createDataFrame(items, "item_id long, text string"), terms=3, span=5)
    all_words = [w for _, text in docs for w in words_of(text)]
    expected = set()
    for item, text in items:
        known = sorted({(all_words.count(w), w) for w in words_of(text) if w in all_words})[:3]
        for key, body in docs if known else []:
            words = words_of(body)
            for i, word in enumerate(words):
                near = set(words[max(0, i - 5) : i + 6])
                if word == known[0][1] and all(w in near for _, w in known):
                    expected.add((item, key, i))
    rows = [tuple(r) for r in found.select("item", "id", "word").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected and expected


def test_query_on_a_larger_table(spark):
    folder = os.environ.get("ROWMILL_TEST_DATA", "/root/testdata/sf0.01")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = QUERIES["op13_benchmark_leaks"](spark, folder)
    rows = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE['op13_benchmark_leaks']})").fetchall()
    assert sorted(rows) == sorted(tuple(r) for r in df.collect())
    assert sum(r[-1] for r in rows) > 10
