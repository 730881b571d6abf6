"""Periodic runs against a loop over all periods and places."""

import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from rowmill.llm import periodic_runs
from rowmill.llm.queries import QUERIES

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
FOLDER = os.environ.get("ROWMILL_TEST_DATA", "/root/testdata/sf0.001")


def runs_by_loop(words, least=24):
    """All runs, period by period and place by place."""
    found = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 3 * q):
                part = words[i : i + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found)


def collapse(words, runs):
    dropped = set()
    for start, length, q in runs:
        dropped.update(range(start + q, start + length))
    return [w for i, w in enumerate(words) if i not in dropped]


def texts():
    rng = random.Random(7)
    out = [None, "", " \t\n", "a", "a " * 23, "a " * 24, "x " * 500, "a b " * 12, "a b " * 11 + "a"]
    out += ["a " * 100 + "b " + "a " * 100 + "b " + "a " * 100 + "b " + "a " * 40]
    fib = ["a", "a b"]
    while len(fib) < 14:
        fib.append(fib[-1] + " " + fib[-2])
    out.append(fib[-1])
    morse = "a"
    while len(morse) < 3000:
        morse += " " + morse.translate(str.maketrans("ab", "ba"))
    out.append(morse)
    out.append(" ".join(["A a"] * 30))
    for n in (30, 70, 200, 900):
        for kinds in (2, 3, 40):
            out.append(" ".join(f"w{rng.randrange(kinds)}" for _ in range(n)))
    for q in (5, 15, 16, 17, 31, 32, 33, 47, 48, 63, 64, 65, 100, 127, 128, 200):
        for kinds in (2, 1000):
            period = [f"v{rng.randrange(kinds)}" for _ in range(q)]
            body = (period * 8)[: 3 * q + rng.randrange(4 * q)]
            noise = [f"v{rng.randrange(kinds)}" for _ in range(rng.randrange(60))]
            out.append(" ".join(noise + body + noise))
            # A run of long period whose period holds runs of short ones, and one short of three periods.
            nested = (["s"] * 30 + period + ["s", "t"] * 20) * 3
            out.append("  ".join(nested))
            out.append(" ".join(period * 2 + period[:-1] + ["end"]))
    return out


def test_runs_equal_the_loop(spark):
    given = texts()
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in periodic_runs.find_runs(df).collect()}
    assert len(found) == len(given)
    for i, text in enumerate(given):
        words = SPACE.findall((text or "").encode())
        expected = runs_by_loop(words)
        assert [tuple(r) for r in found[i]["runs"]] == expected, (i, text[:80])
        assert found[i]["n_words"] == len(words)
        assert found[i]["collapsed"].encode() == b" ".join(collapse(words, expected))


def test_random_words_of_few_kinds():
    rng = np.random.default_rng(3)
    for trial in range(300):
        kinds, n = rng.integers(1, 5), rng.integers(1, 400)
        base = rng.integers(0, kinds, n)
        cut = rng.integers(1, n + 1)
        ids = np.concatenate([np.tile(base[:cut], rng.integers(1, 6))[:600], base]).astype(np.int64)
        joined = np.concatenate([ids, [10**6]])
        found = periodic_runs.find_all(joined, np.array([len(joined)]))
        assert [tuple(r) for r in found.tolist()] == runs_by_loop(ids.tolist()), trial


def test_few_seeds_in_hostile_texts():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(20_000, np.int64), np.tile([1] * 99 + [2], 200), rng.integers(0, 2, 20_000), np.tile(np.arange(700), 30)):
        for scale in (16, 64, 512, 4096):
            assert len(periodic_runs.seeds(ids, scale)[0]) <= 12 * len(ids) / (scale // 6) + 12


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "a b " * 20, "x"), (1, "a b " * 20, "y"), (None, "c " * 30, "z"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").selectExpr("*", "'n' AS n_words", "'i' AS id", "1 AS collapsed")
    found = sorted((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.find_runs(df).collect())
    assert found == [(0, [], ""), (0, [(0, 30, 1)], "c"), (1, [(0, 40, 2)], "a b"), (1, [(0, 40, 2)], "a b")]


@pytest.fixture(scope="module")
def query_rows(spark):
    return {r["doc_id"]: r.asDict() for r in QUERIES["op11_periodic_runs"](spark, FOLDER).collect()}


def test_query_equals_the_loop(spark, query_rows):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(query_rows) == len(docs)
    assert sum(r["n_runs"] > 0 for r in query_rows.values()) > len(docs) / 20
    for doc in docs:
        words = SPACE.findall((doc["text"] or "").encode())
        n, h = len(words), zlib.crc32(str(doc["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 2500:
            continue
        runs = runs_by_loop(words)
        row = dict(doc_id=doc["doc_id"], n_runs=len(runs), start=None, length=None, period=None, exponent_milli=None)
        if runs:
            start, length, q = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
            row |= dict(start=start, length=length, period=q, exponent_milli=1000 * length // q)
        row["runs_sha256"] = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        row["collapsed_sha256"] = hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest()
        assert query_rows[doc["doc_id"]] == row
