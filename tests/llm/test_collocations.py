"""Collocations and the trie that counts them against loops."""

import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from rowmill.llm import collocations, hat_trie
from rowmill.llm.queries import ORACLE, QUERIES


def mined_by_loop(rows, least=10, inside=50, top=2000):
    f = defaultdict(Counter)
    n = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().lower()):
            words = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in candidates.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longest[part] = max(longest[part], a)
        rows_of = []
        for p, a in candidates.items():
            if p in longest and 100 * longest[p] >= inside * a:
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows_of.append((-score, -a, b" ".join(p), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_of)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(df, **how):
    return sorted(tuple(r) for r in collocations.mine(df, **how).collect())


def sample(rng, n, kinds):
    marks = [" ", " ", " ", " ", " \t", ", ", "\n", " . "]
    return "".join(f"W{min(rng.randrange(kinds), rng.randrange(kinds))}" + rng.choice(marks) for _ in range(n))


@pytest.mark.parametrize("kinds", [3, 40])
def test_phrases_equal_the_loop(spark, kinds):
    rng = random.Random(kinds)
    rows = [(sample(rng, rng.randrange(300), kinds), rng.choice(["en", "fr", None, "und", ""])) for _ in range(60)]
    rows += [(None, "en"), ("", None), (" . , ", "fr"), ("Új szó új szó új", "hu")] + [("Új szó itt.", "hu")] * 12
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS block", "'x' AS word", "2 AS n").repartition(4)
    expected = mined_by_loop(rows)
    assert mined(df) == expected and expected
    # Many partitions: hot words and pairs are spread over several.
    assert mined(df, target=20) == expected
    assert mined(df, top=5, inside=80) == mined_by_loop(rows, top=5, inside=80)


def test_equal_scores_at_the_limit(spark):
    """More phrases of the same score and count than the limit: the first by their bytes stay."""
    rows = [(f"é{i} b{i}. a{i} z{i} q{i}.", "en") for i in range(50)] * 10 + [("x y.", "en")] * 10 + [("x z.", "en")] * 30
    df = spark.createDataFrame(rows, "text string, lang string")
    for top in (3, 40, 99, 200):
        assert mined(df, top=top) == mined_by_loop(rows, top=top)


def test_empty_table(spark):
    assert mined(spark.createDataFrame([], "text string, lang string")) == []


@pytest.mark.parametrize("burst,most", [(4, 50), (64, 400), (32_768, 10**6)])
def test_trie_counts(burst, most):
    rng = np.random.default_rng(burst)
    runs = []
    trie = hat_trie.HatTrie(lambda p, k, c: runs.append((p, k, c)), 40, burst, most)
    parts = rng.integers(0, 7, 5000)
    keys = (rng.integers(0, 300, 5000).astype(np.uint64) << np.uint64(32)) | rng.integers(0, 4, 5000).astype(np.uint64)
    keys[::5] = rng.integers(0, 2**63, 1000).astype(np.uint64)
    for at in range(0, 5000, 700):
        trie.add(parts[at : at + 700], keys[at : at + 700])
        assert trie.size <= most + 700
    trie.flush()
    assert trie.size == 0 and not trie.roots
    assert all((np.diff(k.astype(object)) > 0).all() for _, k, _ in runs)
    found = {}
    for p in set(parts.tolist()):
        merged = hat_trie.merge([(k, c) for q, k, c in runs if q == p])
        found.update({(p, k): c for k, c in zip(*(x.tolist() for x in merged))})
    assert found == Counter(zip(parts.tolist(), keys.tolist()))
    assert (len(runs) > 7) == (most < 1000)


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**11
    row = spark.createDataFrame([(big, big + 1, big + 7)], "a long, l long, r long")
    assert row.select(collocations._score("a", "l", "r")).first()[0] == 10**6 * big * big // ((big + 1) * (big + 7))


def test_query_on_a_larger_table(spark):
    folder = os.environ.get("ROWMILL_TEST_DATA", "/root/testdata/sf0.01")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    df = QUERIES["op12_collocations"](spark, folder)
    rows = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE['op12_collocations']})").fetchall()
    assert sorted(rows) == sorted(tuple(r) for r in df.collect())
    assert len(rows) > 100
