"""LM scoring: base scores by hand, probabilities that sum to one, held-out texts better than the base."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rowmill.llm import pitman_yor
from rowmill.llm.pitman_yor import CONTEXTS, KEPT, Totals, bucket_totals, sample_seating, seat

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_packing():
    words = np.sort(np.array([3, 3, 2**63 + 5, 9, 9, 9, 2**64 - 1], np.uint64))
    assert (pitman_yor.unpack_words(*pitman_yor.pack_words(words)) == words).all()
    values = np.array([0, 1, 255, 256, 2**40])
    assert (pitman_yor.unpack(pitman_yor.pack(values, "<i8"), "<i8") == values).all()


def test_seating():
    rng = np.random.default_rng(0)
    customers = np.array([0, 1, 2, 5, 300, 5000])
    tables = seat(customers, np.full(6, 0.5), 0.5, rng)
    assert (tables <= customers).all() and (tables[1:] >= 1).all() and tables[0] == 0
    assert (seat(customers, np.full(6, 1e12), 0.5, rng) == customers).all()
    # Two customers share a table with probability (1 - d) / (1 - d + weight).
    many = seat(np.full(20_000, 2), np.full(20_000, 0.5), 0.2, rng)
    assert abs((many == 1).mean() - 0.8 / 1.3) < 0.02


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    n_words = 40
    context, word = np.repeat([5, 256, 9], n_words), np.tile(np.arange(n_words), 3)
    customers = rng.integers(0, 6, len(word)) * rng.integers(0, 2, len(word))
    customers[:n_words] += 1
    samples = sample_seating(context, word, customers, n_words, 1.0, 3)
    totals = Totals(bucket_totals(context, customers, samples))
    assert (totals.known, totals.tokens) == (n_words, customers.sum())
    cells = np.stack([customers, *[s[0] for s in samples]], 1)
    words = np.stack([*[s[2][word] for s in samples], *[s[1][word] for s in samples]], 1)
    for c in (5, 256, 9):
        at = context == c
        unknown = totals.log_probabilities(np.array([c]), np.zeros((1, 1 + KEPT)), np.zeros((1, 2 * KEPT)))
        assert math.isclose((10 ** totals.log_probabilities(context[at], cells[at], words[at])).sum() + 10 ** unknown[0], 1.0, rel_tol=1e-9)
    new_context = totals.log_probabilities(np.full(n_words, 77), np.zeros((n_words, 1 + KEPT)), words[:n_words])
    assert (10**new_context).sum() < 1


def base_rows(texts, held):
    """texts: id -> text"""
    tokens = {i: [*WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {
        i: (held(i), len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        for i, ws in tokens.items()
    }


def crc_held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", 50)
    texts = {1: None, 2: "", 3: " \n", 4: "A a É é", 5: "word " * 30_000, 6: "\x1c x\x85y", **{k: f"the word {k} the end" for k in range(7, 60)}}
    docs = spark.createDataFrame([(i, t, "b", 1) for i, t in texts.items()], "doc_id long, text string, block string, id int").repartition(3)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    found = {r.doc_id: r for r in pitman_yor.score_texts(docs, held).collect()}
    expected = base_rows(texts, crc_held)
    assert set(found) == set(texts)
    for i, (h, n, known, all_, base) in expected.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, all_)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0
    repeated = pitman_yor.score_texts(docs.limit(0).union(spark.createDataFrame([(None, "x y", "b", 1)] * 2, docs.schema)), held).collect()
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in repeated] == [(None, 3, 3, 6)] * 2
    nothing = pitman_yor.score_texts(docs.limit(5), F.lit(True)).collect()
    assert all((r.score, r.base_score, r.n_known) == (0.0, 0.0, 0) for r in nothing)


def test_documents(spark):
    from rowmill.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = QUERIES["op8_lm_score"](spark, folder).collect()
    expected = base_rows(texts, crc_held)
    assert len(found) == len(texts)
    for r in found:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == expected[r.doc_id][:4]
        assert math.isclose(r.base_score, expected[r.doc_id][4], rel_tol=1e-9)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert CONTEXTS == 257
    print("held-out log10 per token:", sum(r.score for r in held) / sum(r.n_tokens for r in held), sum(r.base_score for r in held) / sum(r.n_tokens for r in held))


def test_draws_depend_on_the_dish_only():
    rng = np.random.default_rng(4)
    customers, weight = rng.integers(0, 3000, 500), rng.random(500) * 3
    keys = rng.integers(0, 2**64, 500, np.uint64)
    whole = pitman_yor.seat_keyed(customers, weight, 0.6, keys)
    parts = [pitman_yor.seat_keyed(customers[k::7], weight[k::7], 0.6, keys[k::7]) for k in range(7)]
    assert all((whole[k::7] == parts[k]).all() for k in range(7))


def test_long_queues_are_seated_exactly(monkeypatch):
    def means(n):
        return [seat(np.full(4000, n), np.full(4000, w), d, np.random.default_rng(5)).mean() for w, d in ((0.3, 0.1), (20.0, 0.7))]

    drawn = means(1500)
    monkeypatch.setattr(pitman_yor, "ONE_BY_ONE", 1501)
    one_by_one = means(1500)
    assert np.allclose(drawn, one_by_one, rtol=0.02)


def test_partitions_do_not_change_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).select("doc_id", "text").localCheckpoint()
    held = F.col("doc_id") % 5 == 1
    one, many = ({r.doc_id: r.score for r in pitman_yor.score_texts(docs.repartition(n), held).collect()} for n in (1, 30))
    assert one == many


def test_pairs_of_words_count(spark):
    pairs = ["cats purr", "dogs bark", "vélos roulent", "trés brillent"]
    texts = [*pairs * 30, *pairs, "cats bark", "dogs purr", "vélos brillent", "trés roulent"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = pitman_yor.score_texts(docs, F.col("doc_id") >= 120).collect()
    score = {r.doc_id: r.score for r in rows}
    assert min(score[k] for k in range(120, 124)) > max(score[k] for k in range(124, 128)) + 1


def test_a_word_with_very_many_contexts(spark):
    """More contexts of one word in a block than 16 bits can count: the end after many words, a word after many words."""
    words = [f"w{i}" for i in range(70_000)]
    rows = [(str(i), w) for i, w in enumerate(words)] + [("line\nend", " x ".join(words)), (None, "w1 w2"), ("", "w3")]
    df = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    found = {r.doc_id: r for r in pitman_yor.score_texts(df, F.col("doc_id") == "5").collect()}
    assert len(found) == len(rows) and {None, "", "line\nend"} <= set(found)
    assert found["line\nend"].n_tokens == 140_000 and found["5"].held_out and found["5"].n_known == 2
    assert all(math.isfinite(r.score) and r.score < 0 for r in found.values())


def test_no_stored_step_moves_the_cells_twice(spark, monkeypatch):
    """Two joins in one step keep the shuffle files of both, and the old table, until its end."""
    joins, store = [], pitman_yor.Scratch.store

    def counted(self, df):
        joins.append(df._jdf.queryExecution().analyzed().toString().count("Join Inner"))
        return store(self, df)

    monkeypatch.setattr(pitman_yor.Scratch, "store", counted)
    scratch = pitman_yor.Scratch(spark, "pitman-yor-test")
    cells = scratch.store(spark.createDataFrame([(w, c, 1 + w * c) for w in range(4) for c in range(3)], "word long, context long, customers long"))
    state, words, totals = pitman_yor.sample_tables(scratch, cells)
    assert max(joins) == 1
    assert (state.count(), words.count(), totals.tokens) == (12, 4, sum(1 + w * c for w in range(4) for c in range(3)))


def test_keys_and_packed_arrays():
    values = np.random.default_rng(3).integers(0, 2**64, 1000, np.uint64)
    assert (pitman_yor.unmix(pitman_yor.mix(values)) == values).all()
    for some in (values, np.zeros(0, np.uint64), np.zeros(5, np.int64), np.arange(70_000)):
        assert (pitman_yor.get(pitman_yor.put(some)) == some.astype(np.uint64)).all()
    assert (pitman_yor.get_sorted(pitman_yor.put_sorted(np.sort(values))) == np.sort(values)).all()
    keys = np.sort(values)
    assert all((pitman_yor.whole_keys(pitman_yor.last_bits(keys, 16)[x:y], b, 16) == keys[x:y]).all() for b, x, y in pitman_yor.runs(pitman_yor.first_bits(keys, 16)))


def sampled_at_once(word, context, customers):
    """Every cell in every sweep, in arrays: tables per kept sample, then (served, root, beside) by number and the last sums."""
    items, place = pitman_yor.distinct(np.concatenate([word, context]))
    w, c = place[: len(word)], place[len(word) :]
    add = lambda of, values: np.bincount(of, values, len(items)).astype(np.int64)
    d1, tables = pitman_yor.estimate_discount((customers == 1).sum(), (customers == 2).sum()), np.ones(len(word), np.int64)
    served, beside = add(w, tables), add(c, tables)
    root, samples = (served > 0).astype(np.int64), []
    for sweep in range(pitman_yor.SWEEPS):
        d0 = pitman_yor.estimate_discount((served == 1).sum(), (served == 2).sum())
        fresh = (1 + d0 * root.sum()) / ((served > 0).sum() + 1)
        p_root = (np.maximum(served - d0 * root, 0) + fresh) / (1 + served.sum())
        tables = pitman_yor.seat_keyed(customers, (1 + d1 * beside[c]) * p_root[w], d1, pitman_yor.dish_keys(2 * sweep, word, context))
        served, beside = add(w, tables), add(c, tables)
        root = pitman_yor.seat_keyed(served, np.full(len(items), fresh), d0, pitman_yor.dish_keys(2 * sweep + 1, items))
        samples.append((tables, served, root, beside))
    return items, w, c, d1, samples[-KEPT:]


def test_rows_are_sampled_as_at_once(spark):
    rng = np.random.default_rng(8)
    pairs = np.unique(rng.integers(0, 2**64, 300, np.uint64)[rng.zipf(1.5, (4000, 2)) % 300], axis=0)
    word, context = pairs[:, 0].copy(), pairs[:, 1].copy()
    customers = rng.zipf(1.4, len(word)) % 900 + 1
    items, w, c, _, samples = sampled_at_once(word, context, customers)
    signed = lambda values: values.view(np.int64).tolist()
    rows = spark.createDataFrame([*zip(signed(word), signed(context), customers.tolist())], "word long, context long, customers long")
    state, words, totals = pitman_yor.sample_tables(pitman_yor.Scratch(spark, "pitman-yor-test"), rows)
    expected = {(a, b): (n, *t) for a, b, n, *t in zip(signed(word), signed(context), customers.tolist(), *[s[0].tolist() for s in samples])}
    assert {(r.word, r.context): (r.customers, r.tables0, r.tables1, r.tables2) for r in state.collect()} == expected
    found = {r.word: r for r in words.collect()}
    seen = np.bincount(w, customers, len(items)).tolist()
    assert set(found) == set(signed(items))
    for k, item in enumerate(signed(items)):
        r = found[item]
        assert (r.seen, r.served0, r.root0, r.tables0) == (seen[k], *(samples[0][i][k] for i in (1, 2, 3)))
        assert (r.served2, r.root2, r.tables2) == tuple(samples[2][i][k] for i in (1, 2, 3))
    assert (totals.known, totals.tokens, totals.served[1], totals.root[1]) == ((np.array(seen) > 0).sum(), customers.sum(), samples[1][1].sum(), samples[1][2].sum())


def test_texts_are_scored_as_at_once(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", 200)
    rng = np.random.default_rng(9)
    texts = {k: " ".join(f"w{n}" for n in rng.zipf(1.3, 30) % 500) for k in range(200)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in pitman_yor.score_texts(docs, F.col("doc_id") % 4 == 1).collect()}
    prints = pitman_yor.WordPrints()
    pairs = {k: [*zip([*(prints[x.encode()] for x in t.split()), 1], [256, *(prints[x.encode()] for x in t.split())])] for k, t in texts.items()}
    counts = Counter(p for k, ps in pairs.items() if k % 4 != 1 for p in ps)
    word, context = np.array([*counts], np.uint64).T.copy()
    items, w, c, d1, samples = sampled_at_once(word, context, np.array([*counts.values()]))
    number, cell = {int(v): k for k, v in enumerate(items)}, {p: k for k, p in enumerate(counts)}
    around = np.bincount(c, [*counts.values()], len(items))
    of = lambda values, key, where: int(values[where[key]]) if key in where else 0

    d0 = pitman_yor.estimate_discount((samples[-1][1] == 1).sum(), (samples[-1][1] == 2).sum())  # of the last sample, as in Totals

    def probability(a, b):
        total = 0
        for tables, served, root, beside in samples:
            p = (of(served, a, number) - d0 * of(root, a, number) + (1 + d0 * root.sum()) / ((served > 0).sum() + 1)) / (1 + served.sum())
            total += (counts[a, b] - d1 * of(tables, (a, b), cell) + (1 + d1 * of(beside, b, number)) * p) / (1 + of(around, b, number))
        return total / KEPT

    for k, ps in pairs.items():
        assert math.isclose(found[k].score, sum(math.log10(probability(a, b)) for a, b in ps), rel_tol=1e-9)


def test_a_frequent_word_is_dealt_to_all_buckets(spark, monkeypatch):
    """No stored table has a row per cell, and no bucket holds the cells of a word that stands beside all others."""
    rows, shares, store = [], [], pitman_yor.Scratch.store

    def measured(self, df):
        kept = store(self, df)
        rows.append(kept.count())
        if ("facts", "array<binary>") in kept.dtypes:
            size = F.aggregate("facts", F.lit(0), lambda n, x: n + F.octet_length(x))
            at = kept.where("kind in (0, 1)").groupBy("kind", "at").agg(F.sum(size).alias("size")).groupBy("kind").agg(F.max("size").alias("most"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("n"))
            shares.extend(r.most * r.n / r["all"] for r in at.collect() if r.n == 16 and r["all"])
        return kept

    monkeypatch.setattr(pitman_yor.Scratch, "store", measured)
    docs = spark.createDataFrame([(k, " ".join(f"the w{i}" for i in range(20_000))) for k in range(2)], "doc_id long, text string")
    found = pitman_yor.score_texts(docs, F.lit(False)).collect()
    assert [r.n_tokens for r in found] == [40_001] * 2
    assert max(rows) < 20_000 and shares and max(shares) < 2
