"""Near copies: signatures, sketches and the whole join against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowmill.llm import near_copies
from rowmill.llm.near_copies import Threshold, different_at_least, parity_sketch, signatures
from rowmill.llm.shingles import WordPrints, exact_shingles, shingle_sets

THRESHOLD = Threshold()


def components(sets: dict) -> dict:
    """Smallest reachable id, by comparing all pairs."""
    found = {i: i for i in sets}

    def root(i):
        while found[i] != i:
            i = found[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                found[b] = a
    return {i: root(i) for i in ids}


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 120), st.integers(0, 10**9), st.booleans())
def test_similar_sets_share_a_signature(size, changed, seed, common):
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 2**63, size, np.uint64))
    other = np.unique(np.concatenate([base[min(changed, len(base)) // 2 :], rng.integers(0, 2**63, changed // 2, np.uint64)]))
    if not len(other):
        return
    both = len(np.intersect1d(base, other))
    different = len(base) + len(other) - 2 * both
    assert different_at_least(parity_sketch(base), parity_sketch(other)) <= different
    if THRESHOLD.linked(both, len(base) + len(other)):
        assert different <= THRESHOLD.most_different(len(base) + len(other))
        frequent = np.sort(rng.choice(base, len(base) // 2, replace=False)) if common else np.zeros(0, np.uint64)
        a, b = (set(np.concatenate(signatures(s, THRESHOLD, frequent)).tolist()) for s in (base, other))
        assert a & b


@given(st.lists(st.integers(-(2**62), 2**62), min_size=1, max_size=6))
def test_packed_ids(ids):
    for own in (np.array(ids), np.sort(np.array(ids) % 1000)):
        assert (near_copies.unpack_ids(near_copies.pack_ids(own), len(own)) == own).all()
    sigs = np.array(ids).astype(np.uint64)
    assert (near_copies.unpack_signatures(near_copies.pack_signatures(sigs)) == sigs % np.uint64(2**48)).all()


def test_shingles():
    texts = [b"", b" \n", b"One two", b"a b c d e", b"a b c d e f A B c D e", "é x a b c".encode()]
    sets = shingle_sets(texts, WordPrints())
    assert [len(s) for s in sets] == [len(exact_shingles(t)) for t in texts] == [0, 0, 1, 1, 6, 1]


def family(rng, words, n, rate):
    """Copies of one text with some words changed."""
    return [" ".join(w if rng.random() > rate else f"x{rng.integers(10**6)}" for w in words) for _ in range(n)]


@pytest.mark.parametrize("blocks", [1024, 7])
def test_all_links(spark, monkeypatch, blocks):
    monkeypatch.setattr(near_copies, "BLOCK", blocks)
    rng = np.random.default_rng(5)
    line = "shared passage of many words that stands in every text " * 3
    texts = [None, "", " ", "one two", "One  TWO", "one two three"]
    for size, rate in ((8, 0.02), (30, 0.01), (200, 0.02), (200, 0.025), (700, 0.03)):
        words = [f"w{rng.integers(10**5)}" for _ in range(size)]
        texts += family(rng, words, 25, rate)
    texts += [line + " ".join(f"u{rng.integers(10**6)}" for _ in range(rng.integers(3, 60))) for _ in range(120)]
    texts += [line] * 5
    chain = [f"c{k}" for k in range(400)]
    texts += [" ".join(chain[k * 9 : k * 9 + 150]) for k in range(20)]
    rows = [(int(i), t, 1, "a") for i, t in zip(rng.permutation(len(texts)), texts)]
    docs = spark.createDataFrame([*rows, rows[40], (None, "x y", 1, "a")], "doc_id long, text string, id int, sig string").repartition(6)
    found = near_copies.link_copies(docs).collect()
    sets = {i: exact_shingles((t or "").encode()) for i, t, *_ in rows}
    expected = components(sets)
    assert len(found) == len(rows) + 2
    for r in found:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), expected[r.doc_id])
        else:
            assert r.component_id is None
    assert near_copies.link_copies(docs.limit(0)).collect() == []


def test_copies_meet_once(spark, monkeypatch):
    """Groups of equal texts in many tasks ask for one pair per two texts, not for one per two rows."""
    asked = []
    possible = near_copies.possible
    monkeypatch.setattr(near_copies, "possible", lambda pairs, *rest: asked.append(pairs.count()) or possible(pairs, *rest))
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(150)]
    texts = family(rng, words, 6, 0.05)
    rows = [(k, texts[k % 6]) for k in range(240)] + [(240, "x y z"), (7, texts[3]), (7, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    found = {r.doc_id: r.component_id for r in near_copies.link_copies(docs).collect()}
    sets = {k: exact_shingles(t.encode()) for k, t in rows[:241]}
    expected = components(sets)
    joined = {expected[240], expected[7], expected[3]}
    assert found == {i: min(joined) if c in joined else c for i, c in expected.items()}
    # Six texts, and the id with several.
    assert len(asked) == 3 and max(asked) <= 7 * 6 // 2


def test_sketches_of_a_block_keep_their_width(spark):
    """A short text in a block does not blur the sketches of the long ones."""
    rng = np.random.default_rng(9)
    sets = {0: np.arange(3, dtype=np.uint64), **{k: np.unique(rng.integers(0, 2**63, 900, np.uint64)) for k in range(1, 30)}}
    prints = spark.createDataFrame([(k, len(s), bytearray(parity_sketch(s))) for k, s in sets.items()], "id long, n long, sketch binary")
    members = spark.createDataFrame([(1, k, k) for k in sets], "sig long, id long, component long")
    assert near_copies.open_pairs(members, prints, THRESHOLD).count() == 0


def test_pairs_of_many_signatures_come_once(spark):
    """Members that meet in many signatures give a pair in the first of them only, in blocks of any size."""
    rng = np.random.default_rng(11)
    words = np.unique(rng.integers(0, 2**63, 200, np.uint64))
    prints = spark.createDataFrame([(k, 200, bytearray(parity_sketch(words))) for k in range(30)], "id long, n long, sketch binary")
    members = spark.createDataFrame([(sig, k, k) for sig in range(-20, 20) for k in range(30) if k % 15 or sig > 0], "sig long, id long, component long")
    assert near_copies.block_pairs(members, prints, THRESHOLD).count() == 30 * 29 // 2
    near_copies_block, near_copies.BLOCK = near_copies.BLOCK, 7
    try:
        assert near_copies.block_pairs(members, prints, THRESHOLD).count() == 30 * 29 // 2
    finally:
        near_copies.BLOCK = near_copies_block


def test_sketches_drop_most_unlinked_pairs():
    """Pairs of similarity 0.74, which share signatures often, seldom pass the sketches."""
    passed = 0
    for seed in range(200):
        values = np.unique(np.random.default_rng(seed).integers(0, 2**63, 190, np.uint64))
        rng = np.random.default_rng(seed + 1000)
        values = rng.permutation(values)
        a, b = np.sort(values[:165]), np.sort(values[25:])
        assert not THRESHOLD.linked(140, 330)
        passed += different_at_least(parity_sketch(a), parity_sketch(b)) <= THRESHOLD.most_different(330)
    assert passed < 20


def test_documents(spark):
    from rowmill.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op10_near_copies"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    sets = {r.doc_id: exact_shingles((r.text or "").encode()) for r in docs}
    expected = components(sets)
    assert found == {i: (len(s), expected[i]) for i, s in sets.items()}
    assert sum(i != c for i, c in expected.items()) > 20
