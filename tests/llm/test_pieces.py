"""Pieces: N best segmentations against listing them all, exact round trips."""

import itertools
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowmill.llm import pieces
from rowmill.llm.pieces import Lattice, apply_changes

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LATTICE = Lattice(MODEL, most=30)
TEXTS = ["", " ", "  a  ", "the thanedble", "a\n\nb \n", "▁ ▁x", "\U0001f600 é 漢字 \x00", "aaaaaaaaaaaaaaaa", "ﬁ \t q"]


def all_paths(text):
    """Costs of all segmentations of a text, least first."""
    words = LATTICE.split(text)

    def of(word):
        edges = LATTICE.edges(word)

        def go(i):
            if i == len(edges):
                return [(0, ())]
            return [(c + cost, ids + rest) for j, ids, c in edges[i] for cost, rest in go(j)]

        return go(0)

    return sorted(sum(c for c, _ in path) for path in itertools.product(*map(of, words)))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("theains \n▁é漢"), max_size=9), st.integers(1, 5))
def test_n_best(text, n):
    ids, ends, ranked = LATTICE.encode([text, "x"], n)
    costs, changes = ranked[0]
    assert costs == all_paths(text)[:n]
    best = ids[ends[0] : ends[1]].tolist()
    variants = [apply_changes(best, changes, rank) for rank in range(len(costs))]
    assert variants[0] == best
    assert len(set(map(tuple, variants))) == len(variants)
    for v in variants:
        assert b"".join(LATTICE.spelled[i] for i in v).decode() == (" " + text if text else "")


@pytest.mark.parametrize("text", TEXTS)
def test_search_agrees_with_viterbi(text):
    for word in LATTICE.split(text):
        ids, cost, extra = LATTICE.best(word)
        found = LATTICE.n_best(word, 2)
        assert found[0] == (cost, ids)
        assert (found[1][0] - cost if len(found) > 1 else float("inf")) == extra


def test_round_trip(spark):
    texts = [None, *TEXTS, "x" * 50_000, "word " * 20_000, "word " * 20_000]
    docs = spark.createDataFrame([(k if k else None, t, "i", 0) for k, t in enumerate(texts)], "doc_id long, text string, ids string, id int")
    found = pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()
    assert sorted((r.doc_id or 0, r.text) for r in found) == [(k, t or "") for k, t in enumerate(texts)]
    assert pieces.encode(docs.limit(0), MODEL).collect() == []


def test_documents(spark):
    from rowmill.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in QUERIES["op2_piece_segments"](spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        assert found[r.doc_id].decoded_crc32 == zlib.crc32(r.text.encode())
        assert found[r.doc_id].costs == sorted(found[r.doc_id].costs)


def test_decoding_holds_few_ids_at_a_time(spark, monkeypatch):
    """Ids of a batch come as many small batches; rows of more ids than a slice has stand alone."""
    monkeypatch.setattr(pieces, "SLICE_IDS", 40)
    texts = [None, "the word " * 7, "", "x" * 500, *["a few words"] * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    encoded = pieces.encode(docs, MODEL).select("doc_id", "ids").localCheckpoint()
    decoded = pieces.decode(encoded, MODEL)
    assert {r.doc_id: r.text for r in decoded.collect()} == {k: t or "" for k, t in enumerate(texts)}
    # What is remembered lies in arrays, not in lists of numbers.
    assert LATTICE.flat.itemsize == 4 and LATTICE.cost.itemsize == LATTICE.extra.itemsize == 8
