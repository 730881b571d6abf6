"""Packing: schedules against a walk token by token, ids against the tokenizer, whole query."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rowmill.llm import packing
from rowmill.llm.packing import Schedule
from rowmill.llm.token_ids import WordIds

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def layout(schedule, totals):
    """Every token's (sequence, offset), taken one document of seven tokens at a time."""
    out = {}
    for q, total in enumerate(totals):
        for first in range(0, total, 7):
            n = min(7, total - first)
            covered = []
            for start, length, sequence, offset in schedule.pieces(q, first, n):
                assert length > 0
                for i in range(length):
                    covered.append(start + i)
                    assert (sequence, offset + i) not in out
                    out[sequence, offset + i] = q
            assert covered == list(range(n))
    return out


@pytest.mark.parametrize("weights", [None, [1.0, 1.0, 2.0], [0.7, 0.2, 0.1]])
@pytest.mark.parametrize("totals", [[500, 301, 77], [64, 64, 64], [1, 0, 1000], [5, 2, 1]])
def test_every_token_has_one_place(totals, weights):
    schedule = Schedule(totals, weights, window=16)
    places = layout(schedule, totals)
    assert len(places) == sum(totals)
    sizes = Counter(s for s, _ in places)
    full = sum(totals) // 16
    assert all(sizes[s] == 16 for s in range(full))
    assert [sizes[s] for s in range(full, len(sizes))] == schedule.tail()
    assert all({o for s2, o in places if s2 == s} == set(range(n)) for s, n in sizes.items())


def test_windows_hold_the_shares():
    totals = [5000, 2000, 1500, 1500]
    places = layout(Schedule(totals, None, window=100), totals)
    windows = defaultdict(Counter)
    for (s, _), q in places.items():
        windows[s][q] += 1
    for s in range(100):
        for q, total in enumerate(totals):
            assert abs(windows[s][q] - total / 100) <= 1


def test_weights_hold_until_a_queue_runs_dry():
    totals = [4000, 4000]
    places = layout(Schedule(totals, [3.0, 1.0], window=100), totals)
    windows = defaultdict(Counter)
    for (s, _), q in places.items():
        windows[s][q] += 1
    assert all(abs(windows[s][0] - 75) <= 1 for s in range(53))
    assert all(windows[s][0] == 0 for s in range(54, 80))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    return WordIds(VOCABULARY, most=50)


CASES = [
    "", " ", "Heesble, the THE don't I'll 12a3 x_y -- ###", "Ère ñandú ÜBER straße ŒUVRE İstanbul ΣΑΣ",
    "a<|endoftext|>b <|startoftext|> <|x", "tab\tnew\nline\x0b\x0c\r end", " no break　ideographic", "é café ́x",
    "漢字 かな 한국어 \U0001f600!", "\x1c\x1d\x00 zero", "ﬁ ² ½ Ⅷ", "it's 'S 'RE we've",
]


def test_ids_equal_the_tokenizer(tokenizer, encoder):
    ids, ends = encoder.encode([t.encode() for t in CASES], 1)
    starts = [0, *ends[:-1]]
    for text, a, b in zip(CASES, starts, ends):
        assert ids[a:b].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aB'é ß\n<|>9.İſ"))), max_size=4))
def test_ids_of_any_text(texts):
    tokenizer, encoder = Tokenizer.from_file(VOCABULARY), test_ids_of_any_text.encoder
    ids, ends = encoder.encode([t.encode() for t in texts])
    for text, a, b in zip(texts, [0, *ends[:-1]], ends):
        assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


test_ids_of_any_text.encoder = WordIds(VOCABULARY)


def check_pieces(rows, texts, tokenizer):
    """``texts``: list of (id, text); rows of one id are matched by their token counts in order."""
    wanted = sorted((i or 0, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in texts)
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id or 0].append(r)
    repeated = Counter(i or 0 for i, _ in texts)
    for i, ids in wanted:
        if repeated[i] > 1:
            continue
        at = 0
        for r in sorted(found[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert bytes(r.ids) == np.array(ids[at : at + r.length], "<u4").tobytes()
            at += r.length
        assert at == len(ids)
    spans = defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
    for sequence in spans.values():
        at = 0
        for offset, length in sorted(sequence):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in wanted)


def test_pack_odd_rows(spark, tokenizer):
    texts = [(1, None), (2, ""), (3, "word " * 9000), (4, "the end"), (4, "the end"), (None, "no id")]
    rows = [(i, t, None if k % 2 else "s", k, "q", 0) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, id int, queue string, ids int")
    found = packing.pack(docs, VOCABULARY).collect()
    check_pieces(found, texts, tokenizer)
    assert {r.doc_id for r in found} == {1, 2, 3, 4, None}
    assert packing.pack(docs.limit(0), VOCABULARY).collect() == []


def test_pack_documents(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    found = packing.pack(docs, VOCABULARY).collect()
    check_pieces(found, texts, tokenizer)
    from rowmill.llm.queries import QUERIES

    rows = QUERIES["op5_packing"](spark, "/root/testdata/sf0.001").collect()
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


def halves(rows):
    """Tokens of every source in the first half of all tokens, and in all."""
    total = sum(r.length for r in rows)
    early, whole = Counter(), Counter()
    for r in rows:
        whole[r.queue] += r.length
        early[r.queue] += r.length if r.sequence_id * 2048 + r.offset < total // 2 else 0
    return early, whole


def test_every_small_source_is_spread(spark, tokenizer):
    # 1,100 sources of equal size, one after the other in the table.
    texts = [(k, f"source {k % 1100} " + "word " * 500) for k in sorted(range(2200), key=lambda k: k % 1100)]
    docs = spark.createDataFrame([(k, t, f"s{k % 1100}") for k, t in texts], "doc_id long, text string, source string").coalesce(2)
    rows = packing.pack(docs, VOCABULARY).collect()
    check_pieces(rows, texts, tokenizer)
    early, whole = halves(rows)
    assert len(whole) == 1100
    assert all(abs(early[q] - n / 2) <= 2 * packing.GRAIN for q, n in whole.items())


def test_weights_of_small_sources_count(spark, tokenizer):
    texts = [(k, "word " * 300) for k in range(1300)]
    docs = spark.createDataFrame([(k, t, f"s{k}") for k, t in texts], "doc_id long, text string, source string").coalesce(2)
    weights = {f"s{k}": 1.0 for k in range(1300)} | {"s1298": 20.0, "s1299": 0.1}
    rows = packing.pack(docs, VOCABULARY, weights=weights).collect()
    check_pieces(rows, texts, tokenizer)
    early, whole = halves(rows)
    assert early["s1298"] == whole["s1298"] == 301
    assert early["s1299"] <= 2 * packing.GRAIN


def test_ids_of_odd_words_equal_the_full_tokeniser():
    import random

    from tokenizers import Tokenizer

    from rowmill.llm.queries import vocabulary
    from rowmill.llm.token_ids import WordIds

    path = vocabulary("word_bpe_49k.json")
    full, quick = Tokenizer.from_file(path), WordIds(path, 20_000)
    rng = random.Random(1)
    pieces = ["it's", "It'S", "don't", "a1", "1a", "x,", "X.", "--", "<|endoftext|>", "<|ENDOFTEXT|>", "é", "Été,", "日本", "we'll!", "'s"]
    pieces += ["a'b", "ﬁ", "ǅ", "x²", "…", "á", "İ", "Ā9", "\x1c", "a\x00b", "$5.00", "http://x.y/z?q=1", " ", "Ⅷ", "I'M", "é's"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "\n", "\t"]) for _ in range(rng.randrange(30))) for _ in range(600)]
    for at in range(0, len(texts), 7):
        ids, ends = quick.encode([t.encode() for t in texts[at : at + 7]])
        starts = [0, *ends.tolist()]
        for k, text in enumerate(texts[at : at + 7]):
            assert ids[starts[k] : starts[k + 1]].tolist() == full.encode(text, add_special_tokens=False).ids, text
