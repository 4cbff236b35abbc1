"""Automaton counts against plain greedy longest match."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gyrespark.llm import wordpiece


def greedy(word, first, further):
    n, at = 0, 0
    while at < len(word):
        pieces = further if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.sets(st.text("abc", min_size=1, max_size=5), max_size=12),
       st.lists(st.text("abcd", min_size=1, max_size=14), max_size=8))
def test_counts_equal_greedy(first, further, words):
    machine = wordpiece.Automaton(sorted(first), sorted(further))
    for word in words:
        assert machine.count(word) == greedy(word, first, further)


@pytest.fixture(scope="module")
def pieces():
    """The vocabulary, read independently of the operator."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=wordpiece.vocabulary_path())
    return {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}


def longest(word, pieces):
    """Greedy longest match of a word after the word start."""
    n, rest = 0, "▁" + word
    while rest:
        end = next((e for e in range(len(rest), 0, -1) if rest[:e] in pieces), None)
        if end is None:
            return -1
        n, rest = n + 1, rest[end:]
    return n


def test_texts(spark, pieces):
    rng = random.Random(2)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "Hello world, unbelievable!"), (4, "日本 ☃☃ x\x0by"), (5, "a" * 5000), (None, "null id"), (3, "Hello world, unbelievable!")]
    rows += [(10 + i, " ".join("".join(rng.choice("aeinrstzéñ,.") for _ in range(rng.randrange(1, 20))) for _ in range(80))) for i in range(20)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n_tokens int")
    want = []
    for i, t in rows:
        counts = [longest(w.decode(), pieces) for w in (t or "").encode().split()]
        want.append((i, len(counts), sum(abs(c) for c in counts), counts.count(-1)))
    assert sorted(map(str, (tuple(r) for r in wordpiece.op7(frame).collect()))) == sorted(map(str, want))
    assert wordpiece.op7(frame.limit(0)).count() == 0


def test_words_that_only_the_bare_start_begins(spark, pieces):
    assert "▁" in pieces and "▁2" not in pieces
    words = ["2024", "ñandú", "日本語", "3.14", "word", "çà", "日☃", "\U0001f9ff", "x2", "2x"]
    got = wordpiece.op7(spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id bigint, text string")).collect()
    assert {words[r.doc_id]: r.n_tokens if not r.n_unknown else -1 for r in got} == {w: longest(w, pieces) for w in words}
    assert longest("2024", pieces) == 5
