"""BPE against the tokenizers library, and the lexicon automaton by itself."""

import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from gyrespark.llm import bpe, lexicon

ODD = [None, "", " \n\t", "Hello  World's foo123 don't!! <|endoftext|>x", "é É é İ ſ 😀 \xa0  x \x1cy\x1d", "ab\x00c İstanbul ΑΣ Σ",
       "a_b-c'sé ''s 'll's", "<|startoftext|><|endoftext|>a<|endof", "� ‍ ͅ ǅ", "x" * 3000 + "ab" * 4000, "1234 ¼²", "'S'T 'RE",
       "　’s\x85z q", "word " * 500]


def test_lexicon_is_minimal_and_exact():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))).encode() + b"ing" for _ in range(500)})
    outputs = [[i, i * 2][: i % 3] for i in range(len(words))]
    data = np.frombuffer(lexicon.build(words, outputs), dtype=np.int64)
    lex = lexicon.Lexicon(data)
    assert lex.numbers(words).tolist() == list(range(len(words)))
    assert [lex.output(i) for i in range(len(words))] == outputs
    other = [w + b"x" for w in words] + [w[:-1] for w in words if w[:-1] not in set(words)] + [b""]
    assert set(lex.numbers(other).tolist()) == {-1}
    # words that share every ending share its states
    tail = lexicon.Lexicon(np.frombuffer(lexicon.build([b"aing", b"bing", b"cing"], [[], [], []]), dtype=np.int64))
    assert len(tail.keys) == 6
    empty = lexicon.Lexicon(np.frombuffer(lexicon.build([], []), dtype=np.int64))
    assert empty.numbers([b"a", b""]).tolist() == [-1, -1]


def test_equals_tokenizers_library(spark):
    path = bpe.tokenizer_path()
    library = Tokenizer.from_file(path)
    rng = random.Random(4)
    rows = list(enumerate(ODD)) + [(100 + i, " ".join("".join(rng.choice("aeinrst'éß1.") for _ in range(rng.randrange(1, 14))) for _ in range(60))) for i in range(30)]
    rows += [(None, "some text"), (3, ODD[3])]
    frame = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id bigint, text string, ids binary")
    for lexicon_words in (0, 50, bpe.LEXICON_WORDS):
        got = bpe.encode(frame, lexicon_words=lexicon_words).collect()
        assert len(got) == len(rows)
        for r, (i, t) in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0]))):
            want = library.encode(t or "", add_special_tokens=False).ids
            assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want, (i, t)
            assert r.decoded == library.decode(want, skip_special_tokens=False)
            assert bpe.model(path).decode(want) == r.decoded
    digest = {r.doc_id: r for r in bpe.op3(frame).collect()}
    want = library.encode(ODD[3], add_special_tokens=False).ids
    assert digest[3].n_tokens == len(want) and digest[3].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert digest[0].n_tokens == 0 and digest[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark):
    assert bpe.op3(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
