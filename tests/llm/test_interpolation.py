"""Deleted interpolation against counts and mixtures in plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gyrespark.llm import blobs, interpolation

END = ""


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w.decode() for w in low.encode().split()] + [END]


def plain_model(rows):
    role = {}
    for i, _ in rows:
        crc = zlib.crc32(str(i).encode())
        role[i] = 2 if crc % 7 == 2 else 1 if crc // 7 % interpolation.DELETED == 0 else 0
    count = [Counter(), Counter()]
    pair = [Counter(), Counter()]
    for i, t in rows:
        if role[i] < 2:
            seq = tokens(t)
            count[role[i]].update(seq)
            pair[role[i]].update(zip([END] + seq, seq))
    return role, count, pair


def context(n):
    return min(math.ceil(math.log2(n + 1)), interpolation.CONTEXTS - 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = [f"W{i}" for i in range(60)]
    out = [(i, " ".join(words[(rng.randrange(4) * 13 + j) % 60] if rng.random() < 0.8 else rng.choice(words) for j in range(rng.randrange(30)))) for i in range(300)]
    return out + [(300, None), (301, ""), (302, "never seen words é\x0bx"), (17, out[17][1])]


def test_scores_equal_plain_python(spark, rows):
    got = interpolation.op1(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, role string")).collect()
    assert len(got) == len(rows)
    role, count, pair = plain_model(rows)
    total, both = count[0] + count[1], pair[0] + pair[1]
    n, v, n0, v0 = sum(total.values()), len(total), sum(count[0].values()), len(count[0])
    # events of the deleted part, unbinned
    events = []
    for i, t in rows:
        if role[i] == 1:
            seq = tokens(t)
            for a, b in zip([END] + seq, seq):
                c = count[0][a]
                events.append((context(c), count[0][b] / n0, pair[0][a, b] / c if c else 0.0))
    ctx, one, two = (np.array(x) for x in zip(*events))
    weights = interpolation.learn_weights(ctx, np.ones(len(ctx)), one, two, 1 / (v0 + 1))
    assert np.allclose(weights.sum(axis=1), 1)
    text_of = dict(rows)
    for r in got:
        seq = tokens(text_of[r.doc_id])
        assert r.held_out == (role[r.doc_id] == 2) and r.train_tokens == n and r.n_tokens == len(seq)
        assert r.n_known == sum(total[w] > 0 for w in seq)
        assert r.base_score == pytest.approx(sum(math.log10((total[w] + 1) / (n + v + 1)) for w in seq), rel=1e-9)
        want = 0.0
        for a, b in zip([END] + seq, seq):
            w = weights[context(total[a])]
            want += math.log10(w[0] / (v + 1) + w[1] * total[b] / n + (w[2] * both[a, b] / total[a] if total[a] else 0))
        assert r.score == pytest.approx(want, rel=0.02)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.8  # pairs help on this text
    # given any predecessor, the probabilities of all tokens and the unknown one sum to one
    for a in (END, "w1", "w17"):
        w = weights[context(total[a])]
        mass = sum(w[0] / (v + 1) + w[1] * total[b] / n + w[2] * both[a, b] / total[a] for b in total) + w[0] / (v + 1)
        assert mass == pytest.approx(1, abs=1e-9)


def test_odd_tables(spark):
    frame = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id bigint, text string")
    got = sorted(interpolation.op1(frame).collect(), key=lambda r: r.n_tokens)
    assert [(r.doc_id, r.held_out, r.n_tokens, r.train_tokens) for r in got] == [(None, False, 1, 4), (None, False, 3, 4)]
    assert interpolation.op1(frame.limit(0)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = interpolation.op1(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).first()
    assert (only.train_tokens, only.base_score, only.score, only.n_known) == (0, 0.0, 0.0, 0)


def test_cells_round_trip():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    assert (blobs.unpack_sorted(blobs.pack_sorted(keys)) == keys).all()
    assert len(blobs.unpack(blobs.pack(np.empty(0, np.uint32)), np.uint32)) == 0
    ends = blobs.bucket_bounds(keys, 7)
    assert ends[0] == 0 and ends[-1] == len(keys) and (np.diff(ends) > 0).all()
    assert len(np.unique(blobs.mix(keys))) == len(keys)


def test_long_text_and_clashing_columns(spark):
    """A text of 400,000 words is scored whole; other columns do not disturb."""
    words = [f"w{i * i % 5003}" for i in range(400_000)]
    long_id = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2 and zlib.crc32(str(i).encode()) // 7 % interpolation.DELETED)
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    frame = spark.createDataFrame([(long_id, " ".join(words), 1, "x"), (held, "w0 w1 unseen", 2, "y")], "doc_id bigint, text string, block bigint, kind string")
    got = {r.doc_id: r for r in interpolation.op1(frame).collect()}
    total = Counter(words) + Counter([END])
    n, v = len(words) + 1, len(total)
    assert (got[long_id].n_tokens, got[long_id].n_known, got[long_id].train_tokens) == (n, n, n)
    assert got[long_id].base_score == pytest.approx(sum(c * math.log10((c + 1) / (n + v + 1)) for c in total.values()), rel=1e-9)
    assert (got[held].n_tokens, got[held].n_known) == (4, 3)
