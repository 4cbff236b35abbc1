"""Votes, label model and scores against plain Python, rates on simulated votes, held-out accuracy against true labels."""

import math
import re

import duckdb
import numpy as np
import pytest

from gyrespark.llm import weaklabels

FOLDER = "/root/testdata/sf0.01"


def test_label_model_recovers_rates():
    rng = np.random.default_rng(1)
    n, true_bad = 20_000, rng.random(20_000) < 0.2
    bad_vote = np.array([[0.6, 0.5, 0.7, 0.4, 0.6, 0.5, 0.5], [0.02, 0.01, 0.03, 0.01, 0.01, 0.02, 0.01]])  # of bad and of good documents
    votes = np.where(rng.random((n, 7)) < np.where(true_bad[:, None], bad_vote[0], bad_vote[1]), -1, 1)
    votes[rng.random((n, 7)) < 0.1] = 0
    patterns, at, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, chance, good = weaklabels.label_model(patterns, count.astype(float))
    assert prior == pytest.approx(0.8, abs=0.04)
    assert np.abs(chance[0] - bad_vote[0]).max() < 0.1 and np.abs(chance[1] - bad_vote[1]).max() < 0.03
    assert ((good[at.ravel()] < 0.5) == true_bad).mean() > 0.93


def test_accuracy_on_labels(spark):
    got = {r.doc_id: r for r in weaklabels.op10(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    rows = duckdb.sql(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet'").fetchall()
    assert np.mean([got[i].kept for i, q in rows if q == 1]) > 0.97
    assert np.mean([not got[i].kept for i, q in rows if q == 0]) > 0.8
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    prose = "The river ran slowly over old stones.\nBirds were singing in every tree.\nNobody came to look at them today, though. "
    rows = [(i, prose + f"Line {i} ends here.", 1) for i in range(40)] + [(50 + i, f"A{i} || ## %% " * 40, 1) for i in range(10)]
    rows += [(100, None, 1), (101, "", 1), (102, " \n", 1), (None, prose, 1), (3, prose + "Line 3 ends here.", 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, votes int")
    got = weaklabels.op10(frame).collect()
    assert len(got) == len(rows)
    assert all((r.score, r.kept) == (0.0, False) for r in got if r.doc_id in (100, 101, 102))
    assert all(r.kept for r in got if r.doc_id is None or r.doc_id < 40) and not any(r.kept for r in got if r.doc_id and 50 <= r.doc_id < 60)
    assert weaklabels.op10(frame.limit(0)).count() == 0
    full = weaklabels.classify(frame).collect()
    assert all(0 <= r.posterior <= 1 and set(r.votes) <= {-1, 0, 1} for r in full)
    assert weaklabels.op10(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).first().kept is False


def test_long_texts_and_all_menu_marks_vote(spark):
    long = " ".join(f"Word{i} flows." for i in range(150))
    rows = [(0, long), (1, long + " All rights reserved."), (2, "sign in " * 20 + "now"), (3, "Home » News » Sport » About » Help"), (4, "Home • News • Sport • About • Help")]
    got = {r.doc_id: dict(zip(weaklabels.votes(), r.votes)) for r in weaklabels.with_votes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i]["phrases"] for i in range(3)] == [1, 0, -1]
    assert [got[i]["bars"] for i in (0, 3, 4)] == [1, -1, -1]


def plain_votes(text):
    """The twelve rules on one text, in the order of ``weaklabels.votes``."""
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^ \t\n\x0b\x0c\r]", x)]
    n, chars = len(words), sum(map(len, words))
    number = lambda marks: sum(text.count(m) for m in marks)
    share = lambda part, whole: part / max(whole, 1)
    vote = lambda good, bad: -1 if bad else 1 if good else 0
    distinct = share(sum(len(set(words[i:i + 100])) for i in range(0, n, 100)), n)
    upper, loud = share(len(re.findall("[A-Z]", text)), chars), share(number("!?"), n)
    signs, bars = number("#*$%&|<>=_~^"), share(number("|\u00bb\u2022"), n)
    again, stops = share(sum(a == b for a, b in zip(words, words[1:])), n), share(number(".;:"), n)
    length, copies = share(chars, n), share(len(lines) - len(set(lines)), len(lines))
    phrases = share(sum(text.lower().count(p) for p in weaklabels.PHRASES), n)
    return [vote(n >= 50, n < 5), vote(distinct > 0.4, n >= 30 and distinct < 0.2), vote(upper < 0.15, upper > 0.3),
            vote(loud < 0.02, loud > 0.3), vote(share(signs, n) < 0.03, share(signs, n) > 0.25),
            vote(share(signs, chars) < 0.01, share(signs, chars) > 0.04), vote(bars < 0.02, bars > 0.15),
            vote(again < 0.03, n >= 10 and again > 0.1), vote(3 <= length <= 9, length < 2 or length > 15),
            vote(0.02 <= stops <= 0.35, n >= 30 and (stops < 0.005 or stops > 0.7)),
            vote(len(lines) >= 3 and copies == 0, copies > 0.3), vote(n >= 30 and phrases <= 0.001, phrases > 0.005)]


def test_votes_posteriors_and_scores_equal_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    votes = {i: plain_votes(t) for i, t in texts.items()}
    rows = weaklabels.with_votes(weaklabels.texts(docs)).persist()
    assert {r.doc_id: list(r.votes) for r in rows.collect()} == votes

    # expectation-maximisation over documents, one number at a time
    prior, rate = 0.85, [[0.2] * 12, [0.005] * 12]
    weight = 0.02 * len(votes) + 1
    for _ in range(100):
        good = {}
        for i, v in votes.items():
            chance = [1 - prior, prior]
            for c in (0, 1):
                for h in range(12):
                    chance[c] *= rate[c][h] if v[h] == -1 else 1 - rate[c][h] if v[h] == 1 else 1
            good[i] = chance[1] / sum(chance)
        prior = (sum(good.values()) + 0.85 * weight) / (len(votes) + weight)
        for c, guess in ((0, 0.2), (1, 0.005)):
            part = {i: g if c else 1 - g for i, g in good.items()}
            rate[c] = [(sum(part[i] for i, v in votes.items() if v[h] == -1) + weight * guess)
                       / (sum(part[i] for i, v in votes.items() if v[h]) + weight) for h in range(12)]
    patterns, n = np.unique(np.array(list(votes.values())), axis=0, return_counts=True)
    found, bad_vote, _ = weaklabels.label_model(patterns, n.astype(float))
    assert found == pytest.approx(prior, abs=1e-6) and bad_vote == pytest.approx(np.array(rate), abs=1e-6)
    posterior = weaklabels.posterior_of(found, bad_vote)
    got = {r.doc_id: r.p for r in rows.select("doc_id", posterior.alias("p")).collect()}
    assert all(got[i] == pytest.approx(g, abs=1e-6) for i, g in good.items())

    model = weaklabels.fit_scorer(rows, 1.0, posterior, 1 << 12)
    scored = model.transform(weaklabels.hashed(rows, 1 << 12)).select("doc_id", "_tokens", weaklabels.vector_to_array("probability")[1].alias("p")).collect()
    hashing = weaklabels.HashingTF(numFeatures=1 << 12)
    for r in scored[::25]:
        counts = {}
        for t in r._tokens:
            counts[hashing.indexOf(t)] = counts.get(hashing.indexOf(t), 0) + 1
        size = math.sqrt(sum(v * v for v in counts.values())) or 1.0
        z = model.intercept + sum(model.coefficients[int(k)] * v / size for k, v in counts.items())
        assert r.p == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_rules_hold_at_every_length(spark):
    rng = np.random.default_rng(3)
    fresh = lambda n: " ".join(f"word{i} tale{i} on." for i in rng.permutation(n))
    rows = [(k, fresh(n)) for k, n in ((0, 40), (1, 2_000), (2, 120_000))]  # the last is a text of 2 MB
    rows += [(10 + k, "buy it now " * n + "sign in " * n) for k, n in ((0, 20), (1, 2_000), (2, 100_000))]
    got = {r.doc_id: dict(zip(weaklabels.votes(), r.votes)) for r in weaklabels.with_votes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for rule, good, bad in (("variety", 1, -1), ("phrases", 1, -1)):
        assert [got[i][rule] for i in (0, 1, 2)] == [good] * 3 and [got[i][rule] for i in (10, 11, 12)] == [bad] * 3


def test_clashing_columns(spark):
    names = ["_w", "_l", "_n", "_h", "_marks", "votes", "posterior", "score", "kept", "features", "probability", "label", "weight"]
    docs = spark.createDataFrame([(i, f"Line {i} of a text. " * (i + 1), *([i] * len(names))) for i in range(6)],
                                 "doc_id bigint, text string, " + ", ".join(f"{n} int" for n in names))
    plain = weaklabels.op10(docs.select("doc_id", "text")).collect()
    assert sorted(weaklabels.op10(docs).collect()) == sorted(plain) and len(plain) == 6


def test_registered_query_returns_the_full_result(spark):
    from gyrespark.llm.queries import QUERIES

    got = QUERIES["op10_weak_label_scorer"][0](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "votes", "posterior", "score", "kept"]
    rows = got.collect()
    assert len(rows[0].votes) == len(weaklabels.votes()) and all(0 <= r.posterior <= 1 for r in rows)
