"""Kneser-Ney models against a plain recursive definition, and held-out accuracy."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from gyrespark.llm import langid

FOLDER = "/root/testdata/sf0.01"


def counts_of(words, order):
    c = Counter()
    for word in words:
        w = langid.START + word + langid.END
        for k in range(1, order + 1):
            c.update(w[i:i + k] for i in range(len(w) - k + 1))
    return c


class Plain:
    """Interpolated Kneser-Ney by its recursive definition."""

    def __init__(self, raw, order, alphabet):
        self.order, self.alphabet, self.c = order, alphabet, [None]
        for k in range(1, order + 1):
            self.c.append({g: n if k == order or g[0] == langid.START else sum(1 for x in raw if len(x) == k + 1 and x[1:] == g)
                           for g, n in raw.items() if len(g) == k and g != langid.START})

    def p(self, history, char):
        k = len(history) + 1
        own = self.c[k]
        lower = self.p(history[1:], char) if k > 1 else 1 / (self.alphabet + 1)
        ones, twos = (sum(n == i for n in own.values()) for i in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        after = [n for g, n in own.items() if g[:-1] == history]
        if not sum(after):
            return lower
        n = own.get(history + char, 0)
        return (max(n - d, 0) if n else 0) / sum(after) + d * len(after) / sum(after) * lower


def test_models_equal_definition():
    rng = random.Random(1)
    samples = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(60)] for lang, letters in (("aa", "abc"), ("bb", "bcdé"))}
    raw = {lang: counts_of(w, 4) for lang, w in samples.items()}
    models = langid.Models(raw, 4)
    alphabet = len({g for c in raw.values() for g in c if len(g) == 1} - {langid.START})
    words = ["a", "abc", "dddé", "xyz", "bcab", "cc"]
    got = models.words(words)
    for at, lang in enumerate(models.langs):
        plain = Plain(raw[lang], 4, alphabet)
        for w, row in zip(words, got):
            text = langid.START + w + langid.END
            want = sum(math.log(plain.p(text[max(0, i - 3):i], text[i])) for i in range(1, len(text)))
            assert row[at] == pytest.approx(want, rel=1e-4)


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in langid.op2(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    rows = duckdb.sql(f"SELECT doc_id, lang FROM '{FOLDER}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    held = [(lang, got[i]) for i, lang in rows if got[i].held_out]
    assert np.mean([lang == r.lang_pred for lang, r in held]) > 0.98
    assert all(0 <= r.score <= 1 for _, r in held) and np.mean([r.rejected for _, r in held]) < 0.1


def test_odd_rows(spark):
    rows = [(i, "der hund und die katze " * 3, "de", 1) for i in range(30)] + [(i + 30, "the dog and the cat with " * 3, "en", 1) for i in range(30)]
    rows += [(100, None, "de", 1), (101, "", None, 1), (102, "123 ½ !!", "en", 1), (None, "the cat", None, 1), (100, "und die", "de", 1), (103, "汉字", None, 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    got = langid.op2(frame).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id not in (100,)}
    assert [(by_id[i].lang_pred, by_id[i].score) for i in (101, 102)] == [("und", 0.0)] * 2
    assert sorted(r.lang_pred for r in got if r.doc_id == 100) == ["de", "und"]
    assert by_id[None].lang_pred == "en" and by_id[103].lang_pred in ("de", "en") and by_id[103].rejected
    assert langid.op2(frame.limit(0)).count() == 0
    unlabelled = frame.withColumn("lang", frame["lang"].substr(100, 1)).selectExpr("doc_id", "text", "nullif(lang, '') AS lang")
    assert {(r.lang_pred, r.score) for r in langid.op2(unlabelled).collect()} == {("und", 0.0)}


def test_no_language_is_lost_by_the_bound(spark):
    rng = random.Random(3)
    rows = [(i, "the dog and the cat " * 20, "en") for i in range(40)]
    rows += [(100 + i, " ".join("".join(rng.choice("кошкадм") for _ in range(6)) for _ in range(3000)), "ru") for i in range(6)]  # long against its share
    rows += [(200 + i, "αβγ δεζ ηθι", f"g{i}") for i in range(20)]  # languages of one row
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labelled = frame.select("doc_id", "text", "lang")
    fitted = Counter(r.lang for r in langid.chosen_rows(labelled, 200).where("part <> 0").collect())
    assert set(fitted) == {r[2] for r in rows}
    chosen = Counter(r.lang for r in langid.chosen_rows(labelled, 200).collect())
    assert chosen["ru"] == langid.LEAST_ROWS and all(chosen[f"g{i}"] == 1 for i in range(20))
