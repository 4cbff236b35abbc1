"""Quality classifier from weak labels.

Overlapping heuristics vote good (1), bad (-1) or abstain (0) on every document.
Every measure behind a vote is a share (of words, characters, lines, or of
windows of fixed length), so texts of all lengths are judged alike.  Documents are
counted by their pattern of votes; on this table, whose size depends on the number
of heuristics only, expectation-maximisation estimates how often each heuristic
says what about good and bad documents, without any true label.  The posterior, a
sum of log-odds over the votes, is the soft label of a document.  A linear scorer
over hashed words and word shapes is trained on the soft labels and then scores
all documents, also where the heuristics abstain.

Bound of the fit: about ``FIT_DOCS`` documents, chosen by a hash of id and text;
votes and their counts cover all documents and are written once, beside the texts.
The sample is dealt anew by its own size, so a step of the fit costs the same
whatever the number of partitions of the table.

Cases: a null text counts as empty; texts without words are not kept and have
score 0.  A text stays whole in its task, so the longest one bounds the memory of
a task.  Ties: documents of equal votes have equal posteriors, those of equal texts
equal scores.  A null id is scored like any other.  Repeated rows repeat their
result; an empty table gives an empty one.  Only id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce
from operator import add

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrespark.llm.common import SPACES, persisted, texts, total_bytes, without, words_of
from gyrespark.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]"
FIT_DOCS = 10_000
FEATURES = 1 << 16
KEPT = 0.3      # in doubt a document stays
PENALTY = 1e-7  # the features are shares of a document, so weights are large
ROUNDS = 100
PRIOR = 0.85          # first guess of the share of good documents
GUESS = (0.2, 0.005)  # first guess of how often a heuristic calls a bad and a good document bad
PULL = 0.02           # weight of these guesses, as a share of all documents
PHRASES = ["all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie", "licensed under", "sign in", "log in",
           "click here", "subscribe to", "skip to content"]
SIGNS, BARS, LOUD, STOPS = "#*$%&|<>=_~^", "|\u00bb\u2022", "!?", ".;:"
PHRASED = (0.001, 0.005)  # phrases a word: at most the first speaks for a text, more than the second against it
WINDOW = 100         # words in which distinct ones are counted
FIT_BYTES = 4 << 20  # text of the sample in a partition of the fit


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _distinct(words: Column) -> Column:
    """Distinct words of each window of ``WINDOW`` words, added up."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(WINDOW))
    return F.aggregate(starts, F.lit(0), lambda total, i: total + F.size(F.array_distinct(F.slice(words, i, F.lit(WINDOW)))))


def measures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    return {
        # without the many characters that are not counted, which go in one pass
        "_marks": F.regexp_replace(text, "[a-z \\n\\x{80}-\\x{ba}\\x{bc}-\\x{2021}\\x{2023}-\\x{10ffff}]+", ""),
        "_n": F.size(words), "_chars": F.length(without(text, SPACES)), "_distinct": _distinct(words),
        "_again": F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: a == b), lambda x: x)),
        "_lines": F.size(lines), "_own_lines": F.size(F.array_distinct(lines)),
        "_low": F.lower(text)}


def counts() -> dict[str, Column]:
    """Numbers of the characters in ``_marks`` and of the phrases in ``_low``."""
    marks, low = F.col("_marks"), F.col("_low")
    number = lambda chars: F.length(marks) - F.length(without(marks, chars))
    return {"_upper": F.length(marks) - F.length(F.regexp_replace(marks, "[A-Z]+", "")), "_signs": number(SIGNS), "_bars": number(BARS),
            "_loud": number(LOUD), "_stops": number(STOPS), "_phrases": reduce(add, [(F.octet_length(low) - F.octet_length(without(low, [p]))) / len(p) for p in PHRASES])}


def votes() -> dict[str, Column]:
    """Vote of every heuristic from the measures of a document."""
    n, c = F.col("_n"), F.col
    distinct, upper, loud = _share(c("_distinct"), n), _share(c("_upper"), c("_chars")), _share(c("_loud"), n)
    dense, bars, again = _share(c("_signs"), c("_chars")), _share(c("_bars"), n), _share(c("_again"), n)
    phrases = _share(c("_phrases"), n)
    signs, stops, length, copies = _share(c("_signs"), n), _share(c("_stops"), n), _share(c("_chars"), n), _share(c("_lines") - c("_own_lines"), c("_lines"))
    return {
        "length": _vote(n >= 50, n < 5),
        "variety": _vote(distinct > 0.4, (n >= 30) & (distinct < 0.2)),
        "capitals": _vote(upper < 0.15, upper > 0.3),
        "loudness": _vote(loud < 0.02, loud > 0.3),
        "signs": _vote(signs < 0.03, signs > 0.25),
        "sign_density": _vote(dense < 0.01, dense > 0.04),
        "bars": _vote(bars < 0.02, bars > 0.15),
        "echoes": _vote(again < 0.03, (n >= 10) & (again > 0.1)),
        "word_length": _vote((length >= 3) & (length <= 9), (length < 2) | (length > 15)),
        "sentences": _vote((stops >= 0.02) & (stops <= 0.35), (n >= 30) & ((stops < 0.005) | (stops > 0.7))),
        "copied_lines": _vote((c("_lines") >= 3) & (copies == 0), copies > 0.3),
        "phrases": _vote((n >= 30) & (phrases <= PHRASED[0]), phrases > PHRASED[1]),
    }


def with_votes(docs: DataFrame) -> DataFrame:
    """Add the list of votes to (doc_id, text)."""
    out = docs.withColumn("_w", words_of(F.col("text"))).withColumn("_l", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    out = out.withColumns(measures(F.col("text"), F.col("_w"), F.col("_l"))).withColumns(counts())
    return out.select("doc_id", "text", F.array(*[v.cast("int") for v in votes().values()]).alias("votes"))


def label_model(patterns: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good, P(bad vote | class) per class and heuristic, posterior of good per pattern).

    ``patterns`` are rows of votes, ``n`` their counts.  Heuristics are taken as
    independent given the class, abstaining tells nothing.  The estimates start
    from, and are drawn towards, heuristics that seldom call a good document bad,
    so the classes keep their meaning.
    """
    voted = np.stack([patterns == -1, patterns == 1]).astype(float)  # outcome, pattern, heuristic
    weight = PULL * n.sum() + 1
    prior, bad_vote = PRIOR, np.repeat(np.array(GUESS)[:, None], patterns.shape[1], axis=1)  # class (bad, good), heuristic
    good = None
    for _ in range(rounds):
        fit = np.einsum("ph,ch->pc", voted[0], np.log(bad_vote)) + np.einsum("ph,ch->pc", voted[1], np.log(1 - bad_vote)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(fit[:, 0] - fit[:, 1], -50, 50)))
        if good is not None and np.abs(new - good).max() < 1e-9:
            break
        good = new
        prior = ((n * good).sum() + PRIOR * weight) / (n.sum() + weight)
        part = np.stack([n * (1 - good), n * good])
        said_bad, said = (np.einsum("cp,ph->ch", part, v) for v in (voted[0], voted[0] + voted[1]))
        bad_vote = (said_bad + weight * np.array(GUESS)[:, None]) / (said + weight)
    return float(prior), bad_vote, good


def posterior_of(prior: float, bad_vote: np.ndarray) -> Column:
    """Probability that the document of ``votes`` is good."""
    odds = F.lit(float(np.log(prior / (1 - prior))))
    for h, (bad, good) in enumerate(bad_vote.T):
        vote = F.col("votes")[h]
        odds = odds + F.when(vote == -1, float(np.log(good / bad))).when(vote == 1, float(np.log((1 - good) / (1 - bad)))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def hashed(frame: DataFrame, features: int) -> DataFrame:
    """Add ``features``: hashed numbers of words and word shapes, of unit length."""
    # runs of small letters, capitals and digits become one sign each
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[a-z]+", "\x01"), "[A-Z]+", "\x02"), "[0-9]+", "\x03")
    tokens = F.concat(words_of(shape), words_of(F.lower("text")))
    count = HashingTF(numFeatures=features, inputCol="_tokens", outputCol="_counts")
    return Normalizer(p=2.0, inputCol="_counts", outputCol="features").transform(count.transform(frame.withColumn("_tokens", tokens)))


def fit_scorer(rows: DataFrame, share: float, posterior: Column, features: int) -> LogisticRegressionModel:
    """Linear scorer fitted on the soft labels of a hashed ``share`` of the rows (one row at least)."""
    draw = F.xxhash64("doc_id", "text")
    sample = persisted(rows.where(F.shiftrightunsigned(draw, 34) < share * (1 << 30)))
    if sample.isEmpty():
        sample = rows.orderBy(draw).limit(1)
    parts = max(1, math.ceil(total_bytes(sample) / FIT_BYTES))
    dealt = sample.select("text", posterior.alias("posterior"), draw.alias("_h")).repartition(parts, "_h").sortWithinPartitions("_h")
    each = F.explode(F.array(*[F.struct(F.lit(y).alias("label"), p.alias("weight")) for y, p in ((1.0, F.col("posterior")), (0.0, 1 - F.col("posterior")))]))
    two = persisted(hashed(dealt, features).select("features", each.alias("_y")).select("features", "_y.*").where("weight > 0")).persist()
    model = LogisticRegression(regParam=PENALTY, maxIter=100, standardization=False, weightCol="weight").fit(two)
    two.unpersist()
    return model


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, features: int = FEATURES) -> DataFrame:
    """(doc_id, votes, posterior, score, kept) of every row."""
    folder = f"{checkpoint_dir(docs.sparkSession)}/votes-{uuid.uuid4().hex}"
    with_votes(texts(docs, id_col, text_col)).write.option("compression", "zstd").parquet(folder)
    rows = docs.sparkSession.read.parquet(folder)  # counted, learned from and scored
    table = rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    if not table:
        return rows.select("doc_id", "votes", F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    table.sort(key=lambda r: r["votes"])
    n = np.array([r["n"] for r in table], dtype=float)
    prior, bad_vote, _ = label_model(np.array([r["votes"] for r in table]), n)
    posterior = posterior_of(prior, bad_vote)
    model = fit_scorer(rows, min(1.0, fit_docs / n.sum()), posterior, features)
    scored = model.transform(hashed(rows.select("doc_id", "text", "votes", posterior.alias("posterior")), features))
    score = F.when(F.col("text").rlike(WORD), vector_to_array("probability")[1]).otherwise(0.0)
    return scored.select("doc_id", "votes", "posterior", score.alias("score"), (score >= KEPT).alias("kept"))


def op10(docs: DataFrame) -> DataFrame:
    return classify(docs)
