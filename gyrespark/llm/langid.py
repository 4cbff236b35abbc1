"""Language identification by interpolated Kneser-Ney character models.

A text is its runs of letters in lower case; each run is spelt with a mark at
both ends.  Every language has a model of its character n-grams: absolute
discounts, raw counts at the highest order and counts of distinct left
neighbours below, mixed down to a uniform alphabet.  All models share sorted
arrays of 64-bit n-gram hashes; a row holds one log-probability for each
language, a second array the back-off weights of the contexts.  The language
with the lowest cross-entropy per character wins.

The score is the probability that the winner is right, from a logistic fit on a
calibration part of the learning rows; a text is flagged ``rejected`` if its
score or its cross-entropy is worse than nearly all right calibration rows.

Bound of the fit: ``FIT_CHARS`` characters in total, shared equally between the
languages, chosen by a hash of id and text, but ``LEAST_ROWS`` rows of every
language at least; so the model has at most ``FIT_CHARS * ORDER`` n-grams, and
those of these rows, whatever the input.  Labels are taken to be few.

Cases: a null text, a text without letters, or a fit without any labelled row
gives ``und`` with score 0, rejected.  Equal entropies go to the smaller label.
A null id is learned from.  Repeated rows repeat their result; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyrespark.llm.blobs import mix
from gyrespark.llm.common import id_class, per_batch, texts

ORDER = 4
FIT_CHARS = 1_000_000
LEAST_ROWS = 5       # chosen of each language at least
CALIBRATION = 5      # one chosen row of so many calibrates instead of fitting
REJECTED = 0.005     # share of right calibration rows that a limit may reject
UNKNOWN = "und"
START, END = "\x02", "\x03"
CACHE_WORDS = 200_000


def letter_runs(text: str) -> list[str]:
    import regex

    return regex.findall(r"\p{L}+", text.lower())


def gram_hash(code: np.ndarray, size: int) -> np.ndarray:
    """Hash of rows of code points, right aligned in ``size`` columns (0: absent)."""
    h = np.full(len(code), size, dtype=np.uint64)
    for i in range(code.shape[1]):
        h = mix(h + code[:, i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return h


def _codes(grams: list[str], size: int) -> np.ndarray:
    out = np.zeros((len(grams), size), dtype=np.uint32)
    for i, g in enumerate(grams):
        out[i, size - len(g):] = [ord(c) for c in g]
    return out


class Models:
    """Kneser-Ney models of several languages in shared sorted hash arrays."""

    def __init__(self, counts: dict[str, Counter], order: int = ORDER):
        """``counts``: raw counts of all n-grams up to ``order`` per language."""
        self.order, self.langs = order, sorted(counts)
        n_langs = len(self.langs)
        alphabet = {g for c in counts.values() for g in c if len(g) == 1} - {START}
        below = np.full(n_langs, -np.log(len(alphabet) + 1.0))
        self.uniform = below
        grams: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(n_langs)) for _ in range(order)]
        backs: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.ones(n_langs)) for _ in range(order)]
        for at, lang in enumerate(self.langs):
            raw = counts[lang]
            left: list[Counter] = [Counter() for _ in range(order + 1)]
            for g in raw:
                if len(g) > 1:
                    left[len(g) - 1][g[1:]] += 1
            for k in range(1, order + 1):
                own = {g: (n if k == order or g[0] == START else left[k][g]) for g, n in raw.items() if len(g) == k and g != START}
                ones, twos = (sum(n == i for n in own.values()) for i in (1, 2))
                d = ones / (ones + 2 * twos) if ones and twos else 0.5
                total, kinds = Counter(), Counter()
                for g, n in own.items():
                    total[g[:-1]] += n
                    kinds[g[:-1]] += 1
                for g, n in own.items():
                    grams[k - 1][g][at] = (n - d) / total[g[:-1]] if n else 0.0
                for h, n in total.items():
                    if n:
                        backs[k - 1][h][at] = d * kinds[h] / n
        # interpolate upwards: a row of order k has the whole probability of each language
        self.grams, self.backs, lower = [], [], {}
        for k in range(1, order + 1):
            names = list(grams[k - 1])
            rows = np.empty((len(names), n_langs))
            for i, g in enumerate(names):
                rest = np.exp(below) if k == 1 else self._find(lower, g[1:], np.exp(below), backs)
                rows[i] = grams[k - 1][g] + backs[k - 1].get(g[:-1], np.ones(n_langs)) * rest
            lower = lower | dict(zip(names, rows))
            self.grams.append(self._sorted(names, np.log(np.maximum(rows, 1e-300)), k))
            contexts = list(backs[k - 1])
            self.backs.append(self._sorted(contexts, np.log(np.array([backs[k - 1][h] for h in contexts]).reshape(-1, n_langs)), k - 1))

    @staticmethod
    def _find(known, gram, uniform, backs):
        """Probability of a shorter n-gram, backing off where it is unknown."""
        weight = 1.0
        while gram:
            if gram in known:
                return weight * known[gram]
            weight = weight * backs[len(gram) - 1].get(gram[:-1], 1.0)
            gram = gram[1:]
        return weight * uniform

    def _sorted(self, names, rows, size):
        h = gram_hash(_codes(names, max(size, 1)), size)
        order = np.argsort(h)
        return h[order], rows[order].astype(np.float32)

    @staticmethod
    def _look(table, h):
        keys, rows = table
        if not len(keys):
            return np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=np.int64)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return keys[at] == h, at

    def log_probs(self, code: np.ndarray) -> np.ndarray:
        """Natural log-probability of the last column given the others, per language; 0 is absent history."""
        out = np.zeros((len(code), len(self.langs)))
        have = (code > 0).sum(axis=1)
        live = np.arange(len(code))
        for k in range(self.order, 0, -1):
            ready = live[have[live] >= k]
            part = code[ready][:, self.order - k:]
            hit, at = self._look(self.grams[k - 1], gram_hash(part, k))
            out[ready[hit]] += self.grams[k - 1][1][at[hit]]
            miss, part = ready[~hit], part[~hit]
            context = part[:, :-1] if k > 1 else np.zeros((len(part), 1), np.uint32)
            known, at = self._look(self.backs[k - 1], gram_hash(context, k - 1))
            out[miss[known]] += self.backs[k - 1][1][at[known]]
            live = np.concatenate([live[have[live] < k], miss])
        out[live] += self.uniform
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """Sum of log-probabilities of each word's characters and its end, per language."""
        if not words:
            return np.zeros((0, len(self.langs)))
        text = START + (END + START).join(words) + END
        code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
        first = np.cumsum(length) - length
        position = np.arange(len(code)) - np.repeat(first, length)
        asked = np.flatnonzero(position > 0)
        window = np.zeros((len(asked), self.order), dtype=np.uint32)
        for back in range(self.order):
            ok = position[asked] >= back
            window[ok, self.order - 1 - back] = code[asked[ok] - back]
        unique, at = np.unique(gram_hash(window, self.order), return_index=True)
        where = np.searchsorted(unique, gram_hash(window, self.order))
        each = self.log_probs(window[at])[where]
        return np.add.reduceat(each, np.cumsum(length - 1) - (length - 1), axis=0)


class Scorer:
    """Per-text entropies by language; remembers a bounded number of words."""

    def __init__(self, models: Models):
        self.models, self.code, self.rows = models, {}, np.zeros((0, len(models.langs)))

    def entropies(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character and language, characters) of each text."""
        split = [letter_runs(t) for t in batch]
        new = set().union(*split).difference(self.code)
        if len(self.code) + len(new) > CACHE_WORDS:
            self.code, self.rows, new = {}, self.rows[:0], set().union(*split)
        new = list(new)
        self.rows = np.concatenate([self.rows, self.models.words(new)])
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new))))
        get = self.code.__getitem__
        total = np.zeros((len(batch), self.rows.shape[1]))
        chars = np.zeros(len(batch), dtype=np.int64)
        for i, words in enumerate(split):
            if words:
                total[i] = self.rows[np.fromiter(map(get, words), np.int64, len(words))].sum(axis=0)
                chars[i] = sum(map(len, words)) + len(words)
        return -total / np.maximum(chars, 1)[:, None], chars


def _features(entropy: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Margin to the second language and its evidence over the whole text."""
    two = np.sort(entropy, axis=1)[:, :2]
    margin = two[:, 1] - two[:, 0] if two.shape[1] > 1 else np.ones(len(entropy))
    return np.stack([np.ones(len(margin)), np.minimum(margin, 5), np.log1p(margin * chars)], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w = w - np.linalg.solve(hess, x.T @ (p - y) + penalty * w)
    return w


def gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n) of a small frame (lang, text)."""
    def run(batches):
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in Counter(letter_runs(text)).items():
                    w = START + word + END
                    for k in range(1, order + 1):
                        for i in range(len(w) - k + 1):
                            seen[lang][w[i:i + k]] += n
        flat = [(lang, g, n) for lang, c in seen.items() for g, n in c.items()]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*flat)], ["lang", "gram", "n"])
    return rows.select("lang", "text").mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def chosen_rows(rows: DataFrame, fit_chars: int) -> DataFrame:
    """About ``fit_chars`` characters of labelled rows, an equal share for each language, with ``part`` for calibration.

    The ``LEAST_ROWS`` rows with letters that come first by hash are chosen in
    every language, also where they exceed its share, and the first one always
    fits, so no language with labelled text is lost.
    """
    step = 1 / float(1 << 24)
    drawn = rows.withColumn("_bits", F.xxhash64("doc_id", "text")).withColumn("_unit", F.shiftrightunsigned("_bits", 40) * step)
    sizes = drawn.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()
    share = fit_chars / max(len(sizes), 1)
    if not sizes:
        return rows.where("false").withColumn("part", F.lit(0))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_unit", "_bits"))  # limited before it is dealt out
    first = drawn.where(F.col("text").rlike(r"\p{L}")).select("lang", "_unit", "_bits").withColumn("_i", place).where(F.col("_i") <= LEAST_ROWS).collect()
    least: dict[str, float] = defaultdict(float)
    for r in first:
        least[r["lang"]] = max(least[r["lang"]], r["_unit"] + step)
    rate = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], max(min(1.0, share / max(r["n"] or 1, 1)), least[r["lang"]]))])
    part = F.when(F.col("_bits").isin([r["_bits"] for r in first if r["_i"] == 1]), 1).otherwise(F.pmod("_bits", F.lit(CALIBRATION)))
    return drawn.where(F.col("_unit") < F.element_at(rate, F.col("lang"))).withColumn("part", part).drop("_bits", "_unit")


def identify(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             order: int = ORDER, fit_chars: int = FIT_CHARS) -> DataFrame:
    """(doc_id, lang_pred, score, entropy, rejected) of every row; rows where ``learn`` holds and a label exists are learned from."""
    spark = docs.sparkSession
    labelled = docs.where(learn & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sample = chosen_rows(labelled, fit_chars)
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in gram_counts(sample.where("part <> 0"), order).toLocalIterator():
        counts[r["lang"]][r["gram"]] = r["n"]
    rows = texts(docs, id_col, text_col)
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, entropy double, rejected boolean"
    if not counts:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
    models = spark.sparkContext.broadcast(Models(counts, order))
    held: dict[int, Scorer] = {}

    def scorer() -> Scorer:
        if 0 not in held:
            held[0] = Scorer(models.value)
        return held[0]

    def trial(part: pa.RecordBatch) -> pa.RecordBatch:
        entropy, chars = scorer().entropies(part.column(1).to_pylist())
        best = [models.value.langs[i] for i in entropy.argmin(axis=1)]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(best), pa.array(chars), pa.array(entropy.tolist(), pa.list_(pa.float64()))], ["lang", "best", "chars", "entropy"])

    tried = per_batch(sample.where("part = 0").select("lang", "text"), "lang string, best string, chars bigint, entropy array<double>", trial).toPandas()
    tried = tried[tried["chars"] > 0]
    x, least, fit, limit = np.zeros((0, 3)), 0.0, np.array([2.0, 1.0, 0.5]), np.inf
    if len(tried):
        entropy = np.array(tried["entropy"].tolist())
        x, y = _features(entropy, tried["chars"].to_numpy()), (tried["lang"] == tried["best"]).to_numpy()
        fit = fit_logistic(x, y.astype(float))
        if y.any():
            least = float(np.quantile(1 / (1 + np.exp(-x[y] @ fit)), REJECTED))
            limit = float(np.quantile(entropy[y].min(axis=1), 1 - REJECTED))

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        entropy, chars = scorer().entropies(part.column(1).to_pylist())
        none = chars == 0
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(best)), best]
        score = np.where(none, 0.0, 1 / (1 + np.exp(-_features(entropy, chars) @ fit)))
        names = [UNKNOWN if n else models.value.langs[i] for i, n in zip(best, none)]
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(np.where(none, np.nan, low), from_pandas=True), pa.array(none | (score < least) | (low > limit))],
            ["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return per_batch(rows, schema, kernel)


def op2(docs: DataFrame) -> DataFrame:
    held = id_class("doc_id", 3) == 1
    rows = docs.select("doc_id", "text", "lang")
    return identify(rows, ~held).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")
