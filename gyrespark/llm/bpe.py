"""BPE encoding by a lexicon automaton of frequent words, with exact merges for the rest.

Words are counted over the whole corpus; the most frequent ones, at most
``lexicon_words``, are compiled with their ids into a minimal acyclic automaton.  Its file
lies in the shared folder, Spark hands it to the executors, and each Python
worker maps it.  Any other word is merged by rank, so ids never depend on what
the lexicon holds.

The vocabulary file is one of the word-end BPE kind: normalisation to NFC and
lower case, words of letters, single digits, runs of other marks, contractions,
bytes as printable characters and ``</w>`` at a word's end.

Cases: a null or blank text has no tokens and decodes to the empty string; the
strings of special tokens in a text give their ids; rows are encoded one by one,
so repeated rows repeat their result and an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import struct
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrespark.llm import lexicon
from gyrespark.llm.common import give_back, persisted, slices, texts
from gyrespark.session import checkpoint_dir

LEXICON_WORDS = 200_000
SLICE = 1 << 20         # bytes of text encoded at once
LEAST_COUNT = 4         # rarer words are not compiled
STEPS = 8               # classes of a count per doubling
CACHE_WORDS = 150_000   # encoded words, and parts, a worker remembers before it forgets them
COUNT_WORDS = 200_000   # distinct words a task counts before it hands them on
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PARTS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
CONTROLS = "\x1c\x1d\x1e\x1f"  # Python splits at these, the tokenizer does not


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """Printable character of each byte: itself if visible, else the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


class Model:
    """Vocabulary, merge ranks and special tokens of a file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.token = {i: t for t, i in self.vocab.items()}
        # pair of ids -> rank and id of the merged token, all as one number
        self.merges: dict[int, int] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges[self.vocab[a] << 20 | self.vocab[b]] = rank << 20 | self.vocab[a + b]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]
        self.parts = regex.compile(PARTS + r"|\n").findall
        self.split = regex.compile(f"[{SPACE}]+").split
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.marks = tuple(s[:2] for s in self.special)

    def words(self, text: str) -> list[str]:
        """White-space words; no token crosses their borders."""
        if any(c in text for c in CONTROLS):
            return [w for w in self.split(text) if w]
        return text.split()

    def pieces(self, words: list[str]) -> list[list]:
        """Normalised parts of each word, and ids of special tokens."""
        if self.special_split and any(m in w for m in self.marks for w in words):
            out = []
            for word in words:
                runs = [r for r in self.special_split(word) if r]
                plain = iter(self.pieces_of_plain([r for r in runs if r not in self.special]))
                out.append([p for r in runs for p in ([self.special[r]] if r in self.special else next(plain))])
            return out
        return self.pieces_of_plain(words)

    def pieces_of_plain(self, words: list[str]) -> list[list[str]]:
        """Parts of words without special tokens, found in one pass over all."""
        import unicodedata

        text = "\n".join(words)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        out: list[list[str]] = [[]]
        for part in self.parts(text.lower()):
            if part == "\n":
                out.append([])
            else:
                out[-1].append(part)
        return out if words else []

    def merge(self, part: bytes) -> list[int]:
        """Ids of one part: the best-ranked, leftmost pair is merged until none is left."""
        ids = [self.inner[b] for b in part[:-1]] + [self.last[part[-1]]]
        if len(ids) > 100:
            return self._merge_long(ids)
        get, none = self.merges.get, 1 << 60
        best = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while best and (least := min(best)) < none:
            i = best.index(least)
            ids[i:i + 2] = [least & 0xFFFFF]
            del best[i]
            if i:
                best[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
            if i < len(best):
                best[i] = get(ids[i] << 20 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = m & 0xFFFFF, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def decode(self, ids) -> str:
        """Token strings with blanks between; the file names no decoder."""
        return " ".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


class Encoder:
    """Encodes whole texts word by word; remembers a bounded number of words and parts."""

    def __init__(self, path: str, lexicon_file: str | None):
        self.model, self.known, self.parts = model(path), {}, {}
        self.lexicon = lexicon.Lexicon.mapped(lexicon_file) if lexicon_file else None

    def learn(self, words: list[str]) -> None:
        """Encode new words: the automaton answers for all new parts at once, merges do the rest."""
        m = self.model
        split = m.pieces(words)
        if len(self.parts) > CACHE_WORDS:
            self.parts.clear()
        known = self.parts
        new = list({p for s in split for p in s}.difference(known))
        raw = [p.encode() if isinstance(p, str) else b"" for p in new]
        found = self.lexicon.numbers(raw).tolist() if self.lexicon else [-1] * len(raw)
        for p, r, n in zip(new, raw, found):
            ids = [p] if isinstance(p, int) else m.merge(r) if n < 0 else self.lexicon.output(n)
            known[p] = struct.pack(f"<{len(ids)}I", *ids), m.decode(ids)
        for w, s in zip(words, split):
            if len(s) == 1:
                self.known[w] = known[s[0]]
            else:
                both = [known[p] for p in s]
                self.known[w] = b"".join([b[0] for b in both]), " ".join([b[1] for b in both])

    def encode(self, batch: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian uint32, decoded text) of each text."""
        split = [self.model.words(t) for t in batch]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        self.learn(list(set().union(*split).difference(self.known)))
        get = self.known.__getitem__
        out = []
        for words in split:
            both = list(map(get, words))
            out.append((b"".join([b[0] for b in both]), " ".join([b[1] for b in both])))
        return out


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """(word, n) of the white-space words of all texts in lower case, pre-counted in the tasks."""
    def run(batches):
        words, seen = model(path).words, Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for text in batch.column(0).slice(i, 64).to_pylist():
                    seen.update(words(text.lower()))
                    if len(seen) > COUNT_WORDS:
                        yield flush()
        yield flush()
        give_back()
    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_lexicon(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS) -> str:
    """Compile the parts of the most frequent words, put the file into the shared folder, hand it to the executors; its name."""
    spark = docs.sparkSession
    counts = persisted(word_counts(docs, path).where(F.col("n") >= LEAST_COUNT).withColumn("class", F.floor(F.log2("n") * STEPS)))
    # the highest classes of counts that hold no more than the wanted number of words
    least, found = math.inf, 0
    for r in sorted(counts.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        found += r["n"]
        if found > lexicon_words:
            break
        least = r["class"]
    top = counts.where(F.col("class") >= least).select("word").collect() if math.isfinite(least) else []
    m = model(path)
    parts = {p for s in m.pieces([r["word"] for r in top]) for p in s if isinstance(p, str)}
    words = sorted(p.encode() for p in parts)
    data = lexicon.build(words, [m.merge(w) for w in words])
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{name}")
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(data)
    out.close()
    spark.sparkContext.addFile(target.toString())
    return name


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian uint32, and the text they decode to."""
    path = path or tokenizer_path()
    rows = texts(docs, id_col, text_col)
    name = frequent_lexicon(rows, path, lexicon_words) if lexicon_words else None

    def run(batches):
        encoder = Encoder(path, SparkFiles.get(name) if name else None)  # its memory ends with the task
        for part in slices(batches, 1, SLICE):
            pairs = encoder.encode(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.string())], ["doc_id", "ids", "decoded"])
        del encoder
        give_back()

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids binary, decoded string")


def op3(docs: DataFrame) -> DataFrame:
    return encode(docs).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
