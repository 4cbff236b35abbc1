"""Word-piece token counts by a linear longest-match automaton.

The vocabulary's pieces form one trie, pieces that go on a word under a second
root.  Each node has a failure link to the node reached once the longest piece
above it is popped, and the number of tokens popped on the way, so greedy
longest-match counts need one step per character and never build a piece.  A
vocabulary's bare word-start piece is popped at the first root, so a word that no
longer piece begins is that piece and pieces that go on a word.

Cases: a null or blank text has no words and no tokens; a word that cannot be
covered counts as one unknown token; rows are counted one by one, so repeated
rows repeat their result and an empty table gives an empty one.  A word has no
length limit.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gyrespark.llm.common import slices, texts

WORD_START = "▁"
CACHE_WORDS = 300_000  # counted words a worker remembers before it forgets them
ROOT, GO_ON = 0, 1     # roots of pieces that begin and that continue a word


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> tuple[list[str], list[str]]:
    """(pieces that begin a word, pieces that continue one) of a sentence-piece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size())
             if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    first = [p[1:] for p in plain if p.startswith(WORD_START) and len(p) > 1 and WORD_START not in p[1:]]
    return first, [p for p in plain if WORD_START not in p]


def has_bare_start(path: str) -> bool:
    """Whether the word-start mark is a piece by itself, so a word may go on right after it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    i = model.piece_to_id(WORD_START)
    return not model.is_unknown(i) and model.id_to_piece(i) == WORD_START


class Automaton:
    """Trie with failure links and counts of popped tokens."""

    def __init__(self, first: list[str], further: list[str], bare: bool = False):
        step: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        order: list[tuple[int, str, int]] = []  # (parent, character, node), parents first
        for root, pieces in ((ROOT, first), (GO_ON, further)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in step[node]:
                        step[node][c] = len(step)
                        order.append((node, c, len(step)))
                        step.append({})
                        ends.append(False)
                    node = step[node][c]
                ends[node] = ends[node] or node > GO_ON
        depth = [0] * len(step)
        for parent, _, node in order:
            depth[node] = depth[parent] + 1
        order.sort(key=lambda x: depth[x[2]])
        fail, popped = [-1] * len(step), [0] * len(step)
        if bare:
            fail[ROOT], popped[ROOT] = GO_ON, 1
        for parent, c, node in order:
            if ends[node]:
                fail[node], popped[node] = GO_ON, 1
                continue
            z, n = fail[parent], popped[parent]
            while z >= 0 and c not in step[z]:
                n += popped[z]
                z = fail[z]
            if z >= 0:
                fail[node], popped[node] = step[z][c], n
        self.step, self.fail, self.popped = step, fail, popped

    def count(self, word: str) -> int:
        """Greedy longest-match tokens of a word; -1 if it cannot be covered."""
        step, fail, popped = self.step, self.fail, self.popped
        node = n = 0
        for c in word:
            while c not in step[node]:
                if fail[node] < 0:
                    return -1
                n += popped[node]
                node = fail[node]
            node = step[node][c]
        while node != GO_ON:
            if fail[node] < 0:
                return -1
            n += popped[node]
            node = fail[node]
        return n


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(*read_pieces(path), has_bare_start(path))


class _Counts(dict):
    """Counts of words, made on first use."""

    def __init__(self, path: str):
        self.count = automaton(path).count

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.count(word.decode())
        return n


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown); an unknown word is one token."""
    path = path or vocabulary_path()
    rows = texts(docs, id_col, text_col)

    def run(batches):
        known = _Counts(path)  # its memory ends with the task
        for part in slices(batches, 1):
            out = []
            for raw in pc.cast(part.column(1), pa.binary()).to_pylist():
                counts = list(map(known.__getitem__, raw.split()))
                unknown = counts.count(-1)
                out.append((len(counts), sum(counts) + 2 * unknown, unknown))
            if len(known) > CACHE_WORDS:
                known.clear()
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*out))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words bigint, n_tokens bigint, n_unknown bigint")


def op7(docs: DataFrame) -> DataFrame:
    return token_counts(docs)
