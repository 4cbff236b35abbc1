"""Minimal acyclic automaton from words to numbers, in flat arrays that can be mapped from a file."""

from __future__ import annotations

import numpy as np

MAGIC = 0x4C455831


def build(words: list[bytes], outputs: list[list[int]]) -> bytes:
    """Automaton of sorted, distinct words; word number i has ``outputs[i]``.

    States with the same finality and arcs are stored once.  Each arc carries the
    number of words before it, so a path sums up to the number of its word.
    """
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []      # of registered states: ((byte, state), ...)
    final: list[bool] = []
    count: list[int] = []
    path: list[list] = [[False, []]]  # of the last word: [final, arcs done]

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            done, out = path.pop()
            key = (done, tuple(out))
            if key not in register:
                register[key] = len(arcs)
                arcs.append(key[1])
                final.append(done)
                count.append(done + sum(count[s] for _, s in out))
            path[-1][1].append((last[len(path) - 1], register[key]))

    last = b""
    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        close(shared)
        path.extend([False, []] for _ in word[shared:])
        path[-1][0] = True
        last = word
    close(0)
    done, out = path.pop()
    start = len(arcs)
    arcs.append(tuple(out))
    final.append(done)
    keys, target, skip = [], [], []
    for s, own in enumerate(arcs):
        before = int(final[s])
        for byte, t in own:
            keys.append(s * 256 + byte)
            target.append(t)
            skip.append(before)
            before += count[t]
    ends = np.cumsum([0] + [len(x) for x in outputs], dtype=np.int64)
    ids = np.array([i for x in outputs for i in x], dtype=np.int64)
    parts = [np.array(keys, np.int64), np.array(target, np.int64), np.array(skip, np.int64), np.array(final, np.int64), ends, ids]
    head = np.array([MAGIC, start, *map(len, parts)], dtype=np.int64)
    return b"".join(x.tobytes() for x in [head, *parts])


class Lexicon:
    """Look-ups in the arrays of :func:`build`, given as one int64 array (a mapped file, say)."""

    def __init__(self, data: np.ndarray):
        if data[0] != MAGIC:
            raise ValueError("not a lexicon")
        self.start, at, parts = int(data[1]), 8, []
        for n in data[2:8]:
            parts.append(data[at:at + int(n)])
            at += int(n)
        self.keys, self.target, self.skip, self.final, self.ends, self.ids = parts

    @classmethod
    def mapped(cls, path: str) -> "Lexicon":
        return cls(np.asarray(np.memmap(path, dtype=np.int64, mode="r")))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, or -1; all words walk one byte at a time together."""
        out = np.full(len(words), -1, dtype=np.int64)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        if not len(self.keys):
            return out
        text = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8)
        begin = np.cumsum(length) - length
        live = np.arange(len(words))
        state = np.full(len(words), self.start, dtype=np.int64)
        total = np.zeros(len(words), dtype=np.int64)
        depth = 0
        while len(live):
            over = length[live] == depth
            if over.any():
                ended = over & (self.final[state] > 0)
                out[live[ended]] = total[ended]
                live, state, total = live[~over], state[~over], total[~over]
                if not len(live):
                    break
            key = state * 256 + text[begin[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            live, at = live[known], at[known]
            state, total = self.target[at], total[known] + self.skip[at]
            depth += 1
        return out

    def output(self, number: int) -> list[int]:
        return self.ids[self.ends[number]:self.ends[number + 1]].tolist()
