"""A minimal acyclic transducer from words to token ids, kept as flat arrays that workers map into memory.

States share suffixes. Each transition carries the number of words that sort before it at its state, so that the numbers along a
word's path add up to the word's place in sorted order, and that place gives its ids. Built once on the driver from at most
`size` words, it is a few megabytes whatever the corpus.
"""

from __future__ import annotations

import numpy as np

from newsloom.llm.flat import pack, view


def build(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Arrays of the automaton of words, each with its ids. An empty dictionary gives an automaton that knows no word."""
    register: dict = {}
    final: list[bool] = []
    arcs: list[tuple] = []
    path: list[list] = [[False, []]]  # unregistered states of the last word: [is final, [(byte, state)]]

    def settle(down_to: int) -> None:
        while len(path) - 1 > down_to:
            is_final, out = path.pop()
            key = (is_final, tuple(out))
            state = register.get(key)
            if state is None:
                state = register[key] = len(final)
                final.append(is_final)
                arcs.append(key[1])
            path[-1][1][-1] = (path[-1][1][-1][0], state)

    last = b""
    ordered = sorted(words)
    for word in ordered:
        common = 0
        for a, b in zip(last, word):
            if a != b:
                break
            common += 1
        settle(common)
        for byte in word[common:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    settle(0)
    root = len(final)
    final.append(path[0][0])
    arcs.append(tuple(path[0][1]))

    below = [0] * len(final)  # words accepted from each state; a state's targets are registered before it
    begin, label, target, skip = [0], [], [], []
    for state, out in enumerate(arcs):
        n = int(final[state])
        for byte, to in out:
            label.append(byte)
            target.append(to)
            skip.append(n)
            n += below[to]
        below[state] = n
        begin.append(len(label))
    ids = [words[w] for w in ordered]
    states = np.repeat(np.arange(len(begin) - 1, dtype=np.int64), np.diff(begin))
    return {
        "begin": np.array(begin, np.int32), "key": states * 256 + np.array(label, np.int64), "target": np.array(target, np.int32), "skip": np.array(skip, np.int32),
        "final": np.array(final, np.uint8), "root": np.array([root], np.int32),
        "offset": np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32), "ids": np.array([i for x in ids for i in x], np.int32),
    }


class Lexicon:
    """Reads a packed automaton; with a path, its pages are mapped from the file and shared by all workers of a machine."""

    def __init__(self, path: str):
        for name, a in view(np.memmap(path, np.uint8, "r")).items():
            setattr(self, name, a)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in sorted order, -1 where it isn't one of the lexicon; all words walk together, a byte a step."""
        n = len(words)
        if not n:
            return np.empty(0, np.int64)
        length = np.fromiter(map(len, words), np.int64, n)
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        flat = np.frombuffer(b"".join(words), np.uint8)
        state = np.full(n, self.root[0], np.int64)
        place = np.zeros(n, np.int64)
        live = np.arange(n)
        keys = self.key
        for k in range(int(length.max())):
            live = live[length[live] > k]
            if not len(live):
                break
            want = state[live] * 256 + flat[start[live] + k]
            arc = np.searchsorted(keys, want)
            hit = (arc < len(keys)) & (keys[np.minimum(arc, len(keys) - 1)] == want) if len(keys) else np.zeros(len(live), bool)
            state[live[~hit]] = -1
            live, arc = live[hit], arc[hit]
            place[live] += self.skip[arc]
            state[live] = self.target[arc]
        ok = (state >= 0) & (self.final[np.maximum(state, 0)] == 1) if len(self.final) else np.zeros(n, bool)
        return np.where(ok, place, -1)


__all__ = ["Lexicon", "build", "pack"]
