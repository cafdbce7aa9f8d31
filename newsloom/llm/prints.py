"""The persistent fingerprint store of one part: sorted runs of fingerprints with Bloom filters.

What a batch brings to a part is pending at first. With the next batch it is sealed, without the items that turned out to be repeats: a sorted run of
fingerprints, the word sets of their items, and a Bloom filter. Runs of like size are merged together with their filters, so that a part has few of them, and of each only the
pages that positives fall into are read. A task publishes its runs by renaming when it is through, under names that its batches give, and never looks at runs of its own batches:
if it is repeated, it finds the state before it and gives the same result. Runs that a published one has taken in are removed when a part is opened the next time.
"""

from __future__ import annotations

import numpy as np

from newsloom.llm import bloom
from newsloom.llm.flat import Folder

#: A run is merged with the one before it while that has less than so many times its fingerprints, and both together at most MERGED; larger ones are merged by compact.
GROWTH, MERGED = 4, 500_000
#: Pairs whose word sets are compared at once; four times as many are made and held against the sets' marks.
BLOCK = 200_000


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of runs of the given lengths, one after the other."""
    ends = np.cumsum(length)
    n = int(ends[-1]) if len(ends) else 0
    return np.arange(n, dtype=np.int64) + np.repeat(start - (ends - length), length)


class Sets:
    """Word sets of items as one array of sorted word hashes and offsets, and 64 bits of each set, of which each word sets one."""

    def __init__(self, ids: np.ndarray, offset: np.ndarray, words: np.ndarray, marks: np.ndarray | None = None):
        self.ids, self.offset, self.words = ids, offset, words
        if marks is None:
            marks, some = np.zeros(len(ids), np.uint64), np.flatnonzero(np.diff(offset))
            if len(some):
                marks[some] = np.bitwise_or.reduceat(np.uint64(1) << (words.view(np.uint64) & np.uint64(63)), np.asarray(offset)[some])
        self.marks = marks

    def size(self, k: np.ndarray) -> np.ndarray:
        return (self.offset[k + 1] - self.offset[k]).astype(np.int64)


def common_words(a: Sets, i: np.ndarray, b: Sets, j: np.ndarray) -> np.ndarray:
    """How many words the sets a[i] and b[j] share, for each pair."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), BLOCK):
        x, y = i[at : at + BLOCK], j[at : at + BLOCK]
        nx, ny = a.size(x), b.size(y)
        pair = np.concatenate([np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)])
        words = np.concatenate([a.words[ragged(a.offset[x].astype(np.int64), nx)], b.words[ragged(b.offset[y].astype(np.int64), ny)]])
        order = np.lexsort((words, pair))
        pair, words = pair[order], words[order]
        twice = (pair[1:] == pair[:-1]) & (words[1:] == words[:-1])
        out[at : at + BLOCK] = np.bincount(pair[1:][twice], minlength=len(x))
    return out


def maybe_alike(a: Sets, i: np.ndarray, b: Sets, j: np.ndarray) -> np.ndarray:
    """Whether the sets a[i] and b[j] may be alike by their sizes and marks: a bit that only one of them has stands for a word at least that the other lacks."""
    na, nb, x, y = a.size(i), b.size(j), a.marks[i], b.marks[j]
    return 9 * np.minimum(na - np.bitwise_count(x & ~y), nb - np.bitwise_count(y & ~x)) >= 4 * (na + nb)


def make_run(prints: np.ndarray, item: np.ndarray, sets: Sets, whole: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of a run: its fingerprints in order with the item of each, the items' sets, the keys that match as a whole, and the filter over both."""
    order = np.argsort(prints, kind="stable")
    whole = np.unique(whole)
    keys = np.concatenate([prints, whole])
    return {
        "print": prints[order], "item": item[order].astype(np.int32), "id": sets.ids, "offset": sets.offset.astype(np.int64), "words": sets.words, "marks": sets.marks, "whole": whole,
        "bits": bloom.build(keys, bloom.size_for(len(keys))),
    }


def sets_of(run: dict[str, np.ndarray]) -> Sets:
    return Sets(run["id"], run["offset"], run["words"], run["marks"])


def merge(runs: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    base = np.cumsum([0, *(len(r["id"]) for r in runs)])
    shift = np.cumsum([0, *(len(r["words"]) for r in runs)])
    offset = np.concatenate([[0], *(r["offset"][1:] + k for r, k in zip(runs, shift))])
    sets = Sets(np.concatenate([r["id"] for r in runs]), offset, np.concatenate([r["words"] for r in runs]), np.concatenate([r["marks"] for r in runs]))
    return make_run(np.concatenate([r["print"] for r in runs]), np.concatenate([r["item"] + k for r, k in zip(runs, base)]), sets, np.concatenate([r["whole"] for r in runs]))


def without(pending: dict[str, np.ndarray], killed: np.ndarray) -> dict[str, np.ndarray]:
    """A run of a pending file's items that aren't among killed."""
    stays = ~np.isin(pending["id"], killed)
    place = np.cumsum(stays) - 1
    keep = stays[pending["item"]]
    size = np.diff(pending["offset"])
    words = pending["words"][np.repeat(stays, size)]
    sets = Sets(pending["id"][stays], np.concatenate([[0], np.cumsum(size[stays])]), words)
    return make_run(pending["print"][keep], place[pending["item"][keep]], sets, pending["whole"][~np.isin(pending["whole_id"], killed)])


def _keys(run: dict[str, np.ndarray]) -> int:
    return len(run["print"]) + len(run["whole"])


class Part:
    """One part of the store as a task sees it that takes batches from number `first` on."""

    def __init__(self, uri: str, first: int, previous: int | None = None, killed: np.ndarray = np.empty(0, np.int64), sealing: bool = True):
        """killed: ids of the items of batch `previous`, the last one before, that turned out to be repeats. Without sealing what is pending stays so."""
        self.folder = Folder(uri)
        self.rows_read = 0
        names = self.folder.names()
        spans = [(*(int(x) for x in name[4:].split("_")), name) for name in names if name.startswith("run-")]
        spans = sorted(r for r in spans if r[1] < first)
        # of runs that hold others' batches the widest count
        wide = [r for r in spans if not any(o is not r and o[0] <= r[0] and r[1] <= o[1] for o in spans)]
        waiting = sorted((int(name[5:]), name) for name in names if name.startswith("pend-") and int(name[5:]) < first)
        left = [(p, name) for p, name in waiting if not any(a <= p <= b for a, b, _ in wide)]
        stay = {name for *_, name in wide + left}
        self.folder.remove([name for *_, name in spans + waiting if name not in stay])
        self.runs = [(a, b, self.folder.read(name), True) for a, b, name in wide]
        self.pending: tuple[int, dict] | None = None
        for p, name in left if sealing else ():
            # repeats of the batch just before come with this task; an earlier pending batch that no task has met since had none here
            self.pending = p, self.folder.read(name)
            self.seal(killed if p == previous else np.empty(0, np.int64))

    def seal(self, killed: np.ndarray) -> None:
        """Makes a run of what is pending, without the items with ids among killed, merged with runs of like size before it."""
        if self.pending is None:
            return
        first = last = self.pending[0]
        run = without(self.pending[1], killed)
        self.pending = None
        while self.runs and _keys(self.runs[-1][2]) < GROWTH * (_keys(run) + 1) and _keys(self.runs[-1][2]) + _keys(run) <= MERGED:
            first, _, before, _ = self.runs.pop()
            run = merge([before, run])
        self.runs.append((first, last, run, False))

    def compact(self) -> None:
        """Merges all runs into one."""
        if len(self.runs) > 1:
            self.runs = [(self.runs[0][0], self.runs[-1][1], merge([r for _, _, r, _ in self.runs]), False)]

    def publish(self) -> None:
        for first, last, run, there in self.runs:
            if not there:
                self.folder.write(f"run-{first}_{last}", run)
        if self.pending is not None:
            self.folder.write(f"pend-{self.pending[0]}", self.pending[1])

    def hits(self, prints: np.ndarray, item: np.ndarray, sets: Sets, whole: np.ndarray, whole_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a batch's items and ids of whole keys: those which repeat an accepted article. The filters prescreen, positives are looked up, shared coverage is verified."""
        hit_item, hit_id = [], []
        for _, _, run, _ in self.runs:
            if len(run["print"]):
                may = np.flatnonzero(bloom.contains(run["bits"], prints))
                lo, hi = (np.searchsorted(run["print"], prints[may], side) for side in ("left", "right"))
                self.rows_read += int((hi - lo).sum())
                before, found = sets_of(run), []
                ends = np.cumsum(hi - lo)
                # pairs are made in blocks, however many items of the run share a fingerprint
                cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, 4 * BLOCK), "right"))
                for a, z in zip(cuts, [*cuts[1:], len(may)]):
                    x, y = np.repeat(item[may[a:z]], hi[a:z] - lo[a:z]), run["item"][ragged(lo[a:z], hi[a:z] - lo[a:z])]
                    near = maybe_alike(sets, x, before, y)
                    found.append(np.unique(x[near] * len(before.ids) + y[near]))
                if found:
                    x, y = np.divmod(np.unique(np.concatenate(found)), len(before.ids))
                    common = common_words(sets, x, before, y)
                    hit_item.append(x[9 * common >= 4 * (sets.size(x) + before.size(y))])
            if len(run["whole"]) and len(whole):
                may = np.flatnonzero(bloom.contains(run["bits"], whole))
                at = np.minimum(np.searchsorted(run["whole"], whole[may]), len(run["whole"]) - 1)
                found = run["whole"][at] == whole[may]
                self.rows_read += int(found.sum())
                hit_id.append(whole_id[may[found]])
        none = np.empty(0, np.int64)
        return np.unique(np.concatenate([none, *hit_item])), np.unique(np.concatenate([none, *hit_id]))

    def keep(self, batch: int, prints: np.ndarray, item: np.ndarray, sets: Sets, whole: np.ndarray, whole_id: np.ndarray) -> None:
        """Leaves the batch's items pending, until it is known which of them are repeats."""
        self.pending = batch, {
            "print": prints, "item": item.astype(np.int32), "id": sets.ids, "offset": sets.offset.astype(np.int64), "words": sets.words, "whole": whole, "whole_id": whole_id}


def links_within(prints: np.ndarray, item: np.ndarray, micros: np.ndarray, sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """(earlier, later) places of a batch's items that share a fingerprint and are alike, but not equal sets: equal ones share a whole key."""
    order = np.argsort(prints, kind="stable")
    p, it = prints[order], item[order]
    begins = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.empty(0, np.int64)
    length = np.diff(np.concatenate([begins, [len(p)]]))
    later = np.arange(len(p)) - np.repeat(begins, length)  # so many share the fingerprint before this one
    found = []
    # pairs of a fingerprint are made in blocks, however many items share it
    ends = np.cumsum(later)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, BLOCK * 4):
        n = np.clip(ends, lo, lo + BLOCK * 4)
        skip = np.clip(lo - (ends - later), 0, later)
        count = n - np.maximum(ends - later, lo).clip(max=lo + BLOCK * 4)
        at = np.flatnonzero(count > 0)
        y = np.repeat(it[at], count[at])
        x = it[ragged((np.repeat(begins, length)[at] + skip[at]).astype(np.int64), count[at])]
        near = maybe_alike(sets, x, sets, y)
        x, y = x[near], y[near]
        pairs = np.stack(np.divmod(np.unique(np.minimum(x, y) * len(sets.ids) + np.maximum(x, y)), len(sets.ids)))
        common = common_words(sets, pairs[0], sets, pairs[1])
        na, nb = sets.size(pairs[0]), sets.size(pairs[1])
        found.append(pairs[:, (9 * common >= 4 * (na + nb)) & ~((common == na) & (common == nb))])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.unique(np.concatenate(found, axis=1), axis=1)
    first = (micros[a] < micros[b]) | (micros[a] == micros[b]) & (sets.ids[a] < sets.ids[b])
    return np.where(first, a, b), np.where(first, b, a)
