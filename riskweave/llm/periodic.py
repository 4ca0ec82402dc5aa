"""Periodic runs of words, found by block matching.

A run repeats a unit of q words at least four times. At the scale b, a power of two, units have b <= q < 2b words. The first aligned
block of b words inside a run stands again q words later, so each block that recurs b to 2b - 1 words further on seeds a
period, and the stretch around it is extended both ways, word by word. Blocks are the keys of Aho-Corasick automata over word
numbers, a bounded group of blocks at a time, and only where a run could be: in a run of period q every word after the first
q was said within the last q words, so a stretch with an older word can't hold one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Shortest run, and how often it holds its unit at least.
LEAST_LENGTH, LEAST_TIMES = 6, 4
#: Blocks in one automaton. A node looks through its children one by one, and the root has one for each block.
GROUP = 32
#: A longer block is searched by so many of its first words; what follows is compared when the stretch is extended.
LONGEST_KEY = 1 << 9
#: Words that an automaton is shown at once.
SHOWN = 1 << 18


class Numbers(dict):
    """word -> a number of its own."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def since_last(w: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many words ago each word was last said in its document; the number of all words + 1 where it wasn't. starts: of the documents."""
    order = np.argsort(w, kind="stable")
    before = np.full(len(w), -1)
    same = w[order[1:]] == w[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    begin = np.repeat(starts, np.diff(np.append(starts, len(w))))
    at = np.arange(len(w))
    return np.where(before >= begin, at - before, len(w) + 1)


def _spans(w: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first word of the document, b, first, end) of every stretch that could hold a run at scale b, in the order of b."""
    if not len(w):
        return
    ago, b = since_last(w, starts), 1
    old, longest = np.arange(len(w)), np.diff(np.append(starts, len(w))).max()
    while max(LEAST_LENGTH, LEAST_TIMES * b) <= longest:
        old = old[ago[old] >= 2 * b]
        ends = np.append(old[1:], len(w))
        wide = ends - old - 1 >= max(LEAST_LENGTH - 1 if b == 1 else 0, (LEAST_TIMES - 1) * b)
        first = starts[np.searchsorted(starts, old[wide], "right") - 1]
        for begin, u, v in zip(first.tolist(), old[wide].tolist(), ends[wide].tolist(), strict=True):
            yield begin, b, max(begin, u + 1 - (2 * b - 1)), v
        b *= 2


def _same_ahead(w: np.ndarray, i: int, j: int, end: int) -> int:
    """How many words from i on equal those from j on, j > i, before end."""
    n, step = 0, 64
    while j + n < end:
        m = min(step, end - j - n)
        differ = w[i + n : i + n + m] != w[j + n : j + n + m]
        if differ.any():
            return n + int(differ.argmax())
        n, step = n + m, step * 4
    return n


def _same_behind(w: np.ndarray, i: int, j: int, begin: int) -> int:
    """How many words before i equal those before j, not below begin."""
    n, step = 0, 64
    while i - n > begin:
        m = min(step, i - n - begin)
        differ = w[i - n - m : i - n] != w[j - n - m : j - n]
        if differ.any():
            return n + int(differ[::-1].argmax())
        n, step = n + m, step * 4
    return n


def _has_shorter(w: np.ndarray, first: int, q: int) -> bool:
    """If the unit of q words at first is itself a repetition; twice the unit stands there."""
    left, r = q, 2
    primes = []
    while r * r <= left:
        if left % r == 0:
            primes.append(r)
            while left % r == 0:
                left //= r
        r += 1
    return any((w[first : first + q] == w[first + q // r : first + q // r + q]).all() for r in [*primes, *([left] if left > 1 else [])])


class Document:
    """The runs of one document, found scale by scale; w holds the numbers of its words between begin and end."""

    def __init__(self, w: np.ndarray, begin: int, end: int):
        self.w, self.begin, self.end = w, begin, end
        self.runs: list[tuple[int, int, int]] = []  # first word, end, period
        self.b, self.fresh = 0, []
        self.known: list[tuple[int, np.ndarray, np.ndarray]] = []  # scale, first words and ends of the runs of each scale below

    def inside_known(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """If a run of a lower scale holds all words from first to end. Runs of one scale that overlap by their periods are one, so it is the last that begins before."""
        held = np.zeros(len(first), bool)
        for _, starts, ends in self.known:
            at = np.searchsorted(starts, first, "right") - 1
            held |= (at >= 0) & (ends[at] >= end)
        return held

    def hopeless(self, at: np.ndarray, q: np.ndarray, key: int) -> np.ndarray:
        """Seeds that can't be of a run of period q.

        Within a known run of lower scale a longer unit isn't the smallest period. If the block stands in a run whose unit it holds four
        times, so does its other place, and a stretch with both runs goes past an end of both: the same end, q words apart.
        """
        out = self.inside_known(at, at + q + key)
        for scale, starts, ends in self.known:
            if 8 * scale <= key:
                one, two = (np.searchsorted(starts, x, "right") - 1 for x in (at, at + q))
                held = (one >= 0) & (two >= 0) & (ends[one] >= at + key) & (ends[two] >= at + q + key)
                out |= held & (ends[two] - ends[one] != q) & (starts[two] - starts[one] != q)
        return out

    def at_scale(self, b: int) -> None:
        if b != self.b:
            if self.fresh:
                fresh = np.array(sorted(self.fresh))
                self.known.append((self.b, fresh[:, 0], fresh[:, 1]))
            self.b, self.fresh, self.done = b, [], {}

    def search(self, b: int, first: int, end: int) -> None:
        """Adds the runs of periods b to 2b - 1 in a stretch. Scales ascend."""
        self.at_scale(b)
        x = np.arange(self.begin + -(-(first - self.begin) // b) * b, end - 2 * b + 1, b)  # aligned blocks
        x = x[~self.inside_known(x, x + 3 * b)]  # a run with a unit longer than a known run's can't overlap it so far
        k = 0
        while k < len(x):
            seen = len(self.fresh)
            self.group(b, x[k : k + GROUP], end)
            k += GROUP
            for s, e in self.fresh[seen:]:  # nor can another run of this scale overlap one by four blocks
                if k < len(x) and s <= x[k]:
                    k = max(k, int(np.searchsorted(x, e - 4 * b, "right")))

    def group(self, b: int, x: np.ndarray, end: int) -> None:
        w, key = self.w, min(b, LONGEST_KEY)
        automaton, content, of = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}, {}
        for at in x.tolist():
            block = tuple(w[at : at + key].tolist())
            if block not in content:
                content[block] = len(content)
                automaton.add_word(block, content[block])
            of[at] = content[block]
        automaton.make_automaton()
        found = []
        shown, stop = int(x[0]) + b, min(end, int(x[-1]) + 2 * b - 1 + key)
        while shown + key <= stop:
            text = tuple(w[shown : min(stop, shown + SHOWN + key - 1)].tolist())
            for last, block in automaton.iter(text):
                y = shown + last - key + 1
                at = self.begin + (y - b - self.begin) // b * b  # the one aligned block that is b to 2b - 1 words before
                if of.get(at) == block:
                    found.append((y - at, at))
            shown += SHOWN
        if found:
            seeds = np.array(sorted(found))
            seeds = seeds[~self.hopeless(seeds[:, 1], seeds[:, 0], key)]
            for q, at in seeds.tolist():
                self.extend(q, at)

    def extend(self, q: int, at: int) -> None:
        """Adds the run of period q around a word, if there is one."""
        if at < self.done.get(q, -1):  # in a stretch that has been looked at
            return
        first = at - _same_behind(self.w, at, at + q, self.begin)
        end = at + q + _same_ahead(self.w, at, at + q, self.end)
        self.done[q] = end - q
        if end - first >= max(LEAST_LENGTH, LEAST_TIMES * q) and not _has_shorter(self.w, first, q):
            self.runs.append((first, end, q))
            self.fresh.append((first, end))


def runs_of(w: np.ndarray, starts: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """First word of a document -> its runs (first word, length, period), by first word, then period. Documents without runs are left out."""
    ends, found = dict(zip(starts.tolist(), np.append(starts, len(w))[1:].tolist(), strict=True)), {}
    for begin, b, first, end in _spans(w, starts):
        if begin not in found:
            found[begin] = Document(w, begin, ends[begin])
        found[begin].search(b, first, end)
    return {begin: sorted((s - begin, e - s, q) for s, e, q in d.runs) for begin, d in found.items() if d.runs}


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that a run holds after its first unit."""
    edge = np.zeros(len(words) + 1, int)
    for s, n, q in runs:
        edge[s + q] += 1
        edge[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _search(rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            words = [t.split() for t in texts]
            if rewrite:
                words = [rewrite(i, x) for i, x in zip(ids.to_pylist(), words, strict=True)]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            numbers = Numbers()
            w = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, sizes.sum())
            begin = np.cumsum(sizes) - sizes
            found = runs_of(w, begin[sizes > 0])
            own = [found.get(s, []) if n else [] for s, n in zip(begin.tolist(), sizes.tolist(), strict=True)]
            flat = np.array(list(chain.from_iterable(own)), np.int64).reshape(-1, 3)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in own])]).astype(np.int32))
            runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], ["start", "length", "period"]))
            left = pa.array([b" ".join(collapsed(x, r) if r else x) for x, r in zip(words, own, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), runs, left], ["doc_id", "n_words", "runs", "collapsed"])

    return search


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period), collapsed: the periodic runs of every text, and the text without the repetitions.

    A run is a longest stretch of words in which words q apart are the same, q its smallest period, at least 6 words long and
    four times q. Words are stretches without white space (space, and 0x09 to 0x0D), unchanged, numbered from 0; runs come by start,
    then period. collapsed has the words, joined by single spaces, that no run holds after its first q words.
    rewrite(id, words) may change a document's words before the search.

    Null text has no words; a null id stays null. Repeated rows get a row each. An empty table gives an empty result. Other
    columns play no part. Texts are searched whole, one at a time; an automaton holds a bounded number of words, however
    long a text is. Nothing is shuffled.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_search(rewrite), f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
