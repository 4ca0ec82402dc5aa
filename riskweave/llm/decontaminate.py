"""Benchmark decontamination by latent semantic retrieval.

Passages of a document (overlapping runs of words, of several lengths) and benchmark items are TF-IDF vectors over the
benchmark's vocabulary, seen in the leading right singular subspace of passages. Where their cosine is high, the longest
common subsequence of words decides, and the item's last words (its answer) must be there too.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, text_of

#: Dimensions of the latent space, extra ones while it is sought, rounds of power iteration.
RANK, EXTRA, ROUNDS = 64, 16, 2
#: So many documents a fit took at most in earlier versions; tests of recall go beyond. Now it takes all.
FIT_DOCS = 4_000
#: Words of a passage that the latent space is fitted on; one starts every half of it.
FIT_WORDS = 32
#: Benchmark items searched for at once, and words of an item in one probe.
BLOCK, PROBE = 20_000, 64
#: Rows of a matrix in one message, words of documents handled together, and similarities held at once.
BLOCK_TERMS, GROUP, CELLS = 4096, 50_000, 1 << 21
#: Regions of a document for one item that are looked at without a count of the item's words in them before.
FEW = 8
#: A candidate's cosine (of an item with itself it is 1, whatever the latent space loses of it), the share of an item's words in order, words of the answer and the share of them.
COSINE, LCS, ANSWER_WORDS, ANSWER = 0.38, 0.7, 5, 0.6
#: Passage lengths in words; a passage starts every half of its length.
SCALES = (16, 32, 64)
_PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def words_of(text: str) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    low = text if text.isascii() else text.lower()
    return low.encode("utf-8", "surrogatepass").lower().translate(_PUNCTUATION).split()


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of integers."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & places.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


class Probes:
    """Benchmark items, their probes and vocabulary; row 0 of the vocabulary stands for all other words."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, w) for i, t in items if (w := words_of(t))]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}), 1)}
        self.numbers = [[self.vocabulary[w] for w in ws] for _, ws in self.items]
        self.bags = [frozenset(x) for x in self.numbers]
        self.parts = [(n, ws[k : k + PROBE]) for n, (_, ws) in enumerate(self.items) for k in range(0, len(ws), PROBE) if k == 0 or len(ws) - k >= 8]

    def vectors(self, table: np.ndarray) -> np.ndarray:
        return np.stack([table[[self.vocabulary[w] for w in ws]].sum(0) for _, ws in self.parts])

    def norms(self, idf: np.ndarray) -> np.ndarray:
        """Lengths of the probes before they are seen in the latent space."""
        out = []
        for _, ws in self.parts:
            terms, n = np.unique([self.vocabulary[w] for w in ws], return_counts=True)
            out.append(np.linalg.norm(n * idf[terms]))
        return np.array(out, np.float32)


def _numbered(probes: Probes):
    """Documents with the numbers of their words in the vocabulary, 0 for others: all that the passes after this one need."""

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = probes.vocabulary.get
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "words": [np.fromiter(map(get, words_of(body), repeat(0)), np.int32).tobytes() for body in frame["body"]]})

    return number


def _df(size: int):
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(size, np.int64)
        for frame in frames:
            n[0] += len(frame)
            for group in _groups(frame):
                cells = np.repeat(np.arange(len(group)), [len(x) for _, x in group]) * size + np.concatenate([x for _, x in group])
                n[1:] += np.bincount(np.unique(cells) % size, minlength=size)[1:]
        yield pd.DataFrame({"k": np.flatnonzero(n), "n": n[n > 0]})

    return count


def _pairs(idf: np.ndarray, table: np.ndarray, group: list[tuple[object, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(terms, rows): a group's share of A'A basis, A being its passages by terms with unit rows. table: idf by basis.

    A passage is two blocks of half its length. Both products are linear in the words, so a block's words are summed once for both its passages.
    """
    half = FIT_WORDS // 2
    counts = np.array([len(x) for _, x in group], np.int64)
    said, blocks = np.concatenate([x for _, x in group]).astype(np.int64), -(-counts // half)
    first, n = np.cumsum(blocks) - blocks, int(blocks.sum())
    place = np.arange(len(said)) + np.repeat(first * half - (np.cumsum(counts) - counts), counts)  # each document starts a block of its own
    ids = np.zeros(n * half, np.int64)
    ids[place] = said
    at, said = place[said > 0] // half, said[said > 0]
    if not len(said):
        return np.empty(0, np.int64), np.empty((0, table.shape[1]))
    last, begins = np.zeros(n, bool), np.zeros(n, bool)
    last[(first + blocks - 1)[blocks > 0]] = True
    begins[first[blocks > 0]] = True
    here, before = begins[at] | ~last[at], ~begins[at]  # a document's last block begins no passage, unless it is the only one
    cell = np.concatenate([at[here], at[before] - 1]) * len(table) + np.concatenate([said[here], said[before]])
    cell, times = np.unique(cell.astype(np.int32 if n * len(table) < 1 << 31 else np.int64), return_counts=True)  # short numbers are sorted sooner
    square = np.bincount(cell // len(table), weights=(times * idf[cell % len(table)]) ** 2, minlength=n)
    sums, joined = sum(table.take(ids[j::half], axis=0) for j in range(half)), (~last[:-1, None]).astype(np.float32)
    seen = sums.copy()
    seen[:-1] += sums[1:] * joined
    seen *= np.where((begins | ~last) & (square > 0), 1 / np.where(square > 0, square, 1), 0).astype(np.float32)[:, None]
    both = seen.copy()
    both[1:] += seen[:-1] * joined
    order = np.argsort(said.astype(np.uint16 if len(table) <= 1 << 16 else np.int64), kind="stable")
    start = np.flatnonzero(np.diff(said[order], prepend=-1))
    terms = said[order][start]
    return terms, np.add.reduceat(both.take(at[order], axis=0), start, axis=0) * idf[terms, None]


def _gram(idf: np.ndarray, basis: np.ndarray):
    """A partition's share of A'A basis."""

    def gram(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, table = np.zeros(basis.shape), (idf[:, None] * basis).astype(np.float32)
        for frame in frames:
            for group in _groups(frame):
                terms, rows = _pairs(idf, table, group)
                total[terms] += rows
        for block in range(0, len(total), BLOCK_TERMS):
            if (part := total[block : block + BLOCK_TERMS]).any():
                yield pd.DataFrame({"block": [block], "part": [part.tobytes()]})

    return gram


def _sum_parts(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(p) for p in rows["part"])
    return pd.DataFrame({"block": rows["block"].iloc[:1], "part": [total.tobytes()]})


def _summed(parts: DataFrame, lanes: int) -> DataFrame:
    """The sum of the parts of each block, in two steps, so that no task gets what every task has made."""
    kinds = "block long, part binary"
    return parts.groupBy("block", F.pmod(F.spark_partition_id(), F.lit(lanes))).applyInPandas(_sum_parts, kinds).groupBy("block").applyInPandas(_sum_parts, kinds)


def latent(numbered: DataFrame, probes: Probes, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Terms by latent dimensions: randomised SVD of the passages of all documents; each round multiplies a random basis by A'A on the executors."""
    size = len(probes.vocabulary) + 1
    width = min(rank + EXTRA, size)
    basis = np.random.default_rng(7).standard_normal((size, width))
    lanes = max(1, math.isqrt(numbered.rdd.getNumPartitions()))
    for _ in range(ROUNDS):
        basis, _ = np.linalg.qr(basis)
        product = np.zeros((size, width))
        for r in _summed(numbered.mapInPandas(_gram(idf, basis), "block long, part binary"), lanes).collect():
            product[r["block"] : r["block"] + BLOCK_TERMS] = np.frombuffer(r["part"]).reshape(-1, width)
        items = np.zeros_like(product)
        for _, ws in probes.parts:  # the items belong to the passages, with as much weight in all as the others
            terms, n = np.unique([probes.vocabulary[w] for w in ws], return_counts=True)
            v = n * idf[terms]
            v /= np.linalg.norm(v) or 1
            items[terms] += np.outer(v, v @ basis[terms])
        basis = product + items * (np.linalg.norm(product) / np.linalg.norm(items) if product.any() and items.any() else 1.0)
    q, s, _ = np.linalg.svd(basis, full_matrices=False)
    return q[:, : min(rank, int((s > 1e-9 * max(s[0], 1e-30)).sum()) or 1)]


def _groups(frame: pd.DataFrame) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Documents and the numbers of their words, as many together as have GROUP words."""
    group, size = [], 0
    for doc_id, words in frame[["doc_id", "words"]].itertuples(index=False):
        group.append((doc_id, np.frombuffer(words, np.int32)))
        size += len(group[-1][1])
        if size > GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


class Searcher:
    """Passages of groups of documents against the probes."""

    def __init__(self, probes: Probes, idf: np.ndarray, basis: np.ndarray, cosine: float, share: float):
        self.probes, self.cosine, self.share = probes, cosine, share
        table = (idf[:, None] * basis).astype(np.float32)
        self.queries = probes.vectors(table)
        self.least = (cosine * (self.queries**2).sum(1) / np.maximum(probes.norms(idf), 1e-9)).astype(np.float32)
        weigh = idf.astype(np.float32) ** 2
        weigh[0] = np.median(idf[1:]) ** 2  # any word outside the vocabulary is a dimension of its own
        self.table = np.concatenate([table, np.zeros((1, table.shape[1]), np.float32)])  # the last row is for what isn't there
        self.weigh = np.append(weigh, np.float32(0))
        self.item = np.array([n for n, _ in probes.parts])
        self.words_of_item = np.array([len(ws) for _, ws in probes.items])
        self.bag_ids = [np.array(list(bag)) for bag in probes.bags]
        self.mark = np.zeros(len(probes.vocabulary) + 1, bool)

    def candidates(self, group: list[tuple[object, np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Arrays (document, scale, first word, probe, cosine) wherever a passage is near enough to a probe; each document's words by number."""
        half = SCALES[0] // 2
        counts = np.array([len(ws) for _, ws in group], np.int64)
        blocks = -(-counts // half)
        first = np.cumsum(blocks) - blocks  # each document starts a block of its own
        ids = np.full(int(blocks.sum()) * half, len(self.table) - 1, np.int64)
        said = np.concatenate([ws for _, ws in group]).astype(np.int64)
        ids[np.arange(len(said)) + np.repeat(first * half - (np.cumsum(counts) - counts), counts)] = said
        parts, weights = (sum(x.take(ids[j::half], axis=0) for j in range(half)) for x in (self.table, self.weigh))
        sums = np.concatenate([np.zeros((1, parts.shape[1])), np.cumsum(parts, 0, dtype=float)])
        lengths = np.concatenate([[0.0], np.cumsum(weights, dtype=float)])
        out = []
        for scale in SCALES:
            step = scale // half
            each = -(-np.maximum(1, blocks - step // 2) // max(1, step // 2)) * (blocks > 0)
            doc = np.repeat(np.arange(len(group)), each)
            at = (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)) * max(1, step // 2)
            low, high = first[doc] + at, first[doc] + np.minimum(at + step, blocks[doc])
            size = np.sqrt(np.maximum(lengths[high] - lengths[low], 1e-9)).astype(np.float32)
            rows = max(1, CELLS // max(1, len(self.queries)))
            for k in range(0, len(doc), rows):
                v = (sums[high[k : k + rows]] - sums[low[k : k + rows]]).astype(np.float32)
                near = v @ self.queries.T
                near /= size[k : k + rows, None]
                p, q = np.divmod(np.flatnonzero(near >= self.least), near.shape[1])
                out.append((doc[k + p], np.full(len(p), scale), at[k + p] * half, q, near[p, q] * self.cosine / self.least[q]))
        none = [(np.empty(0, np.int64),) * 4 + (np.empty(0),)]
        return [np.concatenate(x) for x in zip(*(out or none), strict=True)], np.split(said, np.cumsum(counts)[:-1])

    def found(self, group: list[tuple[object, np.ndarray]]) -> list[tuple]:
        """Rows of (document, item): regions around near passages, of those that lie in one another the largest, are tried until one has enough of the item."""
        (doc, scale, at, q, cosine), ids = self.candidates(group)
        n = self.item[q]
        m = self.words_of_item[n]
        low, high = np.maximum(0, at - m), np.minimum(np.array([len(x) for x in ids])[doc], at + scale + m)
        order = np.lexsort((-high, low, n, doc))
        doc, n, low, high, cosine = (x[order] for x in (doc, n, low, high, cosine))
        rows, cuts = [], np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (n[1:] != n[:-1]), [True]])) if len(doc) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            d, k = int(doc[a]), int(n[a])
            item_id, item, bag, a_to_b = self.probes.items[k][0], self.probes.numbers[k], self.probes.bags[k], slice(a, b)
            enough: Iterable[int] = range(a, b)
            if b - a > FEW:
                begin, end = int(low[a]), int(high[a_to_b].max())  # no region lies outside, however long the document
                self.mark[self.bag_ids[k]] = True  # how many words of the item a region has, in whatever order
                have = np.concatenate([[0], np.cumsum(self.mark[ids[d][begin:end]])])
                self.mark[self.bag_ids[k]] = False
                enough = (np.flatnonzero(have[high[a_to_b] - begin] - have[low[a_to_b] - begin] >= self.share * len(item)) + a).tolist()
            reach, words, answer = -1, ids[d], item[-ANSWER_WORDS:]
            for i in enough:
                if high[i] <= reach:
                    continue  # inside a region that has failed
                reach = int(high[i])
                region = words[low[i] : reach].tolist()
                if len(bag.intersection(region)) < self.share * len(item) - (len(item) - len(bag)):
                    continue  # too many of them are the same word
                got = lcs(item, region)
                if got >= self.share * len(item) and lcs(answer, region) >= ANSWER * len(answer):
                    rows.append((group[d][0], item_id, float(cosine[i]), got, len(item)))
                    break
        return rows


def _search(probes: Probes, idf: np.ndarray, basis: np.ndarray, cosine: float, share: float):
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searcher = Searcher(probes, idf, basis, cosine, share)
        for frame in frames:
            rows = [r for group in _groups(frame) for r in searcher.found(group)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "cosine", "lcs", "item_words"]).astype({"doc_id": frame["doc_id"].dtype, "item_id": "Int64", "cosine": float})

    return search


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, share: float = LCS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, lcs, item_words: items of (item_id, text) that a document has in whole or nearly so.

    Document frequencies and the latent space are of all docs; every passage of every document is searched. The benchmark is the
    query set: it is taken in blocks of bounded size; for each, the docs' words are written once as numbers, and counted, fitted on and searched from there. Items or documents that are null or
    have no words match nothing; an item's null id is kept. Null ids are kept; repeated rows are reported each, repeated items by their own ids. An
    empty table gives an empty result. Other columns play no part.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body"))
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).distinct()
    n_items = asked.count()
    blocks = -(-n_items // BLOCK)
    schema = "doc_id long, item_id long, cosine double, lcs long, item_words long"
    out = None
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        probes = Probes([(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()])
        if not probes.items:
            continue
        numbered = materialise(slim.mapInPandas(_numbered(probes), "doc_id long, words binary"), "numbered")
        df = np.zeros(len(probes.vocabulary) + 1)
        for r in numbered.mapInPandas(_df(len(df)), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
            df[r["k"]] = r["n"]
        idf = np.log((df[0] + 1) / (df + 1)) + 0.05
        idf[0] = 0
        basis = latent(numbered, probes, idf)
        found = materialise(numbered.mapInPandas(_search(probes, idf, basis, cosine, share), schema), "leaks")
        discard(numbered)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)
