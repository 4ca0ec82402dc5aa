"""Ranked lexical search by block-max pruning.

Documents, in ranges, become a forward index of the terms that the items ask for. Ranges are cut into blocks; for each block, the largest
impact of every term bounds what any of its documents can score. For an item, blocks are taken in the order of their bounds and
scored document by document until the bound is below the score that the last of the best has by then.

A sixteenth of the ranges is searched first: the score of the last of the best there is one that the whole table reaches at least,
so the rest begins with it and hands on little more than what is wanted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, press, scratch, text_of, unpress

# Fixed values of the score: the impact of tf occurrences is (TOP * tf) div (1000 * tf + 20 * m), m = 100 - 50 + 50 * n * N div L.
TOP = 1_000_000_000
#: Documents of one block; bytes of items that are searched for at once; ranges of which one is searched first; lanes of the last choice.
BLOCK, ITEM_BYTES, FIRST, LANES = 32, 4 << 20, 16, 16
#: Products of a term's weight and a block's maximum that are held at once.
PRODUCTS = 1 << 22

#: Terms are stretches of ASCII letters, digits and all that isn't ASCII; only A-Z is lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Vocabulary(dict):
    """term -> number; -1 for others."""

    def __missing__(self, term: bytes) -> int:
        return -1


def _index(vocabulary: Vocabulary):
    """A row for each range of documents: their ids and lengths, and how often each has which term."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            if not texts:
                continue
            split = [terms_of(t) for t in texts]
            n = np.fromiter(map(len, split), np.int64, len(split))
            term = np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(split)), np.int64, n.sum())
            known = term >= 0
            key, tf = np.unique(np.repeat(np.arange(len(n)), n)[known] * max(1, len(vocabulary)) + term[known], return_counts=True)
            doc, term = np.divmod(key, max(1, len(vocabulary)))
            seen, df = np.unique(term, return_counts=True)
            none = np.array(ids.is_null())
            row = {
                "first": [bool(hash((int(n.sum()), len(texts[0]), len(key))) % FIRST == 0)], "n_docs": [int((n > 0).sum())], "n_terms": [int(n.sum())], "seen": [press(seen)], "df": [press(df)],
                "ids": [ids.fill_null(0).to_numpy().astype(np.int64).tobytes()], "none": [press(none.astype(np.int64))], "n": [press(n)], "each": [press(np.bincount(doc, minlength=len(n)))], "term": [press(term)], "tf": [press(tf)],
            }
            yield pa.RecordBatch.from_pydict(row)

    return index


_INDEX = "first boolean, n_docs long, n_terms long, seen binary, df binary, ids binary, none binary, n binary, each binary, term binary, tf binary"


def _frequencies(size: int):
    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for f in frames:
            for seen, df in zip(f["seen"], f["df"], strict=True):
                total[unpress(seen)] += unpress(df)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "df": total[at]})

    return add


def damping(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of n terms; in whole numbers of any size where 64 bits don't hold the product."""
    if len(n) and int(n.max()) > (1 << 62) // (50 * max(1, n_docs)):
        return np.array([50 + 50 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 50 + 50 * n * n_docs // max(1, n_terms)


class Best:
    """For each item the k best documents so far: by score, then id, null ids last."""

    def __init__(self, k: int, floors: np.ndarray):
        self.k, self.floors = k, np.maximum(floors, 1)
        self.kept: dict[int, tuple[np.ndarray, ...]] = {}

    def add(self, item: int, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.floors[item]
        if not good.any():
            return
        new = score[good], none[good], ids[good]
        if item in self.kept:
            new = tuple(map(np.concatenate, zip(self.kept[item], new, strict=True)))
        order = np.lexsort((new[2], new[1], -new[0]))[: self.k]
        self.kept[item] = tuple(x[order] for x in new)
        if len(order) == self.k:
            self.floors[item] = max(self.floors[item], new[0][order[-1]])


def search_range(r, items: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, best: Best) -> int:
    """Adds what a range of documents has to the best; how many blocks it scored. r: a row of the index; items: the terms of each."""
    ids, none, n, each, term, tf = np.frombuffer(r.ids, np.int64), unpress(r.none), unpress(r.n), unpress(r.each), unpress(r.term), unpress(r.tf)
    if not len(term):
        return 0
    doc = np.repeat(np.arange(len(n)), each)
    impact = TOP * tf // (1000 * tf + 20 * damping(n, n_docs, n_terms)[doc])
    blocks = -(-len(n) // BLOCK)
    seen, local = np.unique(term, return_inverse=True)
    most = np.zeros((len(seen) + 1, blocks), np.int64)  # the last row is for terms that no document here has
    key = local * blocks + doc // BLOCK
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order], prepend=-1))
    most.ravel()[key[order][cuts]] = np.maximum.reduceat(impact[order], cuts)
    row = np.full(len(weight), len(seen))
    row[seen] = np.arange(len(seen))
    edges = np.concatenate([[0], np.cumsum(each)])

    scored, wanted = 0, np.zeros(len(weight), np.int64)
    sizes = np.array([len(t) for t in items])
    step = max(1, PRODUCTS // (blocks * max(1, int(sizes.max(initial=1)))))
    for at in range(0, len(items), step):
        some = np.concatenate(items[at : at + step]) if items[at : at + step] else np.empty(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes[at : at + step])])
        ahead = np.zeros((len(some) + 1, blocks), np.int64)
        np.cumsum(weight[some, None] * most[row[some]], 0, out=ahead[1:])
        bounds = ahead[starts[1:]] - ahead[starts[:-1]]
        for i in np.flatnonzero((bounds >= best.floors[at : at + step, None]).any(1)):
            item, bound = at + int(i), bounds[i]
            wanted[items[item]] = weight[items[item]]
            for b in np.argsort(-bound, kind="stable").tolist():
                if bound[b] < best.floors[item]:
                    break
                lo, hi = b * BLOCK, min(len(n), (b + 1) * BLOCK)
                p, q = edges[lo], edges[hi]
                sums = np.concatenate([[0], np.cumsum(wanted[term[p:q]] * impact[p:q])])
                best.add(item, np.diff(sums[edges[lo : hi + 1] - p]), none[lo:hi], ids[lo:hi])
                scored += 1
            wanted[items[item]] = 0
    return scored


def _search(items: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int, floors: np.ndarray):
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(k, floors)
        for f in frames:
            for r in f.itertuples(index=False):
                search_range(r, items, weight, n_docs, n_terms, best)
        for item, (score, none, ids) in best.kept.items():
            yield pd.DataFrame({"item": item, "score": score, "doc_id": pd.array(np.where(none == 1, 0, ids), "Int64")}).assign(doc_id=lambda x, none=none: x["doc_id"].mask(none == 1))

    return search


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item, with their ranks; lanes first, then what these leave."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    lanes = found.withColumn("lane", F.pmod(F.xxhash64("doc_id", "score"), F.lit(LANES)))
    best = lanes.withColumn("rank", F.row_number().over(Window.partitionBy("item", "lane").orderBy(*order))).filter(F.col("rank") <= k).drop("rank", "lane")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: for each item the k documents that score highest, equal scores by ascending id, null ids last.

    Terms are the longest stretches of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. A term in df of the N documents
    that have any weighs floor(1000 ln((2N + 2) / (2 df + 1))); a document's score is the sum, over the item's different terms, of weight times
    (10^9 tf) div (1000 tf + 20 m), with m = 50 + (50 n N) div L, n the document's terms and L those of all. Only scores above 0 count.

    Ids are integers. Null and empty texts have no terms. Every row of either table stands for itself: documents that repeat an id are ranked each,
    items that repeat an id get their own ranks each. Empty tables, and items without terms, give no rows. Other columns play no part.

    Items are searched for in lots of bounded size, all documents for each lot. The driver sees the items' texts, one number for each of
    their terms, and one score for each item.
    """
    with scratch(docs.sparkSession):
        return materialise(_rank(docs, items, k, doc_id, text, item_id, item_text), "ranked", keep=True)


def _rank(docs: DataFrame, items: DataFrame, k: int, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    spark = docs.sparkSession
    asked = materialise(items.select(F.col(item_id).alias("item_id"), text_of(item_text).alias("text"), F.monotonically_increasing_id().alias("row")), "ranked-items")
    lots = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // ITEM_BYTES))
    rows, out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")), None
    for lot in range(lots):
        own = asked.filter(F.pmod(F.xxhash64("row"), F.lit(lots)) == lot)
        found = _rank_lot(rows, [(r["row"], r["text"]) for r in own.select("row", "text").collect()], k)  # ITEM_BYTES, about
        out = found if out is None else out.unionByName(found)
    return out.join(asked.select("item_id", "row"), "row").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _rank_lot(rows: DataFrame, asked: list[tuple[int, str]], k: int) -> DataFrame:
    spark, vocabulary = rows.sparkSession, Vocabulary()
    items = [np.array(sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(body.encode())}), np.int64) for _, body in asked]
    index = materialise(rows.mapInArrow(_index(vocabulary), _INDEX), "ranked-index", by=("first",))
    totals = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).head()
    n_docs, n_terms = totals["docs"] or 0, totals["terms"] or 0
    weight = np.full(len(vocabulary), 0, np.int64)
    for r in index.select("seen", "df").mapInPandas(_frequencies(len(vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one for each term that is asked for
        weight[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))

    schema, floors, parts = "item int, score long, doc_id long", np.zeros(len(items), np.int64), []
    for first in (True, False):
        found = index.filter(F.col("first") == first).select("ids", "none", "n", "each", "term", "tf").mapInPandas(_search(items, weight, n_docs, n_terms, k, floors), schema)
        parts.append(materialise(_top(found, k), "ranked-part"))
        if first:
            floors = floors.copy()
            for r in parts[0].filter(F.col("rank") == k).collect():  # one for each item at most
                floors[r["item"]] = r["score"]
    best = _top(parts[0].drop("rank").unionByName(parts[1].drop("rank")), k)
    numbers = spark.createDataFrame([(i, row) for i, (row, _) in enumerate(asked)], "item int, row long")
    return materialise(best.join(F.broadcast(numbers), "item").select("row", "rank", "doc_id", "score"), "ranked-lot")
