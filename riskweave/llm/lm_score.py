"""The language model of lm.py, learnt from and applied to a table of documents.

Chunks of documents tell owners of ranges of words which words they have, class by class, and how often. An owner sums them up and so has
all words of its range side by side: what follows the beginning of a word it knows by itself, but for beginnings that
words of its neighbours share, and last bytes, which owners of hash ranges tell. Each word is spelt once and the answer sent back to the chunks.

A chunk sends a message to each owner at most, and never more messages than it has words.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lm
from .common import discard, give_back, materialise, press, scratch, text_of, unpress, width

#: Bytes of text in a chunk and for each owner of words, bytes of distinct words in a piece, tokens handled at once, and bytes of words spelt at once.
CHUNK, OWNED, PIECE, TOKENS, SPELT = 4 << 20, 32 << 20, 3 << 18, 50_000, 1 << 18
#: Words that each task draws for the bounds of the owners' ranges.
DRAWN = 64
#: Rows between tasks. Which of the blobs a row has follows from its kind.
ROW = "kind int, owner int, chunk long, start long, a binary, b binary, c binary, d binary"
UNIT = lm.CLASSES + 1


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _row(kind: int, owner: int = 0, chunk: int = 0, start: int = 0, a: bytes = b"", b: bytes = b"", c: bytes = b"", d: bytes = b"") -> tuple:
    return kind, owner, chunk, start, a, b, c, d


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "owner", "chunk", "start", "a", "b", "c", "d"])


def _bytes(words: list[bytes]) -> bytes:
    return zstandard.compress(b"\n".join(words), 1)


def _list(blob: bytes) -> list[bytes]:
    return zstandard.decompress(blob).split(b"\n")


def _said(bodies) -> list[bytes]:
    """Texts as lower-case words, each with a space after it."""
    return [b" ".join([*body.encode("utf-8", "surrogatepass").lower().split(), b""]) for body in bodies]


def tokens(said: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words in order, the number of each text's words and then its end (the empty word), and how many there are."""
    lists = pc.split_pattern(pa.array(said, pa.large_binary()), b" ")
    flat = lists.flatten().dictionary_encode()
    order = pc.array_sort_indices(flat.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    at = flat.indices.to_numpy(zero_copy_only=False)
    return flat.dictionary.take(pa.array(order)).to_pylist(), rank[at], np.diff(lists.offsets.to_numpy()).astype(np.int64)


def _buckets(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(lm.bucket, words), np.int64, len(words))


def _parts(sizes: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Documents and their tokens, as many together as have TOKENS tokens."""
    ends = np.cumsum(sizes)
    cuts = [0, *(np.flatnonzero(np.diff(ends // TOKENS)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield slice(a, b), slice(int(ends[a] - sizes[a]), int(ends[b - 1]))


# What is known before words are counted: the groups of short words, and bounds of ranges of words.


def _look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    both, size, drawn = np.zeros((lm.BUCKETS + 1, lm.BUCKETS + 1)), 0, {}
    for frame in frames:
        said = _said(frame["body"])
        size += sum(map(len, said))
        learn = np.flatnonzero(~frame["held_out"].to_numpy(bool))
        lists = pc.split_pattern(pa.array([said[i] for i in learn], pa.large_binary()), b" ")
        flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
        short = pc.less_equal(pc.binary_length(flat), lm.SHORT).to_numpy(zero_copy_only=False)
        coded = flat.filter(pa.array(short)).dictionary_encode()
        own = np.full(len(flat), lm.BUCKETS)
        own[short] = _buckets(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        for d, t in _parts(sizes):
            both += lm.together(own[t], sizes[d])
        some = flat.take(pa.array(np.arange(0, len(flat), 16))).unique().to_pylist()  # every 16th word is enough for bounds
        drawn.update((xxhash.xxh32_intdigest(w), w) for w in some)
        drawn = {h: drawn[h] for h in heapq.nsmallest(DRAWN, drawn)}
    yield pd.DataFrame({"sums": [both.tobytes()], "size": [size], "drawn": [_bytes(sorted(drawn.values()))]})


def _looked(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    both, size, drawn = np.zeros((lm.BUCKETS + 1) ** 2), 0, []
    for frame in rows:
        for sums in frame["sums"]:
            both += np.frombuffer(sums)
        size += int(frame["size"].sum())
        drawn += [w for blob in frame["drawn"] for w in _list(blob)]
    yield pd.DataFrame({"sums": [both.tobytes()], "size": [size], "drawn": [_bytes(drawn)]})


def _overview(slim: DataFrame) -> tuple[np.ndarray, list[bytes]]:
    """The group of each bucket of short words, and the words at which owners' ranges begin (but the first)."""
    kinds, few = "sums binary, size long, drawn binary", max(1, math.isqrt(width(slim.sparkSession)))
    parts = slim.mapInPandas(_look, kinds).repartition(few).mapInPandas(_looked, kinds).collect()
    both = sum((np.frombuffer(r["sums"]) for r in parts), np.zeros((lm.BUCKETS + 1) ** 2))
    drawn = sorted(w for r in parts for w in _list(r["drawn"]))
    owners = max(1, -(-sum(r["size"] for r in parts) // OWNED))
    bounds = {drawn[k * len(drawn) // owners] for k in range(1, owners)}
    return lm.groups(both.reshape(lm.BUCKETS + 1, -1)), sorted(bounds - {b""})


# Chunks. Kind 0: a chunk's documents (ids and marks, sizes, tokens, numbers of units). Kind 1: to an owner (words, classes, counts). Kind 2: sums for recall.


def _chunk(number: int, docs: pd.DataFrame, group: np.ndarray, bounds: list[bytes]) -> list[tuple]:
    words, at, sizes = tokens(docs["said"].tolist())
    own, learn, fit = group[_buckets(words)], ~docs["held_out"].to_numpy(bool), lm.Fit(lm.RECALL_GATES, lm.RECALL_START)
    unit = np.empty(len(at), np.int32 if len(words) * UNIT < 1 << 31 else np.int64)
    for d, t in _parts(sizes):
        unit[t] = at[t].astype(np.int64) * UNIT + lm.classes(own[at[t]], sizes[d])
        keep = np.repeat(learn[d], sizes[d])
        if keep.any():
            r = lm.Recall(at[t][keep], sizes[d][learn[d]])
            fit.add(r.hit, r.inputs, r.gate)
    units, of = np.unique(unit, return_inverse=True)
    n = np.bincount(of, weights=np.repeat(learn, sizes)).astype(np.int64)
    marks = docs["no_id"].to_numpy(bool) * 2 + docs["held_out"].to_numpy(bool)
    lengths = np.fromiter(map(len, docs["said"]), np.int64, len(docs))
    rows = [_row(0, chunk=number, a=press(np.stack([docs["doc_id"].to_numpy(), marks, sizes, lengths])), b=press(at), c=press(of))]
    edges = np.searchsorted(units, [0, *(bisect.bisect_left(words, w) * UNIT for w in bounds), len(words) * UNIT])
    for o, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)):
        if b > a:
            rows.append(_row(1, o, number, a, _bytes([words[r] for r in (units[a:b] // UNIT).tolist()]), press(units[a:b] % UNIT), press(n[a:b])))
    return [*rows, _row(2, a=fit.sums())]


def _chunks(group: np.ndarray, bounds: list[bytes]):
    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for frame in frames:
            docs = frame[["doc_id", "no_id", "held_out"]].assign(said=_said(frame["body"]))
            ends = size + np.cumsum(docs["said"].map(len).to_numpy(np.int64) + 64)
            cut = (ends // CHUNK).astype(np.int64)
            for k in np.unique(cut):
                if k and held:
                    yield _frame(_chunk(number, pd.concat(held), group, bounds))
                    number, held = number + 1, []
                    give_back()
                held.append(docs[cut == k])
            size = int(ends[-1] % CHUNK)
        if held:
            yield _frame(_chunk(number, pd.concat(held), group, bounds))
        give_back()

    return chunks


# Owners of words. Kind 3: a piece of an owner's units (words, classes, counts), its number as chunk. Kind 4: the place of each unit of a chunk among
# all the owner's. Kind 5: to a piece, what contexts are followed by. Kind 7: a piece's units spelt. Kind 6: answers to a chunk.


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    sent = [_list(b) for b in rows["a"]]
    flat = pa.array([w for ws in sent for w in ws], pa.large_binary()).dictionary_encode()
    order = pc.array_sort_indices(flat.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    units, of = np.unique(rank[flat.indices.to_numpy(zero_copy_only=False)] * UNIT + np.concatenate([unpress(b) for b in rows["b"]]), return_inverse=True)
    n = np.bincount(of, weights=np.concatenate([unpress(c) for c in rows["c"]])).astype(np.int64)
    words, owner, out, at = flat.dictionary.take(pa.array(order[units // UNIT])).to_pylist(), int(rows["owner"].iloc[0]), [], 0
    size = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) // PIECE
    begins = np.flatnonzero(np.concatenate([[True], units[1:] // UNIT != units[:-1] // UNIT]))  # a word's units stay together
    cuts = [0, *begins[1:][np.diff(size[begins]) > 0].tolist(), len(words)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        out.append(_row(3, owner, owner << 32 | k, a, _bytes(words[a:b]), press(units[a:b] % UNIT), press(n[a:b])))
    for chunk, start, ws in zip(rows["chunk"], rows["start"], sent, strict=True):
        out.append(_row(4, owner, chunk, start, press(of[at : at + len(ws)])))
        at += len(ws)
    return _frame(out)


class Owned:
    """A piece of units: words (sorted), of (the class each stands in) and n; and what it knows of contexts by itself."""

    def __init__(self, row):
        self.words, self.of, self.n = _list(row.a), unpress(row.b), unpress(row.c)
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1
        parts = [lm.Batch(self.words[w], self.of[w]) for w, _ in self.slices()]
        self.bytes, self.pair = np.concatenate([b.bytes for b in parts]), np.concatenate([b.pair.astype(np.uint16) for b in parts])
        self.keys = [np.concatenate([b.keys[kind] for b in parts]) for kind in range(lm.CONTEXTS)]

    def tally(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return lm.tally(self.keys[kind], np.repeat(self.n, self.sizes))

    def shared(self) -> np.ndarray:
        """Contexts of the second kind that neighbours may have too: beginnings of the first and of the last word."""
        ends = [w[: lm.DEPTH] for w in (self.words[0], self.words[-1]) for _ in range(UNIT)]
        return np.unique(lm.Batch(ends, np.tile(np.arange(UNIT), 2)).keys[1] >> 8)

    def slices(self) -> Iterator[tuple[slice, slice]]:
        """Words and their bytes, as many at a time as have SPELT bytes."""
        ends = np.cumsum(self.sizes)
        cuts = [0, *(np.flatnonzero(np.diff(ends // SPELT)) + 1).tolist(), len(ends)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield slice(a, b), slice(int(ends[a] - self.sizes[a]), int(ends[b - 1]))

    def known(self, code: lm.Code, told: pd.DataFrame) -> list[tuple[lm.Counts, np.ndarray]]:
        """For each kind of context the counts over all training documents, and the key of each byte."""
        out = []
        for kind in range(lm.CONTEXTS):
            own, n, of = self.tally(kind)
            pair = np.empty(len(own), np.int64)
            pair[of] = self.pair
            part = told[told["start"] == kind]
            keys = np.concatenate([np.empty(0, np.int64), *(np.cumsum(unpress(b)) for b in part["a"])])
            counts = np.concatenate([np.empty(0, np.int64), *map(unpress, part["b"])])
            n = np.where(np.isin(own >> 8, self.shared()), 0, n) if kind else np.zeros_like(n)  # of these all is told
            every, at = np.unique(np.concatenate([own, keys]), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([n, counts])).astype(np.int64)
            new = np.concatenate([[0], np.cumsum((every[1:] >> 8) != (every[:-1] >> 8))])
            pairs = np.empty(int(new[-1]) + 1, np.int64)
            pairs[new[at[: len(own)]]] = pair  # every context told of is one of its own
            out.append((lm.Counts(code, every, pairs[new], total), at[: len(own)].astype(np.int32)[of]))
        return out

    def inputs(self, code: lm.Code, told: pd.DataFrame, leave_out: bool):
        """Slice by slice: words, sizes, and what lm.inputs gives."""
        known = [(c, *c.inputs(leave_out), of) for c, of in self.known(code, told)]
        for words, bytes_ in self.slices():
            yield words, self.sizes[words], lm.inputs(code, self.pair[bytes_].astype(np.intp), self.bytes[bytes_], [(c, x, y, of[bytes_]) for c, x, y, of in known])


def _asked(owners: int):
    """Messages to owners of hash ranges: the contexts that a range of words doesn't know alone, and what it has after them."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                own = Owned(row)
                for kind in range(lm.CONTEXTS):
                    keys, n, _ = own.tally(kind)
                    if kind:
                        at = np.isin(keys >> 8, own.shared())
                        keys, n = keys[at], n[at]
                    edges = np.searchsorted(keys >> 8, [(o << 48) // owners for o in range(owners + 1)])  # a context has one owner
                    yield _frame([_row(kind, o, row.chunk, 0, press(np.diff(keys[a:b], prepend=0)), press(n[a:b])) for o, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a])

    return ask


def _tell(messages: pd.DataFrame) -> pd.DataFrame:
    """Answers each message with all bytes that training documents have after its contexts, and how often."""
    sent = [np.cumsum(unpress(b)) for b in messages["a"]]
    keys, at = np.unique(np.concatenate(sent), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([unpress(b) for b in messages["b"]])).astype(np.int64)
    keys, n = keys[n > 0], n[n > 0]
    context, rows = keys >> 8, []
    for kind, asker, s in zip(messages["kind"], messages["chunk"], sent, strict=True):
        own = np.unique(s >> 8)
        has = own[np.minimum(np.searchsorted(own, context), len(own) - 1)] == context
        rows.append(_row(5, 0, int(asker), int(kind), press(np.diff(keys[has], prepend=0)), press(n[has])))
    return _frame(rows)


def _fit(code):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        """A range's sums for the mixing weights, each word as often as training documents have it."""
        own = Owned(next(rows[rows["kind"] == 3].itertuples()))
        sums = lm.Fit(lm.GATES, lm.SPELL_START)
        for words, sizes, (n, bits, logits, gate) in own.inputs(code.value, rows[rows["kind"] == 5], True):
            by = np.add.reduceat(n, np.cumsum(sizes) - sizes)
            sums.add(bits, logits, gate, np.repeat(own.n[words], by))
        give_back()
        return pd.DataFrame({"sums": [sums.sums()]})

    return fit


def _spell(code, weights: np.ndarray):
    def spell(rows: pd.DataFrame) -> pd.DataFrame:
        """For each unit of a piece how often training documents have its word, and what it costs to spell."""
        row, told = next(rows[rows["kind"] == 3].itertuples()), rows[rows["kind"] == 5]
        own = Owned(row)
        spelt = np.concatenate([lm.spelling(sizes, *x, weights) for _, sizes, x in own.inputs(code.value, told, False)]).astype(np.float32)
        word = np.cumsum([0, *(a != b for a, b in zip(own.words, own.words[1:], strict=False))])
        n = np.bincount(word, weights=own.n).astype(np.int64)[word]
        del own
        give_back()
        return _frame([_row(7, row.owner, row.chunk, row.start, press(n), zstandard.compress(spelt.tobytes(), 1))])

    return spell


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """An owner's answers to chunks, from its pieces."""
    pieces = rows[rows["kind"] == 7].sort_values("start")
    n, spelt = np.concatenate([unpress(b) for b in pieces["a"]]), np.concatenate([_floats(b) for b in pieces["b"]])
    out = []
    for row in rows[rows["kind"] == 4].itertuples():
        at = unpress(row.a)
        out.append(_row(6, 0, row.chunk, row.start, press(n[at]), zstandard.compress(spelt[at].tobytes(), 1)))
    return _frame(out)


def _floats(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), np.float32)


def _score(recall: np.ndarray, n_all: int, distinct: int):
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "bits_per_byte", "train_tokens"]

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        answers = rows[rows["kind"] == 6].sort_values("start")
        seen = np.concatenate([unpress(b) for b in answers["a"]])
        spelt = np.concatenate([_floats(b) for b in answers["b"]]).astype(float)
        base, known, out = np.log10((seen + 1) / (n_all + distinct + 1)), (seen > 0).astype(float), []
        row = next(rows[rows["kind"] == 0].itertuples())
        ids, marks, sizes, lengths = unpress(row.a).reshape(4, -1)
        at, of = unpress(row.b), unpress(row.c)
        for d, t in _parts(sizes):
            r, first = lm.Recall(at[t], sizes[d]), np.cumsum(sizes[d]) - sizes[d]
            logs = spelt[of[t]]
            logs[r.at[r.hit]] = 0.0  # a word that is recalled isn't spelt
            logs[r.at] += r.logs(recall)
            out.append(np.stack([np.add.reduceat(x, first) for x in (known[of[t]], base[of[t]], logs)]))
        k, b, logs = np.concatenate(out, 1)
        named = pd.Series(ids, dtype="Int64").mask(marks >= 2)
        return pd.DataFrame({
            "doc_id": named, "held_out": marks % 2 == 1, "n_tokens": sizes, "n_known": k.astype(np.int64), "base_score": b,
            "score": logs / math.log(10), "bits_per_byte": -logs / math.log(2) / np.maximum(lengths, 1), "train_tokens": n_all,
        })[columns]

    return score


# The model's parts.


def _add_up(gates: int, start: np.ndarray):
    def add(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A partition's sums in one row; every row's are of one fixed size."""
        total = lm.Fit(gates, start)
        for frame in rows:
            for sums in frame["sums"]:
                total.take(sums)
        yield pd.DataFrame({"sums": [total.sums()]})

    return add


def _fitted(sums: DataFrame, gates: int, start: np.ndarray) -> lm.Fit:
    """The sum of a column of sums, added up in two steps before it reaches the driver."""
    add, out = _add_up(gates, start), lm.Fit(gates, start)
    few = max(1, math.isqrt(width(sums.sparkSession)))
    for r in sums.mapInPandas(add, "sums binary").repartition(few).mapInPandas(add, "sums binary").collect():
        out.take(r["sums"])
    return out


def _triples(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(pair, byte, n): how often training documents have a byte after two others, within words; pair -1: tokens, -2: words they have."""
    for frame in frames:
        for row in frame.itertuples():
            own = Owned(row)
            word = np.cumsum([0, *(a != b for a, b in zip(own.words, own.words[1:], strict=False))])
            yield pd.DataFrame({"pair": [-1, -2], "byte": [0, 0], "n": [int(own.n.sum()), int((np.bincount(word, weights=own.n) > 0).sum())]}).astype({"pair": "int32", "byte": "int32"})
            for words, at in own.slices():
                key, of = np.unique(own.pair[at].astype(np.int64) << 8 | own.bytes[at], return_inverse=True)
                n = np.bincount(of, weights=np.repeat(own.n[words], own.sizes[words])).astype(np.int64)
                yield pd.DataFrame({"pair": (key >> 8).astype(np.int32), "byte": (key & 255).astype(np.int32), "n": n})[n > 0]


def _code(units: DataFrame) -> tuple[lm.Code, int, int]:
    """Codes from the counts of bytes after pairs of bytes (65,536 pairs at most, far fewer in text); tokens and words of training documents."""
    triples = units.mapInPandas(_triples, "pair int, byte int, n long").groupBy("pair", "byte").agg(F.sum("n").alias("n"))
    own: dict[int, dict[int, int]] = {}
    singles = np.zeros((256, 256), np.int64)
    totals = {-1: 0, -2: 0}
    for r in triples.collect():
        if r["pair"] < 0:
            totals[r["pair"]] = r["n"]
        else:
            own.setdefault(r["pair"], {})[r["byte"]] = r["n"]
            singles[r["pair"] & 255, r["byte"]] += r["n"]
    return lm.Code(own, singles), totals[-1], totals[-2]


def lm_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of docs.

    A text counts as its words (runs of other bytes than ASCII white space, A-Z lowered) with single spaces and an end. The model
    and the base learn from all documents that aren't held out (crc32 of the id as text, modulo 7, is 2). score is the model's
    log10 probability, base_score that of smoothed word counts. Null text is empty: one token, the end. A null id isn't
    held out. Repeated rows are learnt from and scored each. A word may be of any length; its contexts look back DEPTH bytes.
    An empty table gives an empty result. Other columns play no part.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body"))
    slim = plain.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.isnull("doc_id").alias("no_id"), held_out().alias("held_out"), "body")
    with scratch(docs.sparkSession):
        return _lm_score(slim)


def _lm_score(slim: DataFrame) -> DataFrame:
    spark = slim.sparkSession
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double, train_tokens long"
    group, bounds = _overview(slim)
    sent = materialise(slim.mapInPandas(_chunks(group, bounds), ROW), "lm-chunks")
    recall = _fitted(sent.filter("kind = 2").select(F.col("a").alias("sums")), lm.RECALL_GATES, lm.RECALL_START).weights()
    owners = len(bounds) + 1
    dealt = lambda rows, key, n: rows.repartition(n, key).groupBy(key)
    owned = materialise(dealt(sent.filter("kind = 1"), "owner", owners).applyInPandas(_merge, ROW), "lm-words")
    units = owned.filter("kind = 3")
    pieces = max(1, units.count())
    made, n_all, distinct = _code(units)
    code = spark.sparkContext.broadcast(made)

    messages = units.mapInPandas(_asked(pieces // 8 + 1), ROW)
    told = materialise(messages.groupBy("owner", "kind").applyInPandas(_tell, ROW), "lm-contexts")
    asked = dealt(units.unionByName(told), "chunk", pieces)
    weights = _fitted(asked.applyInPandas(_fit(code), "sums binary"), lm.GATES, lm.SPELL_START).weights().astype(np.float32)
    spelt = materialise(asked.applyInPandas(_spell(code, weights), ROW), "lm-spelt")
    discard(told)
    answers = dealt(owned.filter("kind = 4").unionByName(spelt), "owner", owners).applyInPandas(_answer, ROW)
    answers = materialise(answers, "lm-answers")
    discard(owned, spelt)
    scored = dealt(sent.filter("kind = 0").unionByName(answers), "chunk", 2 * owners).applyInPandas(_score(recall, n_all, distinct), kinds)
    return materialise(scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"), "lm-scores", keep=True)
