"""Repeated passages across documents, found level by level: what repeats at one length alone is tried at twice that.

The first level is half of the window (halved again while it is long). Only the least hash of each run of such short windows is
exchanged (two documents that share a whole window share that least hash too), as sorted compressed fingerprints in
the manner of exact dedup: owners answer with bitmaps. Only windows whose short window repeats reach the next level. What
is left at full length goes to owners in the same way, with its smallest document id, and they answer with the smallest of all.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M2, WordHashes, discard, materialise, mix, remove_at_end, shared_dir, text_of, width, windows
from .exact_dedup import _bitmap, _flags, _judge, rice_decode, rice_encode

WINDOW = 13
#: Bits of the fingerprints that are exchanged; too few only leave more for the next level.
BITS = 50
#: Bits at full length that are sent compressed, and bits of a second hash that go with them. Two different windows among n are
#: taken for one with a chance of about n * n / 2**95: 1e-5 where there are 1e12.
FULL_BITS, MORE_BITS = 62, 32
#: Bytes of text that are handled together, and bytes of text for each owner of fingerprints.
CHUNK_BYTES, OWNED_BYTES = 6 << 20, 16 << 20


def levels(window: int) -> list[int]:
    """Lengths from the first to the window; each is at most twice the one before."""
    out = [window]
    while out[0] > 8:
        out.insert(0, (out[0] + 1) // 2)
    return out


def least_of_runs(h: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every n consecutive values, by doubling."""
    span = 1
    while span < n:
        step = min(span, n - span)
        h = np.minimum(h[: len(h) - step], h[step:])
        span += step
    return h


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _prints(h: np.ndarray, level: int, window: int) -> np.ndarray:
    """For each window, the fingerprint by which it is looked up at a level: the least short window inside it."""
    short = windows(h, level) >> np.uint64(64 - BITS)
    return least_of_runs(short, window - level + 1).astype(np.int64)


def _edges(values: np.ndarray, owners: int, bits: int) -> np.ndarray:
    return np.searchsorted(values, np.array([min((o << bits) // owners, (1 << bits) - 1) + (o == owners) for o in range(owners + 1)], np.uint64).astype(np.int64))


def _messages(chunk: int, prints: list[np.ndarray], owners: int) -> pd.DataFrame:
    """What a chunk sends: for each owner its sorted fingerprints, and which of them several of its documents have."""
    each = [np.unique(p) for p in prints]
    values, counts = np.unique(np.concatenate([np.empty(0, np.int64), *each]), return_counts=True)
    edges = _edges(values, owners, BITS)
    rows = [(o, chunk, int(b - a), *rice_encode(values[a:b]), _bitmap(counts[a:b] > 1)) for o, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
    return pd.DataFrame(rows, columns=["owner", "sender", "n", "base", "k", "unary", "rest", "twice"])


def _suspects(answers: pd.DataFrame) -> np.ndarray:
    got = [rice_decode(*m)[_flags(b, m[0])] for *m, b in answers[["n", "base", "k", "unary", "rest", "bitmap"]].itertuples(index=False)]
    return np.sort(np.concatenate([np.empty(0, np.int64), *got]))


def _tried(told: pd.DataFrame) -> list[tuple[int, np.ndarray]]:
    return [(int(level), _suspects(own)) for level, own in told.groupby("level")] if len(told) else []


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _alive(h: np.ndarray, tried: list[tuple[int, np.ndarray]], window: int) -> np.ndarray:
    """Which windows are suspects at all levels so far (none if a level has no answer for this chunk)."""
    ok = np.ones(len(h) - window + 1, bool)
    for level, ordered in tried:
        ok &= _among(_prints(h, level, window), ordered)
    return ok


def _level(level: int, window: int, owners: int):
    """What a chunk sends at a level: the short windows of those windows that earlier levels have left."""

    def send(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        hashes, seen, tried = WordHashes(), {}, _tried(told)
        for body in docs["body"]:
            if body not in seen and len(h := hashes.of(_words(body))) >= window:
                seen[body] = _prints(h, level, window)[_alive(h, tried, window)]
        return _messages(int(docs["chunk"].iloc[0]) if len(docs) else -1, list(seen.values()), owners)

    return send


def _zip(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unzip(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()


def _full(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of each window."""
    return (windows(h, window) >> np.uint64(64 - FULL_BITS)).astype(np.int64), (windows(mix(h + M2), window, 1) >> np.uint64(64 - MORE_BITS)).astype(np.uint32)


def _least(values: np.ndarray, more: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of values, then more, then ids; and which places in it are the first of their value and more."""
    order = np.lexsort((ids, more, values))
    values, more = values[order], more[order]
    return order, np.concatenate([[True], (values[1:] != values[:-1]) | (more[1:] != more[:-1])])[: len(order)]


def _last_level(window: int, owners: int):
    """Windows at full length that all levels have left: fingerprints, and the smallest id of the chunk's documents that have each."""

    def send(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        hashes, tried, prints, more, ids = WordHashes(), _tried(told), [np.empty(0, np.int64)], [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for doc_id, body in docs[["doc_id", "body"]].itertuples(index=False):
            if len(h := hashes.of(_words(body))) >= window and (ok := _alive(h, tried, window)).any():
                one, two = _full(h, window)
                prints.append(one[ok])
                more.append(two[ok])
                ids.append(np.full(len(prints[-1]), doc_id, np.int64))
        values, more, least = np.concatenate(prints), np.concatenate(more), np.concatenate(ids)
        order, first = _least(values, more, least)
        values, more, least = (x[order[first]] for x in (values, more, least))
        edges, rows = _edges(values, owners, FULL_BITS), []
        for o, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if b > a:
                rows.append((o, int(docs["chunk"].iloc[0]), int(b - a), *rice_encode(values[a:b]), more[a:b].tobytes(), _zip(least[a:b])))
        return pd.DataFrame(rows, columns=["owner", "sender", "n", "base", "k", "unary", "rest", "more", "least"])

    return send


def _settle(messages: pd.DataFrame) -> pd.DataFrame:
    """Answers each message with the smallest id of all, window by window."""
    sent = [rice_decode(*m) for m in messages[["n", "base", "k", "unary", "rest"]].itertuples(index=False)]
    values, more, ids = np.concatenate(sent), np.concatenate([np.frombuffer(b, np.uint32) for b in messages["more"]]), np.concatenate([_unzip(b) for b in messages["least"]])
    order, first = _least(values, more, ids)
    least = np.empty(len(ids), np.int64)
    least[order] = ids[order[first]][np.cumsum(first) - 1]
    ends = np.cumsum([len(v) for v in sent])
    return pd.DataFrame({"owner": messages["owner"], "sender": messages["sender"], "answer": [_zip(x) for x in np.split(least, ends[:-1])]})


def _cut(window: int):
    def cut(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        hashes, rows = WordHashes(), []
        parts = [(rice_decode(*x), np.frombuffer(m, np.uint32), _unzip(b)) for *x, m, b in told[["n", "base", "k", "unary", "rest", "more", "answer"]].itertuples(index=False)]
        known, more, least = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3
        order = np.argsort(known)
        known, more, least = known[order], more[order], least[order]
        twins = int(np.diff(np.flatnonzero(np.concatenate([[True], known[1:] != known[:-1], [True]]))).max()) if len(known) else 0
        for doc_id, no_id, body, copy in docs[["doc_id", "no_id", "body", "copy"]].itertuples(index=False):
            words = _words(body)
            gone = np.zeros(len(words), bool)
            if len(words) >= window and copy:
                gone[:] = True
            elif len(words) >= window and len(known):
                one, two = _full(hashes.of(words), window)
                first, found = np.searchsorted(known, one), np.zeros(len(one), bool)
                for step in range(twins):  # windows that share the first hash stand side by side
                    at = np.minimum(first + step, len(known) - 1)
                    found |= (known[at] == one) & (more[at] == two) & (least[at] < doc_id)
                starts = np.flatnonzero(found)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
            rows.append((doc_id, no_id, len(words), int(gone.sum()), b" ".join(kept).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(rows, columns=["doc_id", "no_id", "n_words", "n_removed", "kept"]).astype({"doc_id": docs["doc_id"].dtype, "no_id": bool})

    return cut


def substring_dedup(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for every row of docs.

    Words are runs of other bytes than ASCII white space. A word is removed if a window of `window` consecutive words covers it whose words
    also start in a document with a smaller id. Windows are judged on the input. Hashes of 94 bits stand for windows.

    Whole copies are settled first: of equal texts all but the one with the smallest id lose every word (if they have
    a window at all), and take no further part. Null text has no words. A null id is below every other and its row loses nothing.
    Rows that repeat an id are one document for the rule: none makes another lose words. An empty table gives an empty result. Other columns play no part.

    The result is read from tables in the shared folder, which go when the driver ends.
    """
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col(doc_id).isNull().alias("no_id"), text_of(text).alias("body"))
    n_bytes = slim.agg(F.sum(F.octet_length("body") + 64)).head()[0] or 0
    chunks = max(1, -(-n_bytes // CHUNK_BYTES))
    same = [F.xxhash64("body"), F.xxhash64(F.lit(1), "body")]
    keyed = slim.select("doc_id", same[0].alias("t1"), same[1].alias("t2"))
    first = keyed.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("t1", "t2", "first")
    first = materialise(first, "copies")  # else its partitioning would bind the join, and a hot group couldn't be split
    copies = keyed.join(first, ["t1", "t2"]).filter("doc_id > first").select("doc_id", "t1", F.lit(True).alias("copy")).distinct()
    marked = slim.withColumn("t1", same[0]).join(copies, ["doc_id", "t1"], "left").select("doc_id", "no_id", "body", F.coalesce("copy", F.lit(False)).alias("copy"))
    marked = marked.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "body"), F.lit(chunks)).cast("int"))  # rows that share an id, or have none, are spread

    # Bucketed by chunk: what is sent to a chunk later meets its texts without another shuffle of them.
    name = f"riskweave_{uuid.uuid4().hex}"
    buckets = max(1, min(chunks, width(spark) * 4))
    (marked.repartition(buckets, "chunk").write.format("parquet").bucketBy(buckets, "chunk").sortBy("chunk")
     .option("path", f"{shared_dir(spark).rstrip('/')}/{name}").saveAsTable(name))
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and what reads them knows how they are dealt out
    remove_at_end(spark, f"{shared_dir(spark).rstrip('/')}/{name}")

    owners, kinds = max(width(spark), n_bytes // OWNED_BYTES), "owner int, sender int, n int, base long, k int, unary binary, rest binary, twice binary"
    reps, told = table.filter("not copy"), spark.createDataFrame([], "chunk int, n int, base long, k int, unary binary, rest binary, bitmap binary, level int")
    for level in levels(window)[:-1] or [window]:
        messages = materialise(reps.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(_level(level, window, owners), kinds), "seeds")
        answers = messages.groupBy("owner").applyInPandas(_judge, "owner int, sender int, bitmap binary")
        heard = messages.join(answers, ["owner", "sender"]).select(F.col("sender").alias("chunk"), "n", "base", "k", "unary", "rest", "bitmap", F.lit(level).alias("level"))
        told = told.unionByName(materialise(heard, "told"))
        discard(messages)
    kinds = "owner int, sender int, n int, base long, k int, unary binary, rest binary, more binary, least binary"
    messages = materialise(reps.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(_last_level(window, owners), kinds), "windows")
    answers = messages.groupBy("owner").applyInPandas(_settle, "owner int, sender int, answer binary")
    replies = messages.join(answers, ["owner", "sender"]).select(F.col("sender").alias("chunk"), "n", "base", "k", "unary", "rest", "more", "answer")
    done = table.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(_cut(window), "doc_id long, no_id boolean, n_words long, n_removed long, kept string")
    return done.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", "kept")
