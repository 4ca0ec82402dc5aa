"""Exact dedup by a Golomb-coded exchange of fingerprints.

Every input partition sorts the fingerprints of its texts and sends each owner (a slice of the hash range) one
compressed message. An owner decodes its messages and answers each with a bitmap: which of the sender's fingerprints
turned up more than once. Texts behind those are suspects; only they are shuffled, and grouped by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, scratch, text_of, width

#: Bits of a fingerprint. Too few only make more suspects; bytes decide.
BITS = 48
#: Fingerprints that an owner judges, about.
OWNED = 4_000_000
#: Suspect fingerprints up to this count (8 bytes each) are broadcast; beyond it the semi-join shuffles.
BROADCAST_ROWS = 500_000


def rice_encode(values: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """Golomb code with a power of two as divisor: (first value, k, unary plane, remainder plane) of sorted distinct integers.

    Gaps are counted from the first value: where an owner's slice begins has no part in the divisor.
    """
    base = int(values[0]) if len(values) else 0
    gaps = np.diff(values, prepend=base).astype(np.uint64)
    k = max(0, int(np.log2(max(1.0, float(gaps.mean() * 0.69))))) if len(gaps) else 0
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return base, k, np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes()


def rice_decode(n: int, base: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * k).reshape(n, k) if k else np.zeros((n, 0), np.uint8)
    remainders = bits.astype(np.int64) @ (np.int64(1) << np.arange(k - 1, -1, -1, dtype=np.int64))
    return base + np.cumsum((quotients << k) + remainders)


def _bitmap(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(np.uint8)).tobytes()


def _flags(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n).astype(bool)


def fingerprint(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - BITS)


def _sender(owners: int):
    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [f["fp"].to_numpy(np.int64) for f in frames]
        values, counts = np.unique(np.concatenate(seen) if seen else np.empty(0, np.int64), return_counts=True)
        edges = np.searchsorted(values, [(o << BITS) // owners for o in range(owners + 1)])
        me, rows = TaskContext.get().partitionId(), []
        for o, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if b > a:
                rows.append((o, me, int(b - a), *rice_encode(values[a:b]), _bitmap(counts[a:b] > 1)))
        if rows:
            yield pd.DataFrame(rows, columns=["owner", "sender", "n", "base", "k", "unary", "rest", "twice"])

    return send


def _judge(messages: pd.DataFrame) -> pd.DataFrame:
    sent = [rice_decode(*m) for m in messages[["n", "base", "k", "unary", "rest"]].itertuples(index=False)]
    twice = np.concatenate([v[_flags(t, len(v))] for v, t in zip(sent, messages["twice"], strict=True)])
    values, counts = np.unique(np.concatenate(sent), return_counts=True)
    suspects = np.union1d(values[counts > 1], twice)
    return pd.DataFrame({"owner": messages["owner"], "sender": messages["sender"], "bitmap": [_bitmap(np.isin(v, suspects, assume_unique=True)) for v in sent]})


def _read_answers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for *m, b in f[["n", "base", "k", "unary", "rest", "bitmap"]].itertuples(index=False):
            yield pd.DataFrame({"fp": rice_decode(*m)[_flags(b, m[0])]})


def suspect_fingerprints(texts: DataFrame, owners: int | None = None) -> DataFrame:
    """fp: fingerprints (column fp of texts) that more than one row has."""
    owners = owners or max(width(texts.sparkSession), texts.count() // OWNED)
    kinds = "owner int, sender int, n int, base long, k int, unary binary, rest binary, twice binary"
    messages = materialise(texts.select("fp").mapInPandas(_sender(owners), kinds), "fingerprints")
    answers = messages.groupBy("owner").applyInPandas(_judge, "owner int, sender int, bitmap binary")
    found = materialise(messages.join(answers, ["owner", "sender"]).mapInPandas(_read_answers, "fp long").distinct(), "suspects")
    discard(messages)
    return found


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Rows with equal texts form a group; its row with the largest id stays. Null text counts as empty; empty texts are
    equal to each other. A null id is below every other; where all ids of a group are null, keep_id is null and
    kept is true. Rows that repeat an id and a text are reported each, all kept or none, and count each for group_size.
    An empty table gives an empty result. Other columns of docs play no part, whatever their names.
    """
    with scratch(docs.sparkSession):
        return materialise(_exact_dedup(docs, doc_id, text), "exact-found", keep=True)


def _exact_dedup(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    slim = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("body"))
    marked = slim.withColumn("fp", fingerprint(F.col("body")))
    suspects = suspect_fingerprints(marked)
    few = suspects.count() <= BROADCAST_ROWS
    shuffled = marked.join(F.broadcast(suspects) if few else suspects, "fp", "left_semi")
    groups = shuffled.groupBy("fp", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = groups.select(F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size", F.lit(True).alias("grouped"))
    groups = materialise(groups, "groups")  # of known size; else its partitioning would bind the join, and a hot group couldn't be split
    every = slim.select("doc_id", F.sha2("body", 256).alias("text_sha256"))
    keep = F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return (
        every.join(groups, "text_sha256", "left")
        .withColumn("keep_id", keep)
        .select("doc_id", "keep_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )
