"""Packing by non-negative least squares over shallow length combinations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of

WINDOW = 1024
#: Remainders planned together, and triples enumerated for each length.
PLAN_DOCS, TRIPLES = 2048, 6
END = 0


def tokenizer(path: str | None = None, added: str | None = None):
    """The byte-level vocabulary as ranks, with the added tokens of its JSON form; by default the installed public files."""
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(added or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as form:
        special = {t["content"]: t["id"] for t in json.load(form)["added_tokens"]}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


_TOKENIZERS: dict = {}


def encoder(path: str | None = None, added: str | None = None):
    """text -> ids; one tokenizer for each worker process and vocabulary. An added token's text in a document is that token."""
    if (path, added) not in _TOKENIZERS:
        _TOKENIZERS[path, added] = tokenizer(path, added)
    own = _TOKENIZERS[path, added]
    special, plain = tuple(own.special_tokens_set), own.encode_ordinary
    return lambda text: own.encode(text, allowed_special="all") if any(s in text for s in special) else plain(text)


def _width(path: str | None, added: str | None) -> str:
    """Bytes of an id between tasks: two where the vocabulary fits."""
    encoder(path, added)
    return "<u2" if _TOKENIZERS[path, added].n_vocab <= 1 << 16 else "<u4"


def _encode(path: str | None, added: str | None, window: int):
    """Each document as its whole windows and what is left over (marked whole = false, one for each document that has any)."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to_ids, kind = encoder(path, added), _width(path, added)
        for frame in frames:
            rows = []
            for doc_id, body in frame[["doc_id", "body"]].itertuples(index=False):
                ids = np.array([*to_ids(body), END], kind)
                whole = len(ids) // window * window
                rows += [(doc_id, at, ids[at : at + window].astype("<u4").tobytes(), len(ids), True) for at in range(0, whole, window)]
                if whole < len(ids):
                    rows.append((doc_id, whole, ids[whole:].tobytes(), len(ids), False))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "ids", "doc_tokens", "whole"]).astype({"doc_id": frame["doc_id"].dtype, "whole": bool, "start": "int64", "doc_tokens": "int64"})

    return encode


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """Pairs and, for each length, a few triples of present lengths that fill the window; (n, 3), 0 for no member."""
    have = np.zeros(window + 1, bool)
    have[present] = True
    a = present[present * 2 <= window]
    pairs = np.stack([np.zeros_like(a), a, window - a], 1)
    tried = [pairs]
    for t in range(TRIPLES):
        b = 1 + (present * 37 + t * 149) % max(1, window // 2)
        c = window - present - b
        tried.append(np.sort(np.stack([present, b, c], 1)[c > 0], 1))
    found = np.unique(np.concatenate(tried), axis=0)
    return found[np.all(have[found] | (found == 0), axis=1)]


def solve_counts(combos: np.ndarray, histogram: np.ndarray, steps: int = 60) -> np.ndarray:
    """x >= 0 that brings (uses of each length) x close to the histogram, by multiplicative least-squares updates."""
    member = combos > 0
    up = lambda v: np.where(member, v[combos], 0).sum(1)
    x, target = np.ones(len(combos)), up(histogram.astype(float))
    for _ in range(steps):
        used = np.bincount(combos.ravel(), weights=np.repeat(x, 3) * member.ravel(), minlength=len(histogram))
        x *= target / np.maximum(up(used), 1e-9)
    return x


def plan(lengths: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) that use every item of 1 to window - 1 ids whole, cutting where nothing fits."""
    stacks: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]
    for item in np.argsort(lengths, kind="stable")[::-1]:
        if lengths[item]:
            stacks[lengths[item]].append((int(item), 0))
    sequences = []
    histogram = np.bincount(lengths[lengths > 0], minlength=window + 1)
    if len(present := np.flatnonzero(histogram)) and len(combos := combinations(present, window)):
        x = solve_counts(combos, histogram)
        for k in np.argsort(-x, kind="stable"):
            if (times := int(x[k] + 0.5)) == 0:
                break
            members = [int(m) for m in combos[k] if m]
            need = {m: members.count(m) for m in members}
            for _ in range(min(times, *(len(stacks[m]) // n for m, n in need.items()))):
                sequences.append([(*stacks[m].pop(), m) for m in members])
    mask = sum(1 << n for n, s in enumerate(stacks) if s)
    while mask:
        gap, sequence = window, []
        while gap and mask:
            fits = mask & ((1 << (gap + 1)) - 1)
            n = fits.bit_length() - 1 if fits else (mask >> (gap + 1) & -(mask >> (gap + 1))).bit_length() + gap
            item, start = stacks[n].pop()
            if not stacks[n]:
                mask &= ~(1 << n)
            taken = min(n, gap)
            sequence.append((item, start, taken))
            if n > gap:
                stacks[n - gap].append((item, start + gap))
                mask |= 1 << (n - gap)
            gap -= taken
        sequences.append(sequence)
    return sequences


def _place(kind: str, window: int):
    def place(rest: pd.DataFrame) -> pd.DataFrame:
        rest = rest.assign(size=rest["ids"].map(len)).sort_values(["size", "row"], ignore_index=True)
        ids, starts, totals = rest["doc_id"].tolist(), rest["start"].tolist(), rest["doc_tokens"].tolist()
        parts, rows, first = [np.frombuffer(t, kind).astype("<u4") for t in rest["ids"]], [], int(rest["plan"].iloc[0]) << 32
        for nth, sequence in enumerate(plan(np.array([len(x) for x in parts], np.int64), window)):
            offset = 0
            for item, start, n in sequence:
                rows.append((ids[item], starts[item] + start, n, parts[item][start : start + n].tobytes(), totals[item], first + nth, offset))
                offset += n
        return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]).astype({"doc_id": rest["doc_id"].dtype})

    return place


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, added: str | None = None, doc_id: str = "doc_id", text: str = "text", plan_docs: int = PLAN_DOCS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian, four bytes each), doc_tokens, sequence_id, offset.

    A document is the ids of its text and an end id; the text of an added token (of the JSON form `added`) is that token.
    Whole windows of a document are sequences of their own, wherever they were made (negative sequence ids). What is left
    over, under one window, is planned with some thousands of others: combinations of two or three lengths that fill the
    window get repeat counts by non-negative least squares against the histogram of lengths, counts are rounded, and
    the residue is packed greedily by best fit, cutting a piece only where none fits. At most the last sequence of a
    plan isn't full. Remainders are dealt to plans by their place in the written table, so that a plan holds about
    plan_docs * window ids at most, whatever ids or texts repeat.

    Null text is empty: one end id. Null ids are kept as null. Repeated rows are packed as often as they occur. An empty
    table gives an empty result. Other columns play no part.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body"))
    kinds = "doc_id long, start long, ids binary, doc_tokens long, whole boolean"
    encoded = materialise(slim.mapInPandas(_encode(vocabulary, added, window), kinds), "pack-ids").withColumn("row", F.monotonically_increasing_id())
    rest = encoded.filter("not whole")
    plans = max(1, -(-rest.count() // plan_docs))
    dealt = rest.withColumn("plan", F.pmod(F.xxhash64("row"), F.lit(plans)))
    pieces = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    planned = dealt.groupBy("plan").applyInPandas(_place(_width(vocabulary, added), window), pieces)
    alone = encoded.filter("whole").select("doc_id", "start", F.lit(window).cast("long").alias("length"), "ids", "doc_tokens", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return planned.unionByName(alone)
