"""Near-duplicate documents by min-max hashing.

Each hash function gives two values of a set, its minimum and its maximum, so 64 evaluations make a signature of 128.
Bands of four values nominate candidates; every link is confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, M2, WordHashes, discard, materialise, mix, scratch, text_of, windows

HASHES, ROWS = 64, 4
BANDS = 2 * HASHES // ROWS
#: Multiplier and offset of each hash function, by a rule.
_A = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * M1) | np.uint64(1)
_B = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * M2)
#: Of 128 one-byte values that agree, so many at least in a pair of the last round; at a similarity of 0.8 fewer have a chance of 1e-8.
LEAST_AGREE = 76
#: Rounds with hubs drawn by hash after the first; members of a block in the last round.
HUB_TURNS, BLOCK = 1, 1024
#: Counters of shingles in the last round, at most (a power of two), and how many classes of size a doubling has.
MOST_COUNTERS, SIZES = 24, 36


def shingles(words: WordHashes, text: str, n: int) -> np.ndarray:
    """The sorted distinct hashes of n-word shingles; a shorter text is one shingle; no words, none."""
    h = words.of(text.encode("utf-8", "surrogatepass").lower().split())
    if len(h) == 0:
        return h
    return np.unique(windows(h, n) if len(h) >= n else windows(h, len(h), seed=len(h)))


def signature(s: np.ndarray) -> np.ndarray:
    """The minimum, then the maximum of the set under each hash function."""
    low, high = np.full(HASHES, np.iinfo(np.uint64).max), np.zeros(HASHES, np.uint64)
    for i in range(0, len(s), 2048):
        x = s[i : i + 2048, None] * _A
        x += _B
        x ^= x >> np.uint64(29)
        low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One key for each band. A band has minima and maxima of its own functions only, so bands are independent."""
    rows = mix(sig * M1).reshape(2, HASHES)
    rows = np.concatenate([rows[0].reshape(-1, ROWS), rows[1].reshape(-1, ROWS)])
    return windows_of_rows(rows) + np.arange(BANDS, dtype=np.uint64)


def windows_of_rows(rows: np.ndarray) -> np.ndarray:
    out = np.full(len(rows), M2, np.uint64)
    for j in range(rows.shape[1]):
        out = out * M1 + rows[:, j]
    return mix(out)


def _sign(n: int):
    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for frame in frames:
            rows = []
            for doc_id, body in frame[["doc_id", "body"]].itertuples(index=False):
                s = shingles(words, body, n)
                if len(s) == 0:
                    rows.append((doc_id, 0, None, None, None, None))
                    continue
                sig = signature(s)
                key = np.array([np.bitwise_xor.reduce(mix(s * M2)), s.sum(dtype=np.uint64)], np.uint64).view(np.int64)
                rows.append((doc_id, len(s), key[0], key[1], band_keys(sig).view(np.int64), mix(sig * M1).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "s1", "s2", "bands", "digest"]).astype({"doc_id": frame["doc_id"].dtype, "s1": "Int64", "s2": "Int64"})

    return sign


def _sets(n: int):
    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for frame in frames:
            yield pd.DataFrame({"id": frame["doc_id"], "members": [shingles(words, body, n).tobytes() for body in frame["body"]]})

    return sets


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _confirm(percent: int):
    def confirm(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept = []
            for a, b, x, y in frame[["a", "b", "x", "y"]].itertuples(index=False):
                if similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent):
                    kept.append((a, b))
            yield pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    return confirm


def _counted(bits: int):
    """slot, n: how many shingles of the sets fall into each counter."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            every = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in frame["members"])])
            slot, n = np.unique((every * M2) >> np.uint64(64 - bits), return_counts=True)
            yield pd.DataFrame({"slot": slot.astype(np.int32), "n": n})

    return count


def _size_class(n) -> np.ndarray:
    return np.floor(np.log2(np.asarray(n, float)) * SIZES).astype(np.int64)


def prefix_keys(tokens: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a set can be asked for, and keys under which it asks for others no larger than itself.

    Shingles are taken by how often they are, the rarest first. If two sets are similar and a shingle is the first that they share,
    both have enough left from there on; so the larger asks by that shingle and the smaller's class of size, and the smaller is there.
    """
    slot = ((tokens * M2) >> np.uint64(64 - int(len(often)).bit_length() + 1)).astype(np.intp)
    n, size = often[slot], len(tokens)
    order = np.lexsort((tokens, n))
    shared = n[order] > 1
    largest = (size - np.arange(size)) * (100 + percent) // percent - size  # the largest partner if this is the first shared one
    least = -(-percent * size // 100)
    base = mix(tokens[order] * M1)
    key = lambda at, c: mix(base[at] + c.astype(np.uint64) * M2).view(np.int64)
    there = np.flatnonzero(shared & (largest >= size))
    asks = np.flatnonzero(shared & (largest >= least))
    low, high = int(_size_class(max(1, least))), _size_class(np.minimum(size, np.maximum(1, largest[asks])))
    n_classes = high - low + 1
    classes = low + np.arange(int(n_classes.sum())) - np.repeat(np.cumsum(n_classes) - n_classes, n_classes)
    return key(there, np.full(len(there), _size_class(size))), key(np.repeat(asks, n_classes), classes)


def _keyed(often, percent: int):
    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rep, comp, x in frame[["rep", "comp", "members"]].itertuples(index=False):
                there, asks = prefix_keys(np.frombuffer(x, np.uint64), often.value, percent)
                if len(there) + len(asks):
                    yield pd.DataFrame({"rep": rep, "comp": comp, "key": np.concatenate([there, asks]), "asks": np.arange(len(there) + len(asks)) >= len(there)})

    return keyed


def _resolve(percent: int):
    """Links between a block's members and its visitors: pairs of which one asks for the other and that aren't connected yet."""

    def resolve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rep", "visits"], ignore_index=True)
        reps, comps, visits = rows["rep"].tolist(), rows["comp"].tolist(), rows["visits"].to_numpy(bool)
        digests = np.frombuffer(b"".join(rows["digest"]), np.uint8).reshape(len(rows), -1)
        sets, found = [np.frombuffer(x, np.uint64) for x in rows["members"]], []
        above, visitors = {c: c for c in comps}, {}

        def top(c: int) -> int:
            while above[c] != c:
                above[c] = c = above[above[c]]
            return c

        for j in np.flatnonzero(visits).tolist():
            for side in ("there", "asks"):
                for k in rows[side][j]:
                    visitors.setdefault((side, k), []).append(j)
        for i in np.flatnonzero(~visits).tolist():
            others = np.array(sorted({j for a, b in (("there", "asks"), ("asks", "there")) for k in rows[a][i] for j in visitors.get((b, k), ())}), np.int64)
            others = others[(digests[others] == digests[i]).sum(1) >= LEAST_AGREE] if len(others) else others
            for j in others.tolist():
                if (a := top(comps[i])) != (b := top(comps[j])) and similar(sets[i], sets[j], percent):
                    above[max(a, b)] = min(a, b)
                    found.append((min(reps[i], reps[j]), max(reps[i], reps[j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return resolve


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the full sets of a and b confirm. A hub's set meets each partner's once."""
    met = pairs.join(sets.selectExpr("id as b", "members as y"), "b").join(sets.selectExpr("id as a", "members as x"), "a")
    return materialise(met.select("a", "b", "x", "y").mapInPandas(_confirm(percent), "a long, b long").distinct(), "near-links")


def components(links: DataFrame) -> DataFrame:
    """id, comp: the smallest id reachable over the links (a, b).

    First every link hangs its larger end on that end's smallest partner, which leaves few links where many members share
    hubs; then the least label is passed on along links and by jumps until nothing changes.
    """
    hung = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for _ in range(2):
        least = hung.groupBy("b").agg(F.min("a").alias("m"))
        over = hung.join(least, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        hung = materialise(least.select(F.col("m").alias("a"), "b").unionByName(over).distinct(), "hung")
    both = materialise(hung.selectExpr("a as u", "b as v").unionByName(hung.selectExpr("b as u", "a as v")).distinct(), "edges")
    labels = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("comp")).withColumnRenamed("u", "id"), "labels")
    before = labels
    while True:
        heard = both.join(labels.withColumnRenamed("id", "u"), "u").groupBy("v").agg(F.min("comp").alias("heard")).withColumnRenamed("v", "id")
        told = labels.join(heard, "id").select("id", F.col("comp").alias("was"), F.least("comp", "heard").alias("comp"))
        jump = labels.selectExpr("id as comp", "comp as further")
        moved = told.join(jump, "comp", "left").select("id", "was", F.least("comp", "further").alias("comp"))
        moved = materialise(moved, "labels")
        discard(before)
        before, labels = moved, moved.select("id", "comp")
        if moved.filter("was <> comp").isEmpty():
            return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, comp) after new links, whose ends all have a label: only components that links join are worked on."""
    over = links.join(labels.selectExpr("id as a", "comp as ca"), "a").join(labels.selectExpr("id as b", "comp as cb"), "b")
    joined = components(over.filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    moved = labels.join(joined.selectExpr("id as comp", "comp as now"), "comp", "left")
    return materialise(moved.select("id", F.coalesce("now", "comp").alias("comp")), "labels")


def _last_links(left: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the members (rep, comp) of torn buckets that aren't connected yet, exactly.

    Members are compared only under a rare shingle that both begin with and sizes that allow enough to be shared (prefix_keys), so
    members that merely have a frame in common meet nobody. Those that touch under such keys form a group; a missing link
    has an end outside the group's largest component, so members outside it visit every block of all members.
    """
    spark = left.sparkSession
    torn = materialise(left.select("rep", "comp").distinct().join(sets.withColumnRenamed("id", "rep"), "rep"), "near-rest")
    shingles_in_all = torn.agg(F.sum(F.octet_length("members") / 8)).head()[0] or 1
    bits = int(min(MOST_COUNTERS, max(10, math.ceil(math.log2(4 * shingles_in_all)))))
    often = np.ones(1 << bits, np.uint8)  # one byte for each counter: up to 16 MB
    counted = torn.mapInPandas(_counted(bits), "slot int, n long").groupBy("slot").agg(F.least(F.sum("n"), F.lit(255)).cast("short").alias("n")).filter("n > 1")
    for batch in counted.toArrow().to_batches():
        often[batch["slot"].to_numpy()] = batch["n"].to_numpy()
    keyed = materialise(torn.mapInPandas(_keyed(spark.sparkContext.broadcast(often), percent), "rep long, comp long, key long, asks boolean"), "near-keys")
    meets = keyed.groupBy("key").agg(F.min("rep").alias("head"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("asks").alias("asked"), F.min("asks").alias("only"))
    meets = materialise(meets.filter("low < high and asked and not only").select("key", "head"), "near-meets")
    alive = materialise(keyed.join(meets, "key"), "near-alive")
    groups = components(alive.select(F.col("head").alias("a"), F.col("rep").alias("b")).filter("a < b").distinct()).withColumnRenamed("comp", "grp")
    keys_of = lambda asks: F.collect_list(F.when(F.col("asks") == asks, F.col("key")))
    members = alive.groupBy("rep", "comp").agg(keys_of(False).alias("there"), keys_of(True).alias("asks")).join(groups.withColumnRenamed("id", "rep"), "rep")
    members = materialise(members, "near-members")
    sizes = members.groupBy("grp", "comp").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("comp", F.struct("n", "comp")).alias("big"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("few"))
    known = members.join(sizes, "grp").withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("sets", F.ceil(F.col("few") / BLOCK))
    here = F.pmod(F.xxhash64("rep"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("sets") - 1))
    there = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("sets"))
    side = lambda rows, at, visits: rows.select("grp", "rep", "comp", "there", "asks", at[0].alias("i"), at[1].alias("j"), F.lit(visits).alias("visits"))
    dealt = side(known, here, False).unionByName(side(known.filter("comp <> big"), there, True))
    full = dealt.join(classes.select("rep", "digest"), "rep").join(sets.withColumnRenamed("id", "rep"), "rep")
    return materialise(full.groupBy("grp", "i", "j").applyInPandas(_resolve(percent), "a long, b long").distinct(), "near-links")


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    A document's set has its distinct shingles of `words` words (runs of other bytes than ASCII white space, A-Z lowered);
    with fewer words, all of them as one. Documents whose sets agree by percent/100 (intersection by union) are linked;
    component_id is the smallest id reachable. kept: it is the row's own id.

    Equal sets are one class, which takes part once. In each bucket of a band all classes are held against the smallest
    one, not against each other; where a bucket then spans several components, against a hub drawn by hash; and only
    what still isn't connected is compared across components, under rare shingles that both begin with and sizes that
    allow the link, after a look at one-byte signatures. So a large group of near copies, or of documents with a common frame, costs a
    few comparisons for each member. No link between components is lost but by chance: one of a similarity of 0.8 shares no band
    with a chance of 5e-8, and fails the look at signatures with one of 1e-8; more similar ones with far less.
    Null text, or one without words, has an empty set and no links. Null ids keep a null component and aren't kept. Rows that repeat an
    id are one node. An empty table gives an empty result. Other columns play no part.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body"))
    with scratch(docs.sparkSession):
        return _near_dedup(slim, words, percent)


def _near_dedup(slim: DataFrame, words: int, percent: int) -> DataFrame:
    signed = materialise(slim.mapInPandas(_sign(words), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, digest binary"), "near-signed")
    some = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "digest"), "doc_id").alias("of"))
    classes = materialise(classes.select("s1", "s2", "rep", "of.*"), "near-classes")

    rows = classes.select("rep", F.explode("bands").alias("key"))
    hubs = rows.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last").select("key", "hub")
    hubs = materialise(hubs, "near-hubs")  # else its partitioning would bind the join, and a hot bucket couldn't be split
    shared = materialise(rows.join(hubs, "key"), "near-buckets")
    ids = shared.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialise(slim.join(ids, "doc_id", "left_semi").mapInPandas(_sets(words), "id long, members binary"), "near-sets")
    links = _linked(shared.filter("hub < rep").selectExpr("hub as a", "rep as b").distinct(), sets, percent)
    found = components(links)
    every = shared.select(F.col("rep").alias("id")).distinct()
    labels = materialise(every.join(found, "id", "left").select("id", F.coalesce("comp", "id").alias("comp")), "labels")
    rows = shared.select("key", "rep")
    for turn in range(HUB_TURNS + 1):
        placed = rows.join(labels.withColumnRenamed("id", "rep"), "rep")
        torn = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min_by(F.struct("rep", "comp"), F.xxhash64("rep", F.lit(turn))).alias("hub"))
        torn = materialise(torn.filter("low < high").select("key", "hub"), "near-torn-keys")
        left = materialise(placed.join(torn, "key"), "near-torn")
        if left.isEmpty():
            break
        rows = left.select("key", "rep")  # a bucket that is whole stays so
        if turn < HUB_TURNS:
            pairs = left.filter("comp <> hub.comp").select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()
            more = _linked(pairs, sets, percent)
        else:
            more = _last_links(left, classes, sets, percent)
        if not more.isEmpty():
            labels = _merged(labels, more)

    out = signed.join(classes.select("s1", "s2", "rep"), ["s1", "s2"], "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.coalesce("comp", "rep", "doc_id")
    return materialise(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")), "near-found", keep=True)
