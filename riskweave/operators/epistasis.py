"""Pairwise epistasis on bit planes.

Genotypes become bit planes: for each variant and each chunk of people of one phenotype, which of them carry one allele, two, or have no
call. Tiles of variants meet tiles of variants, chunk by chunk; a count of people is the number of bits that two planes share. So
people are never joined with themselves, and what moves is a bit for each person, not a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import count_if
from ..sources.shared import written

#: Bits of a plane, as bitmap_construct_agg makes them; people dealt to one chunk, on average; variants of a tile, on average.
BITS, PEOPLE, TILE = 32_768, 30_000, 512
#: Pairs in one batch of results.
ROWS = 8192
PHENOTYPES = (1, 2)


def chunks(people: DataFrame) -> DataFrame:
    """(iid, phenotype, chunk, bit): people of a phenotype dealt by a hash to chunks of a plane's size, and their places there."""
    from pyspark.sql import Window

    n = people.count()
    dealt = people.select("iid", "phenotype", F.pmod(F.xxhash64("iid"), F.lit(max(1, -(-n // PEOPLE)))).alias("lot"))
    place = F.row_number().over(Window.partitionBy("phenotype", "lot").orderBy("iid")) - 1
    placed = dealt.withColumn("place", place)
    return placed.select("iid", "phenotype", F.concat_ws("-", "lot", F.floor(F.col("place") / BITS)).alias("chunk"), (F.col("place") % BITS).cast("long").alias("bit"))


def planes(genotype: DataFrame, people: DataFrame, tiles: int) -> DataFrame:
    """(snp, tile, phenotype, chunk, one, two, none): who of a chunk carries one allele, two, or has no call, a bit for each person."""
    d = F.col("dosage")
    rows = genotype.filter(d.isNull() | (d > 0)).join(chunks(people), "iid")
    bits = lambda keep: F.bitmap_construct_agg(F.when(keep, F.col("bit")))
    packed = rows.groupBy("snp", "phenotype", "chunk").agg(bits(d == 1).alias("one"), bits(d >= 2).alias("two"), bits(d.isNull()).alias("none"), count_if(d.isNull()).alias("missing"))
    return packed.withColumn("tile", F.pmod(F.xxhash64("snp"), F.lit(tiles)).cast("int"))


class Tile:
    """Counts of one pair of tiles: people of each phenotype with each two of (one, two, none), and with each alone."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high
        self.at: tuple[dict, dict] = ({}, {})
        self.both = np.zeros((len(PHENOTYPES), 3, 3, 0, 0), np.int32)
        self.alone = [np.zeros((len(PHENOTYPES), 3, 0), np.int32) for _ in range(2)]

    def places(self, side: int, snps: list) -> list[int]:
        """Where the variants stand; new ones get places, arrays grow by doubling."""
        known = self.at[side]
        out = [known.setdefault(s, len(known)) for s in snps]
        have, need = self.alone[side].shape[2], len(known)
        if need > have:
            more = max(need, 2 * have) - have
            self.alone[side] = np.pad(self.alone[side], [(0, 0), (0, 0), (0, more)])
            self.both = np.pad(self.both, [(0, 0)] * 3 + [(0, more if side == k else 0) for k in range(2)])
        return out

    def add(self, phenotype: int, rows: list[tuple]) -> None:
        """rows: (tile, snp, planes) of one chunk of people."""
        p, held = PHENOTYPES.index(phenotype), []
        for side, tile in enumerate((self.low, self.high)):
            own = [r for r in rows if r[0] == tile]
            bits = np.frombuffer(b"".join(r[2] for r in own), np.uint64).reshape(len(own), 3, BITS // 64)
            held.append((self.places(side, [r[1] for r in own]), bits))
        for side, (at, bits) in enumerate(held):
            if at:
                self.alone[side][p][:, at] += np.bitwise_count(bits).sum(2, dtype=np.int32).T
        (a, x), (b, y) = held
        if not a or not b:
            return
        used = [[k for k in range(3) if z[:, k].any()] for z in (x, y)]
        for i, row in enumerate(a):
            for k in used[0]:
                if x[i, k].any():
                    for m in used[1]:
                        self.both[p, k, m, row, b] += np.bitwise_count(x[i, k] & y[:, m]).sum(1, dtype=np.int32)

    def packed(self) -> tuple:
        na, nb = len(self.at[0]), len(self.at[1])
        return (self.low, self.high, list(self.at[0]), list(self.at[1]), self.both[..., :na, :nb].tobytes(), self.alone[0][..., :na].tobytes(), self.alone[1][..., :nb].tobytes())

    def merge(self, a: list, b: list, both: bytes, alone_a: bytes, alone_b: bytes) -> None:
        x, y = (np.array(self.places(side, snps), np.int64) for side, snps in enumerate((a, b)))
        self.both[:, :, :, x[:, None], y] += np.frombuffer(both, np.int32).reshape(len(PHENOTYPES), 3, 3, len(a), len(b))
        for side, at, part in ((0, x, alone_a), (1, y, alone_b)):
            self.alone[side][:, :, at] += np.frombuffer(part, np.int32).reshape(len(PHENOTYPES), 3, len(at))

    def tables(self, totals: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(snp_a, snp_b, cells) of pairs a < b, some thousand at a time: all 18 cells, those without a carrier by subtraction."""
        a, b = (np.array(list(known), np.int64) for known in self.at)
        step = max(1, ROWS // max(1, len(b)))
        for at in range(0, len(a), step):
            c = self.both[..., at : at + step, : len(b)].astype(np.int64)
            one, two = (x.astype(np.int64) for x in (self.alone[0][..., at : at + step, None], self.alone[1][..., None, : len(b)]))
            cells = np.empty((len(PHENOTYPES), 3, 3, *c.shape[3:]), np.int64)
            cells[:, 1:, 1:] = c[:, :2, :2]
            cells[:, 1:, 0] = one[:, :2] - c[:, :2].sum(2)  # carriers at a, called and without an allele at b
            cells[:, 0, 1:] = two[:, :2] - c[:, :, :2].sum(1)
            called = totals[:, None, None] - one[:, 2] - two[:, 2] + c[:, 2, 2]
            cells[:, 0, 0] = called - cells.reshape(len(PHENOTYPES), 9, *c.shape[3:])[:, 1:].sum(1)
            left, right = np.broadcast_arrays(a[at : at + step, None], b[None])
            keep = left < right if self.low == self.high else np.ones(left.shape, bool)
            flip = left > right
            cells = np.where(flip, cells.swapaxes(1, 2), cells)
            yield np.where(flip, right, left)[keep], np.where(flip, left, right)[keep], cells.reshape(9 * len(PHENOTYPES), *left.shape)[:, keep].T


_PACKED = "low int, high int, a array<long>, b array<long>, both binary, alone_a binary, alone_b binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["low", "high", "a", "b", "both", "alone_a", "alone_b"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by pair of tiles, lot of chunks, phenotype and chunk; each pair and lot gives one row of counts."""
    tile, pair, chunk, rows = None, None, None, []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            low, high, lot, phenotype, name, number, snp, one, two, none = r
            if (pair, chunk) != ((low, high, lot), (phenotype, name)):
                if rows:
                    tile.add(chunk[0], rows)
                    rows = []
                if pair != (low, high, lot):
                    if tile:
                        yield _batch([tile.packed()])
                    tile = Tile(low, high)
                pair, chunk = (low, high, lot), (phenotype, name)
            rows.append((number, snp, one + two + none))
    if tile:
        tile.add(chunk[0], rows)
        yield _batch([tile.packed()])


def kirkwood(cells: np.ndarray) -> np.ndarray:
    """For tables (n, 18): twice the log-likelihood of the saturated model over Kirkwood's superposition, which has no three-way term.

    The best model without that term fits no worse, so the likelihood ratio of the interaction is at most this.
    """
    n = cells.reshape(-1, len(PHENOTYPES), 3, 3).astype(float)
    whole = n.sum((1, 2, 3), keepdims=True)
    ij, pi, pj = n.sum(1, keepdims=True), n.sum(3, keepdims=True), n.sum(2, keepdims=True)
    p, i, j = n.sum((2, 3), keepdims=True), n.sum((1, 3), keepdims=True), n.sum((1, 2), keepdims=True)
    under = i * j * p
    share = np.divide(ij * pi * pj, under, out=np.zeros_like(n), where=under > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        fitted = share / share.sum((1, 2, 3), keepdims=True) * whole
        return 2 * np.where(n > 0, n * np.log(n / fitted), 0.0).sum((1, 2, 3))


def likelihood_ratio(cells: np.ndarray, steps: int = 200) -> np.ndarray:
    """For tables (n, 18): the saturated log-linear model against that without the three-way term, fitted by iterative proportions."""
    n = cells.reshape(-1, len(PHENOTYPES), 3, 3).astype(float)
    m, left = np.ones_like(n), np.arange(len(n))
    for _ in range(steps):
        new, own = m[left], n[left]
        for axis in (1, 3, 2):
            have = new.sum(axis, keepdims=True)
            new = new * np.divide(own.sum(axis, keepdims=True), have, out=np.zeros_like(have), where=have > 0)
        moved = np.abs(new - m[left]).max((1, 2, 3)) > 1e-10 * np.maximum(1, own.sum((1, 2, 3)))
        m[left] = new
        left = left[moved]
        if not len(left):
            break
    ok = (n > 0) & (m > 0)
    return 2 * np.where(ok, n * np.log(np.where(ok, n, 1) / np.where(ok, m, 1)), 0.0).sum((1, 2, 3))


_TABLES = "snp_a long, snp_b long, cells array<long>, bound double"


def _finish(totals: np.ndarray, least: float | None):
    """Sums the counts of the lots of a pair of tiles, which come one after another, and gives the pairs' tables."""

    def done(tile: Tile) -> Iterator[pa.RecordBatch]:
        for a, b, cells in tile.tables(totals):
            bound = kirkwood(cells)
            keep = cells.reshape(-1, len(PHENOTYPES), 3, 3)[:, :, 1:, 1:].any((1, 2, 3))
            if least is not None:
                keep &= bound >= least
            cells = cells[keep]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, 18, dtype=np.int32)), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(a[keep].astype(np.int64)), pa.array(b[keep].astype(np.int64)), lists, pa.array(bound[keep])], ["snp_a", "snp_b", "cells", "bound"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for batch in batches:
            for low, high, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tile is None or (tile.low, tile.high) != (low, high):
                    if tile:
                        yield from done(tile)
                    tile = Tile(low, high)
                tile.merge(*parts)
        if tile:
            yield from done(tile)

    return finish


def tables(genotype: DataFrame, people: DataFrame, least: float | None = None) -> DataFrame:
    """(snp_a, snp_b, cells, bound), a < b: of all pairs with a common carrier, 18 counts by (phenotype, ga, gb) and Kirkwood's bound.

    genotype: (iid, snp, dosage), no row is dosage 0, a null dosage is no call: such a person isn't counted for pairs with that variant.
    people: (iid, phenotype 1 or 2), one row each; only they count. least: pairs whose bound is lower are left out where they are counted.

    A pair of tiles is one unit of work; where there are fewer such pairs than tasks, the chunks of people are dealt to lots, whose
    counts are summed. Memory: two tiles' planes of one chunk, and the counts of one pair of tiles.
    """
    spark = genotype.sparkSession
    own = people.select("iid", "phenotype").filter(F.col("phenotype").isin(*PHENOTYPES))
    counted = {r["phenotype"]: r["n"] for r in own.groupBy("phenotype").agg(F.count("*").alias("n")).collect()}
    totals = np.array([counted.get(p, 0) for p in PHENOTYPES], np.int64)
    tiles = max(1, -(-genotype.select("snp").distinct().count() // TILE))
    packed = written(planes(genotype, own, tiles).drop("missing"), "planes")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lots = max(1, -(-tasks // (tiles * (tiles + 1) // 2)))
    met = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    met = met.select(F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), F.pmod(F.xxhash64("phenotype", "chunk"), F.lit(lots)).cast("int").alias("lot"), "phenotype", "chunk", "tile", "snp", "one", "two", "none")
    keys = ["low", "high", "lot"]
    counts = met.repartition(tasks, *keys).sortWithinPartitions(*keys, "phenotype", "chunk", "tile", "snp").mapInArrow(_count, _PACKED)
    if lots > 1:
        counts = counts.repartition(tasks, "low", "high").sortWithinPartitions("low", "high")
    return counts.mapInArrow(_finish(totals, least), _TABLES)


def cells_of(found: DataFrame) -> DataFrame:
    """(snp_a, snp_b, phenotype, ga, gb, n) of tables, cells of nobody left out."""
    rows = found.select("snp_a", "snp_b", F.posexplode("cells").alias("at", "n")).filter("n > 0")
    place = F.col("at").cast("long")
    return rows.select("snp_a", "snp_b", (F.floor(place / 9) + 1).cast("int").alias("phenotype"), (F.floor(place / 3) % 3).alias("ga"), (place % 3).alias("gb"), "n")


def carriers_of(found: DataFrame) -> DataFrame:
    """The cells of people who carry both."""
    return cells_of(found).filter("ga > 0 and gb > 0")


def chi2_4_tail(x: Column) -> Column:
    """Upper tail of chi-square with four degrees of freedom, in closed form."""
    x = F.greatest(x, F.lit(0.0))
    return F.exp(-x / 2) * (1 + x / 2)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = batch.column("cells").flatten().to_numpy(zero_copy_only=False).reshape(-1, 18)
        fitted = likelihood_ratio(cells) if len(cells) else np.empty(0)
        yield pa.RecordBatch.from_arrays([batch.column("snp_a"), batch.column("snp_b"), batch.column("bound"), pa.array(fitted)], ["snp_a", "snp_b", "bound", "chisq"])


def boost(found: DataFrame) -> DataFrame:
    """(snp_a, snp_b, bound, chisq, p) of pairwise interaction, four degrees of freedom, from tables. All tables of a batch are fitted at once."""
    return found.mapInArrow(_fit, "snp_a long, snp_b long, bound double, chisq double").withColumn("p", chi2_4_tail(F.col("chisq")))
