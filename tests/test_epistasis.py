"""Pairwise epistasis on bit planes against plain counts and a plain fit."""

import math
from collections import Counter
from itertools import combinations, product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.operators import epistasis


def plain_fit(cells):
    """The model without the three-way term by iterative proportions, one table in nested loops."""
    n = {(p, i, j): float(cells[9 * p + 3 * i + j]) for p, i, j in product(range(2), range(3), range(3))}
    m = dict.fromkeys(n, 1.0)
    for _ in range(400):
        for drop in range(3):
            have, want = Counter(), Counter()
            for k in n:
                key = k[:drop] + k[drop + 1 :]
                have[key] += m[k]
                want[key] += n[k]
            for k in n:
                key = k[:drop] + k[drop + 1 :]
                m[k] = m[k] * want[key] / have[key] if have[key] else 0.0
    return 2 * sum(x * math.log(x / m[k]) for k, x in n.items() if x and m[k])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=18, max_size=18), min_size=1, max_size=4))
def test_all_tables_of_a_batch_are_fitted(rows):
    cells = np.array(rows)
    got, bound = epistasis.likelihood_ratio(cells, 400), epistasis.kirkwood(cells)
    for r, x, b in zip(rows, got, bound, strict=True):
        assert x == pytest.approx(plain_fit(r), abs=1e-4)
        assert x <= b + 1e-6


def test_no_interaction_no_statistic():
    a, b = np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.3, 0.1])
    t = np.outer(a, b) * 1000
    table = np.concatenate([t.ravel() * 2, t.ravel()])[None]
    assert epistasis.likelihood_ratio(table)[0] == pytest.approx(0, abs=1e-6) and epistasis.kirkwood(table)[0] == pytest.approx(0, abs=1e-6)
    assert epistasis.likelihood_ratio(np.array([[10, 0, 0, 0, 10, 0, 0, 0, 10, 0, 10, 10, 10, 0, 10, 10, 10, 0]]))[0] > 10


@pytest.mark.parametrize("tile,chunk", [(512, 30_000), (3, 30_000), (4, 9), (1, 5)])
def test_tables_of_tiles_and_chunks(spark, monkeypatch, tile, chunk):
    monkeypatch.setattr(epistasis, "TILE", tile)
    monkeypatch.setattr(epistasis, "PEOPLE", chunk)
    r = np.random.default_rng(tile)
    g = r.choice([0, 1, 2, None], p=[0.5, 0.25, 0.15, 0.1], size=(60, 9))
    label = r.integers(1, 3, 60)
    snps = [100 * k - 300 for k in range(9)]
    rows = [(i, snps[k], None if g[i, k] is None else int(g[i, k])) for i in range(60) for k in range(9) if g[i, k] != 0 or (i + k) % 3 == 0]
    genotype = spark.createDataFrame([*rows, (999, snps[0], 2)], "iid long, snp long, dosage long")  # one who isn't among the people
    people = spark.createDataFrame([(i, int(p)) for i, p in enumerate(label)], "iid long, phenotype int")
    found = epistasis.tables(genotype, people).collect()
    want = {}
    for a, b in combinations(range(9), 2):
        c = [0] * 18
        for i in range(60):
            if g[i, a] is not None and g[i, b] is not None:
                c[9 * (label[i] - 1) + 3 * g[i, a] + g[i, b]] += 1
        if any(c[9 * p + 3 * i + j] for p in range(2) for i in (1, 2) for j in (1, 2)):
            want[snps[a], snps[b]] = c
    assert {(x["snp_a"], x["snp_b"]): x["cells"] for x in found} == want and len(found) == len(want)
    least = float(np.median([x["bound"] for x in found]))
    assert {(x["snp_a"], x["snp_b"]) for x in epistasis.tables(genotype, people, least).collect()} == {(x["snp_a"], x["snp_b"]) for x in found if x["bound"] >= least}
    tested = {(x["snp_a"], x["snp_b"]): x for x in epistasis.boost(epistasis.tables(genotype, people)).collect()}
    for pair, cells in want.items():
        assert tested[pair]["chisq"] == pytest.approx(plain_fit(cells), abs=1e-3)


def test_nobody_and_nothing(spark):
    genotype = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "iid long, snp long, dosage long")
    people = spark.createDataFrame([(1, 2)], "iid long, phenotype int")
    assert [x["cells"][9 + 5] for x in epistasis.tables(genotype, people).collect()] == [1]
    assert epistasis.tables(genotype.limit(0), people).count() == 0 and epistasis.tables(genotype, people.limit(0)).count() == 0


def test_tail_in_closed_form(spark):
    from pyspark.sql import functions as F

    from riskweave.functions.stats import chi2_sf

    rows = spark.createDataFrame([(x,) for x in (0.0, 0.3, 4.0, 25.0, 90.0)], "x double").select("x", epistasis.chi2_4_tail(F.col("x")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(chi2_sf(r["x"], 4), rel=1e-10) for r in rows)
