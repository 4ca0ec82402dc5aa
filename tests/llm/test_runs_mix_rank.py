"""Periodic runs, mixing and ranked search against plain versions of themselves, and on awkward input."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm import mixing, periodic, queries, ranked

SMALL = "/root/testdata/sf0.001"
CLASHES = ["n", "row", "hash", "size", "at_hash", "level", "budget", "of", "weight", "first", "item", "lot", "rank", "score", "runs", "lang"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, texts and sources, empty and blank texts, repeated rows, ties, a very long text, names that clash."""
    long = " ".join(f"w{i % 7000}" for i in range(60_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, "one two", "b"), (5, "one two", "b"), (6, "one two", "b"), (None, "one two", None), (None, None, None), (7, long, "c"), (8, long + " end", "c"), (9, "naïve ёж 漢字 \x00   x", "é")]
    rows += [(20, "same row again", "hot")] * 50 + [(30 + i, " ".join(f"t{(i * 31 + k) % 90}" for k in range(40)), "hot") for i in range(30)]
    return spark.createDataFrame([(i, t, s, *["x"] * len(CLASHES)) for i, t, s in rows], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHES))


# Periodic runs.


def plain_runs(w):
    """Every period, every stretch."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            first = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - first >= max(6, 4 * q):
                found.setdefault((first, i + q - first), q)
            i += i == first
    return sorted((s, n, q) for (s, n), q in found.items())


pieces = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 9)), max_size=5)


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, min_size=1, max_size=3))
def test_runs_of_every_document(documents):
    texts = [[x for unit, times in d for x in unit * times] for d in documents]
    texts = [t for t in texts if t]
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    got = periodic.runs_of(np.array([x for t in texts for x in t], np.int64), starts)
    assert [got.get(s, []) for s in starts.tolist()] == [plain_runs(t) for t in texts]


@pytest.mark.parametrize("key", [2, 64])
def test_long_units_with_short_keys(key, monkeypatch):
    monkeypatch.setattr(periodic, "LONGEST_KEY", key)
    monkeypatch.setattr(periodic, "SHOWN", 128)
    r = random.Random(key)
    for _ in range(30):
        unit = r.choices(range(3), k=r.randint(20, 200))
        w = [9, *unit * 5, *unit[:7], 8, *[0] * r.randint(0, 300), 7, *[0] * r.randint(0, 300), *unit * 2]
        assert periodic.runs_of(np.array(w), np.array([0])).get(0, []) == plain_runs(w)


def test_work_on_a_text_of_one_word_grows_with_it():
    for w in (np.zeros(300_000, int), np.tile(np.arange(20_000), 9)):
        (run,) = periodic.runs_of(w, np.array([0]))[0]
        assert run[:2] == (0, len(w))


def test_runs_odd(odd):
    rows = periodic.periodic_runs(odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd.count() and periodic.periodic_runs(odd.limit(0)).count() == 0
    assert by[1]["n_words"] == 0 and by[1]["runs"] == [] and by[1]["collapsed"] == ""
    assert [tuple(x) for x in by[7]["runs"]] == [(0, 60_000, 7000)] and len(by[8]["collapsed"].split()) == 7001
    assert by[9]["collapsed"] == "naïve ёж 漢字 \x00 x"


def test_planted_tails():
    for i in range(200):
        w = [b"%d" % k for k in range(1 + i % 60)]
        t = queries.planted(i, w)
        assert len(t) == len(w) and set(t) <= set(w)
    assert queries.planted(None, [b"a"]) == [b"a"] and queries.planted(0, []) == []


# Mixing.


def plain_targets(sizes, weights, budget, most):
    """Excess goes to the others until none is above its stop."""
    stop, target, full = {s: most * n for s, n in sizes.items()}, dict.fromkeys(sizes, 0.0), set()
    while True:
        rest = [s for s in sizes if s not in full]
        left = budget * sum(sizes.values()) - sum(stop[s] for s in full)
        target = {s: stop[s] if s in full else left * weights[s] / sum(weights[x] for x in rest) for s in sizes}
        over = {s for s in rest if target[s] >= stop[s]}
        if not over or not rest:
            return target
        full |= over
        if full == set(sizes):
            return stop


def _mixed(rows, budgets, most=2, weights=(3, 1, 2)):
    sizes, order = Counter(), sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    for r in rows:
        sizes[r["source"]] += r["size"]
    turn = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    for k, b in enumerate(budgets):
        want = plain_targets(sizes, turn, b, most)
        got = Counter()
        for r in rows:
            got[r["source"]] += r["nested"][k]
            assert 0 <= r["nested"][k] <= most * r["size"] and (k == 0 or r["nested"][k - 1] <= r["nested"][k])
        for s in order:
            assert abs(got[s] - want[s]) <= 0.5 + 1e-6
            if k == len(budgets) - 1:
                assert {round(r["target"], 6) for r in rows if r["source"] == s} == {round(want[s], 6)}
    for s in order:  # all but one document of a source are taken a whole number of times
        assert sum(bool(r["size"] and r["taken"] % r["size"]) for r in rows if r["source"] == s) <= 1
    assert all(r["taken"] == r["nested"][-1] and r["source_size"] == sizes[r["source"]] for r in rows)


@pytest.mark.parametrize("budgets", [(1.5,), (0.2, 0.7, 1.0, 1.5), (2.0,), (2.5,)])
def test_sources_meet_their_targets(spark, odd, budgets):
    rows = mixing.mix(odd, budgets=budgets).collect()
    sizes = sorted((r["doc_id"] or -1, len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in odd.collect())
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sizes
    _mixed(rows, budgets)


def test_reruns_agree_whatever_the_order(spark, odd):
    told = lambda df: sorted((r["doc_id"] or -1, r["taken"], r["size"], r["source"] or "") for r in mixing.mix(df).collect())
    assert told(odd) == told(odd.repartition(7).orderBy(odd["text"].desc()))
    assert mixing.mix(odd.limit(0)).count() == 0


def test_more_sources_than_are_broadcast(spark, odd, monkeypatch):
    want = sorted(map(str, mixing.mix(odd).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)  # "hot" has over a third of the rows, others are joined
    assert sorted(map(str, mixing.mix(odd).collect())) == want


def test_one_histogram_after_another(spark, monkeypatch):
    """With buckets of two bits, rows with one hash are cut by their place."""
    monkeypatch.setattr(mixing, "LEVELS", [(s, 63) for s in range(58, -1, -2)] + [(0, s) for s in range(61, -1, -2)] + [(0, 0)])
    df = spark.createDataFrame([(i % 5, "a b c " * (i % 3), "s%d" % (i % 2)) for i in range(300)], "doc_id long, text string, source string")
    _mixed(mixing.mix(df, weights=(1, 4), budgets=(0.4, 1.3)).collect(), (0.4, 1.3), weights=(1, 4))


def test_mixing_is_native(spark, odd):
    plan = mixing.mix(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# Ranked search.


def plain_ranks(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, c, sum(c.values())) for i, c in bags if c]
    n_docs, n_terms, df = len(bags), sum(n for *_, n in bags), Counter(t for _, c, _ in bags for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in bags:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) & c.keys())
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [1, 7, 50])
def test_ranks(spark, k):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = ranked.rank_documents(docs.repartition(9, "doc_id"), items, k)
    want = plain_ranks([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], k)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_lots_of_items_and_small_blocks(spark, odd, monkeypatch):
    """Several lots, one document a block, products in small steps; items with null, empty and repeated texts and ids."""
    asked = [(1, "one TWO"), (1, "one TWO"), (2, None), (None, "t5 t6 t7 w3"), (3, "!!"), (4, "row again ёж x"), (5, "nowhere"), (6, " ".join(f"w{i}" for i in range(0, 7000, 50)))]
    items = spark.createDataFrame([(*x, "y") for x in asked], "item_id long, text string, n string")
    want = plain_ranks([(r["doc_id"], r["text"]) for r in odd.collect()], asked, 5)
    for name, value in (("ITEM_BYTES", 200), ("BLOCK", 1), ("PRODUCTS", 10), ("FIRST", 2), ("LANES", 3)):
        monkeypatch.setattr(ranked, name, value)
    assert sorted(map(tuple, ranked.rank_documents(odd.repartition(5), items, 5).collect()), key=str) == want
    assert ranked.rank_documents(odd.limit(0), items).count() == 0 and ranked.rank_documents(odd, items.limit(0)).count() == 0


def test_blocks_are_skipped_and_nothing_is_lost():
    """A bound is never below a score of its block, and most blocks without the item's rare terms aren't scored."""
    r = random.Random(1)
    vocabulary = ranked.Vocabulary((f"v{i}".encode(), i) for i in range(400))
    import pyarrow as pa

    texts = [" ".join(f"v{min(399, int(r.expovariate(0.03)))}" for _ in range(r.randint(5, 80))) for _ in range(2000)]
    texts[777] = "v390 v391 v392 v393"
    (batch,) = ranked._index(vocabulary)([pa.RecordBatch.from_pydict({"doc_id": list(range(2000)), "text": texts})])
    (row,) = batch.to_pandas().itertuples(index=False)
    terms, best = [np.array([1, 2, 390, 391, 392, 393])], ranked.Best(1, np.zeros(1, np.int64))
    scored = ranked.search_range(row, terms, np.arange(400), 2000, int(row.n_terms), best)
    assert best.kept[0][2].tolist() == [777] and scored <= 3


def test_damping_beyond_64_bits():
    n = np.array([10, 10**9], np.int64)
    assert ranked.damping(n, 10**11, 10**14).tolist() == [50 + 50 * int(x) * 10**11 // 10**14 for x in n]
