"""Each operator against a plain version of itself, and on awkward input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm import chat, decontaminate, exact_dedup, lm, lm_score, near_dedup, packing, pii, queries, sharding, substring, toxicity

SMALL = "/root/testdata/sf0.001"
CLASHES = ["body", "copy", "chunk", "keep_id", "score", "held_out", "part", "fp", "toxic", "rep", "comp", "size", "hash", "lang"]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty and blank texts, repeated rows, ties, a very long text, names that clash."""
    long = " ".join(f"w{i % 7000}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (5, "one two"), (6, "one two"), (None, "one two"), (None, None), (7, long), (8, long + " end"), (9, "naïve ёж 漢字 \x00   x"), (10, "a" * 5000)]
    rows += [(20 + i, " ".join(f"t{(i * 31 + k) % 90}" for k in range(40))) for i in range(30)]
    return spark.createDataFrame([(i, t, *["x"] * len(CLASHES)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def words(text):
    return (text or "").encode().split()


# Exact dedup.


@given(st.lists(st.integers(0, 2**48 - 1), unique=True, min_size=1, max_size=300))
def test_golomb_round_trip(values):
    v = np.array(sorted(values), np.int64)
    assert (exact_dedup.rice_decode(len(v), *exact_dedup.rice_encode(v)) == v).all()


def test_bits_of_a_fingerprint():
    """A slice of the hash range costs about as much as the entropy of its gaps, wherever it begins."""
    r = np.random.default_rng(1)
    for n in (2_000, 200_000):
        values, spent = np.unique(r.integers(0, 1 << 48, n)), 0
        edges = np.searchsorted(values, [(o << 48) // 200 for o in range(201)])
        for a, b in zip(edges, edges[1:], strict=False):
            base, k, unary, rest = exact_dedup.rice_encode(values[a:b])
            assert (exact_dedup.rice_decode(b - a, base, k, unary, rest) == values[a:b]).all()
            spent += 8 * (len(unary) + len(rest))
        assert spent / n < 48 - math.log2(n) + 2.1 + 16 * 200 / n


def test_exact_dedup(docs, texts):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs).collect()}
    for i, t in texts.items():
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(groups[t]), len(groups[t]), i == max(groups[t]))
        assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_odd(odd, none):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == odd.count() and exact_dedup.exact_dedup(none).count() == 0
    two = [r for r in rows if r["text_sha256"] == hashlib.sha256(b"one two").hexdigest()]
    assert {r["keep_id"] for r in two} == {6} and {r["group_size"] for r in two} == {4} and sum(r["kept"] for r in two) == 1
    empty = [r for r in rows if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert {r["keep_id"] for r in empty} == {2} and len(empty) == 3


# Sharding.


def test_shards(odd, docs, none, spark):
    alike = spark.createDataFrame([(None, "")] * 700 + [(5, "the same")] * 700, "doc_id long, text string")
    hot = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 17)) for i in range(2000)], "doc_id long, text string")
    for df, slack in ((docs, None), (odd, None), (hot, 300), (alike, None)):
        rows = sharding.shard(df, 8).collect()
        size, slots = Counter(), defaultdict(list)
        for r in rows:
            size[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert len(rows) == df.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(size.values()) - min(size[k] for k in range(8)) <= 2 * (slack or max(r["size"] for r in rows))
        assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
        total, before = sum(size.values()), 0
        for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])):  # by the middle of each record in their order
            assert r["shard"] == min(7, int((before + r["size"] / 2) * 8 // total))
            before += r["size"]
    assert sharding.shard(none, 8).count() == 0
    for r in sharding.shard(docs, 8).join(docs, "doc_id").collect():
        assert r["size"] == len(r["text"].encode()) + 1 and r["text_crc32"] == zlib.crc32(r["text"].encode())


# Packing.


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(1, 63), max_size=200))
def test_plan_uses_every_id_once(lengths):
    seen = defaultdict(list)
    sequences = packing.plan(np.array(lengths, np.int64), 64)
    for s in sequences:
        assert sum(n for _, _, n in s) <= 64
        for item, start, n in s:
            seen[item].append((start, n))
    for item, n in enumerate(lengths):
        at = 0
        for start, k in sorted(seen[item]):
            assert start == at
            at += k
        assert at == n
    assert sum(sum(n for *_, n in s) < 64 for s in sequences) <= 1


def test_packing_round_trip(spark, docs, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    marked = spark.createDataFrame([(1, "one<|endoftext|>two <|endoftext|>"), (2, "<|endoftext|>"), (3, "<|endof<|endoftext|>text|> 've\u00a0 \u4e2d")], "doc_id long, text string")
    for df in (docs, marked, odd.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        pieces, offsets = defaultdict(list), defaultdict(list)
        for r in packing.pack(df).collect():
            pieces[r["doc_id"]].append(r)
            offsets[r["sequence_id"]].append((r["offset"], r["length"]))
        for r in df.collect():
            ids = np.array([*reference.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
            at = 0
            for p in sorted(pieces[r["doc_id"]], key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids)
                at += p["length"]
                assert bytes(p["ids"]) == ids[p["start"] : at].tobytes()
            assert at == len(ids)
        total = sum(n for spans in offsets.values() for _, n in spans)
        plans = len({i >> 32 for i in offsets if i >= 0})
        assert len(offsets) <= -(-total // 1024) + plans  # one sequence of each plan at most isn't full
        for spans in offsets.values():
            at = 0
            for start, n in sorted(spans):
                assert start == at
                at += n
            assert at <= 1024
    crcs = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in queries.QUERIES["op1_pack"](docs.sparkSession, SMALL).collect()}
    assert all(crcs[r["doc_id"], r["start"]] == zlib.crc32(bytes(r["ids"])) for r in packing.pack(docs).collect())
    assert packing.pack(none).count() == 0 and packing.pack(odd).count() >= odd.count()


def test_no_plan_holds_all_rows_that_are_alike(spark):
    rows = packing.pack(spark.createDataFrame([(None, "")] * 3000 + [(7, "the same text")] * 3000, "doc_id long, text string"), plan_docs=500).collect()
    assert sum(r["doc_id"] is None for r in rows) >= 3000 and len({r["sequence_id"] >> 32 for r in rows}) == 12
    assert sum(r["length"] for r in rows) == 3000 + 3000 * max(r["doc_tokens"] for r in rows)


# Chat.


def test_preferences_sql(spark, duck):
    got = {r["pair_id"]: r.asDict() for r in queries.QUERIES["op3_preferences"](spark, SMALL).collect()}
    want = duck.sql(queries.SQL["op3_preferences"]).df().to_dict("records")
    assert len(want) == len(got) and all(got[w["pair_id"]] == w for w in want)


def test_preferences_odd(spark):
    rows = [(1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no"), (2, "chosen", 0, None, None), (3, "rejected", None, "assistant", "x")]
    got = {r["pair_id"]: r for r in chat.format_preferences(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")).collect()}
    one = got[1]
    assert one["prompt"] == "<|user|>\nhi<|end|>\n" and one["common_turns"] == 1
    a, b = map(int, one["chosen_mask"].split(":"))
    assert one["chosen"][a:b] == "yes<|end|>\n" and one["rejected"][len("<|assistant|>\n") :].startswith("no")
    assert got[2]["prompt"] == "" and got[2]["chosen"] and got[2]["rejected"] == "" and got[3]["chosen"] == ""


def test_forks_are_found_and_every_conversation_is_formatted(spark):
    r, talks = random.Random(9), {}
    for i in [*range(0, 120, 2), *range(121, 160), -3, -4]:
        talks[i] = [("user" if k % 2 == 0 else "assistant", r.choice("abc") if i < 120 else f"{i} {k}") for k in range(r.randint(1, 6))]
    talks[500] = talks[501] = [("user", "a copy"), ("assistant", "of it")]
    rows = [(i, k, role, text, "x") for i, turns in talks.items() for k, (role, text) in enumerate(turns)] + [(None, 0, "user", "nobody", "x")]
    got = {x["pair_id"]: x for x in chat.preferences(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, pair_id string")).collect()}
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    said = lambda turns: "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in turns)
    assert got.keys() == talks.keys()
    forks = 0
    for i, own in talks.items():
        most = max(common(own, t) for j, t in talks.items() if j != i)
        x = got[i]
        if most:
            forks += 1
            sharing = sorted(j for j, t in talks.items() if common(own, t) >= most)
            assert x["rejected_id"] == (sharing[-1] if sharing[0] == i else sharing[0]) and x["common_turns"] == most
            assert (x["prompt"], x["chosen"], x["rejected"]) == (said(own[:most]), said(own[most:]), said(talks[x["rejected_id"]][most:]))
            continue
        last = max((k for k, t in enumerate(own) if t[0] == "assistant"), default=len(own))
        lent = [t for t in talks.get(i + 1 - 2 * (i % 2), []) if t[0] == "assistant"][-1:]
        assert x["rejected"] == said(lent) and x["prompt"] == said(own[:last]) and x["chosen"] == said(own[last:])
        assert x["rejected_id"] == (i + 1 - 2 * (i % 2) if lent else i)
    assert forks > 60 and chat.preferences(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


# Decontamination.


def test_lcs():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 20))] for _ in range(2))
        assert decontaminate.lcs(a, b) == slow(a, b)


def test_leaks(spark, docs, texts, odd, none):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {r["item_id"]: decontaminate.words_of(r["text"]) for r in bench.collect()}
    r, planted = random.Random(5), []
    for k, (i, ws) in enumerate(sorted(items.items())):
        host = decontaminate.words_of(texts[k])
        hit = [w if r.random() > 0.12 else b"other" for w in ws]  # a paraphrase
        planted.append((10_000 + k, b" ".join([*host[:40], *hit, *host[40:80]]).decode(), i))
    df = docs.unionByName(spark.createDataFrame([p[:2] for p in planted], "doc_id long, text string"))
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(df, bench).collect()}
    padded = {i: b" " + b" ".join(decontaminate.words_of(t)) + b" " for i, t in texts.items()}
    verbatim = {(i, b) for i, t in padded.items() for b, ws in items.items() if b" " + b" ".join(ws) + b" " in t}
    found = {(d, i) for d, _, i in planted} & got
    assert verbatim <= got and len(found) >= 0.9 * len(planted)
    extra = {(d, i) for d, i in got if d < 10_000} - verbatim
    for d, i in extra:  # near-verbatim only
        assert decontaminate.lcs(items[i], decontaminate.words_of(texts[d])) >= decontaminate.LCS * len(items[i])
    assert decontaminate.find_leaks(odd, bench).count() == 0 and decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def _planted(bench, hosts, times, least=0, most=10**9):
    """Items with a fifth of their words replaced, between words that no item has: rows, and the (doc_id, item_id) that count as leaks."""
    r, rows, want = random.Random(11), [], set()
    for i, ws in sorted((x["item_id"], decontaminate.words_of(x["text"])) for x in bench.collect()):
        for _ in range(times if least <= len(ws) <= most else 0):
            host, (a, b) = r.choice(hosts), ([b"zz%d" % r.randrange(9999) for _ in range(30)] for _ in range(2))
            text = b" ".join([*host[:40], *a, *(w if r.random() > 0.2 else b"qq%d" % r.randrange(9999) for w in ws), *b, *host[40:80]]).decode()
            rows.append((10_000_000 + len(rows), text))
            got = decontaminate.words_of(text)
            if decontaminate.lcs(ws, got) >= decontaminate.LCS * len(ws) and decontaminate.lcs(ws[-5:], got) >= decontaminate.ANSWER * len(ws[-5:]):
                want.add((rows[-1][0], i))
    return rows, want


def test_short_paraphrased_leaks(spark, docs, texts):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows, want = _planted(bench, [decontaminate.words_of(t) for _, t in sorted(texts.items())], 16, most=20)
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string")), bench).collect()}
    assert len(want) > 50 and len(want - got) <= 0.015 * len(want), (len(want - got), len(want))


def test_leaks_against_a_search_of_every_passage(spark, docs, texts):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = [(x["item_id"], decontaminate.words_of(x["text"])) for x in bench.collect()]
    rows, _ = _planted(bench, [decontaminate.words_of(t) for _, t in sorted(texts.items())], 2)
    want = set()
    for i, text in [*texts.items(), *rows]:
        ws = decontaminate.words_of(text)
        for k, item in items:
            m, bag = len(item), set(item)
            for scale in decontaminate.SCALES:
                for a in range(0, max(1, len(ws) - scale // 2), scale // 2):
                    region = ws[max(0, a - m) : a + scale + m]
                    if (i, k) not in want and len(bag.intersection(region)) >= decontaminate.LCS * m - (m - len(bag)) and decontaminate.lcs(item, region) >= decontaminate.LCS * m and decontaminate.lcs(item[-5:], region) >= decontaminate.ANSWER * len(item[-5:]):
                        want.add((i, k))
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string")), bench).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) > 50


def test_odd_items(spark):
    text = " ".join(f"word{k}" for k in range(30))
    df = spark.createDataFrame([(1, "some " * 20 + text), (None, text), (3, None), (4, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text, "x"), (2, text, "x"), (2, text, "x"), (None, text, "x"), (5, None, "x"), (6, "", "x"), (7, "one", "x")], "item_id long, text string, doc_id string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()), key=str)
    assert got == sorted([(d, i) for d in (1, None) for i in (1, 2, None)], key=str)


def test_latent_space_of_all_documents(spark, docs, monkeypatch):
    """However many documents there are, the fit takes them all, and its products are those of passages one by one."""
    seen, fit = [], decontaminate.latent
    monkeypatch.setattr(decontaminate, "FIT_DOCS", 5)
    monkeypatch.setattr(decontaminate, "latent", lambda rows, *rest: (seen.append(rows.count()), fit(rows, *rest))[1])
    decontaminate.find_leaks(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).count()
    assert seen == [docs.count()]
    r = np.random.default_rng(1)
    idf, basis = np.append(0, r.random(40) + 0.1), r.normal(size=(41, 7))
    group = [(n, np.where(r.random(n) < 0.3, 0, r.integers(1, 41, n)).astype(np.int32)) for n in (0, 1, 15, 16, 17, 31, 32, 33, 48, 49, 200)] + [(0, np.zeros(50, np.int32))]
    want = np.zeros(basis.shape)
    for _, ids in group:
        for k in range(0, max(1, len(ids) - 16), 16):
            v = np.bincount(ids[k : k + 32], minlength=41) * idf
            v = v / (np.linalg.norm(v) or 1)
            want += np.outer(v, v @ basis)
    got = np.zeros(basis.shape)
    terms, rows = decontaminate._pairs(idf, (idf[:, None] * basis).astype(np.float32), group)
    got[terms] += rows
    assert np.allclose(got, want, atol=1e-4)


def test_leaks_where_the_latent_space_is_fitted_on_a_sample(spark):
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    hosts = [decontaminate.words_of(x["text"]) for x in docs.filter("text is not null").orderBy("doc_id").limit(400).collect()]
    rows, want = _planted(bench, hosts, 4)
    df = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    assert df.count() > 2 * decontaminate.FIT_DOCS
    missed = want - {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(df, bench).collect()}
    assert len(want) > 600 and len(missed) <= 0.015 * len(want), (len(missed), len(want))


# Near duplicates.


def _near(texts, n):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in texts}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    at = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in at[s])
        for s in sets[i]:
            at[s].append(i)
        for j, c in common.items():
            if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in texts}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, texts, n):
    want = _near(texts, n)
    for r in near_dedup.near_dedup(docs, words=n).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_without_a_good_hub(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    r = random.Random(4)
    made = {}
    for i in range(200):
        w = [f"w{k}" for k in range(60)]
        for _ in range(r.randint(1, 5)):
            w[r.randrange(60)] = f"x{r.randrange(10**6)}"
        made[i] = " ".join(w)
    want = _near(made, 2)
    for x in near_dedup.near_dedup(spark.createDataFrame(list(made.items()), "doc_id long, text string"), words=2).collect():
        assert x["component_id"] == want[x["doc_id"]][1]


def test_documents_with_a_common_frame_meet_nobody(spark, monkeypatch):
    r, asked = random.Random(8), []
    frame = [f"frame{k}" for k in range(60)]
    made = {i: " ".join([*frame[:30], *(f"own{r.randrange(10**9)}" for _ in range(14 + i % 9)), *frame[30:]]) for i in range(400)}
    for i in range(0, 400, 40):  # and some real copies
        made[1000 + i] = made[i] + " end"
    resolve = near_dedup._resolve
    monkeypatch.setattr(near_dedup, "_resolve", lambda percent: asked.append(1) or resolve(percent))
    want = _near(made, 2)
    members = []
    written = near_dedup.materialise
    monkeypatch.setattr(near_dedup, "materialise", lambda df, tag, **k: members.append(written(df, tag, **k)) or (members[-1] if tag != "near-members" else asked.append(members[-1].count()) or members[-1]))
    for x in near_dedup.near_dedup(spark.createDataFrame(list(made.items()), "doc_id long, text string"), words=2).collect():
        assert x["component_id"] == want[x["doc_id"]][1]
    assert len({top for _, top in want.values()}) == 400 and sum(n for n in asked[::2]) < 200


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=40, unique=True), st.lists(st.integers(0, 60), min_size=1, max_size=40, unique=True), st.sampled_from([50, 80, 90]))
def test_similar_sets_share_a_prefix_key(a, b, percent):
    from riskweave.llm.common import mix

    often = np.full(1 << 12, 9, np.uint8)
    often[np.arange(0, 1 << 12, 3)] = 2
    x, y = (np.unique(mix(np.array(v, np.uint64))) for v in (a, b))
    if len(x) < len(y):
        x, y = y, x
    if near_dedup.similar(x, y, percent):
        assert set(near_dedup.prefix_keys(x, often, percent)[1].tolist()) & set(near_dedup.prefix_keys(y, often, percent)[0].tolist())


def test_near_duplicates_odd(odd, none):
    rows = near_dedup.near_dedup(odd, words=2).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd.count() and by[1]["n_shingles"] == 0 and by[3]["component_id"] == 3 and by[3]["kept"]
    assert by[6]["component_id"] == 5 and by[8]["component_id"] == 7
    assert near_dedup.near_dedup(none).count() == 0


# Language model.


def test_base_and_held_out_score(docs, texts):
    learn = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    counts = Counter()
    for i in learn:
        counts.update([*(w.lower() for w in words(texts[i])), b""])
    n, v = sum(counts.values()), len(counts)
    rows = lm_score.lm_score(docs).collect()
    for r in rows:
        w = [*(x.lower() for x in words(texts[r["doc_id"]])), b""]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(counts[x] > 0 for x in w), n, r["doc_id"] not in learn)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] < 0 and r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / (len(b" ".join(w[:-1])) + 1))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_model_beats_the_base_on_held_out_documents(spark, sf):
    from pyspark.sql import functions as F

    rows = lm_score.lm_score(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).head()
    assert rows[0] > rows[1]


def _units(seed, n=120):
    """Words in classes, how often each, and the code of their bytes."""
    r = random.Random(seed)
    units = {("".join(r.choices("abc\u0436", k=r.randint(0, 11))).encode(), r.randrange(3)): r.randint(0, 5) for _ in range(n)}
    units[b"ab" * 50, 1] = units[b"ab" * 50 + b"c", 1] = 2
    said, of, times = [w for w, _ in units], np.array([c for _, c in units]), np.array(list(units.values()))
    batch, own, singles = lm.Batch(said, of), defaultdict(Counter), np.zeros((256, 256), np.int64)
    for p, b, n in zip(batch.pair.tolist(), batch.bytes.tolist(), np.repeat(times, batch.sizes).tolist(), strict=True):
        if n:
            own[p][b] += n
            singles[p & 255, b] += n
    return said, of, times, batch, lm.Code({p: dict(c) for p, c in own.items()}, singles)


def _known(code, batch, times, leave_out=False):
    out = []
    for keys, n, of in (lm.tally(keys, np.repeat(times, batch.sizes)) for keys in batch.keys):
        pairs = np.empty(len(keys), np.int64)
        pairs[of] = batch.pair
        counts = lm.Counts(code, keys, pairs, n)
        out.append((counts, *counts.inputs(leave_out), of))
    return out


def _path(code, pair, byte):
    n, nodes, bits = code.spell(np.array([pair]), np.array([byte]))
    return list(zip(nodes.tolist(), bits.tolist(), strict=True))


@pytest.mark.parametrize("leave_out", [False, True])
def test_spelling_against_a_plain_mixer(leave_out):
    said, of, times, batch, code = _units(2)
    known = _known(code, batch, times, leave_out)
    weights = np.random.default_rng(3).uniform(-0.2, 0.8, (lm.GATES, lm.CONTEXTS + 1)).astype(np.float32)
    got = lm.spelling(batch.sizes, *lm.inputs(code, batch.pair, batch.bytes, known), weights)
    after = defaultdict(Counter)  # kind, class, place (up to the kind's reach) and what precedes -> byte -> count
    steps = lambda w, c: [(w[:i], (w + b"\xff")[i], [(0, c, min(i, lm.ORDER), w[max(0, i - lm.ORDER) : i]), (1, c, i, w[:i] if i <= lm.DEPTH else None)]) for i in range(len(w) + 1)]
    for w, c, n in zip(said, of.tolist(), times.tolist(), strict=True):
        for _, byte, contexts in steps(w, c):
            for x in contexts:
                after[x][byte] += n if x[3] is not None else 0
    for w, c, value in zip(said, of.tolist(), got.tolist(), strict=True):
        want = 0.0
        for before, byte, contexts in steps(w, c):
            pair = int.from_bytes(before[-2:], "big")
            for node, bit in _path(code, pair, byte):
                x, gate = [float(code.logits[node])], 0
                for context in contexts:
                    n = [0, 0]
                    for other, times_other in after[context].items():
                        for node2, bit2 in _path(code, pair, other):
                            n[bit2] += times_other * (node2 == node)
                    n[bit] -= leave_out and n[bit] > 0
                    x.append(math.log((n[1] + 0.3) / (n[0] + 0.3)))
                    gate = gate * lm.N_LEVELS + sum(sum(n) >= k for k in lm.SEEN) + 5 * (min(n) > 0)
                z = sum(float(v) * float(weights[gate, k]) for k, v in enumerate(x))
                want -= math.log1p(math.exp(-z if bit else z))
        assert value == pytest.approx(want, rel=1e-4)


def test_codes_and_next_bytes_have_a_probability_of_one_at_most():
    said, of, times, batch, code = _units(5)
    for own in range(256, len(code.depth)):
        assert sum(0.5 ** int(d) for d in code.depth[own] if d) == pytest.approx(1)
    weights = np.full((lm.GATES, lm.CONTEXTS + 1), 0.4, np.float32)
    for prefix in (b"", b"a", b"ab", b"abcab", b"zz"):
        next_words = lm.Batch([prefix + bytes([b]) for b in range(255)] + [prefix], np.zeros(256, np.int64))
        both = lm.Batch([*said, *(prefix + bytes([b]) for b in range(255)), prefix], np.concatenate([of, np.zeros(256, np.int64)]))
        known, late = _known(code, both, np.concatenate([times, np.zeros(256, np.int64)])), len(batch.bytes)
        n, bits, logits, gate = lm.inputs(code, next_words.pair, next_words.bytes, [(c, x, y, at[late:]) for c, x, y, at in known])
        z = sum(x * weights[:, k].take(gate) for k, x in enumerate(logits))
        logs = -np.log1p(np.exp(np.where(bits == 1, -z, z)))
        ends = np.cumsum(n)
        places = np.cumsum(next_words.sizes) - next_words.sizes + len(prefix)
        total = sum(math.exp(logs[ends[p] - n[p] : ends[p]].sum()) for p in places)
        assert 0.5 <= total <= 1.001


def test_classes_and_recall_against_plain_loops():
    r = random.Random(6)
    sizes = np.array([1, 300, 2, 40, 1, 700])
    tokens = np.array([r.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 9][: 3 + i % 8]) for i in range(int(sizes.sum()))])
    group = np.array([0, 1, lm.CLASSES, 2, 1, lm.CLASSES, 0, 3, 7, 7])[tokens]
    got, recall, place = lm.classes(group, sizes), lm.Recall(tokens, sizes), 0
    decisions = iter(zip(recall.at.tolist(), recall.doc.tolist(), recall.hit.tolist(), recall.gate.tolist(), recall.inputs[1].tolist(), strict=True))
    for d, n in enumerate(sizes.tolist()):
        own, had = tokens[place : place + n].tolist(), Counter()
        came, streak = {True: [0, 0], False: [0, 0]}, 0
        for i, w in enumerate(own):
            best = max(had.values(), default=0)
            assert got[place + i] == (min(k for k, v in had.items() if v == best) if best else lm.CLASSES)
            had.update([int(group[place + i])] if group[place + i] < lm.CLASSES else [])
            two = [j for j in range(2, i) if own[j - 2 : j] == own[i - 2 : i]] if i >= 2 else []
            one = [j for j in range(1, i) if own[j - 1] == own[i - 1]] if i else []
            if two or one:
                j, much = (two or one)[-1], bool(two)
                hit, (yes, no) = own[j] == w, came[much]
                at, doc, hit2, gate, x = next(decisions)
                assert (at, doc, hit2) == (place + i, d, hit) and gate == much * 5 + sum(streak >= k for k in lm.STREAKS)
                assert x == pytest.approx(math.log((yes + 0.4) / (no + 1.6)), rel=1e-5)
                came[much][not hit] += 1
                streak = streak + 1 if hit else 0
        place += n
    assert next(decisions, None) is None
    logs = recall.logs(np.tile(lm.RECALL_START, (lm.RECALL_GATES, 1)))
    assert (logs < 0).all() and len(logs) == len(recall.at)


def test_groups_of_words_that_share_documents():
    texts = [b"of the is " * 3] * 5 + [b"der die das"] * 4 + [b"le la de"] * 3
    words, at, sizes = lm_score.tokens(lm_score._said([t.decode() for t in texts]))
    group = lm.groups(lm.together(lm_score._buckets(words)[at], sizes))
    of = [{int(group[lm.bucket(w)]) for w in ws} for ws in ([b"of", b"the", b"is"], [b"der", b"die", b"das"], [b"le", b"la", b"de"])]
    assert all(not a & b for i, a in enumerate(of) for b in of[:i]) and group[lm.bucket(b"longer")] == lm.CLASSES
    assert set(lm.groups(np.zeros((lm.BUCKETS + 1, lm.BUCKETS + 1))).tolist()) == {lm.CLASSES}


def test_tokens():
    said = lm_score._said(["One two  one", "", " \n ", "\u00c9 two"])
    words, at, sizes = lm_score.tokens(said)
    assert [words[i] for i in at] == [b"one", b"two", b"one", b"", b"", b"", "\u00c9".encode(), b"two", b""]
    assert sizes.tolist() == [4, 1, 1, 3] and words == sorted(words)


def test_owners_know_what_all_training_documents_have(spark):
    r = random.Random(3)
    units = sorted({("".join(r.choices("ab", k=r.randint(0, 9))).encode(), r.randrange(3)) for _ in range(1500)})
    n = [r.randint(0, 4) for _ in units]
    batch = lm.Batch([w for w, _ in units], np.array([c for _, c in units]))
    singles, own_codes = np.ones((256, 256), np.int64), defaultdict(dict)
    code, times = lm.Code(own_codes, singles), np.array(n)
    whole, places = _known(code, batch, times), np.repeat(np.arange(len(units)), batch.sizes)
    words, rows, cuts = sorted({w for w, _ in units}), [], [0, 40, 300, 301, 10**6]
    for o, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        own = [i for i, (w, _) in enumerate(units) if a <= words.index(w) < b]
        rows.append(lm_score._row(3, 0, o, a=lm_score._bytes([units[i][0] for i in own]), b=lm_score.press(np.array([units[i][1] for i in own])), c=lm_score.press(np.array([n[i] for i in own]))))
    df = spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in row) for row in rows], lm_score.ROW)
    told = df.mapInPandas(lm_score._asked(3), lm_score.ROW).groupBy("owner", "kind").applyInPandas(lm_score._tell, lm_score.ROW).toPandas()
    for o, row in enumerate(lm_score._frame(rows).itertuples()):
        own = lm_score.Owned(row)
        at = np.flatnonzero(np.isin(places, [i for i, (w, _) in enumerate(units) if cuts[o] <= words.index(w) < cuts[o + 1]]))
        for (got, of), (want, _, _, want_of) in zip(own.known(code, told[told["chunk"] == o]), whole, strict=True):
            for k, (i, j) in enumerate(zip(of.tolist(), want_of[at].tolist(), strict=True)):
                n = code.spell(own.pair[k : k + 1].astype(int), own.bytes[k : k + 1])[0][0]
                a, b = got.first[i], want.first[j]
                assert (got.n0[a : a + n] == want.n0[b : b + n]).all() and (got.n1[a : a + n] == want.n1[b : b + n]).all()


def test_weights_are_fitted_on_all_training_documents(spark, monkeypatch):
    r, asked = random.Random(4), []
    said = [" ".join(r.choices(["one", "two", "three"], k=4)).encode() for _ in range(4200)]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(said)], "doc_id long, text string")
    fitted, code = lm_score._fitted, lm_score._code
    monkeypatch.setattr(lm_score, "_fitted", lambda *a: asked.append(fitted(*a)) or asked[-1])
    monkeypatch.setattr(lm_score, "_code", lambda *a: asked.append(code(*a)) or asked[-1])
    lm_score.lm_score(df)
    train = [t for i, t in enumerate(said) if zlib.crc32(str(i).encode()) % 7 != 2]
    recall, (code, _, _), spelling = asked
    times = Counter(w for t in train for w in [*t.split(), b""])
    decisions = {w: code.spell((b := lm.Batch([w], np.zeros(1))).pair, b.bytes)[0].sum() for w in times}
    assert spelling.seen == sum(n * decisions[w] for w, n in times.items())
    assert recall.seen == len(lm.Recall(*lm_score.tokens(lm_score._said([t.decode() for t in train]))[1:]).at) and len(train) > 3500


def test_lm_odd(odd, none):
    rows = lm_score.lm_score(odd).collect()
    assert len(rows) == odd.count() and all(r["n_tokens"] >= 1 and math.isfinite(r["score"]) for r in rows)
    assert lm_score.lm_score(none).count() == 0


# Substrings.


def _cut(texts, window):
    first = {}
    for i in sorted(texts):
        w = words(texts[i])
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i in texts:
        w = words(texts[i])
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("window", [5, 13, 30])
def test_substring_dedup(docs, texts, window):
    want = _cut(texts, window)
    for r in substring.substring_dedup(docs, window).collect():
        assert (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) == want[r["doc_id"]]


def test_substring_digest(spark, texts):
    want = _cut(texts, 13)
    for r in queries.QUERIES["op9_substring"](spark, SMALL).collect():
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]


def test_substring_odd(odd, none):
    rows = substring.substring_dedup(odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd.count() and by[1]["n_words"] == 0 and by[5]["n_removed"] == 0
    assert by[8]["n_words"] == 60_001 and by[8]["n_removed"] == 60_000
    assert substring.substring_dedup(none).count() == 0


# Toxicity.


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").collect()
    both = sum(r["predicted"] and r["toxic"] for r in rows)
    assert both >= 0.9 * sum(r["toxic"] for r in rows) > 50 and both >= 0.8 * sum(r["predicted"] for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_folding_and_exceptions():
    assert toxicity.fold("L0SER id10t") == "loser idiot" and toxicity.fold("\u0455\u0441um") == "scum" and toxicity.fold("room 101") == "room 101"
    lexicon = toxicity.Lexicon({"scum ": 5.0, "idio": 4.0}, {"idiom "}, {"pond scum", "the idiot box"}, -3.0, (2.0, 1.0))
    machine = lexicon.automaton()
    assert lexicon.measure(machine, "such an idiom, scumble") == (0.0, 0.0)
    assert lexicon.measure(machine, "such an 1di0t!")[0] > 0 and lexicon.score(machine, "scum") > 0.5 > lexicon.score(machine, "")
    assert lexicon.measure(machine, "Pond\nscum on THE idiot-box") == (0.0, 0.0)
    assert lexicon.measure(machine, "beyond scum")[0] > 0 and lexicon.measure(machine, "pond scum, scum")[0] == math.log1p(5.0)


def test_phrases_of_clean_documents_are_excepted(spark):
    rows = [(f"you are scum number {i}", 1) for i in range(12)] + [(f"there is pond scum in water {i}", 0) for i in range(3)] + [(f"a clean text {i}", 0) for i in range(300)]
    lexicon = toxicity.fit(spark.createDataFrame(rows, "body string, toxic int"))
    assert {"pond scum", "scum in", "pond scum in"} <= lexicon.phrases and not any("are scum" in x for x in lexicon.phrases)
    machine = lexicon.automaton()
    assert lexicon.score(machine, "scum, all of you") > 0.5 > lexicon.score(machine, "green pond scum")


def test_toxicity_odd(odd, none, spark):
    labels = spark.createDataFrame([(4, 0, 1), (5, 0, 0), (5, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd, labels).count() == odd.count()
    assert toxicity.toxicity(none, labels).count() == 0 and toxicity.toxicity(odd, labels.limit(0)).filter("predicted = 1").count() == 0


# Personal data.

_PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s, d: 13 <= len(d) <= 19 and pii.luhn(d)), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 9 <= len(d) <= 15),
]


def _plain(text):
    return [(k, *m.span()) for k, p, ok in _PLAIN for m in re.finditer(p, text) if ok(m[0], re.sub("[^0-9]", "", m[0]))]


@settings(deadline=None, max_examples=400)
@given(st.text(alphabet="019.@+-() ab%é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == _plain(text)


def test_pii_digest(spark, texts):
    for r in queries.QUERIES["op2_pii"](spark, SMALL).collect():
        base = _plain(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))


def test_field_on_unseen_lines():
    weights, right, truth, wrong = np.array(pii.train()), 0, 0, 0
    for text, gold in pii.examples(400, 77):
        base = pii.base_spans(text)
        got, gold = set(pii.added_spans(text, base, weights)), gold - set(base)
        right, truth, wrong = right + len(got & gold), truth + len(gold), wrong + len(got - gold)
    assert right >= 0.9 * truth and wrong <= 0.05 * truth


def test_decoding_by_enumeration():
    r, weights = random.Random(3), np.zeros(pii.WEIGHTS)
    for _ in range(100):
        spans = sorted(((a := r.randrange(12), a + r.randint(1, 5), "card", [0]) for _ in range(7)), key=lambda s: s[1])
        values = [r.uniform(-1, 1) for _ in spans]
        pii_scores, pii._scores = pii._scores, lambda *_: values
        try:
            got = sum(values[spans.index((a, b, k, [0]))] for k, a, b in pii.decode(spans, weights))
        finally:
            pii._scores = pii_scores
        best = 0.0
        for m in range(1 << len(spans)):
            pick = [i for i in range(len(spans)) if m >> i & 1]
            if all(spans[i][1] <= spans[j][0] or spans[j][1] <= spans[i][0] for i in pick for j in pick if i < j):
                best = max(best, sum(values[i] for i in pick))
        assert got == pytest.approx(best) or len({s[:2] for s in spans}) < len(spans)


# Personal data written in ways that the field's own examples were not made from.
_WRITTEN = [
    ("write to jane.doe [at] example [dot] org please", "jane.doe [at] example [dot] org", "email"), ("server 192.168.1[.]10 is down", "192.168.1[.]10", "ip"),
    ("card 4111.1111.1111.1111, exp 12/27", "4111.1111.1111.1111", "card"), ("call (212) 555-0147 now", "(212) 555-0147", "phone"), ("Tel 212.555.0147", "212.555.0147", "phone"),
    ("mail bob at example dot com today", "bob at example dot com", "email"), ("bob(at)mail.example.com", "bob(at)mail.example.com", "email"), ("host 10[.]0[.]0[.]1 up", "10[.]0[.]0[.]1", "ip"),
    ("alice @ example . net", "alice @ example . net", "email"), ("pay 4111_1111_1111_1111", "4111_1111_1111_1111", "card"), ("fax 415-555-0199.", "415-555-0199", "phone"), ("Reach me: (415)555-0199", "(415)555-0199", "phone"),
]
_PLAIN_NUMBERS = ["on 2024-01-02 at 10.30", "order 12345678", "room 101 at noon", "pages 12 - 14", "look at this dot", "see 3.14159 and 2.71828"]


def test_field_on_ways_of_writing_it_was_not_trained_on():
    weights, found = np.array(pii.train()), 0
    for text, span, kind in _WRITTEN:
        found += (kind, text.index(span), text.index(span) + len(span)) in pii.added_spans(text, pii.base_spans(text), weights)
    assert found >= 0.9 * len(_WRITTEN)
    assert not any(pii.added_spans(text, pii.base_spans(text), weights) for text in _PLAIN_NUMBERS)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["(555) 123-4567", " at home dot com", "bob", "4111.1111.1111.1111", "@", " ", "1.2.3.4", "[.]", "5", "+1 ", "a@b.co", "-", "(", "x"]), max_size=12))
def test_added_spans_overlap_nothing(parts):
    text, weights = "".join(parts), np.array(pii.train())
    base = pii.base_spans(text)
    added = sorted(pii.added_spans(text, base, weights), key=lambda s: s[1])
    assert all(a[2] <= b[1] for a, b in zip(added, added[1:], strict=False))
    assert not any(a < y and x < b for _, a, b in added for _, x, y in base)


@pytest.mark.parametrize("unit", ["1.2.3.", "12 34 ", "@", "a@a", "+(1", "5 "])
def test_work_grows_with_the_text_and_no_faster(unit):
    import time

    weights, took = np.array(pii.train()), []
    for n in (50_000, 400_000):
        text = unit * (n // len(unit))
        began = time.process_time()
        pii.added_spans(text, pii.base_spans(text), weights)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] * 3 + 0.5


def test_pii_odd(odd, none):
    rows = pii.find_pii(odd).collect()
    assert len(rows) == odd.count() and pii.find_pii(none).count() == 0
    assert {(r["base_spans"], r["spans"]) for r in rows if r["doc_id"] == 1} == {("", "")}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(want.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_nothing_but_results_is_left_behind(spark, docs, tmp_path):
    from riskweave.llm import common

    before = spark.conf.get("spark.checkpoint.dir")
    tables = len(spark.catalog.listTables())
    shared = Path(common.shared_dir(spark).removeprefix("file://"))
    seen = {p.name for p in shared.iterdir()}
    for run, name in ((near_dedup.near_dedup, "near-found"), (lm_score.lm_score, "lm-scores"), (exact_dedup.exact_dedup, "exact-found"), (sharding.shard, "shards")):
        assert run(docs).count() == docs.count()
        left = {p.name for p in shared.iterdir()} - seen
        assert {x.rpartition("-")[0] for x in left} == {name}
        seen |= left
    substring.substring_dedup(docs).count()
    assert len(spark.catalog.listTables()) == tables and spark.conf.get("spark.checkpoint.dir") == before


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from riskweave.llm import common

    unset = N(get=lambda key, default=None: default)
    with pytest.raises(ValueError):
        common.shared_dir(N(sparkContext=N(getConf=lambda: unset, master="spark://host:7077", applicationId="x"), conf=unset))


def test_leaks_do_not_depend_on_counts_before(monkeypatch):
    """Regions that are looked at without a count of their words give the rows that those with one give."""
    import pandas as pd

    from riskweave.llm import decontaminate as D

    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(words, 20))) for i in range(12)]
    texts = [" ".join([*r.choice(words, 40), *(items[i % 12][1].split() * (i % 3)), *r.choice(words, 30)]) for i in range(40)]
    probes = D.Probes(items)
    frame = next(D._numbered(probes)(iter([pd.DataFrame({"doc_id": range(40), "body": texts})])))
    idf = np.append(0.0, np.ones(len(probes.vocabulary)))
    found = []
    for few in (0, D.FEW, 10**9):
        monkeypatch.setattr(D, "FEW", few)
        found.append(next(D._search(probes, idf, np.eye(len(idf)), D.COSINE, D.LCS)(iter([frame]))))
    assert len(found[0]) >= 20 and found[0].equals(found[1]) and found[0].equals(found[2])
