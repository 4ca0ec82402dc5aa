"""The stages of the pipeline against plain versions, each on its own input."""

from collections import defaultdict

import corpus_pipeline as P
import pytest

from riskweave.llm import toxicity
from riskweave.llm.common import materialise

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """Rows after each stage."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES[:-1]:
        out.append(materialise(stage(spark, out[-1], SMALL), "t"))
        assert out[-1].columns == docs.columns
    return out


def _ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_toxic_documents_go(spark, kept):
    scored = toxicity.toxicity(kept[0], spark.read.parquet(f"{SMALL}/labels.parquet")).collect()
    assert _ids(kept[1]) == {r["doc_id"] for r in scored if not r["predicted"]}


def test_one_of_equal_texts_stays(kept):
    groups = defaultdict(list)
    for r in kept[1].collect():
        groups[r["text"]].append(r["doc_id"])
    assert _ids(kept[2]) == {max(g) for g in groups.values()}


def test_near_duplicates_go(kept):
    from .test_llm import _near

    want = _near({r["doc_id"]: r["text"] for r in kept[2].collect()}, 5)
    assert _ids(kept[3]) == {i for i, (_, top) in want.items() if i == top}


def test_no_text_is_sorted_to_number_rows(spark, monkeypatch):
    """Rows are numbered as they lie: neither plan that is written for it has an exchange or a sort."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plans, write = [], P.materialise
    monkeypatch.setattr(P, "materialise", lambda df, tag, **k: plans.append((tag, df._jdf.queryExecution().toString())) or write(df, tag, **k))
    P._numbered(docs)
    assert [tag for tag, _ in plans] == ["pipeline-rows"] and not any(word in plan for _, plan in plans for word in ("Exchange", "Sort"))


def test_leaks_go_and_nothing_else(spark, kept):
    from riskweave.llm.decontaminate import words_of

    items = [b" " + b" ".join(words_of(r["text"])) + b" " for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in kept[3].collect() if not any(i in b" " + b" ".join(words_of(r["text"])) + b" " for i in items)}
    left = _ids(kept[4])
    assert left <= clean and len(clean - left) <= 0.02 * len(clean)


def test_all_that_is_left_is_packed(spark, kept):
    assert {r["doc_id"] for r in P.STAGES[-1][1](spark, kept[4], SMALL).collect()} == _ids(kept[4])


def test_rows_without_an_id_or_with_a_repeated_one_are_told_apart(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").head()["text"]
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(None, item), (None, "a clean text"), (1, item), (1, "another clean text"), (2, long), (2, "a third clean text"), (3, long + " end"), (None, long + " stop")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(r["text"] for r in P.near_stage(spark, docs, SMALL).collect())
    assert left == sorted([item, "a clean text", "another clean text", long, "a third clean text"])  # of the item's two rows one goes
    clean = sorted(r["text"] for r in P.benchmark_stage(spark, docs, SMALL).collect())
    assert clean == sorted(t for _, t in rows if t != item)


def test_columns_with_names_that_stages_use(spark):
    rows = [(1, "x y", "mine", 7, "own", 1), (2, "x y", "yours", 8, None, 2), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, row int, `gone.id` string, score int")
    want = [rows[1], rows[2]]
    for _, stage in P.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SMALL), "t")
    assert sorted(map(tuple, docs.collect()), key=str) == sorted(want, key=str)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "x y", "en", None, 3), (2, "x y", "en", None, 3), (3, "x y", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for _, stage in P.STAGES[:-1]:
            df = materialise(stage(spark, df, SMALL), "t")
        assert P.STAGES[-1][1](spark, df, SMALL).count() >= 0
