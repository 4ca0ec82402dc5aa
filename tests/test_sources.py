import json
import numpy as np
import pytest

from riskweave.operators import binning, prs
from riskweave.plans.fixtures import frame
from riskweave.sources import bed, readers, sinks
from riskweave.streaming.scoring import score_pieces, score_stream

SMALL = "/root/testdata/sf0.001"


def test_dosage_file(spark, tmp_path):
    p = tmp_path / "x.raw"
    p.write_text("FID IID PAT MAT SEX PHENOTYPE rs1_A rs2_G a_b_T\n1 1 0 0 1 2 0 1 2\n2 2 0 0 2 1 NA 2 0\n3 3 0 0 2 1 1 1 1\n")
    assert readers.header(spark, str(p))[6:] == ["rs1_A", "rs2_G", "a_b_T"]
    people, g = readers.read_dosages(spark, str(p), withdrawn=spark.createDataFrame([(3,)], "iid long"))
    assert {tuple(r) for r in g.collect()} == {(1, "rs2", 1), (1, "a_b", 2), (2, "rs1", None), (2, "rs2", 2)}
    assert {tuple(r) for r in people.collect()} == {(1, 1, 2), (2, 2, 1)}
    _, g = readers.read_dosages(spark, str(p), ["rs1"])
    assert {tuple(r) for r in g.collect()} == {(2, "rs1", None), (3, "rs1", 1)}
    assert readers.column_index(["b", "z"], ["a", "b"]) == (["b"], ["z"])


def test_covariates_and_hla(spark, tmp_path):
    c = tmp_path / "c.csv"
    c.write_text("Participant ID,Sex,Age at recruitment,PC1\n1,Female,40,0.5\n2,Male,x,\n3,,,\n")
    got = {r["iid"]: (r["sex"], r["age"], r["pc1"]) for r in readers.read_covariates(spark, str(c)).collect()}
    assert got == {1: (0, 40.0, 0.5), 2: (1, None, None)}
    h = tmp_path / "h.csv"
    h.write_text('id,hla\n1,"0.5,1.2"\n2,"2,0"\n')
    assert {tuple(r) for r in readers.read_packed_hla(spark, str(h), ["x", "y"]).collect()} == {(1, "x", 0.5), (1, "y", 1.2), (2, "x", 2.0), (2, "y", 0.0)}


def test_text_tables(spark, tmp_path):
    e = tmp_path / "e.summary"
    e.write_text(" CHR SNP N_SIG N_TOT PROP BEST_CHISQ BEST_CHR BEST_SNP\n 1 rs1 2 3 0.1 5 2 rs9\n")
    assert readers.read_epistasis(spark, str(e)).head()["feature"] == "rs1,rs9"
    l = tmp_path / "x.ld"
    l.write_text(" CHR_A BP_A SNP_A CHR_B BP_B SNP_B R2\n 1 5 rs1 1 6 rs2 0.7\n 1 5 rs1 1 7 rs3 0.2\n")
    assert [tuple(r) for r in readers.read_ld(spark, str(l)).collect()] == [("rs1", "rs2", 0.7)]
    w = tmp_path / "w.csv"
    w.write_text("5\n7\n")
    assert sorted(r[0] for r in readers.read_ids(spark, str(w)).collect()) == [5, 7]
    i = tmp_path / "i.csv"
    i.write_text("feature,shap_zscore,data_type\na,2.5,main\na,-3,epi\nb,0.5,main\n")
    assert [tuple(r) for r in readers.read_important(spark, str(i), 1).collect()] == [("a", -3.0, "epi")]
    assert readers.read_config("# x\nexport A='1'\nB=2\nB=3\n") == {"A": "1", "B": "3"}


def test_environment_files(spark, tmp_path):
    e = tmp_path / "e.csv"
    e.write_text("Participant ID,BMI,HbA1c (x)\n1,20.5,\n2,x,41\n")
    assert {tuple(r) for r in readers.read_environment(spark, str(e)).collect()} == {(1, "BMI", 20.5), (2, "HbA1c (x)", 41.0)}


def test_bed_folder_of_ranges_and_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bed, "PEOPLE", 6)
    monkeypatch.setattr(bed, "VARIANTS_IN_PART", 4)
    r = np.random.default_rng(2)
    g = r.choice([0, 1, 2, None], (23, 11), p=[0.5, 0.2, 0.2, 0.1])
    rows = [(i, 10 * k, None if g[i, k] is None else int(g[i, k])) for i in range(23) for k in range(11) if g[i, k] != 0]
    genotype, people = spark.createDataFrame([*rows, (99, 0, 1)], "iid long, snp long, dosage long"), spark.range(23).withColumnRenamed("id", "iid")
    variants = spark.createDataFrame([(10 * k,) for k in range(11)] + [(500,)], "snp long")
    path = f"file://{tmp_path}/folder"
    bed.save(genotype, people, path, variants)
    listed = [json.loads(x) for x in (tmp_path / "folder" / bed.LIST).read_text().splitlines()]
    assert len(listed) >= 12 and [(x["part"], x["chunk"]) for x in listed] == sorted((x["part"], x["chunk"]) for x in listed)
    assert sum(x["variants"] * x["people"] for x in listed) == 12 * 23
    df = spark.read.format("bed").load(path)
    want = sorted((str(i), str(s), d) for i, s, d in rows)
    told = lambda df: sorted(map(tuple, df.collect()), key=lambda x: x[:2])
    assert told(df) == sorted(want, key=lambda x: x[:2])
    (tmp_path / "folder" / "part-left-behind.bed").write_bytes(b"x")  # not on the list
    assert told(df.filter("snp in ('10', '500') and iid <> '3'")) == [x for x in sorted(want, key=lambda x: x[:2]) if x[1] == "10" and x[0] != "3"]
    assert told(df.filter("iid = '7' and snp = '20'")) == [x for x in want if x[:2] == ("7", "20")]


def test_bed_round_trip(spark, tmp_path):
    d = np.random.default_rng(0).integers(-1, 3, (5, 7))
    bed.write_fileset(str(tmp_path / "g"), [f"p{i}" for i in range(7)], [f"rs{i}" for i in range(5)], d)
    bed.register(spark)
    got = {(r["iid"], r["snp"]): r["dosage"] for r in spark.read.format("bed").load(str(tmp_path / "g")).collect()}
    assert got == {(f"p{j}", f"rs{i}"): None if d[i, j] < 0 else int(d[i, j]) for i in range(5) for j in range(7) if d[i, j]}


def test_batches_are_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    for _ in range(2):
        sinks.write_batch(df, str(tmp_path / "t"), "x")
    sinks.write_batch(df, str(tmp_path / "t"), "y")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.write_ids(df, str(tmp_path / "ids"), ["a", "b"])
    assert spark.read.text(str(tmp_path / "ids")).head()[0] == "1 2"


def test_stream_equals_batch(spark, tmp_path):
    rows, weights = frame(spark, SMALL, "feature_rows"), frame(spark, SMALL, "weights")
    scores = prs.score(rows, weights, frame(spark, SMALL, "participant"))
    edges = binning.quantile_edges(scores, "prs100", 10, ["model"])
    for k in range(2):
        rows.filter(f"iid % 2 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    score_stream(spark, str(tmp_path / "in"), weights, edges, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {(r["iid"], r["model"]): r["score"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["iid"], r["model"]): r["prs100"] for r in scores.collect()}
    assert got and all(want[k] == v for k, v in got.items()) and all(v == 0 for k, v in want.items() if k not in got)


def test_people_in_pieces(spark, tmp_path):
    """In any order, over several runs, some twice, some without weights; who isn't whole isn't told."""
    weights = spark.createDataFrame([("a", "m", 3), ("b", "m", 5), ("b", "n", 7)], "feature string, model string, coef100 int")
    edges = spark.createDataFrame([("m", [4.0]), ("n", [4.0])], "model string, edges array<double>")
    kind = "iid long, piece int, pieces int, rows array<struct<feature: string, x: long>>"
    batches = [
        [(1, 0, 2, [("a", 1)]), (2, 0, 1, [("b", 2)]), (1, 0, 2, [("a", 1)]), (3, 0, 2, [("a", 9)]), (4, 1, 2, [("zz", 1)])],
        [(1, 0, 2, [("a", 1)]), (1, 1, 2, [("b", 1), ("b", 1)]), (4, 0, 2, [("a", 1)]), (2, 0, 1, [("b", 2)])],
        [(1, 1, 2, [("b", 1), ("b", 1)]), (5, 0, 1, [])],
    ]
    run = lambda patience: score_pieces(spark, str(tmp_path / "in"), weights, edges, str(tmp_path / "out"), str(tmp_path / "ck"), patience=patience).awaitTermination(120)
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(3_600_000)
    told = lambda: sorted((r["iid"], r["model"], r["score"], r["complete"], r["bin"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert told() == [(1, "m", 13, True, 2), (1, "n", 14, True, 2), (2, "m", 10, True, 2), (2, "n", 14, True, 2), (4, "m", 3, True, 1)]


def test_copies_of_a_piece_in_another_order(spark, tmp_path):
    """Two copies of a piece in one batch, in files and orders of their own, count as one."""
    weights = spark.createDataFrame([(f, "m", c) for f, c in (("a", 1), ("b", 10), ("c", 100))], "feature string, model string, coef100 int")
    edges, kind = spark.createDataFrame([("m", [4.0])], "model string, edges array<double>"), "iid long, piece int, pieces int, rows array<struct<feature: string, x: long>>"
    for order in ("abc", "cab", "bca"):
        spark.createDataFrame([(i, 0, 1, [(f, 1) for f in order]) for i in range(20)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    score_pieces(spark, str(tmp_path / "in"), weights, edges, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("iid", "model", "score", "complete").collect())
    assert got == [(i, "m", 111, True) for i in range(20)]


def test_who_waits_too_long_is_told_as_far_as_known(spark, tmp_path):
    """Once, with the next data, and then forgotten; who was told whole isn't told again."""
    weights = spark.createDataFrame([("a", "m", 3), ("b", "n", 7)], "feature string, model string, coef100 int")
    edges, kind = spark.createDataFrame([("m", [4.0]), ("n", [4.0])], "model string, edges array<double>"), "iid long, piece int, pieces int, rows array<struct<feature: string, x: long>>"
    told, seen = lambda: sorted((r["iid"], r["model"], r["score"], r["complete"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()), []
    for rows in ([(1, 0, 2, [("a", 9)]), (2, 0, 1, [("b", 1)]), (3, 0, 2, [("zz", 1)])], [(4, 0, 1, [("a", 1)])], [(1, 1, 2, [("a", 1)]), (5, 0, 1, [("b", 2)])]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        score_pieces(spark, str(tmp_path / "in"), weights, edges, str(tmp_path / "out"), str(tmp_path / "ck"), patience=1).awaitTermination(120)
        seen.append(told())
    assert seen == [[(2, "n", 7, True)], [(1, "m", 27, False), (2, "n", 7, True), (4, "m", 3, True)], [(1, "m", 27, False), (2, "n", 7, True), (4, "m", 3, True), (5, "n", 14, True)]]


@pytest.mark.parametrize("view", ["covar", "hla", "env", "cluster_genes"])
def test_fixture_views_have_rows(spark, view):
    assert frame(spark, SMALL, view).count() > 0


def test_config_lines_and_log(spark, tmp_path):
    text = readers.upsert_config("# A=1\nexport A=old\nB=2\nA=older\n", A="new", C="x")
    assert text.splitlines() == ["# A=1", "export A=new", "B=2", "C=x"] and readers.read_config(text) == {"A": "new", "B": "2", "C": "x"}
    path = tmp_path / "lines"
    sinks.write_lines(spark.range(500).selectExpr("id", "concat('line ', id) as value").repartition(7), f"file://{path}", order="id")
    lines = [x for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [f"line {i}" for i in range(500)]
    logger = sinks.log_to(str(tmp_path / "logs"), "run")
    logger.info("one line")
    [file] = (tmp_path / "logs").glob("run-*.log")
    assert file.read_text().rstrip().endswith("INFO one line")
