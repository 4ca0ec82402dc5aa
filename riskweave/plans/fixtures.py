"""Inputs of the risk-score queries, as SQL that both engines run over the star-schema tables.

Each view is named here once; `frame` gives it as a DataFrame, `with_views` as common table expressions for an oracle.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import written

TABLES = ("customer", "orders", "lineitem", "part", "events", "embeddings")

#: View -> SQL. Views may use the tables and views before them. {pc} is an engine's list of principal components. What a hint
#: broadcasts has a few hundred rows whatever the size of the tables: 64 variants, 32 pairs, and their weights.
VIEWS = {
    "ks": "SELECT p_partkey - 1 AS k FROM part WHERE p_partkey BETWEEN 1 AND 64",
    "participant": "SELECT c_custkey AS iid, CASE WHEN c_mktsegment = 'BUILDING' OR c_acctbal < 0 THEN 2 ELSE 1 END AS phenotype FROM customer",
    "participant_text": """
        SELECT c_custkey AS iid,
            CASE WHEN c_mktsegment = 'BUILDING' THEN 'E11 type 2 diabetes' WHEN c_custkey % 11 = 0 THEN NULL ELSE 'I10 hypertension' END AS icd10,
            CASE WHEN c_custkey % 17 = 0 THEN 'diabetes' ELSE '' END AS self_report_0, CASE WHEN c_custkey % 23 = 0 THEN 'type 2 diabetes' ELSE 'asthma' END AS self_report_1,
            CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE '' END AS self_report_2, CAST('' AS STRING) AS self_report_3,
            CASE WHEN c_acctbal < -500 THEN '2001-02-03' ELSE '' END AS date_first, CASE WHEN c_custkey % 41 = 0 THEN 'hospital' ELSE '' END AS date_source
        FROM customer""",
    "withdrawn": "SELECT c_custkey AS iid FROM customer WHERE c_custkey % 97 = 0",
    "split": """
        SELECT iid, phenotype, CASE WHEN rn <= round(0.7 * n) THEN 'train' WHEN rn <= round(0.7 * n) + round(0.6666 * (n - round(0.7 * n))) THEN 'test' ELSE 'holdout' END AS split
        FROM (SELECT iid, phenotype, row_number() OVER (PARTITION BY phenotype ORDER BY md5(concat('1-', CAST(iid AS STRING))), iid) AS rn,
            CAST(count(*) OVER (PARTITION BY phenotype) AS DOUBLE) AS n FROM participant) s""",
    "genotype": """
        SELECT o_custkey AS iid, l_partkey % 64 AS snp, CAST(least(count(*), 2) AS BIGINT) AS dosage
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey % 64""",
    "genotype_missing": "SELECT iid, snp, CASE WHEN (iid * 7 + snp * 13) % 29 = 0 THEN NULL ELSE dosage END AS dosage FROM genotype",
    "hla": """
        SELECT o_custkey AS iid, concat('hla_', CAST(l_linenumber AS STRING)) AS allele,
            CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) / 5 AS raw
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_linenumber""",
    "env": """
        SELECT c_custkey AS iid, 'acctbal' AS env_feature, c_acctbal AS value FROM customer
        UNION ALL SELECT o_custkey, 'n_orders', CAST(count(*) AS DOUBLE) FROM orders GROUP BY o_custkey
        UNION ALL SELECT o_custkey, 'avg_order', CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 FROM orders GROUP BY o_custkey
        UNION ALL SELECT o_custkey, 'avg_qty', CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) / count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey
        UNION ALL SELECT user_id, concat('event_', event_type), CAST(count(*) AS DOUBLE) FROM events JOIN customer ON user_id = c_custkey GROUP BY user_id, event_type""",
    "covar": """
        SELECT c_custkey AS iid, CAST(40 + c_custkey % 30 AS DOUBLE) AS age, CAST(c_custkey % 2 AS DOUBLE) AS sex, {pc}
        FROM customer LEFT JOIN embeddings ON vec_id = c_custkey % 500""",
    "pairs": "SELECT k, concat(CAST(k AS STRING), ',', CAST((5 * k + 3) % 64 AS STRING)) AS feature, k AS a, (5 * k + 3) % 64 AS b FROM ks WHERE k < 32",
    "epi_pairs": """
        SELECT k AS line, CAST(k AS STRING) AS snp1, CAST((5 * k + 3) % 64 AS STRING) AS snp2 FROM ks
        UNION ALL SELECT 100 + k, CAST((5 * k + 3) % 64 AS STRING), CAST(k AS STRING) FROM ks WHERE k % 3 = 0
        UNION ALL SELECT 200 + k, CAST(k AS STRING), CAST((5 * k + 3) % 64 AS STRING) FROM ks WHERE k % 7 = 0""",
    "main_rows": "SELECT iid, CAST(snp AS STRING) AS feature, dosage AS x FROM genotype",
    "pair_rows": """
        SELECT /*+ BROADCAST(p) */ g.iid, p.feature, sum(g.dosage) AS x FROM genotype g
        JOIN (SELECT feature, a AS snp FROM pairs UNION ALL SELECT feature, b FROM pairs) p ON g.snp = p.snp GROUP BY g.iid, p.feature""",
    "gxe_rows": """
        SELECT /*+ BROADCAST(p) */ r.iid, concat('n_orders,', r.feature) AS feature, r.x * CAST(e.value AS BIGINT) AS x
        FROM pair_rows r JOIN env e ON e.iid = r.iid AND e.env_feature = 'n_orders' JOIN pairs p ON p.feature = r.feature WHERE p.k < 16""",
    "feature_rows": """
        SELECT iid, feature, CAST(x AS BIGINT) AS x FROM main_rows UNION ALL SELECT iid, feature, CAST(x AS BIGINT) FROM pair_rows
        UNION ALL SELECT iid, feature, CAST(x AS BIGINT) FROM gxe_rows""",
    "weights": """
        SELECT m.model, w.feature, w.coef100 FROM (
            SELECT 'm' AS kind, CAST(k AS STRING) AS feature, ((k * 37) % 21) - 10 AS coef100 FROM ks
            UNION ALL SELECT 'p', feature, ((k * 17) % 15) - 7 FROM pairs
            UNION ALL SELECT 'g', concat('n_orders,', feature), ((k * 11) % 9) - 4 FROM pairs WHERE k < 16) w
        JOIN (SELECT 'main' AS model, 'm' AS kind UNION ALL SELECT 'epi', 'p' UNION ALL SELECT 'cardio', 'g'
            UNION ALL SELECT 'epi+main', 'm' UNION ALL SELECT 'epi+main', 'p') m ON m.kind = w.kind""",
    "snp_weights": """
        SELECT w.model, k AS snp, 0 AS env, w.coef100 FROM weights w JOIN ks ON w.feature = CAST(k AS STRING)
        UNION ALL SELECT w.model, x.a, 0, w.coef100 FROM weights w JOIN pairs x ON w.feature = x.feature
        UNION ALL SELECT w.model, x.b, 0, w.coef100 FROM weights w JOIN pairs x ON w.feature = x.feature
        UNION ALL SELECT w.model, x.a, 1, w.coef100 FROM weights w JOIN pairs x ON w.feature = concat('n_orders,', x.feature)
        UNION ALL SELECT w.model, x.b, 1, w.coef100 FROM weights w JOIN pairs x ON w.feature = concat('n_orders,', x.feature)""",
    "prs": """
        SELECT p.iid, p.phenotype, m.model, CAST(coalesce(s.prs100, 0) AS BIGINT) AS prs100
        FROM participant p JOIN (SELECT DISTINCT model FROM weights) m ON 1 = 1
        LEFT JOIN (SELECT /*+ BROADCAST(w) */ f.iid, w.model, sum(f.x * w.coef100) AS prs100 FROM feature_rows f JOIN weights w ON f.feature = w.feature GROUP BY f.iid, w.model) s
        ON s.iid = p.iid AND s.model = m.model""",
    "shap": "SELECT CAST(k AS STRING) AS feature, CAST(((k * 29) % 61) - 30 AS DOUBLE) / 10 AS shap_zscore, 'main' AS data_type FROM ks UNION ALL SELECT feature, CAST(((k * 23) % 51) - 25 AS DOUBLE) / 10, 'epi' FROM pairs",
    "feature_scores": """
        SELECT model, feature, CAST(coef100 AS DOUBLE) / 100 AS coefs FROM weights
        UNION ALL SELECT 'cardio', concat('acctbal,', feature), CAST(((k * 19) % 23) - 11 AS DOUBLE) / 100 FROM pairs
        UNION ALL SELECT 'covariate', 'age', CAST(0.5 AS DOUBLE) UNION ALL SELECT 'main', '(Intercept)', CAST(-1.5 AS DOUBLE)""",
    "ld": """
        SELECT CAST(k AS STRING) AS snp_a, CAST((k + 1) % 64 AS STRING) AS snp_b, CAST((k * 7) % 10 AS DOUBLE) / 10 AS r2 FROM ks
        UNION ALL SELECT CAST(k AS STRING), CAST((5 * k + 4) % 64 AS STRING), CAST((k * 3) % 10 AS DOUBLE) / 10 FROM ks
        UNION ALL SELECT CAST(a.k AS STRING), CAST(b.k AS STRING), CAST(0.9 AS DOUBLE) FROM ks a JOIN ks b ON a.k < b.k AND a.k IN (0, 3, 8, 1, 43) AND b.k IN (3, 8, 43, 1, 0)""",
    "gxe_scores": """
        SELECT concat('e', CAST(e AS STRING)) AS env_type, CASE WHEN kind = 0 THEN concat('e', CAST(e AS STRING)) ELSE concat('e', CAST(e AS STRING), ',', feature) END AS name,
            CAST(CASE WHEN kind = 0 THEN (e * 53) % 61 - 30 ELSE ((k + e * 5) * 29) % 61 - 30 END AS DOUBLE) / 10 AS z, CASE WHEN kind = 0 THEN NULL ELSE feature END AS genetic
        FROM (SELECT k, feature, k % 4 AS e, 1 AS kind FROM pairs UNION ALL SELECT DISTINCT 0, '', k % 4, 0 FROM pairs) t
        UNION ALL SELECT concat('e', CAST(k % 4 AS STRING)), feature, CAST(((k * 31) % 57) - 28 AS DOUBLE) / 10 + CAST(k AS DOUBLE) / 1000, feature FROM pairs""",
    "cluster_genes": """
        SELECT p_name AS gene, p_partkey AS gene_id, CASE p_size % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'epi' WHEN 2 THEN 'cardio' ELSE 'main,epi' END AS cohort,
            0.5 + CAST((p_partkey * 13) % 100 AS DOUBLE) / 100 AS or_value, CAST(p_partkey % 2 AS BIGINT) AS c1, CAST(p_partkey % 3 = 0 AS BIGINT) AS c2,
            CAST(p_partkey % 5 < 2 AS BIGINT) AS c3, CAST(p_size % 7 = 1 AS BIGINT) AS c4, CAST(0 AS BIGINT) AS c5 FROM part""",
    "cluster_subtype": "SELECT 'c1' AS functional_cluster, 'beta cell, liver' AS subtype UNION ALL SELECT 'c2', 'obesity' UNION ALL SELECT 'c3', 'liver' UNION ALL SELECT 'c4', 'UNKNOWN' UNION ALL SELECT 'c5', 'obesity,beta cell'",
    "gene_map": "SELECT CAST(k AS STRING) AS feature, concat('GENE', CAST(k % 9 AS STRING)) AS gene, concat('HLA-', CAST(k % 5 AS STRING)) AS locus FROM ks WHERE k % 2 = 0",
    "known": """
        SELECT 'snp' AS level, CAST(k AS STRING) AS name, concat('trait', CAST(k % 3 AS STRING)) AS trait FROM ks WHERE k % 6 = 0
        UNION ALL SELECT 'locus', 'HLA-1', 'celiac' UNION ALL SELECT 'gene', 'GENE4', 'lipids' UNION ALL SELECT 'gene', 'GENE0', 'height'""",
    "clinical": "SELECT iid, CASE WHEN iid % 19 = 0 THEN NULL ELSE value END AS marker FROM env WHERE env_feature = 'acctbal'",
    "probs": "SELECT iid, phenotype - 1 AS y, model, round(1 / (1 + exp(-(CAST(prs100 AS DOUBLE) / 100 - 0.5))), 6) AS p FROM prs",
}
#: Views that Spark is told in another way, with the same rows. Scores are linear in dosages, so weights are summed by variant first
#: and meet each genotype once; features of pairs and environments need no rows of their own. Genotypes are dealt by person into {slices}, as many
#: as the lines ask for: what a person's rows are summed to needs no other exchange, and a task holds no more where the tables are larger. Places in the
#: split are counted in slices of the hash.
SPARK_VIEWS = {
    "split": """
        SELECT iid, phenotype, CASE WHEN rn <= round(0.7 * n) THEN 'train' WHEN rn <= round(0.7 * n) + round(0.6666 * (n - round(0.7 * n))) THEN 'test' ELSE 'holdout' END AS split
        FROM (
            SELECT /*+ BROADCAST(z) */ h.iid, h.phenotype, z.n, z.before + row_number() OVER (PARTITION BY h.phenotype, h.slice ORDER BY h.key, h.iid) AS rn
            FROM (SELECT iid, phenotype, key, coalesce(substring(key, 1, 2), '') AS slice FROM (SELECT iid, phenotype, md5(concat('1-', CAST(iid AS STRING))) AS key FROM participant)) h
            JOIN (
                SELECT phenotype, slice, sum(m) OVER (PARTITION BY phenotype ORDER BY slice) - m AS before, CAST(sum(m) OVER (PARTITION BY phenotype) AS DOUBLE) AS n FROM (
                    SELECT phenotype, coalesce(substring(md5(concat('1-', CAST(iid AS STRING))), 1, 2), '') AS slice, count(*) AS m FROM participant GROUP BY 1, 2)) z
            ON z.phenotype = h.phenotype AND z.slice = h.slice)""",
    "genotype": """
        SELECT iid, snp, CAST(least(count(*), 2) AS BIGINT) AS dosage FROM (
            SELECT /*+ REPARTITION({slices}, iid) */ o_custkey AS iid, l_partkey % 64 AS snp FROM (SELECT /*+ REPARTITION({slices}, o_orderkey) */ o_orderkey, o_custkey FROM orders)
            JOIN (SELECT /*+ REPARTITION({slices}, l_orderkey) */ l_orderkey, l_partkey FROM lineitem) ON o_orderkey = l_orderkey)
        GROUP BY iid, snp""",
    "prs": """
        SELECT p.iid, p.phenotype, m.model, CAST(coalesce(s.prs100, 0) AS BIGINT) AS prs100
        FROM participant p JOIN (SELECT DISTINCT model FROM weights) m ON 1 = 1
        LEFT JOIN (
            SELECT t.iid, t.model, sum(t.x * CASE WHEN t.env = 1 THEN coalesce(n.n_orders, 0) ELSE 1 END) AS prs100 FROM (
                SELECT /*+ BROADCAST(w) */ g.iid, w.model, w.env, sum(g.dosage * w.c) AS x FROM genotype g JOIN (
                    SELECT model, snp, env, sum(coef100) AS c FROM snp_weights
                    GROUP BY model, snp, env) w ON g.snp = w.snp GROUP BY g.iid, w.model, w.env) t
            LEFT JOIN (SELECT o_custkey AS iid, count(*) AS n_orders FROM orders GROUP BY o_custkey) n ON n.iid = t.iid GROUP BY t.iid, t.model) s
        ON s.iid = p.iid AND s.model = m.model""",
}
_ENGINE = {
    "spark": {"pc": ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS pc{i + 1}" for i in range(10))},
    "duckdb": {"pc": ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS pc{i + 1}" for i in range(10))},
}


#: Views that are written once where a query reads them more than once; scores always are, as bins, edges and people all read them.
SHARED = ("genotype", "prs")
#: Lines in a slice of the genotypes.
SLICE = 500_000


class Kept(dict):
    """The views that a query has written, and the slices of its genotypes once they are known."""

    slices = 0


def _sql(view: str, engine: str) -> str:
    return (SPARK_VIEWS.get(view) if engine == "spark" else None) or VIEWS[view]


def _uses(sql: str) -> list[str]:
    return [x for x in re.findall(r"(?:FROM|JOIN)\s+(\w+)", sql) if x in VIEWS]


@functools.cache
def _needed(name: str, engine: str, known: frozenset = frozenset()) -> tuple[str, ...]:
    """The views that a view needs and that aren't known, and itself, in the order of VIEWS."""
    found = {name} | {x for u in _uses(_sql(name, engine)) if u not in known for x in _needed(u, engine, known)}
    return tuple(v for v in VIEWS if v in found)


@functools.cache
def _times(name: str, view: str, known: frozenset) -> int:
    """How often a view's plan would hold another."""
    return sum(1 if u == view else _times(u, view, known) for u in _uses(_sql(name, "spark")) if u not in known)


def with_views(sql: str, engine: str = "duckdb", known: frozenset = frozenset(), slices: int = 1) -> str:
    """sql with the views it names, less those known, as common table expressions."""
    found = {x for u in _uses(sql) if u not in known for x in _needed(u, engine, known)}
    views = ",\n".join(f"{v} AS ({_sql(v, engine).format(**_ENGINE[engine], slices=slices)})" for v in VIEWS if v in found)
    if not views:
        return sql
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body[: len(start)].upper() == start:
            return f"{start}{views},\n{body[len(start) :]}"
    return f"WITH {views}\n{body}"


def frame(spark: SparkSession, sf_dir: str, view: str, kept: Kept | None = None) -> DataFrame:
    """A view over the tables in sf_dir. Only the tables it needs are opened. kept: views that this query has written, and will."""
    kept = Kept() if kept is None else kept
    if view in kept:
        return kept[view]
    for shared in SHARED:
        if shared != view and shared not in kept:
            n = _times(view, shared, frozenset(kept))
            if n > 1 or n and shared == "prs":
                kept[shared] = written(frame(spark, sf_dir, shared, kept), shared)
    if not kept.slices and "genotype" in _needed(view, "spark", frozenset(kept)):
        kept.slices = max(spark.sparkContext.defaultParallelism, -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // SLICE))
    sql = with_views(f"SELECT * FROM {view}", "spark", frozenset(kept), kept.slices)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", sql)}
    used |= {v: df for v, df in kept.items() if re.search(rf"\b(FROM|JOIN)\s+{v}\b", sql)}
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", sql)
    out = spark.sql(sql, **used)
    if view == "prs":
        out = kept[view] = written(out, view)
    return out
