"""The thin queries opN_<name>, and their SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import preferences
from .decontaminate import find_leaks
from .exact_dedup import exact_dedup
from .lm_score import lm_score
from .mixing import mix
from .near_dedup import near_dedup
from .packing import pack
from .periodic import periodic_runs
from .pii import find_pii
from .ranked import rank_documents
from .sharding import shard
from .substring import substring_dedup
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added")


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences(_table(spark, sf_dir, "conversations"))


def op4_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"), 8)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), words=2)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_table(spark, sf_dir, "documents"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, with a periodic tail in one of ten, by a hash of the id. A null id has no hash and no tail."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_table(spark, sf_dir, "documents"), rewrite=planted)
    better = lambda best, r: F.when(best["length"].isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    best = found.withColumn("best", F.aggregate("runs", none, better))
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), budgets=(1.0, 1.5)).drop("nested")


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pack, op2_pii, op3_preferences, op4_leaks, op5_exact_dedup, op6_shard, op7_near_dedup, op8_lm_score, op9_substring, op10_toxicity, op11_runs, op12_mix, op13_ranked)}

SQL = {
    "op7_near_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        t AS (SELECT s.doc_id, s.g, n.n FROM s JOIN n USING (doc_id)),
        links AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
        edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.y, reach.r FROM reach JOIN edges b ON b.x = reach.doc_id)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.r) AS component_id, d.doc_id = min(reach.r) AS kept
        FROM documents d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
    """,
    "op9_substring": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
        first AS (SELECT g, min(doc_id) AS f FROM win GROUP BY g),
        gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM win JOIN first USING (g) WHERE f < doc_id)),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d)
        SELECT d.doc_id, any_value(len(d.w)) AS n_words, count(gone.p) AS n_removed,
            sha256(coalesce(string_agg(words.word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL), '')) AS kept_sha256
        FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY d.doc_id
    """,
    "op11_runs": r"""
        WITH RECURSIVE c AS (
            SELECT 0 AS k, [i::UBIGINT FOR i IN range(256)] AS t
            UNION ALL SELECT k + 1, list_transform(t, lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END) FROM c WHERE k < 8),
        d AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
                    lambda s, x: xor(s >> 8, t[xor(s & 255, x)::INT + 1]))) AS h
            FROM documents, c WHERE k = 8),
        a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END::BIGINT AS a FROM d),
        p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8)::BIGINT AS p FROM a),
        words AS (SELECT doc_id, n, i, CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)),
        same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        stretches AS (
            SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM same)
            GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
        runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
        told AS (
            SELECT doc_id, count(*) AS n_runs, arg_min({'start': start, 'length': length, 'period': period}, {'e': -length / period, 's': start, 'p': period}) AS b,
                sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS digest FROM runs GROUP BY doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period, 1000 * b.length // b.period AS exponent_milli,
            coalesce(digest, sha256('')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
        FROM d LEFT JOIN told ON told.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
    """,
    "op12_mix": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, ''))[1:15] AS h FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap, [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
            FROM d GROUP BY source),
        filling AS (
            SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
            FROM s WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        level AS (SELECT max(level) FILTER (WHERE cap > weight * level) AS level FROM filling),
        wanted AS (SELECT source, source_size, least(cap, weight * level) AS target, round(least(cap, weight * level))::BIGINT AS want FROM s, level),
        ordered AS (
            SELECT d.*, source_size, target, want // greatest(source_size, 1) AS whole, want % greatest(source_size, 1) AS need, sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) - size AS ahead
            FROM d JOIN wanted ON d.source IS NOT DISTINCT FROM wanted.source)
        SELECT doc_id, size, source_size, target, (whole * size + least(greatest(need - ahead, 0), size))::BIGINT AS taken, source FROM ordered
    """,
    "op13_ranked": r"""
        WITH terms AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents),
        asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
        whole AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM sizes),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
        weighed AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term),
        lengths AS (SELECT doc_id, 50 + (50 * n * nd) // l AS m FROM sizes, whole),
        scored AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
            FROM asked JOIN tf USING (term) JOIN weighed USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id),
        ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 50
    """,
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op3_preferences": """
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
            FROM conversations WHERE conv_id IS NOT NULL),
        begun AS (SELECT conv_id, i, string_agg(role || chr(1) || text || chr(2), '') OVER (PARTITION BY conv_id ORDER BY i) AS begin FROM t),
        shared AS (SELECT i, begin, min(conv_id) AS low, max(conv_id) AS high FROM begun GROUP BY i, begin HAVING min(conv_id) < max(conv_id)),
        best AS (SELECT conv_id, arg_max(CASE WHEN conv_id = low THEN high ELSE low END, i) AS rejected_id FROM begun JOIN shared USING (i, begin) GROUP BY conv_id),
        last AS (
            SELECT conv_id, max(i) FILTER (WHERE role = 'assistant') AS last, count(*) AS n, arg_max(text, i) FILTER (WHERE role = 'assistant') AS answer FROM t GROUP BY conv_id),
        alone AS (SELECT l.* FROM last l WHERE conv_id NOT IN (SELECT conv_id FROM best)),
        lent AS (
            SELECT a.conv_id, o.conv_id AS rejected_id, coalesce(a.last, a.n + 1) AS i, o.answer AS text
            FROM alone a JOIN last o ON o.conv_id = a.conv_id + 1 - 2 * (((a.conv_id % 2) + 2) % 2) AND o.last IS NOT NULL),
        chosen AS (SELECT conv_id AS pair_id, i, role, text FROM t),
        rejected AS (
            SELECT b.conv_id AS pair_id, t.i, role, text FROM best b JOIN t ON t.conv_id = b.rejected_id
            UNION ALL SELECT t.conv_id, t.i, role, text FROM t JOIN alone a ON a.conv_id = t.conv_id AND (a.last IS NULL OR t.i < a.last)
            UNION ALL SELECT conv_id, i, 'assistant', text FROM lent),
        common AS (
            SELECT p.pair_id, coalesce(min(CASE WHEN c.i IS NULL OR r.i IS NULL OR c.role <> r.role OR c.text <> r.text THEN coalesce(c.i, r.i) END) - 1, count(*)) AS n
            FROM (SELECT DISTINCT pair_id FROM chosen) p
            JOIN chosen c ON c.pair_id = p.pair_id
            LEFT JOIN rejected r ON r.pair_id = c.pair_id AND r.i = c.i GROUP BY p.pair_id),
        parts AS (
            SELECT 'c' AS side, pair_id, i, role, text FROM chosen UNION ALL SELECT 'r', pair_id, i, role, text FROM rejected),
        rendered AS (
            SELECT side, p.pair_id, i, role, i <= n AS shared, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS said
            FROM parts p JOIN common USING (pair_id)),
        placed AS (
            SELECT *, sum(length(said)) OVER (PARTITION BY side, pair_id, shared ORDER BY i) AS stop FROM rendered)
        SELECT pair_id, coalesce(best.rejected_id, lent.rejected_id, pair_id) AS rejected_id, k.n AS common_turns,
            coalesce((SELECT string_agg(said, '' ORDER BY i) FROM placed x WHERE x.pair_id = k.pair_id AND side = 'c' AND shared), '') AS prompt,
            coalesce((SELECT string_agg(said, '' ORDER BY i) FROM placed x WHERE x.pair_id = k.pair_id AND side = 'c' AND NOT shared), '') AS chosen,
            coalesce((SELECT string_agg(said, '' ORDER BY i) FROM placed x WHERE x.pair_id = k.pair_id AND side = 'r' AND NOT shared), '') AS rejected,
            coalesce((SELECT string_agg((stop - length(said) + length(role) + 5)::BIGINT || ':' || stop::BIGINT, ',' ORDER BY i) FROM placed x WHERE x.pair_id = k.pair_id AND side = 'c' AND NOT shared AND role = 'assistant'), '') AS chosen_mask,
            coalesce((SELECT string_agg((stop - length(said) + length(role) + 5)::BIGINT || ':' || stop::BIGINT, ',' ORDER BY i) FROM placed x WHERE x.pair_id = k.pair_id AND side = 'r' AND NOT shared AND role = 'assistant'), '') AS rejected_mask
        FROM common k LEFT JOIN best ON best.conv_id = k.pair_id LEFT JOIN lent ON lent.conv_id = k.pair_id
    """,
}
