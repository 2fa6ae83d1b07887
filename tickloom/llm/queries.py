"""Queries over the corpus tables: one a numbered operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .divergence import divergence_audit
from .exact_dedup import exact_dedup
from .language import identify
from .mixing import with_copies
from .near_dedup import near_duplicates
from .packing import pack_documents
from .periodic_runs import find_runs, strongest, with_planted_period
from .pii import scan as scan_pii
from .quality_model import scores
from .quality_rules import COUNTS, judge
from .scaled_sketch import edit_report, fingerprint
from .secrets import scan as scan_secrets
from .sharding import kd_shards


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pii(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), hash_all=True)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_runs(with_planted_period(table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edit_report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality_model": op2_quality_model,
    "op3_pii": op3_pii,
    "op4_secrets": op4_secrets,
    "op5_mixing": op5_mixing,
    "op6_near_dedup": op6_near_dedup,
    "op7_language": op7_language,
    "op8_kd_sharding": op8_kd_sharding,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_scaled_sketch": op12_scaled_sketch,
    "op13_source_divergence": op13_source_divergence,
    "pipeline": pipeline,
}

ORACLE = {
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op6_near_dedup": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
            ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END) AS sh FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
        r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id, d.doc_id = min(r.root) AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id""",
    # Runs repeat windows of 8 words a period apart at 9 places or more; of stretches at the same place the smallest period is the run's.
    "op11_periodic_runs": """
        WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, xor(4294967295, list_reduce(
                list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ascii(d)::UBIGINT)),
                lambda s, b: list_reduce(list_concat([xor(s, b)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))) AS h FROM documents),
        g AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, CAST(CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS BIGINT) AS a, CAST((h // 10) % 8 AS BIGINT) AS k FROM c),
        p AS (SELECT *, 1 + (n - a) // (3 + k) AS p FROM g),
        m AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM p),
        w AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(ws) AS word FROM m),
        e AS (SELECT doc_id, n, i, sh FROM (SELECT doc_id, n, unnest(range(n - 7)) AS i, unnest(list_transform(range(1, n - 6), lambda i: array_to_string(ws[i : i + 7], ' '))) AS sh FROM m WHERE n >= 24)),
        j AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.sh = y.sh AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
        l AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM j),
        s AS (SELECT doc_id, min(i) AS start, count(*) + 7 + q AS length, q FROM l GROUP BY doc_id, q, island HAVING count(*) + 7 + q >= greatest(24, 3 * q)),
        r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
        b AS (SELECT doc_id, count(*) AS n_runs, first(struct_pack(start, length, period) ORDER BY length / period DESC, start, period) AS best,
            string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
        k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY w.doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
            sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
        FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op12_scaled_sketch": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS next, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
            FROM documents WINDOW w AS (ORDER BY doc_id DESC)),
        e AS (SELECT *, left(text, length(text) - length(text) // 2) || left(next, length(text) // 2) AS changed FROM d),
        t AS (SELECT doc_id, true AS own, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM e UNION ALL SELECT doc_id, false, regexp_extract_all(changed, '[^\\x20\\x09-\\x0D]+') FROM e),
        h AS (SELECT doc_id, own, CASE WHEN len(ws) = 0 THEN [] ELSE list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: left(md5(array_to_string(ws[i : i + 4], ' ')), 12)) END AS hs FROM t),
        k AS (SELECT doc_id, own, CASE WHEN len(list_filter(hs, lambda x: x < '4')) > 0 THEN list_sort(list_distinct(list_filter(hs, lambda x: x < '4'))) ELSE list_sort(hs)[1:1] END AS ks FROM h),
        r AS (SELECT d.doc_id, d.text, e.changed, o.ks AS own, n.ks AS new, x.ks AS other FROM d JOIN e ON e.doc_id = d.doc_id
            JOIN k o ON o.own AND o.doc_id = d.doc_id JOIN k n ON NOT n.own AND n.doc_id = d.doc_id JOIN k x ON x.own AND x.doc_id = d.next_id)
        SELECT doc_id, length(text) AS n_chars, sha256(changed) AS edited_sha256, array_to_string(own, '') AS fingerprint, array_to_string(new, '') AS edited_fingerprint,
            CASE WHEN len(own) > 0 AND len(new) > 0 THEN len(list_intersect(own, new)) / least(len(own), len(new)) ELSE CAST(len(own) = len(new) AS DOUBLE) END AS near_edited,
            CASE WHEN len(own) > 0 AND len(other) > 0 THEN len(list_intersect(own, other)) / least(len(own), len(other)) ELSE CAST(len(own) = len(other) AS DOUBLE) END AS near_next
        FROM r""",
    "op13_source_divergence": """
        WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
        t AS (SELECT lang, source, row, term, count(*) AS n FROM (SELECT lang, source, row, unnest(ts) AS term FROM d) GROUP BY ALL),
        k AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY ALL HAVING count(*) >= 10),
        l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, sum(n) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
        g AS (SELECT lang, source, coalesce(any_value(total), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) GROUP BY ALL),
        p AS (SELECT lang, source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * l.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * l.v) AS q
            FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(x.value), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
            ON x.lang = a.lang AND x.source = a.source AND x.item = b.source GROUP BY a.lang, a.source, b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM r QUALIFY part = 'pair' OR rank <= 10""",
}
