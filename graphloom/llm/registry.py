"""The corpus operators as named queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k FROM w, unnest(range(1, len(ws) - 6)) AS u(i) WHERE len(ws) >= 8),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM dup, unnest(range(0, 8)) AS u(o) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT w.rid, doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  n_symbols * 100 > n_words * 30 OR n_dup_lines * 100 > n_lines * 30 OR word_chars < n_words * 2 OR word_chars > n_words * 20 AS soft_failed FROM m),
h AS (SELECT source, count(*) AS n, sum((base_failed OR soft_failed)::BIGINT)::DOUBLE AS f FROM j GROUP BY source),
s AS (SELECT least(greatest(sum(f) / sum(n), 1e-6), 1 - 1e-6) AS mean, count(*) AS k,
  greatest(sum((f / n) * (f / n)) / count(*) - power(sum(f / n) / count(*), 2), 0) AS spread, sum(1.0 / n) / count(*) AS inv FROM h),
q AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(spread - mean * (1 - mean) * inv, 1e-12) - 1, 2.0), 1000.0) AS a FROM s),
r AS (SELECT source, (f + mean * a) / (n + a) AS rate, least(0.5, mean + 2.0 * sqrt(mean * (1 - mean) / (a + 1))) AS cut FROM h, q),
v AS (SELECT source, rate > cut AS host_rejected, 1 + 0.5 * greatest(0.0, 1 - rate / 0.5) AS x FROM r),
k AS (SELECT j.*, host_rejected, (host_rejected AND soft_failed) OR n_symbols * 100 > n_words * 30 * x OR n_dup_lines * 100 > n_lines * 30 * x
  OR word_chars * x < n_words * 2 OR word_chars > n_words * 20 * x AS rejected FROM j JOIN v ON j.source IS NOT DISTINCT FROM v.source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, soft_failed, host_rejected, NOT base_failed AND NOT rejected AS kept
FROM k
"""


@_query("op7_host_quality", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.host_quality import QualityParams, score_documents

    # as in the pipeline, a document of any host goes that breaks a soft rule by far; how far, its host's rate says
    return score_documents(table(spark, sf_dir, "documents"), params=QualityParams(doc_slack=0.5)).drop("host_rate")


@_query("op8_temperature_mix")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.temperature_mix import MixParams, mix_plan

    # near uniform weights, as far as no document is seen more than twice
    return mix_plan(table(spark, sf_dir, "documents"), params=MixParams(target_entropy=0.9999))


@_query("op9_sampled_splitters")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.sampled_splitters import shard_digest

    placed = shard_digest(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@_query("op4_setsketch")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.setsketch import SketchParams, near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "documents"), params=SketchParams(shingle=3, threshold_pct=85))


@_query("op1_tag_paths")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.tag_paths import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


@_query("op3_license_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@_query("op6_ftrl_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.ftrl_toxicity import fit_and_score

    return fit_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op10_simhash_leaks")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.simhash_leaks import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP5_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
l AS (SELECT d, max(page_id) AS lead FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN lead IS NOT NULL AND page_id IS DISTINCT FROM lead THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN lead IS NOT NULL AND page_id IS DISTINCT FROM lead THEN lead END AS refers_to, url AS target_uri
FROM p LEFT JOIN l ON p.d = l.d
"""


@_query("op5_warc", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


@_query("op2_line_templates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.line_templates import drop_recurring_lines

    return drop_recurring_lines(table(spark, sf_dir, "documents"))


@_query("op11_piece_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm.piece_bpe import token_digests

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS bad FROM labels GROUP BY 1),
b AS (SELECT part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
  regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS f, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM b GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [p.i, q.i, r.i, s.i, u.i] AS ord FROM x p, x q, x r, x s, x u WHERE len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5),
k AS (SELECT ord, unnest(range(1, 6)) AS step FROM o),
g AS (SELECT part, ord, step, f[ord[step]] AS fails, len(list_filter(ord[1:step - 1], lambda z: f[z])) > 0 AS gone, len(list_filter(f, lambda z: z)) = 1 AS single, n, good, bad FROM m, k),
a AS (SELECT part, ord, step, sum(n) FILTER (WHERE NOT fails AND NOT gone) AS kept, sum(n) FILTER (WHERE fails AND NOT gone) AS removed, sum(n) FILTER (WHERE fails AND gone) AS redundant,
  sum(n) FILTER (WHERE fails AND single) AS unique_fails, sum(good) FILTER (WHERE fails AND NOT gone) AS good_lost, sum(bad) FILTER (WHERE fails AND NOT gone) AS toxic_lost FROM g GROUP BY 1, 2, 3)
SELECT part, array_to_string(list_transform(ord, lambda z: 'ABCDE'[z]), '') AS filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, ord[step]), 0)::BIGINT AS shapley FROM a
"""


@_query("op12_filter_audit", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.filter_audit import audit_filters

    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op13_sql(rounds: int = 5) -> str:
    near = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - w[i]) * (v[i] - w[i])))"
    out = """WITH raw AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
k AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(e, lambda x: floor(256 * x)::HUGEINT) AS v FROM raw WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS w FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM k ORDER BY 1, 2 LIMIT 40))"""
    for r in range(rounds + 1):
        out += f""",
a{r} AS MATERIALIZED (SELECT rid, (min((d, c))).c AS c, (min((d, c))).d AS d FROM (SELECT rid, {{'d': {near}, 'c': c}} AS p FROM k, c{r}) GROUP BY rid)"""
        out = out.replace("(min((d, c))).c AS c, (min((d, c))).d AS d", "min(p).c AS c, min(p).d AS d")
        if r < rounds:
            out += f""",
s{r} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM k JOIN a{r} USING (rid), range(1, 65) AS u(i) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(list((s - ((s % n) + n) % n) // n ORDER BY i) FILTER (WHERE n IS NOT NULL), any_value(w)) AS w FROM c{r} LEFT JOIN s{r} USING (c) GROUP BY c)"""
    return out + f"""
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(w, ',')) AS centroid_sha256 FROM k JOIN a{rounds} USING (rid) JOIN c{rounds} USING (c)
"""


@_query("op13_sort_means", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.sort_means import cluster_digest

    return cluster_digest(table(spark, sf_dir, "embeddings"))
