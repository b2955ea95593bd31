"""The upkeep operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import upkeep as U
from graphloom.plans.kg import KG_SQL, KnowledgeGraph
from graphloom.plans.registry import register

kg = KnowledgeGraph.from_tables


@register("up_graph_stats", KG_SQL + " SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM relations) AS relations, (SELECT count(*) FROM communities) AS communities, (SELECT count(*) FROM (SELECT lower(name) FROM entities GROUP BY 1 HAVING count(*) > 1)) AS duplicate_groups")
def _stats(spark, sf):
    return U.graph_stats(kg(spark, sf))


@register(
    "up_duplicate_groups",
    """WITH p AS (SELECT lower(p_name) AS key, p_brand AS label, count(*) AS k FROM part GROUP BY 1, 2) SELECT key, sum(k)::BIGINT AS n, list(label ORDER BY k DESC, label)[1:4] AS labels FROM p GROUP BY 1 HAVING sum(k) > 1""",
)
def _dups(spark, sf):
    return U.duplicate_groups(spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_name").alias("name"), F.col("p_brand").alias("label")))


@register(
    "up_member_context",
    KG_SQL + """, m AS (SELECT DISTINCT name FROM in_community WHERE community_id = 'n3' AND level = 1), r AS (SELECT a, list_sort(list(DISTINCT rel_type)) AS rels FROM u WHERE a IN (SELECT name FROM m) AND b IN (SELECT name FROM m) GROUP BY 1)
    SELECT m.name, label, coalesce(rels, []::VARCHAR[]) AS rels FROM m JOIN entities e ON e.name = m.name LEFT JOIN r ON r.a = m.name""",
)
def _context(spark, sf):
    return U.member_context(kg(spark, sf), "n3", 1)


@register("up_pick_group", "SELECT o_custkey AS channel, arg_min(o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'a' WHEN '5-LOW' THEN 'b' ELSE 'c' || o_orderpriority END) AS grp FROM orders GROUP BY 1")
def _group(spark, sf):
    return U.pick_group(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("channel"), F.col("o_orderpriority").alias("grp")), ["1-URGENT", "5-LOW"])


@register(
    "up_first_citations",
    """WITH c AS (SELECT DISTINCT 'Order#' || o_orderkey AS chunk_id, o_custkey::VARCHAR AS doc_id, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS doc_date_epoch FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey = 5)
    SELECT doc_id, chunk_id, doc_date_epoch FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY doc_date_epoch, chunk_id) = 1 ORDER BY doc_date_epoch, doc_id LIMIT 20""",
)
def _citations(spark, sf):
    return U.first_citations(kg(spark, sf), "Part#5")


@register("up_quota_used", "SELECT user_id, count(*) AS used FROM events WHERE ts::DATE = DATE '2024-01-10' GROUP BY 1")
def _quota(spark, sf):
    return U.quota_used(spark.read.parquet(f"{sf}/events.parquet"), "2024-01-10")


@register("up_mark_dirty", KG_SQL + " SELECT DISTINCT name FROM (SELECT name FROM entities WHERE label = 'Location' UNION SELECT src FROM relations WHERE rel_type = 'OWNS' UNION SELECT tgt FROM relations WHERE rel_type = 'OWNS')")
def _dirty(spark, sf):
    k = kg(spark, sf)
    return U.mark_dirty(k.entities.filter("label = 'Location'"), k.relations.filter("rel_type = 'OWNS'"))


@register(
    "up_subgraph_hash",
    KG_SQL + """ SELECT a AS name, sha256(array_to_string(list_sort(list(concat_ws('|', rel_type, b, coalesce(polarity, ''), coalesce(valid_from, ''), coalesce(valid_to, '')))), chr(31))) AS hash
    FROM u WHERE a IN (SELECT n_name FROM nation) GROUP BY 1""",
)
def _hashes(spark, sf):
    return U.subgraph_hash(kg(spark, sf), spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("name")))


@register("up_correct_labels", KG_SQL + " SELECT name, CASE WHEN lower(name) IN ('china', 'france', 'germany', 'india', 'iran', 'japan', 'russia', 'romania') THEN 'Location' ELSE 'Organization' END AS label FROM entities WHERE label = 'Location'")
def _labels(spark, sf):
    e = kg(spark, sf).entities.filter("label = 'Location'").withColumn("label", F.lit("Organization"))
    return U.correct_labels(e).select("name", "label")
