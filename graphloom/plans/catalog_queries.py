"""The catalog's primitives as named queries over the driver tables, each with the SQL that must agree."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from graphloom.operators import primitives as P
from graphloom.plans.kg import KG_SQL, KnowledgeGraph
from graphloom.plans.registry import register

#: "Today" of the driver's tables: 2024-01-31 as an epoch-day. The clock is never read.
TODAY = 19753
SUP, CUST, PART, USER = "Supplier#000000003", "Customer#000000007", "Part#5", "User#5"


def primitive(key: str, sql: str, fn, /, **params) -> None:
    # one pass over the branches that the primitive's filters leave; the stored graph, of all branches, is for loops
    register(key, KG_SQL + sql)(lambda spark, sf_dir: fn(KnowledgeGraph.from_tables(spark, sf_dir), **params))


_NOTID = "label NOT IN (SELECT t FROM idt)"
_LIVE = "(polarity IS NULL OR polarity <> 'negated')"

primitive("agg_count_entities", f"SELECT count(*) AS n FROM entities WHERE {_NOTID}", P.count_entities)
primitive("agg_count_relationships", "SELECT count(*) AS n FROM relations WHERE polarity = 'negated'", P.count_relationships, polarity="negated")
primitive("agg_distribution_by_type", "SELECT label AS type, count(*) AS n FROM entities GROUP BY 1", P.distribution_by_type)
primitive("agg_distribution_by_relation_type", "SELECT rel_type AS rel, count(*) AS n FROM relations GROUP BY 1", P.distribution_by_relation_type)
primitive("agg_distribution_by_polarity", "SELECT polarity, count(*) AS n FROM relations GROUP BY 1", P.distribution_by_polarity)
primitive(
    "agg_top_entities_by_mentions",
    f"""SELECT name, mentions FROM (SELECT name, label, mention_count AS mentions FROM entities WHERE {_NOTID} AND mention_count IS NOT NULL ORDER BY 3 DESC, 1 LIMIT 20)
    WHERE length(trim(name)) >= 2 AND lower(name) <> lower(label)""",
    P.top_entities_by_mentions,
)
primitive(
    "agg_top_entities_by_degree",
    f"""SELECT name, coalesce(d, 0) AS degree FROM entities LEFT JOIN (SELECT a, count(*) AS d FROM u WHERE {_LIVE} GROUP BY 1) ON name = a
    WHERE label = 'Organization' ORDER BY 2 DESC, 1 LIMIT 20""",
    P.top_entities_by_degree,
    type="Organization",
)
primitive(
    "conn_entity_dossier",
    f""", me AS (SELECT * FROM customer WHERE c_name = '{CUST}'), mine AS (SELECT ord.* FROM ord JOIN me ON o_custkey = c_custkey),
    met AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM mine) GROUP BY 1, 2),
    own AS MATERIALIZED (SELECT 'CONTACT' AS rel_type, s_name AS b, n::DOUBLE AS weight, concat_ws('|', 'CONTACT', '{CUST}', s_name, l_orderkey) AS rel_id, NULL::VARCHAR AS polarity, 'Organization' AS label FROM met JOIN supplier ON l_suppkey = s_suppkey
      UNION ALL SELECT 'PARTY_OF', oname, 1.0, concat_ws('|', 'PARTY_OF', '{CUST}', oname), NULL, 'OrderNumber' FROM mine
      UNION ALL SELECT 'AMOUNT_OF', money, 1.0, concat_ws('|', 'AMOUNT_OF', '{CUST}', money, o_orderkey), NULL, 'Amount' FROM mine
      UNION ALL SELECT 'MEMBER_OF', n_name, 1.0, concat_ws('|', 'MEMBER_OF', '{CUST}', n_name), NULL, 'Location' FROM me JOIN nation ON c_nationkey = n_nationkey),
    nb AS (SELECT * FROM own WHERE {_LIVE} AND {_NOTID} ORDER BY weight DESC, b, rel_id LIMIT 25), ids AS (SELECT label, b FROM own WHERE NOT {_NOTID} ORDER BY 1, 2 LIMIT 25),
    x AS (SELECT list(struct_pack(rel := rel_type, name := b, ntype := label, w := weight) ORDER BY weight DESC, b, rel_id) AS neighbors FROM nb),
    y AS (SELECT list(struct_pack(id_type := label, value := b) ORDER BY label, b) AS identifiers FROM ids),
    z AS (SELECT list(struct_pack(level := c.level, title := title) ORDER BY c.level, title) AS communities FROM in_community i JOIN communities c ON i.community_id = c.id AND i.level = c.level WHERE i.name = '{CUST}')
    SELECT c_name AS name, 'Person' AS label, 'Person ' || c_name AS description, (SELECT count(*) FROM mine) AS mention_count, neighbors, identifiers, communities FROM me, x, y, z""",
    P.entity_dossier,
    name=CUST,
)
primitive(
    "conn_neighbors_by_relation",
    f"SELECT b AS name, weight AS w, valid_from, valid_to FROM u WHERE a = '{SUP}' AND rel_type = 'SUPPLIES' AND polarity = 'affirmed' ORDER BY 2 DESC, 1, 3, 4 LIMIT 25",
    P.neighbors_by_relation,
    name=SUP,
    rel_type="SUPPLIES",
    polarity="affirmed",
)
primitive(
    "conn_cooccurrence",
    f"""SELECT o.entity_name AS name, count(DISTINCT o.chunk_id) AS shared FROM mentions o JOIN (SELECT DISTINCT chunk_id FROM mentions WHERE entity_name = '{PART}') m
    ON o.chunk_id = m.chunk_id WHERE o.entity_name <> '{PART}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""",
    P.cooccurrence,
    name=PART,
)
primitive(
    "conn_common_connections",
    f"""SELECT n.name, label AS type, v1 || v2 AS via FROM (SELECT b, list_sort(list(DISTINCT rel_type)) AS v1 FROM u WHERE a = 'Supplier#000000003' AND {_LIVE} GROUP BY 1) x
    JOIN (SELECT b, list_sort(list(DISTINCT rel_type)) AS v2 FROM u WHERE a = 'Supplier#000000005' AND {_LIVE} GROUP BY 1) y ON x.b = y.b JOIN entities n ON n.name = x.b
    WHERE n.name NOT IN ('Supplier#000000003', 'Supplier#000000005') ORDER BY len(v1 || v2) DESC, 1 LIMIT 25""",
    P.common_connections,
    a="Supplier#000000003",
    b="Supplier#000000005",
)
primitive(
    "conn_shared_identifier_entities",
    f"""SELECT i.name AS value, i.label AS id_type, list_sort(list(DISTINCT o.name)) AS owners FROM entities i JOIN u ON u.a = i.name JOIN entities o ON o.name = u.b
    WHERE i.label IN (SELECT t FROM idt) AND o.{_NOTID} GROUP BY 1, 2 HAVING count(DISTINCT o.name) >= 2 ORDER BY len(owners) DESC, 1, 2 LIMIT 25""",
    P.shared_identifier_entities,
)
primitive(
    "conn_identifier_lookup",
    f"""SELECT o.name, o.label, rel_type AS rel FROM entities i JOIN u ON u.a = i.name JOIN entities o ON o.name = u.b WHERE i.name = 'Order#7' AND i.label IN (SELECT t FROM idt) AND o.{_NOTID}""",
    P.identifier_lookup,
    value="Order#7",
)
primitive("comm_overview", "SELECT title, summary, member_count FROM communities WHERE level = 1 ORDER BY 3 DESC, 1 LIMIT 20", P.community_overview, level=1)
primitive(
    "comm_entity_communities",
    f"SELECT c.level, title, summary FROM in_community i JOIN communities c ON i.community_id = c.id AND i.level = c.level WHERE i.name = '{CUST}'",
    P.entity_communities,
    name=CUST,
)
primitive(
    "dyn_relationship_timeline",
    f"SELECT substr(valid_from, 1, 7) AS period, rel_type AS rel, b AS name, polarity FROM u WHERE a = '{SUP}' AND valid_from IS NOT NULL AND rel_type = 'SUPPLIES'",
    P.relationship_timeline,
    name=SUP,
    rel_type="SUPPLIES",
)
primitive(
    "dyn_whats_changed",
    """SELECT a AS name, rel_type AS rel, b AS other, polarity, valid_from, valid_to, created_at,
    CASE WHEN valid_from BETWEEN '1995-03' AND '1995-06' THEN 'appeared' WHEN valid_to BETWEEN '1995-03' AND '1995-06' THEN 'ended' ELSE 'first_seen' END AS change FROM u
    WHERE valid_from BETWEEN '1995-03' AND '1995-06' OR valid_to BETWEEN '1995-03' AND '1995-06' OR (valid_from IS NULL AND valid_to IS NULL AND created_at BETWEEN 9190 AND 9311)
    ORDER BY coalesce(valid_from, valid_to) NULLS LAST, a, b, rel_id LIMIT 200""",
    P.whats_changed,
    date_from="1995-03",
    date_to="1995-06",
    top_n=200,
)
for _g, _x in (("month", "strftime(DATE '1970-01-01' + doc_date_epoch::INT, '%Y-%m')"), ("week", "strftime(date_trunc('week', DATE '1970-01-01' + doc_date_epoch::INT), '%Y-%m-%d')")):
    primitive(
        "dyn_topic_trend" if _g == "month" else "dyn_entity_activity",
        f"SELECT {_x} AS period, count(DISTINCT chunk_id) AS mentions FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM mentions WHERE entity_name = '{PART}') GROUP BY 1",
        P.topic_trend,
        topic=PART,
        granularity=_g,
    )
primitive("dyn_polarity_evolution", "SELECT substr(valid_from, 1, 7) AS period, polarity, count(*) AS n FROM u WHERE valid_from IS NOT NULL GROUP BY 1, 2", P.polarity_evolution)
primitive(
    "ev_new_events",
    f""", x AS (SELECT name, label, created_at FROM entities WHERE created_at >= {TODAY - 14} ORDER BY 3 DESC, 1 LIMIT 200),
    y AS (SELECT src, rel_type, tgt, created_at, first_doc_id FROM relations WHERE created_at >= {TODAY - 14} ORDER BY created_at DESC, rel_id LIMIT 200)
    SELECT * FROM (SELECT name, label AS type, created_at, NULL::VARCHAR AS first_doc_id, 'entity' AS kind, NULL::VARCHAR AS src, NULL::VARCHAR AS rel, NULL::VARCHAR AS tgt FROM x
    WHERE {_NOTID} AND lower(name) <> lower(label) UNION ALL SELECT NULL, NULL, created_at, first_doc_id, 'edge', src, rel_type, tgt FROM y)
    ORDER BY created_at DESC, kind DESC, name NULLS FIRST, src NULLS FIRST, tgt, rel LIMIT 200""",
    P.new_events,
    today=TODAY,
    top_n=200,
)
primitive(
    "ev_entity_new_connections",
    f"SELECT rel_type AS rel, b AS other, created_at, first_doc_id FROM u WHERE a = '{USER}' AND created_at >= {TODAY - 21} ORDER BY 3 DESC, 2, rel_id LIMIT 20",
    P.entity_new_connections,
    name=USER,
    today=TODAY,
    window_days=21,
)
primitive(
    "ev_event_dossier",
    """SELECT name, event_type, NULL::VARCHAR AS event_ts_raw, event_start_epoch, event_start_epoch AS event_end_epoch, 'second' AS event_ts_precision,
    (SELECT list(struct_pack(actor_name := b, rel := rel_type) ORDER BY b, rel_type) FROM u WHERE a = 'Event#11') AS actors FROM entities WHERE name = 'Event#11' AND label = 'EventOrAction'""",
    P.event_dossier,
    name="Event#11",
)
primitive(
    "ev_event_timeline",
    f"""SELECT name, event_type, NULL::VARCHAR AS event_ts_raw, event_start_epoch, event_start_epoch AS event_end_epoch, 'second' AS event_ts_precision
    FROM u JOIN entities ON b = name WHERE a = '{USER}' AND rel_type = 'PARTICIPATED_IN' AND label = 'EventOrAction' ORDER BY 4 DESC NULLS LAST, 1 LIMIT 50""",
    P.event_timeline,
    entity=USER,
)
primitive(
    "ev_trending_events",
    f"""SELECT entity, event_type, recent, baseline_rate, burst_score FROM (SELECT *, recent / greatest(baseline_rate, 1.0) AS burst_score FROM (
    SELECT tgt AS entity, event_type, count(DISTINCT CASE WHEN e.created_at >= {TODAY - 7} THEN src END) AS recent, count(DISTINCT CASE WHEN e.created_at < {TODAY - 7} THEN src END) / 4.0 AS baseline_rate
    FROM relations r JOIN entities e ON r.src = e.name AND e.label = 'EventOrAction' WHERE rel_type = 'PARTICIPATED_IN' AND {_LIVE} AND e.created_at >= {TODAY - 35} GROUP BY 1, 2))
    WHERE recent >= 2 AND burst_score >= 1.0 ORDER BY burst_score DESC, recent DESC, entity, event_type LIMIT 20""",
    P.trending_events,
    today=TODAY,
)
primitive(
    "qual_contradictions",
    """SELECT p.src AS a, p.rel_type AS rel, p.tgt AS b, [p.first_doc_id] AS affirmed_chunks, [n.first_doc_id] AS negated_chunks FROM relations p JOIN relations n
    ON p.src = n.src AND p.tgt = n.tgt AND p.rel_type = n.rel_type AND p.polarity = 'affirmed' AND n.polarity = 'negated'
    WHERE (p.valid_from IS NULL OR n.valid_to IS NULL OR p.valid_from <= n.valid_to) AND (n.valid_from IS NULL OR p.valid_to IS NULL OR n.valid_from <= p.valid_to) ORDER BY 1, 2, 3 LIMIT 200""",
    P.contradictions,
    top_n=200,
)
primitive(
    "qual_orphans",
    f"""SELECT name, coalesce(d, 0) AS degree, label AS type FROM entities LEFT JOIN (SELECT a, count(*) AS d FROM u GROUP BY 1) ON name = a
    WHERE {_NOTID} AND coalesce(d, 0) < 3 ORDER BY 2, 1 LIMIT 100""",
    P.orphans,
    min_degree=3,
    top_n=100,
)
primitive(
    "qual_incomplete_entities",
    """SELECT e.name, list_filter(['Amount', 'OrderNumber', 'Email'], lambda x: NOT list_contains(have, x)) AS missing, have FROM (
    SELECT name, coalesce(list_sort(list(DISTINCT il) FILTER (WHERE il IS NOT NULL)), []::VARCHAR[]) AS have FROM entities LEFT JOIN (
      SELECT a, i.label AS il FROM u JOIN entities i ON u.b = i.name WHERE i.label IN ('Amount', 'OrderNumber', 'Email')) ON name = a WHERE label = 'Person' GROUP BY 1) e
    ORDER BY len(missing) DESC, 1 LIMIT 200""",
    P.incomplete_entities,
    type="Person",
    expected=("Amount", "OrderNumber", "Email"),
    top_n=200,
)


def _shouted(spark, sf_dir):
    """The graph with every person under a second name in capitals, so that there is something to merge."""
    kg = KnowledgeGraph.from_tables(spark, sf_dir)
    people = kg.entities.filter("label = 'Person'").withColumn("name", F.upper("name"))
    return dataclasses.replace(kg, entities=kg.entities.union(people))


for _n, _f in (("qual_merge_candidates", P.merge_candidates), ("sig_recommended_merges", P.recommended_merges)):
    register(
        _n,
        KG_SQL + f"""SELECT lower(trim(name)) AS key, list_sort(list(name)) AS names, count(*) AS count FROM (SELECT name, label FROM entities UNION ALL SELECT upper(name), label FROM entities WHERE label = 'Person')
        WHERE {_NOTID} GROUP BY 1 HAVING count(*) > 1 ORDER BY 3 DESC, 1 LIMIT 20""",
    )(lambda spark, sf_dir, f=_f: f(_shouted(spark, sf_dir)))


@register(
    "sig_review_queue",
    KG_SQL + """, ent AS (SELECT name, CASE label WHEN 'Person' THEN 'Organization' ELSE label END AS label FROM entities), v AS (SELECT * FROM u WHERE rel_type IN ('PARTY_OF', 'AMOUNT_OF'))
    SELECT a AS name, count(*) AS degree, 'shell_signal' AS flag FROM v JOIN ent o ON v.a = o.name AND o.label = 'Organization' JOIN ent n ON n.name = v.b
    GROUP BY 1 HAVING count(*) = count(*) FILTER (WHERE n.label IN (SELECT t FROM idt)) ORDER BY 2 DESC, 1 LIMIT 20""",
)
def _review_queue(spark, sf_dir):
    """Customers as organisations that are linked to orders and amounts alone."""
    kg = KnowledgeGraph.from_tables(spark, sf_dir)
    ent = kg.entities.withColumn("label", F.when(F.col("label") == "Person", "Organization").otherwise(F.col("label")))
    return P.review_queue(dataclasses.replace(kg, entities=ent, relations=kg.relations.filter("rel_type IN ('PARTY_OF', 'AMOUNT_OF')")))


primitive(
    "sig_circular_ownership",
    """, o AS (SELECT src, tgt, rel_id FROM relations WHERE rel_type = 'OWNS')
    SELECT [a.src, a.tgt, b.tgt, c.tgt, d.tgt] AS cycle FROM o a JOIN o b ON b.src = a.tgt JOIN o c ON c.src = b.tgt JOIN o d ON d.src = c.tgt WHERE d.tgt = a.src
    AND len(list_distinct([a.rel_id, b.rel_id, c.rel_id, d.rel_id])) = 4 ORDER BY len(cycle) DESC, cycle LIMIT 200""",
    P.circular_ownership,
    top_n=200,
)
primitive(
    "dom_issue_resolution_stats",
    """SELECT count(*) AS total_issues, count(r.a) AS resolved, count(*) - count(r.a) AS unresolved, round(count(r.a) / count(*)::DOUBLE, 4) AS resolution_rate
    FROM entities e LEFT JOIN (SELECT DISTINCT a FROM u WHERE rel_type = 'RESOLVED_BY') r ON e.name = r.a WHERE label = 'Issue'""",
    P.issue_resolution_stats,
)
primitive(
    "dom_communication_stats",
    """SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, rel_type AS rel, count(*) AS interactions FROM relations WHERE rel_type IN ('CONTACT', 'RESPONDED_TO') AND src <> tgt
    GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 50""",
    P.communication_stats,
    top_n=50,
)
primitive(
    "roll_numeric_rollup",
    """SELECT u.a AS counterparty, round(sum(TRY_CAST(replace(b, ' RUB', '') AS DOUBLE)), 2) AS total, count(*) AS count FROM u JOIN entities n ON n.name = u.b AND n.label = 'Amount'
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""",
    P.numeric_rollup,
    top_n=50,
)
