"""Graph algorithms and the reads of their materialised results, over the driver tables."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import primitives as P
from graphloom.plans import materialize as M
from graphloom.plans.catalog_queries import CUST, TODAY
from graphloom.plans.kg import KG_SQL, KnowledgeGraph
from graphloom.plans.registry import register

#: Each of these passes over the tables once or twice (loops keep an edge table of their own), so the graph is not stored first.
kg = KnowledgeGraph.from_tables
#: Production rounds of the rank iterations.
PAGERANK_ROUNDS, EIGENVECTOR_ROUNDS = 20, 30
_GRAPH_SQL = """,
g AS MATERIALIZED (SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, sum(coalesce(weight, 1.0)) AS w FROM relations WHERE src <> tgt GROUP BY 1, 2),
bo AS MATERIALIZED (SELECT a, b, w FROM g UNION ALL SELECT b, a, w FROM g), tot AS (SELECT a, sum(w) AS t FROM bo GROUP BY 1), sh AS MATERIALIZED (SELECT bo.a, b, w / t AS p FROM bo JOIN tot ON bo.a = tot.a),
nm AS MATERIALIZED (SELECT DISTINCT a AS name FROM bo)"""


def _graph(k: KnowledgeGraph, types=None):
    return G.build_graph(k.relations if types is None else k.relations.filter(F.col("rel_type").isin(*types)))


def _rank_sql(start: str, rounds: int) -> str:
    out = f"{_GRAPH_SQL}, tp AS ({start}), r0 AS (SELECT name, v AS score FROM tp)"
    for i in range(rounds):
        out += f""", r{i + 1} AS (SELECT tp.name, 0.15 * tp.v + 0.85 * coalesce(f.s, 0) AS score FROM tp LEFT JOIN (SELECT sh.b, sum(r.score * p) AS s FROM sh JOIN r{i} r ON r.name = sh.a GROUP BY 1) f ON f.b = tp.name)"""
    return out


_PR = _rank_sql("SELECT name, 1.0 / (SELECT count(*) FROM nm) AS v FROM nm", PAGERANK_ROUNDS)
_PPR = _rank_sql("SELECT name, CASE WHEN name IN ('Supplier#000000003', 'Supplier#000000005') THEN 0.5 ELSE 0.0 END AS v FROM nm", PAGERANK_ROUNDS)


@register("central_pagerank", KG_SQL + _PR + " SELECT name, score FROM r20 ORDER BY round(score, 12) DESC, name LIMIT 20")
def _pagerank(spark, sf):
    return G.pagerank(_graph(kg(spark, sf))).orderBy(F.desc(F.round("score", 12)), "name").limit(20)


@register("comm_personalized_pagerank", KG_SQL + _PPR + " SELECT name, score FROM r20 ORDER BY round(score, 12) DESC, name LIMIT 20")
def _ppr(spark, sf):
    r = G.pagerank(_graph(kg(spark, sf)), seeds=["Supplier#000000003", "Supplier#000000005", "no such node"])
    return r.orderBy(F.desc(F.round("score", 12)), "name").limit(20)


@register(
    "comm_top_central_entities",
    KG_SQL + _PR + " SELECT r20.name, score FROM r20 JOIN entities e ON e.name = r20.name AND label = 'Organization' ORDER BY round(score, 12) DESC, 1 LIMIT 20",
)
def _central(spark, sf):
    k = kg(spark, sf)
    scores = G.pagerank(_graph(k)).select("name", F.round("score", 12).alias("pagerank"))
    return P.top_central_entities(dataclasses.replace(k, scores=scores), "pagerank", "Organization")


_EIG = _GRAPH_SQL + ", x0 AS (SELECT name, 1.0::DOUBLE AS score FROM nm)"
for _i in range(EIGENVECTOR_ROUNDS):
    _EIG += f""", y{_i} AS MATERIALIZED (SELECT x.name, x.score + f.s AS score FROM x{_i} x JOIN (SELECT bo.b, sum(r.score * w) AS s FROM bo JOIN x{_i} r ON r.name = bo.a GROUP BY 1) f ON f.b = x.name),
    x{_i + 1} AS (SELECT name, score / (SELECT max(score) FROM y{_i}) AS score FROM y{_i})"""


@register("central_eigenvector", KG_SQL + _EIG + " SELECT name, score FROM x30 ORDER BY round(score, 12) DESC, name LIMIT 20")
def _eigen(spark, sf):
    return G.eigenvector(_graph(kg(spark, sf))).orderBy(F.desc(F.round("score", 12)), "name").limit(20)


_COMP = r"""WITH RECURSIVE e AS (SELECT s_name AS a, (SELECT y.s_name FROM supplier y WHERE y.s_suppkey = CASE WHEN x.s_suppkey = (SELECT max(z.s_suppkey) FROM supplier z WHERE z.s_suppkey // 4 = x.s_suppkey // 4)
  THEN (SELECT min(z.s_suppkey) FROM supplier z WHERE z.s_suppkey // 4 = x.s_suppkey // 4) ELSE x.s_suppkey + 1 END) AS b FROM supplier x
  UNION ALL SELECT 'Event#' || event_id, 'User#' || user_id FROM events),
u AS (SELECT DISTINCT a, b FROM e WHERE a <> b UNION SELECT DISTINCT b, a FROM e WHERE a <> b),
r(name, label) AS (SELECT a, a FROM u UNION SELECT u.b, r.label FROM r JOIN u ON u.a = r.name AND r.label <= u.b),
c AS (SELECT name, min(label) AS component FROM r GROUP BY 1)"""


@register("graph_components", _COMP + " SELECT name, component FROM c")
def _components(spark, sf):
    return G.components(_component_edges(spark, sf))


def _component_edges(spark, sf):
    # parallel edges are not summed: components need no weights
    return kg(spark, sf).relations.filter(F.col("rel_type").isin("OWNS", "PARTICIPATED_IN")).select(F.col("src").alias("a"), F.col("tgt").alias("b"))


@register(
    "graph_component_sizes",
    _COMP + """, z AS (SELECT count(*) AS size FROM c GROUP BY component), o AS (SELECT size, row_number() OVER (ORDER BY size) - 1 AS i, count(*) OVER () AS n FROM z)
    SELECT count(*) AS components, min(size) AS min, max(size) AS max, avg(size) AS mean, max(size) FILTER (WHERE i = round_even(0.5 * (n - 1), 0)) AS p50,
    max(size) FILTER (WHERE i = round_even(0.9 * (n - 1), 0)) AS p90, max(size) FILTER (WHERE i = round_even(0.99 * (n - 1), 0)) AS p99 FROM o""",
)
def _sizes(spark, sf):
    return G.component_sizes(G.component_counts(_component_edges(spark, sf)))


@register(
    "conn_path",
    KG_SQL + f""", s AS (SELECT a, b, min(rel_type) AS rel FROM u WHERE a <> b GROUP BY 1, 2)
    SELECT ['{CUST}', x.b, y.b] AS path, [x.rel, y.rel] AS rels, 2 AS hops FROM s x JOIN s y ON y.a = x.b WHERE x.a = '{CUST}' AND y.b = (
      SELECT r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_name = '{CUST}') ORDER BY x.b LIMIT 1""",
)
def _path(spark, sf):
    k = kg(spark, sf)
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    home = t("customer").filter(F.col("c_name") == CUST).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name").first()
    return G.shortest_path(k, CUST, home[0] if home else "")


@register(
    "graph_walk",
    KG_SQL + """, l AS (SELECT a, b FROM u WHERE polarity IS NULL OR polarity <> 'negated'), n1 AS (SELECT DISTINCT b AS name FROM l WHERE a = 'Order#7' AND b <> 'Order#7' ORDER BY 1 LIMIT 50),
    n2 AS (SELECT DISTINCT b AS name FROM l WHERE a IN (SELECT name FROM n1) AND b NOT IN (SELECT name FROM n1) AND b <> 'Order#7' ORDER BY 1 LIMIT 50)
    SELECT * FROM (SELECT 'Order#7' AS name, 0 AS hop UNION ALL SELECT name, 1 FROM n1 UNION ALL SELECT name, 2 FROM n2) ORDER BY hop, name LIMIT 50""",
)
def _walk(spark, sf):
    return G.graph_walk(kg(spark, sf), "Order#7", 2)[0]


@register(
    "graph_degree_stats",
    KG_SQL + """, g AS (SELECT DISTINCT least(src, tgt) AS a, greatest(src, tgt) AS b FROM relations WHERE src <> tgt),
    d AS (SELECT name, count(x) AS d FROM (SELECT DISTINCT name FROM entities) LEFT JOIN (SELECT a AS x FROM g UNION ALL SELECT b FROM g) ON name = x GROUP BY 1)
    SELECT count(*) AS nodes, (sum(d) / 2)::BIGINT AS edges, avg(d) AS avg_degree, quantile_cont(d, 0.5) AS p50, quantile_cont(d, 0.99) AS p99, max(d) AS max_degree FROM d""",
)
def _degrees(spark, sf):
    k = kg(spark, sf)
    return G.degree_stats(_graph(k), k.entities)


def _baskets(spark, sf):
    m = kg(spark, sf).mentions
    return m.select(F.col("chunk_id").alias("src"), F.col("entity_name").alias("tgt"), F.lit(1.0).alias("weight"))


_SIM = KG_SQL + """, m AS (SELECT DISTINCT chunk_id AS a, entity_name AS b FROM mentions UNION SELECT DISTINCT entity_name, chunk_id FROM mentions), d AS (SELECT a, count(*) AS n FROM m GROUP BY 1),
  i AS (SELECT x.a AS a, y.a AS b, count(*) AS k FROM m x JOIN m y ON x.b = y.b AND x.a <> y.a GROUP BY 1, 2),
  s AS (SELECT i.a, i.b, k / (p.n + q.n - k)::DOUBLE AS score FROM i JOIN d p ON p.a = i.a JOIN d q ON q.a = i.b WHERE k / (p.n + q.n - k)::DOUBLE >= 0.5),
  t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 10)"""


@register("graph_node_similarity", _SIM + " SELECT a, b, score FROM t")
def _similarity(spark, sf):
    return G.node_similarity(G.build_graph(_baskets(spark, sf)))


@register("comm_link_prediction", _SIM + ", z AS (SELECT CASE WHEN a = (SELECT min(a) FROM t) THEN b END AS name, score FROM t UNION ALL SELECT CASE WHEN b = (SELECT min(a) FROM t) THEN a END, score FROM t) SELECT name, max(score) AS score FROM z WHERE name IS NOT NULL GROUP BY 1")
def _links(spark, sf):
    links = M.likely_links(_baskets(spark, sf))
    name = links.agg(F.min("a")).first()[0] or ""
    return P.link_prediction(dataclasses.replace(kg(spark, sf), likely_links=links), name)


@register("graph_betweenness")
def _between(spark, sf):
    """Of organisations, persons and places: exact betweenness of all relation types takes a search from every node (see the README)."""
    return G.betweenness(_graph(kg(spark, sf), ("OWNS", "MEMBER_OF")))


@register("graph_communities")
def _communities(spark, sf):
    return G.community_levels(G.communities(_graph(kg(spark, sf))))[0]


_RISK = KG_SQL + f""", nb AS (SELECT a, b, polarity, u.created_at, label IN (SELECT t FROM idt) AS bid FROM u JOIN entities n ON n.name = u.b),
x AS (SELECT e.name, coalesce(id_links, 0) AS id_links, coalesce(deg, 0) AS deg, coalesce(contested, 0) AS contested, coalesce(recent, 0) AS recent FROM entities e LEFT JOIN (
  SELECT a, count(DISTINCT CASE WHEN bid THEN b END) AS id_links, count(*) AS deg, count(*) FILTER (WHERE polarity IN ('negated', 'uncertain')) AS contested, count(*) FILTER (WHERE created_at >= {TODAY - 14}) AS recent
  FROM nb GROUP BY 1) q ON q.a = e.name WHERE label NOT IN (SELECT t FROM idt)),
c AS (SELECT name, CASE WHEN id_links >= 2 THEN 1.0 ELSE 0.0 END AS affiliation, contested / greatest(deg, 1)::DOUBLE AS controversy, least(recent / greatest(deg, 1)::DOUBLE, 1.0) AS volatility,
  CASE WHEN id_links > 0 AND deg <= id_links THEN 1.0 ELSE 0.0 END AS opacity FROM x),
risk AS (SELECT *, round(affiliation * 0.3 + controversy * 0.2 + volatility * 0.15 + opacity * 0.15, 6) AS score FROM c)"""


def _scored(spark, sf):
    k = kg(spark, sf)
    r = M.compute_risk(M.risk_inputs(k, TODAY - 14)).withColumn("completeness_score", F.lit(None).cast("double"))
    return dataclasses.replace(k, scores=r)


@register(
    "sig_risk_score",
    _RISK + " SELECT name, score, CASE WHEN score >= 0.66 THEN 'high' WHEN score >= 0.33 THEN 'medium' ELSE 'low' END AS band, round(controversy, 6) AS controversy FROM risk ORDER BY score DESC, name LIMIT 20",
)
def _risk(spark, sf):
    r = P.risk_score(_scored(spark, sf))
    return r.select("name", "score", "band", F.round(F.coalesce(F.try_element_at("components", F.lit("controversy")), F.lit(0.0)), 6).alias("controversy"))


@register("sig_investigate_next", _RISK + " SELECT name, score AS risk, 0.0 AS completeness FROM risk ORDER BY 2 DESC, 3, 1 LIMIT 20")
def _investigate(spark, sf):
    return P.investigate_next(_scored(spark, sf))


@register(
    "ev_alerts",
    KG_SQL + f""", w AS (SELECT s_name FROM supplier WHERE s_acctbal > 9000), d AS (SELECT a AS entity, rel_type || '|' || b AS detail, max(created_at) AS created_at FROM u WHERE created_at >= 9990 AND a IN (SELECT s_name FROM w) GROUP BY 1, 2),
    k AS (SELECT 'new_connection:' || entity || ':' || detail AS alert_key, * FROM d ORDER BY created_at DESC, 1 LIMIT 200)
    SELECT alert_key, 'new_connection' AS kind, entity, detail, created_at, 1.0 AS score FROM k ORDER BY created_at DESC, alert_key LIMIT 50""",
)
def _alerts(spark, sf):
    k = kg(spark, sf)
    watched = spark.read.parquet(f"{sf}/supplier.parquet").filter("s_acctbal > 9000").select(F.col("s_name").alias("name"))
    return P.alerts(dataclasses.replace(k, alerts=M.detect_alerts(k, watched, 9990)))
