"""Stored indexes and sampled betweenness over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators.text_index import TextIndex, find_by_name_ranked
from graphloom.operators.trigram_index import TrigramIndex
from graphloom.operators.vector_index import VectorIndex
from graphloom.plans.data_queries import _BM25_SQL, _COS, _TRI, t
from graphloom.plans.kg import KG_SQL, KnowledgeGraph
from graphloom.plans.registry import register
from graphloom.session import shared_dir

DIMS = 64


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"


@register("vec_index_exact", f"SELECT y.vec_id, {_COS} AS score FROM embeddings x, embeddings y WHERE x.vec_id = 0 ORDER BY 2 DESC, 1 LIMIT 10")
def _exact(spark, sf):
    v = t(spark, sf, "embeddings")
    return VectorIndex.build(v, _folder(spark), DIMS).search_exact(v.filter("vec_id = 0").first()["embedding"]).withColumnRenamed("key", "vec_id")


#: A near copy of every vector stands under another id.
_FAR = 1_000_000_000


@register(
    "vec_index_planted",
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings),
    a AS (SELECT * FROM e UNION ALL SELECT vec_id + {_FAR}, list_transform(range(1, 65), lambda i: embedding[i] * (0.9 + 0.1 * (i % 3))) FROM e),
    s AS (SELECT x.vec_id AS query_id, y.vec_id AS id, {_COS} AS score FROM e x, a y WHERE x.vec_id % 50 = 0 AND x.vec_id <> y.vec_id)
    SELECT query_id, id, score FROM s WHERE score >= 0.95""",
)
def _planted(spark, sf):
    v = t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    index = VectorIndex.build(v, _folder(spark), DIMS)
    # the copies come later, as an insert
    index.insert(v.select((F.col("vec_id") + _FAR).alias("vec_id"), F.transform("embedding", lambda x, i: x * (0.9 + 0.1 * ((i + 1) % 3))).alias("embedding")))
    return index.search_within(v.filter("vec_id % 50 = 0"), 0.95).filter("id <> query_id").select("query_id", "id", "score")


@register("txt_index_bm25", _BM25_SQL)
def _text(spark, sf):
    return TextIndex.build(t(spark, sf, "documents"), _folder(spark)).search("License rights").withColumnRenamed("id", "doc_id")


@register(
    "ret_find_by_name_ranked",
    KG_SQL + r""", nm AS (SELECT DISTINCT name FROM entities), d AS (SELECT name, list_filter(regexp_split_to_array(lower(name), '[^\p{L}\p{N}_]+'), lambda w: w <> '') AS t FROM nm),
    f AS (SELECT name, len(t) AS n, len(list_filter(t, lambda w: w = 'supplier')) AS a, len(list_filter(t, lambda w: w = '000000003')) AS b FROM d),
    s AS (SELECT count(*) AS c, avg(n) AS av, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM f),
    r AS (SELECT name, ln(1 + (c - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / av)) + ln(1 + (c - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / av)) AS score FROM f, s),
    h AS (SELECT name, score FROM r WHERE score > 0 ORDER BY 2 DESC, 1 LIMIT 10)
    SELECT e.name, e.label, score FROM (SELECT DISTINCT name, label FROM entities) e JOIN h ON e.name = h.name ORDER BY 3 DESC, 1, 2 LIMIT 10""",
)
def _names(spark, sf):
    e = KnowledgeGraph.from_tables(spark, sf).entities
    return find_by_name_ranked(TextIndex.build(e.select("name").distinct(), _folder(spark), "name", "name"), e, "Supplier 000000003")


_NAMES = f"{KG_SQL}, x AS (SELECT DISTINCT name, label, {_TRI('name')} AS a, {_TRI(chr(39) + 'Suplier 00000003' + chr(39))} AS b FROM entities)"


@register("ret_trigram_similar", _NAMES + " SELECT name, label, len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE AS score FROM x WHERE len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE >= 0.4 ORDER BY 3 DESC, 1, 2 LIMIT 20")
def _similar(spark, sf):
    return TrigramIndex.build(KnowledgeGraph.from_tables(spark, sf).entities, _folder(spark)).similar("Suplier 00000003", 0.4)


@register(
    "ret_trigram_containing",
    KG_SQL + f", x AS (SELECT DISTINCT name, label, {_TRI('name')} AS a, {_TRI(chr(39) + 'ER#00000001' + chr(39))} AS b FROM entities WHERE contains(lower(name), 'er#00000001')) SELECT name, label, len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE AS score FROM x ORDER BY 3 DESC, 1, 2 LIMIT 20",
)
def _containing(spark, sf):
    return TrigramIndex.build(KnowledgeGraph.from_tables(spark, sf).entities, _folder(spark)).containing("ER#00000001")


@register("graph_betweenness_sampled")
def _between(spark, sf):
    """Of all relation types: every score within 0.05 * n * (n - 1) / 2 of the exact one, with a probability of 0.95."""
    return G.sampled_betweenness(G.build_graph(KnowledgeGraph.from_tables(spark, sf).relations))
