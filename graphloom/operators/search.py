"""Search as compositions: graph search, neighbours, retrieval of sub-questions, community selection and drift."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import tolerant_json
from graphloom.operators import graph as G
from graphloom.operators import retrieval as R
from graphloom.plans.kg import KnowledgeGraph


def entity_knn(entities: DataFrame, query: Sequence[float], k: int = 10, label: str | None = None) -> DataFrame:
    """(name, score): the nearest entities that stand for themselves (merged ones, which have a canonical name, do not count)."""
    e = entities.filter("er_canonical_name IS NULL AND er_vec IS NOT NULL")
    if label is not None:
        e = e.filter(F.col("label") == label)
    return R.knn(e, query, k, "name", "er_vec")


def community_knn(reports: DataFrame, query: Sequence[float], level: int, k: int = 10) -> DataFrame:
    """(id, level, summary, score): the reports of a level nearest to a query; reports without a summary do not count."""
    r = reports.filter((F.col("level") == level) & (F.trim(F.coalesce("summary", F.lit(""))) != ""))
    near = R.knn(r, query, k, "id", "embedding")
    return near.join(r.select("id", "level", "summary"), "id").select("id", "level", "summary", "score").orderBy(F.desc("score"), "id")


def graph_search(kg: KnowledgeGraph, text: str, query: Sequence[float] | None = None, k: int = 5, depth: int = 2, now: str | None = None, max_nodes: int = 50) -> tuple[DataFrame, DataFrame]:
    """Entities (name, label, hop) and relations around the entities that match a query by vector or by name, no entity twice.

    Depth is at most 3, as in :func:`graph_walk`; the seeds are k by vector (if a query vector is given) and k by name.
    """
    seeds = R.find_by_name(kg.entities, text, k).select("name")
    if query is not None:
        seeds = entity_knn(kg.entities, query, k).select("name").union(seeds)
    # 2 * k names at most
    nodes, edges = G.graph_walk(kg, [r["name"] for r in seeds.collect()], depth, now=now, max_nodes=max_nodes)
    return nodes.join(kg.entities.select("name", "label"), "name", "left").select("name", "label", "hop").orderBy("hop", "name"), edges


def find_neighbours(kg: KnowledgeGraph, entity: str, hops: int = 1, max_nodes: int = 50) -> DataFrame:
    """(name, label, hop) of what lies within some hops of an entity."""
    nodes = G.graph_walk(kg, entity, hops, max_nodes=max_nodes + 1)[0].filter("hop > 0")
    # at most max_nodes names, so that the filter reaches the tables of each label
    labels = kg.entities.filter(F.col("name").isin([r["name"] for r in nodes.collect()])).select("name", "label")
    return nodes.join(labels, "name", "left").select("name", "label", "hop").orderBy("hop", "name").limit(max_nodes)


def find_entity_by_id(entities: DataFrame, name: str, type: str | None = None) -> DataFrame:
    """The entity of exactly this name; a type is compared without case."""
    e = entities.filter(F.col("name") == name)
    return e if type is None else e.filter(F.lower("label") == type.strip().lower())


def filter_by_metadata(sources: DataFrame, doc_id=None, department: str | None = None, doc_type: str | None = None) -> DataFrame:
    """(chunk_id, doc_id) of the sources that have the given values; an empty wish does not filter."""
    for column, value in (("doc_id", doc_id), ("department", department), ("doc_type", doc_type)):
        if value not in (None, ""):
            sources = sources.filter(F.col(column) == value)
    return sources.select("chunk_id", "doc_id")


def retrieve(
    questions: DataFrame, chunks: DataFrame, kg: KnowledgeGraph, k: int = 10, since: int | None = None, until: int | None = None, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None
) -> DataFrame:
    """(question_id, chunk_id, via, rank) for all sub-questions at once: chunks near by vector, then chunks that mention an entity named in the question.

    questions: question_id, text, embedding; chunks: chunk_id, embedding, doc_date_epoch, doc_group. Dates and groups filter before the
    cut, and of a chunk found both ways the vector's place stays. Entities are matched by their whole name, of however many words,
    among the question's runs of words, so the match is a join on names and not a scan of them.
    """
    live = R.group_filter(R.date_filter(chunks, "doc_date_epoch", since, until), "doc_group", include, exclude)
    q = questions.select(F.col("question_id").alias("vec_id"), "embedding")
    near = R.knn_join(q, live.select(F.col("chunk_id").alias("vec_id"), "embedding"), k)
    by_vector = near.select(F.col("query_id").alias("question_id"), F.col("id").alias("chunk_id"), F.lit("vector").alias("via"), "rank")
    # runs of as many words as the longest name has; names are compared with single spaces
    spaced = F.regexp_replace(F.trim("entity_name"), r"\s+", " ")
    longest = kg.mentions.agg(F.max(F.size(F.split(spaced, " ")))).first()[0] or 1
    words = F.filter(F.split(F.trim(F.col("text")), r"[\s,;?!()]+"), lambda w: w != "")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: i + n <= F.size("w") + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    asked = questions.select("question_id", words.alias("w")).select("question_id", F.explode(F.array_distinct(runs)).alias("spaced"))
    named = kg.mentions.withColumn("spaced", spaced).join(asked, "spaced").join(live.select("chunk_id"), "chunk_id", "left_semi")
    named = named.groupBy("question_id", "chunk_id").agg(F.countDistinct("entity_name").alias("n"))
    ranked = named.groupBy("question_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "chunk_id"))), 1, k).alias("top"))
    by_name = ranked.select("question_id", F.posexplode("top").alias("p", "x")).select("question_id", "x.chunk_id", F.lit("graph").alias("via"), (F.col("p") + 1).alias("rank"))
    both = by_vector.withColumn("block", F.lit(0)).union(by_name.withColumn("block", F.lit(1)))
    return R.first_per(both, ["question_id", "chunk_id"], "block", "rank").drop("block")


def parse_subquestions(reply: str | None, original: str, most: int = 5) -> list[str]:
    """Sub-questions of a planner's reply: a JSON array, also in prose or cut off, else its lines without list marks; fewer than two mean the question itself."""
    text = (reply or "").strip()
    items = tolerant_json.loads(text) if "[" in text else None
    found = [str(x).strip() for x in items if str(x).strip()] if isinstance(items, list) else []
    if len(found) < 2:
        found = [x for x in (re.sub(r"^\s*(?:[-*•]|\d+[.)])\s*", "", line).strip() for line in text.splitlines()) if x]
    return found[:most] if len(found) >= 2 else [original]


def coverage_gap(complete: bool, missing: str | None, rounds_left: int) -> str | None:
    """What one more round should look for: the gap that was named, if the evidence is incomplete and a round is left."""
    gap = (missing or "").strip()
    return gap if gap and rounds_left > 0 and not complete else None


def drift(hits: DataFrame, kg: KnowledgeGraph, level: int = 0, budget: int = 5) -> DataFrame:
    """(id, title, summary, seeds): communities that the entities in the local hits belong to, those with the most first."""
    seeds = kg.mentions.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi").select(F.col("entity_name").alias("name")).distinct()
    c = kg.in_community.filter(F.col("level") == level).join(seeds, "name").groupBy(F.col("community_id").alias("id")).agg(F.count(F.lit(1)).alias("seeds"))
    return kg.communities.filter(F.col("level") == level).join(c, "id").select("id", "title", "summary", "seeds").orderBy(F.desc("seeds"), "id").limit(budget)


# Word parts that tell a question about trends.
TREND_WORDS = (
    "тренд", "в тренде", "трендах", "trending", "популярн", "упомин", "самое обсуждаемое", "обсуждаем", "на слуху", "хайп", "burst", "surge",
    "most mentioned", "most talked", "most discussed", "hot topic", "hottest",
)


def is_trend_question(question: str | None) -> bool:
    return any(w in (question or "").lower() for w in TREND_WORDS)
