"""The catalog's analytical primitives: (graph, parameters) -> DataFrame.

Rows are cut to ``top_n`` by a total order: the ranking, then names. Edges are undirected unless said
otherwise; negated edges are left out where a primitive reads live relations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.plans.kg import KnowledgeGraph
from graphloom.schema import EXPECTED_IDS, clamp_top_n
from graphloom.session import reliable_checkpoint

SECONDS_A_DAY = 86_400


def _top(df: DataFrame, n: int | None, *order, default: int = 20) -> DataFrame:
    return df.orderBy(*order).limit(clamp_top_n(n, default))


def _entities(kg: KnowledgeGraph, type: str | None = None, exclude_identifiers: bool = False) -> DataFrame:
    e = kg.entities
    if type is not None:
        e = e.filter(F.col("label") == type)
    return e.filter(~S.is_identifier(F.col("label"))) if exclude_identifiers else e


def _labels(kg: KnowledgeGraph, name: str, label: str) -> DataFrame:
    return kg.entities.select(F.col("name").alias(name), F.col("label").alias(label))


def _edges_of(kg: KnowledgeGraph, name: str) -> DataFrame:
    """The edges of one entity, from its side; the filter reaches both halves of the union."""
    return kg.undirected.filter(F.col("a") == name)


def name_ranges(entities: DataFrame) -> list[tuple[str, str]]:
    """The first and the last name of each label; a row a label."""
    found = entities.filter("name IS NOT NULL").groupBy("label").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).collect()
    return sorted((r["lo"], r["hi"]) for r in found)


def may_be_named(col, ranges: list[tuple[str, str]]):
    """Whether a name lies in one of the ranges. As a filter on an end of ``kg.undirected`` it reaches the tables of each relation
    type, so types whose ends lie elsewhere are neither grouped nor joined; the join with the names themselves follows."""
    out = F.lit(False)
    for lo, hi in ranges:
        out = out | col.between(lo, hi)
    return out


# -- aggregations and rankings


def count_entities(kg: KnowledgeGraph, type: str | None = None, exclude_identifiers: bool = True) -> DataFrame:
    return _entities(kg, type, exclude_identifiers).agg(F.count(F.lit(1)).alias("n"))


def _relations(kg: KnowledgeGraph, rel_type: str | None = None, polarity: str | None = None) -> DataFrame:
    r = kg.relations
    if rel_type is not None:
        r = r.filter(F.col("rel_type") == rel_type)
    return r.filter(F.col("polarity") == polarity) if polarity is not None else r


def count_relationships(kg: KnowledgeGraph, rel_type: str | None = None, polarity: str | None = None) -> DataFrame:
    return _relations(kg, rel_type, polarity).agg(F.count(F.lit(1)).alias("n"))


def distribution_by_type(kg: KnowledgeGraph, exclude_identifiers: bool = False) -> DataFrame:
    return _entities(kg, None, exclude_identifiers).groupBy(F.col("label").alias("type")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def distribution_by_relation_type(kg: KnowledgeGraph) -> DataFrame:
    return kg.relations.groupBy(F.col("rel_type").alias("rel")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rel")


def distribution_by_polarity(kg: KnowledgeGraph, rel_type: str | None = None) -> DataFrame:
    return _relations(kg, rel_type).groupBy("polarity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "polarity")


def top_entities_by_mentions(kg: KnowledgeGraph, type: str | None = None, top_n: int = 20, exclude_identifiers: bool = True) -> DataFrame:
    """Meaningless names are dropped after the cut, so fewer than top_n rows may be left."""
    e = _entities(kg, type, exclude_identifiers).filter("mention_count IS NOT NULL")
    cut = _top(e.select("name", "label", F.col("mention_count").alias("mentions")), top_n, F.desc("mentions"), "name")
    return cut.filter(S.is_meaningful_entity(F.col("name"), F.col("label"), exclude_identifiers)).select("name", "mentions")


def top_entities_by_degree(kg: KnowledgeGraph, type: str | None = None, top_n: int = 20) -> DataFrame:
    # edges are counted by end before the join: both sides then have a row a name
    degree = kg.ends.filter(S.live(F.col("polarity"))).groupBy(F.col("a").alias("name")).agg(F.count(F.lit(1)).alias("d"))
    e = _entities(kg, type).select("name").join(degree, "name", "left")
    return _top(e.select("name", F.coalesce("d", F.lit(0)).alias("degree")), top_n, F.desc("degree"), "name")


# -- connections and co-occurrence


def entity_dossier(kg: KnowledgeGraph, name: str, top_n: int = 25) -> DataFrame:
    """One row: the core, live neighbours by weight, identifiers and communities; none if the entity is unknown."""
    k = clamp_top_n(top_n, 25)
    near = _edges_of(kg, name).join(_labels(kg, "b", "ntype"), "b")
    best = near.filter(S.live(F.col("polarity")) & ~S.is_identifier(F.col("ntype"))).orderBy(F.desc("weight"), "b", "rel_id").limit(k)
    neighbours = best.agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("o"), F.col("b"), F.col("rel_id"), F.col("rel_type"), F.col("ntype")))), lambda x: F.struct(x["rel_type"].alias("rel"), x["b"].alias("name"), x["ntype"].alias("ntype"), (-x["o"]).alias("w"))).alias("neighbors")
    )
    ids = near.filter(S.is_identifier(F.col("ntype"))).select(F.col("ntype").alias("id_type"), F.col("b").alias("value")).orderBy("id_type", "value").limit(k)
    identifiers = ids.agg(F.array_sort(F.collect_list(F.struct("id_type", "value"))).alias("identifiers"))
    comm = kg.in_community.filter(F.col("name") == name).join(kg.communities, (F.col("community_id") == F.col("id")) & (kg.in_community["level"] == kg.communities["level"]))
    communities = comm.agg(F.array_sort(F.collect_list(F.struct(kg.communities["level"].alias("level"), F.col("title").alias("title")))).alias("communities"))
    core = kg.entities.filter(F.col("name") == name).select("name", "label", "description", "mention_count").limit(1)
    # every side has one row at most
    return core.crossJoin(neighbours).crossJoin(identifiers).crossJoin(communities)


def neighbors_by_relation(kg: KnowledgeGraph, name: str, rel_type: str, polarity: str | None = None, top_n: int = 25) -> DataFrame:
    e = _edges_of(kg, name).filter(F.col("rel_type") == rel_type)
    if polarity is not None:
        e = e.filter(F.col("polarity") == polarity)
    out = e.select(F.col("b").alias("name"), F.col("weight").alias("w"), "valid_from", "valid_to")
    return _top(out, top_n, F.desc_nulls_last("w"), "name", "valid_from", "valid_to", default=25)


def cooccurrence(kg: KnowledgeGraph, name: str, top_n: int = 25) -> DataFrame:
    mine = kg.mentions.filter(F.col("entity_name") == name).select("chunk_id").distinct()
    others = kg.mentions.filter(F.col("entity_name") != name).join(mine, "chunk_id")
    return _top(others.groupBy(F.col("entity_name").alias("name")).agg(F.countDistinct("chunk_id").alias("shared")), top_n, F.desc("shared"), "name", default=25)


def common_connections(kg: KnowledgeGraph, a: str, b: str, top_n: int = 25) -> DataFrame:
    side = lambda x, c: _edges_of(kg, x).filter(S.live(F.col("polarity"))).groupBy(F.col("b").alias("name")).agg(F.array_sort(F.collect_set("rel_type")).alias(c))
    both = side(a, "v1").join(side(b, "v2"), "name").filter(~F.col("name").isin(a, b)).join(_labels(kg, "name", "type"), "name")
    out = both.select("name", "type", F.concat("v1", "v2").alias("via"))
    return _top(out, top_n, F.desc(F.size("via")), "name", default=25)


def shared_identifier_entities(kg: KnowledgeGraph, id_type: str | None = None, min_owners: int = 2, top_n: int = 25) -> DataFrame:
    ids = kg.entities.filter(S.is_identifier(F.col("label")) if id_type is None else (F.col("label") == id_type)).select(F.col("name").alias("value"), F.col("label").alias("id_type"))
    ranges = name_ranges(ids.select(F.col("value").alias("name"), F.col("id_type").alias("label")))
    owners = kg.undirected.filter(may_be_named(F.col("a"), ranges)).select(F.col("a").alias("value"), F.col("b").alias("owner")).join(ids, "value")
    owners = owners.join(kg.entities.filter(~S.is_identifier(F.col("label"))).select(F.col("name").alias("owner")), "owner")
    out = owners.groupBy("value", "id_type").agg(F.array_sort(F.collect_set("owner")).alias("owners")).filter(F.size("owners") >= min_owners)
    return _top(out, top_n, F.desc(F.size("owners")), "value", "id_type", default=25)


def identifier_lookup(kg: KnowledgeGraph, value: str) -> DataFrame:
    e = _edges_of(kg, value).join(_labels(kg, "a", "alabel"), "a").filter(S.is_identifier(F.col("alabel")))
    e = e.join(_labels(kg, "b", "label"), "b").filter(~S.is_identifier(F.col("label")))
    return e.select(F.col("b").alias("name"), "label", F.col("rel_type").alias("rel"))


# -- communities and centrality reads


def community_overview(kg: KnowledgeGraph, level: int = 0, top_n: int = 20) -> DataFrame:
    return _top(kg.communities.filter(F.col("level") == level).select("title", "summary", "member_count"), top_n, F.desc("member_count"), "title")


def entity_communities(kg: KnowledgeGraph, name: str) -> DataFrame:
    mine = kg.in_community.filter(F.col("name") == name).select(F.col("community_id").alias("id"), "level")
    return mine.join(kg.communities, ["id", "level"]).select("level", "title", "summary").orderBy("level", "title")


def top_central_entities(kg: KnowledgeGraph, metric: str = "pagerank", type: str | None = None, top_n: int = 20) -> DataFrame:
    """Reads materialised scores; entities without one are left out."""
    if metric not in ("pagerank", "betweenness", "eigenvector"):
        raise ValueError(f"unknown metric {metric!r}")
    s = kg.scores.filter(F.col(metric).isNotNull())
    if type is not None:
        s = s.join(kg.entities.filter(F.col("label") == type).select("name"), "name", "left_semi")
    return _top(s.select("name", F.col(metric).alias("score")), top_n, F.desc("score"), "name")


def link_prediction(kg: KnowledgeGraph, name: str, top_n: int = 20) -> DataFrame:
    l = kg.likely_links
    both = l.select("a", "b", "score").union(l.select(F.col("b"), F.col("a"), "score")).filter(F.col("a") == name)
    return _top(both.groupBy(F.col("b").alias("name")).agg(F.max("score").alias("score")), top_n, F.desc("score"), "name")


# -- temporal dynamics


def relationship_timeline(kg: KnowledgeGraph, name: str, rel_type: str | None = None) -> DataFrame:
    e = _edges_of(kg, name).filter("valid_from IS NOT NULL")
    if rel_type is not None:
        e = e.filter(F.col("rel_type") == rel_type)
    return e.select(F.substring("valid_from", 1, 7).alias("period"), F.col("rel_type").alias("rel"), F.col("b").alias("name"), "polarity").orderBy("period", "name")


def whats_changed(kg: KnowledgeGraph, date_from: str, date_to: str, entity: str | None = None, top_n: int = 50) -> DataFrame:
    """Edges that appeared, ended or were first seen in a window of (partial) ISO dates, compared as text.

    Without ``entity`` every edge is seen from both ends.
    """
    e = (kg.ends if entity is None else _edges_of(kg, entity)).filter(F.col("rel_type") != "LIKELY_LINK")
    lo, hi = S.day_of_iso(date_from), S.day_of_iso(date_to, end=True)
    within = lambda c: F.coalesce(F.col(c).between(date_from, date_to), F.lit(False))
    seen = F.lit(False)
    if lo is not None and hi is not None:
        seen = F.col("valid_from").isNull() & F.col("valid_to").isNull() & F.col("created_at").between(lo, hi)
    change = F.when(within("valid_from"), "appeared").when(within("valid_to"), "ended").otherwise("first_seen")
    e = e.filter(within("valid_from") | within("valid_to") | seen)
    out = e.select(F.col("a").alias("name"), F.col("rel_type").alias("rel"), F.col("b").alias("other"), "polarity", "valid_from", "valid_to", "created_at", change.alias("change"), "rel_id")
    return _top(out, top_n, F.asc_nulls_last(F.coalesce("valid_from", "valid_to")), "name", "other", "rel_id", default=50).drop("rel_id")


def topic_trend(kg: KnowledgeGraph, topic: str, granularity: str = "month", since: str | None = None, until: str | None = None) -> DataFrame:
    """Mentions a period; since and until (partial ISO dates) leave the periods that overlap them."""
    mine = kg.mentions.filter(F.col("entity_name") == topic).select("chunk_id").distinct()
    dated = kg.chunks.filter("doc_date_epoch IS NOT NULL").join(mine, "chunk_id", "left_semi")
    trend = dated.groupBy(S.period_of_day(F.col("doc_date_epoch"), granularity).alias("period")).agg(F.countDistinct("chunk_id").alias("mentions"))
    return trend.filter(S.period_in_window(F.col("period"), granularity, since, until)).orderBy("period")


entity_activity = topic_trend


def polarity_evolution(kg: KnowledgeGraph, name: str | None = None, rel_type: str | None = None) -> DataFrame:
    """Without ``name`` every edge counts from both ends."""
    e = (kg.ends if name is None else _edges_of(kg, name)).filter("valid_from IS NOT NULL")
    if rel_type is not None:
        e = e.filter(F.col("rel_type") == rel_type)
    return e.groupBy(F.substring("valid_from", 1, 7).alias("period"), "polarity").agg(F.count(F.lit(1)).alias("n")).orderBy("period", "polarity")


# -- events


def new_events(kg: KnowledgeGraph, today: int, window_days: int = 14, type: str | None = None, exclude_identifiers: bool = True, top_n: int = 25) -> DataFrame:
    """New entities and edges since today - window_days (epoch-days), each side cut before its filters."""
    k, since = clamp_top_n(top_n, 25), today - window_days
    e = kg.entities.filter(F.col("created_at") >= since).select("name", F.col("label").alias("type"), "created_at", "first_doc_id").orderBy(F.desc("created_at"), "name").limit(k)
    if type is not None:
        e = e.filter(F.col("type") == type)
    e = e.filter(S.is_meaningful_entity(F.col("name"), F.col("type"), exclude_identifiers)).withColumn("kind", F.lit("entity"))
    r = kg.relations.filter(F.col("created_at") >= since).orderBy(F.desc("created_at"), "rel_id").limit(k)
    r = r.select("src", F.col("rel_type").alias("rel"), "tgt", "created_at", "first_doc_id", F.lit("edge").alias("kind"))
    both = e.unionByName(r, allowMissingColumns=True)
    return both.orderBy(F.desc("created_at"), F.desc("kind"), "name", "src", "tgt", "rel").limit(k)


def entity_new_connections(kg: KnowledgeGraph, name: str, today: int, window_days: int = 14, top_n: int = 20) -> DataFrame:
    e = _edges_of(kg, name).filter(F.col("created_at") >= today - window_days)
    return _top(e.select(F.col("rel_type").alias("rel"), F.col("b").alias("other"), "created_at", "first_doc_id", "rel_id"), top_n, F.desc("created_at"), "other", "rel_id").drop("rel_id")


def event_dossier(kg: KnowledgeGraph, name: str, top_n: int = 25) -> DataFrame:
    core = kg.entities.filter((F.col("name") == name) & (F.col("label") == "EventOrAction")).select("name", "event_type", "event_ts_raw", "event_start_epoch", "event_end_epoch", "event_ts_precision")
    actors = _edges_of(kg, name).select(F.col("b").alias("actor_name"), F.col("rel_type").alias("rel")).orderBy("actor_name", "rel").limit(clamp_top_n(top_n, 25))
    return core.limit(1).crossJoin(actors.agg(F.array_sort(F.collect_list(F.struct("actor_name", "rel"))).alias("actors")))


def event_timeline(kg: KnowledgeGraph, entity: str, today: int | None = None, window_days: int | None = None, top_n: int = 50) -> DataFrame:
    """Events of a participant, latest first, those without a time last."""
    e = _edges_of(kg, entity).filter("rel_type = 'PARTICIPATED_IN'").select(F.col("b").alias("name"))
    out = e.join(kg.entities.filter("label = 'EventOrAction'"), "name")
    if window_days is not None:
        out = out.filter(F.coalesce("event_start_epoch", F.col("created_at").cast("long") * SECONDS_A_DAY) >= (today - window_days) * SECONDS_A_DAY)
    out = out.select("name", "event_type", "event_ts_raw", "event_start_epoch", "event_end_epoch", "event_ts_precision")
    return _top(out, top_n, F.desc_nulls_last("event_start_epoch"), "name", default=50)


def trending_events(kg: KnowledgeGraph, today: int, window_days: int = 7, baseline_windows: int = 4, min_count: int = 2, ratio: float = 1.0, top_n: int = 20) -> DataFrame:
    """Participants with more events of a type of late than in an average earlier window."""
    recent_from, base_from = today - window_days, today - window_days * (baseline_windows + 1)
    ev = kg.entities.filter((F.col("label") == "EventOrAction") & (F.col("created_at") >= base_from)).select(F.col("name").alias("src"), "event_type", F.col("created_at").alias("at"))
    part = kg.relations.filter((F.col("rel_type") == "PARTICIPATED_IN") & S.live(F.col("polarity"))).select("src", F.col("tgt").alias("entity"))
    g = part.join(ev, "src").groupBy("entity", "event_type").agg(
        F.countDistinct(F.when(F.col("at") >= recent_from, F.col("src"))).alias("recent"), F.countDistinct(F.when(F.col("at") < recent_from, F.col("src"))).alias("earlier")
    )
    g = g.withColumn("baseline_rate", F.col("earlier") / F.lit(float(baseline_windows)))
    g = g.withColumn("burst_score", F.col("recent") / F.greatest("baseline_rate", F.lit(1.0))).filter((F.col("recent") >= min_count) & (F.col("burst_score") >= ratio))
    return _top(g.select("entity", "event_type", "recent", "baseline_rate", "burst_score"), top_n, F.desc("burst_score"), F.desc("recent"), "entity", "event_type")


def alerts(kg: KnowledgeGraph, kind: str | None = None, entity: str | None = None, since: int | None = None, top_n: int = 50) -> DataFrame:
    a = kg.alerts
    for c, v in (("kind", kind), ("entity", entity)):
        if v is not None:
            a = a.filter(F.col(c) == v)
    if since is not None:
        a = a.filter(F.col("created_at") >= since)
    return _top(a.select("alert_key", "kind", "entity", "detail", "created_at", "score"), top_n, F.desc("created_at"), "alert_key", default=50)


# -- quality


def contradictions(kg: KnowledgeGraph, top_n: int = 50) -> DataFrame:
    """Affirmed and negated edges between the same ends whose validity windows overlap (an open bound is unbounded)."""
    side = lambda p, x: kg.relations.filter(F.col("polarity") == p).select(
        F.col("src").alias("a"), F.col("rel_type").alias("rel"), F.col("tgt").alias("b"), F.col("valid_from").alias(f"f{x}"), F.col("valid_to").alias(f"t{x}"), F.col("source_chunks").alias(f"c{x}")
    )
    pairs = side("affirmed", 1).join(side("negated", 2), ["a", "rel", "b"])
    before = lambda x, y: F.col(x).isNull() | F.col(y).isNull() | (F.col(x) <= F.col(y))
    out = pairs.filter(before("f1", "t2") & before("f2", "t1")).select("a", "rel", "b", F.col("c1").alias("affirmed_chunks"), F.col("c2").alias("negated_chunks"))
    return _top(out, top_n, "a", "rel", "b", default=50)


def _degrees(kg: KnowledgeGraph) -> DataFrame:
    return kg.ends.groupBy(F.col("a").alias("name")).agg(F.count(F.lit(1)).alias("d"))


def orphans(kg: KnowledgeGraph, min_degree: int = 1, top_n: int = 20) -> DataFrame:
    e = _entities(kg, None, True).select("name", F.col("label").alias("type")).join(_degrees(kg), "name", "left")
    out = e.select("name", F.coalesce("d", F.lit(0)).alias("degree"), "type").filter(F.col("degree") < min_degree)
    return _top(out, top_n, "degree", "name")


def incomplete_entities(kg: KnowledgeGraph, type: str = "Organization", expected: tuple[str, ...] | None = None, top_n: int = 20) -> DataFrame:
    want = tuple(expected or EXPECTED_IDS.get(type, ()))
    ids = kg.entities.filter(F.col("label").isin(*want)).select(F.col("name").alias("b"), F.col("label").alias("idl"))
    have = kg.ends.select("a", "b").join(ids, "b").groupBy(F.col("a").alias("name")).agg(F.array_sort(F.collect_set("idl")).alias("have"))
    e = _entities(kg, type).select("name").join(have, "name", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    out = e.select("name", F.array_except(F.array(*[F.lit(x) for x in want]).cast("array<string>"), F.col("have")).alias("missing"), "have")
    return _top(out, top_n, F.desc(F.size("missing")), "name")


def merge_candidates(kg: KnowledgeGraph, top_n: int = 20) -> DataFrame:
    g = _entities(kg, None, True).groupBy(F.lower(F.trim("name")).alias("key")).agg(F.array_sort(F.collect_list("name")).alias("names"), F.count(F.lit(1)).alias("count")).filter("count > 1")
    return _top(g, top_n, F.desc("count"), "key")


# -- signals


def risk_score(kg: KnowledgeGraph, name: str | None = None, band: str | None = None, top_n: int = 20) -> DataFrame:
    s = kg.scores.filter("risk_score IS NOT NULL")
    if name is not None:
        s = s.filter(F.col("name") == name)
    if band is not None:
        s = s.filter(F.col("risk_band") == band)
    return _top(s.select("name", F.col("risk_score").alias("score"), F.col("risk_band").alias("band"), F.col("risk_components").alias("components")), top_n, F.desc("score"), "name")


def investigate_next(kg: KnowledgeGraph, top_n: int = 20) -> DataFrame:
    s = kg.scores.filter("risk_score IS NOT NULL").select("name", F.col("risk_score").alias("risk"), F.coalesce("completeness_score", F.lit(0.0)).alias("completeness"))
    return _top(s, top_n, F.desc("risk"), "completeness", "name")


recommended_merges = merge_candidates


def review_queue(kg: KnowledgeGraph, top_n: int = 20) -> DataFrame:
    """Organisations with neighbours, every one of which is an identifier."""
    org = kg.entities.filter("label = 'Organization'").select(F.col("name").alias("a"))
    e = kg.ends.select("a", "b").join(org, "a", "left_semi").join(_labels(kg, "b", "bl"), "b")
    g = e.groupBy(F.col("a").alias("name")).agg(F.count(F.lit(1)).alias("degree"), F.sum(S.is_identifier(F.col("bl")).cast("long")).alias("ids")).filter("degree = ids")
    return _top(g.select("name", "degree", F.lit("shell_signal").alias("flag")), top_n, F.desc("degree"), "name")


def circular_ownership(kg: KnowledgeGraph, rel_type: str = "OWNS", max_edges: int = 6, top_n: int = 20) -> DataFrame:
    """Directed cycles of 2 to max_edges edges, one row a rotation; edges are not used twice.

    Edges that lie on no cycle are trimmed first, as far as a few rounds see; a cycle is then two walks of half
    its length that meet at both ends, so no walk is longer than half a cycle.
    """
    e = kg.relations.filter((F.col("rel_type") == rel_type) & (F.col("src") != F.col("tgt"))).select("src", "tgt", "rel_id")
    for _ in range(2):
        e = e.join(e.select(F.col("tgt").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("tgt")).distinct(), "tgt", "left_semi")
    e = reliable_checkpoint(e.select("src", "tgt", "rel_id"))
    step = e.select(F.col("src").alias("at"), F.col("tgt").alias("to"), F.col("rel_id").alias("via"))
    walks = {1: e.select(F.col("src").alias("start"), F.col("tgt").alias("at"), F.array("src", "tgt").alias("path"), F.array("rel_id").alias("used"))}
    for n in range(2, (max_edges + 1) // 2 + 1):
        longer = walks[n - 1].join(step, "at").filter(~F.array_contains("used", F.col("via")))
        walks[n] = longer.select("start", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), F.concat("used", F.array("via")).alias("used"))
    found = None
    for n in range(2, max_edges + 1):
        back = walks[n // 2].select(F.col("at").alias("start"), F.col("start").alias("at"), F.col("path").alias("path2"), F.col("used").alias("used2"))
        both = walks[n - n // 2].join(back, ["start", "at"]).filter(~F.arrays_overlap("used", "used2"))
        closed = both.select(F.concat("path", F.slice("path2", 2, n)).alias("cycle"))
        found = closed if found is None else found.union(closed)
    return _top(found, top_n, F.desc(F.size("cycle")), "cycle")


# -- domain and rollups


def issue_resolution_stats(kg: KnowledgeGraph) -> DataFrame:
    res = kg.entities.filter("label = 'Resolution'").select(F.col("name").alias("b"))
    done = kg.ends.filter((F.col("rel_type") == "RESOLVED_BY") & S.live(F.col("polarity"))).join(res, "b", "left_semi").select(F.col("a").alias("name")).distinct().withColumn("ok", F.lit(1))
    g = kg.entities.filter("label = 'Issue'").select("name").join(done, "name", "left").agg(F.count(F.lit(1)).alias("total_issues"), F.count("ok").alias("resolved"))
    rate = F.when(F.col("total_issues") > 0, F.round(F.col("resolved") / F.col("total_issues"), 4)).otherwise(F.lit(0.0))
    return g.select("total_issues", "resolved", (F.col("total_issues") - F.col("resolved")).alias("unresolved"), rate.alias("resolution_rate"))


def communication_stats(kg: KnowledgeGraph, name: str | None = None, top_n: int = 20) -> DataFrame:
    r = kg.relations.filter(F.col("rel_type").isin("CONTACT", "RESPONDED_TO") & S.live(F.col("polarity")) & (F.col("src") != F.col("tgt")))
    p = r.select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b"), F.col("rel_type").alias("rel"))
    if name is not None:
        p = p.filter((F.col("a") == name) | (F.col("b") == name))
    return _top(p.groupBy("a", "b", "rel").agg(F.count(F.lit(1)).alias("interactions")), top_n, F.desc("interactions"), "a", "b", "rel")


def numeric_rollup(kg: KnowledgeGraph, counterparty: str | None = None, top_n: int = 20) -> DataFrame:
    """Sums of the numbers in the names of neighbouring amounts."""
    amounts = _entities(kg, "Amount").select("name", "label")
    e = kg.undirected.filter(may_be_named(F.col("b"), name_ranges(amounts))) if counterparty is None else _edges_of(kg, counterparty)
    e = e.select(F.col("a").alias("counterparty"), F.col("b").alias("name"))
    # a name is parsed once, not once an edge
    e = e.join(amounts.select("name", S.parse_amount(F.col("name")).alias("v")).filter("v IS NOT NULL"), "name")
    g = e.groupBy("counterparty").agg(F.round(F.sum("v"), 2).alias("total"), F.count(F.lit(1)).alias("count"))
    return _top(g, top_n, F.desc("total"), "counterparty")


def first_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")
