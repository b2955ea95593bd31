"""Search, claims, resolution, readers and scalars over the driver tables."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.functions import tolerant_json
from graphloom.operators import claims as C
from graphloom.operators import resolve as X
from graphloom.operators import retrieval as R
from graphloom.operators import search as Q
from graphloom.operators import stats as A
from graphloom.operators import upkeep as U
from graphloom.plans import materialize as M
from graphloom.plans.catalog_queries import CUST, PART, TODAY
from graphloom.plans.data_queries import _COS, t
from graphloom.plans.kg import KG_SQL, KnowledgeGraph
from graphloom.plans.registry import register
from graphloom.sources import readers, sinks
from graphloom.session import shared_dir

kg = KnowledgeGraph.from_tables
_DAY = "date_diff('day', DATE '1970-01-01', {}::DATE)"


def _first_vector(spark, sf):
    return t(spark, sf, "embeddings").filter("vec_id = 0").first()["embedding"]


@register("vec_entity_knn", f"SELECT 'v ' || y.vec_id AS name, {_COS} AS score FROM embeddings x, embeddings y WHERE x.vec_id = 0 AND y.vec_id % 3 <> 1 AND y.label = 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _entity_knn(spark, sf):
    v = t(spark, sf, "embeddings")
    name = F.concat(F.lit("v "), F.col("vec_id").cast("string"))
    e = v.select(name.alias("name"), F.col("label").cast("string").alias("label"), F.when(F.col("vec_id") % 3 == 1, "v 0").alias("er_canonical_name"), F.col("embedding").alias("er_vec"))
    return Q.entity_knn(e, _first_vector(spark, sf), 10, "1")


@register(
    "vec_community_knn",
    f"SELECT 'c' || y.vec_id AS id, y.label % 2 AS level, 'about ' || y.vec_id AS summary, {_COS} AS score FROM embeddings x, embeddings y WHERE x.vec_id = 0 AND y.label % 2 = 1 AND y.vec_id % 7 <> 0 ORDER BY 4 DESC, 1 LIMIT 10",
)
def _community_knn(spark, sf):
    v = t(spark, sf, "embeddings")
    r = v.select(F.concat(F.lit("c"), "vec_id").alias("id"), (F.col("label") % 2).alias("level"), F.when(F.col("vec_id") % 7 != 0, F.concat(F.lit("about "), "vec_id")).otherwise(" ").alias("summary"), "embedding")
    return Q.community_knn(r, _first_vector(spark, sf), 1, 10)


@register("graph_neighbours", KG_SQL + "SELECT DISTINCT b AS name, label, 1 AS hop FROM u JOIN entities n ON n.name = u.b WHERE a = 'Order#7' AND b <> 'Order#7' AND (polarity IS NULL OR polarity <> 'negated')")
def _neighbours(spark, sf):
    return Q.find_neighbours(kg(spark, sf), "Order#7", 1)


@register(
    "graph_search",
    KG_SQL + f""", s AS (SELECT name FROM entities WHERE label = 'Location' AND name IN (SELECT n_name FROM nation ORDER BY n_name LIMIT 1)), l AS (SELECT a, b FROM u WHERE polarity IS NULL OR polarity <> 'negated'),
    h AS (SELECT DISTINCT b AS name FROM l WHERE a IN (SELECT name FROM s) AND b NOT IN (SELECT name FROM s) ORDER BY 1 LIMIT 20)
    SELECT name, label, hop FROM (SELECT name, 0 AS hop FROM s UNION ALL SELECT name, 1 FROM h) JOIN entities USING (name) ORDER BY hop, name LIMIT 20""",
)
def _search(spark, sf):
    name = t(spark, sf, "nation").agg(F.min("n_name")).first()[0] or ""
    return Q.graph_search(kg(spark, sf), name, None, 1, 1, max_nodes=20)[0]


@register("graph_entity_by_id", KG_SQL + f"SELECT name, label, mention_count FROM entities WHERE name = '{CUST}' AND label = 'Person'")
def _by_id(spark, sf):
    return Q.find_entity_by_id(kg(spark, sf).entities, CUST, " person ").select("name", "label", "mention_count")


@register("ret_filter_by_metadata", "SELECT o_orderkey AS chunk_id, o_custkey AS doc_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def _by_metadata(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("department"), F.col("o_orderstatus").alias("doc_type"))
    return Q.filter_by_metadata(o, "", "1-URGENT", "F")


@register(
    "ret_subquestions",
    f"""WITH s AS (SELECT x.vec_id AS q, 'Order#' || y.vec_id AS chunk_id, {_COS} AS c FROM embeddings x, embeddings y WHERE x.vec_id % 50 = 0),
    v AS (SELECT q, chunk_id, row_number() OVER (PARTITION BY q ORDER BY c DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10),
    m AS (SELECT 'Order#' || l_orderkey AS chunk_id, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_partkey IN (5, 7) AND l_orderkey IN (SELECT vec_id FROM embeddings) GROUP BY 1),
    g AS (SELECT chunk_id, row_number() OVER (ORDER BY n DESC, chunk_id) AS rank FROM m QUALIFY rank <= 10), b AS (SELECT q, chunk_id, 'vector' AS via, rank, 0 AS block FROM v UNION ALL SELECT q, chunk_id, 'graph', rank, 1 FROM g, (SELECT DISTINCT q FROM v))
    SELECT q AS question_id, chunk_id, via, rank FROM b QUALIFY row_number() OVER (PARTITION BY q, chunk_id ORDER BY block) = 1""",
)
def _subquestions(spark, sf):
    v = t(spark, sf, "embeddings")
    name = F.concat(F.lit("Order#"), F.col("vec_id").cast("string"))
    questions = v.filter("vec_id % 50 = 0").select(name.alias("question_id"), F.lit("What links Part#5, and Part#7?").alias("text"), "embedding")
    chunks = v.select(name.alias("chunk_id"), "embedding", F.lit(1).alias("doc_date_epoch"), F.lit("g").alias("doc_group"))
    got = Q.retrieve(questions, chunks, kg(spark, sf), 10, since=0)
    return got.withColumn("question_id", F.substring("question_id", 7, 20).cast("long"))


def _orders_as_mentions(spark, sf):
    k = kg(spark, sf)
    return dataclasses.replace(k, mentions=k.relations.filter("rel_type = 'PARTY_OF'").select(F.col("tgt").alias("chunk_id"), F.col("src").alias("entity_name")))


@register(
    "ret_drift",
    KG_SQL + """, s AS (SELECT DISTINCT c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT')
    SELECT c.id, c.title, c.summary, count(*) AS seeds FROM s JOIN in_community i ON i.name = s.name AND i.level = 0 JOIN communities c ON c.id = i.community_id AND c.level = 0 GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1 LIMIT 5""",
)
def _drift(spark, sf):
    hits = t(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("Order#"), "o_orderkey").alias("chunk_id"))
    return Q.drift(hits, _orders_as_mentions(spark, sf), 0, 5)


@register(
    "dyn_topic_trend_window",
    KG_SQL + f"""SELECT strftime(d, '%Y') || '-Q' || quarter(d) AS period, count(DISTINCT chunk_id) AS mentions FROM (SELECT DATE '1970-01-01' + doc_date_epoch::INT AS d, chunk_id FROM chunks
    WHERE chunk_id IN (SELECT chunk_id FROM mentions WHERE entity_name = '{PART}')) WHERE date_trunc('quarter', d) <= DATE '1996-12-31' AND date_trunc('quarter', d) + INTERVAL 3 MONTH > DATE '1994-05-15' GROUP BY 1""",
)
def _trend(spark, sf):
    from graphloom.operators import primitives as P

    return P.topic_trend(kg(spark, sf), PART, "quarter", "1994-05-15", "1996")


@register("fn_period_bounds", "SELECT DISTINCT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS period, date_trunc('week', o_orderdate)::DATE AS first, (date_trunc('week', o_orderdate) + INTERVAL 6 DAY)::DATE AS last FROM orders UNION SELECT DISTINCT strftime(o_orderdate, '%Y-%m'), date_trunc('month', o_orderdate)::DATE, last_day(o_orderdate::DATE) FROM orders")
def _bounds(spark, sf):
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    o = t(spark, sf, "orders")
    one = lambda g: o.select(S.period_of_day(day, g).alias("period")).distinct().select("period", S.period_bounds(F.col("period"), g).alias("b")).select("period", "b.first", "b.last")
    return one("week").union(one("month"))


@register("fn_parse_temporal", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN NULL ELSE strftime(l_shipdate, '%Y-%m') END AS valid_from, CASE l_returnflag WHEN 'R' THEN NULL ELSE strftime(l_shipdate, '%Y') END AS valid_to FROM lineitem")
def _temporal(spark, sf):
    l = t(spark, sf, "lineitem")
    d = F.col("l_shipdate")
    text = F.concat(F.when(F.col("l_returnflag") == "A", "").otherwise(F.date_format(d, "yyyy-MM")), F.when(F.col("l_returnflag") == "R", F.lit("")).otherwise(F.concat(F.lit(" .. "), F.date_format(d, "yyyy"))))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", S.parse_temporal(text).alias("v")).select("l_orderkey", "l_linenumber", "l_partkey", "v.*")


@register("fn_display_name", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name || ' of ' || p_brand, ' '), lambda w: CASE WHEN w = lower(w) AND w <> upper(w) THEN upper(w[1]) || w[2:] ELSE w END), ' ') AS shown FROM part")
def _display(spark, sf):
    return t(spark, sf, "part").select("p_partkey", S.display_entity_name(F.concat("p_name", F.lit("  of "), "p_brand")).alias("shown"))


@register(
    "fn_cosine",
    f"SELECT x.vec_id, {_COS} AS score FROM embeddings x, (SELECT embedding FROM embeddings WHERE vec_id = 0) y",
)
def _cosine(spark, sf):
    v = t(spark, sf, "embeddings")
    return v.crossJoin(F.broadcast(v.filter("vec_id = 0").select(F.col("embedding").alias("q")))).select("vec_id", S.cosine(F.col("embedding"), F.col("q")).alias("score"))


_CLAIMS = "'Sure: [{\"subject\": \"' || p_name || '\", \"attribute\": \"brand\", \"value\": \"' || p_brand || '\", \"polarity\": \"' || CASE WHEN p_size % 5 = 0 THEN 'negated' ELSE 'affirmed' END || '\"}, {\"subject\": \"\", \"attribute\": \"x\", \"value\": \"y\"}] done'"


def _replies(spark, sf):
    return t(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_type").alias("source"), F.expr(_CLAIMS).alias("raw"))


@register("claim_parse", "SELECT p_partkey AS doc_id, p_type AS source, p_name AS subject, 'brand' AS attribute, p_brand AS value, CASE WHEN p_size % 5 = 0 THEN 'negated' ELSE 'affirmed' END AS polarity FROM part")
def _parse(spark, sf):
    return C.parse_claims(_replies(spark, sf))


@register(
    "claim_refined",
    """WITH v AS (SELECT lower(p_name) AS subject, p_brand AS value, count(DISTINCT p_type) AS sources FROM part GROUP BY 1, 2), s AS (SELECT lower(p_name) AS subject, count(DISTINCT p_size % 5 = 0) = 2 AS split FROM part GROUP BY 1),
    a AS (SELECT subject, list(value ORDER BY sources DESC, value) AS vs, count(*) AS n FROM v GROUP BY 1)
    SELECT a.subject, n AS versions, split AS polarity_split FROM a JOIN s ON a.subject = s.subject WHERE (n > 1 OR split) AND (split OR n < 2 OR NOT (least(vs[1], vs[2]) < 'Brand#3'))""",
)
def _refined(spark, sf):
    b = t(spark, sf, "part").select(F.col("p_brand").alias("b")).distinct()
    pairs = b.select(F.col("b").alias("value_a")).join(b.select(F.col("b").alias("value_b")), F.col("value_a") < F.col("value_b"))
    verdicts = pairs.withColumn("raw", F.when(F.col("value_a") < "Brand#3", "They AGREE.").otherwise("AGREE? no: CONTRADICT"))
    return C.contradictions_of(_replies(spark, sf), verdicts).select("subject", F.size("versions").cast("long").alias("versions"), "polarity_split")


_SHAPES = ("+7 (495) ", "8 495 ", "495-", "8-495-")


def _phones(spark, sf):
    """A hundred numbers, each written in four ways."""
    shape = F.get(F.array(*[F.lit(x) for x in _SHAPES]), F.pmod("c_custkey", F.lit(4)).cast("int"))
    number = F.lpad(F.floor(F.pmod("c_custkey", F.lit(400)) / 4).cast("string"), 7, "0")
    return t(spark, sf, "customer").select(F.concat(shape, number).alias("name"), F.lit("PhoneNumber").alias("label"), F.col("c_custkey").alias("mention_count"))


_NUMBER = "lpad((c_custkey % 400 // 4)::VARCHAR, 7, '0')"
_PHONES = f"SELECT CASE c_custkey % 4 WHEN 0 THEN '+7 (495) ' WHEN 1 THEN '8 495 ' WHEN 2 THEN '495-' ELSE '8-495-' END || {_NUMBER} AS name, '+7495' || {_NUMBER} AS canonical, c_custkey AS n FROM customer"


@register("er_phones", f"SELECT canonical, max_by(name, struct_pack(n := n, x := name)) AS name, sum(n)::BIGINT AS mention_count FROM ({_PHONES}) GROUP BY 1")
def _consolidated(spark, sf):
    return X.consolidate_phones(_phones(spark, sf))


@register(
    "er_duplicate_identifiers",
    f"WITH x AS (SELECT regexp_replace(name, '[^0-9+]', '', 'g') AS k, name, n FROM ({_PHONES})), b AS (SELECT k, min_by(name, struct_pack(n := -n, x := name)) AS canonical, count(*) AS c FROM x GROUP BY 1) SELECT name, canonical FROM x JOIN b USING (k) WHERE c > 1 AND name <> canonical",
)
def _dup_ids(spark, sf):
    return X.duplicate_identifiers(_phones(spark, sf))


def _extracted(spark, sf):
    e = t(spark, sf, "events")
    return e.select(
        "event_type", F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("trigger "), (F.col("event_id") % 7).cast("string"))).alias("trigger"),
        F.array(F.concat(F.lit(" User#"), F.col("user_id").cast("string")), F.concat(F.lit("User#"), F.col("user_id").cast("string")), F.lit("")).alias("participants"),
        F.lit(1).alias("start"), F.lit(2).alias("end"), F.lit("day").alias("precision"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("chunk"),
    )


_EVENT_NAME = "CASE WHEN event_id % 10 <> 0 THEN 'trigger ' || event_id % 7 ELSE event_type END"


def _event_graph(spark, sf):
    # two of three users are known
    people = t(spark, sf, "events").filter("user_id % 3 <> 0").select(F.concat(F.lit("User#"), F.col("user_id").cast("string")).alias("name")).distinct()
    return X.events_to_graph(_extracted(spark, sf), people)


@register("er_event_edges", f"SELECT {_EVENT_NAME} AS src, 'c' || event_id AS chunk, 'User#' || user_id AS tgt, 'PARTICIPATED_IN' AS rel_type FROM events")
def _event_edges(spark, sf):
    return _event_graph(spark, sf)[1].select("src", F.element_at("source_chunks", 1).alias("chunk"), "tgt", "rel_type")


@register(
    "er_event_nodes",
    f"""SELECT {_EVENT_NAME} AS name, 'EventOrAction' AS label, 'other' AS event_type, event_type AS event_type_raw, false AS orphan, 'c' || event_id AS chunk FROM events
    UNION ALL SELECT 'User#' || user_id, 'Other', NULL, NULL, true, min('c' || event_id) FROM events WHERE user_id % 3 = 0 GROUP BY user_id""",
)
def _event_nodes(spark, sf):
    return _event_graph(spark, sf)[0].select("name", "label", "event_type", "event_type_raw", "orphan", F.element_at("source_chunks", 1).alias("chunk"))


@register("er_split_events", KG_SQL + "SELECT label, count(*) AS n FROM entities WHERE label <> 'EventOrAction' GROUP BY 1 UNION ALL SELECT 'events', count(*) FROM entities WHERE label = 'EventOrAction'")
def _split(spark, sf):
    rest, events = X.split_events(kg(spark, sf).entities)
    return rest.groupBy("label").agg(F.count(F.lit(1)).alias("n")).union(events.agg(F.lit("events"), F.count(F.lit(1))))


@register("er_eligible", KG_SQL + "SELECT name FROM entities WHERE label NOT IN (SELECT t FROM idt)")
def _eligible(spark, sf):
    return X.er_eligible(kg(spark, sf).entities).select("name")


_JUDGED = "SELECT s_name AS a, n_name AS b, s_suppkey % 3 AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey"


@register("er_judged", f"SELECT a, b FROM ({_JUDGED}) WHERE k = 0 OR k = 1")
def _judged(spark, sf):
    p = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("a"), F.col("n_name").alias("b"), (F.col("s_suppkey") % 3).alias("k"))
    verdicts = p.filter("k <> 0").select(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("k") == 1).alias("same"))
    pairs = p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "k")
    got = X.judged(pairs.withColumn("decision", F.when(F.col("k") == 0, "auto").otherwise("borderline")), verdicts)
    nations = t(spark, sf, "nation").select(F.col("n_name").alias("n"))
    return got.join(F.broadcast(nations), F.col("n").isin(F.col("a"), F.col("b"))).select(F.when(F.col("a") == F.col("n"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("n").alias("b"))


@register("er_supported_bounds", "SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN year(l_shipdate) = 1995 THEN strftime(l_shipdate, '%Y-%m') END AS valid_from, CASE WHEN year(l_shipdate) = 1995 THEN strftime(l_shipdate, '%Y') END AS valid_to FROM lineitem")
def _supported(spark, sf):
    l = t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM").alias("valid_from"), F.date_format("l_shipdate", "yyyy").alias("valid_to"), F.lit("It was in 1995, they say.").alias("text"))
    return X.supported_bounds(l).drop("text")


@register("er_backfill_first_seen", KG_SQL + "SELECT label, coalesce(created_at, 0) AS created_at, count(*) AS n FROM entities GROUP BY 1, 2")
def _backfill(spark, sf):
    return X.backfill_first_seen(kg(spark, sf).entities).groupBy("label", "created_at").agg(F.count(F.lit(1)).alias("n"))


@register(
    "er_cross_channel",
    f"""WITH s AS (SELECT 'e' || x.vec_id AS event, 'n' || y.vec_id AS entity, {_COS} AS c, y.vec_id AS pos FROM embeddings x JOIN embeddings y ON x.label = y.label)
    SELECT event, max_by(entity, struct_pack(c := c, p := pos)) AS entity, max(c) AS score FROM s WHERE c >= 0.2 AND substr(event, 2) <> substr(entity, 2) GROUP BY 1""",
)
def _cross(spark, sf):
    v = t(spark, sf, "embeddings")
    chunk = F.array(F.col("label").cast("string")).alias("source_chunks")
    side = lambda p: v.select(F.concat(F.lit(p), F.col("vec_id").cast("string")).alias("name"), chunk, "embedding", F.col("vec_id").alias("pos"))
    got = X.cross_channel_events(side("e"), side("n").withColumn("name", F.regexp_replace("name", "^n", "e")), 0.2)
    return got.withColumn("entity", F.regexp_replace("entity", "^e", "n"))


@register("up_activity_timings", "SELECT o_orderkey AS scheduled_id, 'ship' AS activity, 1 AS attempt, 'COMPLETED' AS outcome, 0.0::DOUBLE AS wait, greatest(s - o, 0)::DOUBLE AS run FROM (SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS o, max(date_diff('day', DATE '1970-01-01', l_shipdate::DATE)) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)")
def _timings(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("scheduled_id"), F.unix_date(F.col("o_orderdate").cast("date")).cast("double").alias("ts"))
    s = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("scheduled_id")).agg(F.max(F.unix_date(F.col("l_shipdate").cast("date"))).cast("double").alias("ts")).join(o.select("scheduled_id"), "scheduled_id", "left_semi")
    row = lambda df, kind, n: df.select("scheduled_id", F.lit(kind).alias("kind"), F.lit(n).cast("int").alias("attempt"), F.lit("ship").alias("activity"), "ts")
    log = row(o, "SCHEDULED", None).union(row(o.join(s.select("scheduled_id"), "scheduled_id", "left_semi"), "STARTED", 1)).union(row(s, "COMPLETED", 1))
    return X.activity_timings(log).select("scheduled_id", "activity", "attempt", "outcome", F.greatest("wait", F.lit(0.0)).alias("wait"), F.col("run").cast("double").alias("run"))


@register("up_run_overview", "SELECT o_orderpriority AS workflow, count(*) AS runs, count(*) FILTER (WHERE o_orderstatus = 'O') AS running, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, avg(CASE WHEN o_orderstatus <> 'O' THEN o_custkey END) AS mean, max(CASE WHEN o_orderstatus <> 'O' THEN o_custkey END) AS longest FROM orders GROUP BY 1")
def _overview(spark, sf):
    o = t(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    return U.run_overview(o.select(F.col("o_orderpriority").alias("workflow"), status.alias("status"), F.lit(0).cast("long").alias("started"), F.when(status != "running", F.col("o_custkey")).alias("ended")))


@register("up_truncate", "SELECT doc_id, substr(text, 1, 500) AS text, coalesce(length(text) > 500, false) AS truncated FROM documents")
def _truncate(spark, sf):
    return U.truncate_texts(t(spark, sf, "documents").select("doc_id", "text"), most=500)


@register("up_child_context", KG_SQL + "SELECT id, title, summary, member_count FROM communities WHERE level = 1 AND id IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1) ORDER BY 4 DESC, 1 LIMIT 20")
def _children(spark, sf):
    k = kg(spark, sf)
    below = k.parent_of.withColumn("level", F.lit(1))
    return U.child_context(dataclasses.replace(k, parent_of=below), "r1", 0)


@register("up_community_documents", KG_SQL + "SELECT DISTINCT i.community_id, o_custkey::VARCHAR AS doc_id FROM in_community i JOIN customer ON c_name = i.name JOIN orders ON o_custkey = c_custkey WHERE i.level = 0")
def _community_documents(spark, sf):
    return U.community_documents(_orders_as_mentions(spark, sf), 0)


@register("up_report_vectors", f"SELECT c.id, c.level, e.label FROM ({KG_SQL} SELECT id, level FROM communities) c LEFT JOIN embeddings e ON c.id = 'n' || e.vec_id AND c.level = 1")
def _report_vectors(spark, sf):
    v = t(spark, sf, "embeddings").select(F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("id"), F.lit(1).alias("level"), F.col("label").alias("embedding"))
    return U.report_vectors(kg(spark, sf).communities.select("id", "level"), v).withColumnRenamed("embedding", "label")


@register("up_entity_mirror", KG_SQL + "SELECT name, label, label || ' ' || name AS description, mention_count FROM entities WHERE label IN ('Organization', 'Person')")
def _mirror(spark, sf):
    e = kg(spark, sf).entities.filter("label IN ('Organization', 'Person')")
    old = e.filter("label = 'Person'").select("name", F.lit("Other").alias("label"), "description", F.lit(0).cast("long").alias("mention_count"))
    return U.entity_mirror(old, e)


@register("up_changed_pages", "SELECT s_name AS name FROM supplier WHERE s_suppkey % 4 <> 0")
def _changed(spark, sf):
    h = t(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.md5("s_name").alias("hash"), "s_suppkey")
    return U.changed_pages(h.drop("s_suppkey"), h.withColumn("hash", F.when(F.col("s_suppkey") % 4 == 0, F.col("hash")).otherwise("old"))).select("name")


@register("ret_distinct_documents", "SELECT l_orderkey AS doc_id, min(l_partkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY 1 ORDER BY 2, 1 LIMIT 25")
def _distinct(spark, sf):
    return R.distinct_documents(t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos")), 25)


@register("ret_relevant_partials", "SELECT 'community:' || c_custkey AS source, c_acctbal AS score FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def _partials(spark, sf):
    return R.relevant_partials(t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_mktsegment") == "BUILDING").alias("relevant"), F.col("c_acctbal").alias("score")))


@register("stat_source_catalogue", "SELECT p_brand AS source, count(DISTINCT p_partkey) AS indicators, min(f) AS first_period, max(u) AS last_period FROM part LEFT JOIN (SELECT l_partkey, min(l_shipdate::DATE) AS f, max(l_shipdate::DATE) AS u FROM lineitem GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1")
def _catalogue(spark, sf):
    i = t(spark, sf, "part").select(F.col("p_partkey").alias("indicator_id"), F.col("p_brand").alias("source"))
    return A.source_catalogue(i, t(spark, sf, "lineitem").select(F.col("l_partkey").alias("indicator_id"), F.col("l_shipdate").cast("date").alias("period_start")))


@register("stat_dims", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A'")
def _dims(spark, sf):
    dims = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"))
    return t(spark, sf, "lineitem").filter(A.dims_match(dims, {"flag": "A"})).select("l_orderkey", "l_partkey", "l_linenumber")


_POINTS = f"SELECT o_orderkey AS k, CASE WHEN o_custkey % 5 = 0 THEN 'nan'::DOUBLE ELSE o_totalprice END AS v, {_DAY.format('o_orderdate')} AS f, {_DAY.format('o_orderdate')} + o_custkey % 3 - 1 AS u FROM orders"


@register("stat_rejected_observations", f"SELECT k, CASE WHEN isnan(v) THEN 'not_finite' ELSE 'period_order' END AS reason FROM ({_POINTS}) WHERE isnan(v) OR u < f")
def _rejected(spark, sf):
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    p = t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_custkey") % 5 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("value"), day.alias("period_start"), (day + F.col("o_custkey") % 3 - 1).alias("period_end"))
    return sinks.validate_observations(p)[1].select("k", "reason")


def _chunks(spark, sf):
    """Two chunks a document, split behind its hundredth character."""
    d = t(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    part = lambda n, x: d.select("doc_id", F.lit(n).alias("position"), x.alias("text"))
    return part(0, F.substring("text", 1, 100)).union(part(1, F.substring("text", 101, 1 << 30)))


@register("src_full_document", "SELECT doc_id, substr(substr(coalesce(text, ''), 1, 100) || chr(10) || substr(coalesce(text, ''), 101), 1, 60000) AS text FROM documents WHERE doc_id = 7")
def _full(spark, sf):
    return readers.full_document(_chunks(spark, sf), 7)


@register("src_chunk_page", "SELECT doc_id, 1 AS position, substr(coalesce(text, ''), 101) AS text FROM documents WHERE doc_id = 7")
def _page(spark, sf):
    return readers.chunk_page(_chunks(spark, sf), 7, 1, 5)


@register("src_document_dates", f"SELECT l_orderkey, l_partkey, l_linenumber, {_DAY.format('o_orderdate')} AS doc_date_epoch, o_orderpriority AS doc_group FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def _dates(spark, sf):
    chunks = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_partkey", "l_linenumber")
    docs = t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.unix_date(F.col("o_orderdate").cast("date")).alias("doc_date_epoch"), F.col("o_orderpriority").alias("doc_group"))
    return readers.with_document_dates(chunks, docs).withColumnRenamed("doc_id", "l_orderkey")


@register("src_backfill_doc_ids", "SELECT l_partkey, l_linenumber, l_orderkey AS doc_id FROM lineitem")
def _doc_ids(spark, sf):
    l = t(spark, sf, "lineitem")
    path = lambda c: F.concat(F.lit("/in/"), F.col(c).cast("string"), F.lit(".txt"))
    chunks = l.select("l_partkey", "l_linenumber", path("l_orderkey").alias("file_path"), F.when(F.col("l_linenumber") == 1, F.col("l_orderkey")).alias("doc_id"))
    return readers.backfill_doc_ids(chunks, t(spark, sf, "orders").select(path("o_orderkey").alias("path"), F.col("o_orderkey").alias("doc_id"))).select("l_partkey", "l_linenumber", "doc_id")


#: Files that a task writes or reads, about.
FILES_A_TASK = 500


def _one_a_file(d, n: int):
    """(value, lang, doc), the documents of each language dealt to many tasks, so that a frequent language is not written by one."""
    return d.select(F.coalesce("text", F.lit("")).alias("value"), "lang", F.col("doc_id").alias("doc")).repartition(max(1, n // FILES_A_TASK), "lang", "doc")


@register("src_folder", "SELECT lang AS channel, count(*) AS files, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents GROUP BY 1")
def _folder(spark, sf):
    """Documents written as text files, one a document and in folders by language, and read back as whole files."""
    d = t(spark, sf, "documents")
    root = f"{shared_dir(spark)}/folder-{uuid.uuid4().hex}"
    n = d.count()
    # Spark's reader passes over empty files, so each ends with a mark
    named = F.coalesce(F.concat(F.lit("lang="), F.url_encode("lang")), F.lit("no-lang"))
    sinks.write_folder(_one_a_file(d, n).select(named.alias("folder"), F.concat("value", F.lit("\u0001")).alias("text"), "doc"), root)
    # small as they are, Spark deals a few files to a task
    got = readers.read_folder(spark, root).coalesce(max(spark.sparkContext.defaultParallelism, n // FILES_A_TASK))
    text = F.regexp_replace("text", "\u0001$", "")
    # the path is encoded once more
    lang = F.url_decode(F.url_decode(F.nullif(F.regexp_extract("path", "/(lang=[^/]*)/[^/]*$", 1), F.lit("")).substr(6, 1 << 20)))
    return got.groupBy(lang.alias("channel")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length(text)).cast("long").alias("bytes"))


@register("src_channel", "SELECT source, 'tg_' || source || '_' || doc_id || '.txt' AS path FROM documents")
def _channel(spark, sf):
    path = F.concat(F.lit("tg_"), "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return t(spark, sf, "documents").select(readers.source_channel(path).alias("source"), path.alias("path"))


@register("sink_version", "SELECT p_partkey, p_name FROM part")
def _version(spark, sf):
    """A table written as a new version and read back from where it says."""
    return spark.read.parquet(sinks.write_version(t(spark, sf, "part").select("p_partkey", "p_name"), f"{shared_dir(spark)}/versions"))


@register("sig_write_risk", "SELECT s_name AS name, s_acctbal AS risk_score, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal / 2 END AS risk_score_prev FROM supplier")
def _write_risk(spark, sf):
    new = t(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("risk_score"), "s_suppkey")
    return M.write_risk(new.filter("s_suppkey % 2 = 0").select("name", (F.col("risk_score") / 2).alias("risk_score")), new.drop("s_suppkey"))


@register("ev_deliver_alerts", "SELECT 'k' || o_orderkey AS alert_key FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, 1 LIMIT 50")
def _deliver(spark, sf):
    a = t(spark, sf, "orders").select(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("alert_key"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") != "O", 1).alias("pushed_at"))
    return M.deliver_alerts(a).select("alert_key")


@register(
    "ev_alerts_all_kinds",
    f"""SELECT 'risk_rise' AS kind, s_name AS entity, '' AS detail, {TODAY} AS created_at, s_acctbal - s_acctbal / 2 AS score FROM supplier WHERE s_acctbal - s_acctbal / 2 >= 3000
    UNION ALL SELECT 'burst', s_name, 'type', {TODAY}, 2.0 FROM supplier WHERE s_suppkey % 10 = 0""",
)
def _kinds(spark, sf):
    s = t(spark, sf, "supplier")
    risk = s.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("risk_score"), (F.col("s_acctbal") / 2).alias("risk_score_prev"))
    bursts = s.filter("s_suppkey % 5 = 0").select(F.col("s_name").alias("entity"), F.lit("type").alias("event_type"), F.lit(2.0).alias("burst_score"))
    watched = s.filter("s_suppkey % 10 = 0").select(F.col("s_name").alias("name"))
    return M.detect_alerts(kg(spark, sf), watched, TODAY, risk, bursts, 3000.0, 1_000_000).filter("kind <> 'new_connection'").select("kind", "entity", "detail", "created_at", "score")


@register("materialized_risk", KG_SQL + "SELECT label, count(*) AS n FROM entities WHERE label NOT IN (SELECT t FROM idt) GROUP BY 1")
def _materialized(spark, sf):
    """All stages in one pass; the unknown metric fails alone."""
    k = kg(spark, sf)
    out, errors = M.materialize(k, TODAY - 14, metrics=("pagerank", "eigenvector", "nonsense"), links=False)
    if set(out) != {"centrality", "risk"} or set(errors) != {"nonsense"}:
        raise RuntimeError(f"stages: {sorted(out)}, errors: {errors}")
    return out["risk"].join(k.entities.select("name", "label"), "name").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register(
    "fn_report",
    """SELECT p_partkey, p_name AS title, 'About ' || p_brand AS summary, [struct_pack(statement := p_type, importance := p_size), struct_pack(statement := 'price', importance := 0)] AS findings FROM part""",
)
def _report(spark, sf):
    # replies in prose, of which every other one is cut off inside its last finding
    p = t(spark, sf, "part")
    head = F.concat(F.lit('Here is the report [1]:\n```json\n{"title": "'), "p_name", F.lit('", "summary": " About '), "p_brand", F.lit('", "findings": [{"statement": "'), "p_type", F.lit('", "importance": '))
    full = F.concat(head, F.col("p_size").cast("string"), F.lit('}, {"statement": " price ", "importance": "high"}, {"statement": '))
    reply = F.concat(full, F.when(F.col("p_partkey") % 2 == 0, F.lit('""}]}\n```\nThat is all.')).otherwise(F.lit('"and th')))
    r = tolerant_json.report(reply)
    return p.select("p_partkey", r.alias("r")).select("p_partkey", "r.title", "r.summary", "r.findings")


@register(
    "tr_slices",
    r"""WITH d AS (SELECT doc_id, length(text) AS n, 'Begin. ' || text || ' End. ' AS t FROM documents WHERE length(text) > 0),
    x AS (SELECT doc_id, n, t, length(t) AS m, list_transform(regexp_split_to_array(t, '[.!?]\s'), lambda p: length(p) + 2) AS ls FROM d),
    y AS (SELECT *, list_append(list_transform(range(1, len(ls)), lambda i: list_sum(ls[1:i])), m) AS ends FROM x),
    z AS (SELECT doc_id, t, [0] || list_transform(range(1, 5), lambda k: list_min(list_filter(ends, lambda e: e >= CASE WHEN k = 4 THEN m ELSE (k * n // 4) * m // n END))) AS cuts FROM y)
    SELECT doc_id, doc_id || '-' || k AS chunk_id, (k - 1)::INT AS position, md5(t[(cuts[k] + 1)::BIGINT : cuts[k + 1]::BIGINT]) AS text_md5 FROM z, unnest(range(1, 5)) AS u(k)""",
)
def _slices(spark, sf):
    # four chunks a document; the translation is longer than the original
    d = t(spark, sf, "documents").filter("length(text) > 0").select("doc_id", F.length("text").cast("long").alias("n"), "text")
    k = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")
    chunks = d.select("doc_id", "n", k).select("doc_id", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("k").cast("string")).alias("chunk_id"), F.floor(F.col("k") * F.col("n") / 4).alias("end"))
    translated = d.select("doc_id", F.col("n").alias("original_chars"), F.concat(F.lit("Begin. "), F.col("text"), F.lit(" End. ")).alias("text"))
    return X.translation_slices(chunks, translated).select("doc_id", "chunk_id", "position", F.md5(F.col("text").cast("binary")).alias("text_md5"))
