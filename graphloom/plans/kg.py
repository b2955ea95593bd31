"""The knowledge graph as tables, and its derivation from the driver's star schema.

``KnowledgeGraph.from_tables`` stays lazy: a query reads only the branches that its filters leave, since
every branch of a union has its label or relation type as a literal.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import shared_dir

#: Where a session has written the graph of a folder of tables.
_STORED: dict[tuple[str, str], str] = {}


@dataclass(frozen=True)
class KnowledgeGraph:
    entities: DataFrame
    relations: DataFrame
    mentions: DataFrame
    chunks: DataFrame
    communities: DataFrame
    in_community: DataFrame
    parent_of: DataFrame
    alerts: DataFrame | None = None
    likely_links: DataFrame | None = None
    scores: DataFrame | None = None
    #: Relations and their ends before they were grouped.
    links: tuple[DataFrame, DataFrame] | None = None

    @property
    def bare_relations(self) -> DataFrame:
        """(src, tgt, rel_type), some of them repeated as the tables repeat them: for reads to which copies add nothing, so that no type is grouped."""
        known = self.links is not None and self.links[0] is self.relations
        return self.links[1] if known else self.relations.select("src", "tgt", "rel_type")

    @cached_property
    def undirected(self) -> DataFrame:
        """Each edge seen from both ends (``a`` looks at ``b``), a self-loop once."""
        r = self.relations
        there = r.withColumnsRenamed({"src": "a", "tgt": "b"})
        back = r.filter("src <> tgt").withColumnsRenamed({"src": "b", "tgt": "a"}).select(*there.columns)
        return there.union(back)

    @cached_property
    def ends(self) -> DataFrame:
        """The same rows from one pass over the relations, for reads that are not about one entity."""
        here, back = F.struct(F.col("src").alias("a"), F.col("tgt").alias("b")), F.struct(F.col("tgt").alias("a"), F.col("src").alias("b"))
        r = self.relations.withColumn("__ends", F.explode(F.when(F.col("src") == F.col("tgt"), F.array(here)).otherwise(F.array(here, back))))
        return r.select("__ends.a", "__ends.b", *[c for c in self.relations.columns if c not in ("src", "tgt")])

    @classmethod
    def stored(cls, spark: SparkSession, sf_dir: str) -> KnowledgeGraph:
        """The graph with entities and relations written to the shared folder, by label and type, once a session and folder."""
        kg = cls.from_tables(spark, sf_dir)
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _STORED:
            path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
            kg.entities.write.partitionBy("label").parquet(f"{path}/entities")
            kg.relations.drop("source_chunks").write.partitionBy("rel_type").parquet(f"{path}/relations")
            _STORED[key] = path
        read = lambda name, like: spark.read.schema(like.schema).parquet(f"{_STORED[key]}/{name}").select(*like.columns)
        relations = read("relations", kg.relations.drop("source_chunks"))
        return replace(kg, entities=read("entities", kg.entities), relations=relations.withColumn("source_chunks", F.array(F.col("first_doc_id"))))

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str) -> KnowledgeGraph:
        t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        day = lambda c: F.unix_date(F.col(c).cast("date"))
        iso = lambda c: F.date_format(F.col(c).cast("date"), "yyyy-MM-dd")
        supplier, customer, nation, region = t("supplier"), t("customer"), t("nation"), t("region")
        orders, lines, events = t("orders"), t("lineitem"), t("events")
        part_name = lambda c: F.concat(F.lit("Part#"), F.col(c).cast("string"))
        order_name = lambda c: F.concat(F.lit("Order#"), F.col(c).cast("string"))
        money = F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" RUB"))
        event_name = lambda c: F.concat(F.lit("Event#"), F.col(c).cast("string"))
        user_name = lambda c: F.concat(F.lit("User#"), F.col(c).cast("string"))
        epoch = F.unix_seconds(F.col("ts").cast("timestamp"))

        def ent(df: DataFrame, name, label: str, mentions=None, created=None, event_type=None, start=None) -> DataFrame:
            null = lambda x, kind: F.lit(None).cast(kind) if x is None else x.cast(kind)
            return df.select(
                name.alias("name"), F.lit(label).alias("label"), F.concat(F.lit(label + " "), name).alias("description"), null(mentions, "long").alias("mention_count"),
                null(created, "int").alias("created_at"), F.lit(None).cast("string").alias("first_doc_id"), null(event_type, "string").alias("event_type"),
                F.lit(None).cast("string").alias("event_ts_raw"), null(start, "long").alias("event_start_epoch"), null(start, "long").alias("event_end_epoch"),
                F.lit("second" if start is not None else None).cast("string").alias("event_ts_precision"),
            )

        n, lo = F.col("n"), F.col("lo")
        by_supplier = lines.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min(day("l_shipdate")).alias("lo"))
        by_part = lines.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.min(day("l_shipdate")).alias("lo"))
        by_customer = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min(day("o_orderdate")).alias("lo"))
        by_user = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min(day("ts")).alias("lo"))
        errors = events.filter("event_type = 'error'")
        bought = events.filter("event_type = 'purchase'")
        e1, p1 = errors.select("event_id", "user_id", "ts"), bought.select(F.col("event_id").alias("p_id"), F.col("user_id").alias("p_user"), F.col("ts").alias("p_ts"))
        solved = e1.join(p1, (F.col("user_id") == F.col("p_user")) & (F.col("p_ts") >= F.col("ts")) & (F.col("p_ts") <= F.col("ts") + F.expr("interval 24 hours")))
        entities = [
            ent(supplier.join(by_supplier, F.col("s_suppkey") == F.col("l_suppkey"), "left"), F.col("s_name"), "Organization", F.coalesce(n, F.lit(0)), lo),
            ent(customer.join(by_customer, F.col("c_custkey") == F.col("o_custkey"), "left"), F.col("c_name"), "Person", F.coalesce(n, F.lit(0)), lo),
            ent(t("part").join(by_part, F.col("p_partkey") == F.col("l_partkey"), "left"), part_name("p_partkey"), "Product", F.coalesce(n, F.lit(0)), lo),
            ent(nation, F.col("n_name"), "Location"),
            ent(region, F.col("r_name"), "Location"),
            ent(orders, order_name("o_orderkey"), "OrderNumber", F.lit(1), day("o_orderdate")),
            ent(orders.groupBy(money.alias("m")).agg(F.count(F.lit(1)).alias("n"), F.min(day("o_orderdate")).alias("lo")), F.col("m"), "Amount", n, lo),
            ent(orders.groupBy(iso("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.min(day("o_orderdate")).alias("lo")), F.col("m"), "DocumentDate", n, lo),
            ent(events, event_name("event_id"), "EventOrAction", F.lit(1), day("ts"), F.col("event_type"), epoch),
            ent(by_user, user_name("user_id"), "Person", n, lo),
            ent(errors, F.concat(F.lit("Issue#"), F.col("event_id").cast("string")), "Issue", F.lit(1), day("ts")),
            ent(bought, F.concat(F.lit("Resolution#"), F.col("event_id").cast("string")), "Resolution", F.lit(1), day("ts")),
        ]

        def rel(df: DataFrame, kind: str, src, tgt, polarity=None, lo=None, hi=None, weight=None, created=None, doc=None, extra=None) -> DataFrame:
            null = lambda x, k: F.lit(None).cast(k) if x is None else x.cast(k)
            key = [F.lit(kind), src, tgt] + ([extra] if extra is not None else [])
            return df.select(
                F.concat_ws("|", *key).alias("rel_id"), src.alias("src"), tgt.alias("tgt"), F.lit(kind).alias("rel_type"), null(polarity, "string").alias("polarity"),
                null(lo, "string").alias("valid_from"), null(hi, "string").alias("valid_to"), null(weight if weight is not None else F.lit(1.0), "double").alias("weight"),
                null(created, "int").alias("created_at"), null(doc, "string").alias("first_doc_id"),
            )

        s_name, c_name = supplier.select("s_suppkey", "s_name", "s_nationkey"), customer.select("c_custkey", "c_name", "c_nationkey")
        supplies = lines.groupBy("l_suppkey", "l_partkey", "l_returnflag").agg(
            F.count(F.lit(1)).alias("n"), F.min(iso("l_shipdate")).alias("f"), F.max(iso("l_shipdate")).alias("u"), F.min(day("l_shipdate")).alias("lo"), F.min("l_orderkey").alias("o")
        ).join(s_name, F.col("l_suppkey") == F.col("s_suppkey"))
        flag = F.when(F.col("l_returnflag") == "A", "affirmed").when(F.col("l_returnflag") == "R", "negated").otherwise("uncertain")
        contact = lines.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).join(
            orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")
        ).join(s_name, F.col("l_suppkey") == F.col("s_suppkey")).join(c_name, F.col("o_custkey") == F.col("c_custkey"))
        of_customer = orders.join(c_name, F.col("o_custkey") == F.col("c_custkey"))
        member = supplier.select(F.col("s_name").alias("x"), F.col("s_nationkey").alias("k")).union(customer.select("c_name", "c_nationkey")).join(nation, F.col("k") == F.col("n_nationkey"))
        block = supplier.withColumn("blk", F.floor(F.col("s_suppkey") / 4)).select("s_suppkey", "s_name", "blk")
        size = block.groupBy("blk").agg(F.max("s_suppkey").alias("last"), F.min("s_suppkey").alias("head"))
        ring = block.join(size, "blk").withColumn("nxt", F.when(F.col("s_suppkey") == F.col("last"), F.col("head")).otherwise(F.col("s_suppkey") + 1))
        owned = ring.alias("x").join(block.alias("y"), F.col("x.nxt") == F.col("y.s_suppkey")).filter("x.s_suppkey <> y.s_suppkey").select(F.col("x.s_name").alias("f"), F.col("y.s_name").alias("u"))
        relations = [
            rel(supplies, "SUPPLIES", F.col("s_name"), part_name("l_partkey"), flag, F.col("f"), F.col("u"), n, lo, order_name("o"), F.col("l_returnflag")),
            rel(contact, "CONTACT", F.col("c_name"), F.col("s_name"), None, None, None, n, day("o_orderdate"), order_name("l_orderkey"), F.col("l_orderkey").cast("string")),
            rel(of_customer, "PARTY_OF", F.col("c_name"), order_name("o_orderkey"), None, iso("o_orderdate"), None, None, day("o_orderdate")),
            rel(of_customer, "AMOUNT_OF", F.col("c_name"), money, None, iso("o_orderdate"), None, None, day("o_orderdate"), None, F.col("o_orderkey").cast("string")),
            rel(orders, "DATED", order_name("o_orderkey"), iso("o_orderdate"), None, None, None, None, day("o_orderdate")),
            rel(member, "MEMBER_OF", F.col("x"), F.col("n_name")),
            rel(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), "MEMBER_OF", F.col("n_name"), F.col("r_name")),
            rel(owned, "OWNS", F.col("f"), F.col("u")),
            rel(events, "PARTICIPATED_IN", event_name("event_id"), user_name("user_id"), F.when(F.col("event_type") == "error", "negated").otherwise("affirmed"), None, None, None, day("ts")),
            rel(solved, "RESOLVED_BY", F.concat(F.lit("Issue#"), F.col("event_id").cast("string")), F.concat(F.lit("Resolution#"), F.col("p_id").cast("string")), None, None, None, None, day("ts")),
        ]
        # the ends of the two grouped types before they are grouped, all others as they are
        in_orders = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(c_name, F.col("o_custkey") == F.col("c_custkey"))
        sold = lambda df, kind, src, tgt: df.join(s_name, F.col("l_suppkey") == F.col("s_suppkey")).select(src.alias("src"), tgt.alias("tgt"), F.lit(kind).alias("rel_type"))
        links = [sold(lines, "SUPPLIES", F.col("s_name"), part_name("l_partkey")), sold(in_orders, "CONTACT", F.col("c_name"), F.col("s_name"))]
        links += [r.select("src", "tgt", "rel_type") for r in relations[len(links) :]]
        union = lambda parts: __import__("functools").reduce(DataFrame.union, parts)
        people = supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("k")).union(customer.select("c_name", "c_nationkey"))
        placed = people.join(nation, F.col("k") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        one = placed.select("name", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("community_id"), F.lit(1).alias("level"))
        zero = placed.select("name", F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("community_id"), F.lit(0).alias("level"))
        titled = placed.groupBy(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit(1).alias("level"), F.col("n_name").alias("title")).agg(F.count(F.lit(1)).alias("member_count")).union(
            placed.groupBy(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(0).alias("level"), F.col("r_name").alias("title")).agg(F.count(F.lit(1)).alias("member_count"))
        )
        whole = union(relations).withColumn("source_chunks", F.array(F.col("first_doc_id")))
        return cls(
            entities=union(entities),
            relations=whole,
            mentions=lines.select(order_name("l_orderkey").alias("chunk_id"), part_name("l_partkey").alias("entity_name")),
            chunks=orders.select(order_name("o_orderkey").alias("chunk_id"), F.col("o_custkey").cast("string").alias("doc_id"), day("o_orderdate").alias("doc_date_epoch"), F.col("o_orderpriority").alias("doc_group")),
            communities=titled.withColumn("summary", F.concat(F.lit("Parties of "), F.col("title"))),
            in_community=zero.union(one),
            parent_of=nation.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child_id"), F.lit(1).alias("level")),
            links=(whole, union(links)),
        )


#: The same tables as DuckDB common table expressions; a query is this and its own SELECT.
KG_SQL = r"""
WITH e_sup AS (SELECT l_suppkey k, count(*) n, min(date_diff('day', DATE '1970-01-01', l_shipdate::DATE)) lo FROM lineitem GROUP BY 1),
e_part AS (SELECT l_partkey k, count(*) n, min(date_diff('day', DATE '1970-01-01', l_shipdate::DATE)) lo FROM lineitem GROUP BY 1),
e_cust AS (SELECT o_custkey k, count(*) n, min(date_diff('day', DATE '1970-01-01', o_orderdate::DATE)) lo FROM orders GROUP BY 1),
ord AS (SELECT *, 'Order#' || o_orderkey AS oname, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ' RUB' AS money,
  strftime(o_orderdate::DATE, '%Y-%m-%d') AS iso, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS dd FROM orders),
ev AS (SELECT *, date_diff('day', DATE '1970-01-01', ts::DATE) AS dd, date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) AS ep FROM events),
entities AS (
SELECT s_name AS name, 'Organization' AS label, coalesce(n, 0) AS mention_count, lo AS created_at, NULL::VARCHAR AS event_type, NULL::BIGINT AS event_start_epoch FROM supplier LEFT JOIN e_sup ON s_suppkey = k
UNION ALL SELECT c_name, 'Person', coalesce(n, 0), lo, NULL, NULL FROM customer LEFT JOIN e_cust ON c_custkey = k
UNION ALL SELECT 'Part#' || p_partkey, 'Product', coalesce(n, 0), lo, NULL, NULL FROM part LEFT JOIN e_part ON p_partkey = k
UNION ALL SELECT n_name, 'Location', NULL, NULL, NULL, NULL FROM nation
UNION ALL SELECT r_name, 'Location', NULL, NULL, NULL, NULL FROM region
UNION ALL SELECT oname, 'OrderNumber', 1, dd, NULL, NULL FROM ord
UNION ALL SELECT money, 'Amount', count(*), min(dd), NULL, NULL FROM ord GROUP BY 1
UNION ALL SELECT iso, 'DocumentDate', count(*), min(dd), NULL, NULL FROM ord GROUP BY 1
UNION ALL SELECT 'Event#' || event_id, 'EventOrAction', 1, dd, event_type, ep FROM ev
UNION ALL SELECT 'User#' || user_id, 'Person', count(*), min(dd), NULL, NULL FROM ev GROUP BY 1
UNION ALL SELECT 'Issue#' || event_id, 'Issue', 1, dd, NULL, NULL FROM ev WHERE event_type = 'error'
UNION ALL SELECT 'Resolution#' || event_id, 'Resolution', 1, dd, NULL, NULL FROM ev WHERE event_type = 'purchase'),
sup_edges AS (SELECT s_name, l_partkey, l_returnflag, count(*) n, min(strftime(l_shipdate::DATE, '%Y-%m-%d')) f, max(strftime(l_shipdate::DATE, '%Y-%m-%d')) u,
  min(date_diff('day', DATE '1970-01-01', l_shipdate::DATE)) lo, min(l_orderkey) o FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
blk AS (SELECT s_suppkey, s_name, s_suppkey // 4 AS b, max(s_suppkey) OVER (PARTITION BY s_suppkey // 4) AS last, min(s_suppkey) OVER (PARTITION BY s_suppkey // 4) AS head FROM supplier),
placed AS (SELECT name, n_nationkey, n_name, r_regionkey, r_name FROM (SELECT s_name AS name, s_nationkey AS k FROM supplier UNION ALL SELECT c_name, c_nationkey FROM customer)
  JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey),
relations AS (
SELECT concat_ws('|', 'SUPPLIES', s_name, 'Part#' || l_partkey, l_returnflag) AS rel_id, s_name AS src, 'Part#' || l_partkey AS tgt, 'SUPPLIES' AS rel_type,
  CASE l_returnflag WHEN 'A' THEN 'affirmed' WHEN 'R' THEN 'negated' ELSE 'uncertain' END AS polarity, f AS valid_from, u AS valid_to, n::DOUBLE AS weight, lo AS created_at, 'Order#' || o AS first_doc_id FROM sup_edges
UNION ALL SELECT concat_ws('|', 'CONTACT', c_name, s_name, l_orderkey), c_name, s_name, 'CONTACT', NULL, NULL, NULL, n::DOUBLE, dd, 'Order#' || l_orderkey
  FROM (SELECT l_orderkey, l_suppkey, count(*) n FROM lineitem GROUP BY 1, 2) JOIN ord ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT concat_ws('|', 'PARTY_OF', c_name, oname), c_name, oname, 'PARTY_OF', NULL, iso, NULL, 1.0, dd, NULL FROM ord JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT concat_ws('|', 'AMOUNT_OF', c_name, money, o_orderkey), c_name, money, 'AMOUNT_OF', NULL, iso, NULL, 1.0, dd, NULL FROM ord JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT concat_ws('|', 'DATED', oname, iso), oname, iso, 'DATED', NULL, NULL, NULL, 1.0, dd, NULL FROM ord
UNION ALL SELECT concat_ws('|', 'MEMBER_OF', name, n_name), name, n_name, 'MEMBER_OF', NULL, NULL, NULL, 1.0, NULL, NULL FROM placed
UNION ALL SELECT concat_ws('|', 'MEMBER_OF', n_name, r_name), n_name, r_name, 'MEMBER_OF', NULL, NULL, NULL, 1.0, NULL, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT concat_ws('|', 'OWNS', x.s_name, y.s_name), x.s_name, y.s_name, 'OWNS', NULL, NULL, NULL, 1.0, NULL, NULL
  FROM blk x JOIN supplier y ON y.s_suppkey = CASE WHEN x.s_suppkey = x.last THEN x.head ELSE x.s_suppkey + 1 END WHERE x.s_suppkey <> y.s_suppkey
UNION ALL SELECT concat_ws('|', 'PARTICIPATED_IN', 'Event#' || event_id, 'User#' || user_id), 'Event#' || event_id, 'User#' || user_id, 'PARTICIPATED_IN',
  CASE WHEN event_type = 'error' THEN 'negated' ELSE 'affirmed' END, NULL, NULL, 1.0, dd, NULL FROM ev
UNION ALL SELECT concat_ws('|', 'RESOLVED_BY', 'Issue#' || e.event_id, 'Resolution#' || p.event_id), 'Issue#' || e.event_id, 'Resolution#' || p.event_id, 'RESOLVED_BY', NULL, NULL, NULL, 1.0, e.dd, NULL
  FROM ev e JOIN ev p ON e.user_id = p.user_id AND e.event_type = 'error' AND p.event_type = 'purchase' AND p.ts >= e.ts AND p.ts <= e.ts + INTERVAL 24 HOUR),
u AS (SELECT src AS a, tgt AS b, * EXCLUDE (src, tgt) FROM relations UNION ALL SELECT tgt, src, * EXCLUDE (src, tgt) FROM relations WHERE src <> tgt),
mentions AS (SELECT 'Order#' || l_orderkey AS chunk_id, 'Part#' || l_partkey AS entity_name FROM lineitem),
chunks AS (SELECT oname AS chunk_id, dd AS doc_date_epoch, o_orderpriority AS doc_group FROM ord),
in_community AS (SELECT name, 'r' || r_regionkey AS community_id, 0 AS level FROM placed UNION ALL SELECT name, 'n' || n_nationkey, 1 FROM placed),
communities AS (SELECT 'r' || r_regionkey AS id, 0 AS level, r_name AS title, count(*) AS member_count, 'Parties of ' || r_name AS summary FROM placed GROUP BY r_regionkey, r_name
  UNION ALL SELECT 'n' || n_nationkey, 1, n_name, count(*), 'Parties of ' || n_name FROM placed GROUP BY n_nationkey, n_name),
idt AS (SELECT unnest(['Email','PhoneNumber','PostalAddress','DocumentDate','Amount','ContractNumber','OrderNumber','InvoiceNumber','INN','OGRN','BIC','BankAccount']) AS t)
"""
