"""Smaller operators around ingest, communities, pages and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators.primitives import first_per
from graphloom.plans.kg import KnowledgeGraph

# Country names that extractions mislabel as organisations.
COUNTRIES = (
    "россия", "рф", "российская федерация", "украина", "сша", "соединённые штаты", "иран", "ирак", "китай", "кнр", "германия", "фрг", "франция", "великобритания", "англия", "индия", "япония", "турция", "польша",
    "румыния", "казахстан", "белоруссия", "беларусь", "грузия", "армения", "азербайджан", "сирия", "израиль", "египет", "бразилия", "канада", "италия", "испания", "греция", "финляндия", "швеция", "норвегия",
    "молдова", "литва", "латвия", "эстония", "венгрия", "чехия", "словакия", "болгария", "сербия", "кндр", "южная корея", "вьетнам", "афганистан", "саудовская аравия", "оаэ", "катар", "йемен", "мали", "монако",
    "ливия", "судан", "нигерия", "пакистан", "индонезия", "мексика", "аргентина", "куба", "венесуэла", "узбекистан", "киргизия", "таджикистан", "монголия", "австралия", "нидерланды", "бельгия", "австрия",
    "швейцария", "португалия", "ирландия", "дания", "хорватия", "словения", "черногория", "russia", "ukraine", "iran", "china", "germany", "france", "usa", "uk", "india", "japan", "turkey", "poland", "romania",
    "greece", "kazakhstan",
)


def correct_labels(entities: DataFrame) -> DataFrame:
    """Countries become locations; of entities labelled Email those that are addresses of pages or handles become Document or Other."""
    n = F.trim(F.coalesce("name", F.lit("")))
    mail = n.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$") & ~n.contains("://")
    page = n.rlike(r"(?i)^(?:https?://|www\.)|://")
    fixed = F.when(F.col("label").isin("Organization", "Other", "Concept") & F.lower(n).isin(*COUNTRIES), "Location").when((F.col("label") == "Email") & ~mail, F.when(page, "Document").otherwise("Other"))
    return entities.withColumn("label", F.coalesce(fixed, F.col("label")))


def filter_spans(spans: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Spans (chunk, text, label, score, start) scored enough, one for each text without case and label: the first of the chunk."""
    s = spans.filter((F.col("score") >= threshold) & (F.trim("text") != "")).withColumn("k", F.lower(F.trim("text")))
    return first_per(s, ["chunk", "k", "label"], "start", F.desc("score")).drop("k")


def glean(first: DataFrame, second: DataFrame, key: str = "key") -> DataFrame:
    """Entities of a second pass are added only if their key was not seen in the first."""
    return first.unionByName(second.join(first.select(key), key, "left_anti").select(*first.columns))


def report_specs(communities: DataFrame, old: DataFrame) -> DataFrame:
    """Communities with the report of an unchanged (level, members_hash) carried over, and ``needs_report`` for the rest."""
    o = old.select("level", "members_hash", "report").groupBy("level", "members_hash").agg(F.max("report").alias("report"))
    return communities.join(o, ["level", "members_hash"], "left").withColumn("needs_report", F.col("report").isNull())


def summary_batches(texts: DataFrame, most: int = 150_000, key: str = "community", pos: str = "pos", text: str = "text") -> DataFrame:
    """A batch number for each text of a community, so that a batch starts anew at every ``most`` characters."""
    upto = F.sum(F.length(text)).over(Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    return texts.withColumn("batch", F.floor(F.coalesce(upto, F.lit(0)) / most).cast("int"))


def member_context(kg: KnowledgeGraph, community_id: str, level: int) -> DataFrame:
    """(name, label, rels): the members of a community and the types of their relations to other members."""
    m = kg.in_community.filter((F.col("community_id") == community_id) & (F.col("level") == level)).select("name").distinct()
    e = kg.undirected.select("a", "b", "rel_type").join(m.select(F.col("name").alias("a")), "a", "left_semi").join(m.select(F.col("name").alias("b")), "b", "left_semi")
    rels = e.groupBy(F.col("a").alias("name")).agg(F.array_sort(F.collect_set("rel_type")).alias("rels"))
    return m.join(kg.entities.select("name", "label"), "name").join(rels, "name", "left").select("name", "label", F.coalesce("rels", F.array().cast("array<string>")).alias("rels"))


def community_documents(kg: KnowledgeGraph, level: int = 0) -> DataFrame:
    """(community_id, doc_id): documents whose chunks mention a member."""
    c = kg.in_community.filter(F.col("level") == level).select(F.col("name").alias("entity_name"), "community_id")
    return kg.mentions.join(c, "entity_name").join(kg.chunks.select("chunk_id", "doc_id"), "chunk_id").select("community_id", "doc_id").distinct()


def duplicate_groups(entities: DataFrame, labels: int = 4) -> DataFrame:
    """Names that are the same without case: (key, n, labels), the commonest labels first."""
    e = entities.withColumn("key", F.lower("name"))
    by = e.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"))
    lab = by.groupBy("key").agg(F.sum("k").alias("n"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("o"), "label"))), lambda x: x["label"]), 1, labels).alias("labels"))
    return lab.filter("n > 1").orderBy(F.desc("n"), "key")


def pick_group(rows: DataFrame, order: list[str], key: str = "channel", group: str = "grp") -> DataFrame:
    """One group for each key: the first in the order, unknown ones last."""
    rank = F.lit(len(order))
    for i, g in reversed(list(enumerate(order))):
        rank = F.when(F.col(group) == g, i).otherwise(rank)
    return rows.groupBy(key).agg(F.min_by(group, F.struct(rank, F.col(group))).alias(group))


def graph_stats(kg: KnowledgeGraph) -> DataFrame:
    """Entities, relations, communities and groups of names that differ in case only; one row."""
    dup = kg.entities.groupBy(F.lower("name").alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    one = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    # four rows of one number each
    return one(kg.entities, "entities").crossJoin(one(kg.relations, "relations")).crossJoin(one(kg.communities, "communities")).crossJoin(one(dup, "duplicate_groups"))


def dirty_pages(entities: DataFrame, limit: int = 100) -> DataFrame:
    """Entities whose page is due, the oldest mark first."""
    return entities.filter("wiki_dirty").orderBy(F.asc_nulls_first("wiki_dirty_at"), "name").limit(limit)


def mark_dirty(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Names that changed: entities and the ends of relations."""
    return entities.select("name").union(relations.select("src")).union(relations.select("tgt")).filter("name IS NOT NULL").distinct()


def subgraph_hash(kg: KnowledgeGraph, names: DataFrame) -> DataFrame:
    """(name, hash) over an entity's sorted edges, by which an unchanged page is seen."""
    line = F.concat_ws("|", "rel_type", "b", F.coalesce("polarity", F.lit("")), F.coalesce("valid_from", F.lit("")), F.coalesce("valid_to", F.lit("")))
    e = kg.undirected.join(names.select(F.col("name").alias("a")), "a", "left_semi")
    return e.groupBy(F.col("a").alias("name")).agg(S.members_hash(F.collect_list(line)).alias("hash"))


def changed_pages(hashes: DataFrame, old: DataFrame) -> DataFrame:
    return hashes.join(old.select("name", "hash"), ["name", "hash"], "left_anti")


def first_citations(kg: KnowledgeGraph, name: str, k: int = 20) -> DataFrame:
    """(doc_id, chunk_id): of every document that mentions an entity its first chunk, oldest documents first."""
    c = kg.mentions.filter(F.col("entity_name") == name).select("chunk_id").distinct().join(kg.chunks, "chunk_id")
    return first_per(c, ["doc_id"], "doc_date_epoch", "chunk_id").orderBy("doc_date_epoch", "doc_id").limit(k).select("doc_id", "chunk_id", "doc_date_epoch")


def quota_used(requests: DataFrame, day, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Requests of a day by user."""
    return requests.filter(F.col(ts).cast("date") == F.lit(day).cast("date")).groupBy(key).agg(F.count(F.lit(1)).alias("used"))


def looks_russian(text):
    """At least six of ten letters are Cyrillic."""
    cyr, all_ = F.regexp_count(text, F.lit(r"[а-яёА-ЯЁ]")), F.regexp_count(text, F.lit(r"\p{L}"))
    return (all_ > 0) & (cyr >= 0.6 * all_)


def child_context(kg: KnowledgeGraph, community_id: str, level: int, most: int = 20) -> DataFrame:
    """(id, title, summary, member_count) of the communities below one, the largest first; those with a summary tell about it in its place."""
    below = kg.parent_of.filter((F.col("parent_id") == community_id) & (F.col("level") == level + 1)).select(F.col("child_id").alias("id"))
    c = kg.communities.filter((F.col("level") == level + 1) & (F.trim(F.coalesce("summary", F.lit(""))) != ""))
    return c.join(below, "id", "left_semi").select("id", "title", "summary", "member_count").orderBy(F.desc("member_count"), "id").limit(most)


def report_vectors(reports: DataFrame, vectors: DataFrame) -> DataFrame:
    """Reports with their vectors, by (id, level)."""
    return reports.join(vectors.select("id", "level", "embedding"), ["id", "level"], "left")


def run_overview(runs: DataFrame, key: str = "workflow") -> DataFrame:
    """(key, runs, one column a status, mean and longest seconds), by name; runs that have not ended have no duration."""
    took = F.col("ended") - F.col("started")
    by = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return runs.groupBy(key).agg(F.count(F.lit(1)).alias("runs"), *[by(s) for s in ("running", "completed", "failed")], F.avg(took).alias("mean"), F.max(took).alias("longest")).orderBy(key)


def run_steps(log: DataFrame, run_id) -> DataFrame:
    """The steps of one run in order: (step, activity, started, seconds, status)."""
    s = log.filter(F.col("run_id") == run_id)
    return s.select("step", "activity", "started", (F.col("ended") - F.col("started")).alias("seconds"), "status").orderBy("step")


# Fixed value: characters that a stored chunk's text may have.
MAX_STORED_CHARS = 64_000


def truncate_texts(chunks: DataFrame, text: str = "text", most: int = MAX_STORED_CHARS) -> DataFrame:
    """Texts cut to what the vector store takes, with ``truncated``; null stays null."""
    return chunks.withColumns({"truncated": F.coalesce(F.length(text) > most, F.lit(False)), text: F.substring(text, 1, most)})


def entity_mirror(old: DataFrame, entities: DataFrame) -> DataFrame:
    """The flat copy of the entities after an upsert by name: (name, label, description, mention_count)."""
    from graphloom.sources.sinks import upsert

    return upsert(old, entities.select("name", "label", "description", "mention_count"), ["name"])


def augment_block(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, block): one line a type with its canonical forms, sorted, to be put before a text that goes to extraction."""
    e = spans.select(id_col, F.explode("identifiers").alias("x")).select(id_col, "x.type", "x.canonical").distinct()
    line = e.groupBy(id_col, "type").agg(F.concat_ws(": ", F.col("type"), F.array_join(F.array_sort(F.collect_set("canonical")), ", ")).alias("line"))
    return line.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("block"))
