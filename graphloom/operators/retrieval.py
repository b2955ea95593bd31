"""Search operators: nearest vectors, lexical ranking, fusion, merging, reranking and community selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators.primitives import first_per


def date_filter(df: DataFrame, col: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Inclusive bounds; rows without a date go as soon as a bound is set."""
    for v, op in ((since, "__ge__"), (until, "__le__")):
        if v is not None:
            df = df.filter(getattr(F.col(col), op)(v))
    return df


def group_filter(df: DataFrame, col: str, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> DataFrame:
    """Rows without a group fail an inclusion and pass an exclusion."""
    if include:
        df = df.filter(F.col(col).isin(*include))
    if exclude:
        df = df.filter(F.col(col).isNull() | ~F.col(col).isin(*exclude))
    return df


def knn(vectors: DataFrame, query: Sequence[float], k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k vectors of greatest cosine to one query; filters on ``vectors`` act before the cut."""
    q = np.asarray(query, np.float64)
    norm = float(np.linalg.norm(q))
    # the query is a literal of the plan, and every batch is one matrix product
    @F.pandas_udf("double")
    def cosine(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            out = np.zeros(len(s))
            ok = np.array([x is not None and len(x) == len(q) for x in s])
            if ok.any():
                m = np.stack(list(s[ok])).astype(np.float64)
                n = np.linalg.norm(m, axis=1) * norm
                out[ok] = np.divide(m @ q, n, out=np.zeros(len(m)), where=n > 0)
            yield pd.Series(out)

    return vectors.select(id_col, cosine(vec_col).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


#: Rows that are compared with a block of queries at a time.
JOIN_ROWS = 512


def knn_join(queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 1024) -> DataFrame:
    """(query_id, id, score, rank): for every query the k nearest vectors, exactly.

    The queries are a stated set; they are carried to the data in blocks, each task keeps its own k best for every query,
    and only those meet: k rows a query and task.
    """
    rows = [(r[0], r[1]) for r in queries.select(id_col, vec_col).toLocalIterator()]
    kind = queries.schema[id_col].dataType.simpleString()
    out = None
    for i in range(0, len(rows), block):
        ids = [r[0] for r in rows[i : i + block]]
        q = np.array([r[1] for r in rows[i : i + block]], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def run(it: Iterator[pd.DataFrame], ids=ids, q=q) -> Iterator[pd.DataFrame]:
            # what may be among the k best of each query so far: query, score and id, and the score that k others reach
            kept, least, size = [], np.full(len(ids), -np.inf), 0

            def cut() -> list:
                j, v, c = (np.concatenate(x) for x in zip(*kept))
                order = np.lexsort((c, -v, j))
                j, v, c = j[order], v[order], c[order]
                place = np.arange(len(j)) - np.searchsorted(j, j)
                full = place == k - 1
                least[j[full]] = v[full]
                top = place < k
                return [(j[top], v[top], c[top])]

            for pdf in it:
                for lo in range(0, len(pdf), JOIN_ROWS):
                    some = pdf.iloc[lo : lo + JOIN_ROWS]
                    m = np.stack(list(some[vec_col])).astype(np.float64)
                    m /= np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]
                    s = m @ q.T
                    # ties with the k-th stay until they are told apart by id
                    r, j = np.nonzero(~(s < least))
                    kept.append((j, s[r, j], some[id_col].to_numpy()[r]))
                    size += len(r)
                    if size > max(4 * k * len(ids), 65_536):
                        kept = cut()
                        size = len(kept[0][0])
            if kept:
                j, v, c = cut()[0]
                yield pd.DataFrame({"query_id": np.asarray(ids)[j], "id": c, "score": v})

        part = vectors.select(id_col, vec_col).filter(F.col(vec_col).isNotNull()).mapInPandas(run, f"query_id {kind}, id {kind}, score double")
        out = part if out is None else out.union(part)
    if out is None:
        return vectors.select(F.col(id_col).alias("query_id"), F.col(id_col).alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tokens(text) -> object:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def bm25(docs: DataFrame, query: str, k: int = 10, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the k best documents; ties by id. One pass counts what the formula needs, a second scores."""
    terms = sorted({w for w in __import__("re").findall(r"\w+", query.lower())})
    d = docs.select(F.col(id_col), tokens(F.col(text_col)).alias("t"))
    # documents shrink to their length and the query's term counts before anything is shuffled
    def times(w: str):
        return F.size(F.filter("t", lambda x: x == w))

    tf = d.select(id_col, F.size("t").alias("len"), *[times(w).alias(f"t{i}") for i, w in enumerate(terms)])
    stats = tf.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.count(F.when(F.col(f"t{i}") > 0, 1)).alias(f"d{i}") for i in range(len(terms))])
    x = tf.crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        f = F.col(f"t{i}")
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return x.select(id_col, score.alias("score")).filter("score > 0").orderBy(F.desc("score"), id_col).limit(k)


def rrf(rankings: DataFrame, constant: int = 60, k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of (source, id, rank): (id, score)."""
    return rankings.groupBy("id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def merge_first_wins(hits: DataFrame, key: str = "chunk_id", block: str = "block", pos: str = "pos") -> DataFrame:
    """Hits of several blocks without repeats: the first by block and position stays."""
    return first_per(hits, [key], block, pos)


def block_contributions(merged: DataFrame, block: str = "block") -> DataFrame:
    return merged.groupBy(block).agg(F.count(F.lit(1)).alias("n"))


def round_robin(hits: DataFrame, n: int, block: str = "block", pos: str = "pos", key: str = "chunk_id") -> DataFrame:
    """n candidates taken from the blocks in turn: all firsts, then all seconds."""
    r = hits.withColumn("rank_in_block", F.row_number().over(Window.partitionBy(block).orderBy(pos, key)))
    return r.orderBy("rank_in_block", block, key).limit(n)


def weigh_groups(scored: DataFrame, weights: dict[str, float], score: str = "score", group: str = "doc_group") -> DataFrame:
    """sigmoid(score) times the group's weight (1 without one), best first."""
    w = F.lit(1.0)
    for g, x in weights.items():
        w = F.when(F.col(group) == g, F.lit(float(x))).otherwise(w)
    return scored.withColumn("weighted", S.sigmoid(F.col(score)) * w).orderBy(F.desc("weighted"))


def append_unranked(ranked: DataFrame, pool: DataFrame, key: str = "chunk_id", pos: str = "pos", limit: int = 10_000) -> DataFrame:
    """(key, place): the ranked ones in their order, then the rest of the pool in its own, ``limit`` in all.

    The first ``limit`` are picked in parallel, so only they are numbered in one task.
    """
    rest = pool.join(ranked.select(key), key, "left_anti").select(key, F.lit(1).alias("part"), F.col(pos).alias("o"))
    both = ranked.select(key, F.lit(0).alias("part"), F.col("rank").alias("o")).union(rest).orderBy("part", "o", key).limit(limit)
    return both.withColumn("place", F.row_number().over(Window.orderBy("part", "o", key))).select(key, "place")


def distinct_documents(sources: DataFrame, limit: int, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    return sources.groupBy(doc).agg(F.min(pos).alias(pos)).orderBy(pos, doc).limit(limit)


def evidence_blob(sources: DataFrame, text: str = "text", pos: str = "pos", most: int = 12_000) -> DataFrame:
    """All texts in order, cut to so many characters. A text takes a character and its separator at least, so the first ``most`` texts fill them."""
    lead = sources.select(pos, F.substring(text, 1, most).alias(text)).orderBy(pos, text).limit(most)
    return lead.agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda x: x[text]), "\n\n"), 1, most).alias("blob"))


def communities_by_overlap(communities: DataFrame, query: str, budget: int) -> DataFrame:
    """By shared lower-case tokens with the query, ties by size and id."""
    q = F.array_distinct(tokens(F.lit(query)))
    c = communities.withColumn("overlap", F.size(F.array_intersect(F.array_distinct(tokens(F.concat_ws(" ", "title", "summary"))), q)))
    return c.orderBy(F.desc("overlap"), F.desc("member_count"), "id").limit(budget)


def communities_by_descent(communities: DataFrame, parent_of: DataFrame, query: str, budget: int, max_levels: int = 10) -> DataFrame:
    """Beam search from the roots: the best ``budget`` of each level go on to their children; leaves are selected, roots if there are none."""
    q = F.array_distinct(tokens(F.lit(query)))
    c = communities.withColumn("overlap", F.size(F.array_intersect(F.array_distinct(tokens(F.concat_ws(" ", "title", "summary"))), q)))
    order = [F.desc("overlap"), F.desc("member_count"), "id"]
    parents = parent_of.select(F.col("parent_id").alias("id")).distinct()
    front = c.join(parent_of.select(F.col("child_id").alias("id")).distinct(), "id", "left_anti")
    roots, leaves = front, None
    for _ in range(max_levels):
        beam = front.orderBy(*order).limit(budget)
        ends = beam.join(parents, "id", "left_anti")
        leaves = ends if leaves is None else leaves.union(ends)
        nxt = parent_of.join(beam.select(F.col("id").alias("parent_id")), "parent_id").select(F.col("child_id").alias("id")).distinct()
        front = c.join(nxt, "id")
        if not front.limit(1).count():
            break
    got = leaves.orderBy(*order).limit(budget)
    return got if got.limit(1).count() else roots.orderBy(*order).limit(budget)


def relevant_partials(partials: DataFrame) -> DataFrame:
    """Map answers that count: (source, score), irrelevant ones and those without a positive score dropped."""
    return partials.filter(F.col("relevant") & (F.col("score") > 0)).select(F.concat(F.lit("community:"), F.col("id")).alias("source"), "score").orderBy(F.desc("score"), "source")


def find_by_name(entities: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Entities that share tokens with the query, by the share of the query's tokens found, then of their own."""
    q = F.array_distinct(tokens(F.lit(query)))
    t = F.array_distinct(tokens(F.col("name")))
    hit = F.size(F.array_intersect(t, q))
    return entities.select("name", "label", (hit / F.size(q)).alias("score"), F.size(t).alias("n")).filter("score > 0").orderBy(F.desc("score"), "n", "name").limit(limit).drop("n")


def search_entities(entities: DataFrame, query: str, mode: str = "exact", label: str | None = None, limit: int = 20, least: float = 0.3) -> DataFrame:
    """exact, prefix (without case) or substring (by trigram similarity)."""
    e = entities if label is None else entities.filter(F.col("label") == label)
    if mode == "exact":
        return e.filter(F.col("name") == query).select("name", "label").orderBy("name").limit(limit)
    if mode == "prefix":
        return e.filter(F.lower("name").startswith(query.lower())).select("name", "label").orderBy("name").limit(limit)
    return e.select("name", "label", S.trigram_similarity(F.col("name"), F.lit(query)).alias("score")).filter(F.col("score") >= least).orderBy(F.desc("score"), "name").limit(limit)


def recent_history(turns: DataFrame, n: int = 6, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last n turns of every conversation."""
    w = Window.partitionBy(key).orderBy(F.desc(turn), "role", "text")
    return turns.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


# Route labels in the order of preference on equal places.
ROUTES = ("local", "global", "drift")


def parse_route(reply):
    """The label that occurs first in a reply; local without one."""
    low = F.lower(F.coalesce(reply, F.lit("")))
    at = {r: F.instr(low, r) for r in ROUTES}
    far = F.lit(2**31 - 1)
    pos = {r: F.when(p > 0, p).otherwise(far) for r, p in at.items()}
    first = F.least(*pos.values())
    return F.when(first == far, "local").when(pos["local"] == first, "local").when(pos["global"] == first, "global").otherwise("drift")
