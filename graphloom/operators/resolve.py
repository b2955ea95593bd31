"""Building the graph from extractions: merging, entity resolution, event dedup, identifiers and gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators.components import connected_components
from graphloom.operators.primitives import first_per
from graphloom.operators.stats import majority
from graphloom.session import discard, reliable_checkpoint, stored

# Thresholds of entity resolution.
COSINE_FLOOR, COSINE_FLOOR_BARE, TOKEN_FLOOR, AUTO_MERGE = 0.55, 0.70, 0.5, 0.85
HUB_SIZE, VERIFY_SIZE = 12, 3


def merge_entities(nodes: DataFrame) -> DataFrame:
    """(key, name, label, descriptions, source_chunks, mention_count) by match key.

    nodes: name, label, description, chunk, pos (the order of arrival). The label is the majority's, the first on ties;
    chunks are distinct in order; mentions count all.
    """
    n = nodes.withColumn("key", S.match_key(F.col("name")))
    label = majority(n, ["key"], "label", "pos")
    firsts = n.groupBy("key", "chunk").agg(F.min("pos").alias("p")).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "chunk"))), lambda x: x["chunk"]).alias("source_chunks"))
    texts = n.filter("description IS NOT NULL AND description <> ''").groupBy("key", "description").agg(F.min("pos").alias("p")).groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "description"))), lambda x: x["description"]), "\n---\n").alias("description")
    )
    base = n.groupBy("key").agg(F.min_by("name", "pos").alias("name"), F.count(F.lit(1)).alias("mention_count"))
    return base.join(label, "key").join(firsts, "key", "left").join(texts, "key", "left")


def merge_relations(rels: DataFrame) -> DataFrame:
    """Relations of unordered pairs merged: (a, b, rel_type, polarity, valid_from, valid_to, weight, source_chunks, keywords).

    rels: src, tgt, label, keywords (array), polarity, valid_from, valid_to, chunk, pos. The type is the first keyword
    of all in order, else the majority label; windows are united; the weight is the number of distinct chunks.
    """
    r = rels.withColumns({"a": F.least("src", "tgt"), "b": F.greatest("src", "tgt")})
    k = ["a", "b"]
    words = r.select(*k, F.explode_outer("keywords").alias("w")).groupBy(*k).agg(F.array_sort(F.collect_set("w")).alias("keywords"))
    g = r.groupBy(*k).agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"), F.array_sort(F.collect_set("chunk")).alias("source_chunks"))
    out = g.join(words, k).join(majority(r, k, "polarity", "pos"), k).join(majority(r, k, "label", "pos"), k)
    kind = S.safe_label(F.coalesce(F.get("keywords", F.lit(0)), F.col("label")))
    return out.select(*k, kind.alias("rel_type"), "polarity", "valid_from", "valid_to", F.size("source_chunks").cast("double").alias("weight"), "source_chunks", "keywords")


def orphan_endpoints(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Endpoints without an entity, to be added with the label Other; repeated relations and null ends add nothing."""
    ends = relations.select(F.col("src").alias("name")).union(relations.select("tgt")).filter("name IS NOT NULL").distinct()
    return ends.join(entities.select("name"), "name", "left_anti").withColumn("label", F.lit("Other"))


def er_eligible(entities: DataFrame) -> DataFrame:
    """No identifiers, and no short single words that are hardly mentioned and not described."""
    generic = (F.size(F.split(F.trim("name"), r"\s+")) == 1) & (F.length(F.trim("name")) < 5) & (F.coalesce("mention_count", F.lit(0)) <= 1) & (F.coalesce("description", F.lit("")) == "")
    return entities.filter(~S.is_identifier(F.col("label")) & ~generic)


def deterministic_pairs(entities: DataFrame) -> DataFrame:
    """(a, b, reason): same label and deep-normalised name, or persons of one surname and initial; stars around the smallest name."""
    keys = entities.select("name", "label", S.deep_normalize(F.col("name")).alias("k"), F.lit("name").alias("reason")).union(
        entities.filter("label = 'Person'").select("name", "label", S.initials_signature(F.col("name")), F.lit("initials"))
    ).filter("k IS NOT NULL AND k <> ''")
    lead = keys.groupBy("label", "k", "reason").agg(F.min("name").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keys.join(lead, ["label", "k", "reason"]).filter("name <> a").select("a", F.col("name").alias("b"), "reason").distinct()


def pair_cosines(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of the rows i of x with the rows j of y. The sums run from the first dimension on, so that copies of a vector have the very same cosines."""
    out = np.empty(len(i))
    xx, yy = np.sqrt(_dots(x, x)), np.sqrt(_dots(y, y))
    for lo in range(0, len(i), 1 << 18):
        p, q = i[lo : lo + (1 << 18)], j[lo : lo + (1 << 18)]
        with np.errstate(invalid="ignore", divide="ignore"):
            out[lo : lo + (1 << 18)] = np.where((xx[p] == 0) | (yy[q] == 0), 0.0, _dots(x[p], y[q]) / xx[p] / yy[q])
    return out


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, from the first dimension on."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


#: What a matrix product's cosine may be off by; whatever lies so near to a limit is computed again by :func:`pair_cosines`.
_ROUGH = 1e-9


def candidate_pairs(items: DataFrame, floor: float = COSINE_FLOOR, floor_bare: float = COSINE_FLOOR_BARE, token_floor: float = TOKEN_FLOOR, auto: float = AUTO_MERGE, top_k: int = 10, block_rows: int = 2000) -> DataFrame:
    """(a, b, cosine, overlap, decision) within labels: vectors near enough, or enough shared name tokens.

    items: name, label, description, embedding. Blocks of one label meet pairwise as matrices (block_rows rows each, so no
    task holds a whole label); every item keeps its top_k by cosine, then overlap and name, of each meeting and then of all. 'auto' needs the same
    unmixed script, others are 'borderline'.
    """
    it = items.select("name", "label", (F.coalesce("description", F.lit("")) == "").alias("bare"), "embedding", S.name_tokens(F.col("name")).alias("tokens"), S.script_of(F.col("name")).alias("script"))
    size = it.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    b = it.join(size, "label").withColumn("blk", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    met = b.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"p": F.least("blk", "o"), "q": F.greatest("blk", "o")})

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        """Of each row of x the top_k rows of y; a row is no partner of itself."""
        vx, vy = (np.stack(z["embedding"].to_list()).astype(np.float64) for z in (x, y))
        cos = _unit(vx) @ _unit(vy).T
        need = np.where(x["bare"].to_numpy(bool)[:, None] | y["bare"].to_numpy(bool)[None, :], floor_bare, floor)
        where: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})
        for z, w in ((x, where[0]), (y, where[1])):
            for i, tokens in enumerate(z["tokens"]):
                for token in set(tokens):
                    w.setdefault(token, []).append(i)
        both = np.zeros_like(cos)
        for token, i in where[0].items():
            if token in where[1]:
                both[np.ix_(i, where[1][token])] += 1
        n = [np.array([len(set(t)) for t in z["tokens"]], np.float64) for z in (x, y)]
        over = both / np.maximum(n[0][:, None] + n[1][None, :] - both, 1.0)
        i, j = np.nonzero(np.abs(cos - need) <= _ROUGH)
        cos[i, j] = pair_cosines(vx, vy, i, j)
        ok = (cos >= need) | (over >= token_floor)
        if x is y:
            np.fill_diagonal(ok, False)
        # those that may be among the best, by exact cosines
        rough = np.where(ok, cos, -np.inf)
        if rough.shape[1] > top_k:
            ok &= rough >= np.partition(rough, -top_k, axis=1)[:, -top_k][:, None] - 2 * _ROUGH
        i, j = np.nonzero(ok)
        sx, sy = x["script"].to_numpy(), y["script"].to_numpy()
        out = pd.DataFrame({"a": x["name"].to_numpy()[i], "b": y["name"].to_numpy()[j], "cosine": pair_cosines(vx, vy, i, j), "overlap": over[i, j], "same_script": (sx[i] == sy[j]) & (sx[i] != "mixed"), "i": i})
        out = out.sort_values(["i", "cosine", "overlap", "b"], ascending=[True, False, False, True])
        return out[out.groupby("i").cumcount() < top_k].drop(columns="i")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[1] == key[2]:
            return best(pdf, pdf)
        p, q = pdf[pdf["blk"] == key[1]], pdf[pdf["blk"] == key[2]]
        return pd.concat([best(p, q), best(q, p)]) if len(p) and len(q) else pd.DataFrame({"a": [], "b": [], "cosine": [], "overlap": [], "same_script": []})

    found = met.groupBy("label", "p", "q").applyInPandas(run, "a string, b string, cosine double, overlap double, same_script boolean")
    top = found.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), F.desc("overlap"), "b"))).filter(F.col("k") <= top_k)
    pair = top.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("cosine").alias("cosine"), F.max("overlap").alias("overlap"), F.max("same_script").alias("same_script"))
    return pair.select("a", "b", "cosine", "overlap", F.when((F.col("cosine") >= auto) & F.col("same_script"), "auto").otherwise("borderline").alias("decision"))


def judged(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pairs to merge: automatic ones and those with a stored verdict 'same'; without a verdict they differ."""
    v = verdicts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "same")
    return pairs.join(v, ["a", "b"], "left").filter((F.col("decision") == "auto") | F.coalesce("same", F.lit(False))).select("a", "b")


def clusters(pairs: DataFrame) -> DataFrame:
    """(name, cluster, size, review, verify) of merged names: clusters of HUB_SIZE are held for review, of VERIFY_SIZE verified."""
    c = connected_components(pairs)
    size = c.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return c.join(size, "component").select(F.col("node").alias("name"), F.col("component").alias("cluster"), "size", (F.col("size") >= HUB_SIZE).alias("review"), (F.col("size") >= VERIFY_SIZE).alias("verify"))


def canonical_names(members: DataFrame) -> DataFrame:
    """(cluster, canonical): a stored one, then more mentions, a longer name, Cyrillic, and the greater name.

    members: cluster, name, mention_count, stored (boolean).
    """
    rank = F.struct(F.coalesce("stored", F.lit(False)), F.coalesce("mention_count", F.lit(0)), F.length("name"), F.col("name").rlike("[Ѐ-ӿ]"), F.col("name"))
    return members.groupBy("cluster").agg(F.max_by("name", rank).alias("canonical"))


def consolidate(members: DataFrame) -> DataFrame:
    """(cluster, canonical, label, mention_count, aliases): mentions summed (1 at least each), the majority label, sorted aliases."""
    label = majority(members, ["cluster"], "label", "name")
    g = members.groupBy("cluster").agg(F.sum(F.greatest(F.coalesce("mention_count", F.lit(0)), F.lit(1))).alias("mention_count"), F.array_sort(F.collect_set("name")).alias("names"))
    out = g.join(canonical_names(members), "cluster").join(label, "cluster")
    return out.select("cluster", "canonical", "label", "mention_count", F.array_remove("names", F.col("canonical")).alias("aliases"))


def collapse_aliases(aliases: DataFrame, max_rounds: int = 30) -> DataFrame:
    """(name, canonical) with chains followed to their end; a cycle ends at its smallest name."""
    now = reliable_checkpoint(aliases.filter("name <> canonical").select("name", "canonical").groupBy("name").agg(F.min("canonical").alias("canonical")))
    for _ in range(max_rounds):
        nxt = now.alias("x").join(now.alias("y"), F.col("x.canonical") == F.col("y.name"), "left").select("x.name", F.when(F.col("y.canonical") == F.col("x.name"), F.least("x.name", "x.canonical")).otherwise(F.coalesce("y.canonical", "x.canonical")).alias("canonical"))
        nxt = reliable_checkpoint(nxt)
        if not nxt.join(now, ["name", "canonical"], "left_anti").limit(1).count():
            break
        now = nxt
    return nxt.filter("name <> canonical")


def rewrite_relations(relations: DataFrame, aliases: DataFrame) -> DataFrame:
    """Ends renamed, self-loops dropped, unordered pairs of a type merged: the longest description, summed weights, united chunks."""
    al = lambda c: aliases.select(F.col("name").alias(c), F.col("canonical").alias(f"{c}_to"))
    r = relations.join(al("src"), "src", "left").join(al("tgt"), "tgt", "left")
    r = r.withColumns({"s": F.coalesce("src_to", "src"), "t": F.coalesce("tgt_to", "tgt")}).filter("s <> t")
    g = r.groupBy(F.least("s", "t").alias("src"), F.greatest("s", "t").alias("tgt"), "rel_type")
    return g.agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"), F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_chunks")))).alias("source_chunks"))


def event_bucket(start, days: int = 7):
    """ISO year and week for seven days, else a number of that many days; a mark for events without a time."""
    d = F.to_date(F.timestamp_seconds(start))
    if days == 7:
        label = F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    else:
        label = F.floor((F.unix_date(d) + 719163) / days).cast("string")
    return F.coalesce(label, F.lit("none"))


def merge_events(events: DataFrame, days: int = 7) -> DataFrame:
    """Events of one type, set of participants and time bucket: the first name, the earliest interval, all names and chunks.

    events: name, event_type, participants (array), start, end, chunk, pos.
    """
    who = F.array_join(F.array_sort(F.array_distinct(F.transform("participants", lambda p: S.deep_normalize(p)))), "|")
    e = events.withColumns({"k_type": F.lower("event_type"), "k_who": who, "k_when": event_bucket(F.col("start"), days)})
    k = ["k_type", "k_who", "k_when"]
    return e.groupBy(*k).agg(
        F.min_by("name", "pos").alias("name"), F.min("start").alias("start"), F.min_by("end", F.struct("start", "pos")).alias("end"), F.array_sort(F.collect_set("name")).alias("names"),
        F.array_sort(F.collect_set("chunk")).alias("source_chunks"), F.count(F.lit(1)).alias("merged"),
    )


def cross_channel_events(events: DataFrame, entities: DataFrame, floor: float = 0.88, block_rows: int = 4096) -> DataFrame:
    """(event, entity, score): of entities in the same chunk the one of greatest cosine at or above the floor, the later on ties.

    Blocks of a chunk's events and entities meet as matrices (block_rows rows each, so no task holds a chunk), and a meeting gives one row an event.
    Vectors that are null, zero, hold nulls or are of another length than the other have a cosine of 0.
    """
    def blocks(df: DataFrame, name: str, *more: str) -> tuple[DataFrame, DataFrame]:
        whole = F.when(F.forall("embedding", lambda v: v.isNotNull()), F.col("embedding").cast("array<double>"))
        rows = df.select(F.col("name").alias(name), F.explode("source_chunks").alias("chunk"), whole.alias("v"), *more).filter(F.col(name).isNotNull())
        return rows, rows.groupBy("chunk").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(f"{name}_blocks"))

    (x, nx), (y, ny) = blocks(events, "event"), blocks(entities, "entity", "pos")
    grid = nx.join(ny, "chunk")
    deal = lambda c: F.pmod(F.xxhash64(c), F.col(f"{c}_blocks")).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(f"{c}_blocks") - 1))
    x = x.join(grid, "chunk").withColumn("p", deal("event")).withColumn("q", each("entity")).select("chunk", "p", "q", "event", "v")
    y = y.join(grid, "chunk").withColumn("q", deal("entity")).withColumn("p", each("event")).select("chunk", "p", "q", "entity", "v", "pos")
    schema = f"event string, entity string, score double, pos {y.schema['pos'].dataType.simpleString()}"

    def matrix(v: pd.Series, dims: int) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([-1 if a is None else len(a) for a in v])
        m = np.zeros((len(v), dims))
        for i, a in enumerate(v):
            if size[i] > 0:
                m[i, : size[i]] = a
        return m, size

    def meet(_: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"event": [], "entity": [], "score": [], "pos": []})]
        if not len(a) or not len(b):
            return out[0]
        # the later of equal cosines comes first
        b = b.sort_values(["pos", "entity"], ascending=False).reset_index(drop=True)
        dims = max((len(v) for v in [*a["v"], *b["v"]] if v is not None), default=0)
        (va, sa), (vb, sb) = matrix(a["v"], dims), matrix(b["v"], dims)
        ua, ub, event, entity, pos = _unit(va), _unit(vb), a["event"].to_numpy(), b["entity"].to_numpy(), b["pos"].to_numpy()
        for lo in range(0, len(a), 512):
            same = (sa[lo : lo + 512, None] == sb[None, :]) & (sa[lo : lo + 512, None] >= 0)
            cos = np.where(same, ua[lo : lo + 512] @ ub.T, 0.0)
            # not a number is above every number
            cos[np.isnan(cos)] = np.inf
            cos[event[lo : lo + 512, None] == entity[None, :]] = -np.inf
            top = cos.max(axis=1, keepdims=True)
            i, j = np.nonzero((cos >= np.maximum(np.where(np.isinf(top), top, top - 2 * _ROUGH), floor - _ROUGH)) & (cos > -np.inf))
            score = np.where(same[i, j], pair_cosines(va[lo : lo + 512], vb, i, j), 0.0)
            got = pd.DataFrame({"i": i, "j": j, "score": score, "by": np.where(np.isnan(score), np.inf, score)})
            got = got[got["by"] >= floor].sort_values(["i", "by", "j"], ascending=[True, False, True]).drop_duplicates("i")
            i, j = got["i"].to_numpy(), got["j"].to_numpy()
            out.append(pd.DataFrame({"event": event[lo + i], "entity": entity[j], "score": got["score"].to_numpy(), "pos": pos[j]}))
        return pd.concat(out[1:])

    by = ["chunk", "p", "q"]
    j = x.groupBy(*by).cogroup(y.groupBy(*by)).applyInPandas(meet, schema)
    return j.groupBy("event").agg(F.max_by("entity", F.struct("score", "pos", "entity")).alias("entity"), F.max("score").alias("score"))


def classify(docs: DataFrame, name: str, size: str, extensions: tuple[str, ...], min_size: int, max_size: int) -> DataFrame:
    """Ingest gate: adds ``skip`` and ``reason``."""
    ext = F.lower(F.regexp_extract(F.col(name), r"(\.[^./\\]+)$", 1))
    reason = F.when(~ext.isin(*extensions), "extension").when(F.col(size) < min_size, "too_small").when(F.col(size) > max_size, "too_large")
    return docs.withColumns({"reason": reason, "skip": reason.isNotNull()})


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = 512, overlap: int = 50) -> DataFrame:
    """(id, position, text): sentences packed into chunks of up to chunk_tokens words, the last ``overlap`` words' sentences repeated."""
    import re

    def pack(text: str | None) -> list[str]:
        sents = [s for s in re.split(r"(?<=[.!?…])\s+|\n+", text or "") if s.strip()]
        words = [len(s.split()) for s in sents]
        out, i = [], 0
        while i < len(sents):
            j, n = i, 0
            while j < len(sents) and (j == i or n + words[j] <= chunk_tokens):
                n += words[j]
                j += 1
            out.append(" ".join(sents[i:j]))
            if j >= len(sents):
                break
            back, k = 0, j
            while k > i + 1 and back + words[k - 1] <= overlap:
                k -= 1
                back += words[k]
            i = k
        return out

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(i, p, t) for i, x in zip(pdf["id"], pdf["text"], strict=True) for p, t in enumerate(pack(x))]
            yield pd.DataFrame(rows, columns=["id", "position", "text"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, position int, text string").withColumnRenamed("id", id_col)


def unchanged(docs: DataFrame, seen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose text was not transformed before: seen has (id, text_hash)."""
    h = docs.withColumn("text_hash", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return h.join(seen.select(id_col, "text_hash"), [id_col, "text_hash"], "left_anti")


def _directions(vectors) -> list[np.ndarray]:
    """Unit vectors; what has no direction (null, empty, zero) is near nothing and stays so."""
    out = []
    for v in vectors:
        x = np.asarray([] if v is None else v, np.float64)
        out.append(x / max(np.linalg.norm(x), 1e-300))
    return out


def _groups(vectors: list[np.ndarray], keys: list) -> dict[tuple, list[int]]:
    """The places of the vectors of each key and length."""
    out: dict[tuple, list[int]] = {}
    for i, (x, k) in enumerate(zip(vectors, keys, strict=True)):
        out.setdefault((k, len(x)), []).append(i)
    return out


def _seeds_among(vectors: list[np.ndarray], keys: list, floor: float) -> list[int]:
    """The places of those that are near to no earlier seed, by a sequential pass."""
    out: list[int] = []
    for (_, size), rows in _groups(vectors, keys).items():
        m = np.stack([vectors[i] for i in rows])
        near = m @ m.T >= floor if size else np.zeros((len(rows),) * 2, bool)
        taken: list[int] = []
        for i in range(len(rows)):
            if not near[i, taken].any():
                taken.append(i)
        out += [rows[i] for i in taken]
    return sorted(out)


def _first_near(vectors: list[np.ndarray], keys: list, seeds: list[np.ndarray], seed_keys: list, floor: float) -> list[int | None]:
    """Of each vector the number of the first seed of its key and length that is near enough."""
    groups = _groups(seeds, seed_keys)
    out: list[int | None] = [None] * len(vectors)
    for g, rows in _groups(vectors, keys).items():
        if g in groups and g[1]:
            near = np.stack([vectors[i] for i in rows]) @ np.stack([seeds[i] for i in groups[g]]).T >= floor
            for i, hit, first in zip(rows, near.any(axis=1), near.argmax(axis=1), strict=True):
                out[i] = groups[g][first] if hit else None
    return out


def greedy_clusters(claims: DataFrame, floor: float = 0.83, key: str | None = None, block: int = 2048) -> DataFrame:
    """(id, cluster) in the order of ``pos``, then ``id``: a claim joins the first seed it is near enough to, else it becomes one; by ``key`` if given.

    The result is that of a sequential pass, in parallel rounds. The first ``block`` claims that are still open choose the
    next seeds among themselves (all seeds before them are known not to be near), and all other open claims look at those seeds at
    once, in every task. So a task holds a block of seeds, no pairs are made, and claims that many are near to are
    settled in one round; there are as many rounds as blocks of claims that are near to none before them. Clusters are numbered from 0 in the order
    of their seeds (of a key's seeds, if given). Vectors without direction or of another length are near nothing.
    """
    spark = claims.sparkSession
    k = F.lit(None).cast("string") if key is None else F.coalesce(F.col(key).cast("string"), F.lit(""))
    todo, at = stored(claims.select("id", "pos", k.alias("k"), "embedding"))
    id_type = dict(todo.dtypes)["id"]
    fields = f"id {id_type}, pos {dict(todo.dtypes)['pos']}, k string, embedding {dict(todo.dtypes)['embedding']}, seed long"
    done, paths, count = None, [], 0
    while rows := todo.orderBy("pos", "id").limit(block).collect():
        vectors, keys = _directions(r["embedding"] for r in rows), [r["k"] for r in rows]
        chosen = _seeds_among(vectors, keys, floor)
        seeds, seed_keys = [vectors[i] for i in chosen], [keys[i] for i in chosen]
        own = {(rows[i]["pos"], rows[i]["id"]): n for n, i in enumerate(chosen)}

        def run(it: Iterator[pd.DataFrame], seeds=seeds, seed_keys=seed_keys, own=own, count=count) -> Iterator[pd.DataFrame]:
            for pdf in it:
                near = _first_near(_directions(pdf["embedding"]), [None if x is None or x != x else x for x in pdf["k"]], seeds, seed_keys, floor)
                # a seed without direction is near nothing, itself included
                near = [own.get((p, i)) if n is None else n for n, p, i in zip(near, pdf["pos"], pdf["id"], strict=True)]
                seed = pd.array([None if n is None else count + n for n in near], dtype="Int64")
                yield pdf.assign(seed=seed, embedding=[None if n is not None else e for n, e in zip(near, pdf["embedding"], strict=True)])

        looked, path = stored(todo.mapInPandas(run, fields))
        discard(spark, at) if count == 0 else None
        paths.append(path)
        settled = looked.filter("seed IS NOT NULL").select("id", "k", "seed")
        done = settled if done is None else done.union(settled)
        todo, count = looked.filter("seed IS NULL").drop("seed"), count + len(chosen)
    if done is None:
        return todo.select("id", F.lit(0).alias("cluster"))
    if key is not None:
        # seeds of a key, narrow rows
        order = done.select("k", "seed").distinct().withColumn("cluster", F.row_number().over(Window.partitionBy("k").orderBy("seed")) - 1)
        out = stored(done.join(order, ["k", "seed"]).select("id", "cluster"))[0]
    else:
        out = stored(done.select("id", F.col("seed").cast("int").alias("cluster")))[0]
    discard(spark, *paths)
    return out


def parse_extractions(chunks: DataFrame, raw: str = "extract_raw", chunk: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """Tuples of an extraction reply as (entities, relations); reading stops at the end mark, malformed tuples are left out."""
    head = F.split_part(F.col(raw), F.lit("<|COMPLETE|>"), F.lit(1))
    rec = chunks.select(chunk, F.posexplode(F.split(head, r"\n+|##")).alias("pos", "line"))
    f = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\(|\)$", ""), r"<\|#\|>"), lambda x: F.regexp_replace(F.trim(x), r"^\"|\"$", ""))
    rec = rec.select(chunk, "pos", f.alias("f")).withColumn("kind", F.lower(F.get("f", F.lit(0))))
    at = lambda i: F.get("f", F.lit(i))
    ents = rec.filter((F.col("kind") == "entity") & (F.size("f") >= 4) & (at(1) != "")).select(F.col(chunk), "pos", at(1).alias("name"), at(2).alias("label"), at(3).alias("description"))
    ents = first_per(ents.withColumn("key", S.match_key(F.col("name"))), [chunk, "key"], "pos")
    rels = rec.filter((F.col("kind").isin("relation", "relationship")) & (F.size("f") >= 5) & (at(1) != "") & (at(2) != "") & (at(1) != at(2))).select(
        F.col(chunk), "pos", at(1).alias("src"), at(2).alias("tgt"), F.filter(F.transform(F.split(at(3), ","), lambda x: F.trim(x)), lambda x: x != "").alias("keywords"), at(4).alias("description"),
        S.normalize_polarity(at(5)).alias("polarity"), S.valid_bound(F.split_part(at(6), F.lit(".."), F.lit(1))).alias("valid_from"), S.valid_bound(F.when(at(6).contains(".."), F.split_part(at(6), F.lit(".."), F.lit(2)))).alias("valid_to"),
    )
    return ents, rels


def supported_bounds(rels: DataFrame, text: str = "text") -> DataFrame:
    """Date bounds whose year does not stand in the chunk's text are dropped."""
    keep = lambda c: F.when(F.contains(F.col(text), F.substring(c, 1, 4)), F.col(c))
    return rels.withColumns({"valid_from": keep("valid_from"), "valid_to": keep("valid_to")})


def first_seen(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """(key, created_at, first_doc_id): the stamp that was there first stays."""
    n = new.groupBy(key).agg(F.min(F.struct("created_at", "first_doc_id")).alias("n"))
    j = old.select(key, F.struct("created_at", "first_doc_id").alias("o")).join(n, key, "full")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    return j.select(key, pick("created_at"), pick("first_doc_id"))


def activity_timings(log: DataFrame) -> DataFrame:
    """One row an attempt from an event log (kind, scheduled_id, attempt, ts): wait and run seconds, at least 0."""
    k = ["scheduled_id"]
    sch = log.filter("kind = 'SCHEDULED'").groupBy(*k).agg(F.min("ts").alias("scheduled"), F.first("activity").alias("activity"))
    sta = log.filter("kind = 'STARTED'").groupBy(*k, "attempt").agg(F.min("ts").alias("started"))
    end = log.filter("kind IN ('COMPLETED', 'FAILED', 'TIMED_OUT', 'CANCELED')").groupBy(*k, "attempt").agg(F.min("ts").alias("ended"), F.first("kind").alias("outcome"))
    j = sch.join(sta, k).join(end, [*k, "attempt"], "left")
    return j.select(*k, "activity", "attempt", "outcome", F.greatest(F.col("started") - F.col("scheduled"), F.lit(0)).alias("wait"), F.greatest(F.col("ended") - F.col("started"), F.lit(0)).alias("run"))


def nearest_stored(items: DataFrame, stored: DataFrame, k: int = 10, floor: float = COSINE_FLOOR, bands: int = 32, bits: int = 8, seed: int = 5) -> DataFrame:
    """(a, b, cosine): for each item the k nearest stored entities of its label, through random-hyperplane bands.

    items and stored: name, label, embedding. A pair meets if it falls on the same side of all hyperplanes of some band
    (at a cosine of 0.85 with a probability over 0.99), and is then compared exactly; no label is compared as a whole.
    """

    def keys(df: DataFrame, name: str, vec: str) -> DataFrame:
        @F.pandas_udf("array<long>")
        def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            planes: dict[int, np.ndarray] = {}
            for s in it:
                out = []
                for v in s:
                    x = np.asarray([] if v is None else v, np.float64)
                    if not len(x):
                        out.append([])
                        continue
                    if len(x) not in planes:
                        planes[len(x)] = np.random.default_rng(seed).standard_normal((bands * bits, len(x)))
                    sides = (planes[len(x)] @ x > 0).reshape(bands, bits)
                    out.append((np.packbits(sides, axis=1, bitorder="little")[:, 0].astype(np.int64) + np.arange(bands) * 256).tolist())
                yield pd.Series(out)

        return df.select(F.col("name").alias(name), "label", F.col("embedding").alias(vec), F.explode(run("embedding")).alias("band"))

    met = keys(items, "a", "va").join(keys(stored, "b", "vb"), ["label", "band"]).filter("a <> b").select("a", "b", "va", "vb").dropDuplicates(["a", "b"])
    near = met.select("a", "b", S.cosine(F.col("va"), F.col("vb")).alias("cosine")).filter(F.col("cosine") >= floor)
    return near.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).filter(F.col("k") <= k).drop("k")


def consolidate_phones(entities: DataFrame) -> DataFrame:
    """(canonical, name, mention_count): phone entities by their E.164 form; the name most mentioned stands for the group."""
    digits = F.regexp_replace("name", r"\D", "")
    plus = F.trim("name").startswith("+")
    e164 = F.when(plus & F.length(digits).between(10, 15), F.concat(F.lit("+"), digits)).when((F.length(digits) == 11) & digits.rlike("^[78]"), F.concat(F.lit("+7"), F.substring(digits, 2, 10))).when((F.length(digits) == 10) & digits.rlike("^[3489]"), F.concat(F.lit("+7"), digits))
    p = entities.filter("label = 'PhoneNumber'").withColumn("canonical", e164).filter("canonical IS NOT NULL")
    return p.groupBy("canonical").agg(F.max_by("name", F.struct(F.coalesce("mention_count", F.lit(0)), F.col("name"))).alias("name"), F.sum(F.coalesce("mention_count", F.lit(0))).alias("mention_count"))


def duplicate_identifiers(entities: DataFrame) -> DataFrame:
    """(name, canonical): identifiers that differ only in case, spaces and signs, each with the one that it is merged into (most mentioned, then the smaller name)."""
    i = entities.filter(S.is_identifier(F.col("label"))).withColumn("key", F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}@.+]", ""))
    best = i.groupBy("label", "key").agg(F.min_by("name", F.struct(-F.coalesce("mention_count", F.lit(0)), F.col("name"))).alias("canonical"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return i.join(best, ["label", "key"]).filter("name <> canonical").select("name", "canonical")


# Event types; all others count as ``other``.
EVENT_TYPES = ("deal", "appointment", "lawsuit", "incident", "payment", "meeting", "sanction", "other")
EVENT_NAME_CHARS = 120


def events_to_graph(events: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Extracted events as (entities, PARTICIPATED_IN relations from an event to each participant).

    events: event_type, trigger, participants (array), start, end, precision, chunk. An event is named by its trigger (EVENT_NAME_CHARS
    characters), without one by its type, without either "event"; a type that is none of EVENT_TYPES becomes ``other`` and stays in ``event_type_raw``. Events
    of one name are told apart by ``event_id``; events alike in all they say, in one chunk, are one. Participants
    that are no known entity (by match key) become entities of the label Other, marked ``orphan``; blank ones are left out.
    """
    said = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    kind = F.lower(F.coalesce(said("event_type"), F.lit("event")))
    e = events.select("*", F.substring(F.coalesce(said("trigger"), said("event_type"), F.lit("event")), 1, EVENT_NAME_CHARS).alias("name"), kind.isin(*EVENT_TYPES).alias("listed"), kind.alias("kind"))
    key = F.sha2(F.to_json(F.struct("chunk", "name", "kind", "start", "end", "participants")), 256)
    nodes = e.select(
        key.alias("event_id"), "name", F.lit("EventOrAction").alias("label"), F.coalesce(said("trigger"), F.col("name")).alias("description"), F.when(F.col("listed"), F.col("kind")).otherwise("other").alias("event_type"),
        F.when(~F.col("listed"), F.col("event_type")).alias("event_type_raw"), F.col("start").alias("event_start_epoch"), F.col("end").alias("event_end_epoch"), F.col("precision").alias("event_ts_precision"),
        F.array("chunk").alias("source_chunks"), F.lit(False).alias("orphan"),
    ).dropDuplicates(["event_id"])
    ends = e.select(key.alias("event_id"), F.col("name").alias("src"), "chunk", F.explode("participants").alias("p")).select("event_id", "src", "chunk", S.match_key(F.trim("p")).alias("k")).filter("k IS NOT NULL AND k <> ''").distinct()
    if known is None:
        ends = ends.withColumn("found", F.lit(None).cast("string"))
    else:
        ends = ends.join(known.groupBy(S.match_key(F.col("name")).alias("k")).agg(F.min("name").alias("found")), "k", "left")
    orphans = ends.filter("found IS NULL").groupBy(F.col("k").alias("name")).agg(F.array(F.min("chunk")).alias("source_chunks"))
    orphans = orphans.select("name", F.lit("Other").alias("label"), F.lit("").alias("description"), "source_chunks", F.lit(True).alias("orphan"))
    relations = ends.select("event_id", "src", F.coalesce("found", "k").alias("tgt"), F.lit("PARTICIPATED_IN").alias("rel_type"), F.lit(1.0).alias("weight"), F.array("chunk").alias("source_chunks"))
    return nodes.unionByName(orphans, allowMissingColumns=True), relations


def split_events(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, events): events do not take part in entity resolution."""
    event = F.coalesce(F.col("label") == "EventOrAction", F.lit(False))
    return entities.filter(~event), entities.filter(event)


def link_canonical(mentions: DataFrame, aliases: DataFrame, items: DataFrame, auto: float = 0.9) -> DataFrame:
    """(surface, label, qid, how): mentions linked to stored items by an exact alias, else by the nearest vector if it is near and of the same script.

    mentions: surface, label, embedding; aliases: surface, label, qid; items: name, label, qid, embedding. Others get a null qid.
    """
    a = aliases.groupBy("surface", "label").agg(F.min("qid").alias("by_alias"))
    near = nearest_stored(mentions.select(F.concat(F.lit("m "), F.col("surface")).alias("name"), "label", "embedding"), items.select(F.concat(F.lit("i "), F.col("name")).alias("name"), "label", "embedding"), 1, auto)
    near = near.select(F.substring("a", 3, 1 << 20).alias("surface"), F.substring("b", 3, 1 << 20).alias("name")).join(items.select("name", F.col("label").alias("l"), F.col("qid").alias("by_vector")), "name")
    same = (S.script_of(F.col("surface")) == S.script_of(F.col("name"))) & (S.script_of(F.col("name")) != "mixed")
    near = near.filter(same).groupBy("surface", F.col("l").alias("label")).agg(F.min("by_vector").alias("by_vector"))
    j = mentions.select("surface", "label").distinct().join(a, ["surface", "label"], "left").join(near, ["surface", "label"], "left")
    how = F.when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_vector").isNotNull(), "vector")
    return j.select("surface", "label", F.coalesce("by_alias", "by_vector").alias("qid"), how.alias("how"))


def translation_slices(chunks: DataFrame, translations: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, position, text): of each document's translation the part that stands for each of its chunks.

    chunks: doc_id, chunk_id, end (characters of the original up to the chunk's end); translations: doc_id, original_chars, text. A chunk's
    part ends where its share of the original ends, carried on to the end of the sentence ([.!?] and white space), and begins where the part before
    ends. So the parts of a document join to its translation, in the order of the ends, and no sentence is cut; a chunk that lies within the last
    sentence of another gets an empty part. Documents without a translation or a length are left out; null texts are empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = translations.filter("original_chars > 0").groupBy("doc_id").agg(F.first("original_chars").alias("n"), F.first(text).alias("t"))
    ends = whole.select("doc_id", F.posexplode(F.split("t", r"(?<=[.!?]\s)")).alias("p", "s"))
    upto = Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.select("doc_id", F.sum(F.length("s")).over(upto).alias("at"), F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("long").alias("end"))
    size = whole.select("doc_id", "n", F.length("t").cast("long").alias("len"))
    last = Window.partitionBy("doc_id").orderBy(F.desc("end"), F.desc("chunk_id"))
    raw = F.floor(F.col("end") * F.col("len") / F.col("n"))
    # the last chunk has what is left
    cut = chunks.join(size, "doc_id").withColumn("r", F.row_number().over(last)).select(
        "doc_id", F.when(F.col("r") == 1, F.col("len")).otherwise(F.least(F.greatest(raw, F.lit(0)), F.col("len"))).alias("at"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("end").cast("long").alias("end")
    )
    # from the end on, the nearest sentence end so far; sentence ends come before cuts at the same place
    back = Window.partitionBy("doc_id").orderBy(F.desc("at"), F.col("chunk_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    snapped = ends.unionByName(cut).withColumn("to", F.min(F.when(F.col("chunk_id").isNull(), F.col("at"))).over(back)).filter("chunk_id IS NOT NULL")
    order = Window.partitionBy("doc_id").orderBy("end", "chunk_id")
    placed = snapped.select("doc_id", "chunk_id", (F.row_number().over(order) - 1).alias("position"), F.coalesce(F.lag("to").over(order), F.lit(0)).alias("from"), "to")
    return placed.join(whole.select("doc_id", "t"), "doc_id").select("doc_id", "chunk_id", "position", F.substring(F.col("t"), F.col("from") + 1, F.col("to") - F.col("from")).alias("text"))


def split_windows(docs: DataFrame, most: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, position, text): windows of whole lines of up to ``most`` characters for translation; a longer line is a window of its own pieces.

    Joining a document's windows gives its text back.
    """
    piece = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("line") - 1) / most).cast("int"))), lambda i: F.substring(F.col("line"), i * most + 1, F.lit(most)))
    lines = docs.select(F.col(id_col).alias("id"), F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?<=\n)").alias("lines"))
    each = lines.select("id", F.posexplode("lines").alias("p", "line")).select("id", "p", F.posexplode(piece).alias("q", "part"))
    parts = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("p", "q", "part"))).alias("parts"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(acc, x):
        fits = F.length(acc["now"]) + F.length(x["part"]) <= most
        return F.struct(F.when(fits | (acc["now"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))).alias("done"), F.when(fits, F.concat(acc["now"], x["part"])).otherwise(x["part"]).alias("now"))

    packed = parts.select("id", F.aggregate("parts", start, add, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"])))).alias("w"))
    return packed.select(F.col("id").alias(id_col), F.posexplode("w").alias("position", "text"))


def split_semantic(sentences: DataFrame, percentile: float = 0.95, id_col: str = "doc_id") -> DataFrame:
    """(id, chunk, text): sentences (id, position, text, embedding) packed into chunks that end where the next sentence is further away than the document's percentile of such distances."""
    w = Window.partitionBy(id_col).orderBy("position")
    d = sentences.withColumn("next", F.lead("embedding").over(w))
    d = d.withColumn("far", F.when(F.col("next").isNotNull(), 1 - S.cosine(F.col("embedding"), F.col("next"))))
    cut = d.groupBy(id_col).agg(F.percentile("far", F.lit(percentile)).alias("limit"))
    d = d.join(cut, id_col).withColumn("ends", F.coalesce(F.col("far") > F.col("limit"), F.lit(False)).cast("int"))
    d = d.withColumn("chunk", F.coalesce(F.sum("ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.groupBy(id_col, "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " ").alias("text"))


def backfill_first_seen(entities: DataFrame) -> DataFrame:
    """Entities without a stamp get 0, which lies in no window of days."""
    return entities.withColumn("created_at", F.coalesce("created_at", F.lit(0)))


def assemble_chunks(chunks: DataFrame, entities: DataFrame, relations: DataFrame, identifiers: DataFrame | None = None) -> DataFrame:
    """One row a chunk: (chunk_id, entities, relations, identifiers), each sorted; what was extracted from a chunk, ready to be stored with it."""
    e = entities.groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct("name", "label"))).alias("entities"))
    r = relations.groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct("src", "rel_type", "tgt"))).alias("relations"))
    out = chunks.select("chunk_id").join(e, "chunk_id", "left").join(r, "chunk_id", "left")
    if identifiers is not None:
        out = out.join(identifiers.groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct("type", "canonical"))).alias("identifiers")), "chunk_id", "left")
    return out
