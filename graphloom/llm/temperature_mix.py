"""Mixing sources by temperature, in DataFrame functions only.

Source token shares p are raised to an exponent a and normalised; a is found by repeated bisection
(into many parts at a time) so that the weights reach a target entropy or keep within a repetition
limit. The weights are realised as copies: whole passes over a source, and for the rest a budget in
each block of a permutation of the source's documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import BROADCAST_ROWS, NON_WS_CLASS
from graphloom.session import reliable_checkpoint


@dataclass(frozen=True)
class MixParams:
    """target_entropy: share of the largest possible entropy, ln(sources), that the weights should reach.

    max_repeat: how often at most any document may be seen; it prevails over the entropy.
    budget_tokens: tokens of the mix; None: the smallest budget that drops nothing, so that the source with
    most to spare is passed over once and every other at least once.
    block_docs: documents in a permutation block, about; more where that makes more than max_blocks blocks.
    """

    target_entropy: float = 0.95
    max_repeat: float = 2.0
    budget_tokens: int | None = None
    block_docs: int = 2048
    max_blocks: int = 20_000
    parts: int = 16
    rounds: int = 6
    seed: int = 8


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NON_WS_CLASS + "+")), F.lit(0)).cast("long")


def source_weights(rows: DataFrame, source: str, tokens: str, p: MixParams) -> tuple[DataFrame, float, int, float]:
    """(source, n_docs, n_tokens, weight, repeat), the exponent, the number of sources and the rows of the mix."""
    src = reliable_checkpoint(rows.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(tokens).alias("n_tokens")).coalesce(8))
    live = src.filter("n_tokens > 0")
    t = live.agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"), F.min("n_tokens").alias("lo"), F.max("n_tokens").alias("hi")).first()
    total, k = float(t["t"] or 0), t["k"]
    n_sources = src.count()
    if not k:
        none = src.withColumns({"weight": F.lit(0.0), "repeat": F.lit(1.0)})
        return none, 1.0, n_sources, float(src.agg(F.sum("n_docs")).first()[0] or 0)
    share = F.col("n_tokens") / total
    spread = t["hi"] / t["lo"]

    def fits(alphas: list[float]) -> list[bool]:
        """Of each exponent: are the weights flat enough no more? True from the wanted exponent on."""
        cols = []
        for i, a in enumerate(alphas):
            cols += [F.sum(F.pow(share, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(share, F.lit(a)) * F.log(share)).alias(f"l{i}")]
        x = live.agg(*cols).first()
        out = []
        for i, a in enumerate(alphas):
            entropy = math.log(x[f"z{i}"]) - a * x[f"l{i}"] / x[f"z{i}"]
            out.append(spread ** (1 - a) <= p.max_repeat and entropy <= p.target_entropy * math.log(k) + 1e-12)
        return out

    lo, hi = 0.0, 1.0
    if k > 1 and fits([1.0])[0]:
        # both conditions turn true once as the exponent grows: keep the last false and the first true part
        for _ in range(p.rounds):
            grid = [lo + (hi - lo) * i / p.parts for i in range(p.parts + 1)]
            ok = fits(grid)
            j = next(i for i, x in enumerate(ok) if x) if any(ok) else p.parts
            lo, hi = (grid[j - 1], grid[j]) if j else (grid[0], grid[0])
            if lo == hi:
                break
    # else natural shares are flatter than the target already: the exponent stays 1
    a = hi
    z = live.agg(F.sum(F.pow(share, F.lit(a)))).first()[0]
    weight = F.when(F.col("n_tokens") > 0, F.pow(share, F.lit(a)) / z).otherwise(F.lit(0.0))
    # passes over a source of share p at weight w are in proportion to w / p = p ** (a - 1) / z
    budget = p.budget_tokens if p.budget_tokens is not None else total * z * (t["hi"] / total) ** (1 - a)
    repeat = F.when(F.col("n_tokens") > 0, F.col("weight") * budget / F.col("n_tokens")).otherwise(F.lit(1.0))
    out = src.withColumn("weight", weight).withColumn("repeat", F.round(repeat, 9))
    return out, a, n_sources, float(out.agg(F.sum(F.col("n_docs") * F.col("repeat"))).first()[0] or 0)


def _placed(rows: DataFrame, weights: DataFrame, n_sources: int, source: str, key: Column, size: int, seed: int) -> DataFrame:
    """Adds the source's repeat and weight, and the row's block and its place in the block's permutation."""
    w = weights.select(
        F.col("source").alias("__mix_source"), F.col("repeat").alias("__mix_repeat"), F.ceil(F.col("n_docs") / size).alias("__mix_blocks"), F.col("weight").alias("__mix_weight")
    )
    joined = rows.join(F.broadcast(w) if n_sources <= BROADCAST_ROWS else w, F.col(source).eqNullSafe(F.col("__mix_source")), "left")
    # a hot source has as many blocks as it needs: none is larger than about block_docs
    return joined.withColumns({"__mix_block": F.pmod(F.xxhash64(key, F.lit(seed)), F.col("__mix_blocks")), "__mix_order": F.xxhash64(key, F.lit(seed + 1))})


def _cutoffs(placed: DataFrame, tokens: str) -> DataFrame:
    """Of each block how far in its permutation the documents get one copy more.

    Rows of one place (repeats of a row) are summed before the shuffle; where the budget ends among them,
    ``tie_share`` of them get the copy.
    """
    part = F.col("__mix_repeat") - F.floor("__mix_repeat")
    at = placed.filter(part > 0).groupBy("__mix_source", "__mix_block", "__mix_order")
    at = at.agg(F.sum(tokens).alias("w"), F.count(F.lit(1)).alias("m"), F.first(part).alias("part"))
    block = Window.partitionBy("__mix_source", "__mix_block")
    at = at.withColumns({"upto": F.sum("w").over(block.orderBy("__mix_order").rowsBetween(Window.unboundedPreceding, 0)), "budget": F.col("part") * F.sum("w").over(block)})
    left = F.col("budget") - F.col("upto") + F.col("w")
    share = F.when((F.col("m") == 1) | (F.col("w") == 0), (left >= F.col("w") / 2.0).cast("double")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), left / F.col("w"))))
    at = at.withColumn("share", share)
    return at.groupBy(F.col("__mix_source").alias("__cut_source"), F.col("__mix_block").alias("__cut_block")).agg(
        F.max(F.when(F.col("share") >= 1, F.col("__mix_order"))).alias("__cut_full"),
        F.min(F.when((F.col("share") > 0) & (F.col("share") < 1), F.struct("__mix_order", "share"))).alias("__cut_tie"),
    )


def _copies(placed: DataFrame, cutoffs: DataFrame, n_blocks: int, row: Column) -> DataFrame:
    """Adds __mix_copies: whole passes, and one more up to the block's cutoff. Rows stay where they are unless there are very many blocks."""
    met = placed.join(
        F.broadcast(cutoffs) if n_blocks <= BROADCAST_ROWS else cutoffs,
        F.col("__mix_source").eqNullSafe(F.col("__cut_source")) & (F.col("__mix_block") == F.col("__cut_block")),
        "left",
    )
    drawn = F.pmod(F.xxhash64(row, F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    tie = (F.col("__mix_order") == F.col("__cut_tie.__mix_order")) & (drawn < F.col("__cut_tie.share"))
    more = F.coalesce(F.col("__mix_order") <= F.col("__cut_full"), F.lit(False)) | F.coalesce(tie, F.lit(False))
    return met.withColumn("__mix_copies", (F.floor("__mix_repeat") + more.cast("int")).cast("int"))


def _plan(rows: DataFrame, source: str, p: MixParams) -> tuple[DataFrame, DataFrame, int, int, int, float]:
    """Of narrow rows (source, __mix_tokens, __mix_key): weights, cutoffs, the numbers of sources and of blocks, the block size and the rows of the mix."""
    weights, _, k, n_out = source_weights(rows, source, "__mix_tokens", p)
    n = weights.agg(F.sum("n_docs")).first()[0] or 0
    size = max(p.block_docs, math.ceil(n / p.max_blocks))
    cutoffs = reliable_checkpoint(_cutoffs(_placed(rows, weights, k, source, F.col("__mix_key"), size, p.seed), "__mix_tokens").coalesce(8))
    return weights, cutoffs, k, k + math.ceil(n / size), size, n_out


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", params: MixParams | None = None) -> DataFrame:
    """One row per document and copy: (id, source, n_tokens, weight, copy, mix_block, mix_pos).

    ``copy`` counts from 1; (mix_block, mix_pos) is the copy's place: the mix is a row of blocks, each a
    permutation of a cross-section of all sources. Null text has no tokens; a document without tokens
    is passed over once if its source has none at all, else as often as its source; null sources form one
    source; null ids are treated like others; rows repeated in id and text are spread over the blocks, and where the budget
    ends among them a share of them gets the copy; an empty table gives an empty result.
    """
    p = params or MixParams()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = reliable_checkpoint(
        docs.select(
            F.col(id_col).alias(id_col), F.col(source_col).alias("source"), count_tokens(F.col(text_col)).alias("__mix_tokens"),
            F.xxhash64(F.col(id_col).cast("string"), text).alias("__mix_key"), F.monotonically_increasing_id().alias("__mix_row"),
        )
    )
    weights, cutoffs, k, n_blocks, size, n_out = _plan(rows, "source", p)
    made = _copies(_placed(rows, weights, k, "source", F.col("__mix_key"), size, p.seed), cutoffs, n_blocks, F.col("__mix_row")).filter("__mix_copies > 0")
    # repeats of a row have one key: their own number spreads them
    twice = reliable_checkpoint(rows.groupBy(F.col("__mix_key").alias("__mix_twice")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("__mix_twice"))
    n_twice = twice.count()
    salt = F.lit(0).cast("long")
    if n_twice:
        made = made.join(F.broadcast(twice) if n_twice <= BROADCAST_ROWS else twice, F.col("__mix_key") == F.col("__mix_twice"), "left")
        salt = F.when(F.col("__mix_twice").isNotNull(), F.col("__mix_row")).otherwise(salt)
    each = made.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))))
    place = F.xxhash64(F.col("__mix_key"), salt, F.col("copy"), F.lit(p.seed + 2))
    blocks = max(1, math.ceil(n_out / p.block_docs))
    each = each.withColumns({"mix_block": F.pmod(place, F.lit(blocks)).cast("long"), "__mix_place": F.xxhash64(place)})
    pos = F.row_number().over(Window.partitionBy("mix_block").orderBy("__mix_place", "__mix_tokens")) - 1
    return each.select(id_col, "source", F.col("__mix_tokens").alias("n_tokens"), F.col("__mix_weight").alias("weight"), "copy", "mix_block", pos.cast("long").alias("mix_pos"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", params: MixParams | None = None) -> DataFrame:
    """The documents of the mix, each as often as the weights ask for, with the columns of ``docs``; edge cases as in :func:`mix_plan`.

    The plan is made on narrow rows; the texts are only passed through, each row where it is read.
    """
    p = params or MixParams()
    names = docs.columns
    key = F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")))
    narrow = reliable_checkpoint(docs.select(F.col(source_col).alias("__mix_src"), count_tokens(F.col(text_col)).alias("__mix_tokens"), key.alias("__mix_key")))
    weights, cutoffs, k, n_blocks, size, _ = _plan(narrow, "__mix_src", p)
    rows = docs.withColumn("__mix_row", F.monotonically_increasing_id())
    made = _copies(_placed(rows, weights, k, source_col, key, size, p.seed), cutoffs, n_blocks, F.col("__mix_row")).filter("__mix_copies > 0")
    return made.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*[F.col(f"`{c}`") for c in names])
