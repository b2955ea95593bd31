"""Sharding by sampled splitters, in DataFrame functions only.

A size-weighted sample of keys gives quantile boundaries; rows are range-partitioned by them,
overfull ranges are subdivided, and exact sums per range turn a row's place in its range into a
place among all bytes, which names the shard. The law is ``bytes``: shard sizes differ from the
mean by less than the largest row. The key is the text's hash and then the id's, so equal texts lie
side by side, and a group of copies larger than a shard is cut rather than kept in one task.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import clear_of
from graphloom.session import reliable_checkpoint

H, TIE, SIZE = "__shard_h", "__shard_tie", "__shard_size"


@dataclass(frozen=True)
class ShardParams:
    """n_ranges: ranges at least; more where rows_per_range or bytes_per_range ask for it, up to max_ranges (which bounds
    what the driver holds: max_draws keys and two numbers a range). An overfull range is cut into as many pieces as its share asks for."""

    n_shards: int = 8
    n_ranges: int = 512
    rows_per_range: int = 1_000_000
    bytes_per_range: int = 1 << 30
    max_ranges: int = 65_536
    max_draws: int = 524_288
    samples_per_range: int = 32
    overfull: float = 2.0
    seed: int = 9


@dataclass(frozen=True)
class _Plan:
    splitters: list[tuple[int, int]]
    pieces: list[int]  # of each range
    unit0: list[int]  # number of the first unit of each range
    starts: list[int]  # bytes before each unit
    ranks: list[int]  # rows before each unit
    first: list[int]  # rank of each shard's first row
    total: int


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({H: F.xxhash64(text), TIE: F.xxhash64(F.col(id_col).cast("string")), SIZE: (F.octet_length(text) + 1).cast("long")})


def _literal(values, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps({"v": values})), f"v {kind}")["v"]


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """The number of splitters at or below the row's key, by a search of two levels."""
    step = max(1, int(len(splitters) ** 0.5))
    blocks = [[{"h": a, "t": b} for a, b in splitters[i : i + step]] for i in range(0, len(splitters), step)] or [[]]
    below = lambda s: (s["h"] < F.col(H)) | ((s["h"] == F.col(H)) & (s["t"] <= F.col(TIE)))
    heads = _literal([b[0] for b in blocks if b], "array<struct<h:bigint,t:bigint>>")
    block = F.size(F.filter(heads, below)) - 1
    inner = F.get(_literal(blocks, "array<array<struct<h:bigint,t:bigint>>>"), block)
    return F.when(block < 0, F.lit(0)).otherwise(block * step + F.size(F.filter(inner, below)))


def _with_unit(keyed: DataFrame, splitters, pieces, unit0) -> DataFrame:
    ranged = keyed.withColumn("__shard_range", _range_of(splitters))
    k = F.get(_literal(pieces, "array<int>"), F.col("__shard_range"))
    piece = F.when(k > 1, F.pmod(F.xxhash64(F.col(TIE)), k)).otherwise(F.lit(0))
    unit = F.get(_literal(unit0, "array<int>"), F.col("__shard_range")) + piece.cast("int")
    return ranged.withColumn("__shard_unit", unit).drop("__shard_range")


def _placed(units: DataFrame, starts, ranks, total: int, n_shards: int) -> DataFrame:
    """Adds the row's rank among all rows and its shard."""
    # units are bounded shares of all bytes, so no window gathers a hot key
    w = Window.partitionBy("__shard_unit").orderBy(H, TIE, SIZE)
    at = F.get(_literal(starts, "array<bigint>"), F.col("__shard_unit")) + F.sum(SIZE).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(SIZE)
    rank = F.get(_literal(ranks, "array<bigint>"), F.col("__shard_unit")) + F.row_number().over(w) - 1
    # exact integers: bytes times shards stays below 2**63 up to an exabyte
    return units.withColumns({"__shard_rank": rank, "__shard_at": at}).withColumn(
        "__shard_no", F.least(F.call_function("div", F.col("__shard_at") * n_shards, F.lit(total)), F.lit(n_shards - 1)).cast("int")
    )


def _plan(narrow: DataFrame, p: ShardParams) -> _Plan | None:
    s = narrow.agg(F.count(F.lit(1)).alias("n"), F.sum(SIZE).alias("b")).first()
    n, total = s["n"], s["b"]
    if not n:
        return None
    r = min(p.max_ranges, max(p.n_ranges, -(-n // p.rows_per_range), -(-total // p.bytes_per_range)))
    # size-weighted draws: a row of b bytes stands for m = b * draws / total of them
    draws = min(r * p.samples_per_range, max(p.max_draws, r))
    m = F.col(SIZE) * (draws / total)
    u = F.pmod(F.xxhash64(F.col(H), F.col(TIE), F.lit(p.seed)), F.lit(2**31)) / float(2**31)
    drawn = sorted((x["h"], x["t"], x["m"]) for x in narrow.filter(u < m).select(F.col(H).alias("h"), F.col(TIE).alias("t"), F.greatest(m, F.lit(1.0)).alias("m")).collect())
    weight, splitters, passed = sum(x[2] for x in drawn), [], 0.0
    for h, t, w in drawn:
        passed += w
        if passed * r >= weight * (len(splitters) + 1) and (not splitters or splitters[-1] != (h, t)):
            splitters.append((h, t))
    k = len(splitters) + 1
    count = lambda pieces, unit0: {
        x["__shard_unit"]: (x["b"], x["n"])
        for x in _with_unit(narrow, splitters, pieces, unit0).groupBy("__shard_unit").agg(F.sum(SIZE).alias("b"), F.count(F.lit(1)).alias("n")).collect()
    }
    pieces, unit0 = [1] * k, list(range(k))
    sums = count(pieces, unit0)
    limit = p.overfull * total / k
    if any(b > limit and c > 1 for b, c in sums.values()):
        pieces = [-(-int(sums[i][0]) * k // total) if i in sums and sums[i][0] > limit and sums[i][1] > 1 else 1 for i in range(k)]
        unit0 = _cumulative(pieces)
        sums = count(pieces, unit0)
    n_units = sum(pieces)
    starts = _cumulative([sums.get(i, (0, 0))[0] for i in range(n_units)])
    ranks = _cumulative([sums.get(i, (0, 0))[1] for i in range(n_units)])
    # a shard's first row: at a unit's start, or inside the unit that holds the shard's boundary
    at = lambda b: min(p.n_shards - 1, b * p.n_shards // total)
    first: dict[int, int] = {}
    cut = []
    for i in range(n_units):
        b, c = sums.get(i, (0, 0))
        if c:
            first[at(starts[i])] = min(first.get(at(starts[i]), ranks[i]), ranks[i])
            if at(starts[i]) != at(starts[i] + b - 1):
                cut.append(i)
    if cut:
        inside = _with_unit(narrow, splitters, pieces, unit0).filter(F.col("__shard_unit").isin(cut))
        for x in _placed(inside, starts, ranks, total, p.n_shards).groupBy("__shard_no").agg(F.min("__shard_rank").alias("r")).collect():
            first[x["__shard_no"]] = min(first.get(x["__shard_no"], x["r"]), x["r"])
    return _Plan(splitters, pieces, unit0, starts, ranks, [first.get(i, 0) for i in range(p.n_shards)], total)


def _cumulative(xs: list[int]) -> list[int]:
    out, c = [], 0
    for x in xs:
        out.append(c)
        c += x
    return out


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: ShardParams | None = None) -> DataFrame:
    """``docs`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    A row's size is its UTF-8 bytes and 1; null text has size 1; null ids are placed like any other;
    repeated rows are placed one by one (which of them comes first is not defined, their values are
    equal); an empty table gives an empty result. Columns of the input named ``shard`` or ``slot``, in any case, are
    replaced; all others stay as they are.
    """
    p = params or ShardParams()
    # names are told apart without case, as Spark does; a column called like a helper waits under another name
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    aside = {c: f"{clear_of(docs, '__aside_')}{i}" for i, c in enumerate(own) if c.lower().startswith("__shard_")}
    if aside:
        named = docs.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in own])
        back = assign_shards(named, aside.get(id_col, id_col), aside.get(text_col, text_col), p)
        return back.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in own], "shard", "slot")
    names = own
    keyed = _keyed(docs, id_col, text_col)
    plan = _plan(reliable_checkpoint(keyed.select(H, TIE, SIZE)), p)
    kept = [F.col(f"`{c}`") for c in names]
    if plan is None:
        return docs.select(*kept, F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    placed = _placed(_with_unit(keyed, plan.splitters, plan.pieces, plan.unit0), plan.starts, plan.ranks, plan.total, p.n_shards)
    slot = F.col("__shard_rank") - F.get(_literal(plan.first, "array<bigint>"), F.col("__shard_no"))
    return placed.select(*kept, F.col("__shard_no").alias("shard"), slot.cast("long").alias("slot"))


def shard_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: ShardParams | None = None) -> DataFrame:
    """(id, size, text_crc32, shard, slot), the text itself left behind before the shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias(id_col),
        F.xxhash64(text).alias("h"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    p = params or ShardParams()
    keyed = reliable_checkpoint(narrow.withColumns({H: F.col("h"), TIE: F.xxhash64(F.col(id_col).cast("string")), SIZE: F.col("size")}).drop("h"))
    plan = _plan(keyed, p)
    if plan is None:
        return keyed.select(id_col, "size", "text_crc32", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    placed = _placed(_with_unit(keyed, plan.splitters, plan.pieces, plan.unit0), plan.starts, plan.ranks, plan.total, p.n_shards)
    slot = F.col("__shard_rank") - F.get(_literal(plan.first, "array<bigint>"), F.col("__shard_no"))
    return placed.select(id_col, "size", "text_crc32", F.col("__shard_no").alias("shard"), slot.cast("long").alias("slot"))
