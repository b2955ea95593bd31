"""Exact statistics: series, resampling, alignment, status tables, claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators.primitives import first_per
from graphloom.schema import GRANULARITIES, STATUSES, VALUE_KINDS

MIN_OVERLAP = 8


def latest_revision(observations: DataFrame, keys: Sequence[str] = ("indicator_id", "period_start", "dims"), revision: int | None = None, since=None, until=None) -> DataFrame:
    """Of every key the newest revision, or the pinned one; bounds on period_start are inclusive."""
    o = observations
    if since is not None:
        o = o.filter(F.col("period_start") >= F.lit(since))
    if until is not None:
        o = o.filter(F.col("period_start") <= F.lit(until))
    if revision is not None:
        return o.filter(F.col("revision") == revision)
    return first_per(o, list(keys), F.desc("revision"), F.desc("value"))


def dims_match(dims, wanted: dict[str, str] | None, exact: bool = False):
    """Whether a map holds the wanted entries; an empty wish, or ``exact``, means these and no others."""
    if wanted is None:
        return F.lit(True)
    has = F.lit(True)
    for k, v in wanted.items():
        has = has & F.coalesce(F.element_at(dims, F.lit(k)) == v, F.lit(False))
    return has & (F.size(dims) == len(wanted)) if exact or not wanted else has


def valid_points(points: DataFrame, value: str = "value") -> DataFrame:
    v = F.col(value)
    return points.filter(v.isNotNull() & ~F.isnan(v) & ~v.isin(float("inf"), float("-inf")))


def resample(points: DataFrame, granularity: str, value_kind: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, period, value): levels take a bucket's last value (the greater of one day's), others the mean; nothing is filled in."""
    if granularity not in GRANULARITIES or value_kind not in VALUE_KINDS:
        raise ValueError(f"unknown granularity or kind: {granularity!r}, {value_kind!r}")
    period = F.date_trunc(granularity, F.col("d").cast("timestamp")).cast("date")
    value = F.max_by("value", F.struct("d", "value")) if value_kind == "level" else F.avg("value")
    return points.groupBy(*keys, period.alias("period")).agg(value.alias("value"))


def align(a: DataFrame, b: DataFrame, granularity: str, kind_a: str, kind_b: str, max_lag: int = 0, min_overlap: int = MIN_OVERLAP) -> tuple[DataFrame, DataFrame]:
    """The grid (idx, period, a, b, a_norm, b_norm, gap) and one row (best_lag, correlation, divergence, warnings).

    Both series (d, value) are resampled and z-scored; of the shifts of b in [-max_lag, max_lag] grid steps the one with
    the greatest correlation is taken, the first on ties, if enough periods overlap. The grid has a row a period
    (not a point), so it fits in one task whatever the series' length in points.
    """
    if max_lag < 0:
        raise ValueError("max_lag must be >= 0")
    x = resample(a, granularity, kind_a).select("period", F.col("value").alias("a"))
    y = resample(b, granularity, kind_b).select("period", F.col("value").alias("b"))
    whole = Window.partitionBy()

    def z(c: str):
        sd = F.stddev_pop(c).over(whole)
        return F.when(F.col(c).isNotNull(), F.when(sd > 0, F.try_divide(F.col(c) - F.avg(c).over(whole), sd)).otherwise(F.lit(0.0)))

    g = x.join(y, "period", "full").withColumn("idx", F.row_number().over(Window.orderBy("period")) - 1)
    g = g.select("idx", "period", "a", "b", z("a").alias("a_norm"), z("b").alias("b_norm"))
    lags = g.select(F.col("idx").alias("i"), F.col("a_norm").alias("p")).withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))))
    pairs = lags.join(g.select(F.col("idx").alias("j"), F.col("b_norm").alias("q")), F.col("j") == F.col("i") + F.col("lag")).filter("p IS NOT NULL AND q IS NOT NULL")
    n = F.count(F.lit(1))
    cov = F.sum(F.col("p") * F.col("q")) - F.sum("p") * F.sum("q") / n
    vp, vq = F.sum(F.col("p") * F.col("p")) - F.sum("p") * F.sum("p") / n, F.sum(F.col("q") * F.col("q")) - F.sum("q") * F.sum("q") / n
    per = pairs.groupBy("lag").agg(F.when((n >= max(min_overlap, 2)) & (vp > 1e-12) & (vq > 1e-12), F.try_divide(cov, F.sqrt(vp) * F.sqrt(vq))).alias("corr"))
    best = per.filter("corr IS NOT NULL").agg(F.max_by("lag", F.struct(F.round("corr", 12), -F.col("lag"))).alias("l"), F.max("corr").alias("correlation")).select(F.coalesce("l", F.lit(0)).alias("best_lag"), "correlation")
    grid = g.crossJoin(F.broadcast(best.select("best_lag")))
    shifted = g.select(F.col("idx").alias("k"), F.col("b_norm").alias("q"))
    grid = grid.join(shifted, F.col("k") == F.col("idx") + F.col("best_lag"), "left").select("idx", "period", "a", "b", "a_norm", "b_norm", (F.col("a_norm") - F.col("q")).alias("gap"))
    n_gap = F.count("gap")
    note = lambda test, text: F.when(test, text)
    warn = F.array_compact(
        F.array(
            note(F.max(F.col("a").isNull()), F.lit("sparse:a")), note(F.max(F.col("b").isNull()), F.lit("sparse:b")), F.lit(f"value_kind_mismatch:{kind_a}/{kind_b}" if kind_a != kind_b else None),
            note(n_gap == 0, F.lit("no_overlap")), note((n_gap > 0) & (n_gap < min_overlap), F.concat(F.lit("low_overlap:"), n_gap.cast("string"), F.lit(f"<{min_overlap}"))),
        )
    )
    summary = grid.agg(F.avg(F.abs("gap")).alias("divergence"), warn.alias("warnings")).crossJoin(best)
    return grid, summary.select("best_lag", "correlation", "divergence", "warnings")


def search_indicators(indicators: DataFrame, query: str | None = None, source: str | None = None, limit: int = 20, least: float = 0.3) -> DataFrame:
    """By trigram similarity of the title, best first; without a query all, by title."""
    i = indicators if source is None else indicators.filter(F.col("source") == source)
    score = S.trigram_similarity(F.col("title"), F.lit(query)) if query else F.lit(1.0)
    return i.withColumn("score", score).filter(F.col("score") >= (least if query else 0)).orderBy(F.desc("score"), "title").limit(limit)


def source_catalogue(indicators: DataFrame, observations: DataFrame) -> DataFrame:
    per = observations.groupBy("indicator_id").agg(F.min("period_start").alias("lo"), F.max("period_start").alias("hi"))
    return indicators.join(per, "indicator_id", "left").groupBy("source").agg(F.countDistinct("indicator_id").alias("indicators"), F.min("lo").alias("first_period"), F.max("hi").alias("last_period"))


def status_counts_by(docs: DataFrame, key: str) -> DataFrame:
    """(key, one column a status, total), largest first; empty keys are left out."""
    d = docs.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    g = d.groupBy(key).agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES], F.count(F.lit(1)).alias("total"))
    return g.orderBy(F.desc("total"), key)


def timeline_counts(rows: DataFrame, ts: str, since=None, until=None, by: str | None = None) -> DataFrame:
    """Rows a day, optionally by a column; since is inclusive, until exclusive."""
    r = rows
    if since is not None:
        r = r.filter(F.col(ts) >= F.lit(since).cast(r.schema[ts].dataType))
    if until is not None:
        r = r.filter(F.col(ts) < F.lit(until).cast(r.schema[ts].dataType))
    return r.groupBy(F.col(ts).cast("date").alias("day"), *([by] if by else [])).agg(F.count(F.lit(1)).alias("n"))


def majority(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The commonest value of each key, the first seen on ties."""
    g = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return first_per(g, keys, F.desc("n"), "first", value).select(*keys, value)


def activity_metrics(rows: DataFrame, key: str, duration: str, model: str) -> DataFrame:
    """Mean, 95th percentile and the distinct models of each activity."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("runs"), F.avg(duration).alias("mean"), F.percentile(duration, F.lit(0.95)).alias("p95"), F.array_join(F.array_sort(F.collect_set(model)), ", ").alias("models"))


def claim_contradictions(claims: DataFrame) -> DataFrame:
    """Subjects and attributes with more than one value: versions by distinct sources, the consensus of a strict majority, and a polarity split."""
    k = ["subject", "attribute"]
    v = claims.groupBy(*k, "value").agg(F.countDistinct("source").alias("sources"))
    per = v.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct((-F.col("sources")).alias("o"), F.col("value")))).alias("v"), F.sum("sources").alias("all"), F.max("sources").alias("top"), F.count(F.lit(1)).alias("versions"))
    split = claims.groupBy(*k).agg((F.countDistinct(F.when(F.col("polarity") == "negated", 1)) + F.countDistinct(F.when(F.coalesce("polarity", F.lit("affirmed")) == "affirmed", 1)) == 2).alias("polarity_split"))
    out = per.join(split, k).filter("versions > 1 OR polarity_split")
    return out.select(*k, F.transform("v", lambda x: F.struct(x["value"].alias("value"), (-x["o"]).alias("sources"))).alias("versions"), F.when(F.col("top") * 2 > F.col("all"), F.get("v", F.lit(0))["value"]).alias("consensus"), "polarity_split")
