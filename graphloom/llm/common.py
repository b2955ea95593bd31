"""What the corpus operators share: word rules, row ids and table access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WS_CLASS = r"[\x20\x09-\x0D]"
NON_WS_CLASS = r"[^\x20\x09-\x0D]"

#: Tables of a number of rows up to this are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once: a lambda variable is bound, a plain Column would be copied."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The white-space separated words of ``text``; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS_CLASS + "+"), "")


def small_join(left: DataFrame, right: DataFrame, on, rows: int, how: str = "left") -> DataFrame:
    """Join to ``right`` of a counted number of rows: broadcast below the bound, else by shuffle (AQE splits skew)."""
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)


def clear_of(df: DataFrame, stem: str) -> str:
    """``stem``, lengthened until no column of ``df`` starts with it, in whatever case: a prefix for helper columns."""
    while any(c.lower().startswith(stem.lower()) for c in df.columns):
        stem += "_"
    return stem
