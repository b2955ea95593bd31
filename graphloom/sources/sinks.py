"""Table sinks: keyed upserts as joins, written beside the old version."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.primitives import first_per


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_first: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` replace those of equal keys (null keys equal each other); columns in keep_first stay what they were first.

    Of new rows with equal keys one is taken, by the order of their columns, so that repeats write nothing twice.
    """
    cols = old.columns
    n = first_per(new.select(*cols), keys, *[F.col(c).desc_nulls_last() for c in cols if c not in keys])
    o = old.withColumnsRenamed({c: f"__o_{c}" for c in cols}).withColumn("__old", F.lit(True))
    n = n.withColumn("__new", F.lit(True))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"__o_{k}").eqNullSafe(F.col(k))
    j = o.join(n, on, "full")
    took = F.col("__new").isNotNull()
    return j.select(
        *[
            (F.coalesce(F.col(f"__o_{c}"), F.col(c)) if c in keep_first or c in keys else F.when(took, F.col(c)).otherwise(F.col(f"__o_{c}"))).alias(c)
            for c in cols
        ]
    )


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys are not there yet; nothing else is touched."""
    return first_per(new.join(old.select(*keys).distinct(), keys, "left_anti"), keys, *[F.col(c).desc_nulls_last() for c in new.columns if c not in keys])


def mark(table: DataFrame, chosen: DataFrame, key: str, column: str, value) -> DataFrame:
    """A flag or stamp set on the chosen keys."""
    c = chosen.select(key).distinct().withColumn("__hit", F.lit(True))
    return table.join(c, key, "left").withColumn(column, F.when(F.col("__hit"), F.lit(value)).otherwise(F.col(column))).drop("__hit")


def write_version(df: DataFrame, root: str) -> str:
    """Writes a new version under ``root`` and names its folder: readers of the old one are not disturbed."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def validate_observations(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with a reason): finite values, and periods that do not end before they start."""
    v = F.col("value")
    reason = F.when(v.isNull() | F.isnan(v) | v.isin(float("inf"), float("-inf")), "not_finite").when(F.col("period_end") < F.col("period_start"), "period_order")
    r = points.withColumn("reason", reason)
    return r.filter("reason IS NULL").drop("reason"), r.filter("reason IS NOT NULL")


def write_folder(docs: DataFrame, path: str) -> int:
    """Each row (folder, text, and columns that order them) as a text file of its own in that folder below ``path``; their number.

    Tasks write the files where they stay. The names follow from a partition's rows in order, so a task that runs again writes the same files.
    """
    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        part, n, known = TaskContext.get().partitionId(), 0, set()
        for batch in it:
            for folder, text in zip(batch.column("folder").to_pylist(), batch.column("text").to_pylist()):
                if folder not in known:
                    fs.create_dir(f"{root}/{folder}", recursive=True)
                    known.add(folder)
                with fs.open_output_stream(f"{root}/{folder}/{part:05d}-{n:07d}.txt", compression=None) as out:
                    out.write(text.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rest = [c for c in docs.columns if c not in ("folder", "text")]
    return docs.sortWithinPartitions("folder", *rest, "text").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
