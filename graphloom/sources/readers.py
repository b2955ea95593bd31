"""Document sources: folders of text files and mail, tables, and statistics files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_EXTENSIONS = ("txt", "md", "eml")


def read_folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = TEXT_EXTENSIONS) -> DataFrame:
    """(path, name, text, size): whole text files of a folder and those below it, on any file system Spark knows."""
    d = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").format("text").option("wholetext", "true").load(path)
    p = F.col("_metadata.file_path")
    return d.select(p.alias("path"), F.regexp_extract(p, r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("size"))


def source_channel(path):
    """The channel in names such as tg_<channel>_<number>.txt, or null."""
    c = F.regexp_extract(path, r"tg_(.+)_[0-9]+\.txt$", 1)
    return F.when(c != "", c)


def with_document_dates(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks stamped with the date and group of their document."""
    return chunks.join(docs.select("doc_id", "doc_date_epoch", "doc_group"), "doc_id", "left")


def backfill_doc_ids(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks without a document id take that of the document of the same path."""
    d = docs.groupBy("path").agg(F.min("doc_id").alias("found"))
    return chunks.join(d, chunks["file_path"] == d["path"], "left").withColumn("doc_id", F.coalesce("doc_id", "found")).drop("found", "path")


def chunk_page(chunks: DataFrame, doc_id, offset: int = 0, limit: int = 50) -> DataFrame:
    return chunks.filter(F.col("doc_id") == doc_id).orderBy("position").offset(offset).limit(limit)


def full_document(chunks: DataFrame, doc_id, max_chars: int = 60_000) -> DataFrame:
    """A document's text in the order of its chunks, cut to max_chars."""
    c = chunks.filter(F.col("doc_id") == doc_id)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n")
    return c.groupBy("doc_id").agg(F.substring(joined, 1, max_chars).alias("text"))
