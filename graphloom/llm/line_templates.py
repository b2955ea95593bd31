"""Line dedup by a log-template tree.

A line's variable fields (tokens with digits, addresses) become wildcards; the tree of fixed depth sends it to
a leaf by its token count and leading tokens; in a leaf, tokens that stand in few documents at their
position become wildcards too, and lines that then are equal share a template. Templates that recur in
enough documents are boilerplate, and their lines are dropped from every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BROADCAST_ROWS
from graphloom.session import reliable_checkpoint

_FIELD = re.compile(r"\S*(?:\d|@|://)\S*")
#: Occurs in every line that has a field, and is quickly seen not to occur in the others.
_HINT = re.compile(r"[\d@]|://")
WILD = "<*>"


@dataclass(frozen=True)
class TemplateParams:
    """depth: leading tokens in the tree; similarity: least share of a template's positions that are no wildcards of
    its own; min_docs: documents in which a template recurs, and in which a token must stand at its position to be
    part of one; step: a leaf's templates are looked for at min_docs, step * min_docs, step**2 * min_docs and so on
    (a field of few values is found variable at a higher one); min_tokens: lines of fewer are templates of their
    own, compared as they stand; short_docs: documents in which such a line of under short_chars characters recurs."""

    depth: int = 3
    similarity: float = 0.7
    min_docs: int = 3
    step: int = 4
    min_tokens: int = 4
    short_docs: int = 10
    short_chars: int = 20


def parse_line(line: str, p: TemplateParams) -> tuple[int, int, list[str]] | None:
    """(leaf, hash of the masked line, masked tokens); None for a blank line. The lowest bit of the leaf tells brief lines."""
    tokens = line.split()
    if not tokens:
        return None
    if len(tokens) < p.min_tokens:
        text = " ".join(tokens)
        key = _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))
        return key | 1 if len(text) < p.short_chars else key & ~1, key, tokens
    if _HINT.search(line):
        tokens = _FIELD.sub(WILD, line).split()
    leaf = xxhash.xxh3_64_intdigest(f"{len(tokens)} {' '.join(tokens[: p.depth])}".encode("utf-8", "surrogatepass"))
    return _signed(leaf) & ~1, _signed(xxhash.xxh3_64_intdigest(" ".join(tokens).encode("utf-8", "surrogatepass"))), tokens


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _lines(p: TemplateParams, with_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, leaves, masks, texts = [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen = set()
                for line in (text or "").split("\n"):
                    got = parse_line(line, p)
                    if got and got[:2] not in seen:
                        seen.add(got[:2])
                        keys.append(key), leaves.append(got[0]), masks.append(got[1])
                        texts.append(" ".join(got[2]) if with_tokens else None)
            arrays = [pa.array(keys, pa.int64()), pa.array(leaves, pa.int64()), pa.array(masks, pa.int64())]
            names = ["doc", "leaf", "mask"]
            if with_tokens:
                arrays.append(pa.array(texts, pa.string()))
                names.append("line")
            for i in range(0, len(keys), 4096):
                yield pa.RecordBatch.from_arrays([a.slice(i, 4096) for a in arrays], names=names)

    return run


def line_templates(lines: DataFrame, p: TemplateParams) -> DataFrame:
    """(leaf, mask, template) for the templates that a line fits; ``lines`` is (leaf, mask, line, docs), one row a masked line.

    At each support of the ladder a line's template keeps the tokens that stand at their position in so many
    documents' lines of the leaf (the leading tokens always do). Counting by leaf, position and token is combined before the
    shuffle, so a leaf of any size is no task's alone, and what a line's templates are depends on no order.
    """
    tokens = F.split("line", " ")
    rest = lines.select("leaf", "mask", "docs", F.posexplode(F.slice(tokens, p.depth + 1, F.size(tokens))).alias("pos", "token"))
    often = reliable_checkpoint(rest.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("support")).filter(F.col("support") >= p.min_docs))
    n = often.count()
    known = rest.drop("docs").join(F.broadcast(often) if n <= BROADCAST_ROWS else often, ["leaf", "pos", "token"], "left")
    # steps of the ladder that a token's support reaches; -1: none
    level = F.coalesce(F.floor(F.log(F.col("support") / p.min_docs + 1e-9) / F.log(F.lit(float(p.step)))), F.lit(-1)).cast("int")
    shapes = known.groupBy("leaf", "mask").agg(F.sort_array(F.collect_list(F.struct("pos", level.alias("level"), "token"))).alias("at"))
    shapes = shapes.withColumn("step", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.array_max(F.transform("at", lambda x: x["level"]))))))
    fixed = F.transform("at", lambda x: F.when(x["level"] >= F.col("step"), x["token"]))
    kept = F.size(F.filter(fixed, lambda x: x.isNotNull())) + p.depth
    shaped = shapes.filter(kept >= p.similarity * (F.size("at") + p.depth))
    # a wildcard is told apart from every token
    return shaped.select("leaf", "mask", F.xxhash64("step", F.transform(fixed, lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("")))).alias("template"))


def recurring_lines(keyed: DataFrame, bare: DataFrame, p: TemplateParams) -> DataFrame:
    """(leaf, mask) of masked lines whose template recurs; ``keyed`` has doc (long) and text, ``bare`` the documents' distinct lines."""
    least = F.when(F.col("leaf").bitwiseAND(1) == 1, p.short_docs).otherwise(p.min_docs)
    # a template lies within a leaf, so a leaf of too few documents has none that recurs
    leaves = bare.select("leaf", "doc").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= least)
    counted = bare.groupBy("leaf", "mask").agg(F.count(F.lit(1)).alias("docs")).join(leaves.select("leaf"), "leaf", "left_semi")
    counted = reliable_checkpoint(counted)
    known = counted.filter(F.col("docs") >= least)
    # lines that do not recur as they are may recur as a template with others of their leaf
    shared = counted.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines")).filter("lines > 1").select("leaf")
    n_shared = shared.count()
    if not n_shared:
        return known.select("leaf", "mask")
    lines = keyed.mapInArrow(_lines(p, True), "doc long, leaf long, mask long, line string").join(F.broadcast(shared) if n_shared <= BROADCAST_ROWS else shared, "leaf")
    one = lines.groupBy("leaf", "mask").agg(F.first("line").alias("line"), F.count(F.lit(1)).alias("docs"))
    named = reliable_checkpoint(line_templates(reliable_checkpoint(one), p))
    docs = bare.join(named, ["leaf", "mask"]).select("leaf", "template", "doc").distinct().groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("docs"))
    often = named.join(docs.filter(F.col("docs") >= least), ["leaf", "template"]).select("leaf", "mask")
    return known.select("leaf", "mask").union(often).distinct()


def _rebuild(texts: list, gone: list, p: TemplateParams) -> tuple[list[str], list[int], list[int]]:
    out, n, dropped = [], [], []
    for text, masks in zip(texts, gone, strict=True):
        text = text or ""
        lines = text.count("\n") + 1 if text else 0
        if masks:
            masks = set(masks)
            kept = [x for x in text.split("\n") if not ((got := parse_line(x, p)) and got[1] in masks)]
            out.append("\n".join(kept)), n.append(lines), dropped.append(lines - len(kept))
        else:
            out.append(text), n.append(lines), dropped.append(0)
    return out, n, dropped


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: TemplateParams | None = None) -> DataFrame:
    """One row per input row: (id, n_lines, n_dropped, text without the lines of recurring templates).

    Null and empty texts have no lines and give an empty text; a text all of whose lines recur becomes empty.
    Rows count as one document if id and text are equal (null ids too), so repeated rows alone make
    no line recur; copies under other ids do. Lines end at \\n; texts and lines are read whole; other columns are not read.
    """
    p = params or TemplateParams()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("doc", F.xxhash64(F.col("id").cast("string"), F.col("text")))
    keyed = rows.select("doc", "text")
    # the text's own lines as hashes, once: what recurs and what goes is decided on these
    bare = reliable_checkpoint(keyed.mapInArrow(_lines(p, False), "doc long, leaf long, mask long").distinct())
    often = recurring_lines(keyed, bare, p)
    gone = bare.join(often, ["leaf", "mask"]).groupBy("doc").agg(F.collect_set("mask").alias("gone"))
    met = rows.join(gone, "doc", "left").select("id", "text", "gone")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, n, dropped = _rebuild(b.column("text").to_pylist(), b.column("gone").to_pylist(), p)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(text, pa.string())], names=["id", "n_lines", "n_dropped", "text"])

    return met.mapInArrow(run, f"id {kind}, n_lines long, n_dropped long, text string").withColumnRenamed("id", id_col)
