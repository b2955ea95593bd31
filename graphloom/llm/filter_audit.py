"""How five filters interact: what each removes in every order, alone, in vain, and its Shapley sum.

Texts are routed by fingerprint: records are partitioned by xxhash and sorted by (fingerprint, id), and a chain of
full texts with their smallest id tells copies apart from collisions; the ids that are not the smallest fail filter E.
Rows then are a part and a mask of failed filters; ``combineByKey`` merges vectors of mask counts by part, from which
all orders follow without looking at a document again.

Hot texts: a map task sends a text once, with a count for the rows that share its id, and settles greater ids itself,
so a text that a third of all rows hold crosses the shuffle once a map task. A task holds at most ``HELD_BYTES`` of
texts while it maps and one fingerprint's different texts while it reduces.

Edge cases: null texts are empty texts; a null source is the part of the empty string; rows repeated in id and text are
not copies of each other (no id is smaller); a null id is neither smaller nor larger than another, so such rows never
fail E; a document has quality or toxicity 1 if any of its label rows says so; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: Bytes of texts that a map task compares among themselves before it sends them on.
HELD_BYTES = 64 << 20
#: Bytes of texts that a partition sorts, about.
ROUTED_BYTES = 128 << 20
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_capitals, _symbols = re.compile(r"[A-Z]").findall, re.compile(r"[#$%&*|]").search


def text_mask(text: str) -> int:
    """Bits 0 to 3: the text fails A (under 200 words), B (few distinct words), C (capitals), D (symbols)."""
    words = _words(text)
    n = len(words)
    return (n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * len(_capitals(text)) > 2 * len(text)) << 2 | bool(_symbols(text)) << 3


def _outgoing(rows: Iterable[tuple[int | None, bytes | None, str | None]], held_bytes: int = HELD_BYTES) -> Iterator[tuple]:
    """Of a partition's documents: ((fingerprint, id), (text, mask, parts)) for texts to be settled, the text None for ids that are.

    Parts counts the rows of that id and text by part.
    """
    chains: dict[int, list[list]] = {}
    held = 0

    def settled(mask: int, doc: int | None, parts: Counter) -> tuple:
        # already decided, so it goes wherever its id falls
        return (xxhash.xxh3_64_intdigest(str(doc)), -1 if doc is None else doc), (None, mask, dict(parts), doc)

    for doc, raw, source in rows:
        text, part = bytes(raw or b""), source or ""
        mask_of = lambda: text_mask(text.decode("utf-8", "replace"))  # noqa: E731, B023
        if doc is None:
            yield settled(mask_of(), None, Counter([part]))
            continue
        fp = xxhash.xxh3_64_intdigest(text)
        chain = chains.setdefault(fp, [])
        for entry in chain:
            if entry[0] == text:
                if doc == entry[1]:
                    entry[3][part] += 1
                elif doc > entry[1]:
                    yield settled(entry[2] | 16, doc, Counter([part]))
                else:
                    yield settled(entry[2] | 16, entry[1], entry[3])
                    entry[1], entry[3] = doc, Counter([part])
                break
        else:
            chain.append([text, doc, mask_of(), Counter([part])])
            held += len(text) + 200
            if held > held_bytes:
                yield from _leads(chains)
                chains, held = {}, 0
    yield from _leads(chains)


def _leads(chains: dict[int, list[list]]) -> Iterator[tuple]:
    for fp, chain in chains.items():
        for text, doc, mask, parts in chain:
            yield (fp, doc), (text, mask, dict(parts), doc)


def _settle(records: Iterable[tuple]) -> Iterator[tuple[int | None, int, str, int]]:
    """(id, mask, part, rows) from a partition sorted by (fingerprint, id): the first that brings a text has its smallest id."""
    now, chain = None, []
    for (fp, _), (text, mask, parts, doc) in records:
        if text is not None:
            if fp != now:
                now, chain = fp, []
            for known, least in chain:
                if known == text:
                    mask |= 16 if doc != least else 0
                    break
            else:
                chain.append((text, doc))
        for part, n in parts.items():
            yield doc, mask, part, n


def failed_masks(docs: DataFrame, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, mask, part, n): of every document the filters it fails (bit 0: A, ... bit 4: E), rows alike counted in n.

    Texts go to as many partitions as hold ``ROUTED_BYTES`` each, whatever the session's number is, so that a partition sorts in memory.
    """
    spark = docs.sparkSession
    if partitions is None:
        held = docs.agg(F.sum(F.octet_length(F.col(text_col)) + F.lit(100))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // ROUTED_BYTES))
    n = partitions
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"), F.col(source_col).cast("string")).rdd
    routed: RDD = rows.mapPartitions(_outgoing).repartitionAndSortWithinPartitions(n, lambda key: key[0] % n)
    return spark.createDataFrame(routed.mapPartitions(_settle), "doc_id long, mask int, part string, n long", verifySchema=False)


def duplicate_ids(masks: DataFrame) -> DataFrame:
    """(doc_id): the ids whose text a smaller id has, once each; from :func:`failed_masks`."""
    return masks.filter(F.col("mask").bitwiseAND(16) != 0).select("doc_id").distinct()


def _vector(row: tuple[int, bool, bool, int]) -> list[int]:
    return _add([0] * 96, row)


def _add(v: list[int], row: tuple[int, bool, bool, int]) -> list[int]:
    mask, good, toxic, n = row
    v[mask] += n
    v[32 + mask] += n * good
    v[64 + mask] += n * toxic
    return v


def _merge(v: list[int], w: list[int]) -> list[int]:
    return [x + y for x, y in zip(v, w, strict=True)]


@cache
def _orders() -> tuple[list[tuple[str, int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """(order, step, filter) of the 600 rows, and by row the masks that it removes, keeps and fails in vain."""
    masks, rows, removed, kept, late = np.arange(32), [], [], [], []
    for order in itertools.permutations(range(5)):
        gone = np.zeros(32, bool)
        for step, f in enumerate(order, 1):
            fails = (masks >> f & 1).astype(bool)
            rows.append(("".join(FILTERS[i] for i in order), step, f))
            removed.append(fails & ~gone)
            late.append(fails & gone)
            gone = gone | fails
            kept.append(~gone)
    return rows, *(np.array(x, np.int64) for x in (removed, kept, late))


def _report(item: tuple[str, list[int]]) -> Iterator[tuple]:
    """The rows of one part: every order, every step."""
    part, v = item
    rows, removes, keeps, late = _orders()
    v, good, toxic = np.array(v, np.int64).reshape(3, 32)
    removed = removes @ v
    shapley = np.zeros(5, np.int64)
    np.add.at(shapley, [f for _, _, f in rows], removed)
    counts = zip((keeps @ v).tolist(), removed.tolist(), (late @ v).tolist(), (removes @ good).tolist(), (removes @ toxic).tolist(), strict=True)
    for (order, step, f), (kept, r, redundant, g, t) in zip(rows, counts, strict=True):
        yield part, order, step, kept, r, redundant, int(v[1 << f]), g, t, int(shapley[f])


def audit_filters(docs: DataFrame, labels: DataFrame, partitions: int | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), 600 rows a part."""
    spark = docs.sparkSession
    masks = failed_masks(docs, partitions)
    said = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    # the narrow rows meet the labels, not the texts
    told = masks.join(said, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(False)), F.coalesce("bad", F.lit(False)), "n")
    vectors = told.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(_vector, _add, _merge, numPartitions=masks.rdd.getNumPartitions())
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return spark.createDataFrame(vectors.flatMap(_report), schema, verifySchema=False)
