"""Scalar functions of the analytics catalog as Column expressions."""

from __future__ import annotations

import datetime as dt
import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.schema import ID_TYPES

# Names that are only numbers, amounts and units, and names that are addresses.
NUMBERISH = r"(?i)^[\d\s.,%€$₽+–—-]*(?:трлн|млрд|млн|тыс|%)?[\d\s.,%€$₽+–—-]*$"
URLISH = r"(?i)^(?:https?://|www\.)|://"


def is_identifier(label: Column) -> Column:
    return F.coalesce(label.isin(*ID_TYPES), F.lit(False))


def is_meaningful_entity(name: Column, label: Column, exclude_identifiers: bool = True) -> Column:
    """Whether an entity is worth showing: not too short, not named as its type, and no identifier, number or address."""
    n = F.trim(F.coalesce(name, F.lit("")))
    ok = (F.length(n) >= 2) & ~F.coalesce(F.lower(n) == F.lower(label), F.lit(False))
    if exclude_identifiers:
        ok = ok & ~is_identifier(label) & ~n.rlike(NUMBERISH) & ~n.rlike(URLISH)
    return ok


def live(polarity: Column) -> Column:
    """Not negated; an unknown polarity counts as live."""
    return polarity.isNull() | (polarity != "negated")


def period_of_day(day: Column, granularity: str = "month") -> Column:
    """Label of the bucket that an epoch-day falls in; weeks are named by their Monday; unknown granularities mean month."""
    d = F.date_from_unix_date(day)
    if granularity == "year":
        return F.date_format(d, "yyyy")
    if granularity == "quarter":
        return F.concat(F.date_format(d, "yyyy"), F.lit("-Q"), F.quarter(d).cast("string"))
    if granularity == "week":
        return F.date_format(F.date_trunc("week", d), "yyyy-MM-dd")
    return F.date_format(d, "yyyy-MM-dd" if granularity == "day" else "yyyy-MM")


def day_of_iso(text: str, end: bool = False) -> int | None:
    """Epoch-day of a partial ISO date, at the start or the end of the year or month that it names; None if it is none."""
    try:
        parts = [int(x) for x in text.split("-")]
        y, m, d = (parts + [None, None])[:3]
        if m is None:
            day = dt.date(y, 12, 31) if end else dt.date(y, 1, 1)
        elif d is None:
            day = (dt.date(y + m // 12, m % 12 + 1, 1) - dt.timedelta(days=1)) if end else dt.date(y, m, 1)
        else:
            day = dt.date(y, m, d)
    except (ValueError, TypeError, AttributeError):
        return None
    return (day - dt.date(1970, 1, 1)).days


def parse_amount(text: Column) -> Column:
    """The first number of a text: with both separators the comma groups thousands, alone it is the decimal sign."""
    token = F.regexp_replace(F.regexp_extract(text, r"-?\d[\d  .,]*", 0), r"[  ]", "")
    both = token.contains(",") & token.contains(".")
    plain = F.when(both, F.replace(token, F.lit(","), F.lit(""))).otherwise(F.replace(token, F.lit(","), F.lit(".")))
    return plain.try_cast("double")


def normalize(v: Column, lo: float, hi: float) -> Column:
    return F.lit(0.0) if hi <= lo else F.least(F.greatest((v - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector and for vectors of different lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def sigmoid(x: Column) -> Column:
    """Without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


# Letters with diacritics that are folded to their base letter.
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñçŠšŽžёй"
FOLDED = "aaaaaaeeeeiiiiooooouuuuyyncsszzеи"


def deep_normalize(name: Column) -> Column:
    """Lower case, without diacritics, with anything but letters and digits as single spaces."""
    folded = F.translate(F.lower(F.coalesce(name, F.lit(""))), ACCENTED, FOLDED)
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def name_tokens(name: Column, stop: tuple[str, ...] = ("the", "of", "and", "llc", "ltd", "inc", "ооо", "оао", "зао", "пао", "ао")) -> Column:
    words = F.split(deep_normalize(name), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def script_of(name: Column) -> Column:
    cyr, lat = name.rlike(r"[Ѐ-ӿ]"), name.rlike(r"[A-Za-z]")
    return F.when(cyr & lat, "mixed").when(cyr, "cyrillic").when(F.coalesce(name, F.lit("")).rlike(r"^[\x00-\x7F]*$"), "ascii").otherwise("mixed")


def initials_signature(name: Column) -> Column:
    """'surname|initial' of 'Surname I. O.' and 'I. O. Surname' forms; null for others."""
    tail = F.regexp_extract(name, r"^([\p{L}-]{2,})\s+(\p{L})\.\s*(?:\p{L}\.)?$", 1)
    tail_i = F.regexp_extract(name, r"^([\p{L}-]{2,})\s+(\p{L})\.\s*(?:\p{L}\.)?$", 2)
    head = F.regexp_extract(name, r"^(\p{L})\.\s*(?:\p{L}\.\s*)?([\p{L}-]{2,})$", 2)
    head_i = F.regexp_extract(name, r"^(\p{L})\.\s*(?:\p{L}\.\s*)?([\p{L}-]{2,})$", 1)
    return F.when(tail != "", F.lower(F.concat_ws("|", tail, tail_i))).when(head != "", F.lower(F.concat_ws("|", head, head_i)))


def match_key(name: Column) -> Column:
    """White space collapsed; ASCII names with every word capitalised, others as they are."""
    flat = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    return F.when(flat.rlike(r"^[\x00-\x7F]*$"), F.initcap(flat)).otherwise(flat)


def safe_label(text: Column) -> Column:
    """Upper case with other characters as single underscores; RELATED if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"[^A-Z0-9_]+", "_"), r"_+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.when(s == "", "RELATED").otherwise(s)


def normalize_polarity(text: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.startswith("neg"), "negated").when(t.startswith("unc"), "uncertain").otherwise("affirmed")


def valid_bound(text: Column) -> Column:
    """A partial ISO date, or null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01]))?)?$"), t)


def trigrams(text: Column) -> Column:
    """Distinct letter trigrams of the padded lower-case words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def members_hash(names: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(names), "\x1f"), 256)


def numbers_in(text: Column) -> Column:
    """Numbers of a text, without grouping spaces and commas as decimal points."""
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=\d)[  ](?=\d{3})", ""), F.lit(r"-?\d+(?:[.,]\d+)?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("."))))


def faithfulness(answer: Column, evidence: Column) -> Column:
    """Share of the answer's numbers that occur in the evidence; 1 without numbers."""
    mine = numbers_in(answer)
    return F.when(F.size(mine) == 0, F.lit(1.0)).otherwise(1 - F.size(F.array_except(mine, numbers_in(evidence))) / F.size(mine))


def period_bounds(period: Column, granularity: str) -> Column:
    """A struct (first, last) of the days that a label of :func:`period_of_day` covers; null for what is no label."""
    if granularity == "year":
        first, last = F.make_date(period.try_cast("int"), F.lit(1), F.lit(1)), F.lit(12)
    elif granularity == "quarter":
        month = (F.substring(period, 7, 1).try_cast("int") - 1) * 3 + 1
        first, last = F.make_date(F.substring(period, 1, 4).try_cast("int"), month, F.lit(1)), F.lit(3)
    elif granularity in ("week", "day"):
        first = period.try_cast("date")
        return F.struct(first.alias("first"), F.date_add(first, 6 if granularity == "week" else 0).alias("last"))
    else:
        first, last = F.concat(F.substring(period, 1, 7), F.lit("-01")).try_cast("date"), F.lit(1)
    return F.struct(first.alias("first"), F.date_sub(F.add_months(first, last), 1).alias("last"))


def period_in_window(period: Column, granularity: str, since: str | None = None, until: str | None = None) -> Column:
    """Whether the period overlaps the window of (partial) ISO dates; a bound that is none does not bind."""
    b = period_bounds(period, granularity)
    keep = F.lit(True)
    if (lo := day_of_iso(since)) is not None:
        keep = keep & (F.unix_date(b["last"]) >= lo)
    if (hi := day_of_iso(until, end=True)) is not None:
        keep = keep & (F.unix_date(b["first"]) <= hi)
    return keep


def parse_temporal(text: Column) -> Column:
    """A struct (valid_from, valid_to) of ``from..to``; a single date is a start, each bound must be a partial ISO date."""
    v = F.trim(F.coalesce(text, F.lit("")))
    at = F.instr(v, "..")
    left = F.when(at > 0, F.substring(v, F.lit(1), at - 1)).otherwise(v)
    right = F.when(at > 0, F.substring(v, at + 2, F.length(v)))
    return F.struct(valid_bound(F.trim(left)).alias("valid_from"), valid_bound(F.trim(right)).alias("valid_to"))


def display_entity_name(name: Column) -> Column:
    """All-lowercase words of an ASCII name are capitalised; others, and names in other scripts, stay as they are."""
    v = F.regexp_replace(F.trim(name), r"\s+", " ")
    word = lambda w: F.when((w == F.lower(w)) & (w != F.upper(w)), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))).otherwise(w)
    return F.when(v.rlike(r"^[\x00-\x7F]*$"), F.array_join(F.transform(F.split(v, " "), word), " ")).otherwise(v)


def entity_vid(name: Column) -> Column:
    """32 hex digits of a 128-bit hash by which an entity is stored; null counts as empty."""

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda x: hashlib.blake2b((x or "").encode(), digest_size=16).hexdigest())

    return run(name)
