"""Claims and verdicts out of model replies, and contradictions confirmed by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.stats import claim_contradictions

_CLAIM = "array<struct<subject:string,attribute:string,value:string,polarity:string>>"


def parse_claims(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """(doc_id, source, subject, attribute, value, polarity) of replies that hold a JSON array anywhere; items without subject, attribute or value are left out.

    The polarity is "negated" only if the reply says so. Null and malformed replies give no claims.
    """
    body = F.regexp_extract(F.coalesce(F.col(raw), F.lit("")), r"(?s)(\[.*\])", 1)
    c = replies.select("doc_id", "source", F.explode(F.from_json(body, _CLAIM)).alias("c")).select("doc_id", "source", "c.*")
    full = lambda x: F.trim(F.coalesce(F.col(x), F.lit(""))) != ""
    c = c.filter(full("subject") & full("attribute") & full("value"))
    polarity = F.when(F.lower(F.trim("polarity")).startswith("neg"), "negated").otherwise("affirmed")
    return c.select("doc_id", "source", F.trim("subject").alias("subject"), F.trim("attribute").alias("attribute"), F.trim("value").alias("value"), polarity.alias("polarity"))


def parse_verdict(raw: Column) -> Column:
    """CONTRADICT, AGREE or NEUTRAL; a reply that names both contradicts, null is neutral."""
    low = F.upper(F.coalesce(raw, F.lit("")))
    return F.when(low.contains("CONTRADICT"), "CONTRADICT").when(low.rlike(r"\bAGREE"), "AGREE").otherwise("NEUTRAL")


def refine(contradictions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Contradictions without those whose two best-supported values were judged to agree; a polarity split stays.

    verdicts: value_a, value_b (in either order) and the raw reply; pairs without one stay.
    """
    v = verdicts.select(F.least("value_a", "value_b").alias("x"), F.greatest("value_a", "value_b").alias("y"), parse_verdict(F.col("raw")).alias("verdict"))
    # of several replies on a pair a contradiction counts most
    v = v.groupBy("x", "y").agg(F.max(F.when(F.col("verdict") == "CONTRADICT", 2).when(F.col("verdict") == "AGREE", 1).otherwise(0)).alias("v"))
    one, two = F.get("versions", F.lit(0))["value"], F.get("versions", F.lit(1))["value"]
    c = contradictions.withColumns({"x": F.least(one, two), "y": F.greatest(one, two)})
    agreed = F.coalesce(F.col("v") == 1, F.lit(False)) & (F.size("versions") >= 2) & ~F.coalesce("polarity_split", F.lit(False))
    return c.join(v, ["x", "y"], "left").filter(~agreed).drop("x", "y", "v")


def contradictions_of(replies: DataFrame, verdicts: DataFrame, raw: str = "raw") -> DataFrame:
    """From replies to confirmed contradictions: claims, their versions by subject and attribute (without case), and the verdicts."""
    c = parse_claims(replies, raw)
    keyed = c.withColumns({"subject": F.lower("subject"), "attribute": F.lower("attribute")})
    return refine(claim_contradictions(keyed), verdicts)
