"""Quality rules with host-level verdicts, in DataFrame functions only.

Every document is measured, rule failures are summed by host, each host's
failure rate is shrunk towards an empirical beta prior, and the host's
verdict is joined back to its documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BROADCAST_ROWS, NON_WS_CLASS, WS_CLASS, let, words_of
from graphloom.session import reliable_checkpoint

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class QualityParams:
    """min_words, max_repeat_pct: the base rule. The others are the method's.

    A document breaks a soft rule when it has more than ``max_symbol_pct`` symbols per 100 words,
    more than ``max_dup_line_pct`` repeated lines per 100 lines, or a mean word length outside
    ``word_len``. A host is rejected when its shrunk failure rate lies more than ``host_sigmas`` standard deviations of
    the fitted prior above the prior's mean, or beyond ``host_reject_rate``; in a
    rejected host the soft rules bind, elsewhere they only count towards the host's rate. Clean
    documents of a rejected host are kept. With ``doc_slack`` a document of any host also goes when it breaks a
    soft rule by more than a factor that the host's rate moves: 1 + ``doc_slack`` in a host without failures,
    down to 1 at ``host_reject_rate``.
    """

    min_words: int = 20
    max_repeat_pct: int = 30
    max_symbol_pct: int = 30
    max_dup_line_pct: int = 30
    word_len: tuple[int, int] = (2, 20)
    host_reject_rate: float = 0.5
    host_sigmas: float = 2.0
    prior_strength: tuple[float, float] = (2.0, 1000.0)
    doc_slack: float | None = None


def _repeat_words(w: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more, by sorting window hashes: n log n for any length."""

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def dup_positions(s: Column) -> Column:
            same = lambda j: F.coalesce(F.get(s, j)["h"] == F.get(s, j + 1)["h"], F.lit(False))
            marked = F.transform(s, lambda x, j: F.when(same(j) | ((j > 0) & same(j - 1)), x["p"]))
            return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

        start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).alias("e"))
        add = lambda a, p: F.struct(
            (a["c"] + p + F.lit(WINDOW) - F.greatest(p, a["e"])).cast("long").alias("c"), (p + F.lit(WINDOW)).alias("e")
        )
        return let(ranked, lambda s: F.aggregate(dup_positions(s), start, add, lambda a: a["c"]))

    def over(v: Column) -> Column:
        # element access, not slice(): slice copies the whole array for each window
        hashes = F.transform(F.sequence(F.lit(0), F.size(v) - WINDOW), lambda i: F.xxhash64(*[F.get(v, i + k) for k in range(WINDOW)]))
        distinct = lambda h: F.size(F.array_distinct(h)) == F.size(h)
        return let(hashes, lambda h: F.when(distinct(h), F.lit(0).cast("long")).otherwise(covered(h)))

    by_word = let(F.transform(w, lambda x: F.xxhash64(x)), over)
    return F.when(F.size(w) < WINDOW + 1, F.lit(0).cast("long")).otherwise(by_word)


def measures(text: Column) -> Column:
    """A struct of the document's counts; null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NON_WS_CLASS))
    by_words = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    by_lines = let(
        lines,
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    return F.struct(
        by_words.alias("w"),
        by_lines.alias("l"),
        (F.length(t) - F.length(F.regexp_replace(t, f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
    )


def _breaks_soft(c: Column, p: QualityParams, factor: Column) -> Column:
    n = c["w"]["n_words"]
    return (
        (c["n_symbols"] * 100 > n * p.max_symbol_pct * factor)
        | (c["l"]["n_dup_lines"] * 100 > c["l"]["n_lines"] * p.max_dup_line_pct * factor)
        | (c["w"]["word_chars"] * factor < n * p.word_len[0])
        | (c["w"]["word_chars"] > n * p.word_len[1] * factor)
    )


def _judged(df: DataFrame, m: str, p: QualityParams, base: str, soft: str) -> DataFrame:
    c = F.col(m)
    n = c["w"]["n_words"]
    base_failed = (n < p.min_words) | (c["w"]["n_repeat_words"] * 100 > n * p.max_repeat_pct)
    return df.withColumns({base: base_failed, soft: _breaks_soft(c, p, F.lit(1))})


def _verdict(c: Column, p: QualityParams, soft: Column, rate: Column, rejected: Column) -> Column:
    """Whether a document that passes the base rule is rejected."""
    if p.doc_slack is None:
        return rejected & soft
    return (rejected & soft) | _breaks_soft(c, p, 1 + p.doc_slack * F.greatest(F.lit(0.0), 1 - rate / p.host_reject_rate))


def host_verdicts(judged: DataFrame, host: str, base: str, soft: str, p: QualityParams) -> tuple[DataFrame, int]:
    """(host, n_docs, n_failed, host_rate, host_rejected) and the number of hosts.

    The prior is fitted to all hosts by moments: its mean is the overall rate, its strength follows the
    spread of the hosts' rates beyond binomial noise.
    """
    # hosts' sums are pre-aggregated before the shuffle, so a hot host costs one row a task
    hosts = reliable_checkpoint(
        judged.groupBy(F.col(host).alias("host")).agg(
            F.count(F.lit(1)).alias("n_docs"), F.sum((F.col(base) | F.col(soft)).cast("long")).alias("n_failed")
        ).coalesce(8)
    )
    rate = F.col("n_failed") / F.col("n_docs")
    s = hosts.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n_docs").alias("n"),
        F.sum("n_failed").alias("f"),
        F.sum(rate).alias("r1"),
        F.sum(rate * rate).alias("r2"),
        F.sum(1.0 / F.col("n_docs")).alias("inv"),
    ).first()
    k = s["k"] or 0
    mean = (s["f"] or 0) / s["n"] if s["n"] else 0.0
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    spread = max((s["r2"] or 0) / k - ((s["r1"] or 0) / k) ** 2, 0.0) if k else 0.0
    noise = mean * (1 - mean) * ((s["inv"] or 0) / k) if k else 0.0
    between = max(spread - noise, 1e-12)
    strength = min(max(mean * (1 - mean) / between - 1, p.prior_strength[0]), p.prior_strength[1])
    shrunk = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    # the spread of the fitted beta distribution
    cut = min(p.host_reject_rate, mean + p.host_sigmas * math.sqrt(mean * (1 - mean) / (strength + 1)))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > cut), k


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", params: QualityParams | None = None) -> DataFrame:
    """One row per input row: the counts, the base rule, the host's verdict and ``kept``.

    Null text is empty (and fails ``min_words``); rows with a null host form one host; a null id passes
    through; repeated rows are judged alike, each by itself; an empty table gives an empty result; other
    columns of the input are not read.
    """
    p = params or QualityParams()
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), measures(F.col(text_col)).alias("m"))
    # the text is read once: what follows reads these few numbers a document
    judged = reliable_checkpoint(_judged(rows, "m", p, "base_failed", "soft_failed"))
    hosts, k = host_verdicts(judged, "host", "base_failed", "soft_failed", p)
    hosts = hosts.select(F.col("host").alias("host_key"), "host_rate", "host_rejected")
    joined = judged.join(F.broadcast(hosts) if k <= BROADCAST_ROWS else hosts, F.col("host").eqNullSafe(F.col("host_key")), "left")
    m = F.col("m")
    return joined.select(
        F.col("id").alias(id_col),
        m["w"]["n_words"].alias("n_words"),
        m["w"]["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        m["l"]["n_dup_lines"].alias("n_dup_lines"),
        m["w"]["n_repeat_words"].alias("n_repeat_words"),
        "base_failed",
        "soft_failed",
        "host_rate",
        "host_rejected",
        (~F.col("base_failed") & ~_verdict(m, p, F.col("soft_failed"), F.col("host_rate"), F.col("host_rejected"))).alias("kept"),
    )


def keep_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source", params: QualityParams | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns; same rules and edge cases as :func:`score_documents`.

    Rows are measured again rather than joined back, so the texts are never shuffled and ids need not be unique.
    """
    p = params or QualityParams()
    names, m = docs.columns, "__quality_m"
    rows = _judged(docs.withColumn(m, measures(F.col(text_col))), m, p, "__quality_base", "__quality_soft")
    hosts, k = host_verdicts(rows.select(F.col(host_col).alias("__quality_host"), "__quality_base", "__quality_soft"), "__quality_host", "__quality_base", "__quality_soft", p)
    verdicts = hosts.select(F.col("host").alias("__quality_key"), F.col("host_rate").alias("__quality_rate"), F.col("host_rejected").alias("__quality_bad"))
    joined = rows.join(F.broadcast(verdicts) if k <= BROADCAST_ROWS else verdicts, F.col(host_col).eqNullSafe(F.col("__quality_key")), "left")
    gone = _verdict(F.col(m), p, F.col("__quality_soft"), F.col("__quality_rate"), F.col("__quality_bad"))
    # one number over both verdicts, which may be null for all that the optimiser knows: a condition of its own for the base
    # rule, or for its not being null, would be pushed below the join and measure the text a second time
    faults = F.col("__quality_base").cast("int") + gone.cast("int") * F.when(F.col("__quality_rate").isNotNull(), 1).otherwise(0)
    return joined.filter(F.coalesce(faults, F.lit(1)) == 0).select(*[F.col(f"`{c}`") for c in names])
