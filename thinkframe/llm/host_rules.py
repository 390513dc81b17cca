"""Operator 5: host-level quality rules, with DataFrame operations only.

Rules judge each document; their failures are counted by host, each host's
failure rate is shrunk towards an empirical beta prior fitted to all hosts,
and a host whose shrunk rate is above the limit takes its documents with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: A host is refused when its shrunk failure rate is above this.
HOST_LIMIT = 0.5
WINDOW = 8


def _repeated_words(windows: str) -> Column:
    """Words lying in windows found twice or more: equal hashes are neighbours once sorted, their places are then added up."""
    n = F.size(windows)
    placed = F.array_sort(F.arrays_zip(F.col(windows).alias("w"), F.sequence(F.lit(0), n - 1).alias("i")))
    ahead = F.slice(placed, 2, n)
    behind = F.concat(F.array(F.lit(None).cast("struct<w:bigint,i:int>")), placed)
    marked = F.arrays_zip(placed.alias("x"), ahead.alias("y"), F.slice(behind, 1, n).alias("z"))
    repeated = F.filter(marked, lambda m: (m["x"]["w"] == m["y"]["w"]) | (m["x"]["w"] == m["z"]["w"]))
    at = F.array_sort(F.transform(repeated, lambda m: m["x"]["i"]))
    gaps = F.aggregate(at, F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")), lambda s, i: F.struct(
        (s["sum"] + F.least(F.lit(WINDOW), i - s["last"])).alias("sum"), i.alias("last")))
    return gaps["sum"]


def document_rules(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc_id, host and the counts of each whole text (a null text has no words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"))
    words = base.withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    counted = words.select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    windows = F.when(F.size("hashes") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size("hashes") - WINDOW + 1), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))).otherwise(F.array().cast("array<long>"))
    seen = counted.select("*", windows.alias("windows"))
    repeats = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _repeated_words("windows")).otherwise(0)
    return seen.select("doc_id", "host", "n_words", "word_chars", "n_symbols",
                       F.size("lines").cast("long").alias("n_lines"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                       repeats.cast("long").alias("n_repeat_words"))


def host_verdicts(rated: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, host_rate, host_kept) from rows (host, failed); rows without a host have no verdict.

    The prior's mean is the rate over all rows and its strength comes from the
    spread of the hosts' rates around it (method of moments), at least 1.
    """
    hosts = rated.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("failed").cast("double")).alias("k"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")).first()
    mean, strength = beta_prior(total.n or 0.0, total.k or 0.0, total.kk or 0.0)
    rate = (F.col("k") + mean * strength) / (F.col("n") + strength)
    return hosts.select("host", rate.alias("host_rate"), (rate <= limit).alias("host_kept"))


def beta_prior(n: float, k: float, kk: float) -> tuple[float, float]:
    """Mean and strength of the prior from the hosts' sums of rows, failures and failures^2 / rows."""
    mean = k / n if n else 0.0
    spread = max((kk - mean * k) / n, 0.0) if n else 0.0
    strength = mean * (1 - mean) / spread - 1 if spread > 0 else 1e6
    return mean, min(max(strength, 1.0), 1e6)


def host_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept, and host_rate.

    A document fails the base with under 20 words or over 30% of them in
    repeated 8-word windows. For its host's rate it also counts as failed with a
    symbol in over a tenth of its words or over 30% repeated lines. ``kept`` needs a passed base
    and a host that is not refused; without a host (null) the base decides.
    Null and empty texts have no words and fail. Repeated rows count and
    come out as often as they are there; an empty table gives an empty result; other columns are
    ignored. Equal windows are found by 64-bit hashes within one document.
    """
    counts = document_rules(docs, id_col, text_col, host_col)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    more = (10 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))
    rated = staged(counts.withColumn("base_failed", base).withColumn("failed", base | more), "rules")
    verdicts = host_verdicts(rated)
    return (rated.join(verdicts, "host", "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"), F.round("host_rate", 9).alias("host_rate")))
