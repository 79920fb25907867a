"""Quality rules with host verdicts, in DataFrame functions only.

Every document gets its rule figures without a shuffle. Failures are counted per host with map-side
aggregation, the failure rate of each host is shrunk towards a beta prior fitted to all hosts (method of
moments), and the verdict on the host comes back to its documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import free_name, replaced, staged

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Hosts whose verdicts are broadcast at most (about 100 bytes each); beyond, they are joined by shuffle.
BROADCAST_HOSTS = 50_000


@dataclass(frozen=True)
class Settings:
    """``max_host_rate``: a host is rejected if its shrunk failure rate is above."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    max_host_rate: float = 0.6


def rule_figures(df: DataFrame, text: str, settings: Settings = Settings()) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed (columns of these names are replaced).

    Null and empty texts have no words, count 0 everywhere and fail. Windows of words are ordered by
    their hash, and neighbours with equal hashes are compared word by word.
    """
    k = settings.window
    words, hashes, starts = (free_name(df, x) for x in ("_words", "_hashes", "_starts"))
    source = F.coalesce(F.col(text), F.lit(""))
    lines = free_name(df, "_lines")
    df = df.withColumn(lines, F.filter(F.split(source, "\n", -1), lambda line: line.rlike(WORD)))
    df = df.withColumn(words, F.expr(f"regexp_extract_all(coalesce(`{text}`, ''), r'{WORD}', 0)"))
    n = F.size(words)
    df = df.withColumn(starts, F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>")))
    single = free_name(df, "_single")
    df = df.withColumn(single, F.transform(F.col(words), lambda w: F.xxhash64(w)))
    df = df.withColumn(hashes, F.transform(F.col(starts), lambda i: F.xxhash64(*[F.get(F.col(single), i + j) for j in range(k)])))
    sorted_windows, repeated = free_name(df, "_sorted"), free_name(df, "_repeated")
    any_repeat = F.size(F.array_distinct(F.col(hashes))) < F.size(hashes)
    windows = F.sort_array(F.transform(F.col(starts), lambda i: F.struct(F.get(F.col(hashes), i).alias("h"), i.alias("i"))))
    df = df.withColumn(sorted_windows, F.when(any_repeat, windows))
    window = lambda x: F.slice(F.col(words), x["i"] + 1, k)
    equal = lambda x, y: F.coalesce((x["h"] == y["h"]) & (window(x) == window(y)), F.lit(False))
    same = lambda x, i: equal(x, F.get(F.col(sorted_windows), i - 1)) | equal(x, F.get(F.col(sorted_windows), i + 1))
    flagged = F.filter(F.col(sorted_windows), same)
    df = df.withColumn(repeated, F.sort_array(F.transform(flagged, lambda x: x["i"])))
    covered = F.aggregate(
        F.col(repeated),
        F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")),
        lambda a, i: F.struct((a["n"] + i + k - F.greatest(i, a["end"])).alias("n"), (i + k).alias("end")),
        lambda a: a["n"],
    )
    df = replaced(
        df,
        n_words=F.size(words).cast("long"),
        word_chars=F.length(F.translate(source, " \t\n\x0b\x0c\r", "")).cast("long"),
        n_symbols=F.expr(f"regexp_count(coalesce(`{text}`, ''), r'{SYMBOLS}')").cast("long"),
        n_dup_lines=(F.size(lines) - F.size(F.array_distinct(F.col(lines)))).cast("long"),
        n_repeat_words=F.coalesce(covered, F.lit(0)).cast("long"),
    ).drop(lines, words, starts, single, hashes, sorted_windows, repeated)
    return replaced(df, base_failed=base_rule(settings))


def base_rule(settings: Settings) -> Column:
    return (F.col("n_words") < settings.min_words) | (100 * F.col("n_repeat_words") > settings.max_repeat_percent * F.col("n_words"))


def host_rates(figures: DataFrame, host: str) -> DataFrame:
    """One row per host: host, n_docs, n_failed and rate, shrunk by a beta prior with the moments of all hosts' rates.

    Documents without a host form none. With fewer than two hosts, or rates that don't differ, the prior
    has the weight of one document at the overall rate; its weight is at most the mean size of a host.
    """
    hosts = figures.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(raw).alias("m"), F.var_samp(raw).alias("v"), F.avg("n_docs").alias("size"))
    weight = F.when((F.col("v") > 0) & (F.col("m") * (1 - F.col("m")) > F.col("v")), F.least(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.col("size"))).otherwise(1.0)
    prior = prior.select("m", F.greatest(weight, F.lit(1e-6)).alias("weight")).first()
    mean, strength = (prior["m"] or 0.0, prior["weight"])
    return hosts.withColumn("rate", (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength))


def with_verdicts(figures: DataFrame, host: str, settings: Settings = Settings()) -> DataFrame:
    """``figures`` with host_rate and kept. A document is kept if it passes and its host isn't rejected.

    Documents without a host are judged by their own figures. ``figures`` is read twice: hand in a stored table.
    """
    rates = staged(host_rates(figures, host))
    verdicts = rates.select(F.col("host").alias(key := free_name(figures, "_host")), F.col("rate").alias(rate := free_name(figures, "_rate")))
    if rates.count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    out = figures.join(verdicts, F.col(f"`{host}`") == F.col(key), "left")
    kept = ~F.col("base_failed") & (F.coalesce(F.col(rate), F.lit(0.0)) <= settings.max_host_rate)
    return replaced(out, host_rate=F.col(rate), kept=kept).drop(key, rate)


def judge(docs: DataFrame, text: str = "text", host: str = "source", settings: Settings = Settings()) -> DataFrame:
    """All columns of ``docs`` with the rule figures, host_rate and kept; what ``docs`` has under these names is replaced.

    Empty tables give empty results, repeated rows are judged one by one.
    """
    return with_verdicts(staged(rule_figures(docs, text, settings)), host, settings)
