"""Quality rules with verdicts on hosts.

Every document is counted and held against rules. The failures are summed by host, the failure rate of a host is shrunk
towards the mean of all hosts with a beta prior estimated from the hosts themselves, and the verdict on the host is
joined back to its documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.llm.common import landed, split_words
from keysieve.operators.skew import lookup_join

SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Rules:
    """Base rules reject a document alone. Soft rules mark it as suspect; a suspect document goes if its host is bad."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbols_per_word: float = 0.1
    max_dup_line_share: float = 0.3
    min_mean_word: float = 2.0
    max_mean_word: float = 20.0
    max_host_rate: float = 0.5


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """How many words lie in a window of ``window`` words that the text has at least twice.

    Windows are numbered exactly, by numbering pairs of (window one word shorter, next word) again and again.
    """
    n = len(words)
    if n <= window:
        return 0
    known: dict[str, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    if len(known) == n:
        return 0
    # Windows of 2, then 4 words are numbered from two halves; the rest is added word by word.
    number, size = codes, 1
    while size < window:
        step = size if 2 * size <= window else 1
        tail = number[size:] if step == size else codes[size:]
        _, number = np.unique(number[:len(tail)] * n + tail, return_inverse=True)
        size += step
    again = np.bincount(number)[number] > 1
    covered = np.zeros(n, dtype=bool)
    for j in range(window):
        covered[j:j + len(again)] |= again
    return int(covered.sum())


def count_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    text = text or ""
    words = split_words(text)
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if split_words(line):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), lines, dup, repeated_words(words))


def _counts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([count_text(t) for t in texts], columns=[c.split()[0] for c in COUNTS.split(", ")])


def base_failed(rules: Rules = Rules()) -> Column:
    return ((F.col("n_words") < rules.min_words)
            | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))


def suspect(rules: Rules = Rules()) -> Column:
    words, chars = F.col("n_words"), F.col("word_chars")
    return (base_failed(rules) | (F.col("n_symbols") > rules.max_symbols_per_word * words)
            | (F.col("n_dup_lines") > rules.max_dup_line_share * F.col("n_lines"))
            | (chars < rules.min_mean_word * words) | (chars > rules.max_mean_word * words))


def host_rates(judged: DataFrame, host: str) -> DataFrame:
    """(host, docs, failed, rate): the shrunk failure rate of every host.

    The prior is a beta distribution by the method of moments: the spread of the hosts' rates beyond what chance gives
    sets how much weight the common mean has.
    """
    hosts = landed(judged.groupBy(F.col(host).alias("_host")).agg(
        F.count("*").alias("docs"), F.sum(F.col("_suspect").cast("long")).alias("failed")), "hosts")
    total = hosts.agg(F.count("*").alias("h"), F.sum("docs").alias("n"), F.sum("failed").alias("f"),
                      F.sum(F.col("failed") * F.col("failed") / F.col("docs")).alias("q")).first()
    if not total["n"]:
        return hosts.withColumn("rate", F.lit(0.0))
    mean = total["f"] / total["n"]
    chance = mean * (1 - mean)
    spread = total["q"] / total["n"] - mean * mean - chance * total["h"] / total["n"]
    weight = min(max(chance / spread - 1, 2.0), 1000.0) if spread > 1e-12 else 1000.0
    return hosts.withColumn("rate", (F.col("failed") + F.lit(mean * weight)) / (F.col("docs") + F.lit(weight)))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules(),
                  carry: list[str] | None = None) -> DataFrame:
    """Add the counts, ``base_failed``, ``suspect``, ``host_rate`` and ``kept`` to every row.

    ``carry`` names the input columns of the result; all of them if not given.

    Null and empty texts have no words and fail the base rules. A null host is the host "". Repeated rows are judged one
    by one and counted one by one. An empty table gives an empty table. Input columns with the name of an added column
    are replaced by it.
    """
    added = [c.split()[0] for c in COUNTS.split(", ")] + ["base_failed", "suspect", "host_rate", "kept"]
    own = [c for c in (docs.columns if carry is None else carry) if c not in added]
    counts = F.pandas_udf(_counts, COUNTS)(text).alias("_c")
    counted = (docs.select(*own, F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), counts)
               .select(*own, "_host", "_c.*")
               .withColumn("base_failed", base_failed(rules)).withColumn("_suspect", suspect(rules)))
    judged = landed(counted, "rules")
    rates = host_rates(judged, "_host").select("_host", F.col("rate").alias("host_rate"))
    spread = F.struct("n_words", "word_chars", "n_symbols", "n_repeat_words")
    return (lookup_join(judged, rates, "_host", spread)
            .withColumn("kept", ~F.col("base_failed") & ~(F.col("_suspect") & (F.col("host_rate") > rules.max_host_rate)))
            .withColumnRenamed("_suspect", "suspect").select(*own, *added))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows that are kept, with their columns as they were."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    return quality_rules(rows, f"_row.{text}", f"_row.{host}", rules).filter("kept").select("_row.*")
