"""URL verdicts: host and path rules, and for the rest the ratio of two character language models.

Both models are variable-order Markov models with smoothing, one of accepted and one of rejected urls. The longest
context that was seen often enough predicts a character, shorter ones smooth it. Everything is DataFrame operations:
grams are counted with partial aggregates, the models hold every gram, and each distinct gram of the urls is looked up once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.llm.common import landed
from keysieve.operators.skew import lookup_join

ORDER = 5           # characters of context at most
START, END = "\u0002", "\u0003"
Rule = tuple[str, str]   # (verdict, "host/path")


def host_of(url: str = "url") -> Column:
    """The part after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(_part(url, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return _part(url, 2)


def _part(url: str, group: int) -> Column:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.coalesce(F.regexp_extract(F.col(url), pattern, group), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits: its host is the url's or a parent of it, its path a prefix. Null if none does."""
    fitting = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        fitting = F.when(fits, F.lit(rule)).otherwise(fitting)
    return fitting


def verdict_of(rule: Column, rules: Sequence[Rule]) -> Column:
    return reduce(lambda column, r: F.when(rule == r[1], F.lit(r[0])).otherwise(column), rules,
                  F.lit(None).cast("string"))


def _characters(url: str) -> Column:
    """The url as the models see it: without scheme, lower case, digits alike, with start and end marks."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://", ""))
    return F.concat(F.lit(START * ORDER), F.regexp_replace(plain, "[0-9]", "0"), F.lit(END))


def _gram(text: Column, position: Column, order: int) -> Column:
    """The character at ``position`` (from 1, after the start marks) with ``order`` characters before it."""
    return F.substring(text, position + (ORDER - order), F.lit(order + 1))


def _positions(text: Column) -> Column:
    return F.explode(F.sequence(F.lit(1), F.length(text) - ORDER)).alias("_at")


def fit_models(known: DataFrame, url: str, accepted: Column, least: int = 2) -> list[DataFrame]:
    """For each order a table (gram, ratio) of all grams seen: the log-likelihood ratio of the last character.

    p(character | context) = (n(gram) + c * p(character | shorter context)) / (n(context) + c), with c the number of
    different characters seen after the context, so much seen contexts trust themselves. Grams seen fewer than ``least``
    times are left to shorter contexts.
    """
    text = known.select(_characters(url).alias("_t"), accepted.cast("int").alias("_a"))
    grams = text.select("_t", "_a", _positions(F.col("_t"))).select("_a", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), _gram(F.col("_t"), F.col("_at"), k).alias("gram")) for k in range(ORDER + 1)])).alias("g"))
    counts = landed(grams.select("_a", "g.k", "g.gram").groupBy("k", "gram").agg(
        F.sum(F.col("_a").cast("double")).alias("acc"), F.sum((1 - F.col("_a")).cast("double")).alias("rej"))
        .withColumn("context", F.expr("substring(gram, 1, k)")), "grams")
    models: list[DataFrame] = []
    for k in range(ORDER + 1):
        rows = counts.filter(F.col("k") == k)
        seen = rows.groupBy("context").agg(
            F.sum("acc").alias("n_acc"), F.sum("rej").alias("n_rej"),
            F.sum((F.col("acc") > 0).cast("double")).alias("c_acc"), F.sum((F.col("rej") > 0).cast("double")).alias("c_rej"))
        rows = rows.join(seen, "context")
        if k:
            shorter = models[-1].select(F.col("gram").alias("_short"), F.col("p_acc").alias("q_acc"), F.col("p_rej").alias("q_rej"))
            rows = rows.withColumn("_short", F.expr("substring(gram, 2)")).join(shorter, "_short")
        else:
            rows = rows.withColumns({"q_acc": F.lit(1 / 128), "q_rej": F.lit(1 / 128)})
        smooth = {f"p_{s}": (F.col(s) + (F.col(f"c_{s}") + 1) * F.col(f"q_{s}")) / (F.col(f"n_{s}") + F.col(f"c_{s}") + 1)
                  for s in ("acc", "rej")}
        models.append(landed(rows.withColumns(smooth).select("gram", "acc", "rej", "p_acc", "p_rej"), f"order{k}"))
    ratio = F.log("p_acc") - F.log("p_rej")
    weight = F.col("acc") + F.col("rej")
    return [m.filter(weight >= (least if k else 1)).select("gram", ratio.alias("ratio")) for k, m in enumerate(models)]


def gram_ratios(grams: DataFrame, models: Sequence[DataFrame]) -> DataFrame:
    """(gram, ratio) of the distinct longest ``grams``: the ratio of the longest end of each that its model knows.

    Goes up from single characters. A gram is in its model once, and as many grams share an end as there are characters,
    so no join has a hot key.
    """
    ends = [grams.select(F.expr(f"substring(gram, {ORDER - k + 1})").alias("gram")).distinct() for k in range(ORDER)] + [grams]
    known = ends[0].join(models[0], "gram", "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))
    for k in range(1, ORDER + 1):
        shorter = known.select(F.col("gram").alias("_short"), F.col("ratio").alias("_less"))
        known = (ends[k].join(models[k], "gram", "left").withColumn("_short", F.expr("substring(gram, 2)")).join(shorter, "_short")
                 .select("gram", F.coalesce("ratio", "_less").alias("ratio")))
    return known


def score_urls(urls: DataFrame, url: str, models: Sequence[DataFrame]) -> DataFrame:
    """(url, score): the ratio of every distinct url, per character. Ratios are broadcast only if they are proven to be few."""
    text = urls.select(F.col(url).alias("url")).distinct().withColumn("_t", _characters("url"))
    rows = text.select("url", "_t", _positions(F.col("_t"))).select("url", _gram(F.col("_t"), F.col("_at"), ORDER).alias("gram"))
    ratios = landed(gram_ratios(landed(rows.select("gram").distinct(), "urlgrams"), models), "gramratios")
    scored = lookup_join(rows, ratios, "gram", F.col("url"), "inner")
    return scored.groupBy("url").agg((F.sum("ratio") / F.count("*")).alias("score"))


def calibrated_threshold(scored: DataFrame, bins: int = 400, width: float = 4.0) -> float:
    """The score that best tells accepted from rejected urls, from a histogram of fixed size."""
    at = F.floor((F.least(F.greatest("score", F.lit(-width)), F.lit(width - 1e-6)) + width) / (2 * width) * bins).cast("int")
    rows = scored.groupBy(at.alias("bin")).agg(F.sum(F.col("accepted").cast("long")).alias("a"), F.count("*").alias("n")).collect()
    accepted, rejected = sum(r["a"] for r in rows), sum(r["n"] - r["a"] for r in rows)
    if not accepted or not rejected:
        return float("-inf") if accepted or not rejected else float("inf")
    table = {r["bin"]: (r["a"] / accepted, (r["n"] - r["a"]) / rejected) for r in rows}
    gain, best, place = 0.0, 0.0, 0
    for b in range(bins):
        a, r = table.get(b, (0.0, 0.0))
        gain += r - a                       # rejected urls caught below the next edge, less accepted ones lost
        if gain > best:
            best, place = gain, b + 1
    return place / bins * 2 * width - width


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``score`` to every row.

    A rule decides where one fits. Urls under a rule are the accepted and rejected ones to learn from, a fifth of them
    kept aside to calibrate the threshold; the models decide on all others. Null urls and urls without ``://`` have an
    empty host and path and are scored like any text (null as the empty one). Without accepted or without rejected urls
    there is nothing to compare, and the class that was seen, or else "allow", is the verdict. Input columns with the
    name of an added one are replaced.
    """
    added = ("host", "path", "rule", "verdict", "score")
    own = [c for c in pages.columns if c not in added]
    judged = pages.select(*own).withColumn("host", host_of(url)).withColumn("path", path_of(url))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    judged = judged.withColumn("_ruled", verdict_of(F.col("rule"), rules)).withColumn("_key", F.coalesce(F.col(url), F.lit("")))
    known = judged.filter(F.col("rule").isNotNull()).select("_key", (F.col("_ruled") == "allow").alias("_ok"))
    aside = F.crc32(F.col("_key").cast("binary")) % 5 == 0
    models = [landed(m, "urlmodel") for m in fit_models(known.filter(~aside), "_key", F.col("_ok"))]
    scores = landed(score_urls(judged, "_key", models), "urlscores").withColumnRenamed("url", "_key")
    kept_aside = known.filter(aside).distinct().join(scores, "_key").select("score", F.col("_ok").alias("accepted"))
    edge = calibrated_threshold(kept_aside)
    by_score = F.when(F.col("score") >= edge, F.lit("allow")).otherwise(F.lit("block"))
    return (judged.join(scores, "_key").withColumn("verdict", F.coalesce("_ruled", by_score)).select(*own, *added))
