"""Personal data: generators propose spans, boosted trees judge the ones that no exact rule settles.

Base spans come from fixed patterns and checks and always stay. Wider generators propose more spans, which may overlap.
Boosted trees over format and context features learn from the base spans what personal data looks like, seeing neither which
pattern proposed a span nor how it was spelled. A threshold, calibrated on rows kept aside, selects the spans to add. Scanning, features, trees and redaction are all column
expressions within a row: no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.llm.common import fresh, landed, text_or_empty

KINDS = ("email", "ip", "card", "phone")

# The base patterns, with runs that don't backtrack. A run that failed from its first character isn't tried again from
# the next one (unless the match before ended there), which changes no match and keeps long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider patterns: spelled-out addresses, numbers in groups, addresses in hexadecimal.
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[a-z0-9-]{1,63}"
             r"(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[a-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[./_\x20-][0-9]{4}){3}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[.\x20-])(?:[0-9]{2,4}[.\x20-]){1,3}[0-9]{2,4}(?![0-9A-Za-z])",
}
CUES = {
    "contact": r"(?i)(tel|phone|fax|call|mobile|whatsapp|mail|contact|reach|write)",
    "money": r"(?i)(card|visa|credit|debit|account|iban|pay)",
    "network": r"(?i)(\bip\b|host|server|address|ping)",
    "code": r"(?i)(order|invoice|version|release|isbn|issn|serial|build|page|\bid\b|sha|key|token)",
}
FEATURES = ("kind", "digits", "letters", "length", "groups", "longest", "dots", "marks", "valid", "glued", "prose", *CUES)


def _needs(text: Column, kind: str, wide: bool = False) -> Column:
    """A cheap condition without which the patterns of a kind can't match."""
    if kind == "email":
        return text.rlike(r"(?i)[ (\[]at[ )\]]") if wide else text.contains("@")
    return text.contains(":") if wide and kind == "ip" else text.rlike("[0-9]")


def _may_hold(text: Column) -> Column:
    return text.rlike(r"[@0-9:]|(?i)[ (\[]at[ )\]]")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` and the lambdas in it use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _matches(text: Column, pattern: str, kind: str, wide: bool) -> Column:
    """Every match with place, value and what stands around it; places count code points from 0."""
    cut = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def place(c: Column) -> Column:
        pairs = F.zip_with(c["parts"], c["hits"], lambda a, b: F.struct(F.length(a).alias("a"), F.length(b).alias("b")))
        begin = F.aggregate(
            F.slice(pairs, F.lit(1), F.size(c["hits"])),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
            lambda s, x: F.struct((s["at"] + x["a"] + x["b"]).alias("at"), F.concat(s["all"], F.array(s["at"] + x["a"])).alias("all")),
            lambda s: s["all"])
        return F.struct(c["parts"].alias("parts"), c["hits"].alias("hits"), begin.alias("begin"))

    def spans(c: Column) -> Column:
        return F.transform(c["hits"], lambda hit, i: F.struct(
            F.get(c["begin"], i).alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
            (F.get(c["begin"], i) + F.length(hit)).alias("end"), F.lit(kind).alias("kind"), F.lit(wide).alias("wide"),
            hit.alias("value"), F.substring(F.get(c["parts"], i), -24, 24).alias("left"),
            F.substring(F.get(c["parts"], i + 1), 1, 4).alias("right")))

    return _let(_let(cut, place), spans)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substr(digits, n + 1 - i, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + worth(i))
    return F.when(n > 0, total % 10 == 0).otherwise(False)


def _valid(kind: str, value: Column) -> Column:
    """Whether a match of a kind passes its check."""
    digits = _digits(value)
    n = F.length(digits)
    if kind == "card":
        return _let(digits, lambda d: F.when((F.length(d) >= 14) & (F.length(d) <= 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(
            (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (p.try_cast("decimal(38,0)") <= 255), F.lit(False)))
    return F.lit(True)


def _found(text: Column, patterns: dict[str, str]) -> Column:
    """All matches of the patterns, valid or not."""
    wide = patterns is WIDE
    empty = F.filter(_matches(F.lit(""), BASE["ip"], "ip", False), lambda s: F.lit(False))
    return F.concat(*[F.coalesce(F.when(_needs(text, k, wide), _matches(text, patterns[k], k, wide)), empty) for k in KINDS])


def base_of(found: Column) -> Column:
    """The valid ones of the matches of the base patterns, by start and then kind."""
    def valid(s: Column) -> Column:
        checks = F.lit(False)
        for i, k in enumerate(KINDS):
            checks = F.when(s["rank"] == i, _valid(k, s["value"])).otherwise(checks)
        return checks

    return F.array_sort(F.filter(found, valid))


def base_spans(text: Column) -> Column:
    """The valid matches of the base patterns, by start and then kind."""
    return base_of(_found(text, BASE))


def _overlap(spans: Column, s: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def _plain(s: Column) -> Column:
    """The value in the form that the base patterns know, so that a spelling gives no proposal away."""
    at = F.regexp_replace(s["value"], r"(?i)\x20?[\[(]at[\])]\x20?|\x20at\x20", "@")
    email = F.regexp_replace(at, r"(?i)\x20?[\[(]dot[\])]\x20?|\x20dot\x20", ".")
    ip = F.translate(F.regexp_replace(s["value"], "[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}", "00"), ":", ".")
    return (F.when(s["wide"] & (s["rank"] == KINDS.index("email")), email)
            .when(s["wide"] & (s["rank"] == KINDS.index("ip")), ip).otherwise(s["value"]))


def _passes(s: Column) -> Column:
    """Whether a proposal passes the check of its kind in its plain form."""
    checks = F.lit(False)
    for i, k in enumerate(KINDS):
        checks = F.when(s["rank"] == i, _valid(k, _plain(s))).otherwise(checks)
    return checks


def _glued(s: Column) -> Column:
    joined = r"[\p{L}0-9_=/]"
    return F.substring(s["left"], -1, 1).rlike(joined).cast("int") + F.substring(s["right"], 1, 1).rlike(joined).cast("int")


def _prose(s: Column) -> Column:
    """Whether an address is a word, "at" and a host name, as in "look at host.org"."""
    return (s["wide"] & (s["rank"] == KINDS.index("email"))
            & ~s["value"].rlike(r"(?i)[\[(]at[\])]|[\[(]dot[\])]|\x20dot\x20"))


def _label(s: Column, passes: Column, overlaps: Column) -> Column:
    """1 for personal data, 0 for what is none, null if the base patterns can't tell.

    A match that passes its check and overlaps a base span is personal data. None is what overlaps no base span and fails
    its check, is part of a longer token, or stands in a code or order context or in prose without any other cue. All
    other proposals are what the trees are to judge, so nothing is learned from them.
    """
    cue = {n: s["left"].rlike(p) for n, p in CUES.items()}
    odd = ((cue["code"] & ~(cue["contact"] | cue["money"] | cue["network"])) | (_glued(s) > 0) | (_prose(s) & ~cue["contact"]))
    return F.when(overlaps, F.when(passes, 1.0)).when(~passes | odd, 0.0)


def _features(s: Column) -> list[Column]:
    """Numbers with few values each: what the span looks like and which words stand before it."""
    value = _plain(s)
    digits = _digits(value)
    least = lambda c, most: F.least(c, F.lit(most)).cast("int")
    runs = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    return [s["rank"], least(F.length(digits), 24),
            least(F.length(F.regexp_replace(value, r"[^A-Za-z]", "")) / 4, 10), least(F.length(value) / 4, 12),
            least(F.size(runs), 8), least(F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)), 20),
            least(F.length(F.regexp_replace(value, r"[^.]", "")), 4), least(F.length(F.regexp_replace(value, r"[^ ()\-]", "")), 6),
            _passes(s).cast("int"), _glued(s), _prose(s).cast("int"), *[s["left"].rlike(p).cast("int") for p in CUES.values()]]


@dataclass(frozen=True)
class Trees:
    """``rows`` bounds the different feature rows to learn from (weighted by how often each occurs), not those kept aside."""

    rows: int = 20_000
    trees: int = 10
    depth: int = 3
    precision: float = 0.98
    seed: int = 3
    model: GBTClassificationModel | None = field(default=None, repr=False)
    threshold: float = 1.0


def fit_trees(docs: DataFrame, text: str = "text", how: Trees = Trees()) -> Trees:
    """Learn from the proposals of all documents that base spans, checks and contexts settle (see ``_label``).

    Equal feature rows are counted together. A quarter of them is kept aside to find the least threshold with the wanted
    precision. Without both classes nothing is learned and nothing will be added.
    """
    body = text_or_empty(text)
    spans = (docs.select(body.alias("_t")).filter(_may_hold(F.col("_t")))
             .select(_found(F.col("_t"), BASE).alias("_f"), _found(F.col("_t"), WIDE).alias("_w"))
             .select(base_of(F.col("_f")).alias("_b"), F.concat("_f", "_w").alias("_p"))
             .select("_b", F.explode("_p").alias("s")))
    named = [c.alias(n) for c, n in zip(_features(F.col("s")), FEATURES)]
    label = _label(F.col("s"), F.col("valid") == 1, F.col("_over"))
    rows = (spans.select("s", *named, _overlap(F.col("_b"), F.col("s")).alias("_over"))
            .select(*FEATURES, label.alias("label")).filter(F.col("label").isNotNull()))
    counted = rows.groupBy(*FEATURES, "label").agg(F.count("*").cast("double").alias("weight"))
    counted = landed(counted, "spans")
    classes = {r["label"]: r["n"] for r in counted.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if min(classes.get(0.0, 0), classes.get(1.0, 0)) < 4:
        return Trees(how.rows, how.trees, how.depth, how.precision, how.seed)
    aside = F.pmod(F.xxhash64(*FEATURES, F.lit(how.seed)), F.lit(4)) == 0
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    most = counted.filter(~aside).orderBy(F.desc("weight"), F.xxhash64(*FEATURES)).limit(how.rows)
    learn = vectors.transform(landed(most, "learn").coalesce(2))
    if learn.select("label").distinct().count() < 2:
        return Trees(how.rows, how.trees, how.depth, how.precision, how.seed)
    model = GBTClassifier(maxIter=how.trees, maxDepth=how.depth, weightCol="weight", seed=how.seed).fit(learn)
    score = tree_score(model, {n: F.col(n) for n in FEATURES})
    table = (counted.filter(aside).groupBy(F.floor(score * 200).cast("int").alias("bin"))
             .agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("good")).orderBy(F.desc("bin")).collect())
    threshold, n, good = 1.0, 0.0, 0.0
    for r in table:
        n, good = n + r["n"], good + r["good"]
        if good >= how.precision * n and r["bin"] >= 100:
            threshold = r["bin"] / 200
    return Trees(how.rows, how.trees, how.depth, how.precision, how.seed, model, threshold)


def tree_score(model: GBTClassificationModel, features: dict[str, Column]) -> Column:
    """The model's probability as an expression: a tree is a nest of conditions."""
    names = list(features)

    def walk(node) -> Column:
        if node.numDescendants() == 0:
            return F.lit(float(node.prediction()))
        split = node.split()
        return F.when(features[names[split.featureIndex()]] <= split.threshold(), walk(node.leftChild())).otherwise(walk(node.rightChild()))

    trees = [w * walk(t._java_obj.rootNode()) for w, t in zip(model.treeWeights, model.trees)]
    margin = reduce(lambda a, b: a + b, trees)
    return 1 / (1 + F.exp(-2 * margin))


def find_pii(docs: DataFrame, text: str = "text", trees: Trees | None = None) -> DataFrame:
    """Add ``base`` and ``spans``, arrays of (start, rank, end, kind), to every row.

    ``spans`` holds the base spans and the wide proposals that the trees accept and that overlap no base span; accepted
    proposals may overlap each other. Other matches of the base patterns failed their check. Places are code points, ends are exclusive. Null and empty texts have none.
    Repeated rows are searched each. Columns named base or spans are replaced. ``trees`` are learned from the rows
    themselves if not given.
    """
    trees = trees or fit_trees(docs, text)
    own = [c for c in docs.columns if c not in ("base", "spans")]
    short = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    if trees.model is None:
        rows = docs.select(*own, F.transform(base_spans(text_or_empty(text)), short).alias("base"))
        return rows.withColumn("spans", F.col("base"))

    def accepted(s: Column) -> Column:
        features = F.struct(*[c.alias(n) for c, n in zip(_features(s), FEATURES)])
        return _let(features, lambda f: tree_score(trees.model, {n: f[n] for n in FEATURES})) >= trees.threshold

    body = text_or_empty(text)
    found, wide = fresh("_found", own), fresh("_wide", own)
    rows = (docs.select(*own, _found(body, BASE).alias(found), F.when(_may_hold(body), _found(body, WIDE)).alias(wide))
            .select(*own, F.transform(base_of(F.col(found)), short).alias("base"), F.col(wide)))
    free = F.filter(F.col(wide), lambda s: ~_overlap(F.col("base"), s))
    more = F.transform(F.filter(free, accepted), short)
    spans = F.coalesce(F.array_sort(F.array_distinct(F.concat(F.col("base"), more))), F.col("base"))
    return rows.select(*own, "base", spans.alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", trees: Trees | None = None) -> DataFrame:
    """Replace every span by its kind in angle brackets; overlapping spans become one, named by the first."""
    found = find_pii(docs.select(F.struct(*docs.columns).alias("_row")), f"_row.{text}", trees)
    body = F.col(f"_row.{text}")
    # State: how far the text is copied, and the pieces so far. A span that starts before that point only extends it.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substr(body, s["at"] + 1, x["start"] - s["at"])
        mark = F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        apart = x["start"] >= s["at"]
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"),
                        F.when(apart, F.concat(s["out"], F.array(gap, mark))).otherwise(s["out"]).alias("out"))

    clean = F.aggregate("spans", start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(body, s["at"] + 1, F.length(body))))
    row = F.col("_row").withField(text, F.when(F.size("spans") > 0, clean).otherwise(body))
    return found.select(row.alias("_row")).select("_row.*")
