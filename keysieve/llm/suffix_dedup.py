"""Removal of repeated byte strings by maximal repeats from an enhanced suffix array.

A string of ``length`` bytes that occurs twice has the same anchor in both places: an anchor is a position whose
``gram``-byte hash is the least in some window of the string. So only the suffixes at anchors are sorted, and only with
as many bytes around them as such a string can reach. Suffixes with the same gram meet; where they are many, they part
again by longer strings. In each meeting group the suffixes are sorted, a stack scan over their common prefixes finds the
intervals, and the bytes to the left of an interval's suffixes (where they differ, the repeat can't grow) decide how far
it reaches: each interval is a repeat with all its occurrences, not only neighbours.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.llm.common import landed


@dataclass(frozen=True)
class Repeats:
    """``length`` bytes make a repeat. ``group`` suffixes at most are sorted together."""

    length: int = 200
    gram: int = 32
    group: int = 10_000

    def __post_init__(self) -> None:
        if not self.gram <= self.length < 4096:
            raise ValueError("gram must be at most length, and length below 4096")


_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any strings of a run of bytes from sums of the bytes times powers of an odd number."""

    _powers = np.ones(1, dtype=np.uint64)
    _undo = np.ones(1, dtype=np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        if len(Hashes._powers) <= len(data):
            n = max(len(data) + 1, 2 * len(Hashes._powers))
            Hashes._powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]), dtype=np.uint64)
            Hashes._undo = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _UNDO)]), dtype=np.uint64)
        table = _mix(np.arange(1, 257, dtype=np.uint64))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(table[data] * Hashes._powers[:len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * Hashes._undo[begin])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every window: minima from the left and right ends of blocks as long as the window."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchors(data: np.ndarray, hashes: Hashes, how: Repeats) -> tuple[np.ndarray, ...]:
    """(place, first start, last start, gram hash): every string of ``length`` bytes belongs to the place of the least
    gram in it (the leftmost of equal ones); the strings of a place start from ``first`` to ``last``."""
    empty = np.zeros(0, np.int64)
    if len(data) < how.length:
        return empty, empty, empty, np.zeros(0, np.uint64)
    at = np.arange(len(data) - how.gram + 1)
    values = hashes.of(at, at + how.gram)
    least = _least(values, how.length - how.gram + 1)
    begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    end = np.append(begin[1:], len(least)) - 1
    wanted = least[begin]
    # Places by value, then position; a run of strings with one least value takes the first place from its start on.
    ranks = np.unique(wanted)
    rank = np.minimum(np.searchsorted(ranks, values), len(ranks) - 1)
    places = np.flatnonzero(ranks[rank] == values)
    key = np.sort(rank[places] * len(data) + places)
    run = np.searchsorted(ranks, wanted)
    found = []
    while len(begin):
        place = key[np.searchsorted(key, run * len(data) + begin)] - run * len(data)
        found.append((place, begin, np.minimum(end, place), ranks[run]))
        more = end > place                      # later strings of the run have an equal gram further right
        begin, end, run = place[more] + 1, end[more], run[more]
    return tuple(np.concatenate(x) for x in zip(*found))


def _positions(texts: pd.Series, how: Repeats) -> Iterator[tuple[int, tuple[np.ndarray, ...], np.ndarray]]:
    """(row, anchors, hash of the bytes within reach of each) of every text that is long enough."""
    for row, text in enumerate(texts):
        if text is None or 4 * len(text) < how.length:
            continue
        data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        if len(data) >= how.length:
            hashes = Hashes(data)
            found = anchors(data, hashes, how)
            place, first, last, _ = found
            context = hashes.of(first, last + how.length)
            shape = ((place - first) * how.length + (place - last)).astype(np.uint64)
            yield row, found, _mix(context + shape * _BASE)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n            # a[:low] is common, a[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def repeat_intervals(right: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(common prefix, members) of every interval of the enhanced suffix array of ``right``, by a stack scan."""
    order = sorted(range(len(right)), key=right.__getitem__)
    prefix = [_common(right[a], right[b]) for a, b in zip(order, order[1:])] + [-1]
    stack: list[tuple[int, int]] = []       # (common prefix, first suffix) of the open intervals, growing
    for i, value in enumerate(prefix):
        first = i
        while stack and stack[-1][0] > value:
            depth, first = stack.pop()
            yield depth, order[first:i + 1]
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def covered(left: list[bytes], right: list[bytes], length: int) -> list[set[tuple[int, int]]]:
    """For each suffix how far to the left and right of its anchor a repeat of ``length`` bytes or more reaches.

    ``left`` are the bytes before the anchors, reversed. Within an interval the suffixes are sorted by them: where two
    neighbours in that order part, the repeat is left-maximal.
    """
    reach: list[set[tuple[int, int]]] = [set() for _ in left]
    rank = np.empty(len(left), dtype=np.int64)
    rank[sorted(range(len(left)), key=left.__getitem__)] = np.arange(len(left))
    for depth, members in repeat_intervals(right):
        if depth + max(len(left[m]) for m in members) < length:
            continue
        members = sorted(members, key=rank.__getitem__)
        for a, b in zip(members, members[1:]):
            before = _common(left[a], left[b])
            if before + depth >= length:
                reach[a].add((before, depth))
                reach[b].add((before, depth))
    return reach


def _resolved(batches: Iterator[pd.DataFrame], how: Repeats) -> Iterator[pd.DataFrame]:
    """Covered spans from rows that come group by group; a group may go on in the next batch."""
    rest = None
    for batch in chain(batches, [None]):
        if batch is not None and rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        last = batch is None
        rows = rest if last else batch
        if rows is None or not len(rows):
            continue
        keys = rows["key"].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        if not last:
            rest = rows.iloc[edges[-1]:]
            rows = rows.iloc[:edges[-1]]
            edges = edges[:-1]
        if not len(rows):
            continue
        context, lead = rows["context"].tolist(), rows["lead"].tolist()
        right = [bytes(c[n:]) for c, n in zip(context, lead)]
        left = [bytes(c[:n][::-1]) for c, n in zip(context, lead)]
        index, begin, end = [], [], []
        place = rows["place"].tolist()
        for a, b in zip(edges, np.append(edges[1:], len(rows))):
            for i, reach in enumerate(covered(left[a:b], right[a:b], how.length), a):
                for before, after in reach:
                    index.append(i)
                    begin.append(place[i] - before)
                    end.append(place[i] + after)
        found = rows.iloc[index][["doc_id", "body"]]
        yield found.assign(begin=np.array(begin, dtype=np.int64), end=np.array(end, dtype=np.int64))


def _settle(spark: SparkSession) -> None:
    """Let the driver collect its garbage: the shuffles of finished steps are removed with the plans that made them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", how: Repeats = Repeats()) -> DataFrame:
    """(doc_id, body, spans): for each text with repeats the covered byte ranges (begin, end), unmerged.

    ``body`` is a hash of the text and tells rows with the same id apart; rows that repeat id and text share their spans.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[doc_id]
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("body", F.xxhash64("text"))

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                found = [f[3] for _, f, _ in _positions(batch["text"].iloc[at:at + 1000], how)]
                if found:
                    gram, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pd.DataFrame({"gram": gram.view(np.int64), "n": n})

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at:at + 1000]
                found = list(_positions(part["text"], how))
                if not found:
                    continue
                place, first, last, gram = (np.concatenate([f[1][i] for f in found]) for i in range(4))
                rows = np.repeat([f[0] for f in found], [len(f[2]) for f in found])
                yield pd.DataFrame({
                    "gram": gram.view(np.int64), "context": np.concatenate([f[2] for f in found]).view(np.int64),
                    "doc_id": part["doc_id"].to_numpy()[rows], "body": part["body"].to_numpy()[rows],
                    # Place, and how many bytes before it the strings of the anchor start at most and at least.
                    "at": place << 24 | (place - first) << 12 | (place - last)})

    # Grams that occur once are in no repeat.
    twice = own.select("text").mapInPandas(grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    twice = landed(twice.filter("n > 1").select("gram"), "grams")
    schema = f"gram long, context long, doc_id {kind}, body long, at long"
    found = landed(own.select("doc_id", "body", "text").mapInPandas(places, schema).join(twice, "gram"), "places")
    _settle(spark)
    # Anchors whose whole reach occurs again are settled; of each such class one goes on as a partner for others.
    classes = landed(found.groupBy("gram", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "body", "at")).alias("one")), "contexts")
    place, before, least = F.shiftright("at", 24), F.shiftright("at", 12).bitwiseAND(F.lit(4095)), F.col("at").bitwiseAND(F.lit(4095))
    whole = (found.join(classes.filter("n > 1").select("gram", "context"), ["gram", "context"])
             .select("doc_id", "body", (place - before).alias("begin"), (place - least + how.length).alias("end")))
    settled = landed(whole.groupBy("doc_id", "body").agg(F.collect_set(F.struct("begin", "end")).alias("spans")), "spans")
    groups = classes.groupBy("gram").agg(F.count("*").alias("size")).filter("size > 1")
    open_ = (classes.join(groups, "gram").select("gram", "size", "one.*")
             .groupBy("doc_id", "body").agg(F.collect_list(F.struct("gram", "size", "at")).alias("anchors")))
    raw = F.encode(F.col("text"), "UTF-8")
    joined = own.join(landed(open_, "open").withColumnsRenamed({"doc_id": "_id", "body": "_body"}),
                      F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("body").eqNullSafe(F.col("_body")))
    place, before, least = (lambda x: F.shiftright(x["at"], 24)), (lambda x: F.shiftright(x["at"], 12).bitwiseAND(F.lit(4095))), (lambda x: x["at"].bitwiseAND(F.lit(4095)))
    cut = F.transform("anchors", lambda x: F.struct(
        x["gram"].alias("key"), x["size"].alias("size"), place(x).alias("place"), before(x).cast("int").alias("lead"),
        F.substring(raw, (place(x) - before(x) + 1).cast("int"), (before(x) - least(x) + how.length).cast("int")).alias("context")))
    rows = landed(joined.select("doc_id", "body", F.explode(cut).alias("x")).select("doc_id", "body", "x.*")
                  .withColumn("low", F.lit(0)).withColumn("high", F.lit(how.length - how.gram)), "reach")
    _settle(spark)
    parts = [_in_groups(rows.filter(F.col("size") <= how.group), how, kind)]
    parts += _divided(rows.filter(F.col("size") > how.group), how, kind)
    spans = parts[0]
    for part in parts[1:]:
        spans = spans.unionByName(part)
    more = landed(spans.groupBy("doc_id", "body").agg(F.collect_set(F.struct("begin", "end")).alias("spans")), "spans")
    _settle(spark)
    return settled.unionByName(more).groupBy("doc_id", "body").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _in_groups(rows: DataFrame, how: Repeats, kind: str) -> DataFrame:
    """Spans of groups of bounded size: the suffixes of a group come one after the other in a task."""
    rows = rows.select("key", "doc_id", "body", "place", "lead", "context")
    rows = rows.dropDuplicates(["key", "doc_id", "body", "place"])
    return (rows.repartition("key").sortWithinPartitions("key", "doc_id", "body", "place")
            .mapInPandas(lambda b: _resolved(b, how), f"doc_id {kind}, body long, begin long, end long"))


def _divided(rows: DataFrame, how: Repeats, kind: str) -> list[DataFrame]:
    """Spans of large groups. The strings of a group start from ``low`` to ``high`` bytes before the anchor, so all of
    them have the bytes between in common. Halving the range makes that common part longer and the groups smaller, until
    they are of bounded size or the range is one string; then all in the group have that very string."""
    parts = []
    rows = rows.dropDuplicates(["key", "doc_id", "body", "place"]).drop("size")
    while not rows.isEmpty():
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("low").alias("a"), middle.alias("b")),
                                   F.struct((middle + 1).alias("a"), F.col("high").alias("b")))).alias("_h")
        # A row stays in a half if it has strings that start there.
        rows = (rows.select("*", halves).withColumn("low", F.col("_h.a")).withColumn("high", F.col("_h.b")).drop("_h")
                .filter((F.col("low") <= F.col("lead")) & (F.col("high") >= F.col("lead") - (F.length("context") - how.length))))
        core = F.substring(F.col("context"), F.col("lead") - F.col("low") + 1, how.length - (F.col("high") - F.col("low")))
        rows = landed(rows.withColumn("key", F.xxhash64("key", "low", "high", core)), "halves")
        sizes = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        rows = landed(rows.join(sizes, "key"), "sized")
        single = F.col("low") == F.col("high")
        parts.append(rows.filter(single).select("doc_id", "body", (F.col("place") - F.col("low")).alias("begin"),
                                                (F.col("place") - F.col("low") + how.length).alias("end")))
        parts.append(_in_groups(rows.filter(~single & (F.col("size") <= how.group)), how, kind))
        rows = rows.filter(~single & (F.col("size") > how.group)).drop("size")
    return parts


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlap; spans that touch are one."""
    result: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if result and begin <= result[-1][1]:
            result[-1] = (result[-1][0], max(end, result[-1][1]))
        else:
            result.append((begin, end))
    return result


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", how: Repeats = Repeats()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, removed, kept), one row for each row of ``docs``.

    ``removed`` are the byte ranges covered by a string of ``length`` bytes that starts anywhere else, too, in this or
    another row, and ``kept`` the other bytes. Null and empty texts have none of either; rows that repeat are removed but
    for nothing, as each occurs elsewhere. An empty table gives an empty table.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("body", F.xxhash64("text"))
    spans = repeated_spans(docs, doc_id, text, how).withColumnsRenamed({"doc_id": "_id", "body": "_body"})
    rows = own.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("body").eqNullSafe(F.col("_body")), "left")

    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        result = []
        for t, found in zip(texts, spans):
            data = (t or "").encode("utf-8")
            gone = merged([(s["begin"], s["end"]) for s in found]) if found is not None and len(found) else []
            edges = [0, *(x for s in gone for x in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[0::2], edges[1::2]))
            result.append((len(data), len(data) - len(kept), len(gone), [{"begin": a, "end": b} for a, b in gone], kept))
        return pd.DataFrame(result, columns=["n_bytes", "n_removed", "n_spans", "removed", "kept"])

    kind = "n_bytes long, n_removed long, n_spans long, removed array<struct<begin:long,end:long>>, kept binary"
    return rows.select("doc_id", F.pandas_udf(cut, kind)("text", "spans").alias("r")).select("doc_id", "r.*")
