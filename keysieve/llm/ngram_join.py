"""Near-duplicate texts: a MinHash LSH forest over word n-grams proposes, exact Jaccard similarity decides.

Equal texts are one class from the start. Every other text has one run of MinHash values in each tree; a tree is its runs
in order, where the texts under a node of the trie are neighbours. Range partitions may cut it anywhere, so no node has to
fit one task. Matches begin at the longest prefix and are shortened, bucket by bucket: to the length with which a pair at
the very threshold meets in some tree with the target recall, and from there on while the bucket may still lose more links
than allowed, counted by the texts that share its longest prefix. A pair may thus be missed, with the odds of
``Forest.missed``. Candidates that hang together are compared exactly, all with all, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.llm.common import landed, split_words, text_or_empty
from keysieve.llm.components import connected_components

_WORDS: dict[str, int] = {}
_WORDS_KEPT = 300_000


@dataclass(frozen=True)
class Forest:
    """``lost`` bounds the links a text in a crowded bucket is expected to lose, ``rows`` the part of a tree in one task."""

    words: int = 5
    threshold: float = 0.8
    trees: int = 24
    longest: int = 8
    recall: float = 0.9999
    lost: float = 0.001
    rows: int = 250_000
    block: int = 512
    seed: int = 11

    def missed(self, depth: int) -> float:
        """The odds that a pair at the threshold shares a prefix of this length in no tree."""
        return (1 - self.threshold ** depth) ** self.trees

    def depth(self) -> int:
        """The longest prefix with which a pair at the threshold meets in some tree with probability ``recall``."""
        return next((d for d in range(self.longest, 1, -1) if 1 - self.missed(d) >= self.recall), 1)

    def depths(self, others: np.ndarray) -> np.ndarray:
        """How far the prefix of a bucket is shortened, given the number of other texts with its longest prefix.

        A link meets at the longest prefix of a tree with probability threshold ** longest at least, so a text with
        ``others`` there has about others / threshold ** longest links at most.
        """
        found = np.full(len(others), self.depth())
        links = others / self.threshold ** self.longest
        for d in range(self.depth() - 1, 0, -1):
            found[links * self.missed(d + 1) > self.lost] = d
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the word n-grams; a shorter text is one n-gram, a text without words has none."""
    found = split_words(text or "")
    if not found:
        return np.empty(0, np.uint64)
    if len(_WORDS) > _WORDS_KEPT:
        _WORDS.clear()
    for w in set(found).difference(_WORDS):
        _WORDS[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    codes = np.fromiter(map(_WORDS.__getitem__, found), dtype=np.uint64, count=len(found))
    n = min(words, len(codes))
    total = np.full(len(codes) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[j:len(codes) - n + 1 + j]
    return np.unique(_mix(total))


def signature(grams: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """MinHash values; blocks of n-grams keep the work matrix small."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), 1024):
        part = grams[at:at + 1024]
        np.minimum(least, (factors[:, None] * part + terms[:, None]).min(axis=1), out=least)
    return least


def runs(texts: pd.Series, forest: Forest) -> pd.Series:
    """For each text its runs, tree after tree, 16 bits of each MinHash value; null for a text without words."""
    rng = np.random.default_rng(forest.seed)
    shape = forest.trees * forest.longest
    factors = rng.integers(0, 2 ** 63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = rng.integers(0, 2 ** 63, shape, dtype=np.uint64)
    result = []
    for text in texts:
        grams = shingles(text, forest.words)
        values = _mix(signature(grams, factors, terms)) >> np.uint64(48) if len(grams) else None
        result.append(None if values is None else values.astype(">u2").tobytes())
    return pd.Series(result, dtype=object)


MEETINGS = "a binary, b binary, tree int, depth int, prefix binary"


def trie_nodes(tree: np.ndarray, values: np.ndarray, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted runs: the length each row's prefix is shortened to, the first row under that node, and the common
    prefix of each row with the one before."""
    n = len(values)
    common = np.zeros(n, dtype=np.int64)
    if n > 1:
        differs = values[1:] != values[:-1]
        common[1:] = np.where(differs.any(1), differs.argmax(1), forest.longest)
        common[1:][tree[1:] != tree[:-1]] = 0
    leaf = np.cumsum(common < forest.longest) - 1
    wanted = forest.depths(np.bincount(leaf) - 1)[leaf]
    depth = np.full(n, forest.depth())
    for d in range(forest.depth() - 1, 0, -1):
        node = np.cumsum(common < d) - 1
        depth[np.isin(node, node[wanted <= d])] = d
    first = np.zeros(n, dtype=np.int64)
    for d in np.unique(depth):
        start = np.flatnonzero(common < d)
        at = depth == d
        first[at] = start[np.cumsum(common < d)[at] - 1]
    return depth, first, common


def meetings(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    """Scan one range of the sorted trees: an edge from each text to the first one under its shortened prefix, and for
    nodes that the range's ends may cut their first text, with ``b`` null."""
    parts = [x for x in batches if x.num_rows]
    if not parts:
        return
    rows = pa.Table.from_batches(parts).combine_chunks()
    tree, key = rows["tree"].to_numpy(), rows["key"].combine_chunks()
    values = np.frombuffer(b"".join(rows["run"].to_pylist()), ">u2").reshape(-1, forest.longest)
    depth, first, common = trie_nodes(tree, values, forest)
    at = np.flatnonzero(first != np.arange(len(first)))
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("tree", pa.int32()), ("depth", pa.int32()), ("prefix", pa.binary())])
    key = key.cast(pa.binary())
    none = [pa.nulls(len(at), t) for t in (pa.int32(), pa.int32(), pa.binary())]
    yield pa.RecordBatch.from_arrays([key.take(pa.array(at)), key.take(pa.array(first[at])), *none], schema=schema)
    cut = set()
    for edge in (0, len(first) - 1):
        for d in range(depth[edge], forest.depth() + 1):
            head = int(np.flatnonzero(common[:edge + 1] < d)[-1])
            cut.add((key[head].as_py(), int(tree[edge]), d, values[edge, :d].tobytes()))
    heads, trees, depths, prefix = zip(*sorted(cut))
    yield pa.RecordBatch.from_arrays([
        pa.array(heads, pa.binary()), pa.nulls(len(heads), pa.binary()), pa.array(trees, pa.int32()),
        pa.array(depths, pa.int32()), pa.array(prefix, pa.binary())], schema=schema)


def candidate_edges(signed: DataFrame, forest: Forest) -> DataFrame:
    """(a, b) over ``signed`` (key, runs): texts that hang together by edges are candidates of each other."""
    signed = signed.filter(F.col("runs").isNotNull())
    width = 2 * forest.longest
    rows = (signed.select("key", "runs", F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree"))
            .select("key", "tree", F.substring("runs", F.col("tree") * width + 1, F.lit(width)).alias("run")))
    parts = max(1, -(-signed.count() * forest.trees // forest.rows))
    order = ["tree", "run", "key"]
    met = landed(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                 .mapInArrow(lambda batches: meetings(batches, forest), MEETINGS), "meetings")
    # A node cut by borders of ranges has one row for each part: at most two paths of each range.
    cut = met.filter(F.col("b").isNull())
    whole = cut.groupBy("tree", "depth", "prefix").agg(F.min("a").alias("b"))
    over = cut.drop("b").join(whole, ["tree", "depth", "prefix"]).filter(F.col("a") != F.col("b")).select("a", "b")
    return met.filter(F.col("b").isNotNull()).select("a", "b").unionByName(over)


def text_key(text: str = "text") -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.unhex(F.md5(text_or_empty(text).cast("binary")))


def _linked(first: list[np.ndarray], second: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which pairs of sets have the similarity, as a matrix; inside one block if ``second`` is None."""
    sets = first + (second or [])
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = count > 1                      # an n-gram of one text alone is in no intersection
    number = np.cumsum(shared) - 1
    inside = shared[column]
    row, column = row[inside], number[column[inside]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    n, m = len(first), len(second) if second else len(first)
    common = np.zeros((n, m), dtype=np.float64)
    step = 8192
    for at in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(column, [at, at + step])
        part = np.zeros((len(sets), min(step, int(shared.sum()) - at)), dtype=np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        common += part[:n] @ (part[n:] if second else part).T
    a, b = size[:n], size[n:] if second else size
    return common >= threshold * (a[:, None] + b[None, :] - common) - 1e-9


def _verify(rows: pd.DataFrame, forest: Forest) -> pd.DataFrame:
    """Links of one pair of blocks: for each text the number of links, and the least text it hangs together with."""
    i, j = int(rows["lo"].iloc[0]), int(rows["hi"].iloc[0])
    rows = rows.sort_values(["part", "key"], kind="stable").reset_index(drop=True)
    sets = [shingles(t, forest.words) for t in rows["text"]]
    n = int((rows["part"] == i).sum())
    if i == j:
        linked = _linked(sets, None, forest.threshold)
        np.fill_diagonal(linked, False)
        whole = linked
    else:
        if n in (0, len(sets)):
            return pd.DataFrame({"key": [], "links": [], "root": []})
        linked = _linked(sets[:n], sets[n:], forest.threshold)
        whole = np.zeros((len(sets), len(sets)), dtype=bool)
        whole[:n, n:], whole[n:, :n] = linked, linked.T
    links = whole.sum(1)
    root = np.full(len(sets), -1)
    for start in range(len(sets)):
        if root[start] < 0:
            root[start] = start
            edge = [start]
            while edge:
                near = np.flatnonzero(whole[edge].any(0) & (root < 0))
                root[near] = start
                edge = list(near)
    keys = rows["key"].to_numpy()
    hit = links > 0
    return pd.DataFrame({"key": keys[hit], "links": links[hit], "root": keys[root[hit]]})


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", forest: Forest = Forest()) -> DataFrame:
    """(doc_id, key, class_id, representative, n_copies, n_links), one row for each row of ``docs``.

    ``key`` stands for the text, ``n_copies`` counts the rows that have it, ``n_links`` the other texts at or above the
    threshold. Texts linked directly or through others are one class; ``class_id`` is its least doc_id, and
    ``representative`` marks the rows that have it (several only if rows repeat both id and text). Null texts count as
    empty, all texts without words and with equal characters are copies of each other and have no links. Null ids come
    last: they name a class only if it has no other.
    """
    rows = landed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
                  .select("doc_id", text_key().alias("key"), F.pandas_udf(lambda t: runs(t, forest), "binary")("text").alias("runs")),
                  "signatures")
    classes = landed(rows.groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"), F.first("runs").alias("runs")), "classes")
    groups = landed(connected_components(candidate_edges(classes, forest)), "candidates")
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / forest.block).cast("int").alias("blocks"))
    members = (groups.join(sizes, "root").withColumnRenamed("node", "key").join(classes.drop("runs"), "key")
               .withColumn("part", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("key", text_key())
    texts = (members.join(own, (members["key"] == own["key"]) & members["first_id"].eqNullSafe(own["doc_id"]))
             .select(members["key"], "root", "blocks", "part", own["text"]).dropDuplicates(["key"]))
    pairs = (texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")))
    found = landed(pairs.select("root", "lo", "hi", "part", "key", "text").groupBy("root", "lo", "hi")
                   .applyInPandas(lambda g: _verify(g, forest), "key binary, links long, root binary"), "links")
    links = found.groupBy("key").agg(F.sum("links").alias("n_links"))
    roots = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    labelled = (classes.drop("runs").join(links, "key", "left")
                .join(roots.withColumnRenamed("node", "key"), "key", "left")
                .withColumn("root", F.coalesce("root", "key")))
    labelled = landed(labelled, "labelled")
    names = labelled.groupBy("root").agg(F.min("first_id").alias("class_id"))
    # The class with a null name is told apart by the key of its least text.
    firsts = (labelled.join(names, "root").groupBy("root", "class_id")
              .agg(F.min(F.when(F.col("first_id").eqNullSafe(F.col("class_id")), F.col("key"))).alias("first_key")))
    final = landed(labelled.join(firsts, "root").select(
        "key", "class_id", "first_key", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "final")
    return (rows.drop("runs").join(final, "key")
            .withColumn("representative", F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("first_key")))
            .select("doc_id", "key", "class_id", "representative", "n_copies", "n_links"))


def one_of_each_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", forest: Forest = Forest()) -> DataFrame:
    """The rows of ``docs`` that stand for their class, all columns kept; of rows that repeat id and text one stays."""
    own = docs.columns
    kept = (near_duplicates(docs, doc_id, text, forest).filter("representative")
            .select(F.col("doc_id").alias("_near_id"), F.col("key").alias("_near_key")).distinct())
    rows = docs.withColumn("_near_own", text_key(text))
    return (rows.join(kept, (F.col("_near_own") == F.col("_near_key")) & F.col(doc_id).eqNullSafe(F.col("_near_id")), "left_semi")
            .dropDuplicates([doc_id, "_near_own"]).select(*own))
