"""Best-fit packing of tokenized documents by a grouping genetic algorithm.

How well a packing does depends on the lengths only. So an individual is a list of bin patterns (which lengths share a
sequence) with multiplicities, and its size depends on the capacity, not on the number of documents: at most some
thousands of patterns stand for any number of sequences. Islands evolve as tasks of their own and pass their elites on.
The documents get their places afterwards by their rank among those of the same length.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keysieve.llm.common import landed

_ENCODERS: dict[tuple, _Encoder] = {}
Genome = list[tuple[int, dict[int, int]]]   # (multiplicity, {length: how many of it in the sequence})


class _Encoder:
    """Byte-pair encoding of whole texts, in one call each.

    A token of the vocabulary that was added to the merged ones is cut out of the text first and has its own id.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int]) -> None:
        self.added = {text: np.array([i], dtype="<u4").tobytes() for text, i in added.items()}
        longest_first = sorted(map(re.escape, added), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(longest_first) + ")") if added else None
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def merged(self, text: str) -> bytes:
        return np.array(self.plain.encode_ordinary(text), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.cut is None or not any(token in text for token in self.added):
            return self.merged(text)
        return b"".join(self.added[part] if part in self.added else self.merged(part) for part in self.cut.split(text) if part)


def _encoder(ranks_path: str, pattern: str, added: dict[str, int]) -> _Encoder:
    key = (ranks_path, pattern, tuple(sorted(added.items())))
    if key not in _ENCODERS:
        _ENCODERS[key] = _Encoder(ranks_path, pattern, added)
    return _ENCODERS[key]


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """The texts and ids of the tokens that a tokenizer file adds to its merged ones."""
    with open(tokenizer_path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def tokenized_pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, end_id: int = 2,
                     doc_id: str = "doc_id", text: str = "text", added: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids): every document's tokens with ``end_id`` after them.

    Documents longer than ``capacity`` are cut into pieces of that length, the first one takes what is left over. ``ids``
    are little-endian unsigned 32-bit numbers. Null and empty texts are the end id alone. ``ranks_path`` is a vocabulary
    of byte-pair ranks that every executor has, ``pattern`` the one that cuts a text before merging, ``added`` the tokens with
    an id of their own wherever they stand in a text (see ``added_tokens``).
    """
    kind = dict(docs.dtypes)[doc_id]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(ranks_path, pattern, added or {})
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at:at + 500]
                rows = []
                for name, body in zip(part.iloc[:, 0], part.iloc[:, 1]):
                    ids = encoder.encode("" if body is None else body) + end
                    n = len(ids) // 4
                    edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    rows += [(name, k, a, b - a, ids[4 * a:4 * b]) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"]).astype({"doc_id": part.dtypes.iloc[0]})

    return docs.select(doc_id, text).mapInPandas(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


# ---- the genetic algorithm, on lengths


def pack_lengths(left: np.ndarray, capacity: int, rng: np.random.Generator | None = None) -> Genome:
    """Fill sequence after sequence: the longest that fits, unless one or two lengths fill the room exactly.

    Equal sequences are made in one go. ``rng`` picks among the exact pairs; without it the most unequal one is taken.
    """
    left = left.copy()
    genome: Genome = []
    while left.any():
        spare = left.copy()
        pattern: dict[int, int] = {}
        room = capacity
        while room:
            fits = np.flatnonzero(spare[:room + 1])
            if not len(fits):
                break
            take = [int(fits[-1])]
            if pattern and take[0] != room:
                pairs = fits[spare[room - fits] > (room == 2 * fits)]
                if len(pairs):
                    first = int(pairs[-1] if rng is None else rng.choice(pairs))
                    take = [first, room - first]
            for size in take:
                k = 1 if len(take) > 1 else int(min(spare[size], room // size)) if not pattern and rng is None else 1
                pattern[size] = pattern.get(size, 0) + k
                spare[size] -= k
                room -= k * size
        times = int(min(left[s] // k for s, k in pattern.items()))
        genome.append((times, pattern))
        for s, k in pattern.items():
            left[s] -= times * k
    return genome


def filled(pattern: dict[int, int]) -> int:
    return sum(s * k for s, k in pattern.items())


def fitness(genome: Genome, capacity: int) -> tuple[int, float]:
    """Fewer sequences first; among as many, fuller full ones and emptier empty ones."""
    return (-sum(m for m, _ in genome), sum(m * (filled(p) / capacity) ** 2 for m, p in genome))


def _merged(genome: Genome) -> Genome:
    same: dict[tuple, int] = {}
    for m, p in genome:
        key = tuple(sorted(p.items()))
        same[key] = same.get(key, 0) + m
    return [(m, dict(key)) for key, m in same.items() if m]


def _take(left: np.ndarray, bins: Genome) -> Genome:
    """The bins as far as their documents are still there; a bin with a document that is used up goes whole."""
    kept = []
    for m, p in bins:
        times = min(m, *(int(left[s]) // k for s, k in p.items()))
        if times > 0:
            kept.append((times, p))
            for s, k in p.items():
                left[s] -= times * k
    return kept


def _best_fit(left: np.ndarray, bins: Genome, capacity: int) -> Genome:
    """Put displaced documents, longest first, where the least room stays."""
    bins = list(bins)
    room = np.array([capacity - filled(p) for _, p in bins], dtype=np.int64)
    for size in np.flatnonzero(left)[::-1]:
        size = int(size)
        while left[size]:
            where = np.flatnonzero(room >= size)
            if not len(where):
                break
            at = int(where[room[where].argmin()])
            m, p = bins[at]
            times = int(min(left[size], m))
            bins.append((times, {**p, size: p.get(size, 0) + 1}))
            room = np.append(room, room[at] - size)
            bins[at] = (m - times, p)
            if m == times:
                room[at] = -1
            left[size] -= times
    return [b for b in bins if b[0]]


def crossover(counts: np.ndarray, mother: Genome, father: Genome, capacity: int, rng: np.random.Generator) -> Genome:
    """Whole well-filled sequences of the father go into the mother; what they displace is fitted in again."""
    left = counts.copy()
    good = sorted((b for b in father if rng.random() < 0.5), key=lambda b: -filled(b[1]))
    good = good[:max(len(good) * 2 // 3, 1)]
    child = _take(left, good)
    child += _take(left, sorted(mother, key=lambda b: -filled(b[1])))
    child = _best_fit(left, child, capacity)
    return _merged(child + pack_lengths(left, capacity, rng))


def mutated(counts: np.ndarray, genome: Genome, capacity: int, rng: np.random.Generator) -> Genome:
    """Take the emptiest sequences and some others apart and pack their documents anew."""
    order = sorted(genome, key=lambda b: filled(b[1]) + rng.integers(0, capacity // 16 + 1))
    left = counts.copy()
    kept = _take(left, order[max(len(order) // 8, 2):])
    return _merged(kept + pack_lengths(left, capacity, rng))


def evolve(counts: np.ndarray, population: list[Genome], capacity: int, steps: int, seed: int) -> list[Genome]:
    """Some generations of one island, the best first. Each child takes the place of the worst if it is better."""
    rng = np.random.default_rng(seed)
    least = -(-int((np.arange(len(counts)) * counts).sum()) // capacity)
    population = [(fitness(g, capacity), g) for g in population]
    for _ in range(steps):
        population.sort(key=lambda x: x[0], reverse=True)
        if -population[0][0][0] <= least:
            break
        a, b = sorted(rng.choice(len(population), 2, replace=False)) if len(population) > 1 else (0, 0)
        child = crossover(counts, population[a][1], population[b][1], capacity, rng)
        if rng.random() < 0.5:
            child = mutated(counts, child, capacity, rng)
        score = fitness(child, capacity)
        if score > population[-1][0] and all(score != s for s, _ in population):
            population[-1] = (score, child)
    population.sort(key=lambda x: x[0], reverse=True)
    return [g for _, g in population]


@dataclass(frozen=True)
class Islands:
    islands: int = 4
    population: int = 6
    rounds: int = 2
    steps: int = 12
    seed: int = 5


def _store(genome: Genome) -> str:
    return json.dumps([[m, sorted(p.items())] for m, p in genome])


def _load(text: str) -> Genome:
    return [(m, {s: k for s, k in p}) for m, p in json.loads(text)]


def best_packing(spark: SparkSession, counts: np.ndarray, capacity: int, how: Islands = Islands()) -> Genome:
    """The best genome for ``counts[length]`` documents of each length, from islands that run as tasks.

    After each round the elite of an island goes to the next one too. ``counts`` has capacity + 1 entries.
    """
    start = pack_lengths(counts, capacity)
    least = -(-int((np.arange(len(counts)) * counts).sum()) // capacity)
    if sum(m for m, _ in start) <= least:
        return start
    own = "island long, place long, genome string"

    def run(number: int):
        def live(rows: pd.DataFrame) -> pd.DataFrame:
            island = int(rows["island"].iloc[0])
            seed = how.seed * 1_000_003 + number * 1009 + island
            if number:
                people = [_load(g) for g in dict.fromkeys(rows.sort_values("place", kind="stable")["genome"])]
            else:
                people = [start] + [pack_lengths(counts, capacity, np.random.default_rng(seed * 97 + k)) for k in range(how.population - 1)]
            people = evolve(counts, people, capacity, how.steps, seed)[:how.population]
            return pd.DataFrame({"island": island, "place": range(len(people)), "genome": [_store(g) for g in people]})
        return live

    state = spark.range(how.islands).select(F.col("id").alias("island"), F.lit(0).cast("long").alias("place"), F.lit("").alias("genome"))
    for number in range(how.rounds):
        elites = state.filter(F.col("place") == 0).withColumn("island", (F.col("island") + 1) % how.islands)
        meeting = state.unionByName(elites) if number else state
        state = landed(meeting.repartition(how.islands, "island").groupBy("island").applyInPandas(run(number), own), "islands")
    elites = [_load(r["genome"]) for r in state.filter(F.col("place") == 0).orderBy("island").collect()]
    return max([start, *elites], key=lambda g: fitness(g, capacity))


# ---- places for the documents


def place_pieces(pieces: DataFrame, capacity: int = 1024, how: Islands = Islands(), group: int = 4000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with doc_id, piece, start and length (1 to capacity).

    Rows are ranked among those of the same length, in groups of about ``group`` rows by a hash, so a frequent length
    doesn't meet in one task. The rank says which copy of which pattern a row belongs to. Repeated rows get places of
    their own. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    pieces = landed(pieces, "pieces")
    table = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in table.items():
        counts[length] = n
    groups = max(1, -(-int(counts.max()) // group))
    own = pieces.columns
    keyed = pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    ranked = keyed.withColumn("_i", F.row_number().over(W.partitionBy("length", "_g").orderBy("doc_id", "piece", "start")) - 1)
    sizes = keyed.groupBy("length", "_g").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_g").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select("length", "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    ranked = ranked.join(shifts, ["length", "_g"]).withColumn("_rank", F.col("_i") + F.col("_shift")).select(*own, "_rank")

    # One segment per pattern and length: the ranks from ``begin`` on, ``per`` of them in each copy of the pattern.
    genome = best_packing(spark, counts, capacity, how) if counts.any() else []
    segments, used, sequence = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for times, pattern in sorted(genome, key=lambda b: sorted(b[1].items(), reverse=True), reverse=True):
        at = 0
        for size, per in sorted(pattern.items(), reverse=True):
            segments.append((size, used[size], per, sequence, at))
            used[size] += times * per
            at += size * per
        sequence += times
    segments.sort()
    size, begin, per, first, at = (np.array(c, dtype=np.int64) for c in (zip(*segments) if segments else [[]] * 5))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = size << np.int64(44) | begin
        for batch in batches:
            rank, length = batch["_rank"].to_numpy(np.int64), batch["length"].to_numpy(np.int64)
            s = np.searchsorted(key, length << np.int64(44) | rank, side="right") - 1
            copy, slot = np.divmod(rank - begin[s], per[s])
            yield batch.drop(columns="_rank").assign(sequence_id=first[s] + copy, offset=at[s] + slot * length)

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInPandas(placed, schema)


def packed_sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the sequences themselves, from placed pieces that carry ``ids``."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    joined = F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
