"""Catalogues of thousands of rules: an inverted index from grams of required literals to rules.

A plan with every rule as a literal grows with the catalogue, and so does the work for a line. Here a rule stands in the
index under one gram of each of its literals. A pass over the lines looks for all grams of the index at once; lines
meet rules by an equi-join on the grams they hold, and a pattern runs on those pairs only. Rules without a telling literal
go the way of small catalogues.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve.operators.matching import TELLING, existence_pattern, java_dialect, java_pattern, match_lines, required_literals
from keysieve.operators.skew import lookup_join
from keysieve.sources.rules import Rule

# Lengths of grams in bytes: a literal is cut to the longest that fits. Eight bytes fill a long.
GRAMS = (8, 5, TELLING)
_BITS = 22


def _code(gram: str) -> int:
    return int.from_bytes(gram.encode("ascii"), "big")


def gram_index(rules: Sequence[Rule]) -> tuple[dict[int, list[int]], list[Rule]]:
    """The grams of every rule that has telling literals, by rule id, and the rules that have none.

    Of each literal the gram is taken that the fewest literals of the catalogue share, the first of several.
    """
    literals = {rule.id: required_literals(java_dialect(rule.regex)) for rule in rules}
    plain = [rule for rule in rules if not literals[rule.id] or min(map(len, literals[rule.id])) < TELLING]
    for rule in plain:
        del literals[rule.id]

    def grams(literal: str) -> list[str]:
        n = next(n for n in GRAMS if len(literal) >= n)
        return [literal[i:i + n] for i in range(len(literal) - n + 1)]

    shared = Counter(g for texts in literals.values() for t in texts for g in set(grams(t)))
    return {i: sorted({_code(min(grams(t), key=lambda g: shared[g])) for t in texts}) for i, texts in literals.items()}, plain


class _Finder:
    """Which of the known grams a block of bytes holds, and where."""

    def __init__(self, codes: Sequence[int]):
        self.sets = []
        for n in GRAMS:
            low = 1 << 8 * (n - 1)
            known = np.array(sorted(c for c in codes if low <= c < low << 8), dtype=np.uint64)
            table = np.zeros(1 << _BITS, dtype=bool)
            table[self._slot(known)] = True
            self.sets.append((n, known, table))

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)

    def find(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places, codes = [], []
        for n, known, table in self.sets:
            if not len(known) or len(block) < n:
                continue
            size = len(block) - n + 1
            code = np.zeros(size, dtype=np.uint64)
            for k in range(n):
                code = (code << np.uint64(8)) | block[k:k + size]
            at = np.flatnonzero(table[self._slot(code)])
            code = code[at]
            spot = np.minimum(np.searchsorted(known, code), len(known) - 1)
            fits = known[spot] == code
            places.append(at[fits])
            codes.append(code[fits])
        return (np.concatenate(places), np.concatenate(codes)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _folded(text: str) -> str:
    """Lower case, with the letters that only a caseless match equates with an ASCII one written as that one."""
    text = text.lower()
    return text if text.isascii() else text.replace("i̇", "i").replace("ı", "i").replace("ſ", "s")


def with_grams(lines: DataFrame, codes: Sequence[int], text: str, name: str = "_grams") -> DataFrame:
    """The lines that hold a gram of the index, with the grams they hold, each once."""
    schema = T.StructType([*lines.schema, T.StructField(name, T.ArrayType(T.LongType()))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(codes)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for first in range(0, len(texts), 2000):
                # Lines are put behind one another with a byte between them that no literal holds.
                parts = [b"" if t is None else _folded(t).encode() for t in texts[first:first + 2000]]
                ends = np.cumsum([len(p) + 1 for p in parts])
                places, found = finder.find(np.frombuffer(b"\0".join(parts), dtype=np.uint8))
                rows = np.searchsorted(ends, places, side="right")
                pairs = np.unique(np.stack([rows.astype(np.uint64), found]), axis=1)
                held, starts = np.unique(pairs[0], return_index=True)
                if not len(held):
                    continue
                grams = pa.ListArray.from_arrays(pa.array(np.append(starts, pairs.shape[1]).astype(np.int32)),
                                                 pa.array(pairs[1].astype(np.int64)))
                kept = batch.take(pa.array(held.astype(np.int64) + first))
                yield pa.RecordBatch.from_arrays([*kept.columns, grams], names=schema.names)

    return lines.mapInArrow(look, schema)


def match_many(lines: DataFrame, rules: Sequence[Rule], text: str = "match_text") -> DataFrame:
    """Lines x rules on a regex match, adding ``rule_id`` and ``match_end``: one row for every rule that matches a line.

    Gives what ``match_lines(..., every_rule=True)`` gives. The index has a row for every literal of the catalogue; it is
    broadcast if it is proven to be small, and otherwise shuffled with the lines it may match, a common gram in parts.
    """
    grams, plain = gram_index(rules)
    found = match_lines(lines, plain, text, every_rule=True) if plain else None
    if grams:
        wanted = {rule.id: rule for rule in rules if rule.id in grams}
        rows = [(code, i, java_pattern(java_dialect(wanted[i].regex)), java_pattern(existence_pattern(java_dialect(wanted[i].regex))), codes)
                for i, codes in grams.items() for code in codes]
        index = lines.sparkSession.createDataFrame(
            rows, "_gram long, rule_id int, _pattern string, _exists string, _codes array<long>")
        codes = sorted({row[0] for row in rows})
        held = with_grams(lines, codes, text).withColumn("_gram", F.explode("_grams"))
        pairs = lookup_join(held, index, "_gram", F.xxhash64(text), how="inner")
        # A rule with several literals is met once: by the least of its grams on the line. Behind one another, lines of the
        # same rule run a pattern that is compiled once.
        once = pairs.filter(F.col("_gram") == F.array_min(F.array_intersect("_grams", "_codes"))).sortWithinPartitions("rule_id")
        matched = once.filter(F.rlike(F.col(text), F.col("_exists"))).withColumn("match_end", _last_end(F.col(text), F.col("_pattern")))
        indexed = matched.select(*lines.columns, "match_end", "rule_id")
        found = indexed if found is None else found.select(*indexed.columns).unionByName(indexed)
    return found.select(*lines.columns, "match_end", "rule_id")


def _last_end(text: Column, pattern: Column) -> Column:
    return F.length(text) - F.length(F.element_at(F.split(text, pattern, -1), -1))


def best_rules(matches: DataFrame, line: Sequence[str]) -> DataFrame:
    """One rule for every line, which the columns ``line`` tell apart: the one whose last match ends last, then the highest id."""
    rest = [c for c in matches.columns if c not in (*line, "match_end", "rule_id")]
    best = F.max(F.struct("match_end", "rule_id", *rest)).alias("_best")
    return matches.groupBy(*line).agg(best).select(*line, *[f"_best.{c}" for c in rest], "_best.rule_id")
