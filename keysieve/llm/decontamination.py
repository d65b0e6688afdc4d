"""Benchmark decontamination: rare n-grams of the test items seed candidates, Smith-Waterman alignment scores them.

Items go to the tasks in blocks of bounded size; every block is held against all documents. A first pass counts in how
many documents each n-gram of an item occurs. A document is aligned with an item if it has one of the item's rare
n-grams, or several others, so copies with edits are found and an item that leaked everywhere is, too. A copy is a large
share of an item, or a long run of its words however long the item is.

Words are runs of letters, marks, digits and underscores, so any white space and punctuation separates them, typographic or
not. Characters of scripts without spaces are words by themselves. Compatible forms and invisible characters are folded.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INVISIBLE = regex.compile(r"\p{Cf}+")
_BREAKS = regex.compile(r"[^\p{L}\p{M}\p{N}\x00-\x7F]+")
_UNSPACED = regex.compile(r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*)")
# Which bytes are part of a word once a text is folded: letters, digits, underscore and everything that is not ASCII.
_WORD = np.zeros(256, dtype=bool)
_WORD[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + [95] + list(range(128, 256))] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 1 << 20


@dataclass(frozen=True)
class Alignment:
    """Scores of the alignment and what counts as a copy: ``least`` is the share of the score of an exact copy, ``run`` the
    number of words whose exact copy has the score that is enough in an item of any length."""

    ngram: int = 3
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    least: float = 0.5
    run: int = 50
    rare_share: float = 0.5
    others: int = 2
    block_items: int = 20_000
    block_chars: int = 16_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def folded(text: str) -> str:
    """The text with ASCII characters, or spaces, between its words; a text of ASCII characters is left as it is."""
    if text.isascii():
        return text
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    # Most texts have few characters that are not ASCII, and patterns only run for those they hold.
    odd = "".join(c for c in set(text) if c > "\x7f")
    for pattern, instead in ((_INVISIBLE, ""), (_BREAKS, " "), (_UNSPACED, r" \1 ")):
        if pattern.search(odd):
            text = pattern.sub(instead, text)
    return text


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, where each text's words begin). Words are compared in lower case."""
    encoded = [folded(t).lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(encoded) + b" ", dtype=np.uint8)
    ends = np.cumsum([len(e) + 1 for e in encoded]) if encoded else np.zeros(0, dtype=np.int64)
    inside = _WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside.size and inside[0]:
        edges = np.concatenate([[0], edges])
    first, last = edges[0::2], edges[1::2]
    longest = int((last - first).max()) if len(first) else 0
    hashes = np.zeros(len(first), dtype=np.uint64)
    # Character by character over all words at once; words that have ended drop out.
    live, at = np.arange(len(first)), first
    size = last - first
    for j in range(min(longest, 24)):
        hashes[live] = (hashes[live] + data[at + j]) * _ODD
        more = size[live] > j + 1
        if not more.all():
            live, at = live[more], at[more]
    for i in live if longest > 24 else ():
        hashes[i:i + 1] += _tail(data[first[i] + 24:last[i]])
    hashes = _mixed(hashes)
    begins = np.searchsorted(first, np.concatenate([[0], ends]))
    return hashes, begins


def _tail(data: np.ndarray) -> np.ndarray:
    powers = np.cumprod(np.full(len(data), _ODD, dtype=np.uint64))
    return (data.astype(np.uint64) * powers).sum(dtype=np.uint64, keepdims=True)


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(max(len(words) - n + 1, 0), dtype=np.uint64)
    for j in range(n):
        total = total * _ODD + words[j:len(words) - n + 1 + j]
    return _mixed(total)


class Items:
    """One block of test items, ready to be looked up by n-gram. Items shorter than an n-gram have their own length."""

    def __init__(self, rows: list, how: Alignment) -> None:
        self.ids = [r[0] for r in rows]
        hashes, begins = hashed_words([r[1] or "" for r in rows])
        self.words = [hashes[a:b] for a, b in zip(begins, begins[1:])]
        self.how = how
        found = []
        for i, words in enumerate(self.words):
            n = min(how.ngram, len(words))
            if n:
                for at, g in enumerate(_grams(words, n)):
                    found.append((int(g), n, i, at))
        self.sizes = sorted({f[1] for f in found})
        gram = np.array([f[0] for f in found], dtype=np.uint64)
        self.grams, self.number = np.unique(gram, return_inverse=True) if found else (gram, np.zeros(0, dtype=int))
        self.item = np.array([f[2] for f in found], dtype=int)
        self.at = np.array([f[3] for f in found], dtype=int)
        order = np.argsort(self.number, kind="stable")
        self.item, self.at = self.item[order], self.at[order]
        self.begin = np.searchsorted(self.number[order], np.arange(len(self.grams) + 1))
        self.slots = np.zeros(_SLOTS, dtype=bool)
        self.slots[(self.grams & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
        self.rare = np.ones(len(found), dtype=bool)

    def learn(self, counts: dict[int, int]) -> None:
        """Mark the rare n-grams of each item: the rarest half by number of documents, ties included."""
        df = np.array([counts.get(i, 0) for i in range(len(self.grams))])
        number = np.repeat(np.arange(len(self.grams)), np.diff(self.begin))
        own = df[number]
        order = np.argsort(self.item, kind="stable")
        edges = np.searchsorted(self.item[order], np.arange(len(self.words) + 1))
        for i in range(len(self.words)):
            mine = order[edges[i]:edges[i + 1]]
            if len(mine):
                edge = np.sort(own[mine])[max(int(np.ceil(len(mine) * self.how.rare_share)) - 1, 0)]
                self.rare[mine] = own[mine] <= edge

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number of the n-gram) wherever an item's n-gram occurs."""
        places, numbers = [], []
        for n in self.sizes:
            grams = _grams(words, n)
            maybe = np.flatnonzero(self.slots[(grams & np.uint64(_SLOTS - 1)).astype(np.int64)])
            at = np.searchsorted(self.grams, grams[maybe])
            at[at == len(self.grams)] = 0
            real = self.grams[at] == grams[maybe]
            places.append(maybe[real])
            numbers.append(at[real])
        return (np.concatenate(places), np.concatenate(numbers)) if places else (np.zeros(0, int), np.zeros(0, int))


def _next_row(above: np.ndarray, word: np.uint64, words: np.ndarray, how: Alignment, least: int | None) -> np.ndarray:
    """The scores below ``above``; ``least`` bounds them from below where an alignment may begin anywhere."""
    slope = -how.gap * np.arange(len(above))
    cell = np.empty_like(above)
    cell[0] = above[0] + how.gap
    np.maximum(above[:-1] + np.where(words == word, how.match, how.mismatch), above[1:] + how.gap, out=cell[1:])
    if least is not None:
        np.maximum(cell, least, out=cell)
    # A run of gaps along the row costs the same per word, so a running maximum of (score + slope) finds it.
    return np.maximum.accumulate(cell + slope) - slope


def align(item: np.ndarray, words: np.ndarray, how: Alignment) -> tuple[float, int, int]:
    """(share of the score of an exact copy, begin, end in ``words``) of the best local alignment.

    Two rows are in memory, whatever the lengths: the first pass finds where the best alignment ends, a second one runs
    back from there. Of equally good ones the first end in the item counts, then in the words, then the shortest.
    """
    m, n = len(item), len(words)
    if not m or not n:
        return 0.0, 0, 0
    best, last, end = 0, 0, 0
    row = np.zeros(n + 1, dtype=np.int64)
    for i in range(m):
        row = _next_row(row, item[i], words, how, 0)
        j = int(row.argmax())
        if row[j] > best:
            best, last, end = int(row[j]), i + 1, j
    if not best:
        return 0.0, 0, 0
    # Matches pay for the gaps of an alignment, which bounds how far it reaches back.
    back = words[max(end - last - last * how.match // -how.gap, 0):end][::-1]
    row = how.gap * np.arange(len(back) + 1, dtype=np.int64)
    for i in range(last - 1, -1, -1):
        row = _next_row(row, item[i], back, how, None)
        j = int(row.argmax())
        if row[j] == best:
            return best / (how.match * m), end - j, end
    raise AssertionError("the best alignment is found again from its end")


def _candidates(items: Items, place: np.ndarray, number: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(item, where it would begin in the text for each hit) of the items worth an alignment."""
    count = items.begin[number + 1] - items.begin[number]
    rows = np.repeat(items.begin[number], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    item, starts, rare = items.item[rows], np.repeat(place, count) - items.at[rows], items.rare[rows]
    order = np.argsort(item, kind="stable")
    item, starts, rare = item[order], starts[order], rare[order]
    edges = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]])) if len(item) else np.zeros(1, int)
    for a, b in zip(edges, edges[1:]):
        if rare[a:b].any() or b - a >= items.how.others:
            yield int(item[a]), np.sort(starts[a:b])


def find_copies(items: Items, words: np.ndarray, place: np.ndarray, number: np.ndarray) -> list[tuple]:
    """(item id, score, begin, end) of each item that the text copies; of several copies of an item the best."""
    found = []
    for i, starts in _candidates(items, place, number):
        size = len(items.words[i])
        slack = size // 2 + 2
        best = (0.0, 0, 0)
        for group in np.split(starts, np.flatnonzero(np.diff(starts) > 2 * slack) + 1):
            lo, hi = max(int(group[0]) - slack, 0), int(group[-1]) + size + slack
            score, begin, end = align(items.words[i], words[lo:hi], items.how)
            if score > best[0]:
                best = (score, lo + begin, lo + end)
        if best[0] >= items.how.least or best[0] * size >= items.how.run:
            found.append((items.ids[i], *best))
    return found


def _per_text(items: Items, texts: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, its words, places, numbers) for every text with a hit; texts are hashed in runs of some megabytes."""
    texts = ["" if t is None else t for t in texts]
    run, chars, start = [], 0, 0
    for k, t in enumerate([*texts, None]):
        if t is None or (run and chars + len(t) > 8_000_000):
            words, begins = hashed_words(run)
            place, number = items.hits(words)
            if len(place):
                text = np.searchsorted(begins, place, side="right") - 1
                order = np.argsort(text, kind="stable")
                place, number, text = place[order], number[order], text[order]
                edges = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1], [True]]))
                for a, b in zip(edges, edges[1:]):
                    lo, hi = begins[text[a]], begins[text[a] + 1]
                    yield start + int(text[a]), words[lo:hi], place[a:b] - lo, number[a:b]
            run, chars, start = [], 0, k
        if t is not None:
            run.append(t)
            chars += len(t)


def item_blocks(benchmark: DataFrame, item_id: str, text: str, how: Alignment) -> Iterator[list]:
    """The items in blocks that are safe to send to every task."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct()
    total = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(-(-total[0] // how.block_items), -(-total[1] // how.block_chars), 0)
    for b in range(blocks):
        yield items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()


def document_counts(docs: DataFrame, text: str, items: Items) -> dict[int, int]:
    """In how many documents each n-gram of the block occurs, over all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(items.grams), dtype=np.int64)
        for batch in batches:
            for _, _, _, number in _per_text(items, batch.iloc[:, 0]):
                total[np.unique(number)] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "docs": total[at]})

    rows = docs.select(text).mapInPandas(count, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))
    return {r["gram"]: r["docs"] for r in rows.collect()}


def _copies_column(items: Items, text: str, kind: str) -> Column:
    def copies(texts: pd.Series) -> pd.Series:
        result: list[list] = [[] for _ in texts]
        for k, words, place, number in _per_text(items, texts):
            result[k] = [{"item_id": i, "score": s, "begin": a, "end": e} for i, s, a, e in find_copies(items, words, place, number)]
        return pd.Series(result, dtype=object)

    return F.pandas_udf(copies, f"array<struct<item_id:{kind},score:double,begin:long,end:long>>")(text)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", how: Alignment = Alignment(), name: str = "copies") -> DataFrame:
    """Add the array ``name`` of (item_id, score, begin, end) to every row: which items it copies, from word to word.

    Null and empty texts and items copy nothing. A repeated item row counts once, a repeated document row each time.
    Items shorter than ``ngram`` words must occur whole to be looked at. Without items the arrays are empty. Very long
    texts and items are aligned in memory that grows with their lengths, not with the product.
    """
    kind = dict(benchmark.dtypes)[item_id]
    own = [c for c in docs.columns if c != name]
    result = docs.select(*own).withColumn(name, F.expr(f"cast(array() as array<struct<item_id:{kind},score:double,begin:long,end:long>>)"))
    for rows in item_blocks(benchmark, item_id, item_text, how):
        items = Items(rows, how)
        if len(items.grams):
            items.learn(document_counts(docs, text, items))
            result = result.withColumn(name, F.concat(F.col(name), _copies_column(items, text, kind)))
    return result


def decontaminate(docs: DataFrame, benchmark: DataFrame, how: Alignment = Alignment(), text: str = "text") -> DataFrame:
    """The rows that copy no test item, all columns kept."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    marked = contamination(rows, benchmark, text=f"_row.{text}", how=how, name="_copies")
    return marked.filter(F.size("_copies") == 0).select("_row.*")
