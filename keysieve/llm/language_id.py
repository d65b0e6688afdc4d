"""Language of words and documents: a linear-chain conditional random field, decoded by forward-backward.

Every word is a place in a chain, the languages are its labels. Scores of a word come from hashed affixes, character
n-grams and the word itself (the lexicon); transitions say how easily a text changes language. The document gets the
language with the largest share of its letters, by the probabilities of its words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
_KEPT = 300_000


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text in lower case. A run of other word characters only, such as fractions or Roman numeral
    signs, is no word."""
    return [w for w in LETTERS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


@dataclass
class Field:
    """The model and how it is learned. ``rows`` (for each language) and ``chars`` bound the rows to learn from."""

    rows: int = 150
    chars: int = 20_000
    buckets: int = 1 << 17
    orders: tuple[int, ...] = (2, 3, 4, 5)
    steps: int = 30
    rate: float = 0.3
    penalty: float = 1e-4
    switch: float = 0.3
    seed: int = 13
    languages: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default=None, repr=False)
    transitions: np.ndarray = field(default=None, repr=False)

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bucket of every feature of every word, where each word's features begin).

        The features are the byte n-grams of the word between boundary marks, so those at the marks are its affixes, and
        the whole word.
        """
        encoded = [b"<" + w.encode("utf-8") + b">" for w in words]
        size = np.array([len(e) for e in encoded], dtype=np.int64)
        data = np.frombuffer(b"".join(encoded), dtype=np.uint8).astype(np.uint64)
        ends = np.cumsum(size)
        word = np.repeat(np.arange(len(words)), size)
        left = np.repeat(ends, size) - np.arange(len(data))      # bytes from here to the end of the word
        buckets, owner = [], []
        code = np.zeros(len(data), dtype=np.uint64)
        for n in range(1, max(self.orders) + 1):
            code[:len(data) - n + 1] = (code[:len(data) - n + 1] + data[n - 1:]) * np.uint64(0x9E3779B97F4A7C15)
            if n in self.orders:
                at = np.flatnonzero(left >= n)
                buckets.append(self._bucket(code[at], n))
                owner.append(word[at])
        begin = ends - size
        powers = np.cumprod(np.full(int(size.max()) if len(size) else 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
        place = np.arange(len(data)) - np.repeat(begin, size)
        whole = np.add.reduceat(data * powers[place], begin) if len(words) else data
        buckets.append(self._bucket(whole, 0))
        owner.append(np.arange(len(words)))
        buckets, owner = np.concatenate(buckets), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return buckets[order], np.searchsorted(owner[order], np.arange(len(words)))

    def _bucket(self, code: np.ndarray, n: int) -> np.ndarray:
        code = (code ^ np.uint64(n * 0x1F3D5B79)) * np.uint64(0xD6E8FEB86659FD93)
        return ((code ^ (code >> np.uint64(32))) % np.uint64(self.buckets)).astype(np.int64)

    def scores(self, words: list[str]) -> np.ndarray:
        """The score of every language for every word."""
        total = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        for at in range(0, len(words), 20_000):
            part = words[at:at + 20_000]
            bucket, begin = self.features(part)
            total[at:at + len(part)] = np.add.reduceat(self.weights[bucket], begin, axis=0)
        return total


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, segment: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word, and the expected transitions, of chains that lie one after the other.

    Chains are cut into segments that run side by side. The product of a segment's steps carries messages over it, so a
    chain of n words needs about n / segment + segment steps, and the result is that of one pass along the whole chain.
    """
    words, k = scores.shape
    move = np.exp(transitions - transitions.max())
    pieces = -(-lengths // segment)
    first = np.cumsum(pieces) - pieces
    n = int(pieces.sum())
    offset = np.arange(words) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at, seg = offset % segment, np.repeat(first, lengths) + offset // segment
    local, real = np.ones((segment, n, k)), np.zeros((segment, n), dtype=bool)
    local[at, seg] = np.exp(scores - scores.max(axis=1, keepdims=True))
    real[at, seg] = True
    over = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for t in range(1, segment):
        step = (over.reshape(n * k, k) @ move).reshape(n, k, k) * local[t][:, None, :]
        over = np.where(real[t][:, None, None], step, over)
        if t % 8 == 0:
            over /= over.max(axis=(1, 2), keepdims=True)

    def even(x: np.ndarray) -> np.ndarray:
        return x / x.sum(axis=-1, keepdims=True)

    # Messages between segments, for all chains at once; the chains with most segments come first.
    order = np.argsort(-pieces, kind="stable")
    begin, many = first[order], pieces[order]
    live = [int((many > s).sum()) for s in range(int(many[0]) + 1)] if len(many) else [0]
    enter, ends, leave, out = np.empty((n, k)), np.empty((n, k)), np.ones((n, k)), None
    pairs = np.zeros((k, k))
    for s in range(len(live) - 1):
        idx = begin[:live[s]] + s
        enter[idx] = even(local[0, idx] if s == 0 else (out[:live[s]] @ move) * local[0, idx])
        out = ends[idx] = even(np.einsum("ni,nij->nj", enter[idx], over[idx]))
    back = None
    for s in range(len(live) - 2, -1, -1):
        idx, more = begin[:live[s]] + s, live[s + 1]
        if more:
            coming = local[0, idx[:more] + 1] * back[:more]
            leave[idx[:more]] = even(coming @ move.T)
            state = ends[idx[:more]]
            pairs += move * (state.T @ (coming / ((state @ move) * coming).sum(1, keepdims=True)))
        back = even(np.einsum("nij,nj->ni", over[idx], leave[idx]))
    chance = np.empty_like(local)
    chance[0] = enter
    for t in range(1, segment):
        chance[t] = even((chance[t - 1] @ move) * local[t])
    beta = leave
    for t in range(segment - 2, -1, -1):
        coming = local[t + 1] * beta
        total = ((chance[t] @ move) * coming).sum(1, keepdims=True)
        rows = real[t + 1]
        pairs += move * (chance[t][rows].T @ (coming[rows] / total[rows]))
        chance[t + 1] *= beta
        beta = np.where(rows[:, None], even(coming @ move.T), beta)
    chance[0] *= beta
    return even(chance[at, seg]), pairs


def fit_field(texts: list[tuple[str, str]], model: Field | None = None) -> Field:
    """Learn from (language, text). Chains join lines of the texts, now and then of another language, so that the
    transitions see texts that switch."""
    model = model or Field()
    rng = np.random.default_rng(model.seed)
    model.languages = sorted({lang for lang, _ in texts})
    labels = {lang: i for i, lang in enumerate(model.languages)}
    lines = [[] for _ in model.languages]
    for lang, text in texts:
        for line in text.split("\n"):
            words = words_of(line)
            if words:
                lines[labels[lang]].append(words)
    model.languages = [lang for lang in model.languages if lines[labels[lang]]]
    lines = [group for group in lines if group]
    k = len(model.languages)
    model.weights, model.transitions = np.zeros((model.buckets, max(k, 1)), dtype=np.float32), np.zeros((k, k))
    if k < 2:
        return model
    known: dict[str, int] = {}
    chains, truths = [], []
    for lang in range(k):
        order = rng.permutation(len(lines[lang]))
        for at in range(0, len(order), 6):
            words, truth = [], []
            for i in order[at:at + 6]:
                other = int(rng.integers(k)) if rng.random() < model.switch else lang
                line = lines[lang][i] if other == lang else lines[other][int(rng.integers(len(lines[other])))]
                words += line
                truth += [other] * len(line)
            chains.append(np.array([known.setdefault(w, len(known)) for w in words]))
            truths.append(np.array(truth))
    codes, truth, lengths = np.concatenate(chains), np.concatenate(truths), np.array([len(c) for c in chains])
    seen = np.zeros((k, k))
    inside = np.ones(len(codes) - 1, dtype=bool)
    inside[np.cumsum(lengths)[:-1] - 1] = False
    np.add.at(seen, (truth[:-1][inside], truth[1:][inside]), 1)
    bucket, begin = model.features(list(known))
    owner = np.repeat(np.arange(len(known)), np.diff(np.append(begin, len(bucket))))
    total = len(codes)
    squares, move_squares = np.full(model.weights.shape, 1e-8), np.full((k, k), 1e-8)
    for _ in range(model.steps):
        scores = np.add.reduceat(model.weights[bucket], begin, axis=0)
        chance, pairs = forward_backward(scores[codes].astype(np.float64), lengths, model.transitions)
        off = -chance
        off[np.arange(total), truth] += 1
        for label in range(k):
            step = np.bincount(codes, weights=off[:, label], minlength=len(known))
            g = np.bincount(bucket, weights=step[owner], minlength=model.buckets) / total - model.penalty * model.weights[:, label]
            squares[:, label] += g * g
            model.weights[:, label] += model.rate * g / np.sqrt(squares[:, label])
        move = seen - pairs
        move = move / total - model.penalty * model.transitions
        move_squares += move * move
        model.transitions += model.rate * move / np.sqrt(move_squares)
    return model


def learning_rows(docs: DataFrame, learn: Column, text: str, lang: str, doc_id: str, model: Field) -> list[tuple[str, str]]:
    """A bounded sample of labelled texts: at most ``rows`` of each language, the first by a hash of id and text.

    Texts of more than ``chars`` characters are cut into pieces of that length, each a text of its own. Equal pieces of equal
    ids count once, null ids and texts like others (a null text is no text). Every learned language has at least one row.
    """
    size = F.lit(model.chars)
    at = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int"))
    rows = (docs.filter(learn & F.col(lang).isNotNull() & (F.length(text) > 0))
            .select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("id"))
            .select("lang", "text", "id", F.explode(at).alias("at"))
            .select("lang", F.when(F.col("at") == 0, F.substring("text", 1, model.chars))
                    .otherwise(F.substring("text", F.col("at") * size + 1, size)).alias("text"),
                    F.xxhash64("id", "text", "at", F.lit(model.seed)).alias("h")))
    # A share of the hashes that holds enough of each language is found first, so that few texts are sorted out.
    distinct = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not distinct:
        return []
    span = 2 ** 63
    below = F.lit(None).cast("long")
    for name, n in distinct.items():
        below = F.when(F.col("lang") == name, F.lit(int(-span + 2 * span * min(1.0, (2 * model.rows + 100) / max(n, 1))) - 1)).otherwise(below)
    near = rows.filter(F.col("h") <= below).groupBy("lang", "h").agg(F.min("text").alias("text"))
    found = near.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "text"))), 1, model.rows).alias("rows")).collect()
    return sorted((r["lang"], x["text"]) for r in found for x in r["rows"])


_MEMORY: dict[str, object] = {"model": None, "words": {}, "scores": None}


def _labelled(model: Field, token: str, texts: pd.Series) -> pd.DataFrame:
    """Language, score and runs of each text. Scores of words are kept between batches of the same model."""
    if _MEMORY["model"] != token or len(_MEMORY["words"]) > _KEPT:
        _MEMORY.update(model=token, words={}, scores=np.zeros((0, len(model.languages)), dtype=np.float32))
    known = _MEMORY["words"]
    words = [words_of(t) for t in texts]
    new = sorted(set().union(*words).difference(known))
    known.update(zip(new, range(len(known), len(known) + len(new))))
    if new:
        _MEMORY["scores"] = np.vstack([_MEMORY["scores"], model.scores(new)])
    size = np.array([len(w) for w in words], dtype=np.int64)
    lang, score, runs = [UNKNOWN] * len(words), [0.0] * len(words), [[] for _ in words]
    some = np.flatnonzero(size)
    if not len(some):
        return pd.DataFrame({"lang": lang, "score": score, "runs": runs})
    codes = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(size.sum()))
    every, _ = forward_backward(_MEMORY["scores"][codes].astype(np.float64), size[some], model.transitions)
    ends = np.cumsum(size[some])
    for i, end in zip(some, ends):
        chance = every[end - size[i]:end]
        weight = np.fromiter(map(len, words[i]), dtype=np.float64, count=len(words[i]))
        share = weight @ chance / weight.sum()
        best = int(share.argmax())
        lang[i], score[i] = model.languages[best], float(min(share[best], 1.0))
        label = chance.argmax(1)
        edges = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1], [True]]))
        runs[i] = [{"lang": model.languages[label[a]], "words": int(b - a)} for a, b in zip(edges, edges[1:])]
    return pd.DataFrame({"lang": lang, "score": score, "runs": runs})


def identify(docs: DataFrame, model: Field, text: str = "text", name: str = "language") -> DataFrame:
    """Add the struct ``name`` (lang, score, runs) to every row; runs are the languages of its words in order.

    Words are the runs of letters. A text that is null or has no letter, and any text if no language was learned, is
    "und" with score 0. With one learned language everything else has it. Repeated rows are labelled each, an empty table
    stays empty, an input column called ``name`` is replaced.
    """
    token = f"{id(model)}-{model.languages}-{float(np.abs(model.weights).sum()) if model.weights is not None else 0}"

    def label(texts: pd.Series) -> pd.DataFrame:
        if not model.languages:
            return pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": 0.0, "runs": [[] for _ in texts]})
        parts = [_labelled(model, token, texts.iloc[a:a + 1000]) for a in range(0, len(texts), 1000)]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang": [], "score": [], "runs": []})

    own = [c for c in docs.columns if c != name]
    kind = "lang string, score double, runs array<struct<lang:string,words:int>>"
    return docs.select(*own, F.pandas_udf(label, kind)(text).alias(name))
