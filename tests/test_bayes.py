"""Naive Bayes and signed feature hashing against plain Python."""

import hashlib
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from keysieve.operators import bayes


def test_naive_bayes_against_python(spark):
    rows = [(1, "Pass word one", True), (2, "word word é2", False), (3, "", True), (4, None, False), (5, "unseen", None), (6, "pass é2", True)]
    frame = spark.createDataFrame(rows, "id long, snippet string, leak boolean")
    model = bayes.fit_naive_bayes(frame, F.col("leak"))
    counts = {c: Counter(w for _, t, k in rows if k is c and t for w in t.lower().split()) for c in (True, False)}
    vocabulary = set(counts[True]) | set(counts[False])
    score = lambda w: sum(s * math.log((counts[c][w] + 1) / (counts[c].total() + len(vocabulary) + 1)) for c, s in ((True, 1), (False, -1)))
    prior = math.log((3 + 1) / (2 + 1))
    got = {r["id"]: r["log_odds"] for r in bayes.log_odds(frame, model).collect()}
    for i, text, _ in rows:
        assert math.isclose(got[i], prior + sum(score(w) for w in (text or "").lower().split() if w in vocabulary))
    flagged = bayes.bayes_model(model).predict(frame, "snippet", "fp").collect()
    assert {r["id"] for r in flagged if r["fp"]} == {i for i, v in got.items() if v < 0} and flagged[0].__fields__ == ["id", "snippet", "leak", "fp"]
    nothing = bayes.fit_naive_bayes(frame.limit(0), F.col("leak"))
    assert {r["log_odds"] for r in bayes.log_odds(frame, nothing).collect()} == {0.0}


def test_signed_hashing_against_python(spark):
    texts = ["password = 'a'", "ab", "", None, "ÉÉÉÉ 𝒳𝒳", "aaaa"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, snippet string")
    for row in bayes.signed_encoder(16)(frame).collect():
        text = (row.snippet or "").replace("'", '"').lower()
        vector = np.zeros(16)
        for i in range(len(text) - 2):
            digest = hashlib.md5(text[i:i + 3].encode()).hexdigest()
            vector[int(digest[:8], 16) % 16] += 1 if digest[8] < "8" else -1
        norm = np.linalg.norm(vector)
        assert np.allclose(row.embedding, vector / norm if norm else vector)


def test_signed_hashing_takes_each_digest_of_a_batch_once(spark):
    frame = spark.createDataFrame([(1, "x" * 500), (2, None)], "id long, snippet string")
    encoded = bayes.signed_encoder(128)(frame)
    assert "ArrowEvalPython" in encoded._jdf.queryExecution().executedPlan().toString()   # not 128 passes over the grams of a text
    one = {r.id: [x for x in r.embedding if x] for r in encoded.collect()}
    assert [abs(x) for x in one[1]] == [1.0] and one[2] == []
