"""Whitening, conversation repair and sharding, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keysieve.llm import bidiagonal, conversation_repair, sharding, whitening
from keysieve.llm.common import landed

# ---- conversation repair


def cheapest(rows):
    """(cost, audit, repaired rows) by trying all states layer by layer; rows are (role, text, fault)."""
    best = {0: (0, "", ())}

    def inserted(states):
        for _ in range(3):
            for q, (c, s, out) in list(states.items()):
                r = (2, 2, 3, 2)[q]
                new = (c + 5, s + "I", out + (("user" if r == 2 else "assistant") + ":",))
                if r not in states or new[:2] < states[r][:2]:
                    states[r] = new
        return states

    for role, text, fault in rows:
        best, after = inserted(dict(best)), {}
        for q, (c, s, out) in best.items():
            moves = [(2, "D", q, ())]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                r = (2, 2, 3, 2)[q]
                moves.append((1 + more, "R", r, (("user" if r == 2 else "assistant") + ":" + text,)))
                kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], q))
                if kept:
                    moves.append((more, "K", kept, (role + ":" + text,)))
            for cost, letter, r, add in moves:
                new = (c + cost, s + letter, out + add)
                if r not in after or new[:2] < after[r][:2]:
                    after[r] = new
        best = after
    return min((v for q, v in inserted(best).items() if q in (0, 3)), key=lambda v: v[:2])


def judged(rows):
    """The digest of a conversation's damaged rows [(turn, role, text)]."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, out = cheapest([(r, x, f) for (_, r, x), f in zip(rows, faults)])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if x is None else x for x in (conv, turn, role, text))
        draw = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * {0: 0, 3: 2}.get(draw, 1)
    return out


def test_repair_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randint(0, 12)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "umpire"])
            text = rng.choice(["Hi.", "No", "", None, " \n", "Yes!", f"x{rng.randint(0, 99)}?", "é…", "Hi. \x0b"])
            rows += [(conv, rng.choice([turn, turn, turn * 3, None]), role, text)] * rng.choice([1, 1, 1, 3])
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    expected = {}
    for conv, turn, role, text in damaged(rows):
        expected.setdefault(conv, []).append((turn, role, text))
    expected = {c: judged(expected.get(c, [])) for c in {r[0] for r in rows}}
    for block in (128, 3, 1):
        monkeypatch.setattr(conversation_repair, "BLOCK_ROWS", block)
        got = conversation_repair.repair(conversation_repair.damage(table), table.select("conv_id"))
        assert {r[0]: tuple(r[1:]) for r in got.collect()} == expected


@pytest.mark.parametrize("pattern", ["", "D", "UA", "SUA", "uaUAxSDa", "AAAUUU", "SSS", "XxX", "DDUA", "ASUAD", "sUAuU"])
def test_auction_prices_and_strings(pattern):
    table = conversation_repair.options(pattern)
    whole = min((c[0] + end, c[1] + add) for c, (end, add) in zip(table[0], conversation_repair.ENDINGS) if c)
    kinds = {"U": "user", "A": "assistant", "S": "system", "X": "tool"}
    rows = [("tool", "", "blank") if p == "D" else (kinds[p.upper()], "t", "truncated" if p.islower() else None) for p in pattern]
    assert whole == cheapest(rows)[:2]


def test_auction_prices_are_dual():
    rng = random.Random(8)
    for _ in range(40):
        pattern = "".join(rng.choice("SUAXsuaxD") for _ in range(rng.randint(1, 9)))
        for goal in range(4):
            price = conversation_repair.auction(pattern, goal)
            for (layer, state), p in price.items():
                ahead = [c + price.get((n, q), conversation_repair.INF) for _, c, n, q in conversation_repair._arcs(pattern, layer, state)]
                assert p >= conversation_repair.INF or (layer == len(pattern) and state == goal) or p == min(ahead)


def test_repaired_rows_and_empty_tables(spark):
    schema = "conv_id string, turn int, role string, text string, conv string"
    table = spark.createDataFrame([("a", 0, "assistant", "Hello.", "z"), ("a", 1, "user", "Yes.", "z")], schema)
    rows = conversation_repair.repaired_rows(conversation_repair.with_spaces(table)).orderBy("place").collect()
    assert [(r["edit"], r["role"], r["text"]) for r in rows] == [("R", "user", "Hello."), ("R", "assistant", "Yes.")]
    nothing = spark.createDataFrame([], schema)
    assert conversation_repair.repair(conversation_repair.damage(nothing), nothing.select("conv_id")).count() == 0
    zero = conversation_repair.repair(conversation_repair.damage(nothing), table.select("conv_id")).collect()
    assert [tuple(r) for r in zero] == [("a", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"Line {i}.") for i in range(3000)]
    rows += [(1, 5000, "user", "Again and again.")] * 4000 + [(1, 6000 + i, "user", "Same.") for i in range(500)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = conversation_repair.repair(conversation_repair.with_spaces(table)).collect()
    assert tuple(got[1:]) == judged([r[1:] for r in rows])


# ---- whitening


def brute_whitening(vectors):
    x = np.floor(64 * np.array(vectors, dtype=float)).astype(np.int64) + 1_000_000
    n = len(x)
    dev = n * x - x.sum(axis=0)
    c = dev / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return c, e[::-1], v[:, ::-1], [(sum(int(a) ** 2 for a in row)) for row in dev]


def test_whitening_against_eigenvectors(spark):
    rng = np.random.default_rng(1)
    base = (rng.normal(size=(400, 9)) * np.logspace(0, -1, 9)).tolist()
    bad = [None, base[0][:8] + [None], base[1][:8] + [float("nan")], base[1][:8] + [float("inf")], [1.0], []]
    rows = [(i, v, "x") for i, v in enumerate(base + base[:50] + bad)] + [(None, base[3], None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string").repartition(7)
    table = landed(table)
    model = whitening.fit(table, components=6)
    got = whitening.whiten(table, model).collect()
    kept = base + base[:50] + [base[3]]
    c, e, v, deviation = brute_whitening(kept)
    assert len(got) == len(kept) == model.n and model.identity_error < 1e-9
    assert np.allclose(model.explained, (e / e.sum())[:6], rtol=1e-9)
    by_id = {r["vec_id"]: r for r in got}
    y = c @ v[:, :6] / np.sqrt(e[:6])
    signs = np.sign(y[0] * np.array(by_id[0]["whitened"]))
    for i, (want, dev) in enumerate(zip(y, deviation)):
        row = by_id[i if i < 450 else None]
        assert np.allclose(np.array(row["whitened"]) * signs, want, atol=1e-9) and int(row["deviation"]) == dev


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])]):
        table = spark.createDataFrame(rows, schema)
        model = whitening.fit(table)
        assert model.n == 0 and whitening.whiten(table, model).count() == 0
    table = spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], schema)
    model = whitening.fit(table)
    assert model.n == 2 and [(int(r["deviation"]), r["whitened"]) for r in whitening.whiten(table, model).collect()] == [(0, [])] * 2
    table = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, -5.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(table, whitening.fit(table)).count() == 3


@pytest.mark.parametrize("kind", ["random", "graded", "repeated", "rank", "blocks", "identity", "zero", "one"])
def test_singular_vectors(kind):
    rng = np.random.default_rng(5)
    q = [np.linalg.qr(rng.normal(size=(24, 24)))[0] for _ in range(2)]
    matrix = {"random": rng.normal(size=(24, 24)), "graded": q[0] @ np.diag(np.logspace(0, -9, 24)) @ q[1],
              "repeated": q[0] @ np.diag([3.0] * 8 + [2.0] * 8 + [1.0] * 8) @ q[1],
              "rank": np.outer(rng.normal(size=24), rng.normal(size=24)), "identity": np.eye(24), "zero": np.zeros((24, 24)),
              "blocks": np.kron(np.diag([1.0, 5.0, 1.0]), rng.normal(size=(8, 8))), "one": np.array([[-2.0]])}[kind]
    values, vectors = bidiagonal.right_vectors(np.linalg.qr(matrix)[1], 99)
    exact = np.linalg.svd(matrix)[1]
    k = len(values)
    assert k == (exact > len(matrix) * 2.3e-16 * max(exact[0], 1e-300)).sum()
    assert np.allclose(values, exact[:k], atol=1e-13 * max(exact[0], 1))
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-10)
    assert np.allclose(matrix.T @ matrix @ vectors, vectors * values ** 2, atol=1e-12 * max(exact[0] ** 2, 1))


# ---- sharding


@pytest.mark.parametrize("n", [0, 1, 5, 1003])
def test_shards(spark, n):
    rows = [(None if i % 7 == 0 else i // 3, None if i % 11 == 0 else "same" if i % 2 else "é" * (i % 90), i, "s") for i in range(n)]
    table = landed(spark.createDataFrame(rows, "doc_id long, text string, bucket int, shard string"))
    got = sharding.shuffle_into_shards(table, shards=8, seed=3, bucket_bytes=4000).collect()
    assert sorted((r["bucket"] for r in got)) == list(range(n))
    assert {r["bucket"]: (r["doc_id"], r["text"]) for r in got} == {r[2]: r[:2] for r in rows}
    slots = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(8)]
    assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
    again = sharding.shuffle_into_shards(table, shards=8, seed=3, bucket_bytes=4000).collect()
    assert {(r["bucket"], r["shard"], r["slot"]) for r in again} == {(r["bucket"], r["shard"], r["slot"]) for r in got}


def test_order_is_uniform(spark):
    counts = {}
    for k in range(6000):
        order = tuple(sharding.fisher_yates(3, np.random.default_rng([k, 0])).tolist())
        counts[order] = counts.get(order, 0) + 1
    assert len(counts) == 6 and all(850 < c < 1150 for c in counts.values())
    table = landed(spark.range(4000).withColumn("text", F.lit("same")))
    got = sharding.shuffle_into_shards(table, shards=4, seed=1).collect()
    for s in range(4):
        mean = np.mean([r["id"] for r in got if r["shard"] == s])
        assert abs(mean - 2000) < 150            # a shard is no run of the input


def test_written_shards(spark, tmp_path):
    table = landed(spark.range(100).withColumn("text", F.col("id").cast("string")))
    sharding.write_shards(table, f"{tmp_path}/out", shards=3, seed=5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r["id"] for r in back.collect()) == list(range(100)) and back.select("shard").distinct().count() == 3
