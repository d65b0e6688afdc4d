"""Similarity search by sign projections, against brute force."""

import math

import numpy as np
import pytest

from keysieve.operators.vector_index import VectorIndex, shape_for

SCHEMA = "id long, embedding array<double>"


@pytest.fixture(scope="module")
def stored():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(150, 16))
    vectors = [centres[i % 150] + rng.normal(size=16) * 0.02 * (i % 30) for i in range(1500)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(10_000 + i, rows[7][1]) for i in range(700)]
    odd = [(None, rows[7][1]), (20_000, None), (20_001, [0.0] * 16), (20_002, [1.0] * 3), (20_003, [None] + [1.0] * 15),
           (20_004, [float("nan")] + [1.0] * 15), (20_005, [float("inf")] + [1.0] * 15), (20_006, [x * 1e200 for x in rows[8][1]])]
    return rows, odd


def brute(rows, asked, least):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    return {(a, i): s for a in asked for i, v in unit.items() if (s := float(unit[a] @ v)) > least}


@pytest.mark.parametrize("part_rows", [10_000, 9])
def test_search_and_recall_against_brute_force(spark, stored, tmp_path, part_rows):
    rows, odd = stored
    table = spark.createDataFrame(rows + odd, SCHEMA)
    index = VectorIndex.build(table, str(tmp_path / "index"), 16, threshold=0.9, part_rows=part_rows)
    assert index._read("large").isEmpty() == (part_rows == 10_000)
    requests = table.filter("id % 100 = 0 or id = 7")
    got = {(r.request_id, r.id): r.similarity for r in index.similar(requests).collect()}
    valid = rows + [(20_006, rows[8][1])]
    want = brute(valid, [i for i, _ in rows if i % 100 == 0 or i == 7], 0.9)
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert len(got) == index.similar(requests).count()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    counts = index.recall(requests).collect()
    assert sum(r.found for r in counts) >= 0.9 * sum(r.similar for r in counts) > 0
    assert {r.request_id for r in counts} == {a for a, _ in want}
    above = {k for k, s in want.items() if s > 0.97}
    assert {(r.request_id, r.id) for r in index.similar(requests, threshold=0.97).collect()} <= above
    with pytest.raises(ValueError):
        index.similar(requests, threshold=0.5)


def test_requests_that_are_similar_to_nothing_and_empty_tables(spark, stored, tmp_path):
    rows, odd = stored
    table = spark.createDataFrame(rows[:50], SCHEMA)
    index = VectorIndex.build(table, str(tmp_path / "a"), 16)
    assert index.similar(spark.createDataFrame(odd[1:7], SCHEMA)).isEmpty()
    assert index.recall(table.limit(0)).isEmpty()
    empty = VectorIndex.build(table.limit(0), str(tmp_path / "b"), 16)
    assert empty.similar(table).isEmpty() and {(r.similar, r.found) for r in empty.recall(table).collect()} == {(0, 0)}


def test_tables_follow_from_the_recall_and_bits_from_the_rows():
    few, many = shape_for(1000, 64, 0.96), shape_for(10 ** 9, 64, 0.96)
    assert few.bits == 8 and many.bits == 24 and many.tables > few.tables
    assert shape_for(10 ** 9, 64, 0.96, recall=0.9).tables < many.tables
    assert len(many.masks()) == 1 + 24 + 24 * 23 // 2


def test_sketches_leave_few_unrelated_pairs_and_lose_none_at_the_threshold():
    shape = shape_for(10 ** 6, 64, 0.96)
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(2, 4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    near = 0.96 * a + 0.28 * b / np.linalg.norm(b, axis=1, keepdims=True)
    apart = lambda x, y: np.bitwise_count((shape.sketches(x) ^ shape.sketches(y)).view(np.uint64))
    assert (apart(a, near) <= shape.differing).all() and (apart(a, b) <= shape.differing).mean() < 0.05


def test_what_grows_with_the_requests_is_not_broadcast(spark, stored, tmp_path):
    rows, _ = stored
    table = spark.createDataFrame(rows, SCHEMA)
    index = VectorIndex.build(table, str(tmp_path / "index"), 16)
    found = index.similar(table.filter("id % 100 = 0"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # Only the list of crowded buckets is, which is empty here.
    assert plan.count("BroadcastHashJoin") <= 1 and plan.count("SortMergeJoin") >= 3


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """400 different vectors that are all similar, 20 copies of one of them, and 40 requests."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=64) + rng.normal(size=(400, 64)) * 0.05
    table = spark.createDataFrame([(i, [float(x) for x in vectors[i]]) for i in range(400)]
                                  + [(400 + i, [float(x) for x in vectors[0]]) for i in range(20)], SCHEMA)
    index = VectorIndex.build(table, str(tmp_path_factory.mktemp("crowd") / "index"), 64, part_rows=6)
    return index, table, table.filter("id < 400 and id % 10 = 0")


def moved_bytes(frame):
    """What the exchanges of a frame that was run have written, before compression."""
    def nodes(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return nodes(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return nodes(plan.plan())
        below = plan.children()
        return [plan] + [x for i in range(below.size()) for x in nodes(below.apply(i))]
    return sum(x.metrics().apply("dataSize").value() for x in nodes(frame._jdf.queryExecution().executedPlan())
               if x.getClass().getSimpleName() == "ShuffleExchangeExec")


def test_a_crowd_of_similar_vectors_is_not_moved_pair_by_pair(crowd):
    index, table, requests = crowd
    found = index.similar(requests)
    rows = found.collect()
    assert len(rows) == len({(r.request_id, r.id) for r in rows}) == 40 * 420
    # A vector has 512 bytes, and a pair passes three exchanges.
    assert moved_bytes(found) < 400 * len(rows)


def test_a_pair_leaves_the_index_once(crowd):
    index, table, requests = crowd
    wanted = index._requests(requests, "id", "embedding").select("class", "vector")
    met = index._met(wanted)
    assert met.count() == met.distinct().count() == 40 * 400


def test_members_of_a_large_class_come_in_parts(crowd):
    index, table, requests = crowd
    members, classes = index._read("members"), index._read("classes")
    assert {r.parts for r in classes.collect()} == {1, 4} and members.count() == 420
    assert members.join(classes.filter("parts = 4"), "class").select("part").distinct().count() == 4


def test_recall_of_a_crowd_moves_no_vector_for_each_pair(crowd):
    index, table, requests = crowd
    found = index.recall(requests)
    rows = found.collect()
    assert [(r.similar, r.found) for r in rows] == [(400, 400)] * 40
    assert moved_bytes(found) < 200 * 40 * 400


@pytest.mark.parametrize("block", [16_000, 7])
def test_exact_comparison_is_as_exact_as_double_precision(spark, tmp_path, block):
    # Cosines that lie on both sides of the threshold, nearer than single precision can tell.
    angles = [math.acos(0.9 + x * 1e-9) for x in range(-40, 41) if x]
    table = spark.createDataFrame([(i, [math.cos(a), math.sin(a), 0.0, 0.0]) for i, a in enumerate([0.0, *angles])], SCHEMA)
    index = VectorIndex.build(table, str(tmp_path / "index"), 4, threshold=0.9)
    wanted = index._requests(table, "id", "embedding").select("class", "vector")
    got = index.exact_classes(wanted, block=block)
    assert got.count() == got.select("request_class", "class").distinct().count() == 80 ** 2 + 1 + 2 * 40
    assert got.filter("similarity <= 0.9").isEmpty()
