"""Walking pages gives the ordered result, and a page reads the ranges it lies in."""

import random
import re

import pytest
from pyspark.sql import functions as F

from keysieve.operators.pages import PageIndex


@pytest.mark.parametrize("size, range_rows", [(500, 60), (500, 1000), (1, 10), (0, 10)])
def test_walking_pages(spark, tmp_path, size, range_rows):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, "ccc"]), i) for i in range(size)]
    frame = spark.createDataFrame(rows, "k string, i int")
    index = PageIndex.build(frame, str(tmp_path / "p"), [F.desc_nulls_last("k"), F.asc("i")], range_rows)
    expected = sorted(rows, key=lambda r: (r[0] is None, [-ord(c) for c in (r[0] or "")], r[1]))
    expected = [(n, *r) for n, r in enumerate(expected, 1)]
    walked, after = [], 0
    while True:
        page = [tuple(r) for r in index.page(after, 97).collect()]
        if not page:
            break
        walked += page
        after = page[-1][0]
    assert walked == expected and sorted(tuple(r) for r in index.all_rows().collect()) == expected
    assert [tuple(r) for r in index.page(450, 10).collect()] == expected[450:460]
    assert index.page(10_000, 5).isEmpty()
    with pytest.raises(ValueError):
        index.page(0, 0)


def test_a_page_reads_few_ranges(spark, tmp_path):
    index = PageIndex.build(spark.range(1000).withColumnRenamed("id", "i"), str(tmp_path / "p"), [F.asc("i")], 100)
    assert len(index.starts) > 5
    plan = index.page(700, 20)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_range", plan)
    pruned = index._rows().filter(F.col("_range") == index.ranges[6])
    assert [r.place for r in index.page(700, 20).collect()] == list(range(701, 721)) and pruned.count() < 300
