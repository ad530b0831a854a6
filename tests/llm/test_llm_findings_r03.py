"""What the findings of round 3 named: each test fails without its change."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.llm import pivot_search as PS, queries

FOLDER = "/root/testdata/sf0.001"


def test_held_out_scores_are_near_the_base(spark):
    rows = [r for r in queries.op6_lattice_lm(spark, FOLDER).collect()]
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    held = [r for r in rows if r.held_out]
    known = [r for r in rows if not r.held_out]
    # the vocabulary's scores alone: 2.1 times the base
    assert sum(r.score for r in held) > 1.4 * sum(r.base_score for r in held)
    assert sum(r.score for r in known) > 1.1 * sum(r.base_score for r in known)


@pytest.mark.parametrize("rows", [500, 20_000])
def test_sample_of_pivots_is_bounded_before_it_is_sent(spark, rows):
    table = spark.range(rows, numPartitions=16).select(F.concat(F.lit(b"h"), F.encode(F.format_string("%08d", "id"), "utf-8")).alias("vec"))
    want = [bytes(r.vec) for r in table.orderBy(F.xxhash64("vec"), "vec").limit(PS.SAMPLE).collect()]
    assert PS._sampled(table, rows) == want


def test_rings_are_data_and_not_plan(spark):
    keyed = spark.createDataFrame([(b"h1", [1], 0, 0.5), (b"h2", [2], 0, 1.0), (b"h3", [3], 1, 9.0)], "vec binary, ids array<bigint>, pivot int, d double")
    placed = PS._placed(keyed, [np.array([0.5, 0.7]), np.array([])], np.array([0, 3]))
    assert {r.pivot * 10 + r.d: r.ring for r in placed.collect()} == {0.5: 0, 1.0: 2, 19.0: 3}
    assert "0.7" not in placed._jdf.queryExecution().toString()
