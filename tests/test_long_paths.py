"""Simple paths are followed to their end, however long."""

import pytest

from headwater.operators import graph, merge

CHAIN = [f"dbt::m{i}" for i in range(61)]


def test_paths_of_any_length(spark):
    e = spark.createDataFrame([*zip(CHAIN, CHAIN[1:]), (CHAIN[30], CHAIN[30]), (CHAIN[60], CHAIN[0])], "src string, dst string")
    assert [r.path for r in merge.end_to_end_paths(merge.Unified(e, e, e), CHAIN[0], CHAIN[60]).collect()] == [CHAIN]


def test_a_bound_drops_nothing(spark):
    e = spark.createDataFrame([*zip(CHAIN[:4], CHAIN[1:5])], "src string, dst string")
    assert [r.path for r in graph.end_to_end_paths(e, CHAIN[0], CHAIN[3], max_hops=3).collect()] == [CHAIN[:4]]
    with pytest.raises(ValueError, match="beyond 2 hops"):
        graph.end_to_end_paths(e, CHAIN[0], CHAIN[3], max_hops=2)
