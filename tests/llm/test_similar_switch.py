"""The links of near-duplicates are the same whatever size of a shard gives it further leaders."""

import pytest

from rastermill.llm import simhash


@pytest.mark.parametrize("shard", [2, 4096])
def test_a_chain_stays_whole_with_many_leaders(spark, shard):
    """Texts that slide along each other: neighbours are similar, and leaders settle short stretches of the chain each."""
    words = [f"w{i}" for i in range(60 + 6 * 80)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 60])) for i in range(80)]
    found = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), shard=shard)
    assert {r.component_id for r in found.collect()} == {0}
