import pickle

import pandas as pd
import pytest

from tidemill.llm import shards


@pytest.mark.parametrize("wanted", [1, 7, 1000])
def test_tiles_hold_every_pair_once(wanted):
    parts, counts = {2: 75, 3: 1, 5: 40, 9: 3}, {2: 15, 3: 1, 5: 33, 8: 0}
    tiles = shards.tiled(parts, counts, wanted)
    assert set(tiles) == {2, 3, 5}
    numbers = []
    for d, (first, down, across, high, wide) in tiles.items():
        assert high <= shards.MOST_SIDE and wide <= shards.MOST_SIDE
        assert down * high >= parts[d] > (down - 1) * high and across * wide >= counts[d] > (across - 1) * wide
        numbers += range(first, first + down * across)
    assert numbers == list(range(len(numbers)))


@pytest.mark.parametrize("cores", [1, 100])
def test_blocks_meet_shards_in_tasks_without_passing_through_the_driver(spark, monkeypatch, cores):
    monkeypatch.setattr(shards, "_TASKS_A_CORE", cores)
    parts, counts = {4: 23, 6: 2}, {4: 9, 6: 1}

    def table(sizes):
        return spark.createDataFrame([(d, i, pickle.dumps((d, i))) for d, n in sizes.items() for i in range(n)], "dim int, part int, payload binary")

    def search(shard, block, held):
        if shard is not None:
            held.setdefault("met", []).append(shard)
            return None
        return pd.DataFrame([(*block, *s) for s in held.get("met", [])], columns=["dim", "block", "other", "shard"])

    found = shards.meet(table(parts), parts, table(counts), counts, search, "dim int, block int, other int, shard int")
    assert sorted(map(tuple, found.collect())) == sorted((d, b, d, s) for d, n in counts.items() for b in range(n) for s in range(parts[d]))
    plan = found._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "Join" not in plan
