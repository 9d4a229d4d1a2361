"""State of paced runs: few stores for small micro-batches, and the session's own settings left as they were."""

import random

import pytest

from tests.test_joins import brute, pair
from tests.test_replay import rows
from tidejoin.plans.spec import JoinSpec, Predicate
from tidejoin.streaming import stores
from tidejoin.streaming.join import paced_join
from tidejoin.streaming.running import paced_histogram
from tidejoin.streaming.sweep import Setting, paced_sweep


@pytest.mark.parametrize("run", ["join", "histogram"])
def test_stores_of_a_paced_run(spark, run):
    rng = random.Random(9)
    r, s = rows(rng, 40), rows(rng, 40)
    spec = JoinSpec(Predicate.KEY, 9, 9)
    with stores.settings(spark, {"spark.sql.shuffle.partitions": "24"}):
        if run == "join":
            found, query = paced_join(*pair(spark, r, s), spec, 20, 20, 2, "1 second")
            assert sorted(map(tuple, found.collect())) == brute(r, s, spec)
        else:
            query = paced_histogram(*pair(spark, r, s), spec, 4, 20, 20, 2)[1]
        assert spark.conf.get("spark.sql.shuffle.partitions") == "24"
    held = query.recentProgress[0]["stateOperators"]
    assert {o["numShufflePartitions"] for o in held} == {stores.LEAST_PARTITIONS}
    assert all(o["numStateStoreInstances"] == stores.LEAST_PARTITIONS for o in held)  # four times as many with the stores that Spark has by default
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_partitions():
    assert [stores.state_partitions(n, 200) for n in (1, 5_000, 5_001, 10**9)] == [4, 5, 6, 200]
    assert stores.state_partitions(10**9, 2) == 2


def test_runs_at_once(spark):
    rng = random.Random(7)
    r, s = rows(rng, 60), rows(rng, 60)
    settings = {str(n): Setting(JoinSpec(Predicate.KEY, 9, 9), 20, 30, n) for n in (1, 2, 5)}
    found = {x.config: x for x in paced_sweep(*pair(spark, r, s), settings, "1 second", at_once=3).collect()}
    assert {k: (x["in"], x["out"], x.switches) for k, x in found.items()} == {k: (120, len(brute(r, s, settings[k].spec)), -(-5 // n)) for k, n in (("1", 1), ("2", 2), ("5", 5))}
