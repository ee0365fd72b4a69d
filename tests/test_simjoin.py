"""Prefixes and stored tables of the similarity join."""

import os
import random

from lorestone import session
from lorestone.plans import simjoin


def test_prefixes_are_cut_where_the_sets_lie(spark):
    """Before, every item of every set was shuffled twice to find the rare ones."""
    rng = random.Random(3)
    sets = [(i, sorted(rng.sample([f"w{j}" for j in range(30)], rng.randint(1, 12)))) for i in range(60)]
    found = simjoin.prefixes(spark.createDataFrame(sets, "rep long, items array<string>"), 0.6)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    keys = {}
    for r in found.collect():
        keys.setdefault(r.rep, set()).add(r.value)
    for i, a in sets:
        for j, b in sets:
            a_, b_ = set(a), set(b)
            if len(a_ & b_) >= 0.6 * len(a_ | b_):
                assert keys[i] & keys[j]
    assert all(len(keys[i]) == 2 * (len(a) - -(-6 * len(a) // 10) + 1) for i, a in sets)


def test_tables_of_past_rounds_are_removed(spark, monkeypatch):
    """Before, the tables of all rounds stayed until the driver ended."""
    made = []
    keep = lambda df: (made.append(session.settle(df)), made[-1])[1]
    monkeypatch.setattr(simjoin, "settle", keep)
    rows = [(i, [f"w{j}" for j in range(i % 7, i % 7 + 20)]) for i in range(40)]
    found = simjoin.leaders(spark.createDataFrame(rows, "id long, t array<string>"), "id", "t", 0.9)
    # neighbours share 19 of 21, the next ones 18 of 22
    assert {(r.id, r.leader) for r in found.collect()} == {(i, i % 7 // 2 * 2) for i in range(40)}
    gone = [df for df in made if not os.path.exists(df.settled_path.removeprefix("file:"))]
    assert len(gone) >= 2 and made[0] in gone
