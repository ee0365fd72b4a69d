import random

from pyspark.sql import functions as F

from lorestone.operators import ledger as L
from lorestone.operators import metrics as M
from lorestone.operators import notes as N
from lorestone.plans import graph as G
from lorestone.plans import ordered as O
from lorestone.plans.simjoin import leaders


def test_running_sums_and_neighbours_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), i, rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    sums = {(r.k, r.i): (r.s, r.n) for r in O.running_sums(df, ["k"], ["i"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    near = {(r.k, r.i): (r.p, r.q) for r in O.neighbours(df, ["k"], ["i"], before={"p": F.col("v")}, after={"q": F.col("i")}).collect()}
    for key in {k for k, _, _ in rows}:
        mine = [r for r in rows if r[0] == key]
        total = 0
        for at, (k, i, v) in enumerate(mine):
            total += v
            assert sums[(k, i)] == (total, at + 1)
            assert near[(k, i)] == (mine[at - 1][2] if at else None, mine[at + 1][1] if at + 1 < len(mine) else None)


def _greedy(sets, t):
    lead, out = [], {}
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    for i in sorted(sets):
        best = max(((jac(sets[i], sets[j]), -j) for j in lead), default=(0.0, 0))
        if best[0] > t:
            out[i] = -best[1]
        else:
            lead.append(i)
            out[i] = i
    return out


def test_leaders_equal_the_sequential_rule(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    base = [set(rng.sample(words, 20)) for _ in range(4)]
    sets = {}
    for i in range(120):
        s = set(base[i % 4])
        for _ in range(rng.randint(0, 3)):
            s ^= {rng.choice(words)}
        sets[i] = s if i % 9 else set(rng.sample(words, rng.randint(0, 6)))
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, t array<string>")
    for t in (0.9, 0.6, 0.3):
        got = {r.id: r.leader for r in leaders(df, "id", "t", t).collect()}
        assert got == _greedy(sets, t), t


def test_chains_cycles_and_components(spark):
    nodes = [(0, True, None), (1, False, 0), (2, False, 1), (3, False, 99), (4, False, 5), (5, False, 4), (6, False, None), (7, False, 7)]
    nodes += [(i, False, i - 1) for i in range(100, 140)] + [(99 + 1000, True, None)]
    df = spark.createDataFrame(nodes, "id long, origin boolean, parent long")
    done = {r.id: r.complete for r in G.reaches_origin(df).collect()}
    assert [done[i] for i in range(8)] == [True, True, True, False, False, False, False, False]
    assert not done[139]
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 9)], "src long, dst long")
    n = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6, 9)], "node long")
    assert {r.node: r.component for r in G.components(n, edges).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 9}


def test_confidence_replay(spark):
    rng = random.Random(3)
    names = ["confirmed", "contradicted", "accessed", "stale", "other"]
    events = [(i % 3, i, rng.choice(names)) for i in range(300)]
    want = {}
    for note, _, e in events:
        c = want.get(note, 0.5)
        c = {"confirmed": min(1, c + 0.1 * (1 - c)), "contradicted": max(0, c - 0.15), "accessed": min(1, c + 0.02), "stale": max(0.1, c - 0.01)}.get(e, c)
        want[note] = c
    df = spark.createDataFrame(events, "id int, seq int, event string")
    for r in N.confidence_after(df, chunk=8).collect():
        assert abs(r.confidence - want[r.id]) < 1e-9


def test_outcomes_and_gate(spark):
    recalls = spark.createDataFrame(
        [("e1", "a", 0.0, ["alpha beta gamma delta epsilon"]), ("e2", "a", 0.0, ["one two three"]), ("e3", "b", 10.0, ["red green blue black"])],
        "event_id string, agent string, ts double, memories array<string>",
    )
    texts = spark.createDataFrame([(1, "a", 1800.0, "beta gamma alpha here"), (2, "b", 1811.0, "red green blue black")], "write_id int, agent string, ts double, text string")
    assert {r.event_id: r.was_used for r in L.match_outcomes(recalls, texts).collect()} == {"e1": True, "e3": False}
    ex = spark.createDataFrame([(i, float(i), i >= 20) for i in range(100)], "id int, score double, was_correct boolean")
    gate = L.fit_gate(ex, 0.1, 30).first()
    assert gate.threshold == 12.0 and gate.n_accepted == 88
    assert L.fit_gate(ex.limit(5), 0.1, 30).first().threshold is None


def test_frontier(spark):
    rows = [(1, "x", 90.0, 1000, 10.0), (2, "x", 80.0, 1000, 20.0), (3, "x", 80.0, 100, 20.0), (4, "y", 10.0, 100, 99.0), (5, "x", 99.0, None, 1.0)]
    df = spark.createDataFrame(rows, "id int, benchmark string, accuracy double, tokens_total int, p95_latency_ms double")
    assert {r.id: r.frontier for r in M.pareto_frontier(df).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}
