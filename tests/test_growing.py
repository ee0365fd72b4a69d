"""Clusters that grow in order, against the sequential rule."""

import random

import pytest
from pyspark.sql import functions as F

from lorestone.operators import notes as N
from lorestone.plans import growing
from lorestone.plans.growing import grown_clusters, replay


def grown(notes):
    """Cluster by cluster: every later free note with two keys of the grown set joins."""
    free, out = dict(notes), {}
    for seq in sorted(free):
        if seq in out:
            continue
        union, members = set(free[seq]), [seq]
        for other in sorted(free):
            if other > seq and other not in out and len(union & set(free[other])) >= 2:
                members.append(other)
                union |= set(free[other])
        for m in members:
            out[m] = seq
    return out


def cases():
    rng = random.Random(11)
    for words, most in ((12, 4), (60, 5), (200, 6)):
        yield {i: rng.sample([f"k{w}" for w in range(words)], rng.randint(0, most)) for i in rng.sample(range(1000), 300)}
    # one key that all notes share, and a chain in which every note brings the next one in
    yield {i: ["hot", f"a{i % 40}", f"b{i % 7}"] for i in range(300)}
    yield {i: [f"c{i}", f"c{i + 1}", f"c{i + 2}"] for i in range(30)}


@pytest.mark.parametrize("notes", list(cases()))
def test_replay_equals_the_sequential_rule(notes):
    assert dict(replay((s, notes[s]) for s in sorted(notes))) == grown(notes)


@pytest.mark.parametrize("held", [10**6, 20])
def test_clusters_equal_the_sequential_rule(spark, held):
    for notes in list(cases()) if held > 1000 else [dict(sorted(c.items())[:60]) for c in list(cases())[1:]]:
        want = grown(notes)
        sizes = {c: sum(v == c for v in want.values()) for c in set(want.values())}
        df = spark.createDataFrame([(s, [*k, None, *k[:1]]) for s, k in notes.items()], "seq long, keys array<string>")
        got = {r.seq: (r.cluster, r.n) for r in grown_clusters(df, held).collect()}
        assert got == {s: (c, sizes[c]) for s, c in want.items() if sizes[c] > 1}


def test_clusters_of_odd_notes(spark):
    rows = [(1, None, None), (2, [], ["x"]), (3, ["a"], ["b"]), (4, ["b"], ["a", "c"]), (5, ["c"], ["b"])]
    df = spark.createDataFrame(rows, "seq long, keywords array<string>, entities array<string>")
    got = {(r.seq, r.cluster, r.n) for r in N.note_clusters(df).collect()}
    assert got == {(3, 3, 3), (4, 3, 3), (5, 3, 3)}
    assert N.note_clusters(df.where(F.lit(False))).count() == 0


def large_notes():
    rng = random.Random(7)
    some = {i: [f"h{rng.randint(0, 3)}", *rng.sample([f"k{w}" for w in range(1500)], rng.randint(1, 4)), f"own{i}"] for i in range(0, 4000, 2)}
    return some | {i: ["hot", "warm", f"v{i % 300}", f"w{i % 7}"] for i in range(1, 4000, 2)}


@pytest.mark.parametrize("copied", [growing.COPIED, 4000, 0])
def test_a_component_above_the_limit_is_not_listed_note_by_note(spark, monkeypatch, copied):
    """All but the notes that bring a key are placed in parallel; only without room for these the old ways are taken."""
    notes = large_notes()
    want = grown(notes)
    sizes = {c: sum(v == c for v in want.values()) for c in set(want.values())}
    df = spark.createDataFrame(list(notes.items()), "seq long, keys array<string>").repartition(4)
    if copied == growing.COPIED:
        monkeypatch.setattr(growing, "_rounds", None)
        monkeypatch.setattr(growing, "_replayed", None)
    got = {r.seq: (r.cluster, r.n) for r in grown_clusters(df, 10**6 if copied < growing.COPIED else 20, copied).collect()}
    assert got == {s: (c, sizes[c]) for s, c in want.items() if sizes[c] > 1}
