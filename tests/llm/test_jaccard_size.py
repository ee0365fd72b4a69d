"""What the set join keeps and lists: no token of sets without a possible partner, no row per pair of a large block."""

import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lorestone import session
from lorestone.llm import jaccard


def test_only_sets_of_possible_pairs_are_kept(spark, monkeypatch):
    """Before, the keys of all documents and the tokens of all that met were written and shuffled."""
    held = []

    def keep(df):
        out = session.settle(df)
        arrays = [f.name for f in out.schema if f.dataType.typeName() == "array"]
        held.append(sum(out.agg(F.sum(F.size(c))).first()[0] or 0 for c in arrays))
        return out

    monkeypatch.setattr(jaccard, "settle", keep)
    rng = random.Random(9)
    common = [f"c{i}" for i in range(12)]
    texts = [" ".join([*common, *(f"w{rng.randrange(10**6)}" for _ in range(150))]) for _ in range(80)]
    texts += [texts[0] + " more", texts[1]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(rows).collect()}
    assert found == {i: {80: 0, 81: 1}.get(i, i) for i in range(82)}
    tokens = sum(len(t.split()) - 3 for t in texts)
    assert sum(held) < tokens / 8


def sets_of_a_block(rng, count):
    base = np.array([rng.getrandbits(64) for _ in range(110)], np.uint64)
    out = []
    for _ in range(count):
        own = [rng.getrandbits(64) for _ in range(rng.choice([3, 12, 30, 90]))]
        out.append(np.unique(np.concatenate([base[: rng.randint(60, 110)], np.array(own, np.uint64)])))
    return out


def test_marks_rule_out_no_link_and_most_others():
    """Sets with different numbers of marks are compared by those of the smaller one."""
    sets = sets_of_a_block(random.Random(4), 120)
    marks = pa.array([jaccard._marks(s).tolist() for s in sets], pa.list_(pa.int64()))
    assert len({len(m) for m in marks}) > 1
    one, other = map(np.array, zip(*itertools.combinations(range(120), 2), strict=True))
    n = np.array([len(s) for s in sets])
    same = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(one, other, strict=True)])
    linked = 100 * same >= 85 * (n[one] + n[other] - same)
    possible = jaccard._within(marks, n, one, other, 85)
    assert linked.sum() > 20 and not (linked & ~possible).any()
    assert possible.sum() < 2 * linked.sum()


def test_pairs_of_a_large_block_are_no_rows(spark, monkeypatch):
    """Before, the last round joined the members of a block with each other; now tiles of it give what may be a link."""
    sets = sets_of_a_block(random.Random(4), 60)
    reps = spark.createDataFrame([(i, len(s), jaccard._marks(s).tolist()) for i, s in enumerate(sets)], "rep long, n long, marks array<long>")
    # 1 << 32 and 5 lie in hash ranges 1 and 0
    key = lambda rep: [1 << 32] + [5] * (rep < 20)
    labelled = spark.createDataFrame([(k, i, i // 2) for i in range(60) for k in key(i)], "key long, rep long, component long")
    open_ = labelled.groupBy("key").agg(F.count("*").alias("members"))
    one, other = map(np.array, zip(*itertools.combinations(range(60), 2), strict=True))
    n, marks = np.array([len(s) for s in sets]), pa.array([jaccard._marks(s).tolist() for s in sets], pa.list_(pa.int64()))
    fit = jaccard._within(marks, n, one, other, 85) & (one // 2 != other // 2) & (100 * np.minimum(n[one], n[other]) >= 85 * np.maximum(n[one], n[other]))
    want = set(zip(one[fit].tolist(), other[fit].tolist(), strict=True))
    for tile in (1024, 25, 7):
        monkeypatch.setattr(jaccard, "TILE", tile)
        assert {tuple(r) for r in jaccard._across(labelled, open_, reps, 85).collect()} == want
