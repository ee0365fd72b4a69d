"""Parts of deep recall that are made for the asked names and memories only give the rows of the whole."""

import random

from pyspark.sql import functions as F

from lorestone.functions import text as T
from lorestone.functions.common import by_letters, extract_all, plain
from lorestone.operators import consolidate as C
from lorestone.operators import recall as R

NOTES = [
    ("a", "2024-01-02", "PyTorch needs CUDA 12 because v1.2 broke. 45% of GPU time, src/cache_file_reader.py and some_long_name_here."),
    ("b", "2024-01-01", "BM25 was fixed from v1.2 to v2.0; 45% more. Measured on GPU with CacheReader."),
    ("c", "2024-01-03", "Nothing here."), ("d", None, "GPU becauſe of CUDA, dépends_on_me_too and ÉcoleNord, ４５% v１.2"), ("e", "2024-01-05", None),
    ("b", "2024-01-01", "GPU replaced CUDA"), (None, "2023-01-01", "GPU needs CUDA, v1.2 İmproved"),
]


def test_neighbours_of_asked_names(spark):
    rng = random.Random(5)
    names = [f"n{rng.randint(0, 400):03d}é" for _ in range(600)] + [None, None, "n200é", "n200é"]
    traces = spark.createDataFrame([(n,) for n in names], "name string").repartition(7)
    asked = ["n200é", "n000é", "n399é", min(n for n in names if n), max(n for n in names if n), "absent", None, "n200é"]
    ask = spark.createDataFrame([(n,) for n in asked], "name string")
    rows = lambda df: sorted(map(str, df.collect()))
    whole = R.order_neighbours(traces).join(ask.distinct(), "name", "left_semi")
    want = rows(whole.select("name", "other", "distance"))
    assert len(want) >= 6 and rows(R.order_neighbours(traces, asked=ask)) == want
    few, R.COPIED = R.COPIED, 2
    try:
        assert rows(R.order_neighbours(traces, asked=ask)) == want
    finally:
        R.COPIED = few


def test_both_tables_of_the_graph_from_one_pass(spark):
    notes = spark.createDataFrame(NOTES, "name string, date string, text string").withColumn("entities", T.trace_entities(F.col("text")))
    graph = C.counted_graph(notes)
    plan = graph._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 1
    rows = lambda df: sorted(map(str, df.collect()))
    relations = rows(C.relation_table(C.trace_relations(notes)))
    assert rows(C.relation_table(graph)) == relations and any("weight=3" in r for r in relations)
    entities = rows(C.entity_table(notes, ["gpu"]))
    assert rows(C.entity_table(graph, ["gpu"])) == entities and any("type='project'" in r for r in entities)


def test_patterns_without_the_unicode_flag_on_plain_texts(spark):
    odd = [t for *_, t in NOTES] + ["", "a_b_c_d abc_def_ghi x\x0by 12.5% É12%", "\x1c7%\x85 MiniLM ſome_odd_nameſ_x İsTanBul"]
    texts = spark.createDataFrame([(t,) for t in odd], "text string")
    c = F.col("text")
    for p in (r"(?U)\d+\.?\d*%", r"(?U)\b[a-z][a-z_]+(?:_[a-z]+){2,}\b", r"(?U)\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b", r"(?iUd)\bbecause\b|\bneeds\b", r"(?U)\w+\s"):
        rows = texts.select(extract_all(c, p).alias("a"), by_letters(plain(c), p, lambda x: extract_all(c, x)).alias("b")).collect()  # noqa: B023
        assert [r.a for r in rows] == [r.b for r in rows]


def test_memories_that_were_not_found_are_not_read_in_full(spark):
    memories = spark.createDataFrame([(i, f"---\nproject: p{i}\n---\n# M\n- note number {i} about kyoto and more words") for i in range(50)], "item_id long, text string")
    queries = spark.createDataFrame([(1, "kyoto 7"), (2, "nothing")], "query_id int, query string")
    found = R.semantic_search(memories, queries, 3)
    got = {(r.query_id, r.item_id, r.key_point, r.project) for r in found.collect()}
    assert got == {(1, i, f"note number {i} about kyoto and more words", f"p{i}") for i in (7, 0, 1)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("key_point"):]
