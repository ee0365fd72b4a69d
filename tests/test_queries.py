import os

import pytest

from tools.check import compare, connect
from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "bm25_topk", "boosted_search", "structured_filters", "tfidf_bigrams", "paragraph_units", "fact_query",
    "supersession_windows", "temporal_edges", "shared_entity_links", "contradicted_notes", "bfs_related",
    "gap_clusters", "cosine_topk", "ledger_latest_outcome", "risk_coverage_aurc", "failure_taxonomy",
    "session_selection", "stream_hourly", "public_results", "as_of_validity", "stored_index_search", "block_search",
    "block_savings", "temporal_query", "feed_intake", "stream_outcomes", "pareto_frontier", "code_chunks", "code_symbols",
    "compiled_facts", "memory_versions", "commit_stimuli", "summary_levels", "document_chunks", "channel_fusion",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, name):
    _, n, verdict = compare(spark, connect(FOLDER), name, queries()[name], oracle_sql()[name], FOLDER)
    assert verdict == "same", verdict
    assert n > 0


def test_entry_and_registry(spark):
    assert entry(spark).columns == ["query_id", "para_id", "score", "rank"]
    assert set(oracle_sql()) <= set(queries())


def test_command_line(spark, tmp_path, capsys):
    from lorestone.cli import main

    (tmp_path / "2024-01-02_alder_decision.md").write_text(
        "# Note\n\nWe decided that the parser v1.2 uses bm25 because PyTorch failed on 2024-01-02.\n"
    )
    assert main(["search", "--notes", str(tmp_path), "--query", "which parser was decided"], spark) == 0
    assert main(["graph", "--notes", str(tmp_path)], spark) == 0
    assert "bm25" in capsys.readouterr().out
