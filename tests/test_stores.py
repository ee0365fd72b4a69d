"""Versioned tables, the vector log and the commit log."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorestone.sources import files
from lorestone.sources import vectorlog as G
from lorestone.sources import versions as S

ROWS = "part string, id long, value string"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("part", "id", "value").collect())


def test_versions_of_a_partitioned_table(spark, tmp_path):
    path = str(tmp_path / "table")
    frame = lambda rows: spark.createDataFrame(rows, ROWS)
    assert S.merge_rows(spark, path, frame([("01", 1, "a"), ("01", 2, "b"), ("02", 1, "c")]), ["part", "id"], "part") == 1
    gone = spark.createDataFrame([("02", 1)], "part string, id long")
    assert S.merge_rows(spark, path, frame([("01", 2, "B"), ("03", 9, None)]), ["part", "id"], "part", gone=gone) == 2
    assert rows_of(S.read_version(spark, path, 1)) == [("01", 1, "a"), ("01", 2, "b"), ("02", 1, "c")]
    assert sorted(map(str, rows_of(S.read_version(spark, path)))) == sorted(map(str, [("01", 1, "a"), ("01", 2, "B"), ("03", 9, None)]))
    # partitions that a merge does not touch keep their folder
    assert S.merge_rows(spark, path, frame([("03", 9, "z")]), ["part", "id"], "part") == 3
    second, third = S.manifest(spark, path, 2)[1]["parts"], S.manifest(spark, path, 3)[1]["parts"]
    assert second["01"] == third["01"] and second["03"] != third["03"] and "02" not in second
    S.clean(spark, path, keep=1)
    assert S.versions(spark, path) == [3] and rows_of(S.read_version(spark, path)) == [("01", 1, "a"), ("01", 2, "B"), ("03", 9, "z")]


def test_a_failed_or_late_writer_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([("p", 1, "a")], ROWS)
    S.merge_rows(spark, path, rows, ["part", "id"], "part")
    with pytest.raises(Exception, match="stopped"):
        S.merge_rows(spark, path, rows.withColumn("value", F.raise_error(F.lit("stopped"))), ["part", "id"], "part")
    assert S.versions(spark, path) == [1] and rows_of(S.read_version(spark, path)) == [("p", 1, "a")]
    with pytest.raises(S.VersionConflict):
        S.commit(spark, path, 0, {"parts": {}})
    assert S.versions(spark, path) == [1]
    with pytest.raises(ValueError, match="no version 7"):
        S.read_version(spark, path, 7)


# a lambda travels to the tasks by value
encode = lambda texts: np.array([[len(t) + 1.0, t.count("a") + 1.0, t.count("b") + 1.0] for t in texts])


def test_the_vector_log_equals_a_rebuild(spark, tmp_path):
    path, other = str(tmp_path / "log"), str(tmp_path / "again")
    chunk = lambda rows: spark.createDataFrame(rows, "chunk_id string, text string").withColumn("content_hash", F.sha2("text", 256))
    seen = lambda p, v=None: sorted((r.chunk_id, r.text, tuple(np.round(r.embedding, 6))) for r in G.vectors(spark, p, v).collect())
    assert G.add(spark, path, chunk([("1", "aa"), ("2", "ab"), ("3", "aa")]), encode) == (1, 0, 2)
    # one unchanged, one changed to known content, one new with new content
    assert G.add(spark, path, chunk([("1", "aa"), ("2", "aa"), ("4", "bbb")]), encode) == (2, 1, 1)
    assert G.remove(spark, path, chunk([("3", "x"), ("9", "x")])) == 3
    before = seen(path)
    assert G.compact(spark, path) == 4 and seen(path) == before
    G.add(spark, other, chunk([("1", "aa"), ("2", "aa"), ("4", "bbb")]), encode)
    assert seen(other) == before
    assert [r[0] for r in seen(path, 1)] == ["1", "2", "3"] and [r[0] for r in seen(path, 2)] == ["1", "2", "3", "4"]
    assert len(S.manifest(spark, path)[1]["segments"]) == 1


def test_a_damaged_segment_is_noticed(spark, tmp_path):
    path = str(tmp_path / "log")
    G.add(spark, path, spark.createDataFrame([("1", "aa", "h")], "chunk_id string, text string, content_hash string"), encode)
    file = next((tmp_path / "log" / "manifest").glob("*.json"))
    content = json.loads(file.read_text())
    content["segments"][0]["n"] = 2
    file.unlink()
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    file.write_text(json.dumps(content))
    with pytest.raises(S.DamagedTable):
        G.vectors(spark, path)


def test_commits_of_a_dump(spark, tmp_path):
    mark = lambda *f: "\x1e" + "\x1f".join(f)
    dump = "".join(
        [mark("a1", "First | one", "Ann", "10", "body\n\nof lines\n"), mark("a2", "Second", "Bo", "20", "\n"), mark("broken", "no time", "Cy", "soon"), mark("short", "x"), mark("a3", "Third", "Di", "20")]
    )
    file = tmp_path / "log.txt"
    file.write_text(dump)
    log = files.commit_log(spark, str(file)).withColumn("project", F.lit("p"))
    assert sorted(tuple(r) for r in log.drop("project").collect()) == [("a1", "First | one", "Ann", 10, "body\n\nof lines"), ("a2", "Second", "Bo", 20, ""), ("a3", "Third", "Di", 20, "")]
    seen = spark.createDataFrame([("p", "a2"), ("q", "zz")], "project string, sha string")
    fresh, last = files.new_commits(log, seen)
    assert [r.text for r in files.commit_stimuli(fresh).collect()] == ["p: Third (by Di)"]
    assert sorted(tuple(r) for r in last.collect()) == [("p", "a3"), ("q", "zz")]
    assert files.new_commits(log, seen.where("project = 'q'"))[0].count() == 3
