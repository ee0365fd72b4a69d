"""Tables that change in versions, as Parquet folders and one small manifest per version.

A writer puts new files into a folder of its own and then adds a manifest that names what the table consists of now.  Only that last
step makes the version; a writer that fails before leaves the table as it was, and readers of an older version are not
disturbed.  A commit names the version that it started from and is refused if another came first.

Two kinds of table are built on it.  A *partitioned* table maps each value of its partition column to the folder that holds it: a
merge reads and rewrites the partitions it changes and keeps the folders of all others.  A *log* is a list of segments that are
only added to, until a compaction replaces them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scale import best_per_key
from ..session import settle

#: column of a log that orders its segments
SEGMENT = "_segment"


class VersionConflict(RuntimeError):
    """Another writer has committed since this one began."""


class DamagedTable(RuntimeError):
    """A segment does not hold what its manifest says."""


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, rising."""
    files, folder = _files(spark, f"{path}/manifest")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """(version, content) of a version, the last one by default; version 0 is the empty table."""
    known = versions(spark, path)
    wanted = (known[-1] if known else 0) if version is None else version
    if wanted == 0:
        return 0, {}
    if wanted not in known:
        raise ValueError(f"{path} has no version {wanted}")
    files, file = _files(spark, f"{path}/manifest/{wanted:012d}.json")
    stream = files.open(file)
    try:
        return wanted, json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, base: int, content: dict) -> int:
    """Make ``content`` the version after ``base``; the manifest appears whole or not at all."""
    files, made = _files(spark, f"{path}/manifest/.{uuid.uuid4().hex}")
    stream = files.create(made, False)
    stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    stream.close()
    _, final = _files(spark, f"{path}/manifest/{base + 1:012d}.json")
    last = versions(spark, path)
    if (last[-1] if last else 0) != base or files.exists(final) or not files.rename(made, final):
        files.delete(made, False)
        raise VersionConflict(f"{path}: version {base} is not the last one any more")
    return base + 1


def clean(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete folders that none of the last ``keep`` versions names, and the older manifests."""
    known = versions(spark, path)
    held: set[str] = set()
    for v in known[-keep:]:
        content = manifest(spark, path, v)[1]
        held |= set(content.get("parts", {}).values()) | {s["folder"] for s in content.get("segments", ())}
    files, data = _files(spark, f"{path}/data")
    for status in files.listStatus(data) if files.exists(data) else ():
        if status.getPath().getName() not in held:
            files.delete(status.getPath(), True)
    for v in known[:-keep]:
        files.delete(_files(spark, f"{path}/manifest/{v:012d}.json")[1], False)


# ---- partitioned tables ------------------------------------------------------------------------------


def _read_parts(spark: SparkSession, path: str, parts: dict[str, str], schema: str, part: str) -> DataFrame:
    """The partitions from the folders that hold them; one read per folder, pruned to its partitions."""
    out = spark.createDataFrame([], schema)
    for folder in sorted(set(parts.values())):
        values = [v for v, f in parts.items() if f == folder]
        out = out.unionByName(spark.read.schema(schema).parquet(f"{path}/data/{folder}").where(F.col(part).isin(values)))
    return out


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A partitioned table as of a version."""
    number, content = manifest(spark, path, version)
    if number == 0:
        raise ValueError(f"{path} has no version yet")
    return _read_parts(spark, path, content["parts"], content["schema"], content["part"])


def merge_rows(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], part: str, gone: DataFrame | None = None) -> int:
    """Put ``changes`` in place of rows with equal keys and take rows out whose keys are in ``gone``; returns the version.

    Keys include the partition column, a string without null.  The names of the partitions come to the driver, so the column is one
    of few values.  Keys are unique within ``changes``.
    """
    base, content = manifest(spark, path)
    changes = settle(changes)
    touched = {r[0] for r in changes.select(part).distinct().collect()} | ({r[0] for r in gone.select(part).distinct().collect()} if gone is not None else set())
    old = {v: f for v, f in content.get("parts", {}).items() if v in touched}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changes.schema)
    rows = changes
    if old:
        kept = _read_parts(spark, path, old, content["schema"], part).join(changes.select(keys), keys, "left_anti")
        if gone is not None:
            kept = kept.join(gone.select(keys), keys, "left_anti")
        rows = kept.unionByName(changes, allowMissingColumns=True)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    folder = uuid.uuid4().hex
    rows.write.partitionBy(part).parquet(f"{path}/data/{folder}")
    written = spark.read.schema(schema).parquet(f"{path}/data/{folder}").select(part).distinct()
    parts = {v: f for v, f in content.get("parts", {}).items() if v not in touched}
    parts |= {r[0]: folder for r in written.collect()}
    return commit(spark, path, base, {"parts": parts, "schema": schema, "part": part})


# ---- logs ---------------------------------------------------------------------------------------------


def _sum(df: DataFrame) -> tuple[int, str]:
    """Rows and a sum of their hashes, whatever their order."""
    total = F.sum(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)"))
    n, value = df.agg(F.count("*"), F.coalesce(total, F.lit(0).cast("decimal(38,0)"))).first()
    return n, str(value)


def _segment(spark: SparkSession, path: str, rows: DataFrame) -> dict:
    folder = uuid.uuid4().hex
    rows.write.parquet(f"{path}/data/{folder}")
    n, value = _sum(spark.read.schema(rows.schema).parquet(f"{path}/data/{folder}"))
    return {"folder": folder, "n": n, "sum": value}


def append_segment(spark: SparkSession, path: str, rows: DataFrame) -> int:
    base, content = manifest(spark, path)
    schema = content.get("schema") or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    segments = [*content.get("segments", ()), _segment(spark, path, rows)]
    return commit(spark, path, base, {"segments": segments, "schema": schema})


def read_log(spark: SparkSession, path: str, version: int | None = None, check: bool = True) -> DataFrame:
    """All rows of the log with the number of their segment; ``check`` holds each segment against its manifest."""
    _, content = manifest(spark, path, version)
    out = spark.createDataFrame([], content["schema"]).withColumn(SEGMENT, F.lit(0))
    for number, segment in enumerate(content["segments"]):
        rows = spark.read.schema(content["schema"]).parquet(f"{path}/data/{segment['folder']}")
        if check and _sum(rows) != (segment["n"], segment["sum"]):
            raise DamagedTable(f"{path}: segment {number} differs from its manifest")
        out = out.unionByName(rows.withColumn(SEGMENT, F.lit(number)))
    return out


def last_of_log(log: DataFrame, keys: list[str], removed: str) -> DataFrame:
    """The last row of each key, unless it says ``removed``."""
    return best_per_key(log, keys, [F.desc(SEGMENT)]).where(~F.col(removed)).drop(SEGMENT, removed)


def compact(spark: SparkSession, path: str, keys: list[str], removed: str) -> int:
    """Replace the segments by one that holds the rows that still count."""
    base, content = manifest(spark, path)
    rows = last_of_log(read_log(spark, path, base), keys, removed).withColumn(removed, F.lit(False))
    names = list(spark.createDataFrame([], content["schema"]).columns)
    return commit(spark, path, base, {"segments": [_segment(spark, path, rows.select(*names))], "schema": content["schema"]})


