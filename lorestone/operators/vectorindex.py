"""Vector chunks: validation, re-use by content, exact search, public views."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import fixed
from ..functions import text as T
from ..plans.scale import best_per_key, by_score, top_per_key

#: query vectors that may be copied to every task
MAX_PROBES = 20_000


def chunk_table(paragraphs: DataFrame, private: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of the paragraphs; the first of equal chunks stays.  Paths that hold one of ``private`` are left out.

    ``paragraphs`` has para_id, source, name, path, date, doc_type, para_idx and text.
    """
    public = paragraphs.where(~is_private_path(F.col("path"), private)) if private else paragraphs
    # all chunks of a paragraph; a blank one still has its empty chunk, which validation reports
    parts_ = T.text_chunks(F.col("text"))
    rows = public.withColumn("_chunks", parts_).withColumn("chunk", F.explode(F.when(F.size("_chunks") > 0, F.col("_chunks")).otherwise(F.array(F.lit(""))))).drop("_chunks")
    # fields are joined by NUL bytes
    parts = [F.col("source"), F.col("name"), F.col("para_idx").cast("string"), F.col("chunk")]
    nul = F.unhex(F.lit("00"))
    payload = F.encode(parts[0], "utf-8")
    for p in parts[1:]:
        payload = F.concat(payload, nul, F.encode(p, "utf-8"))
    chunks = rows.select(
        F.sha2(payload, 256).alias("chunk_id"), F.col("chunk").alias("text"), "source",
        F.sha2("chunk", 256).alias("content_hash"),
        F.create_map(
            F.lit("document"), F.col("name"), F.lit("document_type"), F.col("doc_type"),
            F.lit("date"), F.col("date"), F.lit("path"), F.col("path"),
            F.lit("paragraph_idx"), F.col("para_idx").cast("string"),
        ).alias("metadata"),
        F.col("para_id").alias("ordinal"),
    )
    return best_per_key(chunks, ["chunk_id"], [F.asc("ordinal")])


def is_private_path(path: Column, private: tuple[str, ...]) -> Column:
    p = F.translate(path, "\\", "/")
    out = F.lit(False)
    for marker in private:
        out = out | p.contains(marker)
    return out


def chunk_problems(chunks: DataFrame) -> DataFrame:
    """(problem, n) of invalid chunks; no row when the table can be built."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    repeats = chunks.groupBy("chunk_id").count().where("count > 1").agg(
        F.lit("duplicate chunk_id").alias("problem"), F.count("*").alias("n")
    )
    single = chunks.agg(
        F.count_if(blank("chunk_id")).alias("empty chunk_id"),
        F.count_if(blank("text")).alias("empty text"),
        F.count_if(F.lit(True)).alias("rows"),
    )
    listed = single.selectExpr(
        "stack(3, 'empty chunk_id', `empty chunk_id`, 'empty text', `empty text`, 'no chunks', "
        "cast(rows = 0 as bigint)) as (problem, n)"
    )
    return listed.unionByName(repeats).where("n > 0")


def reuse_vectors(chunks: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, pending): chunks whose content already has a vector, and those to embed.

    ``stored`` has content_hash and embedding; a repeated hash keeps one vector.
    """
    known = stored.groupBy("content_hash").agg(F.min("embedding").alias("embedding"))
    kept = chunks.join(known, "content_hash")
    pending = chunks.join(known.select("content_hash"), "content_hash", "left_anti")
    return kept, pending


def embed(chunks: DataFrame, encode: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """Unit vectors for the chunks from a provider that maps texts to a matrix."""
    schema = StructType([*chunks.schema.fields, StructField("embedding", ArrayType(DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = []
            for start in range(0, len(frame), batch):
                matrix = np.asarray(encode(frame["text"].iloc[start : start + batch].tolist()), dtype="float64")
                parts.append(matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12))
            if parts:
                yield frame.assign(embedding=list(np.vstack(parts)))

    return chunks.mapInPandas(run, schema)


def build_vectors(chunks: DataFrame, stored: DataFrame | None, encode, batch: int = 64) -> DataFrame:
    """Vector table of the chunks; only new content is embedded.

    When the provider's dimension differs from the stored one, everything is embedded again.
    """
    if stored is None:
        return embed(chunks, encode, batch)
    kept, pending = reuse_vectors(chunks, stored)
    old = stored.select(F.size("embedding").alias("d")).limit(1).collect()
    if old and len(np.asarray(encode(["dimension probe"]))[0]) != old[0]["d"]:
        return embed(chunks, encode, batch)
    return kept.unionByName(embed(pending, encode, batch))


def _probe_batches(probes: DataFrame, seed: int = 0) -> list[DataFrame]:
    """Query vectors in batches of at most ``MAX_PROBES``, split by a hash of their id."""
    n = probes.count()
    if n <= MAX_PROBES:
        return [probes]
    parts = 2 * (-(-n // MAX_PROBES))
    share = F.pmod(F.xxhash64("query_id", F.lit(seed)), F.lit(parts))
    return [b for i in range(parts) for b in _probe_batches(probes.where(share == i), seed + 1)]


def _probe_matrix(probes: DataFrame) -> tuple[list, np.ndarray]:
    """Query vectors of one batch for a copy in every task."""
    rows = probes.select("query_id", "embedding").toPandas()
    matrix = np.array(rows["embedding"].tolist(), dtype="float64")
    if len(rows):
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    return rows["query_id"].tolist(), matrix


def _similarities(vectors: DataFrame, probes: DataFrame, pick) -> DataFrame:
    """(query_id, vec_id, similarity) chosen by ``pick`` from each block of similarities.

    The corpus is read in place, once per batch of query vectors; each Arrow batch is one matrix
    product.
    """
    out = None
    for batch in _probe_batches(probes.select("query_id", "embedding")):
        part = _batch_similarities(vectors, batch, pick)
        out = part if out is None else out.unionByName(part)
    return out


def _batch_similarities(vectors: DataFrame, probes: DataFrame, pick) -> DataFrame:
    ids, matrix = _probe_matrix(probes)
    handle = vectors.sparkSession.sparkContext.broadcast((np.array(ids), matrix))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = handle.value
        for frame in frames:
            if not len(frame) or not len(q):
                continue
            v = np.array(frame["embedding"].tolist(), dtype="float64")
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            sims = np.clip(v @ q.T, -1.0, 1.0)
            ids_here = frame["vec_id"].to_numpy()
            row, col = pick(sims, ids_here)
            yield pd.DataFrame(
                {"query_id": names[col], "vec_id": ids_here[row], "similarity": sims[row, col]}
            )

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    q_kind = dict(probes.dtypes)["query_id"]
    schema = f"query_id {q_kind}, vec_id {kinds['vec_id']}, similarity double"
    return vectors.select("vec_id", "embedding").mapInPandas(run, schema)


def similar_above(vectors: DataFrame, probes: DataFrame, threshold: float) -> DataFrame:
    """All pairs of a query vector and a stored vector above a cosine."""
    return _similarities(vectors, probes, lambda s, _ids: np.nonzero(s > threshold))


def cosine_topk(vectors: DataFrame, probes: DataFrame, k: int = 5) -> DataFrame:
    """Exact k nearest stored vectors per query vector.

    Every batch keeps its own k best per query (with all ties), so at most k rows per batch and
    query reach the final ranking.  Filter ``vectors`` by source before calling.
    """

    def best(sims: np.ndarray, _ids) -> tuple[np.ndarray, np.ndarray]:
        n = sims.shape[0]
        if n <= k:
            return np.nonzero(np.ones_like(sims, dtype=bool))
        floor = np.partition(sims, n - k, axis=0)[n - k]
        return np.nonzero(sims >= floor - 1e-9)

    found = _similarities(vectors, probes, best)
    return top_per_key(found, ["query_id"], by_score("vec_id", "similarity"), k)


def fingerprint(chunks: DataFrame) -> DataFrame:
    """One row (chunks, fingerprint) that changes with any chunk and not with their order.

    Each chunk is hashed on its own and the hashes are added, so no task sees the whole corpus.
    """
    entries = F.to_json(F.array_sort(F.map_entries("metadata")))
    one = F.sha2(F.concat_ws("\u0001", "chunk_id", "content_hash", entries, "source"), 256)
    part = lambda i: F.conv(F.substring(one, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")
    sums = chunks.agg(F.count("*").alias("chunks"), *[F.sum(part(i)).alias(f"s{i}") for i in range(4)])
    joined = F.concat_ws("-", F.col("chunks").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)])
    return sums.select("chunks", F.sha2(joined, 256).alias("fingerprint"))


def public_view(
    results: DataFrame,
    allowed_sources: list[str] | None = None,
    path_prefixes: list[str] | None = None,
    redacted_terms: list[str] | None = None,
    metadata_keys: list[str] | None = None,
    replacement: str = "[REDACTED]",
    max_chars: int = 600,
) -> DataFrame:
    """Search results fit for publication: allow-listed, redacted, cut; nothing without an allow-list."""
    if not allowed_sources and not path_prefixes:
        keep = F.lit(False)
    else:
        keep = F.col("source").isin(allowed_sources) if allowed_sources else F.lit(True)
        if path_prefixes:
            path = F.btrim(F.translate(F.coalesce(F.col("metadata")["path"], F.lit("")), "\\", "/"), F.lit("/"))
            under = F.lit(False)
            for prefix in path_prefixes:
                p = prefix.replace("\\", "/").strip("/")
                under = under | (path == p) | path.startswith(p + "/")
            keep = keep & under
    terms = [t.strip() for t in redacted_terms or [] if t.strip()]

    def clean(c: Column) -> tuple[Column, Column]:
        count = F.lit(0)
        for term in terms:
            pattern = "(?iu)" + "".join("\\" + ch if not ch.isalnum() and not ch.isspace() else ch for ch in term)
            count = count + F.regexp_count(c, F.lit(pattern))
            c = F.regexp_replace(c, pattern, replacement)
        return c, count

    text, n = clean(F.col("text"))
    entries = []
    for key in metadata_keys or []:
        value, m = clean(F.col("metadata")[key])
        entries += [F.lit(key), value]
        n = n + F.coalesce(m, F.lit(0))
    meta = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    cut = text
    if max_chars > 0:
        head = F.regexp_replace(F.substring(text, 1, max(max_chars - 3, 0)), r"(?U)\s+$", "")
        cut = F.when(F.length(text) > max_chars, F.concat(head, F.lit("..."))).otherwise(text)
    return results.where(keep).select(
        "chunk_id", cut.alias("text"), "source", "score",
        F.map_filter(meta, lambda _k, v: v.isNotNull()).alias("metadata"), n.alias("redactions"),
    )
