"""Indexing a project: what changed, its new units and relations, and the swap of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.operators.graph import resolve_edges


def replace_files(units: DataFrame, edges: DataFrame, files: DataFrame, new_units: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables after a re-parse of ``files`` (project_id, file_path).

    Units of the files are replaced; relations that start in them are resolved anew; relations into units that are still
    there stay, those into vanished units go.
    """
    old = units.join(files, ["project_id", "file_path"], "left_semi").select("id")
    kept = units.join(old, "id", "left_anti").unionByName(new_units)
    outgoing = edges.join(old.withColumnRenamed("id", "src"), "src", "left_anti").select(*edges.columns)
    living = outgoing.join(kept.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)
    return kept, living.unionByName(resolve_edges(new_edges, kept).select(*edges.columns)).distinct()


def stale_vectors(vectors: DataFrame, files: DataFrame, kept: DataFrame) -> DataFrame:
    """Vectors without those of re-parsed files whose unit is gone."""
    gone = vectors.join(files, ["project_id", "file_path"], "left_semi").join(kept.select("id"), "id", "left_anti").select("id")
    return vectors.join(gone, "id", "left_anti")


def merged_metadata(base: str, extra: str):
    """Metadata of a unit with what a detector adds: the detector wins."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(extra), k)), extra)


def recovered(tasks: DataFrame) -> DataFrame:
    """Tasks after a restart: what was queued or running has failed; agent runs with a finished step are partial."""
    open_ = F.col("status").isin("QUEUED", "RUNNING", "INDEXING")
    return tasks.withColumn("status", F.when(open_ & (F.col("kind") == "AGENT") & (F.col("steps_done") > 0), "PARTIAL").when(open_, "FAILED").otherwise(F.col("status")))


def admitted(history: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests to index (project_id) with whether they are accepted: not while the project is being indexed."""
    running = history.filter("status = 'running'").select("project_id", F.lit(True).alias("busy")).distinct()
    return requests.join(running, "project_id", "left").select("project_id", F.col("busy").isNull().alias("accepted"))


def dirty(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """The cache (project_id, file_path, hash, dirty) with the files (project_id, file_path) about to be parsed marked, new ones without a hash."""
    both = cache.join(changed.withColumn("_c", F.lit(True)), ["project_id", "file_path"], "full")
    return both.select("project_id", "file_path", "hash", (F.coalesce("_c", F.lit(False)) | F.coalesce("dirty", F.lit(False))).alias("dirty"))


def committed(cache: DataFrame, parsed: DataFrame, current: DataFrame) -> DataFrame:
    """The cache after a run: a parsed file (project_id, file_path, hash) is clean if it has that hash still; others stay as they are."""
    seen = parsed.select("project_id", "file_path", F.col("hash").alias("_p")).join(current.select("project_id", "file_path", F.col("hash").alias("_n")), ["project_id", "file_path"])
    same = seen.filter("_p = _n").select("project_id", "file_path", "_p")
    return cache.join(same, ["project_id", "file_path"], "left").select("project_id", "file_path", F.coalesce("_p", "hash").alias("hash"), (F.col("dirty") & F.col("_p").isNull()).alias("dirty"))


def gone_files(cached: DataFrame, current: DataFrame, units: DataFrame) -> DataFrame:
    """(project_id, file_path) to take out of the index: cached files that were deleted, and files of units that are not on disk."""
    keys = ["project_id", "file_path"]
    return cached.select(*keys).unionByName(units.filter("trim(file_path) <> ''").select(*keys)).distinct().join(current.select(*keys), keys, "left_anti")


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors by id: new ones take the place of old ones."""
    return old.join(new.select("id").distinct(), "id", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def without_project(vectors: DataFrame, project_id: str) -> DataFrame:
    """Vectors without those of a project."""
    return vectors.filter(F.col("project_id") != project_id)
