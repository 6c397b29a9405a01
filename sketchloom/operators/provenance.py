"""Manifests of runs: hashes, checks against what is there, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sha256(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def hashed(artifacts: DataFrame) -> DataFrame:
    """run_id, path, sha256."""
    return artifacts.select("run_id", "path", sha256(F.col("content")).alias("sha256"))


def manifests(runs: DataFrame, hashes: DataFrame, digits: int = 2) -> DataFrame:
    """runs plus bucket and artifact_sha256, a map in the order of paths.

    A run's paths are dealt into 16 ** digits buckets by their own hash, so that
    no row has to hold them all; a run without artifacts has one row of nulls.
    """
    bucket = F.substring(F.sha2("path", 256), 1, digits)
    listed = hashes.groupBy("run_id", bucket.alias("bucket")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "sha256")))).alias("artifact_sha256"))
    return runs.join(listed, "run_id", "left")


def verified(manifest: DataFrame, seen: DataFrame) -> DataFrame:
    """run_id, path, recorded, sha256, ok: the recorded hashes (manifest: run_id, path, recorded) against those recomputed, without case."""
    both = manifest.select("run_id", "path", F.lower("recorded").alias("recorded")).join(seen.select("run_id", "path", F.lower("sha256").alias("sha256")), ["run_id", "path"], "full_outer")
    return both.withColumn("ok", F.col("recorded").eqNullSafe(F.col("sha256")))


def run_checks(runs: DataFrame, comparisons: DataFrame, provider: str, revision: str, model: str, native: str = "passed") -> DataFrame:
    """run_id, provider, mismatches, failed (first failing check, or null).

    runs: revision, clean, critiqued, provider, model, output_sha256 (recorded),
    seen_sha256 (recomputed), native_status, native_sha256 (what the native
    check read) and after_sha256 (afterwards). A value that is missing fails.
    """
    counts = comparisons.groupBy("run_id").agg(F.sum((~F.col("ok")).cast("long")).alias("mismatches"))
    rows = runs.join(counts, "run_id", "left").na.fill(0, ["mismatches"])
    same = lambda a, b: F.lower(a) == F.lower(b)
    checks = {
        "revision": F.col("revision") == revision, "worktree": F.col("clean"), "critique": F.col("critiqued"), "provider": F.col("provider") == provider, "model": F.col("model") == model,
        "output_hash": same("output_sha256", "seen_sha256"), "hash": F.col("mismatches") == 0, "native_status": F.col("native_status") == native,
        "native_hash": same("native_sha256", "seen_sha256"), "after_hash": same("after_sha256", "seen_sha256"),
    }
    failed = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()))
    return rows.select("run_id", "provider", "mismatches", failed.alias("failed"))


def corpus_report(checks: DataFrame) -> DataFrame:
    """provider, runs, passed, all_passed."""
    ok = F.col("failed").isNull()
    return checks.groupBy("provider").agg(F.count("*").alias("runs"), F.sum(ok.cast("long")).alias("passed"), F.bool_and(ok).alias("all_passed"))
