"""Analyses over time: snapshots, trends per rule, regression, and the cache of extracted files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagraph.operators import rules

SCORE = "overall double, structural_presence double, layer_conformance double, dependency_compliance double, interface_coverage double"
SNAPSHOT = f"timestamp string, git_commit string, git_branch string, result struct<score: struct<{SCORE.replace(' double', ': double')}>, violations: array<struct<rule: string, severity: string, file: string, line: bigint, message: string>>, component_count: bigint, dependency_count: bigint, files_analyzed: bigint, repo: string, package_metrics: array<struct<package: string, abstractness: double, instability: double, distance: double, zone: string>>, patterns: array<struct<name: string, confidence: double>>>"


def read_history(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Snapshots from NDJSON; blank and malformed lines are left out. Adds ts, a timestamp."""
    reader = (spark.readStream if streaming else spark.read).schema(SNAPSHOT + ", _bad string").option("columnNameOfCorruptRecord", "_bad")
    return reader.json(path).where("_bad is null and timestamp is not null").drop("_bad").withColumn("ts", F.to_timestamp("timestamp"))


def append_history(snapshots: DataFrame, path: str) -> None:
    snapshots.select("timestamp", "git_commit", "git_branch", "result").write.mode("append").json(path)


def latest(history: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; one aggregation, no sort."""
    rest = [c for c in history.columns if c not in keys]
    low = history.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return low.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def with_previous(history: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds previous and delta of a value, by time within each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return history.withColumn("previous", F.lag(value).over(w)).withColumn("delta", F.col(value) - F.col("previous"))


def rule_trends(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(repo, rule_id, previous_count, current_count, delta) over the rules of either; inputs (repo, rule, n)."""
    a, b = previous.select("repo", F.col("rule").alias("rule_id"), F.col("n").alias("previous_count")), current.select("repo", F.col("rule").alias("rule_id"), F.col("n").alias("current_count"))
    both = a.join(b, ["repo", "rule_id"], "full_outer").na.fill(0, ["previous_count", "current_count"])
    return both.withColumn("delta", F.col("current_count") - F.col("previous_count"))


def regressions(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(repo, before, after) where the overall score fell; inputs (repo, overall)."""
    return previous.select("repo", F.col("overall").alias("before")).join(current.select("repo", F.col("overall").alias("after")), "repo").where("after < before")


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))


def cache_split(files: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of state to use again, files to extract again): a hit has the same repo, path and hash. files need sha256."""
    keys = ["repo", "path", "sha256"]
    return state.join(files.select(*keys).distinct(), keys, "left_semi"), files.join(state.select(*keys).distinct(), keys, "left_anti")


def cache_prune(state: DataFrame, files: DataFrame) -> DataFrame:
    """State of files that are still there."""
    return state.join(files.select("repo", "path").distinct(), ["repo", "path"], "left_semi")


def snapshots(summary: DataFrame, violations: DataFrame, timestamp: str, commit: str | None = None, branch: str | None = None, files: DataFrame | None = None, packages: DataFrame | None = None, patterns: DataFrame | None = None) -> DataFrame:
    """Rows of history from the summaries and violations of analyses, one a repository; with the number of files, package metrics and pattern confidences where these tables are given."""
    found = rules.each(violations).groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("rule", "severity", "file", "line", "message"))).alias("violations"))
    none = F.array().cast("array<struct<rule: string, severity: string, file: string, line: bigint, message: string>>")
    parts = [p.split()[0] for p in SCORE.split(", ")]
    score = F.when(F.col("overall").isNotNull(), F.struct(*parts))
    rows = summary.join(found, "repo", "left")
    for rest, kind, agg in (
        (files, "files_analyzed bigint", F.count("*")),
        (packages, "package_metrics array<struct<package: string, abstractness: double, instability: double, distance: double, zone: string>>", F.array_sort(F.collect_list(F.struct("package", "abstractness", "instability", "distance", "zone")))),
        (patterns, "patterns array<struct<name: string, confidence: double>>", F.array_sort(F.collect_list(F.struct("name", "confidence")))),
    ):
        name, kind = kind.split(" ", 1)
        rows = rows.withColumn(name, F.lit(None).cast(kind)) if rest is None else rows.join(rest.groupBy("repo").agg(agg.alias(name)), "repo", "left")
    result = F.struct(score.alias("score"), F.coalesce("violations", none).alias("violations"), "component_count", "dependency_count", "files_analyzed", "repo", "package_metrics", "patterns")
    return rows.select(F.lit(timestamp).alias("timestamp"), F.lit(commit).cast("string").alias("git_commit"), F.lit(branch).cast("string").alias("git_branch"), result.alias("result"))
