"""Whole analyses: from source trees to facts, graph, violations, metrics and scores."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.config import Config, discover
from stratagraph.operators import forensics, graph, history, metrics, patterns, rules, services
from stratagraph.sources import tree
from stratagraph.tables import written


@dataclass
class Analysis:
    """One or many repositories; every table is made when it is first asked for, and then read from the shared folder."""

    components: DataFrame
    dependencies: DataFrame
    config: Config
    files: DataFrame | None = None
    externals: str = "cli"
    cycles: str = ""  # "nodes": of the dependency graph, "packages": of packages and their imports, which real code has
    project_root: str | None = None

    @cached_property
    def nodes(self) -> DataFrame:
        first = written(graph.build_nodes(self.components, self.dependencies), "nodes")
        return written(graph.with_external(first, self.components, self.project_root, self.externals), "graph")

    @cached_property
    def edges(self) -> DataFrame:
        return written(graph.build_edges(self.dependencies, self.nodes), "edges")

    @cached_property
    def violations(self) -> DataFrame:
        of = {"nodes": lambda: self.dependencies.select("repo", F.col("from_id").alias("a"), F.col("to_id").alias("b")), "packages": lambda: graph.package_edges(self.dependencies, self.components)}
        cyclic = graph.strongly_connected(of[self.cycles]()) if self.cycles else None
        return written(rules.described(rules.all_violations(self.components, self.nodes, self.edges, self.config, cyclic)), "violations")

    @cached_property
    def package_metrics(self) -> DataFrame:
        return written(metrics.package_metrics(self.components, self.dependencies), "packages")

    @cached_property
    def patterns(self) -> DataFrame:
        return written(patterns.confidences(patterns.signals(self.components, self.dependencies)), "patterns")

    @cached_property
    def score(self) -> DataFrame:
        return written(metrics.gated(metrics.scores(self.components, self.dependencies, self.nodes, self.edges, self.config), self.patterns), "score")

    @cached_property
    def summary(self) -> DataFrame:
        """(repo, score, top pattern, counts): one row a repository."""
        depth = graph.depth_metrics(self.nodes, self.edges).select("repo", F.col("node_count").alias("component_count"), F.col("edge_count").alias("dependency_count"))
        out = depth.join(self.score, "repo", "left").join(patterns.top_pattern(self.patterns), "repo", "left")
        return out.join(self.violations.groupBy("repo").agg(graph.number(self.violations).alias("violation_count")), "repo", "left").na.fill(0, ["violation_count"])

    def failing(self, fail_on: str | None = None, ignore: list[str] | None = None) -> DataFrame:
        return rules.failing(rules.without_rules(self.violations, ignore or []), fail_on or self.config.fail_on)

    def violation_kinds(self) -> DataFrame:
        return metrics.violation_kinds(self.violations)

    def improvements(self) -> DataFrame:
        return forensics.improvements(self.components, rules.each(self.violations))


def of_files(files: DataFrame, config: Config, state: DataFrame | None = None, **how) -> Analysis:
    """An analysis of (repo, path, language, content); state: facts of an earlier run, used where path and hash are the same."""
    hashed = history.with_hash(files)
    if state is None:
        found = tree.facts(files)
    else:
        hits, misses = history.cache_split(hashed, state)
        found = hits.unionByName(tree.facts(misses))
    found = written(found, "facts")
    return Analysis(written(tree.components(found, config), "components"), written(tree.dependencies(found, config), "dependencies"), config, found, **how)


def of_tree(spark: SparkSession, root: str, repo: str = "repo", config: Config | None = None, cache: str | None = None, under: str = "", **how) -> Analysis:
    """cache: a folder with the facts of the last run, which is read and then replaced; under: a module of the tree, whose paths stay those from the root."""
    config = config or discover(root)
    state = None
    if cache and os.path.isdir(cache):
        state = spark.read.schema(tree.FACTS).parquet(cache)
    a = of_files(tree.scan(spark, root, repo, config.languages, under), config, state, **how)
    if cache:
        a.files.write.mode("overwrite").parquet(cache)  # of_files has written a.files elsewhere, so it reads no cache
    return a


def per_service(spark: SparkSession, root: str, config: Config | None = None, pattern: str | None = None, **how) -> tuple[Analysis, DataFrame, DataFrame]:
    """(the analysis with a service as its repo column, its rollup, modules that services share): all services in one job."""
    config = config or discover(root)
    files = tree.scan(spark, root, "repo", config.languages)
    how.setdefault("cycles", "nodes")
    own = files.withColumn("repo", services.service_of(F.col("path"), pattern or config.services_pattern or "services/*")).where("repo is not null")
    a = of_files(own, config, **how)
    per = a.summary.join(a.files.groupBy("repo").agg(F.count("*").alias("files_analyzed")), "repo", "left")
    used = a.dependencies.where("kind = 'import'").select(F.lit("all").alias("repo"), F.col("repo").alias("service"), F.col("import_path").alias("module"))
    return a, services.rollup(per.withColumn("repo", F.lit("all"))), services.shared_modules(used)
