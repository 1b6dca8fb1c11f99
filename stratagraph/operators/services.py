"""Several services in one repository: their key, rolled-up scores and shared modules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = ["overall", "structural_presence", "layer_conformance", "dependency_compliance", "interface_coverage"]


def service_of(path: Column, pattern: str = "services/*") -> Column:
    """The folder of a path that a pattern names, null outside; here a star stays within one folder."""
    regex = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in pattern)
    found = F.regexp_extract(path, f"^({regex})/", 1)
    return F.when(found != "", found)


def rollup(services: DataFrame) -> DataFrame:
    """(repo, five score parts, component_count, dependency_count, files_analyzed): means weighted by components; a service without score counts as 0 but keeps its weight."""
    n = F.sum("component_count")
    mean = lambda c: F.when(n > 0, F.sum(F.coalesce(c, F.lit(0.0)) * F.col("component_count")) / n).otherwise(0.0)
    return services.groupBy("repo").agg(*[mean(c).alias(c) for c in PARTS], n.alias("component_count"), F.sum("dependency_count").alias("dependency_count"), F.sum("files_analyzed").alias("files_analyzed"))


def shared_modules(imports: DataFrame, distinct_services: bool = False) -> DataFrame:
    """(repo, module, used_by) for modules imported more than once, or by more than one service; input (repo, service, module)."""
    n = F.count_distinct("service") if distinct_services else F.count("*")
    return imports.groupBy("repo", "module").agg(n.alias("n"), F.array_sort(F.collect_set("service")).alias("used_by")).where("n > 1").drop("n")
