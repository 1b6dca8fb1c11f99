"""Confidence in architecture patterns, from signals that one pass over the facts gathers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.functions import classify as C

NAMES = ("ddd-hexagonal", "active-record", "flat-crud", "anemic-domain", "service-layer")


def signals(components: DataFrame, dependencies: DataFrame) -> DataFrame:
    p = F.col("package")
    domain, port = C.has_segment(p, "domain"), F.col("kind") == "port"
    facts = components.groupBy("repo").agg(
        F.count_distinct(F.when(p != "", p)).alias("packages"),
        F.coalesce(F.bool_or(domain), F.lit(False)).alias("domain"),
        F.coalesce(F.bool_or(C.has_segment(p, "application") | C.has_segment(p, "app")), F.lit(False)).alias("app"),
        F.coalesce(F.bool_or(C.has_segment(p, "infrastructure") | C.has_segment(p, "infra")), F.lit(False)).alias("infra"),
        F.count_if(port).alias("ports"), F.count_if(port & domain).alias("domain_ports"), F.count_if(~port & domain).alias("domain_types"),
    )
    dep = dependencies.select("repo", C.layer_word(C.package_of(F.col("from_id"))).alias("a"), C.layer_word(F.col("import_path")).alias("b")).where("a is not null and b is not null and a <> b")
    flow = dep.groupBy("repo").agg(F.lit(True).alias("linked"), F.bool_or(F.col("b") == "domain").alias("imported"), F.bool_or(F.col("a") == "domain").alias("imports"))
    return facts.join(flow, "repo", "left").na.fill(False, ["linked", "imported", "imports"])


def _plus(total: Column, condition: Column, points: float) -> Column:
    return total + F.when(condition, points).otherwise(0.0)


def confidences(found: DataFrame) -> DataFrame:
    """(repo, name, confidence), five rows a repo; terms are added in their declared order."""
    c, zero = F.col, F.lit(0.0)
    in_domain = c("domain_ports") + c("domain_types")
    hexagonal = zero
    for when, points in ((c("domain"), 0.20), (c("app"), 0.15), (c("infra"), 0.15), (c("domain_ports") > 0, 0.20), (c("imported") & ~c("imports"), 0.20), ((in_domain > 0) & (c("domain_ports") / F.greatest(in_domain, F.lit(1)) >= 0.25), 0.10)):
        hexagonal = _plus(hexagonal, when, points)
    named = c("domain").cast("int") + c("app").cast("int") + c("infra").cast("int")
    flat = F.when(c("packages") == 1, 0.55).when((c("packages") == 2) & ~c("linked"), 0.05).otherwise(0.0)
    flat = _plus(_plus(flat, c("ports") == 0, 0.20), named == 0, 0.15)
    anemic = zero
    for when, points in (((c("domain_ports") == 0) & (c("domain_types") > 0), 0.40), (c("imported"), 0.30), (c("ports") == 0, 0.20), (~c("app"), 0.10)):
        anemic = _plus(anemic, when, points)
    service = zero
    for when, points in ((c("packages") >= 2, 0.20), (c("linked"), 0.30), ((c("ports") == 0) & c("linked"), 0.20), (~c("domain") & ~c("infra") & (c("packages") >= 2), 0.10)):
        service = _plus(service, when, points)
    values = (hexagonal, zero, flat, F.when(c("domain"), anemic).otherwise(0.0), service)
    rows = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(n).alias("name"), F.least(F.lit(1.0), F.greatest(zero, v)).alias("confidence")) for k, (n, v) in enumerate(zip(NAMES, values))])
    return found.select("repo", F.explode(rows).alias("r")).select("repo", "r.ord", "r.name", "r.confidence")


def top_pattern(patterns: DataFrame) -> DataFrame:
    """(repo, top_pattern, top_confidence); of equals the one declared first."""
    return patterns.groupBy("repo").agg(F.max_by("name", F.struct("confidence", -F.col("ord"))).alias("top_pattern"), F.max("confidence").alias("top_confidence"))
