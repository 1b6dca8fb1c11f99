"""Metrics and scores: grouped aggregates per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.config import LAYERS, Config
from stratagraph.functions import classify as C
from stratagraph.operators.graph import import_targets, number


def _share(part: Column, whole: Column) -> Column:
    return part.cast("double") / whole.cast("double")


def short_names(components: DataFrame) -> DataFrame:
    """(repo, package, short): one package, the first by name, for each last segment."""
    return components.where("package <> ''").select("repo", "package", C.last_segment(F.col("package")).alias("short")).groupBy("repo", "short").agg(F.min("package").alias("package"))


def _ends(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(repo, a, ce, ca) from distinct pairs (repo, a, b): out- and in-degrees in one aggregation."""
    one = pairs.select("repo", F.col(a).alias("p"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(pairs.select("repo", F.col(b).alias("p"), F.lit(0), F.lit(1)))
    return one.groupBy("repo", "p").agg(F.sum("o").alias("ce"), F.sum("i").alias("ca"))


def package_metrics(components: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(repo, package, abstractness, instability, distance, zone) per short package name; imports couple by their last segment."""
    short = short_names(components)
    sizes = components.join(short, ["repo", "package"]).groupBy("repo", "short").agg(F.count("*").alias("nc"), F.count_if(F.col("kind") == "port").alias("na"))
    dep = dependencies.where("import_path is not null").select("repo", C.package_of(F.col("from_id")).alias("package"), C.last_segment(F.col("import_path")).alias("to_short")).distinct()
    pairs = dep.join(short, ["repo", "package"]).join(short.select("repo", F.col("short").alias("to_short")), ["repo", "to_short"], "left_semi").where("short <> to_short").select("repo", "short", "to_short").distinct()
    both = sizes.join(_ends(pairs, "short", "to_short").withColumnRenamed("p", "short"), ["repo", "short"], "left").na.fill(0, ["ce", "ca"])
    a, i = _share(F.col("na"), F.col("nc")), F.when(F.col("ce") + F.col("ca") > 0, _share(F.col("ce"), F.col("ce") + F.col("ca"))).otherwise(0.0)
    d = F.abs(F.col("a") + F.col("i") - 1)
    far = F.col("d") > 0.5
    zone = F.when(far & (F.col("a") < 0.5) & (F.col("i") < 0.5), "pain").when(far & (F.col("a") > 0.5) & (F.col("i") > 0.5), "uselessness")
    return both.withColumn("a", a).withColumn("i", i).withColumn("d", d).select("repo", F.col("short").alias("package"), C.round2(F.col("a")).alias("abstractness"), C.round2(F.col("i")).alias("instability"), C.round2(F.col("d")).alias("distance"), zone.alias("zone"))


def package_conformance(components: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(repo, package, layer, abstractness, instability, conformance) per package with a layer; imports couple by their last two segments."""
    own = components.where("package <> ''").groupBy("repo", "package").agg(F.count("*").alias("nc"), F.count_if(F.col("kind") == "port").alias("na"), F.min_by("layer", F.when(F.col("layer").isNotNull(), F.col("seq"))).alias("layer"))
    pairs = import_targets(dependencies, own.select("repo", "package")).where("package <> to_package").distinct()
    both = own.where("layer is not null").join(_ends(pairs, "package", "to_package").withColumnRenamed("p", "package"), ["repo", "package"], "left").na.fill(0, ["ce", "ca"])
    a, i = _share(F.col("na"), F.col("nc")), F.when(F.col("ce") + F.col("ca") > 0, _share(F.col("ce"), F.col("ce") + F.col("ca"))).otherwise(0.0)
    x = y = F.lit(None).cast("double")
    for layer, (cx, cy) in C.CENTROIDS.items():
        x, y = F.when(F.col("layer") == layer, cx).otherwise(x), F.when(F.col("layer") == layer, cy).otherwise(y)
    away = F.sqrt((F.col("a") - x) * (F.col("a") - x) + (F.col("i") - y) * (F.col("i") - y))
    return both.withColumn("a", a).withColumn("i", i).select("repo", "package", "layer", F.col("a").alias("abstractness"), F.col("i").alias("instability"), F.greatest(F.lit(0.0), 1 - away).alias("conformance"))


def compliance(edges: DataFrame, spec: bool = False) -> DataFrame:
    """(repo, n_edges, n_right, compliance): the share of edges inside the code that don't go outwards. Unclassified edges count as wrong, unless spec leaves them and those within a layer out."""
    rows = edges.where(~F.col("src_is_external") & ~F.col("tgt_is_external") & ~F.col("src_is_cross_cutting") & ~F.col("tgt_is_cross_cutting") & ~F.col("src_architecture_mode").eqNullSafe("service-oriented"))
    if spec:
        rows = rows.where("src_layer is not null and tgt_layer is not null and src_layer <> tgt_layer")
    right = F.coalesce(~C.violates(F.col("src_layer"), F.col("tgt_layer")), F.lit(False))
    return rows.groupBy("repo").agg(number(rows).alias("n_edges"), number(rows, right).alias("n_right")).withColumn("compliance", _share(F.col("n_right"), F.col("n_edges")) * 100)


def interface_coverage(nodes: DataFrame, spec: bool = False) -> DataFrame:
    """(repo, ports, adapters, coverage); 100 without adapters (null under spec, which also counts domain ports only and no services)."""
    kinds = ["adapter", "repository"] if spec else ["adapter", "repository", "service"]
    port = (F.col("kind") == "port") & (F.col("layer") == "domain") if spec else F.col("kind") == "port"
    free = ~F.col("is_cross_cutting")
    counts = nodes.groupBy("repo").agg(F.count_if(free & port).alias("ports"), F.count_if(free & (F.col("layer") == "infrastructure") & F.col("kind").isin(kinds)).alias("adapters"))
    none = F.lit(None).cast("double") if spec else F.lit(100.0)
    return counts.withColumn("coverage", F.when(F.col("adapters") == 0, none).otherwise(_share(F.least("ports", "adapters"), F.greatest("ports", "adapters")) * 100))


def classification(nodes: DataFrame) -> DataFrame:
    """(repo, total, classified, cross_cutting, unclassified, coverage, unclassified_packages): over components; at most ten packages, the first by name."""
    real = nodes.where("not is_external and kind is not null")
    cc, known = F.col("is_cross_cutting"), F.col("layer").isNotNull()
    counts = real.groupBy("repo").agg(F.count("*").alias("total"), F.count_if(~cc & known).alias("classified"), F.count_if(cc).alias("cross_cutting"), F.count_if(~cc & ~known).alias("unclassified"))
    top = real.where("not is_cross_cutting and layer is null").select("repo", C.package_of(F.col("node_id")).alias("p")).distinct()
    top = top.withColumn("k", F.row_number().over(Window.partitionBy("repo").orderBy("p"))).where("k <= 10").groupBy("repo").agg(F.array_sort(F.collect_list("p")).alias("unclassified_packages"))
    share = _share(F.col("classified") + F.col("cross_cutting"), F.col("total")) * 100
    return counts.join(top, "repo", "left").select("*", share.alias("coverage")).withColumn("unclassified_packages", F.coalesce("unclassified_packages", F.array().cast("array<string>")))


def scores(components: DataFrame, dependencies: DataFrame, nodes: DataFrame, edges: DataFrame, config: Config) -> DataFrame:
    """(repo, overall, structural_presence, layer_conformance, dependency_compliance, interface_coverage), not gated; what is undefined is 100, and an undefined conformance has no weight."""
    base = nodes.select("repo").distinct()
    conform = package_conformance(components, dependencies).groupBy("repo").agg((F.avg("conformance") * 100).alias("conf"))
    all_of = base.join(conform, "repo", "left").join(compliance(edges).select("repo", "compliance"), "repo", "left").join(interface_coverage(nodes).select("repo", "coverage"), "repo", "left").join(classification(nodes).select("repo", F.col("coverage").alias("presence")), "repo", "left").na.fill(100.0, ["compliance", "coverage", "presence"])
    w1, w2, w3 = config.weights
    some = F.when(F.col("conf").isNotNull(), w1).otherwise(0.0)
    total = some + w2 + w3
    right = F.when(total > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.coalesce("conf", F.lit(0.0)) * some + F.col("compliance") * w2 + F.col("coverage") * w3) / total))).otherwise(100.0)
    overall = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("presence") * right / 100))
    return all_of.select("repo", overall.alias("overall"), F.col("presence").alias("structural_presence"), F.coalesce("conf", F.lit(100.0)).alias("layer_conformance"), F.col("compliance").alias("dependency_compliance"), F.col("coverage").alias("interface_coverage"))


def gated(score: DataFrame, patterns: DataFrame, at_least: float = 0.5) -> DataFrame:
    """Scores with null columns where no pattern is confident enough."""
    top = patterns.groupBy("repo").agg(F.max("confidence").alias("_top"))
    sure = F.coalesce(F.col("_top") >= at_least, F.lit(False))
    return score.join(top, "repo", "left").select("repo", *[F.when(sure, F.col(c)).alias(c) for c in score.columns if c != "repo"])


def kind_counts(components: DataFrame) -> DataFrame:
    return components.groupBy("repo", "kind").agg(F.count("*").alias("n"))


def layer_counts(nodes: DataFrame) -> DataFrame:
    bucket = F.when(F.col("is_cross_cutting"), "cross_cutting").otherwise(F.coalesce("layer", F.lit("unclassified")))
    return nodes.where("not is_external").groupBy("repo", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def coupling_matrix(edges: DataFrame) -> DataFrame:
    """(repo, source, domain, application, infrastructure, presentation): edges between layers, four rows a repo."""
    both = edges.where("src_layer is not null and tgt_layer is not null").groupBy("repo", F.col("src_layer").alias("source")).pivot("tgt_layer", list(LAYERS)).agg(number(edges))
    frame = edges.select("repo").distinct().withColumn("source", F.explode(F.array(*[F.lit(x) for x in LAYERS])))
    return frame.join(both, ["repo", "source"], "left").na.fill(0, list(LAYERS))


def rule_counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("repo", "rule").agg(number(violations).alias("n"))


VIOLATION_KINDS = ("layer_direction", "circular_dependency", "missing_port", "missing_implementation", "constructor_concrete", "domain_infra_leak", "init_coupling", "custom")


def violation_kinds(violations: DataFrame) -> DataFrame:
    """(repo, a count for each of eight kinds of violation); D001 to PA003 by their category, all configured rules as custom."""
    kind = F.when(F.col("rule").startswith("C-"), "custom").otherwise(F.create_map(*[F.lit(x) for pair in C.CATEGORIES.items() for x in pair])[F.col("rule")])
    return violations.groupBy("repo").agg(*[number(violations, kind == k).alias(k) for k in VIOLATION_KINDS])


def layer_flow(edges: DataFrame, real_only: bool = False) -> DataFrame:
    """(repo, source, target, n_edges, n_violations) between layers; real_only: edges between components alone."""
    rows = edges.where("src_kind is not null and tgt_kind is not null") if real_only else edges
    name = lambda c: F.coalesce(F.col(c), F.lit("unclassified"))
    return rows.groupBy("repo", name("src_layer").alias("source"), name("tgt_layer").alias("target")).agg(number(rows).alias("n_edges"), number(rows, C.violates(F.col("src_layer"), F.col("tgt_layer"))).alias("n_violations"))


def by_file(violations: DataFrame) -> DataFrame:
    """(repo, file, diagnostics) as an editor wants them, counted from 0. Equal ones are one entry with their number n, counted before entries are put together, so that a file's array grows with what is different in it."""
    zero = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(1)) - 1, F.lit(0))
    entry = ["line", "col", "severity", "rule", "message"]
    found = violations.withColumns({"line": zero("line"), "col": zero("col")}).groupBy("repo", "file", *entry).agg(number(violations).alias("n"))
    return found.groupBy("repo", "file").agg(F.array_sort(F.collect_list(F.struct(*entry, "n"))).alias("diagnostics"))
