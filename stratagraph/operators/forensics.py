"""A close look at one module or many: aggregates, imports by category, domain patterns, improvements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.functions import classify as C
from stratagraph.operators.graph import lengths_of, substrings

CATEGORIES = ("stdlib", "internal_domain", "internal_application", "internal_infrastructure", "external")


def classified_imports(dependencies: DataFrame) -> DataFrame:
    return dependencies.where("import_path is not null").withColumn("category", C.import_category(F.col("import_path")))


def entity_value_objects(components: DataFrame) -> DataFrame:
    """(repo, entity_id, value_object): value objects whose name is in a field type of an entity: an equi-join with the types' substrings of lengths that the names have."""
    types = components.where("kind = 'entity'").select("repo", F.col("component_id").alias("entity_id"), F.explode("fields.type_name").alias("t")).distinct()
    words = types.select("repo", "t").distinct()
    objects = components.where("kind = 'value_object'").select("repo", F.col("name").alias("value_object")).distinct()
    inside = substrings(words, "t", "value_object", lengths_of(objects, "value_object")).join(objects, ["repo", "value_object"], "left_semi").distinct()
    return types.join(inside, ["repo", "t"]).select("repo", "entity_id", "value_object").distinct()


def dependency_audit(components: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(repo, entity_id, a list of imports per category, is_clean): the imports of an entity's file; clean without infrastructure imports."""
    entities = components.where("kind = 'entity'").select("repo", "file", F.col("component_id").alias("entity_id")).distinct()
    lists = classified_imports(dependencies).groupBy("repo", "file").agg(*[F.array_sort(F.collect_set(F.when(F.col("category") == c, F.col("import_path")))).alias(c) for c in CATEGORIES])
    none = F.array().cast("array<string>")
    both = entities.join(lists, ["repo", "file"], "left").select("repo", "entity_id", *[F.coalesce(c, none).alias(c) for c in CATEGORIES])
    return both.withColumn("is_clean", F.size("internal_infrastructure") == 0)


def domain_patterns(components: DataFrame) -> DataFrame:
    """(repo, component_id, pattern, detected), four rows an entity."""
    methods = F.size("methods")
    factory = F.exists("methods", lambda m: m["name"].startswith("New") | m["name"].startswith("Create"))
    rows = F.array(*[F.struct(F.lit(n).alias("pattern"), d.alias("detected")) for n, d in (("rich model", methods > 0), ("factory method", factory), ("identity", C.has_identity(F.col("fields"))), ("encapsulation", methods >= 2))])
    return components.where("kind = 'entity'").select("repo", "component_id", F.explode(rows).alias("r")).select("repo", "component_id", "r.pattern", "r.detected")


def unserved_ports(components: DataFrame) -> DataFrame:
    """Ports that no adapter states by exact name."""
    stated = components.where("kind = 'adapter'").select("repo", F.explode("implements").alias("name")).distinct()
    return components.where("kind = 'port'").join(stated, ["repo", "name"], "left_anti")


def _bucket():
    names = {"domain_event": "events", "port": "ports", "entity": "entities", "value_object": "value_objects", "use_case": "application_services", "service": "application_services", "adapter": "adapters", "repository": "adapters"}
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("kind")]


def buckets(components: DataFrame) -> DataFrame:
    """(repo, bucket, members) of the report's lists."""
    return components.groupBy("repo", _bucket().alias("bucket")).agg(F.array_sort(F.collect_list("component_id")).alias("members"))


def listed(components: DataFrame) -> DataFrame:
    """(repo, bucket, component_id, name, kind, file, line): the members of the report's lists as rows."""
    return components.withColumn("bucket", _bucket()).select("repo", "bucket", "component_id", "name", "kind", "file", "line")


def improvements(components: DataFrame, leaks: DataFrame) -> DataFrame:
    """(repo, ord, subject, advice) from six generators; leaks are violations of rule L005."""
    def rows(df: DataFrame, k: int, subject, advice: str) -> DataFrame:
        return df.select("repo", F.lit(k).alias("ord"), subject.alias("subject"), F.lit(advice).alias("advice"))

    entities = components.where("kind = 'entity'")
    eventless = entities.select("repo").distinct().join(components.where("kind = 'domain_event'").select("repo").distinct(), "repo", "left_anti")
    parts = [
        rows(entities.where((F.col("layer") == "domain") & (F.size("methods") == 0)), 1, F.col("name"), "move behaviour into this type, it has none"),
        rows(eventless, 2, F.lit(""), "publish events when aggregates change"),
        rows(components.where((F.col("kind").isin("adapter", "repository")) & (F.col("layer") == "infrastructure") & (F.size("implements") == 0)), 3, F.col("name"), "give this adapter a port"),
        rows(leaks.where("rule = 'L005'"), 4, F.col("message"), "keep stores out of the domain"),
        rows(entities.where(F.size("fields") > 10), 5, F.col("name"), "split this type into value objects"),
        rows(unserved_ports(components), 6, F.col("name"), "implement this port"),
    ]
    return reduce(DataFrame.unionByName, parts)
