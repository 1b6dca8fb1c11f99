"""The rules: every one is a query over nodes and edges that gives rows of one violation schema."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.config import Config
from stratagraph.functions import classify as C
from stratagraph.functions.globs import any_of
from stratagraph.operators.graph import lengths_of, substrings
from stratagraph.tables import dealt

COLUMNS = ["repo", "rule", "severity", "file", "line", "col", "subject", "message", "suggestion"]


@dataclass
class Rule:
    """What one rule says about a row: when it is broken, and the columns of the violation."""

    broken: Column
    rule: Column | str
    severity: Column | str
    subject: Column
    message: Column
    suggestion: str | None

    def entry(self) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(lit(self.rule).alias("rule"), lit(self.severity).alias("severity"), self.subject.alias("subject"), self.message.alias("message"), F.lit(self.suggestion).cast("string").alias("suggestion"))


def applied(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """The violations of all rules, from one pass over the rows. Rows with a column n give violations with it; each() makes rows of these."""
    n = [c for c in rows.columns if c == "n"]
    if len(rules) == 1:
        return rows.where(rules[0].broken).select("repo", "file", "line", "col", *n, rules[0].entry().alias("v")).select("repo", "v.rule", "v.severity", "file", "line", "col", "v.subject", "v.message", "v.suggestion", *n)
    any_broken = reduce(lambda a, b: a | b, [r.broken for r in rules])
    hits = F.explode(F.filter(F.array(*[F.when(r.broken, r.entry()) for r in rules]), lambda x: x.isNotNull()))
    return rows.where(any_broken).select("repo", "file", "line", "col", *n, hits.alias("v")).select("repo", "v.rule", "v.severity", "file", "line", "col", "v.subject", "v.message", "v.suggestion", *n)


def each(violations: DataFrame) -> DataFrame:
    """A row for every violation, where a row stands for n equal ones."""
    if "n" not in violations.columns:
        return violations
    rest = [c for c in violations.columns if c != "n"]
    return dealt(violations, 4096).select(*rest, F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("_one")).select(*rest)


def _violation(rows: DataFrame, rule: Column | str, severity: Column | str, subject: Column, message: Column, suggestion: str | None) -> DataFrame:
    return applied(rows, [Rule(F.lit(True), rule, severity, subject, message, suggestion)])


def _say(pattern: str, *cols) -> Column:
    return F.format_string(pattern, *[F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("?")) for c in cols])


def _true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _layer_rule(config: Config) -> Rule:
    s, t = F.col("src_layer"), F.col("tgt_layer")
    wrong = (
        ~F.col("src_is_external") & ~F.col("tgt_is_external") & ~F.col("src_is_cross_cutting") & ~F.col("tgt_is_cross_cutting") & ~F.col("from_id").contains("<init>")
        & ~F.col("src_architecture_mode").eqNullSafe("service-oriented") & _true(C.violates(s, t)) & ~_true((F.col("src_architecture_mode") == "active-record") & (s == "domain") & (t == "infrastructure"))
    )
    rule = C.rule_of_layers(s, t)
    names = ["L001", "L002", "L003", "L099"]
    severity = reduce(lambda a, r: F.when(rule == r, C.severity_of(r, config, "error")).otherwise(a), names, F.lit("error"))
    return Rule(wrong, rule, severity, F.col("from_id"), _say("%s code reaches out to the %s layer (%s)", "src_layer", "tgt_layer", F.coalesce("import_path", "to_id")), "Turn the dependency round with an interface in the inner layer.")


def layer_violations(edges: DataFrame, config: Config) -> DataFrame:
    """L001, L002, L003 and L099: an inner layer that depends on an outer one."""
    return applied(edges, [_layer_rule(config)])


def cycles(components: DataFrame, nodes: DataFrame, config: Config) -> DataFrame:
    """D001: strongly connected components, as operators.graph.strongly_connected gives them."""
    at = nodes.select("repo", F.col("node_id").alias("component"), "file", "line", "col")
    found = components.join(at, ["repo", "component"], "left")
    return _violation(found, "D001", C.severity_of("D001", config, "error"), F.col("component"), _say("Dependency cycle: %s", F.concat_ws(" -> ", "members", F.col("members")[0])), "Cut the cycle at its weakest edge.")


def port_names(nodes: DataFrame) -> DataFrame:
    low = F.lower("name")
    is_port = _true(F.col("kind") == "port") | low.contains("port") | low.contains("interface") | (low.contains("repository") & _true(F.col("layer") == "domain"))
    return nodes.where(is_port).select("repo", low.alias("port"), C.port_base(F.col("name")).alias("port_base")).distinct()


def missing_ports(nodes: DataFrame, components: DataFrame, config: Config, spec: bool = False) -> DataFrame:
    """PA001: adapters of the infrastructure layer that have no port.

    A port fits if its name without the usual endings equals the adapter's, or if the adapter's name contains the port's.
    Both are equi-joins: on the base, and of the adapter's substrings, of lengths that ports have, with the ports' names. spec leaves out ends of
    dependencies, which are no components.
    """
    low = F.lower("name")
    by_name = low.rlike("(handler|controller)$") | low.contains("adapter") | low.contains("impl")
    kinds = _true(F.col("kind").isin("adapter", "repository"))
    chosen = nodes.where(~F.col("is_cross_cutting") & _true(F.col("layer") == "infrastructure") & (kinds | by_name))
    if spec:
        chosen = chosen.where("kind is not null")
    stated = components.where((F.col("kind") == "adapter") & ((F.size("implements") > 0) | F.col("returns_concrete").isNotNull())).select("repo", F.col("component_id").alias("node_id")).distinct()
    chosen = chosen.join(stated, ["repo", "node_id"], "left_anti")
    ports = port_names(nodes)
    names = chosen.select("repo", "name").distinct().withColumn("low", low)
    by_base = names.withColumn("port_base", C.adapter_base(F.col("name"))).where("port_base <> ''").join(ports, ["repo", "port_base"], "left_semi").select("repo", "name")
    inside = substrings(names, "low", "port", lengths_of(ports, "port")).join(ports, ["repo", "port"], "left_semi").select("repo", "name")
    lone = chosen.join(by_base.union(inside).distinct(), ["repo", "name"], "left_anti")
    return _violation(lone, "PA001", C.severity_of("PA001", config, "warning"), F.col("name"), _say("No port fits the adapter %s", "name"), "Declare an interface for it.")


def concrete_constructors(components: DataFrame, config: Config) -> DataFrame:
    """PA003: adapters whose constructor gives a concrete type."""
    rows = components.where((F.col("kind") == "adapter") & F.col("returns_concrete").isNotNull())
    return _violation(rows, "PA003", C.severity_of("PA003", config, "warning"), F.col("name"), _say("The constructor of %s gives the concrete type %s", "name", "returns_concrete"), "Let it return the port.")


def unimplemented_ports(nodes: DataFrame, components: DataFrame, config: Config) -> DataFrame:
    """PA002: ports of the domain layer that nothing implements: by statement, by equal bases, or by an adapter whose name contains the port's name or base."""
    ports = nodes.where(~F.col("is_cross_cutting") & _true((F.col("kind") == "port") & (F.col("layer") == "domain")))
    stated = components.where("kind = 'adapter'").select("repo", F.explode("implements").alias("name")).distinct()
    ports = ports.join(stated, ["repo", "name"], "left_anti")
    adapters = nodes.where(_true((F.col("layer") == "infrastructure") & F.col("kind").isin("adapter", "repository"))).select("repo", F.lower("name").alias("low"), C.adapter_base(F.col("name")).alias("base")).distinct()
    names = ports.select("repo", "name").distinct().select("repo", "name", F.lower("name").alias("low"), C.port_base(F.col("name")).alias("base"))
    wanted = names.select("repo", "name", F.explode(F.array_distinct(F.array("low", "base"))).alias("key")).where("key <> ''")
    keys = substrings(adapters, "low", "key", lengths_of(wanted, "key")).select("repo", "key").union(adapters.where("base <> ''").select("repo", F.col("base").alias("key"))).distinct()
    met = wanted.join(keys, ["repo", "key"], "left_semi").select("repo", "name").distinct()
    open_ports = ports.join(met, ["repo", "name"], "left_anti")
    return _violation(open_ports, "PA002", C.severity_of("PA002", config, "info"), F.col("name"), _say("Nothing in the infrastructure layer implements %s", "name"), "Implement the port or remove it.")


def _import_rule(config: Config) -> Rule:
    broken = ~F.col("src_is_external") & ~F.col("src_is_cross_cutting") & ~F.col("src_architecture_mode").eqNullSafe("active-record") & _true(F.col("src_layer") == "domain") & _true(F.lower("import_path").rlike(C.STORES))
    return Rule(broken, "L005", C.severity_of("L005", config, "error"), F.col("from_id"), _say("Domain code imports the store %s", "import_path"), "Put a repository port between them.")


def infrastructure_imports(edges: DataFrame, config: Config) -> DataFrame:
    """L005: domain code that imports a path which names a data store."""
    return applied(edges, [_import_rule(config)])


def _target_rule(config: Config) -> Rule:
    broken = (
        ~F.col("src_is_external") & ~F.col("tgt_is_external") & ~F.col("src_is_cross_cutting") & ~F.col("tgt_is_cross_cutting") & ~F.col("src_architecture_mode").eqNullSafe("active-record")
        & _true((F.col("src_layer") == "domain") & (F.col("tgt_layer") == "infrastructure")) & _true(F.lower("tgt_name").rlike(C.CONCRETE))
    )
    return Rule(broken, "L005", C.severity_of("L005", config, "error"), F.col("from_id"), _say("Domain node %s is tied to %s", "src_name", "tgt_name"), "Put a repository port between them.")


def concrete_targets(edges: DataFrame, config: Config) -> DataFrame:
    """L005: domain code that depends on an infrastructure node named for a product."""
    return applied(edges, [_target_rule(config)])


def infrastructure_leaks(edges: DataFrame, config: Config) -> DataFrame:
    """L005: both kinds, from one pass over the edges; an edge that is of both gives two rows."""
    return applied(edges, [_import_rule(config), _target_rule(config)])


def _init_rule(config: Config) -> Rule:
    broken = F.lit(config.detect_init) & F.col("from_id").contains("<init>") & ~F.col("src_is_cross_cutting") & ~F.col("tgt_is_cross_cutting") & _true(C.violates(F.col("src_layer"), F.col("tgt_layer")))
    return Rule(broken, "L004", C.severity_of("L004", config, "warning"), F.col("from_id"), _say("An init function of the %s layer calls into %s (%s)", "src_layer", "tgt_layer", "to_id"), "Pass the dependency in instead.")


def init_coupling(edges: DataFrame, config: Config) -> DataFrame:
    """L004: Go init functions that reach an outer layer."""
    return applied(edges, [_init_rule(config)])


def _custom_rules(config: Config) -> list[Rule]:
    bad = [r.name for r in config.custom_rules if not (_compiles(r.from_pattern) and _compiles(r.to_pattern))]
    if bad:
        warnings.warn(f"custom rules are off, these don't compile: {', '.join(bad)}", stacklevel=3)
        return []
    target = F.coalesce("import_path", "to_id")
    return [
        Rule(F.col("from_id").rlike(r.from_pattern) & target.rlike(r.to_pattern), f"C-{r.name}", r.severity, F.col("from_id"), F.lit(r.message) if r.message else _say(f"{r.name.replace('%', '%%')}: %s must not reach %s", "from_id", target), None)
        for r in config.custom_rules
    ]


def custom_violations(edges: DataFrame, config: Config) -> DataFrame:
    """C-name: edges whose ends match a configured pair of expressions; one that does not compile turns all custom rules off, with a warning."""
    found = _custom_rules(config)
    return applied(edges, found) if found else _violation(edges.where(F.lit(False)), "C-", "error", F.col("from_id"), F.lit(""), None)


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def without_ignored(violations: DataFrame, config: Config) -> DataFrame:
    """Leaves out violations of a rule in files that its ignore globs match."""
    out = violations
    for i in config.ignore:
        pattern = any_of(i.paths)
        if pattern:
            out = out.where(~((F.col("rule") == i.rule) & _true(F.col("file").rlike(pattern))))
    return out


def without_rules(violations: DataFrame, rules: list[str]) -> DataFrame:
    return violations.where(~F.col("rule").isin(list(rules))) if rules else violations


def failing(violations: DataFrame, fail_on: str) -> DataFrame:
    """Violations at or above a severity."""
    return violations.where(C.severity_order(F.col("severity")) >= C.severity_order(F.lit(fail_on)))


def described(violations: DataFrame) -> DataFrame:
    return violations.withColumn("rule_name", C.rule_name(F.col("rule"))).withColumn("doc_url", C.doc_url(F.col("rule"))).withColumn("severity_ord", C.severity_order(F.col("severity")))


def all_violations(components: DataFrame, nodes: DataFrame, edges: DataFrame, config: Config, cyclic: DataFrame | None = None) -> DataFrame:
    """All rules, less what the configuration ignores; those on edges in one pass over them. cyclic: strongly connected components, if they are wanted."""
    parts = [applied(edges, [_layer_rule(config), _import_rule(config), _target_rule(config), _init_rule(config), *_custom_rules(config)])]
    if cyclic is not None:
        parts.append(cycles(cyclic, nodes, config))
    parts += [missing_ports(nodes, components, config), concrete_constructors(components, config), unimplemented_ports(nodes, components, config)]
    if "n" in edges.columns:
        parts = [p if "n" in p.columns else p.withColumn("n", F.lit(1).cast("bigint")) for p in parts]
    return without_ignored(reduce(DataFrame.unionByName, parts), config)
