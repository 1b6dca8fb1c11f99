"""Renderers. Whole reports, nothing is cut off; rows come to the driver a partition at a time."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from stratagraph.functions import classify as C
from stratagraph.operators import forensics, metrics, rules
from stratagraph.operators.metrics import VIOLATION_KINDS
from stratagraph.plans.analysis import Analysis
from stratagraph.sources import tree
from stratagraph.tables import dealt

PARTS = {"overall": "Overall", "structural_presence": "Structural presence", "layer_conformance": "Layer conformance", "dependency_compliance": "Dependency compliance", "interface_coverage": "Interface coverage"}
VIOLATION = ["file", "line", "col", "rule", "rule_name", "severity", "message", "suggestion", "doc_url"]
PACKAGE = ["package", "abstractness", "instability", "distance", "zone"]
MARKS = {"error": "E", "warning": "W", "info": "I"}


def _number(x: float | None) -> str:
    return "—" if x is None else f"{x:.1f}"


def _violations(v: DataFrame) -> Iterator[Row]:
    return rules.each(v).orderBy(F.desc("severity_ord"), "repo", "file", "line", "rule", "subject", "message").toLocalIterator()


def text(a: Analysis) -> str:
    out: list[str] = []
    packages: dict[str, list[Row]] = {}
    for p in a.package_metrics.orderBy("repo", "package").toLocalIterator():
        packages.setdefault(p.repo, []).append(p)
    for s in a.summary.orderBy("repo").toLocalIterator():
        out.append(f"== {s.repo} ==")
        if not s.component_count:
            out.append("Nothing was found to analyse.")
            continue
        if s.overall is None:
            out.append(f"No score: the surest pattern is {s.top_pattern} at {s.top_confidence or 0:.2f}, which is too unsure.")
        else:
            out += [f"{label}: {_number(s[key])}" for key, label in PARTS.items()]
            out.append(f"Pattern: {s.top_pattern} ({s.top_confidence:.2f})")
        out.append(f"{s.component_count} nodes, {s.dependency_count} dependencies, {s.violation_count} violations")
        for p in packages.get(s.repo, []):
            out.append(f"  {p.package}: A={p.abstractness:.2f} I={p.instability:.2f} D={p.distance:.2f}" + (f" (zone of {p.zone})" if p.zone else ""))
    out += [f"[{MARKS[v.severity]}] {v.rule} {v.file}:{v.line} {v.message}" for v in _violations(a.violations)]
    return "\n".join(out) + "\n"


def check(a: Analysis, fail_on: str | None = None, ignore: list[str] | None = None) -> tuple[str, int]:
    """The result of a gate and its exit code: 1 if a violation reaches the severity, or a score the configured minimum not."""
    rows = _violations(a.failing(fail_on, ignore))
    low = [s for s in a.summary.collect() if a.config.min_score is not None and s.overall is not None and s.overall < a.config.min_score]
    lines = [f"{v.rule} {v.file}:{v.line} {v.message}" for v in rows] + [f"{s.repo}: score {_number(s.overall)} is below {a.config.min_score:g}" for s in low]
    return "\n".join([*lines, "FAILED" if lines else "PASSED"]) + "\n", int(bool(lines))


def score_line(a: Analysis, as_json: bool = False) -> str:
    rows = a.summary.select("repo", "overall").orderBy("repo").collect()
    return json.dumps({r.repo: r.overall or 0.0 for r in rows}) if as_json else "\n".join(f"{r.repo} {r.overall or 0.0:.1f}" for r in rows)


def _head(a: Analysis) -> DataFrame:
    """(repo, and the report's parts that are small whatever the repository)."""
    k = a.patterns.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("name", "confidence"))).alias("patterns"))
    kinds = metrics.kind_counts(a.components).groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("components_by_kind"))
    layers = metrics.layer_counts(a.nodes).groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "n")))).alias("components_by_layer"))
    score = F.when(F.col("overall").isNotNull(), F.struct(*PARTS)).alias("score")
    s = a.summary.select("repo", score, "component_count", "dependency_count", "top_pattern", "top_confidence")
    for x in (k, kinds, layers):
        s = s.join(x, "repo", "left")
    return s


def _json(rows: DataFrame) -> Column:
    return F.to_json(F.struct(*[c for c in rows.columns if c != "repo"]))


def json_frame(a: Analysis) -> DataFrame:
    """(repo, report): one JSON text a repository, put together by Spark. A repository's whole report must fit a task's memory and Spark's 2 GB for a value; json_rows has no such bound."""
    v = rules.each(a.violations).groupBy("repo").agg(F.array_sort(F.collect_list(F.struct(*VIOLATION))).alias("violations"))
    p = a.package_metrics.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct(*PACKAGE))).alias("package_metrics"))
    s = _head(a).join(v, "repo", "left").join(p, "repo", "left")
    return s.select("repo", _json(s).alias("report"))


def json_rows(a: Analysis, most: int = 256) -> DataFrame:
    """(repo, section, place, text): the same report in rows of bounded size, put together by no one task.

    The section "head" is an object, a row a repository. The rows of "package_metrics" and of "violations" are arrays,
    which one after the other, in the order of place, are those of the report. Equal violations, neighbours in that
    order, are up to most in a row.
    """
    head, p = _head(a), a.package_metrics.select("repo", *PACKAGE)
    v = a.violations.select("repo", *VIOLATION, *([] if "n" not in a.violations.columns else ["n"]))
    if "n" in v.columns:
        v = dealt(v, most)
    one = F.to_json(F.struct(*VIOLATION))
    texts = F.array_join(F.array_repeat(one, F.col("n").cast("int")), ",") if "n" in v.columns else one
    kinds = dict(a.violations.dtypes)
    place = lambda **has: F.struct(*[has.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in VIOLATION])
    return (
        head.select("repo", F.lit("head").alias("section"), place().alias("place"), _json(head).alias("text"))
        .union(p.select("repo", F.lit("package_metrics"), place(file=F.col("package")), F.concat(F.lit("["), F.to_json(F.struct(*PACKAGE)), F.lit("]"))))
        .union(v.select("repo", F.lit("violations"), place(**{c: F.col(c) for c in VIOLATION}), F.concat(F.lit("["), texts, F.lit("]"))))
    )


def as_json(a: Analysis, pretty: bool = False) -> str:
    rows: dict[str, dict] = {}
    for r in json_rows(a).orderBy("repo", "section", "place").toLocalIterator():
        if r.section == "head":
            rows.setdefault(r.repo, {}).update(json.loads(r.text))
        else:
            rows.setdefault(r.repo, {}).setdefault(r.section, []).extend(json.loads(r.text))
    return json.dumps(rows, indent=2 if pretty else None, sort_keys=True)


def _table(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(str(x).replace("|", "\\|") for x in r) + " |" for r in rows), ""]


def markdown(a: Analysis) -> str:
    out = ["# Architecture", ""]
    summary = a.summary.orderBy("repo").collect()
    out += _table(["Repository", *PARTS.values(), "Pattern", "Violations"], [[s.repo, *[_number(s[k]) for k in PARTS], s.top_pattern or "—", s.violation_count] for s in summary])
    out += ["## Packages", "", *_table(["Repository", "Package", "A", "I", "D", "Zone"], [[p.repo, p.package, f"{p.abstractness:.2f}", f"{p.instability:.2f}", f"{p.distance:.2f}", p.zone or ""] for p in a.package_metrics.orderBy("repo", "package").collect()])]
    out += ["## Violations", "", *_violation_table(a.violations)]
    return "\n".join(out) + "\n"


def _violation_table(v: DataFrame) -> list[str]:
    return _table(["Rule", "Severity", "Place", "Message"], [[v.rule, v.severity, f"{v.file}:{v.line}", v.message] for v in _violations(v)])


def check_markdown(a: Analysis, passed: bool, fail_on: str | None = None, ignore: list[str] | None = None) -> str:
    """The result of a gate, what failed it, and counts by kind of violation."""
    counts = a.violation_kinds().orderBy("repo").toLocalIterator()
    out = [f"# Check {'passed' if passed else 'failed'}", "", *_table(["Repository", *VIOLATION_KINDS], [[r.repo, *[r[k] for k in VIOLATION_KINDS]] for r in counts])]
    return "\n".join([*out, "## Failing violations", "", *_violation_table(a.failing(fail_on, ignore))]) + "\n"


def _drawn(a: Analysis, spec: bool) -> tuple[list, list]:
    """Nodes (repo, id, layer) and edges (a, b, wrong) of a layer diagram: components alone, or under spec packages, whose edges real code has."""
    if spec:
        from stratagraph.operators import graph

        nodes = a.components.groupBy("repo", F.col("package").alias("id")).agg(F.min("layer").alias("layer"))
        pairs = graph.package_edges(a.dependencies, a.components)
        layer = lambda c: nodes.select("repo", F.col("id").alias(c), F.col("layer").alias(f"l{c}"))
        edges = pairs.join(layer("a"), ["repo", "a"]).join(layer("b"), ["repo", "b"]).select("a", "b", F.coalesce(C.violates(F.col("la"), F.col("lb")), F.lit(False)).alias("wrong"))
    else:
        nodes = a.nodes.where("kind is not null").select("repo", F.col("node_id").alias("id"), "layer")
        edges = a.edges.where("src_kind is not null and tgt_kind is not null").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.coalesce(C.violates(F.col("src_layer"), F.col("tgt_layer")), F.lit(False)).alias("wrong"))
    return nodes.select("id", "layer", C.mermaid_id(F.col("id")).alias("m"), C.dot_id(F.col("id")).alias("d"), C.short_label(F.col("id")).alias("label")).orderBy("layer", "id").collect(), edges.distinct().select("a", "b", "wrong", C.mermaid_id(F.col("a")).alias("ma"), C.mermaid_id(F.col("b")).alias("mb"), C.dot_id(F.col("a")).alias("da"), C.dot_id(F.col("b")).alias("db")).orderBy("a", "b").collect()


def mermaid(a: Analysis, spec: bool = False) -> str:
    nodes, edges = _drawn(a, spec)
    out = ["flowchart TB"]
    for layer in dict.fromkeys(n.layer for n in nodes):
        out += [f"  subgraph {layer or 'unclassified'}", *(f'    {n.m}["{n.label}"]' for n in nodes if n.layer == layer), "  end"]
    return "\n".join(out + [f"  {e.ma} {'-.->|breaks a layer|' if e.wrong else '-->'} {e.mb}" for e in edges]) + "\n"


def dot(a: Analysis, spec: bool = False) -> str:
    nodes, edges = _drawn(a, spec)
    out = ["digraph layers {", "  rankdir=TB;"]
    for layer in dict.fromkeys(n.layer for n in nodes):
        out += [f"  subgraph cluster_{layer or 'unclassified'} {{", f'    label="{layer or "unclassified"}";', *(f'    {n.d} [label="{n.label}"];' for n in nodes if n.layer == layer), "  }"]
    return "\n".join(out + [f"  {e.da} -> {e.db}{' [color=red, style=dashed]' if e.wrong else ''};" for e in edges] + ["}"]) + "\n"


def flow(a: Analysis, form: str = "mermaid") -> str:
    """Counts of edges and violations from layer to layer."""
    rows = metrics.layer_flow(a.edges).groupBy("source", "target").agg(F.sum("n_edges").alias("n"), F.sum("n_violations").alias("bad")).orderBy("source", "target").collect()
    say = lambda r: f"{r.n}" + (f", {r.bad} wrong" if r.bad else "")
    if form == "dot":
        return "\n".join(["digraph flow {", *(f'  {r.source} -> {r.target} [label="{say(r)}"{", color=red" if r.bad else ""}];' for r in rows), "}"]) + "\n"
    return "\n".join(["flowchart LR", *(f"  {r.source} -->|{say(r)}| {r.target}" for r in rows)]) + "\n"


def forensic_markdown(a: Analysis) -> str:
    """The whole forensic report: files, lists by kind, aggregates with their imports, value objects, patterns, violations, improvements."""
    out = ["# Forensics", "", "## Files", ""]
    if a.files is not None:
        out += [f"{'  ' * r.depth}- {r.path.rsplit('/', 1)[-1]}{'/' if r.is_dir else ''}" for r in tree.listing(a.files).toLocalIterator()]
    lists = forensics.listed(a.components)
    for bucket, title in (("events", "Domain events"), ("ports", "Ports"), ("application_services", "Application services"), ("adapters", "Adapters")):
        rows = lists.where(F.col("bucket") == bucket).orderBy("repo", "component_id").toLocalIterator()
        out += ["", f"## {title}", "", *_table(["Name", "Kind", "Place"], [[r.name, r.kind, f"{r.file}:{r.line}"] for r in rows])]
    out += ["## Aggregates", ""]
    audit = forensics.dependency_audit(a.components, a.dependencies)
    out += _table(["Entity", "Clean", "Domain", "Application", "Infrastructure", "External"], [[r.entity_id, "yes" if r.is_clean else "no", *[", ".join(r[c]) for c in forensics.CATEGORIES[1:]]] for r in audit.orderBy("repo", "entity_id").toLocalIterator()])
    out += ["## Value objects", "", *_table(["Entity", "Value object"], [[r.entity_id, r.value_object] for r in forensics.entity_value_objects(a.components).orderBy("repo", "entity_id", "value_object").toLocalIterator()])]
    out += ["## Patterns", "", *_table(["Entity", "Pattern", "Found"], [[r.component_id, r.pattern, "yes" if r.detected else "no"] for r in forensics.domain_patterns(a.components).orderBy("repo", "component_id", "pattern").toLocalIterator()])]
    out += ["## Violations", "", *_violation_table(a.violations)]
    out += ["## Improvements", "", *(f"- {r.subject}: {r.advice}" if r.subject else f"- {r.advice}" for r in a.improvements().orderBy("repo", "ord", "subject").toLocalIterator()), ""]
    return "\n".join(out)


def services(a: Analysis, total: DataFrame, shared: DataFrame, form: str = "text") -> str:
    """Scores of each service and of all, and the modules that they share."""
    rows, t, modules = a.summary.orderBy("repo").collect(), total.first(), shared.orderBy("module").collect()
    if form == "json":
        return json.dumps({"services": {r.repo: {"overall": r.overall, "components": r.component_count, "violations": r.violation_count} for r in rows}, "overall": t.overall if t else 100.0, "shared_modules": {m.module: m.used_by for m in modules}}, sort_keys=True) + "\n"
    table = [[r.repo, _number(r.overall), r.component_count, r.violation_count] for r in rows] + ([["all", _number(t.overall), t.component_count, sum(r.violation_count for r in rows)]] if t else [])
    if form == "markdown":
        return "\n".join(["# Services", "", *_table(["Service", "Score", "Nodes", "Violations"], table), "## Shared modules", "", *_table(["Module", "Used by"], [[m.module, ", ".join(m.used_by)] for m in modules])])
    return "\n".join([*(f"{name}: {score} ({n} nodes, {v} violations)" for name, score, n, v in table), *(f"shared: {m.module} ({', '.join(m.used_by)})" for m in modules)]) + "\n"
