"""Dependencies that are counted give what each of them alone gives, in rows of bounded size."""

import json

import pytest
from oracle import DATA, rows_of
from pyspark.sql import functions as F

from stratagraph.operators import graph, metrics, rules
from stratagraph.plans import analysis, testmap
from stratagraph.plans import queries as Q
from stratagraph.reports import render


@pytest.fixture(scope="module")
def both(spark):
    """Two analyses of the same facts, in which every dependency is there three times: as they are, and counted."""
    c, d = testmap.components(spark, str(DATA)), testmap.dependencies(spark, str(DATA))
    d = d.union(d.withColumn("seq", F.col("seq") + 10_000_000)).union(d.withColumn("seq", F.col("seq") + 20_000_000))
    return analysis.Analysis(c, d, Q.CONFIG), analysis.Analysis(c, graph.counted(d), Q.CONFIG)


def test_json_rows_are_the_whole_report(both):
    for a in both:
        whole = {r.repo: json.loads(r.report) for r in render.json_frame(a).collect()}
        rows = sorted(render.json_rows(a, 2).collect(), key=lambda r: tuple((x is not None, x) for x in r.place))
        for repo, report in whole.items():
            own = [r for r in rows if r.repo == repo]
            assert [json.loads(r.text) for r in own if r.section == "head"] == [{k: v for k, v in report.items() if k not in ("violations", "package_metrics")}]
            for section in ("violations", "package_metrics"):
                parts = [json.loads(r.text) for r in own if r.section == section]
                assert [x for p in parts for x in p] == report[section] and max(map(len, parts)) <= 2
        assert json.loads(render.as_json(a)) == whole
    assert json.loads(render.as_json(both[0])) == json.loads(render.as_json(both[1]))


def test_json_report_makes_no_text_of_a_repository(spark):
    plan = Q.QUERIES["json_report"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "collect_list" in line and "severity" in line]


def test_a_row_that_stands_for_many_is_dealt_out(spark):
    v = spark.createDataFrame([("a", 10_000), ("b", 1)], "x string, n bigint")
    assert {(r.x, r["count"]) for r in rules.each(v).groupBy("x").count().collect()} == {("a", 10_000), ("b", 1)}
    parts = rules.dealt(v, 256)
    assert sorted((r.x, r.n) for r in parts.collect()) == [("a", 10_000 % 256)] + [("a", 256)] * (10_000 // 256) + [("b", 1)]
    assert parts.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_counted_edges_give_the_same(both):
    plain, few = both
    assert few.edges.count() < plain.edges.count() and rows_of(plain.nodes) == rows_of(few.nodes)
    for f in (metrics.compliance, metrics.coupling_matrix, metrics.layer_flow):
        assert rows_of(f(plain.edges)) == rows_of(f(few.edges))
    assert rows_of(graph.depth_metrics(plain.nodes, plain.edges)) == rows_of(graph.depth_metrics(few.nodes, few.edges))
    assert rows_of(plain.violations) == rows_of(rules.each(few.violations)) and rows_of(plain.summary) == rows_of(few.summary)
    assert rows_of(plain.violation_kinds()) == rows_of(few.violation_kinds()) and rows_of(plain.improvements()) == rows_of(few.improvements())
    assert render.text(plain) == render.text(few) and render.check(plain) == render.check(few)


def test_queries_on_edges_read_dependencies_once(spark):
    """They read what Facts has counted, not the dependencies again for each rule."""
    for name in ("infra_leak", "diagnostics_by_file", "layer_violations", "edge_join"):
        assert not [p for p in Q.QUERIES[name](spark, str(DATA)).inputFiles() if "lineitem" in p], name


def test_leaks_of_both_kinds(spark):
    e = spark.createDataFrame([(x, 2) for x in ("x.io/mongo", "x.io/y")], "import_path string, n bigint").select(
        F.lit("r").alias("repo"), F.lit("domain::<file>").alias("from_id"), F.lit("t").alias("to_id"), "import_path", F.lit("f").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("col"), F.lit("s").alias("src_name"), F.lit("MongoUsers").alias("tgt_name"),
        F.lit("domain").alias("src_layer"), F.lit("infrastructure").alias("tgt_layer"), F.lit("ddd").alias("src_architecture_mode"), *[F.lit(False).alias(f"{x}_{y}") for x in ("src", "tgt") for y in ("is_external", "is_cross_cutting")], "n",
    )
    got = rules.infrastructure_leaks(e, Q.CONFIG)
    assert rows_of(rules.each(got)) == rows_of(rules.each(rules.infrastructure_imports(e, Q.CONFIG).unionByName(rules.concrete_targets(e, Q.CONFIG)))) and rules.each(got).count() == 6


def test_diagnostics_of_a_file(both, spark):
    """Equal diagnostics are one entry with their number; none is lost."""
    plain, few = (rows_of(metrics.by_file(a.violations)) for a in both)
    assert plain == few
    v = spark.createDataFrame([("r", "a.go", k % 3 + 1, 1, "error", "L001", "m") for k in range(3000)] + [("r", "a.go", None, 1, "error", "L002", "m"), ("r", None, 1, 1, "info", "L001", "m")], "repo string, file string, line int, col int, severity string, rule string, message string")
    got = {r.file: [(d.line, d.rule, d.n) for d in r.diagnostics] for r in metrics.by_file(v).collect()}
    assert got == {"a.go": [(0, "L001", 1000), (0, "L002", 1), (1, "L001", 1000), (2, "L001", 1000)], None: [(0, "L001", 1)]}
