"""One query per operator over the stand-in facts of testmap, and the SQL that a plain SQL engine runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.config import Config, CustomRule, Ignore, LayerOverride
from stratagraph.functions import classify as C
from stratagraph.operators import forensics, graph, history, metrics, patterns, rules, services
from stratagraph.plans import testmap
from stratagraph.tables import parquet, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CONFIG = Config(custom_rules=(CustomRule("no-drivers", "^svc[0-2]/", "drivers/", "warning"), CustomRule("svc0-alone", "^svc0/", "acme/svc[1-4]/")))
IGNORING = Config(ignore=(Ignore("L002", ("svc1/**", "**/order/**")), Ignore("L099", ("svc?/domain/*/f[0-2].go",))))
SCOPED = Config(overrides=(LayerOverride("svc2/**", {"domain": ("**/util/**",)}, "active-record"), LayerOverride("svc3/**")), cross_cutting=("**/util/billing/**",))


class Facts:
    """Components and dependencies, and the graph over them. Dependencies, counted in the one pass over them, and nodes are side tables in the shared folder, made once for a session and folder, as all rules read them."""

    made: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.components = testmap.components(spark, folder)
        key = (spark.sparkContext.applicationId, folder)
        if key not in self.made:
            dependencies = written(graph.counted(testmap.dependencies(spark, folder)), "dependencies")
            first = written(graph.build_nodes(self.components, dependencies), "nodes")
            self.made[key] = dependencies, written(graph.with_external(first, self.components), "graph")
        self.dependencies, self.nodes = self.made[key]
        self.edges = graph.build_edges(self.dependencies, self.nodes)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


C_ = f"c AS ({testmap.COMPONENTS})"
D_ = f"d AS ({testmap.DEPENDENCIES})"
NODES_ = f"""{C_}, {D_},
n0 AS (SELECT repo, component_id AS node_id, name, kind, layer, is_cross_cutting, architecture_mode, file, line, 0 AS p, seq AS s, 0 AS e FROM c
       UNION ALL SELECT repo, from_id, from_id, NULL, from_layer, from_cross_cutting, architecture_mode, file, line, 1, seq, 0 FROM d
       UNION ALL SELECT repo, to_id, to_id, NULL, to_layer, to_cross_cutting, architecture_mode, file, line, 1, seq, 1 FROM d),
n1 AS (SELECT * FROM n0 QUALIFY row_number() OVER (PARTITION BY repo, node_id ORDER BY p, s, e) = 1),
dirs AS (SELECT DISTINCT repo, regexp_replace(file, '/?[^/]*$', '') AS dir FROM c),
w AS (SELECT DISTINCT repo, list_extract(string_split(dir, '/'), k) || '/' || list_extract(string_split(dir, '/'), k + 1) AS pair FROM (SELECT *, unnest(range(1, len(string_split(dir, '/')))) AS k FROM dirs)),
paths AS (SELECT DISTINCT repo, node_id, split_part(node_id, '::', 1) AS path FROM n1 WHERE kind IS NULL),
inside AS (SELECT DISTINCT repo, node_id FROM paths JOIN dirs USING (repo) WHERE ends_with(path, dir) UNION SELECT repo, node_id FROM paths JOIN w USING (repo) WHERE contains(replace(path, '.', '/'), pair)),
nodes AS (SELECT n1.*, kind IS NULL AND i.node_id IS NULL AS is_external FROM n1 LEFT JOIN inside i ON i.repo = n1.repo AND i.node_id = n1.node_id)"""
EDGES_ = f"""{NODES_},
lv AS (SELECT * FROM (VALUES ('domain', 0), ('application', 1), ('infrastructure', 2), ('presentation', 3)) t(layer, depth)),
e AS (SELECT d.repo, d.from_id, d.to_id, d.import_path, d.file, d.line, d.col, s.name AS sn, s.layer AS sl, s.is_cross_cutting AS sc, s.architecture_mode AS sm, s.is_external AS sx, s.kind AS sk,
      t.name AS tn, t.layer AS tl, t.is_cross_cutting AS tc, t.is_external AS tx, t.kind AS tk, a.depth AS sd, b.depth AS td
      FROM d JOIN nodes s ON s.repo = d.repo AND s.node_id = d.from_id JOIN nodes t ON t.repo = d.repo AND t.node_id = d.to_id LEFT JOIN lv a ON a.layer = s.layer LEFT JOIN lv b ON b.layer = t.layer)"""


@query(f"WITH {NODES_} SELECT repo, node_id, name, kind, layer, is_cross_cutting, is_external FROM nodes")
def node_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the graph, first mention wins, with the external mark."""
    return Facts(spark, sf_dir).nodes.select("repo", "node_id", "name", "kind", "layer", "is_cross_cutting", "is_external")


@query(f"WITH {EDGES_} SELECT repo, sx AS src_is_external, tx AS tgt_is_external, sl AS src_layer, tl AS tgt_layer, count(*) AS n FROM e GROUP BY ALL")
def edge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with both ends (J1), counted by what the ends are."""
    e = Facts(spark, sf_dir).edges
    return e.groupBy("repo", "src_is_external", "tgt_is_external", "src_layer", "tgt_layer").agg(graph.number(e).alias("n"))


@query(f"WITH {EDGES_} SELECT repo, CAST(count(*) > 0 AS BIGINT) AS max_depth, round(1.0e0 / max(nn), 6) AS average_depth, max(nn) AS node_count, count(*) AS edge_count FROM e JOIN (SELECT repo, count(*) AS nn FROM nodes GROUP BY repo) USING (repo) GROUP BY repo")
def dependency_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth metrics and counts."""
    f = Facts(spark, sf_dir)
    return graph.depth_metrics(f.nodes, f.edges).withColumn("average_depth", _r("average_depth"))


_PACKAGE = f"""WITH {C_}, {D_},
p AS (SELECT repo, string_split(package, '/')[-1] AS short, min(package) AS package FROM c GROUP BY ALL),
s AS (SELECT c.repo, short, count(*) AS nc, count(*) FILTER (kind = 'port') AS na FROM c JOIN p ON p.repo = c.repo AND p.package = c.package GROUP BY ALL),
x AS (SELECT DISTINCT d.repo, a.short AS f, b.short AS t FROM d JOIN p a ON a.repo = d.repo AND a.package = split_part(from_id, '::', 1) JOIN p b ON b.repo = d.repo AND b.short = string_split(import_path, '/')[-1] WHERE a.short <> b.short),
m AS (SELECT s.*, na / nc AS a, (SELECT count(*) FROM x WHERE x.repo = s.repo AND f = short) AS ce, (SELECT count(*) FROM x WHERE x.repo = s.repo AND t = short) AS ca FROM s),
v AS (SELECT *, CASE WHEN ca + ce = 0 THEN 0.0e0 ELSE ce / (ca + ce) END AS i FROM m),
z AS (SELECT *, abs(a + i - 1) AS dist FROM v)
SELECT repo, short AS package, round(a * 100) / 100 AS abstractness, round(i * 100) / 100 AS instability, round(dist * 100) / 100 AS distance,
       CASE WHEN dist > 0.5 AND a < 0.5 AND i < 0.5 THEN 'pain' WHEN dist > 0.5 AND a > 0.5 AND i > 0.5 THEN 'uselessness' END AS zone FROM z"""


@query(_PACKAGE)
def package_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstractness, instability, distance and zone per package."""
    return metrics.package_metrics(testmap.components(spark, sf_dir), testmap.dependencies(spark, sf_dir))


_CONFORM = f"""WITH {C_}, {D_},
p AS (SELECT repo, package, count(*) AS nc, count(*) FILTER (kind = 'port') AS na, arg_min(layer, seq) FILTER (layer IS NOT NULL) AS layer FROM c GROUP BY ALL),
q AS (SELECT repo, package, string_split(package, '/') AS s FROM p), i AS (SELECT DISTINCT repo, split_part(from_id, '::', 1) AS package, import_path, string_split(import_path, '/') AS s FROM d WHERE import_path IS NOT NULL),
t AS (SELECT i.repo, i.package, min(q.package) AS target FROM i JOIN q ON q.repo = i.repo AND q.s[-1] = i.s[-1] AND (len(q.s) < 2 OR len(i.s) < 2 OR q.s[-2] = i.s[-2]) JOIN p ON p.repo = i.repo AND p.package = i.package GROUP BY i.repo, i.package, i.import_path),
x AS (SELECT DISTINCT repo, package AS f, target AS t FROM t WHERE package <> target),
m AS (SELECT p.*, na / nc AS a, (SELECT count(*) FROM x WHERE x.repo = p.repo AND f = package) AS ce, (SELECT count(*) FROM x WHERE x.repo = p.repo AND x.t = package) AS ca FROM p WHERE layer IS NOT NULL),
v AS (SELECT *, CASE WHEN ca + ce = 0 THEN 0.0e0 ELSE ce / (ca + ce) END AS ii, CASE layer WHEN 'domain' THEN 0.75e0 WHEN 'application' THEN 0.4e0 ELSE 0.15e0 END AS cx, CASE layer WHEN 'domain' THEN 0.15e0 WHEN 'application' THEN 0.5e0 ELSE 0.75e0 END AS cy FROM m)"""


@query(f"{_CONFORM} SELECT repo, package, layer, round(a, 6) AS abstractness, round(ii, 6) AS instability, round(greatest(0, 1 - sqrt((a - cx) * (a - cx) + (ii - cy) * (ii - cy))), 6) AS conformance FROM v")
def conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each package from the ideal of its layer."""
    return metrics.package_conformance(testmap.components(spark, sf_dir), testmap.dependencies(spark, sf_dir)).select("repo", "package", "layer", _r("abstractness"), _r("instability"), _r("conformance"))


_COMPLIANT = "NOT sx AND NOT tx AND NOT sc AND NOT tc AND sm <> 'service-oriented'"
_COMPLIANCE = f"SELECT repo, count(*) AS n_edges, count(*) FILTER (sd >= td) AS n_right, count(*) FILTER (sd >= td) * 100.0e0 / count(*) AS compliance FROM e WHERE {_COMPLIANT} GROUP BY repo"


@query(f"WITH {EDGES_} SELECT repo, n_edges, n_right, round(compliance, 6) AS compliance FROM ({_COMPLIANCE})")
def compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of edges that respect the layers."""
    return metrics.compliance(Facts(spark, sf_dir).edges).withColumn("compliance", _r("compliance"))


_COVERAGE = "SELECT repo, ports, adapters, CASE WHEN adapters = 0 THEN 100.0e0 ELSE least(ports, adapters) * 100.0e0 / greatest(ports, adapters) END AS coverage FROM (SELECT repo, count(*) FILTER (kind = 'port' AND NOT is_cross_cutting) AS ports, count(*) FILTER (layer = 'infrastructure' AND kind IN ('adapter', 'repository', 'service') AND NOT is_cross_cutting) AS adapters FROM nodes GROUP BY repo)"


@query(f"WITH {NODES_} SELECT repo, ports, adapters, round(coverage, 6) AS coverage FROM ({_COVERAGE})")
def interface_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ports against adapters (A10)."""
    return metrics.interface_coverage(Facts(spark, sf_dir).nodes).withColumn("coverage", _r("coverage"))


_PRESENCE = """SELECT repo, count(*) AS total, count(*) FILTER (NOT is_cross_cutting AND layer IS NOT NULL) AS classified, count(*) FILTER (is_cross_cutting) AS cross_cutting, count(*) FILTER (NOT is_cross_cutting AND layer IS NULL) AS unclassified,
count(*) FILTER (is_cross_cutting OR layer IS NOT NULL) * 100.0e0 / count(*) AS coverage FROM nodes WHERE kind IS NOT NULL AND NOT is_external GROUP BY repo"""


@query(f"""WITH {NODES_}, u AS (SELECT repo, string_agg(p, ',' ORDER BY p) AS packages FROM (SELECT DISTINCT repo, split_part(node_id, '::', 1) AS p FROM nodes WHERE kind IS NOT NULL AND NOT is_external AND NOT is_cross_cutting AND layer IS NULL QUALIFY dense_rank() OVER (PARTITION BY repo ORDER BY split_part(node_id, '::', 1)) <= 10) GROUP BY repo)
SELECT a.repo, total, classified, cross_cutting, unclassified, round(coverage, 6) AS coverage, coalesce(packages, '') AS unclassified_packages FROM ({_PRESENCE}) a LEFT JOIN u ON u.repo = a.repo""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification coverage, with the first ten unclassified packages."""
    return metrics.classification(Facts(spark, sf_dir).nodes).withColumn("coverage", _r("coverage")).withColumn("unclassified_packages", F.concat_ws(",", "unclassified_packages"))


_SCORES = f"""WITH {EDGES_}, z AS ({_CONFORM} SELECT repo, avg(greatest(0, 1 - sqrt((a - cx) * (a - cx) + (ii - cy) * (ii - cy)))) * 100 AS conf FROM v GROUP BY repo),
y AS (SELECT n.repo, conf, coalesce(compliance, 100) AS comp, coalesce(g.coverage, 100) AS cov, coalesce(h.coverage, 100) AS pres FROM (SELECT DISTINCT repo FROM nodes) n LEFT JOIN z USING (repo) LEFT JOIN ({_COMPLIANCE}) USING (repo) LEFT JOIN ({_COVERAGE}) g USING (repo) LEFT JOIN ({_PRESENCE}) h USING (repo))"""
_SCORE = "round(pres * (coalesce(conf, 0) * CASE WHEN conf IS NULL THEN 0 ELSE 0.4e0 END + comp * 0.4e0 + cov * 0.2e0) / (CASE WHEN conf IS NULL THEN 0 ELSE 0.4e0 END + 0.6e0) / 100, 6)"


@query(f"{_SCORES} SELECT repo, {_SCORE} AS overall, round(pres, 6) AS structural_presence, round(coalesce(conf, 100), 6) AS layer_conformance, round(comp, 6) AS dependency_compliance, round(cov, 6) AS interface_coverage FROM y")
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted score and its parts, shown where a pattern is confident enough."""
    f = Facts(spark, sf_dir)
    found = patterns.confidences(patterns.signals(f.components, f.dependencies))
    s = metrics.gated(metrics.scores(f.components, f.dependencies, f.nodes, f.edges, CONFIG), found)
    return s.select("repo", *[_r(c) for c in s.columns if c != "repo"])


@query(f"WITH {C_} SELECT repo, kind, count(*) AS n FROM c GROUP BY ALL")
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components by kind (A1)."""
    return metrics.kind_counts(testmap.components(spark, sf_dir))


@query(f"WITH {NODES_} SELECT repo, CASE WHEN is_cross_cutting THEN 'cross_cutting' ELSE coalesce(layer, 'unclassified') END AS bucket, count(*) AS n FROM nodes WHERE NOT is_external GROUP BY ALL")
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by layer (A2)."""
    return metrics.layer_counts(Facts(spark, sf_dir).nodes)


@query(f"WITH {EDGES_} SELECT repo, source, " + ", ".join(f"count(*) FILTER (sl = source AND tl = '{x}') AS {x}" for x in ("domain", "application", "infrastructure", "presentation")) + " FROM (SELECT DISTINCT repo, unnest(['domain', 'application', 'infrastructure', 'presentation']) AS source FROM e) JOIN e USING (repo) GROUP BY ALL")
def coupling_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between layers as a matrix (A4)."""
    return metrics.coupling_matrix(Facts(spark, sf_dir).edges)


@query(f"WITH {EDGES_} SELECT repo, coalesce(sl, 'unclassified') AS source, coalesce(tl, 'unclassified') AS target, count(*) AS n_edges, count(*) FILTER (sd < td) AS n_violations FROM e GROUP BY ALL")
def layer_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and violations from layer to layer."""
    return metrics.layer_flow(Facts(spark, sf_dir).edges)


def _seg(p: str, w: str) -> str:
    return f"list_contains(string_split(replace(replace({p}, '.', '/'), ':', '/'), '/'), '{w}')"


def _word(p: str) -> str:
    return "CASE " + " ".join(f"WHEN {_seg(p, w)} THEN '{n}'" for w, n in (("domain",) * 2, ("application",) * 2, ("infrastructure",) * 2, ("app", "application"), ("infra", "infrastructure"))) + " END"


_SIGNALS = f"""WITH {C_}, {D_},
g AS (SELECT repo, count(DISTINCT package) AS pk, bool_or({_seg('package', 'domain')}) AS dom, bool_or({_seg('package', 'application')} OR {_seg('package', 'app')}) AS app, bool_or({_seg('package', 'infrastructure')} OR {_seg('package', 'infra')}) AS inf,
      count(*) FILTER (kind = 'port') AS ports, count(*) FILTER (kind = 'port' AND {_seg('package', 'domain')}) AS dp, count(*) FILTER (kind <> 'port' AND {_seg('package', 'domain')}) AS ds FROM c GROUP BY repo),
l AS (SELECT repo, {_word("split_part(from_id, '::', 1)")} AS a, {_word('import_path')} AS b FROM d),
f AS (SELECT repo, true AS linked, bool_or(b = 'domain') AS imported, bool_or(a = 'domain') AS imports FROM l WHERE a <> b GROUP BY repo),
s AS (SELECT g.*, coalesce(linked, false) AS linked, coalesce(imported, false) AS imported, coalesce(imports, false) AS imports FROM g LEFT JOIN f USING (repo))"""


def _terms(*terms: tuple[str, str]) -> str:
    return "least(1.0e0, 0.0e0 + " + " + ".join(f"CASE WHEN {c} THEN {p}e0 ELSE 0 END" for c, p in terms) + ")"


_PATTERNS = f"""{_SIGNALS}
SELECT repo, 'ddd-hexagonal' AS name, {_terms(('dom', '0.20'), ('app', '0.15'), ('inf', '0.15'), ('dp > 0', '0.20'), ('imported AND NOT imports', '0.20'), ('dp + ds > 0 AND dp * 4 >= dp + ds', '0.10'))} AS confidence FROM s
UNION ALL SELECT repo, 'active-record', 0.0e0 FROM s
UNION ALL SELECT repo, 'flat-crud', {_terms(('pk = 1', '0.55'), ('pk = 2 AND NOT linked', '0.05'), ('ports = 0', '0.20'), ('NOT dom AND NOT app AND NOT inf', '0.15'))} FROM s
UNION ALL SELECT repo, 'anemic-domain', CASE WHEN dom THEN {_terms(('dp = 0 AND ds > 0', '0.40'), ('imported', '0.30'), ('ports = 0', '0.20'), ('NOT app', '0.10'))} ELSE 0.0e0 END FROM s
UNION ALL SELECT repo, 'service-layer', {_terms(('pk >= 2', '0.20'), ('linked', '0.30'), ('ports = 0 AND linked', '0.20'), ('NOT dom AND NOT inf AND pk >= 2', '0.10'))} FROM s"""


@query(f"SELECT repo, name, round(confidence, 6) AS confidence FROM ({_PATTERNS})")
def pattern_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence in five patterns."""
    return patterns.confidences(patterns.signals(testmap.components(spark, sf_dir), testmap.dependencies(spark, sf_dir))).select("repo", "name", _r("confidence"))


@query(f"SELECT repo, name AS top_pattern, round(confidence, 6) AS top_confidence FROM ({_PATTERNS}) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY confidence DESC, list_position(['ddd-hexagonal', 'active-record', 'flat-crud', 'anemic-domain', 'service-layer'], name)) = 1")
def top_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most confident pattern."""
    found = patterns.confidences(patterns.signals(testmap.components(spark, sf_dir), testmap.dependencies(spark, sf_dir)))
    return patterns.top_pattern(found).withColumn("top_confidence", _r("top_confidence"))


_BASE = "NOT sx AND NOT tx AND NOT sc AND NOT tc"
_RULE = "CASE WHEN sl = 'domain' AND tl = 'infrastructure' THEN 'L001' WHEN sl = 'domain' AND tl = 'application' THEN 'L002' WHEN sl = 'application' AND tl = 'infrastructure' THEN 'L003' ELSE 'L099' END"
_L = f"SELECT repo, {_RULE} AS rule, 'error' AS severity, file, line, from_id AS subject FROM e WHERE {_BASE} AND from_id NOT LIKE '%<init>%' AND sm <> 'service-oriented' AND sd < td AND NOT (sm = 'active-record' AND sl = 'domain' AND tl = 'infrastructure')"


def _rows(v: DataFrame) -> DataFrame:
    return rules.each(v).select("repo", "rule", "severity", "file", "line", "subject")


@query(f"WITH {EDGES_} {_L}")
def layer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner layers that depend on outer ones."""
    return _rows(rules.layer_violations(Facts(spark, sf_dir).edges, CONFIG))


_PB = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '(port)+$', ''), '(interface)+$', ''), '(repository)+$', ''), '(service)+$', '')"
_AB = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '(handler)+$', ''), '(controller)+$', ''), '(adapter)+$', ''), '(impl)+$', '')"
_ADAPTERS = "SELECT repo, name, node_id, kind, layer, is_cross_cutting, file, line, lower(name) AS low, {_AB} AS base FROM nodes".replace("{_AB}", _AB)
_PA001 = f"""SELECT repo, 'PA001' AS rule, 'warning' AS severity, file, line, name AS subject FROM ({_ADAPTERS}) a
WHERE layer = 'infrastructure' AND NOT is_cross_cutting AND (kind IN ('adapter', 'repository') OR low LIKE '%handler' OR low LIKE '%controller' OR low LIKE '%adapter%' OR low LIKE '%impl%')
AND NOT EXISTS (SELECT 1 FROM c WHERE c.repo = a.repo AND component_id = a.node_id AND c.kind = 'adapter' AND (implemented IS NOT NULL OR returns_concrete IS NOT NULL))
AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT repo, lower(name) AS port, {_PB} AS pbase FROM nodes WHERE kind = 'port' OR contains(lower(name), 'port') OR contains(lower(name), 'interface') OR (contains(lower(name), 'repository') AND layer = 'domain')) p
                WHERE p.repo = a.repo AND ((base <> '' AND pbase = base) OR contains(low, port)))"""


@query(f"WITH {NODES_} {_PA001}")
def missing_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapters without a port."""
    f = Facts(spark, sf_dir)
    return _rows(rules.missing_ports(f.nodes, f.components, CONFIG))


_PA002 = f"""SELECT repo, 'PA002' AS rule, 'info' AS severity, file, line, name AS subject FROM (SELECT *, {_PB} AS pbase, lower(name) AS port FROM nodes) p
WHERE kind = 'port' AND layer = 'domain' AND NOT is_cross_cutting AND NOT EXISTS (SELECT 1 FROM c WHERE c.repo = p.repo AND c.kind = 'adapter' AND implemented = p.name)
AND NOT EXISTS (SELECT 1 FROM ({_ADAPTERS}) a WHERE a.repo = p.repo AND a.layer = 'infrastructure' AND a.kind IN ('adapter', 'repository') AND ((base <> '' AND base = pbase) OR contains(low, port) OR (pbase <> '' AND contains(low, pbase))))"""


@query(f"WITH {NODES_} {_PA002}")
def unimplemented_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain ports that nothing implements."""
    f = Facts(spark, sf_dir)
    return _rows(rules.unimplemented_ports(f.nodes, f.components, CONFIG))


_PA003 = "SELECT repo, 'PA003' AS rule, 'warning' AS severity, file, line, name AS subject FROM c WHERE kind = 'adapter' AND returns_concrete IS NOT NULL"


@query(f"WITH {C_} {_PA003}")
def concrete_ctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constructors that give concrete types (V5)."""
    return _rows(rules.concrete_constructors(testmap.components(spark, sf_dir), CONFIG))


_STORES = " OR ".join(f"contains(lower(import_path), '{w}')" for w in C.STORES.split("|"))
_PRODUCTS = " OR ".join(f"contains(lower(tn), '{w}')" for w in C.CONCRETE.split("|"))
_L005 = f"""SELECT repo, 'L005' AS rule, 'error' AS severity, file, line, from_id AS subject FROM e WHERE NOT sx AND NOT sc AND sm <> 'active-record' AND sl = 'domain' AND ({_STORES})
UNION ALL SELECT repo, 'L005', 'error', file, line, from_id FROM e WHERE {_BASE} AND sm <> 'active-record' AND sl = 'domain' AND tl = 'infrastructure' AND ({_PRODUCTS})"""


@query(f"WITH {EDGES_} {_L005}")
def infra_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores reached from the domain."""
    return _rows(rules.infrastructure_leaks(Facts(spark, sf_dir).edges, CONFIG))


_L004 = "SELECT repo, 'L004' AS rule, 'warning' AS severity, file, line, from_id AS subject FROM e WHERE from_id LIKE '%<init>%' AND NOT sc AND NOT tc AND sd < td"


@query(f"WITH {EDGES_} {_L004}")
def init_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Init functions that reach outwards."""
    return _rows(rules.init_coupling(Facts(spark, sf_dir).edges, CONFIG))


_CUSTOM = """SELECT repo, 'C-no-drivers' AS rule, 'warning' AS severity, file, line, from_id AS subject FROM e WHERE regexp_matches(from_id, '^svc[0-2]/') AND regexp_matches(coalesce(import_path, to_id), 'drivers/')
UNION ALL SELECT repo, 'C-svc0-alone', 'error', file, line, from_id FROM e WHERE regexp_matches(from_id, '^svc0/') AND regexp_matches(coalesce(import_path, to_id), 'acme/svc[1-4]/')"""


@query(f"WITH {EDGES_} {_CUSTOM}")
def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured pairs of expressions."""
    return _rows(rules.custom_violations(Facts(spark, sf_dir).edges, CONFIG))


@query(f"WITH {EDGES_} SELECT * FROM ({_L}) WHERE NOT (rule = 'L002' AND (file LIKE 'svc1/%' OR file LIKE '%/order/%')) AND NOT (rule = 'L099' AND regexp_matches(file, '^svc./domain/.*/f[0-2][.]go$'))")
def rule_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations less those that ignore globs name."""
    return _rows(rules.without_ignored(rules.layer_violations(Facts(spark, sf_dir).edges, IGNORING), IGNORING))


_ALL = f"{_L} UNION ALL {_PA001} UNION ALL {_PA003} UNION ALL {_PA002} UNION ALL {_L005} UNION ALL {_L004} UNION ALL {_CUSTOM}"


def _all(f: Facts) -> DataFrame:
    return rules.all_violations(f.components, f.nodes, f.edges, CONFIG)


@query(f"WITH {EDGES_} SELECT rule, severity, count(*) AS n FROM ({_ALL}) WHERE severity IN ('warning', 'error') AND rule <> 'L099' GROUP BY ALL")
def severity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules together, at or above warning, without one rule."""
    v = rules.failing(rules.without_rules(_all(Facts(spark, sf_dir)), ["L099"]), "warning")
    return v.groupBy("rule", "severity").agg(graph.number(v).alias("n"))


@query(f"WITH {EDGES_} SELECT repo, rule, count(*) AS n FROM ({_ALL}) GROUP BY ALL")
def violations_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations by rule."""
    return metrics.rule_counts(_all(Facts(spark, sf_dir)))


@query(f"WITH {EDGES_} SELECT repo, file, CAST(count(*) AS BIGINT) AS n, CAST(min(greatest(line - 1, 0)) AS BIGINT) AS first_line FROM ({_ALL}) GROUP BY ALL")
def diagnostics_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations as editor diagnostics."""
    total = F.aggregate(F.col("diagnostics")["n"], F.lit(0).cast("bigint"), lambda a, x: a + x)
    return metrics.by_file(_all(Facts(spark, sf_dir))).select("repo", "file", total.alias("n"), F.col("diagnostics")[0]["line"].cast("bigint").alias("first_line"))


_PE = f"""WITH RECURSIVE {C_}, {D_}, p AS (SELECT DISTINCT repo, package, string_split(package, '/') AS s FROM c),
i AS (SELECT DISTINCT repo, split_part(from_id, '::', 1) AS a, import_path, string_split(import_path, '/') AS s FROM d WHERE import_path IS NOT NULL),
tg AS (SELECT i.repo, i.a, min(p.package) AS b FROM i JOIN p ON p.repo = i.repo AND p.s[-1] = i.s[-1] AND (len(p.s) < 2 OR len(i.s) < 2 OR p.s[-2] = i.s[-2]) JOIN p f ON f.repo = i.repo AND f.package = i.a GROUP BY i.repo, i.a, i.import_path),
pe AS (SELECT DISTINCT repo, a, b FROM tg WHERE a <> b),
r AS (SELECT repo, a, b FROM pe UNION SELECT r.repo, r.a, pe.b FROM r JOIN pe ON pe.repo = r.repo AND pe.a = r.b),
m AS (SELECT x.repo, x.a, min(least(x.a, x.b)) AS component FROM r x JOIN r y ON y.repo = x.repo AND y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY x.repo, x.a)"""


@query(f"{_PE} SELECT repo, component, string_agg(a, ',' ORDER BY a) AS members FROM m GROUP BY repo, component")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected packages."""
    edges = graph.package_edges(testmap.dependencies(spark, sf_dir), testmap.components(spark, sf_dir))
    return graph.strongly_connected(edges).withColumn("members", F.concat_ws(",", "members"))


@query(f"{_PE}, l AS (SELECT repo, package, arg_min(file, seq) AS file, arg_min(line, seq) AS line FROM c GROUP BY repo, package) SELECT m.repo, 'D001' AS rule, 'error' AS severity, l.file, l.line, component AS subject, 'Dependency cycle: ' || string_agg(a, ' -> ' ORDER BY a) || ' -> ' || min(a) AS message FROM m JOIN l ON l.repo = m.repo AND l.package = component GROUP BY m.repo, component, l.file, l.line")
def cycle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of packages as violations, at the first place of their lowest package."""
    c = testmap.components(spark, sf_dir)
    edges = graph.package_edges(testmap.dependencies(spark, sf_dir), c)
    places = c.groupBy("repo", F.col("package").alias("node_id")).agg(F.min_by("file", "seq").alias("file"), F.min_by("line", "seq").alias("line"), F.min_by("col", "seq").alias("col"))
    return rules.cycles(graph.strongly_connected(edges), places, CONFIG).select("repo", "rule", "severity", "file", "line", "subject", "message")


_PATHS = f"WITH {C_}, x AS (SELECT DISTINCT file AS path FROM c UNION SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = testmap.components(spark, sf_dir).select(F.col("file").alias("path"))
    return own.union(parquet(spark, sf_dir, "pages").where("url is not null").select("url")).distinct()


def _glob(*words: str) -> str:
    return "(" + " OR ".join(f"contains('/' || {{0}}, '/{w}/')" for w in words) + ")"


def _layers(p: str, own_domain: str | None = None) -> str:
    tests = {"domain": own_domain or _glob("domain", "entity", "model"), "application": _glob("application", "usecase", "service"), "infrastructure": _glob("infrastructure", "adapter", "repository", "persistence"), "presentation": _glob("presentation", "handler", "api", "cmd")}
    return "CASE " + " ".join(f"WHEN {t.format(p)} THEN '{k}'" for k, t in tests.items()) + " END"


@query(f"{_PATHS} SELECT path, CASE WHEN path LIKE 'svc2/%' THEN {_layers('path', _glob('util'))} ELSE {_layers('path')} END AS layer, CASE WHEN path LIKE 'svc2/%' THEN 'active-record' ELSE 'ddd' END AS mode, contains('/' || path, '/util/billing/') AS cross_cutting FROM x")
def classify_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer, mode and cross-cutting flag of paths, with overrides."""
    p = F.col("path")
    return _paths(spark, sf_dir).select("path", C.layer_of(p, SCOPED).alias("layer"), C.mode_of(p, SCOPED).alias("mode"), C.is_cross_cutting(p, SCOPED).alias("cross_cutting"))


def _guess(p: str) -> str:
    rows = (("domain", "domain entity model", ""), ("application", "application usecase service", ""), ("infrastructure", "infrastructure adapter repository persistence", ""), ("presentation", "presentation handler cmd", f" OR contains(lower({p}), '/api/')"))
    return "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower({p}), '/{w}') OR string_split(lower({p}), '/')[-1] = '{w}'" for w in words.split())}{more} THEN '{k}'" for k, words, more in rows) + " END"


@query(f"WITH {D_}, x AS (SELECT DISTINCT import_path AS path FROM d UNION SELECT DISTINCT url FROM pages WHERE url IS NOT NULL) SELECT path, coalesce({_layers('path')}, {_layers("('**/' || path)")}, {_layers("(path || '/**')")}, {_guess('path')}) AS layer, contains('/' || path || '/**', '/util/billing/') AS cross_cutting FROM x")
def classify_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer of imported paths."""
    own = testmap.dependencies(spark, sf_dir).select(F.col("import_path").alias("path"))
    paths = own.union(parquet(spark, sf_dir, "pages").where("url is not null").select("url")).distinct()
    return paths.select("path", C.import_layer(F.col("path"), Config()).alias("layer"), C.is_cross_cutting_import(F.col("path"), SCOPED).alias("cross_cutting"))


_CATEGORY = """CASE WHEN NOT contains(path, '.') AND NOT starts_with(path, './') THEN 'stdlib' WHEN starts_with(path, 'std::') OR starts_with(path, 'core::') OR starts_with(path, 'java.') OR starts_with(path, 'javax.') THEN 'stdlib'
WHEN contains(lower(path), '/domain') OR contains(lower(path), '::domain::') OR contains(lower(path), '.domain.') THEN 'internal_domain'
WHEN contains(lower(path), '/application/') OR contains(lower(path), '::application::') OR contains(lower(path), '.application.') OR contains(lower(path), '/usecase/') THEN 'internal_application'
WHEN contains(lower(path), '/infrastructure/') OR contains(lower(path), '::infrastructure::') OR contains(lower(path), '.infrastructure.') OR contains(lower(path), '/adapter/') THEN 'internal_infrastructure'
WHEN starts_with(path, './') OR starts_with(path, '../') OR starts_with(path, 'crate::') OR starts_with(path, 'super::') THEN 'internal_domain' ELSE 'external' END"""


@query(f"WITH {D_}, x AS (SELECT import_path AS path FROM d WHERE import_path IS NOT NULL UNION ALL SELECT url FROM pages WHERE url IS NOT NULL) SELECT path, {_CATEGORY} AS category, count(*) AS n FROM x GROUP BY ALL")
def import_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports by category (C27, FX2)."""
    both = testmap.dependencies(spark, sf_dir).select("import_path").union(parquet(spark, sf_dir, "pages").select("url"))
    return forensics.classified_imports(both).groupBy(F.col("import_path").alias("path"), "category").agg(F.count("*").alias("n"))


@query(f"WITH {D_} SELECT repo, kind, import_path, count(*) AS n FROM d WHERE kind <> 'import' OR contains(import_path, '.') GROUP BY ALL")
def stdlib_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports without the standard library's (F1, F2)."""
    return testmap.dependencies(spark, sf_dir).where((F.col("kind") != "import") | ~C.is_go_stdlib(F.col("import_path"))).groupBy("repo", "kind", "import_path").agg(F.count("*").alias("n"))


def _suffix(words: str) -> str:
    return f"regexp_matches(lower(name), '({words})$')"


_VALUE = "CASE WHEN (has_id OR ref_type IS NOT NULL) AND NOT has_id THEN 'value_object' ELSE 'entity' END"
_GO = f"CASE WHEN contains(file, 'infrastructure/') AND {_suffix('repository|repo')} THEN 'repository' WHEN contains(file, 'infrastructure/') AND returns_concrete IS NOT NULL THEN 'adapter' WHEN contains(file, 'domain/events/') OR {_suffix('event|' + C.PAST.replace(' ', '|'))} THEN 'domain_event' WHEN {_suffix('repository|repo')} THEN 'repository' WHEN {_suffix('service|svc')} THEN 'service' WHEN {_suffix('usecase|interactor')} THEN 'use_case' ELSE {_VALUE} END"
_RUST = f"CASE WHEN {_suffix('repository|repo')} THEN 'repository' WHEN {_suffix('service|svc')} THEN 'service' WHEN {_suffix('handler|controller')} THEN 'adapter' WHEN {_suffix('usecase|interactor')} THEN 'use_case' WHEN {_suffix('event')} THEN 'domain_event' ELSE {_VALUE} END"
_CLASS = f"CASE WHEN {_suffix('repository|repo')} THEN 'repository' WHEN {_suffix('service|svc')} THEN 'service' WHEN {_suffix('handler|controller')} THEN 'adapter' WHEN {_suffix('usecase|interactor')} THEN 'use_case' WHEN implemented IS NOT NULL THEN 'adapter' ELSE 'entity' END"


@query(f"WITH {C_} SELECT seq, {_GO} AS go_kind, {_RUST} AS rust_kind, {_CLASS} AS class_kind, n_methods >= 2 AS active_record, CASE WHEN layer = 'infrastructure' AND kind NOT IN ('adapter', 'repository', 'service') AND {_suffix('handler|controller')} THEN 'adapter' ELSE kind END AS upgraded FROM c")
def kind_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds from names, fields and paths."""
    c, name, fields = testmap.components(spark, sf_dir), F.col("name"), F.col("fields")
    none = F.lit("")
    return c.select("seq", C.go_kind(name, fields, F.col("file"), F.col("returns_concrete"), none).alias("go_kind"), C.rust_kind(name, fields).alias("rust_kind"), C.class_kind(name, F.col("implements")).alias("class_kind"), C.is_active_record(F.col("methods")).alias("active_record"), C.upgraded_kind(F.col("kind"), F.col("layer"), name).alias("upgraded"))


@query(f"""WITH {C_} SELECT seq, replace(replace(replace(replace(replace(replace(replace(component_id, '::', '_'), '/', '_'), '.', '_'), '-', '_'), ' ', '_'), '<', ''), '>', '') AS mermaid, regexp_replace(component_id, '[^A-Za-z0-9]', '_', 'g') AS dot,
string_split(package, '/')[-2] || '/' || string_split(package, '/')[-1] AS label, {_PB} AS port_base, {_AB} AS adapter_base, upper(substr(name, 1, 1)) || substr(name, 2) AS pascal, lower(substr(name, 1, 1)) || substr(name, 2) AS camel FROM c""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers and labels of diagrams, base names."""
    n = F.col("name")
    return testmap.components(spark, sf_dir).select("seq", C.mermaid_id(F.col("component_id")).alias("mermaid"), C.dot_id(F.col("component_id")).alias("dot"), C.short_label(F.col("package")).alias("label"), C.port_base(n).alias("port_base"), C.adapter_base(n).alias("adapter_base"), C.upper_first(n).alias("pascal"), C.lower_first(n).alias("camel"))


@query("SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot of each project."""
    e = parquet(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return history.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", _r("value"))


@query("SELECT event_id, round(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS previous, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events")
def score_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each snapshot against the one before it."""
    e = parquet(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return history.with_previous(e, ["user_id"], ["ts", "event_id"], "value").select("event_id", _r("previous"), _r("delta"))


@query("""WITH x AS (SELECT CAST(user_id AS VARCHAR) AS repo, event_type AS rule_id, hour(ts) < 12 AS early FROM events)
SELECT repo, rule_id, count(*) FILTER (early) AS previous_count, count(*) FILTER (NOT early) AS current_count, count(*) FILTER (NOT early) - count(*) FILTER (early) AS delta FROM x GROUP BY repo, rule_id""")
def rule_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per rule of two snapshots (J10, U2); the snapshots are the two halves of the days."""
    e = parquet(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("repo"), F.col("event_type").alias("rule"), (F.hour("ts") < 12).alias("early"))
    count = lambda df: metrics.rule_counts(df)
    return history.rule_trends(count(e.where("early")), count(e.where("not early")))


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Source files and their cached state, in which the hashes of all but English texts are out of date and pages are files that are gone."""
    docs = parquet(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("content"), "lang")
    files = history.with_hash(docs)
    old = files.select("repo", "path", F.when(F.col("lang") == "en", F.col("sha256")).otherwise(F.sha2(F.concat("content", F.lit("old")), 256)).alias("sha256"))
    gone = parquet(spark, sf_dir, "pages").select(F.lit("pages").alias("repo"), F.col("url").alias("path"), F.sha2("html", 256).alias("sha256"))
    return files, old.union(gone)


@query("SELECT source AS repo, CAST(doc_id AS VARCHAR) AS path, sha256(coalesce(text, '')) AS sha256, lang = 'en' AS hit FROM documents")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to take from the cache and files to read again."""
    files, state = _files(spark, sf_dir)
    hits, misses = history.cache_split(files.select("repo", "path", "sha256"), state)
    return hits.select("repo", "path", "sha256", F.lit(True).alias("hit")).union(misses.select("repo", "path", "sha256", F.lit(False)))


@query("SELECT source AS repo, CAST(doc_id AS VARCHAR) AS path FROM documents")
def cache_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached files that are still there."""
    files, state = _files(spark, sf_dir)
    return history.cache_prune(state, files).select("repo", "path")


_PART = "CASE WHEN s_acctbal >= {0} THEN s_acctbal / (97 + {0}) END"


@query("WITH s AS (SELECT CAST(s_nationkey AS VARCHAR) AS repo, " + ", ".join(f"{_PART.format(700 * k)} AS {c}" for k, c in enumerate(services.PARTS)) + ", 1 + s_suppkey % 40 AS n, s_suppkey % 7 AS d, s_suppkey % 3 AS f FROM supplier) SELECT repo, " + ", ".join(f"round(coalesce(sum({c} * n), 0) / sum(n), 6) AS {c}" for c in services.PARTS) + ", CAST(sum(n) AS BIGINT) AS component_count, CAST(sum(d) AS BIGINT) AS dependency_count, CAST(sum(f) AS BIGINT) AS files_analyzed FROM s GROUP BY repo")
def service_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of services weighted by their components."""
    key = F.col("s_suppkey")
    s = parquet(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("repo"), *[F.expr(_PART.format(700 * k)).alias(c) for k, c in enumerate(services.PARTS)], (1 + key % 40).alias("component_count"), (key % 7).alias("dependency_count"), (key % 3).alias("files_analyzed"))
    out = services.rollup(s)
    return out.select("repo", *[_r(c) for c in services.PARTS], *[F.col(c).cast("bigint").alias(c) for c in ("component_count", "dependency_count", "files_analyzed")])


@query(f"WITH {D_} SELECT repo, import_path AS module, string_agg(DISTINCT split_part(from_id, '/', 1), ',' ORDER BY split_part(from_id, '/', 1)) AS used_by FROM d WHERE import_path IS NOT NULL GROUP BY repo, import_path HAVING count(*) > 1")
def shared_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that more than one import names."""
    d = testmap.dependencies(spark, sf_dir).where("import_path is not null").select("repo", services.service_of(F.col("from_id"), "svc*").alias("service"), F.col("import_path").alias("module"))
    return services.shared_modules(d).withColumn("used_by", F.concat_ws(",", "used_by"))


@query(f"WITH {C_} SELECT DISTINCT a.repo, a.component_id AS entity_id, b.name AS value_object FROM c a JOIN c b ON b.repo = a.repo AND b.kind = 'value_object' AND contains(a.ref_type, b.name) WHERE a.kind = 'entity'")
def entity_value_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value objects in the fields of entities (J14, FX3)."""
    return forensics.entity_value_objects(testmap.components(spark, sf_dir))


_CAT = _CATEGORY.replace("path", "import_path")


@query(f"""WITH {C_}, {D_}, t AS (SELECT DISTINCT repo, file, import_path, {_CAT} AS category FROM d),
x AS (SELECT DISTINCT repo, file, component_id AS entity_id FROM c WHERE kind = 'entity')
SELECT x.repo, entity_id, x.file, """ + ", ".join(f"coalesce(string_agg(import_path, ',' ORDER BY import_path) FILTER (category = '{k}'), '') AS {k}" for k in forensics.CATEGORIES) + ", count(*) FILTER (category = 'internal_infrastructure') = 0 AS is_clean FROM x LEFT JOIN t ON t.repo = x.repo AND t.file = x.file GROUP BY x.repo, entity_id, x.file")
def dependency_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of each entity's file by category."""
    c = testmap.components(spark, sf_dir)
    a = forensics.dependency_audit(c.withColumn("component_id", F.concat_ws("|", "component_id", "file")), testmap.dependencies(spark, sf_dir))
    return a.select("repo", F.substring_index("entity_id", "|", 1).alias("entity_id"), F.substring_index("entity_id", "|", -1).alias("file"), *[F.concat_ws(",", k).alias(k) for k in forensics.CATEGORIES], "is_clean")


@query(f"WITH {C_} SELECT repo, component_id, seq, unnest(['rich model', 'factory method', 'identity', 'encapsulation']) AS pattern, unnest([n_methods > 0, n_methods > 0, has_id, n_methods >= 2]) AS detected FROM c WHERE kind = 'entity'")
def domain_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design patterns of entities (FX4)."""
    c = testmap.components(spark, sf_dir)
    return forensics.domain_patterns(c.withColumn("component_id", F.concat_ws("|", "component_id", "seq"))).select("repo", F.substring_index("component_id", "|", 1).alias("component_id"), F.substring_index("component_id", "|", -1).cast("bigint").alias("seq"), "pattern", "detected")


@query(f"WITH {C_} SELECT repo, component_id, seq FROM c WHERE kind = 'port' AND NOT EXISTS (SELECT 1 FROM c a WHERE a.repo = c.repo AND a.kind = 'adapter' AND a.implemented = c.name)")
def unserved_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ports that no adapter names."""
    return forensics.unserved_ports(testmap.components(spark, sf_dir)).select("repo", "component_id", "seq")


@query(f"WITH {C_} SELECT repo, CASE kind WHEN 'domain_event' THEN 'events' WHEN 'port' THEN 'ports' WHEN 'entity' THEN 'entities' WHEN 'value_object' THEN 'value_objects' WHEN 'use_case' THEN 'application_services' WHEN 'service' THEN 'application_services' ELSE 'adapters' END AS bucket, count(*) AS n FROM c GROUP BY ALL")
def kind_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components by the forensic report's lists."""
    return forensics.buckets(testmap.components(spark, sf_dir)).select("repo", "bucket", F.size("members").cast("bigint").alias("n"))


@query(f"""WITH {EDGES_} SELECT repo, 1 AS ord, name AS subject FROM c WHERE kind = 'entity' AND layer = 'domain' AND n_methods = 0
UNION ALL SELECT DISTINCT repo, 2, '' FROM c WHERE kind = 'entity' AND repo NOT IN (SELECT repo FROM c WHERE kind = 'domain_event')
UNION ALL SELECT repo, 3, name FROM c WHERE kind IN ('adapter', 'repository') AND layer = 'infrastructure' AND implemented IS NULL
UNION ALL SELECT repo, 4, from_id FROM e WHERE NOT sx AND NOT sc AND sm <> 'active-record' AND sl = 'domain' AND ({_STORES})
UNION ALL SELECT repo, 6, name FROM c WHERE kind = 'port' AND NOT EXISTS (SELECT 1 FROM c a WHERE a.repo = c.repo AND a.kind = 'adapter' AND a.implemented = c.name)""")
def improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to improve (FX5)."""
    f = Facts(spark, sf_dir)
    leaks = rules.each(rules.infrastructure_imports(f.edges, CONFIG))
    return forensics.improvements(f.components, leaks.withColumn("message", F.col("subject"))).select("repo", "ord", "subject")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Go files made from the components: a file each, with its types, their fields and methods."""
    c = testmap.components(spark, sf_dir)
    field = F.array_join(F.transform("fields", lambda f: F.format_string("\t%s %s\n", f["name"], f["type_name"])), "")
    method = F.array_join(F.transform("methods", lambda m: F.format_string("func (x *%s) %s(n int) error {\n\treturn nil // {\n}\n", F.col("name"), m["name"])), "")
    body = F.when(F.col("kind") == "port", F.format_string("type %s interface {\n\tFind(id string) error\n}\n", "name")).otherwise(F.concat(F.format_string("type %s struct {\n", "name"), field, F.lit("}\n"), method))
    one = c.groupBy("repo", "file", "component_id").agg(F.min_by(body, "seq").alias("body"), F.min("seq").alias("seq"))
    text = F.concat(F.lit("package p\n\nimport (\n\t\"fmt\"\n\t\"github.com/acme/x\"\n)\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "body"))), lambda x: x["body"]), "\n"))
    return one.groupBy("repo", "file").agg(text.alias("content")).select("repo", F.col("file").alias("path"), F.lit("go").alias("language"), "content")


@query(f"""WITH {C_}, o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY repo, file, component_id ORDER BY seq) = 1),
g AS (SELECT repo, file, name, layer, kind = 'port' AS port, CASE WHEN kind = 'port' THEN 0 ELSE CAST(has_id AS INTEGER) + CAST(ref_type IS NOT NULL AS INTEGER) END AS n_fields, CASE WHEN kind = 'port' THEN 1 ELSE least(n_methods, 3) END AS n_methods, has_id, ref_type FROM o)
SELECT repo, file, name, layer, CASE WHEN port THEN 'port' WHEN contains(file, 'infrastructure/') AND {_suffix('repository|repo')} THEN 'repository' WHEN {_suffix('event|' + C.PAST.replace(' ', '|'))} THEN 'domain_event' WHEN {_suffix('repository|repo')} THEN 'repository'
WHEN {_suffix('service|svc')} THEN 'service' WHEN {_suffix('usecase|interactor')} THEN 'use_case' WHEN layer = 'infrastructure' AND {_suffix('handler|controller')} THEN 'adapter' ELSE {_VALUE} END AS kind, CAST(n_fields AS INTEGER) AS n_fields, CAST(n_methods AS INTEGER) AS n_methods FROM g""")
def go_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components read back from generated Go text."""
    from stratagraph.sources import tree

    found = tree.components(tree.facts(_sources(spark, sf_dir)), Config())
    return found.select("repo", "file", "name", "layer", "kind", F.size("fields").alias("n_fields"), F.size("methods").alias("n_methods"))


_TEXTS = {
    "rust": (".rs", "use std::fmt;\nuse crate::acme::mail;\n\n", "pub trait {n} {{\n    fn find(&self);\n}}\n", "pub struct {n} {{\n{fields}}}\n{impl}", "impl {i} for {n} {{\n}}\n", "    pub %s: %s,\n", "crate::acme::mail"),
    "typescript": (".ts", "import {{ A }} from '../acme/mail';\n// import '../no';\n\n", "export interface {n} {{\n  find(id: string): void;\n}}\n", "export class {n}{impl} {{\n}}\n", " implements {i}", "", "../acme/mail"),
    "java": (".java", "package a;\nimport java.util.List;\nimport com.acme.Mail;\n\n", "public interface {n} {{\n    void find(String id);\n}}\n", "public class {n}{impl} {{\n}}\n", " implements {i}", "", "com.acme.Mail"),
}


def _written_in(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """The components as files of a language: a file each, with its types, what they implement, and in Rust their fields."""
    ending, head, port, other, impl, field, _ = _TEXTS[language]

    def fill(pattern: str, **values) -> F.Column:
        names = [x.split("}", 1)[0] for x in pattern.replace("{{", "\0").split("{")[1:]]
        for n in values:
            pattern = pattern.replace("{" + n + "}", "%s")
        return F.format_string(pattern.replace("{{", "{").replace("}}", "}"), *[values[n] for n in names]) if names else F.lit(pattern.replace("{{", "{").replace("}}", "}"))

    c = testmap.components(spark, sf_dir)
    stated = F.when(F.size("implements") > 0, fill(impl, i=F.col("implements")[0], n=F.col("name"))).otherwise("")
    fields = F.array_join(F.transform("fields", lambda f: F.format_string(field, f["name"], f["type_name"])), "") if field else F.lit("")
    body = F.when(F.col("kind") == "port", fill(port, n=F.col("name"))).otherwise(fill(other, n=F.col("name"), fields=fields, impl=stated))
    one = c.groupBy("repo", "file", "component_id").agg(F.min_by(body, "seq").alias("body"), F.min("seq").alias("seq"))
    text = F.concat(F.lit(head.replace("{{", "{").replace("}}", "}")), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "body"))), lambda x: x["body"]), "\n"))
    return one.groupBy("repo", "file").agg(text.alias("content")).select("repo", F.regexp_replace("file", "[.]go$", ending).alias("path"), F.lit(language).alias("language"), "content")


def _all_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from functools import reduce

    from stratagraph.sources import tree

    return tree.facts(reduce(DataFrame.unionByName, [_written_in(spark, sf_dir, x) for x in _TEXTS] + [_sources(spark, sf_dir)]))


_O = f"WITH {C_}, o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY repo, file, component_id ORDER BY seq) = 1)"
_UP = "CASE WHEN layer = 'infrastructure' AND k NOT IN ('adapter', 'repository', 'service') AND " + _suffix("handler|controller") + " THEN 'adapter' ELSE k END"


@query(_O + " SELECT language, repo, replace(file, '.go', ending) AS file, name, layer, CASE WHEN kind = 'port' THEN 'port' ELSE " + _UP + " END AS kind, n_fields, CAST(kind = 'port' AS INTEGER) AS n_methods, CAST(kind <> 'port' AND implemented IS NOT NULL AS INTEGER) AS n_implements FROM ("
    + f"SELECT *, 'rust' AS language, '.rs' AS ending, CASE WHEN implemented IS NOT NULL THEN 'adapter' ELSE {_RUST} END AS k, CASE WHEN kind = 'port' THEN 0 ELSE CAST(has_id AS INTEGER) + CAST(ref_type IS NOT NULL AS INTEGER) END AS n_fields FROM o"
    + "".join(f" UNION ALL SELECT *, '{x}', '{_TEXTS[x][0]}', {_CLASS}, 0 FROM o" for x in ("typescript", "java")) + ")")
def source_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components read back from generated Rust, TypeScript and Java text."""
    from stratagraph.sources import tree

    found = tree.components(_all_languages(spark, sf_dir).where("language <> 'go'"), Config())
    language = F.create_map(*[F.lit(x) for k, v in _TEXTS.items() for x in (v[0], k)])[F.concat(F.lit("."), F.substring_index("file", ".", -1))]
    return found.select(language.alias("language"), "repo", "file", "name", "layer", "kind", F.size("fields").alias("n_fields"), F.size("methods").alias("n_methods"), F.size("implements").alias("n_implements"))


@query(_O + ", f AS (SELECT DISTINCT repo, file, layer FROM o) SELECT repo, replace(file, '.go', ending) AS file, import_path, from_layer FROM (SELECT repo, file, layer AS from_layer, unnest(['.rs', '.ts', '.java', '.go']) AS ending, unnest(['crate::acme::mail', '../acme/mail', 'com.acme.Mail', 'github.com/acme/x']) AS import_path FROM f)")
def import_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports read back from generated text of four languages, without their standard libraries."""
    from stratagraph.sources import tree

    return tree.dependencies(_all_languages(spark, sf_dir), Config()).select("repo", "file", "import_path", "from_layer")


@query(f"WITH {EDGES_}, t AS (SELECT repo, name AS top_pattern FROM ({_PATTERNS}) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY confidence DESC, list_position(['ddd-hexagonal', 'active-record', 'flat-crud', 'anemic-domain', 'service-layer'], name)) = 1) SELECT repo, (SELECT count(*) FROM nodes WHERE nodes.repo = t.repo) AS n_nodes, (SELECT count(*) FROM d WHERE d.repo = t.repo) AS n_dependencies, (SELECT count(*) FROM ({_ALL}) v WHERE v.repo = t.repo) AS n_violations, (SELECT count(DISTINCT string_split(package, '/')[-1]) FROM c WHERE c.repo = t.repo) AS n_packages, top_pattern FROM t")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the JSON report of each repository says (K4)."""
    from stratagraph.reports.render import json_rows

    of = lambda section, x: F.when(F.col("section") == section, x)
    part = lambda p: F.max(of("head", F.get_json_object("text", f"$.{p}")))
    n = lambda section: F.coalesce(F.sum(of(section, F.json_array_length("text"))), F.lit(0)).cast("bigint")
    rows = json_rows(_analysis(spark, sf_dir)).groupBy("repo")
    return rows.agg(part("component_count").cast("bigint").alias("n_nodes"), part("dependency_count").cast("bigint").alias("n_dependencies"), n("violations").alias("n_violations"), n("package_metrics").alias("n_packages"), part("top_pattern").alias("top_pattern"))


def _analysis(spark: SparkSession, sf_dir: str):
    from stratagraph.plans.analysis import Analysis

    f = Facts(spark, sf_dir)
    a = Analysis(f.components, f.dependencies, CONFIG)
    a.nodes = f.nodes
    return a


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, report): a JSON report a repository, as one text."""
    from stratagraph.reports.render import json_frame

    return json_frame(_analysis(spark, sf_dir))


@query(_O + " SELECT repo, file AS path, count(*) AS n_components FROM o GROUP BY repo, file")
def streaming_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that a stream of source files ends in, in two batches of which the second replaces most files of the first and leaves some (streaming form of J11, K13)."""
    import uuid

    from stratagraph.streaming import incremental
    from stratagraph.tables import shared_dir

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    full = written(_sources(spark, sf_dir), "sources")
    stays = F.col("path").endswith("f3.go")
    first = full.withColumn("content", F.when(stays, F.col("content")).otherwise("package p\ntype Gone struct {\n}\n")).withColumn("version", F.lit(1).cast("bigint"))
    for batch in (first, full.where(~stays).withColumn("version", F.lit(2).cast("bigint"))):
        batch.write.mode("append").parquet(f"{at}/in")
        incremental.start(incremental.read_files(spark, f"{at}/in"), f"{at}/state", f"{at}/log").awaitTermination()
    return incremental.current(spark, f"{at}/state").select("repo", "path", F.size("components").cast("bigint").alias("n_components"))
