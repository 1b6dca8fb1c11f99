"""Source trees of our own, from text to scores and reports."""

import json

import pytest
from pyspark.sql import functions as F

from stratagraph.config import Config, CustomRule, Ignore, LayerOverride
from stratagraph.extract.languages import extract
from stratagraph.operators import graph, history, rules
from stratagraph.plans import analysis
from stratagraph.reports import render
from stratagraph.sources import tree
from stratagraph.streaming import incremental

FILES = {
    "domain/user.go": 'package domain\n\ntype UserStore interface {\n\tFind(id string) (*User, error)\n}\n\ntype User struct {\n\tID string\n\tMail Address\n}\n\nfunc (u *User) Rename(n string) error { return nil }\n\ntype Address struct {\n\tStreet string\n}\n',
    "application/users.go": 'package application\n\nimport (\n\t"fmt"\n\t"shop.example/app/domain"\n)\n\ntype UserService struct {\n\tstore domain.UserStore\n}\n',
    "infrastructure/pg.go": 'package infrastructure\n\nimport "shop.example/app/domain"\n\ntype pgUsers struct {\n\tdsn string\n}\n\nfunc NewPgUsers(d string) domain.UserStore { return &pgUsers{} }\n\ntype mailer struct {\n\tkey string\n}\n\nfunc NewMailer() *mailer { return nil }\n',
    "domain/bad.go": 'package domain\n\nimport "shop.example/app/infrastructure"\n\nfunc init() {\n\tinfrastructure.Connect("x")\n}\n',
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("shop")
    for name, text in FILES.items():
        (at / name).parent.mkdir(exist_ok=True)
        (at / name).write_text(text)
    (at / "domain/user_test.go").write_text("package domain\ntype Fake struct{}\n")
    return str(at)


@pytest.fixture(scope="module")
def shop(spark, root):
    return analysis.of_tree(spark, root, "shop", Config())


def test_kinds(shop):
    got = {r.name: (r.kind, r.layer, r.implements, r.returns_concrete) for r in shop.components.collect()}
    assert got == {
        "UserStore": ("port", "domain", [], None), "User": ("entity", "domain", [], None), "Address": ("value_object", "domain", [], None), "UserService": ("service", "application", [], None),
        "pgUsers": ("adapter", "infrastructure", ["UserStore"], None), "mailer": ("adapter", "infrastructure", [], "mailer"),
    }


def test_violations(shop):
    got = sorted((r.rule, r.severity, r.file) for r in shop.violations.collect())
    assert got == [("L001", "error", "domain/bad.go"), ("L004", "warning", "domain/bad.go"), ("PA003", "warning", "infrastructure/pg.go")]
    assert render.check(shop)[1] == 1 and render.check(shop, "error", ["L001"]) == ("PASSED\n", 0)


def test_package_metrics(shop):
    got = {r.package: (r.abstractness, r.instability, r.distance) for r in shop.package_metrics.collect()}
    assert got == {"domain": (0.33, 0.33, 0.33), "application": (0.0, 1.0, 0.0), "infrastructure": (0.0, 0.5, 0.5)}


def test_score_and_reports(shop):
    s = shop.summary.first()
    assert s.top_pattern == "ddd-hexagonal" and s.structural_presence == 100 and 0 < s.overall < 100
    assert "L001 domain/bad.go:3" in render.text(shop) and "## Violations" in render.markdown(shop)
    assert json.loads(render.as_json(shop))["shop"]["violations"][0]["rule"] in ("L001", "L004", "PA003")
    assert "flowchart TB" in render.mermaid(shop) and "-->" not in render.mermaid(shop) and "breaks a layer" in render.mermaid(shop, spec=True)
    assert render.dot(shop, spec=True).count("->") == 3 and "wrong" in render.flow(shop) and "digraph" in render.flow(shop, "dot")
    assert "User" in render.forensic_markdown(shop) and render.score_line(shop).startswith("shop ")


def test_ignore_custom_rules_and_modes(spark, root):
    cfg = Config(ignore=(Ignore("L001", ("domain/**",)),), custom_rules=(CustomRule("no-app", "^infrastructure", "/domain$", "info"),), detect_init=False)
    assert sorted(r.rule for r in analysis.of_tree(spark, root, "shop", cfg).violations.collect()) == ["C-no-app", "PA003"]
    bad = Config(custom_rules=(CustomRule("x", "(", "y"), CustomRule("z", ".", ".")))
    with pytest.warns(UserWarning):
        assert not rules.custom_violations(analysis.of_tree(spark, root, "shop", bad).edges, bad).count()
    active = Config(overrides=(LayerOverride("domain/**", {}, "active-record"),))
    assert "L001" not in {r.rule for r in analysis.of_tree(spark, root, "shop", active).violations.collect()}


def test_unserved_port_and_no_edges(spark):
    files = spark.createDataFrame([("r", "domain/a.go", "go", "package d\ntype AuditLog interface {\n\tWrite(x string)\n}\n")], "repo string, path string, language string, content string")
    a = analysis.of_files(files, Config())
    assert [r.rule for r in a.violations.collect()] == ["PA002"] and a.summary.first().dependency_count == 0


def test_empty_and_null_files(spark):
    schema = "repo string, path string, language string, content string"
    for rows in ([], [("r", "a.go", "go", None), ("r", "b.go", "go", "")]):
        a = analysis.of_files(spark.createDataFrame(rows, schema), Config())
        assert a.components.count() == a.violations.count() == 0 and render.check(a)[1] == 0


def test_cycles(spark):
    e = spark.createDataFrame([("r", *x) for x in ("ab", "bc", "ca", "cd", "de", "ed", "xx", "fa")], "repo string, a string, b string")
    assert sorted(tuple(r.members) for r in graph.strongly_connected(e).collect()) == [("a", "b", "c"), ("d", "e")]
    assert graph.strongly_connected(e.where("a = 'f'")).count() == 0


@pytest.mark.parametrize("most", [0, 1000])
def test_cycles_against_reachability(spark, most):
    import random

    rng = random.Random(most)
    e = {(f"n{rng.randrange(25):02}", f"n{rng.randrange(25):02}") for _ in range(40)}
    reach = {(a, b) for a, b in e}
    while more := {(a, d) for a, b in reach for c, d in e if b == c} - reach:
        reach |= more
    parts = {tuple(sorted({b for b in {x for y in e for x in y} if b == a or ((a, b) in reach and (b, a) in reach)})) for a in {x for y in e for x in y}}
    got = graph.strongly_connected(spark.createDataFrame([("r", a, b) for a, b in e], "repo string, a string, b string"), most).collect()
    assert sorted(tuple(r.members) for r in got) == sorted(p for p in parts if len(p) > 1) and all(r.component == r.members[0] for r in got)


def test_long_names(spark):
    """Names of 10,000 characters in every place whose substrings are compared."""
    long = "github.com/" + "import/adapterImpl" * 600
    text = f'package d\n\nimport "{long}"\nimport "x.io/app/infrastructure/y"\n\ntype MailPort interface {{\n\tFind(x string)\n}}\ntype Thing struct {{\n\tID string\n\tF {"Addr" * 2500}\n}}\ntype Addr struct {{\n\tX int\n}}\n'
    files = spark.createDataFrame([("r", "domain/a.go", "go", text), ("r", "app/infrastructure/b.go", "go", "package i\ntype smtpMailportAdapter struct {\n\tK string\n}\nfunc NewSmtpMailportAdapter() string { return \"\" }\n")], "repo string, path string, language string, content string")
    a = analysis.of_files(files, Config())
    ends = {r.node_id: r.is_external for r in a.nodes.where("kind is null").collect()}
    assert ends[f"{long}::<package>"] and not ends["x.io/app/infrastructure/y::<package>"] and a.violations.count() >= 0
    assert [r.value_object for r in __import__("stratagraph.operators.forensics", fromlist=["x"]).entity_value_objects(a.components).collect()] == ["Addr"]


def test_reports_are_whole(spark):
    """1,500 rows in each section."""
    types = "".join(f"type E{k} struct {{\n\tID string\n\tv V{k}x\n}}\ntype V{k}x struct {{\n\tA int\n}}\n" for k in range(1500))
    files = spark.createDataFrame([("r", "domain/a.go", "go", "package d\n" + types)] + [("r", f"domain/b{k}.go", "go", 'package d\nimport "x.io/mongo"\n') for k in range(1500)], "repo string, path string, language string, content string")
    a = analysis.of_files(files, Config())
    text = render.forensic_markdown(a)
    assert all(f"domain::E{k} |" in text and f"| domain::E{k} | V{k}x |" in text and f"- E{k}: " in text for k in range(1500)) and text.count("rich model") == 1500 and text.count("| L005 |") == 1500
    assert render.text(a).count(" L005 ") == 1500 and render.markdown(a).count("| L005 |") == 1500 and render.check(a)[0].count("L005 ") == 1500


def test_cache(spark):
    schema = "repo string, path string, language string, content string"
    one = spark.createDataFrame([("r", "a.go", "go", FILES["domain/user.go"]), ("r", "b.go", "go", "package b\ntype B struct {\n\tX int\n}\n")], schema)
    first = analysis.of_files(one, Config())
    two = one.withColumn("content", F.when(F.col("path") == "b.go", "package b\ntype C struct {\n\tX int\n}\n").otherwise(F.col("content")))
    hits, misses = history.cache_split(history.with_hash(two), first.files)
    assert [r.path for r in hits.collect()] == ["a.go"] and [r.path for r in misses.collect()] == ["b.go"]
    assert {r.name for r in analysis.of_files(two, Config(), state=first.files).components.collect()} == {"UserStore", "User", "Address", "C"}


def test_services(spark, tmp_path):
    for svc in ("auth", "order"):
        for name, text in FILES.items():
            p = tmp_path / "services" / svc / name
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(text)
    a, total, shared = analysis.per_service(spark, str(tmp_path), Config())
    assert {r.repo for r in a.summary.collect()} == {"services/auth", "services/order"} and total.first().files_analyzed == 8
    assert {r.module: r.used_by for r in shared.collect()}["shop.example/app/domain"] == ["services/auth", "services/order"]


def test_history(spark, tmp_path):
    p = tmp_path / "history"
    p.mkdir()
    (p / "a.json").write_text('{"timestamp":"2024-01-01T00:00:00Z","git_commit":"x","result":{"component_count":3}}\nbroken\n\n{"timestamp":"2024-01-02T00:00:00Z","result":{"component_count":5}}\n')
    h = history.read_history(spark, str(p))
    assert h.count() == 2 and history.latest(h.withColumn("k", F.lit(1)), ["k"], ["ts"]).first().result.component_count == 5
    history.append_history(h.limit(1), str(p))
    assert history.read_history(spark, str(p)).count() == 3


def test_stream_replaces_facts(spark, tmp_path):
    put = lambda n, text, v: spark.createDataFrame([("r", "a.go", "go", text, v)], incremental.FILES).write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: incremental.start(incremental.read_files(spark, str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "log")).awaitTermination()
    for n, (text, names) in enumerate((("package a\ntype A struct {\n}\n", ["A"]), ("package a\ntype B struct {\n}\n", ["B"]), ("package a\ntype B struct {\n}\n", ["B"]))):
        put(n, text, n)
        go()
        assert [c.name for r in incremental.current(spark, str(tmp_path / "state")).collect() for c in r.components] == names


def names(path, language, text):
    c, d = extract(path, language, text)
    return {(x.name, x.decl, tuple(x.implements), x.note) for x in c}, [x.path for x in d]


def test_go_details():
    c, d = extract("a.go", "go", 'package a\n// type No struct {}\nvar s = `type No struct {\n}`\nimport q "x.io/y"\ntype hidden interface {\n\tA()\n}\ntype T[K any] struct {\n\tA, B int `json:"a"`\n}\nfunc (t T) M(a int) (int, error) {\n}\n')
    assert [(x.name, x.fields, [m[0] for m in x.methods]) for x in c] == [("T", [("A", "int"), ("B", "int")], ["M"])] and [x.path for x in d] == ["x.io/y"]


def test_typescript():
    got = names("a.ts", "typescript", "import { A } from './a';\nimport type B from \"../b\";\nimport './side';\nexport interface Repo<T> extends X {\n  find(id: string): T;\n  save?(x: T): void;\n  name: string;\n}\ntype Shape = { a: number };\nexport class PgRepo extends Base implements Repo<User>, Other {\n}\nclass Plain {}\n")
    assert got == ({("Repo", "interface", (), None), ("Shape", "interface", (), None), ("PgRepo", "class", ("Repo", "Other"), None), ("Plain", "class", (), None)}, ["./a", "../b", "./side"])
    assert extract("a.d.ts", "typescript", "interface A {}") == ([], [])


def test_java():
    got = names("A.java", "java", "package a;\nimport java.util.List;\nimport com.acme.domain.User;\nimport static com.x.Y.*;\npublic interface Users { User find(String id) throws E; }\n@Repository\npublic class JpaUsers implements Users { }\n@Service(\"x\")\nclass Named extends B { }\n")
    assert got == ({("Users", "interface", (), None), ("JpaUsers", "class", ("Users",), "repository"), ("Named", "class", (), None)}, ["com.acme.domain.User", "com.x.Y.*"])


def test_rust():
    got = names("a.rs", "rust", "use std::fmt;\nuse crate::domain::{User,\n  Mail};\npub trait Users { fn find(&self) -> User; }\npub struct PgUsers { pub pool: Pool<A, B>, id: u32 }\nimpl Users for PgUsers { fn find(&self) -> User { } }\nstruct Unit;\n")
    assert got == ({("Users", "interface", (), None), ("PgUsers", "struct", ("Users",), None), ("Unit", "struct", (), None)}, ["crate::domain::{User, Mail}"])


def test_listing_and_languages(spark, root):
    files = tree.scan(spark, root, "shop")
    assert tree.detect_languages(files) == ["go"] and files.count() == 4
    assert tree.scan(spark, root, "shop", under="domain").count() == 2
    assert [(r.path, r.depth, r.is_dir) for r in tree.listing(files.where("path = 'domain/bad.go'")).collect()] == [("domain", 0, True), ("domain/bad.go", 1, False)]
