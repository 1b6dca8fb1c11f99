import re

import pytest
from pyspark.sql import functions as F

from stratagraph import config as K
from stratagraph.functions import classify as C
from stratagraph.functions.globs import any_of, to_regex

GLOBS = [
    ("**/domain/**", "a/domain/x.go", True), ("**/domain/**", "domain/x.go", True), ("**/domain/**", "domain", False), ("**/domain/**", "subdomain/x.go", False), ("vendor/**", "vendor/a/b", True), ("*.go", "a/b.go", True),
    ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("src/?.ts", "src/a.ts", True), ("{app,core}/**", "core/x", True), ("[ab]x", "bx", True), ("[!ab]x", "bx", False), ("a.b", "axb", False),
]


@pytest.mark.parametrize(("glob", "path", "expected"), GLOBS)
def test_globs(glob, path, expected):
    assert bool(re.search(to_regex(glob), path)) == expected


def test_invalid_globs_are_left_out():
    assert to_regex("a{b") is None and to_regex("[a") is None and any_of(["[a"]) is None


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_override_without_fall_through(spark):
    cfg = K.Config(overrides=(K.LayerOverride("svc/**", {"domain": ("**/core/**",)}, "active-record"),))
    for path, layer in (("svc/core/a.go", "domain"), ("svc/domain/a.go", None), ("svc/service/a.go", "application"), ("x/domain/a.go", "domain"), ("./domain\\a.go", "domain")):
        assert one(spark, C.layer_of(F.col("p"), cfg), p=path) == layer, path
    assert one(spark, C.mode_of(F.col("p"), cfg), p="svc/a.go") == "active-record" and one(spark, C.mode_of(F.col("p"), cfg), p="a.go") == "ddd"


@pytest.mark.parametrize(("path", "layer"), [("github.com/x/domain", "domain"), ("infrastructure", "infrastructure"), ("x/api/y", "presentation"), ("x/y", None), ("x/models", "domain"), ("crate::domain::user", None)])
def test_import_layers(spark, path, layer):
    assert one(spark, C.import_layer(F.col("p"), K.Config()), p=path) == layer


@pytest.mark.parametrize(("path", "category"), [("fmt", "stdlib"), ("crate::domain::x", "stdlib"), ("java.util.List", "stdlib"), ("com.acme.domain.User", "internal_domain"), ("./user", "internal_domain"), ("x.io/infrastructure/db", "internal_infrastructure"), ("x.io/y", "external")])
def test_import_categories(spark, path, category):
    assert one(spark, C.import_category(F.col("p")), p=path) == category


def test_layers_order_and_rules(spark):
    d = lambda a, b: one(spark, C.violates(F.col("a"), F.col("b")), a=a, b=b)
    assert d("domain", "infrastructure") and d("infrastructure", "presentation") and not d("presentation", "domain") and not d("domain", "domain")
    assert one(spark, C.rule_of_layers(F.col("a"), F.col("b")), a="application", b="infrastructure") == "L003"
    assert one(spark, C.doc_url(F.col("r")), r="PA001").endswith("#pa001") and one(spark, C.doc_url(F.col("r")), r="C-x") is None


def test_names(spark):
    assert one(spark, C.adapter_base(F.col("n")), n="UserHandlerHandler") == "user" and one(spark, C.port_base(F.col("n")), n="UserServicePort") == "user"
    assert one(spark, C.constructed_name(F.col("n")), n="NewMailSender") == "mailSender" and one(spark, C.constructed_name(F.col("n")), n="New") == ""
    assert one(spark, C.dot_id(F.col("n")), n="1a::b") == "n_1a__b" and one(spark, C.short_label(F.col("n")), n="a/b/c") == "b/c"


def test_config_round_trip_and_aliases(tmp_path):
    assert K.parse(K.template()) == K.Config(exclude=K.Config().exclude)
    c = K.parse('[scoring]\nlayer_isolation_weight = 0.7\n[rules]\nfail_on = "warn"\n[[rules.ignore]]\nrule = "L001"\npaths = ["a/**"]\n')
    assert c.weights == (0.7, 0.4, 0.2) and c.fail_on == "warning" and c.ignore[0].rule == "L001"
    (tmp_path / "stratagraph.toml").write_text("[broken")
    with pytest.warns(UserWarning):
        assert K.discover(tmp_path) == K.Config()
    assert C.severity_of("L001", K.Config(severities={"L001": "info", "layer_direction": "error"}), "error") == "info"
