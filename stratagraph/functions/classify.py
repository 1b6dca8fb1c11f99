"""Scalar functions of the analysis as column expressions: kinds, layers, categories, names and identifiers.

None of them is a Python UDF; configuration becomes literals when the plan is made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratagraph.config import LAYERS, SEVERITIES, Config
from stratagraph.functions.globs import any_of

PAST = " ".join(sorted("succeeded rejected reversed approved applied canceled cancelled closed completed created deactivated activated deleted dispatched expired failed finalized opened paid processed published recorded refunded updated voided".split()))
CRUD = sorted(("Persist", "Remove", "Upsert", "List", "Fetch", "Get", "GetAll", "FindBy", "FindByID", "Create", "Insert", "Delete", "Update", "Save", "Load"), key=str.lower)
STORES = "|".join(sorted("sqlite elasticsearch cassandra dynamodb db sql database mongo redis mysql postgres".split()))
CONCRETE = "mongo|redis|mysql|postgres"
CENTROIDS = {"domain": (0.75, 0.15), "application": (0.40, 0.50), "infrastructure": (0.15, 0.75), "presentation": (0.15, 0.75)}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ends(name: Column, words: str) -> Column:
    return F.lower(name).rlike(f"({words})$")


def is_event_name(name: Column) -> Column:
    return ends(name, "event|" + PAST.replace(" ", "|"))


def lower_first(name: Column) -> Column:
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))


def upper_first(name: Column) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))


def constructed_name(constructor: Column) -> Column:
    """The type that a Go constructor makes, in lower-first form; empty if the name is no constructor's."""
    return F.when(constructor.rlike("^New."), lower_first(F.substring(constructor, 4, 1 << 30))).otherwise("")


def has_identity(fields: Column) -> Column:
    return F.exists(fields, lambda f: F.lower(f["name"]).isin("id", "uuid"))


def _value_or_entity(fields: Column) -> Column:
    return F.when((F.size(fields) > 0) & ~has_identity(fields), "value_object").otherwise("entity")


def go_kind(name: Column, fields: Column, path: Column, constructor_type: Column, constructor_package: Column) -> Column:
    """Kind of a Go struct; the constructor's columns are null where there is none, the package empty if it returns a type of its own package."""
    infra = path.contains("infrastructure/")
    made = infra & constructor_type.isNotNull()
    return (
        F.when(infra & ends(name, "repository|repo"), "repository")
        .when(made & ends(constructor_type, "repository|repo"), "repository")
        .when(made, "adapter")
        .when(path.contains("domain/events/") | is_event_name(name), "domain_event")
        .when(ends(name, "repository|repo"), "repository")
        .when(ends(name, "service|svc"), "service")
        .when(ends(name, "usecase|interactor"), "use_case")
        .otherwise(_value_or_entity(fields))
    )


def rust_kind(name: Column, fields: Column) -> Column:
    return (
        F.when(ends(name, "repository|repo"), "repository")
        .when(ends(name, "service|svc"), "service")
        .when(ends(name, "handler|controller"), "adapter")
        .when(ends(name, "usecase|interactor"), "use_case")
        .when(ends(name, "event"), "domain_event")
        .otherwise(_value_or_entity(fields))
    )


def class_kind(name: Column, implements: Column) -> Column:
    """Kind of a TypeScript or Java class."""
    return (
        F.when(ends(name, "repository|repo"), "repository")
        .when(ends(name, "service|svc"), "service")
        .when(ends(name, "handler|controller"), "adapter")
        .when(ends(name, "usecase|interactor"), "use_case")
        .when(F.size(implements) > 0, "adapter")
        .otherwise("entity")
    )


def is_active_record(methods: Column) -> Column:
    return F.size(F.filter(methods, lambda m: m["name"].rlike(f"^({'|'.join(CRUD)})"))) >= 2


def upgraded_kind(kind: Column, layer: Column, name: Column) -> Column:
    """Handlers and controllers of the infrastructure layer are adapters."""
    return F.when((layer == "infrastructure") & ~kind.isin("adapter", "repository", "service") & ends(name, "handler|controller"), "adapter").otherwise(kind)


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), "^\\./", "")


def matches(path: Column, globs) -> Column:
    pattern = any_of(globs)
    return path.rlike(pattern) if pattern else F.lit(False)


def _first_layer(path: Column, patterns: dict) -> Column:
    found = F.lit(None).cast("string")
    for layer in reversed(LAYERS):
        found = F.when(matches(path, patterns.get(layer, ())), layer).otherwise(found)
    return found


def layer_of(path: Column, config: Config) -> Column:
    """The layer of a path: the first override whose scope matches decides, else the global patterns; null if none matches."""
    path, out = normal_path(path), None
    for o in config.overrides:
        own = _first_layer(path, {k: o.patterns.get(k) or config.patterns[k] for k in LAYERS})
        out = F.when(matches(path, [o.scope]), own) if out is None else out.when(matches(path, [o.scope]), own)
    last = _first_layer(path, config.patterns)
    return last if out is None else out.otherwise(last)


def mode_of(path: Column, config: Config) -> Column:
    path, out = normal_path(path), None
    for o in config.overrides:
        here = F.lit(o.mode or config.mode)
        out = F.when(matches(path, [o.scope]), here) if out is None else out.when(matches(path, [o.scope]), here)
    return F.lit(config.mode) if out is None else out.otherwise(config.mode)


def is_cross_cutting(path: Column, config: Config) -> Column:
    return matches(normal_path(path), config.cross_cutting)


def _candidates(path: Column) -> list[Column]:
    return [path, F.concat(F.lit("**/"), path), F.concat(path, F.lit("/**"))]


def is_cross_cutting_import(path: Column, config: Config) -> Column:
    return reduce(lambda a, b: a | b, [matches(x, config.cross_cutting) for x in _candidates(F.translate(path, "\\", "/"))])


def import_layer(path: Column, config: Config) -> Column:
    """The layer of an imported path: by the patterns, then by the words in it."""
    low = F.lower(path)
    last = F.element_at(F.split(low, "/"), -1)

    def has(words: str, extra: str = "") -> Column:
        return low.rlike("/(" + words.replace(" ", "|") + ")" + extra) | last.isin(words.split())

    guess = (
        F.when(has("domain entity model"), "domain")
        .when(has("application usecase service"), "application")
        .when(has("infrastructure adapter repository persistence"), "infrastructure")
        .when(has("presentation handler cmd") | low.contains("/api/"), "presentation")
    )
    return F.coalesce(*[layer_of(x, config) for x in _candidates(path)], guess)


def depth(layer: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, name in enumerate(LAYERS):
        out = F.when(layer == name, k).otherwise(out)
    return out


def violates(source: Column, target: Column) -> Column:
    """Whether a layer must not depend on another; null if either is unknown."""
    return depth(source) < depth(target)


def rule_of_layers(source: Column, target: Column) -> Column:
    return (
        F.when((source == "domain") & (target == "infrastructure"), "L001")
        .when((source == "domain") & (target == "application"), "L002")
        .when((source == "application") & (target == "infrastructure"), "L003")
        .otherwise("L099")
    )


RULE_NAMES = {
    "D001": "circular-dependency", "L001": "domain-depends-on-infrastructure", "L002": "domain-depends-on-application", "L003": "application-bypasses-ports", "L004": "init-function-coupling",
    "L005": "domain-uses-infrastructure-type", "L099": "inner-layer-depends-outwards", "PA001": "missing-port-interface", "PA002": "port-without-implementation", "PA003": "constructor-returns-concrete-type",
}
CATEGORIES = {"D001": "circular_dependency", "L001": "layer_direction", "L002": "layer_direction", "L003": "layer_direction", "L004": "init_coupling", "L005": "domain_infra_leak", "L099": "layer_direction", "PA001": "missing_port", "PA002": "missing_implementation", "PA003": "constructor_concrete"}


def rule_name(rule: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in RULE_NAMES.items() for x in pair])
    return F.when(rule.startswith("C-"), F.substring(rule, 3, 1 << 30)).otherwise(names[rule])


def doc_url(rule: Column, base: str = "https://example.org/rules") -> Column:
    return F.when(~rule.startswith("C-"), F.concat(F.lit(base + "#"), F.lower(rule)))


def severity_of(rule: str, config: Config, default: str) -> str:
    """A rule's own severity before its category's."""
    return config.severities.get(rule, config.severities.get(CATEGORIES.get(rule, ""), default))


def severity_order(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int")


def package_of(component: Column) -> Column:
    return F.substring_index(component, "::", 1)


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def segment_before_last(path: Column) -> Column:
    """Null if there is no slash."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-2)))


def round2(x: Column) -> Column:
    return F.round(x * 100) / 100


def has_segment(path: Column, word: str) -> Column:
    return F.array_contains(F.split(path, "[/.:]"), word)


def layer_word(path: Column) -> Column:
    """The first layer keyword among a path's segments, in its long form; null if there is none."""
    words = F.array(*[F.lit(w) for w in ("domain", "application", "infrastructure", "app", "infra")])
    first = F.try_element_at(F.array_intersect(words, F.split(path, "[/.:]")), F.lit(1))
    return F.create_map(*[F.lit(x) for x in ("domain", "domain", "application", "application", "infrastructure", "infrastructure", "app", "application", "infra", "infrastructure")])[first]


def import_category(path: Column) -> Column:
    """As forensic reports sort imports."""
    low = F.lower(path)
    return (
        F.when(~path.contains(".") & ~path.startswith("./"), "stdlib")
        .when(path.rlike("^(std|core)::"), "stdlib")
        .when(path.rlike("^javax?\\."), "stdlib")
        .when(low.rlike("/domain|::domain::|\\.domain\\."), "internal_domain")
        .when(low.rlike("/application/|::application::|\\.application\\.|/usecase/"), "internal_application")
        .when(low.rlike("/infrastructure/|::infrastructure::|\\.infrastructure\\.|/adapter/"), "internal_infrastructure")
        .when(path.rlike("^(\\.\\.?/|crate::|super::)"), "internal_domain")
        .otherwise("external")
    )


def adapter_base(name: Column) -> Column:
    out = F.lower(name)
    for word in ("handler", "controller", "adapter", "impl"):
        out = F.regexp_replace(out, f"({word})+$", "")
    return out


def port_base(name: Column) -> Column:
    out = F.lower(name)
    for word in ("port", "interface", "repository", "service"):
        out = F.regexp_replace(out, f"({word})+$", "")
    return out


def mermaid_id(component: Column) -> Column:
    return F.translate(F.regexp_replace(component, "::", "_"), "/.- <>", "____")


def dot_id(component: Column) -> Column:
    clean = F.regexp_replace(component, "[^A-Za-z0-9]", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("n_"), clean)).otherwise(clean)


def short_label(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.concat_ws("/", F.slice(parts, -2, 2))).otherwise(path)


def is_go_stdlib(path: Column) -> Column:
    return ~path.contains(".")
