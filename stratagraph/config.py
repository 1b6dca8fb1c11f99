"""Configuration: TOML files as frozen dataclasses, and where to find them."""

from __future__ import annotations

import subprocess
import tomllib
import warnings
from dataclasses import dataclass, field
from pathlib import Path

FILE_NAMES = (".stratagraph.toml", "stratagraph.toml")
LAYERS = ("domain", "application", "infrastructure", "presentation")
SEVERITIES = ("info", "warning", "error")


def _globs(words: str) -> tuple[str, ...]:
    return tuple(f"**/{w}/**" for w in words.split())


@dataclass(frozen=True)
class LayerOverride:
    """Patterns that hold inside one scope; a layer without patterns here keeps the global ones."""

    scope: str
    patterns: dict[str, tuple[str, ...]] = field(default_factory=dict)
    mode: str | None = None


@dataclass(frozen=True)
class CustomRule:
    name: str
    from_pattern: str
    to_pattern: str
    severity: str = "error"
    message: str | None = None
    action: str = "deny"


@dataclass(frozen=True)
class Ignore:
    rule: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Config:
    languages: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ("**/testdata/**", "**/*_test.go", "vendor/**")
    services_pattern: str | None = None
    patterns: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "domain": _globs("domain entity model"),
            "application": _globs("application usecase service"),
            "infrastructure": _globs("infrastructure adapter repository persistence"),
            "presentation": _globs("presentation handler api cmd"),
        }
    )
    overrides: tuple[LayerOverride, ...] = ()
    cross_cutting: tuple[str, ...] = ()
    mode: str = "ddd"
    weights: tuple[float, float, float] = (0.4, 0.4, 0.2)  # conformance, compliance, coverage
    severities: dict[str, str] = field(
        default_factory=lambda: {
            "circular_dependency": "error",
            "constructor_concrete": "warning",
            "domain_infra_leak": "error",
            "init_coupling": "warning",
            "layer_direction": "error",
            "missing_implementation": "info",
            "missing_port": "warning",
        }
    )
    fail_on: str = "error"
    min_score: float | None = None
    custom_rules: tuple[CustomRule, ...] = ()
    detect_init: bool = True
    ignore: tuple[Ignore, ...] = ()


def parse_severity(text: str) -> str:
    """Accepts any case, and "warn"."""
    low = text.strip().lower()
    low = "warning" if low == "warn" else low
    if low not in SEVERITIES:
        raise ValueError(f"unknown severity: {text}")
    return low


def parse(text: str) -> Config:
    """A TOML text, with defaults for what it leaves out and the older names of two weights."""
    raw, base = tomllib.loads(text), Config()
    project, layers, scoring, rules = (raw.get(k, {}) for k in ("project", "layers", "scoring", "rules"))
    overrides = tuple(LayerOverride(o["scope"], {k: tuple(o[k]) for k in LAYERS if o.get(k)}, o.get("architecture_mode")) for o in layers.get("overrides", []))
    custom = tuple(CustomRule(c["name"], c["from_pattern"], c["to_pattern"], parse_severity(c.get("severity", "error")), c.get("message"), c.get("action", "deny")) for c in rules.get("custom_rules", []))
    return Config(
        languages=tuple(project.get("languages", base.languages)),
        exclude=tuple(project.get("exclude_patterns", base.exclude)),
        services_pattern=project.get("services_pattern"),
        patterns={k: tuple(layers.get(k, base.patterns[k])) for k in LAYERS},
        overrides=overrides,
        cross_cutting=tuple(layers.get("cross_cutting", ())),
        mode=layers.get("architecture_mode", base.mode),
        weights=(
            float(scoring.get("layer_conformance_weight", scoring.get("layer_isolation_weight", base.weights[0]))),
            float(scoring.get("dependency_compliance_weight", scoring.get("dependency_direction_weight", base.weights[1]))),
            float(scoring.get("interface_coverage_weight", base.weights[2])),
        ),
        severities={k: parse_severity(v) for k, v in rules["severities"].items()} if "severities" in rules else base.severities,
        fail_on=parse_severity(rules.get("fail_on", base.fail_on)),
        min_score=rules.get("min_score"),
        custom_rules=custom,
        detect_init=rules.get("detect_init_functions", True),
        ignore=tuple(Ignore(i["rule"], tuple(i["paths"])) for i in rules.get("ignore", [])),
    )


def load(path: str | Path) -> Config:
    return parse(Path(path).read_text())


def find(start: str | Path) -> Path | None:
    """The nearest configuration file in a folder or its ancestors."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        for name in FILE_NAMES:
            if (folder / name).is_file():
                return folder / name
    return None


def discover(start: str | Path) -> Config:
    """The nearest configuration; a malformed one gives a warning and the defaults."""
    path = find(start)
    if not path:
        return Config()
    try:
        return load(path)
    except (ValueError, KeyError, TypeError) as e:
        warnings.warn(f"{path} can't be read, the defaults hold: {e}", stacklevel=2)
        return Config()


def project_root(start: str | Path, config_path: str | Path | None = None) -> Path:
    """The folder of the configuration given, or the nearest ancestor with one or with a git folder, or the start."""
    if config_path:
        return Path(config_path).resolve().parent
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        if (folder / ".git").exists() or any((folder / n).is_file() for n in FILE_NAMES):
            return folder
    return at


def git(root: str | Path, *args: str) -> str | None:
    """What a git command prints, None if it fails."""
    try:
        done = subprocess.run(["git", "-C", str(root), *args], capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() if done.returncode == 0 and done.stdout.strip() else None


def git_state(root: str | Path) -> tuple[str | None, str | None]:
    """(commit, branch)."""
    return git(root, "rev-parse", "HEAD"), git(root, "rev-parse", "--abbrev-ref", "HEAD")


def changed_files(root: str | Path) -> list[str]:
    """Files changed since the last commit, and untracked ones."""
    found = [git(root, "diff", "--name-only", "HEAD"), git(root, "ls-files", "--others", "--exclude-standard")]
    return sorted({line for x in found if x for line in x.splitlines()})


TEMPLATE = """# Layers are found by globs over file paths; * also crosses folders.
[project]
# languages = ["go", "typescript"]
# services_pattern = "services/*"

[layers]
{layers}
# cross_cutting = ["**/logging/**"]
# architecture_mode = "ddd"          # or "active-record", "service-oriented"

[scoring]
layer_conformance_weight = 0.4
dependency_compliance_weight = 0.4
interface_coverage_weight = 0.2

[rules]
fail_on = "error"
detect_init_functions = true

[rules.severities]
{severities}
"""


def template() -> str:
    """A configuration file with the defaults, which parse() reads back."""
    base = Config()
    return TEMPLATE.format(
        layers="\n".join(f"{k} = [{', '.join(f'"{p}"' for p in v)}]" for k, v in base.patterns.items()),
        severities="\n".join(f'{k} = "{v}"' for k, v in base.severities.items()),
    )
