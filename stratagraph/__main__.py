"""Command line: analyze, check, init, diagram and forensics over a source tree. Exit codes: 0 passed, 1 a check failed, 2 an error."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stratagraph import config as K
from stratagraph.operators import history, rules
from stratagraph.plans import analysis
from stratagraph.reports import render
from stratagraph.sources import tree

HISTORY, CACHE = ".stratagraph/history", ".stratagraph/cache"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratagraph", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, formats: tuple[str, ...] = ()) -> argparse.ArgumentParser:
        v = sub.add_parser(name)
        v.add_argument("path", nargs="?", default=".")
        v.add_argument("--config")
        v.add_argument("--languages", default="")
        if formats:
            v.add_argument("--format", choices=formats, default=formats[0])
        return v

    for v in (verb("analyze", ("text", "json", "markdown")), verb("check", ("text", "json", "markdown"))):
        v.add_argument("--per-service", action="store_true")
        v.add_argument("--compact", action="store_true")
        v.add_argument("--score-only", action="store_true")
        v.add_argument("--ignore", action="append", default=[], help="rule ids, separated by commas")
        v.add_argument("--package-cycles", action="store_true", help="look for cycles of packages, too")
        v.add_argument("--incremental", action="store_true", help="take facts of unchanged files from the last run")
        v.add_argument("--fail-on", type=K.parse_severity)
        v.add_argument("--track", action="store_true")
        v.add_argument("--no-regression", action="store_true")
    sub.add_parser("init").add_argument("--force", action="store_true")
    d = verb("diagram", ("mermaid", "dot"))
    d.add_argument("--type", choices=("layers", "flow"), default="layers")
    d.add_argument("--packages", action="store_true", help="draw packages and their imports")
    f = verb("forensics")
    f.add_argument("--output")
    f.add_argument("--project-root", help="the project that the path is a module of")
    return p


def _session() -> SparkSession:
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _check(spark: SparkSession, a: analysis.Analysis, args: argparse.Namespace, root: Path) -> tuple[str, int]:
    text, code = render.check(a, args.fail_on, args.ignore)
    at = root / HISTORY
    if args.no_regression and at.is_dir():
        before = history.read_history(spark, str(at)).withColumn("repo", F.coalesce("result.repo", F.lit("repo")))
        last = history.latest(before, ["repo"], ["ts"]).select("repo", F.col("result.score.overall").alias("overall"))
        fell = history.regressions(last, a.summary.select("repo", "overall")).orderBy("repo").collect()
        if fell:
            lines = [f"The score of {r.repo} fell from {r.before:.1f} to {r.after:.1f}.\n" for r in fell]
            text, code = "".join(lines) + text.replace("PASSED", "FAILED"), 1
    if args.track:  # after the comparison, so that a run is not compared with itself
        history.append_history(history.snapshots(a.summary, a.violations, datetime.now(UTC).isoformat(), *K.git_state(root), a.files, a.package_metrics, a.patterns), str(at))
    if args.format == "json":
        counts = {r.repo: {k: r[k] for k in r.asDict() if k != "repo"} for r in a.violation_kinds().collect()}
        text = json.dumps({"passed": not code, "messages": text.splitlines()[:-1], "counts": counts}) + "\n"
    elif args.format == "markdown":
        text = render.check_markdown(a, not code, args.fail_on, args.ignore)
    return text, code


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.verb == "init":
        at = Path(K.FILE_NAMES[0])
        if at.exists() and not args.force:
            print(f"{at} is there already; --force replaces it", file=sys.stderr)
            return 2
        at.write_text(K.template())
        return 0
    path = Path(args.path).resolve()
    if not path.is_dir():
        print(f"{path} is no folder", file=sys.stderr)
        return 2
    root = K.project_root(path, args.config)
    cfg = K.load(args.config) if args.config else K.discover(path)
    if args.languages:
        from dataclasses import replace

        cfg = replace(cfg, languages=tuple(args.languages.split(",")))
    spark = _session()
    if hasattr(args, "ignore"):
        args.ignore = [r.strip() for x in args.ignore for r in x.split(",") if r.strip()]
    if not cfg.languages:
        from dataclasses import replace

        cfg = replace(cfg, languages=tuple(tree.detect_languages(tree.scan(spark, str(path)).select("path"))))
    if args.verb in ("analyze", "check") and args.per_service:
        a, total, shared = analysis.per_service(spark, str(path), cfg, cycles="packages" if args.package_cycles else "nodes")
        if args.verb == "analyze":
            if args.ignore:
                a.violations = rules.without_rules(a.violations, args.ignore)
            print(render.services(a, total, shared, args.format), end="")
            return 0
        out, code = _check(spark, a, args, root)
        print((render.services(a, total, shared, args.format) if args.format != "json" else "") + out, end="")
        return code
    base, under = path, ""
    if args.verb == "forensics" and args.project_root:
        base = Path(args.project_root).resolve()
        if not path.is_relative_to(base):
            print(f"{path} is not in {base}", file=sys.stderr)
            return 2
        under = "" if path == base else str(path.relative_to(base))
    cache = str(root / CACHE) if getattr(args, "incremental", False) else None
    a = analysis.of_tree(spark, str(base), "repo", cfg, cache, under, cycles="packages" if getattr(args, "package_cycles", False) else "nodes", project_root=str(root))
    code = 0
    if args.verb == "check":
        out, code = _check(spark, a, args, root)
    elif args.verb == "analyze":
        if args.ignore:
            a.violations = rules.without_rules(a.violations, args.ignore)
        out = render.score_line(a, args.format == "json") + "\n" if args.score_only else {"text": render.text, "markdown": render.markdown, "json": lambda x: render.as_json(x, not args.compact) + "\n"}[args.format](a)
    elif args.verb == "diagram":
        out = render.flow(a, args.format) if args.type == "flow" else {"mermaid": render.mermaid, "dot": render.dot}[args.format](a, args.packages)
    else:
        out = render.forensic_markdown(a)
        if args.output:
            Path(args.output).write_text(out)
            out = ""
    print(out, end="")
    return code


if __name__ == "__main__":
    sys.exit(main())
