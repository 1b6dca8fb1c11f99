"""Source trees as tables: the scan, languages, listings, and the extraction of facts.

Defined results: null content gives no facts; a file whose extraction fails gives a row with its error and no facts.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.config import Config
from stratagraph.extract.languages import EXTENSIONS, extract
from stratagraph.functions import classify as C
from stratagraph.ship import ship

FIELD = "array<struct<name: string, type_name: string>>"
METHOD = "array<struct<name: string, parameters: string, return_type: string>>"
FACTS = (
    f"repo string, path string, language string, sha256 string, error string, components array<struct<name: string, decl: string, line: bigint, col: bigint, fields: {FIELD}, methods: {METHOD}, implements: array<string>, made_type: string, made_package: string, note: string>>,"
    " dependencies array<struct<kind: string, path: string, line: bigint, col: bigint, source: string, target: string>>"
)


def language_of(path):
    extension = F.concat(F.lit("."), F.lower(F.substring_index(path, ".", -1)))
    out = F.lit(None).cast("string")
    for x, name in EXTENSIONS.items():
        out = F.when(extension == x, name).otherwise(out)
    return out


def is_source(path):
    return ~path.rlike(r"vendor/|/target/|_test\.go$|\.d\.ts$")


def scan(spark: SparkSession, root: str, repo: str = "repo", languages: tuple[str, ...] = (), under: str = "") -> DataFrame:
    """(repo, path, language, content) of a tree's source files, paths relative to the root; under: a module within it."""
    unknown = sorted(set(languages) - set(EXTENSIONS.values()))
    if unknown:
        warnings.warn(f"no extractor for: {', '.join(unknown)}", stacklevel=2)
    if languages and len(unknown) == len(set(languages)):
        raise ValueError("none of the languages has an extractor")
    wanted = [x for x, name in EXTENSIONS.items() if not languages or name in languages]
    raw = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*{" + ",".join(wanted) + "}")
    prefix = F.lit("file:" + root.rstrip("/") + "/" if root.startswith("/") else root.rstrip("/") + "/")
    full = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    rows = raw.select(F.lit(repo).alias("repo"), F.substring(full, F.length(prefix) + 1, F.lit(1 << 30)).alias("path"), F.col("value").alias("content"))
    out = rows.where(is_source(F.col("path"))).withColumn("language", language_of(F.col("path")))
    return out.where(F.col("path").startswith(under.rstrip("/") + "/")) if under else out


def detect_languages(files: DataFrame) -> list[str]:
    """Languages of all files, Go if there are none."""
    found = files.select(language_of(F.col("path")).alias("l")).where("l is not null").distinct().collect()
    return sorted(r[0] for r in found) or ["go"]


def listing(files: DataFrame) -> DataFrame:
    """(repo, path, depth, is_dir) of all files and the folders above them, in order of path."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.concat_ws("/", F.slice(parts, 1, k)).alias("path"), (k - 1).alias("depth"), (k < F.size(parts)).alias("is_dir")))
    return files.select("repo", F.explode(up).alias("x")).select("repo", "x.*").distinct().orderBy("repo", "path")


def facts(files: DataFrame) -> DataFrame:
    """FACTS, a row per file: the only step that runs Python, in Arrow batches."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                try:
                    c, d = extract(r.path, r.language, r.content)
                    error = None
                except Exception as e:  # noqa: BLE001 whatever a file does to its lexer, the others are read
                    c, d, error = [], [], f"{type(e).__name__}: {e}"
                named = [asdict(x) | {"fields": [dict(zip(("name", "type_name"), f)) for f in x.fields], "methods": [dict(zip(("name", "parameters", "return_type"), m)) for m in x.methods]} for x in c]
                out.append((r.repo, r.path, r.language, r.sha256, error, named, [asdict(x) for x in d]))
            yield pd.DataFrame(out, columns=["repo", "path", "language", "sha256", "error", "components", "dependencies"])

    return files.select("repo", "path", "language", "content", F.sha2(F.col("content").cast("binary"), 256).alias("sha256")).mapInPandas(run, FACTS)


def _folder(path):
    return F.regexp_replace(path, "/?[^/]*$", "")


def components(state: DataFrame, config: Config) -> DataFrame:
    """Components of extracted files, classified by the configuration as it is now."""
    rows = state.select("repo", "path", "language", F.posexplode("components").alias("k", "c")).select("repo", "path", "language", "k", "c.*")
    name, path = F.col("name"), F.col("path")
    kind = (
        F.when(F.col("decl") == "interface", "port")
        .when(F.col("language") == "go", C.go_kind(name, F.col("fields"), path, F.col("made_type"), F.col("made_package")))
        .when((F.col("language") == "rust") & (F.size("implements") > 0), "adapter")
        .when(F.col("language") == "rust", C.rust_kind(name, F.col("fields")))
        .otherwise(F.coalesce("note", C.class_kind(name, F.col("implements"))))
    )
    made = (F.col("language") == "go") & path.contains("infrastructure/") & F.col("made_type").isNotNull() & (F.col("kind") == "adapter")
    layered = rows.withColumn("layer", C.layer_of(path, config)).withColumn("kind", kind).withColumn("_made", made)
    upgraded = layered.withColumn("kind", F.when(F.col("decl") != "interface", C.upgraded_kind(F.col("kind"), F.col("layer"), name)).otherwise(F.col("kind")))
    package = _folder(path)
    entity = F.col("kind") == "entity"
    return upgraded.select(
        "repo", F.concat(package, F.lit("::"), name).alias("component_id"), package.alias("package"), "name", "kind", "layer", C.is_cross_cutting(path, config).alias("is_cross_cutting"), C.mode_of(path, config).alias("architecture_mode"),
        path.alias("file"), "line", "col", "fields", "methods", F.when(F.col("_made") & (F.col("made_package") != ""), F.array("made_type")).when(F.col("decl") == "interface", F.array().cast("array<string>")).otherwise(F.col("implements")).alias("implements"),
        F.when(F.col("_made"), F.when(F.col("made_package") != "", "high").otherwise("medium")).when(F.col("kind") == "adapter", "medium").alias("confidence"), F.when(F.col("_made") & (F.col("made_package") == ""), F.col("made_type")).alias("returns_concrete"),
        (entity & C.is_active_record(F.col("methods"))).alias("is_active_record"), (entity & (F.size("methods") == 0)).alias("is_anemic_domain_model"), _place(path).alias("seq"),
    )


def _place(path):
    """The order of facts: by path, then as they stand in the file."""
    return F.concat(path, F.lit("\u0000"), F.lpad(F.col("k").cast("string"), 10, "0"))


def dependencies(state: DataFrame, config: Config) -> DataFrame:
    """Dependencies of extracted files without the standard library's, with the layers of both ends."""
    rows = state.select("repo", F.col("path").alias("file"), "language", F.posexplode("dependencies").alias("k", "d")).select("repo", "file", "language", "k", "d.*")
    rows = rows.where(~((F.col("language") == "go") & (F.col("kind") == "import") & C.is_go_stdlib(F.col("path"))))
    target = F.col("path")
    return rows.select(
        "repo", F.concat(_folder(F.col("file")), F.lit("::"), F.col("source")).alias("from_id"), F.concat(target, F.lit("::"), F.col("target")).alias("to_id"), "kind", target.alias("import_path"), "file", "line", "col",
        C.layer_of(F.col("file"), config).alias("from_layer"), C.import_layer(target, config).alias("to_layer"), C.is_cross_cutting(F.col("file"), config).alias("from_cross_cutting"), C.is_cross_cutting_import(target, config).alias("to_cross_cutting"),
        C.mode_of(F.col("file"), config).alias("architecture_mode"), _place(F.col("file")).alias("seq"),
    )
