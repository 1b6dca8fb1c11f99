"""Stand-ins for architecture facts, made from star-schema tables so that both Spark and a SQL oracle can build them.

They exercise the operators; they say nothing about real code. The scalar columns come from one SQL text that both
engines run; Spark adds the nested columns. Every row of the tables is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.tables import parquet


def _pick(n: str, words: str) -> str:
    return f"CASE {n} " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(words.split())) + " END"


NOUNS = "Invoice User Order Ledger Mail Stock Cart Audit Tax Route Plan"


def _div(k: str, n: int) -> str:
    return f"CAST(floor(({k}) / {n}) AS BIGINT)"


def _package(p: str) -> str:
    """The path of package number p, below 75."""
    layer = f"({_div(p, 5)} % 5)"
    last = f"CASE WHEN {layer} = 2 THEN {_pick(f'({_div(p, 25)} % 3)', 'postgres order redis')} ELSE {_pick(f'({_div(p, 25)} % 3)', 'user order billing')} END"
    return f"('svc' || CAST(({p}) % 5 AS VARCHAR) || '/' || {_pick(layer, 'domain application infrastructure handler util')} || '/' || {last})"


def _layer(p: str) -> str:
    return f"CASE ({_div(p, 5)} % 5) WHEN 0 THEN 'domain' WHEN 1 THEN 'application' WHEN 2 THEN 'infrastructure' WHEN 3 THEN 'presentation' END"


def _mode(p: str) -> str:
    return f"CASE ({p}) % 5 WHEN 3 THEN 'active-record' WHEN 4 THEN 'service-oriented' ELSE 'ddd' END"


def _shared(p: str) -> str:
    return f"(({_div(p, 5)} % 5) = 4 AND ({_div(p, 25)} % 3) = 2)"


#: The 75 packages: number, path, layer, mode, whether shared.
PACKAGES = f"SELECT p, {_package('p')} AS package, {_layer('p')} AS layer, {_mode('p')} AS mode, {_shared('p')} AS shared FROM range(75) AS r(p)"

COMPONENTS = f"""
WITH pk AS ({PACKAGES}),
k AS (SELECT p_partkey AS k, p_partkey % 75 AS kp, {_div('p_partkey', 75)} AS q, p_size FROM part),
n AS (SELECT k, q, p_size, package, layer, mode AS architecture_mode, shared AS is_cross_cutting, {_pick('((q + kp) % 7)', 'Repository Service Handler UseCase Created Port Item')} AS suffix,
      {_pick('(k % 11)', NOUNS)} AS noun, CASE WHEN layer = 'infrastructure' THEN {_pick('(k % 4)', 'Mongo Stripe Sql Local')} ELSE '' END AS vendor FROM k JOIN pk ON pk.p = k.kp)
SELECT 'r' || CAST(q % 4 AS VARCHAR) AS repo, package || '::' || vendor || noun || suffix AS component_id, package, vendor || noun || suffix AS name,
       CASE suffix WHEN 'Repository' THEN 'repository' WHEN 'Service' THEN 'service' WHEN 'Handler' THEN 'adapter' WHEN 'UseCase' THEN 'use_case' WHEN 'Created' THEN 'domain_event' WHEN 'Port' THEN 'port'
            ELSE CASE WHEN p_size % 2 = 0 THEN 'entity' ELSE 'value_object' END END AS kind,
       layer, is_cross_cutting, architecture_mode, package || '/f' || CAST(k % 4 AS VARCHAR) || '.go' AS file, CAST(p_size AS BIGINT) AS line, CAST(1 AS BIGINT) AS col, CAST(k AS BIGINT) AS seq,
       (p_size % 2 = 0) AS has_id, CASE WHEN suffix = 'Item' THEN '[]' || {_pick('((k + p_size) % 11)', NOUNS)} || 'Item' END AS ref_type,
       CAST(p_size % 4 AS BIGINT) AS n_methods, CASE WHEN suffix = 'Handler' AND p_size % 5 = 0 THEN noun || 'Port' END AS implemented, CASE WHEN suffix = 'Handler' AND p_size % 5 = 1 THEN noun || 'Client' END AS returns_concrete
FROM n
"""

DEPENDENCIES = f"""
WITH pk AS ({PACKAGES}),
k AS (SELECT l_partkey % 75 AS kp, (7 * (l_partkey % 75) * (l_partkey % 75) + 11 * (l_suppkey % 3) + l_partkey % 75) % 75 AS kt, {_div('l_partkey', 75)} AS q, l_suppkey % 10 AS way, l_orderkey AS o, l_linenumber AS ln, (l_returnflag = 'R' AND l_linestatus = 'F') AS init FROM lineitem),
n AS (SELECT q, way, o, ln, init, a.package, a.layer AS from_layer, a.shared AS from_cross_cutting, a.mode AS architecture_mode, CASE WHEN way < 8 THEN b.layer END AS to_layer, (way < 8 AND b.shared) AS to_cross_cutting,
      CASE WHEN way = 8 THEN 'fmt' WHEN way = 9 THEN 'github.com/drivers/postgres' ELSE 'github.com/acme/' || b.package END AS import_path FROM k JOIN pk a ON a.p = k.kp JOIN pk b ON b.p = k.kt)
SELECT 'r' || CAST(q % 4 AS VARCHAR) AS repo, package || CASE WHEN init THEN '::<init>' ELSE '::<file>' END AS from_id, import_path || '::<package>' AS to_id, CASE WHEN init THEN 'method_call' ELSE 'import' END AS kind, import_path,
       package || '/f' || CAST(o % 4 AS VARCHAR) || '.go' AS file, CAST(ln AS BIGINT) AS line, CAST(1 AS BIGINT) AS col, from_layer, to_layer, from_cross_cutting, to_cross_cutting, architecture_mode, CAST(o * 16 + ln AS BIGINT) AS seq
FROM n
"""


def _sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    return spark.sql(text.replace("AS VARCHAR", "AS STRING").replace(*next((f" FROM {t}", f" FROM {{{t}}}") for t in tables)), **tables)


def components(spark: SparkSession, folder: str) -> DataFrame:
    flat = _sql(spark, COMPONENTS, part=parquet(spark, folder, "part"))
    field = lambda name, kind: F.struct(F.lit(name).alias("name"), kind.alias("type_name"))
    fields = F.filter(F.array(F.when(F.col("has_id"), field("ID", F.lit("string"))), F.when(F.col("ref_type").isNotNull(), field("ref", F.col("ref_type")))), lambda f: f.isNotNull())
    names = F.array(*[F.lit(x) for x in ("Create", "Save", "Describe")])
    methods = F.transform(F.slice(names, F.lit(1), F.col("n_methods").cast("int")), lambda n: F.struct(n.alias("name"), F.lit("").alias("parameters"), F.lit("").alias("return_type")))
    return flat.withColumns({"fields": fields, "methods": methods, "implements": F.filter(F.array("implemented"), lambda x: x.isNotNull())}).drop("has_id", "ref_type", "n_methods", "implemented")


def dependencies(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(spark, DEPENDENCIES, lineitem=parquet(spark, folder, "lineitem"))
