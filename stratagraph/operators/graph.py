"""The dependency graph as two tables: nodes (first mention wins) and edges with both their ends' columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.functions import classify as C
from stratagraph.ship import ship
from stratagraph.tables import kept

NODE = ["repo", "node_id", "name", "kind", "layer", "is_cross_cutting", "architecture_mode", "file", "line", "col"]


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in the order given; one shuffle on the keys, with partial aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    low = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return low.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def counted(dependencies: DataFrame) -> DataFrame:
    """Equal dependencies as one row, with their number n and the lowest seq: one hash aggregate before the shuffle. Nodes, edges and rules made of these rows mean the same, and their work follows the number of distinct dependencies."""
    return dependencies.groupBy(*[c for c in dependencies.columns if c != "seq"]).agg(F.min("seq").alias("seq"), F.count("*").alias("n"))


def number(rows: DataFrame, where: Column | None = None) -> Column:
    """The aggregate that counts rows, or what rows with a column n stand for."""
    if "n" not in rows.columns:
        return F.count(F.lit(1)) if where is None else F.count_if(where)
    return F.sum("n" if where is None else F.when(where, F.col("n")).otherwise(0))


def build_nodes(components: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Components, then both ends of dependencies; the first mention of an id gives its columns. kind is null for ends that are no components.

    Dependencies are scanned once. Equal mentions are first counted off by a hash aggregate that keeps the earliest, so
    that what is shuffled and compared follows the number of distinct mentions, not of dependencies. seq, a number or a
    text, is the order of mentions.
    """

    def at(rows: DataFrame, e: int):
        return F.concat("seq", F.lit(str(e))) if dict(rows.dtypes)["seq"] == "string" else F.col("seq").cast("long") * 2 + e

    own = components.select("repo", F.col("component_id").alias("node_id"), "name", "kind", "layer", "is_cross_cutting", "architecture_mode", "file", "line", "col", F.lit(0).alias("_p"), at(components, 0).alias("_s"))

    def end(which: str, e: int):
        return F.struct(
            F.col(f"{which}_id").alias("node_id"), F.col(f"{which}_id").alias("name"), F.lit(None).cast("string").alias("kind"), F.col(f"{which}_layer").alias("layer"),
            F.col(f"{which}_cross_cutting").alias("is_cross_cutting"), F.col("architecture_mode").alias("architecture_mode"), "file", "line", "col", F.lit(1).alias("_p"), at(dependencies, e).alias("_s"),
        )

    ends = dependencies.select("repo", F.explode(F.array(end("from", 0), end("to", 1))).alias("x")).select("repo", "x.*")
    mentions = own.unionByName(ends).groupBy(*NODE, "_p").agg(F.min("_s").alias("_s"))
    return first_wins(mentions, ["repo", "node_id"], ["_p", "_s"]).select(*NODE)


def substrings(rows: DataFrame, text: str, key: str, lengths: list[int]) -> DataFrame:
    """rows with a row for each substring of a text that has one of the lengths given: keys by which containment becomes an equi-join. A length at a time, so that a long text makes many rows, never a large one."""
    n, size = F.length(text), F.col("_length")
    each = rows.withColumn("_length", F.explode(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"))).where(size <= n)
    return each.withColumn(key, F.explode(F.transform(F.sequence(F.lit(1), n - size + 1), lambda k: F.substring(F.col(text), k, size)))).drop("_length")


def lengths_of(rows: DataFrame, text: str) -> list[int]:
    """The lengths that a column's texts have; few, whatever the number of rows."""
    return sorted(r[0] for r in rows.select(F.length(text).alias("n")).where("n > 0").distinct().collect())


def with_external(nodes: DataFrame, components: DataFrame, project_root: str | None = None, mode: str = "cli") -> DataFrame:
    """Adds is_external. mode "cli": ends that match no source folder: none is a suffix of their path, and no two neighbouring segments of one are in it; both are equi-joins on pieces of the distinct paths that have lengths of folders, or of neighbouring segments to either side of a slash; mode "pipeline": no end is external, but every one is cross-cutting."""
    synthetic = F.col("kind").isNull()
    if mode == "pipeline":
        return nodes.withColumn("is_external", F.lit(False)).withColumn("is_cross_cutting", F.col("is_cross_cutting") | synthetic)
    dirs = components.select("repo", F.regexp_replace("file", "/?[^/]*$", "").alias("dir")).where("dir <> ''").distinct()
    path = C.package_of(F.translate("node_id", "\\", "/"))
    ends = nodes.where(synthetic).select("repo", "node_id", path.alias("path"))
    own = ends.where(F.col("path").startswith(".") | F.col("path").startswith("crate") | (F.col("path").startswith(project_root) if project_root else F.lit(False)))
    distinct = ends.select("repo", "path").distinct()
    sizes = F.array(*[F.lit(x) for x in lengths_of(dirs, "dir")]).cast("array<int>")
    n = F.length("path")
    by_suffix = distinct.withColumn("dir", F.explode(F.transform(F.filter(sizes, lambda k: k <= n), lambda k: F.substring(F.col("path"), n - k + 1, k)))).join(dirs, ["repo", "dir"], "left_semi")
    parts = F.split("dir", "/")
    pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat_ws("/", F.slice(parts, k, 2)))
    dir_pairs = dirs.where(F.size(parts) > 1).select("repo", F.explode(pairs).alias("pair")).distinct()
    halves = dir_pairs.select(F.length(F.substring_index("pair", "/", 1)).alias("x"), F.length(F.substring_index("pair", "/", -1)).alias("y")).distinct().collect()
    sides = F.array(*[F.struct(F.lit(r.x).alias("x"), F.lit(r.y).alias("y")) for r in halves]).cast("array<struct<x: int, y: int>>")
    # a pair is inside a path if it ends the segment before a slash and begins the one after it
    around = distinct.withColumn("p", F.split(F.translate("path", ".", "/"), "/")).where(F.size("p") > 1).select("repo", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.slice(F.col("p"), k, 2))).alias("w"))
    left, right = F.col("w")[0], F.col("w")[1]
    fits = F.filter(sides, lambda s: (s["x"] <= F.length(left)) & (s["y"] <= F.length(right)))
    inner = around.select("repo", "path", F.explode(F.transform(fits, lambda s: F.concat(F.substring(left, F.length(left) - s["x"] + 1, s["x"]), F.lit("/"), F.substring(right, F.lit(1), s["y"])))).alias("pair"))
    by_pair = inner.join(dir_pairs, ["repo", "pair"], "left_semi")
    inside = by_suffix.select("repo", "path").union(by_pair.select("repo", "path")).distinct()
    known = ends.join(inside, ["repo", "path"], "left_semi").select("repo", "node_id").union(own.select("repo", "node_id")).distinct().withColumn("_in", F.lit(True))
    return nodes.join(known, ["repo", "node_id"], "left").withColumn("is_external", synthetic & F.col("_in").isNull()).drop("_in")


def build_edges(dependencies: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every dependency with its ends' columns as src_* and tgt_*; parallel edges stay, as rows or as the n of counted() ones."""
    cols = ["name", "kind", "layer", "is_cross_cutting", "architecture_mode", "is_external"]

    def end(prefix: str, key: str) -> DataFrame:
        return nodes.select("repo", F.col("node_id").alias(key), *[F.col(c).alias(f"{prefix}_{c}") for c in cols])

    base = dependencies.select("repo", "from_id", "to_id", F.col("kind").alias("dep_kind"), "import_path", "file", "line", "col", "seq", *[c for c in dependencies.columns if c == "n"])
    return base.join(end("src", "from_id"), ["repo", "from_id"]).join(end("tgt", "to_id"), ["repo", "to_id"])


def import_targets(dependencies: DataFrame, packages: DataFrame) -> DataFrame:
    """(repo, package, to_package): the package, the first by name, that each import of a known package means. Last segments must be equal, and the ones before them where both have one: three equi-joins. packages: (repo, package)."""
    keys = packages.select("repo", F.col("package").alias("to_package"), C.last_segment(F.col("package")).alias("k1"), C.segment_before_last(F.col("package")).alias("k2")).where("k1 <> ''")
    dep = dependencies.where("import_path is not null").select("repo", C.package_of(F.col("from_id")).alias("package"), C.last_segment(F.col("import_path")).alias("k1"), C.segment_before_last(F.col("import_path")).alias("k2")).distinct()
    known = dep.join(packages.select("repo", "package"), ["repo", "package"], "left_semi")
    full = known.join(keys, ["repo", "k1", "k2"]).select("repo", "package", "k1", "k2", "to_package")
    short_import = known.where("k2 is null").join(keys.drop("k2"), ["repo", "k1"]).select("repo", "package", "k1", F.lit(None).cast("string").alias("k2"), "to_package")
    short_package = known.where("k2 is not null").join(keys.where("k2 is null").drop("k2"), ["repo", "k1"]).select("repo", "package", "k1", "k2", "to_package")
    return full.union(short_import).union(short_package).groupBy("repo", "package", "k1", "k2").agg(F.min("to_package").alias("to_package")).select("repo", "package", "to_package")


def package_edges(dependencies: DataFrame, components: DataFrame) -> DataFrame:
    """(repo, a, b): packages of one repo of which one imports the other."""
    found = import_targets(dependencies, components.select("repo", "package").distinct())
    return found.where("package <> to_package").select("repo", F.col("package").alias("a"), F.col("to_package").alias("b")).distinct()


def _components_in_memory(nodes: list[str], edges: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected components of more than one node, by one depth-first search (Tarjan)."""
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    stack, on, out = [], set(), []
    for start in nodes:
        if start in number:
            continue
        work = [(start, iter(edges.get(start, ())))]
        number[start] = low[start] = len(number)
        stack.append(start)
        on.add(start)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in number:
                    number[w] = low[w] = len(number)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(edges.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], number[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    at = len(stack) - 1
                    while stack[at] != v:
                        at -= 1
                    found = stack[at:]
                    del stack[at:]
                    on.difference_update(found)
                    if len(found) > 1:
                        out.append(sorted(found))
    return out


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The lowest label that reaches each node along the edges; a round is one join and a checkpoint, and there are as many as the longest way a label takes. labels: (repo, n, l)."""
    while True:
        came = edges.join(labels.select("repo", F.col("n").alias("a"), F.col("l").alias("m")), ["repo", "a"]).groupBy("repo", F.col("b").alias("n")).agg(F.min("m").alias("m"))
        new = kept(labels.join(came, ["repo", "n"], "left").select("repo", "n", F.least("l", F.coalesce("m", "l")).alias("l"), F.col("l").alias("was")))
        labels = new.select("repo", "n", "l")
        if new.where("l <> was").isEmpty():
            return labels


def _coloured(core: DataFrame) -> DataFrame:
    """(repo, n, component) by forward and backward colouring: a node's colour is the lowest node that reaches it; of one colour, the nodes that reach that lowest one are its component. They are taken off, and so on with the rest. A round handles each edge once; no pairs of nodes are made."""
    found, edges = None, core
    while not edges.isEmpty():
        nodes = edges.select("repo", F.col("a").alias("n")).union(edges.select("repo", F.col("b").alias("n"))).distinct()
        colour = _spread(nodes.withColumn("l", F.col("n")), edges)
        of = lambda c: colour.select("repo", F.col("n").alias(c), F.col("l").alias(f"l{c}"))
        inside = edges.join(of("a"), ["repo", "a"]).join(of("b"), ["repo", "b"]).where("la = lb")
        back = inside.select("repo", F.col("b").alias("a"), F.col("a").alias("b"))
        reach = _spread(colour.select("repo", "n", F.when(F.col("n") == F.col("l"), F.lit(0)).otherwise(1).alias("l")), back).where("l = 0").select("repo", "n")
        done = kept(colour.join(reach, ["repo", "n"]).select("repo", "n", F.col("l").alias("component")))
        found = done if found is None else found.union(done)
        gone = done.select("repo", "n")
        edges = kept(edges.join(gone.withColumnRenamed("n", "a"), ["repo", "a"], "left_anti").join(gone.withColumnRenamed("n", "b"), ["repo", "b"], "left_anti").select("repo", "a", "b"))
    return found


def strongly_connected(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(repo, component, members) for strongly connected components of more than one node; component is the lowest member. Repositories of up to most distinct edges are searched in memory, one a task; larger ones by colouring over the cluster."""
    core = kept(edges.where("a <> b").select("repo", "a", "b").distinct())
    # an edge of a cycle begins at a node that has a way in, and ends at one that has a way out
    core = kept(core.join(core.select("repo", F.col("b").alias("a")).distinct(), ["repo", "a"], "left_semi").join(core.select("repo", F.col("a").alias("b")).distinct(), ["repo", "b"], "left_semi").select("repo", "a", "b"))
    large = core.groupBy("repo").agg(F.count("*").alias("n")).where(F.col("n") > most).select("repo")
    ship(core.sparkSession)

    def search(table: pa.Table) -> pa.Table:
        out: dict[str, list[str]] = {}
        for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist()):
            out.setdefault(a, []).append(b)
        members = _components_in_memory(list(out), out)
        repo = table.column("repo")[0].as_py()
        return pa.table({"repo": pa.array([repo] * len(members), pa.string()), "component": pa.array([m[0] for m in members], pa.string()), "members": pa.array(members, pa.list_(pa.string()))})

    schema = "repo string, component string, members array<string>"
    if large.isEmpty():
        return core.groupBy("repo").applyInArrow(search, schema)
    small = core.join(large, "repo", "left_anti").groupBy("repo").applyInArrow(search, schema)
    found = _coloured(core.join(large, "repo", "left_semi"))
    return small.union(found.groupBy("repo", "component").agg(F.array_sort(F.collect_list("n")).alias("members")).where(F.size("members") > 1))


def depth_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, max_depth, average_depth, node_count, edge_count): the depth is 1 where there is any edge, else 0."""
    n = nodes.groupBy("repo").agg(F.count("*").alias("node_count"))
    e = edges.groupBy("repo").agg(number(edges).alias("edge_count"))
    both = n.join(e, "repo", "left").withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))
    deep = F.when(F.col("edge_count") > 0, 1).otherwise(0).cast("long")
    return both.select("repo", deep.alias("max_depth"), (deep / F.col("node_count")).alias("average_depth"), "node_count", "edge_count")
