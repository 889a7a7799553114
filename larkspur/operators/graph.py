"""Graph walks over edge tables by frontier joins.

Edges are stored once before a walk, so that no hop makes them again. Each hop joins the frontier with the edges
and drops what was visited; only how large a frontier is comes to the driver. Frontiers are stored in the shared
folder, which cuts lineage and outlives lost executors; what was visited is their union, never rewritten but
for a merge of many small ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import sent_if_small, stored

#: Frontiers that are merged into one table.
MERGE = 16


def reach(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None, source: str = "src", target: str = "dst", most: int | None = None) -> DataFrame:
    """(node, depth) of everything reachable from ``seeds`` (node) along source -> target, seeds included at 0.
    With ``most`` the walk ends once it has seen more nodes than that besides the seeds."""
    return _walk(stored(_steps(edges, source, target)), seeds, max_hops, most)


def _steps(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    return edges.select(F.col(source).alias("node"), F.col(target).alias("next")).where("node is not null and next is not null and node <> next")


def _walk(e: DataFrame, seeds: DataFrame, max_hops: int | None = None, most: int | None = None) -> DataFrame:
    """``reach`` over stored steps (node, next). Steps may repeat: what they lead to is made distinct at each hop."""
    front = stored(seeds.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    seen, parts, hop, met = front, 1, 0, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        new = e.join(sent_if_small(front.select("node")), "node", "left_semi").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = stored(new.withColumn("depth", F.lit(hop)))
        n = front.count()
        if not n:
            break
        seen, parts, met = seen.unionByName(front), parts + 1, met + n
        if parts > MERGE:
            seen, parts = stored(seen.coalesce(max(1, e.rdd.getNumPartitions()))), 1
        if most is not None and met > most:
            break
    return seen


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def subgraph(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Edges among the nodes within ``hops`` of ``seeds``, whichever way edges point."""
    e = stored(edges)
    near = stored(_walk(_steps(e).unionByName(_steps(e, "dst", "src")), seeds, hops).select("node"))
    src, dst = (sent_if_small(near.withColumnRenamed("node", c)) for c in ("src", "dst"))
    return e.join(src, "src", "left_semi").join(dst, "dst", "left_semi").select("src", "dst")


def fan(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out)."""
    i = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("fan_in"))
    o = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("fan_out"))
    return i.join(o, "node", "full_outer").select("node", F.coalesce("fan_in", F.lit(0)).cast("long").alias("fan_in"), F.coalesce("fan_out", F.lit(0)).cast("long").alias("fan_out"))


def impact(edges: DataFrame, target: DataFrame, depth: int = 3, ambient: int = 25) -> tuple[DataFrame, DataFrame]:
    """(shown, total) of callers. Edges run caller -> callee.

    shown: node, parent, depth of a walk against the edges from ``target`` (node), ``depth`` hops, self-calls
    left out; a node with more than ``ambient`` callers is cited (ambient) and not gone beyond. total: one row,
    callers: all direct and indirect callers, the target not counted."""
    edges = stored(edges)
    calls = edges.where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("caller"))
    wide = lambda nodes: calls.join(sent_if_small(nodes.select("node")), "node", "left_semi").distinct().groupBy("node").agg((F.count(F.lit(1)) > ambient).alias("ambient"))
    rows = stored(target.select("node", F.lit(None).cast(target.schema["node"].dataType).alias("parent"), F.lit(0).alias("depth")))
    front = rows
    for hop in range(1, depth + 1):
        open_ = front.join(wide(front).where("ambient"), "node", "left_anti") if hop > 1 else front
        new = calls.join(open_.select("node"), "node").select(F.col("caller").alias("n"), F.col("node").alias("parent"))
        new = new.groupBy("n").agg(F.min("parent").alias("parent")).withColumnRenamed("n", "node").join(rows.select("node"), "node", "left_anti")
        front = stored(new.withColumn("depth", F.lit(hop)))
        if front.isEmpty():
            break
        rows = rows.unionByName(front)
    total = _walk(_steps(edges, "dst", "src"), target).agg((F.count(F.lit(1)) - 1).alias("callers"))
    return rows.join(wide(rows), "node", "left").withColumn("ambient", F.coalesce("ambient", F.lit(False))), total


def trace(edges: DataFrame, start: DataFrame, end: DataFrame) -> DataFrame:
    """(node, from_start, to_end): nodes on some path from ``start`` to ``end``, with their distances. Nodes whose
    distances add up to the least are on a shortest path."""
    e = stored(edges)
    ahead = _walk(_steps(e), start).withColumnRenamed("depth", "from_start")
    back = _walk(_steps(e, "dst", "src"), end).withColumnRenamed("depth", "to_end")
    return ahead.join(back, "node")


def spine(edges: DataFrame, traced: DataFrame) -> DataFrame:
    """(step, node): one shortest path, at each step the least node that follows the one before."""
    edges, traced = stored(edges), stored(traced)
    best = traced.agg(F.min(F.col("from_start") + F.col("to_end")).alias("n"))
    on = stored(traced.join(F.broadcast(best), F.col("from_start") + F.col("to_end") == F.col("n")).select("node", "from_start", "n"))
    row = on.agg(F.max("n").alias("n")).first()
    out = on.where("from_start = 0").agg(F.min("node").alias("node")).select(F.lit(0).alias("step"), "node")
    here = out
    for k in range(1, (row.n or 0) + 1):  # as many hops as the path is long
        here = edges.join(here.select(F.col("node").alias("src")), "src").join(on.where(F.col("from_start") == k).select(F.col("node").alias("dst")), "dst").agg(F.min("dst").alias("node")).select(F.lit(k).alias("step"), "node")
        here = stored(here)
        out = out.unionByName(here)
    return out.where("node is not null")


def tests_reaching(importers: DataFrame, is_test: DataFrame, naming: DataFrame) -> DataFrame:
    """(node, kind): tests in the closure of importers and tests that name the symbol; precise if they name it, else
    broad."""
    broad = importers.join(is_test, "node", "left_semi").select("node").distinct().withColumn("p", F.lit(False))
    precise = naming.join(is_test, "node", "left_semi").select("node").distinct().withColumn("p", F.lit(True))
    return broad.unionByName(precise).groupBy("node").agg(F.bool_or("p").alias("p")).select("node", F.when(F.col("p"), "precise").otherwise("broad").alias("kind"))


def affected_tests(changed: DataFrame, files: DataFrame, edges: DataFrame, is_test) -> DataFrame:
    """(path, kind) of a change: changed and unknown (``changed``: path, in ``files`` or not) and the tests that import a
    changed file, directly or not. files: file_id, path; edges: src imports dst; is_test: a condition on path."""
    known = files.join(changed.select("path").distinct(), "path", "left_semi")
    near = reach(reversed_edges(edges), known.select(F.col("file_id").alias("node")))
    tests = files.join(near.select(F.col("node").alias("file_id")), "file_id", "left_semi").where(is_test)
    unknown = changed.select("path").distinct().join(files.select("path"), "path", "left_anti")
    kinds = ((known, "changed"), (unknown, "unknown"), (tests, "test"))
    first, *rest = [t.select("path", F.lit(kind).alias("kind")) for t, kind in kinds]
    for t in rest:
        first = first.unionByName(t)
    return first


def file_graph(files: DataFrame, imports: DataFrame, exports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes file_id, path and exports (name, type; by name), edges from_id, to_id, source: a row for
    each import that is resolved."""
    listed = exports.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("name", "type"))).alias("exports"))
    nodes = files.select("file_id", "path").join(listed, "file_id", "left").withColumn("exports", F.coalesce("exports", F.array().cast("array<struct<name:string,type:string>>")))
    edges = imports.where("resolved_file_id is not null").join(files.select("file_id"), "file_id", "left_semi").join(files.select(F.col("file_id").alias("resolved_file_id")), "resolved_file_id", "left_semi")
    return nodes, edges.select(F.col("file_id").alias("from_id"), F.col("resolved_file_id").alias("to_id"), "source")


def depends_on(imports: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file_id, path, source): what each of ``wanted`` (file_id) imports, a row an import."""
    mine = imports.where("resolved_file_id is not null").join(wanted.select("file_id").distinct(), "file_id", "left_semi")
    return mine.join(files.select(F.col("file_id").alias("resolved_file_id"), "path"), "resolved_file_id").select("file_id", "path", "source")


def dependents(imports: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file_id, path, source): who imports each of ``wanted`` (file_id), a row an import."""
    theirs = imports.join(wanted.select(F.col("file_id").alias("resolved_file_id")).distinct(), "resolved_file_id", "left_semi")
    return theirs.join(files.select("file_id", "path"), "file_id").select(F.col("resolved_file_id").alias("file_id"), "path", "source")


def project_map(files: DataFrame, edges: DataFrame, exports: DataFrame, most: int = 8) -> DataFrame:
    """A row a file (file_id, path): its directory, first ``most`` exports by name, how many more there are, fan-in and
    fan-out, and whether nothing imports it. edges: src imports dst."""
    from ..functions import text as tx

    listed = exports.select("file_id", "name").distinct().groupBy("file_id").agg(F.sort_array(F.collect_list("name")).alias("names"))
    f = files.select("file_id", "path").join(listed, "file_id", "left").join(fan(edges).withColumnRenamed("node", "file_id"), "file_id", "left")
    names, zero = F.coalesce("names", F.array().cast("array<string>")), F.lit(0).cast("long")
    return f.select("file_id", "path", tx.dirname("path").alias("dir"), F.slice(names, 1, most).alias("exports"), F.greatest(F.size(names) - most, F.lit(0)).alias("more"), F.coalesce("fan_in", zero).alias("fan_in"), F.coalesce("fan_out", zero).alias("fan_out"), (F.coalesce("fan_in", zero) == 0).alias("entry"))


def project_constants(exports: DataFrame, chunks: DataFrame, types: tuple[str, ...] = ("constant", "variable")) -> DataFrame:
    """(file_id, name, snippet, exported): exported constants, each with its chunk's text (found by name without regard
    to case; the least chunk), then constants a file keeps to itself, unless it exports their name."""
    text = chunks.where("entity_name is not null").groupBy("file_id", F.lower("entity_name").alias("_key")).agg(F.min_by("snippet", "chunk_id").alias("snippet"))
    mine = exports.where(F.col("type").isin(*types)).select("file_id", "name").distinct().withColumn("_key", F.lower("name")).join(text, ["file_id", "_key"], "left").select("file_id", "name", "snippet", F.lit(True).alias("exported"))
    local = chunks.where(F.col("chunk_type").isin(*types) & F.col("entity_name").isNotNull()).groupBy("file_id", F.col("entity_name").alias("name")).agg(F.min_by("snippet", "chunk_id").alias("snippet"))
    rest = local.join(mine.select("file_id", "name"), ["file_id", "name"], "left_anti")
    return mine.unionByName(rest.select("file_id", "name", "snippet", F.lit(False).alias("exported")))


def symbol_graph(exports: DataFrame, refs: DataFrame) -> DataFrame:
    """(from_file, export_id, refs): how often each file refers to each export of other files."""
    e = exports.select(F.col("export_id").alias("resolved_export_id"), F.col("file_id").alias("_home"))
    j = refs.where("resolved_export_id is not null").join(e, "resolved_export_id").where("file_id <> _home")
    return j.groupBy(F.col("file_id").alias("from_file"), F.col("resolved_export_id").alias("export_id")).agg(F.count(F.lit(1)).alias("refs"))


def directory_rollup(files: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(directories, links): files (node, dir) and edges rolled up by directory: files, fan-in and fan-out as
    distinct other directories; links between directories with their number of edges."""
    s, d = files.select(F.col("node").alias("src"), F.col("dir").alias("from_dir")), files.select(F.col("node").alias("dst"), F.col("dir").alias("to_dir"))
    between = edges.join(s, "src").join(d, "dst").where("from_dir <> to_dir").groupBy("from_dir", "to_dir").agg(F.count(F.lit(1)).alias("edges"))
    size = files.groupBy("dir").agg(F.count(F.lit(1)).alias("files"))
    out = between.groupBy(F.col("from_dir").alias("dir")).agg(F.count(F.lit(1)).alias("fan_out"))
    into = between.groupBy(F.col("to_dir").alias("dir")).agg(F.count(F.lit(1)).alias("fan_in"))
    rolled = size.join(into, "dir", "left").join(out, "dir", "left")
    return rolled.select("dir", "files", F.coalesce("fan_in", F.lit(0)).cast("long").alias("fan_in"), F.coalesce("fan_out", F.lit(0)).cast("long").alias("fan_out")), between
