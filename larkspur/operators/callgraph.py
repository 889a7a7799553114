"""The call graph: callables, who calls whom, what a change reaches, how one gets from here to there.

Tables: exports (export_id, file_id, name, type), chunks (chunk_id, file_id, entity_name, chunk_type, start_line,
end_line, parent_id), refs (ref_id, chunk_id, file_id, name, line from 0, resolved_export_id). A node is a
string: e:<export_id>, or l:<file_id>:<name> for what a file keeps to itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..runtime import sent_if_small, stored
from . import graph as gr

# What counts as callable; a callable referred to more often than this is shown but not gone beyond.
CALLABLE, WALKED = ("function", "method"), ("function", "method", "class")
AMBIENT = 25


def export_key(export_id: Column) -> Column:
    return F.concat(F.lit("e:"), export_id.cast("string"))


def local_key(file_id: Column, name: Column) -> Column:
    return F.concat_ws(":", F.lit("l"), file_id.cast("string"), name)


def callable_exports(exports: DataFrame, chunks: DataFrame) -> DataFrame:
    """(export_id, file_id, name, start_line, end_line) of exported functions and methods; lines over all chunks of
    the name in the file, null if there are none."""
    lines = chunks.groupBy("file_id", F.col("entity_name").alias("name")).agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    return exports.where(F.col("type").isin(*CALLABLE)).select("export_id", "file_id", "name").join(lines, ["file_id", "name"], "left").select("export_id", "file_id", "name", "start_line", "end_line")


def local_callables(chunks: DataFrame, exports: DataFrame | None = None, kinds: tuple[str, ...] = WALKED) -> DataFrame:
    """(file_id, name, start_line, end_line) of named chunks of a callable kind; without those that the file exports,
    if ``exports`` are given."""
    named = chunks.where(F.col("chunk_type").isin(*kinds) & F.col("entity_name").isNotNull()).groupBy("file_id", F.col("entity_name").alias("name")).agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    return named if exports is None else named.join(exports.select("file_id", "name").distinct(), ["file_id", "name"], "left_anti")


def unique_by_suffix(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """(wanted, file_id, name): for each of ``names`` (wanted) the only callable called <something>.<wanted>; if there is
    none such, the only method called just so. Several candidates give no row. An equi-join on the name's ends."""
    held = local_callables(chunks.where("start_line is not null and end_line is not null"))
    parts = F.split("name", r"\.")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    dotted = held.where(F.instr("name", ".") > 0).select("file_id", "name", F.explode(ends).alias("wanted")).join(names.select("wanted").distinct(), "wanted")
    n = dotted.groupBy("wanted").agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("file_id"), F.min("name").alias("name"))
    methods = local_callables(chunks.where("start_line is not null and end_line is not null"), kinds=("method",)).withColumn("wanted", F.col("name"))
    rest = names.select("wanted").distinct().join(n.select("wanted"), "wanted", "left_anti")
    m = methods.join(rest, "wanted").groupBy("wanted").agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("file_id"), F.min("name").alias("name"))
    return n.unionByName(m).where("n = 1").select("wanted", "file_id", "name")


def callee_refs(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """(file_id, owner, ref_id, name, line, resolved_export_id): the references in each named entity's chunks and in
    the chunks these are the parents of. A union of two equi-joins in place of an OR; each reference once an
    owner."""
    own = chunks.select("chunk_id", "file_id", F.col("entity_name").alias("owner"))
    parent = chunks.select(F.col("chunk_id").alias("parent_id"), F.col("file_id").alias("_file"), F.col("entity_name").alias("owner"))
    inside = chunks.select("chunk_id", "file_id", "parent_id").join(parent, "parent_id").where("file_id = _file").select("chunk_id", "file_id", "owner")
    holds = own.unionByName(inside).where("owner is not null").distinct()
    return refs.select("chunk_id", "ref_id", "name", "line", "resolved_export_id").join(holds, "chunk_id").select("file_id", "owner", "ref_id", "name", "line", "resolved_export_id")


def callers(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(export_id, name, file_id, caller, line, start_line, end_line): who refers to an export, or, with export_id null,
    who refers in its own file to a name that is resolved to none. A caller is the entity whose chunk the reference
    stands in, else the parent's; references outside any drop out. line (from 1) is the first."""
    parent = chunks.select(F.col("chunk_id").alias("parent_id"), F.col("entity_name").alias("_name"), F.col("start_line").alias("_start"), F.col("end_line").alias("_end"))
    named = chunks.join(parent, "parent_id", "left").select("chunk_id", F.coalesce("entity_name", "_name").alias("caller"), F.coalesce("start_line", "_start").alias("start_line"), F.coalesce("end_line", "_end").alias("end_line"))
    name = F.when(F.col("resolved_export_id").isNull(), F.col("name"))
    j = refs.select("chunk_id", "file_id", "line", F.col("resolved_export_id").alias("export_id"), name.alias("name")).join(named.where("caller is not null"), "chunk_id")
    return j.groupBy("export_id", "name", "file_id", "caller").agg((F.min("line") + 1).alias("line"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))


def inbound_refs(refs: DataFrame, callables: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(export_id, inbound): references to each export but those of its own declaration (its name, in its file, on its
    first line, or anywhere in the file if that isn't known) and those in ``excluded`` files."""
    r = refs.where("resolved_export_id is not null")
    if excluded is not None:
        r = r.join(excluded.select("file_id").distinct(), "file_id", "left_anti")
    c = callables.select(F.col("export_id").alias("resolved_export_id"), F.col("file_id").alias("_file"), F.col("name").alias("_name"), F.col("start_line").alias("_start"))
    j = r.join(c, "resolved_export_id", "left")
    itself = (F.col("file_id") == F.col("_file")) & (F.col("name") == F.col("_name")) & (F.col("line") + 1 == F.coalesce(F.col("_start"), F.col("line") + 1))
    return j.where(~F.coalesce(itself, F.lit(False))).groupBy(F.col("resolved_export_id").alias("export_id")).agg(F.count(F.lit(1)).alias("inbound"))


def call_edges(exports: DataFrame, chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """(src, dst), distinct, caller to callee: what a callable's references resolve to, an exported callable or else one
    that the file keeps to itself. Calls of oneself, and what is neither, are left out. Store it for walks."""
    c = callable_exports(exports, chunks)
    by_name = c.groupBy("file_id", "name").agg(F.max("export_id").alias("export_id"))
    calls = callee_refs(chunks, refs)
    src = calls.join(by_name.withColumnRenamed("name", "owner").withColumnRenamed("export_id", "_own"), ["file_id", "owner"], "left")
    src = src.withColumn("src", F.coalesce(export_key(F.col("_own")), local_key(F.col("file_id"), F.col("owner"))))
    to = src.join(c.select(F.col("export_id").alias("resolved_export_id"), F.lit(True).alias("_is")), "resolved_export_id", "left")
    to = to.join(local_callables(chunks).select("file_id", "name", F.lit(True).alias("_here")), ["file_id", "name"], "left")
    dst = F.when(F.col("_is"), export_key(F.col("resolved_export_id"))).when(F.col("_here"), local_key(F.col("file_id"), F.col("name")))
    return to.select("src", dst.alias("dst")).where("dst is not null and src <> dst").distinct()


def direct_callees(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("src") == node).select(F.col("dst").alias("node")).distinct()


def graph_signature(exports: DataFrame, refs: DataFrame, files: DataFrame) -> str:
    """What changes whenever the call graph may have: counts and greatest ids; deletions change the counts."""
    one = lambda t, *a: t.agg(*a).first()
    e = one(exports, F.count(F.lit(1)), F.coalesce(F.max("export_id"), F.lit(0)))
    r = one(refs, F.count(F.lit(1)), F.coalesce(F.max("ref_id"), F.lit(0)))
    f = one(files, F.count(F.lit(1)), F.max("indexed_at") if "indexed_at" in files.columns else F.lit(None))
    return ":".join("" if x is None else str(x) for x in (*e, *r, *f))


class CallGraphCache:
    """The stored edges of the last signature: made again only when the tables changed."""

    def __init__(self):
        self.held: tuple[str, DataFrame] | None = None

    def edges(self, exports: DataFrame, chunks: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
        signature = graph_signature(exports, refs, files)
        if self.held is None or self.held[0] != signature:
            self.held = signature, stored(call_edges(exports, chunks, refs))
        return self.held[1]


def impact(edges: DataFrame, root: str, ambient: DataFrame, depth: int = 3, budget: int = 80, cap: int = 2000) -> tuple[DataFrame, dict]:
    """(tree, counts) of the callers of ``root``. ``ambient``: node, of nodes that are cited but not gone beyond.

    tree: depth, parent, node, seen (shown elsewhere already), ambient. Nodes are gone beyond breadth first, in
    order of parent and name, ``budget`` at most and no deeper than ``depth``. counts: shown (distinct callers in
    the tree, which may be the root itself in a cycle), total (all callers, direct or not, the root not counted,
    and no fewer than shown), capped (there are more than ``cap``, counted up to there), truncated. The tree is a
    display of bounded size and is put together on the driver, a level at a time; the count is a walk by joins
    that ends once the cap is passed."""
    spark, edges = edges.sparkSession, stored(edges)
    tree: list[tuple] = []
    visited, shown, spent, truncated = {root}, set(), 0, False
    level = [root]
    for d in range(depth + 1):
        if not level:
            break
        here = spark.createDataFrame([(n,) for n in level], "dst string")
        found = edges.join(F.broadcast(here), "dst")
        if d == depth:
            truncated |= not found.isEmpty()
            break
        # a level has at most ``budget`` nodes that are gone beyond, and each no more callers than it has
        rows = found.join(sent_if_small(ambient.select(F.col("node").alias("src"), F.lit(True).alias("ambient"))), "src", "left").select("dst", "src", F.coalesce("ambient", F.lit(False)).alias("ambient")).collect()
        place, after = {n: k for k, n in enumerate(level)}, []
        for r in sorted(rows, key=lambda r: (place[r.dst], r.src)):
            shown.add(r.src)
            seen = r.src in visited
            tree.append((d + 1, r.dst, r.src, seen, r.ambient and not seen))
            if seen:
                continue
            visited.add(r.src)
            if r.ambient or spent >= budget:
                truncated = True
                continue
            spent += 1
            after.append(r.src)
        level = after
    reached = gr.reach(gr.reversed_edges(edges), spark.createDataFrame([(root,)], "node string"), most=cap)
    total = reached.limit(cap + 1).count() - 1
    capped = total >= cap and reached.count() > cap + 1
    counts = {"shown": len(shown), "total": max(total, len(shown)), "capped": capped, "truncated": truncated}
    return spark.createDataFrame(tree, "depth int, parent string, node string, seen boolean, ambient boolean"), counts


def trace(edges: DataFrame, start: str, end: str, frontier: int = 8) -> dict:
    """How ``start`` comes to ``end``: found, nodes (DataFrame: node, from_start, to_end of all nodes on some path), spine
    (one shortest path), size; without a path ahead (the deepest nodes reached) and back (direct callers of
    ``end``), ``frontier`` at most of each. Both walks are without a limit, so no path is overlooked."""
    spark, edges = edges.sparkSession, stored(edges)
    seed = lambda n: spark.createDataFrame([(n,)], "node string")
    if start == end:
        return {"found": True, "nodes": seed(start).select("node", F.lit(0).alias("from_start"), F.lit(0).alias("to_end")), "spine": [start], "size": 1, "ahead": [], "back": []}
    ahead = gr.reach(edges, seed(start))
    back = gr.reach(gr.reversed_edges(edges), seed(end))
    nodes = stored(ahead.withColumnRenamed("depth", "from_start").join(back.withColumnRenamed("depth", "to_end"), "node"))
    size = nodes.count()
    if not size:
        deepest = ahead.agg(F.max("depth")).first()[0]
        far = [r.node for r in ahead.where((F.col("depth") == deepest) & (F.col("depth") > 0)).orderBy("node").limit(frontier).collect()]
        near = [r.src for r in edges.where(F.col("dst") == end).select("src").distinct().orderBy("src").limit(frontier).collect()]
        return {"found": False, "nodes": nodes, "spine": [], "size": 0, "ahead": far, "back": near}
    return {"found": True, "nodes": nodes, "spine": [r.node for r in gr.spine(edges, nodes).orderBy("step").collect()], "size": size, "ahead": [], "back": []}


def drawn(edges: DataFrame, traced: dict, budget: int = 300) -> list[tuple[int, str, bool]]:
    """(depth, node, seen) of a tree that shows the nodes between start and end, depth first. The spine is always
    there; others fill ``budget``. A display: its edges are collected up to a bound that the budget sets."""
    if not traced["found"] or len(traced["spine"]) < 2:
        return [(0, n, False) for n in traced["spine"]]
    spine, start, end = set(traced["spine"]), traced["spine"][0], traced["spine"][-1]
    on = traced["nodes"].select("node")
    shown = [r.node for r in traced["nodes"].orderBy(F.col("from_start") + F.col("to_end"), "from_start", "node").limit(budget + len(spine)).collect()]
    kept = edges.sparkSession.createDataFrame([(n,) for n in {*shown, *spine}], "node string")
    inner = edges.join(on.withColumnRenamed("node", "src"), "src", "left_semi").join(F.broadcast(kept.withColumnRenamed("node", "src")), "src", "left_semi").join(F.broadcast(kept.withColumnRenamed("node", "dst")), "dst", "left_semi")
    after: dict[str, list[str]] = {}
    for r in inner.select("src", "dst").distinct().orderBy("src", "dst").collect():
        after.setdefault(r.src, []).append(r.dst)
    out, placed, spent = [], set(), 0
    stack = [(0, start)]
    while stack:
        depth, node = stack.pop()
        out.append((depth, node, node in placed))
        if node in placed or node == end:
            placed.add(node)
            continue
        placed.add(node)
        children = []
        for c in after.get(node, []):
            if c in spine or spent < budget:
                spent += 1
                children.append((depth + 1, c))
        stack += reversed(children)
    return out


def resolve_symbol(exports: DataFrame, chunks: DataFrame, files: DataFrame, name: str, file: str | None = None, most: int = 50) -> tuple[str, list[tuple[str, str]]]:
    """(ok | not_found | ambiguous, [(node, path)]) of the callables of a name; ``file`` narrows by a path or its end on a
    folder's boundary. An export goes before a local of its name and file. A bounded listing for the user."""
    e = callable_exports(exports, chunks).where(F.col("name") == name).groupBy("file_id").agg(F.max("export_id").alias("export_id")).select("file_id", export_key(F.col("export_id")).alias("node"))
    l = local_callables(chunks, exports, CALLABLE).where(F.col("name") == name).select("file_id", local_key(F.col("file_id"), F.col("name")).alias("node"))
    c = e.unionByName(l).join(files.select("file_id", "path"), "file_id")
    if file:
        c = c.where(tx.suffix_path(tx.normalize_path("path"), file.replace("\\", "/").removeprefix("./")))
    found = [(r.node, r.path) for r in c.orderBy("path", "node").limit(most).collect()]
    return ("not_found" if not found else "ok" if len(found) == 1 else "ambiguous"), found
