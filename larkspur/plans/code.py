"""Queries on graphs, symbols, chunks and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chunking as ck
from ..operators import graph as gr
from ..operators import symbols as sy
from ..runtime import dealt, stored
from ..sources import store
from .registry import EDGES, LINES, edges, lines, query, table

RF = "r AS (SELECT 1::BIGINT AS node UNION SELECT dst FROM r JOIN edges ON src = node)"
# Pages link to words; a word is the page whose number its length and first letter give, so links make a graph.
PAGE_LINKS = "links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages)"


def seed(spark: SparkSession, node: int) -> DataFrame:
    return spark.range(node, node + 1).select(F.col("id").alias("node"))


@query(f"WITH {EDGES} SELECT coalesce(src, dst) AS node, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM (SELECT src, count(*) AS fan_out FROM edges GROUP BY 1) o FULL JOIN (SELECT dst, count(*) AS fan_in FROM edges GROUP BY 1) i ON src = dst")
def fan_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.fan(edges(spark, sf_dir))


@query(f"WITH RECURSIVE {EDGES}, {RF} SELECT node FROM r")
def reachable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.reach(edges(spark, sf_dir), seed(spark, 1)).select("node")


def _hops(n: int, source: str = "src", target: str = "dst") -> str:
    steps = [f"h{k} AS (SELECT {target} AS node, {k} AS depth FROM edges JOIN h{k - 1} ON {source} = node)" for k in range(1, n + 1)]
    return ", ".join(["h0 AS (SELECT 1::BIGINT AS node, 0 AS depth)", *steps])


@query(f"WITH {EDGES}, {_hops(2)} SELECT node, min(depth)::INTEGER AS depth FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1")
def two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.reach(edges(spark, sf_dir), seed(spark, 1), 2)


@query(f"""WITH {EDGES}, b AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), n AS (SELECT 1::BIGINT AS node UNION SELECT dst FROM b WHERE src = 1)
SELECT src, dst FROM edges WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)""")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.subgraph(edges(spark, sf_dir), seed(spark, 1), 1)


@query(f"WITH RECURSIVE {EDGES}, r AS (SELECT 2::BIGINT AS node UNION SELECT src FROM r JOIN edges ON dst = node WHERE src <> dst) SELECT count(*) - 1 AS callers FROM r")
def impact_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.impact(edges(spark, sf_dir), seed(spark, 2), depth=1)[1]


@query(f"""WITH {EDGES}, c AS (SELECT dst AS node, src AS caller FROM edges WHERE src <> dst), w AS (SELECT node, count(*) AS n FROM c GROUP BY 1),
a AS (SELECT caller AS node, min(node) AS parent, 1 AS depth FROM c WHERE node = 2 GROUP BY 1),
b AS (SELECT c.caller AS node, min(c.node) AS parent, 2 AS depth FROM c JOIN a ON c.node = a.node LEFT JOIN w ON w.node = a.node WHERE coalesce(w.n, 0) <= 20 AND c.caller <> 2 AND c.caller NOT IN (SELECT node FROM a) GROUP BY 1),
t AS (SELECT 2 AS node, NULL::BIGINT AS parent, 0 AS depth UNION ALL SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT t.node::BIGINT AS node, coalesce(parent, -1) AS parent, depth::INTEGER AS depth, coalesce(w.n > 20, false) AS ambient FROM t LEFT JOIN w USING (node)""")
def impact_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.impact(edges(spark, sf_dir), seed(spark, 2), depth=2, ambient=20)[0].select("node", F.coalesce("parent", F.lit(-1)).alias("parent"), "depth", "ambient")


@query(f"""WITH RECURSIVE {EDGES}, f AS (SELECT 1::BIGINT AS node UNION SELECT dst FROM f JOIN edges ON src = node), b AS (SELECT 3::BIGINT AS node UNION SELECT src FROM b JOIN edges ON dst = node)
SELECT node FROM f INTERSECT SELECT node FROM b""")
def trace_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.trace(edges(spark, sf_dir), seed(spark, 1), seed(spark, 3)).select("node")


# the least node at each step: distances from both ends, then a walk along them
@query(f"""WITH RECURSIVE {EDGES}, f AS (SELECT 1::BIGINT AS node, 0 AS d UNION SELECT dst, d + 1 FROM f JOIN edges ON src = node WHERE d < 8),
b AS (SELECT 3::BIGINT AS node, 0 AS d UNION SELECT src, d + 1 FROM b JOIN edges ON dst = node WHERE d < 8),
fd AS (SELECT node, min(d) AS d FROM f GROUP BY 1), bd AS (SELECT node, min(d) AS d FROM b GROUP BY 1), n AS (SELECT d AS n FROM fd WHERE node = 3),
o AS (SELECT node, fd.d FROM fd JOIN bd USING (node), n WHERE fd.d + bd.d = n),
w AS (SELECT 0 AS step, 1::BIGINT AS node UNION ALL SELECT step + 1, (SELECT min(dst) FROM edges JOIN o ON o.node = dst WHERE src = w.node AND o.d = step + 1) FROM w, n WHERE step < n)
SELECT step::INTEGER AS step, node FROM w""")
def trace_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stored(edges(spark, sf_dir))
    return gr.spine(e, gr.trace(e, seed(spark, 1), seed(spark, 3)))


@query(f"""WITH RECURSIVE {EDGES}, t AS (SELECT 5::BIGINT AS node UNION SELECT src FROM t JOIN edges ON dst = node)
SELECT p_partkey AS node, CASE WHEN p_partkey % 6 = 0 THEN 'precise' ELSE 'broad' END AS kind FROM part WHERE p_partkey % 3 = 0 AND (p_partkey % 6 = 0 OR p_partkey IN (SELECT node FROM t))""")
def affected_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = gr.reach(gr.reversed_edges(edges(spark, sf_dir)), seed(spark, 5))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    return gr.tests_reaching(near, parts.where("node % 3 = 0"), parts.where("node % 6 = 0"))


DIRS = "d AS (SELECT p_partkey AS node, p_brand AS dir FROM part)"
BETWEEN = f"{EDGES}, {DIRS}, b AS (SELECT x.dir AS from_dir, y.dir AS to_dir, count(*) AS edges FROM edges JOIN d x ON src = x.node JOIN d y ON dst = y.node WHERE x.dir <> y.dir GROUP BY 1, 2)"


@query(f"WITH {BETWEEN} SELECT from_dir, to_dir, edges FROM b")
def directory_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("dir"))
    return gr.directory_rollup(d, edges(spark, sf_dir))[1]


@query(f"""WITH {BETWEEN} SELECT dir, count(*) AS files, (SELECT count(*) FROM b WHERE to_dir = dir) AS fan_in, (SELECT count(*) FROM b WHERE from_dir = dir) AS fan_out FROM d GROUP BY dir""")
def project_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("dir"))
    return gr.directory_rollup(d, edges(spark, sf_dir))[0]


@query(f"WITH {PAGE_LINKS} SELECT page_id, href, count(*) AS n FROM links WHERE href NOT IN (SELECT url FROM pages) GROUP BY 1, 2")
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    l = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("href"))
    return l.join(p.select(F.col("url").alias("href")).distinct(), "href", "left_anti").groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


# part and lineitem as symbols: a part is an export of the file of its brand and size, a line item a reference.
EXPORTS = "ex AS (SELECT p_partkey AS export_id, p_brand || '-' || p_size AS file_id, p_type AS name, p_brand AS type FROM part)"
REFS = "rf AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, p_brand || '-' || l_linenumber AS file_id, p_type AS name, l_suppkey AS line FROM lineitem JOIN part ON l_partkey = p_partkey)"
IMPORTS = "im AS (SELECT p_partkey AS import_id, p_brand || '-' || (p_size % 7 + 1) AS file_id, p_type AS local, p_type AS original, p_brand || '-' || p_size AS resolved_file_id, p_partkey % 4 = 0 AS is_namespace FROM part)"


def _symbols(spark, sf_dir):
    p, l = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    at = lambda x: F.concat("p_brand", F.lit("-"), x.cast("string"))
    ex = p.select(F.col("p_partkey").alias("export_id"), at(F.col("p_size")).alias("file_id"), F.col("p_type").alias("name"), F.col("p_brand").alias("type"))
    rf = l.join(p, l.l_partkey == p.p_partkey).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), at(F.col("l_linenumber")).alias("file_id"), F.col("p_type").alias("name"), F.col("l_suppkey").alias("line"))
    im = p.select(F.col("p_partkey").alias("import_id"), at(F.col("p_size") % 7 + 1).alias("file_id"), F.col("p_type").alias("local"), F.col("p_type").alias("original"), at(F.col("p_size")).alias("resolved_file_id"), (F.col("p_partkey") % 4 == 0).alias("is_namespace"))
    return ex, rf, im


@query(f"""WITH {EXPORTS}, {REFS}, {IMPORTS}, own AS (SELECT file_id, name, min(export_id) AS r1 FROM ex GROUP BY 1, 2),
bf AS (SELECT file_id, name, min(export_id) AS id FROM ex GROUP BY 1, 2),
bd AS (SELECT im.file_id, local AS name, min(id) AS r2 FROM im JOIN bf ON bf.file_id = resolved_file_id AND bf.name = original WHERE NOT is_namespace GROUP BY 1, 2),
sp AS (SELECT DISTINCT rf.file_id, rf.line, resolved_file_id FROM rf JOIN im ON im.file_id = rf.file_id AND im.local = rf.name WHERE is_namespace),
mb AS (SELECT ref_id, min(id) AS r3 FROM rf JOIN sp USING (file_id, line) JOIN bf ON bf.file_id = sp.resolved_file_id AND bf.name = rf.name GROUP BY 1)
SELECT ref_id, name, line, coalesce(r1, r2, r3, -1) AS export_id, count(*) AS n FROM rf LEFT JOIN own USING (file_id, name) LEFT JOIN bd USING (file_id, name) LEFT JOIN mb USING (ref_id) GROUP BY ALL""")
def resolve_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex, rf, im = _symbols(spark, sf_dir)
    out = dealt(sy.resolve_references(rf, ex, im), table(spark, sf_dir, "lineitem").count(), "ref_id")
    return out.groupBy("ref_id", "name", "line", F.coalesce("resolved_export_id", F.lit(-1)).alias("export_id")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EXPORTS}, f AS (SELECT DISTINCT file_id, type || '/' || file_id || '.ts' AS path FROM ex)
SELECT name, path, ex.export_id, (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = name) AS references, (SELECT count(DISTINCT p_brand) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = name) AS modules
FROM ex JOIN f USING (file_id) WHERE contains(lower(name), 'e') ORDER BY name, path, export_id LIMIT 20""")
def search_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex, _, _ = _symbols(spark, sf_dir)
    f = ex.select("file_id", F.concat("type", F.lit("/"), "file_id", F.lit(".ts")).alias("path")).distinct()
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    home = p.select("p_partkey", F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("file_id"))
    refs = l.join(home, l.l_partkey == home.p_partkey).select(F.col("l_partkey").alias("resolved_export_id"), "file_id")
    return sy.search_symbols(ex, refs, f, "e").select("name", "path", "export_id", "references", "modules")


@query(f"""WITH {EXPORTS}, {REFS}, s AS (SELECT min(name) AS s FROM ex) SELECT DISTINCT file_id AS path, line + 1 AS line FROM rf, s WHERE name = s AND file_id NOT IN (SELECT file_id FROM ex, s WHERE name = s) ORDER BY 1, 2 LIMIT 200""")
def find_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex, rf, _ = _symbols(spark, sf_dir)
    name = ex.agg(F.min("name").alias("n")).first().n
    refs = rf.withColumn("resolved_export_id", F.lit(None).cast("long"))
    return sy.find_usages(refs, ex, rf.select("file_id", F.col("file_id").alias("path")).distinct(), name)


# parts as files, in two layouts of dotted modules and one of packages; edges as imports of what the part's file is called
@query(f"""WITH {EDGES}, f AS (SELECT p_partkey AS id, p_size AS s, p_partkey % 3 = 2 AS go, CASE p_partkey % 3 WHEN 0 THEN 'src/b' WHEN 1 THEN 'packs/x/b' ELSE 'go/b' END || p_size || '/m' || p_partkey || CASE p_partkey % 3 WHEN 2 THEN '.go' ELSE '.py' END AS path FROM part),
g AS (SELECT s, arg_min(id, path) AS first FROM f WHERE go GROUP BY s)
SELECT src * 1000000 + dst AS import_id, CASE WHEN t.go THEN g.first ELSE dst END AS resolved_file_id FROM edges JOIN f ON f.id = src JOIN f t ON t.id = dst LEFT JOIN g ON g.s = t.s WHERE f.go = t.go""")
def resolve_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, key = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    folder = F.concat(F.when(kind == 0, "src/b").when(kind == 1, "packs/x/b").otherwise("go/b"), F.col("p_size").cast("string"))
    called = F.when(kind == 2, F.concat(F.lit("ex.com/p/"), folder)).otherwise(F.concat(F.lit("b"), F.col("p_size").cast("string"), F.lit(".m"), key))
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.concat(folder, F.lit("/m"), key, F.when(kind == 2, ".go").otherwise(".py")).alias("path"), called.alias("specifier"))
    im = edges(spark, sf_dir).join(f.select(F.col("file_id").alias("src"), "path"), "src").join(f.select(F.col("file_id").alias("dst"), "specifier"), "dst")
    return sy.resolve_imports(im.select((F.col("src") * 1000000 + F.col("dst")).alias("import_id"), "path", "specifier"), f.select("file_id", "path"), "ex.com/p")


# chunks with ranges of lines: line items of an order, quantity as their length
RANGES = "rg AS (SELECT l_orderkey AS file_id, l_partkey AS chunk_id, (l_suppkey % 40)::BIGINT AS start_line, (l_suppkey % 40 + l_quantity)::BIGINT AS end_line FROM lineitem)"


@query(f"""WITH {RANGES}, pt AS (SELECT o_orderkey AS file_id, o_custkey % 60 AS line FROM orders), j AS (SELECT pt.*, chunk_id, start_line, end_line, row_number() OVER (PARTITION BY file_id, line ORDER BY end_line - start_line, start_line DESC, chunk_id) AS n
FROM pt JOIN rg USING (file_id) WHERE line BETWEEN start_line AND end_line) SELECT file_id, line, chunk_id, start_line, end_line FROM j WHERE n = 1""")
def containing_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    rg = l.select(F.col("l_orderkey").alias("file_id"), F.col("l_partkey").alias("chunk_id"), (F.col("l_suppkey") % 40).alias("start_line"), (F.col("l_suppkey") % 40 + F.col("l_quantity")).cast("long").alias("end_line"))
    pt = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), (F.col("o_custkey") % 60).alias("line"))
    return sy.containing(pt, rg, ["file_id"])


@query("""SELECT l_orderkey AS file_id, CASE WHEN l_linenumber % 3 = 0 THEN '#' || (l_partkey * 10 + l_linenumber) ELSE l_returnflag END AS entity, min(l_suppkey) AS start_line, max(l_suppkey + 3) AS end_line, count(*) AS chunks FROM lineitem GROUP BY 1, 2""")
def coalesced_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return sy.coalesced_ranges(l.select(F.col("l_orderkey").alias("file_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag")).alias("entity_name"), F.col("l_suppkey").alias("start_line"), (F.col("l_suppkey") + 3).alias("end_line")))


@query(f"""WITH {EXPORTS}, ch AS (SELECT DISTINCT p_brand || '-' || (p_size % 9) AS file_id, p_type AS name FROM part)
SELECT file_id, name, bool_or(e) AS is_export FROM (SELECT file_id, name, true AS e FROM ex UNION ALL SELECT file_id, name, false FROM ch) GROUP BY 1, 2""")
def callable_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex, _, _ = _symbols(spark, sf_dir)
    ch = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("-"), (F.col("p_size") % 9).cast("string")).alias("file_id"), F.col("p_type").alias("entity_name"))
    return sy.callable_candidates(ch, ex)


@query(f"""WITH {LINES}, t AS (SELECT file_id, chunk_index, snippet FROM lines)
SELECT file_id, chunk_index, unnest(list_transform(CASE WHEN length(snippet) = 0 THEN [] ELSE range(0, greatest(length(snippet) - 20 - 1, 0) + 1, 100) END, lambda i: substr(snippet, i + 1, 120))) AS piece FROM t""")
def split_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("file_id", "chunk_index", F.explode(ck.split_by_size("snippet", 120, 20)).alias("piece"))


@query("""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents),
m AS (SELECT doc_id, list_reduce(list_transform(parts, lambda x: {'out': []::VARCHAR[], 'buf': x}), lambda a, x: CASE WHEN length(a.buf) + length(x.buf) < 100 THEN {'out': a.out, 'buf': a.buf || chr(10) || chr(10) || x.buf}
  ELSE {'out': list_append(a.out, a.buf), 'buf': x.buf} END) AS r FROM p WHERE len(parts) > 0),
l AS (SELECT doc_id, list_append(r.out, r.buf) AS out FROM m)
SELECT doc_id, unnest(range(0, len(out)))::INTEGER AS chunk_index, unnest(out) AS snippet FROM l""")
def merge_tiny(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(ck.merge_tiny(F.split("text", "\n"))).alias("chunk_index", "snippet"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return ck.chunk_files(d.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 5 == 0, ".md").otherwise(".txt").alias("ext"), "text"))


@query(f"""WITH {LINES}, g AS (SELECT file_id, chunk_index // 4 AS grp, chunk_index, snippet FROM lines)
SELECT file_id, grp, count(*) AS members, min(chunk_index) AS start_line, max(chunk_index) AS end_line, sha256(string_agg(snippet, chr(10) || chr(10) ORDER BY chunk_index)) AS hash FROM g GROUP BY 1, 2 HAVING count(*) >= 2""")
def parent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lines(spark, sf_dir).withColumn("group", F.expr("chunk_index div 4")).withColumn("start_line", F.col("chunk_index")).withColumn("end_line", F.col("chunk_index"))
    return ck.parent_groups(c).select("file_id", F.col("group").alias("grp"), "members", "start_line", "end_line", F.sha2("snippet", 256).alias("hash"))


@query(f"""WITH {LINES}, c AS (SELECT file_id, sha256(snippet) AS h, min(chunk_index) AS chunk_index, count(*) AS n FROM lines GROUP BY 1, 2),
a AS (SELECT file_id, h, chunk_index FROM c WHERE chunk_index % 5 <> 0), b AS (SELECT file_id, h, chunk_index + (chunk_index % 3) AS chunk_index FROM c WHERE chunk_index % 7 <> 3),
j AS (SELECT file_id, h, a.chunk_index AS o, b.chunk_index AS n, CASE WHEN b.chunk_index IS NULL THEN 'delete' WHEN a.chunk_index IS NULL THEN 'insert' WHEN a.chunk_index = b.chunk_index THEN 'keep' ELSE 'move' END AS action FROM a FULL JOIN b USING (file_id, h)),
s AS (SELECT file_id, count(*) FILTER (WHERE action = 'insert') / greatest(count(n), 1) AS share FROM j GROUP BY 1)
SELECT file_id, h AS content_hash, action, coalesce(n, o) AS chunk_index, CASE WHEN share > 0.5 THEN 'full' ELSE 'incremental' END AS mode FROM j JOIN s USING (file_id)""")
def chunk_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lines(spark, sf_dir).groupBy("file_id", F.sha2("snippet", 256).alias("content_hash")).agg(F.min("chunk_index").alias("chunk_index"))
    return store.chunk_diff(c.where("chunk_index % 5 <> 0"), c.where("chunk_index % 7 <> 3").withColumn("chunk_index", F.col("chunk_index") + F.col("chunk_index") % 3))


@query(f"""WITH {LINES} SELECT file_id, count(*) > count(DISTINCT snippet) AS has_duplicates, count(DISTINCT snippet) AS kept FROM lines GROUP BY 1""")
def duplicate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lines(spark, sf_dir)
    kept = ck.first_of(c, ["file_id", "snippet"], "chunk_id").groupBy("file_id").agg(F.count(F.lit(1)).alias("kept"))
    n = c.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(kept, "file_id").select("file_id", (F.col("n") > F.col("kept")).alias("has_duplicates"), "kept")


@query("""WITH v AS (SELECT o_custkey AS k, o_orderkey AS v FROM orders WHERE o_orderstatus = 'O'), u AS (SELECT c_custkey AS k, 0::BIGINT AS v FROM customer)
SELECT k, min(v) AS v FROM (SELECT k, v FROM v UNION ALL SELECT k, v + 1000000000 FROM u) GROUP BY 1""")
def prefer_first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.lit(0).alias("source"))
    u = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(1000000000).cast("long").alias("v"), F.lit(1).alias("source"))
    w = Window.partitionBy("k").orderBy("source", "v")
    return o.unionByName(u).withColumn("n", F.row_number().over(w)).where("n = 1").select("k", "v")


@query("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM region JOIN nation ON n_regionkey = r_regionkey
LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def dimension_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    j = n.join(r, n.n_regionkey == r.r_regionkey).join(c, n.n_nationkey == c.c_nationkey, "left").join(s, n.n_nationkey == s.s_nationkey, "left")
    return j.select("r_name", "n_name", F.coalesce("customers", F.lit(0)).cast("long").alias("customers"), F.coalesce("suppliers", F.lit(0)).cast("long").alias("suppliers"))
