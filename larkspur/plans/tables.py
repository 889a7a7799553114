"""Queries on stored tables: inserting, replacing and removing rows by key, lookups, arrays in text, previews; and the
text functions that no other query runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import chunking as ck
from ..operators import conversations as cv
from ..operators import telemetry as tl
from ..sources import store
from .callgraph import CODE, code
from .memory import TURNS, turns
from .registry import FILES, LINES, QUERY_LOG, files, lines, query, query_log, table

GONE = "gone AS (SELECT file_id FROM files WHERE path LIKE 'src/d2/%')"


@query(f"""WITH {CODE}, {GONE} SELECT 'files' AS name, count(*) AS rows, 0 AS nulls FROM files WHERE file_id NOT IN (SELECT file_id FROM gone) UNION ALL SELECT 'chunks', count(*), 0 FROM chunks WHERE file_id NOT IN (SELECT file_id FROM gone)
UNION ALL SELECT 'exports', count(*), 0 FROM exports WHERE file_id NOT IN (SELECT file_id FROM gone)
UNION ALL SELECT 'imports', count(*), count(*) FILTER (WHERE resolved_file_id IS NULL OR resolved_file_id NOT IN (SELECT file_id FROM files WHERE file_id NOT IN (SELECT file_id FROM gone))) FROM imports WHERE file_id NOT IN (SELECT file_id FROM gone)
UNION ALL SELECT 'refs', count(*), count(*) FILTER (WHERE resolved_export_id IS NULL OR resolved_export_id IN (SELECT export_id FROM exports WHERE file_id IN (SELECT file_id FROM gone))) FROM refs WHERE file_id NOT IN (SELECT file_id FROM gone)""")
def remove_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = code(spark, sf_dir)
    left = store.remove_files(t, t["files"].where("path like 'src/d2/%'"))
    nulls = {"imports": "resolved_file_id", "refs": "resolved_export_id"}
    out = None
    for name, rows in left.items():
        one = rows.agg(F.count(F.lit(1)).alias("rows"), (F.count_if(F.col(nulls[name]).isNull()) if name in nulls else F.lit(0)).cast("int").alias("nulls")).select(F.lit(name).alias("name"), "rows", "nulls")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("nulls", F.col("nulls").cast("long"))


@query(f"WITH {CODE} SELECT DISTINCT file_id FROM imports WHERE resolved_file_id IS NOT NULL AND file_id NOT IN (SELECT file_id FROM refs WHERE file_id % 4 <> 0)")
def stale_reference_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = code(spark, sf_dir)
    return store.stale_reference_files(t["imports"], t["refs"].where("file_id % 4 <> 0"))


@query(f"""WITH {CODE}, f AS (SELECT file_id FROM files WHERE path LIKE 'tests/%') SELECT chunk_id, file_id, entity_name FROM chunks WHERE file_id NOT IN (SELECT file_id FROM f)
UNION ALL SELECT chunk_id + 1000000, file_id, 'new' FROM chunks WHERE file_id IN (SELECT file_id FROM f) AND chunk_type = 'class'""")
def replace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = code(spark, sf_dir)
    c, tests = t["chunks"].select("chunk_id", "file_id", "entity_name"), t["files"].where("path like 'tests/%'")
    new = t["chunks"].where("chunk_type = 'class'").join(tests, "file_id", "left_semi").select((F.col("chunk_id") + 1000000).alias("chunk_id"), "file_id", F.lit("new").alias("entity_name"))
    return store.replace_of_files(c, new, tests)


@query(f"""WITH {CODE}, rd AS (SELECT path, 'h' || file_id AS hash FROM files WHERE file_id % 3 = 0), k AS (SELECT file_id, path FROM files WHERE file_id % 2 = 0)
SELECT path, coalesce(hash, 'old') AS hash, k.path IS NOT NULL AS known, (SELECT count(*) FROM chunks c JOIN files f USING (file_id) WHERE f.path = p.path AND CASE WHEN rd.path IS NOT NULL THEN c.chunk_type = 'method' ELSE k.path IS NOT NULL END) AS chunks
FROM (SELECT path FROM k UNION SELECT path FROM rd) p LEFT JOIN k USING (path) LEFT JOIN rd USING (path)""")
def upsert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = code(spark, sf_dir)
    known = t["files"].where("file_id % 2 = 0").select("file_id", "path", F.lit("old").alias("hash"))
    read = t["files"].where("file_id % 3 = 0").select("path", F.concat(F.lit("h"), F.col("file_id").cast("string")).alias("hash"))
    at = t["chunks"].join(t["files"], "file_id")
    fresh = at.where("chunk_type = 'method'").join(read, "path", "left_semi").select("path", "chunk_id")
    held = at.join(known, "path", "left_semi").select("file_id", "chunk_id")
    f, c = store.upsert_files(known, held, read, fresh)
    n = c.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"))
    return f.join(n, "file_id", "left").join(known.select("path", F.lit(True).alias("known")), "path", "left").select("path", "hash", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))


@query(f"WITH {QUERY_LOG} SELECT query, count(*) AS n, count(duration_ms) AS timed FROM (SELECT query, NULL::BIGINT AS duration_ms FROM query_log UNION ALL SELECT 'new ' || (user_id % 5), 7 FROM query_log WHERE result_count = 0) GROUP BY 1")
def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = query_log(spark, sf_dir)
    new = l.where("result_count = 0").select(F.concat(F.lit("new "), (F.col("user_id") % 5).cast("string")).alias("query"), F.lit(7).cast("long").alias("duration_ms"))
    return store.append(l.select("query"), new).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.count("duration_ms").alias("timed"))


@query(f"WITH {TURNS}, a AS (SELECT session_id, CASE WHEN session_id % 5 = 0 THEN -1 ELSE 0 END AS last FROM turns WHERE session_id % 3 = 0 GROUP BY 1) SELECT session_id, turn_index FROM turns LEFT JOIN a USING (session_id) WHERE last IS NULL OR turn_index <= last")
def delete_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).select("session_id", "turn_index")
    above = t.where("session_id % 3 = 0").select("session_id").distinct().withColumn("last", F.when(F.col("session_id") % 5 != 0, 0))
    return cv.delete_turns(t, above)


@query(f"""WITH {TURNS}, n AS (SELECT session_id, count(*) AS turn_count, max(turn_index) AS last_turn, sum(token_cost)::BIGINT AS total_tokens FROM turns WHERE session_id % 2 = 0 GROUP BY 1)
SELECT session_id, coalesce(n.turn_count, 1) AS turn_count, coalesce(n.last_turn, 0) AS last_turn, coalesce(n.total_tokens, 5) AS total_tokens FROM (SELECT DISTINCT session_id FROM turns) LEFT JOIN n USING (session_id)""")
def upsert_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    long = lambda x: F.lit(x).cast("long")
    old = t.select("session_id").distinct().select("session_id", long(1).alias("turn_count"), long(0).alias("last_turn"), long(5).alias("total_tokens"))
    return cv.upsert_sessions(old, t.where("session_id % 2 = 0"))


@query(f"WITH {TURNS}, l AS (SELECT *, max(turn_index) OVER (PARTITION BY session_id) AS last FROM turns) SELECT session_id, turn_index FROM l WHERE turn_index BETWEEN least(1, last) AND least(2, last)")
def turns_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.turn_window(turns(spark, sf_dir), first=1, last=2).select("session_id", "turn_index")


@query("""SELECT 'found' AS kind, c_custkey AS key FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') UNION ALL SELECT 'missing', o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)""")
def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderpriority")
    found = store.lookup(c, "key", o.where("o_orderpriority like '1%'")).select(F.lit("found").alias("kind"), "key")
    return found.unionByName(store.missing(c.where("key % 7 <> 0"), "key", o).select(F.lit("missing").alias("kind"), "key"))


@query("""WITH c AS (SELECT l_orderkey AS file_id, l_linenumber % 2 AS chunk_index, l_returnflag AS content_hash, l_orderkey * 10 + l_linenumber AS chunk_id FROM lineitem)
SELECT min(chunk_id) AS chunk_id, file_id, chunk_index::INTEGER AS chunk_index, content_hash, (file_id IN (SELECT file_id FROM c GROUP BY file_id, chunk_index, content_hash HAVING count(*) > 1)) AS again FROM c GROUP BY file_id, chunk_index, content_hash""")
def collapse_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") % 2).cast("int").alias("chunk_index"), F.col("l_returnflag").alias("content_hash"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"))
    kept, again = store.collapse_duplicates(l)
    return kept.join(again.withColumn("again", F.lit(True)), "file_id", "left").withColumn("again", F.coalesce("again", F.lit(False)))


@query(f"""WITH {LINES}, h AS (SELECT file_id, sha256(snippet) AS content_hash, min(chunk_id) AS chunk_id, length(any_value(snippet)) AS n FROM lines GROUP BY 1, 2)
SELECT chunk_id, name, line::INTEGER AS line FROM (SELECT chunk_id, 'a' AS name, unnest([1, n % 7]) AS line FROM h UNION ALL SELECT chunk_id, 'b', n % 5 FROM h)""")
def rewrite_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lines(spark, sf_dir).withColumn("content_hash", F.sha2("snippet", 256))
    n = F.length("snippet")
    fresh = l.groupBy("file_id", "content_hash").agg(F.max(n).alias("n")).select("file_id", "content_hash", F.create_map(F.lit("a"), F.array(F.lit(1), F.col("n") % 7), F.lit("b"), F.array(F.col("n") % 5)).alias("references"))
    return store.rewrite_references(l, fresh)


@query("""SELECT l_orderkey AS id, to_json(list(l_partkey ORDER BY l_linenumber, l_partkey))::VARCHAR AS packed, count(*)::INTEGER AS n FROM lineitem GROUP BY 1""")
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    packed = tx.packed(F.transform("x", lambda r: r["l_partkey"]))
    return l.select("id", packed.alias("packed"), F.size(tx.unpacked(packed, "bigint")).alias("n"))


@query(f"WITH {FILES} SELECT path, CASE WHEN length(text) > 120 THEN trim(substr(text, 1, 120), ' ') || '...' ELSE text END AS preview FROM files")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", tx.preview("text", 120).alias("preview"))


@query(f"""WITH {FILES}, l AS (SELECT path, text, unnest(list_filter(string_split(text, chr(10)), lambda x: length(x) > 0)[1:3]) AS part, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: length(x) > 0)[1:3], 1) AS k FROM files)
SELECT path, count(*)::INTEGER AS parts, bool_and(contains(text, part)) AS found FROM l GROUP BY 1""")
def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("path", "text", F.slice(F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0), 1, 3).alias("parts")).where(F.size("parts") > 0)
    spans = tx.line_span(F.col("text"), F.col("parts"))
    return f.select("path", spans.alias("s")).select("path", F.size("s").alias("parts"), F.forall("s", lambda x: x["start_line"].isNotNull() & (x["end_line"] >= x["start_line"])).alias("found"))


@query(f"""WITH {CODE} SELECT c.chunk_id, CASE WHEN p.entity_name IS NOT NULL AND coalesce(x.name, c.entity_name) IS NOT NULL THEN p.entity_name || '.' || coalesce(x.name, c.entity_name) ELSE coalesce(x.name, c.entity_name, '') END AS name
FROM chunks c LEFT JOIN chunks p ON p.chunk_id = c.parent_id LEFT JOIN exports x ON x.export_id = c.chunk_id""")
def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = code(spark, sf_dir)
    p = t["chunks"].select(F.col("chunk_id").alias("parent_id"), F.col("entity_name").alias("_parent"))
    x = t["exports"].select(F.col("export_id").alias("chunk_id"), F.col("name").alias("_export"))
    return t["chunks"].join(p, "parent_id", "left").join(x, "chunk_id", "left").select("chunk_id", F.coalesce(tx.entity_name(F.col("_parent"), F.col("_export"), F.col("entity_name")), F.lit("")).alias("name"))


@query(f"""WITH {FILES}, w AS (SELECT path, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS t FROM files)
SELECT path, (CASE WHEN len(t) <= 256 THEN 1 ELSE len(range(0, greatest(len(t) - 32 - 1, 0) + 1, 224)) END)::INTEGER AS windows FROM w""")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return files(spark, sf_dir).select("path", F.size(vx.token_windows(words)).alias("windows"))


@query("""WITH q AS (SELECT label AS query_id, label % 2 AS model, vec_id AS item FROM embeddings WHERE vec_id % 25 = 0), r AS (SELECT label AS query_id, vec_id AS item, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 7919) % 1009, vec_id) AS rank FROM embeddings),
m AS (SELECT query_id, any_value(model) AS model, count(*) FILTER (WHERE rank <= 5) / count(*) AS recall, coalesce(1 / min(rank), 0) AS rr FROM q JOIN r USING (query_id, item) GROUP BY 1)
SELECT model::BIGINT AS model, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg((recall = 0)::INT), 6) AS zero_miss, avg(recall) >= 0.1 AND avg(rr) >= 0.1 AS passed FROM m GROUP BY 1""")
def benchmark_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("item"))
    r = v.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy((F.col("item") * 7919) % 1009, "item")))
    per = tl.retrieval_metrics(r, v.where("item % 25 = 0"), 5).withColumn("model", (F.col("query_id") % 2).cast("long"))
    g = tl.gate(per, 0.1, 0.1, "model")
    return g.select("model", "queries", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "zero_miss")], "passed")


@query(f"""WITH {LINES}, g AS (SELECT file_id, chunk_index, chunk_index // 3 AS grp, chunk_index % 3 AS k FROM lines), n AS (SELECT file_id, grp, count(*) AS members FROM g GROUP BY 1, 2)
SELECT file_id, chunk_index, coalesce(members = 3, false) AS grouped FROM g JOIN n USING (file_id, grp)""")
def bookend_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("chunk_index") % 3
    c = lines(spark, sf_dir).select("file_id", "chunk_index", F.when(k == 0, "class_start").when(k == 2, "class_end").otherwise("method").alias("chunk_type"), F.concat(F.lit("c"), F.expr("chunk_index div 3").cast("string")).alias("entity_name"))
    return ck.bookend_groups(c).select("file_id", "chunk_index", F.col("group").isNotNull().alias("grouped"))
