"""Queries on history, conversations, telemetry and stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conversations as cv
from ..operators import history as hs
from ..operators import memory as mm
from ..operators import telemetry as tl
from ..runtime import dealt, stored
from ..sources import store
from .registry import COMMIT_FILES, COMMITS, FILES, QUERY_LOG, commit_files, commits, files, query, query_log, table

HIST = f"{COMMITS}, {COMMIT_FILES}"


@query(f"""WITH {HIST}, sized AS (SELECT commit_id FROM commit_files GROUP BY 1 HAVING count(DISTINCT file_path) BETWEEN 2 AND 25),
u AS (SELECT DISTINCT commit_id, file_path FROM commit_files JOIN sized USING (commit_id) JOIN commits USING (commit_id) WHERE NOT is_merge),
m AS (SELECT DISTINCT commit_id FROM u WHERE file_path = 'part_1.c' OR file_path LIKE '%/part\\_1.c' ESCAPE '\\'), n AS (SELECT count(*) AS target FROM m),
t AS (SELECT file_path, count(*) AS together FROM u JOIN m USING (commit_id) WHERE file_path <> 'lib/part_1.c' GROUP BY 1 HAVING count(*) >= 1),
c AS (SELECT file_path, count(*) AS changes FROM u GROUP BY 1)
SELECT file_path, together, changes, round(together / (target + changes - together), 6) AS jaccard, round(together / least(target, changes), 6) AS confidence
FROM t JOIN c USING (file_path), n ORDER BY together / (target + changes - together) DESC, together DESC, file_path LIMIT 15""")
def co_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hs.co_change(commits(spark, sf_dir), commit_files(spark, sf_dir), "part_1.c", k=15, least=1)
    return out.select("file_path", "together", "changes", F.round("jaccard", 6).alias("jaccard"), F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {HIST} SELECT file_path, commit_id, date, row_number() OVER (PARTITION BY file_path ORDER BY date DESC, commit_id)::INTEGER AS rank
FROM commit_files JOIN commits USING (commit_id) QUALIFY rank <= 3""")
def newest_commits_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.newest_per_file(commits(spark, sf_dir), commit_files(spark, sf_dir), 3, table(spark, sf_dir, "lineitem").count()).select("file_path", "commit_id", "date", "rank")


@query(f"""WITH {HIST} SELECT commit_id, date, author, insertions FROM commits JOIN commit_files USING (commit_id) WHERE file_path LIKE '%/part\\_2.c' ESCAPE '\\' AND date >= '1995'
ORDER BY date DESC, commit_id LIMIT 20""")
def file_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.file_history(commits(spark, sf_dir), commit_files(spark, sf_dir), "part_2.c", "1995").select("commit_id", "date", "author", "insertions")


@query(f"""WITH {HIST}, l AS (SELECT commit_id, list(file_path) AS fs FROM commit_files GROUP BY 1)
SELECT commit_id, date FROM commits JOIN l USING (commit_id) WHERE contains(lower(author), '#00000000') AND substr(date, 1, 7) >= '1995-03' AND substr(date, 1, 10) <= '1997-06-30'
AND len(list_filter(fs, lambda f: contains(f, 'part_1'))) > 0""")
def commit_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = commit_files(spark, sf_dir).groupBy("commit_id").agg(F.collect_list("file_path").alias("files_changed"))
    return hs.commit_filter(commits(spark, sf_dir).join(l, "commit_id"), "#00000000", "1995-03", "1997-06-30", "part_1").select("commit_id", "date")


@query(f"WITH {COMMITS} SELECT count(*) AS n_commits, max(date) AS last_date, arg_max(commit_id, (date, commit_id)) AS last_id, arg_max(message, (date, commit_id)) AS last_message FROM commits")
def history_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.git_status(commits(spark, sf_dir))


@query("""WITH n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey % 50 END AS sha FROM orders), f AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS path FROM lineitem),
ch AS (SELECT DISTINCT o_custkey % 50 AS sha, l_suppkey AS path FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 3 = 0),
k AS (SELECT DISTINCT c_custkey % 50 AS sha FROM customer WHERE c_custkey % 50 <> 7),
h AS (SELECT id, count(*) AS n FROM n JOIN f USING (id) WHERE (sha, path) IN (SELECT (sha, path) FROM ch) GROUP BY 1)
SELECT id, CASE WHEN sha IS NULL THEN NULL WHEN sha NOT IN (SELECT sha FROM k) THEN 'diverged' WHEN h.n > 0 THEN 'stale' ELSE 'current' END AS verdict, coalesce(h.n, 0) AS n_stale FROM n LEFT JOIN h USING (id)""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    n_lines = l.count()
    l = dealt(l.select("l_orderkey", "l_partkey", "l_suppkey"), n_lines, "l_orderkey")
    f = l.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("files_involved"))
    n = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_custkey") % 50).cast("string")).alias("commit_hash")).join(f, "id", "left")
    ch = o.where("o_custkey % 3 = 0").join(l, o.o_orderkey == l.l_orderkey).select((F.col("o_custkey") % 50).cast("string").alias("sha"), F.col("l_suppkey").cast("string").alias("path"))
    ch = dealt(ch, n_lines, "sha", "path").distinct()
    known = c.where("c_custkey % 50 <> 7").select((F.col("c_custkey") % 50).cast("string").alias("sha")).distinct()
    return hs.freshness(n, ch, known, n_lines).select("id", "verdict", F.coalesce(F.size("stale_files"), F.lit(0)).cast("long").alias("n_stale"))


@query(f"WITH {COMMITS} SELECT commit_id AS hash, date FROM commits WHERE commit_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def purge_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    reachable = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("hash"))
    return hs.purge(commits(spark, sf_dir).select(F.col("commit_id").alias("hash"), "date"), reachable)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    e = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", "text", F.array(F.concat(F.lit("t"), (F.length("text") % 3).cast("string"))).alias("tools"), F.lit(None).cast("array<string>").alias("files"), F.size(F.split("text", " ")).alias("tokens"))
    return cv.fold_turns(e)


TURNS = """ev AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ti, len(string_split(text, ' ')) AS tok FROM conversations),
turns AS (SELECT conv_id AS session_id, ti::BIGINT AS turn_index, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'user' AND text <> ''), '') AS user_text,
  coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant' AND text <> ''), '') AS assistant_text,
  coalesce(sum(tok) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS token_cost, count(*) AS n_events, count(DISTINCT length(text) % 3) AS n_tools FROM ev WHERE ti >= 0 GROUP BY 1, 2)"""


@query(f"""WITH {TURNS} SELECT session_id, turn_index, user_text, assistant_text, token_cost, n_events, n_tools::INTEGER AS n_tools, substr(CASE WHEN user_text <> '' THEN user_text ELSE assistant_text END, 1, 200) AS summary
FROM turns WHERE user_text <> '' OR assistant_text <> ''""")
def turn_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("session_id", "turn_index", "user_text", "assistant_text", "token_cost", "n_events", F.size("tools_used").alias("n_tools"), "summary")


@query(f"WITH {TURNS} SELECT session_id, count(*) AS turn_count, max(turn_index) AS last_turn, sum(token_cost)::BIGINT AS total_tokens FROM turns GROUP BY 1")
def session_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.session_stats(turns(spark, sf_dir))


@query(f"""WITH {TURNS}, l AS (SELECT *, max(turn_index) OVER (PARTITION BY session_id) AS last FROM turns)
SELECT session_id, turn_index FROM l WHERE turn_index BETWEEN least(greatest(2, 0), last) - 1 AND least(greatest(2, 0), last) + 1""")
def turn_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.turn_window(turns(spark, sf_dir), turn=2, context=1).select("session_id", "turn_index")


@query(f"""WITH {TURNS}, b AS (SELECT session_id, turn_index, user_text || chr(10) || assistant_text AS block FROM turns),
u AS (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY session_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM b)
SELECT session_id, turn_index, substr(block, 1, 1500 - used) AS block FROM u WHERE length(block) <= 1500 - used OR 1500 - used > 200""")
def character_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = turns(spark, sf_dir).select("session_id", "turn_index", F.concat("user_text", F.lit("\n"), "assistant_text").alias("block"))
    return cv.budget(b, 1500)


@query("""WITH v AS (SELECT conv_id, turn // 2 AS slot, turn AS version, text FROM conversations)
SELECT conv_id, slot, max(version) AS version, arg_max(text, version) AS text FROM v GROUP BY 1, 2""")
def replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "conversations").select("conv_id", F.expr("turn div 2").alias("slot"), F.col("turn").alias("version"), "text")
    return cv.latest(v, ["conv_id", "slot"], "version")


@query("""SELECT source AS file, CASE WHEN bool_or(lang = 'de' AND doc_id % 40 = 3) THEN 'own' WHEN count(lang) > 0 THEN 'foreign' ELSE 'unknown' END AS owner FROM documents GROUP BY 1""")
def transcript_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.when((F.col("lang") == "de") & (F.col("doc_id") % 40 == 3), "mine").otherwise(F.col("lang")).alias("cwd"))
    return cv.session_owner(e, "mine")


@query(f"""WITH {QUERY_LOG} SELECT count(*) AS queries, round(avg(result_count), 6) AS avg_results, round(avg(top_score), 6) AS avg_score, count(*) FILTER (WHERE result_count = 0) AS zero_results,
count(*) FILTER (WHERE top_score < 0.3) AS low_scores FROM query_log""")
def analytics_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.totals(query_log(spark, sf_dir)).withColumn("avg_results", F.round("avg_results", 6)).withColumn("avg_score", F.round("avg_score", 6))


@query(f"WITH {QUERY_LOG} SELECT query, count(*) AS n FROM query_log GROUP BY 1 ORDER BY n DESC, query LIMIT 10")
def analytics_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.top_terms(query_log(spark, sf_dir))


@query(f"WITH {QUERY_LOG} SELECT query, count(*) AS n FROM query_log WHERE result_count = 0 GROUP BY 1 ORDER BY n DESC, query LIMIT 10")
def analytics_zero_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.top_terms(query_log(spark, sf_dir), zero_only=True)


@query(f"WITH {QUERY_LOG} SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM query_log GROUP BY 1")
def analytics_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.per_day(query_log(spark, sf_dir))


@query(f"""WITH {QUERY_LOG}, t AS (SELECT *, created_at >= TIMESTAMP '2024-01-15' AND created_at < TIMESTAMP '2024-01-22' AS now, created_at >= TIMESTAMP '2024-01-08' AND created_at < TIMESTAMP '2024-01-15' AS old FROM query_log)
SELECT count(*) FILTER (WHERE now) AS queries_now, round(avg(top_score) FILTER (WHERE now), 6) AS score_now, round(count(*) FILTER (WHERE now AND result_count = 0) / count(*) FILTER (WHERE now), 6) AS zero_rate_now,
 count(*) FILTER (WHERE old) AS queries_before, round(avg(top_score) FILTER (WHERE old), 6) AS score_before, round(count(*) FILTER (WHERE old AND result_count = 0) / count(*) FILTER (WHERE old), 6) AS zero_rate_before,
 count(*) FILTER (WHERE now) - count(*) FILTER (WHERE old) AS queries_delta, round(avg(top_score) FILTER (WHERE now) - avg(top_score) FILTER (WHERE old), 6) AS score_delta FROM t""")
def analytics_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tl.trend(query_log(spark, sf_dir), "2024-01-08", "2024-01-15", "2024-01-22")
    return t.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in t.dtypes])


@query("""WITH e AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY (doc_id * 7919) % 1009, doc_id) AS rank FROM e),
q AS (SELECT e.item_id AS query_id, count(*) FILTER (WHERE rank <= 1) / count(*) AS recall, coalesce(1 / min(rank), 0) AS rr FROM e LEFT JOIN r USING (item_id, doc_id) GROUP BY 1)
SELECT query_id, round(recall, 6) AS recall, round(rr, 6) AS rr FROM q""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = stored(tl.passages_in(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("item")))
    r = e.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy((F.col("item") * 7919) % 1009, "item")))
    return tl.retrieval_metrics(r, e, 1).select("query_id", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"))


@query("""WITH k AS (SELECT unnest([1, 5, 10]) AS k), r AS (SELECT label AS query_id, vec_id AS item, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 7919) % 1009, vec_id) AS rank FROM embeddings),
e AS (SELECT label AS query_id, vec_id AS item FROM embeddings WHERE vec_id % 25 = 0),
q AS (SELECT k, query_id, count(*) FILTER (WHERE rank <= k) / count(*) AS recall, coalesce(1 / min(rank), 0) AS rr FROM e JOIN r USING (query_id, item), k GROUP BY 1, 2)
SELECT k, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg((recall = 0)::INT), 6) AS zero_miss FROM q GROUP BY 1""")
def recall_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("item"))
    r = v.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy((F.col("item") * 7919) % 1009, "item")))
    e = v.where("item % 25 = 0")  # the items that count as relevant
    out = None
    for k in (1, 5, 10):
        s = tl.summary(tl.retrieval_metrics(r, e, k)).select(F.lit(k).alias("k"), "queries", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "zero_miss")])
        out = s if out is None else out.unionByName(s)
    return out


@query(f"""WITH {FILES}, w AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3)) AS word FROM benchmark),
n AS (SELECT item_id AS task_id, path, count(*) AS score FROM files JOIN w ON contains(lower(path), word) GROUP BY 1, 2)
SELECT task_id, path, score, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, path)::INTEGER AS rank FROM n QUALIFY rank <= 5""")
def filename_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"), F.col("text").alias("task"))
    return tl.keyword_baseline(tasks, files(spark, sf_dir).select("path"), 5)


@query("""WITH t AS (SELECT CASE WHEN label % 2 = 0 THEN 'a' ELSE 'b' END AS arm, vec_id * 3 % 101 AS tokens, vec_id % 13 AS ms, vec_id % 4 = label % 4 AS hit FROM embeddings)
SELECT arm, count(*) AS tasks, round(avg(tokens), 6) AS avg_tokens, round(avg(ms), 6) AS avg_ms, round(avg(hit::INT), 6) AS hit_rate FROM t GROUP BY 1""")
def ab_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    t = v.select(F.when(F.col("label") % 2 == 0, "a").otherwise("b").alias("arm"), (F.col("vec_id") * 3 % 101).alias("tokens"), (F.col("vec_id") % 13).alias("duration_ms"), F.array((F.col("vec_id") % 4).cast("long")).alias("read"), F.array((F.col("label") % 4).cast("long")).alias("expected"))
    return tl.ab_stats(t).select("arm", "tasks", *[F.round(c, 6).alias(c) for c in ("avg_tokens", "avg_ms", "hit_rate")])


@query("""WITH e AS (SELECT 'p' || (doc_id % 60) AS path, CASE WHEN doc_id % 4 <> 0 THEN 's' || (doc_id % 3) END AS symbol_name, n_chars AS note, lang AS author, doc_id AS ts FROM documents)
SELECT path, symbol_name, min(ts) AS created_at, max(ts) AS updated_at, arg_max(note, ts) AS note, arg_max(author, ts) AS author FROM e GROUP BY 1, 2""")
def annotation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    e = d.select(F.concat(F.lit("p"), (F.col("doc_id") % 60).cast("string")).alias("path"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))).alias("symbol_name"), F.col("n_chars").alias("note"), F.col("lang").alias("author"), F.col("doc_id").alias("at"))
    return mm.annotation_upsert(e)


@query("""WITH o AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, upper(c_mktsegment) AS v FROM customer WHERE c_custkey % 5 = 0)
SELECT k, coalesce(n.v, o.v) AS v FROM o FULL JOIN n USING (k)""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return store.upsert(c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("k"), F.upper("c_mktsegment").alias("v")), ["k"])


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 5 = 0""")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return store.insert_or_ignore(c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v")), ["k"])


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity < 3)")
def prune_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = table(spark, sf_dir, "lineitem").where("l_quantity < 3").select(F.col("l_suppkey").alias("s_suppkey"))
    return store.prune(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), scanned, "s_suppkey")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) THEN l_suppkey ELSE -1 END AS l_suppkey FROM lineitem""")
def null_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return store.null_dangling(l, table(spark, sf_dir, "supplier").where("s_acctbal > 0"), "l_suppkey", "s_suppkey").fillna(-1, ["l_suppkey"])
