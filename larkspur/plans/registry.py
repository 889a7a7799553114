"""Where queries register themselves, and the driver's tables in the roles that operators expect.

Each adapter exists twice, as a DataFrame and as a SQL fragment, so that a query and its DuckDB equivalent
start from the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import dealt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files of a repository: file_id, path, text."""
    folder = F.when(F.col("doc_id") % 7 == 0, "tests/").when(F.col("doc_id") % 7 == 1, "src/").otherwise("")
    ext = F.when(F.col("doc_id") % 5 == 0, ".md").otherwise(".txt")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat("source", F.lit("/"), "lang", F.lit("/"), folder, F.lit("doc_"), F.col("doc_id").cast("string"), ext).alias("path"), "text")


FILES = """files AS (SELECT doc_id AS file_id, source || '/' || lang || '/' || CASE doc_id % 7 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/' ELSE '' END
  || 'doc_' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.md' ELSE '.txt' END AS path, text FROM documents)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as commits: commit_id, date (ISO text), author, message, is_merge."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    o = dealt(o, o.count(), "o_custkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("commit_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        F.col("c_name").alias("author"), F.col("o_orderpriority").alias("message"), (F.col("o_orderstatus") == "P").alias("is_merge"),
    )


COMMITS = """commits AS (SELECT o_orderkey AS commit_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS date, c_name AS author, o_orderpriority AS message,
  o_orderstatus = 'P' AS is_merge FROM orders JOIN customer ON o_custkey = c_custkey)"""


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as the files of commits: commit_id, file_path, insertions."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return dealt(l, l.count(), "l_orderkey").groupBy(F.col("l_orderkey").alias("commit_id"), F.concat(F.lit("lib/part_"), F.col("l_partkey").cast("string"), F.lit(".c")).alias("file_path")).agg(F.sum(F.col("l_quantity").cast("long")).alias("insertions"))


COMMIT_FILES = """commit_files AS (SELECT l_orderkey AS commit_id, 'lib/part_' || l_partkey || '.c' AS file_path, SUM(l_quantity::BIGINT)::BIGINT AS insertions
  FROM lineitem GROUP BY 1, 2)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import edges between parts that follow each other in an order: src, dst."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    n = l.count()
    e = dealt(l, n, "l_orderkey").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return dealt(e.where("dst is not null"), n, "src", "dst").distinct()


EDGES = """edges AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst
  FROM lineitem) WHERE dst IS NOT NULL)"""


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a query log: query, result_count, top_score, user_id, created_at."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat("event_type", F.lit(" "), (F.col("user_id") % 40).cast("string")).alias("query"), F.get_json_object("props", "$.k").cast("long").alias("result_count"), F.when(F.col("event_id") % 9 != 0, F.col("value") / 1000).alias("top_score"), "user_id", F.col("ts").alias("created_at"))


QUERY_LOG = """query_log AS (SELECT event_type || ' ' || (user_id % 40) AS query, (props->>'$.k')::BIGINT AS result_count, CASE WHEN event_id % 9 <> 0 THEN value / 1000 END AS top_score,
  user_id, ts AS created_at FROM events)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of files as chunks: chunk_id, file_id, chunk_index, snippet."""
    f = files(spark, sf_dir).select("file_id", "path", F.posexplode(F.split("text", "\n")).alias("chunk_index", "snippet"))
    return f.select((F.col("file_id") * 100000 + F.col("chunk_index")).alias("chunk_id"), "file_id", "path", F.col("chunk_index").cast("long").alias("chunk_index"), "snippet")


LINES = FILES + """, lines AS (SELECT file_id * 100000 + chunk_index AS chunk_id, file_id, path, chunk_index, snippet FROM
  (SELECT file_id, path, unnest(string_split(text, chr(10))) AS snippet, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index FROM files))"""

FOLD = "translate(lower(coalesce({0}, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


def bm25_sql(query: str, source: str, key: str, text: str, name: str = "bm") -> str:
    """A CTE of BM25 scores of one-word phrases."""
    from ..functions.text import query_phrases

    terms = list(dict.fromkeys(p[0] for p in query_phrases(query)))
    quoted = ", ".join(f"'{t}'" for t in terms)
    return f"""tok AS (SELECT {key}, regexp_extract_all({FOLD.format(text)}, '[\\p{{L}}\\p{{N}}]+') AS t FROM {source}),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
tf AS (SELECT {key}, term, len(t) AS dl, len(list_filter(t, lambda x: x = term)) AS f FROM tok, (SELECT unnest([{quoted}]) AS term) AS terms),
df AS (SELECT term, count(*) FILTER (WHERE f > 0) AS d FROM tf GROUP BY term),
{name} AS (SELECT {key}, round(sum(greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS bm25
  FROM tf JOIN df USING (term), st GROUP BY {key} HAVING sum(f) > 0)"""
