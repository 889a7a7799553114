"""Composed searches: chunks, insertion points, conversations, commits, checkpoints, annotations; the stored index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import conversations as cv
from ..operators import history as hs
from ..operators import memory as mm
from ..operators import retrieval as rt
from ..runtime import shared_dir
from ..sources.store import SnapshotStore
from .registry import COMMIT_FILES, COMMITS, bm25_sql, commit_files, commits, query, table
from .retrieval import _IN_PATH, _IN_STEM, _SPLIT, _STEM, _TEST, BOOST_QUERY, IMPORTERS, L2, TERMS, WEIGHT

TOP = 10

# documents as chunks of code: four make a file, the first of them stands for the whole of it (chunk_index -1)
CHUNKS = """chunks AS (SELECT doc_id AS id, doc_id // 4 AS file_id, 'src' || (doc_id // 4 % 9) || '/en/' || CASE doc_id // 4 % 7 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/' ELSE '' END || 'doc_' || (doc_id // 4)
  || CASE WHEN doc_id // 4 % 5 = 0 THEN '.md' ELSE '.txt' END AS path, (doc_id % 4 - 1)::BIGINT AS chunk_index, 'fn' || (doc_id % 9) AS entity_name, text AS snippet FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.expr("doc_id div 4")
    folder = F.when(f % 7 == 0, "tests/").when(f % 7 == 1, "src/").otherwise("")
    path = F.concat(F.lit("src"), (f % 9).cast("string"), F.lit("/en/"), folder, F.lit("doc_"), f.cast("string"), F.when(f % 5 == 0, ".md").otherwise(".txt"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), f.alias("file_id"), path.alias("path"), (F.col("doc_id") % 4 - 1).alias("chunk_index"), F.concat(F.lit("fn"), (F.col("doc_id") % 9).cast("string")).alias("entity_name"), F.col("text").alias("snippet"))


def first_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.orderBy("vec_id").limit(1).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


Q = "q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


def _lists(spark, sf_dir, k):
    c = chunks(spark, sf_dir)
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(c.select("id"), "id", "left_semi")
    near = rt.knn(v, first_vector(spark, sf_dir), k).select("id", "rank", F.col("score").alias("vector_score"))
    words = rt.bm25(c, TERMS, "id", "snippet", k=k).select("id", "rank")
    at = c.select("id", "path", "chunk_index", "entity_name", "snippet")
    return near.join(at, "id"), words.join(at, "id")


def _lists_sql(k: int) -> str:
    return f"""{CHUNKS}, {Q}, {bm25_sql(TERMS, 'chunks', 'id', 'snippet')},
d AS (SELECT vec_id AS id, round({L2}, 9) AS distance FROM embeddings v, q WHERE vec_id IN (SELECT id FROM chunks)),
va AS (SELECT id, path, chunk_index, 1 / (1 + distance) AS vector_score, row_number() OVER (ORDER BY distance, id) AS rank FROM d JOIN chunks USING (id) QUALIFY rank <= {k}),
ta AS (SELECT id, path, chunk_index, row_number() OVER (ORDER BY bm25 DESC, id) AS rank FROM bm JOIN chunks USING (id) QUALIFY rank <= {k})"""


MULTIPLIER = f"CASE WHEN {_TEST} THEN 0.85 ELSE 1.0 END * CASE WHEN contains(path, '/tests/') THEN 0.75 ELSE (1 + 0.1 * ({_IN_STEM})) * (1 + 0.05 * ({_IN_PATH})) END"
RRF = f"coalesce({WEIGHT} * 60 / (60 + v.rank - 1), 0) + coalesce({1 - WEIGHT} * 60 / (60 + t.rank - 1), 0)"


def _scored_sql(k: int, leaf: bool, boost: float, least: float) -> str:
    pick = "WHERE chunk_index <> -1" if leaf else ""
    return f"""{_lists_sql(4 * k)}, {IMPORTERS},
v AS (SELECT id, path, chunk_index, vector_score, row_number() OVER (ORDER BY rank) AS rank FROM va {pick}), t AS (SELECT id, path, chunk_index, row_number() OVER (ORDER BY rank) AS rank FROM ta {pick}),
pv AS (SELECT id, path, row_number() OVER (ORDER BY rank) AS rank FROM va WHERE chunk_index = -1), pt AS (SELECT id, path, row_number() OVER (ORDER BY rank) AS rank FROM ta WHERE chunk_index = -1),
pb AS (SELECT path, {RRF} AS blob FROM pv v FULL JOIN pt t USING (id, path)),
fu AS (SELECT path, chunk_index, round({RRF}, 12) AS score, v.vector_score, t.rank AS trank FROM v FULL JOIN t USING (id, path, chunk_index)),
ok AS (SELECT * FROM fu WHERE trank IS NOT NULL OR vector_score IS NULL OR greatest(-1, least(1, 1 - (1 / vector_score - 1) * (1 / vector_score - 1) / 2)) >= {least}),
sc AS (SELECT path, chunk_index, round(score * {MULTIPLIER} + 0.05 * log2(coalesce(importers, 0) + 1) + CASE WHEN chunk_index <> -1 THEN coalesce(blob, 0) * {boost} ELSE 0 END, 9) AS score
  FROM ok LEFT JOIN imp ON imp.file_id = regexp_extract(path, 'doc_(\\d+)', 1)::BIGINT LEFT JOIN pb USING (path))"""


def _expanded_sql(source: str, k: int) -> str:
    return f"""r AS (SELECT *, row_number() OVER (ORDER BY score DESC, path, chunk_index) AS rank, regexp_matches(path, '(?i)\\.(md|mdx)$')::INT AS doc FROM {source}),
h AS (SELECT coalesce(sum(doc), 0) AS docs, count(*) AS n FROM r WHERE rank <= {k}), cc AS (SELECT r.*, coalesce(sum(1 - doc) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS codes FROM r),
ex AS (SELECT cc.* FROM cc, h WHERE rank <= {k} OR (docs > 0 AND docs < n AND rank <= {2 * k} AND codes < {k}))"""


def _importers(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("file_id")).agg(F.count(F.lit(1)).alias("importers"))
    return n.join(chunks(spark, sf_dir).select("file_id", "path").distinct(), "file_id").select("path", "importers")


# a symbol that the search names: its chunks are injected where they aren't found
@query(f"""WITH {_scored_sql(TOP, True, 0.3, 0.3)}, sy AS (SELECT path, chunk_index FROM chunks WHERE entity_name = 'fn7' AND file_id < 12 AND chunk_index <> -1),
al AS (SELECT * FROM sc UNION ALL SELECT path, chunk_index, 0.75 FROM sy WHERE (path, chunk_index) NOT IN (SELECT (path, chunk_index) FROM sc)), {_expanded_sql('al', TOP)},
l AS (SELECT *, lag(score) OVER (ORDER BY rank) AS p FROM ex), x AS (SELECT coalesce(min(rank) FILTER (WHERE rank > 1 AND (p - score) / p <= 0.15), max(rank) + 1) AS stop FROM l), y AS (SELECT score AS anchor FROM ex, x WHERE rank = stop - 1)
SELECT path, chunk_index, round(score, 6) AS score, rank::INTEGER AS rank FROM ex, y WHERE score >= anchor * 0.5""")
def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, words = _lists(spark, sf_dir, 4 * TOP)
    named = chunks(spark, sf_dir).where("entity_name = 'fn7' and file_id < 12").select("path", "chunk_index")
    out = rt.chunk_search(near, words, BOOST_QUERY, TOP, WEIGHT, 0.3, True, 0.3, 0.5, importers=_importers(spark, sf_dir), generated=["tests/**"], symbols=named)
    return out.select("path", "chunk_index", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_scored_sql(3 * TOP, False, 0.0, 0.3)}, {_expanded_sql('sc', 3 * TOP)}, b AS (SELECT path, arg_max(chunk_index, (score, -chunk_index)) AS chunk_index, max(score) AS score FROM ex GROUP BY 1)
SELECT path, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, path)::INTEGER AS rank, 'after ' || entity_name AS after, trim(substr(snippet, greatest(length(snippet) - 149, 1), 150), ' ') AS anchor
FROM b JOIN chunks USING (path, chunk_index) QUALIFY rank <= {TOP}""")
def write_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, words = _lists(spark, sf_dir, 12 * TOP)
    found = rt.chunk_search(near, words, BOOST_QUERY, 3 * TOP, WEIGHT, 0.3, leaf_only=False, importers=_importers(spark, sf_dir), generated=["tests/**"])
    return rt.insertion_points(found, TOP).withColumn("score", F.round("score", 6))


@query(f"WITH {_scored_sql(TOP, False, 0.0, 0.0)} SELECT path, chunk_index, round(score, 6) AS score FROM sc WHERE score >= 0.4")
def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, words = _lists(spark, sf_dir, 4 * TOP)
    stages: dict = {}
    rt.chunk_search(near, words, BOOST_QUERY, TOP, WEIGHT, -1.0, leaf_only=False, importers=_importers(spark, sf_dir), generated=["tests/**"], trace=stages)
    return rt.score_gate(stages["scored"], 0.4).select("path", "chunk_index", F.round("score", 6).alias("score"))


@query(f"WITH {_lists_sql(40)} SELECT path, chunk_index, row_number() OVER (ORDER BY rank)::INTEGER AS rank FROM va WHERE chunk_index <> -1")
def leaf_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.leaves_only(_lists(spark, sf_dir, 40)[0]).select("path", "chunk_index", "rank")


# identifiers are indexed with their parts
PARTS_SQL = f"array_to_string(list_distinct(flatten(list_filter(list_transform(list_filter(regexp_extract_all(html, '[A-Za-z_$][A-Za-z0-9_$]*(?:\\.[A-Za-z_$][A-Za-z0-9_$]*)*'), lambda t: length(t) <= 80), lambda t: list_transform({_SPLIT.format('t')}, lambda x: lower(x))), lambda p: len(p) > 1))), ' ')"


@query(f"""WITH src AS (SELECT page_id, html || ' ' || {PARTS_SQL} AS text FROM pages), {bm25_sql('item page the site', 'src', 'page_id', 'text')}
SELECT page_id, round(bm25, 6) AS bm25, row_number() OVER (ORDER BY bm25 DESC, page_id)::INTEGER AS rank FROM bm QUALIFY rank <= 20""")
def bm25_with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.bm25(table(spark, sf_dir, "pages"), "item page the site", "page_id", "html", k=20, parts=True).withColumn("bm25", F.round("bm25", 6))


@query(f"""WITH {bm25_sql(TERMS, 'documents', 'doc_id', 'text')}
SELECT doc_id, round(bm25, 6) AS bm25, row_number() OVER (ORDER BY bm25 DESC, doc_id)::INTEGER AS rank FROM bm QUALIFY rank <= 20""")
def bm25_from_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = SnapshotStore(spark, f"{shared_dir(spark)}/larkspur/index-{uuid.uuid4().hex}")
    index = rt.TextIndex(store, "postings", "doc_id").build(table(spark, sf_dir, "documents"))
    return rt.top(index.scores(TERMS), 20, "doc_id").withColumn("bm25", F.round("bm25", 6))


# messages of conversations as chunks of turns, each with one of the vectors
TALK = """nv AS (SELECT max(vec_id) + 1 AS n FROM embeddings), ev AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ti FROM conversations),
talk AS (SELECT conv_id * 1000 + turn AS id, conv_id * 1000 + ti::BIGINT AS turn_id, conv_id AS session_id, text, (conv_id * 7 + turn) % n AS vec_id FROM ev, nv WHERE ti >= 0)"""


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    w = Window.partitionBy("conv_id").orderBy("turn")
    e = table(spark, sf_dir, "conversations").withColumn("ti", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w) - 1).where("ti >= 0")
    return e.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") * 1000 + F.col("ti")).alias("turn_id"), F.col("conv_id").alias("session_id"), "text", ((F.col("conv_id") * 7 + F.col("turn")) % n).alias("vec_id"))


SAID = "the of and you"


@query(f"""WITH {TALK}, {Q}, {bm25_sql(SAID, 'talk', 'id', 'text')}, d AS (SELECT id, turn_id, round({L2}, 9) AS distance FROM talk JOIN embeddings v USING (vec_id), q),
va AS (SELECT id, turn_id, row_number() OVER (ORDER BY distance, id) AS rank FROM d QUALIFY rank <= 15), ta AS (SELECT id, turn_id, row_number() OVER (ORDER BY bm25 DESC, id) AS rank FROM bm JOIN talk USING (id) QUALIFY rank <= 15),
v AS (SELECT turn_id, row_number() OVER (ORDER BY best) AS rank FROM (SELECT turn_id, min(rank) AS best FROM va GROUP BY 1) QUALIFY rank <= 5), t AS (SELECT turn_id, row_number() OVER (ORDER BY best) AS rank FROM (SELECT turn_id, min(rank) AS best FROM ta GROUP BY 1) QUALIFY rank <= 5)
SELECT turn_id, round({RRF}, 6) AS score, row_number() OVER (ORDER BY round({RRF}, 12) DESC, turn_id)::INTEGER AS rank FROM v FULL JOIN t USING (turn_id) QUALIFY row_number() OVER (ORDER BY round({RRF}, 12) DESC, turn_id) <= 5""")
def search_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = talk(spark, sf_dir)
    v = c.join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    at = c.select("id", "turn_id", "session_id")
    near = rt.knn(v, first_vector(spark, sf_dir), 15).join(at, "id")
    words = rt.bm25(c, SAID, "id", k=15).join(at, "id")
    return cv.search_turns(near, words, 5).withColumn("score", F.round("score", 6))


HISTORY = f"{COMMITS}, {COMMIT_FILES}, nv AS (SELECT max(vec_id) + 1 AS n FROM embeddings), cs AS (SELECT commit_id, list(file_path) AS fs FROM commit_files GROUP BY 1)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    files = commit_files(spark, sf_dir).groupBy("commit_id").agg(F.sort_array(F.collect_list("file_path")).alias("files_changed"))
    c = commits(spark, sf_dir).join(files, "commit_id").withColumn("summary", F.lit(None).cast("string")).withColumn("vec_id", F.col("commit_id") % n)
    return c.join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "left").drop("vec_id")


@query(f"""WITH {HISTORY}, hc AS (SELECT commits.*, message AS text, commit_id % n AS vec_id FROM commits JOIN cs USING (commit_id), nv), {Q}, {bm25_sql('urgent 2 high', 'hc', 'commit_id', 'text')},
fc AS (SELECT commit_id FROM hc JOIN cs USING (commit_id) WHERE contains(lower(author), '00') AND substr(date, 1, 4) >= '1995' AND len(list_filter(fs, lambda f: contains(f, 'part_1'))) > 0),
d AS (SELECT commit_id, round({L2}, 9) AS distance FROM hc JOIN embeddings v USING (vec_id), q WHERE commit_id IN (SELECT commit_id FROM fc)),
v AS (SELECT commit_id, 1 / (1 + distance) AS vector_score, row_number() OVER (ORDER BY distance, commit_id) AS rank FROM d QUALIFY rank <= 10),
t AS (SELECT commit_id, row_number() OVER (ORDER BY bm25 DESC, commit_id) AS rank FROM bm WHERE commit_id IN (SELECT commit_id FROM fc) QUALIFY rank <= 10),
o AS (SELECT commit_id, round({RRF}, 12) AS score FROM v FULL JOIN t USING (commit_id) WHERE t.rank IS NOT NULL OR vector_score IS NULL OR greatest(-1, least(1, 1 - (1 / vector_score - 1) * (1 / vector_score - 1) / 2)) >= 0.1)
SELECT commit_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, commit_id)::INTEGER AS rank FROM o QUALIFY rank <= 10""")
def search_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hs.search_commits(history(spark, sf_dir), first_vector(spark, sf_dir), "urgent 2 high", 10, WEIGHT, 0.1, author="00", since="1995", path="part_1")
    return out.withColumn("score", F.round("score", 6))


# orders as checkpoints, each with one of the vectors
POINTS = """nv AS (SELECT max(vec_id) + 1 AS n FROM embeddings), cp AS (SELECT o_orderkey AS checkpoint_id, o_custkey AS session_id, strftime(o_orderdate, '%Y-%m-%d') AS timestamp,
  CASE o_orderkey % 6 WHEN 0 THEN 'decision' WHEN 1 THEN 'milestone' WHEN 2 THEN 'blocker' WHEN 3 THEN 'direction_change' WHEN 4 THEN 'handoff' ELSE 'other' END AS type, o_orderpriority AS title, o_orderkey % n AS vec_id FROM orders, nv)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    kind = F.element_at(F.array(*[F.lit(x) for x in (*mm.KINDS, "other")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("session_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"), kind.alias("type"), F.col("o_orderpriority").alias("title"), (F.col("o_orderkey") % n).alias("vec_id"))
    return mm.checkpoint(c).withColumn("checkpoint_id", F.col("order"))


@query(f"WITH {POINTS} SELECT checkpoint_id, timestamp, title FROM cp WHERE type = 'blocker' ORDER BY timestamp DESC, checkpoint_id LIMIT 20")
def checkpoint_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mm.list_checkpoints(points(spark, sf_dir), kind="blocker").select("checkpoint_id", "timestamp", "title")


@query(f"""WITH {POINTS}, {Q}, d AS (SELECT checkpoint_id, round({L2}, 9) AS distance FROM cp JOIN embeddings v USING (vec_id), q WHERE type = 'decision')
SELECT checkpoint_id, round(1 / (1 + distance), 6) AS score, row_number() OVER (ORDER BY distance, checkpoint_id)::INTEGER AS rank FROM d QUALIFY rank <= 5""")
def checkpoint_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = points(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    return mm.search_checkpoints(c, first_vector(spark, sf_dir), "decision").select("checkpoint_id", F.round("score", 6).alias("score"), "rank")


# documents as notes on the files of chunks
NOTES = """notes AS (SELECT doc_id AS annotation_id, 'src' || (doc_id % 9) || '/en/doc_' || (doc_id % 60) || '.txt' AS path, CASE WHEN doc_id % 4 <> 0 THEN 'fn' || (doc_id % 3) END AS symbol_name, source AS note, doc_id AS created_at, doc_id + n_chars AS updated_at FROM documents)"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    path = F.concat(F.lit("src"), (i % 9).cast("string"), F.lit("/en/doc_"), (i % 60).cast("string"), F.lit(".txt"))
    return d.select(i.alias("annotation_id"), path.alias("path"), F.when(i % 4 != 0, F.concat(F.lit("fn"), (i % 3).cast("string"))).alias("symbol_name"), F.col("source").alias("note"), i.alias("created_at"), (i + F.col("n_chars")).alias("updated_at"))


@query(f"WITH {NOTES} SELECT annotation_id, note FROM notes WHERE (path = 'en/doc_7.txt' OR path LIKE '%/en/doc\\_7.txt' ESCAPE '\\') AND symbol_name = 'fn1'")
def annotation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mm.list_annotations(notes(spark, sf_dir), "en/doc_7.txt", "fn1").select("annotation_id", "note")


@query(f"""WITH {NOTES}, {Q}, d AS (SELECT annotation_id, round({L2}, 9) AS distance FROM notes JOIN embeddings v ON v.vec_id = annotation_id, q)
SELECT annotation_id, round(1 / (1 + distance), 6) AS score, row_number() OVER (ORDER BY distance, annotation_id)::INTEGER AS rank FROM d QUALIFY rank <= 10""")
def annotation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("annotation_id"), "embedding"), "annotation_id")
    return mm.search_annotations(n, first_vector(spark, sf_dir)).select("annotation_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {NOTES} SELECT annotation_id, path, coalesce(symbol_name, '') AS symbol_name FROM notes WHERE NOT ((path = 'src7/en/doc_7.txt' AND symbol_name IS NOT DISTINCT FROM 'fn1') OR (path = 'src8/en/doc_8.txt' AND symbol_name IS NULL))")
def annotation_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([("src7/en/doc_7.txt", "fn1"), ("src8/en/doc_8.txt", None)], "path string, symbol_name string")
    return mm.delete_annotations(notes(spark, sf_dir), gone).select("annotation_id", "path", F.coalesce("symbol_name", F.lit("")).alias("symbol_name"))


@query(f"""WITH {CHUNKS}, {NOTES} SELECT c.path, chunk_index, count(note) AS n_notes, coalesce(string_agg(coalesce(symbol_name, '') || ':' || note, ',' ORDER BY created_at), '') AS notes
FROM chunks c LEFT JOIN notes n ON n.path = c.path AND (symbol_name IS NULL OR symbol_name = entity_name) GROUP BY 1, 2""")
def annotated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = mm.annotated(chunks(spark, sf_dir).select("path", "chunk_index", "entity_name"), notes(spark, sf_dir))
    shown = F.array_join(F.transform("notes", lambda x: F.concat(F.coalesce(x["symbol_name"], F.lit("")), F.lit(":"), x["note"])), ",")
    return a.select("path", "chunk_index", F.size("notes").cast("long").alias("n_notes"), shown.alias("notes"))


@query(f"""WITH {TALK}, o AS (SELECT turn_id, string_agg(text, chr(0) ORDER BY id) AS t FROM talk WHERE id % 5 <> 0 GROUP BY 1), f AS (SELECT turn_id, string_agg(text, chr(0) ORDER BY id) AS t FROM talk GROUP BY 1)
SELECT turn_id, f.t IS DISTINCT FROM o.t AS changed FROM f LEFT JOIN o USING (turn_id)""")
def changed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = talk(spark, sf_dir).select("turn_id", F.col("id").alias("chunk_index"), F.col("text").alias("snippet"))
    return cv.changed_turns(c.where("chunk_index % 5 <> 0"), c)


@query(f"""WITH {TALK} SELECT turn_id, coalesce(string_agg(CASE WHEN id % 2 = 0 THEN text END, chr(10) ORDER BY id), '') AS user_text, len(string_split(coalesce(string_agg(text, chr(10) ORDER BY id), ''), chr(10)))::INTEGER AS n_lines,
concat_ws(chr(10) || chr(10), CASE WHEN count(CASE WHEN id % 2 = 0 AND text <> '' THEN 1 END) > 0 THEN 'User: ' || string_agg(CASE WHEN id % 2 = 0 THEN text END, chr(10) ORDER BY id) END, CASE WHEN count(CASE WHEN id % 2 = 1 AND text <> '' THEN 1 END) > 0 THEN 'Assistant: ' || string_agg(CASE WHEN id % 2 = 1 THEN text END, chr(10) ORDER BY id) END) AS shown FROM talk GROUP BY 1""")
def turn_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda k: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["id"] % 2 == k), lambda x: x["text"]), "\n")
    t = talk(spark, sf_dir).groupBy("turn_id").agg(side(0).alias("user_text"), side(1).alias("other"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n").alias("all"))
    return t.select("turn_id", "user_text", F.size(F.split("all", "\n")).alias("n_lines"), tx.turn_text(F.col("user_text"), F.col("other"), F.array().cast("array<string>")).alias("shown"))
