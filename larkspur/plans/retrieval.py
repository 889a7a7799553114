"""Retrieval queries: BM25, kNN, fusion, boosts, list shaping, text and path functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import retrieval as rt
from .registry import COMMIT_FILES, COMMITS, FILES, LINES, bm25_sql, commit_files, commits, files, lines, query, table

TERMS = "the of erst and"
L2 = "sqrt(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))))"
# Fixed values of these queries: the search's words, its weight and its list lengths.
WEIGHT, TOP = 0.5, 20


@query(f"""WITH {bm25_sql(TERMS, 'documents', 'doc_id', 'text')}
SELECT doc_id, round(bm25, 6) AS bm25, row_number() OVER (ORDER BY bm25 DESC, doc_id)::INTEGER AS rank FROM bm QUALIFY rank <= 20""")
def bm25_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.bm25(table(spark, sf_dir, "documents"), TERMS, "doc_id", k=20).withColumn("bm25", F.round("bm25", 6))


def first_vectors(spark, sf_dir):
    """One query vector a label: that of its least vec_id."""
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query"), F.min("vec_id").alias("query_id")).select("query_id", "query")


KNN_SQL = f"""q AS (SELECT min(vec_id) AS query_id, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label),
d AS (SELECT query_id, vec_id, round({L2}, 9) AS distance FROM embeddings v, q),
knn AS (SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM d)"""


@query(f"WITH {KNN_SQL} SELECT query_id, vec_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score, rank FROM knn WHERE rank <= 10")
def knn_top10_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rt.knn(table(spark, sf_dir, "embeddings"), first_vectors(spark, sf_dir), 10, "vec_id")
    return out.withColumn("distance", F.round("distance", 6)).withColumn("score", F.round("score", 6))


@query(f"""WITH {KNN_SQL}, s AS (SELECT query_id, vec_id, 1 / (1 + distance) AS score FROM knn)
SELECT query_id, vec_id, round(score, 6) AS score, round(greatest(-1, least(1, 1 - (1 / score - 1) * (1 / score - 1) / 2)), 5) AS cosine FROM s""")
def score_to_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings").join(F.broadcast(first_vectors(spark, sf_dir)), how="cross")
    d = d.select("query_id", "vec_id", vx.distance_score(F.round(vx.l2_distance("embedding", "query"), 9)).alias("score"))
    return d.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.round(vx.score_cosine("score"), 5).alias("cosine"))


def _lists(spark, sf_dir, k=4 * TOP):
    """The vector and the keyword list of one hybrid search over files (a vector belongs to the file of its id)."""
    f = files(spark, sf_dir)
    q = first_vectors(spark, sf_dir).orderBy("query_id").limit(1)
    near = rt.knn(table(spark, sf_dir, "embeddings").join(f, F.col("vec_id") == F.col("file_id"), "left_semi"), q, k, "vec_id").select(F.col("vec_id").alias("file_id"), "rank", F.col("score").alias("vector_score"))
    words = rt.bm25(f, TERMS, "file_id", k=k).select("file_id", "rank")
    return near, words


def _fused(spark, sf_dir):
    near, words = _lists(spark, sf_dir)
    out = rt.rrf(near, words, WEIGHT, ["file_id"]).join(files(spark, sf_dir).select("file_id", "path"), "file_id")
    return out.withColumn("score", F.round("score", 12))


FUSED = f"""{FILES}, {bm25_sql(TERMS, 'files', 'file_id', 'text')},
q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM (SELECT min(vec_id) AS vec_id FROM embeddings GROUP BY label))),
nd AS (SELECT vec_id AS file_id, round({L2}, 9) AS distance FROM embeddings v, q WHERE vec_id IN (SELECT file_id FROM files)),
a AS (SELECT file_id, distance, row_number() OVER (ORDER BY distance, file_id) AS ra FROM nd QUALIFY ra <= {4 * TOP}),
b AS (SELECT file_id, row_number() OVER (ORDER BY bm25 DESC, file_id) AS rb FROM bm QUALIFY rb <= {4 * TOP}),
fused AS (SELECT file_id, path, ra, rb, 1 / (1 + distance) AS vector_score,
  round(coalesce({WEIGHT} * 60 / (60 + ra - 1), 0) + coalesce({1 - WEIGHT} * 60 / (60 + rb - 1), 0), 12) AS score FROM a FULL JOIN b USING (file_id) JOIN files USING (file_id))"""


@query(f"WITH {FUSED} SELECT file_id, path, round(score, 6) AS score FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("file_id", "path", F.round("score", 6).alias("score"))


COSINE_SQL = "greatest(-1, least(1, 1 - (1 / vector_score - 1) * (1 / vector_score - 1) / 2))"


@query(f"WITH {FUSED} SELECT file_id, round(score, 6) AS score FROM fused WHERE rb IS NOT NULL OR vector_score IS NULL OR {COSINE_SQL} >= 0.3")
def cosine_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fused(spark, sf_dir).withColumn("cosine", vx.score_cosine("vector_score"))
    return rt.cosine_gate(f, 0.3).select("file_id", F.round("score", 6).alias("score"))


# the query's words that may occur in paths: "src", "doc"
BOOST_QUERY = "src9 document doc_12 scheduler"
_W = tx.query_words(BOOST_QUERY)
_STEM = "regexp_replace(lower(regexp_extract(path, '[^/]*$')), '(.)[.][^.]*$', '\\1')"
_IN_STEM = " + ".join(f"(len(list_filter(string_split_regex({_STEM}, '[_-]+'), lambda s: contains(s, '{w}') OR contains('{w}', s))) > 0)::INT" for w in _W)
_FOLDERS = "list_filter(string_split_regex(regexp_replace(lower(path), '/[^/]*$', ''), '[/_.-]+'), lambda s: length(s) >= 3)"
_IN_PATH = " + ".join(f"(len(list_filter({_FOLDERS}, lambda s: contains(s, '{w}'))) > 0)::INT" for w in _W)
_TEST = "regexp_matches(path, '(?i)(^|[/\\\\])tests?[/\\\\]|(^|[/\\\\])__tests__[/\\\\]|(^|[/\\\\])spec[/\\\\]|\\.(test|spec)\\.[^/\\\\]+$|(^|[/\\\\])test_')"
_SOURCE = "regexp_matches(path, '(?i)(^|[/\\\\])(src|lib|app|pkg|packages|internal|cmd)[/\\\\]')"
IMPORTERS = "imp AS (SELECT l_suppkey AS file_id, count(*) AS importers FROM lineitem GROUP BY 1)"
BOOSTED = f"""{FUSED}, {IMPORTERS}, boosted AS (SELECT file_id, path, round(score * CASE WHEN {_TEST} THEN 0.85 WHEN {_SOURCE} THEN 1.1 ELSE 1.0 END
  * CASE WHEN contains(path, '/tests/') THEN 0.75 ELSE 1 + 0.1 * ({_IN_STEM}) + 0.05 * ({_IN_PATH}) END + 0.05 * log2(coalesce(importers, 0) + 1), 9) AS score FROM fused LEFT JOIN imp USING (file_id))"""


def _boosted(spark, sf_dir):
    importers = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("file_id")).agg(F.count(F.lit(1)).alias("importers"))
    f = _fused(spark, sf_dir).join(importers, "file_id", "left")
    score = F.col("score") * rt.path_boost() * rt.affinity_boost(BOOST_QUERY, generated=["tests/**"]) + rt.centrality_boost()
    return f.select("file_id", "path", F.round(score, 9).alias("score"))


@query(f"WITH {BOOSTED} SELECT file_id, path, round(score, 6) AS score FROM boosted")
def boost_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boosted(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"""WITH {BOOSTED}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, file_id) AS rank, regexp_matches(path, '(?i)\\.(md|mdx)$')::INT AS doc FROM boosted),
h AS (SELECT sum(doc) AS docs, count(*) AS n FROM r WHERE rank <= {TOP}),
c AS (SELECT r.*, coalesce(sum(1 - doc) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS codes FROM r)
SELECT file_id, path, rank::INTEGER AS rank FROM c, h WHERE rank <= {TOP} OR (docs > 0 AND docs < n AND rank <= {2 * TOP} AND codes < {TOP})""")
def doc_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.expand_for_docs(rt.ranked(_boosted(spark, sf_dir), "file_id"), TOP).select("file_id", "path", "rank")


@query(f"""WITH {BOOSTED}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, file_id) AS rank FROM boosted), t AS (SELECT * FROM r WHERE rank <= {TOP}),
s AS (SELECT *, lag(score) OVER (ORDER BY rank) AS p FROM t),
x AS (SELECT coalesce(min(rank) FILTER (WHERE rank > 1 AND (p - score) / p <= 0.15), max(rank) + 1) AS stop FROM s),
y AS (SELECT score AS anchor FROM t, x WHERE rank = stop - 1)
SELECT file_id, round(score, 6) AS score, rank::INTEGER AS rank FROM t, y WHERE score >= anchor * 0.85""")
def tail_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = rt.ranked(_boosted(spark, sf_dir), "file_id").where(F.col("rank") <= TOP)
    return rt.tail_cut(top).select("file_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {LINES}, {bm25_sql(TERMS, 'lines', 'chunk_id', 'snippet')}
SELECT path, round(max(bm25), 6) AS score, count(DISTINCT snippet)::INTEGER AS n_snippets FROM bm JOIN lines USING (chunk_id) GROUP BY path""")
def dedup_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lines(spark, sf_dir)
    hits = rt.bm25_scores(c, TERMS, "chunk_id", "snippet").select("chunk_id", F.col("bm25").alias("score")).join(c, "chunk_id")
    return rt.by_file(hits).select("path", F.round("score", 6).alias("score"), F.size("snippets").alias("n_snippets"))


@query(f"""WITH {LINES}, {bm25_sql(TERMS, 'lines', 'chunk_id', 'snippet')}, h AS (SELECT chunk_id, file_id, bm25 FROM bm JOIN lines USING (chunk_id)),
n AS (SELECT file_id, count(*) AS k, max(bm25) AS best FROM h GROUP BY 1)
SELECT chunk_id AS id, file_id AS parent_id, round(bm25, 6) AS score FROM h WHERE file_id IN (SELECT file_id FROM n WHERE k < 3)
UNION ALL SELECT -file_id - 1 AS id, -1 AS parent_id, round(best, 6) FROM n WHERE k >= 3""")
def parent_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lines(spark, sf_dir)
    hits = rt.bm25_scores(c, TERMS, "chunk_id", "snippet").select("chunk_id", F.col("bm25").alias("score")).join(c, "chunk_id")
    parent = (-F.col("file_id") - 1).alias("id")
    # children are shown with their file, parents with none
    return rt.promote_parents(hits.select(F.col("chunk_id").alias("id"), (-F.col("file_id") - 1).alias("parent_id"), "score"), files(spark, sf_dir).select(parent), 3).select("id", F.coalesce(-F.col("parent_id") - 1, F.lit(-1)).alias("parent_id"), F.round("score", 6).alias("score"))


@query(f"""WITH {BOOSTED}, hits AS (SELECT path FROM boosted WHERE file_id % 3 = 0 UNION ALL SELECT path FROM boosted WHERE file_id % 6 = 0 UNION ALL SELECT path FROM files WHERE file_id < 5),
n AS (SELECT path, count(*) AS k FROM hits GROUP BY 1)
SELECT path, round(coalesce(score * power(1.3, coalesce(k, 0)), 0.75 * power(1.3, k - 1)), 6) AS score FROM boosted FULL JOIN n USING (path)""")
def symbol_hit_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boosted(spark, sf_dir)
    hits = b.where("file_id % 3 = 0").select("path").unionAll(b.where("file_id % 6 = 0").select("path")).unionAll(files(spark, sf_dir).where("file_id < 5").select("path"))
    return rt.symbol_boost(b.select("path", "score"), hits).select("path", F.round("score", 6).alias("score"))


@query(f"""WITH {LINES}, c AS (SELECT path, chunk_index, length(snippet) / 1000.0 AS score FROM lines UNION ALL SELECT path, -1, least(length(text) / 5000.0, 1.0) FROM files WHERE file_id % 2 = 0)
SELECT path, c.chunk_index, round(score + CASE WHEN c.chunk_index <> -1 THEN coalesce(0.3 * (SELECT max(p.score) FROM c p WHERE p.chunk_index = -1 AND p.path = c.path), 0) ELSE 0 END, 6) AS score FROM c""")
def parent_blob_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lines(spark, sf_dir).select("path", "chunk_index", (F.length("snippet") / 1000.0).alias("score"))
    p = files(spark, sf_dir).where("file_id % 2 = 0").select("path", F.lit(-1).cast("long").alias("chunk_index"), F.least(F.length("text") / 5000.0, F.lit(1.0)).alias("score"))
    return rt.parent_blob_boost(c.unionByName(p), 0.3).select("path", "chunk_index", F.round("score", 6).alias("score"))


@query(f"""WITH {FILES} SELECT path, {_TEST} AS is_test, {_SOURCE} AS is_source, regexp_matches(path, '(?i)\\.(md|mdx)$') AS is_doc, {_STEM} AS stem,
  regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') AS base FROM files""")
def path_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", tx.is_test("path").alias("is_test"), tx.is_source("path").alias("is_source"), tx.is_doc("path").alias("is_doc"), tx.stem("path").alias("stem"), tx.dirname("path").alias("dir"), tx.basename("path").alias("base"))


@query(f"""WITH {FILES} SELECT path FROM files WHERE (path LIKE '%.md' OR path LIKE '%.rst') AND (path LIKE 'src1/%' OR path LIKE 'src2/%' OR path LIKE 'src0/%') AND NOT path LIKE 'src1/fr/%'""")
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(tx.path_filter("path", [".md", "rst"], ["src1", "src2/", "src0"], ["src1/fr"])).select("path")


@query(f"""WITH {FILES} SELECT path FROM files WHERE (path LIKE '%.md' OR path LIKE 'src3/%' OR regexp_matches(path, '^(.*/)?doc_1[.].*') OR (path LIKE 'src4/%' AND path LIKE '%.txt') OR regexp_matches(path, '^src5/[^/]*/doc_[0-9][.]txt$'))
  AND NOT (contains(path, '/tests/') OR path LIKE 'src6/%' OR regexp_matches(path, '(^|/)doc_7[.][^/]*$') OR path LIKE '%9.md')""")
def glob_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    include = ["**/*.md", "src3/**", "**/doc_1.*", "src4/**/*.txt", "src5/*/doc_?.txt"]
    exclude = ["**/tests/**", "src6/**", "**/doc_7.*", "*9.md"]
    return files(spark, sf_dir).where(tx.included("path", include) & ~tx.excluded("path", exclude)).select("path")


_SPLIT = "list_filter(string_split_regex(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda p: length(p) >= 2)"


@query(f"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '[A-Za-z_$][A-Za-z0-9_$]*(?:\\.[A-Za-z_$][A-Za-z0-9_$]*)*')) AS tok FROM pages),
p AS (SELECT page_id, list_transform({_SPLIT.format('tok')}, lambda x: lower(x)) AS parts FROM t WHERE length(tok) <= 80)
SELECT page_id, coalesce(string_agg(part, ' ' ORDER BY part), '') AS parts FROM (SELECT DISTINCT page_id, unnest(parts) AS part FROM p WHERE len(parts) > 1) GROUP BY 1""")
def identifier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # parts are exploded out of an array of one, so that the filter doesn't make them a second time
    from ..runtime import spread

    p = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.explode(F.array(tx.identifier_parts("html"))).alias("parts")).where(F.size("parts") > 0)
    return p.select("page_id", F.array_join(F.array_sort("parts"), " ").alias("parts"))


@query(f"""WITH {FILES} SELECT path, sha256(text) AS hash, CASE WHEN length(text) > 60000 THEN 'too_large'
  WHEN length(text) * 1.0 / len(string_split(text, chr(10))) > 1000 THEN 'minified' WHEN path LIKE 'src7/%' THEN 'unknown_extension' WHEN NOT regexp_matches(text, '\\S') THEN 'empty' ELSE 'indexed' END AS status FROM files""")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.scan import admission_status

    f = files(spark, sf_dir).withColumn("known", ~F.col("path").startswith("src7/"))
    return f.select("path", tx.content_hash("text").alias("hash"), admission_status(F.col("text"), F.length("text"), F.col("known"), max_size=60000).alias("status"))


@query(f"""WITH {COMMITS}, {COMMIT_FILES}, l AS (SELECT commit_id, list(file_path ORDER BY file_path) AS fs FROM commit_files GROUP BY 1)
SELECT commit_id, message || chr(10) || 'Files changed: ' || array_to_string(fs, ', ') || chr(10) || 'Directories: lib' AS text,
  array_to_string(fs[1:3], chr(10)) || CASE WHEN len(fs) > 3 THEN chr(10) || '... and ' || (len(fs) - 3) || ' more files' ELSE '' END AS summary FROM commits JOIN l USING (commit_id)""")
def commit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = commit_files(spark, sf_dir).groupBy("commit_id").agg(F.sort_array(F.collect_list("file_path")).alias("fs"))
    return commits(spark, sf_dir).join(l, "commit_id").select("commit_id", tx.commit_embed_text(F.col("message"), F.col("fs")).alias("text"), tx.diff_summary(F.col("fs"), 3).alias("summary"))


@query("""WITH u AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i)
SELECT label, i::INTEGER AS i, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS x FROM u""")
def merge_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = vx.merge_embeddings(table(spark, sf_dir, "embeddings"), "label")
    return m.select("label", F.posexplode("embedding").alias("i", "x")).select("label", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))
