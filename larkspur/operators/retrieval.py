"""Hybrid retrieval: exact kNN, BM25, rank fusion, boosts, list shaping. Ranks are columns, orders total."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.vectors import distance_score, l2_distance, score_cosine
from ..runtime import ship, spread, stored

K = 60
#: Constants of the usual BM25.
K1, B = 1.2, 0.75
#: Up to so many queries are sent to all vectors; more are taken in blocks of BLOCK.
FEW, BLOCK = 2_000, 1024


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, distance, score, rank) of the k nearest by L2. ``queries``: query_id, query (vector).

    Every vector meets every query: a few queries are sent to all vectors, more in blocks, each a pass over the
    vectors that keeps k rows a query and task. Per-query limits apply before the shuffle (window group limit)."""
    if queries.limit(FEW + 1).count() <= FEW:
        d = vectors.crossJoin(F.broadcast(queries)).select("query_id", key, F.round(l2_distance(vector, "query"), 9).alias("distance"))
    else:
        d = _nearest_in_blocks(vectors, queries, k, key, vector)
    w = Window.partitionBy("query_id").orderBy("distance", key)
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", key, "distance", distance_score(F.col("distance")).alias("score"), "rank")


def _nearest_in_blocks(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """(query_id, key, distance): k candidates a query and Arrow batch at least, ties aside; numeric keys. Queries come
    to the driver a block at a time."""
    ship(vectors.sparkSession)
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("distance", T.DoubleType())])
    rows, out = iter(queries.select("query_id", "query").toLocalIterator(prefetchPartitions=True)), []
    while block := list(itertools.islice(rows, BLOCK)):
        ids, q = [r.query_id for r in block], np.array([r.query for r in block], np.float64)

        def run(batches, ids=ids, q=q):
            squares = (q * q).sum(1)
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    b = whole.slice(at, 4096)
                    x = np.asarray(pc.list_flatten(b.column(1)), np.float64).reshape(b.num_rows, -1)
                    near = squares[:, None] + (x * x).sum(1) - 2 * (q @ x.T)
                    # some more than k by the fast formula, then the exact distance
                    n = min(k + 16, b.num_rows)
                    pick = np.argpartition(near, n - 1, 1)[:, :n]
                    exact = np.sqrt(((q[:, None] - x[pick]) ** 2).sum(2))
                    yield pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(np.repeat(np.arange(len(q)), n))), b.column(0).take(pa.array(pick.ravel())), pa.array(np.round(exact.ravel(), 9))], names=schema.names)

        out.append(vectors.select(key, vector).mapInArrow(run, schema))
    for d in out[1:]:
        out[0] = out[0].unionByName(d)
    return out[0]


def index_tokens(text: str = "text", parts: bool = False) -> Column:
    """What the keyword index holds of a text: its words and, with ``parts``, after a gap that no phrase crosses, the
    parts of its identifiers."""
    words = tx.word_tokens(text)
    return F.concat(words, F.array(F.lit("")), tx.word_tokens(F.array_join(tx.identifier_parts(text), " "))) if parts else words


def _phrases(query: str) -> list[list[str]]:
    return list(map(list, dict.fromkeys(map(tuple, tx.query_phrases(query)))))


def _scores(tf: DataFrame, key: str, phrases: list[list[str]], n: int, avgdl: float) -> DataFrame:
    """(key, bm25) from tf (key, dl, f0, ...: how often each phrase occurs)."""
    found = tf.agg(*(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(phrases)))).first()

    def part(i: int) -> Column:
        idf = F.greatest(F.log((F.lit(float(n)) - found[i] + 0.5) / (F.lit(float(found[i])) + 0.5)), F.lit(1e-6))
        f = F.col(f"f{i}").cast("double")
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / avgdl))

    return tf.where(sum(F.col(f"f{i}") for i in range(len(phrases))) > 0).select(key, F.round(sum(part(i) for i in range(len(phrases))), 9).alias("bm25"))


def bm25_scores(docs: DataFrame, query: str, key: str = "id", text: str = "text", parts: bool = False) -> DataFrame:
    """(key, bm25) of documents that hold one of the query's phrases; a phrase's score is that of a term.

    A phrase of one word counts its term in the token array; longer ones count adjacent matches by position. Texts
    are read and cut into tokens once: a row of a few numbers a document is stored, from which both the totals and
    the scores are made. For many queries on the same texts use TextIndex."""
    phrases = _phrases(query)
    if not phrases:
        return docs.where(F.lit(False)).select(key, F.lit(0.0).alias("bm25"))
    words = F.col("tokens")

    def count(p: list[str]) -> Column:
        if len(p) == 1:
            return F.size(F.filter(words, lambda t: t == p[0]))
        last = F.size(words) - len(p)
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(starts, lambda i: F.slice(words, i + 1, len(p)) == F.array(*map(F.lit, p))))

    # an exploded array of one keeps Spark from making the tokens again for each use
    tokens = spread(docs.select(key, text)).select(key, F.explode(F.array(index_tokens(text, parts))).alias("tokens"))
    tf = stored(tokens.select(key, (F.size(words) - int(parts)).alias("dl"), *(count(p).alias(f"f{i}") for i, p in enumerate(phrases))))
    n, avgdl = tf.agg(F.count(F.lit(1)), F.avg("dl")).first()
    return _scores(tf, key, phrases, n, avgdl or 1.0)


def top(scores: DataFrame, k: int, key: str, score: str = "bm25") -> DataFrame:
    """The k best with their rank from 1, ties by key: a bounded list."""
    best = scores.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def bm25(docs: DataFrame, query: str, key: str = "id", text: str = "text", k: int = 20, parts: bool = False) -> DataFrame:
    """(key, bm25, rank) of the k best documents."""
    return top(bm25_scores(docs, query, key, text, parts), k, key)


def _postings(batches, names: list[str], gap: int):
    """(key, dl, term, positions) of each document and term, in that order, from batches of (key, tokens); without ""."""
    for whole in batches:
        start = 0
        while start < whole.num_rows:
            # as many rows as have some 500,000 tokens together, one at least
            sizes = np.asarray(pc.fill_null(pc.list_value_length(whole.column(1).slice(start)), 0), np.int64)
            rows = max(1, int(np.searchsorted(sizes.cumsum(), 500_000, "right")))
            b, sizes, start = whole.slice(start, rows), sizes[:rows], start + rows
            doc = np.repeat(np.arange(b.num_rows), sizes)
            pos = np.arange(len(doc)) - np.repeat(sizes.cumsum() - sizes, sizes)
            coded = pc.dictionary_encode(pc.list_flatten(b.column(1)))
            code = np.asarray(coded.indices, np.int64)
            held = np.flatnonzero(np.asarray(pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False), bool)[code]) if len(code) else np.arange(0)
            # a stable order by document and term keeps positions in order
            order = held[np.lexsort((code[held], doc[held]))]
            doc, code, pos = doc[order], code[order], pos[order]
            first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])]) if len(doc) else np.arange(0)
            ends = pa.array(np.r_[first, len(doc)].astype(np.int32))
            at = pa.array(doc[first])
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array((sizes - gap)[doc[first]].astype(np.int32)), coded.dictionary.take(pa.array(code[first])), pa.ListArray.from_arrays(ends, pa.array(pos.astype(np.int32)))], names=names)


class TextIndex:
    """Postings in a snapshot store: (term, key, positions, dl), in folders by the term's hash, so that a search reads
    the folders of its terms only, and of these the row groups that hold them."""

    BUCKETS = 32

    def __init__(self, store, name: str, key: str):
        self.store, self.name, self.key = store, name, key

    @classmethod
    def _bucket(cls) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(cls.BUCKETS)).cast("int")

    def build(self, docs: DataFrame, text: str = "text", parts: bool = False) -> TextIndex:
        """Indexes all of ``docs``. Postings are made where the text is read, so that no word's occurrences are shuffled and
        a word that all documents have stays spread over tasks."""
        key, gap = self.key, int(parts)
        ship(docs.sparkSession)
        tokens = spread(docs.select(key, text)).select(key, index_tokens(text, parts).alias("tokens"))
        schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("dl", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
        self.store.commit_buckets(self.name, tokens.mapInArrow(lambda batches: _postings(batches, schema.names, gap), schema), self._bucket(), list(range(self.BUCKETS)), "term")
        lengths = docs.select(key, F.explode(F.array(F.size(index_tokens(text, parts)) - int(parts))).alias("dl"))
        self.store.commit(**{f"{self.name}_totals": lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))})
        return self

    def scores(self, query: str) -> DataFrame | None:
        """(key, bm25) of the documents with one of the query's phrases; None if no folder has any of its words."""
        phrases = _phrases(query)
        terms = sorted({t for p in phrases for t in p})
        if not terms:
            return None
        spark = self.store.spark
        buckets = {r.b for r in spark.createDataFrame([(t,) for t in terms], "term string").select(self._bucket().alias("b")).collect()}
        held = self.store.read_buckets(self.name, sorted(buckets))
        if held is None:
            return None
        place = {t: f"p{i}" for i, t in enumerate(terms)}
        none = F.array().cast("array<int>")
        rows = held.where(F.col("term").isin(*terms)).groupBy(self.key).agg(F.max("dl").alias("dl"), *(F.coalesce(F.max(F.when(F.col("term") == t, F.col("positions"))), none).alias(c) for t, c in place.items()))

        def count(p: list[str]) -> Column:
            at = F.col(place[p[0]])
            for i, t in enumerate(p[1:], 1):
                at = F.array_intersect(at, before(place[t], i))
            return F.size(at)

        def before(c: str, i: int) -> Column:
            return F.transform(c, lambda x: x - i)

        tf = stored(rows.select(self.key, "dl", *(count(p).alias(f"f{i}") for i, p in enumerate(phrases))))
        n, avgdl = self.store.read(f"{self.name}_totals").first()
        return _scores(tf, self.key, phrases, n, avgdl or 1.0)


def rrf(primary: DataFrame, secondary: DataFrame, weight: float, keys: list[str]) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (keys, rank from 1): score = w*K/(K+i) + (1-w)*K/(K+j) with
    ranks i, j from 0; a missing side gives 0. Fields of the primary list win."""
    a = primary.withColumnRenamed("rank", "rank_a")
    b = secondary.withColumnRenamed("rank", "rank_b")
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    for c in shared:
        a, b = a.withColumnRenamed(c, f"{c}_a"), b.withColumnRenamed(c, f"{c}_b")
    part = lambda c, w: F.coalesce(F.lit(w) * K / (K + F.col(c) - 1), F.lit(0.0))
    out = a.join(b, keys, "full_outer").withColumn("score", part("rank_a", weight) + part("rank_b", 1 - weight))
    for c in shared:
        out = out.withColumn(c, F.coalesce(f"{c}_a", f"{c}_b")).drop(f"{c}_a", f"{c}_b")
    return out


def score_gate(rows: DataFrame, least: float) -> DataFrame:
    """Rows whose fused score is ``least`` or more; no condition unless it is above 0."""
    return rows.where(F.col("score") >= least) if least > 0 else rows


def cosine_gate(fused: DataFrame, least: float, cosine: str = "cosine") -> DataFrame:
    """Drops rows only the vectors found whose cosine is below ``least``; keyword matches and unknown cosines stay."""
    return fused.where(F.col("rank_b").isNotNull() | F.col(cosine).isNull() | (F.col(cosine) >= least))


def leaves_only(ranked: DataFrame, index: str = "chunk_index") -> DataFrame:
    """Without parents, before fusion; ranks are closed up."""
    return ranked.where(F.col(index) != -1).withColumn("rank", F.row_number().over(Window.orderBy("rank")))


def by_file(fused: DataFrame, path: str = "path") -> DataFrame:
    """One row a file: best score and distinct snippets, best first."""
    w = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "snippet")))
    return fused.groupBy(path).agg(F.max("score").alias("score"), F.array_distinct(F.transform(w, lambda x: x["snippet"])).alias("snippets"))


def path_boost(path: str = "path", chunk: bool = False) -> Column:
    source = F.lit(1.0) if chunk else F.when(tx.is_source(path), 1.1).otherwise(1.0)
    return F.when(tx.is_test(path), 0.85).otherwise(source)


def affinity_boost(query: str, path: str = "path", generated: list[str] | None = None, chunk: bool = False) -> Column:
    """Boilerplate and generated files down; else the query's words in the file's stem and directories up (added
    for files, multiplied for chunks). Without words nothing changes."""
    words = tx.query_words(query)
    if not words:
        return F.lit(1.0)
    stems = F.split(tx.stem(path), "[_-]+")
    folders = F.flatten(F.transform(F.slice(F.split(F.lower(F.col(path)), "/"), 1, F.greatest(F.size(F.split(F.col(path), "/")) - 1, F.lit(0))), lambda s: F.split(s, "[_.-]+")))

    def holds(w: str) -> Column:
        return F.exists(stems, lambda s: (F.instr(s, w) > 0) | (F.instr(F.lit(w), s) > 0) | (s == ""))

    def lies_in(w: str) -> Column:
        return F.exists(folders, lambda s: (F.length(s) >= 3) & (F.instr(s, w) > 0))

    in_stem, in_path = (sum(f(w).cast("int") for w in words) for f in (holds, lies_in))
    up = (1 + 0.1 * in_stem) * (1 + 0.05 * in_path) if chunk else 1 + 0.1 * in_stem + 0.05 * in_path
    return F.when(tx.basename(path).isin(*tx.BOILERPLATE), 0.8).when(tx.is_generated(path, generated or []), 0.75).otherwise(up)


def centrality_boost(importers: str = "importers") -> Column:
    return 0.05 * F.log2(F.coalesce(F.col(importers), F.lit(0)) + 1)


def symbol_boost(files: DataFrame, hits: DataFrame, path: str = "path") -> DataFrame:
    """``hits``: a row a symbol hit. A file found already gains a factor 1.3 a hit; a new one starts at 0.75."""
    n = hits.groupBy(path).agg(F.count(F.lit(1)).alias("hits"))
    found = F.col("score") * F.pow(F.lit(1.3), F.coalesce("hits", F.lit(0)))
    return files.join(n, path, "full_outer").withColumn("score", F.coalesce(found, 0.75 * F.pow(F.lit(1.3), F.col("hits") - 1))).drop("hits")


def parent_blob_boost(chunks: DataFrame, weight: float) -> DataFrame:
    """Adds the best parent's score of the same file, weighted, to rows that aren't parents."""
    best = chunks.where("chunk_index = -1").groupBy("path").agg(F.max("score").alias("blob"))
    more = F.when(F.col("chunk_index") != -1, F.coalesce("blob", F.lit(0.0)) * weight).otherwise(0.0)
    return chunks.join(best, "path", "left").withColumn("score", F.col("score") + more).drop("blob")


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """With rank from 1, by score and then the given columns."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *order)))


def expand_for_docs(ordered: DataFrame, k: int, path: str = "path") -> DataFrame:
    """The first k rows (``rank``); if documents push code out of them, as many more as give k code rows, up to
    2k. The list has at most 2k rows here, so the windows are small."""
    few = ordered.where(F.col("rank") <= 2 * k)
    doc = tx.is_doc(path).cast("int")
    w = Window.orderBy("rank")
    few = few.withColumn("_d", F.sum(F.when(F.col("rank") <= k, doc).otherwise(0)).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    few = few.withColumn("_n", F.count(F.when(F.col("rank") <= k, 1)).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    few = few.withColumn("_c", F.coalesce(F.sum(1 - doc).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    mixed = (F.col("_d") > 0) & (F.col("_d") < F.col("_n"))
    return few.where((F.col("rank") <= k) | (mixed & (F.col("_c") < k))).drop("_d", "_n", "_c")


def tail_cut(ordered: DataFrame, cutoff: float = 0.85, steep: float = 0.15) -> DataFrame:
    """Drops rows below cutoff times the score at which the curve settles: the first after the steep head steps."""
    if cutoff <= 0:
        return ordered
    w = Window.orderBy("rank")
    before = F.lag("score").over(w)
    drop = F.when(before > 0, (before - F.col("score")) / before).otherwise(0.0)
    marked = ordered.withColumn("_calm", F.when((F.col("rank") > 1) & (drop <= steep), F.col("rank")))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = marked.withColumn("_stop", F.coalesce(F.min("_calm").over(whole), F.max("rank").over(whole) + 1))
    marked = marked.withColumn("_anchor", F.max(F.when(F.col("rank") == F.col("_stop") - 1, F.col("score"))).over(whole))
    return marked.where(F.col("score") >= F.col("_anchor") * cutoff).drop("_calm", "_stop", "_anchor")


def promote_parents(chunks: DataFrame, parents: DataFrame, least: int = 2) -> DataFrame:
    """Siblings of a parent, ``least`` or more, become one row: the parent with their best score, unless it is
    there already; without the parent they stay. chunks: id, parent_id, score; parents: id."""
    n = chunks.where("parent_id is not null").groupBy("parent_id").agg(F.count(F.lit(1)).alias("_n"), F.max("score").alias("_best"))
    known = parents.select(F.col("id").alias("parent_id"))
    full = n.where(F.col("_n") >= least).join(known, "parent_id", "left_semi")
    kept = chunks.join(full, "parent_id", "left_anti").select("id", "parent_id", "score")
    new = full.join(chunks.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
    return kept.unionByName(new.select(F.col("parent_id").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("_best").alias("score")))


def inject_symbols(rows: DataFrame, symbols: DataFrame, keys: list[str], score: float = 0.75) -> DataFrame:
    """``rows`` and those of ``symbols`` (keys and others) that aren't among them, with a fixed score."""
    new = symbols.dropDuplicates(keys).join(rows.select(*keys), keys, "left_anti")
    return rows.unionByName(new.withColumn("score", F.lit(score)), allowMissingColumns=True)


def best_per_file(rows: DataFrame, k: int, path: str = "path") -> DataFrame:
    """The best chunk of each file, of equal ones the first, and of these the k best files."""
    rest = [c for c in rows.columns if c != path]
    best = rows.groupBy(path).agg(F.max_by(F.struct(*rest), F.struct("score", (-F.col("chunk_index")).alias("o"))).alias("r")).select(path, "r.*")
    return top(best, k, path, "score")


def insertion_points(rows: DataFrame, k: int) -> DataFrame:
    """(path, score, rank, after, anchor): where text like the query would best be put in: after which entity or
    chunk of each of the k best files, and how that ends."""
    after = F.coalesce(F.concat(F.lit("after "), "entity_name"), F.concat(F.lit("after chunk "), F.col("chunk_index").cast("string")))
    tail = F.btrim(F.substring(F.col("snippet"), F.greatest(F.length("snippet") - 149, F.lit(1)), F.lit(150)))
    return best_per_file(rows, k).select("path", "score", "rank", after.alias("after"), tail.alias("anchor"))


def chunk_search(
    near: DataFrame, words: DataFrame, query: str, k: int, weight: float = 0.5, threshold: float = 0.0, leaf_only: bool = True, parent_boost: float = 0.0, rel_cutoff: float = 0.0,
    importers: DataFrame | None = None, generated: list[str] | None = None, symbols: DataFrame | None = None, parents: DataFrame | None = None, siblings: int = 2, trace: dict | None = None,
) -> DataFrame:
    """Ranked chunks (path, chunk_index, score, rank) of one search.

    near: path, chunk_index, rank, vector_score; words: path, chunk_index, rank; both bounded lists, with other columns
    if wanted. In order: parents (chunk_index -1) give their files a boost and, ``leaf_only``, leave both lists, whose
    ranks close up; fusion; rows that only the vectors found need a cosine of ``threshold``; boosts by path, names and
    ``importers`` (path, importers); ``symbols`` (path, chunk_index) are injected; ``siblings`` of a parent become the
    parent (``parents``: id, path; needs id and parent_id in the lists; not if leaf_only); documents widen the list;
    the tail is cut. ``trace`` takes the DataFrame of each stage."""
    keys, note = ["path", "chunk_index"], (lambda name, df: trace.__setitem__(name, df) if trace is not None else None)
    blobs = None
    if parent_boost > 0:
        only = lambda d: d.where("chunk_index = -1").withColumn("rank", F.row_number().over(Window.orderBy("rank")))
        blobs = rrf(only(near), only(words), weight, keys).groupBy("path").agg(F.max("score").alias("_blob"))
    if leaf_only:
        near, words = leaves_only(near), leaves_only(words)
    note("lists", near.unionByName(words, allowMissingColumns=True))
    f = rrf(near, words, weight, keys).withColumn("score", F.round("score", 12)).withColumn("cosine", score_cosine("vector_score"))
    f = cosine_gate(f, threshold)
    note("fused", f)
    score = F.col("score") * path_boost(chunk=True) * affinity_boost(query, generated=generated, chunk=True)
    if importers is not None:
        f = f.join(importers.select("path", "importers"), "path", "left")
        score = score + centrality_boost()
    if blobs is not None:
        f = f.join(blobs, "path", "left")
        score = score + F.when(F.col("chunk_index") != -1, F.coalesce("_blob", F.lit(0.0)) * parent_boost).otherwise(0.0)
    f = f.withColumn("score", F.round(score, 9)).drop("rank_a", "rank_b", "importers", "_blob")
    note("scored", f)
    if symbols is not None:
        f = inject_symbols(f, symbols.where("chunk_index <> -1") if leaf_only else symbols, keys)
        note("symbols", f)
    if parents is not None and not leaf_only:
        groups = promote_parents(f.select("id", "parent_id", "score"), parents.select("id"), siblings)
        where = f.select("id", "path", "chunk_index").unionByName(parents.select("id", "path", F.lit(-1).cast(f.schema["chunk_index"].dataType).alias("chunk_index"))).dropDuplicates(["id"])
        f = groups.join(where, "id")
        note("grouped", f)
    out = expand_for_docs(ranked(f, *keys), k)
    if rel_cutoff > 0:
        out = tail_cut(out, rel_cutoff)
    note("final", out)
    return out
