"""Version history: listings, filters, co-change, freshness, purging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..runtime import dealt, sent_if_small


def file_history(commits: DataFrame, commit_files: DataFrame, path: str, since: str | None = None, k: int = 20) -> DataFrame:
    """The newest commits that touch ``path`` (or a path that ends with it)."""
    hit = commit_files.where(tx.suffix_path("file_path", path))
    c = commits.join(hit, "commit_id")
    if since:
        c = c.where(F.col("date") >= since)
    return c.orderBy(F.desc("date"), "commit_id").limit(k)


def commit_filter(commits: DataFrame, author: str | None = None, since: str | None = None, until: str | None = None, path: str | None = None) -> DataFrame:
    """Author by case-insensitive part of the name or address; dates compared to the given length, so that a day
    is included whole; path by part of any changed file (files_changed)."""
    c = commits
    if author:
        names = [F.lower(x) for x in ("author", "author_email") if x in c.columns]
        c = c.where(tx._any([F.instr(n, author.lower()) > 0 for n in names]))
    for limit, later in ((since, True), (until, False)):
        if limit:
            limit = limit.replace(" ", "T")
            d = F.substring("date", 1, len(limit))
            c = c.where(d >= limit if later else d <= limit)
    if path:
        c = c.where(F.exists("files_changed", lambda f: F.instr(f, path) > 0))
    return c


def search_commits(commits: DataFrame, queries: DataFrame, query: str, k: int = 10, weight: float = 0.5, threshold: float = 0.0, **filters) -> DataFrame:
    """(commit_id, score, rank) of one search: vectors (``queries``: query_id, query; one row) and keywords in message
    and summary, fused. commits: commit_id, embedding, message, summary and what ``commit_filter`` takes. Filters
    come before both lists are cut; keyword statistics are those of all commits. Rows that only the vectors found
    need a cosine of ``threshold``, if that is above 0."""
    from ..functions.vectors import score_cosine
    from .retrieval import bm25_scores, cosine_gate, knn, rrf, top

    c = commit_filter(commits, **filters)
    near = knn(c.where("embedding is not null"), queries, k, "commit_id").select("commit_id", "rank", F.col("score").alias("vector_score"))
    text = commits.select("commit_id", F.concat_ws("\n", "message", "summary").alias("text"))
    words = top(bm25_scores(text, query, "commit_id").join(c.select("commit_id"), "commit_id", "left_semi"), k, "commit_id").select("commit_id", "rank")
    fused = rrf(near, words, weight, ["commit_id"]).withColumn("cosine", score_cosine("vector_score"))
    kept = cosine_gate(fused, threshold) if threshold > 0 else fused
    return top(kept.select("commit_id", F.round("score", 12).alias("score")), k, "commit_id", "score")


#: Parts that the commits of a file are ranked in before they are ranked together.
PARTS = 64


def newest_per_file(commits: DataFrame, commit_files: DataFrame, k: int, rows: int | None = None) -> DataFrame:
    """The k newest commits of each file with their rank. ``rows``: about how many files all commits have, by which they
    are dealt out, at first by file and part, so that a file which most commits touch doesn't come to one task."""
    order = (F.desc("date"), "commit_id")
    j = commit_files.join(commits, "commit_id")
    if rows is not None:
        part = j.withColumn("_part", F.pmod(F.xxhash64("commit_id"), F.lit(PARTS)))
        w = Window.partitionBy("file_path", "_part").orderBy(*order)
        first = dealt(part, rows, "file_path", "_part").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        j = dealt(first.drop("_part", "rank"), rows, "file_path")
    w = Window.partitionBy("file_path").orderBy(*order)
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def co_change(commits: DataFrame, commit_files: DataFrame, path: str, k: int = 15, least: int = 2, max_files: int = 25) -> DataFrame:
    """(file_path, together, changes, jaccard, confidence): files that change with ``path``, most alike first.

    Merges and commits of one file or more than ``max_files`` don't count. The target's commits are found first,
    so that the self-join only meets their files."""
    plain = commits.where("not is_merge").select("commit_id")
    sized = commit_files.groupBy("commit_id").agg(F.countDistinct("file_path").alias("n")).where(F.col("n").between(2, max_files)).select("commit_id")
    use = commit_files.select("commit_id", "file_path").distinct().join(sized, "commit_id", "left_semi").join(plain, "commit_id", "left_semi")
    mine = use.where(tx.suffix_path("file_path", path)).select("commit_id").distinct()
    total = mine.agg(F.count(F.lit(1)).alias("target"))
    with_ = use.join(mine, "commit_id", "left_semi").where(~tx.suffix_path("file_path", path)).groupBy("file_path").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= least)
    counts = use.join(with_.select("file_path"), "file_path", "left_semi").groupBy("file_path").agg(F.count(F.lit(1)).alias("changes"))
    j = with_.join(counts, "file_path").crossJoin(F.broadcast(total))
    j = j.withColumn("jaccard", F.col("together") / (F.col("target") + F.col("changes") - F.col("together"))).withColumn("confidence", F.col("together") / F.least("target", "changes"))
    return j.orderBy(F.desc("jaccard"), F.desc("together"), "file_path").limit(k).drop("target")


def freshness(notes: DataFrame, changes: DataFrame, known: DataFrame, rows: int | None = None) -> DataFrame:
    """``notes`` (id, commit_hash, files_involved) with verdict: null without a commit, diverged if the commit isn't
    ``known`` (sha), stale with stale_files if a file involved changed since (``changes``: sha, path), or current.
    ``rows``: about how many files all notes involve, by which they are dealt out."""
    # a note's files meet the changes and come together again once; nothing is made distinct before
    f = notes.where("commit_hash is not null").select("id", "commit_hash", F.explode("files_involved").alias("path"))
    f = f if rows is None else dealt(f, rows, "commit_hash", "path")
    hit = f.join(changes.withColumnRenamed("sha", "commit_hash"), ["commit_hash", "path"], "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("path")).alias("stale_files"))
    out = notes.join(hit, "id", "left").join(sent_if_small(known.select(F.col("sha").alias("commit_hash"), F.lit(True).alias("_known")).distinct()), "commit_hash", "left")
    verdict = F.when(F.col("commit_hash").isNull(), F.lit(None)).when(F.col("_known").isNull(), "diverged").when(F.col("stale_files").isNotNull(), "stale").otherwise("current")
    return out.withColumn("verdict", verdict).drop("_known")


def purge(commits: DataFrame, reachable: DataFrame) -> DataFrame:
    """Commits that are still reachable (hash)."""
    return commits.join(reachable.select("hash").distinct(), "hash", "left_semi")


def recovered(commits: DataFrame, reachable: DataFrame | None, last_is_ancestor: bool) -> tuple[DataFrame, bool]:
    """(commits to keep, whether to read on from the last one): after a forced push (the last commit read is no ancestor)
    what isn't ``reachable`` (hash) goes. Without an answer (None: git failed) nothing goes, as that is not the same
    as an empty history."""
    if last_is_ancestor or reachable is None:
        return commits, last_is_ancestor
    return purge(commits, reachable), False


def parse_status(text: str) -> list[tuple[str, str]]:
    """(state, path) of each line of ``git status --porcelain``; of a renamed file the new path."""
    return [(line[:2].strip() or "?", line[3:].split(" -> ")[-1].strip('"')) for line in text.splitlines() if len(line) > 3]


def git_context(status: DataFrame, files: DataFrame) -> DataFrame:
    """``status`` (state, path) with indexed: whether the index has the file."""
    return status.join(files.select("path").distinct().withColumn("indexed", F.lit(True)), "path", "left").select("state", "path", F.coalesce("indexed", F.lit(False)).alias("indexed"))


def git_status(commits: DataFrame) -> DataFrame:
    """One row: commits, last date, and the last commit's id and message."""
    last = F.max(F.struct("date", F.col("commit_id"), "message"))
    return commits.agg(F.count(F.lit(1)).alias("n_commits"), last.alias("l")).select("n_commits", F.col("l.date").alias("last_date"), F.col("l.commit_id").alias("last_id"), F.col("l.message").alias("last_message"))
