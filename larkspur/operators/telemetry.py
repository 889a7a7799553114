"""Query-log analytics and retrieval metrics."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..runtime import sent_if_small, spread, stored


def _totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("queries"), F.avg("result_count").alias("avg_results"), F.avg("top_score").alias("avg_score"),
        F.count_if(F.col("result_count") == 0).alias("zero_results"), F.count_if(F.col("top_score") < 0.3).alias("low_scores"),
    ]


def totals(log: DataFrame) -> DataFrame:
    """One row in one pass: queries, means (scores where there are any), zero and low results."""
    return log.agg(*_totals())


def top_terms(log: DataFrame, k: int = 10, zero_only: bool = False) -> DataFrame:
    l = log.where("result_count = 0") if zero_only else log
    return l.groupBy("query").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "query").limit(k)


def per_day(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def trend(log: DataFrame, start: str, middle: str, end: str) -> DataFrame:
    """One row: figures of [middle, end) and [start, middle), and differences."""
    at = F.col("created_at")
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    now, old = (at >= ts(middle)) & (at < ts(end)), (at >= ts(start)) & (at < ts(middle))
    out = []
    for name, when in (("now", now), ("before", old)):
        out += [F.count_if(when).alias(f"queries_{name}"), F.avg(F.when(when, F.col("top_score"))).alias(f"score_{name}"), (F.count_if(when & (F.col("result_count") == 0)) / F.nullif(F.count_if(when), F.lit(0))).alias(f"zero_rate_{name}")]
    t = log.agg(*out)
    return t.select("*", (F.col("queries_now") - F.col("queries_before")).alias("queries_delta"), (F.col("score_now") - F.col("score_before")).alias("score_delta"))


def retrieval_metrics(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Per query (query_id): recall at k and reciprocal rank of the first hit. results: query_id, item, rank (from 1);
    expected: query_id, item."""
    hits = expected.distinct().join(results, ["query_id", "item"], "left")
    return hits.groupBy("query_id").agg((F.count_if(F.col("rank") <= k) / F.count(F.lit(1))).alias("recall"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"))


def summary(per_query: DataFrame) -> DataFrame:
    """One row: mean recall, MRR, share of queries without a hit."""
    return per_query.agg(F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.avg(F.when(F.col("recall") == 0, 1.0).otherwise(0.0)).alias("zero_miss"))


def gate(per_query: DataFrame, recall: float = 0.8, mrr: float = 0.6, *groups: str) -> DataFrame:
    """Per group (such as the model) the mean recall and MRR, the share of queries without a hit, and whether both
    means reach what is asked."""
    g = per_query.groupBy(*groups).agg(F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.avg(F.when(F.col("recall") == 0, 1.0).otherwise(0.0)).alias("zero_miss"))
    return g.withColumn("passed", (F.col("recall") >= recall) & (F.col("mrr") >= mrr))


def keyword_baseline(tasks: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """Files whose path holds words (of 3 letters or more) of a task, most words first: task_id, path, score, rank.
    Words and paths meet on the word's first three letters, which any path that holds the word has."""
    words = tasks.select("task_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("task"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))).alias("word"))
    p = paths.select("path", F.lower("path").alias("_p")).where(F.length("path") >= 3)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_p") - 2), lambda i: F.substring(F.col("_p"), i, F.lit(3))))
    found = p.select("path", "_p", F.explode(grams).alias("gram")).join(words.select("word", F.substring("word", 1, 3).alias("gram")).distinct(), "gram").where(F.contains("_p", "word")).select("path", "word")
    n = found.join(words, "word").groupBy("task_id", "path").agg(F.count(F.lit(1)).alias("score"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("score"), "path"))).where(F.col("rank") <= k)


def passages_in(docs: DataFrame, passages: DataFrame, key: str = "doc_id", passage_key: str = "item_id") -> DataFrame:
    """(passage_key, key): which texts hold which passages (both: text). A passage meets the texts that have its longest
    inner word (one with white space on both sides) and is then looked for; passages without an inner word are looked
    for in all texts."""
    words = F.split("text", r"\s+")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    p = passages.select(passage_key, F.col("text").alias("_passage"), F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("_word"))
    anchors = stored(p)
    d = spread(docs.select(key, "text"))
    met = d.select(key, "text", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("_word")).join(sent_if_small(anchors.where("_word is not null"), 10_000), "_word")
    out = met.where(F.contains("text", "_passage")).select(passage_key, key)
    short = anchors.where("_word is null")
    if not short.isEmpty():
        out = out.unionByName(d.join(short, F.contains("text", "_passage")).select(passage_key, key))
    return out.distinct()


class Phases:
    """How long phases of work take and how many rows they make: ``with phases("embed") as seen: seen(df).write...``"""

    def __init__(self):
        self.seconds: dict[str, float] = {}
        self.rows: dict[str, int] = {}

    @contextmanager
    def __call__(self, name: str):
        began, watched = time.perf_counter(), []

        def seen(df: DataFrame) -> DataFrame:
            watched.append(o := Observation())
            return df.observe(o, F.count(F.lit(1)).alias("rows"))

        yield seen
        self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
        self.rows[name] = self.rows.get(name, 0) + sum(o.get["rows"] for o in watched)

    def shares(self) -> dict[str, float]:
        whole = sum(self.seconds.values()) or 1.0
        return {k: v / whole for k, v in self.seconds.items()}


def ab_stats(traces: DataFrame) -> DataFrame:
    """Per arm: tasks, means of tokens and duration, share of tasks with an expected file among those read."""
    return traces.groupBy("arm").agg(F.count(F.lit(1)).alias("tasks"), F.avg("tokens").alias("avg_tokens"), F.avg("duration_ms").alias("avg_ms"), F.avg(F.when(F.arrays_overlap("read", "expected"), 1.0).otherwise(0.0)).alias("hit_rate"))
