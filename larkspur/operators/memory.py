"""Checkpoints and annotations: what users and agents note down, listed, searched and shown beside code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .retrieval import knn

# Kinds of checkpoints.
KINDS = ("decision", "milestone", "blocker", "direction_change", "handoff")


def checkpoint(rows: DataFrame) -> DataFrame:
    """New checkpoints with an id of their own (from session, time and title); an unknown kind is left out."""
    id_ = F.xxhash64("session_id", F.col("timestamp").cast("string"), "title")
    return rows.where(F.col("type").isin(*KINDS)).withColumn("checkpoint_id", id_)


def list_checkpoints(checkpoints: DataFrame, session: object | None = None, kind: str | None = None, k: int = 20) -> DataFrame:
    """Newest first."""
    c = checkpoints
    if session is not None:
        c = c.where(F.col("session_id") == session)
    if kind is not None:
        c = c.where(F.col("type") == kind)
    return c.orderBy(F.desc("timestamp"), "checkpoint_id").limit(k)


def search_checkpoints(checkpoints: DataFrame, queries: DataFrame, kind: str | None = None, k: int = 5) -> DataFrame:
    """(query_id, checkpoint_id, score, rank): the nearest by vector. The kind is filtered before the list is cut, so
    k are found if there are k."""
    c = checkpoints if kind is None else checkpoints.where(F.col("type") == kind)
    return knn(c, queries, k, "checkpoint_id").select("query_id", "checkpoint_id", "score", "rank")


def annotation_upsert(events: DataFrame) -> DataFrame:
    """Notes by (path, symbol or none): first created_at; note, author, commit (where events have one) and time of
    the last."""
    last = [F.max_by(c, F.struct("at", "note")).alias(c) for c in ("note", "author", "commit_hash") if c in events.columns]
    return events.groupBy("path", "symbol_name").agg(F.min("at").alias("created_at"), F.max("at").alias("updated_at"), *last)


def delete_annotations(annotations: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the notes of ``gone`` (path, symbol_name; no symbol is a key of its own)."""
    g = gone.select(F.col("path").alias("_p"), F.col("symbol_name").alias("_s")).distinct()
    return annotations.join(g, F.col("path").eqNullSafe(F.col("_p")) & F.col("symbol_name").eqNullSafe(F.col("_s")), "left_anti")


def list_annotations(annotations: DataFrame, path: str | None = None, symbol: str | None = None) -> DataFrame:
    """Newest first, of a path (or one that ends with it), of a symbol."""
    a = annotations
    if path is not None:
        a = a.where(tx.suffix_path("path", path))
    if symbol is not None:
        a = a.where(F.col("symbol_name") == symbol)
    return a.orderBy(F.desc("updated_at"), "path", F.asc_nulls_first("symbol_name"))


def search_annotations(annotations: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, annotation_id, score, rank): the nearest by vector."""
    return knn(annotations, queries, k, "annotation_id").select("query_id", "annotation_id", "score", "rank")


def annotated(chunks: DataFrame, annotations: DataFrame) -> DataFrame:
    """``chunks`` (path, entity_name and others) with notes: those of the whole file and of the chunk's entity, in
    order of time, as (symbol_name, note)."""
    on = (F.col("path") == F.col("_path")) & (F.col("symbol_name").isNull() | (F.col("symbol_name") == F.col("entity_name")))
    a = annotations.select(F.col("path").alias("_path"), "symbol_name", "note", F.col("created_at").alias("_at"))
    own = chunks.columns
    listed = F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("_at", "symbol_name", "note"))))
    return chunks.join(a, on, "left").groupBy(*own).agg(F.transform(listed, lambda x: F.struct(x["symbol_name"].alias("symbol_name"), x["note"].alias("note"))).alias("notes"))
