"""Structured Streaming over transcripts, files and the query log.

Late and repeated data are settled by replacing by key (the last version wins), not by dropping: a turn is
emitted again as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

ENTRY = "session_id string, seq long, role string, text string"
TURN = "session_id string, turn_index long, user_text string, assistant_text string, n_events long"


def read_entries(spark: SparkSession, folder: str, schema: str = ENTRY, **options) -> DataFrame:
    """JSON lines as a stream; lines that don't parse have null fields and are dropped."""
    return spark.readStream.schema(schema).options(**options).json(folder).where("session_id is not null")


def stream_turns(entries: DataFrame) -> DataFrame:
    """Turns of a stream of entries that come in order from batch to batch; within a batch a session's entries are put
    in order. The open turn is kept as state and sent again with each batch that adds to it; the sink replaces it by
    (session_id, turn_index)."""

    def fold(key, frames, state):
        import pandas as pd

        turn, user, answer, n = state.get if state.exists else (-1, "", "", 0)
        done: dict[int, tuple] = {}
        # a session can come in several frames, so order is made over all of them
        for _, role, text in sorted((row for f in frames for row in f[["seq", "role", "text"]].itertuples(index=False, name=None)), key=lambda r: r[0]):
            if role == "user":
                turn, user, answer, n = turn + 1, "", "", 0
            if turn < 0:
                continue
            text = text or ""
            if role == "user":
                user = text
            elif role == "assistant" and text:
                answer = f"{answer}\n{text}" if answer else text
            n += 1
            done[turn] = (key[0], turn, user, answer, n)
        state.update((turn, user, answer, n))
        yield pd.DataFrame(list(done.values()), columns=["session_id", "turn_index", "user_text", "assistant_text", "n_events"])

    return entries.groupBy("session_id").applyInPandasWithState(fold, TURN, "turn long, user string, answer string, n long", "update", GroupStateTimeout.NoTimeout)


def replacing_sink(path: str, keys: list[str], buckets: int = 16):
    """A foreachBatch function: rows replace those of the same keys in the table ``rows`` of the store at ``path``. Rows
    lie in buckets by the hash of their keys, and a batch rewrites the buckets it touches; old versions go. Batches
    that are run again write the same rows again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        from ..sources.store import SnapshotStore, upsert

        store = SnapshotStore(batch.sparkSession, path)
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        batch = batch.persist()
        touched = [r.b for r in batch.select(bucket.alias("b")).distinct().collect()]  # ``buckets`` rows at most
        if touched:
            held = store.read_buckets("rows", touched)
            store.commit_buckets("rows", batch if held is None else upsert(held, batch, keys), bucket, touched)
            store.vacuum(keep=2)
        batch.unpersist()

    return write


def refreshing_sink(path: str):
    """A foreachBatch function for file events (file_id, path, action, at): of each path the last event counts; removed
    files go from all tables of the store at ``path``, and references that a change can touch are resolved again.
    What was read of changed files is committed before, by whoever reads them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        from ..operators.symbols import importers_of, refresh_references
        from ..sources.store import SnapshotStore, remove_files

        store = SnapshotStore(batch.sparkSession, path)
        names = ("files", "chunks", "imports", "exports", "refs")
        tables = {n: store.read(n) for n in names}
        last = latest_events(batch).join(tables["files"].select("file_id", "path"), "path")
        # who imported what went is asked before it goes
        scope = importers_of(tables["imports"], last.select("file_id", "path"))
        left = remove_files(tables, last.where("action = 'remove'"))
        left["refs"] = refresh_references(left["refs"], left["exports"], left["imports"], scope)
        store.commit(**left)

    return write


def latest_events(batch: DataFrame) -> DataFrame:
    """Of a batch of file events (path, action, at) the last one of each path: what debouncing comes to."""
    return batch.groupBy("path").agg(F.max_by("action", "at").alias("action"), F.max("at").alias("at"))


def windowed_queries(log: DataFrame, every: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Extension: queries by event time in tumbling or sliding windows, with a watermark."""
    w = F.window("created_at", every, slide) if slide else F.window("created_at", every)
    return log.withWatermark("created_at", late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("result_count") == 0).alias("zero_results")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "queries", "zero_results")


def user_sessions(log: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Extension: queries of a user without a longer gap between them."""
    w = F.session_window("created_at", gap)
    return log.withWatermark("created_at", late).groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("queries")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "queries")
