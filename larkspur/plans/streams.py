"""Queries that run streams over the driver's tables to their end, and the event-time analytics as batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_dir, ship
from ..streaming import tail
from .registry import QUERY_LOG, query, query_log, table


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/larkspur/stream-{uuid.uuid4().hex}"


@query("""WITH ev AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ti FROM conversations)
SELECT conv_id::VARCHAR AS session_id, ti::BIGINT AS turn_index, count(*) AS n_events, coalesce(max(text) FILTER (WHERE role = 'user'), '') AS user_text FROM ev WHERE ti >= 0 GROUP BY 1, 2""")
def streamed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    at = _scratch(spark)
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), "role", "text")
    # a session's later entries come in later files, so that a batch goes on with turns that one before it sent
    for k, part in enumerate((c.where("seq < 3"), c.where("seq >= 3"))):
        part.coalesce(1).write.json(f"{at}/in/part={k}")
    turns = tail.stream_turns(tail.read_entries(spark, f"{at}/in/part=*", maxFilesPerTrigger=1))
    q = turns.writeStream.outputMode("update").foreachBatch(tail.replacing_sink(f"{at}/out", ["session_id", "turn_index"])).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    from ..sources.store import SnapshotStore

    return SnapshotStore(spark, f"{at}/out").read("rows").select("session_id", "turn_index", "n_events", "user_text")


@query(f"""WITH {QUERY_LOG} SELECT date_trunc('day', created_at)::TIMESTAMP AS start, date_trunc('day', created_at)::TIMESTAMP + INTERVAL 1 DAY AS end, count(*) AS queries, count(*) FILTER (WHERE result_count = 0) AS zero_results
FROM query_log GROUP BY 1, 2""")
def windowed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tail.windowed_queries(query_log(spark, sf_dir))


@query(f"""WITH {QUERY_LOG}, g AS (SELECT *, (created_at > lag(created_at) OVER w + INTERVAL 30 MINUTE)::INT AS new FROM query_log WINDOW w AS (PARTITION BY user_id ORDER BY created_at)),
s AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY user_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(created_at) AS start, max(created_at) + INTERVAL 30 MINUTE AS end, count(*) AS queries FROM s GROUP BY user_id, s""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tail.user_sessions(query_log(spark, sf_dir))
