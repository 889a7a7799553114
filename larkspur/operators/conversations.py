"""Conversations: folding events into turns, statistics, windows, budgets, replacing by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tools whose output is kept only if short, and how short.
BULKY_TOOLS = ("Read", "Glob", "Write", "Edit", "NotebookEdit")
SHORT_OUTPUT = 500


def keep_tool_output(tool: Column, output: Column) -> Column:
    return ~tool.isin(*BULKY_TOOLS) | (F.length(output) <= SHORT_OUTPUT)


def fold_turns(events: DataFrame, session: str = "session_id", order: str = "seq") -> DataFrame:
    """Events (session, order, role, text, tools, files, tokens) to turns: a user's message opens a turn, what
    comes before the first is dropped. Texts are joined by line feeds in order, tools and files are distinct in
    order, tokens are those of the assistant; the summary is the first 200 characters of what was said first."""
    w = Window.partitionBy(session).orderBy(order)
    e = events.withColumn("turn_index", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w) - 1).where("turn_index >= 0")
    listed = F.array_sort(F.collect_list(F.struct(order, "role", "text", "tools", "files")))
    t = e.groupBy(session, "turn_index").agg(listed.alias("l"), F.sum(F.when(F.col("role") == "assistant", F.col("tokens"))).alias("token_cost"), F.count(F.lit(1)).alias("n_events"))

    def said(role: str) -> Column:
        return F.array_join(F.transform(F.filter("l", lambda x: (x["role"] == role) & (F.coalesce(x["text"], F.lit("")) != "")), lambda x: x["text"]), "\n")

    def distinct(field: str) -> Column:
        return F.array_distinct(F.flatten(F.transform("l", lambda x: F.coalesce(x[field], F.array().cast("array<string>")))))

    t = t.select(session, "turn_index", said("user").alias("user_text"), said("assistant").alias("assistant_text"), distinct("tools").alias("tools_used"), distinct("files").alias("files_referenced"), F.coalesce("token_cost", F.lit(0)).cast("long").alias("token_cost"), "n_events")
    full = (F.col("user_text") != "") | (F.col("assistant_text") != "")
    return t.where(full).withColumn("summary", F.substring(F.when(F.col("user_text") != "", F.col("user_text")).otherwise(F.col("assistant_text")), 1, 200))


def session_stats(turns: DataFrame, session: str = "session_id") -> DataFrame:
    return turns.groupBy(session).agg(F.count(F.lit(1)).alias("turn_count"), F.max("turn_index").alias("last_turn"), F.sum("token_cost").alias("total_tokens"))


def turn_window(turns: DataFrame, session: str = "session_id", tail: int | None = None, turn: int | None = None, context: int = 0, first: int | None = None, last: int | None = None) -> DataFrame:
    """The turns from ``first`` to ``last``, those around ``turn``, or the last ``tail``, clamped to what there is."""
    t = turns.join(turns.groupBy(session).agg(F.max("turn_index").alias("_last")), session)
    clamp = lambda x: F.least(F.greatest(F.lit(x), F.lit(0)), F.col("_last"))
    if first is not None or last is not None:
        t = t.where(F.col("turn_index").between(clamp(first or 0), F.col("_last") if last is None else clamp(last)))
    elif turn is not None:
        at = clamp(turn)
        t = t.where(F.col("turn_index").between(at - context, at + context))
    elif tail is not None:
        t = t.where(F.col("turn_index") > F.col("_last") - tail)
    return t.drop("_last")


def budget(turns: DataFrame, max_chars: int, text: str = "block", session: str = "session_id", least_rest: int = 200) -> DataFrame:
    """Whole blocks while they fit in ``max_chars``; the first that doesn't is cut if more than ``least_rest`` are left."""
    w = Window.partitionBy(session).orderBy("turn_index").rowsBetween(Window.unboundedPreceding, -1)
    t = turns.withColumn("_used", F.coalesce(F.sum(F.length(text)).over(w), F.lit(0)))
    rest = F.lit(max_chars) - F.col("_used")
    whole = F.length(text) <= rest
    return t.where(whole | (rest > least_rest)).withColumn(text, F.when(whole, F.col(text)).otherwise(F.substring(F.col(text), F.lit(1), rest.cast("int")))).drop("_used")


def latest(rows: DataFrame, keys: list[str], *version: str) -> DataFrame:
    """The last version of each key, whole rows: what replacing or upserting by key comes to."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*version, *[c for c in rest if c not in version])).alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in rest])


def first_per_turn(chunks: DataFrame, k: int, turn: str = "turn_id", session: str | None = None) -> DataFrame:
    """Ranked chunks (rank) to at most k turns, each by its best chunk; a session is picked after that."""
    best = chunks.withColumn("_n", F.row_number().over(Window.partitionBy(turn).orderBy("rank"))).where("_n = 1").drop("_n")
    if session is not None:
        best = best.where(F.col("session_id") == session)
    return best.orderBy("rank").limit(k)


def search_turns(near: DataFrame, words: DataFrame, k: int, weight: float = 0.5, session: object | None = None) -> DataFrame:
    """(turn_id, score, rank) of one search of conversations. near, words: ranked chunks (turn_id, session_id, rank), as
    many as three times k, or ten with a session. Each list gives its first k turns, a turn by its best chunk."""
    from .retrieval import rrf, top

    lists = [first_per_turn(d, k, session=session).withColumn("rank", F.row_number().over(Window.orderBy("rank"))).select("turn_id", "rank") for d in (near, words)]
    return top(rrf(*lists, weight, ["turn_id"]).select("turn_id", F.round("score", 12).alias("score")), k, "turn_id", "score")


def changed_turns(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(turn_id, changed): whether a turn's chunks (turn_id, chunk_index, snippet) differ from those stored; one that
    didn't change need not be embedded again. Texts are compared by a hash of all of them in order."""
    whole = lambda d, c: d.groupBy("turn_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "snippet"))), lambda x: x["snippet"]), "\0"), 256).alias(c))
    return whole(fresh, "n").join(whole(stored, "o"), "turn_id", "left").select("turn_id", (~F.col("n").eqNullSafe(F.col("o"))).alias("changed"))


def delete_turns(turns: DataFrame, above: DataFrame, session: str = "session_id") -> DataFrame:
    """Without the turns beyond those of ``above`` (session, last: the last turn that stays, null for none)."""
    a = above.select(F.col(session), F.coalesce("last", F.lit(-1)).alias("_last"))
    return turns.join(a, session, "left").where(F.col("_last").isNull() | (F.col("turn_index") <= F.col("_last"))).drop("_last")


def upsert_sessions(sessions: DataFrame, turns: DataFrame, session: str = "session_id") -> DataFrame:
    """Sessions with the statistics of ``turns`` in place of what was stored; others stay."""
    from ..sources.store import upsert

    return upsert(sessions, session_stats(turns, session), [session])


def session_digest(sessions: DataFrame, turns: DataFrame, checkpoints: DataFrame, annotations: DataFrame, commits: DataFrame, k: int = 5) -> dict[str, list]:
    """What a new session is told: the latest sessions with their last summary, checkpoints, notes and commits, ``k`` of
    each at most, for the user."""
    last = turns.groupBy("session_id").agg(F.max_by("summary", "turn_index").alias("summary"))
    s = sessions.join(last, "session_id", "left").orderBy(F.desc("last_turn"), "session_id").limit(k)
    lists = {"sessions": s.select("session_id", "turn_count", "summary"), "checkpoints": checkpoints.orderBy(F.desc("timestamp"), "title").limit(k).select("type", "title"), "notes": annotations.orderBy(F.desc("updated_at"), "path").limit(k).select("path", "note"), "commits": commits.orderBy(F.desc("date"), "commit_id").limit(k).select("date", "message")}
    return {name: [tuple(r) for r in d.collect()] for name, d in lists.items()}


def session_owner(entries: DataFrame, project: str, file: str = "file") -> DataFrame:
    """(file, owner): own if any entry's cwd is the project, foreign if others are named, unknown if none is."""
    mine = F.bool_or(F.col("cwd") == project)
    return entries.groupBy(file).agg(F.when(mine, "own").when(F.count("cwd") > 0, "foreign").otherwise("unknown").alias("owner"))


def resume_action(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """For the first parsed turn of each session against the stored one: replace if the user's text and the time are
    equal or the stored answer begins the parsed one, else append."""
    j = parsed.alias("p").join(stored.alias("s"), "session_id", "left")
    same = F.col("p.user_text").eqNullSafe(F.col("s.user_text")) & (F.col("p.timestamp").eqNullSafe(F.col("s.timestamp")) | F.col("p.assistant_text").startswith(F.col("s.assistant_text")))
    return j.select("session_id", F.when(F.coalesce(same, F.lit(False)), "replace").otherwise("append").alias("action"))
