"""Chat formatting with cumulative-snapshot collapse.

Loggers often write a conversation again after each turn, so that the log holds its prefixes too. Every
conversation gets rolling hashes of its turn prefixes; one whose whole hash is a shorter prefix of another
is dropped by an anti-join, of equal ones the smallest conv_id stays, and only maximal ones are rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Text before and after each turn's role and text.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """One row a turn: conv_id, place (from 1), role, text, and p1, p2: the hash of the turns up to here.

    A turn's own hash holds its place, so xor over the turns so far depends on their order; two independent
    64-bit hashes make accidents negligible. Running sums stream through a conversation's turns."""
    t = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text").distinct()
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    t = t.withColumn("place", F.row_number().over(w))
    own = F.md5(F.concat_ws("\x1f", F.col("place").cast("string"), F.to_json(F.struct("role", "text"))))
    half = lambda a: F.conv(F.substring(own, a, 15), 16, 10).cast("bigint")
    t = t.withColumn("h1", half(1)).withColumn("h2", half(16))
    return t.select("conv_id", "place", "role", "text", F.bit_xor("h1").over(w).alias("p1"), F.bit_xor("h2").over(w).alias("p2"))


def _escaped(c: str) -> Column:
    """A text that holds a marker can't pass for one: its bar is taken out."""
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"<\|(im_start|im_end)\|>", "<$1>")


def maximal_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefix rows, kept): kept has conv_id, n_turns and n_copies of conversations that no other extends."""
    rows = turn_prefixes(turns)
    ends = rows.groupBy("conv_id").agg(F.max(F.struct("place", "p1", "p2")).alias("end")).select("conv_id", F.col("end.place").alias("n_turns"), "end.p1", "end.p2")
    # equal conversations are one, and so are equal prefixes: both sides of the anti-join have a key once
    whole = ends.groupBy("p1", "p2", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    longer = rows.join(ends.select("conv_id", "n_turns"), "conv_id").where("place < n_turns").select("p1", "p2", F.col("place").alias("n_turns")).distinct()
    return rows, whole.join(longer, ["p1", "p2", "n_turns"], "left_anti").select("conv_id", "n_turns", "n_copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (conversations equal to it, itself included) and rendered of the maximal
    conversations of ``turns`` (conv_id, turn, role, text; other columns are ignored).

    Turns go by turn, then role, then text, nulls first but for turn; a row repeated in full counts once; a
    null role or text is rendered empty but is not equal to an empty one. Rows without conv_id belong to no
    conversation and are left out. Turn numbers need not start at 0 or be dense: order alone counts. Markers
    inside a text lose their bars. An empty table gives no rows."""
    rows, kept = maximal_conversations(turns)
    line = F.concat(F.lit(OPEN), _escaped("role"), F.lit(MIDDLE), _escaped("text"), F.lit(CLOSE))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "")
    return rows.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(text.alias("rendered")).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", "rendered")


#: The same by comparing whole texts of prefixes, for DuckDB.
FORMAT_CHATS_SQL = r"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS place
           FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)),
p AS (SELECT conv_id, place, to_json(list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY place))::VARCHAR AS prefix,
             string_agg('<|im_start|>' || regexp_replace(coalesce(role, ''), '<\|(im_start|im_end)\|>', '<\1>', 'g') || chr(10)
                        || regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<\1>', 'g') || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY place) AS rendered
      FROM t),
e AS (SELECT p.*, max(place) OVER (PARTITION BY conv_id) AS n FROM p),
w AS (SELECT prefix, n, min(conv_id) AS conv_id, count(*) AS n_copies, min(rendered) AS rendered FROM e WHERE place = n GROUP BY prefix, n)
SELECT conv_id, n::BIGINT AS n_turns, n_copies::BIGINT AS n_copies, rendered FROM w
WHERE prefix NOT IN (SELECT prefix FROM e WHERE place < n)
"""
