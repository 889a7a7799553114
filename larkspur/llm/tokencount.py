"""Token counts of fields and lines, from one encoding of the whole document.

A document is its fields one after the other. It is encoded once; the ids' byte spans are joined with the
sections' spans by binary search, and a token that crosses a boundary goes to one section by rule:
``start`` (the section of its first byte), ``end`` (of its last) or ``most`` (where most of its bytes lie,
the first of equals). So a document's counts always add up to its number of tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import batch_encoder, token_bytes
from .common import ship
from .textkernel import rows_of, texts

COUNTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("field", T.StringType()), T.StructField("line", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_crossing", T.LongType()),
])
RULES = ("start", "end", "most")


def attribute(starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray, total: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses). Sections begin at ``cuts`` (ascending, from 0) and cover
    all ``total`` bytes; of sections that begin at one place all but the last are empty and get nothing."""
    first = np.searchsorted(cuts, starts, "right") - 1
    last = np.searchsorted(cuts, ends - 1, "right") - 1
    crosses = first != last
    if rule == "end":
        return last, crosses
    if rule == "most":
        best = first.copy()
        edge = np.append(cuts, total)
        for t in np.flatnonzero(crosses).tolist():  # few; a token may span many short sections
            k = np.arange(first[t], last[t] + 1)
            share = np.minimum(edge[k + 1], ends[t]) - np.maximum(edge[k], starts[t])
            best[t] = k[np.argmax(share)]
        return best, crosses
    return first, crosses


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",), lines: bool = True, rule: str = "start") -> DataFrame:
    """One row for each line (or, without ``lines``, field) of every row of ``docs``.

    Returns doc_id, field, line (from 0 in its field), start (byte in the document), bytes, n_tokens, and
    n_crossing (tokens with a byte in this section and one in another that were allotted here). A line holds
    its line feed; an empty or null field is one empty line with no tokens. Repeated rows and rows without
    an id count too; other columns are ignored; an empty table gives no rows."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(docs.sparkSession)

    def run(batches):
        encoder, size = batch_encoder(vocabulary, pattern), token_bytes(vocabulary)
        for b in rows_of(batches):
            buf, off = texts(b.column(1))
            lengths = np.array(b.column(2).flatten()).reshape(-1, len(fields)) if b.num_rows else np.zeros((0, len(fields)), np.int64)
            ids, _ = encoder.encode(buf, off)
            ends = np.cumsum(size[ids])
            # every field begins a section, and in it every byte after a line feed
            begin = off[:-1, None] + np.cumsum(lengths, 1) - lengths
            owner = np.arange(begin.size)
            cuts = begin.ravel()
            if lines:
                feeds = np.flatnonzero(buf == 10) + 1
                stop = (begin + lengths).ravel()
                # a line feed that ends a field begins no line
                home = np.searchsorted(cuts, feeds - 1, "right") - 1
                feeds, home = (x[feeds < stop[home]] for x in (feeds, home))
                cuts, owner = np.concatenate([cuts, feeds]), np.concatenate([owner, home])
                order = np.lexsort((cuts, owner))
                cuts, owner = cuts[order], owner[order]
            to, crosses = attribute(ends - size[ids], ends, cuts, len(buf), rule)
            n = np.bincount(to, minlength=len(cuts))
            x = np.bincount(to[crosses], minlength=len(cuts))
            first = np.searchsorted(owner, owner)
            doc, field = owner // len(fields), owner % len(fields)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), pa.array(fields).take(pa.array(field)), pa.array(np.arange(len(cuts)) - first), pa.array(cuts - off[doc]), pa.array(np.diff(np.append(cuts, len(buf)))), pa.array(n), pa.array(x)],
                names=[f.name for f in COUNTS],
            )

    def filled(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    whole = F.concat(*map(filled, fields)) if len(fields) > 1 else filled(fields[0])
    sizes = F.array(*[F.octet_length(filled(c)).cast("long") for c in fields])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole.alias("text"), sizes.alias("sizes")).mapInArrow(run, COUNTS)
