"""Best-fit-decreasing packing of documents into fixed-size token sequences.

The plan is exact global best-fit decreasing, made on the histogram of piece lengths: at most
``capacity`` different lengths, whatever the corpus' size. Open bins are kept as runs of bins with equal
contents, keyed by remaining capacity; a segment tree over the capacities finds the tightest run that
takes a length in logarithmic time. Runs make a step stand for all pieces it places alike, so the plan
stays of bounded size and only it goes to the executors. Pieces then find their place by their rank among
pieces of their length, a rank made of a local rank and the sums of counts of earlier blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, sent_if_small, ship
from .textkernel import rows_of, texts


class CapacityTree:
    """Which remaining capacities have open bins; ``tightest(need)``: the least one of at least ``need``."""

    def __init__(self, capacity: int):
        self.size = 1 << max(1, math.ceil(math.log2(capacity + 1)))
        self.full = [False] * (2 * self.size)

    def put(self, at: int, there: bool) -> None:
        at += self.size
        self.full[at] = there
        while at > 1:
            at //= 2
            self.full[at] = self.full[2 * at] or self.full[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        if need >= self.size:
            return None
        at = need + self.size
        if self.full[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.full[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.full[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


@dataclass
class Run:
    """``count`` bins from number ``first`` on, all with ``left`` room."""

    first: int
    count: int
    left: int


@dataclass
class Plan:
    """For each length, in order of rank: (first rank, first bin, offset in the bin, pieces placed)."""

    places: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    bins: int = 0


def plan_packing(histogram: dict[int, int], capacity: int) -> Plan:
    """Exact best-fit decreasing of ``histogram`` (length: pieces) into bins of ``capacity``."""
    tree, open_at, plan = CapacityTree(capacity), {}, Plan()

    def opened(run: Run) -> None:
        if run.count and run.left:
            open_at.setdefault(run.left, []).append(run)
            tree.put(run.left, True)

    for length in sorted((n for n in histogram if histogram[n]), reverse=True):
        todo, rank = histogram[length], 0
        out = plan.places[length] = []
        while todo:
            left = tree.tightest(length)
            if left is None:
                # a new bin takes this length again and again before another is opened
                each = capacity // length
                count, rest = divmod(todo, each)
                for n, bins in ((each, count), (rest, 1 if rest else 0)):
                    for k in range(n if bins else 0):
                        out.append((rank, plan.bins, k * length, bins))
                        rank += bins
                    opened(Run(plan.bins, bins, capacity - n * length))
                    plan.bins += bins
                break
            # each bin of the run is filled as far as it goes before the next bin is touched
            run = open_at[left].pop()
            if not open_at[left]:
                tree.put(left, False)
            each = left // length
            count, rest = min(run.count, todo // each), 0
            if count < run.count and todo - count * each < each:
                rest = todo - count * each
            for n, first, bins in ((each, run.first, count), (rest, run.first + count, 1 if rest else 0)):
                for k in range(n if bins else 0):
                    out.append((rank, first, capacity - left + k * length, bins))
                    rank += bins
                opened(Run(first, bins, left - n * length))
            done = count + (1 if rest else 0)
            opened(Run(run.first + done, run.count - done, left))
            todo -= count * each + rest
    return plan


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("block", T.LongType()), T.StructField("local_rank", T.LongType()),
])


def cut(total: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents with ``total`` ids each: full ones, and
    before them the rest, so that only one piece of a document has to be fitted in somewhere."""
    n = -(-total // capacity)
    doc = np.repeat(np.arange(len(total)), n)
    piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    head = total - (n - 1) * capacity
    start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, head[doc], capacity)


def tokenized_pieces(docs: DataFrame, vocabulary: str, pattern: str, capacity: int, end_id: int, special=()) -> DataFrame:
    """One row a piece. ``block`` and ``local_rank`` say where among the pieces of its length it comes."""

    def run(batches):
        from .bpe import batch_encoder

        encoder, seen, block, left = batch_encoder(vocabulary, pattern, special), np.zeros(capacity + 1, np.int64), None, 0
        for b in rows_of(batches):
            if block is None:
                from pyspark import TaskContext

                block = TaskContext.get().partitionId()
            ids, off = encoder.encode(*texts(b.column(1)))
            total = np.diff(off) + 1
            out = np.full(int(total.sum()), end_id, "<u4")
            ends = np.cumsum(total)
            keep = np.ones(len(out), bool)
            keep[ends - 1] = False
            out[keep] = ids
            doc, piece, start, length = cut(total, capacity)
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.searchsorted(ranked, ranked) + seen[ranked]
            seen += np.bincount(length, minlength=capacity + 1)
            at = np.append((ends - total)[doc] + start, len(out)) * 4
            data = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), data.cast(pa.binary()), pa.array(np.full(len(doc), block, np.int64)), pa.array(rank)],
                names=[f.name for f in PIECES],
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 2048, end_id: int = 0, special: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """All pieces of ``docs`` (doc_id, text) with their ids (little-endian unsigned 32-bit) and places.

    Returns doc_id, piece, start, length, ids, sequence_id, offset. A document is its ids and ``end_id``;
    a null or empty text is ``end_id`` alone. ``special`` strings (with ids) are cut out of texts first;
    without it no string is special. Only documents of more than ``capacity`` ids are cut. Rows
    with the same (or no) doc_id are documents of their own. An empty table gives no rows. Other columns
    of ``docs`` are ignored, whatever their names."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "pack")
    pieces = scratch.table(tokenized_pieces(docs, vocabulary, pattern, capacity, end_id, special), "pieces")
    # counts of each block and length: far fewer than pieces; ranks of blocks are running sums within a length
    counts = scratch.table(pieces.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    plan = plan_packing({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    # a row a block and length: sent if few, else both sides are shuffled by block and length
    before = sent_if_small(scratch.table(block_offsets(counts), "before"))
    steps = [(n, *x) for n, xs in plan.places.items() for x in xs]
    length = np.array([x[0] for x in steps], np.int64)
    rank, first, place = (np.array([x[k] for x in steps], np.int64) for k in (1, 2, 3))
    # steps ascend by (length, rank) once sorted; lengths are at most the capacity, so one number orders both
    order = np.lexsort((rank, length))
    length, rank, first, place = length[order], rank[order], first[order], place[order]
    lows = np.searchsorted(length, np.arange(capacity + 2))

    def put(batches):
        for b in batches:
            n, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            step = np.empty(len(n), np.int64)
            for k in np.unique(n).tolist():
                at = np.flatnonzero(n == k)
                step[at] = lows[k] + np.searchsorted(rank[lows[k] : lows[k + 1]], r[at], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids")), pa.array(first[step] + r - rank[step]), pa.array(place[step])],
                names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
            )

    ranked = pieces.join(before, ["block", "length"]).withColumn("rank", F.col("local_rank") + F.col("before"))
    schema = T.StructType([*PIECES.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select("doc_id", "piece", "start", "length", "ids", "rank").mapInArrow(put, schema)


def block_offsets(counts: DataFrame) -> DataFrame:
    """For each (block, length), how many pieces of that length earlier blocks hold."""
    from pyspark.sql import Window

    w = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("block", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids (binary), in order of offset."""
    return placed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"])), "").alias("hex"),
    ).select("sequence_id", "length", F.unhex("hex").alias("ids"))
