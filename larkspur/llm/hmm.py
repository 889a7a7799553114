"""A hidden Markov language model, trained by Baum-Welch over all training documents.

Every word seen in training has emissions of its own in each state, however many there are. They are found in
two steps. First come passes with tied emissions: frequent words (OWN_CLASSES at most) stand alone, the others
share a class by their last bytes. Then a last pass over all training documents sums each word's expected counts
by state in a shuffle and splits its class between its words: a word's states are those counts, drawn to its
class's as by OWN_PRIOR further occurrences, so a word seen once leans on its class and one seen often on itself.
In each state the shares of a class add up to 1. Words never seen are one outcome, whose mass is the share of
training tokens seen once (Good and Turing's estimate).

Documents are cut into blocks, coded once (tokens as positions in the block's own vocabulary) and written;
later passes read codes only. The frequent words, a bounded table, go to all tasks; the table of the other words
stays distributed, and each block gets back the rows of its words, packed. No word has a row for each block that
a window would buffer. The driver sees one row a class. Passes go on until the likelihood hardly rises.
Likelihoods are exact: scaled forward recursion over whole documents, many side by side."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, ship
from .textkernel import hash_spans, ragged, rows_of, texts, words

STATES, OWN_CLASSES, SUFFIX_CLASSES = 8, 32768, 2048
#: Passes over all training documents, at most, and the rise of the log likelihood of a token (in nats) that is
#: worth another one.
PASSES, RISE = 3, 0.05
#: A word is tried as frequent if it is this share of a block's training tokens: no word that is more common than
#: that in the corpus is missed.
OFTEN = 2.0**-18
#: Occurrences, by its class's states, that a word's own are added to.
OWN_PRIOR = 2.0
#: The start is found on whole documents: SAMPLE at most, and none after SAMPLE_TOKENS tokens; documents of more
#: than SAMPLE_LONG tokens only if there are no shorter ones.
SAMPLE, SAMPLE_TOKENS, SAMPLE_LONG, SAMPLE_PASSES = 400, 1_000_000, 65_536, 12
#: Pseudo-tokens of the unigram distribution in each state's emissions, and of each transition.
PRIOR, PRIOR_MOVE = 100.0, 1.0
BLOCK_BYTES, CHUNK_TOKENS = 8 << 20, 400_000
END = np.uint64(0x5EED0FE11D0C5EED)
_END_SUFFIX = SUFFIX_CLASSES

@dataclass
class Frequent:
    """The most frequent words, by hash, and their corpus counts."""

    words: np.ndarray  # ascending
    counts: np.ndarray

    def place(self, word: np.ndarray) -> np.ndarray:
        """Where each word stands here, or -1."""
        if not len(self.words):
            return np.full(len(word), -1)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, at, -1)


BLOCKS = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("doc_id", T.ArrayType(T.LongType())), T.StructField("train", T.ArrayType(T.BooleanType())),
    T.StructField("length", T.BinaryType()), T.StructField("tokens", T.BinaryType()), T.StructField("words", T.BinaryType()), T.StructField("suffix", T.BinaryType()), T.StructField("counts", T.BinaryType()),
])


def pack(x: np.ndarray, width: int) -> bytes:
    """Integers by their bytes' planes, compressed: high planes are nearly empty."""
    return zstandard.compress(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def unpack(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def coded(docs: DataFrame) -> DataFrame:
    """Blocks of ``docs`` (doc_id, text, train): lengths and tokens (positions in words), words (64-bit
    hashes), and their suffix classes and counts in training documents of this block."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, b in enumerate(rows_of(batches, BLOCK_BYTES)):
            buf, off = texts(b.column(1))
            s, e, at = words(buf, off)
            h = hash_spans(buf, s, e, lower=True)
            # the last four bytes, A-Z lower-cased, tell word endings apart
            low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint32)
            suffix = np.zeros(len(s), np.uint32)
            for i in range(1, 5):
                suffix = suffix * np.uint32(16777619) ^ np.where(e - i >= s, low[np.maximum(e - i, 0)], 0).astype(np.uint32)
            suffix = (suffix ^ (suffix >> 15)) % SUFFIX_CLASSES
            n = np.diff(at) + 1
            ends = np.cumsum(n)
            every = np.full(int(n.sum()), END, np.uint64)
            inner = np.ones(len(every), bool)
            inner[ends - 1] = False
            every[inner] = h
            types, first, tokens = np.unique(every, return_index=True, return_inverse=True)
            # frequent words get small numbers, which compress well
            rank = np.argsort(-np.bincount(tokens, minlength=len(types)), kind="stable")
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))
            types, first, tokens = types[rank], first[rank], place[tokens]
            tail = np.full(len(every), _END_SUFFIX, np.uint16)
            tail[inner] = suffix
            train = np.repeat(np.array(b.column(2).to_pylist(), bool), n)
            counts = np.bincount(tokens[train], minlength=len(types))
            one = lambda x: pa.array([x], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | k]), pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([b.column(2).to_pylist()], pa.list_(pa.bool_())), one(pack(n, 4)), one(pack(tokens, 4)), one(types.tobytes()), one(tail[first].tobytes()), one(pack(counts, 4))],
                names=BLOCKS.names,
            )

    return docs.select("doc_id", "text", "train").mapInArrow(run, BLOCKS)


def _columns(b: pa.RecordBatch, *names: str):
    """The rows of some columns, as Python values."""
    return zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in names))


def frequent_words(blocks: DataFrame, own_classes: int = OWN_CLASSES) -> np.ndarray:
    """The most frequent training words (hashes, ascending), ``own_classes`` at most, by their counts in blocks of
    which they are OFTEN or more. Only these are collected."""

    def run(batches):
        for b in batches:
            for w, n in _columns(b, "words", "counts"):
                n = unpack(n, 4)
                has = n >= max(1, OFTEN * n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(w, "<i8")[has]), pa.array(n[has])], names=["word", "n"])

    often = blocks.select("words", "counts").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r.word for r in often.orderBy(F.desc("n"), "word").limit(own_classes).collect()], np.int64).view(np.uint64))


def fit_classes(blocks: DataFrame, own_classes: int = OWN_CLASSES) -> Classes:
    """Classes and their exact totals in training documents; one row a class is collected."""
    frequent = Frequent(frequent_words(blocks, own_classes), np.zeros(0, np.int64))
    own, n_classes = len(frequent.words), len(frequent.words) + SUFFIX_CLASSES + 2

    def run(batches):
        total = np.zeros(n_classes, np.int64)
        for b in batches:
            for w, s, n in _columns(b, "words", "suffix", "counts"):
                at = frequent.place(np.frombuffer(w, "<u8"))
                np.add.at(total, np.where(at >= 0, at, own + np.frombuffer(s, "<u2").astype(np.int64)), unpack(n, 4))
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["class", "n"])

    total = np.zeros(n_classes)
    for r in blocks.select("words", "suffix", "counts").mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        total[r["class"]] = r.n
    frequent.counts = total[:own].astype(np.int64)
    return Classes(frequent, total, int(total.sum()))


def other_words(blocks: DataFrame, frequent: Frequent) -> DataFrame:
    """(block, at, word): where a block's vocabulary has words that aren't ``frequent``."""

    def run(batches):
        for b in batches:
            for block, w in _columns(b, "block", "words"):
                w = np.frombuffer(w, "<u8")
                at = np.flatnonzero(frequent.place(w) < 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at.astype(np.int32)), pa.array(w[at].view(np.int64))], names=["block", "at", "word"])

    return blocks.select("block", "words").mapInArrow(run, "block long, at int, word long")


def packed_rows(found: DataFrame, longs: list[str]) -> DataFrame:
    """(block, data): many (at, ``longs``) of a block in one compressed value, some rows a block and task."""

    def run(batches):
        held, n = [], 0
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(b)
                n += b.num_rows
            if held and (b is None or n >= 500_000):
                block, at, *rest = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2 + len(longs)))
                order = np.lexsort((at, block))
                block, at, rest = block[order], at[order].astype(np.int64), [x[order] for x in rest]
                ids, first = np.unique(block, return_index=True)
                ends = np.append(first[1:], len(block))
                data = [pack(np.concatenate([np.diff(at[x:y], prepend=0), *(r[x:y] for r in rest)]), 8) for x, y in zip(first, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(data, pa.binary())], names=["block", "data"])
                held, n = [], 0

    return found.select("block", "at", *longs).mapInArrow(run, "block long, data binary")


@dataclass
class Classes:
    """How words map to classes in the tied passes, and the classes' training tokens."""

    frequent: Frequent  # words that are classes of their own, numbered as they stand there
    total: np.ndarray  # training tokens of each class
    tokens: int

    @property
    def n(self) -> int:
        return len(self.total)  # the last class is the unseen outcome

    def of(self, word: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        own = self.frequent.place(word)
        return np.where(own >= 0, own, len(self.frequent.words) + suffix.astype(np.int64))


@dataclass
class Model:
    start: np.ndarray  # S
    move: np.ndarray  # S x S
    emit: np.ndarray  # classes x S


def time_major(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, active, index): documents by falling length; how many are active at each time; for each (time,
    document) in that order the token's place in the documents' concatenation."""
    order = np.argsort(-lengths, kind="stable")
    n = lengths[order]
    active = len(n) - np.searchsorted(n[::-1], np.arange(1, n[0] + 1) if len(n) else [], "left")
    first = (np.cumsum(lengths) - lengths)[order]
    doc = ragged(np.zeros(len(active), np.int64), active)
    time = np.repeat(np.arange(len(active)), active)
    return order, active, first[doc] + time


def forward(model: Model, emitted: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward variables and scales, time by time; ``emitted``: each token's class in each state."""
    alpha, scale, at = np.empty_like(emitted), np.empty(len(emitted)), 0
    now = np.broadcast_to(model.start, (int(active[0]), len(model.start)))
    for t, n in enumerate(active.tolist()):
        now = (now[:n] @ model.move if t else now) * emitted[at : at + n]
        c = now.sum(1)
        now /= c[:, None]
        alpha[at : at + n], scale[at : at + n] = now, c
        at += n
    return alpha, scale


def expected(model: Model, cls: np.ndarray, lengths: np.ndarray, n_out: int, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts (start, move, emit) of the documents, and their log likelihood. Emissions are counted by
    class, or by ``out`` where that is given."""
    s = len(model.start)
    start, move, emit, total = np.zeros(s), np.zeros((s, s)), np.zeros((n_out, s)), 0.0
    for docs in chunks(lengths):
        order, active, index = time_major(lengths[docs])
        where = ragged((np.cumsum(lengths) - lengths)[docs], lengths[docs])[index]
        e = model.emit[cls[where]]
        counted = (cls if out is None else out)[where]
        alpha, scale = forward(model, e, active)
        total += float(np.log(scale).sum())
        beta = np.ones((int(active[-1]), s))
        gamma = alpha  # becomes alpha * beta in place, from the end
        ends = np.cumsum(active)
        for t in range(len(active) - 1, 0, -1):
            a, b, n = ends[t] - active[t], ends[t], int(active[t])
            ahead = e[a:b] * beta / scale[a:b, None]
            before = alpha[a - active[t - 1] : a]
            move += before[:n].T @ ahead
            gamma[a:b] *= beta
            beta = np.ones((int(active[t - 1]), s))
            beta[:n] = ahead @ model.move.T
        gamma[: active[0]] *= beta
        start += gamma[: active[0]].sum(0)
        for k in range(s):
            emit[:, k] += np.bincount(counted, weights=gamma[:, k], minlength=n_out)
    return start, move * model.move, emit, total


def chunks(lengths: np.ndarray):
    """Documents (positions) in groups of like length and of bounded tokens; a longer one is alone."""
    order = np.argsort(-lengths, kind="stable")
    ends = np.cumsum(lengths[order])
    k = 0
    while k < len(order):
        base = ends[k - 1] if k else 0
        to = max(k + 1, int(np.searchsorted(ends, base + CHUNK_TOKENS, "right")))
        yield order[k:to]
        k = to


def updated(start: np.ndarray, move: np.ndarray, emit: np.ndarray, classes: Classes) -> Model:
    """The next model from expected counts; words never seen have no part in it yet."""
    s = len(start)
    base = classes.total / max(classes.tokens, 1)
    e = emit + PRIOR * base[:, None]
    norm = e.sum(0)
    e = e / np.where(norm > 0, norm, 1)
    start, move = start + PRIOR_MOVE / s, move + PRIOR_MOVE / s
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), e)


def starting_model(cls: np.ndarray, lengths: np.ndarray, classes: Classes, states: int = STATES, passes: int = SAMPLE_PASSES) -> Model:
    """Baum-Welch on a few documents, from sticky states and unigram emissions with noise."""
    rng = np.random.default_rng(5)
    noise = np.exp(rng.normal(0, 1.0, (classes.n, states)))
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9)
    model = updated(np.ones(states), move * 1000, classes.total[:, None] * noise, classes)
    for _ in range(passes if len(lengths) else 0):
        model = updated(*expected(model, cls, lengths, classes.n)[:3], classes)
    return model


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _training(b: pa.RecordBatch, k: int, classes: Classes):
    """Of row k of blocks: which documents are for training, all lengths and tokens, and the vocabulary's classes."""
    get = lambda c: b.column(b.schema.get_field_index(c))[k].as_py()
    cls = classes.of(np.frombuffer(get("words"), "<u8"), np.frombuffer(get("suffix"), "<u2"))
    return np.flatnonzero(np.array(get("train"), bool)), unpack(get("length"), 4), unpack(get("tokens"), 4), cls


def baum_welch_pass(blocks: DataFrame, model: Model, classes: Classes) -> tuple[Model, float, np.ndarray]:
    """The next model by one pass over all training documents of ``blocks``, the log likelihood of a training
    token under ``model``, in nats, and the expected counts of each class by state."""
    s = len(model.start)
    names = [f"s{k}" for k in range(s)]
    schema = T.StructType([T.StructField("key", T.LongType()), *(T.StructField(x, T.DoubleType()) for x in names)])

    def run(batches):
        start, move, emit, total, any_ = np.zeros(s), np.zeros((s, s)), np.zeros((classes.n, s)), 0.0, False
        for b in batches:
            for k in range(b.num_rows):
                use, lengths, tokens, cls = _training(b, k, classes)
                if not len(use):
                    continue
                mine = cls[tokens[ragged((np.cumsum(lengths) - lengths)[use], lengths[use])]]
                x, y, z, one = expected(model, mine, lengths[use], classes.n)
                start, move, total, any_ = start + x, move + y, total + one, True
                emit += z
        if any_:
            seen = np.flatnonzero(emit.any(1))
            # single precision halves what is shuffled; the sums are double
            rows = np.concatenate([np.full((1, s), total), start[None], move, emit[seen].astype(np.float32)])
            key = np.concatenate([[-1], [-2], -3 - np.arange(s), seen])
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(s))], names=schema.names)

    got = blocks.select("train", "length", "tokens", "words", "suffix").mapInArrow(run, schema).groupBy("key").agg(*(F.sum(x).alias(x) for x in names)).collect()
    total, start, move, emit = np.zeros(s), np.zeros(s), np.zeros((s, s)), np.zeros((classes.n, s))
    for key, *x in got:
        (emit[key] if key >= 0 else total if key == -1 else start if key == -2 else move[-3 - key])[:] = x
    return updated(start, move, emit, classes), float(total[0]) / max(classes.tokens, 1), emit


def byte_rows(p: np.ndarray) -> list[np.ndarray]:
    """Rows of shares (0 to 1) as bytes, eight in a long; one array for every eight columns."""
    q = np.zeros((len(p), -(-p.shape[1] // 8) * 8), np.uint8)
    q[:, : p.shape[1]] = np.rint(p * 255)
    longs = q.view("<i8")
    return [np.ascontiguousarray(longs[:, j]) for j in range(longs.shape[1])]


def row_bytes(longs: list[np.ndarray], s: int) -> np.ndarray:
    """The bytes (0 to 255) of ``byte_rows``."""
    return np.stack(longs, 1).astype("<i8").view(np.uint8)[:, :s]


def _byte(k: int) -> Column:
    return F.shiftrightunsigned(F.col(f"a{k // 8}"), k % 8 * 8).bitwiseAND(F.lit(255))


def word_states(blocks: DataFrame, model: Model, classes: Classes, held: np.ndarray) -> DataFrame:
    """(word, suffix, c, a0..): for each training word that isn't frequent its count and the shares of its states,
    by one pass over all training documents and one shuffle of narrow rows. ``held``: the classes' expected counts
    by state. No share is 0."""
    s, own = len(model.start), len(classes.frequent.words)
    longs = [f"a{j}" for j in range(-(-s // 8))]
    of_class = held[own : own + SUFFIX_CLASSES + 1] + 1 / s
    of_class = of_class / of_class.sum(1, keepdims=True)

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                use, lengths, tokens, cls = _training(b, k, classes)
                n = unpack(b.column(b.schema.get_field_index("counts"))[k].as_py(), 4)
                at = np.flatnonzero((cls >= own) & (n > 0))
                if not len(at):
                    continue
                out = np.full(len(n), len(at))  # the last row takes all frequent words
                out[at] = np.arange(len(at))
                mine = tokens[ragged((np.cumsum(lengths) - lengths)[use], lengths[use])]
                e = expected(model, cls[mine], lengths[use], len(at) + 1, out[mine])[2][:-1]
                words_ = np.frombuffer(b.column(b.schema.get_field_index("words"))[k].as_py(), "<i8")[at]
                yield pa.RecordBatch.from_arrays([pa.array(words_), pa.array(n[at] << 12 | cls[at] - own), *map(pa.array, byte_rows(e / e.sum(1, keepdims=True)))], names=["word", "m", *longs])

    def smooth(batches):
        for b in batches:
            suffix, c = b.column(1).to_numpy(), b.column(2).to_numpy()
            sums = np.stack([b.column(3 + k).to_numpy() for k in range(s)], 1) / 255
            p = (sums + OWN_PRIOR * of_class[suffix]) / (sums.sum(1) + OWN_PRIOR)[:, None]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *map(pa.array, byte_rows(np.maximum(p, 1 / 255)))], names=["word", "suffix", "c", *longs])

    # narrow rows are dealt out first: sums made before the shuffle would be three times as wide and seldom meet
    rows = blocks.select("train", "length", "tokens", "words", "suffix", "counts").mapInArrow(run, "word long, m long, " + ", ".join(f"{x} long" for x in longs))
    n = F.shiftright("m", 12)
    sums = rows.repartition("word").groupBy("word").agg(F.min(F.col("m").bitwiseAND(F.lit(4095))).alias("suffix"), F.sum(n).alias("c"), *(F.sum(n * _byte(k)).alias(f"s{k}") for k in range(s)))
    return sums.mapInArrow(smooth, "word long, suffix long, c long, " + ", ".join(f"{x} long" for x in longs))


@dataclass
class Fitted:
    """The coded blocks of all documents, the classes, the model with its unseen outcome, the log likelihood of a
    training token before each tied pass, and what splits the classes: the table of the other words, and for each
    suffix class and state the sum of its words' counts times shares."""

    blocks: DataFrame
    classes: Classes
    model: Model
    likelihoods: list[float]
    states: DataFrame
    norm: np.ndarray
    types: int


SCORES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
    T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
])


def placed(blocks: DataFrame, frequent: Frequent) -> DataFrame:
    """Blocks without hashes: ``place`` has 1 and the number of each frequent word, 0 for the others."""

    def run(batches):
        for b in batches:
            place = [pack(frequent.place(np.frombuffer(w, "<u8")) + 1, 4) for w in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(place, pa.binary())], names=["block", "doc_id", "length", "tokens", "place"])

    return blocks.select("block", "doc_id", "length", "tokens", "words").mapInArrow(run, "block long, doc_id array<long>, length binary, tokens binary, place binary")


def scored(f: Fitted) -> DataFrame:
    """Scores of all documents of the blocks."""
    classes, model, norm, types, s = f.classes, f.model, f.norm, f.types, len(f.model.start)
    own, longs = len(classes.frequent.words), [c for c in f.states.columns if c[0] == "a"]

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], _arrow(SCORES))
        get = lambda c: left[c][0].as_py()
        lengths, tokens, place = (unpack(get(c), 4) for c in ("length", "tokens", "place"))
        place -= 1
        count = np.where(place >= 0, np.append(classes.frequent.counts, 0)[place], 0)
        emit = np.where((place >= 0)[:, None], model.emit[place], model.emit[-1])
        for data in right["data"].to_pylist():
            at, m, *rest = unpack(data, 8).reshape(2 + len(longs), -1)
            at, c, suffix = np.cumsum(at), m >> 12, m & 4095
            count[at] = c
            emit[at] = model.emit[own + suffix] * (c[:, None] * row_bytes(rest, s) / norm[suffix])
        owner, first = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths) - lengths
        base = np.log10((count + 0.1) / (classes.tokens + 0.1 * (types + 1)))
        score = np.zeros(len(lengths))
        for docs in chunks(lengths):
            order, active, index = time_major(lengths[docs])
            mine = tokens[ragged(first[docs], lengths[docs])][index]
            _, scale = forward(model, emit[mine], active)
            doc = ragged(np.zeros(len(active), np.int64), active)
            score[docs[order]] = np.bincount(doc, weights=np.log10(scale), minlength=len(docs))
        sums = lambda x: np.bincount(owner, weights=x[tokens], minlength=len(lengths))
        return pa.table(
            [pa.array(get("doc_id"), pa.int64()), pa.array(lengths), pa.array(sums(count > 0).astype(np.int64)), pa.array(np.full(len(lengths), classes.tokens, np.int64)), pa.array(sums(base)), pa.array(score)],
            names=SCORES.names,
        )

    rows = f.states.select("word", F.shiftleft("c", 12).bitwiseOR(F.col("suffix")).alias("m"), *longs)
    looked_up = packed_rows(other_words(f.blocks, classes.frequent).join(rows, "word"), ["m", *longs])
    return placed(f.blocks, classes.frequent).groupBy("block").cogroup(looked_up.groupBy("block")).applyInArrow(one, SCORES)


def _sample(blocks: DataFrame, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Class sequences of whole training documents, those with the smallest hashed ids within the sample's bounds."""

    def sizes(batches):
        for b in batches:
            for k in range(b.num_rows):
                use = np.array(b.column(b.schema.get_field_index("train"))[k].as_py(), bool)
                ids = b.column(b.schema.get_field_index("doc_id"))[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([i for i, u in zip(ids, use) if u], pa.int64()), pa.array(unpack(b.column(b.schema.get_field_index("length"))[k].as_py(), 4)[use])], names=["id", "n"])

    few = blocks.select("doc_id", "train", "length").mapInArrow(sizes, "id long, n long").orderBy(F.col("n") > SAMPLE_LONG, F.xxhash64("id"), "id").limit(SAMPLE).collect()
    before = np.cumsum([r.n for r in few]) - [r.n for r in few] if few else []
    held = {r.id for r, x in zip(few, before) if x < SAMPLE_TOKENS and (r.n <= SAMPLE_LONG or not x)}

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                wanted = [d for d, (i, t) in enumerate(zip(*(b.column(b.schema.get_field_index(c))[k].as_py() for c in ("doc_id", "train")))) if t and i in held]
                if not wanted:
                    continue
                _, lengths, tokens, cls = _training(b, k, classes)
                first = np.cumsum(lengths) - lengths
                for d in wanted:
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(b.schema.get_field_index("doc_id"))[k][d].as_py()]), pa.array([cls[tokens[first[d] : first[d] + lengths[d]]].astype("<i4").tobytes()], pa.binary())], names=["doc_id", "classes"])

    got = sorted(blocks.drop("counts").mapInArrow(run, "doc_id long, classes binary").collect(), key=lambda r: (r.doc_id, r.classes)) if held else []
    seqs = [np.frombuffer(r.classes, "<i4") for r in got]
    return np.concatenate(seqs) if seqs else np.zeros(0, np.int32), np.array([len(x) for x in seqs], np.int64)


def fit_hmm(docs: DataFrame, train: Column, states: int = STATES, passes: int = PASSES, rise: float = RISE, own_classes: int = OWN_CLASSES) -> Fitted:
    """The model of the rows of ``docs`` (doc_id, text) where ``train`` holds, and the coded blocks of all rows."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "hmm")
    use = F.coalesce(train & F.col("doc_id").isNotNull(), F.lit(False))
    blocks = scratch.table(coded(docs.select("doc_id", "text", use.alias("train"))), "blocks")
    classes = fit_classes(blocks, own_classes)
    model, seen, held = starting_model(*_sample(blocks, classes), classes, states), [], np.zeros((classes.n, states))
    for _ in range(passes):
        model, one, held = baum_welch_pass(blocks, model, classes)
        seen.append(one)
        if len(seen) > 1 and seen[-1] - seen[-2] < rise:
            break
    words_ = scratch.table(word_states(blocks, model, classes, held), "words")
    norm, types, once = np.ones((SUFFIX_CLASSES + 1, states)), int((classes.frequent.counts > 0).sum()), int((classes.frequent.counts == 1).sum())
    sums = (F.sum(F.col("c") * _byte(k)).alias(f"z{k}") for k in range(states))
    for suffix, v, v1, *z in words_.groupBy("suffix").agg(F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("once"), *sums).collect():
        norm[suffix], types, once = z, types + v, once + v1
    n = classes.tokens
    unseen = min(0.5, max(once / n, 0.1 / (n + 0.1 * (types + 1)))) if n else 1.0
    emit = model.emit * (1 - unseen)
    emit[-1] = unseen
    return Fitted(blocks, classes, Model(model.start, model.move, emit), seen, words_, norm, types)


def hmm_scores(docs: DataFrame, train: Column, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """Scores every row of ``docs`` (doc_id, text) by a model of the rows where ``train`` holds.

    Tokens are runs without space, tab to carriage return, A-Z lower-cased, then one end. Returns doc_id,
    n_tokens, n_known (tokens seen in training), train_tokens, base_score (unigrams with 0.1 added) and score
    (log10 of the exact likelihood). A null text is empty: one end. Rows without a doc_id are scored but never
    trained on; repeated rows are scored, and trained on, each; an empty training set leaves one outcome of
    probability 1; an empty table gives no rows."""
    return scored(fit_hmm(docs, train, states, passes))
