"""Language identification by compression.

Each language has a raw-content Zstandard dictionary made of whole training texts. A text is compressed with
every dictionary, window by window, each afresh, so that every part of a long text counts; the language with
the smallest sum wins. The margin is what the runner-up needs more, as a share of its sum; where it is narrow
the prediction is marked as rejected."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, ship, with_ids
from .textkernel import rows_of

UNDETERMINED = "und"
#: What bounds the model: whole training documents a language at most, and bytes after which no further
#: document is taken. Longer documents than LONG bytes are taken only if shorter ones don't suffice.
SAMPLE_DOCS, SAMPLE_BYTES, LONG = 192, 1 << 20, 64 << 10
LEVEL = 5
#: Bytes of normalised text that are compressed at once.
WINDOW = 4096
#: Share of the runner-up's bytes saved, below which a prediction is rejected; fitted on held-out rows.
MIN_MARGIN = 0.03
#: Bytes of difference that change the odds of two languages by e.
SCALE = 4.0


_OTHER = re.compile(r"[\W\d_]+")
#: ASCII letters to lower case, all other bytes to a space.
_ASCII = bytes(c | 32 if chr(c).isascii() and chr(c).isalpha() else 32 for c in range(256))

PREDICTED = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
])


def normal(text: str) -> bytes:
    """Lower-cased letters (Unicode category L) in words with one space between them. Symbols, digits and layout
    say little about the language, and lower-casing makes shouted text comparable."""
    if text.isascii():
        return b" ".join(text.encode().translate(_ASCII).split())
    words = _OTHER.sub(" ", text.lower()).split()
    if not all(map(str.isalpha, words)):  # what is left besides letters are number characters such as fractions
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    return " ".join(words).encode()


def train_dictionaries(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, long: int = LONG) -> dict[str, bytes]:
    """Language: dictionary, from rows of ``docs`` (doc_id, text, lang) with a language and a text with letters.

    Takes whole texts of at most ``sample_docs`` documents of each language, those with the smallest hash of
    their id (a partition passes on no more than that many rows a language), and stops after ``sample_bytes``;
    documents of more than ``long`` bytes come last, so that a language of long documents has one at least.
    Ids are ranked first; the chosen ones are sent to the scan, which moves no other text."""
    fit = docs.where("lang is not null and doc_id is not null and text is not null")
    size = F.octet_length("text")
    rank = Window.partitionBy("lang").orderBy("long", "h", "doc_id")
    few = fit.select("doc_id", "lang", (size > long).alias("long"), F.xxhash64("doc_id").alias("h"), size.alias("size")).withColumn("n", F.row_number().over(rank)).where(F.col("n") <= sample_docs)
    before = F.coalesce(F.sum("size").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = few.withColumn("before", before).where(F.col("before") < sample_bytes)
    scratch = Scratch(docs.sparkSession, "language")
    chosen = scratch.table(few.select("doc_id").distinct(), "chosen")
    rows = with_ids(fit.select("doc_id", "lang", "text"), chosen, "doc_id").select("lang", "doc_id", "text").collect()
    scratch.drop(chosen)
    texts: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.doc_id, r.text)):
        if data := normal(r.text):
            texts.setdefault(r.lang, []).append(data)
    # equal size for all, that of the largest: a longer dictionary would win by its length alone, and a shorter
    # one where nothing matches; shorter ones are filled up with shuffled bytes, which match nothing either
    joined = {k: b" ".join(v) for k, v in texts.items()}
    most = max(joined.values(), key=lambda v: (len(v), v), default=b"").ljust(8)
    filler = np.random.default_rng(7).permutation(np.frombuffer(most, np.uint8)).tobytes()
    return {k: filler[: len(most) - len(v)] + v for k, v in sorted(joined.items())}


@lru_cache(1)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...], level: int):
    out = []
    for name, data in dictionaries:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level)
        out.append((name, zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)))
    return out


def classify(text: str | None, compressors, min_margin: float = MIN_MARGIN) -> tuple[str, float, float, bool]:
    """(language, score, margin, rejected) of one whole text. Of equal sums the language first by name wins, with
    margin 0, so rejected."""
    data = normal(text or "")
    if not data or not compressors:
        return UNDETERMINED, 0.0, 0.0, True
    windows = [data[a : a + WINDOW] for a in range(0, len(data), WINDOW)]
    sizes = [(sum(len(c.compress(w)) for w in windows), name) for name, c in compressors]
    (best, name), *rest = sorted(sizes)
    score = 1 / (1 + sum(math.exp(min(0.0, (best - n) / SCALE)) for n, _ in rest))
    margin = (rest[0][0] - best) / rest[0][0] if rest else 1.0
    return name, score, margin, margin < min_margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], level: int = LEVEL, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Two struct columns for each row of ``docs``: row (the row itself, whatever its columns' names) and
    language: lang_pred, score (0 to 1), margin, rejected.

    Only the text is looked at, whole. A null text or one without a letter (Unicode category L) is ``und``,
    score 0 and rejected; so is every text if nothing was learned. All rows stay, repeated ones and those
    without a doc_id too. A very long text is compressed window by window. An empty table gives no rows."""
    ship(docs.sparkSession)
    held = tuple(dictionaries.items())

    def run(batches):
        c = _compressors(held, level)
        for b in rows_of(batches, text=lambda b: b.column(0).field("text")):
            got = [classify(t, c, min_margin) for t in b.column(0).field("text").to_pylist()]
            columns = [pa.array([r[k] for r in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.StructArray.from_arrays(columns, PREDICTED.names)], names=["row", "language"])

    return docs.select(F.struct(*docs.columns).alias("row")).mapInArrow(run, T.StructType([T.StructField("row", docs.schema), T.StructField("language", PREDICTED)]))
