"""Byte-level BPE by monoid tree reduction.

A text's halves are encoded recursively and joined by re-encoding a window around the seam. The window's
ends are places where tokens outside are provably stable: a white-space character after one that surely
isn't white space. Matches of the split pattern never cross such a place, what precedes is matched alike
with or without what follows, and a match depends on nothing before it. So for such places a and b

    encode(L + R) = encode(L[:a]) + encode(L[a:] + R[:b]) + encode(R[b:])

and the first and last terms are the known ids less those of L[a:] and R[:b]. Windows double until both
ends are found; at worst they reach the halves' own ends, where the identity holds trivially. Joining is
associative, so halves may come from anywhere. Decoding concatenates bytes up the same kind of tree."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import encoding, ranks, token_bytes
from .common import ship
from .textkernel import rows_of

LEAF, WINDOW = 4096, 64
#: White space after an ASCII graphic character or a letter of Latin, Greek or Cyrillic.
_STABLE = re.compile(r"(?<=[!-~À-ӿ])[ \t\n\r]")


class TreeCodec:
    def __init__(self, path: str, pattern: str, leaf: int = LEAF):
        self.enc, self.size, self.leaf = encoding(path, pattern), token_bytes(path), leaf
        self.bytes_of = {i: t for t, i in ranks(path).items()}

    def encode(self, text: str) -> np.ndarray:
        """The ids of ``text``, as of encoding it whole."""
        n = len(text)
        if n <= self.leaf:
            return self.enc.encode_to_numpy(text, disallowed_special=())
        return self.join(text, n // 2, self.encode(text[: n // 2]), self.encode(text[n // 2 :]))

    def join(self, text: str, seam: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """ids of ``text`` from those of text[:seam] and text[seam:]."""
        a, w = 0, WINDOW
        while w < seam:
            # last stable place in the window; the character before it must be seen too
            found = None
            for found in _STABLE.finditer(text, seam - w, seam):
                pass
            if found:
                a = found.start()
                break
            w *= 2
        b, w = len(text), WINDOW
        while seam + w < len(text):
            if found := _STABLE.search(text, seam + 1, seam + w):
                b = found.start()
                break
            w *= 2
        drop = self._spanning(left[::-1], len(text[a:seam].encode()))
        skip = self._spanning(right, len(text[seam:b].encode()))
        middle = self.enc.encode_to_numpy(text[a:b], disallowed_special=())
        return np.concatenate([left[: len(left) - drop], middle, right[skip:]])

    def _spanning(self, ids: np.ndarray, size: int) -> int:
        """How many of the first ids make up ``size`` bytes."""
        if not size:
            return 0
        n = 64
        while True:
            ends = np.cumsum(self.size[ids[:n]])
            if ends[-1] >= size:
                k = int(np.searchsorted(ends, size))
                assert ends[k] == size, "a token crosses a stable place"
                return k + 1
            n *= 4

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        h = len(ids) // 2
        return self.decode(ids[:h]) + self.decode(ids[h:])


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])
DECODED = T.StructType([*ENCODED.fields, T.StructField("decoded", T.BinaryType())])


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) of every row of ``docs`` (doc_id, text).

    A null text is empty: no ids. Rows are independent; repeated rows and rows without a doc_id are encoded
    too. Other columns are ignored."""
    ship(docs.sparkSession)

    def run(batches):
        codec = TreeCodec(vocabulary, pattern, leaf)
        for b in rows_of(batches):
            ids = [codec.encode(t or "").astype("<u4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def decode_ids(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the bytes the ids stand for. Null ids are none; an id outside the
    vocabulary is an error."""
    ship(encoded.sparkSession)

    def run(batches):
        codec = TreeCodec(vocabulary, pattern)
        for b in batches:
            out = [codec.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED)
