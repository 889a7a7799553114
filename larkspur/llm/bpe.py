"""Byte-level BPE by a rank file: one text at a time, or whole Arrow batches.

The batch encoder cuts texts before a white-space character that follows one that surely isn't white
space. No match of the split pattern crosses such a place (a match may begin with white space, never hold
it after another character), what comes before is matched alike with or without what comes after, and a
match depends on nothing before it; so the pieces' ids concatenate to the text's ids. Equal pieces are encoded once; a bounded cache serves later batches.

Special tokens, if given, are cut out of texts first and have ids of their own, as the tokenizers library
does with the added tokens of a vocabulary file; without them their strings are ordinary text."""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import tiktoken

from .textkernel import hash_spans, ragged

CACHE = 250_000
_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = True
#: Lead bytes of two-byte characters of which none is white space (U+00C0 and on).
_LEAD2 = np.zeros(256, bool)
_LEAD2[0xC3:0xE0] = True
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x09, 0x0A, 0x0D]] = True


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(4)
def token_bytes(path: str) -> np.ndarray:
    """Length in bytes of each id."""
    r = ranks(path)
    out = np.zeros(max(r.values()) + 1, np.int64)
    for t, i in r.items():
        out[i] = len(t)
    return out


def special_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """(string, id) of the added tokens of a tokenizers vocabulary file."""
    with open(path, encoding="utf-8") as f:
        return tuple((t["content"], t["id"]) for t in json.load(f).get("added_tokens") or ())


def _solid_end(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Whether each span ends with a character that surely isn't white space."""
    return _GRAPHIC[buf[e - 1]] | ((e - s > 2) & _LEAD2[buf[np.maximum(e - 2, 0)]])


class BatchEncoder:
    def __init__(self, path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
        self.path, self.enc = path, encoding(path, pattern)
        self.special = {t.encode(): i for t, i in special}
        self.find = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if special else None
        self.grown: list[tuple[np.ndarray, np.ndarray]] = []
        self.clear()

    def clear(self) -> None:
        raw = np.frombuffer(b"".join(self.special), np.uint8)
        ends = np.cumsum([len(t) for t in self.special], dtype=np.int64)
        h = hash_spans(raw, ends - np.array([len(t) for t in self.special], np.int64), ends)
        self.slot: dict[int, int] = {x: k for k, x in enumerate(h.tolist())}
        self.start, self.length = np.arange(len(h)), np.ones(len(h), np.int64)
        self.ids = np.array(list(self.special.values()), np.uint32)

    def _learn(self, hashes: np.ndarray, raw: bytes, s: np.ndarray, e: np.ndarray, joins: np.ndarray) -> None:
        """Encode new pieces. Those that begin with white space and end without it (joins) tokenise alike
        side by side, so they go as a few long strings; token lengths then tell them apart."""
        size = token_bytes(self.path)
        for one in (False, True):
            pick = np.flatnonzero(joins != one)
            for k in range(0, len(pick), 1 if one else 50_000):
                p = pick[k : k + (1 if one else 50_000)]
                text = b"".join([raw[a:b] for a, b in zip(s[p].tolist(), e[p].tolist())]).decode()
                ids = self.enc.encode_to_numpy(text, disallowed_special=())
                ends = np.searchsorted(np.cumsum(size[ids]), np.cumsum(e[p] - s[p])) + 1
                n = np.diff(ends, prepend=0)
                base = len(self.slot)
                self.slot.update(zip(hashes[p].tolist(), range(base, base + len(p))))
                self.grown.append((ids, n))
        if self.grown:
            n = np.concatenate([self.length, *(x for _, x in self.grown)])
            self.ids = np.concatenate([self.ids, *(x for x, _ in self.grown)])
            self.start, self.length, self.grown = np.cumsum(n) - n, n, []

    def _specials(self, raw: bytes, off: np.ndarray) -> list[int]:
        """Where special tokens begin and end; a match across two texts is none."""
        out, at = [], 0
        while m := self.find.search(raw, at):
            a, b = m.span()
            inside = off[np.searchsorted(off, a, "right") :]
            if whole := not (len(inside) and inside[0] < b):
                out += [a, b]
            at = b if whole else a + 1
        return out

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids)."""
        n = len(buf)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        cut = np.zeros(n, bool)
        cut[1:] = _GRAPHIC[buf[:-1]]
        cut[2:] |= _LEAD2[buf[:-2]]
        cut &= _BREAK[buf]
        edge = off[:-1][off[:-1] < off[1:]]
        cut[edge] = True
        if self.find:
            edges = np.array(self._specials(buf.tobytes(), off), np.int64)
            cut[edges[edges < n]] = True
        s = np.flatnonzero(cut)
        e = np.append(s[1:], n)
        h, first, inv = np.unique(hash_spans(buf, s, e), return_index=True, return_inverse=True)
        if len(self.slot) > CACHE:
            self.clear()
        keys = h.tolist()
        known = np.fromiter(map(self.slot.get, keys, repeat(-1)), np.int64, len(keys))
        if (new := np.flatnonzero(known < 0)).size:
            f = first[new]
            joins = _BREAK[buf[s[f]]] & _solid_end(buf, s[f], e[f])
            self._learn(h[new], buf.tobytes(), s[f], e[f], joins)
            known = np.fromiter(map(self.slot.__getitem__, keys), np.int64, len(keys))
        slots = known[inv]
        length = self.length[slots]
        ids = self.ids[ragged(self.start[slots], length)]
        ends = np.concatenate([[0], np.cumsum(length)])
        return ids, ends[np.searchsorted(s, off)]


@lru_cache(2)
def batch_encoder(path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()) -> BatchEncoder:
    """One for a worker process, with its cache."""
    return BatchEncoder(path, pattern, special)
