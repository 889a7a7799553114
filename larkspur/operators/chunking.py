"""Chunkers. Size and blank-line splitting are expressions; formats with a grammar are one table function that
runs in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..runtime import ship

SIZE, OVERLAP, TINY = 1500, 200, 100


def split_by_size(text: Column | str, size: int, overlap: int) -> Column:
    """Sliding windows of characters; the overlap is at most size - 1; nothing for an empty text."""
    t, overlap = tx.col(text), min(overlap, size - 1)
    starts = F.sequence(F.lit(0), F.greatest(F.length(t) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.substring(t, i + 1, F.lit(size))))


def split_blank_lines(text: Column | str) -> Column:
    return F.split(tx.col(text), r"\n\n+")


def merge_tiny(parts: Column | str, least: int = TINY, separator: str = "\n\n") -> Column:
    """Trimmed parts, each joined to the one before while both together are shorter than ``least``."""
    trimmed = F.filter(F.transform(tx.col(parts), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(a: Column, p: Column) -> Column:
        joined = F.when(a["buf"] == "", p).otherwise(F.concat(a["buf"], F.lit(separator), p))
        fits = F.length(a["buf"]) + F.length(p) < least
        out = F.when(fits | (a["buf"] == ""), a["out"]).otherwise(F.concat(a["out"], F.array(a["buf"])))
        return F.struct(out.alias("out"), F.when(fits, joined).otherwise(p).alias("buf"))

    return F.aggregate(trimmed, start, step, lambda a: F.when(a["buf"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["buf"]))))


def _cut_at(text: str, opens: Callable[[str], bool]) -> list[str]:
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        if opens(line) and any(x.strip() for x in out[-1]):
            out.append([])
        out[-1].append(line)
    return ["\n".join(x) for x in out]


def _markdown(text: str) -> list[str]:
    fence = None

    def opens(line: str) -> bool:
        nonlocal fence
        if m := re.match(r"\s*(```|~~~)", line):
            fence = None if fence == m[1] else fence or m[1]
        return fence is None and bool(re.match(r"#{1,3} ", line))

    return _cut_at(text, opens)


def _yaml(text: str) -> list[str]:
    out = []
    for part in _cut_at(text, lambda x: bool(re.match(r"[A-Za-z_][\w-]*\s*:", x))):
        if part.startswith("paths:"):
            out += _cut_at(part, lambda x: bool(re.match(r"  /\S*:", x)))
        else:
            out.append(part)
    return out


def _json(text: str) -> list[str] | None:
    try:
        data = json.loads(text)
    except ValueError:
        return None
    show = lambda x: json.dumps(x, indent=2, ensure_ascii=False)
    if isinstance(data, list):
        return [f"[{k}]: {show(x)}" for k, x in enumerate(data)]
    if isinstance(data, dict):
        out = []
        for k, v in data.items():
            if k == "paths" and isinstance(v, dict) and ("openapi" in data or "swagger" in data):
                out += [f'paths["{p}"]: {show(x)}' for p, x in v.items()]
            else:
                out.append(f'"{k}": {show(v)}')
        return out
    return [text]


def _python(text: str) -> list[str] | None:
    """Top-level definitions by the standard library's parser, and what lies between them."""
    import ast

    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return None
    lines, out, at = text.split("\n"), [], 0
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)]) - 1
            out += ["\n".join(lines[at:first]), "\n".join(lines[first : node.end_lineno])]
            at = node.end_lineno
    return [*out, "\n".join(lines[at:])]


#: Extension: splitter into sections; None from a splitter means it can't read the text.
SPLITTERS: dict[str, Callable[[str], list[str] | None]] = {
    ".md": _markdown, ".mdx": _markdown, ".yaml": _yaml, ".yml": _yaml, ".json": _json, ".py": _python,
    ".dockerfile": lambda t: _cut_at(t, lambda x: bool(re.match(r"(?i)FROM ", x))),
    ".bru": lambda t: _cut_at(t, lambda x: bool(re.match(r"[\w:-]+ \{", x))),
    ".toml": lambda t: _cut_at(t, lambda x: bool(re.match(r"\s*\[\[?", x))),
    ".sql": lambda t: re.split(r"(?<=;)\s*\n", t),
    ".makefile": lambda t: _cut_at(t, lambda x: bool(re.match(r"[^\s#:=][^:=]*:(?!=)", x))),
}
_MERGES = {".dockerfile", ".bru", ".toml", ".sql", ".makefile", ".yaml", ".yml", ".md", ".mdx"}


def chunk_text(text: str, ext: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[str, int | None, int | None]]:
    """(chunk, first line, last line) of one text. Small texts are one chunk (but for Markdown); sections of a known
    format, else blank-line blocks; tiny ones merge, oversized ones slide. Chunks that aren't verbatim have no lines."""
    if not text.strip():
        return []
    split = SPLITTERS.get(ext)
    if len(text) <= size and ext not in (".md", ".mdx"):
        parts = [text]
    else:
        parts = split(text) if split else None
        merges = parts is None or ext in _MERGES
        parts = re.split(r"\n\n+", text) if parts is None else parts
        parts = [p.strip("\n") if not merges else p.strip() for p in parts if p.strip()]
        if merges and ext not in (".md", ".mdx"):
            merged: list[str] = []
            for p in parts:
                if merged and len(merged[-1]) + len(p) < TINY:
                    merged[-1] += "\n\n" + p
                else:
                    merged.append(p)
            parts = merged
    out, at = [], 0
    overlap = min(overlap, size - 1)
    for p in parts:
        pieces = [p] if len(p) <= size else [p[i : i + size] for i in range(0, max(len(p) - overlap, 1), size - overlap)]
        for x in pieces:
            k = text.find(x, at)
            if k < 0:
                out.append((x, None, None))
                continue
            first = text.count("\n", 0, k) + 1
            out.append((x, first, first + x.count("\n")))
            at = k + (1 if len(pieces) > 1 else len(x))
    return out


def chunk_files(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """files (path, ext, text) to path, chunk_index, snippet, start_line, end_line, content_hash."""

    def run(batches):
        for b in batches:
            rows = [(p, k, *c) for p, e, t in zip(*(b.column(i).to_pylist() for i in range(3))) for k, c in enumerate(chunk_text(t or "", e or "", size, overlap))]
            cols = list(zip(*rows)) if rows else [()] * 5
            types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["path", "chunk_index", "snippet", "start_line", "end_line"])

    ship(files.sparkSession)
    out = files.select("path", "ext", "text").mapInArrow(run, "path string, chunk_index int, snippet string, start_line int, end_line int")
    return out.withColumn("content_hash", tx.content_hash("snippet"))


def parent_groups(chunks: DataFrame) -> DataFrame:
    """Synthetic parents of ``chunks`` (file_id, chunk_index, group, snippet, start_line, end_line): groups of two
    members or more become one row of index -1 with the members' texts and their range of lines."""
    g = chunks.where("`group` is not null").groupBy("file_id", "group").agg(
        F.count(F.lit(1)).alias("members"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "snippet"))), lambda x: x["snippet"]), "\n\n").alias("snippet"),
    )
    return g.where("members >= 2").withColumn("chunk_index", F.lit(-1))


def bookend_groups(chunks: DataFrame) -> DataFrame:
    """``chunks`` (file_id, chunk_index, chunk_type, entity_name and others) with group: pieces of one entity that follow
    each other, an opening piece (chunk_type ends in _start), what lies in it, and a closing one (_end) of the same
    entity. Chunks outside any pair have no group."""
    w = Window.partitionBy("file_id").orderBy("chunk_index")
    kind = F.coalesce("chunk_type", F.lit(""))
    c = chunks.withColumn("_open", F.sum(F.when(kind.endswith("_start"), 1).otherwise(0)).over(w)).withColumn("_closed", F.coalesce(F.sum(F.when(kind.endswith("_end"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pairs = Window.partitionBy("file_id", "_open")
    names = F.max(F.when(kind.endswith("_start"), F.col("entity_name"))).over(pairs)
    ends = F.max(F.when(kind.endswith("_end"), F.col("entity_name"))).over(pairs)
    group = F.when((F.col("_open") > F.col("_closed")) & (names == ends), F.col("_open"))
    return c.withColumn("group", group).drop("_open", "_closed")


def flatten_references(chunks: DataFrame) -> DataFrame:
    """chunk_id, name, line from a map of names to lines."""
    return chunks.select("chunk_id", F.explode("references").alias("name", "lines")).select("chunk_id", "name", F.explode("lines").alias("line"))


def first_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
