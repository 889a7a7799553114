"""Directory scans: file listing, glob filters, per-file admission, parsing of extensions and front matter."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

MAX_BYTES, MAX_AVERAGE_LINE = 50 << 20, 1000
# Base names, in lower case, that have a file type without an extension, and those that have it also
# with anything after a dot.
VIRTUAL_EXTENSIONS = {
    "makefile": ".makefile", "gnumakefile": ".makefile", "vagrantfile": ".vagrantfile", "gemfile": ".gemfile",
    "rakefile": ".rakefile", "brewfile": ".brewfile", "procfile": ".procfile",
}
VIRTUAL_PREFIXES = {"dockerfile": ".dockerfile", "jenkinsfile": ".jenkinsfile"}


def admission_status(text: Column, size: Column, known: Column, old_hash: Column | None = None, max_size: int = MAX_BYTES) -> Column:
    """What becomes of a file, the first that applies: too_large, unchanged, minified (long average lines),
    unknown_extension, empty (nothing but white space), indexed."""
    average = F.length(text) / F.size(F.split(text, "\n"))
    out = F.when(size > max_size, "too_large")
    if old_hash is not None:
        out = out.when(old_hash.eqNullSafe(tx.content_hash(text)), "unchanged")
    return out.when(average > MAX_AVERAGE_LINE, "minified").when(~known, "unknown_extension").when(~text.rlike(r"\S"), "empty").otherwise("indexed")


def no_longer_indexed(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    """file_id of ``stored`` files (file_id, path) whose last scan (path, status) ended in a skip for good: what was
    indexed of them before must go (see store.remove_files)."""
    skipped = scanned.where(F.col("status").isin("too_large", "minified", "unknown_extension", "empty"))
    return stored.join(skipped.select("path").distinct(), "path", "left_semi").select("file_id")


def extension(path: Column | str) -> Column:
    """The extension, also of files known by their base name, without regard to case."""
    base = F.lower(tx.basename(path))
    own = F.regexp_extract(base, r"(?<=.)(\.[^.]+)$", 1)
    out = None
    for name, ext in VIRTUAL_PREFIXES.items():
        when = (base == name) | base.startswith(f"{name}.")
        out = F.when(when, ext) if out is None else out.when(when, ext)
    for name, ext in VIRTUAL_EXTENSIONS.items():
        out = out.when(base == name, ext)
    return out.otherwise(own)


def front_matter(text: Column | str) -> Column:
    """struct(meta: map of the keys of a leading --- block, body). Only plain ``key: value`` lines are read."""
    t = tx.col(text)
    block = F.regexp_extract(t, r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 1)
    pairs = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^\w[\w-]*:\s*\S"))
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^(\w[\w-]*):", 1).alias("key"), F.regexp_replace(F.regexp_replace(x, r"^\w[\w-]*:\s*", ""), r"^[\"'\[]|[\"'\]]$", "").alias("value")))
    unique = F.map_from_entries(F.filter(entries, lambda e: F.lit(True)))
    return F.struct(F.when(block != "", unique).alias("meta"), F.regexp_replace(t, r"(?s)\A---\r?\n.*?\r?\n---(?:\r?\n|\z)", "").alias("body"))


def weighted_text(text: Column | str) -> Column:
    """The body after its front matter's name, description, type and tags, which so weigh more."""
    f = front_matter(text)
    keys = [F.when(f["meta"][k].isNotNull(), F.concat(F.lit(f"{k}: "), f["meta"][k])) for k in ("name", "description", "type", "tags")]
    return F.concat_ws("\n", *keys, f["body"])


def git_files(root: str) -> list[str] | None:
    """Files that git tracks or doesn't ignore; None if there are none or this is no repository, so that a scan
    falls back to walking and never takes all files for deleted."""
    try:
        out = subprocess.run(["git", "-C", root, "ls-files", "--cached", "--others", "--exclude-standard", "-z"], capture_output=True, check=True).stdout
    except (OSError, subprocess.CalledProcessError):
        return None
    return [x.decode() for x in out.split(b"\0") if x] or None


def scan_directory(spark: SparkSession, root: str, include: list[str], exclude: list[str], known: list[str] | None = None, use_git: bool = True) -> DataFrame:
    """path (relative), size, modified, text, hash, status of the files under ``root`` that pass the globs.
    Spark's reader passes over files without a byte."""
    base = Path(root).resolve().as_posix()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    path = tx.project_relative(F.regexp_replace("path", r"^file:/*", "/"), base)
    f = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))
    f = f.where(tx.included("path", include) & ~tx.excluded("path", exclude))
    listed = git_files(root) if use_git else None
    if listed is not None:
        f = f.join(spark.createDataFrame([(x,) for x in listed], "path string"), "path", "left_semi")
    ok = extension("path").isin(*known) if known else F.lit(True)
    return f.select("*", tx.content_hash("text").alias("hash"), admission_status(F.col("text"), F.col("size"), ok).alias("status"))
