"""The snapshot store: tables as Parquet in versioned folders, numbered manifests, changes as rewrites by key."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 2


class Conflict(RuntimeError):
    """Another writer replaced a table that this commit was based on."""


def migrated(held: dict) -> dict:
    """A manifest of any older schema in today's form. Version 1 had one folder a table and no buckets."""
    if held.get("version", SCHEMA_VERSION) > SCHEMA_VERSION:
        raise ValueError(f"the store has schema {held['version']}, newer than {SCHEMA_VERSION}")
    tables = {k: v if isinstance(v, dict) else {"": v} for k, v in held.get("tables", {}).items()}
    return {"version": SCHEMA_VERSION, "identity": held.get("identity", {}), "tables": tables}


class SnapshotStore:
    """Every write goes to a new folder; then a manifest with the next number, which names all folders, is put in
    place without replacing one. A reader takes the highest number, so it sees all of a change or nothing of it,
    whenever a writer fails. Two writers can't take one number: the later one takes up the other's tables, or
    raises Conflict if both replace the same. A manifest of a newer schema, or of vectors of another dimension or
    model, is refused; of an older schema it is brought to today's form."""

    def __init__(self, spark: SparkSession, root: str, identity: dict | None = None, read_only: bool = False):
        self.spark, self.root, self.identity, self.read_only = spark, root.rstrip("/"), identity or {}, read_only
        held = self.manifest()
        for k, v in self.identity.items():
            if held["identity"].get(k, v) != v:
                raise ValueError(f"the store was made with {k}={held['identity'][k]!r}, not {v!r}")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        p, fs = self._fs(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _load(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/manifest-{number:012d}.json", wholetext=True).first().value)

    def manifest(self) -> dict:
        numbers = self._numbers()
        return migrated(self._load(numbers[-1]) if numbers else {})

    def names(self) -> list[str]:
        return sorted(self.manifest()["tables"])

    def read(self, name: str) -> DataFrame:
        folders = self.manifest()["tables"][name]
        return self.spark.read.parquet(*(f"{self.root}/{f}" for f in folders.values()))

    def read_buckets(self, name: str, buckets: list[int]) -> DataFrame | None:
        """The rows of some buckets; None if none of them has any."""
        folders = self.manifest()["tables"].get(name, {})
        found = [f"{self.root}/{folders[str(b)]}" for b in buckets if str(b) in folders]
        return self.spark.read.parquet(*found) if found else None

    def _writable(self) -> None:
        if self.read_only:
            raise ValueError("the store was opened for reading only")

    def commit(self, **tables: DataFrame) -> None:
        self._writable()
        base, new = self.manifest(), {}
        for name, df in tables.items():
            new[name] = {"": f"{name}/{uuid.uuid4().hex}"}
            df.write.parquet(f"{self.root}/{new[name]['']}")
        self._publish(base, new)

    def commit_buckets(self, name: str, rows: DataFrame, bucket: Column, buckets: list[int], *order: str) -> None:
        """Replaces ``buckets`` of a table by ``rows``, whose bucket number is ``bucket``; others stay as they are. Each
        file's rows are in ``order``."""
        self._writable()
        base, folder = self.manifest(), f"{name}/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", bucket).sortWithinPartitions("_bucket", *order).write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        p, fs = self._fs(f"{self.root}/{folder}")
        there = {s.getPath().getName() for s in fs.listStatus(p)}
        held = {k: v for k, v in base["tables"].get(name, {}).items() if k not in {str(b) for b in buckets}}
        self._publish(base, {name: held | {str(b): f"{folder}/_bucket={b}" for b in buckets if f"_bucket={b}" in there}})

    def _publish(self, base: dict, new: dict) -> None:
        while True:
            numbers = self._numbers()
            held = migrated(self._load(numbers[-1]) if numbers else {})
            if any(held["tables"].get(k) != base["tables"].get(k) for k in new):
                raise Conflict(f"another writer replaced one of {sorted(new)}")
            text = json.dumps(held | {"identity": held["identity"] | self.identity, "tables": held["tables"] | new})
            draft, fs = self._fs(f"{self.root}/draft-{uuid.uuid4().hex}")
            out = fs.create(draft)
            out.write(bytearray(text.encode()))
            out.close()
            final, _ = self._fs(f"{self.root}/manifest-{(numbers[-1] if numbers else 0) + 1:012d}.json")
            jvm = self.spark._jvm
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                context.rename(fs.makeQualified(draft), fs.makeQualified(final), none)
                return
            except Exception as e:
                fs.delete(draft, False)
                if "FileAlreadyExists" not in str(e):
                    raise

    def vacuum(self, keep: int = 2) -> int:
        """Deletes table folders and manifests that the last ``keep`` manifests don't name; how many folders went.
        Readers of older versions must be done, and no commit may be under way."""
        numbers = self._numbers()
        named = {f.split("/_bucket=")[0] for n in numbers[-keep:] for t in migrated(self._load(n))["tables"].values() for f in t.values()}
        gone = 0
        root, fs = self._fs(self.root)
        for table in fs.listStatus(root):
            if table.isDirectory():
                for version in fs.listStatus(table.getPath()):
                    if f"{table.getPath().getName()}/{version.getPath().getName()}" not in named:
                        fs.delete(version.getPath(), True)
                        gone += 1
        for n in numbers[:-keep]:
            fs.delete(self._fs(f"{self.root}/manifest-{n:012d}.json")[0], False)
        return gone


def attach(spark: SparkSession, root: str, identity: dict | None = None) -> SnapshotStore:
    """Another project's store, to read from only; one that isn't there or doesn't fit is an error."""
    store = SnapshotStore(spark, root, identity, read_only=True)
    if not store.names():
        raise FileNotFoundError(f"no store in {root}")
    return store


def one_of(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row of each key: the first by ``order`` and then by all other columns."""
    rest = [F.col(c) for c in rows.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*order, *rest)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *version: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys (nulls are equal). Of several new rows of a key the one
    of the last ``version`` stays, of equal ones the first by the other columns."""
    new = one_of(new, keys, *(F.desc_nulls_last(v) for v in version))
    n = new.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return old.join(n, same, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key ``old`` hasn't are added, the first of a key by its other columns."""
    fresh = one_of(new, keys).join(old.select(*keys).distinct(), keys, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both; columns that one side lacks are null."""
    return old.unionByName(new, allowMissingColumns=True)


def replace_of_files(old: DataFrame, new: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """``old`` without the rows of ``files``, and the rows of ``new``: how chunks, imports and exports of files that were
    read again are replaced, also by nothing."""
    return old.join(files.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def prune(stored: DataFrame, scanned: DataFrame, key: str = "path") -> DataFrame:
    """Stored rows whose key was scanned; an empty scan prunes nothing."""
    return stored if scanned.isEmpty() else stored.join(scanned.select(key).distinct(), key, "left_semi")


def remove_files(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """``tables`` (files, chunks, imports, exports, refs) without the rows of files ``gone`` (file_id); imports and
    references elsewhere that point to what went point to nothing."""
    ids = gone.select("file_id").distinct()
    left = {k: t.join(ids, "file_id", "left_anti").select(*t.columns) for k, t in tables.items()}
    if "imports" in left:
        left["imports"] = null_dangling(left["imports"], left["files"], "resolved_file_id", "file_id")
    if "refs" in left:
        left["refs"] = null_dangling(left["refs"], left["exports"], "resolved_export_id", "export_id")
    return left


def stale_reference_files(imports: DataFrame, refs: DataFrame) -> DataFrame:
    """file_id of files that import something of the project but have no references: they were read before
    references were kept and must be read again."""
    return imports.where("resolved_file_id is not null").select("file_id").distinct().join(refs.select("file_id").distinct(), "file_id", "left_anti")


def lookup(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``table`` whose ``key`` is among ``wanted`` (one column of that name), whatever their number."""
    return table.join(wanted.select(key).distinct(), key, "left_semi")


def missing(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Which of ``wanted`` the table hasn't."""
    return wanted.select(key).distinct().join(table.select(key).distinct(), key, "left_anti")


def collapse_duplicates(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, files): of chunks with equal file, index and hash the one of least chunk_id; file_id of the files that
    had others, which are to be read again."""
    w = Window.partitionBy("file_id", "chunk_index", "content_hash").orderBy("chunk_id")
    n = chunks.withColumn("_n", F.row_number().over(w))
    return n.where("_n = 1").drop("_n"), n.where("_n > 1").select("file_id").distinct()


def upsert_files(files: DataFrame, chunks: DataFrame, read: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, chunks) after files were ``read`` (path, hash, indexed_at) into ``fresh`` chunks (path and what chunks
    have but file_id). A known path keeps its file_id, a new one gets the hash of its path; chunks of a file that
    was read are replaced. Both are to be committed together: the manifest stands for the mark that the file is
    whole."""
    ids = read.join(files.select("path", F.col("file_id").alias("_known")), "path", "left").withColumn("file_id", F.coalesce("_known", F.xxhash64("path"))).drop("_known")
    rows = fresh.join(ids.select("path", "file_id"), "path").drop("path")
    return upsert(files, ids, ["path"]), replace_of_files(chunks, rows, ids)


def rewrite_references(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(chunk_id, name, line) of all references of files whose chunks were changed in place: ``fresh`` (file_id,
    content_hash, references: map of names to lines) by the ids of the ``stored`` chunks with their hashes."""
    held = one_of(stored.select("file_id", "content_hash", "chunk_id"), ["file_id", "content_hash"])
    j = fresh.select("file_id", "content_hash", "references").join(held, ["file_id", "content_hash"])
    return j.select("chunk_id", F.explode("references").alias("name", "lines")).select("chunk_id", "name", F.explode("lines").alias("line"))


def chunk_diff(stored: DataFrame, fresh: DataFrame, parents: DataFrame | None = None, most_new: float = 0.5) -> DataFrame:
    """(file_id, content_hash, action, chunk_index, mode): what to do with each chunk: keep, move, insert, delete.

    A file is rewritten (mode full) if a hash is there twice, more than ``most_new`` of its chunks are new, or it
    has parent groups (``parents``: file_id); else it is changed in place (incremental)."""
    twice = stored.select("file_id", "content_hash").unionAll(fresh.select("file_id", "content_hash").withColumn("content_hash", F.concat(F.lit("+"), "content_hash")))
    twice = twice.groupBy("file_id", "content_hash").agg((F.count(F.lit(1)) > 1).alias("d")).groupBy("file_id").agg(F.bool_or("d").alias("twice"))
    first = lambda t, name: t.groupBy("file_id", "content_hash").agg(F.min("chunk_index").alias(name))
    j = first(stored, "old").join(first(fresh, "new"), ["file_id", "content_hash"], "full_outer")
    action = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "insert").when(F.col("old") == F.col("new"), "keep").otherwise("move")
    j = j.withColumn("action", action)
    share = j.groupBy("file_id").agg((F.count_if(F.col("action") == "insert") / F.greatest(F.count("new"), F.lit(1))).alias("share"))
    full: Column = F.col("twice") | (F.col("share") > most_new)
    out = j.join(share, "file_id").join(twice, "file_id")
    if parents is not None:
        out = out.join(parents.select("file_id").distinct().withColumn("_p", F.lit(True)), "file_id", "left")
        full = full | F.coalesce("_p", F.lit(False))
    return out.select("file_id", "content_hash", "action", F.coalesce("new", "old").alias("chunk_index"), F.when(full, "full").otherwise("incremental").alias("mode"))


def null_dangling(pointers: DataFrame, targets: DataFrame, pointer: str, key: str) -> DataFrame:
    """Pointers to rows that are gone become null."""
    t = targets.select(F.col(key).alias("_t")).distinct()
    return pointers.join(t, F.col(pointer) == F.col("_t"), "left").withColumn(pointer, F.col("_t")).drop("_t")
