"""Readers of transcripts, version history, evaluation sets and settings."""

from __future__ import annotations

import json
import re
import subprocess
import uuid
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.conversations import keep_tool_output
from ..runtime import shared_dir

BLOCK = "struct<type:string,text:string,id:string,name:string,tool_use_id:string,content:string,input:string>"
ENTRY = f"type string, uuid string, timestamp string, sessionId string, cwd string, message struct<role:string,content:string,usage:struct<input_tokens:bigint,output_tokens:bigint>>, toolUseResult struct<filenames:array<string>>"


def parse_entries(lines: DataFrame, value: str = "value") -> DataFrame:
    """Transcript lines (JSON) to session_id, timestamp, cwd, role, blocks (array), files, tokens. Lines that don't
    parse and kinds other than user and assistant are dropped; a plain string as content is one text block."""
    e = lines.select("*", F.from_json(value, ENTRY).alias("e")).where("e.sessionId is not null and e.type in ('user', 'assistant')")
    content = F.col("e.message.content")
    blocks = F.coalesce(F.from_json(content, f"array<{BLOCK}>"), F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), content.alias("text"))), BLOCK)))
    kept = [c for c in lines.columns if c != value]
    return e.select(*kept, F.col("e.sessionId").alias("session_id"), "e.timestamp", "e.cwd", F.col("e.type").alias("role"), blocks.alias("blocks"), F.col("e.toolUseResult.filenames").alias("files"), F.coalesce("e.message.usage.output_tokens", F.lit(0)).alias("tokens"))


def _texts(kind: str) -> Column:
    return F.transform(F.filter("blocks", lambda b: b["type"] == kind), lambda b: F.coalesce(b["text"], b["content"], F.lit("")))


def turn_events(entries: DataFrame, order: str) -> DataFrame:
    """Entries to what fold_turns takes. A user's entry that only brings tool results opens no turn: its role is tool."""
    result = F.exists("blocks", lambda b: b["type"] == "tool_result")
    role = F.when((F.col("role") == "user") & result, "tool").otherwise(F.col("role"))
    tools = F.transform(F.filter("blocks", lambda b: b["type"] == "tool_use"), lambda b: b["name"])
    return entries.select("session_id", F.col(order).alias("seq"), role.alias("role"), F.array_join(_texts("text"), "\n").alias("text"), tools.alias("tools"), "files", F.col("tokens").cast("int").alias("tokens"))


def tool_outputs(entries: DataFrame) -> DataFrame:
    """session_id, tool, output: results matched with the calls they answer, bulky tools' long outputs left out."""
    calls = entries.select("session_id", F.explode("blocks").alias("b")).where("b.type = 'tool_use'").select("session_id", F.col("b.id").alias("call"), F.col("b.name").alias("tool"))
    results = entries.select("session_id", F.explode("blocks").alias("b")).where("b.type = 'tool_result'").select("session_id", F.col("b.tool_use_id").alias("call"), F.col("b.content").alias("output"))
    return results.join(calls, ["session_id", "call"]).where(keep_tool_output(F.col("tool"), F.col("output"))).select("session_id", "tool", "output")


FIELD, RECORD = "\x1f", "\x1e"
LOG_FORMAT = "%x1e%H%x1f%P%x1f%an%x1f%ae%x1f%aI%x1f%D%x1f%B"


def parse_log(raw: DataFrame, value: str = "value") -> DataFrame:
    """Records of a log written with LOG_FORMAT to commits; malformed records are dropped."""
    r = raw.select(F.explode(F.split(value, RECORD)).alias("r")).withColumn("f", F.split("r", FIELD)).where((F.size("f") == 7) & F.col("f")[0].rlike("^[0-9a-f]{7,64}$"))
    at = lambda i: F.col("f")[i]
    return r.select(at(0).alias("hash"), F.substring(at(0), 1, 8).alias("short_hash"), F.btrim(at(6), F.lit(" \n")).alias("message"), at(2).alias("author"), at(3).alias("author_email"), at(4).alias("date"), (F.size(F.filter(F.split(at(1), " "), lambda x: x != "")) > 1).alias("is_merge"), F.filter(F.split(at(5), ", "), lambda x: x != "").alias("refs"))


def parse_numstat(lines: DataFrame, value: str = "value") -> DataFrame:
    """hash, file_path, insertions, deletions from lines ``hash TAB added TAB deleted TAB path``; - (binary) is 0."""
    f = F.split(value, "\t")
    n = lambda i: F.when(f[i] == "-", 0).otherwise(F.try_to_number(f[i], F.lit("999999999")).cast("int"))
    return lines.where(F.size(f) == 4).select(f[0].alias("hash"), f[3].alias("file_path"), n(1).alias("insertions"), n(2).alias("deletions"))


def read_git_log(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """All commits of the repository at ``root`` (or those not in ``since``). git runs on the driver, as a repository lies
    on one machine; its output goes to a file in the shared folder and is parsed by Spark."""
    args = ["log", "--all", f"--format={LOG_FORMAT}", *([f"^{since}"] if since else [])]
    return parse_log(_git_output(spark, root, args, lineSep=RECORD))


def read_numstat(spark: SparkSession, root: str) -> DataFrame:
    """hash, file_path, insertions, deletions of all commits; a merge against its first parent."""
    raw = _git_output(spark, root, ["log", "--all", "-m", "--first-parent", "--numstat", f"--format={RECORD}%H"], lineSep=RECORD)
    lines = raw.select(F.split("value", "\n").alias("l")).select(F.col("l")[0].alias("hash"), F.explode("l").alias("line")).where(F.col("line").contains("\t"))
    return parse_numstat(lines.select(F.concat_ws("\t", "hash", "line").alias("value"))).distinct()


def _git_output(spark: SparkSession, root: str, args: list[str], **options) -> DataFrame:
    folder = f"{shared_dir(spark)}/larkspur/git-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/out.txt")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    with subprocess.Popen(["git", "-C", root, *args], stdout=subprocess.PIPE) as git:
        while part := git.stdout.read(1 << 20):
            out.write(bytearray(part))
        out.close()
        if git.wait():
            raise RuntimeError(f"git failed in {root}")
    return spark.read.options(**options).text(folder)


def safe_hash(text: str) -> bool:
    """Whether a text can be handed to git as a commit: never an option or anything but a hash."""
    return bool(re.fullmatch(r"[0-9a-f]{4,64}", text))


def read_tail(path: str, offset: int = 0, block: int = 1 << 20) -> tuple[list[str], int]:
    """(lines, offset) of a growing file from a byte offset on: complete lines only; the offset is where the next read
    begins. A file shorter than the offset was replaced and is read from its start."""
    with open(path, "rb") as f:
        end = f.seek(0, 2)
        at = f.seek(0 if end < offset else offset)
        held, lines = b"", []
        while part := f.read(block):
            *whole, held = (held + part).split(b"\n")
            lines += whole
            at += sum(map(len, whole)) + len(whole)
    return [x.decode(errors="replace") for x in lines if x.strip()], at


def find_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, size) of the transcripts in a folder, latest first; no row if there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "path string, modified timestamp, size long")
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder)
    return f.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")).orderBy(F.desc("modified"), "path")


def session_folder(root: str, project: str) -> str:
    """Where a project's transcripts lie under ``root``: its path with all but letters and digits as dashes."""
    return f"{root.rstrip('/')}/{re.sub(r'[^A-Za-z0-9]', '-', project)}"


def load_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """query, expected of an evaluation set; a row without a query or expected items is an error."""
    df = spark.read.schema("query string, expected array<string>").json(path, multiLine=True)
    if df.where("query is null or query = '' or expected is null or size(expected) = 0").limit(1).count():
        raise ValueError("each row needs a query and at least one expected item")
    return df


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    """task, grading, expectedFiles of an A/B evaluation; a row without a task or grading is an error."""
    df = spark.read.schema("task string, grading string, expectedFiles array<string>").json(path, multiLine=True)
    if df.where("coalesce(task, '') = '' or coalesce(grading, '') = ''").limit(1).count():
        raise ValueError("each row needs a task and a grading")
    return df


def save_traces(traces: DataFrame, path: str) -> None:
    """The traces of an evaluation as JSON lines."""
    traces.write.mode("overwrite").json(path)


def dangerous_folder(path: str, home: str) -> bool:
    """A folder that is never indexed as a project: a slip there would read a whole machine."""
    clean = "/" + "/".join(x for x in path.replace("\\", "/").split("/") if x not in ("", "."))
    return clean in ("/", "/home", "/Users", "/root", "/tmp", "/usr", "/etc", "/var", "/opt", home.rstrip("/"))


@dataclass
class Config:
    """Settings, with what the engine uses where a file sets nothing."""

    include: list[str] = field(default_factory=lambda: ["**/*.py", "**/*.ts", "**/*.js", "**/*.md", "**/*.go", "**/*.java"])
    exclude: list[str] = field(default_factory=lambda: ["**/node_modules/**", "**/.git/**", "**/dist/**"])
    generated: list[str] = field(default_factory=list)
    chunk_size: int = 1500
    chunk_overlap: int = 200
    top_k: int = 8
    hybrid_weight: float = 0.5
    min_recall: float = 0.8
    min_mrr: float = 0.6

    @classmethod
    def load(cls, text: str) -> Config:
        """Keys of the right type are taken, others keep their defaults; what doesn't parse sets nothing."""
        try:
            data = json.loads(text)
        except ValueError:
            return cls()
        base = cls()
        known = {f.name: type(getattr(base, f.name)) for f in fields(cls)}
        good = {k: v for k, v in (data.items() if isinstance(data, dict) else ()) if k in known and isinstance(v, (known[k], int) if known[k] is float else known[k]) and not isinstance(v, bool)}
        return cls(**good)
