"""The store, streams, control plane, readers and the call graph's displays."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.functions import vectors as vx
from larkspur.operators import callgraph as cg
from larkspur.operators import chunking as ck
from larkspur.operators import conversations as cv
from larkspur.operators import history as hs
from larkspur.operators import memory as mm
from larkspur.operators import retrieval as rt
from larkspur.operators import telemetry as tl
from larkspur.sources import readers, scan, store
from larkspur.streaming import control, tail


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, schema, *values):
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)


def test_store_commits_are_whole_and_numbered(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path), {"model": "m", "dim": 4})
    assert s.names() == []
    s.commit(a=frame(spark, "k int", 1, 2), b=frame(spark, "k int", 5))
    other = store.SnapshotStore(spark, str(tmp_path), {"model": "m"})
    base = other.manifest()
    s.commit(a=frame(spark, "k int", 3))
    assert rows(other.read("a")) == [(3,)] and rows(other.read("b")) == [(5,)]
    with pytest.raises(store.Conflict):  # based on what has been replaced
        other._publish(base, {"a": {"": "a/late"}})
    other._publish(base, {"c": base["tables"]["b"]})  # another table: both changes stay
    assert rows(s.read("a")) == [(3,)] and s.names() == ["a", "b", "c"]
    (tmp_path / "draft-of-a-writer-that-died").write_text("{")
    assert rows(s.read("b")) == [(5,)]
    with pytest.raises(ValueError, match="model"):
        store.SnapshotStore(spark, str(tmp_path), {"model": "other"})
    with pytest.raises(ValueError, match="reading"):
        store.attach(spark, str(tmp_path)).commit(a=frame(spark, "k int", 9))
    with pytest.raises(FileNotFoundError):
        store.attach(spark, str(tmp_path / "none"))
    assert s.vacuum(keep=1) == 1 and rows(s.read("a")) == [(3,)] and rows(s.read("c")) == [(5,)]
    with pytest.raises(ValueError, match="newer"):
        store.migrated({"version": 99})
    assert store.migrated({"version": 1, "tables": {"a": "a/x"}})["tables"] == {"a": {"": "a/x"}}


def test_store_buckets(spark, tmp_path):
    s, b = store.SnapshotStore(spark, str(tmp_path)), (F.col("k") % 4).cast("int")
    s.commit_buckets("t", frame(spark, "k int, v string", *[(k, "a") for k in range(8)]), b, [0, 1, 2, 3])
    s.commit_buckets("t", frame(spark, "k int, v string", (1, "b")), b, [1])
    assert rows(s.read_buckets("t", [1])) == [(1, "b")] and len(rows(s.read("t"))) == 7
    s.commit_buckets("t", frame(spark, "k int, v string", (2, "b")).where("false"), b, [2])
    assert s.read_buckets("t", [2]) is None and {r[0] for r in rows(s.read("t"))} == {0, 4, 1, 3, 7}


def test_upserts_keep_one_row_a_key(spark):
    old = frame(spark, "k int, v int", (1, 10), (None, 11), (2, 12))
    new = frame(spark, "k int, v int", (1, 5), (1, 7), (None, 3), (4, 1), (4, 1))
    assert {r.k: r.v for r in store.upsert(old, new, ["k"], "v").collect()} == {1: 7, None: 3, 2: 12, 4: 1}
    assert {r.k: r.v for r in store.insert_or_ignore(old, new, ["k"]).where("k is not null").collect()} == {1: 10, 2: 12, 4: 1}


def test_streamed_turns_grow_and_old_versions_go(spark, tmp_path):
    def put(name, *entries):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"session_id": s, "seq": q, "role": r, "text": t}) for s, q, r, t in entries))

    def run():
        q = tail.stream_turns(tail.read_entries(spark, str(tmp_path / "in"))).writeStream.outputMode("update").foreachBatch(tail.replacing_sink(str(tmp_path / "out"), ["session_id", "turn_index"], 4))
        q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return {(r.session_id, r.turn_index): (r.user_text, r.assistant_text, r.n_events) for r in store.SnapshotStore(spark, str(tmp_path / "out")).read("rows").collect()}

    put("a.json", ("s", 2, "assistant", "one"), ("s", 1, "user", "hi"), ("z", 1, "user", "yo"), ("s", 0, "assistant", "lost"))
    assert run() == {("s", 0): ("hi", "one", 2), ("z", 0): ("yo", "", 1)}
    put("b.json", ("s", 3, "assistant", "two"), ("s", 4, "user", "next"))
    assert run() == {("s", 0): ("hi", "one\ntwo", 3), ("s", 1): ("next", "", 1), ("z", 0): ("yo", "", 1)}
    assert len(list((tmp_path / "out" / "rows").iterdir())) <= 3


def test_file_events_refresh_the_store(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "s"))
    s.commit(
        files=frame(spark, "file_id long, path string", (1, "a.ts"), (2, "b.ts")), chunks=frame(spark, "chunk_id long, file_id long", (10, 1), (20, 2)),
        imports=frame(spark, "file_id long, local string, original string, source string, resolved_file_id long, is_namespace boolean", (1, "f", "f", "./b", 2, False)),
        exports=frame(spark, "export_id long, file_id long, name string", (200, 2, "f"), (100, 1, "g")),
        refs=frame(spark, "ref_id long, file_id long, name string, line int, resolved_export_id long", (1, 1, "f", 3, 200), (2, 1, "g", 4, None)),
    )
    events = frame(spark, "file_id long, path string, action string, at long", (2, "b.ts", "change", 1), (2, "b.ts", "remove", 2))
    tail.refreshing_sink(str(tmp_path / "s"))(events, 0)
    assert rows(s.read("files")) == [(1, "a.ts")] and rows(s.read("chunks")) == [(10, 1)] and [r.resolved_file_id for r in s.read("imports").collect()] == [None]
    assert {r.ref_id: r.resolved_export_id for r in s.read("refs").collect()} == {1: None, 2: 100}


def test_commands_and_lock(tmp_path):
    at = str(tmp_path / "box")
    ids = [control.drop_command(at, "add", {"a": k}, now=100 + k) for k in range(2)]
    old, odd, bad = control.drop_command(at, "add", {"a": 1}, now=0), control.drop_command(at, "other", now=100), control.drop_command(at, "add", {"b": 1}, now=100)
    (tmp_path / "box" / "junk.json").write_text("{")
    done = []
    states = control.run_commands(at, {"add": lambda a: done.append(a) or a + 1}, now=350)
    assert states == {ids[0]: "done", ids[1]: "done", old: "expired", odd: "unknown", bad: "failed", "junk": "unknown"} and done == [0, 1]
    assert control.answer(at, ids[1])["value"] == 2 and control.run_commands(at, {}, now=350) == {}
    lock, again = control.WriterLock(str(tmp_path / "lock")), control.WriterLock(str(tmp_path / "lock"))
    with lock:
        assert lock.acquire() and not again.acquire()
        lock.release()
        assert not again.acquire()
    with again:
        pass
    gone = subprocess.Popen(["true"])
    gone.wait()
    (tmp_path / "lock").write_text(str(gone.pid))
    assert lock.acquire() and (tmp_path / "lock").read_text() == str(os.getpid())
    lock.release()


def test_tails_sessions_and_git(spark, tmp_path):
    f = tmp_path / "t.jsonl"
    f.write_bytes(b"one\ntwo\nthr")
    assert readers.read_tail(str(f), block=3) == (["one", "two"], 8)
    f.write_bytes(b"one\ntwo\nthree\n\n")
    assert readers.read_tail(str(f), 8) == (["three"], 15) and readers.read_tail(str(f), 15) == ([], 15)
    f.write_bytes(b"new\n")
    assert readers.read_tail(str(f), 15) == (["new"], 4)
    os.utime(f, (1, 1))
    (tmp_path / "u.jsonl").write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in readers.find_sessions(spark, str(tmp_path)).collect()] == ["u.jsonl", "t.jsonl"]
    assert readers.find_sessions(spark, str(tmp_path / "none")).count() == 0 and readers.session_folder("/r/", "/a/b.c") == "/r/-a-b-c"
    repo = tmp_path / "repo"
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    repo.mkdir()
    git("init", "-q", "-b", "main")
    (repo / "a").write_text("1\n2\n")
    git("add", "a")
    git("commit", "-qm", "first\n\nbody")
    git("checkout", "-qb", "side")
    (repo / "b").write_bytes(b"\0\1")
    git("add", "b")
    git("commit", "-qm", "binary")
    git("checkout", "-q", "main")
    (repo / "a").write_text("1\n")
    git("commit", "-qam", "less")
    git("merge", "-q", "--no-ff", "-m", "merge", "side")
    log = {r.message: r for r in readers.read_git_log(spark, str(repo)).collect()}
    assert set(log) == {"first\n\nbody", "binary", "less", "merge"} and log["merge"].is_merge and not log["less"].is_merge and log["less"].author == "n"
    stat = {(r.hash, r.file_path): (r.insertions, r.deletions) for r in readers.read_numstat(spark, str(repo)).collect()}
    assert stat[log["less"].hash, "a"] == (0, 1) and stat[log["merge"].hash, "b"] == (0, 0) and stat[log["first\n\nbody"].hash, "a"] == (2, 0)
    assert readers.safe_hash("abc1") and not readers.safe_hash("--all") and readers.dangerous_folder("/root/", "/root") and not readers.dangerous_folder("/root/x", "/root")
    assert hs.parse_status(" M a b\nR  x -> y\n?? z\n") == [("M", "a b"), ("R", "y"), ("??", "z")]
    status = frame(spark, "state string, path string", ("M", "a"), ("??", "z"))
    assert rows(hs.git_context(status, frame(spark, "path string", "a"))) == [("??", "z", False), ("M", "a", True)]
    c = frame(spark, "hash string", "a", "b")
    assert hs.recovered(c, None, False)[0].count() == 2 and hs.recovered(c, frame(spark, "hash string", "b"), False)[0].count() == 1
    tasks = tmp_path / "tasks.json"
    tasks.write_text('[{"task": "t", "grading": "g", "expectedFiles": ["a"]}, {"task": "", "grading": "g"}]')
    with pytest.raises(ValueError):
        readers.load_tasks(spark, str(tasks))
    readers.save_traces(frame(spark, "arm string", "a"), str(tmp_path / "traces"))
    assert spark.read.json(str(tmp_path / "traces")).count() == 1


def test_extensions_and_skips(spark):
    names = {"a/Makefile": ".makefile", "Dockerfile.dev": ".dockerfile", "jenkinsfile": ".jenkinsfile", "Jenkinsfile.x": ".jenkinsfile", "Brewfile": ".brewfile", "x.PY": ".py", ".env": "", "Gemfile": ".gemfile", "LICENSE": ""}
    df = frame(spark, "p string", *names)
    assert {r.p: r.e for r in df.select("p", scan.extension("p").alias("e")).collect()} == names
    s = frame(spark, "path string, status string", ("a", "empty"), ("b", "unchanged"), ("c", "indexed"))
    assert rows(scan.no_longer_indexed(s, frame(spark, "file_id long, path string", (1, "a"), (2, "b"), (3, "c")))) == [(1,)]


def edges(spark, *pairs):
    return frame(spark, "src string, dst string", *pairs)


def test_impact_counts_and_tree(spark):
    none = spark.createDataFrame([], "node string")
    ring = edges(spark, ("b", "a"), ("c", "b"), ("a", "c"))
    tree, counts = cg.impact(ring, "a", none)
    assert counts == {"shown": 3, "total": 3, "capped": False, "truncated": False}
    assert [tuple(r) for r in tree.orderBy("depth").collect()] == [(1, "a", "b", False, False), (2, "b", "c", False, False), (3, "c", "a", True, False)]
    fan = edges(spark, *[(f"x{k}", "t") for k in range(5)], ("y", "x0"), ("z", "x1"))
    tree, counts = cg.impact(fan, "t", frame(spark, "node string", "x0"), budget=2)
    assert counts["total"] == 7 and counts["truncated"] and {r.node for r in tree.where("ambient").collect()} == {"x0"}
    assert {r.node for r in tree.where("depth = 2").collect()} == {"z"}  # x1 and x2 spend the budget
    capped = cg.impact(fan, "t", none, depth=1, cap=3)[1]
    assert capped["total"] == 5 == capped["shown"] and capped["capped"]  # never fewer than are shown
    assert cg.impact(fan, "t", none, depth=1)[1]["truncated"] and cg.impact(fan, "y", none)[1]["total"] == 0


def test_trace_and_its_frontiers(spark):
    e = edges(spark, ("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e"), ("b", "x"), ("q", "e"))
    t = cg.trace(e, "a", "e")
    assert t["found"] and t["spine"] == ["a", "b", "d", "e"] and t["size"] == 5
    assert cg.drawn(e, t) == [(0, "a", False), (1, "b", False), (2, "d", False), (3, "e", False), (1, "c", False), (2, "d", True)]
    no = cg.trace(e, "x", "q")
    assert not no["found"] and no["ahead"] == [] and no["back"] == []
    no = cg.trace(e, "a", "q")
    assert no["ahead"] == ["e"] and cg.trace(e, "q", "d")["back"] == ["b", "c"] and cg.trace(e, "a", "a")["spine"] == ["a"]


def test_symbols_resolve_by_name_and_file(spark):
    ex = frame(spark, "export_id long, file_id long, name string, type string", (1, 1, "f", "function"), (2, 2, "f", "function"), (3, 1, "k", "constant"))
    ch = frame(spark, "chunk_id long, file_id long, entity_name string, chunk_type string, start_line int, end_line int, parent_id long", (1, 1, "f", "function", 1, 2, None), (4, 1, "g", "method", 3, 4, None))
    fi = frame(spark, "file_id long, path string", (1, "src/db.ts"), (2, "src/indexed-db.ts"))
    assert cg.resolve_symbol(ex, ch, fi, "f")[0] == "ambiguous" and cg.resolve_symbol(ex, ch, fi, "f", "db.ts") == ("ok", [("e:1", "src/db.ts")])
    assert cg.resolve_symbol(ex, ch, fi, "g") == ("ok", [("l:1:g", "src/db.ts")]) and cg.resolve_symbol(ex, ch, fi, "k")[0] == "not_found"
    refs = frame(spark, "ref_id long, chunk_id long, file_id long, name string, line int, resolved_export_id long", (1, 4, 1, "f", 2, 1), (2, 1, 1, "g", 0, None))
    cache = cg.CallGraphCache()
    first = cache.edges(ex, ch, refs, fi)
    assert rows(first) == [("e:1", "l:1:g"), ("l:1:g", "e:1")] and cache.edges(ex, ch, refs, fi) is first and cache.edges(ex, ch, refs.where("ref_id = 1"), fi) is not first


def test_index_phrases_and_parts(spark, tmp_path):
    docs = frame(spark, "id long, text string", (1, "call get_user now"), (2, "user get"), (3, "getUser here"), (4, None), (5, ""))
    index = rt.TextIndex(store.SnapshotStore(spark, str(tmp_path)), "p", "id").build(docs, parts=True)
    for q in ("get_user", "user", "get user", "nowhere"):
        direct = rows(rt.bm25_scores(docs, q, parts=True))
        held = index.scores(q)
        assert (rows(held) if held is not None else []) == direct, q
    assert {r[0] for r in rows(index.scores("get_user"))} == {1, 3} and index.scores("!!") is None
    assert rt.bm25_scores(docs, "").count() == 0 and [r.id for r in rt.bm25(docs, "user", k=1).collect()] == [2]


def test_many_queries_are_taken_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rng.normal(size=(70, 6)))], "id long, embedding array<double>")
    q = v.where("id < 40").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    few = rows(rt.knn(v, q, 3))
    monkeypatch.setattr(rt, "FEW", 10)
    monkeypatch.setattr(rt, "BLOCK", 16)
    assert rows(rt.knn(v, q, 3)) == few and len(few) == 120


def test_chunk_search_stages(spark):
    near = frame(spark, "id long, parent_id long, path string, chunk_index int, rank int, vector_score double", (1, 9, "src/a.ts", 0, 1, 0.9), (2, 9, "src/a.ts", 1, 2, 0.8), (9, None, "src/a.ts", -1, 3, 0.8), (5, None, "src/b.ts", 0, 4, 0.42))
    words = frame(spark, "id long, parent_id long, path string, chunk_index int, rank int", (2, 9, "src/a.ts", 1, 1))
    parents = frame(spark, "id long, path string", (9, "src/a.ts"))
    stages = {}
    leaf = rt.chunk_search(near, words, "", 5, threshold=0.5, parent_boost=0.3, trace=stages)
    assert [(r.path, r.chunk_index) for r in leaf.orderBy("rank").collect()] == [("src/a.ts", 1), ("src/a.ts", 0)] and {"lists", "fused", "scored", "final"} <= set(stages)
    whole = rt.chunk_search(near, words, "", 5, leaf_only=False, parents=parents)
    assert {(r.path, r.chunk_index) for r in whole.collect()} == {("src/a.ts", -1), ("src/b.ts", 0)}
    named = rt.chunk_search(near, words, "", 5, symbols=frame(spark, "path string, chunk_index int", ("src/c.ts", 2), ("src/a.ts", 1), ("src/d.ts", -1)))
    assert {r.path: r.score for r in named.where("path = 'src/c.ts'").collect()} == {"src/c.ts": 0.75} and named.where("path = 'src/d.ts'").count() == 0


def test_turns_resume_and_digest(spark):
    s = "session_id string, user_text string, assistant_text string, timestamp string"
    old = frame(spark, s, ("a", "hi", "one", "t1"), ("b", "hi", "one", "t1"), ("c", "hi", "zzz", "t1"))
    new = frame(spark, s, ("a", "hi", "one two", "t2"), ("b", "ho", "one", "t1"), ("c", "hi", "one", "t2"), ("d", "x", "y", "t"))
    assert dict(rows(cv.resume_action(old, new))) == {"a": "replace", "b": "append", "c": "append", "d": "append"}
    turns = frame(spark, "session_id string, turn_index int, summary string", ("a", 0, "first"), ("a", 1, "last"))
    sessions = frame(spark, "session_id string, turn_count int, last_turn int", ("a", 2, 1))
    made = mm.checkpoint(frame(spark, "session_id string, timestamp string, type string, title string", ("a", "t", "decision", "go"), ("a", "t", "nonsense", "x")))
    notes = frame(spark, "path string, note string, updated_at long", ("p", "n", 1))
    commits = frame(spark, "commit_id long, date string, message string", (1, "d", "m"))
    assert cv.session_digest(sessions, turns, made, notes, commits) == {"sessions": [("a", 2, "last")], "checkpoints": [("decision", "go")], "notes": [("p", "n")], "commits": [("d", "m")]}
    e = mm.annotation_upsert(frame(spark, "path string, symbol_name string, note string, author string, commit_hash string, at long", ("p", None, "a", "x", "c1", 1), ("p", None, "b", "y", "c2", 2)))
    assert [(r.created_at, r.updated_at, r.note, r.author, r.commit_hash) for r in e.collect()] == [(1, 2, "b", "y", "c2")]


def test_text_and_vector_functions(spark):
    df = frame(spark, "t string", "ab\ncd\nef\ncd")
    spans = df.select(tx.line_span(F.col("t"), F.array(F.lit("ab"), F.lit("cd\nef"), F.lit("zz"), F.lit("cd"))).alias("s")).first().s
    assert [(x.start_line, x.end_line) for x in spans] == [(1, 1), (2, 3), (None, None), (2, 2)]
    one = df.select(tx.usage_line(F.col("t"), F.lit(11), F.lit(11)).alias("a"), tx.usage_line(F.col("t"), F.lit(11), F.lit(40)).alias("b"), tx.match_line(F.col("t"), "CD", True).alias("c"), tx.is_iso_date(F.lit("2024-01-02T03:04")).alias("d"), tx.is_iso_date(F.lit("2 Jan")).alias("e"), F.lit("50%_x\\").like(tx.like_literal("50%_x\\")).alias("f"), F.lit("50ab").like(tx.like_literal("50%_")).alias("g")).first()
    assert (one.a, one.b[:5], one.c, one.d, one.e, one.f, one.g) == ("cd", "ab\ncd", "cd", True, False, True, False)
    assert frame(spark, "t string", "[1, 2]", "no", None).select(tx.unpacked("t", "int").alias("x")).collect()[1].x == []
    texts = frame(spark, "id long, text string", (1, "word " * 300), (2, "one two"), (3, None))
    got = {r.id: r.embedding for r in vx.embed_windows(texts, "id", "text", vx.HashingEmbedder(16), 100, 10).collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1) and got[2] == pytest.approx(vx.HashingEmbedder(16).embed(["one two"])[0].tolist(), abs=1e-6)


def test_groups_references_and_phases(spark):
    c = frame(spark, "file_id long, chunk_index int, chunk_type string, entity_name string, snippet string, start_line int, end_line int", (1, 0, "class_start", "A", "a", 1, 2), (1, 1, "method", "A.m", "b", 3, 4), (1, 2, "class_end", "A", "c", 5, 6), (1, 3, "function", "f", "d", 7, 8), (1, 4, "class_start", "B", "e", 9, 9))
    g = ck.bookend_groups(c)
    assert [r.group for r in g.orderBy("chunk_index").collect()] == [1, 1, 1, None, None]
    assert [(r.members, r.start_line, r.end_line, r.snippet) for r in ck.parent_groups(g).collect()] == [(3, 1, 6, "a\n\nb\n\nc")]
    m = spark.createDataFrame([(7, {"f": [1, 2], "g": [3]})], "chunk_id long, references map<string,array<int>>")
    assert rows(ck.flatten_references(m)) == [(7, "f", 1), (7, "f", 2), (7, "g", 3)]
    phases = tl.Phases()
    with phases("read") as seen:
        seen(spark.range(7)).write.format("noop").mode("overwrite").save()
    with phases("write") as seen:
        pass
    assert phases.rows == {"read": 7, "write": 0} and sum(phases.shares().values()) == pytest.approx(1)
    docs = frame(spark, "doc_id long, text string", (1, "x one two three y"), (2, "one two"), (3, "zone twofold"), (4, None))
    asked = frame(spark, "item_id long, text string", (1, "one two three"), (2, "one two"), (3, "ne tw"))
    assert rows(tl.passages_in(docs, asked)) == [(1, 1), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3)]
