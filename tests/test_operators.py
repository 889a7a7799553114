import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.functions import vectors as vx
from larkspur.operators import chunking as ck
from larkspur.operators import conversations as cv
from larkspur.operators import graph as gr
from larkspur.operators import history as hs
from larkspur.operators import retrieval as rt
from larkspur.operators import symbols as sy
from larkspur.operators import telemetry as tl
from larkspur.sources import scan, store


def ranked(spark, keys, **extra):
    rows = [(k, i + 1, *[v for v in extra.values()]) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "key string, rank int" + "".join(f", {n} string" for n in extra))


def fuse(spark, p, s, w):
    return {r.key: r.score for r in rt.rrf(ranked(spark, p), ranked(spark, s), w, ["key"]).collect()}


def test_rrf_contract(spark):
    assert fuse(spark, ["a"], ["a"], 0.5) == {"a": 1.0}
    got = fuse(spark, ["p"], ["s"], 0.7)
    assert got["p"] == pytest.approx(0.7) and got["s"] == pytest.approx(0.3)
    assert fuse(spark, ["r0", "r1"], [], 1.0) == pytest.approx({"r0": 1, "r1": 60 / 61})
    a, b = fuse(spark, ["x", "y", "z"], ["y", "w"], 0.65), fuse(spark, ["y", "w"], ["x", "y", "z"], 0.35)
    assert a == pytest.approx(b)
    both = rt.rrf(ranked(spark, ["x"], tag="P"), ranked(spark, ["x"], tag="S"), 0.5, ["key"]).collect()
    assert both[0].tag == "P"


def test_score_to_cosine(spark):
    rows = spark.createDataFrame([(1.0,), (1 / (1 + 2**0.5),), (None,), (0.0,), (0.1,)], "s double").select(vx.score_cosine("s").alias("c")).collect()
    assert rows[0].c == 1 and rows[1].c == pytest.approx(0) and rows[2].c is None and rows[3].c is None and rows[4].c == -1


def test_identifier_parts(spark):
    cases = {"getDependsOn": "get depends on", "content_hash": "content hash", "HTMLParser": "html parser", "just plain words here": "", "aB" * 45: ""}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.array_join(tx.identifier_parts("t"), " ").alias("p")).collect()
    assert {r.t: r.p for r in rows} == cases


def test_query_parsing():
    assert tx.query_words("find the Scheduler_code in x-ray") == ["scheduler", "ray"]
    assert tx.query_identifiers("where is getDB and content_hash or the plain") == ["getDB", "content_hash"]
    assert tx.query_phrases("get_user  (!!) Élan") == [["get", "user"], ["elan"]]


def test_globs(spark):
    paths = ["src/a.ts", "a.ts", "lib/src/a.ts", "x/node_modules/y.js", "node_modules/y.js", "a/.env", "b/.env.local", "q_test.go", "d/foo.egg-info/z", "gen/z"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    pick = lambda c: sorted(r.p for r in df.where(c).collect())
    assert pick(tx.included("p", ["src/**"])) == ["src/a.ts"]
    assert pick(tx.included("p", ["**/*.ts"])) == ["a.ts", "lib/src/a.ts", "src/a.ts"]
    assert pick(tx.excluded("p", ["**/node_modules/**"])) == ["node_modules/y.js", "x/node_modules/y.js"]
    assert pick(tx.excluded("p", ["node_modules/**"])) == ["node_modules/y.js"]
    assert pick(tx.excluded("p", [".env", ".env.*", "**/*_test.go", "*.egg-info/**", "gen/**"])) == ["a/.env", "b/.env.local", "d/foo.egg-info/z", "gen/z", "q_test.go"]
    assert pick(tx.included("p", [])) == []


def naive_expand(rows, k):
    docs = sum(d for d in rows[:k])
    n = len(rows[:k])
    if not docs or docs == n:
        return list(range(min(k, len(rows))))
    end, codes = k, n - docs
    while codes < k and end < min(len(rows), 2 * k):
        codes += not rows[end]
        end += 1
    return list(range(end))


def naive_cut(s, cut, steep):
    anchor = s[0]
    for i in range(1, len(s)):
        if s[i - 1] > 0 and (s[i - 1] - s[i]) / s[i - 1] > steep:
            anchor = s[i]
        else:
            break
    return [x for x in s if x >= anchor * cut]


def test_lists_against_naive(spark):
    rnd = random.Random(4)
    for _ in range(6):
        docs = [rnd.random() < 0.4 for _ in range(rnd.randint(1, 12))]
        df = spark.createDataFrame([(i + 1, f"f{i}" + (".md" if d else ".py")) for i, d in enumerate(docs)], "rank int, path string")
        assert sorted(r["rank"] - 1 for r in rt.expand_for_docs(df, 4).collect()) == naive_expand(docs, 4)
        scores = sorted((rnd.random() for _ in range(rnd.randint(1, 10))), reverse=True)
        df = spark.createDataFrame([(i + 1, x) for i, x in enumerate(scores)], "rank int, score double")
        assert sorted((r.score for r in rt.tail_cut(df).collect()), reverse=True) == naive_cut(scores, 0.85, 0.15)


def naive_merge(parts, least):
    out, buf = [], ""
    for p in (p.strip() for p in parts):
        if not p:
            continue
        if len(buf) + len(p) < least:
            buf = f"{buf}\n\n{p}" if buf else p
        else:
            if buf:
                out.append(buf)
            buf = p
    return [*out, buf] if buf else out


def test_splitters_against_naive(spark):
    rnd = random.Random(5)
    lists = [["x" * rnd.randint(0, 60) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randint(0, 8))] for _ in range(40)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(lists)], "i int, p array<string>")
    got = {r.i: r.m for r in df.select("i", ck.merge_tiny("p").alias("m")).collect()}
    assert all(got[i] == naive_merge(p, 100) for i, p in enumerate(lists))
    texts = ["", "a", "abcdefghij" * 5, "x" * 30]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ck.split_by_size("t", 12, 20).alias("a"), ck.split_by_size("t", 12, 3).alias("b")).collect()
    for r in rows:
        assert r.a == [r.t[i : i + 12] for i in range(0, max(len(r.t) - 11, 1), 1)] if r.t else r.a == []
        assert "".join([r.b[0], *(x[3:] for x in r.b[1:])]) == r.t if r.t else r.b == []


def test_chunk_formats():
    assert len(ck.chunk_text("# a\n" + "x" * 50 + "\n```\n# no\n```\n## b\ny", ".md")) == 2
    assert [c[0].split(":")[0] for c in ck.chunk_text('{"a": 1, "b": "' + "z" * 1600 + '"}', ".json", size=5000)] == ['{"a"']
    assert len(ck.chunk_text("FROM a\n" + "RUN x\n" * 300 + "FROM b\n" + "RUN y\n" * 300, ".dockerfile", size=2000)) == 2
    assert ck.chunk_text("  \n ", ".txt") == []
    big = ck.chunk_text("\n\n".join("line %d " % i * 30 for i in range(20)), ".txt", size=400, overlap=50)
    assert all(c[1] is not None and c[1] <= c[2] for c in big)


def test_graph_walks(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("f", "f"), ("x", "d")], "src string, dst string")
    seed = lambda n: spark.createDataFrame([(n,)], "node string")
    assert {r.node: r.depth for r in gr.reach(e, seed("a")).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert gr.impact(e, seed("a"))[1].first().callers == 2
    assert gr.impact(e, seed("f"))[1].first().callers == 0
    t = gr.trace(e, seed("a"), seed("d"))
    assert [r.node for r in gr.spine(e, t).orderBy("step").collect()] == ["a", "b", "c", "d"]
    assert gr.trace(e, seed("d"), seed("a")).count() == 0
    hot = spark.createDataFrame([("hot", "leaf")] + [(f"c{i}", "hot") for i in range(30)], "src string, dst string")
    shown, total = gr.impact(hot, seed("leaf"))
    assert total.first().callers == 31 and {r.node: r.ambient for r in shown.collect()} == {"leaf": False, "hot": True}


def test_references(spark):
    ex = spark.createDataFrame([(1, 1, "getDB", "f"), (2, 1, "Config", "t"), (3, 2, "run", "f")], "export_id long, file_id long, name string, type string")
    im = spark.createDataFrame([(2, "g", "getDB", 1, False), (3, "ns", None, 1, True)], "file_id long, local string, original string, resolved_file_id long, is_namespace boolean")
    rf = spark.createDataFrame([(1, 2, "run", 5), (2, 2, "g", 6), (3, 3, "ns", 7), (4, 3, "Config", 7), (5, 3, "Config", 8)], "ref_id long, file_id long, name string, line int")
    got = {r.ref_id: r.resolved_export_id for r in sy.resolve_references(rf, ex, im).collect()}
    assert got == {1: 3, 2: 1, 3: None, 4: 2, 5: None}
    files = spark.createDataFrame([(1, "src/db.ts"), (2, "src/run.ts"), (3, "lib/x/index.ts"), (4, "a/pkg/b.py"), (5, "c/pkg/b.py")], "file_id long, path string")
    im = spark.createDataFrame([(1, "src/run.ts", "./db"), (2, "src/run.ts", "../lib/x"), (3, "src/run.ts", "./no")], "import_id long, path string, specifier string")
    assert {r.import_id: r.resolved_file_id for r in sy.resolve_relative(im, files).collect()} == {1: 1, 2: 3}
    im = spark.createDataFrame([(1, "a/main.py", "pkg/b.py"), (2, "z/main.py", "pkg/b.py")], "import_id long, path string, wanted string")
    assert {r.import_id: r.resolved_file_id for r in sy.resolve_suffix(im, files).collect()} == {1: 4}


def test_resolve_imports(spark):
    names = ["pkg/a.py", "pkg/b.py", "pkg/sub/__init__.py", "src/flat/c.py", "mono/one/deep/d.py", "pkg/__init__.py", "src/main/java/com/x/Foo.java", "app/kotlin/com/x/Bar.kt",
             "c/main.c", "c/util.h", "lib/inc/helper.h", "go/b.go", "go/a_test.go", "go/c.go", "root.go", "web/a.ts", "web/lib/index.ts", "t1/same.h", "t2/same.h"]
    files = spark.createDataFrame(list(enumerate(names)), "file_id long, path string")
    cases = [("pkg/a.py", "pkg.b", "pkg/b.py"), ("pkg/a.py", "pkg.sub", "pkg/sub/__init__.py"), ("pkg/a.py", "flat.c", "src/flat/c.py"), ("pkg/a.py", "deep.d", "mono/one/deep/d.py"), ("pkg/a.py", "os", None),
             ("pkg/a.py", ".b", "pkg/b.py"), ("pkg/a.py", ".", "pkg/__init__.py"), ("pkg/sub/__init__.py", "..b", "pkg/b.py"), ("pkg/a.py", ".none", None), ("A.java", "com.x.Foo", "src/main/java/com/x/Foo.java"), ("A.kt", "com.x.Bar", "app/kotlin/com/x/Bar.kt"),
             ("A.java", "java.util.List", None), ("c/main.c", "util.h", "c/util.h"), ("c/main.c", "inc/helper.h", "lib/inc/helper.h"), ("c/main.c", "<stdio.h>", None), ("c/main.c", "same.h", None), ("t1/x.c", "same.h", "t1/same.h"),
             ("root.go", "ex.com/p/go", "go/b.go"), ("go/b.go", "ex.com/p", "root.go"), ("go/b.go", "ex.com/pq", None), ("go/b.go", "fmt", None), ("web/a.ts", "./lib", "web/lib/index.ts"), ("web/a.ts", "react", None), ("c/main.c", "./util.h", "c/util.h")]
    im = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "import_id long, path string, specifier string")
    got = {r.import_id: names[r.resolved_file_id] for r in sy.resolve_imports(im, files, "ex.com/p").collect()}
    assert [got.get(k) for k in range(len(cases))] == [c for *_, c in cases]
    assert sy.resolve_imports(im.limit(0), files).count() == sy.resolve_imports(im, files.limit(0), "ex.com/p").count() == 0


def test_history(spark):
    c = spark.createDataFrame([(i, f"2024-01-{i:02d}T10:00:00", i == 4) for i in range(1, 7)], "commit_id long, date string, is_merge boolean")
    f = [(1, "src/db.ts"), (1, "src/a.ts"), (2, "src/db.ts"), (2, "src/a.ts"), (3, "src/db.ts"), (3, "src/mydb.ts"), (4, "src/db.ts"), (4, "src/a.ts"), (6, "src/a.ts"), (6, "x")]
    f += [(5, f"big{i}") for i in range(30)] + [(5, "src/db.ts")]
    f = spark.createDataFrame(f, "commit_id long, file_path string")
    got = hs.co_change(c, f, "db.ts").collect()
    assert [(r.file_path, r.together, r.changes) for r in got] == [("src/a.ts", 2, 3)] and got[0].jaccard == pytest.approx(2 / 4)
    assert [r.commit_id for r in hs.file_history(c, f, "db.ts").collect()] == [5, 4, 3, 2, 1]
    assert hs.commit_filter(c, until="2024-01-02").count() == 2
    notes = spark.createDataFrame([(1, "s1", ["a"]), (2, "s1", ["b"]), (3, "gone", ["a"]), (4, None, ["a"])], "id long, commit_hash string, files_involved array<string>")
    ch = spark.createDataFrame([("s1", "a")], "sha string, path string")
    got = {r.id: r.verdict for r in hs.freshness(notes, ch, spark.createDataFrame([("s1",)], "sha string")).collect()}
    assert got == {1: "stale", 2: "current", 3: "diverged", 4: None}


def test_turns(spark):
    rows = [("s", 0, "system", "x"), ("s", 1, "user", "hi"), ("s", 2, "assistant", "a"), ("s", 3, "assistant", "b"), ("s", 4, "user", "bye"), ("t", 0, "assistant", "lost")]
    e = spark.createDataFrame([(*r, ["T", "T"], None, 2) for r in rows], "session_id string, seq int, role string, text string, tools array<string>, files array<string>, tokens int")
    got = {(r.session_id, r.turn_index): (r.user_text, r.assistant_text, r.tools_used, r.token_cost) for r in cv.fold_turns(e).collect()}
    assert got == {("s", 0): ("hi", "a\nb", ["T"], 4), ("s", 1): ("bye", "", ["T"], 0)}


def test_store(spark, tmp_path):
    s = store.SnapshotStore(spark, f"file://{tmp_path}/s", {"dim": 4})
    old = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "k string, l string, v int")
    s.commit(rows=old)
    s.commit(rows=store.upsert(s.read("rows"), spark.createDataFrame([("a", None, 9)], old.schema), ["k", "l"]))
    assert {(r.k, r.v) for r in store.SnapshotStore(spark, f"file://{tmp_path}/s").read("rows").collect()} == {("a", 9), ("b", 2)}
    with pytest.raises(ValueError):
        store.SnapshotStore(spark, f"file://{tmp_path}/s", {"dim": 8})
    assert store.prune(old, old.where("false"), "k").count() == 2


def test_scan(spark, tmp_path):
    for name, text in {"a.py": "x = 1\n", "b.min.js": "y" * 3000, "Makefile": "all:\n", "empty.py": "", "node_modules/z.py": "q"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = scan.scan_directory(spark, str(tmp_path), ["**/*.py", "**/*.js", "**/Makefile"], ["**/node_modules/**"], [".py", ".js", ".makefile"], use_git=False)
    assert {r.path: r.status for r in got.collect()} == {"a.py": "indexed", "b.min.js": "minified", "Makefile": "indexed"}  # Spark's reader passes over empty files
    doc = spark.createDataFrame([("---\nname: N\ntags: t\n---\nbody",), ("plain",)], "t string").select(scan.weighted_text("t").alias("w")).collect()
    assert [r.w for r in doc] == ["name: N\ntags: t\nbody", "plain"]


def test_metrics(spark):
    res = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (2, "z", 1)], "query_id int, item string, rank int")
    exp = spark.createDataFrame([(1, "b"), (1, "q"), (2, "y")], "query_id int, item string")
    got = {r.query_id: (r.recall, r.rr) for r in tl.retrieval_metrics(res, exp, 5).collect()}
    assert got == {1: (0.5, pytest.approx(1 / 3)), 2: (0.0, 0.0)}


def test_embedder_is_deterministic(spark):
    e = vx.HashingEmbedder(16)
    a = e.embed(["getUser name", "", "get user name"])
    assert (a[0] == a[2]).all() and not a[1].any()
