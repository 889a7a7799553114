"""What queries do on inputs where repeated rows meet: the rows their steps make grow no faster than the input."""

from pyspark.sql import functions as F

from larkspur import runtime
from larkspur.operators import graph as gr
from larkspur.operators import history as hs
from larkspur.operators import retrieval as rt
from larkspur.operators import symbols as sy
from larkspur.plans import registry
from larkspur.sources.store import SnapshotStore


def rows_made(spark, make, node="Join", name="number of output rows"):
    """(rows of a DataFrame that ``make`` returns, most rows that an operator of that name made on the way)."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, found = store.executionsCount(), [r.asDict() for r in make().collect()]
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    most, all_ = 0, store.executionsList()
    for i in range(before, all_.size()):
        at = all_.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for k in range(nodes.size()):
            n = nodes.apply(k)
            for m in range(n.metrics().size() if node in n.name() else 0):
                metric = n.metrics().apply(m)
                if metric.name() == name and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return found, most


def test_repeated_namespaces_meet_a_line_once(spark):
    ex = spark.createDataFrame([(1, 1, "f", "function")], "export_id long, file_id long, name string, type string")
    im = spark.range(300).selectExpr("id AS import_id", "2L AS file_id", "'ns' AS local", "'' AS original", "1L AS resolved_file_id", "true AS is_namespace")
    rf = spark.range(2000).selectExpr("id AS ref_id", "2L AS file_id", "IF(id % 2 = 0, 'ns', 'f') AS name", "id % 10 DIV 2 AS line")
    got, most = rows_made(spark, lambda: sy.resolve_references(rf, ex, im))
    assert len(got) == 2000 and {(r["name"], r["resolved_export_id"]) for r in got} == {("ns", None), ("f", 1)}
    assert most <= 4000


def test_references_in_ranges_are_counted_without_pairs(spark):
    cells = [(1, k % 40, k) for k in range(1500)] + [(1, None, 1), (None, 3, 2), (2, 5, 3)]
    refs = spark.createDataFrame(cells, "file_id long, line long, ref_id long")
    spans = [(k, 1, k % 37 + 1, k % 37 + k % 5) for k in range(1500)] + [(2000, 2, 6, 6), (2001, 2, 7, 9), (2002, 1, None, 9), (2003, None, 1, 9), (2004, 3, 1, 9)]
    ranges = spark.createDataFrame(spans, "chunk_id long, file_id long, start_line long, end_line long")
    got, most = rows_made(spark, lambda: sy.count_in_range(refs, ranges, ["file_id"]))
    want = {r.chunk_id: r["count"] for r in sy.in_range(refs, ranges, ["file_id"]).groupBy("chunk_id").count().collect()}
    assert {r["chunk_id"]: r["refs"] for r in got} == want and most <= 3100


def test_edges_are_dealt_out_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "TASK_ROWS", 500)
    rows = spark.range(6000).selectExpr("id DIV 4 AS l_orderkey", "CAST(id % 4 AS INT) AS l_linenumber", "id % 997 AS l_partkey", "id % 7 AS l_suppkey")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    e = registry.edges(spark, str(tmp_path))
    sizes = e.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert sum(sizes) == e.count() == rows.join(rows.select((rows.l_orderkey).alias("o"), (rows.l_linenumber - 1).alias("n"), (rows.l_partkey).alias("dst")), F.expr("o = l_orderkey AND n = l_linenumber")).select("l_partkey", "dst").distinct().count()
    assert max(sizes) < 800


def test_a_spine_makes_its_edges_once(spark):
    made, n = spark.sparkContext.accumulator(0), 12
    e = spark.createDataFrame(spark.sparkContext.parallelize([(k, k + 1) for k in range(n)]).map(lambda x: (made.add(1), x)[1]), "src long, dst long")
    seed = lambda k: spark.createDataFrame([(k,)], "node long")
    found = gr.spine(e, gr.trace(e, seed(0), seed(5)))
    assert [r.node for r in found.orderBy("step").collect()] == [0, 1, 2, 3, 4, 5]
    assert made.value <= 2 * n


def test_an_index_shuffles_no_occurrences_of_words(spark, tmp_path):
    docs = spark.range(60).selectExpr("id", "IF(id % 9 = 0, NULL, array_join(transform(sequence(1, 100), x -> concat('w', (x * id) % 13)), ' ')) AS text")
    store = SnapshotStore(spark, str(tmp_path))
    got, most = rows_made(spark, lambda: rt.TextIndex(store, "p", "id").build(docs).store.read("p"), "Exchange", "shuffle records written")
    want = docs.select("id", F.posexplode(F.split("text", " ")).alias("pos", "term")).groupBy("id", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions")).collect()
    assert sorted((r["id"], r["term"], r["positions"]) for r in got) == sorted((r.id, r.term, r.positions) for r in want)
    assert {r["dl"] for r in got} == {100} and most <= 60


def history(spark):
    c = spark.range(900).selectExpr("id AS commit_id", "concat('2024-01-', lpad(CAST(id % 28 + 1 AS STRING), 2, '0')) AS date")
    f = c.selectExpr("commit_id", "explode(array('hot', concat('f', commit_id % 50))) AS file_path")
    return c, f


def test_newest_commits_of_a_hot_file_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(runtime, "TASK_ROWS", 100)
    c, f = history(spark)
    plain, dealt = hs.newest_per_file(c, f, 3), hs.newest_per_file(c, f, 3, 1800)
    cells = lambda d: sorted((r.file_path, r.commit_id, r["rank"]) for r in d.collect())
    assert cells(dealt) == cells(plain) and len(cells(dealt)) == 153
    # 900 rows of the hot file come in as at most three of each part
    _, most = rows_made(spark, lambda: dealt, "Exchange", "shuffle records written")
    assert dealt.rdd.getNumPartitions() == 18 and most <= 1800


def test_notes_meet_changes_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(runtime, "TASK_ROWS", 100)
    notes = spark.range(400).selectExpr("id", "IF(id % 11 = 0, NULL, concat('s', id % 5)) AS commit_hash", "transform(sequence(1, 5), x -> concat('p', (x * id) % 17)) AS files_involved")
    changes = spark.range(17).selectExpr("explode(array('s1', 's2')) AS sha", "concat('p', id) AS path").where("path <> 'p3'")
    known = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s1",)], "sha string")
    seen = []
    monkeypatch.setattr(hs, "dealt", lambda df, rows, *keys: seen.append((rows, keys)) or runtime.dealt(df, rows, *keys))
    cells = lambda d: sorted((r.id, r.verdict or "", r.stale_files or []) for r in d.collect())
    assert cells(hs.freshness(notes, changes, known, 2000)) == cells(hs.freshness(notes, changes, known))
    assert seen == [(2000, ("commit_hash", "path"))]


def test_module_candidates_are_made_once_for_each_specifier(spark):
    files = spark.createDataFrame([(1, "src/a/m.py"), (2, "p/x/b/n.py"), (3, "p/c/two.py"), (4, "q/c/two.py")], "file_id long, path string")
    im = spark.range(900).selectExpr("id DIV 3 AS import_id", "concat(element_at(array('p', 'q', 'z'), CAST(id % 3 AS INT) + 1), '/f', id, '.py') AS path", "element_at(array('a.m', 'b.n', 'c.two', 'no.thing'), CAST(id DIV 3 % 4 AS INT) + 1) AS specifier")
    got, most = rows_made(spark, lambda: sy.resolve_imports(im, files), "Generate")
    want = {"a.m": [1, 1, 1], "b.n": [2, 2, 2], "c.two": [3, 4], "no.thing": []}
    assert sorted((r["import_id"], r["resolved_file_id"]) for r in got) == sorted((k, f) for k in range(300) for f in want[["a.m", "b.n", "c.two", "no.thing"][k % 4]])
    assert most <= 900
