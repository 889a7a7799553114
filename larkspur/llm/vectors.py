"""Near-duplicate vectors by a robust-pruned flat graph.

1. Equal vectors form a class; only its least vec_id goes on.
2. Centres are fitted on a bounded sample. A vector belongs to the shards of its nearest centres (overlap).
   A shard of more than BLOCK vectors is dealt into blocks by hash.
3. In each block every vector gets its nearest ones as candidates, pruned robustly: a candidate is dropped
   if a chosen neighbour is closer to it by a factor; reverse edges are added. A vector's adjacency lists
   from all its shards are united.
4. Every vector is searched in its nearest shards (all their blocks) from the block's medoid, spread rows and
   one row of each part that these don't reach: a greedy beam first, then the range is expanded, every hit's
   neighbours being looked at, until no new hit turns up.
5. Hits are checked by their cosine in double precision. Recall is audited by comparing a bounded set of
   vectors with all, vector by vector and by number of links; below the aim the graph is built again with more
   overlap, and if the last build misses it too, vectors are compared exactly with every shard that can hold
   a link of theirs."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, ship
from .components import connected_components

SHARD, BLOCK, MAX_CENTRES = 1000, 4096, 4096
#: Vectors that the centres are fitted on, and that recall is audited on, at most; where the audited vectors have
#: no links, others are audited, up to AUDIT_MORE in all.
SAMPLE, AUDIT, AUDIT_MORE = 16384, 1024, 8192
#: Audited vectors that a recall by number of links is taken over, at least.
STRATUM = 8
OVERLAP, MORE_PROBES, MIN_RECALL, ROUNDS = 2, 1, 0.98, 3
DEGREE, CANDIDATES, ALPHA, BEAM, WIDTH = 24, 64, 1.2, 32, 4
#: One row in so many is a start of the search besides the medoid.
SPREAD = 16


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that huge or tiny components do no harm."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(11)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def robust_prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours of each row of unit vectors, reverse edges included (up to ``degree`` more, and beyond that
    for rows that nothing else leads to)."""
    m = len(x)
    if m < 2:
        return [np.zeros(0, np.int64)] * m
    k = min(CANDIDATES, m - 1)
    out: list[np.ndarray] = []
    for a in range(0, m, 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        cand = np.argpartition(-s, k - 1, 1)[:, :k]
        near = np.take_along_axis(s, cand, 1)
        order = np.argsort(-near, 1, kind="stable")
        cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
        far = 2 - 2 * near  # squared distances
        between = 2 - 2 * np.einsum("nid,njd->nij", x[cand], x[cand])
        alive, chosen = np.ones(cand.shape, bool), np.zeros(cand.shape, bool)
        rows = np.arange(len(cand))
        for _ in range(min(degree, k)):
            left = alive.any(1)
            if not left.any():
                break
            pick = alive.argmax(1)
            chosen[rows[left], pick[left]] = True
            # a candidate that a chosen one is closer to by the factor is reached through it
            alive &= ~((alpha * alpha * between[rows, pick] <= far) & left[:, None])
            alive[rows, pick] = False
        out += [c[b] for c, b in zip(cand, chosen)]
    back: list[list[int]] = [[] for _ in range(m)]
    for i, n in enumerate(out):
        for j in n.tolist():
            if len(back[j]) < degree:
                back[j].append(i)
    led_to = np.zeros(m, bool)
    led_to[np.concatenate([*out, *(np.array(b, np.int64) for b in back)])] = True
    for i in np.flatnonzero(~led_to).tolist():
        back[min(out[i].tolist(), key=lambda j: len(back[j]))].append(i)
    return [np.unique(np.concatenate([n, np.array(b, np.int64)])).astype(np.int64) for n, b in zip(out, back)]


def starts(x: np.ndarray, adjacency: np.ndarray) -> np.ndarray:
    """Rows to search from: the medoid, one row in SPREAD, and a row of each part that these don't reach."""
    picked = np.unique(np.append(np.arange(0, len(x), SPREAD), (x @ x.mean(0)).argmax()))
    more, front, seen = [], picked, np.zeros(len(x), bool)
    while True:
        while len(front):
            seen[front] = True
            near = np.unique(adjacency[front])
            near = near[near >= 0]
            front = near[~seen[near]]
        if seen.all():
            return np.concatenate([picked, np.array(more, np.int64)])
        front = np.array([seen.argmin()])
        more.append(front[0])


def range_search(x: np.ndarray, adjacency: np.ndarray, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs of inner product ``least`` or more that greedy search from ``starts`` and range
    expansion find. ``adjacency``: rows of x, padded with -1."""
    m = len(x)
    first = starts(x, adjacency)
    width = min(BEAM, len(first))
    found_q, found_x = [], []
    for a in range(0, len(queries), 256):
        q = queries[a : a + 256]
        n, rows = len(q), np.arange(len(q))
        seen = np.zeros((n, m), bool)
        seen[:, first] = True
        ids = np.full((n, BEAM), -1)
        score = np.full((n, BEAM), -np.inf)
        done = np.ones((n, BEAM), bool)
        value = q @ x[first].T
        best = np.argpartition(-value, width - 1, 1)[:, :width]
        ids[:, :width], score[:, :width], done[:, :width] = first[best], np.take_along_axis(value, best, 1), False
        opened = np.zeros((n, m), bool)
        hits = np.zeros((n, m), bool)
        hits[:, first] = value >= least
        while not done.all():
            live = np.flatnonzero(~done.all(1))
            s = np.where(done[live], -np.inf, score[live])
            pick = np.argpartition(-s, WIDTH - 1, 1)[:, :WIDTH]
            ok = np.isfinite(np.take_along_axis(s, pick, 1))
            nodes = np.where(ok, np.take_along_axis(ids[live], pick, 1), 0)
            flags = done[live]
            np.put_along_axis(flags, pick, True, 1)
            done[live] = flags
            opened[live[:, None], nodes] |= ok
            near = np.where(ok[:, :, None], adjacency[nodes], -1).reshape(len(live), -1)
            near.sort(1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = (near >= 0) & ~seen[live[:, None], near]
            r, c = np.nonzero(fresh)
            if not len(r):
                continue
            got = near[r, c]
            seen[live[r], got] = True
            value = np.einsum("nd,nd->n", x[got], q[live[r]])
            hits[live[r], got] = value >= least
            add = np.full(near.shape, -np.inf)
            add[r, c] = value
            all_ids = np.concatenate([ids[live], near], 1)
            all_score = np.concatenate([score[live], add], 1)
            all_done = np.concatenate([done[live], ~fresh], 1)
            best = np.argpartition(-all_score, BEAM - 1, 1)[:, :BEAM]
            ids[live], score[live], done[live] = (np.take_along_axis(y, best, 1) for y in (all_ids, all_score, all_done))
        while True:
            r, c = np.nonzero(hits & ~opened)
            if not len(r):
                break
            r, c = r[:20_000], c[:20_000]
            opened[r, c] = True
            near = adjacency[c]
            who = np.repeat(r, near.shape[1])
            key = np.unique((who * m + near.ravel())[near.ravel() >= 0])
            who, near = key // m, key % m
            fresh = ~seen[who, near]
            who, near = who[fresh], near[fresh]
            seen[who, near] = True
            hits[who, near] = np.einsum("nd,nd->n", x[near], q[who]) >= least
        r, c = np.nonzero(hits)
        found_q.append(r + a)
        found_x.append(c)
    return (np.concatenate(found_q), np.concatenate(found_x)) if found_q else (np.zeros(0, np.int64),) * 2


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = np.asarray(pc.list_value_length(col).fill_null(0))
    flat = np.asarray(col.flatten())
    if (n == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(n), dim), flat.dtype)
    out[np.arange(dim) < n[:, None]] = flat
    return out


@dataclass
class Found:
    """rows: vec_id, n_links, component_id, kept. links: a < b of class representatives, and copies of each.
    recall: the least of the audited vectors' mean and of the means by number of links, None if AUDIT_MORE vectors
    (or all there are) have no links; 1.0 if compared exactly. overlap: shards of a vector in the last build, 0 if
    compared exactly."""

    rows: DataFrame
    links: DataFrame
    recall: float | None
    overlap: int


PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _routed(classes: DataFrame, dim: int, centres: np.ndarray, overlap: int, reach: np.ndarray | None = None) -> DataFrame:
    """Each class' shards, nearest first: own (to be a node of) and shards (to be searched), MORE_PROBES more
    or, with ``reach``, all whose centre is within the shard's angle of it."""
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*classes.select("id", "embedding").schema.fields, T.StructField("own", ints), T.StructField("shards", ints)])

    def run(batches):
        for b in batches:
            x = unit(_matrix(b.column(1), dim)) if b.num_rows else np.zeros((0, dim))
            s = x @ centres.T
            top = np.argsort(-s, 1, kind="stable").astype(np.int32)
            own = list(top[:, :overlap])
            shards = list(top[:, : overlap + MORE_PROBES]) if reach is None else [t[w] for t, w in zip(top, np.take_along_axis(_angle(s) <= reach, top, 1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.list_(pa.int32())), pa.array(shards, pa.list_(pa.int32()))], names=schema.names)

    return classes.select("id", "embedding").mapInArrow(run, schema)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _reach(classes: DataFrame, dim: int, centres: np.ndarray, least: float) -> np.ndarray:
    """How far a shard's centre can be, as an angle, from a vector that a vector of the shard (those nearest to
    that centre) links to: the widest angle in the shard and that of a link, by the triangle inequality."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = unit(_matrix(b.column(0), dim)) @ centres.T
                near = np.argsort(-s, 1, kind="stable")[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(_angle(s[np.arange(len(s)), near]))], names=["shard", "angle"])

    out = np.full(len(centres), -1.0)
    for r in classes.select("embedding").mapInArrow(run, "shard int, angle double").groupBy("shard").agg(F.max("angle").alias("angle")).collect():  # a row a centre at most
        out[r.shard] = r.angle + math.acos(max(-1.0, min(1.0, least))) + 1e-6
    return out


def _pairs(classes: DataFrame, dim: int, centres: np.ndarray, least: float, overlap: int, scratch: Scratch) -> DataFrame:
    """Verified links (a < b) found with ``overlap`` shards a vector and MORE_PROBES more for its search; with
    overlap 0 all links, each vector being compared with all shards within reach."""
    spark = classes.sparkSession
    exact = not overlap
    reach = _reach(classes, dim, centres, least) if exact else None
    routed = scratch.table(_routed(classes, dim, centres, max(overlap, 1), reach), "routed")
    sizes = {}
    for k, column in enumerate(("own", "shards")):
        for r in routed.select(F.explode(column).alias("shard")).groupBy("shard").count().collect():  # a row a centre at most
            sizes.setdefault(r.shard, [0, 0])[k] = r["count"]
    parts = spark.createDataFrame([(s, max(1, -(-n // BLOCK)), max(1, -(-q // BLOCK))) for s, (n, q) in sizes.items()], "shard int, blocks int, query_parts int")
    own = routed.select("id", "embedding", F.explode("own").alias("shard")).join(parts, "shard")
    own = own.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        near = robust_prune(unit(_matrix(t["embedding"], dim)).astype(np.float32))
        ids = t["id"].to_numpy()
        off = np.concatenate([[0], np.cumsum([len(n) for n in near])]).astype(np.int32)
        flat = ids[np.concatenate(near)] if len(near) else np.zeros(0, np.int64)
        return pa.table({"id": ids, "near": pa.ListArray.from_arrays(pa.array(off), pa.array(flat))})

    if exact:
        own = own.withColumn("near", F.array().cast("array<bigint>"))
    else:
        lists = own.select("shard", "block", "id", "embedding").groupBy("shard", "block").applyInArrow(build, "id long, near array<long>")
        graph = scratch.table(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
        own = own.join(graph, "id")
    nodes = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)))
    nodes = nodes.select("shard", "block", "part", "id", "embedding", "near")
    asks = routed.select("id", "embedding", F.explode("shards").alias("shard")).join(parts, "shard")
    asks = asks.withColumn("part", F.pmod(F.xxhash64(F.lit(7), "id"), F.col("query_parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asks = asks.select("shard", "block", "part", "id", "embedding", F.lit(None).cast("array<bigint>").alias("near"))

    def search(t: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        is_node = np.asarray(t["near"].combine_chunks().is_valid())
        node, ask = t.filter(pa.array(is_node)).sort_by("id"), t.filter(pa.array(~is_node))
        if not node.num_rows or not ask.num_rows:
            return none
        ids, asked = node["id"].to_numpy(), ask["id"].to_numpy()
        x, q = unit(_matrix(node["embedding"], dim)), unit(_matrix(ask["embedding"], dim))
        if exact:
            found = [np.nonzero(q[a : a + 512] @ x.T >= least - 1e-9) for a in range(0, len(q), 512)]
            i, j = np.concatenate([r + 512 * k for k, (r, _) in enumerate(found)]), np.concatenate([c for _, c in found])
        else:
            near = node["near"].combine_chunks()
            size = np.asarray(pc.list_value_length(near))
            flat = np.asarray(near.flatten())
            at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
            at = np.where(ids[at] == flat, at, -1)  # united lists name vectors of other shards too
            adjacency = np.full((len(ids), max(1, int(size.max()))), -1)
            adjacency[np.arange(adjacency.shape[1]) < size[:, None]] = at
            i, j = range_search(x.astype(np.float32), adjacency, q.astype(np.float32), least - 1e-4)
        sure = np.einsum("nd,nd->n", q[i], x[j]) >= least
        a, b = asked[i[sure]], ids[j[sure]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)}).filter(pa.array(a != b))

    pairs = nodes.unionByName(asks).groupBy("shard", "block", "part").applyInArrow(search, PAIRS).distinct()
    return scratch.table(pairs, "pairs")


def worst_recall(true: np.ndarray, hit: np.ndarray) -> float:
    """The least of the vectors' mean recall and of its means by number of links (powers of four, those of too
    few vectors put together). ``true``, ``hit``: links of each vector, and those found."""
    recall, order = hit / true, np.argsort(true, kind="stable")
    means, held = [recall.mean()], []
    for _, group in itertools.groupby(order.tolist(), lambda k: (int(true[k]).bit_length() + 1) // 2):
        held += group
        if len(held) >= STRATUM:
            means.append(recall[held].mean())
            held = []
    # few vectors of many links count with the largest others, which their hits must not hide
    if held:
        means.append(recall[order[-max(len(held), STRATUM) :]].mean())
    return float(min(means))


def _audit(classes: DataFrame, dim: int, pairs: DataFrame, least: float) -> float | None:
    """``worst_recall`` of ``pairs`` for a bounded set of vectors."""
    size, n = AUDIT, classes.count()
    while (recall := _audited(classes, dim, pairs, least, size)) is None and size < min(n, AUDIT_MORE):
        size *= 8
    return recall


def _audited(classes: DataFrame, dim: int, pairs: DataFrame, least: float, size: int) -> float | None:
    """``worst_recall`` of ``pairs`` for ``size`` vectors, by comparing them with all rows in blocks."""
    picked = classes.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(size).select("id", "embedding").toArrow()
    if not picked.num_rows:
        return None
    ids, q = picked["id"].to_numpy(), unit(_matrix(picked["embedding"], dim))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                i, j = np.nonzero(q @ unit(_matrix(b.column(1), dim)).T >= least)
                x, y = ids[i], b.column(0).to_numpy()[j]
                yield pa.RecordBatch.from_arrays([pa.array(c[x != y]) for c in (x, np.minimum(x, y), np.maximum(x, y))], names=["id", "a", "b"])

    true = classes.select("id", "embedding").mapInArrow(run, T.StructType([T.StructField("id", T.LongType()), *PAIRS.fields]))
    got = true.join(pairs.withColumn("hit", F.lit(1)), ["a", "b"], "left").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hit")).collect()  # a row an audited vector at most
    return worst_recall(np.array([r.n for r in got]), np.array([r.hit for r in got])) if got else None


def vector_near_duplicates(vectors: DataFrame, least: float = 0.95) -> Found:
    """Links rows of ``vectors`` (vec_id, embedding; other columns are ignored) with a cosine of ``least`` or more.

    rows: one for each row of ``vectors``: vec_id, n_links (other rows linked directly, copies included),
    component_id (smallest vec_id reachable), kept (vec_id = component_id). Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing, and so do rows without vec_id (component null,
    kept). Shorter vectors count as filled up with zeros. vec_id is meant to be unique. An empty table gives
    no rows."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "vectors")
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    keyed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, v).alias("embedding")).withColumn("k1", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding"))).withColumn("k2", F.when(F.col("embedding").isNotNull(), F.xxhash64(F.lit(1), "embedding")))
    classes = keyed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    classes = scratch.table(classes, "classes")
    n, dim = classes.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    dim = dim or 1
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()
    centres = fit_centres(unit(_matrix(sample["embedding"], dim)), min(MAX_CENTRES, -(-n // SHARD))) if n else np.zeros((1, dim))
    overlap, recall = OVERLAP, None
    for _ in range(ROUNDS):
        pairs = _pairs(classes, dim, centres, least, overlap, scratch)
        recall = _audit(classes, dim, pairs, least)
        if recall is None or recall >= MIN_RECALL:
            break
        scratch.drop(pairs)
        overlap *= 2
    else:
        pairs, recall, overlap = _pairs(classes, dim, centres, least, 0, scratch), 1.0, 0
    sizes = classes.select("id", "copies")
    ends = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.join(sizes.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.sum("copies").alias("linked"))
    parts = connected_components(pairs, scratch)
    out = keyed.select("vec_id", "k1", "k2").join(classes.select("k1", "k2", "id", "copies"), ["k1", "k2"], "left")
    out = out.join(degree.withColumnRenamed("a", "id"), "id", "left").join(parts, "id", "left")
    component = F.coalesce("component", "id", "vec_id")
    rows = out.select("vec_id", (F.coalesce("linked", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
    return Found(rows, pairs, recall, overlap)


#: The same for DuckDB, by comparing all vectors.
VECTORS_SQL = """
WITH RECURSIVE ok AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
v AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM ok),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id, vec_id AS root FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.root = l.a),
c AS (SELECT vec_id, min(root) AS component FROM r GROUP BY 1), d AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component = vec_id, true) AS kept
FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN d USING (vec_id)
"""
