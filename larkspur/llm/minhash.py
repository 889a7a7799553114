"""Near-duplicate documents: MinHash, banding, signature check, exact check, connected components.

1. Every text becomes a set of word shingles (64-bit hashes), a fingerprint of the set and a signature of
   universal hash minima. Equal sets form a class; only its least document goes on.
2. Bands of the signature make buckets. In a bucket all members are paired with its least one only.
3. Pairs that sizes and signatures don't rule out are checked on full sets: the members of a head are dealt to
   tasks with a copy of the head's set for each part of STAR members. Links give components.
4. Buckets that still hold several components are compared across components only: the members outside a
   bucket's largest component (the rest) with all. Where the rest is more than a block, other members are first
   tried as heads, each trial in proportion to the bucket, until that stops making the rest much smaller.
   Components that a plausible pair connects meet in a cell, whose members are compared on full sets in the same
   manner, so that every candidate pair is either checked or known to be connected. Then components are made
   again. Tasks pass on spanning forests, never all pairs; n members with a rest of r pass n * ceil(r / BLOCK)
   rows, which is in proportion to n unless many members are like none of the others.

With rows r and bands b, a pair at similarity s shares no bucket with probability (1 - s**r)**b: 3e-6 at 0.8
with the defaults, less above. The signature check drops a pair at 0.8 that agrees in less than
``threshold - slack``: five standard errors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, sent_if_small, ship, with_ids
from .components import connected_components
from .textkernel import hash_spans, mix, ragged, rows_of, texts, words

BANDS, ROWS = 24, 4
#: Signature agreement may fall short of the threshold by so much.
SLACK = 0.2
#: Members, and shingles of theirs, on a side of a comparison that one task makes at once.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
#: Members that one copy of a head's set is sent with.
STAR = 2048
#: Times that other members than the least are tried as heads of a bucket whose rest is more than a block, at
#: most, and the share that a trial must take off the rest to be followed by another.
TRIALS, WORTH = 8, 0.1

_rng = np.random.default_rng(77)
_MUL = (_rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their offsets.

    A text of fewer than k words is one shingle of them all; one without words has none."""
    s, e, at = words(buf, off)
    h = hash_spans(buf, s, e, lower=True)
    n = np.diff(at)
    if len(h) >= k:
        grams = h[: len(h) - k + 1] * _PLACE[0]
        for i in range(1, k):
            grams = grams + h[i : len(h) - k + 1 + i] * _PLACE[i]
        grams = mix(grams)
    else:
        grams = np.zeros(0, np.uint64)
    out, sizes = [], np.zeros(len(n), np.int64)
    for d, (a, m) in enumerate(zip(at.tolist(), n.tolist())):
        if m >= k:
            u = np.unique(grams[a : a + m - k + 1])
        elif m:
            u = mix((h[a : a + m] * _PLACE[:m]).sum(keepdims=True) + np.uint64(m))
        else:
            continue
        sizes[d] = len(u)
        out.append(u)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minima of BANDS*ROWS universal hashes of each set; rows of empty sets are zero."""
    out = np.zeros((len(at) - 1, BANDS * ROWS), np.uint32)
    full = np.flatnonzero(np.diff(at))
    x = (sets >> np.uint64(32)).astype(np.uint32)
    k = 0
    while k < len(full):  # some ten thousand hashes at a time stay in the cache
        to = max(k + 1, int(np.searchsorted(at[full + 1], at[full[k]] + 32768, "right")))
        a, b = at[full[k]], at[full[to - 1] + 1]
        part, starts = x[a:b], at[full[k:to]] - a
        for i in range(BANDS * ROWS):
            out[full[k:to], i] = np.minimum.reduceat(part * _MUL[i] + _ADD[i], starts)
        k = to
    return out


SIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()),
    T.StructField("signature", T.ArrayType(T.IntegerType())),
])
PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
SETS = T.StructType([T.StructField("id", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])


def signed(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for b in rows_of(batches):
            sets, at = shingle_sets(*texts(b.column(1)), k)
            n = np.diff(at)
            f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            full = np.flatnonzero(n)
            if len(full):
                f1[full] = np.add.reduceat(mix(sets + np.uint64(0x9E3779B97F4A7C15)), at[full])
                f2[full] = np.add.reduceat(mix(sets ^ np.uint64(0xC2B2AE3D27D4EB4F)), at[full])
            sig = signatures(sets, at).view(np.int32)
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * sig.shape[1]), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), sig], names=[f.name for f in SIGNED])

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for b in rows_of(batches):
            sets, at = shingle_sets(*texts(b.column(1)), k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))], names=["id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, SETS)


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose sizes and signatures allow the wanted similarity."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("signature").alias(f"s{c}"))
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        .where(same >= (percent / 100 - SLACK) * BANDS * ROWS)
        .select("a", "b")
    )


def _in_common(heads: tuple[np.ndarray, np.ndarray], group: np.ndarray, sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many shingles each set shares with its group's head. ``heads``: group and shingle of each of theirs."""
    key = lambda g, x: mix(x + g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    known, n = np.sort(key(*heads)), np.diff(at)
    mine = key(np.repeat(group, n), sets)
    hit = np.zeros(len(mine), np.int64)
    if len(known):
        hit = (known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(hit)])
    return ends[at[1:]] - ends[at[:-1]]


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links: the pairs (a: head, b) whose full sets have the wanted similarity. Only sets of documents in pairs
    are made. A head of more than STAR members is dealt out in parts; rows come sorted by part, the head's set
    first, and a task holds one head's set at a time."""
    wanted = scratch.table(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct(), "wanted")
    sets = scratch.table(full_sets(with_ids(docs.select("doc_id", "text"), wanted, "doc_id"), k), "sets")
    crowds = scratch.table(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts")).where("parts > 1"), "crowds")
    dealt = pairs.join(sent_if_small(crowds), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    heads = dealt.select("a", "part").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "shingles")
    members = dealt.join(sets.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "shingles")

    def run(batches):
        last, held = None, np.zeros(0, np.uint64)
        for t in batches:
            if not t.num_rows:
                continue
            a, part, b = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2)
            s = t.column(3)
            flat, n = np.asarray(s.flatten()).view(np.uint64), np.asarray(pc.list_value_length(s)).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(n)])
            new = np.append(True, (a[1:] != a[:-1]) | (part[1:] != part[:-1]))
            group = np.cumsum(new)
            is_head = ~np.asarray(b.is_valid())
            goes_on = last == (a[0], part[0])
            own = np.repeat(is_head, n)
            known = (np.concatenate([np.full(len(held) if goes_on else 0, 1), np.repeat(group, n)[own]]), np.concatenate([held if goes_on else held[:0], flat[own]]))
            common = _in_common(known, group, flat, at)
            size = np.zeros(int(group[-1]) + 1, np.int64)
            np.add.at(size, known[0], 1)
            link = ~is_head & (100 * common >= percent * (n + size[group] - common))
            yield pa.RecordBatch.from_arrays([pa.array(a[link]), b.filter(pa.array(link))], names=["a", "b"])
            last, held = (a[-1], part[-1]), known[1][known[0] == group[-1]]

    ordered = heads.unionAll(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    links = scratch.table(ordered.mapInArrow(run, PAIRS), "links")
    scratch.drop(sets, wanted)
    return links


class Forest:
    """Union-find over small numbers; ``tree`` is each member's root."""

    def __init__(self, labels: np.ndarray):
        self.tree = np.unique(labels, return_inverse=True)[1]

    def join(self, x: int, y: int) -> None:
        self.tree[self.tree == self.tree[y]] = self.tree[x]


def _crowds(members: DataFrame, key: str, scratch: Scratch, weight: str | None = None) -> DataFrame:
    """Of each value of ``key`` that holds several components: main, the one of most members; blocks of all
    members and of the rest outside it, by number or ``weight``."""
    total = F.sum(weight) if weight else F.lit(0)
    parts = members.groupBy(key, "component").agg(F.count(F.lit(1)).alias("c"), total.alias("w"))
    blocks = lambda c, w: F.greatest(F.ceil(c / BLOCK), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    found = parts.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("n"), F.sum("w").alias("wn"), F.max(F.struct("c", (-F.col("component")).alias("o"), "w")).alias("m")).where("k > 1")
    rest, rest_w = F.col("n") - F.col("m.c"), F.col("wn") - F.col("m.w")
    return scratch.table(found.select(key, (-F.col("m.o")).alias("main"), rest.alias("rest"), blocks(F.col("n"), F.col("wn")).alias("blocks"), blocks(rest, rest_w).alias("rest_blocks")), "crowds")


def _blocked(members: DataFrame, crowds: DataFrame, key: str) -> DataFrame:
    """``members`` of ``crowds`` dealt into groups (key, i, j) that a task can hold, with asks: false for a member
    that is compared with, true for one of the rest that is compared with these, null in the only group of a
    small crowd, where all are compared with each other."""
    d = members.join(sent_if_small(crowds), key)
    mine = lambda seed, blocks: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(blocks)).cast("int")
    all_of = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    zero = F.lit(0)
    alone = d.where("blocks = 1").withColumn("i", zero).withColumn("j", zero).withColumn("asks", F.lit(None).cast("boolean"))
    there = d.where("blocks > 1").withColumn("i", mine(1, "blocks")).withColumn("j", all_of("rest_blocks")).withColumn("asks", F.lit(False))
    asking = d.where("blocks > 1 and component <> main").withColumn("j", mine(2, "rest_blocks")).withColumn("i", all_of("blocks")).withColumn("asks", F.lit(True))
    dealt = alone.unionByName(there).unionByName(asking).drop("main", "rest", "blocks", "rest_blocks")
    # by all three, or else one key's groups would meet in the task that its join has put them in
    return dealt.repartition(key, "i", "j").groupBy(key, "i", "j")


def _compare(t: pa.Table, percent: int, exact: bool) -> tuple[list[int], list[int], np.ndarray]:
    """Places (x, y) of pairs that join two components of a group, directly or by earlier pairs not yet one:
    a spanning forest, so at most one pair a member. Pairs are plausible by size and signature, and if
    ``exact`` they are links by their full sets."""
    comp, n = (t[c].to_numpy() for c in ("component", "n"))
    asks = np.asarray(t["asks"].combine_chunks().fill_null(False))
    base, all_ask = np.flatnonzero(~asks), not asks.any()
    sig = np.asarray(t["signature"].combine_chunks().flatten()).reshape(len(t), -1)
    least = (percent / 100 - SLACK) * sig.shape[1]
    forest = Forest(comp)
    if exact:
        sets = t["shingles"].combine_chunks()
        local = np.unique(np.asarray(sets.flatten()), return_inverse=True)[1]
        size = np.asarray(pc.list_value_length(sets)).astype(np.int64)
        first = np.cumsum(size) - size
        flag = np.zeros(int(local.max(initial=0)) + 1, bool)
    found_x, found_y = [], []
    for x in range(len(t)) if all_ask else np.flatnonzero(asks).tolist():
        y = base[x + 1 :] if all_ask else base
        y = y[(forest.tree[y] != forest.tree[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
        y = y[(sig[y] == sig[x]).sum(1) >= least]
        if exact and len(y):
            own = local[first[x] : first[x] + size[x]]
            flag[own] = True
            common = np.add.reduceat(flag[local[ragged(first[y], size[y])]].astype(np.int64), np.cumsum(size[y]) - size[y])
            flag[own] = False
            y = y[100 * common >= percent * (size[x] + size[y] - common)]
        for k in y.tolist():
            if forest.tree[k] != forest.tree[x]:
                forest.join(x, k)
                found_x.append(x)
                found_y.append(k)
    return found_x, found_y, comp


def _plausible_components(members: DataFrame, crowds: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of components that some plausible pair in a bucket connects (enough of them)."""

    def run(t: pa.Table) -> pa.Table:
        x, y, comp = _compare(t, percent, False)
        return pa.table({"a": np.maximum(comp[x], comp[y]), "b": np.minimum(comp[x], comp[y])})

    return _blocked(members, crowds, "bucket").applyInArrow(run, PAIRS).distinct()


def _links_in_cells(cells: DataFrame, crowds: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of a cell, enough to connect what any link connects."""

    def run(t: pa.Table) -> pa.Table:
        x, y, _ = _compare(t, percent, True)
        ids = t["id"].to_numpy()
        return pa.table({"a": ids[x], "b": ids[y]})

    return _blocked(cells, crowds, "cell").applyInArrow(run, PAIRS)


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))


def _other_heads(placed: DataFrame, crowds: DataFrame, trial: int) -> DataFrame:
    """Pairs (a, b): in buckets whose rest is more than a block, a member of the main component, another one at
    each trial, and the members of the rest."""
    d = placed.join(sent_if_small(crowds.where("rest_blocks > 1")), "bucket")
    head = d.where("component = main").groupBy("bucket").agg(F.min_by("id", F.xxhash64(F.lit(trial), "id")).alias("a"))
    return d.where("component <> main").join(head, "bucket").select("a", F.col("id").alias("b")).distinct()


def _rest(members: DataFrame, found: DataFrame, links: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Components with the links that pairing with heads missed."""
    was = None
    for trial in range(TRIALS):
        placed = _placed(members, found)
        crowds = _crowds(placed, "bucket", scratch)
        left = crowds.where("rest_blocks > 1").agg(F.sum("rest")).first()[0] or 0
        if not left or (was is not None and left > (1 - WORTH) * was):
            break
        was = left
        tried = scratch.table(_plausible(_other_heads(placed, crowds, trial), classes, percent), "pairs")
        links = scratch.table(links.unionAll(_verified(tried, docs, k, percent, scratch)), "links")
        found = connected_components(links, scratch)
    else:
        placed = _placed(members, found)
        crowds = _crowds(placed, "bucket", scratch)
    small = classes.select("id", "n", "signature")
    near = scratch.table(_plausible_components(placed.join(small, "id"), crowds, percent), "near")
    if near.isEmpty():
        return found
    # a cell is known by its least component, which connected_components leaves out
    cell = connected_components(near, scratch).select(F.col("id").alias("component"), F.col("component").alias("cell"))
    cell = scratch.table(cell.unionAll(cell.select(F.col("cell").alias("component"), "cell")).distinct(), "cells")
    inside = small.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")).join(cell, "component")
    inside = scratch.table(inside.select("cell", "id", "component", "n", "signature"), "inside")
    crowds = _crowds(inside, "cell", scratch, "n")
    sets = full_sets(with_ids(docs.select("doc_id", "text"), inside.select(F.col("id").alias("doc_id")), "doc_id"), k)
    more = scratch.table(_links_in_cells(inside.join(sets, "id"), crowds, percent), "links")
    return connected_components(links.unionAll(more), scratch)


def minhash_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Groups documents whose sets of ``shingle``-word shingles have a Jaccard similarity of ``percent``
    hundredths or more, directly or through others.

    Takes doc_id and text of ``docs`` (other columns are ignored) and returns one row for each of its rows:
    doc_id, n_shingles (size of the set), component_id (smallest doc_id reachable), kept (doc_id =
    component_id), class_id (smallest doc_id with an equal set). Words are runs without space, tab to
    carriage return, A-Z lower-cased; null, empty and blank texts have no shingles and link with nothing.
    Rows without a doc_id link with nothing, have no component and are kept. doc_id is meant to be unique;
    where it isn't, each row gets the component of its own text. A group of any size is compared in blocks, so
    none is cut. An empty table gives no rows."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "minhash")
    rows = scratch.table(signed(docs, shingle), "signed")
    same_set = ["f1", "f2", "n_shingles"]
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy(*same_set).agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"))
    classes = scratch.table(classes.select("id", F.col("n_shingles").alias("n"), "f1", "f2", "signature"), "classes")
    buckets = classes.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * ROWS + 1, ROWS)))).alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1")
    members = scratch.table(buckets.join(shared, "bucket").select("bucket", "id", "head"), "members")
    pairs = members.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    pairs = scratch.table(_plausible(pairs, classes, percent), "pairs")
    links = _verified(pairs, docs, shingle, percent, scratch)
    found = _rest(members, connected_components(links, scratch), links, classes, docs, shingle, percent, scratch)
    out = rows.drop("signature").join(classes.select(F.col("n").alias("n_shingles"), "f1", "f2", F.col("id").alias("class_id")), same_set, "left")
    out = out.join(found.withColumnRenamed("id", "class_id"), "class_id", "left")
    component = F.coalesce("component", "class_id", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


#: The same with four-word shingles for DuckDB, by comparing all sets that share a shingle.
MINHASH_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [concat_ws(' ', 'few:', array_to_string(w, ' '))]
    ELSE list_sort(list_distinct(list_transform(list_zip(w, w[2:], w[3:], w[4:])[:-4], lambda x: concat_ws(' ', x[1], x[2], x[3], x[4])))) END AS g FROM w),
c AS (SELECT g, min(doc_id) AS id FROM s WHERE len(g) > 0 GROUP BY g),
u AS (SELECT id, len(g) AS n, unnest(g) AS x FROM c),
p AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id, id AS root FROM c UNION SELECT r.id, e.b FROM r JOIN e ON r.root = e.a),
f AS (SELECT id, min(root) AS component FROM r GROUP BY 1)
SELECT doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM s LEFT JOIN c ON c.g = s.g LEFT JOIN f USING (id)
"""
