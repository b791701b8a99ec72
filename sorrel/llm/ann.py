"""Approximate largest inner products with one HNSW graph per shard.

Equal vectors are one class, so a group of copies is one node of a graph; a
class keeps the ``k + 1`` smallest ids, which is all that a result of ``k`` can
show of it.  Classes are hashed to as many shards as there are cores, more where
shards would hold over ``shard_rows`` nodes, so a query's work grows with the logarithm of the rows until
then.  Each shard builds a hierarchical navigable small-world graph: node levels fall off
geometrically, every layer links a node to nodes at small angles picked for diversity, and
links are kept in flat arrays.  On the lowest layer every node is also linked to its
largest inner products among the longest nodes, which answer many queries and may lie at a wide angle.

A shard's layers are linked from near lists (exact ones of small layers, those
of random partitions and of neighbours' neighbours of large ones) instead of one insertion after the
other: the same graph form, no dependence on the order of rows.

Queries go to every shard in blocks, each block walks down the layers side by
side with a beam of ``ef`` nodes, scores are taken again in double precision,
and the shards' results are merged.

Vectors that are null, zero, or hold null or non-finite components take no
part, neither do null ids.  Vectors of different lengths never meet.  Rows that
repeat id and vector count once.  An id with several vectors asks once, with the smallest
of them (compared component by component); as a candidate each counts, but a query
passes over all rows of its own id.  Ties go to the smaller id.  With fewer than
``k`` candidates all are returned; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sorrel.plans.staging import stage

# Nodes of a shard at most, and at least while there are cores without one.
SHARD_ROWS, LEAST_ROWS = 131_072, 16_384
QUERY_BLOCK = 4096
# Links a node: on upper layers, and twice as many on the lowest, a third of them to the longest nodes.
LINKS = 24
# Near nodes among which links are picked.
NEAR = 64
EF = 192
# Nodes up to which near lists are exact; beyond, nodes of a leaf, partitions, rounds over neighbours of neighbours and
# the neighbours followed.
EXACT, LEAF, TREES, ROUNDS, HOPS = 16_384, 1024, 6, 1, 16
# The longest nodes of a shard, to which every node is linked by inner product.
LONG = 4096
# Rows of one matrix product, queries walked side by side, and nodes of a beam opened at once.
ROWS, WALKS, WIDE = 512, 512, 4
EMPTY = np.iinfo(np.int64).min + 1


def usable(vec: Column) -> Column:
    """Whether a vector takes part."""
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & whole & F.exists(vec, lambda x: x != 0)


def _top(v: np.ndarray, q: np.ndarray, own: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` rows of ``v`` most similar to each of ``q``, its ``own`` row left out, nearest first."""
    s = q @ v.T
    s[np.arange(len(s)), own] = -np.inf
    part = np.argpartition(-s, count - 1, axis=1)[:, :count] if count < len(v) - 1 else np.argsort(-s, axis=1)[:, :count]
    near = np.take_along_axis(s, part, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(part, order, 1), np.take_along_axis(near, order, 1)


def _best(ids: np.ndarray, sims: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` most similar different ids of each row."""
    order = np.lexsort((-sims, ids), axis=1)
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
    order = np.argsort(-sims, axis=1, kind="stable")[:, :count]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _leaves(v: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """All nodes in groups of at most ``LEAF``, parted at the median of random directions."""
    todo, out = [np.arange(len(v))], []
    while todo:
        nodes = todo.pop()
        if len(nodes) <= LEAF:
            out.append(nodes)
            continue
        order = nodes[np.argsort(v[nodes] @ rng.normal(size=v.shape[1]).astype(np.float32), kind="stable")]
        todo += np.array_split(order, 2)
    return out


def _near(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``count`` near other nodes of every node, nearest first, and their similarity.

    Up to ``EXACT`` nodes they are the nearest.  Of more nodes, they are the nearest met in the leaves
    of several random partitions, then among the neighbours of neighbours, so the work grows
    with the number of nodes and not with its square.
    """
    n = len(v)
    count = min(count, n - 1)
    if n <= EXACT:
        parts = [_top(v, v[low : low + ROWS], np.arange(low, min(n, low + ROWS)), count) for low in range(0, n, ROWS)]
        ids, sims = (np.concatenate(x) for x in zip(*parts, strict=True))
        return ids.astype(np.int32), sims
    rng = np.random.default_rng(len(v))
    ids, sims = np.full((n, count), -1, np.int32), np.full((n, count), -np.inf, np.float32)
    for _ in range(TREES):
        for nodes in _leaves(v, rng):
            some = v[nodes]
            near, sim = _top(some, some, np.arange(len(nodes)), min(count, len(nodes) - 1))
            ids[nodes], sims[nodes] = _best(np.hstack((ids[nodes], nodes[near])), np.hstack((sims[nodes], sim)), count)
    for _ in range(ROUNDS):
        known = ids[:, :HOPS].copy()
        for low in range(0, n, ROWS):
            own = np.arange(low, min(n, low + ROWS))
            new = known[known[own]].reshape(len(own), -1)
            sim = np.einsum("nkd,nd->nk", v[new], v[own])
            sim[new == own[:, None]] = -np.inf
            ids[own], sims[own] = _best(np.hstack((ids[own], new)), np.hstack((sims[own], sim)), count)
    return ids, sims


def _diverse(v: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Marks the near nodes to link: those nearer to the node than to any node marked before."""
    marks = np.zeros(ids.shape, bool)
    for low in range(0, len(ids), 128):
        near, sim = ids[low : low + 128], sims[low : low + 128]
        g = v[near]
        between = g @ g.transpose(0, 2, 1)
        mark = marks[low : low + 128]
        for j in range(ids.shape[1]):
            hidden = (mark & (between[:, j, :] > sim[:, j, None])).any(axis=1)
            mark[:, j] = ~hidden & (mark.sum(axis=1) < most)
    # Nodes with room left are linked to their nearest ones as well.
    rank = np.cumsum(~marks, axis=1)
    room = (most - marks.sum(axis=1))[:, None] // 2
    return marks | (~marks & (rank <= room))


def link_layer(v: np.ndarray, most: int) -> np.ndarray:
    """Flat neighbour array (nodes x ``2 * most``, -1 where empty) of one layer."""
    n = len(v)
    out = np.full((n, 2 * most), -1, np.int32)
    if n < 2:
        return out
    ids, sims = _near(v, NEAR)
    marks = _diverse(v, ids, sims, most)
    a, j = np.nonzero(marks)
    b, s = ids[a, j], sims[a, j]
    a, b, s = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((s, s))
    forward = np.concatenate((np.ones(len(a) // 2, bool), np.zeros(len(a) // 2, bool)))
    # Own links first, then links back, nearest first, as many as there is room for.
    order = np.lexsort((b, -s, ~forward, a))
    a, b = a[order], b[order]
    _, first = np.unique(a.astype(np.int64) * n + b, return_index=True)
    keep = np.zeros(len(a), bool)
    keep[first] = True
    a, b = a[keep], b[keep]
    starts = np.searchsorted(a, np.arange(n))
    place = np.arange(len(a)) - starts[a]
    good = place < out.shape[1]
    out[a[good], place[good]] = b[good]
    return out


def levels_of(ids: np.ndarray) -> np.ndarray:
    """Geometric levels from a hash of the ids."""
    x = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        for mix in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(mix)
    u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return np.floor(-np.log(u) / math.log(LINKS)).astype(np.int64)


def links_to_long(v: np.ndarray) -> np.ndarray:
    """For every node the largest inner products among the ``LONG`` longest nodes, ``LINKS * 2 // 3`` of them."""
    long = np.argsort(-np.einsum("nd,nd->n", v, v), kind="stable")[:LONG]
    place = np.full(len(v), -1)
    place[long] = np.arange(len(long))
    out, some = np.full((len(v), LINKS * 2 // 3), -1, np.int32), v[long]
    count = min(out.shape[1], len(long) - 1)
    for low in range(0, len(v) if count > 0 else 0, ROWS):
        s = v[low : low + ROWS] @ some.T
        own = place[low : low + ROWS]
        s[np.flatnonzero(own >= 0), own[own >= 0]] = -np.inf
        part = np.argpartition(-s, count - 1, axis=1)[:, :count]
        out[low : low + ROWS, :count] = long[part]
    return out


def build_graph(ids: np.ndarray, v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the lowest up: node numbers and neighbour array (in node numbers)."""
    level = levels_of(ids)
    even = (v / np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))[:, None]).astype(np.float32)
    out = []
    for layer in range(int(level.max()) + 1):
        nodes = np.flatnonzero(level >= layer)
        links = link_layer(even[nodes], LINKS * 2 // 3 if layer == 0 else LINKS // 2)
        links = np.where(links < 0, -1, nodes[links]).astype(np.int32)
        out.append((nodes.astype(np.int32), np.hstack((links, links_to_long(v))) if layer == 0 else links))
    return out


def _keys(sims: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """One integer per similarity and node; larger is nearer, equal ones go by the smaller node."""
    bits = (sims.astype(np.float32) + np.float32(0)).view(np.int32).astype(np.int64)
    ordered = np.where(bits < 0, -(bits & 0x7FFFFFFF), bits)
    return (ordered << 32) | (0xFFFFFFFF - nodes)


def walk(v: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, ef: int) -> np.ndarray:
    """Node numbers (queries x at most ``ef``, -1 where empty) near the largest inner products.

    Each step opens the ``WIDE`` best unopened nodes of every beam.  Beams are cut by
    similarity, then by node number, so equal similarities have one order.
    """
    rows = np.arange(len(q))[:, None]
    nodes = layers[-1][0]
    beam = np.broadcast_to(nodes[: max(1, min(len(nodes), WIDE))].astype(np.int64), (len(q), max(1, min(len(nodes), WIDE))))
    for depth in range(len(layers) - 1, -1, -1):
        nodes, links = layers[depth]
        where = np.full(len(v), -1, np.int32)
        where[nodes] = np.arange(len(nodes))
        width = ef if depth == 0 else max(8, ef // 8)
        wide = WIDE if depth == 0 else 1
        keys = np.where(beam >= 0, _keys(np.einsum("qbd,qd->qb", v[beam], q), beam), EMPTY)
        done = beam < 0
        seen = np.zeros((len(q), len(v)), bool)
        seen[np.broadcast_to(rows, beam.shape)[~done], beam[~done]] = True
        live = np.arange(len(q))
        while len(live):
            open_keys = np.where(done[live], EMPTY, keys[live])
            if wide < open_keys.shape[1]:
                pick = np.argpartition(-open_keys, wide - 1, axis=1)[:, :wide]
                open_keys = np.take_along_axis(open_keys, pick, 1)
            else:
                pick = np.broadcast_to(np.arange(open_keys.shape[1]), open_keys.shape)
            r, c = np.nonzero(open_keys > EMPTY)
            going = np.zeros(len(live), bool)
            going[r] = True
            done[live[r], pick[r, c]] = True
            new = np.full((len(live), pick.shape[1], links.shape[1]), -1, np.int64)
            new[r, c] = links[where[0xFFFFFFFF - (open_keys[r, c] & 0xFFFFFFFF)]]
            new = new.reshape(len(live), -1)[going]
            live = live[going]
            if not len(live):
                break
            # A node that several opened ones link to is met once.
            new.sort(axis=1)
            fresh = (new >= 0) & ~seen[live[:, None], new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            r, c = np.nonzero(fresh)
            seen[live[r], new[r, c]] = True
            found = np.full(new.shape, EMPTY)
            found[r, c] = _keys(np.einsum("nd,nd->n", v[new[r, c]], q[live[r]]), new[r, c])
            both, opened = np.hstack((keys[live], found)), np.hstack((done[live], ~fresh))
            if both.shape[1] > width:
                best = np.argpartition(-both, width - 1, axis=1)[:, :width]
                both, opened = np.take_along_axis(both, best, 1), np.take_along_axis(opened, best, 1)
            if both.shape[1] > keys.shape[1]:
                more = both.shape[1] - keys.shape[1]
                keys = np.hstack((keys, np.full((len(q), more), EMPTY)))
                done = np.hstack((done, np.ones((len(q), more), bool)))
            keys[live], done[live] = both, opened
        beam = np.where(keys > EMPTY, 0xFFFFFFFF - (keys & 0xFFFFFFFF), -1)
    return beam


def nearest_in_shard(shard: pd.Series, queries: pd.DataFrame, k: int, ef: int) -> Iterator[tuple]:
    """(query id, id, score) of the best ``k`` candidates of each query in one shard."""
    dim, size = int(shard["dim"]), int(shard["nodes"])
    v = np.frombuffer(shard["vectors"], np.float32).reshape(size, dim)
    ids, ends = np.frombuffer(shard["members"], np.int64), np.frombuffer(shard["ends"], np.int64)
    flat, layers, at = np.frombuffer(shard["links"], np.int32), [], 0
    for n, width in np.frombuffer(shard["shape"], np.int64).reshape(-1, 2).tolist():
        layers.append((flat[at : at + n], flat[at + n : at + n + n * width].reshape(n, width)))
        at += n + n * width
    names = queries["id"].to_numpy(np.int64)
    vectors = np.array(queries["v"].tolist(), np.float32).reshape(len(queries), dim)
    for low in range(0, len(names), WALKS):
        q = vectors[low : low + WALKS]
        found = walk(v, layers, q, max(ef, k + 1))
        exact = np.einsum("qbd,qd->qb", v[found].astype(np.float64), q.astype(np.float64))
        exact[found < 0] = -np.inf
        # Nodes are numbered by their smallest id.
        order = np.lexsort((found, -exact), axis=1)[:, : k + 1]
        for row, name in enumerate(names[low : low + WALKS].tolist()):
            hits = []
            for j in order[row]:
                if (node := found[row, j]) >= 0:
                    score = float(exact[row, j])
                    hits += [(-score, i) for i in ids[ends[node] : ends[node + 1]].tolist() if i != name]
            yield from ((name, i, -s) for s, i in sorted(hits)[:k])


def index(vectors: DataFrame, key: str, vec: str, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: vectors, members of classes and the graph as flat arrays."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("v"))
    rows = rows.filter(usable(F.col("v")) & F.col("id").isNotNull()).distinct()
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    classes = stage(first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "classes")
    nodes, cores = classes.count(), vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(nodes / shard_rows), min(cores, nodes // LEAST_ROWS))
    placed = classes.select("v", "ids", F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(first=[int(x[0]) for x in group["ids"]]).sort_values("first")
        dim = int(group["dim"].iloc[0])
        v = np.array(group["v"].tolist(), np.float32).reshape(len(group), dim)
        layers = build_graph(group["first"].to_numpy(np.int64), v)
        return pd.DataFrame([{
            "dim": dim, "shard": int(group["shard"].iloc[0]), "nodes": len(group), "vectors": v.tobytes(),
            "members": np.concatenate([np.asarray(x, np.int64) for x in group["ids"]]).tobytes(),
            "ends": np.cumsum([0, *map(len, group["ids"])]).astype(np.int64).tobytes(),
            "links": np.concatenate([x for nodes, links in layers for x in (nodes, links.ravel())]).astype(np.int32).tobytes(),
            "shape": np.array([links.shape for _, links in layers], np.int64).tobytes(),
        }])

    schema = "dim int, shard int, nodes long, vectors binary, members binary, ends binary, links binary, shape binary"
    return stage(placed.groupBy("dim", "shard").applyInPandas(build, schema), "graphs")


def search(
    vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vec: str = "embedding", k: int = 20,
    ef: int = EF, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``(query_id, rank, key, score)``: the ``k`` nearest found of every query.

    ``queries`` has the columns of ``vectors``; a candidate with the query's own id is passed over.
    """
    graphs = index(vectors, key, vec, k, shard_rows)
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("v"))
    asked = asked.filter(usable(F.col("v")) & F.col("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    shards = graphs.select((F.col("dim") + 0).alias("dim"), (F.col("shard") + 0).alias("shard"))  # one narrow row per shard
    spread = asked.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    spread = spread.join(shards, "dim")
    copies = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = nearest_in_shard(left.iloc[0], right, k, ef) if len(left) and len(right) else ()
        return pd.DataFrame(list(found), columns=["query_id", "id", "score"]).astype({"query_id": "int64", "id": "int64", "score": "float64"})

    by = ["dim", "shard", "block"]
    found = copies.groupBy(*by).cogroup(spread.groupBy(*by)).applyInPandas(look, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
