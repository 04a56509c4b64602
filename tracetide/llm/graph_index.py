"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched with a beam."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracetide.llm.shared import bound_batches, materialise

#: Vectors of a shard, edges of a node, nodes a search keeps, nodes it expands at once, slack of the pruning.
SHARD, DEGREE, BEAM, WIDTH, SLACK = 4096, 32, 96, 4, 1.2
QUERY_BLOCK, BATCH = 512, 256


def beam_search(points: np.ndarray, links: np.ndarray, start: int, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) of the nearest `beam` nodes each query met, nearest first; -1 where fewer.

    All queries advance together: each expands its nearest unexpanded nodes until its beam has none.
    """
    n, q = len(points), len(queries)
    beam = min(beam, n)
    norms, own = (points**2).sum(1), (queries**2).sum(1)
    nodes, dist = np.full((q, beam), -1), np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    nodes[:, 0], done[:, 0] = start, False
    dist[:, 0] = norms[start] - 2 * queries @ points[start] + own
    seen = np.zeros((q, n + 1), bool)
    seen[:, start] = True
    active = np.arange(q)
    while len(active):
        rank = np.where(done[active], beam, np.arange(beam))
        picks = np.sort(rank, 1)[:, : min(WIDTH, beam)]
        alive = picks[:, 0] < beam
        active, picks = active[alive], picks[alive]
        if not len(active):
            break
        real = picks < beam
        picks = np.where(real, picks, 0)
        rows = active[:, None]
        chosen = np.where(real, nodes[rows, picks], -1)
        done[np.broadcast_to(rows, picks.shape)[real], picks[real]] = True
        near = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(active), -1)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near = np.where(seen[rows, near], -1, near)
        seen[np.broadcast_to(rows, near.shape), near] = True
        seen[:, n] = False
        far = norms[near] - 2 * np.einsum("ijk,ik->ij", points[near], queries[active]) + own[active][:, None]
        far = np.where(near >= 0, far, np.inf).astype(np.float32)
        every = np.concatenate([dist[active], far], 1)
        best = np.argsort(every, 1, kind="stable")[:, :beam]
        take = lambda a, b: np.take_along_axis(np.concatenate([a, b], 1), best, 1)
        nodes[active], done[active] = take(nodes[active], near), take(done[active], near < 0)
        dist[active] = np.take_along_axis(every, best, 1)
    return np.where(np.isfinite(dist), nodes, -1), dist


def prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, slack: float = SLACK, degree: int = DEGREE) -> np.ndarray:
    """For each node the candidates that stay: the nearest is kept and rules out those that it is nearer to,
    by a factor of `slack`, than the node itself; then the next. -1 fills the rows."""
    candidates = np.sort(candidates, 1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    candidates[candidates == own[:, None]] = -1
    norms = (points**2).sum(1)
    far = norms[candidates] - 2 * np.einsum("ijk,ik->ij", points[candidates], points[own]) + norms[own][:, None]
    far[candidates < 0] = np.inf
    order = np.argsort(far, 1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    width = int((candidates >= 0).sum(1).max(initial=1))
    candidates, far = candidates[:, :width], far[:, :width]
    vectors = points[candidates]
    out, alive = np.full((len(own), degree), -1), candidates >= 0
    rows = np.arange(len(own))
    for k in range(degree):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        pick = candidates[rows, first]
        out[some, k] = pick[some]
        between = norms[candidates] - 2 * np.einsum("ijk,ik->ij", vectors, points[pick]) + norms[pick][:, None]
        alive &= ~(some[:, None] & (slack**2 * between <= far))
        alive[rows, first] = False
    return out


def build_graph(points: np.ndarray) -> tuple[np.ndarray, int]:
    """(links, start): every node's out-edges and the node nearest the mean. Two passes, the first without slack."""
    n = len(points)
    rng = np.random.default_rng(n)
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    links = np.full((n, DEGREE), -1)
    some = min(DEGREE // 2, n - 1)
    if some > 0:
        links[:, :some] = (np.arange(n)[:, None] + rng.integers(1, n, (n, some))) % n
    for slack in (1.0, SLACK):
        order = rng.permutation(n)
        for low in range(0, n, BATCH):
            batch = order[low : low + BATCH]
            met, _ = beam_search(points, links, start, points[batch])
            links[batch] = prune(points, batch, np.concatenate([met, links[batch]], 1), slack)
            source, target = np.repeat(batch, DEGREE), links[batch].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            cut = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, np.int64)
            size = np.diff(np.append(cut, len(target)))
            back = np.full((len(cut), int(size.max(initial=1))), -1)
            place = np.arange(len(target)) - np.repeat(cut, size)
            back[np.repeat(np.arange(len(cut)), size), place] = source
            hubs = target[cut]
            for a in range(0, len(hubs), BATCH):
                hub = hubs[a : a + BATCH]
                links[hub] = prune(points, hub, np.concatenate([links[hub], back[a : a + BATCH]], 1), slack)
    return links.astype(np.int32), start


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`(id long, v array<double>, dim)`, one row an id: vectors that are not null, zero, or holding null or non-finite values."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    ok = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    ok = ok.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return ok.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


INDEX = "shard int, dim int, start int, vectors binary, links binary, lift binary, members array<long>, cuts array<int>"


def build_index(points: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """One row a shard: its distinct vectors, their graph, and the ids of each.

    points: from `usable`. Shards are dealt by a hash of the id, and vectors of unequal length never share
    one. Inner products become distances by one more component, which lifts all vectors to the longest
    length (`lift`). Equal vectors of a shard are one node, however many.
    """
    stats = points.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top"))
    dealt = points.join(stats, "dim").select("dim", "id", "v", "top", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / shard_size)).cast("int").alias("shard"))

    def build(key, rows):
        dim, n = key[0].as_py(), rows.num_rows
        x = rows.column("v").combine_chunks().flatten().to_numpy().reshape(n, dim)
        ids = rows.column("id").to_numpy()
        distinct, which = np.unique(x, axis=0, return_inverse=True)
        which = which.ravel()
        order = np.lexsort((ids, which))
        cuts = np.append(np.searchsorted(which[order], np.arange(len(distinct))), n)
        lift = np.sqrt(np.maximum(0, rows.column("top")[0].as_py() - (distinct**2).sum(1)))
        links, start = build_graph(np.column_stack([distinct, lift]).astype(np.float32))
        return pa.table({"shard": pa.array([key[1].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()), "start": pa.array([start], pa.int32()), "vectors": [distinct.tobytes()], "links": [links.tobytes()], "lift": [lift.tobytes()], "members": [ids[order]], "cuts": pa.array([cuts], pa.list_(pa.int32()))})

    shards = int(stats.agg(F.sum(F.ceil(F.col("n") / shard_size))).first()[0] or 1)
    # a shard is little data and much work, so partitions go by the number of shards and not by bytes
    return materialise(dealt.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, INDEX), "graph-index")


def search_index(index: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: the k largest inner products found for each query, itself left out.

    queries: from `usable`. They travel in blocks; every block meets every shard of its length once, by
    equality of shard numbers. A pair of a block and a shard gives at most k rows a query, and the
    k best of all shards are kept by a ranking that is cut before the shuffle.
    """
    counts = queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    blocks = queries.join(counts, "dim").groupBy("dim", F.pmod(F.xxhash64("id", F.lit(1)), "blocks").alias("block")).agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("qs"))
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    asked = blocks.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), "last"))).drop("last", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                get = lambda c, r=row, b=batch: b.column(c)[r]
                dim = get("dim").as_py()
                vectors = np.frombuffer(get("vectors").as_buffer()).reshape(-1, dim)
                links = np.frombuffer(get("links").as_buffer(), np.int32).reshape(-1, DEGREE)
                lift = np.frombuffer(get("lift").as_buffer())
                members, cuts = get("members").values.to_numpy(), get("cuts").values.to_numpy()
                ids, asked = get("ids").values.to_numpy(), get("qs").values.to_numpy().reshape(-1, dim)
                points = np.column_stack([vectors, lift]).astype(np.float32)
                nodes, _ = beam_search(points, links, get("start").as_py(), np.column_stack([asked, np.zeros(len(asked))]).astype(np.float32), beam)
                score = np.where(nodes >= 0, np.einsum("ijk,ik->ij", vectors[nodes], asked), -np.inf)
                size = np.where(nodes >= 0, np.minimum(np.diff(cuts)[nodes], k + 1), 0)
                owner = np.repeat(np.repeat(np.arange(len(ids)), nodes.shape[1]), size.ravel())
                ends = np.cumsum(size.ravel())
                place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size.ravel(), size.ravel())
                vec = members[np.repeat(cuts[:-1][nodes].ravel(), size.ravel()) + place]
                value = np.repeat(score.ravel(), size.ravel())
                other = vec != ids[owner]
                owner, vec, value = owner[other], vec[other], value[other]
                order = np.lexsort((vec, -value, owner))
                owner, vec, value = owner[order], vec[order], value[order]
                first = np.searchsorted(owner, np.arange(len(ids)))
                keep = np.arange(len(owner)) - first[owner] < k
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner[keep]]), pa.array(vec[keep]), pa.array(value[keep])], names=["query_id", "vec_id", "score"])

    found = asked.join(index, ["dim", "shard"]).mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, query: str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: for the rows that meet the SQL condition `query` on `id`, the k nearest others.

    Nearness is the largest inner product in double precision of the given vectors; ties go to the smaller
    id. Null ids, and vectors that are null, zero, or holding null or non-finite values, neither ask nor
    answer. Of rows with one id, the smallest vector counts. Vectors only meet those of their own length.
    Other columns are not carried. Empty in, empty out.
    """
    bound_batches(vectors.sparkSession)
    points = materialise(usable(vectors, id_col, vector_col), "graph-points")
    return search_index(build_index(points), points.where(query), k)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "id % 20 = 0")
