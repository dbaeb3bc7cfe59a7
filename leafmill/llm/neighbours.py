"""Approximate nearest neighbours: one hierarchical navigable small-world graph a shard, kept as flat neighbour arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.common import save_point, sent, table

#: Vectors of one shard, about, and queries that are searched together.
SHARD, BLOCK = 16_384, 256
#: Links that a vector chooses on each layer, those it may have after others chose it, and the nearest ones it chooses from.
LINKS, MOST, NEAR = 16, 48, 64
#: Each layer has this part of the one below.
PART = 16
#: Candidates that a search keeps on the lowest layer, and how many it expands at once.
KEPT, EXPANDED = 384, 4


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


def _components(links: np.ndarray) -> np.ndarray:
    """Least member of each node's component; links: rows of neighbours, padded with -1, both ways counting."""
    n = len(links)
    u, k = np.nonzero(links >= 0)
    v = links[u, k]
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, u, label[v])
        np.minimum.at(least, v, label[u])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def layer(x: np.ndarray) -> np.ndarray:
    """Neighbours of each vector, padded with -1. Of its nearest ones a vector takes those that are nearer to it than to any taken
    before, then the nearest of the rest; links count both ways, and parts that none joins are joined at their nearest pair."""
    n = len(x)
    k = min(NEAR, n - 1)
    if k < 1:
        return np.full((n, 1), -1, np.int32)
    chosen = np.full((n, min(LINKS, k)), -1, np.int64)
    lengths = np.full(chosen.shape, np.inf, np.float32)
    for a in range(0, n, 256):
        d = _squares(x[a : a + 256], x)
        own = np.arange(len(d))
        d[own, a + own] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        dn = np.take_along_axis(d, near, 1)
        order = np.argsort(dn, axis=1, kind="stable")
        near, dn = np.take_along_axis(near, order, 1), np.take_along_axis(dn, order, 1)
        g = x[near]
        squares = (g * g).sum(2)
        between = squares[:, :, None] + squares[:, None, :] - 2 * np.einsum("bid,bjd->bij", g, g, optimize=True)
        taken = np.zeros((len(d), k), bool)
        for j in range(k):
            blocked = (taken[:, :j] & (between[:, j, :j] <= dn[:, j, None])).any(1)
            taken[:, j] = ~blocked & (taken.sum(1) < chosen.shape[1])
        first = np.argsort(~taken, axis=1, kind="stable")[:, : chosen.shape[1]]
        chosen[a : a + 256] = np.take_along_axis(near, first, 1)
        lengths[a : a + 256] = np.take_along_axis(dn, first, 1)
    u = np.repeat(np.arange(n), chosen.shape[1])
    v, d = chosen.reshape(-1), lengths.reshape(-1)
    u, v, d = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([d, d])
    _, once = np.unique(u * n + v, return_index=True)
    u, v, d = u[once], v[once], d[once]
    order = np.lexsort((v, d, u))
    u, v = u[order], v[order]
    rank = np.arange(len(u)) - np.searchsorted(u, u)
    keep = rank < MOST
    links = np.full((n, MOST), -1, np.int32)
    links[u[keep], rank[keep]] = v[keep]
    while len(parts := np.unique(label := _components(links))) > 1:
        extra: dict[int, list[int]] = {}
        sizes = np.bincount(label, minlength=n)
        main = int(parts[sizes[parts].argmax()])
        rest = np.flatnonzero(label == main)
        for p in parts.tolist():
            if p != main:
                own = np.flatnonzero(label == p)[:256]
                best = min(((d := _squares(x[own], x[rest[a : a + 4096]])).min(), own[d.argmin() // d.shape[1]], rest[a + d.argmin() % d.shape[1]]) for a in range(0, len(rest), 4096))
                extra.setdefault(int(best[1]), []).append(int(best[2]))
                extra.setdefault(int(best[2]), []).append(int(best[1]))
        more = np.full((n, max(map(len, extra.values()))), -1, np.int32)
        for i, others in extra.items():
            more[i, : len(others)] = others
        links = np.concatenate([links, more], 1)
    return links


def build(x: np.ndarray, seed: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the top one: members (places in x) and their links (places among the members). seed: a hash of each vector's key."""
    height = np.zeros(len(x), np.int64)
    z = seed.astype(np.uint64)
    while (z % np.uint64(PART) == 0).any() and height.max() < 12:
        on = (z % np.uint64(PART) == 0) & (height == height.max())
        if on.sum() < 2:
            break
        height[on] += 1
        z = z // np.uint64(PART)
    out = []
    for h in range(int(height.max()), -1, -1):
        members = np.flatnonzero(height >= h)
        out.append((members.astype(np.int32), layer(x[members])))
    return out


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest `kept` found for each query from its start, as places with squared distances, nearest first (-1: none)."""
    m, n = len(q), len(x)
    kept = min(kept, n)
    rows = np.arange(m)[:, None]
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    ids = np.full((m, kept), n)
    dist = np.full((m, kept), np.inf, np.float32)
    done = np.ones((m, kept), bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = ((q - x[start]) ** 2).sum(1)
    seen[np.arange(m), start] = True
    links = np.where(links < 0, n, links)
    live = np.arange(m)
    while len(live):
        order = np.argsort(done[live], axis=1, kind="stable")[:, :EXPANDED]  # the nearest that are not expanded, as rows are in order
        fresh = ~np.take_along_axis(done[live], order, 1)
        at = np.where(fresh, np.take_along_axis(ids[live], order, 1), n)
        np.put_along_axis(marks := done[live], order, True, 1)
        done[live] = marks
        near = np.where((at < n)[:, :, None], links[np.minimum(at, n - 1)], n).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[live[:, None], near]] = n
        seen[live[:, None], near] = True
        real = near < n
        width = int(real.sum(1).max())
        if width:
            near = np.take_along_axis(near, np.argsort(~real, axis=1, kind="stable")[:, :width], 1)
            d = np.where(near < n, ((x[np.minimum(near, n - 1)] - q[live][:, None, :]) ** 2).sum(2), np.inf)
            all_d = np.concatenate([dist[live], d], 1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :kept]
            dist[live] = np.take_along_axis(all_d, best, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), best, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], near >= n], 1), best, 1)
        live = live[~done[live].all(1)]
    return np.where(ids < n, ids, -1), dist


def search(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, kept: int) -> np.ndarray:
    """Places of the nearest found for each query, nearest first, -1 for none."""
    at = np.zeros(len(q), np.int64)
    for k, (members, links) in enumerate(layers):
        last = k == len(layers) - 1
        found, _ = _beam(x[members], links, q, at, kept if last else 8)
        if last:
            return members[found] * (found >= 0) - (found < 0)
        at = np.searchsorted(layers[k + 1][0], members[found[:, 0]])
    raise ValueError("no layers")


def usable(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, v (array of double), dim of those that take part: no null, zero or non-finite component's vector."""
    v = F.col(f"`{vector}`").cast("array<double>")
    out = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0)
    return out.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(sound, F.lit(False))).withColumn("dim", F.size("v"))


def _indexed(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """One row with the graph of a shard: its layers, the vectors, and of equal vectors the k + 1 least ids, which suffice for any query."""
    x = np.stack(frame["v"].values)
    frame = frame.assign(b=[r.tobytes() for r in x]).drop_duplicates(["vec_id", "b"]).sort_values("vec_id", kind="stable")
    frame["copy"] = frame.groupby("b", sort=False).cumcount()
    nodes = frame[frame["copy"] == 0]
    place = dict(zip(nodes["b"], range(len(nodes)), strict=True))
    ids = np.full((len(nodes), k + 1), -1, np.int64)
    few = frame[frame["copy"] <= k]
    ids[few["b"].map(place).values, few["copy"].values] = few["vec_id"].values
    x = np.stack(nodes["v"].values)
    layers = build(x.astype(np.float32), nodes["seed"].values)
    flat = [[len(m), links.shape[1], m.tobytes(), links.astype(np.int32).tobytes()] for m, links in layers]
    return pd.DataFrame({"dim": [x.shape[1]], "shard": [frame["shard"].iloc[0]], "x": [x.tobytes()], "ids": [ids.tobytes()], "sizes": [[s[0] for s in flat]], "widths": [[s[1] for s in flat]], "members": [[s[2] for s in flat]], "links": [[s[3] for s in flat]]})


class Shard:
    """A shard's graph as it was stored."""

    def __init__(self, row: pd.Series) -> None:
        self.x = np.frombuffer(row["x"], np.float64).reshape(-1, row["dim"])
        self.x32 = self.x.astype(np.float32)
        self.ids = np.frombuffer(row["ids"], np.int64).reshape(len(self.x), -1)
        self.layers = [(np.frombuffer(m, np.int32), np.frombuffer(e, np.int32).reshape(n, w)) for n, w, m, e in zip(row["sizes"], row["widths"], row["members"], row["links"], strict=True)]

    def nearest(self, own: np.ndarray, q: np.ndarray, k: int, kept: int) -> pd.DataFrame:
        """query_id, vec_id, score: of 4 k found for each query (q, with its id) the k nearest by exact distance."""
        found = search(self.x32, self.layers, q.astype(np.float32), max(kept, 4 * k))[:, : 4 * k]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, row in enumerate(found):
            row = row[row >= 0]
            d = np.sqrt(((self.x[row] - q[i]) ** 2).sum(1))
            pick = self.ids[row]
            d = np.repeat(d, pick.shape[1])
            pick = pick.reshape(-1)
            real = (pick >= 0) & (pick != own[i])
            pick, d = pick[real], d[real]
            order = np.lexsort((pick, d))
            # an id with several vectors counts by its nearest
            order = order[np.sort(np.unique(pick[order], return_index=True)[1])[:k]]
            out.append((np.full(len(order), own[i]), pick[order], d[order]))
        ids, picks, scores = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"query_id": ids, "vec_id": picks, "score": scores})


def nearest(vectors: DataFrame, queries: Column, k: int = 10, kept: int = KEPT, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, by Euclidean distance in double precision, ties to smaller vec_id.

    vectors: vec_id, embedding; queries: which rows are queries, all rows but its own id being candidates. Null ids and vectors that
    are null, zero, or hold null or non-finite components take no part; vectors of different lengths have no distance, so each length is
    searched by itself. Equal vectors of one shard are one node. Shards are dealt by hash; each is indexed once, and its graph moves once
    to where the queries, in blocks, pass by it. Fewer than k candidates: all of them. Repeated rows count once. An id with several different vectors asks with
    each of them, and is near by the nearest of them.
    """
    rows = usable(vectors)
    sizes = save_point(rows.groupBy("dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards")))
    lengths = sizes.count()
    dealt = rows.join(sent(sizes, 32 * lengths), "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    graph = "x binary, ids binary, sizes array<int>, widths array<int>, members array<binary>, links array<binary>"
    indexed = dealt.select("dim", "shard", "vec_id", "v", F.xxhash64(F.lit("height"), "vec_id").alias("seed")).groupBy("dim", "shard").applyInPandas(lambda frame: _indexed(frame, k), f"dim int, shard int, {graph}")
    asked = rows.filter(queries).join(sent(sizes, 32 * lengths), "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(True).alias("asks"), "vec_id", "v")
    both = save_point(indexed).withColumn("asks", F.lit(False)).unionByName(asked, allowMissingColumns=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here: Shard | None = None
        for frame in frames:
            graphs = np.flatnonzero(~frame["asks"].values.astype(bool)).tolist()
            for a, b in zip([-1, *graphs], [*graphs, len(frame)], strict=True):
                if a >= 0:
                    here = Shard(frame.iloc[a])
                for s in range(a + 1, b, BLOCK):
                    e = min(s + BLOCK, b)
                    yield here.nearest(frame["vec_id"].values[s:e].astype(np.int64), np.stack(frame["v"].values[s:e]), k, kept)

    at = ["dim", "shard"]
    found = both.repartition(*at).sortWithinPartitions(*at, "asks").mapInPandas(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of each row of embeddings whose vec_id is divisible by 100, among all rows but itself."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
