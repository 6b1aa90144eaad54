"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample of ``FIT_ROWS`` distinct vectors: k-means splits each node into ``FANOUT`` children until a leaf
holds few enough of them; the more vectors there are, the more leaves, up to ``FIT_ROWS / LEAF_SAMPLE`` of them. Every vector
is then put into the leaf that a walk to the nearest centres leads to, and a leaf's vectors are dealt to blocks of bounded size.

A query walks the tree with a priority queue of nodes by the distance of their centres: the nearest node is taken off, its children
are put on, and leaves come off in the order in which they are to be visited. How many are visited is calibrated:
for ``CALIBRATION`` of the queries all vectors are searched, and the number of visits is widened until they find a share
``RECALL`` of their true neighbours. Within the visited leaves the search is exact, on the original vectors in double precision. Leaves are
visited in ``WAVES`` of growing size, and a later wave sends only what is as near as the k-th vector of the waves before.

Equal vectors are one entry of the index with its ``k + 1`` smallest ids, as no query can return more of them, and equal
queries are searched once; so copies of one vector, however many, are neither a hot leaf nor a hot query.
A leaf that many queries visit is dealt to several tasks by blocks of queries.

The sample bounds the number of leaves. Beyond ``FIT_ROWS / LEAF_SAMPLE * LEAF_ROWS`` distinct vectors leaves grow with the table; their
blocks stay as small and are searched by as many tasks as there are. Equal 64-bit hashes count as equal vectors of queries.

Vectors that are null or zero or hold a null or a component that is not finite take no part, neither do null ids. Vectors of different
lengths have no distance: each length has a tree of its own. An id that stands with several vectors is one
row for each; a query finds none of its own id. With fewer than k candidates a query gets all of them. Repeated rows count once. Other columns
are not read, so names never clash. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionledger.llm.common import hash60
from sessionledger.session import materialize

FIT_ROWS, LEAF_SAMPLE = 40_000, 10  # vectors that the tree is fitted on; at least so many of them to a leaf on average
LEAF_ROWS = 200  # vectors that a leaf should hold while the sample allows for so many leaves
FANOUT, ROUNDS = 8, 12
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 512
CALIBRATION, RECALL = 256, 0.97
WAVES = 3
SEED = 11


class Tree:
    """centers[i] of node i; children of node i are first[i] .. first[i] + count[i] - 1; leaves have none."""

    def __init__(self, centers: np.ndarray, first: np.ndarray, count: np.ndarray):
        self.centers, self.first, self.count = centers, first, count
        self.n_leaves = int((count == 0).sum())

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: from the root always to the nearest child."""
        out = np.zeros(len(rows), dtype=np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not self.count[node]:
                out[at] = node
                continue
            a = self.first[node]
            near = _distances(rows[at], self.centers[a:a + self.count[node]]).argmin(axis=1)
            todo += [(a + c, at[near == c]) for c in np.unique(near).tolist()]
        return out

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.count[node]:
                yield node
                continue
            a, n = int(self.first[node]), int(self.count[node])
            d = ((self.centers[a:a + n] - query) ** 2).sum(axis=1)
            for c in range(n):
                heapq.heappush(queue, (float(d[c]), a + c))


def _distances(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances up to a number that is the same for all centres."""
    return (centers ** 2).sum(axis=1)[None, :] - 2 * rows @ centers.T


def _kmeans(rows: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centers = rows[rng.choice(len(rows), size=k, replace=False)]
    near = np.zeros(len(rows), dtype=np.int64)
    for _ in range(ROUNDS):
        near = _distances(rows, centers).argmin(axis=1)
        sizes = np.bincount(near, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, rows)
        moved = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centers)
        if np.allclose(moved, centers):
            break
        centers = moved
    return centers, near


def fit(sample: np.ndarray, leaf_size: int) -> Tree:
    """Splits the sample until no leaf holds more than ``leaf_size`` of it (or it cannot be split)."""
    rng = np.random.default_rng(SEED)
    scale = np.abs(sample).max() if len(sample) else 1.0
    sample = sample / scale  # squares of very large numbers stay finite
    centers, first, count = [np.zeros(sample.shape[1])], [0], [0]
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, at = todo.pop()
        if len(at) <= leaf_size:
            continue
        k = min(FANOUT, max(2, -(-len(at) // leaf_size)))
        found, near = _kmeans(sample[at], k, rng)
        used = np.unique(near)
        if len(used) < 2:
            continue
        first[node], count[node] = len(centers), len(used)
        for c in used.tolist():
            todo.append((len(centers), at[near == c]))
            centers.append(found[c])
            first.append(0)
            count.append(0)
    return Tree(np.array(centers) * scale, np.array(first), np.array(count))


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(axis=1))


def _matrix(vectors, dims: int) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64).reshape(len(vectors), dims)


def usable(vector: Column) -> Column:
    """Holds a number at every place, all of them finite, and not only zeros."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _least(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of every group; Spark keeps k of a group per task before it shuffles."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= k)


def _nearest(rows: np.ndarray, ids: list, query: np.ndarray, k: int, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the best k entries' ids within a distance; ids: up to k of each row."""
    d = exact(query, rows)
    cut = min(bound, np.partition(d, k - 1)[k - 1]) if len(d) > k else bound
    near = np.flatnonzero(d <= cut)
    own = [np.asarray(ids[i], dtype=np.int64) for i in near]
    flat = np.concatenate(own) if own else np.zeros(0, dtype=np.int64)
    far = np.repeat(d[near], [len(x) for x in own])
    best = np.lexsort((flat, far))[:k]
    return far[best], flat[best]


def _search_all(index: DataFrame, queries: pd.DataFrame, dims: int, k: int) -> DataFrame:
    """``qh, distance, id``: the nearest of all vectors for a bounded number of queries."""
    sent = index.sparkSession.sparkContext.broadcast((queries["qh"].to_numpy(), _matrix(queries["v"].tolist(), dims)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = sent.value
        best = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(names)
        for pdf in batches:
            rows, ids = _matrix(pdf["v"].tolist(), dims), pdf["ids"].tolist()
            for i in range(len(names)):
                d, found = _nearest(rows, ids, q[i], k)
                d, found = np.concatenate((best[i][0], d)), np.concatenate((best[i][1], found))
                o = np.lexsort((found, d))[:k]
                best[i] = (d[o], found[o])
        for h, (d, found) in zip(names, best):
            if len(d):
                yield pd.DataFrame({"qh": h, "distance": d, "id": found})

    return _least(index.select("v", "ids").mapInPandas(run, "qh long, distance double, id long"), ["qh"], ["distance", "id"], k).select("qh", "distance", "id")


def search(vectors: DataFrame, asks: Column, k: int, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest other rows of every row for which ``asks`` holds."""
    spark = vectors.sparkSession
    v = F.col(f"`{vector}`")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), v.cast("array<double>").alias("v"), F.coalesce(asks, F.lit(False)).alias("asks")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows = materialize(rows.withColumns({"dims": F.size("v"), "vh": F.xxhash64("v")}).distinct())
    # per distinct vector the smallest k + 1 ids: the query itself and k others
    ids = _least(rows, ["vh", "v"], ["id"], k + 1)
    index = materialize(ids.groupBy("vh", "v").agg(F.first("dims").alias("dims"), F.sort_array(F.collect_list("id")).alias("ids")))
    asked = materialize(rows.filter("asks").select(F.col("vh").alias("qh"), "v", "dims").distinct())

    found = None
    for dims in [r["dims"] for r in rows.select("dims").distinct().collect()]:
        part = _search_one(index.filter(F.col("dims") == dims), asked.filter(F.col("dims") == dims), dims, k + 1, recall)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.limit(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    own = rows.filter("asks").select(F.col("id").alias("query_id"), F.col("vh").alias("qh"))
    others = own.join(found, "qh").filter(F.col("query_id") != F.col("id"))
    others = others.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return _least(others, ["query_id"], ["distance", "id"], k).select("query_id", F.col("place").alias("rank"), F.col("id").alias("vec_id"), F.col("distance").alias("score"))


def build(index: DataFrame, dims: int) -> Tree:
    """The tree over ``vh, v``, fitted on the ``FIT_ROWS`` vectors of smallest hash."""
    n = index.count()
    drawn = index.select("v", hash60(F.lit(SEED), F.col("vh")).alias("draw")) if n > FIT_ROWS else index.select("v", F.lit(0).alias("draw"))
    sample = drawn.orderBy("draw").limit(FIT_ROWS).select("v").toPandas()  # FIT_ROWS at most
    leaves = max(1, min(n // LEAF_ROWS, FIT_ROWS // LEAF_SAMPLE))
    return fit(_matrix(sample["v"].tolist(), dims), -(-len(sample) // leaves))


def calibrated_visits(tree: Tree, index: DataFrame, asked: DataFrame, dims: int, k: int, recall: float) -> int:
    """Leaf visits after which the calibration queries have found the wanted share of their true neighbours."""
    some = asked.orderBy(hash60(F.lit(SEED), F.col("qh"))).limit(CALIBRATION).toPandas()
    if not len(some) or tree.n_leaves < 2:
        return 1
    truth = _search_all(index, some, dims, k).filter("distance > 0")  # a query's own vector is no find
    where = index.select("leaf", F.explode("ids").alias("id"))
    leaves = truth.join(where, "id").select("qh", "leaf").toPandas()  # CALIBRATION * k rows
    wanted = leaves.groupby("qh")["leaf"].apply(list).to_dict()
    at: list[int] = []  # the visit that finds each neighbour
    for qh, q in zip(some["qh"], _matrix(some["v"].tolist(), dims)):
        order = {leaf: i for i, leaf in enumerate(tree.visits(q))}
        at += [order[x] for x in wanted.get(qh, [])]
    if not at:
        return 1
    found = np.bincount(at).cumsum() / len(at)
    visits = 1
    while found[min(visits, len(found)) - 1] < recall:
        visits += 1
    return visits


def waves(visits: int) -> list[tuple[int, int]]:
    """Visits in a few waves of growing size: what a wave finds bounds what the next one has to send."""
    cuts = sorted({0, visits, *(round(visits ** (i / WAVES)) for i in range(1, WAVES))} if visits > WAVES else {0, visits})
    return list(zip(cuts, cuts[1:]))


def _search_one(index: DataFrame, asked: DataFrame, dims: int, k: int, recall: float) -> DataFrame:
    """``qh, distance, id`` of all queries of one vector length."""
    tree = build(index, dims)
    sent = index.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["leaf"] = sent.value.leaf_of(_matrix(pdf["v"].tolist(), dims))
            yield pdf

    index = materialize(index.select("vh", "v", "ids").mapInPandas(place, "vh long, v array<double>, ids array<long>, leaf long"))
    visits = calibrated_visits(tree, index, asked, dims, k, recall)

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            leaves = []
            for q in _matrix(pdf["v"].tolist(), dims):
                walk = sent.value.visits(q)
                leaves.append([x for _, x in zip(range(visits), walk)])
            pdf["leaf"] = leaves
            yield pdf

    to_see = materialize(asked.select("qh", "v").mapInPandas(order, "qh long, v array<double>, leaf array<long>").select("qh", F.posexplode("leaf").alias("visit", "leaf")))
    sizes = materialize(index.groupBy("leaf").agg((F.floor(F.count("*") / BLOCK_ROWS) + 1).alias("blocks")))
    row_block, turn = F.pmod(F.xxhash64("vh"), F.col("blocks")), F.pmod(F.xxhash64("qh"), F.col("turns"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def scan(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        queries, own = pdf[pdf["asking"]], pdf[~pdf["asking"]]
        rows, ids = _matrix(own["v"].tolist(), dims), own["ids"].tolist()
        names, far, near = [], [], []
        for h, bound, q in zip(queries["qh"], queries["bound"], _matrix(queries["v"].tolist(), dims)):
            d, found = _nearest(rows, ids, q, k, bound)
            names.append(np.full(len(d), h, dtype=np.int64))
            far.append(d)
            near.append(found)
        return pd.DataFrame({"qh": np.concatenate(names), "distance": np.concatenate(far), "id": np.concatenate(near)})

    found = None
    for first, last in waves(visits):
        seeing = to_see.filter((F.col("visit") >= first) & (F.col("visit") < last)).select("qh", "leaf")
        asking = asked.select("qh", "v", F.lit(float("inf")).alias("bound"))
        if found is not None:  # the k-th distance so far, if there are k
            known = found.groupBy("qh").agg(F.when(F.count("*") >= k, F.max("distance")).alias("bound"))
            asking = asked.select("qh", "v").join(known, "qh", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        calls = seeing.groupBy("leaf").agg((F.floor(F.count("*") / BLOCK_QUERIES) + 1).alias("turns"))
        plan = materialize(sizes.join(calls, "leaf"))  # a row per leaf, a bounded number
        held = index.join(F.broadcast(plan), "leaf").select("leaf", row_block.alias("block"), every("turns").alias("turn"), F.lit(False).alias("asking"), F.lit(0).cast("long").alias("qh"), F.lit(0.0).alias("bound"), "v", "ids")
        calling = seeing.join(asking, "qh").join(F.broadcast(plan), "leaf").select("leaf", every("blocks").alias("block"), turn.alias("turn"), F.lit(True).alias("asking"), "qh", "bound", "v", F.lit(None).cast("array<long>").alias("ids"))
        near = held.unionByName(calling).groupBy("leaf", "block", "turn").applyInPandas(scan, "qh long, distance double, id long")
        found = materialize(_least(near if found is None else near.unionByName(found), ["qh"], ["distance", "id"], k).select("qh", "distance", "id"))
    return found
