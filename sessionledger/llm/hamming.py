"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code is the signs of its elements, cut into segments of 16 bits. The index has one table per
segment. A query looks up, segment by segment, all values at distance r from its own, for r = 0, 1, 2, ..;
every code found is verified by its whole Hamming distance. With m segments, once r is done in all of them and r + 1 in
the first j, any code not yet seen is further than m * r + m + j - 1, so the search ends when the k-th
best verified distance is within what is covered. The answer is exact, ties going to the smaller id.

The index is built in blocks of ``BLOCK_ROWS`` codes, each searched by all queries in blocks of
``BLOCK_QUERIES``; a query keeps k rows of a block, and the blocks' answers are merged. Blocks hold codes
by a hash of id and code, so copies of one vector are spread over all.

A null id or vector is neither found nor asked for; a null element counts as 0; shorter vectors are
padded with zeros. Rows equal in id and code count once. A query never finds its own id. With fewer than k
other rows, a query gets as many as there are. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionledger.session import materialize

SEGMENT = 16
BLOCK_ROWS, BLOCK_QUERIES = 32_768, 128
_ONES = np.array([bin(x).count("1") for x in range(1 << 8)], dtype=np.uint8)
_ONES = (_ONES[:, None] + _ONES[None, :]).ravel()  # set bits of every 16-bit number
_MASKS = [np.flatnonzero(_ONES == r) for r in range(SEGMENT + 1)]


def code_of(vector: Column, segments: int) -> Column:
    """The signs of a vector as 16-bit numbers, the first element as the highest bit."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(segments * SEGMENT - 1)), lambda i: (F.coalesce(F.get(vector, i), F.lit(0.0)) > 0).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda j: F.aggregate(F.slice(bits, j * SEGMENT + 1, SEGMENT), F.lit(0), lambda a, b: a * 2 + b))


class MultiIndex:
    """The segment tables of one block; codes: rows of 16-bit segments."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        self.ids, self.codes = ids, codes
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.start = [np.searchsorted(codes[o, j], np.arange((1 << SEGMENT) + 1)) for j, o in enumerate(self.order)]

    def nearest(self, own: int, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest codes of other ids, in order."""
        n, m = self.codes.shape
        seen = np.zeros(n, dtype=bool)
        seen[self.ids == own] = True
        ids, dist = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for r in range(SEGMENT + 1):
            for j in range(m):
                values = code[j] ^ _MASKS[r]
                a, b = self.start[j][values], self.start[j][values + 1]
                a, b = a[b > a], b[b > a]
                if len(a):
                    # all positions of the ranges a .. b
                    runs = b - a
                    at = np.repeat(a - np.concatenate(([0], runs.cumsum()[:-1])), runs) + np.arange(runs.sum())
                    found = self.order[j][at]
                    found = found[~seen[found]]
                    seen[found] = True
                    d = _ONES[self.codes[found] ^ code].sum(axis=1, dtype=np.int64)
                    ids, dist = np.concatenate((ids, self.ids[found])), np.concatenate((dist, d))
                    best = np.lexsort((ids, dist))[:k]
                    ids, dist = ids[best], dist[best]
                if len(dist) == k and dist[-1] <= m * r + j:
                    return ids, dist
        return ids, dist


def top_k(vectors: DataFrame, queries: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, neighbor_id, distance``: the k nearest other rows of every row for which ``queries`` holds."""
    sized = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull())
    width = sized.agg(F.max(F.size(vector))).first()[0] or 1
    m = -(-width // SEGMENT)
    rows = materialize(sized.select(F.col(key).cast("long").alias("id"), code_of(F.col(vector), m).alias("code"), F.coalesce(queries, F.lit(False)).alias("asks")).distinct())
    blocks = rows.count() // BLOCK_ROWS + 1
    asked = rows.filter("asks")
    q_blocks = asked.count() // BLOCK_QUERIES + 1

    def packed(df: DataFrame, n: int, name: str) -> DataFrame:
        """One row per block; a block's rows are bounded by the number of blocks."""
        return df.groupBy(F.pmod(F.xxhash64("id", "code"), F.lit(n)).alias(name)).agg(F.collect_list(F.struct("id", "code")).alias(f"{name}_rows"))

    tasks = packed(asked, q_blocks, "q").select("q", "q_rows", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))
    pairs = tasks.join(packed(rows.drop("asks"), blocks, "b"), "b").repartition(F.col("b"), F.col("q"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, index = None, None
        for pdf in batches:
            for b, asked_rows, own_rows in zip(pdf["b"], pdf["q_rows"], pdf["b_rows"]):
                if now != b:
                    now, index = b, MultiIndex(np.array([r["id"] for r in own_rows], dtype=np.int64), np.array([r["code"] for r in own_rows], dtype=np.int64).reshape(len(own_rows), m))
                out = []
                for r in asked_rows:
                    ids, dist = index.nearest(r["id"], np.array(r["code"], dtype=np.int64), k)
                    out.append(pd.DataFrame({"query_id": r["id"], "neighbor_id": ids, "distance": dist}))
                yield pd.concat(out)

    near = pairs.mapInPandas(search, "query_id long, neighbor_id long, distance int")
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return near.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")
