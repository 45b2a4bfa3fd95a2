"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integer vectors; a term is a dimension with a sign. Rows of each
group are ordered by their strongest term and cut into blocks of document
ranges, each with a forward index (its integer matrix) and every dimension's
least and greatest value. For a query, the terms' greatest contributions sum to
a bound for the block. Blocks are visited by falling bound and scored through
their forward index until the bound falls below the query's k-th score.

Queries travel in large blocks to every group of documents, whose index is built
once for each; a group answers with at most k rows a query, and a window keeps
the k best of them. Groups shrink on small tables, so that all cores have one.

Integers are held as doubles, which is exact, and multiplied as doubles where
all sums stay below 2**53, else as 64-bit integers where they stay below 2**62,
else as Python integers.

Defined cases: vectors that are null, or hold null or non-finite components (or
double ones that scaling makes infinite), take no part; shorter vectors count as padded with zeros; equal scores go to the
smaller id; repeated ids are separate candidates, and a row never answers a query
of its own id; a score among a query's k best that no long holds raises
OverflowError; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

BLOCK = 512
FLOAT_EXACT, LONG_EXACT = float(1 << 53), float(1 << 62)
LEAST = -(1 << 63)


def quantize(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, terms array<double>, whole numbers) of the rows that take part."""
    raw = F.col(vector_col)
    usable = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))

    def whole(x):
        scaled = x.cast("double") * scale
        return F.when(F.abs(scaled) < FLOAT_EXACT, F.floor(scaled).cast("double")).otherwise(scaled)

    return vectors.where(F.col(id_col).isNotNull() & raw.isNotNull()).where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(raw, whole).alias("terms"))


def matrix(rows: pd.Series) -> np.ndarray:
    wide = max(map(len, rows), default=0)
    out = np.zeros((len(rows), wide))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``; those beyond a long as the nearest long."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if most < FLOAT_EXACT:
        return (a @ b.T).astype(np.int64)
    if most < LONG_EXACT:
        return a.astype(np.int64) @ b.astype(np.int64).T
    x, y = (np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (a, b))
    return np.clip(x @ y.T, LEAST + 1, (1 << 63) - 1).astype(np.int64)


class BlockIndex:
    """Document-range blocks over integer vectors with term bounds and forward indexes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block: int = BLOCK):
        if vectors.shape[1]:
            strongest = np.abs(vectors).argmax(axis=1)
            signed = 2 * strongest + (vectors[np.arange(len(ids)), strongest] > 0)
            order = np.lexsort((ids, -np.abs(vectors).max(axis=1), signed))
        else:
            order = np.argsort(ids, kind="stable")
        self.ids, vectors = ids[order], vectors[order].astype(float)
        self.cuts = list(range(0, len(ids), block)) + [len(ids)]
        self.blocks = [vectors[a:b] for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        self.least = np.array([b.min(axis=0) for b in self.blocks]).reshape(len(self.blocks), -1)
        self.most = np.array([b.max(axis=0) for b in self.blocks]).reshape(len(self.blocks), -1)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of each query's scores in each block, raised by what rounding can take from them."""
        wide = q.shape[1]
        least, most = self.least[:, :wide], self.most[:, :wide]
        rounded = np.abs(q) @ np.maximum(np.abs(least), np.abs(most)).T * ((wide + 2) * np.finfo(float).eps)
        return np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T + np.where(rounded < 0.25, 0, rounded)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, vec_id, score) of each query's k best, ties to the smaller id."""
        wide = min(queries.shape[1], self.least.shape[1])
        q = queries[:, :wide].astype(float)
        with np.errstate(over="ignore", invalid="ignore"):
            bounds = np.nan_to_num(self.bounds(q), nan=np.inf, posinf=np.inf)
        order = np.argsort(-bounds, axis=1, kind="stable")
        n = len(q)
        best = np.full((n, k), LEAST, np.int64)
        owner = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        going = np.ones(n, bool)
        for rank in range(order.shape[1]):
            going &= bounds[np.arange(n), order[:, rank]] >= best[:, -1]
            if not going.any():
                break
            for b in np.unique(order[going, rank]):
                at = np.flatnonzero(going & (order[:, rank] == b))
                a, z = self.cuts[b], self.cuts[b + 1]
                ids = self.ids[a:z]
                scores = products(q[at], self.blocks[b][:, :wide])
                own = query_ids[at, None] == ids[None, :]
                keep = min(k, z - a)
                for i, row in enumerate(at):
                    s, m = scores[i], ids
                    if own[i].any():
                        s, m = s[~own[i]], m[~own[i]]
                    if len(s) > keep:
                        kth = np.partition(s, len(s) - keep)[len(s) - keep]
                        hit = s >= max(kth, best[row, -1])
                        s, m = s[hit], m[hit]
                    s, m = np.concatenate([best[row], s]), np.concatenate([owner[row], m])
                    top = np.lexsort((m, ~s))[:k]
                    best[row], owner[row] = s[top], m[top]
        real = best > LEAST
        if ((best == (1 << 63) - 1) | (best == LEAST + 1)).any():
            raise OverflowError("a score among the best is beyond a long")
        where = np.repeat(np.arange(n), real.sum(axis=1))
        return where, owner[real], best[real]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = 65536, rows_per_group: int = 65536, least_group: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of ``vectors`` for each query; both from ``quantize``."""
    n_rows = vectors.count()
    n_queries = queries.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-n_rows // rows_per_group), min(cores, n_rows // least_group))
    parts = max(1, -(-n_queries // query_block))

    def bucket(n: int, salt: int):
        return F.pmod(F.xxhash64(F.col("vec_id"), F.lit(salt)), F.lit(n)).cast("int")

    left = vectors.select(bucket(groups, 1).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), "vec_id", "terms")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), bucket(parts, 2).alias("p"), "vec_id", "terms")

    def answer(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if docs.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        index = BlockIndex(docs.vec_id.to_numpy(np.int64), matrix(docs.terms))
        ids = asked.vec_id.to_numpy(np.int64)
        found = [index.search(ids[i : i + 4096], matrix(asked.terms[i : i + 4096]), k) for i in range(0, len(ids), 4096)]
        where = np.concatenate([w + 4096 * i for i, (w, _, _) in enumerate(found)])
        return pd.DataFrame({"query_id": ids[where], "vec_id": np.concatenate([v for _, v, _ in found]), "score": np.concatenate([s for _, _, s in found])})

    local = left.groupBy("g", "p").cogroup(right.groupBy("g", "p")).applyInPandas(answer, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
