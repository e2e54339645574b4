"""Exact top-k search by inner product over integer vectors.

Method: exhaustive term-at-a-time accumulation.  A vector's components
are ``floor(scale * x)``; a term is a component's position, its postings
the (row, weight) pairs of a block of candidates whose weight there is
not zero.  For each query row, each of its non-zero terms scatters
query weight x posting weight into a dense score array over the block;
a partition then selects the block's k best, and the blocks' selections
are merged.

Distribution: candidates are dealt by hash into blocks of about
``block_rows``, queries into blocks of about ``query_rows``; every pair
of blocks is one task's unit of work, with a bounded number of rows on
both sides.  Only k rows per query and block leave it.

Defined cases: vectors that are null or hold a null or non-finite
component take no part, nor do rows with a null id.  Every row of a
repeated id is a candidate, and as a query row asks for itself; rows of a
query's own id are none of its results.  Vectors of unequal length meet on
their common positions (a missing one weighs zero).  Scores are exact
(see ``vectors``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwarden.llm.common import prepare, stored
from tickwarden.llm.vectors import NARROW, SCALE, SCORE, Rows, as_long, as_score, exact, usable

K = 5
BLOCK_ROWS = 16_384
QUERY_ROWS = 4_096


def searchable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<double>), one row per row that takes part."""
    return usable(vectors, id_col, vector_col)


class Block:
    """Postings of a block of candidate rows (ids ascending)."""

    def __init__(self, ids: np.ndarray, vectors: list, scale: int = SCALE) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.scale = ids[order], scale
        self.rows = Rows([vectors[i] for i in order], scale)
        self.postings = []
        for weights in self.rows.matrix.T.astype(np.int64):
            at = np.flatnonzero(weights)
            # a list that names most rows is kept as a whole row
            self.postings.append((None, weights) if 2 * len(at) > len(weights) else (at, weights[at]))

    def scores(self, vector: np.ndarray, out: np.ndarray, work: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            query = np.floor(vector * self.scale)
        if np.abs(query).max(initial=0.0) > NARROW:
            whole = exact(vector, self.scale)
            return np.array([self.rows.product(i, whole) for i in range(len(self.ids))] + [None], object)[:-1]
        query = query.astype(np.int64)
        out[:] = 0
        for term in np.flatnonzero(query[: len(self.postings)]):
            at, weights = self.postings[term]
            if at is None:
                np.multiply(weights, query[term], out=work)
                out += work
            elif len(at):
                out[at] += weights * query[term]
        if not self.rows.wide:
            return out
        scores, whole = out.astype(object), [int(v) for v in query]
        for i in self.rows.wide:
            scores[i] = self.rows.product(i, whole)
        return scores

    def best(self, scores: np.ndarray, own: int, k: int) -> list[int]:
        """Positions of the k best (score descending, id ascending), of other ids than ``own``."""
        others = np.flatnonzero(self.ids != own)
        if len(others) > k:
            found = scores[others]
            edge = np.partition(found, len(found) - k)[len(found) - k]
            others = others[found >= edge]  # with all ties, ids ascending
        return sorted(others.tolist(), key=lambda i: -scores[i])[:k]


def _search(k: int):
    def run(key: tuple, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            block = Block(candidates["vec_id"].to_numpy(np.int64), list(candidates["x"]))
            sums, work = np.zeros(len(block.ids), np.int64), np.zeros(len(block.ids), np.int64)
            for q, own, vector in zip(queries["row"], queries["query_id"], queries["vector"]):
                scores = block.scores(np.asarray(vector, np.float64), sums, work)
                out += [(q, own, int(block.ids[i]), as_score(scores[i])) for i in block.best(scores, own, k)]
        return pd.DataFrame(out, columns=["q", "query_id", "vec_id", "score"])

    return run


def top_k(
    rows: DataFrame, is_query: Column, k: int = K, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """rows(vec_id, x) to (query_id, rank, vec_id, score)."""
    prepare(rows.sparkSession)
    # the number of a row tells the rows of one id apart
    rows = stored(rows.select("vec_id", "x", F.monotonically_increasing_id().alias("q")), "vectors")
    # names of their own: Spark prunes columns that both sides of a cogroup share
    queries = rows.where(is_query).select(
        F.col("q").alias("row"), F.col("vec_id").alias("query_id"), F.col("x").alias("vector")
    )
    n, q = rows.count(), queries.count()
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-q // query_rows))

    def dealt(df: DataFrame, number: str, own: int, name: str, other: int, other_name: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(number), F.lit(own)).cast("int").alias(name)
        return df.select("*", mine, F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(other_name))

    left = dealt(rows, "q", blocks, "block", groups, "part").groupBy("block", "part")
    right = dealt(queries, "row", groups, "part", blocks, "block").groupBy("block", "part")
    partial = left.cogroup(right).applyInPandas(_search(k), f"q bigint, query_id bigint, vec_id bigint, score {SCORE}")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", as_long(F.col("score")).alias("score"))
