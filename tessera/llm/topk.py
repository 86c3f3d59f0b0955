"""Exact top-k inner-product search by the threshold algorithm.

Candidates are dealt into blocks. A block is an index: its matrix and, for each dimension, the list of its rows
sorted by that component. A query walks all lists of a block in step, from the end that its own component's sign
prefers, scores each row that it meets for the first time, and stops once the sum of the last components met
(the best score that an unseen row can have) is below its k-th score. Queries are dealt into blocks as well, so
that a task holds one block of each; the k best of every block are then merged by one window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import blocks_for

BLOCK_ROWS = 4096
QUERY_ROWS = 4096
FIRST_STEP = 32
#: Inner products below this are exact in double precision, where numpy multiplies matrices fastest.
EXACT = 2.0**53


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, x taken as double; null if the vector or a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _pack(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids = pdf["id"].to_numpy(np.int64)
    order = np.argsort(ids, kind="stable")
    matrix = np.stack([np.asarray(v, dtype=np.int64) for v in pdf["vec"]]) if len(pdf) else np.zeros((0, 0), np.int64)
    return ids[order], matrix[order]


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row: a block's ids, its matrix and its sorted lists, one for each dimension."""
    ids, matrix = _pack(pdf)
    lists = np.argsort(matrix, axis=0, kind="stable").T.astype(np.int32)
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "block": [pdf["block"].iloc[0]], "n": [len(ids)], "ids": [ids.tobytes()], "matrix": [matrix.tobytes()], "lists": [np.ascontiguousarray(lists).tobytes()]})


def _queries(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, matrix = _pack(pdf)
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "qblock": [pdf["block"].iloc[0]], "qids": [ids.tobytes()], "qmatrix": [matrix.tobytes()]})


def threshold_topk(query: np.ndarray, own: int, ids: np.ndarray, matrix: np.ndarray, lists: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores, rows scored) of the k best rows for a query, ties to the smaller id; rows of id own take no part."""
    n = len(ids)
    seen = ids == own
    used = np.flatnonzero(query)
    up, down = used[query[used] < 0], used[query[used] > 0]
    best_ids, best = np.zeros(0, np.int64), np.zeros(0, matrix.dtype)
    depth, step, scored = 0, FIRST_STEP, 0
    while depth < n:
        end = min(n, depth + step)
        met = np.zeros(n, bool)
        if len(used):
            met[lists[up, depth:end]] = True
            met[lists[down, n - end : n - depth]] = True
        else:
            met[:] = True  # the zero query: every row scores 0
            end = n
        new = np.flatnonzero(met & ~seen)
        seen |= met
        scored += len(new)
        if len(new):
            all_ids, scores = np.concatenate([best_ids, ids[new]]), np.concatenate([best, matrix[new] @ query])
            if len(scores) > 4 * k:  # only rows that reach the k-th score need sorting
                enough = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                all_ids, scores = all_ids[enough], scores[enough]
            order = np.lexsort((all_ids, -scores))[:k]
            best_ids, best = all_ids[order], scores[order]
        depth, step = end, step * 2
        if len(best) == k and len(used):
            last = np.where(query[used] < 0, matrix[lists[used, end - 1], used], matrix[lists[used, n - end], used])
            if last @ query[used] < best[-1]:
                break
    return best_ids, best, scored


def _search(k: int):
    def run(index: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": [], "n_scored": []}
        if len(index) and len(wanted):
            row, asked = index.iloc[0], wanted.iloc[0]
            ids, qids = np.frombuffer(row["ids"], np.int64), np.frombuffer(asked["qids"], np.int64)
            matrix = np.frombuffer(row["matrix"], np.int64).reshape(row["n"], row["dim"])
            queries = np.frombuffer(asked["qmatrix"], np.int64).reshape(len(qids), row["dim"])
            lists = np.frombuffer(row["lists"], np.int32).reshape(row["dim"], row["n"])
            if row["dim"] and float(np.abs(matrix).max()) * float(np.abs(queries).max()) * row["dim"] < EXACT:
                matrix, queries = matrix.astype(np.float64), queries.astype(np.float64)
            for own, query in zip(qids, queries, strict=True):
                found, scores, scored = threshold_topk(query, own, ids, matrix, lists, k)
                out["query_id"] += [own] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += scores.astype(np.int64).tolist()
                out["n_scored"] += [scored] * len(found)
        return pd.DataFrame(out)

    return run


def exact_topk(candidates: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k highest integer inner products, ties to the smaller vec_id.

    Every row of candidates but those with the query's own id is searched. Vectors that are null or hold a null
    or non-finite component take no part; a query meets only vectors of its own length; an id that is null takes
    no part. A query id that stands in several rows is searched once, by the smallest vector. Repeated candidate rows
    each count. Other columns are ignored. n_scored is the number of rows that the block of that result scored before it could stop.
    """

    def taken(df: DataFrame) -> DataFrame:
        out = df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("vec"))
        return out.filter(F.col("id").isNotNull() & F.col("vec").isNotNull()).withColumn("dim", F.size("vec"))

    rows, asked = taken(candidates), taken(queries).groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))
    n_blocks, n_qblocks = blocks_for(rows.count(), BLOCK_ROWS), blocks_for(asked.count(), QUERY_ROWS)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "vec", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_qblocks)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = rows.groupBy("dim", "block").applyInPandas(_index, "dim int, block int, n int, ids binary, matrix binary, lists binary").withColumn("qblock", every(n_qblocks))
    wanted = asked.groupBy("dim", "block").applyInPandas(_queries, "dim int, qblock int, qids binary, qmatrix binary").withColumn("block", every(n_blocks))
    pairs = index.groupBy("dim", "block", "qblock").cogroup(wanted.groupBy("dim", "block", "qblock"))
    found = pairs.applyInPandas(_search(k), "query_id long, vec_id long, score long, n_scored long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_scored")
