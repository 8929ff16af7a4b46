"""Operator 7, exact top-k search by tiled matrix products.

Vectors are packed into written shards of rows, which never move: blocks of
queries of at most ``QUERY_BYTES`` are broadcast one after another, and each
task scans the shards of its partition.  A slice of queries and some shards
form a tile, one matrix product whose columns are reduced to the k best per query
at once; a task merges the lists of its tiles, and the lists of the tasks,
all that is shuffled, are merged in a tree, ``FAN`` lists a query at a time.

Components become floor(scale * x); scores are exact integers: products run
in float64 while every sum is below 2**53, else in Python integers, and are
clipped to 64 bits.

Defined cases: vectors that are null or hold null, NaN or infinite
components take no part, nor do rows without an id; a query meets only
vectors of its own length; repeated rows are rows of their own (a query
excludes only its own row, so a copy of it can be its best hit); ties go to
the smaller id; fewer than k candidates give fewer rows; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetrina.llm.common import materialize, pieces_for

SHARD_ROWS, TILE_SHARDS, QUERY_BYTES, FAN = 4096, 8, 1 << 26, 16
_COLUMNS = ["shard", "dim", "ids", "at", "m", "n"]
_LISTS = "shard string, at int, query_id long, tile int, ids array<long>, scores array<long>"
_PACKED = "shard string, dim int, ids binary, at binary, m binary, n int"


def _pack(scale: float):
    def pack(batches):
        from pyspark import TaskContext
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            batch = batch.assign(dim=batch["vector"].map(len))
            for dim, rows in batch.groupby("dim", sort=True):
                for a in range(0, len(rows), SHARD_ROWS):
                    own = rows.iloc[a : a + SHARD_ROWS]
                    m = np.array(own["vector"].tolist(), np.float64).reshape(len(own), dim)
                    ids = own["id"].to_numpy(np.int64)
                    yield pd.DataFrame({"shard": [f"{part}-{k}"], "dim": [dim], "ids": [ids.tobytes()], "at": [np.arange(len(own), dtype=np.int32).tobytes()],
                                        "m": [np.floor(scale * m).tobytes()], "n": [len(own)]})
                    k += 1
    return pack


def _unpack(frame: pd.DataFrame, dim: int):
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in frame["ids"]])
    at = np.concatenate([np.frombuffer(x, np.int32) for x in frame["at"]])
    m = np.concatenate([np.frombuffer(x, np.float64) for x in frame["m"]]).reshape(len(ids), dim)
    shard = np.repeat(frame["shard"].to_numpy(), frame["n"].to_numpy())
    return ids, at, m, shard


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    if not q.size or np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2.0**53:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q.tolist()], object) @ np.array([[int(x) for x in r] for r in c.tolist()], object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query; ``ids`` ascend."""
    if len(scores) > k:  # everything above the k-th score, then the first of its ties
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > kth)
        best = np.concatenate([above, np.flatnonzero(scores == kth)[: k - len(above)]])
        ids, scores = ids[best], scores[best]
    order = np.lexsort((ids, ~scores))
    return ids[order], scores[order]


def _merge(a, b, k: int):
    ids, scores = (np.concatenate(x) for x in zip(a, b, strict=True))
    order = np.lexsort((ids, ~scores))[:k]
    return ids[order], scores[order]


def _scan(block, k: int):
    def scan(batches):
        from pyspark import TaskContext
        tile = TaskContext.get().partitionId()
        queries = {dim: _unpack(rows, dim) for dim, rows in pd.DataFrame(block.value, columns=_COLUMNS).groupby("dim")}
        found: dict[tuple, tuple] = {}
        for batch in batches:
            for dim, frame in batch.groupby("dim"):
                if dim not in queries:
                    continue
                qid, qat, q, qshard = queries[dim]
                for b in range(0, len(frame), TILE_SHARDS):
                    shards = frame.iloc[b : b + TILE_SHARDS]
                    begin = dict(zip(shards["shard"], shards["n"].cumsum() - shards["n"], strict=True))
                    cid, _, c, _ = _unpack(shards, dim)
                    order = np.argsort(cid, kind="stable")  # ties to the smaller id
                    cid, c, place = cid[order], c[order], np.argsort(order)
                    for a in range(0, len(qid), 256):
                        for i, s in enumerate(_scores(q[a : a + 256], c), a):
                            ids = cid
                            if qshard[i] in begin:  # the query's own row
                                own = place[begin[qshard[i]] + qat[i]]
                                s, ids = np.delete(s, own), np.delete(cid, own)
                            best = _best(ids, s, k)
                            found[dim, i] = _merge(found[dim, i], best, k) if (dim, i) in found else best
        rows = [(queries[dim][3][i], int(queries[dim][1][i]), int(queries[dim][0][i]), tile, ids.tolist(), scores.tolist())
                for (dim, i), (ids, scores) in found.items()]
        yield pd.DataFrame(rows, columns=["shard", "at", "query_id", "tile", "ids", "scores"])
    return scan


def _blocks(rows, most: int):
    """Rows of the query table in blocks of about ``most`` bytes (one shard's
    queries more, at most)."""
    held, size = [], 0
    for r in rows:
        held.append((r.shard, r.dim, bytes(r.ids), bytes(r.at), bytes(r.m), r.n))
        size += len(r.m)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def exact_top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0, query_every: int = 20) -> DataFrame:
    """(query_id, rank from 1, <id_col>, score) of the k best other rows for
    each row whose id is divisible by ``query_every``."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double")).alias("vector"))
    rows = rows.where("id is not null and vector is not null").where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    shards = materialize(rows.mapInPandas(_pack(scale), _PACKED), "vector-shards")

    def pick(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                ids = np.frombuffer(r.ids, np.int64)
                own = np.flatnonzero(ids % query_every == 0)
                if len(own):
                    m = np.frombuffer(r.m, np.float64).reshape(len(ids), r.dim)[own]
                    out.append((r.shard, r.dim, ids[own].tobytes(), np.frombuffer(r.at, np.int32)[own].tobytes(), m.tobytes(), len(own)))
            yield pd.DataFrame(out, columns=_COLUMNS)

    queries = materialize(shards.mapInPandas(pick, _PACKED), "vector-queries")
    written = []
    for block in _blocks(queries.toLocalIterator(), QUERY_BYTES):
        sent = spark.sparkContext.broadcast(block)
        written.append(materialize(shards.mapInPandas(_scan(sent, k), _LISTS), "top-lists"))
        sent.destroy()
    lists = functools.reduce(DataFrame.unionAll, written) if written else spark.createDataFrame([], _LISTS)
    tiles = (lists.agg(F.max("tile")).first()[0] or 0) + 1
    best = F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct(F.bitwise_not(x["scores"]).alias("minus"), x["ids"].alias("id")))
    merged = lists.select("shard", "at", "query_id", "tile", best.alias("best"))
    while tiles > 1:  # tree of lists: FAN tiles become one
        tiles = pieces_for(tiles, FAN)
        merged = (merged.groupBy("shard", "at", "query_id", F.floor(F.col("tile") / FAN).cast("int").alias("tile"))
                  .agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")))
    return merged.select("query_id", F.posexplode("best").alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias(id_col), F.bitwise_not(F.col("hit.minus")).alias("score"))
