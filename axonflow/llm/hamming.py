"""Exact top-k search over binary codes by incremental multi-index hashing (operator 2).

A code is cut into segments of 16 bits, each with a table of the distinct codes by segment value. A query probes all
segment values within radius 0, then 1, 2, ... of its own; after radius r in each of S segments every code within distance
S * (r + 1) - 1 has been met, since one of its segments is within r. Met codes are verified in full, and a query stops
when its k-th verified distance is covered in that sense. Ties at the k-th place fall to the smaller id, which coverage
makes exact. Where a radius has more segment values than a table has codes, the table's values are compared instead.

Spark deals the rows into index blocks of about ``INDEX_ROWS``. Each query is searched in one block first, its home,
which moves neither index nor queries twice. Its k-th distance there bounds the radius in all other blocks, to which the
queries go in parts of about ``QUERY_ROWS``: so many queries meet one copy of a block. The lists of the blocks are merged.
The union of exact lists holds the exact list, so nothing is lost at any number of blocks.

Defined cases: bit i is set where component i is positive (null and NaN are not); missing components are 0; rows with a
null vector or id are neither indexed nor queried; a row is not its own neighbour; repeated ids and codes are ordinary
rows (of equal codes in a block, no more than the k + 1 smallest ids can be answers); fewer than k rows give all of them;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axonflow.llm.common import materialize, table

SEGMENT_BITS, WORD_BITS = 16, 64
INDEX_ROWS, QUERY_ROWS = 1 << 16, 1 << 18
#: Queries whose probes are held at a time.
PROBED = 16
RESULT_SCHEMA = "q long, query_id long, neighbor_id long, distance int"


def sign_codes(vectors: DataFrame) -> DataFrame:
    """vec_id and code: the signs of all components, 64 to a word."""
    rows = vectors.where("embedding IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "embedding")
    words = max(1, math.ceil((rows.agg(F.max(F.size("embedding"))).first()[0] or 0) / WORD_BITS))
    bit = "(x, i) -> IF(x > 0 AND NOT isnan(x), shiftleft(1L, i), 0L)"
    word = lambda w: F.expr(f"aggregate(transform(slice(embedding, {WORD_BITS * w + 1}, {WORD_BITS}), {bit}), 0L, (a, b) -> a | b)")
    return rows.select("vec_id", F.array(*(word(w) for w in range(words))).alias("code"))


def _flips(radius: int) -> np.ndarray:
    """All 16-bit masks with ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT_BITS), radius)], np.int64)


def _segments(codes: np.ndarray) -> np.ndarray:
    """Segment values, (segments, codes), of (codes, words)."""
    shifts = np.arange(0, WORD_BITS, SEGMENT_BITS, dtype=np.uint64)
    return ((codes[:, :, None] >> shifts) & np.uint64((1 << SEGMENT_BITS) - 1)).reshape(len(codes), -1).T.astype(np.int64)


def search_block(queries: np.ndarray, query_ids: np.ndarray, codes: np.ndarray, ids: np.ndarray, k: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, neighbour id, distance) of the k nearest rows of each query, itself left out, by distance, then id.

    ``queries`` and ``codes`` have a row of 64-bit words each. With ``limit``, rows farther than that are of no use.
    """
    distinct, which = np.unique(codes, axis=0, return_inverse=True)
    order = np.lexsort((ids, which.ravel()))
    count = np.bincount(which.ravel(), minlength=len(distinct))
    first = np.cumsum(count) - count
    ids, count = ids[order], np.minimum(count, k + 1)
    values = _segments(distinct)
    tables = [(np.argsort(v, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(v, minlength=1 << SEGMENT_BITS))])) for v in values]
    limit = np.full(len(queries), WORD_BITS * queries.shape[1]) if limit is None else limit.copy()
    parts = []
    for low in range(0, len(queries), PROBED):
        active = np.arange(low, min(low + PROBED, len(queries)))
        asked = _segments(queries[active])
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # query, distance, row
        for radius in range(SEGMENT_BITS + 1):
            flips, met = _flips(radius), []
            for value, own, (rows, offsets) in zip(values, asked[:, active - low], tables, strict=True):
                if len(flips) > len(distinct):
                    q, code = np.nonzero(np.bitwise_count(own[:, None] ^ value) == radius)
                else:
                    probe = (own[:, None] ^ flips).ravel()
                    start, n = offsets[probe], offsets[probe + 1] - offsets[probe]
                    hit = np.flatnonzero(n)
                    n = n[hit]
                    code = rows[np.arange(int(n.sum())) + np.repeat(start[hit] - (np.cumsum(n) - n), n)]
                    q = np.repeat(hit // len(flips), n)
                met.append(active[q] * len(distinct) + code)
            q, code = np.divmod(np.unique(np.concatenate(met)), max(len(distinct), 1))
            d = np.bitwise_count(queries[q] ^ distinct[code]).sum(axis=1, dtype=np.int64)
            keep = d <= limit[q]
            q, code, d = q[keep], code[keep], d[keep]
            n = count[code]
            row = np.arange(int(n.sum())) + np.repeat(first[code] - (np.cumsum(n) - n), n)
            q, d = np.repeat(q, n), np.repeat(d, n)
            other = ids[row] != query_ids[q]
            q, d, row = (np.concatenate(x) for x in zip(best, (q[other], d[other], row[other]), strict=True))
            sort = np.lexsort((row, ids[row], d, q))
            q, d, row = q[sort], d[sort], row[sort]
            new = np.ones(len(q), bool)  # a row can be met at several radii
            new[1:] = (q[1:] != q[:-1]) | (row[1:] != row[:-1])
            q, d, row = q[new], d[new], row[new]
            top = np.arange(len(q)) - np.searchsorted(q, q) < k
            best = q[top], d[top], row[top]
            found = np.bincount(best[0], minlength=len(queries))
            full = active[found[active] >= k]
            limit[full] = np.minimum(limit[full], best[1][np.searchsorted(best[0], full, side="right") - 1])
            active = active[limit[active] > len(values) * (radius + 1) - 1]
            if not len(active):
                break
        parts.append((best[0], ids[best[2]], best[1]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _search(k: int):
    def words(column: pd.Series) -> np.ndarray:
        return np.stack(column.to_numpy()).astype(np.int64).view(np.uint64)

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"q": [], "query_id": [], "neighbor_id": [], "distance": []}).astype({"q": "int64", "query_id": "int64", "neighbor_id": "int64", "distance": "int32"})
        ids = q["vec_id"].to_numpy(np.int64)
        row, near, d = search_block(words(q["code"]), ids, words(x["code"]), x["vec_id"].to_numpy(np.int64), k, q["reach"].to_numpy(np.int64))
        return pd.DataFrame({"q": q["q"].to_numpy(np.int64)[row], "query_id": ids[row], "neighbor_id": near, "distance": d.astype(np.int32)})

    return run


def top_k(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), neighbor_id, distance: the k nearest rows of ``index`` for each row of ``queries``.

    Both have vec_id and code (an array of 64-bit words, of one length). Every query meets every row in some block.
    """
    deal = lambda seed, n: F.pmod(F.xxhash64("vec_id", "code", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = materialize(index.select("vec_id", "code"), "mih-index")
    blocks = max(1, math.ceil(index.count() / INDEX_ROWS))
    asked = queries.select("vec_id", "code", F.monotonically_increasing_id().alias("q"), deal(2, blocks).alias("home"))
    asked = materialize(asked.withColumn("reach", (F.size("code") * WORD_BITS).cast("long")), "mih-queries")
    rows = index.select("vec_id", "code", deal(1, blocks).alias("block"))
    home = asked.select("q", "vec_id", "code", "reach", F.col("home").alias("block")).groupBy("block")
    lists = home.cogroup(rows.groupBy("block")).applyInPandas(_search(k), RESULT_SCHEMA)
    if blocks > 1:
        lists = materialize(lists, "mih-home")
        parts = max(1, math.ceil(asked.count() / QUERY_ROWS))
        reach = lists.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).cast("long").alias("near"))
        away = asked.join(reach, "q", "left").withColumn("reach", F.coalesce("near", "reach"))
        away = away.select("q", "vec_id", "code", "reach", "home", deal(3, parts).alias("part"), every(blocks).alias("block")).where("block != home").drop("home")
        others = away.groupBy("part", "block").cogroup(rows.withColumn("part", every(parts)).groupBy("part", "block")).applyInPandas(_search(k), RESULT_SCHEMA)
        lists = lists.unionByName(others)
    order = Window.partitionBy("q").orderBy("distance", "neighbor_id")
    ranked = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "neighbor_id", "distance")


def op2_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sign_codes(table(spark, sf_dir, "embeddings"))
    return top_k(codes, codes.where("vec_id % 20 = 0"))


SQL = {
    "op2_hamming_top_k": """
WITH c AS (SELECT vec_id, list_transform(range(1, 65), lambda i: embedding[i] > 0) AS b FROM embeddings),
d AS (SELECT q.vec_id AS query_id, x.vec_id AS neighbor_id,
             CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.b[i] != x.b[i] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
      FROM c q JOIN c x ON q.vec_id != x.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10""",
}
QUERIES = {"op2_hamming_top_k": op2_hamming_top_k}
