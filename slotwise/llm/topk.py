"""Exact top-k by inner product with a pivot table.

Candidate vectors get one more coordinate, sqrt(R^2 - |v|^2) with R the largest norm, so
all have norm R. A query, stretched to norm R too and with coordinate 0, then has the distance
sqrt(2 R^2 - 2 R q.v / |q|) to a candidate, which falls as their inner product grows. The table holds each candidate's distance to PIVOTS pivots. The
largest difference between a query's and a candidate's distances to a pivot is a lower bound
of their distance, hence an upper bound of the score. Candidates are evaluated in bound
order until no bound left can reach the k-th score; bounds carry a slack for rounding and
equal bounds are still evaluated, so results are exact, ties to the smaller id.

Queries and candidates are dealt to blocks of bounded size; every pair of blocks is one
group, starts from the pivot distances alone and gives k rows a query at most. Blocks meet again by query.

Vectors that are null, empty or hold a null or non-finite component take no part. Vectors of
different lengths compare as if filled up with zeros. Repeated rows count as often as they
occur; a query's own id never answers it. Components beyond MAX_COMPONENT after scaling
would overflow a long and are refused with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import query, stored, table

SCALE, K, EVERY, PIVOTS = 1024, 10, 100, 48
QUERY_BLOCK, CANDIDATE_BLOCK, STEP = 512, 8192, 64
MAX_COMPONENT = 1 << 28


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long) of the rows that take part."""
    x = F.col("embedding")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(F.col("embedding"), lambda c: F.floor(c.cast("double") * scale))
    return vectors.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    flat, ends = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(ends), width), np.int64)
    out[np.arange(width) < ends[:, None]] = flat
    return out


def far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots: each the sample's vector farthest from those before it."""
    chosen = [int((sample**2).sum(1).argmax())]
    far = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def lifted(v: np.ndarray, radius2: float) -> np.ndarray:
    v = v.astype(float)
    return np.hstack([v, np.sqrt(np.maximum(0, radius2 - (v**2).sum(1)))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T))


def search_block(q_ids, q, c_ids, c, pivots, radius2: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query, candidate, score) of one pair of blocks: each query's k best."""
    norms = np.sqrt((q.astype(float) ** 2).sum(1))
    radius = radius2**0.5
    stretched = q * (radius / np.where(norms > 0, norms, 1))[:, None]
    bare = np.hstack([stretched, np.zeros((len(q), 1))])
    to_q, to_c = distances(bare, pivots), distances(lifted(c, radius2), pivots).T.copy()
    share = norms / max(radius, 1e-300)
    slack = 1e-6 * share * radius2 + 1
    fq, fc = q.astype(float), c.astype(float)
    exact = float(np.abs(fq).max() * np.abs(fc).max()) * q.shape[1] < 2**52  # sums in doubles are then whole
    out = []
    for i in range(len(q)):
        low = np.abs(to_c[0] - to_q[i, 0])
        for p in range(1, len(pivots)):
            np.maximum(low, np.abs(to_c[p] - to_q[i, p]), out=low)
        bound = share[i] * (radius2 - low**2 / 2) + slack[i]
        order = np.argsort(-bound, kind="stable")
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, STEP
        while at < len(order):
            if len(ids) >= k and bound[order[at]] < scores[k - 1]:
                break
            part = order[at:at + step]
            at, step = at + step, step * 2
            part = part[c_ids[part] != q_ids[i]]
            got = (fc[part] @ fq[i]).astype(np.int64) if exact else c[part] @ q[i]
            ids, scores = np.append(ids, c_ids[part]), np.append(scores, got)
            best = np.lexsort([ids, -scores])[:k]
            ids, scores = ids[best], scores[best]
        out.append((np.full(len(ids), q_ids[i]), ids, scores))
    return tuple(np.concatenate(x) for x in zip(*out))


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE, pivots: int = PIVOTS, sample_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score for the queries (ids divisible by ``every``)."""
    rows = stored(scaled(vectors, scale), "vectors")
    is_query = F.col("vec_id") % every == 0
    largest = F.array_max(F.transform("v", lambda c: F.abs(c)))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    size = rows.agg(
        F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(norm2).alias("r2"),
        F.max(F.size("v")).alias("width"), F.max(largest).alias("largest"),
    ).first()
    result = "query_id long, vec_id long, score long"
    if not size["q"]:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if size["largest"] > MAX_COMPONENT:
        raise ValueError("a component is too large for whole-number scores")
    width, radius2 = size["width"], size["r2"]
    # The pivots' sample is bounded; which rows it holds changes speed only.
    sample = rows.orderBy(F.xxhash64("vec_id"), "v").limit(sample_rows).select("v").toArrow()
    table_pivots = far_apart(lifted(matrix(sample["v"], width), radius2), pivots)
    n_q, n_c = -(-size["q"] // QUERY_BLOCK), -(-size["n"] // CANDIDATE_BLOCK)
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where(is_query).select("vec_id", "v", block(n_q).alias("qb"), blocks(n_c).alias("cb"))
    candidates = rows.select("vec_id", "v", blocks(n_q).alias("qb"), block(n_c).alias("cb"))

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        empty = q.num_rows == 0 or c.num_rows == 0
        ids = lambda t: t["vec_id"].to_numpy()
        out = (np.zeros(0, np.int64),) * 3 if empty else search_block(
            ids(q), matrix(q["v"], width), ids(c), matrix(c["v"], width), table_pivots, radius2, k
        )
        return pa.table(dict(zip(("query_id", "vec_id", "score"), out)))

    keys = [F.col("qb").cast("long"), F.col("cb").cast("long")]
    best = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(run, result)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""


@query("op4_pivot_top_k", SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
