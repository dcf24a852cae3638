"""Maximum inner product search with score-aware quantisation.

* Fit (a sample of ``FIT_ROWS`` vectors by hash order): the space is cut into pairs
  of dimensions with 16 centroids each. Loss is anisotropic: the part of a residual
  that is parallel to its vector changes inner products with the queries that matter
  and weighs ``ETA`` times the orthogonal part. Codes are chosen by coordinate descent
  on that loss, centroids by the weighted least squares it implies.
* Scan: two four-bit codes share a byte, and a query has a table of 256 sums for each
  byte; a block's scores are one table look-up a byte.
* Rerank: the best ``RERANK`` of each block are scored exactly in double precision.

Equal vectors are one class with its ``k + 1`` least ids (no answer needs more), so a
vector that a third of all rows share costs as much as any other. Classes are dealt to
blocks by hash; the stated queries, also in blocks, meet every block, and are shipped once to
each group of ``GROUP`` blocks. What a block returns is at most ``k + 1`` classes a query.

Coarse cells that a query probes a few of would save scans only where vectors lie in
clusters; README has measured figures of why all blocks are scanned.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and vectors of another length than the most frequent one, take no part; ids that are null
take no part; rows that repeat id and vector count once; fewer candidates than k give all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactspark.llm.common import materialise, table

FIT_ROWS = 8_192
ETA = 4.0
CENTROIDS, PAIR = 16, 2
ROUNDS = 8
BLOCK = 4_096
QUERY_BLOCK = 256
#: Blocks that one copy of the queries serves.
GROUP = 16
RERANK = 128


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def encode(x: np.ndarray, books: np.ndarray, codes: np.ndarray | None = None, eta: float = ETA, passes: int = 2) -> np.ndarray:
    """Codes (rows x subspaces): coordinate descent on |r|^2 + (eta - 1) (r.u)^2, r the residual, u the vector's direction."""
    n, m = len(x), len(books)
    parts = x.reshape(n, m, -1)
    units = _units(x).reshape(n, m, -1)
    if codes is None:
        codes = np.stack([((parts[:, s, None, :] - books[s][None]) ** 2).sum(2).argmin(1) for s in range(m)], 1)
    along = np.stack([((parts[:, s] - books[s][codes[:, s]]) * units[:, s]).sum(1) for s in range(m)], 1)
    total = along.sum(1)
    for _ in range(passes):
        for s in range(m):
            left = parts[:, s, None, :] - books[s][None]
            near = (left * units[:, s, None, :]).sum(2)
            rest = total - along[:, s]
            codes[:, s] = ((left**2).sum(2) + (eta - 1) * (rest[:, None] + near) ** 2).argmin(1)
            along[:, s] = near[np.arange(n), codes[:, s]]
            total = rest + along[:, s]
    return codes.astype(np.uint8)


def fit(x: np.ndarray, eta: float = ETA, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids (subspaces x 16 x 2) of a sample."""
    n, d = x.shape
    m = d // PAIR
    parts, units = x.reshape(n, m, PAIR), _units(x).reshape(n, m, PAIR)
    rng = np.random.default_rng(11)
    books = np.stack([parts[rng.integers(0, n, CENTROIDS), s] for s in range(m)]).astype(np.float64)
    codes = None
    for _ in range(rounds):
        codes = encode(x, books, codes, eta).astype(np.int64)
        residual = parts - books[np.arange(m)[None], codes]
        along = (residual * units).sum(2)
        total = along.sum(1)
        for s in range(m):
            for c in range(CENTROIDS):
                own = codes[:, s] == c
                if not own.any():
                    books[s, c] = parts[rng.integers(0, n), s]
                    continue
                u, p = units[own, s], parts[own, s]
                target = (total[own] - along[own, s]) + (p * u).sum(1)
                left = own.sum() * np.eye(PAIR) + (eta - 1) * u.T @ u
                books[s, c] = np.linalg.solve(left, p.sum(0) + (eta - 1) * u.T @ target)
    return books


def tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(queries x bytes x 256): for each byte of two codes, the sum of both parts' inner products."""
    m = len(books)
    one = np.einsum("qmp,mcp->qmc", queries.reshape(len(queries), m, PAIR), books)
    if m % 2:
        one = np.concatenate([one, np.zeros((len(queries), 1, CENTROIDS))], 1)
    return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(queries), -1, 256).astype(np.float32)


def packed(codes: np.ndarray) -> np.ndarray:
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
    return (codes[:, 0::2] << 4) | codes[:, 1::2]


def scan(queries: np.ndarray, look_up: np.ndarray, codes: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, rerank: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the best k rows of a block: (query, rows, exact scores), by score and then id."""
    rough = np.zeros((len(queries), len(codes)), np.float32)
    for b in range(codes.shape[1]):
        rough += look_up[:, b, :][:, codes[:, b]]
    for q in range(len(queries)):
        rows = np.arange(len(codes)) if len(codes) <= rerank else np.argpartition(-rough[q], rerank - 1)[:rerank]
        products = vectors[rows] * queries[q]
        near = products.sum(1)
        if len(rows) > k:  # rounding can't lift what is further behind than this
            slack = 1e-12 * float(np.abs(products).sum(1).max())
            keep = near >= np.partition(near, -k)[-k] - slack
            rows, products = rows[keep], products[keep]
        # One product at a time, summed exactly: equal vectors and any order of rows give the same bits.
        exact = np.array([math.fsum(p) for p in products])
        best = np.lexsort((ids[rows], -exact))[:k]
        yield q, rows[best], exact[best]


def _clean(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) with vectors that can take part."""
    v = F.col(vector_col).cast("array<double>")
    good = F.expr("id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x != 0)")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(good)
    return rows.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))


def search(rows: DataFrame, query: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row that ``query`` (SQL over ``id``) selects."""
    spark = rows.sparkSession
    good = materialise(_clean(rows, id_col, vector_col).distinct(), "ann-good")
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], out_schema)
    d = sizes[0]["d"]
    good = good.where(F.size("v") == d)
    least = good.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = materialise(classes.select(F.col("ids")[0].alias("class"), "ids", "v"), "ann-classes")
    count = classes.count()
    n_blocks = max(1, -(-count // BLOCK))
    wide = -(-d // PAIR) * PAIR

    def matrix(lists: list) -> np.ndarray:
        x = np.zeros((len(lists), wide))
        x[:, :d] = np.array(lists, np.float64).reshape(len(lists), d)
        return x

    sample = classes.select("v", F.xxhash64("class").alias("h"), "class").orderBy("h", "class").limit(FIT_ROWS).select("v").toArrow()
    books = fit(matrix(sample.column("v").to_pylist()))

    def pack_block(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("class")
        x = matrix(part["v"].tolist())
        return pd.DataFrame({"block": [part["block"].iloc[0]], "ids": [part["class"].to_numpy("<i8").tobytes()], "codes": [packed(encode(x, books)).tobytes()], "vectors": [x.tobytes()]})

    dealt = classes.select("class", "v", F.pmod(F.xxhash64("class", F.lit(3)), F.lit(n_blocks)).cast("int").alias("block"))
    blocks = materialise(dealt.groupBy("block").applyInPandas(pack_block, "block int, ids binary, codes binary, vectors binary"), "ann-blocks")

    asked = good.where(query)
    ask = asked.select("v").distinct().withColumn("q", F.xxhash64("v"))
    ask = materialise(ask.join(classes.select("v", "class"), "v").select("class", "v"), "ann-queries")
    n_asked = max(1, -(-ask.count() // QUERY_BLOCK))

    def pack_queries(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [part["part"].iloc[0]], "asked": [part["class"].to_numpy("<i8").tobytes()], "queries": [matrix(part["v"].tolist()).tobytes()]})

    ask = ask.withColumn("part", F.pmod(F.xxhash64("class", F.lit(5)), F.lit(n_asked)).cast("int"))
    ask = ask.groupBy("part").applyInPandas(pack_queries, "part int, asked binary, queries binary")
    # Queries go once to each group of blocks, not to each block.
    n_groups = min(n_blocks, max(spark.sparkContext.defaultParallelism, -(-n_blocks // GROUP)))
    grouped = blocks.withColumn("group", F.col("block") % n_groups)
    meet = ask.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).join(grouped, "group")
    schema = pa.schema([("asked", pa.int64()), ("class", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked_, queries, ids, codes, vectors in zip(*[batch.column(c) for c in ("asked", "queries", "ids", "codes", "vectors")]):
                who, of = (np.frombuffer(x.as_py(), "<i8") for x in (asked_, ids))
                q, x = (np.frombuffer(y.as_py()).reshape(-1, wide) for y in (queries, vectors))
                code = np.frombuffer(codes.as_py(), np.uint8).reshape(len(of), -1)
                found = [*scan(q, tables(q, books), code, x, of, k + 1, rerank)]
                made = [np.repeat(who, [len(r) for _, r, _ in found]), of[np.concatenate([r for _, r, _ in found])], np.concatenate([s for _, _, s in found])]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in made], schema=schema)

    met = meet.select("asked", "queries", "ids", "codes", "vectors").mapInArrow(run, "asked long, class long, score double")
    best = met.withColumn("n", F.row_number().over(W.partitionBy("asked").orderBy(F.desc("score"), "class"))).where(F.col("n") <= k + 1)
    members = best.join(classes.select("class", "ids"), "class").select("asked", "score", F.explode("ids").alias("id"))
    near = members.withColumn("n", F.row_number().over(W.partitionBy("asked").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1)
    lists = near.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id")))).alias("found"))
    of_class = asked.join(classes.select("v", F.col("class").alias("asked")), "v").select(F.col("id").alias("query_id"), "asked")
    out = of_class.join(lists, "asked").select("query_id", F.expr(f"slice(filter(found, x -> x.id != query_id), 1, {k})").alias("found"))
    out = out.select("query_id", F.posexplode("found"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("vec_id"), (-F.col("col.s")).alias("score"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every row of ``embeddings`` whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), "id % 20 = 0")
