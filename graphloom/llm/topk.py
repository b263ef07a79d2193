"""Exact top-k inner products of integer vectors: norm-sorted blocks, rotated partial sums, residual bounds.

Candidates are sorted by falling length and packed into blocks; queries are packed into blocks too.
A pair of blocks meets in one task, where the blocks of a query block come in order of length. A block
is skipped when length times length can't reach any query's k-th best. Of the rest, inner products
over the leading rotated dimensions plus the product of the residual lengths (Cauchy-Schwarz) bound
every score, and only pairs whose bound reaches the k-th best are counted, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch, vectors

_EXACT = float(2**53)


def _ints(scale: float):
    return lambda x: np.floor(scale * x)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and b, exact: by doubles while no partial sum can pass 2^53, else by Python's integers."""
    if len(a) and len(b) and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= _EXACT:
        big = lambda m: np.array([[int(v) for v in r] for r in m], object)
        return big(a) @ big(b).T
    return a @ b.T


def _dense(x: np.ndarray) -> bytes:
    """Rows of whole numbers in two bytes for each where that is enough, else as doubles."""
    return (x.astype("<i2") if not x.size or np.abs(x).max() < 32768 else x.astype("<f8")).tobytes()


def _wide(raw, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if len(raw) == 2 * n * dim else "<f8").astype(float).reshape(n, dim)


def _pack(df: DataFrame, dim: int, scale: float, rows: int, name: str) -> DataFrame:
    """Blocks (number, length of the longest vector, ids, doubles) of df (id, vector) in the order it is in."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, n = [], [], 0

        def block():
            i, x = np.concatenate(ids), np.concatenate(xs)
            for at in range(0, len(i), rows):
                part = x[at : at + rows]
                yield pa.RecordBatch.from_pydict({"longest": [float(np.sqrt((part**2).sum(axis=1)).max())], "ids": [i[at : at + rows].tobytes()], "data": [_dense(part)]})

        for b in batches:
            x, _ = vectors.matrix(b.column(1), dim)
            ids.append(b.column(0).to_numpy().astype(np.int64))
            xs.append(np.floor(scale * x))
            n += len(x)
            if n >= rows:
                whole = n // rows * rows
                i, x = np.concatenate(ids), np.concatenate(xs)
                ids, xs = [i[:whole]], [x[:whole]]
                yield from block()
                ids, xs, n = [i[whole:]], [x[whole:]], n - whole
        if n:
            yield from block()

    return scratch.keep(df.mapInArrow(pack, "longest double, ids binary, data binary").withColumn("number", F.monotonically_increasing_id()), name)


def _pack_queries(df: DataFrame, dim: int, scale: float, groups: int) -> DataFrame:
    """A row (q_number, q_ids, q_data) for each of so many groups of queries (id, vector), dealt out by a hash of the id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, xs = None, [], []

        def block():
            return pa.RecordBatch.from_pydict({"q_number": pa.array([held], pa.int64()), "q_ids": [np.concatenate(ids).tobytes()], "q_data": [_dense(np.concatenate(xs))]})

        for b in batches:
            number = b.column(2).to_numpy()
            x = np.floor(scale * vectors.matrix(b.column(1), dim)[0])
            cuts = np.flatnonzero(np.diff(number)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(number)]):
                if lo == hi:
                    continue
                if held != number[lo] and ids:
                    yield block()
                    ids, xs = [], []
                held = int(number[lo])
                ids.append(b.column(0).to_numpy().astype(np.int64)[lo:hi])
                xs.append(x[lo:hi])
        if ids:
            yield block()

    dealt = df.withColumn("q_number", F.pmod(F.xxhash64("id"), F.lit(groups))).repartition("q_number").sortWithinPartitions("q_number", "id")
    return scratch.keep(dealt.select("id", "v", "q_number").mapInArrow(pack, "q_number long, q_ids binary, q_data binary"), "queries")


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -score))[:k]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, lead: int = 16, rows: int = 2048, query_rows: int = 512, lanes: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates but itself by integer inner product.

    Components become floor(scale * x). Ties go to the smaller id. Vectors that are null or hold null
    or non-finite components, and rows without id, take no part; a vector shorter than another counts
    as filled with zeros. Repeated rows count once each, as queries and as candidates: one candidate with
    a query's id and vector is the query's own row, others are not. Fewer than k candidates give fewer
    rows, none give none. lanes: tasks among which the blocks of one query block are dealt, each in order
    of length.
    """
    dim = max(vectors.dimension(candidates, vector_col), vectors.dimension(queries, vector_col))
    spark = candidates.sparkSession
    if dim == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    v = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    pick = lambda df: df.where(sound).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    axes = vectors.rotation(pick(candidates), "v", dim, _ints(scale))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.floor(F.lit(scale) * x).cast("double"), F.lit(2.0)))
    blocks = _pack(pick(candidates).orderBy(length.desc(), "id"), dim, scale, rows, "candidates")
    groups = max(1, -(-pick(queries).count() // query_rows))
    asked = _pack_queries(pick(queries), dim, scale, groups)
    # The longest vectors, one block of them, give every query its first bound.
    head = blocks.orderBy(F.col("longest").desc(), "number").limit(1).collect()
    if not head:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    head_ids, head_x = np.frombuffer(head[0].ids, np.int64), _wide(head[0].data, len(head[0].ids) // 8, dim)
    lead = min(lead, dim)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, q_ids, q, q_lead, q_rest, q_len, best, floor, twins = [None] * 9

        def flush():
            # A twin has its query's id and vector; of all twins found anywhere one is the query itself.
            found = [(i, int(q_ids[i]), int(b), int(s), False) for i, (ids, scores) in enumerate(best) for b, s in zip(ids, scores)]
            found += [(i, int(q_ids[i]), int(q_ids[i]), score, True) for i, (n, score) in twins.items() for _ in range(min(n, k + 1))]
            if found:
                place, *rest, twin = zip(*found)
                arrays = [pa.array([held] * len(found), pa.int64()), pa.array(place, pa.int32()), *(pa.array(x, pa.int64()) for x in rest), pa.array(twin)]
                yield pa.RecordBatch.from_arrays(arrays, names=["q_number", "place", "query_id", "vec_id", "score", "twin"])

        for b in batches:
            for row in range(b.num_rows):
                number, longest = b.column("q_number")[row].as_py(), b.column("longest")[row].as_py()
                raw = {c: b.column(c)[row].as_py() for c in ("q_ids", "q_data", "ids", "data") if number != held or c in ("ids", "data")}
                if number != held:
                    if held is not None:
                        yield from flush()
                    held, q_ids, twins = number, np.frombuffer(raw["q_ids"], np.int64), {}
                    q = _wide(raw["q_data"], len(q_ids), dim)
                    turned = q @ axes
                    q_lead, q_rest, q_len = turned[:, :lead], np.sqrt((turned[:, lead:] ** 2).sum(axis=1)), np.sqrt((q**2).sum(axis=1))
                    best = [(np.empty(0, np.int64), np.empty(0, object)) for _ in q_ids]
                    first = _dot(q, head_x)
                    floor = np.full(len(q), -np.inf)
                    for i, query_id in enumerate(q_ids):
                        others = np.sort(first[i][head_ids != query_id])
                        if len(others) >= k:
                            floor[i] = float(others[-k])
                # Bounds are sums of doubles: a little slack keeps them bounds.
                slack = 1e-9 * (q_len * longest + 1)
                live = np.flatnonzero(q_len * longest + slack >= floor)
                ids = np.frombuffer(raw["ids"], np.int64)
                own = np.isin(q_ids, ids)
                if not len(live) and not own.any():
                    continue
                x = _wide(raw["data"], len(ids), dim)
                for i in np.flatnonzero(own):
                    same = np.flatnonzero(ids == q_ids[i])
                    if n := int((x[same] == q[i]).all(axis=1).sum()):
                        twins[int(i)] = (twins.get(int(i), (0, 0))[0] + n, int(_dot(q[i : i + 1], q[i : i + 1])[0][0]))
                turned = x @ axes
                bound = q_lead[live] @ turned[:, :lead].T + np.outer(q_rest[live], np.sqrt((turned[:, lead:] ** 2).sum(axis=1)))
                may = bound + slack[live, None] >= floor[live, None]
                for i, row_may in zip(live, may):
                    at = np.flatnonzero(row_may)
                    if own[i]:
                        at = at[(ids[at] != q_ids[i]) | (x[at] != q[i]).any(axis=1)]
                    if not len(at):
                        continue
                    score = _dot(q[i : i + 1], x[at])[0]
                    all_ids, all_scores = np.concatenate([best[i][0], ids[at]]), np.concatenate([best[i][1], score.astype(object)])
                    top = _best(all_scores.astype(float) if score.dtype != object else all_scores, all_ids, k)
                    best[i] = (all_ids[top], all_scores[top])
                    if len(top) == k:
                        floor[i] = max(floor[i], float(all_scores[top[-1]]))
        if held is not None:
            yield from flush()

    # Pairs of blocks: each candidate block goes to every group of queries, of which there are few.
    pairs = blocks.withColumn("lane", F.pmod(F.xxhash64("number"), F.lit(lanes))).withColumn("q_number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    pairs = pairs.join(asked, "q_number")
    ordered = pairs.repartition("q_number", "lane").sortWithinPartitions("q_number", "lane", F.col("longest").desc())
    found = ordered.select("q_number", "q_ids", "q_data", "ids", "data", "longest").mapInArrow(meet, "q_number long, place int, query_id long, vec_id long, score long, twin boolean")
    query = ["q_number", "place"]
    of_twins = F.row_number().over(W.partitionBy(*query, "twin").orderBy(F.col("score").desc(), "vec_id"))
    others = found.withColumn("n", of_twins).where((~F.col("twin") & (F.col("n") <= k)) | (F.col("twin") & (F.col("n") > 1)))
    rank = F.row_number().over(W.partitionBy(*query).orderBy(F.col("score").desc(), "vec_id"))
    return others.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
