"""Embedding near-dedup by an epsilon grid order join.

Vectors of length 1 whose cosine is c lie sqrt(2 - 2c) apart, which is epsilon. They are rotated onto
their principal axes and sorted by the cells of a grid with sides epsilon on the leading ones. The
sorted sequence is cut into blocks; two blocks meet only if their boxes (in all dimensions) come within
epsilon of each other. A meeting splits both sequences again and again, leaving out provably distant
halves, until the parts are small, and there counts cosines in double precision.

Equal vectors are one, with their number: copies never meet each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, vectors
from .components import connected
from .ngram_join import _forest

BLOCK = 1024
#: Consecutive blocks that go to a task together; a tile is two such groups, of which each block is sent once.
GROUP = 3
#: Parts up to this size are not split further.
LEAF = 128
#: Cosines this near the bound are added again.
CLOSE = 1e-12


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows by their length; scaled by the largest component first, so that no square over- or underflows."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    return x / np.where(top > 0, np.sqrt((x**2).sum(axis=1, keepdims=True)), 1)


def _meet(x: np.ndarray, y: np.ndarray, tx: np.ndarray, ty: np.ndarray, eps: float, bound: float, at: tuple[int, int], same: bool, out: list) -> None:
    """Adds (i, j) of all pairs with cosine >= bound to out. tx, ty: x and y on the principal axes."""
    gap = np.maximum(0, np.maximum(tx.min(axis=0) - ty.max(axis=0), ty.min(axis=0) - tx.max(axis=0)))
    if gap @ gap > eps * eps + 1e-9:
        return
    if max(len(x), len(y)) <= LEAF:
        found = x @ y.T
        i, j = np.nonzero(found >= bound - CLOSE)
        if same:
            i, j = i[i < j], j[i < j]
        # A matrix product adds in an order of its own; at the bound the sum is taken exactly.
        sure = found[i, j] >= bound + CLOSE
        for k in np.flatnonzero(~sure).tolist():
            sure[k] = math.fsum(x[i[k]] * y[j[k]]) >= bound
        i, j = i[sure], j[sure]
        if len(i):
            out.append(np.stack([i + at[0], j + at[1]], axis=1))
        return
    cut = lambda v: [(0, len(v))] if len(v) <= LEAF else [(0, len(v) // 2), (len(v) // 2, len(v))]
    for p, q in cut(x):
        for r, s in cut(y):
            if same and p > r:
                continue
            _meet(x[p:q], y[r:s], tx[p:q], ty[r:s], eps, bound, (at[0] + p, at[1] + r), same and p == r, out)


def near_components(vectors_df: DataFrame, least_cosine: float = 0.95, axes_used: int = 6, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    n_links: other rows with cosine >= least_cosine; component_id: the smallest id reachable by such
    links, itself included; kept: whether that is the row's own. Vectors that are null, zero, or hold
    null or non-finite components link with nothing. A vector shorter than another counts as filled
    with zeros. Repeated rows are rows of their own, linked with each other. Rows without id link with
    nothing and have a null component. Empty tables give none. Other columns are left out.
    """
    # Components in single precision travel as such.
    kind = np.float32 if dict(vectors_df.dtypes)[vector_col] == "array<float>" else np.float64
    v = F.col(vector_col).cast("array<double>")
    rows = vectors_df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    dim = vectors.dimension(rows, "v")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    # -0 and 0, and zeros at the end, are no difference.
    full = F.transform(F.concat("v", F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(dim) - F.size("v")))), lambda x: x + F.lit(0.0))
    keyed = rows.select("id", "v", F.when(sound, F.xxhash64(full)).alias("sig"))
    members = scratch.keep(keyed.select("id", "sig"), "members")
    if dim == 0:
        return members.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    classes = scratch.keep(keyed.where("sig is not null").groupBy("sig").agg(F.count("*").alias("times"), F.min("id").alias("least_id"), F.first("v").alias("v")), "classes")
    axes = vectors.rotation(classes, "v", dim, _unit)
    eps = float(np.sqrt(max(0.0, 2 - 2 * least_cosine)))
    used = min(axes_used, dim)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _ = vectors.matrix(b.column("v"), dim)
            grid = np.floor(_unit(x) @ axes[:, :used] / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("sig"), b.column("times"), b.column("v"), *[pa.array(grid[:, i]) for i in range(used)]], names=["sig", "times", "v", *[f"c{i}" for i in range(used)]])

    grid = classes.select("sig", "times", "v").mapInArrow(cells, "sig long, times long, v array<double>, " + ", ".join(f"c{i} int" for i in range(used)))
    ordered = grid.orderBy(*[f"c{i}" for i in range(used)], "sig").select("sig", "times", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def block(sig, times, x):
            t = _unit(x) @ axes
            return pa.RecordBatch.from_pydict({"low": [t.min(axis=0).tobytes()], "high": [t.max(axis=0).tobytes()], "sigs": [sig.tobytes()], "times": [times.tobytes()], "data": [x.astype(kind).tobytes()]})

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), vectors.matrix(b.column(2), dim)[0]))
            if sum(len(h[0]) for h in held) >= BLOCK:
                sig, times, x = (np.concatenate(p) for p in zip(*held))
                whole = len(sig) // BLOCK * BLOCK
                for at in range(0, whole, BLOCK):
                    yield block(*(p[at : at + BLOCK] for p in (sig, times, x)))
                held = [tuple(p[whole:] for p in (sig, times, x))]
        if held and sum(len(h[0]) for h in held):
            yield block(*(np.concatenate(p) for p in zip(*held)))

    packed = ordered.mapInArrow(pack, "low binary, high binary, sigs binary, times binary, data binary").withColumn("block", F.monotonically_increasing_id())
    blocks = scratch.keep(packed, "blocks")

    # Which blocks meet is settled on the boxes alone, cell by cell of the first axis, before any vector moves.
    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = [int(np.floor(np.frombuffer(x)[0] / eps)) if eps else 0 for x in b.column("low").to_pylist()]
            hi = [int(np.floor(np.frombuffer(x)[0] / eps)) if eps else 0 for x in b.column("high").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("low"), b.column("high"), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["block", "low", "high", "first_cell", "last_cell"])

    boxes = scratch.keep(blocks.select("block", "low", "high").mapInArrow(span, "block long, low binary, high binary, first_cell int, last_cell int"), "boxes")
    own = boxes.select(F.col("block").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.col("first_cell").alias("first_a"), F.explode(F.sequence("first_cell", "last_cell")).alias("cell"))
    near = boxes.select(F.col("block").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.col("first_cell").alias("first_b"), F.explode(F.sequence(F.col("first_cell") - 1, F.col("last_cell") + 1)).alias("cell"))
    # Of the cells that bring two blocks together, the first counts.
    together = own.join(near, "cell").where("a <= b and cell = greatest(first_a, first_b - 1)")

    def within_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            box = [np.array([np.frombuffer(x) for x in b.column(c).to_pylist()]).reshape(b.num_rows, dim) for c in ("low_a", "high_a", "low_b", "high_b")]
            gap = np.maximum(0, np.maximum(box[0] - box[3], box[2] - box[1]))
            yield b.select(["a", "b"]).filter(pa.array((gap**2).sum(axis=1) <= eps * eps + 1e-9))

    meetings = scratch.keep(together.mapInArrow(within_reach, "a long, b long"), "meetings")
    # Of a tile (two groups of blocks) every block that meets another there is sent once, the first group ahead.
    group = lambda c: F.shiftright(c, GROUP)
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("block")), F.struct(F.lit(1).alias("side"), F.col("b").alias("block")))
    members_of = meetings.select(group("a").alias("ta"), group("b").alias("tb"), F.explode(sides).alias("m")).select("ta", "tb", "m.side", "m.block").distinct()
    dealt = members_of.join(blocks.select("block", "sigs", "times", "data"), "block").repartition("ta", "tb").sortWithinPartitions("ta", "tb", "side", "block")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, first = None, []
        for b in batches:
            for i in range(b.num_rows):
                ta, tb, last, number, sigs, times, data = (b.column(c)[i].as_py() for c in ("ta", "tb", "side", "block", "sigs", "times", "data"))
                if (ta, tb) != tile:
                    tile, first = (ta, tb), []
                x = _unit(np.frombuffer(data, kind).astype(float).reshape(-1, dim))
                block = (number, x, x @ axes, np.frombuffer(sigs, np.int64), np.frombuffer(times, np.int64))
                if not last:
                    first.append(block)
                    continue
                # Of each vector the number of links found here; of the links a spanning forest.
                count: dict[int, int] = {}
                links: list = []
                for other in first:
                    if other[0] > number:
                        continue
                    out: list = []
                    _meet(other[1], block[1], other[2], block[2], eps, least_cosine, (0, 0), other[0] == number, out)
                    if not out:
                        continue
                    p, q = np.concatenate(out).T
                    for one, two, mine, theirs in ((other, block, p, q), (block, other, q, p)):
                        total = np.bincount(mine, weights=two[4][theirs], minlength=len(one[3])).astype(np.int64)
                        for k in np.flatnonzero(total).tolist():
                            sig = int(one[3][k])
                            count[sig] = count.get(sig, 0) + int(total[k])
                    links = list(_forest([*links, *zip(other[3][p].tolist(), block[3][q].tolist())]))
                if count:
                    m, n = len(count), len(links)
                    yield pa.RecordBatch.from_arrays([pa.array([*count, *[f[0] for f in links]], pa.int64()), pa.array([None] * m + [f[1] for f in links], pa.int64()), pa.array([*count.values(), *[None] * n], pa.int64())], names=["sig", "other", "n"])

    found = scratch.keep(dealt.mapInArrow(join, "sig long, other long, n long"), "found")
    counts = found.where("n is not null").groupBy("sig").agg(F.sum("n").alias("n"))
    components = connected(found.where("other is not null"), "sig", "other").select(F.col("node").alias("sig"), "component")
    known = classes.select("sig", "times", "least_id").join(counts, "sig", "left").join(components, "sig", "left")
    known = scratch.keep(known.select("sig", "least_id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "sig").alias("component")), "known")
    roots = scratch.keep(known.groupBy("component").agg(F.min("least_id").alias("component_id")), "roots")
    by_sig = scratch.keep(known.join(roots, "component").select("sig", "n_links", "component_id"), "by_sig")
    out = members.join(by_sig, "sig", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
