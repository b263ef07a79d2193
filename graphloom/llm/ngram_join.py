"""N-gram Jaccard join by vertical partitioning of a global order of n-grams.

A text's set holds the hashes of its distinct runs of five words. The global order puts n-grams that
fall into heavy counters of a corpus-wide sketch last, and others by hash. The prefix of a set is the first
third of it in this order. The prefixes of two sets that reach the threshold share a tenth of either set or
more. The order is cut into fragments by hash; each fragment counts by itself how many prefix n-grams every
pair of sets shares there, and how far down the last of them stands. The partial overlaps are summed for
each pair, and a pair goes on only if they, the lengths and the places leave room for the threshold.

* Equal sets are one: copies never travel, whatever their number.
* N-grams with many holders give ties instead of pairs: each holder is tied to the n-gram. A pair that
  shares such n-grams alone has a tenth of each of its sets among them; ties of other sets are left out,
  and a pair's partial overlap may be greater by the ties of its sets. So no linked pair can fall apart.
* Pairs and ties make families. Inside a family the overlaps of whole sets are counted exactly, again
  slice by slice of the order and summed, in blocks of similar length; only a spanning forest of the links
  leaves a block, so a family's pairs are never rows.

N-grams are 64-bit hashes: a false match would have to fall into one and the same pair of sets. Sets are
told apart by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch, wordhash
from .components import connected

#: Counters of the sketch that finds frequent n-grams; any number gives the same result.
WIDTH = 1 << 20
_SLICES = 16
#: Up to so many holders an n-gram gives pairs, beyond that ties.
PAIRS_UP_TO = 128
#: So many holders of a frequent n-gram in one portion of text are tied there.
TIED_HERE = 32
#: Sets, and n-grams, of a block in which overlaps are counted.
BLOCK = 256
BLOCK_GRAMS = 1 << 18


def sets_of(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, size of each set): distinct k-word shingles of each text, ascending; under k words the whole sequence as one."""
    words, count = wordhash.words_of(texts, lower=True)
    first = np.cumsum(count) - count
    grams = wordhash.runs_of(words, k)
    n = np.maximum(count - k + 1, 0)
    short = (count > 0) & (count < k)
    owner = np.repeat(np.arange(len(count)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    h = np.concatenate([grams[at], wordhash.span_hash(words, first[short], (first + count)[short]) ^ np.uint64(k)])
    owner = np.concatenate([owner, np.flatnonzero(short)])
    by = np.lexsort((h, owner))
    h, owner = h[by], owner[by]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.empty(0, bool)
    return h[fresh], np.bincount(owner[fresh], minlength=len(count)).astype(np.int64)


def _signatures(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each whole set."""
    end, n = np.cumsum(size), size.astype(np.uint64)

    def one(salt: int) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wordhash.mix(h ^ np.uint64(salt)), dtype=np.uint64)])
        return wordhash.mix(total[end] - total[end - size] + n)

    return one(0x5851F42D4C957F2D), one(0xD1342543DE82EF95)


def need(nx, ny, num: int, den: int):
    """The least overlap with which sets of these sizes reach num / den."""
    return -(-num * (nx + ny) // (num + den))


def rest(n, num: int, den: int):
    """How many n-grams of a set lie beyond its prefix: under 13/15 of what the threshold asks of it."""
    return -(-n * num * 13 // (den * 15)) - 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % WIDTH


def _facts(docs: DataFrame, k: int) -> DataFrame:
    """Of each document id, n, sig, sig2; and the sketch's counters, one row for each slice and partition."""
    names = ["id", "n", "sig", "sig2", "slice", "counters"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(WIDTH, np.int64)
        for batch in batches:
            for b in wordhash.portions(batch, 1):
                h, size = sets_of(b.column(1), k)
                at, times = np.unique(_counter(h), return_counts=True)
                counters[at] += times
                m = len(size)
                yield pa.RecordBatch.from_arrays([b.column(0), _signed(size), *map(_signed, _signatures(h, size)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        if counters.any():
            parts = np.minimum(counters, 2**32 - 1).astype(np.uint32).reshape(_SLICES, -1)
            none = pa.nulls(_SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([none] * 4 + [pa.array(range(_SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    return scratch.keep(docs.mapInArrow(scan, "id long, n long, sig long, sig2 long, slice int, counters binary"), "facts")


def _heavy(facts: DataFrame) -> np.ndarray:
    """Which counters of the sketch are heavy, over all documents. Of fixed size, so it may reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        give = lambda: pa.RecordBatch.from_pydict({"slice": pa.array([held], pa.int32()), "total": [total.tobytes()]})
        for b in batches:
            for at, raw in zip(b.column(0).to_pylist(), b.column(1)):
                if at != held:
                    if held is not None:
                        yield give()
                    held, total = at, np.zeros(WIDTH // _SLICES, np.int64)
                total += np.frombuffer(raw.as_buffer(), np.uint32)
        if held is not None:
            yield give()

    counters = facts.where("slice is not null").select("slice", "counters").repartition(_SLICES, "slice").sortWithinPartitions("slice")
    rows = counters.mapInArrow(add, "slice int, total binary").collect()
    total = np.zeros((_SLICES, WIDTH // _SLICES), np.int64)
    for r in rows:
        total[r.slice] = np.frombuffer(r.total, np.int64)
    total = total.ravel()
    mean = total.mean()
    return total > mean + 8 * np.sqrt(mean) + 32


def _starts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


_POSTING = "gram long, sig long, n int, place int, other long"


def _postings(docs: DataFrame, heavy: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """Postings of the prefix of every set; a set that a partition has met before is left out.

    A row with a gram tells that a set holds it, at a place of its order (-1: the holder stands for others
    that are tied already). A row without one ties sig to the n-gram in other.
    """
    packed = np.packbits(heavy)
    names = [x.split()[0] for x in _POSTING.split(", ")]

    def batch(gram, sig, n, place) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_signed(gram), _signed(sig), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32)), pa.nulls(len(gram), pa.int64())], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.unpackbits(packed).astype(bool)
        met: set[int] = set()
        for whole in batches:
            for b in wordhash.portions(whole, 0):
                h, size = sets_of(b.column(0), k)
                sig, sig2 = _signatures(h, size)
                new = np.array([s not in met and not met.add(s) and n > 0 for s, n in zip((sig ^ sig2).tolist(), size.tolist())], bool)
                owner = np.repeat(np.arange(len(size)), size)
                late = last[_counter(h)]
                by = np.lexsort((h, late, owner))
                h, owner, late = h[by], owner[by], late[by]
                place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
                n = size[owner]
                pick = new[owner] & (place < n - rest(n, num, den))
                h, owner, late, place, n = h[pick], owner[pick], late[pick], place[pick], n[pick]
                # Frequent n-grams with many holders right here.
                at = np.flatnonzero(late)
                at = at[np.lexsort((place[at], h[at]))]
                start = _starts(h[at])
                times = np.diff(np.append(start, len(at)))
                tied = at[np.repeat(times >= TIED_HERE, times)]
                if len(tied):
                    none = pa.nulls(len(tied), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, _signed(sig[owner[tied]]), pa.array(n[tied].astype(np.int32)), none.cast(pa.int32()), _signed(h[tied])], names=names)
                    stays = np.ones(len(h), bool)
                    stays[tied] = False
                    first = at[start[times >= TIED_HERE]]
                    stays[first], place[first] = True, -1
                    h, owner, place, n = h[stays], owner[stays], place[stays], n[stays]
                yield batch(h, sig[owner], n, place)

    return docs.select("text").mapInArrow(scan, _POSTING)


def _candidates(postings: DataFrame, num: int, den: int) -> DataFrame:
    """Partial overlaps by fragment: (a, b, shared, na, nb, pa, pb) of pairs, and ties (n-gram a, set b, its size nb) with the rest null.

    shared: prefix n-grams of this fragment that both hold; pa, pb: the place of the last of them.
    """
    kind = "a long, b long, shared int, na int, nb int, pa int, pb int"
    names = [x.split()[0] for x in kind.split(", ")]

    def pairs_of(gram, sig, n, place) -> np.ndarray:
        """(a, b, na, nb, pa, pb) of all pairs of holders of each n-gram whose lengths allow a link."""
        start = _starts(gram)
        rank = np.arange(len(gram)) - np.repeat(start, np.diff(np.append(start, len(gram))))
        b = np.repeat(np.arange(len(gram)), rank)
        a = b - 1 - (np.arange(len(b)) - np.repeat(np.cumsum(rank) - rank, rank))
        ok = den * np.minimum(n[a], n[b]).astype(np.int64) >= num * np.maximum(n[a], n[b]).astype(np.int64)
        a, b = a[ok], b[ok]
        # Holders of an n-gram come in order of their signatures.
        return np.stack([sig[a], sig[b], n[a], n[b], place[a], place[b]])

    def summed(found: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(found, axis=1)
        x = x[:, np.lexsort((x[1], x[0]))]
        start = np.flatnonzero(np.concatenate([[True], (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])])) if x.shape[1] else np.empty(0, np.int64)
        shared = np.diff(np.append(start, x.shape[1]))
        most = [np.maximum.reduceat(x[i], start) if len(start) else x[i] for i in (4, 5)]
        small = [shared, x[2][start], x[3][start], *most]
        return pa.RecordBatch.from_arrays([pa.array(x[0][start]), pa.array(x[1][start]), *[pa.array(v.astype(np.int32)) for v in small]], names=names)

    def tied(ties: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(ties, axis=1)
        none = pa.nulls(x.shape[1], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1]), none, none, pa.array(x[2].astype(np.int32)), none, none], names=names)

    def fragment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4
        many_of = None  # an n-gram of many holders that is under way
        found, ties, n_found = [], [], 0

        def whole(x: list[np.ndarray]) -> None:
            """Takes n-grams of which all holders are there."""
            nonlocal n_found
            start = _starts(x[0])
            times = np.diff(np.append(start, len(x[0])))
            many = np.repeat((times > PAIRS_UP_TO) | (x[3][start] < 0), times)
            ties.append(np.stack([v[many] for v in x[:3]]))
            got = pairs_of(*(v[~many] for v in x))
            found.append(got)
            n_found += got.shape[1]

        for b in batches:
            if b.column("gram").null_count:
                own = b.filter(b.column("gram").is_null())
                ties.append(np.stack([own.column(c).to_numpy().astype(np.int64) for c in ("other", "sig", "n")]))
                b = b.filter(b.column("gram").is_valid())
            x = [np.concatenate([o, b.column(c).to_numpy().astype(np.int64)]) for o, c in zip(held, ("gram", "sig", "n", "place"))]
            fresh = np.concatenate([[True], (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])]) if len(x[0]) else np.empty(0, bool)
            x = [v[fresh] for v in x]
            if many_of is not None and (same := x[0] == many_of).any():
                ties.append(np.stack([v[same] for v in x[:3]]))
                x = [v[~same] for v in x]
            held = x
            if len(x[0]):
                tail = x[0] == x[0][-1]
                held = [v[tail] for v in x]
                whole([v[~tail] for v in x])
                if tail.sum() > PAIRS_UP_TO or held[3][0] < 0:
                    many_of = held[0][0]
                    ties.append(np.stack(held[:3]))
                    held = [v[:0] for v in held]
            if n_found > 300_000:
                yield summed(found)
                found, n_found = [], 0
            if ties:
                yield tied(ties)
                ties = []
        whole(held)
        yield summed(found)
        yield tied(ties)

    dealt = postings.repartition(F.coalesce("gram", "sig")).sortWithinPartitions("gram", F.col("place") >= 0, "sig")
    return scratch.keep(dealt.mapInArrow(fragment, kind), "candidates")


def _edges(candidates: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs whose summed partial overlaps leave room for the threshold, and sets tied to n-grams that may link by these alone.

    What two sets share beyond the last n-gram that their prefixes share is at most what is left of
    either; and of the set whose prefix ends first, only what lies beyond that prefix is not yet counted.
    """
    pairs = candidates.where("shared is not null").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    ties = scratch.keep(candidates.where("shared is null").select("a", "b", F.col("nb").alias("n")).distinct(), "ties")
    tied = scratch.keep(ties.groupBy("b").agg(F.count("*").alias("ties"), F.max("n").alias("n")), "tied")
    for c in "ab":
        pairs = pairs.join(tied.select(F.col("b").alias(c), F.col("ties").alias(f"ties_{c}")), c, "left")
    beyond = lambda c: F.ceil(F.col(c) * (num * 13) / F.lit(den * 15)) - 1
    room = F.least(F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1, F.greatest(beyond("na"), beyond("nb")))
    more = F.least(F.coalesce("ties_a", F.lit(0)), F.coalesce("ties_b", F.lit(0)))
    wanted = F.ceil((F.col("na") + F.col("nb")) * num / F.lit(num + den))
    alone = tied.where(F.col("ties") * (den * 15) >= F.col("n") * (num * 2)).select("b")
    return pairs.where(F.col("shared") + more + room >= wanted).select("a", "b").union(ties.join(alone, "b").select("a", "b"))


def _overlap_links(x_sets: list[np.ndarray], y_sets: list[np.ndarray] | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of pairs that reach the threshold; without y_sets, pairs within x_sets."""
    every = x_sets + (y_sets or [])
    flat = np.concatenate(every) if every else np.empty(0, np.uint64)
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])[shared]
    _, code = np.unique(code[shared], return_inverse=True)
    size = np.array([len(s) for s in every], np.int64)
    m = len(x_sets)
    total = np.zeros((m, len(every) - m if y_sets is not None else m), np.float64)
    width = 4096
    by = np.argsort(code, kind="stable")
    code, owner = code[by], owner[by]
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, [at, at + width])
        held = np.zeros((len(every), width), np.float32)
        held[owner[lo:hi], code[lo:hi] - at] = 1
        total += held[:m] @ (held[m:] if y_sets is not None else held).T
    other = size[m:] if y_sets is not None else size
    ok = total >= need(size[:m, None], other[None, :], num, den)
    if y_sets is None:
        ok = np.triu(ok, 1)
    return np.nonzero(ok)


def _forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that connect what all the pairs connect."""
    up: dict[int, int] = {}
    out = []

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            up[ra] = rb
            out.append((a, b))
    return out


#: Bits of the map that tells which documents may be in a family; any number gives the same result.
MEMBER_BITS = 1 << 23


def _members(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the hashed ids set, so that documents outside never travel."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(MEMBER_BITS, bool)
        for b in batches:
            held[wordhash.mix(b.column(0).to_numpy().astype(np.uint64)) % np.uint64(MEMBER_BITS)] = True
        if held.any():
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(_SLICES), pa.int32()), "bits": [np.packbits(p).tobytes() for p in held.reshape(_SLICES, -1)]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                bits = np.frombuffer(raw, np.uint8)
                total[at] = total[at] | bits if at in total else bits
        if total:
            yield pa.RecordBatch.from_pydict({"slice": pa.array([*total], pa.int32()), "bits": [v.tobytes() for v in total.values()]})

    kind = "slice int, bits binary"
    rows = ids.mapInArrow(local, kind).repartition(_SLICES, "slice").mapInArrow(merge, kind).collect()
    out = np.zeros((_SLICES, MEMBER_BITS // _SLICES // 8), np.uint8)
    for r in rows:
        out[r.slice] |= np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _verified(docs: DataFrame, members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): links of nodes found by exact counts within families; members: id, node, sig, sig2, n, family of one row for each set."""
    sizes = scratch.keep(members.groupBy("family").agg(F.count("*").alias("of")), "sizes")
    # Sets that link have lengths of one or of neighbouring bands.
    band = F.floor(F.log("n") / F.lit(math.log(1.0001 * den / num))).cast("int")
    large = F.col("of") > BLOCK
    lanes = members.join(sizes, "family").select(
        "id", "node", "sig", "sig2", "family", F.when(large, band).otherwise(0).alias("band"),
        F.when(large, F.pmod(F.xxhash64("node"), F.ceil(F.col("of") / (8 * BLOCK)))).otherwise(0).alias("lane"), "of",
    )
    lanes = scratch.keep(lanes, "lanes")
    packed = _members(lanes.select("id"))

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = np.unpackbits(packed).astype(bool)
        for b in batches:
            yield b.filter(pa.array(member[wordhash.mix(b.column(0).to_numpy().astype(np.uint64)) % np.uint64(MEMBER_BITS)]))

    texts = docs.select("id", "text").mapInArrow(may, "id long, text string").join(lanes, "id").drop("id")
    dealt = texts.repartition("family", "band", "lane").sortWithinPartitions("family", "band", "lane", "node")
    kind = "a long, b long, family long, band int, nodes binary, sizes binary, grams binary"
    names = [c.split()[0] for c in kind.split(", ")]

    def links(a, b) -> pa.RecordBatch:
        m = len(a)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), *[pa.nulls(m, pa.binary())] * 3], names=names)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes, sets, of = None, [], [], 0

        def close():
            i, j = _overlap_links(sets, None, num, den)
            found = _forest((nodes[p], nodes[q]) for p, q in zip(i.tolist(), j.tolist()))
            if found:
                yield links(*zip(*found))
            if of > len(sets):
                sizes = np.array([len(s) for s in sets], np.int64)
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (np.array(nodes, np.int64), sizes, np.concatenate(sets))]], names=names)

        for batch in batches:
            for b in wordhash.portions(batch, batch.schema.get_field_index("text")):
                column = lambda c: b.column(c).to_pylist()  # noqa: B023, E731
                h, size = sets_of(b.column("text"), k)
                same = np.logical_and(*(own.view(np.int64) == b.column(c).to_numpy() for own, c in zip(_signatures(h, size), ("sig", "sig2"))))
                for key, node, total, e, n, own in zip(zip(column("family"), column("band"), column("lane")), column("node"), column("of"), np.cumsum(size), size, same):
                    if not own or (sets and key == held and nodes[-1] == node):
                        continue  # another text under the same id, or a repeated row
                    if sets and (key != held or len(sets) >= BLOCK or sum(map(len, sets)) + n > BLOCK_GRAMS):
                        yield from close()
                        nodes, sets = [], []
                    held, of = key, total
                    nodes.append(node)
                    sets.append(h[e - n : e].copy())
        if sets:
            yield from close()

    made = scratch.keep(dealt.mapInArrow(within, kind), "within")
    blocks = made.where("family is not null").select("family", "band", "nodes", "sizes", "grams").withColumn("block", F.xxhash64("nodes"))
    left = blocks.select("family", F.col("band").alias("own"), F.explode(F.array("band", F.col("band") + 1)).alias("band"), *[F.col(c).alias(f"{c}_x") for c in ("block", "nodes", "sizes", "grams")])
    right = blocks.select("family", "band", *[F.col(c).alias(f"{c}_y") for c in ("block", "nodes", "sizes", "grams")])
    across = left.join(right, ["family", "band"]).where("own < band or block_x < block_y").drop("family", "band", "own", "block_x", "block_y")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(sizes, grams):
            cut = np.cumsum(np.frombuffer(sizes, np.int64))[:-1]
            return np.split(np.frombuffer(grams, np.uint64), cut)

        for b in batches:
            for i in range(b.num_rows):
                get = lambda c: b.column(c)[i].as_buffer()  # noqa: B023, E731
                x, y = np.frombuffer(get("nodes_x"), np.int64), np.frombuffer(get("nodes_y"), np.int64)
                p, q = _overlap_links(sets(get("sizes_x"), get("grams_x")), sets(get("sizes_y"), get("grams_y")), num, den)
                found = _forest(zip(x[p].tolist(), y[q].tolist()))
                if found:
                    a, c = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    return made.where("a is not null").select("a", "b").union(across.mapInArrow(between, "a long, b long"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text", with_sets: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) for every row: the smallest id reachable by links, itself included.

    Two rows link when their sets of distinct k-word shingles (A-Z as a-z; under k words, the whole
    sequence as one) have den * overlap >= num * union. Rows without words or text have n_shingles 0
    and link with nothing; so do rows without id, whose component is null. Repeated rows stay, each
    with its row. Empty tables give none. Other columns are left out. with_sets: also sig and sig2, the
    set's signature, and stands, whether the row's id and set stand for its class.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    facts = _facts(rows, k)
    per_doc = facts.where("slice is null")
    candidates = _candidates(_postings(rows, _heavy(facts), k, num, den), num, den)
    edges = scratch.keep(_edges(candidates, num, den), "edges")
    scratch.drop(candidates)
    families = connected(edges, "a", "b").select(F.col("node").alias("sig"), F.col("component").alias("family"))
    # One document stands for each set; rows of one id that differ in text stand for their own sets.
    least = per_doc.where("n > 0 and id is not null").groupBy("sig", "sig2").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    sets = scratch.keep(least.withColumn("node", F.monotonically_increasing_id()), "sets")
    links = scratch.keep(_verified(rows.where("id is not null"), sets.join(families, "sig"), k, num, den), "jaccard_links")
    scratch.drop(edges)
    classes = connected(links, "a", "b")
    known = scratch.keep(sets.join(classes, "node", "left").select("sig", "sig2", "id", "node", F.coalesce("component", "node").alias("component")), "known")
    scratch.drop(sets)
    scratch.drop(links)
    roots = scratch.keep(known.groupBy("component").agg(F.min(F.struct("id", "node")).alias("m")).select("component", F.col("m.id").alias("component_id"), F.col("m.node").alias("first")), "roots")
    by_set = scratch.keep(known.join(roots, "component").select("sig", "sig2", "component_id", (F.col("node") == F.col("first")).alias("first")), "by_set")
    scratch.drop(known)
    scratch.drop(roots)
    out = per_doc.select("id", F.col("n").alias("n_shingles"), "sig", "sig2").join(by_set, ["sig", "sig2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    extra = ["sig", "sig2", F.coalesce(F.col("first") & (F.col("id") == F.col("component_id")), F.lit(False)).alias("stands")] if with_sets else []
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"), *extra)


def with_signatures(docs: DataFrame, k: int = 5, text_col: str = "text") -> DataFrame:
    """(row, n, sig, sig2): docs' columns as a struct, and size and signature of each row's set."""
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = T.StructType([base.schema["row"], *[T.StructField(c, T.LongType()) for c in ("n", "sig", "sig2")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in wordhash.portions(batch, 1):
                h, size = sets_of(b.column(1), k)
                yield pa.RecordBatch.from_arrays([b.column(0), _signed(size), *map(_signed, _signatures(h, size))], names=["row", "n", "sig", "sig2"])

    return base.mapInArrow(run, kind)
