"""Problem 6: the most similar vectors of every vector.

Unit vectors are projected on M directions with a 2-stable (Gaussian) law: the squared projected distance of two rows at
distance d follows d^2 * chi-square with M degrees of freedom. A kd-tree over the projections cuts the rows into leaves.
A row searches its own leaf first and then the leaves whose boxes are near enough. In a leaf, rows are taken in the order
of their projected distance and verified exactly, a few at a time, until the chi-square test holds: the next projected
distance is one that a row nearer than the k-th best so far would exceed with probability 1 - STOP only.

How far a box may be is a quantile of the distance from a row to the leaf of a simulated neighbour at the k-th best
distance, from the same law. With a least similarity, the k-th best distance is at most that of the floor; a
pair is then found if either of its rows reaches the leaf of the other, so the nearer of the two boxes counts.

The tree has two levels, each fitted on at most about SAMPLE rows a node of the level above, so that the driver never
holds more than two samples' worth of numbers. A leaf of more than FULL rows is searched in chunks; none is capped.
Rows of one direction are folded into one before the search, so no number of copies can fill a leaf.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulegrid.runtime import checkpointed, fan_out

DIMS, M = 64, 24
#: Rows of a leaf where a floor keeps visits few, and where a search may have to see most leaves; rows of a chunk.
LEAF, WIDE_LEAF, FULL = 4096, 16_384, 32_768
#: Rows a level of the tree is fitted on, and the levels' greatest depths.
SAMPLE, DEPTHS = 16_384, (9, 9)
STEP = 1 / 20
SEED = 20240615
#: Of the test in a leaf; of the boxes, for a row's k-th best distance and for a pair at the floor exactly.
STOP, LEAF_STOP, FLOOR_STOP = 0.995, 0.99, 0.95
SALTS = 32
#: Rows verified first where nothing bounds a search, and the rings that follow as quantiles; the last is the test.
FIRST, RINGS = 64, (0.01, 0.3, STOP)
#: More than single precision can be off in a squared distance; what is that near a bound is decided in double precision.
MARGIN = 1e-5


def chi_square(p: float, degrees: int = M) -> float:
    """The p quantile, by Wilson and Hilferty's cube."""
    spread = 2 / (9 * degrees)
    return degrees * (1 - spread + NormalDist().inv_cdf(p) * spread**0.5) ** 3


def _directions() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((DIMS, M))


def unit_rows(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, unit vectors, vectors scaled by a power of two) of the usable ones: DIMS finite numbers, not all zero."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(sizes == DIMS)
    flat = pa.compute.list_flatten(vectors.take(pa.array(keep)))
    x = flat.to_numpy(zero_copy_only=False).astype("f8").reshape(len(keep), DIMS)
    top = np.abs(x).max(1, initial=0)
    good = np.isfinite(top) & (top > 0)
    x, top = x[good], top[good]
    scaled = np.ldexp(x, -np.frexp(top)[1][:, None])
    return keep[good], scaled / np.sqrt((scaled * scaled).sum(1))[:, None], scaled.astype("f4")


def _held(size: int, at: np.ndarray, rows: np.ndarray) -> pa.Array:
    out: list[bytes | None] = [None] * size
    for i, row in zip(at.tolist(), rows):
        out[i] = row.tobytes()
    return pa.array(out, pa.binary())


def _sketch(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each usable vector's direction key with its byte projection or, if `whole`, the scaled vector; others have neither."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = _directions()
        weights = np.random.default_rng(SEED + 1).integers(1, 2**63, DIMS, dtype="u8") | np.uint64(1)
        for batch in batches:
            at, unit, scaled = unit_rows(batch.column("embedding"))
            mixed = (np.rint(unit * 2**20).astype("i8").view("u8") * weights).sum(1, dtype="u8")
            keys = np.zeros(batch.num_rows, "u8")
            keys[at] = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            held = scaled if whole else np.clip(np.rint(unit @ directions / STEP), -127, 127).astype("i1")
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), batch.column("created_at"), pa.array(keys.view("i8")), _held(batch.num_rows, at, held)], ["id", "created_at", "key", "held"])

    return sketch


class Tree:
    """A kd-tree: at each node the projection of greatest spread is halved at its median. Nodes are numbered from 1."""

    def __init__(self, depth: int, dim: np.ndarray, cut: np.ndarray):
        self.depth, self.dim, self.cut = depth, dim, cut

    @classmethod
    def fitted(cls, points: np.ndarray, depth: int) -> Tree:
        dim, cut = np.zeros(2**depth, "i4"), np.zeros(2**depth, "f4")
        held = {1: points}
        for node in range(1, 2**depth):
            mine = held.pop(node, points[:0])
            if len(mine) > 1:
                dim[node] = int(mine.std(0).argmax())
                cut[node] = np.median(mine[:, dim[node]])
            right = mine[:, dim[node]] > cut[node]
            held[2 * node], held[2 * node + 1] = mine[~right], mine[right]
        return cls(depth, dim, cut)

    def below(self, parts: dict[int, Tree], depth: int) -> Tree:
        """The tree with a tree of this depth under each of its leaves; a leaf without one sends all rows to the left."""
        whole = Tree(self.depth + depth, np.zeros(2 ** (self.depth + depth), "i4"), np.full(2 ** (self.depth + depth), np.inf, "f4"))
        whole.dim[: 2**self.depth], whole.cut[: 2**self.depth] = self.dim, self.cut
        for leaf, part in parts.items():
            for level in range(depth):
                there = (2**self.depth + leaf) << level
                whole.dim[there : there + 2**level] = part.dim[2**level : 2 ** (level + 1)]
                whole.cut[there : there + 2**level] = part.cut[2**level : 2 ** (level + 1)]
        return whole

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), "i8")
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.dim[node]] > self.cut[node])
        return node - 2**self.depth

    def gap(self, points: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Squared distance of each point from the box of the leaf of its other."""
        node, rows = np.ones(len(points), "i8"), np.arange(len(points))
        gap = np.zeros(points.shape, "f4")
        for _ in range(self.depth):
            dim, cut = self.dim[node], self.cut[node]
            mine, theirs = points[rows, dim], others[rows, dim] > cut
            off = np.where((mine > cut) != theirs, np.abs(mine - cut), 0)
            gap[rows, dim] = np.maximum(gap[rows, dim], off)
            node = 2 * node + theirs
        return (gap**2).sum(1)

    def reach(self, points: np.ndarray, distance: float, either: bool) -> float:
        """The LEAF_STOP quantile of the squared distance of a point to the leaf of a neighbour at this distance; if
        `either`, the FLOOR_STOP quantile of the nearer of the two boxes. Neighbours are simulated by the projections' law."""
        if not self.depth or not len(points):
            return 0.0
        cosine = max(-1.0, 1 - distance**2 / 2)
        others = (cosine * points + (1 - cosine**2) ** 0.5 * np.random.default_rng(SEED + 2).standard_normal(points.shape)).astype("f4")
        gap = self.gap(points, others)
        return float(np.quantile(np.minimum(gap, self.gap(others, points)), FLOOR_STOP) if either else np.quantile(gap, LEAF_STOP))

    def visit(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf whose box is within the row's squared reach; its own leaf first."""
        row, node = np.arange(len(points)), np.ones(len(points), "i8")
        gap, far = np.zeros((len(points), points.shape[1]), "f4"), np.zeros(len(points), "f4")
        for _ in range(self.depth):
            dim, cut = self.dim[node], self.cut[node]
            off = points[row, dim] - cut
            right = off > 0
            there = far - gap[np.arange(len(row)), dim] ** 2 + off**2
            cross = np.flatnonzero((there <= reach[row]) & np.isfinite(cut))
            new_gap = gap[cross]
            new_gap[np.arange(len(cross)), dim[cross]] = off[cross]
            far, gap = np.concatenate([far, there[cross]]), np.concatenate([gap, new_gap])
            node = np.concatenate([2 * node + right, 2 * node[cross] + ~right[cross]])
            row = np.concatenate([row, row[cross]])
        return row, node - 2**self.depth


def _points(codes: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(codes), "i1").reshape(len(codes), M).astype("f4") * np.float32(STEP)


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), "f4").reshape(len(vectors), DIMS).astype("f8")
    return x / np.sqrt((x * x).sum(1))[:, None]


def _fitter(depth: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree.fitted(_points(pdf["code"]), depth)
        return pd.DataFrame({"leaf": pdf["leaf"].iloc[:1], "dim": [tree.dim.astype("i1").tobytes()], "cut": [tree.cut.tobytes()]})

    return fit


def _leaves_of(tree: Tree) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(leaf=tree.leaf(_points(pdf["code"])).astype("i4") if len(pdf) else np.zeros(0, "i4"))

    return place


def _part(share: Column) -> Column:
    """A part of the rows by the hash of their id."""
    return F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)


def grown(rows: DataFrame, count: int, leaf: int) -> tuple[Tree, np.ndarray]:
    """A tree with leaves of about `leaf` of the rows (id, code), and the points its upper level was fitted on."""
    depth = max(0, int(np.ceil(np.log2(max(1, count) / leaf))))
    upper, lower = min(depth, DEPTHS[0]), min(max(0, depth - DEPTHS[0]), DEPTHS[1])
    sample = [r.code for r in rows.where(_part(F.lit(min(1.0, SAMPLE / max(1, count))))).orderBy("id").select("code").collect()]
    points = _points(pd.Series(sample, dtype=object)) if sample else np.zeros((0, M), "f4")
    tree = Tree.fitted(points, upper)
    if lower:
        placed = rows.mapInPandas(_leaves_of(tree), "id long, code binary, leaf int")
        held = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
        some = placed.join(held, "leaf").where(_part(F.lit(float(SAMPLE)) / F.col("n"))).select("leaf", "code")
        fits = some.groupBy("leaf").applyInPandas(_fitter(lower), "leaf int, dim binary, cut binary").collect()
        tree = tree.below({r.leaf: Tree(lower, np.frombuffer(r.dim, "i1").astype("i4"), np.frombuffer(r.cut, "f4")) for r in fits}, lower)
    return tree, points


def chunks_of(leaves: DataFrame) -> dict[int, int]:
    """leaf -> number of chunks, of the leaves with more than FULL rows; at most one entry a leaf."""
    return {r.leaf: -(-r.n // FULL) for r in leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FULL).collect()}


def _visitor(tree: Tree, chunks: dict[int, int], away: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Adds leaf and chunk: one row per chunk of each leaf within the row's `reach`, without its own leaf if `away`."""

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            row, leaf = tree.visit(_points(pdf["code"]), pdf["reach"].to_numpy("f8"))
            if away:
                row, leaf = row[len(pdf) :], leaf[len(pdf) :]
            times = np.array([chunks.get(x, 1) for x in leaf.tolist()], "i8") if chunks else np.ones(len(leaf), "i8")
            chunk = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            out = pdf.iloc[np.repeat(row, times)].drop(columns="reach").reset_index(drop=True)
            yield out.assign(leaf=np.repeat(leaf, times).astype("i4"), chunk=chunk.astype("i4"))

    return visits


def _placed(tree: Tree, chunks: dict[int, int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Adds the row's own leaf and chunk."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            leaf = tree.leaf(_points(pdf["code"])) if len(pdf) else np.zeros(0, "i8")
            times = np.array([chunks.get(x, 1) for x in leaf.tolist()], "i8")
            yield pdf.assign(leaf=leaf.astype("i4"), chunk=((pdf["id"].to_numpy("i8") * 2654435761 >> 7) % np.maximum(times, 1)).astype("i4"))

    return place


def _flags(radius: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Of a chunk and its visitors (codes only): which rows have another within the projected radius."""

    def flag(base: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        if base.empty or visitors.empty:
            return pd.DataFrame({c: pd.Series(dtype="i8") for c in ("id", "leaf", "chunk", "asks")})
        mine, ids = _points(base["code"]), base["id"].to_numpy()
        square, asked = (mine**2).sum(1), np.zeros(len(base), bool)
        points, asks = _points(visitors["code"]), np.zeros(len(visitors), bool)
        who = visitors["id"].to_numpy()
        for low in range(0, len(points), 1024):
            part = points[low : low + 1024]
            near = (part**2).sum(1)[:, None] + square[None, :] - 2 * part @ mine.T <= radius
            near &= who[low : low + 1024, None] != ids[None, :]
            asks[low : low + 1024] = near.any(1)
            asked |= near.any(0)
        both = pd.concat([base[asked].assign(asks=False), visitors[asks].assign(asks=True)])
        return both[["id", "asks"]].assign(leaf=base["leaf"].iloc[0], chunk=base["chunk"].iloc[0])

    return flag


def searched(base: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, similarity): of unit vectors, each query's k most similar rows other than itself within its squared
    distance `limit`, by incremental search in the order of projected distance."""
    directions = _directions().astype("f4")
    single = base.astype("f4")
    mine = single @ directions
    square = (mine**2).sum(1)
    out_q, out_r, out_s = [], [], []
    for low in range(0, len(queries), 256):
        unit = queries[low : low + 256]
        q = unit.astype("f4")
        proj = q @ directions
        far = (proj**2).sum(1)[:, None] + square[None, :] - 2 * proj @ mine.T
        far[query_ids[low : low + 256, None] == ids[None, :]] = np.inf
        best = limit[low : low + 256].astype("f8").copy()
        held_q, held_r, held_d = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)
        done, products = np.full(len(q), -np.inf), None
        # Rings of growing projected distance; each is verified before the test decides how far the next may go.
        for p in RINGS:
            upper = best * chi_square(p)
            if p == RINGS[0] and far.shape[1] > FIRST:
                upper = np.minimum(upper, np.partition(far, FIRST, axis=1)[:, FIRST]) if (best >= 2).any() else upper
            fresh = (far <= upper[:, None]) & (far > done[:, None]) & np.isfinite(far)
            done = np.maximum(done, upper)
            if fresh.mean() > 0.005:  # many rows at once: all products in single precision first
                products = 2 - 2 * (q @ single.T) if products is None else products
                fresh &= products <= best[:, None] + MARGIN
            at, r = np.nonzero(fresh)
            d = 2 - 2 * (unit[at] * base[r]).sum(1)
            good = d <= best[at] + 1e-12
            held_q, held_r, held_d = np.concatenate([held_q, at[good]]), np.concatenate([held_r, r[good]]), np.concatenate([held_d, d[good]])
            order = np.lexsort((ids[held_r], np.round(held_d, 12), held_q))
            held_q, held_r, held_d = held_q[order], held_r[order], held_d[order]
            place = np.arange(len(held_q)) - np.searchsorted(held_q, held_q)
            last = place == k - 1
            best[held_q[last]] = np.minimum(best[held_q[last]], held_d[last])
            held_q, held_r, held_d = held_q[place < k], held_r[place < k], held_d[place < k]
        out_q.append(held_q + low)
        out_r.append(held_r)
        out_s.append(1 - held_d / 2)
    return (np.concatenate(x) if x else np.zeros(0, "i8") for x in (out_q, out_r, out_s))


def _searcher(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Of a chunk and its visitors, both with vectors: each visitor's k most similar rows of the chunk."""

    def search(base: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        if base.empty or visitors.empty:
            return pd.DataFrame({"a": pd.Series(dtype="i8"), "b": pd.Series(dtype="i8"), "similarity": pd.Series(dtype="f8")})
        base = base.sort_values(["id", "vector"]).drop_duplicates("id")
        visitors = visitors.sort_values(["id", "vector"]).drop_duplicates("id")
        ids, who = base["id"].to_numpy(), visitors["id"].to_numpy()
        q, r, s = searched(_units(base["vector"]), ids, _units(visitors["vector"]), who, k, visitors["furthest"].to_numpy("f8"))
        return pd.DataFrame({"a": who[q], "b": ids[r], "similarity": np.minimum(s, 1.0)})

    return search


def _by_direction(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows by what is read of them; the latest usable row of each id with its direction; the k + 1 first ids of each direction."""
    raw = vectors.where("id IS NOT NULL").select("id", "created_at", "embedding")
    latest = (
        raw.mapInArrow(_sketch(False), "id long, created_at timestamp, key long, held binary")
        .groupBy("id").agg(F.max(F.struct("created_at", "key", "held")).alias("v")).select("id", "v.key", F.col("v.held").alias("code")).where("code IS NOT NULL")
    )
    latest = checkpointed(latest)
    by_key = Window.partitionBy("key").orderBy("id")
    heads = checkpointed(latest.withColumn("place", F.row_number().over(by_key)).where(F.col("place") <= k + 1))
    return raw, latest, heads


def _to_rows(both: DataFrame, latest: DataFrame, heads: DataFrame, k: int, asked: Column) -> DataFrame:
    """The k most similar rows of every asked row from (a, b, similarity) of directions."""
    # Back from directions to rows. A direction of more than k rows fills its rows' lists by itself.
    group = heads.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    first = F.element_at("ids", 1)
    small = group.where(F.size("ids") <= k).select(first.alias("a"), F.explode("ids").alias("id")).where(asked)
    other = both.join(small, "a").join(group.select(first.alias("b"), "ids"), "b").select("id", F.explode("ids").alias("neighbour_id"), "similarity")
    several = fan_out(group.where(F.size("ids") > 1).select("key", "ids"), SALTS)
    own = latest.where(asked).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(several, ["key", "salt"]).select("id", F.explode("ids").alias("neighbour_id"), F.lit(1.0).alias("similarity"))
    every = other.unionByName(own).where("id <> neighbour_id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 12)), "neighbour_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k)


_VISIT = "id long, code binary, leaf int, chunk int"
_PAIR = "a long, b long, similarity double"


def _whole(raw: DataFrame) -> DataFrame:
    return raw.mapInArrow(_sketch(True), "id long, created_at timestamp, key long, held binary").where("held IS NOT NULL").select("id", "key", F.col("held").alias("vector"))


def similar(vectors: DataFrame, k: int = 5, floor: float = 0.9) -> DataFrame:
    """(id, neighbour_id, similarity, rank): for every row its `k` most similar rows of cosine similarity `floor` or more.

    vectors: id, created_at, embedding. The latest row of an id counts; of several latest ones one by a fixed rule.
    Unusable vectors (null, not DIMS numbers, not finite, all zero) have no neighbours and are none. The scale of a vector
    does not matter. Rows of one direction have similarity 1; ties are ordered by the smaller neighbour id. A row with
    fewer than k such neighbours has fewer rows; an empty table gives an empty result. The search is approximate: see
    README for its recall against brute force.

    Codes alone travel to the leaves first; vectors follow only for the rows that have another within the projected
    radius of the floor there, and are searched and verified in the leaf.
    """
    wanted = 2 - 2 * floor
    raw, latest, heads = _by_direction(vectors, k)
    reps = heads.where("place = 1").select("id", "key", "code")
    tree, points = grown(reps.select("id", "code"), reps.count(), LEAF)
    reach = tree.reach(points, wanted**0.5, either=True)
    chunks = chunks_of(reps.select("id", "code").mapInPandas(_leaves_of(tree), "id long, code binary, leaf int")) if tree.depth else {}
    codes = reps.select("id", "code")
    base = codes.mapInPandas(_placed(tree, chunks), _VISIT)
    visits = codes.withColumn("reach", F.lit(reach)).mapInPandas(_visitor(tree, chunks, False), _VISIT)
    place = ["leaf", "chunk"]
    flags = base.groupBy(*place).cogroup(visits.groupBy(*place)).applyInPandas(_flags(wanted * chi_square(STOP)), "id long, leaf int, chunk int, asks boolean")
    held = checkpointed(flags.join(reps.select("id", "key"), "id").join(_whole(raw), ["id", "key"]))
    # New column identities: the two sides of a cogroup come from one frame.
    asking = held.where("asks").toDF(*held.columns).withColumn("furthest", F.lit(wanted))
    both = held.where("NOT asks").groupBy(*place).cogroup(asking.groupBy(*place)).applyInPandas(_searcher(k), _PAIR)
    # A pair is found from the row whose reach is the nearer box; it counts for both.
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("w")
    both = both.select(ways, "similarity").select("w.a", "w.b", "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return _to_rows(both, latest, heads, k, F.lit(True))


def similar_pairs(vectors: DataFrame, k: int = 5, floor: float = 0.9) -> DataFrame:
    """(id_a, id_b), the smaller first: pairs of which one is among the k most similar of the other."""
    found = similar(vectors, k, floor)
    return found.select(F.least("id", "neighbour_id").cast("int").alias("id_a"), F.greatest("id", "neighbour_id").cast("int").alias("id_b")).distinct()


#: Squared distances for which the reach is simulated; between them the next larger counts.
_GRID = np.linspace(0, 2, 21)[1:] ** 2


def _reach_of(tree: Tree, points: np.ndarray) -> Column:
    """The reach of a row by its squared k-th best distance `furthest`."""
    out = F.lit(float("inf"))
    for square in _GRID[::-1]:
        out = F.when(F.col("furthest") <= float(square), tree.reach(points[:4096], float(square) ** 0.5, either=False)).otherwise(out)
    return out


def nearest(vectors: DataFrame, k: int = 5, asked: Column | None = None) -> DataFrame:
    """(id, neighbour_id, similarity, rank): for every asked row its `k` most similar of all rows, however far they are.

    asked: a condition on `id`; all rows by default. Vectors, copies, ties and empty tables as in `similar`. A row first
    searches its own leaf, which gives its k-th best distance, then the leaves which that distance reaches.
    """
    asked = F.lit(True) if asked is None else asked
    raw, latest, heads = _by_direction(vectors, k)
    reps = heads.where("place = 1").select("id", "key", "code")
    tree, points = grown(reps.select("id", "code"), reps.count(), WIDE_LEAF)
    chunks = chunks_of(reps.select("id", "code").mapInPandas(_leaves_of(tree), "id long, code binary, leaf int")) if tree.depth else {}
    placed = reps.join(_whole(raw), ["id", "key"])
    base = checkpointed(placed.mapInPandas(_placed(tree, chunks), "id long, key long, code binary, vector binary, leaf int, chunk int"))
    keys = latest.where(asked).select("key").distinct()
    queries = base.drop("leaf", "chunk").join(keys, "key", "left_semi")
    place, visit = ["leaf", "chunk"], "id long, key long, code binary, vector binary, furthest double, leaf int, chunk int"
    there = base.select("id", "vector", *place)

    def round_(rows: DataFrame, away: bool) -> DataFrame:
        visits = rows.mapInPandas(_visitor(tree, chunks, away), visit).select("id", "vector", "furthest", *place)
        return there.groupBy(*place).cogroup(visits.groupBy(*place)).applyInPandas(_searcher(k), _PAIR)

    home = checkpointed(round_(queries.withColumns({"furthest": F.lit(4.0), "reach": F.lit(0.0)}), False))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    bound = home.withColumn("place", best).where(F.col("place") == k).select(F.col("a").alias("id"), (2 - 2 * F.col("similarity")).alias("furthest"))
    far = queries.join(bound, "id", "left").withColumn("furthest", F.coalesce("furthest", F.lit(4.0))).withColumn("reach", _reach_of(tree, points))
    every = home.unionByName(round_(far, True)) if tree.depth else home
    both = every.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return _to_rows(both.withColumn("place", best).where(F.col("place") <= k).drop("place"), latest, heads, k, asked)
