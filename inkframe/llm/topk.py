"""Exact search for the k greatest inner products, by ball trees in shards.

Vectors of integers are dealt into shards of like size: a bounded sample of them names cells, cells lie in a row in
which neighbours are alike, and a vector's place in the row, by its cell's running count and a hash of the row, gives the
shard. So copies of one vector are dealt out like others. A shard's task builds a ball tree of its vectors and answers
queries as they stream in, in blocks: nodes wait in a heap by the greatest inner product that any open query of the block
can have in the ball, and a query leaves a node as soon as its k-th score so far is out of the ball's reach. Scores are
integers, so the bound, rounded down, also settles ties: a ball that reaches just the k-th score counts only if it holds a
smaller id.

Each query first searches the shard it lies in. Its k-th score there goes along to the other shards, of which only those
in reach get the query at all.

Vectors that are null or hold a null, infinite or undefined component take no part; shorter vectors count as filled up
with zeros; an empty table gives no rows. Each row is a query or candidate of its own, repeated ids and vectors
included; a row is no candidate of itself. A null id comes last among ties. Components beyond a long are cut to its range,
and scores likewise. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors that name cells, taken by a hash of the row: a bounded sample that only speed depends on.
CELLS = 256
#: A shard holds SPAN times the root of the number of vectors, within these bounds.
SPAN, LEAST, MOST = 16, 2_048, 131_072
#: Shards are looked at in so many groups before queries are sent to them.
GROUPS = 1_024
LEAF = 64
BLOCK = 512
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max
ROWS = "shard int, tag int, home int, row long, id long, vec array<long>, kth long, kth_id long"
FOUND = "row long, id long, score long, other long"
BALLS = "shard int, center array<double>, radius double, least long"


def top_k(df: DataFrame, is_query: Column, scratch: Scratch, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank from 1, id, score) of the k greatest inner products of each query row with all other rows.

    Components are floor(scale * x). Ties go to the smaller id.
    """
    fine = F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    vec = F.transform(vec_col, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    rows = df.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), vec.alias("vec"))
    # written, so that a row's number stays
    rows = scratch.cut(rows)
    n, width = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    n, width = n or 1, width or 0
    placed, count = _placed(rows, n, width)
    placed = scratch.cut(placed)
    none = F.lit(None).cast("long")
    stored = placed.select("shard", F.lit(0).alias("tag"), F.lit(0).alias("home"), "row", "id", "vec", none.alias("kth"), none.alias("kth_id"))
    asking = placed.where("asks").select("shard", F.lit(1).alias("tag"), F.col("shard").alias("home"), "row", "id", "vec", none.alias("kth"), none.alias("kth_id"))
    first = scratch.cut(_searched(stored.unionByName(asking), k, width, count))
    kth = first.groupBy("row").agg(F.count("*").alias("n"), F.min(F.struct("score", -F.coalesce("other", F.lit(LAST)))).alias("worst"))
    kth = kth.where(F.col("n") >= k).select("row", F.col("worst.score").alias("kth"), (-F.col("worst.col2")).alias("kth_id"))
    sent = _sent(asking.drop("kth", "kth_id").join(kth, "row", "left"), _groups(stored, width, count), count, width)
    more = _searched(stored.unionByName(sent), k, width, count)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("other"))
    best = first.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("id").alias("query_id"), "rank", F.col("other").alias(id_col), "score")


def _placed(rows: DataFrame, n: int, width: int) -> tuple[DataFrame, int]:
    """Adds shard, and how many there are."""
    size = int(min(MOST, max(LEAST, SPAN * n**0.5)))
    count = -(-n // size)
    sample = rows.orderBy(F.xxhash64("row"), "row").select("vec").limit(CELLS).collect()
    pivots = np.unique(filled([r.vec for r in sample], width).astype(float), axis=0)
    pivots = pivots[chain(pivots)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (pivots**2).sum(1) / 2
        for b in batches:
            cells = np.empty(b.num_rows, np.int32)
            for lo in range(0, b.num_rows, 1024):
                part = b.column(3).slice(lo, 1024)
                cells[lo : lo + 1024] = np.argmax(matrix(part, width).astype(float) @ pivots.T - half, axis=1) if len(pivots) else 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells)], names=["row", "id", "asks", "vec", "cell"])

    celled = rows.mapInArrow(run, "row long, id long, asks boolean, vec array<long>, cell int")
    # CELLS rows at most
    sums = sorted((r.cell, r["count"]) for r in celled.groupBy("cell").count().collect())
    before, met = {}, 0
    for cell, c in sums:
        before[cell] = (met, c)
        met += c
    if not before:
        return celled.withColumn("shard", F.lit(0)).drop("cell"), 1
    place = F.create_map(*[x for cell, (b, c) in before.items() for x in (F.lit(cell), F.struct(F.lit(b).alias("b"), F.lit(c).alias("c")))])[F.col("cell")]
    along = F.pmod(F.xxhash64("row"), F.lit(1 << 20)) / float(1 << 20)
    shard = F.least(F.lit(count - 1), F.floor((place["b"] + along * place["c"]) * count / met)).cast("int")
    return celled.withColumn("shard", shard).drop("cell"), count


def chain(x: np.ndarray) -> np.ndarray:
    """An order of rows in which each is followed by the nearest of those left."""
    left, out = list(range(len(x))), []
    while left:
        at = left[int(np.argmin(((x[left] - x[out[-1]]) ** 2).sum(1)))] if out else 0
        left.remove(at)
        out.append(at)
    return np.array(out, int)


def filled(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of width numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), flat.dtype)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _groups(stored: DataFrame, width: int, count: int) -> list[tuple[int, np.ndarray, float, int]]:
    """Balls around the vectors of each group of neighbouring shards; GROUPS at most."""
    each = -(-count // GROUPS)
    group = F.floor(F.col("shard") / each).cast("int")

    def centers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            g, x = b.column(0).to_numpy(), matrix(b.column(1), width).astype(float)
            for key in np.unique(g).tolist():
                own = sums.setdefault(key, [0, np.zeros(width)])
                own[0] += int((g == key).sum())
                own[1] += x[g == key].sum(0)
        for key, (c, s) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([c]), pa.array([s], pa.list_(pa.float64()))], names=["g", "n", "s"])

    partial = stored.select(group.alias("g"), "vec").mapInArrow(centers, "g int, n long, s array<double>")
    terms = partial.select("g", "n", F.posexplode("s").alias("i", "x")).groupBy("g", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
    # a row a group
    middle = {r.g: np.array([v.x for v in r.c]) for r in terms.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).collect()}

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far: dict[int, tuple[float, int]] = {}
        for b in batches:
            g, x = b.column(0).to_numpy(), matrix(b.column(1), width).astype(float)
            ids = b.column(2).fill_null(LAST).to_numpy()
            for key in np.unique(g).tolist():
                own, (r, least) = g == key, far.get(key, (0.0, LAST))
                d = ((x[own] - middle.get(key, np.zeros(width))) ** 2).sum(1).max()
                far[key] = (max(r, float(d) ** 0.5), min(least, int(ids[own].min())))
        for key, (r, least) in far.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([r]), pa.array([least])], names=["g", "r", "least"])

    ends = stored.select(group.alias("g"), "vec", "id").mapInArrow(reach, "g int, r double, least long").groupBy("g").agg(F.max("r").alias("r"), F.min("least").alias("least")).collect()
    return [(r.g, middle.get(r.g, np.zeros(width)), r.r, r.least) for r in ends]


def _sent(asking: DataFrame, groups: list, count: int, width: int) -> DataFrame:
    """The queries for each shard but their own whose group is in reach."""
    each = -(-count // GROUPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = Balls(np.stack([g[1] for g in groups]), np.array([g[2] for g in groups]), np.array([g[3] for g in groups])) if groups else None
        for b in batches:
            if not balls or not b.num_rows:
                continue
            at = {f.name: b.column(i) for i, f in enumerate(b.schema)}
            q = matrix(at["vec"], width)
            kth, kth_id = at["kth"].fill_null(NONE).to_numpy(), at["kth_id"].fill_null(LAST).to_numpy()
            ask, g = np.nonzero(balls.in_reach(q, np.linalg.norm(q.astype(float), axis=1), kth, kth_id))
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(ask)).columns, pa.array(np.array([x[0] for x in groups], np.int32)[g])], names=[*b.schema.names, "g"])

    asked = asking.select("tag", "home", "row", "id", "vec", "kth", "kth_id").mapInArrow(run, "tag int, home int, row long, id long, vec array<long>, kth long, kth_id long, g int")
    shards = F.sequence(F.col("g") * each, F.least(F.lit(count), (F.col("g") + 1) * each) - 1)
    return asked.withColumn("shard", F.explode(shards)).drop("g").where("shard != home").select(*[x.split()[0] for x in ROWS.split(", ")])


def _searched(rows: DataFrame, k: int, width: int, count: int) -> DataFrame:
    """(row, id, score, other) of the up to k best candidates of each query in each shard it was sent to, if better than its
    k-th score so far. rows are vectors (tag 0) and queries (tag 1) of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                part = batch.slice(lo, hi - lo)
                if key[lo] // 2 != shard:
                    shard, held, tree = key[lo] // 2, [], None
                if key[lo] % 2 == 0:
                    held.append((part.column(3).to_numpy(), part.column(4).fill_null(LAST).to_numpy(), matrix(part.column(5), width)))
                    continue
                if tree is None:
                    if not held:
                        continue  # no vector fell in this shard
                    tree, held = Tree(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                for at in range(0, part.num_rows, BLOCK):
                    yield from answers(tree, part.slice(at, BLOCK))

    def answers(tree: Tree, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kth, kth_id = part.column(6).fill_null(NONE).to_numpy(), part.column(7).fill_null(LAST).to_numpy()
        score, other = tree.search(part.column(3).to_numpy(), matrix(part.column(5), width), k, kth, kth_id)
        q, j = np.nonzero(other != NONE)
        ids = other[q, j]
        yield pa.RecordBatch.from_arrays([part.column(3).take(pa.array(q)), part.column(4).take(pa.array(q)), pa.array(score[q, j]), pa.array(ids, mask=ids == LAST)], names=["row", "id", "score", "other"])

    return rows.repartition(min(count, 20_000), "shard").sortWithinPartitions("shard", "tag", "home").mapInArrow(run, FOUND)


class Balls:
    """Balls with the least id inside each."""

    def __init__(self, center: np.ndarray, radius: np.ndarray, least: np.ndarray):
        self.center, self.radius, self.least, self.norm = center, radius, least, np.linalg.norm(center, axis=1)

    def bounds(self, q: np.ndarray, norm: np.ndarray, nodes: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The greatest inner product that each query can have in each ball; a trifle more, for rounding."""
        reach = norm[:, None] * self.radius[nodes]
        return np.floor(q @ self.center[nodes].T + reach + 1e-9 * (norm[:, None] * self.norm[nodes] + reach) + 1e-3)

    def in_reach(self, q: np.ndarray, norm: np.ndarray, kth: np.ndarray, kth_id: np.ndarray, nodes: np.ndarray | slice = slice(None), bound: np.ndarray | None = None) -> np.ndarray:
        bound = self.bounds(q.astype(float), norm, nodes) if bound is None else bound
        return (bound > kth[:, None]) | ((bound == kth[:, None]) & (self.least[nodes] < kth_id[:, None]))


class Tree(Balls):
    """A ball tree; a leaf holds LEAF vectors at most, or copies of one vector."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, x: np.ndarray):
        by_id = np.lexsort((row, ids))
        self.row, self.ids, self.x = row[by_id], ids[by_id], x[by_id]
        float_x = self.x.astype(float)
        self.most = float(np.abs(float_x).max(initial=0))
        center, radius, least, self.child, self.member = [], [], [], [], []
        waiting = [(np.arange(len(row)), -1)]
        while waiting:
            at, parent = waiting.pop()
            points = float_x[at]
            c = points.mean(0)
            far = ((points - c) ** 2).sum(1)
            me = len(center)
            if parent >= 0:
                self.child[parent].append(me)
            center.append(c)
            radius.append(float(far.max()) ** 0.5)
            least.append(int(self.ids[at].min()))
            self.child.append([])
            self.member.append(None)
            if len(at) <= LEAF or (points == points[0]).all():
                self.member[me] = at
                continue
            a = points[np.argmax(far)]
            b = points[np.argmax(((points - a) ** 2).sum(1))]
            order = np.argsort(points @ (b - a), kind="stable")
            waiting += [(np.sort(at[order[: len(at) // 2]]), me), (np.sort(at[order[len(at) // 2 :]]), me)]
        super().__init__(np.stack(center), np.array(radius), np.array(least))

    def search(self, row: np.ndarray, q: np.ndarray, k: int, kth: np.ndarray, kth_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best for each query; id NONE where there is none that beats the k-th it came with."""
        score = np.repeat(kth[:, None], k, axis=1)
        tie = np.repeat(kth_id[:, None], k, axis=1)  # the id that an equal score must be below
        other = np.full((len(q), k), NONE)
        float_q = q.astype(float)
        norm = np.linalg.norm(float_q, axis=1)
        exact = self.most * float(np.abs(float_q).max(initial=0)) * max(1, q.shape[1]) < 2**53
        heap = [(0.0, 0, np.arange(len(q)), None)]
        while heap:
            _, node, open_, bound = heapq.heappop(heap)
            # the k-th scores may have risen since
            use = self.in_reach(float_q[open_], norm[open_], score[open_, -1], tie[open_, -1], np.array([node]), bound)[:, 0]
            open_ = open_[use]
            if not len(open_):
                continue
            if self.member[node] is None:
                both = np.array(self.child[node])
                bounds = self.bounds(float_q[open_], norm[open_], both)
                for i, child in enumerate(both.tolist()):
                    heapq.heappush(heap, (-float(bounds[:, i].max()), child, open_, bounds[:, i : i + 1]))
                continue
            at = self.member[node]
            if len(at) > LEAF:
                at = at[: k + 1]  # copies: those of the least ids
            got = products(float_q[open_], self.x[at]) if exact else wide_products(q[open_], self.x[at])
            ids = np.broadcast_to(self.ids[at], got.shape)
            taken = self.row[at][None, :] != row[open_][:, None]
            taken &= (got > score[open_, -1:]) | ((got == score[open_, -1:]) & (ids < tie[open_, -1:]))
            hit = taken.any(1)
            if not hit.any():
                continue
            open_, got, ids, taken = open_[hit], got[hit], ids[hit], taken[hit]
            every = np.concatenate([score[open_], np.where(taken, got, NONE)], axis=1)
            ties = np.concatenate([tie[open_], np.where(taken, ids, LAST)], axis=1)
            names = np.concatenate([other[open_], np.where(taken, ids, NONE)], axis=1)
            # greatest score first; ~x turns the order without leaving the range
            best = np.lexsort((ties, ~every), axis=-1)[:, :k]
            score[open_], tie[open_], other[open_] = (np.take_along_axis(x, best, axis=1) for x in (every, ties, names))
        return score, other


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (q @ x.astype(float).T).astype(np.int64)


def wide_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For numbers that doubles don't hold; cut to the range of a long."""
    out = q.astype(object) @ x.astype(object).T
    return np.clip(out, NONE + 1, LAST).astype(np.int64)
