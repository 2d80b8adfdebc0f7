"""Exact search for the largest inner products: ball trees with branch and bound."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from presswork.llm.workers import find_package, map_batches
from presswork.session import durable_table

#: Vectors of a shard, on average, and queries searched for together.
SHARD_ROWS = 4096
QUERY_ROWS = 4096
#: Shards at most, so that the table of their balls stays small; beyond, shards hold more rows.
MAX_SHARDS = 4096
#: Vectors that the planes between shards are fitted to, at most.
SAMPLE = 20_000
#: After so many shards, how many a query visits in its next round; else all that are left.
FIRST_VISITS = {0: 1, 1: 3, 4: 16}
#: Vectors of a leaf.
LEAF = 64
#: Relative slack of bounds, for rounding of floating-point numbers.
_SLACK = 1e-9
#: Products below this are exact in 64-bit integers and in doubles.
_EXACT = 2.0 ** 53


def scaled(vector: Column, factor: int = 1024) -> Column:
    """A vector's components x as floor(factor * x), doubles; NULL if it takes no part."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)),
                  F.transform(doubles, lambda x: F.call_function("floor", x * factor).cast("double")))


@dataclass
class _Node:
    """Rows ``start`` to ``end`` of the tree's order, inside a ball; children if it is no leaf."""

    start: int
    end: int
    centre: np.ndarray
    radius: float
    least_id: int
    children: tuple["_Node", ...] = ()


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each query (row) and ball (column), what no product with a vector in the ball exceeds.

    The product with the centre plus the query's norm times the radius, and some slack for rounding.
    """
    norms = np.sqrt((queries ** 2).sum(axis=1))[:, None]
    reach = norms * radii[None]
    top = queries @ centres.T + reach
    return top + _SLACK * (np.abs(top) + norms * np.sqrt((centres ** 2).sum(axis=1))[None] + reach)


class BallTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.rows = self.ids if rows is None else rows[order]
        # Components so large that products leave 53 bits are multiplied as Python's integers.
        self.large = not ((vectors ** 2).sum(axis=1).max() < _EXACT / 2)
        self.root = self._node(0, len(ids))

    def _node(self, start: int, end: int) -> _Node:
        part = self.vectors[start:end]
        centre = part.mean(axis=0)
        distances = np.sqrt(((part - centre) ** 2).sum(axis=1))
        node = _Node(start, end, centre, float(distances.max()), int(self.ids[start:end].min()))
        if end - start > LEAF and node.radius > 0:
            # Two far points; each row goes to the nearer one, equal halves if that does not split.
            one = part[distances.argmax()]
            other = part[((part - one) ** 2).sum(axis=1).argmax()]
            side = part @ (other - one)
            middle = (end - start) // 2
            order = np.argsort(side, kind="stable")
            self.vectors[start:end] = part[order]
            for kept in {id(a): a for a in (self.ids, self.rows)}.values():
                kept[start:end] = kept[start:end][order]
            node.children = (self._node(start, start + middle), self._node(start + middle, end))
        return node

    def _products(self, node: _Node, query: np.ndarray) -> np.ndarray:
        rows = self.vectors[node.start:node.end]
        if not self.large and query @ query < _EXACT / 2:
            return rows @ query
        factors = [int(x) for x in query]
        exact = [sum(int(x) * y for x, y in zip(row, factors)) for row in rows]
        return np.array([min(max(s, -2 ** 63), 2 ** 63 - 1) for s in exact], object)

    def search(self, query: np.ndarray, own: int, k: int, floor: tuple[float, int] | None
               ) -> list[tuple[float, int]]:
        """Up to ``k`` (score, id), best first, but for the row ``own``; those below ``floor`` may lack.

        ``floor`` is the kth score known elsewhere, with its id.

        Nodes are visited by their upper bound, the product with the centre plus the
        query's norm times the radius; once the bound does not reach the kth score, the rest
        is cut off. At an equal score the smaller id wins.
        """
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst on top

        def bound(node: _Node) -> float:
            return float(upper_bounds(query[None], node.centre[None], np.array([node.radius]))[0, 0])

        def beaten(top: float, least_id: int) -> bool:
            if floor is not None and (top, -least_id) < (floor[0], -floor[1]):
                return True
            return len(best) == k and (top, -least_id) < best[0]
        waiting = [(-bound(self.root), 0, self.root)]
        count = 1
        while waiting:
            top, _, node = heapq.heappop(waiting)
            if beaten(-top, node.least_id):
                if -top < (best[0][0] if len(best) == k else -np.inf):
                    break
                continue
            if node.children:
                for child in node.children:
                    top = bound(child)
                    if not beaten(top, child.least_id):
                        heapq.heappush(waiting, (-top, count, child))
                        count += 1
                continue
            scores = self._products(node, query)
            ids = self.ids[node.start:node.end]
            usable = self.rows[node.start:node.end] != own
            if len(best) == k:
                usable &= scores >= best[0][0]
            for at in np.flatnonzero(usable):
                entry = (int(scores[at]), -int(ids[at]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(score, -negative) for score, negative in sorted(best, reverse=True)]


class Regions:
    """Space cut into leaves of about equally many vectors of a sample, by planes between far points."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.planes: list[tuple[np.ndarray, float, int, int]] = []
        self.leaves = 0
        self.root = self._cut(sample, leaves)

    def _cut(self, part: np.ndarray, leaves: int) -> int:
        """The number of a plane, or of a leaf as one below 0."""
        normal = None
        if leaves > 1 and len(part) > 1:
            one = part[((part - part.mean(axis=0)) ** 2).sum(axis=1).argmax()]
            normal = part[((part - one) ** 2).sum(axis=1).argmax()] - one
        if normal is None or not normal.any():
            self.leaves += 1
            return -self.leaves
        side = part @ normal
        first = leaves // 2
        value = float(np.partition(side, min(len(side) * first // leaves, len(side) - 1))[
            min(len(side) * first // leaves, len(side) - 1)])
        at = len(self.planes)
        self.planes.append((normal, value, 0, 0))
        low = side < value
        children = self._cut(part[low], first), self._cut(part[~low], leaves - first)
        self.planes[at] = (normal, value, *children)
        return at

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector, from 0."""
        at = np.full(len(vectors), self.root)
        while (inside := np.flatnonzero(at >= 0)).size:
            for plane in np.unique(at[inside]):
                normal, value, low, high = self.planes[plane]
                own = inside[at[inside] == plane]
                at[own] = np.where(vectors[own] @ normal < value, low, high)
        return -1 - at


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _in_shards(usable: DataFrame, length: int, total: int, shard_rows: int) -> DataFrame:
    """The vectors of one length with their ``shard`` and its ``piece``, written, near ones together.

    Planes are fitted to at most SAMPLE vectors, drawn by a hash; every vector then gets its
    region. A region with more rows than a shard should have, such as many equal vectors,
    is dealt to pieces by a hash.
    """
    leaves = min(MAX_SHARDS, max(1, -(-total // shard_rows)))
    rows = usable.filter(F.col("length") == length)
    drawn = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("vector").toArrow()
    regions = Regions(_matrix(drawn.column(0)), leaves) if drawn.num_rows else Regions(np.zeros((1, max(length, 1))), 1)
    schema = "row long, vec_id long, vector array<double>, asks boolean, shard int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = regions.of(_matrix(batch.column(2))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(own)], names=["row", "vec_id", "vector", "asks", "shard"])

    placed = durable_table(map_batches(rows.select("row", "vec_id", "vector", "asks"), run, schema))
    pieces = placed.groupBy("shard").agg(F.ceil(F.count("*") / (2 * shard_rows)).cast("int").alias("_pieces"))
    # One row for each shard.
    return placed.join(F.broadcast(pieces), "shard").withColumn(
        "piece", F.pmod(F.xxhash64(F.lit("piece"), "row"), "_pieces").cast("int")).drop("_pieces")


def _balls(shards: DataFrame) -> pa.Table:
    """One row for each shard and piece: its centre, radius and least id."""
    schema = "shard int, piece int, centre array<double>, radius double, least_id long"

    def run(key, rows):
        vectors = _matrix(rows.column("vector"))
        centre = vectors.mean(axis=0)
        radius = float(np.sqrt(((vectors - centre) ** 2).sum(axis=1).max()))
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int32()), "piece": pa.array([key[1].as_py()], pa.int32()),
            "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius]),
            "least_id": pa.array([int(rows.column("vec_id").to_numpy().min())], pa.int64())})

    find_package(shards)
    return shards.select("shard", "piece", "vector", "vec_id").groupBy("shard", "piece").applyInArrow(
        run, schema).toArrow()


_VISIT = "query_row long, query_vector array<double>, kth_score long, kth_id long, shard int, piece int"


def _visits(state: DataFrame, balls: pa.Table, skip: int, most: int | None) -> DataFrame:
    """Which shards each query searches now: of those by falling bound, ``most`` beyond the first ``skip``.

    Only those whose bound reaches the kth score that is known.
    """
    centres, radii = _matrix(balls.column("centre")), balls.column("radius").to_numpy()
    least = balls.column("least_id").to_numpy()
    shards, pieces = balls.column("shard").to_numpy(), balls.column("piece").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                bounds = upper_bounds(_matrix(part.column(1)), centres, radii)
                order = np.argsort(-bounds, axis=1, kind="stable")
                order = order[:, skip:None if most is None else skip + most]
                tops = np.take_along_axis(bounds, order, 1)
                score = part.column(2).to_numpy(zero_copy_only=False).astype(float)[:, None]
                vec = part.column(3).fill_null(0).to_numpy()[:, None]
                reaches = np.isnan(score) | (tops > score) | ((tops == score) & (least[order] < vec))
                owner, place = np.nonzero(reaches)
                ball = order[owner, place]
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(pa.array(owner)) for c in part.columns],
                     pa.array(shards[ball]), pa.array(pieces[ball])], names=_NAMES)

    return map_batches(state.select("query_row", "query_vector", "kth_score", "kth_id"), run, _VISIT)


_NAMES = [field.split()[0] for field in _VISIT.split(", ")]


def _search_piece(k: int):
    schema = ["query_row", "vec_id", "score"]

    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(candidates) and len(queries):
            tree = BallTree(candidates["vec_id"].to_numpy(), np.stack(candidates["vector"].to_numpy()),
                            candidates["row"].to_numpy())
            asked = np.stack(queries["query_vector"].to_numpy())
            for own, query, score, vec in zip(queries["query_row"], asked, queries["kth_score"], queries["kth_id"]):
                floor = None if pd.isna(score) else (int(score), int(vec))
                found += [(own, vec_id, int(value)) for value, vec_id in tree.search(query, own, k, floor)]
        return pd.DataFrame(found, columns=schema).astype("int64")
    return run


def _found(visits: DataFrame, shards: DataFrame, k: int, query_rows: int) -> DataFrame:
    """The best rows of each visit. Queries of a piece meet it in blocks, each with a copy of the piece."""
    visits = durable_table(visits)
    blocks = visits.groupBy("shard", "piece").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks"))
    # One row for each piece.
    blocks = F.broadcast(durable_table(blocks))
    asked = visits.join(blocks, ["shard", "piece"]).withColumn(
        "block", F.pmod(F.xxhash64(F.lit("block"), "query_row"), "blocks").cast("int")).toDF(
        "q_shard", "q_piece", *_NAMES[:4], "blocks", "q_block")
    rows = shards.join(blocks, ["shard", "piece"]).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "shard", "piece", "block", "row", "vec_id", "vector")
    return (rows.groupBy("shard", "piece", "block")
            .cogroup(asked.drop("blocks").groupBy("q_shard", "q_piece", "q_block"))
            .applyInPandas(_search_piece(k), "query_row long, vec_id long, score long"))


def top_inner_products(vectors: DataFrame, query: Column, k: int = 10, shard_rows: int = SHARD_ROWS,
                       query_rows: int = QUERY_ROWS) -> DataFrame:
    """For each query the ``k`` other rows with the largest inner product, exactly.

    ``vectors`` has ``vec_id`` (long) and ``vector`` (array of integral doubles; NULL
    takes no part); ``query`` is a condition that picks the queries among its rows.
    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (long); fewer than
    ``k`` rows if there are fewer candidates; at equal scores the smaller id comes first.

    Space is cut into regions by planes, and each region's rows are a shard with a ball
    around them and a ball tree inside. The balls are a small table, by which a query knows
    its bound for every shard. It searches the shard with the highest bound, then in
    rounds the next ones, several at a time, and only those whose bound still reaches the kth score
    that it has; in each tree that score is the bound to beat from the start. Queries meet
    a shard in blocks, so neither has to fit into one task, and a visit returns at most
    ``k`` rows. Many equal vectors make no deep tree: a ball of radius 0 is a leaf.

    Vectors of different lengths never meet. Rows with a repeated id are rows of their own:
    each is a candidate, also for a query of that id, and each query row has its own ranks.
    Products beyond 64 bits count as the
    largest or smallest long; components beyond them as the largest or smallest one.
    """
    usable = durable_table(vectors.filter("vec_id IS NOT NULL AND vector IS NOT NULL").select(
        F.monotonically_increasing_id().alias("row"), "vec_id", "vector", F.size("vector").alias("length"),
        query.alias("asks")))
    # As many rows as there are lengths of vectors with queries among them.
    lengths = usable.groupBy("length").agg(F.count("*").alias("rows"), F.count_if("asks").alias("asking")).filter(
        "asking > 0 AND length > 0").collect()
    result = None
    for length, rows, _ in lengths:
        found = _top_of_length(usable, length, rows, k, shard_rows, query_rows)
        result = found if result is None else result.union(found)
    if result is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ids = usable.filter("asks").select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return result.join(ids, "query_row").select("query_id", "rank", "vec_id", "score")


def _top_of_length(usable: DataFrame, length: int, total: int, k: int, shard_rows: int,
                   query_rows: int) -> DataFrame:
    """(query_row, rank, vec_id, score) among the vectors of one length."""
    shards = durable_table(_in_shards(usable, length, total, shard_rows))
    balls = _balls(shards)
    asked = shards.filter("asks").select(F.col("row").alias("query_row"), F.col("vector").alias("query_vector"))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    best, seen = None, 0
    while seen < balls.num_rows:
        if best is None:
            state = asked.withColumns({c: F.lit(None).cast("long") for c in ("kth_score", "kth_id")})
        else:
            kth = best.filter(F.col("rank") == k).select(
                "query_row", F.col("score").alias("kth_score"), F.col("vec_id").alias("kth_id"))
            state = asked.join(kth, "query_row", "left")
        # One shard, then a few more, then all that are left.
        most = FIRST_VISITS[seen] if seen in FIRST_VISITS else None
        found = _found(_visits(state, balls, seen, most), shards, k, query_rows)
        if best is not None:
            found = found.union(best.drop("rank"))
        best = durable_table(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
                             .withColumn("rank", F.col("rank").cast("int")))
        seen = balls.num_rows if most is None else seen + most
    return best.select("query_row", "rank", "vec_id", "score")
